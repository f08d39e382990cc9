"""More queries over the sales graph, for operators that the headline queries don't reach; each with SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .errors import GraphloomError, MappingError, StoreError
from .functions import builtins, iri, language, text, tools
from .operators import behavior, classes, detect, pattern, shapes, timeline, traverse, versions
from .operators.pattern import Check, EdgePattern, NodePattern
from .operators.shapes import Constraint, Path, PropertyShape, Shape, Shapes, predicate
from .plans import compile as rule_compile
from .plans import confidence, fixpoint, ir, reason
from .plans.rules import Parser, relation_atom
from .queries import orders, query, starts, with_behaviors
from .sources import graph as sources
from .sources import io, ontology
from .sources.graph import Graph
from .sources.work import work_dir

C = Constraint


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/query-{uuid.uuid4().hex}"


def prefixed_edges(g: Graph) -> Graph:
    """The graph with language prefixes on two relation types."""
    rel = F.col("rel_type")
    return g.with_(edges=g.edges.withColumn("rel_type", F.when(rel == "suppliedBy", "swrl:suppliedBy").when(rel == "contains", "rule:contains").otherwise(rel)))


# Sources and sinks


@query("SELECT label, count(*) AS n FROM (SELECT label FROM n UNION ALL SELECT 'Individual' FROM n WHERE ind) GROUP BY 1")
def source_views(g):
    """The graph read back from views."""
    tag = uuid.uuid4().hex
    names = {k: f"{k}_{tag}" for k in ("nodes", "edges", "props")}
    for k, name in names.items():
        getattr(g, k).createOrReplaceTempView(name)
    return sources.from_views(g.spark, **names).health()


@query("SELECT rel AS rel_type, count(*) AS n FROM e GROUP BY 1")
def source_fallback(g):
    """A path that isn't there gives the graph held ready instead."""
    return sources.open_graph(g.spark, folder(g.spark), fallback=g).edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rel AS rel_type, count(*) AS n, count(val) AS with_value FROM e GROUP BY 1")
def source_saved(g):
    """The graph saved by relation type and key, and read again by a store."""
    path = folder(g.spark)
    sources.ParquetStore(path).save(g)
    again = sources.build(sources.ParquetStore(path), g.spark)
    return again.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


@query("SELECT 'nation:' || n_nationkey AS node_id, n_name AS name, 'region:' || n_regionkey AS dst FROM nation")
def source_rows(g):
    """Nations as dicts, a bounded table, made into a graph of their own."""
    found = g.nodes.where(F.col("node_id").startswith("nation:")).select("node_id", "name", "type").collect()
    made = sources.from_rows(g.spark, [{"labels": ["Type"], "id": r.node_id, "name": r.name} for r in found], [{"src": r.node_id, "rel_type": "in", "dst": r.type} for r in found])
    return made.nodes.select("node_id", "name").join(made.edges.select(F.col("src").alias("node_id"), "dst"), "node_id")


@query("""SELECT 'customer:' || c_custkey AS node_id, '{"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS json FROM customer""")
def sink_json_values(g):
    return io.value_to_json(g.props.where(F.col("node_id").startswith("customer:")))


@query("SELECT 'order:' || o_orderkey AS node_id, o_totalprice > 0 AS paid, '[0] order:' || o_orderkey AS head FROM orders")
def sink_events(g):
    """A line per order written as JSON lines and read back."""
    path = folder(g.spark)
    seen = orders(g).select(F.lit("order").alias("start"), "node_id", F.lit(0).alias("hop"), F.lit(0.5).alias("confidence"), F.lit("ok").alias("state"))
    io.write_events(reason.narrated(seen), path)
    return g.spark.read.json(path).select("node_id", (F.col("confidence") > 0).alias("paid"), F.substring_index("line", " confidence", 1).alias("head"))


@query("SELECT '[0] nation:' || n_nationkey || ' confidence 0.5000 ok' AS value FROM nation")
def sink_log(g):
    path = folder(g.spark)
    seen = g.nodes.where(F.col("node_id").startswith("nation:")).select(F.lit("x").alias("start"), "node_id", F.lit(0).alias("hop"), F.lit(0.5).alias("confidence"), F.lit("ok").alias("state"))
    io.write_log(reason.narrated(seen), path)
    return g.spark.read.text(path)


@query("""SELECT line FROM (SELECT '- ' || label || ': ' || count(*) AS line FROM (SELECT label FROM n UNION ALL SELECT 'Individual' FROM n WHERE ind) GROUP BY label
  UNION ALL SELECT '- ' || node_id || ' (Class)' FROM (SELECT node_id, label FROM n ORDER BY node_id LIMIT 3) WHERE label = 'Class'
  UNION ALL SELECT '- ' || src || ' -[' || rel || ']-> ' || dst FROM (SELECT * FROM e ORDER BY src, rel, dst LIMIT 3))""")
def sink_prompt(g):
    """The markdown view with a limit of three nodes and edges, which is its feature."""
    lines = [x for x in io.render(g, 3).split("\n") if x.startswith("- ")]
    return rows(g.spark, [(x,) for x in lines], "line string")


RULE_FILES = {"near": "# rules of places\n[near: locatedIn(?a,?n) ^ locatedIn(?n,?r) -> within(?a,?r)]\n", "buys": "[buys: placedBy(?o,?c) ^ contains(?o,?p) -> buys(?c,?p)]\nbroken line\n", "plain": "nation:3 is a word of this file"}


def rule_files(spark: SparkSession) -> str:
    """The rule files above in a folder of their own."""
    path = folder(spark)
    for name, body in RULE_FILES.items():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{path}/{name}.swrl")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(body.encode()))
        out.close()
    return path


@query("""SELECT subject, predicate, object FROM (SELECT DISTINCT a.src AS subject, 'within' AS predicate, b.dst AS object FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'locatedIn' AND b.rel = 'locatedIn'
  UNION ALL SELECT DISTINCT a.dst, 'buys', b.dst FROM e a JOIN e b ON a.src = b.src WHERE a.rel = 'placedBy' AND b.rel = 'contains')""")
def rules_from_folder(g):
    """Rules from the text files of a folder; comments and lines that are no rules are left out."""
    path = rule_files(g.spark)
    rules = [r for name in ("near", "buys") for r in io.read_rules(g.spark, f"{path}/{name}.swrl")]
    return fixpoint.run(g, rules).facts.select("subject", "predicate", "object")


@query("""SELECT rule_name, source_file, count(*) AS n FROM (SELECT src, rel, dst, 'near: locatedIn(?a,?n) ^ locatedIn(?n,?r) -> within(?a,?r)' AS rule_name, 'near' AS source_file FROM e WHERE rel = 'locatedIn'
  UNION ALL SELECT src, rel, dst, 'buys: placedBy(?o,?c) ^ contains(?o,?p) -> buys(?c,?p)', 'buys' FROM e WHERE rel IN ('placedBy', 'contains') UNION ALL SELECT src, rel, dst, 'plain', 'plain' FROM e WHERE src = 'nation:3' OR dst = 'nation:3') GROUP BY 1, 2""")
def rules_mentioned(g):
    """Edges whose relation or ends are words of a rule file."""
    return io.find_rules(g.spark, rule_files(g.spark), g.edges.select("src", "rel_type", "dst")).groupBy("rule_name", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'rule:' || n_nationkey AS node_id, '[r: locatedIn(?x,nation:' || n_nationkey || ') -> class:home(?x)]' AS text FROM nation")
def rules_as_nodes(g):
    found = g.nodes.where(F.col("node_id").startswith("nation:")).select("node_id").collect()
    made = [{"labels": ["Rule"], "id": r.node_id.replace("nation", "rule"), "rule": f"[r: locatedIn(?x,{r.node_id}) -> class:home(?x)]"} for r in found]
    return io.rule_nodes(versions.insert(g, made))


@query("SELECT 'type:' || t AS node_id, t AS name, up AS dst FROM (SELECT DISTINCT p_brand AS t, 'type:' || p_type AS up FROM part)")
def import_taxonomy(g):
    """Brands below part types as a table of pairs; types that are there already are left alone."""
    pairs = g.spark.read.parquet(f"{g.source}/part.parquet").select(F.col("p_brand").alias("name"), F.col("p_type").alias("parent"))
    grown = versions.import_types(versions.import_types(g, pairs), pairs)
    new = grown.nodes.where(F.col("node_id").startswith("type:Brand")).select("node_id", "name")
    return new.join(grown.edges.where("rel_type = 'subClassOf'").select(F.col("src").alias("node_id"), "dst"), "node_id")


@query("SELECT 'urn:entity:E' || s_suppkey AS node_id, 'E' || s_suppkey AS code, key, value FROM supplier, LATERAL (VALUES ('speed', s_acctbal::VARCHAR), ('code', 'E' || s_suppkey), ('id', 'urn:entity:E' || s_suppkey), ('type', 'nation:' || s_nationkey)) t(key, value)")
def import_entities(g):
    """Entities from a table, a row each; a second import changes nothing."""
    table = g.spark.read.parquet(f"{g.source}/supplier.parquet").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_acctbal").alias("speed"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("type"))
    grown = versions.import_entities(versions.import_entities(g, table), table)
    new = grown.nodes.where(F.col("code").rlike("^E[0-9]+$")).select("node_id", "code")
    return new.join(grown.props.select("node_id", "key", F.col("raw").alias("value")), "node_id")


@query("SELECT dst AS node_id, count(*) AS children FROM e WHERE rel = 'subClassOf' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_parents(g):
    return traverse.top_parents(g, 3)


# Lookups, plans and patterns


@query("SELECT x AS name, x IN (SELECT code FROM n WHERE label = 'Entity') AS is_code, x IN (SELECT name FROM n WHERE label = 'Type') AS is_type FROM (SELECT unnest(['P1', 'O1', 'NATION_2', 'ECONOMY', 'none']) AS x)")
def exists_checks(g):
    names = ("P1", "O1", "NATION_2", "ECONOMY", "none")
    return rows(g.spark, [(x, pattern.exists_code(g, x), pattern.exists_type(g, x)) for x in names], "name string, is_code boolean, is_type boolean")


@query("SELECT 'order:' || o_orderkey AS subject, 'customer:' || o_custkey AS object FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def plan_rule(g):
    rule = Parser().parse("[r: placedBy(?o,?c) ^ swrlb:greaterThan(?c.c_acctbal, 5000) -> rich(?o,?c)]")
    return ir.execute(g, ir.Plan("rule", {"rule": rule})).select("subject", "object")


@query("""SELECT 'json' AS plan, p_name AS value FROM part WHERE p_partkey = 5 UNION ALL SELECT 'code', 'part:5' UNION ALL SELECT 'label', count(*)::VARCHAR FROM n WHERE label = 'Event'
  UNION ALL SELECT 'pattern', count(*)::VARCHAR FROM e WHERE rel = 'locatedIn' UNION ALL SELECT 'up', dst FROM e WHERE src = 'nation:2' AND rel = 'subClassOf' UNION ALL SELECT 'down', code FROM e JOIN n ON node_id = dst WHERE src = 'part:5' AND rel = 'suppliedBy'
  UNION ALL SELECT 'valid', (p_size >= 10)::VARCHAR FROM part WHERE p_partkey = 5 UNION ALL SELECT 'call', count(*)::VARCHAR FROM e WHERE rel = 'placedBy' UNION ALL SELECT 'bad', 'StoreError' UNION ALL SELECT 'missing', 'StoreError'""")
def plan_variants(g):
    """Every kind of plan, and two that are refused."""
    go = lambda name, **a: ir.execute(g, ir.Plan(name, a))
    one = lambda name, df, value: df.select(F.lit(name).alias("plan"), value.cast("string").alias("value"))
    count = F.count(F.lit(1))
    ir.FUNCTIONS["edges_of"] = lambda graph, a: graph.edges.where(F.col("rel_type") == a["rel_type"])
    parts = [
        one("json", go("json_path", code="P5", path="$.p_name"), F.col("value")), one("code", go("get_by_code", code="P5"), F.col("node_id")), one("label", go("get_by_label", label="Event").agg(count.alias("n")), F.col("n")),
        one("pattern", go("pattern", edge=EdgePattern("locatedIn")).agg(count.alias("n")), F.col("n")), one("up", go("parent_types", child="nation:2"), F.col("node_id")),
        one("down", go("downstream", node="part:5", rel_types=["suppliedBy"]), F.col("code")), one("valid", go("validate", code="P5", checks=[Check("min", "p_size", 10)]), F.col("passed")),
        one("call", ir.execute(g, ir.parse_call("func:edges_of(rel_type=placedBy)")).agg(count.alias("n")), F.col("n")),
    ]
    for name, plan in (("bad", ir.Plan("nothing", {})), ("missing", ir.Plan("call", {"function": "none"}))):
        try:
            ir.execute(g, plan)
        except StoreError as e:
            parts.append(one(name, g.spark.range(1), F.lit(type(e).__name__)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(", r AS (SELECT 'part:7' AS node_id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.node_id WHERE rel IN ('suppliedBy', 'contains') AND depth < 5) SELECT node_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1", recursive=True)
def inference_by_prefix(g):
    """What lies downstream over edges with a language prefix, whatever their action."""
    return traverse.inference_closure(prefixed_edges(g), starts(g, "part:7"), by_prefix=True)


@query("SELECT rel AS rel_type, count(*) AS n, CASE rel WHEN 'suppliedBy' THEN 'rules' WHEN 'contains' THEN 'direction' WHEN 'next' THEN 'custom_func' WHEN 'locatedIn' THEN 'extract' ELSE 'facts' END AS target FROM e WHERE rel IN ('suppliedBy', 'contains', 'next', 'locatedIn', 'subClassOf') GROUP BY 1")
def edge_router_prefixes(g):
    """The targets that prefixes and functions lead to."""
    some = prefixed_edges(g).edges.where(F.col("rel_type").isin("swrl:suppliedBy", "rule:contains", "next", "locatedIn", "subClassOf"))
    some = some.withColumns({"func": F.when(F.col("rel_type") == "next", "f"), "action_type": F.lit("inference"), "rel_type": F.when(F.col("rel_type") == "locatedIn", "func:locatedIn").otherwise(F.col("rel_type"))})
    return language.route(some).groupBy(F.element_at(F.split("rel_type", ":"), -1).alias("rel_type"), "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src AS start, dst AS \"end\" FROM e JOIN p ON p.node_id = src AND key = 'p_brand' AND s = 'Brand#2' WHERE rel = 'suppliedBy'")
def pattern_builders(g):
    """A pattern put together step by step."""
    start = NodePattern().with_label("Entity").with_property("p_brand", "Brand#2").with_variable("p")
    return pattern.match(g, start, EdgePattern().with_type("suppliedBy"), NodePattern().with_variable("s")).select("start", "end")


@query("SELECT hop::INTEGER AS hop, count(*) AS nodes, count(*) FILTER (c < 0.5 AND hop = 1) AS blocked FROM (SELECT 1 AS hop, least(1.0, greatest(0.0, c_acctbal / 10000)) AS c FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 2, 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal / 10000 >= 0.5) GROUP BY 1")
def explore_counts(g):
    """Nodes and blocked nodes per hop, from every order to its customer and the customer's nation."""
    narrow = g.with_(edges=g.edges.where(F.col("rel_type").isin("placedBy", "locatedIn")))
    return traverse.hop_counts(traverse.explore(narrow, orders(g), 2, threshold=0.5))


# Rules


@query("SELECT 'steps' AS what, 3 AS n UNION ALL SELECT 'total_derived', (SELECT count(DISTINCT (a.src, b.dst)) FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn') + (SELECT count(DISTINCT (a.src, c.dst)) FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn' AND c.rel = 'locatedIn') UNION ALL SELECT 'trips', 0 UNION ALL SELECT 'a', count(DISTINCT (a.src, b.dst)) FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn'")
def rule_statistics(g):
    """What a run reports: rounds, facts in all and per rule, trips of the gate."""
    out = fixpoint.run(g, Parser().parse_all("[a: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]\n[b: shipsFrom(?o,?n) ^ locatedIn(?n,?r) -> shipsWithin(?o,?r)]"))
    found = {k: out.stats[k] for k in ("steps", "total_derived", "trips")} | {"a": out.per_rule["a"]}
    return rows(g.spark, list(found.items()), "what string, n long")


@query("SELECT 1 AS iter, count(DISTINCT (a.src, b.dst)) AS n FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn' UNION ALL SELECT 2, count(DISTINCT (a.src, c.dst)) FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn' AND c.rel = 'locatedIn'")
def rule_hook(g):
    """A hook sees each round's new facts."""
    seen = []
    fixpoint.run(g, Parser().parse_all("[a: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]\n[b: shipsFrom(?o,?n) ^ locatedIn(?n,?r) -> shipsWithin(?o,?r)]"), on_round=lambda new: seen.append((new.first().iter, new.count())))
    return rows(g.spark, seen, "iter int, n long")


@query("SELECT 'customer:' || c_custkey AS subject FROM customer WHERE length(c_mktsegment) > 8")
def rule_registered(g):
    """A built-in of one's own in a rule body."""
    builtins.register("longerThan", lambda a, b: F.length(builtins.text(a)) > builtins.whole(b))
    found = fixpoint.derive_once(g, Parser().parse("[l: class:customer(?c) ^ swrlb:longerThan(?c.c_mktsegment, 8) -> class:long(?c)]")).select("subject")
    return found


@query("SELECT name, body_vars, head_vars, safe FROM (VALUES ('reach', '?c,?n,?o', '?n,?o', true), ('vip', '?c', '?c', true)) t(name, body_vars, head_vars, safe)")
def rule_variables(g):
    """Variables of rules, from text and from helpers."""
    found = Parser().parse_all("# two rules\n\n[reach: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]\nnot a rule\n[vip: class:customer(?c) ^ class:segment:BUILDING(?c) -> class:builder(?c)]")
    assert relation_atom("placedBy", "?o", "?c") == found[0].body[0]
    return rows(g.spark, [(r.name, ",".join(r.body_variables), ",".join(r.head_variables), r.safe) for r in found], "name string, body_vars string, head_vars string, safe boolean")


@query("SELECT 'order:' || o_orderkey AS subject, 'http://s.org#from' AS predicate, 'customer:' || o_custkey AS object FROM orders")
def rule_prefixes(g):
    """Names with registered prefixes and the default namespace stand for whole IRIs."""
    base = "http://s.org#"
    made = g.with_(edges=g.edges.withColumn("rel_type", F.when(F.col("rel_type") == "placedBy", base + "placedBy").otherwise(F.col("rel_type"))))
    return fixpoint.derive_once(made, Parser({"s": base}, base).parse("[p: s:placedBy(?o,?c) -> :from(?o,?c)]")).select("subject", "predicate", "object")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE rel WHEN 'INSTANCE_OF' THEN 'class' WHEN 'HAS_VALUE' THEN 'data' ELSE 'relation' END AS kind FROM e) GROUP BY 1")
def rule_facts(g):
    return rule_compile.base_facts(g).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rel AS predicate, count(*) AS n, true AS known FROM e WHERE rel IN ('INSTANCE_OF', 'subClassOf', 'HAS_VALUE') GROUP BY 1 UNION ALL SELECT rel, count(*), false FROM e WHERE rel NOT IN ('INSTANCE_OF', 'subClassOf', 'HAS_VALUE') GROUP BY 1")
def vocabulary_relations(g):
    """Which relation types are ontology terms, by lookup of the term and back."""
    found = g.edges.groupBy(F.col("rel_type").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))
    known = [r.predicate for r in found.collect() if vocab.is_known_relation(r.predicate) and vocab.RELATION_OF_AXIOM[vocab.AXIOM_OF_RELATION[r.predicate]] == r.predicate]
    return found.withColumn("known", F.col("predicate").isin(*known))


@query("SELECT label, label <> 'nothing' AS known, label IN ('Individual', 'Entity', 'Event', 'Type') AS individual, label IN ('Class', 'Type') AS class FROM (SELECT DISTINCT label FROM n UNION ALL SELECT 'Individual' UNION ALL SELECT 'nothing')")
def vocabulary_labels(g):
    found = [r.label for r in g.health().collect()] + ["nothing"]
    return rows(g.spark, [(x, vocab.is_known_label(x), vocab.is_individual_label(x), vocab.is_class_label(x)) for x in found], "label string, known boolean, individual boolean, class boolean")


@query("SELECT term, rdf FROM (VALUES ('Class', 'owl:Class'), ('ObjectProperty', 'owl:ObjectProperty'), ('SubClassOf', 'rdfs:subClassOf'), ('ClassAssertion', 'rdf:type'), ('nothing', 'KeyError'), ('label', 'annotation'), ('symmetric', 'aspect')) t(term, rdf)", graph=False)
def vocabulary_terms(spark, d):
    def of(term):
        try:
            return vocab.RDF_PREDICATES.get(term) or (vocab.is_annotation(term) and "annotation") or (vocab.is_aspect(term) and "aspect") or vocab.rdf_type(term)
        except KeyError as e:
            return type(e).__name__

    return rows(spark, [(t, of(t)) for t in ("Class", "ObjectProperty", "SubClassOf", "ClassAssertion", "nothing", "label", "symmetric")], "term string, rdf string")


@query("SELECT c_custkey, abs(c_acctbal) AS size, (c_custkey % 2 = 1) AS negated, contains(',' || c_mktsegment || ',', ',MACHINERY,') AS listed, 3::BIGINT AS items, c_custkey * 2 - 1 AS less, c_custkey * 3 AS times, ends_with(c_name, '7') AS ends, c_custkey <> 5 AS other, c_acctbal <= 5000 AS low, c_acctbal < 5000 AS lower FROM customer", graph=False)
def rule_builtins_more(spark, d):
    """The built-ins that the rules of other queries don't use, on every customer."""
    b, c = builtins.BUILTINS, F.col
    listed = F.concat(F.lit("A, "), c("c_mktsegment"), F.lit(" ,,B"))
    return spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", b["abs"](c("c_acctbal")).cast("double").alias("size"), b["booleanNot"](F.when(c("c_custkey") % 2 == 1, "False").otherwise("true")).alias("negated"),
        b["listContains"](listed, F.lit("MACHINERY")).alias("listed"), b["listLength"](listed).cast("bigint").alias("items"), b["subtract"](b["multiply"](c("c_custkey"), F.lit(2)), F.lit("1")).cast("bigint").alias("less"),
        b["multiply"](c("c_custkey"), F.lit("3")).cast("bigint").alias("times"), b["endsWith"](c("c_name"), F.lit("7")).alias("ends"), b["notEqual"](c("c_custkey"), F.lit("5.0")).alias("other"),
        b["lessThanOrEqual"](c("c_acctbal"), F.lit("5000")).alias("low"), b["lessThan"](c("c_acctbal"), F.lit("5000")).alias("lower"),
    )


@query("SELECT mode, threshold, weight, passed FROM (VALUES ('permissive', 0.15::DOUBLE, 0.45::DOUBLE, true), ('balanced', 0.3::DOUBLE, 0.3::DOUBLE, true), ('strict', 0.5::DOUBLE, 0.25::DOUBLE, false)) t(mode, threshold, weight, passed)")
def confidence_modes(g):
    """Modes by old and new names, weights of sources, and what a gate of each mode does with a score of 0.45; the gate forgets its trips."""
    reasoner, out = reason.Reasoner(g), []
    for name, old, source in (("permissive", "training", "explicit"), ("balanced", "exercise", "rule"), ("strict", "WarFighting", "inherited")):
        reasoner.switch_mode(old)
        gate = confidence.Gate(reasoner.mode.value)
        passed = gate.check(0.45, name)
        gate.reset()
        assert reasoner.mode is confidence.Mode.of(name) and not gate.tripped
        out.append((name, reasoner.mode.value, confidence.SOURCE_WEIGHTS[source], passed))
    return rows(g.spark, out, "mode string, threshold double, weight double, passed boolean")


# Shapes


def report(name: str, make, sql: str):
    def run(g):
        return make(g)

    run.__name__ = f"shacl_{name}"
    query(sql)(run)


def one(target: tuple[str, str], path: Path, *constraints: Constraint) -> list[Shape]:
    return [Shape("S", (target,), (PropertyShape(path, constraints),))]


def found(g: Graph, *args) -> DataFrame:
    return shapes.validate(g, one(*args)).select("focus", "component")


ENTITY = ("class", "Entity")
report("node_target", lambda g: found(g, ("node", "P5"), predicate("p_size"), C("min_inclusive", 99)), "SELECT 'part:5' AS focus, 'min_inclusive' AS component")
report("bytes", lambda g: found(g, ENTITY, predicate("p_name"), C("max_bytes", 9), C("min_bytes", 9)), "SELECT node_id AS focus, CASE WHEN strlen(s) > 9 THEN 'max_bytes' ELSE 'min_bytes' END AS component FROM p WHERE key = 'p_name' AND strlen(s) <> 9")
report("min_length", lambda g: found(g, ENTITY, predicate("c_mktsegment"), C("min_length", 9)), "SELECT node_id AS focus, 'min_length' AS component FROM p WHERE key = 'c_mktsegment' AND length(s) < 9")
report("min_exclusive", lambda g: found(g, ENTITY, predicate("p_size"), C("min_exclusive", 10), C("max_inclusive", 40)), "SELECT node_id AS focus, CASE WHEN num <= 10 THEN 'min_exclusive' ELSE 'max_inclusive' END AS component FROM p WHERE key = 'p_size' AND (num <= 10 OR num > 40)")
report("language", lambda g: found(g, ENTITY, predicate("p_size"), C("language_in", ("en",)), C("min_inclusive", 45)), "SELECT node_id AS focus, 'min_inclusive' AS component FROM p WHERE key = 'p_size' AND num < 45")
report("non_empty", lambda g: shapes.validate(versions.update_props(g, g.props.where("key = 'p_brand' AND raw = 'Brand#2'").withColumn("raw", F.lit(""))), one(ENTITY, predicate("p_brand"), C("non_empty"))).select("focus", "component"), "SELECT node_id AS focus, 'non_empty' AS component FROM p WHERE key = 'p_brand' AND s = 'Brand#2'")
report("node_kind", lambda g: found(g, ENTITY, Path("alternative", (predicate("locatedIn"), predicate("p_size"))), C("node_kind", "iri")), "SELECT node_id AS focus, 'node_kind' AS component FROM p WHERE key = 'p_size'")
report("and_or", lambda g: found(g, ENTITY, predicate("p_size"), C("and", (C("min_inclusive", 10), C("max_inclusive", 20))), C("or", (C("max_exclusive", 10), C("min_exclusive", 30)))), "SELECT node_id AS focus, 'and' AS component FROM p WHERE key = 'p_size' AND NOT num BETWEEN 10 AND 20 UNION ALL SELECT node_id, 'or' FROM p WHERE key = 'p_size' AND num BETWEEN 10 AND 30")
report("qualified_max", lambda g: found(g, ("class", "Event"), Path("sequence", (predicate("contains"), predicate("p_size"))), C("qualified_max", (2, C("min_inclusive", 25)))), "SELECT src AS focus, 'qualified_max' AS component FROM e JOIN p ON p.node_id = dst AND key = 'p_size' WHERE rel = 'contains' AND num >= 25 GROUP BY 1 HAVING count(*) > 2")
report("unique_per_node", lambda g: found(g, ("class", "Event"), Path("sequence", (predicate("contains"), predicate("p_brand"))), C("unique_per_node")), "SELECT src AS focus, 'unique_per_node' AS component FROM (SELECT src, count(*) OVER (PARTITION BY src, s) AS n FROM e JOIN p ON p.node_id = dst AND key = 'p_brand' WHERE rel = 'contains') WHERE n > 1")
report("path_star", lambda g: found(g, ("class", "Type"), Path("zero_or_more", (predicate("subClassOf"),)), C("min_count", 3)), "SELECT node_id AS focus, 'min_count' AS component FROM n WHERE label = 'Type' AND (node_id LIKE 'region:%' OR node_id LIKE 'type:%')")
report("custom", lambda g: found(g, ENTITY, predicate("p_size"), C("custom", lambda kind, raw, num: num % 2 == 0)), "SELECT node_id AS focus, 'custom' AS component FROM p WHERE key = 'p_size' AND num % 2 <> 0")
report("node_logic", lambda g: shapes.validate(g, [Shape("N", (("subjects_of", "locatedIn"),), (), (C("or", (C("class", "Type"), C("class", "Event"))), C("not", (C("class", "Type"),)), C("xone", (C("class", "Type"), C("class", "Individual"))), C("and", (C("class", "Entity"), C("class", "Individual"))), C("node_kind", "iri"), C("required")))]).select("focus", "component"),
       "SELECT src AS focus, c AS component FROM (SELECT DISTINCT src FROM e WHERE rel = 'locatedIn'), (SELECT unnest(['or', 'not', 'xone', 'and']) AS c) WHERE CASE c WHEN 'or' THEN src NOT LIKE 'nation:%' WHEN 'not' THEN src LIKE 'nation:%' WHEN 'xone' THEN src LIKE 'nation:%' ELSE src LIKE 'nation:%' END")
report("paths_shown", lambda g: shapes.validate(g, one(ENTITY, Path("sequence", (predicate("suppliedBy"), Path("inverse", (predicate("suppliedBy"),)))), C("max_count", 40))).groupBy("path", "severity").agg(F.count(F.lit(1)).alias("n")),
       "SELECT 'suppliedBy/^suppliedBy' AS path, 'Violation' AS severity, count(*) AS n FROM (SELECT a.src FROM (SELECT DISTINCT src, dst FROM e WHERE rel = 'suppliedBy') a JOIN (SELECT DISTINCT src, dst FROM e WHERE rel = 'suppliedBy') b ON a.dst = b.dst GROUP BY 1 HAVING count(*) > 40) HAVING count(*) > 0")


@query("SELECT node_id AS focus, 1::BIGINT AS n FROM p WHERE key = 'p_size' AND num < 25")
def shacl_shape_set(g):
    """A set in which a shape is replaced by name, one is removed, one is switched off, and one property is; results by focus node."""
    known = Shapes()
    known.add(Shape("Size", (ENTITY,), (PropertyShape(predicate("p_size"), (C("min_inclusive", 1000),)),)))
    known.add(Shape("Size", (ENTITY,), (PropertyShape(predicate("p_size"), (C("min_inclusive", 25),)), PropertyShape(predicate("p_brand"), (C("max_length", 0),), deactivated=True))))
    known.add(Shape("Gone", (ENTITY,), (PropertyShape(predicate("p_size"), (C("min_inclusive", 1000),)),)))
    known.add(Shape("Off", (ENTITY,), (PropertyShape(predicate("p_size"), (C("min_inclusive", 1000),)),)).with_(deactivated=True))
    known.remove("Gone")
    return shapes.grouped(shapes.validate(g, known), "focus")


@query("SELECT node_id AS focus, 'too small' AS message, 'order more' AS suggestion, 'Info' AS severity, s AS value FROM p WHERE key = 'p_size' AND num < 60 AND node_id IN (SELECT dst FROM e WHERE src = 'order:1' AND rel = 'contains')")
def shacl_only_some(g):
    """Validation of some nodes only, with a message, a suggestion and a severity."""
    shape = Shape("Size", (ENTITY,), (PropertyShape(predicate("p_size"), (C("min_inclusive", 60),), shapes.INFO, False, "too small", "order more"),))
    some = pattern.relationships(g, "order:1", "contains").select(F.col("dst").alias("focus"))
    return shapes.validate(g, [shape], only=some).select("focus", "message", "suggestion", "severity", "value")


# Behaviours, versions and writes


@query("SELECT 'part:' || p_partkey AS node_id, CASE WHEN p_size % 3 = 0 THEN 'run_rule' WHEN p_size % 3 = 1 THEN 'log' ELSE 'none' END AS action, CASE p_size % 3 WHEN 0 THEN 'a(?x,?y) -> b(?y,?x)' WHEN 1 THEN 'notify' ELSE '' END AS effect_body FROM part")
def behavior_effects(g):
    """What an effect's text is handed to."""
    size = g.props.where("key = 'p_size'").select("node_id", (F.col("num") % 3).alias("k"))
    effect = F.when(F.col("k") == 0, "swrl:a(?x,?y) -> b(?y,?x)").when(F.col("k") == 1, "func:notify").otherwise("")
    return behavior.effects(size.select("node_id", effect.alias("effect"))).select("node_id", "action", "effect_body")


@query("SELECT DISTINCT dst AS subject, 'supplies' AS predicate, src AS object, (SELECT count(*) FROM part WHERE p_size >= 10) AS ready FROM e WHERE rel = 'suppliedBy'")
def behavior_run(g):
    """Behaviours that pass, run by the facade: the rule in their effect makes facts that join the graph."""
    made = with_behaviors(g)
    rule = "swrl:suppliedBy(?x,?y) -> supplies(?y,?x)"
    made = made.with_(props=made.props.withColumn("raw", F.when(F.col("key") == "hasEffect", rule).otherwise(F.col("raw"))))
    reasoner = reason.Reasoner(made)
    ready, _ = reasoner.execute_behaviors(write=True)
    return reasoner.graph.edges.where("rel_type = 'supplies'").select(F.col("src").alias("subject"), F.col("rel_type").alias("predicate"), F.col("dst").alias("object"), F.lit(ready.count()).alias("ready"))


@query("""SELECT 'order:' || o_orderkey AS start, hop::INTEGER AS hop, CASE WHEN hop = 1 THEN 'customer:' || o_custkey ELSE 'order:' || o_orderkey END AS node_id, CASE WHEN hop = 1 AND o_custkey % 2 = 0 AND c_acctbal <= 2000 THEN 'precondition' ELSE 'ok' END AS state,
  'order:' || o_orderkey || '_v5' AS copy, (SELECT count(*) FROM n WHERE node_id LIKE 'order:%' OR node_id IN (SELECT 'customer:' || o_custkey FROM orders)) AS copies FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest([0, 1]) AS hop)""")
def pipeline_version(g):
    """The pipeline with a version, from every order: copies of what it touches, preconditions on customers, then steps."""
    some = g.props.where("key = 'c_acctbal'").select("node_id").where(F.substring_index("node_id", ":", -1).cast("bigint") % 2 == 0)
    made = versions.update_props(g, some.select("node_id", F.lit("hasPrecondition").alias("key"), F.lit("string").alias("kind"), F.lit("c_acctbal > 2000").alias("raw")))
    out = reason.reason_on_nodes(made, orders(g), "5", threshold=0.0)
    copies = out.graph.nodes.where("version = '5'")
    n = copies.count()
    mapped = copies.select("node_id").where(F.col("node_id").startswith("order:")).select(F.regexp_replace("node_id", "_v5$", "").alias("start"), F.col("node_id").alias("copy"))
    return out.steps.select("start", "hop", "node_id", "state").join(mapped, "start").withColumn("copies", F.lit(n))


@query("SELECT 'customer:' || c_custkey AS node_id, 3::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def pipeline_inherited(g):
    """How many properties customers downstream of any order have from nation, region and world."""
    return reason.reason_on_nodes(g, orders(g)).inherited


@query("SELECT hop::INTEGER AS hop, CASE WHEN c < 0.3 THEN 'low_confidence' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT 0 AS hop, 0.8 AS c FROM orders UNION ALL SELECT 1, 0.8 * least(1.0, greatest(0.0, c_acctbal / 10000)) FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2")
def pipeline_states(g):
    return reason.reason_on_nodes(g, orders(g)).states


@query("SELECT 'shipsFrom' AS predicate, (SELECT count(DISTINCT (a.src, b.dst)) FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn') AS n, true AS below, true AS member, 1::BIGINT AS rules, (SELECT count(*) FROM p WHERE key = 'c_acctbal' AND num < 0) AS violations")
def reasoner_facade(g):
    """Rules, queries and shapes over one graph, through the facade."""
    r = reason.Reasoner(g)
    r.load_rules("[a: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]")
    r.reason(version=None)
    r.shapes.add(Shape("Balance", (("subjects_of", "c_acctbal"),), (PropertyShape(predicate("c_acctbal"), (C("min_inclusive", 0),)),)))
    below, member = r.is_subclass("ClassName(class:segment:BUILDING)", "ClassName(class:customer)"), r.is_instance("order:1", "SomeValuesFrom(shipsFrom,Top)")
    made = r.graph.edges.where("rel_type = 'shipsFrom'").groupBy(F.col("rel_type").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))
    return made.withColumns({"below": F.lit(below), "member": F.lit(member), "rules": F.lit(len(r.list_rules())).cast("bigint"), "violations": F.lit(r.validate().count()).cast("bigint")})


@query("SELECT iri, holds FROM (SELECT 'individuals' AS iri, count(*) AS holds FROM i UNION ALL SELECT 'key', count(*) FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:part')")
def dl_records(g):
    """Results of class expressions as records: the expression's key and its count."""
    found = [("individuals", classes.result(g, classes.TOP)), ("key", classes.result(g, "ClassName(class:part)"))]
    assert found[1][1].expression == "ClassName(class:part)" and len(found[1][1].sample) <= 10
    return rows(g.spark, [(name, r.count) for name, r in found], "iri string, holds long")


@query("SELECT 'nation:' || n_nationkey || '_v3' AS node_id, key, CASE key WHEN 'n_name' THEN n_name ELSE 'x' || n_nationkey END AS value FROM nation, (SELECT unnest(['n_name', 'note']) AS key)")
def write_insert(g):
    """Nodes inserted by row, and one of a key that is there replaced with its properties."""
    found = g.nodes.where(F.col("node_id").startswith("nation:")).select("node_id", "name").collect()
    first = versions.insert(g, [{"labels": ["Type"], "id": f"{r.node_id}_v3", "old": 1} for r in found])
    made = versions.insert(first, [{"labels": ["Type"], "id": f"{r.node_id}_v3", "n_name": r.name, "note": "x" + r.node_id.partition(":")[2]} for r in found])
    return made.props.where(F.col("node_id").endswith("_v3") & (F.col("key") != "id")).select("node_id", "key", F.col("raw").alias("value"))


@query("SELECT rel AS rel_type, count(*) AS n FROM e WHERE NOT (rel = 'placedBy' AND src IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')) GROUP BY 1")
def write_delete_edges(g):
    done = g.props.where("key = 'o_orderstatus' AND raw = 'F'").select(F.col("node_id").alias("src"))
    return versions.delete_edges(g, g.edges.where("rel_type = 'placedBy'").join(done, "src", "left_semi")).edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, kind, value FROM (VALUES ('code', 'string', 'NEW'), ('id', 'string', 'urn:entity:NEW'), ('speed', 'float', '3.0'), ('leven', 'integer', '2'), ('Space_abs', 'list', '[1.5,2]'), ('extra', 'boolean', 'true')) t(key, kind, value) UNION ALL SELECT 'again', 'error', 'invalid_data' UNION ALL SELECT 'none', 'error', 'invalid_data'")
def write_entity(g):
    """A new entity: known keys have their types, wrong ones are left out; a code that is there, or none, is refused."""
    made = versions.create_entity(g, {"code": "NEW", "speed": 3, "leven": 2, "power": "much", "Space_abs": [1.5, 2], "extra": True, "name": 7})
    refused = []
    for key, params in (("again", {"code": "NEW"}), ("none", {"name": "x"})):
        try:
            versions.create_entity(made, params)
        except StoreError as e:
            refused.append((key, "error", e.kind))
    return made.props.where("node_id = 'urn:entity:NEW'").select("key", "kind", F.col("raw").alias("value")).unionByName(rows(g.spark, refused, "key string, kind string, value string"))


@query("SELECT node_id, label, dst FROM (VALUES ('type:New', 'Type', 'type:NATION_1'), ('patrol:R1', 'Patrol', NULL)) t(node_id, label, dst)")
def write_type_and_patrol(g):
    made = versions.create_patrol(versions.create_type(g, "New", "NATION_1", level=1), "R1", "round", [[1.0, 2.0]], ["P1"])
    new = made.nodes.where(F.col("node_id").isin("type:New", "patrol:R1")).select("node_id", F.col("labels")[0].alias("label"))
    return new.join(made.edges.select(F.col("src").alias("node_id"), "dst"), "node_id", "left")


@query("SELECT 'customer:' || c_custkey AS src, 'likes' AS rel_type, 'part:' || (c_custkey % (SELECT count(*) FROM part)) AS dst, 0 AS delete_flag, '2024-01-02 03:04:05' AS create_time FROM customer")
def write_relationships(g):
    """An edge per customer to a part, both named by code, with audit columns."""
    n = g.nodes.where(F.col("node_id").startswith("part:")).count()
    k = F.substring_index("node_id", ":", -1).cast("bigint")
    specs = g.nodes.where(F.col("node_id").startswith("customer:")).select(F.col("code").alias("start_code"), F.concat(F.lit("P"), (k % n).cast("string")).alias("end_code"), F.lit("likes").alias("rel_type"))
    made = versions.create_relationships(g, pattern.resolve_ids(g, pattern.resolve_ids(g, specs, "start"), "end"))
    stamped = versions.audited(made.edges.where("rel_type = 'likes'"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return stamped.select("src", "rel_type", "dst", F.col("delete_flag").cast("int").alias("delete_flag"), "create_time")


@query("SELECT 'part:' || p_partkey AS node_id, CASE WHEN p_partkey = 3 THEN '99' ELSE p_size::VARCHAR END AS value, CASE WHEN p_partkey = 3 THEN 99 ELSE p_size END::DOUBLE AS num FROM part")
def write_in_place(g):
    return versions.update_entity(g, "part:3", {"p_size": 99}).props.where("key = 'p_size'").select("node_id", F.col("raw").alias("value"), "num")


@query("SELECT 'now' AS at, count(*) - (SELECT count(*) FROM customer) AS n FROM n UNION ALL SELECT 'then', count(*) FROM n UNION ALL SELECT 'missing', -1")
def write_snapshots(g):
    """A snapshot outlives a delete; one that wasn't taken is refused."""
    control = versions.VersionControl()
    control.snapshot("then", g)
    now = versions.delete_nodes(g, g.nodes.where(F.col("node_id").startswith("customer:")))
    found = [("now", now.nodes.count()), ("then", control.rollback("then").nodes.count())]
    try:
        control.rollback("missing")
    except StoreError as e:
        found.append(("missing", -1 if e.kind == "not_found" else 0))
    return rows(g.spark, found, "at string, n long")


@query("SELECT name, node_id, version FROM (VALUES ('P3', 'part:3_v4', '4'), ('P4', 'part:4', NULL)) t(name, node_id, version)")
def version_resolve(g):
    """A code in a version where there is a copy, else the original."""
    made = versions.copy_nodes(g, "4", starts(g, "part:3"))[0]
    parts = [versions.VersionControl.resolve_code(made, x, "4").select(F.lit(x).alias("name"), "node_id", "version") for x in ("P3", "P4")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'suppliedBy' AS rel_type, 'part:7_v6' AS src, dst || '_v6' AS dst FROM e WHERE rel = 'suppliedBy' AND src = 'part:7'")
def version_clone_selected(g):
    """A node and what lies downstream over edges with a prefix, copied with the edges between them."""
    made = versions.clone_selected(prefixed_edges(g), starts(g, "part:7"), "6")
    return made.edges.where("version = '6'").select(F.substring_index("rel_type", ":", -1).alias("rel_type"), "src", "dst")


@query("SELECT rel AS rel_type, count(*) AS n FROM (SELECT 'subClassOf' AS rel FROM nation UNION ALL SELECT 'INSTANCE_OF' FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT 'HAS_VALUE' FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT 'HAS_PROPERTY' UNION ALL SELECT 'HAS_RANGE') GROUP BY 1")
def ontology_rows(g):
    """Declarations of classes, a property and individuals as edges of a graph."""
    nations = g.nodes.where(F.col("node_id").startswith("nation:")).select("node_id", "type").collect()
    o = ontology.Ontology([ontology.ClassDecl(r.node_id, super_classes=(r.type,)) for r in nations], [ontology.PropertyDecl("speed", "thing", "number", aspects=("functional",))],
                          [ontology.IndividualDecl(f"s{k}", types=("supplier",), values=(("speed", k),)) for k in range(10)])
    return o.graph(g.spark).edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


# Texts, values, tools and errors


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE event_id % 3 WHEN 2 THEN NULL ELSE 'found' END AS state FROM events", graph=False)
def json_extraction(spark, d):
    """JSON in texts: fenced, among words, and none."""
    e = spark.read.parquet(f"{d}/events.parquet")
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('the "answer" is '), "props", F.lit(" } or so"))).otherwise("none here")
    out = text.extracted_json(e.select("event_id", "props", told.alias("told")), "told")
    return out.select("event_id", text.at_path(F.col("props"), "$.k").cast("bigint").alias("k"), F.when(text.at_path(F.col("json"), "k") == text.at_path(F.col("props"), "k"), "found").alias("state"))


@query("SELECT p_partkey, 'http://x.org#' || p_brand AS long, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS short, CASE p_partkey % 2 WHEN 0 THEN '\"' || p_name || '\"' ELSE p_size::VARCHAR END AS shown, p_partkey % 3 = 0 AS iso, p_partkey % 6 = 0 AS iso_strict, 2 AS items FROM part", graph=False)
def text_helpers(spark, d):
    """Expansion of prefixes, shortening, rendering, ISO times and JSON lists, on every part."""
    c, k = F.col, F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet")
    when = F.when(k % 6 == 0, "2024-01-01T00:00:00Z").when(k % 3 == 0, "Tuesday").otherwise("2024-01-01 00:00:00")
    kind = F.when(k % 2 == 0, "string").otherwise("integer")
    return p.select(
        "p_partkey", iri.Prefixes({"x": "http://x.org#"}).expand(F.concat(F.lit("x:"), "p_brand")).alias("long"), text.shortened(c("p_name"), 8).alias("short"),
        text.rendered(kind, F.when(k % 2 == 0, c("p_name")).otherwise(c("p_size").cast("string")), c("p_size").cast("double")).alias("shown"),
        text.is_iso_time(when).alias("iso"), text.is_iso_time(when, strict=True).alias("iso_strict"), F.size(text.string_items(F.concat(F.lit('["a", 1, "'), "p_brand", F.lit('"]')))).alias("items"),
    )


@query("SELECT o_orderkey, left(sha256(o_orderkey::VARCHAR || chr(31) || o_orderstatus), 32) AS id FROM orders", graph=False)
def stable_ids(spark, d):
    made = text.stable_id("n:", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.substring_index(made, ":", -1).alias("id"))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'swrl' WHEN 1 THEN 'func' END AS prefix, CASE event_id % 3 WHEN 0 THEN 'swrl:' WHEN 1 THEN 'func:' ELSE 'rdf:' END || event_type AS expression, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def language_groups(spark, d):
    k = F.col("event_id") % 3
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.when(k == 0, "swrl:").when(k == 1, "func:").otherwise("rdf:"), "event_type").alias("x"))
    return language.grouped(e, "x")


@query("SELECT o_custkey AS route, 'Patrol' AS kind, ':Patrol(' || o_custkey || ')' AS head, count(*) AS legs FROM orders GROUP BY 1", graph=False)
def route_texts(spark, d):
    """Texts of a route's effect and parts, made from its totals."""
    from .queries import _legs

    totals = timeline.route_totals(_legs(spark, d)).withColumns({"entity": F.lit("E"), "speed": F.lit(200.0)})
    told = timeline.route_rules(totals)
    return told.select("route", F.regexp_extract("effect", ":(\\w+)\\(", 1).alias("kind"), F.substring_index("effect", " ^", 1).alias("head"), F.size(F.split("composed_of", " \\^ ")).cast("bigint").alias("legs"))


@query("SELECT o_orderkey AS code, 'Strike' AS kind, o_orderkey % 2 = 0 AS reached FROM orders", graph=False)
def strike_texts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.lit(0.0).alias("attacker_lat"), F.lit(0.0).alias("attacker_lon"), F.lit(0.0).alias("target_lat"), (F.col("o_orderkey") % 2).cast("double").alias("target_lon"))
    scored = timeline.strikes(o.withColumns({"code": F.col("o_orderkey").cast("string"), "attacker": F.lit("A"), "target": F.lit("T"), "weapon": F.lit("gun"), "weapon_range_m": F.lit(1000.0), "target_depth": F.lit(0.0), "confidence": F.lit(1.0)}))
    told = timeline.strike_rules(scored)
    return told.select(F.col("o_orderkey").alias("code"), F.regexp_extract("effect", ":(\\w+)\\(", 1).alias("kind"), F.col("effect").contains("'done'").alias("reached"))


@query("SELECT source, change, n, line FROM (SELECT 'customer:0' AS source, 'added' AS change, 1 AS n, 'customer:0 -[locatedIn]-> nation:' || c_nationkey || ': new property ''n_name''' AS line FROM customer WHERE c_custkey = 0) UNION ALL SELECT 'hook', 'seen', (SELECT count(*) FROM customer), 'hook'")
def detector_hook(g):
    """A detector of one's own beside the usual one, and the text of a change."""
    pairs = g.edges.where((F.col("rel_type") == "locatedIn") & F.col("src").startswith("customer:")).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("relation"))
    none = F.lit(None).cast("string")
    seen = lambda graph, p: p.select("source", "target", "relation", F.lit("hook").alias("key"), none.alias("old"), none.alias("new"), F.lit("seen").alias("change"))
    told = detect.narrated(detect.detect(g, pairs, [detect.attribute_changes, seen]))
    hook = F.col("change") == "seen"
    return told.where(hook | (F.col("source") == "customer:0")).groupBy(F.when(hook, "hook").otherwise(F.col("source")).alias("source"), "change", F.when(hook, "hook").otherwise(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, required, kinds FROM (VALUES ('get_entity_context', 'id', 'string'), ('infer_on_nodes', 'ids', 'array,number,string'), ('create_type', 'name', 'string,string')) t(name, required, kinds)", graph=False)
def tool_schemas(spark, d):
    found = [t.as_dict()["function"] for t in (tools.ENGINE_TOOLS.find(n) for n in ("get_entity_context", "infer_on_nodes", "create_type"))]
    return rows(spark, [(t["name"], ",".join(t["parameters"]["required"]), ",".join(p["type"] for p in t["parameters"]["properties"].values())) for t in found], "name string, required string, kinds string")


@query("SELECT event_id, event_type AS tool, json_extract_string(props, '$.k')::BIGINT AS k FROM events", graph=False)
def tool_calls(spark, d):
    """Calls in model responses: the name and its arguments, from every event."""
    e = spark.read.parquet(f"{d}/events.parquet")
    body = F.concat(F.lit('{"choices":[{"message":{"tool_calls":[{"function":{"name":"'), "event_type", F.lit('","arguments":'), F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2), F.lit("}}]}}]}"))
    out = text.extracted_json(e.select("event_id", "event_type", body.alias("told")), "told")
    name = F.get_json_object("told", "$.choices[0].message.tool_calls[0].function.name")
    return out.select("event_id", name.alias("tool"), F.get_json_object("json", "$.k").cast("bigint").alias("k"))


@query("SELECT told, kind, calls FROM (VALUES ('call', 'tool_calls', 'search_entities'), ('json', 'json', ''), ('plain', 'text', '')) t(told, kind, calls)", graph=False)
def model_responses(spark, d):
    """Responses of models as records: tool calls, JSON, or text."""
    call = '{"choices":[{"message":{"tool_calls":[{"function":{"name":"search_entities","arguments":"{\\"code\\":\\"P1\\"}"}}]}}]}'
    found = [(name, tools.response(t)) for name, t in (("call", call), ("json", 'so {"a": 1}'), ("plain", "nothing"))]
    return rows(spark, [(n, r.kind, ",".join(c.name for c in r.calls)) for n, r in found], "told string, kind string, calls string")


@query("SELECT p_brand AS brand, 'Entity where p_brand is ''' || p_brand || ''' with suppliedBy to any node' AS told, 'MATCH (a:Entity {p_brand: ''' || p_brand || '''})-[r:suppliedBy]->(b) RETURN a, r, b' AS match FROM (SELECT DISTINCT p_brand FROM part)")
def pattern_texts(g):
    """A pattern per brand in words and as text of a graph query language."""
    brands = [r.raw for r in g.props.where("key = 'p_brand'").select("raw").distinct().collect()]
    args = lambda b: (NodePattern("Entity", {"p_brand": b}), EdgePattern("suppliedBy"), NodePattern())
    return rows(g.spark, [(b, tools.describe(*args(b)), tools.match_text(*args(b))) for b in brands], "brand string, told string, match string")


@query("SELECT rel AS rel_type, dst FROM (SELECT rel, dst, row_number() OVER (PARTITION BY rel ORDER BY dst) AS k FROM (SELECT DISTINCT rel, dst FROM e)) WHERE k <= 3")
def log_samples(g):
    """Three targets of each relation type for a log, which is what the operator is for."""
    return traverse.samples(g.edges, "rel_type", "dst", 3)


@query("SELECT name, kind, base FROM (VALUES ('parse', 'MappingError', true), ('store', 'StoreError', true), ('rule', 'RuleError', true), ('class', 'ExpressionError', true), ('shape', 'ShapeError', true)) t(name, kind, base)")
def error_kinds(g):
    """What each layer raises for what it can't use."""
    tries = {"parse": lambda: language.parse("rdf:x"), "store": lambda: pattern.resolve_ids(g, rows(g.spark, [("x",)], "to_label string"), "to"), "rule": lambda: Parser().parse("[x: :P(?x) -> q(?x,?y)]"),
             "class": lambda: classes.parse("Nothing(a)"), "shape": lambda: shapes.focus_nodes(g, Shape("S", ()))}
    out = []
    for name, go in tries.items():
        try:
            go()
        except GraphloomError as e:
            out.append((name, type(e).__name__, isinstance(e, (MappingError, GraphloomError))))
    return rows(g.spark, out, "name string, kind string, base boolean")


# Streams


@query("SELECT a.src AS subject, b.dst AS object, b.k % 3 + 1 > 0 AS derived FROM (SELECT 'event:' || event_id AS src, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a JOIN (SELECT 'event:' || event_id AS dst, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) b ON a.user_id = b.user_id AND b.k = a.k + 1")
def stream_rules(g):
    """All edges between events in three micro-batches of a real stream: facts of two steps, each from the batch that completes it."""
    from .streaming.incremental import RuleStream

    spark, path = g.spark, folder(g.spark)
    g.edges.where("rel_type = 'next'").select("src", "rel_type", "dst").repartition(3, "src").write.parquet(f"{path}/in")  # a file is a micro-batch
    handler = RuleStream(sources.from_rows(spark, [], []), Parser().parse_all("[two: next(?a,?b) ^ next(?b,?c) -> after(?a,?c)]"), lambda new, n: new.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    stream = spark.readStream.schema("src string, rel_type string, dst string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("subject", "object", (F.col("predicate") == "after").alias("derived"))
