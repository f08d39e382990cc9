"""One query per operator over the graph projection of the sales tables, and SQL that must give the same rows."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import builtins, language, text
from .functions.iri import Prefixes, name_of
from .operators import behavior, classes, detect, pattern, search, shapes, timeline, traverse, versions
from .operators.pattern import Check, EdgePattern, NodePattern
from .operators.shapes import Constraint, Path, PropertyShape, Shape, predicate
from .plans import confidence, fixpoint, ir, reason
from .plans.rules import Parser
from .sources.graph import EDGES, Graph, from_sales, full

#: The projection in SQL: nodes n, properties p and edges e.
PRELUDE = """
n AS (
  SELECT 'region:' || r_regionkey AS node_id, NULL AS code, r_name AS name, 'type:World' AS type, 'Type' AS label, true AS ind, NULL::DOUBLE AS confidence FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, NULL, n_name, 'region:' || n_regionkey, 'Type', true, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, c_name, 'nation:' || c_nationkey, 'Entity', true, least(1.0, greatest(0.0, c_acctbal / 10000)) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_name, 'nation:' || s_nationkey, 'Entity', true, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'P' || p_partkey, p_name, 'ptype:' || p_type, 'Entity', true, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'O' || o_orderkey, NULL, NULL, 'Event', true, NULL FROM orders
  UNION ALL SELECT DISTINCT 'ptype:' || p_type, NULL, p_type, 'type:Part', 'Type', false, NULL::DOUBLE FROM part
  UNION ALL SELECT x, NULL, x, NULL, 'Type', false, NULL FROM (VALUES ('type:World'), ('type:Part'), ('type:Thing')) t(x)
  UNION ALL SELECT 'class:' || x, NULL, NULL, NULL, 'Class', false, NULL FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order')) t(x)
  UNION ALL SELECT DISTINCT 'class:segment:' || c_mktsegment, NULL, NULL, NULL, 'Class', false, NULL::DOUBLE FROM customer
  UNION ALL SELECT DISTINCT 'class:status:' || o_orderstatus, NULL, NULL, NULL, 'Class', false, NULL::DOUBLE FROM orders),
p AS (
  SELECT 'region:' || r_regionkey AS node_id, 'r_name' AS key, 'string' AS kind, r_name AS s, NULL::DOUBLE AS num FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'n_name', 'string', n_name, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'c_name', 'string', c_name, NULL FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'c_acctbal', 'float', NULL, c_acctbal FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'c_mktsegment', 'string', c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 's_name', 'string', s_name, NULL FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 's_acctbal', 'float', NULL, s_acctbal FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'p_name', 'string', p_name, NULL FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'p_brand', 'string', p_brand, NULL FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'p_size', 'integer', p_size::VARCHAR, p_size FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'p_retailprice', 'float', NULL, p_retailprice FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'o_orderstatus', 'string', o_orderstatus, NULL FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'o_totalprice', 'float', NULL, o_totalprice FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'o_orderpriority', 'string', o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'type:World', 'planet', 'string', 'Earth', NULL UNION ALL SELECT 'type:Thing', 'r_name', 'string', 'anything', NULL),
e AS (
  SELECT 'customer:' || c_custkey AS src, 'locatedIn' AS rel, 'nation:' || c_nationkey AS dst, NULL AS act, NULL::DOUBLE AS val FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'locatedIn', 'nation:' || s_nationkey, NULL, NULL FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'locatedIn', 'region:' || n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 'order:' || o_orderkey, 'placedBy', 'customer:' || o_custkey, 'inference', NULL FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, NULL, NULL::DOUBLE FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'suppliedBy', 'supplier:' || l_suppkey, 'inference', NULL::DOUBLE FROM lineitem
  UNION ALL SELECT 'event:' || event_id, 'next', 'event:' || nx, NULL, NULL FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL
  UNION ALL SELECT 'nation:' || n_nationkey, 'subClassOf', 'region:' || n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'subClassOf', 'type:World', NULL, NULL FROM region
  UNION ALL SELECT DISTINCT 'ptype:' || p_type, 'subClassOf', 'type:Part', NULL, NULL::DOUBLE FROM part
  UNION ALL SELECT 'type:Part', 'subClassOf', 'type:Thing', NULL, NULL
  UNION ALL SELECT 'customer:' || c_custkey, 'HAS_VALUE', 'prop:balance', NULL, c_acctbal FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'HAS_VALUE', 'prop:total', NULL, o_totalprice FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'INSTANCE_OF', 'class:customer', NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'INSTANCE_OF', 'class:supplier', NULL, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'INSTANCE_OF', 'class:part', NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'INSTANCE_OF', 'class:order', NULL, NULL FROM orders
  UNION ALL SELECT 'nation:' || n_nationkey, 'INSTANCE_OF', 'class:nation', NULL, NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'INSTANCE_OF', 'class:region', NULL, NULL FROM region
  UNION ALL SELECT 'customer:' || c_custkey, 'INSTANCE_OF', 'class:segment:' || c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'INSTANCE_OF', 'class:status:' || o_orderstatus, NULL, NULL FROM orders),
i AS (SELECT DISTINCT node_id AS iri FROM n WHERE ind)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True, recursive: bool = False):
    """Register a query under its function's name; ``sql`` follows the projection's tables where ``graph`` is set."""

    def add(make):
        QUERIES[make.__name__] = make if not graph else lambda spark, d: make(from_sales(spark, d))
        if sql:
            SQL[make.__name__] = f"WITH {'RECURSIVE ' * recursive}{PRELUDE}{sql}" if graph else sql
        return make

    return add


def starts(g: Graph, like: str) -> DataFrame:
    return g.nodes.where(F.col("node_id").isin(*like.split(","))).select("node_id")


# Scans, lookups and patterns


@query("SELECT node_id, name FROM n WHERE label = 'Type'")
def label_scan(g):
    return g.labelled("Type").select("node_id", "name")


@query("SELECT label, count(*) AS n FROM (SELECT label FROM n WHERE NOT (ind AND false) UNION ALL SELECT 'Individual' FROM n WHERE ind) GROUP BY 1")
def health_counts(g):
    return g.health()


@query("SELECT a AS alias, node_id, name FROM (SELECT unnest(['P7', 'customer:3', 'nation:1', 'none']) AS a) JOIN n ON a = node_id OR a = code")
def lookup_alias(g):
    return pattern.get_nodes(g, ["P7", "customer:3", "nation:1", "none"]).select("alias", "node_id", "name")


@query("SELECT src AS start, rel AS rel_type, dst AS \"end\" FROM e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst WHERE rel = 'suppliedBy' AND a.label = 'Entity' AND b.label = 'Entity'")
def pattern_match(g):
    return pattern.match(g, NodePattern("Entity"), EdgePattern("suppliedBy"), NodePattern("Entity"))


@query("SELECT src AS start, rel AS rel_type, dst AS \"end\" FROM e JOIN p ON p.node_id = src AND key = 'c_mktsegment' AND s = 'BUILDING' WHERE rel = 'locatedIn'")
def pattern_match_props(g):
    return pattern.match(g, NodePattern("Entity", {"c_mktsegment": "BUILDING"}), EdgePattern("locatedIn"), NodePattern())


@query("SELECT dst AS start, rel AS rel_type, src AS \"end\" FROM e JOIN p ON p.node_id = src AND key = 'p_size' AND kind = 'integer' AND num = 7 WHERE rel = 'contains' AND false UNION ALL SELECT dst, rel, src FROM e JOIN p ON p.node_id = dst AND key = 'p_size' AND num = 7 WHERE rel = 'contains'")
def pattern_incoming(g):
    return pattern.match(g, NodePattern(props={"p_size": 7}), EdgePattern("contains").incoming(), NodePattern("Event"))


@query("SELECT src, rel AS rel_type, dst FROM e WHERE src = 'nation:3' OR dst = 'nation:3'")
def relationships_both(g):
    return pattern.relationships(g, "nation:3", direction="both").select("src", "rel_type", "dst")


@query("SELECT src, dst FROM e JOIN n ON node_id = src WHERE dst = 'nation:3' AND src <> dst AND label IN ('Entity', 'Event', 'Type') AND rel = 'locatedIn'")
def incoming_edges(g):
    return pattern.incoming_relationships(g, "nation:3", "locatedIn").select("src", "dst")


@query("SELECT node_id, code FROM n WHERE node_id = 'part:5' AND code = 'P5'")
def find_by_id_code(g):
    return pattern.find_by_id_code(g, "part:5", "P5").select("node_id", "code")


@query("""SELECT node_id, tier::INTEGER AS tier FROM (SELECT node_id, CASE WHEN node_id = 'P1' THEN 0 WHEN code = 'P1' OR name = 'P1' THEN 1 WHEN contains(name, 'P1') THEN 2 END AS tier FROM n)
  WHERE tier IS NOT NULL ORDER BY tier, node_id LIMIT 1""")
def find_any(g):
    return pattern.find_any(g, "P1").select("node_id", "tier")


@query("""SELECT x AS start_code, coalesce((SELECT min(node_id) FROM n WHERE code = x AND label = 'Entity'), (SELECT min(node_id) FROM n WHERE name = x AND label = 'Entity'), (SELECT min(node_id) FROM n WHERE name = x AND label = 'Type'), x) AS start_node
  FROM (SELECT unnest(['P3', 'O4', 'FRANCE', 'nobody']) AS x) WHERE x <> 'O4' UNION ALL SELECT 'O4', 'order:4'""")
def resolve_ids(g):
    specs = g.spark.createDataFrame([("P3",), ("O4",), ("FRANCE",), ("nobody",)], "start_code string")
    return pattern.resolve_ids(g, specs, "start")


@query("SELECT DISTINCT dst AS node_id FROM e JOIN n ON node_id = dst WHERE src = 'nation:2' AND rel IN ('INSTANCE_OF', 'subClassOf') AND label = 'Type'")
def parent_types(g):
    return pattern.parent_types(g, "nation:2")


@query("SELECT DISTINCT code FROM e JOIN n ON node_id = dst WHERE src = 'order:1' AND rel IN ('contains', 'placedBy') AND code IS NOT NULL")
def discover_downstream(g):
    return pattern.discover_downstream(g, "order:1", ["contains", "placedBy"])


@query("""SELECT 'customer:' || c_custkey AS node_id, ok_a AND ok_b AND ok_c AND ok_d AS passed, concat_ws(';', CASE WHEN NOT ok_a THEN 'min(c_acctbal, 0)' END, CASE WHEN NOT ok_b THEN 'in(c_mktsegment, (''BUILDING'', ''MACHINERY''))' END, CASE WHEN NOT ok_c THEN 'pattern(c_name, 1$)' END, CASE WHEN NOT ok_d THEN 'exists(p_size)' END) AS failed
  FROM (SELECT c_custkey, c_acctbal >= 0 AS ok_a, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ok_b, regexp_matches(c_name, '1$') AS ok_c, false AS ok_d FROM customer)""")
def check_nodes(g):
    checks = [Check("min", "c_acctbal", 0), Check("in", "c_mktsegment", ("BUILDING", "MACHINERY")), Check("pattern", "c_name", "1$"), Check("exists", "p_size")]
    nodes = pattern.nodes_like(g, NodePattern("Entity")).where(F.col("node_id").startswith("customer:"))
    return pattern.check_nodes(g, nodes, checks).select("node_id", "passed", F.array_join("failed", ";").alias("failed"))


@query("SELECT rel AS rel_type, CASE WHEN act <> 'inference' THEN 'llm_only' WHEN rel IN ('INSTANCE_OF', 'subClassOf', 'HAS_VALUE') THEN 'facts' ELSE 'non_inference' END AS target, count(*) AS n FROM e GROUP BY 1, 2")
def edge_router(g):
    return language.route(g.edges).groupBy("rel_type", "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, dst FROM e WHERE rel = 'locatedIn' AND src = 'nation:3'")
def plan_relationships(g):
    return ir.execute(g, ir.Plan("relationships", {"node": "nation:3", "rel_type": "locatedIn"})).select("src", "dst")


# Class expressions


def dl(name: str, expression: classes.Expr | str, sql: str):
    def make(g):
        return classes.instances(g, expression)

    make.__name__ = name
    query(sql)(make)


CUSTOMER, BUILDING, NATION, ORDER = "SELECT src FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:customer'", "SELECT src FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:segment:BUILDING'", "SELECT src FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:nation'", "SELECT src FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:order'"
customer, building, order = classes.named("class:customer"), classes.named("class:segment:BUILDING"), classes.named("class:order")
dl("dl_top", classes.TOP, "SELECT iri FROM i")
dl("dl_bottom", classes.BOTTOM, "SELECT iri FROM i WHERE false")
dl("dl_class", customer, f"SELECT iri FROM i WHERE iri IN ({CUSTOMER})")
dl("dl_and", customer & building, f"SELECT iri FROM i WHERE iri IN ({CUSTOMER}) AND iri IN ({BUILDING})")
dl("dl_or", building | classes.named("class:nation"), f"SELECT iri FROM i WHERE iri IN ({BUILDING}) OR iri IN ({NATION})")
dl("dl_not", ~customer, f"SELECT iri FROM i WHERE iri NOT IN ({CUSTOMER})")
dl("dl_some", classes.some("placedBy", building), f"SELECT iri FROM i WHERE iri IN (SELECT src FROM e WHERE rel = 'placedBy' AND dst IN ({BUILDING}))")
dl("dl_all", order & classes.only("placedBy", building), f"SELECT iri FROM i WHERE iri IN ({ORDER}) AND iri NOT IN (SELECT src FROM e WHERE rel = 'placedBy' AND dst NOT IN ({BUILDING}))")
dl("dl_min", classes.at_least(4, "contains"), "SELECT src AS iri FROM e WHERE rel = 'contains' GROUP BY 1 HAVING count(*) >= 4")
dl("dl_max", order & classes.at_most(2, "contains"), f"SELECT iri FROM i WHERE iri IN ({ORDER}) AND iri NOT IN (SELECT src FROM e WHERE rel = 'contains' GROUP BY 1 HAVING count(*) > 2)")
dl("dl_exact", classes.exactly(3, "contains", classes.some("suppliedBy")), "SELECT src AS iri FROM e WHERE rel = 'contains' AND dst IN (SELECT src FROM e WHERE rel = 'suppliedBy') GROUP BY 1 HAVING count(*) = 3")
dl("dl_oneof", classes.one_of("customer:1", "nation:2", "customer:1"), "SELECT unnest(['customer:1', 'nation:2']) AS iri")
dl("dl_nested", "Intersection(ClassName(class:order),SomeValuesFrom(placedBy,Intersection(Complement(ClassName(class:segment:BUILDING)),SomeValuesFrom(locatedIn,OneOf(nation:1;nation:2)))))",
   f"SELECT iri FROM i WHERE iri IN ({ORDER}) AND iri IN (SELECT src FROM e WHERE rel = 'placedBy' AND dst NOT IN ({BUILDING}) AND dst IN (SELECT src FROM e WHERE rel = 'locatedIn' AND dst IN ('nation:1', 'nation:2')))")


@query("SELECT DISTINCT 'part:' || l_partkey AS iri FROM lineitem WHERE l_linenumber > 1")
def dl_self(g):
    """Self over a relation made of line items beyond an order's first: loops among other edges of that relation."""
    items = g.spark.read.parquet(f"{g.source}/lineitem.parquet").where("l_linenumber > 1").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("src"))
    loops = items.distinct().select("src", F.lit("likes").alias("rel_type"), F.col("src").alias("dst"))
    others = g.edges.where("rel_type = 'suppliedBy'").select("src", F.lit("likes").alias("rel_type"), "dst")
    return classes.instances(g.with_(edges=g.edges.unionByName(full(loops.unionByName(others), EDGES))), classes.has_self("likes"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("""SELECT s AS segment, NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = s AND c_acctbal IS NULL) AS in_customers, NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = s AND c_mktsegment <> 'BUILDING') AS in_building
  FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS s)""")
def dl_subsumes(g):
    """Each segment below customers, which all are, and below one segment, which only that one is."""
    rows = None
    for x in SEGMENTS:
        lower = classes.named(f"class:segment:{x}")
        one = classes.subsumes(g, customer, lower).withColumnRenamed("holds", "in_customers").crossJoin(classes.subsumes(g, building, lower).withColumnRenamed("holds", "in_building")).select(F.lit(x).alias("segment"), "in_customers", "in_building")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"""SELECT 'customer:' || k AS iri, 'customer:' || k IN ({BUILDING}) AS holds FROM (SELECT unnest(range(12)) AS k)""")
def dl_instance_of(g):
    rows = [classes.is_instance(g, f"customer:{k}", building).select(F.lit(f"customer:{k}").alias("iri"), "holds") for k in range(12)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# Rules


def rule(name: str, text_: str, sql: str, products: bool = False):
    def make(g):
        return fixpoint.derive_once(g, Parser().parse(text_), products=products).select("subject", "predicate", "object")

    make.__name__ = name
    query(sql)(make)


rule("rule_chain", "[reach: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]",
     "SELECT DISTINCT a.src AS subject, 'shipsFrom' AS predicate, b.dst AS object FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn'")
rule("rule_class_head", "[vip: class:customer(?c) ^ class:segment:BUILDING(?c) -> class:builder(?c)]",
     f"SELECT src AS subject, 'INSTANCE_OF' AS predicate, 'class:builder' AS object FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:customer' AND src IN ({BUILDING})")
rule("rule_builtin_num", "[rich: class:customer(?c) ^ swrlb:greaterThan(?c.c_acctbal, 9000) -> class:rich(?c)]",
     "SELECT 'customer:' || c_custkey AS subject, 'INSTANCE_OF' AS predicate, 'class:rich' AS object FROM customer WHERE c_acctbal > 9000")
rule("rule_builtin_str", "[brand: class:part(?p) ^ swrlb:startsWith(?p.p_brand, Brand#1) ^ swrlb:lessThan(?p.p_size, 10) -> class:small(?p)]",
     "SELECT 'part:' || p_partkey AS subject, 'INSTANCE_OF' AS predicate, 'class:small' AS object FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size < 10")
rule("rule_data_body", "[total: prop:total(?o,?v) ^ swrlb:greaterThanOrEqual(?v, 300000) -> class:big(?o)]",
     "SELECT 'order:' || o_orderkey AS subject, 'INSTANCE_OF' AS predicate, 'class:big' AS object FROM orders WHERE o_totalprice >= 300000")
rule("rule_data_head", "[flag: class:nation(?n) -> prop:flag(?n, checked)]",
     "SELECT 'nation:' || n_nationkey AS subject, 'prop:flag' AS predicate, 'checked' AS object FROM nation")
rule("rule_same", "[pair: placedBy(?o,?c) ^ contains(?o,?p) ^ suppliedBy(?p,?s) ^ locatedIn(?s,?m) ^ locatedIn(?c,?n) ^ sameAs(?n,?m) -> nearBy(?c,?s)]",
     "SELECT DISTINCT c.dst AS subject, 'nearBy' AS predicate, s.dst AS object FROM e c JOIN e p ON p.src = c.src AND p.rel = 'contains' JOIN e s ON s.src = p.dst AND s.rel = 'suppliedBy' JOIN e m ON m.src = s.dst AND m.rel = 'locatedIn' JOIN e n ON n.src = c.dst AND n.rel = 'locatedIn' WHERE c.rel = 'placedBy' AND n.dst = m.dst")
rule("rule_different", "[rivals: suppliedBy(part:1,?a) ^ suppliedBy(part:1,?b) ^ differentFrom(?a,?b) -> rivalOf(?a,?b)]",
     "SELECT DISTINCT a.dst AS subject, 'rivalOf' AS predicate, b.dst AS object FROM e a, e b WHERE a.rel = 'suppliedBy' AND b.rel = 'suppliedBy' AND a.src = 'part:1' AND b.src = 'part:1' AND a.dst <> b.dst", products=True)
rule("rule_constant", "[home: locatedIn(?c,?n) ^ locatedIn(?n,region:1) -> class:inRegionOne(?c)]",
     "SELECT DISTINCT a.src AS subject, 'INSTANCE_OF' AS predicate, 'class:inRegionOne' AS object FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'locatedIn' AND b.rel = 'locatedIn' AND b.dst = 'region:1'")
rule("rule_dl_query", "[busy: placedBy(?o,?c) ^ query:{MinCardinality(5,contains,Top)}(?o) -> keenBuyer(?c,?o)]",
     "SELECT DISTINCT dst AS subject, 'keenBuyer' AS predicate, src AS object FROM e WHERE rel = 'placedBy' AND src IN (SELECT src FROM e WHERE rel = 'contains' GROUP BY 1 HAVING count(*) >= 5)")


def facts(g: Graph, text_: str, **options) -> DataFrame:
    return fixpoint.run(g, Parser().parse_all(text_), **options).facts


@query("""SELECT subject, predicate, object, rule FROM (
  SELECT src AS subject, 'above' AS predicate, dst AS object, 'base' AS rule FROM e WHERE rel = 'subClassOf'
  UNION ALL SELECT a.src, 'above', b.dst, 'step' FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'subClassOf' AND b.rel = 'subClassOf')""")
def rule_fixpoint_transitive(g):
    return facts(g, "[base: subClassOf(?a,?b) -> above(?a,?b)]\n[step: subClassOf(?a,?b) ^ above(?b,?c) -> above(?a,?c)]").select("subject", "predicate", "object", "rule")


@query("""SELECT a.src AS subject, b.dst AS object, (1 + ceil(log2(b.k - a.k + 1)))::INTEGER AS iter FROM
  (SELECT 'event:' || event_id AS src, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a
  JOIN (SELECT 'event:' || event_id AS dst, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) b ON a.user_id = b.user_id AND b.k >= a.k""")
def rule_fixpoint_events(g):
    """A recursive rule over all events to its fixpoint: a fact's round grows with the logarithm of its distance, as derived facts meet each other."""
    rules = Parser().parse_all("[base: next(?a,?b) -> later(?a,?b)]\n[step: later(?a,?b) ^ later(?b,?c) -> later(?a,?c)]")
    out = fixpoint.run(g, rules, max_iterations=sys.maxsize)
    if out.state is not fixpoint.State.CONVERGED:
        raise RuntimeError(f"the rules did not converge: {out.state.value}")
    return out.facts.select("subject", "object", "iter")


@query("""SELECT subject, predicate, object FROM (
  SELECT src AS subject, 'linked' AS predicate, dst AS object FROM e WHERE rel = 'locatedIn' AND src LIKE 'nation:%'
  UNION SELECT dst, 'linked', src FROM e WHERE rel = 'locatedIn' AND src LIKE 'nation:%')""")
def rule_symmetric(g):
    return facts(g, "[base: class:nation(?a) ^ locatedIn(?a,?b) -> linked(?a,?b)]\n[back: linked(?a,?b) -> linked(?b,?a)]").select("subject", "predicate", "object")


@query("""SELECT subject, predicate, object FROM (
  SELECT a.src AS subject, 'shipsFrom' AS predicate, b.dst AS object FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn'
  UNION SELECT a.src, 'shipsWithin', c.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.rel = 'placedBy' AND b.rel = 'locatedIn' AND c.rel = 'locatedIn')""")
def rule_fixpoint_multi(g):
    return facts(g, "[a: placedBy(?o,?c) ^ locatedIn(?c,?n) -> shipsFrom(?o,?n)]\n[b: shipsFrom(?o,?n) ^ locatedIn(?n,?r) -> shipsWithin(?o,?r)]").select("subject", "predicate", "object")


@query("""SELECT src AS subject, 'INSTANCE_OF' AS predicate, 'class:place' AS object, round(0.35 * 1 + 0.45 + 0.2 * greatest(1.0 / (SELECT count(*) FROM region), 0.1), 6) AS confidence FROM e WHERE rel = 'INSTANCE_OF' AND dst = 'class:region'""")
def rule_confidence(g):
    return facts(g, "[place: class:region(?r) -> class:place(?r)]").select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"))


@query("""SELECT (SELECT count(*) FROM region) AS derived, 1 AS trips, 'weak' AS rule, round(0.35 / 15 + 0.45 + 0.2 * greatest(1.0 / (SELECT count(*) FROM region), 0.1), 6) AS score, 'class:strong' AS made""")
def rule_fuse_strict(g):
    """Of two rules over the same facts the one with a body of many atoms and one variable scores below the threshold and makes nothing."""
    body = " ^ ".join(["class:region(?r)"] * 15)
    out = fixpoint.run(g, Parser().parse_all(f"[weak: {body} -> class:place(?r)]\n[strong: class:region(?r) -> class:strong(?r)]"), threshold=0.6)
    score, _, name = out.gate.trips[0]
    return out.facts.groupBy(F.col("object").alias("made")).agg(F.count(F.lit(1)).alias("derived")).withColumns({"trips": F.lit(len(set(out.gate.trips))), "rule": F.lit(name), "score": F.round(F.lit(score), 6)})


# Traversal


BFS = """{cte} AS (SELECT DISTINCT 'nation:1' AS node, 0 AS hop UNION SELECT {to}, hop + 1 FROM {cte} JOIN e ON {on} WHERE hop < 2)
  SELECT 'nation:1' AS start, node, min(hop)::INTEGER AS hop FROM {cte} WHERE node <> 'nation:1' GROUP BY node"""


@query(", " + BFS.format(cte="b", to="e.dst", on="e.src = b.node"), recursive=True)
def bfs_out(g):
    return traverse.explore(g, starts(g, "nation:1"), 2).select("start", "node", "hop")


@query(", " + BFS.format(cte="b", to="e.src", on="e.dst = b.node"), recursive=True)
def bfs_in(g):
    return traverse.explore(g, starts(g, "nation:1"), 2, "in").select("start", "node", "hop")


@query(", " + BFS.format(cte="b", to="CASE WHEN e.src = b.node THEN e.dst ELSE e.src END", on="(e.src = b.node OR e.dst = b.node) AND rel = 'locatedIn'"), recursive=True)
def bfs_both(g):
    return traverse.explore(g, starts(g, "nation:1"), 2, "both", "locatedIn").select("start", "node", "hop")


def orders(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("node_id").startswith("order:")).select("node_id")


@query("""SELECT 'order:' || o_orderkey AS start, 'customer:' || o_custkey AS node, round(least(1.0, greatest(0.0, c_acctbal / 10000)), 6) AS confidence, least(1.0, greatest(0.0, c_acctbal / 10000)) < 0.5 AS blocked
  FROM orders JOIN customer ON o_custkey = c_custkey""")
def bfs_confidence_stop(g):
    return traverse.explore(g, orders(g), 3, relation="placedBy", threshold=0.5).select("start", "node", F.round("confidence", 6).alias("confidence"), "blocked")


@query(""", a AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM e WHERE rel = 'subClassOf' UNION SELECT a.node, e.dst, depth + 1 FROM a JOIN e ON e.src = a.ancestor AND rel = 'subClassOf')
  SELECT node, ancestor, min(depth)::INTEGER AS depth FROM a GROUP BY 1, 2""", recursive=True)
def ancestors(g):
    return traverse.ancestors(g)


@query("""SELECT 'customer:' || c_custkey AS node_id, k AS key, v AS value, d::INTEGER AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
    LATERAL (VALUES ('c_name', c_name, 0), ('c_mktsegment', c_mktsegment, 0), ('n_name', n_name, 1), ('r_name', r_name, 2), ('planet', 'Earth', 3)) t(k, v, d)""")
def inherit_props(g):
    own = traverse.inherited_props(g).where(F.col("node_id").startswith("customer:") & (F.col("kind") == "string"))
    return own.select("node_id", "key", F.col("raw").alias("value"), "depth")


@query("""SELECT rel_type, n, array_to_string(samples, ',') AS samples FROM (
  SELECT rel AS rel_type, count(*) AS n, list_slice(list(DISTINCT dst ORDER BY dst), 1, 3) AS samples FROM e GROUP BY 1) ORDER BY n DESC, rel_type LIMIT 5""")
def rel_summary_top(g):
    return traverse.summarize_relations(g.edges, 5).select("rel_type", "n", F.array_join("samples", ",").alias("samples"))


@query("""SELECT node_id, rel_type, n, place::INTEGER AS place FROM (SELECT src AS node_id, rel AS rel_type, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, rel) AS place FROM e GROUP BY 1, 2) WHERE place <= 2""")
def next_step_top(g):
    return traverse.next_steps(g, 2)


@query(""", r AS (SELECT 'order:1' AS node_id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.node_id WHERE act = 'inference' AND depth < 9)
  SELECT node_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1""", recursive=True)
def inference_closure(g):
    return traverse.inference_closure(g, starts(g, "order:1"))


@query(""", r AS (SELECT 'nation:1' AS node_id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.node_id WHERE rel IN ('INSTANCE_OF', 'subClassOf', 'HAS_VALUE') AND depth < 9)
  SELECT node_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1""", recursive=True)
def ontology_closure(g):
    return traverse.ontology_closure(g, starts(g, "nation:1"))


@query("""SELECT start, node_id, hop::INTEGER AS hop, round(conf, 6) AS confidence, CASE WHEN conf < 0.3 THEN 'low_confidence' ELSE 'ok' END AS state FROM (
  SELECT 'order:' || o_orderkey AS start, 'order:' || o_orderkey AS node_id, 0 AS hop, 0.8 AS conf FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 1, 0.8 * least(1.0, greatest(0.0, c_acctbal / 10000)) FROM orders JOIN customer ON o_custkey = c_custkey)""")
def pipeline_confidence(g):
    return reason.reason_on_nodes(g, orders(g)).steps.withColumn("confidence", F.round("confidence", 6))


# Shapes


def shacl(name: str, target: str, path: Path, constraint: Constraint, sql: str):
    def make(g):
        shape = Shape("S", (("class", target),), (PropertyShape(path, (constraint,)),))
        return shapes.validate(g, [shape]).select("focus", "component")

    make.__name__ = f"shacl_{name}"
    query(sql)(make)


def C(name, value=None):  # noqa: N802
    return Constraint(name, value)


ENTITIES = "SELECT node_id AS focus FROM n WHERE label = 'Entity'"
shacl("min_count", "Event", predicate("contains"), C("min_count", 3), "SELECT node_id AS focus, 'min_count' AS component FROM n WHERE label = 'Event' AND node_id NOT IN (SELECT src FROM e WHERE rel = 'contains' GROUP BY 1 HAVING count(*) >= 3)")
shacl("max_count", "Event", predicate("contains"), C("max_count", 5), "SELECT src AS focus, 'max_count' AS component FROM e WHERE rel = 'contains' GROUP BY 1 HAVING count(*) > 5")
shacl("required", "Entity", predicate("p_size"), C("required"), "SELECT node_id AS focus, 'required' AS component FROM n WHERE label = 'Entity' AND node_id NOT LIKE 'part:%'")
shacl("datatype", "Entity", predicate("p_size"), C("datatype", "String"), "SELECT node_id AS focus, 'datatype' AS component FROM p WHERE key = 'p_size'")
shacl("datatype_mixed", "Entity", Path("alternative", (predicate("p_size"), predicate("p_retailprice"), predicate("p_brand"))), C("datatype", "Int"), "SELECT node_id AS focus, 'datatype' AS component FROM p WHERE key IN ('p_retailprice', 'p_brand')")
shacl("range", "Entity", predicate("c_acctbal"), C("min_inclusive", 0), "SELECT node_id AS focus, 'min_inclusive' AS component FROM p WHERE key = 'c_acctbal' AND num < 0")
shacl("max_exclusive", "Entity", predicate("p_retailprice"), C("max_exclusive", 910), "SELECT node_id AS focus, 'max_exclusive' AS component FROM p WHERE key = 'p_retailprice' AND num >= 910")
shacl("length", "Entity", predicate("c_mktsegment"), C("max_length", 8), "SELECT node_id AS focus, 'max_length' AS component FROM p WHERE key = 'c_mktsegment' AND length(s) > 8")
shacl("pattern", "Entity", predicate("p_brand"), C("pattern", "^Brand#[12]"), "SELECT node_id AS focus, 'pattern' AS component FROM p WHERE key = 'p_brand' AND NOT regexp_matches(s, '^Brand#[12]')")
shacl("in", "Entity", predicate("c_mktsegment"), C("in", ("BUILDING", "MACHINERY")), "SELECT node_id AS focus, 'in' AS component FROM p WHERE key = 'c_mktsegment' AND s NOT IN ('BUILDING', 'MACHINERY')")
shacl("has_value", "Event", predicate("o_orderstatus"), C("has_value", "F"), "SELECT 'order:' || o_orderkey AS focus, 'has_value' AS component FROM orders WHERE o_orderstatus <> 'F'")
shacl("unique", "Entity", predicate("p_brand"), C("unique"), "SELECT node_id AS focus, 'unique' AS component FROM p WHERE key = 'p_brand' AND s IN (SELECT s FROM p WHERE key = 'p_brand' GROUP BY 1 HAVING count(*) > 1)")
shacl("logic", "Entity", predicate("p_size"), C("xone", (C("min_inclusive", 10), C("max_inclusive", 20))), "SELECT node_id AS focus, 'xone' AS component FROM p WHERE key = 'p_size' AND num BETWEEN 10 AND 20")
shacl("not", "Entity", predicate("p_size"), C("not", (C("min_inclusive", 40),)), "SELECT node_id AS focus, 'not' AS component FROM p WHERE key = 'p_size' AND num >= 40")
shacl("class", "Entity", Path("alternative", (predicate("locatedIn"), predicate("suppliedBy"))), C("class", "Type"), "SELECT src AS focus, 'class' AS component FROM e JOIN n ON node_id = src WHERE rel = 'suppliedBy' AND label = 'Entity'")
shacl("qualified", "Event", Path("sequence", (predicate("contains"), predicate("p_size"))), C("qualified_min", (2, C("min_inclusive", 25))),
      "SELECT node_id AS focus, 'qualified_min' AS component FROM n WHERE label = 'Event' AND node_id NOT IN (SELECT src FROM e JOIN p ON p.node_id = dst AND key = 'p_size' WHERE rel = 'contains' AND num >= 25 GROUP BY 1 HAVING count(*) >= 2)")
shacl("path_seq", "Event", Path("sequence", (predicate("placedBy"), predicate("locatedIn"), predicate("n_name"))), C("in", ("FRANCE", "CHINA", "NATION_1", "NATION_2")),
      "SELECT 'order:' || o_orderkey AS focus, 'in' AS component FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'CHINA', 'NATION_1', 'NATION_2')")
shacl("path_inverse", "Entity", Path("inverse", (predicate("placedBy"),)), C("max_count", 12), "SELECT dst AS focus, 'max_count' AS component FROM e WHERE rel = 'placedBy' GROUP BY 1 HAVING count(*) > 12")
shacl("path_alt", "Entity", Path("alternative", (predicate("c_acctbal"), predicate("s_acctbal"))), C("min_inclusive", 0), "SELECT node_id AS focus, 'min_inclusive' AS component FROM p WHERE key IN ('c_acctbal', 's_acctbal') AND num < 0")
shacl("path_plus", "Type", Path("one_or_more", (predicate("subClassOf"),)), C("min_count", 2),
      "SELECT node_id AS focus, 'min_count' AS component FROM n WHERE label = 'Type' AND (node_id LIKE 'region:%' OR node_id LIKE 'type:%')")


@query("""SELECT shape, n FROM (SELECT 'Balance' AS shape, count(*) FILTER (num < 0) AS n FROM p WHERE key = 'c_acctbal' UNION ALL SELECT 'Order', count(*) FILTER (num > 400000) FROM p WHERE key = 'o_totalprice') WHERE n > 0""")
def shacl_report(g):
    return shapes.grouped(shapes.validate(g, _two_shapes()))


@query("""SELECT (SELECT count(*) FILTER (num < 0) FROM p WHERE key = 'c_acctbal') AS violations, (SELECT count(*) FILTER (num > 400000) FROM p WHERE key = 'o_totalprice') AS warnings, 0::BIGINT AS infos,
  (SELECT count(*) FILTER (num < 0) = 0 FROM p WHERE key = 'c_acctbal') AS conforms""")
def shacl_summary(g):
    return shapes.summary(shapes.validate(g, _two_shapes()))


def _two_shapes() -> list[Shape]:
    return [
        Shape("Balance", (("subjects_of", "c_acctbal"),), (PropertyShape(predicate("c_acctbal"), (C("min_inclusive", 0),)),)),
        Shape("Order", (("all", ""),), (PropertyShape(predicate("o_totalprice"), (C("max_inclusive", 400000),), shapes.WARNING),)),
    ]


@query("SELECT node_id AS focus, 'class' AS component FROM n WHERE node_id LIKE 'customer:%' OR node_id LIKE 'supplier:%'")
def shacl_node_class(g):
    """Nodes with an edge locatedIn: types among them conform, entities don't."""
    return shapes.validate(g, [Shape("N", (("subjects_of", "locatedIn"),), (), (C("class", "Type"),))]).select("focus", "component")


@query("SELECT DISTINCT dst AS focus FROM e WHERE rel = 'placedBy'")
def shacl_objects_of(g):
    return shapes.focus_nodes(g, Shape("O", (("objects_of", "placedBy"), ("objects_of", "placedBy"))))


# Behaviours


#: Preconditions and what they mean in SQL, over parts (size is an integer, price a float, brand and name strings).
PRE = (
    ("p_size > 20", "p_size > 20"), ("p_size < 20", "p_size < 20"), ("p_size >= 20", "p_size >= 20"), ("p_retailprice <= 950.5", "p_retailprice <= 950.5"), ("p_brand = Brand#2", "p_brand = 'Brand#2'"),
    ("p_brand == Brand#2", "p_brand = 'Brand#2'"), ("p_brand != 'Brand#2'", "p_brand <> 'Brand#2'"), ('p_name matches "^s.*g$"', "regexp_matches(p_name, '^s.*g$')"), ("exists(p_size)", "true"), ("required(c_name)", "false"),
    ("", "true"), ("False", "false"), ("TRUE", "true"), ("p_brand > 5", "false"), ("gone != 1", "true"), ("gone = 1", "false"), ("anything else", "true"),
)


@query("SELECT node_id, k, passes FROM (SELECT 'part:' || p_partkey AS node_id, unnest(range(17)) AS k, unnest([" + ", ".join(sql for _, sql in PRE) + "]) AS passes FROM part)")
def behavior_precondition(g):
    """Every form of a precondition on every part."""
    texts = F.array(*(F.lit(t) for t, _ in PRE))
    rows = g.nodes.where(F.col("node_id").startswith("part:")).select("node_id", F.posexplode(texts).alias("k", "precondition"))
    return behavior.passes(g, rows, keys=["p_size", "p_retailprice", "p_brand", "p_name", "c_name", "gone"]).select("node_id", F.col("k").cast("bigint").alias("k"), "passes")


def with_behaviors(g: Graph) -> Graph:
    """Parts with behaviours made from their own columns: priority from size, parts that name the next ones."""
    base = g.nodes.where(F.col("node_id").startswith("part:")).join(g.props.where("key = 'p_size'").select("node_id", "num"), "node_id").withColumn("k", F.substring_index("node_id", ":", -1).cast("bigint"))
    made = {"hasPrecondition": F.lit("p_size >= 10"), "hasEffect": F.lit("swrl:none"), "hasPriority": (F.col("num") % 15).cast("int").cast("string"), "hasDuration": (F.col("k") % 7).cast("string"),
            "composedOf": F.when(F.col("k") % 10 == 0, F.concat(F.lit("P"), (F.col("k") + 1).cast("string"), F.lit("; P"), (F.col("k") + 10).cast("string"), F.lit(" ;")))}
    rows = base.select("node_id", F.explode(F.create_map(*(x for k, v in made.items() for x in (F.lit(k), v)))).alias("key", "raw")).where("raw IS NOT NULL")
    return versions.update_props(g, rows.withColumn("kind", F.lit("string")))


@query("""SELECT node_id, priority, duration, passes, row_number() OVER (ORDER BY priority DESC, duration, node_id) AS place FROM (
  SELECT 'part:' || p_partkey AS node_id, least(10, p_size % 15)::BIGINT AS priority, (p_partkey % 7)::BIGINT AS duration, p_size >= 10 AS passes FROM part)""")
def behavior_order(g):
    return behavior.placed(behavior.batch(with_behaviors(g))).select("node_id", "priority", "duration", "passes", "place")


@query(""", l AS (SELECT 'part:' || a.p_partkey AS at, 'part:' || b.p_partkey AS part FROM part a JOIN part b ON a.p_partkey % 10 = 0 AND b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 10) WHERE a.p_size >= 10),
  c AS (SELECT 'part:' || p_partkey AS root, 'part:' || p_partkey AS node_id, 0 AS depth FROM part UNION SELECT c.root, l.part, depth + 1 FROM c JOIN l ON l.at = c.node_id WHERE depth < 5)
  SELECT root, node_id, depth::INTEGER AS depth FROM c""", recursive=True)
def behavior_composed(g):
    return behavior.composed(with_behaviors(g))


# Versions and writes


@query("SELECT node_id || '_v2' AS node_id, code || '_v2' AS code, '2' AS version FROM n WHERE code IS NOT NULL")
def version_clone_nodes(g):
    return versions.copy_nodes(g, "2")[0].nodes.where("version = '2'").select("node_id", "code", "version")


@query("SELECT src || '_v2' AS src, rel AS rel_type, dst || '_v2' AS dst FROM e JOIN n a ON a.node_id = src AND a.code IS NOT NULL JOIN n b ON b.node_id = dst AND b.code IS NOT NULL")
def version_clone_edges(g):
    return versions.clone_all(g, "2").edges.where("version = '2'").select("src", "rel_type", "dst")


@query("SELECT label, count(*) AS n FROM (SELECT label FROM n UNION ALL SELECT 'Individual' FROM n WHERE ind) GROUP BY 1")
def version_delete(g):
    return versions.delete_version(versions.clone_all(g, "2"), "2").health()


@query("SELECT 'customer:1_v9' AS node_id, key, CASE key WHEN 'c_mktsegment' THEN 'NEW' WHEN 'code' THEN (SELECT c_name FROM customer WHERE c_custkey = 1) || '_v9' WHEN 'cope_version' THEN '9' WHEN 'graph_id' THEN 'customer:1' ELSE (SELECT c_name FROM customer WHERE c_custkey = 1) END AS value FROM (SELECT unnest(['c_name', 'c_mktsegment', 'code', 'cope_version', 'graph_id']) AS key)")
def version_update(g):
    out = versions.update_entity(g, "customer:1", {"c_mktsegment": "NEW"}, "9")
    return out.props.where("node_id = 'customer:1_v9' AND kind = 'string'").select("node_id", "key", F.col("raw").alias("value"))


@query("SELECT count(*) AS edges FROM e WHERE src <> 'nation:1' AND dst <> 'nation:1'")
def delete_cascade(g):
    return versions.delete_nodes(g, starts(g, "nation:1")).edges.agg(F.count(F.lit(1)).alias("edges"))


# Spatial, routes, engagements


COORDS = "({k} % 180 - 90)::DOUBLE AS {a}lat, (({k} * 7) % 360 - 180)::DOUBLE AS {a}lon"
HAVERSINE = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - ({a}))))"
A_TERM = "pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2)"


def coordinates(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    k = F.col(key)
    return df.withColumns({f"{prefix}lat": (k % 180 - 90).cast("double"), f"{prefix}lon": ((k * 7) % 360 - 180).cast("double")})


@query(f"""SELECT c_custkey, s_suppkey, round({HAVERSINE.format(a=A_TERM)} / 1000, 3) AS km FROM (SELECT c_custkey, c_nationkey, {COORDS.format(k='c_custkey', a='a_')} FROM customer) JOIN (SELECT s_suppkey, s_nationkey, {COORDS.format(k='s_suppkey', a='b_')} FROM supplier) ON c_nationkey = s_nationkey""", graph=False)
def haversine_pairs(spark, d):
    c = coordinates(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey", "a_")
    s = coordinates(spark.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", "b_")
    # few bytes of customers make many pairs, so they are dealt out by number, not by the size of their files
    dealt = c.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "c_custkey")
    pairs = dealt.join(s, F.col("c_nationkey") == F.col("s_nationkey"))
    return pairs.select("c_custkey", "s_suppkey", F.round(timeline.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) / 1000, 3).alias("km"))


@query(f"""SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, {COORDS.format(k='c_custkey', a='a_')} FROM customer), (SELECT n_nationkey, {COORDS.format(k='(n_nationkey * 37)', a='b_')} FROM nation) WHERE {HAVERSINE.format(a=A_TERM)} <= 500000""", graph=False)
def radius_search(spark, d):
    points = coordinates(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey").select("c_custkey", "lat", "lon")
    nations = coordinates(spark.read.parquet(f"{d}/nation.parquet").withColumn("k", F.col("n_nationkey") * 37), "k", "c_").select("n_nationkey", "c_lat", "c_lon")
    return timeline.within(points, nations, 500_000).select("c_custkey", "n_nationkey")


@query(f"""WITH w AS (SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, {COORDS.format(k='o_orderkey', a='b_')} FROM orders),
  l AS (SELECT route, seq, coalesce(lag(b_lat) OVER v, 0.0) AS a_lat, coalesce(lag(b_lon) OVER v, 0.0) AS a_lon, b_lat, b_lon FROM w WINDOW v AS (PARTITION BY route ORDER BY seq)),
  t AS (SELECT route, seq, {HAVERSINE.format(a=A_TERM)} AS dist_m FROM l)
  SELECT route, seq, round(dist_m / 1000, 2) AS km, round(greatest(0.0, sum(dist_m / 200) OVER (PARTITION BY route) - sum(dist_m / 200) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING)) / 60, 2) AS minutes_left FROM t""", graph=False)
def route_legs(spark, d):
    legs = _legs(spark, d)
    return legs.select("route", "seq", F.round(F.col("dist_m") / 1000, 2).alias("km"), F.round(F.col("remaining_s") / 60, 2).alias("minutes_left"))


def _legs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS route", "o_orderkey", "cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bigint) AS seq")
    points = coordinates(o, "o_orderkey").withColumns({"action": F.lit("SCAN"), "start_lat": F.lit(0.0), "start_lon": F.lit(0.0), "speed": F.lit(200.0)})
    return timeline.route_legs(points)


@query(f"""WITH w AS (SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, {COORDS.format(k='o_orderkey', a='b_')} FROM orders),
  l AS (SELECT route, coalesce(lag(b_lat) OVER v, 0.0) AS a_lat, coalesce(lag(b_lon) OVER v, 0.0) AS a_lon, b_lat, b_lon FROM w WINDOW v AS (PARTITION BY route ORDER BY seq))
  SELECT route, count(*) AS legs, round(sum({HAVERSINE.format(a=A_TERM)}) / 1000, 2) AS km FROM l GROUP BY 1""", graph=False)
def route_totals(spark, d):
    return timeline.route_totals(_legs(spark, d)).select("route", "legs", F.round(F.col("total_distance_m") / 1000, 2).alias("km"))


@query(f"""WITH s AS (SELECT o_orderkey AS code, {COORDS.format(k='o_orderkey', a='a_')}, {COORDS.format(k='(o_orderkey + o_custkey % 5)', a='b_')}, (o_custkey % 1200)::DOUBLE AS depth, CASE o_custkey % 4 WHEN 0 THEN 'Torpedo' WHEN 1 THEN 'supersonic missile' WHEN 2 THEN 'gun' ELSE 'net' END AS weapon FROM orders),
  t AS (SELECT *, {HAVERSINE.format(a=A_TERM)} AS m FROM s),
  h AS (SELECT *, greatest(0, least(1, CASE WHEN m <= 3000000 THEN 0.9 * greatest(0, 1 - m / 3000000) ELSE 0 END * CASE WHEN depth > 0 THEN greatest(0.1, 1 - least(0.9, depth / 1000)) ELSE 1 END)) AS p FROM t)
  SELECT code, m <= 3000000 AS in_range, round(p, 6) AS hit_probability, CASE WHEN p >= 0.8 THEN 'destroyed' WHEN p >= 0.6 THEN 'heavy' WHEN p >= 0.3 THEN 'moderate' WHEN p > 0 THEN 'light' ELSE 'none' END AS damage_level,
    round(m / CASE weapon WHEN 'Torpedo' THEN 40 WHEN 'supersonic missile' THEN 300 WHEN 'gun' THEN 800 ELSE 200 END / 60, 2) AS minutes FROM h""", graph=False)
def engagement_score(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    kinds = F.when(F.col("o_custkey") % 4 == 0, "Torpedo").when(F.col("o_custkey") % 4 == 1, "supersonic missile").when(F.col("o_custkey") % 4 == 2, "gun").otherwise("net")
    rows = coordinates(coordinates(o.withColumn("k", F.col("o_orderkey") + F.col("o_custkey") % 5), "o_orderkey", "attacker_"), "k", "target_")
    rows = rows.withColumns({"weapon": kinds, "target_depth": (F.col("o_custkey") % 1200).cast("double"), "weapon_range_m": F.lit(3_000_000.0), "confidence": F.lit(0.9)})
    return timeline.strikes(rows).select(F.col("o_orderkey").alias("code"), "in_range", F.round("hit_probability", 6).alias("hit_probability"), "damage_level", F.round(F.col("total_time_s") / 60, 2).alias("minutes"))


# Texts, values and differences


@query("""SELECT e.src AS source, e.dst AS target, 'locatedIn' AS relation, p.key, NULL::VARCHAR AS old, p.s AS new, 'added' AS change FROM e JOIN p ON p.node_id = dst WHERE rel = 'locatedIn' AND src LIKE 'customer:%'
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey + 1), 'before', 'p_brand', p_brand, b, 'changed' FROM (SELECT *, lead(p_brand) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b <> p_brand
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey + 1), 'before', 'p_size', p_size::VARCHAR, b::VARCHAR, 'changed' FROM (SELECT *, lead(p_size) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b <> p_size""")
def attr_diff(g):
    """What customers lack of their nation's properties, and where the brand or size of a part differs from that of the next one."""
    pairs = g.edges.where((F.col("rel_type") == "locatedIn") & F.col("src").startswith("customer:")).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("relation"))
    k = F.substring_index("node_id", ":", -1).cast("bigint") + 1
    after = g.nodes.where(F.col("node_id").startswith("part:")).select(F.col("node_id").alias("source"), F.concat(F.lit("part:"), k.cast("string")).alias("target"), F.lit("before").alias("relation"))
    some = g.with_(props=g.props.where(~F.col("key").isin("p_name", "p_retailprice")))
    return detect.detect(some, pairs.unionByName(after), [detect.attribute_changes])


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'rdfs' WHEN 1 THEN 'owl2' WHEN 2 THEN 'swrl' WHEN 3 THEN 'sh' WHEN 4 THEN 'rule' WHEN 5 THEN 'func' END AS prefix, CASE WHEN event_id % 8 < 6 THEN event_type END AS body FROM events""", graph=False)
def language_prefix(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    names = F.element_at(F.array(*map(F.lit, ("rdfs:", "owl2:", "swrl:", "sh:", "rule:", "func:", "rdf:", "action:"))), (F.col("event_id") % 8 + 1).cast("int"))
    e = events.select("event_id", F.concat(names, "event_type").alias("x"))
    return e.select("event_id", language.prefix_of(F.col("x")).alias("prefix"), language.body_of(F.col("x")).alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", graph=False)
def jsonpath_extract(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.at_path(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, 'k' AS name, 'integer' AS kind, json_extract_string(props, '$.k') AS raw, json_extract_string(props, '$.k')::DOUBLE AS num FROM events", graph=False)
def json_values(spark, d):
    return text.json_rows(spark.read.parquet(f"{d}/events.parquet"), "props", "event_id")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'rdfs:' || p_brand WHEN 1 THEN 'owl:' || p_brand ELSE 'http://x.org/' || p_brand END AS short, CASE p_partkey % 3 WHEN 2 THEN regexp_extract(p_brand, '[^#]*$') ELSE p_brand END AS name FROM part""", graph=False)
def iri_compress(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    ns = F.element_at(F.array(F.lit("http://www.w3.org/2000/01/rdf-schema#"), F.lit("http://www.w3.org/2002/07/owl#"), F.lit("http://x.org/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    iri = part.select("p_partkey", F.concat(ns, "p_brand").alias("iri"))
    return iri.select("p_partkey", Prefixes().compress(F.col("iri")).alias("short"), name_of(F.col("iri")).alias("name"))


@query("""SELECT o_orderkey, o_totalprice > 200000 AS gt, o_custkey + 1 AS added, CASE WHEN o_custkey <> 0 THEN o_totalprice / o_custkey END AS divided, contains(o_orderpriority, 'HIGH') AS has, '[' || o_orderstatus || ']' AS joined, 'a' = lower(o_orderstatus) AS same FROM orders""", graph=False)
def rule_builtins(spark, d):
    o, b = spark.read.parquet(f"{d}/orders.parquet"), builtins.BUILTINS
    c = F.col
    return o.select(
        "o_orderkey", b["greaterThan"](c("o_totalprice"), F.lit("200000")).alias("gt"), b["add"](c("o_custkey"), F.lit("1")).cast("bigint").alias("added"),
        b["divide"](c("o_totalprice"), c("o_custkey")).cast("double").alias("divided"), b["contains"](c("o_orderpriority"), F.lit("HIGH")).alias("has"),
        b["concat"](F.lit("["), c("o_orderstatus"), F.lit("]")).alias("joined"), b["equal"](F.lit("a"), F.lower("o_orderstatus")).alias("same"),
    )


NUMBERS = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || o_custkey % 15 || ' ' WHEN 2 THEN '-' || o_custkey % 9 WHEN 3 THEN o_orderpriority ELSE o_custkey::VARCHAR END"


@query(f"SELECT o_orderkey, least(10, greatest(0, coalesce(try_cast(trim(v) AS BIGINT), 0))) AS priority, coalesce(try_cast(trim(v) AS BIGINT), 0) AS duration FROM (SELECT o_orderkey, {NUMBERS} AS v FROM orders)", graph=False)
def behavior_numbers(spark, d):
    """Priorities and durations from texts of all orders: numbers, blanks, words."""
    k, cust = F.col("o_orderkey") % 5, F.col("o_custkey")
    v = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), (cust % 15).cast("string"), F.lit(" "))).when(k == 2, F.concat(F.lit("-"), (cust % 9).cast("string"))).when(k == 3, F.col("o_orderpriority")).otherwise(cust.cast("string"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.clamped_priority(v).alias("priority"), text.duration(v).alias("duration"))


@query("""SELECT c_custkey, round(0.35 * least(1, greatest(0, c_acctbal / 10000)) + 0.2 * (c_custkey % 11) / 10 + 0.25 * least(1, (c_custkey % 13) / 10) + 0.2 * 0.5, 8) AS score,
  round(0.35 * least(1, greatest(0, c_acctbal / 10000)) + 0.2 * (c_custkey % 11) / 10 + 0.25 * least(1, (c_custkey % 13) / 10) + 0.2 * 0.5, 8) >= 0.5 AS strict FROM customer""", graph=False)
def confidence_score(spark, d):
    """The weighted mean over a measure of every customer, and what the strict mode lets through; measures outside 0 to 1 are clamped."""
    rows = spark.read.parquet(f"{d}/customer.parquet")
    score = F.round(confidence.weighted_column(F.col("c_acctbal") / 10000, (F.col("c_custkey") % 11) / 10, (F.col("c_custkey") % 13) / 10, F.lit(0.5)), 8)
    return rows.select("c_custkey", score.alias("score"), (score >= confidence.Mode.of("WarFighting").value).alias("strict"))


@query("SELECT 'customer:' || c_custkey AS node_id, c_name AS code FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name), '7')")
def search_combined(g):
    return search.search(g, subclass_of="region:1", keyword="7", props={"c_mktsegment": "BUILDING"}).select("node_id", "code")


@query("SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 4")
def search_type(g):
    return search.search(g, type_="nation:4").select("node_id")


@query("SELECT rel AS rel_type, count(*) AS n FROM e WHERE dst = 'customer:1' GROUP BY 1")
def entity_context_incoming(g):
    return search.context(g, "customer:1")["incoming"].select("rel_type", "n")


@query("SELECT 'type:World' AS ancestor, 2 AS depth UNION ALL SELECT 'region:' || n_regionkey, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 UNION ALL SELECT 'nation:' || c_nationkey, 0 FROM customer WHERE c_custkey = 1")
def entity_context_types(g):
    return search.context(g, "customer:1")["types"]


@query("SELECT date_trunc('hour', ts) AS start, 'did' AS rel_type, 'type:' || event_type AS dst, count(*) AS n FROM events GROUP BY 1, 3", graph=False)
def stream_counts(spark, d):
    from .streaming.incremental import event_edges, relation_counts

    return relation_counts(event_edges(spark.read.parquet(f"{d}/events.parquet"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import operator_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
