"""IRIs: compression to prefixes, expansion, and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import NAMESPACES


class Prefixes:
    """A registry of namespaces by prefix, the four standard ones included."""

    def __init__(self, extra: dict[str, str] | None = None):
        self.namespaces = {**NAMESPACES, **(extra or {})}

    def compress(self, iri: Column) -> Column:
        """``prefix:name`` for an IRI in a known namespace (the longest one that fits), else the IRI."""
        out = None
        for prefix, ns in sorted(self.namespaces.items(), key=lambda x: (-len(x[1]), x[0])):
            case = iri.startswith(ns)
            short = F.concat(F.lit(f"{prefix}:"), F.substr(iri, F.lit(len(ns) + 1)))
            out = F.when(case, short) if out is None else out.when(case, short)
        return out.otherwise(iri)

    def expand(self, short: Column) -> Column:
        """The IRI for ``prefix:name`` with a known prefix, else the text itself."""
        out = None
        for prefix, ns in sorted(self.namespaces.items()):
            case = short.startswith(f"{prefix}:")
            long = F.concat(F.lit(ns), F.substr(short, F.lit(len(prefix) + 2)))
            out = F.when(case, long) if out is None else out.when(case, long)
        return out.otherwise(short)

    def expand_text(self, short: str, default: str = "http://example.org#") -> str:
        """Expansion of a name in rule text: full IRIs stay, a leading colon stands for the default namespace."""
        if "://" in short:
            return short
        prefix, colon, name = short.partition(":")
        if colon and not prefix:
            return default + name
        return self.namespaces[prefix] + name if colon and prefix in self.namespaces else short


def name_of(iri: Column) -> Column:
    """The name in an IRI: what follows ``:`` in a compressed one, else the last ``#``, else the last ``/``."""
    compressed = Prefixes().compress(iri)
    short = ~compressed.contains("://") & compressed.contains(":")
    return F.when(short, F.regexp_extract(compressed, ":(.*)$", 1)).when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))
