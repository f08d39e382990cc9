"""Confidence of derived facts: a weighted mean of four measures, modes with thresholds, and the gate that trips below them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of match, cardinality, property and structure; thresholds of the modes.
WEIGHTS = (0.35, 0.20, 0.25, 0.20)


class Mode(Enum):
    PERMISSIVE = 0.15
    BALANCED = 0.30
    STRICT = 0.50

    @classmethod
    def of(cls, name: str) -> Mode:
        """A mode by name, older names included."""
        older = {"training": "PERMISSIVE", "exercise": "BALANCED", "warfighting": "STRICT"}
        key = name.replace("_", "").lower()
        return cls[older.get(key, key.upper())]


#: Weights of the sources of a fact, which callers may override.
SOURCE_WEIGHTS = {"explicit": 0.45, "rule": 0.30, "inherited": 0.25, "external": 0.20}


def clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def weighted(match: float, cardinal: float, prop: float, structural: float, weights=WEIGHTS) -> float:
    total = sum(weights)
    return clamp(sum(clamp(v) * w for v, w in zip((match, cardinal, prop, structural), weights)) / total) if total else 0.0


def weighted_column(match: Column, cardinal: Column, prop: Column, structural: Column, weights=WEIGHTS) -> Column:
    """:func:`weighted` over columns."""
    total = sum(weights)
    clamped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * w for v, w in zip((match, cardinal, prop, structural), weights)]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(clamped[1:], clamped[0]) / total)) if total else F.lit(0.0)


def rule_score(variables: int, atoms: int, bindings: int) -> float:
    """The confidence of a rule's results in one evaluation."""
    return weighted(min(1.0, variables / max(1, atoms)), 1.0, 1.0, max(1 / max(1, bindings), 0.1))


@dataclass
class Gate:
    """Trips where a confidence is below the threshold, and remembers each trip."""

    threshold: float = Mode.BALANCED.value
    trips: list[tuple[float, float, str]] = field(default_factory=list)

    @property
    def tripped(self) -> bool:
        return bool(self.trips)

    def check(self, confidence: float, rule: str) -> bool:
        """Whether the results pass."""
        if confidence >= self.threshold:
            return True
        self.trips.append((confidence, self.threshold, rule))
        return False

    def reset(self) -> None:
        self.trips.clear()
