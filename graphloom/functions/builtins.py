"""Built-in predicates and functions of rules, as Column factories.

Arguments are strings (bindings) or literals; numbers are compared as numbers where both sides hold one, and as text otherwise. A null result of a
predicate means that it could not be evaluated, and its row is dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(x: Column) -> Column:
    return x.cast("string")


def number(x: Column) -> Column:
    return text(x).try_cast("double")


def whole(x: Column) -> Column:
    return text(x).try_cast("bigint")


def _compare(a: Column, b: Column, op: Callable) -> Column:
    both = number(a).isNotNull() & number(b).isNotNull()
    neither = number(a).isNull() & number(b).isNull()
    return F.when(both, op(number(a), number(b))).when(neither, op(text(a), text(b)))


def equal(a: Column, b: Column) -> Column:
    return F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).otherwise(text(a) == text(b))


def _arithmetic(a: Column, b: Column, integer: Callable, double: Callable) -> Column:
    """Text of an integer where both sides are integers, else of a double; null where a side is no number."""
    ints = whole(a).isNotNull() & whole(b).isNotNull()
    return F.when(ints, text(integer(whole(a), whole(b)))).otherwise(text(double(number(a), number(b))))


def divide(a: Column, b: Column) -> Column:
    """Always a double; null where the divisor is within rounding of zero."""
    return text(F.when(F.abs(number(b)) >= F.lit(sys.float_info.epsilon), F.try_divide(number(a), number(b))))


def parts(x: Column) -> Column:
    return F.transform(F.split(text(x), ","), lambda p: F.trim(p))


BUILTINS: dict[str, Callable[..., Column]] = {
    "equal": equal,
    "notEqual": lambda a, b: ~equal(a, b),
    "greaterThan": lambda a, b: _compare(a, b, lambda x, y: x > y),
    "lessThan": lambda a, b: _compare(a, b, lambda x, y: x < y),
    "greaterThanOrEqual": lambda a, b: _compare(a, b, lambda x, y: x >= y),
    "lessThanOrEqual": lambda a, b: _compare(a, b, lambda x, y: x <= y),
    "add": lambda a, b: _arithmetic(a, b, F.try_add, F.try_add),
    "subtract": lambda a, b: _arithmetic(a, b, F.try_subtract, F.try_subtract),
    "multiply": lambda a, b: _arithmetic(a, b, F.try_multiply, F.try_multiply),
    "divide": divide,
    "abs": lambda a: F.when(whole(a).isNotNull(), text(F.abs(whole(a)))).otherwise(text(F.abs(number(a)))),
    "contains": lambda a, b: text(a).contains(text(b)),
    "startsWith": lambda a, b: text(a).startswith(text(b)),
    "endsWith": lambda a, b: text(a).endswith(text(b)),
    "concat": lambda *xs: F.concat(*map(text, xs)),
    "booleanNot": lambda a: F.when(F.lower(text(a)).isin("true", "false"), F.lower(text(a)) == "false"),
    "listContains": lambda a, b: F.array_contains(parts(a), F.trim(text(b))),
    "listLength": lambda a: text(F.size(F.filter(parts(a), lambda p: p != ""))),
}

#: Those that test; a call of any other in a rule body only has to give a value.
PREDICATES = {"equal", "notEqual", "greaterThan", "lessThan", "greaterThanOrEqual", "lessThanOrEqual", "contains", "startsWith", "endsWith", "booleanNot", "listContains"}


def register(name: str, make: Callable[..., Column], predicate: bool = True) -> None:
    """Add a built-in, or replace one. ``make`` takes and returns Columns; a pandas UDF will do where no Spark function does."""
    BUILTINS[name] = make
    (PREDICATES.add if predicate else PREDICATES.discard)(name)


def local_name(functor: str) -> str:
    return functor.rpartition("#")[2].rpartition(":")[2]


def holds(functor: str, args: list[Column]) -> Column:
    """Whether a call holds as a body atom; null where it can't be evaluated or isn't known."""
    name = local_name(functor)
    if name not in BUILTINS:
        return F.lit(None).cast("boolean")
    value = BUILTINS[name](*args)
    return value if name in PREDICATES else value.isNotNull()
