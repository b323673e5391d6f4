"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once; lambdas also keep long expressions out of generated methods."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(pairs) -> Column:
    """A literal map of (text, text) or (text, int) pairs; one parsed expression, folded to a constant."""
    pairs = list(pairs)
    kind = "int" if isinstance(pairs[0][1], int) else "string"
    keys, values = (",".join(str(p[i]) for p in pairs) for i in (0, 1))
    return F.expr(f"map_from_arrays(split('{keys}', ','), cast(split('{values}', ',') as array<{kind}>))")
