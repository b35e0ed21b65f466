"""Small helpers for computing heavy columns once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-element generator.

    The optimiser moves filters through projections by copying the projected expressions into them, so a filter on a
    heavy column would evaluate its whole chain again. It does not do so through a generator: the columns are computed
    once, whatever is filtered or selected later.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(values: list, ordinal: Column, empty: str = "string") -> Column:
    """The constant at a 0-based place. The list travels as one literal, which keeps the plan small; Spark folds the split. Of an empty list
    nothing is found, a null of the type ``empty``."""
    if not values:
        return F.lit(None).cast(empty)
    kind = "boolean" if isinstance(values[0], bool) else "int" if isinstance(values[0], int) else "string"
    listed = F.split(F.lit("\x01".join(map(str, values))), "\x01")
    # An unknown place has no constant; element_at does not declare that, so it is said here.
    return F.when(ordinal.isNotNull(), F.element_at(listed, ordinal + 1).cast(kind))
