"""Whole-field reductions with partial sums in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.exact import exact_sum

#: Names: aggregates of a column.  min and max are `x < y ? x : y` and `x > y ? x : y`; NaNs are passed over (Spark orders them last), all of them if there is nothing else.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "plus": F.sum,
    "mul": F.product,
    "min": lambda c: F.min(F.when(~F.isnan(c.cast("double")), c)),
    "max": lambda c: F.max(F.when(~F.isnan(c.cast("double")), c)),
    "bitwise_and": F.bit_and,
    "bitwise_or": F.bit_or,
    "bitwise_xor": F.bit_xor,
}


class Reducible:
    """A field to be reduced, with the neutral element of the reduction."""

    def __init__(self, field: DataFrame, column: str, neutral: object):
        self.field, self.column, self.neutral = field, column, neutral

    def reduce(self, how: str | Callable[[object, object], object], kind: str = "double") -> DataFrame:
        """One row, column `value`; a callable of two values reduces each task's rows, then the tasks' results.

        `exact_plus` is a sum of doubles that does not depend on the order of rows; `plus` does, in its last bits.

        A callable must be associative and commutative and leave values as they are with the neutral element.
        """
        if how == "exact_plus":
            return exact_sum(self.field, [], self.column, "value").select(F.coalesce("value", F.lit(self.neutral)).alias("value"))
        if isinstance(how, str):
            value = REDUCTIONS[how](F.col(self.column))
            return self.field.agg(F.coalesce(value, F.lit(self.neutral)).alias("value"))
        name, neutral = self.column, self.neutral

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both, out, some = np.frompyfunc(how, 2, 1), neutral, False
            for pdf in frames:
                if len(pdf):
                    out, some = both.reduce(pdf.iloc[:, 0].to_numpy(object), initial=out), True
            if some:
                yield pd.DataFrame({"value": [out]})

        partial = self.field.select(name).mapInPandas(fold, f"value {kind}")
        last = partial.repartition(1).mapInPandas(fold, f"value {kind}")
        return last.agg(F.coalesce(F.first("value"), F.lit(neutral).cast(kind)).alias("value"))


def make_reducible(field: DataFrame, column: str, neutral: object) -> Reducible:
    return Reducible(field, column, neutral)


def scatter(updates: DataFrame, keys: list[str], column: str, how: str, order: str | None = None) -> DataFrame:
    """What atomic add, sub, min, max and exch on shared cells come to: one aggregate by cell.

    exch leaves the last update by the column `order`; of several last ones the greatest.
    """
    if how == "exch":
        if order is None:
            raise ValueError("exch needs an order")
        value = F.max(F.struct(F.col(order).alias("__order"), F.col(column).alias("__value")))["__value"]
    else:
        value = {"add": F.sum, "sub": lambda c: -F.sum(c), "min": F.min, "max": F.max}[how](F.col(column))
    return updates.groupBy(*keys).agg(value.alias(column))
