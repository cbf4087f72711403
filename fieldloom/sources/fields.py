"""Fields as DataFrames: from formulas, tables, numpy arrays and Parquet, and back."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldSpec:
    """What a field is to be: each thing is set at most once, type and dimensions must be."""

    dims: Mapping[str, int] | None = None
    dtype: str | None = None
    init: Callable[..., Column] | Column | object = None
    name: str = "value"
    halos: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    mask: tuple[str, ...] = ()
    read_only: bool = False

    def _set(self, **what) -> FieldSpec:
        for k in what:
            if getattr(self, k) != getattr(FieldSpec(), k):
                raise ValueError(f"{k} is set already")
        return FieldSpec(**{**self.__dict__, **what})

    def type(self, dtype: str) -> FieldSpec:
        return self._set(dtype=dtype)

    def dimensions(self, **dims: int) -> FieldSpec:
        return self._set(dims=dims)

    def named(self, name: str) -> FieldSpec:
        return self._set(name=name)

    def halo(self, **halos: tuple[int, int]) -> FieldSpec:
        return self._set(halos=halos)

    def masked(self, *dims: str) -> FieldSpec:
        """Dimensions along which the field does not vary: it has no column for them."""
        return self._set(mask=dims)

    def initializer(self, f: Callable[..., Column]) -> FieldSpec:
        """f of the index columns in order."""
        return self._set(init=f)

    def value(self, v: object) -> FieldSpec:
        return self._set(init=v)

    def const(self) -> FieldSpec:
        return self._set(read_only=True)

    def build(self, spark: SparkSession) -> DataFrame:
        """A row for each index from 0, dealt over tasks by the first dimension with more than one index."""
        if self.dims is None or self.dtype is None:
            raise ValueError("type and dimensions must be set")
        if self.read_only and self.init is None:
            raise ValueError("a read-only field needs an initializer")
        dims = {d: n for d, n in self.dims.items() if d not in self.mask}
        out = dense(spark, dims)
        init = self.init(*map(F.col, dims)) if callable(self.init) else F.lit(self.init)
        return out.withColumn(self.name, init.cast(self.dtype))


def dense(spark: SparkSession, dims: Mapping[str, int], offsets: Mapping[str, int] | None = None) -> DataFrame:
    """All points of a box as int columns, from one range: the row number's mixed-radix digits, so that it splits evenly."""
    total = int(np.prod([*dims.values(), 1]))
    out = spark.range(total)
    rest = F.col("id")
    columns = {}
    for d, n in reversed(dims.items()):
        columns[d] = (rest % max(n, 1) + (offsets or {}).get(d, 0)).cast("int")
        rest = F.floor(rest / max(n, 1))
    return out.select(*(columns[d].alias(d) for d in dims))


def zip_fields(first: DataFrame, *others: DataFrame, dims: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """One table of fields on the same points; a field without some of the dimensions is repeated along them.

    A field that shares no dimension must have exactly one row; the query fails if it has not.
    """
    for other in others:
        on = [d for d in dims if d in other.columns and d in first.columns]
        first = first.join(other, on) if on else first.join(F.broadcast(_single(other)))
    return first


def _single(field: DataFrame) -> DataFrame:
    """The one row of a field."""
    row = field.agg(F.count("*").alias("__rows"), *(F.first(c).alias(c) for c in field.columns))
    alone = F.when(F.col("__rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a field that shares no dimension must have one row")).cast("boolean"))
    return row.where(alone).drop("__rows")


def lattice(rows: DataFrame, i: Column, j: Column, k: Column, value: Column, dims: tuple[int, int, int]) -> DataFrame:
    """Dense (i, j, k, value): the sum of value over the rows at each point of the box, 0 where there are none."""
    sums = rows.select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), value.alias("v")).groupBy("i", "j", "k").agg(F.sum("v").cast("double").alias("value"))
    points = dense(rows.sparkSession, dict(zip("ijk", dims, strict=True)))
    return points.join(sums, ["i", "j", "k"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def rename_dimensions(df: DataFrame, **names: str) -> DataFrame:
    """Relabel dimensions: old=new."""
    return df.withColumnsRenamed(names)


def shift_origin(df: DataFrame, **offsets: int) -> DataFrame:
    """Move the origin to the given place: coordinates become smaller by it."""
    return df.withColumns({d: (F.col(d) - o).cast(df.schema[d].dataType) for d, o in offsets.items()})


def dimension_to_tuple(df: DataFrame, dim: str, value: str) -> DataFrame:
    """The values along a dimension as one array for each of the other points, in order."""
    rest = [c for c in df.columns if c not in (dim, value)]
    packed = df.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(dim, value))).alias("__l"))
    return packed.select(*rest, F.col(f"__l.{value}").alias(value))


def tuple_to_dimension(df: DataFrame, value: str, dim: str) -> DataFrame:
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(value).alias(dim, value))


def from_numpy(spark: SparkSession, array: np.ndarray, dims: tuple[str, ...] = ("i", "j", "k"), name: str = "value", dtype: str | None = None, order: str = "C", offsets: Mapping[str, int] | None = None) -> DataFrame:
    """A field from an array (or anything with a buffer); order F: the array is a column-major buffer seen as row-major, its axes in the opposite order of dims.

    Checked: the number of dimensions, a fixed-size number type, and dtype where it is given.
    """
    a = np.asarray(array)
    if a.ndim != len(dims):
        raise ValueError(f"the array has {a.ndim} dimensions, not {len(dims)}")
    if a.dtype.kind not in "iufb":
        raise ValueError(f"no field type for {a.dtype}")
    if dtype and np.dtype(dtype) != a.dtype:
        raise ValueError(f"the array holds {a.dtype}, not {dtype}")
    if order == "F":
        a = a.T
    import pandas as pd

    places = np.indices(a.shape).reshape(a.ndim, -1)
    own = offsets or {}
    return spark.createDataFrame(pd.DataFrame({**{d: (p + own.get(d, 0)).astype(np.int32) for d, p in zip(dims, places, strict=True)}, name: a.reshape(-1)}))


def to_numpy(df: DataFrame, dims: tuple[str, ...] = ("i", "j", "k"), name: str = "value") -> np.ndarray:
    """The field as an array from its smallest indices on; it must be dense.  The array comes to the driver."""
    pdf = df.select(*dims, name).toPandas()
    at = [pdf[d].to_numpy() - pdf[d].min() for d in dims]
    shape = [int(x.max()) + 1 for x in at]
    if int(np.prod(shape)) != len(pdf):
        raise ValueError("the field is not dense")
    out = np.empty(shape, pdf[name].dtype)
    out[tuple(at)] = pdf[name].to_numpy()
    return out


def transform_layout(df: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """The same points with the dimension columns in another order: a copy between layouts."""
    return df.select(*dims, *[c for c in df.columns if c not in dims])
