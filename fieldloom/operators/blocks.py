"""Fields that stay in blocks over many steps, of which only border strips move.

A block is one row: an array for each field, halo included, and the strips of its box that its neighbours need.  The rows are a table bucketed by block.
A step reads the strips alone, sends them to the blocks that need them, puts them in place there and runs the stages on the block's arrays; the
block's own arrays are read where they lie.  What a step writes is a new table, so that its plan does not grow with the steps.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.stencil import numpy_plan, run_plan
from fieldloom.plans.grid import Grid
from fieldloom.plans.spec import MultiStage, Spec, SpecError
from fieldloom.sources.tables import Table

SIDES = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]


@dataclass(frozen=True)
class Layout:
    """How a lattice from (0, 0, 0) on is cut: cells of a block, blocks, and halo cells (minus, plus) in i, j and k; which dimensions wrap."""

    sizes: tuple[int, int, int]
    blocks: tuple[int, int, int]
    halos: tuple[tuple[int, int], tuple[int, int], tuple[int, int]]
    periodic: tuple[bool, bool, bool] = (False, False, False)

    def __post_init__(self):
        if min(*self.sizes, *self.blocks) < 1 or any(min(h) < 0 or max(h) > n for h, n in zip(self.halos, self.sizes, strict=True)):
            raise ValueError("a block has cells, and its halo is no wider than a block")

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(m + n + p for n, (m, p) in zip(self.sizes, self.halos, strict=True))

    def number(self, at: tuple[int, int, int]) -> int:
        return (at[0] * self.blocks[1] + at[1]) * self.blocks[2] + at[2]

    def place(self, number: int) -> tuple[int, int, int]:
        return number // (self.blocks[1] * self.blocks[2]), number // self.blocks[2] % self.blocks[1], number % self.blocks[2]

    def lows(self, number: int) -> tuple[int, int, int]:
        """The lattice's place of the first cell of a block's array."""
        return tuple(b * n - m for b, n, (m, _) in zip(self.place(number), self.sizes, self.halos, strict=True))

    def neighbour(self, number: int, side: tuple[int, int, int]) -> int | None:
        at = [b + s for b, s in zip(self.place(number), side, strict=True)]
        for d, (count, wraps) in enumerate(zip(self.blocks, self.periodic, strict=True)):
            if not 0 <= at[d] < count:
                if not wraps:
                    return None
                at[d] %= count
        return self.number(tuple(at))

    def sent(self, side: tuple[int, int, int]) -> tuple[slice, ...]:
        """Box cells that the neighbour on a side needs: its halo there has the mirrored width."""
        return tuple(slice(m, m + p) if s < 0 else slice(m + n - m, m + n) if s > 0 else slice(m, m + n) for s, n, (m, p) in zip(side, self.sizes, self.halos, strict=True))

    def received(self, side: tuple[int, int, int]) -> tuple[slice, ...]:
        """Halo cells that what a block sent to this side fills."""
        return tuple(slice(m + n, m + n + p) if s < 0 else slice(0, m) if s > 0 else slice(m, m + n) for s, n, (m, p) in zip(side, self.sizes, self.halos, strict=True))

    def strip_cells(self) -> int:
        """Cells that all strips of a block have together."""
        return sum(int(np.prod([x.stop - x.start for x in self.sent(s)])) for s in SIDES)


class Blocks:
    """Fields in blocks.  exchanged: those whose halo is filled before each step."""

    def __init__(self, layout: Layout, kinds: Mapping[str, T.DataType], exchanged: tuple[str, ...], table: Table, buckets: int):
        self.layout, self.kinds, self.exchanged, self.table, self.buckets = layout, dict(kinds), exchanged, table, buckets

    @classmethod
    def of(cls, fields: DataFrame, layout: Layout, exchanged: tuple[str, ...]) -> Blocks:
        """Blocks of a dense table (i, j, k, fields of numbers); halo cells are NaN or 0 until a neighbour fills them.

        One exchange by block; each is put together in a task, which raises an error where points are missing or repeated.
        """
        kinds = {f.name: f.dataType for f in fields.schema if f.name not in ("i", "j", "k")}
        if not set(exchanged) <= set(kinds):
            raise SpecError(f"no such fields: {sorted(set(exchanged) - set(kinds))}")
        place = [F.floor(F.col(d) / n).cast("int") for d, n in zip("ijk", layout.sizes, strict=True)]
        rows = fields.withColumn("block", (place[0] * layout.blocks[1] + place[1]) * layout.blocks[2] + place[2])
        rows = rows.where(" and ".join(f"{d} between 0 and {n * b - 1}" for d, n, b in zip("ijk", layout.sizes, layout.blocks, strict=True)))
        schema, finish = _row_schema(kinds, exchanged), _finisher(layout, list(kinds), exchanged)

        def build(points: pa.Table) -> pa.Table:
            number = points["block"][0].as_py()
            at = tuple(points[d].to_numpy().astype(np.int64) - low for d, low in zip("ijk", layout.lows(number), strict=True))
            if points.num_rows != int(np.prod(layout.sizes)) or len(np.unique(np.ravel_multi_index(at, layout.shape))) != points.num_rows:
                raise ValueError("the table has a hole or a repeated point")
            data = {}
            for f in kinds:
                column = points[f].to_numpy()
                data[f] = np.full(layout.shape, np.nan if column.dtype.kind == "f" else 0, column.dtype)
                data[f][at] = column
            return finish(number, data)

        buckets = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(layout, kinds, exchanged, Table(rows.groupBy("block").applyInArrow(build, schema), "block", buckets), buckets)

    def step(self, spec: Spec | MultiStage | None = None, grid: Grid | None = None, swaps: Mapping[str, str] | None = None) -> Blocks:
        """The fields after an exchange of halos, a run of spec (if any) on the grid's box, and swaps of fields."""
        out = self.plan(spec, grid, swaps)
        return Blocks(self.layout, self.kinds, self.exchanged, Table(out, "block", self.buckets), self.buckets)

    def plan(self, spec: Spec | MultiStage | None = None, grid: Grid | None = None, swaps: Mapping[str, str] | None = None) -> DataFrame:
        """The rows that a step writes."""
        spec = Spec((spec,)) if isinstance(spec, MultiStage) else spec
        layout, kinds, exchanged = self.layout, self.kinds, self.exchanged
        stages = None
        if spec is not None:
            spec.validate(grid)
            if spec.fields() - spec.temps - set(kinds):
                raise SpecError(f"no such fields: {sorted(spec.fields() - spec.temps - set(kinds))}")
            if layout.blocks[2] > 1 and any(m.order != "parallel" for m in spec.multistages):
                raise SpecError("ordered multistages need blocks of whole columns")
            for f, e in spec.arg_extents().items():
                halos = layout.halos if f in exchanged or f in spec.temps else ((0, 0),) * 3
                whole = (False, False, layout.blocks[2] == 1)  # beyond a whole column there is nothing to exchange
                if any((getattr(e, d)[0] < -m or getattr(e, d)[1] > p) and not all_k for d, (m, p), all_k in zip("ijk", halos, whole, strict=True)):
                    raise SpecError(f"{f} is read beyond the halo that is exchanged for it")
            stages = numpy_plan(spec, grid)
        pairs = {**(swaps or {}), **{b: a for a, b in (swaps or {}).items()}}
        finish = _finisher(layout, list(kinds), exchanged)

        def advance(own: pa.Table, strips: pa.Table) -> pa.Table:
            number = own["block"][0].as_py()
            data = {f: own[f].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(layout.shape).copy() for f in kinds}
            for n in range(strips.num_rows):
                place = layout.received(SIDES[strips["side"][n].as_py()])
                for f in exchanged:
                    part = data[f][place]
                    part[...] = strips[f][n].values.to_numpy(zero_copy_only=False).reshape(part.shape)
            if stages is not None:
                run_plan(stages, spec, data, grid, layout.lows(number), layout.shape)
            return finish(number, {f: data[pairs.get(f, f)] for f in kinds})

        table = self.table.read()
        strips = table.select(F.explode("strips").alias("s")).select("s.to", "s.side", *(F.col(f"s.`{f}`").alias(f) for f in exchanged))
        return table.drop("strips").groupBy("block").cogroup(strips.groupBy("to")).applyInArrow(advance, table.schema)

    def march(self, spec: Spec | MultiStage, grid: Grid, count: int, swaps: Mapping[str, str] | None = None) -> Blocks:
        """count steps; each step's table is dropped once the next one is there, this one's is kept."""
        now = self
        for _ in range(count):
            after = now.step(spec, grid, swaps)
            if now is not self:
                now.drop()
            now = after
        return now

    def rows(self) -> DataFrame:
        """The points of all boxes: (i, j, k, fields), without halos."""
        layout, kinds = self.layout, self.kinds
        schema = T.StructType([*(T.StructField(d, T.IntegerType()) for d in "ijk"), *(T.StructField(f, k) for f, k in kinds.items())])
        box = tuple(slice(m, m + n) for n, (m, _) in zip(layout.sizes, layout.halos, strict=True))

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    lows = layout.lows(batch.column(0)[n].as_py())
                    at = np.meshgrid(*(np.arange(x.start, x.stop, dtype=np.int32) + low for x, low in zip(box, lows, strict=True)), indexing="ij")
                    values = [batch.column(1 + m)[n].values.to_numpy(zero_copy_only=False).reshape(layout.shape)[box].ravel() for m in range(len(kinds))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(a.ravel()) for a in at), *(pa.array(v) for v in values)], names=[f.name for f in schema])

        return self.table.read().select("block", *kinds).mapInArrow(flat, schema)

    def drop(self) -> None:
        self.table.drop()


def _row_schema(kinds: Mapping[str, T.DataType], exchanged: tuple[str, ...]) -> T.StructType:
    strip = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("side", T.IntegerType()), *(T.StructField(f, T.ArrayType(kinds[f])) for f in exchanged)])
    return T.StructType([T.StructField("block", T.IntegerType()), *(T.StructField(f, T.ArrayType(k)) for f, k in kinds.items()), T.StructField("strips", T.ArrayType(strip))])


def _finisher(layout: Layout, names: list[str], exchanged: tuple[str, ...]):
    """A function from a block's number and arrays to its row."""

    def finish(number: int, data: Mapping[str, np.ndarray]) -> pa.Table:
        strips = []
        for n, side in enumerate(SIDES):
            to, place = layout.neighbour(number, side), layout.sent(side)
            if to is not None and all(x.stop > x.start for x in place):
                strips.append({"to": to, "side": n, **{f: data[f][place].ravel() for f in exchanged}})
        kind = pa.list_(pa.struct([("to", pa.int32()), ("side", pa.int32()), *((f, pa.list_(pa.from_numpy_dtype(data[f].dtype))) for f in exchanged)]))
        arrays = [pa.array([data[f].ravel()], pa.list_(pa.from_numpy_dtype(data[f].dtype))) for f in names]
        return pa.table([pa.array([number], pa.int32()), *arrays, pa.array([strips], kind)], names=["block", *names, "strips"])

    return finish
