"""Running a spec on a DataFrame of dimension columns i, j, k and value columns.

Strategies for dense tables.  Windows, for parallel multistages: rows are dealt to horizontal tiles together with the halo that the
extents ask for, so that one exchange by tile and level serves all windows of all stages, and each tile's own cells
are kept in the end.  Blocks, for ordered multistages or on request: the same tiles, all levels of one in a task, as
numpy arrays.  Columns, for ordered multistages without Python: see ordered.  All treat writes as updates: cells and levels that no stage covers keep
their old values.  Sparse tables are served by gathers within tiles: every row goes to the places that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from fieldloom.operators.gather import sent_within
from fieldloom.operators.ordered import has_column_form, read_indexed, run_columns
from fieldloom.plans.expr import native_only, reads, to_column, to_numpy
from fieldloom.plans.grid import Extent, Grid
from fieldloom.plans.spec import MultiStage, Operator, Spec, SpecError, Stage, execute_parallel
from fieldloom.sources.tables import written

TILE = (64, 64)
#: Types of temporaries in blocks.
_NUMPY_KINDS = {"double": np.dtype("f8"), "float": np.dtype("f4"), "bigint": np.dtype("i8"), "long": np.dtype("i8"), "int": np.dtype("i4"), "boolean": np.dtype("?")}


def run(spec: Spec | MultiStage, grid: Grid, fields: DataFrame, strategy: str = "auto", tile: tuple[int, int] = TILE, check_bounds: bool = False, sparse: bool = False) -> DataFrame:
    """fields with the written columns updated on the grid's box; temporaries are not returned.

    fields is dense: a row for each point of a box that holds the grid's and the read extents (check_bounds makes sure of
    that, and of a table without holes and repeated points, by one aggregate).  Fields outside the box keep their values, also those that inner stages compute beyond
    it.  strategy: windows (for parallel multistages), columns (JVM folds for ordered ones, windows for the others), blocks (numpy over tiles) or
    auto (windows if all multistages are parallel, else blocks).  tile: cells of a tile in i and j.  A hole or a repeated point that a task meets raises an
    error.

    sparse: the table may lack points.  A missing point is read as null, so that what is computed from it is null too (a choice whose condition is
    null as well); only points that the table holds are written.
    """
    spec = spec if isinstance(spec, Spec) else Spec((spec,))
    spec.validate(grid)
    missing = spec.fields() - spec.temps - set(fields.columns)
    if missing:
        raise SpecError(f"no such fields: {sorted(missing)}")
    if min(grid.ni, grid.nj, grid.nk) <= 0:
        return fields
    if check_bounds and not sparse:
        _check(spec, grid, fields)
    parallel = all(m.order == "parallel" for m in spec.multistages)
    if sparse:
        if any(s.indexed() for s in spec.stages()):
            raise SpecError("reads at offsets that are expressions need dense columns")
        if not parallel or strategy not in ("auto", "windows"):
            raise SpecError("sparse tables serve parallel multistages only")
        strategy = "windows"
    if strategy == "auto":
        strategy = "windows" if parallel else "blocks"  # numpy over tiles outruns the lambdas of columns, which Spark interprets
    if strategy == "columns" and not has_column_form(spec):
        raise SpecError("an ordered multistage reads what it writes at a horizontal offset, which has no column form")
    if strategy == "blocks" and any(native_only(e) for s in spec.stages() for _, b in s.bodies() for e in b.values()):
        raise SpecError("tuple values have no block form")
    if strategy == "blocks" and any(spec.kinds.get(t, "double") not in _NUMPY_KINDS for t in spec.temps):
        raise SpecError("temporaries of this type have no block form")
    if strategy == "windows" and not parallel:
        raise SpecError("windows serve parallel multistages only")
    halo = Extent()
    for e in spec.arg_extents().values():
        halo = halo.hull(e)
    if strategy == "windows" and halo.i == halo.j == (0, 0) and not vertical_reads(spec):
        tiled = fields.withColumn("own", F.lit(True))  # every point for itself: a projection, without an exchange
    else:
        tiled = deal(fields, grid, halo, tile, by_level=strategy == "windows" and not vertical_reads(spec))
    if sparse:
        out = _gathers(spec, grid, tiled)
    elif strategy == "columns":
        out = run_columns(spec, grid, _with_temps(spec, tiled), _window_stage, _shifted)
    else:
        out = _windows(spec, grid, tiled) if strategy == "windows" else _blocks(spec, grid, tiled)
    return out.where("own").select(*fields.columns)


def run_single_stage(op: Operator, grid: Grid, fields: DataFrame, **args: str) -> DataFrame:
    return run(execute_parallel().stage(op, **args), grid, fields)


def vertical_reads(spec: Spec) -> bool:
    return any(e.k != (0, 0) for s in spec.stages() for e in s.read_extents().values()) or any(s.indexed() for s in spec.stages())


def _check(spec: Spec, grid: Grid, fields: DataFrame) -> None:
    low_i, high_i, low_j, high_j, low_k, high_k, rows = fields.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j"), F.min("k"), F.max("k"), F.count("*")).first()
    if not rows or rows != (high_i - low_i + 1) * (high_j - low_j + 1) * (high_k - low_k + 1):
        raise SpecError("the fields' table has holes or repeats points")
    for name, e in spec.arg_extents().items():
        if name not in spec.temps and (grid.i0 + e.i[0] < low_i or grid.i0 + grid.ni - 1 + e.i[1] > high_i or grid.j0 + e.j[0] < low_j or grid.j0 + grid.nj - 1 + e.j[1] > high_j):
            raise SpecError(f"{name} is read beyond its bounds")


def deal(fields: DataFrame, grid: Grid, halo: Extent, tile: tuple[int, int], by_level: bool) -> DataFrame:
    """Rows copied to every tile whose cells, widened by the halo, hold them; own marks the tile that keeps the row.

    A row outside all tiles' boxes belongs to the nearest tile.  Without a halo no row is copied.
    """

    def tiles(dim: str, start: int, n: int, size: int, reach: tuple[int, int]) -> tuple[Column, Column]:
        last = max((n - 1) // size, 0)
        place = F.col(dim).cast("int") - start
        at = lambda x: F.least(F.greatest(F.floor(x / size).cast("int"), F.lit(0)), F.lit(last))
        return at(place), F.sequence(at(place - reach[1]), at(place - reach[0]))

    own_i, all_i = tiles("i", grid.i0, grid.ni, tile[0], halo.i)
    own_j, all_j = tiles("j", grid.j0, grid.nj, tile[1], halo.j)
    out = fields
    out = out.withColumn("ti", F.explode(all_i) if halo.i != (0, 0) else own_i).withColumn("tj", F.explode(all_j) if halo.j != (0, 0) else own_j)
    out = out.withColumn("own", (F.col("ti") == own_i) & (F.col("tj") == own_j))
    return out.repartition("ti", "tj", "k") if by_level else out.repartition("ti", "tj")


_KEYS = ["ti", "tj"]


def _line(axis: int) -> WindowSpec:
    dim = "ijk"[axis]
    return Window.partitionBy(*_KEYS, *(d for d in "kij" if d != dim)).orderBy(dim)


def _with_temps(spec: Spec, tiled: DataFrame) -> DataFrame:
    new = {name: F.lit(None).cast(spec.kinds.get(name, "double")) for name in sorted(spec.temps & spec.fields())}
    return tiled.withColumns(new) if new else tiled


def _windows(spec: Spec, grid: Grid, tiled: DataFrame) -> DataFrame:
    """One layer of lag/lead columns for each stage; Spark keeps the exchange of deal() for all of them."""
    out = _with_temps(spec, tiled)
    singles = frozenset(f.name for f in out.schema if isinstance(f.dataType, T.FloatType))
    checked: set[str] = set()
    for s, extent in zip(spec.stages(), spec.compute_extents(), strict=True):
        out = _window_stage(out, s, extent, grid, singles, checked)
    return out


def _shifted(out: DataFrame, wanted: list[tuple[str, tuple[int, int, int]]], checked: set[str]) -> tuple[DataFrame, dict[tuple, str]]:
    """out with a column for each field at an offset, and their names; null beyond the table.

    A corner is a shift of a shift.  The first time that a dimension is read along, which `checked` remembers, each row's coordinate is held to that of
    the row next to it: a hole or a repeated point raises an error.
    """
    held: dict[tuple, str] = {}
    for axis in range(3):
        dim, line, layer = "ijk"[axis], _line(axis), {}
        for name, offset in wanted:
            part = offset[: axis + 1] + (0,) * (2 - axis)
            if offset[axis] and (name, part) not in held and (name, part) not in layer:
                before = part[:axis] + (0,) * (3 - axis)
                layer[name, part] = (held[name, before] if any(before) else name, offset[axis])
        if not layer:
            continue
        names = {key: f"__{axis}_{n}" for n, key in enumerate(layer)}
        found = {names[key]: F.lead(c, by).over(line) if by > 0 else F.lag(c, -by).over(line) for key, (c, by) in layer.items()}
        if dim in checked:
            out = out.withColumns(found)
        else:
            checked.add(dim)
            first = next(iter(names.values()))  # one of the layer's columns carries the check
            out = out.withColumns(found | {"__before": F.lag(dim, 1).over(line)})
            hole = F.raise_error(F.lit(f"the table has a hole or a repeated point along {dim}; run with sparse=True")).cast(out.schema[first].dataType)
            out = out.withColumn(first, F.when(F.coalesce(F.col("__before") != F.col(dim) - 1, F.lit(False)), hole).otherwise(F.col(first))).drop("__before")
        held |= names
    return out, held


def _window_stage(out: DataFrame, s: Stage, extent: Extent, grid: Grid, singles: frozenset[str], checked: set[str]) -> DataFrame:
    bodies = s.bodies()
    out, held = _shifted(out, sorted({r for _, b in bodies for e in b.values() for r in reads(e) if any(r[1])}), checked)
    wanted = s.indexed()
    if wanted:
        out, more = read_indexed(out, wanted, held, singles)
        held |= more
    return _written(out, bodies, extent, grid, singles, held)


def _gathers(spec: Spec, grid: Grid, tiled: DataFrame) -> DataFrame:
    """A stage at a time: reads at offsets come by sent_within, whose aggregate needs no exchange beside that of deal()."""
    out = _with_temps(spec, tiled)
    singles = frozenset(f.name for f in out.schema if isinstance(f.dataType, T.FloatType))
    for s, extent in zip(spec.stages(), spec.compute_extents(), strict=True):
        bodies = s.bodies()
        wanted: dict[tuple[int, int, int], set[str]] = {}
        for name, offset in {r for _, b in bodies for e in b.values() for r in reads(e) if any(r[1])}:
            wanted.setdefault(offset, set()).add(name)
        held = {}
        if wanted:
            out, held = sent_within(out, _KEYS, {o: sorted(names) for o, names in sorted(wanted.items())})
        out = _written(out, bodies, extent, grid, singles, held, missing=True)
    return out


def _written(out: DataFrame, bodies: list, extent: Extent, grid: Grid, singles: frozenset[str], held: dict[tuple, str], missing: bool = False) -> DataFrame:
    """out with a stage's writes, reads at offsets being the columns of held, which go."""
    inside = F.col("i").between(grid.i0 + extent.i[0], grid.i0 + grid.ni - 1 + extent.i[1]) & F.col("j").between(grid.j0 + extent.j[0], grid.j0 + grid.nj - 1 + extent.j[1])
    updates: dict[str, Column] = {}
    for interval, body in bodies:
        levels = grid.levels(interval) if interval else range(grid.nk)
        here = inside & F.col("k").between(levels.start, levels.stop - 1)
        for name, e in body.items():
            value = to_column(e, lambda f, o: F.col(held[f, o] if isinstance(o, str) or any(o) else f), singles, missing=missing)
            kind = out.schema[name].dataType
            value = value if isinstance(kind, (T.StructType, T.ArrayType)) else value.cast(kind)
            updates[name] = updates[name].when(here, value) if name in updates else F.when(here, value)
    return out.withColumns({name: u.otherwise(F.col(name)) for name, u in updates.items()}).drop(*held.values())


def numpy_plan(spec: Spec, grid: Grid) -> list:
    """For each multistage its order and its stages: compute extent, and levels and expressions of each interval."""
    extents = iter(spec.compute_extents())
    return [(m.order, [(next(extents), [(grid.levels(i) if i else range(grid.nk), b) for i, b in s.bodies()]) for s in m.stages]) for m in spec.multistages]


def run_plan(plan: list, spec: Spec, data: dict[str, np.ndarray], grid: Grid, lows: tuple, shape: tuple) -> None:
    """All multistages on the arrays of a tile whose first cell is at lows; temporaries are added to data."""
    for name in sorted(spec.temps & spec.fields()):
        kind = _NUMPY_KINDS[spec.kinds.get(name, "double")]
        data[name] = np.full(shape, np.nan if kind.kind == "f" else 0, kind)
    for order, stages in plan:
        _multistage(order, stages, data, grid, lows, shape)


def _blocks(spec: Spec, grid: Grid, tiled: DataFrame) -> DataFrame:
    """Numpy over whole tiles: every stage on its compute box, level by level where the order says so."""
    plan = numpy_plan(spec, grid)
    used = sorted(spec.fields() - spec.temps)
    written = sorted({f for s in spec.stages() for f in s.written()} - spec.temps)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in tiled.schema])

    def compute(table: pa.Table) -> pa.Table:
        i, j, k = (table[d].to_numpy().astype(np.int64) for d in "ijk")
        lows, highs = (i.min(), j.min(), k.min()), (i.max(), j.max(), k.max())
        shape = tuple(int(b - a + 1) for a, b in zip(lows, highs, strict=True))
        at = (i - lows[0], j - lows[1], k - lows[2])
        if len(i) != shape[0] * shape[1] * shape[2] or len(np.unique(np.ravel_multi_index(at, shape))) != len(i):
            raise ValueError("the table has a hole or a repeated point")
        data = {}
        for name in used:
            column = table[name].to_numpy()
            data[name] = np.full(shape, np.nan if column.dtype.kind == "f" else 0, column.dtype)
            data[name][at] = column
        run_plan(plan, spec, data, grid, lows, shape)
        for name in written:
            n = table.schema.get_field_index(name)
            table = table.set_column(n, table.schema.field(n), pa.chunked_array([pa.array(data[name][at]).cast(table.schema.field(n).type)]))
        return table

    return tiled.groupBy("ti", "tj").applyInArrow(compute, schema)


def _multistage(order: str, stages: list, data: dict, grid: Grid, lows: tuple, shape: tuple) -> None:
    def box(extent: Extent, used: set) -> tuple[slice, slice] | None:
        """The stage's cells within this tile and its halo: those whose reads it holds."""
        reach = Extent()
        for _, o in used:
            reach = reach.hull(Extent.at(*o))
        i0, i1 = max(grid.i0 + extent.i[0] - lows[0], -reach.i[0]), min(grid.i0 + grid.ni + extent.i[1] - lows[0], shape[0] - reach.i[1])
        j0, j1 = max(grid.j0 + extent.j[0] - lows[1], -reach.j[0]), min(grid.j0 + grid.nj + extent.j[1] - lows[1], shape[1] - reach.j[1])
        return (slice(int(i0), int(i1)), slice(int(j0), int(j1))) if i0 < i1 and j0 < j1 else None

    def apply(extent: Extent, body: dict, levels: slice) -> None:
        here = box(extent, set().union(*map(reads, body.values())) if body else set())
        if here is None:
            return

        def read(name: str, o: tuple[int, int, int]) -> np.ndarray:
            if isinstance(o[2], np.ndarray):
                column = data[name][here[0].start + o[0] : here[0].stop + o[0], here[1].start + o[1] : here[1].stop + o[1], :]
                at = np.broadcast_to(np.arange(levels.start, levels.stop) + np.where(np.isfinite(o[2]), o[2], -shape[2]).astype(np.int64), (*column.shape[:2], levels.stop - levels.start))
                found = np.take_along_axis(column, np.clip(at, 0, shape[2] - 1), axis=2)
                return np.where((at >= 0) & (at < shape[2]), found, np.nan)
            low, high = levels.start + o[2], levels.stop + o[2]
            a = data[name][here[0].start + o[0] : here[0].stop + o[0], here[1].start + o[1] : here[1].stop + o[1], max(low, 0) : max(min(high, shape[2]), 0)]
            if low < 0 or high > shape[2]:  # beyond the column there is nothing
                a = np.pad(a if a.dtype.kind == "f" else a.astype(np.float64), ((0, 0), (0, 0), (min(max(-low, 0), high - low), min(max(high - shape[2], 0), high - low))), constant_values=np.nan)
            return a

        def index(dim: str) -> np.ndarray:
            n = "ijk".index(dim)
            r = np.arange(*((here[0].start, here[0].stop), (here[1].start, here[1].stop), (levels.start, levels.stop))[n]) + lows[n]
            return r.reshape([-1 if d == n else 1 for d in range(3)])

        values = {name: to_numpy(e, read, index) for name, e in body.items()}
        for name, v in values.items():
            data[name][here[0], here[1], levels] = v

    if order == "parallel":
        for extent, bodies in stages:
            for levels, body in bodies:
                a, b = max(levels.start - lows[2], 0), min(levels.stop - lows[2], shape[2])
                if a < b:
                    apply(extent, body, slice(int(a), int(b)))
        return
    ks = range(grid.nk) if order == "forward" else range(grid.nk - 1, -1, -1)
    for level in ks:  # all stages at a level before the next: later stages' values can be read from levels that are done
        a = level - int(lows[2])
        if 0 <= a < shape[2]:
            for extent, bodies in stages:
                for levels, body in bodies:
                    if level in levels:
                        apply(extent, body, slice(a, a + 1))


def expandable_run(spec_of, factor: int, grid: Grid, fields: DataFrame, vectors: dict[str, list[str]], **options) -> DataFrame:
    """The same computation over lists of equally many fields; spec_of gets {name: field} of each place in turn.

    factor only says how many the reference would fuse; Spark plans all of them as one.
    """
    if len({len(v) for v in vectors.values()}) != 1:
        raise SpecError("the lists of fields must be equally long")
    if factor < 1:
        raise SpecError("the factor is at least 1")
    specs = [spec_of({name: v[n] for name, v in vectors.items()}) for n in range(len(next(iter(vectors.values()))))]
    specs = [s if isinstance(s, Spec) else Spec((s,)) for s in specs]
    renamed = Spec(tuple(m for s in specs for m in s.multistages), frozenset().union(*(s.temps for s in specs)), {t: k for s in specs for t, k in s.kinds.items()})
    return run(renamed, grid, fields, **options)


def steps(spec: Spec | MultiStage, grid: Grid, fields: DataFrame, swaps: dict[str, str], count: int, every: int = 10, **options) -> Iterator[DataFrame]:
    """State after each of count runs; after a run the columns named in swaps change places.

    Every `every` steps the state is written to the shared folder and read back, which cuts the plan.  For many steps of a large table see blocks: there
    only strips move between steps.
    """
    for n in range(1, count + 1):
        fields = run(spec, grid, fields, **options)
        names = {**swaps, **{b: a for a, b in swaps.items()}}
        fields = fields.select(*(F.col(names.get(c, c)).alias(c) for c in fields.columns))
        if n % every == 0:
            fields = written(fields)
        yield fields
