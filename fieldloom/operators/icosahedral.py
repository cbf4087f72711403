"""Icosahedral grids: rows (i, j, k, c) with c below 2 for cells, 3 for edges and 1 for vertices."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.gather import sent_within
from fieldloom.plans.grid import Extent

COLORS = {"cells": 2, "edges": 3, "vertices": 1}

#: From location and colour to location, neighbours (di, dj, colour) in the order that results depend on.
NEIGHBORS: dict[tuple[str, int, str], list[tuple[int, int, int]]] = {
    ("cells", 0, "cells"): [(-1, 0, 1), (0, 0, 1), (0, -1, 1)],
    ("cells", 0, "edges"): [(0, 0, 1), (0, 0, 2), (0, 0, 0)],
    ("cells", 0, "vertices"): [(1, 0, 0), (0, 0, 0), (0, 1, 0)],
    ("cells", 1, "cells"): [(1, 0, 0), (0, 0, 0), (0, 1, 0)],
    ("cells", 1, "edges"): [(1, 0, 1), (0, 0, 2), (0, 1, 0)],
    ("cells", 1, "vertices"): [(0, 1, 0), (1, 1, 0), (1, 0, 0)],
    ("edges", 0, "cells"): [(0, -1, 1), (0, 0, 0)],
    ("edges", 0, "edges"): [(0, -1, 2), (0, 0, 1), (0, 0, 2), (1, -1, 1)],
    ("edges", 0, "vertices"): [(1, 0, 0), (0, 0, 0)],
    ("edges", 1, "cells"): [(-1, 0, 1), (0, 0, 0)],
    ("edges", 1, "edges"): [(-1, 0, 2), (-1, 1, 0), (0, 0, 2), (0, 0, 0)],
    ("edges", 1, "vertices"): [(0, 0, 0), (0, 1, 0)],
    ("edges", 2, "cells"): [(0, 0, 1), (0, 0, 0)],
    ("edges", 2, "edges"): [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 1)],
    ("edges", 2, "vertices"): [(0, 1, 0), (1, 0, 0)],
    ("vertices", 0, "cells"): [(-1, -1, 1), (-1, 0, 0), (-1, 0, 1), (0, 0, 0), (0, -1, 1), (0, -1, 0)],
    ("vertices", 0, "edges"): [(0, -1, 1), (-1, 0, 0), (-1, 0, 2), (0, 0, 1), (0, 0, 0), (0, -1, 2)],
    ("vertices", 0, "vertices"): [(0, -1, 0), (-1, 0, 0), (-1, 1, 0), (0, 1, 0), (1, 0, 0), (1, -1, 0)],
}


def neighbors_extent(source: str, target: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """Hull of the offsets in i and j over all colours, the point itself included."""
    every = [o for (s, _, t), offsets in NEIGHBORS.items() if (s, t) == (source, target) for o in offsets]
    return tuple((min(0, *(o[d] for o in every)), max(0, *(o[d] for o in every))) for d in (0, 1))


def for_neighbors(points: DataFrame, source: str, target: str, field: DataFrame, values: list[str]) -> DataFrame:
    """points (i, j, k, c) with `neighbors`: their target neighbours' values as array<struct<n, values...>>, in order.

    The field's rows are sent to the points that see them (a fixed list for each colour, by explode), and one aggregate
    gathers them: no join with an offset table.  Neighbours beyond the field are left out.
    """
    seen = [(o, n, c) for (s, c, t), offsets in NEIGHBORS.items() if (s, t) == (source, target) for n, o in enumerate(offsets)]
    # a field row at (i, j, colour) is the n-th neighbour of (i - di, j - dj, c)
    routes = F.array(*(F.struct(F.lit(o[0]).alias("di"), F.lit(o[1]).alias("dj"), F.lit(o[2]).alias("from"), F.lit(n).alias("n"), F.lit(c).alias("to")) for o, n, c in seen))
    sent = field.select("i", "j", "k", "c", *values).withColumn("__r", F.explode(F.filter(routes, lambda r: r["from"] == F.col("c"))))
    sent = sent.select((F.col("i") - F.col("__r.di")).alias("i"), (F.col("j") - F.col("__r.dj")).alias("j"), "k", F.col("__r.to").alias("c"), F.struct(F.col("__r.n").alias("n"), *values).alias("__x"))
    lists = sent.groupBy("i", "j", "k", "c").agg(F.array_sort(F.collect_list("__x")).alias("neighbors"))
    return points.join(lists, ["i", "j", "k", "c"], "left")


def fold_neighbors(points: DataFrame, source: str, target: str, field: DataFrame, values: list[str], init: Column, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """points with step(acc, neighbour's struct) over the neighbours in order, from init."""
    seen = for_neighbors(points, source, target, field, values)
    none = F.expr("array()").cast(seen.schema["neighbors"].dataType)
    return seen.withColumn(name, F.aggregate(F.coalesce("neighbors", none), init, step)).drop("neighbors")


def divergence(cells: DataFrame, edges: DataFrame, flux: str = "u", length: str = "edge_length", reciprocal: str = "cell_area_reciprocal", name: str = "div") -> DataFrame:
    """Sum of flux times length over a cell's edges, outward for colour 0 and inward for colour 1, over its area."""
    out = fold_neighbors(cells, "cells", "edges", edges, [flux, length], F.lit(0.0), lambda a, x: a + x[flux] * x[length], name)
    sign = F.when(F.col("c") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return out.withColumn(name, sign * F.col(name) * F.col(reciprocal))


def curl(vertices: DataFrame, edges: DataFrame, flux: str = "u", length: str = "dual_edge_length", reciprocal: str = "dual_area_reciprocal", name: str = "curl") -> DataFrame:
    """Circulation around a vertex over its dual area; the signs alternate along its edges, from minus."""
    step = lambda a, x: a + F.when(x["n"] % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * x[flux] * x[length]
    out = fold_neighbors(vertices, "vertices", "edges", edges, [flux, length], F.lit(0.0), step, name)
    return out.withColumn(name, F.col(name) * F.col(reciprocal))


def laplacian(edges: DataFrame, div: DataFrame, curls: DataFrame, inverse_dual: str = "dual_edge_length_reciprocal", inverse_length: str = "edge_length_reciprocal", name: str = "lap") -> DataFrame:
    """Vector Laplacian on edges: the gradient of the divergence and the rotated gradient of the curl."""
    along = lambda a, x, v: a + F.when(x["n"] == 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * x[v]
    out = fold_neighbors(edges, "edges", "cells", div, ["div"], F.lit(0.0), lambda a, x: along(a, x, "div"), "__d")
    out = fold_neighbors(out, "edges", "vertices", curls, ["curl"], F.lit(0.0), lambda a, x: along(a, x, "curl"), "__c")
    return out.withColumn(name, F.col("__d") * F.col(inverse_dual) - F.col("__c") * F.col(inverse_length)).drop("__d", "__c")


# --- stages


class Near:
    """What a stage's body sees of a point of one colour: own columns, the colour, and folds over neighbours of a location, in order."""

    def __init__(self, location: str, color: int, near: Mapping[str, Column]):
        self.location, self.near = location, near
        self.color = F.lit(color)
        self._color = color

    def __call__(self, name: str) -> Column:
        return F.col(_wide(self.location, self._color, name))

    def fold(self, target: str, step: Callable[[Column, Column], Column], init: Column) -> Column:
        """step(acc, neighbour) with the neighbour's place n and the values that the stage reads there."""
        if target not in self.near:
            raise ValueError(f"the stage reads nothing on {target}")
        return F.aggregate(self.near[target], init, step)


def _wide(location: str, color: int, name: str) -> str:
    """The column of a location's field on one colour, in rows that hold all colours of a place."""
    return f"{location}__{color}__{name}"


@dataclass(frozen=True)
class Stage:
    """On all colours of a location: body(near) gives {column: new value}.  reads: for other points' locations, the values read there."""

    location: str
    body: Callable[[Near], Mapping[str, Column]]
    writes: tuple[str, ...]
    reads: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class IcosahedralSpec:
    """Stages in order; temps: {name: (location, type)} of fields that only live within a run."""

    stages: tuple[Stage, ...]
    temps: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def compute_extents(self) -> list[Extent]:
        """How far beyond the box each stage computes, so that later reads through neighbours find what it writes."""
        needed: dict[tuple[str, str], Extent] = {}
        out = []
        for s in reversed(self.stages):
            own = Extent()
            for name in s.writes:
                own = own.hull(needed.get((s.location, name), Extent()))
            out.append(own)
            for target, names in s.reads.items():
                reach = own.plus(Extent(*neighbors_extent(s.location, target)))
                for name in names:
                    needed[target, name] = needed.get((target, name), Extent()).hull(reach)
        return out[::-1]


def run(spec: IcosahedralSpec, box: tuple[tuple[int, int], tuple[int, int]], fields: Mapping[str, DataFrame], tile: tuple[int, int] = (64, 64)) -> dict[str, DataFrame]:
    """The locations' tables after all stages, without the temporaries.

    box: (first, last) of i and j.  Points outside a stage's box (widened by its extent) keep what they had; neighbours beyond a table are left
    out; the tables may have any holes, but no repeated points.

    All locations and colours of a place (i, j, k) become one row, dealt to tiles with the halo that the stages reach: one exchange by tile and level serves the
    packing and every stage, whose reads are aggregates within the tile (see gather.sent_within).
    """
    tables = dict(fields)
    for name, (location, kind) in spec.temps.items():
        if not any(name in s.writes and s.location == location for s in spec.stages):
            raise ValueError(f"temporary {name} is never written")
        tables[location] = tables[location].withColumn(name, F.lit(None).cast(kind))
    names = {location: [c for c in df.columns if c not in ("i", "j", "k", "c")] for location, df in tables.items()}
    extents = spec.compute_extents()
    reach = Extent()
    for s, extent in zip(spec.stages, extents, strict=True):
        for target, read in s.reads.items():
            if target not in names or not set(read) <= set(names[target]):
                raise ValueError(f"the stage reads {sorted(read)} on {target}, which has {names.get(target)}")
            reach = reach.hull(extent.plus(Extent(*neighbors_extent(s.location, target))))
    df = _packed(tables, names, reach, tile)
    kinds = {_wide(at, c, n): tables[at].schema[n].dataType for at in tables for c in range(COLORS[at]) for n in names[at]}
    for s, extent in zip(spec.stages, extents, strict=True):
        df = _stage(df, s, extent, box, names, kinds)
    df = df.where("own")
    out = {}
    for at, table in tables.items():
        left = [n for n in names[at] if spec.temps.get(n, ("",))[0] != at]
        colours = F.array(*(F.struct(F.lit(c).alias("c"), F.col(_wide(at, c, "")).alias("there"), *(F.col(_wide(at, c, n)).alias(n) for n in left)) for c in range(COLORS[at])))
        rows = df.select("i", "j", "k", F.explode(colours).alias("x")).where("x.there")
        places = {d: F.col(d).cast(table.schema[d].dataType).alias(d) for d in "ijk"} | {"c": F.col("x.c").cast(table.schema["c"].dataType).alias("c")}
        out[at] = rows.select(*(places[c] if c in places else F.col(f"x.`{c}`").alias(c) for c in table.columns if c in places or c in left))
    return out


def _packed(tables: Mapping[str, DataFrame], names: Mapping[str, list[str]], reach: Extent, tile: tuple[int, int]) -> DataFrame:
    """One row for each place of each tile that needs it: a column for each location's field and colour, and one that tells if the point is there."""
    union = None
    for at, table in tables.items():
        rows = table.select(*(F.col(d).cast("int").alias(d) for d in "ijk"), F.lit(at).alias("__at"), F.col("c").cast("int").alias("__c"), *(F.col(f"`{n}`").alias(f"{at}__{n}") for n in names[at]))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    tiles = lambda d, n, ends: F.sequence(F.floor((F.col(d) - ends[1]) / n).cast("int"), F.floor((F.col(d) - ends[0]) / n).cast("int"))
    dealt = union.withColumn("ti", F.explode(tiles("i", tile[0], reach.i))).withColumn("tj", F.explode(tiles("j", tile[1], reach.j))).repartition("ti", "tj", "k")
    cells = []
    for at in tables:
        for c in range(COLORS[at]):
            here = (F.col("__at") == at) & (F.col("__c") == c)
            cells.append(F.coalesce(F.bool_or(here), F.lit(False)).alias(_wide(at, c, "")))
            cells += [F.first(F.when(here, F.col(f"{at}__{n}")), ignorenulls=True).alias(_wide(at, c, n)) for n in names[at]]
    own = (F.col("ti") == F.floor(F.col("i") / tile[0])) & (F.col("tj") == F.floor(F.col("j") / tile[1]))
    return dealt.groupBy("ti", "tj", "k", "i", "j").agg(*cells).withColumn("own", own)


def _stage(df: DataFrame, s: Stage, extent: Extent, box: tuple, names: Mapping[str, list[str]], kinds: Mapping[str, object]) -> DataFrame:
    seen = {(c, target): NEIGHBORS[s.location, c, target] for c in range(COLORS[s.location]) for target in s.reads}
    wanted: dict[tuple[int, int, int], set[str]] = {}
    for (_, target), offsets in seen.items():
        for di, dj, c in offsets:
            if di or dj:
                wanted.setdefault((di, dj, 0), set()).update(_wide(target, c, n) for n in ("", *s.reads[target]))
    plain = df.columns
    held: dict[tuple, str] = {}
    if wanted:
        df, held = sent_within(df, ["ti", "tj"], {o: sorted(cols) for o, cols in sorted(wanted.items())})
    at = lambda di, dj, name: F.col(held[name, (di, dj, 0)] if di or dj else name)
    (i0, i1), (j0, j1) = box
    inside = F.col("i").between(i0 + extent.i[0], i1 + extent.i[1]) & F.col("j").between(j0 + extent.j[0], j1 + extent.j[1])
    updates = {}
    for c in range(COLORS[s.location]):
        near = {}
        for target, read in s.reads.items():
            points = [F.when(at(di, dj, _wide(target, to, "")), F.struct(F.lit(n).alias("n"), *(at(di, dj, _wide(target, to, v)).alias(v) for v in read))) for n, (di, dj, to) in enumerate(seen[c, target])]
            near[target] = F.array_compact(F.array(*points))
        found = s.body(Near(s.location, c, near))
        if set(found) != set(s.writes) or not set(found) <= set(names[s.location]):
            raise ValueError(f"the stage writes {sorted(found)}, not {sorted(s.writes)} of its location's columns")
        for n, v in found.items():
            name = _wide(s.location, c, n)
            updates[name] = F.when(inside & F.col(_wide(s.location, c, "")), v.cast(kinds[name])).otherwise(F.col(name))
    return df.withColumns(updates).select(*plain)


def expandable_run(spec_of: Callable[[Mapping[str, str]], IcosahedralSpec], box: tuple[tuple[int, int], tuple[int, int]], fields: Mapping[str, DataFrame], vectors: Mapping[str, list[str]], **options) -> dict[str, DataFrame]:
    """The same stages over lists of equally many fields or temporaries; spec_of gets {name: field} of each place in turn.  One exchange serves all."""
    if len({len(v) for v in vectors.values()}) != 1:
        raise ValueError("the lists of fields must be equally long")
    specs = [spec_of({name: v[n] for name, v in vectors.items()}) for n in range(len(next(iter(vectors.values()))))]
    return run(IcosahedralSpec(tuple(s for spec in specs for s in spec.stages), {t: kind for spec in specs for t, kind in spec.temps.items()}), box, fields, **options)
