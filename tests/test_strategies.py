"""Folds of packed columns, tables that lack points, persistent blocks, icosahedral stages: against plain loops and each other, and their plans."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import halo, icosahedral, kernels, stencil
from fieldloom.operators.blocks import Blocks, Layout
from fieldloom.operators.icosahedral import COLORS, NEIGHBORS, IcosahedralSpec, Stage
from fieldloom.operators.ordered import has_column_form
from fieldloom.plans.expr import where
from fieldloom.plans.grid import Axis, Halo, make_grid
from fieldloom.plans.spec import Operator, SpecError, execute_backward, execute_forward, execute_parallel, in_, inout, multi_pass
from fieldloom.sources.fields import dense

N, NK = 9, 70  # more levels than a chunk of results holds


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"(?<!Reused)Exchange hash", plan_of(df)))


@pytest.fixture(scope="module")
def fields(spark):
    df = dense(spark, {"i": N, "j": N, "k": NK}).withColumns({"a": F.sin(F.col("i") * 3 + F.col("j") * 5 + F.col("k")), "b": F.cos(F.col("k") * 2 + F.col("i")), "x": F.lit(0.0), "y": F.lit(0.5), "z": F.lit(-1.0)}).cache()
    return df


def ordered_spec(order):
    """Rings of two and three, reads ahead of a written field, horizontal reads of inputs, intervals, stages that read each other, coordinates."""
    axis = Axis(20, NK - 20)
    top, low = axis.interval(1), axis.interval(0)
    back = -1 if order == "forward" else 1
    both = (-3, 3)
    first = Operator(
        {low: lambda a, x: {"x": a(i=1, j=-1, k=1) + where(x(k=2 * back) > 0.25, x(k=back) * 0.5, 0.125)}, top: lambda a, x: {"x": a(k=-2) - 0.5 * x(k=3 * back)}},
        a=in_((-1, 1), (-1, 1), both), x=inout(k=both),
    )
    second = Operator({low: lambda b, x, y: {"y": x() * b(i=-1) + y(k=-back)}, top: lambda b, x, y: {"y": y(k=back) * 0.25 + x(k=back)}}, b=in_((-1, 0)), x=in_(k=both), y=inout(k=both))
    execute = execute_forward() if order == "forward" else execute_backward()
    return execute.stage(first, a="a", x="x").stage(second, b="b", x="x", y="y"), make_grid(Halo(1, 1, 1, N - 2, N), Halo(1, 1, 1, N - 2, N), axis)


def plain(order, grid, rows):
    """The same by loops; None where a read finds nothing."""
    spec, _ = ordered_spec(order)
    data = {f: {(r.i, r.j, r.k): r[f] for r in rows} for f in ("a", "b", "x", "y")}
    box = list(itertools.product(range(1, N - 1), range(1, N - 1)))
    for k in range(NK) if order == "forward" else range(NK - 1, -1, -1):
        s = -1 if order == "forward" else 1
        at = lambda f, i, j, k: data[f].get((i, j, k))
        for stage in (0, 1):
            new = {}
            for i, j in box:
                if stage == 0:
                    if k < 20:
                        a, x2, x1 = at("a", i + 1, j - 1, k + 1), at("x", i, j, k + 2 * s), at("x", i, j, k + s)
                        new["x", i, j] = None if a is None else a + (x1 * 0.5 if x2 is not None and x2 > 0.25 else 0.125)
                    else:
                        a, x = at("a", i, j, k - 2), at("x", i, j, k + 3 * s)
                        new["x", i, j] = None if x is None or a is None else a - 0.5 * x
                elif k < 20:
                    x, y = at("x", i, j, k), at("y", i, j, k - s)
                    new["y", i, j] = None if x is None or y is None else x * at("b", i - 1, j, k) + y
                else:
                    y, x = at("y", i, j, k + s), at("x", i, j, k + s)
                    new["y", i, j] = None if x is None or y is None else y * 0.25 + x
            for (f, i, j), v in new.items():
                data[f][i, j, k] = v
    return data


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_columns_equal_loops(spark, fields, order):
    spec, grid = ordered_spec(order)
    ran = stencil.run(spec, grid, fields, strategy="columns", tile=(4, 5))
    assert exchanges(ran) == 1 and not re.search("Python|Arrow|Pandas", plan_of(ran))
    want = plain(order, grid, fields.collect())
    for r in ran.collect():
        assert (r.x, r.y) == (want["x"][r.i, r.j, r.k], want["y"][r.i, r.j, r.k]), (r.i, r.j, r.k)


def test_columns_equal_blocks_bit_by_bit(fields):
    grid = make_grid(Halo(1, 1, 1, N - 2, N), Halo(1, 1, 1, N - 2, N), NK)
    df = fields.withColumns({"inf": F.lit(-1.0), "diag": 3.0 + F.col("b"), "sup": F.lit(0.75), "w": F.col("b") * 0.01, "tens": F.lit(0.1), "x32": F.lit(0).cast("float"), "a32": F.col("a").cast("float")})
    single = execute_forward().stage(Operator({make_grid(1, 1, NK).axis.full().modify(1, 0): lambda a, x: {"x": x(k=-1) * 0.7 + a() / 3.0}}, a=in_(), x=inout(k=(-1, 0))), a="a32", x="x32")
    for spec, out in ((kernels.tridiagonal(grid, rhs="a", out="z"), "z"), (kernels.vertical_advection(grid, u_stage="a", wcon="w", u_pos="b", utens="tens", utens_stage="tens", out="z"), "z"), (single, "x32")):
        got = {s: sorted(map(tuple, stencil.run(spec, grid, df, strategy=s, tile=(5, 4)).select("i", "j", "k", out).collect())) for s in ("blocks", "columns")}
        assert got["blocks"] == got["columns"]


def test_specs_without_a_column_form(fields):
    first = Operator(lambda a, x: {"x": a()}, a=in_(), x=inout())
    second = Operator(lambda x, y: {"y": x(i=1)}, x=in_((0, 1)), y=inout())
    spec = multi_pass(execute_forward().stage(first, a="a", x="t").stage(second, x="t", y="y"), temps=("t",))
    grid = make_grid(Halo(0, 1, 0, N - 2, N), N, NK)
    assert not has_column_form(spec)
    with pytest.raises(SpecError):
        stencil.run(spec, grid, fields, strategy="columns")
    assert stencil.run(spec, grid, fields).count() == N * N * NK


@pytest.mark.parametrize("strategy", ["windows", "blocks"])
@pytest.mark.parametrize("wrong", ["hole", "repeat"])
def test_holes_raise(spark, strategy, wrong):
    df = dense(spark, {"i": 6, "j": 6, "k": 2}).withColumns({"v": F.col("i") * F.col("i") * 1.0, "out": F.lit(0.0)})
    df = df.where("not (i = 2 and j = 2 and k = 1)") if wrong == "hole" else df.union(df.where("i = 2 and j = 2 and k = 1"))
    h = Halo(1, 1, 1, 4, 6)
    with pytest.raises(Exception, match="hole or a repeated point"):
        stencil.run(execute_parallel().stage(kernels.laplacian, inp="v", out="out"), make_grid(h, h, 2), df, strategy=strategy).collect()


@pytest.mark.parametrize("vertical", [False, True])
def test_sparse_stencils_equal_loops(spark, vertical):
    """Two stages with corner reads on a random half of a lattice: null where anything that is read is missing."""
    rnd = random.Random(2)
    points = {(i, j, k): float(rnd.randrange(100)) for i in range(-3, 12) for j in range(8) for k in range(4) if rnd.random() < 0.6}
    up = 1 if vertical else 0
    first = Operator(lambda v, t: {"t": v(i=-1, j=1, k=up) + v()}, v=in_((-1, 0), (0, 1), (0, up)), t=inout())
    second = Operator(lambda v, t, out: {"out": where(t(i=1) > t(j=-1), t(i=1), v())}, v=in_(), t=in_((0, 1), (-1, 0)), out=inout())
    df = spark.createDataFrame([(*p, v, -1.0) for p, v in points.items()], "i int, j int, k int, v double, out double")
    spec = multi_pass(execute_parallel().stage(first, v="v", t="t").stage(second, v="v", t="t", out="out"), temps=("t",))
    ran = stencil.run(spec, make_grid(9, 8, Axis(4)), df, tile=(4, 3), sparse=True)
    assert exchanges(ran) == 1
    t = {p: None if (q := points.get((p[0] - 1, p[1] + 1, p[2] + up))) is None else q + v for p, v in points.items()}
    want = {}
    for (i, j, k), v in points.items():
        a, b = t.get((i + 1, j, k)), t.get((i, j - 1, k))
        inside = 0 <= i < 9
        want[i, j, k] = -1.0 if not inside else None if a is None or b is None else a if a > b else v
    assert {(r.i, r.j, r.k): r.out for r in ran.collect()} == want


def test_blocks_equal_one_undivided_run(spark):
    """20 steps; a step's plan has one exchange, of strips alone, and does not grow."""
    n = 12
    df = dense(spark, {"i": n, "j": n, "k": 3}).withColumns({"value": F.sin(F.col("i") * 2 + F.col("j")) * 50 + F.col("k"), "coeff": F.lit(0.025), "out": F.sin(F.col("i") * 2 + F.col("j")) * 50 + F.col("k")})
    h = Halo(2, 2, 2, n - 3, n)
    grid, spec, swaps = make_grid(h, h, 3), kernels.horizontal_diffusion(), {"value": "out"}
    layout = Layout((4, 6, 3), (3, 2, 1), ((2, 2), (2, 2), (0, 0)))
    start = Blocks.of(df, layout, ("value",))
    end = start.march(spec, grid, 20, swaps)
    *_, want = stencil.steps(spec, grid, df, swaps, 20, every=4)
    assert sorted(map(tuple, end.rows().select("i", "j", "k", "value", "coeff").collect())) == sorted(map(tuple, want.select("i", "j", "k", "value", "coeff").collect()))
    one, last = plan_of(start.plan(spec, grid, swaps)), plan_of(end.plan(spec, grid, swaps))
    assert len(re.sub(r"#\d+|plan_id=\d+", "", one)) == len(re.sub(r"#\d+|plan_id=\d+", "", last)) and len(re.findall("Exchange hash", one)) == 1
    moved = one[one.index("Exchange hash") :]
    assert "ReadSchema: struct<strips:" in moved and "coeff" not in moved
    sent = end.table.read().select(F.explode("strips").alias("s")).agg(F.sum(F.size("s.value"))).first()[0]
    assert sent <= layout.strip_cells() * 6
    with pytest.raises(SpecError):
        start.step(execute_parallel().stage(kernels.laplacian, inp="out", out="value"), grid)
    end.drop()


@pytest.mark.parametrize("periodic", [(True, False, True), (False, False, False), (True, True, True)])
def test_exchange_of_blocks_equals_neighbours(spark, periodic):
    """All 26 sides, uneven halos, blocks along k too: a halo cell has its lattice place's value, or keeps NaN beyond the edge."""
    sizes, counts, halos = (3, 2, 2), (2, 3, 2), ((1, 2), (2, 0), (1, 1))
    total = [s * c for s, c in zip(sizes, counts, strict=True)]
    df = dense(spark, dict(zip("ijk", total, strict=True))).withColumn("v", (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).cast("double"))
    layout = Layout(sizes, counts, halos, periodic)
    got = Blocks.of(df, layout, ("v",)).step()
    for r in got.table.read().collect():
        array, lows = np.array(r.v).reshape(layout.shape), layout.lows(r.block)
        for at in np.ndindex(*layout.shape):
            g = [low + a for low, a in zip(lows, at, strict=True)]
            if all(0 <= x < n or p for x, n, p in zip(g, total, periodic, strict=True)):
                g = [x % n for x, n in zip(g, total, strict=True)]
                assert array[at] == g[0] * 100 + g[1] * 10 + g[2]
            else:
                assert np.isnan(array[at])


def test_blocks_of_a_table_with_holes(spark):
    df = dense(spark, {"i": 4, "j": 4, "k": 1}).withColumn("v", F.lit(1.0)).where("not (i = 1 and j = 3)")
    with pytest.raises(Exception, match="hole or a repeated point"):
        Blocks.of(df, Layout((2, 2, 1), (2, 2, 1), ((1, 1), (1, 1), (0, 0))), ("v",))


def test_exchanges_in_a_row_read_the_table_once(spark):
    df = halo.decompose(dense(spark, {"i": 4, "j": 4, "k": 1}).withColumn("v", F.col("i") * 1.0), (2, 2, 1), ((1, 1), (1, 1), (0, 0)), (2, 2, 1))
    h, z = Halo(1, 1, 1, 2, 4), Halo(0, 0, 0, 0, 1)
    scans = []
    for _ in range(4):
        df = halo.exchange(df, ["v"], (h, h, z), (2, 2, 1), (True, True, False))
        scans.append(plan_of(df).count("Range"))
    assert len(set(scans)) == 1 and df.where("v is null").count() == 0


def corners(at: str, c: int) -> set[tuple[int, int]]:
    """Vertices of a point at (0, 0) of the triangulation: a square's two triangles, and its sides along j, along i and across."""
    return {("vertices", 0): {(0, 0)}, ("cells", 0): {(0, 0), (1, 0), (0, 1)}, ("cells", 1): {(1, 0), (0, 1), (1, 1)}, ("edges", 0): {(0, 0), (1, 0)}, ("edges", 1): {(0, 0), (0, 1)}, ("edges", 2): {(1, 0), (0, 1)}}[at, c]


def test_neighbour_table_is_the_triangulation():
    """Neighbours follow from shared vertices: of vertices by a shared edge, of cells by a shared edge, of edges by a shared cell."""
    def moved(at, c, di, dj):
        return frozenset((x + di, y + dj) for x, y in corners(at, c))

    around = list(itertools.product(range(-2, 3), range(-2, 3)))
    every = {at: {(di, dj, c): moved(at, c, di, dj) for di, dj in around for c in range(n)} for at, n in COLORS.items()}
    for (source, c, target), offsets in NEIGHBORS.items():
        own = frozenset(corners(source, c))
        if source == target == "vertices":
            found = {o for o, v in every[target].items() if any(e == own | v for e in every["edges"].values()) and v != own}
        elif source == target:
            found = {o for o, v in every[target].items() if v != own and (len(v & own) == 2 if source == "cells" else any(v | own <= t for t in every["cells"].values()))}
        else:
            found = {o for o, v in every[target].items() if v <= own or own <= v}
        assert set(offsets) == found and len(offsets) == len(found), (source, c, target)


def test_icosahedral_chain_on_tables_with_holes(spark):
    """Eight stages in one exchange, on tables that lack points, against loops."""
    rnd = random.Random(9)
    values = {at: {(i, j, 0, c): float(rnd.randrange(50)) for i in range(7) for j in range(6) for c in range(n) if rnd.random() < 0.8} for at, n in COLORS.items()}
    tables = {at: spark.createDataFrame([(*p, v, "kept", 0.0) for p, v in values[at].items()], "i int, j int, k int, c int, u double, other string, out double") for at in COLORS}
    chain = [("edges", "cells"), ("vertices", "edges"), ("cells", "vertices"), ("cells", "cells"), ("edges", "cells"), ("edges", "edges"), ("vertices", "edges"), ("cells", "vertices")]
    names = [("cells", "u"), *((at, f"t{n}") for n, (at, _) in enumerate(chain[:-1])), ("cells", "out")]
    stages, temps = [], {}
    for n, (at, target) in enumerate(chain):
        read, to = names[n][1], names[n + 1][1]
        stages.append(Stage(at, lambda p, target=target, read=read, to=to: {to: p.fold(target, lambda a, x: a * 0.5 + x[read] * (x["n"] + 1), F.lit(0.0)) + p.color}, (to,), {target: (read,)}))
        if n < len(chain) - 1:
            temps[to] = (at, "double")
    spec = IcosahedralSpec(tuple(stages), temps)
    ran = icosahedral.run(spec, ((2, 4), (1, 4)), tables, tile=(3, 2))["cells"]
    assert exchanges(ran) == 1 and set(ran.columns) == set(tables["cells"].columns)
    held = dict(values["cells"])
    extents = spec.compute_extents()
    for (at, target), e in zip(chain, extents, strict=True):
        new = {}
        for i, j, k, c in values[at]:
            acc = None
            if 2 + e.i[0] <= i <= 4 + e.i[1] and 1 + e.j[0] <= j <= 4 + e.j[1]:
                acc = 0.0
                for n, (di, dj, to) in enumerate(NEIGHBORS[at, c, target]):
                    if (p := (i + di, j + dj, k, to)) in values[target]:
                        acc = None if acc is None or held.get(p) is None else acc * 0.5 + held[p] * (n + 1)
                acc = None if acc is None else acc + c
            new[i, j, k, c] = acc
        held = new
    got = {(r.i, r.j, r.k, r.c): r for r in ran.collect()}
    assert set(got) == set(values["cells"]) and all(r.other == "kept" and r.u == values["cells"][p] for p, r in got.items())
    for p, r in got.items():
        assert r.out == (held[p] if 2 <= p[0] <= 4 and 1 <= p[1] <= 4 else 0.0)
    with pytest.raises(ValueError, match="reads"):
        icosahedral.run(IcosahedralSpec((Stage("cells", lambda p: {"out": p("u")}, ("out",), {"edges": ("nothing",)}),)), ((0, 1), (0, 1)), tables)


def test_indexed_reads_equal_loops(spark):
    """By windows, columns and blocks, forward too; null and far offsets find nothing; holes raise."""
    rnd = random.Random(8)
    n, nk = 5, 9
    v = {(i, j, k): rnd.uniform(-5, 5) for i in range(n) for j in range(n) for k in range(nk)}
    by = {p: rnd.choice([None, -20.0, -2.0, -1.0, 0.0, 1.0, 3.0, 2.75, 40.0]) for p in v}
    df = spark.createDataFrame([(*p, v[p], by[p], 0.0) for p in v], "i int, j int, k int, v double, by double, out double")
    h = Halo(1, 0, 1, n - 1, n)
    grid = make_grid(h, n, nk)
    own = Operator(lambda v, by, out: {"out": where(by(i=-1) > 0.5, v(i=-1, k=by()), v.at(i=-1)(k=by(i=-1)) + v())}, v=in_((-1, 0)), by=in_((-1, 0)), out=inout())
    want = {}
    for (i, j, k), x in v.items():
        if i < 1:
            want[i, j, k] = 0.0
            continue
        other, mine = by[i - 1, j, k], by[i, j, k]
        found = lambda b, i=i, j=j, k=k: None if b is None else v.get((i - 1, j, k + int(b)))
        a = found(mine) if other is not None and other > 0.5 else found(other)
        want[i, j, k] = a if other is not None and other > 0.5 else None if a is None else a + x
    for spec, strategies in ((execute_parallel(), ("windows", "blocks")), (execute_forward(), ("columns", "blocks"))):
        for s in strategies:
            ran = stencil.run(spec.stage(own, v="v", by="by", out="out"), grid, df, strategy=s, tile=(2, 3))
            if s != "blocks":
                assert exchanges(ran) == 1
            got = {(r.i, r.j, r.k): None if r.out is None or r.out != r.out else r.out for r in ran.collect()}
            assert got == want, s
    with pytest.raises(Exception, match="hole"):
        stencil.run(execute_parallel().stage(own, v="v", by="by", out="out"), grid, df.where("not (i = 3 and j = 3 and k = 4)")).collect()
    with pytest.raises(SpecError):
        stencil.run(execute_parallel().stage(own, v="v", by="by", out="out"), grid, df, sparse=True)
