import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import fn, icosahedral, kernels, mesh, reduction, stencil
from fieldloom.operators.fn import can_deref, deref, shift
from fieldloom.plans.expr import where
from fieldloom.plans.grid import Extent, Halo, make_grid
from fieldloom.sources import fields as src


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _dense(spark, ni=6, nj=5, nk=3):
    a = np.random.default_rng(1).normal(size=(ni, nj, nk))
    return a, src.from_numpy(spark, a)


# --- columns


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("size", [1, 63, 64, 65, 200])
def test_long_columns(spark, size, backward):
    """Beyond a chunk of levels too, in either order."""
    a = np.random.default_rng(size).integers(0, 9, size=(3, size)).astype(float)
    df = src.from_numpy(spark, a, ("i", "k"), "v")
    out = mesh.column_stage(df, ["i"], "k", ["v"], F.lit(5.0), mesh.Scan(lambda s, x: s + x["v"], lambda s: 2 * s), "double", "out", backward=backward)
    got = src.to_numpy(out, ("i", "k"), "out")
    sums = np.cumsum(a[:, ::-1] if backward else a, axis=1) + 5
    assert np.array_equal(got, 2 * (sums[:, ::-1] if backward else sums))
    assert np.array_equal(np.unique([r.out_last for r in out.collect()]), np.unique(a.sum(axis=1) + 5))


def test_first_and_last_levels_across_chunks(spark):
    df = spark.range(130).select(F.lit(0).alias("i"), F.col("id").cast("int").alias("k"), F.lit(1.0).alias("v"), F.lit(-1.0).alias("out"))
    add = lambda n: mesh.Scan(lambda s, x: s + n * x["v"])
    fold = mesh.Fold(lambda s, x: s + x["v"])
    stage = mesh.ColumnStage(fold, "out", F.lit(0.0), prologue=(add(10), add(100)), epilogue=(add(1000),))
    got = [r.out for r in mesh.merged_columns(df, ["i"], "k", ["v", "out"], [stage]).orderBy("k").collect()]
    assert got == [10.0, 110.0] + [-1.0] * 127 + [110.0 + 127 + 1000]  # a fold leaves the old values
    with pytest.raises(Exception, match="shorter"):
        mesh.merged_columns(df.where("k < 2"), ["i"], "k", ["v", "out"], [stage]).collect()


def test_stages_of_a_column_share_an_exchange(spark):
    df = src.dense(spark, {"i": 4, "k": 7}).withColumn("v", F.col("k") + F.col("i") * 1.0)
    up = mesh.ColumnStage(mesh.Scan(lambda s, x: s + x["v"]), "up", F.lit(0.0))
    down = mesh.ColumnStage(mesh.Scan(lambda s, x: s + x["up"]), "down", backward=True)
    out = mesh.merged_columns(df, ["i"], "k", ["v"], [up, down], "last")
    assert len(re.findall(r"\bExchange\b", _plan(out))) == 1
    a = src.to_numpy(df, ("i", "k"), "v")
    sums = a.cumsum(axis=1)
    expected = (sums[:, ::-1].cumsum(axis=1) + sums[:, -1:])[:, ::-1]
    assert np.array_equal(src.to_numpy(out, ("i", "k"), "down"), expected)
    with pytest.raises(ValueError, match="seed"):
        mesh.merged_columns(df, ["i"], "k", ["v"], [down])


# --- iterators


def test_iterators(spark):
    it = fn.Iterator("a")
    assert shift(it, "i", 1, "k", -2, "i", 2) == fn.Iterator("a", (), (3, 0, -2))
    assert shift(it, "v2e", 1, "e2v", 0, "k", 1) == fn.Iterator("a", (("v2e", 1), ("e2v", 0)), (0, 0, 1))
    with pytest.raises(ValueError):
        shift(it, "i")


def test_cartesian_assignments(spark):
    """Domains of their own, new and old columns, groups that share an exchange and such that cannot."""
    a, df = _dense(spark)
    inner = mesh.cartesian_domain({"i": 4, "j": 3, "k": 3}, {"i": 1, "j": 1})
    lap = lambda v: sum((deref(shift(v, d, s)) for d in "ij" for s in (-1, 1)), 0.0) - 4 * deref(v)
    ran = fn.CartesianExecutor(inner, df).assign("lap", lap, "value").assign(("x", "y"), lambda v, w: (deref(v) + deref(w), deref(v) - deref(w)), "value", "lap").execute()
    assert len(re.findall(r"\bExchange\b", _plan(ran))) == 1
    want = np.zeros_like(a)
    want[1:-1, 1:-1] = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    rows = {(r.i, r.j, r.k): r for r in ran.collect()}
    for (i, j, k), r in rows.items():
        if 1 <= i <= 4 and 1 <= j <= 3:
            assert abs(r.lap - want[i, j, k]) < 1e-12 and r.x == r.value + r.lap and r.y == r.value - r.lap
        else:
            assert r.lap is None and r.x is None
    # written after it was read at an offset: a run of its own, which sees the old values first
    twice = fn.CartesianExecutor(inner, df).assign("o", lambda v: deref(shift(v, "i", 1)), "value").assign("value", lambda o: 2 * deref(o), "o").execute()
    for r in twice.collect():
        if 1 <= r.i <= 4 and 1 <= r.j <= 3:
            assert r.o == a[r.i + 1, r.j, r.k] and r.value == 2 * r.o
        else:
            assert r.value == a[r.i, r.j, r.k]
    levels = mesh.cartesian_domain({"i": 6, "j": 5, "k": 1}, {"k": 1})
    some = fn.CartesianExecutor(levels, df).assign("o", lambda v: deref(shift(v, "k", 1)), "value").execute()
    assert all(r.o == (a[r.i, r.j, 2] if r.k == 1 else None) for r in some.collect())
    none = mesh.cartesian_domain({"i": 0, "j": 5, "k": 3})
    assert all(r.o is None for r in fn.CartesianExecutor(none, df).assign("o", deref, "value").execute().collect())
    with pytest.raises(ValueError, match="results"):
        fn.CartesianExecutor(inner, df).assign(("o", "p"), deref, "value").execute()
    with pytest.raises(ValueError, match="MeshExecutor"):
        fn.CartesianExecutor(inner, df).assign("o", lambda v: deref(shift(v, "v2e", 0)), "value").execute()


def test_mesh_assignments(spark):
    """Against loops over a random mesh with missing neighbours at both hops, and a step along the levels."""
    rng = np.random.default_rng(3)
    p2q, q2p = rng.integers(-1, 8, size=(10, 3)), rng.integers(-1, 10, size=(8, 2))
    table = lambda a: spark.createDataFrame([(i, n, int(x)) for i, row in enumerate(a) for n, x in enumerate(row)], "index int, n int, neighbor int")
    u, w = rng.integers(0, 99, size=(10, 2)).astype(float), rng.integers(0, 99, size=8).astype(float)
    fields = {"p": src.from_numpy(spark, u, ("p", "k"), "u"), "q": src.from_numpy(spark, w, ("q",), "w")}
    domain = mesh.unstructured_domain({"p": 9, "k": 2}, p2q=table(p2q), q2p=table(q2p))

    def own(u, w):
        return (
            where(can_deref(shift(w, "p2q", 2)), deref(shift(w, "p2q", 2)), -1.0),
            where(can_deref(shift(u, "p2q", 1, "q2p", 0)), deref(shift(u, "p2q", 1, "q2p", 0)), -2.0),
            deref(shift(u, "k", 1)),
        )

    out = fn.MeshExecutor(domain, "p", fields).assign(("a", "b", "c"), own, "u", "w").assign("a", lambda a: 2 * deref(a), "a").execute()
    assert out.count() == 20
    for r in out.collect():
        if r.p == 9:
            assert r.a is None and r.b is None and r.c is None
            continue
        q = p2q[r.p, 2]
        assert r.a == 2 * (w[q] if q >= 0 else -1.0)
        q = p2q[r.p, 1]
        back = q2p[q, 0] if q >= 0 else -1
        assert r.b == (u[back, r.k] if back >= 0 else -2.0)
        assert r.c == (u[r.p, 1] if r.k == 0 else None)
    with pytest.raises(ValueError, match="no connectivity"):
        fn.MeshExecutor(domain, "p", fields).assign("a", lambda w: deref(shift(w, "p2r", 0)), "w").execute()
    with pytest.raises(ValueError, match="locations"):
        fn.MeshExecutor(domain, "p", fields).assign("a", lambda x: deref(shift(x, "p2q", 0)), "x").execute()


def test_points_without_neighbors(spark):
    """They give init at every level, and nothing is joined without a key."""
    table = spark.createDataFrame([(0, 0, 1), (0, 1, -1), (1, 0, -1), (1, 1, -1)], "index int, n int, neighbor int")
    field = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "v int, k int, x double")
    out = mesh.reduce_neighbors(field, "x", table, "v", "p", lambda a, v, n: a + v, F.lit(0.5), {"k": 2}, "s")
    assert sorted(map(tuple, out.collect())) == [(0, 0, 3.5), (0, 1, 4.5), (1, 0, 0.5), (1, 1, 0.5)]
    assert not re.search("NestedLoop|Cartesian", _plan(out))


# --- icosahedral stages


def test_icosahedral_extents():
    body = lambda at: {}
    first = icosahedral.Stage("edges", body, ("t",), {"cells": ("u",)})
    second = icosahedral.Stage("cells", body, ("out",), {"edges": ("t",)})
    assert icosahedral.IcosahedralSpec((first, second)).compute_extents() == [Extent(*icosahedral.neighbors_extent("cells", "edges")), Extent()]
    assert icosahedral.neighbors_extent("cells", "edges") == ((0, 1), (0, 1)) and icosahedral.neighbors_extent("edges", "cells") == ((-1, 0), (-1, 0))


def test_icosahedral_rules(spark):
    cells = src.dense(spark, {"i": 2, "j": 2, "k": 1, "c": 2}).withColumn("u", F.lit(1.0))
    with pytest.raises(ValueError, match="never written"):
        icosahedral.run(icosahedral.IcosahedralSpec((), {"t": ("cells", "double")}), ((0, 1), (0, 1)), {"cells": cells})
    wrong = icosahedral.Stage("cells", lambda at: {"v": at("u")}, ("v",))
    with pytest.raises(ValueError, match="columns"):
        icosahedral.run(icosahedral.IcosahedralSpec((wrong,)), ((0, 1), (0, 1)), {"cells": cells})
    far = icosahedral.Stage("cells", lambda at: {"u": at.fold("edges", lambda a, x: a, F.lit(0.0))}, ("u",))
    with pytest.raises(ValueError, match="reads nothing"):
        icosahedral.run(icosahedral.IcosahedralSpec((far,)), ((0, 1), (0, 1)), {"cells": cells})


# --- types


def test_floats_are_the_same_in_both_strategies(spark):
    """Diffusion in single precision with temporaries of floats: bit for bit, and unlike the doubles'."""
    a, df = _dense(spark, 12, 9, 2)
    df = df.select("i", "j", "k", F.col("value").cast("float").alias("value"), F.lit(0.025).cast("float").alias("coeff"), F.lit(0.0).cast("float").alias("out"))
    grid = make_grid(Halo(2, 2, 2, 9, 12), Halo(2, 2, 2, 6, 9), 2)
    runs = [src.to_numpy(stencil.run(kernels.horizontal_diffusion(kind="float"), grid, df, strategy=s, tile=(4, 4)), name="out") for s in ("windows", "blocks")]
    assert runs[0].dtype == np.float32 and np.array_equal(*runs)
    x = a.astype(np.float32)
    lap = np.zeros_like(x)
    lap[1:-1, 1:-1] = np.float32(4) * x[1:-1, 1:-1] - (((x[2:, 1:-1] + x[1:-1, 2:]) + x[:-2, 1:-1]) + x[1:-1, :-2])
    fx, fy = lap[1:] - lap[:-1], lap[:, 1:] - lap[:, :-1]
    fx[fx * (x[1:] - x[:-1]) > 0] = 0
    fy[fy * (x[:, 1:] - x[:, :-1]) > 0] = 0
    want = x[2:-2, 2:-2] - np.float32(0.025) * (((fx[2:-1, 2:-2] - fx[1:-2, 2:-2]) + fy[2:-2, 2:-1]) - fy[2:-2, 1:-2])
    assert np.array_equal(runs[0][2:-2, 2:-2], want)


def test_exchange_needs_an_order(spark):
    rows = spark.createDataFrame([(0, 1.0, 2), (0, 5.0, 1), (1, 3.0, 1)], "i int, v double, at int")
    assert sorted(map(tuple, reduction.scatter(rows, ["i"], "v", "exch", "at").collect())) == [(0, 1.0), (1, 3.0)]
    with pytest.raises(ValueError, match="order"):
        reduction.scatter(rows, ["i"], "v", "exch")
