import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import ieee
from fieldloom.operators import boundary, halo, kernels, mesh, reduction, stencil
from fieldloom.plans.expr import Index
from fieldloom.plans.grid import Axis, Halo, make_grid
from fieldloom.plans.spec import Operator, SpecError, execute_forward, execute_parallel, in_, inout
from fieldloom.sources import fields as src

NI, NJ, NK = 12, 9, 4


def _field(spark, seed=0, **more):
    a = np.random.default_rng(seed).normal(size=(NI, NJ, NK))
    return a, src.from_numpy(spark, a).withColumns(more)


def _diffusion(a, coeff):
    lap = np.zeros_like(a)
    lap[1:-1, 1:-1] = 4 * a[1:-1, 1:-1] - (a[2:, 1:-1] + a[1:-1, 2:] + a[:-2, 1:-1] + a[1:-1, :-2])
    fx, fy = np.zeros_like(a), np.zeros_like(a)
    fx[:-1] = lap[1:] - lap[:-1]
    fx[:-1][fx[:-1] * (a[1:] - a[:-1]) > 0] = 0
    fy[:, :-1] = lap[:, 1:] - lap[:, :-1]
    fy[:, :-1][fy[:, :-1] * (a[:, 1:] - a[:, :-1]) > 0] = 0
    out = np.zeros_like(a)
    out[2:-2, 2:-2] = (a - coeff * (fx - np.roll(fx, 1, 0) + fy - np.roll(fy, 1, 1)))[2:-2, 2:-2]
    return out


@pytest.mark.parametrize("strategy", ["windows", "blocks"])
@pytest.mark.parametrize("tile", [(64, 64), (3, 4)])
def test_horizontal_diffusion(spark, strategy, tile):
    a, df = _field(spark, coeff=F.lit(0.025), out=F.lit(0.0))
    grid = make_grid(Halo(2, 2, 2, NI - 3, NI), Halo(2, 2, 2, NJ - 3, NJ), NK)
    out = stencil.run(kernels.horizontal_diffusion(), grid, df, strategy=strategy, tile=tile, check_bounds=True)
    assert out.columns == df.columns
    np.testing.assert_allclose(src.to_numpy(out, name="out"), _diffusion(a, 0.025), atol=1e-14)


def test_windows_share_one_exchange(spark):
    _, df = _field(spark, coeff=F.lit(0.025), out=F.lit(0.0))
    grid = make_grid(Halo(2, 2, 2, NI - 3, NI), Halo(2, 2, 2, NJ - 3, NJ), NK)
    plan = stencil.run(kernels.horizontal_diffusion(), grid, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_tridiagonal_and_advection(spark):
    a, df = _field(spark, 1, inf=F.lit(-1.0), diag=F.lit(3.0), sup=F.lit(1.0), out=F.lit(0.0))
    grid = make_grid(NI, NJ, NK)
    x = src.to_numpy(stencil.run(kernels.tridiagonal(grid, rhs="value"), grid, df), name="out")
    matrix = np.diag([3.0] * NK) + np.diag([-1.0] * (NK - 1), -1) + np.diag([1.0] * (NK - 1), 1)
    np.testing.assert_allclose(x, np.einsum("kl,ijl->ijk", np.linalg.inv(matrix), a), atol=1e-13)

    dtr, rng = 3 / 20, np.random.default_rng(5)
    w, pos, tens, tens2 = (rng.normal(size=(NI, NJ, NK)) for _ in range(4))
    for name, y in (("wcon", w), ("u_pos", pos), ("utens", tens), ("utens_stage", tens2)):
        df = df.join(src.from_numpy(spark, y, name=name), ["i", "j", "k"])
    grid = make_grid(Halo(0, 1, 0, NI - 2, NI), NJ, NK)
    got = src.to_numpy(stencil.run(kernels.vertical_advection(grid, u_stage="value"), grid, df.withColumn("utens_out", F.lit(0.0)), tile=(5, 5)), name="utens_out")
    for i in range(NI - 1):
        for j in range(NJ):
            m, rhs = np.zeros((NK, NK)), np.zeros(NK)
            for k in range(NK):
                down = -0.25 * (w[i + 1, j, k] + w[i, j, k]) if k else 0
                up = 0.25 * (w[i + 1, j, k + 1] + w[i, j, k + 1]) if k < NK - 1 else 0
                m[k, k] = dtr - (down + up) / 2
                rhs[k] = dtr * pos[i, j, k] + tens[i, j, k] + tens2[i, j, k]
                if k:
                    m[k, k - 1] = down / 2
                    rhs[k] -= down / 2 * (a[i, j, k - 1] - a[i, j, k])
                if k < NK - 1:
                    m[k, k + 1] = up / 2
                    rhs[k] -= up / 2 * (a[i, j, k + 1] - a[i, j, k])
            np.testing.assert_allclose(got[i, j], dtr * (np.linalg.solve(m, rhs) - pos[i, j]), rtol=1e-8, atol=1e-9)


def test_later_stage_is_read_from_done_levels(spark):
    """In an ordered multistage a stage sees what later stages wrote at levels that are done."""
    axis = Axis(NK)
    full = axis.full()
    first = Operator({full.first_level(): lambda x, y, z: {"y": x()}, full.modify(1, 0): lambda x, y, z: {"y": x() + z(k=-1)}}, x=in_(), y=inout(), z=in_(k=(-1, 0)))
    second = Operator(lambda y, z: {"z": 2 * y()}, y=in_(), z=inout())
    a, df = _field(spark, 2, y=F.lit(0.0), z=F.lit(0.0))
    spec = execute_forward().stage(first, x="value", y="y", z="z").stage(second, y="y", z="z")
    got = src.to_numpy(stencil.run(spec, make_grid(NI, NJ, axis), df), name="z")
    want, z = np.zeros_like(a), np.zeros((NI, NJ))
    for k in range(NK):
        z = 2 * (a[:, :, k] + (z if k else 0))
        want[:, :, k] = z
    np.testing.assert_allclose(got, want)


def test_empty_box_and_bounds(spark):
    a, df = _field(spark, out=F.lit(7.0))
    same = stencil.run_single_stage(kernels.copy, make_grid(0, NJ, NK), df, inp="value", out="out")
    assert (src.to_numpy(same, name="out") == 7).all()
    with pytest.raises(SpecError):
        stencil.run(execute_parallel().stage(kernels.laplacian, inp="value", out="out"), make_grid(NI, NJ, NK), df, check_bounds=True)
    with pytest.raises(SpecError):
        stencil.run_single_stage(kernels.copy, make_grid(NI, NJ, NK), df, inp="nothing", out="out")


def test_steps(spark):
    a, df = _field(spark, out=F.lit(0.0))
    double = Operator(lambda inp, out: {"out": 2 * inp() + 0 * Index("i")}, inp=in_(), out=inout())
    states = list(stencil.steps(execute_parallel().stage(double, inp="value", out="out"), make_grid(NI, NJ, NK), df, {"value": "out"}, 3, every=99))
    np.testing.assert_allclose(src.to_numpy(states[-1]), 8 * a)


def test_ieee(spark):
    inf, nan = math.inf, math.nan
    rows = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (nan, 1.0), (1.0, nan), (-7.5, 2.0), (7.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(ieee.divide(a, b), ieee.fmod(a, b), ieee.maximum(a, b), ieee.minimum(a, b), ieee.log(a), ieee.trunc(a)).collect()
    assert [r[0] for r in got[:3]] == [inf, -inf, -inf] and math.isnan(got[3][0]) and got[6][0] == -3.75
    assert got[6][1] == -1.5 and math.isnan(got[0][1])
    assert got[4][2] == 1.0 and math.isnan(got[5][2])  # a > b ? a : b
    assert math.isnan(got[4][3]) and got[5][3] == 1.0  # a > b ? b : a
    assert got[3][4] == -inf and math.isnan(got[1][4]) and got[6][5] == -7.0


def test_reductions(spark):
    df = src.dense(spark, {"i": 5, "j": 4}).withColumn("v", F.col("i") + 1)
    field = reduction.make_reducible(df, "v", 0)
    assert field.reduce("plus").first()[0] == 60
    assert field.reduce(lambda x, y: x + y).first()[0] == 60.0
    assert reduction.make_reducible(df.where("false"), "v", 0).reduce("plus").first()[0] == 0


@pytest.mark.parametrize("periodic", [(False, False, False), (True, False, True), (True, True, True)])
def test_halo_exchange_all_periodicities(spark, periodic):
    size, blocks, widths = (3, 4, 2), (2, 2, 2), ((1, 2), (2, 1), (1, 1))
    n = [s * b for s, b in zip(size, blocks, strict=True)]
    df = src.dense(spark, dict(zip("ijk", n, strict=True))).withColumn("v", (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).cast("double"))
    halos = tuple(Halo(a, b, a, a + s - 1, a + s + b) for s, (a, b) in zip(size, widths, strict=True))
    got = halo.exchange(halo.decompose(df, size, widths, blocks).fillna({"v": -1.0}), ["v"], halos, blocks, periodic).collect()
    for r in got:
        want = 0
        for d, p, weight, s, total, (low, _) in zip("ijk", periodic, (100, 10, 1), size, n, widths, strict=True):
            x = r[f"b{d}"] * s + r[d] - low
            if not 0 <= x < total:
                if not p:
                    want = None
                    break
                x %= total
            want += weight * x
        assert r["v"] == (-1.0 if want is None else want)
    assert len(got) == math.prod(b * (s + w[0] + w[1]) for b, s, w in zip(blocks, size, widths, strict=True))


def test_boundary_predicate(spark):
    df = src.dense(spark, {"i": 4, "j": 4, "k": 1}).withColumn("v", F.lit(0.0))
    h = Halo(1, 1, 1, 2, 4)
    out = boundary.apply_boundary(df, (h, h, Halo(0, 0, 0, 0, 1)), boundary.value_boundary(1.0, "v"), predicate=lambda d: d[0] == -1)
    assert {(r.i, r.j) for r in out.where("v = 1").collect()} == {(0, j) for j in range(4)}


def test_numpy_round_trip(spark):
    a = np.arange(24, dtype=np.float64).reshape(2, 3, 4)
    assert (src.to_numpy(src.from_numpy(spark, a)) == a).all()
    assert (src.to_numpy(src.from_numpy(spark, a, order="F")) == a.T).all()
    with pytest.raises(ValueError):
        src.from_numpy(spark, a[0])
    with pytest.raises(ValueError):
        src.from_numpy(spark, a, dtype="float32")
    with pytest.raises(ValueError):
        src.to_numpy(src.from_numpy(spark, a).where("i + j + k > 0"))
    with pytest.raises(ValueError):
        src.FieldSpec().type("double").type("int")
    with pytest.raises(ValueError):
        src.FieldSpec().type("double").build(spark)


def test_domains_and_folds(spark):
    assert mesh.cartesian_domain({"i": 3, "j": 0}).points(spark).count() == 0
    assert mesh.cartesian_domain({}).points(spark).count() == 1
    df = spark.createDataFrame([(0, k, float(k + 1)) for k in range(5)], "i int, k int, v double")
    assert mesh.fold_columns(df, ["i"], "k", ["v"], F.lit(42.0), lambda a, x: a + x["v"], "double").first().value == 57
    scanned = mesh.column_stage(df, ["i"], "k", ["v"], F.lit(42.0), mesh.Scan(lambda a, x: a + x["v"]), "double")
    assert [r.value for r in scanned.orderBy("k").collect()] == [42 + (k + 1) * (k + 2) / 2 for k in range(5)]
    ends = mesh.column_stage(df, ["i"], "k", ["v"], F.lit(42.0), mesh.Fold(lambda a, x: a + x["v"]), "double", prologue=(mesh.Fold(lambda a, x: a + 2 * x["v"]),), epilogue=(mesh.Fold(lambda a, x: a + 3 * x["v"]),))
    assert ends.first().value_last == 68 and ends.first().value is None


def test_zero_extents_take_no_exchange(spark):
    """A pointwise stage is a projection of the table."""
    fields = src.dense(spark, {"i": 4, "j": 4, "k": 2}).withColumns({"value": F.col("i") * 1.0, "out": F.lit(0.0)})
    out = stencil.run_single_stage(kernels.copy, make_grid(4, 4, 2), fields, inp="value", out="out")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r.out == r.value for r in out.collect())


def test_single_rows_and_holes(spark):
    points = src.dense(spark, {"i": 3, "j": 3, "k": 2}).withColumns({"value": F.col("i") * 1.0, "out": F.lit(0.0)})
    scalar = spark.createDataFrame([(2.5,)], "scale double")
    assert {r.scale for r in src.zip_fields(points, scalar).collect()} == {2.5}
    with pytest.raises(Exception, match="one row"):
        src.zip_fields(points, scalar.union(scalar)).collect()
    with pytest.raises(SpecError, match="holes"):
        stencil.run(execute_parallel().stage(kernels.copy, inp="value", out="out"), make_grid(3, 3, 2), points.where("i <> 1"), check_bounds=True)


def test_reductions_by_a_function_of_empty_and_full_fields(spark):
    points = spark.range(100).select(F.col("id").cast("double").alias("value"))
    assert reduction.make_reducible(points, "value", 0.0).reduce(lambda a, b: max(a, b)).first().value == 99.0
    assert reduction.make_reducible(points.where("false"), "value", -1.0).reduce(lambda a, b: max(a, b)).first().value == -1.0
