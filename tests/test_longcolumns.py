"""Scans and tridiagonal systems in chunks against loops over whole columns."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.longcolumns import Monoid, affine, blocked_scan, blocked_tridiagonal


def plus():
    return Monoid("bigint", F.lit(0).cast("long"), lambda a, b: a + b)


def words():
    """Not commutative, so that order shows."""
    return Monoid("string", F.lit(""), lambda a, b: F.concat(a, b))


@pytest.mark.parametrize("size", [2, 3, 7, 1000])
def test_scans_equal_loops(spark, size):
    """Gaps, columns that begin and end anywhere, empty chunks, columns of one point."""
    rnd = random.Random(size)
    rows = [(c, p, chr(97 + rnd.randrange(26))) for c, (low, high) in enumerate([(-5, 60), (3, 3), (40, 99), (10, 12)]) for p in range(low, high + 1) if rnd.random() < 0.6 or p == low]
    ran = blocked_scan(spark.createDataFrame(rows, "col int, p int, w string"), ["col"], "p", F.col("w"), words(), "s", size)
    want, held = {}, {}
    for c, p, w in sorted(rows):
        held[c] = held.get(c, "") + w
        want[c, p] = held[c]
    assert {(r.col, r.p): r.s for r in ran.collect()} == want and ran.columns == ["col", "p", "w", "s"]


def test_one_long_column_in_many_tasks(spark):
    n = 200_000
    ran = blocked_scan(spark.range(n).withColumn("v", F.col("id") % 7), [], "id", F.col("v"), plus(), "s", 1024).cache()
    assert ran.rdd.getNumPartitions() > 1
    total = F.expr("(id div 7) * 21 + (id % 7) * (id % 7 + 1) div 2")
    assert ran.where(F.col("s") != total).count() == 0 and ran.count() == n


def test_affine_maps_equal_a_loop(spark):
    rnd = random.Random(1)
    rows = [(p, rnd.uniform(-1, 1), rnd.uniform(-5, 5)) for p in range(300)]
    ran = blocked_scan(spark.createDataFrame(rows, "p int, a double, b double"), [], "p", F.struct("a", "b"), affine(), "f", 8)
    x, want = 2.0, {}
    for p, a, b in rows:
        x = a * x + b
        want[p] = x
    assert all(abs(r.f.a * 2.0 + r.f.b - want[r.p]) < 1e-9 for r in ran.collect())


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_systems_equal_thomas(spark, size):
    """To 1e-12, columns of many lengths, from one place on; ends within and at the end of chunks."""
    rnd = random.Random(size)
    rows = []
    for c, (low, high) in enumerate([(0, 200), (4, 4), (9, 10), (3, 80), (15, 31), (0, 15)]):
        rows += [(c, p, rnd.uniform(-1, 1), rnd.choice([-1, 1]) * rnd.uniform(2.5, 4), rnd.uniform(-1, 1), rnd.uniform(-9, 9), "kept") for p in range(low, high + 1)]
    df = spark.createDataFrame(rows, "col int, p int, a double, b double, c double, d double, other string").repartition(3)
    got = {(r.col, r.p): r.x for r in blocked_tridiagonal(df, ["col"], "p", "a", "b", "c", "d", "x", size).collect()}
    assert len(got) == len(rows)
    for col in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == col)
        cs, ds, u, v = [], [], 0.0, 0.0
        for _, _, a, b, c, d, _ in own:
            below = b - a * u
            u, v = c / below, (d - a * v) / below
            cs.append(u)
            ds.append(v)
        x = 0.0
        for n in range(len(own) - 1, -1, -1):
            x = ds[n] - cs[n] * x
            assert abs(got[col, own[n][1]] - x) < 1e-12 * max(1, abs(x))


def test_gaps_and_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (3, 1.0)], "p int, a double")
    with pytest.raises(ValueError, match="gap"):
        blocked_tridiagonal(df, [], "p", "a", "a", "a", "a", "x")
    assert blocked_tridiagonal(df.limit(0), [], "p", "a", "a", "a", "a", "x").count() == 0
    assert blocked_scan(df.limit(0), [], "p", F.col("a").cast("long"), plus(), "s").count() == 0
