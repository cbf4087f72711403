"""Sums that do not depend on the order, against whole numbers of any size."""

import math
import random
import struct


from fieldloom.operators.exact import exact_sum
from fieldloom.operators.reduction import make_reducible


def bits(x: float) -> bytes:
    return struct.pack(">d", x)


def test_sums_equal_fsum_in_any_order(spark):
    """Numbers of every size, the least and greatest too: bit-equal to the rounded exact sum, however the rows lie."""
    rnd = random.Random(4)
    rows = []
    for k in range(12):
        size = rnd.choice([(-1074, 1020), (-1070, -1000), (0, 60), (-40, 40), (900, 1020)])
        values = [math.ldexp(rnd.uniform(-1, 1), rnd.randint(*size)) for _ in range(80)] + [5e-324, -5e-324, 2.0**62, 0.1]
        rows += [(k, v) for v in values + [-v for v in values[:40]]]
    want = {k: math.fsum(v for n, v in rows if n == k) for k in range(12)}
    for partitions in (1, 7):
        rnd.shuffle(rows)
        got = {r.k: r.s for r in exact_sum(spark.createDataFrame(rows, "k int, v double").repartition(partitions), ["k"], "v", "s").collect()}
        assert {k: bits(v) for k, v in got.items()} == {k: bits(v) for k, v in want.items()}


def test_powers_and_their_neighbours(spark):
    """Each cut alone gives the number back."""
    values = [s * v for e in range(-1074, 1024, 7) for s in (1.0, -1.0) for p in (math.ldexp(1.0, e),) for v in (p, math.nextafter(p, math.inf), math.nextafter(p, 0.0))] + [1.7976931348623157e308]
    got = exact_sum(spark.createDataFrame(list(enumerate(values)), "n int, v double"), ["n"], "v", "s").collect()
    assert all(r.s == values[r.n] for r in got) and len(got) == len(values)


def test_special_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"null": [None], "mixed": [None, 1.5], "nan": [1.0, nan], "both": [inf, -inf], "up": [inf, -5.0], "down": [-inf, 1e308], "over": [1.7e308, 1.7e308], "zero": [-0.0, 0.0], "one": [1e16, 1.0, -1e16], None: [2.0, 0.25]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.s for r in exact_sum(df, ["k"], "v", "s").collect()}
    assert math.isnan(got.pop("nan")) and math.isnan(got.pop("both"))
    assert got == {"null": None, "mixed": 1.5, "up": inf, "down": -inf, "over": inf, "zero": 0.0, "one": 1.0, None: 2.25}
    assert make_reducible(df.limit(0), "v", 0.0).reduce("exact_plus").first()[0] == 0.0
    assert make_reducible(df.where("k = 'one'"), "v", 0.0).reduce("exact_plus").first()[0] == 1.0
    assert "HashAggregate" in exact_sum(df, [], "v")._jdf.queryExecution().executedPlan().toString()
