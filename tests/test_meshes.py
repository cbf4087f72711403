"""Columns with neighbours on meshes and parts of meshes, against loops and the whole."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import fn, mesh
from fieldloom.operators.fn import can_deref, deref, shift
from fieldloom.plans.expr import equal, where


@pytest.fixture(scope="module")
def graph(spark):
    """40 points on a line, each with the one before and two further on as neighbours, some missing."""
    rnd = random.Random(6)
    to = {(p, n): q if 0 <= (q := p + d) < 40 and rnd.random() < 0.9 else -1 for p in range(40) for n, d in enumerate((-1, 2, 3))}
    table = spark.createDataFrame([(p, n, q) for (p, n), q in to.items()], "index int, n int, neighbor int")
    values = {(p, k): float(rnd.randrange(-9, 10)) for p in range(40) for k in range(6) if p != 7 or k != 3}
    field = spark.createDataFrame([(p, k, v) for (p, k), v in values.items()], "point int, k int, v double")
    return to, table, values, field


@pytest.mark.parametrize("backward", [False, True])
def test_column_passes_with_neighbours_equal_loops(graph, backward):
    """Two hops, levels above and below, missing neighbours, a column that lacks a level."""
    to, table, values, field = graph
    domain = mesh.unstructured_domain({"point": 38, "k": 6}, c=table)
    some = lambda e: where(equal(e, e), e, 0.0)

    def step(acc, v):
        return 0.5 * acc + some(deref(shift(v, "k", 1))) + where(can_deref(shift(v, "c", 1)), 1.0, 0.0) + some(deref(shift(v, "c", 0, "c", 2, "k", -1))) * 3.0 + deref(v)

    got = fn.mesh_column_executor(domain, "point", {"point": field}, F.lit(2.0), ("v",), fn.ScanPass(step), "x", backward=backward)
    got = {(r.point, r.k): (r.v, r.x) for r in got.collect()}
    want = {}
    for p in range(38):
        acc = 2.0
        for k in sorted((k for q, k in values if q == p), reverse=backward):
            hop = to[q, 2] if (q := to[p, 0]) != -1 else -1
            acc = 0.5 * acc + values.get((p, k + 1), 0.0) + (1.0 if to[p, 1] != -1 else 0.0) + values.get((hop, k - 1), 0.0) * 3.0 + values[p, k]
            want[p, k] = (values[p, k], acc)
    assert got == want


def test_a_part_reads_its_frontier_alone(spark, graph):
    """Two assignments, the second reads the first's result through neighbours: the first is computed on ghost points too."""
    to, table, values, field = graph
    domain = mesh.unstructured_domain({"point": 40, "k": 6}, c=table)
    whole = fn.MeshExecutor(domain, "point", {"point": field})
    some = lambda e: where(equal(e, e), e, 0.0)
    whole.assign("t", lambda v: some(deref(shift(v, "c", 0))) + deref(v), "v").assign("x", lambda t: some(deref(shift(t, "c", 1))) - deref(t), "t")
    part = {3, 4, 20, 39}
    points = spark.createDataFrame([(p,) for p in part], "id int")
    ghost = part | {to[p, 1] for p in part} - {-1}
    read = ghost | {to[p, 0] for p in ghost} - {-1}
    need = whole.needed(points)
    assert set(need) == {"v"} and {r.id for r in need["v"].collect()} == read
    got = {(r.point, r.k): r.x for r in whole.on_part(points).collect()}
    every = {(r.point, r.k): r.x for r in whole.execute().collect()}
    assert got == {p: x for p, x in every.items() if p[0] in part}
    by_part = fn.MeshExecutor(domain, "point", {"point": field}).assign("t", lambda v: deref(shift(v, "c", 2)), "v").needed(spark.createDataFrame([(5, "a"), (6, "b"), (5, "b")], "id int, part string"))
    assert {(r.id, r.part) for r in by_part["v"].collect()} == {(to[p, 2], q) for p, q in ((5, "a"), (6, "b"), (5, "b")) if to[p, 2] != -1}
