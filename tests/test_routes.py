"""Routes between blocks that reach the same cell."""

from fieldloom.operators import halo


def test_of_several_routes_to_a_cell_the_greatest_block_holds(spark):
    cells = [(b, 0, 0, i, 0, 0, 10.0 * b + i, f"own {b}") for b in range(3) for i in range(4)]
    df = spark.createDataFrame(cells, "bi int, bj int, bk int, i int, j int, k int, value double, note string").repartition(5)
    names = ["from_bi", "from_bj", "from_bk", "i0", "i1", "j0", "j1", "k0", "k1", "to_bi", "to_bj", "to_bk", "di", "dj", "dk"]
    routes = [
        (1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0),  # cells 0, 1 of block 1 to cells 1, 2 of block 0
        (2, 0, 0, 2, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),  # cells 2, 3 of block 2 to cells 2, 3 of block 0
        (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0),  # cell 0 of block 2 to cell 2 of block 0
    ]
    routes = spark.createDataFrame(routes, ", ".join(f"{n} int" for n in names))
    for some in (routes, routes.orderBy("from_bi", ascending=False), routes.union(routes)):
        got = {(r.bi, r.i): r.value for r in halo.all_to_all(df, some, ["value"]).collect()}
        assert len(got) == 12 and halo.all_to_all(df, some, ["value"]).count() == 12
        assert [got[0, i] for i in range(4)] == [0.0, 10.0, 22.0, 23.0]
        assert all(got[b, i] == 10.0 * b + i for b in (1, 2) for i in range(4))
