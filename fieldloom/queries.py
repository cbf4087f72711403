"""The registered queries on lattices made from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import ieee
from fieldloom.operators import blocks, boundary, exact, fn, halo, icosahedral, kernels, longcolumns, mesh, reduction, stencil
from fieldloom.operators.fn import can_deref, deref, shift
from fieldloom.plans import expr
from fieldloom.plans.expr import Index, array, maximum, where
from fieldloom.plans.grid import Axis, Extent, Grid, Halo, Interval, Level, make_grid
from fieldloom.plans.spec import Global, Operator, execute_backward, execute_forward, execute_parallel, in_, inout, multi_pass
from fieldloom.sources import fields as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The lattice: suppliers by parts by line numbers.
N, NK = 10, 7


def lat(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    return src.lattice(rows, F.col("l_suppkey") % n, F.col("l_partkey") % n, F.col("l_linenumber") - 1, F.col("l_quantity").cast("long"), (n, n, NK))


def _lat_sql(n: int = N) -> str:
    return f"""lat AS MATERIALIZED (SELECT i, j, k, coalesce(v, 0)::double AS value FROM (SELECT a.i::int AS i, b.j::int AS j, c.k::int AS k FROM range({n}) a(i), range({n}) b(j), range({NK}) c(k))
        LEFT JOIN (SELECT (l_suppkey % {n})::int AS i, (l_partkey % {n})::int AS j, (l_linenumber - 1)::int AS k, sum(l_quantity::bigint) AS v FROM lineitem GROUP BY 1, 2, 3) USING (i, j, k))"""


def query(sql: str | None = None, n: int = N) -> Callable[[Query], Query]:
    """Register; {lat} in the SQL is the lattice's table."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{lat}", _lat_sql(n))
        return f

    return register


def _inner(df: DataFrame, h: int, n: int = N) -> DataFrame:
    return df.where(F.col("i").between(h, n - 1 - h) & F.col("j").between(h, n - 1 - h))


def _box(h: int, k: int | Axis = NK, n: int = N) -> Grid:
    own = Halo(h, h, h, n - 1 - h, n)
    return make_grid(own, own, k)


def _at(di: int, dj: int, dk: int = 0, column: str = "value", table: str = "lat") -> str:
    """SQL for a neighbour's value of row a."""
    return f"(SELECT n.{column} FROM {table} n WHERE n.i = a.i + ({di}) AND n.j = a.j + ({dj}) AND n.k = a.k + ({dk}))"


_DIFFUSION_SQL = """
    WITH {lat},
    lap AS (SELECT a.i, a.j, a.k, a.value, 4e0 * a.value - (e.value + n.value + w.value + s.value) AS lap FROM lat a
        JOIN lat e ON e.i = a.i + 1 AND e.j = a.j AND e.k = a.k JOIN lat n ON n.i = a.i AND n.j = a.j + 1 AND n.k = a.k
        JOIN lat w ON w.i = a.i - 1 AND w.j = a.j AND w.k = a.k JOIN lat s ON s.i = a.i AND s.j = a.j - 1 AND s.k = a.k),
    fx AS (SELECT a.i, a.j, a.k, CASE WHEN (e.lap - a.lap) * (e.value - a.value) > 0 THEN 0e0 ELSE e.lap - a.lap END AS f FROM lap a JOIN lap e ON e.i = a.i + 1 AND e.j = a.j AND e.k = a.k),
    fy AS (SELECT a.i, a.j, a.k, CASE WHEN (n.lap - a.lap) * (n.value - a.value) > 0 THEN 0e0 ELSE n.lap - a.lap END AS f FROM lap a JOIN lap n ON n.i = a.i AND n.j = a.j + 1 AND n.k = a.k)
    SELECT a.i, a.j, a.k, a.value - {coeff} * (x.f - w.f + y.f - s.f) AS out FROM lat a
        JOIN fx x ON x.i = a.i AND x.j = a.j AND x.k = a.k JOIN fx w ON w.i = a.i - 1 AND w.j = a.j AND w.k = a.k
        JOIN fy y ON y.i = a.i AND y.j = a.j AND y.k = a.k JOIN fy s ON s.i = a.i AND s.j = a.j - 1 AND s.k = a.k
    WHERE a.i BETWEEN 2 AND 7 AND a.j BETWEEN 2 AND 7"""


@query(_DIFFUSION_SQL.replace("{coeff}", "0.025e0"))
def horizontal_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parallel stages with inferred extents, by windows."""
    df = lat(spark, sf_dir).withColumns({"coeff": F.lit(0.025), "out": F.lit(0.0)})
    return _inner(stencil.run(kernels.horizontal_diffusion(), _box(2), df), 2).select("i", "j", "k", "out")


@query(_DIFFUSION_SQL.replace("{coeff}", "0.025e0"))
def horizontal_diffusion_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on numpy blocks, in tiles of 4 by 4."""
    df = lat(spark, sf_dir).withColumns({"coeff": F.lit(0.025), "out": F.lit(0.0)})
    return _inner(stencil.run(kernels.horizontal_diffusion(), _box(2), df, strategy="blocks", tile=(4, 4)), 2).select("i", "j", "k", "out")


@query(_DIFFUSION_SQL.replace("{coeff}", "(0.5e0 + a.j / 10e0)"))
def masked_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient varies along j alone and is repeated along the other dimensions."""
    coeff = src.FieldSpec().type("double").dimensions(i=N, j=N, k=NK).masked("i", "k").named("coeff").initializer(lambda j: 0.5 + j / 10.0).build(spark)
    df = src.zip_fields(lat(spark, sf_dir), coeff).withColumn("out", F.lit(0.0))
    return _inner(stencil.run(kernels.horizontal_diffusion(), _box(2), df), 2).select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, value, value AS out FROM lat")
def copy_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.run_single_stage(kernels.copy, make_grid(N, N, NK), lat(spark, sf_dir).withColumn("out", F.lit(0.0)), inp="value", out="out")


@query(f"WITH {{lat}} SELECT i, j, k, CASE WHEN i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8 THEN 4e0 * value - ({_at(1, 0)} + {_at(0, 1)} + {_at(-1, 0)} + {_at(0, -1)}) ELSE -1e0 END AS out FROM lat a")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells outside the box keep what they held."""
    df = lat(spark, sf_dir).withColumn("out", F.lit(-1.0))
    return stencil.run_single_stage(kernels.laplacian, _box(1), df, inp="value", out="out").select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, (i + j + k)::double AS out FROM lat")
def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Operator(lambda out: {"out": Index("i") + Index("j") + Index("k")}, out=inout())
    return stencil.run_single_stage(own, make_grid(N, N, NK), lat(spark, sf_dir).withColumn("out", F.lit(0.0)), out="out").select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, coalesce(sum(value) OVER (PARTITION BY i, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out FROM lat")
def whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over all levels below, by a forward pass that reads its own last output."""
    full = Axis(NK).full()
    step = Operator({full.first_level(): lambda inp, out: {"out": 0.0}, full.modify(1, 0): lambda inp, out: {"out": out(k=-1) + inp(k=-1)}}, inp=in_(k=(-1, 0)), out=inout(k=(-1, 0)))
    df = lat(spark, sf_dir).withColumn("out", F.lit(0.0))
    return stencil.run(execute_forward().stage(step, inp="value", out="out"), make_grid(N, N, NK), df).select("i", "j", "k", "out")


@query("""WITH RECURSIVE {lat}, f(i, j, k, c, d) AS (
        SELECT i, j, k, 1e0 / 3e0, value / 3e0 FROM lat WHERE k = 0
        UNION ALL SELECT a.i, a.j, a.k, 1e0 / (3e0 - f.c * -1e0), (a.value - -1e0 * f.d) / (3e0 - f.c * -1e0) FROM f JOIN lat a ON a.i = f.i AND a.j = f.j AND a.k = f.k + 1),
    b(i, j, k, x) AS (SELECT i, j, k, d FROM f WHERE k = 6 UNION ALL SELECT f.i, f.j, f.k, f.d - f.c * b.x FROM b JOIN f ON f.i = b.i AND f.j = b.j AND f.k = b.k - 1)
    SELECT i, j, k, x AS out FROM b""")
def tridiagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward elimination and backward substitution, in blocks."""
    grid = make_grid(N, N, NK)
    df = lat(spark, sf_dir).withColumns({"inf": F.lit(-1.0), "diag": F.lit(3.0), "sup": F.lit(1.0), "out": F.lit(0.0)})
    return stencil.run(kernels.tridiagonal(grid, rhs="value"), grid, df).select("i", "j", "k", "out")


@query()
def vertical_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit vertical advection of the lattice; tested against a loop in plain Python."""
    grid = make_grid(Halo(0, 1, 0, N - 2, N), N, NK)
    df = lat(spark, sf_dir).withColumns({"wcon": F.col("value") / 1000, "u_pos": F.col("value") / 50, "utens": F.lit(0.5), "utens_stage": F.lit(0.25), "utens_out": F.lit(0.0)})
    out = stencil.run(kernels.vertical_advection(grid, u_stage="value"), grid, df)
    return out.where(F.col("i") < N - 1).select("i", "j", "k", "utens_out")


@query("WITH {lat} SELECT i, j, k, CASE WHEN k < 3 THEN value ELSE 4 * value END AS out FROM lat")
def two_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Axis(3, 4)
    scale = Operator({axis.interval(0): lambda inp, out: {"out": inp()}, axis.interval(1): lambda inp, out: {"out": 2 * inp()}}, inp=in_(), out=inout())
    twice = multi_pass(execute_parallel().stage(scale, inp="value", out="half").stage(scale, inp="half", out="out"), temps=("half",))
    return stencil.run(twice, make_grid(N, N, axis), lat(spark, sf_dir).withColumn("out", F.lit(0.0))).select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, CASE WHEN k BETWEEN 2 AND 4 THEN value ELSE 1.5e0 END AS out FROM lat")
def uncovered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Axis(2, 3, 2)
    middle = Operator({axis.interval(1): lambda inp, out: {"out": inp()}}, inp=in_(), out=inout())
    return stencil.run(execute_parallel().stage(middle, inp="value", out="out"), make_grid(N, N, axis), lat(spark, sf_dir).withColumn("out", F.lit(1.5))).select("i", "j", "k", "out")


@query(f"WITH {{lat}} SELECT i, j, k, {_at(1, 1, 0)} + {_at(-1, 0, 1)} AS out FROM lat a WHERE i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8 AND k < 6")
def corner_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in several dimensions at once, vertical ones too, in tiles of 3 by 3."""
    own = Operator(lambda inp, out: {"out": inp(i=1, j=1) + inp(i=-1, k=1)}, inp=in_((-1, 1), (0, 1), (0, 1)), out=inout())
    df = stencil.run(execute_parallel().stage(own, inp="value", out="out"), _box(1, NK - 1), lat(spark, sf_dir).withColumn("out", F.lit(0.0)), tile=(3, 3))
    return _inner(df, 1).where(F.col("k") < NK - 1).select("i", "j", "k", "out")


@query(f"WITH {{lat}}, d AS (SELECT i, j, k, 2 * value AS value FROM lat) SELECT i, j, k, {_at(1, 0, table='d')} + {_at(-1, 0, table='d')} AS out FROM lat a WHERE i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8")
def stencil_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator called within another, seen from two places."""
    double = Operator(lambda inp, out: {"out": 2 * inp()}, inp=in_(), out=inout())
    both = Operator(lambda inp, out: {"out": double(inp=inp.at(i=1))["out"] + double(inp=inp.at(i=-1))["out"]}, inp=in_(i=(-1, 1)), out=inout())
    df = stencil.run_single_stage(both, _box(1), lat(spark, sf_dir).withColumn("out", F.lit(0.0)), inp="value", out="out")
    return _inner(df, 1).select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, 1 * value / 2 AS o0, 2 * value / 2 AS o1, 3 * value / 2 AS o2, 4 * value / 2 AS o3, 5 * value / 2 AS o4 FROM lat")
def expandable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same computation over five fields, in chunks of two."""
    df = lat(spark, sf_dir).withColumns({f"t{n}": F.col("value") * (n + 1) for n in range(5)} | {f"o{n}": F.lit(0.0) for n in range(5)})
    half = Operator(lambda inp, out: {"out": inp() / 2}, inp=in_(), out=inout())
    ran = stencil.expandable_run(lambda f: execute_parallel().stage(half, inp=f["inp"], out=f["out"]), 2, make_grid(N, N, NK), df, {"inp": [f"t{n}" for n in range(5)], "out": [f"o{n}" for n in range(5)]})
    return ran.select("i", "j", "k", *(f"o{n}" for n in range(5)))


@query("WITH {lat} SELECT i, j, k, value + 3 AS a, 2 * (value + 1) AS b FROM lat")
def tuple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array-valued fields: element-wise work, read back by element."""
    df = lat(spark, sf_dir).withColumn("t", F.array(*(F.col("value") + n for n in range(5)))).withColumn("out", F.array(*(F.lit(0.0) for _ in range(2))))
    own = Operator(lambda inp, out: {"out": array(inp()[3], 2 * inp()[1])}, inp=in_(), out=inout())
    ran = stencil.run_single_stage(own, make_grid(N, N, NK), df, inp="t", out="out")
    return ran.select("i", "j", "k", F.get("out", F.lit(0)).alias("a"), F.get("out", F.lit(1)).alias("b"))


@query("SELECT vec_id, embedding[5]::double AS fifth, embedding[1]::double * 2e0 + embedding[64]::double AS ends FROM embeddings")
def extra_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of a vector as an extra data dimension, read by place within a stencil."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    own = Operator(lambda v, fifth, ends: {"fifth": v()[4], "ends": v()[0] * 2.0 + v()[63]}, v=in_(), fifth=inout(), ends=inout())
    df = emb.withColumns({"fifth": F.lit(0.0), "ends": F.lit(0.0)})
    return stencil.run_single_stage(own, make_grid((1 << 31) - 1, 1, 1), df, v="v", fifth="fifth", ends="ends").select("vec_id", "fifth", "ends")


@query("WITH {lat} SELECT i, j, list(value ORDER BY k)[3] AS third, len(list(value)) AS n FROM lat GROUP BY i, j")
def axis_to_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = src.dimension_to_tuple(lat(spark, sf_dir), "k", "value")
    return packed.select("i", "j", F.get("value", F.lit(2)).alias("third"), F.size("value").cast("long").alias("n"))


@query("WITH {lat} SELECT (k - 2)::int AS z, (j + 1)::int AS j, i, value FROM lat")
def moved_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.transform_layout(src.rename_dimensions(src.shift_origin(lat(spark, sf_dir), k=2, j=-1), k="z"), ("z", "j", "i"))


@query("""WITH {lat} SELECT sum(value) AS plus, min(value) AS least, max(value) AS most, bit_and(value::bigint) AS all_bits, bit_or(value::bigint) AS any_bit, bit_xor(value::bigint) AS odd_bits,
    product(1 + (i % 2)) AS mul, sum(value * value) AS dot FROM lat""")
def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lat(spark, sf_dir).withColumns({"n": F.col("value").cast("long"), "p": (1 + F.col("i") % 2).cast("double"), "v2": F.col("value") * F.col("value")})
    how = reduction.REDUCTIONS
    return df.agg(
        how["plus"](F.col("value")).alias("plus"), how["min"](F.col("value")).alias("least"), how["max"](F.col("value")).alias("most"), how["bitwise_and"](F.col("n")).alias("all_bits"),
        how["bitwise_or"](F.col("n")).alias("any_bit"), how["bitwise_xor"](F.col("n")).alias("odd_bits"), how["mul"](F.col("p")).alias("mul"), how["plus"](F.col("v2")).alias("dot"),
    )


@query("WITH {lat} SELECT max(value) AS value FROM lat")
def reduce_functor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction by a function of two values, partial in each task."""
    return reduction.make_reducible(lat(spark, sf_dir), "value", 0.0).reduce(lambda a, b: a if a > b else b)


@query("SELECT (l_suppkey % 10)::int AS i, sum(l_quantity::bigint)::bigint AS q FROM lineitem GROUP BY 1")
def atomic_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 10).cast("int").alias("i"), F.col("l_quantity").cast("long").alias("q"))
    return reduction.scatter(rows, ["i"], "q", "add")


_H3 = Halo(2, 2, 2, 7, 10)
_SIDES = "CASE WHEN {d} < 2 THEN -1 WHEN {d} > 7 THEN 1 ELSE 0 END"


@query(f"""WITH {{lat}}, s AS (SELECT *, {_SIDES.format(d='i')} AS si, {_SIDES.format(d='j')} AS sj FROM lat)
    SELECT i, j, k, CASE WHEN si = 0 AND sj = 0 THEN 0e0 WHEN si = -1 AND sj = -1 THEN value + 1000 WHEN sj = -1 THEN value + 1 ELSE 2 * value END AS out FROM s""")
def directional_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by direction, of which the most specific holds."""
    df = lat(spark, sf_dir).withColumn("out", F.lit(0.0))
    rules = {(None, None, None): lambda c: {"out": 2 * c["value"]}, (None, -1, None): lambda c: {"out": c["value"] + 1}, (-1, -1, None): lambda c: {"out": c["value"] + 1000}}
    return boundary.apply_boundary(df, (_H3, _H3, Halo(0, 0, 0, NK - 1, NK)), rules).select("i", "j", "k", "out")


@query(f"""WITH {{lat}}, s AS (SELECT *, NOT ({_SIDES.format(d='i')} = 0 AND {_SIDES.format(d='j')} = 0) AS h FROM lat)
    SELECT i, j, k, CASE WHEN h THEN value ELSE 0e0 END AS copied, CASE WHEN h THEN 42e0 ELSE 0e0 END AS fixed, CASE WHEN h THEN 0e0 ELSE value END AS zeroed FROM s""")
def simple_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lat(spark, sf_dir).withColumns({"copied": F.lit(0.0), "fixed": F.lit(0.0), "zeroed": F.col("value")})
    halos = (_H3, _H3, Halo(0, 0, 0, NK - 1, NK))
    for rules in (boundary.copy_boundary("value", "copied"), boundary.value_boundary(42.0, "fixed"), boundary.zero_boundary("zeroed")):
        df = boundary.apply_boundary(df, halos, rules)
    return df.select("i", "j", "k", "copied", "fixed", "zeroed")


_BLOCK = (Halo(1, 2, 1, 4, 7), Halo(2, 1, 2, 5, 7), Halo(0, 0, 0, NK - 1, NK))
_BLOCKS_SQL = """blocks AS (SELECT x.bi::int AS bi, y.bj::int AS bj, 0 AS bk, p.i::int AS i, q.j::int AS j, r.k::int AS k, p.i - 1 + 4 * x.bi AS gi, q.j - 2 + 4 * y.bj AS gj FROM range(2) x(bi), range(2) y(bj), range(7) p(i), range(7) q(j), range(7) r(k))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halo.decompose(lat(spark, sf_dir, 8), (4, 4, NK), ((1, 2), (2, 1), (0, 0)), (2, 2, 1))


@query(f"""WITH {{lat}}, {_BLOCKS_SQL}
    SELECT bi, bj, bk, b.i, b.j, b.k, v.value FROM blocks b LEFT JOIN lat v ON v.i = (gi + 8) % 8 AND v.j = gj AND v.k = b.k""", 8)
def halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two blocks with uneven halos, periodic along i alone."""
    return halo.exchange(_blocks(spark, sf_dir), ["value"], _BLOCK, (2, 2, 1), (True, False, False))


@query(f"""WITH {{lat}}, {_BLOCKS_SQL}
    SELECT bi, bj, bk, b.i, b.j, b.k, coalesce(v.value, 42e0) AS value FROM blocks b LEFT JOIN lat v ON v.i = (gi + 8) % 8 AND v.j = gj AND v.k = b.k""", 8)
def distributed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange, then a constant where a block has no neighbour."""
    bounds = boundary.DistributedBoundaries(_BLOCK, (2, 2, 1), (True, False, False), 3)
    return bounds.exchange(_blocks(spark, sf_dir), boundary.bind_bc(boundary.value_boundary(42.0, "value"), "value"))


@query("""WITH {lat}, b AS (SELECT (i // 4)::int AS bi, (j // 4)::int AS bj, 0 AS bk, (i % 4)::int AS i, (j % 4)::int AS j, k, value FROM lat)
    SELECT a.bi, a.bj, a.bk, a.i, a.j, a.k, CASE WHEN a.bi = 1 AND a.bj = 0 AND a.i < 2 AND a.j >= 2 THEN s.value ELSE a.value END AS value
    FROM b a LEFT JOIN b s ON s.bi = 0 AND s.bj = 1 AND s.i = a.i + 2 AND s.j = a.j - 2 AND s.k = a.k""", 8)
def block_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner of one block moved into another."""
    names = ["from_bi", "from_bj", "from_bk", "i0", "i1", "j0", "j1", "k0", "k1", "to_bi", "to_bj", "to_bk", "di", "dj", "dk"]
    routes = spark.createDataFrame([(0, 1, 0, 2, 3, 0, 1, 0, NK - 1, 1, 0, 0, -2, 2, 0)], ", ".join(f"{n} int" for n in names))
    return halo.all_to_all(halo.decompose(lat(spark, sf_dir, 8), (4, 4, NK), ((0, 0),) * 3, (2, 2, 1)), routes, ["value"])


@query("WITH {lat} SELECT i, j, k, 42 + sum(value) OVER (PARTITION BY i, j ORDER BY k) AS out, 42 + sum(value) OVER (PARTITION BY i, j) AS out_last FROM lat")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum from a seed, by a JVM aggregate over each column."""
    return mesh.column_stage(lat(spark, sf_dir), ["i", "j"], "k", ["value"], F.lit(42.0), mesh.Scan(lambda a, x: a + x["value"]), "double", "out").select("i", "j", "k", "out", "out_last")


@query("WITH {lat} SELECT i, j, k, 2 * sum(value) OVER (PARTITION BY i, j ORDER BY k DESC) AS out FROM lat")
def scan_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = mesh.Scan(lambda a, x: a + x["value"], lambda a: 2 * a)
    return mesh.column_stage(lat(spark, sf_dir), ["i", "j"], "k", ["value"], F.lit(0.0), step, "double", "out", backward=True).select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, sum(CASE WHEN k = 0 THEN 2 * value WHEN k = 6 THEN 3 * value ELSE value END) + 42 AS out FROM lat GROUP BY i, j")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold with a prologue and an epilogue."""
    own = [mesh.Fold(lambda a, x, n=n: a + n * x["value"]) for n in (1, 2, 3)]
    out = mesh.column_stage(lat(spark, sf_dir), ["i", "j"], "k", ["value"], F.lit(42.0), own[0], "double", "out", prologue=(own[1],), epilogue=(own[2],))
    return out.where("k = 0").select("i", "j", F.col("out_last").alias("out"))


@query("WITH {lat} SELECT i, j, sum(value) + max(value) AS out FROM lat GROUP BY i, j")
def merged_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage's accumulator seeds the second."""
    df = lat(spark, sf_dir)
    most = mesh.fold_columns(df, ["i", "j"], "k", ["value"], F.lit(0.0), lambda a, x: F.greatest(a, x["value"]), "double", out="seed")
    return mesh.fold_columns(df.join(most, ["i", "j"]), ["i", "j", "seed"], "k", ["value"], F.col("seed"), lambda a, x: a + x["value"], "double", out="out").select("i", "j", "out")


# --- meshes: a structured triangulation of 10 by 10 vertices; edges along i, then along j, then diagonal

_NX = 10
_E2V = f"""e2v AS (SELECT (i + j * {_NX - 1})::int AS edge, [i + j * {_NX}, i + 1 + j * {_NX}]::int[] AS v FROM range({_NX - 1}) a(i), range({_NX}) b(j)
    UNION ALL SELECT ({(_NX - 1) * _NX} + i + j * {_NX})::int, [i + j * {_NX}, i + (j + 1) * {_NX}]::int[] FROM range({_NX}) a(i), range({_NX - 1}) b(j)
    UNION ALL SELECT ({2 * (_NX - 1) * _NX} + i + j * {_NX - 1})::int, [i + 1 + j * {_NX}, i + (j + 1) * {_NX}]::int[] FROM range({_NX - 1}) a(i), range({_NX - 1}) b(j))"""


def edges_to_vertices(spark: SparkSession, nx: int = _NX) -> DataFrame:
    """(index, n, neighbor): both ends of every edge of the triangulation."""
    points = src.dense(spark, {"i": nx, "j": nx})
    i, j = F.col("i"), F.col("j")
    kinds = [
        ((i < nx - 1), i + j * (nx - 1), i + j * nx, i + 1 + j * nx),
        ((j < nx - 1), i + j * nx + (nx - 1) * nx, i + j * nx, i + (j + 1) * nx),
        ((i < nx - 1) & (j < nx - 1), i + j * (nx - 1) + 2 * (nx - 1) * nx, i + 1 + j * nx, i + (j + 1) * nx),
    ]
    rows = F.filter(F.array(*(F.when(ok, F.struct(e.alias("index"), F.array(a, b).alias("to"))) for ok, e, a, b in kinds)), lambda x: x.isNotNull())
    return points.select(F.explode(rows).alias("e")).select(F.col("e.index").alias("index"), F.posexplode("e.to").alias("n", "neighbor"))


def vertices_to_edges(spark: SparkSession, nx: int = _NX) -> DataFrame:
    """(index, n, neighbor): the edges of every vertex in order of their numbers, up to six places with -1 for none."""
    ends = edges_to_vertices(spark, nx).groupBy("neighbor").agg(F.array_sort(F.collect_list("index")).alias("e"))
    padded = F.concat("e", F.array_repeat(F.lit(mesh.MISSING), 6 - F.size("e")))
    return ends.select(F.col("neighbor").alias("index"), F.posexplode(padded).alias("n", "neighbor"))


_V2E = "v2e AS (SELECT v AS vertex, edge, (row_number() OVER (PARTITION BY v ORDER BY edge) - 1)::int AS n FROM (SELECT edge, unnest(v) AS v FROM e2v))"


@query(f"""WITH {{lat}}, {_E2V}, {_V2E}, p AS (SELECT (i + j * 10)::int AS vertex, n.n::int AS n, value FROM lat, range(6) n(n) WHERE k = 0)
    SELECT vertex AS index, n, coalesce(edge, -1)::int AS neighbor, value FROM p LEFT JOIN v2e USING (vertex, n)""")
def neighbor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connectivity with the value of the point that each row belongs to."""
    field = lat(spark, sf_dir).where("k = 0").select((F.col("i") + F.col("j") * N).alias("vertex"), "value")
    return mesh.deref(vertices_to_edges(spark), "index", field, "vertex", "value").select("index", "n", "neighbor", "value")


@query(f"""WITH {{lat}}, {_E2V}, {_V2E}, f AS (SELECT (i + j * 10)::int AS vertex, k, value FROM lat),
    e AS (SELECT edge, a.k, a.value + b.value AS flux FROM e2v JOIN f a ON a.vertex = v[1] JOIN f b ON b.vertex = v[2] AND b.k = a.k)
    SELECT vertex, k, sum(CASE WHEN n % 2 = 0 THEN flux ELSE -flux END) AS out FROM v2e JOIN e USING (edge) GROUP BY vertex, k""")
def unstructured_nabla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge values from both ends, then signed sums of them around each vertex, in neighbour order."""
    field = lat(spark, sf_dir).select((F.col("i") + F.col("j") * N).alias("vertex"), "k", "value")
    add = mesh.reduce_neighbors(field, "value", edges_to_vertices(spark), "vertex", "edge", lambda a, v, n: a + v, F.lit(0.0), {"k": NK}, "flux")
    signed = lambda a, v, n: a + F.when(n % 2 == 0, v).otherwise(-v)
    return mesh.reduce_neighbors(add, "flux", vertices_to_edges(spark), "edge", "vertex", signed, F.lit(0.0), {"k": NK}, "out")


@query(f"""WITH {{lat}}, {_E2V}, {_V2E}, f AS (SELECT (i + j * 10)::int AS vertex, value FROM lat WHERE k = 0), p AS (SELECT vertex FROM f),
    h AS (SELECT p.vertex, coalesce(x.edge, -1)::int AS edge FROM p LEFT JOIN v2e x ON x.vertex = p.vertex AND x.n = 5)
    SELECT h.vertex, edge, coalesce(v[2], -1)::int AS other, value FROM h LEFT JOIN e2v USING (edge) LEFT JOIN f ON f.vertex = v[2]""")
def shift_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops, vertex to its sixth edge to that edge's second vertex: -1 stays -1, and reads nothing."""
    field = lat(spark, sf_dir).where("k = 0").select((F.col("i") + F.col("j") * N).alias("vertex"), "value")
    points = mesh.hop(field.select("vertex"), "vertex", vertices_to_edges(spark), place=5, to="edge")
    points = mesh.hop(points, "edge", edges_to_vertices(spark), place=1, to="other")
    return mesh.deref(points, "other", field, "vertex", "value").select("vertex", "edge", "other", "value")


@query(f"WITH {{lat}} SELECT i, j, k, value, {_at(0, 0, 'CASE WHEN a.k > 0 THEN -1 ELSE 0 END')} AS other FROM lat a")
def vertical_indirection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset to read at is itself data."""
    return mesh.indirect(lat(spark, sf_dir), "value", "k", F.when(F.col("k") > 0, F.lit(-1)).otherwise(0), ["i", "j"], "other")


@query("WITH {lat} SELECT i, j, k, value, CASE WHEN i BETWEEN 2 AND 5 AND j < 3 THEN value + k END AS a, CASE WHEN i BETWEEN 2 AND 5 AND j < 3 THEN 2 * (value + k) END AS b FROM lat")
def fn_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments in order on a domain with sizes and offsets."""
    domain = mesh.cartesian_domain({"i": 4, "j": 3, "k": NK}, {"i": 2})
    return mesh.StencilExecutor(domain, lat(spark, sf_dir)).assign("a", lambda v, k: v + k, "value", "k").assign("b", lambda a: 2 * a, "a").execute()


# --- icosahedral: colours are line numbers modulo the location's number of colours

_ICO = "{loc} AS (SELECT i, j, 0 AS k, k AS c, value AS u, 1 + k::double AS len, 0.5e0 AS r FROM lat WHERE k < {n})"
_EDGES, _CELLS, _VERTICES = (_ICO.replace("{loc}", x).replace("{n}", str(n)) for x, n in (("edges", 3), ("cells", 2), ("vertices", 1)))


def _located(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    df = lat(spark, sf_dir).where(F.col("k") < icosahedral.COLORS[where]).withColumns({"c": F.col("k"), "k": F.lit(0)})
    return df.select("i", "j", "k", "c", F.col("value").alias("u"), (1 + F.col("c").cast("double")).alias("len"), F.lit(0.5).alias("r"))


def _ico_sql(source: str, target: str, value: str, name: str, outer: str = "{}", table: str = "") -> str:
    """Sum of a value over each point's neighbours; table: where the neighbours' values are, if not in the location's own."""
    rows = ", ".join(f"({c}, {n}, {o[0]}, {o[1]}, {o[2]})" for (s, c, t), offsets in icosahedral.NEIGHBORS.items() if (s, t) == (source, target) for n, o in enumerate(offsets))
    return f"""(SELECT p.i, p.j, p.k, p.c, {outer.format(f"sum({value})")} AS {name} FROM {source} p JOIN (VALUES {rows}) t(pc, n, di, dj, c) ON t.pc = p.c
        JOIN {table or target} x ON x.i = p.i + t.di AND x.j = p.j + t.dj AND x.k = p.k AND x.c = t.c GROUP BY p.i, p.j, p.k, p.c, p.r)"""


@query(f"WITH {{lat}}, {_CELLS} SELECT i, j, k, c, s FROM {_ico_sql('cells', 'cells', 'x.u', 's')}")
def ico_neighbors_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _located(spark, sf_dir, "cells")
    out = icosahedral.fold_neighbors(cells.select("i", "j", "k", "c"), "cells", "cells", cells, ["u"], F.lit(0.0), lambda a, x: a + x["u"], "s")
    return out


@query(f"WITH {{lat}}, {_EDGES} SELECT i, j, k, c, s FROM {_ico_sql('edges', 'edges', 'x.u', 's')}")
def ico_neighbors_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _located(spark, sf_dir, "edges")
    return icosahedral.fold_neighbors(edges.select("i", "j", "k", "c"), "edges", "edges", edges, ["u"], F.lit(0.0), lambda a, x: a + x["u"], "s")


_DIV = _ico_sql("cells", "edges", "x.u * x.len", "div", outer="(CASE WHEN p.c = 0 THEN 1e0 ELSE -1e0 END) * {} * p.r")
_CURL = _ico_sql("vertices", "edges", "(CASE WHEN n % 2 = 0 THEN -1e0 ELSE 1e0 END) * x.u * x.len", "curl", outer="{} * p.r")


@query(f"WITH {{lat}}, {_EDGES}, {_CELLS} SELECT i, j, k, c, div FROM {_DIV}")
def ico_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icosahedral.divergence(_located(spark, sf_dir, "cells"), _located(spark, sf_dir, "edges"), "u", "len", "r").select("i", "j", "k", "c", "div")


@query(f"WITH {{lat}}, {_EDGES}, {_VERTICES} SELECT i, j, k, c, curl FROM {_CURL}")
def ico_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icosahedral.curl(_located(spark, sf_dir, "vertices"), _located(spark, sf_dir, "edges"), "u", "len", "r").select("i", "j", "k", "c", "curl")


@query(f"""WITH {{lat}}, {_EDGES}, {_CELLS}, {_VERTICES}, d AS (SELECT * FROM {_DIV}), w AS (SELECT * FROM {_CURL}),
    gd AS (SELECT * FROM {_ico_sql('edges', 'cells', '(CASE WHEN n = 0 THEN -1e0 ELSE 1e0 END) * x.div', 'g', table='d')}),
    gc AS (SELECT * FROM {_ico_sql('edges', 'vertices', '(CASE WHEN n = 0 THEN -1e0 ELSE 1e0 END) * x.curl', 'g', table='w')})
    SELECT e.i, e.j, e.k, e.c, coalesce(gd.g, 0) * e.r - coalesce(gc.g, 0) * e.len AS lap FROM edges e LEFT JOIN gd USING (i, j, k, c) LEFT JOIN gc USING (i, j, k, c)""")
def ico_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _located(spark, sf_dir, "edges")
    div = icosahedral.divergence(_located(spark, sf_dir, "cells"), edges, "u", "len", "r").select("i", "j", "k", "c", "div")
    curl = icosahedral.curl(_located(spark, sf_dir, "vertices"), edges, "u", "len", "r").select("i", "j", "k", "c", "curl")
    return icosahedral.laplacian(edges, div, curl, "r", "len").select("i", "j", "k", "c", "lap")


# --- scalar functions


@query("""WITH {lat}, x AS (SELECT i, j, k, value - 600 AS a, (k - 3)::double AS b FROM lat)
    SELECT i, j, k, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'NaN'::double WHEN a > 0 THEN 'Infinity'::double ELSE '-Infinity'::double END ELSE a / b END AS quotient,
    CASE WHEN b = 0 THEN 'NaN'::double ELSE a % b END AS remainder, trunc(a / 7) AS cut, ceil(a / 7) AS up, floor(a / 7) AS down, greatest(a, b) AS most, least(a, b) AS least, b * (b * b) AS cube FROM x""")
def ieee_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lat(spark, sf_dir).select("i", "j", "k", (F.col("value") - 600).alias("a"), (F.col("k") - 3).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(
        "i", "j", "k", ieee.divide(a, b).alias("quotient"), ieee.fmod(a, b).alias("remainder"), ieee.trunc(a / 7).alias("cut"), ieee.ceil(a / 7).alias("up"), ieee.floor(a / 7).alias("down"),
        ieee.maximum(a, b).alias("most"), ieee.minimum(a, b).alias("least"), ieee.power(b, 3).alias("cube"),
    )


@query("WITH {lat} SELECT i, j, k, CASE WHEN value > 600 THEN 600e0 ELSE greatest(value, 550e0) END AS out FROM lat")
def data_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Operator(lambda inp, out: {"out": where(inp() > 600.0, 600.0, maximum(inp(), 550.0))}, inp=in_(), out=inout())
    return stencil.run_single_stage(own, make_grid(N, N, NK), lat(spark, sf_dir).withColumn("out", F.lit(0.0)), inp="value", out="out").select("i", "j", "k", "out")


@query("WITH {lat} SELECT i, j, k, value, sum(value) OVER (PARTITION BY i, j ORDER BY k DESC) AS out FROM lat")
def backward_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = Axis(NK).full()
    step = Operator({full.last_level(): lambda inp, out: {"out": inp()}, full.modify(0, -1): lambda inp, out: {"out": out(k=1) + inp()}}, inp=in_(), out=inout(k=(0, 1)))
    return stencil.run(execute_backward().stage(step, inp="value", out="out"), make_grid(N, N, NK), lat(spark, sf_dir).withColumn("out", F.lit(0.0)))


@query("WITH {lat} SELECT i, j, k, 2.5e0 * value + 10 + 11 AS out FROM lat")
def global_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants for all points, one of them a callable."""
    own = Operator(lambda inp, scale, shift, out: {"out": scale() * inp() + shift(10) + shift(11)}, inp=in_(), scale=Global(2.5), shift=Global(lambda x: x), out=inout())
    df = lat(spark, sf_dir).withColumn("out", F.lit(0.0))
    return stencil.run_single_stage(own, make_grid(N, N, NK), df, inp="value", out="out").select("i", "j", "k", "out")


@query(f"WITH {{lat}} SELECT i, j, k, 2 * ({_at(1, 0)}) AS out, {_at(1, 0)} + value AS other FROM lat a WHERE i BETWEEN 2 AND 7 AND j BETWEEN 2 AND 7")
def stencil_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A called operator with two results, seen from a neighbour, within a stage whose extent is given."""
    both = Operator(lambda a, b, x, y: {"x": 2 * a(), "y": a() + b()}, a=in_(), b=in_(), x=inout(), y=inout())

    def body(inp, out, other):
        got = both(a=inp.at(i=1), b=inp())
        return {"out": got["x"], "other": got["y"]}

    stage = Operator(body, inp=in_(i=(0, 1)), out=inout(), other=inout())
    df = lat(spark, sf_dir).withColumns({"out": F.lit(0.0), "other": F.lit(0.0)})
    ran = stencil.run(execute_parallel().stage(stage, extent=Extent((-1, 1)), inp="value", out="out", other="other"), _box(2), df)
    return _inner(ran, 2).select("i", "j", "k", "out", "other")


@query("WITH {lat} SELECT i, j, k, i + j + value AS xy, j + k + value AS yz FROM lat")
def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct-valued fields, read by name."""
    df = lat(spark, sf_dir).withColumn("t", F.struct(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("k").cast("double").alias("z"), "value"))
    own = Operator(lambda inp, xy, yz: {"xy": inp()["x"] + inp()["y"] + inp()["value"], "yz": inp()["y"] + inp()["z"] + inp()["value"]}, inp=in_(), xy=inout(), yz=inout())
    ran = stencil.run_single_stage(own, make_grid(N, N, NK), df.withColumns({"xy": F.lit(0.0), "yz": F.lit(0.0)}), inp="t", xy="xy", yz="yz")
    return ran.select("i", "j", "k", "xy", "yz")


@query(f"WITH {{lat}} SELECT i, j, k, {' + '.join(f'({q + 1}) * (value + {q} - {_at(1, 0)})' for q in range(4))} AS out FROM lat a WHERE i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8")
def extended_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth dimension in an array, with weights of its own, beside an offset in the first."""
    df = lat(spark, sf_dir).withColumns({"t": F.array(*(F.col("value") + q for q in range(4))), "jac": F.array(*(F.lit(q + 1.0) for q in range(4))), "out": F.lit(0.0)})
    own = Operator(lambda t, v, jac, out: {"out": sum((jac()[q] * (t()[q] - v(i=1)) for q in range(1, 4)), jac()[0] * (t()[0] - v(i=1)))}, t=in_(), v=in_(i=(0, 1)), jac=in_(), out=inout())
    ran = stencil.run_single_stage(own, _box(1), df, t="t", v="value", jac="jac", out="out")
    return _inner(ran, 1).select("i", "j", "k", "out")


@query("""WITH {lat} SELECT i, j, sum(value * (k + 1)) AS total, max(2 * value) AS most, bool_and(value >= 0) AS all_positive FROM lat GROUP BY i, j""")
def tuple_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform, zip, fold and test a column of values as one tuple."""
    packed = src.dimension_to_tuple(lat(spark, sf_dir), "k", "value")
    weighed = F.zip_with("value", F.sequence(F.lit(1), F.size("value")), lambda v, w: v * w)
    return packed.select("i", "j", F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max(F.transform("value", lambda v: 2 * v)).alias("most"), F.forall("value", lambda v: v >= 0).alias("all_positive"))


@query(f"WITH {{lat}}, s AS (SELECT i, j, k, value, 3 * value AS twin FROM lat) SELECT i, j, k, value + {_at(0, -1, table='s', column='twin')} AS out FROM s a WHERE i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8")
def composite_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields zipped on their points, one of them read at a neighbour."""
    twin = lat(spark, sf_dir).select("i", "j", "k", (3 * F.col("value")).alias("twin"))
    df = src.zip_fields(lat(spark, sf_dir), twin).withColumn("out", F.lit(0.0))
    own = Operator(lambda a, b, out: {"out": a() + b(j=-1)}, a=in_(), b=in_(j=(-1, 0)), out=inout())
    return _inner(stencil.run_single_stage(own, _box(1), df, a="value", b="twin", out="out"), 1).select("i", "j", "k", "out")


@query("""WITH {lat} SELECT i, j, k, CASE WHEN i < 2 AND j BETWEEN 2 AND 7 THEN -1e0 ELSE value END AS value FROM lat""")
def boundary_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition for the directions that a predicate lets pass."""
    halos = (_H3, _H3, Halo(0, 0, 0, NK - 1, NK))
    return boundary.apply_boundary(lat(spark, sf_dir), halos, boundary.value_boundary(-1.0, "value"), predicate=lambda d: d == (-1, 0, 0))


@query("WITH {lat} SELECT i, j, k, 8 * value AS value FROM lat")
def time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps, each from the state before it."""
    double = Operator(lambda inp, out: {"out": 2 * inp()}, inp=in_(), out=inout())
    df = lat(spark, sf_dir).withColumn("next", F.lit(0.0))
    *_, last = stencil.steps(execute_parallel().stage(double, inp="value", out="next"), make_grid(N, N, NK), df, {"value": "next"}, 3)
    return last.select("i", "j", "k", "value")


@query("WITH {lat}, s AS (SELECT *, sum(value) OVER (PARTITION BY i, j ORDER BY k) AS up FROM lat WHERE k BETWEEN 1 AND 5) SELECT i, j, k, value, up, sum(up) OVER (PARTITION BY i, j ORDER BY k DESC) AS down FROM s")
def vertical_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward scan and a backward one over its result, on a domain within the axis."""
    domain = mesh.cartesian_domain({"i": N, "j": N, "k": 5}, {"k": 1})
    add = lambda name: mesh.Scan(lambda a, x: a + x[name])
    return mesh.VerticalExecutor(domain, lat(spark, sf_dir), ["i", "j"], "k").assign("up", add("value"), F.lit(0.0), "value").assign("down", add("up"), F.lit(0.0), "up", backward=True).execute()


# --- the functional frontend: stencils on iterators


def _fn_lap(inp):
    return 4.0 * deref(inp) - (deref(shift(inp, "i", 1)) + deref(shift(inp, "j", 1)) + deref(shift(inp, "i", -1)) + deref(shift(inp, "j", -1)))


def _fn_flux(dim: str, lap):
    """lap: a stencil; the flux is one of the input alone."""
    def flux(inp):
        ahead = shift(inp, dim, 1)
        step = lap(ahead) - lap(inp)
        return where(step * (deref(ahead) - deref(inp)) > 0, 0.0, step)

    return flux


def _fn_diffused(inp, coeff, flx, fly):
    """flx, fly: functions of a shift (dimension, steps)."""
    return deref(inp) - deref(coeff) * (flx() - flx("i", -1) + fly() - fly("j", -1))


@query(_DIFFUSION_SQL.replace("{coeff}", "0.025e0"))
def fn_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four assignments, each on a domain of its own; they share one exchange."""
    def box(low: tuple[int, int], n: tuple[int, int]) -> mesh.Domain:
        return mesh.cartesian_domain({"i": n[0], "j": n[1], "k": NK}, {"i": low[0], "j": low[1]})

    def flux(dim: str):
        def own(inp, lap):
            step = deref(shift(lap, dim, 1)) - deref(lap)
            return where(step * (deref(shift(inp, dim, 1)) - deref(inp)) > 0, 0.0, step)

        return own

    read = lambda it: lambda *moves: deref(shift(it, *moves))
    ex = fn.CartesianExecutor(box((2, 2), (6, 6)), lat(spark, sf_dir).withColumn("coeff", F.lit(0.025)))
    ex.assign("lap", _fn_lap, "value", domain=box((1, 1), (8, 8)))
    ex.assign("flx", flux("i"), "value", "lap", domain=box((1, 2), (7, 6))).assign("fly", flux("j"), "value", "lap", domain=box((2, 1), (6, 7)))
    ex.assign("out", lambda inp, coeff, flx, fly: _fn_diffused(inp, coeff, read(flx), read(fly)), "value", "coeff", "flx", "fly")
    return _inner(ex.execute(), 2).select("i", "j", "k", "out")


@query(_DIFFUSION_SQL.replace("{coeff}", "0.025e0"))
def fn_diffusion_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one stencil that calls the others on shifted iterators."""
    def fused(inp, coeff):
        flx, fly = (lambda *moves, d=d: _fn_flux(d, _fn_lap)(shift(inp, *moves)) for d in "ij")
        return _fn_diffused(inp, coeff, flx, fly)

    domain = mesh.cartesian_domain({"i": 6, "j": 6, "k": NK}, {"i": 2, "j": 2})
    ex = fn.CartesianExecutor(domain, lat(spark, sf_dir).withColumn("coeff", F.lit(0.025))).assign("out", fused, "value", "coeff")
    return _inner(ex.execute(), 2).select("i", "j", "k", "out")


#: Rows of the implicit system, in the order of the kernel's arithmetic; then its solution from below and back.
_ADVECTION_SQL = """WITH RECURSIVE {lat}, w AS (SELECT i, j, k, value AS u, value / 1000e0 AS w, value / 50e0 AS pos FROM lat),
    n AS (SELECT a.*, e.w AS we, b.u AS ub, t.u AS ut, t.w AS wt, te.w AS wte FROM w a JOIN w e ON e.i = a.i + 1 AND e.j = a.j AND e.k = a.k
        LEFT JOIN w b ON b.i = a.i AND b.j = a.j AND b.k = a.k - 1 LEFT JOIN w t ON t.i = a.i AND t.j = a.j AND t.k = a.k + 1
        LEFT JOIN w te ON te.i = a.i + 1 AND te.j = a.j AND te.k = a.k + 1),
    p AS (SELECT *, CASE WHEN k = 0 THEN 0e0 ELSE -0.25e0 * (we + w) END AS down, CASE WHEN k = 6 THEN 0e0 ELSE 0.25e0 * (wte + wt) END AS up, 0.15e0 * pos + 0.5e0 + 0.25e0 AS known FROM n),
    q AS (SELECT *, CASE WHEN k = 0 THEN known ELSE known - down * 0.5e0 * (ub - u) END AS known1 FROM p),
    s AS MATERIALIZED (SELECT i, j, k, pos, down * 0.5e0 AS inf, 0.15e0 - down * 0.5e0 - up * 0.5e0 AS diag, up * 0.5e0 AS sup, CASE WHEN k = 6 THEN known1 ELSE known1 - up * 0.5e0 * (ut - u) END AS rhs FROM q),
    f(i, j, k, pos, c, d) AS (SELECT i, j, k, pos, sup / diag, rhs / diag FROM s WHERE k = 0
        UNION ALL SELECT a.i, a.j, a.k, a.pos, a.sup / (a.diag - f.c * a.inf), (a.rhs - a.inf * f.d) / (a.diag - f.c * a.inf) FROM f JOIN s a ON a.i = f.i AND a.j = f.j AND a.k = f.k + 1),
    b(i, j, k, pos, x) AS (SELECT i, j, k, pos, d FROM f WHERE k = 6 UNION ALL SELECT f.i, f.j, f.k, f.pos, f.d - f.c * b.x FROM b JOIN f ON f.i = b.i AND f.j = b.j AND f.k = b.k - 1)
    SELECT i, j, k, 0.15e0 * (x - pos) AS utens_out FROM b"""
ORACLE_SQL["vertical_advection"] = _ADVECTION_SQL.replace("{lat}", _lat_sql())


@query(_ADVECTION_SQL)
def fn_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a forward scan of pairs that reads at i + 1 and k + 1, and a backward scan over its result."""
    dtr = 3.0 / 20.0

    def row(below: bool, above: bool):
        def step(acc, u, w, pos):
            down = -0.25 * (deref(shift(w, "i", 1)) + deref(w)) if below else expr.Const(0.0)
            up = 0.25 * (deref(shift(w, "i", 1, "k", 1)) + deref(shift(w, "k", 1))) if above else expr.Const(0.0)
            rhs = dtr * deref(pos) + 0.5 + 0.25
            if below:
                rhs = rhs - down * 0.5 * (deref(shift(u, "k", -1)) - deref(u))
            if above:
                rhs = rhs - up * 0.5 * (deref(shift(u, "k", 1)) - deref(u))
            diag = dtr - down * 0.5 - up * 0.5
            if not below:
                return up * 0.5 / diag, rhs / diag
            left = diag - acc[0] * (down * 0.5)
            return up * 0.5 / left, (rhs - down * 0.5 * acc[1]) / left

        return step

    domain = mesh.cartesian_domain({"i": N - 1, "j": N, "k": NK})
    df = lat(spark, sf_dir).withColumns({"wcon": F.col("value") / 1000, "u_pos": F.col("value") / 50})
    seed = F.struct(F.lit(0.0).alias("_0"), F.lit(0.0).alias("_1"))
    passes = [fn.ScanPass(row(*sides)) for sides in ((True, True), (False, True), (True, False))]
    df = fn.column_executor(df, domain, seed, ("value", "wcon", "u_pos"), passes[0], "cd", prologue=(passes[1],), epilogue=(passes[2],), width=2)
    back = fn.ScanPass(lambda x, cd: deref(cd)["_1"] - deref(cd)["_0"] * x)
    out = fn.column_executor(df, domain, F.lit(0.0), ("cd",), back, "x", backward=True, prologue=(fn.ScanPass(lambda x, cd: deref(cd)["_1"]),))
    return out.select("i", "j", "k", (F.lit(dtr) * (F.col("x") - F.col("u_pos"))).alias("utens_out"))


_NABLA_SQL = f"""WITH {{lat}}, {_E2V}, {_V2E}, f AS (SELECT (i + j * 10)::int AS vertex, k, value FROM lat),
    z AS (SELECT edge, a.k, (a.value + b.value) / 2e0 * ((edge + a.k) % 17) AS x, (a.value + b.value) / 2e0 * ((edge + a.k) % 7) AS y FROM e2v JOIN f a ON a.vertex = v[1] JOIN f b ON b.vertex = v[2] AND b.k = a.k),
    s AS (SELECT *, [0, 1, vertex % 2, 1, (vertex + 1) % 2, 0][n + 1]::double AS s FROM v2e)
    SELECT vertex, k, sum(s * x) / (vertex % 13 + 1) AS x, sum(s * y) / (vertex % 13 + 1) AS y FROM s JOIN z USING (edge) GROUP BY vertex, k"""


def _nabla(spark: SparkSession, sf_dir: str) -> tuple[mesh.Domain, dict[str, DataFrame]]:
    vertices = lat(spark, sf_dir).select((F.col("i") + F.col("j") * N).alias("vertex"), "k", F.col("value").alias("pp"))
    v = F.col("vertex")
    sign = F.array(*(x.cast("double") for x in (F.lit(0), F.lit(1), v % 2, F.lit(1), (v + 1) % 2, F.lit(0))))
    vertices = vertices.withColumns({"sign": sign, "vol": (v % 13 + 1).cast("double")})
    edges = edges_to_vertices(spark).select(F.col("index").alias("edge")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(NK - 1))))
    turned = F.struct(((F.col("edge") + F.col("k")) % 17).cast("double").alias("x"), ((F.col("edge") + F.col("k")) % 7).cast("double").alias("y"))
    domain = mesh.unstructured_domain({"vertex": N * N, "k": NK}, v2e=vertices_to_edges(spark), e2v=edges_to_vertices(spark))
    return domain, {"vertex": vertices, "edge": edges.withColumn("s", turned)}


def _around(vol, sign, at) -> tuple:
    """Sums over the six places around a vertex of at(place), a pair, with signs; missing edges count nothing."""
    pairs = [at(n) for n in range(6)]
    return tuple(sum((deref(sign)[n] * p[d] for n, p in enumerate(pairs)), expr.Const(0.0)) / deref(vol) for d in (0, 1))


@query(_NABLA_SQL)
def fn_nabla_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages on edges as a field of pairs, then signed sums of them around each vertex."""
    domain, fields = _nabla(spark, sf_dir)
    on_edges = mesh.unstructured_domain({"edge": 3 * N * N, "k": NK}, **domain.connectivities)

    def average(pp, s):
        half = (deref(shift(pp, "e2v", 0)) + deref(shift(pp, "e2v", 1))) / 2.0
        return expr.struct(half * deref(s)["x"], half * deref(s)["y"])

    fields["edge"] = fn.MeshExecutor(on_edges, "edge", fields).assign("zavg", average, "pp", "s").execute()

    def nabla(zavg, sign, vol):
        def pair(n):
            z = shift(zavg, "v2e", n)
            return tuple(where(can_deref(z), deref(z)[f"_{d}"], 0.0) for d in (0, 1))

        return _around(vol, sign, pair)

    return fn.MeshExecutor(domain, "vertex", fields).assign(("x", "y"), nabla, "zavg", "sign", "vol").execute().select("vertex", "k", "x", "y")


@query(_NABLA_SQL)
def fn_nabla_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one stencil with two hops."""
    domain, fields = _nabla(spark, sf_dir)

    def nabla(sign, vol, pp, s):
        def pair(n):
            edge = shift(s, "v2e", n)
            half = (deref(shift(pp, "v2e", n, "e2v", 0)) + deref(shift(pp, "v2e", n, "e2v", 1))) / 2.0
            return tuple(where(can_deref(edge), half * deref(edge)[d], 0.0) for d in ("x", "y"))

        return _around(vol, sign, pair)

    return fn.MeshExecutor(domain, "vertex", fields).assign(("x", "y"), nabla, "sign", "vol", "pp", "s").execute().select("vertex", "k", "x", "y")


@query("WITH {lat}, m AS (SELECT i, j, max(value) AS seed FROM lat GROUP BY i, j) SELECT i, j, k, value, seed + sum(value) OVER (PARTITION BY i, j ORDER BY k DESC) AS down, seed + sum(value) OVER (PARTITION BY i, j) AS last FROM lat JOIN m USING (i, j)")
def merged_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold, then a backward scan that begins with its accumulator, in one exchange."""
    most = mesh.ColumnStage(mesh.Fold(lambda a, x: F.greatest(a, x["value"])), seed=F.lit(0.0))
    down = mesh.ColumnStage(mesh.Scan(lambda a, x: a + x["value"]), "down", backward=True)
    return mesh.merged_columns(lat(spark, sf_dir), ["i", "j"], "k", ["value"], [most, down], "last")


@query(f"""WITH {{lat}}, {_E2V}, {_V2E}, p AS (SELECT (i + j * 10)::int AS vertex, n.n::int AS n, value FROM lat, range(6) n(n) WHERE k = 1)
    SELECT vertex, value, n AS place, coalesce(edge, -1)::int AS edge, edge IS NOT NULL AS there FROM p LEFT JOIN v2e USING (vertex, n)""")
def neighbor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of any names taken as a connectivity, along which a field's points move, and which of its places can be read."""
    table = mesh.as_neighbor_table(vertices_to_edges(spark).toDF("vertex", "place", "edge"), "vertex", "place", "edge")
    points = lat(spark, sf_dir).where("k = 1").select((F.col("i") + F.col("j") * N).alias("vertex"), "value")
    return mesh.hop(points, "vertex", table, to="edge", order="place").select("vertex", "value", "place", "edge", mesh.can_deref("edge").alias("there"))


# --- icosahedral stages, and the pairs of locations without a query so far


@query(f"WITH {{lat}}, {_CELLS}, {_VERTICES} SELECT i, j, k, c, coalesce(s, 0) AS s FROM cells LEFT JOIN {_ico_sql('cells', 'vertices', 'x.u * (x.i + 1)', 's')} USING (i, j, k, c)")
def ico_vertices_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _located(spark, sf_dir, "vertices").withColumn("u", F.col("u") * (F.col("i") + 1))
    return icosahedral.fold_neighbors(_located(spark, sf_dir, "cells").select("i", "j", "k", "c"), "cells", "vertices", vertices, ["u"], F.lit(0.0), lambda a, x: a + x["u"], "s")


@query(f"WITH {{lat}}, {_CELLS}, {_VERTICES} SELECT i, j, k, c, s FROM {_ico_sql('vertices', 'cells', '(n + 1) * x.u', 's')}")
def ico_cells_of_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighed by their places, so that their order counts."""
    return icosahedral.fold_neighbors(_located(spark, sf_dir, "vertices").select("i", "j", "k", "c"), "vertices", "cells", _located(spark, sf_dir, "cells"), ["u"], F.lit(0.0), lambda a, x: a + (x["n"] + 1) * x["u"], "s")


@query(f"WITH {{lat}}, {_VERTICES} SELECT i, j, k, c, s FROM {_ico_sql('vertices', 'vertices', '(n + 1) * x.u', 's')}")
def ico_neighbors_of_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _located(spark, sf_dir, "vertices")
    return icosahedral.fold_neighbors(vertices.select("i", "j", "k", "c"), "vertices", "vertices", vertices, ["u"], F.lit(0.0), lambda a, x: a + (x["n"] + 1) * x["u"], "s")


@query(f"""WITH {{lat}}, {_CELLS}, {_EDGES}, t AS (SELECT * FROM {_ico_sql('edges', 'cells', '(n + 1) * x.u', 't')}), e AS (SELECT t.*, edges.r FROM t JOIN edges USING (i, j, k, c)),
    o AS (SELECT * FROM {_ico_sql('cells', 'edges', 'x.t', 'o', table='e')})
    SELECT i, j, k, c, CASE WHEN i BETWEEN 2 AND 7 AND j BETWEEN 2 AND 7 THEN o + c ELSE -1e0 END AS out FROM cells LEFT JOIN o USING (i, j, k, c)""")
def ico_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages with a temporary on edges, which the first computes as far beyond the box as the second reads."""
    cells = _located(spark, sf_dir, "cells").withColumn("out", F.lit(-1.0))
    first = icosahedral.Stage("edges", lambda at: {"t": at.fold("cells", lambda a, x: a + (x["n"] + 1) * x["u"], F.lit(0.0))}, ("t",), {"cells": ("u",)})
    second = icosahedral.Stage("cells", lambda at: {"out": at.fold("edges", lambda a, x: a + x["t"], F.lit(0.0)) + at.color}, ("out",), {"edges": ("t",)})
    spec = icosahedral.IcosahedralSpec((first, second), {"t": ("edges", "double")})
    return icosahedral.run(spec, ((2, 7), (2, 7)), {"cells": cells, "edges": _located(spark, sf_dir, "edges")})["cells"].select("i", "j", "k", "c", "out")


# --- types, functions and the rest of the model


@query("WITH {lat}, x AS (SELECT i, j, k, value / 1000 AS a FROM lat) SELECT i, j, k, abs(a - 1) AS away, sqrt(a) AS root, round(exp(a), 9) AS e, CASE WHEN a > 0 THEN round(ln(a), 9) ELSE '-inf'::double END AS l, round(pow(a, 1.5e0), 9) AS p, round(sin(a), 9) AS s, round(cos(a), 9) AS c FROM x")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stencil's expressions; those that libraries round differently to nine digits."""
    df = lat(spark, sf_dir).withColumn("a", F.col("value") / 1000)
    forms = {"away": lambda a: expr.fabs(a - 1), "root": expr.sqrt, "e": expr.exp, "l": expr.log, "p": lambda a: expr.power(a, 1.5), "s": expr.sin, "c": expr.cos}
    own = Operator(lambda a: {n: f(a()) for n, f in forms.items()}, a=in_(), **{n: inout() for n in forms})
    ran = stencil.run_single_stage(own, make_grid(N, N, NK), df.withColumns({n: F.lit(0.0) for n in forms}), a="a", **{n: n for n in forms})
    exact = {"away", "root"}
    return ran.select("i", "j", "k", *(F.col(n) if n in exact else F.when(F.abs(n) == float("inf"), F.col(n)).otherwise(F.round(n, 9)).alias(n) for n in forms))


@query("WITH {lat} SELECT min(value) FILTER (k > 0) AS least, max(value) FILTER (k > 0) AS most, 7e0 AS none FROM lat")
def nan_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaNs are passed over; a field of NaNs alone gives the neutral element."""
    df = lat(spark, sf_dir).withColumns({"v": F.when(F.col("k") > 0, F.col("value")).otherwise(F.lit(float("nan"))), "none": F.lit(float("nan"))})
    parts = [reduction.make_reducible(df, c, 7.0).reduce(how).withColumnRenamed("value", name) for c, how, name in (("v", "min", "least"), ("v", "max", "most"), ("none", "max", "none"))]
    return src.zip_fields(*parts)


@query(f"""WITH {{lat}}, {_BLOCKS_SQL} SELECT bi, bj, bk, b.i, b.j, b.k, v.value AS wide, CASE WHEN b.i BETWEEN 0 AND 5 AND b.j BETWEEN 1 AND 6 THEN v.value END AS narrow
    FROM blocks b LEFT JOIN lat v ON v.i = (gi + 8) % 8 AND v.j = gj AND v.k = b.k""", 8)
def halos_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields with halos of different widths in one exchange."""
    narrow = (Halo(1, 1, 1, 4, 7), Halo(1, 1, 2, 5, 7), _BLOCK[2])
    df = _blocks(spark, sf_dir).withColumn("narrow", F.col("value")).withColumnRenamed("value", "wide")
    return halo.exchange(df, ["wide", "narrow"], {"wide": _BLOCK, "narrow": narrow}, (2, 2, 1), (True, False, False))


@query(f"""WITH {{lat}}, {_BLOCKS_SQL}
    SELECT bi, bj, bk, b.i, b.j, b.k, coalesce(v.value, (b.i + b.j + b.k)::double) AS value, (b.i + b.j + b.k)::double AS given FROM blocks b LEFT JOIN lat v ON v.i = (gi + 8) % 8 AND v.j = gj AND v.k = b.k""", 8)
def associated_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that copies an associated field, which is not exchanged itself."""
    df = _blocks(spark, sf_dir).withColumn("given", (F.col("i") + F.col("j") + F.col("k")).cast("double"))
    bounds = boundary.DistributedBoundaries(_BLOCK, (2, 2, 1), (True, False, False), 3)
    return bounds.exchange(df, boundary.bind_bc(boundary.copy_boundary("given", "value"), "value").associate("given"))


@query("SELECT (l_suppkey % 10)::int AS i, arg_max(l_quantity::bigint, l_orderkey::bigint * 10 + l_linenumber) AS q FROM lineitem GROUP BY 1")
def atomic_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each cell stays."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.select((F.col("l_suppkey") % 10).cast("int").alias("i"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("at"))
    return reduction.scatter(rows, ["i"], "q", "exch", "at")


@query("WITH {lat} SELECT i, j, k, CASE WHEN k BETWEEN 1 AND 5 THEN value WHEN k = 6 THEN 2 * value ELSE 0e0 END AS out, 1::int AS first, 5::int AS size, 5::int AS back FROM lat")
def interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals made by concat, enclosing and shift; first level and size of one in both directions."""
    axis = Axis(2, 3, 2)
    grid = make_grid(N, N, axis)
    lower = axis.interval(0).last_level().concat(axis.interval(1)).enclosing(Interval(Level(2, 1), Level(2, 1)))
    top = Interval(Level(2, 1), Level(2, 1)).shift(1)
    own = Operator({lower: lambda inp, out: {"out": inp()}, top: lambda inp, out: {"out": 2 * inp()}}, inp=in_(), out=inout())
    df = stencil.run(execute_parallel().stage(own, inp="value", out="out"), grid, lat(spark, sf_dir).withColumn("out", F.lit(0.0)))
    return df.select("i", "j", "k", "out", F.lit(grid.k_start(lower)).alias("first"), F.lit(grid.k_size(lower)).alias("size"), F.lit(grid.k_start(lower, backward=True)).alias("back"))


@query("""WITH {lat}, s AS (SELECT * FROM (VALUES (0, 'lap', -1, 1, -1, 1), (1, 'flx', -1, 0, 0, 0), (2, 'fly', 0, 0, -1, 0), (3, 'out', 0, 0, 0, 0)) t(stage, writes, i_low, i_high, j_low, j_high))
    SELECT s.*, count(*) AS cells, sum(value) AS total FROM s JOIN lat ON i BETWEEN 2 + i_low AND 7 + i_high AND j BETWEEN 2 + j_low AND 7 + j_high GROUP BY ALL""")
def plan_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of horizontal diffusion, how far each computes beyond the box by the plan's JSON, and the cells of the lattice that it so computes."""
    kinds = "struct<multistages: array<struct<stages: array<struct<extent: struct<i: array<int>, j: array<int>>, fields: map<string, string>>>>>>"
    plan = F.from_json(F.lit(kernels.horizontal_diffusion().explain_json(_box(2))), kinds)
    rows = lat(spark, sf_dir).select("i", "j", "value", F.posexplode(F.flatten(plan["multistages"]["stages"])).alias("stage", "s"))
    ends = [F.get(f"s.extent.{d}", F.lit(n)).alias(f"{d}_{side}") for d in "ij" for n, side in enumerate(("low", "high"))]
    rows = rows.select("i", "j", "value", "stage", F.col("s.fields")["out"].alias("writes"), *ends).where("i between 2 + i_low and 7 + i_high and j between 2 + j_low and 7 + j_high")
    return rows.groupBy("stage", "writes", "i_low", "i_high", "j_low", "j_high").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query("WITH {lat} SELECT i, j, k, (value::float / 7::float + 0.1::float) * value::float AS windows, (value::float / 7::float + 0.1::float) * value::float AS blocks, (i::bigint << 56) + j AS wide FROM lat")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats stay floats in both strategies, temporaries too; a temporary of whole numbers keeps all their bits."""
    df = lat(spark, sf_dir).withColumns({"v": F.col("value").cast("float"), "windows": F.lit(0.0).cast("float"), "blocks": F.lit(0.0).cast("float"), "n": F.shiftleft(F.col("i").cast("long"), 56) + F.col("j"), "wide": F.lit(0).cast("long")})
    first = Operator(lambda v, n, t, w: {"t": v() / 7.0 + 0.1, "w": n()}, v=in_(), n=in_(), t=inout(), w=inout())
    second = Operator(lambda v, t, w, out, wide: {"out": t() * v(), "wide": w()}, v=in_(), t=in_(), w=in_(), out=inout(), wide=inout())
    for strategy in ("windows", "blocks"):
        spec = multi_pass(execute_parallel().stage(first, v="v", n="n", t="t", w="w").stage(second, v="v", t="t", w="w", out=strategy, wide="wide"), temps={"t": "float", "w": "bigint"})
        df = stencil.run(spec, make_grid(N, N, NK), df, strategy=strategy)
    return df.select("i", "j", "k", "windows", "blocks", "wide")


@query("WITH {lat} SELECT i, j, k, value AS c_order, value AS f_order FROM lat")
def buffer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as numpy arrays of both orders and back; arrays are the driver's own, and as small as they are."""
    import numpy as np

    a = src.to_numpy(lat(spark, sf_dir))
    return src.zip_fields(src.from_numpy(spark, a, name="c_order"), src.from_numpy(spark, np.ascontiguousarray(a.transpose(2, 1, 0)), name="f_order", order="F"))


_WLAP = "e.value + w.value - 2e0 * a.value + north * (n.value - a.value) + 0.25e0 * (s.value - a.value)"


@query(f"""WITH {{lat}}, g AS (SELECT *, 0.5e0 + j / 8e0 AS north FROM lat),
    lap AS (SELECT a.i, a.j, a.k, a.value, a.north, {_WLAP.replace('north', 'a.north')} AS lap FROM g a JOIN g e ON e.i = a.i + 1 AND e.j = a.j AND e.k = a.k JOIN g n ON n.i = a.i AND n.j = a.j + 1 AND n.k = a.k
        JOIN g w ON w.i = a.i - 1 AND w.j = a.j AND w.k = a.k JOIN g s ON s.i = a.i AND s.j = a.j - 1 AND s.k = a.k)
    SELECT a.i, a.j, a.k, a.value + (((a.lap - w.lap) - (e.lap - a.lap)) + (a.north * (a.lap - s.lap) - a.north * (n.lap - a.lap))) * 0.125e0 AS out FROM lap a
        JOIN lap e ON e.i = a.i + 1 AND e.j = a.j AND e.k = a.k JOIN lap n ON n.i = a.i AND n.j = a.j + 1 AND n.k = a.k JOIN lap w ON w.i = a.i - 1 AND w.j = a.j AND w.k = a.k JOIN lap s ON s.i = a.i AND s.j = a.j - 1 AND s.k = a.k""")
def simple_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that vary along j."""
    df = lat(spark, sf_dir).withColumns({"north": 0.5 + F.col("j") / 8.0, "south": F.lit(0.25), "coeff": F.lit(0.125), "out": F.lit(0.0)})
    return _inner(stencil.run(kernels.simple_diffusion(), _box(2), df), 2).select("i", "j", "k", "out")


@query(f"WITH {{lat}} SELECT i, j, k, {', '.join(f'(i + 1) * (value + {n}) AS o{n}' for n in range(11))} FROM lat")
def prepare_tracers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven tracers times a density that all share."""
    df = lat(spark, sf_dir).withColumns({f"t{n}": F.col("value") + n for n in range(11)} | {f"o{n}": F.lit(0.0) for n in range(11)} | {"density": (F.col("i") + 1).cast("double")})
    spec = lambda f: execute_parallel().stage(kernels.prepare_tracer, inp=f["inp"], density="density", out=f["out"])
    ran = stencil.expandable_run(spec, 2, make_grid(N, N, NK), df, {"inp": [f"t{n}" for n in range(11)], "out": [f"o{n}" for n in range(11)]})
    return ran.select("i", "j", "k", *(f"o{n}" for n in range(11)))


# --- ordered multistages in the JVM, tables that lack points, blocks over many steps, chains of icosahedral stages


@query(ORACLE_SQL["tridiagonal"])
def tridiagonal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sweeps as folds of packed columns, without Python."""
    grid = make_grid(N, N, NK)
    df = lat(spark, sf_dir).withColumns({"inf": F.lit(-1.0), "diag": F.lit(3.0), "sup": F.lit(1.0), "out": F.lit(0.0)})
    return stencil.run(kernels.tridiagonal(grid, rhs="value"), grid, df, strategy="columns").select("i", "j", "k", "out")


@query(ORACLE_SQL["whole_axis"])
def whole_axis_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = Axis(NK).full()
    step = Operator({full.first_level(): lambda inp, out: {"out": 0.0}, full.modify(1, 0): lambda inp, out: {"out": out(k=-1) + inp(k=-1)}}, inp=in_(k=(-1, 0)), out=inout(k=(-1, 0)))
    df = lat(spark, sf_dir).withColumn("out", F.lit(0.0))
    return stencil.run(execute_forward().stage(step, inp="value", out="out"), make_grid(N, N, NK), df, strategy="columns").select("i", "j", "k", "out")


@query(ORACLE_SQL["vertical_advection"])
def vertical_advection_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parallel stage by windows, two sweeps as folds, and a parallel stage, in one exchange."""
    grid = make_grid(Halo(0, 1, 0, N - 2, N), N, NK)
    df = lat(spark, sf_dir).withColumns({"wcon": F.col("value") / 1000, "u_pos": F.col("value") / 50, "utens": F.lit(0.5), "utens_stage": F.lit(0.25), "utens_out": F.lit(0.0)})
    return stencil.run(kernels.vertical_advection(grid, u_stage="value"), grid, df, strategy="columns").where("i < 9").select("i", "j", "k", "utens_out")


@query("""WITH RECURSIVE {lat}, f(i, j, k, a, b, before) AS (
        SELECT i, j, k, value, value, 0e0 FROM lat WHERE k = 0
        UNION ALL SELECT l.i, l.j, l.k, l.value + 0.5e0 * f.a + f.before, l.value + 0.5e0 * f.a + f.before - f.b, f.a FROM f JOIN lat l ON l.i = f.i AND l.j = f.j AND l.k = f.k + 1)
    SELECT i, j, k, a, b FROM f""")
def interleaved_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages of one forward pass: the second reads what the first wrote at its level, and its own last output; the first reads two levels back."""
    axis = Axis(NK, offset_limit=3)
    full = axis.full()
    low, second, rest = full.first_level(), full.first_level().shift(1), full.modify(2, 0)
    first = Operator({low: lambda v, a: {"a": v()}, second: lambda v, a: {"a": v() + 0.5 * a(k=-1) + 0.0}, rest: lambda v, a: {"a": v() + 0.5 * a(k=-1) + a(k=-2)}}, v=in_(), a=inout(k=(-2, 0)))
    then = Operator({low: lambda a, b: {"b": a()}, full.modify(1, 0): lambda a, b: {"b": a() - b(k=-1)}}, a=in_(), b=inout(k=(-1, 0)))
    spec = execute_forward().stage(first, v="value", a="a").stage(then, a="a", b="b")
    return stencil.run(spec, make_grid(N, N, axis), lat(spark, sf_dir).withColumns({"a": F.lit(0.0), "b": F.lit(0.0)}), strategy="columns").select("i", "j", "k", "a", "b")


def _sparse_sql(n: int = 12, gone: int = 3) -> str:
    """Points of a lattice of n by 10 that lines fall on, less those whose quantities add up to a multiple of `gone`."""
    return f"""lat AS MATERIALIZED (SELECT (l_suppkey % {n})::int AS i, (l_partkey % 10)::int AS j, (l_linenumber - 1)::int AS k, sum(l_quantity::bigint)::double AS value
        FROM lineitem GROUP BY 1, 2, 3 HAVING sum(l_quantity::bigint) % {gone} <> 0)"""


_SPARSE_SQL = _sparse_sql()


def sparse_lat(spark: SparkSession, sf_dir: str, n: int = 12, gone: int = 3) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = rows.groupBy(*(c.cast("int").alias(d) for d, c in zip("ijk", (F.col("l_suppkey") % n, F.col("l_partkey") % 10, F.col("l_linenumber") - 1), strict=True))).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return own.where(F.col("value") % gone != 0).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_SPARSE_SQL} SELECT i, j, k, CASE WHEN i BETWEEN 1 AND 10 AND j BETWEEN 1 AND 8 THEN 4e0 * value - ({_at(1, 0)} + {_at(0, 1)} + {_at(-1, 0)} + {_at(0, -1)}) ELSE -1e0 END AS out FROM lat a")
def sparse_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice with holes, unfilled: null where a neighbour is missing."""
    grid = make_grid(Halo(1, 1, 1, 10, 12), Halo(1, 1, 1, 8, 10), NK)
    spec = execute_parallel().stage(kernels.laplacian, inp="value", out="out")
    return stencil.run(spec, grid, sparse_lat(spark, sf_dir).withColumn("out", F.lit(-1.0)), sparse=True).select("i", "j", "k", "out")


@query(_DIFFUSION_SQL.replace("{coeff}", "0.025e0").replace("{lat}", _sparse_sql(10, 31)))
def sparse_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stages on a lattice with holes, in tiles of 5 by 5; the points where all that they read is there."""
    df = sparse_lat(spark, sf_dir, 10, 31).withColumns({"coeff": F.lit(0.025), "out": F.lit(0.0)})
    out = stencil.run(kernels.horizontal_diffusion(), _box(2), df, tile=(5, 5), sparse=True)
    return _inner(out, 2).where("out is not null").select("i", "j", "k", "out")


@query(f"WITH {_SPARSE_SQL} SELECT a.i, a.j, a.k, a.value - c.value AS out FROM lat a JOIN lat c ON c.i = a.i - 1 AND c.j = a.j + 1 AND c.k = a.k + 1")
def sparse_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read at a corner of another level, whatever lies between."""
    own = Operator(lambda v, out: {"out": v() - v(i=-1, j=1, k=1)}, v=in_(i=(-1, 0), j=(0, 1), k=(0, 1)), out=inout())
    df = sparse_lat(spark, sf_dir).withColumn("out", F.lit(None).cast("double"))
    return stencil.run(execute_parallel().stage(own, v="value", out="out"), make_grid(12, 10, NK), df, tile=(4, 4), sparse=True).where("out is not null").select("i", "j", "k", "out")


def _steps_sql(count: int) -> str:
    step = """s{m} AS MATERIALIZED (SELECT a.i, a.j, a.k, CASE WHEN a.j BETWEEN 1 AND 8 THEN a.value + 0.125e0 * (e.value + n.value + w.value + s.value - 4e0 * a.value) ELSE a.value END AS value FROM s{l} a
        LEFT JOIN s{l} e ON e.i = (a.i + 1) % 10 AND e.j = a.j AND e.k = a.k LEFT JOIN s{l} n ON n.i = a.i AND n.j = a.j + 1 AND n.k = a.k
        LEFT JOIN s{l} w ON w.i = (a.i + 9) % 10 AND w.j = a.j AND w.k = a.k LEFT JOIN s{l} s ON s.i = a.i AND s.j = a.j - 1 AND s.k = a.k)"""
    return f"WITH {{lat}}, s0 AS (SELECT * FROM lat), {', '.join(step.format(l=n, m=n + 1) for n in range(count))} SELECT i, j, k, value FROM s{count}"


@query(_steps_sql(6))
def stepped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six steps of diffusion, periodic along i, in blocks that stay where they are: only border strips move."""
    own = Operator(lambda v, out: {"out": v() + 0.125 * (v(i=1) + v(j=1) + v(i=-1) + v(j=-1) - 4.0 * v())}, v=in_(i=(-1, 1), j=(-1, 1)), out=inout())
    start = blocks.Blocks.of(lat(spark, sf_dir).withColumn("next", F.col("value")), blocks.Layout((5, 5, NK), (2, 2, 1), ((1, 1), (1, 1), (0, 0)), (True, False, False)), ("value",))
    return start.march(execute_parallel().stage(own, v="value", out="next"), make_grid(N, Halo(1, 1, 1, N - 2, N), NK), 6, {"value": "next"}).rows().select("i", "j", "k", "value")


def _fused_sql() -> str:
    """Sums over neighbours from cells to edges to vertices to edges to cells; each table has the sums of the one before."""
    a, b, c, d = (_ico_sql(source, target, "x.s", "s", table=f"s{n}") for n, (source, target) in enumerate((("edges", "cells"), ("vertices", "edges"), ("edges", "vertices"), ("cells", "edges"))))
    return f"""WITH {{lat}}, {_CELLS}, {_EDGES}, {_VERTICES}, s0 AS (SELECT *, u AS s FROM cells), s1 AS (SELECT * FROM {a}), s2 AS (SELECT * FROM {b}), s3 AS (SELECT * FROM {c}), s4 AS (SELECT * FROM {d})
        SELECT i, j, k, c, CASE WHEN i BETWEEN 4 AND 5 AND j BETWEEN 4 AND 5 THEN s4.s ELSE -1e0 END AS out FROM cells LEFT JOIN s4 USING (i, j, k, c)"""


@query(_fused_sql())
def ico_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of four stages over all three locations in one exchange; three write temporaries as far beyond the box as those after them read."""
    chain = [("edges", "cells", "u", "t1"), ("vertices", "edges", "t1", "t2"), ("edges", "vertices", "t2", "t3"), ("cells", "edges", "t3", "out")]
    stages = tuple(icosahedral.Stage(at, lambda p, f=f, r=r, to=to: {to: p.fold(f, lambda a, x: a + x[r], F.lit(0.0))}, (to,), {f: (r,)}) for at, f, r, to in chain)
    spec = icosahedral.IcosahedralSpec(stages, {"t1": ("edges", "double"), "t2": ("vertices", "double"), "t3": ("edges", "double")})
    tables = {where: _located(spark, sf_dir, where) for where in icosahedral.COLORS}
    tables["cells"] = tables["cells"].withColumn("out", F.lit(-1.0))
    return icosahedral.run(spec, ((4, 5), (4, 5)), tables)["cells"].select("i", "j", "k", "c", "out")


@query(f"""WITH {{lat}}, {_CELLS}, {_VERTICES}, a AS (SELECT * FROM {_ico_sql('cells', 'vertices', 'x.u', 's')}), b AS (SELECT * FROM {_ico_sql('cells', 'vertices', 'x.u * x.len', 's')})
    SELECT i, j, k, c, coalesce(a.s, 0) AS p, coalesce(b.s, 0) AS q FROM cells LEFT JOIN a USING (i, j, k, c) LEFT JOIN b USING (i, j, k, c)""")
def ico_expandable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stages over two fields, with a temporary for each."""
    vertices = _located(spark, sf_dir, "vertices").withColumn("w", F.col("u") * F.col("len"))
    cells = _located(spark, sf_dir, "cells").withColumns({"p": F.lit(0.0), "q": F.lit(0.0)})

    def spec(f):
        copy = icosahedral.Stage("vertices", lambda at: {f["t"]: at(f["v"])}, (f["t"],))
        add = icosahedral.Stage("cells", lambda at: {f["out"]: at.fold("vertices", lambda a, x: a + x[f["t"]], F.lit(0.0))}, (f["out"],), {"vertices": (f["t"],)})
        return icosahedral.IcosahedralSpec((copy, add), {f["t"]: ("vertices", "double")})

    ran = icosahedral.expandable_run(spec, ((0, N), (0, N)), {"cells": cells, "vertices": vertices}, {"v": ["u", "w"], "t": ["t1", "t2"], "out": ["p", "q"]})
    return ran["cells"].select("i", "j", "k", "c", "p", "q")


# --- columns longer than a task should hold


@query("SELECT o_orderkey, (sum(o_custkey) OVER w)::bigint AS total, max(o_custkey) OVER w AS most FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def long_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one column, scanned in chunks: a running sum and a running greatest value."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    both = longcolumns.Monoid("struct<s: bigint, m: bigint>", F.struct(F.lit(0).alias("s"), F.lit(0).alias("m")), lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), F.greatest(a["m"], b["m"]).alias("m")))
    ran = longcolumns.blocked_scan(rows, [], "o_orderkey", F.struct(F.col("o_custkey").alias("s"), F.col("o_custkey").alias("m")), both, "r", 256)
    return ran.select("o_orderkey", F.col("r.s").alias("total"), F.col("r.m").alias("most"))


@query("""WITH RECURSIVE {lat}, f(i, j, k, x) AS (SELECT i, j, k, value FROM lat WHERE k = 0 UNION ALL SELECT a.i, a.j, a.k, 0.5e0 * f.x + a.value FROM f JOIN lat a ON a.i = f.i AND a.j = f.j AND a.k = f.k + 1)
    SELECT i, j, k, x FROM f""")
def affine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = x / 2 + value up each column, as maps that are composed in chunks of two."""
    step = F.struct(F.lit(0.5).alias("a"), F.col("value").alias("b"))
    return longcolumns.blocked_scan(lat(spark, sf_dir), ["i", "j"], "k", step, longcolumns.affine(), "f", 2).select("i", "j", "k", F.col("f.b").alias("x"))


@query("""WITH RECURSIVE {lat}, r AS MATERIALIZED (SELECT (i * 10 + j) * 7 + k AS p, value AS d, -1e0 - k / 16e0 AS a, 3e0 + i / 8e0 AS b, 1e0 - j / 16e0 AS c FROM lat),
    f(p, u, v) AS (SELECT p, c / b, d / b FROM r WHERE p = 0 UNION ALL SELECT r.p, r.c / (r.b - r.a * f.u), (r.d - r.a * f.v) / (r.b - r.a * f.u) FROM f JOIN r ON r.p = f.p + 1),
    b(p, x) AS (SELECT p, v FROM f WHERE p = 699 UNION ALL SELECT f.p, f.v - f.u * b.x FROM b JOIN f ON f.p = b.p - 1)
    SELECT p, round(x, 6) AS x FROM b""")
def long_tridiagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as one column and one system, solved in chunks of 64."""
    row = lat(spark, sf_dir).select(((F.col("i") * 10 + F.col("j")) * 7 + F.col("k")).alias("p"), F.col("value").alias("d"), (-1 - F.col("k") / 16).alias("a"), (3 + F.col("i") / 8).alias("b"), (1 - F.col("j") / 16).alias("c"))
    return longcolumns.blocked_tridiagonal(row, [], "p", "a", "b", "c", "d", "x", 64).select("p", F.round("x", 6).alias("x"))


# --- offsets that are data


_INDEXED_SQL = """WITH {lat}, o AS (SELECT *, ((i + 2 * j + 3 * k) % 5) - 2 AS by FROM lat)
    SELECT a.i, a.j, a.k, coalesce(b.value, -1e0) + coalesce(c.value, -2e0) AS out FROM o a LEFT JOIN lat b ON b.i = a.i AND b.j = a.j AND b.k = a.k + a.by
        LEFT JOIN lat c ON c.i = a.i + 1 AND c.j = a.j AND c.k = a.k + 1 - a.by WHERE a.i < 9"""


def _with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lat(spark, sf_dir).withColumns({"by": ((F.col("i") + 2 * F.col("j") + 3 * F.col("k")) % 5 - 2).cast("double"), "out": F.lit(0.0)})


def _or(value, other: float):
    """A value, or another where it is beyond the column: null there, or NaN in numpy, equals nothing."""
    return where(expr.equal(value, value), value, other)


@query(_INDEXED_SQL)
def indexed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that reads as many levels away as another field says, here and at i + 1."""
    own = Operator(lambda v, by, out: {"out": _or(v(k=by()), -1.0) + _or(v.at(k=1)(i=1, k=-by()), -2.0)}, v=in_(i=(0, 1), k=(0, 1)), by=in_(), out=inout())
    ran = stencil.run(execute_parallel().stage(own, v="value", by="by", out="out"), make_grid(Halo(0, 1, 0, N - 2, N), N, NK), _with_offsets(spark, sf_dir))
    return ran.where("i < 9").select("i", "j", "k", "out")


@query(_INDEXED_SQL)
def fn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by iterators, one of which is shifted by what another reads."""
    stencil_ = lambda v, by: _or(deref(shift(v, "k", deref(by))), -1.0) + _or(deref(shift(v, "i", 1, "k", 1, "k", -deref(by))), -2.0)
    domain = mesh.cartesian_domain({"i": N - 1, "j": N, "k": NK})
    return fn.CartesianExecutor(domain, _with_offsets(spark, sf_dir)).assign("out", stencil_, "value", "by").execute().where("i < 9").select("i", "j", "k", "out")


@query("""WITH RECURSIVE {lat}, o AS MATERIALIZED (SELECT a.i, a.j, a.k, coalesce(b.value, 0e0) AS v FROM lat a LEFT JOIN lat b ON b.i = a.i AND b.j = a.j AND b.k = a.k + ((a.i + 2 * a.j + 3 * a.k) % 5) - 2),
    f(i, j, k, x) AS (SELECT i, j, k, v FROM o WHERE k = 0 UNION ALL SELECT o.i, o.j, o.k, 0.5e0 * f.x + o.v FROM f JOIN o ON o.i = f.i AND o.j = f.j AND o.k = f.k + 1) SELECT i, j, k, x FROM f""")
def fn_indexed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan up each column that adds what another field points to."""
    step = fn.ScanPass(lambda acc, v, by: 0.5 * acc + _or(deref(shift(v, "k", deref(by))), 0.0))
    ran = fn.column_executor(_with_offsets(spark, sf_dir).drop("out"), mesh.cartesian_domain({"i": N, "j": N, "k": NK}), F.lit(0.0), ("value", "by"), step, "x")
    return ran.select("i", "j", "k", "x")


# --- sums that do not depend on the order


@query("""SELECT k, sum(h)::double / 1024 AS total, 1e0 AS apart FROM (SELECT (l_linenumber - 1)::int AS k, (l_quantity::bigint * 1024 + l_orderkey % 1024)::hugeint AS h FROM lineitem) GROUP BY k""")
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of quantities and fractions by line number, and of 2**90 + 1 - 2**90 beside them."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") - 1).cast("int").alias("k"), (F.col("l_quantity").cast("long") + (F.col("l_orderkey") % 1024) / 1024).cast("double").alias("v"))
    total = exact.exact_sum(rows, ["k"], "v", "total")
    ends = rows.select("k").distinct().select("k", F.explode(F.array(F.lit(2.0**90), F.lit(1.0), F.lit(-(2.0**90)))).alias("v"))
    return total.join(exact.exact_sum(ends, ["k"], "v", "apart"), "k").select("k", "total", "apart")


@query("WITH {lat} SELECT sum(value)::double AS value FROM lat")
def exact_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.make_reducible(lat(spark, sf_dir), "value", 0.0).reduce("exact_plus")


# --- columns with neighbours on meshes, and parts of a mesh


@query(f"""WITH RECURSIVE {{lat}}, {_E2V}, {_V2E}, f AS (SELECT (i + j * 10)::int AS vertex, k, value FROM lat),
    s AS MATERIALIZED (SELECT x.vertex, a.k, sum(coalesce(b.value, 0e0)) AS s FROM v2e x JOIN e2v USING (edge) JOIN f a ON a.vertex = x.vertex LEFT JOIN f b ON b.vertex = v[1] AND b.k = a.k + 1 GROUP BY x.vertex, a.k),
    r AS MATERIALIZED (SELECT f.vertex, f.k, f.value, coalesce(s, 0e0) AS s FROM f LEFT JOIN s USING (vertex, k)),
    u(vertex, k, c, d) AS (SELECT vertex, k, 0.25e0, (value + s) / 4e0 FROM r WHERE k = 0 UNION ALL SELECT r.vertex, r.k, 1e0 / (4e0 - u.c), (r.value + r.s - u.d) / (4e0 - u.c) FROM u JOIN r ON r.vertex = u.vertex AND r.k = u.k + 1),
    w(vertex, k, x) AS (SELECT vertex, k, d FROM u WHERE k = 6 UNION ALL SELECT u.vertex, u.k, u.d - u.c * w.x FROM w JOIN u ON u.vertex = w.vertex AND u.k = w.k - 1)
    SELECT vertex, k, x FROM w""")
def mesh_implicit_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system up each vertex's column whose right side reads the columns of the first ends of its edges, a level up."""
    field = lat(spark, sf_dir).select((F.col("i") + F.col("j") * N).alias("vertex"), "k", "value")
    domain = mesh.unstructured_domain({"vertex": N * N, "k": NK}, v2e=vertices_to_edges(spark), e2v=edges_to_vertices(spark))

    def right(v):
        return deref(v) + sum((_or(deref(shift(v, "v2e", n, "e2v", 0, "k", 1)), 0.0) for n in range(6)), expr.Const(0.0))

    def first(acc, v):
        return expr.Const(0.25), right(v) / 4.0

    def up(acc, v):
        return 1.0 / (4.0 - acc[0]), (right(v) - acc[1]) / (4.0 - acc[0])

    solved = fn.mesh_column_executor(domain, "vertex", {"vertex": field}, F.struct(F.lit(0.0).alias("_0"), F.lit(0.0).alias("_1")), ("value",), fn.ScanPass(up), "cd", prologue=(fn.ScanPass(first),), width=2)
    back = fn.ScanPass(lambda x, cd: deref(cd)["_1"] - deref(cd)["_0"] * x)
    return fn.mesh_column_executor(domain, "vertex", {"vertex": solved}, F.lit(0.0), ("cd",), back, "x", backward=True).select("vertex", "k", "x")


@query(f"SELECT * FROM ({_NABLA_SQL}) WHERE vertex % 3 = 0 AND vertex < 50")
def nabla_of_a_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop nabla on some vertices, from tables cut down to these and the points that they read."""
    domain, fields = _nabla(spark, sf_dir)

    def nabla(sign, vol, pp, s):
        def pair(n):
            edge = shift(s, "v2e", n)
            half = (deref(shift(pp, "v2e", n, "e2v", 0)) + deref(shift(pp, "v2e", n, "e2v", 1))) / 2.0
            return tuple(where(can_deref(edge), half * deref(edge)[d], 0.0) for d in ("x", "y"))

        return _around(vol, sign, pair)

    part = fields["vertex"].where("vertex % 3 = 0 and vertex < 50").select(F.col("vertex").alias("id")).distinct()
    return fn.MeshExecutor(domain, "vertex", fields).assign(("x", "y"), nabla, "sign", "vol", "pp", "s").on_part(part).select("vertex", "k", "x", "y")


# --- further parts of the model


@query("WITH {lat} SELECT i, j, k, CASE WHEN i BETWEEN 1 AND 4 THEN value + k END AS a, CASE WHEN i BETWEEN 1 AND 4 THEN value - k END AS b FROM lat")
def merged_stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stencils in one pass over the points, both from the old values."""
    inside = F.col("i").between(1, 4)
    both = mesh.merged_stencil(("a", lambda v, k: F.when(inside, v + k), ("value", "k")), ("b", lambda v, k: F.when(inside, v - k), ("value", "k")))
    return both(lat(spark, sf_dir)).select("i", "j", "k", "a", "b")


@query(f"WITH {{lat}}, {_E2V}, {_V2E} SELECT a.k, sum(CASE WHEN n = 0 THEN 1 ELSE 2 END * a.value) AS total FROM lat a JOIN e2v ON edge = 17 JOIN (SELECT unnest([0, 1]) AS n) t ON v[t.n + 1] = a.i + 10 * a.j GROUP BY a.k")
def one_row_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of one edge, in their order, and a weighed sum of a field over them."""
    ends = mesh.neighbors_of(edges_to_vertices(spark), 17)
    field = lat(spark, sf_dir).select((F.col("i") + F.col("j") * N).alias("neighbor"), "k", "value")
    return ends.join(field, "neighbor").groupBy("k").agg(F.sum((F.col("n") + 1) * F.col("value")).alias("total"))


@query("WITH {lat} SELECT i, j, k, value * 2 AS value FROM lat")
def tuple_to_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis made a tuple of each point, worked on as one, and made an axis again."""
    packed = src.dimension_to_tuple(lat(spark, sf_dir), "k", "value")
    return src.tuple_to_dimension(packed.withColumn("value", F.transform("value", lambda x: x * 2)), "value", "k").select("i", "j", "k", "value")


@query("""WITH {lat} SELECT i, j, k, CASE WHEN i < 2 OR j < 2 THEN -5e0 ELSE value END AS value FROM lat""")
def boundary_of_a_corner_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition on the sides and corners where the block in the first corner of a grid of blocks has no neighbour; the others keep their values."""
    first = boundary.at_edges((0, 0, 0), (2, 2, 1), (False, False, True))
    return boundary.apply_boundary(lat(spark, sf_dir), (_H3, _H3, Halo(0, 0, 0, NK - 1, NK)), {(None, None, None): lambda row: {"value": F.lit(-5.0)}}, first)
