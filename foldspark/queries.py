"""All queries of the library over the test tables, and the SQL twins of those that SQL can express.

Sums of more than two numbers are rounded on both sides: their order, and so
their last digits, is a matter of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import linalg
from .functions.curves import fit_ab
from .functions.hashing import draw_column, draw_sql
from .materialize import materialize
from .operators import affinity, barnes_hut, batches, density, diffusion, edges as E, eigen, epochs, svd, vectors
from .operators.knn import knn
from .plans import distributed, encoder, pipelines
from .plans.params import DiffusionParams, KnnParams, PacmapParams, ParametricParams, PhateParams, TsneParams, UmapParams, densmap_params, densne_params
from .sources import synthetic
from .sources.matrix import embeddings, from_columns, shape, single

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K, PERPLEXITY, PHATE_K, SEED, EPOCH = 15, 30.0, 5, 42, 3
A, B = 1.5, 0.9
N_LANDMARKS = 20


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded as SQL's round does, half away from zero of the number times a power of ten; -0.0 is 0.0.

    Spark's own goes through a decimal for each number, some 2 microseconds, and rounds its shortest digits.
    """
    kinds = dict(df.dtypes)
    columns = columns or tuple(c for c, t in kinds.items() if t == "double")
    return df.withColumns({c: (_round(F.col(c), digits) if kinds[c] == "double" else F.round(c, digits)) + F.lit(0.0) for c in columns})


def _round(x: Column, digits: int) -> Column:
    """Numbers too large to have such digits are only multiplied and divided, as in SQL; infinities and NaN stay."""
    by = F.lit(10.0**digits)
    t = F.abs(x * by)
    down = F.floor(t)
    near = (down + F.when(t - down >= 0.5, 1).otherwise(0)) / by
    return F.when(t < float(1 << 52), F.when(x < 0, -near).otherwise(near)).when(t < float("inf"), x * by / by).otherwise(x)


# SQL parts: (name, body), put together by sql().

def _r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def sql(final: str, *parts: tuple[str, str], recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({b})" for n, b in parts) + "\n" + final


PTS = ("pts", "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
D2 = "list_reduce(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)"
DOT = "list_reduce(list_transform(list_zip({0}.v, {1}.v), lambda p: p[1] * p[2]), lambda x, y: x + y)"
COS = f"1 - {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}))"


def knn_part(k: int, d: str = D2, name: str = "knn", pts: str = "pts") -> tuple[str, str]:
    return name, f"SELECT i, rank::INTEGER AS rank, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.id AS i, b.id AS j, {d} AS d FROM {pts} a JOIN {pts} b ON a.id <> b.id)) WHERE rank <= {k}"


ROWS = ("rws", "SELECT i, list(d ORDER BY rank) AS ds, list(j ORDER BY rank) AS js FROM knn GROUP BY i")
ADJ = ("adj", "SELECT i, js, ds, ds[1] AS rho, list_transform(ds, lambda d: greatest(d - ds[1], 0.0)) AS a FROM rws")
SEARCH = (
    "search",
    f"""SELECT i, a, 0 AS step, 0.0::DOUBLE AS lo, {affinity.OPEN}::DOUBLE AS hi, 1.0::DOUBLE AS mid, false AS done FROM adj
 UNION ALL
 SELECT i, a, step + 1, CASE WHEN done OR found OR val > target THEN lo ELSE mid END, CASE WHEN NOT (done OR found) AND val > target THEN mid ELSE hi END,
        CASE WHEN done OR found THEN mid WHEN val > target THEN (lo + mid) / 2 WHEN hi = {affinity.OPEN}::DOUBLE THEN mid * 2 ELSE (mid + hi) / 2 END, done OR found
 FROM (SELECT *, abs(val - target) < {affinity.TOLERANCE} AS found FROM (
   SELECT *, ln({K}::DOUBLE) AS target, list_reduce(list_transform(a, lambda x: exp(-x * inv)), lambda x, y: x + y) AS val
   FROM (SELECT *, 1.0 / mid AS inv FROM search WHERE step < {affinity.STEPS} AND NOT done)))""",
)
SMOOTH = ("smooth", "SELECT i, arg_max(mid, step) AS sigma FROM search GROUP BY i")
MEMBER = (
    "member",
    "SELECT i, j, CASE WHEN sigma > 0 THEN exp(-greatest(d - rho, 0.0) * (1.0 / sigma)) WHEN greatest(d - rho, 0.0) > 0 THEN 0.0 ELSE 1.0 END AS w FROM (SELECT a.i, unnest(a.js) AS j, unnest(a.ds) AS d, a.rho, s.sigma FROM adj a JOIN smooth s USING (i)) WHERE i <> j",
)


def merged(of: str, name: str, w: str, least: str = "0") -> tuple[str, str]:
    return name, f"SELECT * FROM (SELECT i, j, {w} AS w FROM (SELECT i, j, sum(a) AS a, sum(b) AS b FROM (SELECT i, j, w AS a, 0.0::DOUBLE AS b FROM {of} UNION ALL SELECT j, i, 0.0, w FROM {of}) GROUP BY i, j)) WHERE w > {least}"


UNION = merged("member", "unioned", "a + b - a * b")
GRAPH = ("graph", "SELECT * FROM unioned WHERE w >= (SELECT max(w) FROM unioned) / 500")
UMAP = (PTS, knn_part(K), ROWS, ADJ, SEARCH, SMOOTH, MEMBER, UNION, GRAPH)

TSNE_K = int(3 * PERPLEXITY)
TSNE_ROWS = ("trows", f"SELECT i, list(d ORDER BY rank) AS ds, list(j ORDER BY rank) AS js FROM knn WHERE d >= {E.EPSILON} GROUP BY i")
BETA = (
    "betas",
    f"""SELECT i, ds, 0 AS step, 1.0::DOUBLE AS beta, -1.0::DOUBLE AS lo, -1.0::DOUBLE AS hi, 1.0::DOUBLE AS used, {E.EPSILON}::DOUBLE AS total, false AS done FROM trows
 UNION ALL
 SELECT i, ds, step + 1, CASE WHEN stop THEN beta WHEN diff > 0 THEN CASE WHEN hi < 0 THEN beta * 2 ELSE (beta + hi) / 2 END ELSE CASE WHEN lo < 0 THEN beta / 2 ELSE (beta + lo) / 2 END END,
        CASE WHEN NOT stop AND diff > 0 THEN beta ELSE lo END, CASE WHEN NOT stop AND diff <= 0 THEN beta ELSE hi END, beta, tot, stop
 FROM (SELECT *, abs(diff) < {affinity.TOLERANCE} AS stop FROM (
   SELECT *, 1.4426950408889634 * (ln(tot) + beta * dp / tot) - log2({PERPLEXITY}::DOUBLE) AS diff
   FROM (SELECT *, CASE WHEN abs(p) < {E.EPSILON} THEN {E.EPSILON} ELSE p END AS tot FROM (
     SELECT i, ds, step, beta, lo, hi, list_reduce(list_transform(ds, lambda d: exp(-beta * d)), lambda x, y: x + y) AS p,
            list_reduce(list_transform(ds, lambda d: d * exp(-beta * d)), lambda x, y: x + y) AS dp
     FROM betas WHERE step < {affinity.PERPLEXITY_STEPS} AND NOT done))))""",
)
COND = (
    "cond",
    f"SELECT i, j, w FROM (SELECT i, unnest(js) AS j, exp(-used * unnest(t.ds)) * (1.0 / total) AS w FROM trows t JOIN (SELECT i, arg_max(used, step) AS used, arg_max(total, step) AS total FROM betas GROUP BY i) USING (i)) WHERE w > {E.EPSILON} AND i <> j",
)
JOINT = merged("cond", "joint", "(a + b) * (1.0 / (2.0 * (SELECT count(*) FROM pts)))")
TSNE = (PTS, knn_part(TSNE_K), TSNE_ROWS, BETA, COND, JOINT)

DECAY = (
    "decay",
    f"SELECT i, j, w FROM (SELECT k.i, k.j, k.d, CASE WHEN sqrt(k.d) < sqrt({E.EPSILON}) THEN 1.0 ELSE exp(-pow(sqrt(k.d) / s.sigma, 40.0)) END AS w FROM knn k JOIN (SELECT i, greatest(max(sqrt(d)) FILTER (WHERE rank = {PHATE_K}), {E.EPSILON}) AS sigma FROM knn GROUP BY i) s USING (i)) WHERE w >= 0.0001",
)
KERNEL = merged("decay", "kernel", "(a + b) / 2")
MARKOV = ("markov", "SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM kernel")
PHATE = (PTS, knn_part(K), DECAY, KERNEL, MARKOV)
POS = ("pos", "SELECT id, v[1] * 10 AS x, v[2] * 10 AS y FROM pts")


def ends(of: str, name: str = "ends", extra: str = "") -> tuple[str, str]:
    return name, f"SELECT *, dx * dx + dy * dy AS d2 FROM (SELECT e.*, p.x - q.x AS dx, p.y - q.y AS dy{extra} FROM {of} e JOIN pos p ON e.i = p.id JOIN pos q ON e.j = q.id)"


def product(a: str, b: str, name: str) -> tuple[str, str]:
    return name, f"SELECT l.i, r.j, sum(l.w * r.w) AS w FROM {a} l JOIN {b} r ON l.j = r.i GROUP BY l.i, r.j"


def edges_out(of: str, digits: int = 6) -> str:
    return f"SELECT i, j, {_r('w', digits)} AS w FROM {of}"


# Builders shared by queries.

# What several steps read is written once: no plan holds a search twice, and a lost executor doesn't search again.

def _knn(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return materialize(knn(embeddings(spark, d), k), "knn")


def _umap(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    return materialize(E.prune(materialize(affinity.umap_graph(_knn(spark, d) if near is None else near, K, n_epochs=None), "umap-union"), 500), "umap-graph")


def _tsne(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    return materialize(affinity.tsne_graph(_knn(spark, d, TSNE_K) if near is None else near, PERPLEXITY, shape(embeddings(spark, d))[0]), "tsne-graph")


def _kernel(spark: SparkSession, d: str) -> DataFrame:
    return materialize(affinity.alpha_decay(_knn(spark, d), PHATE_K), "kernel")


def _markov(spark: SparkSession, d: str) -> DataFrame:
    return materialize(diffusion.markov(_kernel(spark, d)), "markov")


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    return materialize(epochs.umap_schedule(_umap(spark, d)), "schedule")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select("id", (F.get("features", F.lit(0)) * 10).alias("x"), (F.get("features", F.lit(1)) * 10).alias("y"))


# Neighbours

THIRDS = ("ths", "SELECT id, list_transform(v, lambda x: x / 3) AS v FROM pts")
ROUNDED = ("sgl", "SELECT id, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v FROM ths")


def _thirds(spark, d):
    """Features that 32 bits don't hold exactly."""
    return embeddings(spark, d).select("id", F.transform("features", lambda x: x / 3).alias("features"))


@query(sql("SELECT id, unnest(range(0, len(v)))::INTEGER AS p, unnest(v) AS x FROM sgl", PTS, THIRDS, ROUNDED))
def matrix_single(spark, d):
    """Features rounded to 32 bits, one by one."""
    return single(_thirds(spark, d)).select("id", F.posexplode("features").alias("p", "x"))


@query(sql(f"SELECT i, rank, j, {_r('d', 9)} AS d FROM knn", PTS, THIRDS, ROUNDED, knn_part(K, pts="sgl")))
def knn_exact_single(spark, d):
    """Exact search on features of 32 bits."""
    return rounded(knn(_thirds(spark, d), K, "exhaustive_gpu"), 9)


@query(sql(f"SELECT i, rank, j, {_r('d', 9)} AS d FROM knn", PTS, knn_part(K)))
def knn_exact_euclidean(spark, d):
    return rounded(_knn(spark, d), 9)


@query(sql(f"SELECT i, rank, j, {_r('d', 9)} AS d FROM knn", PTS, knn_part(K, COS)))
def knn_exact_cosine(spark, d):
    return rounded(knn(embeddings(spark, d), K, metric="cosine"), 9)


# Searches that are exact by the triangle inequality, with more cells than a small table would get.

for _search, _metric, _d in (("kmknn", "euclidean", D2), ("balltree", "euclidean", D2), ("kmknn", "cosine", COS), ("balltree", "cosine", COS)):
    query(sql(f"SELECT i, rank, j, {_r('d', 9)} AS d FROM knn", PTS, knn_part(K, _d)), f"knn_{_search}_{_metric}")(
        lambda spark, d, search=_search, metric=_metric: rounded(knn(embeddings(spark, d), K, search, metric, n_list=20), 9)
    )


@query(sql("SELECT " + _r("avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END)") + " AS intra_label, count(*) AS n_pairs FROM knn JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j", PTS, knn_part(K)))
def knn_intra_label_ratio(spark, d):
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    near = _knn(spark, d).join(labels.toDF("i", "li"), "i").join(labels.toDF("j", "lj"), "j")
    return rounded(near.agg(F.avg(F.when(F.col("li") == F.col("lj"), 1.0).otherwise(0.0)).alias("intra_label"), F.count(F.lit(1)).alias("n_pairs")))


CUSTOMER = ("pts", "SELECT s_suppkey AS id, [s_acctbal::DOUBLE] AS v FROM supplier")


@query(sql(f"SELECT i, rank, j, {_r('d', 4)} AS d FROM knn", CUSTOMER, knn_part(5)))
def knn_one_dimension(spark, d):
    return rounded(knn(from_columns(spark.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", ["s_acctbal"]), 5), 4)


# UMAP

@query(sql(f"SELECT a.i, {_r('a.rho')} AS rho, {_r('s.sigma')} AS sigma FROM adj a JOIN smooth s USING (i)", *UMAP[:6], recursive=True))
def umap_rho_sigma(spark, d):
    return rounded(affinity.smooth_knn(affinity.neighbour_rows(_knn(spark, d)), K).select("i", "rho", "sigma"))


@query(sql(f"SELECT i, {_r('ds[1] * 0.5 + ds[2] * 0.5')} AS rho FROM rws", *UMAP[:3]))
def umap_local_connectivity(spark, d):
    return rounded(affinity.neighbour_rows(_knn(spark, d)).select("i", affinity.rho_of(F.col("ds"), 1.5).alias("rho")))


@query(sql(edges_out("member"), *UMAP[:7], recursive=True))
def umap_membership(spark, d):
    return rounded(affinity.memberships(affinity.smooth_knn(affinity.neighbour_rows(_knn(spark, d)), K)))


@query(sql(edges_out("unioned"), *UMAP[:8], recursive=True))
def umap_fuzzy_union(spark, d):
    return rounded(affinity.umap_graph(_knn(spark, d), K, n_epochs=None))


@query(sql(edges_out("graph"), *UMAP, recursive=True))
def umap_fuzzy_graph(spark, d):
    return rounded(_umap(spark, d))


PERIODS = ("sched", "SELECT i, j, w, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS e, 1.0 / (w / (SELECT max(w) FROM graph WHERE i < j)) AS period FROM graph WHERE i < j")


@query(sql(f"SELECT i, j, e, {_r('period', 4)} AS period FROM sched", *UMAP, PERIODS, recursive=True))
def umap_edge_periods(spark, d):
    return rounded(_schedule(spark, d).select("i", "j", F.col("e").cast("long").alias("e"), "period"), 4)


DUE = ("due", f"SELECT * FROM sched WHERE floor({EPOCH}.0::DOUBLE / period) > floor({EPOCH - 1}.0::DOUBLE / period)")
DRAWN = ("drawn", f"SELECT * FROM (SELECT i, e, m, {draw_sql(SEED, 'i', str(EPOCH), 'e', 'm', '(SELECT count(*) FROM pts)')} AS j FROM (SELECT i, e, unnest(range(0, 5)) AS m FROM due)) WHERE i <> j")


@query(sql("SELECT i, e, m::INTEGER AS m, j FROM drawn", *UMAP, PERIODS, DUE, DRAWN, recursive=True))
def umap_hash_negatives(spark, d):
    n, _ = shape(embeddings(spark, d))
    now = epochs.due(_schedule(spark, d), EPOCH).select("i", F.col("e").cast("long").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m"))
    return now.withColumn("j", draw_column(SEED, F.col("i"), F.lit(EPOCH), F.col("e"), F.col("m"), n)).where("i <> j")


BOTH_ENDS = ("both_drawn", f"SELECT * FROM (SELECT i, e, m, {draw_sql(SEED, 'i', str(EPOCH), 'e', 'm', '(SELECT count(*) FROM pts)')} AS j FROM (SELECT i, e, unnest(range(0, 5)) AS m FROM (SELECT i, e FROM due UNION ALL SELECT j, e + {epochs.OTHER_END} FROM due))) WHERE i <> j")


@query(sql("SELECT i, e, m::INTEGER AS m, j FROM both_drawn", *UMAP, PERIODS, DUE, BOTH_ENDS, recursive=True))
def umap_hash_negatives_both_ends(spark, d):
    n, _ = shape(embeddings(spark, d))
    slots = epochs.negative_slots(epochs.due(_schedule(spark, d), EPOCH), 5, both_ends=True)
    return slots.withColumn("j", draw_column(SEED, F.col("i"), F.lit(EPOCH), F.col("e"), F.col("m"), n)).where("i <> j")


UMAP_GRAD = (
    ("twoway", "SELECT i, j FROM due UNION ALL SELECT j, i FROM due"), ends("twoway", "near"), ends("drawn", "far"),
    ("parts", f"""SELECT i AS id, -pull * dx AS gx, -pull * dy AS gy, 1 AS act FROM (SELECT *, CASE WHEN d2 >= 1e-8 THEN 2.0 * (2.0 * {A} * {B}) * pow(d2, {B}) / (d2 * (1.0 + {A} * pow(d2, {B}))) ELSE 0.0 END AS pull FROM near)
 UNION ALL SELECT i, push * dx, push * dy, 0 FROM (SELECT *, least(greatest(2.0 * {B} / ((d2 + 0.001) * (1.0 + {A} * pow(d2 + 0.001, {B}))), -4.0), 4.0) AS push FROM far)"""),
)


@query(sql(f"SELECT id, {_r('sum(gx)', 5)} AS gx, {_r('sum(gy)', 5)} AS gy, sum(act)::BIGINT AS n_active FROM parts GROUP BY id", *UMAP, PERIODS, DUE, DRAWN, POS, *UMAP_GRAD, recursive=True))
def umap_epoch_gradient(spark, d):
    n, _ = shape(embeddings(spark, d))
    return rounded(epochs.umap_gradient(_schedule(spark, d), _positions(spark, d), n, EPOCH, A, B), 5)


@query(sql(f"SELECT id, {_r('sum(gx)', 5)} AS gx, {_r('sum(gy)', 5)} AS gy, sum(act)::BIGINT AS n_active FROM parts GROUP BY id", *UMAP, PERIODS, DUE, ("drawn", BOTH_ENDS[1]), POS, *UMAP_GRAD, recursive=True))
def umap_epoch_gradient_both_ends(spark, d):
    n, _ = shape(embeddings(spark, d))
    return rounded(epochs.umap_gradient(_schedule(spark, d), _positions(spark, d), n, EPOCH, A, B, both_ends=True), 5)


@query(sql(f"SELECT {_r('sqrt(sum(gx * gx + gy * gy))', 4)} AS norm FROM (SELECT id, sum(gx) AS gx, sum(gy) AS gy FROM parts GROUP BY id)", *UMAP, PERIODS, DUE, DRAWN, POS, *UMAP_GRAD, recursive=True))
def umap_gradient_norm(spark, d):
    n, _ = shape(embeddings(spark, d))
    return rounded(epochs.gradient_norm(epochs.umap_gradient(_schedule(spark, d), _positions(spark, d), n, EPOCH, A, B)), 4)


@query(sql(f"SELECT i, count(*) AS n_edges, {_r('sum(w)')} AS degree FROM graph GROUP BY i", *UMAP, recursive=True))
def edge_degree(spark, d):
    return rounded(E.degree(_umap(spark, d)))


@query(sql("SELECT i, len(l) AS n, l[1] AS first_j, l[len(l)] AS last_j FROM (SELECT i, list(j ORDER BY j) AS l FROM graph GROUP BY i)", *UMAP, recursive=True))
def adjacency_list(spark, d):
    rows = E.adjacency(_umap(spark, d)).withColumn("l", F.col("neighbours.j"))
    return rows.select("i", F.size("l").cast("long").alias("n"), F.element_at("l", 1).alias("first_j"), F.element_at("l", -1).alias("last_j"))


@query(sql(edges_out("scaled"), *UMAP, ("deg", "SELECT i, CASE WHEN sum(w) > 1e-8 THEN sqrt(sum(w)) END AS s FROM graph GROUP BY i"), ("scaled", "SELECT g.i, g.j, -coalesce(g.w / (a.s * b.s), 0.0) AS w FROM graph g LEFT JOIN deg a ON g.i = a.i LEFT JOIN deg b ON g.j = b.i WHERE g.i <> g.j"), recursive=True))
def neg_normalised_adjacency(spark, d):
    return rounded(E.negative_normalised_adjacency(_umap(spark, d)))


# t-SNE

@query(sql(edges_out("cond", 8), *TSNE[:5], recursive=True))
def tsne_conditional_p(spark, d):
    return rounded(affinity.conditional_probabilities(_knn(spark, d, TSNE_K), PERPLEXITY), 8)


@query(sql(edges_out("joint", 9), *TSNE, recursive=True))
def tsne_joint_p(spark, d):
    return rounded(_tsne(spark, d), 9)


TSNE_GRAD = (
    POS, ends("joint", "ends"), ("att", "SELECT i AS id, sum(w / (1.0 + d2) * dx) AS ax, sum(w / (1.0 + d2) * dy) AS ay FROM ends GROUP BY i"),
    ("rep", "SELECT id, sum(q * q * dx) AS rx, sum(q * q * dy) AS ry, sum(q) AS z FROM (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, 1 / (1 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS q FROM pos a JOIN pos b ON a.id <> b.id) GROUP BY id"),
)


@query(sql(f"SELECT id, {_r('rx', 5)} AS rx, {_r('ry', 5)} AS ry, {_r('z', 5)} AS z FROM rep", PTS, POS, TSNE_GRAD[3]))
def tsne_repulsion_exact(spark, d):
    return rounded(epochs.tsne_repulsion_exact(_positions(spark, d)), 5)


@query(sql(f"SELECT r.id, {_r('coalesce(ax, 0.0) - rx / (SELECT sum(z) FROM rep)', 7)} AS gx, {_r('coalesce(ay, 0.0) - ry / (SELECT sum(z) FROM rep)', 7)} AS gy FROM rep r LEFT JOIN att a ON a.id = r.id", *TSNE, *TSNE_GRAD, recursive=True))
def tsne_epoch_gradient_exact(spark, d):
    graph = _tsne(spark, d)
    return rounded(epochs.tsne_gradient(graph, _positions(spark, d)), 7)


#: Cells no wider than this share of their distance stand for their points.
THETA = 0.5


TREE = (
    POS, ("square", "SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9) AS side FROM pos"),
    ("placed", "SELECT id, x, y, least(greatest(floor((x - x0) / side * 16777216), 0), 16777215)::BIGINT AS a, least(greatest(floor((y - y0) / side * 16777216), 0), 16777215)::BIGINT AS b, side FROM pos, square"),
    ("sa", "SELECT *, (a | (a << 16)) & 281470681808895 AS a1, (b | (b << 16)) & 281470681808895 AS b1 FROM placed"),
    ("sb", "SELECT *, (a1 | (a1 << 8)) & 71777214294589695 AS a2, (b1 | (b1 << 8)) & 71777214294589695 AS b2 FROM sa"),
    ("sc", "SELECT *, (a2 | (a2 << 4)) & 1085102592571150095 AS a3, (b2 | (b2 << 4)) & 1085102592571150095 AS b3 FROM sb"),
    ("sd", "SELECT *, (a3 | (a3 << 2)) & 3689348814741910323 AS a4, (b3 | (b3 << 2)) & 3689348814741910323 AS b4 FROM sc"),
    ("coded", "SELECT id, x, y, side, ((a4 | (a4 << 1)) & 6148914691236517205) | (((b4 | (b4 << 1)) & 6148914691236517205) << 1) AS code FROM sd"),
    ("cells", "SELECT level, code >> (2 * (24 - level)) AS cell, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM coded, range(25) t(level) GROUP BY level, cell"),
    ("looked", """SELECT p.id, p.x, p.y, p.code, p.side, c.level, c.cell, c.n, c.cx, c.cy FROM coded p JOIN cells c ON c.level = 0
    UNION ALL
    SELECT p.id, p.x, p.y, p.code, p.side, c.level, c.cell, c.n, c.cx, c.cy FROM looked p JOIN cells c ON c.level = p.level + 1 AND c.cell >> 2 = p.cell
    WHERE p.n > 1 AND (p.code >> (2 * (24 - p.level)) = p.cell OR pow(p.side / pow(2, p.level), 2) >= 0.25 * (pow(p.x - p.cx, 2) + pow(p.y - p.cy, 2)))"""),
    ("felt", """SELECT id, x - cx AS dx, y - cy AS dy, n - (code >> (2 * (24 - level)) = cell)::INTEGER AS many, 1 + pow(x - cx, 2) + pow(y - cy, 2) AS far FROM looked
    WHERE n = 1 OR level = 24 OR NOT (code >> (2 * (24 - level)) = cell OR pow(side / pow(2, level), 2) >= 0.25 * (pow(x - cx, 2) + pow(y - cy, 2)))"""),
)


@query(sql(f"SELECT id, {_r('sum(many / (far * far) * dx)', 8)} AS rx, {_r('sum(many / (far * far) * dy)', 8)} AS ry, {_r('sum(many / far)', 8)} AS z FROM felt GROUP BY id", PTS, *TREE, recursive=True))
def tsne_repulsion_tree(spark, d):
    return rounded(barnes_hut.repulsion(_positions(spark, d), THETA), 8)


@query(sql(f"SELECT level, cell AS code, n, {_r('cx', 9)} AS cx, {_r('cy', 9)} AS cy FROM cells c WHERE level = 0 OR (SELECT n FROM cells u WHERE u.level = c.level - 1 AND u.cell = c.cell >> 2) > 1", PTS, *TREE[:-2]))
def quadtree_cells(spark, d):
    positions = _positions(spark, d)
    low, side = barnes_hut._square(positions)
    cells = barnes_hut.cells_of(barnes_hut.blocks_of(positions, low, side))
    up = cells.where("n > 1").select((F.col("level") + 1).alias("level"), F.col("code").alias("__up"))
    below = cells.where("level > 0").withColumn("__up", F.shiftright("code", 2)).join(up, ["level", "__up"]).select("level", "code", "n", "cx", "cy")
    return rounded(below.union(cells.where("level = 0")).withColumn("level", F.col("level").cast("long")), 9)


@query(sql(f"SELECT {_r('min(x)')} AS lo_x, {_r('max(x)')} AS hi_x, {_r('min(y)')} AS lo_y, {_r('max(y)')} AS hi_y, {_r('avg(x)')} AS mean_x, {_r('avg(y)')} AS mean_y FROM pos", PTS, POS))
def embedding_bounds(spark, d):
    return rounded(_positions(spark, d).agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")))


# PHATE and diffusion

@query(sql(edges_out("kernel"), *PHATE[:4]))
def alpha_decay_kernel(spark, d):
    return rounded(_kernel(spark, d))


BINARY = ("ones", f"SELECT i, j, 1.0::DOUBLE AS w FROM knn WHERE rank <= {PHATE_K} AND i <> j")


@query(sql("SELECT * FROM bin", PTS, knn_part(K), BINARY, merged("ones", "bin", "(a + b) / 2")))
def binary_kernel(spark, d):
    return affinity.alpha_decay(_knn(spark, d), PHATE_K, None)


for _name, _how, _w, _least in (("symmetrise_mult", "multiplicative", "a * b", "0"), ("symmetrise_mnn", "mnn", "least(a, b)", str(E.EPSILON)), ("symmetrise_add", "add", "(a + b) / 2", "0")):
    query(sql(edges_out("sym"), *PHATE[:3], merged("decay", "sym", _w, _least)), _name)(lambda spark, d, how=_how: rounded(affinity.alpha_decay(_knn(spark, d), PHATE_K, symmetry=how)))
query(sql(edges_out("decay"), *PHATE[:3]), "symmetrise_none")(lambda spark, d: rounded(affinity.alpha_decay(_knn(spark, d), PHATE_K, symmetry="none")))


@query(sql(edges_out("markov"), *PHATE))
def diffusion_operator(spark, d):
    return rounded(_markov(spark, d))


def _scaled_sql(power: float) -> str:
    return sql(edges_out("scaled"), *PHATE[:4], ("deg", f"SELECT i, pow(sum(w), {power}) AS s FROM kernel GROUP BY i"), ("scaled", "SELECT g.i, g.j, coalesce(g.w / (a.s * b.s), 0.0) AS w FROM kernel g LEFT JOIN deg a ON g.i = a.i LEFT JOIN deg b ON g.j = b.i"))


@query(_scaled_sql(1.0))
def anisotropic_kernel(spark, d):
    return rounded(E.anisotropic(_kernel(spark, d), 1.0))


@query(_scaled_sql(0.5))
def symmetric_diffusion_operator(spark, d):
    return rounded(E.symmetric_operator(_kernel(spark, d)))


@query(sql(edges_out("t"), *PHATE, ("t", "SELECT j AS i, i AS j, w FROM markov")))
def transpose(spark, d):
    return rounded(E.transpose(_markov(spark, d)))


@query(sql(edges_out("p2", 8), *PHATE, product("markov", "markov", "p2")))
def sparse_matmul(spark, d):
    p = _markov(spark, d)
    return rounded(E.multiply(p, p), 8)


P3 = (product("markov", "markov", "p2"), product("markov", "p2", "p3"))


@query(sql(edges_out("p3", 8), *PHATE, *P3))
def matrix_power_3(spark, d):
    return rounded(E.power(_markov(spark, d), 3), 8)


@query(sql(edges_out("lp", 5), *PHATE, P3[0], ("lp", "SELECT i, j, -ln(greatest(least(w, 1.0), 0.0) + 1e-7) AS w FROM p2")))
def log_potential(spark, d):
    return rounded(diffusion.potential(_markov(spark, d), 2, 1.0), 5)


@query(sql(edges_out("pp"), *PHATE, ("pp", "SELECT i, j, pow(w, 0.5) / 0.5 AS w FROM markov")))
def power_potential(spark, d):
    return rounded(diffusion.power_potential(_markov(spark, d), 0.0))


POT_D = (product("markov", "tr", "dots"), ("norms", "SELECT i, sum(w * w) AS s FROM markov GROUP BY i"))


@query(sql(f"SELECT d.i, d.j, CASE WHEN d.i = d.j THEN 0.0 ELSE {_r('sqrt(greatest(a.s + b.s - 2 * d.w, 0.0))')} END AS d FROM dots d JOIN norms a ON d.i = a.i JOIN norms b ON d.j = b.i", *PHATE, ("tr", "SELECT j AS i, i AS j, w FROM markov"), *POT_D))
def potential_distances(spark, d):
    return rounded(diffusion.potential_distances(_markov(spark, d)))


@query(sql(f"SELECT j, {_r('sum(w)')} AS w FROM markov GROUP BY j", *PHATE))
def sum_of_rows(spark, d):
    return rounded(E.sum_of_rows(_markov(spark, d), embeddings(spark, d).select(F.col("id").alias("i"))))


@query(sql(edges_out("norm"), *UMAP, ("norm", "SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM graph"), recursive=True))
def row_l1_normalise(spark, d):
    return rounded(E.normalise_rows(_umap(spark, d)))


MARKS = ("marks", f"SELECT row_number() OVER (ORDER BY id) - 1 AS landmark, id, v FROM (SELECT * FROM pts ORDER BY md5('{SEED}:' || id), id LIMIT {N_LANDMARKS})")
ASSIGNED = ("assigned", f"SELECT i, landmark FROM (SELECT a.id AS i, b.landmark, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.landmark) AS r FROM pts a, marks b) WHERE r = 1")


@query(sql("SELECT i, landmark::INTEGER AS landmark FROM assigned", PTS, MARKS, ASSIGNED))
def landmark_assign_random(spark, d):
    m = embeddings(spark, d)
    return diffusion.assign_to_landmarks(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED))


SPARSE_MARKS = ("smarks", f"SELECT id, -ln((('0x' || substr(md5('{SEED}:' || id), 1, 13))::BIGINT::DOUBLE + 1) / {float((1 << 52) + 1)}) * coalesce(g.degree, 0.0) AS key FROM pts LEFT JOIN (SELECT i, sum(w) AS degree FROM kernel GROUP BY i) g ON g.i = pts.id ORDER BY key, id LIMIT {N_LANDMARKS}")


@query(sql("SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS landmark, id FROM smarks", *PHATE[:4], SPARSE_MARKS))
def density_landmarks(spark, d):
    return diffusion.density_landmarks(embeddings(spark, d), _kernel(spark, d), N_LANDMARKS, SEED).select("landmark", "id")


@query(sql(edges_out("kept"), *PHATE[:3], ("twice", "SELECT i, j, w, 0 AS nr FROM decay UNION ALL SELECT i, j, w / 2, 1 FROM decay WHERE (i + j) % 2 = 0"), ("kept", "SELECT i, j, arg_max(w, nr) AS w FROM twice GROUP BY i, j")))
def edges_last_wins(spark, d):
    decay = materialize(affinity.alpha_decay(_knn(spark, d), PHATE_K, symmetry="none"), "decay")
    twice = decay.withColumn("at", F.lit(0)).union(decay.where("(i + j) % 2 = 0").select("i", "j", F.col("w") / 2, F.lit(1)))
    return rounded(E.last_wins(twice, "at"))


LANDMARK_OP = (
    ("ln0", "SELECT a.landmark AS i, m.j, sum(m.w) AS w FROM markov m JOIN assigned a ON m.i = a.i GROUP BY ALL"), ("ln1", "SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM ln0"),
    ("nl0", "SELECT m.i, a.landmark AS j, sum(m.w) AS w FROM markov m JOIN assigned a ON m.j = a.i GROUP BY ALL"), ("nl1", "SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM nl0"), product("ln1", "nl1", "lop"),
)


@query(sql(edges_out("lop"), *PHATE, MARKS, ASSIGNED, *LANDMARK_OP))
def landmark_operator(spark, d):
    m = embeddings(spark, d)
    assigned = diffusion.assign_to_landmarks(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED))
    return rounded(diffusion.landmark_operators(_markov(spark, d), assigned)[2])


TRANS = ("near", f"SELECT i, j, d, max(d) OVER (PARTITION BY i) AS far FROM (SELECT a.id AS i, b.landmark AS j, {D2} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.landmark) AS r FROM pts a, marks b) WHERE r <= {PHATE_K}")


@query(sql(f"SELECT i, j, {_r('w / sum(w) OVER (PARTITION BY i)')} AS w FROM (SELECT i, j, exp(-(d / greatest(far, {E.EPSILON}))) AS w FROM near) WHERE w >= 0.0001", PTS, MARKS, TRANS))
def nystroem_transitions(spark, d):
    m = embeddings(spark, d)
    return rounded(diffusion.to_landmark_transitions(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED), PHATE_K))


CENTRE = (
    ("sq", f"SELECT a.id AS i, b.id AS j, {D2} AS s FROM pts a, pts b"), ("rm", "SELECT i, sum(s) / (SELECT count(*) FROM pts) AS r FROM sq GROUP BY i"),
)


@query(sql(f"SELECT q.i, q.j, {_r('-0.5 * (q.s - a.r - b.r + (SELECT sum(r) / (SELECT count(*) FROM pts) FROM rm))')} AS w FROM sq q JOIN rm a ON q.i = a.i JOIN rm b ON q.j = b.i", PTS, *CENTRE))
def mds_double_centring(spark, d):
    return rounded(diffusion.centred_distances(embeddings(spark, d)))


# Density

RADII = (
    ("d2s", "SELECT g.i, g.j, g.w, coalesce(a.d, b.d, 0.0) AS d2 FROM graph g LEFT JOIN knn a ON g.i = a.i AND g.j = a.j LEFT JOIN knn b ON g.i = b.j AND g.j = b.i"),
    ("raw", f"SELECT p.id AS i, ln(1e-8 + coalesce(sum(w * d2), 0.0) / greatest(coalesce(sum(w), 0.0), {E.EPSILON})) AS lr, coalesce(sum(w), 0.0) AS mu FROM pts p LEFT JOIN d2s ON d2s.i = p.id GROUP BY p.id"),
    ("radii", "SELECT i, (lr - avg(lr) OVER ()) / stddev_samp(lr) OVER () AS r, mu AS mu_sum FROM raw"),
)


@query(sql(f"SELECT i, {_r('r')} AS r, {_r('mu_sum')} AS mu_sum FROM radii", *UMAP, *RADII, recursive=True))
def original_log_radii(spark, d):
    m, near = embeddings(spark, d), _knn(spark, d)
    return rounded(density.original_radii(m.select(F.col("id").alias("i")), _umap(spark, d, near), near))


EMB_RADII = (POS, ends("graph", "gends"), ("re", f"SELECT i AS id, ln(1e-8 + sum(phi * d2) / greatest(sum(phi), {E.EPSILON})) AS re, sum(phi) AS phi_sum FROM (SELECT *, 1.0 / (1.0 + {A} * pow(d2, {B})) AS phi FROM gends) GROUP BY i"))


@query(sql(f"SELECT id, {_r('re')} AS re, {_r('phi_sum')} AS phi_sum FROM re", *UMAP, *EMB_RADII, recursive=True))
def embedding_log_radii(spark, d):
    return rounded(epochs.umap_radii(_umap(spark, d), _positions(spark, d), A, B))


@query(sql(f"SELECT {_r('avg(re)')} AS mean, {_r('sqrt(var_samp(re) + 0.1)')} AS std, {_r('sum((re - m) * r) / (count(*) - 1)')} AS cov FROM (SELECT re, r, avg(re) OVER () AS m FROM re JOIN radii ON re.id = radii.i)", *UMAP, *RADII, *EMB_RADII, recursive=True))
def density_correlation_stats(spark, d):
    m, near = embeddings(spark, d), _knn(spark, d)
    graph = _umap(spark, d, near)
    original = density.original_radii(m.select(F.col("id").alias("i")), graph, near)
    return rounded(density.correlation_stats(epochs.umap_radii(graph, _positions(spark, d), A, B).join(original.withColumnRenamed("i", "id"), "id")))


DENS = (
    ("rad", "SELECT re.id, re, phi_sum, r, mu_sum, avg(re) OVER () AS mean FROM re JOIN radii ON re.id = radii.i"),
    ("stat", "SELECT any_value(mean) AS mean, sqrt(sum((re - mean) * (re - mean)) / (count(*) - 1) + 0.1) AS std, sum((re - mean) * r) / (count(*) - 1) AS cov FROM rad"),
    ("scl", "SELECT 2.0 * sum(mu_sum) / 2 / ((SELECT std FROM stat) * (count(*) - 1)) AS scale FROM radii"),
    ("wgt", f"SELECT id, r - cov * (re - mean) / (std * std) AS weight, greatest(phi_sum, {E.EPSILON}) AS phi, exp(-re) AS inv, re, phi_sum FROM (SELECT b.id, b.re, b.phi_sum, b.r, s.mean, s.std, s.cov FROM rad b, stat s)"),
)
DENS_GRAD = (
    ends("due", "dends"),
    ("dphi", f"SELECT *, {A} * {B} * pow(d2, {B}) / d2 * phi AS slope, 1.0 - {B} * (1.0 - phi) AS common FROM (SELECT *, 1.0 / (1.0 + {A} * pow(d2, {B})) AS phi FROM dends WHERE d2 >= 1e-8)"),
    ("dtwo", f"SELECT e.i, e.j, e.dx, e.dy, 2.0 * (SELECT scale FROM scl) * (p.weight * (e.phi / p.phi * (e.common * p.inv + e.slope)) + q.weight * (e.phi / q.phi * (e.common * q.inv + e.slope))) / greatest(e.w, {E.EPSILON}) AS two FROM dphi e JOIN wgt p ON e.i = p.id JOIN wgt q ON e.j = q.id"),
    ("dmove", "SELECT i, j, 2.0 * least(greatest(two * dx, -4.0), 4.0) AS gx, 2.0 * least(greatest(two * dy, -4.0), 4.0) AS gy FROM dtwo"),
)


def _densities(spark, d):
    m, near = embeddings(spark, d), _knn(spark, d)
    graph = _umap(spark, d, near)
    original = materialize(density.original_radii(m.select(F.col("id").alias("i")), graph, near), "radii")
    radii = materialize(epochs.umap_radii(graph, _positions(spark, d), A, B).join(original.select(F.col("i").alias("id"), "r"), "id"), "embedding-radii")
    return graph, original, radii, density.correlation_stats(radii)


@query(sql(f"SELECT id, {_r('re')} AS re, {_r('phi_sum')} AS phi_sum, {_r('weight')} AS weight FROM wgt", *UMAP, *RADII, *EMB_RADII, *DENS, recursive=True))
def densmap_weights(spark, d):
    _, _, radii, stats = _densities(spark, d)
    return rounded(epochs.density_weights(radii, stats))


@query(sql(f"SELECT id, {_r('sum(gx)', 5)} AS gx, {_r('sum(gy)', 5)} AS gy FROM (SELECT i AS id, gx, gy FROM dmove UNION ALL SELECT j, -gx, -gy FROM dmove) GROUP BY id", *UMAP, *RADII, *EMB_RADII, *DENS, PERIODS, DUE, *DENS_GRAD, recursive=True))
def densmap_epoch_gradient(spark, d):
    graph, original, radii, stats = _densities(spark, d)
    now = epochs.due(materialize(epochs.umap_schedule(graph), "schedule"), EPOCH)
    return rounded(epochs.umap_density_gradient(now, _positions(spark, d), epochs.density_weights(radii, stats), epochs.density_scale(original, stats, 2.0), A, B), 5)


# PaCMAP

PAIRS = (
    PTS, knn_part(50),
    ("tries", f"SELECT i, m, {draw_sql(SEED, 'i', '0', '0', 'm', '(SELECT count(*) FROM pts)')} AS j FROM (SELECT id AS i, unnest(range(0, 200)) AS m FROM pts)"),
    ("pairs", "SELECT 'near' AS kind, i, j FROM knn WHERE rank <= 10 UNION ALL SELECT 'mid_near', i, j FROM knn WHERE rank > 4 AND rank <= 9 UNION ALL SELECT 'further', i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY m) AS r FROM tries WHERE i <> j) WHERE r <= 20"),
)


def _pairs(spark, d):
    n, _ = shape(embeddings(spark, d))
    return materialize(epochs.pacmap_pairs(_knn(spark, d, 50), n), "pairs")


@query(sql("SELECT kind, i, j FROM pairs", *PAIRS))
def pacmap_pairs(spark, d):
    return _pairs(spark, d)


_W = epochs.phase_weights(EPOCH)
PACMAP_GRAD = (
    POS, ("twoway", "SELECT kind, i, j FROM pairs UNION ALL SELECT kind, j, i FROM pairs"), ends("twoway", "pends"),
    ("pg", f"SELECT *, CASE kind WHEN 'near' THEN -{_W[0]} * 20.0 / pow(10.0 + (1.0 + d2), 2) WHEN 'mid_near' THEN -({_W[1]!r}) * 20000.0 / pow(10000.0 + (1.0 + d2), 2) ELSE 2.0 / pow(2.0 + d2, 2) END AS g FROM pends"),
)


@query(sql(f"SELECT i AS id, {_r('sum(g * dx)', 5)} AS gx, {_r('sum(g * dy)', 5)} AS gy FROM pg GROUP BY i", *PAIRS, *PACMAP_GRAD))
def pacmap_epoch_gradient(spark, d):
    return rounded(epochs.pacmap_gradient(_pairs(spark, d), _positions(spark, d), EPOCH), 5)


@query(sql("SELECT id AS i, min(b) AS component FROM reach GROUP BY id", PTS, knn_part(2), ("e", "SELECT i AS a, j AS b FROM knn WHERE d < 1.1 UNION SELECT j, i FROM knn WHERE d < 1.1"), ("reach", "SELECT id, id AS b FROM pts UNION SELECT r.id, e.b FROM reach r JOIN e ON r.b = e.a"), recursive=True))
def connected_components(spark, d):
    m = embeddings(spark, d)
    return E.components(m.select(F.col("id").alias("i")), knn(m, 2).where("d < 1.1"))


COMPONENTS = (knn_part(2, name="knn2"), ("e2", "SELECT i AS a, j AS b FROM knn2 WHERE d < 1.1 UNION SELECT j, i FROM knn2 WHERE d < 1.1"), ("reach", "SELECT id, id AS b FROM pts UNION SELECT r.id, e2.b FROM reach r JOIN e2 ON r.b = e2.a"), ("comp", "SELECT id AS i, min(b) AS component FROM reach GROUP BY id"))


def _components(spark, d, near=None):
    """Of the graph of two neighbours; the first two of a wider table are these."""
    m = embeddings(spark, d)
    return E.components(m.select(F.col("id").alias("i")), (_knn(spark, d, 2) if near is None else near).where("rank <= 2 AND d < 1.1"))


@query(sql(f"SELECT a.component, g.i, g.j, {_r('g.w')} AS w FROM graph g JOIN comp a ON g.i = a.i JOIN comp b ON g.j = b.i WHERE a.component = b.component", *UMAP, *COMPONENTS, recursive=True))
def component_edges(spark, d):
    near = _knn(spark, d)
    return rounded(E.within_components(_umap(spark, d, near), _components(spark, d, near)))


@query(sql(f"SELECT part, p::INTEGER AS p, {_r('avg(x)')} AS x FROM (SELECT c.component AS part, unnest(range(0, len(v))) AS p, unnest(v) AS x FROM pts JOIN comp c ON c.i = pts.id) GROUP BY part, p", PTS, *COMPONENTS, recursive=True))
def component_means(spark, d):
    parts = _components(spark, d).select(F.col("i").alias("id"), F.col("component").alias("part"))
    return rounded(E.part_means(embeddings(spark, d), parts))


@query("SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)) AS t(part, x, y)")
def component_simplex(spark, d):
    c = pipelines.component_centres(4, None, 2, SEED) + 0.0
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(c)], "part long, x double, y double")


@query(sql(f"SELECT a.id AS i, (row_number() OVER (PARTITION BY a.id ORDER BY b.id) - 1)::INTEGER AS k, {_r('coalesce(m.w, 0.0)')} AS w FROM pts a JOIN pts b ON true LEFT JOIN markov m ON m.i = a.id AND m.j = b.id WHERE a.id IN (SELECT i FROM markov)", *PHATE))
def dense_rows(spark, d):
    # Rounded before it is spread: most entries are 0.
    return E.dense_entries(rounded(_markov(spark, d)), distributed._places(embeddings(spark, d)))


@query(sql("SELECT i, j, 1.0::DOUBLE AS w FROM knn WHERE i <> j", PTS, knn_part(K)))
def knn_edges_unweighted(spark, d):
    return E.unweighted(_knn(spark, d))


@query(sql("SELECT i AS src, j AS dst, e FROM tedges", *UMAP, TRAINING := ("tedges", "SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS e FROM graph"), recursive=True))
def parametric_training_edges(spark, d):
    return batches.training_edges(_umap(spark, d))


N_BATCHES = 4
BATCH = (
    *UMAP, TRAINING, ("mine", f"SELECT * FROM tedges WHERE {draw_sql(SEED, 'i', str(EPOCH), 'e', str(batches.WHICH), str(N_BATCHES))} = 1"),
    ("batch", f"SELECT i, j, 1.0::DOUBLE AS target FROM mine UNION ALL SELECT i, j, 0.0 FROM (SELECT i, {draw_sql(SEED, 'i', str(EPOCH), 'e', 'm', '(SELECT count(*) FROM pts)')} AS j FROM mine, range(5) t(m)) WHERE i <> j"),
)


def _batch(spark, d):
    m = embeddings(spark, d)
    return batches.batch(batches.training_edges(_umap(spark, d)), shape(m)[0], EPOCH, 1, N_BATCHES, 5, SEED)


@query(sql("SELECT i AS src, j AS dst, target FROM batch", *BATCH, recursive=True))
def parametric_training_batch(spark, d):
    """One batch of an epoch: its edges and their negatives."""
    return _batch(spark, d)


LOSS = (
    *BATCH, POS, ends("batch", "bends"),
    ("ce", f"SELECT -(target * ln(q) + (1 - target) * ln(1 - q)) AS ce, sqrt(d2 + 1e-8) AS z, sqrt({D2} + 1e-8) AS x FROM (SELECT *, least(greatest(1.0 / (1.0 + {A} * pow(d2 + 1e-6, {B})), 1e-7), 1.0 - 1e-7) AS q FROM bends) g JOIN pts a ON a.id = g.i JOIN pts b ON b.id = g.j"),
    ("losses", "SELECT avg(ce) AS cross_entropy, -covar_pop(x, z) / (sqrt(var_pop(x) + 1e-8 / count(*)) * sqrt(var_pop(z) + 1e-8 / count(*))) AS correlation, count(*) AS n FROM ce"),
)


@query(sql(f"SELECT {_r('cross_entropy')} AS cross_entropy, {_r('correlation')} AS correlation, {_r('cross_entropy + 0.5 * correlation')} AS loss, n FROM losses", *LOSS, recursive=True))
def parametric_batch_losses(spark, d):
    """Both losses of a batch, with targets 1 and 0, and their weighted sum."""
    return rounded(batches.losses(_batch(spark, d), _positions(spark, d), embeddings(spark, d), A, B, 0.5))


@query(sql(edges_out("itp", 8), *PHATE, MARKS, ASSIGNED, *LANDMARK_OP, product("lop", "lop", "lop2"), product("nl1", "lop2", "itp")))
def landmark_power_interpolation(spark, d):
    """P^t over all rows and the landmarks: transitions to landmarks times a power of their operator."""
    m = embeddings(spark, d)
    assigned = diffusion.assign_to_landmarks(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED))
    _, p_nl, small = diffusion.landmark_operators(_markov(spark, d), assigned)
    return rounded(diffusion.interpolate_power(p_nl, small, 2), 8)


# Methods end to end, and other results without SQL

def _method(name: str, f) -> None:
    query(None, name)(f)


#: Adam steps of the encoder over tables, with its default layers: a parameter, README has the cost.
ENCODER_ROUNDS = 12

_method("umap", lambda s, d: pipelines.umap(embeddings(s, d)))
_method("umap_gpu_rule", lambda s, d: pipelines.umap(embeddings(s, d), UmapParams(optimiser="adam_gpu", knn=KnnParams("nndescent_gpu"))))
_method("umap_sgd", lambda s, d: pipelines.umap(embeddings(s, d), UmapParams(optimiser="sgd")))
_method("umap_adam", lambda s, d: pipelines.umap(embeddings(s, d), UmapParams(optimiser="adam")))
_method("umap_distributed", lambda s, d: distributed.umap(embeddings(s, d), UmapParams()))
_method("densmap", lambda s, d: pipelines.umap(embeddings(s, d), densmap_params()))
_method("tsne", lambda s, d: pipelines.tsne(embeddings(s, d), TsneParams()))
_method("tsne_fft", lambda s, d: pipelines.tsne(embeddings(s, d), TsneParams(method="fft")))
_method("tsne_distributed", lambda s, d: distributed.tsne(embeddings(s, d), TsneParams(method="fft")))
_method("tsne_tree_distributed", lambda s, d: distributed.tsne(embeddings(s, d), TsneParams()))
_method("diffusion_maps_distributed", lambda s, d: distributed.diffusion_maps(embeddings(s, d)))
_method("tsne_repulsion_grid", lambda s, d: epochs.tsne_repulsion_grid(_positions(s, d)))
_method("densne", lambda s, d: pipelines.tsne(embeddings(s, d), densne_params()))
_method("phate", lambda s, d: pipelines.phate(embeddings(s, d)))
_method("phate_distributed", lambda s, d: distributed.phate(embeddings(s, d)))
_method("densne_distributed", lambda s, d: distributed.tsne(embeddings(s, d), densne_params(method="fft")))
_method("phate_landmarks", lambda s, d: pipelines.phate(embeddings(s, d), PhateParams(n_landmarks=50, landmarks="random", mds="classic")))
_method("phate_spectral_landmarks", lambda s, d: pipelines.phate(embeddings(s, d), PhateParams(n_landmarks=50, mds="classic")))
_method("phate_density_landmarks", lambda s, d: pipelines.phate(embeddings(s, d), PhateParams(n_landmarks=50, landmarks="density", mds="classic")))
_method("pacmap", lambda s, d: pipelines.pacmap(embeddings(s, d)))
_method("pacmap_distributed", lambda s, d: distributed.pacmap(embeddings(s, d), PacmapParams()))
_method("diffusion_maps", lambda s, d: pipelines.diffusion_maps(embeddings(s, d)))
_method("diffusion_maps_landmarks", lambda s, d: pipelines.diffusion_maps(embeddings(s, d), DiffusionParams(n_landmarks=50, landmarks="random")))
_method("parametric_umap", lambda s, d: pipelines.parametric_umap(embeddings(s, d), ParametricParams()))
_method("parametric_umap_distributed", lambda s, d: encoder.parametric_umap(embeddings(s, d), rounds=ENCODER_ROUNDS))
_method("diffusion_maps_spectral_landmarks", lambda s, d: pipelines.diffusion_maps(embeddings(s, d), DiffusionParams(n_landmarks=50, landmarks="spectral")))
_method("diffusion_maps_density_landmarks", lambda s, d: pipelines.diffusion_maps(embeddings(s, d), DiffusionParams(n_landmarks=50, landmarks="density")))
_method("knn_hnsw", lambda s, d: knn(embeddings(s, d), K, "hnsw"))
_method("knn_ivf", lambda s, d: knn(embeddings(s, d), K, "ivf"))
_method("knn_annoy", lambda s, d: knn(embeddings(s, d), K, "annoy"))
_method("knn_nndescent", lambda s, d: knn(embeddings(s, d), K, "nndescent"))
_method("swiss_roll", lambda s, d: synthetic.swiss_roll(s, 1000))
_method("swiss_roll_biased", lambda s, d: synthetic.swiss_roll(s, 1000, bias=2.0))
_method("synthetic_clusters", lambda s, d: synthetic.clusters(s, 1000, 10))
_method("synthetic_hierarchical", lambda s, d: synthetic.hierarchical(s, 1000, 10))
_method("synthetic_trajectory", lambda s, d: synthetic.trajectory(s, 1000))


def _started(kind: str):
    def f(s, d):
        m = embeddings(s, d)
        at = pipelines.Numbered(m)
        blocks = pipelines.graph_blocks(_umap(s, d), at) if kind == "spectral" else None
        x = pipelines.start(kind, None, blocks, at, m, 2, SEED)
        if blocks is not None:
            blocks.close()
        at.close()
        return at.frame(s, x)

    return f


for _kind in ("spectral", "pca", "random"):
    _method(f"{_kind}_start", _started(_kind))


@query()
def randomised_svd(spark, d):
    found = svd.dense_svd(embeddings(spark, d), 5)
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(5), "s": found.values}))


@query(sql(f"SELECT p::INTEGER AS p, q::INTEGER AS q, {_r('sum(v[p + 1] * v[q + 1])', 9)} AS w FROM pts, range(4) a(p), range(4) b(q) GROUP BY p, q", PTS))
def triangular_factor(spark, d):
    """The products of the factor of four columns with itself: what a QR decomposition by tree reduction must keep."""
    names = [f"c{c}" for c in range(4)]
    r = svd.tsqr(embeddings(spark, d).select(*[F.get("features", F.lit(c)).alias(n) for c, n in enumerate(names)]), names)
    g = r.T @ r
    return rounded(spark.createDataFrame([(p, q, float(g[p, q])) for p in range(4) for q in range(4)], "p int, q int, w double"), 9)


@query(sql(f"SELECT id, {_r('sqrt(list_reduce(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b))', 8)} AS norm FROM pts, (SELECT list(x ORDER BY p) AS m FROM (SELECT p, avg(x) AS x FROM (SELECT unnest(range(0, len(v))) AS p, unnest(v) AS x FROM pts) GROUP BY p))", PTS))
def principal_score_norms(spark, d):
    """Scores on all principal axes keep each centred row's length."""
    m = embeddings(spark, d)
    scores = svd.principal_scores(m, shape(m)[1])
    return rounded(scores.select("id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")), 8)


def _as_sparse(edges: DataFrame) -> linalg.Sparse:
    rows = edges.toPandas()
    ids = np.unique(np.concatenate([rows["i"], rows["j"]]))
    return linalg.Sparse(np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"]), rows["w"].to_numpy(float), len(ids))


@query()
def sparse_randomised_svd(spark, d):
    found = svd.sparse_svd(_markov(spark, d), 5)
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(5), "s": found.values}))


@query()
def leading_eigenpairs(spark, d):
    """(k, value, residual) of the ten largest eigenvalues of the symmetric diffusion operator, over tables."""
    found = eigen.extreme_eigenpairs(E.symmetric_operator(_kernel(spark, d)), embeddings(spark, d), 10)
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(len(found.values)), "value": found.values, "residual": found.residuals}))


@query(sql(f"SELECT s.i AS id, {_r('sum(s.w * v.v[1])', 8)} AS v1, {_r('sum(s.w * v.v[2])', 8)} AS v2, {_r('sum(s.w * v.v[3])', 8)} AS v3 FROM scaled s JOIN pts v ON v.id = s.j GROUP BY s.i", *PHATE[:4], ("deg", "SELECT i, pow(sum(w), 0.5) AS s FROM kernel GROUP BY i"), ("scaled", "SELECT g.i, g.j, coalesce(g.w / (a.s * b.s), 0.0) AS w FROM kernel g LEFT JOIN deg a ON g.i = a.i LEFT JOIN deg b ON g.j = b.i")))
def eigen_block_step(spark, d):
    """The operator times a block of columns: one step of the eigensolver."""
    names = ["v1", "v2", "v3"]
    columns = embeddings(spark, d).select("id", *[F.get("features", F.lit(c)).alias(n) for c, n in enumerate(names)])
    return rounded(eigen.multiply_columns(E.symmetric_operator(_kernel(spark, d)), columns, names), 8)


@query()
def spectral_entropies(spark, d):
    """Entropies of the powers of the symmetric diffusion operator by Lanczos quadrature, and their knee."""
    op, nodes = materialize(E.symmetric_operator(_kernel(spark, d)), "operator"), embeddings(spark, d).select("id")
    h = eigen.spectral_entropies(op, nodes, 20, eigen.extreme_eigenpairs(op, nodes, 8))
    return spark.createDataFrame(pd.DataFrame({"t": np.arange(1, 21), "h": h, "knee": linalg.knee(h)}))


@query()
def lanczos_eigenvalues(spark, d):
    m = _as_sparse(E.symmetric_operator(_kernel(spark, d)))
    values, _ = linalg.lanczos(lambda x: m @ x, m.shape[0], 5)
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)), "value": values}))


@query()
def entropy_curve(spark, d):
    h = pipelines.entropies(_markov(spark, d), 20)
    return spark.createDataFrame(pd.DataFrame({"t": np.arange(1, 21), "h": h, "knee": linalg.knee(h)}))


@query()
def fit_curve(spark, d):
    return spark.createDataFrame([(m, s, *fit_ab(m, s)) for m, s in ((0.1, 1.0), (0.5, 1.0))], "min_dist double, spread double, a double, b double")


# More single steps and expressions, all with SQL

@query(sql(f"SELECT id, {_r('sqrt(s)', 7)} AS norm, {_r('v[1] / sqrt(s)', 7)} AS first, {_r('t', 7)} AS with_reverse FROM (SELECT id, v, {DOT.format('p', 'p')} AS s, list_reduce(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] * p[2]), lambda x, y: x + y) AS t FROM pts p)", PTS))
def vector_norms(spark, d):
    v = F.col("features")
    return rounded(embeddings(spark, d).select("id", vectors.norm(v).alias("norm"), F.element_at(vectors.normalise(v), 1).alias("first"), vectors.dot(v, F.reverse(v)).alias("with_reverse")), 7)


GRID = ("grid", "SELECT id, least(greatest(floor((x - lx) / side * 65536), 0), 65535)::BIGINT AS cx, least(greatest(floor((y - ly) / side * 65536), 0), 65535)::BIGINT AS cy FROM (SELECT id, x, y, min(x) OVER () AS lx, min(y) OVER () AS ly, greatest(max(x) OVER () - min(x) OVER (), max(y) OVER () - min(y) OVER ()) AS side FROM pos)")


@query(sql("SELECT id, list_sum(list_transform(range(0, 16), lambda k: (((cx >> k) & 1) << (2 * k)) + (((cy >> k) & 1) << (2 * k + 1))))::BIGINT AS code FROM grid", PTS, POS, GRID))
def morton_codes(spark, d):
    p = _positions(spark, d)
    b = F.broadcast(p.agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")))
    cells = p.crossJoin(b).select("id", vectors.cell_of(F.col("x"), F.col("lx"), F.col("side"), 1 << 16).alias("cx"), vectors.cell_of(F.col("y"), F.col("ly"), F.col("side"), 1 << 16).alias("cy"))
    return cells.select("id", vectors.morton(F.col("cx"), F.col("cy")).alias("code"))


@query(sql(f"SELECT id, {_r('(t - 0.5) / (-1.0 / 3) * ((t - 2.5 / 3) / (-2.0 / 3))')} AS w0, {_r('(t - 0.5 / 3) / (1.0 / 3) * ((t - 2.5 / 3) / (-1.0 / 3))')} AS w1, {_r('(t - 0.5 / 3) / (2.0 / 3) * ((t - 0.5) / (1.0 / 3))')} AS w2 FROM (SELECT id, x - floor(x) AS t FROM pos)", PTS, POS))
def lagrange_weights(spark, d):
    w = _positions(spark, d).withColumn("w", vectors.lagrange_weights(F.col("x") - F.floor("x")))
    return rounded(w.select("id", *[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(3)]))


TSNE_RE = (ends("joint", "tends"), ("tre", f"SELECT i AS id, ln(1e-8 + sum(phi * d2) / greatest(sum(phi), {E.EPSILON})) AS re, sum(phi) AS phi_sum FROM (SELECT *, 1.0 / (1.0 + d2) AS phi FROM tends) GROUP BY i"))


@query(sql(f"SELECT id, {_r('re')} AS re, {_r('phi_sum')} AS phi_sum FROM tre", *TSNE, POS, *TSNE_RE, recursive=True))
def tsne_embedding_radii(spark, d):
    graph = _tsne(spark, d)
    return rounded(epochs.tsne_radii(graph, _positions(spark, d)))


DENSNE = (
    ("d2s", "SELECT g.i, g.j, g.w, coalesce(a.d, b.d, 0.0) AS d2 FROM joint g LEFT JOIN knn a ON g.i = a.i AND g.j = a.j LEFT JOIN knn b ON g.i = b.j AND g.j = b.i"), *RADII[1:],
    ("stat", "SELECT any_value(m) AS mean, sqrt(var_samp(re) + 0.1) AS std, sum((re - m) * r) / (count(*) - 1) AS cov, count(*) AS n FROM (SELECT re, r, avg(re) OVER () AS m FROM tre JOIN radii ON tre.id = radii.i)"),
    ("shares", f"SELECT t.id, (r / std - cov / pow(std, 3.0) * (re - mean)) * (1.0 + exp(-re)) / greatest(phi_sum, {E.EPSILON}) AS s FROM tre t JOIN radii ON t.id = radii.i, stat"),
)


@query(sql(f"SELECT i AS id, {_r('sum(g * dx) * 0.1 / (SELECT n - 1 FROM stat)', 8)} AS gx, {_r('sum(g * dy) * 0.1 / (SELECT n - 1 FROM stat)', 8)} AS gy FROM (SELECT e.i, e.dx, e.dy, 1.0 / (1.0 + e.d2) * (1.0 / (1.0 + e.d2)) * (a.s + b.s) AS g FROM tends e JOIN shares a ON e.i = a.id JOIN shares b ON e.j = b.id) GROUP BY i", *TSNE, POS, *TSNE_RE, *DENSNE, recursive=True))
def densne_epoch_gradient(spark, d):
    m, near = embeddings(spark, d), _knn(spark, d, TSNE_K)
    graph, p = _tsne(spark, d, near), _positions(spark, d)
    both = materialize(epochs.tsne_radii(graph, p).join(density.original_radii(m.select(F.col("id").alias("i")), graph, near).select(F.col("i").alias("id"), "r"), "id"), "radii")
    return rounded(epochs.densne_gradient(graph, p, both, density.correlation_stats(both)), 8)


STEP = (
    ("grad", "SELECT r.id, coalesce(ax, 0.0) - rx / (SELECT sum(z) FROM rep) AS gx, coalesce(ay, 0.0) - ry / (SELECT sum(z) FROM rep) AS gy FROM rep r LEFT JOIN att a ON a.id = r.id"),
    ("ups", "SELECT id, CASE WHEN gx > 0 THEN 1.2 ELSE 0.8 END::DOUBLE AS wx, CASE WHEN gy > 0 THEN 1.2 ELSE 0.8 END::DOUBLE AS wy, gx, gy FROM grad"),
    ("caps", "SELECT id, wx, wy, ux, uy, CASE WHEN sqrt(ux * ux + uy * uy) > 5.0 THEN 5.0 / sqrt(ux * ux + uy * uy) ELSE 1.0 END AS k FROM (SELECT *, -200.0 * wx * gx AS ux, -200.0 * wy * gy AS uy FROM ups)"),
    ("new", "SELECT c.id, p.x + c.ux * c.k AS x, p.y + c.uy * c.k AS y, c.wx, c.wy FROM caps c JOIN pos p USING (id)"),
)


@query(sql(f"SELECT id, {_r('x - avg(x) OVER ()', 5)} AS x, {_r('y - avg(y) OVER ()', 5)} AS y, wx, wy FROM new", *TSNE, *TSNE_GRAD, *STEP, recursive=True))
def tsne_descent_step(spark, d):
    graph, p = _tsne(spark, d), _positions(spark, d)
    state = p.select("id", "x", "y", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("wx"), F.lit(1.0).alias("wy"))
    return rounded(epochs.tsne_step(state, epochs.tsne_gradient(graph, p), 200.0, 0.5).select("id", "x", "y", "wx", "wy"), 5)


_ROOT = (1 - 0.9 ** (EPOCH + 1)) ** 0.5
_RATE = (1 - EPOCH / 500) * _ROOT / (1 - 0.5 ** (EPOCH + 1))


@query(sql(f"SELECT p.id, {_r(f'p.x + CASE WHEN act > 0 THEN {_RATE!r} * (0.5 * gx) / (sqrt({1 - 0.9!r} * (gx * gx)) + {_ROOT * 1e-7!r}) ELSE 0.0 END', 5)} AS x, {_r(f'p.y + CASE WHEN act > 0 THEN {_RATE!r} * (0.5 * gy) / (sqrt({1 - 0.9!r} * (gy * gy)) + {_ROOT * 1e-7!r}) ELSE 0.0 END', 5)} AS y FROM pos p LEFT JOIN (SELECT id, sum(gx) AS gx, sum(gy) AS gy, sum(act) AS act FROM parts GROUP BY id) USING (id)", *UMAP, PERIODS, DUE, DRAWN, POS, *UMAP_GRAD, recursive=True))
def umap_adam_step(spark, d):
    n, _ = shape(embeddings(spark, d))
    g = epochs.umap_gradient(_schedule(spark, d), _positions(spark, d), n, EPOCH, A, B)
    return rounded(distributed._adam(distributed._state(_positions(spark, d)), g, _RATE, _ROOT * 1e-7, 0.5, 0.9, F.col("n_active") > 0).select("id", "x", "y"), 5)


@query(sql(f"SELECT {_r('avg(-ln(q))')} AS loss, count(*) AS n FROM (SELECT least(greatest(1.0 / (1.0 + {A} * pow(d2 + 1e-6, {B})), 1e-7), 1.0 - 1e-7) AS q FROM gends)", *UMAP, POS, ends("graph", "gends"), recursive=True))
def parametric_loss(spark, d):
    return rounded(epochs.umap_loss(_umap(spark, d).select("i", "j", F.lit(1.0).alias("target")), _positions(spark, d), A, B))


@query(sql(f"SELECT {_r('corr(sqrt(k.d), sqrt(e.d2))')} AS correlation FROM ends e JOIN knn k ON e.i = k.i AND e.j = k.j", PTS, knn_part(K), POS, ends("knn")))
def distance_correlation(spark, d):
    near = epochs.with_ends(_knn(spark, d), _positions(spark, d))
    return rounded(near.agg(F.corr(F.sqrt("d"), F.sqrt("d2")).alias("correlation")))


MARK_XY = ("mxy", "SELECT landmark, v[1] * 10 AS x, v[2] * 10 AS y FROM marks")


def _mark_coordinates(spark, d):
    return diffusion.random_landmarks(embeddings(spark, d), N_LANDMARKS, SEED).select("landmark", F.array(F.get("features", F.lit(0)) * 10, F.get("features", F.lit(1)) * 10).alias("x"))


def _xy(df):
    return df.select(F.col("i").alias("id"), F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y"))


@query(sql(f"SELECT n.i AS id, {_r('sum(n.w * m.x)')} AS x, {_r('sum(n.w * m.y)')} AS y FROM nl1 n JOIN mxy m ON n.j = m.landmark GROUP BY n.i", *PHATE, MARKS, ASSIGNED, *LANDMARK_OP[2:4], MARK_XY))
def landmark_interpolation(spark, d):
    m = embeddings(spark, d)
    assigned = diffusion.assign_to_landmarks(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED))
    return rounded(_xy(diffusion.interpolate(diffusion.landmark_operators(_markov(spark, d), assigned)[1], _mark_coordinates(spark, d))))


@query(sql(f"SELECT t.i AS id, {_r('sum(t.w * m.x) / 0.5')} AS x, {_r('sum(t.w * m.y) / 0.25')} AS y FROM (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, j, exp(-(d / greatest(far, {E.EPSILON}))) AS w FROM near) WHERE w >= 0.0001) t JOIN mxy m ON t.j = m.landmark GROUP BY t.i", PTS, MARKS, TRANS, MARK_XY))
def nystroem_extension(spark, d):
    m = embeddings(spark, d)
    to = diffusion.to_landmark_transitions(m, diffusion.random_landmarks(m, N_LANDMARKS, SEED), PHATE_K)
    return rounded(_xy(diffusion.nystroem(to, _mark_coordinates(spark, d), [0.5, 0.25])))


@query(f"SELECT epoch, CASE WHEN epoch < 100 THEN 2.0 WHEN epoch < 200 THEN 3.0 ELSE 1.0 END::DOUBLE AS near, {_r('CASE WHEN epoch < 100 THEN 1000.0 * (1 - epoch / 100.0::DOUBLE) + 3.0 * (epoch / 100.0::DOUBLE) WHEN epoch < 200 THEN 3.0 ELSE 0.0 END::DOUBLE')} AS mid, 1.0::DOUBLE AS further FROM (SELECT unnest(range(0, 450, 10)) AS epoch)")
def pacmap_phases(spark, d):
    return rounded(spark.createDataFrame([(e, *epochs.phase_weights(e)) for e in range(0, 450, 10)], "epoch long, near double, mid double, further double"))
