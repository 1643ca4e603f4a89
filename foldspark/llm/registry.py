"""The thin queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, compression, html_text, mixing, negatives, packing, quality, sharding, simhash, tokens, toxicity, url_filter
from .common import table

URL_RULES = "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)"


#: Factor of the ANN query. Vectors of the test tables have no clusters, so only exact search reaches the recall asked for.
ANN_FACTOR = 1.0


def op1_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, ANN_FACTOR)


OP1_SQL = """
WITH held AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), measured AS (
  SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM held
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM measured q JOIN measured c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.sql(URL_RULES)).drop("url")


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT s.*,
         (SELECT max({'l': length(rhost || rpath), 'h': length(rhost), 'r': rhost || rpath, 'v': rverdict}) FROM rules
          WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS best
  FROM split s
)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mix_sql(documents: str = "documents") -> str:
    """The steps of ``mixing.mix`` with its defaults; seats are ranked among all candidate quotients."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null/' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM {documents}
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), capped AS (
  SELECT *, CASE place % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS weight, source_size * {mixing.EPOCHS} AS cap
  FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targeted AS (
  SELECT source, source_size, n, place,
         least(cap::DOUBLE, coalesce(min_by(level, {{'r': cap::DOUBLE / weight, 'p': place}}) FILTER (WHERE cap::DOUBLE / weight >= level) OVER (), 0.0) * weight) AS target
  FROM levels
), all_blocks AS (
  SELECT round(sum(source_size)::DOUBLE / {mixing.BLOCK})::BIGINT AS seats, sum(target) AS w, count(*) AS k FROM targeted
), seats AS (
  SELECT place, target / (2 * s - 1) AS q, row_number() OVER (ORDER BY target / (2 * s - 1) DESC, place) AS r
  FROM (SELECT place, target, unnest(range(1, (floor(target * (seats + k / 2.0) / w + 0.5) + 2)::BIGINT)) AS s
        FROM targeted, all_blocks WHERE target > 0 AND seats > 0)
), source_blocks AS (
  SELECT t.*, coalesce(g.blocks, 0) AS blocks, ceil(t.n / {mixing.PER_SHARD}.0)::BIGINT AS shards
  FROM targeted t LEFT JOIN (SELECT place, count(*) AS blocks FROM seats, all_blocks WHERE r <= all_blocks.seats GROUP BY place) g USING (place)
), put AS (
  SELECT *, key % shards AS shard FROM (
    SELECT d.doc_id, d.size, b.source_size, b.target, b.place, b.blocks, b.shards, d.key
    FROM sized d JOIN source_blocks b ON d.source IS NOT DISTINCT FROM b.source)
), shards AS (
  SELECT place, shard, any_value(blocks) AS blocks, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY place) AS w, count(*) OVER (PARTITION BY place) AS k
  FROM put GROUP BY place, shard
), shard_seats AS (
  SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY words::DOUBLE / (2 * s - 1) DESC, shard) AS r, blocks
  FROM (SELECT *, unnest(range(1, (floor(words::DOUBLE * (blocks + k / 2.0) / w + 0.5) + 2)::BIGINT)) AS s FROM shards WHERE words > 0 AND blocks > 0)
), quotas AS (
  SELECT s.place, s.shard, s.words, least(coalesce(g.quota, 0) * {mixing.BLOCK}, s.words * {mixing.EPOCHS}) AS wanted,
         ('0x' || substr(md5('{mixing.SEED}-start:' || s.place || '/' || s.shard), 1, 15))::BIGINT % greatest(ceil(s.words::DOUBLE / {mixing.BLOCK})::BIGINT, 1) * {mixing.BLOCK} AS begin
  FROM shards s LEFT JOIN (SELECT place, shard, count(*) AS quota FROM shard_seats WHERE r <= blocks GROUP BY place, shard) g USING (place, shard)
), laid AS (
  SELECT p.*, q.words, q.begin, CASE WHEN q.words > 0 THEN q.wanted // q.words ELSE 0 END AS rounds, CASE WHEN q.words > 0 THEN q.wanted % q.words ELSE 0 END AS rest,
         sum(p.size) OVER (PARTITION BY p.place, p.shard ORDER BY p.key, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS hi
  FROM put p JOIN quotas q USING (place, shard)
)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(least(hi, least(begin + rest, words)) - greatest(hi - size, begin), 0)
        + greatest(least(hi, begin + rest - words) - greatest(hi - size, 0), 0))::BIGINT AS taken
FROM laid
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label)
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH held AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM held a JOIN held c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compressed_vectors(table(spark, sf_dir, "embeddings"))


def codes_sql() -> str:
    """The rounds of ``compression.compress`` one after the other, every distance computed."""
    n, k, rounds = compression.PARTS, compression.ENTRIES, compression.ROUNDS
    steps = [
        f"""held AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, * FROM (
    SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({compression.SCALE} * x)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // {n}) + 1 : (p + 1) * (len(v) // {n})] AS v FROM held, range({n}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row - 1 AS e, v AS c FROM parts WHERE row <= {k}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""assigned{r} AS MATERIALIZED (
  SELECT row, p, best.e AS e, best.d AS d, v FROM (
    SELECT row, x.p, any_value(x.v) AS v, min({{'d': list_sum(list_transform(list_zip(x.v, b.c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT, 'e': b.e}}) AS best
    FROM parts x JOIN book{r} b ON x.p = b.p GROUP BY row, x.p)
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM assigned{r}, range(1, 1 + (SELECT max(len(v)) FROM parts)) t(i) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)""")
    return f"""
WITH {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned{rounds} GROUP BY row
)
SELECT h.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY h.label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM held h JOIN coded c USING (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vp_trees, op2_text_density, op3_toxicity, op4_token_counts, op5_kd_sharding, op6_best_fit_packing, op7_url_filter, op8_simhash, op9_mixing, op10_quality_rules, op11_bpe_automaton, op12_hard_negatives, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_vp_trees": OP1_SQL, "op7_url_filter": OP7_SQL, "op9_mixing": mix_sql(), "op12_hard_negatives": OP12_SQL, "op13_vector_codes": codes_sql()}
