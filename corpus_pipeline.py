"""A pipeline over ``documents``: quality, toxicity, near-duplicates, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. All but the last return the
columns that docs has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import jaccard, mixing, packing, quality, simhash, toxicity
from foldspark.llm.common import materialize, table

#: Hashing, learning and byte-pair encoding have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep; both multinomials come from docs."""
    ids = quality.trusted(table(spark, sf_dir, "labels"))
    judged = quality.with_quality(docs, quality.log_ratios(docs, ids), ids, "text", list(docs.columns), prefix="__q_")
    return judged.where("__q_kept").select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the threshold; learnt from the labelled rows among docs.

    A null or empty text has the score of the bias alone, a null doc_id teaches
    nothing; repeated rows stay or go together, an empty table gives none.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, "text", list(docs.columns), "__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the least doc_id, then the least digest of its text.

    Near-duplicates share 0.8 of their five-word shingles or more (the exact
    Jaccard similarity of the sets). SimHash balls find those with the fewest
    changes; fingerprints of 64 bits can't tell 0.8 from less, so what they
    leave is found by meetings on rare shingles (``jaccard``).

    A null doc_id comes last. Of rows equal in both, any one stays. Texts are
    shuffled once, to meet the list of those that stay.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = jaccard.with_shingles(docs.select("doc_id", digest.alias("__digest"), "text"), "text", ["doc_id", "__digest"])
    digests = materialize(marked, "near-duplicates")
    stay = simhash.representatives(digests, ["doc_id", "__digest"], "node", jaccard.roots(digests)).toDF("__i", "__t", "__n")
    # An id that is null meets by its text's digest alone, so nulls don't meet in one task.
    stay = materialize(stay.withColumn("__k", F.coalesce("__i", "__t")).withColumn("__null", F.col("__i").isNull()).drop("__i"), "near-duplicates-stay")
    mine = docs.select(F.struct(*docs.columns).alias("__row"), digest.alias("__text"), F.col("doc_id").isNull().alias("__lone")).withColumn("__key", F.coalesce("__row.doc_id", "__text"))
    same = (F.col("__key") == F.col("__k")) & (F.col("__text") == F.col("__t")) & (F.col("__lone") == F.col("__null"))
    once = mine.join(stay.where("__n = 1"), same, "left_semi")
    repeated = mine.join(stay.where("__n > 1"), same, "left_semi").dropDuplicates(["__key", "__text", "__lone"])
    return once.union(repeated).select("__row.*")


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: the words taken over its own words, rounded.

    Only the documents where a shard's run begins or ends are taken in part. A null
    or empty text has no words and isn't taken, a null source is a source of its own,
    rows without an id lie by their texts; an empty table gives none.
    """
    mixed = mixing.mix(docs.withColumn("__row", F.struct(*docs.columns)), carry=["__row"])
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.when(F.col("size") > 0, F.col("size")))).otherwise(0).cast("int")
    return mixed.select("__row", F.explode(F.array_repeat(F.lit(0), times))).select("__row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("mixing", mixing_to_targets),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs
