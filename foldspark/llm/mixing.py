"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Targets: every source gets its share of all words by weight, at most EPOCHS
   times its own size; the excess is shared again by weight.
2. Sources get blocks of BLOCK words by highest quotients target / (2 s - 1).
3. Each source's blocks are apportioned in the same way to its shards, by the
   words that a shard holds: an integer quota for each shard.
4. In a shard, documents lie in seeded order on a line of words. Whole rounds
   of the line are taken as the quota asks, then a run of blocks from a seeded
   start, so a document is taken as often as the quota covers it.

The highest quotients are found without listing all seats. With K parties,
weights w, sum W and N seats, the divisor W / (N - K / 2) can't give more than N
seats and W / (N + K / 2) can't give fewer. Seats of the first are certain; only
seats between both, at most 2 K in all, are ranked.

DataFrame functions only; MIX_SQL in ``registry`` is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 32
#: Documents in a shard of a source, about.
PER_SHARD = 1000
SEED = "mix-1"
#: Copies of a row that are listed at once.
COPIES = 4096


def seeded(text: Column, seed: str = SEED) -> Column:
    """60 bits of an md5, as a long: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), text)), 1, 15), 16, 10).cast("long")


def capped_targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, weight, source_size): the fixpoint of sharing the excess again.

    Sources stop in the order of cap / weight. With those before stopped, the
    rest would get (all - caps before) / (weights from here) a unit of weight;
    the first source whose cap isn't below that sets the level. One row for each
    source; the windows over all rows hold as many rows as there are sources.
    """
    ordered = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (
        sources.withColumn("cap", F.col("source_size") * epochs)
        .withColumn("all", F.sum("source_size").over(every))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
        .withColumn("open", F.col("cap").cast("double") / F.col("weight") >= F.col("level"))
    )
    level = F.min_by("level", F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(every)
    return at.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("cap", "all", "level", "open")


def sainte_lague(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[str], to: str) -> DataFrame:
    """Adds ``to``, the party's seats: the highest quotients weight / (2 s - 1), ties by ``order``.

    ``seats`` is a column, the same for all parties of a group. Parties of no
    weight get none. (group, order) is a key.
    """
    whole = Window.partitionBy(*[F.col(c) for c in group])
    w, n = F.col(weight).cast("double"), F.col(seats).cast("double")
    known = parties.withColumn("__W", F.sum(w).over(whole)).withColumn("__K", F.count(F.lit(1)).over(whole).cast("double"))
    few = n - F.col("__K") / 2
    known = (
        known.withColumn("__sure", F.when((few > 0) & (F.col("__W") > 0), F.floor(w * few / F.col("__W") + 0.5)).otherwise(0).cast("long"))
        .withColumn("__most", F.when((w > 0) & (n > 0), F.floor(w * (n + F.col("__K") / 2) / F.col("__W") + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("__left", F.col(seats) - F.sum("__sure").over(whole))
    )
    key = [*group, *order]
    tried = known.where("__most > __sure").select(*key, weight, "__left", F.explode(F.sequence(F.col("__sure") + 1, "__most")).alias("__s"))
    first = Window.partitionBy(*group).orderBy((F.col(weight).cast("double") / (2 * F.col("__s") - 1)).desc(), *order)
    won = tried.withColumn("__r", F.row_number().over(first)).where("__r <= __left").groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.count(F.lit(1)).alias("__won"))
    on = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return known.join(won, on, "left").withColumn(to, F.col("__sure") + F.coalesce("__won", F.lit(0))).select(*parties.columns, to)


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, per_shard: int = PER_SHARD, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and the columns ``carry``.

    ``taken`` is the number of words that the mix takes of it, from 0 to
    epochs * size. Sources by code point, null last, weigh ``weights``,
    repeating. Null and empty texts have size 0 and nothing is taken. Rows of one
    id, source and size (without an id: of one text too) lie beside each other in any order, so only their sum is fixed. Texts of
    any length are counted whole. An empty table gives none. Other columns, of any
    name, aren't read.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    carry = carry or []
    # Rows without an id lie by their texts, so they don't meet in one shard.
    key = seeded(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(F.col(text), F.lit(""))))), seed)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("__key"), *carry)
    # Rows that nothing tells apart are counted first, so many of them are few on the line. Each task counts its own, which bounds a count.
    like = ["doc_id", "source", "size", "__key", "__task"]
    alone = [F.lit(0).alias("__task"), F.lit(1).cast("long").alias("__copies")]
    counted = rows.withColumn("__task", F.spark_partition_id()).groupBy(*like).agg(F.count(F.lit(1)).alias("__copies"))
    sized = materialize(rows.select(*like[:-1], *alone) if carry else counted, "mix")
    weight = F.element_at(F.lit(list(weights)), F.col("place") % len(weights) + 1)
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("__copies")).alias("source_size"), F.sum("__copies").alias("__rows"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    sources = capped_targets(sources, epochs).withColumn("blocks", F.round(F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double") / block).cast("long"))
    sources = sainte_lague(sources.withColumn("everything", F.lit(0)), ["everything"], "target", "blocks", ["place"], "source_blocks")
    sources = materialize(sources.withColumn("shards", F.ceil(F.col("__rows") / per_shard).cast("long")).select(F.col("source").alias("__source"), "source_size", "target", "place", "source_blocks", "shards"), "mix-sources")

    put = (rows.select("*", *alone) if carry else sized).join(sources.select("__source", "source_size", "target", "place", "shards"), F.col("source").eqNullSafe(F.col("__source"))).withColumn("shard", F.pmod("__key", "shards"))
    put = put.select("doc_id", "size", "source_size", "target", "place", "shard", "__key", "__task", "__copies", *carry)
    shards = put.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("__copies")).alias("words")).join(sources.select(F.col("place").alias("__place"), "source_blocks"), F.col("place") == F.col("__place")).drop("__place")
    shards = sainte_lague(shards, ["place"], "words", "source_blocks", ["shard"], "quota")
    wanted = F.least(F.col("quota") * block, F.col("words") * epochs)
    start = F.pmod(seeded(F.concat_ws("/", F.col("place").cast("string"), F.col("shard").cast("string")), seed + "-start"), F.greatest(F.ceil(F.col("words") / block), F.lit(1))) * block
    shards = shards.select(
        F.col("place").alias("__p"), F.col("shard").alias("__s"), "words",
        F.when(F.col("words") > 0, F.floor(wanted / F.col("words"))).otherwise(0).cast("long").alias("rounds"),
        F.when(F.col("words") > 0, wanted % F.when(F.col("words") > 0, F.col("words"))).otherwise(0).alias("rest"), start.alias("begin"),
    )
    line = Window.partitionBy("place", "shard").orderBy("__key", "doc_id", "size", "__task").rowsBetween(Window.unboundedPreceding, 0)
    laid = put.withColumn("end", F.sum(F.col("size") * F.col("__copies")).over(line)).join(shards, (F.col("place") == F.col("__p")) & (F.col("shard") == F.col("__s")))
    # One row for each copy again, in two steps so that no list is long.
    last = F.col("__copies") - 1
    laid = laid.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor(last / COPIES)))).withColumn("__copy", F.explode(F.sequence(F.col("__run") * COPIES, F.least(last, (F.col("__run") + 1) * COPIES - 1))))
    high = F.col("end") - F.col("size") * (last - F.col("__copy"))
    low = high - F.col("size")

    def meets(a: Column, b: Column) -> Column:
        return F.greatest(F.least(high, b) - F.greatest(low, a), F.lit(0))

    reach = F.col("begin") + F.col("rest")
    taken = F.col("rounds") * F.col("size") + meets(F.col("begin"), F.least(reach, F.col("words"))) + meets(F.lit(0), reach - F.col("words"))
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)
