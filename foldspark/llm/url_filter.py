"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and a path; it fits its host and all subdomains where the
URL's path starts with the rule's. So a URL can only meet rules among a few
keys: its last k labels and first m characters, for the (k, m) that occur among
the rules, whatever their number. Each key is tested against the Bloom filter of
all rules; those that pass go on to an exact hash join with the rules, which
removes the false positives. Most URLs have none or few: up to COLUMNS possible
keys are columns, each joined, so rows aren't shuffled unless the rules are too
many to broadcast. URLs with more are exploded and grouped by (host, path).

The filter is split-block (Putze, Sanders and Singler, "Cache-, Hash- and
Space-Efficient Bloom Filters", 2007): a key picks one block of eight 32-bit
words and sets one bit in each. It is a binary literal of 32 * n_blocks bytes;
MOST_BLOCKS bounds it, whatever the number of rules: more rules only mean more
false positives, which the join removes.

DataFrame functions only. Tests count what a filter that is too small lets pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Odd multipliers, one for each word of a block, those of the Parquet format's Bloom filters.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: 4 MB.
MOST_BLOCKS = 1 << 17
RULES_IN_BLOCK = 16
#: The most rules that are broadcast; beyond, both sides of a join are shuffled.
BROADCAST_RULES = 100_000
#: Possible keys of a URL that are joined as columns; URLs with more take another way to the same result.
COLUMNS = 3
#: Parts that rows without a possible hit are dealt into where they are shuffled.
PARTS = 4096


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)).cast("int")


def _bit(h: Column, salt: int) -> Column:
    """The place, 0 to 31, of the bit that the low half of the hash has in a word."""
    return F.shiftright((h.bitwiseAND(0xFFFFFFFF) % (1 << 31) * (salt | 1)).bitwiseAND(0xFFFFFFFF), 27).cast("int")


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_words(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the blocks that are not empty, from rules with a column ``key``."""
    h = _hash(F.col("key"))
    words = [F.bit_or(_one(_bit(h, s))).alias(f"w{k}") for k, s in enumerate(SALTS)]
    return rules.groupBy(_block(h, n_blocks).alias("block")).agg(*words)


def bloom_filter(rules: DataFrame, n_blocks: int) -> bytes:
    """The filter as bytes, words in big-endian order. At most n_blocks rows come to the driver."""
    out = bytearray(32 * n_blocks)
    for row in bloom_words(rules, n_blocks).collect():
        for k in range(8):
            at = 32 * row["block"] + 4 * k
            out[at : at + 4] = row[f"w{k}"].to_bytes(4, "big")
    return bytes(out)


def possible(keys: Column, bloom: bytes) -> Column:
    """Those of an array of keys that the filter may hold. Each key is hashed and its block looked up once."""
    hashed = F.transform(keys, lambda k: F.struct(k.alias("key"), _hash(k).alias("h")))
    looked = F.transform(hashed, lambda x: F.struct(x["key"].alias("key"), x["h"].alias("h"), F.hex(F.substring(F.lit(bloom), _block(x["h"], len(bloom) // 32) * 32 + 1, F.lit(32))).alias("block")))

    def held(x: Column) -> Column:
        out = F.lit(True)
        for k, salt in enumerate(SALTS):
            word = F.conv(F.substring(x["block"], 8 * k + 1, 8), 16, 10).cast("long")
            out = out & (word.bitwiseAND(_one(_bit(x["h"], salt))) != 0)
        return out

    return F.transform(F.filter(looked, held), lambda x: x["key"])


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL that rules of these (labels, path characters) could have."""
    labels = F.split(host, r"\.")
    fitting = F.filter(F.lit([list(x) for x in shapes]), lambda x: (x[0] <= F.size(labels)) & (x[1] <= F.length(path)))
    return F.transform(fitting, lambda x: _key(F.array_join(F.slice(labels, F.size(labels) - x[0] + 1, x[0]), "."), F.substring(path, F.lit(1), x[1])))


def _named(known: DataFrame, key: str, best: str) -> DataFrame:
    return known.select(F.col("key").alias(key), F.struct(F.length("key").alias("long"), F.length("host").alias("host"), F.col("key").alias("rule"), F.col("verdict")).alias(best))


def _joined(rows: DataFrame, known: DataFrame, k: int, small: bool) -> DataFrame:
    """rows with ``__best{k}``, the rule of the k-th possible key. Keys that are null must not meet in one task: they get keys that no rule has."""
    rules = _named(known, f"__key{k}", f"__best{k}")
    if small:
        return rows.withColumn(f"__c{k}", F.get("__keys", F.lit(k))).join(F.broadcast(rules), F.col(f"__c{k}") == F.col(f"__key{k}"), "left")
    none = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("string"))
    return rows.withColumn(f"__c{k}", F.coalesce(F.get("__keys", F.lit(k)), none)).join(rules, F.col(f"__c{k}") == F.col(f"__key{k}"), "left")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", other: str = "allow", n_blocks: int | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls, replacing columns of these names.

    rules: host (lower case), path, verdict; equal (host, path) take the least
    verdict. The longest fitting rule wins, by the length of host and path, then
    the longer host. URLs that no rule fits, null URLs and URLs without ``://``
    get a null rule and ``other``. No rules: the same for all. Rows are
    independent and stay as they are otherwise; repeated rows stay. A URL of any
    length is judged whole. There is no bound on rules or on their shapes.
    """
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    known = known.withColumn("key", _key(F.col("host"), F.col("path")))
    # A row for each (labels, characters) that occurs: at most labels of the longest host times characters of the longest path.
    found = known.groupBy(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).agg(F.count(F.lit(1)).alias("n")).collect()
    shapes, n_rules = sorted((r["labels"], r["chars"]) for r in found), sum(r["n"] for r in found)
    out = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(other))
    bloom = bloom_filter(known, n_blocks or min(MOST_BLOCKS, max(1, -(-n_rules // RULES_IN_BLOCK))))
    kept, small = list(out.columns), n_rules <= BROADCAST_RULES
    out = out.withColumn("__keys", possible(keys_of(F.col("host"), F.col("path"), shapes), bloom))
    few = out.where(F.size("__keys") <= COLUMNS)
    for k in range(COLUMNS):
        few = _joined(few, known, k, small)
    few = few.select(*kept, F.greatest(*[F.col(f"__best{k}") for k in range(COLUMNS)]).alias("__best"))
    many = out.where(F.size("__keys") > COLUMNS)
    rules = _named(known, "__key", "__best")
    places = many.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.explode("__keys").alias("__c")).distinct()
    best = places.join(F.broadcast(rules) if small else rules, F.col("__c") == F.col("__key")).groupBy("__host", "__path").agg(F.max("__best").alias("__best"))
    many = many.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").select(*kept, "__best")
    return few.union(many).select(*kept, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(other)).alias("verdict"))
