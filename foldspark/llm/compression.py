"""Vector codes by product quantization, with adaptive bounds on distances.

Vectors of whole numbers are cut into consecutive parts, and each part position
has a codebook, fitted by Lloyd's rounds in exact integer arithmetic. Which entry
a part is nearest to is kept from round to round with bounds (Drake and Hamerly,
"Accelerated k-means with adaptive distance bounds", 2012):

* an upper bound on the distance to its own entry;
* its b closest other entries, in order, each with a lower bound on its distance;
* one outer bound, which no entry beyond those is nearer than.

When entries move, bounds move with them: the upper one by the move of the own
entry, a lower one by that entry's, the outer one by the largest move. Where the
upper bound is below the first lower bound, nothing is computed. Else only the
entries before the first bound that it is below are, and all of them if it is
below none. Bounds are doubles; wherever one can't decide by a margin, integer
distances do, with ties to the smaller index, so results are those of plain rounds.
b is adapted: the next round keeps as many bounds as this one used at most, and no
fewer than an eighth of the entries.

Each round reads the table of the last one and writes the next, row by row: the
state is a column set of the rows, nothing is shuffled, and a lost executor's
rows are read again. What the driver sees are the sums of each entry's parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WrongDimensions
from .common import discard, materialize, released, spread

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are bounded at once.
AT_ONCE = 2048
#: Whole components are smaller than this, so that sums of squares fit a long.
MOST_COMPONENT = 1 << 26
#: Totals of so many groups are broadcast, more are joined by shuffling.
MOST_GROUPS = 100_000
#: Parts that each group of a shuffled join is dealt into.
SALT = 64


class Bounds:
    """The kept state of rows: arrays of shape (rows, parts) or (rows, parts, b)."""

    def __init__(self, own, upper, near, lower, outer):
        self.own, self.upper, self.near, self.lower, self.outer = own, upper, near, lower, outer

    @staticmethod
    def fresh(n: int, parts: int, b: int) -> "Bounds":
        """Bounds that say nothing."""
        return Bounds(np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf), np.zeros((n, parts, b), np.uint8), np.zeros((n, parts, b)), np.zeros((n, parts)))


def squared(v: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Exact squared distances (..., entries) of parts (..., width) from entries (entries, width)."""
    gap = v[..., None, :] - codebook
    return np.einsum("...k,...k->...", gap, gap)


def _margin(x: np.ndarray) -> np.ndarray:
    """What a bound must be apart to decide; far above the rounding of its few sums."""
    return 1e-9 * (1 + np.abs(x))


def assign(v: np.ndarray, books: np.ndarray, moves: np.ndarray, held: Bounds) -> tuple[Bounds, np.ndarray, int]:
    """The next state of rows v (rows, parts, width) under books (parts, entries, width), how many bounds each row used, and how many distances were computed.

    ``moves`` (parts, entries): how far each entry went since the state was made.
    """
    n, parts, _ = v.shape
    k = books.shape[1]
    b = held.near.shape[2]
    used = np.zeros(n, np.int8)
    computed = 0
    own, upper, near, lower, outer = held.own.copy(), held.upper.copy(), held.near.copy(), held.lower.copy(), held.outer.copy()
    for p in range(parts):
        book, move = books[p], moves[p]
        u = upper[:, p] + move[own[:, p]]
        low = np.concatenate([lower[:, p] - move[near[:, p]], (outer[:, p] - move.max(initial=0.0))[:, None]], axis=1)
        # In order again: a bound is no more than those behind it.
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].copy()
        rows = np.flatnonzero(~(u + _margin(u) < low[:, 0]))
        if len(rows):  # the true distance may decide
            gap = v[rows, p] - book[own[rows, p]]
            u[rows] = np.sqrt((gap * gap).sum(1))
            computed += len(rows)
            rows = rows[~(u[rows] + _margin(u[rows]) < low[rows, 0])]
        # The first bound that lies above: entries before it are in question.
        depth = (~(u[rows] + _margin(u[rows]) < low[rows].T)).sum(0)
        for z in range(1, b + 1):
            some = rows[depth == z]
            if not len(some):
                continue
            among = np.concatenate([own[some, p][:, None], near[some, p, :z]], axis=1)
            gap = v[some, p][:, None] - book[among]
            d = (gap * gap).sum(2)
            computed += d.size
            order = np.lexsort((among, d), axis=1)
            among, d = np.take_along_axis(among, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
            own[some, p], u[some] = among[:, 0], d[:, 0]
            near[some, p, :z], low[some, :z] = among[:, 1:], d[:, 1:]
            # The one given up may lie behind the next bound; bounds stay in order.
            low[some] = np.minimum.accumulate(low[some][:, ::-1], axis=1)[:, ::-1]
            used[some] = np.maximum(used[some], z)
        some = rows[depth > b]
        for s in range(0, len(some), AT_ONCE):
            part = some[s : s + AT_ONCE]
            d = squared(v[part, p], book)
            computed += d.size
            order = np.argsort(d, axis=1, kind="stable")
            d = np.sqrt(np.take_along_axis(d, order, 1))
            own[part, p], u[part] = order[:, 0], d[:, 0]
            near[part, p], low[part, :b] = order[:, 1 : b + 1], d[:, 1 : b + 1]
            low[part, b] = d[:, b + 1] if k > b + 1 else np.inf
            used[part] = b
        upper[:, p], lower[:, p], outer[:, p] = u, low[:, :b], low[:, b]
    return Bounds(own, upper, near, lower, outer), used, computed


def narrowed(held: Bounds, b: int) -> Bounds:
    """The state with b kept entries instead of more: the outer bound takes in what is dropped."""
    if b >= held.near.shape[2]:
        return held
    return Bounds(held.own, held.upper, held.near[:, :, :b], held.lower[:, :, :b], np.minimum(held.outer, held.lower[:, :, b]))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(a: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as lists."""
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(a).ravel()))


_STATE = "own array<smallint>, upper array<double>, near array<smallint>, lower array<double>, outer array<double>, used tinyint"


def _rounded(state: DataFrame, keep: list[T.StructField], books, moves, parts: int, b: int, first: bool) -> DataFrame:
    """The table of the next round, written."""
    names = [c.name for c in keep]
    schema = T.StructType([*keep, T.StructField("__v", T.ArrayType(T.LongType())), *T._parse_datatype_string(_STATE).fields])
    sent = state.sparkSession.sparkContext.broadcast((books, moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                x = whole.slice(s, AT_ONCE)
                n = x.num_rows
                v = _matrix(x.column(len(names)), n)
                if first:
                    held = Bounds.fresh(n, parts, b)
                else:
                    own, upper, near, lower, outer = (_matrix(x.column(len(names) + 1 + c), n) for c in range(5))
                    wide = near.shape[1] // parts
                    held = narrowed(Bounds(own.astype(np.uint8), upper, near.astype(np.uint8).reshape(n, parts, wide), lower.reshape(n, parts, wide), outer), b)
                after, used, _ = assign(v.reshape(n, parts, -1), books, moves, held)
                made = [after.own.astype(np.int16), after.upper, after.near.reshape(n, -1).astype(np.int16), after.lower.reshape(n, -1), after.outer]
                yield pa.RecordBatch.from_arrays([*x.columns[: len(names)], x.column(len(names)), *(_lists(a) for a in made), pa.array(used)], names=schema.names)

    read = state if first else state.select(*names, "__v", "own", "upper", "near", "lower", "outer")
    return materialize(read.mapInArrow(released(run), schema), "codes-round")


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts (parts, entries), sums (parts, entries, width) of the parts of each entry, and the most bounds that a row used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, most = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64), 0
        for x in batches:
            n = x.num_rows
            if not n:
                continue
            at = (_matrix(x.column(1), n).astype(np.int64) + entries * np.arange(parts)).ravel()
            v = _matrix(x.column(0), n).reshape(-1, width)
            count += np.bincount(at, minlength=parts * entries)
            np.add.at(total, at, v)
            most = max(most, pc.max(x.column(2)).as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * entries)), pa.array(count), _lists(total), pa.array(np.full(parts * entries, most, np.int64))], names=["at", "n", "total", "most"])

    each = state.select("__v", "own", "used").mapInArrow(released(run), "at long, n long, total array<long>, most long")
    # One row for each entry of each part: the codebooks' size.
    added = each.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(c))) for c in range(width)]).alias("total"), F.max("most").alias("most")).orderBy("at").collect()
    return np.array([r["n"] for r in added]).reshape(parts, entries), np.array([r["total"] for r in added], np.int64).reshape(parts, entries, width), max(r["most"] for r in added)


def whole_parts(vectors: DataFrame, keep: list[str], vector: str, scale: int) -> DataFrame:
    """Columns ``keep`` and __v = floor(scale * x), of the rows whose vector is neither null nor holds null, NaN or infinity."""
    x = F.col("__x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = vectors.select(*keep, F.col(vector).cast("array<double>").alias("__x")).where(x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return held.select(*keep, F.transform(x, lambda c: F.floor(c * scale)).alias("__v"))


class Codes:
    """What ``compress`` gives: ``table`` (the kept columns, code array<smallint>, error long) and ``books`` (parts, entries, width)."""

    def __init__(self, table: DataFrame, books: np.ndarray):
        self.table, self.books = table, books

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, with commas between them."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self) -> DataFrame:
        """The kept columns and ``approximation`` array<long>: each part's entry, put together."""
        spark = self.table.sparkSession
        sent = spark.sparkContext.broadcast(self.books)
        keep = [f for f in self.table.schema if f.name not in ("__code", "__error")]
        schema = T.StructType([*keep, T.StructField("approximation", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            for x in batches:
                code = _matrix(x.column(len(keep)), x.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], _lists(books[np.arange(len(books)), code].reshape(x.num_rows, -1))], names=schema.names)

        return self.table.select(*[f.name for f in keep], "__code").mapInArrow(released(run), schema)


def compress(vectors: DataFrame, keep: list[str], order: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codes of all usable vectors: their table has the columns ``keep``, __code array<smallint> and __error long. None where no vector is usable.

    Codebooks start as the parts of the ``entries`` rows of smallest ``order``,
    nulls last, repeated rows counting each; of fewer rows, all. Rows with equal
    ``order`` come by their vectors. Each round assigns every part to its nearest
    entry, ties to the lower index, and replaces each entry by the components'
    floor(sum / count); an unused entry stays. At the end parts are assigned once
    more. Vectors that are null or hold null or non-finite components are left out.
    Raises WrongDimensions unless all have one length that ``parts`` divides, and
    ValueError where a component of 2^26 or more could make a sum of squares too
    large, or for more than 256 entries.
    """
    if entries > 256:
        raise ValueError("an index has at most 256 values")
    rows = materialize(spread(whole_parts(vectors, keep, vector, scale)), "codes-rows")
    seen = rows.agg(F.min(F.size("__v")).alias("least"), F.max(F.size("__v")).alias("most"), F.max(F.aggregate("__v", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))).alias("largest")).first()
    if seen["least"] is None:
        discard(rows)
        return None
    if seen["least"] != seen["most"] or seen["least"] == 0 or seen["least"] % parts:
        raise WrongDimensions(f"vectors of {seen['least']} to {seen['most']} dimensions aren't {parts} equal parts each")
    if seen["largest"] >= MOST_COMPONENT:
        raise ValueError(f"components of {seen['largest']} are too large")
    start = rows.orderBy(F.col(order).asc_nulls_last(), "__v").limit(entries).select("__v").collect()
    books = np.array([r["__v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    k, width = books.shape[1:]
    least = max(1, k // 8)
    b = max(least, k // 4) if k > 1 else 0
    kept = [rows.schema[c] for c in keep]
    moves = np.zeros(books.shape[:2])
    state = rows
    for turn in range(rounds + 1):
        after = _rounded(state, kept, books, moves, parts, b, turn == 0)
        discard(state)
        state = after
        if turn == rounds:
            break
        count, total, most = _sums(state, parts, k, width)
        moved = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
        gap = moved - books
        # Rounded up, so that bounds stay bounds.
        moves = np.sqrt((gap * gap).sum(2)) * (1 + 1e-12)
        books = moved
        if turn and k > 1:  # the first round computes all
            b = min(b, max(least, most))
    return Codes(_coded(state, kept, books, parts), books)


def _coded(state: DataFrame, keep: list[T.StructField], books: np.ndarray, parts: int) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*keep, T.StructField("__code", T.ArrayType(T.ShortType())), T.StructField("__error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for x in batches:
            n = x.num_rows
            own = _matrix(x.column(len(keep) + 1), n).astype(np.int64)
            gap = _matrix(x.column(len(keep)), n).reshape(n, parts, -1) - books[np.arange(parts), own]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], x.column(len(keep) + 1), pa.array((gap * gap).sum((1, 2)))], names=schema.names)

    return state.select(*[f.name for f in keep], "__v", "own").mapInArrow(released(run), schema)


def compressed_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed over parts), label_error (summed over equal labels, nulls together) and codebooks_sha256.

    An empty table, or one without usable vectors, gives no rows.
    """
    found = compress(vectors.select("vec_id", "label", "embedding"), ["vec_id", "label"], parts=parts, entries=entries, rounds=rounds, scale=scale)
    kind = vectors.schema["label"].dataType.simpleString()
    if found is None:
        empty = vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long")
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    code = F.concat_ws("", F.transform("__code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    rows = materialize(found.table.select("vec_id", "label", code.alias("code"), F.col("__error").alias("error")), "codes")
    totals = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    if totals.count() <= MOST_GROUPS:
        both = rows.join(F.broadcast(totals.withColumnRenamed("label", "__label")), F.col("label").eqNullSafe(F.col("__label")))
    else:  # a hot label is dealt into SALT parts
        salted = totals.withColumnRenamed("label", "__label").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = rows.withColumn("__at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
