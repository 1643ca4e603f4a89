"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches hold about the same number of bytes, whatever the number of texts, and
a long text is split where splitting can't change its tokens, so one batch never
holds more than BATCH_BYTES plus one indivisible run.

The vocabulary is byte-level BPE. Its pre-tokenizer matches, from the left,
contractions, ``" ?letters"``, ``" ?digits"``, ``" ?others"`` and white space; no
match crosses from a character that isn't white space to one that is, nor from a
full stop or the like to a letter. Hence a cut before a blank or line end that
follows a character other than white space is safe, and so is one between such a
mark and a letter: both sides tokenize as they do in the whole text.

Two libraries encode the same vocabulary. ``tokenizers`` is the one whose
results count; ``tiktoken`` is several times faster and gives the same ids
wherever both agree about Unicode classes. Texts of characters in SETTLED,
whose classes no Unicode version has changed, take the fast one, all others
the first. tests/llm compares them over code points and random texts.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, spread

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = "<|endoftext|>"
END_ID = 50256
#: The most bytes that are encoded in one call.
BATCH_BYTES = 1 << 20
#: Latin letters, IPA and general punctuation.
SETTLED = re.compile("[\x00-ʯ‐-‧‰-⁞€]*")
_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])|(?<=[.,;:!?。，、；：！？])(?=[^\W\d_])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as the library for the vocabulary gives them."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path or vocabulary_path()
        self.slow = Tokenizer.from_file(self.path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        ranks = ranks or (vocabulary_path(RANKS) if path is None else None)
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END: END_ID})
            self._special = {END}

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text or piece, as unsigned 32-bit numbers."""
        if not text:
            return np.empty(0, "<u4")
        if self.fast is not None and SETTLED.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special=self._special, disallowed_special=())
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of a batch of pieces."""
        out = [0] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.fast is not None and SETTLED.fullmatch(text):
                out[k] = len(self.fast.encode_to_numpy(text, allowed_special=self._special, disallowed_special=()))
            elif text:
                rest.append(k)
        if rest:
            for k, e in zip(rest, self.slow.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = len(e)
        return out


def pieces(text: str, most: int = BATCH_BYTES // 4) -> Iterator[str]:
    """The text in parts of about ``most`` characters that tokenize alone as they do together.

    A run without a safe boundary stays whole.
    """
    at, end = 0, len(text)
    while end - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def balanced(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (owners, pieces) of about the same number of UTF-8 bytes."""
    owners: list[int] = []
    batch: list[str] = []
    held = 0
    for k, text in enumerate(texts):
        for piece in pieces(text or "", most // 4):
            size = len(piece) if piece.isascii() else len(piece.encode())
            if batch and held + size > most:
                yield owners, batch
                owners, batch, held = [], [], 0
            owners.append(k)
            batch.append(piece)
            held += size
    if batch:
        yield owners, batch


_kept: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder for each worker process; loading the files takes a second."""
    if (path, ranks) not in _kept:
        _kept[path, ranks] = Encoder(path, ranks)
    return _kept[path, ranks]


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, n_tokens: str = "n_tokens", path: str | None = None, ranks: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Columns ``keep`` of df (default: all) and the number of tokens of ``text``, in place of any column of its name.

    Null and empty texts have 0 tokens. Rows are independent: repeated rows and
    null ids stay as they are. Narrow: no shuffle but for tiny inputs. An empty
    table gives none.
    ``path`` is another vocabulary file for ``tokenizers``; ``ranks`` the same
    vocabulary as ranks, where there is one.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != n_tokens]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(n_tokens, T.LongType())])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks)
        for b in batches:
            total = np.zeros(b.num_rows, np.int64)
            for owners, batch in balanced(b.column(b.num_columns - 1).to_pylist(), batch_bytes):
                np.add.at(total, owners, enc.counts(batch))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total)], names=[*keep, n_tokens])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(released(lengths), schema)


def token_counts(documents: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each document. Other columns, of any name, aren't read."""
    held = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(held, "text", ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
