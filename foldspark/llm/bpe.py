"""BPE encoding and decoding by a tokenization automaton.

Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (CIAA
2024). The automaton reads tokens. It starts with one state and an arc for each
byte, so it accepts every spelling of every word, and then takes one gadget for
each merge (u, v), in their order: wherever an arc u meets an arc v, an arc uv
goes past both, and v may not follow u any more. What it accepts at the end are
exactly the token sequences that the merges give, one for each word.

* All arcs of one label end in one state. A gadget gives the label u a new state,
  a copy of the old one without v; the label uv ends where v ends. So there is at
  most one state for each merge, and a state is kept while some label ends there.
* A label that grows out of a forbidden one by later merges on its right is
  forbidden with it. Labels are numbered along the tree "token, its left part",
  later children first, so each gadget forbids one interval of labels, and a
  state is a short sorted list of intervals. The arc of a label out of a state
  is there unless an interval holds it: that is the transition table.

Encoding reads bytes. Every prefix of a word has one correct spelling, so one arc
ends at each byte: of the labels that end there, which a table of byte transitions
gives (Aho and Corasick, 1975), the one that the state at its beginning has an arc
for. The arcs from the last byte back are the tokens; their
labels, emitted in order, are the text again.

Words are what the vocabulary's pre-tokenizer makes of a text. The classes of
characters that it needs are asked from the library itself, once for each
character, so no version of Unicode is assumed.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, spread
from .tokens import balanced, vocabulary_path

#: The pre-tokenizer's pattern, over ASCII stand-ins of each class of characters.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
STAND_INS = {"letter": "x", "number": "0", "space": "\t", "other": "!"}
#: Words whose tokens a worker remembers before it starts anew.
MOST_WORDS = 100_000
#: Words of up to so many bytes are spelt many at once, longer ones alone.
MOST_BYTES = 64
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 19


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for what follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """States, arcs and labels, as arrays.

    ``starts`` and ``ends`` hold the forbidden intervals of state s at
    ``first[s]`` to ``first[s + 1]``; ``target`` is the state that each label's
    arcs end in; ``step`` the byte transitions (node * 256 + byte to node),
    ``fail`` where to go on without one, and ``label_of`` the label that a node
    completes. ``ids`` and ``labels`` give a label's id and bytes. State 0 is the
    start, every state accepts.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("a byte without a token: some words would have no path")
        made = {u + v: k for k, (u, v) in enumerate(merges)}
        if len(made) < len(merges):
            raise ValueError("two merges make the same token: its arcs would end in two states")
        grown: dict[bytes, list[tuple[int, bytes]]] = {}
        for k, (u, v) in enumerate(merges):
            grown.setdefault(u, []).append((k, u + v))
        number, behind = self._numbered([t for t in tokens if t not in made], grown)
        ends = {t: 0 for t in tokens if t not in made}
        # Versions of states: each is its parent without an interval of labels.
        parent, cut = [-1], [(0, 0)]

        def forbidden(state: int, label: int) -> bool:
            while state:
                if cut[state][0] <= label < cut[state][1]:
                    return True
                state = parent[state]
            return False

        for k, (u, v) in enumerate(merges):
            if u not in ends or v not in ends or forbidden(ends[u], number[v]):
                continue  # nowhere does u meet v: earlier merges take one of them, so there is no arc for the pair
            before = ends[v]
            parent.append(ends[u])
            # v itself, and what grew or grows out of it by this merge and later ones.
            later = [t for rank, t in grown.get(v, []) if rank >= k]
            cut.append((number[v], behind[later[0]] if later else number[v] + 1))
            ends[u], ends[u + v] = len(parent) - 1, before
        self._flatten(ends, parent, cut, number, tokens)

    @staticmethod
    def _numbered(roots: list[bytes], grown: dict[bytes, list]) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """Each token's number, and the number behind all that grow out of it, later merges first."""
        number, behind = {}, {}
        todo = [(t, False) for t in reversed(roots)]
        while todo:
            t, left = todo.pop()
            if left:
                behind[t] = len(number)
                continue
            number[t] = len(number)
            todo.append((t, True))
            todo += [(child, False) for _, child in grown.get(t, [])]  # the last is taken first
        return number, behind

    def _flatten(self, ends, parent, cut, number, tokens) -> None:
        kept = sorted({0, *ends.values()})
        place = {s: k for k, s in enumerate(kept)}
        starts, stops, first = [], [], [0]
        for s in kept:
            found = []
            while s:
                found.append(cut[s])
                s = parent[s]
            held = []
            for a, b in sorted(found):
                if held and a <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
            starts += [a for a, _ in held]
            stops += [b for _, b in held]
            first.append(len(starts))
        self.starts, self.ends, self.first = (np.array(x, np.int32) for x in (starts, stops, first))
        n = len(number)
        self.target, self.ids, self.labels = np.zeros(n, np.int32), np.full(n, -1, np.int32), [b""] * n
        step: dict[int, int] = {}
        label_of = [-1]
        for t, s in ends.items():
            at = number[t]
            self.target[at], self.ids[at], self.labels[at] = place[s], tokens[t], t
            node = 0
            for b in t:
                node = step.setdefault(node << 8 | b, len(label_of))
                if node == len(label_of):
                    label_of.append(-1)
            label_of[node] = at
        # Where the longest beginning of another label goes on when a node has no transition, breadth first.
        fail = [0] * len(label_of)
        below: list[list[tuple[int, int]]] = [[] for _ in label_of]
        for key, node in step.items():
            below[key >> 8].append((key & 255, node))
        order = [node for _, node in below[0]]
        for node in order:
            for byte, to in below[node]:
                at = fail[node]
                while at and at << 8 | byte not in step:
                    at = fail[at]
                fail[to] = step.get(at << 8 | byte, 0)
                order.append(to)
        self.step = np.array(list(step.items()), np.int64)
        self.label_of, self.fail = np.array(label_of, np.int32), np.array(fail, np.int32)

    def runner(self) -> "Runner":
        return Runner(self)


class Runner:
    """An automaton's tables as a worker uses them."""

    def __init__(self, made: Automaton):
        self.step = dict(made.step.tolist())
        self.fail, self.label_of, self.target, self.ids, self.labels = made.fail.tolist(), made.label_of.tolist(), made.target.tolist(), made.ids.tolist(), made.labels
        self.starts, self.ends, self.first = made.starts.tolist(), made.ends.tolist(), made.first.tolist()
        self.arcs: dict[int, bool] = {}
        self.ended: dict[int, tuple[tuple[int, int], ...]] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether a label may follow in a state."""
        lo = self.first[state]
        at = bisect_right(self.starts, label, lo, self.first[state + 1]) - 1
        return at < lo or label >= self.ends[at]

    def _go(self, node: int, byte: int) -> int:
        """The longest beginning of a label that ends with this byte; remembered as a transition."""
        at = node
        while (to := self.step.get(at << 8 | byte)) is None and at:
            at = self.fail[at]
        self.step[node << 8 | byte] = to = to or 0
        return to

    def _ended(self, node: int) -> tuple[tuple[int, int], ...]:
        """(label, number of bytes) of all labels that end here, the longest first."""
        out, at = [], node
        while at:
            if self.label_of[at] >= 0:
                out.append((self.label_of[at], len(self.labels[self.label_of[at]])))
            at = self.fail[at]
        self.ended[node] = found = tuple(out)
        return found

    def tokens(self, word: bytes) -> tuple[int, ...]:
        """The ids along the one path that spells a word."""
        step, ended, arcs, target = self.step.get, self.ended.get, self.arcs, self.target
        if len(arcs) > 1_000_000:
            arcs.clear()
        states = [0]
        arrived: list[tuple[int, int]] = []  # the label of the arc that ends at each byte, and its bytes
        node = 0
        for at, byte in enumerate(word, 1):
            to = step(node << 8 | byte)
            node = self._go(node, byte) if to is None else to
            for one in ended(node) or self._ended(node):
                label, size = one
                key = states[at - size] << 20 | label
                there = arcs.get(key)
                if there is None:
                    there = arcs[key] = self.arc(states[at - size], label)
                if there:
                    break
            arrived.append(one)
            states.append(target[label])
        out = []
        at = len(word)
        while at:
            label, size = arrived[at - 1]
            out.append(self.ids[label])
            at -= size
        out.reverse()
        return tuple(out)


class Words(dict):
    """Numbers of words; those not met before are kept in ``fresh`` until their tokens are known."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


class Spelling:
    """The paths of many words at once, byte by byte: the steps of ``Runner.tokens`` on columns."""

    def __init__(self, made: Automaton):
        self.made = made
        n = len(made.label_of)
        kind = np.uint16 if n < 1 << 16 else np.int32
        self.go = np.zeros((n, 256), kind)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in made.step.tolist():
            children[key >> 8].append((key & 255, node))
        fail = made.fail.tolist()
        order = [0]
        self.last = np.zeros(n, np.int32)  # the longest label that ends at a node: the node that completes it
        self.shorter = np.zeros(n, np.int32)  # and for such a node, the next shorter one
        for node in order:
            if node:
                self.go[node] = self.go[fail[node]]
                self.shorter[node] = self.last[fail[node]]
                self.last[node] = node if made.label_of[node] >= 0 else self.shorter[node]
            for byte, to in children[node]:
                self.go[node, byte] = to
            order += [to for _, to in children[node]]
        self.size = np.array([len(t) for t in made.labels], np.int32)
        self.begin = np.repeat(np.arange(len(made.first) - 1, dtype=np.int64), np.diff(made.first)) << 20 | made.starts

    def arc(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each label may follow in its state."""
        at = np.searchsorted(self.begin, states.astype(np.int64) << 20 | labels, side="right") - 1
        return ~((at >= 0) & (self.begin[at] >> 20 == states) & (labels < self.made.ends[at]))

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has). Words are not empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")  # those still going on come first
        size, most = size[order], int(size.max())
        text = np.zeros((len(words), most), np.uint8)
        text[np.arange(most)[None] < size[:, None]] = np.frombuffer(b"".join([words[k] for k in order.tolist()]), np.uint8)
        state = np.zeros((most + 1, len(words)), np.int32)
        arrived = np.zeros((most, len(words)), np.int32)
        node = np.zeros(len(words), np.int64)
        for at in range(most):
            n = int(np.searchsorted(-size, -at, side="left"))  # words of more than ``at`` bytes
            node = self.go[node[:n], text[:n, at]].astype(np.int64)
            rows, ending = np.arange(n), self.last[node]
            while len(rows):
                label = self.made.label_of[ending]
                there = self.arc(state[at + 1 - self.size[label], rows], label)
                arrived[at, rows[there]] = label[there]
                rows, ending = rows[~there], self.shorter[ending[~there]]
            state[at + 1, :n] = self.made.target[arrived[at, :n]]
        owner, found, rows, at = [], [], np.arange(len(words)), size.copy()
        while len(rows):
            label = arrived[at - 1, rows]
            owner.append(order[rows])
            found.append(self.made.ids[label])
            at = at - self.size[label]
            rows, at = rows[at > 0], at[at > 0]
        owner, found = np.concatenate(owner[::-1]), np.concatenate(found[::-1])
        return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


class Codec:
    """A vocabulary's texts to ids and back."""

    def __init__(self, made: Automaton, special: list[tuple[str, int]], path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.made, self.path, self.run = made, path, None
        self.special = dict(special)
        self._between = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        self._classes: dict[int, str] = {c: chr(c) for c in range(128)}
        self._ask = self.words = None
        labels = [b""] * (1 + max([*made.ids.tolist(), *self.special.values()]))
        for at, t in zip(made.ids.tolist(), made.labels):
            if at >= 0:
                labels[at] = t
        for s, at in self.special.items():
            labels[at] = s.encode()
        self.emitted = labels

    def _forget(self) -> None:
        """Start with no words; the tables of encoding are made at first use, decoding needs none."""
        if self.words is None:
            self.spelling = Spelling(self.made)
        self.words = Words()
        self.pool, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)
        for s in self.special:  # no word is equal to one: the pattern parts letters from other characters
            self.words[s]
        self._learn()

    def _learn(self) -> None:
        """Tokens of the words not met before."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        raw = [w.encode() for w in fresh]
        count = np.zeros(len(raw), np.int64)
        short = [k for k, w in enumerate(raw) if 0 < len(w) <= MOST_BYTES and fresh[k] not in self.special]
        ids, count[short] = self.spelling.tokens([raw[k] for k in short]) if short else (np.empty(0, np.int32), 0)
        if len(short) < len(raw):
            self.run = self.run or self.made.runner()  # long words are rare
            parts = np.split(ids, np.cumsum(count[short])[:-1]) if short else []
            held = dict(zip(short, parts))
            for k in range(len(raw)):
                if k not in held:
                    held[k] = np.array([self.special[fresh[k]]] if fresh[k] in self.special else self.run.tokens(raw[k]), np.int32)
                    count[k] = len(held[k])
            ids = np.concatenate([held[k] for k in range(len(raw))])
        self.pool = np.concatenate([self.pool, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])

    def _class(self, c: str) -> str:
        """The stand-in of a character's class, as the library's own pre-tokenizer joins it."""
        if self._ask is None:
            from tokenizers import Tokenizer

            self._ask = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        for kind in ("letter", "number", "other"):
            if len(self._ask(STAND_INS[kind] + c)) == 1:
                return STAND_INS[kind]
        return STAND_INS["space"]

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii():
            return PATTERN.findall(text)
        classes = self._classes
        for c in set(text):
            if ord(c) not in classes:
                classes[ord(c)] = self._class(c)
        ends = list(accumulate(map(len, PATTERN.findall(text.translate(classes)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def ids_of(self, texts: list[str | None], most: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has). Texts are encoded in batches of bytes; long ones are split where that can't change their ids."""
        total, found = np.zeros(len(texts), np.int64), []
        for owners, batch in balanced(texts, most):
            if self.words is None or len(self.words) > MOST_WORDS:
                self._forget()
            words: list[str] = []
            behind = []
            for piece in batch:
                for part in self._between.split(piece) if self._between is not None else (piece,):
                    words += [part] if part in self.special else self.split(part)
                behind.append(len(words))
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            self._learn()
            first, count = self.first[at], self.first[at + 1] - self.first[at]
            ends = np.cumsum(count)
            found.append(self.pool[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)])
            np.add.at(total, owners, np.diff(np.concatenate([[0], ends])[np.array([0, *behind])]))
        return np.concatenate([np.empty(0, np.int32), *found]), total

    def text(self, ids: list[int]) -> str:
        """The labels of ids, put together. Bytes that are no UTF-8 become U+FFFD; ids that the vocabulary doesn't have emit nothing."""
        try:
            return b"".join(map(self.emitted.__getitem__, ids)).decode("utf-8", "replace")
        except (IndexError, TypeError):
            n = len(self.emitted)
            return b"".join([self.emitted[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


def compiled(path: str | None = None) -> tuple[Automaton, list[tuple[str, int]], str | None]:
    """The automaton of a byte-level BPE vocabulary file of the ``tokenizers`` library, its special strings, and the path."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        held = json.load(f)
    byte = byte_letters()
    raw = lambda t: bytes(byte[c] for c in t)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
    special = [(t["content"], t["id"]) for t in held["added_tokens"]]
    names = {s for s, _ in special}
    tokens = {raw(t): i for t, i in held["model"]["vocab"].items() if t not in names}
    return Automaton(tokens, [(raw(a), raw(b)) for a, b in merges]), special, path


_kept: dict[str, Codec] = {}


def _codec(sent, key: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if key not in _kept:
        made, special, path = sent.value
        _kept[key] = Codec(made, special, path or vocabulary_path())
    return _kept[key]


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", path: str | None = None, vocabulary=None) -> DataFrame:
    """Columns ``keep`` of df (default: all) and the token ids of ``text`` (array<int>), in place of any column of its name.

    Null and empty texts have no tokens. Whole texts are encoded, however long;
    special strings inside them become their ids, as the library does by default.
    Rows are independent: repeated rows and null ids stay as they are, an empty
    table gives none. No shuffle but for tiny inputs. ``vocabulary``: what
    ``compiled(path)`` gives, if it is at hand. Its tables are broadcast; their
    size follows the vocabulary.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or compiled(path))
    key = str(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, key)
        for b in batches:
            for first, last in _runs(b.column(b.num_columns - 1)):
                part = b.slice(first, last - first)
                found, count = codec.ids_of(part.column(b.num_columns - 1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], names=[*keep, ids])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(released(run), schema)


def decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, text: str = "decoded", path: str | None = None, vocabulary=None) -> DataFrame:
    """Columns ``keep`` of df (default: all) and the text of the token ids, in place of any column of its name.

    Special ids emit their strings. A null or empty array gives an empty text;
    null ids and ids outside the vocabulary emit nothing; bytes that are no UTF-8
    become U+FFFD. Rows are independent, an empty table gives none.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or compiled(path))
    key = str(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, key)
        for b in batches:
            for first, last in _runs(b.column(b.num_columns - 1)):
                part = b.slice(first, last - first)
                held = part.column(b.num_columns - 1)
                flat, ends = held.flatten(), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(held), 0)))
                flat = flat.to_pylist() if flat.null_count or (len(flat) and pc.min(flat).as_py() < 0) else flat.to_numpy().tolist()
                texts = pa.array([codec.text(flat[a:z]) for a, z in zip([0, *ends.tolist()], ends.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*keep, text])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(released(run), schema)


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows of about 2^19 characters or ids."""
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = np.asarray(pc.fill_null(sizes, 0))
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > 1 << 19:
            yield start, k
            start, held = k, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: its text encoded, and the ids decoded. Other columns, of any name, aren't read."""
    vocabulary = compiled(path)
    encoded = encode(documents, "text", ["doc_id"], "ids", path, vocabulary)
    both = decode(encoded, "ids", ["doc_id", "ids"], "decoded", path, vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
