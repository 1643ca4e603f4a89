import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foldspark.llm import packing, tokens

from .data import documents, frame


def fewest(items, capacity):
    """By trying all."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    r = random.Random(5)
    for _ in range(400):
        capacity = r.choice([10, 20, 50])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        fixed, rest = packing.reduce_dominated(Counter(items), capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)


def test_packing_is_whole_and_near_the_bound():
    r = random.Random(6)
    counts = Counter(min(1024, max(1, int(r.lognormvariate(5.5, 1)))) for _ in range(50_000))
    packed = packing.pack(counts)
    got = Counter()
    for pattern, times in packed:
        assert sum(pattern) <= 1024 and times > 0
        for x in pattern:
            got[x] += times
    assert got == counts
    assert sum(t for _, t in packed) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 1024)


def test_best_fit_runs_equal_one_by_one():
    r = random.Random(7)
    for _ in range(200):
        capacity = r.choice([12, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 30))]
        rooms = []
        for x in sorted(items, reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= x]
            if fit:
                k = min(fit, key=lambda k: rooms[k])
                rooms[k] -= x
            else:
                rooms.append(capacity - x)
        assert sum(t for _, t in packing.best_fit(Counter(items), capacity)) == len(rooms)


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.pack({2000: 1})


def test_round_trip(spark):
    enc = tokens.Encoder()
    docs = frame(spark).selectExpr("*", "1 AS length", "2 AS sequence_id", "3 AS `offset`")
    got = packing.pack_documents(docs).collect()
    ids = {}
    for d, t, *_ in documents():
        ids.setdefault(d, []).append(np.asarray([*enc.slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    want = Counter()
    for d, lists in ids.items():
        for x in lists:
            at, end, k = 0, len(x) if len(x) <= 1024 else len(x) % 1024 or 1024, 0
            while at < len(x):
                want[d, k, at, end - at, zlib.crc32(x[at:end].tobytes())] += 1
                at, end, k = end, min(len(x), end + 1024), k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1 + -(-sum(r.length for r in got) // 1024)


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
