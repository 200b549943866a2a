"""Ranked search against scoring every document, and what the bounds spare."""

import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    """item_id, rank, doc_id, score by scoring every document."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, k in bags:
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * (100 - 90 + 90 * k * n // total))) for t in set(terms(text)) if t in b)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=repr)


def made(seed, n, most=80):
    rng = np.random.default_rng(seed)
    return [" ".join(f"{'tT'[rng.integers(2)]}{int(x) % 200}" for x in rng.zipf(1.4, rng.integers(0, most))) for _ in range(n)]


@pytest.mark.parametrize("block,shard,size", [(128, 1 << 16, 16_000_000), (4, 50, 400), (1, 7, 100_000)])
def test_against_brute_force(spark, monkeypatch, block, shard, size):
    """Long and short blocks, one shard a task or many, items at once or in blocks: the same rows; repeated texts tie."""
    monkeypatch.setattr(search, "SHARD_DOCS", max(shard, 60))
    monkeypatch.setattr(search, "SLICE_CHARS", 40 * shard)
    monkeypatch.setattr(search, "ITEM_BYTES", size)
    texts = made(1, 500)
    texts += texts[:40] * 5
    docs = [(7 * i % 1009 * 10**9, t) for i, t in enumerate(texts)]
    items = [(i, t) for i, t in enumerate(made(2, 25, 12) + texts[:5])]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, rank int, score long").repartition(3)
    got = [tuple(r) for r in search.rank_documents(d, spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id long"), block=block).collect()]
    assert sorted(got, key=repr) == brute(docs, items)


def test_edge(spark):
    docs = [(1, None), (2, ""), (3, "... \t"), (4, "Alpha beta_gamma"), (5, "alpha ALPHA"), (5, "alpha ALPHA"), (None, "alpha alpha"), (-3, "alpha\x00alpha"), (8, "É é beta \x7f日本 " * 3000), (9, "x" * 100_000 + " gamma"), (10, "word " * 40_000)]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "!?"), (5, "GAMMA é gamma"), (5, "beta"), (None, "日本"), (6, "absent"), (7, "word alpha alpha"), (8, "x" * 100_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in search.rank_documents(d, q).collect()), key=repr) == brute(docs, items)
    assert search.rank_documents(d.limit(0), q).count() == 0 and search.rank_documents(d, q.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")  # a term of all documents has a small weight, but one
    assert search.rank_documents(same, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == len(brute([(1, "a b"), (2, "a c")], [(1, "a")]))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 65535), st.integers(1, 70_000), min_size=1, max_size=400))
def test_blocks_round_trip(of):
    d = np.array(sorted(of), np.int64)
    tf = np.array([of[x] for x in d.tolist()], np.int64)
    ends, data = search.encode_blocks(d, tf)
    got = [search.decode_block(data[a:b], min(search.BLOCK, len(d) - k * search.BLOCK)) for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends))]
    assert np.array_equal(np.concatenate([x for x, _ in got]), d) and np.array_equal(np.concatenate([x for _, x in got]), tf)


def lists_of(matrix, m):
    """Coded lists of the columns of a document x term matrix of frequencies."""
    out = {}
    for t in range(matrix.shape[1]):
        d = np.flatnonzero(matrix[:, t])
        if len(d):
            s = search.impacts(matrix[d, t], m[d])
            lo = np.arange(0, len(d), search.BLOCK)
            ends, payload = search.encode_blocks(d, matrix[d, t])
            out[t] = search.List({"peaks": np.maximum.reduceat(s, lo).tobytes(), "lasts": d[np.minimum(lo + search.BLOCK, len(d)) - 1].tobytes(), "offsets": np.append(ends, [len(d), search.BLOCK]).tobytes(), "payload": payload}, m)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_bounds_lose_nothing(seed):
    """Any threshold that ten documents reach keeps all ties of the ten best, and blocks of frequent terms are left undecoded."""
    rng = np.random.default_rng(seed)
    n, k = 6000, 12
    share = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.02, 0.01, 0.01, 0.005, 0.005])
    matrix = (rng.random((n, k)) < share) * rng.integers(1, 4, (n, k))
    matrix[100:112, 7:] = 9  # a passage that some documents share
    m = rng.integers(10, 400, n)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int((matrix[:, t] > 0).sum()) + 1))) for t in range(k)]
    every = np.where(matrix > 0, search.impacts(matrix, m[:, None]), 0)
    score = (every * weight).sum(1)
    tenth = np.sort(score)[-10]
    tops = np.sort(every, 0)[-10]
    for least in (0, max(w * int(x) for w, x in zip(weight, tops)), int(tenth)):
        lists = lists_of(matrix, m)
        d, s = search.answer(lists, list(enumerate(weight)), every.max(0), least, n)
        got = dict(zip(d.tolist(), s.tolist()))
        assert {i for i in np.flatnonzero(score >= tenth).tolist()} <= set(got) and all(score[i] == v for i, v in got.items())
    assert sum(len(x.blocks) for x in lists.values()) < 0.5 * sum(len(x.lasts) for x in lists.values())
