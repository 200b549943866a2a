"""Collocations against brute force, and what a merged summary guarantees."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, max_words=3, top=2000, inside=50):
    """lang, rank, phrase, a, l, r, n, score by plain counting with exact integers."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        ranked = []
        for p, a in cand.items():
            if p in longer and 100 * longer[p] >= inside * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, t.decode(), -a, l, r, n[lang], -s) for i, (s, a, t, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def made(seed, n, words=30):
    rng = np.random.default_rng(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]
    return [(["en", "de", None, "und"][rng.integers(4)], "".join(f"{'Ww'[rng.integers(2)]}{int(rng.zipf(1.6)) % words}{ends[rng.integers(len(ends))]}" for _ in range(rng.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("mass,bits,rows", [(4_000_000, 1 << 29, 400_000), (400, 1 << 12, 0), (50, 64 * 40, 0)])
def test_against_brute_force(spark, monkeypatch, mass, bits, rows):
    """One partition or many, a table with room or nearly full, counts broadcast or shuffled: the same rows."""
    monkeypatch.setattr(phrases, "PART_MASS", mass)
    monkeypatch.setattr(phrases, "TABLE_BITS", bits)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows)
    data = made(1, 400)
    df = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string, score int, rank int").repartition(5)
    got = sorted(map(tuple, phrases.collocations(df).collect()))
    assert got == brute(data) and len(got) > 100
    assert sorted(map(tuple, phrases.collocations(df, least=4, max_words=4, top=7).collect())) == brute(data, 4, 4, 7)


def test_edge(spark):
    rows = [(None, None), ("en", ""), ("en", " \t\n.;"), ("en", None), ("fr", "one"), ("en", "x" * 100_000), ("en", "a b " * 60_000), ("ja", "日本 語 " * 12), ("de", "Éa Straße éa strasse. " * 11), ("de", "A\xa0B C\x1cD,  c\x1cd  e " * 10)]
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute(rows)
    assert phrases.collocations(df.limit(0)).count() == 0
    nine = spark.createDataFrame([("p q. " * 9, "en")], "text string, lang string")
    assert phrases.collocations(nine).count() == 0 and phrases.collocations(nine.union(spark.createDataFrame([("P\tQ", "en")], nine.schema))).first()["a"] == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 9), max_size=30), max_size=12), st.integers(1, 40))
def test_merged_summary(parts, capacity):
    true = collections.Counter()
    for p in parts:
        true.update(p)
    own = [(np.array(list(p), np.uint32), np.array(list(p.values()), np.int64)) for p in parts]
    items, counters, taken = phrases.merge_summaries(own, capacity)
    have = dict(zip(items.tolist(), counters.tolist()))
    assert len(have) <= capacity and taken * (capacity + 1) <= sum(true.values())
    for x, n in true.items():
        assert have.get(x, 0) <= n <= have.get(x, 0) + taken


def test_survivors_hold_every_frequent_key(spark):
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{min(int(x), 5000)}" for x in rng.zipf(1.3, 3000)) for _ in range(40)]
    docs = spark.createDataFrame([("en", 5, t) for t in text], "lang string, salt long, text string").repartition(4)
    kept = phrases.survivors(phrases.summaries(docs, 8, 2), 10).collect()
    have = {(r["part"], x) for r in kept for x in np.frombuffer(r["prints"], np.uint32).tolist()}
    t = phrases.Pieces(text)
    salt = np.full(len(text), 5, np.uint64)
    keys, n = np.unique(np.concatenate([t.ngrams(k, salt)[1] for k in (1, 2)]), return_counts=True)
    part, prints = phrases.place(keys[n >= 10], 8)
    assert set(zip(part.tolist(), prints.tolist())) <= have and len(have) < 3 * len(part) < len(keys)
