"""Corpus operators against brute force, held-out accuracy and edge cases."""

import collections
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, components, exact_dedup, html_text, langid, near_dedup, packing, pii, quality, quality_rules, toxicity
from gridloom.llm.textnum import Texts, shingle_sets

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

EDGE = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "Straße É ß"), (6, "STRASSE é"), (7, "a b c d e f g"), (8, "A B C D E F G"), (9, "a b c d e f g"), (None, "a b c d e f g"), (7, "another text of row seven here"),
    (10, "word " * 60_000), (11, "!!! ### \U0001f600 日本語 <|endoftext|>"), (12, "x" * 200_000), (13, "mail a.b@c.example.com ip 1.2.3.4 tel +1 (555) 555-0100 card 4012888888881881"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", "src", 1, 0.5, True, 3, "x") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, keep_id int, digest string")


@pytest.fixture(scope="module")
def edge_labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted(((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=repr)


def test_exact_dedup_edge(edge):
    got = exact_dedup.exact_dedup(edge).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(EDGE)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [False]
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0


def test_drop_copies(edge):
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in EDGE})


def test_doubled_rows(spark, edge):
    """Of rows that repeat both id and text one stays, in the result and in the table."""
    rows = [(1, "Same"), (1, "same"), (1, "same"), (2, "other"), (None, "x"), (None, "x"), (3, None), (3, ""), (0, "same")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    for largest, sames in ((True, 1), (False, 0)):
        got = exact_dedup.exact_dedup(df, largest=largest).collect()
        assert sorted(((r["doc_id"], r["keep_id"]) for r in got if r["kept"]), key=repr) == sorted([(sames, sames), (2, 2), (None, None), (3, 3)], key=repr)
        assert len(got) == len(rows)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([1, 2, None, 3], key=repr)
    assert exact_dedup.exact_dedup(df, runs=1).count() == exact_dedup.exact_dedup(df, runs=5, fan_in=2).count() == len(rows)


def test_smallest_id_option(edge):
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(edge.where("doc_id in (8, 9)"), largest=False).collect()}
    assert got == {8: 8, 9: 8}


# ---- near dedup


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_near(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@has_data
def test_near_dedup_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, sets = brute_near(sets_of(rows)), sets_of(rows)
    got = by_id(near_dedup.near_dedup(docs))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_dedup_families(spark):
    """Families of edited copies, in which many pairs lie near the border and components split."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(3):
        base = [f"w{family}_{k}" for k in range(220)]
        for member in range(60):
            words = list(base)
            for k in rng.choice(220, rng.integers(0, 14), replace=False):
                words[k] = f"e{rng.integers(1 << 30)}"
            rows.append((len(rows) * 3 + 5, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [(1000 + k, passage + " " + " ".join(f"o{k}_{j}" for j in range(30))) for k in range(80)]
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {i: r["component_id"] for i, r in got.items()} == brute_near(sets_of(rows))


def brute_rows(rows):
    """Component (smallest id reachable) of each row, every row being a document of its own."""
    sets = sets_of(list(enumerate(t for _, t in rows)))
    roots = brute_near(sets)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[roots[i]] = min(doc_id, least.get(roots[i], doc_id))
    return sorted((doc_id, least[roots[i]]) for i, (doc_id, _) in enumerate(rows))


def test_near_dedup_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (7, b), (7, a + " more"), (9, c), (9, c), (11, c + " x"), (9, c + " y"), (12, ""), (12, None), (13, b + " z"), (6, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(df).collect()) == brute_rows(rows)
    left = near_dedup.drop_near_copies(df)
    assert left.columns == df.columns and sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == [(5, a), (6, c), (7, b), (12, ""), (12, "")]
    left = near_dedup.drop_near_copies(df.where("doc_id in (9, 11)")).collect()
    assert len(left) == 1 and left[0]["doc_id"] == 9


def test_near_dedup_hot_group(spark):
    """A group of edited copies, of short and of long texts, in which few pairs are links: no stage gives out its pairs."""
    rng = np.random.default_rng(8)
    rows = []
    for n, members, edits in ((120, 700, 5), (400, 300, 12)):
        base = [f"h{n}_{k}" for k in range(n)]
        for _ in range(members):
            words = list(base)
            for k in rng.choice(n, rng.integers(0, edits), replace=False):
                words[k] = f"e{rng.integers(1 << 40)}"
            rows.append((len(rows) + 1, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == brute_rows(rows)


def test_spanning_forest():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 30):
        for same in (True, False):
            fits = rng.random((n, n)) < 2 / n
            if same:
                fits = np.triu(fits, 1) | np.triu(fits, 1).T
            rows, cols = np.arange(n), np.arange(n) if same else np.arange(n, 2 * n)
            tree = rng.integers(0, max(1, n), n if same else 2 * n)
            asked = []
            ok = {tuple(sorted((int(rows[p]), int(cols[q])))): bool(rng.random() < 0.7) for p, q in zip(*np.nonzero(fits))}
            links = [(int(tree[a]), int(tree[b])) for (a, b), v in ok.items() if v]
            want = {int(t): int(t) for t in tree}
            for _ in range(len(want)):
                for a, b in links:
                    want[a] = want[b] = min(want[a], want[b])
            old = tree.copy()
            edges = near_dedup._forest(fits, rows, cols, tree, lambda a, b: asked.append(tuple(sorted((a, b)))) or ok[tuple(sorted((a, b)))])
            assert len(edges) < max(1, len(want)) and len(asked) == len(set(asked))
            assert all((tree[a] == tree[b]) == (want[int(old[a])] == want[int(old[b])]) for a in range(len(tree)) for b in range(len(tree)))


def test_near_dedup_edge(edge):
    got = near_dedup.near_dedup(edge).collect()
    assert len(got) == len(EDGE)
    kept = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in got}
    assert kept[1] == (1, 0, True) and kept[2] == (2, 0, True) and kept[3] == (3, 0, True) and kept[4] == (4, 1, True)
    assert kept[9] == (7, 3, False) and kept[8] == (7, 3, False) and kept[None] == (None, 3, True) and kept[10][1] == 1
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] == 7) == [(2, 7), (3, 7)]
    assert near_dedup.near_dedup(edge.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(edge).columns == edge.columns


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}
    assert components.components(links.limit(0)).count() == 0


def test_shingle_sets_equal_words():
    texts = [t for _, t in EDGE]
    want = [len(s) for s in (sets_of([(0, t)])[0] for t in texts)]
    assert [len(s) for s in shingle_sets(Texts(texts, True))] == want


# ---- BPE and packing


def test_bpe_equals_the_library(edge):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    ref, own = Tokenizer.from_file(path), bpe.load(path)
    for text in [*(t or "" for _, t in EDGE), "aaaa" * 300, "don't I'LL\t\x0b\x85\x1c x²½ _ ", " " * 300]:
        ids = ref.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(np.array(ids)) == ref.decode(ids, skip_special_tokens=False)
    rows = [r for r in bpe.round_trip(edge, path).collect()]
    assert len(rows) == len(EDGE)
    ids = bpe.encode_texts(edge.where("doc_id = 11"), path)
    assert bpe.decode_ids(ids, path).first()["text"] == dict(EDGE)[11]
    assert bpe.round_trip(edge.limit(0), path).count() == 0


def check_packing(rows, capacity=1024):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_edge(edge):
    import zlib

    path = bpe.tokenizer_path()
    rows = packing.pack_documents(edge, path).collect()
    check_packing(rows)
    coded = collections.defaultdict(list)
    for r in rows:
        coded[r["doc_id"]].append(r)
    long = sorted(coded[10], key=lambda r: r["piece"])
    seq = np.array(bpe.load(path).encode(dict(EDGE)[10]) + [2], "<u4")
    assert sum(r["length"] for r in long) == len(seq) and all(r["length"] == 1024 for r in long[1:])
    assert all(zlib.crc32(seq[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in long)
    assert [(r["piece"], r["start"], r["length"]) for r in coded[1]] == [(0, 0, 1)]
    assert packing.pack_documents(edge.limit(0), path).count() == 0


@has_data
def test_packing_is_near_the_bound(docs):
    rows = packing.pack_documents(docs, bpe.tokenizer_path()).collect()
    used, total = check_packing(rows), sum(r["length"] for r in rows)
    assert used <= -(-total // 1024) * 1.02 + 1


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 301, 5000), minlength=301)
    left = demand.copy()
    for config, n in packing.plan(demand, 300):
        assert sum(config) <= 300
        for length in config:
            left[length] -= n
    assert not left.any()


def test_program_covers_the_demand():
    """The program, not best fit, places the pieces, at any scale of the demand, and needs no more sequences than best fit alone."""
    rng = np.random.default_rng(2)
    one = np.bincount(np.minimum(1 + rng.exponential(300, 20_000).astype(int), 1023), minlength=1025)
    for demand in (one, one * 100, np.bincount(rng.choice([300, 350, 600], 3000), minlength=1025)):
        for more in (0, 1023):
            covered = np.zeros(1025)
            for config, n in packing.configurations(demand, 1024, more=more).items():
                assert sum(config) <= 1024
                np.add.at(covered, list(config), n)
            assert (covered <= demand).all() and covered.sum() >= 0.95 * demand.sum()
        assert sum(n for _, n in packing.plan(demand, 1024)) <= sum(n for _, n in packing.best_fit(demand, 1024))


def fewest(lengths, capacity):
    """Sequences that are needed at least, by trying every way."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                other = list(rooms)
                other.remove(room)
                place(k + 1, [*other, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plan_against_brute_force():
    rng = np.random.default_rng(6)
    more = 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        got = packing.plan(np.bincount(lengths, minlength=21), 20)
        assert sorted(x for config, n in got for _ in range(n) for x in config) == sorted(lengths)
        used, need = sum(n for _, n in got), fewest(lengths, 20)
        assert need <= used <= need + 1
        more += used - need
    assert more <= 3


@has_data
def test_fast_encoder_equals_the_library(docs, edge):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    ref = Tokenizer.from_file(path)
    texts = [r["text"] or "" for r in docs.select("text").collect()] + [t or "" for _, t in EDGE]
    for text, want in zip(texts, ref.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_ids(path, text).tolist() == want.ids


# ---- classifiers


@has_data
def test_quality_held_out(docs, labels):
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for label in (0, 1):  # of either class: the larger one alone would pass a test of all
        own = [r for r in rows if r["quality"] == label]
        assert sum(r["predicted"] == label for r in own) / len(own) > 0.9


@has_data
def test_language_held_out(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifier_edge(edge, edge_labels, classify):
    rows = classify(edge, edge_labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["score"] == 0.5 for r in classify(edge, edge_labels.limit(0)).collect())
    assert classify(edge.limit(0), edge_labels).count() == 0


def test_held_out_split(edge, edge_labels):
    import zlib

    for r in quality.classify(edge, edge_labels).collect():
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)


def test_quality_score_ignores_neighbours(edge, edge_labels, spark):
    table, bias = quality.train(edge.select("doc_id", "text"), edge_labels)
    one = lambda df: {r["doc_id"]: r["_score"] for r in quality.score(df.select("doc_id", "text"), table, bias).collect()}
    few, all_ = one(edge.where("doc_id in (5, 8)")), one(edge)
    assert few == pytest.approx({k: all_[k] for k in few})


def test_language_edge(edge, spark):
    rows = langid.identify(edge).collect()
    assert len(rows) == len(EDGE)
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[5] == "en"
    assert all(r["lang_pred"] == "und" for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(edge.limit(0)).count() == 0


def test_samples_are_bounded_in_bytes(spark):
    from gridloom.llm import training

    rows = [(i, i % 2, bytes(100 if i else 5000)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, _label int, b binary")
    got = training.byte_cut(df, F.octet_length("b"), 2000).collect()
    assert {r["_label"] for r in got} == {0, 1} and len(got) == 40 and all(len(r["b"]) == 100 for r in got)


def test_embedding_is_the_mean_of_its_rows():
    """Pooled sums of a batch against counting every feature of each text alone; scores don't depend on the batch."""
    from gridloom.llm.pooled import pooled, sparse

    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, (1 << 10, 2)).astype(np.float32)
    texts = ["", "a", "one two two", "Ünï code \U0001f600", None, "x" * 500, "a b c d"]
    total, count = pooled(Texts(texts), table, 10, (2, 3), True)
    for i, t in enumerate(texts):
        s = sparse(Texts([t]), 10, (2, 3), True)
        idx, cnt = np.frombuffer(s["idx"][0], np.int32), np.frombuffer(s["cnt"][0], np.float32)
        n = len(t or "")
        assert cnt.sum() == count[i] == max(0, n - 1) + max(0, n - 2) + 2 * len(WORD.findall(t or ""))
        assert np.allclose(total[i], (table[idx] * cnt[:, None]).sum(0), atol=1e-3)


def test_decoding_against_brute_force():
    """The chosen codeword is the one of least weighted loss, bit by bit."""
    rng = np.random.default_rng(3)
    for n in (2, 4, 9):
        code = langid.codewords(n)
        margins, weight = rng.normal(0, 2, (20, code.shape[1])), rng.uniform(0.1, 3, code.shape[1])
        p = langid.decode(margins, code, weight)
        assert np.allclose(p.sum(1), 1)
        for row, m in zip(p, margins):
            loss = [sum(w * np.log1p(np.exp(-a * c)) for a, c, w in zip(m, word, weight)) for word in code]
            assert row.argmax() == int(np.argmin(loss))


def test_posterior_against_brute_force():
    """The label model's posterior is Bayes' rule over its own tables, voter by voter."""
    rng = np.random.default_rng(4)
    y = rng.random(500) < 0.4
    v = np.stack([np.where(rng.random(500) < a, np.where(y, 1, -1), rng.integers(-1, 2, 500)) for a in (0.9, 0.6, 0.5)], 1).astype(np.int8)
    post, p, weight = toxicity.label_model(v, rounds=200)
    share = float(np.clip(post.mean(), 0.02, 0.98))
    for row, q in zip(v[:50], post):
        odds = np.log(share / (1 - share)) + sum(w * np.log(p[1, k, o + 1] / p[0, k, o + 1]) for k, (o, w) in enumerate(zip(row.tolist(), weight)))
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(q, abs=1e-3)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c}) == n


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < a, np.where(y, 1, -1), np.where(rng.random(3000) < 0.5, 1, -1)) for a in (0.9, 0.8, 0.7, 0.0)], 1).astype(np.int8)
    post, p, _ = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.9
    assert p[1, 0, 2] > p[1, 3, 2]


# ---- quality rules


def brute_rules(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    flag = [False] * len(w)
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            flag[i] = flag[i + 1] = flag[i + 2] = True
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, sum(flag), len(w) < 50 or 100 * sum(flag) > 50 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@has_data
def test_rules_base(docs):
    got, texts = by_id(quality_rules.rules(docs)), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(tuple(got[i][n] for n in NAMES) == brute_rules(t) for i, t in texts.items())


def test_rules_edge(edge):
    rows = quality_rules.rules(edge).collect()
    assert sorted(((r["doc_id"], *(r[n] for n in NAMES)) for r in rows), key=repr) == sorted(((i, *brute_rules(t)) for i, t in EDGE), key=repr)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.rules(edge.limit(0)).count() == 0


def brute_verdict(rows):
    """{doc_id: (js_char, js_word, kept)} of rows (doc_id, lang, text), word by word and character by character."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    classes = [r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[\x00-\x7f]", r"(?s:.)"]

    def chars(t):
        return collections.Counter(next(k for k, c in enumerate(classes) if re.match(c, x)) for x in t)

    def short(t):
        return collections.Counter(w for w in WORD.findall(t.translate(lower)) if len(w) <= quality_rules.SHORT)

    def number(w):  # ties in a count go by the word's hash
        return int(quality_rules._short_words(Texts([w], lower_ascii=True))[1][0])

    def distance(p, q):
        p, q = ({k: n / sum(d.values()) for k, n in d.items()} for d in (p, q))
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p | q}
        return sum(sum(n * np.log2(n / m[k]) for k, n in d.items() if n) for d in (p, q)) ** 0.5 / 2**0.5

    langs = {}
    for lang in {lang for _, lang, t in rows if lang is not None and t}:
        own = [t for _, x, t in rows if x == lang and t]
        count = sum(map(short, own), collections.Counter())
        top = sorted(count, key=lambda w: (-count[w], number(w)))[: quality_rules.COMMON]
        total = sum(len(WORD.findall(t)) for t in own)
        langs[lang] = sum(map(chars, own), collections.Counter()), {w: count[w] for w in top} | {None: total - sum(count[w] for w in top)}
    out = {}
    for i, _, t in rows:
        n, own = len(WORD.findall(t or "")), []
        for ref_chars, ref_words in langs.values():
            seen = {w: c for w, c in short(t or "").items() if w in ref_words}
            if t and n:
                own.append((distance(chars(t), ref_chars), distance(seen | {None: n - sum(seen.values())}, ref_words)))
        c, w = min(own, key=sum, default=(None, None))
        c, w = c if n >= quality_rules.MIN_CHAR_WORDS else None, w if n >= quality_rules.MIN_WORD_WORDS else None
        far = c is not None and c > quality_rules.MAX_CHAR or w is not None and w > quality_rules.MAX_WORD
        out[i] = c, w, not brute_rules(t)[-1] and not far
    return out


@has_data
def test_rules_verdict_against_brute_force(spark, docs):
    some = docs.where("doc_id % 4 = 1").select("doc_id", "lang", "text")
    odd = [(-1, "en", "the # * $ of " * 40), (-2, None, "zq1 xv2 " * 90), (-3, "xx", None), (-4, "en", " ".join(f"w{k}é" for k in range(120)))]
    table = some.unionByName(spark.createDataFrame(odd, "doc_id long, lang string, text string"))
    want = brute_verdict([tuple(r) for r in table.collect()])
    got = by_id(quality_rules.rules(table))
    assert set(got) == set(want)
    for i, (c, w, kept) in want.items():
        assert got[i]["js_char"] == (c if c is None else pytest.approx(c, abs=1e-9)), i
        assert got[i]["js_word"] == (w if w is None else pytest.approx(w, abs=1e-9)), i
        assert got[i]["kept"] == kept, i
    assert 0 < sum(not k for _, _, k in want.values()) < len(want)


def test_js_distance():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality_rules.js_distance(p, np.array([0.0, 1.0]))[0] == pytest.approx(1)
    assert quality_rules.js_distance(p, np.array([0.5, 0.5]))[1] == pytest.approx(0)


# ---- personal data


def brute_spans(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fits(k, s):
        d = re.sub("[^0-9]", "", s)
        if k == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if k == 2:
            return 14 <= len(d) <= 19 and pii.luhn(d)
        return k == 0 or 10 <= len(d) <= 15

    return sorted(((m.start(), m.end(), k) for k, p in enumerate(kinds) for m in re.finditer(p, t) if fits(k, m.group())), key=lambda s: (s[0], s[2]))


ODD = ["a@b a.b@c.d@e.f g@h.i", "x@@y.z", "..@a.b", "1.2.3.4.5.6.7.8", "1.2.3.256 01.002.3.4", "4012 8888-8888 1881 4012888888881881", "+1(555)555-0100+44 20 7946 0958", "a" * 5000 + "@", "1@2.3.4.5", "@a.b", "+-+1 2", "é@x.y"]


@pytest.mark.parametrize("text", ODD + [t or "" for _, t in EDGE])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_edge(edge):
    every = pii.detect(edge).collect()
    assert len(every) == len(EDGE)
    rows = {r["doc_id"]: r for r in every}
    assert rows[1]["spans"] == "" and rows[13]["n_email"] == rows[13]["n_ip"] == rows[13]["n_card"] == rows[13]["n_phone"] == 1
    assert pii.detect(edge.limit(0)).count() == 0
    clean = pii.redact(edge)
    assert clean.columns == edge.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[13] == "mail <EMAIL> ip <IP> tel <PHONE> card <CARD>" and text[1] is None


def segmentations(n, spans, at=0):
    """Every choice of spans (with types) that don't overlap, in order, from border ``at`` on."""
    yield []
    for k, (i, j) in enumerate(spans):
        if i >= at:
            for kind in range(4):
                for rest in segmentations(n, spans, j):
                    yield [(k, kind), *rest]


def test_field_against_brute_force():
    """Sums, chances and the best segmentation by trying every one."""
    rng = np.random.default_rng(12)
    for _ in range(25):
        n = int(rng.integers(3, 7))
        spans = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(4)})
        field, z = pii.SemiMarkov((np.zeros((4, len(pii.FEATURES))), rng.normal(0, 1, (5, 4)))), rng.normal(0, 2, (len(spans), 4))

        def score(way):
            state = total = 0
            for k, kind in way:
                total, state = total + z[k, kind] + field.t[state, kind], kind + 1
            return total

        ways = list(segmentations(n, spans))
        scores = np.array([score(w) for w in ways])
        chance, total = field.chances(n, spans, z)
        assert total == pytest.approx(np.logaddexp.reduce(scores))
        for k in range(len(spans)):
            for kind in range(4):
                want = sum(np.exp(s - total) for w, s in zip(ways, scores) if (k, kind) in w)
                assert chance[k, :, kind].sum() == pytest.approx(want)
        best = ways[int(scores.argmax())]
        assert field.best(n, spans, z, np.full(n - 1, -1)) == [(*spans[k], kind) for k, kind in best]


def test_fixed_spans_set_the_state():
    field = pii.SemiMarkov((np.zeros((4, len(pii.FEATURES))), np.zeros((5, 4))))
    field.t[:] = -5
    field.t[3, 3] = 5  # a phone follows a card
    assert field.best(4, [(2, 3)], np.zeros((1, 4)), np.array([2, -1, -1])) == [(2, 3, 3)]
    assert field.best(4, [(2, 3)], np.zeros((1, 4)), np.array([1, -1, -1])) == []
    assert pii.taken([0, 3, 5, 9], [(4, 6, 1)]).tolist() == [-1, 1, 1]


def test_many_spans_take_linear_time():
    import time

    field = pii.SemiMarkov((np.ones((4, len(pii.FEATURES))), np.zeros((5, 4))))
    for text in (" ".join(f"10.{k % 256}.3.4" for k in range(20_000)), "a@b " * 20_000, "x" * 100_000 + "(at)y", "1" * 200_000 + ". x", "b(at)" * 40_000, "a" * 200_000 + " (at) b.co"):
        t = time.time()
        base, _ = pii.find(text, field)
        assert time.time() - t < 20 and len(base) in (0, 20_000)


@has_data
def test_field_adds_what_the_patterns_miss(docs):
    field = pii.SemiMarkov(pii.train(docs.select("doc_id", "text")))
    text = "call +1 (605) 555-9305 4078918989542222 now"
    base, spans = pii.find(text, field)
    assert base == [] and spans == [(5, 22, 3), (23, 39, 2)]
    for clean in ("version 2024-01-15 and 1234567 items", "pages 100 200 300 of 12345678901234567890123"):
        assert pii.find(clean, field)[1] == []


# ---- pages


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href=x>no</a></ul></nav>
    <div class="ad">no</div><article><header><h1>Head &amp; tail</h1></header><p><b>One<br>two &lt;3&nbsp;x<p>Three  <i>four</i></p><aside>no</aside><div class="comments"><p>no</p></div></article><footer>no"""
    assert html_text.blocks(page)[0] == ["Head & tail", "One two <3 x", "Three four"]


def test_self_closed_and_broken_markup():
    import time

    for raw in ("<svg class='i'/>", "<svg><path d='a>b'/></svg>", "<iframe src=x />", "<math/>", "<canvas id='a'></canvas>"):
        assert html_text.blocks(f"<article><p>before</p>{raw}<p>after</p></article>")[0] == ["before", "after"], raw
    assert html_text.blocks("<article><p>a</p><script src='x'/>no</script><p title='1>0'>b</p></article>")[0] == ["a", "b"]
    for junk in ('<a "', "<a", "<!", "<script", "<a x='", "</", "<a<b ", "<svg "):
        t = time.time()
        html_text.page_blocks("<article>text</article>" + junk * 20_000)
        assert time.time() - t < 5, junk


def test_pages_edge(spark):
    """Very long pages, and extra columns whose names clash."""
    long = "<article>" + "".join(f"<p>paragraph {k} of it</p>" for k in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://x/1", long, "t", True, 2)], "page_id long, url string, html string, blocks string, open boolean, row int")
    got = html_text.extract(df).collect()
    assert got[0]["text"].count("\n") == 29_999 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_parts_are_whole_names():
    for wrapper in ("class='layout has-sidebar'", "class=with-header", "class='overflow-hidden'", "data-hidden=no", "class='widget'", "hidden", "style='display:none'"):
        assert html_text.blocks(f"<body><div {wrapper}><p>lead<article><p>text</article></div>") == (["text"], ["lead"]), wrapper
    assert html_text.blocks("<article><div class='entry-header'><h1>Title</h1></div><div class=header>by</div><p>text</article>")[0] == ["Title", "by", "text"]
    assert html_text.blocks("<form id=f><div class=ads>no</div><main>text</main></form><form>no</form>") == (["text"], [])
    for part in ("class='x sidebar'", "hidden", "style='color:red; display: none'", "aria-hidden=true", "role=navigation"):
        assert html_text.blocks(f"<div {part}>no</div><article>text <span {part}>no</span> more</article>") == (["text more"], []), part
    assert html_text.blocks("<main><article>text</article><div id=comments><article>no</article></div></main>")[0] == ["text"]


def test_extract_edge(spark):
    boiler = "<div>Subscribe to all of our great daily letters today</div>"
    rows = [(k, f"http://h.example/{k}", f"<body>{boiler}<p>story number {k} tells of k{k}</p></body>") for k in range(6)]
    rows += [(50, None, None), (51, "", ""), (52, "http://h.example/a", "<article>kept < text</article>"), (52, "odd", "<b>unclosed"), (None, "u", "<main>m</main>")]
    got = html_text.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert all("Subscribe" not in text[(k, f"http://h.example/{k}")] and f"k{k}" in text[(k, f"http://h.example/{k}")] for k in range(6))
    assert text[(50, None)] == "" and text[(52, "odd")] == "unclosed" and text[(None, "u")] == "m"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_doubtful_blocks_beside_an_article(spark):
    """Text outside an article stays where it is unique to its page, in page order, and goes where the host repeats it."""
    boiler = "<div>Subscribe to all of our great daily letters today</div>"
    rows = [(k, f"http://h.example/{k}", f"<div>Title of page p{k}</div>{boiler}<article><p>text t{k}</p></article><div>then q{k}</div>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title of page p{k}\ntext t{k}\nthen q{k}" for k in range(6)}


def test_runs_are_long_and_counted_over_the_host(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 8))) for _ in range(n))
    long, head, copied = word(30), word(2), word(40)
    rows = [(k, f"http://big.example/{k}", f"<div>it was said that {word(5)}</div>") for k in range(1300)]  # a phrase of four words
    rows += [(k, f"http://big.example/{k}", f"<p>{head}</p><p>{word(3)} {long} {word(3)}</p><p>{head} {word(2)}</p>") for k in range(1300, 1306)]  # few pages of a large host
    rows += [(k, f"http://big.example/{k}", f"<p>{copied}</p>") for k in range(1306, 1312)]  # copies of a page
    rows += [(k, f"http://h{k}.example/", f"<p>{copied}</p>") for k in range(1312, 1318)]  # the same on other hosts
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, page in rows:
        words = re.sub("<[^>]*>", " ", page)
        if 1300 <= k < 1306:
            words = words.replace(long, " ").replace(head, " ", 1)
        assert got[k].split() == words.split()


def test_runs_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pages = [[" ".join(map(str, rng.integers(0, 2, rng.integers(1, 7)))) for _ in range(rng.integers(0, 4))] for _ in range(rng.integers(0, 6))]
        want = []
        for p, page in enumerate(pages):
            at = 0
            for b in page:
                w = b.split(" ")
                want += [(p, at + i, min(3, len(w)), tuple(w[i : i + 3])) for i in range(max(1, len(w) - 2))]
                at += len(w)
        owner, at, n, digest = html_text.runs(pages, 3)
        names = {(p, a): t for p, a, _, t in want}
        assert sorted(zip(owner.tolist(), at.tolist(), n.tolist())) == sorted(x[:3] for x in want)
        pairs = {(d, names[p, a]) for p, a, d in zip(owner.tolist(), at.tolist(), digest)}
        assert len(pairs) == len({d for d, _ in pairs}) == len({t for _, t in pairs})


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        t = rng.integers(0, 3, n)
        assert html_text.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


# ---- pipeline


@has_data
def test_pipeline_stages(spark, docs, labels):
    import corpus_pipeline as p

    from gridloom.llm.common import keep

    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "personal_data", "packing"]
    a = keep(stages["quality_classifier"](spark, docs, SF), "t")
    scores = by_id(quality.classify(docs, labels))
    assert {r["doc_id"] for r in a.select("doc_id").collect()} == {i for i, r in scores.items() if r["predicted"] == 1}
    b = keep(stages["exact_dedup"](spark, a, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    assert {r["doc_id"] for r in b.collect()} == {keep_id for _, keep_id, _, _ in brute_exact(rows)}
    c = keep(stages["near_dedup"](spark, b, SF), "t")
    want = brute_near(sets_of([(r["doc_id"], r["text"]) for r in b.collect()]))
    assert {r["doc_id"] for r in c.collect()} == {i for i, k in want.items() if i == k}
    e = keep(stages["personal_data"](spark, c, SF), "t")
    assert e.columns == docs.columns and e.count() == c.count()
    assert all(pii.base_spans(r["text"] or "") == [] or "<" in r["text"] for r in e.collect())
    packed = stages["packing"](spark, e, SF).collect()
    check_packing(packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in e.collect()}


def test_pipeline_edge(spark, edge, tmp_path):
    import corpus_pipeline as p

    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
        assert stage(spark, docs, f"file://{tmp_path}").count() >= 1
