"""Operator 9, near-duplicates: bottom-k sketches from one hash function, inverted lists, union-sketch estimation, exact Jaccard.

1. Each whole text becomes the set of its hashed five-word shingles and the k smallest of them (its sketch). Texts with equal sets
   form a class, which has a number of its own (``node``): identifiers may repeat, so they name rows only in the result.
2. Of two sets with Jaccard of at least 0.75, each value among the smallest of their union lies in both with a chance of 0.75, so two
   sketches of k = 192 share ``least`` = 105 values or more but for a chance below 1e-9, and share one of their first 15 but for a chance
   below 1e-9 too. Values that many rows hold come last in the order, so that a common passage makes no list; the number of values
   to invert follows from the share of such values in a sketch (15 with none, 88 at most: two sketches that share 105 of 192 values
   share one of the first 88 in any order). Small sets are held whole, and the bound is exact for them.
3. The values so chosen are inverted, split by size class: linked sets differ in size by a third at most. First each class is paired with
   the first class of its longest list, filtered by the union-sketch estimate and confirmed on the full sets; components follow.
4. Lists whose members ended up in several components get all their other pairs across components compared; pairs inside one component
   cannot change the result. A pair that shares its longest list is left to that list. Long lists are dealt out as pairs of blocks,
   and a block pair is compared by matrix products, so no list is capped and no task holds one. Where both sets are held whole by their
   sketches the product is the exact intersection: such links are joined at once, and a block pair gives out the edges of a spanning
   forest only. Members with larger sets that may still be linked across the forest's trees are given out once each (a row, not their
   pairs); their full sets meet in the same block pair, where links are confirmed and joined in the same way. What a block pair gives out
   is in proportion to its members, never to their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, id_text, join_groups, keep, map_texts, read, small_batches
from .components import components
from .textnum import Texts, shingle_sets

K, LEAST = 192, 105
#: Chance of missing a link by the choice of inverted values.
MISS = 1e-9
#: Values that are put last in the order at most (the commonest ones), and rows a value needs for that.
COMMON_VALUES, COMMON_ROWS = 200_000, 50
#: Numbers of classes (16 bytes each) and classes with their keys (some 100 bytes each) that are broadcast at most.
BROADCAST_IDS, BROADCAST_KEYS = 1_000_000, 200_000
#: Members of an inverted list that are compared at once, and bytes of their full sets; pairs of one head that are joined at once.
BLOCK, BLOCK_BYTES, HEAD_PAIRS = 2048, 1 << 25, 512


def _sets(texts: list, size: int, k: int, full: bool) -> dict:
    sets = shingle_sets(Texts(texts, lower_ascii=True), size)
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    if full:
        return {"set_key": keys, "shingles": [s.tobytes() for s in sets]}
    return {
        "n_shingles": [len(s) for s in sets],
        "set_key": keys,
        "sketch": [s[:k].tobytes() for s in sets],
    }


def sketches(docs: DataFrame, size: int = 5, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and sketch (the k smallest hashes, little-endian) per row."""
    return map_texts(docs, lambda t: _sets(t, size, k, False), "n_shingles bigint, set_key binary, sketch binary")


def _prefix_length(n: int, kept: int, shared: int, k: int, least: int, percent: int) -> int:
    """How many of a sketch's values, in the common order, must be inverted. ``shared`` of the ``kept`` values are common ones."""
    if n < k:
        exact = n - -(-percent * n // 100) + 1
        bound = max(exact, n - least + 1) if n * 100 >= percent * k else exact
    else:
        bound = kept - least + 1
    # of the values that are not common, at least this share of the union is in both sets
    common = min(1.0, shared / kept + 0.05)
    both = (percent / 100 - common) / (1 - common) if common < percent / 100 else 0.0
    return min(bound, int(np.ceil(np.log(MISS) / np.log(1 - both)))) if both > 0 else bound


def _common_values(reps: DataFrame) -> np.ndarray:
    """Rows (n, value) of the values that most rows hold, at most ``COMMON_VALUES``. Any order of the values keeps the result right."""

    def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for b in batches:
            parts.append(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))
            held += len(parts[-1])
            if held > 2_000_000:  # a common value comes again in the next lot; the order of the others is free
                v, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(v[c > 1]), pa.array(c[c > 1])], ["value", "n"])
                parts, held = [], 0
        v, c = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(v[c > 1]), pa.array(c[c > 1])], ["value", "n"])

    found = reps.select("sketch").mapInArrow(count, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_ROWS).orderBy(F.desc("n"), "value").limit(COMMON_VALUES)
    got = found.toArrow()  # two columns of numbers; rows would take many times their memory
    n, value = (got.column(c).to_numpy().astype(np.int64) for c in ("n", "value"))
    order = np.lexsort((value, n))
    return np.stack((n[order], value[order]), 1)


def _prefixes(reps: DataFrame, common: np.ndarray, k: int, least: int, percent: int) -> DataFrame:
    """(node, n, prefix): the values of each sketch to invert, those that many rows hold coming last in the order."""
    order = np.argsort(common[:, 1])
    table = reps.sparkSession.sparkContext.broadcast((common[order, 1], common[order, 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = table.value
        for b in batches:
            ids, ns, blobs = b.column(0), b.column(1).to_numpy(False), b.column(2).to_pylist()
            out = []
            for n, blob in zip(ns, blobs):
                s = np.frombuffer(blob, np.int64)
                shared = 0
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, counts[at], 0)
                    shared = np.count_nonzero(rank)
                    if shared:
                        s = s[np.argsort(rank, kind="stable")]
                out.append(s[: _prefix_length(int(n), len(s), shared, k, least, percent)])
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(out, pa.list_(pa.int64()))], ["node", "n", "prefix"])

    return reps.select("node", "n_shingles", "sketch").mapInArrow(run, "node bigint, n bigint, prefix array<bigint>")


def _least_shared(na: np.ndarray, nb: np.ndarray, k: int, least: int, percent: int) -> np.ndarray:
    """How many values the sketches of linked sets share, but for a chance of about 1e-9, where both are full.

    The larger set's sketch is k of its n values drawn at random (by hash), of which the common ones are known to be enough: a
    hypergeometric count, taken six and a half deviations and one below its mean.
    """
    j = percent / 100
    n = np.maximum(np.maximum(na, nb), 1).astype(np.float32)
    share = np.clip(j / (1 + j) * (na + nb) / n, 0, 1)
    deviation = np.sqrt(np.maximum(k * share * (1 - share) * (1 - k / np.maximum(n, k)), 0))
    return np.where((na >= k) & (nb >= k), np.maximum(least, k * share - 6.5 * deviation - 1), least)


def _estimate(a: np.ndarray, na: int, b: np.ndarray, nb: int, k: int, least: int, percent: int) -> bool:
    """Whether the k smallest values of the union leave a Jaccard of ``percent`` possible."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    if na <= k and nb <= k:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (na + nb - both)
    if len(np.intersect1d(a, b, assume_unique=True)) < _least_shared(na, nb, k, least, percent):
        return False
    union = np.sort(np.concatenate((a, b)))
    twice = union[1:] == union[:-1]
    # both sketches are complete up to the smaller of their largest values
    cut = min(a[-1] if na > k else union[-1], b[-1] if nb > k else union[-1])
    inside = int(np.count_nonzero(twice & (union[1:] <= cut)))
    return inside >= min(least, k)


def _only(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``reps`` whose node is in ``nodes``, where these are few: the others' sketches then need no shuffle. Else all of them."""
    return reps.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= BROADCAST_IDS else reps


def _both_sides(pairs: DataFrame, heads: DataFrame, others: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``heads`` (one row per a) and ``others`` (one per b). A head of many pairs gets a copy per ``HEAD_PAIRS`` of them."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD_PAIRS).cast("int").alias("_parts"))
    dealt = pairs.join(sizes, "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int")).drop("_parts")
    copies = heads.join(sizes, "a").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(others, "b").join(copies, ["a", "_part"]).drop("_part")


def _filter_pairs(pairs: DataFrame, reps: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb = t.column("na").to_numpy(False), t.column("nb").to_numpy(False)
            sa, sb = t.column("sa"), t.column("sb")
            good = [_estimate(np.frombuffer(sa[i].as_py(), np.uint64), na[i], np.frombuffer(sb[i].as_py(), np.uint64), nb[i], k, least, percent) for i in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    a, b = (_only(reps, keep(pairs.select(F.col(s).alias("node")).distinct(), "nodes")) for s in "ab")
    sides = [r.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s, r in (("a", a), ("b", b))]
    return _both_sides(pairs, *sides).where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) with the whole set of each class in ``nodes``, kept. Texts are found by the class's smallest id and told apart by
    their sets' keys, so that an identifier that repeats with other texts does no harm."""
    wanted = keep(classes.join(nodes.select("node").distinct(), "node").select("node", "doc_id", "set_key"), "wanted")
    hint = F.broadcast if wanted.count() <= BROADCAST_KEYS else (lambda d: d)  # so many rows spare the texts and sets a shuffle
    texts = docs.join(hint(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = map_texts(texts, lambda t: _sets(t, size, 0, True), "set_key binary, shingles binary").drop("doc_id")
    full = keep(sets.join(hint(wanted.select("node", "set_key")), "set_key").select("node", "shingles"), "sets")
    discard(wanted)
    return full


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity, kept."""
    pairs = keep(pairs, "candidates")
    full = _full_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, classes, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for t in batches:
            good, left, sa, sb = [], t.column("a").to_pylist(), t.column("sa"), t.column("sb")
            for i in range(t.num_rows):
                if left[i] != last:
                    last, a = left[i], np.frombuffer(sa[i].as_py(), np.uint64)
                b = np.frombuffer(sb[i].as_py(), np.uint64)
                both = _both(a, b)
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # rows that repeat an id and a text give their class's set more than once
    side = lambda s: full.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}")).dropDuplicates([s])
    links = keep(_both_sides(pairs, side("a"), side("b")).select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")
    discard(pairs, full)
    return links


def _both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """How many values each sketch of x shares with each of y: matrix products over the values that both sides have, a slab at a time."""
    flat = [np.concatenate(a) for a in (x, y)]
    owner = [np.repeat(np.arange(len(a)), [len(s) for s in a]) for a in (x, y)]
    values = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    total = np.zeros((len(x), len(y)), np.float32)
    places = []
    for f, o in zip(flat, owner):
        at = np.searchsorted(values, f)
        hit = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == f) if len(values) else np.zeros(len(f), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], o[hit][order]))
    for lo in range(0, len(values), columns):
        sides = []
        for (at, o), n in zip(places, (len(x), len(y))):
            a, b = np.searchsorted(at, (lo, lo + columns))
            m = np.zeros((n, min(columns, len(values) - lo)), np.float32)
            m[o[a:b], at[a:b] - lo] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total


def _forest(fits: np.ndarray, rows: np.ndarray, cols: np.ndarray, tree: np.ndarray, check=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest over ``fits`` (rows x cols; both number members), in addition to what ``tree`` joins already.

    ``tree`` has a label a member and is brought up to date: members joined by edges get one label. ``check(i, j)`` confirms an edge, and is
    asked once at most for a pair, and never for a pair that is joined already. Rows and columns are disjoint, or the same and ``fits`` symmetric.
    """
    at_row, at_col = np.full(len(tree), -1), np.full(len(tree), -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    edges: list[tuple[int, int]] = []
    mates: dict[int, list[int]] = {}
    for i, label in enumerate(tree.tolist()):
        mates.setdefault(label, []).append(i)
    waiting = np.ones(len(tree), bool)
    for start in range(len(tree)):
        if not waiting[start]:
            continue
        label = int(tree[start])
        todo = list(mates[label])
        waiting[todo] = False
        while todo:
            i = todo.pop()
            near = cols[fits[at_row[i]]] if at_row[i] >= 0 else rows[fits[:, at_col[i]]]
            for j in near[waiting[near]].tolist():
                if waiting[j] and (check is None or check(i, j)):
                    edges.append((i, j))
                    more = mates[int(tree[j])]
                    waiting[more] = False
                    todo += more
                    tree[more] = label
    return edges


def _fitting(t: pa.Table, mine: int, x: np.ndarray, y: np.ndarray, sketch: list[np.ndarray], k: int, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For members x and y of a list: (pairs that are links for sure, pairs that may be). Each pair fits in one list only."""
    ns, comp, home, own, native = (t.column(c).to_numpy() for c in ("n_shingles", "comp", "home", "own", "native"))
    before = [(v := np.array(p, np.int64))[v < mine] for p in t.column("prefix").to_pylist()]
    fits, whole = np.zeros((len(x), len(y)), bool), np.zeros((len(x), len(y)), bool)
    ny = ns[y][None, :]
    for lo in range(0, len(x), 128):  # strips of rows bound the memory
        r = x[lo : lo + 128]
        part = _shared_counts([sketch[v] for v in r], [sketch[v] for v in y])
        nx = ns[r][:, None]
        alike = home[r][:, None] == home[y][None, :]
        good = (comp[r][:, None] != comp[y][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        good &= np.where(alike, (home[r] == own[r])[:, None], native[r][:, None] | native[y][None, :])
        small = (nx <= k) & (ny <= k)
        good &= np.where(small, 100 * part >= percent * (nx + ny - part) - 0.01, part >= _least_shared(nx, ny, k, least, percent))
        if good.any():
            p, q = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            earlier = _shared_counts([before[v] for v in r[p]], [before[v] for v in y[q]]) > 0
            good[np.ix_(p, q)] &= ~earlier | alike[np.ix_(p, q)]
        fits[lo : lo + 128], whole[lo : lo + 128] = good, small
    return fits & whole, fits & ~whole


_MEMBER = ["node", "block", "native", "home", "own", "comp"]


def _block_links(members: DataFrame, reps: DataFrame, prefixes: DataFrame, docs: DataFrame, classes: DataFrame, size: int, k: int, least: int, percent: int) -> list[DataFrame]:
    """Links (a, b) across components within lists, compared block by block, enough of them to join all that is linked.

    ``members``: value, cell, native, node, comp. A pair is compared in the lists of the larger set's own size class, or only in the longest
    list if both have the same one as their longest. Of the lists it shares, the one of the smallest value takes it.
    """
    lists = ["value", "cell"]
    sized = members.join(members.groupBy(*lists).agg(F.count("*").alias("m")), lists)
    longest = sized.groupBy("node").agg(F.max(F.struct("m", *lists)).alias("h"))
    placed = sized.join(longest.select("node", F.xxhash64("h.value", "h.cell").alias("home")), "node").withColumn("own", F.xxhash64(*lists))
    # a list all of whose members have another list as their longest has nothing left to compare
    left = placed.groupBy(*lists).agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.first("own").alias("own")).where("h0 <> h1 or h0 = own").select(*lists)
    placed = keep(placed.join(left, lists, "left_semi"), "members")
    # a long list is dealt out by hash before it is numbered; a block's full sets are BLOCK_BYTES at most
    per = F.greatest(F.lit(4), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / 8 / F.pow(F.lit(100 / percent), F.col("cell") + 1)))).cast("int")
    deals = F.greatest(F.lit(1), F.ceil(F.col("m") / (2 * per)))
    dealt = placed.withColumn("per", per).withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int"))
    rn = F.row_number().over(Window.partitionBy(*lists, "deal").orderBy("native", "home", "comp", "node"))
    blocks = dealt.withColumn("block", (F.col("deal") * 1024 + F.floor((rn - 1) / F.col("per"))).cast("int")).select(*lists, *_MEMBER)
    spans = blocks.groupBy(*lists, "block").agg(*(f(c).alias(f"{c}{i}") for c in ("home", "comp") for i, f in enumerate((F.min, F.max))), F.max("native").alias("native"), F.first("own").alias("own"))
    first = spans.select(*lists, F.col("block").alias("i"), F.col("native").alias("native_"), *(F.col(f"{c}{i}").alias(f"{c}{i}_") for c in ("home", "comp") for i in (0, 1)))
    both = first.join(spans, lists).where("""i <= block and (native or native_ or own between home0 and home1 or own between home0_ and home1_) and not (comp0 = comp1 and comp0_ = comp1_ and comp0 = comp0_)
        and not (home0 = home1 and home0_ = home1_ and home0 = home0_ and home0 <> own)""")
    work = both.select(*lists, "i", F.col("block").alias("j"))
    need = work.select(*lists, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    held = _only(reps.join(prefixes.select("node", "prefix"), "node"), keep(placed.select("node").distinct(), "nodes"))
    rows = need.join(blocks, [*lists, "block"]).join(held, "node")
    keys = [*lists, "i", "j"]
    shape = "value bigint, cell int, i int, j int, a bigint, b bigint, block int, native boolean, home bigint, own bigint, comp bigint"
    names = [c.split()[0] for c in shape.split(", ")]

    def result(key: tuple, t: pa.Table, edges: list[tuple[int, int]], tree: np.ndarray, open_rows: np.ndarray) -> pa.Table:
        """Links (a, b), and members (a alone, with what is known of them) that may be linked further; ``comp`` is one for each tree."""
        comp = t.column("comp").to_numpy()
        label = np.zeros(len(tree), np.int64)
        label[tree] = comp
        a = np.concatenate((np.array([e[0] for e in edges], np.int64), open_rows))
        other = pa.array([e[1] for e in edges] + [None] * len(open_rows), pa.int64())
        part = t.take(pa.array(a))
        b = t.column("node").combine_chunks().take(other)
        return pa.table([*(pa.array([v.as_py()] * len(a), pa.int64() if n == 0 else pa.int32()) for n, v in enumerate(key)), part.column("node"), b, *(part.column(c) for c in _MEMBER[1:-1]), pa.array(label[tree[a]])], names)

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        block, comp = t.column("block").to_numpy(), t.column("comp").to_numpy()
        x, y = np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py())
        sketch = [np.frombuffer(v, np.uint64) for v in t.column("sketch").to_pylist()]
        sure, may = _fitting(t, key[0].as_py(), x, y, sketch, k, least, percent)
        tree = np.unique(comp, return_inverse=True)[1]
        edges = _forest(sure, x, y, tree)
        may &= tree[x][:, None] != tree[y][None, :]
        return result(key, t, edges, tree, np.union1d(x[may.any(1)], y[may.any(0)]))

    found = keep(rows.groupBy(*keys).applyInArrow(compare, shape), "compared")
    links = keep(found.where("b is not null").select("a", "b").distinct(), "links")
    open_rows = found.where("b is null").drop("b").withColumnRenamed("a", "node")
    full = _full_sets(open_rows, docs, classes, size)
    again = open_rows.join(prefixes.select("node", F.col("n").alias("n_shingles"), "prefix"), "node").join(full.dropDuplicates(["node"]), "node")

    def confirm(key: tuple, t: pa.Table) -> pa.Table:
        block, comp = t.column("block").to_numpy(), t.column("comp").to_numpy()
        x, y = np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py())
        sets = [np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()]
        _, may = _fitting(t, key[0].as_py(), x, y, [s[:k] for s in sets], k, least, percent)

        def linked(i: int, j: int) -> bool:
            n = _both(sets[i], sets[j])
            return 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)

        tree = np.unique(comp, return_inverse=True)[1]
        return result(key, t, _forest(may, x, y, tree, linked), tree, x[:0])

    more = keep(again.groupBy(*keys).applyInArrow(confirm, shape).select("a", "b").distinct(), "links")
    discard(placed, found, full)
    return [links, more]


def link_classes(docs: DataFrame, size: int = 5, percent: int = 75, k: int = K, least: int = LEAST) -> tuple[DataFrame, DataFrame, int]:
    """(rows with doc_id, n_shingles and set_key, (set_key, component, component_id, n_members) per class, number of rows)."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    rows = keep(sketches(docs, size, k), "sketches")
    total = rows.count()
    first = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("s")
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(first, F.count("*").alias("n_members")).select("set_key", "n_members", "s.doc_id", "s.n_shingles", "s.sketch")
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    reps = classes.select("node", "n_shingles", "sketch")
    prefixes = keep(_prefixes(reps, _common_values(reps), k, least, percent), "prefixes")
    post = prefixes.select(F.explode("prefix").alias("value"), "node", "n")

    # sets whose sizes differ by a third at most lie in the same class of sizes or in neighbouring ones
    cell = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    home = post.withColumn("cell", cell)
    heads = home.groupBy("value", "cell").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    star = home.join(heads, ["value", "cell"]).groupBy("node").agg(F.max(F.struct("m", F.col("a"))).alias("h")).select(F.col("h.a").alias("a"), F.col("node").alias("b")).where("a <> b")
    candidates = keep(_filter_pairs(keep(star, "star"), reps, k, least, percent), "filtered")
    links = _confirm(candidates, docs, classes, size, percent)
    found = components(links)

    labelled = post.join(found, "node", "left").select("value", "node", F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("native")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("native")))).alias("c"), F.coalesce("component", "node").alias("comp")).select("value", "node", "comp", "c.cell", "c.native")
    mixed = labelled.groupBy("value", "cell").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("value", "cell")
    members = keep(labelled.join(mixed, ["value", "cell"], "left_semi"), "members")
    more = _block_links(members, reps, prefixes, docs, classes, size, k, least, percent)
    final = components(links.unionByName(more[0]).unionByName(more[1]))
    named = classes.select("set_key", "node", "doc_id", "n_members").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # most components are one class and need no partner
    linked = named.where("component <> node").select("component").distinct()
    groups = named.join(linked, "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = named.join(groups, "component", "left").select("set_key", "component", F.coalesce("component_id", "doc_id").alias("component_id"), "n_members")
    placed = keep(placed, "placed")
    discard(classes, prefixes, members, links, *more)
    return rows, placed, total


def _labelled(docs: DataFrame, size: int, percent: int, k: int, least: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, component, component_id) of each row with an id; component is null for rows without words."""
    rows, classes, total = link_classes(docs, size, percent, k, least)
    labelled = join_groups(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), classes, "set_key", "n_members", total).drop("n_members")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "set_key", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return labelled.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, k: int = K, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (whether that is its own id).

    Null texts and texts without words have no shingles and stand alone. Rows that repeat an id are documents of their own: each gets the
    component of its own text. Rows with a null id are returned with a null component and kept. An empty table gives an empty result;
    columns besides id and text are ignored.
    """
    docs = id_text(docs, id_col, text_col)
    named = _labelled(docs, size, percent, k, least).select("doc_id", "n_shingles", "component_id")
    unnamed = sketches(docs.where("doc_id is null"), size, k).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 75, k: int = K, least: int = LEAST) -> DataFrame:
    """One document of each group of linked ones, the smallest id; all columns stay, rows with a null id or without words too.

    Of a group's rows that share the smallest id, one stays: the one whose set's key is the smallest, any of those that are equal in it.
    """
    rows = keep(_labelled(id_text(docs), size, percent, k, least), "labelled")
    gone = keep(rows.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = keep(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs.join(few(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(few(keep(gone.unionByName(again).distinct(), "gone"), BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    # a repeated id names several rows, which are told apart by their texts' sets
    first = rows.where("doc_id = component_id and component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "set_key")).alias("s")).select("s.doc_id", "s.set_key").join(again, "doc_id", "left_semi")
    several = map_texts(docs.join(again, "doc_id", "left_semi").select(*docs.columns), lambda t: dict(zip(("_n", "_set_of"), list(_sets(t, size, 0, False).values())[:2])), "_n bigint, _set_of binary", keep_text=True)
    first = first.select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_set"))
    chosen = several.where("_n > 0").join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_set_of") == F.col("_set"))).dropDuplicates(["_id", "_set"])
    return single.unionByName(chosen.select(*docs.columns)).unionByName(several.where("_n = 0").select(*docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
