"""Operator 13, ranked lexical search by Block-Max MaxScore over document shards.

1. One scan of the documents writes the postings of the terms that the items ask for, by shard: a stretch of one task's documents, at most
   ``SHARD_DOCS`` of them, numbered within it. Counts of documents, terms and document frequencies are sums over all shards.
2. Each shard's lists are coded in blocks of ``BLOCK`` postings (gaps and frequencies in as few bytes as the block needs) with the last
   document and the largest impact of each block. Over all shards follow each term's global bound and its ten largest impacts, which give
   every item a threshold to begin with: ten documents have at least its best term's tenth impact.
3. A shard answers all items. Lists in order of their global bounds: as long as the bounds' sum stays below the threshold they are
   non-essential, and a document that only they hold can't be among the ten. Documents of the essential lists are scored; then each
   non-essential list, from the largest bound down, looks only at the blocks in which a candidate still can reach the threshold by the
   block's maximum, and drops the other candidates without decoding their blocks. Equal scores are never dropped.
4. The shards' heaps of ten are merged in two levels.

Documents are all ranked; nothing is sampled or cut off. Items are answered in blocks of at most ``ITEM_BYTES`` bytes of distinct terms, so
what is broadcast is bounded; every block scans the documents once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, keep, read, slices, small_batches
from .textnum import Texts

#: Results of an item; postings of a block; documents and postings of a shard at most; bytes of distinct terms of the items answered at once.
TOP, BLOCK, SHARD_DOCS, SHARD_POSTINGS, ITEM_BYTES = 10, 128, 1 << 16, 4_000_000, 16_000_000
SLICE_CHARS = 1 << 20
#: Stands for a null id among the ids of a shard.
NO_ID = -(1 << 63)

_TERM = np.zeros(128, bool)
_TERM[[c for c in range(128) if chr(c).isalnum()]] = True
_POSTINGS = "shard bigint, term int, df bigint, total bigint, docs binary, tfs binary"
_INDEX = "shard bigint, term int, tops array<int>, peaks binary, lasts binary, offsets binary, payload binary"


class Terms(Texts):
    """Texts with A-Z lower-cased, and the terms of each: letters and digits of ASCII and all that isn't ASCII."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts, lower_ascii=True)
        inside = (self.cp >= 128) | _TERM[np.minimum(self.cp, 127)]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_at = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_at)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """qid (a number of the row), item_id, terms: sorted distinct 64-bit hashes of each item's terms."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in slices([len(x or "") for x in texts], SLICE_CHARS):
                t = Terms(texts[lo:hi])
                w = t.words()
                blobs = [np.unique(w[t.word_at[i] : t.word_at[i + 1]]).tobytes() for i in range(t.n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["qid", "item_id", "terms"])

    return items.select(F.monotonically_increasing_id().alias("qid"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "qid bigint, item_id bigint, terms binary")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in one, two or four bytes each."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n] if n else np.uint8).astype(np.int64)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of a shard: for each of its terms (a place in the sorted vocabulary) df, numbers of the documents and frequencies; as term -1 the ids
    and lengths of all its documents, with the number of those that have a term in df and of all terms in total."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(number: int, ids: list, lengths: list, found: list) -> pa.RecordBatch:
        n = np.concatenate(lengths)
        term, doc, tf = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order].astype(np.uint16), tf[order]
        cut = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
        end = np.append(cut[1:], len(term))
        rows = [(number, -1, int((n > 0).sum()), int(n.sum()), np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(), n.astype(np.int64).tobytes())]
        rows += [(number, int(term[a]), int(b - a), 0, doc[a:b].tobytes(), _narrow(tf[a:b]).tobytes()) for a, b in zip(cut, end)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "term", "df", "total", "docs", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = shared.value, TaskContext.get().partitionId() << 32
        ids, lengths, found, held = [], [], [], 0
        for b in batches:
            own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices([len(x or "") for x in texts], SLICE_CHARS):
                if ids and (len(ids) + hi - lo > SHARD_DOCS or held >= SHARD_POSTINGS):
                    yield shard(number, ids, lengths, found)
                    number, ids, lengths, found, held = number + 1, [], [], [], 0
                t = Terms(texts[lo:hi])
                w = t.words()
                at = np.minimum(np.searchsorted(vocabulary, w), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero(vocabulary[at] == w) if len(vocabulary) else np.zeros(0, int)
                key, tf = np.unique(t.word_doc()[hit] * len(vocabulary) + at[hit], return_counts=True)
                found.append((key % max(len(vocabulary), 1), key // max(len(vocabulary), 1) + len(ids), tf))
                held += len(key)
                ids += own[lo:hi]
                lengths.append(t.n_words)
        if ids:
            yield shard(number, ids, lengths, found)

    return docs.select("doc_id", "text").mapInArrow(run, _POSTINGS)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms each; in Python's integers where 64 bits might not hold the product."""
    if 90 * int(n.max(initial=0)) * docs < 1 << 62:
        return 10 + 90 * n * docs // max(terms, 1)
    return np.array([10 + 90 * int(x) * docs // max(terms, 1) for x in n], np.int64)


def encode_blocks(docs: np.ndarray, tf: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
    """(end of each block's bytes, bytes): each block has a byte for the width of its gaps, then gaps (the first from the block's first document to
    itself, 0) behind the first document's number in two bytes, then frequencies."""
    out, ends, at = [], [], 0
    for lo in range(0, len(docs), block):
        d, f = docs[lo : lo + block], _narrow(tf[lo : lo + block])
        gaps = _narrow(np.diff(d))
        piece = bytes([gaps.itemsize]) + int(d[0]).to_bytes(2, "little") + gaps.tobytes() + f.tobytes()
        out.append(piece)
        at += len(piece)
        ends.append(at)
    return np.array(ends, np.int64), b"".join(out)


def decode_block(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and frequencies of a block of n postings."""
    width = data[0]
    cut = 3 + width * (n - 1)
    docs = np.full(n, int.from_bytes(data[1:3], "little"), np.int64)
    docs[1:] += np.cumsum(_wide(data[3:cut], n - 1))
    return docs, _wide(data[cut:], n)


def block_index(found: DataFrame, docs: int, terms: int, block: int = BLOCK) -> DataFrame:
    """The coded lists of each shard (``_INDEX``): ``tops`` are the list's ten largest impacts, offsets end with the number of postings and the size
    of a block; term -1 has ids as payload and lengths as offsets."""

    def build(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["term"] < 0)
        m = length_norms(np.frombuffer(own["tfs"], np.int64), docs, terms)
        out = [(own["shard"], -1, [], b"", b"", own["tfs"], own["docs"])]
        for r in rows:
            if r["term"] >= 0:
                d, tf = np.frombuffer(r["docs"], np.uint16).astype(np.int64), _wide(r["tfs"], r["df"])
                s = impacts(tf, m[d])
                lo = np.arange(0, len(d), block)
                ends, payload = encode_blocks(d, tf, block)
                tops = np.sort(s)[::-1][:TOP].tolist()
                out.append((r["shard"], r["term"], tops, np.maximum.reduceat(s, lo).tobytes(), d[np.minimum(lo + block, len(d)) - 1].tobytes(), np.append(ends, [len(d), block]).tobytes(), payload))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "term", "tops", "peaks", "lasts", "offsets", "payload"])

    return found.groupBy("shard").applyInArrow(build, _INDEX)


class List:
    """A coded list of a shard; blocks are decoded when they are asked for, and counted."""

    def __init__(self, row: dict, m: np.ndarray):
        self.peaks, self.lasts, ends = (np.frombuffer(row[c], np.int64) for c in ("peaks", "lasts", "offsets"))
        self.ends, (self.size, self.each) = ends[:-2], ends[-2:].tolist()
        self.payload, self.m = row["payload"], m
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k."""
        if k not in self.blocks:
            d, tf = decode_block(self.payload[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])], min(self.each, self.size - k * self.each))
            self.blocks[k] = d, impacts(tf, self.m[d])
        return self.blocks[k]

    def some(self, ks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*map(self.block, ks)))


def best(scores: np.ndarray, least: int) -> int:
    """The threshold after some scores are known: the tenth of them, if it is more than ``least``."""
    return max(least, int(np.partition(scores, len(scores) - TOP)[len(scores) - TOP])) if len(scores) >= TOP else least


def answer(lists: dict[int, List], terms: list[tuple[int, int]], bounds: np.ndarray, least: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, scores) of one shard that can be among the ten best, those among them. ``terms``: (term, weight); ``bounds``: the largest
    impact of each term in any shard; ``least``: a score that ten documents of all shards reach."""
    own = sorted((w * int(bounds[t]), t, w) for t, w in terms if w > 0 and t in lists)
    sums = np.concatenate(([0], np.cumsum([b for b, _, _ in own], dtype=np.int64)))
    split = int(np.searchsorted(sums[1:], least))  # lists before it: their bounds together stay below the threshold
    score = np.zeros(n_docs, np.int64)
    for _, t, w in own[split:]:
        d, s = lists[t].some(range(len(lists[t].lasts)))
        score[d] += w * s
    cand = np.flatnonzero(score)
    least = best(score[cand], least)
    for i in range(split - 1, -1, -1):
        _, t, w = own[i]
        cand = cand[score[cand] + sums[i + 1] >= least]
        if not len(cand):
            break
        x = lists[t]
        k = np.searchsorted(x.lasts, cand)
        peak = np.append(x.peaks, 0)[k] * w
        can = score[cand] + sums[i] + peak >= least
        cand, k = cand[can], k[can]
        some = np.unique(k[k < len(x.lasts)]).tolist()
        if some:
            d, s = x.some(some)
            at = np.minimum(np.searchsorted(d, cand), len(d) - 1)
            same = d[at] == cand
            score[cand[same]] += w * s[at[same]]
            least = best(score[cand], least)
    cand = cand[score[cand] >= max(least, 1)]
    return cand, score[cand]


def search(index: DataFrame, docs: int, terms: int, queries: list[tuple[int, int | None, list[tuple[int, int]]]], bounds: np.ndarray, tops: np.ndarray) -> DataFrame:
    """shard, qid, item_id, doc_id, score: every shard's ten best of each query. ``tops``: each term's tenth largest impact over all shards (0: fewer)."""
    ready = [(q, i, own, max((w * int(tops[t]) for t, w in own), default=0)) for q, i, own in queries]
    shared = index.sparkSession.sparkContext.broadcast((ready, bounds))

    def run(t: pa.Table) -> pa.Table:
        queries, bounds = shared.value
        rows = t.to_pylist()
        own = next(r for r in rows if r["term"] < 0)
        ids = np.frombuffer(own["payload"], np.int64)
        m = length_norms(np.frombuffer(own["offsets"], np.int64), docs, terms)
        lists = {r["term"]: List(r, m) for r in rows if r["term"] >= 0}
        out: list[tuple] = []
        for qid, item, wanted, least in queries:
            d, s = answer(lists, wanted, bounds, least, len(ids))
            known = ids[d] != NO_ID
            order = np.lexsort((ids[d], ~known, -s))[:TOP]
            out += [(own["shard"], qid, item, int(i) if k else None, int(v)) for i, k, v in zip(ids[d][order], known[order], s[order])]
        kinds = ("shard", "qid", "item_id", "doc_id", "score")
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=list(kinds))

    return index.groupBy("shard").applyInArrow(run, "shard bigint, qid bigint, item_id bigint, doc_id bigint, score bigint")


def term_bounds(index: DataFrame) -> DataFrame:
    """term, tops: the ten largest impacts of each term over all shards, merged in two levels."""
    ten = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, TOP).alias("tops")
    return index.where("term >= 0").groupBy("term", F.pmod(F.xxhash64("shard"), F.lit(256)).alias("part")).agg(ten).groupBy("term").agg(ten)


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ten best documents with a score above 0, equal scores by ascending doc_id.

    Null, empty and termless texts have no terms: such items give no rows, such documents are not counted and never found. Rows that repeat
    a document are documents of their own (a null id comes after the others), rows that repeat an item_id are items of their own, ranked
    each for itself. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    items = keep(item_terms(items, item_id, item_text).where("octet_length(terms) > 0"), "items")
    rounds = (items.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) // ITEM_BYTES + 1
    out = spark.createDataFrame([], "shard bigint, qid bigint, item_id bigint, doc_id bigint, score bigint")
    for part in range(rounds):
        # at most ITEM_BYTES on average, and one item more
        wanted = [(r["qid"], r["item_id"], np.frombuffer(r["terms"], np.uint64)) for r in items.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == part).collect()]
        if not wanted:
            continue
        vocabulary = np.unique(np.concatenate([t for _, _, t in wanted]))
        found = keep(postings(docs, vocabulary), "postings")
        df, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for r in found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect():
            df[r["term"]] = r["df"]  # the documents that have a term stand last
            total = max(total, r["total"])
        n = int(df[-1])
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df[:-1]]
        index = keep(block_index(found, n, total, block), "index")
        discard(found)
        bounds, tenth = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        for r in term_bounds(index).collect():
            bounds[r["term"]] = r["tops"][0]
            tenth[r["term"]] = r["tops"][TOP - 1] if len(r["tops"]) >= TOP else 0
        queries = [(q, i, [(int(t), weight[t]) for t in np.searchsorted(vocabulary, terms)]) for q, i, terms in wanted]
        out = out.unionByName(search(index, n, total, queries, bounds, tenth))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    heaps = out.withColumn("_heap", F.pmod(F.xxhash64("shard"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("qid", "_heap").orderBy(*order))).where(F.col("rank") <= TOP)
    return heaps.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
     l AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1), a AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
     p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY 1, 2), f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
     w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a),
     s AS (SELECT item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN l ON l.doc_id = p.doc_id CROSS JOIN a GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
