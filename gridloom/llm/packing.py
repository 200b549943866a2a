"""Operator 8, best-fit packing: a configuration linear program over the length histogram, rounded.

Documents become token pieces of at most ``capacity`` tokens. All that matters for packing is the histogram of piece lengths, at most
``capacity`` numbers, which alone goes to the driver. There a configuration (a multiset of lengths that fits a sequence) is a column of
a covering program: use as few configurations as possible so that every length's demand is met. Multiplicative weights solve it: a
length's dual price starts high for long pieces, which few others fit, and falls exponentially with the share of its demand that is
covered. A knapsack dynamic program over the capacity prices each round's columns, for each length the best one that holds it and leaves
no place empty; columns near the best are used in whole sequences as far as the pieces reach, so that the solution is rounded as it grows.
Where no full column is left, columns with a few places more than need be empty are let in. What no such column can be made of is the
remainder of the rounding, which alone is packed best fit, longest first, by counts.

Pieces then find their places without another look at the texts: the k-th piece of a length (a distributed rank) takes the k-th slot
that the configurations have for it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import CHUNK_CHARS, id_text, keep, read, release, slices

_coders: dict[str, object] = {}


def _coder(path: str):
    """A fast encoder with the vocabulary at ``path``; ids are those of the backtracking encoder, which is only loaded for very long texts."""
    if path not in _coders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = bpe.byte_alphabet()
        ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        _coders[path] = tiktoken.Encoding("corpus", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens=special)
    return _coders[path]


def token_ids(path: str, text: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; very long texts take the encoder of linear time."""
    if len(text) > CHUNK_CHARS:
        return np.frombuffer(bpe.load(path).encode_bytes(text), "<u4")
    return _coder(path).encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and a first one that may be shorter."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids followed by ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                at, rows = [], []
                for i in range(lo, hi):
                    seq = np.append(token_ids(path, texts[i] or "").astype("<u4"), np.array(end_id, "<u4"))
                    for k, (s, n) in enumerate(cut(len(seq), capacity)):
                        at.append(i)
                        rows.append((k, s, n, zlib.crc32(seq[s : s + n].tobytes())))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _price(value: np.ndarray, capacity: int) -> np.ndarray:
    """The largest value of a configuration of exactly each size up to ``capacity`` (unbounded knapsack), -inf where there is none.
    value[l] is that of length l, 0 for none."""
    usable = np.flatnonzero(value)
    v = value[usable]
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0
    for c in range(1, capacity + 1):
        k = np.searchsorted(usable, c, "right")
        if k:
            best[c] = (best[c - usable[:k]] + v[:k]).max()
    return best


def _column(first: int, size: int, best: np.ndarray, value: np.ndarray, room: np.ndarray) -> list[int] | None:
    """The best configuration of ``size`` tokens that holds ``first``, with no length more often than ``room`` says, or None."""
    out, c = [first], size - first
    room = room.copy()
    room[first] -= 1
    while c > 0:
        usable = np.flatnonzero((room[: c + 1] > 0) & (value[: c + 1] > 0))
        gains = best[c - usable] + value[usable]
        if not len(usable) or gains.max() == -np.inf:
            return None
        length = int(usable[gains.argmax()])
        out.append(length)
        c -= length
        room[length] -= 1
    return out


def configurations(demand: np.ndarray, capacity: int, slack: float = 0.02, waste: float = 1 / 64, remainder: float = 0.05, more: int = 0) -> dict[tuple[int, ...], int]:
    """Solution of the configuration program by multiplicative weights, in whole sequences. demand[l] pieces have length l.

    A round uses columns whose value is within ``slack`` of the best one's, and a round without any doubles the slack. When the fullest
    columns are at an end, others with 1, 3, 7, ... more empty places come in (``more`` from the begin), up to ``waste`` of the capacity, and beyond while more than ``remainder`` of the
    pieces is uncovered.
    """
    x: dict[tuple[int, ...], int] = {}
    left = demand.astype(np.int64)
    price = (np.arange(len(demand)) / capacity) ** 2
    reach_down = slack
    while left.any() and (more <= waste * capacity or capacity > more and left.sum() > remainder * demand.sum()):
        share = 1 - np.divide(left, demand, out=np.zeros(len(demand)), where=demand > 0)
        value = np.where(left > 0, price * np.exp(-share), 0.0)
        best = _price(value, capacity)
        usable = np.flatnonzero(left)
        empty = capacity - int(np.flatnonzero(best > -np.inf)[-1]) + more
        # for each length the best size of what stands beside it, with at most ``empty`` places left
        beside = [max(0, capacity - n - empty) + int(best[max(0, capacity - n - empty) : capacity - n + 1].argmax()) for n in usable.tolist()]
        worth = value[usable] + best[beside]
        top, moved = worth.max(), False
        order = np.lexsort((-usable, -worth))
        for at in order[worth[order] >= (1 - reach_down) * top].tolist() if top > -np.inf else ():
            first = int(usable[at])
            while left[first] > 0:
                config = _column(first, first + beside[at], best, value, left)
                if config is None or value[config].sum() < (1 - 2 * reach_down) * top:
                    break
                lengths, times = np.unique(config, return_counts=True)
                amount = int(np.min(left[lengths] // times))
                key = tuple(sorted(config, reverse=True))
                x[key] = x.get(key, 0) + amount
                left[lengths] -= amount * times
                moved = True
        if moved:
            reach_down = max(slack, reach_down / 1.5)
        elif reach_down < 1 and top > -np.inf:
            reach_down = min(1.0, 2 * reach_down)
        else:
            more, reach_down = 2 * more + 1, slack
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing by counts: equal bins are handled together, so the work follows the number of lengths."""
    room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(r: int, config: tuple[int, ...], n: int) -> None:
        room.setdefault(r, {})
        room[r][config] = room[r].get(config, 0) + n

    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            r = min((r for r in room if r >= length and room[r]), default=None)
            if r is None:
                per = min(capacity // length, n)
                bins = n // per
                put(capacity - per * length, (length,) * per, bins)
                n -= bins * per
                continue
            config, have = next(iter(room[r].items()))
            m = min(n, have)
            room[r][config] -= m
            if not room[r][config]:
                del room[r][config]
            put(r - length, (*config, length), m)
            n -= m
    return [(config, n) for by in room.values() for config, n in by.items()]


def plan(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences): the program's solution, and best fit for the remainder. The program is solved for full columns
    first, and for columns of any filling, which suits histograms of few lengths; the solution with fewer sequences stands."""
    full = [((capacity,), int(demand[capacity]))] if demand[capacity] else []
    found = []
    for more in (0, capacity - 1):
        left, out = demand.copy(), list(full)
        left[capacity] = 0
        for config, n in sorted(configurations(left, capacity, more=more).items(), key=lambda c: (-c[1], c[0])):
            out.append((config, n))
            lengths, times = np.unique(config, return_counts=True)
            left[lengths] -= n * times
        found.append(out + best_fit(left, capacity))
    return min(found, key=lambda out: sum(n for _, n in out))


def slots(configs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence_id, offset) of its slots, in rank order."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for config, n in configs:
        offset = 0
        for length in config:
            k = taken.get(length, 0)
            out.setdefault(length, []).append((k, base, offset))
            taken[length] = k + n
            offset += length
        base += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(parts: DataFrame, capacity: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length and any others).

    Every piece gets a place; no sequence exceeds ``capacity`` and each is filled from 0 without gaps. Pieces of a length are ranked in
    buckets, at most ``bucket_rows`` in one and fewer where that leaves tasks idle, so that a common length is spread over many tasks.
    """
    spark = parts.sparkSession
    hist = parts.groupBy("length").count().collect()  # at most ``capacity`` rows
    demand = np.zeros(capacity + 1, np.int64)
    for r in hist:
        demand[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(slots(plan(demand, capacity)))
    own = min(bucket_rows, max(100, int(demand.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    deals = spark.createDataFrame([(r["length"], -(-r["count"] // own)) for r in hist], "length bigint, _deals bigint")
    dealt = parts.join(F.broadcast(deals), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32" if "ids_crc32" in parts.columns else "length"), "_deals")).drop("_deals")
    before = dealt.groupBy("length", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).drop("count")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*parts.columns, "_rank")
    names = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                rows = table.value[int(value)]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                seq[at] = rows[k, 1] + rank[at] - rows[k, 0]
                off[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Rows that repeat an id are packed like any others. An empty table gives an empty
    result; columns besides id and text are ignored.
    """
    parts = keep(pieces(id_text(docs, id_col, text_col), path, capacity, end_id), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), bpe.tokenizer_path())
