"""Operator 12, phrase collocations from mergeable Misra-Gries summaries.

1. Every slice of texts counts its n-grams of one to ``max_words`` words and deals their fingerprints out to hash partitions, each a summary of
   its own. The summaries of a partition are merged into one with more counters than ``SLACK`` times its mass (occurrences) divided by the
   threshold; where a merge has more, the largest count that has no place is taken from all of them. What is taken in all is below
   threshold / ``SLACK``, so every n-gram that occurs ``least`` times or more survives: its counter plus what was taken reaches ``least``.
   The number of partitions follows the size of the corpus, so a partition's memory doesn't.
2. The survivors are set in a bit table of at most ``TABLE_BITS`` bits. A second pass counts the n-grams that it lets through as text, exactly;
   others that it lets through fall to the threshold. A fuller table lets more through and loses none.
3. Cuts, scores, containment and ranks are joins and windows over the exact counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, join_groups, keep, read, slices, small_batches
from .textnum import Texts, mix, sequences

#: Occurrences a phrase must have, words in a phrase at most, and phrases of a language in the result.
LEAST, MAX_WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has this many hundredths of its occurrences.
INSIDE = 50
#: Counters of a summary over mass / threshold; occurrences in a hash partition, about; bits of the table of survivors at most.
SLACK, PART_MASS, TABLE_BITS = 4, 4_000_000, 1 << 29
#: Characters whose n-grams are counted at once.
SLICE_CHARS = 1 << 20
#: Rows of exact counts that are broadcast at most (some 60 bytes each).
BROADCAST_ROWS = 400_000
UNKNOWN = "und"

_STOP = np.zeros(128, bool)
_STOP[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True


class Pieces(Texts):
    """Texts with A-Z lower-cased, and the words ``[^\\x20\\x09]+`` of their pieces between ``[.,;:!?\\x0A-\\x0D]``."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts, lower_ascii=True)
        stop = _STOP[np.minimum(self.cp, 127)] & (self.cp < 128)
        edge = np.diff(np.concatenate(([1], (stop | (self.cp == 32) | (self.cp == 9)).view(np.int8), [1])))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.word_at = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_at)
        #: number of the piece each word stands in; the line feed after each text ends one
        self.piece = np.cumsum(stop)[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def ngrams(self, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, 64-bit key) of each n-gram inside a piece; ``salt`` is the hash of each text's language."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        return at, mix(sequences(self.words(), at, n) + salt[self.word_doc()[at]])

    def phrase(self, at: np.ndarray, n: int) -> list[str]:
        """The words of each n-gram joined by single spaces."""
        plain = self.cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        tidy = np.ones(len(at), bool)
        for k in range(n - 1):
            tidy &= (self.starts[at + k + 1] - self.ends[at + k] == 1) & (self.cp[self.ends[at + k]] == 32)
        return [plain[s:e] if ok else " ".join(re.split("[ \t]+", plain[s:e])) for s, e, ok in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), tidy.tolist())]


def place(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition (from the upper half of a key, in its order) and fingerprint (the lower half)."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def merge_summaries(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(items, counters, taken) of the Misra-Gries summary of at most ``capacity`` counters that the given ones merge into.

    ``taken`` is at most mass / (capacity + 1): whenever a count is taken from all counters, more than ``capacity`` of them have it. An item's
    occurrences are between its counter and its counter plus ``taken``, an item without a counter has ``taken`` at most.
    """
    items, counters, held, taken = [], [], 0, 0

    def squeeze() -> None:
        nonlocal items, counters, held, taken
        every, count = np.concatenate(items), np.concatenate(counters)
        order = np.argsort(every, kind="stable")
        every, count = every[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, int)
        every, count = every[first], np.add.reduceat(count, first) if len(first) else count
        if len(every) > capacity:
            out = int(np.partition(count, len(count) - capacity - 1)[len(count) - capacity - 1])
            count = count - out
            every, count = every[count > 0], count[count > 0]
            taken += out
        items, counters, held = [every], [count], len(every)

    for k, c in summaries:
        items.append(k)
        counters.append(c.astype(np.int64))
        held += len(k)
        if held > 2 * capacity:
            squeeze()
    if not items:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    squeeze()
    return items[0], counters[0], taken


def _each(docs: DataFrame, fn: Callable[[Pieces, np.ndarray, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn(pieces, language hashes, languages)`` for slices of the texts (columns lang, salt and text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, salts, texts = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE_CHARS):
                yield fn(Pieces(texts[lo:hi]), salts[lo:hi].astype(np.int64).view(np.uint64), langs[lo:hi])

    return docs.select("lang", "salt", "text").mapInArrow(run, schema)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values that are successive stretches of an array."""
    offsets = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def summaries(docs: DataFrame, parts: int, max_words: int) -> DataFrame:
    """part, ones, many, counts: the exact summary of each slice by hash partition; fingerprints seen once need no count."""

    def count(t: Pieces, salt: np.ndarray, langs: list[str]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([t.ngrams(k, salt)[1] for k in range(1, max_words + 1)]), return_counts=True)
        part, prints = place(keys, parts)
        here, once = np.unique(part), n == 1
        sizes = [np.bincount(np.searchsorted(here, part[m]), minlength=len(here)) for m in (once, ~once)]
        return pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), _binary(prints[once], sizes[0]), _binary(prints[~once], sizes[1]), _binary(n[~once].astype(np.uint32), sizes[1])], ["part", "ones", "many", "counts"])

    return _each(docs, count, "part bigint, ones binary, many binary, counts binary")


def survivors(found: DataFrame, least: int, slack: int = SLACK) -> DataFrame:
    """part, prints, n: the fingerprints of each hash partition that may have ``least`` occurrences, all that have among them."""

    def merge(t: pa.Table) -> pa.Table:
        ones, many, counts = ([np.frombuffer(x or b"", np.uint32) for x in t.column(c).to_pylist()] for c in ("ones", "many", "counts"))
        mass = sum(map(len, ones)) + sum(int(c.sum(dtype=np.int64)) for c in counts)
        own = [pair for o, m, c in zip(ones, many, counts) for pair in ((o, np.ones(len(o), np.int64)), (m, c))]
        items, counters, taken = merge_summaries(own, slack * mass // least + 1)
        kept = items[counters + taken >= least]
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int64()), "prints": pa.array([kept.astype(np.uint32).tobytes()], pa.binary()), "n": pa.array([len(kept)], pa.int64())})

    return found.groupBy("part").applyInArrow(merge, "part bigint, prints binary, n bigint")


def _bit(prints: np.ndarray, width: int) -> np.ndarray:
    return (prints.astype(np.uint64) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def bit_table(kept: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """Packed bits, ``width`` for each hash partition, set where a survivor falls: sixteen for each survivor, ``TABLE_BITS`` in all at most.
    A partition's bits reach the driver as its own stretch of the table."""
    total = kept.agg(F.sum("n")).first()[0] or 0
    width = 64
    while width * 2 <= TABLE_BITS // parts and width * parts < 16 * total:
        width *= 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for prints in b.column(1).to_pylist():
                bits = np.zeros(width, bool)
                bits[_bit(np.frombuffer(prints, np.uint32), width)] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["part", "bits"])

    table = np.zeros((parts, width // 8), np.uint8)
    for r in kept.where("n > 0").select("part", "prints").mapInArrow(pack, "part bigint, bits binary").toLocalIterator():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table, width


def exact_counts(docs: DataFrame, table: np.ndarray, width: int, max_words: int) -> DataFrame:
    """lang, size, phrase, f of the n-grams the table lets through, and of size 0 with an empty phrase the words of each language."""
    shared, parts = docs.sparkSession.sparkContext.broadcast(table), len(table)

    def count(t: Pieces, salt: np.ndarray, langs: list[str]) -> pa.RecordBatch:
        flat = shared.value.ravel()
        lang, size, phrase, f = [], [], [], []
        doc, names = t.word_doc(), np.array(langs, object)
        for n in range(1, max_words + 1):
            at, keys = t.ngrams(n, salt)
            part, prints = place(keys, parts)
            bit = part * width + _bit(prints, width)
            hit = (flat[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)
            _, first, seen = np.unique(keys[hit], return_index=True, return_counts=True)
            first = at[hit][first]
            lang += names[doc[first]].tolist()
            size += [n] * len(first)
            phrase += t.phrase(first, n)
            f += seen.tolist()
        words: dict[str, int] = {}
        for name, k in zip(langs, t.n_words.tolist()):
            words[name] = words.get(name, 0) + k
        lang, size, phrase, f = lang + list(words), size + [0] * len(words), phrase + [""] * len(words), f + list(words.values())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"])

    return _each(docs, count, "lang string, size int, phrase string, f bigint").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def frequent(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all n-grams of up to ``max_words`` words that occur ``least`` times or more, (lang, n) of all words), both
    kept tables. ``docs``: lang, text; a null language is ``und``, a null text empty."""
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").withColumn("salt", F.xxhash64("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, min(TABLE_BITS // 64, size * max_words // 6 // PART_MASS)))
    kept = keep(survivors(summaries(docs, parts, max_words), least), "survivors")
    table, width = bit_table(kept, parts)
    counts = keep(exact_counts(docs, table, width, max_words).where(f"size = 0 or f >= {least}"), "phrases")
    discard(kept)
    return counts.where("size > 0"), counts.where("size = 0").select("lang", F.col("f").alias("n"))


def _looked_up(rows: DataFrame, counts: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``key``: by broadcast where the counts are few, else by a join safe for hot keys."""
    own = counts.select(F.concat_ws("\t", "lang", "phrase").alias("_key"), F.col("f").alias(out))
    keyed = rows.withColumn("_key", F.concat_ws("\t", "lang", key))
    if counts.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(own), "_key").drop("_key")
    keyed = keep(keyed, "cuts")  # read three times below
    groups = keep(keyed.groupBy("_key").agg(F.count("*").alias("_rows")).join(own, "_key"), "parts")
    return join_groups(keyed, groups, "_key", "_rows", keyed.count()).drop("_key", "_rows")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, inside: int = INSIDE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words.

    a, l and r are the occurrences of the phrase and of its parts at the cut with the lowest score floor(1000000 a a / (l r)), of equal ones
    the one with the shortest first part; n are the language's words. Phrases inside a longer one with ``inside`` hundredths of their
    occurrences or more are left out. Null texts are empty, a null language is ``und`` and one with texts in that language; rows that repeat
    a text count each; a language without such phrases, and an empty table, give no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts, words = frequent(docs, least, max_words)
    several = counts.where("size > 1").withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = _looked_up(_looked_up(cuts.drop("w"), counts, "left", "l"), counts, "right", "r")
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    cuts = cuts.select("lang", "size", "phrase", "a", "k", "l", "r", (exact["a"] * exact["a"] * F.lit(1_000_000)).alias("_up"), (exact["l"] * exact["r"]).alias("_down"))
    scored = cuts.withColumn("score", F.expr("_up div _down")).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the largest count of a longer phrase around each phrase
    spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    around = several.where("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # a language may hold most phrases: its best are found in 64 heaps first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    heaps = left.withColumn("_heap", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_heap").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
     s AS (SELECT lang, w, size FROM w, (VALUES (1), (2), (3)) AS v(size) WHERE len(w) >= size), u AS (SELECT lang, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM s),
     c AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM u GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
     k AS (SELECT lang, size, phrase, f AS a, unnest(generate_series(1, size - 1)) AS k FROM c WHERE size > 1),
     x AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp FROM k),
     z AS (SELECT x.lang, x.size, x.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM x JOIN c l ON l.lang = x.lang AND l.phrase = lp JOIN c r ON r.lang = x.lang AND r.phrase = rp),
     b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     h AS (SELECT lang, array_to_string(string_split(phrase, ' ')[j:j + 1], ' ') AS phrase, max(f) AS longer FROM c, (VALUES (1), (2)) AS v(j) WHERE size = 3 GROUP BY 1, 2),
     o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase AND b.size = 2 WHERE longer IS NULL OR 100 * longer < {INSIDE} * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
