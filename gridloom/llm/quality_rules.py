"""Operator 3, quality rules: distribution divergence from language references.

A text's histogram over character classes, and its histogram over the commonest short words of a language, are compared with references by
the Jensen-Shannon distance (base 2, 0 to 1). References are counted over all rows of the table, by language. A text is judged by the language
whose references it is nearest to; too far from both kinds means it is no text of any language at hand. Histograms of few words say little,
so each comparison has a guard on the number of words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, map_texts, read
from .textnum import Texts, mix, sequences

SYMBOLS = "#*$%&|<>"
#: Character classes: white space, a-z, A-Z, digits, symbols, other ASCII, other.
CLASSES = 7
#: Words of up to this many code points count as short; the commonest of a language are its common words.
SHORT, COMMON = 6, 48
#: Farthest distances allowed, and words needed for the comparison (production parameters).
MAX_CHAR, MIN_CHAR_WORDS = 0.32, 20
MAX_WORD, MIN_WORD_WORDS = 0.38, 100
MIN_WORDS, MAX_REPEAT = 50, 50


def _class_table() -> np.ndarray:
    t = np.full(128, 5, np.int8)
    t[[32, *range(9, 14)]] = 0
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 1, 2, 3
    t[[ord(c) for c in SYMBOLS]] = 4
    return t


def char_classes(t: Texts) -> np.ndarray:
    """Counts of the character classes in each text."""
    kinds = np.where(t.cp < 128, _class_table()[np.minimum(t.cp, 127)], 6)
    doc = np.repeat(np.arange(t.n), t.lengths + 1)
    inside = np.ones(len(t.cp), bool)
    inside[t.offsets[1:] - 1] = False
    return np.bincount((doc * CLASSES + kinds)[inside], minlength=t.n * CLASSES).reshape(t.n, CLASSES)


def _per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the places ``at``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def base_metrics(t: Texts, classes: np.ndarray) -> dict[str, np.ndarray]:
    words, doc = t.words(), t.word_doc()
    n = len(words)
    # lines: between line feeds (texts are joined by one), with a word
    feeds = np.flatnonzero(t.cp == 10)
    starts = np.concatenate(([0], feeds[:-1] + 1)) if len(feeds) else np.zeros(0, np.int64)
    has = np.searchsorted(t.starts, feeds) > np.searchsorted(t.starts, starts)
    starts, ends = starts[has], feeds[has]
    line_doc = np.searchsorted(t.offsets, starts, "right") - 1
    owned = mix(t.span_hash(starts, ends) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(starts) else np.zeros(0, np.uint64)
    _, first = np.unique(owned, return_index=True)
    dup = np.bincount(line_doc, minlength=t.n) - np.bincount(line_doc[first], minlength=t.n)
    # words in three-word windows found twice
    repeated = np.zeros(n + 2, bool)
    at = np.flatnonzero(doc[:-2] == doc[2:]) if n > 2 else np.zeros(0, np.int64)
    if len(at):
        h = mix(sequences(words, at, 3) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        hit = at[times[back] > 1]
        repeated[hit] = repeated[hit + 1] = repeated[hit + 2] = True
    return {
        "n_words": t.n_words,
        "word_chars": _per_doc(t.ends - t.starts, t.word_at),
        "n_symbols": classes[:, 4],
        "n_dup_lines": dup,
        "n_repeat_words": _per_doc(repeated[:n].astype(np.int64), t.word_at),
    }


def _short_words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each short word, A-Z lower-cased by the caller."""
    short = t.ends - t.starts <= SHORT
    return t.word_doc()[short], t.span_hash(t.starts[short], t.ends[short]).view(np.int64)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language -> (character-class shares, sorted hashes of its common words, shares of these and of all other words), over all rows.

    Counted in the workers and summed by Spark; what reaches the driver is a few numbers a language.
    """

    def run(batches):
        import pyarrow as pa

        from .common import slices

        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lo, hi in slices([len(x or "") for x in texts]):
                t = Texts(texts[lo:hi], lower_ascii=True)
                classes = char_classes(Texts(texts[lo:hi]))
                doc, h = _short_words(t)
                rows: list[tuple[str, int, int, int]] = []
                part = langs[lo:hi]
                for lang in set(part):
                    own = part == lang
                    rows += [(lang, 0, k, int(c)) for k, c in enumerate(classes[own].sum(0))]
                    rows.append((lang, 2, 0, int(t.n_words[own].sum())))
                    u, c = np.unique(h[own[doc]], return_counts=True)
                    rows += [(lang, 1, int(k), int(n)) for k, n in zip(u, c)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, kind int, item bigint, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))).where(f"r <= {COMMON}")
    out: dict[str, list] = {}
    for r in top.collect():
        out.setdefault(r["lang"], []).append((r["kind"], r["item"], r["n"]))
    made = {}
    for lang, rows in sorted(out.items()):
        chars, total = np.zeros(CLASSES), 0
        words = sorted((i, n) for k, i, n in rows if k == 1)
        for k, i, n in rows:
            if k == 0:
                chars[i] = n
            elif k == 2:
                total = n
        if total and chars.sum() and words:
            share = np.array([n for _, n in words], float) / total
            made[lang] = (chars / chars.sum(), np.array([i for i, _ in words], np.int64), np.append(share, max(0.0, 1 - share.sum())))
    return made


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p and the distribution q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_char, js_word.

    Null and empty texts have no words and fail the base rules. ``js_*`` are null where the guard on words doesn't let them be compared, or
    where the table has no language with text to refer to. Rows that repeat an id each get a row; an empty table gives an empty result.
    """
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(references(named))

    def run(texts: list) -> dict:
        t = Texts(texts)
        classes = char_classes(t)
        out = base_metrics(t, classes)
        low = Texts(texts, lower_ascii=True)
        doc, h = _short_words(low)
        n = out["n_words"]
        char, word = np.full(t.n, np.inf), np.full(t.n, np.inf)
        shares = classes / np.maximum(classes.sum(1, keepdims=True), 1)
        for chars, items, common in shared.value.values():
            at = np.minimum(np.searchsorted(items, h), len(items) - 1)
            hit = items[at] == h
            seen = np.bincount(doc[hit] * len(common) + at[hit], minlength=t.n * len(common)).reshape(t.n, len(common)).astype(float)
            seen[:, -1] = n - seen.sum(1)
            c, w = js_distance(shares, chars), js_distance(seen / np.maximum(n, 1)[:, None], common)
            nearer = c + w < char + word
            char, word = np.where(nearer, c, char), np.where(nearer, w, word)
        failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * n)
        use_char, use_word = np.isfinite(char) & (n >= MIN_CHAR_WORDS), np.isfinite(word) & (n >= MIN_WORD_WORDS)
        far = (use_char & (char > MAX_CHAR)) | (use_word & (word > MAX_WORD))
        as_list = lambda x, ok: [float(v) if o else None for v, o in zip(x, ok)]
        return {k: v.astype(np.int64) for k, v in out.items()} | {"base_failed": failed, "kept": ~failed & ~far, "js_char": as_list(char, use_char), "js_word": as_list(word, use_word)}

    return map_texts(id_text(docs, id_col, text_col), run, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, js_char double, js_word double")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents"))
