"""Operator 5, personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans come from fixed patterns, found in time linear in the text. The field then looks at the stretches of a text that might hold
more: those with many digits, and those around an at sign or its spelt-out form. A stretch is cut into tokens; a segmentation of it gives
every segment a type (email, ip, card, phone or none), features score a whole candidate span at once (its shape, number of digits,
separators, checksum, octets, domain, the word before), a transition scores its type after that of the entity before it in the stretch, and
dynamic programming over segments of bounded length picks boundaries and types jointly. Base spans are fixed segments there, so they stay,
nothing overlaps them, and their types count for the entity after them.

Weights are trained in numpy on the segmentations that the base patterns give a bounded sample of documents, and on rewritten copies of
these spans (other separators, spelt-out signs, no plus), by stochastic gradient steps on the conditional log-likelihood.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_texts, read
from .training import hash_cut

KINDS = ("email", "ip", "card", "phone")
#: Documents whose base spans the field is trained on at most, and characters of whole stretches from each.
TRAIN_DOCS, TRAIN_CHARS = 600, 2000
#: Longest segment of a type, in tokens; none-segments are single tokens.
MAX_TOKENS = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # what matches inside a run of digits matches from its begin too
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end(), 0))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # no local part reaches over an at sign
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed patterns, sorted by start and kind; leftmost, non-overlapping within a kind, failing matches dropped."""
    out = _emails(text) if "@" in text else []
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- the field

_TOKEN = re.compile(r"[^\W_]+|_|\s+|[^\w\s]")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9 ().\-/ +]*[0-9]")
_SIGN = re.compile(r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?", re.I)
_HOST = re.compile(r"([^\s@]+)(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?\w+)*", re.I)
_MAILISH = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]+)+", re.I)
_GROUPS = re.compile("[0-9]+")
_DOTTED = re.compile(r"[A-Za-z0-9-]\.[A-Za-z0-9-]")

#: Features of a whole span, each with one weight a type; the list is the field's definition.
FEATURES = (
    "bias", "has_at", "spelt_at", "domain", "whole_mail", "four_octets", "octets_big", "luhn_14_19", "digits_13_19_no_luhn", "digits_10_15",
    "digits_7_9", "digits_under_7", "plus_first", "bracket", "dot_groups", "dash_or_space", "plain_run", "letters", "groups_of_4", "edge_space",
    "word_before_phone", "word_before_card", "word_before_ip", "word_before_mail", "glued", "phone_shape",
)
_BEFORE = (("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"), ("card", "visa", "credit", "karte", "carte", "tarjeta"), ("ip", "host", "server", "addr", "address"), ("mail", "email", "e-mail", "contact", "correo"))
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}$")


def span_features(text: str, lo: int, hi: int) -> np.ndarray:
    """Feature vector of text[lo:hi] as one entity."""
    s = text[lo:hi]
    digits = _DIGITS.sub("", s)
    n, groups = len(digits), _GROUPS.findall(s)
    before = text[max(0, lo - 24) : lo].lower()
    octets = len(groups) == 4 and s.count(".") == 3 and n + 3 == len(s)
    f = np.zeros(len(FEATURES))
    f[:] = (
        1, "@" in s, bool(re.search(r"[(\[{]at[)\]}]", s, re.I)), bool(_DOTTED.search(s)), bool(_MAILISH.fullmatch(s)), octets and all(int(g[:4]) <= 255 for g in groups),
        octets and any(int(g[:4]) > 255 for g in groups), 14 <= n <= 19 and luhn(digits), 13 <= n <= 19 and not luhn(digits), 10 <= n <= 15, 7 <= n <= 9, n < 7,
        s[0] == "+", "(" in s, s.count(".") > 0, "-" in s or " " in s, n == len(s), n < len(re.sub(r"[\s().+\-/]", "", s)), len(groups) > 2 and all(len(g) == 4 for g in groups),
        s[0].isspace() or s[-1].isspace(), *(any(w in before for w in ws) for ws in _BEFORE),
        (lo > 0 and text[lo - 1].isalnum()) or (hi < len(text) and text[hi].isalnum()), bool(_PHONE_SHAPE.fullmatch(s)),
    )
    return f


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that might hold an entity: runs of at least seven digits with separators, and what stands around an at sign."""
    found = [(m.start(), m.end()) for m in _NUMERIC.finditer(text) if len(_DIGITS.sub("", m.group())) >= 7]
    done = reach = 0
    for m in _SIGN.finditer(text):
        lo = m.start()
        while lo > done and not text[lo - 1].isspace() and text[lo - 1] != "@":
            lo -= 1
        done = m.end()
        # a sign inside the host of the one before would end where that ends
        if lo < m.start() and m.end() >= reach and (host := _HOST.match(text, m.end())):
            found.append((lo, host.end()))
            reach = host.end(1)
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def taken(borders: list[int], fixed: list[Span]) -> np.ndarray:
    """The kind of the fixed span that each token lies in, -1 for none."""
    kind = np.full(len(borders) - 1, -1)
    for s, e, k in fixed:
        if s < borders[-1] and e > borders[0]:
            kind[max(0, bisect_right(borders, s) - 1) : bisect_left(borders, e)] = k
    return kind


def candidates(text: str, lo: int, hi: int, fixed: list[Span]) -> tuple[list[int], list[tuple[int, int]]]:
    """Token borders of a stretch, and spans (first, last border) that may be an entity; none of them overlaps a fixed span.

    Spans begin where a number or address can begin and end after a letter or digit, have at most ``MAX_TOKENS`` tokens, and are either
    numeric throughout with 7 to 19 digits, or hold an at sign.
    """
    borders = [lo] + [m.end() for m in _TOKEN.finditer(text, lo, hi)]
    if borders[-1] != hi:
        borders.append(hi)
    free = taken(borders, fixed) < 0
    spans = []
    for i in range(len(borders) - 1):
        if not free[i] or not (text[borders[i]].isalnum() or text[borders[i]] in "+("):
            continue
        for j in range(i + 1, min(len(borders), i + 1 + MAX_TOKENS)):
            if not free[j - 1]:
                break
            if not text[borders[j] - 1].isalnum():
                continue
            s = text[borders[i] : borders[j]]
            if len(s) >= 7 and (7 <= sum(map(str.isdigit, s)) <= 19 and _NUMERIC.fullmatch(s) or _MAILISH.fullmatch(s)):
                spans.append((i, j))
    return borders, spans


class SemiMarkov:
    """A semi-Markov field: weights ``w`` [type, feature] of spans, and ``t`` [state, type] of transitions, the state being the type of the
    entity before plus 1, or 0 at a stretch's begin. A token outside an entity scores 0 and keeps the state."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.w, self.t = weights or (np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1, len(KINDS))))

    def _scores(self, text: str, borders: list[int], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([span_features(text, borders[i], borders[j]) for i, j in spans]).reshape(len(spans), len(FEATURES))
        return x, x @ self.w.T

    def chances(self, n: int, spans: list[tuple[int, int]], z: np.ndarray) -> tuple[np.ndarray, float]:
        """(chance of each span, state before it and type; log of the sum over segmentations) by forward and backward sums over ``n`` borders."""
        into: list[list[int]] = [[] for _ in range(n)]
        outof: list[list[int]] = [[] for _ in range(n)]
        for k, (i, j) in enumerate(spans):
            into[j].append(k)
            outof[i].append(k)
        fwd, bwd = np.full((n, len(KINDS) + 1), -np.inf), np.zeros((n, len(KINDS) + 1))
        fwd[0, 0] = 0
        for j in range(1, n):
            fwd[j] = fwd[j - 1]
            for k in into[j]:
                fwd[j, 1:] = np.logaddexp(fwd[j, 1:], np.logaddexp.reduce(fwd[spans[k][0]][:, None] + self.t, 0) + z[k])
        for i in range(n - 2, -1, -1):
            bwd[i] = bwd[i + 1]
            for k in outof[i]:
                bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.t + z[k] + bwd[spans[k][1], 1:], 1))
        total = float(np.logaddexp.reduce(fwd[-1]))
        chance = np.array([np.exp(fwd[i][:, None] + self.t + z[k] + bwd[j, 1:] - total) for k, (i, j) in enumerate(spans)])
        return chance, total

    def step(self, text: str, lo: int, hi: int, gold: list[Span], rate: float) -> None:
        """One gradient step on the log-likelihood of ``gold`` in text[lo:hi]."""
        borders, spans = candidates(text, lo, hi, [])
        if not spans:
            return
        x, z = self._scores(text, borders, spans)
        chance, _ = self.chances(len(borders), spans, z)
        right = {(s, e): kind for s, e, kind in gold}
        state = 0
        for k, (i, j) in enumerate(spans):  # in order of their begin; those of the gold don't overlap
            kind = right.get((borders[i], borders[j]))
            if kind is not None:
                chance[k, state, kind] -= 1
                state = kind + 1
        self.w -= rate * (chance.sum(1).T @ x)
        self.t -= rate * chance.sum(0)
        self.w *= 1 - rate * 1e-3
        self.t *= 1 - rate * 1e-3

    def best(self, n: int, spans: list[tuple[int, int]], z: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int, int]]:
        """(first border, last border, type) of the most likely segmentation's entities. ``kinds``: type of the fixed span of each token, or -1."""
        into: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(spans):
            into.setdefault(j, []).append(k)
        states = range(len(KINDS) + 1)
        score = np.full((n, len(KINDS) + 1), -np.inf)
        score[0, 0] = 0
        back: list[list[tuple[int, ...] | None]] = [[None] * len(states)]  # (border, state) that a state at a border comes from
        for j in range(1, n):
            own = int(kinds[j - 1]) + 1
            if own:
                s = int(score[j - 1].argmax())
                score[j, own] = score[j - 1, s]
                back.append([(j - 1, s) if x == own else None for x in states])
                continue
            score[j] = score[j - 1]
            back.append([(j - 1, x) for x in states])
            for k in into.get(j, ()):
                i = spans[k][0]
                for kind in range(len(KINDS)):
                    from_all = score[i] + self.t[:, kind]
                    s = int(from_all.argmax())
                    if from_all[s] + z[k, kind] > score[j, kind + 1]:
                        score[j, kind + 1] = from_all[s] + z[k, kind]
                        back[j][kind + 1] = (i, s, kind)
        out, j, s = [], n - 1, int(score[-1].argmax())
        while j > 0:
            step = back[j][s]
            if len(step) == 3:
                out.append((step[0], j, step[2]))
            j, s = step[:2]
        return out[::-1]

    def decode(self, text: str, lo: int, hi: int, fixed: list[Span]) -> list[Span]:
        """The most likely segmentation's entities in text[lo:hi] that don't overlap ``fixed``."""
        borders, spans = candidates(text, lo, hi, fixed)
        if not spans:
            return []
        _, z = self._scores(text, borders, spans)
        return [(borders[i], borders[j], kind) for i, j, kind in self.best(len(borders), spans, z, taken(borders, fixed))]


def rewritten(text: str, span: Span, rng: np.random.Generator) -> tuple[str, int] | None:
    """The span's text in another common notation and its kind, as training material for what the base patterns don't find."""
    s = text[span[0] : span[1]]
    digits = _DIGITS.sub("", s)
    if span[2] == 0:
        user, _, host = s.partition("@")
        return (f"{user} (at) {host}" if rng.random() < 0.5 else f"{user}[at]{host.replace('.', '[dot]')}"), 0
    if span[2] == 3 and len(digits) >= 10:
        a = digits[-10:]
        return (f"({a[:3]}) {a[3:6]}-{a[6:]}", f"{a[:3]}-{a[3:6]}-{a[6:]}", f"{a[:3]}.{a[3:6]}.{a[6:]}")[rng.integers(3)], 3
    if span[2] == 2:
        return ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), 2
    return None


def train(docs: DataFrame, rows: int = TRAIN_DOCS, epochs: int = 4, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most ``rows`` documents that have base spans, chosen by a hash of the id."""
    docs = docs.where("doc_id is not null")
    found = map_texts(hash_cut(docs, rows, docs.count(), 100), lambda ts: {"hits": [_examples(t or "") for t in ts]}, "hits array<string>")
    sample = found.where(F.size("hits") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    rng, field = np.random.default_rng(seed), SemiMarkov()
    cases: list[tuple[str, int, int, list[Span]]] = []
    for r in sample:
        for text in r["hits"]:
            gold = base_spans(text)
            for lo, hi in windows(text):
                cases.append((text, lo, hi, [g for g in gold if lo <= g[0] and g[1] <= hi]))
            for g in gold:
                if other := rewritten(text, g, rng):
                    new = text[: g[0]] + other[0] + text[g[1] :]
                    own = (g[0], g[0] + len(other[0]), other[1])
                    cases += [(new, lo, hi, [own]) for lo, hi in windows(new) if lo <= own[0] and own[1] <= hi]
    # numbers that are none of these: plain runs of digits, dates, amounts
    for k in range(len(cases) // 2):
        n = int(rng.integers(7, 22))
        digits = "".join(map(str, rng.integers(0, 10, n)))
        if 14 <= n <= 19 and luhn(digits):
            continue
        text = (f"no {digits} was", f"on 2{digits[:3]}-0{digits[3]}-1{digits[4]} 1{digits[5]}", f"of {digits[:3]} {digits[3:6]} {digits[6:9]} in", f"v {digits[0]}.{digits[1]}.{digits[2:8]} of")[k % 4]
        cases += [(text, lo, hi, []) for lo, hi in windows(text)]
    for e in range(epochs):
        for k in rng.permutation(len(cases)):
            field.step(*cases[k], rate=0.3 / (1 + e))
    return field.w, field.t


def _examples(text: str) -> list[str]:
    """A text's stretches with base spans, whole and with 30 characters around them, as many as ``TRAIN_CHARS`` allows."""
    out, room = [], TRAIN_CHARS
    starts = [s for s, _, _ in base_spans(text)]
    for lo, hi in windows(text) if starts else ():
        if bisect_left(starts, lo) < bisect_left(starts, hi) and hi - lo <= room:
            out.append(text[max(0, lo - 30) : hi + 30])
            room -= hi - lo
    return out


def find(text: str, field: SemiMarkov | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each sorted by start and kind."""
    base = base_spans(text)
    if field is None:
        return base, base
    more, ends = [], np.maximum.accumulate([e for _, e, _ in base]) if base else []
    for lo, hi in windows(text):
        first, last = bisect_right(ends, lo), bisect_left(base, (hi,))  # the base spans that may reach into the stretch
        more += field.decode(text, lo, hi, base[first:last])
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _field(weights: tuple[np.ndarray, np.ndarray]) -> SemiMarkov | None:
    return SemiMarkov(weights) if weights[0].any() else None


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null texts count as empty; without spans the counts are 0 and the lists empty strings. A table without any base span trains no field
    and gets base spans alone. Rows that repeat an id each get a row; an empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(train(rows))

    def run(texts: list) -> dict:
        field = _field(weights.value)
        found = [find(t or "", field) for t in texts]
        out = {f"n_{k}": [sum(s[2] == i for s in base) for base, _ in found] for i, k in enumerate(KINDS)}
        return out | {"base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], "spans": [_joined(a) for _, a in found]}

    return map_texts(rows, run, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first one's kind stands."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out.append(text[at:s] + f"<{KINDS[k].upper()}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` brought up to date where there is such a column; null texts stay null."""
    weights = docs.sparkSession.sparkContext.broadcast(train(id_text(docs)))

    def run(texts: list) -> dict:
        field = _field(weights.value)
        return {"_masked": [None if t is None else mask(t, find(t, field)[1]) for t in texts]}

    out = map_texts(docs, run, "_masked string").withColumnRenamed("_masked", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
