"""Operator 6, main text of web pages: page structure, and suffix arrays over the pages of a host.

A page is cut into blocks of text. Blocks inside elements that never hold the article (navigation, page header and footer, asides,
adverts, notices, forms, comments, scripts) are dropped. Blocks inside an article or main element are kept whole: the same article may
stand on many pages, so repetition tells nothing there. All other blocks are doubtful. Of these, long token runs and whole blocks that
stand on several distinct pages of the host are removed, and what is unique to a page stays.

Suffix arrays (prefix doubling) over the doubtful blocks at hand in a task group the places where equal runs begin, and give out each
run once with its hash. The pages a run stands on are counted over the whole host by a shuffle on these hashes, so the rule is the
same for a host of any size and no task gets a whole large host. Pages of the same text count once: copies of a page don't make its
text boilerplate.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, keep, map_texts, read, slices

#: Tokens of a run (shorter blocks count whole), and distinct pages of the host it stands on, to count as boilerplate.
RUN_TOKENS, RUN_PAGES = 24, 3
#: Characters whose runs are found at once, and rows given out at once.
RUN_CHARS, RUN_ROWS = 1 << 18, 50_000

# Elements of HTML by their role (fixed values).
RAW = "script style noscript template textarea title svg math iframe object canvas audio video"
NEVER = "head nav footer aside form menu dialog button select option label fieldset input"
VOID = "area base br col embed hr img input link meta source track wbr"
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
# Words in class, id or role that name a part of a page other than its article (fixed values).
PARTS = (
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
)
_RAW, _NEVER, _VOID, _BLOCK, _PARTS = (frozenset(x.split()) for x in (RAW, NEVER, VOID, BLOCK, PARTS))
# Raw elements that may close themselves; the others' slash means nothing.
SELF_CLOSED = "svg math iframe object canvas audio video"
# Attributes end at an angle bracket outside quotes, so that a tag that is never closed costs no second look at what follows it.
_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^<>]*>"
    rf"|<(?:{'|'.join(SELF_CLOSED.split())})\b{_INSIDE}(?<=/)>"
    rf"|<({'|'.join(sorted(_RAW))})\b{_INSIDE}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*)({_INSIDE})>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.S | re.I,
)
# Parts that are made of articles of their own, which are not the page's.
_OTHERS = frozenset("comment comments disqus related replies reply respond".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def _other_part(name: str, attributes: str, inside: bool) -> str:
    """"never" for an element that is a part of the page other than the article, "named" for one that its attributes call so and that may
    still be a wrapper of the article, else "". Names are whole words of class, id or role. An article's own header is part of it."""
    if name != "form" and (name in _NEVER or (name == "header" and not inside)):
        return "never"
    if name == "form":  # some sites put the whole page into a form
        return "named"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    names: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.update(value.lower().split())
        hidden |= key == "hidden" or (key == "style" and bool(_NONE.search(value))) or (key == "aria-hidden" and value.strip().lower() == "true")
    if names & _OTHERS:
        return "never"
    return "named" if hidden or names & (_PARTS - {"header"} if inside else _PARTS) else ""


def page_blocks(page: str) -> list[tuple[str, bool]]:
    """(text, whether inside an article or main element) of each block, in page order, references decoded and white space made single."""
    found: list[tuple[list[tuple[str, tuple[int, ...]]], bool]] = []  # pieces, each with the wrappers around it; inside the article
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # name, inside another part, inside the article, wrappers around it
    holding: set[int] = set()  # wrappers that hold an article or main element
    parts: list[tuple[str, tuple[int, ...]]] = []
    at = 0

    def flush() -> None:
        if parts:
            found.append((parts.copy(), bool(stack and stack[-1][2])))
            parts.clear()

    def put(text: str) -> None:
        parts.append((text, stack[-1][3] if stack else ()))

    for m in _MARKUP.finditer(page):
        if m.start() > at and not (stack and stack[-1][1]):
            put(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], (m[4] or m[7] or "")
        if name in _BLOCK:
            flush()
        elif name == "br":
            put(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in _VOID and not attributes.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # a new one ends an open one of its kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "main", "nav", "footer", "aside", "header", "form"):
                        break
            skip, inside, around = stack[-1][1:] if stack else (False, False, ())
            if name == "body":
                stack.clear()
                skip, inside, around = False, False, ()
            if name in ("article", "main"):
                if not skip:
                    holding.update(around)
                inside = True
            part = _other_part(name, attributes, inside)
            if part == "named" and not skip:
                around = (*around, m.start())
            stack.append((name, skip or part == "never", inside, around))
    if at < len(page) and not (stack and stack[-1][1]) and "<" not in page[at : at + 1]:
        put(page[at:])
    flush()
    texts = ((" ".join(html.unescape("".join(t for t, around in pieces if holding.issuperset(around))).split()), sure) for pieces, sure in found)
    return [(text, sure) for text, sure in texts if text]


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(blocks of article and main elements, doubtful blocks), in page order."""
    found = page_blocks(page)
    return [t for t, sure in found if sure], [t for t, sure in found if not sure]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order, by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    h = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - h] = rank[h:] if h < n else after[:0]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = new
        h *= 2
        if h >= n or rank.max() == n - 1:
            return order


def runs(found: list[list[str]], run: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(page, first token in the page, tokens, hash) of every run of ``run`` tokens inside a block, and of every whole block of fewer.

    Equal runs get equal hashes: a suffix array groups the places, and one place of each group is hashed.
    """
    words = [b.split(" ") for page in found for b in page]
    sizes = np.array([len(w) for w in words], np.int64)
    pages = np.repeat(np.arange(len(found)), [len(page) for page in found])
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    names: dict[str, int] = {}
    flat = [w for ws in words for w in ws]
    # every block ends with a token below all words, so no run crosses blocks and equal short blocks share their end too
    tokens = np.insert(np.array([names.setdefault(w, len(names)) for w in flat], np.int64), np.cumsum(sizes), -1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(tokens)
    block = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(tokens)) - starts[block]
    begins = (offset == 0) | (offset + run <= sizes[block])
    begins &= tokens >= 0
    length = np.minimum(run, sizes[block])
    order = order[begins[order]]
    # neighbours in the order that agree up to their runs' ends; the end itself tells a whole block from the start of a longer one
    same = length[order[1:]] == length[order[:-1]]
    for k in range(run):
        a, b = order[:-1] + k, order[1:] + k
        inside = k < length[order[:-1]]
        same &= ~inside | (tokens[np.minimum(a, len(tokens) - 1)] == tokens[np.minimum(b, len(tokens) - 1)])
    group = np.concatenate(([0], np.cumsum(~same)))
    firsts = order[np.concatenate(([True], ~same))]
    where = firsts - block[firsts]  # the ends are not in ``flat``
    hashes = [hashlib.blake2b(" ".join(flat[w : w + n]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for w, n in zip(where.tolist(), length[firsts].tolist())]
    before = np.cumsum(sizes) - sizes
    head = np.concatenate(([0], np.cumsum([len(page) for page in found])))[:-1]
    base = np.concatenate((before, [0]))[np.minimum(head, len(before))]  # the page's first token in ``flat``
    page = pages[block[order]]
    return page, before[block[order]] + offset[order] - base[page], length[order], [hashes[g] for g in group]


def _unique_runs(found: list[str], sure: list[bool], covered: np.ndarray) -> list[str]:
    """A page's sure blocks and what is unique of its doubtful ones, in page order. ``covered`` marks tokens of the doubtful blocks."""
    out, at = [], 0
    for b, whole in zip(found, sure):
        if whole:
            out.append(b)
            continue
        words = b.split(" ")
        keep = [w for w, c in zip(words, covered[at : at + len(words)]) if not c]
        at += len(words)
        if keep:
            out.append(" ".join(keep))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without article text, have an empty text. Pages that repeat an id each get a row; pages with a null or
    odd url share one nameless host. An empty table gives an empty result; columns besides the three are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))

    def whole(texts: list) -> dict:
        found = [page_blocks(t or "") for t in texts]
        return {"body": ["\n".join(b for b, _ in f) for f in found], "open": [not all(sure for _, sure in f) for f in found]}

    def parts(texts: list) -> dict:
        found = [page_blocks(t or "") for t in texts]
        found = [[] if all(sure for _, sure in f) else f for f in found]
        return {"blocks": [[b for b, _ in f] for f in found], "sure": [[sure for _, sure in f] for f in found]}

    sure = map_texts(rows, whole, "body string, open boolean").where("not open").select("page_id", "url", F.col("body").alias("text"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    doubtful = map_texts(rows, parts, "blocks array<string>, sure array<boolean>").where(F.size("blocks") > 0)
    doubtful = keep(doubtful.withColumn("host", host).withColumn("row", F.monotonically_increasing_id()), "doubtful")
    opened = F.transform(F.filter(F.arrays_zip("blocks", "sure"), lambda b: ~b["sure"]), lambda b: b["blocks"])
    page = doubtful.select("row", F.xxhash64("blocks").alias("page"), "host", opened.alias("open"))

    def found_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3).to_pylist()
            for lo, hi in slices([sum(map(len, x)) for x in lists], RUN_CHARS):
                owner, at, n, digest = runs(lists[lo:hi])
                for i in range(0, len(owner), RUN_ROWS):  # lots of rows bound the memory of a batch
                    o = pa.array(owner[i : i + RUN_ROWS] + lo)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(o) for k in range(3)), pa.array(at[i : i + RUN_ROWS]), pa.array(n[i : i + RUN_ROWS]), pa.array(digest[i : i + RUN_ROWS], pa.binary())], ["row", "page", "host", "at", "n", "digest"])

    every = page.mapInArrow(found_runs, "row bigint, page bigint, host string, at bigint, n bigint, digest binary")
    every = keep(every.select("row", "page", "at", "n", F.xxhash64("host", "digest").alias("run")), "runs")
    spread = every.groupBy("run", "page").agg(F.count("*").alias("n_rows")).groupBy("run").agg(F.count("*").alias("n_pages"), F.sum("n_rows").alias("n_rows")).where(F.col("n_pages") >= RUN_PAGES)
    hits = join_groups(every, keep(spread.select("run", "n_rows"), "repeated"), "run", "n_rows", every.count())
    marks = hits.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("marks"))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for found, sures, spans in zip(*(b.column(c).to_pylist() for c in ("blocks", "sure", "marks"))):
                covered = np.zeros(sum(x.count(" ") + 1 for x, s in zip(found, sures) if not s), bool)
                for span in spans or ():
                    covered[span["at"] : span["at"] + span["n"]] = True
                texts.append("\n".join(_unique_runs(found, sures, covered)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rest = doubtful.join(marks, "row", "left").select("page_id", "url", "blocks", "sure", "marks").mapInArrow(unique, "page_id bigint, url string, text string")
    return sure.unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
