"""Operator 4, byte-level BPE: a backtracking encoder over longest token matches, and decoding by an offset table.

Encoding works on the pieces of the pre-tokeniser's pattern. A piece's bytes are cut from left to right: at each place the longest
vocabulary entry that matches there is tried (found by one pass of an Aho-Corasick automaton of the reversed vocabulary over the reversed
piece), and kept if it is compatible with the token before it. Two tokens are compatible if merging their joined bytes by rank would
leave exactly these two; a walk back through the merges decides that, and a table keeps the answer. If no match fits, the encoder takes back one token and tries its next shorter prefix. A bit field of places that are
known dead ends keeps the time linear. The result equals merging by rank.

Decoding concatenates the vocabulary's bytes into one array with an offset for each id, and gathers.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, map_texts, read

#: Pre-tokeniser of the byte-level vocabularies (fixed value of that public format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 only, with the classes spelt out and the commonest case first (fixed values: letters, numbers, white space).
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PIECES = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Pairs in the compatibility table at most; a worker that meets more begins it anew.
TABLE_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary: ``encode`` texts to ids, ``decode`` ids to text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(self.bytes_of) + 1
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(size)])))
        # merge rank of a pair and of the token it makes; what a token was merged from
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            whole = self.ids[a + b]
            self.rank.setdefault((self.ids[a], self.ids[b]), (r, whole))
            self.parts.setdefault(whole, (self.ids[a], self.ids[b]))
        self.made_at = {t: self.rank[p][0] for t, p in self.parts.items()}
        # automaton over reversed tokens: its match ending at a place of the reversed piece is the match that starts there
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        # the next shorter token that is a prefix of a token
        self.shorter: dict[int, int] = {}
        for b, i in self.ids.items():
            self.shorter[i] = next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1)
        self.length = {i: len(b) for b, i in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.find_any, self.find_latin = regex.compile(PIECES).findall, re.compile(LATIN_PIECES).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves just a and b. Kept in a table of the pairs met."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= TABLE_PAIRS:
                self.fits.clear()
            found = self.fits[(a, b)] = self._unmerged(a, b)
        return found

    def _unmerged(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' merges step by step; a merge across the border that comes earlier than it is a conflict."""
        limit = 1 << 60
        while True:
            crossing = self.rank.get((a, b))
            if crossing is not None and crossing[0] < limit:
                return False
            ra, rb = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # equal ranks merge from the left, so the right token's merge came later
            if ra > rb:
                limit = ra
                a = self.parts[a][1]
            else:
                limit = rb + 1
                b = self.parts[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenised piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end  # the longest match is reported first
            if longest[at] < 0 or self.length[token] > self.length[longest[at]]:
                longest[at] = token
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while True:
            step = at + self.length[token] if token >= 0 else -1
            if token >= 0 and alive[step] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = step
                if at == n:
                    return out
                token = longest[at]
                continue
            if token >= 0:
                token = self.shorter[token]
            if token < 0:
                alive[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]

    def piece_key(self, piece: str) -> tuple[str, bytes]:
        """Decimal ids of a piece joined by commas, and the ids as little-endian 32-bit numbers; kept for the next time."""
        ids = self.piece(piece.encode("utf-8", "surrogatepass"))
        if len(self.known) > 600_000:
            self.known.clear()
        found = self.known[piece] = (",".join(map(str, ids)), np.array(ids, "<u4").tobytes())
        return found

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def _pieces(self, text: str) -> list[tuple[str, bytes]]:
        known, make, out = self.known, self.piece_key, []
        parts = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                i = self.special[part]
                out.append((str(i), np.array([i], "<u4").tobytes()))
            else:
                out += [known.get(p) or make(p) for p in self.find(part)]
        return out

    def encode_both(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the ids as little-endian 32-bit numbers."""
        found = self._pieces(text)
        return ",".join([a for a, _ in found]), b"".join([b for _, b in found])

    def encode_bytes(self, text: str) -> bytes:
        return b"".join([b for _, b in self._pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        lo = self.offset[ids]
        n = self.offset[ids + 1] - lo
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; null and empty texts have no ids. Columns besides these two are ignored."""

    def run(texts: list) -> dict:
        bpe = load(path)
        return {"ids": [np.frombuffer(bpe.encode_bytes(t or ""), "<u4").astype(np.int32) for t in texts]}

    return map_texts(id_text(docs, id_col, text_col), run, "ids array<int>")


def decode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each id list; a null list counts as empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again.

    Null texts count as empty, rows that repeat an id each get a row, an empty table gives an empty result.
    """

    def run(texts: list) -> dict:
        bpe, out = load(path), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            decimal, raw = bpe.encode_both(t or "")
            out["n_tokens"].append(len(raw) // 4)
            out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
            back = bpe.decode(np.frombuffer(raw, "<u4"))
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        return out

    return map_texts(id_text(docs, id_col, text_col), run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path())
