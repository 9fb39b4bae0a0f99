"""Byte-level BPE by a pair occurrence index, and its decoding.

A text is cut into pieces by the tokenizer's pattern; a special token's text is one id.  The distinct new pieces of a
block lie one after the other in one array of symbols.  The index maps the rank of each mergeable pair to all its
positions there.  Ranks are taken in ascending order while any is active: all occurrences of the pair are merged at
once (of overlapping ones the left first), and only the pairs beside them are looked up and put into the lists of
their own, always higher, ranks.  Decoding joins the ids' bytes and reads them as UTF-8 (bad bytes: U+FFFD).

Null texts count as empty; an empty text has no ids, and the digests of nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, blocks, table

#: Pieces whose ids a worker remembers between blocks, and characters of those that it does.
KNOWN_PIECES, KNOWN_CHARS = 60_000, 64
END = -1
#: Characters of texts whose new pieces are merged together.
BLOCK = 2 << 20
#: Texts of these characters alone are cut by the standard library's faster engine; its classes below are those of the
#: pattern within them (letters up to U+024F, digits with superscripts and fractions).
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")
PLAIN_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "| ?[^ \t\n\r0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
    "|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for the bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file: its pieces' pattern, merges by pair, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in byte.items():
            self.of_byte[b] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.piece = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, END where it can't be merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], END)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def not_overlapping(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which of the ascending positions stay if each that directly follows a kept one goes."""
    step = np.arange(len(at))
    begins = np.maximum.accumulate(np.where(follows, 0, step))
    return (step - begins) % 2 == 0


def merge_all(pieces: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after the other, and how many each has."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = len(raw)
    symbol = np.append(voc.of_byte[raw], END)  # the last place stands for any end
    owner = np.append(np.repeat(np.arange(len(pieces)), sizes), END)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = n
    before[(ends - sizes[sizes > 0])] = n
    after[n] = before[n] = n
    alive = np.ones(n + 1, bool)
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enlist(at: np.ndarray) -> None:
        """Puts the pairs that begin at these positions into the lists of their ranks."""
        at = at[(at < n) & (after[at] < n)]
        rank = voc.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank != END], rank[rank != END]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist(), len(rank)]
        for r, i, j in zip(rank[starts[:-1]].tolist() if len(rank) else (), starts, starts[1:], strict=False):
            if r in lists:
                lists[r].append(at[i:j])
            else:
                lists[r] = [at[i:j]]
                heapq.heappush(active, r)

    enlist(np.arange(n))
    while active:
        r = heapq.heappop(active)
        found = lists.pop(r)
        at = np.concatenate(found) if len(found) > 1 else found[0]
        a, b = voc.left[r], voc.right[r]
        at = at[alive[at] & (symbol[at] == a) & (symbol[after[at]] == b)]  # else an earlier merge has taken a part
        if len(at) > 1:
            at.sort()
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if a == b and len(at) > 1:
            at = at[not_overlapping(at, np.concatenate(([False], after[at[:-1]] == at[1:])))]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = voc.made[r]
        alive[gone] = False
        nxt = after[gone]
        after[at] = nxt
        inner = nxt < n
        before[nxt[inner]] = at[inner]
        enlist(np.concatenate((before[at], at)))
    kept = np.flatnonzero(alive[:n])
    return symbol[kept], np.bincount(owner[kept], minlength=len(pieces))


class Encoder:
    """Encodes texts.  Of each piece it keeps what `form` makes of its ids, up to KNOWN_PIECES of them."""

    def __init__(self, voc: Vocabulary, form: Callable[[list[int]], object] = tuple) -> None:
        self.voc, self.form = voc, form
        self.known: dict[str, object] = {}
        self.long: list[str] = []

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return merge_all([p.encode("utf-8", "surrogatepass") for p in pieces], self.voc)

    def plain_pieces(self, text: str) -> list[str]:
        return PLAIN_PIECE.findall(text) if PLAIN.fullmatch(text) else self.voc.piece.findall(text)

    def pieces(self, text: str) -> list[str]:
        if self.voc.cut is None or not any(s in text for s in self.voc.special):
            return self.plain_pieces(text)
        return [p for part in self.voc.cut.split(text) for p in ([part] if part in self.voc.special else self.plain_pieces(part))]

    def block(self, texts: list[str | None]) -> Iterator[list]:
        """What is kept of each piece of each text, a text at a time; to be used up before the next block."""
        same: dict[str, str] = {}  # equal pieces are held as one string
        cut = [list(map(same.setdefault, found, found)) for t in texts for found in [self.pieces(t) if t else []]]
        for p in self.long:
            del self.known[p]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        new = sorted(same.keys() - self.known.keys())
        del same
        self.long = [p for p in new if len(p) > KNOWN_CHARS]
        plain = [p for p in new if p not in self.voc.special]
        flat, sizes = self.merged(plain)
        start = 0
        for p, n in zip(plain, sizes.tolist(), strict=True):
            self.known[p] = self.form(flat[start : start + n].tolist())
            start += n
        for p in new:
            if p in self.voc.special:
                self.known[p] = self.form([self.voc.special[p]])
        return (list(map(self.known.__getitem__, c)) for c in cut)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[i for ids in text for i in ids] for text in self.block(texts)]


def decode(ids: list[int], voc: Vocabulary) -> str:
    return b"".join(map(voc.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(vocabulary(path))
        for ids, texts in blocks(batches):
            yield {"doc_id": ids, "ids": encoder.encode(texts)}

    return arrow_map(docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        voc = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield {"doc_id": part.column(0), "text": [decode(x or [], voc) for x in part.column(1).to_pylist()]}

    return arrow_map(rows.select("doc_id", "ids"), work, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text in one go, so that no ids are moved."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        voc = vocabulary(path)
        # of each piece: how many ids, the ids as text, and the bytes that they decode to
        encoder = Encoder(voc, lambda ids: (len(ids), ",".join(map(str, ids)).encode(), b"".join(map(voc.bytes.__getitem__, ids))))
        for docs_, texts in blocks(batches, most=BLOCK):
            counts, ids, texts_ = [], [], []
            for row in encoder.block(texts):
                counts.append(sum([x[0] for x in row]))
                ids.append(hashlib.sha256(b",".join([x[1] for x in row])).hexdigest())
                texts_.append(hashlib.sha256(b"".join([x[2] for x in row]).decode("utf-8", "replace").encode()).hexdigest())
            yield {"doc_id": docs_, "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts_}

    rows = docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
