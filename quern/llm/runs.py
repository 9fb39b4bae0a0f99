"""Periodic run detection after Kolpakov and Kucherov, on the words of whole texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of
max(LEAST, 3 * q) words or more that no neighbouring word extends with the same period.  Words are the stretches
without ASCII blanks (space, tab to carriage return), so other spaces belong to words.

All runs of a sequence come from its factors, each the longest stretch that also starts earlier (or a new word):
a suffix automaton with the first end of each state gives the factors; Main's algorithm finds the runs that cross or touch
the start of a factor, from the longest common extensions around it; a run strictly inside a factor stands likewise in
the factor's earlier occurrence, from which it is copied.  Time is in proportion to the words.

Most texts have no run at all, so the sequences are cut down first, without loss: each GRAM words within a run stand a
period further or before in the same run (3 * q and LEAST make room for that), so a run lies within one stretch of
positions whose GRAM words occur twice in the text.  Only such stretches, LEAST words or more, are factorised.

A text is one row, whose runs and words one task holds; tasks share nothing.  A null text has no words, and with no
words or fewer than LEAST there are no runs.  Null and repeated ids are rows like others, equal texts get equal values,
extra columns are left out, an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, blocks, table

#: The least length of a run in words, and the least in periods.
LEAST, TIMES = 24, 3
#: So many words are hashed together to find what occurs twice; with q < GRAM, 2 * q + GRAM - 1 words must fit in LEAST.
GRAM = 8
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of numbers from 0, with the first end of each state's words.

    Most states have one way out, held in two arrays; those with more have a dict.
    """

    def __init__(self, w: Sequence[int]) -> None:
        self.letter, self.to, self.more = array("q", [-1]), array("q", [0]), {}
        self.end = array("q", [0])
        letter, to, more, end = self.letter, self.to, self.more, self.end
        length, link = array("q", [0]), array("q", [-1])
        last = 0
        for i, c in enumerate(w):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            end.append(i + 1)
            letter.append(-1)
            to.append(0)
            p, q = last, -1
            last = new
            while p >= 0:
                if letter[p] == c:
                    q = to[p]
                    break
                if letter[p] < 0:
                    letter[p], to[p] = c, new
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: new}
                    elif c in ways:
                        q = ways[c]
                        break
                    else:
                        ways[c] = new
                p = link[p]
            if q < 0:
                continue
            if length[p] + 1 == length[q]:
                link[new] = q
                continue
            copy = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            end.append(end[q])
            letter.append(letter[q])
            to.append(to[q])
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0:
                if letter[p] == c:
                    if to[p] != q:
                        break
                    to[p] = copy
                else:
                    ways = more.get(p)
                    if ways is None or ways.get(c) != q:
                        break
                    ways[c] = copy
                p = link[p]
            link[q] = link[new] = copy

    def factors(self, w: Sequence[int]) -> list[tuple[int, int, int]]:
        """(start, end, earlier start, or -1 for a new word) of each factor."""
        letter, to, more, end = self.letter, self.to, self.more, self.end
        out, start, n = [], 0, len(w)
        while start < n:
            state, at = 0, start
            while at < n:
                c = w[at]
                ahead = to[state] if letter[state] == c else more[state][c]
                if end[ahead] > at:  # it ends here for the first time
                    break
                state, at = ahead, at + 1
            if at == start:
                out.append((start, start + 1, -1))
                start += 1
            else:
                out.append((start, at, end[state] - (at - start)))
                start = at
        return out


def prefixes(s: Sequence[int]) -> np.ndarray:
    """For each position, how many numbers from there on equal those at the start of s (the Z function)."""
    n = len(s)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        left, right = i, i + k
        out[i] = k
    return np.array(out, np.int64)


def around(w: list[int], at: int, before: int, after: int) -> Iterator[Run]:
    """(start, end, period) of stretches that cross or touch position `at`, seen over so many words before and after it."""
    t, v = w[at - before : at], w[at : at + after]
    rt, rv = t[::-1], v[::-1]
    forth, back = prefixes([*v, -1, *t, *v]), prefixes([*rt, -1, *rv, *rt])
    # a period to the left of it: words at - p and at, then those on
    p = np.arange(1, before + 1)
    on, off = forth[after + 1 + before - p], np.append(back[1:before], 0)[:before]
    for i in np.flatnonzero((on + off >= (TIMES - 1) * p) & (on + off + p >= LEAST)).tolist():
        yield at - int(off[i]) - i - 1, at + int(on[i]), i + 1
    # and to the right
    p = np.arange(1, after + 1)
    on, off = np.append(forth[1:after], 0)[:after], back[before + 1 + after - p]
    for i in np.flatnonzero((on + off >= (TIMES - 1) * p) & (on + off + p >= LEAST)).tolist():
        yield at - int(off[i]), at + i + 1 + int(on[i]), i + 1


def runs_of(w: list[int]) -> list[Run]:
    """(start, length, period) of all runs of a sequence of numbers from 0, by start, then period."""
    n = len(w)
    cut = Automaton(w).factors(w)
    found: dict[tuple[int, int], int] = {}
    ahead = [*cut, (n, n, -1)]
    for (c, b, _), (_, e, _) in zip(cut, ahead[1:], strict=True):
        # a run that ends within [b, e) starts less than 2 * (b - c) + (e - b) words before b, or the factor at c were longer
        before, after = min(b, 2 * (b - c) + (e - b)), e - b
        if before + after < LEAST:
            continue
        for start, end, p in around(w, b, before, after):
            # what goes on beyond what was seen is another factor's
            if (start == 0 or w[start - 1] != w[start - 1 + p]) and (end == n or w[end] != w[end - p]) and p < found.get((start, end), n):
                found[start, end] = p
    order = sorted(found)
    for b, e, source in cut:
        if source < 0 or e - b < LEAST + 2:
            continue
        k = bisect.bisect_left(order, (source + 1, 0))
        while k < len(order) and order[k][0] < source + e - b:
            start, end = order[k]
            moved = (start + b - source, end + b - source)
            if moved[1] < e and moved not in found:
                found[moved] = found[start, end]
                bisect.insort(order, moved)
            k += 1
    return sorted((start, end - start, p) for (start, end), p in found.items())


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs."""
    n = len(words)
    if n < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    by, step = 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] + np.uint64(by) * h[step:]
        by, step = by * by % (1 << 64), step * 2
    cells = 1 << (4 * n).bit_length()
    at = (h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    twice = np.bincount(at, minlength=cells)[at] > 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8))).reshape(-1, 2)
    return [(a, z + GRAM - 1) for a, z in edges[edges[:, 1] - edges[:, 0] > LEAST - GRAM].tolist()]


def searched(words: list[bytes]) -> list[Run]:
    """(start, length, period) of all runs of the words, by start, then period."""
    out = set()
    for a, z in stretches(words):
        names: dict[bytes, int] = {}
        for start, length, p in runs_of([names.setdefault(x, len(names)) for x in words[a:z]]):
            out.add((a + start, length, p))
    return sorted(out)


def kept(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    stays = np.ones(len(words), bool)
    for start, length, p in found:
        stays[start + p : start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs by start and period, and collapsed: the kept words joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for ids, texts in blocks(iter([batch])):
                out: dict[str, list] = {"doc_id": ids, "n_words": [], "runs": [], "collapsed": []}
                for text in texts:
                    words = (text or "").encode().split()
                    found = searched(words)
                    out["n_words"].append(len(words))
                    out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    out["collapsed"].append(b" ".join(kept(words, found)).decode())
                yield out

    return arrow_map(docs.select("doc_id", "text"), work, SCHEMA)


# -- the query


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text, with every tenth text's words from a on replaced by repeats of the p words that start there.

    The checksum of the id as text chooses texts, a and p; a null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size("words")
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    hit = hit.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    hit = hit.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return hit.select("doc_id", F.coalesce(F.when(a.isNotNull(), text), F.col("text")).alias("text"))


def strongest(found: Column) -> Column:
    """The run of greatest length / period, exactly; of equal ones the first in the array."""

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def digests(found: DataFrame) -> DataFrame:
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(runs(repeated(table(spark, sf_dir, "documents"))))
