"""Periodic runs against brute force, and the edge cases that the docstring states."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quern.llm import runs

DOCS = "doc_id bigint, text string, runs string, n_words int, collapsed string"


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every period, every stretch: (start, length, smallest period)."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain(doc_id: int | None, text: str | None) -> tuple:
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), n)


def made(r: random.Random, n: int, letters: int) -> list[int]:
    """Repeats within repeats, and copies of earlier stretches."""
    w: list[int] = []
    while len(w) < n:
        kind = r.random()
        if kind < 0.4 or not w:
            w += [r.randrange(letters) for _ in range(r.randint(1, 20))]
        elif kind < 0.8:
            s = r.randrange(len(w))
            w += (w[s : s + r.randint(1, 30)] * r.randint(1, 12))[: r.randint(1, 120)]
        else:
            s = r.randrange(len(w))
            w += w[s : s + r.randint(1, 150)]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 50])
def test_runs_are_those_of_brute_force(letters):
    r = random.Random(letters)
    for _ in range(300):
        w = made(r, r.choice([20, 60, 120, 300]), letters)
        assert runs.runs_of(w) == brute(w) == runs.searched([b"w%d" % x for x in w])


def test_factors_are_the_longest_that_start_earlier():
    r = random.Random(3)
    for _ in range(100):
        w = made(r, 40, 3)
        cut = runs.Automaton(w).factors(w)
        assert [a for a, _, _ in cut] == [0, *[e for _, e, _ in cut[:-1]]] and cut[-1][1] == len(w)
        for b, e, source in cut:
            longest = max((k for k in range(len(w) - b + 1) if any(w[j : j + k] == w[b : b + k] for j in range(b))), default=0)
            assert e - b == max(1, longest) and (w[source : source + e - b] == w[b:e] if longest else source == -1)


def test_long_sequences_take_time_in_proportion():
    r = random.Random(1)
    for w in ([0] * 100_000, [i % 7 for i in range(100_000)], [i % 30_000 for i in range(100_000)]):
        found = runs.runs_of(w)
        assert found == [(0, 100_000, len(set(w)))]
    assert runs.runs_of([r.randrange(4) for _ in range(20_000)]) == []


def test_digests_are_the_plain_ones(spark):
    r = random.Random(9)
    texts = [None, "", " \t\n", "a " * 24, "a " * 23, "a\xa0b c\x1cd " * 30, "x y\tz\n" * 9 + "x", "tail " * 50 + "!"]
    texts += [" ".join(f"w{x}" for x in made(r, r.choice([5, 30, 200, 900]), r.choice([2, 4, 40, 900]))) for _ in range(150)]
    ids = [None, *range(1, len(texts))]
    docs = spark.createDataFrame([(i, t, "r", 1, "c") for i, t in zip(ids, texts, strict=True)] + [(4, "a " * 23, "r", 1, "c")] * 2, DOCS)
    got = sorted((tuple(x) for x in runs.digests(runs.runs(runs.repeated(docs))).collect()), key=str)
    want = sorted([plain(i, t) for i, t in zip(ids, texts, strict=True)] + [plain(4, "a " * 23)] * 2, key=str)
    assert got == want
    assert sum(1 for i in ids if zlib.crc32(str(i).encode()) % 10 == 0) > 5 and sum(x[1] for x in want) > 50


def test_a_very_long_text(spark):
    text = "one two three " * 60_000 + " ".join(f"v{i}" for i in range(60_000))
    row = runs.runs(spark.createDataFrame([(1, text, "r", 1, "c")], DOCS)).collect()[0]
    assert [tuple(x) for x in row.runs] == [(0, 180_000, 3)] and row.n_words == 240_000 and row.collapsed.startswith("one two three v0 v1")


def test_equal_ratios_go_to_the_first_and_empty_tables_stay_empty(spark):
    text = "a b " * 12 + "stop " + "c d " * 12
    row = runs.digests(runs.runs(spark.createDataFrame([(1, text, "r", 1, "c")], DOCS))).collect()[0]
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 24, 2, 12_000)
    assert runs.digests(runs.runs(runs.repeated(spark.createDataFrame([], DOCS)))).count() == 0
