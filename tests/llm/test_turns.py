"""Structure repair of conversations against a search over all edits, and the edge cases that the docstring states."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from quern.llm import turns

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, fault string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def searched(rows: list[tuple[str, str]], faults: list[str | None]) -> tuple[int, str, str]:
    """(cost, audit, repaired) by trying every edit at every turn: the least suffix of (cost, audit) for each state."""

    @functools.cache
    def best(i: int, last: str, inserted: int) -> tuple[int, str, tuple[str, ...]]:
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role, to in (("user", "u"), ("assistant", "a")):
                if (last in ("", "s", "a")) == (to == "u"):
                    cost, audit, lines = best(i, to, inserted + 1)
                    found.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            cost, audit, lines = best(i + 1, last, 0)
            found.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for role, price, name in ((rows[i][0], 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    to = role[:1]
                    if to == "s" and last == "" or to == "u" and last in ("", "s", "a") or to == "a" and last == "u":
                        cost, audit, lines = best(i + 1, to, 0)
                        found.append((cost + price + more, name + audit, (f"{role}:{rows[i][1]}", *lines)))
        return min(found, key=lambda x: x[:2], default=(1 << 30, "", ()))

    cost, audit, lines = best(0, "", 0)
    return cost, audit, "\n".join(lines)


def plain(rows: list[tuple]) -> dict:
    """What the contract says of one conversation's (turn, role, text) rows after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64].encode(), hashlib.sha256(x[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = BLANK.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    cost, audit, text = searched([x[1:] for x in rows], faults)
    letters = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + z not in ("su", "ua", "au") for a, z in zip(letters, letters[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def conversations(r: random.Random, n: int, most: int) -> list[tuple]:
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "U", "", None, "ultra", "sys"]
    texts = ["Hello.", "yes?", "no!", "well", " ", "", None, "One. Two", "\t\n", "x\xa0", "Right. ", "é"]
    rows = []
    for conv in [*range(n), None]:
        turn = r.randint(-2, 3)
        for _ in range(r.randint(0, most)):
            rows.append((conv, turn if r.random() < 0.95 else None, r.choice(roles[:6] if r.random() < 0.7 else roles), r.choice(texts[:4] if r.random() < 0.7 else texts)))
            turn += r.choice([0, 1, 1, 1, 1, 2, 5])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "f") for x in rows], TURNS)


def test_edits_are_the_cheapest_and_least():
    r = random.Random(2)
    for _ in range(1500):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), "t") for _ in range(r.randint(0, 9))]
        faults = [r.choice([None, None, None, "truncated", "blank", "duplicate"]) for _ in rows]
        coded = [(-1 if f in ("blank", "duplicate") else turns.ROLES.index(role) if role in turns.ROLES else 0, 3 if f == "truncated" else 0) for (role, _), f in zip(rows, faults, strict=True)]
        done, end = turns.edits(coded, turns.START, None)
        at, _ = turns.solved(coded, (turns.START,))
        audit = "".join(turns.LETTERS[x] for _, x in done) + "I" * len(turns.ENDS[end])
        assert (at[turns.START, end][0] + 3 * len(turns.ENDS[end]), audit) == searched(rows, faults)[:2]


def test_pieces_make_the_same_as_the_whole():
    r = random.Random(4)
    for _ in range(400):
        coded = [(r.choice([-1, 0, 1, 2, 2, 3, 3]), r.choice([0, 0, 3])) for _ in range(r.randint(1, 40))]
        cuts = sorted({0, len(coded), *[r.randint(0, len(coded)) for _ in range(r.randint(0, 6))]})
        pieces = [coded[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        roles = turns.between([{k: x[:2] for k, x in turns.solved(p, (0, 1, 2, 3))[0].items()} for p in pieces])
        parts = [turns.edits(p, a, z)[0] for p, a, z in zip(pieces, roles, roles[1:], strict=False)]
        whole, end = turns.edits(coded, 0, None)
        assert [x[1] for x in sum(parts, [])] == [x[1] for x in whole] and roles[-1] == end


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_reports_are_the_plain_ones(spark, monkeypatch, bits):
    """With blocks of 2 and 8 rows most conversations are cut."""
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    rows = conversations(random.Random(bits), 60, 14)
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in turns.reports(table(spark, rows), turns.damaged(table(spark, rows))).collect()}
    hurt = damage(rows)
    assert found == {c: plain([x[1:] for x in hurt if x[0] == c]) for c in {x[0] for x in rows}}


def test_edits_are_rows_with_their_texts(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hi."), (1, 3, "assistant", "Hi."), (1, 4, "user", " ")]
    got = [(r.role, r.fault, r.edit, r.becomes, r.text) for r in sorted(turns.repaired(table(spark, rows)).collect(), key=lambda r: (r.place, r.step))]
    assert got == [
        ("system", None, "keep", "system", "Be kind."), (None, None, "insert", "user", ""), ("assistant", None, "keep", "assistant", "Hi."),
        ("assistant", "duplicate", "delete", None, "Hi."), ("user", "blank", "delete", None, " "),
    ]


def test_one_long_conversation_and_very_long_texts(spark):
    roles = ["user", "assistant"]
    rows = [(7, i, roles[i % 2] if i % 11 else "tool", f"turn {i}.") for i in range(30_000)] + [(8, 0, "user", "x" * 500_000), (8, 1, "assistant", "y." * 200_000)]
    got = {r.c: r for r in turns.digests(turns.repaired(table(spark, rows))).collect()}
    assert len(got[7].audit) == 30_000 and got[7].cost == 3 * len([i for i in range(30_000) if i % 11 == 0]) and got[7].truncated == got[7].gaps == 0
    text = "\n".join(f"{roles[i % 2]}:turn {i}." for i in range(30_000))
    assert got[7].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (got[8].audit, got[8].truncated) == ("KK", 1)


def test_many_equal_rows(spark):
    got = turns.digests(turns.repaired(table(spark, [(1, None, "user", "Same.")] * 20_000))).collect()[0]
    assert (got.duplicate, got.gaps, got.cost, got.audit) == (19_999, 0, 4 * 19_999 + 3, "K" + "D" * 19_999 + "I")


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    one = table(spark, [(gone, 1, "user", "Hi.")])
    row = turns.reports(one, turns.damaged(one)).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], TURNS)
    assert turns.reports(none, turns.damaged(none)).count() == 0 and turns.repaired(none).count() == 0
