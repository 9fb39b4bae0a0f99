"""Conversation structure repair: the cheapest subsequence of turns to retain, by dynamic programming.

A repaired conversation's roles begin, letter by letter, with an optional s and then ua any number of times.  Turns are kept
(cost 0), reroled to user or assistant (REROLE), deleted (DELETE), and empty user or assistant turns are inserted (INSERT).  A
turn's first fault counts: blank (only ASCII blanks), duplicate (role and text stand earlier in the conversation) and
truncated (the last other character isn't one of .!?).  Blank turns and duplicates must go; a truncated turn that stays costs
TRUNCATED more.  The cheapest repair wins, of equal ones that with the least audit, the edits' initials in order.

The recurrence runs over retained turns alone: a turn is retained in a role after an earlier one in its role, what lies
between is deleted at the difference of two prefix sums, and the two roles tell which turn is inserted.  So for each
role only the running minimum of (cost less the deletions so far) is needed.  Ties: audits that retain the same last turn
hold as many letters but inserts, and end with that turn's, so none begins another; ranks of the audits so far, renewed at
each retained turn, order them as well as the strings would.

Rows are numbered once in the order of conversation and turn, and cut into blocks of BLOCK rows, whatever the conversations'
lengths.  A conversation within one block is solved at once.  One that blocks cut is first a matrix of costs and ranks for
each piece, from last role to last role; a pass over a conversation's matrices finds the roles between pieces, and
then the pieces are solved apart, like the others.  Only `digests` meets a conversation's rows in one task, as a stream that
keeps the letters of the audit and no turn, since one checksum of the whole repaired text is asked for.

Turns are ordered by turn (nulls first), then role, then text by its first characters and a digest; repeated rows are turns of
their own.  A null role or text is taken as one space, so such a text is blank.  A null conv_id is a conversation like
any other.  Extra columns are left out.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.chat import grouped, together
from quern.llm.shared import arrow_map, in_order, table, written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Rows of a block, as a power of two.
BLOCK_BITS = 13
BLANKS = " \t\n\x0b\x0c\r"
#: How a turn can continue an audit, in the order of the letters: deleted, kept or reroled after an inserted turn, kept, reroled.
LETTERS = ("D", "IK", "IR", "K", "R")
#: Turns to insert at the end, after each last role.
ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def retentions(code: int) -> list[tuple[int, int, int, int]]:
    """(role, last role, cost, index in LETTERS) of the ways to retain a turn whose own role is `code`."""
    out = [(SYSTEM, START, 0, LETTERS.index("K"))] if code == SYSTEM else []
    for role in (USER, ASSISTANT):
        edit, price = ("K", 0) if code == role else ("R", REROLE)
        for last in range(4):
            direct = last == USER if role == ASSISTANT else last != USER
            out.append((role, last, price + (0 if direct else INSERT), LETTERS.index(edit if direct else f"I{edit}")))
    return out


RETAIN = [retentions(code) for code in range(4)]


def solved(turns: list[tuple[int, int]], begins: tuple[int, ...]) -> tuple[dict[tuple[int, int], tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """For (role before, last role) the cost, the audit's rank and the last node; and the nodes (turn, role, letter, node before).

    turns: (own role's code, cost of staying); a code below 0 must go.  Ranks hold among all pairs.
    """
    at = {(s, s): (0, 0, -1) for s in begins}
    nodes: list[tuple[int, int, int, int]] = []
    for j, (code, stay) in enumerate(turns):
        if code < 0:
            continue
        # values are costs less the deletion of all turns so far; an audit that is not continued here gets a D
        best = {k: (value, rank, 0, node, 0) for k, (value, rank, node) in at.items()}
        for role, last, cost, letter in RETAIN[code]:
            for s in begins:
                if (s, last) in at:
                    value, rank, node = at[s, last]
                    value += cost + stay - DELETE
                    held = best.get((s, role))
                    if held is None or (value, rank, letter) < held[:3]:
                        best[s, role] = (value, rank, letter, node, role)
        ranks = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        at = {}
        for k, (value, rank, letter, node, role) in best.items():
            if role:
                nodes.append((j, role, letter, node))
                node = len(nodes) - 1
            at[k] = (value, ranks[rank, letter], node)
    return {k: (value + DELETE * len(turns), rank, node) for k, (value, rank, node) in at.items()}, nodes


def cheapest_end(at: dict[int, tuple[int, int]]) -> int:
    """Of the cost and rank of each last role, the one to end with."""
    return min(at, key=lambda q: (at[q][0] + INSERT * len(ENDS[q]), at[q][1], len(ENDS[q])))


def between(pieces: list[dict[tuple[int, int], tuple[int, int]]]) -> list[int]:
    """The last role before each piece and after the last one, given each piece's costs and ranks."""
    at, came = {START: (0, 0)}, []
    for piece in pieces:
        best: dict[int, tuple] = {}
        for (s, q), (cost, rank) in piece.items():
            if s in at:
                key = (at[s][0] + cost, at[s][1], rank, s)
                if q not in best or key < best[q]:
                    best[q] = key
        ranks = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        at = {q: (b[0], ranks[b[1:3]]) for q, b in best.items()}
        came.append({q: b[3] for q, b in best.items()})
    out = [cheapest_end(at)]
    for back in reversed(came):
        out.append(back[out[-1]])
    return out[::-1]


def edits(turns: list[tuple[int, int]], begin: int, end: int | None) -> tuple[list[tuple[int, int]], int]:
    """(role or 0, index in LETTERS) of each turn on the cheapest way from role `begin` to `end`, and that end; None: the best."""
    at, nodes = solved(turns, (begin,))
    if end is None:
        end = cheapest_end({q: x[:2] for (_, q), x in at.items()})
    out, node = [(0, 0)] * len(turns), at[begin, end][2]
    while node >= 0:
        j, role, letter, node = nodes[node]
        out[j] = (role, letter)
    return out, end


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place, fault: the turns in order; `place` rises with conversation and turn."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})
    placed = written(in_order(rows, ["conv_id", "turn", "role", "head", "digest"]).drop("head"), "turns")
    placed = placed.withColumn("place", F.shiftleft(F.col("quern_part").cast("bigint"), 33) + F.col("quern_within")).drop("quern_part", "quern_within")
    # the first of each role and text, where there are several: few, and one for each key however many rows have it
    again = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    rows = placed.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    rest = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(rest == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def repaired(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, place, step, turn, role, text, fault, edit, becomes: a row for each edit.

    Ordered by place and step, a conversation's rows are its edits; `edit` is keep, rerole, delete or insert, `becomes` the role
    in the repaired conversation (NULL where deleted), role and turn are NULL where inserted.
    """
    kind = next(t for c, t in turns.dtypes if c == "conv_id")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), -1).when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    stay = F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    rows = marked(turns).withColumns({"block": F.shiftright("place", BLOCK_BITS), "code": code, "stay": stay})

    # a conversation that blocks cut; a block cuts two at most
    pieces = rows.select("conv_id", "block").distinct()
    cut = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, block, _, code, stay in grouped(batches, 2):
            at, _ = solved(list(zip(code, stay, strict=True)), (START, SYSTEM, USER, ASSISTANT))
            yield {"conv": conv[:1], "block": block[:1], "ways": [[[*k, cost, rank] for k, (cost, rank, _) in at.items()]]}

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, block, ways in grouped(batches, 1):
            roles = between([{(s, q): (cost, rank) for s, q, cost, rank in w} for w in ways])
            yield {"c": conv, "b": block, "begin": roles[:-1], "end": roles[1:], "last": [False] * (len(conv) - 1) + [True]}

    of_cut = rows.join(cut, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "block", "place", "code", "stay")
    ways = arrow_map(of_cut.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place"), matrices, f"conv {kind}, block bigint, ways array<array<bigint>>")
    known = arrow_map(ways.repartition("conv").sortWithinPartitions("conv", "block"), states, f"c {kind}, b bigint, begin int, end int, last boolean")
    rows = rows.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block in grouped(batches, 2):
            conv, _, place, turn, role, text, fault, code, stay, begin, end, last = block
            done, final = edits(list(zip(code, stay, strict=True)), begin[0] or START, end[0])
            out: list[tuple] = []
            for i, (becomes, letter) in enumerate(done):
                if LETTERS[letter][0] == "I":
                    out.append((conv[i], place[i], 0, None, None, "", None, "insert", ROLES[USER if becomes == ASSISTANT else ASSISTANT]))
                name = {"D": "delete", "K": "keep", "R": "rerole"}[LETTERS[letter][-1]]
                out.append((conv[i], place[i], 1, turn[i], role[i], text[i], fault[i], name, {"delete": None, "keep": role[i], "rerole": ROLES[becomes]}[name]))
            if last[0] is None or last[0]:
                out += [(conv[0], place[-1], 2 + k, None, None, "", None, "insert", ROLES[r]) for k, r in enumerate(ENDS[final])]
            yield dict(zip(("conv_id", "place", "step", "turn", "role", "text", "fault", "edit", "becomes"), map(list, zip(*out, strict=True)), strict=True))

    spread = rows.select("conv_id", "block", "place", "turn", "role", "text", "fault", "code", "stay", "begin", "end", "last").repartition("block").sortWithinPartitions("block", "conv_id", "place")
    spread = spread.select("conv_id", "block", "place", "turn", "role", "text", "fault", "code", "stay", "begin", "end", "last")
    return arrow_map(spread, together(edit), f"conv_id {kind}, place bigint, step int, turn bigint, role string, text string, fault string, edit string, becomes string")


class Report:
    """What is told of one conversation, turn by turn."""

    def __init__(self, conv: object) -> None:
        self.conv, self.audit, self.digest, self.lines = conv, bytearray(), hashlib.sha256(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.most = self.initial = None
        self.distinct = self.illegal = self.cost = 0

    def add(self, turn: int | None, role: str | None, text: str, fault: str | None, edit: str, becomes: str | None) -> None:
        self.audit += edit[:1].upper().encode()
        self.cost += {"keep": 0, "rerole": REROLE, "delete": DELETE, "insert": INSERT}[edit]
        if fault:
            self.faults[fault] += 1
            if fault == "truncated" and edit != "delete":
                self.cost += TRUNCATED
        if edit != "insert":
            if turn is not None and turn != self.most:
                self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
        if becomes is not None:
            self.digest.update(("\n" if self.lines else "").encode() + f"{becomes}:{text}".encode())
            self.lines += 1

    def row(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"c": self.conv, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": self.audit.decode(), "repaired_sha256": self.digest.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(repair: DataFrame) -> DataFrame:
    """The edits of `repaired` -> c (the conversation), gaps, the faults, illegal, cost, audit and repaired_sha256."""
    kind = next(t for c, t in repair.dtypes if c == "conv_id")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        told = None
        for batch in batches:
            out: list[dict] = []
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edit", "becomes")), strict=True):
                if told is None or told.conv != conv:
                    out += [told.row()] if told else []
                    told = Report(conv)
                told.add(*turn)
            if out:
                yield {k: [x[k] for x in out] for k in out[0]}
        if told:
            yield {k: [v] for k, v in told.row().items()}

    schema = f"c {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    return arrow_map(repair.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step"), tell, schema)


# -- the query


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fifth of the turns damaged, by the checksum of conversation and turn; nulls are one space."""
    space = F.lit(" ")
    k = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = turns.select("conv_id", "turn", k.alias("k"), role.alias("role"), text.alias("text")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def reports(turns: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each conversation of `turns`, with what `digests` says of its turns in `after`."""
    told = digests(repaired(after))
    rows = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return reports(turns, damaged(turns))
