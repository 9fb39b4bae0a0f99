"""URL filters by a sorted digest array.

A list entry is a host and a path prefix with a verdict; it fits its host and all subdomains if the URL's path starts
with the prefix, and the longest fitting entry decides (of equally long ones that with the longer host).  Entries are
keyed by the 64-bit xxhash of host and path.  The keys stand sorted in files that workers memory-map: a batch of URLs
makes one key for each (host suffix, length of a listed path), probes the array by vectorised binary search, and
confirms each hit against the stored full string, so that a collision of keys never decides.

A large list is many files (shards), each of one range of keys; the manifest holds each shard's first key.  Where the
shared folder is no local path, a shard is read whole instead of mapped.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path goes on
from there up to `?`, `#` or the end.  Null URLs and those without `://` have an empty host and path.  A URL that no
entry fits gets the default verdict.  With two entries for the same host and path, block wins.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, scratch, table, written

#: The contract's rules: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Words of sites that sell or bet; a host is listed where one stands between dots and hyphens of its name.
WARNED = ["bet", "bets", "betting", "casino", "jackpot", "loan", "loans", "pharmacy", "pills", "poker", "porn", "replica", "viagra", "xxx"]
#: Ranges of keys that the query's list has at least.
LIST_SHARDS = 4
#: Entries that one shard holds, about.
SHARD_ROWS = 4_000_000
MARK = b"QUF1"
SEED = 42  # that of Spark's xxhash64


class Parts(NamedTuple):
    host: str
    path: str


UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def parts(url: str | None) -> Parts:
    if url is None or (at := url.find("://")) < 0:
        return Parts("", "")
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    cut = len(rest) if cut < 0 else cut
    return Parts(rest[:cut].translate(UPPER), rest[cut:])


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"), SEED)


def shard_bytes(keys: np.ndarray, entries: list[bytes], blocked: np.ndarray) -> bytes:
    """A shard: mark, count, the sorted keys, the entries' ends, the verdicts, and the entries one after the other."""
    ends = np.cumsum([len(e) for e in entries], dtype=np.uint64)
    return MARK + struct.pack("<IQ", 0, len(keys)) + keys.astype("<u8").tobytes() + ends.astype("<u8").tobytes() + blocked.astype("u1").tobytes() + b"".join(entries)


class Shard:
    """A shard's arrays, mapped from its file where that is local."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        if isinstance(system, fs.LocalFileSystem):
            buffer = pa.memory_map(path).read_buffer()
        else:
            buffer = system.open_input_file(path).read_buffer()
        view = memoryview(buffer)
        if bytes(view[:4]) != MARK:
            raise ValueError(f"{uri} is no digest array")
        _, n = struct.unpack("<IQ", view[4:16])
        self.keys = np.frombuffer(buffer, "<u8", n, 16)
        self.ends = np.frombuffer(buffer, "<u8", n, 16 + 8 * n)
        self.blocked = np.frombuffer(buffer, "u1", n, 16 + 16 * n)
        self.text = view[16 + 17 * n :]

    def entry(self, k: int) -> bytes:
        return bytes(self.text[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])])


class Filter(NamedTuple):
    """What workers need: each shard's first key and URI, the lengths of the listed paths, the most labels of a host."""

    firsts: list[int]
    shards: list[str]
    lengths: list[int]
    labels: int
    default: str


def build(entries: DataFrame, folder: str, default: str = "allow", least_shards: int = 1) -> Filter:
    """The digest array of entries (host, path, verdict), written by key ranges under folder (a URI).

    The driver gets a row for each shard of SHARD_ROWS entries (or least_shards of them) and the distinct lengths of
    paths, no entry.
    """
    rows = entries.where("host is not null").select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rows = rows.groupBy(F.concat("host", F.lit("\n"), "path").alias("entry")).agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocked"), F.max(F.length("path")).alias("length"), F.max(F.size(F.split("host", "[.]"))).alias("labels"))
    rows = rows.withColumn("key", F.xxhash64("entry"))
    total = rows.count()
    # unsigned order: the sign bit is turned
    rows = rows.withColumn("order", F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).repartitionByRange(max(least_shards, -(-total // SHARD_ROWS)), "order").sortWithinPartitions("order", "entry")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, found, blocked, lengths, labels = [], [], [], set(), 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            found += [e.encode() for e in batch.column(1).to_pylist()]
            blocked.append(batch.column(2).to_numpy(zero_copy_only=False))
            lengths.update(batch.column(3).to_pylist())
            labels = max([labels, *batch.column(4).to_pylist()])
        if keys and found:
            uri = f"{folder}/shard-{uuid.uuid4().hex}"
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(shard_bytes(np.concatenate(keys), found, np.concatenate(blocked)))
            yield {"first": [str(next(k[0] for k in keys if len(k)))], "uri": [uri], "lengths": [sorted(lengths)], "labels": [labels]}

    shards = written(arrow_map(rows.select("key", "entry", "blocked", "length", "labels"), work, "first string, uri string, lengths array<int>, labels int"), "shards").collect()
    shards.sort(key=lambda s: int(s.first))
    return Filter([int(s.first) for s in shards], [s.uri for s in shards], sorted({n for s in shards for n in s.lengths}), max((s.labels for s in shards), default=0), default)


class Prober:
    """Judges batches of URLs; it opens a shard when a key first falls in its range."""

    def __init__(self, rules: Filter) -> None:
        self.rules, self.opened = rules, {}
        self.firsts = np.array(rules.firsts, np.uint64)

    def shard(self, i: int) -> Shard:
        if i not in self.opened:
            self.opened[i] = Shard(self.rules.shards[i])
        return self.opened[i]

    def hits(self, keys: np.ndarray, entries: list[bytes]) -> list[int | None]:
        """For each key whether it is listed: 1 blocked, 0 allowed, None not there."""
        out: list[int | None] = [None] * len(keys)
        if not len(self.firsts):
            return out
        where = np.searchsorted(self.firsts, keys, side="right").astype(np.int64) - 1
        # copies of a key may begin in the shard before the one that begins with it
        for move in (0, -1):
            at = where + move
            for i in np.unique(at[at >= 0]).tolist():
                mine = np.flatnonzero(at == i)
                if move and not (keys[mine] == self.firsts[i + 1]).any():
                    continue
                shard = self.shard(i)
                low, high = (np.searchsorted(shard.keys, keys[mine], side=s) for s in ("left", "right"))
                for m in np.flatnonzero(high > low).tolist():
                    for k in range(int(low[m]), int(high[m])):
                        if shard.entry(k) == entries[mine[m]]:
                            out[mine[m]] = int(shard.blocked[k])
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL."""
        split = [parts(u) for u in urls]
        owner: list[int] = []
        tried: list[tuple[int, str, str]] = []
        for i, (host, path) in enumerate(split):
            if not host:
                continue
            # no listed host has more labels, so a hostile name of many costs no more
            labels = host.rsplit(".", self.rules.labels)[-self.rules.labels :] if self.rules.labels else []
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in self.rules.lengths:
                    if n <= len(path):
                        owner.append(i)
                        tried.append((len(suffix) + n, suffix, path[:n]))
        entries = [f"{h}\n{p}".encode("utf-8", "surrogatepass") for _, h, p in tried]
        keys = np.fromiter((xxhash.xxh64_intdigest(e, SEED) for e in entries), np.uint64, len(entries))
        best: dict[int, tuple[int, str, str, int]] = {}
        for i, (size, host, path), hit in zip(owner, tried, self.hits(keys, entries), strict=True):
            if hit is not None and (i not in best or (size, len(host)) > (best[i][0], len(best[i][1]))):
                best[i] = (size, host, path, hit)
        out = []
        for i, (host, path) in enumerate(split):
            if i in best:
                _, h, p, blocked = best[i]
                out.append((host, path, h + p, "block" if blocked else "allow"))
            else:
                out.append((host, path, None, self.rules.default))
        return out


def judged(rows: DataFrame, rules: Filter, id_: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        prober = Prober(rules)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                found = prober.judge(part.column(1).to_pylist())
                yield {"page_id": part.column(0), **{name: list(x) for name, x in zip(("host", "path", "rule", "verdict"), zip(*found, strict=True), strict=True)}}

    return arrow_map(rows.select(F.col(id_).cast("bigint").alias("page_id"), F.col(url).alias("url")), work, "page_id bigint, host string, path string, rule string, verdict string")


def entries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rules, columns=["host", "path", "verdict"]), "host string, path string, verdict string")


def warned_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Entries (host, path, verdict) that block each distinct host of the pages with a warned word in its name."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    host = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hosts = pages.select(host.alias("host")).where(F.col("host").rlike(f"(^|[.-])({'|'.join(WARNED)})([.-]|$)")).distinct()
    return hosts.select("host", F.lit("").alias("path"), F.lit("block").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules decide where one fits; else the list of warned hosts does, and its entry is no `rule`."""
    pages = table(spark, sf_dir, "pages")
    rules = build(entries(spark, RULES), scratch(spark, "url-rules"))
    listed = build(warned_hosts(pages), scratch(spark, "url-list"), least_shards=LIST_SHARDS)
    return two_lists(pages, rules, listed)


def two_lists(rows: DataFrame, rules: Filter, listed: Filter, id_: str = "page_id", url: str = "url") -> DataFrame:
    """As `judged` with `rules`; where none fits, the verdict of `listed`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, second = Prober(rules), Prober(listed)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                urls = part.column(1).to_pylist()
                found = first.judge(urls)
                rest = [k for k, x in enumerate(found) if x[2] is None]
                other = dict(zip(rest, (x[3] for x in second.judge([urls[k] for k in rest])), strict=True))
                rows_ = [(h, p, r, other.get(k, v)) for k, (h, p, r, v) in enumerate(found)]
                yield {"page_id": part.column(0), **{name: list(x) for name, x in zip(("host", "path", "rule", "verdict"), zip(*rows_, strict=True), strict=True)}}

    return arrow_map(rows.select(F.col(id_).cast("bigint").alias("page_id"), F.col(url).alias("url")), work, "page_id bigint, host string, path string, rule string, verdict string")


ORACLE_SQL = f"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM split),
dotted AS (SELECT *, '.' || host AS d FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN d LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN d LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN d LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN d LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN d LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM dotted)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(d, '[.-]({'|'.join(WARNED)})([.-]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM ruled
"""
