"""File listing as a version control system would give it: ignore files, which rule each folder and what is below.

A line of an ignore file is a pattern.  Blank lines and lines that begin with # say nothing; ! before a pattern takes back what an
earlier one ignored; a slash at the end makes it match folders alone; a slash elsewhere ties it to the ignore file's own
folder, else it matches at any depth below.  * and ? and [...] stay within a name, ** stands for any folders.  A
backslash takes the next character as it is, also a blank at the end, where others are cut off.

Of the patterns that match a path the last line of the deepest ignore file decides.  What is in an ignored folder is ignored,
whatever is said further down.  Tracked files are listed even if they are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IGNORE_FILE = ".gitignore"
#: The note of a listing that no ignore rules were applied to.
NOT_APPLIED = "no version control here: ignore rules were not applied, so generated files may be among the nodes"
RULE = "base string, line int, pattern string, negated boolean, folders boolean"


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression of paths below the ignore file's folder, negated, folders alone) of a line, or None."""
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t\r]+$", r"\1", line.rstrip("\n"))
    if not line or line[0] == "#":
        return None
    negated = line[0] == "!"
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    tied = "/" in line
    parts = line.lstrip("/").split("/") if tied else ["**", line]
    out = ""
    for i, part in enumerate(parts):
        last = i + 1 == len(parts)
        if part == "**":
            out += "(?s:.+)" if last else "(?:[^/]+/)*"
        else:
            name = one_name(part)
            if name is None:
                return None
            out += name if last else f"{name}/"
    return f"^{out}$", negated, folders


def one_name(glob: str) -> str | None:
    """The regular expression of a pattern within a name; None if it can't match."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\":
            if i == len(glob):
                return None
            out += re.escape(glob[i])
            i += 1
        elif c == "*":
            out += "[^/]*"
            while i < len(glob) and glob[i] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            close = glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^")))
            if close < 0:
                return None
            inside = glob[i:close]
            i = close + 1
            no = inside[:1] in ("!", "^")
            inside = re.sub(r"([\\\[\]^&~])", r"\\\1", inside[no:])
            out += f"(?!/)[{'^' if no else ''}{inside}]"
        else:
            out += re.escape(c)
    return out


def rules(ignores: DataFrame) -> DataFrame:
    """ignores(path, text) of ignore files -> base (their folder, '' at the root), line, pattern, negated, folders."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                for i, line in enumerate((text or "").split("\n")):
                    if (found := rule(line)) is not None:
                        rows.append((path.rpartition("/")[0], i, *found))
            yield pd.DataFrame(rows, columns=["base", "line", "pattern", "negated", "folders"])

    return ignores.select("path", "text").where("path is not null").mapInPandas(read, RULE)


def listed(files: DataFrame, ignores: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """files(path, ...) with `ignored`, by the ignore files (path, text) and, if given, the tracked paths; all rows stay.

    Each path and each folder above it is held against the rules of the folders above that, by equality of the folder; a folder is
    judged once, however many files it holds.
    """
    parts = F.split("path", "/")
    names = files.select("path").where("path is not null").distinct().select("path", parts.alias("p"))
    ways = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("at"), (k < F.size("p")).alias("folder")))
    ways = names.select("path", F.explode(ways).alias("w")).select("path", "w.at", "w.folder")
    each = ways.select("at", "folder").distinct().withColumn("p", F.split("at", "/"))
    bases = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.struct(F.when(k == 0, "").otherwise(F.array_join(F.slice("p", 1, k), "/")).alias("base"), k.alias("depth"), F.array_join(F.slice("p", k + 1, F.size("p")), "/").alias("rest")))
    near = each.select("at", "folder", F.explode(bases).alias("b")).select("at", "folder", "b.base", "b.depth", "b.rest")
    hits = near.join(rules(ignores), "base").where((F.col("folder") | ~F.col("folders")) & F.regexp_like("rest", F.col("pattern")))
    last = hits.groupBy("at", "folder").agg(F.max_by("negated", F.struct("depth", "line")).alias("negated")).where(~F.col("negated"))
    out = ways.join(last.select("at", "folder"), ["at", "folder"], "left_semi").select("path").distinct()
    if tracked is not None:
        out = out.join(tracked.select("path"), "path", "left_anti")
    marked = files.drop("ignored").join(out.withColumn("ignored", F.lit(True)), "path", "left")
    return marked.withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def listing(files: DataFrame, tracked: DataFrame | None, ignore_file: str = IGNORE_FILE) -> tuple[DataFrame, str]:
    """files(path, text, ...) that are listed, and a note: `tracked` holds the tracked paths, or is None without version control,
    where nothing is ignored and the note says so."""
    if tracked is None:
        return files, NOT_APPLIED
    ignores = files.where((F.col("path") == ignore_file) | F.col("path").endswith(f"/{ignore_file}"))
    return listed(files, ignores, tracked).where("not ignored").drop("ignored"), ""
