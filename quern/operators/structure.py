"""Files and their structure: limits with exemptions, lint findings, import inventories, and documents as sets.

Exempt findings stay, with the severity `exempt`; an exemption without a reason covers nothing and is itself a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ratios import half_even

#: Fixed values: (metric, warn, hard); a NULL warn has one step only.
LIMITS = [("file_lines", 200, 250), ("method_lines", 15, 25), ("nesting", None, 1), ("loop_body", None, 8), ("params", 3, 4), ("public", 5, 7), ("folder_files", 5, 7), ("else_branch", None, 0)]
NOT_COUNTED = [".tf", ".tfvars", ".h", ".hpp"]
#: How a comment begins that exempts the next line of code, and what parts its metrics from the reason.
MARK, REASON = "# quern:exempt", "--"
#: How many lines at its top may exempt a whole file, and, fixed values, what is never scanned and what is code to be judged by length.
HEAD_LINES = 20
#: Files of a commit that one join key pairs.
COMMIT_BLOCK = 512
#: Lines of a change log that one part holds, as a power of two.
LOG_BITS = 16
DROPPED = ["min.js", "lock", "map", "snap", "png", "jpg", "jpeg", "gif", "svg", "pdf", "zip", "gz", "ico", "woff", "woff2", "ttf"]
CODE = ["py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "kt", "kts", "go", "rb", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "swift", "scala", "php", "ex", "exs", "erl", "clj", "dart", "sh", "bash", "zsh", "awk", "pl", "lua", "m", "mm", "groovy", "gradle", "tf", "vue", "svelte"]


def line_count(text: Column) -> Column:
    """Physical lines; an unterminated last one counts, an empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def lint_line_count(text: Column) -> Column:
    """The linter's count: newlines plus one."""
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))


def limits(metric: str) -> tuple[int | None, int]:
    return next((w, h) for m, w, h in LIMITS if m == metric)


def graded(value: Column, warn: int | None, hard: int) -> Column:
    """struct(severity, cap): major above hard, minor above warn, else NULL."""
    minor = F.when(value > warn, F.struct(F.lit("minor").alias("severity"), F.lit(warn).alias("cap"))) if warn is not None else F.lit(None)
    return F.when(value > hard, F.struct(F.lit("major").alias("severity"), F.lit(hard).alias("cap"))).otherwise(minor)


def violations(rows: DataFrame, metric: str) -> DataFrame:
    """rows with a `value` above the metric's limits, with severity and cap."""
    warn, hard = limits(metric)
    found = rows.withColumn("g", graded(F.col("value"), warn, hard)).where("g is not null")
    return found.select("*", F.lit(metric).alias("metric"), "g.severity", "g.cap").drop("g")


def exempted(found: DataFrame, exemptions: DataFrame) -> DataFrame:
    """found(path, metric, severity, …) with what exemptions(path, metric, reason) cover as `exempt`, and a major
    `exempt_without_reason` row for each exemption that gives none."""
    given = exemptions.where(F.trim(F.coalesce("reason", F.lit(""))) != "").select("path", "metric", F.lit(True).alias("covered")).distinct()
    rows = found.join(given, ["path", "metric"], "left").withColumn("severity", F.when(F.col("covered"), "exempt").otherwise(F.col("severity"))).drop("covered")
    bare = exemptions.where(F.trim(F.coalesce("reason", F.lit(""))) == "").select("path", F.lit("exempt_without_reason").alias("metric"), F.lit("major").alias("severity"), F.lit(1).alias("value"), F.lit(0).alias("cap"))
    return rows.select("path", "metric", "severity", "value", "cap").unionByName(bare)


def pragmas(lines: DataFrame, mark: str = MARK) -> DataFrame:
    """lines(path, line, text) -> path, line, metric, reason: a comment that begins with the mark holds for the next line of code.

    Its metrics stand before the first REASON, parted by commas or blanks; each gives a row, and a reason may be empty.
    Blank lines and other comments between are passed over; a line of code uses up what stands before it.
    """
    bare = F.trim(F.regexp_replace("text", r"\s", " "))
    body = F.substring(bare, F.lit(len(mark) + 1), F.length(bare))
    told = F.struct(F.substring_index(body, REASON, 1).alias("metrics"), F.trim(F.when(F.contains(body, F.lit(REASON)), F.expr("substring(body, instr(body, '--') + 2)")).otherwise("")).alias("reason"), F.col("line").alias("at"))
    rows = lines.withColumn("bare", bare).withColumn("body", body)
    rows = rows.withColumn("said", F.when(F.col("bare").startswith(mark), told)).withColumn("code", (F.col("bare") != "") & ~F.col("bare").startswith("#"))
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("last_said", F.last("said", ignorenulls=True).over(by)).withColumn("last_code", F.last(F.when(F.col("code"), F.col("line")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(F.col("code") & F.col("last_said").isNotNull() & (F.col("last_code").isNull() | (F.col("last_said.at") > F.col("last_code"))))
    metrics = F.array_distinct(F.filter(F.split("last_said.metrics", "[ ,]+"), lambda x: x != ""))
    return rows.select("path", "line", F.explode(metrics).alias("metric"), F.col("last_said.reason").alias("reason"))


def is_code(path: Column) -> Column:
    """Whether a file is held to the limit of lines: code by its ending, and not one of the built or binary kinds."""
    ending = lambda kinds: F.regexp_like(path, F.lit("[.](" + "|".join(k.replace(".", "[.]") for k in kinds) + ")$"))
    return F.coalesce(ending(CODE) & ~ending(DROPPED), F.lit(False))


def file_lengths(files: DataFrame, mark: str = MARK) -> DataFrame:
    """files(path, text) -> path, metric, severity, value, cap of the code files above a limit of lines.

    A file has no declaration to hang a pragma on, so one of its first lines may exempt it: the mark, the metric among
    others, and a reason.  Such a file stays as `exempt`, against the hard limit.
    """
    warn, hard = limits("file_lines")
    told = F.exists(F.slice(F.split("text", "\n"), 1, HEAD_LINES), lambda x: F.regexp_like(x, F.lit(rf"\Q{mark}\E[^-]*[\s,]file_lines([\s,][^-]*)?{REASON}\s*\S")))
    rows = files.where(is_code(F.col("path"))).select("path", line_count(F.col("text")).alias("value"), told.alias("told"))
    found = violations(rows, "file_lines")
    exempt = F.coalesce("told", F.lit(False))
    return found.select("path", "metric", F.when(exempt, "exempt").otherwise(F.col("severity")).alias("severity"), "value", F.when(exempt, hard).otherwise(F.col("cap")).alias("cap"))


def folder_files(files: DataFrame) -> DataFrame:
    """folder, value: the distinct files right in each folder, without declarations and headers."""
    counted = ~F.regexp_like("path", F.lit(r"(" + "|".join(e.replace(".", "[.]") for e in NOT_COUNTED) + r")$"))
    rows = files.where(counted).select("path").distinct()
    return rows.groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("value"))


def roll_up(found: DataFrame) -> DataFrame:
    """metric, severity, n, worst of each (exempt rows included)."""
    return found.groupBy("metric", "severity").agg(F.count("*").alias("n"), F.max("value").alias("worst"))


def worst(found: DataFrame, n: int = 20) -> DataFrame:
    return found.orderBy(F.desc("value"), "path", "metric").limit(n)


def ratchet(measured: DataFrame, budget: DataFrame) -> DataFrame:
    """measured(key, value) against budget(key, value): what passes, and the next budget, which never rises."""
    rows = measured.join(budget.withColumnRenamed("value", "budget"), "key", "left")
    return rows.select("key", "value", "budget", (F.col("value") <= F.col("budget")).alias("passes"), F.least("value", F.coalesce("budget", "value")).alias("next_budget"))


# -- inventories


def lexical_imports(files: DataFrame) -> DataFrame:
    """path, line, module, statement of `from X import …` and `import a, b as c` lines; relative ones are not seen."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "statement")).withColumn("line", F.col("pos") + 1)
    source = F.regexp_extract("statement", r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b", 1)
    plain = F.regexp_extract("statement", r"^\s*import\s+([A-Za-z_].*)$", 1)
    each = F.transform(F.split(F.regexp_replace(plain, r"\s*#.*$", ""), ","), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_][\w.]*)", 1))
    rows = lines.withColumn("modules", F.when(source != "", F.array(source)).when(plain != "", each).otherwise(F.array().cast("array<string>")))
    return rows.select("path", "line", F.explode("modules").alias("module"), F.substring(F.trim("statement"), 1, 160).alias("statement")).where("module <> ''")


def inventory(imports: DataFrame) -> DataFrame:
    return imports.groupBy("module").agg(F.count("*").alias("occurrences"), F.count_distinct("path").alias("files"))


def prefix_violations(imports: DataFrame, prefixes: list[str]) -> DataFrame:
    """Imports equal to a prefix or below it, with the first such prefix."""
    first = F.coalesce(*[F.when((F.col("module") == p) | F.col("module").startswith(p + "."), F.lit(p)) for p in prefixes])
    return imports.withColumn("prefix", first).where("prefix is not null")


# -- documents as sets


def statement_actions(doc: DataFrame) -> DataFrame:
    """doc(doc, sid, effect, actions array) -> doc, effect, action, one row each."""
    return doc.select("doc", "effect", F.explode("actions").alias("action")).distinct()


def diff_sets(live: DataFrame, made: DataFrame, key: str, item: str) -> DataFrame:
    """key, change (added or removed), item: what only `made` has, and what only `live` has."""
    a = made.select(key, item).distinct()
    z = live.select(key, item).distinct()
    return a.join(z, [key, item], "left_anti").withColumn("change", F.lit("added")).unionByName(z.join(a, [key, item], "left_anti").withColumn("change", F.lit("removed"))).select(key, "change", item)


def additive_merge(live: DataFrame, made: DataFrame, key: list[str], item: str) -> DataFrame:
    """The union, each item with where it comes from; what only `live` has is preserved.

    The key must hold the effect, so that a denied action never turns into an allowed one.
    """
    a = made.select(*key, item).distinct().withColumn("m", F.lit(True))
    z = live.select(*key, item).distinct().withColumn("l", F.lit(True))
    return a.join(z, [*key, item], "full_outer").select(*key, item, F.when(F.col("m") & F.col("l"), "both").when(F.col("m"), "generated").otherwise("preserved").alias("origin"))


def replaced(live: DataFrame, made: DataFrame, key: list[str], item: str) -> DataFrame:
    """As generated; what goes with it is reported as `removed`."""
    a = made.select(*key, item).distinct()
    z = live.select(*key, item).distinct().join(a, [*key, item], "left_anti")
    return a.withColumn("state", F.lit("kept")).unionByName(z.withColumn("state", F.lit("removed")))


def vote_ranking(votes: DataFrame, group: str, name: str, weight: str) -> DataFrame:
    """group, name, score, place: the sums of weights, highest first, then by name."""
    s = votes.groupBy(group, name).agg(F.sum(weight).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), name)))


def first_layer(layers: DataFrame, group: str, layer: str) -> DataFrame:
    """The rows of each group's first layer that has any."""
    least = layers.groupBy(group).agg(F.min(layer).alias("__least"))
    return layers.join(least, group).where(F.col(layer) == F.col("__least")).drop("__least")


def carried_forward(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """The last value seen up to each row."""
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def ordered_distinct(text: Column, default: list[str]) -> Column:
    """The distinct names of a comma-separated list in the order first seen; the default if there is none."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(names) == 0, F.array(*map(F.lit, default))).otherwise(names)


def slug(name: Column) -> Column:
    """Runs of other than letters, digits and underscores are one dash; none at the ends; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[^\w]+", "-"), "^-+|-+$", ""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(__[A-Z][A-Z0-9_]*?__)"), 1))


def substituted(text: Column, values: dict[str, str]) -> Column:
    """Longest token first, so that none is hit inside a longer one."""
    for k in sorted(values, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(k), F.lit(values[k]))
    return text


def required(value: Column, name: str) -> Column:
    """The value; an error where it is missing or blank."""
    return F.coalesce(F.when(F.trim(value) != "", value), F.raise_error(F.lit(f"{name} is missing")).cast("string"))


def prefix_lookup(name: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the table's first prefix that the name has, else the name's first part."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(v)) for p, v in table], F.element_at(F.split(name, "_"), 1))


def lenient_json(text: Column, need: str) -> Column:
    """struct(value, reason): NULL with a reason for empty texts, broken JSON, and objects without the needed key."""
    value = F.try_parse_json(text)
    has = F.get_json_object(text, f"$.{need}").isNotNull()
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(value.isNull(), "not json").when(~has, f"no {need}").otherwise("")
    return F.struct(F.when(reason == "", text).alias("value"), reason.alias("reason"))


# -- history


def new_path(path: Column) -> Column:
    """A path of a change log, after a rename: `old => new` and `a/{old => new}/b` are the new path."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.when(path.contains("{") & (inner != path), F.regexp_replace(inner, "//+", "/")).otherwise(F.regexp_replace(path, "^.* => ", ""))
    return F.regexp_replace(whole, "^/", "")


def numstat(log: DataFrame) -> DataFrame:
    """log(line, text) of a history with changed lines -> sha, path, added, deleted: a row for each file of a commit.

    A header is C, the commit and perhaps its parents; with two parents or more it is a merge, whose files are left out, as they
    would count twice.  A file's line is added, deleted and path, parted by tabs; a binary file has dashes and NULL lines.  Other
    lines, and files before the first header, are left out.  The log is cut by line numbers; what carries over is the last
    header of the parts before, found from one row a part.
    """
    head = r"^C([0-9a-fA-F]+)((?: [0-9a-fA-F]+)*)\s*$"
    rows = log.where("line is not null and text is not null").withColumn("part", F.shiftright(F.col("line").cast("bigint"), LOG_BITS))
    sha = F.when(F.regexp_like("text", F.lit(head)), F.struct(F.regexp_extract("text", head, 1).alias("sha"), (F.size(F.split(F.trim(F.regexp_extract("text", head, 2)), " ")) > 1).alias("merge")))
    rows = rows.withColumn("header", sha)
    here = F.last("header", ignorenulls=True).over(Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("part").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line"))).alias("end"))
    before = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    cells = F.split("text", "\t", 3)
    files = rows.withColumn("here", here).where("header is null").join(before, "part").select(F.coalesce("here", "before").alias("of"), cells.alias("c"))
    files = files.where((F.size("c") == 3) & F.regexp_like(F.element_at("c", 1), F.lit("^([0-9]+|-)$")) & F.col("of").isNotNull() & ~F.col("of.merge"))
    return files.select("of.sha", new_path(F.col("c")[2]).alias("path"), F.col("c")[0].try_cast("bigint").alias("added"), F.col("c")[1].try_cast("bigint").alias("deleted"))


def commit_pairs(rows: DataFrame, block: int = COMMIT_BLOCK) -> DataFrame:
    """sha, a, b with a < b: the pairs of the distinct (sha, path) in one commit.

    A commit's files are dealt by hash into blocks of about `block` files, and a pair of blocks is a join key of its own, so a commit of
    very many files is no single task's.  Most commits are one block.
    """
    size = rows.groupBy("sha").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(size, "sha").withColumn("k", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j")))
    keyed = dealt.select("sha", "path", "k", F.explode(others).alias("key"))
    a = keyed.select("sha", "key", F.col("path").alias("a"), F.col("k").alias("ka"))
    b = keyed.select("sha", "key", F.col("path").alias("b"), F.col("k").alias("kb"))
    # within a pair of two blocks only what is in different ones; a block's own pairs have a key of their own
    return a.join(b, ["sha", "key"]).where("a < b and (key.i = key.j or ka <> kb)").select("sha", "a", "b")


def co_change(changes: DataFrame, least: int = 1, least_revisions: int = 1) -> DataFrame:
    """a, b, shared: the pairs of files in one commit, and in how many; pairs of a commit come from its own files alone.

    A file of fewer than `least` commits is in no such pair, so it goes before the pairs are made, like one of too few revisions.
    """
    rows = changes.select("sha", "path").distinct()
    few = max(least, least_revisions)
    if few > 1:
        rows = rows.join(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= few).select("path"), "path", "left_semi")
    return commit_pairs(rows).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def revisions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count_distinct("sha").alias("revisions"))


def churn(changes: DataFrame, since: Column) -> DataFrame:
    """path, churn of the changes at or after `since`; binary ones (NULL lines) count 0."""
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    return changes.where(F.col("ts") >= since).groupBy("path").agg(F.sum(lines).alias("churn"))


def temporal_coupling(changes: DataFrame, least_revisions: int, least_shared: int = 1) -> DataFrame:
    """a, b, shared, degree: 100 times the shared commits over the mean of the two files' revisions."""
    r = revisions(changes).where(F.col("revisions") >= least_revisions)
    rows = co_change(changes, least_shared, least_revisions).join(r.select(F.col("path").alias("a"), F.col("revisions").alias("ra")), "a").join(r.select(F.col("path").alias("b"), F.col("revisions").alias("rb")), "b")
    return rows.select("a", "b", "shared", half_even(200.0 * F.col("shared") / (F.col("ra") + F.col("rb")), 4).alias("degree"))


def ownership(changes: DataFrame, minor: float) -> DataFrame:
    """path, author, commits, share, minor: an author with less than that share is a minor one."""
    by = changes.groupBy("path", "author").agg(F.count_distinct("sha").alias("commits"))
    share = F.col("commits") / F.sum("commits").over(Window.partitionBy("path"))
    return by.select("path", "author", "commits", half_even(share, 4).alias("share"), (share < minor).alias("minor"))


def implicit_dependencies(pairs: DataFrame, package: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """a, b, shared of pairs (a, b, shared) in different packages (path, package) that make up more than `share` of the
    co-changes of each of the two files."""
    both = pairs.select(F.col("a").alias("path"), "shared").unionByName(pairs.select(F.col("b").alias("path"), "shared"))
    total = both.groupBy("path").agg(F.sum("shared").alias("total"))
    rows = pairs.where(F.col("shared") >= least)
    for end in ("a", "b"):
        facts = total.join(package, "path").select(F.col("path").alias(end), F.col("total").alias(f"t{end}"), F.col("package").alias(f"p{end}"))
        rows = rows.join(facts, end)
    return rows.where((F.col("pa") != F.col("pb")) & (F.col("shared") > share * F.col("ta")) & (F.col("shared") > share * F.col("tb"))).select("a", "b", "shared")


def unlinked_pairs(pairs: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """a, b, shared of co-changing files (pairs) that no edge (src, dst) joins either way."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.where(F.col("shared") >= least).join(ends, ["a", "b"], "left_anti")


def independent_modules(pairs: DataFrame, edges: DataFrame, homes: DataFrame, above: int = 4) -> DataFrame:
    """m, n, pairs, most: modules of one layer without an edge between any of their files, some of which co-change more than `above` times.

    homes(path, module, layer).  The rule on module pairs, not on file pairs: one edge between any two files of the modules ends it,
    whether these files co-change or not.  Files without a home count for none; a module of NULL layer shares it with none.
    """
    home = lambda end: homes.select(F.col("path").alias(end), F.col("module").alias(f"m_{end}"), F.col("layer").alias(f"l_{end}"))

    def by_module(rows: DataFrame, a: str, b: str) -> DataFrame:
        at = rows.join(home(a), a).join(home(b), b).where(F.col(f"m_{a}") != F.col(f"m_{b}"))
        return at.withColumns({"m": F.least(f"m_{a}", f"m_{b}"), "n": F.greatest(f"m_{a}", f"m_{b}")})

    linked = by_module(edges.select("src", "dst").distinct(), "src", "dst").select("m", "n").distinct()
    often = by_module(pairs.where(F.col("shared") > above), "a", "b").where("l_a = l_b").groupBy("m", "n").agg(F.count("*").alias("pairs"), F.max("shared").alias("most"))
    return often.join(linked, ["m", "n"], "left_anti")


def unstable_interfaces(pairs: DataFrame, edges: DataFrame, impact: int = 10, least: int = 3) -> DataFrame:
    """path, dependents, overlap: more than `impact` dependents, more than `impact` of which co-change with it."""
    often = pairs.where(F.col("shared") >= least)
    met = often.select(F.col("a").alias("dst"), F.col("b").alias("src")).unionByName(often.select(F.col("b").alias("dst"), F.col("a").alias("src"))).withColumn("met", F.lit(1))
    rows = edges.where("src <> dst").select("src", "dst").distinct().join(met, ["src", "dst"], "left")
    found = rows.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"), F.count("met").alias("overlap"))
    return found.where((F.col("dependents") > impact) & (F.col("overlap") > impact))


def crossings(pairs: DataFrame, edges: DataFrame, degree: int = 4, least: int = 3) -> DataFrame:
    """path, fan_in, fan_out: both at least `degree`, and co-changes on both sides."""
    often = pairs.where(F.col("shared") >= least).select("a", "b")
    one = edges.where("src <> dst").select("src", "dst").distinct().withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    one = one.join(often.withColumn("met", F.lit(1)), ["a", "b"], "left")
    into = one.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"), F.count("met").alias("met_in"))
    out = one.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("fan_out"), F.count("met").alias("met_out"))
    return into.join(out, "path").where(f"fan_in >= {degree} and fan_out >= {degree} and met_in > 0 and met_out > 0").select("path", "fan_in", "fan_out")
