"""Ignore rules on a fixture tree, and the translation of patterns."""

from __future__ import annotations

import re

import pytest

from quern.sources import ignores

FILES = "path string, text string, ignored string"


@pytest.mark.parametrize(
    ("line", "yes", "no"),
    [
        ("*.log", ["a.log", "x/y/.log", "x/a.log"], ["a.logs", "alog"]),
        ("/top.txt", ["top.txt"], ["x/top.txt"]),
        ("doc/*.md", ["doc/a.md"], ["doc/x/a.md", "x/doc/a.md"]),
        ("**/gen", ["gen", "a/gen", "a/b/gen"], ["genx", "gen/x"]),
        ("a/**", ["a/x", "a/x/y"], ["a", "b/a/x"]),
        ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["az", "a/bz"]),
        ("f?o", ["foo", "x/fzo"], ["fo", "f/o"]),
        ("[a-c]x", ["ax", "d/cx"], ["dx", "/x"]),
        ("[!a-c]x", ["dx"], ["ax"]),
        ("[]]x", ["]x"], ["[x"]),
        (r"\#a", ["#a"], ["a"]),
        (r"\!a", ["!a"], ["a"]),
        ("a.b", ["a.b"], ["axb"]),
        ("end  ", ["end"], ["end  "]),
        (r"end\ ", ["end "], ["end"]),
        ("a+(b)$", ["a+(b)$"], ["aab"]),
    ],
)
def test_patterns(line, yes, no):
    pattern, negated, _ = ignores.rule(line)
    assert not negated and all(re.search(pattern, p) for p in yes) and not any(re.search(pattern, p) for p in no)


def test_lines_without_a_pattern():
    assert [ignores.rule(x) for x in ("", "   ", "# note", "/", "!", "[a", "x\\")] == [None] * 7
    assert ignores.rule("!build/")[1:] == (True, True) and ignores.rule("a/")[2]


def test_a_tree(spark):
    ruled = {
        ".gitignore": "# made by tools\n*.log\nbuild/\n!keep.log\n/only_here\ndocs/*.tmp\n",
        "sub/.gitignore": "!*.log\nsecret*\n!secret_but_fine\n",
        "sub/deep/.gitignore": "*\n!*.py\n",
        "build/.gitignore": "!*\n",
    }
    kept = ["a.py", "keep.log", "sub/x.log", "x/only_here", "x/docs/a.tmp", "docs/x/a.tmp", "sub/secret_but_fine", "sub/deep/a.py", "buildx/a", "file/build"]
    gone = ["a.log", "x/a.log", "build/a.py", "build/keep.log", "x/build/y/z.py", "only_here", "docs/a.tmp", "sub/secret", "sub/y/secrets", "sub/deep/a.txt", "sub/deep/in/a.py", "only_here/below.py"]
    rows = [(p, t, "x") for p, t in ruled.items()] + [(p, None, "x") for p in kept + gone]
    files = spark.createDataFrame(rows, FILES)
    none = spark.createDataFrame([], "path string")
    got, note = ignores.listing(files, none)
    assert note == "" and sorted(r.path for r in got.collect()) == sorted([*kept, ".gitignore", "sub/.gitignore"])
    tracked = spark.createDataFrame([("build/a.py",), ("a.log",)], "path string")
    assert sorted(r.path for r in ignores.listing(files, tracked)[0].collect()) == sorted([*kept, ".gitignore", "sub/.gitignore", "build/a.py", "a.log"])
    got, note = ignores.listing(files, None)
    assert got.count() == len(rows) and "not applied" in note


def test_all_rows_stay(spark):
    files = spark.createDataFrame([("a.log", "1", "x"), ("a.log", "2", "x"), (None, "3", "x"), ("b", None, "x")], FILES)
    rules = spark.createDataFrame([(".gitignore", "*.log"), ("z/.gitignore", None), (None, "*")], "path string, text string")
    assert sorted((str(r.path), r.ignored) for r in ignores.listed(files, rules).collect()) == [("None", False), ("a.log", True), ("a.log", True), ("b", False)]
    assert ignores.listed(files.limit(0), rules).count() == 0 and ignores.listed(files, rules.limit(0)).where("ignored").count() == 0
