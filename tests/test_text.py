import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.functions import severity as sev
from siftline.functions import text as tx


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, fn, kind="string"):
    df = column(spark, values, kind).select("i", fn(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def random_texts(n=60):
    rnd = random.Random(7)
    alphabet = list("ab _=1:\t\n\r\x0b\x0c\x1c\x85\u2028 éßſKİ") + ["if ", "for ", "def f(", "class A", "\r\n"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", "a", "\n"]


def test_strip_is_the_unicode_strip(spark):
    values = random_texts()
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]


def test_newlines_become_line_feeds(spark):
    values = random_texts()
    assert apply(spark, values, tx.normalise_newlines) == [re.sub("\r\n?", "\n", v) for v in values]


def test_fold_keeps_positions(spark):
    values = ["İıſK", "PASSWORD straße ÀÉ", "x"]
    folded = apply(spark, values, tx.fold)
    assert folded == ["iisk", "password straße àé", "x"]
    assert [len(f) for f in folded] == [len(v) for v in values]


def test_line_counts(spark):
    values = random_texts()
    assert apply(spark, values, tx.count_splitlines) == [len(v.splitlines()) for v in values]
    assert apply(spark, values, tx.loc) == [sum(1 for l in v.split("\n") if l.strip()) for v in values]


def test_three_lines_of_code(spark):
    assert apply(spark, ["line1\nline2\nline3\n"], tx.loc) == [3]


def test_complexity_counts(spark):
    values = random_texts() + ["éfor for_ for(if)elif", "def  f (x):\n  class  B: pass"]
    df = column(spark, values).select("i", *[c.alias(n) for n, c in tx.complexity(F.col("x")).items()])
    got = [tuple(r)[1:] for r in df.orderBy("i").collect()]
    want = [
        (
            len(re.findall(r"def\s+\w+\s*\(", v)), len(re.findall(r"class\s+\w+", v)),
            len(re.findall(r"\b(if|elif|while|for)\b", v)), len(v.split("\n")),
        )
        for v in values
    ]
    assert got == want


def test_snippets_are_clipped(spark):
    text = "a\nb\nc\nd"
    df = spark.range(-2, 9).select(
        F.col("id").cast("int").alias("n"), tx.snippet(F.lit(text), F.col("id").cast("int"), 1).alias("s")
    )
    lines = text.split("\n")
    for n, s in df.collect():
        assert s == "\n".join(lines[max(0, n - 2) : max(0, min(4, n + 1))]) if n + 1 > 0 else s == ""


def test_languages(spark):
    names = ["a.py", "b.js", "c.jsx", "d.ts", "e.tsx", "f.go", "g.rs", "h.txt", "I.PY", ".py", "x.", "d/.b/c"]
    assert apply(spark, names, pt.language) == [
        "python", "javascript", "javascript", "typescript", "typescript", "go", "rust",
        "unknown", "python", "unknown", "unknown", "unknown",
    ]
    assert apply(spark, ["a.md", "a.zzz"], pt.display_language) == ["Markdown", None]
    assert apply(spark, ["a.sh", "a.zzz"], pt.language_hint) == ["bash", ""]


def test_scannable_paths(spark):
    names = ["node_modules/test.js", "good.js", "a/build/x.py", "build.py", "a/.venv/b.go", "x.PY", "x.txt"]
    assert apply(spark, names, pt.is_scannable) == [False, True, False, True, False, False, False]


def test_exclusion_globs_match_from_the_right(spark):
    from pathlib import PurePosixPath

    names = ["a/b/c.py", "c.py", "a/c.pyc", "/abs/x.js", "b/[z].go", "src1/k.rs", "srcx/k.rs"]
    for pattern in ["*.py", "b/*.py", "a/*/c.py", "/abs/*.js", "src[0-9]/*.rs", "src[!0-9]/k.?s", "b/c", "[[]z].go"]:
        want = [pattern in n or PurePosixPath(n).match(pattern) for n in names]
        assert apply(spark, names, lambda c: pt.should_exclude(c, [pattern])) == want, pattern


def test_sizes_round_half_to_even(spark):
    def expected(n):
        for unit in ["B", "KB", "MB", "GB"]:
            if n < 1024.0:
                return f"{n:.1f} {unit}"
            n /= 1024.0
        return f"{n:.1f} TB"

    sizes = [0, 1, 1023, 1024, 1280, 1792, 2304, 1048575, 1048576, 1310720, 5 * 2**30 + 2**28, 2**40, 2**50 + 2**38]
    assert apply(spark, sizes, pt.human_size, "bigint") == [expected(s) for s in sizes]


def test_validators(spark):
    assert apply(spark, ["", " \t", None, "x", "x" * 11], lambda c: F.array_join(pt.content_errors(c, 10), "")) == [
        "Code is empty", "Code is empty", "Code is empty", "", "Code exceeds maximum size (1MB)",
    ]
    assert apply(spark, [0, 1, 10485759, 10485760], pt.valid_size, "bigint") == [False, True, True, False]
    assert apply(spark, ["a.py", "a.rb"], lambda c: F.array_join(pt.extension_errors(c), "")) == [
        "", "Extension .rb not allowed",
    ]
    assert apply(spark, ["HIGH", "info", "warning", None], sev.is_valid) == [True, True, False, False]


def test_severity_mappings(spark):
    assert apply(spark, ["HIGH", "low", "Undefined"], sev.imported) == ["high", "low", "medium"]
    assert apply(spark, ["critical", "low", "CRITICAL", None], sev.rank) == [4, 1, 0, 0]
    assert apply(spark, ["critical", "info", "zzz", None], sev.level) == [5, 1, 1, 1]


def test_paths_are_shown_relative(spark):
    assert apply(spark, ["/w/x\\y/z"], lambda c: pt.normalise_path(c, "/w")) == ["./x/y/z"]


@pytest.mark.parametrize(
    ("pattern", "hit", "miss"),
    [
        (r"FOO\S+bar", "foo--bar", "foo  bar"),
        (r"a\Wb", "a-b", "axb"),
        (r"a\Db", "axb", "a1b"),
        (r"x\Bfoo", "xfoo", "x foo"),
        (r"\\s", r"\s", "a b"),
    ],
)
def test_escapes_keep_their_meaning(spark, pattern, hit, miss):
    df = spark.createDataFrame([(hit,), (miss,)], "t string")
    assert [r.t for r in df.where(F.lower("t").rlike(tx.regex(pattern))).collect()] == [hit]
