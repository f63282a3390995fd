"""Vectors, text and path expressions against pinned values."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import glob as G
from lodestone.functions import text as T
from lodestone.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)).cast("array<float>")


@pytest.mark.parametrize("a,b,expected", [((1, 2, 3), (1, 2, 3), 1), ((1, 0), (0, 1), 0), ((1, 2), (-1, -2), -1), ((1, 2), (10, 20), 1), ((), (), 0), ((1,), (1, 2), 0), ((0, 0), (1, 1), 0), ((float("inf"), 1), (1, 1), 0), ((float("nan"), 1), (1, 1), 0)])
def test_cosine(spark, a, b, expected):
    assert one(spark, V.cosine(vec(*a), vec(*b))) == pytest.approx(expected, abs=1e-6)
    if b:
        assert one(spark, V.cosine_with(vec(*a), [float(x) for x in b])) == pytest.approx(expected, abs=1e-6)


def test_vector_functions(spark):
    assert one(spark, V.squared_l2(vec(1, 2), vec(4, 6))) == 25
    assert one(spark, V.l2_normalized(vec(3, 4))) == pytest.approx([0.6, 0.8], abs=1e-6)
    assert one(spark, V.l2_normalized(vec(0, 0))) == [0, 0]
    assert one(spark, V.mean_pooled(F.array(vec(1, 2), vec(3, 4), vec(9, 9)), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == [2, 3]
    assert one(spark, V.mean_pooled(F.array(vec(1, 2)), F.array(F.lit(0.0)))) == [0, 0]
    assert one(spark, V.nearest(vec(1, 1), F.array(vec(5, 5), vec(1, 0), vec(0, 1)))) == 1
    assert one(spark, V.quantized(vec(-1, 0, 1, 5), -1.0, 1.0)) == [0, 128, 255, 255]
    assert one(spark, V.quantized(vec(2, 2), 2.0, 2.0)) == [255, 255]
    assert one(spark, V.dequantized(F.array(F.lit(0), F.lit(255)), -1.0, 1.0)) == pytest.approx([-1, 1])
    assert [V.clamp_threshold(t) for t in (-0.5, 0.4, 1.5)] == [0, 0.4, 1]


@pytest.mark.parametrize("text,lines", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, text, lines):
    assert one(spark, T.line_count(F.lit(text))) == lines


def test_text_functions(spark):
    assert one(spark, T.preview(F.lit("This is a test"), 10)) == "This is a ..."
    assert one(spark, T.preview(F.lit("short"), 10)) == "short"
    assert one(spark, T.location(F.lit("test.rs"), F.lit(1))) == "test.rs:1"
    assert one(spark, T.squeezed(F.lit("  a \n\t b  "))) == "a b"
    assert [one(spark, T.format_bytes(F.lit(n))) for n in (0, 512, 1024, 1536, 1 << 20, 1 << 30)] == ["0.0 B", "512.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB"]
    assert [one(spark, T.backoff_ms(F.lit(a), 100, 2, 1000)) for a in range(4)] == [0, 100, 200, 400]
    assert one(spark, T.backoff_ms(F.lit(9), 100, 2, 250)) == 250
    assert one(spark, T.real_content(F.lit(T.PLACEHOLDER + "a:1]"))) is None
    assert one(spark, T.error_class(F.lit("No files found"))) == "no_files_found" and one(spark, T.error_class(F.lit("x"))) == "generic"
    assert one(spark, T.model_path(F.lit("a/b:c.d"))) == "a_b_c_d"
    assert [one(spark, T.is_model_name(F.lit(n))) for n in ("org/name", "org", "a/b/c", "o/n!")] == [True, False, False, False]
    assert [one(spark, T.language(F.lit(p))) for p in ("a/b.RS", "x.hpp", "x.zzz", "Makefile")] == ["rust", "c", None, None]
    assert [one(spark, T.extension(F.lit(p))) for p in ("a.b/c", ".hidden", ".hidden.rs", "x.tar.gz", "test.")] == ["", "", "rs", "gz", ""]


@pytest.mark.parametrize("text,n", [("100", 100), ("100b", 100), ("2kb", 2048), ("2KB", 2048), ("5mb", 5 << 20), ("1gb", 1 << 30), ("invalid", None), ("2.5mb", None)])
def test_filesize(spark, text, n):
    assert one(spark, T.filesize(F.lit(text))) == n
    if n is None:
        with pytest.raises(ValueError):
            T.parse_filesize(text)
    else:
        assert T.parse_filesize(text) == n


def test_memory_and_device():
    assert T.parse_memory_limit("2GB") == 2 << 30 and T.parse_memory_limit("512.5mb") == int(512.5 * (1 << 20)) and T.parse_memory_limit("100B") == 100
    assert T.parse_device("CUDA") == "cuda"
    for bad in ("100", "x"):
        with pytest.raises(ValueError):
            T.parse_memory_limit(bad)
    with pytest.raises(ValueError):
        T.parse_device("tpu")


# pattern, what it matches, what it doesn't
GLOBS = [
    ("*.toml", ["crate.toml", "a/b/crate.toml", ".keep.toml"], ["crate.TOML", "crate.toml~", "toml"]),
    ("docs/*.adoc", ["docs/a.adoc", "docs/x/y.adoc"], ["other/a.adoc", "docs.adoc"]),
    ("**/zeta", ["zeta", "p/q/zeta"], ["p/zeta.q", "p/q/eta"]),
    ("**/*.kt", ["One.kt", "m/n/Two.kt"], ["One.kts"]),
    ("lib/**", ["lib/u/v", "lib/w"], ["alib/w"]),
    ("*.{c,h}", ["odd.{c,h}"], ["a.c", "a.h"]),
    ("[!q]?.ml", ["xy.ml"], ["qy.ml", "y.ml"]),
    ("[d-f]0", ["d0", "e0", "f0"], ["c0", "g0"]),
    ("größe_?.csv", ["größe_1.csv"], ["grösse_1.csv", "größe_.csv"]),
    ("c++(1).md", ["c++(1).md"], ["cc(1).md", "c++1.md"]),
]


def test_globs(spark):
    paths = sorted({p for _, good, bad in GLOBS for p in good + bad})
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern, good, bad in GLOBS:
        got = {r.path for r in rows.where(G.matches(F.col("path"), pattern)).collect()}
        assert got >= set(good) and not got & set(bad), pattern
    assert rows.where(G.matches(F.col("path"), "[bad")).count() == 0


def test_glob_rules():
    pairs = [("x//y///*.go", "x/y/*.go"), (" ./pkg/**/*.go ", "pkg/**/*.go"), ("**/**/*.tex", "**/*.tex"), ("notes/old/", "notes/old"), ("./*.c", "*.c"), ("**/*/**/*.sql", "**/**/*.sql")]
    assert [G.normalize_glob(a) for a, _ in pairs] == [b for _, b in pairs]
    for bad in ("", "   ", "a\0b", "a\nb", "z" * 1001, "[open", "../up", "a**", "***", "/**" * 6, "[" + "a" * 51 + "]"):
        with pytest.raises(G.GlobError):
            G.validate_glob(bad)
    assert G.validate_glob(" two\tparts.log ") == "two\tparts.log"
    assert [G.normalize_extension(x) for x in ("rs", ".js", "PY", ".TS")] == [".rs", ".js", ".py", ".ts"]
    for bad in ("", "rs.", "r s", "verylongextension"):
        with pytest.raises(G.GlobError):
            G.normalize_extension(bad)
    assert G.describe(None, None) == "No filters active" and G.describe("*.rs", "rs") == "Glob pattern: *.rs, File extension: rs"


def test_extension_filters(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.rs", "b.RS", "c", "test.", "d.rs.bak")], "path string")
    got = lambda c: {r.path for r in rows.where(c).collect()}
    assert got(G.has_extension(F.col("path"), ".rs")) == {"a.rs"}
    assert got(G.has_extension_any_case(F.col("path"), "rs")) == {"a.rs", "b.RS"}
    assert got(G.has_extension(F.col("path"), "")) == {"c", "test."}
    assert got(G.matches_wildcards(F.col("path"), ["*.BAK", "a*"])) == {"a.rs", "d.rs.bak"}
    assert len(got(G.matches_wildcards(F.col("path"), []))) == 5


def test_random_globs_agree_with_a_matcher(spark):
    def match(p, s):
        if not p:
            return not s
        if p.startswith("**/"):
            return match(p[3:], s) or any(match(p[3:], s[i + 1 :]) for i, c in enumerate(s) if c == "/")
        if p[0] == "*":
            return any(match(p[1:], s[i:]) for i in range(len(s) + 1))
        return bool(s) and (p[0] == "?" or p[0] == s[0]) and match(p[1:], s[1:])

    r = random.Random(3)
    paths = ["".join(r.choice("ab/.") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    for _ in range(25):
        pattern = r.choice(["", "**/"]) + "".join(r.choice(["a", "b", "/", ".", "?", "*"]) for _ in range(r.randrange(1, 5)))
        try:
            G.glob_regex(pattern)
        except G.GlobError:
            continue
        assert sorted(x.path for x in rows.where(G.matches(F.col("path"), pattern)).collect()) == sorted(p for p in paths if match(pattern, p)), pattern
