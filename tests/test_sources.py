import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from siftline import session
from siftline.sources import corpus as src
from siftline.sources import exports
from siftline.sources import tree as tree_source


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.py": b"x = 1\r\ny = 2\rz", "sub/b.js": b"let a", "node_modules/c.js": b"no", "sub/build/d.go": b"no",
        "e.txt": b"no", "__init__.py": b"", "_lib/.x y+%41.py": b"p", "bad.rs": b"ok \xff\xfe caf\xc3\xa9", "empty.ts": b"", "big.py": b"#" * 5000,
    }
    root = tmp_path / "venv" / "root"
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def names(df, root):
    return sorted(os.path.relpath(r.path.split("file:")[-1], root) for r in df.select("path").collect())


def test_reads_supported_files_below_the_root(spark, tree):
    found = src.read_files(spark, tree)
    assert names(found, tree) == ["__init__.py", "_lib/.x y+%41.py", "a.py", "bad.rs", "big.py", "empty.ts", "sub/b.js"]
    assert rows(found.where("size = 0"), "content", "error") == [("", None), ("", None)]
    assert [(r.content, r.error) for r in found.where("error is not null").collect()] == [(None, "not UTF-8")]
    first = {r.content: r.language for r in found.collect()}
    assert first["x = 1\ny = 2\nz"] == "python"
    assert first["let a"] == "javascript"


def test_ignoring_decoder_and_size_limit(spark, tree):
    found = src.read_files(spark, tree, errors="ignore", max_bytes=1000)
    assert names(found.where("error is null"), tree) == [
        "__init__.py", "_lib/.x y+%41.py", "a.py", "bad.rs", "empty.ts", "sub/b.js",
    ]
    assert [(r.content, r.error) for r in found.where("error is not null").collect()] == [(None, "too large")]
    assert "ok  café" in {r.content for r in found.collect()}


def test_the_root_is_relative_whatever_its_scheme(spark):
    path = spark.createDataFrame([("hdfs://nn:8020/a/b/c.py",), ("file:/a/b/c.py",)], "p string")
    for root, short in (("hdfs://nn:8020/a", "b/c.py"), ("file:///a/b", "c.py"), ("/a/b/", "c.py")):
        assert short in [r[0] for r in path.select(src.relative(F.col("p"), root)).collect()]


def test_written_files_are_read_back(spark, tmp_path):
    deep = "/".join(f"d{i}" for i in range(12)) + "/z.py"
    wanted = {"a b/ü.py": "x\n", "_p/__init__.py": "", deep: "deep", "build/x.py": "no", "n.py": None}
    df = spark.createDataFrame(list(wanted.items()), "path string, content string")
    root = str(tmp_path / "new root")
    assert tree_source.write_files(df, root) == tree_source.write_files(df, root) == 5
    found = src.read_files(spark, root)
    got = {r.path.split("new root/")[1]: r.content for r in found.collect()}
    assert got == {"a b/ü.py": "x\n", "_p/__init__.py": "", deep: "deep", "n.py": ""}
    with pytest.raises(Exception, match="not below the root"):
        tree_source.write_files(df.withColumn("path", F.lit("../x.py")), root)


def test_an_empty_root_and_linked_folders(spark, tmp_path):
    assert src.read_files(spark, str(tmp_path)).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.py").write_text("1")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    assert names(src.read_files(spark, str(tmp_path)), str(tmp_path)) == ["a/f.py"]


def test_contents_above_the_limit_of_a_row_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "f.py").write_text("12345")
    (tmp_path / "g.py").write_text("1")
    monkeypatch.setattr(tree_source, "MOST_BYTES", 5)
    found = src.read_files(spark, str(tmp_path)).select("content", "size", "error").collect()
    assert {tuple(r) for r in found} == {("1", 1, None), (None, 5, "too large")}


def test_limits(spark, corpus):
    df = corpus("aaa", "b", "cc")
    assert rows(src.first_files(df, 2), "path") == [("f0.py",), ("f1.py",)]
    labelled = src.size_labelled(df, 2)
    assert rows(labelled, "path", "too_large") == [("f0.py", True), ("f1.py", False), ("f2.py", False)]


def test_ignore_file(spark, tmp_path):
    path = tmp_path / "ignore"
    path.write_text("# c\n\n  *.py  \nbuild/\n  # d\n")
    assert rows(src.read_ignore_file(spark, str(path)), "pattern") == [("*.py",), ("build/",)]


def test_exports(spark, tmp_path, findings):
    df = findings(("a.py", 5, "high", "security", 'say "x", y', "static", 0)).withColumn("suggestion", F.lit(None).cast("string"))
    exports.write_json(df, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert rows(back, "file", "line_number", "message") == [("a.py", 5, 'say "x", y')]
    assert "suggestion" in exports.json_records(df).first()[0]
    exports.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.columns == ["Severity", "Type", "File", "Line", "Message", "Suggestion"]
    assert back.first().Message == 'say "x", y'


def test_a_run_written_again_replaces_itself_alone(spark, tmp_path, findings):
    odd = ' lead "q"\r\nnext, \\ end '
    one = findings(("a.py", 5, "high", "security", odd, "static", 0), ("b.py", None, "low", "", None, None, 1))
    one = one.withColumn("suggestion", F.when(F.col("seq") == 0, "").cast("string"))
    none = one.limit(0)
    for write, read, line in (
        (exports.write_json, exports.read_json, "message"), (exports.write_csv, exports.read_csv, "Message"),
    ):
        path = str(tmp_path / write.__name__)
        for df, run in ((one, "7"), (one, "7"), (one, "b-2"), (none, "b-2")):
            write(df, path, run)
        back = read(spark, path)
        assert {r.run for r in back.collect()} == {"7"} and back.count() == 2
        assert {r[line] for r in back.collect()} == {odd, None}
        texts = {r["suggestion" if line == "message" else "Suggestion"] for r in back.collect()}
        assert texts == {"", None}
    with pytest.raises(ValueError):
        exports.write_json(one, str(tmp_path / "x"), "../y")


def test_scan_log_needs_a_start(spark, tmp_path):
    scans = spark.sql(
        "SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:02.5', 3L),"
        "('b', NULL, TIMESTAMP_NTZ'2024-01-01 00:00:02', 1L) AS t(scan_id, start_ts, end_ts, issues)"
    )
    path = str(tmp_path / "log")
    exports.append_scan_log(scans, path)
    exports.append_scan_log(scans, path)
    assert rows(spark.read.parquet(path), "scan_id", "duration") == [("a", 2.5), ("a", 2.5)]
    for run in ("r1", "r2", "r2"):
        exports.append_scan_log(scans, path + "-runs", run)
    assert rows(spark.read.parquet(path + "-runs"), "scan_id", "run") == [("a", "r1"), ("a", "r2")]


def test_the_cluster_names_the_checkpoint_folder(spark):
    assert session.checkpoint_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = session.checkpointed(spark.range(5))
    assert df.count() == 5
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()

