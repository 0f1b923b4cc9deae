from pyspark.sql import functions as F

from conftest import rows
from siftline.operators import linescan, plugins


def long_file(content, path):
    return F.when(
        F.length(content) > 3,
        F.struct(F.lit("low").alias("severity"), F.concat(F.lit("long "), path).alias("message")),
    )


def test_registry_replaces_and_unregisters(corpus):
    registry = plugins.Registry()
    registry.register("x", lambda c: c.limit(0))
    registry.register("x", plugins.column_rules([long_file, long_file]))
    registry.register("y", lambda c: linescan.check_lines(c, "hardcoded_secrets"))
    registry.register("z", lambda c: c)
    registry.unregister("z")
    registry.unregister("none")
    assert registry.names() == ["x", "y"] and registry.get("z") is None
    found = registry.scan(corpus("abcd", "token = 'x'", "a"))
    assert rows(found, "plugin", "file", "message") == [
        ("x", "f0.py", "long f0.py"), ("x", "f0.py", "long f0.py"),
        ("x", "f1.py", "long f1.py"), ("x", "f1.py", "long f1.py"),
        ("y", "f1.py", "Security issue: Hardcoded token"),
    ]


def test_python_rules_yield_at_most_one_finding_per_file(corpus):
    rules = [
        lambda content, path: {"message": f"{len(content)}", "severity": "low"} if "a" in content else None,
        lambda content, path: {"message": path, "line_number": 2} if content.startswith("b") else None,
    ]
    found = plugins.python_rules(rules)(corpus("abc", "b", "ba"))
    assert rows(found, "file", "seq", "message") == [("f0.py", 0, "3"), ("f1.py", 1, "f1.py"), ("f2.py", 0, "2"), ("f2.py", 1, "f2.py")]


def test_rules_are_called_from_sql(spark, corpus):
    rules = [lambda content, path: {"message": path, "severity": "low"} if "a" in content else None]
    plugins.register_rules(spark, "letters", rules)
    found = spark.sql("SELECT * FROM letters(TABLE(SELECT path, content FROM {c}))", c=corpus("abc", "b", "ba"))
    assert rows(found, "file", "rule_no", "message") == [("f0.py", 0, "f0.py"), ("f2.py", 0, "f2.py")]
    none = spark.sql("SELECT * FROM letters(TABLE(SELECT path, content FROM {c} WHERE path = ''))", c=corpus("abc"))
    assert none.count() == 0
