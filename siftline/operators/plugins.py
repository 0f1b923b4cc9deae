"""Named scanners over a corpus, and scanners made of rules."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.ranking import union_all
from siftline.schemas import as_findings

Scanner = Callable[[DataFrame], DataFrame]

_RULE_FIELDS = {
    "file": ("string", pa.string()),
    "line_number": ("int", pa.int32()),
    "severity": ("string", pa.string()),
    "type": ("string", pa.string()),
    "message": ("string", pa.string()),
    "suggestion": ("string", pa.string()),
    "rule_no": ("int", pa.int32()),
}


class Registry:
    """Scanners by name; registering a name again replaces its scanner."""

    def __init__(self) -> None:
        self._scanners: dict[str, Scanner] = {}

    def register(self, name: str, scanner: Scanner) -> None:
        self._scanners[name] = scanner

    def unregister(self, name: str) -> None:
        self._scanners.pop(name, None)

    def get(self, name: str) -> Scanner | None:
        return self._scanners.get(name)

    def names(self) -> list[str]:
        return list(self._scanners)

    def scan(self, corpus: DataFrame) -> DataFrame:
        """Union of the findings of all scanners, each row naming its scanner."""
        return union_all(
            [corpus.transform(s).withColumn("plugin", F.lit(n)) for n, s in self._scanners.items()]
        )


def column_rules(rules: list[Callable[[Column, Column], Column]]) -> Scanner:
    """A scanner of column rules: (content, path) to a finding struct, or NULL for none."""

    def scan(corpus: DataFrame) -> DataFrame:
        found = F.array_compact(F.array(*[r(F.col("content"), F.col("path")) for r in rules]))
        rows = corpus.select(F.col("path").alias("file"), F.posexplode(found).alias("n", "r"))
        return as_findings(rows.select("file", "r.*", F.col("n").cast("bigint").alias("seq")))

    return scan


_ARROW = pa.schema([(name, kind) for name, (_, kind) in _RULE_FIELDS.items()])
_SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in _RULE_FIELDS.items())


def _hits(rules: list[Callable[[str, str], dict | None]], batch: pa.RecordBatch) -> pa.RecordBatch:
    paths, contents = (batch.column(c).to_pylist() for c in ("path", "content"))
    rows = []
    for path, content in zip(paths, contents):
        for n, rule in enumerate(rules):
            hit = rule(content, path)
            if hit:
                rows.append({"file": path, "rule_no": n, **hit})
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def python_rules(rules: list[Callable[[str, str], dict | None]]) -> Scanner:
    """A scanner of Python rules: (content, path) to a dict or nothing; Arrow batches."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_hits(rules, batch) for batch in it)

    def scan(corpus: DataFrame) -> DataFrame:
        hits = corpus.select("path", "content").mapInArrow(batches, _SCHEMA)
        return as_findings(hits.withColumn("seq", F.col("rule_no").cast("bigint")))

    return scan


def register_rules(spark: SparkSession, name: str, rules: list[Callable[[str, str], dict | None]]) -> None:
    """Python rules as a table function: ``SELECT * FROM name(TABLE(SELECT path, content FROM …))``.

    The table is not moved: every task passes its own Arrow batches to the rules.
    """

    class Rules:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield _hits(rules, batch)

    spark.udtf.register(name, F.arrow_udtf(Rules, returnType=_SCHEMA))
