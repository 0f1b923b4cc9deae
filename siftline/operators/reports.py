"""Reports as rows of text with their order; writers sort, nothing is concatenated per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.functions import severity as sev
from siftline.functions.text import loc
from siftline.operators import metrics, ranking
from siftline.operators.catalog import BUG_STAGE
from siftline.schemas import SEVERITY_RANK


def _optional(label: str, column: str):
    return F.when(
        F.coalesce(F.col(column), F.lit("")) != "",
        F.concat(F.lit(f"- **{label}:** "), F.col(column), F.lit("\n")),
    ).otherwise(F.lit(""))


def markdown(findings: DataFrame) -> DataFrame:
    """``file, section, severity_rank, line_number, seq, text``: a heading and one block per finding."""
    s = F.col("severity")
    packed = F.count_if(F.col("stage") == BUG_STAGE)
    heads = findings.groupBy("file").agg(F.count("*").alias("n"), packed.alias("packed")).select(
        "file", F.lit(0).alias("section"), F.lit(0).alias("severity_rank"),
        F.lit(0).alias("line_number"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(
            F.lit("# Review\n**Path:** `"), F.col("file"), F.lit("`\n**Total:** "),
            F.col("n").cast("string"), F.lit(" issues\n**Codex bugs:** "),
            F.col("packed").cast("string"), F.lit("\n"),
        ).alias("text"),
    )
    block = F.concat(
        F.lit("### "), sev.mark(s), F.lit(" "), F.upper(s), F.lit(": "), F.col("type"), F.lit("\n"),
        F.lit("- **File:** `"), F.col("file"), F.lit("` (line "),
        F.col("line_number").cast("string"), F.lit(")\n- **Message:** "), F.col("message"),
        F.lit("\n"), _optional("Fix", "suggestion"), _optional("Stage", "stage"),
    )
    blocks = findings.select(
        "file", F.lit(1).alias("section"), sev.rank(s).alias("severity_rank"), "line_number",
        "seq", block.alias("text"),
    )
    return heads.unionByName(blocks)


def write_markdown(findings: DataFrame, path: str, files_per_write: int | None = None) -> None:
    """Sorted text parts; a file's report may continue in the next part."""
    rows = markdown(findings)
    order = ["file", "section", F.desc("severity_rank"), "line_number", "seq"]
    ranged = rows.repartitionByRange(files_per_write, *order) if files_per_write else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


#: Blocks of a report that make one text.
CHUNK_BLOCKS = 10_000


def markdown_texts(findings: DataFrame, blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """``file, chunk, text``: the report of a file in one text, or in several where it has many findings.

    All blocks are placed in one order and every ``blocks`` places make a chunk, so no text holds more of
    them. Chunk numbers rise by one within a file; they do not begin at zero.
    """
    order = [F.col("file"), F.col("section"), F.desc("severity_rank"), F.col("line_number"), F.col("seq"), F.col("text")]
    placed = ranking.with_position(markdown(findings), order)
    chunk = F.floor((F.col("position") - 1) / F.lit(blocks)).cast("bigint").alias("chunk")
    whole = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY position)").alias("text")
    return placed.groupBy("file", chunk).agg(whole)


def text_summary(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """``part, ord, text``: file and line totals, four severity lines, one line per type."""
    totals = corpus.agg(F.count("*").alias("f"), F.coalesce(F.sum(loc(F.col("content"))), F.lit(0)).alias("l"))
    line = lambda i, label, c: F.struct(
        F.lit(0).alias("part"), F.lit(i).cast("bigint").alias("ord"),
        F.concat(F.lit(label), F.col(c).cast("string")).alias("text"),
    )
    head = totals.select(
        F.inline(F.array(line(0, "Files Analyzed: ", "f"), line(1, "Lines of Code: ", "l")))
    )
    severities = metrics.count_by_severity(findings).select(
        F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("ord"),
        F.concat(F.lit("  "), sev.mark(F.col("severity")), F.lit(" "), F.upper("severity"),
                 F.lit(": "), F.col("count").cast("string")).alias("text"),
    )
    types = metrics.count_by_type(findings).select(
        F.lit(2).alias("part"), (-F.col("count")).alias("ord"),
        F.concat(F.lit("  • "), F.col("type"), F.lit(": "), F.col("count").cast("string")).alias("text"),
    )
    return head.unionByName(severities).unionByName(types)


def text_listing(findings: DataFrame) -> DataFrame:
    """``category, section, file, seq, text``: per type its count, a heading, and a line per finding.

    The lines of a type are ordered by file and emission; no type is gathered in one task.
    """
    # Wording of the listing.
    number = F.coalesce(F.col("line_number").cast("string"), F.lit("?"))
    items = findings.select(
        F.col("type").alias("category"), F.lit(2).alias("section"), "file", "seq",
        F.concat(
            F.lit("  Line "), number, F.lit(": "), F.coalesce("message", F.lit("No message"))
        ).alias("text"),
    )
    name = F.upper(F.coalesce("type", F.lit("")))
    entry = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("text"))
    heads = (
        findings.groupBy("type").agg(F.count("*").cast("string").alias("n"))
        .select(
            F.col("type").alias("category"),
            F.inline(
                F.array(
                    entry(0, F.concat(name, F.lit(": "), F.col("n"))),
                    entry(1, F.concat(name, F.lit(" ISSUES:"))),
                )
            ),
        )
        .select(
            "category", "section", F.lit(None).cast("string").alias("file"),
            F.lit(None).cast("bigint").alias("seq"), "text",
        )
    )
    return heads.unionByName(items)


def comment(corpus: DataFrame, findings: DataFrame, limit: int = 10) -> DataFrame:
    """The whole comment, ordered by ``ord, position``: three totals, then the lines of the findings.

    Without findings one line says so.
    """
    totals = corpus.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(loc(F.col("content"))), F.lit(0)).alias("lines")
    ).withColumn("issues", findings.agg(F.count("*")).scalar())
    # Wording of the head.
    row = lambda label, c: F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |"))
    none = F.when(F.col("issues") == 0, F.lit("✅ **No issues found!**"))
    texts = F.array(
        row("Files Analyzed", "files"), row("Lines of Code", "lines"), row("Issues Found", "issues"), none
    )
    head = totals.select(F.posexplode(texts).alias("position", "text")).filter("text IS NOT NULL")
    head = head.select(F.lit("summary").alias("bucket"), "position", "text", F.lit(0).alias("ord"))
    return head.unionByName(comment_lines(findings, limit))


def comment_lines(findings: DataFrame, limit: int = 10) -> DataFrame:
    """``bucket, position, text``: per severity a heading, its first findings and the remainder."""
    title = F.concat(
        F.lit("### "), sev.mark(F.col("bucket")), F.lit(" "), F.upper("bucket"), F.lit(" ("),
        F.col("bucket_size").cast("string"), F.lit(")"),
    )
    item = F.concat(
        F.lit("- **"), pt.basename(F.coalesce("file", F.lit(""))), F.lit(":"),
        F.coalesce("line_number", F.lit(0)).cast("string"), F.lit("** - "),
        F.coalesce("message", F.lit("")),
    )
    rest = F.concat(F.lit("- ... and "), F.col("more").cast("string"), F.lit(" more"))
    entry = lambda at, text: F.struct(at.cast("int").alias("position"), text.alias("text"))
    first = F.col("position") == 1
    # The first finding of a severity brings the heading and the closing line with it.
    lines = F.array_compact(
        F.array(
            F.when(first, entry(F.lit(0), title)),
            entry(F.col("position"), item),
            F.when(first & (F.col("more") > 0), entry(F.lit(limit + 1), rest)),
        )
    )
    top = ranking.top_per_severity(findings, limit).select("bucket", F.inline(lines))
    order = F.array(*[F.lit(s) for s in SEVERITY_RANK])
    return top.withColumn("ord", F.array_position(order, F.col("bucket")).cast("int"))
