"""Learning from findings: observations, patterns, retention and learned rules."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import keys
from siftline.functions import severity as sev
from siftline.operators import catalog as cat
from siftline.schemas import PATTERNS

# Retention, examples kept, rule threshold, stage share.
RETENTION_DAYS = 30
EXAMPLES = 3
RULE_MIN_COUNT = 3
PRIORITY_SHARE = 0.3
TOP = 10


def observations(findings: DataFrame, *more: str) -> DataFrame:
    """One observation per finding; needs ``language`` and ``ts`` beside the finding."""
    return findings.select(
        "seq",
        keys.pattern_key(F.col("type"), F.col("message")).alias("pattern_key"),
        "language",
        F.col("file").alias("file_path"),
        "severity", "message", "ts", "stage", *more,
    )


#: What a row of counts counts: all observations of a key, or those with a language, a severity or a message.
ALL, LANGUAGE, SEVERITY, MESSAGE = range(4)


def review_observations(findings: DataFrame, language: Column, ts: Column) -> DataFrame:
    """Observations of reviewed files, with their ``place`` in the log.

    A review lists a file's findings by severity, then line; the position of a scan counts inside a
    file, so the place begins with the file. Equal places are equal in all that is counted.
    """
    place = F.struct("file", (-sev.rank(F.col("severity"))).alias("rank"), F.col("line_number").alias("line"), "message")
    noted = findings.withColumn("language", language).withColumn("ts", ts)
    return observations(noted.withColumn("place", place), "place")


def counted(obs: DataFrame, order: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every key (in each group of ``by``) and of its languages, severities and messages.

    Columns ``pattern_key``, ``kind``, ``value``, ``n``, ``first`` (least ``order``), ``first_ts``, ``last_ts``. One
    grouped pass, so a key that holds a large share of the observations is reduced inside each task
    before anything moves. Rows of several such tables can be merged by :func:`merged`.
    """
    own = [*by, "pattern_key"]
    rows = obs.groupingSets(
        [own, [*own, "language"], [*own, "severity"], [*own, "message"]], *own, "language", "severity", "message"
    ).agg(
        F.grouping_id().bitwiseAND(F.lit(0b111)).alias("g"),
        F.count("*").alias("n"),
        F.min(order).alias("first"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    # grouping_id bits: language, severity, message (1 = rolled up).
    g = F.col("g")
    kind = F.when(g == 0b011, LANGUAGE).when(g == 0b101, SEVERITY).when(g == 0b110, MESSAGE).otherwise(ALL)
    value = F.when(g == 0b011, F.col("language")).when(g == 0b101, F.col("severity")).when(g == 0b110, F.col("message"))
    return rows.select(*own, kind.alias("kind"), value.alias("value"), "n", "first", "first_ts", "last_ts")


def partials(obs: DataFrame, order: str, by: tuple[str, ...]) -> DataFrame:
    """:func:`counted` with the first messages only: bounded by the languages and severities of a key.

    The first messages over several groups are among the first ones of each, so the partials of any
    groups can be merged, and a group can be taken away by leaving its rows out.
    """
    rows = counted(obs, order, by)
    w = Window.partitionBy(*by, "pattern_key", "kind").orderBy("first", "value")
    first = rows.filter(F.col("kind") == MESSAGE).withColumn("rn", F.row_number().over(w))
    return rows.filter(F.col("kind") != MESSAGE).unionByName(first.filter(F.col("rn") <= EXAMPLES).drop("rn"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("pattern_key", "kind", "value").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def finished(counts: DataFrame) -> DataFrame:
    """Per key: count, first and last sighting, modal language and severity, first messages.

    The most frequent value wins, of equally frequent ones the first seen, then the smaller one.
    """
    kind = F.col("kind")
    w = Window.partitionBy("pattern_key", "kind").orderBy(
        F.when(kind == MESSAGE, F.lit(0)).otherwise(-F.col("n")), "first", "value"
    )
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= EXAMPLES)
    pick = lambda of, col: F.max(F.when((kind == of) & (F.col("rn") == 1), F.col(col)))
    message = F.when(kind == MESSAGE, F.struct("first", "value"))
    return top.groupBy("pattern_key").agg(
        pick(LANGUAGE, "value").alias("language"),
        pick(ALL, "n").alias("count"),
        pick(ALL, "first_ts").alias("first_seen"),
        pick(ALL, "last_ts").alias("last_seen"),
        pick(SEVERITY, "value").alias("typical_severity"),
        # At most EXAMPLES messages reach a group.
        F.transform(F.array_sort(F.collect_list(message)), lambda s: s["value"]).alias("example_messages"),
    )


def grouped_patterns(obs: DataFrame, order: str = "seq") -> DataFrame:
    """The patterns of a log of observations, first seen by the column ``order``."""
    return finished(counted(obs, order))


#: What an update renews.
RENEWED = ("count", "last_seen", "typical_severity", "example_messages")


def upsert(patterns: DataFrame, obs: DataFrame) -> DataFrame:
    """Stored patterns after one consolidation, with ``outcome`` new, updated or kept.

    Known keys get count, last sighting, severity and examples of the log; language, first
    sighting, suggestion and the rule flag stay. ``changed`` marks rows that are not as stored.
    """
    return upsert_fresh(patterns, grouped_patterns(obs))


def upsert_fresh(patterns: DataFrame, fresh_patterns: DataFrame) -> DataFrame:
    """:func:`upsert` with the patterns of the log at hand."""
    p, n = patterns.alias("p"), fresh_patterns.alias("n")
    joined = p.join(n, F.col("p.pattern_key") == F.col("n.pattern_key"), "full_outer")
    old = F.col("p.pattern_key").isNotNull()
    fresh = F.col("n.pattern_key").isNotNull()
    prefer_new = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    prefer_old = lambda c: F.when(old, F.col(f"p.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(
        prefer_old("pattern_key"), prefer_old("language"), prefer_new("count"),
        prefer_old("first_seen"), prefer_new("last_seen"), prefer_new("typical_severity"),
        prefer_new("example_messages"),
        F.col("p.suggestion").alias("suggestion"),
        F.coalesce(F.col("p.custom_rule_generated"), F.lit(False)).alias("custom_rule_generated"),
        F.when(old & fresh, "updated").when(old, "kept").otherwise("new").alias("outcome"),
        (fresh & ~reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in RENEWED])).alias("changed"),
    )


def as_patterns(upserted: DataFrame) -> DataFrame:
    return upserted.select(*[F.col(f.name).cast(f.dataType) for f in PATTERNS.fields])


def is_retained(now: str, ts: str = "ts") -> Column:
    return F.col(ts) > F.expr(f"TIMESTAMP_NTZ'{now}' - INTERVAL {RETENTION_DAYS} DAYS")


def retained(obs: DataFrame, now: str) -> DataFrame:
    return obs.filter(is_retained(now))


def consolidation_summary(upserted: DataFrame, obs: DataFrame, now: str) -> DataFrame:
    """One row: new, updated, total patterns; pruned, remaining observations."""
    counts = upserted.agg(
        F.count_if(F.col("outcome") == "new").alias("new_patterns"),
        F.count_if(F.col("outcome") == "updated").alias("updated_patterns"),
        F.count("*").alias("total_consolidated"),
    )
    log = obs.agg(
        F.count_if(~is_retained(now)).alias("observations_pruned"),
        F.count_if(is_retained(now)).alias("observations_remaining"),
    )
    # Both sides are one row.
    return counts.withColumn("k", F.lit(1)).join(log.withColumn("k", F.lit(1)), "k").drop("k")


def hot_patterns(patterns: DataFrame, language: str | None = None, limit: int = TOP) -> DataFrame:
    chosen = patterns.filter(F.col("language") == language) if language else patterns
    order = [F.desc("count"), F.asc("first_seen"), F.asc("pattern_key")]
    first = chosen.orderBy(*order).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def project_summary(obs: DataFrame, patterns: DataFrame, order: str = "seq") -> DataFrame:
    """Totals, all severities, top languages and top keys, as (section, key, n, position).

    Of equally frequent ones the first seen by ``order`` comes first, then the smaller one.
    """
    counted = obs.groupingSets(
        [["severity"], ["language"], ["pattern_key"], []], "severity", "language", "pattern_key"
    ).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min(order).alias("first_seq"))
    g = F.col("g")
    section = (
        F.when(g == 0b011, "severity").when(g == 0b101, "language")
        .when(g == 0b110, "pattern").otherwise("total_observations")
    )
    key = F.when(g == 0b011, F.col("severity")).when(g == 0b101, F.col("language")).when(
        g == 0b110, F.col("pattern_key")
    ).otherwise(F.lit(""))
    zero = obs.sparkSession.range(1).selectExpr(
        "'total_observations' AS section", "'' AS key", "0L AS n",
        f"CAST(NULL AS {obs.schema[order].dataType.simpleString()}) AS first_seq",
    )
    # The total is reported for an empty log too.
    rows = (
        counted.select(section.alias("section"), key.alias("key"), "n", "first_seq")
        .unionByName(zero)
        .groupBy("section", "key")
        .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    )
    w = Window.partitionBy("section").orderBy(F.desc("n"), "first_seq", "key")
    top = (
        rows.filter("section != 'severity'")
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= TOP)
    )
    severities = rows.filter("section = 'severity'").withColumn("position", F.lit(None).cast("int"))
    total = patterns.agg(F.count("*").alias("n")).select(
        F.lit("unique_patterns").alias("section"), F.lit("").alias("key"), "n",
        F.lit(1).alias("position"),
    )
    cols = ["section", "key", "n", "position"]
    return top.select(cols).unionByName(severities.select(cols)).unionByName(total)


def priorities(patterns: DataFrame, types: list[str], share: float = PRIORITY_SHARE) -> DataFrame:
    """Per language and type prefix: is its share of the language's findings above ``share``."""
    total = F.sum("count")
    per_type = F.array(
        *[
            F.struct(
                F.lit(t).alias("type"),
                F.coalesce(
                    F.sum(F.when(F.startswith("pattern_key", F.lit(t + ":")), F.col("count"))),
                    F.lit(0),
                ).alias("type_total"),
            )
            for t in types
        ]
    )
    grouped = patterns.groupBy("language").agg(total.alias("total"), per_type.alias("t"))
    return grouped.select("language", "total", F.inline("t")).withColumn(
        "prioritise",
        F.when(F.col("total") == 0, F.lit(False)).otherwise(
            F.col("type_total") / F.col("total") > share
        ),
    )


def should_prioritise(patterns: DataFrame, issue_type: str, language: str) -> DataFrame:
    """One row, also for a language without patterns (false)."""
    of = F.col("language") == language
    total = F.coalesce(F.sum(F.when(of, F.col("count"))), F.lit(0))
    part = F.coalesce(
        F.sum(F.when(of & F.startswith("pattern_key", F.lit(issue_type + ":")), F.col("count"))),
        F.lit(0),
    )
    answer = F.when(total == 0, F.lit(False)).otherwise(part / total > PRIORITY_SHARE)
    return patterns.agg(answer.alias("prioritise"))


def rules(patterns: DataFrame, min_count: int = RULE_MIN_COUNT) -> DataFrame:
    """Rules of the patterns seen often enough that have none yet."""
    key = F.col("pattern_key")
    has = lambda name: F.contains(key, F.lit(name))
    seen = F.concat(F.lit(" (seen "), F.col("count").cast("string"), F.lit("x"))
    where = F.concat(F.lit(" in "), F.col("language"), F.lit(")"))

    # The three rule templates.
    def template(kind, message, suggestion, pattern):
        return F.struct(
            F.lit(kind).alias("type"), message.alias("message"),
            F.lit(suggestion).alias("suggestion"),
            F.lit(pattern).cast("string").alias("pattern"),
        )

    rule = (
        F.when(
            has("hardcoded_secret"),
            template("regex", F.concat(F.lit("Learned pattern: hardcoded secret"), seen, where),
                     "Use environment variables or a secrets manager", cat.LEARNED_SECRET),
        )
        .when(
            has("unused_import"),
            template("ast", F.concat(F.lit("Learned pattern: unused import"), seen, where),
                     "Remove unused imports to keep code clean", None),
        )
        .when(
            has("empty_except"),
            template("regex", F.concat(F.lit("Learned pattern: empty except block"), seen, F.lit(")")),
                     "Handle the exception or at minimum log it", cat.LEARNED_EXCEPT),
        )
    )
    due = patterns.filter((F.col("count") >= min_count) & ~F.col("custom_rule_generated"))
    return due.withColumn("r", rule).filter("r IS NOT NULL").select(
        "pattern_key",
        F.concat(F.lit("learned_"), key).alias("id"),
        F.col("r.type").alias("type"),
        F.col("typical_severity").alias("severity"),
        "r.message", "r.suggestion", "r.pattern",
        F.array("language").alias("languages"),
    )


def flag_generated(patterns: DataFrame, emitted: DataFrame) -> DataFrame:
    done = emitted.select("pattern_key", F.lit(True).alias("done"))
    return (
        patterns.join(done, "pattern_key", "left")
        .withColumn("custom_rule_generated", F.col("custom_rule_generated") | F.coalesce("done", F.lit(False)))
        .drop("done")
    )
