"""Telemetry quality: component scores, grade and recommendations, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.sqltext import lit, struct, when
from telemill.functions.text import instant_text, present
from telemill.operators.policy import has_value
from telemill.session import stable

# Component weights and grade limits.
WEIGHTS = {"coverage": 30, "completeness": 25, "freshness": 25, "schema": 20}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
EVIDENCE = 5
TARGET = 70
GOOD_LINE = "Telemetry quality is within target thresholds."

SOURCES = "source_id string, source_type string, healthy boolean, last_event_at timestamp, events_observed bigint, required boolean"
FIELDS = "field_name string, present bigint, total bigint, required boolean"


def _score(df: DataFrame, name: str, score: str, detail: str, evidence: str) -> DataFrame:
    return df.selectExpr(
        f"{lit(name)} AS component",
        f"cast({score} AS int) AS score",
        f"{WEIGHTS[name]} AS weight",
        f"{detail} AS detail",
        f"{evidence} AS evidence",
    )


def _bounded(df: DataFrame, condition: str, text: str, order: str, most: int = EVIDENCE) -> DataFrame:
    """One row: array of the first few texts (a top-k report)."""
    top = df.filter(condition).orderBy(order).limit(most).selectExpr(f"{order} AS o", f"{text} AS t")
    return top.agg(F.expr("transform(array_sort(collect_list(struct(o, t))), x -> x.t)").alias("_evidence"))


def _fresh(now: str, window: str) -> str:
    return f"last_event_at >= {now} - {window}"


def quality_coverage(sources: DataFrame, now: str, window: str = "INTERVAL 24 HOURS") -> DataFrame:
    """Share of required sources (all, when none is required) that are healthy, active and fresh."""
    good = f"healthy AND events_observed > 0 AND {_fresh(now, window)}"
    counts = sources.agg(
        F.count("*").alias("n_all"),
        F.count_if(F.col("required")).alias("n_req"),
        F.expr(f"count_if({good})").alias("good_all"),
        F.expr(f"count_if(required AND {good})").alias("good_req"),
    )
    # Sources that are only stale are not listed, as they do contribute.
    idle = "NOT (healthy AND events_observed > 0)"
    text = "concat('Source \\'', source_id, '\\' (', source_type, ') not contributing.')"
    lines = _bounded(sources, f"required AND {idle}", text, "source_id").withColumnRenamed("_evidence", "ev_req")
    others = _bounded(sources, idle, text, "source_id").withColumnRenamed("_evidence", "ev_all")
    row = counts.crossJoin(lines).crossJoin(others)
    basis, covered = "IF(n_req > 0, n_req, n_all)", "IF(n_req > 0, good_req, good_all)"
    return _score(
        row,
        "coverage",
        f"IF(n_all = 0, 0, round(100.0D * {covered} / {basis}))",
        f"IF(n_all = 0, 'No sources configured.', concat({covered}, '/', {basis}, ' required sources healthy with recent events.'))",
        "CASE WHEN n_all = 0 THEN array('Register required security sources.') WHEN n_req > 0 THEN ev_req ELSE ev_all END",
    )


def quality_completeness(fields: DataFrame) -> DataFrame:
    """Mean fill rate of the required fields that were seen; 50 without any."""
    seen = fields.filter("required AND total > 0")
    mean = seen.agg(F.expr("avg(100.0D * present / total)").alias("mean"))
    text = "concat('Field \\'', field_name, '\\' present in ', present, '/', total, ' events.')"
    row = mean.crossJoin(_bounded(seen, "100.0D * present / total < 80", text, "field_name"))
    return _score(
        row,
        "completeness",
        "coalesce(round(mean), 50)",
        "IF(mean IS NULL, 'No required field observations supplied.', 'Average required-field fill rate.')",
        "IF(mean IS NULL, array('Provide field completeness samples for actor, action, target and correlation.'), _evidence)",
    )


def quality_freshness(sources: DataFrame, now: str, window: str = "INTERVAL 24 HOURS") -> DataFrame:
    """Share of sources with a timestamp whose last event is inside the window."""
    timed = sources.filter("last_event_at IS NOT NULL")
    counts = timed.agg(F.count("*").alias("n"), F.expr(f"count_if({_fresh(now, window)})").alias("fresh"))
    text = f"concat('Source \\'', source_id, '\\' last event at ', {instant_text('last_event_at')}, '.')"
    row = counts.crossJoin(_bounded(timed, f"NOT ({_fresh(now, window)})", text, "source_id"))
    return _score(
        row,
        "freshness",
        "IF(n = 0, 0, round(100.0D * fresh / n))",
        "IF(n = 0, 'No source timestamps available.', concat(fresh, '/', n, ' sources within freshness window.'))",
        "IF(n = 0, array('Confirm collectors are emitting heartbeats and events.'), _evidence)",
    )


def quality_schema(events: DataFrame, event: str = "event") -> DataFrame:
    """Share of four semantic points per event: actor, target, correlation, action."""
    points = " + ".join(
        f"cast({test} AS int)"
        for test in (
            f"({present(event + '.actor.username')} OR {present(event + '.actor.userId')})",
            f"({event}.target IS NOT NULL)",
            f"({event}.request.correlationId IS NOT NULL OR {event}.request.traceId IS NOT NULL)",
            present(f"{event}.eventAction"),
        )
    )
    row = events.agg(F.count("*").alias("n"), F.expr(f"sum({points})").alias("points"))
    score = "IF(n = 0, 50, round(100.0D * points / (n * 4)))"
    return _score(
        row,
        "schema",
        score,
        "IF(n = 0, 'No sample events supplied for schema quality.', 'Semantic field population across sample events.')",
        when(
            [
                ("n = 0", "array('Include sample events to score actor/target/correlation completeness.')"),
                (f"{score} < 80", "array('Increase actor, target, correlation and action population on emitted events.')"),
            ],
            "cast(array() AS array<string>)",
        ),
    )


def grade(score: str) -> str:
    """Letter of a score."""
    return when([(f"{score} >= {low}", lit(letter)) for low, letter in GRADES], "'F'")


def quality_components(sources: DataFrame, fields: DataFrame, events: DataFrame, now: str, window: str = "INTERVAL 24 HOURS") -> DataFrame:
    """The four component rows.

    Sources and fields have a row per source and field; they are kept in the shared folder, so the events
    behind them are read once for each and not again for every count and piece of evidence.
    """
    sources, fields = stable(sources), stable(fields)
    return (
        quality_coverage(sources, now, window)
        .unionByName(quality_completeness(fields))
        .unionByName(quality_freshness(sources, now, window))
        .unionByName(quality_schema(events))
    )


def quality_report(components: DataFrame) -> DataFrame:
    """One row: overall score, grade and recommendations of four (or fewer) component rows."""
    order = "array_position(array('coverage', 'completeness', 'freshness', 'schema'), component)"
    lines = "transform(evidence, e -> concat(component, ': ', e))"
    return (
        components.agg(
            F.expr("cast(round(sum(score * weight) / sum(weight)) AS int)").alias("overall"),
            F.expr(f"flatten(transform(array_sort(collect_list(IF(score < {TARGET}, struct({order} AS o, {lines} AS l), NULL))), x -> x.l))").alias("_lines"),
        )
        .withColumn("grade", F.expr(grade("overall")))
        .withColumn("recommendations", F.expr(f"IF(size(_lines) = 0, array({lit(GOOD_LINE)}), _lines)"))
        .drop("_lines")
    )


def field_observations(events: DataFrame, fields: Sequence[str], required: Sequence[str] = (), event: str = "event") -> DataFrame:
    """Field completeness rows computed in one pass over the events."""
    counts = [F.expr(f"count_if({has_value(event, f)})").alias(f"n{i}") for i, f in enumerate(fields)]
    row = events.agg(F.count("*").alias("total"), *counts)
    items = ", ".join(struct(field_name=lit(f), present=f"n{i}", required=lit(f in required)) for i, f in enumerate(fields))
    return row.select("total", F.expr(f"inline(array({items}))")).select("field_name", "present", "total", "required")


def source_observations(events: DataFrame, expected: DataFrame, source: str, time: str) -> DataFrame:
    """Source coverage rows: what was seen of every expected source (``source_id, source_type, required``)."""
    seen = events.groupBy(F.col(source).alias("source_id")).agg(F.max(time).alias("last_event_at"), F.count("*").alias("_n"))
    joined = expected.join(seen, "source_id", "left")
    return joined.select(
        "source_id",
        "source_type",
        F.col("_n").isNotNull().alias("healthy"),
        "last_event_at",
        F.coalesce("_n", F.lit(0)).alias("events_observed"),
        "required",
    )


def decision_counts(df: DataFrame, window: str, time: str = "time", decision: str = "decision", by: Sequence[str] = ()) -> DataFrame:
    """Events per time bucket and decision."""
    return (
        df.groupBy(F.window(time, window).alias("_w"), decision, *by)
        .agg(F.count("*").alias("events"))
        .select(F.col("_w.start").alias("bucket"), decision, *by, "events")
    )
