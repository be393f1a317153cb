"""Reports before any queue, and the SMTP sessions that enclose them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.facts import boundary_client, prequeue_action, report_client, usable_time
from loghelm.schema import REF, field

ACTOR = ("instance", "source_id", "origin_id", "pid")


def prequeue_reports(facts: DataFrame) -> DataFrame:
    """One row per rejection or warning that names no queue."""
    rows = facts.withColumn("action", prequeue_action()).where(F.col("action").isNotNull())
    return rows.select(
        *REF,
        "instance",
        "pid",
        usable_time().alias("t"),
        "time_quality",
        "action",
        F.when(F.col("action") == "reject", F.lit("rejected")).otherwise(F.lit("warning")).alias("disposition"),
        field("from").alias("sender"),
        field("to").alias("recipient"),
        field("proto").alias("protocol"),
        field("helo").alias("helo"),
        "message",
        report_client(F.col("action")).alias("client"),
    )


def session_rows(facts: DataFrame) -> DataFrame:
    """Boundary rows (with `edge`) and report rows (with `action`), with instant and client."""
    rows = facts.withColumn("action", prequeue_action())
    bound = (F.col("service") == "smtpd") & F.col("kind").isin("connect", "disconnect") & (F.col("pid") != "")
    rows = rows.withColumn("edge", F.when(bound, F.col("kind"))).where(F.col("edge").isNotNull() | F.col("action").isNotNull())
    rows = rows.withColumns({"t": usable_time(), "client": F.when(F.col("edge").isNotNull(), boundary_client()).otherwise(report_client(F.col("action")))})
    return rows.select(*ACTOR, "start_offset", "end_offset", "edge", "action", "client", "t")


def _segments(facts: DataFrame) -> DataFrame:
    """Session rows, numbered by the boundaries before them in physical order."""
    rows = session_rows(facts)
    w = Window.partitionBy(*ACTOR).orderBy("start_offset")
    return rows.withColumn("segment", F.count("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(facts: DataFrame) -> DataFrame:
    """One row per report with its session's boundaries and, if it is in doubt, the reason.

    A session is the stretch of an actor between a connect and the disconnect that follows. One
    doubt quarantines all reports of the stretch. Reasons are tried in this order: boundaries
    missing or unnamed, clients that differ, boundaries undated, dates that contradict, and then
    the first doubtful report in physical order. Stretches without reports give no rows.
    """
    rows = _segments(facts)
    seg = Window.partitionBy(*ACTOR, "segment")
    edges = rows.where(F.col("edge").isNotNull()).select(*ACTOR, "segment", "edge", "client", "t", "start_offset")
    w = Window.partitionBy(*ACTOR).orderBy("segment")
    edges = edges.select(
        *ACTOR,
        "segment",
        F.col("edge").alias("opener"),
        F.col("client").alias("open_client"),
        F.col("t").alias("open_t"),
        F.col("start_offset").alias("open_start"),
        F.lead("edge").over(w).alias("closer"),
        F.lead("client").over(w).alias("close_client"),
        F.lead("t").over(w).alias("close_t"),
    )
    reports = rows.where(F.col("action").isNotNull())
    met = reports.join(edges, [*ACTOR, "segment"], "left")
    out = F.coalesce(F.col("pid") == "", F.lit(True)) | F.coalesce(F.col("opener") != "connect", F.lit(True)) | (F.coalesce(F.col("open_client"), F.lit("")) == "") | F.coalesce(F.col("closer") != "disconnect", F.lit(True))
    differs = F.max((F.col("client") == "") | (F.col("client") != F.col("open_client"))).over(seg) | (F.col("close_client") == "") | (F.col("close_client") != F.col("open_client"))
    doubt = F.when(F.col("t").isNull(), F.lit("undated")).when((F.col("t") < F.col("open_t")) | (F.col("t") > F.col("close_t")), F.lit("time_conflict"))
    met = met.withColumn("doubt", F.when(doubt.isNotNull(), F.struct("start_offset", doubt.alias("why"))))
    reason = (
        F.when(out, F.lit("boundary_unproven"))
        .when(differs, F.lit("client_mismatch"))
        .when(F.col("open_t").isNull() | F.col("close_t").isNull(), F.lit("undated"))
        .when(F.col("close_t") <= F.col("open_t"), F.lit("time_conflict"))
        .otherwise(F.min("doubt").over(seg)["why"])
    )
    return met.select(*REF, "instance", "pid", "segment", "action", "client", "t", "open_start", "open_t", "close_t", reason.alias("reason"))
