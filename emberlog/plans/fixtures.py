"""Log-shaped views of the ``events`` table: rows per session, raw log text, templates, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, ts, user_id, event_type, value, event, bad, bad200`` — one row per event."""
    return line_columns(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def line_columns(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as line_no",
        "ts",
        "user_id",
        "event_type",
        "value",
        "concat(event_type, ':', least(cast(floor(value / 25) as int), 3)) as event",
        "cast(event_type = 'error' and value > 100 as int) as bad",
        "cast(event_type = 'error' and value > 200 as int) as bad200",
    )


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sessions: everything one user did."""
    lines = event_lines(spark, sf_dir)
    return lines.selectExpr("concat('u', user_id) as session_id", "line_no", "event", "bad200 as bad")


def day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sessions: what one user did on one day."""
    return event_lines(spark, sf_dir).selectExpr(
        "concat('u', user_id, 'd', date_format(ts, 'yyyyMMdd')) as session_id",
        "line_no",
        "event",
        "event_type",
        "bad",
        "date_format(ts, 'HHmmss') as time",
        "cast(user_id as string) as pid",
    )


def _per_type(cases: dict[str, Column]) -> Column:
    out = None
    for name, text in cases.items():
        here = F.col("event_type") == name
        out = F.when(here, text) if out is None else out.when(here, text)
    return out


def hdfs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: block-style log text; purchases name two blocks, signups none."""
    lines = event_lines(spark, sf_dir)
    user = F.col("user_id").cast("string")
    block = F.concat(F.lit("blk_"), user)
    content = _per_type(
        {
            "view": F.concat(F.lit("Receiving block "), block, F.lit(" src: /10.0.0."), user),
            "click": F.concat(F.lit("Verification succeeded for blk_-"), (F.col("user_id") + 1).cast("string")),
            "error": F.concat(F.lit("Got exception while serving "), block, F.lit(" to /10.0.0."), user),
            "purchase": F.concat(
                F.lit("Moved "), block, F.lit(" to blk_"), F.dayofmonth("ts").cast("string"), F.lit(", done")
            ),
            "signup": F.lit("heartbeat"),
        }
    )
    level = F.when(F.col("event_type") == "error", "WARN").otherwise("INFO")
    head = [F.date_format("ts", "yyMMdd"), F.date_format("ts", "HHmmss"), user, level]
    component = F.concat(F.lit("dfs."), "event_type", F.lit(":"))
    return lines.select("line_no", F.concat_ws(" ", *head, component, content).alias("value"))


def hdfs_log_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block log, but a line whose event had the largest value lost its content."""
    peak = event_lines(spark, sf_dir).agg(F.max("value").alias("v")).scalar()
    peaks = event_lines(spark, sf_dir).where(F.col("value") == peak).select("line_no", F.lit(1).alias("cut"))
    value = F.when(F.col("cut") == 1, F.substring_index("value", " ", 5)).otherwise(F.col("value"))
    return hdfs_log(spark, sf_dir).join(peaks, "line_no", "left").select("line_no", value.alias("value"))


def openstack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: service-style log text; signups have no bracket, errors no template."""
    lines = event_lines(spark, sf_dir)
    user = F.col("user_id").cast("string")
    hashed = F.md5(user)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(hashed, a, n) for a, n in cuts])
    request = F.concat(F.lit("[req-"), F.col("line_no").cast("string"), F.lit("]"))
    content = _per_type(
        {
            "click": F.concat(F.lit("[instance: "), uuid, F.lit("] VM Started (Lifecycle Event)")),
            "error": F.concat(F.lit("unexpected failure in "), uuid),
        }
    ).otherwise(F.concat("event_type", F.lit(" done, instance "), uuid, F.lit(" took "), user, F.lit(" ms")))
    rest = F.when(F.col("event_type") == "signup", F.lit("no bracket here")).otherwise(
        F.concat_ws(" ", request, content)
    )
    head = [F.lit("api.log"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), user]
    return lines.select(
        "line_no", F.concat_ws(" ", *head, F.lit("INFO"), F.lit("svc.api"), rest).alias("value")
    )


def templates_hdfs(spark: SparkSession) -> DataFrame:
    """Ordered catalogue; the second entry is shadowed by the first on full lines."""
    rows = [
        (0, r"Receiving block (.*) src: (.*)", [0]),
        (1, r"Receiving (.*)", [0]),
        (2, r"Verification succeeded for (.*)", [0]),
        (3, r"Got exception while serving (.*) to (.*)", [1]),
        (4, r"Moved (.*) to (.*)", [0, 1]),
    ]
    return spark.createDataFrame(rows, "idx int, pattern string, args_keep array<int>")


def templates_openstack(spark: SparkSession) -> DataFrame:
    rows = [
        (0, "[instance: <*>] VM Started (Lifecycle Event)"),
        (1, "<*> done, instance <*> took <*> ms"),
    ]
    return spark.createDataFrame(rows, "idx int, template string")


def block_labels(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``BlockId, Label`` for block rows with ``line_no``: anomalous if a bad line names the block."""
    bad = event_lines(spark, sf_dir).select("line_no", "bad200")
    mark = F.when(F.max("bad200") > 0, "Anomaly").otherwise("Normal")
    return rows.join(bad, "line_no").groupBy(F.col("session_id").alias("BlockId")).agg(mark.alias("Label"))


def anomaly_ids(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``value``: ids of sessions whose lines include an event above 250."""
    high = event_lines(spark, sf_dir).where(F.col("value") > 250).select("line_no")
    return rows.join(high, "line_no").select(F.col("session_id").alias("value")).distinct()
