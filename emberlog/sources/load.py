"""One call from a file to split sessions: read or parse, sessionise, label, split."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import parse, sessions, split
from emberlog.session import stage
from emberlog.sources import readers

KINDS = ("hdfs_log", "openstack_log", "hdfs_structured", "openstack_structured", "instances", "sequences")


@dataclass
class Sessions:
    """``heads``: one row per session with label and split; ``chunks``: its events; both are written tables."""

    heads: DataFrame
    chunks: DataFrame

    def part(self, name: str) -> DataFrame:
        """Chunks of one split, with ``label``."""
        return self.chunks.join(self.heads.where(F.col("split") == name).select("session_id", "label"), "session_id")


def _rows(spark: SparkSession, path: str, kind: str, templates: str | None) -> DataFrame:
    """``session_id, line_no, event`` of a log."""
    if kind.endswith("_log") and templates is None:
        raise ValueError("raw logs need a template catalogue")
    family = kind.split("_")[0]
    if kind == "hdfs_log":
        table = parse.structured_hdfs(readers.read_lines(spark, path), readers.read_templates(spark, templates), arguments=False)
    elif kind == "openstack_log":
        patterns = parse.wildcard_patterns(readers.read_wildcard_templates(spark, templates))
        table = parse.structured_openstack(readers.read_lines(spark, path), patterns)
    else:
        table = readers.read_structured(spark, path, family)
    event = F.coalesce("event_id", F.lit("")).alias("event")
    keep = ("line_no", event)
    return sessions.block_rows(table, *keep) if family == "hdfs" else sessions.uuid_rows(table, *keep)


def load_sessions(
    spark: SparkSession,
    path: str,
    kind: str,
    templates: str | None = None,
    labels: str | None = None,
    anomalies: str | None = None,
    train_ratio: float = 0.5,
    split_type: str = "sequential",
    test_ratio: float | None = None,
    balanced: bool = False,
) -> Sessions:
    """Sessions of a raw log, a structured log or an instance file, labelled and split.

    ``labels`` is a table of ids and labels, ``anomalies`` a list of anomalous ids. Instance files
    (``instances`` with ids, which also give the order, ``sequences`` without) bring their labels along.
    Without labels the split can only be sequential; asking for another one warns.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}: one of {', '.join(KINDS)}")
    if kind == "sequences":
        read = readers.read_bare_instances(spark, path)
        whole = read.select(F.concat(F.lit("s"), F.col("row_no").cast("string")).alias("session_id"), F.col("row_no").alias("first_line"), "events", "label")
        whole = stage(whole, "sequences")
        heads = whole.select("session_id", "first_line", F.size("events").cast("bigint").alias("n_events"), "label")
        chunks = sessions.session_chunks(whole.select("session_id", F.posexplode("events").alias("pos", "event")))
    elif kind == "instances":
        read = stage(readers.read_instances(spark, path), "instances")
        # Sessions have no line of their own here: their ids order them.
        facts = read.groupBy("session_id").agg(F.sum(F.size("events")).cast("bigint").alias("n_events"), F.max("label").alias("label"))
        zero = facts.withColumn("first_line", F.lit(0).cast("bigint"))
        heads = sessions.with_seq_no(zero).select("session_id", F.col("seq_no").alias("first_line"), "n_events", "label")
        own = F.posexplode("events").alias("_i", "event")
        place = (F.col("chunk") * sessions.CHUNK_LEN + F.col("_i")).alias("pos")
        chunks = sessions.session_chunks(read.select("session_id", "chunk", own).select("session_id", place, "event"))
    else:
        rows = stage(_rows(spark, path, kind, templates), "session-rows")
        heads = sessions.session_heads(rows)
        if labels is not None:
            heads = sessions.label_from_table(heads, readers.read_labels(spark, labels))
        elif anomalies is not None:
            heads = sessions.label_from_list(heads, readers.read_anomaly_list(spark, anomalies))
        chunks = sessions.session_chunks(sessions.with_positions(rows))
    labelled = labels is not None or anomalies is not None or kind in ("instances", "sequences")
    if not labelled and (split_type != "sequential" or balanced):
        warnings.warn("without labels sessions are split sequentially", stacklevel=2)
    parts = split.split_sessions(heads, train_ratio, split_type, test_ratio, balanced, labelled)
    parts = parts.select("session_id", "first_line", "n_events", "label", "split")
    return Sessions(stage(parts, "heads"), stage(chunks, "chunks"))
