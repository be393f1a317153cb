"""Structured Streaming ingestion: followed files to stored facts, with the effect of once."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loghelm.sources.envelope import TimeContext
from loghelm.sources.follow import MARK, LogFileSource
from loghelm.sources.mail_lines import parse_lines
from loghelm.sources.recovery import stored_origins
from loghelm.store.facts_store import CHECKPOINTS, ORIGINS, FactStore


def read_log(spark: SparkSession, path: str, source_id: str, store: FactStore | None = None, **options: str) -> DataFrame:
    """Lines of a followed path. A query without a checkpoint of its own goes on from the origins
    that `store` holds of the source, all of them or none; else it starts afresh."""
    spark.dataSource.register(LogFileSource)
    if store is not None:
        options["stored"] = json.dumps([asdict(o) for o in stored_origins(store, source_id)])
    reader = spark.readStream.format("loghelm_log").option("path", path).option("sourceId", source_id)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def ingest(lines: DataFrame, store: FactStore, ctx: TimeContext, checkpoint: str, poll: str | None = "1 second") -> StreamingQuery:
    """Each micro-batch is parsed and committed whole, with the states and anchors of the origins
    that it changes. A batch that Spark repeats after a failure meets its own records in the store
    and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # a batch is bounded by the source; its files are read once
        facts = parse_lines(batch.where("origin is null").drop("read_error", "origin"), ctx)
        marks = batch.where("origin is not null").select("source_id", "origin_id", F.from_json("origin", MARK).alias("o")).select("source_id", "origin_id", "o.*")
        rows = [r.asDict() for r in marks.collect()]  # one row per origin that changed
        table = lambda shape: store.spark.createDataFrame([tuple(r[c.split()[0]] for c in shape.split(", ")) for r in rows], shape)
        store.commit(facts, origins=table(ORIGINS), checkpoints=table(CHECKPOINTS), notes={"last_batch": batch_id})
        batch.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()
