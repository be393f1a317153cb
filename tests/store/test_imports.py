"""Imports in order under one deadline, and runs whose input can't be read for a while."""

import time

import pytest
from pyspark.sql import functions as F

from loghelm.schema import RefusedError
from loghelm.sources.finite import imported, inspect
from loghelm.sources.mail_lines import parse_lines
from loghelm.store.facts_store import FactStore
from loghelm.store.imports import ImportAttempt, import_in_order
from tests.helpers import CTX, INBOUND


def inputs(spark, path):
    r = inspect(spark, [str(path)])
    return r.where(F.col("start_offset").isNull()), parse_lines(imported(r, "hist", "mx-a").drop("path"), CTX)


def test_one_deadline_for_all(spark, tmp_path):
    good, bad = tmp_path / "a.log", tmp_path / "b.log"
    good.write_bytes(INBOUND.strip().encode() + b"\n")
    bad.write_bytes(b"no end")
    store = FactStore(spark, str(tmp_path / "s"))
    started = []

    def work(name, path):
        def go():
            started.append(name)
            store.import_records(name, *inputs(spark, path), "hist")

        return name, go

    def slow():
        started.append("slow")
        wait = F.udf(lambda x: time.sleep(60) or x, "long")
        spark.range(4).select(wait("id")).write.format("noop").mode("overwrite").save()

    got = import_in_order(store, [work("one", good), work("two", bad)], deadline_s=3600)
    assert [(o.run_id, o.status) for o in got] == [("one", "complete"), ("two", "failed")] and got[1].error == "partial_final_line"
    began = time.monotonic()
    got = import_in_order(store, [("slow", slow), work("three", good)], deadline_s=20)
    assert [(o.run_id, o.status) for o in got] == [("slow", "deadline"), ("three", "left")]
    assert time.monotonic() - began < 50 and started == ["one", "two", "slow"] and store.import_run("three") is None
    assert [o.status for o in import_in_order(store, [work("three", good)], 0)] == ["deadline"]


def test_a_bound_run_outlives_a_passing_fault(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(INBOUND.strip().encode() + b"\n")
    store = FactStore(spark, str(tmp_path / "s"))
    head, lines = inputs(spark, path)
    top = head.first()
    run = ImportAttempt(store, "run", "hist")
    run.begin()
    run.bind(top.sha256, top.content_bytes)
    away = head.withColumn("failure", F.lit("invalid_gzip: truncated"))
    with pytest.raises(RefusedError, match="input_unavailable"):
        store.import_records("run", away, lines)
    assert store.import_run("run").status == "running"
    store.import_records("run", head, lines)
    assert store.import_run("run").status == "complete"
