"""Queries read what they need once, and deal it to many tasks."""

from pathlib import Path

import pytest

from loghelm import catalog, stored
from loghelm.store.facts_store import FactStore
from loghelm.views import event_facts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def several(spark, tmp_path):
    """The smallest events, in three files."""
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_parts_of_the_stream_are_written_by_several_tasks(spark, several, monkeypatch):
    folder = f"{several}/store"
    monkeypatch.setattr(stored, "new_folder", lambda spark: folder)
    stored.sessions_streamed(spark, several).count()
    assert all(len(list(Path(f"{folder}/in/{k}").glob("part-*"))) > 1 for k in range(3))
    assert sorted(p.name for p in Path(f"{folder}/out").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]


def test_timelines_do_not_read_the_events_again(spark, monkeypatch):
    read = []
    timeline = catalog.timeline
    monkeypatch.setattr(catalog, "timeline", lambda facts, *a, **kw: read.extend(facts.inputFiles()) or timeline(facts, *a, **kw))
    catalog.candidate_timeline(spark, "/root/testdata/sf0.01")
    assert read and not any("events.parquet" in f for f in read)


def test_a_commit_meets_stored_facts_once(spark, several, monkeypatch):
    plans = []
    written = FactStore._written
    monkeypatch.setattr(FactStore, "_written", lambda self, rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or written(self, rows, *a))
    store = FactStore(spark, f"file://{several}/facts")
    rows = event_facts(spark.read.parquet(f"{several}/events.parquet"))
    store.commit(rows.where("event_id % 2 = 0"))
    store.commit(rows)
    assert len(plans) == 2 and not any("old_end" in p for p in plans)
    assert store.facts().count() == rows.count()
