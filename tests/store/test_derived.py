"""Tables that are refreshed where facts changed, against tables worked out of all facts."""

import pytest
from pyspark.sql import functions as F

from loghelm.operators import identity, origin_order
from loghelm.operators.generations import assigned
from loghelm.operators.identity import revision
from loghelm.operators.summaries import summaries
from loghelm.schema import RefusedError
from loghelm.store import derived as derived_module
from loghelm.store.derived import Derived
from loghelm.store.facts_store import CHECKPOINTS, ORIGINS, FactStore
from tests.helpers import INBOUND, facts


def same(store, derived):
    """The kept tables are those that all facts give."""
    assert derived.revision() == revision(store.facts()).first().revision
    want = summaries(assigned(store.facts())).collect()
    assert sorted(map(repr, derived.summaries().select(*want[0].__fields__).collect())) == sorted(map(repr, want))


def test_a_late_fact_rebuilds_one_queue(spark, tmp_path, monkeypatch):
    for f in (origin_order.range_of, origin_order.ordered):
        monkeypatch.setattr(f, "__defaults__", (256,))
    monkeypatch.setattr(derived_module, "RANGE_BYTES", 256)
    store = FactStore(spark, str(tmp_path / "s"))
    derived = Derived(store)
    with pytest.raises(RefusedError, match="absent"):
        derived.summaries()
    queues = [INBOUND.replace("4F1A2B3C4D", f"{i:08X}F") for i in range(10, 16)]
    log = facts(spark, "\n".join(q.strip() for q in queues)).persist()
    starts = sorted(r.start_offset for r in log.where("kind = 'delivery'").select("start_offset").collect())
    late = F.col("start_offset") == starts[2]
    store.commit(log.where(~late))
    first = derived.refresh()
    assert first.whole and derived.summaries().count() == 6
    same(store, derived)
    assert derived.refresh().ranges == 0 and derived.seen() == first.version

    store.commit(log)
    got = derived.refresh()
    assert (got.whole, got.ranges, got.queues, got.folders) == (False, 1, 1, 2)
    same(store, derived)

    assert store.compact()
    before = store.snapshots.current().paths("summaries")
    got = derived.refresh()
    assert (got.ranges, got.queues, got.folders) == (0, 0, 0) and store.snapshots.current().paths("summaries") == before

    # a purge takes facts away, whole ranges of them
    end = log.agg(F.max("end_offset")).first()[0]
    file = ("src", "org", "/var/log/mail.log", 1, 2, "00", "retired")
    store.commit(origins=spark.createDataFrame([file], ORIGINS), checkpoints=spark.createDataFrame([("src", "org", end, "a")], CHECKPOINTS))
    cut = log.where("kind = 'delivery'").agg(F.min("time_utc_ns")).first()[0]
    assert store.purge_retention("mx-a", cut, None).purged == 24
    got = derived.refresh()
    assert not got.whole and got.queues == 6
    same(store, derived)

    # what was seen is cleared away: the tables are built anew
    store.commit(facts(spark, INBOUND, origin="other"))
    store.snapshots.vacuum(keep=0, older_than_s=-5)
    got = derived.refresh()
    same(store, derived)
    assert derived.summaries().count() == 7 and identity.RANGE_KEYS[2] == "range"
    log.unpersist()
