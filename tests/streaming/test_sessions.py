"""Sessions as a stream, cut into micro-batches anywhere, against the batch query."""

import random

import pytest
from pyspark.sql import functions as F

from loghelm.operators.prequeue import sessions
from loghelm.schema import FACT
from loghelm.streaming.sessions import latest, read_sessions, stretch_reason, write_sessions
from tests.helpers import facts


def some_lines(rng, n):
    out = []
    for i in range(n):
        pid, host = rng.randrange(3), rng.choice(["a.example[192.0.2.1]", "b.example[192.0.2.2]"] if rng.random() < 0.06 else ["a.example[192.0.2.1]"])
        at = f"Oct  1 10:{i // 60 % 60:02d}:{i % 60:02d}" if rng.random() < 0.88 else "Oct  1 09:00:00"
        kind = rng.random()
        text = f"connect from {host}" if kind < 0.25 else f"disconnect from {host} ehlo=1" if kind < 0.5 else f"NOQUEUE: reject: RCPT from {host}: 554 5.7.1 no; from=<a@x> to=<b@y> proto=ESMTP helo=<h>"
        out.append(f"{at} mx postfix/smtpd[{pid}]: {text}")
    return "\n".join(out)


def test_any_cut_gives_the_rows_of_the_batch_query(spark, tmp_path):
    rng = random.Random(9)
    df = facts(spark, some_lines(rng, 140)).drop("event_id").persist()
    want = sorted(map(repr, sessions(df).collect()))
    reasons = {r.reason for r in sessions(df).collect()}
    assert {None, "boundary_unproven", "client_mismatch", "time_conflict"} <= reasons
    starts = sorted(r.start_offset for r in df.select("start_offset").collect())
    cuts = [0, *sorted(rng.sample(starts[1:], 4)), starts[-1] + 1]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where(F.col("start_offset").between(a, b - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        # the query is started anew for each part, from its checkpoint
        stream = spark.readStream.schema(FACT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        write_sessions(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = latest(read_sessions(spark, f"{tmp_path}/out"))
        so_far = sessions(df.where(F.col("start_offset") < b))
        assert sorted(map(repr, got.select(*so_far.columns).collect())) == sorted(map(repr, so_far.collect()))
    assert sorted(map(repr, got.select(*so_far.columns).collect())) == want
    df.where(F.col("start_offset") == starts[3]).write.parquet(f"{tmp_path}/in/late")
    with pytest.raises(Exception, match="out_of_order"):
        write_sessions(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    df.unpersist()


def test_reasons_in_their_order():
    opened, closed = ("connect", "h[1]", 10), ("disconnect", "h[1]", 20)
    assert stretch_reason("7", opened, closed, [(1, "h[1]", 15)]) is None
    assert stretch_reason("", opened, closed, []) == stretch_reason("7", None, closed, []) == stretch_reason("7", opened, None, []) == "boundary_unproven"
    assert stretch_reason("7", ("disconnect", "h[1]", 1), closed, []) == stretch_reason("7", opened, opened, []) == stretch_reason("7", ("connect", "", 1), closed, []) == "boundary_unproven"
    assert stretch_reason("7", opened, closed, [(1, "", 15)]) == stretch_reason("7", opened, ("disconnect", "g[2]", None), []) == "client_mismatch"
    assert stretch_reason("7", opened, ("disconnect", "h[1]", None), []) == "undated"
    assert stretch_reason("7", opened, ("disconnect", "h[1]", 10), []) == "time_conflict"
    assert stretch_reason("7", opened, closed, [(5, "h[1]", None), (4, "h[1]", 99)]) == "time_conflict"
    assert stretch_reason("7", opened, closed, [(3, "h[1]", None), (4, "h[1]", 99)]) == "undated"
