"""Sessions of reports before any queue, as a stream keyed by actor.

The state of an actor is its open stretch: the boundary that opened it, the number of boundaries
so far, and the reports since. A report is given out when it comes, with what is known then (its
stretch is not closed, so it is `boundary_unproven`), and once more when the stretch is closed, as
the batch query over all facts so far would give it. A sink that keeps the last row of each report
(by `batch`) is therefore equal to the batch query after every micro-batch, however the facts are
cut into micro-batches.

The facts of an origin must come in physical order, as the followed file and the store's commits
give them. One that comes before the last boundary of its actor is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loghelm.operators.prequeue import ACTOR, session_rows
from loghelm.schema import REF, RefusedError

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDGE = "segment long, edge string, client string, t long, start_offset long"
REPORT = "start_offset long, end_offset long, action string, client string, t long"
OUT = "source_id string, origin_id string, start_offset long, end_offset long, instance string, pid string, segment long, action string, client string, t long, open_start long, open_t long, close_t long, reason string"


def _none(x):
    return None if x is None or x != x else x


def _int(x) -> int | None:
    return None if _none(x) is None else int(x)


def stretch_reason(pid: str | None, opener: tuple | None, closer: tuple | None, reports: list[tuple]) -> str | None:
    """Why the reports of a stretch are in doubt, as `operators.prequeue.sessions` has it.

    A boundary is (edge, client, t), a report (start_offset, client, t)."""
    if not pid or opener is None or opener[0] != "connect" or not opener[1] or closer is None or closer[0] != "disconnect":
        return "boundary_unproven"
    if any(not c or c != opener[1] for _, c, _ in reports) or not closer[1] or closer[1] != opener[1]:
        return "client_mismatch"
    if opener[2] is None or closer[2] is None:
        return "undated"
    if closer[2] <= opener[2]:
        return "time_conflict"
    for _, _, t in sorted(reports, key=lambda r: r[0]):
        if t is None:
            return "undated"
        if t < opener[2] or t > closer[2]:
            return "time_conflict"
    return None


class Stretches(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edge = handle.getValueState("edge", EDGE)
        self.reports = handle.getListState("reports", REPORT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        instance, source, origin, pid = (_none(k) for k in key)
        held = self.edge.get()
        edge = (0, None, None, None, None) if held is None else (int(held[0]), _none(held[1]), _none(held[2]), _int(held[3]), _int(held[4]))
        out: list[tuple] = []

        def told(reports: list[tuple], closer: tuple | None) -> None:
            opener = None if edge[1] is None else (edge[1], edge[2], edge[3])
            close = None if closer is None else (closer[1], closer[2], closer[3])
            reason = stretch_reason(pid, opener, close, [(r[0], r[3], r[4]) for r in reports])
            for start, end, action, client, t in reports:
                out.append((source, origin, start, end, instance, pid, edge[0], action, client, t, edge[4], edge[3], closer[3] if opener and closer else None, reason))

        came = pd.concat(list(rows), ignore_index=True).sort_values("start_offset", kind="stable")
        if edge[4] is not None and int(came["start_offset"].iloc[0]) <= edge[4]:
            raise RefusedError("out_of_order", f"{source} {origin}: {int(came['start_offset'].iloc[0])}")
        fresh: list[tuple] = []  # reports of this batch in the open stretch
        for start, end, kind, action, client, t in zip(*[came[c] for c in ("start_offset", "end_offset", "edge", "action", "client", "t")], strict=True):
            if _none(kind) is None:
                fresh.append((int(start), int(end), action, _none(client), _int(t)))
                continue
            now = (edge[0] + 1, kind, _none(client), _int(t), int(start))
            before = [(int(r[0]), int(r[1]), r[2], _none(r[3]), _int(r[4])) for r in self.reports.get()] if self.reports.exists() else []
            told(before + fresh, now)
            self.reports.clear()
            edge, fresh = now, []
        if fresh:
            told(fresh, None)
            self.reports.appendList(fresh)
        if edge[0]:
            self.edge.update(edge)
        names = [c.split()[0] for c in OUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({c: "Int64" for c in ("segment", "start_offset", "end_offset", "t", "open_start", "open_t", "close_t")})

    def close(self) -> None:
        pass


def session_stream(facts: DataFrame) -> DataFrame:
    """Reports of a stream of facts with their sessions, each again when its stretch is closed.
    The session must use the RocksDB state store (`use_rocks`)."""
    # instants go as text: pandas would make floats of whole numbers with gaps
    rows = session_rows(facts).withColumn("t", F.col("t").cast("string"))
    return rows.groupBy(*ACTOR).transformWithStateInPandas(Stretches(), OUT, "Append", "None")


def use_rocks(facts: DataFrame) -> None:
    facts.sparkSession.conf.set(STORE, ROCKS)


def latest(given: DataFrame) -> DataFrame:
    """The last row of each report, by `batch`."""
    w = Window.partitionBy(*REF).orderBy(F.desc("batch"))
    return given.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def write_sessions(facts: DataFrame, folder: str, checkpoint: str, poll: str | None = None):
    """Runs the stream into a table whose folders are its micro-batches; one that is repeated after
    a failure replaces what it wrote. `latest(read_sessions(...))` is the answer at any time."""
    use_rocks(facts)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = session_stream(facts).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def read_sessions(spark, folder: str) -> DataFrame:
    return spark.read.schema(OUT + ", batch long").parquet(folder)
