"""Import runs: attempts at finite inputs that can be taken up again.

A run is recorded before anything is read, bound once to content by its digest, advanced by
contiguous records from where the origin's checkpoint stands, and ended as complete or failed.
An ended run never changes. Records, checkpoint and run row of each step are one version, so a
crash leaves a running row that tells exactly how far the run came.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loghelm.functions.scalars import import_origin_id
from loghelm.operators.origin_order import ordered
from loghelm.schema import RefusedError

CHECKPOINTS = "source_id string, origin_id string, offset long, anchor string"
IMPORTS = "run_id string, source_id string, origin_id string, sha256 string, content_bytes long, records long, end_offset long, status string, error string"
ORIGIN = ["source_id", "origin_id"]


def gaps(records: DataFrame, after: int = 0) -> DataFrame:
    """Records that don't start at `expected`: where the one before them in their origin ends, or
    at `after` for the first."""
    rows = ordered(records).withColumn("expected", F.coalesce("previous_end", F.lit(after).cast("long")))
    return rows.where(F.col("expected") != F.col("start_offset")).drop("previous_end", "place")


def with_marks(origins: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Origins with the checkpoint of each; an absent checkpoint is NULL, not offset 0."""
    return origins.join(checkpoints, ORIGIN, "left")


def runs_with_marks(imports: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Import runs with the offset of their origin's checkpoint, and `fault`: '' for a row that can
    be, else what is wrong with it. A later run of the same content may stand further on."""
    met = with_marks(imports, checkpoints.select(*ORIGIN, "offset"))
    at = F.coalesce("end_offset", F.lit(0))
    fault = (
        F.when(~F.col("status").isin("running", "complete", "failed"), "status")
        .when(F.col("origin_id").isNull(), F.when((at != 0) | (F.col("status") == "complete"), "unbound").otherwise(""))
        .when((at < 0) | (at > F.col("content_bytes")), "offset")
        .when((F.col("status") == "complete") & (at != F.col("content_bytes")), "incomplete")
        .when(F.col("offset").isNull() | (F.col("offset") < at), "checkpoint")
        .otherwise("")
    )
    return met.withColumn("fault", fault)


class ImportAttempt:
    """One run of a FactStore. Each step reads the run anew and is refused if another writer was
    first, so the same steps may be sent again after any failure."""

    def __init__(self, store, run_id: str, source_id: str):
        self.store, self.run_id, self.source_id = store, run_id, source_id

    def begin(self) -> Row:
        """The run's row, created if it isn't there. Ended runs come back as they are."""
        base = self.store.snapshots.current()
        found = self.store.import_run(self.run_id, base)
        if found is None:
            found = Row(run_id=self.run_id, source_id=self.source_id, origin_id=None, sha256=None, content_bytes=None, records=0, end_offset=0, status="running", error="")
            self._put(found, base)
        elif found["source_id"] != self.source_id:
            raise RefusedError("import_mismatch", "the run belongs to another source")
        return found

    def bind(self, sha256: str, content_bytes: int) -> Row:
        """Attaches content at the position that its checkpoint proves, 0 if there is none. A run
        that is bound must meet the same content, and its checkpoint at its own end."""
        base, row = self._running()
        origin = self.store.spark.range(1).select(import_origin_id(F.lit(self.source_id), F.lit(sha256))).first()[0]
        mark = self.store.checkpoint(self.source_id, origin, base)
        if mark is not None and (mark[1] != sha256 or mark[0] > content_bytes):
            raise RefusedError("import_resume", "the checkpoint is of other content")
        if row["sha256"] is not None:
            if (row["sha256"], row["content_bytes"]) != (sha256, content_bytes) or mark is None or mark[0] != row["end_offset"]:
                raise RefusedError("import_resume", "other content, or its checkpoint has moved")
            return row
        at = mark[0] if mark else 0
        bound = self._with(row, origin_id=origin, sha256=sha256, content_bytes=content_bytes, end_offset=at)
        self._put(bound, base, checkpoints=self._mark(bound))
        return bound

    def advance(self, records: DataFrame) -> Row:
        """Commits the records that lie beyond the run's end; they must go on from there without
        a gap. Records before it were committed by an earlier step and are left out."""
        base, row = self._running(bound=True)
        fresh = records.where(F.col("start_offset") >= row["end_offset"])
        said = fresh.agg(F.count(F.lit(1)).alias("n"), F.max("end_offset").alias("end"), F.sum((~F.col("origin_id").eqNullSafe(F.lit(row["origin_id"]))).cast("int")).alias("alien")).first()
        if not said["n"]:
            return row
        if said["alien"] or said["end"] > row["content_bytes"]:
            raise RefusedError("import_mismatch", "records of other content")
        if not gaps(fresh, row["end_offset"]).isEmpty():
            raise RefusedError("records_not_contiguous")
        ahead = self._with(row, records=row["records"] + said["n"], end_offset=said["end"])
        self._put(ahead, base, facts=fresh, checkpoints=self._mark(ahead))
        return ahead

    def finish(self, failure: str = "") -> Row:
        """Ends the run: failed with a reason, or complete if every byte was read."""
        base, row = self._running()
        if not failure and (row["sha256"] is None or row["end_offset"] != row["content_bytes"]):
            raise RefusedError("import_unfinished")
        ended = self._with(row, status="failed" if failure else "complete", error=failure)
        self._put(ended, base)
        return ended

    def _running(self, bound: bool = False):
        base = self.store.snapshots.current()
        row = self.store.import_run(self.run_id, base)
        if row is None or (bound and row["sha256"] is None):
            raise RefusedError("import_not_begun" if row is None else "import_unbound")
        if row["status"] != "running":
            raise RefusedError("import_is_final")
        return base, row

    @staticmethod
    def _with(row: Row, **changes) -> Row:
        return Row(**{**row.asDict(), **changes})

    def _mark(self, row: Row) -> DataFrame:
        # the anchor of an import's checkpoint is the digest of its content
        return self.store.spark.createDataFrame([(row["source_id"], row["origin_id"], row["end_offset"], row["sha256"])], CHECKPOINTS)

    def _put(self, row: Row, base, **tables) -> None:
        columns = [c.split()[0] for c in IMPORTS.split(", ")]
        self.store.commit(tables.pop("facts", None), imports=self.store.spark.createDataFrame([tuple(row[c] for c in columns)], IMPORTS), base=base, **tables)


@dataclass(frozen=True)
class Outcome:
    """complete, failed (with its reason), or refused; `left` for runs that never started."""

    run_id: str
    status: str
    error: str = ""


def import_in_order(store, runs: list[tuple[str, Callable[[], None]]], deadline_s: float) -> list[Outcome]:
    """Finite inputs one after the other, as (run id, work), under one deadline for all of them. work
    imports its input into the store. The first that is refused or overruns ends the order: its
    Spark jobs are cancelled, its run stays as far as it came, to be taken up again, and those
    after it never start. An input that fails by itself does not stop the others."""
    context = store.spark.sparkContext
    end, out = time.monotonic() + deadline_s, []
    for i, (run_id, work) in enumerate(runs):
        left = end - time.monotonic()
        tag = f"loghelm-import-{uuid.uuid4().hex}"
        timer = threading.Timer(max(0.0, left), context.cancelJobsWithTag, (tag,))
        context.addJobTag(tag)
        try:
            if left <= 0:
                raise TimeoutError
            timer.start()
            work()
            row = store.import_run(run_id)
            if time.monotonic() >= end and (row is None or row["status"] == "running"):
                raise TimeoutError
            out.append(Outcome(run_id, row["status"] if row else "refused", row["error"] if row else "no run"))
        except Exception as x:
            late = time.monotonic() >= end
            if not late and not isinstance(x, RefusedError):
                raise
            out.append(Outcome(run_id, "deadline" if late else "refused", "" if late else str(x)))
            return out + [Outcome(r, "left") for r, _ in runs[i + 1 :]]
        finally:
            timer.cancel()
            context.removeJobTag(tag)
    return out
