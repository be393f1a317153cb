"""Asserted succession of origins, checked as a whole."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.operators.identity import queue_instances
from loghelm.schema import MAX_BOUNDARIES, RefusedError

#: (source_id, from_origin, from_end, to_origin, to_start)
BOUNDARY = "source_id string, from_origin string, from_end long, to_origin string, to_start long"


def extremities(facts: DataFrame) -> DataFrame:
    """First and last provenance of each origin: two extremes, combined before the shuffle."""
    first = F.min(F.struct("start_offset", "end_offset"))
    last = F.max(F.struct("start_offset", "end_offset"))
    return facts.groupBy("source_id", "origin_id").agg(first["start_offset"].alias("first_start"), last["end_offset"].alias("last_end"), F.min("instance").alias("instance"), F.max("instance").alias("instance_hi"))


def check_claims(facts: DataFrame, boundaries: list[tuple[str, str, int, str, int]]) -> list[tuple]:
    """The claims in canonical order, or RefusedError for the first that does not hold.

    A claim joins the end of one origin to the start (0) of another origin of the same source and
    instance; no origin has two successors or two predecessors, and no chain comes back.
    """
    if len(boundaries) > MAX_BOUNDARIES:
        raise RefusedError("too_many_boundaries")
    claims = sorted(set(boundaries))
    if len(claims) != len(boundaries):
        raise RefusedError("duplicate_boundary")
    spark: SparkSession = facts.sparkSession
    claimed = F.broadcast(spark.createDataFrame(claims, BOUNDARY))  # at most MAX_BOUNDARIES rows
    ends = extremities(facts)
    a = ends.select("source_id", F.col("origin_id").alias("from_origin"), F.col("last_end").alias("seen_end"), F.col("instance").alias("from_instance"))
    b = ends.select("source_id", F.col("origin_id").alias("to_origin"), F.col("first_start").alias("seen_start"), F.col("instance").alias("to_instance"))
    met = a.join(claimed, ["source_id", "from_origin"]).join(F.broadcast(b.join(F.broadcast(claimed.select("source_id", "to_origin").distinct()), ["source_id", "to_origin"])), ["source_id", "to_origin"])
    good = met.where((F.col("from_origin") != F.col("to_origin")) & (F.col("from_end") == F.col("seen_end")) & (F.col("to_start") == 0) & (F.col("seen_start") == 0) & (F.col("from_instance") == F.col("to_instance")))
    if good.count() != len(claims):
        raise RefusedError("boundary_unproven")
    after = {(s, f): t for s, f, _, t, _ in claims}
    if len(after) != len(claims) or len({(s, t) for s, _, _, t, _ in claims}) != len(claims):
        raise RefusedError("ambiguous_succession")
    for s, f in after:
        at, steps = f, 0
        while (s, at) in after:
            at, steps = after[s, at], steps + 1
            if at == f or steps > len(claims):
                raise RefusedError("cyclic_succession")
    return claims


def chains(claims: list[tuple]) -> list[list[tuple[str, str]]]:
    """Origins in order of succession, one list per chain."""
    after = {(s, f): (s, t) for s, f, _, t, _ in claims}
    out = []
    for head in sorted(set(after) - set(after.values())):
        chain = [head]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        out.append(chain)
    return out


def plan_digest(revision: str, claims: list[tuple]) -> str:
    h = hashlib.sha256(b"loghelm-continuity-1")
    for part in (revision, *[str(x) for c in claims for x in c]):
        raw = part.encode()
        h.update(struct.pack(">Q", len(raw)) + raw)
    return h.hexdigest()


def instances_with_continuity(gens: DataFrame, revision: str, facts: DataFrame, boundaries: list[tuple]) -> DataFrame:
    """Queue instances under a revision that also covers the claims; generations are not merged."""
    claims = check_claims(facts, boundaries)
    return queue_instances(gens).withColumn("revision", F.lit(plan_digest(revision, claims)))
