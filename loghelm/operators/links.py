"""Queue hints, and the links they support between two generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.facts import delivery, is_queued, projects_delivery, queue_hint, usable_time
from loghelm.operators.generations import assigned
from loghelm.operators.partition import message_id
from loghelm.schema import GENERATION, MAX_BINDINGS, MAX_LINK_WINDOW_NS, QUEUE, REF, RefusedError, field

KNOWN = ("sent", "delivered", "deferred", "bounced")


def hints(facts: DataFrame, *more: str) -> DataFrame:
    """One row per explicit native report of another queue id, with the columns `more` of its fact."""
    # inline keeps the wide expression in one place: no filter or projection is merged into it
    found = F.filter(F.array(queue_hint()), lambda h: h.isNotNull())
    rows = facts.where(F.col("kind").isin("bounce", "delivery"))
    out = rows.select(*REF, "instance", "queue_id", usable_time().alias("t"), field("to").alias("recipient"), *more, F.inline(found))
    return out.withColumnRenamed("kind", "hint_kind")


def check_options(window_ns: int, bindings: Sequence[tuple[str, str, str]]) -> None:
    if not 0 < window_ns <= MAX_LINK_WINDOW_NS:
        raise RefusedError("invalid_link_options", "window")
    if len(bindings) > MAX_BINDINGS or len({b[:2] for b in bindings}) != len(bindings) or not all(all(b) for b in bindings):
        raise RefusedError("invalid_link_options", "bindings")


def _queues(rows: DataFrame) -> DataFrame:
    """One row per queue: `doubt`, whether a stream of it was refused, and its generations (`gens`),
    each with its extremes and flags, its sender and message id where observed values agree (else
    NULL), the facts that prove them, its hints, and the deliveries that it reports as known.

    All is nested in the key of the queue, by which the rows are partitioned already. Both
    sides of the links read the exchange at the end, so nothing here may tell them apart: no
    lambda is used before it, and the filters that either side implies are stated.
    """
    resolved = F.col("reason") == "resolved"
    sender = F.when((F.col("service") == "qmgr") & (F.col("kind") == "message"), field("from"))
    d = delivery()
    known = F.when(resolved & projects_delivery() & d["status"].isin(*KNOWN), F.struct(d["recipient"].alias("address"), F.struct(*REF).alias("proof")))
    r = rows.withColumns({"sender": sender, "mid": message_id(), "known": known, "h": F.when(F.col("kind").isin("bounce", "delivery"), queue_hint())})
    hint = F.when(F.col("h").isNotNull(), F.struct(*REF, "t", field("to").alias("recipient"), "h"))

    def agreed(c: str):
        return F.when(F.min(c) == F.max(c), F.min(c)).alias(c)

    place = F.struct("place", *REF)
    per = r.groupBy(*GENERATION, "reason").agg(
        F.min("t").alias("first_t"),
        F.max("receipt").alias("receipt"),
        F.max(F.col("time_quality") != "explicit_offset").alias("non_explicit"),
        F.first("cross_stream").alias("cross"),
        agreed("sender"),
        agreed("mid"),
        F.coalesce(F.min("mid") != F.max("mid"), F.lit(False)).alias("mids_differ"),
        F.array_compact(F.array(F.min(F.when(F.col("sender").isNotNull(), place)), F.min(F.when(F.col("mid").isNotNull(), place)))).alias("proofs"),
        F.collect_list(hint).alias("hints"),
        F.collect_list("known").alias("deliveries"),
    )
    gen = F.struct(F.struct(*GENERATION).alias("gid"), *[c for c in per.columns if c not in GENERATION])
    per = per.where(F.col("instance").isNotNull() & F.col("queue_id").isNotNull())
    # an exchange by the whole key would be left out, as the rows lie by it already
    return per.groupBy(*QUEUE).agg(F.max(~resolved).alias("doubt"), F.collect_list(gen).alias("gens")).repartition("queue_id")


def links(facts: DataFrame, window_ns: int, bindings: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """One row per hint: state, reason, source and target generations, and evidence.

    Only the queues that a hint is of or points to are assigned to generations, once. Bindings
    (instance, relay, target instance) are a checked handful and are broadcast; every other join
    is on queue keys.
    """
    check_options(window_ns, bindings)
    bind = facts.sparkSession.createDataFrame([tuple(b) for b in bindings], "instance string, relay string, bound string")
    to = F.coalesce("target_instance", F.when(F.col("hint_kind") == "smtp_queue_hint", F.col("bound"))).alias("to_instance")

    def bound(src: DataFrame) -> DataFrame:
        return src.join(F.broadcast(bind), ["instance", "relay"], "left").select("*", to).drop("bound")

    asked = bound(hints(facts))
    keys = asked.select(*QUEUE).unionByName(asked.select(F.col("to_instance").alias("instance"), F.col("target_queue_id").alias("queue_id")))
    queues = _queues(assigned(facts.where(is_queued()).join(keys.distinct(), list(QUEUE), "left_semi")))

    # source side: hints lie with the generation that they are of
    each = queues.select(*QUEUE, F.col("doubt").alias("source_doubt"), F.explode_outer("gens").alias("g")).select(*QUEUE, "source_doubt", "g", F.explode_outer("g.hints").alias("x")).where("x IS NOT NULL")
    src = each.select(*QUEUE, "x.*", "source_doubt", F.col("g.cross").alias("cross_stream"), F.when(F.col("g.reason") == "resolved", F.col("g").dropFields("hints", "deliveries")).alias("s"))
    src = src.select("*", F.col("h.kind").alias("hint_kind"), "h.target_queue_id", "h.target_instance", "h.relay").drop("h")
    free = hints(facts.where(~is_queued())).drop("native_proof")
    src = bound(src.unionByName(free, allowMissingColumns=True)).withColumn("hint_id", F.struct(*REF))

    # target side: all generations of the target's queue, of which one must be plausible
    t = queues.select(F.col("instance").alias("to_instance"), F.col("queue_id").alias("target_queue_id"), F.col("doubt").alias("target_doubt"), F.filter("gens", lambda g: g["reason"] == "resolved").alias("t_gens"))
    out = src.join(t, ["to_instance", "target_queue_id"], "left")

    def plausible(g):
        apart = g["first_t"] - F.col("t")
        return F.coalesce(F.col("s.receipt") & g["receipt"] & (g["first_t"] > F.col("s.first_t")) & apart.between(-window_ns, window_ns), F.lit(False))

    out = out.withColumns({"n_target": F.size(F.coalesce("t_gens", F.array().cast(t.schema["t_gens"].dataType))), "target_cross": F.exists("t_gens", lambda g: g["cross"]), "likely": F.filter("t_gens", plausible)})
    out = out.withColumns({"n_plausible": F.coalesce(F.size("likely"), F.lit(0)), "target": F.get("likely", F.lit(0))}).drop("t_gens", "likely")

    # a delivery that the single target reports to the address that the hint speaks of
    wanted = F.when(F.col("hint_kind") == "bounce_notification_hint", F.col("s.sender")).otherwise(F.col("recipient"))
    out = out.withColumn("wanted", wanted)
    proofs = F.transform(F.filter("target.deliveries", lambda d: d["address"] == F.col("wanted")), lambda d: d["proof"])
    out = out.withColumn("delivery_proof", F.when(F.col("n_plausible") == 1, F.array_min(proofs)))

    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    smtp = F.col("hint_kind") == "smtp_queue_hint"
    s_sender, t_sender = F.col("s.sender"), F.col("target.sender")
    s_mid, t_mid = F.col("s.mid"), F.col("target.mid")
    senders = s_sender.isNotNull() & t_sender.isNotNull()
    ids_ok = ~flag("s.mids_differ") & ~flag("target.mids_differ") & F.coalesce(s_mid == t_mid, F.lit(True))
    bounce_ok = senders & (s_sender != "") & (t_sender == "") & F.col("delivery_proof").isNotNull()
    same_ok = senders & (s_sender == t_sender) & ids_ok
    smtp_ok = same_ok & F.coalesce((s_mid != "") & (s_mid == t_mid), F.lit(False)) & F.col("delivery_proof").isNotNull()
    ok = F.coalesce(F.when(F.col("hint_kind") == "bounce_notification_hint", bounce_ok).when(smtp, smtp_ok).otherwise(same_ok), F.lit(False))
    reason = (
        F.when(F.col("s.gid").isNull(), F.lit("source_unresolved"))
        .when(flag("cross_stream") | flag("source_doubt"), F.lit("source_ambiguous"))
        .when(F.col("to_instance").isNull(), F.lit("target_instance_unknown"))
        .when((F.col("to_instance") == F.col("instance")) & (F.col("target_queue_id") == F.col("queue_id")), F.lit("self_reference"))
        .when(flag("target_doubt"), F.lit("target_ambiguous"))
        .when(F.col("n_target") == 0, F.lit("target_absent"))
        .when(F.col("n_plausible") == 0, F.lit("evidence_insufficient"))
        .when((F.col("n_plausible") > 1) | flag("target_cross"), F.lit("target_ambiguous"))
        .when(~ok, F.lit("evidence_insufficient"))
    )
    out = out.withColumn("reason", reason)
    linked = F.col("reason").isNull()
    # what a link rests on: the hint, one proof for each agreed value, and the target's delivery
    placed = F.transform(F.concat("s.proofs", "target.proofs"), lambda p: p.dropFields("place"))
    all_proofs = F.concat(F.array("hint_id"), placed, F.array_compact(F.array("delivery_proof")))
    evidence = F.when(linked, F.array_sort(F.array_distinct(all_proofs))).otherwise(F.array("hint_id"))
    return out.select(
        *REF,
        "instance",
        "queue_id",
        "hint_kind",
        "target_queue_id",
        F.col("to_instance").alias("target_instance"),
        F.when(linked, F.lit("corroborated")).otherwise(F.lit("candidate")).alias("state"),
        "reason",
        F.when(F.col("reason").isNull() | (F.col("reason") != "source_unresolved"), F.col("s.gid")).alias("source_generation"),
        # a target, and what it adds, only where the link holds
        F.when(linked, F.col("target.gid")).alias("target_generation"),
        (flag("s.non_explicit") | (linked & flag("target.non_explicit"))).alias("non_explicit_time"),
        evidence.alias("evidence"),
    )


