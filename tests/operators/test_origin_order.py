"""Order within origins over carried ranges, against one plain window over the origin."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loghelm.operators.origin_order import ordered
from loghelm.operators.partition import provenance_faults
from loghelm.store.imports import gaps

SHAPE = "source_id string, origin_id string, start_offset long, end_offset long, instance string"


def some(rng, n):
    rows, at = [], {}
    for _ in range(n):
        key = (rng.choice(["s", "t", "", None]), rng.choice(["a", "b", "c", None]))
        start = at.get(key, 0) + rng.choice([0, 0, 0, 700, -30])
        end = start + rng.randrange(1, 90)
        at[key] = end
        rows.append((*key, rng.choice([start] * 30 + [None]), rng.choice([end] * 30 + [None]), "i"))
    return rows


def test_ranges_carry_the_row_before_and_the_place(spark):
    rng = random.Random(6)
    # an index keeps rows that are alike apart, and identities are as `ordered` sees them
    rows = [("s" if r[0] is None else r[0], "a" if r[1] is None else r[1], *r[2:]) for r in some(rng, 600)]
    df = spark.createDataFrame(rows, SHAPE).dropDuplicates(["source_id", "origin_id", "start_offset", "end_offset"])
    w = Window.partitionBy("source_id", "origin_id").orderBy("start_offset", "end_offset")
    want = df.withColumns({"previous_end": F.lag("end_offset").over(w), "place": F.row_number().over(w).cast("long")})
    for size in (50, 1000, 1 << 40):
        got = ordered(df, size)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert ordered(df.limit(0)).collect() == []


def test_faults_and_gaps_across_range_borders(spark, monkeypatch):
    from loghelm.operators import origin_order

    monkeypatch.setattr(origin_order.ordered, "__defaults__", (100,))
    rows = [("s", "o", i * 40, i * 40 + 40, "i") for i in range(50)]
    rows[30] = ("s", "o", 1195, 1240, "i")  # starts in the range before its predecessor's end
    rows[40] = ("s", "o", 1605, 1640, "i")  # leaves five bytes out
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    assert [(r.start_offset, r.fault) for r in provenance_faults(df).collect()] == [(1195, "overlap")]
    assert sorted((r.start_offset, r.expected) for r in gaps(df).collect()) == [(1195, 1200), (1605, 1600)]
    bad = spark.createDataFrame([(None, "o", 0, 1, "i"), ("s", "", 0, 1, "i"), ("s", "o", None, 1, "i"), ("s", "o", 5, 5, "i"), ("s", "p", -1, 5, "i")], SHAPE)
    assert sorted(r.fault for r in provenance_faults(bad).collect()) == ["invalid_offsets"] * 3 + ["missing_identity"] * 2


def test_no_task_holds_an_origin(spark):
    """One origin of many rows: each task of the rows' shuffle gets its ranges only, and the plan
    sorts whole origins only for the rows that are carried."""
    df = spark.range(200_000).select(F.lit("s").alias("source_id"), F.lit("o").alias("origin_id"), (F.col("id") * 400).alias("start_offset"), (F.col("id") * 400 + 400).alias("end_offset"), F.lit("i").alias("instance"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ordered(df)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert gaps(df).isEmpty() and got.agg(F.max("place")).first()[0] == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 120_000
    over = [line for line in plan.splitlines() if "Window [" in line]
    assert sorted("__range" in line.split("windowspecdefinition(")[1].split("ASC")[0].rsplit(",", 1)[0] for line in over)
