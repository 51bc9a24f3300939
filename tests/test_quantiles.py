"""Quantiles by counting against numpy and ``percentile``, and what statistics move between tasks."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewater as tw
from tidewater.functions import text
from tidewater.operators import quantiles as Q
from tidewater.quality import profile

AT = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def stages(spark, f) -> list:
    """The stages that ``f`` runs, as Spark's status store has them."""

    def all_of_them():
        gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = all_of_them()
    f()
    return [s for k, s in all_of_them().items() if k not in before]


def shuffled(spark, f) -> int:
    """Bytes that the jobs of ``f`` write for shuffles."""
    return sum(s.shuffleWriteBytes() for s in stages(spark, f))


rng = np.random.default_rng(3)
COLUMNS = {
    "ints": rng.integers(-5, 6, 3000).astype(float), "wide": rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000), "close": 1e9 + rng.integers(0, 5000, 3000) / 1000, "same": np.full(3000, 7.25),
    "tiny": rng.integers(-40, 40, 3000) * 5e-324, "zeros": rng.choice([-0.0, 0.0, 1.0], 3000), "ends": rng.choice([-1.7976931348623157e308, 1.7976931348623157e308], 3000), "skewed": np.r_[np.full(2900, 1.0), rng.normal(0, 1e6, 100)],
}


@pytest.mark.parametrize("few", [100_000, 20])
def test_as_percentile_gives(spark, monkeypatch, few):
    """Whether values of a bin are counted one by one or in finer bins; columns with nulls, few rows and none too."""
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "TOGETHER", 5)
    rows = [tuple(map(float, r)) + (None if i % 3 else float(i), 4.5 if i == 9 else None, None) for i, r in enumerate(zip(*COLUMNS.values(), strict=True))]
    names = [*COLUMNS, "nulls", "one", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    want = df.agg(*[F.percentile(F.col(c), F.array(*map(F.lit, AT))).alias(c) for c in names]).first()
    assert Q.quantiles(df, [F.col(c) for c in names], AT) == [want[c] for c in names]
    assert Q.quantiles(df.limit(0), [F.col("ints")], AT) == [None]


def test_winsorizing_moves_counts_and_not_values(spark):
    df = spark.range(400_000, numPartitions=8).select(((F.col("id") * 7919) % 400_009 + 0.25).alias("x"))
    values = np.array([(i * 7919) % 400_009 + 0.25 for i in range(400_000)])
    lo, hi = np.quantile(values, [0.05, 0.95])
    got = []
    assert shuffled(spark, lambda: got.append(tw.winsorize_outliers(df).agg(F.min("x"), F.max("x")).first())) < 1_000_000
    assert got[0] == pytest.approx((lo, hi))


def test_no_task_reads_the_values_of_a_column(spark):
    """Of what a large shuffle holds, each of four tasks reads about its share."""
    df = spark.range(200_000, numPartitions=8).select(((F.col("id") * 7919) % 200_003 + 0.25).alias("x"), ((F.col("id") * 104_729) % 200_003).alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        large = [s for s in stages(spark, lambda: got.extend(profile.column_stats(df, ["x", "y"]).collect())) if s.shuffleReadBytes() > 500_000]
        assert large
        for s in large:
            tasks = spark.sparkContext._jsc.sc().statusStore().taskList(s.stageId(), s.attemptId(), 100)
            assert max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().localBytesRead() for i in range(tasks.size())) < 0.4 * s.shuffleReadBytes()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x = np.array([(i * 7919) % 200_003 + 0.25 for i in range(200_000)])
    assert [got[0][q] for q in ("q25", "q50", "q75", "q95")] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75, 0.95]).tolist()) and got[0]["unique_count"] == len(set(x.tolist()))


def test_distinct_values_carry_no_statistics(spark):
    """The shuffle of distinct values is about as large as that of counting them alone."""
    df = spark.range(50_000, numPartitions=8).select("id", F.concat(F.lit("Customer#"), F.col("id")).alias("name"))
    least = shuffled(spark, lambda: df.agg(F.count_distinct("id"), F.count_distinct("name")).collect())
    assert shuffled(spark, lambda: profile.column_stats(df, ["id", "name"]).collect()) < 1.4 * least


ODD = [(1, float("nan"), "a", None, True), (2, float("inf"), " ", None, None), (2, float("inf"), " ", None, None), (3, -2.5, None, None, False), (4, 7.0, "", None, True), (None, None, "b", None, True)]


@pytest.mark.parametrize("size", [0, 6])
def test_comparisons_of_frames_are_those_of_their_profiles(spark, size):
    a = spark.createDataFrame(ODD, "`n.o` long, x double, s string, gone double, flag boolean").coalesce(1)
    b = a.limit(size).select(F.col("`n.o`").cast("string").alias("n.o"), (F.col("x") * 3).alias("x"), "s", F.lit(None).cast("string").alias("none"), "gone")
    p, q = tw.profile(a), tw.profile(b)
    assert tw.detect_drift(a, b) == tw.detect_drift(p, q) == tw.detect_drift(p, b)
    assert tw.detect_drift(b, a) == tw.detect_drift(q, p) == tw.detect_drift(q, a)
    for options in ({}, {"max_duplicate_ratio_delta": None}, {"max_duplicate_ratio_delta": 0, "max_null_ratio_delta": 0, "max_numeric_mean_delta_ratio": 0}):
        assert tw.check_quality_gates(a, b, **options) == tw.check_quality_gates(p, q, **options)
        assert tw.check_quality_gates(b, a, **options) == tw.check_quality_gates(q, p, **options) == tw.check_quality_gates(q, a, **options)


def test_gates_shuffle_no_more_than_the_distinct_rows(spark):
    df = spark.range(50_000, numPartitions=8).select(((F.col("id") * 7919) % 50_021).alias("id")).withColumn("name", F.concat(F.lit("Customer#"), F.col("id")))
    least = shuffled(spark, lambda: df.distinct().count())
    assert shuffled(spark, lambda: tw.check_quality_gates(df, df)) < 2.1 * least


def test_drift_shuffles_no_values(spark):
    df = spark.range(50_000, numPartitions=8).select("id", F.concat(F.lit("Customer#"), F.col("id")).alias("name"))
    assert shuffled(spark, lambda: tw.detect_drift(df, df)) < 10_000


def test_stripping_is_pythons_and_linear(spark):
    """White space inside a text was tried again from each of its characters."""
    values = [f"{chr(i)} x{chr(i)}y{chr(i)}" for i in range(1, 0x3100)] + ["", " ", "　", "\U0001f600 ", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.strip_unicode(F.col("v")).alias("bare")).collect()
    assert all(r.bare == (r.v.strip() if r.v is not None else None) for r in rows)
    began = time.perf_counter()
    long = spark.range(1, numPartitions=1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000 + F.col("id").cast("int")), F.lit("b ")).alias("v"))
    assert long.select(F.length(text.strip_unicode(F.col("v")))).first()[0] == 300_002
    assert time.perf_counter() - began < 15
