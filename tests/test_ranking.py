"""The distributed order statistics against numpy, with any number of value parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvagrid.operators import ranking


def skewed(spark, n=4000):
    """One group with most rows, a heavy tail, many equal values and a group of one."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(0, 2, n), 2)]
    rows += [("flat", 5.0)] * 300 + [("one", -3.0)] + [("neg", float(x)) for x in rng.normal(0, 1, 50)]
    rows += [("hot", None), ("flat", None)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def expected(rows, q):
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    return {k: np.percentile(x, q) for k, x in groups.items()}


LEVELS = [None, 0, 3, 9]


@pytest.mark.parametrize("levels", LEVELS)
def test_percentiles(spark, levels):
    rows, df = skewed(spark)
    got = ranking.exact_percentiles(df, ["k"], "v", {"q05": 0.05, "q50": 0.5, "q99": 0.99}, levels=levels).collect()
    for name, q in (("q05", 5), ("q50", 50), ("q99", 99)):
        want = expected(rows, q)
        assert {r["k"]: pytest.approx(r[name]) for r in got} == want


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([("a", 3.0), (None, 1.0), (None, 2.0), ("a", None), ("b", None)], "k string, v double")
    for levels in LEVELS:
        got = {r["k"]: r["m"] for r in ranking.exact_percentiles(df, ["k"], "v", {"m": 0.5}, levels=levels).collect()}
        assert got == {"a": 3.0, None: 1.5}
    run = ranking.running_totals(df.where("v IS NOT NULL").withColumn("w", F.lit(1)), ["k"], "v", ["w"]).collect()
    assert {(r["k"], r["v"]): (r["w_run"], r["w_all"]) for r in run} == {("a", 3.0): (1, 1), (None, 1.0): (1, 2), (None, 2.0): (2, 2)}
    kept = ranking.sample_exact(df.withColumn("i", F.monotonically_increasing_id()), ["k"], ["i"], 1, 5).collect()
    assert sorted(str(r["k"]) for r in kept) == ["None", "a", "b"]


def test_percentile_without_keys(spark):
    rows, df = skewed(spark)
    want = np.percentile([x for _, x in rows if x is not None], 90)
    assert ranking.exact_percentiles(df, [], "v", {"q": 0.9}).first()["q"] == pytest.approx(want)


def test_lower_order_statistic(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "k string, v double")
    got = ranking.exact_percentiles(df, ["k"], "v", {"q": 0.15}, lower=True).first()["q"]
    assert got == 3.0  # ceil(0.15 * 20) = 3


def test_percentile_share_from_key(spark):
    df = spark.createDataFrame([(p, float(i)) for p in (0.25, 0.75) for i in range(5)], "p double, v double")
    got = ranking.exact_percentiles(df, ["p"], "v", {"q": F.col("p")}).collect()
    assert {r["p"]: r["q"] for r in got} == {0.25: 1.0, 0.75: 3.0}


def test_many_quantiles_of_groups(spark):
    rows, df = skewed(spark)
    df = df.unionAll(spark.createDataFrame([(None, 1.0), (None, 4.0)], df.schema))
    shares = [k / 64 for k in range(1, 64)]
    want = expected([*rows, (None, 1.0), (None, 4.0)], [100 * p for p in shares])
    for staged in (True, False):
        got = {r["k"]: r["cuts"] for r in ranking.exact_quantiles(df, ["k"], "v", shares, staged).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
        assert got["flat"] == [5.0] * 63
    alone = ranking.exact_quantiles(df.where("k = 'hot'"), [], "v", shares).collect()
    assert [r["cuts"] for r in alone] == [got["hot"]]


def test_percentiles_of_several_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 3, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    for r in ranking.exact_percentiles_of(df, ["k"], ["a", "b"], {"lo": 0.1, "m": 0.5}).collect():
        for i, c in ((1, "a"), (2, "b")):
            mine = [x[i] for x in rows if x[0] == r["k"]]
            assert (r[f"lo_{c}"], r[f"m_{c}"]) == pytest.approx(tuple(np.percentile(mine, [10, 50])))


def test_only_wanted_parts_are_shuffled_by_value(spark):
    """No exchange above a scan of the values has all of them: counts per part move, then the rows of a few parts."""
    df = spark.range(20000).select((F.col("id") % 2).alias("k"), F.rand(3).alias("v"))
    got = ranking.exact_percentiles(df, ["k"], "v", {"m": 0.5})
    got.collect()
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("levels", LEVELS)
def test_running_totals(spark, levels):
    rng = np.random.default_rng(2)
    rows = [("a", float(i), int(w)) for i, w in enumerate(rng.integers(1, 9, 500))] + [("b", 0.5, 7)]
    df = spark.createDataFrame(rows, "k string, o double, w int")
    got = {(r["k"], r["o"]): (r["w_run"], r["w_all"]) for r in ranking.running_totals(df, ["k"], "o", ["w"], levels).collect()}
    total = 0
    for k, o, w in rows[:-1]:
        total += w
        assert got[(k, o)][0] == total
    assert got[("a", 0.0)][1] == total
    assert got[("b", 0.5)] == (7, 7)


def test_ties_are_ordered_by_the_further_columns(spark):
    df = spark.createDataFrame([(0.5, i, 1) for i in range(50)], "u double, i int, w int")
    got = {r["i"]: r["w_run"] for r in ranking.running_totals(df, [], ["u", "i"], ["w"]).collect()}
    assert got == {i: i + 1 for i in range(50)}


def test_sample_exact_sizes_whatever_the_parts(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4900, "hot").otherwise("cold"))
    samples = []
    for levels in (None, 0, 6):
        got = ranking.sample_exact(df, ["k"], ["id"], 300, 3, levels).collect()
        samples.append({k: {r["id"] for r in got if r["k"] == k} for k in ("hot", "cold")})
    assert len(samples[0]["hot"]) == 300
    assert len(samples[0]["cold"]) == 100  # smaller groups stay whole
    assert samples[1:] == samples[:1] * 2


def test_parts_split_a_hot_group_evenly(spark):
    """Nine tenths of the rows in one group with a heavy tail: no part of it is large."""
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 10 else "cold", float(x)) for i, x in enumerate(rng.lognormal(0, 3, 20000))]
    cut = ranking.with_value_part(spark.createDataFrame(rows, "k string, v double"), "v", levels=6)
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) == 64
    assert max(sizes) < 2 * 18000 / 64


def test_splitters_are_merged_in_two_levels(spark):
    from sylvagrid.operators import ranking

    df = spark.range(0, 40_000, 1, 150).select((F.col("id") * 7 % 40_000).cast("double").alias("v"))
    cuts = ranking.splitters(df, "v", 16).first()["cuts"]
    assert len(cuts) == 15 and all(abs(c - 2500 * (i + 1)) < 500 for i, c in enumerate(cuts))
    # no aggregate goes from all tasks of the scan to one
    v = F.col("v")
    plan = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(ranking.MERGES))).agg(F.kll_sketch_agg_double(v))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    import inspect

    assert "percentile_approx" not in inspect.getsource(ranking)
    nothing = df.where("v < 0").unionAll(spark.createDataFrame([(float("nan"),), (None,)], "v double"))
    assert ranking.splitters(nothing, "v", 4).first()["cuts"] is None
    assert {r["_part"] for r in ranking.with_value_part(nothing, "v", 2).collect()} == {0}


def test_tasks_of_running_totals_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    run = ranking.running_totals(spark.range(1, 1001).withColumn("w", F.lit(2)), [], "id", ["w"])
    assert run.rdd.getNumPartitions() == 10
    assert all(r["w_run"] == 2 * r["id"] and r["w_all"] == 2000 for r in run.collect())


def test_the_edge_of_a_part_takes_the_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1.0] * 500 + [2.0] * 500 + list(np.linspace(3, 4, 200))] + [(None,)], "v double")
    cut = ranking.with_value_part(df, "v", 5, edge=True)
    beside = cut.where("NOT _edge").groupBy("_part").count().collect()
    assert max(r["count"] for r in beside) < 100 and cut.where("_edge AND v IN (1, 2)").count() == 1000
    assert cut.where("_edge").groupBy("_part").agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0] == 1


def test_ks_of_consecutive_years_equals_brute_force(spark, monkeypatch):
    from sylvagrid.operators import distributions

    rng = np.random.default_rng(5)
    rows = [("a", 1 + i % 3, float(x)) for i, x in enumerate(rng.normal(0, 1, 9000))]
    rows += [("a", 2, 0.25)] * 400 + [("a", 3, x) for x in (None, None, float("nan"), float("inf"), -float("inf"))]
    rows += [(None, 1 + i % 2, float(x)) for i, x in enumerate(rng.integers(0, 4, 2000))]
    rows += [("same", y, float(x)) for y in (1, 2) for x in range(50)] + [("a", None, 1.0)]
    monkeypatch.setattr(ranking, "TASK_ROWS", 200)
    moved, tasks_for = [], ranking.tasks_for
    monkeypatch.setattr(distributions, "tasks_for", lambda n: moved.append(n) or tasks_for(n))
    df = spark.createDataFrame(rows, "k string, y int, v double")
    for staged in (True, False):
        got = {(r["k"], r["year1"]): r for r in distributions.ks_consecutive(df, ["k"], "y", "v", staged).collect()}
        assert set(got) == {("a", 1), ("a", 2), (None, 1), (None, 2), ("same", 1), ("same", 2)}
        for (k, y), r in got.items():
            # nulls come after NaN, both after all numbers
            one, two = (sorted((x is None, x is not None and x != x, x if x is not None and x == x else 0) for b, z, x in rows if b == k and z == w) for w in (y, y + 1))
            assert (r["year2"], r["n1"], r["n2"]) == (y + 1, len(one), len(two))
            if two:
                at = {x: i for i, x in enumerate(sorted({*one, *two}))}
                f = [np.cumsum(np.bincount([at[x] for x in side], minlength=len(at))) / len(side) for side in (one, two)]
                assert r["ks_statistic"] == pytest.approx(np.abs(f[0] - f[1]).max(), abs=1e-15)
            else:
                assert r["ks_statistic"] is None
    # parts that cannot hold the distance stay where they are
    assert all(0 < n < len(rows) / 3 for n in moved)
    alone = distributions.ks_consecutive(df.where("k = 'a'"), [], "y", "v").drop("p_value").orderBy("year1").collect()
    assert [tuple(r) for r in alone] == [tuple(got["a", y])[1:6] for y in (1, 2)]
