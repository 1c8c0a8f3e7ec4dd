"""Joins, order statistics and ranks against brute force, with skewed keys and values."""

import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propense.operators import joins, lookalike, quantiles, quintiles


def table(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def third_equal(n, seed=3):
    """A third of all values are one value, the rest have a long tail."""
    rng = random.Random(seed)
    return [7.0 if i % 3 == 0 else rng.paretovariate(0.5) for i in range(n)]


@pytest.mark.parametrize("accuracy", [20, 100])
@pytest.mark.parametrize("exact_rows", [1, 40, 10_000])
def test_order_statistics(spark, accuracy, exact_rows):
    values = third_equal(1500)
    ranks = [1, 2, 300, 499, 500, 501, 750, 1000, 1001, 1499, 1500]
    found = quantiles.order_statistics(table(spark, values).repartition(5), "x", ranks, exact_rows, accuracy)
    assert found == [sorted(values)[r - 1] for r in ranks]


def test_order_statistics_ignore_null_and_nan(spark):
    data = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "x double")
    assert quantiles.order_statistics(data, "x", [2, 1]) == [2.0, 1.0]
    with pytest.raises(ValueError, match="rank 3 of 2"):
        quantiles.order_statistics(data, "x", [3])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_order_statistics_property(spark, values):
    ranks = list(range(1, len(values) + 1, 7))
    found = quantiles.order_statistics(table(spark, values), "x", ranks, exact_rows=3, accuracy=10)
    assert found == [sorted(values)[r - 1] for r in ranks]


def test_quintiles(spark):
    rows = [(i, i % 4, i * i) for i in range(23)]
    data = spark.createDataFrame(rows, "id int, days int, amount int")

    def bucket(value, column):
        ordered = sorted(r[column] for r in rows)
        cuts = [ordered[len(rows) // 5 * j - 1] for j in range(1, 5)]
        return next((i for i, c in enumerate(cuts) if value <= c), 4)

    for base in (0, 1):
        result = {r["id"]: r["score"] for r in quintiles.quintile_scores(data, "days", "amount", base).collect()}
        for i, days, amount in rows:
            assert result[i] == pytest.approx((bucket(days, 1) + base) / 100 + bucket(amount, 2) + base)


def test_cut_points_ignore_nulls(spark):
    data = spark.createDataFrame([(i if i < 4 else None, i) for i in range(20)], "few int, all int")
    assert quintiles.cut_points(data, ["few", "all"]) == {"few": [], "all": [3.0, 7.0, 11.0, 15.0]}
    data = spark.createDataFrame([(i if i < 10 else None, i) for i in range(20)], "few int, all int")
    assert quintiles.cut_points(data, ["few"]) == {"few": [1.0, 3.0, 5.0, 7.0]}


def test_top_share_ranks_numbers_only(spark):
    rows = [(i, float(i)) for i in range(20)] + [(100 + i, float("nan")) for i in range(3)] + [(200, None)]
    data = spark.createDataFrame(rows, "user_id long, score double")
    assert sorted(r["user_id"] for r in lookalike.top_share(data, 20).collect()) == [16, 17, 18, 19]
    assert lookalike.top_threshold(data, 4) == 16.0


def test_top_share_of_wide_keys(spark):
    for first in (2**53, -(2**62), 2**62):
        data = spark.createDataFrame([(first + i, 1.0) for i in range(10)], "user_id long, score double")
        assert sorted(r["user_id"] for r in lookalike.top_share(data, 40).collect()) == [first + i for i in range(4)]


def test_shares_of_a_percent(spark):
    data = spark.createDataFrame([(i, float(i), i % 2 == 0) for i in range(1000)], "user_id long, score double, is_target boolean")
    assert lookalike.top_share(data, Decimal("1.74")).count() == 17
    shares = (Decimal("1.74"), Decimal("1.1"), Decimal("0.01"))
    found = lookalike.sweep(data, shares).select("percent", "size", "threshold", "predicted").collect()
    assert [tuple(r) for r in found] == [(Decimal("1.74"), 17, 983.0, 17), (Decimal("1.1"), 11, 989.0, 11)]


def test_broadcast_measures_nested_values(spark):
    vectors = spark.range(2000).select(F.col("id"), array_to_vector(F.array_repeat(F.lit(1.0), 20_000)).alias("v"))
    maps = spark.range(2000).select(F.map_from_arrays(F.sequence(F.lit(1), F.lit(5000)), F.sequence(F.lit(1), F.lit(5000))).alias("m"))
    nested = spark.range(200).select(F.array_repeat(F.struct(F.lit("x" * 100).alias("s")), 5000).alias("a"))
    assert not joins.fits_broadcast(vectors)
    assert not joins.fits_broadcast(maps)
    assert not joins.fits_broadcast(nested)
    assert joins.fits_broadcast(spark.range(1000).select("id", F.struct(F.lit("x"), F.array(F.lit(1))).alias("s")))
    assert not joins.fits_broadcast(spark.range(11), max_rows=10)


def test_quintiles_of_few_rows_are_lowest(spark):
    data = spark.createDataFrame([(1, 5), (9, 7)], "days int, amount int")
    scores = [r["score"] for r in quintiles.quintile_scores(data, "days", "amount").collect()]
    assert scores == pytest.approx([1.01, 1.01])


def test_dense_index_in_ranges(spark):
    ids = random.Random(5).sample(range(10**9), 700)
    data = spark.createDataFrame([(i,) for i in ids], "item_id long")
    for part_rows in (10_000, 50):
        result = quantiles.dense_index(data, "item_id", "n", part_rows)
        assert {r["item_id"]: r["n"] for r in result.collect()} == {v: i for i, v in enumerate(sorted(ids))}
    assert quantiles.dense_index(data.limit(0), "item_id", "n").count() == 0


def test_numbers_beyond_32_bits(spark):
    sizes = [(part, 2**31 + part) for part in (0, 1, 2, 3, 7, 8, 40)]
    table = spark.createDataFrame(sizes, "_part int, _size long")
    for block in (1, 2, 5, 1000):
        found = {r["_part"]: r["_offset"] for r in quantiles.running_offsets(table, block).collect()}
        assert found == {part: sum(n for p, n in sizes if p < part) for part, _ in sizes}


def keyed(spark):
    rows = [(1, i) for i in range(300)] + [(i % 40, i) for i in range(300)] + [(None, 1), (None, 2)]
    big = spark.createDataFrame(rows, "k int, v int")
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 60, 2)] + [(1, "hot")], "k int, name string")
    return big, small


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    big, small = keyed(spark)
    expected = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)
    salted = joins.salted_join(big, small, ["k"], how, salts=7, share=0.1)
    assert sorted(map(tuple, salted.collect()), key=repr) == expected
    for max_rows in (1, 1000):
        looked_up = joins.lookup_join(big, small, "k", how, max_rows=max_rows)
        assert sorted(map(tuple, looked_up.collect()), key=repr) == expected


def test_hot_keys_need_no_table_of_keys(spark):
    """Many more keys than the sketch follows: those with much of the rows are found, and nothing is staged."""
    hot = F.when(F.col("id") % 150 == 0, F.lit(-5)).when(F.col("id") % 3 == 1, F.lit(-6)).otherwise(F.col("id"))
    rows = spark.range(400_000).select(hot.alias("k")).repartition(7)
    names = spark.createDataFrame([(-5,), (-6,)], "k long").select(F.xxhash64("k")).collect()
    assert sorted(joins.hot_keys(rows, ["k"])) == sorted(r[0] for r in names)
    assert joins.hot_keys(spark.range(400_000).toDF("k"), ["k"]) == []
    assert joins.hot_keys(rows.where("k IS NULL"), ["k"]) == []


def test_salted_join_spreads_the_hot_key(spark):
    big, small = keyed(spark)
    assert joins.hot_keys(big, ["k"], 0.9) == []
    assert joins.salted_join(big, small, ["k"], "left", share=0.9).count() == big.count()
    assert joins.hot_keys(big, ["k"], 0.3) == [spark.range(1).select(F.xxhash64(F.lit(1).cast(big.schema["k"].dataType))).first()[0]]
    plan = joins.salted_join(big, small, ["k"], "left", salts=7, share=0.3)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_equal_rows_of_a_hot_key_are_spread(spark):
    big = spark.range(4000, numPartitions=16).select(F.lit(5).alias("k"))
    small = spark.createDataFrame([(5, "five")], "k int, name string")
    joined = joins.salted_join(big, small, ["k"], "left", salts=8)
    assert joined.where("name = 'five'").count() == 4000
    salts = big.select(F.pmod(F.xxhash64("k", F.spark_partition_id()), F.lit(8)).alias("s")).distinct().count()
    assert salts > 3


def test_broadcast_needs_few_rows_and_bytes(spark):
    _, small = keyed(spark)
    assert joins.fits_broadcast(small)
    assert not joins.fits_broadcast(small, max_rows=5)
    assert not joins.fits_broadcast(small, max_bytes=100)
    assert joins.fits_broadcast(small.limit(0))


def test_top_share_takes_exactly_the_share(spark):
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 11)) for i in range(200)]
    data = spark.createDataFrame(rows, "user_id long, score double")
    for percent in (0, 1, 10, 33, 50, 100):
        size = len(rows) * percent // 100
        expected = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
        assert sorted(map(tuple, lookalike.top_share(data, percent).collect())) == sorted(expected)


def test_sweep_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([-1.0, 0.0, 0.5, rng.random()]), rng.random() < 0.3) for i in range(150)]
    result = lookalike.sweep(spark.createDataFrame(rows, "user_id long, score double, is_target boolean")).collect()
    targets = sum(r[2] for r in rows)
    assert [r["percent"] for r in result] == list(range(1, 21))
    for row in result:
        size = len(rows) * row["percent"] // 100
        threshold = sorted((r[1] for r in rows), reverse=True)[size - 1]
        reached = [r for r in rows if r[1] >= threshold]
        assert (row["size"], row["threshold"], row["positive"]) == (size, threshold, threshold > 0)
        assert (row["predicted"], row["hits"]) == (len(reached), sum(r[2] for r in reached))
        assert row["recall"] == pytest.approx(row["hits"] / targets)


def test_sweep_skips_empty_shares(spark):
    data = spark.createDataFrame([(i, float(i), True) for i in range(10)], "user_id long, score double, is_target boolean")
    assert [r["percent"] for r in lookalike.sweep(data).collect()] == list(range(10, 21))
    few = lookalike.sweep(data.where("user_id < 3"))
    assert few.count() == 0
    assert few.columns == lookalike.sweep(data).columns


def test_membership_and_recall(spark):
    users = spark.createDataFrame([(i,) for i in range(6)], "user_id long")
    members = spark.createDataFrame([(1,), (1,), (4,), (9,)], "user_id long")
    flags = {r["user_id"]: r["is_target"] for r in lookalike.flag_members(users, members).collect()}
    assert flags == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False}
    assert lookalike.recall(users.where("user_id < 4"), members).first()["recall"] == pytest.approx(1 / 3)
    argmax = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>").select(lookalike.argmax(F.col("v")))
    assert argmax.first()[0] == 1
