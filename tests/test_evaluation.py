import math
import random

import pytest
from pyspark.sql import functions as F

from propense.operators import auc, evaluation, negatives, splits
from propense.functions.hashing import PRIME, draw


def predictions(spark, rows):
    return spark.createDataFrame(rows, "rating double, prediction double")


def test_confusion(spark):
    nan = float("nan")
    rows = [(1, 0.5)] * 3 + [(1, -0.1), (1, 0.0)] + [(0, 0.2)] + [(0, 0.0)] * 4 + [(1, nan), (nan, 1.0)]
    result = evaluation.evaluate(predictions(spark, [(float(a), float(b)) for a, b in rows])).first()
    assert (result["tp"], result["fp"], result["fn"], result["tn"]) == (3, 2, 3, 4)
    assert result["accuracy"] == pytest.approx(7 / 12)
    assert result["precision"] == pytest.approx(0.6)
    assert result["recall"] == result["sensitivity"] == pytest.approx(0.5)
    assert result["fallout"] == pytest.approx(1 / 3)
    assert result["specificity"] == pytest.approx(2 / 3)
    assert result["f"] == pytest.approx(2 * 0.6 * 0.5 / 1.1)


def test_nothing_to_divide_gives_nan(spark):
    result = evaluation.evaluate(predictions(spark, [(0.0, 0.0)])).first()
    assert result["accuracy"] == 1.0 and result["specificity"] == 1.0
    assert all(math.isnan(result[m]) for m in ("precision", "recall", "f"))
    empty = evaluation.evaluate(predictions(spark, [])).first()
    assert (empty["tp"], empty["fp"], empty["fn"], empty["tn"]) == (0, 0, 0, 0)
    assert all(math.isnan(empty[m]) for m in evaluation.METRICS)


def test_errors_and_folds(spark):
    assert evaluation.mean_squared_error(predictions(spark, [(1.0, 0.5), (0.0, 1.0)])).first()[0] == 0.625
    folds = spark.createDataFrame([(0.5,), (0.7,), (0.6,)], "recall double")
    summary = evaluation.fold_summary(folds).first()
    assert summary["mean_recall"] == pytest.approx(0.6) and summary["recall_spread"] == pytest.approx(0.2)


def test_report_lines(spark):
    # The report format, from one recorded trial.
    row = (14, 37, 10.4, 5.9, 0.5, 0.25, 0.5916, 0.4267, 0.4790, 0.3477, 0.4790, 0.6523, 0.4514)
    names = "trial int, rank int, reg double, alpha double, mean_recall double, recall_spread double, " + ", ".join(
        f"{m} double" for m in evaluation.METRICS
    )
    data = spark.createDataFrame([row], names)
    metrics = "0.5916,0.4267,  0.4790,0.3477,0.4790,0.6523,0.4514"
    assert data.select(evaluation.trial_line()).first()[0] == f"    14,37,10.4000,05.9000,{metrics}"
    assert data.select(evaluation.fold_line()).first()[0] == f"14,0.5000,0.2500,37,10.4000,05.9000,{metrics}"


@pytest.mark.parametrize("ties", ["wrong", "half"])
def test_auc_against_pairs(spark, ties):
    rng = random.Random(4)
    # User 0 owns most of the rows; scores repeat, so that there are ties.
    users = [0] * 400 + [rng.randrange(1, 20) for _ in range(200)]
    positive = [(u, float(rng.randrange(60))) for u in users]
    negative = [(u, float(rng.randrange(50))) for u in users[::2]] + [(77, 1.0)]
    schema = "user_id long, prediction double"
    result = auc.user_auc(spark.createDataFrame(positive, schema), spark.createDataFrame(negative, schema), ties)
    found = {r["user_id"]: r["auc"] for r in result.collect()}
    for user in {u for u, _ in positive}:
        p = [s for u, s in positive if u == user]
        n = [s for u, s in negative if u == user]
        if not n:
            assert user not in found
            continue
        credit = sum((a > b) + (0.5 if ties == "half" and a == b else 0) for a in p for b in n)
        assert found.pop(user) == pytest.approx(credit / (len(p) * len(n)))
    assert not found


def mixed(seed, first, second):
    total = (first % PRIME) * 48271 + seed + (second % PRIME) * 69621
    once = total % PRIME
    twice = (once * once + once + 48271) % PRIME
    return (twice * twice + once * 69621 + 69621) % PRIME


def test_draws_are_uniform_and_reproducible(spark):
    data = spark.range(20000).select(F.col("id").alias("a"), (F.col("id") * 7 - 30000).alias("b"))
    rows = data.withColumn("d", draw(11, F.col("a"), F.col("b"))).collect()
    assert all(r["d"] == mixed(11, r["a"], r["b"]) for r in rows[:200])
    assert [sum(r["d"] * 10 // PRIME == i for r in rows) for i in range(10)] == pytest.approx([2000] * 10, rel=0.08)


def pairs(spark, n=3000):
    return spark.range(n).select(
        (F.col("id") % 300).alias("user_id"), (F.col("id") / 300).cast("long").alias("item_id")
    )


def test_splits_partition_the_rows(spark):
    data = pairs(spark)
    parts = splits.random_split(data, [0.8, 0.1, 0.1], 3)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 3000 and sizes == pytest.approx([2400, 300, 300], rel=0.15)
    assert parts[0].union(parts[1]).union(parts[2]).distinct().count() == 3000
    assert sorted(parts[1].collect()) == sorted(splits.random_split(data, [0.8, 0.1, 0.1], 3)[1].collect())
    assert sorted(parts[1].collect()) != sorted(splits.random_split(data, [0.8, 0.1, 0.1], 4)[1].collect())
    assert splits.bernoulli_sample(data, 0.25, 3).count() == pytest.approx(750, rel=0.1)


def test_stratified_split(spark):
    result = splits.with_stratified_split(pairs(spark), 4, [0.5, 0.5], [1.0, 0.0], 3)
    counts = {(r["population"], r["split"]): r["count"] for r in result.groupBy("population", "split").count().collect()}
    assert set(counts) == {("target", 0), ("target", 1), ("other", 0)} and counts["other", 0] == 2700


def test_folds(spark):
    base = spark.createDataFrame([(1000, 1)], "user_id long, item_id long")
    folded = splits.with_fold(pairs(spark), 4, 3)
    tests = []
    for fold in range(4):
        train, test = splits.fold_parts(base, folded, fold)
        assert train.count() + test.count() == 3001
        assert train.where("user_id = 1000").count() == 1
        assert train.intersect(test).count() == 0
        tests.append(test)
    assert sum(t.count() for t in tests) == 3000


@pytest.mark.parametrize("chunk", [4, 4096])
def test_negatives_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    n_items, seed = 40, 5
    rng = random.Random(1)
    held = {u: set(rng.sample(range(n_items), m)) for u, m in enumerate([1, 3, 10, 25, 37, 39, 40])}
    train = {u: set(rng.sample(range(n_items), 4)) for u in held}
    items = spark.createDataFrame([(i * 3,) for i in range(n_items)], "item_id long")
    frames = [
        spark.createDataFrame([(u, i * 3) for u, chosen in side.items() for i in chosen], "user_id long, item_id long")
        for side in (held, train)
    ]
    for exclude in (None, frames[1]):
        result = negatives.sample_negatives(frames[0], items, seed, exclude)
        found = {}
        for row in sorted(result.collect(), key=lambda r: (r["user_id"], r["draw"])):
            found.setdefault(row["user_id"], []).append((row["draw"], row["item_id"]))
        for user, positives in held.items():
            avoid = positives | (train[user] if exclude is not None else set())
            draws = [(d, mixed(seed, user, d) % n_items) for d in range(n_items)]
            expected = [(d, i * 3) for d, i in draws if i not in avoid][: len(positives)]
            assert found.get(user, []) == expected
