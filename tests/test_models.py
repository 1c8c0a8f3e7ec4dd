"""Fitted models against numpy and against Spark's own transforms."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from propense import jobs
from propense.operators import clusters, decompose, factors, features, lookalike, popularity, recommend, topics, trials
from propense.plans import modelling, ranking
from propense.sources import sinks, staging, tables
from propense.sources.text import read_lines


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(2)
    rows = [(u, i * 10, float(rng.integers(1, 6))) for u in range(30) for i in range(12) if rng.random() < 0.4]
    return spark.createDataFrame(rows, "user_id int, item_id int, rating double").cache()


@pytest.fixture(scope="module")
def matrix(ratings):
    dense = np.zeros((30, 12))
    for row in ratings.collect():
        dense[row["user_id"], row["item_id"] // 10] = row["rating"]
    return dense


@pytest.fixture(scope="module")
def model(ratings):
    return recommend.fit(ratings, recommend.Settings(rank=4, iterations=3, reg=0.1, alpha=2.0))


def test_user_factors_solve_the_normal_equations(model, matrix):
    x = {r["user_id"]: np.array(r["user_factor"]) for r in recommend.user_factors(model).collect()}
    items = {r["item_id"]: np.array(r["item_factor"]) for r in recommend.item_factors(model).collect()}
    y = np.array([items.get(i * 10, np.zeros(4)) for i in range(12)])
    for user, factor in x.items():
        r = matrix[user]
        left = y.T @ y + y.T @ np.diag(2.0 * r) @ y + 0.1 * (r > 0).sum() * np.eye(4)
        assert left @ factor == pytest.approx(y.T @ ((1 + 2.0 * r) * (r > 0)), abs=1e-4)


@pytest.mark.parametrize("implicit", [True, False])
def test_packed_blocks_give_the_factors_of_the_solver(spark, monkeypatch, implicit):
    """Few and many ratings for the rank, blocks and chunks of any size, one user with very many ratings: as Spark's own solver."""
    rng = np.random.default_rng(5)
    rows = [(u, i * 3, float(rng.integers(1, 6))) for u in range(60) for i in range(40) if u == 7 or rng.random() < 0.15]
    ratings = spark.createDataFrame([*rows, *rows[:5]], "user_id int, item_id int, rating double")
    settings = recommend.Settings(rank=6, iterations=4, reg=0.3, alpha=5.0, implicit=implicit)
    solver = local_factors(recommend.fit(ratings, settings))
    monkeypatch.setattr(recommend, "PACKED_RATINGS", 0)
    called = []
    monkeypatch.setattr(recommend, "iterate", lambda *args: called.append(1) or factors.iterate(*args))
    for name, value in (("BLOCK_BYTES", 500), ("CHUNK_RATINGS", 9), ("MESSAGE_BYTES", 60), ("GATHERED", 50)):
        monkeypatch.setattr(factors, name, value)
    packed = local_factors(recommend.fit(ratings, settings))
    assert called
    for mine, theirs in zip(packed, solver, strict=True):
        assert set(mine) == set(theirs) and all(mine[k] == pytest.approx(theirs[k], abs=1e-4) for k in theirs)


def test_fits_drop_their_shuffles_by_size():
    assert recommend._exchange(1000, [100, 50], 10, 8) == (10, False)
    # Nine million ratings of 900,000 users: two gigabytes in every iteration.
    assert recommend._exchange(9_000_000, [900_000, 60_000], 10, 56) == (1, True)
    assert recommend._exchange(900_000, [90_000, 6_000], 10, 56) == (2, False)


def test_staging_leaves_no_shuffle_behind(spark):
    """Threads side by side, and the session's own setting afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with staging.without_shuffles(spark), staging.without_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folders.getAllFiles()) if f.getName().startswith("shuffle_")}

    kept = shuffles()
    rows = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if shuffles() <= kept:
            break
        time.sleep(0.1)
    assert shuffles() <= kept and rows.count() == 7


def local_factors(model):
    users = {r["user_id"]: np.array(r["user_factor"]) for r in model.users.collect()}
    return users, {r["item_id"]: np.array(r["item_factor"]) for r in model.items.collect()}


def test_predictions_are_products(spark, model, ratings):
    unknown = spark.createDataFrame([(999, 0, 1.0), (1, 999, 1.0)], ratings.schema)
    pairs = ratings.union(unknown)
    mine = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict(model, pairs).collect()}
    users, items = local_factors(model)
    theirs = {(r["user_id"], r["item_id"]): users[r["user_id"]] @ items[r["item_id"]] for r in ratings.collect()}
    assert mine == pytest.approx(theirs, abs=1e-9) and len(mine) == ratings.count()


def test_fit_is_deterministic(model, ratings):
    again = recommend.fit(ratings, recommend.Settings(rank=4, iterations=3, reg=0.1, alpha=2.0))
    assert sorted(again.users.collect()) == sorted(model.users.collect())


@pytest.mark.parametrize("nonnegative", [False, True])
def test_users_and_items_without_weight_have_zero_factors(spark, nonnegative):
    """Rank above the number of items, a user with zeros only, an item with zeros only, null ratings."""
    rows = [(u, i, 0.0 if u == 7 or i == 9 else float((u + i) % 3)) for u in range(30) for i in range(10)]
    ratings = spark.createDataFrame([*rows, (40, 3, None)], "user_id int, item_id int, rating double")
    settings = recommend.Settings(rank=20, iterations=10, reg=0.2, alpha=30.0, nonnegative=nonnegative)
    model = recommend.fit(ratings, settings)
    users, items = local_factors(model)
    assert set(users) == {*range(30), 40} and set(items) == set(range(10))
    assert not users[7].any() and not users[40].any() and not items[9].any() and users[8].any() and items[8].any()
    left = {r["user_id"]: (r["residual"], r["scale"]) for r in recommend.residuals(model, ratings).collect()}
    assert set(left) == set(users) and all(r <= 1e-3 * s for r, s in left.values())
    moved = recommend.Model(model.users.withColumn("user_factor", F.transform("user_factor", lambda x: x * 1.1)), model.items, settings)
    assert max(r["residual"] / r["scale"] for r in recommend.residuals(moved, ratings).collect() if r["scale"]) > 1e-3


def test_ratings_without_any_weight(spark):
    ratings = spark.createDataFrame([(u, i, 0.0) for u in range(5) for i in range(3)], "user_id int, item_id int, rating double")
    model = recommend.fit(ratings, recommend.Settings(rank=4, iterations=2))
    assert model.users.count() == 5 and model.items.count() == 3
    none = recommend.players_of(ratings, 99)
    assert recommend.audience(model, ratings, none, 1).count() == 0
    assert recommend.predict(model, ratings).where("prediction = 0").count() == 15
    empty = recommend.fit(ratings.limit(0), recommend.Settings(rank=4))
    assert empty.users.count() == 0 and recommend.best_items(empty, None, 3).count() == 0
    with pytest.raises(ValueError, match="below zero"):
        recommend.fit(ratings.withColumn("rating", F.lit(-1.0)), recommend.Settings(rank=2))


@pytest.mark.parametrize("bound", [1 << 26, 600, 97])
def test_best_items_are_exact(spark, monkeypatch, bound):
    """Against all predictions sorted, with items in one block, in many, and with many of one length; with zero factors and ties."""
    monkeypatch.setattr(recommend, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(4)
    users = {u: rng.integers(-2, 3, 3).astype(float) for u in range(40)} | {2**40: np.zeros(3)}
    items = {i * 7: rng.integers(-3, 4, 3).astype(float) for i in range(30)} | {-5: np.zeros(3)} | {i: np.ones(3) for i in range(1000, 1010)}
    model = recommend.Model(
        spark.createDataFrame([(u, x.tolist()) for u, x in users.items()], "user_id long, user_factor array<float>"),
        spark.createDataFrame([(i, x.tolist()) for i, x in items.items()], "item_id long, item_factor array<float>"),
        recommend.Settings(rank=3),
    )
    for k in (1, 4, 100):
        found = {r["user_id"]: (r["items"], r["scores"]) for r in recommend.best_items(model, None, k).collect()}
        for user, x in users.items():
            best = sorted((-float(x @ y), i) for i, y in items.items())[:k]
            assert found[user] == ([i for _, i in best], [-s for s, _ in best])
    last = spark.createDataFrame([(u, 2.0) for u in users], "user_id long, last double")
    above = {r["user_id"]: r["items_above"] for r in recommend.above(model, last).collect()}
    assert above == {u: sum(x @ y > 2 for y in items.values()) for u, x in users.items()}


def test_audience(spark, model, ratings):
    players = recommend.players_of(ratings, 30)
    scored = {r["user_id"]: r["prediction"] for r in recommend.audience(model, ratings, players, 30).collect()}
    gone = {r["user_id"] for r in players.collect()}
    pairs = ratings.select("user_id").distinct().withColumn("item_id", F.lit(30))
    users, items = local_factors(model)
    expected = {
        r["user_id"]: p for r in pairs.collect() if r["user_id"] not in gone and (p := users[r["user_id"]] @ items[30]) > 0
    }
    assert gone and scored == pytest.approx(expected, abs=1e-5)
    assert recommend.predict_item(model, ratings, 12345).count() == 0


def test_recommend(spark, model, ratings):
    users = spark.createDataFrame([(3,), (3,), (5,)], "user_id int")
    rows = recommend.recommend(model, users, 5).orderBy("user_id", "place").collect()
    assert [(r["user_id"], r["place"]) for r in rows] == [(u, p) for u in (3, 5) for p in range(1, 6)]
    lines = {r["line"] for r in recommend.recommendation_lines(model, users, 5).collect()}
    assert f"3 -> {', '.join(str(r['item_id']) for r in rows[:5])}" in lines and len(lines) == 2
    everyone = recommend.recommend(model, None, 5)
    assert everyone.where("user_id = 3").orderBy("place").collect() == rows[:5]
    assert everyone.select("user_id").distinct().count() == ratings.select("user_id").distinct().count()
    names = spark.createDataFrame([(i * 10, f"item {i}") for i in range(12)], "item_id int, name string")
    both = recommend.existing_and_recommended(ratings, recommend.recommend(model, users, 5), names, 3)
    kinds = {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()}
    assert kinds == {"existing": ratings.where("user_id = 3").count(), "recommended": 5}


def test_ids_beyond_32_bits(spark, model, ratings):
    """Numbered in their order, wide ids give the model of the narrow ones."""
    shift = {"user_id": F.col("user_id") + F.lit(2**40), "item_id": F.col("item_id") - F.lit(2**50)}
    wide = recommend.fit(ratings.withColumns(shift), recommend.Settings(rank=4, iterations=3, reg=0.1, alpha=2.0))
    solved = recommend.residuals(wide, ratings.withColumns(shift)).collect()
    assert {r["user_id"] - 2**40 for r in solved} == set(local_factors(model)[0])
    assert all(r["residual"] <= 1e-4 * r["scale"] for r in solved)
    assert {i + 2**50 for i in local_factors(wide)[1]} == set(local_factors(model)[1])


def test_decomposition(spark, ratings, matrix):
    dictionary = features.item_dictionary(ratings).cache()
    assert [r["item_id"] for r in dictionary.orderBy("item_index").collect()] == [i * 10 for i in range(12)]
    entries = features.indexed_entries(ratings, dictionary, "rating")
    d = decompose.decompose(entries, dictionary, 12)
    s = np.linalg.svd(matrix, compute_uv=False)
    assert np.array(d.singular_values) == pytest.approx(s, rel=1e-8)

    v = np.array([r["v"] for r in d.items.orderBy("item_index").collect()])
    assert v.T @ v == pytest.approx(np.eye(12), abs=1e-8)
    assert all(column[np.abs(column).argmax()] > 0 for column in v.T)
    rows = {r["user_id"]: r["values"] for r in decompose.reconstruct_rows(d).collect()}
    for user, values in rows.items():
        assert values == pytest.approx(matrix[user], abs=1e-8)
    cells = {(r["user_id"], r["item_id"]): r["reconstructed"] for r in decompose.reconstruct_cells(d, ratings).collect()}
    assert cells == pytest.approx({(u, i): matrix[u, i // 10] for u, i in cells}, abs=1e-8)
    items = {(r["component"], r["item_id"]): r["value"] for r in decompose.item_clusters(d).collect()}
    assert items[2, 50] == pytest.approx(d.singular_values[2] * v[5, 2])

    truncated = decompose.decompose(entries, dictionary, 3)
    assert np.array(truncated.singular_values) == pytest.approx(s[:3], rel=1e-8)
    component = lookalike.main_component(truncated, 50)
    row = truncated.items.where("item_id = 50").first()["v"]
    assert component == int(np.argmax(row))
    users = {r["user_id"]: r["u"][component] for r in truncated.users.collect()}
    column = {r["user_id"]: r["score"] for r in decompose.component(truncated, component).collect()}
    assert column == pytest.approx(users, abs=1e-9)


@pytest.mark.parametrize("sent", [decompose.SENT_BYTES, 0])
def test_decomposition_of_a_larger_matrix(spark, monkeypatch, sent):
    """More items than the basis holds at once, singular values close together: against numpy, with blocks sent and joined."""
    monkeypatch.setattr(decompose, "SENT_BYTES", sent)
    monkeypatch.setattr(decompose, "USERS_AT_ONCE", 7)
    monkeypatch.setattr(decompose, "FOLD", 1)
    monkeypatch.setattr(decompose, "EXTRA", 8)
    monkeypatch.setattr(decompose, "WIDEST", 4)
    monkeypatch.setattr(decompose, "WIDE", 20)
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(150, 90)) * (rng.random((150, 90)) < 0.3)
    cells = [(int(u) + 2**35, int(i) - 40, float(dense[u, i])) for u, i in zip(*np.nonzero(dense), strict=True)]
    rows = spark.createDataFrame(cells, "user_id long, item_id long, value double")
    dictionary = features.item_dictionary(rows).cache()
    d = decompose.decompose(features.indexed_entries(rows, dictionary, "value"), dictionary, 5)
    assert np.array(d.singular_values) == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:5], rel=1e-9)
    v = np.array([r["v"] for r in d.items.orderBy("item_index").collect()])
    u = np.array([r["u"] for r in d.users.orderBy("user_id").collect()])
    assert v.T @ v == pytest.approx(np.eye(5), abs=1e-8) and u.T @ u == pytest.approx(np.eye(5), abs=1e-6)
    assert dense @ v == pytest.approx(u * np.array(d.singular_values), abs=1e-6)
    for misfit in decompose.misfits(d):
        assert misfit.agg(F.max("misfit")).first()[0] < 1e-5


def test_products_with_blocks_of_vectors(spark):
    """Fewer items than tasks, and an item that no user has; thirty components of 60,000 items are still sent."""
    dense = np.array([[1.0, 0.0, 2.0], [0.0, 0.0, 3.0], [4.0, 0.0, 0.0]])
    rows = spark.createDataFrame([([(int(i), float(r[i])) for i in np.nonzero(r)[0]],) for r in dense], "cells array<struct<item_index: int, value: double>>")
    x = np.arange(6.0).reshape(3, 2)
    block = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "item_index int, x array<double>")
    found = {r["item_index"]: r["z"] for r in decompose._squared(None, rows, block, 2, 3).collect()}
    for i, z in enumerate(dense.T @ dense @ x):
        assert found.get(i, [0.0, 0.0]) == pytest.approx(z.tolist())
    assert 60_000 * (decompose.FOLD * 30 + decompose.EXTRA) * 8 <= decompose.SENT_BYTES


def test_decomposition_of_low_rank(spark):
    cells = [(u, i, float((u + 1) * (i % 2 + 1))) for u in range(6) for i in range(9)]
    rows = spark.createDataFrame(cells, "user_id long, item_id long, value double")
    dictionary = features.item_dictionary(rows).cache()
    entries = features.indexed_entries(rows, dictionary, "value")
    d = decompose.decompose(entries, dictionary, 4)
    assert d.singular_values == pytest.approx([np.linalg.norm([c[2] for c in cells])])
    assert d.items.count() == 9 and d.users.count() == 6
    none = decompose.decompose(entries.withColumn("value", F.lit(0.0)), dictionary, 4)
    assert none.singular_values == () and none.items.count() == 9 and none.values.count() == 0


def test_cells_of_vectors(spark):
    rows = [(1, Vectors.sparse(5, [1, 4], [2.0, 0.0])), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(5, [], []))]
    vectors = spark.createDataFrame(rows, tables.vector_schema("user_id"))
    cells = sorted(map(tuple, features.vector_cells(vectors, "features").collect()))
    assert cells == [(1, 1, 2.0), (1, 4, 0.0), (2, 0, 0.0), (2, 1, 3.0)]


def test_vectors_sum_repeated_cells(spark):
    rows = spark.createDataFrame([(1, 10, 2), (1, 10, 3), (1, 30, None), (2, 20, 4)], "user_id long, item_id int, x int")
    dictionary = features.item_dictionary(rows)
    entries = features.indexed_entries(rows, dictionary, "x")
    vectors = features.user_vectors(entries, 3)
    assert {r["user_id"]: r["features"] for r in vectors.collect()} == {
        1: Vectors.sparse(3, [0, 2], [5.0, 0.0]),
        2: Vectors.sparse(3, [1], [4.0]),
    }
    assert [r["user_id"] for r in vectors.where(features.vector_element(F.col("features"), 0) > 1).collect()] == [1]
    assert [r["user_id"] for r in features.users_above(entries, 1, 1).collect()] == [2]


def test_popularity(spark):
    train = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (1, 2, 1.0)], "user_id int, item_id int, rating double")
    pairs = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "user_id int, item_id int")
    scored = popularity.predict_popularity(pairs, popularity.popularity(train))
    assert {r["item_id"]: r["prediction"] for r in scored.collect()} == {1: 5.0, 2: 1.0, 3: 0.0}
    stats = popularity.id_stats(train, ["item_id"]).first()
    assert (stats["count"], stats["max"], stats["min"]) == (3, 2.0, 1.0)
    assert stats["stdev"] == pytest.approx(np.std([1, 1, 2]))


def cluster_rows(spark):
    rows = []
    for i in range(60):
        centre = [0.0, 10.0, 20.0][i % 3]
        rows.append((i, Vectors.dense([centre + (i % 5) * 0.1, centre]), i % 3 == 1, i % 3 == 1 and i % 2 == 0))
    return spark.createDataFrame(rows, ["user_id", "features", "is_target", "held_out"])


def test_cluster_sweep_and_report(spark):
    data = cluster_rows(spark)
    sweep = clusters.sweep(data, (2, 3), seed=1, iterations=20)
    rows = {r["k"]: r for r in sweep.collect()}
    assert rows[3]["recall"] == 1.0 and rows[3]["target_cluster"] == rows[3]["test_cluster"]
    assert clusters.lowest_cost(sweep).first()["k"] == 3
    model = clusters.fit(data, 3, 1, 20)
    report = clusters.report(clusters.assign(model, data))
    totals = {r["segment"]: r["total"] for r in report.groupBy("segment").agg(F.sum("count").alias("total")).collect()}
    assert totals == {"all": 60, "target": 20, "test": 10}
    assert clusters.centres(model, spark).count() == 6


def test_distances_to_centres(spark, monkeypatch):
    """Sparse, dense and empty vectors, measured from what they store: as numpy has it from what they stand for."""
    monkeypatch.setattr(clusters, "HELD_NUMBERS", 5)
    dense = {1: [0.0, 2.0, 0.0, 5.0], 2: [1.0, 1.0, 1.0, 1.0], 3: [0.0] * 4, 4: [0.0, 0.0, 7.0, 0.0]}
    rows = [(u, Vectors.dense(x) if u == 2 else Vectors.sparse(4, [(i, v) for i, v in enumerate(x) if v]), 0) for u, x in dense.items()]

    class Model:
        def clusterCenters(self):
            return [np.array([0.5, 0.0, 3.0, 1.0]), np.array([0.0, 2.0, 0.0, 4.0]), np.zeros(4)]

    schema = tables.vector_schema("user_id").add("cluster", IntegerType())
    found = {r["user_id"]: r["distances"] for r in clusters.distances(spark.createDataFrame(rows, schema), Model()).collect()}
    for user, x in dense.items():
        assert found[user] == pytest.approx([float(((np.array(x) - c) ** 2).sum()) for c in Model().clusterCenters()])


def test_elements_of_vectors(spark):
    """A sparse vector is not written out: this one would hold two billion numbers."""
    rows = [(1, Vectors.sparse(2**31 - 1, [1, 2**30], [2.0, 4.0])), (2, Vectors.dense([0.0, 3.0])), (3, None)]
    vectors = spark.createDataFrame(rows, tables.vector_schema("user_id"))
    elements = [features.vector_element(F.col("features"), i).alias(f"e{i}") for i in (0, 1, 5, 2**30)]
    found = {r["user_id"]: tuple(r)[1:] for r in vectors.select("user_id", *elements).collect()}
    assert found == {1: (0.0, 2.0, 0.0, 4.0), 2: (0.0, 3.0, None, None), 3: (None,) * 4}


def test_best_clustering(spark):
    data = cluster_rows(spark)
    trials_run, best_model, assigned = jobs.best_clustering(data, (2, 3), seed=1, iterations=20, parallelism=2)
    recalls = {r["k"]: r["recall"] for r in trials_run.collect()}
    assert len(best_model.clusterCenters()) == max(recalls, key=lambda k: (recalls[k], -k))
    assert assigned.count() == 60 and set(assigned.columns) == {"user_id", "is_target", "held_out", "cluster"}


def test_cross_validation(spark, ratings):
    # Every fold trains on the base rows and the other folds.
    settings = recommend.Settings(rank=2, iterations=2, reg=0.1, alpha=2.0)
    base, rows = ratings.where("item_id < 60"), ratings.where("item_id >= 60")
    result = jobs.cross_validate(base, rows, settings, seed=3, folds=3).collect()
    assert sorted(r["fold"] for r in result) == [0, 1, 2]
    recalls = [r["recall"] for r in result]
    assert result[0]["mean_recall"] == pytest.approx(sum(recalls) / 3)
    assert result[0]["recall_spread"] == pytest.approx(max(recalls) - min(recalls))
    assert sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in result) <= rows.count()


def test_holdout_recall(spark):
    schema = "cluster int, is_target boolean, held_out boolean"
    rows = [(1, True, False)] * 5 + [(2, True, True)] * 2 + [(1, True, True)] * 2 + [(3, False, False)] * 9
    result = clusters.holdout_recall(spark.createDataFrame(rows, schema)).first()
    assert (result["target_cluster"], result["test_cluster"], result["recall"]) == (1, 1, 0.5)
    away = [(1, True, False)] * 5 + [(2, True, True)] * 3
    assert clusters.holdout_recall(spark.createDataFrame(away, schema)).first()["recall"] == 0.0


def test_topics_keep_the_counts(spark):
    rows = [([float((i + j) % 4) for j in range(6)],) for i in range(20)]
    corpus = topics.count_vectors(spark.createDataFrame(rows, "counts array<double>"))
    weights = topics.topic_terms(topics.fit(corpus, 3, 5), spark)
    totals = {r["term"]: r["w"] for r in weights.groupBy("term").agg(F.sum("weight").alias("w")).collect()}
    assert totals == pytest.approx({j: sum(r[0][j] for r in rows) for j in range(6)})


def test_grids(spark):
    points = trials.grid(
        spark, trials.linear("rank", "2", "10", "2"), trials.linear("reg", "0.1", "0.5", "0.1"), trials.choices("a", 1.0, 7.0)
    )
    rows = [(r["rank"], r["reg"], r["a"]) for r in points.orderBy("point").collect()]
    assert rows == [(k, l, a) for k in (2, 4, 6, 8) for l in (0.1, 0.2, 0.3, 0.4) for a in (1.0, 7.0)]
    spaced = trials.grid(spark, trials.log_spaced("x", 0.01, 50, 100)).orderBy("point").collect()
    assert [r["x"] for r in spaced] == pytest.approx([0.01 * 5000 ** (i / 100) for i in range(100)])
    # Sizes of the three published grids.
    sizes = [
        (trials.linear("r", "2", "50", "2"), trials.linear("l", "0.0001", "15", "0.1"), trials.linear("a", "0.0001", "50", "0.1")),
        (trials.linear("r", "2", "50", "1"), trials.linear("l", "0.1", "15", "0.1"), trials.linear("a", "0.1", "50", "0.1")),
        (trials.linear("r", "2", "100", "2"), trials.log_spaced("l", 0.01, 50, 100), trials.log_spaced("a", 0.01, 50, 100)),
    ]
    assert [trials.grid(spark, *axes).count() for axes in sizes] == [1_800_000, 3_568_848, 490_000]


def test_random_trials_are_seeded(spark):
    points = trials.grid(spark, trials.linear("rank", "0", "100", "1"))
    first = trials.random_trials(points, 5, 3)
    assert first == trials.random_trials(points, 5, 3) != trials.random_trials(points, 5, 4)
    assert [t["trial"] for t in first] == list(range(5)) and len({t["point"] for t in first}) == 5


def test_failing_trials_are_reported(spark):
    def one(trial):
        if trial["trial"] == 1:
            raise RuntimeError("no luck")
        b = float("nan") if trial["trial"] == 2 else 1.0
        return spark.createDataFrame([(trial["trial"] / 10, b)], "a double, b double")

    result = trials.run_trials(spark, [Row(trial=i) for i in range(4)], one, parallelism=3)
    rows = {r["trial"]: r for r in result.collect()}
    assert rows[1]["error"] == "RuntimeError: no luck" and rows[1]["a"] is None and rows[3]["a"] == 0.3
    assert trials.best(result, "b").first()["trial"] == 0
    assert trials.best(result, "a").first()["trial"] == 3
    with pytest.raises(RuntimeError, match="no trial succeeded"):
        trials.run_trials(spark, [Row(trial=1)], one)
    with pytest.raises(RuntimeError, match="1 of 4 trials failed"):
        trials.run_trials(spark, [Row(trial=i) for i in range(4)], one, complete=True)


def test_null_metrics_keep_their_type(spark):
    def one(trial):
        return spark.createDataFrame([(None,)], "auc double")

    result = trials.run_trials(spark, [Row(trial=i) for i in range(2)], one)
    assert dict(result.dtypes)["auc"] == "double"
    assert trials.best(result, "auc").count() == 0


def test_failing_fold_is_an_error(spark, monkeypatch):
    def failing(train, test, settings, by=None):
        raise RuntimeError("fold lost")

    monkeypatch.setattr(jobs, "evaluate_model", failing)
    rows = spark.createDataFrame([(i, i % 5, 1.0) for i in range(40)], "user_id int, item_id int, rating double")
    with pytest.raises(RuntimeError, match="fold lost"):
        jobs.cross_validate(rows, rows, recommend.Settings(rank=2, iterations=1, reg=0.1, alpha=1.0), seed=1)


def test_sinks(spark, tmp_path, model):
    schema = "user_id int, item_id int, rating double, prediction double"
    rows = spark.createDataFrame([(1, 2, 1.0, 0.12345), (3, 4, 0.0, -2.0)], schema)
    path = str(tmp_path / "lines")
    for _ in range(2):
        sinks.write_lines(rows, sinks.rating_line(), path)
    assert sorted(r[0] for r in read_lines(spark, path).collect()) == ["1\t2\t1.0\t0.1235", "3\t4\t0.0\t-2.0000"]
    line = spark.createDataFrame([([0.5, 12.0],)], "v array<double>").select(sinks.matrix_line(F.col("v")))
    assert line.first()[0] == "0.5000, 12.0000"
    metrics = str(tmp_path / "metrics")
    for _ in range(3):
        sinks.append_metrics(rows.limit(1), metrics)
    assert spark.read.parquet(metrics).count() == 3
    sinks.save_model(model, str(tmp_path / "als"))
    assert sinks.load_model("als", str(tmp_path / "als")).settings.rank == 4
    vectors = spark.createDataFrame([(1, Vectors.sparse(4, [1], [2.0]))], tables.vector_schema("user_id"))
    sinks.write_table(vectors, str(tmp_path / "vectors"))
    assert tables.read_vectors(spark, str(tmp_path / "vectors")).select(vector_to_array("features")).first()[0][1] == 2.0
    loaded = topics.fit(topics.count_vectors(spark.createDataFrame([([1.0, 2.0],)] * 3, "counts array<double>")), 2, 2)
    sinks.save_model(loaded, str(tmp_path / "lda"))
    assert sinks.load_model("lda", str(tmp_path / "lda")).vocabSize() == 2


def test_staging_follows_the_session(spark, monkeypatch):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = staging.shared_dir(spark)
    assert folder == configured if configured else folder
    rows = staging.stage(spark.range(5), "t")
    assert rows.count() == 5 and folder.rstrip("/") in rows.inputFiles()[0]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_cluster_stages_in_a_mounted_folder(spark, tmp_path, monkeypatch, scheme):
    folder = f"{scheme}{tmp_path}"
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: folder)
    assert staging.shared_dir(spark) == folder
    rows = staging.stage(spark.range(5), "t")
    assert rows.count() == 5 and str(tmp_path) in rows.inputFiles()[0]


def test_a_cluster_without_a_folder_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: str(tmp_path))
    assert staging.shared_dir(spark) == str(tmp_path)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(spark)


def test_transpose(spark):
    arrays = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id long, values array<double>")
    turned = {(r["column"], r["row_id"]): r["value"] for r in decompose.transpose(arrays, "row_id", "values").collect()}
    assert turned == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0}


def test_queries_take_the_production_settings(spark, sf_dir, monkeypatch):
    assert (modelling.IMPLICIT.rank, modelling.IMPLICIT.iterations) == (56, 100)

    class Asked(Exception):
        pass

    def asked(*args, **named):
        raise Asked(args, named)

    def call(query):
        with pytest.raises(Asked) as found:
            query(spark, sf_dir)
        return found.value.args

    monkeypatch.setattr(modelling, "_clustered", lambda spark, sf_dir: None)
    monkeypatch.setattr(modelling.clusters, "sweep", asked)
    monkeypatch.setattr(jobs, "best_clustering", asked)
    numbers = {name: call(getattr(modelling, name)) for name in ("kmeans_sweep", "kmeans_lowest_cost", "kmeans_report")}
    assert {name: (args[1], args[3:]) for name, (args, _) in numbers.items()} == {
        "kmeans_sweep": (tuple(range(10, 31)), ()),
        "kmeans_lowest_cost": (tuple(range(2, 201)), ()),
        "kmeans_report": (tuple(range(10, 31)), ()),
    }
    monkeypatch.setattr(jobs, "rank_lookalikes", asked)
    assert call(ranking.svd_lookalike_sweep)[1]["k"] == 30
    monkeypatch.setattr(recommend, "fit", asked)
    settings = [call(query)[0][1] for query in (modelling.als_explicit_mse, modelling.als_nonnegative)]
    assert [(s.rank, s.iterations) for s in settings] == [(8, 50), (10, 20)]
    monkeypatch.setattr(jobs, "search_parameters", asked)
    monkeypatch.setattr(jobs, "compare_auc", asked)
    (_, points, _, base, *_), _ = call(modelling.als_random_search)
    assert (points.count(), points.select("rank").distinct().count(), base.iterations) == (490_000, 49, 100)
    (_, _, _, points, n, base), _ = call(modelling.als_auc_grid)
    assert ({r["rank"] for r in points.collect()}, points.count(), n, base.iterations) == ({10, 50}, 8, 8, 10)
