"""Collaborative filtering by alternating least squares."""

from __future__ import annotations

import contextlib
import gc
import json
import math
import threading
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.limits import BROADCAST_BYTES
from propense.operators.factors import iterate
from propense.operators.features import reindex
from propense.operators.joins import lookup_join
from propense.operators.popularity import names_of
from propense.sources.staging import shared_dir, stage

# Blocks of users and of items beyond which the pairwise exchange costs more than it spreads.
MAX_BLOCKS = 1000

# Bytes of factors that the blocks of one fit may leave behind in shuffles before they are dropped.
# A fit that exchanges more than that in one iteration has the cluster to itself.
EXCHANGED_BYTES = 512 << 20
_ALONE = threading.Lock()

# Ratings from which an iteration between packed blocks takes less time than one of Spark's solver.
PACKED_RATINGS = 100_000

# Ids that the solver takes as they are.
LEAST_ID, MOST_ID = -(2**31), 2**31 - 1

# Scores of users and items that a task holds at once while it looks for the best items.
HELD_SCORES = 1 << 22


@dataclass(frozen=True)
class Settings:
    """Parameters of one model; `alpha` is used by implicit models only."""

    rank: int = 10
    iterations: int = 10
    reg: float = 0.01
    alpha: float = 0.01
    implicit: bool = True
    nonnegative: bool = False
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """Factors as staged tables: `users` (user_id, user_factor) and `items` (item_id, item_factor), under the ids of the ratings."""

    users: DataFrame
    items: DataFrame
    settings: Settings


def fit(ratings: DataFrame, settings: Settings) -> Model:
    """Fit a model to `user_id, item_id, rating`, ids being whole numbers of up to 64 bits.

    An implicit rating is a strength and not below zero; zero or null carries no
    weight. The fit sees the ratings that carry some. A user or an item without
    any has the zero factor, which is what its equations say: nothing pulls it
    away from zero, and it pulls at nobody. (In the fit itself such equations
    would have no regularisation and no unique solution.) Ratings without any
    weight give a model of zero factors.

    The number of blocks follows the cluster's parallelism up to a bound, since
    blocks exchange factors pairwise. The factors are checkpointed to the shared
    folder to cut the lineage and to drop the shuffles of the iterations before:
    every ten iterations, or sooner where these take much disk. Of the fits that
    exchange much in every iteration only one runs at a time. Large fits start
    from the solver's first factors and go on between packed blocks
    (`operators/factors.py`), which takes the same steps with less work and
    exchange. Ids beyond 32 bits are numbered for the fit.
    """
    ids = ["user_id", "item_id"]
    rows = stage(ratings.select(*(F.col(c).cast("long").alias(c) for c in ids), F.col("rating").cast("float").alias("rating")), "ratings")
    bounds = [f(c).alias(f"{name}_{c}") for c in ids for name, f in (("least", F.min), ("most", F.max), ("distinct", F.approx_count_distinct))]
    counts = [F.count_if(F.col("rating") > 0).alias("above"), F.count_if(F.col("rating") < 0).alias("below"), F.count("*").alias("all")]
    seen = rows.agg(*counts, *bounds).first()
    if settings.implicit and seen["below"]:
        raise ValueError(f"{seen['below']} ratings below zero; implicit ratings are strengths")
    weighted = rows.where("rating > 0") if settings.implicit else rows
    if settings.implicit and not seen["above"] or seen["least_user_id"] is None:
        return _completed(None, rows, settings)

    names = {}
    for column in ids:
        if seen[f"least_{column}"] < LEAST_ID or seen[f"most_{column}"] > MOST_ID:
            weighted, names[column] = reindex(weighted, column)
    shared_dir(ratings.sparkSession)
    blocks = min(max(10, ratings.sparkSession.sparkContext.defaultParallelism), MAX_BLOCKS)
    count, distinct = seen["above" if settings.implicit else "all"], [seen[f"distinct_{c}"] for c in ids]
    interval, alone = _exchange(count, distinct, blocks, settings.rank)
    # Where the items' factors fit a broadcast, Spark's solver only gives the first factors of a large fit.
    fits = distinct[1] * settings.rank * 4 <= BROADCAST_BYTES
    packed = fits and count >= PACKED_RATINGS and not settings.nonnegative and settings.reg > 0 and settings.iterations > 0
    als = ALS(
        rank=settings.rank,
        maxIter=0 if packed else settings.iterations,
        regParam=settings.reg,
        alpha=settings.alpha,
        implicitPrefs=settings.implicit,
        nonnegative=settings.nonnegative,
        seed=settings.seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        checkpointInterval=interval,
    )
    with _ALONE if alone else contextlib.nullcontext():
        narrow = weighted.select(*(F.col(c).cast("int").alias(c) for c in ids), "rating")
        fitted = als.fit(narrow)
        found = fitted.userFactors, fitted.itemFactors
        if packed:
            found = iterate(narrow, found[0], settings.rank, settings.iterations, settings.reg, settings.alpha, settings.implicit)
        factors = {}
        for column, table in zip(ids, found, strict=True):
            table = table.select(F.col("id").cast("long").alias(column), "features")
            if column in names:
                wide = names[column].select(F.col(column).alias("_wide"), F.col("dense").cast("long").alias(column))
                table = table.join(wide, column).select(F.col("_wide").alias(column), "features")
            factors[column] = table
        model = _completed(factors, rows, settings)
        if alone:
            # Blocks of ratings and their shuffles go with the driver's garbage only.
            del als, fitted, found, factors, table
            gc.collect()
            ratings.sparkSession._jvm.System.gc()
    return model


def _exchange(ratings: int, ids: list[int], blocks: int, rank: int) -> tuple[int, bool]:
    """After how many iterations a fit drops its shuffles, and whether it exchanges too much to have others beside it.

    A factor goes once to every block that has ratings of its id.
    """
    each = sum(min(ratings, n * blocks) for n in ids) * 4 * rank
    return min(10, max(1, EXCHANGED_BYTES // max(1, each))), each > EXCHANGED_BYTES


def _completed(factors: dict[str, DataFrame] | None, rows: DataFrame, settings: Settings) -> Model:
    """The model with a zero factor for every id of the ratings that the fit has not seen."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), settings.rank).alias("features")
    tables = []
    for column, name in (("user_id", "user_factor"), ("item_id", "item_factor")):
        ids = rows.select(column).distinct()
        if factors is None:
            table = ids.select(column, zero)
        elif settings.implicit:
            table = factors[column].union(ids.join(factors[column], column, "left_anti").select(column, zero))
        else:
            table = factors[column]
        tables.append(stage(table.withColumnRenamed("features", name), name))
    return Model(*tables, settings)


def save(model: Model, path: str) -> None:
    """Store the factors and the settings."""
    spark = model.users.sparkSession
    model.users.write.mode("overwrite").parquet(f"{path}/users")
    model.items.write.mode("overwrite").parquet(f"{path}/items")
    spark.createDataFrame([(json.dumps(asdict(model.settings)),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Model:
    settings = Settings(**json.loads(spark.read.parquet(f"{path}/settings").first()[0]))
    return Model(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"), settings)


def user_factors(model: Model) -> DataFrame:
    return model.users


def item_factors(model: Model) -> DataFrame:
    return model.items


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def predict(model: Model, pairs: DataFrame) -> DataFrame:
    """Score (user, item) pairs; pairs with an unknown user or item are absent.

    Pairs often name few items, so both factor tables are joined as lookups
    that survive an item or user that owns much of the pairs.
    """
    known = lookup_join(pairs, model.items, "item_id", "inner")
    both = lookup_join(known, model.users, "user_id", "inner")
    return both.withColumn("prediction", dot(F.col("user_factor"), F.col("item_factor"))).drop(
        "user_factor", "item_factor"
    )


def predict_item(model: Model, users: DataFrame, item_id: int) -> DataFrame:
    """Score distinct users for one item. Its factors, one row, go into the plan, so nothing is joined on the item."""
    known = model.users.join(users.select("user_id"), "user_id", "left_semi")
    row = model.items.where(F.col("item_id") == item_id).first()
    if row is None:
        known, factor = known.where(F.lit(False)), F.lit(None).cast("array<float>")
    else:
        factor = F.lit(list(row["item_factor"]))
    return known.select(
        "user_id", F.lit(item_id).alias("item_id"), dot(F.col("user_factor"), factor).alias("prediction")
    )


def players_of(interactions: DataFrame, item_id: int) -> DataFrame:
    """Distinct users of an item."""
    return interactions.where(F.col("item_id") == item_id).select("user_id").distinct()


def non_players(candidates: DataFrame, players: DataFrame) -> DataFrame:
    """Distinct candidates that do not use the item yet."""
    return candidates.select("user_id").distinct().join(players, "user_id", "left_anti")


def audience(model: Model, candidates: DataFrame, players: DataFrame, item_id: int) -> DataFrame:
    """Users that do not use the item and score above zero for it: `user_id, item_id, prediction`."""
    scored = predict_item(model, non_players(candidates, players), item_id)
    return scored.where((F.col("prediction") > 0) & ~F.isnan("prediction"))


def _blocks(model: Model) -> tuple[list[DataFrame], list[float]]:
    """The items by falling length of their factors, in blocks that fit a broadcast, and the longest factor of each."""
    items = stage(model.items.withColumn("length", F.sqrt(dot(F.col("item_factor"), F.col("item_factor")))), "item_lengths")
    bound = max(1, BROADCAST_BYTES // (8 * model.settings.rank + 64))
    count = items.count()
    cuts: list[float] = []
    if count > bound:
        shares = [i / math.ceil(2 * count / bound) for i in range(1, math.ceil(2 * count / bound))]
        cuts = sorted(set(items.agg(F.percentile_approx("length", shares, 100 * len(shares))).first()[0]), reverse=True)
    ranges = zip([math.inf, *cuts], [*cuts, -1.0], strict=True)
    blocks, longest = [], []
    for upper, lower in ranges:
        within = items.where((F.col("length") <= upper) & (F.col("length") > lower))
        size, most = within.agg(F.count("*"), F.max("length")).first()
        # Very many items of one length are dealt into several blocks.
        deals = math.ceil(size / bound)
        for deal in range(deals):
            blocks.append(within.where(F.pmod(F.xxhash64("item_id"), F.lit(deals)) == deal).select("item_id", "item_factor"))
            longest.append(most)
    return blocks, longest


def _matrix(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, rank)


def _largest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their ids, equal scores by id. Ids may differ from row to row."""
    k = min(k, scores.shape[1])
    if k == 0:
        return np.empty((len(scores), 0)), np.empty((len(scores), 0), np.int64)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out_scores, out_ids = np.empty((len(scores), k)), np.empty((len(scores), k), np.int64)
    for row, least in enumerate(kth):
        places = np.flatnonzero(scores[row] >= least)
        mine = ids[row] if ids.ndim == 2 else ids
        best = places[np.lexsort((mine[places], -scores[row, places]))[:k]]
        out_scores[row], out_ids[row] = scores[row, best], mine[best]
    return out_scores, out_ids


_TOP = "user_id long, user_factor array<float>, items array<long>, scores array<double>, done boolean"


def _with_block(block, rank: int, k: int, following: float | None):
    """Task that adds a block's items to the best items of its users, and says whose no later block can change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, factors = block.value
        for batch in batches:
            step = max(1, HELD_SCORES // max(1, len(ids)))
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                users = _matrix(some.column("user_factor"), rank)
                scores, items = _largest(users @ factors.T, ids, k)
                held = some.column("items").to_pylist()
                if held[0]:
                    scores = np.concatenate([np.array(some.column("scores").to_pylist()), scores], axis=1)
                    items = np.concatenate([np.array(held, np.int64), items], axis=1)
                    scores, items = _largest(scores, items, k)
                done = np.full(len(users), following is None)
                if following is not None and scores.shape[1] == k:
                    # No factor that follows is longer, so no product with one is larger than this.
                    done = scores[:, -1] > np.linalg.norm(users, axis=1) * following * (1 + 1e-9)
                columns = [
                    some.column("user_id"),
                    some.column("user_factor"),
                    pa.array(list(items), pa.list_(pa.int64())),
                    pa.array(list(scores), pa.list_(pa.float64())),
                    pa.array(done),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["user_id", "user_factor", "items", "scores", "done"])

    return run


def best_items(model: Model, users: DataFrame | None, k: int) -> DataFrame:
    """`user_id, items, scores`: the k items of the largest predictions, equal ones by id; without `users`, for all of the model.

    Exact, and no row is made per user and item. The items come in blocks of
    falling factor length, each small enough for a broadcast; a user whose k-th
    prediction exceeds what the longest factor of the next block could give is
    done. A user of the zero factor predicts 0 for all items and takes the
    smallest ids.
    """
    spark, rank = model.users.sparkSession, model.settings.rank
    asked = model.users if users is None else model.users.join(users.select("user_id").distinct(), "user_id", "left_semi")
    none = F.array().cast("array<long>"), F.array().cast("array<double>")
    asked = asked.select("user_id", "user_factor", none[0].alias("items"), none[1].alias("scores"))
    zero = F.forall("user_factor", lambda x: x == 0)
    smallest = [row[0] for row in model.items.select("item_id").orderBy("item_id").limit(k).collect()]
    found = asked.where(zero).select(
        "user_id",
        F.lit(smallest).cast("array<long>").alias("items"),
        F.lit([0.0] * len(smallest)).cast("array<double>").alias("scores"),
    )
    open_ = asked.where(~zero)
    blocks, longest = _blocks(model)
    for block, following in zip(blocks, [*longest[1:], None][: len(blocks)], strict=True):
        rows = block.orderBy("item_id").toArrow()
        factors = _matrix(rows["item_factor"].combine_chunks(), rank)
        sent = spark.sparkContext.broadcast((rows["item_id"].to_numpy(), factors))
        scored = stage(open_.mapInArrow(_with_block(sent, rank, k, following), _TOP), "best_items")
        sent.destroy()
        found = found.union(scored.where("done").select("user_id", "items", "scores"))
        open_ = scored.where("NOT done").drop("done")
        if following is not None and open_.isEmpty():
            break
    return found


def above(model: Model, bounds: DataFrame) -> DataFrame:
    """`user_id, items_above`: how many items a user of `user_id, last` is predicted more than `last` for.

    Every block of items is read whole: this is what the early ends of `best_items` are held against.
    """
    spark, rank = model.users.sparkSession, model.settings.rank
    counted = lookup_join(model.users, bounds, "user_id", "inner").select("user_id", "user_factor", "last", F.lit(0).cast("long").alias("items_above"))

    def with_block(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factors = block.value
            for batch in batches:
                users, last = _matrix(batch.column("user_factor"), rank), batch.column("last").to_numpy()
                more = np.zeros(len(users), np.int64)
                step = max(1, HELD_SCORES // max(1, len(users)))
                for start in range(0, len(factors), step):
                    # A hair above, for a prediction may differ by rounding from the one in the bound.
                    more += (users @ factors[start : start + step].T > last[:, None] + 1e-9).sum(axis=1)
                total = pa.array(batch.column("items_above").to_numpy() + more)
                yield batch.set_column(3, "items_above", total)

        return run

    for block in _blocks(model)[0]:
        sent = spark.sparkContext.broadcast(_matrix(block.toArrow()["item_factor"].combine_chunks(), rank))
        counted = stage(counted.mapInArrow(with_block(sent), counted.schema), "items_above")
    return counted.select("user_id", "items_above")


def recommend(model: Model, users: DataFrame | None, k: int) -> DataFrame:
    """The k best items of each user: `user_id, place, item_id, prediction`."""
    top = best_items(model, users, k).select("user_id", F.posexplode(F.arrays_zip("items", "scores")).alias("place", "best"))
    return top.select(
        "user_id",
        (F.col("place") + 1).alias("place"),
        F.col("best.items").alias("item_id"),
        F.col("best.scores").alias("prediction"),
    )


def recommendation_lines(model: Model, users: DataFrame | None, k: int) -> DataFrame:
    """`user -> item, item, ...` in order of preference."""
    items = F.array_join(F.col("items").cast("array<string>"), ", ")
    return best_items(model, users, k).select(F.concat(F.col("user_id").cast("string"), F.lit(" -> "), items).alias("line"))


def gram(factors: DataFrame, column: str, rank: int) -> np.ndarray:
    """The sum of x x^T over a table of factors; rank x rank numbers per task are added up."""

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            x = _matrix(batch.column(0), rank)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank)), pa.array(total.ravel())], names=["place", "value"])

    parts = factors.select(column).mapInArrow(squared, "place long, value double")
    out = np.zeros(rank * rank)
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row["place"]] = row["value"]
    return out.reshape(rank, rank)


def residuals(model: Model, ratings: DataFrame) -> DataFrame:
    """How well every user's factor solves the user's equations: `user_id, residual, scale`.

    `residual` is the largest entry of (Y^T C Y + reg n I) x - Y^T C p, without
    those entries that a non-negative factor of 0 may leave positive, and `scale`
    the largest sum of the absolute terms of an entry. One row per rating and
    entry of the factor is summed up, so the work is linear in the rank. Users
    are solved last, so their equations hold up to rounding.
    """
    s = model.settings
    cells = ratings.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.col("rating").cast("double").alias("rating"))
    cells = cells.where("rating > 0") if s.implicit else cells
    cells = lookup_join(lookup_join(cells, model.items, "item_id", "inner"), model.users, "user_id", "inner")
    confidence, rating = (F.col("rating") * s.alpha, F.lit(1.0)) if s.implicit else (F.lit(1.0), F.col("rating"))
    weight = confidence + 1 if s.implicit else confidence
    p = dot(F.col("user_factor"), F.col("item_factor"))
    cells = cells.select(
        "user_id",
        (confidence * p - weight * rating).alias("pull"),
        (F.abs(confidence * p) + F.abs(weight * rating)).alias("size"),
        F.posexplode("item_factor").alias("place", "y"),
    )
    sums = cells.groupBy("user_id", "place").agg(
        F.sum(F.col("pull") * F.col("y")).alias("pull"), F.sum(F.col("size") * F.abs("y")).alias("size"), F.count("*").alias("n")
    )
    everywhere = gram(model.items, "item_factor", s.rank) if s.implicit else np.zeros((s.rank, s.rank))
    rows = F.lit(everywhere.tolist())
    common = F.transform(rows, lambda row: dot(row, F.col("user_factor")))
    entries = model.users.select("user_id", common.alias("all"), F.posexplode("user_factor").alias("place", "x"))
    entries = entries.select("user_id", "place", F.col("x").cast("double").alias("x"), F.get("all", F.col("place")).alias("common"))
    entries = entries.join(sums, ["user_id", "place"], "left").na.fill(0, ["pull", "size", "n"])
    own = s.reg * F.col("n") * F.col("x")
    entry = F.col("common") + own + F.col("pull")
    left = F.when(F.col("x") > 0, F.abs(entry)).otherwise(F.greatest(-entry, F.lit(0.0))) if s.nonnegative else F.abs(entry)
    return entries.groupBy("user_id").agg(
        F.max(left).alias("residual"), F.max(F.abs("common") + F.abs(own) + F.col("size")).alias("scale")
    )


def existing_and_recommended(
    interactions: DataFrame, recommendations: DataFrame, names: DataFrame, user_id: int
) -> DataFrame:
    """Names of the items a user has and of those recommended to the user: `kind, item_id, name`."""
    mine = F.col("user_id") == user_id
    existing = names_of(names, interactions.where(mine)).withColumn("kind", F.lit("existing"))
    proposed = names_of(names, recommendations.where(mine)).withColumn("kind", F.lit("recommended"))
    return existing.unionByName(proposed).select("kind", "item_id", "name")
