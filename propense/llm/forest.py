"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample; every row is then routed to a leaf of
each tree. A query walks all trees through one shared priority queue, the
nearest open branch of any tree first, until the leaves it has reached hold
enough rows, and its candidates there are ranked exactly. How many rows are
enough is measured on the sample, against brute force.

Rows of the sample that lie in the leaves a query reads are candidates of it, so
the last of the best among them is a floor: a leaf sends no row below it. This
changes no result, only how many rows the leaves of a query send.

The inner product is turned into a distance by one more component that gives
all rows the same length, so that the trees fit it as well.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.vectors import common_length, matrix, usable
from propense.sources.staging import stage


@dataclass(frozen=True)
class Settings:
    """Neighbours per query and how they are found.

    The trees are grown on at most `sample` rows and have leaves of about
    `leaf` rows, but at most 2 ** `depth` leaves. `tests` rows of the sample
    are queries that measure how much of the forest must be read for `recall`.
    A task ranks at most about `block` rows against as many queries. Floors come
    from as much of the sample as fits `floor_bytes`, which every task holds.
    """

    neighbours: int = 20
    trees: int = 4
    sample: int = 32_768
    leaf: int = 1024
    depth: int = 12
    tests: int = 256
    recall: float = 0.96
    block: int = 4096
    floor_bytes: int = 1 << 26
    seed: int = 5


class Tree:
    """A complete binary tree; node n splits by the sign of normal[n].x - offset[n]; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        count = (1 << depth) - 1
        self.normal = np.zeros((count, sample.shape[1]))
        self.offset = np.zeros(count)
        groups = {0: np.arange(len(sample))}
        for node in range(count):
            group = groups.pop(node)
            points = sample[group]
            normal = self._direction(points, rng)
            along = points @ normal
            # Equal points cannot be split; a full side is then empty.
            offset = float(np.median(along)) if len(group) else 0.0
            self.normal[node], self.offset[node] = normal, offset
            groups[2 * node + 1], groups[2 * node + 2] = group[along < offset], group[along >= offset]

    @staticmethod
    def _direction(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The line through the centres of two random points' neighbourhoods, or any line."""
        if len(points) >= 2:
            a, b = points[rng.choice(len(points), 2, replace=False)]
            for _ in range(3):
                near_a = ((points - a) ** 2).sum(axis=1) < ((points - b) ** 2).sum(axis=1)
                if near_a.all() or not near_a.any():
                    break
                a, b = points[near_a].mean(axis=0), points[~near_a].mean(axis=0)
            if np.linalg.norm(a - b) > 0:
                return (a - b) / np.linalg.norm(a - b)
        line = rng.normal(size=points.shape[1])
        return line / np.linalg.norm(line)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", rows, self.normal[node]) >= self.offset[node]
            node = 2 * node + 1 + right
        return node - len(self.offset)


class Forest:
    """Trees over rows that are lengthened to a common norm."""

    def __init__(self, sample: np.ndarray, norm: float, depth: int, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.norm = norm
        longer = self.lengthened(sample)
        self.trees = [Tree(longer, depth, rng) for _ in range(settings.trees)]

    def lengthened(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (rows**2).sum(axis=1)))
        return np.hstack([rows, rest[:, None]])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        longer = self.lengthened(rows)
        return np.stack([tree.leaves(longer) for tree in self.trees], axis=1)

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue: the branch with the least negative margin first."""
        longer = np.append(query, 0.0)
        margins = [tree.normal @ longer - tree.offset for tree in self.trees]
        queue = [(-math.inf, t, 0) for t in range(len(self.trees))]
        while queue:
            bound, t, node = heapq.heappop(queue)
            inner = len(margins[t])
            if node >= inner:
                yield t, node - inner
                continue
            margin = margins[t][node]
            # The queue holds by how far a branch is missed, negated for the worst split on its path.
            heapq.heappush(queue, (max(bound, margin), t, 2 * node + 1))
            heapq.heappush(queue, (max(bound, -margin), t, 2 * node + 2))

    def enough(self, sample: np.ndarray, settings: Settings) -> float:
        """Share of the forest's rows (all trees together) to read so that the sample's neighbours are found."""
        tests = sample[: settings.tests]
        places = self.leaves(sample)
        sizes = [np.bincount(places[:, t], minlength=1 << tree.depth) for t, tree in enumerate(self.trees)]
        needed = []
        for i, query in enumerate(tests):
            score = sample @ query
            score[i] = -np.inf
            wanted = min(settings.neighbours, len(sample) - 1)
            best = np.argpartition(-score, wanted - 1)[:wanted] if wanted else np.array([], int)
            read, first = 0, {}
            for t, leaf in self.walk(query):
                read += sizes[t][leaf]
                first[t, leaf] = read
            needed += [min(first[t, places[b, t]] for t in range(len(self.trees))) for b in best]
        return float(np.quantile(needed, settings.recall)) / (len(sample) * len(self.trees)) if needed else 1.0


class Floors:
    """Rows of the sample, one per id, and their leaves."""

    def __init__(self, forest: Forest, ids: np.ndarray, sample: np.ndarray, settings: Settings):
        once = np.sort(np.unique(ids, return_index=True)[1])[: settings.floor_bytes // (8 * sample.shape[1])]
        self.ids, self.rows = ids[once], sample[once]
        self.places = forest.leaves(self.rows)
        self.leaves = 1 << forest.trees[0].depth
        self.norm, self.wanted = forest.norm, settings.neighbours

    def of(self, query_id: int, query: np.ndarray, visited: list[tuple[int, int]]) -> float:
        """A score that `wanted` rows in the visited leaves reach, other than the query's own, less what rounding may shift."""
        met = np.zeros(len(self.ids), bool)
        for tree in range(self.places.shape[1]):
            read = np.zeros(self.leaves, bool)
            read[[leaf for t, leaf in visited if t == tree]] = True
            met |= read[self.places[:, tree]]
        scores = (self.rows @ query)[met & (self.ids != query_id)]
        if len(scores) < self.wanted:
            return -math.inf
        return float(np.partition(scores, -self.wanted)[-self.wanted]) - 1e-11 * self.norm * float(np.linalg.norm(query))


def best_of(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, wanted: int
):
    """Per query the `wanted` rows of largest inner product but its own, ties to smaller ids: (query, id, score) arrays.

    Rows below the query's floor are left out.
    """
    close = queries @ rows.T
    close[(query_ids[:, None] == ids[None, :]) | (close < floors[:, None])] = -np.inf
    out = ([], [], [])
    for k in range(len(query_ids)):
        line = close[k]
        last = np.partition(line, -wanted)[-wanted] if len(line) > wanted else -np.inf
        # The product of whole blocks rounds differently from block to block: what may belong is computed alone.
        may = np.flatnonzero((line >= last - 1e-9 * (1 + abs(last))) & (line > -np.inf)) if last > -np.inf else np.flatnonzero(line > -np.inf)
        score = (rows[may] * queries[k]).sum(axis=1)
        order = np.lexsort((ids[may], -score))[:wanted]
        out[0].append(np.full(len(order), query_ids[k]))
        out[1].append(ids[may][order])
        out[2].append(score[order])
    return [np.concatenate(o) if o else np.array([]) for o in out]


def fit(rows: DataFrame, settings: Settings) -> tuple[Forest, Floors, float] | None:
    """A forest on a bounded sample of the rows, drawn by a hash, floors from it, and the share of it a query reads."""
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    total, norm = rows.agg(F.count("*"), F.max(F.sqrt(squares))).first()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30))
    share = min(1 << 30, math.ceil((1 << 30) * 1.1 * settings.sample / total))
    drawn = rows.where(draw < share).orderBy(draw, "vec_id").limit(settings.sample).select("vec_id", "vector").toArrow()
    sample = matrix(drawn["vector"])
    depth = min(settings.depth, max(0, math.ceil(math.log2(max(1, total / settings.leaf)))))
    forest = Forest(sample, norm, depth, settings)
    return forest, Floors(forest, drawn["vec_id"].to_numpy(), sample, settings), forest.enough(sample, settings)


def nearest(vectors: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of every query, all candidates if there are fewer.

    `is_query` is a condition on vec_id. Nearness is the largest inner product,
    in double precision, ties to the smaller vec_id; a query's candidates are all
    rows but those of its own id. Vectors that are null, empty, zero or hold
    null or non-finite components, or differ in length from most others, take
    no part, nor do rows without an id. Rows that repeat an id and a vector
    count once. Other columns are not read. An empty table gives an empty
    result.
    """
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vector"))
    length = common_length(vectors)
    rows = rows.where(F.size("vector") == F.lit(length if length is not None else 0))
    fitted = fit(rows, settings)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if fitted is None:
        return spark.createDataFrame([], schema)
    forest, floors, share = fitted
    sent = spark.sparkContext.broadcast(forest)
    under = spark.sparkContext.broadcast(floors)

    @arrow_udf("array<int>")
    def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(sent.value.leaves(matrix(batch))) if len(batch) else [], pa.list_(pa.int32()))

    placed = stage(rows.select("vec_id", "vector", leaves("vector").alias("leaves")), "ann_rows")
    placed = placed.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    # One number per leaf: at most trees * 2 ** depth.
    counts = {(r["tree"], r["leaf"]): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}
    budget = share * sum(counts.values())
    sizes = spark.sparkContext.broadcast(counts)
    least = settings.neighbours + 1

    @arrow_udf("struct<floor:double,leaves:array<struct<tree:int,leaf:int>>>")
    def visits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, vectors in batches:
            out = []
            for query_id, query in zip(ids.to_pylist(), matrix(vectors), strict=True):
                read, met = 0, []
                per_tree = [0] * len(sent.value.trees)
                for tree, leaf in sent.value.walk(query):
                    rows_there = sizes.value.get((tree, leaf), 0)
                    if rows_there:
                        met.append((tree, leaf))
                        read += rows_there
                        per_tree[tree] += rows_there
                    # One tree alone must hold enough different rows.
                    if read >= budget and max(per_tree) >= least:
                        break
                leaves_met = [{"tree": tree, "leaf": leaf} for tree, leaf in met]
                out.append({"floor": under.value.of(query_id, query, met), "leaves": leaves_met})
            kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())]))
            yield pa.array(out, pa.struct([("floor", pa.float64()), ("leaves", kind)]))

    asked = rows.where(is_query).select("vec_id", "vector", visits("vec_id", "vector").alias("visits"))
    asked = stage(asked.select("vec_id", "vector", "visits.*"), "ann_queries")
    walked = asked.select("vec_id", "vector", "floor", F.explode("leaves").alias("v")).select("vec_id", "vector", "floor", "v.*")
    wanted = {(r["tree"], r["leaf"]): r["count"] for r in walked.groupBy("tree", "leaf").count().collect()}
    # Blocks of a leaf's rows and of its queries: every block of the one meets every block of the other.
    grid = [
        (t, leaf, math.ceil(counts[t, leaf] / settings.block), math.ceil(n / settings.block))
        for (t, leaf), n in sorted(wanted.items())
    ]
    grid = F.broadcast(spark.createDataFrame(grid, "tree int, leaf int, row_blocks int, query_blocks int"))

    def dealt(side: int, own: str, other: str):
        block = F.pmod(F.xxhash64("vec_id", "vector"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        others = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return [F.lit(side).alias("side"), "tree", "leaf", "vec_id", "vector", "floor", block, others]

    met = placed.withColumn("floor", F.lit(None).cast("double")).join(grid, ["tree", "leaf"]).select(*dealt(0, "row", "query")).unionByName(
        walked.join(grid, ["tree", "leaf"]).select(*dealt(1, "query", "row"))
    )
    neighbours = settings.neighbours

    def rank(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        some, asking = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if len(some) and len(asking):
            q, v, s = best_of(
                some["vec_id"].to_numpy(),
                matrix(some["vector"]),
                asking["vec_id"].to_numpy(),
                matrix(asking["vector"]),
                asking["floor"].to_numpy(),
                neighbours,
            )
        else:
            q, v, s = [], [], []
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = met.groupBy("tree", "leaf", "row_block", "query_block").applyInArrow(rank, "query_id long, vec_id long, score double")
    # A candidate met in several trees has the same score in each.
    once = found.repartition("query_id").dropDuplicates(["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
