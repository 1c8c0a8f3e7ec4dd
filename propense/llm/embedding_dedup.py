"""Near-duplicate embeddings by products of int8 tiles.

Vectors are compared within their label. Equal vectors are one; the others are
dealt to cells around a bounded sample of pivots, and by the triangle inequality
of angles a vector need only visit the cells that can hold a partner. Within a
cell, rows meet tile by tile: the product of their int8 forms, with a rigorous
bound of what rounding can have changed, settles most pairs, and only those
possibly above the threshold and not surely so are computed in full precision.

A tile gives back each vector's number of links and the few links that connect
what is linked in it, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.components import components
from propense.llm.vectors import matrix, usable
from propense.sources.staging import stage


@dataclass(frozen=True)
class Settings:
    """Least cosine of a link; rows of a tile; rows per pivot, and at most so many pivots of all kinds together."""

    cosine: float = 0.93
    tile: int = 2048
    pivot_rows: int = 2000
    pivots: int = 4096


# Slack for rounding in double precision, far above what sums of a few thousand terms lose.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows of unit vectors, each row's scale, and a bound of the length of its rounding error."""
    scale = np.abs(unit).max(axis=1) / 127
    rows = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - rows * scale[:, None], axis=1) + SLACK
    return rows.astype(np.int8), scale, error


def linked_pairs(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of all pairs of rows with at least this cosine."""
    unit_x = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit_y = y / np.linalg.norm(y, axis=1, keepdims=True)
    qx, sx, ex = quantised(unit_x)
    qy, sy, ey = quantised(unit_y)
    # Sums of int8 products below 2 ** 24 are exact in single precision, which has the fast product.
    exact = np.float32 if x.shape[1] <= (1 << 24) // (127 * 127) else np.float64
    product = (qx.astype(exact) @ qy.astype(exact).T).astype(np.float64)
    product *= sx[:, None]
    product *= sy[None, :]
    # |u.v - u'v'| <= |u - u'| |v| + |u'| |v - v'|, with |u'| <= 1 + |u - u'|.
    bound = ex[:, None] + (1 + ex)[:, None] * ey[None, :]
    i, j = np.nonzero(product + bound >= cosine - SLACK)
    open_ = np.flatnonzero((product - bound)[i, j] < cosine + SLACK)
    keep = np.ones(len(i), bool)
    for start in range(0, len(open_), 1 << 16):
        some = open_[start : start + (1 << 16)]
        a, b = x[i[some]], y[j[some]]
        keep[some] = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= cosine
    return i[keep], j[keep]


def roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `count` places the smallest one that links reach from it."""
    label = np.arange(count)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = np.minimum(label, label[label])
        same = label[i] == label[j]
        i, j = i[~same], j[~same]
    while (label[label] != label).any():
        label = label[label]
    return label


def pivots_of(vectors: DataFrame, settings: Settings) -> dict[str, np.ndarray]:
    """Unit vectors that cells form around, by kind: a bounded sample, drawn by a hash.

    A kind that has none is one cell.
    """
    rows = vectors.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = min(1 / settings.pivot_rows, settings.pivots / max(1, 2 * rows))
    drawn = vectors.where(draw < share).orderBy(draw, "id").limit(settings.pivots).select("kind", "vector").collect()
    by_kind: dict[str, list[list[float]]] = {}
    for row in drawn:
        by_kind.setdefault(row["kind"], []).append(row["vector"])
    return {
        kind: (m := np.array(rows, np.float64)) / np.linalg.norm(m, axis=1, keepdims=True) for kind, rows in by_kind.items()
    }


def angles(pivots: np.ndarray | None, vector: np.ndarray) -> np.ndarray:
    """Angle of a vector to each pivot; without pivots there is one cell, and nothing is known."""
    if pivots is None:
        return np.array([math.pi])
    vector = vector.astype(np.float64)
    return np.arccos(np.clip(pivots @ (vector / np.linalg.norm(vector)), -1, 1))


def tile_links(first: pa.Table, second: pa.Table | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of two tiles, copies counted, and the place of the smallest row each is connected to.

    Without a second tile the first one's rows meet each other.
    """
    x, wx = matrix(first["vector"]), first["weight"].to_numpy()
    if second is None:
        i, j = linked_pairs(x, x, cosine)
        other = i != j
        i, j = i[other], j[other]
        links = np.bincount(i, weights=wx[j], minlength=len(x))
        return links, roots(len(x), i, j)
    y, wy = matrix(second["vector"]), second["weight"].to_numpy()
    i, j = linked_pairs(x, y, cosine)
    links = np.concatenate(
        [np.bincount(i, weights=wy[j], minlength=len(x)), np.bincount(j, weights=wx[i], minlength=len(y))]
    )
    return links, roots(len(x) + len(y), i, j + len(x))


def linked(vectors: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Connecting links (a, b), and each id's number of links with others, copies counted (id, links).

    Rows have an id, a kind, whose vectors have one length, a vector and a weight.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(pivots_of(vectors, settings))

    @arrow_udf("struct<cell:int,angle:double>")
    def nearest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, rows in batches:
            cells, least = [], []
            for kind, row in zip(kinds.to_pylist(), rows, strict=True):
                angle = angles(sent.value.get(kind), row.values.to_numpy(zero_copy_only=False))
                cells.append(int(angle.argmin()))
                least.append(float(angle.min()))
            yield pa.StructArray.from_arrays(
                [pa.array(cells, pa.int32()), pa.array(least, pa.float64())], names=["cell", "angle"]
            )

    housed = stage(vectors.select("*", nearest("kind", "vector").alias("near")).select("*", "near.*").drop("near"), "vec_cells")
    # One row a cell: no more than there are pivots and kinds. A cell's rows are dealt to tiles by a hash.
    cells: dict[str, dict[int, tuple[float, int]]] = {}
    sizes = housed.groupBy("kind", "cell").agg(F.max("angle").alias("far"), F.count("*").alias("rows"))
    for r in sizes.collect():
        cells.setdefault(r["kind"], {})[r["cell"]] = (r["far"], math.ceil(r["rows"] / settings.tile))
    tiles = vectors.sparkSession.sparkContext.broadcast(cells)
    reach = math.acos(settings.cosine) + 1e-7
    meeting = pa.struct([(n, pa.int32()) for n in ("cell_a", "tile_a", "cell_b", "tile_b", "side")])

    @arrow_udf("array<struct<cell_a:int,tile_a:int,cell_b:int,tile_b:int,side:int>>")
    def meetings(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        # The tiles that a row's tile meets: all of its own cell, and those of every cell in reach. The
        # smaller of two (cell, tile) is side 0; a tile meets itself once.
        for kinds, rows, homes, hashes in batches:
            out = []
            for kind, row, home, spot in zip(
                kinds.to_pylist(), rows, homes.to_pylist(), hashes.to_pylist(), strict=True
            ):
                angle = angles(sent.value.get(kind), row.values.to_numpy(zero_copy_only=False))
                own = (home, spot % tiles.value[kind][home][1])
                met = []
                for cell, (far, count) in tiles.value[kind].items():
                    # A partner there is within `far` of the pivot, so the row is within `far + reach`.
                    if cell == home or angle[cell] <= far + reach:
                        for other in ((cell, t) for t in range(count)):
                            (ca, ta), (cb, tb) = min(own, other), max(own, other)
                            met.append((ca, ta, cb, tb, int(own != (ca, ta))))
                out.append([dict(zip(meeting.names, m, strict=True)) for m in met])
            yield pa.array(out, pa.list_(meeting))

    def meet(table: pa.Table) -> pa.Table:
        same = table["cell_a"][0] == table["cell_b"][0] and table["tile_a"][0] == table["tile_b"][0]
        side = table["side"].to_numpy()
        first = table if same else table.filter(pa.array(side == 0))
        second = None if same else table.filter(pa.array(side == 1))
        if not len(first) or (second is not None and not len(second)):
            return table.slice(0, 0).select(["id"]).append_column("links", pa.array([], pa.int64())).append_column(
                "root", pa.array([], pa.binary())
            )
        links, label = tile_links(first, second, settings.cosine)
        ids = first["id"].to_pylist() + ([] if second is None else second["id"].to_pylist())
        some = np.flatnonzero(links > 0)
        return pa.table(
            {
                "id": pa.array([ids[k] for k in some], pa.binary()),
                "links": pa.array(links[some].astype(np.int64)),
                "root": pa.array([ids[label[k]] for k in some], pa.binary()),
            }
        )

    spot = F.pmod(F.xxhash64("id"), F.lit((1 << 31) - 1)).cast("int")
    met = housed.select("id", "kind", "vector", "weight", F.explode(meetings("kind", "vector", "cell", spot)).alias("m"))
    found = stage(
        met.select("kind", "m.*", "id", "vector", "weight")
        .groupBy("kind", "cell_a", "tile_a", "cell_b", "tile_b")
        .applyInArrow(meet, "id binary, links long, root binary"),
        "vec_links",
    )
    return found.select(F.col("id").alias("a"), F.col("root").alias("b")), found.groupBy("id").agg(
        F.sum("links").alias("links")
    )


def identity(kind: Column, vector: Column) -> Column:
    """Column of what rows of one kind with equal vectors share; null for a null vector."""

    @arrow_udf("binary")
    def digests(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, vectors in batches:
            yield pa.array(
                (
                    hashlib.blake2b(
                        k.encode() + b":" + v.values.to_numpy(zero_copy_only=False).tobytes(), digest_size=16
                    ).digest()
                    if v.is_valid
                    else None
                    for k, v in zip(kinds.to_pylist(), vectors, strict=True)
                ),
                pa.binary(),
            )

    return digests(kind, vector)


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are linked when they have the same label and a cosine of at least the
    settings', in double precision. A vector that is null, empty, zero or holds
    null or non-finite components, or has no label, links with nothing; nor do
    vectors of different lengths. Rows with equal vectors are linked, also when
    they repeat an id. The component is the smallest vec_id reachable, for a row
    without links its own, and a row is kept when that is its vec_id, or when
    there is none. Other columns are not read. An empty table gives an empty
    result.
    """
    able = usable() & F.col("label").isNotNull()
    keyed = vectors.select(
        "vec_id",
        F.when(able, F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))).alias("kind"),
        # Zero has one sign, so that equal vectors have equal bytes.
        F.when(able, F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("vector"),
    )
    rows = stage(keyed.withColumn("id", identity(F.col("kind"), F.col("vector"))), "vec_rows")
    different = stage(
        rows.where("id IS NOT NULL")
        .groupBy("id")
        .agg(
            F.first("kind").alias("kind"),
            F.first("vector").alias("vector"),
            F.count("*").alias("weight"),
            F.min("vec_id").alias("first"),
        ),
        "vec_different",
    )
    links, counts = linked(different.drop("first"), settings)
    named = stage(
        different.select("id", "weight", "first")
        .join(components(links), "id", "left")
        .join(counts, "id", "left")
        .select(
            "id",
            "first",
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        ),
        "vec_named",
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    found = stage(named.join(smallest, "component").select("id", "n_links", "least"), "vec_found")
    component = F.coalesce("least", "vec_id")
    return (
        rows.select("vec_id", "id")
        .join(found, "id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
        )
    )
