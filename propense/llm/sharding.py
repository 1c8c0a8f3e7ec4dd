"""Sharding by extendible hashing, in DataFrame operations only.

A document's place is a hash of its id and text; a shard is a hash prefix. The
directory starts with one empty prefix, and only a bucket over the byte limit
is split on another bit. The splits are read off sums of bytes per prefix: the
documents are summed once into cells of a common number of bits, the cells into
all shorter prefixes, and a prefix is a shard when it fits and the prefix one
bit shorter does not. Cells that are still too large are summed again by more
bits, they alone.

Rows that repeat id and text share all bits and cannot be split by them. They
overflow into numbered pages; a document larger than the limit has a page of
its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propense.llm.tables import free_name
from propense.operators.joins import lookup_join
from propense.sources.staging import stage

# Bytes of text a shard may hold.
SHARD_BYTES = 64 << 20

# Bits of the hash; bits of a cell beyond those that would make it as large as a shard.
BITS = 60
FINER_BITS = 3


def place(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that a document's shard is a prefix of."""
    row = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _prefix(column: str, bits: int, depth: Column | int) -> Column:
    """The first `depth` bits of a number of so many bits."""
    return F.call_function("shiftright", F.col(column), (F.lit(bits) - depth).cast("int"))


def directory(placed: DataFrame, limit: int = SHARD_BYTES) -> list[tuple[int, DataFrame]]:
    """The directory over rows with `place` and `n_bytes`, as tables of cells of more and more bits.

    Each entry is a number of bits and a table: `cell`, `depth` of its shard
    (null: see the next table), `shard_bytes`, and `alone`, whether all rows of
    the shard have one place.
    """
    total = placed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + FINER_BITS))
    fits = (F.col("bytes") <= limit) | (F.col("least") == F.col("most"))
    tables, shortest = [], 0
    while True:
        cells = stage(
            placed.groupBy(_prefix("place", BITS, bits).alias("cell")).agg(
                F.sum("n_bytes").alias("bytes"), F.min("place").alias("least"), F.max("place").alias("most")
            ),
            "shard_cells",
        )
        buckets = stage(
            cells.select("*", F.explode(F.sequence(F.lit(shortest), F.lit(bits))).alias("depth"))
            .groupBy("depth", _prefix("cell", bits, F.col("depth")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
            .withColumn("fits", fits),
            "shard_buckets",
        )
        # The directory's first bucket, and those in the cells of the round before, have no bucket above.
        above = buckets.where("fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        shards = stage(
            buckets.where("fits")
            .withColumn("up", F.expr("shiftright(prefix, 1)"))
            .join(above, ["depth", "up"], "left_anti")
            .select("depth", "prefix", F.col("bytes").alias("shard_bytes"), (F.col("least") == F.col("most")).alias("alone")),
            "shards",
        )
        first, last = shards.agg(F.min("depth"), F.max("depth")).first()
        entries = cells.select("cell")
        if first is None:
            entries = entries.selectExpr("cell", "cast(null as int) depth", "0L shard_bytes", "false alone")
        else:
            entries = (
                entries.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
                .withColumn("prefix", _prefix("cell", bits, F.col("depth")))
                .join(shards, ["depth", "prefix"])
                .select("cell", "depth", "shard_bytes", "alone")
            )
            entries = cells.select("cell").join(entries, "cell", "left")
        entries = stage(entries, "shard_directory")
        tables.append((bits, entries))
        open_cells = entries.where("depth IS NULL")
        if bits == BITS or open_cells.isEmpty():
            return tables
        placed = stage(
            lookup_join(placed.withColumn("cell", _prefix("place", BITS, bits)), open_cells.select("cell"), "cell", "left_semi"),
            "shard_open",
        )
        shortest, bits = bits + 1, min(BITS, bits + 8)


def assigned(placed: DataFrame, tables: list[tuple[int, DataFrame]], limit: int = SHARD_BYTES) -> DataFrame:
    """Rows with `place` and `n_bytes`, and what else they have, with `shard` and `shard_bytes` in place of the former.

    A shard's name is its bits, and a page's number where equal rows overflow.
    """
    columns = [c for c in placed.columns if c not in ("place", "n_bytes")]
    result = None
    for bits, entries in tables:
        found = lookup_join(placed.withColumn("cell", _prefix("place", BITS, bits)), entries, "cell")
        # Leading zeros are part of a prefix.
        name = F.concat(
            F.lit("s"),
            F.when(
                F.col("depth") > 0,
                F.lpad(F.bin(_prefix("place", BITS, F.col("depth"))), F.col("depth"), F.lit("0")),
            ).otherwise(""),
        )
        found = found.withColumn("shard", name)
        pages = F.col("alone") & (F.col("shard_bytes") > limit)
        whole = found.where(~pages).select(*columns, "n_bytes", "shard", "shard_bytes")
        result = whole if result is None else result.unionByName(whole)
        if not entries.where(pages).isEmpty():
            result = result.unionByName(_paged(found.where(pages), columns, limit))
        placed = found.where("depth IS NULL").select(*columns, "place", "n_bytes")
    return result


def _paged(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Equal rows dealt to pages: they are counted, and written out again page by page."""
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))).cast("long")
    counted = rows.groupBy(*[f"`{c}`" for c in columns], "n_bytes", "shard").agg(F.count("*").alias("_copies"))
    # A page is a row before its own rows are written out, so that pages spread over tasks.
    pages = (
        counted.withColumn("_page", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_copies") / per_page).cast("long") - 1)))
        .withColumn("_held", F.least(per_page, F.col("_copies") - F.col("_page") * per_page))
        .repartition(F.xxhash64("shard", "_page"))
    )
    return pages.select(
        *[f"`{c}`" for c in columns],
        "n_bytes",
        F.concat_ws("/", "shard", F.col("_page").cast("string")).alias("shard"),
        (F.col("_held") * F.col("n_bytes")).alias("shard_bytes"),
        F.explode(F.sequence(F.lit(1), F.col("_held").cast("int"))).alias("_row"),
    ).drop("_row")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes (of the text, null: 0), shard and shard_bytes of every row.

    No shard is larger than `limit` but for a single document that is. Repeated
    rows stay apart, also without an id; rows equal in id and text are together
    unless they overflow. Other columns are not read. An empty table gives an
    empty result.
    """
    placed = stage(docs.select("doc_id", place().alias("place"), text_bytes().alias("n_bytes")), "shard_rows")
    return assigned(placed, directory(placed, limit), limit)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the documents, all their columns, as one folder per shard; gives shard, documents and bytes.

    The shard is the folders' name and a column of the table that is read back.
    """
    placed = stage(docs.select(place().alias("place"), text_bytes().alias("n_bytes")), "shard_rows")
    tables = directory(placed, limit)
    name = free_name(docs, "shard")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = assigned(docs.select(row, place().alias("place"), text_bytes().alias("n_bytes")), tables, limit)
    whole.select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return whole.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"))
