"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight. A source
first takes as many complete epochs as its target holds; what is left of the
target is filled with the documents of the smallest keys, up to the place where
the prefix sum of their sizes reaches it. One more document, the one whose size
comes nearest to what is then missing, closes the gap if that helps.

A prefix sum over a source never meets in one task: ranges of keys are summed
first, and only the range that holds the cut is sorted. All that is decided is
one row for each source, so texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propense.operators.joins import lookup_join
from propense.sources.staging import stage

# The shares of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"

# Documents that a range of keys holds on average.
RANGE_ROWS = 20_000


def words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """Weight of a document from 0.1 to 1, by the share of its characters that are letters or white space."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def sampling_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The key of a document: -ln(u) / quality, with u drawn from a hash of its id and text.

    Reruns draw the same. Rows that repeat id and text share a key and with it
    their fate.
    """
    row = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    # 52 bits, shifted by a half: never 0 or 1.
    u = (F.conv(F.substring(F.md5(row.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality(text)


def source_key(source: str = "source") -> Column:
    """A source's name for joins, which null has as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def targets(keyed: DataFrame) -> DataFrame:
    """Per source: source_key, source_size and target, from rows with source_key and size.

    Sources weigh 5, 2, 1, 5, ... by code point, null last, and share 150 % of
    all words; a target stops at twice its source's size, and the excess is
    shared again by weight among the others.
    """
    sizes = stage(keyed.groupBy("source_key").agg(F.sum("size").alias("source_size")), "mix_sources")
    # One row a source: names of sources, not documents, are numbered here.
    order = Window.orderBy(F.col("source_key") == "", "source_key")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = stage(
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("most", (MOST_EPOCHS * F.col("source_size")).cast("double")),
        "mix_weights",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    pool, level, full = SHARE * total, 0.0, -1
    while True:
        # The level only rises, so a source that is full stays full.
        over = F.col("weight") * level > F.col("most")
        count, held, weights = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if count == full or not weights:
            break
        full, level = count, (pool - (held or 0.0)) / weights
    return sources.select(
        "source_key", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target")
    )


def cuts(keyed: DataFrame) -> DataFrame:
    """What is taken of each source, from rows with source_key, size and key.

    Columns: source_key, source_size, target, `epochs` complete passes, `rest`
    still to be filled, the `cut_range` and `cut_key` up to which documents no
    larger than the rest are taken once more, `closing_key` of the one that
    closes the gap, and the number of `ranges`.
    """
    shares = stage(
        targets(keyed)
        .withColumn("epochs", F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MOST_EPOCHS)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix_targets",
    )
    ranges = max(1, math.ceil(keyed.count() / RANGE_ROWS))
    fitting = (
        lookup_join(keyed, shares.select("source_key", "rest"), "source_key", "inner")
        .where((F.col("size") > 0) & (F.col("rest") >= 1))
        .withColumn("range", key_range(F.col("key"), ranges))
    )
    fitting = stage(
        # Rows that share a key count as one.
        fitting.groupBy("source_key", "range", "key", "rest").agg(F.sum("size").alias("size")),
        "mix_fitting",
    )
    small = fitting.where(F.col("size") <= F.col("rest"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = small.groupBy("source_key", "range", "rest").agg(F.sum("size").alias("sum"))
    cut = stage(
        sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
        .select("source_key", F.col("range").alias("cut_range"), "before"),
        "mix_ranges",
    )
    upto = Window.partitionBy("source_key").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut_keys = (
        lookup_join(small, cut, "source_key", "inner")
        .where(F.col("range") == F.col("cut_range"))
        .withColumn("upto", F.col("before") + F.sum("size").over(upto))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy("source_key")
        .agg(F.max("key").alias("cut_key"))
    )
    shares = stage(
        shares.join(cut.drop("before"), "source_key", "left").join(cut_keys, "source_key", "left"), "mix_cuts"
    )
    places = lookup_join(fitting.drop("rest"), shares, "source_key", "inner")
    gaps = places.groupBy("source_key").agg(
        (F.first("rest") - F.coalesce(F.sum(F.when(before_cut(F.col("range")), F.col("size"))), F.lit(0))).alias("gap")
    )
    closing = (
        lookup_join(places.where(~before_cut(F.col("range"))), stage(gaps, "mix_gaps"), "source_key", "inner")
        .withColumn("off", F.abs(F.col("size") - F.col("gap")))
        .where(F.col("off") < F.col("gap"))
        .groupBy("source_key")
        .agg(F.min(F.struct("off", "key"))["key"].alias("closing_key"))
    )
    return stage(shares.join(closing, "source_key", "left").withColumn("ranges", F.lit(ranges)), "mix_decided")


def key_range(key: Column, ranges: int | Column) -> Column:
    """Ranges of about as many keys, in the keys' order."""
    return F.floor((1 - F.exp(-key)) * ranges).cast("long")


def before_cut(ranged: Column) -> Column:
    """Whether a row with size and key, in this range of keys, lies before its source's cut; without one, all that fit do."""
    below = F.col("cut_range").isNull() | (ranged < F.col("cut_range"))
    at = (ranged == F.col("cut_range")) & (F.col("key") <= F.coalesce(F.col("cut_key"), F.lit(-1.0)))
    return (F.col("size") <= F.col("rest")) & (F.col("size") > 0) & (F.col("rest") >= 1) & (below | at)


def keyed_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", words().alias("size"), sampling_key().alias("key"), source_key().alias("source_key"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    A null text has no words. A null source is a source of its own, the last
    one. Rows stay apart, also when they have no id; rows that repeat id and
    text share a key and are taken together. Other columns are not read. An
    empty table gives an empty result, and a table without words takes none.
    """
    keyed = stage(keyed_documents(docs), "mix_keyed")
    decided = cuts(keyed)
    return lookup_join(keyed, decided, "source_key", "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken")
    )


def copies() -> Column:
    """How often the mix takes a row that has size, key and its source's decisions."""
    fits = before_cut(key_range(F.col("key"), F.col("ranges")))
    closes = F.coalesce(F.col("key") == F.col("closing_key"), F.lit(False)) & (F.col("size") > 0)
    return F.col("epochs") + (fits | closes).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: every row as often as the mix takes it, with all its columns.

    Documents without words have no place in a mix by words and are dropped.
    """
    keyed = stage(keyed_documents(docs).drop("doc_id"), "mix_keyed")
    decided = cuts(keyed)
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        words().alias("size"),
        sampling_key().alias("key"),
        source_key().alias("source_key"),
    )
    taken = lookup_join(own, decided, "source_key", "inner").withColumn("copies", copies().cast("int"))
    return (
        taken.where((F.col("copies") > 0) & (F.col("size") > 0))
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
