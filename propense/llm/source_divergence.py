"""Which sources differ from the rest of their language, and by which terms: count-cell ranking.

Terms are runs of ASCII letters, in lower case, and of anything beyond ASCII. A
language keeps the terms that occur in at least so many of its documents. Every
group (documents of one language and source) and every language gives each kept
term a scaled probability p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), and two
of them differ in a term by f = floor((p - q)**2 / (p + q)).

p depends on a count alone, so terms with the same counts need no f of their
own. They are gathered into cells, (group count, language count) for the terms
of a group and (count here, count there) for two sources, and f is evaluated
per cell, in exact integers. Cells are ranked by f; a cell's number of terms
says how many ranks it takes, cells of one value are merged, and only the few
that reach the wanted ranks are expanded into their terms, in UTF-8 order.

The terms that occur in one of two sources only are never paired: over the terms
of both, sums of f(c, 0) and f(0, c) are taken off what each source's own cells add up to.

Nulls in text, language and source are empty strings. Every row is a document,
also one that repeats another. A group without terms, or a language that keeps
none, still has its pairs, of value 0 where no term is kept. A source that is
alone in its language has no pair. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propense.llm.tables import texts_of
from propense.operators.joins import lookup_join
from propense.sources.staging import stage

SCALE = 1_000_000_000

# ASCII letters in lower case, any other ASCII as a separator; bytes of longer characters stay.
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
# Bytes of a text that are split at once, and terms that a task adds up before it passes them on.
SPLIT_BYTES = 1 << 20
HELD_TERMS = 200_000

COUNTS = "lang string, source string, term string, count long, docs long"


@dataclass(frozen=True)
class Settings:
    """Documents of a language that a kept term occurs in at least, and the ranks of a group's terms."""

    documents: int = 10
    ranks: int = 10


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    translated = text.encode().translate(TERM_BYTES)
    start = 0
    while start < len(translated):
        end = translated.find(b" ", start + SPLIT_BYTES)
        end = len(translated) if end < 0 else end
        yield translated[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group a row without a term, and a row for each term: its occurrences, and the documents that have it."""
    counts: defaultdict[tuple, Counter] = defaultdict(Counter)
    docs: defaultdict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            names = [None, *(t.decode() for t in found)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(names), pa.string()),
                    pa.array([source] * len(names), pa.string()),
                    pa.array(names, pa.string()),
                    pa.array([0, *found.values()], pa.int64()),
                    pa.array([0, *(docs[lang, source][t] for t in found)], pa.int64()),
                ],
                names=["lang", "source", "term", "count", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        langs, sources = texts_of(batch.column("lang")), texts_of(batch.column("source"))
        for lang, source, text in zip(langs, sources, texts_of(batch.column("text")), strict=True):
            mine, group = Counter(), counts[lang, source]
            for some in terms(text):
                mine.update(some)
            before = len(group)
            group.update(mine)
            docs[lang, source].update(mine.keys())
            held += len(group) - before
            if held > HELD_TERMS:
                yield from flushed()
                held = 0
    yield from flushed()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of each group's terms, and the documents that have them.

    Every group also has a row without a term.
    """
    counted = documents.select("lang", "source", "text").mapInArrow(_counted, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def scaled(count: str, total: str, kept: str) -> Column:
    """p of a count, in exact decimals: the product leaves 64 bits from nine billion occurrences on."""
    return F.expr(f"1 + (cast({SCALE} as decimal(38, 0)) * ({count} + 2)) div ({total} + 2 * {kept})")


def divergence(p: Column, q: Column) -> Column:
    """f of two scaled probabilities, neither above SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


@dataclass(frozen=True)
class Audit:
    """`groups`: lang, source, total, kept; `counts`: lang, source, term, count, lang_count; of kept terms, staged."""

    groups: DataFrame
    counts: DataFrame
    langs: DataFrame


def gathered(documents: DataFrame, settings: Settings = Settings()) -> Audit:
    """Kept terms and their counts, the totals of groups and languages."""
    counts = stage(term_counts(documents), "divergence_counts")
    found = counts.where("term IS NOT NULL")
    by_lang = found.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
    vocabulary = stage(
        by_lang.where(F.col("docs") >= settings.documents).select("lang", "term", "lang_count"), "divergence_terms"
    )
    kept = stage(
        lookup_join(found.drop("docs"), vocabulary, ["lang", "term"], "inner"), "divergence_kept"
    )
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_count").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = (
        counts.where("term IS NULL")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
    )
    return Audit(stage(groups, "divergence_groups"), kept, langs)


def top_terms(audit: Audit, settings: Settings = Settings()) -> DataFrame:
    """lang, source, item, value, rank: the kept terms that a group uses more than its language, the widest apart first."""
    group = ["lang", "source"]
    cells = audit.counts.groupBy(*group, "count", "lang_count").agg(F.count("*").alias("terms"))
    valued = (
        lookup_join(cells, audit.groups, group, "inner")
        .withColumn("p", scaled("count", "total", "kept"))
        .withColumn("q", scaled("lang_count", "lang_total", "kept"))
        .where("p > q")
        .select(*group, "count", "lang_count", "terms", divergence(F.col("p"), F.col("q")).alias("value"))
    )
    valued = stage(valued, "divergence_cells")
    # A value has a term at least, so no rank up to the last wanted one lies below so many values.
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    levels = valued.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    levels = levels.withColumn("level", F.row_number().over(by_value)).where(F.col("level") <= settings.ranks)
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
    reached = levels.withColumn("before", before).where(F.col("before") < settings.ranks).select(*group, "value", "before")
    open_ = stage(valued.join(reached, [*group, "value"]).drop("terms"), "divergence_open")
    expanded = lookup_join(audit.counts, open_, [*group, "count", "lang_count"], "inner")
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return (
        expanded.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= settings.ranks)
        .select(*group, F.col("term").alias("item"), "value", "rank")
    )


def source_pairs(audit: Audit) -> DataFrame:
    """lang, source, item, value, rank: every other source of a language, the widest apart first.

    f is symmetric, so each pair is added up once. The pairs, one for every two
    sources, are the result itself; terms meet only where both sources have them.
    """
    sides = audit.groups.where("kept > 0")
    here = sides.select("lang", F.col("source").alias("a"), F.col("total").alias("a_total"), "kept")
    there = sides.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"))
    zero = F.lit(0).cast("long")
    pairs = (
        here.join(there, "lang")
        .where("a != b")
        .withColumns({"none": zero})
        .withColumn("p0", scaled("none", "a_total", "kept"))
        .withColumn("q0", scaled("none", "b_total", "kept"))
        .withColumn("base", divergence(F.col("p0"), F.col("q0")))
        .drop("none")
    )
    pairs = stage(pairs, "divergence_pairs")
    # What a source's own cells add, the other one's counts taken as zero.
    own = audit.counts.groupBy("lang", F.col("source").alias("a"), "count").agg(F.count("*").alias("terms"))
    alone = (
        own.join(pairs, ["lang", "a"])
        .withColumn("p", scaled("count", "a_total", "kept"))
        .groupBy("lang", "a", "b")
        .agg(F.sum(F.col("terms") * (divergence(F.col("p"), F.col("q0")) - F.col("base"))).alias("alone"))
    )
    alone = stage(alone, "divergence_alone")
    left = audit.counts.select("lang", "term", F.col("source").alias("a"), F.col("count").alias("a_count"))
    right = audit.counts.select("lang", "term", F.col("source").alias("b"), F.col("count").alias("b_count"))
    shared = left.join(right, ["lang", "term"]).where("a < b")
    shared = stage(shared.groupBy("lang", "a", "b", "a_count", "b_count").agg(F.count("*").alias("terms")), "divergence_shared")
    p, q = F.col("p"), F.col("q")
    both = (
        shared.join(pairs, ["lang", "a", "b"])
        .withColumn("p", scaled("a_count", "a_total", "kept"))
        .withColumn("q", scaled("b_count", "b_total", "kept"))
        .withColumn("more", divergence(p, q) - divergence(p, F.col("q0")) - divergence(F.col("p0"), q) + F.col("base"))
        .groupBy("lang", "a", "b")
        .agg(F.sum(F.col("terms") * F.col("more")).alias("both"))
    )
    one = alone.where("a < b")
    other = alone.where("a > b").select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("other"))
    summed = (
        pairs.where("a < b")
        .select("lang", "a", "b", (F.col("kept") * F.col("base")).alias("value"))
        .join(one, ["lang", "a", "b"], "left")
        .join(other, ["lang", "a", "b"], "left")
        .join(both, ["lang", "a", "b"], "left")
        .na.fill(0, ["alone", "other", "both"])
        .select("lang", "a", "b", (F.col("value") + F.col("alone") + F.col("other") + F.col("both")).alias("value"))
    )
    summed = stage(summed, "divergence_sums")
    names = audit.groups.select("lang", "source", "kept")
    bare = names.where("kept = 0")
    without = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang")
    found = (
        summed.union(summed.select("lang", "b", "a", "value"))
        .union(without.where("a != b").select("lang", "a", "b", zero))
        .toDF("lang", "source", "item", "value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(ranked))


def audit(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank, as the module says."""
    gathered_counts = gathered(documents, settings)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(gathered_counts).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.union(top_terms(gathered_counts, settings).withColumn("part", F.lit("term")).select(*columns))
