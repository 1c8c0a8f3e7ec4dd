"""Near-duplicates by order min hashing, verified by banded alignment.

A text is a sequence of words, and its k-mers are runs of five words, each
labelled with its occurrence in the text so that repeated ones differ. One
sketch samples the few k-mers that are smallest under a hash and keeps them in
text order, so texts agree on it when they share k-mers in the same order. Texts
that agree on a sketch are candidates. Two candidates are linked when an
alignment of their k-mers within a band matches at least `similarity` of all
k-mers of both (matched / (all - matched)), and linked texts form a class.

Texts that agree on one sketch are never paired with each other all at once.
They are compared with a pivot; those not in the pivot's class meet further
pivots in later rounds, until all that share a sketch are in one class or have
been compared with each other. Parities of k-mer counts bound how far two texts
are apart, and a pair that they rule out is no pair.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.components import components, merged
from propense.llm.tables import free_name, give_back, small_batches, texts_of
from propense.operators.joins import lookup_join
from propense.sources.staging import stage

# Pairs of one pivot that a task verifies about at once: a pivot's text is repeated for as many of them.
PIVOT_PAIRS = 1000
# Characters of the texts whose hashes a task passes on at once.
BATCH_CHARS = 4 << 20
# Hash values that are held at once while a text is sketched.
BLOCK = 1 << 16

# Texts of up to so many k-mers are compared by sketches of one k-mer as well.
SHORT = 12

# Parities that tell most pairs apart before their texts are compared.
MARKS = 1024

WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
ODDER = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """Words of a k-mer, the least similarity of a link, the number of sketches, and the k-mers of a sketch.

    Texts of similarity s agree on one sketch with a chance of about
    s ** kmers, somewhat less where texts are short: at 0.8 texts of more than
    SHORT k-mers miss all of them about once in 300,000 (very long texts) to
    50,000 times. Texts of fewer k-mers, and all that such a text can be similar
    to, have as many sketches of one k-mer besides, which agree with a chance of s.
    """

    words: int = 5
    similarity: float = 0.8
    sketches: int = 24
    kmers: int = 4


def normal_words(text: str) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.lower().encode().translate(WORD_BYTES).split()


def digest(text: str, words: list[bytes]) -> bytes:
    """What equal texts share: of the words, or of the text itself if it has none."""
    content = b"w" + b" ".join(words) if words else b"t" + " ".join(text.split()).encode()
    return hashlib.blake2b(content, digest_size=16).digest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODDER
    return x ^ (x >> np.uint64(29))


def labelled_kmers(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each k-mer and its occurrence, in text order; a shorter text is a single k-mer.

    A k-mer's first occurrence has the same hash whether or not the text repeats any.
    """
    size = max(1, min(size, len(hashes)))
    count = len(hashes) - size + 1
    kmers = np.full(count, size, np.uint64)
    for shift in range(size):
        kmers = kmers * ODD + hashes[shift : shift + count]
    kmers = mixed(kmers)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return kmers
    places = np.arange(count)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), places, 0))
    occurrence = np.empty(count, np.uint64)
    occurrence[order] = (places - first).astype(np.uint64)
    return np.where(occurrence > 0, mixed(kmers + occurrence * ODD), kmers)


def sketches(kmers: np.ndarray, settings: Settings) -> np.ndarray:
    """One hash per sketch: of its sampled k-mers, in text order, and its number; short texts have further ones of one k-mer."""
    numbers = np.arange(1, settings.sketches + 1, dtype=np.uint64)
    found = _sketched(kmers, mixed(numbers * ODD), settings.kmers)
    if len(kmers) > SHORT / settings.similarity:
        return found
    return np.concatenate([found, _sketched(kmers, mixed((numbers + np.uint64(settings.sketches)) * ODD), 1)])


def _sketched(kmers: np.ndarray, salts: np.ndarray, size: int) -> np.ndarray:
    out = np.empty(len(salts), np.uint64)
    sampled = min(size, len(kmers))
    step = max(1, BLOCK // len(kmers))
    for start in range(0, len(salts), step):
        salt = salts[start : start + step, None]
        values = mixed((kmers[None, :] ^ salt) * ODD)
        smallest = np.sort(np.argpartition(values, sampled - 1, axis=1)[:, :sampled], axis=1)
        key = salt[:, 0].copy()
        for i in range(sampled):
            key = mixed(key * ODD + kmers[smallest[:, i]])
        out[start : start + step] = key
    return out


def similarity(first: np.ndarray, second: np.ndarray, settings: Settings) -> float:
    """Share of k-mers that the best alignment matches; below the settings' similarity only an upper bound.

    An alignment that reaches the similarity leaves few k-mers unmatched, so it
    runs within a band of that width. Labelled k-mers are unique in a text, and
    so the best alignment is a longest rising run of places.
    """
    a, b = labelled_kmers(first, settings.words), labelled_kmers(second, settings.words)
    total = len(a) + len(b)

    def share(matched: int) -> float:
        return matched / (total - matched)

    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if share(len(at_a)) < settings.similarity:
        return share(len(at_a))
    band = total * (1 - settings.similarity) / (1 + settings.similarity) + 1
    near = np.abs(at_a - at_b) <= band
    places = at_b[near][np.argsort(at_a[near])]
    if not (np.diff(places) > 0).all():
        ends: list[int] = []
        for place in places.tolist():
            i = bisect.bisect_left(ends, place)
            ends[i : i + 1] = [place]
        return share(len(ends))
    return share(len(places))


def exact(text: Column | str) -> Column:
    """Column that equal texts share, and no others; empty for null. Unlike the digest it takes no worker."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit("").cast("binary"))


def parities(kmers: np.ndarray) -> np.ndarray:
    """Whether the number of k-mers in each of MARKS ranges of hashes is odd, as bits of 64-bit numbers."""
    odd = np.bincount((kmers & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def possible(other: str, settings: Settings) -> Column:
    """Whether two texts with size and bits can reach the similarity, `other` before the names of the second one.

    A k-mer that only one of them has changes one parity, so there are at least
    as many such k-mers as parities that differ, and as the sizes differ by.
    """
    size, their_size = F.col("size"), F.col(f"{other}size")
    bits, their_bits = F.col("bits"), F.col(f"{other}bits")
    differ = F.bit_count(bits[0].bitwiseXOR(their_bits[0]))
    for i in range(1, MARKS // 64):
        differ += F.bit_count(bits[i].bitwiseXOR(their_bits[i]))
    most = (size + their_size) * ((1 - settings.similarity) / (1 + settings.similarity)) + 0.001
    return (F.abs(size - their_size) <= most) & (differ <= most)


HASHED = "doc_id long, exact binary, digest binary, sketches array<long>, words binary, size int, bits array<long>"


def hashed(settings: Settings):
    """Task that gives all that is compared of each text: its digest, sketches (none without words), words of four bytes
    each, and the number and marks of its k-mers, beside its id and `exact`. A batch goes out as soon as it has so many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            keys = zip(batch.column("doc_id"), batch.column("exact"), strict=True)
            for (doc_id, same), one in zip(keys, texts_of(batch.column("text")), strict=True):
                words = normal_words(one)
                numbers = word_hashes(words)
                kmers = labelled_kmers(numbers, settings.words) if words else np.zeros(0, np.uint64)
                found = sketches(kmers, settings).view(np.int64) if words else None
                known = doc_id.as_py(), same.as_py(), digest(one, words)
                rows.append((*known, found, numbers.tobytes(), len(kmers), parities(kmers)))
                held += len(one)
                if held > BATCH_CHARS:
                    yield _hashed_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _hashed_batch(rows)
        give_back()

    return run


def _hashed_batch(rows: list[tuple]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.binary(), pa.binary(), longs, pa.binary(), pa.int32(), longs]
    columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "exact", "digest", "sketches", "words", "size", "bits"])


def aligned(first: Column | str, second: Column | str, settings: Settings) -> Column:
    """Column of the similarity of two word sequences."""

    @arrow_udf("double")
    def align(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(
                (
                    similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), settings)
                    for x, y in zip(a, b, strict=True)
                ),
                pa.float64(),
            )
        give_back()

    return align(first, second)


def _verified(pairs: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, pivot) that are similar enough. A pivot's text goes out once for so many pairs."""
    spread = (
        pairs.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / PIVOT_PAIRS).cast("int").alias("copies"))
    )
    spread = stage(spread, "omh_pivots")
    pivots = words.join(spread.withColumnRenamed("pivot", "digest"), "digest").select(
        F.col("digest").alias("pivot"),
        F.col("words").alias("pivot_words"),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
    )
    salted = pairs.join(spread, "pivot").select(
        "pivot", F.col("a").alias("digest"), F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy")
    )
    return (
        salted.join(words.select("digest", "words"), "digest")
        .join(pivots, ["pivot", "copy"])
        .select(F.col("digest").alias("a"), F.col("pivot").alias("b"), aligned("words", "pivot_words", settings).alias("s"))
        .where(F.col("s") >= settings.similarity)
        .select("a", "b")
    )


def linked_texts(rows: DataFrame, texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`digest` and `component` of the different texts that have near-duplicates.

    `rows` has what `hashed` gives, and `texts` one row per different text: its digest and its sketches.
    """
    bands = texts.select("digest", F.explode("sketches").alias("sketch"))
    # Sketches that one text has are dropped; the others have a first pivot.
    groups = bands.groupBy("sketch").agg(F.min("digest").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = stage(bands.join(groups, "sketch"), "omh_members")
    near = stage(members.select("digest").distinct(), "omh_near")
    words = rows.select("digest", "words", "size", "bits")
    words = stage(lookup_join(words, near, "digest", "left_semi").dropDuplicates(["digest"]), "omh_words")

    marks = words.select("digest", "size", "bits")
    pairs = lookup_join(members.where("digest != pivot").select("digest", "pivot").distinct(), marks, "digest", "inner")
    pairs = lookup_join(pairs, marks.toDF("pivot", "pivot_size", "pivot_bits"), "pivot", "inner").where(possible("pivot_", settings))
    pairs = stage(pairs.select(F.col("digest").alias("a"), "pivot"), "omh_pairs")
    with small_batches(words.sparkSession):
        labels = components(_verified(pairs, words, settings))
    used = stage(members.select("sketch", "pivot").distinct(), "omh_used")
    tested = pairs.select(F.least("a", "pivot").alias("low"), F.greatest("a", "pivot").alias("high"))
    # A pair that is not possible has been compared as well: by its marks.
    members = lookup_join(members.select("sketch", "digest"), marks, "digest", "inner")
    pivots = 1
    while True:
        pivots *= 16
        members = _open(members.drop("component"), labels.withColumnRenamed("id", "digest"), used)
        if members.isEmpty():
            return labels.withColumnRenamed("id", "digest")
        fresh = stage(
            lookup_join(members, used.withColumnRenamed("pivot", "digest"), ["sketch", "digest"], "left_anti")
            .groupBy("sketch", F.pmod(F.xxhash64("digest"), F.lit(pivots)).alias("slot"))
            .agg(F.min(F.struct("digest", "component", "size", "bits")).alias("pivot"))
            .select("sketch", "pivot.*")
            .toDF("sketch", "pivot", "pivot_component", "pivot_size", "pivot_bits"),
            "omh_fresh",
        )
        met = (
            lookup_join(members, fresh, "sketch", "inner")
            .where((F.col("component") != F.col("pivot_component")) & possible("pivot_", settings))
            .select(F.least("digest", "pivot").alias("low"), F.greatest("digest", "pivot").alias("high"))
            .distinct()
        )
        pairs = stage(lookup_join(met, tested, ["low", "high"], "left_anti"), "omh_pairs")
        used = stage(used.union(fresh.select("sketch", "pivot")), "omh_used")
        if pairs.isEmpty():
            continue
        new = _verified(pairs.select(F.col("low").alias("a"), F.col("high").alias("pivot")), words, settings)
        with small_batches(words.sparkSession):
            links = stage(new, "omh_links")
        labels = merged(labels, links)
        tested = stage(tested.union(pairs), "omh_tested")


def _open(members: DataFrame, labels: DataFrame, used: DataFrame) -> DataFrame:
    """The members (sketch, digest, component) of the sketches whose texts are of several classes, two of them not yet pivots."""
    as_pivots = used.select("sketch", F.col("pivot").alias("digest"), F.lit(1).alias("used"))
    named = lookup_join(lookup_join(members, labels, "digest"), as_pivots, ["sketch", "digest"])
    named = stage(named.withColumn("component", F.coalesce("component", "digest")), "omh_named")
    open_ = (
        named.groupBy("sketch")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), (F.count("*") - F.count("used")).alias("fresh"))
        .where("least != most AND fresh >= 2")
        .select("sketch")
    )
    return stage(lookup_join(named, stage(open_, "omh_open"), "sketch", "left_semi").drop("used"), "omh_open")


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, `exact`, `digest`, class_id (the smallest doc_id of the class), class_size and kept of every row.

    Texts whose words are the same in the same order, but for case and ASCII
    punctuation, are copies; texts without words are copies when they are equal
    but for white space, and a null text is an empty one. The row that is kept
    of a class is the one of the smallest id, or of the smallest digest where
    none has an id; rows that repeat it in id and text are marked with it. Other
    columns are not read. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long"), exact("text").alias("exact"), "text")
        rows = stage(texts.mapInArrow(hashed(settings), HASHED), "omh_rows")
    texts = stage(
        rows.groupBy("digest").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("sketches").alias("sketches")
        ),
        "omh_texts",
    )
    labels = linked_texts(rows, texts.select("digest", "sketches"), settings)
    named = lookup_join(texts.select("digest", "first", "rows"), labels, "digest")
    named = stage(named.withColumn("component", F.coalesce("component", "digest")), "omh_named")
    found = named.groupBy("component").agg(
        F.sum("rows").alias("class_size"),
        F.min(F.struct(F.col("first").isNull(), "first", "digest")).alias("best"),
    )
    by_text = stage(
        lookup_join(named.select("digest", "component"), stage(found, "omh_found"), "component", "inner").select(
            "digest", "class_size", "best"
        ),
        "omh_classes",
    )
    return lookup_join(rows.select("doc_id", "exact", "digest"), by_text, "digest", "inner").select(
        "doc_id",
        "exact",
        "digest",
        F.col("best.first").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("best.first")) & (F.col("digest") == F.col("best.digest"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row, as `classes` says."""
    return classes(docs, settings).drop("exact", "digest")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns.

    The kept rows are found again by their exact texts, so no text goes to a
    worker twice. Copies under the id of the kept one may differ in case and
    punctuation; the one of the smallest `exact` stays.
    """
    found = stage(classes(docs, settings), "omh_found")
    key = free_name(docs, "_key")

    def row_key(doc_id: Column, text: Column) -> Column:
        return F.concat(text, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    kept = found.where("kept").groupBy("doc_id", "digest").agg(F.min("exact").alias("exact"), F.count("*").alias("rows"))
    kept = stage(kept.select(row_key(F.col("doc_id"), F.col("exact")).alias(key), "rows"), "omh_kept")
    left = lookup_join(docs.withColumn(key, row_key(F.col("doc_id"), exact("text"))), kept.select(key), key, "left_semi")
    if kept.where("rows > 1").isEmpty():
        return left.drop(key)
    # Rows that repeat the kept one in id and text: any of them, the others go.
    repeated = stage(kept.where("rows > 1").select(key), "omh_repeated")
    once = lookup_join(left, repeated, key, "left_anti")
    again = lookup_join(left, repeated, key, "left_semi").dropDuplicates([key])
    return once.union(again).drop(key)
