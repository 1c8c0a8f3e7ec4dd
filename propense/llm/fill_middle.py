"""Fill-in-middle transformation by secondary-sort assembly.

A text of n code points is cut in two places that follow from a hash of its
document's id: prefix, middle and suffix. The output has them with markers in
the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm); some
documents, and those whose text is empty or holds a marker, stay plain.

A text goes out as pieces of at most `unit` code points, keyed by document and
place in the output. One repartitionAndSortWithinPartitions brings the pieces of
a document together in order; its output is then streamed, never held whole. For
the restoration the streamed pieces get the place that markers and form give
them in the original, and are sorted once more: the partitioner is the same, so
they stay where they are.

A null text is an empty one, and a null id counts as no digits. Rows that are
equal in id and text are one document to the sort, assembled once and returned
as often as they occur. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers, and the percentages of documents that are cut and of those in spm order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT = 90, 20
ORDERS = {
    "plain": (("", "whole"),),
    "psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")),
    "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle")),
}
# Where a part stands in the original.
PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

# A document's first and last record beside its pieces.
HEAD, TAIL = -1, 1 << 62


@dataclass(frozen=True)
class Settings:
    """Code points of a piece, and bytes of text that a sorted partition holds about."""

    unit: int = 1 << 16
    partition_bytes: int = 16 << 20


@dataclass(frozen=True)
class Cut:
    """How a document is transformed: its form, and the code points where the middle begins and ends."""

    form: str
    start: int
    end: int


def cut(doc_id: int | None, text: str) -> Cut:
    """The cut that follows from the id, the length and the markers in the text."""
    n = len(text)
    digits = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= CUT_PERCENT:
        return Cut("plain", n, n)
    first, second = h1 % (n + 1), h2 % (n + 1)
    return Cut("spm" if h4 % 100 < SPM_PERCENT else "psm", min(first, second), max(first, second))


def pieces(text: str, how: Cut, unit: int) -> Iterator[str]:
    """The output in order, in pieces of at most `unit` code points; a piece begins at each marker."""
    spans = {"whole": (0, len(text)), "prefix": (0, how.start), "middle": (how.start, how.end), "suffix": (how.end, len(text))}
    for marker, part in ORDERS[how.form]:
        start, end = spans[part]
        first = min(end, start + max(0, unit - len(marker)))
        if marker or first > start:
            yield marker + text[start:first]
        for at in range(first, end, unit):
            yield text[at : min(end, at + unit)]


def transformed(text: str, how: Cut) -> str:
    """The whole output of one text."""
    return "".join(pieces(text, how, max(len(text), 1) + len(PREFIX)))


def _records(rows: Iterator[Row], unit: int) -> Iterator[tuple]:
    """((document, place), content) of each row: how it is cut, then its pieces."""
    for row in rows:
        text = row["text"] or ""
        how = cut(row["doc_id"], text)
        document = (row["doc_id"] is None, row["doc_id"] or 0, hashlib.blake2b(text.encode(), digest_size=16).digest())
        yield (document, HEAD), (len(text), how.form, how.start, how.end)
        for place, piece in enumerate(pieces(text, how, unit)):
            yield (document, place), piece.encode()


def _by_document(key: tuple) -> int:
    """The same in every process, unlike Python's own hash."""
    (no_id, doc_id, digest), _ = key
    return zlib.crc32(digest + doc_id.to_bytes(8, "big", signed=True), no_id)


def _streamed(records: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted output pieces, digested and placed for the restoration, and the document's digest behind them.

    Rows that repeat each other bring each piece as often; one of them is read.
    """
    for document, its in groupby(records, key=lambda record: record[0][0]):
        output = hashlib.sha256()
        rows, head, part = 0, None, 0
        for place, same in groupby(its, key=lambda record: record[0][1]):
            content = next(same)[1]
            if place == HEAD:
                rows, head = 1 + sum(1 for _ in same), content
                continue
            output.update(content)
            if head[1] != "plain":
                marker = content[: len(PREFIX)].decode(errors="replace")
                if marker in PARTS:
                    part, content = PARTS[marker], content[len(PREFIX) :]
            yield (document, (part << 56) + place), content
        yield (document, TAIL), (rows, *head, output.hexdigest())


def _restored(records: Iterator[tuple]) -> Iterator[tuple]:
    """One result per row: pieces in the order of the original, digested up to the document's last record."""
    for document, its in groupby(records, key=lambda record: record[0][0]):
        original = hashlib.sha256()
        for (_, place), content in its:
            if place < TAIL:
                original.update(content)
                continue
            rows, n, form, start, end, output = content
            cuts = (None, None) if form == "plain" else (start, end - start)
            for _ in range(rows):
                yield (None if document[0] else document[1], n, form, *cuts, output, original.hexdigest())


def partitions_for(documents: DataFrame, settings: Settings) -> int:
    """Partitions that hold about `partition_bytes` of text each."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / settings.partition_bytes))


def sorted_output(documents: DataFrame, partitions: int, settings: Settings = Settings()) -> RDD:
    """((document, place), content) of all output pieces, those of a document in one partition and in order."""
    unit = settings.unit
    rows = documents.select("doc_id", "text").rdd
    records = rows.mapPartitions(lambda some: _records(some, unit))
    return records.repartitionAndSortWithinPartitions(partitions, _by_document)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
    ]
)


def digests(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row."""
    spark = documents.sparkSession
    partitions = partitions_for(documents, settings)
    output = sorted_output(documents, partitions, settings)
    placed = output.mapPartitions(_streamed, preservesPartitioning=True)
    original = placed.repartitionAndSortWithinPartitions(partitions, _by_document)
    return spark.createDataFrame(original.mapPartitions(_restored), RESULT)


def outputs(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, form and output of every row; here a document's whole output is built, as the column asks for it."""

    def assembled(records: Iterator[tuple]) -> Iterator[tuple]:
        for document, its in groupby(records, key=lambda record: record[0][0]):
            rows, head, parts = 0, None, []
            for place, same in groupby(its, key=lambda record: record[0][1]):
                content = next(same)[1]
                if place == HEAD:
                    rows, head = 1 + sum(1 for _ in same), content
                else:
                    parts.append(content)
            for _ in range(rows):
                yield (None if document[0] else document[1], head[1], b"".join(parts).decode())

    output = sorted_output(documents, partitions_for(documents, settings), settings)
    return documents.sparkSession.createDataFrame(
        output.mapPartitions(assembled), "doc_id long, form string, output string"
    )


def restored(form: str, output: str) -> str:
    """The text that an output of the given form was made from."""
    if form == "plain":
        return output
    places = sorted((output.index(marker), marker) for marker in (PREFIX, SUFFIX, MIDDLE))
    ends = [at for at, _ in places[1:]] + [len(output)]
    parts = {marker: output[at + len(marker) : end] for (at, marker), end in zip(places, ends, strict=True)}
    return "".join(parts[marker] for marker in sorted(parts, key=PARTS.get))
