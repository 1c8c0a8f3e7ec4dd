"""Token counts of whole texts under a byte-level BPE tokenizer.

Texts are encoded in Arrow batches that return lengths only. A batch of the
tokenizer holds a bounded number of bytes, whatever the number of texts; a long
text is cut where its tokenizer cuts as well, so the counts of its parts add up
to the count of the whole.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.tables import by_bytes, texts_of

# Bytes the tokenizer gets at once, and the characters a part of a long text has before the next safe cut.
BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16

# Fixed value: a model's context length.
LIMIT = 1024

# Places that no word of the pre-tokenizer spans and that change no word on either side: before white
# space, and where letters or digits end; not behind white space, whose last character may belong to
# the next word. Only a special string may span the second kind.
BEFORE_SPACE = regex.compile(r"(?<=\S)(?=\s)")
WORD_END = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
SPECIAL_CHARS = 64


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    # Spark runs one task per core already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """Cut a text so that encoding the parts gives the tokens of the whole.

    Parts end at the next white space after `part_chars` characters. Without
    any among as many more, they end where the next letters or digits do,
    unless a special string, which starts with "<" and ends with ">", may be
    open there; a text without such a place stays whole.
    """
    start = 0
    while len(text) - start > part_chars:
        first = start + part_chars
        cut = BEFORE_SPACE.search(text, first, min(len(text), first + part_chars))
        end = cut.start() if cut else _word_end(text, first)
        if end is None:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _word_end(text: str, first: int) -> int | None:
    for cut in WORD_END.finditer(text, first):
        near = text[max(0, cut.start() - SPECIAL_CHARS) : cut.start()]
        if near.rfind("<") <= near.rfind(">"):
            return cut.start()
    return None


def count_batch(texts: Iterator[str], path: str) -> list[int]:
    """Tokens of each text, by the tokenizer file at `path`."""
    tokenizer = _tokenizer(path)
    counts: list[int] = []

    def pieces() -> Iterator[tuple[int, str]]:
        for i, text in enumerate(texts):
            counts.append(0)
            for part in parts(text):
                yield i, part

    for run in by_bytes(pieces(), lambda piece: len(piece[1].encode()), BATCH_BYTES):
        encodings = tokenizer.encode_batch_fast([part for _, part in run], add_special_tokens=False)
        for (i, _), encoding in zip(run, encodings, strict=True):
            counts[i] += len(encoding)
    return counts


def token_count(text: Column | str, path: str) -> Column:
    """Column of the number of tokens of a text: no begin, end or added special tokens; a null text has none."""

    @arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(count_batch(texts_of(batch), path), pa.int64())

    return counted(text)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row.

    A null text counts as empty: no bytes, no tokens. Rows stay apart, also when
    they repeat or have no id; other columns are not read. An empty table gives
    an empty result.
    """
    return (
        docs.select(
            "doc_id",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            token_count("text", path).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
