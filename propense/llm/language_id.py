"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear
softmax on the mean gives the languages' probabilities. Both are trained
together by stochastic gradient descent in numpy, on a bounded sample of
labelled texts. A part of the sample is kept back: it sets the temperature that
makes the scores probabilities, and the score below which a text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.tables import free_name, give_back, texts_of

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Bytes that are neither ASCII letters nor part of a longer character separate words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """How the model is trained.

    `languages` and `per_language` bound the sample: at most so many languages,
    the most frequent first, and about so many documents of each, one stretch of
    `stretch` characters of every sampled document. `rejected` is the share of
    rightly recognised texts that may fall below the rejection score.
    """

    bits: int = 15
    sizes: tuple[int, ...] = (2, 3, 4)
    width: int = 16
    languages: int = 64
    per_language: int = 1500
    stretch: int = 400
    epochs: int = 8
    rate: float = 0.5
    rejected: float = 0.0005
    seed: int = 7

    @property
    def buckets(self) -> int:
        """Buckets of the n-grams of one size."""
        return 1 << self.bits


def grams(text: str, settings: Settings, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Buckets of a text's byte n-grams, in blocks of a bounded number of bytes."""
    words = b" " + b" ".join(text.lower().encode().translate(WORD_BYTES).split()) + b" "
    overlap = max(settings.sizes) - 1
    for start in range(0, max(1, len(words) - overlap), block):
        piece = np.frombuffer(words[start : start + block + overlap], np.uint8).astype(np.uint32)
        last = start + block + overlap >= len(words)
        for order, size in enumerate(settings.sizes):
            count = len(piece) - size + 1 if last else block
            if count <= 0:
                continue
            mixed = np.zeros(count, np.uint32)
            for shift in range(size):
                mixed = mixed * np.uint32(0x01000193) + piece[shift : shift + count]
            mixed *= np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - settings.bits)) + np.uint32(order * settings.buckets)


@dataclass(frozen=True)
class Model:
    """`weights` holds, for each n-gram bucket, the softmax's view of its embedding, at the calibrated temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    reject_below: float
    settings: Settings

    def probabilities(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for buckets in grams(text, self.settings):
            total += np.take(self.weights, buckets, axis=0).sum(axis=0, dtype=np.float64)
            count += len(buckets)
        return softmax(total / max(count, 1) + self.bias)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its probability; `und` and 0 for a text without letters or without a trained language."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], settings: Settings) -> Model:
    """Fit a model on (text, language) pairs; every fifth pair calibrates it instead."""
    languages = sorted({lang for _, lang in rows})
    columns = settings.buckets * len(settings.sizes)
    if not languages:
        return Model([], np.zeros((columns, 0), np.float32), np.zeros(0), 0.0, settings)
    samples = [(np.concatenate(list(grams(text, settings))), languages.index(lang)) for text, lang in rows]
    kept_back, learned = samples[::5], [s for i, s in enumerate(samples) if i % 5]
    learned = learned or kept_back
    rng = np.random.default_rng(settings.seed)
    embedding = rng.uniform(-1, 1, (columns, settings.width)).astype(np.float32) / settings.width
    soft = np.zeros((settings.width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = settings.epochs * len(learned), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(learned)):
            buckets, label = learned[i]
            rate = np.float32(settings.rate * (1 - step / steps))
            mean = embedding[buckets].mean(axis=0)
            error = softmax(mean @ soft + bias)
            error[label] -= 1
            back = soft @ error
            soft -= rate * np.outer(mean, error)
            bias -= rate * error
            # Repeated buckets count once a step; the mean is over all n-grams.
            embedding[buckets] -= rate * back
            step += 1
    weights = embedding @ soft
    logits = np.stack([weights[b].mean(axis=0) + bias for b, _ in kept_back]).astype(np.float64)
    truth = np.array([label for _, label in kept_back])
    places = np.arange(len(truth))
    scales = np.geomspace(0.05, 2, 60)
    loss = [-np.log(softmax(logits * s)[places, truth] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = softmax(logits * scale)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    # No higher than what any text of one language easily reaches, whatever the sample.
    threshold = min(0.5, float(right[int(settings.rejected * len(right))])) if len(right) else 0.0
    return Model(languages, (weights * scale).astype(np.float32), bias.astype(np.float64) * scale, threshold, settings)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept for evaluation: the CRC-32 of its id as text, modulo 4, is 2. No id: false."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, settings: Settings) -> list[tuple[str, str]]:
    """The bounded sample of (text, language): documents by a hash of their text, as many of each language.

    Documents without language, id or letters, and those held out, are left out.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    )
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, settings.per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - settings.stretch, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id"), room) + 1
    rows = (
        usable.where(draw < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))
        .select(F.substr("text", start.cast("int"), F.lit(settings.stretch)).alias("text"), "lang", draw.alias("draw"))
        # The draw bounds the sample to within its chance; this bounds it for certain.
        .orderBy("draw", "text", "lang")
        .limit(2 * settings.per_language * len(counts))
        .collect()
    )
    return [(r["text"], r["lang"]) for r in rows]


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of the documents that have a language and are not held out."""
    return train(sample(docs, settings), settings)


def predicted(text: Column | str, model: Model, docs: DataFrame) -> Column:
    """Column struct<lang_pred, score> of a text's language. The model's size is bounded by its settings."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [sent.value.predict(t) for t in texts_of(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang_pred", "score"],
            )
        give_back()

    return predict(text)


def predictions(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, and whether the calibrated threshold accepts it.

    A text that is null, empty or without letters is `und` with score 0 and not
    accepted. Without any labelled document every text is `und`. Rows stay
    apart, also when they repeat or have no id (then they are neither held out
    nor learned from); other columns are not read.
    """
    model = fit(docs, settings)
    return docs.select("doc_id", held_out().alias("held_out"), predicted("text", model, docs).alias("made")).select(
        "doc_id", "held_out", "made.*", _accepted(F.col("made"), model).alias("accepted")
    )


def _accepted(made: Column, model: Model) -> Column:
    return (made["lang_pred"] != UNKNOWN) & (made["score"] >= model.reject_below)


def accepted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents whose language is recognised with at least the calibrated score, with all their columns."""
    model = fit(docs, settings)
    made = free_name(docs, "_language")
    return docs.withColumn(made, predicted("text", model, docs)).where(_accepted(F.col(made), model)).drop(made)
