"""SentencePiece encoding and decoding by a merge-type prefix table.

The model joins, again and again, the two neighbouring pieces whose union has
the best score. The result can be read off prefixes instead: every prefix of a
text has exactly one last token, namely the one vocabulary entry that ends
there and is compatible with the last token of the prefix before it. An
automaton names the entries that end at each place, a pair is compatible when
joining its characters gives back just this pair, and the ids are recovered
from the table backwards.

Nothing is ever joined across the end of a word, so the table is filled word by
word and the words' ids are kept in a bounded cache.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import heapq
import re
import threading
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.tables import by_bytes, give_back, texts_of

# Words and pairs a worker remembers. Words are kept for two generations of this size: one that
# is met again moves to the newer one.
WORDS_KEPT = 250_000
PAIRS_KEPT = 500_000
# Seconds without a task after which a worker empties these caches.
IDLE_SECONDS = 3.0
# Longer words pass through the table each time instead of filling the cache.
WORD_KEPT_CHARS = 64

# Characters after which a run of texts is sent on: what a task holds does not grow with the batch.
RUN_CHARS = 1 << 20

# The sign for a space, and a word with the spaces before it.
SPACE = "▁"
SEGMENT = re.compile(" *[^ ]+| +")


class Pieces:
    """One model's vocabulary, its automaton and its caches.

    Supported are BPE models with byte fallback, an identity normaliser, a
    space added in front and no entry that has a space behind another
    character. Any other model is an error.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        # The library serves only to name special ids; it encodes and decodes nothing here.
        names = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.unknown = names.eos_id(), names.unk_id()
        self.pieces = [p.piece for p in model.pieces]
        kind = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(kind)) if kind[i] == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(kind)) if kind[i] == kinds.CONTROL}
        self.unknown_text = model.trainer_spec.unk_surface
        if (
            len(self.bytes) < 256
            or model.trainer_spec.model_type != model.trainer_spec.BPE
            or normal.precompiled_charsmap
            or normal.remove_extra_whitespaces
            or not (normal.add_dummy_prefix and normal.escape_whitespaces)
            or any(k in (kinds.USER_DEFINED, kinds.UNUSED) for k in kind)
            or any(SPACE in p.lstrip(SPACE) for p in self.ids)
            or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids)
        ):
            raise ValueError(f"{path}: not a BPE model of the supported kind")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            # Runs of spaces share one score and are joined after everything else: `spaces` handles them.
            if not piece.startswith(SPACE * 2):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.joins: dict[int, tuple[str, str] | None] = {}
        self.words: dict[str, str | tuple[str, str]] = {}
        self.older_words: dict[str, str | tuple[str, str]] = {}
        self.space_runs: dict[int, list[int]] = {}
        self.outside = re.compile("[^" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+")
        # What an id adds to a text; None for bytes that only give a character together with others.
        self.surface: list[str | None] = [p.replace(SPACE, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.surface[i] = chr(b) if b < 0x80 else None
        for i in self.silent:
            self.surface[i] = ""
        self.surface[self.unknown] = self.unknown_text
        self.partial = frozenset(i for b, i in self.bytes.items() if b >= 0x80)

    def joined(self, symbols: list[str], whole: str | None = None) -> list[str]:
        """Join neighbours by score, the leftmost first among equals: what defines the model.

        The join that would make `whole` is left out.
        """
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (score := self.score.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(heap, (-score, left, right, symbols[left], symbols[right]))

        for left in range(len(symbols) - 1):
            offer(left, left + 1)
        while heap:
            _, left, right, a, b = heapq.heappop(heap)
            if symbols[left] != a or symbols[right] != b or after[left] != right or a + b == whole:
                continue
            symbols[left], symbols[right] = a + b, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the characters of two tokens, one behind the other, encode to just these two.

        At a word's beginning `first` is the number behind the last id: then
        `second` must encode to itself. Otherwise the joins that made the two
        are undone, the latest first: at no point may the pieces that meet at
        the border join before the one just undone. Among equals the left one
        comes first.
        """
        known = self.made(second) is not None
        if known and first < len(self.pieces):
            a, b, limit, equal = self.pieces[first], self.pieces[second], float("-inf"), False
            while True:
                score = self.score.get(a + b)
                if score is not None and (score > limit or (equal and score == limit)):
                    known = False
                    break
                score_a, score_b = self.score[a], self.score[b]
                if len(a) > 1 and (len(b) == 1 or score_a < score_b):
                    a, limit, equal = self.made(self.ids[a])[1], score_a, False
                elif len(b) > 1:
                    b, limit, equal = self.made(self.ids[b])[0], score_b, True
                else:
                    break
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[first << 32 | second] = known
        return known

    def made(self, token: int) -> tuple[str, str] | None:
        """The two pieces whose join makes a token, "" and itself for a character; None if its characters do not make it."""
        if token not in self.joins:
            piece = self.pieces[token]
            parts = ["", piece]
            if len(piece) > 1:
                parts = self.joined(list(piece), whole=piece)
            self.joins[token] = tuple(parts) if len(parts) == 2 and "".join(parts) == piece else None
        return self.joins[token]

    def table(self, word: str) -> list[int]:
        """Ids of characters of the vocabulary, by the last token of every prefix."""
        pairs = self.pairs
        last = [len(self.pieces)] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        filled = 0
        for end, (token, length) in self.automaton.iter(word):
            # Every character is an entry, so all shorter prefixes have their token by now.
            if end >= filled:
                first = last[end + 1 - length]
                known = pairs.get(first << 32 | token)
                if known is None:
                    known = self.compatible(first, token)
                if known:
                    filled = end + 1
                    last[filled], size[filled] = token, length
        ids, place = [], len(word)
        while place:
            ids.append(last[place])
            place -= size[place]
        ids.reverse()
        return ids

    def spaces(self, run: int) -> list[int]:
        """Ids of a run of spaces that nothing else has joined."""
        if run not in self.space_runs:
            ids = [self.ids[p] for p in self.joined([SPACE] * run)]
            if run > 4096:
                return ids
            self.space_runs[run] = ids
        return self.space_runs[run]

    def segment(self, text: str) -> list[int]:
        """Ids of a run of spaces and the word behind it."""
        word = text.lstrip(" ")
        run = len(text) - len(word)
        ids: list[int] = []
        held = SPACE if run else ""
        place = 0
        word = held + word
        for group in self.outside.finditer(word):
            ids += self.table(word[place : group.start()])
            ids += [self.bytes[b] for b in group[0].encode()]
            place = group.end()
        ids += self.table(word[place:])
        if run and ids[0] == self.ids[SPACE]:
            return self.spaces(run) + ids[1:]
        return self.spaces(run - 1) + ids if run > 1 else ids

    def forget(self) -> None:
        """Empty the caches of words and pairs."""
        self.words, self.older_words = {}, {}
        self.pairs.clear()

    def word(self, text: str) -> str | tuple[str, str]:
        """The ids of a segment as text, through the cache, with what they decode to where that is not the segment."""
        known = self.older_words.get(text)
        if known is None:
            ids = self.segment(text)
            known, surface = " ".join(map(str, ids)), self.surfaces(ids)
            if surface != text:
                known = known, surface
        if len(text) <= WORD_KEPT_CHARS:
            if len(self.words) >= WORDS_KEPT:
                self.older_words, self.words = self.words, {}
            self.words[text] = known
        return known

    def segments(self, text: str) -> Iterator[tuple[str, str | tuple[str, str]]]:
        """Each segment of a text and its `word`. Each begins with a space, so no character's bytes lie in two of them."""
        if text:
            kept = self.words
            for segment in SEGMENT.findall(" " + text.replace(SPACE, " ")):
                known = kept.get(segment)
                if known is None:
                    known = self.word(segment)
                    kept = self.words
                yield segment, known

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """The ids of a text and the end id, joined by spaces, and what these ids decode to, segment by segment."""
        ids, surfaces = [], []
        for segment, known in self.segments(text):
            if type(known) is tuple:
                known, segment = known
            ids.append(known)
            surfaces.append(segment)
        ids.append(str(self.end))
        # The first piece begins with the space that was put in front.
        return " ".join(ids), "".join(surfaces)[1:]

    def encode_text(self, text: str) -> str:
        """The ids of a text and the end id, joined by spaces."""
        return self.encode_and_decode(text)[0]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(" ")]

    def surfaces(self, ids: list[int]) -> str:
        """The text of ids with the space in front: bytes are gathered into characters, control ids are silent."""
        surface = self.surface
        if self.partial.isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.partial:
                held.append(self.byte_of[i])
                continue
            if held and i not in self.silent:
                out.append(characters(bytes(held)))
                held.clear()
            out.append(surface[i])
        out.append(characters(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that was put in front."""
        text = self.surfaces(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


def characters(data: bytes) -> str:
    """Decode UTF-8; each byte that belongs to no character becomes one replacement sign."""
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        bad = error.start
        return data[:bad].decode() + "�" + characters(data[bad + 1 :])


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Idle:
    """Clears the caches of a model once no task of this worker has used it for a while.

    A worker outlives its tasks: its caches serve the next one, but must not stay
    beside the stages of other operators.
    """

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.uses: dict[str, int] = {}
        self.timers: dict[str, threading.Timer] = {}

    @contextlib.contextmanager
    def used(self, path: str) -> Iterator[Pieces]:
        """The model, whose caches stay at least as long as it is in use."""
        with self.lock:
            self.uses[path] = self.uses.get(path, 0) + 1
            if path in self.timers:
                self.timers.pop(path).cancel()
        try:
            yield pieces_of(path)
        finally:
            with self.lock:
                self.uses[path] -= 1
                timer = threading.Timer(IDLE_SECONDS, self.clear, [path])
                timer.daemon = True
                self.timers[path] = timer
                timer.start()
            give_back()

    def clear(self, path: str) -> None:
        with self.lock:
            if not self.uses[path]:
                pieces_of(path).forget()
                give_back()


IDLE = Idle()


def in_use(path: str) -> contextlib.AbstractContextManager[Pieces]:
    """A model with this worker's caches, for the length of a task."""
    return IDLE.used(path)


def runs(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    """The texts of all batches in runs of about RUN_CHARS characters; a longer text is a run by itself."""
    for batch in batches:
        yield from by_bytes(texts_of(batch), len, RUN_CHARS)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def id_lists(texts: list[str]) -> pa.ListArray:
    """Lists of ids from their text forms, without a Python number for each."""
    arrays = [np.fromstring(t, np.int32, sep=" ") for t in texts]
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *arrays]))


def encoded_and_decoded(text: Column | str, path: str) -> Column:
    """Column struct<ids, text> of a text's ids, the end id last, and what they decode to, in one pass."""

    @arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with in_use(path) as pieces:
            for run in runs(batches):
                ids, back = [], []
                for one in run:
                    of_text, again = pieces.encode_and_decode(one)
                    ids.append(of_text)
                    back.append(again)
                yield pa.StructArray.from_arrays([id_lists(ids), pa.array(back, pa.string())], names=["ids", "text"])

    return both(text)


def encoded(text: Column | str, path: str) -> Column:
    """Column of the ids of a text, the end id last, as an array; a null text is encoded as an empty one."""

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with in_use(path) as pieces:
            for run in runs(batches):
                yield id_lists([pieces.encode_text(t) for t in run])

    return encode(text)


def decoded(ids: Column | str, path: str) -> Column:
    """Column of the text of an array of ids; a null array decodes to an empty text."""

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with in_use(path) as pieces:
            for batch in batches:
                yield pa.array((pieces.decode(row.as_py() or []) for row in batch), pa.string())

    return decode(ids)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, decoded again, and digested.

    A null text is encoded as an empty one, to the end id alone. Rows stay
    apart, also when they repeat or have no id; other columns are not read. An
    empty table gives an empty result.
    """

    @arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with in_use(path) as pieces:
            for run in runs(batches):
                counts, ids_digests, text_digests = [], [], []
                for text in run:
                    ids, again = pieces.encode_and_decode(text)
                    counts.append(ids.count(" ") + 1)
                    ids_digests.append(sha256(ids))
                    text_digests.append(sha256(again))
                yield pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                    names=["n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", digests("text").alias("made")).select("doc_id", "made.*")
