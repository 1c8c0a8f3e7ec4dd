"""Passages that recur, removed wherever they start again: repeated-phrase automata.

A window is a run of `window` consecutive words of one document. Every window
but the first of its kind, by document id and place, is removed with all its
words; windows are judged on the input, not on what is left.

1. A window's anchor is the smallest hash of the runs of `anchor` words in it.
   Equal windows have equal anchors, and neighbouring windows mostly share
   theirs, so a text falls into sections: runs of windows with one anchor. Only
   anchors that occur at two places can belong to a recurring window. They are
   found from hashes alone, a number per several words, and a mask says which of
   a text's sections are left; most text is done with then.
2. The sections that are left go out with their text, to the shard that their
   anchor belongs to. There their windows are counted, those that occur twice
   are confirmed, and an Aho-Corasick automaton whose letters are runs of words
   is compiled from them.
3. All sections of all documents are streamed through their shard's automaton.
   It finds every occurrence of every phrase; those that are not the phrase's
   first one are removed.

An anchor with more sections than a shard takes has shards of its own. Its equal
sections are counted before they are shuffled, so that confirming takes the
different ones only; they are spread over `parts` automata by their windows, and
each of these has `copies`, among which the streamed sections are dealt.

Words are compared themselves, so nothing rests on hashes being different but
where two different texts under one document id are put in order.

Words are runs of anything but ASCII white space. A null text has none. A null
id comes after all others. Rows with one id but different texts are different
documents, in the order of a hash of their texts; rows equal in id and text are
one document: neither starts earlier, and all get its result. A text shorter
than a window is kept whole. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.limits import HOT_SHARE
from propense.llm.tables import free_name, texts_of
from propense.operators.joins import lookup_join, salted_join
from propense.sources.staging import stage

ODD = np.uint64(0x9E3779B97F4A7C15)
ODDER = np.uint64(0xBF58476D1CE4E5B9)

# A document: whether it has no id, its id, and a hash of its text.
DOCUMENT = ["no_id", "id", "version"]
SECTIONS = "no_id boolean, id long, version long, anchor long, start int, content binary"
REMOVED = "no_id boolean, id long, version long, start int, end int"

# Code points of the texts whose sections are held at once; a longer text is alone.
SECTION_CHARS = 4 << 20

# Stands for a letter that no phrase has.
NO_DIGITS = (0, 0)


@dataclass(frozen=True)
class Settings:
    """Words of a window and of an anchor, and sections of a shard, about: this one bounds a task and changes no result."""

    window: int = 20
    anchor: int = 5
    shard_sections: int = 4096


def split_words(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, in UTF-8."""
    return text.encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODDER
    return x ^ (x >> np.uint64(29))


def slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of every `width` consecutive values, from ever wider overlapping runs."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def run_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of every `size` consecutive words."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    hashes = np.full(count, size, np.uint64)
    for shift in range(size):
        hashes = hashes * ODD + each[shift : shift + count]
    return mixed(hashes)


def anchors(words: list[bytes], settings: Settings) -> np.ndarray:
    """The anchor of every window."""
    return slid(run_hashes(words, settings.anchor), settings.window - settings.anchor + 1, np.minimum)


def section_starts(of_windows: np.ndarray) -> np.ndarray:
    """The first window of each section."""
    return np.flatnonzero(np.concatenate([[True], of_windows[1:] != of_windows[:-1]]))


def section_anchors(words: list[bytes], settings: Settings) -> np.ndarray:
    """The anchor of every section, and behind them once more those that occur at two places of their section."""
    runs, width = run_hashes(words, settings.anchor), settings.window - settings.anchor + 1
    of_windows = slid(runs, width, np.minimum)
    starts = section_starts(of_windows)
    lasts = np.concatenate([starts[1:], [len(of_windows)]]) - 1
    found, within = of_windows[starts], np.arange(width)
    # A section's first window holds the anchor's first place, and its last window the last one.
    first = starts + (runs[starts[:, None] + within] == found[:, None]).argmax(axis=1)
    last = lasts + width - 1 - (runs[lasts[:, None] + within[::-1]] == found[:, None]).argmax(axis=1)
    return np.concatenate([found, found[first != last]])


def anchor_hashes(text: Column | str, settings: Settings) -> Column:
    """Column of the hashes that `section_anchors` gives."""

    @arrow_udf("array<long>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for one in texts_of(batch):
                words = split_words(one)
                out.append(section_anchors(words, settings).view(np.int64) if len(words) >= settings.window else [])
            yield pa.array(out, pa.list_(pa.int64()))

    return found(text)


def mask_of(places: Column | str) -> Column:
    """Column of a bit mask with the given places set."""

    @arrow_udf("binary")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for some in batch:
                numbers = some.values.to_numpy()
                bits = np.zeros(int(numbers.max()) + 1, np.uint8)
                bits[numbers] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.array(out, pa.binary())

    return masked(places)


def text_sections(settings: Settings):
    """Task that gives the masked sections of each text: document, anchor, start, and the words, a space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = zip(*(batch.column(name).to_pylist() for name in DOCUMENT), strict=True)
            owners, hashes, starts, contents, held = [], [], [], [], 0
            for document, mask, one in zip(documents, batch.column("mask"), texts_of(batch.column("text")), strict=True):
                words = split_words(one)
                of_windows = anchors(words, settings)
                first = section_starts(of_windows)
                ends = np.concatenate([first[1:], [len(of_windows)]]) + settings.window - 1
                wanted = np.flatnonzero(np.unpackbits(np.frombuffer(mask.as_py(), np.uint8))[: len(first)])
                if not len(wanted):
                    continue
                owners += [document] * len(wanted)
                hashes.append(of_windows[first[wanted]].view(np.int64))
                begin = first[wanted].tolist()
                starts += begin
                contents += [b" ".join(words[a:b]) for a, b in zip(begin, ends[wanted].tolist(), strict=True)]
                held += len(one)
                if held > SECTION_CHARS:
                    yield _section_batch(owners, hashes, starts, contents)
                    owners, hashes, starts, contents, held = [], [], [], [], 0
            if contents:
                yield _section_batch(owners, hashes, starts, contents)

    return run


def _section_batch(owners: list[tuple], hashes: list[np.ndarray], starts: list, contents: list) -> pa.RecordBatch:
    no_id, ids, versions = zip(*owners, strict=True)
    columns = [
        pa.array(no_id, pa.bool_()),
        pa.array(ids, pa.int64()),
        pa.array(versions, pa.int64()),
        pa.array(np.concatenate(hashes)),
        pa.array(starts, pa.int32()),
        pa.array(contents, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*DOCUMENT, "anchor", "start", "content"])


def with_document(docs: DataFrame) -> DataFrame:
    """The columns that name a row's document, none of them null, and its text."""
    return docs.select(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"),
        "text",
    )


@dataclass(frozen=True)
class Sections:
    """The sections whose anchors recur; how many there are, and the anchors with more of them than a shard takes."""

    rows: DataFrame
    count: int
    heavy: DataFrame


def recurring_sections(docs: DataFrame, settings: Settings) -> Sections:
    """no_id, id, version, anchor, start, content of every section whose anchor occurs at two places.

    Sections are chosen by number under a hash of their document. Should two
    documents share that hash, each has the other's sections as well, which
    then find nothing.
    """
    named = with_document(docs)
    key = F.xxhash64(*DOCUMENT)
    hashed = stage(named.select(key.alias("key"), anchor_hashes("text", settings).alias("anchors")), "phrase_hashes")
    counts = hashed.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n"))
    recurring = stage(counts.where("n > 1"), "phrase_anchors")
    total = recurring.agg(F.sum("n")).first()[0] or 0
    hot = [row[0] for row in recurring.where(F.col("n") > int(total * HOT_SHARE)).select(F.xxhash64("anchor")).collect()]
    places = hashed.select("key", F.posexplode("anchors").alias("number", "anchor"))
    # Joined alike at every size; the few anchors with much of all sections are salted.
    left = salted_join(places, recurring.select("anchor"), ["anchor"], "left_semi", hot=hot)
    masks = left.groupBy("key").agg(F.collect_set("number").alias("numbers"))
    masks = stage(masks.select("key", mask_of("numbers").alias("mask")), "phrase_masks")
    rows = lookup_join(named.withColumn("key", key), masks, "key", "inner").select(*DOCUMENT, "text", "mask")
    heavy = recurring.where(F.col("n") > settings.shard_sections)
    return Sections(rows.mapInArrow(text_sections(settings), SECTIONS), total, heavy)


def sharded(sections: Sections, settings: Settings) -> DataFrame:
    """All sections, each where its shard's automaton is made, and before them what the shards of heavy anchors confirm."""
    shards = max(1, sections.count // settings.shard_sections)

    def placed(rows: DataFrame, own: bool, kind: int, shard: Column) -> DataFrame:
        return rows.select(
            F.lit(own).alias("own"), shard.alias("shard"), F.lit(kind).alias("kind"), "part", "parts", "n", *DOCUMENT, "start", "content"
        )

    single = {"part": F.lit(0), "parts": F.lit(1), "n": F.lit(1).cast("long")}
    if sections.heavy.isEmpty():
        return placed(sections.rows.withColumns(single), False, 1, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    rows = stage(sections.rows, "phrase_sections")
    light = lookup_join(rows, sections.heavy, "anchor", "left_anti").withColumns(single)
    of_heavy = lookup_join(rows, sections.heavy.select("anchor", F.col("n").alias("all")), "anchor", "inner")
    different = stage(
        of_heavy.groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.min(F.struct(*DOCUMENT, "start")).alias("first"), F.max("all").alias("all")
        ),
        "phrase_different",
    )
    sizes = different.groupBy("anchor").agg(
        F.ceil(F.count("*") / settings.shard_sections).cast("int").alias("parts"),
        F.ceil(F.max("all") / settings.shard_sections).cast("int").alias("copies"),
    )
    sizes = stage(sizes, "phrase_sizes")
    parts, copies = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "copies"))
    shard = F.xxhash64("anchor", "part", "copy")
    phrases = lookup_join(different, sizes, "anchor", "inner").select("*", parts.alias("part"))
    phrases = phrases.select("*", copies.alias("copy"), "first.*")
    streamed = lookup_join(of_heavy, sizes, "anchor", "inner").select(
        "*", parts.alias("part"), F.pmod(F.xxhash64(*DOCUMENT, "start"), F.col("copies")).cast("int").alias("copy"), F.lit(0).cast("long").alias("n")
    )
    return (
        placed(light, False, 1, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .union(placed(phrases, True, 0, shard))
        .union(placed(streamed, True, 1, shard))
    )


def stride(window: int) -> int:
    """Words of a letter: the largest number of them, up to ten, that windows fall into without rest."""
    return max(size for size in range(1, 11) if window % size == 0)


class Phrases:
    """The phrases of one shard: confirmed, compiled, and looked for.

    A letter stands for `stride` consecutive words, so a phrase has a few
    letters, and a section is read once from each of its first words on.
    """

    def __init__(self, window: int):
        self.window, self.stride = window, stride(window)
        self.letters: dict[tuple, int] = {}
        # Each window's first place, as a section's and a number in it; those that occur twice.
        self.seen: dict[tuple, tuple] = {}
        self.twice: set[tuple] = set()
        self.digits: dict[int, tuple[int, int]] = {}
        self.automaton = None

    def runs(self, words: list[bytes]) -> Iterator[tuple]:
        """Every `stride` consecutive words."""
        return zip(*(words[k:] for k in range(self.stride)))

    def add(self, words: list[bytes], times: int, at: tuple, part: int, parts: int) -> list[int]:
        """Count the windows of a section that occurs so many times, first at `at`, and give the section's letters."""
        known, seen, twice = self.letters, self.seen, self.twice
        letters = [known.setdefault(run, len(known) + 1) for run in self.runs(words)]
        for i, phrase in enumerate(zip(*(letters[k:] for k in range(0, self.window, self.stride)))):
            if parts > 1 and zlib.crc32(b" ".join(words[i : i + self.window])) % parts != part:
                continue
            mine = at, i
            first = seen.setdefault(phrase, mine)
            if first is not mine:
                twice.add(phrase)
                if self.place(at, i) < self.place(*first):
                    seen[phrase] = mine
            elif times > 1:
                twice.add(phrase)
        return letters

    @staticmethod
    def place(at: tuple, i: int) -> tuple:
        """Where the section's window `i` is: document and place."""
        return (*at[:-1], at[-1] + i)

    def letters_of(self, words: list[bytes]) -> list[int]:
        """The letters of a section, 0 for words that no phrase has."""
        return [self.letters.get(run, 0) for run in self.runs(words)]

    def compiled(self):
        """The automaton of the windows that occur twice, each with the place of its first occurrence.

        A state's ways on are looked through one by one, so that the phrases'
        letters are spelled in two digits each: no state has more ways than there are digits.
        """
        if self.automaton is None:
            used = {letter for phrase in self.twice for letter in phrase}
            base = isqrt(len(used)) + 1
            self.digits = {letter: (1 + n // base, 1 + base + n % base) for n, letter in enumerate(used)}
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for phrase in self.twice:
                self.automaton.add_word(tuple(chain.from_iterable(map(self.digits.__getitem__, phrase))), self.place(*self.seen[phrase]))
            self.seen.clear()
            self.twice.clear()
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def found(self, letters: list[int]) -> list[tuple[int, tuple]]:
        """The windows of a section that are phrases, by number, each with the phrase's first place."""
        automaton, step = self.compiled(), self.stride
        if not len(automaton):
            return []
        digits = [self.digits.get(letter, NO_DIGITS) for letter in letters]
        # Readings of equal length, one behind the other; no phrase goes on over the zeros at their ends.
        length = -(-len(digits) // step) + 1
        digits += [NO_DIGITS] * (step * length - len(digits))
        read = tuple(chain.from_iterable(chain.from_iterable(digits[k::step] for k in range(step))))
        back = self.window // step - 1
        places = ((last // 2, first) for last, first in automaton.iter(read))
        return sorted((last // length + (last % length - back) * step, first) for last, first in places)

    @staticmethod
    def later(found: list[tuple[int, tuple]], places: list[tuple], window: int) -> Iterator[tuple]:
        """The words, as documents and ranges of places, that phrases which occur earlier elsewhere cover, of a section at `places`."""
        whole = list(covered((i for i, _ in found), window))
        # Where a section would start whose phrases these are for the first time.
        firsts = {(*first[:-1], first[-1] - i) for i, first in found}
        for at in places:
            *document, start = at
            ranges = whole
            if at in firsts:
                ranges = covered((i for i, first in found if first != (*document, start + i)), window)
            for begin, end in ranges:
                yield *document, start + begin, start + end


def covered(starts: Iterable[int], window: int) -> Iterator[tuple[int, int]]:
    """The words that the windows cover which begin at the given places, in order, as ranges."""
    begin = end = -1
    for place in starts:
        if place > end:
            if end > begin:
                yield begin, end
            begin = place
        end = place + window
    if end > begin:
        yield begin, end


def located(window: int):
    """Task that reads rows sorted by shard and kind and streams the sections through their shard's automaton.

    A heavy anchor's phrases come before its sections. The others' sections are
    the phrases as well; those of a shard are held until all of them are there,
    equal ones as one with all their places: they are counted and streamed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, phrases = None, Phrases(window)
        held: dict[bytes, list[tuple]] = {}
        out: list[tuple] = []

        def finished() -> None:
            letters = [phrases.add(content.split(b" "), len(places), min(places), 0, 1) for content, places in held.items()]
            for some, places in zip(letters, held.values(), strict=True):
                out.extend(phrases.later(phrases.found(some), places, window))
            held.clear()

        for batch in batches:
            contents = batch.column("content")
            names = ["own", "shard", "kind", "part", "parts", "n", *DOCUMENT, "start"]
            columns = [batch.column(name).to_numpy(zero_copy_only=False).tolist() for name in names]
            for i, (own, number, kind, part, parts, n, *at) in enumerate(zip(*columns, strict=True)):
                if (own, number) != shard:
                    finished()
                    shard, phrases = (own, number), Phrases(window)
                content = contents[i].as_py()
                if not own:
                    held.setdefault(content, []).append(tuple(at))
                elif kind == 0:
                    phrases.add(content.split(b" "), n, tuple(at), part, parts)
                else:
                    found = phrases.found(phrases.letters_of(content.split(b" ")))
                    out.extend(phrases.later(found, [tuple(at)], window))
            if out:
                yield _range_batch(out)
                out.clear()
        finished()
        if out:
            yield _range_batch(out)

    return run


def _range_batch(found: list[tuple]) -> pa.RecordBatch:
    no_id, ids, versions, starts, ends = zip(*found, strict=True)
    columns = [
        pa.array(no_id, pa.bool_()),
        pa.array(ids, pa.int64()),
        pa.array(versions, pa.int64()),
        pa.array(starts, pa.int32()),
        pa.array(ends, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*DOCUMENT, "start", "end"])


def merged(ranges: Column | str) -> Column:
    """Column of the ranges in order, those that touch or overlap as one."""

    @arrow_udf("array<struct<start:int,end:int>>")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for some in batch:
                apart: list[dict] = []
                for one in sorted(some.as_py(), key=lambda r: r["start"]):
                    if apart and one["start"] <= apart[-1]["end"]:
                        apart[-1]["end"] = max(apart[-1]["end"], one["end"])
                    else:
                        apart.append(one)
                out.append(apart)
            yield pa.array(out, kind)

    return joined(ranges)


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """no_id, id, version and `ranges` (array<struct<start, end>>, places of words) of every document that repeats some."""
    rows = sharded(recurring_sections(docs, settings), settings)
    found = rows.repartition("own", "shard").sortWithinPartitions("own", "shard", "kind")
    found = found.mapInArrow(located(settings.window), REMOVED).groupBy(*DOCUMENT)
    return found.agg(F.collect_set(F.struct("start", "end")).alias("all")).select(*DOCUMENT, merged("all").alias("ranges"))


def kept_words(words: list[bytes], ranges: list[dict] | None) -> list[bytes]:
    """The words that no range covers."""
    if not ranges:
        return words
    keep = np.ones(len(words), bool)
    for found in ranges:
        keep[found["start"] : found["end"]] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _with_ranges(docs: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """The rows with the ranges to remove of each, and that column's name."""
    names = {name: free_name(docs, f"_{name}") for name in [*DOCUMENT, "ranges"]}
    found = stage(repeated_passages(docs, settings), "phrase_ranges")
    for name, free in names.items():
        found = found.withColumnRenamed(name, free)
    named = docs.withColumns(
        {
            names["no_id"]: F.col("doc_id").isNull(),
            names["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            names["version"]: F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )
    keys = [names[name] for name in DOCUMENT]
    return lookup_join(named, found, keys, "left").drop(*keys), names["ranges"]


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All rows and columns, the text as its kept words with a space between; null texts stay null."""

    @arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            yield pa.array(
                (b" ".join(kept_words(split_words(t), r.as_py())).decode() for t, r in zip(texts_of(texts), ranges, strict=True)),
                pa.string(),
            )

    rows, ranges = _with_ranges(docs, settings)
    text = F.when(F.col("text").isNotNull(), kept("text", ranges))
    return rows.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    @arrow_udf("struct<n_words:long,n_removed:long,kept_sha256:string>")
    def digested(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            sizes, removed, hashes = [], [], []
            for text, of_text in zip(texts_of(texts), ranges, strict=True):
                words = split_words(text)
                kept = kept_words(words, of_text.as_py())
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
                names=["n_words", "n_removed", "kept_sha256"],
            )

    rows, ranges = _with_ranges(docs.select("doc_id", "text"), settings)
    return rows.select("doc_id", digested("text", ranges).alias("made")).select("doc_id", "made.*")
