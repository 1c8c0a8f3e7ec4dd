"""Repeated passages, fill-in-middle and source divergence against brute force and hand-made cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from propense.llm import fill_middle, source_divergence, substring_dedup
from propense.llm.tables import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    docs = spark.createDataFrame([(*row, 0) for row in rows], SCHEMA).repartition(3)
    if extra:
        # Names that operators could use themselves.
        for name in ("id", "no_id", "version", "start", "term", "count", "total", "n", "_ranges", "_ID", "Anchor"):
            docs = docs.withColumn(name, F.lit(1))
    return docs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- repeated passages


def brute_passages(rows, window=20):
    """(doc_id, n_words, n_removed, digest) of each row. Rows equal in id and text are one document; ids are unique but for those."""
    split = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, covered = set(), defaultdict(set)
    for key in sorted(split, key=lambda k: (k[0] is None, k[0] or 0)):
        words = split[key]
        for at in range(len(words) - window + 1):
            content = tuple(words[at : at + window])
            if content in seen:
                covered[key].update(range(at, at + window))
            seen.add(content)
    out = []
    for key in rows:
        words = split[key]
        kept = [w for at, w in enumerate(words) if at not in covered[key]]
        out.append((key[0], len(words), len(words) - len(kept), sha(" ".join(kept))))
    return sorted(out, key=str)


def passage_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = [(None, "no id " + " ".join(passages[0])), (900, None), (901, ""), (902, "word"), (903, " \t\n ")]
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(text)))
    rows += [(100, "again " * 100), (101, "a b " * 50), (102, "again " * 20), (103, "a b c " * 19)]
    # Equal but for white space, an unusual blank that is no white space here, and characters beyond ASCII.
    rows += [(110, "é x " * 30), (111, "é x\v" * 25), (112, " ".join(f"日{i}" for i in range(50)))]
    rows += [(i, " ".join(passages[1])) for i in range(200, 260)]
    rows += [(i, " ".join([f"own{i}", *passages[2]])) for i in range(300, 340)]
    return [*rows, next(row for row in rows if row[0] == 5)]


@pytest.mark.parametrize(
    "settings",
    [
        substring_dedup.Settings(),
        # Small shards, so that anchors get several parts and copies.
        substring_dedup.Settings(shard_sections=2),
        substring_dedup.Settings(window=5, anchor=2, shard_sections=7),
        substring_dedup.Settings(window=3, anchor=3),
    ],
)
def test_repeated_passages(spark, settings):
    rows = passage_rows()
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=True)
    found = sorted((tuple(r) for r in substring_dedup.digests(docs, settings).collect()), key=str)
    assert found == brute_passages(rows, settings.window)
    kept = substring_dedup.deduplicated(docs, settings)
    assert kept.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"] is None, sha(r["text"] or "")) for r in kept.where("doc_id IS NOT NULL").collect())
    assert texts == sorted((i, i == 900, digest) for i, _, _, digest in found if i is not None)


def test_one_id_with_different_texts(spark):
    passage = " ".join(map(str, range(30)))
    rows = [(1, passage, "en", "s"), (1, passage + " more", "en", "s"), (None, passage, "en", "s"), (None, passage, "en", "s")]
    found = substring_dedup.digests(documents(spark, rows)).collect()
    by_id = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in found)
    # One of the two texts under id 1 comes first; the equal rows without an id get the same result.
    assert by_id in ([(0, 30, 30), (0, 30, 30), (1, 30, 0), (1, 31, 30)], [(0, 30, 30), (0, 30, 30), (1, 30, 30), (1, 31, 0)])


def test_no_passages(spark):
    docs = documents(spark, [(1, "a b", "en", "s")])
    assert substring_dedup.digests(docs.where("doc_id = 2")).count() == 0
    assert [tuple(r) for r in substring_dedup.digests(docs).collect()] == [(1, 2, 0, sha("a b"))]


def test_equal_sections_are_counted_and_streamed_once(monkeypatch):
    words = [f"w{i}" for i in range(6)]
    rows = [(0, words), (1, words), (2, words[:5] + ["x"]), (3, words)]
    batch = pa.RecordBatch.from_pylist(
        [
            {"own": False, "shard": 0, "kind": 1, "part": 0, "parts": 1, "n": 1, "no_id": False, "id": i, "version": 7,
             "start": 10 * i, "content": " ".join(some).encode()}
            for i, some in rows
        ]
    )
    counted = []
    add = substring_dedup.Phrases.add
    monkeypatch.setattr(substring_dedup.Phrases, "add", lambda self, some, *more: counted.append(some) or add(self, some, *more))
    found = [tuple(row.values()) for out in substring_dedup.located(5)(iter([batch])) for row in out.to_pylist()]
    assert sorted(found) == [(False, 1, 7, 10, 16), (False, 2, 7, 20, 25), (False, 3, 7, 30, 36)]
    assert len(counted) == 2


def test_phrases_are_spelled_in_few_digits():
    words = [b"w%d" % (i % 90 if i < 200 else i) for i in range(600)]
    phrases = substring_dedup.Phrases(20)
    letters = phrases.add(words, 2, (False, 1, 7, 0), 0, 1)
    stats = phrases.compiled().get_stats()
    assert stats["words_count"] == 581 - 91
    assert stats["nodes_count"] <= 4 * stats["words_count"] + 1
    assert phrases.found(letters) == [(i, (False, 1, 7, i % 90 if i < 181 else i)) for i in range(581)]
    assert phrases.found(phrases.letters_of([b"x", *words[300:325], b"y"])) == [(i + 1, (False, 1, 7, 300 + i)) for i in range(6)]


def test_section_anchors():
    settings = substring_dedup.Settings(window=6, anchor=2)
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]) for _ in range(rng.randint(6, 40))]
        runs = substring_dedup.run_hashes(words, 2).tolist()
        of_windows = [min(runs[i : i + 5]) for i in range(len(words) - 5)]
        assert substring_dedup.anchors(words, settings).tolist() == of_windows
        sections = []
        for i, anchor in enumerate(of_windows):
            if sections and sections[-1][0] == anchor:
                sections[-1][2] = i
            else:
                sections.append([anchor, i, i])
        twice = [anchor for anchor, first, last in sections if runs[first : last + 5].count(anchor) > 1]
        assert substring_dedup.section_anchors(words, settings).tolist() == [s[0] for s in sections] + twice


# --- fill-in-middle


def brute_fill(doc_id, text):
    text = text or ""
    n, digits = len(text), sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(output), sha(text)


@pytest.mark.parametrize("unit", [1, 3, 4, 50, 1 << 16])
def test_fill_middle(spark, unit):
    rng = random.Random(unit)
    letters = ["a", "é", "日", "🏳️", "<", ">", "P", "S", "M", "\n", "\u0000", "�"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "no id"), (None, None), (500, None), (501, ""), (502, "x<P>y"), (503, "<M>"), (-7, "negative id"), (504, "long " * 4000)]
    rows += [(3, rows[3][1])] * 5 + [(4, "other text under an id"), (504, "long " * 4000)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=True)
    settings = fill_middle.Settings(unit=unit, partition_bytes=2000)
    found = sorted((tuple(r) for r in fill_middle.digests(docs, settings).collect()), key=str)
    assert found == sorted((brute_fill(i, t) for i, t in rows), key=str)
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


def test_fill_middle_round_trip(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    made = {r["doc_id"]: r for r in fill_middle.outputs(docs).collect()}
    for row in docs.collect():
        one = made[row["doc_id"]]
        assert fill_middle.restored(one["form"], one["output"]) == (row["text"] or "")
        how = fill_middle.cut(row["doc_id"], row["text"] or "")
        assert (how.form, fill_middle.transformed(row["text"] or "", how)) == (one["form"], one["output"])
    assert fill_middle.digests(docs.where("doc_id < 0")).count() == 0


# --- source divergence


def brute_divergence(rows, least=10, ranks=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for _, t, lang, source in rows]
    having, counts, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, _, found in docs:
        having.update((lang, t) for t in set(found))
    for lang, source, found in docs:
        kept = [t for t in found if having[lang, t] >= least]
        counts[lang, source].update(kept)
        whole[lang].update(kept)
    out = []

    def p(count, total, v):
        return 1 + 10**9 * (count + 2) // (total + 2 * v)

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    for lang, source in counts:
        terms = whole[lang]
        v = len(terms)
        mine = {t: p(counts[lang, source][t], sum(counts[lang, source].values()), v) for t in terms}
        parts = {"pair": [], "term": []}
        for other_lang, item in counts:
            if other_lang == lang and item != source:
                total = sum(counts[lang, item].values())
                parts["pair"].append((-sum(f(mine[t], p(counts[lang, item][t], total, v)) for t in terms), item.encode()))
        for t in terms:
            q = p(terms[t], sum(terms.values()), v)
            if counts[lang, source][t] > 0 and mine[t] > q:
                parts["term"].append((-f(mine[t], q), t.encode()))
        for part, found in parts.items():
            for rank, (value, item) in enumerate(sorted(found), 1):
                if part == "pair" or rank <= ranks:
                    out.append((lang, source, part, item.decode(), -value, rank))
    return sorted(out)


def divergence_rows():
    rng = random.Random(9)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "don't", "x1y", "zz", "🏳️", "k", "K", "ſ"] + [f"t{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = rng.choice(["hot"] * 6 + ["a", "b", "B", "é", None, ""])
        bias = words[: rng.randint(3, len(words))] if source == "a" else words
        rows.append((i, " ".join(rng.choice(bias) for _ in range(rng.randint(0, 12))), lang, source))
    rows += [(None, None, "en", "no text"), (400, "", "en", "no terms"), (401, "!!! 123", "en", "no terms"), (402, "rare", "xx", "one"), (403, "rare", "xx", "two")]
    rows += [(404, "alone", "yy", "only")] + [(405, "zz zz zz", "en", "rep")] * 12
    return rows


@pytest.mark.parametrize(("least", "ranks"), [(10, 10), (1, 3), (40, 1), (10_000, 10)])
def test_divergence(spark, least, ranks):
    rows = divergence_rows()
    docs = documents(spark, rows, extra=True)
    found = source_divergence.audit(docs, source_divergence.Settings(least, ranks))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute_divergence(rows, least, ranks)
    assert source_divergence.audit(docs.where("doc_id < 0")).count() == 0


def test_long_texts_are_split_in_parts(monkeypatch):
    monkeypatch.setattr(source_divergence, "SPLIT_BYTES", 5)
    text = "One two-three\tfour 5 six é" + "x" * 40 + " y"
    found = [t for some in source_divergence.terms(text) for t in some]
    assert found == [b"one", b"two", b"three", b"four", b"six", ("é" + "x" * 40).encode(), b"y"]


def test_many_terms_are_passed_on_early(spark, monkeypatch):
    rows = divergence_rows()
    docs = documents(spark, rows)
    batches = docs.select("lang", "source", "text").toArrow().to_batches()
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 5)
    out = Counter()
    for batch in source_divergence._counted(iter(batches)):
        for row in batch.to_pylist():
            out[row["lang"], row["source"], row["term"]] += row["count"]
    whole = {(r["lang"], r["source"], r["term"]): r["count"] for r in source_divergence.term_counts(docs).collect()}
    assert dict(out) == whole
