"""Sharding, mixing and the operators on vectors against brute force, and the pipeline stage by stage."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from propense.llm import embedding_dedup, forest, language_id, mixing, order_minhash, pii, sharding
from propense.llm.components import components, merged
from propense.llm.queries import MIXING_SQL, sharding_sql
from propense.llm.tables import SENT_BYTES, read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def sql_rows(docs, sql):
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas().astype({"text": object, "source": object}))
    connection.execute("CREATE TABLE d AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM documents")
    connection.unregister("documents")
    connection.execute("CREATE VIEW documents AS SELECT * FROM d")
    return connection.execute(sql).fetchall()


def odd_documents(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        text = rng.choice([None, "", " ".join(rng.choice(["a", "bb", "ccc1", "é!", "\t"]) for _ in range(int(rng.paretovariate(0.7))))])
        # One source holds a third of the rows.
        rows.append((i, (text or "")[:20_000] if text is not None else None, "en", rng.choice([None, "hot", "hot", "s1", "s2", "é"]), 1))
    rows += [(None, "same text", "en", "hot", 9)] * 40 + [(7, "same text", "en", None, 9)] * 30
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- sharding


@pytest.mark.parametrize("limit", [40, 3000, 10**9])
def test_shards(spark, limit):
    docs = odd_documents(spark).withColumn("shard", F.lit(1)).withColumn("place", F.lit(2))
    rows = [tuple(r) for r in sharding.shard_documents(docs, limit).collect()]
    assert Counter(rows) == Counter(sql_rows(docs.drop("shard", "place"), sharding_sql(limit)))
    held, largest = defaultdict(int), defaultdict(int)
    for _, size, shard, _ in rows:
        held[shard] += size
        largest[shard] = max(largest[shard], size)
    assert all(n <= limit or n == largest[s] for s, n in held.items())
    assert all(held[shard] == total for _, _, shard, total in rows)


def test_write_shards(spark, tmp_path):
    docs = odd_documents(spark).withColumn("Shard", F.lit("own"))
    found = sharding.write_shards(docs, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)
    name = (set(back.columns) - set(docs.columns)).pop()
    written = {r[name]: r["bytes"] for r in back.groupBy(name).agg(F.sum(sharding.text_bytes()).alias("bytes")).collect()}
    assert written == {r["shard"]: r["bytes"] for r in found.collect()}
    assert sharding.shard_documents(empty(spark)).count() == 0


# --- mixing


def test_mix_equals_sql(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in mixing.mixed(docs.withColumn("size", F.lit(1)).withColumn("key", F.lit(2))).collect()]
    assert Counter(rows) == Counter(sql_rows(docs, MIXING_SQL))
    assert Counter(rows) == Counter(tuple(r) for r in mixing.mixed(docs.repartition(2)).collect())


def test_mix_meets_its_targets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = mixing.mixed(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert all(r["size"] == len([w for w in r["text"].encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target))}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    free = [s for s in target if target[s] < 2 * size[s]]
    levels = [target[s] / weights[s] for s in free]
    assert max(levels) == pytest.approx(min(levels))
    assert all(2 * size[s] <= weights[s] * max(levels) * (1 + 1e-9) for s in target if s not in free)
    # Documents are taken whole, so half of one may be missing or too much.
    for s in target:
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= largest / 2


def test_larger_sources_come_nearer(spark, sf_dir):
    docs = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    rows = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.03 * r["target"]


def test_mixed_rows(spark):
    docs = odd_documents(spark).withColumn("row", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("Rest", F.lit(3))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = lambda d: d.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()
    per_source = docs.select("doc_id", "text", "source").distinct()
    taken = mixing.mixed(docs).groupBy().agg(F.sum("taken")).first()[0]
    assert sum(r["n"] for r in words(out)) == taken and per_source.count() > 0
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 1)], SCHEMA)
    assert [r["taken"] for r in mixing.mixed(blank).collect()] == [0, 0]


# --- components


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(400, 500)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(7, 7), (2, 1)]
    parent = {i: i for link in links for i in link}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    # An id that is linked with itself only has no link.
    assert found == {i: root(i) for i in parent if i in found} and len(found) >= len(parent) - 20
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    # In two goes: the second one's links join components, single ids, and what is joined already.
    first = components(spark.createDataFrame(links[::2], "a long, b long"))
    both = merged(first, spark.createDataFrame(links[1::2], "a long, b long"))
    assert sorted((r["id"], r["component"]) for r in both.collect()) == sorted(found.items())
    assert merged(both, spark.createDataFrame(links[:3], "a long, b long")) is both


# --- vectors


def odd_vectors(spark, n=700, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        # A third of the rows are around one centre, many of them equal.
        c = 0 if i % 3 == 0 else int(rng.integers(12))
        noise = 0.0 if i % 6 == 0 else float(rng.choice([0.05, 0.3, 1.0]))
        rows.append((i, [float(np.float32(x)) for x in centres[c] + noise * rng.normal(size=16)], int(c % 3)))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] * 16, [None] + [1.0] * 15]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(1100, rows[0][1], None), (1101, [1.0, 2.0], 1), (1102, [2.0, 4.0], 1), (1200, rows[1][1], rows[1][2])]
    rows += [(2000, [-0.0] + [1.0] * 15, 2), (2020, [0.0] + [1.0] * 15, 2)]
    return spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit(1)).withColumn("n_links", F.lit("x")).repartition(4)


@pytest.mark.parametrize("settings", [embedding_dedup.Settings(), embedding_dedup.Settings(tile=16, pivot_rows=20)])
def test_embedding_links(spark, settings):
    vectors = odd_vectors(spark)
    rows = [r for r in vectors.collect()]

    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    usable = [(r["vec_id"], r["label"], np.array(r["embedding"], float)) for r in rows if good(r["embedding"]) and r["label"] is not None]
    links, parent = Counter(), {r["vec_id"]: r["vec_id"] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, la, x) in enumerate(usable):
        for b, lb, y in usable[:k]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors, settings).collect()}
    assert found == {i: (links[i], root(i), root(i) == i) for i in parent}


def test_quantised_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24)) * rng.choice([1e-3, 1, 1e4], size=(300, 1))
    y = np.vstack([x[:150] + 0.3 * np.abs(x[:150]).mean(axis=1, keepdims=True) * rng.normal(size=(150, 24)), rng.normal(size=(50, 24))])
    exact = x @ y.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    for cosine in (0.5, 0.9, 0.93, 0.99):
        assert sorted(zip(*embedding_dedup.linked_pairs(x, y, cosine), strict=True)) == sorted(zip(*np.nonzero(exact >= cosine), strict=True))


def test_vectors_without_rows_or_ids(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert forest.nearest(none, F.lit(True)).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, None, 1)], VECTORS)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(same).collect()), key=str) == sorted(
        [(None, 1, None, True), (None, 1, None, True), (5, 0, 5, True)], key=str
    )
    assert forest.nearest(same, F.lit(True)).count() == 0


def exact_neighbours(rows, wanted):
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        score = (x * x[k]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[k]][:wanted]
        out[ids[k]] = [(ids[i], score[i]) for i in order]
    return out


def test_forest_reads_everything_when_small(spark):
    vectors = odd_vectors(spark)
    rows = [r for r in vectors.collect() if r["embedding"] and len(r["embedding"]) == 16 and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    expected = exact_neighbours(rows, 20)
    found = defaultdict(list)
    for r in forest.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert dict(found) == expected


@pytest.mark.parametrize("block", [4096, 50])
def test_forest_recall(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    # Norms differ, and a third of the rows are one vector.
    x = (centres[rng.integers(30, size=3000)] + 0.4 * rng.normal(size=(3000, 24))) * rng.uniform(0.2, 2, size=(3000, 1))
    x[::3] = x[0]
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    settings = forest.Settings(leaf=100, sample=1000, tests=100, block=block)
    expected = exact_neighbours([dict(zip(("vec_id", "embedding"), r)) for r in rows], 20)
    found = defaultdict(list)
    for r in forest.nearest(vectors, F.col("vec_id") % 20 == 0, settings).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert all(len(found[q]) == 20 for q in expected)
    lowest = {q: e[-1][1] for q, e in expected.items()}
    assert sum(s >= lowest[q] - 1e-9 for q, f in found.items() for _, s in f) >= 0.9 * 20 * len(expected)
    scores = {(q, i): s for q, e in expected.items() for i, s in e}
    assert all(scores.get((q, i), s) == s for q, f in found.items() for i, s in f)
    # Floors leave out rows that are no result, nothing else.
    without = forest.nearest(vectors, F.col("vec_id") % 20 == 0, replace(settings, floor_bytes=0))
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in without.collect()} == {(q, *f) for q, fs in found.items() for f in fs}


# --- pipeline


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage against what its operator says of the stage's own input."""
    docs = read(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "pii", "mixing", "sentence_pieces"]
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r for r in docs.collect()}
        rows = out.collect()
        if name == "language_id":
            accepted = {r["doc_id"] for r in language_id.predictions(docs).where("accepted").collect()}
            assert {r["doc_id"] for r in rows} == accepted
        elif name == "minhash_near_dedup":
            classes = order_minhash.near_duplicates(docs).collect()
            assert sorted(r["doc_id"] for r in rows) == sorted({r["class_id"] for r in classes})
        elif name == "pii":
            clean = {r["doc_id"] for r in pii.personal_data(docs).where("spans = ''").collect()}
            assert all((r["text"] == before[r["doc_id"]]["text"]) == (r["doc_id"] in clean) for r in rows)
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "mixing":
            taken = Counter(r["doc_id"] for r in rows)
            assert {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).where("taken > 0").collect()} == {
                i: n * len(before[i]["text"].split()) for i, n in taken.items()
            }
        else:
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
            for r in rows:
                # The model loses nothing, but a space in front of a text without one.
                assert r["text"] == before[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids"])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out


def test_pipeline_encodes_in_small_batches(spark, monkeypatch):
    """A task's texts reach the workers bit by bit, and the session's setting is as before."""

    def batch_sizes(text, path):
        @F.arrow_udf("struct<ids:array<int>,text:string>")
        def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                ids = pa.array([[batch.nbytes]] * len(batch), pa.list_(pa.int32()))
                yield pa.StructArray.from_arrays([ids, batch], names=["ids", "text"])

        return sizes(text)

    monkeypatch.setattr(corpus_pipeline.sentence_pieces, "encoded_and_decoded", batch_sizes)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 4000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")
    )
    rows = corpus_pipeline.encoded(spark, docs, "").select("ids", F.length("text").alias("n")).collect()
    assert len(rows) == 4000 and all(r["n"] == 5000 for r in rows)
    assert max(r["ids"][0] for r in rows) <= 1.5 * SENT_BYTES
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("name", ["language_id", "order_minhash", "sentence_pieces", "substring_dedup"])
def test_workers_do_not_load_the_machine_learning_package(name):
    found = f"import sys, propense.llm.{name}; print([m for m in ('pyspark.ml', 'pandas') if m in sys.modules])"
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", found], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "[]"
