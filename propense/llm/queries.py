"""The registered queries on training data: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from propense.llm import (
    embedding_dedup,
    fill_middle,
    forest,
    language_id,
    main_text,
    mixing,
    order_minhash,
    pii,
    sentence_pieces,
    sharding,
    source_divergence,
    substring_dedup,
    token_counts,
)
from propense.llm.tables import read
from propense.plans.registry import query

PLACE = (
    "(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, {digits})))"
    "::BIGINT"
)


def sharding_sql(limit: int) -> str:
    """Every depth's buckets, and per row the first that fits or cannot be split."""
    bits = sharding.BITS
    return f"""
WITH placed AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(strlen(text), 0) AS n_bytes, {PLACE.format(digits=bits // 4)} AS place
  FROM documents),
depths AS (SELECT CAST(unnest(range(0, {bits + 1})) AS BIGINT) AS depth),
buckets AS (
  SELECT depth, place >> ({bits} - depth)::INTEGER AS prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes, min(place) = max(place) AS alone
  FROM placed, depths GROUP BY ALL),
found AS (
  SELECT p.row, min(b.depth) AS depth FROM placed p JOIN buckets b ON b.prefix = p.place >> ({bits} - b.depth)::INTEGER
  WHERE b.bytes <= {limit} OR b.alone GROUP BY p.row),
named AS (
  SELECT p.*, f.depth, b.bytes, b.alone AND b.bytes > {limit} AS paged,
    concat('s', CASE WHEN f.depth > 0 THEN lpad(to_binary(b.prefix), f.depth::INTEGER, '0') ELSE '' END) AS shard,
    row_number() OVER (PARTITION BY p.place ORDER BY p.row) - 1 AS nth, count(*) OVER (PARTITION BY p.place) AS equal,
    greatest(1, {limit} // greatest(n_bytes, 1)) AS per_page
  FROM placed p JOIN found f USING (row) JOIN buckets b ON b.depth = f.depth AND b.prefix = p.place >> ({bits} - f.depth)::INTEGER)
SELECT doc_id, n_bytes, CASE WHEN paged THEN concat(shard, '/', nth // per_page) ELSE shard END AS shard,
  CAST(CASE WHEN paged THEN least(per_page, equal - (nth // per_page) * per_page) * n_bytes ELSE bytes END AS BIGINT) AS shard_bytes
FROM named"""


MIXING_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, coalesce('=' || source, '') AS source_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln(({PLACE.format(digits=13)} + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / coalesce(
      0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(text, '[^\\p{{L}}\\s]+', '', 'g')) / nullif(length(text), 0), 0.1::DOUBLE) AS key
  FROM documents),
sizes AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY 1),
weighted AS (
  SELECT *, {list(mixing.WEIGHTS)}[((row_number() OVER (ORDER BY source_key = '', source_key) - 1) % 3 + 1)::INTEGER] AS weight,
    {mixing.MOST_EPOCHS}::DOUBLE * source_size AS most FROM sizes),
levels AS (
  SELECT 0 AS round, 0::DOUBLE AS level, -1::BIGINT AS done
  UNION ALL
  SELECT round + 1, ({mixing.SHARE}::DOUBLE * total - held) / weights, full_ FROM (
    SELECT l.round, l.done, any_value(l.level) AS level, sum(w.source_size) AS total,
      count(*) FILTER (w.weight * l.level > w.most) AS full_,
      coalesce(sum(w.most) FILTER (w.weight * l.level > w.most), 0) AS held,
      sum(w.weight) FILTER (NOT w.weight * l.level > w.most) AS weights
    FROM levels l, weighted w GROUP BY l.round, l.done)
  WHERE full_ <> done AND weights > 0),
shares AS (
  SELECT *, least(floor(target / greatest(source_size, 1)), {mixing.MOST_EPOCHS}) AS epochs,
    target - least(floor(target / greatest(source_size, 1)), {mixing.MOST_EPOCHS}) * source_size AS rest
  FROM (SELECT source_key, source_size, least(most, weight * (SELECT arg_max(level, round) FROM levels)) AS target FROM weighted)),
fitting AS (
  SELECT k.source_key, key, rest, sum(size) AS size FROM keyed k JOIN shares s USING (source_key)
  WHERE size > 0 AND rest >= 1 GROUP BY ALL),
summed AS (
  SELECT *, size <= rest AND sum(CASE WHEN size <= rest THEN size ELSE 0 END)
    OVER (PARTITION BY source_key ORDER BY key ROWS UNBOUNDED PRECEDING) <= rest AS taken FROM fitting),
gaps AS (SELECT source_key, any_value(rest) - coalesce(sum(size) FILTER (taken), 0) AS gap FROM summed GROUP BY 1),
closing AS (
  SELECT source_key, arg_min(key, (abs(size - gap), key)) AS closing_key FROM summed JOIN gaps USING (source_key)
  WHERE NOT taken AND abs(size - gap) < gap GROUP BY 1)
SELECT k.doc_id, k.size, s.source_size, s.target,
  CAST(k.size * (s.epochs + CASE WHEN f.taken OR f.key = c.closing_key THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM keyed k JOIN shares s USING (source_key)
LEFT JOIN summed f ON f.source_key = k.source_key AND f.key = k.key AND k.size > 0
LEFT JOIN closing c ON c.source_key = k.source_key"""


PASSAGES_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
placed AS (SELECT row, doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM rows),
twos AS (SELECT *, concat(word, ' ', lead(word, 1) OVER w) AS s2 FROM placed WINDOW w AS (PARTITION BY row ORDER BY place)),
fours AS (SELECT *, concat(s2, ' ', lead(s2, 2) OVER w) AS s4 FROM twos WINDOW w AS (PARTITION BY row ORDER BY place)),
eights AS (SELECT *, sha256(concat(s4, ' ', lead(s4, 4) OVER w)) AS s8 FROM fours WINDOW w AS (PARTITION BY row ORDER BY place)),
windows AS (
  SELECT row, doc_id, place, concat(s8, lead(s8, 8) OVER w, sha256(lead(s4, 16) OVER w)) AS content, lead(word, {substring_dedup.Settings().window - 1}) OVER w AS last
  FROM eights WINDOW w AS (PARTITION BY row ORDER BY place)),
later AS (
  SELECT row, place FROM (
    SELECT row, place, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, row, place) AS nth
    FROM windows WHERE last IS NOT NULL) WHERE nth > 1),
covered AS (SELECT DISTINCT row, unnest(range(place, place + {substring_dedup.Settings().window})) AS place FROM later)
SELECT r.doc_id, CAST(len(any_value(r.words)) AS BIGINT) AS n_words, count(c.row) AS n_removed,
  sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.place) FILTER (c.row IS NULL), '')) AS kept_sha256
FROM rows r LEFT JOIN placed p ON p.row = r.row LEFT JOIN covered c ON c.row = p.row AND c.place = p.place
GROUP BY r.row, r.doc_id"""


FILL_MIDDLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS digits FROM documents),
numbers AS (
  SELECT *, concat('0x', substr(digits, 1, 8))::BIGINT % (n + 1) AS first, concat('0x', substr(digits, 9, 8))::BIGINT % (n + 1) AS second,
    concat('0x', substr(digits, 17, 8))::BIGINT AS h3, concat('0x', substr(digits, 25, 8))::BIGINT AS h4 FROM hashed),
cuts AS (
  SELECT *, least(first, second) AS a, greatest(first, second) AS b, CASE
    WHEN n = 0 OR contains(text, '{fill_middle.PREFIX}') OR contains(text, '{fill_middle.SUFFIX}') OR contains(text, '{fill_middle.MIDDLE}')
      OR h3 % 100 >= {fill_middle.CUT_PERCENT} THEN 'plain'
    WHEN h4 % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN concat('{fill_middle.PREFIX}', prefix, '{fill_middle.SUFFIX}', suffix, '{fill_middle.MIDDLE}', middle)
    ELSE concat('{fill_middle.SUFFIX}', suffix, '{fill_middle.PREFIX}', prefix, '{fill_middle.MIDDLE}', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


DIVERGENCE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= {source_divergence.Settings().documents}),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN vocabulary USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY 1),
dense AS (
  SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n FROM sources s JOIN vocabulary v USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
mine AS (
  SELECT lang, source, term, n, 1 + ({source_divergence.SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM dense JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, 1 + ({source_divergence.SCALE}::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
  FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM mine a JOIN mine b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM sources a
  JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM mine JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, CAST(value AS BIGINT),
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM terms)
WHERE part = 'pair' OR rank <= {source_divergence.Settings().ranks}"""


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(sharding_sql(sharding.SHARD_BYTES))
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query()
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoding_digests(
        read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(read(spark, sf_dir, "pages"))


@query()
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query(MIXING_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(read(spark, sf_dir, "documents"))


@query(PASSAGES_SQL)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


@query(FILL_MIDDLE_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


@query(DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"))


query(corpus_pipeline.ORACLE_SQL)(corpus_pipeline.pipeline)
