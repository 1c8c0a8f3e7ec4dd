"""Parsing and scanning queries over text and tables derived from the provided data."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions import parsing
from propense.functions.labels import (
    active_at_least,
    active_or_frequent,
    engaged,
    paid,
    payer_class,
)
from propense.operators.features import vector_element
from propense.operators.popularity import resolve_aliases
from propense.plans.fixtures import (
    CHANNEL,
    INTERACTIONS_SQL,
    MODELING_SQL,
    TARGET_ITEM,
    cents,
    interactions,
    modeling,
    table,
)
from propense.plans.registry import query
from propense.sources.sinks import write_lines
from propense.sources.staging import staging_path, write_staged
from propense.sources.tables import read_channel, read_ratings, read_table, read_vectors
from propense.sources.text import drop_equal_lines, read_lines

# Signed amounts in cents: kept goods earn, returned goods cost, the rest is free.
_AMOUNT_SQL = """CASE l_returnflag WHEN 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT)
     WHEN 'R' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END"""


def _amount() -> Column:
    flag = F.col("l_returnflag")
    price = cents("l_extendedprice")
    return F.when(flag == "A", price).when(flag == "R", -price).otherwise(F.lit(0).cast("bigint"))


def _csv(*parts: Column | str) -> Column:
    return F.concat_ws(",", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def _by_line_number(*lines: Column) -> Column:
    """Line number 1 gets the first form, 2 the second, and so on."""
    result = None
    for number, line in enumerate(lines, start=1):
        condition = F.col("l_linenumber") == number
        result = F.when(condition, line) if result is None else result.when(condition, line)
    return result.otherwise(lines[0])


def _line_table(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(line.alias("value"))


def _quoted() -> Column:
    return F.concat(F.lit('"'), F.col("l_suppkey").cast("string"), F.lit('"'))


@query(f"""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CASE WHEN {_AMOUNT_SQL} > 0 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM lineitem WHERE l_linenumber IN (1, 2)""")
def parse_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1 and 2 are well formed; the others miss a field, have one too many or a malformed number."""
    amount = _amount().cast("string")
    lines = _line_table(
        spark,
        sf_dir,
        _by_line_number(
            _csv("l_partkey", "l_suppkey", amount),
            _csv("l_partkey", _quoted(), amount),
            _csv("l_partkey", "l_suppkey", F.lit("")),
            _csv("l_partkey", "l_suppkey", F.concat(amount, F.lit("x"))),
            _csv("l_partkey", "l_suppkey", amount, F.lit("1")),
            _csv(F.concat(F.col("l_partkey"), F.lit(".5")), "l_suppkey", amount),
            _csv(F.concat(F.lit(" "), F.col("l_partkey")), "l_suppkey", amount),
        ),
    )
    return parsing.parse(lines, parsing.PURCHASES).select("user_id", "item_id", paid(F.col("amount")).alias("rating"))


@query(f"""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CASE WHEN {_AMOUNT_SQL} > 0 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM lineitem WHERE l_linenumber <> 3""")
def parse_number_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the wrong length are dropped; a malformed number would raise."""
    amount = _amount().cast("string")
    full = _csv("l_partkey", _quoted(), amount, "l_quantity", F.lit("y"))
    lines = _line_table(spark, sf_dir, _by_line_number(full, full, _csv("l_partkey", _quoted(), amount)))
    return parsing.parse(lines, parsing.PURCHASES_WITH_FLAGS).select(
        "user_id", "item_id", paid(F.col("amount")).alias("rating")
    )


@query("""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CASE WHEN l_quantity >= 25 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM lineitem WHERE l_linenumber <> 2""")
def parse_login_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities stand for login days; line 2 ends in empty fields."""
    full = _csv("l_partkey", "l_suppkey", _amount(), "l_quantity", "l_linenumber", F.lit("3"))
    cut = _csv("l_partkey", "l_suppkey", _amount(), "l_quantity", F.lit(""), F.lit(""))
    rows = parsing.parse(_line_table(spark, sf_dir, _by_line_number(full, cut)), parsing.ENGAGEMENT)
    return rows.select("user_id", "item_id", active_at_least(F.col("login_days"), 25).alias("rating"))


def _profile(*more: Column) -> Column:
    fixed = [F.lit(x) for x in ("m", "theme", "style", "c", "t1", "t2")]
    channel = F.when(F.col("l_linestatus") == "F", 2).otherwise(1)
    # Amounts are whole units here: the layout reads them as integers.
    whole = F.floor(_amount() / 100)
    days = F.col("l_linenumber")
    return _csv(
        "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), days, F.lit(60), F.lit(1), whole, *fixed, channel, *more
    )


_PROFILE_SQL = f"""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CASE WHEN ({_AMOUNT_SQL}) >= 100 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM lineitem"""


@query(_PROFILE_SQL)
def parse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.parse(_line_table(spark, sf_dir, _profile()), parsing.PROFILE)
    return rows.select("user_id", "item_id", paid(F.col("amount")).alias("rating"))


@query(f"{_PROFILE_SQL} WHERE l_linenumber <> 2")
def parse_profile_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 2 lacks the two totals."""
    line = _by_line_number(_profile(F.lit(4), F.lit(100)), _profile())
    rows = parsing.parse(_line_table(spark, sf_dir, line), parsing.PROFILE_WITH_TOTALS)
    return rows.select("user_id", "item_id", paid(F.col("amount")).alias("rating"))


@query("""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CASE WHEN l_linenumber > 1 OR l_discount > 0.05 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM lineitem WHERE l_linenumber <> 5""")
def parse_login_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers stand for login days and 20 x discount for the rate; line 5 has a malformed rate."""
    rate = F.format_string("%.1f", F.round(F.col("l_discount") * 20, 1))
    line = F.when(F.col("l_linenumber") == 5, _profile(F.lit("often"))).otherwise(_profile(rate))
    rows = parsing.parse(_line_table(spark, sf_dir, line), parsing.PROFILE_WITH_RATE)
    label = active_or_frequent(F.col("login_days"), F.col("login_rate"))
    return rows.select("user_id", "item_id", label.alias("rating"))


_GRADE_SQL = """
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CAST(l_quantity AS DOUBLE) AS rating
FROM lineitem"""


@query(_GRADE_SQL)
def parse_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade is the rating as it stands."""
    line = _csv("l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), _amount())
    rows = parsing.parse(_line_table(spark, sf_dir, line), parsing.GRADES)
    return rows.select("user_id", "item_id", F.col("grade").alias("rating"))


@query(f"{_GRADE_SQL} WHERE l_linenumber <> 7")
def parse_grades_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 7 has one field too many."""
    grade = F.col("l_quantity").cast("int")
    line = F.when(
        F.col("l_linenumber") == 7, _csv("l_partkey", "l_suppkey", grade, _amount(), F.lit(1), F.lit(0), F.lit(9))
    ).otherwise(_csv("l_partkey", "l_suppkey", grade, _amount(), F.lit(1), F.lit(0)))
    rows = parsing.parse(_line_table(spark, sf_dir, line), parsing.GRADES_WITH_FLAGS)
    return rows.select("user_id", "item_id", F.col("grade").alias("rating"))


@query(f"""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CAST(l_quantity AS INTEGER) AS login_days, CAST(floor(({_AMOUNT_SQL}) / 100.0) AS INTEGER) AS amount
FROM lineitem""")
def parse_activity_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any malformed line would raise."""
    line = _csv("l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.floor(_amount() / 100))
    return parsing.parse(_line_table(spark, sf_dir, line), parsing.ACTIVITY)


@query(f"""
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id,
       CAST({_AMOUNT_SQL} AS DOUBLE) AS amount
FROM lineitem WHERE l_linenumber <> 4""")
def parse_amount_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids must be numbers; line 4 has no usable amount and is dropped."""
    amount = F.when(F.col("l_linenumber") == 4, F.lit("n/a")).otherwise(_amount().cast("string"))
    line = _csv("l_partkey", _quoted(), F.lit("-"), amount)
    return parsing.parse(_line_table(spark, sf_dir, line), parsing.AMOUNTS)


@query(f"""
SELECT CAST(c_custkey AS INTEGER) AS user_id, {TARGET_ITEM} AS item_id
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def parse_user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment's ids carry a letter and are dropped; everyone else is paired with the target item."""
    segment = F.col("c_mktsegment")
    key = F.col("c_custkey").cast("string")
    user = F.when(segment == "BUILDING", F.concat(F.lit("u"), key)).otherwise(key)
    lines = table(spark, sf_dir, "customer").select(_csv(user, "c_name", "c_nationkey").alias("value"))
    return parsing.parse(lines, parsing.USER_LIST).withColumn("item_id", F.lit(TARGET_ITEM))


# A supplier with a negative balance is an obsolete entry for the first sound supplier of its nation.
_ALIASES_SQL = """aliases AS (
  SELECT b.s_suppkey AS bad_id, g.good_id
  FROM supplier b JOIN (SELECT s_nationkey, min(s_suppkey) AS good_id FROM supplier WHERE s_acctbal >= 0 GROUP BY 1) g
    ON b.s_nationkey = g.s_nationkey
  WHERE b.s_acctbal < 0)"""


def alias_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`bad<TAB>good` lines; suppliers in good standing give lines with an empty first field."""
    suppliers = table(spark, sf_dir, "supplier")
    sound = F.col("s_acctbal") >= 0
    good = suppliers.where(sound).groupBy("s_nationkey").agg(F.min("s_suppkey").alias("good_id"))
    bad = F.when(sound, F.lit("")).otherwise(F.col("s_suppkey").cast("string"))
    line = F.concat_ws("\t", bad, F.col("good_id").cast("string"))
    return suppliers.join(good, "s_nationkey").select(line.alias("value"))


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id<TAB>name` lines; one in each nation without a tab, and names padded with blanks."""
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    line = (
        F.when(F.col("s_acctbal") < 0, key)
        .when(F.col("s_nationkey") == 7, F.concat(key, F.lit("x\t"), F.col("s_name")))
        .otherwise(F.concat(key, F.lit("\t "), F.col("s_name"), F.lit(" ")))
    )
    return suppliers.select(line.alias("value"))


@query(f"""WITH {_ALIASES_SQL}
SELECT CAST(bad_id AS INTEGER) AS bad_id, CAST(good_id AS INTEGER) AS good_id FROM aliases""")
def parse_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_aliases(alias_lines(spark, sf_dir))


@query("""
SELECT CAST(s_suppkey AS INTEGER) AS item_id, s_name AS name
FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 7""")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a tab and ids with a letter are dropped, names are trimmed."""
    return parsing.parse_names(name_lines(spark, sf_dir))


@query(f"""WITH {_ALIASES_SQL}
SELECT CAST(l_partkey AS INTEGER) AS user_id, CAST(coalesce(good_id, l_suppkey) AS INTEGER) AS item_id,
       CAST(l_quantity AS INTEGER) AS count
FROM lineitem LEFT JOIN aliases ON l_suppkey = bad_id""")
def parse_counts_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated triples, with obsolete item ids replaced."""
    line = F.concat_ws(" ", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int").cast("string"))
    triples = parsing.parse(_line_table(spark, sf_dir, line), parsing.COUNTS)
    return resolve_aliases(triples, parsing.parse_aliases(alias_lines(spark, sf_dir)))


# The kinds of events, in the order of the vector's positions.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`user_id, value`: a line with the user's number of events of each kind."""
    kinds = [F.count_if(F.col("event_type") == kind).cast("string") for kind in EVENT_TYPES]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws(",", *kinds).alias("value"))


@query(f"""
SELECT e.user_id, k.position, CAST(count(*) FILTER (WHERE e.event_type = k.kind) AS DOUBLE) AS count
FROM events e CROSS JOIN (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(EVENT_TYPES))}) k(position, kind)
GROUP BY 1, 2""")
def parse_count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of counts as vectors, shown element by element."""
    vectors = parsing.parse_counts(event_counts(spark, sf_dir))
    return vectors.select("user_id", F.posexplode("counts").alias("position", "count"))


@query("""
SELECT part AS field, regexp_matches(part, '^[0-9]*$') AS digits, count(*) AS count
FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS part FROM orders) GROUP BY 1, 2""")
def digits_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").select(F.explode(F.split("o_orderpriority", "-")).alias("field"))
    return parts.groupBy("field", parsing.is_digits(F.col("field")).alias("digits")).count()


_PART_SQL = """
SELECT CAST(p_partkey AS INTEGER) AS user_id, CAST(p_size AS INTEGER) AS item_id,
       CAST(round(p_retailprice * 100) AS DOUBLE) AS amount FROM part"""


def _part_files(spark: SparkSession, sf_dir: str, bare: str = "false") -> str:
    """CSV files: those of the `bare` rows, the larger ones, without a header line, the others with one."""
    path = staging_path(spark, "lines")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("user_id"), F.col("p_size").alias("item_id"), cents("p_retailprice").alias("amount")
    )
    rows.where(f"NOT ({bare})").write.option("header", True).csv(path)
    rows.where(bare).write.mode("append").csv(path)
    return path


@query(_PART_SQL)
def scan_lines_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files, the first line of each skipped by the scan."""
    return parsing.parse(read_lines(spark, _part_files(spark, sf_dir), header=True), parsing.PURCHASES)


@query(_PART_SQL)
def scan_lines_equal_to_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of which some have a header, every line equal to it dropped."""
    lines = read_lines(spark, _part_files(spark, sf_dir, bare="user_id % 4 <> 0"))
    return parsing.parse(drop_equal_lines(lines, "user_id,item_id,amount"), parsing.PURCHASES)


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, CAST(item_id AS INTEGER) AS item_id, CAST(revenue AS DOUBLE) AS rating FROM interactions""")
def scan_parquet_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table whose item id is text."""
    rows = interactions(spark, sf_dir).select(
        "user_id", F.col("item_id").cast("string").alias("item_id"), F.col("revenue").alias("amount")
    )
    return read_ratings(spark, write_staged(rows, "ratings"))


@query(f"""WITH {MODELING_SQL}
SELECT user_id, item_id, active_days FROM modeling WHERE channel = {CHANNEL}""")
def scan_sql_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a parquet path; the channel predicate is pushed to the files."""
    return read_channel(spark, write_staged(modeling(spark, sf_dir), "modeling"), "active_days", CHANNEL)


@query("""
SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_linenumber >= 1 AND CAST(l_quantity AS INTEGER) >= 2""")
def engagement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table with text columns, filtered and cast."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("item_id"),
        F.col("l_linenumber").cast("string").alias("login_days"),
        F.col("l_quantity").cast("int").cast("string").alias("login_times"),
    ).createOrReplaceTempView("engagement")
    return (
        read_table(spark, "engagement")
        .where(engaged(F.col("login_days"), F.col("login_times")))
        .select(F.col("user_id").cast("int"), F.col("item_id").cast("int"))
    )


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN {_AMOUNT_SQL} > 0 THEN 1 ELSE 2 END AS payer_class FROM lineitem""")
def payer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", payer_class(_amount()).alias("payer_class")
    )


@query("SELECT vec_id AS user_id FROM embeddings WHERE CAST(embedding[8] AS DOUBLE) > 0")
def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored `(id, vector)` rows, filtered on one element."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    stored = read_vectors(spark, write_staged(rows, "vectors"))
    return stored.where(vector_element(F.col("features"), 7) > 0).select("user_id")


@query("""
SELECT label, CASE WHEN CAST(embedding[8] AS DOUBLE) > 0 THEN 'target' ELSE 'other' END AS population, count(*) AS count
FROM embeddings GROUP BY 1, 2""")
def vector_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and other users told apart by one vector element."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "features", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    hit = vector_element(F.col("features"), 7) > 0
    return rows.groupBy("label", F.when(hit, "target").otherwise("other").alias("population")).count()


def lines_to_files(lines: DataFrame, name: str) -> str:
    """Write a `value` column as text files; gives the path."""
    path = staging_path(lines.sparkSession, name)
    write_lines(lines, F.col("value"), path)
    return path
