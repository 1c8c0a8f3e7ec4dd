import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from propense.functions import labels, parsing
from propense.sources.text import drop_equal_lines, first_line, read_lines


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lenient_lines(spark):
    data = lines(
        spark, "1,2,3", '4,"5",6.5', "7,8,", "9,10,x", "1,2,3,4", "1.5,2,3", " 1,2,3", "1,2,1e3", "+3,-4,-5",
        "99999999999,1,1", "", ",", "1,,3", "6,7,NaN", "6,7,nan", "6,7,inf", "8,9, 4 ",
    )
    result = parsing.parse(data, parsing.PURCHASES)
    kept = [(r["user_id"], r["item_id"], str(r["amount"])) for r in result.collect()]
    assert sorted(kept) == sorted(
        [(1, 2, "3.0"), (4, 5, "6.5"), (1, 2, "1000.0"), (3, -4, "-5.0"), (6, 7, "nan"), (8, 9, "4.0")]
    )


def test_trailing_empty_fields_do_not_count(spark):
    sizes = lines(spark, "1,2,,", "1,,2", ",1").select(F.size(parsing.split_fields(F.col("value"))))
    assert [r[0] for r in sizes.collect()] == [2, 3, 2]


@pytest.mark.parametrize("bad", ["1,x,3,a,b", "1.5,2,3,a,b", "1,2,y,a,b"])
def test_strict_numbers_raise(spark, bad):
    ok = parsing.parse(lines(spark, "1,2,3,a,b", "1,2,3"), parsing.PURCHASES_WITH_FLAGS)
    assert rows(ok) == [(1, 2, 3.0)]
    with pytest.raises(PySparkException, match="not a"):
        parsing.parse(lines(spark, bad), parsing.PURCHASES_WITH_FLAGS).collect()


def test_strict_arity_raises(spark):
    assert rows(parsing.parse(lines(spark, "1,2,3,4"), parsing.ACTIVITY)) == [(1, 2, 3, 4)]
    with pytest.raises(PySparkException, match="expected 4 fields"):
        parsing.parse(lines(spark, "1,2,3"), parsing.ACTIVITY).collect()
    with pytest.raises(PySparkException, match="expected 3 fields"):
        parsing.parse(lines(spark, "1 2"), parsing.COUNTS).collect()


def test_optional_amount(spark):
    data = lines(spark, '1,"2",-,3.5', "1,2,-,none")
    assert rows(parsing.parse(data, parsing.AMOUNTS)) == [(1, 2, 3.5)]
    with pytest.raises(PySparkException, match="not a int"):
        parsing.parse(lines(spark, "1,x,-,3"), parsing.AMOUNTS).collect()


def test_user_list_takes_any_number_of_fields(spark):
    data = lines(spark, "1", "2,a,b", "x,3", "", "4,")
    assert rows(parsing.parse(data, parsing.USER_LIST)) == [(1,), (2,), (4,)]


def test_names(spark):
    data = lines(spark, "1\t Ann \t", "2\t", "3", "x\tBob", "4\ta\tb")
    assert rows(parsing.parse_names(data)) == [(1, "Ann"), (2, ""), (4, "a\tb")]


def test_aliases(spark):
    assert rows(parsing.parse_aliases(lines(spark, "1\t2", "\t3", "4\t5\t6"))) == [(1, 2), (4, 5)]
    with pytest.raises(PySparkException, match="alias without a target"):
        parsing.parse_aliases(lines(spark, "1")).collect()
    with pytest.raises(PySparkException, match="not a int"):
        parsing.parse_aliases(lines(spark, "a\t1")).collect()


def test_count_vectors(spark):
    assert parsing.parse_counts(lines(spark, "1,2.5,0")).first()["counts"] == [1.0, 2.5, 0.0]
    with pytest.raises(PySparkException, match="not a double"):
        parsing.parse_counts(lines(spark, "1,x")).collect()


def test_digits(spark):
    flags = lines(spark, "12", "", "-1", "1.0").select(parsing.is_digits(F.col("value")))
    assert [r[0] for r in flags.collect()] == [True, True, False, False]


def test_headers(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text('user,item,amount\n1,"2",3\nuser,item,amount\n4,5,6\n')
    path = str(tmp_path)
    assert read_lines(spark, path).count() == 8
    assert sorted(r[0] for r in read_lines(spark, path, header=True).collect()) == sorted(
        ['1,"2",3', "user,item,amount", "4,5,6"] * 2
    )
    header = first_line(spark, f"{path}/a.csv")
    assert header == "user,item,amount"
    lines = read_lines(spark, path)
    assert sorted(r[0] for r in drop_equal_lines(lines, header).collect()) == sorted(['1,"2",3', "4,5,6"] * 2)
    assert drop_equal_lines(spark.createDataFrame([], "value string"), header).count() == 0


def test_header_in_some_files_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user,item,amount\n1,1,1\n")
    (tmp_path / "b.csv").write_text("7,7,7\n" * 50)
    lines = read_lines(spark, str(tmp_path))
    rest = drop_equal_lines(lines, first_line(spark, str(tmp_path / "a.csv")))
    assert sorted(r[0] for r in rest.collect()) == ["1,1,1"] + ["7,7,7"] * 50


def test_lines_stay_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n1,2\u0001,3\n\n\"4\n")
    (tmp_path / "b.csv").write_text("")
    path = str(tmp_path)
    assert sorted(r[0] for r in read_lines(spark, path, header=True).collect()) == ["", '"4', "1,2\u0001,3"]
    assert read_lines(spark, path).count() == 4


def test_first_lines_of_files_in_several_parts(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("h\n" + "".join(f"{name}{i:05d}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = read_lines(spark, str(tmp_path), header=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r[0] for r in found) == [f"{name}{i:05d}" for name in "ab" for i in range(3000)]


def test_labels(spark):
    data = spark.createDataFrame(
        [(None, None, None), (0, 1, 0.5), (-3, 2, 0.5), (5, 1, 1.5), (5, 0, float("nan"))],
        "amount int, days int, rate double",
    )
    result = data.select(
        labels.paid(F.col("amount")),
        labels.active_at_least(F.col("days"), 2),
        labels.active_more_than(F.col("days"), 0),
        labels.active_or_frequent(F.col("days"), F.col("rate")),
        labels.payer_class(F.col("amount")),
        labels.zero_if_null(F.col("amount")),
        labels.paid(F.col("rate")),
    )
    assert [tuple(r) for r in result.collect()] == [
        (0.0, 0.0, 0.0, 0.0, 2, 0, 0.0),
        (0.0, 0.0, 1.0, 0.0, 2, 0, 1.0),
        (0.0, 1.0, 1.0, 1.0, 2, -3, 1.0),
        (1.0, 0.0, 1.0, 1.0, 1, 5, 1.0),
        (1.0, 0.0, 0.0, 0.0, 1, 5, 0.0),
    ]


def test_nan_is_not_money(spark):
    nan = spark.createDataFrame([(float("nan"), float("nan"), 0.5)], "amount double, days double, rate double")
    assert nan.select(
        labels.payer_class(F.col("amount")), labels.active_or_frequent(F.col("days"), F.col("rate"))
    ).first() == (2, 0.0)


def test_engaged(spark):
    data = spark.createDataFrame([("1", "2"), ("1", "1"), ("0", "5"), ("x", "2"), (None, "2")], "d string, t string")
    assert data.where(labels.engaged(F.col("d"), F.col("t"))).count() == 1
