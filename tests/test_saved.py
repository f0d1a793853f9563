import datetime
import decimal

from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.scalars import escape_field, unescape_field
from tidemark.plans.scripts import load_result, save_result
from tidemark.sources.delimited import as_lines, as_strings, result_columns, save_sorted_csv

TEXTS = ["plain", "", None, "a\tb", "a\nb", "a\r\nb", r"\N", "\\", "ends with \\", "\\t", "\\\\n\t\\", "é|,\""]


def test_texts_come_back_unchanged(spark, tmp_path):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "i int, a string, b string")
    save_result(df, str(tmp_path / "r"))
    back = load_result(spark, str(tmp_path / "r"))
    assert back.schema == df.schema
    assert rows(back) == rows(df)


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    back = df.select("t", unescape_field(escape_field(F.col("t"))).alias("u"))
    assert back.where("NOT (t <=> u)").count() == 0


def test_escape_of_every_short_string_is_reversible_and_unique(spark):
    signs = "\\tnrN\t\n\r"
    texts = [""]
    for _ in range(4):
        texts += [t + c for t in texts for c in signs]
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string")
    safe = df.select("t", escape_field(F.col("t")).alias("e"))
    assert safe.where("e RLIKE '[\\\\t\\\\n\\\\r]'").count() == 0
    assert safe.select("e").distinct().count() == df.count()
    assert safe.where(~F.col("t").eqNullSafe(unescape_field(F.col("e")))).count() == 0


def test_all_types_come_back(spark, tmp_path):
    schema = (
        "a tinyint, b double, c decimal(10,4), d boolean, e date, f timestamp, g timestamp_ntz, "
        "h array<string>, i map<string, bigint>, j struct<x: int, y: array<double>>, k binary, "
        "l array<timestamp_ntz>, m array<timestamp>"
    )
    now = datetime.datetime(2024, 2, 29, 1, 2, 3, 456)
    full = (1, 0.1 + 0.2, decimal.Decimal("1.2500"), True, now.date(), now, now, ["x\t", None], {"k\n": 1},
            (1, [2.5, None]), bytearray(b"\x00\xff\n\t"), [now], [now])
    extreme = (-1, float("inf"), None, False, None, None, None, [], {}, (None, None), bytearray(b""), [], None)
    df = spark.createDataFrame([full, extreme, (None,) * 13], schema)
    save_result(df, str(tmp_path / "r"))
    back = load_result(spark, str(tmp_path / "r"))
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert rows(back) == rows(df)


def test_one_column_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,)], "only string")
    save_result(df, str(tmp_path / "one"))
    assert rows(load_result(spark, str(tmp_path / "one"))) == rows(df)
    save_result(df.where("false"), str(tmp_path / "none"))
    assert load_result(spark, str(tmp_path / "none")).count() == 0


def test_lines_and_columns(spark):
    df = spark.sql("SELECT 1 AS `a.b`, CAST(null AS string) c, array(1, 2) d, 'x\ty' e")
    assert as_lines(df).first()[0] == "1\t\\N\t[1,2]\tx\\ty"
    assert tuple(as_strings(df).first()) == ("1", None, "[1,2]", "x\ty")
    assert rows(result_columns(df), "position", "name", "type") == [
        (0, "a.b", "int"), (1, "c", "string"), (2, "d", "array<int>"), (3, "e", "string")
    ]


def test_large_csv_keeps_its_order_over_several_files(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("n"), F.repeat(F.lit("x"), 40).alias("s"))
    # Partitions left as they are stand for a result too large to merge.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_sorted_csv(df, str(tmp_path / "out"), ["n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    numbers = [int(line.split(b",")[0]) for p in parts for line in p.read_bytes().split(b"\r\n") if line]
    assert len(parts) > 1 and len(numbers) == 200_000 and numbers == sorted(numbers)
