from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrachron.functions import dates, routes, sql, text, tiles


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "value, which, expected",
    [
        ("1900", "start", "1900-01-01"),
        ("1900", "end", "1900-12-31"),
        ("1900-02", "end", "1900-02-28"),
        ("2000-02", "end", "2000-02-29"),
        ("-0044-03-15", "start", "-0044-03-15"),
        ("-0005-02", "end", "-0005-02-29"),
        ("800", "end", "0800-12-31"),
        ("1850-13", "start", None),
        ("1999-02-29", "start", None),
        ("circa 1900", "start", None),
        ("", "start", None),
    ],
)
def test_pad_date(spark, value, which, expected):
    assert one(spark, dates.pad_date(F.lit(value), which)) == expected
    sql.register(spark)
    assert spark.sql(f"select pad_date('{value}', '{which}') v").first().v == expected


@pytest.mark.parametrize("value, expected", [(1900.5, "1900-07-02"), (2000.5, "2000-07-01"), (0.5, "-0001-07-01"), (1900.0, "1900-01-01")])
def test_decimal_to_iso(spark, value, expected):
    assert one(spark, dates.decimal_to_iso(F.lit(value))) == expected


def test_dates_round_trip(spark):
    """Every day of many years, common and leap, before and after year 1."""
    years = spark.range(-120, 130).select((F.col("id") * 17).cast("int").alias("year"))
    days = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")).select(
        "year", "m", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("d")
    )
    iso = F.concat_ws("-", dates.year_text(F.col("year")), *[F.lpad(F.col(c).cast("string"), 2, "0") for c in "md"])
    rows = days.select(iso.alias("iso"))
    known = rows.withColumn("dec", dates.to_decimal(F.col("iso"), "start")).filter("dec IS NOT NULL")
    assert known.count() > 90_000
    assert known.filter(dates.decimal_to_iso(F.col("dec")) != F.col("iso")).count() == 0


def test_sql_functions_agree(spark):
    sql.register(spark)
    values = ["1900", "1900-02", "-0044-03-15", "abc", None, "2000-12-31", "0000"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select(
        dates.to_decimal(F.col("v"), "end").alias("a"),
        F.expr("isodatetodecimaldate(pad_date(v, 'end'))").alias("b"),
        dates.decimal_to_iso(dates.to_decimal(F.col("v"), "end")).alias("c"),
        F.expr("convert_decimal_to_iso_date(isodatetodecimaldate(pad_date(v, 'end')))").alias("d"),
        dates.valid_date(F.col("v")).alias("e"),
        F.expr("is_date_valid(v)").alias("f"),
    ).collect()
    for r in got:
        assert r.a == r.b and r.c == r.d and r.e == r.f


def test_route_priority_order(spark):
    rows = [("road", "US:I", "80"), ("road", "US:US", "80"), ("road", "US:CA", "80"), ("road", "US:CA:XX", "80"), ("train", None, None), ("bus", "x", "1")]
    df = spark.createDataFrame(rows, "t string, n string, r string")
    got = [r.p for r in df.select(routes.route_priority(F.col("t"), F.col("n"), F.col("r")).alias("p")).collect()]
    assert got == sorted(got, reverse=True) and len(set(got)) == len(got)
    assert got[0] == Decimal(1_099_001_999_920)


def test_text_helpers(spark):
    assert one(spark, text.sequence_path(F.lit(1884610))) == "001/884/610.osc.gz"
    assert text.language_column_name("name:ar-Latn") == "name_ar_latn"
    assert one(spark, text.as_numeric(F.lit("12 m"))) == -1.0
    assert one(spark, text.human_duration(F.lit(3 * 3600 + 120))) == "3h 2m ago"
    merged = text.merge_tags(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))
    assert one(spark, merged) == {"a": "2", "b": "1"}
    keys = {"name:es": (True, True), "name:es-419": (True, False), "name:EN": (False, False), "name": (False, False)}
    for key, (loose, strict) in keys.items():
        assert one(spark, text.language_key(F.lit(key))) is loose
        assert one(spark, text.language_key(F.lit(key), True)) is strict


@pytest.mark.parametrize("x, z, expected", [(45, 12, "12/45"), (123, 14, "14/12"), (12345, 16, "16/123")])
def test_tile_prefix(spark, x, z, expected):
    assert one(spark, tiles.tile_prefix(F.lit(z), F.lit(x))) == expected


@pytest.mark.parametrize("top, extent, buffer", [(5, 1024, 64), (9, 2048, 128), (12, 4096, 256), (None, 4096, 256)])
def test_extent(spark, top, extent, buffer):
    band = F.lit(top).cast("int")
    assert (one(spark, tiles.extent(band)), one(spark, tiles.buffer(band))) == (extent, buffer)
