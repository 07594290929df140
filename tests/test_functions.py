import datetime as dt

from pyspark.sql import functions as F

from stockroom.functions import dates as X
from stockroom.functions import numbers as N
from stockroom.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_dates(spark):
    assert one(spark, X.parse_dmy("v"), "9/4/2026") == dt.date(2026, 4, 9)
    assert one(spark, X.parse_dmy("v"), "31/02/2026") is None
    assert one(spark, X.parse_day_first("v"), "03-04-2026") == dt.date(2026, 4, 3)
    assert one(spark, X.parse_day_first("v"), "2026-04-03") == dt.date(2026, 4, 3)
    assert one(spark, X.parse_dmy_or_iso("v"), "bad") is None
    assert one(spark, X.parse_yyyymmdd("v"), "20260407") == dt.date(2026, 4, 7)
    assert one(spark, X.parse_d_mon_yy("v"), "1-Apr-26") == dt.date(2026, 4, 1)
    d = spark.createDataFrame([(dt.date(2027, 1, 1),)], "d date")
    r = d.select(X.iso_week_year("d").alias("y"), X.iso_week("d").alias("w"), X.weekday_mon0("d").alias("wd"),
                 X.is_weekend("d").alias("we")).first()
    assert (r["y"], r["w"], r["wd"], r["we"]) == (2026, 53, 4, False)


def test_numbers(spark):
    assert one(spark, N.strict_int("v"), " 7 ") == 7
    assert one(spark, N.strict_int("v"), "1.5") is None
    assert one(spark, N.lenient_int("v"), "-2.9") == -2
    assert one(spark, N.coerce_number("v"), "abc") == 0.0
    assert one(spark, N.first_number_plain("v"), " 12.5 NOS") == 12.5
    assert one(spark, N.first_number_signed("v"), "-1,234.50/NOS") == -1234.5
    assert one(spark, N.number_strip_units("v"), "1,200 NOS") == 1200.0
    rate, unit = N.split_rate_unit("v")
    assert one(spark, F.struct(rate, unit), "2114.00/NOS") == (2114.0, "NOS")
    assert one(spark, F.struct(rate, unit), "") == (0.0, "NOS")
    assert one(spark, F.struct(rate, unit), "5") == (5.0, "NOS")


def test_text(spark):
    assert one(spark, T.trim_or_blank("v"), None) == ""
    assert one(spark, T.size_from_item("v"), "ROYAL STAG 750 - ML") == 750
    assert one(spark, T.size_from_item("v", journal=True), "MC 180ML PET") == 180
    assert one(spark, T.brand_from_item("v"), "Royal Stag 750 - ml Pet") == "Royal Stag"
    assert one(spark, T.brand_from_item("v", trailing_only=True), "OLD MONK 180 - ML") == "OLD MONK"
    assert one(spark, T.normalize_item_name("v"), "Old-Monk's 180 millilitres, Rum.") == "OLD MONKS 180 ML RUM"
    assert one(spark, T.spoken_to_digits("v"), "seven five zero") == "7 5 0"
    assert one(spark, T.spoken_size("v"), "royal stag seven fifty 750 milliliters") == 750
    assert one(spark, T.spoken_item_name("v"), "royal stag 750 milliliters") == "royal stag"
    assert one(spark, T.search_words("v"), "The Royal-Stag & Whiskey 750 ml") == \
        ["royal", "stag", "whisky", "750"]
    assert one(spark, T.is_sales_question("v"), "Show me TOTAL SALES please") is True
    assert one(spark, T.is_sales_question("v"), "stock of rum") is False
    assert one(spark, T.question_date("v", "2026-04-07"), "sales on 05/04/2026") == dt.date(2026, 4, 5)
    assert one(spark, T.question_date("v", "2026-04-07"), "sales 2026-04-01 vs 02/04/2026") == dt.date(2026, 4, 1)
    assert one(spark, T.question_date("v", "2026-04-07"), "sales today") == dt.date(2026, 4, 7)
    assert one(spark, T.look_column(F.lit("WHISKY"), F.lit("A"), F.lit(750)), "x") == "(WHISKY) - A - 750 ML"
