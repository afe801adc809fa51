from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dates import day_gap, days_since, local_day, real_date
from ledgerloom.functions.identity import fingerprint
from ledgerloom.functions.meta import merge_meta, meta_has, meta_path, result_label, set_meta
from ledgerloom.functions.numbers import js_number, js_text, parse_number, round_base, round_half_up, to_fixed2
from ledgerloom.functions.text import compose_result, json_string, parse_result, safe_name, str_field


def values(df, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_parse_number(spark):
    cells = ["12,5", "1,234.5", "12d", "", "  7 ", "\t5 ", ".5", "5.", "1e3", "1e400", "NaN", "Infinity", "-3", "+4", None]
    want = [12.5, None, None, None, 7.0, 5.0, 0.5, 5.0, 1000.0, None, None, None, -3.0, 4.0, None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert values(df, parse_number(F.col("c"))) == want


def test_js_number(spark):
    pairs = {
        10.0: "10", -0.0: "0", 1.5: "1.5", 12345678901.0: "12345678901", 12345678.25: "12345678.25", 1e21: "1e+21",
        1.5e21: "1.5e+21", 1e-7: "1e-7", 1.234e-5: "0.00001234", 1e20: "100000000000000000000",
        0.1 + 0.2: "0.30000000000000004", -5.0: "-5", 2.5e-10: "2.5e-10",
    }
    df = spark.createDataFrame([(x,) for x in pairs], "x double")
    assert values(df, js_number("x")) == list(pairs.values())
    assert [js_text(30), js_text(30.5)] == ["30", "30.5"]


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,), (1234.56,), (12.34,)], "x double")
    assert values(df, round_half_up(F.col("x"))) == [3.0, -2.0, 0.0, 1235.0, 12.0]
    assert values(df, round_base(F.col("x"), F.lit("clp")))[3] == 1235.0
    assert values(df, round_base(F.col("x"), F.lit("USD")))[4] == 12.3
    exact = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (0.125,), (3.6,), (10.235,)], "x double")
    assert values(exact, to_fixed2(F.col("x"))) == [1.0, 2.67, -1.0, 0.13, 3.6, 10.23]


def test_fingerprint_vector(spark):
    rows = [("2025-10-11", 10.0, "USD"), ("2025-10-11", 10.0, "usd"), ("2025-10-11", 10.0, 'U"D')]
    df = spark.createDataFrame(rows, "fecha string, monto_original double, moneda_original string")
    got = values(df, fingerprint())
    assert got[0] == "60230b2c507587ca80277731b0bc4a4bb93b3621ff624ed8eafc55e5ee465c1c"
    assert len(set(got)) == 3
    quoted = spark.createDataFrame([('a"b\\c\n',), ("x",)], "s string")
    assert values(quoted, json_string(F.col("s"))) == ['"a\\"b\\\\c\\n"', '"x"']


def test_dates(spark):
    df = spark.createDataFrame([(d,) for d in ["2025-01-01", "2025-13-40", "2025-02-30", "2025-1-1", "2026-01-01"]], "d string")
    assert values(df, real_date(F.col("d")).isNotNull()) == [True, False, False, False, True]
    gap = day_gap(F.col("d"), date(2025, 1, 9))
    assert values(df, days_since(gap)) == [8, None, None, None, 0]
    assert local_day(datetime(2025, 1, 10, tzinfo=timezone.utc), "America/Santiago") == date(2025, 1, 9)


def test_texts(spark):
    df = spark.createDataFrame([("a b/ñ😀.csv", " ﻿x\t", None)], "n string, s string, z string")
    assert values(df, safe_name(F.col("n")), str_field(F.col("s")), str_field(F.col("z"))) == [("a_b____.csv", "x", "")]
    res = spark.createDataFrame([("A|sin alertas",), ("P|m1||m2, b",), ("R",), ("",)], "t string")
    full = values(res, parse_result(F.col("t")))
    assert [None if r is None else (r.status, list(r.alertas)) for r in full] == [("A", []), ("P", ["m1", "m2, b"]), ("R", []), None]
    first = values(res, parse_result(F.col("t"), first_only=True))
    assert list(first[1].alertas) == ["m1"]
    again = values(res.select(compose_result(F.lit("P"), F.array(F.lit("m1"), F.lit("m2"))).alias("t")), "t")
    assert again[0] == "P|m1||m2"


def test_meta(spark):
    df = spark.sql("""SELECT '{"dedup":{"reason":"x"},"n":1}' AS j, map('a','1','b','2') AS m, map('b','3') AS p,
        named_struct('a', 1, 'b', 2) AS s""")
    row = df.select(
        meta_path(F.col("j"), "dedup", "reason").alias("r"), meta_has(F.col("j"), "dedup").alias("h"),
        meta_has(F.col("j"), "zz").alias("no"), merge_meta(F.col("m"), F.col("p")).alias("m"),
        set_meta(F.col("s"), b=F.lit(9)).alias("s"),
        result_label(F.lit("running"), F.lit(None).cast("string")).alias("l"),
    ).first()
    assert (row.r, row.h, row.no, row.m, row.s.b, row.l) == ("x", True, False, {"a": "1", "b": "3"}, 9, "EN_PROCESO")


@pytest.mark.parametrize("status,label", [("success", "PENDIENTE"), ("failed", "ERROR"), ("skipped", "OMITIDO")])
def test_labels(spark, status, label):
    assert spark.range(1).select(result_label(F.lit(status), F.lit(None).cast("string"))).first()[0] == label
