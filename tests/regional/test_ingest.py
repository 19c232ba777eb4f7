import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanmaru.functions import codes as K
from sanmaru.operators import ingest as I
from sanmaru.sources import readers as R
from sanmaru.sources import sinks as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_codes(spark):
    assert one(spark, K.clean_code, '﻿"4812051000"') == "4812051000"
    assert one(spark, K.quarter_label, "20251") == "2025-03" and one(spark, K.quarter_label, "20254") == "2025-12"
    assert one(spark, K.normal_month, "202513") is None and one(spark, K.normal_month, "202512") == "2025-12"
    assert one(spark, K.minutes, "24:00") is None and one(spark, K.minutes, "9:05") == 545
    assert one(spark, K.field_number, "") == 0.0 and one(spark, K.field_number, "x") is None
    assert one(spark, K.count_number, "1,234") == 1234.0 and one(spark, K.count_number, "-1") is None
    assert one(spark, K.hour_label, "9") == "09"


def test_daily_mean_divides_by_dates(spark):
    rows = spark.createDataFrame([("a", "m", "d1", 32.0), ("a", "m", "d1", 32.0), ("a", "m", "d2", 64.0)], "code string, month string, date string, total double")
    assert I.daily_mean(rows).first().daily == 64.0


def test_credit(spark):
    schema = "code string, pop long, income double, score double, holders long, spend double, economic long"
    rows = spark.createDataFrame([("a", 100, 2000.0, 700.0, 20, 1.0, 1), ("a", 300, 4000.0, 800.0, 60, 1.0, 1), ("z", 0, 5.0, 5.0, 0, 1.0, 1)], schema)
    got = {r.code: r for r in I.credit(rows, ["code"]).collect()}
    assert (got["a"].avg_income, got["a"].credit_score, got["a"].loan_ratio) == (3500.0, 775.0, 20.0)
    assert got["z"].avg_income is None and got["z"].pop_total == 0
    assert I.credit(rows, ["code"], 1000).filter("avg_income is not null").count() == 0


def test_commute_and_migration(spark):
    rows = spark.createDataFrame([("20251", "h", "h", 40), ("20251", "h", "w", 60), ("20251", "x", "h", 110), ("20251", "x", "lone", 20)], "quarter string, home string, work string, n long")
    got = {r.code: (r.jobs_in, r.outbound_ratio, r.job_ratio) for r in I.commute(rows).collect()}
    assert got["h"] == (150, 60.0, 150.0) and got["lone"] == (20, None, None)
    moves = spark.createDataFrame([("q", "1", "2", 5), ("q", "99999", "2", 5), ("q", "2", "2", 5), ("q", None, "2", 5), ("q", "", "2", 5)], "quarter string, previous string, current string, n long")
    assert I.external_moves(moves).count() == 1


def test_dedup_keeps_last_or_first(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, seq int, v int")
    assert sorted((r.k, r.v) for r in I.dedup_last(rows, ["k"], "seq").collect()) == [("a", 20), ("b", 5)]
    assert sorted((r.k, r.v) for r in I.dedup_first(rows, ["k"], "seq").collect()) == [("a", 10), ("b", 5)]


def test_merges(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    part = spark.createDataFrame([("a", 9)], "k string, v int")
    values = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert values(I.merge_all_or_nothing(base, part, ["k"], "v")) == [("a", 1), ("b", 2)]
    assert values(I.merge_all_or_nothing(base, part.union(spark.createDataFrame([("b", 7)], part.schema)), ["k"], "v")) == [("a", 9), ("b", 7)]
    assert values(I.merge_with_zero(base, part, ["k"], "v")) == [("a", 9), ("b", 0)]


def test_readers(spark, tmp_path):
    psv = tmp_path / "a.txt"
    psv.write_text("﻿CODE|M00|F75|X\n1|2|3|4\n", "utf-8")
    df = R.read_psv(spark, str(psv), ["CODE", "M00", "F75"])
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3")] and R.band_columns(df.columns) == ["M00", "F75"]
    with pytest.raises(ValueError, match="NONE"):
        R.read_psv(spark, str(psv), ["NONE"])
    raw = tmp_path / "b.csv"
    raw.write_text("﻿48,a,\n49\n", "utf-8")
    assert [tuple(r) for r in R.read_headerless(spark, str(raw), ["c", "x", "y"]).collect()] == [("48", "a", ""), ("49", None, None)]


def test_geojson_and_xml(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [{"properties": {"code": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"code": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]
    (tmp_path / "g.json").write_text(json.dumps({"features": features}))
    got = {r.properties["code"]: r.polygons for r in R.read_geojson(spark, str(tmp_path / "g.json")).collect()}
    assert len(got["a"]) == 1 and len(got["b"]) == 2 and got["a"][0] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    (tmp_path / "x.xml").write_text("<r><item><name>n</name><XPos>128.5</XPos></item></r>")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("XPos", T.DoubleType())])
    assert [tuple(r) for r in R.read_xml_items(spark, str(tmp_path / "x.xml"), schema).collect()] == [("n", 128.5)]


def test_envelopes(spark):
    item = "struct<k: string>"
    many = json.dumps({"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": [{"k": "1"}, {"k": "2"}]}}}})
    one = json.dumps({"Response": {"head": {"resultCode": "INFO-000"}, "items": {"item": {"k": "3"}}}})
    rows = spark.createDataFrame([(many,), (one,)], "j string")
    assert sorted(r.k for r in R.parse_envelope(rows, "j", item).collect()) == ["1", "2", "3"]
    bad = spark.createDataFrame([(json.dumps({"response": {"header": {"resultCode": "30"}}}),)], "j string")
    with pytest.raises(Exception, match="result code 30"):
        R.parse_envelope(bad, "j", item).collect()


def test_sinks(spark, tmp_path):
    cube = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 2, 5.0)], "code string, month_no int, v double")
    got = {r.code: (r.months, r.series) for r in S.cube_documents(cube, "l", ["v"]).collect()}
    assert got == {"a": ([1, 2], {"v": [2.0, None]}), "b": ([1, 2], {"v": [None, 5.0]})}
    assert S.checksum(cube).first() == S.checksum(cube.repartition(3)).first() != S.checksum(cube.limit(2)).first()
    S.write_ranked_csv(spark.createDataFrame([('a "b", c', 1)], "n string, r int"), str(tmp_path / "csv"))
    assert b'n,r\r\n"a ""b"", c",1\r\n' in [f.read_bytes() for f in (tmp_path / "csv").glob("*.csv")]
    S.write_cube_json(cube, "l", ["v"], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_join_required_refuses_what_is_missing(spark):
    from sanmaru.operators.ingest import join_required

    base = spark.createDataFrame([("a", 1), ("b", 1)], "code string, month_no int")
    full = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("c", 1, 7)], "code string, month_no int, population int")
    assert sorted(tuple(r) for r in join_required(base, full, ["code", "month_no"], "population").collect()) == [("a", 1, 5), ("b", 1, 6)]
    with pytest.raises(Exception, match="no population for"):
        join_required(base, full.filter("code <> 'b'"), ["code", "month_no"], "population").collect()
