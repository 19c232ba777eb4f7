"""Feed files, sinks and boundary checks: odd fields, faults and files as they lie on disk."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sanmaru.operators import boundary as B
from sanmaru.operators import ingest as I
from sanmaru.sources import readers as R
from sanmaru.sources import sinks as S


def test_bands_and_cells_of_feeds(spark, tmp_path):
    night = tmp_path / "n" / "ym=202501"
    night.mkdir(parents=True)
    (night / "a.psv").write_text("\ufeffTIMEZN_CD|ADMDONG_CD|b1|b2\n9|48121510|1.5|x\n10|48121510||2\n", "utf-8")
    got = sorted(map(tuple, R.read_day_night(spark, str(tmp_path / "n")).collect()))
    assert got == [("4812151000", "2025-01", 9, 1.5), ("4812151000", "2025-01", 10, 2.0)]
    out = tmp_path / "o" / "ym=202501"
    out.mkdir(parents=True)
    (out / "a.psv").write_text("BASE_DATE|RSDN_ADM_CD|SGG_CD|w1|w2\n20250101|48121510|48121|1|2\n20250101||48121|9|9\n", "utf-8")
    assert [tuple(r) for r in R.read_mobility(spark, str(tmp_path / "o")).collect()] == [("4812151000", "2025-01", "20250101", 3.0)]
    with pytest.raises(ValueError, match="TIMEZN_CD"):
        R.read_day_night(spark, str(tmp_path / "o"))


def test_envelope_with_a_bad_code_fails(spark):
    df = spark.createDataFrame([('{"response":{"header":{"resultCode":"30"},"body":{}}}',)], "value string")
    with pytest.raises(PySparkException, match="result code 30"):
        R.parse_envelope(df, "value", "struct<id:bigint>").collect()
    with pytest.raises(PySparkException, match="no rows"):
        R.rows_of(spark.createDataFrame([('{"x":1}',)], "value string"), "value", "struct<id:bigint>").collect()


def test_csv_file_has_a_mark_quotes_and_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, 'a"', "x,y")], "rank long, name string, note string")
    S.write_lines(S.csv_lines(rows, ["name", "note"], "rank", [("t", "1,2")]).coalesce(1), str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("part-*"))
    assert b"".join(f.read_bytes() for f in files).decode() == '\ufefft,"1,2"\r\n\r\nname,note\r\n"a""","x,y"\r\nb,\r\n'


def test_no_rows_are_an_error(spark):
    assert I.some_rows(spark.range(3), "none").count() == 3
    with pytest.raises(PySparkException, match="none here"):
        I.some_rows(spark.range(0), "none here").collect()


def test_boundary_faults(spark):
    ring = lambda *p: [list(map(float, q)) for q in p]
    square = ring((128, 35), (128.1, 35), (128.1, 35.1), (128, 35.1), (128, 35))
    cases = {None: [[square]], "empty": [], "open": [[square[:4]]], "short": [[square[:3]]], "bounds": [[ring((120, 35), (121, 35), (121, 36), (120, 35))]], "hole": [[square, ring((129, 35), (129.1, 35), (129.1, 35.1), (129, 35))]]}
    rows = spark.createDataFrame([(str(k), v) for k, v in cases.items()], "k string, polygons array<array<array<array<double>>>>")
    assert {r.k: r.p for r in rows.select("k", B.geometry_problem(F.col("polygons")).alias("p")).collect()} == {str(k): k for k in cases}
    props = {"adm_nm": "경상남도 가", "adm_cd": "48121510", "adm_cd2": "4812151000", "sgg": "1", "sido": "48", "sidonm": "경상남도", "sggnm": "나"}
    features = spark.createDataFrame([(props, [[square]])] * 2, "properties map<string, string>, polygons array<array<array<array<double>>>>")
    assert B.validate_boundaries(features.limit(1), "CRS84", 1).first().feature_count == 1
    with pytest.raises(PySparkException, match="repeated codes"):
        B.validate_boundaries(features, "CRS84", 1).collect()
    with pytest.raises(ValueError, match="5179"):
        B.validate_boundaries(features, "EPSG:5179")


def test_strict_facilities_fail(spark):
    rows = spark.createDataFrame([({"id": "1", "name": "n", "type": "가게", "admCd2": "1", "admNm": "r", "lat": "1", "lng": "2"},)], "record map<string, string>")
    with pytest.raises(PySparkException, match="without type"):
        B.strict_facilities(rows).collect()


def test_later_batches_win(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    updates = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (3, "z", 7)], "id long, v string, seq long")
    assert sorted(map(tuple, S.upsert_batches(base, updates, ["id"], 2).collect())) == [(1, "y"), (2, "b"), (3, "z")]


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
