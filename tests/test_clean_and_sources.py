import contextlib
import io
import json
import time

import pytest
from pyspark.sql import functions as F

from vespera import plans, sources
from vespera.functions.text import missing_to_null, postal_code, strip
from vespera.operators import clean, profile


def test_clean_drops_missing_description(spark):
    raw = spark.createDataFrame(
        [("1", "Concert Jazz", "Un super concert", "Paris", "Paris", "2026-08-01", "2026-08-01"),
         ("2", "Expo Peinture", None, "Lyon", "Rhône", "2026-09-01", "2026-09-15")],
        "uid string, title_fr string, description_fr string, location_city string, location_department string, "
        "date_start string, date_end string",
    )
    rows = plans.clean_events(raw).collect()
    assert len(rows) == 1 and "date_start" not in rows[0].asDict()
    assert rows[0].text_to_embed == (
        "Titre: Concert Jazz\nLieu: Paris (Paris)\nDate: du  au \nDescription: Un super concert"
    )


def test_composed_text_and_tags(spark):
    schema = "uid string, title_fr string, description_fr string, longdescription_fr string, location_city string"
    raw = spark.createDataFrame([("1", None, "court", None, "Paris"), ("2", "T", "c", "<p>a<br>b</p>&amp;", "P")], schema)
    texts = [r.text_to_embed for r in plans.clean_events(raw).orderBy("uid").collect()]
    assert texts == [
        "Titre: None\nLieu: Paris ()\nDate: du  au \nDescription: None",
        "Titre: T\nLieu: P ()\nDate: du  au \nDescription: a\nb&amp;",
    ]
    filled = plans.clean_events(raw, row_fallback=True).orderBy("uid").first().text_to_embed
    assert filled.endswith("Description: court")
    empty = plans.clean_events(raw.where("uid = 'x'"))
    assert empty.count() == 0 and "text_to_embed" in empty.columns


def test_missing_values_and_unicode_strip(spark):
    texts = ["a", "  a \n", " nan\t", "NaN", "", " ", "nan nan", "\x1cb\x85", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(missing_to_null(F.col("t")).alias("m"), strip(F.col("t")).alias("s")).collect()
    assert [r.m for r in rows] == ["a", "a", None, None, None, None, "nan nan", "b", None]
    assert [r.s for r in rows] == [t.strip() if t is not None else None for t in texts]


def test_documents_keep_order_and_rename(spark):
    clean_rows = spark.createDataFrame([("u", "T", " x "), (None, None, "nan")], "uid string, title_fr string, text_to_embed string")
    rows = clean.to_documents(clean_rows.coalesce(1)).collect()
    assert [(r.doc_ord, r.text, r.uid, r.title, r.city) for r in rows] == [(0, "x", "u", "T", None)]


def test_all_pages_are_read_or_reading_fails(spark, tmp_path):
    for page, size in ((1, 2), (2, 2), (3, 1), (10, 2)):
        records = [{"uid": f"{page}-{i}", "title_fr": "é\n", "other": 1} for i in range(size)]
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"total_count": 9, "results": records}, indent=1))
    assert len(sources.read_event_pages(spark, str(tmp_path)).collect()) == 7
    with pytest.raises(ValueError, match="page 3 is short"):
        sources.read_event_pages(spark, str(tmp_path), page_size=2)
    (tmp_path / "page-10.json").write_text('{"results": []}')
    assert len(sources.read_event_pages(spark, str(tmp_path), page_size=2).collect()) == 5
    named = tmp_path / "named"
    named.mkdir()
    (named / "extra.json").write_text('{"results": [{"uid": "x"}]}')
    assert [r.uid for r in sources.read_event_pages(spark, str(named)).collect()] == ["x"]
    with pytest.raises(ValueError, match="1 pages without number"):
        sources.read_event_pages(spark, str(named), page_size=2, page_pattern=r"-(\d+)\.json$")


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title_fr,extra,uid\n"",z,1\n,z,2\n')
    rows = sources.read_clean_csv(spark, str(tmp_path / "a.csv"), "uid int, description_fr string, title_fr string").collect()
    assert [tuple(r) for r in rows] == [(1, None, ""), (2, None, None)]


def test_long_blank_text_is_cleaned_quickly(spark):
    df = spark.createDataFrame([(" " * 1_000_000 + "x",), (" \n" * 500_000,)], "t string")
    start = time.perf_counter()
    assert [r.m for r in df.select(missing_to_null(F.col("t")).alias("m")).collect()] == ["x", None]
    assert time.perf_counter() - start < 10


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_bytes('uid,title_fr\r\n1,"a ""b""\n c "\r\n'.encode("utf-8-sig"))
    rows = sources.read_clean_csv(spark, str(path), "uid string, title_fr string").collect()
    assert [(r.uid, r.title_fr) for r in rows] == [("1", 'a "b"\n c ')]


def test_checks(spark, tmp_path):
    df = spark.createDataFrame([("q",)], "question string")
    with pytest.raises(ValueError, match="reference"):
        sources.require_columns(df, ["question", "reference"])
    with pytest.raises(ValueError, match="empty"):
        sources.require_rows(df.where("question = 'x'"))
    (tmp_path / "t.csv").write_text("question,reference\nq,r\n")
    assert sources.read_test_set(spark, str(tmp_path / "t.csv")).collect() == [("q", "r")]
    with pytest.raises(ValueError, match="unknown format"):
        sources.write_events(df, str(tmp_path / "x"), "xls")


def test_scope_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(
        [("1", "Paris", "2025-07-12"), ("2", "Paris", "2025-07-11"), ("3", "Lyon", "2026-01-01")],
        "uid string, location_city string, firstdate_begin string",
    ).write.parquet(f"{tmp_path}/e")
    scoped = clean.scope_events(spark.read.parquet(f"{tmp_path}/e"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        scoped.explain("formatted")
    pushed = next(line for line in plan.getvalue().splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(location_city,Paris)" in pushed and "GreaterThanOrEqual(firstdate_begin,2025-07-12)" in pushed
    assert [r.uid for r in scoped.collect()] == ["1"]


def test_postal_codes_and_profile(spark):
    codes = ["75004", "75001.0", "F-75011", None, "75116", "93200", "x"]
    df = spark.createDataFrame([(c,) for c in codes], "location_postalcode string")
    got = [r.c for r in df.select(postal_code(F.col("location_postalcode")).alias("c")).collect()]
    assert got == ["75004", "75001", "75011", None, "75116", "93200", None]
    assert {r.arrondissement for r in profile.top_arrondissements(df).collect()} == {"4", "1", "11", "16"}
    assert profile.top_arrondissements(df.drop("location_postalcode")) is None
    dates = spark.createDataFrame([("2026-07-24T17:30:00+00:00",), ("bad",), (None,), ("2026-07-01",)], "firstdate_begin string")
    assert profile.events_by_month(dates).collect() == [("2026-07", 2)]


@pytest.mark.parametrize("suffix,fmt", [("clean.parquet", "parquet"), ("clean.csv", "csv")])
def test_written_events_load_again(spark, tmp_path, suffix, fmt):
    columns = [f.name for f in sources.CLEAN_SCHEMA.fields]
    row = tuple(f"{c}: «é»,\n \"x\" " for c in columns)
    events = spark.createDataFrame([row], sources.CLEAN_SCHEMA)
    sources.write_events(events, f"{tmp_path}/{suffix}", fmt)
    assert plans.load_clean_events(spark, f"{tmp_path}/{suffix}").collect() == [row]
    sources.write_events(events.limit(0), f"{tmp_path}/{suffix}", fmt)
    with pytest.raises(ValueError, match="empty"):
        plans.load_clean_events(spark, f"{tmp_path}/{suffix}")
