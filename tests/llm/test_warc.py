import os

import pytest
from pyspark.sql import functions as F

from proofline.llm import warc

RESPONSES = "record_id long, url string, at long, etag string, last_modified string, digest string, headers map<string,string>"
REVISITS = "record_id long, url string, at long, etag string, last_modified string, headers map<string,string>"


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://WWW.Ex.org:80/a/?utm_source=x&b=2&a=1#top", "ex.org/a?a=1&b=2"), ("https://ex.org", "ex.org"), ("https://ex.org/", "ex.org"),
    ("https://ex.org:8080/A//", "ex.org:8080/A"), ("notes.txt", "notes.txt"), ("", ""), (None, None), ("http://e.org/?ref=1&reform=2", "e.org?reform=2"),
])
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical(F.col("u")).alias("k")).first().k == key


@pytest.mark.parametrize("slot", [1, 7, 3600])
def test_latest_earlier_response(spark, slot):
    h = {"etag": '"a"', "content-length": "9", "x": "1"}
    responses = [
        (1, "http://e.org/p", 10, '"a"', "t1", "d1", h), (2, "https://www.e.org/p/", 20, '"b"', "t2", "d2", h), (3, "http://e.org/p", 20, '"c"', "t2", "d3", h),
        (4, "http://e.org/q", 5, None, "t4", "d4", None), (5, None, 1, '"a"', None, "d5", h), (6, "http://e.org/p", None, '"a"', "t1", "d6", h),
    ]
    fresh = {"x": "2", "content-length": "0", "date": "now"}
    revisits = [
        (11, "http://e.org/p#x", 10, '"a"', None, fresh),  # nothing strictly before
        (12, "http://e.org/p", 11, 'W/"a"', None, fresh), (13, "http://e.org/p", 20, '"a"', None, fresh),
        (14, "http://e.org/p", 500, '"a"', None, fresh), (15, "http://e.org/p", 500, '"c"', None, None), (16, "http://e.org/q", 9, None, "t4", fresh),
        (17, "http://e.org/q", 9, None, None, fresh), (18, "http://e.org/q", 9, '"a"', "t4", fresh), (19, None, 9, '"a"', None, fresh),
        (20, "http://e.org/p", None, '"a"', None, fresh), (12, "http://e.org/p", 11, 'W/"a"', None, fresh),
    ]
    found = warc.resolve(spark.createDataFrame(responses, RESPONSES), spark.createDataFrame(revisits, REVISITS), slot).collect()
    assert len(found) == len(revisits)
    got = {r.record_id: (r.state, r.response_id) for r in found}
    assert got == {
        11: ("missing", None), 12: ("resolved", 1), 13: ("resolved", 1), 14: ("changed", 3), 15: ("resolved", 3), 16: ("resolved", 4),
        17: ("unproven", 4), 18: ("changed", 4), 19: ("missing", None), 20: ("missing", None),
    }
    merged = {r.record_id: r.merged_headers for r in found}
    assert merged[12] == {"content-length": "9", "date": "now", "etag": '"a"', "x": "2"} and merged[15] == h and merged[14] is None
    assert merged[16] == {"date": "now", "x": "2"}


def test_a_burst_on_one_url_and_rows_without_one_are_spread(spark):
    n = 3000
    responses = [(i, "http://e.org/p", 100 + i % 3, f'"{i}"', None, f"d{i}", None) for i in range(n)]
    revisits = [(n + i, None if i % 2 else "http://e.org/p", 101 + i % 5, None, None, None) for i in range(n)]
    found = warc.resolve(spark.createDataFrame(responses, RESPONSES), spark.createDataFrame(revisits, REVISITS))
    got = {r.record_id: r.response_id for r in found.collect()}
    last = {t: max(i for i in range(n) if i % 3 == t) for t in range(3)}
    assert got == {n + i: None if i % 2 else last[min(2, i % 5)] for i in range(n)}
    # no window meets a row without a URL, or more than one row for a second
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by(" in plan[plan.rindex("Window ["):] and "isnotnull" in plan[plan.rindex("Window ["):]


def test_columns_of_clashing_names(spark):
    responses = spark.createDataFrame([(1, "http://e.org", 1, '"a"', None, "d", None)], RESPONSES).withColumn("found", F.lit(1)).withColumn("slot", F.lit(2))
    revisits = spark.createDataFrame([(2, "http://e.org", 5, '"a"', None, None)], REVISITS).withColumn("key", F.lit("x")).withColumn("t", F.lit(3))
    assert [(r.state, r.response_id) for r in warc.resolve(responses, revisits).collect()] == [("resolved", 1)]


def test_empty_tables(spark):
    none, visit = spark.createDataFrame([], RESPONSES), spark.createDataFrame([(1, "http://e.org", 1, None, None, None)], REVISITS)
    assert [r.state for r in warc.resolve(none, visit).collect()] == ["missing"]
    assert warc.resolve(none, visit.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_report_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    found = warc.report(spark.read.parquet(f"{folder}/pages.parquet"))
    expected = con.execute(warc.ORACLE)
    names = [d[0] for d in expected.description]
    assert sorted(map(str, map(tuple, found.select(*names).collect()))) == sorted(map(str, expected.fetchall()))
