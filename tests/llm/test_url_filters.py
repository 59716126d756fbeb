import datetime as dt

import duckdb
from pyspark.sql import functions as F

from cohortkit.llm import url_filters as U

CHANGES = "list string, allows int, pattern string, action string, day date"
D = lambda n: dt.date(2024, 1, n)


def test_validity_and_precedence(spark):
    changes = spark.createDataFrame([
        ("block", 0, "bad.com", "add", D(5)), ("block", 0, "bad.com", "drop", D(10)), ("block", 0, "bad.com", "add", D(20)),
        ("block", 0, "bad.com", "add", D(5)),                                                # repeated
        ("allow", 1, "sub.bad.com/ok", "add", D(1)), ("allow", 1, "sub.bad.com/ok", "drop", D(8)),
        ("block", 0, "same.com", "add", D(3)), ("block", 0, "same.com", "drop", D(3)),       # same day: dropped
        ("block", 0, "tie.com", "add", D(1)), ("allow", 1, "tie.com", "add", D(2)),
        (None, 0, "bad.com", "add", D(1)), ("block", 0, None, "add", D(1)), ("block", 0, "bad.com", None, D(1)),
        ("block", 0, "bad.com", "add", None)], CHANGES)
    captures = spark.createDataFrame([
        (1, "https://sub.bad.com/ok/page?q=1", D(6)), (2, "https://sub.bad.com/ok/page", D(8)),
        (3, "http://user@SUB.bad.com:80/okay", D(6)), (4, "http://bad.com", D(4)), (5, "http://bad.com", D(5)),
        (6, "http://bad.com", D(9)), (7, "http://bad.com", D(10)), (8, "http://bad.com", D(31)), (9, "http://notbad.com", D(6)),
        (10, "http://same.com/", D(3)), (11, "http://tie.com/", D(1)), (12, "http://tie.com/", D(2)), (13, None, D(6)),
        (14, "", D(6)), (15, "no url", D(6)), (16, "http://bad.com", None), (6, "http://bad.com", D(9)),
        (17, "http://" + "a." * 60 + "bad.com/" + "x/" * 3000, D(6))], "page_id int, url string, fetched date")
    captures = captures.withColumn("host", F.lit("clash")).withColumn("rid", F.lit("clash"))
    out = {}
    for r in U.decide(captures, changes).collect():
        out.setdefault(r["_row"]["page_id"], []).append((r["kept"], r["list"]))
        assert r["_row"]["host"] == "clash"
    assert {k: v[0] for k, v in out.items()} == {
        1: (True, "allow"), 2: (False, "block"), 3: (False, "block"), 4: (True, None), 5: (False, "block"), 6: (False, "block"),
        7: (True, None), 8: (False, "block"), 9: (True, None), 10: (True, None), 11: (False, "block"), 12: (True, "allow"),
        13: (False, None), 14: (False, None), 15: (False, None), 16: (True, None), 17: (False, "block")}
    assert len(out[6]) == 2
    assert U.decide(captures.limit(0), changes).collect() == []
    assert all(r["list"] is None for r in U.decide(captures, changes.limit(0)).collect())


def test_very_long_urls_take_linear_time(spark):
    import time
    changes = spark.createDataFrame([("block", 0, "bad.com", "add", D(1)), ("allow", 1, "bad.com/x/x/x", "add", D(1)),
                                     ("block", 0, "one", "add", D(1))], CHANGES)
    captures = spark.createDataFrame([(1, "http://bad.com/" + "x/" * 60_000, D(2)), (2, "http://" + "a." * 40_000 + "bad.com/", D(2)),
                                      (3, "http://one/", D(2)), (4, "http://a.one/", D(2))], "page_id int, url string, fetched date")
    began = time.time()
    got = {r["_row"]["page_id"]: r["pattern"] for r in U.decide(captures, changes).collect()}
    assert got == {1: "bad.com/x/x/x", 2: "bad.com", 3: "one", 4: None} and time.time() - began < 40


def test_registered_query_matches_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet'")
    want = con.execute(U.OP6_SQL)
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=str)
    got = U.op6_url_filters(spark, path)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[3] for r in want) and any(not r[-1] for r in want)
