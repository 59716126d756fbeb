import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import quality_rules as R

DDL = "doc_id long, text string, lang string"
SPACE = "[\x20\x09-\x0D]"


def plain(text):
    words = [w for w in re.split(SPACE + "+", text or "") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures_match_a_plain_version(spark):
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a", "one two three four five", "a b c d e a b c d e", "x " * 40, "é ü\x0bß\x0c日本 #$|",
             "l\nl\n l\n\nl", "\r\nq\r\nq", "a b c d e f a b c d e b c d e f"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in R.measure(spark.createDataFrame(rows, DDL)).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert tuple(out[i][c] for c in R.BASE) == want, t
        assert out[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_binomial_cdf_is_exact(spark):
    cases = [(k, n, p) for p in (0.05, 0.01) for n in (1, 10, 90, 500, 20000, 400000) for k in (0, 1, 3, int(n * p * 0.7), int(n * p))
             if k <= n]
    for p in (0.05, 0.01):
        rows = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(rows, "k long, n long").select("k", "n", R.binomial_cdf(F.col("k"), F.col("n"), p).alias("c"))
        for r in df.distinct().collect():
            k, n = r["k"], r["n"]
            if k >= n * p:
                assert r["c"] == 1.0
                continue
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                      + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert r["c"] == pytest.approx(want, rel=1e-7)


def corpus(n, bad_every=5, noise=0.0, lang="en"):
    rng = random.Random(n)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(40)]
        bad = i % bad_every == 0
        if bad or rng.random() < noise:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def judged(spark, rows, labels, **kw):
    docs = spark.createDataFrame(rows, DDL).withColumn("n_words", F.lit("clash")).withColumn("level", F.lit(1))
    return R.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **kw).collect()


def test_certified_strata_reject_and_others_keep(spark):
    rows, labels = corpus(800)
    few, few_labels = corpus(60, lang="xx")
    rows += [(10_000 + i, t, x) for i, t, x in few]
    labels += [(10_000 + i, q, z) for i, q, z in few_labels]
    labels += [(1, 1, 0), (None, 0, 0), (2, None, 0), (99_999, 0, 0)]
    out = {r["_row"]["doc_id"]: r for r in judged(spark, rows, labels)}
    assert all(out[i]["kept"] == (i % 5 != 0) for i in range(800))
    assert all(r["kept"] and r["level"] is None for i, r in out.items() if i >= 10_000)
    assert out[0]["_row"]["n_words"] == "clash"


def test_no_level_is_certified_when_good_documents_look_bad(spark):
    rows, labels = corpus(800, noise=0.3)
    docs = spark.createDataFrame(rows, DDL)
    table = R.thresholds(R.measure(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in table:
        assert not r["certified"] or r["k"] <= R.ALPHA * r["n"]
    used = [r for r in table if r["used"]]
    assert all(r["certified"] for r in used)


def test_edge_rows_and_empty_tables(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, None, None), (2, "", "en"), (None, ten, None), (4, ten, "en"), (4, ten, "en"), (5, "word " * 50_000, None)]
    out = judged(spark, rows, [(4, 1, 0)])
    assert sorted((str(r["_row"]["doc_id"]), r["kept"]) for r in out) == [
        ("1", False), ("2", False), ("4", True), ("4", True), ("5", False), ("None", True)]
    docs = spark.createDataFrame(rows, DDL)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sum(r["kept"] for r in R.judge(docs, none).collect()) == 3
    assert R.judge(docs.limit(0), none).collect() == []


def test_registered_query_matches_its_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    want = con.execute(R.OP2_SQL)
    names = [d[0] for d in want.description]
    got = R.op2_quality_rules(spark, path)
    assert got.columns == names
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert any(not r["kept"] and not r["base_failed"] for r in rows)
