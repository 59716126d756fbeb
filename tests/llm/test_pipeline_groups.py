import corpus_pipeline as CP


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat, a NULL or shared doc_id, and texts of one doc_id in different groups."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "bravo", "cargo"))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (3, b, "x"), (3, b, "x"), (5, c, "x"), (5, c, "y"), (5, c, "x"),
            (None, c + " more", "z"), (None, "only null ids here " + c[::-1], "z"), (None, "only null ids here " + c[::-1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = CP.near_duplicates(spark, docs, "").collect()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "a.b"}
    texts = [r["text"] for r in got]
    assert len(texts) == len(set(texts)), "equal texts are one group"
    assert {(r["doc_id"], r["text"]) for r in got} >= {(1, a), (2, b), (5, c), (None, rows[-1][1])}
    assert CP.near_duplicates(spark, docs.limit(0), "").collect() == []
