import corpus_pipeline as CP
from cohortkit.llm import simhash

from .test_line_dedup import brute_kept
from .test_packing import check
from .test_simhash import brute, links_brute, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in CP.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns == COLUMNS

    # quality rules: a subset, texts unchanged, clean documents of the labels stay
    before, after = map(rows, seen["quality rules"])
    assert set(after) < set(before)
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    long = {d for d, t in before if len((t or "").split()) >= 10}
    assert len([d for d, _ in after if d in good & long]) >= 0.9 * len([d for d, _ in before if d in good & long])

    # line dedup: the lines that brute force keeps
    before, after = rows(seen["line dedup"][0]), dict(rows(seen["line dedup"][1]))
    want = brute_kept(before)
    wrong = 0
    for d, t in before:
        kept = set(want[d, t])
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i in kept or not x.split())
        wrong += after[d] != text
    assert len(after) == len(before) and not wrong

    # SimHash: one document of each group
    before, after = map(rows, seen["SimHash near-dedup"])
    ids = sorted(d for d, _ in before)
    fp = {d: plain_fingerprint(t) for d, t in before}
    roots = brute([(ids[a], ids[b]) for a, b in links_brute([fp[d] for d in ids], simhash.MAX_BITS)])
    assert {d for d, _ in after} == {d for d in ids if roots.get(d, d) == d}

    # mixing: words of the texts, each at most twice, near the budget
    before, after = map(rows, seen["mixing"])
    words = {d: len((t or "").encode().split()) for d, t in before}
    taken = {}
    for d, t in after:
        taken[d] = taken.get(d, 0) + len(t.encode().split())
    assert all(n <= 2 * words[d] for d, n in taken.items())
    assert abs(sum(taken.values()) / (1.5 * sum(words.values())) - 1) < 0.02

    # packing: an exact round trip
    out = seen["packing"][1].selectExpr("*", "crc32(ids) as ids_crc32").collect()
    check(rows(seen["packing"][0]), out, rows(seen["packing"][0]))


def test_run_and_empty_input(spark):
    assert CP.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in CP.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_edge_rows_pass_every_stage(spark, tmp_path):
    ten = " ".join(f"word{i}" for i in range(30))
    rows = [(1, ten, "en", "a"), (2, ten, "en", "a"), (2, ten, "en", "a"), (None, ten + " own", None, None), (None, None, None, None),
            (4, None, "en", "b"), (5, "", "de", "b"), (6, "long " + " ".join(f"x{i}" for i in range(60_000)), None, "c"),
            (7, " ".join(f"q{i}" for i in range(40)), "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("rid", "row", "_row", "size", "level", "k1", "component_id", "a.b", "seq"):
        docs = docs.selectExpr("*", f"'kept' as `{name}`")
    names = docs.columns
    for i, (name, stage) in enumerate(CP.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert docs.columns == names
            assert all(r["rid"] == "kept" and r["a.b"] == "kept" for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} == {1, 6, 7}      # the others had no words, or only equal lines
