import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import language_id as L


def test_gradients_match_finite_differences():
    m = L.new_model(["a", "b", "c"], hidden=3)
    m.out, m.bias = m.out.astype(float), m.bias.astype(float)
    m.table, m.recur = tuple(t.astype(float) for t in m.table), tuple(r.astype(float) for r in m.recur)
    rng = np.random.default_rng(1)
    x = rng.integers(97, 102, (7, 4)).astype(np.int16)
    x[5:, 1] = L.PAD
    y = np.array([0, 1, 2, 0])
    _, grads = L.loss_and_gradients(m, x, y)
    for name, w in (("out", m.out), ("bias", m.bias), ("table0", m.table[0]), ("table1", m.table[1]),
                    ("recur0", m.recur[0]), ("recur1", m.recur[1])):
        for _ in range(12):
            i = rng.integers(w.shape[0]), (int(x[rng.integers(5), 0]) if name.startswith("table") else rng.integers(w.shape[1]))
            keep, eps = w[i], 1e-5
            w[i] = keep + eps
            up, _ = L.loss_and_gradients(m, x, y)
            w[i] = keep - eps
            down, _ = L.loss_and_gradients(m, x, y)
            w[i] = keep
            assert abs((up - down) / (2 * eps) - grads[name][i]) < 1e-6


def test_pooling_reads_every_position():
    m = L.new_model(["a", "b"])
    texts = [b"x" * 300, b"", b"hello", b"q" * L.CHUNK]
    data = np.frombuffer(b"".join(texts), np.uint8)
    p = L.document_probabilities(m, data, np.cumsum([0, *map(len, texts)]))
    assert np.allclose(p.sum(axis=1), [1, 0, 1, 1], atol=1e-5)
    alone = L.document_probabilities(m, np.frombuffer(b"hello", np.uint8), np.array([0, 5]))
    assert np.allclose(alone[0], p[2], atol=1e-6)


def test_probabilities_match_a_plain_pass_byte_by_byte():
    """One text at a time, one byte at a time, with the states starting anew every CHUNK bytes."""
    m = L.new_model(["a", "b", "c"], hidden=4)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(piece, d):
        n, h, out = m.recur[d].shape[1], np.zeros(m.recur[d].shape[1]), []
        for b in piece if d == 0 else reversed(piece):
            g, a = m.table[d][:, b].astype(float), m.recur[d].astype(float) @ h
            z, r = sig(g[:n] + a[:n]), sig(g[n:2 * n] + a[n:2 * n])
            h = h + z * (np.tanh(g[2 * n:] + r * a[2 * n:]) - h)
            out.append(h)
        return out if d == 0 else out[::-1]
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, k).tolist()) for k in (1, 5, 127, 128, 129, 400)]
    got = L.document_probabilities(m, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, p in zip(texts, got):
        want = np.zeros(3)
        for at in range(0, len(text), L.CHUNK):
            piece = list(text[at:at + L.CHUNK])
            for f, g in zip(states(piece, 0), states(piece, 1)):
                e = np.exp(m.out.astype(float) @ np.concatenate([f, g]) + m.bias[:, 0])
                want += e / e.sum()
        assert np.allclose(p, want / len(text), atol=1e-4)


def test_numerals_are_no_letters():
    assert [L.has_letter(t) for t in ("", "12 ²½①", "_", "² a", "é", "日", "ʰ")] == [False, False, False, True, True, True, True]


def test_equal_rows_do_not_exceed_the_sample(spark):
    df = spark.range(0, 30_000).selectExpr("2L AS doc_id", "'one text again and again' AS text", "'en' AS lang").unionAll(
        spark.range(100, 3000).selectExpr("id AS doc_id", "concat('ein text ', id) AS text", "'de' AS lang"))
    per = {}
    for _, lang in L.training_sample(df, 50):
        per[lang] = per.get(lang, 0) + 1
    assert per["de"] == 50 and per.get("en", 0) <= 50


def test_edge_rows(spark):
    de, en = "der die und nicht schön über straße ", "the of and with this that there "
    rows = [(i, (de if i % 2 else en) * 8, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "de"), (101, "", "en"), (102, "123 !?", None), (None, de * 3, "xx"), (103, en * 3000, None),
             (104, en, "en"), (104, en, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = L.train(L.training_sample(df), steps=60)
    assert model.langs == ["de", "en"]
    out = {}
    for r in L.predict(df, model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert [out[i][0]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert out[103][0]["lang_pred"] == "en" and out[None][0]["lang_pred"] == "de" and len(out[104]) == 2
    assert all(0 <= r["score"] <= 1 for v in out.values() for r in v)
    assert not out[None][0]["held_out"]
    assert L.train(L.training_sample(df.limit(0))) is None
    assert L.predict(df.limit(1), None).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = L.op7_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
