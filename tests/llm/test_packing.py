import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortkit.llm import packing as P

JSON = public_tokenizers.path("byte_bpe_50k.json")


def first_fit_plain(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b in bins:
            if sum(sizes[j] for j in b) + sizes[i] <= capacity:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    assert P.first_fit_decreasing(sizes, 64) == first_fit_plain(sizes, 64)


@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_id_lies_in_one_piece(lengths):
    seen = {d: [] for d in range(len(lengths))}
    for seq in P.pack_lengths(lengths, 64):
        assert 0 < sum(p[2] for p in seq) <= 64
        for d, s, n in seq:
            seen[d] += range(s, s + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(lengths))


def tokenizer_ids(texts):
    tok = Tokenizer.from_file(JSON)
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@settings(deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ranks_give_the_tokenizers_ids(texts):
    assert P.encoder(JSON)(texts) == tokenizer_ids(texts)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a word", "<", "|>", "é"]), max_size=12))
def test_added_tokens_in_a_text_give_their_ids(parts):
    text = "".join(parts)
    assert P.encoder(JSON)([text]) == tokenizer_ids([text])


def test_an_added_token_is_one_id():
    assert P.encoder(JSON)(["<|endoftext|>"]) == [[50256]]


def test_equal_rows_are_dealt_over_groups(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("7L AS doc_id", "'the same text' AS text")
    out = P.pack(rows, JSON, group_docs=500).selectExpr("sequence_id >> 32 AS g", "length", "doc_tokens", "start").collect()
    per = {}
    for r in out:
        per[r["g"]] = per.get(r["g"], 0) + (r["start"] == 0)
    assert sum(per.values()) == 4000 and len(per) == 8 and max(per.values()) < 700


def check(rows, out, texts):
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append([*tokenizer_ids([t or ""])[0], 0])
    got, seqs, padding = {}, {}, 0
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    for d, docs in ids.items():
        if len(docs) > 1:
            continue
        x, at = np.array(docs[0], "<u4"), 0
        for r in sorted(got[d, len(x)], key=lambda r: r["start"]):
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(x[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    total = sum(len(x) for docs in ids.values() for x in docs)
    assert sum(r["length"] for r in out) == total
    return padding / max(1, total)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twin"), (3, "twin"), (4, "word " * 60000), (5, "<|endoftext|> é 日本\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    out = P.pack(df, JSON, group_docs=3).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, out, rows)
    assert sorted(r["doc_tokens"] for r in out if r["doc_id"] in (1, 2)) == [1, 1]
    assert P.pack(df.limit(0), JSON).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = P.op1_packing(spark, sf).collect()
    assert check(rows, out, rows) < 0.005
    again = {tuple(r) for r in P.op1_packing(spark, sf).collect()}
    assert again == {tuple(r) for r in out}
