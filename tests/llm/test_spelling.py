import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from cohortkit.llm import spelling as S


def distance_is_one(a, b):
    """By the table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def plain(n):
    """{word: (form, root, n, n_near, form_n)} by looking at all pairs."""
    out, form = {}, {}
    for w in n:
        near = [x for x in n if distance_is_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if near and n[best] >= 10 * n[w] else None
        out[w] = (form[w], w, n[w], len(near), n[best] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w][2:])
    return out


def plain_vocabulary(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def mutated(rng, w, letters):
    for _ in range(rng.choice([1, 1, 1, 2])):
        i = rng.randrange(len(w))
        w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + w[i:][::-1]])
    return w


def made_words(rng, size):
    letters = "abcdeeeiinnrstzéß×É"
    n = {}
    while len(n) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        for _ in range(rng.randrange(8)):
            n[w] = rng.choice([2, 3, 20, 200, 2000, 30])
            w = mutated(rng, w, letters)
    n |= {"ab" * 60: 4, "ab" * 60 + "c": 40, "ab" * 30 + "x" + "ab" * 30: 400, "ab" * 33: 2, "ab" * 31 + "b" + "ab" * 2: 20,
          "a" * 300: 2, "a" * 301: 20, "a" * 302: 200, "a" * 299: 2000}
    return n


def result(spark, n, **options):
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    return {r["word"]: tuple(r)[1:] for r in S.variants(words, **options).collect()}


def test_words_match_all_pairs_whatever_the_cells(spark):
    n = made_words(random.Random(2), 500)
    want = plain(n)
    assert any(w[0] and w[1] != w[0] for w in want.values())
    assert result(spark, n) == want
    assert result(spark, n, cell_words=40) == want


def test_crowded_vectors_are_dealt_to_blocks(spark):
    rng = random.Random(7)
    n = {"".join(rng.sample("eeaaiinnrt", 10)): rng.choice([2, 30]) for _ in range(300)} | {"bcdfgbcdfg": 9}
    assert result(spark, n, cell_words=25) == plain(n)


def test_walk_leaves_no_neighbour_out():
    rng = random.Random(1)
    words = list(made_words(rng, 300))
    cell = S.Cell(words, np.ones(len(words), np.int64))
    reached = {(int(a), int(b)) for x, y in cell.reached(S.vectors(words)) for a, b in zip(x, y)}
    text = S.Text(words)
    x, y = np.divmod(np.arange(len(words) ** 2), len(words))
    ok = S.near(text, x, text, y)
    for i, (a, b) in enumerate(zip(x, y)):
        assert ok[i] == distance_is_one(words[a], words[b]) == S.one_edit(words[a], words[b])
        assert not ok[i] or (a, b) in reached


def test_words_of_edge_documents(spark):
    rows = [(None, "Variante variante VARIANTE"), (1, None), (1, ""), (2, "short six666 naïveté naïveté NAÏVETÉ"), (2, "variante"),
            (3, "x" * 5000 + " " + "x" * 5000), (3, "x" * 5000), (4, " ".join(["receive", "recieve", "receives", "receivee"] * 20)), (4, "seven77letters letters")]
    rows += [(i, "Variante receive überall Überall") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "doc_id AS n")
    got = {r["word"]: r["n"] for r in S.vocabulary(docs, S.DAMAGE).collect()}
    assert got == plain_vocabulary(rows)
    assert {r["word"]: tuple(r)[1:] for r in S.variants(S.vocabulary(docs, S.DAMAGE)).collect()} == plain(got)
    assert S.variants(S.vocabulary(docs.limit(0))).collect() == []


def test_registered_query_matches_its_sql_and_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = con.execute(S.OP11_SQL)
    names = [d[0] for d in want.description]
    got = S.op11_spelling(spark, path)
    assert got.columns == names
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    n = plain_vocabulary(con.execute("select doc_id, text from documents").fetchall())
    assert {r[0]: r[3] for r in rows} == n
    some = sorted(n)[::25]
    for w in some:
        near = [x for x in n if abs(len(x) - len(w)) < 2 and distance_is_one(w, x)]
        assert [r[4] for r in rows if r[0] == w] == [len(near)]
