"""Line de-duplication on shingles at every character of every line."""

import random

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import line_dedup as L

from .test_simhash import brute


def full_shingles(line, chars=9):
    return {line[i:i + chars] for i in range(max(1, len(line) - chars + 1))}


def brute_kept(rows):
    """{doc_id: kept line numbers} for rows in the order of their ids, comparing every pair of different lines."""
    first = {}
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (d, i))
    lines = list(first)
    sets = [full_shingles(x) for x in lines]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 10 * len(a & b) >= 8 * len(a | b)]
    roots = brute(links)
    out = {d: [] for d, _ in rows}
    for i, line in enumerate(lines):
        if roots.get(i, i) == i:
            out[first[line][0]].append(first[line][1])
    return {d: sorted(k) for d, k in out.items()}


def kept(spark, rows):
    return {r["doc_id"]: r["kept"] for r in L.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lines_that_differ_past_the_start_of_their_words_stay(spark):
    rows = list(enumerate(["Source: https://www.alpha.org/report", "Source: https://www.zeta-news.net/other/page",
                           "日本語のとても長い一行の文章です\r", "日本語のとても長い別の文で、後は何もかも違います\r",
                           "order 1000000001234567890", "order 1000000009876543210"]))
    assert kept(spark, rows) == {d: [0] for d, _ in rows} == brute_kept(rows)


@pytest.mark.parametrize("line", ["a", "nine char", "ten  chars", "x" * 64, "ab cd " * 24, "é😀 ß\r" * 61,
                                  "".join(map(chr, range(97, 97 + 72))), "".join(map(chr, range(97, 97 + 73))),
                                  "".join(map(chr, range(0x4E00, 0x4E00 + 1000)))])
def test_shingles_are_taken_at_every_character(spark, line):
    row = spark.createDataFrame([(line,)], "line string").select(L.shingle_set(F.col("line")).alias("s")).first()
    want = spark.createDataFrame([(s,) for s in full_shingles(line)], "s string").select(F.xxhash64(F.encode("s", "UTF-32")).alias("h"))
    assert sorted(row["s"]) == sorted(r["h"] for r in want.collect())


def test_near_copies_match_brute_force_on_full_shingles(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 14))) for _ in range(300)]
    base, rows = [rng.choice(vocab) for _ in range(40)], []
    for d in range(60):
        copy = base.copy()
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(40)] = rng.choice(vocab)
        rows.append((d, "\n".join([" ".join(copy), " ".join(rng.choice(vocab) for _ in range(15)), "hot line of every text"])))
    assert kept(spark, rows) == brute_kept(rows)


def test_similarity_of_exactly_the_threshold_links(spark):
    """Whole numbers decide: 28 of 35 common shingles are 0.8, 27 of 35 are not."""
    rows = [(common, a, b) for union in range(5, 400, 5) for common in (union * 4 // 5, union * 4 // 5 - 1)
            for a in (common, common + (union - common) // 2) for b in (union + common - a,)]
    sets = spark.createDataFrame(rows, "common int, a int, b int").select(
        "*", F.expr("sequence(1, a)").alias("x"), F.expr("sequence(a - common + 1, a - common + b)").alias("y"))
    got = sets.select("common", "a", "b", L.is_similar(F.col("x"), F.col("y"), "a", "b", 0.8).alias("is"), L.sizes_allow("a", "b", 0.8).alias("may"))
    for r in got.collect():
        want = 10 * r["common"] >= 8 * (r["a"] + r["b"] - r["common"])
        assert r["is"] == want and (r["may"] or not want), r


def test_lines_at_exactly_the_threshold_across_components_link(spark):
    """28 of 35 shingles in common; a and b share a band but no component yet."""
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 43)))
    lines = spark.createDataFrame([(1, text[:40], 32), (2, text[4:], 31)], "k1 long, line string, size int")
    live = spark.createDataFrame([(7, 1, 32, [7], 0.5, 1), (7, 2, 31, [7], 1.5, 2)],
                                 "band long, k1 long, size int, bands array<long>, turn double, root long")
    assert len(full_shingles(text[:40]) & full_shingles(text[4:])) == 28
    pairs = L.hub_pairs(live, 0, 4, 0.8)
    assert [tuple(r) for r in pairs.collect()] == [tuple(r) for r in L.links_of(pairs, lines, 0.8).collect()] == [(1, 2, 1, 2)]
    assert L.hub_pairs(live, 1, 4, 0.8).collect() == []            # the second line's turn: its pair is done
    assert L.hub_pairs(live.withColumn("root", F.lit(1)), 0, 4, 0.8).collect() == []


def test_a_pair_is_compared_in_its_first_band_only(spark):
    rows = [(b, k, 30, [3, 5], k + 0.1 * b, k) for b in (3, 5) for k in (1, 2, 3)]
    live = spark.createDataFrame(rows, "band long, k1 long, size int, bands array<long>, turn double, root long")
    assert sorted(map(tuple, L.hub_pairs(live, 0, 9, 0.8).select("a", "b").collect())) == [(1, 2), (1, 3), (2, 3)]


def test_roots_are_carried_on(spark):
    ddl = "node long, root long"
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], ddl)
    merged = spark.createDataFrame([(1, 1), (5, 1), (9, 1), (20, 20), (21, 20)], ddl)
    assert sorted(map(tuple, L.followed(roots, merged).collect())) == [(1, 1), (2, 1), (5, 1), (6, 1), (9, 1), (20, 20), (21, 20)]


def test_chains_that_join_over_several_rounds_match_brute_force(spark, monkeypatch):
    """One hub a round at first, so that components merge round by round."""
    monkeypatch.setattr(L, "FIRST_HUBS", 1)
    monkeypatch.setattr(L, "MORE_HUBS", 2)
    rng = random.Random(21)
    letters, text, rows = "abcdefghijklmnopqrstuvwxyz ", [], []
    text = [rng.choice(letters) for _ in range(120)]
    for d in range(90):
        text[rng.randrange(120)] = rng.choice(letters)
        if d % 30 == 29:
            text = [rng.choice(letters) for _ in range(120)]
        rows.append((d, "".join(text) + "."))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert kept(spark, rows) == brute_kept(rows)


def test_bands_find_pairs_at_the_threshold(spark):
    """Recall of the signatures alone over pairs with a similarity of 0.8 to 0.81, of many sizes."""
    rng, rows = random.Random(12), []
    letters = "abcdefghijklmnopqrstuvwxyz  "
    while len(rows) < 1200:
        n = rng.choice([12, 25, 60, 150, 400])
        a = "".join(rng.choice(letters) for _ in range(n))
        cut = rng.randrange(1, n)
        b = a[:cut] + rng.choice(letters) * rng.randrange(0, 1 + n // 6) + a[cut + rng.randrange(0, 2):]
        sa, sb = full_shingles(a), full_shingles(b)
        if 0.8 <= len(sa & sb) / len(sa | sb) <= 0.83:
            rows += [(2 * len(rows), a), (2 * len(rows) + 1, b)]
    df = spark.createDataFrame([(k, k, t) for k, t in rows], "k1 long, k2 long, line string")
    bands = {}
    for r in L.banded(df).collect():
        bands.setdefault(r["k1"], set()).add(r["band"])
    missed = sum(not bands[k] & bands[k + 1] for k, _ in rows[::2])
    assert missed <= 0.012 * len(rows) / 2, missed


def test_minima_of_neighbouring_shingles_are_those_of_every_shingle(spark):
    """Bands from runs of shingles are the bands of plain minima, at every length around a run's end."""
    rng = random.Random(31)
    some = lambda n: "".join(rng.choice("abcdefgh é😀日") for _ in range(n))
    rows = [(k, -k, some(n)) for k, n in enumerate([1, 8, 9, 10, *range(14, 28), 72, 73, 300, 2000])]
    df = spark.createDataFrame(rows, "k1 long, k2 long, line string")
    each = df.select("k1", F.explode(L.shingles(F.col("line"))).alias("h")).select("k1", "h", L.part_of(F.col("h"), 24).alias("p"))
    least = {(r["k1"], r["p"]): r["h"] for r in each.groupBy("k1", "p").agg(F.min("h").alias("h")).collect()}
    plain = [(k, b, [least.get((k, 3 * b + r), r) for r in range(3)]) for k, _, _ in rows for b in range(8)
             if any((k, 3 * b + r) in least for r in range(3))]
    want = spark.createDataFrame(plain, "k1 long, b long, m array<long>").select(
        "k1", F.xxhash64("b", F.col("m")[0], F.col("m")[1], F.col("m")[2]).alias("band"))
    assert sorted(map(tuple, L.banded(df).select("k1", "band").collect())) == sorted(map(tuple, want.collect()))


def test_only_lines_of_bands_with_many_lines_get_sketches(spark, monkeypatch):
    """Pairs of small bands meet by key; near copies of few lines need no sketch and no hubs."""
    rng, rows, made = random.Random(33), [], []
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for g in range(12):
        base = some(150)
        rows += [(3 * g + i, base[:75] + x + base[75:]) for i, x in enumerate(("", "Q", "RS"))]
    head = some(400)
    rows += [(100 + i, head[:20 * i] + "Z" + head[20 * i + 1:]) for i in range(18)]
    sketches = L.sketches
    monkeypatch.setattr(L, "sketches", lambda lines, *a: made.append(lines.count()) or sketches(lines, *a))
    assert kept(spark, rows) == brute_kept(rows)
    assert len(made) == 1 and 0 < made[0] <= 18


def test_every_pair_of_a_small_band_is_given_once(spark):
    of = "array<struct<band: long, n: long>>"
    lines = spark.createDataFrame([(1, [(7, 3), (8, 2)]), (2, [(7, 3), (8, 2)]), (3, [(7, 3), (9, 50)]), (4, [(9, 50)])], f"k1 long, of {of}")
    assert sorted(map(tuple, L.small_pairs(lines, 8).collect())) == [(1, 2, 1, 2), (1, 3, 1, 3), (2, 3, 2, 3)]


def test_arrays_with_repeats_are_compared_as_sets(spark):
    """At and just under the threshold, with elements of either side repeated up to three times."""
    rng, rows = random.Random(35), []
    for union in range(5, 105, 5):
        for common in (union * 4 // 5, union * 4 // 5 - 1):
            for more in (0, 1, 30, 2 * union):
                cut = rng.randrange(union - common + 1)
                x, y = list(range(common + cut)), list(range(common)) + list(range(common + cut, union))
                rows.append((10 * common >= 8 * union, x + rng.choices(x, k=more) if x else x, y + rng.choices(y, k=more // 2) if y else y))
    df = spark.createDataFrame(rows, "want boolean, x array<long>, y array<long>")
    got = df.select("want", L.are_similar(F.col("x"), F.col("y"), 0.8).alias("is"), L.are_similar(F.col("y"), F.col("x"), 0.8).alias("turned"))
    assert all(r["is"] == r["turned"] == r["want"] for r in got.collect())
