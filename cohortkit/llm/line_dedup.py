"""Fuzzy line de-duplication by MinHash.

A line is a part of a text between line feeds that has a word.  Its shingles are
the runs of ``SHINGLE_CHARS`` characters that begin at each of its characters (the
line itself, if it is shorter).  Lines whose shingle sets have a
Jaccard similarity of ``THRESHOLD`` or more are linked; one line of each
component stays: its first occurrence by (doc_id, line number).

1. Equal lines collapse to one (128 bits of hash) before anything else.
2. Signatures by one permutation: every shingle is hashed once, the hashes' range is
   cut into ``BANDS`` x ``ROWS`` parts, and the least hash in a part is that part's
   minimum.  A band is the hash of ``ROWS`` neighbouring minima; with 8 bands of 3 a pair
   at the threshold shares one with probability 1 - (1 - 0.8^3)^8 = 0.997 or more.
   Lines are sliced in UTF-32, where a character has a fixed width, so a shingle costs the
   same wherever it begins; the minima stay in the partitions that the first step made, and
   ``RUN`` neighbouring shingles meet them as one row.
3. Only lines that share a band with another line go on, with their text, which is
   smaller than its shingles.  The pairs of bands of at most ``FIRST_HUBS`` lines meet by key
   and are compared at once; only lines of larger bands get a sketch.
   A line's sketch is a bitmap with a bit for every shingle, by hash, and at least four bits a
   shingle (up to 2048 shingles), so few shingles fall together.  A bit that one line has and
   another has not stands for at least one shingle that the other has not, so sketches bound
   the shared shingles from above, and a pair whose bound is too low is dropped unread.
4. Links in the larger bands are searched in rounds.  In a band with lines of different components some
   lines, eight at first and 64 times as many each round, are hubs: they are compared
   with the lines of other components, in the first band that both share.  Exact Jaccard
   decides, the links join components, and a band that is whole, or whose lines all were
   hubs, is done.  Every pair of a
   band is compared, or is found connected before its turn, so no link is lost; a large
   group of near copies is connected after a few rounds, at a cost linear in its size.
   Which lines are hubs in a round follows from a hash and the band's count, so nothing is
   sorted or numbered within a band.
5. Components come from alternating stars.

The whole path is DataFrame functions.  Texts cross one shuffle (for step 1);
everything later is hashes, line numbers and the candidates.  Intermediate files are
deleted as soon as they are superseded.

Defined cases: a line of any length is one row and its shingles are whole; a NULL or empty text has no lines and nothing to remove; lines
without a word are not compared and always stay; rows equal in ``doc_id`` and
``text`` are one document and get the same result; a NULL ``doc_id`` comes last
in the order of occurrences; an empty table gives no rows; other columns are not
read (``deduplicated`` passes them on).
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import freed, let, read_table, whole_row, written
from .components import components

SHINGLE_CHARS = 9
THRESHOLD = 0.8
BANDS = 8
ROWS = 3
SEED = 11
RUN = 8                           # shingles of a line that meet its minima together
BLOCK = 8                         # 64-bit words in a block of a line's sketch
SKETCH_BLOCKS = 16                # blocks of a sketch at most
FIRST_HUBS, MORE_HUBS = 8, 64     # hubs of a band in the first round, and how many times as many in each later one


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def wide(line: Column) -> Column:
    """The line in UTF-32: four bytes a character."""
    return F.encode(line, "UTF-32")


def last_start(data: Column, chars: int = SHINGLE_CHARS) -> Column:
    """The byte of a wide line where its last shingle begins, from 1."""
    return F.greatest(F.lit(1), F.octet_length(data) - (4 * chars - 1))


def starts(data: Column, chars: int = SHINGLE_CHARS) -> Column:
    """The bytes of a wide line where its shingles begin, from 1."""
    return F.sequence(F.lit(1), last_start(data, chars), F.lit(4))


def shingle_hash(data: Column, start: Column, chars: int = SHINGLE_CHARS) -> Column:
    return F.xxhash64(F.substring(data, start, F.lit(4 * chars)))


def shingles(line: Column, chars: int = SHINGLE_CHARS) -> Column:
    """The hashes of a line's character shingles, in their order."""
    return let(wide(line), lambda b: F.transform(starts(b, chars), lambda i: shingle_hash(b, i, chars)))


def shingle_set(line: Column, chars: int = SHINGLE_CHARS) -> Column:
    """The hashes of the different character shingles of a line."""
    return F.array_distinct(shingles(line, chars))


def sketch_blocks(n: Column, most: int = SKETCH_BLOCKS) -> Column:
    """Blocks of the sketch of a line with ``n`` shingles: the least power of two with four bits a shingle, up to ``most``."""
    return reduce(lambda w, k: F.when(n * 4 <= 64 * BLOCK * k, F.lit(k)).otherwise(w),
                  [2 ** i for i in reversed(range(most.bit_length() - 1))], F.lit(most))


def sketches(lines: DataFrame, chars: int = SHINGLE_CHARS, most: int = SKETCH_BLOCKS) -> DataFrame:
    """(k1, k2, sketch) for the lines of ``lines(k1, k2, line)``: a bitmap in which every shingle sets the bit that the lowest
    bits of its hash name."""
    data = lines.select("k1", "k2", wide(F.col("line")).alias("data")).withColumn("at", starts(F.col("data"), chars))
    hashed = (data.select("k1", "k2", "data", sketch_blocks(F.size("at"), most).alias("blocks"), F.explode("at").alias("i"))
              .select("k1", "k2", "blocks", shingle_hash(F.col("data"), F.col("i"), chars).alias("h")))
    low = lambda n: F.col("h").bitwiseAND(F.lit(n - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low(64).cast("int"))
    block = F.shiftright("h", 6 + (BLOCK - 1).bit_length()).bitwiseAND((F.col("blocks") - 1).cast("long")).cast("int")
    words = [F.coalesce(F.bit_or(F.when(F.shiftright(low(64 * BLOCK), 6) == w, bit)), F.lit(0).cast("long")) for w in range(BLOCK)]
    own = hashed.groupBy("k1", "k2", "blocks", block.alias("b")).agg(F.array(*words).alias("words"))
    full = F.map_from_entries(F.collect_list(F.struct("b", "words")))
    none = F.array_repeat(F.lit(0).cast("long"), BLOCK)
    return own.groupBy("k1", "k2", "blocks").agg(full.alias("of")).select("k1", "k2", F.flatten(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.coalesce(F.try_element_at("of", b), none))).alias("sketch"))


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n_all, lines: array of (pos, k1, k2)) for every row."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("pos"), F.when(_has_word(x), F.xxhash64(x)).alias("k1"), F.xxhash64(F.lit(SEED), x).alias("k2")))
    return with_row_key(docs.select("doc_id", "text")).withColumn("all", numbered).select(
        "doc_id", "rid", F.size("all").alias("n_all"), F.filter("all", lambda x: x["k1"].isNotNull()).alias("lines"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, line), one row per different line, partitioned by its keys."""
    line = F.explode(F.split("text", "\n")).alias("line")
    return (docs.filter(F.col("text").isNotNull()).select(line).filter(_has_word(F.col("line")))
            .select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(SEED), "line").alias("k2"), "line")
            .dropDuplicates(["k1", "k2"]))


def part_of(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of 64-bit numbers a hash lies in."""
    upper = F.shiftright(h, 32) + F.lit(2**31).cast("long")
    return F.shiftright(upper * F.lit(parts).cast("long"), 32).cast("int")


def banded(lines: DataFrame, bands: int = BANDS, rows: int = ROWS, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(k1, k2, band) for the lines of ``lines(k1, k2, line)``; a band without a minimum gives no row.

    ``RUN`` neighbouring shingles are one row, so that the table of minima is met once for all of them; the last
    shingle of a line fills its last row."""
    data = lines.select("k1", "k2", wide(F.col("line")).alias("data")).withColumn("last", last_start(F.col("data"), chars))
    runs = data.select("k1", "k2", "data", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * RUN))).alias("i"))
    at = [F.least(F.col("i") + 4 * j, F.col("last")) for j in range(RUN)]
    hashed = runs.select("k1", "k2", *[shingle_hash(F.col("data"), at[j], chars).alias(f"h{j}") for j in range(RUN)])
    parted = hashed.select("*", *[part_of(F.col(f"h{j}"), bands * rows).alias(f"p{j}") for j in range(RUN)])
    none = F.lit(2**63 - 1).cast("long")
    least = lambda p: F.min(F.least(*[F.call_function("if", F.col(f"p{j}") == p, F.col(f"h{j}"), none) for j in range(RUN)]))
    minima = parted.groupBy("k1", "k2").agg(*[least(p).alias(f"m{p}") for p in range(bands * rows)])

    def band(b):
        own = [F.col(f"m{b * rows + r}") for r in range(rows)]
        filled = [F.when(m == none, F.lit(r).cast("long")).otherwise(m) for r, m in enumerate(own)]
        return F.when(F.least(*own) < none, F.xxhash64(F.lit(b).cast("long"), *filled))
    return minima.select("k1", "k2", F.explode(F.array(*[band(b) for b in range(bands)])).alias("band")).filter("band IS NOT NULL")


def sharing(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(k1, k2, line, of: array of (band, n)) of the lines that share a band; n > 1 lines have it."""
    lines = distinct_lines(docs)
    # one exchange by band; the window's frame is a count, so a band's rows stream through (and spill) unsorted
    n = F.count(F.lit(1)).over(W.partitionBy("band"))
    found = (banded(lines, bands, rows, chars).withColumn("n", n).filter("n > 1").groupBy("k1", "k2")
             .agg(F.collect_list(F.struct("band", "n")).alias("of")))
    # both sides are dealt by the keys that the exchange of the distinct lines made, and share it
    return written(lines.join(found, ["k1", "k2"]).select("k1", "k2", "line", "of"), "line-banded")


def sketched(lines: DataFrame, least: int = 2, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(k1, line, size of the shingle set, bands, sketch) of the lines of ``sharing`` in bands of at least ``least`` lines."""
    bands = F.sort_array(F.transform(F.filter("of", lambda x: x["n"] >= least), lambda x: x["band"]))
    some = written(lines.select("k1", "k2", "line", bands.alias("bands")).filter(F.size("bands") > 0), "line-some")
    out = written(some.join(sketches(some, chars), ["k1", "k2"]).select(
        "k1", "line", F.size(shingle_set(F.col("line"), chars)).alias("size"), "bands", "sketch"), "line-candidates")
    freed(some)
    return out


def candidates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(k1, line, size of the shingle set, bands shared with another line, sketch) of the lines that share any."""
    lines = sharing(docs, bands, rows, chars)
    out = sketched(lines, chars=chars)
    freed(lines)
    return out


def members_of(lines: DataFrame) -> DataFrame:
    """(band, k1, size, bands, sketch, n, turn, root) of the candidates; a line's turn in a band of n lines is even over
    0 .. n, by hash."""
    each = lines.select(F.explode("bands").alias("band"), "k1", "size", "bands", "sketch")
    counts = lines.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    turn = (F.xxhash64("band", "k1").cast("double") / 2.0 ** 64 + 0.5) * F.col("n")
    return each.join(counts, "band").select("band", "k1", "size", "bands", "sketch", "n", turn.alias("turn"), F.col("k1").alias("root"))


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a ratio of whole numbers, as it is written: 0.8 is 4 / 5."""
    return Fraction(str(threshold)).as_integer_ratio()


def reaches(common: Column, n: Column, threshold: float) -> Column:
    """Is the Jaccard of two sets with ``n`` elements in all and ``common`` of them shared at
    least the threshold?  |A & B| / |A | B| >= p / q is |A & B| (p + q) >= p (|A| + |B|), in
    whole numbers."""
    p, q = ratio(threshold)
    return common.cast("long") * F.lit(p + q).cast("long") >= n.cast("long") * F.lit(p).cast("long")


def sizes_allow(a, b, threshold: float) -> Column:
    """Can sets of these sizes reach the threshold?"""
    return reaches(F.least(a, b), F.col(a) + F.col(b), threshold)


def sketches_allow(a, b, size_a, size_b, threshold: float) -> Column:
    """Can sets of these sketches and sizes reach the threshold?  Never false for sets that do.  Of sketches with different
    numbers of words the longer one is folded to the shorter one's, which is the sketch it would have had at that length."""
    def folded(x, to):
        whole = F.sequence(F.lit(0), F.size(to) - 1)
        return F.when(F.size(x) <= F.size(to), x).otherwise(F.transform(whole, lambda i: F.aggregate(
            F.sequence(i, F.size(x) - 1, F.size(to)), F.lit(0).cast("long"), lambda v, j: v.bitwiseOR(F.get(x, j)))))

    def left(x, y):
        return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))),
                           F.lit(0), lambda total, n: total + n)
    a, b, both = F.col(a), F.col(b), F.col(size_a) + F.col(size_b)
    return reaches(F.col(size_a) - left(a, b), both, threshold) & reaches(F.col(size_b) - left(b, a), both, threshold)


def is_similar(a: Column, b: Column, size_a, size_b, threshold: float) -> Column:
    """Exact Jaccard of the different elements of two arrays, whose numbers are known."""
    return reaches(F.size(F.array_intersect(a, b)), F.col(size_a) + F.col(size_b), threshold)


def are_similar(a: Column, b: Column, threshold: float) -> Column:
    """Exact Jaccard of the different elements of two arrays; each array is made once.  With n elements in all, repeats
    included, at most n less those of the union are shared, which spares most pairs the intersection."""
    def enough(s, union):
        may = reaches(F.size(s["a"]) + F.size(s["b"]) - union, F.size(s["a"]) + F.size(s["b"]), threshold)
        return may & let(F.size(F.array_intersect(s["a"], s["b"])), lambda common: reaches(common, union + common, threshold))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(F.size(F.array_union(s["a"], s["b"])), lambda union: enough(s, union)))


def links_of(pairs: DataFrame, lines: DataFrame, threshold: float, chars: int = SHINGLE_CHARS) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose lines have similar shingle sets."""
    side = lambda x: lines.select(F.col("k1").alias(x), F.col("line").alias(f"line_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(are_similar(shingles(F.col("line_a"), chars), shingles(F.col("line_b"), chars), threshold)).select(*pairs.columns)


def small_pairs(lines: DataFrame, most: int) -> DataFrame:
    """(a, b, root_a, root_b): every pair of lines of ``sharing`` in a band of at most ``most`` lines, once."""
    members = (lines.select("k1", F.explode("of").alias("x")).filter(F.col("x.n") <= most)
               .groupBy("x.band").agg(F.sort_array(F.collect_set("k1")).alias("of")))
    later = members.select(F.posexplode("of").alias("i", "a"), "of").select("a", F.expr("slice(of, i + 2, size(of))").alias("later"))
    return later.select("a", F.explode("later").alias("b")).distinct().select(
        "a", "b", F.col("a").alias("root_a"), F.col("b").alias("root_b"))


def hub_pairs(live: DataFrame, low: int, high: int, threshold: float) -> DataFrame:
    """(a, b, root_a, root_b): the lines whose turn as a hub comes in this round, with the lines of their bands
    that they may be similar to and are not yet connected with; ``live`` may have no sketches."""
    hubs = live.filter((F.col("turn") >= low) & (F.col("turn") < high)).alias("h")
    first = F.array_min(F.array_intersect("h.bands", "x.bands"))
    allowed = sizes_allow("h.size", "x.size", threshold) & (first == F.col("h.band"))
    if "sketch" in live.columns:                     # the dearest test comes last
        allowed = allowed & sketches_allow("h.sketch", "x.sketch", "h.size", "x.size", threshold)
    return hubs.join(live.alias("x"), (F.col("h.band") == F.col("x.band")) & (F.col("h.root") != F.col("x.root"))
                     & (F.struct("h.turn", "h.k1") < F.struct("x.turn", "x.k1")) & allowed).select(
                         F.col("h.k1").alias("a"), F.col("x.k1").alias("b"),
                         F.col("h.root").alias("root_a"), F.col("x.root").alias("root_b"))


def torn_members(members: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows of ``members`` with the roots that ``merged(node, root)`` gives their present ones, of the bands
    that still hold more than one component."""
    members = members.withColumnRenamed("root", "old").join(merged, F.col("old") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "old")).drop("old", "node")
    torn = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    return members.join(torn, "band", "left_semi")


def followed(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root): ``roots`` carried on by ``merged``, which joins its roots and lines that had no link yet."""
    moved = roots.alias("r").join(merged.alias("m"), F.col("r.root") == F.col("m.node"), "left").select(
        "r.node", F.coalesce("m.root", "r.root").alias("root"))
    return moved.unionAll(merged.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                  chars: int = SHINGLE_CHARS) -> DataFrame:
    """(node, root) over the keys of different lines that are linked."""
    lines = sharing(docs, bands, rows, chars)
    large = sketched(lines, FIRST_HUBS + 1, chars)
    live = written(members_of(large), "line-live")
    freed(large)
    roots, low, hubs = None, 0, FIRST_HUBS
    while True:
        pairs = hub_pairs(live, low, low + hubs, threshold)
        if roots is None:
            pairs = pairs.unionAll(small_pairs(lines, FIRST_HUBS)).distinct()
        links = written(links_of(pairs, lines, threshold, chars)
                        .select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "line-links")
        merged = components(links, "line-roots")               # of the components so far
        done = [links, merged, live] + ([roots] if roots is not None else [])
        roots = written(merged if roots is None else followed(roots, merged), "line-roots")
        low, hubs = low + hubs, hubs * MORE_HUBS
        # a band whose lines all had their turn is done
        live = written(torn_members(live.filter(F.col("n") > low), merged), "line-live")
        freed(*done)
        if live.isEmpty():
            break
    freed(lines, live)
    return roots


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
               chars: int = SHINGLE_CHARS) -> DataFrame:
    """(doc_id, rid, n_all, n_lines, kept): ``kept`` holds the numbers of the compared lines that stay."""
    keys = written(line_keys(docs), "line-keys")
    roots = similar_lines(docs, threshold, bands, rows, chars)
    seen = keys.select("doc_id", "rid", F.explode("lines").alias("l")).select(
        "l.k1", "l.k2", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", F.col("l.pos").alias("pos")).alias("at"))
    firsts = seen.groupBy("k1", "k2").agg(F.min("at").alias("at"))
    chosen = (firsts.join(roots, F.col("k1") == F.col("node"), "left")
              .groupBy(F.coalesce("root", "k1").alias("root"), F.when(F.col("root").isNull(), F.col("k2")).alias("k2"))
              .agg(F.min("at").alias("at")))
    kept = chosen.groupBy(F.col("at.rid").alias("rid")).agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))
    return keys.join(kept, "rid", "left").select(
        "doc_id", "rid", "n_all", F.size("lines").alias("n_lines"),
        F.transform("lines", lambda x: x["pos"]).alias("compared"),
        F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                 chars: int = SHINGLE_CHARS) -> DataFrame:
    """``docs`` with the lines of each text that stay; a text that loses none is unchanged."""
    kept = kept_lines(docs, threshold, bands, rows, chars)
    plan = kept.filter(F.size("kept") < F.col("n_lines")).select(
        F.col("rid").alias("_rid"), F.sort_array(F.array_union(F.array_except(
            F.sequence(F.lit(0), F.col("n_all") - 1), "compared"), "kept")).alias("_stay")).dropDuplicates(["_rid"])
    rows_in = with_row_key(docs.select(whole_row(docs).alias("_row"), "doc_id", "text")).select("_row", "rid")
    out = rows_in.join(written(plan, "line-plan"), F.col("rid") == F.col("_rid"), "left")
    lines = F.split(F.col("_row.text"), "\n")
    text = F.when(F.col("_stay").isNull(), F.col("_row.text")).otherwise(F.transform(
        F.array(lines), lambda all_lines: F.array_join(F.transform("_stay", lambda i: F.get(all_lines, i)), "\n"))[0])
    return out.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), "kept")
