"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits over 4-word shingles (XXH64, seed 42); computed from Arrow
batches with numpy, one document at a time.

Links (Hamming distance <= ``max_bits``): the 64 bits are cut into ``pieces``, so
that two linked fingerprints differ in at most t = max_bits // pieces bits of one
piece.  The anchors of a piece are a covering code of radius 1: a Hamming code on
its first ``code_bits`` bits and every value of the others.  A fingerprint's home
is its nearest anchor (distance <= 1); it is also replicated to every anchor
within 1 + t.  A linked pair meets at the home of either one, where the full
64-bit distance decides.

Equal fingerprints are one node from the start, so copies cost nothing further.
Within an anchor only a spanning forest of the links found is passed on, never
all pairs.  Anchors with many homes are dealt out on a grid of home blocks times
replica blocks, which still compares every home with every replica.  Components
come from ``components``.

Scale: a fingerprint makes some 45 rows at 3 pieces with 2^17 anchors each.  For
far more fingerprints choose 2 pieces and ``code_bits=31`` (2^27 anchors, some
340 rows).

Defined cases: a text with no words (NULL included) has fingerprint 0 and links
like any other; 1 to 3 words make one shingle; a NULL ``doc_id`` links by its
fingerprint but never names a component (a component of NULL ids only is NULL);
repeated rows appear once each in the result; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
PIECES = 3
CODE_BITS = 15
BLOCK_HOMES = 2000      # homes of an anchor beyond which it is dealt out on a grid
PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()      # bytes: lowers A-Z, splits on the six ASCII spaces
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1
    n = max(1, len(tokens) - shingle_words + 1)
    ends = ends[min(shingle_words, len(tokens)) - 1:] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([xxh64_intdigest(line[s:e], seed) for s, e in
                      zip(starts[at:min(n, at + 65536)].tolist(), ends[at:at + 65536].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    on = counts * 2 > n
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        run, "doc_id long, fp long")


class Cover:
    """A piece's covering code: by syndrome, the bit flips that lead to anchors within reach."""

    def __init__(self, width: int, code_bits: int, reach: int):
        self.width = width
        self.code_bits = code_bits = min(code_bits, 2 ** int(np.log2(width + 1)) - 1)
        flips: dict[int, list[tuple[int, int]]] = {}
        for w in range(reach + 1):
            for c in combinations(range(width), w):
                s, mask = 0, 0
                for bit in c:
                    mask |= 1 << bit
                    if bit < code_bits:
                        s ^= bit + 1
                flips.setdefault(s, []).append((w, mask))
        # the first flip of a syndrome is its nearest anchor, in the code bits alone
        self.masks = [np.array([m for _, m in sorted(flips[s], key=lambda f: (f[0], f[1] >> code_bits, f[1]))], np.uint64)
                      for s in range(code_bits + 1)]

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        s = np.zeros(len(values), np.int64)
        for bit in range(self.code_bits):
            s ^= np.where((values >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
        return s


def piece_bounds(pieces: int) -> list[tuple[int, int]]:
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    return list(zip(cuts, cuts[1:]))


def anchors(fps: DataFrame, max_bits: int, pieces: int, code_bits: int) -> DataFrame:
    """(anchor, fp, home): every fingerprint at each anchor it must visit."""
    bounds = piece_bounds(pieces)

    def run(batches):
        import pyarrow as pa
        covers = [Cover(hi - lo, code_bits, 1 + max_bits // pieces) for lo, hi in bounds]
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at:at + 4096].view(np.uint64)
                for p, ((lo, hi), cover) in enumerate(zip(bounds, covers)):
                    v = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                    s = cover.syndromes(v)
                    for k, masks in enumerate(cover.masks):
                        own = np.flatnonzero(s == k)
                        if not len(own):
                            continue
                        a = (v[own][:, None] ^ masks[None, :]) | np.uint64(p << 40)
                        home = np.zeros(a.shape, bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a.ravel().view(np.int64)), pa.array(np.repeat(fp[own], len(masks)).view(np.int64)),
                             pa.array(home.ravel())], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) with the components of the edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def compare(batches, max_bits: int):
    """Spanning links among rows sorted by group with homes first; groups may span batches."""
    import pyarrow as pa

    def links(group, home, fp):
        new = np.r_[True, group[1:] != group[:-1]]
        g = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        homes = np.bincount(g, home, minlength=len(first)).astype(np.int64)
        n = np.where(home, 0, homes[g])                 # every row meets all homes of its group
        stop = np.cumsum(n)
        found_a, found_b = [], []
        at = 0
        while at < len(fp):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            rows = np.repeat(np.arange(at, to), n[at:to])
            if len(rows):
                nth = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(n[at:to])[:-1]], n[at:to])
                x, y = fp[first[g[rows]] + nth], fp[rows]
                d = np.bitwise_count(x ^ y)
                near = np.flatnonzero((d <= max_bits) & (d > 0))
                if len(near):
                    s, r = forest(x[near], y[near])
                    found_a.append(s)
                    found_b.append(r)
            at = to
        if found_a:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        group, home, fp = cols
        if not len(group):
            continue
        other = group != group[-1]
        last = len(group) - int(np.argmax(other[::-1])) if other.any() else 0
        held = [c[last:] for c in cols]
        if last:
            yield from links(group[:last], home[:last], fp[:last].astype(np.int64).view(np.uint64))
    if held and len(held[0]):
        yield from links(held[0], held[1], held[2].astype(np.int64).view(np.uint64))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, pieces: int = PIECES, code_bits: int = CODE_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every component."""
    rows = anchors(fps, max_bits, pieces, code_bits)
    homes = rows.filter("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_HOMES)
    hot = written(homes.select(F.col("anchor").alias("hot"), F.ceil(F.col("n") / BLOCK_HOMES).cast("int").alias("grid")),
                  "simhash-hot")
    placed = rows.join(hot, F.col("anchor") == F.col("hot"), "left").withColumn("grid", F.coalesce("grid", F.lit(1)))
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("grid"))
    other = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    # a home is also a row that the other homes of its anchor must meet
    as_home = placed.filter("home").select("anchor", block.alias("i"), other.alias("j"), F.lit(True).alias("home"), "fp")
    as_row = placed.select("anchor", other.alias("i"), block.alias("j"), F.lit(False).alias("home"), "fp")
    grouped = as_home.unionAll(as_row).select(
        F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("anchor")).otherwise(F.xxhash64("anchor", "i", "j")).alias("g"),
        "home", "fp")
    dealt = grouped.repartition("g").sortWithinPartitions(F.col("g"), F.col("home").desc())
    return dealt.mapInArrow(lambda batches: compare(batches, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED,
                    pieces: int = PIECES, code_bits: int = CODE_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``."""
    prints = written(fingerprints(docs, shingle_words, seed), "simhash-fp")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(near_links(fps, max_bits, pieces, code_bits), "simhash-links")
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-roots")
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = written(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
