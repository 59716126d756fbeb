"""Substring de-duplication with sharded FM-indexes.

A window is ``WINDOW`` consecutive words of one document.  Every word goes that a
window covers whose words also begin in a document with a smaller ``doc_id``.

Routing.  A window's anchor is the ``ANCHOR`` words in it with the smallest hash
(leftmost of equals), so equal windows have equal anchors, wherever they occur.
Consecutive windows with one anchor make a segment.  Segments whose anchor occurs
in one document only cannot repeat and end there; this needs 32 bytes per anchor
(one in 16 words) and no text.

Index.  Of equal segments only the one of the smallest document goes on, with its
text.  Segments are dealt into shards by anchor; each shard builds an FM-index
(suffixes by prefix doubling, the BWT in a wavelet matrix) over them and then
streams them through backward search.  The matching statistics, cut off at
``WINDOW``, tell for each window the suffixes that begin with it; the smallest
document among these is the window's first owner.

A crowded anchor - a common passage whose surroundings differ in every document -
would bring unboundedly many different segments to one shard.  Where an anchor has
more than ``CROWDED`` of them, its segments are cut into single windows, which are
equal or have nothing in common: those of one document only end, of the others
one each goes on to the shards.

Result.  The owners return to all occurrences of their segments; a window's words
go where the owner's ``doc_id`` is smaller.  Words are compared as UTF-8 bytes;
hashes (64 bits) only route and group, and the match inside a shard is on words.

Defined cases: a NULL text has no words; a text shorter than a window loses
nothing; rows with a NULL ``doc_id`` lose nothing and own nothing; rows with one
``doc_id`` are parts of one document, so they never remove from each other; equal
rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, written

WINDOW = 50
ANCHOR = 19
CROWDED = 1000
SHARD_BYTES = 3 << 20
SLAB_BYTES = 4 << 20
TAG_BITS = 26            # tells rows of one doc_id apart, above 32 bits of position and 5 of length
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash per word, first word of every document and the end) of concatenated texts."""
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    size = end - begin
    run = np.zeros(len(data) + 1, np.uint64)
    if len(begin):
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        table = _mix(np.arange(1, 257, dtype=np.uint64))
        part = table[data[solid]] * _powers(_P, int(size.max()))[inside]
        run = np.add.reduceat(part, np.cumsum(size) - size)
    else:
        run = np.zeros(0, np.uint64)
    return _mix(run + size.astype(np.uint64) * _Q), np.searchsorted(begin, offsets)


class Rolling:
    """Hashes of runs of words from prefix sums, modulo 2^64."""

    def __init__(self, h: np.ndarray):
        power = _powers(_Q, len(h) + 1)
        self.inverse = _powers(np.uint64(pow(int(_Q), -1, 2**64)), len(h) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power[:len(h)], dtype=np.uint64)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def segments(h: np.ndarray, firsts: np.ndarray, window: int, anchor: int):
    """(document, first window, last window, anchor hash, segment hash) of all segments; windows by word."""
    n, wide = len(h), window - anchor + 1
    if n < window:
        return [np.zeros(0, np.int64)] * 5
    roll = Rolling(h)
    at = np.arange(n - anchor + 1)
    gram = roll(at, at + anchor)
    best, span = at, 1
    while span < wide:                               # leftmost smallest gram of ever wider runs
        step = min(span, wide - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(gram[a] <= gram[b], a, b)
        span += step
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    start = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
    chosen = best[start]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1) | (doc[start[1:]] != doc[start[:-1]])] \
        if len(start) else np.zeros(0, bool)
    lo = start[new]
    hi = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] if len(start) else lo
    return doc[lo], lo - firsts[doc[lo]], hi - firsts[doc[lo]], gram[chosen[new]], roll(lo, hi + window)


def slabs(batch, text_column: int, size: int = SLAB_BYTES):
    """(first row, bytes, offsets) of stretches of a batch's texts, some ``size`` bytes each."""
    texts = [t.as_py() or "" for t in batch.column(text_column)]
    at = 0
    while at < len(texts):
        part, total = [], 0
        while at + len(part) < len(texts) and (not part or total < size):
            part.append(texts[at + len(part)].encode())
            total += len(part[-1])
        yield at, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
        at += len(part)


def tagged(docs: DataFrame) -> DataFrame:
    tag = F.xxhash64("text").bitwiseAND(F.lit(2**TAG_BITS - 1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text")


def place(tag: Column, word: Column, more: Column) -> Column:
    return F.shiftleft(tag, 37).bitwiseOR(F.shiftleft(word.cast("long"), 5)).bitwiseOR(more.cast("long"))


def find_segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, seg, doc_id, pos): pos packs the row's tag, the first window and the number of further ones."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, data, offsets in slabs(b, 2):
                doc, lo, hi, key, seg = segments(*word_hashes(data, offsets), window, anchor)
                pos = (tags[row + doc] << 37) | (lo << 5) | (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.uint64).view(np.int64)), pa.array(seg.astype(np.uint64).view(np.int64)),
                     pa.array(ids[row + doc]), pa.array(pos)], names=["key", "seg", "doc_id", "pos"])
    return tagged(docs.filter("doc_id is not null and text is not null")).mapInArrow(
        run, "key long, seg long, doc_id long, pos long")


def cut_texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, seg, doc_id, pos, text, single): the words of the wanted segments, or of their single windows."""
    lists = wanted.groupBy("doc_id", F.shiftright("pos", 37).alias("tag")).agg(
        F.collect_set(F.struct("key", "seg", "pos", "single")).alias("list"))

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def signed(x):
            return x - 2**64 if x >= 2**63 else x
        for b in batches:
            for i in range(b.num_rows):
                doc, tag, text, items = (b.column(c)[i].as_py() for c in range(4))
                words = text.encode().split()
                out = []
                for item in items:
                    word, more = (item["pos"] >> 5) & (2**32 - 1), item["pos"] & 31
                    if not item["single"]:
                        out.append((item["key"], item["seg"], doc, item["pos"], b" ".join(words[word:word + more + window]), False))
                        continue
                    for w in range(word, word + more + 1):
                        piece = b" ".join(words[w:w + window])
                        key = signed(xxh64_intdigest(piece, 1))
                        out.append((key, key, doc, (tag << 37) | (w << 5), piece, True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.binary(), pa.bool_()))],
                    names=["key", "seg", "doc_id", "pos", "text", "single"])
    return tagged(docs).join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "list").mapInArrow(
        run, "key long, seg long, doc_id long, pos long, text binary, single boolean")


def owners_in_shard(table, window: int):
    """Arrow table of (key, seg, owners): per window of each segment the smallest document that has it."""
    import pyarrow as pa

    from .fm_index import FMIndex

    numbers: dict = {}
    parts = [[numbers.setdefault(w, len(numbers) + 1) for w in t.split(b" ")] for t in table.column("text").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1                  # a separator follows every segment
    starts = ends - sizes
    tokens = np.zeros(int(ends[-1]) + 1, np.int64)
    tokens[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        np.concatenate([np.array(p) for p in parts])
    index = FMIndex(tokens, len(numbers) + 1, window)
    length, low, _ = index.matching_statistics(tokens, starts, ends)
    docs = np.repeat(table.column("doc_id").to_numpy(), sizes + 1)[index.order]
    classes = np.append(np.flatnonzero(index.common[:-1] < window), len(docs))
    owner = np.minimum.reduceat(docs, classes[:-1])
    at = np.searchsorted(classes, low, "right") - 1
    first = owner[np.minimum(at, len(owner) - 1)]
    whole = sizes - window + 1                       # the windows of a segment, all matched at full length
    lists = [first[s:s + n] for s, n in zip(starts, whole)]
    assert all((length[s:s + n] == window).all() for s, n in zip(starts, whole))
    return pa.table([table.column("key"), table.column("seg"), pa.array(lists, pa.list_(pa.int64()))],
                    names=["key", "seg", "owners"])


def find_owners(texts: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(key, seg, owners) for segments ``texts(key, seg, doc_id, text)``, one row per different segment."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    return texts.withColumn("shard", shard).groupBy("shard").applyInArrow(
        lambda t: owners_in_shard(t, window), "key long, seg long, owners array<long>")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, crowded: int = CROWDED,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, tag, starts): the windows to remove, by number of their first word."""
    if not 0 <= window - anchor <= 31:
        raise ValueError("window and anchor may differ by 31 words at most")
    found = find_segments(docs, window, anchor)
    keys = found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    # written first: the join then reads a plain table and the skew join can split a key's occurrences
    keys = written(keys.select("key"), "substring-keys")
    shared = written(found.join(keys, "key"), "substring-shared")

    segs = shared.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    busy = segs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("key")
    busy = written(busy.withColumn("single", F.lit(True)), "substring-crowded")
    plain = segs.join(busy, "key", "left_anti").select("key", "seg", "at.doc_id", "at.pos", F.lit(False).alias("single"))
    crowd = shared.join(busy, "key").select("key", "seg", "doc_id", "pos", "single")
    texts = written(cut_texts(docs, plain.unionAll(crowd), window), "substring-texts")

    singles = texts.filter("single").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi"),
                                                        F.max("text").alias("text")).filter("doc_id < hi")
    index = texts.filter("not single").select("key", "seg", "doc_id", "text").unionAll(
        singles.select("key", F.col("key").alias("seg"), "doc_id", "text"))
    owners = written(find_owners(index, window, shard_bytes), "substring-owners")

    places = shared.join(busy, "key", "left_anti").unionAll(
        texts.filter("single").select("key", "seg", "doc_id", "pos"))
    hits = places.join(owners, ["key", "seg"])
    word = F.shiftright("pos", 5).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    gone = let(F.struct(F.col("owners").alias("o"), F.col("doc_id").alias("d"), word.alias("w")), lambda s: F.filter(
        F.transform(s["o"], lambda o, i: F.when(o < s["d"], s["w"] + i)), lambda x: x.isNotNull()))
    return (hits.select("doc_id", F.shiftright("pos", 37).alias("tag"), gone.alias("gone")).filter(F.size("gone") > 0)
            .groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("gone")).alias("starts")))


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, crowded: int = CROWDED,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): removed word spans [start, end) and the words that
    stay, joined by one space, for every row of ``docs``."""
    starts = written(repeats(docs, window, anchor, crowded, shard_bytes), "substring-repeats")

    def run(batches):
        import pyarrow as pa
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for i in range(b.num_rows):
                words = (b.column(1)[i].as_py() or "").encode().split()
                begin = b.column(2)[i].values
                if begin is None or not len(begin):
                    out.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                begin = begin.to_numpy(zero_copy_only=False)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + window, -1)
                gone = np.r_[0, np.cumsum(cover)[:-1] > 0, 0].astype(np.int8)
                edges = np.flatnonzero(np.diff(gone))
                keep = np.flatnonzero(gone[1:-1] == 0)
                out.append((len(words), len(words) - len(keep), [{"start": s, "end": e} for s, e in zip(
                    edges[::2].tolist(), edges[1::2].tolist())], b" ".join([words[k] for k in keep]).decode()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), spans_type, pa.string()))]]
                if out else [b.column(0), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], spans_type),
                             pa.array([], pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    both = tagged(docs).alias("t").join(starts.alias("s"), (F.col("t.doc_id") == F.col("s.doc_id"))
                                        & F.col("t.tag").eqNullSafe(F.col("s.tag")), "left")
    return both.select("t.doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
