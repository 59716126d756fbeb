"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's UTF-8 bytes, one from each side; a linear layer on both
states gives every byte position a probability per language.  A document's
probabilities are the mean over all its positions.  The network is trained in
numpy by backpropagation through time on a bounded sample (``DOCS_PER_LANG``
windows of ``WINDOW_CHARS`` characters per language, drawn anywhere in the text
by a hash); every whole text is then read in tasks, straight from the Arrow
buffers, in chunks of ``CHUNK`` bytes whose states start at zero.  Chunks of many
documents go through the recurrence together, so the work is a few matrix
products per byte position.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; so
is every text if nothing can be learned (no labelled rows, an empty table); a
NULL ``doc_id`` is never learned from and not held out; repeated rows are
predicted one by one; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

HIDDEN = 8
CHUNK = 128
LANES = 4096             # chunks that go through the recurrence together
DOCS_PER_LANG = 400      # bound of the training sample
WINDOW_CHARS = 240
STEPS = 240
SEED = 3
PAD = 256                # byte value of positions past a chunk's end
WORDY = re.compile(r"[^\W\d_]")         # letters, and a few numerals that are none


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORDY.finditer(text))


@dataclass
class Model:
    langs: list
    table: tuple         # per direction (3 hidden, 257): what a byte adds to the update, reset and candidate gates
    recur: tuple         # per direction (3 hidden, hidden)
    out: np.ndarray      # (languages, 2 hidden)
    bias: np.ndarray     # (languages, 1)


def step(gates: np.ndarray, recur: np.ndarray, h: np.ndarray):
    """One GRU step on (hidden, lanes): the new state and what backpropagation needs."""
    n = len(h)
    a = recur @ h
    zr = 0.5 * np.tanh(0.5 * (gates[:2 * n] + a[:2 * n])) + 0.5
    c = np.tanh(gates[2 * n:] + zr[n:] * a[2 * n:])
    return h + zr[:n] * (c - h), (zr[:n], zr[n:], c, a[2 * n:], h)


def step_back(dh: np.ndarray, kept: tuple, recur: np.ndarray):
    """Gradients of one step: of the earlier state, the byte's gates and the recurrence."""
    z, r, c, u, h = kept
    dcand = dh * z * (1 - c * c)
    dz = dh * (c - h) * z * (1 - z)
    dr = dcand * u * r * (1 - r)
    da = np.concatenate([dz, dr, dcand * r])
    return dh * (1 - z) + recur.T @ da, np.concatenate([dz, dr, dcand]), da @ h.T


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def chunks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """(width, chunks) byte values, padded with ``PAD``."""
    at = np.arange(width)[:, None]
    x = data[np.minimum(starts + at, max(len(data) - 1, 0))].astype(np.int16)
    x[at >= lengths] = PAD
    return x


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray):
    """Mean cross-entropy over all byte positions of the batch, and its gradients."""
    width, lanes = x.shape
    n = m.out.shape[1] // 2
    live = x != PAD
    states, kept = [], []
    for d, order in enumerate((range(width), range(width - 1, -1, -1))):
        h = np.zeros((n, lanes), m.out.dtype)
        hs, ks = np.zeros((width, n, lanes), m.out.dtype), [None] * width
        for t in order:
            h, ks[t] = step(m.table[d][:, x[t]], m.recur[d], h)
            hs[t] = h
        states.append(hs)
        kept.append(ks)
    both = np.concatenate(states, axis=1)
    scores = np.einsum("lk,tkb->tlb", m.out, both) + m.bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    total = max(1, int(live.sum()))
    chosen = np.take_along_axis(p, np.broadcast_to(y[None, None, :], (width, 1, lanes)), axis=1)[:, 0]
    loss = -(np.log(np.maximum(chosen, 1e-12)) * live).sum() / total
    dscores = p
    np.put_along_axis(dscores, np.broadcast_to(y[None, None, :], (width, 1, lanes)), chosen[:, None] - 1, axis=1)
    dscores *= live[:, None] / total
    grads = {"out": np.einsum("tlb,tkb->lk", dscores, both), "bias": dscores.sum(axis=(0, 2))[:, None]}
    dboth = np.einsum("lk,tlb->tkb", m.out, dscores)
    for d, order in enumerate((range(width - 1, -1, -1), range(width))):
        dh = np.zeros((n, lanes), m.out.dtype)
        dgates = np.zeros((width, 3 * n, lanes), m.out.dtype)
        drecur = np.zeros_like(m.recur[d])
        for t in order:
            dh, dgates[t], dr = step_back(dh + dboth[t, d * n:(d + 1) * n], kept[d][t], m.recur[d])
            drecur += dr
        flat = x.ravel()
        grads[f"table{d}"] = np.stack([np.bincount(flat, dgates[:, k].ravel(), 257) for k in range(3 * n)])
        grads[f"table{d}"][:, PAD] = 0
        grads[f"recur{d}"] = drecur
    return loss, grads


def new_model(langs: list, hidden: int = HIDDEN, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    tables = []
    for _ in range(2):
        t = f(3 * hidden, 257)
        t[:, PAD] = 0
        t[:hidden, PAD] = -40            # the update gate stays shut past the end
        tables.append(t)
    return Model(langs, tuple(tables), (f(3 * hidden, hidden), f(3 * hidden, hidden)),
                 f(len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, lanes: int = 128,
          width: int = 96, seed: int = SEED) -> Model | None:
    """Fit on (text, language) samples with Adam; batches take windows evenly from the languages."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    by_lang = [[t.encode() for t, x in samples if x == lang and t] or [b" "] for lang in langs]
    m = new_model(langs, hidden, seed)
    weights = {"out": m.out, "bias": m.bias, "table0": m.table[0], "table1": m.table[1], "recur0": m.recur[0],
               "recur1": m.recur[1]}
    mean = {k: np.zeros_like(w) for k, w in weights.items()}
    var = {k: np.zeros_like(w) for k, w in weights.items()}
    for i in range(1, steps + 1):
        y = np.arange(lanes) % len(langs)
        x = np.full((width, lanes), PAD, np.int16)
        for lane, k in enumerate(y):
            text = by_lang[k][rng.integers(len(by_lang[k]))]
            at = int(rng.integers(max(1, len(text) - width + 1)))
            piece = np.frombuffer(text[at:at + width], np.uint8)
            x[:len(piece), lane] = piece
        _, grads = loss_and_gradients(m, x, y)
        rate = 0.02 * min(1.0, 2 * (1 - i / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            mean[k] += 0.1 * (g - mean[k])
            var[k] += 0.01 * (g * g - var[k])
            weights[k] -= rate * (mean[k] / (1 - 0.9 ** i)) / (np.sqrt(var[k] / (1 - 0.99 ** i)) + 1e-8)
    return m


def document_probabilities(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): mean probability over the byte positions of each text."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // CHUNK)
    doc = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[:-1][doc] + nth * CHUNK
    sizes = np.minimum(CHUNK, lengths[doc] - nth * CHUNK)
    n, total = m.out.shape[1] // 2, np.zeros((len(lengths), len(m.langs)))
    for at in range(0, len(doc), LANES):
        part = slice(at, at + LANES)
        x = chunks(data, starts[part], sizes[part], CHUNK)
        ahead = np.zeros((CHUNK, n, x.shape[1]), np.float32)
        h = np.zeros((n, x.shape[1]), np.float32)
        for t in range(CHUNK):
            h, _ = step(m.table[0][:, x[t]], m.recur[0], h)
            ahead[t] = h
        h = np.zeros_like(h)
        pooled = np.zeros((len(m.langs), x.shape[1]))
        for t in range(CHUNK - 1, -1, -1):
            h, _ = step(m.table[1][:, x[t]], m.recur[1], h)
            pooled += softmax(m.out[:, :n] @ ahead[t] + m.out[:, n:] @ h + m.bias) * (t < sizes[part])
        np.add.at(total, doc[part], pooled.T)
    return total / np.maximum(lengths, 1)[:, None]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def training_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars: int = WINDOW_CHARS) -> list[tuple[str, str]]:
    """At most ``docs_per_lang`` windows per language of the documents that may be learned from.

    Rows are drawn by a hash of id and text.  A drawing for about twice the bound is then
    cut to the bound in the order of the draw, so equal rows, which share a draw, cannot
    exceed it; each task keeps no more than the bound of a language.
    """
    learn = docs.filter((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one number per language, as many as the model has outputs
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    n = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("lang")).cast("double")
    draw = F.xxhash64("doc_id", "text", F.lit("draw"))
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    picked = (learn.select("lang", "doc_id", draw.alias("draw"), F.substring("text", start.cast("int"), F.lit(chars)).alias("window"), n.alias("n"))
              .filter((F.col("draw").cast("double") / 2.0 ** 64 + 0.5) * F.col("n") <= F.lit(2.0 * docs_per_lang + 40)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "window"))
    kept = picked.withColumn("place", place).filter(F.col("place") <= docs_per_lang)
    return [(r["window"], r["lang"]) for r in kept.orderBy("lang", "doc_id", "window").collect()]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from ``doc_id`` and ``text`` alone."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(2)
            known = [t.as_py() for t in texts]
            letters = np.array([t is not None and has_letter(t) for t in known], bool)
            lang, score = np.full(len(known), "und", object), np.zeros(len(known))
            if model and letters.any():
                used = [t.encode() if ok else b"" for t, ok in zip(known, letters)]
                offsets = np.cumsum([0, *map(len, used)])
                p = document_probabilities(model, np.frombuffer(b"".join(used), np.uint8), offsets)
                best = p.argmax(axis=1)
                lang[letters] = np.array(model.langs, object)[best[letters]]
                score[letters] = np.clip(p[np.arange(len(p)), best][letters], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(training_sample(docs)))
