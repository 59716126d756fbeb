"""Tree ensembles as node tables (M3, M4): growing, collapsing, evaluating prefixes.

A tree works on binned features: a row goes left if its bin is at most the node's.
Every node is stored with its number of rows, its mean label and what its split
gains, leaf or not, so one grown ensemble holds many others exactly:

* the first k trees of a forest, and the first k rounds of a boosting, are the
  smaller ensemble;
* cutting a tree at a depth, or making a leaf of every node with fewer than
  ``min_split`` rows (counts only shrink on the way down), gives the tree that a
  top-down learner with that bound grows, because neither changes which split a node
  above takes.

All random choices (rows of a tree, features of a node) are hashes of the seed, the
tree and the row or node, so they do not depend on what else is grown.

``grow`` builds many trees at once over the binned rows (a byte a value) inside one task,
level by level over histograms of (node, feature, bin); how much it holds besides the rows
is bounded by ``ENTRIES`` and ``CELLS``.  ``level_splits`` is the same step over a table
as grouped aggregates, and ``grow_table`` / ``boost_table`` grow trees with it.  Labels
are 0 / 1 or residuals; the variance that a split removes is, for 0 / 1, half the Gini
impurity it removes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

MAX_BINS = 64
MAX_DEPTH = 30
LEAST_GAIN = 1e-12
ENTRIES = 1 << 20        # (tree, row) pairs that one step of growing holds, if more than one tree's
CELLS = 1 << 20          # (node, bin) pairs that are compared at once
FEW = 1 << 12            # rows whose histograms are added up for all features in one step
JOINT = 1 << 12          # combinations of bins that a column of several features has at most
EXACT_ROWS = 10_000      # a boosting of more rows rounds residuals so that their sums are exact


# --- bins -----------------------------------------------------------------------

def bin_edges(x: np.ndarray, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points of each feature: midway between neighbouring values, all of them if they are few,
    else at the quantiles."""
    out = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        if len(values) > max_bins:
            share = np.cumsum(counts) / counts.sum()
            at = np.unique(np.searchsorted(share, np.arange(1, max_bins) / max_bins))
            at = at[at < len(values) - 1]
        else:
            at = np.arange(len(values) - 1)
        out.append((values[at] + values[at + 1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: the number of cut points below it."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


# --- hashes -----------------------------------------------------------------------

def mixed(*parts) -> np.ndarray:
    """64 well-mixed bits of the parts (numbers or arrays that broadcast)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h ^ np.asarray(p).astype(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def uniform(*parts) -> np.ndarray:
    return (mixed(*parts) >> np.uint64(11)) * 2.0 ** -53


def bootstrap_weights(seed: int, trees: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each tree draws each row: Poisson(1) by hash."""
    u = uniform(seed, 1, trees[:, None], keys[None, :])
    steps = np.cumsum([np.exp(-1) / f for f in np.cumprod([1, *range(1, 12)])])
    return np.searchsorted(steps, u).astype(float)


def feature_picker(seed: int, n_features: int, strategy: str):
    """A function from (tree, heap number of the node) arrays to the node's features, or None for all."""
    k = {"sqrt": int(np.sqrt(n_features)), "log2": int(np.log2(n_features)), "all": n_features}[strategy]
    if k >= n_features:
        return None

    def pick(tree, place):
        h = mixed(seed, 2, tree[:, None], place[:, None], np.arange(n_features)[None, :])
        return np.sort(np.argpartition(h, max(1, k) - 1, axis=1)[:, :max(1, k)], axis=1)
    return pick


# --- growing over binned rows ------------------------------------------------------------

@dataclass
class Nodes:
    """Nodes of several trees, level by level; ``feature`` is -1 at a leaf, children are row numbers."""

    tree: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def joined(parts: list[Nodes]) -> Nodes:
    """The nodes of several batches of trees as one, with the rows that they point to renumbered."""
    first = np.cumsum([0, *[len(p.tree) for p in parts]])
    pointer = lambda v, k: np.where(v >= 0, v + k, -1)
    return Nodes(**{c: np.concatenate([pointer(getattr(p, c), k) if c in ("parent", "left", "right") else getattr(p, c)
                                       for p, k in zip(parts, first)]) for c in Nodes.__dataclass_fields__})


def split_gains(wl: np.ndarray, sl: np.ndarray, wt: np.ndarray, st: np.ndarray, min_leaf: int) -> np.ndarray:
    """What each cut gains, or -1: ``wl`` and ``sl`` are the weights and sums up to it, ``wt`` and ``st`` those of the node."""
    wr, sr = wt - wl, st - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where((wl >= min_leaf) & (wr >= min_leaf), sl * sl / wl + sr * sr / wr - st * st / wt, -1.0)
    return np.where(g > LEAST_GAIN, np.round(g, 9), -1.0)


class Columns:
    """The bins of each feature as columns and, if ``exact`` sums make their order free, of several features as
    one column of their pairs (or more) of bins: a histogram of that holds theirs as its margins, so many rows
    are added up in half as many passes."""

    def __init__(self, codes: np.ndarray, exact: bool):
        self.widths = codes.max(axis=0, initial=0).astype(np.int64) + 1
        self.shape, self.codes = (len(self.widths), int(self.widths.max(initial=1))), codes
        columns, groups = np.ascontiguousarray(codes.T), []
        for f in np.argsort(-self.widths, kind="stable") if exact else ():
            group = next((g for g in groups if self.widths[g].prod() * self.widths[f] <= JOINT), None)
            groups.append([f]) if group is None else group.append(f)
        self.single = [([f], columns[f]) for f in range(len(columns))]
        self.joint = [(g, np.ravel_multi_index([*columns[g]], self.widths[g]).astype(np.uint16)) for g in groups]

    def histograms(self, rows: np.ndarray, slot: np.ndarray, w: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """(weights, sums) of each of ``n`` slots by feature and bin."""
        out, (features, bins) = np.zeros((2, n, *self.shape)), self.shape
        if len(rows) <= FEW:                                 # fewer steps than feature by feature
            place = ((slot[:, None] * features + np.arange(features)) * bins + self.codes[rows]).ravel()
            for i, v in enumerate((w, s)):
                out[i] = np.bincount(place, np.repeat(v, features), out[i].size).reshape(out[i].shape)
            return out
        near = len(rows) and rows[-1] - rows[0] + 1 == len(rows) and bool((np.diff(rows) == 1).all())
        rows = slice(rows[0], rows[-1] + 1) if near else rows
        for v, into in ((None if (w == 1).all() else w, out[0]), (s, out[1])):
            for group, column in self.joint if self.joint and len(slot) > 2 * JOINT * n else self.single:
                sizes = self.widths[group]
                place = column[rows] if n == 1 else slot * sizes.prod() + column[rows]
                cells = np.bincount(place, v, n * sizes.prod()).reshape(n, *sizes)
                for j, f in enumerate(group):
                    others = tuple(k + 1 for k in range(len(group)) if k != j)
                    into[:, f, :sizes[j]] = cells.sum(axis=others) if others else cells
        return out


class Siblings:
    """Histograms of all features of a level's nodes.  If sums are ``exact``, as those of whole numbers and of
    rounded residuals, the smaller of two children is added up and the other is what the parent has besides;
    else every node's rows are added up in their order."""

    def __init__(self, columns: Columns, exact: bool):
        self.columns, self.exact, self.held, self.number = columns, exact, None, None

    def step(self, split: np.ndarray, parents: np.ndarray | None, rows, node, w, s) -> np.ndarray:
        """(weights, sums) of the nodes with ``split``; ``parents`` are this level's, two nodes each, or None at the roots."""
        m = len(split)
        if parents is None or not self.exact:
            on = np.flatnonzero(split)
            number = np.full(m, -1)
            number[on] = np.arange(len(on))
            held = self._sums(number, len(on), rows, node, w, s)
        else:
            pairs = np.flatnonzero(split.reshape(-1, 2).any(1))
            count = np.bincount(node, minlength=m).reshape(-1, 2)[pairs]
            right = (count[:, 1] < count[:, 0]).astype(int)
            number = np.full(m, -1)
            number[2 * pairs + right] = np.arange(len(pairs))
            small, k = self._sums(number, len(pairs), rows, node, w, s), np.arange(len(pairs))
            held = np.empty((2, len(pairs), 2, *small.shape[2:]))
            held[:, k, right] = small
            held[:, k, 1 - right] = self.held[:, self.number[parents[2 * pairs]]] - small
            held = held.reshape(2, 2 * len(pairs), *small.shape[2:])
            number = np.full(m, -1)
            number[2 * pairs], number[2 * pairs + 1] = 2 * k, 2 * k + 1
        self.held, self.number = held, number
        return held[:, number[np.flatnonzero(split)]]

    def _sums(self, number, n, rows, node, w, s):
        slot = number[node]
        if (slot < 0).any():
            mine = np.flatnonzero(slot >= 0)
            rows, slot, w, s = rows[mine], slot[mine], w[mine], s[mine]
        return self.columns.histograms(rows, slot, w, s, n)


def best_of_all(held: np.ndarray, wt: np.ndarray, st: np.ndarray, min_leaf: int):
    """(gain, feature, bin) of each node over all features, from their histograms."""
    wl, sl = held.cumsum(3)
    g = split_gains(wl, sl, wt[:, None, None], st[:, None, None], min_leaf).reshape(len(wt), -1)
    best = g.argmax(1)
    return g[np.arange(len(wt)), best], best // held.shape[3], best % held.shape[3]


def best_of_some(codes: np.ndarray, features: np.ndarray, rows, slot, w, s, wt: np.ndarray, st: np.ndarray, min_leaf: int):
    """(gain, feature, bin) of each node over its own ``features`` (nodes x how many, rising)."""
    n, bins, flat = len(wt), int(codes.max(initial=0)) + 1, codes.ravel()
    gain, feature, cut = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = max(1, CELLS // bins)
    for a in range(0, n, step):
        b = min(n, a + step)
        mine = slice(None) if b - a == n else np.flatnonzero((slot >= a) & (slot < b))
        base, at, ww, ss = rows[mine] * codes.shape[1], slot[mine] - a, w[mine], s[mine]
        for j in range(features.shape[1]):
            own = features[a:b, j]
            place = at * bins + flat[base + own[at]]
            wl, sl = (np.bincount(place, v, (b - a) * bins).reshape(-1, bins).cumsum(1) for v in (ww, ss))
            g = split_gains(wl, sl, wt[a:b, None], st[a:b, None], min_leaf)
            best = g.argmax(1)
            g = g[np.arange(b - a), best]
            up = np.flatnonzero(g > gain[a:b])
            gain[a + up], feature[a + up], cut[a + up] = g[up], own[up], best[up]
    return gain, feature, cut


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: np.ndarray, max_depth: int, min_leaf: int = 1,
         min_split=2, pick=None, led: bool = True, exact: bool = False, side: Columns | None = None):
    """(nodes, leaf of each tree and row) for the trees of ``y`` and ``weight`` (trees x rows).

    Rows of weight 0 take no part but are led to a leaf, unless ``led`` is false, when no
    leaves are given.  A split leaves ``min_leaf`` rows on each side; ties go to the smaller
    feature, then the smaller bin.  ``min_split`` is one number or one a tree.  ``exact`` says that
    all sums of ``y`` are exact; ``side`` are the ``Columns`` of the codes, if they are known.
    """
    n_trees, n_rows = y.shape
    columns = {c: [] for c in Nodes.__dataclass_fields__}
    least = np.broadcast_to(min_split, n_trees)
    leaf = np.zeros((n_trees, n_rows), np.int64) if led else None
    tree, place, parent, start = np.arange(n_trees), np.ones(n_trees, np.uint64), np.full(n_trees, -1), 0
    side = (side or Columns(codes, exact)) if pick is None else None
    siblings = side and Siblings(side, exact)
    e_tree, e_row = np.nonzero(weight > 0)
    e_node, w, target = e_tree.copy(), weight[e_tree, e_row].astype(float), y[e_tree, e_row]
    s = w * target
    q = s * target
    for depth in range(max_depth + 1):
        m = len(tree)
        total = np.bincount(e_node, w, m)
        summed = np.bincount(e_node, s, m)
        mean = summed / np.maximum(total, 1e-300)
        spread = np.bincount(e_node, q, m) - summed * mean
        split = (total >= np.maximum(least[tree], 2 * min_leaf)) & (spread > LEAST_GAIN) & (depth < max_depth)
        gain, feature, cut = np.zeros(m), np.full(m, -1), np.full(m, -1)
        if siblings is not None and m * side.shape[0] * side.shape[1] > 2 * CELLS:
            siblings = None
        if split.any():
            on = np.flatnonzero(split)
            if siblings is not None:
                held = siblings.step(split, None if depth == 0 else parent - (start - last), e_row, e_node, w, s)
                found = best_of_all(held, total[on], summed[on], min_leaf)
            else:
                number = np.full(m, -1)
                number[on] = np.arange(len(on))
                slot = number[e_node]
                mine = slice(None) if len(on) == m else np.flatnonzero(slot >= 0)
                some = np.broadcast_to(np.arange(codes.shape[1]), (len(on), codes.shape[1])) if pick is None else pick(trees[tree[on]], place[on])
                found = best_of_some(codes, some, e_row[mine], slot[mine], w[mine], s[mine], total[on], summed[on], min_leaf)
            gain[on], feature[on], cut[on] = found
            split[on] = gain[on] > 0
            gain, feature, cut = np.where(split, gain, 0.0), np.where(split, feature, -1), np.where(split, cut, -1)
        child = start + m + 2 * (np.cumsum(split) - 1)
        left, right = np.where(split, child, -1), np.where(split, child + 1, -1)
        for c, v in {"tree": trees[tree], "depth": np.full(m, depth), "parent": parent, "feature": feature, "bin": cut, "left": left,
                     "right": right, "n": total, "value": mean, "gain": gain}.items():
            columns[c].append(v)
        stay = ~split[e_node]
        if stay.any():
            if led:
                leaf[e_tree[stay], e_row[stay]] = start + e_node[stay]
            go = np.flatnonzero(~stay)
            e_tree, e_row, e_node, w, s, q = (v[go] for v in (e_tree, e_row, e_node, w, s, q))
        if not len(e_node) or not split.any():
            break
        goes_right = codes[e_row, feature[e_node]] > cut[e_node]
        e_node = (left - (start + m))[e_node] + goes_right
        on = np.flatnonzero(split)
        parent = np.repeat(start + on, 2)
        tree = np.repeat(tree[on], 2)
        with np.errstate(over="ignore"):
            place = np.stack([place[on] * np.uint64(2), place[on] * np.uint64(2) + np.uint64(1)], 1).ravel()
        start, last = start + m, m
    nodes = Nodes(**{c: np.concatenate(v) for c, v in columns.items()})
    if led:
        e_tree, e_row = np.nonzero(weight <= 0)
        leaf[e_tree, e_row] = lead(nodes, codes, e_tree.copy(), e_row)      # the roots come first
    return nodes, leaf


def forest_batches(codes: np.ndarray, y: np.ndarray, keys: np.ndarray, n_trees: int | range, seed: int, strategy: str = "sqrt",
                   min_leaf: int = 1, max_depth: int = MAX_DEPTH, min_split: int = 2):
    """The nodes of a forest or of a range of its trees, a few trees at a time."""
    pick = feature_picker(seed, codes.shape[1], strategy)
    step, wanted = max(1, ENTRIES // max(1, len(y))), np.arange(n_trees) if isinstance(n_trees, int) else np.array(n_trees)
    for a in range(0, len(wanted), step):
        trees = wanted[a:a + step]
        yield grow(codes, np.broadcast_to(y, (len(trees), len(y))), bootstrap_weights(seed, trees, keys), trees, max_depth,
                   min_leaf, min_split, pick, led=False)[0]


def grow_forest(codes: np.ndarray, y: np.ndarray, keys: np.ndarray, n_trees: int | range, seed: int, strategy: str = "sqrt",
                min_leaf: int = 1, max_depth: int = MAX_DEPTH, min_split: int = 2) -> Nodes:
    """The nodes of a forest or of a range of its trees; ``value`` is the share of label 1."""
    return joined([*forest_batches(codes, y, keys, n_trees, seed, strategy, min_leaf, max_depth, min_split)])


def lead(nodes: Nodes, codes: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaves that rows come to from the nodes ``at``, which is changed."""
    going = np.arange(len(at))
    while True:
        going = going[nodes.feature[at[going]] >= 0]
        if not len(going):
            return at
        here = at[going]
        right = codes[rows[going], nodes.feature[here]] > nodes.bin[here]
        at[going] = np.where(right, nodes.right[here], nodes.left[here])


def cut_values(nodes: Nodes, max_depth: int, min_split: float) -> np.ndarray:
    """The value that each node's rows get when the trees are cut and collapsed: its own, or that of the first
    node above it which becomes a leaf."""
    leaf = (nodes.feature < 0) | (nodes.n < min_split) | (nodes.depth >= max_depth)
    at = np.arange(len(leaf))
    for depth in range(1, int(nodes.depth.max(initial=0)) + 1):
        mine = np.flatnonzero(nodes.depth == depth)
        above = at[nodes.parent[mine]]
        at[mine] = np.where(leaf[above], above, mine)
    return nodes.value[at]


def forest_scores(batches, codes: np.ndarray, sizes: list[int], cuts: list[tuple[int, float]]) -> dict[tuple, np.ndarray]:
    """{(k, max_depth, min_split): probability of each row by the first k trees, cut so}.  ``batches`` are nodes of the
    trees in order (``forest_batches``); none are kept, and a row goes down a tree once for all cuts."""
    total, part = ({c: np.zeros(len(codes)) for c in cuts} for _ in range(2))
    rows, out, done = np.arange(len(codes)), {}, 0
    for nodes in batches:
        values = {c: cut_values(nodes, *c) for c in cuts}
        for root in np.flatnonzero(nodes.parent < 0):
            at = lead(nodes, codes, np.full(len(codes), root), rows)
            done += 1
            for c in cuts:
                part[c] += values[c][at]
                if done in sizes:
                    total[c], part[c] = total[c] + part[c], np.zeros(len(codes))
                    out[done, *c] = total[c] / done
    return out


def leaves(nodes: Nodes, codes: np.ndarray, max_depth: int = MAX_DEPTH, min_split: float = 0) -> np.ndarray:
    """The node where each tree (row) leaves each row, with the trees cut and collapsed."""
    leaf = (nodes.feature < 0) | (nodes.n < min_split) | (nodes.depth >= max_depth)
    at = np.repeat(np.flatnonzero(nodes.parent < 0)[:, None], len(codes), 1)
    rows = np.arange(len(codes))[None, :]
    while True:
        going = ~leaf[at]
        if not going.any():
            return at
        right = codes[rows, nodes.feature[at]] > nodes.bin[at]
        at = np.where(going, np.where(right, nodes.right[at], nodes.left[at]), at)


def forest_prefixes(nodes: Nodes, codes: np.ndarray, sizes: list[int], max_depth: int, min_split: int) -> dict[int, np.ndarray]:
    """{k: probability of each row by the first k trees}."""
    trees, total, out = np.flatnonzero(nodes.parent < 0), 0.0, {}
    values = nodes.value[leaves(nodes, codes, max_depth, min_split)]
    done = 0
    for k in sorted(sizes):
        total = total + values[done:k].sum(0)
        out[k], done = total / min(k, len(trees)), k
    return out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


def boost(codes: np.ndarray, y: np.ndarray, keys: np.ndarray, settings: list[dict], rounds: int, max_depth: int, seed: int,
          held_out: np.ndarray | None = None, sizes: tuple = ()):
    """Several boostings at once that differ in stepSize, minSamplesSplit and subsamplingRate only.

    Log loss; a round's tree fits the residuals of the rows it draws, its leaves take a
    Newton step.  With more than ``EXACT_ROWS`` rows, residuals are rounded to whole multiples
    of a power of 2 that is small enough for their sums to be exact in any order.  Settings grow side by side while their rows are
    few, else one after the other; those that differ in minSamplesSplit only are one until a
    node is split that is too small for one of them.  Returns (the log odds at the start,
    nodes, {(setting, size): scores of ``held_out``}); ``tree`` of a node is setting * rounds
    + round.
    """
    n, s = len(y), len(settings)
    rows = np.asfortranarray(codes if held_out is None else np.concatenate([codes, held_out]))
    rate = np.array([x["stepSize"] for x in settings], float)
    share = np.array([x["subsamplingRate"] for x in settings], float)
    least = np.array([x["minSamplesSplit"] for x in settings], float)
    mean = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    first, unit = float(np.log(mean / (1 - mean))), 2.0 ** (52 - n.bit_length())
    z = np.full((s, len(rows)), first)
    exact = n > EXACT_ROWS
    parts, scores, side = [], {}, Columns(rows, exact)
    step = max(1, ENTRIES // max(1, n))
    alike: dict = {}
    for i in np.argsort(least, kind="stable"):
        alike.setdefault((rate[i], share[i]), []).append(i)
    groups = [*alike.values()]
    for t in range(rounds):
        draw = uniform(seed, 3, t, keys)
        waiting, groups = groups, []
        while waiting:
            some, waiting = waiting[:step], waiting[step:]
            mine = np.array([g[0] for g in some])
            p = sigmoid(z[mine, :n])
            weight, target = np.zeros((len(mine), len(rows))), np.zeros((len(mine), len(rows)))
            target[:, :n] = np.round((y - p) * unit) / unit if exact else y - p
            weight[:, :n] = draw[None, :] < share[mine, None]
            nodes, leaf = grow(rows, target, weight, mine, max_depth, 1, least[mine], exact=exact, side=side)
            top = np.bincount(leaf[:, :n].ravel(), (weight[:, :n] * target[:, :n]).ravel(), len(nodes.tree))
            below = np.bincount(leaf[:, :n].ravel(), (weight[:, :n] * p * (1 - p)).ravel(), len(nodes.tree))
            nodes.value = np.where(below > 1e-150, top / np.maximum(below, 1e-150), 0.0)
            for g in some:
                own = np.flatnonzero(nodes.tree == g[0])
                smallest = nodes.n[own][nodes.feature[own] >= 0].min(initial=np.inf)
                same = [i for i in g if least[i] <= smallest]
                groups.append(same)
                if len(same) < len(g):                       # the others would not split the smallest node
                    other = [i for i in g if least[i] > smallest]
                    z[other[0]] = z[g[0]]
                    waiting.append(other)
                for i in same:
                    tree = chosen_nodes(nodes, own)
                    tree.tree = np.full(len(own), i * rounds + t)        # (setting, round) in one number
                    parts.append(tree)
            z[mine] += rate[mine, None] * nodes.value[leaf]
        if t + 1 in sizes:
            for g in groups:
                for i in g:
                    scores[i, t + 1] = sigmoid(z[g[0], n:])
    return first, joined(parts), scores


def chosen_nodes(nodes: Nodes, mine: np.ndarray) -> Nodes:
    """The nodes of some whole trees."""
    place = np.full(len(nodes.tree) + 1, -1)
    place[mine] = np.arange(len(mine))
    out = Nodes(**{c: v[mine] for c, v in nodes.__dict__.items()})
    for c in ("parent", "left", "right"):
        setattr(out, c, place[getattr(out, c)])
    return out


def one_boosting(nodes: Nodes, setting: int, rounds: int) -> Nodes:
    """The nodes of one setting of ``boost``, trees numbered by round."""
    out = chosen_nodes(nodes, np.flatnonzero(nodes.tree // rounds == setting))
    out.tree = out.tree % rounds
    return out


def area_under_roc(y: np.ndarray, score: np.ndarray) -> float:
    """Chance that a row of label 1 scores above one of label 0, ties half."""
    _, rank, counts = np.unique(score, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    middle = (upto - counts + 1 + upto) / 2
    ones = y.sum()
    if ones in (0, len(y)):
        return 0.5
    return float((middle[rank][y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


# --- node tables ----------------------------------------------------------------------

NODE_COLUMNS = {"tree": "int", "node": "long", "parent": "long", "depth": "int", "feature": "string", "threshold": "double", "bin": "int",
                "left": "long", "right": "long", "n": "double", "value": "double", "gain": "double"}
NODE_DDL = ", ".join(f"`{c}` {k}" for c, k in NODE_COLUMNS.items())


def node_frame(nodes: Nodes, features: list[str], edges: list[np.ndarray]):
    """The node table as a pandas frame; ``node`` numbers the nodes of a batch of trees."""
    split = nodes.feature >= 0
    flat = np.concatenate([[np.nan], *edges])
    first = np.cumsum([1, *[len(e) for e in edges]])
    return pd.DataFrame({
        "tree": nodes.tree.astype(np.int32), "node": np.arange(len(nodes.tree)), "parent": nodes.parent, "depth": nodes.depth.astype(np.int32),
        "feature": np.where(split, np.array([*features, None], object)[nodes.feature], None),
        "threshold": flat[np.where(split, first[nodes.feature] + nodes.bin, 0)], "bin": nodes.bin.astype(np.int32), "left": nodes.left,
        "right": nodes.right, "n": nodes.n, "value": nodes.value, "gain": nodes.gain})


def collapse(table: DataFrame, max_depth: int = MAX_DEPTH, min_split: int = 2, trees: int | None = None) -> DataFrame:
    """The node table cut at a depth, with a leaf for every node of fewer than ``min_split`` rows, and
    only the first ``trees`` trees.  Counts shrink on the way down, so a node stays if its parent
    still splits."""
    if trees is not None:
        table = table.filter(F.col("tree") < trees)
    over = table.select(F.col("tree").alias("_t"), F.col("node").alias("_p"), F.col("n").alias("_n"))
    kept = (table.join(over, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_p")), "left")
            .filter((F.col("depth") == 0) | ((F.col("depth") <= max_depth) & (F.col("_n") >= min_split))).drop("_t", "_p", "_n"))
    leaf = F.col("feature").isNull() | (F.col("n") < min_split) | (F.col("depth") >= max_depth)
    blank = {"feature": "string", "threshold": "double"} | dict.fromkeys(("bin",), "int") | dict.fromkeys(("left", "right"), "long")
    cleared = {c: F.when(~leaf, F.col(c)).otherwise(F.lit(None if c in ("feature", "threshold") else -1).cast(k)) for c, k in blank.items()}
    return kept.withColumns(cleared | {"gain": F.when(~leaf, F.col("gain")).otherwise(0.0)})


def importances(table: DataFrame, features: list[str], per_tree: bool) -> DataFrame:
    """(feature, importance) from the gains: shares of each tree averaged over the trees that split
    (forest), or shares of the whole (boosting)."""
    split = table.filter(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    if per_tree:
        whole = Window.partitionBy("tree")
        split = split.select("tree", "feature", (F.col("g") / F.sum("g").over(whole)).alias("g"))
    sums = split.groupBy("feature").agg(F.sum("g").alias("g"))
    total = sums.agg(F.sum("g").alias("t"))
    names = table.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return (names.join(sums, "feature", "left").crossJoin(F.broadcast(total))
            .select("feature", F.coalesce(F.try_divide("g", "t"), F.lit(0.0)).alias("importance")))


@dataclass
class TreeModel:
    """A fitted ensemble that scores tables: its node table (pandas, ``NODE_COLUMNS``), and how leaf values
    become a probability.  The table is bounded by the rows and trees it was fitted with."""

    kind: str                       # "forest" or "boosting"
    features: list[str]
    nodes: pd.DataFrame
    first: float = 0.0
    rate: float = 1.0

    def table(self, spark: SparkSession) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(NODE_DDL)
        return spark.createDataFrame(pa.Table.from_pandas(self.nodes[list(NODE_COLUMNS)], to_arrow_schema(schema), preserve_index=False), schema)

    def arrays(self) -> dict:
        n = self.nodes
        tree, step = n["tree"].to_numpy(np.int64), int(n["node"].max()) + 2
        key = tree * step + n["node"].to_numpy(np.int64)
        order = np.argsort(key)
        child = lambda c: np.where(n[c] < 0, -1, order[np.searchsorted(key, tree * step + n[c].to_numpy(np.int64), sorter=order) % len(n)])
        number = {f: i for i, f in enumerate(self.features)}
        return {"root": np.flatnonzero(n["depth"] == 0), "feature": n["feature"].map(number).fillna(-1).to_numpy(np.int64),
                "threshold": n["threshold"].to_numpy(float), "left": child("left"), "right": child("right"), "value": n["value"].to_numpy(float)}

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (a vector of both classes) and ``prediction``."""
        from pyspark.ml.functions import array_to_vector

        kind, first, rate = self.kind, self.first, self.rate
        sent = df.sparkSession.sparkContext.broadcast(self.arrays())

        @F.pandas_udf("double")
        def share(*columns: pd.Series) -> pd.Series:
            a, x = sent.value, np.stack([c.to_numpy(float) for c in columns], axis=1)
            total = np.zeros(len(x))
            for root in a["root"]:
                at = np.full(len(x), root)
                going = np.arange(len(x))
                while True:
                    going = going[a["feature"][at[going]] >= 0]
                    if not len(going):
                        break
                    here = at[going]
                    right = x[going, a["feature"][here]] > a["threshold"][here]
                    at[going] = np.where(right, a["right"][here], a["left"][here])
                total += a["value"][at]
            return pd.Series(total / max(1, len(a["root"])) if kind == "forest" else sigmoid(first + rate * total))
        scored = df.withColumn("_p", share(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn(
            "prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")


# --- growing on a table of any size ------------------------------------------------------

def bin_codes(df: DataFrame, edges: dict[str, list[float]]) -> Column:
    """The bins of a row's features as an array: how many cut points lie below each value."""
    return F.array(*[F.size(F.filter(F.array(*[F.lit(float(e)) for e in cuts]), lambda e: e < F.col(f).cast("double")))
                     for f, cuts in edges.items()])


def quantile_edges(df: DataFrame, features: list[str], bins: int = MAX_BINS) -> dict[str, list[float]]:
    """Cut points of each feature at its approximate quantiles: one pass, ``bins`` numbers a feature."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return {f: sorted(set(row[f"q{i}"] or [])) for i, f in enumerate(features)}


def level_splits(rows: DataFrame, min_leaf: float = 1) -> DataFrame:
    """(node, n, value, gain, feature, bin): the best split of every node of ``rows(node, codes, target)``.

    One grouped aggregate over (node, feature, bin); its size is nodes x features x bins whatever
    the rows, and partial sums leave the tasks.  Gains are rounded to 9 digits; ties go to the
    smaller feature, then the smaller bin; no split gives NULL.
    """
    cells = (rows.select("node", "target", F.posexplode("codes").alias("f", "b")).groupBy("node", "f", "b")
             .agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("target").alias("s")))
    upto = Window.partitionBy("node", "f").orderBy("b")
    whole = Window.partitionBy("node", "f")
    cells = cells.select("node", "f", "b", F.sum("c").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"),
                         F.sum("c").over(whole).alias("wt"), F.sum("s").over(whole).alias("st"))
    wr, sr = F.col("wt") - F.col("wl"), F.col("st") - F.col("sl")
    gain = F.round(F.try_divide(F.col("sl") * F.col("sl"), F.col("wl")) + F.try_divide(sr * sr, wr) - F.col("st") * F.col("st") / F.col("wt"), 9)
    able = (F.col("wl") >= min_leaf) & (wr >= min_leaf) & (gain > 0)
    way = F.when(able, F.struct((-gain).alias("less"), "f", "b"))
    return cells.groupBy("node").agg(F.max("wt").alias("n"), F.max(F.when(F.col("f") == 0, F.col("st"))).alias("s"), F.min(way).alias("way")).select(
        "node", "n", (F.col("s") / F.col("n")).alias("value"), (-F.col("way.less")).alias("gain"), F.col("way.f").alias("feature"),
        F.col("way.b").alias("bin"))


def grow_table(rows: DataFrame, max_depth: int, min_leaf: float = 1, min_split: float = 2):
    """One tree over all of ``rows(key, codes, target)``: ({heap number: (n, value, gain, feature, bin, leaf)}, rows with ``node``).

    A level is one aggregate; what comes back to the driver is a tree of the given depth, and
    goes to the rows as one expression.  Children of node k are 2k (at most the bin) and 2k + 1.
    """
    rows, found = rows.withColumn("node", F.lit(1).cast("long")), {}
    for depth in range(max_depth + 1):
        active = [n for n in range(2 ** depth, 2 ** (depth + 1)) if depth == 0 or not found.get(n // 2, (0,) * 5 + (True,))[5]]
        if not active:
            break
        at = rows if depth == 0 else rows.filter(F.col("node").isin(active))
        for r in level_splits(at, min_leaf).collect():          # at most 2^depth rows
            leaf = depth == max_depth or r["n"] < min_split or r["feature"] is None
            found[r["node"]] = (r["n"], r["value"], r["gain"], r["feature"], r["bin"], leaf)
        moves = {n: found[n] for n in active if n in found and not found[n][5]}
        if not moves:
            break
        rows = step_down(rows, moves)
    return found, rows


def step_down(rows: DataFrame, moves: dict[int, tuple]) -> DataFrame:
    """Rows of the nodes that split go to a child."""
    table = F.create_map(*[x for n, (_, _, _, f, b, _) in moves.items() for x in (F.lit(n).cast("long"), F.struct(F.lit(f).alias("f"), F.lit(b).alias("b")))])
    way = F.try_element_at(table, F.col("node"))
    right = (F.get("codes", way["f"]) > way["b"]).cast("long")
    return rows.withColumn("node", F.when(way.isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node")))


def boost_table(rows: DataFrame, rounds: int, max_depth: int, rate: float, min_leaf: float = 1, min_split: float = 2):
    """Boosting with log loss over all of ``rows(key, codes, label)``: (log odds at the start, the trees as
    {heap number: (n, value, gain, feature, bin, leaf)} with Newton leaf values, rows with their score ``z``).

    A round costs one aggregate a level, one for the leaves, and one write of the rows' scores.
    """
    rows = checkpointed(rows)                                   # every level of the first round reads it
    mean = rows.agg(F.avg("label").alias("m")).first()["m"]
    first = float(np.log(mean / (1 - mean)))
    rows, trees = rows.withColumn("z", F.lit(first)), []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.col("z")))
        found, placed = grow_table(rows.withColumn("target", F.col("label") - p), max_depth, min_leaf, min_split)
        p = F.col("label") - F.col("target")
        step = placed.groupBy("node").agg(F.sum("target").alias("t"), F.sum(p * (1 - p)).alias("b")).collect()    # the leaves
        value = {r["node"]: r["t"] / r["b"] if r["b"] > 1e-150 else 0.0 for r in step}
        trees.append({n: (c, value.get(n, v), g, f, b, leaf) for n, (c, v, g, f, b, leaf) in found.items()})
        leaf = F.create_map(*[x for n, v in value.items() for x in (F.lit(n).cast("long"), F.lit(float(v)))])
        rows = checkpointed(placed.withColumn("z", F.col("z") + rate * F.element_at(leaf, F.col("node"))).drop("target", "node"))
    return first, trees, rows
