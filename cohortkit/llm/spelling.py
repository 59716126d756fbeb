"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word becomes a vector of how often it has a letter of each group (``GROUPS``).  The
trie arranges words by the successive counts.  One edit changes the vector by one
surplus letter, one missing letter, or one of each, so a depth-first search for a
word's neighbours spends a budget of one surplus and one deficit on the way down and
leaves every branch that needs more.  Words in the leaves it reaches are verified.

1. The vocabulary is counted natively; partial counts leave a task, never texts.
2. The top of the trie (nodes with more than ``CELL_WORDS`` words, and their children)
   is found from counts of the vectors' prefixes.  It has at most ``MAX_CELLS`` large
   nodes a level, so it goes to every task.  Its leaves are the cells.  Words that have
   the same first ``TOP_LEVELS`` counts and are still too many are dealt to blocks.
3. Every word walks the top of the trie with its budget and goes to each cell it
   reaches; in its own cell it is also stored.
4. In a cell the stored words form the rest of the trie; the visitors stream by in
   chunks, and one depth-first walk serves a chunk: at a node the words that still have
   the budget go on.  A task holds one cell and one chunk.
5. Only a count and the best neighbour leave a cell for each word, never pairs.

A word's form is its commonest neighbour if that is ``RATIO`` times as common; the root
is found by pointer doubling, a few rounds since counts grow by ``RATIO`` a step.

Defined cases: a NULL or empty text has no words; a NULL ``doc_id`` is an empty string in
the checksum; ties go to the word that is smallest in code-point order; rows that repeat
count each; words of any length take part; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sql_bits, sql_crc32, written

# Fixed value: the letters of a word, after lower-casing A-Z.
LETTERS = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
# The levels of the trie, the last one holds all other letters
GROUPS = ("e", "a", "i", "n", "r", "t", "o", "s", "l", "u", "h", "d", "c", "g", "m", "p", "bv", "fw", "yj", "kqxz", "")
TOP_LEVELS = 12
CELL_WORDS = 32768
MAX_CELLS = 4096
MOST = 255              # counts are cut here, which never adds to a difference
LEAF_WORDS = 16
CHUNK = 65536           # visitors of one walk
PAIRS = 1 << 18         # pairs verified at once
PLAIN_CHARS = 64        # longer words are verified one by one


def vocabulary(docs: DataFrame, damage: int | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n); ``damage`` deletes a letter from every so many-th pair of document and word, by checksum."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))).alias("word"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def group_table():
    import numpy as np
    table = np.full(256, len(GROUPS) - 1)
    for i, letters in enumerate(GROUPS):
        for c in letters:
            table[ord(c)] = i
    return table


def letters_of(words: list[str]):
    """All letters in one array, and the words' lengths."""
    import numpy as np
    return (np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))


def vectors(words: list[str]):
    """A row of counts for each word."""
    import numpy as np
    flat, lengths = letters_of(words)
    place = np.repeat(np.arange(len(words)) * len(GROUPS), lengths) + group_table()[flat]
    counts = np.bincount(place, minlength=len(words) * len(GROUPS)).reshape(len(words), len(GROUPS))
    return np.minimum(counts, MOST).astype(np.int16)


def spend(counts, value, surplus, deficit):
    """Which words can enter the branch with this count, and what they have then spent."""
    import numpy as np
    diff = counts - value
    surplus, deficit = surplus + np.maximum(diff, 0), deficit + np.maximum(-diff, 0)
    return np.flatnonzero((surplus <= 1) & (deficit <= 1)), surplus, deficit


class Top:
    """The upper part of the trie: ``large`` nodes have children, other nodes are cells."""

    def __init__(self, nodes: list[tuple[bytes, int]], cell_words: int):
        """``nodes``: the root's and the large nodes' children as (prefix, number of words)."""
        self.children, self.cells = {}, {}
        for prefix, n in sorted(nodes):
            if prefix:
                self.children.setdefault(prefix[:-1], []).append(prefix[-1])
            if n <= cell_words or len(prefix) == TOP_LEVELS:
                self.cells[prefix] = (len(self.cells), max(1, ceil(n / cell_words)))

    def walk(self, v):
        """(cell, its blocks, rows of ``v`` that reach it, whether they need no budget for it)."""
        import numpy as np
        zero = np.zeros(len(v), np.int16)
        stack = [(b"", np.arange(len(v)), zero, zero)]
        while stack:
            prefix, rows, surplus, deficit = stack.pop()
            if prefix in self.cells:
                yield *self.cells[prefix], rows, (surplus == 0) & (deficit == 0)
                continue
            for value in self.children.get(prefix, ()):
                on, s, d = spend(v[rows, len(prefix)], value, surplus, deficit)
                if len(on):
                    stack.append((prefix + bytes([value]), rows[on], s[on], d[on]))


def top_of(words: DataFrame, cell_words: int) -> Top:
    """Counts of the vectors' prefixes, level by level under the nodes that are still large."""
    import pyarrow as pa
    total = words.count()
    cell_words = max(cell_words, ceil(total / MAX_CELLS))

    def keys(batches):
        for b in batches:
            v = vectors(b.column(0).to_pylist())[:, :TOP_LEVELS].astype("uint8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary())], names=["key"])
    counted = written(words.select("word").mapInArrow(keys, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "spelling-keys")
    nodes = [(b"", total)]
    if total > cell_words:
        prefixes = counted.select("n", F.explode(F.sequence(F.lit(0), F.lit(TOP_LEVELS))).alias("level"), "key").groupBy(
            F.col("level"), F.substring("key", F.lit(1), F.col("level")).alias("prefix")).agg(F.sum("n").alias("n"))
        prefixes = written(prefixes, "spelling-prefixes")
        large = prefixes.filter((F.col("n") > cell_words) & (F.col("level") < TOP_LEVELS)).select(
            (F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
        below = prefixes.filter("level > 0").withColumn("parent", F.substring("prefix", F.lit(1), F.col("level") - 1))
        nodes += [(bytes(r["prefix"]), r["n"]) for r in below.join(large, ["level", "parent"], "left_semi").select("prefix", "n").collect()]
    return Top(nodes, cell_words)


def routed(words: DataFrame, top: Top) -> DataFrame:
    """(cell, block, visits, word, n): every word in its own cell, and as a visitor where its budget leads."""
    import pyarrow as pa

    def route(batches):
        import zlib

        import numpy as np
        names = ["cell", "block", "visits", "word", "n"]
        for b in batches:
            v = vectors(b.column(0).to_pylist())
            for cell, blocks, rows, free in top.walk(v):
                rows_in = b.take(pa.array(rows))
                own = np.array([zlib.crc32(w.encode()) % blocks for w in rows_in.column(0).to_pylist()]) if blocks > 1 else np.zeros(len(rows), int)
                for k in range(blocks):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), cell), pa.int32()), pa.array(np.full(len(rows), k), pa.int32()),
                        pa.array(~(free & (own == k))), rows_in.column(0), rows_in.column(1)], names=names)
    return words.select("word", "n").mapInArrow(route, "cell int, block int, visits boolean, word string, n long")


class Cell:
    """The stored words of a cell as the lower part of the trie."""

    def __init__(self, words: list[str], counts):
        import numpy as np
        self.words, self.n = words, counts
        self.v = vectors(words)
        self.order = np.lexsort(self.v.T[::-1])             # trie order
        self.sorted = self.v[self.order]
        self.rank = np.empty(len(words), np.int64)          # code-point order
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.text = Text(words)

    def reached(self, v):
        """(rows of ``v``, stored words) of the pairs that the depth-first walk leaves within the budget."""
        import numpy as np
        zero = np.zeros(len(v), np.int16)
        stack = [(0, len(self.order), 0, np.arange(len(v)), zero, zero)]
        while stack:
            lo, hi, level, rows, surplus, deficit = stack.pop()
            if hi - lo <= LEAF_WORDS or level == len(GROUPS):
                for a in range(0, hi - lo, LEAF_WORDS):
                    leaf = slice(lo + a, min(lo + a + LEAF_WORDS, hi))
                    for i in range(0, len(rows), 8192):
                        some = slice(i, i + 8192)
                        diff = v[rows[some], None, level:] - self.sorted[None, leaf, level:]
                        s = surplus[some, None] + np.maximum(diff, 0).sum(2)
                        d = deficit[some, None] + np.maximum(-diff, 0).sum(2)
                        x, y = np.nonzero((s <= 1) & (d <= 1))
                        if len(x):
                            yield rows[some][x], self.order[leaf][y]
                continue
            column = self.sorted[lo:hi, level]
            starts = np.flatnonzero(np.diff(column, prepend=-1))
            counts = v[rows, level]
            for a, b in zip(starts, [*starts[1:], hi - lo]):
                on, s, d = spend(counts, column[a], surplus, deficit)
                if len(on):
                    stack.append((lo + a, lo + b, level + 1, rows[on], s[on], d[on]))

    def best(self, words: list[str]):
        """Rows of ``words`` that have neighbours here, how many, and the best one's row."""
        import numpy as np
        text, left, right, size = Text(words), [], [], 0
        near_left, near_right = [], []

        def verify():
            x, y = np.concatenate(left), np.concatenate(right)
            for i in range(0, len(x), PAIRS):
                ok = near(text, x[i:i + PAIRS], self.text, y[i:i + PAIRS])
                near_left.append(x[i:i + PAIRS][ok])
                near_right.append(y[i:i + PAIRS][ok])
        for x, y in self.reached(vectors(words)):
            left.append(x)
            right.append(y)
            size += len(x)
            if size >= PAIRS:
                verify()
                left, right, size = [], [], 0
        if left:
            verify()
        if not near_left:
            return [], [], []
        x, y = np.concatenate(near_left), np.concatenate(near_right)
        order = np.lexsort((self.rank[y], -self.n[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        return x[first], np.diff([*first, len(x)]), y[first]


class Text:
    """Words as rows of letters, from the left and from the right, short ones filled with zeros."""

    def __init__(self, words: list[str]):
        import numpy as np
        self.words = words
        flat, self.length = letters_of(words)
        width = min(PLAIN_CHARS, int(self.length.max(initial=0)))
        self.left, self.right = np.zeros((2, len(words), width), np.uint8)
        start = np.cumsum(self.length) - self.length
        cut = np.minimum(self.length, width)
        rows = np.repeat(np.arange(len(words)), cut)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(cut) - cut, cut)
        self.left[rows, place] = flat[start[rows] + place]
        self.right[rows, place] = flat[(start + self.length - 1)[rows] - place]


def one_edit(a: str, b: str) -> bool:
    """Do two words differ by one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)                                     # the longest common prefix, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + (len(a) == len(b)):] == b[lo + 1:]


def near(text: Text, x, other: Text, y):
    """Which pairs are one edit apart: their common beginning and end cover all but the edit."""
    import numpy as np
    la, lb = text.length[x], other.length[y]
    short = np.minimum(la, lb)
    width = min(text.left.shape[1], other.left.shape[1])

    def common(a, b):
        differs = a[x, :width] != b[y, :width]
        return np.minimum(np.where(differs.any(1), differs.argmax(1), width), short)
    covered = common(text.left, other.left) + common(text.right, other.right)
    out = np.where(la == lb, covered == la - 1, (np.abs(la - lb) == 1) & (covered >= short))
    for i in np.flatnonzero(np.maximum(la, lb) > width):
        out[i] = one_edit(text.words[x[i]], other.words[y[i]])
    return out


def cell_stream(batches):
    """(key, visits, word, n) runs of sorted batches as lists, at most ``CHUNK`` words at a time for visitors."""
    import numpy as np
    key, kind, words, counts = None, None, [], []
    for b in batches:
        cell, block, visits = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        texts, n = b.column(3).to_pylist(), b.column(4).to_numpy()
        change = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
                                | (np.diff(visits.astype(int), prepend=-1) != 0))
        for a, e in zip(change, [*change[1:], len(texts)]):
            now = (cell[a], block[a]), bool(visits[a])
            if now != (key, kind) or (kind and len(words) >= CHUNK):
                if words:
                    yield key, kind, words, np.concatenate(counts)
                (key, kind), words, counts = now, [], []
            words.extend(texts[a:e])
            counts.append(n[a:e])
    if words:
        yield key, kind, words, np.concatenate(counts)


def searched(rows: DataFrame, cells: int) -> DataFrame:
    """(word, near, best_n, best): neighbours of each word in each cell it came to, and the commonest."""
    import pyarrow as pa

    def search(batches):
        stored, where = None, None
        for key, visits, words, counts in cell_stream(batches):
            if not visits:
                stored, where = Cell(words, counts), key
            if where != key:
                continue                                    # nothing is stored here
            for i in range(0, len(words), CHUNK):
                some = words[i:i + CHUNK]
                x, near_by, y = stored.best(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([some[k] for k in x], pa.string()), pa.array(near_by, pa.int64()),
                    pa.array([stored.n[k] for k in y], pa.int64()), pa.array([stored.words[k] for k in y], pa.string())],
                    names=["word", "near", "best_n", "best"])
    dealt = rows.repartition(cells, "cell", "block").sortWithinPartitions("cell", "block", "visits")
    return dealt.mapInArrow(search, "word string, near long, best_n long, best string")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): follow (word, root) links to their ends; links must not form a circle."""
    while True:
        a, b = links.alias("a"), links.alias("b")
        links = written(a.join(b, F.col("a.root") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``words(word, n)``."""
    words = written(words, "spelling-words")
    top = top_of(words, cell_words)
    found = searched(routed(words, top), max(1, sum(b for _, b in top.cells.values())))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top"))
    form = F.when(-F.col("top.less") >= ratio * F.col("n"), F.col("top.best"))
    judged = written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("top.less")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read_table(spark, sf_dir, "documents"), DAMAGE))


_LETTERS_SQL = "[a-zÀ-ÿ]"
OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_LETTERS_SQL}{{{MIN_CHARS},}}')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {sql_crc32(sql_bits("id || ':' || run"))} AS h FROM counted),
damaged AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
holes AS (
  SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word AS long, w.word AS short, h.n AS long_n, w.n AS short_n FROM holes AS h JOIN words AS w ON h.head || h.tail = w.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes AS a JOIN holes AS b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM shorter
  UNION ALL SELECT short, long, long_n FROM shorter),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (rest = 1) AS other
  FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY other_n DESC) AS rest FROM near) GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN other END AS form,
         CASE WHEN top >= {RATIO} * n THEN top END AS form_n
  FROM words AS w LEFT JOIN best AS b ON w.word = b.word),
chain AS (
  SELECT word, form AS root, 1 AS steps FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT c.word, j.form, steps + 1 FROM chain AS c JOIN judged AS j ON c.root = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT j.word, j.form, coalesce(e.root, j.word) AS root, j.n, j.n_near, j.form_n FROM judged AS j LEFT JOIN ends AS e ON j.word = e.word"""
