"""Secret scan: named patterns, and sliding-window entropy over candidate strings.

Base spans come from three patterns: values assigned to a telling name, access key
ids and long runs of lower-case hex digits.  The method adds spans of high entropy.
For each character class (``CLASSES``) a candidate string is a maximal run of the
class with ``WINDOW`` characters or more.  A window of that width slides along it;
the counts of its characters change by one in and one out a step, and with them the
sum of c * log2(c) over the counts, kept in millionths as a whole number.  The
window's Shannon entropy is log2(WINDOW) - sum / WINDOW, so a class threshold is an
upper bound on the sum.  Windows that reach the threshold and overlap or touch make
one span.  Candidates on the allow list leave before the windows: runs that are
words, numbers, UUIDs, alphabets or placeholders, and runs that follow the name of
a checksum (``ALLOWED``, ``ALLOWED_AFTER``).

Everything is DataFrame functions on the row itself: no shuffle, and a text of any
length costs time linear in its length.  The window's counts are one string with a
place for each character of the class, the places of the spans are two-level
running sums.

Defined cases: a NULL text is empty and has no span; rows that repeat are each
reported; a NULL ``doc_id`` stays NULL; an empty table gives no rows; other columns
are not read; spans of one start go in the order of ``KINDS``.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns. Group 2 of ASSIGN is the value.
_NAMES = "|".join(["password", "passwd", "secret", "token", "api_?key"])
ASSIGN = ("(" + "|".join(_either_case(n) for n in _NAMES.split("|")) + ")"
          + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

WINDOW = 20
SCALE = 1_000_000
# character class -> (regex class, least entropy of a window in bits)
CLASSES = {"entropy_hex": ("[0-9A-Fa-f]", 3.0), "entropy_base64": ("[A-Za-z0-9+/_=-]", 3.7)}
KINDS = ["assign", "access", "hex", *CLASSES]
# Candidates that are no secrets, whole string
ALLOWED = [
    r"^[0-9]+$",
    r"^[A-Za-z]?[a-z]+([-_/=+]+[A-Za-z]?[a-z]+)*[-_/=+]*$",
    r"^[A-Z]+([-_/=+]+[A-Z]+)*[-_/=+]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx]{6}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
]
# Names of checksums and identifiers right before a candidate
ALLOWED_AFTER = r"""([Ss][Hh][Aa][0-9]+|[Mm][Dd]5|[Cc]hecksum|[Dd]igest|[Cc]ommit|[Uu][Uu][Ii][Dd])["']?\x20*[:=-]?\x20*["']?\z"""
AFTER_CHARS = 24


def weight(c: int) -> int:
    """c * log2(c) in millionths."""
    return round(SCALE * c * log2(c)) if c else 0


def most(entropy: float, window: int = WINDOW) -> int:
    """The largest sum of weights with which a window still has this entropy."""
    return int(SCALE * window * (log2(window) - entropy))


def running(steps: Column, block: int = 64) -> Column:
    """Running sums (inclusive) of an array of ints: inside blocks, plus the blocks' own running sums."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, block))
    ).otherwise(F.array().cast("array<array<int>>"))
    before = lambda bs: F.aggregate(
        bs, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
        lambda s, b: F.struct((s["sum"] + total(b)).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")))["all"]
    return let(blocks, lambda bs: let(before(bs), lambda offs: F.flatten(F.transform(bs, lambda b, k: F.transform(
        b, lambda _, i: F.get(offs, k) + total(F.slice(b, 1, i + 1)))))))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (found, before, start, end): the matched string, up
    to ``AFTER_CHARS`` characters before it, and its place in code points, end exclusive."""
    none = F.array().cast("array<struct<found:string,before:string,start:int,end:int>>")

    def placed(found, gaps):
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, x: F.length(g) + F.length(x)))
        return let(ends, lambda e: F.transform(found, lambda x, i: F.struct(
            x.alias("found"), F.right(F.get(gaps, i), F.lit(AFTER_CHARS)).alias("before"),
            (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))))


def allowed(candidate: Column) -> Column:
    out = candidate["before"].rlike(ALLOWED_AFTER)
    for p in ALLOWED:
        out = out | candidate["found"].rlike(p)
    return out


def high_windows(found: Column, entropy: float, window: int = WINDOW) -> Column:
    """(start, end) inside the string of the joined windows that have the entropy.

    One pass with the state (counts, sum, place, from, to, spans): ``counts`` has a
    character for each of the 128 ASCII codes, whose code is 48 + the count of that
    code in the window; ``from`` and ``to`` are the span that is still growing.
    """
    gain = F.array(*[F.lit(weight(c) - weight(c - 1)).cast("long") for c in range(1, window + 1)])
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, 1)) - 48
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 48), code + 1, 1)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    closed = lambda s: F.when(s["to"] > 0, F.concat(s["spans"], F.array(span(s["from"], s["to"])))).otherwise(s["spans"])
    start = F.struct(F.lit("0" * 128).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("place"), F.lit(0).alias("from"),
                     F.lit(0).alias("to"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def leave(s, x):
        n = count(s["counts"], x["out"])
        gone = let(n, lambda c: F.struct(put(s["counts"], x["out"], c - 1).alias("counts"),
                                         (s["sum"] - F.get(gain, c - 1)).alias("sum")))
        return F.when(x["out"] >= 0, gone).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))

    def enter(t, x):
        return let(count(t["counts"], x["in"]), lambda c: F.struct(
            put(t["counts"], x["in"], c + 1).alias("counts"), (t["sum"] + F.get(gain, c)).alias("sum")))

    def step(s, x):
        def after(t):
            end = s["place"] + 1
            high = (end >= window) & (t["sum"] <= F.lit(most(entropy, window)))
            joins = (s["to"] > 0) & (s["to"] >= end - window)
            opened = high & ~joins
            return F.struct(
                t["counts"].alias("counts"), t["sum"].alias("sum"), end.alias("place"),
                F.when(opened, end - window).otherwise(s["from"]).alias("from"),
                F.when(high, end).otherwise(s["to"]).alias("to"),
                F.when(opened, closed(s)).otherwise(s["spans"]).alias("spans"))
        return let(let(leave(s, x), lambda t: enter(t, x)), after)

    codes = F.transform(F.split(found, ""), lambda c: F.ascii(c))
    pairs = let(codes, lambda c: F.transform(c, lambda code, i: F.struct(
        code.alias("in"), F.when(i >= window, F.get(c, i - window)).otherwise(-1).alias("out"))))
    return F.aggregate(pairs, start, step, closed)


def entropy_spans(text: Column, kind: str, window: int = WINDOW) -> Column:
    chars, entropy = CLASSES[kind]
    found = F.filter(matches(text, f"{chars}{{{window},}}"), lambda m: ~allowed(m))
    return F.flatten(F.transform(found, lambda m: F.transform(high_windows(m["found"], entropy, window), lambda w: F.struct(
        (m["start"] + w["start"]).alias("start"), (m["start"] + w["end"]).alias("end")))))


def base_spans(text: Column, kind: str) -> Column:
    pattern, enough = {
        "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= VALUE_CHARS),
        "access": (ACCESS, lambda m: F.length(m["found"]) >= ACCESS_CHARS),
        # runs of hex digits are maximal, so a bound on the run is a bound on the match
        "hex": (f"[0-9a-f]{{{HEX_CHARS},}}", lambda m: F.lit(True)),
    }[kind]
    return F.transform(F.filter(matches(text, pattern), enough), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and one array of (start, end) for each kind of ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *[(entropy_spans(text, k, window) if k in CLASSES else base_spans(text, k)).alias(k) for k in KINDS])


def digest(kinds: list[str]) -> Column:
    """kind:start:end of all spans of the kinds, by start, then kind as listed, comma-joined."""
    def of(kind):
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), s["end"].alias("end")))
    spans = F.concat(*[of(k) for k in kinds])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["nth"]), s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = KINDS[:3]
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(digest(base), 256).alias("base_sha256"), digest(KINDS).alias("spans"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """The same in SQL, windows counted afresh one by one."""
    finds = {"assign": ASSIGN, "access": ACCESS, "hex": f"[0-9a-f]{{{HEX_CHARS},}}",
             **{k: f"{c}{{{WINDOW},}}" for k, (c, _) in CLASSES.items()}}
    found = " UNION ALL ".join(
        f"SELECT row, {i} AS nth, '{k}' AS kind, regexp_extract_all(text, {_quoted(p)}) AS hits, "
        f"string_split_regex(text, {_quoted(p)}) AS gaps FROM docs" for i, (k, p) in enumerate(finds.items()))
    allow = " OR ".join([f"regexp_matches(before, {_quoted(ALLOWED_AFTER)})", *[f"regexp_matches(hit, {_quoted(p)})" for p in ALLOWED]])
    weights = "[" + ", ".join(str(weight(c)) for c in range(1, WINDOW + 1)) + "]"
    limits = " ".join(f"WHEN '{k}' THEN {most(e)}" for k, (_, e) in CLASSES.items())
    text = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
hits AS (
  SELECT row, nth, kind, hit, right(gap, {AFTER_CHARS}) AS before, i,
         (sum(length(gap) + length(hit)) OVER (PARTITION BY row, nth ORDER BY i))::BIGINT AS b
  FROM (SELECT row, nth, kind, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i
        FROM found WHERE len(hits) > 0)),
base AS (
  SELECT row, nth, kind, b - length(hit) AS a, b FROM hits
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, {_quoted(ASSIGN)}, 2)) >= {VALUE_CHARS}
                  WHEN 'access' THEN length(hit) >= {ACCESS_CHARS} WHEN 'hex' THEN true ELSE false END),
candidates AS (
  SELECT row, nth, kind, hit, b - length(hit) AS a FROM hits WHERE kind LIKE 'entropy%' AND NOT ({allow})),
windows AS (
  SELECT row, nth, kind, hit, a, unnest(range(length(hit) - {WINDOW} + 1)) AS w FROM candidates),
counted AS (
  SELECT row, nth, kind, a, w, ch, count(*) AS c
  FROM (SELECT row, nth, kind, a, w, unnest(string_split(substr(hit, w + 1, {WINDOW}), '')) AS ch FROM windows) GROUP BY ALL),
high AS (
  SELECT row, nth, kind, a, w FROM counted GROUP BY ALL HAVING sum({weights}[c]) <= CASE kind {limits} END),
marked AS (
  SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY row, nth, a ORDER BY w) <= {WINDOW} THEN 0 ELSE 1 END AS opens FROM high),
joined AS (
  SELECT *, sum(opens) OVER (PARTITION BY row, nth, a ORDER BY w) AS island FROM marked),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT row, nth, kind, a + min(w) AS a, a + max(w) + {WINDOW} AS b FROM joined GROUP BY row, nth, kind, joined.a, island),
summed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {text} FILTER (nth < 3) AS base, {text} AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (row)"""


OP13_SQL = _sql()
