"""Quality rules with risk-controlled thresholds.

Every document gets base measures and, from them, integer scores in permille
where a higher score is worse (``SCORES``).  A policy level gives each score a
cutoff; a document is rejected at the first level one of its scores exceeds.
Labels choose the level, per stratum, with a guarantee:

1. The labelled documents are dealt into a selection part and a holdout part by
   a hash.  On the selection part, level L sets every score's cutoff from the
   smallest value that at most a share of the good documents exceed, with a margin
   at the first levels (``LEVELS``).  Levels are nested: a higher level never
   rejects less.
2. On the holdout part, level L is certified if the exact binomial probability
   of seeing so few good documents rejected, were their true share ``ALPHA``, is
   at most ``DELTA / strata``; that holds exactly when the Clopper-Pearson upper
   bound of the share is below ``ALPHA``.  Strata share the error by Bonferroni;
   within a stratum the nested levels are tested in order and testing stops at
   the first failure (fixed-sequence testing, which needs no further share).
   So with probability 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its
   good documents.
3. Of the certified levels the one with the best trade on the selection part is
   used; a stratum without a certified level keeps all that pass the base rules.

All labelled documents count.  Only histograms (stratum x score x 1001 values)
reach the windows, so a stratum holding most rows is summed map-side first.

Defined cases: a NULL or empty text has no words and fails the base rules; a
NULL stratum is a stratum of its own; labels with NULL quality are ignored and a
document labelled both ways counts as bad; repeated rows are judged separately;
an empty ``labels`` table certifies nothing; extra columns of the documents are
passed on by ``judge`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_CHARS, let, read_table, whole_row, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
ALPHA = 0.05      # largest share of good documents that a stratum may lose
DELTA = 0.05      # probability with which the guarantee may fail
# Levels from lax to strict: (share of good documents above the value, factor, extra);
# the cutoff is the value times the factor plus extra.  The first leave a margin above
# all good documents seen, which small holdouts need.
LEVELS = ((0.0, 4.0, 100), (0.0, 2.0, 50), (0.0, 1.5, 25), (0.0, 1.0, 10), (0.0, 1.0, 0), (0.0005, 1.0, 0),
          (0.001, 1.0, 0), (0.002, 1.0, 0), (0.005, 1.0, 0), (0.01, 1.0, 0), (0.02, 1.0, 0), (0.03, 1.0, 0))
GOOD_COST = 10    # rejected good share counts this many times the caught bad share
STRATUM = "lang"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the list.

    Windows are compared by their 64-bit hashes inside one document.  A document
    without repeats is recognised by a hash set; only the others are sorted.
    """
    def covered(h):
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        def places(s):
            twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))
        return let(let(tagged, places), lambda p: F.aggregate(
            F.transform(p, lambda v, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width), v - F.get(p, j - 1)))),
            F.lit(0), lambda a, x: a + x))
    def of(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))
    return let(w, of)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """Add the base measures and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACE_CHARS[1:], " " * 5))) > 0)
    out = docs.withColumns({
        "_words": words(F.col("text")),
        "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.col("_lines.n") - F.col("_lines.d")).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "n_lines": F.col("_lines.n").cast("long"),
        "n_upper": _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_shouts": _count_of(text, "!?").cast("long"),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def _permille(part: str, whole: str) -> Column:
    return F.least(F.lit(1000), F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))).cast("int")


# score: (part, whole) in permille; a higher score is worse
SCORES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_upper", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}


def scores_map() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("rule"), _permille(*parts).alias("score"))
                     for name, parts in SCORES.items()])


def log_factorial(m: Column) -> Column:
    """ln(m!): exact to 20, then Stirling's series (error below 1e-13)."""
    x = m.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3.0))
              + 1 / (1260 * F.pow(x, 5.0)))
    return F.when(m <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), for k below the mean; 1 from the mean on.

    The terms below k fall at least geometrically, so a number of them in the
    order of the standard deviation holds the sum to double precision.
    """
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(20 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    def step(a, j):
        i = k - j
        t = a["t"] * (i + 1) * (1 - p) / ((n - i) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.pow(F.lit(1 - p), n.cast("double"))).otherwise(F.exp(top) * total)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = STRATUM, alpha: float = ALPHA,
               delta: float = DELTA, levels=LEVELS) -> DataFrame:
    """(stratum, level, certified p-value, used, one cutoff per score)."""
    truth = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("good")))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("split|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 2
    known = (measured.filter(~F.col("base_failed"))
             .select("doc_id", F.col(stratum).alias("stratum"), scores_map().alias("scores"))
             .join(truth, "doc_id").select("stratum", "scores", "good", part.alias("part")))
    known = written(known, "quality-known")

    # selection part: cutoffs from the histogram of good documents
    each = known.filter((F.col("part") == 0) & (F.col("good") == 1)).select("stratum", F.explode("scores").alias("s"))
    hist = each.groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.score").alias("score")).agg(
        F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("stratum", "rule").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumns({"above": F.coalesce(F.sum("n").over(down), F.lit(0)),
                             "total": F.sum("n").over(W.partitionBy("stratum", "rule"))})
    steps = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(float(m)).alias("m"), F.lit(int(x)).alias("x"))
                      for q, m, x in levels])
    levelled = hist.select("*", F.posexplode(steps).alias("level", "step"))
    cut = (levelled.filter(F.col("above") <= F.col("step.q") * F.col("total"))
           .groupBy("stratum", "level", "rule")
           .agg(F.min(F.floor(F.col("score") * F.col("step.m")).cast("int") + F.col("step.x")).alias("cutoff")))
    wide = cut.groupBy("stratum", "level").agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in SCORES])
    wide = written(wide.withColumnRenamed("stratum", "_stratum"), "quality-cutoffs")

    # both parts: how many documents every level rejects
    fails = None
    for i, r in enumerate(SCORES):
        f = F.col("scores")[i]["score"] > F.col(r)
        fails = f if fails is None else fails | f
    counts = known.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum"))).groupBy("_stratum", "level").agg(
        F.sum(F.when((F.col("part") == 1) & (F.col("good") == 1), 1).otherwise(0)).alias("n"),
        F.sum(F.when((F.col("part") == 1) & (F.col("good") == 1) & fails, 1).otherwise(0)).alias("k"),
        F.sum(F.when((F.col("part") == 0) & (F.col("good") == 1), 1).otherwise(0)).alias("sel_good"),
        F.sum(F.when((F.col("part") == 0) & (F.col("good") == 1) & fails, 1).otherwise(0)).alias("sel_good_hit"),
        F.sum(F.when((F.col("part") == 0) & (F.col("good") == 0), 1).otherwise(0)).alias("sel_bad"),
        F.sum(F.when((F.col("part") == 0) & (F.col("good") == 0) & fails, 1).otherwise(0)).alias("sel_bad_hit"))
    strata = F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    tested = counts.withColumns({"p_value": binomial_cdf(F.col("k"), F.col("n"), alpha), "strata": strata})
    passed = F.col("p_value") <= F.lit(delta) / F.col("strata")
    chain = W.partitionBy("_stratum").orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    tested = tested.withColumn("certified", F.min(F.when(passed, 1).otherwise(0)).over(chain) == 1)
    gain = (F.col("sel_bad_hit") / F.greatest(F.col("sel_bad"), F.lit(1))
            - GOOD_COST * F.col("sel_good_hit") / F.greatest(F.col("sel_good"), F.lit(1)))
    best = W.partitionBy("_stratum", "certified").orderBy(F.desc("gain"), "level")
    tested = tested.withColumn("gain", gain).withColumn(
        "used", F.col("certified") & (F.row_number().over(best) == 1)).withColumnsRenamed(
        {"_stratum": "_st", "level": "_lv"})
    return (wide.join(tested, F.col("_stratum").eqNullSafe(F.col("_st")) & (F.col("level") == F.col("_lv")))
            .select(F.col("_stratum").alias("stratum"), "level", "n", "k", "p_value", "certified", "gain", "used",
                    *SCORES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = STRATUM, alpha: float = ALPHA,
          delta: float = DELTA, levels=LEVELS, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the ``carry`` columns of the input, all by default), the base
    measures, ``base_failed``, ``level`` (NULL: none certified) and ``kept``.

    Documents are measured once; clashing column names are kept apart by
    carrying the input row as one struct.
    """
    row = whole_row(docs, carry).alias("_row")
    measured = written(measure(docs.select(row, "doc_id", "text", stratum)).drop("text"), "quality-measured")
    used = thresholds(measured.drop("_row"), labels, stratum, alpha, delta, levels).filter("used").select(
        F.col("stratum").alias("_stratum"), F.col("level").alias("_level"), *SCORES)
    used = written(used, "quality-used")     # its true size lets the planner send it to the documents
    fails = F.lit(False)
    for r, parts in SCORES.items():
        fails = fails | (_permille(*parts) > F.col(r))
    judged = measured.join(used, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(fails, F.lit(False))
    return judged.select("_row", *BASE, "base_failed", F.col("_level").alias("level"), kept.alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return judge(docs, labels, carry=["doc_id"]).select("_row.doc_id", *BASE, "base_failed", "kept")


def _score_sql(name: str) -> str:
    part, whole = SCORES[name]
    return f"least(1000, floor(1000 * {part}::double / greatest({whole}, 1)))::int"


_SPACE = "[\\x20\\x09-\\x0D]"
_FAILS = " or ".join(f"{_score_sql(r)} > c_{r}" for r in SCORES)
OP2_SQL = f"""
with w as (
  select *, row_number() over () as rid, coalesce(text, '') as t,
         case when text is null then [] else regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') end as ws from documents),
lines as (select rid, unnest(string_split(t, chr(10))) as line from w),
line_counts as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from lines where length(regexp_replace(line, '{_SPACE}', '', 'g')) > 0 group by rid),
wins as (
  select rid, i, array_to_string(ws[i:i + 4], ' ') as win
  from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) > 5)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from wins) where c > 1),
cov as (select rid, count(distinct i + k) as n_repeat_words
        from dup, (select unnest(range(0, 5)) as k) group by rid),
m as (
  select w.doc_id, w.{STRATUM} as stratum, len(ws)::bigint as n_words,
         length(regexp_replace(t, '{_SPACE}', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0)::bigint as n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper,
         length(regexp_replace(t, '[^!?]', '', 'g'))::bigint as n_shouts
  from w left join line_counts using (rid) left join cov using (rid)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words as base_failed from m),
truth as (select doc_id, min(quality) as good from labels where quality is not null and doc_id is not null group by 1),
known as (
  select b.*, good, ('0x' || substr(md5('split|' || b.doc_id::varchar), 1, 8))::bigint % 2 as part
  from b join truth using (doc_id) where not base_failed),
each as (
  {" union all ".join(f"select stratum, '{r}' as rule, {_score_sql(r)} as score from known where part = 0 and good = 1" for r in SCORES)}),
hist as (
  select *, coalesce(sum(n) over (partition by stratum, rule order by score desc
                                  rows between unbounded preceding and 1 preceding), 0) as above,
         sum(n) over (partition by stratum, rule) as total
  from (select stratum, rule, score, count(*) as n from each group by all)),
lv (level, q, m, x) as (values {", ".join(f"({i}, {q}::double, {m}::double, {x})" for i, (q, m, x) in enumerate(LEVELS))}),
cut as (
  select stratum, level, rule, min(floor(score * m)::int + x) as cutoff from hist, lv where above <= q * total group by all),
wide as (
  select stratum, level, {", ".join(f"min(case when rule = '{r}' then cutoff end) as c_{r}" for r in SCORES)}
  from cut group by all),
cnt as (
  select w.stratum, w.level,
         count(*) filter (part = 1 and good = 1) as n, count(*) filter (part = 1 and good = 1 and ({_FAILS})) as k,
         count(*) filter (part = 0 and good = 1) as sg, count(*) filter (part = 0 and good = 1 and ({_FAILS})) as sgh,
         count(*) filter (part = 0 and good = 0) as sb, count(*) filter (part = 0 and good = 0 and ({_FAILS})) as sbh
  from known x join wide w on x.stratum is not distinct from w.stratum group by all),
pv as (
  select *, case when k >= n * {ALPHA} then 1.0 else (
      select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln({1 - ALPHA})))
      from (select unnest(range(0, k + 1)) as i)) end as p,
         count(*) filter (level = 0) over () as strata
  from cnt),
cert as (
  select *, min(case when p <= {DELTA} / strata then 1 else 0 end) over (
      partition by stratum order by level rows between unbounded preceding and current row) = 1 as certified,
      sbh / greatest(sb, 1) - {GOOD_COST} * sgh / greatest(sg, 1) as gain
  from pv),
used as (
  select stratum, level from cert where certified
  qualify row_number() over (partition by stratum order by gain desc, level) = 1),
final as (select w.* from wide w join used u on w.stratum is not distinct from u.stratum and w.level = u.level)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce({_FAILS}, false) as kept
from b left join final f on b.stratum is not distinct from f.stratum
"""
