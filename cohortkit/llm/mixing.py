"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Every source gets a target number of words: weight shares of the budget, no
   source above ``max_repeat`` times its own size, the excess shared again by
   weight until no target is above.
2. The budget is cut into equal blocks of ``block_words`` words.  Sainte-Lague
   (highest quotients ``target / (2 k + 1)``) gives every source an integer
   number of blocks, and a second apportionment inside each source gives every
   shard of it an integer quota.
3. A shard lays its documents one after the other in a seeded random order and
   cuts the line into blocks.  A quota of ``q`` out of ``n`` blocks takes every
   block ``q div n`` times, and ``q mod n`` blocks once more, evenly spaced from
   a seeded start.  How many words of a document fall into those blocks is
   arithmetic on its offset, so blocks are never materialised.

Only the per-source and per-shard tables (a few numbers a row, at most
``MAX_SHARDS`` a source) are apportioned by windows; documents are dealt to shards
and ordered there by a digest of id and text, and a source holding a third of all
rows simply has more shards.

Defined cases: a NULL text has size 0 and takes 0 words; the NULL source is a
source of its own and comes last; a source with no words gets target 0; a very long
text spans many blocks of its shard; equal rows are mixed as separate rows, one after
the other; rows of one ``doc_id`` with different texts go by the digest, and a NULL
``doc_id`` is ordered like any other value; an empty table gives an empty result; columns of the input other than
``doc_id``, ``text`` and ``source`` are never read, and ``mixed_documents``
passes them on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read_table, whole_row, word_count, words, written

BLOCK_WORDS = 32
SHARD_WORDS = 500_000
MAX_SHARDS = 100_000     # of a source; beyond it shards grow
SEED = 7
BUDGET = 1.5
MAX_REPEAT = 2
# Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def _digest(seed: int, *cols: Column) -> Column:
    """A reproducible hash text of a row; equal in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, weight, target): capped shares of ``budget`` x all words.

    ``sizes`` has one row per source, so the windows here see the list of sources
    only.  Sources are sorted by how soon their cap binds; the level at which the
    rest share by weight then follows from prefix sums.
    """
    by_cap = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("pos").asc())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (sizes.withColumn("pos", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                 (F.col("pos") % len(weights) + 1).cast("int")))
              .withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
              .withColumn("turn", F.row_number().over(by_cap))
              .withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything)
                                    - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)),
                                                 F.lit(0)))
                          / F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing))))
    # the first source that its level leaves under its cap sets the level of all that follow
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("turn"))).over(everything)
    level = F.max(F.when(F.col("turn") == F.col("free"), F.col("level"))).over(everything)
    return (ranked.withColumn("free", free).withColumn("common", level)
            .select("source", "source_size", "weight",
                    F.when(F.col("turn") >= F.col("free"), F.col("common") * F.col("weight"))
                    .otherwise(F.col("cap").cast("double")).alias("target")))


def apportion(cells: DataFrame, seats: Column, target: Column, by: list[str], order: list[Column],
              name: str = "quota") -> DataFrame:
    """Add ``name``: the Sainte-Lague seats of every cell inside its ``by`` group.

    ``seats`` is the group's number of seats.  With m cells, the exact divisor
    moves a cell's share s of the seats by at most s*m/2, so every cell starts
    with that many seats less than its rounded share and offers that many
    quotients more; the open seats go by highest quotient.  All cells together
    offer some 5m quotients, whatever the number of seats.
    """
    group = W.partitionBy(*by) if by else W.partitionBy()
    slack = F.ceil(F.col("_t") / F.col("_total") * F.col("_m") / 2)
    base = (cells.withColumn("_t", target.cast("double")).withColumn("_seats", seats.cast("long"))
            .withColumn("_cell", F.row_number().over(group.orderBy(*order)))
            .withColumn("_total", F.sum("_t").over(group)).withColumn("_m", F.count(F.lit(1)).over(group))
            .withColumn("_slack", F.when(F.col("_total") > 0, slack).otherwise(0))
            .withColumn("_q0", F.when(F.col("_total") > 0, F.greatest(F.lit(0), F.floor(
                F.col("_seats") * F.col("_t") / F.col("_total") + F.lit(0.5)) - 1 - F.col("_slack"))).otherwise(0))
            .withColumn("_open", F.when(F.col("_total") > 0, F.col("_seats") - F.sum("_q0").over(group))
                        .otherwise(0)))
    keys = [*by, "_cell"]
    offers = (base.filter(F.col("_t") > 0)
              .select(*keys, "_open", "_t", "_q0",
                      F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_slack") + 3)).alias("_j"))
              .withColumn("_quotient", F.col("_t") / (2 * (F.col("_q0") + F.col("_j")) + 1))
              .withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_quotient"), "_cell", "_j")))
              .filter(F.col("_rank") <= F.col("_open")))
    won = offers.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_won"))
    match = F.col("_cell") == F.col(f"_k{len(by)}")
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = base.join(won, match, "left").withColumn(name, (F.col("_q0") + F.coalesce(F.col("_won"), F.lit(0))).cast("long"))
    return out.select(*cells.columns, name)


def shard_quotas(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT,
                 block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED):
    """(sources, shards): targets and block quotas from a (source, size, digest) frame."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(per_source, weights, budget, max_repeat)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seats = F.round(F.sum("target").over(everything) / block_words)
    sources = apportion(sources.withColumn("seats", seats), F.col("seats"), F.col("target"), [],
                        [F.col("source").asc_nulls_last()], "blocks")
    sources = written(sources.select(
        F.col("source").alias("_s"), "source_size", "target", "blocks",
        F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("n_shards")),
        "mix-sources")
    shards = (with_shard(sizes, sources).groupBy("_s", "shard", "blocks")
              .agg(F.sum("size").alias("shard_size")))
    shards = apportion(shards, F.col("blocks"), F.col("shard_size"), ["_s"], [F.col("shard")])
    n = F.ceil(F.col("shard_size") / block_words).cast("long")
    shards = shards.select(
        F.col("_s").alias("_ss"), F.col("shard").alias("_sh"), n.alias("n_blocks"),
        F.least(F.col("quota"), F.lit(max_repeat) * n).alias("quota"),
        F.when(n > 0, _number(_digest(seed, F.col("_s"), F.col("shard"))) % n).otherwise(0).alias("phase"))
    return sources, written(shards, "mix-shards")


def with_shard(rows: DataFrame, sources: DataFrame) -> DataFrame:
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("_s")), "inner")
    return joined.withColumn("shard", _number(F.col("digest")) % F.col("n_shards"))


def taken_columns(rows: DataFrame, sources: DataFrame, shards: DataFrame,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add each row's word offset in its shard and the words of it that the mix takes."""
    placed = with_shard(rows, sources).join(
        shards, F.col("_s").eqNullSafe(F.col("_ss")) & (F.col("shard") == F.col("_sh")), "inner")
    line = (W.partitionBy("_s", "shard").orderBy("digest", "doc_id", "size")
            .rowsBetween(W.unboundedPreceding, -1))
    o, s, n = F.col("offset"), F.col("size"), F.greatest(F.col("n_blocks"), F.lit(1))
    placed = (placed.withColumn("offset", F.coalesce(F.sum("size").over(line), F.lit(0)))
              .withColumn("times", F.col("quota").cast("long") - F.col("quota") % n)
              .withColumn("times", (F.col("times") / n).cast("long"))
              .withColumn("extra", F.col("quota") % n))

    first = F.floor(o / block_words)
    last = F.floor((o + s - 1) / block_words)
    chosen = lambda j: chosen_before(j + 1) - chosen_before(j)
    partial = F.when(s == 0, F.lit(0)).when(first == last, chosen(first) * s).otherwise(
        chosen(first) * ((first + 1) * block_words - o)
        + (chosen_before(last) - chosen_before(first + 1)) * block_words
        + chosen(last) * (o + s - last * block_words))
    return placed.withColumn("partly", partial.cast("long")).withColumn(
        "taken", (F.col("times") * s + F.col("partly")).cast("long"))


def chosen_before(j) -> Column:
    """How many blocks before block ``j`` of its shard are taken once more."""
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    return F.floor((j * F.col("extra") + F.col("phase")) / n)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("digest", _digest(seed, F.col("doc_id"), F.col("text")))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    rows = written(sized(docs.select("doc_id", "text", "source"), seed).select("doc_id", "source", "size", "digest"),
                   "mix-sizes")
    sources, shards = shard_quotas(rows, weights, budget, max_repeat, block_words, shard_words, seed)
    return taken_columns(rows, sources, shards, block_words).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "shard", "offset", "quota", "n_blocks")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT,
                    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, whole texts once per full repeat and, for a
    document that is taken in part, one row with the words of its chosen blocks
    joined by one space.  Documents of which nothing is taken are left out; so are
    those without words, which no block holds."""
    columns = docs.columns
    row = whole_row(docs).alias("row")
    rows = sized(docs.select(row, "doc_id", "text", "source"), seed)
    sources, shards = shard_quotas(rows.select("source", "size", "digest"), weights, budget, max_repeat,
                                   block_words, shard_words, seed)
    placed = taken_columns(rows.select("row", "doc_id", "source", "size", "digest"), sources, shards, block_words)
    part = F.array_join(F.filter(words(F.col("row.text")), lambda w, i: chosen_before(
        F.floor((F.col("offset") + i) / block_words) + 1) > chosen_before(F.floor((F.col("offset") + i) / block_words))),
        " ")
    whole = F.col("partly") == F.col("size")
    full = F.array_repeat(F.col("row.text"), (F.col("times") + F.when(whole, 1).otherwise(0)).cast("int"))
    texts = F.when((F.col("partly") > 0) & ~whole, F.concat(full, F.array(part))).otherwise(full)
    out = placed.filter(F.col("taken") > 0).withColumn("mixed", F.explode(texts))
    return out.select(*[F.col("mixed").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
with d as (
  select doc_id, source,
         case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end::bigint as size,
         md5('{SEED}|' || coalesce(doc_id::varchar, '~') || '|' || coalesce(text, '~')) as digest
  from documents),
src as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, row_number() over (order by source asc nulls last) - 1 as pos from src),
w2 as (
  select *, case pos % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight,
         {MAX_REPEAT} * source_size as cap from w),
w3 as (
  select *, row_number() over o as turn,
         ({BUDGET}::double * sum(source_size) over ()
          - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (o rows between current row and unbounded following) as level
  from w2 window o as (order by cap / weight, pos)),
w4 as (select *, min(case when level * weight <= cap then turn end) over () as free from w3),
w5 as (select *, max(case when turn = free then level end) over () as common from w4),
tgt as (
  select source, source_size, case when turn >= free then common * weight else cap::double end as target from w5),
seat as (select *, round(sum(target) over () / {BLOCK_WORDS}) as seats from tgt),
quot as (
  select s.source, s.seats, s.target / (2 * k.k + 1) as quotient, k.k
  from seat s, lateral (select unnest(range(0, (2 * s.source_size / {BLOCK_WORDS} + 3)::bigint)) as k) k
  where s.target > 0),
seated as (
  select source, count(*) as blocks from (
    select source, seats, row_number() over (order by quotient desc, source asc nulls last, k) as r from quot)
  where r <= seats group by source),
sources as (
  select t.*, coalesce(b.blocks, 0) as blocks, least({MAX_SHARDS}, greatest(1, ceil(t.source_size / {SHARD_WORDS}.0)))::bigint as n_shards
  from tgt t left join seated b on t.source is not distinct from b.source),
sharded as (
  select d.*, s.source_size, s.target, s.blocks, ('0x' || substr(d.digest, 1, 8))::bigint % s.n_shards as shard
  from d join sources s on d.source is not distinct from s.source),
cells as (
  select source, shard, blocks, sum(size)::bigint as shard_size from sharded group by all),
shard_quot as (
  select c.*, c.shard_size::double / (2 * k.k + 1) as quotient, k.k
  from cells c, lateral (select unnest(range(0, (2 * c.shard_size / {BLOCK_WORDS} + 3)::bigint)) as k) k
  where c.shard_size > 0),
won as (
  select source, shard, count(*) as quota from (
    select source, shard, blocks, row_number() over (partition by source order by quotient desc, shard, k) as r
    from shard_quot) where r <= blocks group by source, shard),
shards as (
  select c.source, c.shard, ceil(c.shard_size / {BLOCK_WORDS}.0)::bigint as n,
         least(coalesce(w.quota, 0), {MAX_REPEAT} * ceil(c.shard_size / {BLOCK_WORDS}.0)::bigint) as quota,
         ('0x' || substr(md5('{SEED}|' || coalesce(c.source, '~') || '|' || c.shard::varchar), 1, 8))::bigint as ph
  from cells c left join won w on c.source is not distinct from w.source and c.shard = w.shard),
placed as (
  select a.doc_id, a.source, a.size, a.source_size, a.target, a.shard, s.quota, s.n as n_blocks,
         greatest(s.n, 1) as n, case when s.n > 0 then s.ph % s.n else 0 end as phase,
         coalesce(sum(a.size) over (partition by a.source, a.shard order by a.digest, a.doc_id, a.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from sharded a join shards s on a.source is not distinct from s.source and a.shard = s.shard),
word_blocks as (
  select p.*, unnest(case when size > 0 then range("offset" // {BLOCK_WORDS}, ("offset" + size - 1) // {BLOCK_WORDS} + 1)
                          else [null] end) as j from placed p),
hits as (
  select *, case when j is null then 0 else
    (least("offset" + size, (j + 1) * {BLOCK_WORDS}) - greatest("offset", j * {BLOCK_WORDS}))
    * (quota // n + ((j + 1) * (quota % n) + phase) // n - (j * (quota % n) + phase) // n) end as hit
  from word_blocks)
select doc_id, size, source_size, target, sum(hit)::bigint as taken, source, shard, "offset", quota, n_blocks
from hits group by all
"""
