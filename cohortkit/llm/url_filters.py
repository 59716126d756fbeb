"""URL filters that apply the list entries active when a page was fetched.

A list is a log of dated changes: on a day, a pattern (a domain, or a host with a
path prefix) is added to a list or dropped from it.  The log becomes validity
intervals; an as-of join then holds every capture against the entries whose
interval contains its fetch day.

1. ``intervals``: one change per (list, pattern, day) (a drop wins over an add of
   the same day), valid until the pattern's next change.
2. ``url_keys``: what an entry may name of a URL: its host, every parent domain of
   two labels or more, and the host with every leading part of its path.  Only
   keys of a shape (number of labels or path parts) that the lists hold are made,
   so a very long URL costs time linear in its length.
3. ``decide``: captures first shrink to the distinct (key, day) pairs, so a host
   that holds a third of all captures probes the lists once a day; the pairs meet
   the intervals by key, and the best active entry of each pair returns to the
   captures.  The longest pattern wins, then the allowing list, then the list's name.

All joins are equi-joins on the key, which the adaptive skew join can split.

Defined cases: a URL that is NULL or has no host is kept=false with no entry; a
capture without a fetch day meets no entry and is kept; changes with a NULL list,
pattern, day or action are ignored; repeated changes count once, repeated captures
are decided one by one; empty tables give no rows or, as lists, no entries; extra
columns of captures are passed on in ``_row`` and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let, read_table, whole_row, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
FIRST_DAY = "2024-01-01"
DAYS = 366


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def shapes(changes: DataFrame) -> DataFrame:
    """One row (labels, depths): how many labels the lists' domains have, and how many parts their paths."""
    pattern = F.col("pattern")
    slashes = F.length(pattern) - F.length(F.replace(pattern, F.lit("/")))
    return changes.filter(pattern.isNotNull()).agg(
        F.collect_set(F.when(slashes == 0, F.size(F.split(pattern, r"\.")))).alias("labels"),
        F.collect_set(F.when(slashes > 0, slashes)).alias("depths"))


def url_keys(url: Column, label_counts: Column, depths: Column) -> Column:
    """Every pattern of those shapes that could name this URL: its host, a parent domain of two labels or
    more, or the host with a leading part of its path.  The cost is linear in the URL for each shape."""
    def keys(host, labels, parts):
        n = F.size(labels)
        domains = F.transform(F.filter(label_counts, lambda k: (k <= n) & ((k >= 2) | (n == 1))),
                              lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
        paths = F.transform(F.filter(depths, lambda d: d <= F.size(parts)),
                            lambda d: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")))
        return F.array_distinct(F.concat(domains, paths))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    found = let(F.struct(host_of(url).alias("host"), F.split(host_of(url), r"\.").alias("labels"), parts.alias("parts")),
                lambda u: keys(u["host"], u["labels"], u["parts"]))
    return F.when(host_of(url).isNull(), F.array().cast("array<string>")).otherwise(found)


def intervals(changes: DataFrame) -> DataFrame:
    """(list, allows, pattern, valid_from, valid_to); an open end is NULL."""
    known = changes.dropna(subset=["list", "pattern", "day", "action"])
    daily = known.groupBy("list", "pattern", "day").agg(
        F.max(F.col("action") == "drop").alias("dropped"), F.max("allows").alias("allows"))
    line = W.partitionBy("list", "pattern").orderBy("day")
    return (daily.withColumn("valid_to", F.lead("day").over(line)).filter(~F.col("dropped"))
            .select("list", "allows", "pattern", F.col("day").alias("valid_from"), "valid_to"))


def decide(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``_row`` (the capture), host, and the entry that decided: list, pattern, valid_from, kept."""
    base = captures.select(whole_row(captures).alias("_row"), F.col("url").alias("u"), F.col("fetched").alias("f"),
                           F.monotonically_increasing_id().alias("rid"))
    base = written(base.withColumn("host", host_of(F.col("u"))), "url-captures")
    probes = base.crossJoin(F.broadcast(shapes(changes))).select(       # one row of distinct small numbers
        "rid", F.col("f").alias("day"), F.explode(url_keys(F.col("u"), F.col("labels"), F.col("depths"))).alias("key"))
    pairs = probes.filter(F.col("day").isNotNull()).select("key", "day").distinct()
    entry = F.struct(F.length("pattern").alias("len"), F.col("allows").alias("allows"), F.col("list").alias("list"),
                     F.col("pattern").alias("pattern"), F.col("valid_from").alias("valid_from"))
    active = (pairs.join(intervals(changes), F.col("key") == F.col("pattern"))
              .filter((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
              .groupBy("key", "day").agg(F.max(entry).alias("entry")))
    best = probes.join(active, ["key", "day"]).groupBy("rid").agg(F.max("entry").alias("entry"))
    out = base.join(best, "rid", "left")
    kept = F.col("host").isNotNull() & F.coalesce(F.col("entry.allows") == 1, F.lit(True))
    return out.select("_row", "host", F.col("entry.list").alias("list"), F.col("entry.pattern").alias("pattern"),
                      F.col("entry.valid_from").alias("valid_from"), kept.alias("kept"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day, spread over a year by the id."""
    return pages.select("page_id", "url", _day(_number(F.col("page_id").cast("string")) % DAYS).alias("fetched"))


def derived_changes(pages: DataFrame) -> DataFrame:
    """A change log over the hosts that occur: domains come and go, some paths are allowed again.

    The tables hold no lists, so the query's log follows from a hash of each host,
    parent domain and first path part of the pages; it grows with them.
    """
    host = host_of(F.col("url"))
    part = F.regexp_extract(F.regexp_extract("url", PATH, 1), "^/([^/]+)", 1)
    names = pages.select(host.alias("host"), part.alias("part")).filter("host is not null").distinct()
    x = _number(F.col("pattern"))
    log = lambda name, allows, action, day: F.struct(
        F.lit(name).alias("list"), F.lit(allows).alias("allows"), F.lit(action).alias("action"), _day(day).alias("day"))
    hosts = names.select(F.col("host").alias("pattern")).distinct().filter(x % 3 == 0).select("pattern", F.explode(F.array(
        log("block", 0, "add", x % 150), log("block", 0, "drop", x % 150 + 60), log("block", 0, "add", x % 150 + 120),
        log("block", 0, "add", x % 150 + 200))).alias("c"))
    parents = names.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).filter("pattern <> ''").distinct(
        ).filter(x % 4 == 1).select("pattern", F.explode(F.array(
            log("adult", 0, "add", x % 200), log("adult", 0, "drop", x % 200 + 100))).alias("c"))
    paths = names.filter("part <> ''").select(F.concat_ws("/", "host", "part").alias("pattern")).distinct().filter(
        x % 5 == 0).select("pattern", F.explode(F.array(
            log("allow", 1, "add", x % 180), log("allow", 1, "drop", x % 180 + 150), log("allow", 1, "drop", x % 180 + 150))).alias("c"))
    return hosts.unionAll(parents).unionAll(paths).select("pattern", "c.*")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return decide(dated_captures(pages), derived_changes(pages)).select(
        "_row.page_id", F.col("_row.fetched").cast("string").alias("fetched"), "host", "list", "pattern",
        F.col("valid_from").cast("string").alias("valid_from"), "kept")


_X = "('0x' || substr(md5({}), 1, 8))::bigint"
_D = f"(date '{FIRST_DAY}' + ({{}})::int)"


def _log(name, allows, action, day):
    return f"select pattern, '{name}' as list, {allows} as allows, '{action}' as action, {_D.format(day)} as day from"


OP6_SQL = f"""
with p as (
  select row_number() over () as rid, page_id, url, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') as host,
         regexp_extract(url, '{PATH}', 1) as path,
         {_D.format(_X.format("page_id::varchar") + f" % {DAYS}")} as fetched from pages),
names as (select distinct host, regexp_extract(path, '^/([^/]+)', 1) as part from p where host is not null),
hosts as (select distinct host as pattern, {_X.format("host")} as x from names where x % 3 = 0),
parents as (
  select *, {_X.format("pattern")} as x from (
    select distinct regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) as pattern from names) where pattern <> '' and x % 4 = 1),
paths as (
  select *, {_X.format("pattern")} as x from (
    select distinct host || '/' || part as pattern from names where part <> '') where x % 5 = 0),
log as (
  {_log("block", 0, "add", "x % 150")} hosts union all {_log("block", 0, "drop", "x % 150 + 60")} hosts union all
  {_log("block", 0, "add", "x % 150 + 120")} hosts union all {_log("block", 0, "add", "x % 150 + 200")} hosts union all
  {_log("adult", 0, "add", "x % 200")} parents union all {_log("adult", 0, "drop", "x % 200 + 100")} parents union all
  {_log("allow", 1, "add", "x % 180")} paths union all {_log("allow", 1, "drop", "x % 180 + 150")} paths),
daily as (select list, pattern, day, max(action = 'drop') as dropped, max(allows) as allows from log group by all),
iv as (
  select * from (select *, lead(day) over (partition by list, pattern order by day) as valid_to from daily) where not dropped),
labels as (select rid, host, path, fetched, string_split(host, '.') as ls,
                  list_filter(string_split(path, '/'), lambda s: s <> '') as ps from p where host is not null),
keys as (
  select rid, fetched, array_to_string(ls[i:], '.') as key
  from (select *, unnest(range(1, greatest(len(ls) - 1, 1) + 1)) as i from labels)
  union
  select rid, fetched, host || '/' || array_to_string(ps[:i], '/') as key
  from (select *, unnest(range(1, len(ps) + 1)) as i from labels)),
best as (
  select rid, list, pattern, allows, day as valid_from
  from keys join iv on key = pattern and fetched >= day and (valid_to is null or fetched < valid_to)
  qualify row_number() over (partition by rid order by length(pattern) desc, allows desc, list desc, pattern desc, day desc) = 1)
select page_id, fetched::varchar as fetched, host, list, pattern, valid_from::varchar as valid_from, host is not null and coalesce(allows = 1, true) as kept
from p left join best using (rid)
"""
