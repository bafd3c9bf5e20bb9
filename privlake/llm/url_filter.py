"""URL filters: temporal list join.

A block list is a log of dated events (pattern, day, action).  Its events become
validity intervals (from an ``add`` to the next event of the pattern), and every
capture is evaluated against the entries active on its fetch day.  A pattern is
a host: it covers the host and all its subdomains, so a capture is looked up by
each suffix of its host.

Captures are first reduced to distinct (host, day) pairs, with partial
aggregation before the shuffle, so a host with a third of all captures is one
row a day; the intervals are joined by suffix, by broadcast only while they
are at most ``BROADCAST_ROWS``, else by shuffled hashes.  The verdicts of the
pairs come back to the captures by a left join in which Spark splits hot keys.

Edge cases: a null or hostless url has a null host and is kept; a null day has
no active entry; repeated events of one day and pattern count once (``remove``
wins ties); repeated captures are judged one by one; empty lists block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from privlake.llm.common import table

BROADCAST_ROWS = 500_000
FIRST_DAY, DAYS = "2024-01-01", 360


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and a leading ``www.`` or ``m.``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^(www|m)\.", ""))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from (pattern, day, action); the end is exclusive, null while it holds."""
    once = events.where("pattern IS NOT NULL AND day IS NOT NULL").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    spans = once.select("pattern", "action", F.col("day").alias("valid_from"), until.alias("valid_to"))
    return spans.where("action = 'add'").drop("action")


def blocked_pairs(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """(host, day, pattern, n_entries) of the pairs with an active entry; the longest pattern is named."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    d = pairs.where("host IS NOT NULL AND day IS NOT NULL").select("host", "day", F.explode(suffixes).alias("pattern"))
    small = active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    d = d.join(F.broadcast(active) if small else active, "pattern")
    d = d.where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    longest = F.max(F.struct(F.length("pattern").alias("n"), "pattern"))["pattern"]
    return d.groupBy("host", "day").agg(longest.alias("pattern"), F.count(F.lit(1)).alias("n_entries"))


def filter_urls(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """``row`` with the capture's columns, host, day, pattern, n_entries and ``blocked``."""
    d = captures.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    found = blocked_pairs(d.select("host", "day").distinct(), intervals(events))
    d = d.join(found, ["host", "day"], "left")
    return d.select("row", "host", "day", "pattern", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.col("pattern").isNotNull().alias("blocked"))


def _md5_int(col: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(col), start, 6), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` with the fetch day that the tables lack: a day of the year from the page id."""
    n = (_md5_int(F.col("page_id").cast("string"), 1) % DAYS).cast("int")
    return pages.withColumn("fetch_day", F.date_add(F.lit(FIRST_DAY).cast("date"), n))


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: a third of the hosts are added, half of those removed
    later and a quarter added again; all of one top domain (a suffix entry) for a month."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    k = lambda i: _md5_int(F.col("pattern"), i)
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    hosts = hosts.where(k(1) % 3 == 0).select("pattern", (k(7) % 120).alias("a"), (k(13) % 4).alias("c"))
    one = lambda cond, n, action: hosts.where(cond).select("pattern", day(n).alias("day"), F.lit(action).alias("action"))
    own = one("true", F.col("a"), "add").unionByName(one("c < 2", F.col("a") + 60, "remove")).unionByName(one("c = 0", F.col("a") + 150, "add"))
    spark = pages.sparkSession
    suffix = spark.sql(
        f"SELECT 'example.net' AS pattern, date_add(DATE'{FIRST_DAY}', x) AS day, y AS action FROM VALUES (200, 'add'), (230, 'remove') AS t(x, y)"
    )
    return own.unionByName(suffix)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    d = filter_urls(captures(pages), list_events(pages))
    return d.select("row.page_id", "host", F.date_format("day", "yyyy-MM-dd").alias("fetch_day"), "pattern", "n_entries", "blocked")


ORACLE = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^(www|m)\.', ''), '') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5(page_id::varchar), 1, 6))::bigint % 360)::int AS day
  FROM pages),
h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::bigint % 3 AS m, (('0x' || substr(md5(host), 7, 6))::bigint % 120)::int AS a,
         ('0x' || substr(md5(host), 13, 6))::bigint % 4 AS c
  FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
e AS (
  SELECT host AS pattern, DATE '2024-01-01' + a AS day, 'add' AS action FROM h WHERE m = 0
  UNION ALL SELECT host, DATE '2024-01-01' + a + 60, 'remove' FROM h WHERE m = 0 AND c < 2
  UNION ALL SELECT host, DATE '2024-01-01' + a + 150, 'add' FROM h WHERE m = 0 AND c = 0
  UNION ALL VALUES ('example.net', DATE '2024-01-01' + 200, 'add'), ('example.net', DATE '2024-01-01' + 230, 'remove')),
o AS (SELECT pattern, day, max(action) AS action FROM e GROUP BY pattern, day),
i AS (SELECT pattern, action, day AS f, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS t FROM o),
b AS (
  SELECT c.page_id, max(length(i.pattern)) AS n, arg_max(i.pattern, length(i.pattern)) AS pattern, count(*) AS n_entries
  FROM c JOIN i ON i.action = 'add' AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)) AND c.day >= i.f AND (i.t IS NULL OR c.day < i.t)
  GROUP BY c.page_id)
SELECT c.page_id, host, strftime(day, '%Y-%m-%d') AS fetch_day, b.pattern, coalesce(b.n_entries, 0)::bigint AS n_entries, b.pattern IS NOT NULL AS blocked
FROM c LEFT JOIN b USING (page_id)"""
