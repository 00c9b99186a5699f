"""URL filters by a temporal list join: was a capture's host, or a domain above it, listed when it was fetched?

Dated list entries (list, pattern, action add or remove, since) become validity intervals: an entry holds from its day
until the next entry of its list and pattern, and counts if it is an add; on one day a remove comes after an add. A
pattern is a host or a domain, and matches itself and all hosts below it. The distinct hosts of the captures are matched
with patterns by equality on their suffixes; what holds for a host is cut into buckets of DAYS days, and a capture meets
only its host's entries of its own bucket, so a listing that changes often stays small. Captures keep their rows: they are
never grouped, and a hot host's rows can be split by Spark's skew handling as they only meet one row a bucket.

All of it is DataFrame functions. Null or malformed URLs have the empty host and match nothing; a null time matches
nothing. A very long URL is one value, of which only the host goes on. Entries with a null field don't count. Repeated captures stay, repeated entries change nothing. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

DAYS = 64
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows list, pattern, since, until (null: still holds) from rows list, pattern, action, since."""
    order = W.partitionBy("list", "pattern").orderBy("since", "action")
    x = entries.select("list", F.lower("pattern").alias("pattern"), "action", F.col("since").cast("date").alias("since")).dropna().distinct()
    x = x.withColumn("until", F.lead("since").over(order)).where("action = 'add' AND (until IS NULL OR until > since)")
    return x.select("list", "pattern", "since", "until")


def _bucket(day) -> F.Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01")) / DAYS)


def screen(captures: DataFrame, entries: DataFrame, id_col="page_id", url_col="url", time_col="fetched") -> DataFrame:
    """All captures: id, host, fetched, blocked, n_lists (lists that held), pattern (the longest that held), listed_since (its day)."""
    x = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).cast("date").alias("fetched"))
    x = x.withColumn("bucket", _bucket(F.col("fetched")))
    places = x.where("host <> '' AND bucket IS NOT NULL").select("host", "bucket").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("pattern"))
    listed = hosts.join(intervals(entries), "pattern")
    # One row for each host and bucket that has captures, with the entries that hold on some day of the bucket.
    first, last = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("bucket") * DAYS).cast("int")), F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("bucket") + 1) * DAYS - 1).cast("int"))
    here = places.join(listed, "host").where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    here = here.groupBy("host", "bucket").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "pattern", "since", "until", "list")).alias("entries"))
    x = x.join(here, ["host", "bucket"], "left")
    held = F.filter(F.coalesce("entries", F.expr("array()").cast(here.schema["entries"].dataType)), lambda y: (y.since <= F.col("fetched")) & (y.until.isNull() | (F.col("fetched") < y.until)))
    x = x.withColumn("held", held)
    top = F.array_max("held")
    return x.select(F.col("id").alias(id_col), "host", "fetched", (F.size("held") > 0).alias("blocked"), F.size(F.array_distinct(F.transform("held", lambda y: y["list"]))).cast("long").alias("n_lists"), top["pattern"].alias("pattern"), top["since"].alias("listed_since"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """The pages table has no times: a page's day of fetching is a rule of its id."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 365) as int))").alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Nor does it come with a list: its hosts and their parent domains are listed, unlisted and listed again by rules of their MD5."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    h = hosts.select(F.col("h").alias("pattern"), number(F.col("h")).alias("u")).where("u % 3 = 0")
    p = hosts.select(F.expr("substring(h, instr(h, '.') + 1)").alias("pattern")).distinct().select("pattern", number(F.col("pattern")).alias("u")).where("u % 4 = 0")
    day = lambda e: F.expr(f"date_add(date'2024-01-01', cast({e} as int))")
    row = lambda x, name, action, e: x.select(F.lit(name).alias("list"), "pattern", F.lit(action).alias("action"), day(e).alias("since"))
    return (
        row(h, "spam", "add", "u % 200").unionByName(row(h.where("u % 2 = 0"), "spam", "remove", "u % 200 + 40"))
        .unionByName(row(h.where("u % 5 = 0"), "spam", "add", "u % 200 + 90")).unionByName(row(p, "adult", "add", "u % 250"))
    )


ORACLE = r"""
WITH x AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    (DATE '2024-01-01' + ((page_id * 37) % 365)::INT)::DATE AS fetched FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM x WHERE host <> ''),
h AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS u FROM hosts),
p AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS u FROM (SELECT DISTINCT substr(pattern, instr(pattern, '.') + 1) AS pattern FROM hosts)),
entries AS (
  SELECT 'spam' AS list, pattern, 'add' AS action, (DATE '2024-01-01' + (u % 200)::INT)::DATE AS since FROM h WHERE u % 3 = 0
  UNION ALL SELECT 'spam', pattern, 'remove', (DATE '2024-01-01' + (u % 200 + 40)::INT)::DATE FROM h WHERE u % 3 = 0 AND u % 2 = 0
  UNION ALL SELECT 'spam', pattern, 'add', (DATE '2024-01-01' + (u % 200 + 90)::INT)::DATE FROM h WHERE u % 3 = 0 AND u % 5 = 0
  UNION ALL SELECT 'adult', pattern, 'add', (DATE '2024-01-01' + (u % 250)::INT)::DATE FROM p WHERE u % 4 = 0),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since, action) AS until FROM entries),
held AS (SELECT x.page_id, s.list, s.pattern, s.since FROM x JOIN spans s ON (x.host = s.pattern OR x.host LIKE '%.' || s.pattern)
  AND s.action = 'add' AND s.since <= x.fetched AND (s.until IS NULL OR x.fetched < s.until)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC, since DESC) AS r FROM held),
lists AS (SELECT page_id, count(DISTINCT list) AS n_lists FROM held GROUP BY page_id)
SELECT x.page_id, x.host, x.fetched::VARCHAR AS fetched, r.page_id IS NOT NULL AS blocked, coalesce(l.n_lists, 0)::BIGINT AS n_lists, r.pattern, r.since::VARCHAR AS listed_since
FROM x LEFT JOIN ranked r ON x.page_id = r.page_id AND r.r = 1 LEFT JOIN lists l ON x.page_id = l.page_id
"""
