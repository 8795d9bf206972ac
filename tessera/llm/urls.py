"""URL filters as of fetch time, in DataFrame operations only.

Dated list events become validity intervals of a pattern: a domain (``example.com``, subdomains included) or a domain
with a path prefix (``example.com/ads``, whole segments). A capture meets the patterns that its own URL names, its
domain suffixes and path prefixes, so the as-of join is an equality on the pattern and a range on the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, table, written

#: Intervals up to this many are broadcast (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_INTERVALS = 100_000
#: Captures of one key in one task of that join; keys of more are dropped where not listed, else salted.
HOT_ROWS = 1_000_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where the URL has none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(rest, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Array of the non-empty path segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def patterns_of(url: Column, depth: int | None = None) -> Column:
    """All patterns that cover the URL, most specific first: path prefixes of the host, then its domain suffixes.

    ``depth``: prefixes of so many segments at most, where no pattern has more; else all.
    """
    path = path_of(url) if depth is None else F.slice(path_of(url), 1, depth)

    def of(host: Column) -> Column:
        labels = F.split(host, r"\.")
        suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        prefixes = let(path, lambda p: F.reverse(F.transform(p, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(p, F.lit(1), i + 1), "/")))))
        return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(prefixes, suffix))

    return let(host_of(url), of)


def normal_pattern(pattern: Column) -> Column:
    """A listed pattern as URLs name it: no scheme, user, port, query, final dot or empty segment, the host in lower
    case; null where there is no host."""
    url = F.concat(F.lit("http://"), F.regexp_replace(F.trim(pattern), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", ""))
    return let(path_of(url), lambda p: F.concat(host_of(url), F.when(F.size(p) > 0, F.concat(F.lit("/"), F.array_join(p, "/"))).otherwise("")))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, action, at) events to (pattern, valid_from, valid_to): listed from an 'add' until the next 'remove'.

    Patterns are normalised first, so ``HTTP://Example.com:80/ads/`` is ``example.com/ads``. Repeated adds or removes change nothing; of an add and a remove at one time the remove wins. valid_to null: still
    listed. Events with a null pattern or time are skipped.
    """
    events = events.withColumn("pattern", normal_pattern(F.col("pattern")))
    e = events.filter(F.col("pattern").isNotNull() & F.col("at").isNotNull()).groupBy("pattern", "at").agg(F.bool_or(F.col("action") == "remove").alias("off"))
    by_time = Window.partitionBy("pattern").orderBy("at")
    e = e.withColumn("was_off", F.coalesce(F.lag("off").over(by_time), F.lit(True))).filter(F.col("off") != F.col("was_off"))
    e = e.withColumn("valid_to", F.lead("at").over(by_time))
    return e.filter(~F.col("off")).select("pattern", F.col("at").alias("valid_from"), "valid_to")


def filtered(captures: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, pattern and valid_from: the most specific pattern listed at fetch time.

    A null URL, one without a host, and a null fetch time match nothing. Rows with equal ids are judged alike only if
    their URLs and times are equal; the key of the join is all three. An empty list blocks nothing. Columns named
    blocked, pattern or valid_from are replaced, all others stay.
    """
    names = [c for c in captures.columns if c not in ("blocked", "pattern", "valid_from")]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(url_col).alias("url"), F.col(time_col).alias("time"))
    # what is asked: each URL and time once, so a capture repeated ever so often is one row
    asked = rows.select("url", "time").filter(F.col("url").isNotNull() & F.col("time").isNotNull()).distinct()
    # a listed pattern of any depth is met: URLs name prefixes down to the deepest one
    n_listed, depth = listed.agg(F.count("*"), F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit(""))))).first()
    asked = asked.select("url", "time", F.posexplode(patterns_of(F.col("url"), depth or 0)).alias("rank", "key"))
    listed = listed.select(F.col("pattern").alias("listed"), "valid_from", "valid_to")
    on = (F.col("key") == F.col("listed")) & (F.col("valid_from") <= F.col("time")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to")))
    if n_listed <= BROADCAST_INTERVALS:
        hits = asked.join(F.broadcast(listed), on)
    else:
        # keys that very many captures name, such as a top-level domain: at most one in HOT_ROWS rows
        hot = asked.groupBy(F.col("key").alias("hot_key")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS)
        known = listed.select(F.col("listed").alias("known")).distinct()
        hot = hot.join(known, F.col("hot_key") == F.col("known"), "left")
        hot = written(hot.select("hot_key", F.when(F.col("known").isNotNull(), F.ceil(F.col("n") / HOT_ROWS)).otherwise(F.lit(0)).cast("int").alias("salts")), "url-hot")
        if hot.count() <= BROADCAST_INTERVALS:
            hot = F.broadcast(hot)
        asked = asked.join(hot, F.col("key") == F.col("hot_key"), "left").filter("salts is null or salts > 0")
        asked = asked.withColumn("own_salt", F.coalesce(F.pmod(F.xxhash64("url", "time"), F.col("salts")).cast("int"), F.lit(0))).drop("salts", "hot_key")
        salted = listed.join(hot, F.col("listed") == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("salts", F.lit(1)), F.lit(1)) - 1)))
        hits = asked.join(salted.drop("salts", "hot_key"), on & (F.col("own_salt") == F.col("salt")))
    best = hits.groupBy("url", "time").agg(F.min(F.struct("rank", "listed", "valid_from")).alias("best")).withColumnsRenamed({"url": "b_url", "time": "b_time"})
    best = written(best, "url-best")  # one row a URL and time, so the captures of a hot one may be split
    out = rows.join(best, (F.col("url") == F.col("b_url")) & (F.col("time") == F.col("b_time")), "left")
    return out.select("row.*", F.col("best").isNotNull().alias("blocked"), F.col("best.listed").alias("pattern"), F.col("best.valid_from").alias("valid_from"))


def _drawn(value: Column, salt: str) -> Column:
    """A number below 2**32 that depends on the value alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value).cast("binary")), 1, 8), 16, 10).cast("long")


START = "2024-01-01"


def stated_captures(spark, sf_dir: str) -> DataFrame:
    """All pages, each fetched on a day of 2024 drawn from its id."""
    day = F.date_add(F.lit(START).cast("date"), (_drawn(F.col("page_id").cast("string"), "f") % 365).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))


def stated_events(captures: DataFrame) -> DataFrame:
    """A third of the hosts, and a fifth of the host/segment prefixes, are listed on a day drawn from the pattern; half are removed, some come back."""
    url = F.col("url")
    host, first = host_of(url), F.get(path_of(url), F.lit(0))
    drawn = captures.select(F.explode(F.array(F.struct(host.alias("p"), F.lit(3).alias("one_in")), F.struct(F.concat(host, F.lit("/"), first).alias("p"), F.lit(5).alias("one_in")))).alias("x"))
    p = F.col("pattern")
    drawn = drawn.select(F.col("x.p").alias("pattern"), "x.one_in").filter("pattern is not null").distinct().filter(_drawn(p, "l") % F.col("one_in") == 0)
    add = F.date_add(F.lit(START).cast("date"), (_drawn(p, "a") % 200).cast("int"))
    off = F.date_add(add, (_drawn(p, "r") % 100 + 1).cast("int"))
    back = F.date_add(off, F.lit(40))
    event = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    events = F.array(event("add", add), F.when(_drawn(p, "o") % 2 == 0, event("remove", off)), F.when(_drawn(p, "o") % 4 == 0, event("add", back)))
    return drawn.select("pattern", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e")).select("pattern", "e.action", "e.at")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    captures = stated_captures(spark, sf_dir)
    out = filtered(captures, intervals(stated_events(captures)))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "valid_from")})


_D = "CAST('0x' || substr(md5('{0}' || {1}), 1, 8) AS BIGINT)"
OP7_SQL = rf"""
WITH c AS (SELECT page_id, url, CAST(DATE '{START}' + CAST({_D.format('f', 'CAST(page_id AS VARCHAR)')} % 365 AS INTEGER) AS DATE) AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:]*)', 1), '\.+$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS path FROM pages),
l AS (SELECT DISTINCT host AS p, 3 AS one_in FROM c WHERE host IS NOT NULL
    UNION SELECT DISTINCT host || '/' || path[1], 5 FROM c WHERE host IS NOT NULL AND len(path) > 0),
a AS (SELECT p, CAST(DATE '{START}' + CAST({_D.format('a', 'p')} % 200 AS INTEGER) AS DATE) AS d, {_D.format('o', 'p')} AS o, {_D.format('r', 'p')} % 100 + 1 AS r
    FROM l WHERE {_D.format('l', 'p')} % one_in = 0),
i AS (SELECT p, d AS f, CASE WHEN o % 2 = 0 THEN CAST(d + CAST(r AS INTEGER) AS DATE) END AS t FROM a
    UNION ALL SELECT p, CAST(d + CAST(r + 40 AS INTEGER) AS DATE), NULL FROM a WHERE o % 4 = 0),
k AS (SELECT page_id, fetched_at, host || '/' || array_to_string(list_slice(path, 1, n), '/') AS key, -n AS rank FROM (SELECT *, unnest(range(1, len(path) + 1)) AS n FROM c WHERE host IS NOT NULL)
    UNION ALL SELECT page_id, fetched_at, array_to_string(list_slice(string_split(host, '.'), n, len(string_split(host, '.'))), '.'), 10 + n
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM c WHERE host IS NOT NULL)),
b AS (SELECT page_id, p, f, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS nth FROM k JOIN i ON key = p AND f <= fetched_at AND (t IS NULL OR fetched_at < t))
SELECT c.page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at, b.p IS NOT NULL AS blocked, b.p AS pattern, CAST(b.f AS VARCHAR) AS valid_from FROM c LEFT JOIN b ON c.page_id = b.page_id AND b.nth = 1
"""
