"""URL filters against dated lists: which entry was active when a page was fetched. DataFrame functions only.

Dated entries add a host, a domain, or a path of a host (``a.org/news``, with a query ``a.org/news?id=1``) to a list or take it off;
per entry they become validity intervals. A capture is looked up by its host, by each domain above it, and by each path
above its own, and the interval that holds its fetch date decides. Captures are first reduced to their different hosts and
dates, so a host with a third of all captures is looked up once a day. Only as many labels and steps are looked up as
entries have, so ``com`` is no key unless a list names it; and each key meets one of several copies of an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm._shared import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/:?#@\[\]]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"
#: A percent code for one of ``A-Z a-z 0-9 - . _ ~``.
_PLAIN_CODE = "^(?:2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"
_ADDRESS = r"^(?:\[.*\]|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
START = "2024-01-01"
#: Copies of each entry, so that one that a third of all captures fall under is met in as many tasks.
PARTS = 16


def _slashed(url: Column) -> Column:
    """A URL with slashes for backslashes, as browsers read it."""
    return F.translate(url, "\\", "/")


def _decoded(path: Column) -> Column:
    """A path with the letters, digits and marks for percent codes that need none, and other codes in upper case."""
    part = lambda x, i: F.when(i == 0, x).when(x.rlike(_PLAIN_CODE), F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), F.substring(x, 3, 1 << 30))).otherwise(
        F.concat(F.lit("%"), F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.upper(F.substring(x, 1, 2))).otherwise(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))
    )
    return F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(F.split(path, "%", -1), part), "")).otherwise(path)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a last full stop; empty if there is none. An IPv6 address has its brackets."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(_slashed(url), _HOST, 1)), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host of a URL, with its query; empty if there is none."""
    return F.coalesce(_decoded(F.regexp_extract(_slashed(url), _PATH, 1)), F.lit(""))


def domains_of(host: Column, sizes: list[int] | None = None) -> Column:
    """The host and all domains above it; only those of as many labels, if ``sizes`` are given. A numeric address is no part of a
    domain: its only label is itself."""
    parts = F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    wanted = F.sequence(F.lit(1), F.size(parts)) if sizes is None else F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size(parts))
    return F.transform(wanted, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def paths_of(host: Column, path: Column, sizes: list[int], queries: bool) -> Column:
    """The host with the first steps of a path, as many as ``sizes`` say, and with the whole path if that has a query."""
    steps = F.split(F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), "^/+|/+$", ""), "/+")
    wanted = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: (n <= F.size(steps)) & (steps[0] != ""))
    found = F.transform(wanted, lambda n: F.concat_ws("/", host, F.array_join(F.slice(steps, F.lit(1), n), "/")))
    whole = F.when(F.contains(path, F.lit("?")), F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))
    return F.concat(found, whole) if queries else found


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, listed_on, action)`` to ``pattern, valid_from, valid_to``; the end is open or exclusive.

    Actions are ``add`` and ``remove``; on one day the last word is ``remove``. What adds an entry that is on the list
    changes nothing, nor does what removes one that is not. Entries with a null are left out.
    """
    days = entries.where("pattern IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    days = days.groupBy("pattern", "listed_on").agg((F.max("action") == "add").alias("on"))
    own = Window.partitionBy("pattern").orderBy("listed_on")
    turns = days.withColumn("was", F.lag("on", 1, False).over(own)).where("on != was")
    return (
        turns.withColumn("valid_to", F.lead("listed_on").over(own))
        .where("on")
        .select("pattern", F.col("listed_on").alias("valid_from"), "valid_to")
    )


def _read_alike(entries: DataFrame) -> DataFrame:
    """Entries with the paths of their patterns written as those of captures are."""
    pattern = F.translate("pattern", "\\", "/")
    host = F.regexp_extract(pattern, "^[^/?]*", 0)
    return entries.select(F.concat(host, _decoded(F.substring(pattern, F.length(host) + 1, F.length(pattern)))).alias("pattern"), "listed_on", "action")


def _active(looked: DataFrame, keys: Column, by: list[str], intervals: DataFrame) -> DataFrame:
    """The longest entry active for each row of ``looked`` (columns ``by`` and ``fetched_on``): ``best``."""
    on = [*by, "fetched_on"]
    keyed = looked.select(*on, F.pmod(F.xxhash64(*on), F.lit(PARTS)).cast("int").alias("part"), F.explode(keys).alias("pattern"))
    copies = intervals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    active = keyed.join(copies, ["pattern", "part"]).where("fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)")
    return active.groupBy(*on).agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from")).alias("best"))


def flag_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``page_id, url, fetched_on``) with ``host, blocked, entry, valid_from``.

    ``entry`` is the longest pattern active on the day of the fetch, null if none is. Captures without a
    host or date are never blocked; repeated rows and null ids are given as they come, and other columns are not read.
    ``entries`` are ``pattern`` (host, domain, or host and path; hosts in lower case), ``listed_on`` and ``action``.
    """
    named = captures.select("page_id", "url", "fetched_on", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    able = named.where("host != '' AND fetched_on IS NOT NULL")
    intervals = validity_intervals(_read_alike(entries)).withColumn("deep", F.col("pattern").rlike("[/?]"))
    # how many labels and steps entries have: a few numbers
    shape = F.struct("deep", F.when(F.col("deep"), F.size(F.split(F.regexp_replace("pattern", r"\?.*$", ""), "/+")) - 1).otherwise(F.when(F.col("pattern").rlike(_ADDRESS), 1).otherwise(F.size(F.split("pattern", r"\.")))).alias("size"), F.contains("pattern", F.lit("?")).alias("query"))
    shapes = [r.shape for r in intervals.select(shape.alias("shape")).distinct().collect()]
    labels, steps = (sorted({x.size for x in shapes if x.deep == deep and not x.query}) for deep in (False, True))
    hosts = _active(able.select("host", "fetched_on").distinct(), domains_of(F.col("host"), labels), ["host"], intervals.where("NOT deep").drop("deep"))
    found = named.join(hosts, ["host", "fetched_on"], "left")
    if any(x.deep for x in shapes):
        deep = intervals.where("deep").drop("deep")
        # only captures of hosts that have such entries are looked up by their paths
        of = deep.select(F.regexp_extract("pattern", "^[^/?]*", 0).alias("host")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        looked = able.select("host", "path", "fetched_on").distinct().withColumn("part", F.pmod(F.xxhash64("path", "fetched_on"), F.lit(PARTS)).cast("int"))
        keys = paths_of(F.col("host"), F.col("path"), steps, any(x.query for x in shapes))
        paths = _active(looked.join(of, ["host", "part"], "left_semi"), keys, ["host", "path"], deep).withColumnRenamed("best", "deeper")
        found = found.join(paths, ["host", "path", "fetched_on"], "left").withColumn("best", F.greatest("best", "deeper"))
    return found.select(
        "page_id",
        "url",
        "fetched_on",
        "host",
        F.isnotnull("best").alias("blocked"),
        F.col("best.pattern").alias("entry"),
        F.col("best.valid_from").alias("valid_from"),
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def dated_lists(urls: DataFrame) -> DataFrame:
    """A history of list entries for a table with ``url``: hosts, domains and paths that come, go and come back, by their hash.

    Null URLs and URLs without a host give none.
    """
    day = lambda n: F.date_add(F.lit(START).cast("date"), n)
    h, g = _number(F.col("pattern")), _number(F.concat(F.lit("d"), F.col("pattern")))
    named = urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    one = named.select(F.col("host").alias("pattern")).distinct()
    event = lambda test, on, action: F.when(test, F.struct(day(on).alias("listed_on"), F.lit(action).alias("action")))
    of_hosts = one.where(h % 4 == 0).select(
        "pattern",
        F.explode(F.array_compact(F.array(event(h >= 0, h % 200, "add"), event(h % 3 != 0, h % 200 + 60, "remove"), event(h % 5 == 0, h % 200 + 120, "add")))).alias("e"),
    )
    above = one.select(F.when(F.col("pattern").rlike(_ADDRESS), F.col("pattern")).otherwise(F.substring_index("pattern", ".", -3)).alias("pattern")).distinct()
    of_domains = above.where(g % 16 == 0).select("pattern", F.struct(day(g % 300).alias("listed_on"), F.lit("add").alias("action")).alias("e"))
    deep = named.select(F.explode(paths_of(F.col("host"), F.col("path"), [1], True)).alias("pattern")).distinct()
    of_paths = deep.where(g % 3 == 0).select("pattern", F.struct(day(g % 300).alias("listed_on"), F.lit("add").alias("action")).alias("e"))
    return of_hosts.unionByName(of_domains).unionByName(of_paths).select("pattern", "e.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active on the day it was fetched.

    The tables have neither fetch dates nor lists: the date follows from page_id, the lists from the pages' URLs.
    """
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit(START).cast("date"), F.pmod(F.pmod("page_id", F.lit(365)) * 37, F.lit(365)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_on"))
    return flag_captures(captures, dated_lists(pages.select("url")))


def op9_oracle() -> str:
    """The same rows in DuckDB SQL."""
    num = lambda x: f"('0x' || substr(md5({x}), 1, 6))::INT"
    code = "'0x' || substr(x, 1, 2)"
    part = f"CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '{_PLAIN_CODE}') THEN chr(({code})::INT) || substr(x, 3) WHEN regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN '%' || upper(substr(x, 1, 2)) || substr(x, 3) ELSE '%' || x END"
    return rf"""
    WITH u AS (SELECT page_id, url, replace(url, '\', '/') AS s FROM pages),
    c AS (SELECT page_id, url, DATE '{START}' + ((page_id % 365 * 37 % 365 + 365) % 365)::INT AS fetched_on,
                 regexp_replace(lower(coalesce(regexp_extract(s, '{_HOST}', 1), '')), '\.$', '') AS host,
                 coalesce(array_to_string(list_transform(string_split(regexp_extract(s, '{_PATH}', 1), '%'), lambda x, i: {part}), ''), '') AS path FROM u),
    steps AS (SELECT DISTINCT host, path, string_split(trim(regexp_replace(path, '\?.*$', ''), '/'), '/')[1] AS step FROM c WHERE host <> ''),
    deep AS (SELECT host, path, host || '/' || step AS pattern FROM steps WHERE step <> '' UNION ALL SELECT host, path, host || path FROM steps WHERE contains(path, '?')),
    hosts AS (SELECT DISTINCT host AS pattern, {num("host")} AS h FROM c WHERE host <> ''),
    doms AS (SELECT DISTINCT CASE WHEN regexp_matches(pattern, '{_ADDRESS}') THEN pattern ELSE array_to_string(string_split(pattern, '.')[-3:], '.') END AS pattern FROM hosts),
    e AS (SELECT pattern, DATE '{START}' + h % 200 AS listed_on, 'add' AS action FROM hosts WHERE h % 4 = 0
          UNION ALL SELECT pattern, DATE '{START}' + h % 200 + 60, 'remove' FROM hosts WHERE h % 4 = 0 AND h % 3 <> 0
          UNION ALL SELECT pattern, DATE '{START}' + h % 200 + 120, 'add' FROM hosts WHERE h % 4 = 0 AND h % 5 = 0
          UNION ALL SELECT pattern, DATE '{START}' + {num("'d' || pattern")} % 300, 'add' FROM doms WHERE {num("'d' || pattern")} % 16 = 0
          UNION ALL SELECT DISTINCT pattern, DATE '{START}' + {num("'d' || pattern")} % 300, 'add' FROM deep WHERE {num("'d' || pattern")} % 3 = 0),
    d AS (SELECT pattern, listed_on, max(action) = 'add' AS a FROM e GROUP BY ALL),
    t AS (SELECT * FROM d QUALIFY a <> lag(a, 1, false) OVER (PARTITION BY pattern ORDER BY listed_on)),
    i AS (SELECT pattern, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to, a FROM t),
    k AS (SELECT DISTINCT host, path, fetched_on, unnest(CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1),
            lambda n: array_to_string(string_split(host, '.')[n:], '.')) END) AS pattern FROM c
          UNION ALL SELECT DISTINCT host, path, fetched_on, pattern FROM c JOIN deep USING (host, path)),
    b AS (SELECT host, path, fetched_on, max({{'n': length(pattern), 'p': pattern, 'f': valid_from}}) AS best
          FROM k JOIN i USING (pattern) WHERE a AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to) GROUP BY ALL)
    SELECT page_id, url, fetched_on, host, best IS NOT NULL AS blocked, best.p AS entry, best.f AS valid_from
    FROM c LEFT JOIN b USING (host, path, fetched_on)
    """
