"""The library's queries over the given tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions import geo, text
from orderflow.jobs.schedule import ANSWERS, answer_orders
from orderflow.jobs.views import view, with_views
from orderflow.operators import confidence, evaluate, extract, gazetteer, generate, itinerary, stations, timetable
from orderflow.sources import records, tables
from orderflow.sources.scratch import scratch, stored
from orderflow.streaming import orders as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL and the views that uses."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _timetable(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return tables.timetable_of(view(spark, d, "stops"), view(spark, d, "stop_times"), view(spark, d, "trips"))


#: Layouts of stop times by application and folder: they are written once, and all searches of a session join them.
_LAYOUTS: dict[tuple[str, str], timetable.Layout] = {}


def _times(spark: SparkSession, d: str) -> timetable.Layout:
    key = (spark.sparkContext.applicationId, d)
    if key not in _LAYOUTS:
        _LAYOUTS[key] = timetable.stored_layout(_timetable(spark, d)["stop_times"])
    return _LAYOUTS[key]


def _stations(spark: SparkSession, d: str) -> DataFrame:
    return tables.stations(view(spark, d, "stations"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_orders(view(spark, d, "orders_text").select("order_id", "sentence"), view(spark, d, "cities"))


# ---- text functions -------------------------------------------------------------------------------------------------

_PLAIN = "replace(replace(replace(replace(replace(strip_accents(lower(text)), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'ø', 'o'), '’', '''')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_NORM_ASCII = _squeeze(rf"regexp_replace({_PLAIN}, '[^a-z0-9\s\-'']', ' ', 'g')")
_LOW_FRENCH = "replace(replace(trim(lower(text)), '’', ' '), chr(39), ' ')"
_NORM_FRENCH = _squeeze(rf"regexp_replace({_LOW_FRENCH}, '[^{text.KEPT_FRENCH}\s\-]', ' ', 'g')")


@_query(f"SELECT doc_id, md5({_NORM_ASCII}) AS norm FROM documents")
def norm_ascii(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "documents").select("doc_id", F.md5(text.norm_ascii(F.col("text"))).alias("norm"))


@_query(f"SELECT doc_id, md5({_NORM_FRENCH}) AS norm FROM documents")
def norm_french(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "documents").select("doc_id", F.md5(text.norm_french(F.col("text"))).alias("norm"))


@_query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def strip_accents(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("plain"))


_SAID = "concat(' ', text, CASE turn % 4 WHEN 0 THEN ' ; Merci bien' WHEN 1 THEN ', s''il  te plait !' WHEN 2 THEN ' ?!' ELSE ' demain' END)"


@_query(rf"SELECT conv_id, turn, trim(trim(regexp_replace({_SAID}, '(?is)\b(?:{text.POLITE.replace(chr(39), chr(39) * 2)})\b.*', ''), '{text.ENDS}')) AS slot FROM conversations")
def clean_slot(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "conversations").select("conv_id", "turn", text.clean_slot(F.expr(_SAID)).alias("slot"))


@_query(
    r"""SELECT uic_code, list_filter(regexp_split_to_array(uic_code, '[;,\s]+'), lambda x: regexp_matches(x, '^\d{8}$')) AS codes,
        nullif(regexp_extract(concat('StopPoint:', uic_code), '(\d{8})', 1), '') AS code FROM {raw_stations}""",
    "raw_stations",
)
def station_codes(spark: SparkSession, d: str) -> DataFrame:
    code = text.code_in_id(F.concat(F.lit("StopPoint:"), F.col("uic_code")))
    return view(spark, d, "raw_stations").select("uic_code", text.codes_in(F.col("uic_code")).alias("codes"), code.alias("code"))


@_query(
    """WITH p AS (SELECT uic_code, string_split(position, ',') AS x FROM {raw_stations}),
    n AS (SELECT uic_code, len(x) AS k, TRY_CAST(trim(x[1]) AS DOUBLE) AS a, TRY_CAST(trim(x[2]) AS DOUBLE) AS b FROM p)
    SELECT uic_code, CASE WHEN k = 2 AND a IS NOT NULL AND b IS NOT NULL THEN a END AS latitude,
           CASE WHEN k = 2 AND a IS NOT NULL AND b IS NOT NULL THEN b END AS longitude FROM n""",
    "raw_stations",
)
def split_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "raw_stations").withColumn("at", text.coordinates(F.col("position"))).select("uic_code", "at.latitude", "at.longitude")


_HYPHENLESS = _squeeze("replace(b, '-', ' ')")
_ODD_NAME = "concat(' Saint-', p_name, '  l’', p_brand, ' ')"


@_query(
    rf"""WITH n AS (SELECT p_partkey, trim({_ODD_NAME}) AS a FROM part), s AS (SELECT *, replace(a, '’', '''') AS b FROM n)
    SELECT DISTINCT p_partkey, unnest([a, b, {_HYPHENLESS}, regexp_replace(b, '\s+', '-', 'g')]) AS variant FROM s"""
)
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "part").select("p_partkey", F.explode(text.name_variants(F.expr(_ODD_NAME))).alias("variant"))


@_query(
    """WITH s AS (SELECT uic_code, latitude AS a, longitude AS b, latitude * 0.9 AS c, longitude + 1.5 AS d FROM {stations}),
    h AS (SELECT *, sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2 AS x FROM s)
    SELECT uic_code, a AS latitude, round(2 * 6371.0 * atan2(sqrt(x), sqrt(1 - x)), 6) AS km FROM h""",
    "stations",
)
def great_circle(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("latitude"), F.col("longitude")
    return view(spark, d, "stations").select("uic_code", "latitude", F.round(geo.great_circle_km(a, b, a * 0.9, b + 1.5), 6).alias("km"))


def _u(key: str, salt: str, seed: int = 0) -> str:
    """A draw in SQL, as ``text.uniform``."""
    return f"(('0x' || substr(md5(concat_ws('|', {key}, '{salt}', '{seed}')), 1, 8))::BIGINT / 4294967296.0)"


def _at(u: str, size: str, inner: int) -> str:
    return f"(floor({u} * greatest({size} - {inner}, 1))::BIGINT + 2)"


_CUT = "concat(substr({s}, 1, {i} - 1), substr({s}, {i} + 1))"
_SWAP = "concat(substr({s}, 1, {i} - 1), substr({s}, {i} + 1, 1), substr({s}, {i}, 1), substr({s}, {i} + 2))"


def _option(options, u: str) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + f"])[floor({u} * {len(options)})::INT + 1]"


def _mild_sql(name: str, key: str, seed: int = 0) -> str:
    s, u = f"strip_accents({name})", _u(key, "typo place", seed)
    dropped, swapped = _CUT.format(s=s, i=_at(u, f"length({s})", 2)), _SWAP.format(s=s, i=_at(u, f"length({s})", 3))
    return f"CASE WHEN length({s}) < 4 THEN {s} WHEN {_u(key, 'typo kind', seed)} < 0.5 THEN {dropped} ELSE {swapped} END"


def _controlled_sql(name: str, key: str, seed: int = 0) -> str:
    i, kind = _at(_u(key, "slip place", seed), f"length({name})", 2), _u(key, "slip kind", seed)
    vowel = _option("aeiouy", _u(key, "slip vowel", seed))
    return f"""CASE WHEN length({name}) < 4 OR {_u(key, "slip", seed)} >= 0.35 THEN {name} WHEN {kind} < 0.25 THEN {_SWAP.format(s=name, i=i)} WHEN {kind} < 0.5 THEN {_CUT.format(s=name, i=i)}
        WHEN {kind} < 0.75 THEN concat(substr({name}, 1, {i}), substr({name}, {i})) ELSE concat(substr({name}, 1, {i} - 1), {vowel}, substr({name}, {i} + 1)) END"""


@_query(f"SELECT p_partkey, p_name, {_mild_sql('p_name', 'p_partkey')} AS mild, {_controlled_sql('p_name', 'p_partkey')} AS controlled FROM part")
def typo_names(spark: SparkSession, d: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    return view(spark, d, "part").select("p_partkey", "p_name", text.mild_typo(name, key).alias("mild"), text.controlled_typo(name, key).alias("controlled"))


# ---- order lines and extraction -------------------------------------------------------------------------------------


@_query(
    """WITH t AS (SELECT trim(value) AS v FROM {lines}), p AS (SELECT v, instr(v, ',') AS i FROM t WHERE v <> '')
    SELECT trim(CASE WHEN i = 0 THEN v ELSE substr(v, 1, i - 1) END) AS order_id, CASE WHEN i > 0 THEN trim(substr(v, i + 1)) END AS sentence,
           CASE WHEN i = 0 THEN 'INVALID_FORMAT' ELSE 'OK' END AS status FROM p""",
    "lines",
)
def order_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.order_lines(view(spark, d, "lines"))


@_query(
    """WITH p AS (SELECT string_split(value, ',') AS x FROM {pair_lines}), t AS (SELECT trim(x[1]) AS order_id, trim(x[2]) AS departure, trim(array_to_string(x[3:], ',')) AS destination FROM p WHERE len(x) >= 3)
    SELECT * FROM t WHERE order_id <> '' AND departure <> '' AND destination <> ''""",
    "pair_lines",
)
def triplets(spark: SparkSession, d: str) -> DataFrame:
    return tables.triplets(view(spark, d, "pair_lines"))


@_query(
    f"""WITH s AS (SELECT conv_id, turn, {_NORM_ASCII} AS n FROM conversations)
    SELECT conv_id, turn, contains(n, 'a') OR contains(n, 'de') OR contains(n, 'rendre') OR contains(n, 'bus') OR contains(n, 'vers') AS travel FROM s"""
)
def travel_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "conversations").select("conv_id", "turn", extract.is_about_travel(F.col("text")).alias("travel"))


_TO = "(?:a|à)"
_CUTS = (
    (rf"(?i)\bde\s+(.+?)\s+{_TO}\s+(.+?)\b", 1, 2),
    (rf"(?i)\bdepuis\s+(.+?)\s+{_TO}\s+(.+?)\b", 1, 2),
    (r"(?i)\bde\s+(.+?)\s+vers\s+(.+?)\b", 1, 2),
    (rf"(?i)\b(?:aller|vais|va|allons|allez)\s+{_TO}\s+(.+?)\s+depuis\s+(.+?)\b", 2, 1),
    (rf"(?i)\brendre\s+{_TO}\s+(.+?)\s+depuis\s+(.+?)\b", 2, 1),
)
_SLOT = lambda g: "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{c[0]}') THEN regexp_extract(sentence, '{c[0]}', {c[g]})" for c in _CUTS) + " END"
_SLOTS_SQL = f"cut AS (SELECT order_id, sentence, {_SLOT(1)} AS dep_slot, {_SLOT(2)} AS dest_slot FROM {{orders_text}})"
_PARSED_SQL = f"""{_SLOTS_SQL},
    slot AS (SELECT dep_slot AS slot FROM cut WHERE dep_slot IS NOT NULL UNION SELECT dest_slot FROM cut WHERE dest_slot IS NOT NULL),
    contained AS (SELECT slot, count(*) AS n, min(city) AS city FROM slot JOIN {{cities}} ON contains(slot, city) GROUP BY slot),
    held AS (SELECT * FROM contained UNION ALL SELECT slot, 1, city FROM slot JOIN {{cities}} ON replace(slot, 'bourgg', 'bourg') = city AND slot <> city),
    both_ AS (SELECT order_id, sentence, a.city AS x, b.city AS y FROM cut LEFT JOIN held a ON a.slot = dep_slot AND a.n = 1 LEFT JOIN held b ON b.slot = dest_slot AND b.n = 1),
    parsed AS (SELECT order_id, sentence, CASE WHEN x <> y THEN x END AS departure, CASE WHEN x <> y THEN y END AS destination, CASE WHEN x <> y THEN 'OK' ELSE 'INVALID' END AS status FROM both_)"""


@_query(f"WITH {_SLOTS_SQL} SELECT * FROM cut", "orders_text")
def order_slots(spark: SparkSession, d: str) -> DataFrame:
    return extract.order_slots(view(spark, d, "orders_text").select("order_id", "sentence"))


@_query(
    """WITH s AS (SELECT DISTINCT lower(station_name) AS slot FROM {stations})
    SELECT slot, CASE WHEN count(*) = 1 THEN min(city) END AS city, count(*) AS n_cities FROM s JOIN {cities} ON contains(slot, city) GROUP BY slot""",
    "stations", "cities",
)
def slot_cities(spark: SparkSession, d: str) -> DataFrame:
    return extract.contained_cities(view(spark, d, "stations").select(F.lower("station_name").alias("slot")).distinct(), view(spark, d, "cities"))


def _typos(spark: SparkSession, d: str) -> DataFrame:
    word = F.explode(F.split("p_name", " ")).alias("word")
    return view(spark, d, "part").select("p_partkey", word).select(text.mild_typo(F.col("word"), F.concat_ws("/", "p_partkey", "word")).alias("slot")).distinct()


@_query()
def fuzzy_slots(spark: SparkSession, d: str) -> DataFrame:
    """Mistyped part words against the dictionary."""
    return extract.fuzzy_cities(_typos(spark, d), view(spark, d, "cities")).select("slot", F.round("score", 6).alias("score"), "city")


@_query()
def fuzzy_matches(spark: SparkSession, d: str) -> DataFrame:
    """Mistyped part words against the dictionary by the index, at the score from which orders are accepted."""
    return extract.fuzzy_cities(_typos(spark, d), view(spark, d, "cities"), extract.LEAST_SCORE, indexed=True).select("slot", F.round("score", 6).alias("score"), "city")


@_query(f"WITH {_PARSED_SQL} SELECT * FROM parsed", "orders_text", "cities")
def parsed_orders(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


@_query(f"WITH {_PARSED_SQL} SELECT order_id, concat_ws(',', order_id, CASE WHEN status = 'OK' THEN concat_ws(',', departure, destination) ELSE status END) AS line FROM parsed", "orders_text", "cities")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.order_answers(_parsed(spark, d))


@_query(f"WITH {_PARSED_SQL} SELECT concat_ws(',', order_id, departure, destination) AS line FROM parsed WHERE status = 'OK'", "orders_text", "cities")
def valid_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.valid_lines(tables.order_answers(_parsed(spark, d)), "line").select("line")


@_query(
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END AS departure, o_orderstatus AS destination FROM orders)
    SELECT order_id, CASE WHEN trim(departure) = '' THEN NULL ELSE [trim(departure), trim(destination)] END AS route,
           CASE WHEN trim(departure) = '' THEN 'INVALID_PATH' ELSE 'OK' END AS route_status FROM o"""
)
def route_cities(spark: SparkSession, d: str) -> DataFrame:
    blank = F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    rows = view(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), blank.alias("departure"), F.col("o_orderstatus").alias("destination"))
    return extract.route_cities(rows).select("order_id", "route", "route_status")


_MENTIONS_SQL = r"""tok AS (SELECT order_id, regexp_extract_all(sentence, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS ts, string_split_regex(sentence, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS gs FROM orders_text__v),
    pos AS (SELECT order_id, ts, gs, unnest(range(1, len(ts) + 1)) AS i FROM tok),
    said AS (SELECT order_id, ts[i] AS text, (length(array_to_string(gs[1:i], '')) + length(array_to_string(ts[1:i-1], '')))::INT AS start FROM pos WHERE ts[i] IN (SELECT city FROM cities__v))"""


@_query(f"WITH {_MENTIONS_SQL} SELECT order_id, text, start, (start + length(text))::INT AS \"end\" FROM said", "orders_text", "cities")
def city_mentions(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.mentions(view(spark, d, "orders_text"), view(spark, d, "cities").withColumnRenamed("city", "name"))


@_query(
    f"""WITH {_MENTIONS_SQL}, one AS (SELECT order_id, lower(text) AS l, min({{'s': start, 't': text}}) AS m FROM said GROUP BY ALL),
    two AS (SELECT order_id, list_sort(list(m)) AS ms FROM one GROUP BY order_id HAVING count(*) >= 2)
    SELECT order_id, ms[1].t AS departure, ms[2].t AS destination FROM two""",
    "orders_text", "cities",
)
def mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.first_two(city_mentions(spark, d))


# ---- stations -------------------------------------------------------------------------------------------------------


@_query(
    """WITH p AS (SELECT *, string_split(position, ',') AS x FROM {raw_stations}),
    n AS (SELECT station_name, trigram, uic_code, len(x) AS k, TRY_CAST(trim(x[1]) AS DOUBLE) AS latitude, TRY_CAST(trim(x[2]) AS DOUBLE) AS longitude FROM p)
    SELECT station_name, trigram, uic_code, latitude, longitude FROM n WHERE k = 2 AND station_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""",
    "raw_stations",
)
def clean_stations(spark: SparkSession, d: str) -> DataFrame:
    return tables.clean_stations(view(spark, d, "raw_stations"))


_CANDIDATES_SQL = """st AS (SELECT *, lower(station_name) AS n FROM {stations}), asked AS (SELECT city FROM {cities}),
    cand AS (SELECT city, station_name, uic_code, latitude, longitude,
        (CASE WHEN starts_with(n, city || ' ') THEN 20 ELSE 0 END + CASE WHEN contains(n, 'gare') THEN 10 ELSE 0 END + CASE WHEN contains(n, 'part dieu') THEN 8 ELSE 0 END
        + CASE WHEN contains(n, 'perrache') THEN 7 ELSE 0 END + CASE WHEN contains(n, 'saint') THEN 2 ELSE 0 END + CASE WHEN contains(n, 'st') THEN 2 ELSE 0 END
        + CASE WHEN contains(n, 'centre') THEN 2 ELSE 0 END + greatest(0, 12 - least(length(n), 60) // 5))::INT AS rank_score
      FROM st JOIN asked ON contains(' ' || n || ' ', ' ' || city || ' ')),
    top AS (SELECT *, (row_number() OVER (PARTITION BY city ORDER BY rank_score DESC, station_name, uic_code, latitude, longitude))::INT AS rank FROM cand QUALIFY rank <= 12)"""


@_query(f"WITH {_CANDIDATES_SQL} SELECT city, rank, rank_score, station_name, uic_code FROM top", "stations", "cities")
def station_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = stations.candidates_for_city(view(spark, d, "cities"), _stations(spark, d))
    return found.select("city", "rank", "rank_score", "station_name", "uic_code")


_OFFERED_SQL = """WITH s AS (SELECT order_id, unnest(string_split(lower(sentence), ' ')) AS w FROM {orders_text}),
    c AS (SELECT order_id, w, count(*) AS n FROM s WHERE length(w) >= 4 GROUP BY ALL),
    names AS (SELECT DISTINCT lower(station_name) AS n FROM {stations}),
    m AS (SELECT DISTINCT w, names.n FROM (SELECT DISTINCT w FROM c) JOIN names ON contains(names.n, w)),
    h AS (SELECT order_id, m.n, sum(c.n)::BIGINT AS hits FROM c JOIN m USING (w) GROUP BY ALL),
    k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY hits DESC, length(n), n) <= 12),
    f AS (SELECT order_id, hits, station_name, uic_code FROM k JOIN {stations} ON lower(station_name) = n)
    SELECT *, (row_number() OVER (PARTITION BY order_id ORDER BY hits DESC, length(station_name), station_name, uic_code))::INT AS rank FROM f QUALIFY rank <= 12"""


@_query(_OFFERED_SQL, "orders_text", "stations")
def free_text_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = stations.candidates_for_text(view(spark, d, "orders_text"), _stations(spark, d))
    return found.select("order_id", "hits", "station_name", "uic_code", "rank")


@_query(
    """WITH one AS (SELECT uic_code, min({'a': station_name, 'b': latitude, 'c': longitude}) AS s FROM stations__v GROUP BY uic_code)
    SELECT DISTINCT stop_code AS uic_code, s.a AS station_name, s.b AS latitude, s.c AS longitude FROM stops__v LEFT JOIN one ON stop_code = uic_code""",
    "stations", "stops",
)
def station_by_code(spark: SparkSession, d: str) -> DataFrame:
    return stations.by_code(view(spark, d, "stops").select(F.col("stop_code").alias("uic_code")).distinct(), _stations(spark, d))


@_query(
    """WITH q AS (SELECT DISTINCT substr(p_name, 2, 5) AS query FROM part), f AS (SELECT query, station_name, uic_code FROM q JOIN {stations} ON contains(lower(station_name), lower(query)))
    SELECT *, (row_number() OVER (PARTITION BY query ORDER BY station_name, uic_code))::INT AS rank FROM f QUALIFY rank <= 10""",
    "stations",
)
def station_search(spark: SparkSession, d: str) -> DataFrame:
    return stations.search(view(spark, d, "part").select(F.substring("p_name", 2, 5).alias("query")), _stations(spark, d))


_HUBS_SQL = """st AS (SELECT station_name, uic_code, trim(lower(station_name)) AS n FROM {stations}),
    t1 AS (SELECT city, st.*, 1 AS tier FROM {cities} JOIN st ON starts_with(n, city || ' ')),
    t2 AS (SELECT city, st.*, 2 AS tier FROM (SELECT city FROM {cities} WHERE city NOT IN (SELECT city FROM t1)) JOIN st ON contains(n, city)),
    sc AS (SELECT *, (greatest(0, 30 - length(n) // 3) + CASE WHEN contains(n, 'tgv') THEN 200 ELSE 0 END + CASE WHEN contains(n, 'gare') THEN 100 ELSE 0 END
        + CASE WHEN contains(n, 'centre') THEN 40 ELSE 0 END - CASE WHEN contains(n, 'halte') THEN 60 ELSE 0 END - CASE WHEN contains(n, 'car') THEN 80 ELSE 0 END)::INT AS hub_score
      FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)),
    hubs AS (SELECT city, station_name AS hub_name, uic_code AS hub_uic, hub_score FROM sc QUALIFY row_number() OVER (PARTITION BY city ORDER BY tier, hub_score DESC, station_name, uic_code) = 1)"""


@_query(f"WITH {_HUBS_SQL} SELECT * FROM hubs", "stations", "cities")
def hub_stations(spark: SparkSession, d: str) -> DataFrame:
    return stations.hub_of_city(view(spark, d, "cities"), view(spark, d, "stations"))


@_query(
    """SELECT unnest(['station_name', 'trigram', 'position', 'uic_code']) AS "column", count(*) AS n_rows,
       unnest([count(*) FILTER (station_name IS NULL), count(*) FILTER (trigram IS NULL), count(*) FILTER (position IS NULL), count(*) FILTER (uic_code IS NULL)]) AS n_null,
       unnest([count(DISTINCT station_name), count(DISTINCT trigram), count(DISTINCT position), count(DISTINCT uic_code)]) AS n_different FROM {raw_stations}""",
    "raw_stations",
)
def station_profile(spark: SparkSession, d: str) -> DataFrame:
    return stations.profile(view(spark, d, "raw_stations"))


@_query()
def station_sketches(spark: SparkSession, d: str) -> DataFrame:
    return stations.sketched_profile(view(spark, d, "raw_stations"))


@_query("SELECT * FROM {raw_stations} ORDER BY station_name NULLS FIRST, trigram NULLS FIRST, position NULLS FIRST, uic_code NULLS FIRST LIMIT 5", "raw_stations")
def station_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return stations.first_rows(view(spark, d, "raw_stations"))


@_query(
    """WITH l AS (SELECT DISTINCT station_name AS name FROM {stations} ORDER BY length(station_name) DESC, station_name LIMIT 600), t AS (SELECT DISTINCT station_name FROM {stations})
    SELECT station_name, upper(station_name) AS text, 7 AS start, (7 + length(station_name))::INT AS "end" FROM t WHERE lower(station_name) IN (SELECT lower(name) FROM l)""",
    "stations",
)
def station_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The longest station names in texts, in any case."""
    texts = view(spark, d, "stations").select("station_name").distinct().withColumn("said", F.concat(F.lit("Depuis "), F.upper("station_name"), F.lit(", svp !")))
    return gazetteer.mentions(texts, gazetteer.longest_names(view(spark, d, "stations")), ignore_case=True, id_col="station_name", text_col="said")


@_query("SELECT DISTINCT station_name AS name FROM {stations} ORDER BY length(station_name) DESC, station_name LIMIT 600", "stations")
def longest_station_names(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.longest_names(view(spark, d, "stations"))


# ---- timetable ------------------------------------------------------------------------------------------------------


@_query(
    r"""WITH c AS (SELECT station_id, station_name, unnest(list_filter(regexp_split_to_array(uic_code, '[;,\s]+'), lambda x: regexp_matches(x, '^\d{8}$'))) AS uic FROM station_asked__v),
    k AS (SELECT DISTINCT station_id, stop_id FROM c JOIN stops__v ON stop_code = uic),
    q AS (SELECT station_id, replace(lower(station_name), '#', ' ') AS n FROM station_asked__v WHERE station_id NOT IN (SELECT station_id FROM k)),
    b AS (SELECT DISTINCT station_id, stop_id FROM q JOIN stops__v ON contains(replace(lower(stop_name), '#', ' '), n))
    SELECT * FROM (SELECT * FROM k UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY stop_id) <= 30""",
    "station_asked", "stops",
)
def stops_of_stations(spark: SparkSession, d: str) -> DataFrame:
    return timetable.stops_of_stations(view(spark, d, "station_asked"), _timetable(spark, d)["stops"])


_DIRECT_SQL = """tm AS (SELECT trip_id, stop_id, departure_time, arrival_time, TRY_CAST(stop_sequence AS DOUBLE) AS seq FROM stop_times__v),
    o AS (SELECT DISTINCT query_id, stop_id FROM ends WHERE side = 'from'), g AS (SELECT DISTINCT query_id, stop_id FROM ends WHERE side = 'to'),
    oo AS (SELECT query_id, tm.* FROM tm JOIN o USING (stop_id)), gg AS (SELECT query_id, tm.* FROM tm JOIN g USING (stop_id)),
    direct AS (SELECT oo.query_id, oo.trip_id, oo.stop_id AS from_stop, oo.departure_time AS departure, gg.stop_id AS to_stop, gg.arrival_time AS arrival,
        (row_number() OVER (PARTITION BY oo.query_id ORDER BY oo.departure_time, gg.arrival_time, oo.trip_id, oo.stop_id, gg.stop_id))::INT AS rank
      FROM oo JOIN gg ON oo.query_id = gg.query_id AND oo.trip_id = gg.trip_id AND oo.seq < gg.seq)"""
_LEG_SQL = """{name} AS (SELECT {fixed}.query_id, b.trip_id, b.stop_id AS board_stop, b.departure_time AS board_time, l.stop_id AS leave_stop, l.arrival_time AS leave_time,
        (row_number() OVER (PARTITION BY {fixed}.query_id ORDER BY b.departure_time, l.arrival_time, b.trip_id, b.seq, l.seq, b.stop_id, l.stop_id))::INT AS rank
      FROM {b} b JOIN {l} l ON b.trip_id = l.trip_id AND b.seq < l.seq AND b.stop_id <> l.stop_id QUALIFY rank <= 400)"""
_OUT_SQL = _LEG_SQL.format(name="out_", fixed="b", b="oo", l="tm")
_IN_SQL = _LEG_SQL.format(name="in_", fixed="l", b="tm", l="gg")
_TRANSFER_SQL = f"""{_OUT_SQL}, {_IN_SQL},
    transfer AS (SELECT a.query_id, a.trip_id AS trip1, a.board_stop AS from_stop, a.board_time AS dep1, a.leave_stop AS transfer_stop, a.leave_time AS arr1,
        c.trip_id AS trip2, c.board_time AS dep2, c.leave_stop AS to_stop, c.leave_time AS arr2,
        (row_number() OVER (PARTITION BY a.query_id ORDER BY a.board_time, c.leave_time, c.board_time, a.trip_id, c.trip_id, a.leave_stop, a.board_stop, c.leave_stop, a.leave_time))::INT AS rank
      FROM out_ a JOIN in_ c ON a.query_id = c.query_id AND a.leave_stop = c.board_stop AND c.board_time >= a.leave_time)"""
_ENDS_SQL = "ends AS (SELECT * FROM ends__v)"


@_query(
    f"""WITH {_ENDS_SQL}, {_DIRECT_SQL} SELECT direct.*, coalesce(t.route_id, '') AS route_id, coalesce(a.stop_name, from_stop) AS from_name, coalesce(b.stop_name, to_stop) AS to_name
    FROM direct LEFT JOIN trips__v t ON t.trip_id = direct.trip_id LEFT JOIN stops__v a ON a.stop_id = from_stop LEFT JOIN stops__v b ON b.stop_id = to_stop WHERE rank <= 5""",
    "ends", "stop_times", "trips", "stops",
)
def direct_journeys(spark: SparkSession, d: str) -> DataFrame:
    known = _timetable(spark, d)
    found = timetable.direct_journeys(view(spark, d, "ends"), _times(spark, d))
    return timetable.named(found, known, {"trip_id": "route_id"}, {"from_stop": "from_name", "to_stop": "to_name"})


@_query(f"WITH {_ENDS_SQL}, {_DIRECT_SQL}, {_OUT_SQL} SELECT * FROM out_", "ends", "stop_times")
def outbound_legs(spark: SparkSession, d: str) -> DataFrame:
    return timetable.legs(view(spark, d, "ends"), _times(spark, d), "from")


@_query(f"WITH {_ENDS_SQL}, {_DIRECT_SQL}, {_IN_SQL} SELECT * FROM in_", "ends", "stop_times")
def inbound_legs(spark: SparkSession, d: str) -> DataFrame:
    return timetable.legs(view(spark, d, "ends"), _times(spark, d), "to")


@_query(
    f"""WITH {_ENDS_SQL}, {_DIRECT_SQL}, {_TRANSFER_SQL} SELECT transfer.*, coalesce(a.route_id, '') AS route1, coalesce(b.route_id, '') AS route2, coalesce(s.stop_name, transfer_stop) AS transfer_name
    FROM transfer LEFT JOIN trips__v a ON a.trip_id = trip1 LEFT JOIN trips__v b ON b.trip_id = trip2 LEFT JOIN stops__v s ON s.stop_id = transfer_stop WHERE rank <= 3""",
    "ends", "stop_times", "trips", "stops",
)
def transfer_journeys(spark: SparkSession, d: str) -> DataFrame:
    known = _timetable(spark, d)
    found = timetable.transfer_journeys(view(spark, d, "ends"), _times(spark, d))
    return timetable.named(found, known, {"trip1": "route1", "trip2": "route2"}, {"transfer_stop": "transfer_name"})


_UNCUT_SQL = _TRANSFER_SQL.replace(" QUALIFY rank <= 400", "")


@_query(
    f"""WITH {_ENDS_SQL}, {_DIRECT_SQL}, {_UNCUT_SQL} SELECT query_id, rank, trip1, from_stop, dep1, transfer_stop, arr1, trip2, dep2, to_stop, arr2 FROM transfer WHERE rank = 1""",
    "ends", "stop_times",
)
def exact_transfers(spark: SparkSession, d: str) -> DataFrame:
    """The first journey with one transfer among all rides of every pair."""
    return timetable.transfer_journeys(view(spark, d, "ends"), _times(spark, d), limit=1, most_legs=None)


_ANSWERS_SQL = """answers AS (SELECT query_id, 'direct' AS kind, trip_id AS trip1, departure AS dep1, arrival AS arr1, NULL AS transfer_stop, NULL AS trip2, NULL AS dep2, NULL AS arr2, from_stop, to_stop FROM direct WHERE rank = 1
      UNION ALL SELECT query_id, 'transfer', trip1, dep1, arr1, transfer_stop, trip2, dep2, arr2, from_stop, to_stop FROM transfer WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM direct))"""
# a city's stops: those with the code of its hub; if no stop has it, or there is no hub, those whose name holds the city's
_PLACES_SQL = """asked_c AS (SELECT departure AS city FROM pairs UNION SELECT destination FROM pairs),
    by_code AS (SELECT DISTINCT city, stop_id FROM asked_c JOIN hubs USING (city) JOIN stops__v ON stop_code = hub_uic),
    by_name AS (SELECT DISTINCT city, stop_id FROM asked_c JOIN stops__v ON contains(replace(lower(stop_name), '#', ' '), city) WHERE city NOT IN (SELECT city FROM by_code)),
    at_ AS (SELECT * FROM (SELECT * FROM by_code UNION ALL SELECT * FROM by_name) QUALIFY row_number() OVER (PARTITION BY city ORDER BY stop_id) <= 30),
    ends AS (SELECT query_id, 'from' AS side, stop_id FROM pairs JOIN at_ ON city = departure UNION ALL SELECT query_id, 'to', stop_id FROM pairs JOIN at_ ON city = destination)"""
_NAMED_SQL = """named AS (SELECT answers.*, coalesce(a.stop_name, from_stop) AS from_name, coalesce(t.stop_name, transfer_stop) AS transfer_name, coalesce(b.stop_name, to_stop) AS to_name,
        coalesce(x.route_id, '') AS route1, coalesce(y.route_id, '') AS route2
      FROM answers LEFT JOIN stops__v a ON a.stop_id = from_stop LEFT JOIN stops__v t ON t.stop_id = transfer_stop LEFT JOIN stops__v b ON b.stop_id = to_stop
        LEFT JOIN trips__v x ON x.trip_id = trip1 LEFT JOIN trips__v y ON y.trip_id = trip2)"""
_FLAGSHIP_SQL = f"""{_PARSED_SQL}, {_HUBS_SQL},
    pairs AS (SELECT DISTINCT departure, destination, concat(departure, '|', destination) AS query_id FROM parsed WHERE status = 'OK'),
    {_PLACES_SQL}, {_DIRECT_SQL}, {_TRANSFER_SQL}, {_ANSWERS_SQL}, {_NAMED_SQL},
    full_ AS (SELECT departure, destination, order_id, coalesce(kind, 'none') AS kind, trip1, dep1, arr1, transfer_stop, trip2, dep2, arr2, from_stop, to_stop, from_name, transfer_name, to_name, route1, route2
      FROM parsed JOIN pairs USING (departure, destination) LEFT JOIN named USING (query_id) WHERE status = 'OK'),
    written_ AS (SELECT order_id, CASE kind WHEN 'direct' THEN [concat_ws(',', order_id, departure, destination), concat_ws(',', order_id, 'SCHEDULE', 'DIRECT', departure, destination, dep1, arr1, trip1, from_name, to_name)]
        WHEN 'transfer' THEN [concat_ws(',', order_id, departure, transfer_name, destination), concat_ws(',', order_id, 'SCHEDULE', '1_TRANSFER', departure, destination, dep1, arr1, trip1, dep2, arr2, trip2, from_name, transfer_name, to_name)]
        ELSE [concat_ws(',', order_id, 'NO_SCHEDULE_FOUND', departure, destination)] END AS ls FROM full_)"""
_FLAGSHIP_VIEWS = ("orders_text", "cities", "stations", "stops", "stop_times", "trips")
_LINES_SQL = "SELECT order_id, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM written_"


@_query(f"WITH {_FLAGSHIP_SQL} SELECT {', '.join(ANSWERS)} FROM full_", *_FLAGSHIP_VIEWS)
def schedule_answers(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every order sentence to its timetable answer."""
    orders = view(spark, d, "orders_text").select("order_id", "sentence")
    return answer_orders(orders, view(spark, d, "cities"), view(spark, d, "stations"), _timetable(spark, d) | {"stop_times": _times(spark, d)})


@_query(f"WITH {_FLAGSHIP_SQL} {_LINES_SQL}", *_FLAGSHIP_VIEWS)
def schedule_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.schedule_lines(schedule_answers(spark, d))


@_query(
    """WITH s AS (SELECT row_number() OVER (PARTITION BY uic_code ORDER BY station_name, latitude, longitude) AS k, * FROM {stations}),
    p AS (SELECT uic_code AS order_id, k - 1 AS pos, station_name, latitude, longitude, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b, count(*) OVER (PARTITION BY uic_code) AS n FROM s WINDOW w AS (PARTITION BY uic_code ORDER BY k)),
    h AS (SELECT *, sin(radians(latitude - a) / 2) ** 2 + cos(radians(a)) * cos(radians(latitude)) * sin(radians(longitude - b) / 2) ** 2 AS x FROM p WHERE n >= 2)
    SELECT order_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'Départ' WHEN n - 1 THEN 'Arrivée' ELSE 'Étape' END AS label, station_name,
           CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE round(2 * 6371.0 * atan2(sqrt(x), sqrt(1 - x)), 6) END AS distance_km FROM h""",
    "stations",
)
def itineraries(spark: SparkSession, d: str) -> DataFrame:
    """Stations of a code as one journey, in the order of their names."""
    one = F.struct("station_name", "latitude", "longitude")
    rows = view(spark, d, "stations").groupBy("uic_code").agg(F.array_sort(F.collect_list(one)).alias("s")).where(F.size("s") >= 2)
    orders = rows.select(F.col("uic_code").alias("order_id"), F.col("s")[0].alias("departure"), F.slice("s", F.lit(2), F.size("s") - 2).alias("via"), F.element_at("s", -1).alias("arrival"))
    return itinerary.itineraries(orders).select("order_id", "pos", "label", F.col("station.station_name").alias("station_name"), F.round("distance_km", 6).alias("distance_km"))


# ---- confidence and evaluation --------------------------------------------------------------------------------------

_LITERAL_SQL = "contains(lower(sentence), lower({}))"


@_query(
    """WITH s AS (SELECT order_id, contains(lower(sentence), lower(expected_dep)) AS a, contains(lower(sentence), lower(expected_dest)) AS b FROM {orders_text})
    SELECT order_id, CASE WHEN a AND b THEN 0.93 WHEN a OR b THEN 0.85 ELSE 0.72 END::DOUBLE AS confidence, CASE WHEN a AND b THEN 'both_literal' WHEN a OR b THEN 'one_literal' ELSE 'none_literal' END AS strength,
           a AS departure_literal, b AS arrival_literal FROM s""",
    "orders_text",
)
def literal_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "orders_text")
    return rows.select("order_id", confidence.literal_confidence(F.col("sentence"), F.col("expected_dep"), F.col("expected_dest")).alias("c")).select("order_id", "c.*")


_RANKED_SQL = f"""{_CANDIDATES_SQL},
    lists AS (SELECT city, count(*) AS n, lower(string_agg(station_name, ' ' ORDER BY rank)) AS names FROM top GROUP BY city),
    j AS (SELECT order_id, sentence, departure, destination, status = 'OK' AS ok, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(a.names, '') AS sa, coalesce(b.names, '') AS sb
      FROM parsed LEFT JOIN lists a ON a.city = departure LEFT JOIN lists b ON b.city = destination),
    f AS (SELECT *, CASE WHEN contains(lower(sentence), departure) AND contains(lower(sentence), destination) THEN 0.93 WHEN contains(lower(sentence), departure) OR contains(lower(sentence), destination) THEN 0.85 ELSE 0.72 END AS base,
        least(0.10, greatest(0, (na - 3) * 0.02)) + least(0.10, greatest(0, (nb - 3) * 0.02)) AS amb,
        CASE WHEN contains(sa, destination) THEN 0.05 ELSE 0 END + CASE WHEN contains(sb, departure) THEN 0.05 ELSE 0 END AS con FROM j),
    resolved AS (SELECT order_id, ok, departure, destination, na AS n_dep, nb AS n_arr, round((CASE WHEN ok THEN greatest(0, base - amb - con) ELSE 0.15 END)::DOUBLE, 6) AS confidence, CASE WHEN ok THEN 'ok' ELSE 'invalid_or_ambiguous' END AS reason FROM f)"""
_RESOLVED_SQL = f"{_PARSED_SQL}, {_RANKED_SQL}"
_MENTION_PAIRS_SQL = f"""{_MENTIONS_SQL}, one AS (SELECT order_id, lower(text) AS l, min({{'s': start, 't': text}}) AS m FROM said GROUP BY ALL),
    two AS (SELECT order_id, list_sort(list(m)) AS ms FROM one GROUP BY order_id HAVING count(*) >= 2),
    pair AS (SELECT order_id, ms[1].t AS departure, ms[2].t AS destination FROM two)"""


def _resolved(spark: SparkSession, d: str, **options) -> DataFrame:
    return confidence.resolve(view(spark, d, "orders_text"), view(spark, d, "cities"), _stations(spark, d), **options)


def _short(rows: DataFrame, *more: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return rows.select("order_id", "ok", "departure", "destination", n("dep_candidates").alias("n_dep"), n("arr_candidates").alias("n_arr"), F.round("confidence", 6).alias("confidence"), "reason", *more)


@_query(f"WITH {_RESOLVED_SQL} SELECT * FROM resolved", "orders_text", "cities", "stations")
def resolved_orders(spark: SparkSession, d: str) -> DataFrame:
    return _short(_resolved(spark, d))


@_query(
    f"""WITH {_MENTION_PAIRS_SQL}, parsed AS (SELECT order_id, sentence, departure, destination, CASE WHEN departure IS NULL THEN 'INVALID' ELSE 'OK' END AS status FROM orders_text__v LEFT JOIN pair USING (order_id)),
    {_RANKED_SQL}, offered AS (SELECT order_id, string_agg(station_name, '|' ORDER BY rank) AS proposed FROM ({_OFFERED_SQL}) GROUP BY order_id)
    SELECT order_id, ok, departure, destination, n_dep, n_arr, confidence, CASE WHEN ok THEN 'ok' ELSE 'spacy_no_result_helpful' END AS reason, CASE WHEN NOT ok THEN proposed END AS proposed
    FROM resolved LEFT JOIN offered USING (order_id)""",
    "orders_text", "cities", "stations",
)
def resolved_by_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = _resolved(spark, d, mode="gazetteer", helpful=True)
    return _short(rows.withColumn("proposed", F.array_join(F.col("proposed.station_name"), "|")), "proposed")


_JUDGED_SQL = f"""{_PARSED_SQL}, judged AS (SELECT l.order_id, l.sentence, expected_dep, expected_dest, departure, destination,
      CASE WHEN expected_valid = 1 THEN CASE WHEN departure IS NULL THEN 'FALSE_NEGATIVE' WHEN departure = expected_dep AND destination = expected_dest THEN 'TP' ELSE 'WRONG_PAIR' END
           WHEN departure IS NULL THEN 'TN' ELSE 'FALSE_POSITIVE' END AS outcome
      FROM {{labelled}} l JOIN parsed p ON p.order_id = l.order_id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    found = extract.parsed_rows(view(spark, d, "labelled"), view(spark, d, "cities"))
    return evaluate.outcomes(found.select("row.*", "departure", "destination"))


@_query(f"WITH {_JUDGED_SQL} SELECT order_id, outcome FROM judged", "labelled", "orders_text", "cities")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("order_id", "outcome")


@_query(
    f"""WITH {_JUDGED_SQL}, n AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome IN ('FALSE_POSITIVE', 'WRONG_PAIR')) AS fp,
        count(*) FILTER (outcome IN ('FALSE_NEGATIVE', 'WRONG_PAIR')) AS fn, count(*) FILTER (outcome = 'TN') AS tn FROM judged),
    s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
    SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s""",
    "labelled", "orders_text", "cities",
)
def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    one = evaluate.scores(_judged(spark, d))
    return one.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query(
    f"WITH {_JUDGED_SQL} SELECT order_id, sentence, outcome, expected_dep, expected_dest, departure, destination FROM judged WHERE outcome NOT IN ('TP', 'TN') ORDER BY order_id LIMIT 20",
    "labelled", "orders_text", "cities",
)
def error_listing(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(_judged(spark, d), "order_id")


@_query(
    f"""WITH {_JUDGED_SQL} SELECT order_id AS sentence_id, sentence, outcome, expected_dep, expected_dest, departure, destination FROM judged WHERE outcome NOT IN ('TP', 'TN')
    ORDER BY CAST(order_id AS BIGINT) DESC LIMIT 20""",
    "labelled", "orders_text", "cities",
)
def errors_in_input_order(spark: SparkSession, d: str) -> DataFrame:
    """The first errors of labelled files as they stand there: several files, written from the last number to the first."""
    path = scratch(spark)
    rows = view(spark, d, "labelled").withColumnRenamed("order_id", "sentence_id").orderBy(F.col("sentence_id").cast("long").desc())
    tables.write_csv(rows.select("sentence_id", "sentence", "expected_dep", "expected_dest", "expected_valid"), path)
    found = extract.parsed_rows(tables.labelled_rows(spark, path, placed=True), view(spark, d, "cities"))
    return evaluate.errors(evaluate.outcomes(found.select("row.*", "departure", "destination")), "sentence_id", order=("place",))


@_query(
    f"""WITH {_PARSED_SQL}, l AS (SELECT order_id, concat_ws(',', order_id, CASE WHEN status = 'OK' THEN concat_ws(',', departure, destination) ELSE status END) AS line FROM parsed)
    SELECT row_number() OVER (ORDER BY CAST(order_id AS BIGINT) DESC) AS line_no, line FROM l""",
    "orders_text", "cities",
)
def answers_in_input_order(spark: SparkSession, d: str) -> DataFrame:
    """Order lines of several files, last number first, to numbered answer lines in input order, without a sort in one task."""
    path = scratch(spark)
    view(spark, d, "orders_text").orderBy(F.col("order_id").cast("long").desc()).select(F.concat_ws(",", "order_id", "sentence").alias("value")).write.text(path)
    orders = tables.order_lines(records.placed_lines(spark, path))
    return records.numbered(tables.order_answers(extract.parse_orders(orders, view(spark, d, "cities")))).select("line_no", "line")


@_query(
    f"""WITH {_PARSED_SQL} SELECT count(*) AS n, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status <> 'OK') AS n_invalid,
    round(100 * count(*) FILTER (status = 'OK') / count(*), 6) AS ok_percent, round(100 * count(*) FILTER (status <> 'OK') / count(*), 6) AS invalid_percent FROM parsed""",
    "orders_text", "cities",
)
def acceptance_rates(spark: SparkSession, d: str) -> DataFrame:
    one = evaluate.rates(_parsed(spark, d).withColumn("ok", F.col("status") == "OK"))
    return one.select("n", "n_ok", "n_invalid", *(F.round(c, 6).alias(c) for c in ("ok_percent", "invalid_percent")))


@_query(f"WITH {_RESOLVED_SQL} SELECT reason, count(*) AS n FROM resolved WHERE NOT ok GROUP BY reason ORDER BY n DESC, reason LIMIT 10", "orders_text", "cities", "stations")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failure_reasons(_resolved(spark, d))


# ---- generation, files and streams ----------------------------------------------------------------------------------


_DRAWN_SQL = f"""names AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS place FROM {{cities}}), size AS (SELECT count(*) AS n FROM names),
    draw AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, n, floor({_u("o_orderkey", "first", 42)} * n)::BIGINT AS a, floor({_u("o_orderkey", "second", 42)} * (n - 1))::BIGINT AS b,
        floor({_u("o_orderkey", "third", 42)} * (n - 2))::BIGINT AS c FROM orders, size),
    drawn AS (SELECT id, x.city AS dep, y.city AS dest, z.city AS other FROM draw JOIN names x ON x.place = a JOIN names y ON y.place = (a + 1 + b) % n
        JOIN names z ON z.place = (a + 1 + CASE WHEN c < b THEN c ELSE c + 1 END) % n)"""


def _filled_sql(template: str, **values: str) -> str:
    for name, value in values.items():
        template = f"replace({template}, '<{name}>', {value})"
    return template


def _slip_sql(side: str) -> str:
    slips = f"{_u('id', 'slips', 42)} < 0.25 AND {_u('id', f'slip {side}', 42)} < 0.5"
    return f"CASE WHEN {slips} THEN {_mild_sql(side, f'concat(id, {chr(39)}{side}{chr(39)}, id)', 42)} ELSE {side} END"


_KIND_SQL, _TYPED = _u("id", "kind", 42), {x: _slip_sql(x) for x in ("dep", "dest")}
# braces would name views
_PICK = lambda options, salt: _option([x.replace("{", "<").replace("}", ">") for x in options], _u("id", salt, 42))
_LABELLED_SQL = f"""WITH {_DRAWN_SQL}, typed AS (SELECT id, dep, dest, other, {_KIND_SQL} AS kind, {_TYPED["dep"]} AS dep2, {_TYPED["dest"]} AS dest2 FROM drawn)
    SELECT id AS sentence_id, CASE WHEN kind < 0.55 THEN {_filled_sql(_PICK(generate.VALID, "valid"), dep="dep2", dest="dest2")} WHEN kind < 0.75 THEN {_PICK(generate.TRASH, "trash")}
        WHEN kind < 0.90 THEN {_filled_sql(f"CASE WHEN {_u('id', 'half', 42)} < 0.5 THEN {_PICK(generate.GOAL_ONLY, 'goal')} ELSE {_PICK(generate.ORIGIN_ONLY, 'origin')} END", dep="dep", dest="dest")}
        ELSE {_filled_sql(_PICK(generate.AMBIGUOUS, "ambiguous"), dep="dep", dest="dest", other="other")} END AS sentence,
      CASE WHEN kind < 0.55 THEN dep END AS expected_dep, CASE WHEN kind < 0.55 THEN dest END AS expected_dest, (kind < 0.55)::INT AS expected_valid FROM typed"""


def _noise_sql() -> str:
    """The steps of ``text.with_noise``, one query over another."""
    u = lambda salt: _u("order_id", salt, 42)
    mixed = "array_to_string(list_transform(string_split(s, ''), lambda c, i: CASE WHEN %s < 0.2 THEN upper(c) ELSE lower(c) END), '')" % _u("concat(order_id, i - 1)", "mixed", 42)
    title = r"array_to_string(list_transform(regexp_extract_all(s, '\p{L}+|\P{L}+'), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '')"
    kind, blanks = u("case kind"), lambda salt: f"repeat(' ', floor({u(salt)} * 3)::INT)"
    steps = (
        ("accents", 0.25, "strip_accents(s)"),
        ("case", 0.30, f"CASE WHEN {kind} < 0.25 THEN lower(s) WHEN {kind} < 0.5 THEN upper(s) WHEN {kind} < 0.75 THEN {title} ELSE {mixed} END"),
        ("apostrophes", 0.20, "replace(replace(s, '’', ' '), chr(39), ' ')"),
        ("blanks", 0.20, rf"concat({blanks('before')}, trim(regexp_replace(s, '\s+', ' ', 'g')), {blanks('after')})"),
        ("end", 0.25, f"concat(s, {_option(('', '.', '!!', ' ?', ' ...', '!!!'), u('end kind'))})"),
    )
    out = "told"
    for salt, rate, changed in steps:
        out = f"(SELECT order_id, CASE WHEN {u(salt)} < {rate} THEN {changed} ELSE s END AS s FROM {out})"
    return out


_SLIPPED = {x: _controlled_sql(x, f"concat(id, '{x}', id)", 42) for x in ("dep", "dest", "other")}
_NOISY_SQL = f"""WITH {_DRAWN_SQL}, slipped AS (SELECT id, dep, {", ".join(f"{v} AS {k}2" for k, v in _SLIPPED.items())} FROM drawn),
    told AS (SELECT concat('S', lpad(id, greatest(5, length(id))::INT, '0')) AS order_id,
        CASE WHEN {_u("id", "invalid", 42)} < 0.25 THEN {_filled_sql(_PICK(generate.NO_ORDERS, "no order"), dep="dep")}
        ELSE {_filled_sql(_PICK(generate.ORDERS, "order"), dep="dep2", dest="dest2", other="other2")} END AS s FROM slipped)
    SELECT order_id, s AS sentence FROM {_noise_sql()}"""


@_query(_LABELLED_SQL, "cities")
def labelled_dataset(spark: SparkSession, d: str) -> DataFrame:
    return generate.labelled_orders(view(spark, d, "orders").select(F.col("o_orderkey").alias("id")), view(spark, d, "cities"))


@_query(_NOISY_SQL, "cities")
def noisy_dataset(spark: SparkSession, d: str) -> DataFrame:
    return generate.noisy_orders(view(spark, d, "orders").select(F.col("o_orderkey").alias("id")), view(spark, d, "cities"))


@_query()
def noisy_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow on noisy orders: acceptance of each way to find the pair, with its commonest reason of failure."""
    noisy, cities = stored(noisy_dataset(spark, d)), view(spark, d, "cities")
    each = []
    for mode in ("baseline", "gazetteer"):
        found = stored(confidence.resolve(noisy, cities, _stations(spark, d), mode=mode).select("ok", "reason"))
        first = evaluate.failure_reasons(found, 1).select(F.lit(mode).alias("mode"), F.col("reason").alias("main_reason"))
        each.append(evaluate.rates(found).withColumn("mode", F.lit(mode)).join(first, "mode", "left"))
    rows = each[0].unionByName(each[1])
    return rows.select("mode", "n", "n_ok", "n_invalid", *(F.round(c, 6).alias(c) for c in ("ok_percent", "invalid_percent")), "main_reason")


@_query("SELECT order_id AS sentence_id, sentence, expected_dep, expected_dest, expected_valid FROM {labelled}", "labelled")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows written as CSV and read back."""
    path = scratch(spark)
    rows = view(spark, d, "labelled").withColumnRenamed("order_id", "sentence_id")
    tables.write_csv(rows.select("sentence_id", "sentence", "expected_dep", "expected_dest", "expected_valid"), path)
    return tables.labelled_rows(spark, path)


@_query("SELECT order_id, sentence || ', \"vite\"' AS sentence FROM {orders_text} WHERE kind <> 0", "orders_text")
def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields of a CSV file without header; rows with a blank one are dropped."""
    path = scratch(spark)
    said = F.when(F.col("kind") == 0, F.lit(" ")).otherwise(F.concat("sentence", F.lit(', "vite"')))
    view(spark, d, "orders_text").select("order_id", said.alias("sentence"), F.lit("x").alias("more")).write.option("escape", '"').csv(path)
    return tables.benchmark_rows(spark, path)


@_query(_SQL["clean_stations"])
def station_files(spark: SparkSession, d: str) -> DataFrame:
    """Raw stations as a semicolon file with the source's headers, read, cleaned, written and read again."""
    raw, clean = scratch(spark), scratch(spark)
    back = {n: c for c, n in tables.RAW_STATIONS.items()}
    view(spark, d, "raw_stations").select(*(F.col(n).alias(f" {c}") for n, c in back.items())).write.option("header", True).option("sep", ";").option("escape", '"').csv(raw)
    tables.write_csv(tables.clean_stations(tables.raw_stations(spark, raw)), clean)
    rows = spark.read.option("header", True).option("escape", '"').csv(clean)
    return tables.stations(rows.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")})).drop("station_norm")


@_query(
    """SELECT t.trip_id, t.stop_sequence, t.departure_time, coalesce(route_id, '') AS route_id, concat('"', stop_name, '", Nord') AS stop_name, stop_code, concat('"', lower(replace(stop_name, '#', ' ')), '", nord') AS norm
    FROM stop_times__v t JOIN stops__v USING (stop_id) LEFT JOIN trips__v r ON r.trip_id = t.trip_id""",
    "stop_times", "stops", "trips",
)
def timetable_folder(spark: SparkSession, d: str) -> DataFrame:
    """A timetable written as text files with quoted names, read again and joined."""
    base = scratch(spark)
    named = view(spark, d, "stops").withColumn("stop_name", F.concat(F.lit('"'), "stop_name", F.lit('", Nord')))
    routes = view(spark, d, "trips").select("route_id").distinct()
    for name, rows in (("stops", named), ("stop_times", view(spark, d, "stop_times")), ("trips", view(spark, d, "trips")), ("routes", routes)):
        tables.write_csv(rows, f"{base}/{name}.txt")
    known = tables.timetable(spark, base)
    joined = known["stop_times"].join(known["stops"], "stop_id").join(known["trips"], "trip_id", "left")
    norm = F.concat(F.lit('"'), F.replace("stop_name_norm", F.lit(" nord"), F.lit('", nord')))
    return joined.select("trip_id", "stop_sequence", "departure_time", F.coalesce("route_id", F.lit("")).alias("route_id"), "stop_name", "stop_code", norm.alias("norm"))


@_query(
    """SELECT t.trip_id, t.stop_sequence, t.departure_time, concat(stop_name, chr(10), '"Nord", quai ', stop_code) AS stop_name, concat('Ligne', chr(10), coalesce(r.route_id, '')) AS route_id
    FROM stop_times__v t JOIN stops__v USING (stop_id) LEFT JOIN trips__v r ON r.trip_id = t.trip_id""",
    "stop_times", "stops", "trips",
)
def timetable_line_ends(spark: SparkSession, d: str) -> DataFrame:
    """A timetable whose fields hold line ends, quotes and commas, with columns that are not used, written as text files and read again."""
    base = scratch(spark)
    name = F.concat("stop_name", F.lit('\n"Nord", quai '), "stop_code")
    trips = view(spark, d, "trips").withColumn("route_id", F.concat(F.lit("Ligne\n"), "route_id"))
    out = {"stops": view(spark, d, "stops").select(F.lit("a,\nb").alias("stop_desc"), "stop_id", name.alias("stop_name"), "stop_code")}
    out |= {"stop_times": view(spark, d, "stop_times"), "trips": trips, "routes": trips.select("route_id").distinct()}
    for table, rows in out.items():
        tables.write_csv(rows, f"{base}/{table}.txt")
    known = tables.timetable(spark, base)
    joined = known["stop_times"].join(known["stops"], "stop_id").join(known["trips"], "trip_id", "left")
    return joined.select("trip_id", "stop_sequence", "departure_time", "stop_name", F.coalesce("route_id", F.lit("Ligne\n")).alias("route_id"))


@_query("SELECT city FROM {cities}", "cities")
def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    view(spark, d, "cities").select(F.concat(F.lit("  "), "city", F.lit(" ")).alias("value")).unionByName(spark.sql("SELECT '# names' AS value UNION ALL SELECT ' '")).write.text(path)
    return tables.dictionary(spark, path, comments=True)


@_query("WITH " + _PARSED_SQL + ", l AS (SELECT order_id, concat_ws(',', order_id, CASE WHEN status = 'OK' THEN concat_ws(',', departure, destination) ELSE status END) AS line FROM parsed) SELECT * FROM l", "orders_text", "cities")
def stream_orders(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as a stream of text files, answered in micro-batches."""
    base = scratch(spark)
    view(spark, d, "orders_text").select(F.concat_ws(",", "order_id", "sentence").alias("value")).write.text(f"{base}/in")
    streams.resolve_stream(streams.order_stream(spark, f"{base}/in"), view(spark, d, "cities"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("order_id string, line string").parquet(f"{base}/out/*")


@_query(_SQL["stream_orders"])
def stream_appended(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as one streaming plan with known pairs of slots in the state store: half of the files, and then, started again, the rest."""
    base, rows = scratch(spark), view(spark, d, "orders_text")
    for half in (0, 1):
        part = rows.where(F.pmod(F.col("order_id").cast("long"), F.lit(2)) == half)
        part.select(F.concat_ws(",", "order_id", "sentence").alias("value")).write.mode("append").text(f"{base}/in")
        answers = streams.answered_lines(streams.order_stream(spark, f"{base}/in"), view(spark, d, "cities"))
        streams.append_stream(answers, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("order_id string, line string").parquet(f"{base}/out")


@_query(f"WITH {_FLAGSHIP_SQL} {_LINES_SQL}", *_FLAGSHIP_VIEWS)
def stream_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cities that arrive as lines in files, answered with schedule lines in micro-batches."""
    base = scratch(spark)
    tables.valid_lines(tables.order_answers(_parsed(spark, d)), "line").select("line").write.text(f"{base}/in")
    lines = streams.order_stream(spark, f"{base}/in")
    streams.schedule_stream(lines, view(spark, d, "stations"), _timetable(spark, d), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("order_id string, line_no int, line string").parquet(f"{base}/out/*")
