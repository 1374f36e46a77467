"""Travel tables made from the given star schema, in SQL that Spark and DuckDB both run.

``{name}`` stands for a given table. The timetable is ``lineitem`` (an order is a trip, a supplier a stop). Cities are the words of
part names and a town for each supplier. Stations are parts, and the towns': of eight towns in turn some have a station whose code a stop
has, some a station whose code none has, some only a stop of their name, and some nothing. Order sentences go between towns; some
misspell one by a double letter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from orderflow.sources.scratch import spread

#: Given tables that are dealt to all cores if they are small, as heavy expressions run on them.
_SPREAD = ("orders", "documents", "conversations", "part")

VIEWS = {
    "stop_times": """
        SELECT CAST(l_orderkey AS STRING) AS trip_id, CAST(l_suppkey AS STRING) AS stop_id, CAST(l_linenumber AS STRING) AS stop_sequence,
               CAST(CAST(l_shipdate AS DATE) AS STRING) AS departure_time, CAST(CAST(l_shipdate AS DATE) AS STRING) AS arrival_time
        FROM {lineitem}""",
    "trips": "SELECT CAST(o_orderkey AS STRING) AS trip_id, CAST(o_custkey AS STRING) AS route_id FROM {orders}",
    "towns": "SELECT s_suppkey AS k, concat('bourg', translate(lpad(CAST(s_suppkey AS STRING), 10, '0'), '0123456789', 'afhjkmpquv')) AS town FROM {supplier}",
    "stops": """
        SELECT CAST(s_suppkey AS STRING) AS stop_id, CASE WHEN s_suppkey % 8 IN (0, 1, 2) THEN concat('Arret ', town) ELSE s_name END AS stop_name,
               lpad(CAST(s_suppkey AS STRING), 8, '0') AS stop_code
        FROM {supplier} JOIN {towns} ON k = s_suppkey""",
    "stations": """
        SELECT concat(p_name, ' ', p_type) AS station_name, lpad(CAST(p_partkey * 7 % 100 AS STRING), 8, '0') AS uic_code,
               40 + CAST(p_partkey % 1000 AS DOUBLE) / 100 AS latitude, CAST(p_partkey % 700 AS DOUBLE) / 100 AS longitude
        FROM {part}
        UNION ALL SELECT concat(CASE k % 2 WHEN 0 THEN 'Halte ' ELSE '' END, town, ' Gare'), lpad(CAST(CASE WHEN k % 8 IN (1, 3) THEN 99000000 + k ELSE k END AS STRING), 8, '0'),
               45 + CAST(k % 900 AS DOUBLE) / 100, CAST(k % 600 AS DOUBLE) / 100
        FROM {towns} WHERE k % 8 NOT IN (0, 7)""",
    "cities": "SELECT split_part(p_name, ' ', 1) AS city FROM {part} UNION SELECT split_part(p_name, ' ', 2) FROM {part} UNION SELECT town FROM {towns}",
    "orders_text": """
        SELECT CAST(o.o_orderkey AS STRING) AS order_id, o.o_orderkey % 10 AS kind, a.town AS expected_dep, b.town AS expected_dest,
          CASE o.o_orderkey % 10 WHEN 0 THEN 'Bonjour' WHEN 1 THEN concat('Je veux aller à ', b.town)
            WHEN 2 THEN concat('Je vais à ', b.town, ' depuis ', a.town) WHEN 3 THEN concat('Je veux un trajet de ', a.town, ' vers ', b.town)
            WHEN 4 THEN concat('Je souhaite me rendre à ', b.town, ' depuis ', a.town)
            WHEN 5 THEN concat('Je veux aller de ', a.town, ' ou ', b.town, ' à ', b.town)
            WHEN 6 THEN concat('Je veux aller de ', a.town, ' à ', a.town)
            WHEN 7 THEN concat('Je veux aller de ', replace(a.town, 'bourg', 'bourgg'), ' à ', b.town)
            ELSE concat('Je veux aller de ', a.town, ' à ', b.town) END AS sentence
        FROM {orders} o CROSS JOIN (SELECT count(*) AS n FROM {supplier}) s
        JOIN {towns} a ON a.k = o.o_orderkey % s.n JOIN {towns} b ON b.k = (o.o_orderkey * 7 + 3 + o.o_orderkey % 3) % s.n""",
    "labelled": """
        SELECT order_id, sentence, CASE WHEN n = 10 THEN 'nowhere' WHEN n IN (9, 19) OR kind IN (0, 1, 5, 6) THEN NULL ELSE expected_dep END AS expected_dep,
               CASE WHEN n = 10 THEN 'nowhere' WHEN n IN (9, 19) OR kind IN (0, 1, 5, 6) THEN NULL WHEN n = 8 THEN expected_dep ELSE expected_dest END AS expected_dest,
               CASE WHEN n = 10 THEN 1 WHEN n IN (9, 19) OR kind IN (0, 1, 5, 6) THEN 0 ELSE 1 END AS expected_valid
        FROM (SELECT *, CAST(order_id AS BIGINT) % 200 AS n FROM {orders_text}) AS o""",
    "lines": "SELECT CASE WHEN kind = 0 THEN sentence WHEN kind = 1 THEN '  ' ELSE concat(' ', order_id, ', ', sentence, ', svp ') END AS value FROM {orders_text}",
    "pair_lines": """
        SELECT concat(CAST(o_orderkey AS STRING), ',', CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', ', o_orderstatus, ',x') END) AS value
        FROM {orders}""",
    "ends": """
        SELECT CAST(s_suppkey AS STRING) AS query_id, 'from' AS side, CAST(s_suppkey AS STRING) AS stop_id FROM {supplier}
        UNION ALL SELECT CAST(s_suppkey AS STRING), 'to', CAST((s_suppkey * 7 + 3) % (SELECT count(*) FROM {supplier}) AS STRING) FROM {supplier}""",
    "raw_stations": """
        SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS station_name, p_brand AS trigram,
               CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_partkey % 13 = 0 THEN '48.5, x' ELSE concat(CAST(p_partkey % 90 AS STRING), '.5, ', CAST(p_size AS STRING), '.25') END AS position,
               concat(lpad(CAST(p_partkey AS STRING), 8, '0'), ';', lpad(CAST(p_partkey * 3 AS STRING), 8, '0'), ', 12 123456789') AS uic_code
        FROM {part}""",
    "station_asked": """
        SELECT CAST(p_partkey AS STRING) AS station_id, CASE WHEN p_partkey % 3 = 0 THEN concat('supplier#0000000', CAST(p_partkey % 90 + 10 AS STRING)) ELSE p_name END AS station_name,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(lpad(CAST(p_partkey % 100 AS STRING), 8, '0'), ';', lpad(CAST(p_partkey % 70 AS STRING), 8, '0')) END AS uic_code
        FROM {part}""",
}
_NAME = re.compile(r"\{([a-z_]\w*)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or else a given table."""
    if name not in VIEWS:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(rows) if name in _SPREAD else rows
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(VIEWS[name]))})


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL with the views it needs as common table expressions, in the order of their needs."""
    wanted: dict[str, None] = {}

    def need(name: str) -> None:
        if name in VIEWS:
            for n in _NAME.findall(VIEWS[name]):
                need(n)
            wanted[name] = None

    for name in names:
        need(name)
    parts = [f"{n}__v AS ({_NAME.sub(lambda m: m[1] + '__v' if m[1] in VIEWS else m[1], VIEWS[n])})" for n in wanted]
    query = _NAME.sub(lambda m: m[1] + "__v" if m[1] in VIEWS else m[1], query)
    body = query.strip()
    return "WITH " + ", ".join(parts) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
