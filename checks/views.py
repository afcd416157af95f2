"""The log and catalogue views every check starts from, in Spark and in SQL.

Two logs: `sessions_e` (from events) has real times of day and ids, and
null tracks; `sessions_l` (from lineitem and orders) has 357 weeks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

ANCHOR_E, PARTIAL_E = date(2024, 1, 1), [1, 5]
ANCHOR_L, PARTIAL_L = date(1995, 1, 2), [1, 357]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts AS timestamp",
        "user_id",
        """CASE WHEN event_type = 'error' THEN NULL
                ELSE CAST(get_json_object(props, '$.k') AS BIGINT) % 20 END AS track_id""",
        """CASE event_type WHEN 'click' THEN 'skip' WHEN 'purchase' THEN 'like'
                WHEN 'error' THEN 'advertisement' ELSE 'play' END AS event_type""",
    )


SESSIONS_E = """
    SELECT *, CAST(floor(datediff('day', DATE '2024-01-01', CAST("timestamp" AS DATE)) / 7.0) AS BIGINT) + 1 AS week
    FROM (SELECT event_id, ts AS "timestamp", user_id,
        CASE WHEN event_type = 'error' THEN NULL
             ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 20 END AS track_id,
        CASE event_type WHEN 'click' THEN 'skip' WHEN 'purchase' THEN 'like'
             WHEN 'error' THEN 'advertisement' ELSE 'play' END AS event_type
    FROM events)"""


def sessions_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).selectExpr(
        "l_orderkey * 10 + l_linenumber AS event_id",
        "l_shipdate AS timestamp",
        "o_custkey AS user_id",
        "l_partkey AS track_id",
        "CASE l_returnflag WHEN 'N' THEN 'play' WHEN 'A' THEN 'skip' ELSE 'like' END AS event_type",
    )


SESSIONS_L = """
    SELECT *, CAST(floor(datediff('day', DATE '1995-01-02', CAST("timestamp" AS DATE)) / 7.0) AS BIGINT) + 1 AS week
    FROM (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_shipdate AS "timestamp", o_custkey AS user_id,
        l_partkey AS track_id,
        CASE l_returnflag WHEN 'N' THEN 'play' WHEN 'A' THEN 'skip' ELSE 'like' END AS event_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_TRACK_COLUMNS = """
    p_partkey AS track_id, p_name AS name, p_brand AS id_artist,
    p_size * 2 AS popularity, CAST(p_size AS BIGINT) * 10000000 AS duration_ms,
    CAST(p_partkey % 2 AS INT) AS explicit, CAST(p_partkey % 12 AS INT) AS key,
    CAST(p_partkey % 97 AS DOUBLE) / 97 AS danceability,
    CAST(p_partkey * 5 % 91 AS DOUBLE) / 91 AS energy,
    CAST(p_partkey * 3 % 59 AS DOUBLE) - 60 AS loudness,
    CAST(p_partkey * 11 % 53 AS DOUBLE) / 53 AS speechiness,
    CAST(p_partkey * 7 % 89 AS DOUBLE) / 89 AS acousticness,
    CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 83 AS DOUBLE) / 83 ELSE CAST(0 AS DOUBLE) END AS instrumentalness,
    CAST(p_partkey * 13 % 73 AS DOUBLE) / 73 AS liveness,
    CAST(p_partkey * 17 % 79 AS DOUBLE) / 79 AS valence,
    60 + CAST(p_partkey * 19 % 131 AS DOUBLE) AS tempo,
    CASE WHEN p_partkey % 20 = 0 THEN 'n/a'
         WHEN p_partkey % 5 = 1 THEN CAST(1950 + p_partkey % 70 AS STRING)
         WHEN p_partkey % 5 = 2 THEN concat(CAST(1950 + p_partkey % 70 AS STRING), '-05')
         ELSE concat(CAST(1950 + p_partkey % 70 AS STRING), '-05-06') END AS release_date"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    return spark.sql(f"SELECT {_TRACK_COLUMNS} FROM _part")


TRACKS = f"SELECT {_TRACK_COLUMNS} FROM part"

YEAR = """CAST(year(coalesce(try_strptime(release_date, '%Y-%m-%d'), try_strptime(release_date, '%Y-%m'),
    try_strptime(release_date, '%Y'))) AS INT)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        """CASE WHEN c_custkey % 10 = 0 THEN CAST(array() AS ARRAY<STRING>)
                ELSE array(c_mktsegment, concat('G', CAST(c_nationkey AS STRING))) END AS favourite_genres""",
    )


USERS = """
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN CAST([] AS VARCHAR[])
        ELSE [c_mktsegment, concat('G', CAST(c_nationkey AS STRING))] END AS favourite_genres
    FROM customer"""

ARTISTS = """
    SELECT p_brand AS id, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE concat('genre_', min(p_type)) END AS genre
    FROM part GROUP BY p_brand
    UNION ALL SELECT 'Brand#98', 'genre_x' UNION ALL SELECT 'Brand#99', NULL
    UNION ALL SELECT '-1', NULL UNION ALL SELECT '-1', NULL"""


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    return spark.sql(ARTISTS.replace("FROM part", "FROM _part"))


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views for a SQL check."""
    bodies = {
        "sessions_e": SESSIONS_E, "sessions_l": SESSIONS_L, "tracks": TRACKS,
        "users": USERS, "artists": ARTISTS,
    }
    return "WITH " + ", ".join(f"{n} AS ({bodies[n]})" for n in names)
