"""Media-library views over the driver's tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_EXT = "CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.JPG' WHEN 'de' THEN '.mp4' ELSE '.avi' END"
_SUFFIX = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-edited' WHEN 2 THEN concat('(', doc_id % 3 + 1, ')') WHEN 3 THEN '-edi' ELSE '.MP' END"
_LONG = "CASE WHEN doc_id % 11 = 0 THEN '_with_a_long_descriptive_title_that_goes_on' ELSE '' END"

#: Documents as files: rotating suffixes, an extension by language, a directory by source.
ASSETS = f"""
SELECT doc_id, source, text, concat('/src/', source) AS dir, concat('/src/', source, '/photo_', doc_id % 400, {_LONG}, {_SUFFIX}, {_EXT}) AS path,
       CASE WHEN length(source) < 5 THEN 'album' ELSE 'loose' END AS type
FROM documents
"""

#: Side files of most of them, with truncated suffixes and moved markers.
SIDECARS = f"""
SELECT DISTINCT concat('/src/', source, '/photo_', doc_id % 400,
       CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '_with_a_long_descriptive_title_that' ELSE '_with_a_long_descriptive_title_that_goes_on' END ELSE '' END,
       CASE WHEN doc_id % 11 = 0 AND doc_id % 2 = 0 THEN '' ELSE {_EXT} END,
       CASE doc_id % 4 WHEN 0 THEN '.supplemental-metadata' WHEN 1 THEN '.suppl' WHEN 2 THEN '' ELSE '.s' END,
       CASE WHEN doc_id % 5 = 2 THEN concat('(', doc_id % 3 + 1, ')') ELSE '' END, '.json') AS path
FROM documents WHERE doc_id % 7 <> 0
"""

#: Line items as records: an order is a group, most proposals are left out.
MEMBERS = """
SELECT concat('g', l_orderkey) AS group_id, concat('f', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', date_part('doy', l_shipdate), '.jpg') AS filename,
       l_shipdate AS first_date, l_linestatus AS album,
       CASE WHEN l_partkey % 40 = 0 THEN concat('Trip ', l_returnflag) WHEN l_partkey % 41 = 0 THEN 'bad/name' WHEN l_partkey % 43 = 0 THEN '' END AS proposed_album
FROM lineitem
"""

#: Members whose proposals never conflict and are names.
PLANNED = """
SELECT group_id, filename, min(first_date) AS first_date, min(CASE WHEN length(group_id) % 2 = 0 THEN album END) AS album,
       min(CASE WHEN length(group_id) = 5 THEN 'Summer' END) AS proposed_album
FROM members GROUP BY group_id, filename
"""

#: Places and points with made-up coordinates.
PLACES = "SELECT n_nationkey AS place_id, n_nationkey * 13 % 120 - 60.5 AS lat, n_nationkey * 37 % 340 - 170.25 AS lon, n_name AS name, concat('R', n_regionkey) AS admin1, substr(n_name, 1, 2) AS cc FROM nation"
POINTS = "SELECT c_custkey AS key, c_custkey * 17 % 1601 / 10 - 80 AS lat, c_custkey * 29 % 3501 / 10 - 175 AS lon FROM customer"

VIEWS = {"assets": ASSETS, "sidecars": SIDECARS, "members": MEMBERS, "planned": PLANNED, "places": PLACES, "points": POINTS}
_NEEDS = {"planned": ["members"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of sf_dir, without leaving names in the session."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    frames |= {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, [])}
    for k in frames:
        sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """The same views as common table expressions before a DuckDB query."""
    every = list(dict.fromkeys(n for name in names for n in [*_NEEDS.get(name, []), name]))
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in every) + ("," if sql.lstrip().startswith(",") else "") + " " + sql.lstrip().lstrip(",")
