"""Query of the ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import search
from tidegrid.llm.common import table
from tidegrid.llm.queries import register

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""WITH d AS (SELECT * FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
g AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark),
t AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM t GROUP BY w), g),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len * n) // l)))) AS BIGINT) AS score FROM q JOIN t USING (w) JOIN f USING (w), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


@register("op12_search", SEARCH_SQL)
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
