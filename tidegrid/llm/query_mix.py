"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import mixing
from tidegrid.llm.common import table
from tidegrid.llm.queries import register

MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('13/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, CAST(sum(s) OVER () AS BIGINT) AS t, coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, r)),
f AS (SELECT *, 3 * s * rest < w * (t - before) AS capped FROM c),
g AS (SELECT *, CASE WHEN capped THEN 3.0::DOUBLE * s ELSE CAST((t - coalesce(sum(3 * s) FILTER (capped) OVER (), 0)) * w AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target,
 greatest(64, (t + 1048575) // 1048576) AS b FROM f),
n AS (SELECT *, (s + b - 1) // b AS n FROM g),
q AS (SELECT *, s // nullif(n, 0) AS l, s % nullif(n, 0) AS o, CAST(least(3 * n, floor(target * n / nullif(s, 0) + 0.5)) AS BIGINT) AS q,
 CAST('0x' || substr(md5('13/' || coalesce(source, '')), 1, 13) AS BIGINT) % nullif(n, 0) AS c FROM n),
p AS (SELECT d.*, q.s, q.target, q.n, q.l, q.o, q.q, q.c, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, CASE WHEN pos < o * (l + 1) THEN pos // (l + 1) ELSE o + (pos - o * (l + 1)) // greatest(l, 1) END AS a,
 CASE WHEN pos + size - 1 < o * (l + 1) THEN (pos + size - 1) // (l + 1) ELSE o + (pos + size - 1 - o * (l + 1)) // greatest(l, 1) END AS z FROM p WHERE size > 0),
j AS (SELECT * EXCLUDE (a, z), unnest(range(CAST(a AS BIGINT), CAST(z AS BIGINT) + 1)) AS j FROM x),
k AS (SELECT doc_id, h, least((j + 1) * l + least(j + 1, o), pos + size) - greatest(j * l + least(j, o), pos) AS words, greatest((q - (j * 2147483647 + c) % n + n - 1) // n, 0) AS times FROM j),
y AS (SELECT doc_id, CAST(sum(words * times) AS BIGINT) AS taken FROM k GROUP BY doc_id)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN y USING (doc_id)"""


@register("op13_mixing", MIX_SQL)
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda total, p: total + p["length"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
