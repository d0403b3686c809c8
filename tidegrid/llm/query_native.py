"""Queries of the chat and licence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import chat, licences
from tidegrid.llm.common import table
from tidegrid.llm.queries import register

#: The added conversation: texts that are control strings of a template.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"

CHAT_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {_ESCAPED.format('role')} AS er, {_ESCAPED.format('text')} AS et FROM c),
t AS (SELECT *, len(regexp_extract_all(et, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')) + 5 AS n, length(er) + length(et) + 33 AS chars,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et) AS k FROM e),
s AS (SELECT *, k = 1 AND er = 'system' AS sys FROM t),
p AS (SELECT *, 2048 - coalesce(max(CASE WHEN sys THEN n END) OVER (PARTITION BY conv_id), 0) AS room,
 coalesce(max(CASE WHEN sys THEN chars END) OVER (PARTITION BY conv_id), 0) AS head,
 coalesce(sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s),
b AS (SELECT *, pos // greatest(room // 2, 1) AS slab, n > greatest(room // 2, 1) AS big FROM p WHERE NOT sys),
l AS (SELECT *, lag(slab) OVER o AS ls, lag(big) OVER o AS lb FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
w AS (SELECT *, sum(CAST(ls IS NULL OR ls <> slab OR big OR lb AS INT)) OVER (PARTITION BY conv_id ORDER BY k) AS w FROM l),
g AS (SELECT conv_id, w, min(k) AS first, min(pos) AS f, least(512, any_value(room) - sum(n)) AS back, sum(chars) AS chars, any_value(head) AS head FROM w GROUP BY conv_id, w),
h AS (SELECT g.conv_id, g.w, sum(w.chars) AS chars FROM g JOIN w ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k < g.first AND w.pos >= g.f - g.back AND g.back > 0 GROUP BY ALL),
x AS (SELECT g.conv_id, sum(g.chars + g.head + coalesce(h.chars, 0)) AS chars FROM g LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id AND g.w = h.w GROUP BY g.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 coalesce(string_agg(CASE WHEN er = 'assistant' THEN text END, '' ORDER BY k), '') AS loss, sum(chars) AS alone FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(coalesce(x.chars, alone) AS BIGINT) AS formatted_chars FROM d LEFT JOIN x ON d.conv_id IS NOT DISTINCT FROM x.conv_id"""


@register("op6_chat_windows", CHAT_SQL)
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    windows = chat.format_windows(given.unionByName(spark.createDataFrame(CONTROL, given.schema)))
    rows = chat.read_windows(windows).groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("x"), F.col("loss_texts").alias("y")))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
    )
    joined = lambda field: F.array_join(F.flatten(F.transform("all", lambda w: w[field])), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(joined("x").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("y")).cast("long").alias("loss_chars"), F.sha2(joined("y").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@register("op5_licence_scan")
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda e: e["family"])))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_paragraphs"), families.alias("families"), "licences")
