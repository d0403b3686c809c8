"""Quality rules as a ledger: each rule is evaluated once, and policies are bit masks over what was stored.

``ledger`` adds the measurements and ``failed``, one bit for each rule. A policy is a named, versioned set of rules;
to apply another one, or to ask what each rule alone removes, only the stored bits are read. Everything is a column
expression: no shuffle but for the ablation's counts, which are sums over bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import SPACE, fresh, text_of

#: Words of a window that is looked for again in the same text.
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: name -> fails, from the measurements. The place in the list is the rule's bit: append only.
RULES: list[tuple[str, Callable[[dict[str, Column]], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
]

#: Policy versions: rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines"],
}


def mask(policy: str | list[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def _pairs(values: str, apart: int, n: Column) -> Column:
    """Hashes of each value with the one ``apart`` places on."""
    rest = F.greatest(n - apart, F.lit(0))
    return F.zip_with(F.slice(values, 1, rest), F.slice(values, apart + 1, rest), lambda a, b: F.xxhash64(a, b))


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """The table with one struct column ``name`` (a longer name if taken): measurements (long) and ``failed``.

    Null text: as an empty one, which fails ``few_words``. Nulls elsewhere, repeated rows and ids: every row is
    measured by itself. Empty table: no rows.
    """
    name = fresh(docs, name)
    c = {k: fresh(docs, f"_{name}_{k}") for k in ("t", "words", "lines", "n", "h1", "h2", "h4", "h8", "sorted", "places", "at")}
    col = {k: F.col(v) for k, v in c.items()}
    df = docs.withColumn(c["t"], text_of(text_col))
    df = df.withColumns({
        c["words"]: F.array_remove(F.split(col["t"], SPACE + "+"), ""),
        c["lines"]: F.filter(F.split(col["t"], "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({c["n"]: F.size(col["words"]), c["h1"]: F.transform(col["words"], lambda w: F.xxhash64(w))})
    for apart in (1, 2, 4):  # hashes of 2, 4 and 8 words
        before, after = f"h{apart}", f"h{2 * apart}"
        df = df.withColumn(c[after], _pairs(c[before], apart, F.size(col[before])))
    # windows in order of their hash, for texts that have one twice: equal ones are neighbours
    repeats = F.size(F.array_distinct(col["h8"])) < F.size(col["h8"])
    df = df.withColumn(c["sorted"], F.when(repeats, F.array_sort(F.transform(col["h8"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    df = df.withColumn(
        c["places"],
        F.transform(
            col["sorted"],
            lambda e, i: F.when((e["x"] == F.get(col["sorted"], i - 1)["x"]) | (e["x"] == F.get(col["sorted"], i + 1)["x"]), e["i"]),
        ),
    )
    df = df.withColumn(c["at"], F.array_sort(F.filter(col["places"], lambda p: p.isNotNull())))
    steps = F.zip_with(
        F.slice(col["at"], 2, F.size(col["at"]) - 1), F.slice(col["at"], 1, F.size(col["at"]) - 1),
        lambda later, p: F.least(later - p, F.lit(WINDOW)),
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)
    has_symbol = col["t"].rlike(r"[#*$%&|<>]")
    m = {
        "n_words": col["n"],
        "word_chars": F.length(F.array_join(col["words"], "")),
        "n_symbols": F.when(has_symbol, F.length(col["t"]) - F.length(F.translate(col["t"], "#*$%&|<>", ""))).otherwise(0),
        "n_lines": F.size(col["lines"]),
        "n_dup_lines": F.size(col["lines"]) - F.size(F.array_distinct(col["lines"])),
        "n_repeat_words": F.when(col["at"].isNotNull(), covered).otherwise(0),
    }
    df = df.withColumn(name, F.struct(*(m[k].cast("long").alias(k) for k in MEASURES)))
    stored = {k: F.col(name)[k] for k in MEASURES}
    failed = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(RULES):
        failed = failed + F.when(fails(stored), F.lit(1 << bit)).otherwise(0)
    # always true; as it is not deterministic, a filter on the bits stays above and does not repeat what is below
    here = F.monotonically_increasing_id() >= 0
    return df.withColumn(name, F.col(name).withField("failed", F.when(here, failed))).drop(*c.values())


def passes(failed: Column, policy: str | list[str] = "v1") -> Column:
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(ledgers: DataFrame, policy: str | list[str] = "v1", name: str = "ledger") -> DataFrame:
    """For each rule of the policy: texts that fail it, texts that it alone rejects, and texts kept without it."""
    failed, whole = F.col(name)["failed"], mask(policy)
    here = failed.bitwiseAND(F.lit(whole))
    rules = [(bit, rule) for bit, (rule, _) in enumerate(RULES) if whole >> bit & 1]
    sums = [F.count("*").alias("n"), F.coalesce(F.sum((here == 0).cast("long")), F.lit(0)).alias("kept")]
    for bit, _ in rules:
        sums.append(F.coalesce(F.sum(F.shiftright(here, bit).bitwiseAND(F.lit(1))), F.lit(0)).cast("long").alias(f"fails_{bit}"))
        sums.append(F.coalesce(F.sum((here == (1 << bit)).cast("long")), F.lit(0)).cast("long").alias(f"only_{bit}"))
    rows = F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.col(f"fails_{bit}").alias("n_failed"), F.col(f"only_{bit}").alias("n_only"), (F.col("kept") + F.col(f"only_{bit}")).alias("kept_without"), F.col("n"))
        for bit, rule in rules
    ))
    return ledgers.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def keep(docs: DataFrame, policy: str | list[str] = "v1", text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns as they were."""
    name = fresh(docs, "ledger")
    return ledger(docs, text_col, name).filter(passes(F.col(name)["failed"], policy)).drop(name)
