"""Licence scan: paragraphs classified by sparse logistic regression on word n-grams, and compared with templates.

Fit (on the driver, from the paragraphs and names of ``licence_texts`` and at most ``OTHERS`` corpus paragraphs as the class
"other"): multinomial logistic regression over words and word pairs with soft thresholding, so few weights remain. Part of
the examples calibrates a temperature. The least probability of a named family is calibrated on families that the
model has not seen: a quarter of the families is left out at a time, and the bound is chosen that keeps apart left-out
families, which should be unknown, and examples of the known ones.

A cue is a word or pair that one family alone has, with a word that the corpus rarely has. A paragraph that is named has
one of its family's, so all of them are looked for and the look leaves out nothing that meets the conditions.

Scan (column expressions only, in the row, no shuffle): a text without a cue that does not speak of a licence is done at one
look. Else a line that is a whole notice by itself is a paragraph, and the other lines that follow one another without
a blank line are one, all without comment signs and of any length. A paragraph's class probabilities follow from the
weights; the best family must reach the calibrated bound, one of its templates (a notice's words, a name's pairs) must
share enough with the paragraph, and something of the family's own must stand there. Else the licence is "unknown" where the
paragraph speaks of a licence at all.
"""

from __future__ import annotations

import itertools
import json
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import fresh, text_of
from tidegrid.llm.licence_texts import NAMES, NOTICES

FAMILIES = sorted(NOTICES)
#: Corpus paragraphs of the class "other" that the fit takes at most; least share of a template; greatest share of the
#: corpus paragraphs that have a cue.
OTHERS, SHARED, COMMON = 1000, 0.6, 0.005
SIGNS = r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)?\s*|\s*(?:\*+/|-->)?\s*$"
#: Words by which a paragraph speaks of a licence.
SPEAKS = r"(?i)\b(licen[sc]ed?|licen[sc]es|copyright|spdx|redistribut\w+)\b"
#: Examples of a notice or name that the fit makes; parts of the families that are left out in turn.
COPIES, PARTS = 8, 4

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def pairs_of(words: list[str]) -> list[str]:
    return [" ".join(p) for p in zip(words, words[1:])]


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *pairs_of(words)})


def notice_templates(family: str) -> list[list[str]]:
    return [sorted(set(words_of(n))) for n in NOTICES[family]]


def name_templates(family: str) -> list[list[str]]:
    return [sorted(set(pairs_of(w) or w)) for w in map(words_of, NAMES[family])]


def own_grams(family: str) -> set[str]:
    """Words and pairs of a family's notices and names that no other family has."""
    of = lambda f: {g for text in NOTICES[f] + NAMES[f] for g in grams(words_of(text))}
    return of(family) - set().union(*(of(f) for f in FAMILIES if f != family))


@dataclass
class LicenceModel:
    weights: dict[str, list[float]]  # n-gram -> one weight a class; the last class is "other"
    bias: list[float]
    cues: list[str]
    own: dict[str, list[str]]  # what must stand in a paragraph that is named so
    temperature: float
    sure: float

    def probabilities(self, text: str) -> list[float]:
        margin = np.array(self.bias)
        for g in grams(words_of(text)):
            if g in self.weights:
                margin = margin + self.weights[g]
        e = np.exp((margin - margin.max()) / self.temperature)
        return (e / e.sum()).tolist()


def examples(others: list[str], families: list[str], seed: int = 5) -> tuple[list[list[str]], list[int]]:
    """Notices and names whole, with words left out and inside other text; and other paragraphs."""
    rng, rows, kinds = random.Random(seed), [], []
    spare = [words_of(o) for o in others] or [["the"]]
    ways = [[], ["released", "under"], ["this", "project", "is"], ["licensed", "under", "the"], ["license"], ["available", "under", "the"]]
    for family in families:
        texts = [(words_of(n), 0.1, [[]]) for n in NOTICES[family]] + [(words_of(n), 0.0, ways) for n in NAMES[family]]
        for (words, lost, leads), _ in itertools.product(texts, range(COPIES)):
            kept = [w for w in words if rng.random() >= lost]
            lead, tail = (rng.choice(spare)[: rng.randrange(6)] for _ in range(2))
            rows.append(lead + rng.choice(leads) + kept + tail)
            kinds.append(FAMILIES.index(family))
    rows += spare
    return rows, kinds + [len(FAMILIES)] * len(spare)


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _regress(x: np.ndarray, kinds: np.ndarray, rounds: int = 250, rate: float = 5.0, sparse: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all classes; classes without a row keep a bias that rules them out."""
    n = len(FAMILIES) + 1
    count = np.bincount(kinds, minlength=n)
    y, weight = np.eye(n, dtype=np.float32)[kinds], (1 / np.maximum(count, 1))[kinds].astype(np.float32)
    weight /= weight.mean()
    w, b = np.zeros((x.shape[1], n), np.float32), np.where(count > 0, 0.0, -1e4).astype(np.float32)
    for _ in range(rounds):
        g = weight[:, None] * (_softmax(x @ w + b) - y) / len(x)
        w -= rate * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / 10, 0)
        b -= rate * g.sum(0)
    return w, b


def template_share(words: list[str], family: str, names: bool = True) -> float:
    """The largest share of a template of the family that the words and their pairs have."""
    have = set(grams(words))
    templates = notice_templates(family) + (name_templates(family) if names else [])
    return max(len(have.intersection(t)) / len(t) for t in templates)


def fit(others: list[str]) -> LicenceModel:
    rows, kinds = examples(others, FAMILIES)
    kinds = np.array(kinds)
    known = sorted({g for f in FAMILIES for n in NOTICES[f] + NAMES[f] for g in grams(words_of(n))})
    place = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(place)), np.float32)
    for r, words in enumerate(rows):
        x[r, [place[g] for g in grams(words) if g in place]] = 1
    test = np.arange(len(rows)) % 5 == 0
    w, b = _regress(x[~test], kinds[~test])
    margins = x[test] @ w + b
    right = lambda t: np.log(np.take_along_axis(_softmax(margins / t), kinds[test][:, None], 1) + 1e-9).mean()
    temperature = max((0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=right)
    # own grams that the corpus rarely has
    # (of a pair, at least one word: pairs of common words are rare in short lines, but not in whole texts)
    seen = Counter(g for o in others for g in set(words_of(o)))
    rare = lambda g: any(seen[w] <= COMMON * len(others) and not w.isdigit() for w in g.split())
    own = {f: sorted(g for g in own_grams(f) if rare(g)) for f in FAMILIES}
    # a pair with a word that is a cue by itself adds nothing
    cues = {g for f in FAMILIES for g in own[f]}
    cues = {g for g in cues if " " not in g or cues.isdisjoint(g.split())}
    # probabilities of examples that the other conditions let pass: of known families, and of families that the model was
    # fitted without
    def best(which: np.ndarray, w: np.ndarray, b: np.ndarray, without: set[int]) -> np.ndarray:
        p = _softmax((x[which] @ w + b) / temperature)[:, :-1]
        p[:, sorted(without)] = 0
        named = [FAMILIES[k] for k in p.argmax(1)]
        passes = [template_share(rows[r], f) >= SHARED and not set(own[f]).isdisjoint(grams(rows[r])) for r, f in zip(np.flatnonzero(which), named)]
        return np.where(passes, p.max(1), 0.0)

    family = kinds < len(FAMILIES)
    inside, outside = best(test & family, w, b, set()), []
    for part in range(PARTS):
        left = set(range(part, len(FAMILIES), PARTS))
        strange = np.isin(kinds, list(left))
        w2, b2 = _regress(x[~strange], kinds[~strange], rounds=80)
        outside.append(best(strange, w2, b2, left))
    outside = np.concatenate(outside)
    bounds = [*np.arange(0.5, 0.96, 0.05).round(2).tolist(), 0.97, 0.98, 0.99, 0.995, 0.998]
    sure = max(bounds, key=lambda t: (inside >= t).mean() - (outside >= t).mean())
    kept = np.flatnonzero(np.abs(w).max(1) > 0)
    return LicenceModel({known[i]: w[i].astype(float).tolist() for i in kept}, b.astype(float).tolist(), sorted(cues), own, temperature, sure)


def train(docs: DataFrame, text_col: str = "text", others: int = OTHERS) -> LicenceModel:
    """The model, with at most ``others`` paragraphs of the corpus that speak of no licence as the class "other".

    They are the different first lines of documents with the least hashes, so the fit is the same in every run. An
    estimate of their number gives a hash under which about twice as many lie; only those are sorted, so what reaches
    the driver does not grow with the table.
    """
    plain = docs.select(F.substring_index(F.col(text_col), "\n", 1).alias("line")).filter(~F.col("line").rlike(SPEAKS) & (F.length("line") < 2000))
    plain = plain.withColumn("h", F.xxhash64("line"))
    (n,) = plain.agg(F.approx_count_distinct("h", 0.02)).first()
    bound = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * others // max(1, n))
    sample = plain.filter(F.col("h") <= F.lit(bound)).distinct().orderBy("h", "line").limit(others)
    return fit([r.line for r in sample.collect()])


def _words(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[^a-z0-9]+"), "")


def _literal(value, ddl: str) -> Column:
    """A large constant as one literal: the optimiser folds it."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _either(cues: list[str]) -> str:
    """A pattern of any of the cues, common beginnings written once; between the words of a pair stands anything else."""
    tree: dict = {}
    for cue in cues:
        node = tree
        for letter in cue:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [("" if not k else ("[^a-z0-9]+" if k == " " else k) + pattern(v)) for k, v in sorted(node.items(), reverse=True)]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return pattern(tree)


def cue_pattern(model: LicenceModel) -> str:
    return SPEAKS + (r"|(?<![a-z0-9])" + _either(model.cues) + r"(?![a-z0-9])" if model.cues else "")


def scan(docs: DataFrame, model: LicenceModel, text_col: str = "text", name: str = "licences") -> DataFrame:
    """The rows with an array column ``name`` (longer if taken), one entry for each paragraph about a licence:
    its first line with a cue or a word on licences (from 0), family or "unknown", probability of the best family, share of its template.

    Null or empty text, or no such paragraph: an empty array. Every row is scanned by itself, whole. Empty table: no rows.
    """
    name = fresh(docs, name)
    n = len(FAMILIES)
    table = _literal(model.weights, "map<string,array<double>>")
    known = _literal(sorted(model.weights), "array<string>")
    own = _literal([model.own[f] for f in FAMILIES], "array<array<string>>")
    notices = _literal([notice_templates(f) for f in FAMILIES], "array<array<array<string>>>")
    every = _literal([notice_templates(f) + name_templates(f) for f in FAMILIES], "array<array<array<string>>>")
    family_words = _literal([sorted({w for x in NOTICES[f] for w in words_of(x)}) for f in FAMILIES], "array<array<string>>")
    families, cue = F.array(*map(F.lit, FAMILIES)), cue_pattern(model)
    let = lambda value, f: F.transform(F.array(value), f)[0]

    def all_grams(words: Column) -> Column:
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        return F.array_distinct(F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))))

    def margins(have: Column) -> Column:
        held = F.transform(F.array_intersect(have, known), lambda g: F.element_at(table, g))
        sums = F.aggregate(held, F.array(*map(F.lit, model.bias)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        return F.transform(sums, lambda m: m / model.temperature)

    def found(line: Column, at: Column, templates: Column) -> Column:
        def entry(have: Column, e: Column) -> Column:
            best = F.array_max(F.slice(e, 1, n))
            place = F.array_position(F.slice(e, 1, n), best).cast("int") - 1
            share = F.array_max(F.transform(templates[place], lambda t: F.size(F.array_intersect(t, have)) / F.size(t)))
            p = best / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
            sure = (p >= model.sure) & (share >= SHARED) & F.arrays_overlap(own[place], have)
            return F.struct(at.cast("long").alias("paragraph"), F.when(sure, families[place]).when(line.rlike(SPEAKS), "unknown").alias("family"), p.alias("probability"), share.alias("shared"))

        scored = lambda have: let(margins(have), lambda m: F.transform(m, lambda v: F.exp(v - F.array_max(m))))
        return let(all_grams(_words(line)), lambda have: let(scored(have), lambda e: entry(have, e)))

    text = text_of(text_col)
    own_line = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.regexp_replace(line, SIGNS, "").alias("line"), i.alias("i")))

    def continues(words: Column, first: Column, sure: Column) -> Column:
        """Most words are of the notices of the family that the line before names."""
        terms = lambda e: family_words[F.array_position(families, e["family"]).cast("int") - 1]
        return F.exists(sure, lambda e: (e["paragraph"] == first - 1) & (F.size(F.array_intersect(words, terms(e))) >= SHARED * F.size(F.array_distinct(words))))

    def joined(lines: Column, sure: Column) -> Column:
        held = F.transform(sure, lambda e: e["paragraph"])
        open_line = lambda s: (F.length(s["line"]) > 0) & ~F.array_contains(held, s["i"].cast("long"))
        marked = F.array_join(F.transform(lines, lambda s: F.when(open_line(s), F.concat(s["i"].cast("string"), F.lit("\t"), s["line"])).otherwise("")), "\n")
        plain = lambda run: F.regexp_replace(run, r"(?:^|\n)\d+\t", " ")
        runs = F.filter(F.split(marked, "\n\n+"), lambda run: plain(run).rlike(cue))
        parts = F.transform(runs, lambda run: F.struct(
            plain(run).alias("text"), F.regexp_extract(run, r"(\d+)\t", 1).cast("long").alias("first"),
            F.coalesce(F.nullif(F.regexp_extract(run, rf"(?m)^(\d+)\t[^\n]*?(?:{cue})", 1), F.lit("")), F.regexp_extract(run, r"(\d+)\t", 1)).cast("long").alias("at")))
        found_in = F.transform(parts, lambda s: F.struct(found(s["text"], s["at"], every).alias("e"), s["text"].alias("text"), s["first"].alias("first")))
        kept = F.filter(found_in, lambda s: s["e"]["family"].isNotNull() & ~((s["e"]["family"] == "unknown") & continues(_words(s["text"]), s["first"], sure)))
        return F.transform(kept, lambda s: s["e"])

    def entries_in(lines: Column) -> Column:
        alone = F.transform(F.filter(lines, lambda s: s["line"].rlike(cue)), lambda s: found(s["line"], s["i"], notices))
        named = F.filter(alone, lambda e: e["family"].isNotNull() & (e["family"] != "unknown"))
        return let(named, lambda sure: F.array_sort(F.concat(sure, joined(lines, sure))))

    entries = let(own_line, entries_in)
    kind = "array<struct<paragraph:bigint,family:string,probability:double,shared:double>>"
    return docs.withColumn(name, F.when(text.rlike(cue), entries).otherwise(F.array().cast(kind)))
