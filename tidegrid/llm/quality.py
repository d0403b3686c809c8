"""Quality classifier: a factorisation machine over hashed words, structure of the text and its metadata.

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

The sum-of-squares identity scores all pairwise interactions in time linear in the features of a text. The model is
fitted on at most ``SAMPLE`` labelled texts (documented bound, chosen by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import fresh, sliced

#: Labelled texts that the fit takes at most.
SAMPLE = 8192
BUCKETS, RANK, EPOCHS, BATCH = 1 << 14, 8, 12, 64
THRESHOLD = 0.7
SEED = 11

#: Bins of each structure statistic; the last holds what is above.
STATS = ["words", "unique", "word_length", "symbols", "punctuation", "upper", "digits", "dup_lines", "top_word", "runs", "bangs", "line_words", "metadata"]
BINS = 12


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return value


_buckets = WordBuckets()
_SYMBOLS = str.maketrans("", "", "#*$%&|<>{}=_~^\\")
_PUNCTUATION = str.maketrans("", "", ".,;:!?'\"()-")
_DIGITS = str.maketrans("", "", "0123456789")


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Statistics in 0..1, in the order of STATS."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        min(1.0, np.log2(n) / 16), len(counts) / n, min(1.0, size / n / 16), (size - len(text.translate(_SYMBOLS))) / size * 4,
        (size - len(text.translate(_PUNCTUATION))) / size * 4, sum(map(str.isupper, words)) / n, (size - len(text.translate(_DIGITS))) / size * 2,
        1 - len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / n, same / n, text.count("!") / n, min(1.0, n / max(1, len(lines)) / 64),
        min(1.0, np.log2(max(1, n_chars if n_chars is not None else 1)) / 20),
    ]


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): hashed words with unit length, one-hot bins and values of the statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    index = np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    index, back = np.unique(index, return_inverse=True)
    weight = np.bincount(back, weight, len(index)) if len(index) else weight
    weight /= max(1e-9, np.sqrt((weight**2).sum()))
    stats = np.clip(structure(text, words, counts, n_chars), 0, 1)
    at = BUCKETS + np.arange(len(STATS)) * (BINS + 1)
    bins = at + 1 + np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
    return np.concatenate([index, at, bins]), np.concatenate([weight, stats, np.ones(len(STATS))])


SIZE = BUCKETS + len(STATS) * (BINS + 1)


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def new(cls) -> FactorMachine:
        return cls(0.0, np.zeros(SIZE, np.float32), np.random.default_rng(SEED).normal(0, 0.02, (SIZE, RANK)).astype(np.float32))

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index]
        return float(self.bias + x @ self.linear[index] + 0.5 * (((x @ v) ** 2).sum() - ((x**2) @ (v**2)).sum()))

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rate: float = 0.1, decay: float = 1e-5) -> FactorMachine:
    """Logistic loss by AdaGrad over shuffled batches; no rows: a machine that scores 0.5."""
    model, rng = FactorMachine.new(), np.random.default_rng(SEED)
    if not rows:
        model.factors[:] = 0
        return model
    share = np.clip(np.mean(labels), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            gw, gv, gb = [], [], 0.0
            for k in some:
                index, x = rows[k]
                v = model.factors[index]
                total = x @ v
                margin = model.bias + x @ model.linear[index] + 0.5 * ((total**2).sum() - ((x**2) @ (v**2)).sum())
                g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[k]
                gb += g
                gw.append(g * x)
                gv.append(g * (x[:, None] * total - (x**2)[:, None] * v))
            index, back = np.unique(np.concatenate([rows[k][0] for k in some]), return_inverse=True)
            dw = np.bincount(back, np.concatenate(gw), len(index)) / len(some) + decay * model.linear[index]
            dv = np.zeros((len(index), RANK))
            np.add.at(dv, back, np.concatenate(gv))
            dv = dv / len(some) + decay * model.factors[index]
            seen_w[index] += dw**2
            seen_v[index] += dv**2
            seen_b += (gb / len(some)) ** 2
            model.linear[index] -= (rate * dw / np.sqrt(seen_w[index])).astype(np.float32)
            model.factors[index] -= (rate / 2 * dv / np.sqrt(seen_v[index])).astype(np.float32)
            model.bias -= rate * gb / len(some) / seen_b**0.5
    return model


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no fit sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, target: str = "quality") -> FactorMachine:
    """Fit on at most ``sample`` labelled documents outside the held-out part.

    A document that several rows label has the least label. Null labels, ids without a text row: left out.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(target).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    has_size = "n_chars" in docs.columns
    source = docs.select("doc_id", "text", (F.col("n_chars").cast("long") if has_size else F.lit(None).cast("long")).alias("n_chars"))
    picked = source.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in found]), pa.array([x.astype("<f4").tobytes() for _, x in found])],
                names=["doc_id", "label", "i", "x"],
            )

    rows = sorted(picked.mapInArrow(run, "doc_id long, label int, i binary, x binary").collect(), key=lambda r: (r.doc_id, r.label, r.i, r.x))
    return fit([(np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(np.float64)) for r in rows], [int(r.label > 0) for r in rows])


def score(docs: DataFrame, model: FactorMachine, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a double column ``name`` (longer if taken), 0 to 1. Only the text and n_chars are read for it.

    Null text: as an empty one, which has a score too. Empty table: no rows.
    """
    name = fresh(docs, name)
    place = docs.columns.index(text_col)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes = [None] * batch.num_rows if size is None else batch.column(size).to_pylist()
            scores = [model.score(*features(t, n)) for t, n in zip(batch.column(place).to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep(docs: DataFrame, model: FactorMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns as they were."""
    name = fresh(docs, "score")
    return score(docs, model, name=name).filter(F.col(name) >= threshold).drop(name)
