"""Toxicity by class-conditional Kneser-Ney bigram models.

Two Kneser-Ney models, toxic and ordinary, are counted from labelled texts; a
text counts each distinct pair of consecutive words once, so that its own
repetitions aren't taken for its class. A class's continuation count of a word is
the number of distinct words it follows there. Discounted continuation counts
back off to ``SHARED`` counts that every word has in both classes together, parted
by the classes' sizes; discounted pair counts back off to as many, parted as the
word's probabilities part it. So an expression that is rare in both classes says
little, and no count is cut. A word's evidence is the log of its toxic over its
ordinary probability, given the word before it; a pair that was never seen has
its word's evidence.

A text has two length-normalised features: the mean evidence of its words, and
the mean of its ``PEAK`` words with the most evidence, clipped at ``CLIP``; the
second keeps long texts from hiding a few toxic words. A logistic curve on both
gives the score. It is fitted on all labelled texts, each with the counts of the
``FOLDS`` - 1 other folds; the model then counts all of them.

Fitting takes at most ``PER_CLASS`` labelled texts of each class, those with the
smallest hash of their doc_id; their pairs are made and counted on executors, in
``FOLDS`` folds, and the driver gets the counts. All texts are scored whole.

Defined cases: a null, empty or wordless text gets the score of no evidence; a
doc_id with labels of both kinds counts as toxic; null labels are left out; with
one class or none the score is 0 for every text; rows that repeat a doc_id are
scored one by one, and count for the fit as one row, that with the largest text;
extra columns are kept, but for one with the name of the score, which it
replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesmill.llm.text import NOT_ALPHANUMERIC, blocks, column, mix, release, words
from seriesmill.session import checkpointed

PER_CLASS = 2000
DISCOUNT, SHARED, CLIP, PEAK = 0.75, 2.0, 6.0, 2
FOLDS = 3
THRESHOLD = 0.7
START = np.uint64(0x5EED)


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), missing)
    place = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[place] == x, values[place], missing)


def _pairs(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word before each word; the start mark at the first of a text."""
    before = np.r_[START, value[:-1]] if len(value) else value
    before[np.r_[True, row[1:] != row[:-1]] if len(row) else []] = START
    return before


@dataclass
class KneserNey:
    """Evidence of known pairs, and of words as their backoff."""

    pair: np.ndarray
    pair_evidence: np.ndarray
    word: np.ndarray
    word_evidence: np.ndarray

    @classmethod
    def fit(cls, value: np.ndarray, before: np.ndarray, counts: np.ndarray) -> KneserNey:
        """Of distinct pairs: the word, the word before it, and the texts of each class (ordinary, toxic) that have the pair."""
        pair = mix(mix(before) + value)
        order = np.argsort(pair)
        pair, value, before, counts = pair[order], value[order], before[order], counts[order].astype(float)
        word, of_word = np.unique(value, return_inverse=True)
        ordinary, toxic = (np.bincount(of_word, counts[:, c] > 0, len(word)) for c in (0, 1))
        size = (toxic.sum() + 0.5) / (toxic.sum() + ordinary.sum() + 1)
        evidence = _backed_off(toxic, ordinary, size)
        head, of_head = np.unique(before, return_inverse=True)
        after = [np.bincount(of_head, counts[:, c], len(head)) for c in (0, 1)]
        part = ((after[1] + SHARED * size) / (after[0] + after[1] + SHARED))[of_head]
        likely = 1 / (1 + np.exp(-(_odds(part) + evidence[of_word])))
        return cls(pair, _backed_off(counts[:, 1], counts[:, 0], likely) + _odds(likely) - _odds(part), word, evidence)

    def evidence(self, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log of toxic over ordinary probability of each word."""
        direct = _lookup(self.pair, self.pair_evidence, mix(mix(before) + value), np.nan)
        return np.clip(np.where(np.isnan(direct), _lookup(self.word, self.word_evidence, value, 0.0), direct), -CLIP, CLIP)


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log(1 - p)


def _backed_off(toxic: np.ndarray, ordinary: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log ratio of discounted counts, with the shared counts parted by ``share``, over the odds of ``share``."""
    own = [np.maximum(c - DISCOUNT, 0) + SHARED * p for c, p in ((toxic, share), (ordinary, 1 - share))]
    return np.log(own[0]) - np.log(own[1]) - _odds(share)


def features(evidence: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row: mean evidence, and the mean of its PEAK largest."""
    out = np.zeros((rows, 2))
    n = np.bincount(row, minlength=rows)
    out[:, 0] = np.bincount(row, evidence, rows) / np.maximum(n, 1)
    order = np.lexsort((-evidence, row))
    first = np.r_[0, np.cumsum(n)[:-1]]
    rank = np.arange(len(order)) - first[row[order]]
    top = order[rank < PEAK]
    out[:, 1] = np.bincount(row[top], evidence[top], rows) / PEAK
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic curve; the classes weigh as they are."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    tables: KneserNey | None
    weights: np.ndarray

    def score(self, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if self.tables is None:
            return np.zeros(rows)
        x = features(self.tables.evidence(value, _pairs(value, row)), row, rows)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _classes(both: np.ndarray) -> np.ndarray:
    """Texts of the ordinary and of the toxic class."""
    return np.stack([both & 0xFFFF, both >> 16], axis=1)


def _labelled_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to their distinct pairs: word, word before it, fold and class."""
    for batch in batches:
        y, fold = (np.asarray(column(batch, c)).astype(np.int32) for c in ("y", "fold"))
        for block in blocks(column(batch, "text")):
            w = words(block, NOT_ALPHANUMERIC)
            before, row = _pairs(w.hash, w.row), w.row + block.first
            one = np.unique(mix(mix(before) + w.hash) ^ mix(row.astype(np.uint64)), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.hash[one].view(np.int64), before[one].view(np.int64), fold[row[one]], y[row[one]])], names=["value", "before", "fold", "y"])


def _features_of(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                w = words(block, NOT_ALPHANUMERIC)
                x = features(sent.value.evidence(w.hash, _pairs(w.hash, w.row)), w.row, block.rows)
                yield pa.RecordBatch.from_arrays([column(batch, c).slice(block.first, block.rows) for c in ("h", "y")] + [pa.array(c) for c in x.T], names=["h", "y", "mean", "peak"])
        release()

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled texts; ``labels`` has the key and a 0/1 label."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("y")).withColumn("h", F.xxhash64(key))
    ids = one.where("y = 1").orderBy("h").limit(per_class).unionByName(one.where("y = 0").orderBy("h").limit(per_class))  # 2 * per_class rows at most
    share = one.agg(F.avg("y")).first()[0] or 0.0
    fold = F.pmod(F.col("h"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(ids), key).groupBy(key, "h").agg(F.max("y").alias("y"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = checkpointed(rows.select("h", "y", fold, "text"))
    both = F.col("y") * 65536 + 1 - F.col("y")  # texts of both classes in one number: per_class is below 65536
    parts = [F.sum(F.when(F.col("fold") == k, both).otherwise(0)).cast("int").alias(f"n{k}") for k in range(FOLDS)]
    pairs = rows.mapInArrow(_labelled_pairs, "value long, before long, fold int, y int").groupBy("value", "before")
    table = pairs.agg(*parts).toArrow()
    if not table.num_rows or rows.agg(F.count_distinct("y")).first()[0] < 2:
        return Model(None, np.zeros(3))
    value, before = (table.column(c).to_numpy().view(np.uint64) for c in ("value", "before"))
    counts = [table.column(f"n{k}").to_numpy() for k in range(FOLDS)]
    every, made = sum(counts), []
    for k in range(FOLDS):  # one model at a time
        others = every - counts[k]
        seen = others > 0
        sent = docs.sparkSession.sparkContext.broadcast(KneserNey.fit(value[seen], before[seen], _classes(others[seen])))
        made.append(rows.where(F.col("fold") == k).mapInArrow(_features_of(sent), "h long, y int, mean double, peak double").toArrow())
        sent.destroy()
        release()
    made = pa.concat_tables(made).sort_by("h")
    y = made.column("y").to_numpy().astype(float)
    w = logistic(np.c_[made.column("mean").to_numpy(), made.column("peak").to_numpy()], y)
    if 0 < share < 1:  # from the sample's share of toxic texts to that of all labels
        w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    tables = KneserNey.fit(value, before, _classes(every))
    del table, value, before, counts, every
    release()
    return Model(tables, w)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each text, 0 to 1, as the last column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample
    others = [c for c in docs.columns if c.lower() != out.lower()]
    given = docs.select(F.col(text).alias("__text"), *others)
    shape = T.StructType([*given.schema.fields[1:], T.StructField(out, T.DoubleType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [np.zeros(0)]
            for block in blocks(batch.column(0)):
                w = words(block, NOT_ALPHANUMERIC)
                score.append(sent.value.score(w.hash, w.row, block.rows))
            own = [c.cast(f.type) for c, f in zip(batch.columns[1:], schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(score))], schema=schema)

    return given.mapInArrow(run, shape)
