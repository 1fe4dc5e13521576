"""Secret scans: fixed patterns, and character Markov models for random strings.

Three patterns find assigned values, access keys and long hexadecimal runs; a
match that is too short is dropped and its text isn't searched again for that
kind. Besides, every token of ``MIN_TOKEN`` or more key characters is scored by
two first-order character models, one of random strings and one of ordinary
tokens, both with add-one-half smoothing and trained from labelled samples. A
token whose log-likelihood ratio reaches the fitted threshold is a span of kind
``markov``, unless a base span overlaps it. The threshold is the least that
``FALSE`` of the ordinary samples that were held out reach; a short token has
too few characters for it unless they are all unlikely.

``labelled_samples`` makes random strings over the alphabets that keys use, and
identifiers joined from plain words in the usual ways. ``fitted`` adds every distinct
token outside base spans of all documents, so that the models know the words of the
corpus: their characters are counted in the tasks, and the threshold is an exact order
statistic of all held-out ones.
Other labelled samples can be passed to ``fit``.

Defined cases: a null or empty text has no spans; overlapping spans of different
kinds are all reported; rows that repeat a doc_id are searched one by one; extra
columns are kept, but for one with the name of the spans, which they replace.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesmill.llm.text import column
from seriesmill.session import stored

#: Kinds, patterns and least lengths of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are whole, so the least length can stand in the pattern
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

MIN_TOKEN, FALSE = 12, 0.001
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")

#: Plain words that sample identifiers are joined from.
PLAIN = (
    "account address array average buffer builder cache callback channel client column config connection content context controller count create current data "
    "database default delete description document element email error event factory field file filter format function group handler header height history image index "
    "input instance item json label language length level list listener loader local location logger manager maximum message method minimum model module name network "
    "number object offset option order output page parameter parser password path payment pattern point policy position prefix process product profile project property "
    "provider query queue reader record reference region register remote request resource response result return schema search section select sender server service session "
    "setting source spring start state status storage stream string style system table target task template text thread time title token total type update upload user "
    "utility validator value vector version view visible widget width window worker writer"
).split()
SAMPLE_SIZE, SAMPLE_SEED = 4000, 7


def labelled_samples(n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> list[tuple[str, bool]]:
    """n random strings (true) and n identifiers (false)."""
    r = random.Random(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = (digits + "abcdef", lower + digits, lower + lower.upper() + digits, lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_")
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(16, 48))), True) for _ in range(n)]
    joins = ("_".join, "-".join, "/".join, "".join, lambda w: w[0] + "".join(map(str.title, w[1:])), lambda w: "_".join(w).upper(), lambda w: "".join(map(str.title, w)))
    for _ in range(n):
        word = r.choice(joins)(r.choices(PLAIN, k=r.randint(2, 6)))
        out.append((word + str(r.randint(0, 9999)) if r.random() < 0.3 else word, False))
    return out


#: Fixed value: the characters of the models; any other counts as the last.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def _codes(text: str) -> np.ndarray:
    """Character codes, after one that marks the start."""
    return np.r_[len(ALPHABET) + 1, _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]]


@dataclass
class Markov:
    """Log-probabilities of a character after the one before it, random over ordinary, and the least ratio of a secret."""

    ratio: np.ndarray
    least: float = 0.0

    @classmethod
    def fit(cls, samples: Iterable[tuple[str, bool]], false: float = FALSE) -> Markov:
        """Every third sample is held out for the threshold."""
        samples = list(samples)
        model = cls.counted(samples)
        held = sorted(model.score(text) for text, random_string in samples[::3] if not random_string)
        if held:
            model.least = max(held[min(len(held) - 1, int(len(held) * (1 - false)))] + 1e-9, 0.0)
        return model

    @classmethod
    def counted(cls, samples: list[tuple[str, bool]], more: np.ndarray | float = 0.0) -> Markov:
        """Without a threshold; ``more`` are counts of further ordinary tokens, a row a character before."""
        size = len(ALPHABET) + 2
        counts = np.full((2, size, size), 0.5)
        counts[0] += more
        for i, (text, random_string) in enumerate(samples):
            if i % 3:
                own = _codes(text)
                np.add.at(counts[int(random_string)], (own[:-1], own[1:]), 1)
        logs = np.log(counts) - np.log(counts.sum(-1, keepdims=True))
        return cls(logs[1] - logs[0])

    def score(self, token: str) -> float:
        """Log-likelihood ratio."""
        own = _codes(token)
        return float(self.ratio[own[:-1], own[1:]].sum())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def free_tokens(text: str, taken: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """Tokens that overlap no base span; ``taken`` is by start."""
    starts, ends = [a for a, _, _ in taken], []
    for _, b, _ in taken:  # the farthest end so far
        ends.append(max(b, ends[-1]) if ends else b)
    for m in TOKEN.finditer(text):
        before = bisect_right(starts, m.end() - 1)
        if not before or ends[before - 1] <= m.start():
            yield m


def markov_spans(text: str, model: Markov, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "markov") for m in free_tokens(text, taken) if model.score(m.group()) >= model.least]


def spans(text: str, model: Markov) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, "markov"))}
    return sorted(base + markov_spans(text, model, base), key=lambda s: (s[0], order[s[2]]))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(sorted({m.group() for t in texts for m in free_tokens(t, base_spans(t))}), pa.string())], names=["token"])


def ordinary_tokens(docs: DataFrame, text: str = "text") -> list[tuple[str, bool]]:
    """The distinct tokens outside base spans of few documents, as ordinary samples for ``Markov.fit``."""
    return [(r.token, False) for r in _distinct(docs, text).orderBy("token").collect()]


def _distinct(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(_tokens, "token string").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(ALPHABET) + 2
    total = np.zeros(size * size, np.int64)
    for batch in batches:
        for token in batch.column(0).to_pylist():
            own = _codes(token)
            np.add.at(total, own[:-1] * size + own[1:], 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def fitted(docs: DataFrame, text: str = "text", false: float = FALSE) -> Markov:
    """The model of the labelled samples and of every distinct free token of ``docs``.

    A token is held out by its hash, one in three. Only the counts of character pairs come to the driver, and of the scores
    of the held-out tokens the counts by whole hundredths, then the scores of the one hundredth that holds the threshold.
    """
    samples, size = labelled_samples(), len(ALPHABET) + 2
    tokens = stored(_distinct(docs, text))
    held = F.pmod(F.xxhash64("token"), F.lit(3)) == 0
    more = np.zeros(size * size)
    for r in tokens.where(~held).mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        more[r.pair] = r.n
    model = Markov.counted(samples, more.reshape(size, size))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.score(t) for t in batch.column(0).to_pylist()], pa.float64())], names=["score"])

    own = [(t,) for i, (t, random_string) in enumerate(samples) if i % 3 == 0 and not random_string]
    spark = docs.sparkSession
    scored = stored(tokens.where(held).unionByName(spark.createDataFrame(own, "token string")).mapInArrow(scores, "score double"))
    part = F.floor(F.col("score") * 100)
    parts = sorted((r.part, r.n) for r in scored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    count = sum(n for _, n in parts)
    place = min(count - 1, int(count * (1 - false)))
    for p, n in parts:
        if place < n:
            values = scored.where(part == p).groupBy("score").agg(F.count("*").alias("n")).orderBy("score").collect()
            at = np.searchsorted(np.cumsum([v.n for v in values]), place, "right")
            model.least = max(values[at].score + 1e-9, 0.0)
            break
        place -= n
    return model


def with_spans(docs: DataFrame, text: str = "text", model: Markov | None = None, out: str = "secrets") -> DataFrame:
    """``docs`` with the column ``out`` at the end: its spans (kind, start, stop) in code points, by start."""
    sent = docs.sparkSession.sparkContext.broadcast(model or Markov.fit(labelled_samples()))
    given = docs.select(F.col(text).alias("__text"), *[c for c in docs.columns if c.lower() != out.lower()])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    shape = T.StructType([*given.schema.fields[1:], T.StructField(out, T.ArrayType(span))])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b} for a, b, k in spans(t.as_py() or "", sent.value)] for t in batch.column(0)]
            own = [c.cast(f.type) for c, f in zip(batch.columns[1:], schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, schema.field(out).type)], schema=schema)

    return given.mapInArrow(run, shape)
