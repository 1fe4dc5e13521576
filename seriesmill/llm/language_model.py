"""LM scoring with a log-bilinear model, trained by noise-contrastive estimation.

Counts. Every word of every training text is counted, by hash, over the whole
corpus. The most frequent ``SHORT`` of them, at most, are broadcast; the other
words of a text are joined with the count table.

Model. The context of a word gives a vector: the embeddings of the ``NEAR``
words before it and the mean embedding of the ``FAR`` words before it, each
scaled by a vector of its place, summed. The named words are the most frequent
ones with ``LEAST`` occurrences or more, up to ``NAMED`` times the root of the
number of distinct words, so they grow with the corpus. They are parted by
frequency into about as many classes as a class of equal mass has words. The
first class is the end, the last one all words without a name. A word has its
class's probability times its probability in the class, both softmaxes over
products of the context vector with an output vector, plus a bias. A word
without a name has the last class's probability times its share (c + 1) / rest,
where one share is kept for a word that was never seen. So all probabilities
add up to 1, and a block takes two matrix products a word.

Training. Texts are dealt by a hash of their words to ``ROUNDS`` rounds and, in
each, to shards of about ``SHARD`` tokens, and sorted by that hash. In a round
each shard starts from the same parameters and runs one pass of noise-contrastive
estimation (AdaGrad by row; noise from the class counts, and within a class from
its words' counts) over its texts; the round ends with the average over its
shards, a row of parameters weighted by the times it was moved. So every training
text is used once, and the model depends on the texts alone, not on partitions
or tasks.

Defined cases: a null text is empty and has the end alone; rows that repeat a
doc_id are scored one by one; with no training text all words are unknown and
the model is the uniform start; ``keep`` names the columns that are returned,
others are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesmill.llm.text import SPACE, Block, blocks, column, mix, release, words
from seriesmill.session import checkpointed

SHORT, LEAST, NAMED = 1 << 18, 24, 12
DIM, NEAR, FAR = 16, 2, 32
ROUNDS, SHARD = 4, 2_000_000
STEP, NOISE, INNER, RATE = 2048, 24, 1, 0.15
END = np.uint64(0xE0D)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token of a block: the words of each row, then an end."""
    w = words(block, SPACE)
    at = w.first[1:] + np.arange(block.rows)
    value = np.empty(len(w.hash) + block.rows, np.uint64)
    own = np.ones(len(value), bool)
    own[at] = False
    value[own], value[at] = w.hash, END
    row = np.repeat(np.arange(block.rows), np.diff(w.first) + 1)
    return value, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes with their counts; a partition's are merged as they come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[head], np.add.reduceat(n, head)

    def out() -> pa.RecordBatch:
        keys, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "n"])

    for batch in batches:
        for block in blocks(column(batch, "text")):
            keys, n = np.unique(tokens(block)[0], return_counts=True)
            held.append((keys, n.astype(np.int64)))
            size += len(keys)
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """hash, n of every distinct token of the texts."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens, by hash, with their counts and ids: 0 the end, from 1 on the named words by frequency, then the rest."""

    hash: np.ndarray  # sorted
    count: np.ndarray
    id: np.ndarray
    total: int  # N
    distinct: int  # V
    first: np.ndarray  # first named id of each class; the end is class 0, the rest the last
    mass: np.ndarray  # share of each class
    inner: np.ndarray  # share of each id in its class

    @classmethod
    def of(cls, key: np.ndarray, n: np.ndarray, total: int, distinct: int, least: int = LEAST, named: int = NAMED) -> Vocabulary:
        """Hashes and counts, most frequent first."""
        most = math.ceil(named * math.sqrt(distinct))
        chosen = np.flatnonzero((key != END) & (n >= least))[:most]
        ids = np.full(len(key), len(chosen) + 1, np.int32)
        ids[chosen] = np.arange(1, len(chosen) + 1)
        ids[key == END] = 0
        own = n[chosen].astype(float)
        classes = min(len(chosen), math.isqrt(len(chosen)) + 1)
        number = np.minimum((np.cumsum(own) - own / 2) / max(own.sum(), 1) * classes, classes - 1).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(own) else np.zeros(0, np.int64)
        first = np.r_[0, heads + 1, len(chosen) + 1].astype(np.int64)
        by_id = np.r_[n[key == END].sum(), own, max(total - n[key == END].sum() - own.sum(), 0)] + 1.0
        mass = np.add.reduceat(by_id, first)
        inner = by_id / np.repeat(mass, np.diff(np.r_[first, len(by_id)]))
        order = np.argsort(key)
        return cls(key[order], n[order], ids[order], total, distinct, first, mass / mass.sum(), inner)

    @property
    def size(self) -> int:
        """The number of ids."""
        return len(self.inner)

    @property
    def of_id(self) -> np.ndarray:
        """The class of each id."""
        return np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, self.size]))

    @property
    def rest(self) -> float:
        """Sum of c + 1 over the words without a name, and one for the unseen."""
        own = self.id != self.size - 1
        end = 0 if (self.hash == END).any() else 1
        return max(float(self.total + self.distinct + 1 - (self.count[own] + 1).sum() - end), 1.0)

    def look(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count (0 where it isn't here), id, and whether it is here, of each token."""
        if not len(self.hash):
            return np.zeros(len(value), np.int64), np.where(value == END, 0, self.size - 1).astype(np.int32), np.zeros(len(value), bool)
        place = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        known = self.hash[place] == value
        ids = np.where(known, self.id[place], np.where(value == END, 0, self.size - 1)).astype(np.int32)
        return np.where(known, self.count[place], 0), ids, known


def ages(lengths: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class LogBilinear:
    """Input vectors; output vectors and biases of classes and of words; the scales of the context places. One more input stands before a text."""

    def __init__(self, vocabulary: Vocabulary, parts: list[np.ndarray] | None = None, seed: int = 11):
        self.first, self.of_id, self.mass, self.inner = vocabulary.first, vocabulary.of_id, vocabulary.mass, vocabulary.inner
        self.sizes = np.diff(np.r_[self.first, len(self.inner)])
        if parts is None:
            r = np.random.default_rng(seed)
            draw = lambda rows: np.c_[r.normal(0, 0.1, (rows, DIM)), np.zeros((rows, 2))].astype(np.float32)
            parts = [draw(len(self.inner) + 1), draw(len(self.mass)), draw(len(self.inner)), np.c_[np.ones((NEAR + 1, DIM)), np.zeros((NEAR + 1, 2))].astype(np.float32)]
            parts[1][:, DIM], parts[2][:, DIM] = np.log(self.mass), np.log(self.inner)
        #: Rows of DIM numbers, a bias, and the mean square of the row's gradients so far.
        self.parts = parts
        self.moved = [np.zeros(len(p), np.int64) for p in parts]

    def context(self, ids: np.ndarray, age: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Input ids of the words before each token (the pad at a text's start), the mean of the far ones, and the context vectors."""
        n, inputs, scale = len(ids), self.parts[0][:, :DIM], self.parts[3][:, :DIM]
        pad, by_number = len(inputs) - 1, np.ascontiguousarray(inputs.T)
        before = np.full((NEAR, n), pad, np.int32)
        for k in range(1, NEAR + 1):
            before[k - 1, k:] = np.where(age[k:] >= k, ids[: n - k], pad)
        mean, vector = np.empty((n, DIM), np.float32), np.empty((n, DIM), np.float32)
        for a in range(0, n, 1 << 13):  # parts that fit the cache, from the first word that they look back to
            b, low = min(n, a + (1 << 13)), max(0, a - FAR)
            sums = np.zeros((DIM, b - low + 1), np.float64)  # by number, so that each is summed along memory
            np.cumsum(by_number[:, ids[low:b]], axis=1, dtype=np.float64, out=sums[:, 1:])
            size, at = np.minimum(age[a:b], FAR), np.arange(a - low, b - low)
            mean[a:b] = ((sums[:, at] - sums[:, at - size]) / np.maximum(size, 1)).T
            np.multiply(mean[a:b], scale[NEAR], out=vector[a:b])
            for k in range(NEAR):
                vector[a:b] += inputs[before[k, a:b]] * scale[k]
        return list(before), mean, vector

    def log_probability(self, ids: np.ndarray, age: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
        """Natural log of each id's probability given its context; the rest is one id."""
        full = np.ones((len(ids), DIM + 1), np.float32)  # the context vector, and 1 for the bias
        full[:, :DIM] = self.context(ids, age)[2]
        longest = float(np.sqrt(np.einsum("ij,ij->i", full, full).max(initial=0)))
        own, out = self.of_id[ids], np.empty(len(ids), np.float64)

        def softmax(outputs: np.ndarray, at: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            weights, one = np.ascontiguousarray(outputs[:, : DIM + 1].T), np.ones(len(outputs), np.float32)
            large = longest * float(np.sqrt((weights * weights).sum(axis=0).max())) > 60  # else no exponential runs over
            step = max(1, cells // len(outputs))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                score = full[part] @ weights
                if large:
                    score -= score.max(axis=1, keepdims=True)
                hit = score[np.arange(len(part)), target[a : a + step]]
                yield part, hit - np.log(np.exp(score, out=score) @ one)

        for part, value in softmax(self.parts[1], np.arange(len(ids)), own):
            out[part] = value
        order = np.argsort(own.astype(np.uint16) if len(self.first) < 1 << 16 else own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(len(self.first) + 1))
        for c in np.flatnonzero((np.diff(cut) > 0) & (self.sizes > 1)).tolist():
            at, low = order[cut[c] : cut[c + 1]], self.first[c]
            for part, value in softmax(self.parts[2][low : low + self.sizes[c]], at, ids[at] - low):
                out[part] += value
        return out

    def train(self, ids: np.ndarray, age: np.ndarray, r: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation, ``STEP`` tokens a step; far means are taken at the start of the block."""
        before, mean, _ = self.context(ids, age)
        log_class = np.log(NOISE * self.mass).astype(np.float32)
        log_inner = np.log(INNER * self.inner).astype(np.float32)
        slots = 256  # words of a class as noise, by their counts
        at = (np.arange(slots) + r.random()) / slots
        ends = np.cumsum(self.inner) - np.repeat(np.r_[0, np.cumsum(self.inner)][self.first], self.sizes) + self.of_id
        drawn_of = np.minimum(np.searchsorted(ends, (np.arange(len(self.first))[:, None] + at).ravel()), len(ends) - 1).reshape(-1, slots)
        inputs, classes, outputs, scale = self.parts
        for a in range(0, len(ids), STEP):
            part = slice(a, a + STEP)
            w, far = ids[part], mean[part]
            own = self.of_id[w]
            vectors = [inputs[b[part], :DIM] for b in before]
            full = np.ones((len(w), DIM + 1), np.float32)  # the context vector, and 1 for the bias
            np.multiply(far, scale[NEAR, :DIM], out=full[:, :DIM])
            for k in range(NEAR):
                full[:, :DIM] += vectors[k] * scale[k, :DIM]
            drawn = r.choice(len(self.mass), NOISE, p=self.mass)
            out = classes[own, : DIM + 1]
            error = (1 - _logistic(np.einsum("ij,ij->i", full, out) - log_class[own]))[:, None]
            false = -_logistic(full @ classes[drawn, : DIM + 1].T - log_class[drawn])
            grad = error * out[:, :DIM]
            grad += false @ classes[drawn, :DIM]
            moves = [(1, np.r_[own, drawn], np.concatenate([error * full, false.T @ full]))]
            many = np.flatnonzero(self.sizes[own] > 1)
            if len(many):
                target, inside = w[many], full[many]
                noise = drawn_of[own[many], r.integers(0, slots, (INNER, len(many)))]
                of_word, of_noise = outputs[target, : DIM + 1], outputs[noise, : DIM + 1]
                error = (1 - _logistic(np.einsum("ij,ij->i", inside, of_word) - log_inner[target]))[:, None]
                false = -_logistic(np.einsum("ij,kij->ki", inside, of_noise) - log_inner[noise])[:, :, None]
                grad[many] += error * of_word[:, :DIM] + (false * of_noise[:, :, :DIM]).sum(0)
                moves.append((2, np.r_[target, noise.ravel()], np.concatenate([error * inside, (false * inside).reshape(-1, DIM + 1)])))
            near = np.zeros((NEAR, len(w), DIM + 1), np.float32)
            for k in range(NEAR):
                np.multiply(grad, scale[k, :DIM], out=near[k, :, :DIM])
            moves.append((0, np.concatenate([b[part] for b in before]), near.reshape(-1, DIM + 1)))
            places = [(grad * x).sum(0) for x in (*vectors, far)]
            moves.append((3, np.arange(NEAR + 1), np.c_[np.array(places), np.zeros(NEAR + 1)].astype(np.float32) / len(w)))
            for which, rows, grads in moves:
                self._step(which, rows, grads)

    def _step(self, which: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """Adds the gradients of equal rows and moves each row by AdaGrad with one rate a row."""
        table = self.parts[which]
        order = np.argsort(rows.astype(np.uint16) if len(table) < 1 << 16 else rows, kind="stable")
        rows = rows[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rows, grad = rows[head], np.add.reduceat(grads[order], head, axis=0)
        held = table[rows]
        held[:, DIM + 1] += (grad * grad).mean(1)
        held[:, : DIM + 1] += RATE * grad / np.sqrt(held[:, DIM + 1 :] + np.float32(1e-2))
        table[rows] = held
        self.moved[which][rows] += 1


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Parameters travel in blocks of so many rows.
PIECE = 512
MADE = "part int, piece int, x binary, moved binary"
#: kind 0: a row of its own (row, keep, sums); 1: a word that isn't broadcast (row, hash, times); 2: texts of a part of the training, or of none (-1).
SHAPE = [("kind", T.IntegerType()), ("row", T.LongType()), ("hash", T.LongType()), ("times", T.IntegerType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()),
         ("base", T.DoubleType()), ("named", T.DoubleType()), ("part", T.IntegerType()), ("rows", T.BinaryType()), ("keys", T.BinaryType()), ("lengths", T.BinaryType()), ("ids", T.BinaryType())]


def _reader(vocabulary, parts: int, schema: pa.Schema):
    """Rows of texts to their base sums, their unknown words, and their ids packed by part of the training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        whole, rest = np.log10(v.total + v.distinct + 1), np.log10(v.rest)

        def made(n: int, **own) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own and not isinstance(own[f.name], pa.Array) else own.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        for batch in batches:
            every = np.asarray(column(batch, "row"))
            use = np.asarray(column(batch, "training").fill_null(False))
            for block in blocks(column(batch, "text")):
                value, row = tokens(block)
                known_of, which = np.unique(value, return_inverse=True)
                count, ids, here = v.look(known_of)
                log_count = np.log10(count + 1)
                base = np.where(here, log_count - whole, 0)[which]
                named = np.where(here & (ids == v.size - 1), log_count - rest, 0)[which]
                own = slice(block.first, block.first + block.rows)
                lengths = np.bincount(row, minlength=block.rows)
                sums = [np.bincount(row, x, block.rows) for x in (here[which] & (count[which] > 0), base, named)]
                rows = every[own]
                yield made(block.rows, kind=np.zeros(block.rows, np.int32), row=rows, n_tokens=lengths, n_known=sums[0].astype(np.int64), base=sums[1], named=sums[2], keep=column(batch, "keep").slice(block.first, block.rows).cast(schema.field("keep").type))
                far = np.flatnonzero(~here[which])
                cell = row[far] * len(known_of) + which[far]
                cell, times = np.unique(cell, return_counts=True)
                if len(cell):
                    yield made(len(cell), kind=np.ones(len(cell), np.int32), row=rows[cell // len(known_of)], hash=known_of[cell % len(known_of)].view(np.int64), times=times.astype(np.int32))
                first = np.cumsum(lengths) - lengths
                key = mix(np.add.reduceat(mix(value + ages(lengths).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)) if block.rows else np.zeros(0, np.uint64)
                part = np.where(use[own], (key % np.uint64(parts)).astype(np.int32), -1)
                order = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
                token, packed = ids[which], []
                for a, b in zip(cut, np.r_[cut, block.rows][1:], strict=True):
                    at = order[a:b]
                    places = np.repeat(first[at] - np.r_[0, np.cumsum(lengths[at])[:-1]], lengths[at]) + np.arange(lengths[at].sum())
                    packed.append((2, int(part[at[0]]), rows[at].tobytes(), key[at].tobytes(), lengths[at].astype(np.int64).tobytes(), token[places].astype(_kind(v)).tobytes()))
                yield made(len(packed), **dict(zip(("kind", "part", "rows", "keys", "lengths", "ids"), (list(x) for x in zip(*packed, strict=True)), strict=True)))
        release()

    return run


def _kind(v: Vocabulary) -> type:
    return np.uint16 if v.size < 1 << 16 else np.uint32


def _joined(batch, names: tuple[str, ...], v: Vocabulary) -> list[np.ndarray]:
    kinds = {"rows": np.int64, "keys": np.uint64, "lengths": np.int64, "ids": _kind(v)}
    return [np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(n)).to_pylist()), kinds[n]) for n in names]


def _trainer(vocabulary, start):
    def run(table: pa.Table) -> pa.Table:
        """One shard: its parameters after a pass, and how often each row moved."""
        part = table.column("part")[0].as_py()
        keys, lengths, ids = _joined(table, ("keys", "lengths", "ids"), vocabulary.value)
        model = LogBilinear(vocabulary.value, [p.copy() for p in start.value])
        order, first, r = np.argsort(keys, kind="stable"), np.cumsum(lengths) - lengths, np.random.default_rng(part)
        ends = np.cumsum(lengths[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
            own = order[at:to]
            places = np.repeat(first[own] - np.r_[0, np.cumsum(lengths[own])[:-1]], lengths[own]) + np.arange(lengths[own].sum())
            model.train(ids[places].astype(np.int32), ages(lengths[own]), r)
            at = to
        rows, moved = np.concatenate(model.parts), np.concatenate(model.moved)
        pieces = range(0, len(rows), PIECE)
        release()
        return pa.table([pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array([rows[a : a + PIECE].tobytes() for a in pieces]), pa.array([moved[a : a + PIECE].tobytes() for a in pieces])], names=["part", "piece", "x", "moved"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums of one piece, in the shards' order: each row times how often it moved, and that number."""
    table = table.sort_by("part")
    total, moved = 0.0, 0
    for x, m in zip(table.column("x").to_pylist(), table.column("moved").to_pylist(), strict=True):
        n = np.frombuffer(m, np.int64)
        kind = np.float32 if len(x) == 4 * len(n) * (DIM + 2) else np.float64
        rows = np.frombuffer(x, kind).reshape(len(n), -1).astype(np.float64)
        total = total + (rows * n[:, None] if kind == np.float32 else rows)
        moved = moved + n
    return pa.table([table.column("part")[:1], table.column("piece")[:1], pa.array([total.tobytes()]), pa.array([moved.tobytes()])], names=["part", "piece", "x", "moved"])


def train(read: DataFrame, vocabulary: Vocabulary, sent, shards: int) -> LogBilinear:
    """The model after all rounds; ``read`` has the packed texts. A group adds up at most 256 pieces, or the sums of such."""
    spark, model = read.sparkSession, LogBilinear(vocabulary)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.parts)
        own = read.where(f"kind = 2 and part >= 0 and part % {ROUNDS} = {turn}").select("part", "keys", "lengths", "ids")
        made = own.groupBy("part").applyInArrow(_trainer(sent, start), MADE)
        if shards > 256:
            made = made.withColumn("lot", F.floor(F.col("part") / (256 * ROUNDS))).groupBy("piece", "lot").applyInArrow(lambda t: _added(t.drop_columns(["lot"])), MADE)
        sums = made.groupBy("piece").applyInArrow(_added, MADE).orderBy("piece").select("x", "moved").collect()  # as many as the model has numbers
        start.unpersist()
        if sums:
            moved = np.concatenate([np.frombuffer(x["moved"], np.int64) for x in sums])
            rows = np.concatenate([np.frombuffer(x["x"], np.float64) for x in sums]).reshape(len(moved), -1)
            old = np.concatenate(model.parts)
            new = np.where(moved[:, None] > 0, rows / np.maximum(moved, 1)[:, None], old).astype(np.float32)
            model = LogBilinear(vocabulary, np.split(new, np.cumsum([len(p) for p in model.parts])[:-1]))
    return model


def _frequent(counts: DataFrame, most: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most about ``most`` of them, most frequent first.

    The least count comes from the number of words of each count, a table that is small, so no task gathers
    the words; of the words of that count, those with the smaller hashes fill what is left.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, share, held = 1 << 62, 0.0, 0
    for row in sizes:
        if held + row["words"] > most:
            least, share = row["n"], (most - held) / row["words"]
            break
        held += row["words"]
    else:
        least = 0
    chosen = (F.col("n") > least) | ((F.col("n") == least) & (F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < int(share * (1 << 20))))
    top = counts.where(chosen).toArrow()
    key, n = (top.column(c).to_numpy().astype(np.int64) for c in ("hash", "n"))
    order = np.lexsort((key, -n))
    return key[order].view(np.uint64), n[order]


def _scorer(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = LogBilinear(vocabulary.value, model.value)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(column(batch, "ids")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 18), "right")))
                rows, lengths, ids = _joined(batch.slice(at, to - at), ("rows", "lengths", "ids"), vocabulary.value)
                value = lm.log_probability(ids.astype(np.int32), ages(lengths)) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(np.repeat(np.arange(len(rows)), lengths), value, len(rows)))], names=["row", "model"])
                at = to
        release()

    return run


def scores(docs: DataFrame, training: Column, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of each row; ``training`` marks the rows to learn from."""
    spark = docs.sparkSession
    counts = checkpointed(word_counts(docs.where(training), text))
    total, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    vocabulary = Vocabulary.of(*_frequent(counts), total, distinct)
    sent = spark.sparkContext.broadcast(vocabulary)
    shards = max(1, round(total / ROUNDS / SHARD))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), training.alias("training"), F.struct(*[F.col(c) for c in keep]).alias("keep"))
    shape = T.StructType([*[T.StructField(n, k) for n, k in SHAPE], T.StructField("keep", given.schema["keep"].dataType)])
    read = checkpointed(given.mapInArrow(_reader(sent, ROUNDS * shards, to_arrow_schema(shape)), shape))
    model = train(read, vocabulary, sent, shards)
    parts = spark.sparkContext.broadcast(model.parts)
    scored = read.where("kind = 2").select("rows", "lengths", "ids").mapInArrow(_scorer(sent, parts), "row long, model double")
    far = read.where("kind = 1").select("row", "hash", "times").join(counts, "hash", "left")
    log = F.log10(F.coalesce("n", F.lit(0)).cast("double") + 1)
    known = F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))
    far = far.groupBy("row").agg(F.sum(F.col("times") * log).alias("logs"), F.sum("times").alias("n_far"), known.alias("far_known"))
    whole, rest = float(np.log10(total + distinct + 1)), float(np.log10(vocabulary.rest))
    of_row = read.where("kind = 0").join(scored, "row").join(far, "row", "left")
    extra = lambda mass: F.coalesce(F.col("logs") - F.col("n_far") * mass, F.lit(0.0))
    return of_row.select(
        "keep.*",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra(whole)).alias("base_score"),
        (F.col("model") + F.col("named") + extra(rest)).alias("score"),
    )
