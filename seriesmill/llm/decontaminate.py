"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents as a sequence of word ids. Words that no test
phrase has, and word pairs that no test phrase has side by side, cannot lie in
an occurrence; they end a run, and runs shorter than the shortest phrase cannot
hold one. The runs, each closed by the separator id 0, are the shard's text. Its
suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix, and
the suffix positions that are multiples of ``SAMPLE``. All phrases go through
backward search together; occurrences are located by walking back to a sampled
position, and the spans of each document are merged.

Documents stay whole in one shard, so no shuffle is needed. The phrases are a
query set: it is broadcast in blocks of at most ``PHRASE_BYTES`` of text, and
each block is one more pass over the rows.

Defined cases: a null or empty text has no words and no spans; an item without
words has no phrase; an item of fewer words than the window is one phrase; equal
items are all reported; rows that repeat a doc_id are judged one by one; extra
columns of either table are ignored, and those of the documents are kept by
``decontaminated``. Item ids are reported as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.llm.text import NOT_ALPHANUMERIC, blocks, column, mix, release, words

WINDOW = 13
#: Every so many text positions the suffix array keeps one.
SAMPLE = 8
#: Test phrases of at most so much text are broadcast at a time.
PHRASE_BYTES = 32 << 20
#: A shard ends once it has so many words.
SHARD_WORDS = 1 << 18


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    rank = np.zeros(n + 1, np.int64)  # rank 0 stands for the end
    order = np.argsort(text, kind="stable")
    value = text[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes = np.diff(np.r_[head, n])
    rank[order] = np.repeat(head, sizes) + 1
    step = 1
    tied = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(tied)
    while len(at):
        item = order[at]
        group = rank[item]
        after = rank[np.minimum(item + step, n)]
        by = np.lexsort((after, group))
        item, group, after = item[by], group[by], after[by]
        order[at] = item
        fresh = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        head = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[head, len(at)])
        rank[item] = np.repeat(at[head], sizes) + 1
        at = at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class WaveletMatrix:
    """rank(symbol, i) for arrays of queries: one bit row a level, with running counts."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (text >> level) & 1
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(text) - int(ones[-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before i."""
        low, symbol = np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            symbol = symbol * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
        return symbol, i - low

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before i."""
        low = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
        return i - low


class FMIndex:
    """Counts and finds word phrases in a text of ids; id 0 separates. Inside, ids are one up and a 0 of its own ends the text."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text, symbols = np.r_[text.astype(np.int64) + 1, 0], symbols + 1
        order = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        marked = order % sample == 0
        self.marked = np.r_[0, np.cumsum(marked)]
        self.kept = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases (rows of ids), all searched together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -k] + 1
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each suffix rank: steps back to a sampled position, plus the steps."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        out = np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            hit = self.marked[r + 1] > self.marked[r]
            done = live[hit]
            out[done] = self.kept[self.marked[r[hit]]] + steps[done]
            live = live[~hit]
            symbol, rank = self.wavelet.access_rank(row[live])
            row[live] = self.before[symbol] + rank
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """The windows of a block of items, as ids of its own vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; id is place + 1
    pairs: np.ndarray  # sorted hashes of neighbouring words
    ids: np.ndarray  # windows x WINDOW, right-aligned, distinct
    lengths: np.ndarray
    owners: np.ndarray  # items of each window, back to back
    owner_ends: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[str], texts: list[str | None], window: int = WINDOW) -> Phrases:
        rows: dict[tuple[int, ...], list[int]] = {}
        at = 0
        for block in blocks(pa.array(texts, pa.large_string())):
            w = words(block, NOT_ALPHANUMERIC)
            for r in range(block.rows):
                own = tuple(w.hash[w.first[r] : w.first[r + 1]].tolist())
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    owners = rows.setdefault(own[k : k + window], [])
                    if not owners or owners[-1] != at + r:
                        owners.append(at + r)
            at += block.rows
        vocabulary = np.unique(np.array([h for row in rows for h in row], np.uint64))
        pairs = {(a, b) for row in rows for a, b in zip(row, row[1:], strict=False)}
        ids = np.zeros((len(rows), window), np.int64)
        for i, row in enumerate(rows):
            ids[i, window - len(row) :] = np.searchsorted(vocabulary, np.array(row, np.uint64)) + 1
        return cls(
            vocabulary,
            np.unique(pair_hash(*np.array(sorted(pairs), np.uint64).reshape(-1, 2).T)),
            ids,
            np.array([len(row) for row in rows], np.int64),
            np.array([i for own in rows.values() for i in own], np.int64),
            np.r_[0, np.cumsum([len(own) for own in rows.values()], dtype=np.int64)].astype(np.int64),
            items,
        )


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) + right)


def member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted values, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    place = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return place, sorted_values[place] == x


def occurrences(word_hash: np.ndarray, row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's words: first word, length and window of every occurrence."""
    none = np.zeros(0, np.int64)
    if not len(p.lengths) or not len(word_hash):
        return none, none, none
    place, known = member(p.vocabulary, word_hash)
    near = np.zeros(len(word_hash), bool)  # may follow the word before it
    both = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1])) + 1
    near[both] = member(p.pairs, pair_hash(word_hash[both - 1], word_hash[both]))[1]
    starts = np.flatnonzero(known & ~near)
    stops = np.flatnonzero(known & ~np.r_[near[1:], False]) + 1
    long = stops - starts >= p.lengths.min()
    starts, sizes = starts[long], (stops - starts)[long]
    if not len(starts):
        return none, none, none
    base = np.r_[0, np.cumsum(sizes + 1)]
    source = np.arange(base[-1]) - np.repeat(base[:-1] - starts, sizes + 1)  # word of each text position
    text = np.where(np.arange(base[-1]) == np.repeat(base[1:] - 1, sizes + 1), 0, place[np.minimum(source, len(place) - 1)] + 1)
    index = FMIndex(text, len(p.vocabulary) + 1)
    low, high = index.search(p.ids, p.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    rank = np.repeat(low[found] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    window = np.repeat(found, count)
    return source[index.locate(rank)], p.lengths[window], window


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def _merge(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(parts: list[pa.Array]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last) of a column with the hash and row of their words."""
    first, hashes, rows, at, total = 0, [], [], 0, 0
    for block in blocks(parts[0]):
        w = words(block, NOT_ALPHANUMERIC)
        hashes.append(w.hash)
        rows.append(w.row + block.first)
        at, total = block.first + block.rows, total + len(w.hash)
        if total >= SHARD_WORDS:
            yield first, at, np.concatenate(hashes), np.concatenate(rows)
            first, hashes, rows, total = at, [], [], 0
    if at > first:
        yield first, at, np.concatenate(hashes), np.concatenate(rows)


def _pass(phrases, text: str, schema: pa.Schema):
    """One pass over the rows: adds what this block of phrases hits to spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words = np.zeros(batch.num_rows, np.int64)
            old_spans, old_items = column(batch, "spans").to_pylist(), column(batch, "items").to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in old_spans]
            items: list[list[str]] = [[] for _ in old_spans]
            for first, last, value, row in _shards([column(batch, text)]):
                border = np.searchsorted(row, np.arange(first, last + 1))
                n_words[first:last] = np.diff(border)
                start, length, window = occurrences(value, row, p)
                by = np.argsort(row[start], kind="stable") if len(start) else start
                start, length, window = start[by], length[by], window[by]
                for own in np.split(np.arange(len(start)), np.flatnonzero(np.diff(row[start])) + 1) if len(start) else []:
                    r = int(row[start[own[0]]])
                    begin = start[own] - border[r - first]
                    spans[r] = _merge(begin, begin + length[own])
                    seen = {int(i) for k in np.unique(window[own]) for i in p.owners[p.owner_ends[k] : p.owner_ends[k + 1]]}
                    items[r] = [p.items[i] for i in seen]
            for r, (old, own) in enumerate(zip(old_spans, old_items, strict=True)):
                if old:
                    both = np.array([(x["first"], x["last"]) for x in old] + spans[r], np.int64)
                    spans[r] = _merge(both[:, 0], both[:, 1])
                items[r] = sorted({*own, *items[r]}) if own or items[r] else []
            made = {
                "n_words": pa.array(n_words),
                "spans": pa.array([[{"first": a, "last": b} for a, b in own] for own in spans], schema.field("spans").type),
                "items": pa.array(items, schema.field("items").type),
            }
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else column(batch, f.name).cast(f.type) for f in schema], schema=schema)
        release()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Columns of ``docs`` with n_words, spans (merged word ranges that are hit, ends exclusive) and items.

    spans and items join ``docs`` under those names, which it must not have.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    phrases = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // phrase_bytes))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    schema = to_arrow_schema(out.schema)
    for k in range(n_blocks):
        block = phrases.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast(Phrases.of([r["item"] for r in block], [r["text"] for r in block], window))
        out = out.mapInArrow(_pass(sent, text, schema), out.schema)
    return out


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contamination rule: a twentieth of a document's words, or more, are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with its columns.

    The columns go by number meanwhile, so that no name clashes and each text passes once.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    judged = contamination(numbered, benchmark, f"_{names.index(text)}").withColumn("n_hit", hit_words())
    return judged.where(~contaminated()).select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)])
