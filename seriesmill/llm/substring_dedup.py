"""Substring dedup by content-defined chunking: every passage of whole words that two documents share.

A chunk's border in the usual form of the method is a place where a gear hash has
low bits of zero. Such places can be far apart or missing (in "with with with ..."),
and what a repeated passage has before its first and after its last border is lost
(6.5 % of passages of 51 words were missed). So borders are taken at the least gear
hash of each window instead, which every window has; chunks vary in length, follow
the content and resist insertions as before, and are deduplicated by digest.

A window is a piece of ``least`` (``MIN_RUN``) bytes or ``MIN_WORDS`` words that
would be too short without its first unit or without its last. Units are words;
in a word of over ``LONG_WORD`` bytes every character is one. Any repeated passage
of that length is a union of windows another document has too, so windows alone
are compared, in two passes over the texts:

1. The shortest window at each unit has its border at one of its grams (pieces of
   ``GRAM`` bytes or ``GRAM_WORDS`` words), the one of least gear hash, the first if
   equal. This depends on the window's bytes alone, so equal windows have equal
   borders, at any entropy and whatever surrounds them. Neighbouring windows with
   one border are a chunk, hashed whole.
2. A gram that two documents have, always in equal chunks, makes those repeated
   as they are. Where chunks of one gram differ, each of their windows is hashed,
   and those that two documents have are repeated. The union of both in a document
   are its runs, exact to the unit. The first place (smallest doc_id, then place)
   of a chunk or window is the original. Copies are what copied ones cover and no
   original does; ``deduplicated`` removes them.

Both passes aggregate before the shuffle, and join back by sort-merge joins that
adaptive execution splits where one digest is hot. No pair of documents is made.
The second pass ships texts with a shared gram only, found by a bitmap of
``BUCKETS`` x 32768 bits; a text it lets by without one costs its shuffle alone.

Defined cases: a null or empty text has no windows; a window within one
document alone is no repeat; rows that repeat a doc_id with another text
are documents of their own, told apart by ``version``, a hash of the text; equal
rows are one document. Windows are compared by 64-bit hashes. Borders are byte
offsets and never lie within a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from seriesmill.llm.text import SPACE, Block, blocks, column, slice_hash, words
from seriesmill.session import checkpointed

MIN_RUN = 160
MIN_WORDS, GRAM, GRAM_WORDS, LONG_WORD = 51, 64, 20, 64
BUCKETS = 1024
_GEAR = np.random.default_rng(20240602).integers(0, 1 << 63, 256, dtype=np.uint64)
GRAMS = "digest long, whole long, doc long"
WINDOWS = "digest long, doc_id long, version long, start int, stop int"
RUNS = "doc_id long, version long, runs array<struct<start:int,stop:int,copies:array<struct<start:int,stop:int>>>>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash before each byte and at the end: every byte shifts the hash left by one and adds its number, so it sees 64 bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    own = out[1:]
    own[:] = _GEAR[data]
    for k in range(6):  # the sum over 2 ** k bytes, and the one before it shifted by as many
        if 1 << k < len(own):
            own[1 << k :] += own[: -(1 << k)].copy() << np.uint64(1 << k)
    return out


def gear_slice(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The gear hash of data[start:end] alone: what came before is shifted out, or taken away."""
    size = (end - start).astype(np.uint64)
    before = np.where(size < 64, hashes[start] << np.minimum(size, np.uint64(63)), np.uint64(0))
    return hashes[end] - before


def _units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, word numbers and rows of a block's units."""
    w = words(block, SPACE, lower=False)
    long = w.end - w.start > LONG_WORD
    if not long.any():
        return w.start, w.end, np.arange(len(w.start)), w.row
    depth = np.zeros(len(block.data) + 1, np.int8)
    depth[w.start[long]] += 1
    depth[w.end[long]] -= 1
    letters = np.flatnonzero((np.cumsum(depth[:-1], dtype=np.int8) > 0) & ((block.data & 0xC0) != 0x80))
    start = np.union1d(w.start[~long], letters)
    word = np.searchsorted(w.start, start, "right") - 1
    end = w.end[word]
    end = np.where(long[word], np.minimum(np.r_[start[1:], len(block.data)], end), end)
    return start, end, word, w.row[word]


def _last(start: np.ndarray, end: np.ndarray, word: np.ndarray, least: int, most_words: int) -> np.ndarray:
    """The last unit of the piece that begins at each unit; ascending, len(start) if the block ends before."""
    by_words = np.searchsorted(word, word + most_words - 1, "right") - 1
    by_words[word + most_words - 1 > word[-1]] = len(start)
    return np.minimum(np.searchsorted(end, start + least), by_words)


def _windows(block: Block, least: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and rows of units; the first, last and farthest last unit of windows, the hash of the gram at each border, and where chunks begin."""
    start, end, word, row = _units(block)
    if not len(start):
        return start, end, row, start, start, start, np.zeros(0, np.uint64), start
    last = _last(start, end, word, least, MIN_WORDS)
    stop = np.searchsorted(row, row, "right")
    first = np.flatnonzero(last < stop)
    far = np.maximum(last[first], np.minimum(np.r_[last[1:], len(start)], stop)[first] - 1)  # until the next start's piece is long enough
    last = last[first]
    to = _last(start, end, word, min(GRAM, least), GRAM_WORDS)
    gram_end = end[np.minimum(to, len(start) - 1)]
    grams = gear_slice(gear(block.data), start, gram_end)
    final = np.searchsorted(to, last, "right") - 1  # the last gram that ends within the window
    level = np.frexp(final - first + 1)[1] - 1
    named = np.empty(len(first), np.int64)
    best = np.arange(len(start))  # of the 2 ** k grams from each on
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        left, right = best[first[at]], best[final[at] - (1 << k) + 1]
        named[at] = np.where(grams[right] < grams[left], right, left)
        if 1 << k < len(best):
            left, right = best[: -(1 << k)], best[1 << k :]
            best = np.r_[np.where(grams[right] < grams[left], right, left), best[-(1 << k) :]]
    return start, end, row, first, last, far, slice_hash(block.data, start, gram_end)[named], np.flatnonzero(np.diff(named, prepend=-1))


def _closing(group: np.ndarray, n: int) -> np.ndarray:
    """The last window of each group of n windows."""
    return np.r_[group[1:], n][: len(group)] - 1


def _gram_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc").to_numpy()
            for block in blocks(column(batch, "text")):
                start, end, row, first, _, far, gram, group = _windows(block, least)
                whole = slice_hash(block.data, start[first[group]], end[far[_closing(group, len(first))]])
                row, gram = row[first[group]], gram[group]
                order = np.lexsort((whole, gram, row))
                row, gram, whole = row[order], gram[order], whole[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
                row, gram, whole = row[fresh], gram[fresh], whole[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[row + block.first])], names=["digest", "whole", "doc"])

    return run


def _window_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, alike, mixed = (column(batch, name) for name in ("doc_id", "version", "alike", "mixed"))
            for block in blocks(column(batch, "text")):
                start, end, row, first, last, far, gram, group = _windows(block, least)
                among = lambda x, sets: np.isin(x, sets.slice(block.first, block.rows).flatten().to_numpy().view(np.uint64))  # noqa: E731, B023
                closing = _closing(group, len(first))
                same = among(gram[group], alike)
                hit = among(gram, mixed)
                n = (far - last)[hit] + 1
                stop = end[np.r_[far[closing[same]], np.repeat(last[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
                first = np.r_[first[group[same]], np.repeat(first[hit], n)]
                start, row = start[first], row[first]
                at = pa.array(row + block.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slice_hash(block.data, start, stop).view(np.int64)),
                        ids.take(at),
                        versions.take(at),
                        pa.array((start - block.ends[row]).astype(np.int32)),
                        pa.array((stop - block.ends[row]).astype(np.int32)),
                    ],
                    names=["digest", "doc_id", "version", "start", "stop"],
                )

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _less(spans: list[tuple[int, int]], holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans without holes; both ascending and apart."""
    out, h = [], 0
    for a, b in spans:
        while h < len(holes) and holes[h][1] <= a:
            h += 1
        k = h
        while k < len(holes) and holes[k][0] < b:
            if holes[k][0] > a:
                out.append((a, holes[k][0]))
            a = max(a, holes[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return out


_SPAN = [("start", pa.int32()), ("stop", pa.int32())]
_RUNS = pa.list_(pa.struct([*_SPAN, ("copies", pa.list_(pa.struct(_SPAN)))]))


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, windows = [], column(batch, "windows")
        start, stop, copy = (windows.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
        ends = np.r_[0, np.cumsum(windows.value_lengths().to_numpy())]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            spans = list(zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True))
            copied = copy[a:b].tolist()
            own = _union([s for s, c in zip(spans, copied, strict=True) if not c])
            cuts = _less(_union([s for s, c in zip(spans, copied, strict=True) if c]), own)
            each, k = [], 0
            for x, y in _union(spans):
                to = k
                while to < len(cuts) and cuts[to][1] <= y:
                    to += 1
                each.append({"start": x, "stop": y, "copies": [{"start": c, "stop": d} for c, d in cuts[k:to]]})
                k = to
            runs.append(each)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "version"), pa.array(runs, _RUNS)], names=["doc_id", "version", "runs"])


def _versioned(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return own.withColumn("doc", F.xxhash64("doc_id", "version"))


def _held(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts whose doc is in sets, and a few more, without a shuffle of texts."""
    place = F.pmod("doc", F.lit(BUCKETS << 15))
    bucket, bit = F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(32767))
    maps = sets.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = texts.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket")
    return found.where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("bucket", "bits")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_RUN) -> DataFrame:
    """A row a document with repeats: doc_id, version and runs, an array of (start, stop, copies) in bytes.

    copies are the parts of the run that no original covers.
    """
    texts = _versioned(docs, key, text)
    grams = texts.select("doc", "text").mapInArrow(_gram_rows(least), GRAMS)
    extent = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("doc", "whole")]
    shared = grams.groupBy("digest").agg(*extent).where("min_doc <> max_doc").select("digest", (F.col("min_whole") == F.col("max_whole")).alias("same"))
    of_kind = lambda same, name: F.collect_set(F.when(same, F.col("digest"))).alias(name)
    sets = grams.select("digest", "doc").join(shared, "digest").groupBy("doc").agg(of_kind(F.col("same"), "alike"), of_kind(~F.col("same"), "mixed"))
    sets = checkpointed(sets)
    windows = _held(texts, sets).join(sets, "doc").select("doc_id", "version", "text", "alike", "mixed").mapInArrow(_window_rows(least), WINDOWS)
    place = F.struct("doc_id", "version", "start")
    first = windows.groupBy("digest").agg(F.min(place).alias("original"), F.max(F.struct("doc_id", "version")).alias("last"))
    first = first.where(~F.struct("original.doc_id", "original.version").eqNullSafe(F.col("last"))).drop("last")
    own = windows.join(first, "digest").select("doc_id", "version", F.struct("start", "stop", (~place.eqNullSafe(F.col("original"))).alias("copy")).alias("w"))
    # the repeated windows of one document: as many as its own text has
    return own.groupBy("doc_id", "version").agg(F.collect_list("w").alias("windows")).mapInArrow(_run_rows, RUNS)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_RUN) -> DataFrame:
    """``docs`` with the copies of repeated spans cut out of the texts, the originals left."""
    shape = docs.schema
    schema = to_arrow_schema(shape)
    runs = repeated_runs(docs, key, text, least).select("doc_id", "version", F.flatten(F.transform("runs", lambda r: r["copies"])).alias("cut"))
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    joined = row.join(runs, ["doc_id", "version"], "left").select("doc.*", F.col("cut").alias("__cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, cuts in zip(column(batch, text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if body is not None and cuts:
                    data, at, kept = body.encode(), 0, []
                    for c in cuts:
                        kept.append(data[at : c["start"]])
                        at = c["stop"]
                    body = b"".join([*kept, data[at:]]).decode()
                texts.append(body)
            own = [pa.array(texts, f.type) if f.name == text else column(batch, f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(own, schema=schema)

    return joined.mapInArrow(cut, shape)
