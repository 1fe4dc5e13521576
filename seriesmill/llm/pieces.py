"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The pieces come from a SentencePiece model file that is read, never trained. A
text, with a space put before it, is cut into chunks: a run of spaces with what
follows up to the next space, or a line break or tab. No piece crosses a cut, as
none of the model has a space after its first character, or a break or tab.

Over each distinct chunk lies a lattice: a node a byte border, an edge a piece;
characters without a piece of their own have an edge a byte. Pieces have Zipf
weights by their rank in the file, raised to ``alpha``. Forward filtering sums
the weights of all ways to each node; backward sampling draws, from the end, an
edge in proportion to its share of that sum. So a segmentation is drawn with the
probability that the weights give it. The draws depend on the row key, the
chunk's number and the step alone: a row has the same tokens in any partition.
A chunk's lattice is kept between blocks from the second time that it is seen,
up to ``KEEP_NODES`` in all; those of other chunks go with their block.

Decoding joins the bytes of the pieces and takes the first space away. It gives
back every text, the piece mark U+2581 within texts too, as that is always
encoded by bytes.

Defined cases: a null text has null tokens and decodes to null; an empty text
has the tokens of its space; rows that repeat a key and text have the same
tokens; extra columns are kept, but for one with the name of the output, which
is replaced.
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

from seriesmill.llm.text import SliceHash, blocks, mix, release, slice_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 17
KEEP_NODES, BLOCK = 3 << 19, 1 << 19
LIKELY = 20
MARK, SPACE = "▁", 0x20


@dataclass
class Pieces:
    """The pieces of a model: bytes (the mark as a space), ids and log weights; ids of the 256 byte tokens."""

    lengths: np.ndarray
    hashes: list[np.ndarray]  # by length: sorted
    ids: list[np.ndarray]
    weights: np.ndarray  # by id
    bytes_of: np.ndarray  # id of each byte's token
    table: np.ndarray  # bytes of all tokens, back to back
    table_start: np.ndarray
    likely: np.ndarray  # by the low LIKELY bits of a hash: bit 0 if some piece has them, bit 1 if a longer piece begins so

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = ALPHA) -> Pieces:
        return cls.of(_model(path), alpha)

    @classmethod
    def of(cls, proto: bytes, alpha: float = ALPHA) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.vocab_size()
        surface, rank = [b""] * n, np.full(n, 8.0 * n)
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        bytes_of = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                surface[i], bytes_of[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surface[i] = model.id_to_piece(i).replace(MARK, " ").encode()
                score = model.get_score(i)
                rank[i] = 1 - score if score > -1e6 else i
                by_length.setdefault(len(surface[i]), []).append((surface[i], i))
        hashes, ids, lengths = [], [], np.array(sorted(by_length))
        for length in lengths.tolist():
            own = by_length[length]
            data = np.frombuffer(b"".join(s for s, _ in own), np.uint8)
            at = np.arange(len(own)) * length
            h, i = slice_hash(data, at, at + length), np.array([i for _, i in own])
            order = np.argsort(h)
            hashes.append(h[order])
            ids.append(i[order])
        table = np.frombuffer(b"".join(surface), np.uint8)
        likely = np.zeros(1 << LIKELY, np.uint8)
        likely[np.concatenate(hashes) & np.uint64((1 << LIKELY) - 1)] = 1
        data = np.frombuffer(b"".join(x for own in by_length.values() for x, _ in own), np.uint8)
        size = np.array([length for length, own in by_length.items() for _ in own])
        start = np.cumsum(size) - size
        for length in range(1, int(size.max())):
            at = start[size > length]
            likely[slice_hash(data, at, at + length) & np.uint64((1 << LIKELY) - 1)] |= 2
        return cls(lengths, hashes, ids, -alpha * np.log(rank + 1), bytes_of, table, np.r_[0, np.cumsum([len(s) for s in surface])], likely)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, back to back."""
    return np.arange(length.sum()) + np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) if len(start) else np.zeros(0, np.int64)


class Lattices:
    """Filtered lattices of distinct chunks: a node's incoming edges lie side by side, with running shares."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.key, self.last = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # chunk hash (sorted), its end node
        self.nodes = self.edges = 0
        self.kept = 0, 0  # nodes and edges that stay
        self.seen = np.zeros(1 << 22, bool)  # by the low bits of a chunk's hash
        self.first = np.zeros(1 << 16, np.int32)  # by node: its first edge
        self.degree = np.zeros(1 << 16, np.int16)  # by node; 0 where a chunk starts
        self.share = np.zeros(1 << 18, np.float32)  # by edge: running share within its node
        self.origin, self.token = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def _room(self, nodes: int, edges: int) -> None:
        """Grows the arrays by doubling."""
        for name, need in (("first", nodes), ("degree", nodes), ("share", edges), ("origin", edges), ("token", edges)):
            have = getattr(self, name)
            if need > len(have):
                more = np.zeros(max(need, 2 * len(have)), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)

    def ends(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """End node of the lattice of each chunk data[start:stop]; they hold until the next call."""
        h = slice_hash(data, start, stop)
        known, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.nodes, self.edges = self.kept
        if self.nodes > KEEP_NODES:
            self.clear()
        place = np.searchsorted(self.key, known)
        fresh = np.ones(len(known), bool)
        inside = place < len(self.key)
        fresh[inside] = self.key[place[inside]] != known[inside]
        last = np.empty(len(known), np.int32)
        last[~fresh] = self.last[place[~fresh]]
        slot = known & np.uint64(len(self.seen) - 1)
        stays = fresh & (self.seen[slot] | (times > 1))
        self.seen[slot] = True
        for own in (stays, fresh & ~stays):
            if own.any():
                last[own] = self._add(data, start[first[own]], stop[first[own]])
            if own is stays:
                self.kept = self.nodes, self.edges
        self.key, self.last = np.insert(self.key, place[stays], known[stays]), np.insert(self.last, place[stays], last[stays])
        return last[which]

    def _edges(self, text: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first byte and token of the edges of new chunks, back to back in ``text``; ``left`` has the bytes from each to its chunk's end."""
        at = np.flatnonzero((text & 0xC0) != 0x80)
        starts, which = at, np.arange(len(at))
        sizes = np.diff(np.r_[at, len(text)])
        covered = np.zeros(len(at), bool)
        of = SliceHash(text)
        by_length = dict(zip(self.pieces.lengths.tolist(), range(len(self.pieces.lengths)), strict=True))
        for length in range(1, int(self.pieces.lengths[-1]) + 1):
            inside = left[at] >= length
            at, which = at[inside], which[inside]
            if not len(at):
                break
            h = of(at, length)
            likely = self.pieces.likely[h & np.uint64((1 << LIKELY) - 1)]
            if length in by_length:
                hashes, ids = self.pieces.hashes[by_length[length]], self.pieces.ids[by_length[length]]
                maybe = np.flatnonzero(likely & 1)
                place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                right = hashes[place] == h[maybe]
                hit = maybe[right]
                covered[which[hit]] |= sizes[which[hit]] == length
                yield length, at[hit], ids[place[right]]
            longer = likely > 1
            at, which = at[longer], which[longer]
        lone = _gather(starts[~covered], sizes[~covered])  # bytes of characters that have no piece
        yield 1, lone, self.pieces.bytes_of[text[lone]]

    def _add(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Builds and filters the lattices of new chunks; their end nodes.

        Nodes are numbered by age, which is their bytes from the chunk's start, so the nodes of an age, and the
        edges that end there, lie side by side: filtering takes a step an age over all chunks.
        """
        longest = np.argsort(start - stop, kind="stable")
        start, size = start[longest], (stop - start)[longest]
        text = data[_gather(start, size)]
        chunk = np.repeat(np.arange(len(size)), size)
        age = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        most = int(size[0])
        base = np.r_[0, np.cumsum(np.searchsorted(-size, -np.arange(most + 1), "right"))]  # the first node of each age
        node = base[age] + chunk
        found = [(node[at], base[age[at] + length] + chunk[at], token) for length, at, token in self._edges(text, size[chunk] - age)]
        degree = np.zeros(base[-1], np.int32)
        for _, target, _ in found:  # a length's targets are distinct
            degree[target] += 1
        first = np.cumsum(degree) - degree
        edges = int(first[-1] + degree[-1])
        source, token = np.empty(edges, np.int32), np.empty(edges, np.int32)
        at = first.copy()
        for own, target, ids in found:
            place = at[target]
            source[place], token[place] = own, ids
            at[target] += 1
        del found, at, node, chunk, age
        weight = self.pieces.weights[token]
        total = np.zeros(base[-1])
        for a in range(1, most + 1):
            low, high = base[a], base[a + 1]
            here = low + np.flatnonzero(degree[low:high])
            e = slice(first[low], first[high] if high < len(first) else edges)
            weight[e] += total[source[e]]
            total[here] = np.logaddexp.reduceat(weight[e], first[here] - first[low]) if len(here) else 0
        weight -= np.repeat(total, degree)
        runs = np.cumsum(np.exp(weight, out=weight), out=weight)
        inner = degree > 0
        runs -= np.repeat(np.r_[0, runs][first[inner]], degree[inner])
        runs[first[inner] + degree[inner] - 1] = 2.0
        n, e = self.nodes, self.edges
        self._room(n + int(base[-1]), e + edges)
        self.share[e : e + edges] = runs
        self.origin[e : e + edges] = n + source
        self.token[e : e + edges] = token
        self.first[n : n + base[-1]] = e + first
        self.degree[n : n + base[-1]] = degree
        self.nodes, self.edges = n + int(base[-1]), e + edges
        last = np.empty(len(size), np.int32)
        last[longest] = n + base[size] + np.arange(len(size))
        return last

    def sample(self, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each chunk occurrence, and how many it has; ``key`` seeds its draws."""
        count = np.zeros(len(end), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        live, at, step = np.arange(len(end)), end, 0
        while len(live):
            u = ((mix(key + np.uint64(step)) >> np.uint64(40)) * 2.0**-24).astype(np.float32)
            edge, left = self.first[at], self.degree[at].astype(np.int32)
            while True:  # the first edge whose running share is above u, by halving
                half = left >> 1
                if not half.any():
                    break
                right = self.share[edge + np.maximum(half, 1) - 1] <= u
                right &= half > 0
                edge = edge + np.where(right, half, 0)
                left = np.where(right, left - half, np.where(half > 0, half, left))
            drawn.append((live, self.token[edge]))
            count[live] += 1
            at = self.origin[edge]
            more = self.degree[at] > 0
            live, at, key, step = live[more], at[more], key[more], step + 1
        out = np.empty(count.sum(), np.int32)
        stop = np.cumsum(count)
        for k, (who, token) in enumerate(drawn):
            out[stop[who] - 1 - k] = token
        return out, count


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts and stops over rows of bytes with borders ``ends``."""
    n = len(data)
    space, alone = data == SPACE, (data == 0x0A) | (data == 0x09)
    begins = np.zeros(n + 1, bool)
    begins[0] = True
    begins[1:n] = (space[1:] & ~space[:-1]) | alone[:-1] | (alone[1:] & ~space[:-1])
    begins[ends] = True
    start = np.flatnonzero(begins[:n]) if n else np.zeros(0, np.int64)
    stop = np.r_[start[1:], n] if n else start
    return start, stop


def encode_block(data: np.ndarray, ends: np.ndarray, key: np.ndarray, lattices: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of rows of bytes, back to back, and the rows' offsets into them."""
    rows = len(ends) - 1
    padded = np.full(len(data) + rows, SPACE, np.uint8)
    ends = ends + np.arange(rows + 1)
    keep = np.ones(len(padded), bool)
    keep[ends[:-1]] = False
    padded[keep] = data
    start, stop = cut(padded, ends)
    first = np.searchsorted(start, ends)
    row = np.repeat(np.arange(rows), np.diff(first))
    own = mix(key.astype(np.uint64) ^ mix(np.array([seed], np.uint64))[0])
    chunk_key = mix(own[row] + (np.arange(len(start)) - first[row]).astype(np.uint64))
    tokens, count = lattices.sample(lattices.ends(padded, start, stop), chunk_key)
    return tokens, np.r_[0, np.cumsum(np.bincount(row, count, rows))].astype(np.int64)


def decode_block(tokens: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of tokens without their first space, and the rows' offsets."""
    start = pieces.table_start[tokens]
    size = pieces.table_start[tokens + 1] - start
    data = pieces.table[_gather(start, size)]
    ends = np.r_[0, np.cumsum(size)][offsets]
    drop = ends[:-1][(ends[1:] > ends[:-1])]
    drop = drop[data[drop] == SPACE]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep], np.r_[0, np.cumsum(keep)][ends]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "tokens", path: str = MODEL, alpha: float = ALPHA, check: str | None = None) -> DataFrame:
    """``docs`` with the sampled token ids of each text at the end; with ``check``, also whether they decode to the text.

    The key is any column; its hash seeds the row's draws.
    """
    proto = docs.sparkSession.sparkContext.broadcast(_model(path))
    named = {x.lower() for x in (out, check) if x}
    given = docs.select(F.xxhash64(key).alias("__key"), F.col(text).alias("__text"), *[c for c in docs.columns if c.lower() not in named])
    shape = T.StructType([*given.schema.fields[2:], T.StructField(out, T.ArrayType(T.IntegerType()))])
    if check:
        shape = shape.add(check, T.BooleanType())
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(proto.value, alpha)
        lattices = Lattices(pieces)
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            for block in blocks(batch.column(1), BLOCK):
                own = slice(block.first, block.first + block.rows)
                tokens, offsets = encode_block(block.data, block.ends, keys[own], lattices)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens), mask=pa.array(block.null))
                columns = [c.slice(block.first, block.rows).cast(f.type) for c, f in zip(batch.columns[2:], schema, strict=False)]
                columns.append(lists.cast(schema.field(len(columns)).type))
                if check:
                    data, ends = decode_block(tokens, offsets, pieces)
                    same = np.diff(ends) == np.diff(block.ends)
                    if same.all() and len(data) == len(block.data):
                        wrong = np.searchsorted(block.ends, np.flatnonzero(data != block.data), "right") - 1
                        same[wrong] = False
                    else:
                        same = np.array([data[ends[i] : ends[i + 1]].tobytes() == block.data[block.ends[i] : block.ends[i + 1]].tobytes() for i in range(block.rows)])
                    columns.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        del pieces, lattices
        release()

    return given.mapInArrow(run, shape)


def decoded(docs: DataFrame, tokens: str = "tokens", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """``docs`` with the text of a column of token ids at the end; null tokens give null."""
    proto = docs.sparkSession.sparkContext.broadcast(_model(path))
    given = docs.select(F.col(tokens).alias("__tokens"), *[c for c in docs.columns if c.lower() != out.lower()])
    shape = T.StructType([*given.schema.fields[1:], T.StructField(out, T.StringType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(proto.value)
        for batch in batches:
            lists = batch.column(0)
            lists = lists.cast(pa.list_(pa.int32())) if lists.type != pa.list_(pa.int32()) else lists
            null = np.asarray(lists.is_null())
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            data, ends = decode_block(np.asarray(lists.flatten()).astype(np.int64), np.r_[0, np.cumsum(sizes)], pieces)
            raw = data.tobytes()
            texts = [None if null[i] else raw[ends[i] : ends[i + 1]].decode() for i in range(len(null))]
            own = [c.cast(f.type) for c, f in zip(batch.columns[1:], schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], schema=schema)
        del pieces
        release()

    return given.mapInArrow(run, shape)
