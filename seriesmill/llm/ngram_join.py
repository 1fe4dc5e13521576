"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct five-word shingles. Two sets
link when their Jaccard similarity is at least ``SIMILAR``, which is 3/4.

Spaces. Space i serves the pairs whose smaller set has a size in band i; the
larger set has up to 4/3 of that. Sets of sizes a and b that link differ in at
most (a + b) / 7 shingles. A space parts the shingle domain into n1 ranges of
hashes and each range into n2 parts, and enumerates the subsets of n2 - k2 parts
of every range: a set's signature for a subset is a hash of its shingles there.
A difference destroys the signatures of the subsets that hold its part, so k
differences destroy at most ``lost`` of them, and a set with m non-empty
signatures shares at least m - lost with each partner. Sets with m <= lost also
emit their empty signatures, so that two of these meet too. Spaces of sets under
``ENUMERATED`` shingles take the pairs of three parts (n2 = 3, k2 = 1); the
signatures of larger sets, which would be half as many again as their shingles
allow for, have one part a range (n2 = 1, k2 = 0).

Search. Signatures are packed by block and dealt to buckets by their hash, about
``BUCKET_BYTES`` of text each; a block sends one entry for a signature that
several of its documents have, so a hot signature has an entry a block and not a
document. A document stays in a space if it has as many signatures with others
as it must share. Of its h ones there, the rarest first, h - must + 1 are enough
to meet each partner (prefix filter). Documents that meet are clusters.

Verification. A cluster's documents are dealt to blocks by a hash, and each pair
of blocks is a tile, one group in one task; small clusters share a tile. A tile
gets each set once and intersects all its pairs inside the task: shingles of few
documents by their lists, those of many as a product of 0/1 matrices. Only a
tree of the linked documents leaves it, at most a row a document, and never a
row a pair. A document is sent to as many tiles as its cluster has blocks, so a
cluster costs the square of its size over the block size; no exact join of sets
that are all about as similar as the bound can do less than compare them.

Exact copies are one class from the start, linked through its smallest doc_id.

Defined cases: a null, empty or wordless text has size 0 and its own doc_id as
component; rows that repeat a doc_id are one node, which links when one of its
texts does, and has the size of the largest set; a null doc_id has its set's size and a null component, and links
with nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.components import components
from seriesmill.llm.text import SPACE, blocks, column, mix, release, shingles, words
from seriesmill.session import checkpointed

SHINGLE = 5
#: Similarity as a fraction, 3/4; the bounds above follow from it.
OVER, UNDER = 3, 4
BUCKET_BYTES = 16 << 20
BLOCK = 1 << 20
BROADCAST_IDS = 250_000
BAND, ENUMERATED = 1.4, 64
#: Documents and shingles of a block of a tile, and the most documents of a shingle whose pairs are listed.
TILE_DOCS, TILE_SHINGLES, LISTED = 512, 1 << 19, 24


def spaces(most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Of each space up to sets of size ``most``: least size, largest smaller set, largest size, n1, n2, k2."""
    low, out = 1, []
    while low <= most:
        after = max(low + 1, int(low * BAND))
        small = after - 1
        top = small * UNDER // OVER
        d = differences(small, top) + 1
        if small == 1:
            out.append((low, small, top, 1, 1, 0))
        elif low < ENUMERATED:
            out.append((low, small, top, int(np.ceil(0.6 * d + 0.75 * np.sqrt(d) + 0.5)), 3, 1))
        else:
            out.append((low, small, top, int(np.ceil(1.15 * d + 1.5 * np.sqrt(d) + 1)), 1, 0))
        low = after
    return out


def lost(k: np.ndarray, n1: int, n2: int, k2: int) -> np.ndarray:
    """Most signatures that k differences destroy: in each range the first part takes most, so they spread."""
    if k2 == 0:
        return np.minimum(k, n1)
    return np.minimum(k, n1) * (n2 - 1) + np.clip(k - n1, 0, n1)


def differences(a, b):
    """Most differences of linked sets of these sizes: (a + b)(1 - s)/(1 + s)."""
    return (a + b) * (UNDER - OVER) // (UNDER + OVER)


def signatures(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, row and must-share count for the sets value[offsets[i]:offsets[i+1]], each sorted.

    Bits 16 to 23 of a signature are its space, the others a hash.
    """
    size = np.diff(offsets)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, (low, small, top, n1, n2, k2) in enumerate(spaces(int(size.max(initial=0)))):
        rows = np.flatnonzero((size >= low) & (size <= top))
        if not len(rows):
            continue
        n = size[rows]
        k = np.where(n <= small, differences(n, np.minimum(n * UNDER // OVER, top)), differences(n, np.minimum(n, small)))
        at = np.repeat(offsets[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        own, h = np.repeat(np.arange(len(rows)), n), value[at]
        cells = n1 * n2
        cell = own * cells + (((h >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        cell, total = cell[head], np.add.reduceat(mix(h), head)
        number = n1
        if k2:
            whole = np.zeros(len(rows) * cells, np.uint64)
            whole[cell] = total
            subsets = np.array(list(combinations(range(n2), n2 - k2)))
            number = n1 * len(subsets)
            whole = whole.reshape(-1, n1, n2)[:, :, subsets].sum(axis=-1, dtype=np.uint64).ravel()
            cell = np.flatnonzero(whole)
            total = whole[cell]
        row, part = cell // number, cell % number
        m = np.bincount(row, minlength=len(rows))
        share = m - lost(k, n1, n2, k2)
        poor = np.flatnonzero(share <= 0)
        if len(poor):
            full = (poor[:, None] * number + np.arange(number)).ravel()
            void = full[~np.isin(full, cell)]
            row, part = np.r_[row, void // number], np.r_[part, void % number]
            total = np.r_[total, np.zeros(len(void), np.uint64)]
        salt = mix(np.array([i + 1], np.uint64))[0]
        mark = mix(total ^ mix(part.astype(np.uint64) + salt)) & ~(np.uint64(0xFF) << np.uint64(16)) | np.uint64(i) << np.uint64(16)
        out.append((mark, rows[row], np.maximum(share, 1)[row]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, shingle hashes and offsets of each block of a batch."""
    for block in blocks(column(batch, "text"), BLOCK):
        yield block.first, block.rows, *shingles(words(block, SPACE), SHINGLE)


PACKED = "bucket int, docs binary, sizes binary, marks binary, place binary, share binary"
#: Rows of a bucket: a signature that others have too (value; must-share), or with must-share -1 a document's size.
FOUND = "doc long, value long, must int"


def _packed_row(bucket: int, docs: np.ndarray, sizes: np.ndarray | None, mark: np.ndarray, row: np.ndarray, share: np.ndarray) -> tuple:
    """One row of ``PACKED``: 48 bits of each signature (more collisions only mean more checks) and the place of its document among those named."""
    if sizes is not None:
        return bucket, docs.tobytes(), sizes.astype(np.int32).tobytes(), b"", b"", b""
    used, place = np.unique(row, return_inverse=True)
    marks = mark.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return bucket, docs[used].tobytes(), b"", marks, place.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), share.tobytes()


def _pack(n_buckets: int):
    """Rows of documents to rows of packed signatures, one for each block and bucket.

    Signatures that several documents of a block have go out at once, to any bucket (negative: known to
    be shared); to their own bucket goes one entry with must-share 0, which stands for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id").cast(pa.int64()))
            for first, rows, value, offsets in _sets(batch):
                mark, row, share = signatures(value, offsets)
                mark &= ~np.uint64(0xFFFF)
                share = np.minimum(share, 255).astype(np.uint8)
                doc, any_bucket = ids[first : first + rows], int(mix(np.array([ids[first]]).view(np.uint64))[0] % np.uint64(n_buckets))
                bucket = (mix(mark) % np.uint64(n_buckets)).astype(np.int64)
                order = np.lexsort((mark, bucket))
                mark, row, share, bucket = mark[order], row[order], share[order], bucket[order]
                head = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, np.int64)
                several = np.repeat(np.diff(np.r_[head, len(mark)]) > 1, np.diff(np.r_[head, len(mark)]))
                made = [_packed_row(any_bucket, doc, np.diff(offsets), mark, row, share)]
                if several.any():
                    made.append(_packed_row(-1 - any_bucket, doc, None, mark[several], row[several], share[several]))
                share = np.where(several, np.uint8(0), share)
                mark, row, share, bucket = mark[head], row[head], share[head], bucket[head]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
                for a, b in zip(cut, np.r_[cut, len(bucket)][1:], strict=True):
                    made.append(_packed_row(int(bucket[a]), doc, None, mark[a:b], row[a:b], share[a:b]))
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["bucket", "docs", "sizes", "marks", "place", "share"])
        release()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: the documents' sizes, and the signatures that several documents have."""
    docs, marks, shares, out = [], [], [], []
    for bucket, own, sizes, mark, place, share in zip(*(table.column(c).to_pylist() for c in ("bucket", "docs", "sizes", "marks", "place", "share")), strict=True):
        own, share = np.frombuffer(own, np.int64), np.frombuffer(share, np.uint8)
        if not len(mark):
            out.append((own, np.frombuffer(sizes, np.int32).astype(np.int64), np.full(len(own), -1, np.int32)))
            continue
        full = np.zeros((len(mark) // 6, 8), np.uint8)
        full[:, 2:] = np.frombuffer(mark, np.uint8).reshape(-1, 6)
        named = own[np.frombuffer(place, np.uint16 if len(own) < 1 << 16 else np.uint32)], full.view(np.int64).ravel(), share.astype(np.int32)
        if bucket < 0:
            out.append(named)
        else:
            for held, x in zip((docs, marks, shares), named, strict=True):
                held.append(x)
    if docs:
        doc, mark, share = (np.concatenate(x) for x in (docs, marks, shares))
        order = np.argsort(mark, kind="stable")
        doc, mark, share = doc[order], mark[order], share[order]
        count = np.diff(np.r_[np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]), len(mark)])
        keep = np.repeat(count > 1, count) & (share > 0)
        out.append((doc[keep], mark[keep], share[keep]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    release()
    return pa.table(columns, names=["doc", "value", "must"])


def _clusters(found: DataFrame) -> DataFrame:
    """doc, cluster: documents that may link are in one cluster."""
    space = F.shiftright("value", 16).bitwiseAND(F.lit(255)).alias("space")
    shared = found.where("must > 0").groupBy("doc", space).agg(F.collect_set("value").alias("marks"), F.max("must").alias("must"))  # a document's own signatures
    open_docs = checkpointed(shared.where("size(marks) >= must"))
    rows = open_docs.select("doc", "space", "must", F.explode("marks").alias("mark"))
    number = checkpointed(rows.groupBy("mark").agg(F.count("*").alias("df")).where("df > 1"))
    ranked = rows.join(number, "mark").groupBy("doc", "space").agg(F.sort_array(F.collect_list(F.struct("df", "mark"))).alias("marks"), F.max("must").alias("must"))
    first = ranked.where("size(marks) >= must").select("doc", F.explode(F.expr("slice(marks, 1, size(marks) - must + 1)")["mark"]).alias("mark"))
    first = checkpointed(first)
    pivots = checkpointed(first.groupBy("mark").agg(F.min("doc").alias("a"), F.max("doc").alias("high")).where("a < high").select("mark", "a"))
    edges = checkpointed(first.join(pivots, "mark").select("a", F.col("doc").alias("b")).distinct())
    named = components(edges).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    return named.unionByName(named.select(F.col("cluster").alias("doc"), "cluster").distinct())


def _tiled(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc, cluster, blocks (of the cluster), block of each document of a cluster."""
    sizes = found.where("must = -1").groupBy("doc").agg(F.max("value").alias("size"))
    of_docs = checkpointed(clusters.join(sizes, "doc"))
    whole = of_docs.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    number = F.greatest(F.ceil(F.col("n") / TILE_DOCS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    many = checkpointed(whole.select("cluster", number.alias("blocks")).where("blocks > 1"))
    named = of_docs.join(many, "cluster", "left").select("doc", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    return checkpointed(named.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, offsets in _sets(batch):
            n = np.diff(offsets).astype(np.int64)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n), none], names=["doc_id", "n_shingles", "component_id"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle hashes of each document, beside its place."""
    for batch in batches:
        for first, rows, value, offsets in _sets(batch):
            sets = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64))).cast(pa.list_(pa.int64()))
            places = [column(batch, c).slice(first, rows) for c in ("doc_id", "cluster", "blocks", "block")]
            yield pa.RecordBatch.from_arrays([*places, sets], names=["doc", "cluster", "blocks", "block", "members"])
    release()


def common_pairs(cluster: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of owners of one cluster with shingles in common, the smaller first, and how many these are.

    ``cluster`` is by owner and ascending, ``owner`` is below n.
    """
    order = np.lexsort((owner, value, cluster[owner]))
    value, owner = value[order], owner[order]
    of = cluster[owner]
    head = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])]) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.r_[head, len(value)])
    keys = []
    for d in range(2, LISTED + 1):
        at = head[count == d]
        if len(at):
            i, j = np.triu_indices(d, 1)
            keys.append((owner[at[:, None] + i] * n + owner[at[:, None] + j]).ravel())
    listed, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    dense = np.flatnonzero(count > LISTED)
    crowded = np.unique(of[head[dense]])
    apart = ~np.isin(cluster[listed // n], crowded) if len(listed) else np.zeros(0, bool)
    yield listed[apart] // n, listed[apart] % n, times[apart]
    for c in crowded.tolist():
        low, high = np.searchsorted(cluster, [c, c + 1])
        size = high - low
        runs = dense[of[head[dense]] == c]
        both = np.zeros((size, size), np.float32)
        for k in range(0, len(runs), 1024):
            part = runs[k : k + 1024]
            length = count[part]
            places = np.repeat(head[part] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            held = np.zeros((size, len(part)), np.float32)
            held[owner[places] - low, np.repeat(np.arange(len(part)), length)] = 1
            both += held @ held.T
        inside = cluster[listed // n] == c
        both[listed[inside] // n - low, listed[inside] % n - low] += times[inside]
        i, j = np.nonzero(np.triu(both, 1))
        yield i + low, j + low, both[i, j].astype(np.int64)


def _verify(table: pa.Table) -> pa.Table:
    """One tile: an edge a, b for each document but the first of those that links of the tile join."""
    cluster = table.column("cluster").to_numpy()
    table = table.take(pa.array(np.argsort(cluster, kind="stable")))
    doc, cluster, block = (table.column(c).to_numpy() for c in ("doc", "cluster", "block"))
    members = table.column("members").combine_chunks()
    size = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value, owner = members.flatten().to_numpy(), np.repeat(np.arange(len(doc)), size)
    _, cluster = np.unique(cluster, return_inverse=True)
    label = np.arange(len(doc))
    ends = []
    across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
    for a, b, common in common_pairs(cluster, value, owner, len(doc)):
        linked = UNDER * common >= OVER * (size[a] + size[b] - common)
        if across:  # pairs within a block belong to the tile of that block alone
            linked &= block[a] != block[b]
        ends.append((a[linked], b[linked]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(doc)))
    release()
    return pa.table([doc[label[moved]], doc[moved]], names=["a", "b"])


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``ids`` by doc_id; few ids are broadcast."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(ids, "doc_id", how)


def _links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Edges a, b between documents that join the same components as all links do."""
    tiled = _tiled(found, _clusters(found))
    total = found.where("must = -1").agg(F.sum("value")).first()[0] or 0
    groups = max(16, -(-int(total) // TILE_SHINGLES))
    sets = _only(docs, tiled.withColumnRenamed("doc", "doc_id"), "inner").mapInArrow(_set_rows, "doc long, cluster long, blocks int, block int, members array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select(
        F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(groups))).alias("tile"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc", "cluster", "block", "members",
    )
    return dealt.groupBy("tile", "low", "high").applyInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = every.where("doc_id is not null")
    hashed = known.select("doc_id", F.md5("text").alias("digest"))
    classes = checkpointed(hashed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = checkpointed(hashed.join(classes, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    copies = members.where("doc_id <> rep").select("doc_id").distinct()
    mixed = members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).where("own").select("doc_id")
    reps = _only(known, checkpointed(copies.join(mixed, "doc_id", "left_anti")), "left_anti")
    several = checkpointed(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b"))

    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, -(-int(size) // BUCKET_BYTES))
    found = checkpointed(reps.mapInArrow(_pack(n_buckets), PACKED).groupBy("bucket").applyInArrow(_meet, FOUND))
    links = _links(reps, found)
    if not several.isEmpty():  # an id with several texts joins their classes
        own = members.join(several.select("doc_id"), "doc_id")
        links = links.unionByName(own.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links)

    sizes = found.where("must = -1").groupBy(F.col("doc").alias("rep")).agg(F.max("value").alias("n_shingles"))
    named = checkpointed(sizes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left"))
    out = members.join(named, "rep", "left")
    n = F.coalesce("n_shingles", F.lit(0)).cast("long")
    out = out.select("doc_id", n.alias("n_shingles"), F.when(n == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
    return out.unionByName(every.where("doc_id is null").mapInArrow(_sizes, out.schema))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the smallest doc_id's, with its least text where that id repeats; rows without a key stay."""
    found = near_duplicates(docs, key, text)
    gone = checkpointed(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    left = docs.join(gone, key, "left_anti")
    again = checkpointed(left.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return left
    one = left.join(again, key).groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct(F.coalesce(text, F.lit("")))).alias("row")).select("row.*")
    return left.join(again, key, "left_anti").unionByName(one)
