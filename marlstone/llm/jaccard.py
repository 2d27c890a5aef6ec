"""N-gram Jaccard join by parity sketches.

A text's set is its distinct shingles of words. A sketch has 64 bits for each of several parts;
a shingle flips one bit of one part, both chosen by its hash. Two sketches differ in at most as many
bits, and so in at most as many parts, as the sets differ in shingles. If sets of a and b
shingles are to reach the similarity s, they differ in at most (1 - s) / s of the smaller; with more parts than
that, some part is equal. Sizes fall into bands; a band's number of parts follows from its
largest size, and a text is also sketched for the band below if its size may meet texts of that.

Of its parts a text gives only those of the highest rank, by shingles in the part and by content, one more than may
differ for its own size. Rank is a matter of a part's content alone. If two texts are similar, their equal parts are
more than either leaves out; so the highest of the equal parts is given by both. Parts with few shingles, which
unrelated texts share most, are left out first.

Join and verification. Texts with an equal part of a band are tied to the smallest id that has
it; so two similar texts are in the group of one leader. Whole sketches, with 4 to 8 bits a shingle,
part a group first: where their distance already exceeds what the similarity allows, a pair is out, and
a text that no other can be similar to leaves. What is left is verified on whole sets, in blocks of a bounded number of shingles, each pair of blocks in a task of its own,
and pairs that links already join are not compared again. Links and links of equal
sets make the components.

Defined results: words are lower-cased (A-Z) runs outside \\x20 and \\x09-\\x0D; a text with fewer words
than a shingle has the whole sequence as its one shingle; texts without words have an empty set and
no links, like null ones; rows with one id are one document, with all their texts; a null id
comes before all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, free, small_batches, text_pieces, tidy, unzipped, zipped
from .components import components
from .packing import buckets, packed, schema, unpacked
from .textvec import FOLDED_VALUES, SPACE, WORD_BASE, WORD_BASE_2, mix, windows, words_of

#: Ratio of the sizes at a band's ends; parts beyond those that may differ, as a part of them, among which texts choose.
RATIO, SPARE = 1.55, 0.3
CHUNK, FLUSH = 1 << 20, 1 << 17
#: Shingles in a block that is verified together, and texts in it.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 1024
NULL_ID = -(1 << 63)
U = np.uint64


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, in order of both."""
    w = words_of(texts, SPACE, FOLDED_VALUES)
    number, owner = np.diff(w.bounds), w.owner()
    place = np.arange(len(owner)) - np.repeat(w.bounds[:-1], number)
    at = np.flatnonzero(place + n <= number[owner])
    hashes, texts_at = windows(w.hashes, n)[at] if len(at) else np.empty(0, U), owner[at]
    for size in range(1, n):  # the whole of shorter texts
        few = np.flatnonzero(number == size)
        if len(few):
            hashes = np.r_[hashes, windows(w.hashes, size)[w.bounds[few]] + U(size)]
            texts_at = np.r_[texts_at, few]
    order = np.lexsort((hashes, texts_at))
    hashes, texts_at = hashes[order], texts_at[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts_at[1:] != texts_at[:-1])
    return texts_at[new], hashes[new]


class Bands:
    """Sizes' bands, and how many shingles may differ in each, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent, edges = percent, [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.floor(edges[-1] * RATIO)))
        self.low = np.array(edges, np.int64)  # least size of each band
        differ = [(hi - 1) * (100 - percent) // percent for hi in edges[1:]]
        self.differ = np.array([*differ, differ[-1]], np.int64)
        self.parts = self.differ + 1 + np.ceil(self.differ * SPARE).astype(np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def also_below(self, size: np.ndarray) -> np.ndarray:
        """Whether texts of this size may be similar to some in the band below (percent * size <= 100 * largest size there)."""
        band = self.of(size)
        return (band > 0) & (self.percent * size <= 100 * (self.low[band] - 1))


def signatures(owner: np.ndarray, hashes: np.ndarray, count: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the sketches' parts; owner in order."""
    size = np.bincount(owner, minlength=count)
    out_text, out_key = [], []
    for below in (False, True):
        chosen = (size > 0) & (bands.also_below(np.maximum(size, 1)) if below else True)
        own = np.flatnonzero(chosen)
        if not len(own):
            continue
        band = bands.of(size[own]) - below
        parts = bands.parts[band]
        first = np.cumsum(parts) - parts  # each text's first part
        number = np.full(count, -1)
        number[own] = np.arange(len(own))
        at = number[owner]
        h = hashes[at >= 0]
        at = at[at >= 0]
        salted = mix(h ^ (band[at].astype(U) + U(1)) * U(WORD_BASE))
        cell = first[at] + ((salted >> U(32)) * parts[at].astype(U) >> U(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cells, salted, h = cell[order], salted[order], h[order]
        start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        bits = np.bitwise_xor.reduceat(U(1) << (salted & U(63)), start)  # the part's parities
        strong = np.bitwise_xor.reduceat(mix(h + U(WORD_BASE_2)), start)  # and of the hashes' bits, which equal parts share as well
        content, number = np.zeros(int(parts.sum()), U), np.zeros(int(parts.sum()), np.int64)
        content[cells[start]] = mix(strong ^ mix(bits))
        number[cells[start]] = np.diff(np.r_[start, len(cells)])
        text = np.repeat(np.arange(len(own)), parts)
        key = mix(content + mix((band[text].astype(U) << U(40)) + (np.arange(len(text)) - first[text]).astype(U)))
        # the parts of highest rank, by shingles and key: one more than may differ
        order = np.lexsort((key, -number, text))
        rank = np.arange(len(text)) - first[text[order]]
        taken = order[rank <= size[own][text[order]] * (100 - bands.percent) // bands.percent]
        out_text.append(own[text[taken]])
        out_key.append(key[taken])
    if not out_text:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(out_text), np.concatenate(out_key)


def fingerprints(owner: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each text's set, and 128 bits that equal sets share."""
    size = np.bincount(owner, minlength=count)
    h1, h2 = np.zeros(count, U), np.zeros(count, U)
    if len(owner):
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        h1[owner[start]] = np.add.reduceat(mix(hashes), start)
        h2[owner[start]] = np.add.reduceat(mix(hashes * U(WORD_BASE_2) + U(1)), start)
    return size, h1, h2


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's whole sketch: a power of two, 4 to 8 for each shingle."""
    return np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(size, 1) * 4)).astype(np.int64)))


def sketches(owner: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole sketches one after the other, as bytes, and where each text's begins (in bytes)."""
    bits = np.where(size > 0, sketch_bits(size), 0)
    start = np.cumsum(bits) - bits
    at = start[owner] + (mix(hashes ^ U(WORD_BASE_2)) & (bits[owner] - 1).astype(U)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1), np.r_[start, bits.sum()] // 8


def folded(sketch: bytes, bits: int) -> np.ndarray:
    """The sketch of so many bits that the same set has: halves of a longer one, added."""
    x = np.frombuffer(sketch, U)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _allowed(x: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of rows, whether their sketches differ in no more bits than sets of that similarity can."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 22) // x.shape[1])
    for a in range(0, len(i), step):
        own, other = i[a : a + step], j[a : a + step]
        differ = np.bitwise_count(x[own] ^ x[other]).sum(1, dtype=np.int64)
        out[a : a + step] = ((100 + percent) * differ <= (100 - percent) * (size[own] + size[other])) & (100 * np.minimum(size[own], size[other]) >= percent * np.maximum(size[own], size[other]))
    return out


def _keyed(x: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the sketches' own parts, for the pigeonhole principle once more: rows that may be joined share a key."""
    bits = x.shape[1] * 64
    most = int(size.max()) * (100 - percent) // percent
    parts = min(bits, most + 1 + math.ceil(most * SPARE))
    starts = np.arange(parts) * bits // parts
    weights = mix(np.arange(1, bits + 1, dtype=U) * U(WORD_BASE))
    keys = np.empty((len(x), parts), U)
    step = max(1, (1 << 21) // bits)
    for a in range(0, len(x), step):
        on = np.unpackbits(x[a : a + step].view(np.uint8), axis=1, bitorder="little")
        keys[a : a + step] = np.bitwise_xor.reduceat(np.where(on, weights, U(0)), starts, axis=1)
    empty = keys == 0
    # an empty part says nothing while there are fewer of them than parts that must agree
    used = ~empty | (empty.sum(1) >= parts - most)[:, None]
    keys = mix(keys + np.arange(parts, dtype=U) * U(WORD_BASE_2))
    row, part = np.nonzero(used)
    return keys[row, part], row


def parted(ids: np.ndarray, size: np.ndarray, held: list[bytes], percent: int) -> np.ndarray:
    """The smallest id of each row's part, parts being joined by pairs whose sketches allow the similarity; own id if alone.

    Sets that are similar differ in at most (1 - s) / (1 + s) of the sum of their sizes, and so do sketches
    in bits. Of many rows, only those are compared that share a part of their sketches.
    """
    bits = int(sketch_bits(size).min())
    x = np.stack([folded(h, bits) for h in held])
    root = np.unique(ids, return_index=True)[1][np.unique(ids, return_inverse=True)[1]]  # rows of one id are one

    members = {r: np.flatnonzero(root == r).tolist() for r in np.flatnonzero(np.bincount(root) > 1).tolist()}

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = int(root[a]), int(root[b])
            if a != b:  # the smaller part takes the larger one's root
                own, other = members.pop(a, [a]), members.pop(b, [b])
                if len(own) < len(other):
                    a, own, other = b, other, own
                root[other] = a
                own += other
                members[a] = own

    def compare(rows: np.ndarray) -> None:
        """Join all of some rows that sketches allow: each, by size, against those up to the largest size that it may meet."""
        rows = rows[np.argsort(size[rows], kind="stable")]
        ends = np.searchsorted(size[rows] * percent, size[rows] * 100, side="right")
        for at, end in enumerate(ends.tolist()):
            others = rows[at + 1 : end]
            apart = others[root[others] != root[rows[at]]]
            if len(apart):
                near = apart[_allowed(x, size, np.full(len(apart), rows[at]), apart, percent)]
                join(np.full(len(near), rows[at]), near)

    if len(ids) <= FEW:
        compare(np.arange(len(ids)))
    else:
        key, row = _keyed(x, size, percent)
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        number = np.diff(np.r_[start, len(key)])
        if (number.astype(float) ** 2).sum() >= float(len(ids)) ** 2:  # the parts are shared by too many: all pairs are fewer
            compare(np.arange(len(ids)))
        else:
            pairs = [np.empty(0, np.int64)]
            for n in range(2, FEW + 1):  # groups of n rows: all their pairs, each compared once
                at = start[number == n]
                i, j = np.triu_indices(n, 1)
                if len(at):
                    pairs.append((row[at[:, None] + i] * len(ids) + row[at[:, None] + j]).ravel())
            for a, n in zip(start[number > FEW].tolist(), number[number > FEW].tolist(), strict=True):
                own = row[a : a + n]
                if (root[own] != root[own[0]]).any():
                    compare(own)
            i, j = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            near = _allowed(x, size, i, j, percent)
            join(i[near], j[near])
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return low[root]


SETS, TIES, SKETCHES = 0, 1, 2
#: A leader's ties are parted by their sketches up to so many shingles in all; of more, all stay. Up to FEW rows are compared pair by pair.
PARTED, FEW = 1 << 26, 16


def tied(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (kind, a, b, c, d, e) of docs (_id, _text): SETS with id, size and fingerprint; TIES with member and leader; SKETCHES with id, size and sketch."""
    spread = buckets(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sets: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if sets:
                ids, size, h1, h2 = (np.concatenate(x) for x in zip(*sets, strict=True))
                sets.clear()
                yield packed((h1 % U(spread)).astype(np.int32), [ids.view(U), size.astype(U), h1, h2], 0)
            if held:
                ids, key = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                seen.clear()
                if not len(ids):
                    return
                order = np.lexsort((ids, key))
                ids, key = ids[order], key[order]
                first = np.r_[True, key[1:] != key[:-1]]
                bucket = (key % U(spread)).astype(np.int32)
                for kind, at in ((1, np.flatnonzero(first)), (2, np.flatnonzero(~first))):  # a key's smallest id here, then the others
                    if len(at):
                        yield packed(bucket[at], [ids[at].view(U), key[at], None, None], kind)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, z, texts in text_pieces(b.column(1), CHUNK):
                owner, hashes = shingles(texts, n)
                size, h1, h2 = fingerprints(owner, hashes, z - a)
                sets.append((ids[a:z], size, h1, h2))
                fresh = np.zeros(z - a, bool)  # of equal sets, one in a flush
                for i, x in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                at = fresh[owner]
                text, key = signatures(owner[at], hashes[at], z - a, bands)
                some = np.flatnonzero(fresh)
                number = np.cumsum(fresh) - 1
                whole, start = sketches(number[owner[at]], hashes[at], size[some])
                if len(some):
                    own = ids[a:z][some]
                    columns = [np.full(len(some), 3, np.int32), own, size[some].astype(np.int64)]
                    cells = [pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in columns[1:]]
                    cells.append(pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(whole)]))
                    yield pa.RecordBatch.from_arrays([pa.array((own % spread).astype(np.int32)), pa.array(columns[0]), *cells, pa.array([b""] * len(some), pa.binary())], names=["bucket", "kind", "c0", "c1", "c2", "c3"])
                held.append((ids[a:z][text], key))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        columns = tuple(x.view(np.int64) for x in columns)
        columns += (np.zeros(len(columns[0]), np.int64),) * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns), pa.nulls(len(columns[0]), pa.binary())], names=["kind", *"abcde"])

    def ties(ids: np.ndarray, leaders: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(ids != leaders)
        if len(at):
            pairs = np.unique(np.stack([ids[at], leaders[at]], 1), axis=0)
            yield out(TIES, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, leaders, held = -1, np.empty(0, U), np.empty(0, np.int64), []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal keys, leaders, held
            if held:
                ids, key = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                order = np.lexsort((ids, key))
                ids, key = ids[order], key[order]
                first = np.r_[True, key[1:] != key[:-1]]
                keys, leaders = key[first], ids[first]
                yield from ties(ids, leaders[np.cumsum(first) - 1])

        for (bucket, kind), (a, b, c, d) in unpacked(batches, (U, U, U, U), 2):
            if kind == 3:  # c holds the sketches one after the other
                size = b.view(np.int64)
                ends = np.cumsum(sketch_bits(size)) // 8
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(c)])
                zero = pa.array(np.zeros(len(size), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), SKETCHES, np.int32)), pa.array(a.view(np.int64)), pa.array(size), zero, zero, blob], names=["kind", *"abcde"])
                continue
            if bucket != own:
                yield from settle()
                own, keys, leaders = bucket, np.empty(0, U), np.empty(0, np.int64)
            if kind == 0:
                yield out(SETS, a, b, c, d)
            elif kind == 1:
                held.append((a.view(np.int64), b))
            else:
                yield from settle()
                yield from ties(a.view(np.int64), leaders[np.searchsorted(keys, b)])
        yield from settle()

    dealt = docs.select("_id", "_text").mapInArrow(deal, schema(4, ("bucket", "kind")))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(match, "kind int, a long, b long, c long, d long, e binary")


def verified(ids: np.ndarray, texts: list[bytes], side: np.ndarray, leader: int, n: int, percent: int) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) that join all similar texts of a group; side: 0 and 1 where only pairs across are asked for, else 0.

    Pairs that the links found so far join are not compared.
    """
    owner, hashes = shingles(texts, n)
    size = np.bincount(owner, minlength=len(texts))
    _, flat = np.unique(hashes, return_inverse=True)
    start = np.cumsum(size) - size
    root = np.arange(len(texts))
    same: dict[int, int] = {}
    for i, x in enumerate(ids.tolist()):  # rows of one id are one document
        root[i] = same.setdefault(x, i)
    across = bool(side.any())
    mask = np.zeros(len(hashes) + 1, bool)
    links: list[tuple[int, int]] = []
    order = np.lexsort((np.arange(len(ids)), ids, ids != leader))
    for p in order.tolist():
        if not size[p] or across and side[p] == 1 and ids[p] != leader:
            continue
        at = np.flatnonzero((root != root[p]) & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p])) & (size > 0) & ((side == 1) | (ids[p] == leader) if across else True))
        if not len(at):
            continue
        own = flat[start[p] : start[p] + size[p]]
        mask[own] = True
        sizes = size[at]
        place = np.repeat(start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(mask[flat[place]].astype(np.int64), np.cumsum(sizes) - sizes)
        mask[own] = False
        for q in at[100 * common >= percent * (size[p] + sizes - common)].tolist():
            if root[q] != root[p]:
                root[root == root[q]] = root[p]
                links.append((max(int(ids[p]), int(ids[q])), min(int(ids[p]), int(ids[q]))))
    return links


def parted_ties(found: DataFrame, percent: int) -> DataFrame:
    """(_id, leader): ties whose sketches allow the similarity, directly or over others of the leader's group."""
    ties = found.where(F.col("kind") == TIES).select(F.col("a").alias("_id"), F.col("b").alias("leader")).distinct()
    sizes = found.where(F.col("kind") == SETS).groupBy(F.col("a").alias("leader")).agg(F.max("b").alias("size"))
    number = ties.groupBy("leader").agg(F.count("*").alias("members")).join(sizes, "leader").select("leader", (F.col("members") * F.col("size") <= PARTED).alias("held"))
    both = ties.unionAll(number.where("held").select(F.col("leader").alias("_id"), "leader")).join(number, "leader")
    some = both.where("held").select("_id", "leader")
    rows = some.join(found.where(F.col("kind") == SKETCHES).select(F.col("a").alias("_id"), F.col("b").alias("size"), F.col("e").alias("sketch")), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        held: list[tuple[int, int, bytes]] = []

        def close() -> Iterator[pa.RecordBatch]:
            ids, size = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            low = parted(ids, size, [x[2] for x in held], percent)
            at = np.flatnonzero(low != ids)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(low[at])], names=["_id", "leader"])

        for b in batches:
            for leader, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if leader != last:
                    if held:
                        yield from close()
                    last, held = leader, []
                held.append(tuple(row))
        if held:
            yield from close()
        tidy()

    near = rows.select("leader", "_id", "size", "sketch").repartition("leader").sortWithinPartitions("leader", "_id").mapInArrow(run, "_id long, leader long")
    return near.unionAll(both.where("NOT held").select("_id", "leader")).distinct()


def links_of(docs: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between texts with different sets, enough for the components, of docs (_id, _text) and tied()'s rows."""
    sizes = found.where(F.col("kind") == SETS).groupBy(F.col("a").alias("leader")).agg(F.max("b").alias("size"))
    ties = checkpointed(parted_ties(found, percent))
    number = ties.groupBy("leader").agg((F.count("*") + 1).alias("members")).join(sizes, "leader")
    most = F.greatest(F.lit(2), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("size")).cast("int")))
    number = checkpointed(number.select("leader", F.ceil(F.col("members") / most).cast("int").alias("blocks")))
    members = ties.unionAll(number.select(F.col("leader").alias("_id"), "leader")).join(number, "leader")
    own = F.when(F.col("_id") == F.col("leader"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_id"), F.col("blocks").cast("long")).cast("int"))
    # block i meets each block j >= i; the leader is in all tasks
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.col("_own").alias("own"))
    at = F.when(
        F.col("_own") < 0, F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j >= i), lambda j: pair(i, j))))
    ).otherwise(F.transform(every, lambda j: pair(F.least(j, F.col("_own")), F.greatest(j, F.col("_own")))))
    rows = members.withColumn("_own", own).withColumn("_at", F.explode(at)).select("_id", "leader", "_at.*")
    rows = rows.join(zipped(docs.select("_id", "_text")), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        held: list[tuple[int, int, bytes]] = []

        def close() -> Iterator[pa.RecordBatch]:
            leader, i, j = last
            ids = np.array([x[0] for x in held], np.int64)
            side = np.array([int(i != j and x[1] == j) for x in held])
            if found := verified(ids, [x[2] or b"" for x in held], side, leader, n, percent):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            ids, leaders, i, j, own = (b.column(k).to_pylist() for k in range(5))
            for row in zip(ids, leaders, i, j, own, unzipped(b.column(5)), strict=True):
                if row[1:4] != last:
                    if last is not None:
                        yield from close()
                    last, held = row[1:4], []
                held.append((row[0], row[4], row[5]))
        if last is not None:
            yield from close()
        tidy()

    return rows.select("_id", "leader", "i", "j", "own", "_text").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "_id").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(_id, n_shingles, component): a row for each row of df, its set's size, and the smallest id that links reach."""
    small_batches(df)
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = checkpointed(tied(docs, n, percent))
    sets = found.where(F.col("kind") == SETS).select(F.col("a").alias("_id"), F.col("b").alias("n_shingles"), "c", "d")
    first = sets.where("n_shingles > 0").groupBy("n_shingles", "c", "d").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last")
    equal = sets.join(first, ["n_shingles", "c", "d"]).select(F.col("_id").alias("a"), F.col("first").alias("b"))
    linked = components(equal.unionAll(links_of(docs, found, n, percent)))
    return sets.join(linked, sets["_id"] == linked["node"], "left").select("_id", "n_shingles", F.coalesce("component", "_id").alias("component"))


def components_of(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id (the key), n_shingles and component_id of every row."""
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return classes(df, key, text, n, percent).select(real("_id").alias(key), "n_shingles", real("component").alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that of the smallest id, with the columns as they are; repeated rows of an id count as one."""
    out = classes(df, key, text, n, percent)
    own = free(df, "_id")
    gone = out.where("_id <> component").select(F.col("_id").alias(own)).distinct()
    rows = df.withColumn(own, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID))).join(gone, own, "left_anti")
    return rows.select(*(F.col(f"`{c}`") for c in df.columns))


def oracle(n: int = 4, percent: int = 85) -> str:
    """Shingles as strings, all pairs that share one, and components by a recursive query."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce({lowered}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + {n - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5_number(string_agg(h::VARCHAR, ',' ORDER BY h)) AS all_h FROM s GROUP BY doc_id),
g AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY all_h) AS rep, n FROM c),
r AS MATERIALIZED (SELECT s.doc_id, s.h, g.n FROM s JOIN g ON s.doc_id = g.doc_id WHERE g.rep = g.doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.h = y.h AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
t AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT t.node, e.b FROM t JOIN e ON t.reach = e.a),
k AS (SELECT node, min(reach) AS low FROM t GROUP BY node)
SELECT w.doc_id, coalesce(g.n, 0)::BIGINT AS n_shingles, coalesce(k.low, g.rep, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN k ON k.node = g.rep"""
