"""Substring deduplication: words covered by a window of words that also starts earlier go.

Difference cover. Modulo 13, every distance is a difference of two of {0, 1, 3, 9}. So of two
equal runs of 20 words, wherever they start, some offset under 13 is at a cover position in
both, and the 8 words from there are an anchor that both share. Only anchors at cover
positions are hashed and shuffled, 4 of 13. Anchors that occur once are done with; around
the others the match extends: the windows of 20 words that hold such an anchor at an offset
under 13 are hashed (128 bits), and all but the first of equal ones cover words that go.

Equal anchors or windows of one flush are settled where they are read, and one of them goes on; so a
passage that a third of all texts hold sends one row a flush. A text meets its positions
by a join on its id, and is shuffled once for that.

Defined results: null and empty texts have no words; shorter texts than a window keep all; a null
id comes before all others; rows with one id are one document (a window starts earlier by
id, then place), repeated rows are judged alike and do not remove each other. Other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, text_pieces, unzipped, zipped, zipped_pieces
from .packing import buckets, packed, schema, unpacked, whole
from .textvec import WORD_BASE_2, windows, words_of

WINDOW = 20
#: Period and cover: each distance modulo the period is the difference of two members.
PERIODS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 3: (0, 1)}
CHUNK, FLUSH, FLUSH_WINDOWS = 1 << 20, 1 << 18, 1 << 17
NULL_ID = -(1 << 63)


def cover(window: int) -> tuple[int, np.ndarray]:
    """The period for a window's size, and which remainders are in the cover; an anchor has window + 1 - period words."""
    period = next((p for p in (13, 7, 3) if window >= p + 4), 1)
    member = np.zeros(period, bool)
    member[list(PERIODS.get(period, (0,)))] = True
    return period, member


def places(bounds: np.ndarray) -> np.ndarray:
    """Each word's place in its text."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors at cover positions of texts that have a window."""
    period, member = cover(window)
    size = window + 1 - period
    w = words_of(texts)
    n = np.diff(w.bounds)
    if not len(w.hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    place, owner = places(w.bounds), w.owner()
    at = np.flatnonzero(member[place % period] & (place + size <= n[owner]) & (n[owner] >= window))
    return owner[at], place[at], windows(w.hashes, size)[at] if len(w.hashes) >= size else np.empty(0, np.uint64)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def candidates(docs: DataFrame, window: int) -> DataFrame:
    """(_id, place) of anchors that occur more than once, of docs (_id, _text)."""
    n = buckets(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, place, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            ids, place, h = ids[order], place[order], h[order]
            first = _first(h)
            number = np.diff(np.r_[np.flatnonzero(first), len(h)])
            bucket = (h % np.uint64(n)).astype(np.int32)
            known = ~first | np.repeat(number > 1, number)
            # one of each goes on, by 40 more bits of the hash; those equal to others here are known
            rest = (h // np.uint64(n))[first]
            yield packed(bucket[first], [ids[first], place[first].astype(np.uint32), rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)], 0)
            if known.any():
                yield packed(bucket[known], [ids[known], place[known].astype(np.uint32), None, None], 1)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, z, texts in text_pieces(b.column(1), CHUNK):
                owner, place, h = anchors(texts, window)
                held.append((ids[a:z][owner], place, h))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), (ids, place, low, high) in whole(unpacked(batches, (np.int64, np.uint32, np.uint32, np.uint8), 2)):
            if kind == 0:
                h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
                order = np.argsort(h, kind="stable")
                first = _first(h[order])
                number = np.diff(np.r_[np.flatnonzero(first), len(h)])
                at = order[np.repeat(number > 1, number)]
                ids, place = ids[at], place[at]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place.astype(np.int32))], names=["_id", "place"])

    dealt = docs.select("_id", "_text").mapInArrow(deal, schema(4, ("bucket", "kind")))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(match, "_id long, place int")


def repeats(with_places: DataFrame, window: int) -> DataFrame:
    """(_id, _th, start) of the windows that also start earlier, of rows (_id, _text, _places, _th) and any others,
    texts zipped.

    Windows are told apart by 96 bits, texts of one id by 31 (_th; 0 if there is one text).
    """
    n = buckets(with_places.sparkSession)
    period, _ = cover(window)

    def settle(ids: np.ndarray, th: np.ndarray, start: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order, which are the first of their hash, and which start later than that."""
        order = np.lexsort((start, ids, h2, h1))
        first = _first(h1[order], h2[order])
        at = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
        later = (ids[order] != ids[order][at]) | (start[order] != start[order][at])
        return order, first, later

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order, first, later = settle(*columns)
            columns = [x[order] for x in columns]
            # copies of a row tie with the first; all that tie go on, as a smaller one may come from elsewhere
            on = first | ~later
            yield packed((columns[3][on] % np.uint64(n)).astype(np.int32), [x[on] for x in columns], 0)
            if later.any():
                ids = columns[0][later]
                yield packed((ids % n).astype(np.int32), [ids, columns[1][later], columns[2][later], None, None], 1)

        for b in batches:
            ids, th = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_id", "_th"))
            known = b.column(b.schema.get_field_index("_places"))
            for a, z, texts in zipped_pieces(b.column(b.schema.get_field_index("_text")), CHUNK):
                w = words_of(texts)
                number = np.diff(w.bounds)
                marked = np.zeros(len(w.hashes) + 1, np.int64)  # +1 where a candidate window may start, -1 after
                for i, p in enumerate(known.slice(a, z - a)):
                    p = np.unique(p.values.to_numpy().astype(np.int64))
                    last = number[i] - window
                    p = p[p - period + 1 <= last]
                    if len(p) and last >= 0:
                        np.add.at(marked, w.bounds[i] + np.maximum(p - period + 1, 0), 1)
                        np.add.at(marked, w.bounds[i] + np.minimum(p, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
                if len(at):
                    owner, place = w.owner()[at], places(w.bounds)[at]
                    held.append((ids[a:z][owner], th[a:z][owner], place.astype(np.int32), windows(w.hashes, window)[at], windows(w.hashes, window, WORD_BASE_2)[at].astype(np.uint32)))
                if sum(len(x[0]) for x in held) >= FLUSH_WINDOWS:
                    yield from flush()
        if held:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), (ids, th, start, h1, h2) in whole(unpacked(batches, (np.int64, np.int32, np.int32, np.uint64, np.uint32), 2)):
            if kind == 0:
                order, _, later = settle(ids, th, start, h1, h2)
                ids, th, start = (x[order[later]] for x in (ids, th, start))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(th), pa.array(start)], names=["_id", "_th", "start"])

    dealt = with_places.mapInArrow(deal, schema(5, ("bucket", "kind")))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(match, "_id long, _th int, start int")


def kept_words(text: bytes, starts: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all words; words are split at \\x20 and \\x09 to \\x0D."""
    words = text.split()
    if not len(starts):
        return words, len(words)
    marked = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    marked[starts] += 1
    np.add.at(marked, starts + window, -1)
    stay = np.flatnonzero(np.cumsum(marked[:-1]) == 0)
    return [words[i] for i in stay.tolist()], len(words)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Every row with its text replaced by the words that stay, joined by a blank, and n_words and n_removed.

    A text that loses no word, or is null, stays as it is. With digest, kept_sha256 (of the
    words that stay, joined by a blank, in any case) instead of the text.
    """
    added = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256" if digest else text, "string", pa.string())]
    kept = [c for c in df.columns if c != text and c not in {n for n, *_ in added}]
    string = F.col(f"`{text}`").cast("string")
    small_batches(df)
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("_id"), string.alias("_text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)))
    found = candidates(docs, window).groupBy("_id").agg(F.collect_set("place").alias("_places"))
    twice = docs.groupBy("_id").count().where("count > 1").select("_id", F.lit(True).alias("_twice"))
    found = found.join(twice, "_id", "left")
    docs = zipped(docs.withColumn("_hash", F.xxhash64("_text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))).where("_id IS NOT NULL")
    # both joins take the same rows and columns of docs by _id, so that the texts are shuffled once and read twice
    own = F.when(F.col("_twice"), F.col("_hash")).otherwise(F.lit(0))
    removed = repeats(docs.join(found, "_id").withColumn("_th", own), window).groupBy("_id", "_th").agg(F.collect_set("start").alias("_starts"))
    removed = removed.groupBy("_id").agg(F.collect_list(F.struct("_th", "_starts")).alias("_removed"))  # one, unless an id has several texts
    mine = F.filter("_removed", lambda x: (x["_th"] == 0) | (x["_th"] == F.col("_hash")))
    joined = docs.join(removed, "_id", "left").withColumn("_starts", F.flatten(F.transform(mine, lambda x: x["_starts"])))
    rows = joined.select(*(f"_c{i}" for i in range(len(kept))), "_text", "_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, starts in zip(unzipped(b.column(len(kept))), b.column(len(kept) + 1), strict=True):
                words, number = kept_words(t or b"", np.array(starts.as_py() or (), np.int64), window)
                joined = b" ".join(words)
                out.append((number, number - len(words), hashlib.sha256(joined).hexdigest() if digest else None if t is None else joined.decode() if len(words) < number else t.decode()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *(pa.array([x[i] for x in out], kind) for i, (_, _, kind) in enumerate(added))], names=[*(f"_c{i}" for i in range(len(kept))), *(n for n, *_ in added)])

    out = rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]), *(f"`{n}` {t}" for n, t, _ in added)]))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"`{n}`") for n, *_ in added))


#: The words as they are, windows of WINDOW of them by first word, all but the first of equal ones.
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, i, hash(ws[i:i + {WINDOW - 1}]) AS h1, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h2
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(0, {WINDOW})) AS o)),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.i) AS kept FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
