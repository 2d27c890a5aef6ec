"""Benchmark decontamination: training passages query a BM25 index of the test items.

A document is cut into overlapping passages of twice the longest item's words, so that every
stretch as long as an item lies in one of them. Each passage is a query; weights of an
item's terms are divided by the item's score for its own text, so that a score is the part
of the item that the passage holds. Retrieval is by upper bounds: over blocks of items, for
many passages at once, the blocks' largest weights of a passage's rarer terms and the
largest weights of its common ones bound what any item of the block can score; passages
and blocks below the threshold end there, and items of the rest whose own weights of the
rarer terms leave them below it. Where the common terms alone may reach the threshold, an
item needs no rarer one: the blocks' largest weights of all terms open blocks there. For
the passages that remain, block-max WAND walks the postings, item by item. All items at or above the threshold are then verified: both the question and the
answer of the item must overlap the passage in runs of three words, a part of one or two
words as a whole.

The index is broadcast in parts of a fixed number of bytes of item text; with more items,
there is one pass for each part. Numbers of items and of those with a term, lengths and
passages are those of all items in each part, so that scores do not depend on the parts.

Defined results: null or empty texts and items match nothing; words are runs of ASCII letters
and digits and of other characters beyond ASCII, A-Z lower-cased; repeated rows are judged
alike, and items with the same text each are found; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free, small_batches, text_pieces
from .textvec import FOLDED_VALUES, NOT_ALNUM, Words, windows, words_of

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, RUN = 0.5, 0.5, 3
#: Items in a block; of the items, the part beyond which a term is common; bytes of item text in an index.
BLOCK, COMMON, PART_BYTES = 8, 0.2, 8 << 20
CHUNK, LEAST_PASSAGE, LEAST_ANSWER = 1 << 20, 32, 6


class Whole(NamedTuple):
    """What an index needs to know of all items, those of other parts too."""

    items: int
    words: int
    longest: int
    terms: np.ndarray  # sorted
    df: np.ndarray


class Index(NamedTuple):
    items: np.ndarray  # ids
    terms: np.ndarray  # hashes, sorted
    first: np.ndarray  # postings of term t: first[t] .. first[t + 1]
    item: np.ndarray
    weight: np.ndarray
    block_first: np.ndarray  # the same by block of items, with the largest weights
    block: np.ndarray
    block_weight: np.ndarray
    largest: np.ndarray  # of a term
    common: np.ndarray
    filter: np.ndarray  # by the top bits of a hash: whether a term may have it
    question: list[np.ndarray]
    answer: list[np.ndarray]
    passage: int  # words


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer: at the last question mark, else before the last sentence if it is
    LEAST_ANSWER words and a fifth to a half of them all, else at two thirds of the words."""
    if len(text[: (at := text.rfind("?") + 1)].split()) >= RUN and len(text[at:].split()) >= RUN:
        return text[:at], text[at:]
    words = text.split()
    ends = [m.end() for m in re.finditer(r"[.!?\n](?=\s)", text.strip())]
    if ends and max(LEAST_ANSWER, len(words) // 5) <= len(text.strip()[ends[-1] :].split()) <= len(words) // 2:
        return text.strip()[: ends[-1]], text.strip()[ends[-1] :]
    cut = min(len(words) * 2 // 3, max(0, len(words) - LEAST_ANSWER))
    return " ".join(words[:cut]), " ".join(words[cut:])


def folded(texts: list[bytes]) -> Words:
    return words_of(texts, NOT_ALNUM, FOLDED_VALUES)


def runs(hashes: np.ndarray) -> np.ndarray:
    """The distinct runs of RUN words, of all words if there are fewer."""
    return np.unique(windows(hashes, min(RUN, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def measured(rows: list[tuple[int, str]]) -> Whole:
    words = folded([t.encode() for _, t in rows if t])
    lengths = np.diff(words.bounds)
    owner = words.owner()
    order = np.lexsort((owner, words.hashes))
    h, owner = words.hashes[order], owner[order]
    once = np.ones(len(h), bool)  # each term of an item
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    terms, df = np.unique(h[once], return_counts=True)
    return Whole(int((lengths > 0).sum()), int(lengths.sum()), int(lengths.max(initial=0)), terms, df)


def together(a: Whole, b: Whole) -> Whole:
    terms, at = np.unique(np.concatenate([a.terms, b.terms]), return_inverse=True)
    df = np.bincount(at, np.concatenate([a.df, b.df]), len(terms)).astype(np.int64)
    return Whole(a.items + b.items, a.words + b.words, max(a.longest, b.longest), terms, df)


def build(rows: list[tuple[int, str]], whole: Whole | None = None) -> Index | None:
    """The index of (item id, text) rows; whole: of all items, if these are a part of them."""
    whole = whole or measured(rows)
    rows = sorted((i, t) for i, t in rows if t)
    words = folded([t.encode() for _, t in rows])
    some = np.flatnonzero(np.diff(words.bounds))
    if not len(some):
        return None
    rows = [rows[i] for i in some]
    lengths = np.diff(words.bounds)[some].astype(float)
    terms, term = np.unique(words.hashes, return_inverse=True)
    pairs, tf = np.unique(term * len(rows) + np.repeat(np.arange(len(rows)), lengths.astype(int)), return_counts=True)
    term, item = pairs // len(rows), pairs % len(rows)
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / (whole.words / whole.items)))
    weight /= np.bincount(item, weight, len(rows))[item]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    n_blocks = -(-len(rows) // BLOCK)
    blocks, at = np.unique(term * n_blocks + item // BLOCK, return_index=True)
    block_weight = np.maximum.reduceat(weight, at)
    bits = np.zeros(1 << 16, bool)
    bits[(terms >> np.uint64(48)).astype(np.intp)] = True
    halves = [parts_of(t) for _, t in rows]
    q, a = folded([x.encode() for x, _ in halves]), folded([x.encode() for _, x in halves])
    part = lambda w: [runs(w.hashes[s:e]) for s, e in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return Index(
        np.array([i for i, _ in rows], np.int64), terms, first, item, weight,
        np.searchsorted(blocks // n_blocks, np.arange(len(terms) + 1)), blocks % n_blocks, block_weight, np.maximum.reduceat(weight, first[:-1]),
        df > max(COMMON * whole.items, 2), bits, part(q), part(a), 2 * max(LEAST_PASSAGE, whole.longest),
    )


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term's range of postings: the term's place, and the posting's."""
    sizes = first[terms + 1] - first[terms]
    place = np.repeat(np.arange(len(terms)), sizes)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[terms], sizes)


_AS_LISTS: dict[int, tuple[Index, tuple[list, list, list, list]]] = {}


def _lists(index: Index) -> tuple[list, list, list, list]:
    """The postings as Python lists, of the index used last."""
    if id(index) not in _AS_LISTS or _AS_LISTS[id(index)][0] is not index:
        _AS_LISTS.clear()
        _AS_LISTS[id(index)] = (index, (index.item.tolist(), index.weight.tolist(), index.block.tolist(), index.block_weight.tolist()))
    return _AS_LISTS[id(index)][1]


def wand(index: Index, terms: np.ndarray, blocks: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """(item, score) of all items in these blocks that score at least threshold, by block-max WAND."""
    lists = [[int(index.first[t]), int(index.first[t + 1]), float(index.largest[t]), int(index.block_first[t]), int(index.block_first[t + 1])] for t in terms.tolist()]
    item, weight, block, block_weight = _lists(index)
    found = []
    lists = [x for x in lists if x[0] < x[1]]
    slack = threshold - 1e-9
    while lists:
        lists.sort(key=lambda x: item[x[0]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[2]
            if bound >= slack:
                pivot = item[x[0]]
                while k + 1 < len(lists) and item[lists[k + 1][0]] == pivot:
                    k += 1
                break
        if pivot < 0:
            break
        own = pivot // BLOCK
        sure = 0.0
        if own in blocks:
            for x in lists[: k + 1]:  # the bound within the pivot's block
                at = bisect_left(block, own, x[3], x[4])
                if at < x[4] and block[at] == own:
                    sure += block_weight[at]
        if sure < slack:  # no item up to the block's end, or up to the next list's item, can do
            to = (own + 1) * BLOCK
            if k + 1 < len(lists):
                to = min(to, item[lists[k + 1][0]])
            to = max(to, pivot + 1)
        elif item[lists[0][0]] == pivot:
            score = sum(weight[x[0]] for x in lists if item[x[0]] == pivot)
            if score >= slack:
                found.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        for x in lists[: k + 1]:
            if item[x[0]] < to:
                x[0] = bisect_left(item, to, x[0], x[1])
        lists = [x for x in lists if x[0] < x[1]]
    return found


def passages(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last + 1 word of passages of that many words, half of it apart, that cover each text."""
    n = np.diff(bounds)
    half = size // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - half) // half)), 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = bounds[owner] + half * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return owner, start, np.minimum(start + size, bounds[owner + 1])


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
    """(text's place, item's place, score, question overlap, answer overlap) of verified matches, best passage of each."""
    words = folded(texts)
    h = words.hashes
    near = np.flatnonzero(index.filter[(h >> np.uint64(48)).astype(np.intp)])
    at = np.minimum(np.searchsorted(index.terms, h[near]), len(index.terms) - 1)
    hit = index.terms[at] == h[near]
    place, term = near[hit], at[hit]  # words that are terms
    owner, start, end = passages(words.bounds, index.passage)
    lo, hi = np.searchsorted(place, start), np.searchsorted(place, end)
    sums = np.concatenate([[0.0], np.cumsum(index.largest[term])])
    alive = np.flatnonzero(sums[hi] - sums[lo] >= THRESHOLD)  # all terms' largest weights
    if not len(alive):
        return []
    sizes = hi[alive] - lo[alive]
    of = np.repeat(np.arange(len(alive)), sizes)
    n_terms = len(index.terms)
    keys = np.unique(of * n_terms + term[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[alive], sizes)])
    of, term = keys // n_terms, keys % n_terms  # each passage's distinct terms
    common = index.common[term]
    usual = np.bincount(of[common], index.largest[term[common]], len(alive))
    k, posting = _expand(index.block_first, term[~common])
    n_blocks = -(-len(index.items) // BLOCK)
    cell = of[~common][k] * n_blocks + index.block[posting]
    bound = np.bincount(cell, index.block_weight[posting], len(alive) * n_blocks).reshape(-1, n_blocks) + usual[:, None]
    open_cell = bound >= THRESHOLD - 1e-9
    rare = np.flatnonzero(~common & open_cell.any(1)[of])
    k, posting = _expand(index.first, term[rare])
    k, item = of[rare][k], index.item[posting]
    at = open_cell[k, item // BLOCK]
    cells, cell = np.unique(k[at] * len(index.items) + item[at], return_inverse=True)
    alone = np.bincount(cell, index.weight[posting][at], len(cells)) + usual[cells // len(index.items)]
    cells = cells[alone >= THRESHOLD - 1e-9]  # the items' own weights of rarer terms
    blocks = np.unique(cells // len(index.items) * n_blocks + cells % len(index.items) // BLOCK)
    enough = np.flatnonzero(usual >= THRESHOLD - 1e-9)  # passages whose common terms alone may do
    if len(enough):
        bound[enough] -= usual[enough, None]
        at = np.flatnonzero(common & (usual >= THRESHOLD - 1e-9)[of])
        for p, t in zip(of[at].tolist(), term[at].tolist(), strict=True):
            own = slice(index.block_first[t], index.block_first[t + 1])
            bound[p, index.block[own]] += index.block_weight[own]
        k, block = np.nonzero(bound[enough] >= THRESHOLD - 1e-9)
        blocks = np.union1d(blocks, enough[k] * n_blocks + block)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    starts = np.flatnonzero(np.r_[True, np.diff(blocks // n_blocks) > 0]) if len(blocks) else []
    for group in np.split(blocks, starts[1:]) if len(blocks) else []:
        p = int(group[0]) // n_blocks
        own = term[slice(*np.searchsorted(of, [p, p + 1]))]
        found = wand(index, own, set((group % n_blocks).tolist()))
        if not found:
            continue
        held = h[start[alive[p]] : end[alive[p]]]
        there = np.unique(np.concatenate([windows(held, n) for n in range(1, RUN + 1)]))  # parts have runs of RUN words, or are shorter
        for i, score in found:
            overlaps = []
            for part in (index.question[i], index.answer[i]):
                overlaps.append(float(np.isin(part, there).mean()) if len(part) else 1.0)
            if min(overlaps) >= OVERLAP:
                key = (int(owner[alive[p]]), i)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (min(1.0, score), *overlaps))
    return [(*k, *v) for k, v in sorted(best.items())]


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Indexes of at most about PART_BYTES of item text each."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    if n == 1:
        index = build([tuple(r) for r in rows.collect()])
        return [index] if index else []
    part = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]
    whole = reduce(together, (measured(part(k)) for k in range(n)))
    return [index for k in range(n) if (index := build(part(k), whole))]


MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def matched(docs: DataFrame, index: Index, name: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds to every row, under that name, the verified matches with the index's items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by PART_BYTES
    small_batches(docs)
    kept = [c for c in docs.columns if keep_text or c != text]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(docs, "_text")))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for a, _, texts in text_pieces(b.column(b.num_columns - 1), CHUNK):
                for place, i, *values in search(own, texts):
                    out[a + place].append(dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), (int(own.items[i]), *values), strict=True)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(out, kind)], names=[*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{name}` {MATCHES}"])
    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: key, item_id, score, question_overlap, answer_overlap."""
    own = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    name = free(own, "_matches")
    found = [matched(own, index, name, text).where(F.size(name) > 0).select(f"`{key}`", F.inline(name)) for index in indexes(items)]
    out = found[0] if found else docs.select(F.col(key)).limit(0).selectExpr(f"`{key}`", f"inline(CAST(array() AS {MATCHES}))")
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold no item, with their columns as they are."""
    out, name = docs, free(docs, "_matches")
    for index in indexes(items):
        out = matched(out, index, name, text, keep_text=True).where(F.size(name) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out
