"""Toxicity by class-conditional Kneser-Ney models.

A text is a sequence of expressions: runs of letters, marks and digits, folded to lower case, every code
point a symbol of its own; in scripts without blanks each symbol begins an expression of up to four.
An expression is predicted symbol by symbol, and its end as well, each from all symbols before it. The toxic and the ordinary model
discount their own counts, of texts that hold an expression, and give the rest to one shared lower order:
Kneser-Ney over three symbols of context, whose continuation counts come from all texts, labelled or not. So a rare expression is judged by
its known beginning and by what the whole corpus knows of its parts.

Most of a toxic text is ordinary: its likelihood of an expression is the toxic model's with the weight MIXED, else the ordinary model's.
The difference of the logarithms of both likelihoods, divided by the text's symbols, is the one number that decides; its logarithm becomes a
probability by one slope and one intercept, fitted on labelled rows that the models have not seen.

What is gathered. The shared order's counts are tables that grow with the corpus and stay distributed. The class models are fitted on
at most LEARN_ROWS labelled rows of each class, and calibrated on at most CALIBRATE_ROWS, both chosen by a hash of
the id; only what these rows' expressions need of the shared counts reaches the driver, and the broadcast model has as many entries as these expressions have beginnings.

Defined results: a null text, and one without expressions, have the difference 0; without labelled rows of both kinds
every score is 0; of repeated labels for one id the largest counts; texts that are alike, and so repeated rows, score alike; a score equal to the threshold is
toxic; a run of more than 64 symbols is several expressions; columns named like the results are replaced, all others pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, free, pieces, small_batches, tidy
from .textvec import BYTE_BASE, mix, powers

U = np.uint64
#: Bounds of the labelled rows of each class that the models learn from, and of those that calibrate, chosen among one in so many.
LEARN_ROWS, CALIBRATE_ROWS, CALIBRATE_ONE_IN = 8192, 4000, 5
#: Counts up to DISCOUNT say nothing by themselves; the shared order's discount; the toxic model's weight in a toxic text; added before the logarithm.
DISCOUNT, SHARED_DISCOUNT, MIXED, FLOOR = 2.0, 0.75, 0.01, 0.001
#: Symbols that a task works on at once; of a longer text, all. Scoring takes some 50 bytes for each, and two tasks share an executor.
CHUNK = 1 << 18
THRESHOLD = 0.7
#: Symbols of an expression, and of one in a script without blanks.
LONGEST, DENSE_LONGEST = 64, 4
#: Scripts without blanks: Thai to Myanmar, Khmer, kana, ideographs.
DENSE = ((0x0E00, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000))
BEGIN, END, SYMBOL = 0x110000, 0x110001, 21
ROOT = U(0x1B873593CC9E2D51)


DENSE_BIT = 24


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """For each code point its symbol, 0 if it is none, with DENSE_BIT if its script has no blanks."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum() or unicodedata.category(ch)[0] == "M":
            out[c] = ord(ch.lower()[0])
    for a, z in DENSE:
        out[a:z] |= np.where(out[a:z] > 0, np.uint32(1 << DENSE_BIT), np.uint32(0))
    return out


class Scan(NamedTuple):
    """Expressions of several texts: running sums for hashes, symbols, first place and number of symbols of each, each text's range of them."""

    sums: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray


def _sums(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, U)
    np.multiply(symbols, powers(BYTE_BASE, len(symbols))[0], out=out[1:])
    return np.cumsum(out, out=out)


def scan(texts: list[str]) -> Scan:
    s = symbol_table()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(s) + 1, bool)
    np.not_equal(s, 0, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last symbol is none
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if len(s) and int(s.max()) >> DENSE_BIT or sizes.max(initial=0) > LONGEST:
        d = s >= 1 << DENSE_BIT
        s = s & np.uint32((1 << DENSE_BIT) - 1)
        kind = (s != 0).astype(np.int8) + d
        edges = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True])  # runs of one kind
        run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at = np.arange(len(s)) - edges[run]
        starts = np.flatnonzero((s != 0) & (d | (at % LONGEST == 0)))
        sizes = np.minimum(edges[run[starts] + 1] - starts, np.where(d[starts], DENSE_LONGEST, LONGEST))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Scan(_sums(s), s, starts, sizes, np.searchsorted(starts, np.r_[0, ends]))


class Slots:
    """Values of some hashes, each in the slot of its last bits, where a later one takes its place: what is found is right, what is not must be made."""

    def __init__(self, bits: int = 20):
        self.mask, self.keys, self.values = U((1 << bits) - 1), np.zeros(1 << bits, U), np.zeros(1 << bits, np.float32)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        return (self.keys[(hashes & self.mask).astype(np.int64)] == hashes) & (hashes != 0)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.values[(hashes & self.mask).astype(np.int64)]

    def put(self, hashes: np.ndarray, values: np.ndarray | float = 0.0) -> None:
        """Of hashes in one slot all but one are forgotten."""
        at = (hashes & self.mask).astype(np.int64)
        self.keys[at] = hashes
        kept = self.keys[at] == hashes
        self.values[at[kept]] = values[kept] if isinstance(values, np.ndarray) else values


def _hashes(sums: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Of the first so many symbols from each start."""
    down = powers(BYTE_BASE, len(sums))[1]
    return _sealed((sums[starts + size] - sums[starts]) * down[starts], size)


def _sealed(sums: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of so many symbols each, from the sums of symbols times powers."""
    return mix(sums + np.asarray(size).astype(U) * U(0xC2B2AE3D27D4EB4F))


def _ended(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U(0x5851F42D4C957F2D))


def distinct(x: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal expressions, and for each expression which of these it is."""
    _, first, which = np.unique(_hashes(x.sums, x.starts, x.sizes), return_index=True, return_inverse=True)
    return first, which


def grams(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of the five symbols up to each symbol of the expressions and to their ends, 21 bits a symbol, three of them in low."""
    owner = np.repeat(np.arange(len(starts)), sizes + 1)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    place = starts[owner] + at
    out = []
    for back in range(4, -1, -1):
        own = symbols[np.clip(place - back, 0, len(symbols) - 1)].astype(np.int64)
        own[at - back < 0] = BEGIN
        if back == 0:
            own[at == sizes[owner]] = END
        out.append(own)
    return out[0] << SYMBOL | out[1], out[2] << 2 * SYMBOL | out[3] << SYMBOL | out[4]


# The shared lower order

def _new(hashes: np.ndarray, known: Slots) -> np.ndarray:
    """Places of the first of each hash that is not among the known; they are known then."""
    at = np.flatnonzero(~known.found(hashes))
    own, first = np.unique(hashes[at], return_index=True)
    known.put(own)
    return at[first]


def kinds(texts: DataFrame) -> DataFrame:
    """(high, low): the kinds of five symbols in a row in all texts, a few times each; a column of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expressions, fives = Slots(), Slots()
        for b in batches:
            column = b.column(0).to_pylist()
            for a, z in pieces((len(t or "") for t in column), CHUNK):
                x = scan([t or "" for t in column[a:z]])
                first = _new(_hashes(x.sums, x.starts, x.sizes), expressions)
                if len(first):
                    high, low = grams(x.symbols, x.starts[first], x.sizes[first])
                    at = _new(mix(mix(high.view(U)) + low.view(U)), fives)
                    yield pa.RecordBatch.from_arrays([pa.array(high[at]), pa.array(low[at])], names=["high", "low"])
        tidy()

    return texts.mapInArrow(run, "high long, low long")


def four_of(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, low): the symbol at that depth of each expression, or its end, after the three before."""
    out = []
    for back in range(3, -1, -1):
        at = depth - back
        out.append(np.full(len(starts), BEGIN) if at < 0 else np.where(at == sizes, END, symbols[np.minimum(starts + at, len(symbols) - 1)]).astype(np.int64))
    return out[0], out[1] << 2 * SYMBOL | out[2] << SYMBOL | out[3]


def _key(a: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(U)) + low.view(U))


def shared(texts: DataFrame, a: np.ndarray, low: np.ndarray) -> np.ndarray:
    """P(symbol | three before) of the shared order, for a bounded number of (a, low); its counts cover all texts."""
    spark = texts.sparkSession
    mask = lambda n: (1 << n * SYMBOL) - 1
    none = F.lit(0).cast("long")
    four = checkpointed(kinds(texts).distinct().groupBy(F.col("high").bitwiseAND(F.lit(mask(1))).alias("a"), "low").agg(F.count("*").alias("n")))
    by_size = {4: four, 3: four.groupBy("low").agg(F.count("*").alias("n")).select(none.alias("a"), "low", "n")}
    for size in (2, 1):
        by_size[size] = by_size[size + 1].groupBy(F.col("low").bitwiseAND(F.lit(mask(size))).alias("low")).agg(F.count("*").alias("n")).select(none.alias("a"), "low", "n")
    # one table of all: (size, a, low) with n, kinds of symbols before; (10 + size, a, context) with their sum t and number k
    parts = [t.select(F.lit(size).alias("size"), "a", "low", "n", none.alias("t"), none.alias("k")) for size, t in by_size.items()]
    parts += [t.groupBy("a", F.shiftright("low", SYMBOL).alias("low")).agg(F.sum("n").alias("t"), F.count("*").alias("k")).select(F.lit(10 + size).alias("size"), "a", "low", none.alias("n"), "t", "k") for size, t in by_size.items()]

    def asked(size: int) -> pd.DataFrame:  # made again where it is used: the driver holds one of the eight
        own = low & mask(min(size % 10, 3))
        return pd.DataFrame({"a": a if size % 10 == 4 else 0, "low": own >> SYMBOL if size > 10 else own})

    ask = pa.concat_tables(pa.Table.from_pandas(asked(size).drop_duplicates().assign(size=np.int32(size)), preserve_index=False) for size in (*by_size, *(10 + size for size in by_size)))
    ask = spark.createDataFrame(ask)
    found = reduce(DataFrame.unionAll, parts).join(F.broadcast(ask), ["size", "a", "low"]).toArrow()

    def looked_up(size: int, *values: str) -> list[np.ndarray]:
        own = found.filter(pc.equal(found["size"], size)).select(["a", "low", *values]).to_pandas()
        own = asked(size).merge(own, "left", ["a", "low"])
        return [own[v].fillna(0).to_numpy(float) for v in values]

    (n,), (t, k) = looked_up(1, "n"), looked_up(11, "t", "k")
    p = (n + 0.5) / (t + 0.5 * (k + 1))
    for size in (2, 3, 4):
        (n,), (t, k) = looked_up(size, "n"), looked_up(10 + size, "t", "k")
        p = np.where(t > 0, (np.maximum(n - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * k * p) / np.maximum(t, 1), p)
    return p


# The class models

class Beginnings(NamedTuple):
    """Of the learned expressions' beginnings: hashes in order; the log ratio of the models up to there, and what a symbol unseen after it adds."""

    hashes: np.ndarray
    ratios: np.ndarray
    rests: np.ndarray
    root: float  # what an unseen first symbol adds


class Level(NamedTuple):
    """Beginnings of one length: hashes; for each an expression that has it, and the place of the one shorter by a symbol in the level before; the expressions, and which beginning each has."""

    hashes: np.ndarray
    example: np.ndarray
    before: np.ndarray
    expressions: np.ndarray
    which: np.ndarray


def levels(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[Level]:
    """The sums of _hashes() grow by a symbol a level: the driver holds one for each expression, none for each symbol."""
    sums, last = np.zeros(len(starts), U), np.zeros(len(starts), np.int32)
    at, power = np.arange(len(starts), dtype=np.int32), 1
    for depth in range(LONGEST + 1):
        at = at[sizes[at] >= depth]
        if not len(at):
            return
        ended = sizes[at] == depth
        on = at[~ended]
        sums[on] += symbols[starts[on] + depth] * U(power)
        h = _sealed(sums[at], depth + ~ended)
        h[ended] = _ended(h[ended])
        hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
        which = which.astype(np.int32)
        yield Level(hashes, at[first], last[at[first]], at, which)
        last[at] = which
        power = power * BYTE_BASE % (1 << 64)


def beginnings(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, lower: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Beginnings:
    """From distinct expressions, in how many texts of each class they are, and the shared order's P of (a, low)."""
    hashes, ratios, rests, root, before = [], [], [], 0.0, np.zeros(1)
    for depth, x in enumerate(levels(symbols, starts, sizes)):
        p = lower(*four_of(symbols, starts[x.example], sizes[x.example], depth))
        number = len(hashes[-1]) if depth else 1
        step, rest = np.zeros(len(x.hashes)), np.zeros(number)
        for n, sign in ((toxic, 1), (ordinary, -1)):
            n = np.bincount(x.which, n[x.expressions])
            total, kept = np.bincount(x.before, n, number), np.bincount(x.before, np.minimum(n, DISCOUNT), number)
            left = np.where(total > 0, kept / np.maximum(total, 1), 1.0)
            step += sign * np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[x.before] + left[x.before] * p)
            rest += sign * np.log(left)
        if depth:
            rests.append(rest.astype(np.float32))
        else:
            root = float(rest[0])
        hashes.append(x.hashes)
        before = step + before[x.before]
        ratios.append(before.astype(np.float32))
    if not hashes:
        return Beginnings(np.empty(0, U), np.empty(0, np.float32), np.empty(0, np.float32), 0.0)
    rests.append(np.zeros(len(hashes[-1]), np.float32))
    order = np.argsort(all_hashes := np.concatenate(hashes))
    hashes.clear()
    return Beginnings(all_hashes[order], np.concatenate(ratios)[order], np.concatenate(rests)[order], root)


def ratios_of(model: Beginnings, x: Scan, first: np.ndarray) -> np.ndarray:
    """log P_toxic - log P_ordinary of the expressions at these places."""
    starts, sizes = x.starts[first], x.sizes[first]
    out = np.full(len(first), model.root)
    active = np.arange(len(first))
    for depth in range(1, LONGEST + 2):  # as long as the beginning is known
        if not len(active):
            break
        ended = sizes[active] < depth
        h = _hashes(x.sums, starts[active], np.minimum(depth, sizes[active]))
        h[ended] = _ended(h[ended])
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        known = model.hashes[at] == h
        out[active[known]] = model.ratios[at[known]] + np.where(ended[known], 0, model.rests[at[known]])
        active = active[known & ~ended]
    return out


def differences(model: Beginnings, texts: list[str | None], known: Slots | None = None) -> np.ndarray:
    """For each text, log P_toxic - log P_ordinary by symbol, where P_toxic of an expression is mixed; known: what expressions gain, for several calls."""
    out, known = np.zeros(len(texts)), known or Slots()
    for a, z in pieces((len(t or "") for t in texts), CHUNK):
        x = scan([t or "" for t in texts[a:z]])
        if not len(x.starts):
            continue
        hashes = _hashes(x.sums, x.starts, x.sizes)
        gain = known.of(hashes)
        at = np.flatnonzero(~known.found(hashes))
        own, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
        fresh = np.log1p(MIXED * np.expm1(np.minimum(ratios_of(model, x, at[first]), 50.0))).astype(np.float32)
        gain[at] = fresh[which]
        known.put(own, fresh)
        rows = np.flatnonzero(np.diff(x.bounds))
        at = x.bounds[rows]
        out[a + rows] = np.add.reduceat(gain.astype(float), at) / np.add.reduceat(x.sizes + 1, at)
    return out


class Model(NamedTuple):
    blob: bytes  # Beginnings, squeezed
    root: float
    slope: float
    intercept: float


def squeezed(model: Beginnings) -> bytes:
    stream = zstandard.ZstdCompressor(level=1).compressobj(size=16 * len(model.hashes))
    parts = [stream.compress(x.data) for x in (np.diff(model.hashes, prepend=U(0)), model.ratios, model.rests)]
    return b"".join([*parts, stream.flush()])


@lru_cache(maxsize=1)
def unsqueezed(blob: bytes, root: float) -> Beginnings:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(data) // 16
    return Beginnings(np.cumsum(np.frombuffer(data, U, n), dtype=U), np.frombuffer(data, np.float32, n, 8 * n), np.frombuffer(data, np.float32, n, 12 * n), root)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a little ridge, by Newton's method."""
    middle, width = x.mean(), x.std() or 1.0
    x = np.c_[(x - middle) / width, np.ones(len(x))]
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


def scores(model: Model | None, texts: list[str | None], known: Slots | None = None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    x = np.log(np.maximum(differences(unsqueezed(model.blob, model.root), texts, known), 0) + FLOOR)
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))


def _chosen(known: DataFrame, salt: int, most: int) -> dict[object, int]:
    """At most that many of the labelled rows (_k, toxic), by a hash of the id."""
    return {r["_k"]: r["toxic"] for r in known.orderBy(F.xxhash64(F.col("_k").cast("string"), F.lit(salt)), "_k").limit(most).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """The shared order from all of docs; labels only of the rows for which learn (over key) holds."""
    spark = docs.sparkSession
    small_batches(docs)
    known = labels.where(learn & F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.when(F.col(toxic) > 0, 1).otherwise(0)).alias("toxic"))
    held = F.pmod(F.xxhash64(F.col("_k").cast("string"), F.lit(11)), F.lit(CALIBRATE_ONE_IN)) == 0
    calibrate = _chosen(known.where(held), 12, CALIBRATE_ROWS)
    rest = known.where(~F.col("_k").isin(list(calibrate))) if calibrate else known
    learned = _chosen(rest.where("toxic = 0"), 13, LEARN_ROWS) | _chosen(rest.where("toxic = 1"), 13, LEARN_ROWS)
    if len(set(learned.values())) < 2:
        return None
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("text"))
    use = calibrate if len(set(calibrate.values())) == 2 else learned  # too few rows to spare some
    asked = spark.createDataFrame([(k, v) for k, v in learned.items()], known.schema)
    sample = rows.join(F.broadcast(asked), "_k").select("text", "toxic")  # bounded by LEARN_ROWS

    def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, classes = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for a, z in pieces((len(t or "") for t in texts), CHUNK):
                x = scan([t or "" for t in texts[a:z]])
                if not len(x.starts):
                    continue
                first, which = distinct(x)
                owner = np.repeat(np.arange(z - a), np.diff(x.bounds))
                pairs = np.unique(owner * len(first) + which)  # an expression counts once in a text
                word, kind = pairs % len(first), classes[a:z][pairs // len(first)]
                own = [x.symbols[s : s + n].astype("<u4").tobytes().decode("utf-32-le") for s, n in zip(x.starts[first].tolist(), x.sizes[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array(np.bincount(word[kind == k], minlength=len(first)).astype(np.int64)) for k in (0, 1))], names=["word", "n0", "n1"])
        tidy()

    counted = sample.mapInArrow(expressions, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n0, n1 = (counted.column(c).to_numpy().astype(float) for c in ("n0", "n1"))
    if not n0.any() or not n1.any():
        return None
    words = counted.column("word").combine_chunks()
    del counted
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    symbols = np.concatenate([np.frombuffer("".join(words.slice(i, 1 << 14).to_pylist()).encode("utf-32-le"), np.uint32) for i in range(0, len(words), 1 << 14)])
    starts = np.cumsum(sizes) - sizes
    del words
    tidy()
    keys, needed = np.empty(0, U), np.empty((2, 0), np.int64)
    for depth, x in enumerate(levels(symbols, starts, sizes)):
        own = np.stack(four_of(symbols, starts[x.example], sizes[x.example], depth))
        keys, first = np.unique(np.r_[keys, _key(*own)], return_index=True)
        needed = np.concatenate([needed, own], axis=1)[:, first]
    del x, own, first
    tidy()
    p = shared(rows.select("text"), *needed)
    del needed
    tidy()
    model = beginnings(symbols, starts, sizes, n0, n1, lambda a, low: p[np.searchsorted(keys, _key(a, low))])
    del symbols, starts, sizes, n0, n1, keys, p
    plain = Model(squeezed(model), model.root, 1.0, 0.0)
    del model
    tidy()
    shipped = spark.sparkContext.broadcast(plain)
    targets = spark.createDataFrame([(k, v) for k, v in use.items()], known.schema)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = differences(unsqueezed(shipped.value.blob, shipped.value.root), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x), b.column(1)], names=["x", "toxic"])

    found = rows.join(F.broadcast(targets), "_k").select("text", "toxic").mapInArrow(differ, "x double, toxic int").toArrow()
    x, y = found.column("x").to_numpy(), found.column("toxic").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    order = np.lexsort((y, x))  # the same sums in any order of the rows
    return Model(plain.blob, plain.root, *calibrated(np.log(np.maximum(x[order], 0) + FLOOR), y[order]))


def score(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to every row; drops the text unless asked to keep it."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the rows that are learned from
    small_batches(df)
    kept = [c for c in df.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(df, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Slots()
        for b in batches:
            p = scores(shipped.value, b.column(b.num_columns - 1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])
        unsqueezed.cache_clear()  # a worker lives on after the task
        tidy()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double", "predicted int"])
    return rows.mapInArrow(run, schema)
