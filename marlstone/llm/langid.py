"""Language identification by a byte convolutional network, trained here with numpy.

A window is a fixed number of bytes. Each byte has a learned vector; filters of several
widths slide over the window, each keeps its highest response, and a softmax layer reads
these. Windows cover a whole text; a text's language is that of the highest mean log
probability over its windows, weighted by their bytes, and its score that mean's softmax.

For prediction the first layer is folded into tables: a filter's response to a pair of bytes
is looked up, not multiplied, so that the cost per byte is a few row lookups.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if no labelled row can be learned from. Rows with a null label or text teach nothing;
repeated rows are judged alike; ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free, pieces, raw_texts, small_batches

WINDOW, WIDTHS, FILTERS, BYTE_DIMS = 256, (2, 3, 4), 8, 8
#: Bounds of the sample that is learned from: rows, and windows of a row.
TRAIN_ROWS, TRAIN_WINDOWS = 4000, 3
EPOCHS, BATCH, SEED = 6, 128, 7
CHUNK, AT_ONCE = 1 << 20, 256
LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    languages: tuple[str, ...]
    by_pair: np.ndarray  # 65536 x filters: first two bytes of every width
    by_byte: np.ndarray  # 256 x filters of width 3: its third byte
    by_next: np.ndarray  # 65536 x filters of width 4: its last two bytes
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover the texts, padded with blanks; the text and the number of bytes of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    padded = b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts.tolist(), strict=True))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - place * WINDOW)


def train(texts: list[bytes], labels: list[str]) -> Model | None:
    """Fit on the windows of texts, in a fixed order: Adam on the cross entropy."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    x, owner, _ = windows(texts)
    rank = np.zeros(len(owner), np.int64)
    order = rng.permutation(len(owner))
    seen: dict[int, int] = {}
    for i in order.tolist():
        rank[i] = seen[owner[i]] = seen.get(owner[i], -1) + 1
    x, owner = x[rank < TRAIN_WINDOWS], owner[rank < TRAIN_WINDOWS]
    y = np.searchsorted(languages, np.array(labels)[owner])
    nf, nl = FILTERS * len(WIDTHS), len(languages)
    p = {"e": rng.normal(0, 0.5, (256, BYTE_DIMS)), "b": np.zeros(nf), "o": rng.normal(0, 0.3, (nf, nl)), "c": np.zeros(nl)}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * BYTE_DIMS), (w, BYTE_DIMS, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = shuffled[at : at + BATCH]
            b, n = x[rows], len(rows)
            v = p["e"][b]
            pooled, spots = [], []
            for w in WIDTHS:
                t = WINDOW - w + 1
                r = sum(v[:, j : j + t] @ p[f"w{w}"][j] for j in range(w))
                s = r.argmax(1)
                pooled.append(np.take_along_axis(r, s[:, None], 1)[:, 0])
                spots.append(s)
            h = np.concatenate(pooled, 1) + p["b"]
            a = np.maximum(h, 0)
            z = a @ p["o"] + p["c"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[rows]] -= 1
            q /= n
            g = {"o": a.T @ q, "c": q.sum(0)}
            dh = (q @ p["o"].T) * (h > 0)
            g["b"], g["e"] = dh.sum(0), np.zeros_like(p["e"])
            for k, (w, s) in enumerate(zip(WIDTHS, spots, strict=True)):
                d, gw = dh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    at_byte = np.take_along_axis(b, s + j, 1)
                    gw[j] = np.einsum("nf,nfd->df", d, p["e"][at_byte])
                    np.add.at(g["e"], at_byte, d[:, :, None] * p[f"w{w}"][j].T[None])
                g[f"w{w}"] = gw
            step += 1
            for k, grad in g.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    e, (w2, w3, w4) = p["e"], (p[f"w{w}"] for w in WIDTHS)
    pair = lambda w: ((e @ w[0])[:, None] + (e @ w[1])[None]).reshape(65536, FILTERS)
    return Model(languages, np.concatenate([pair(w2), pair(w3), pair(w4)], 1).astype(np.float32), (e @ w3[2]).astype(np.float32), pair(w4[2:]).astype(np.float32), p["b"], p["o"], p["c"])


def log_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Of each language, for each window."""
    pooled = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
    for at in range(0, len(x), AT_ONCE):
        b = x[at : at + AT_ONCE].astype(np.intp)
        pairs = b[:, :-1] * 256 + b[:, 1:]
        r = model.by_pair[pairs]
        pooled[at : at + AT_ONCE, :FILTERS] = r[:, :, :FILTERS].max(1)
        three = r[:, :-1, FILTERS : 2 * FILTERS]
        three += model.by_byte[b[:, 2:]]
        pooled[at : at + AT_ONCE, FILTERS : 2 * FILTERS] = three.max(1)
        four = r[:, :-2, 2 * FILTERS :]
        four += model.by_next[pairs[:, 2:]]
        pooled[at : at + AT_ONCE, 2 * FILTERS :] = four.max(1)
    z = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def predict(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    languages, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and LETTER.search(t.decode())] if model else []
    for a, z in pieces((len(texts[i]) for i in rows), CHUNK):
        x, owner, weight = windows([texts[i] for i in rows[a:z]])
        logs = log_probabilities(model, x) * weight[:, None]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        mean = np.add.reduceat(logs, starts) / np.add.reduceat(weight, starts)[:, None]
        q = np.exp(mean - mean.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        best = q.argmax(1)
        for i, k, s in zip(rows[a:z], best.tolist(), q[np.arange(len(q)), best].tolist(), strict=True):
            languages[i], scores[i] = model.languages[k], min(1.0, s)
    return languages, scores


def fit(rows: DataFrame, key: str, text: str, label: str) -> Model | None:
    """Train on at most TRAIN_ROWS rows with text and label, the first by a hash of their key."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit(SEED))
    known = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    chosen = [r[0] for r in known.select(F.col(key), order.alias("_o")).orderBy("_o", key).limit(TRAIN_ROWS).collect()]
    if not chosen:
        return None
    # windows spread over the text, cut before the rows leave the executors
    size = F.length(F.col(text))
    cut = F.concat_ws(" ", *(F.substring(F.col(text), (size * F.lit(i) / F.lit(TRAIN_WINDOWS)).cast("int") + F.lit(1), F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)))
    sample = known.where(F.col(key).isin([c for c in chosen if c is not None])).select(F.col(key).alias("k"), F.when(size <= WINDOW * TRAIN_WINDOWS, F.col(text)).otherwise(cut).alias("t"), F.col(label).alias("l")).collect()
    sample.sort(key=lambda r: (r["k"], r["l"], r["t"]))
    return train([r["t"].encode() for r in sample], [r["l"] for r in sample])


def identify(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Adds lang_pred and score, learned from the rows for which learn holds; drops text and label columns."""
    model = fit(df.where(learn), key, text, label)
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    kept = [c for c in df.columns if c not in (text, label, "lang_pred", "score")]
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(text).cast("string").alias(free(df, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages, scores = predict(shared.value, raw_texts(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)
