"""BPE encoding and decoding of whole texts with a vocabulary of a public tokenizer.

Distinct words go into a trie. A depth-first walk gives each prefix its state: the last
token of its encoding. That token is the one suffix of the prefix which is a token and
may follow the last token of what stands before it; whether two tokens may stand side by
side is settled by merging their joined symbols once and is remembered. A prefix shared by
many words is worked out once, and a word's tokens are read back along the states.

Defined results: a null text is an empty one, with no tokens; repeated rows are encoded alike;
special tokens' strings in a text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free, pieces, small_batches, tidy

#: Bounds of what a worker remembers: words, and pairs of tokens.
WORDS, PAIRS = 300_000, 500_000
CHUNK = 2 << 20
#: White space as the file's expressions mean it (Unicode's property).
WHITE = r"\t-\r \x85\xa0  -     　"
#: Characters that this Python's tables call letters and numbers and the library's older ones do not.
LATER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    r"\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Characters that the library lower-cases and this Python does not: first, last, distance.
LATER_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561),
    (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
SELDOM = regex.compile("[Σ" + "".join(f"{chr(a)}-{chr(z)}" for a, z, _ in LATER_LOWER) + "]")
LOWER = {c: c + d for a, z, d in LATER_LOWER for c in range(a, z + 1)} | {ord("Σ"): "σ"}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Words to token ids; the file is a tokenizers JSON file with a BPE model and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE models are supported")
        steps = [s for n in [spec["normalizer"]] for s in (n["normalizers"] if n["type"] == "Sequence" else [n])]
        pre = [s for n in [spec["pre_tokenizer"]] for s in (n["pretokenizers"] if n["type"] == "Sequence" else [n])]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in pre] != ["Split", "ByteLevel"] or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("only NFC, white space and lower case, then split words in bytes, are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.made = {a + b: (a, b) for a, b in self.ranks}
        if len(self.made) < len(self.ranks):
            raise ValueError("two merges make the same token")
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        #: Tokens within a word, and (without the suffix) those at its end; each with the tokens before it that are settled.
        within = {t: {} for t in self.ids if not self.end or not t.endswith(self.end) or t == self.end}
        final = {t[: -len(self.end)]: {} for t in self.ids if t not in within} if self.end else within
        self.followers: tuple[dict[str, dict[str, bool]], dict[str, dict[str, bool]]] = (within, final)
        #: The same by their symbols from the last, as tries; a token's pairs are under "".
        self.suffixes: tuple[dict, dict] = ({}, {})
        for tokens, node in zip(self.followers, self.suffixes, strict=True):
            for token, pairs in tokens.items():
                below = node
                for c in reversed(token):
                    below = below.setdefault(c, {})
                below[""] = pairs
        self.settled = 0
        self.id_text = {t: str(i) for t, i in self.ids.items()}
        pattern = pre[0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.splits = regex.compile(pattern)
        #: The same for texts with characters that the tables differ in.
        self.later = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
        self.later_splits = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{LATER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER_NUMBERS}]]"))
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = {b: c for b, c in enumerate(byte_symbols())}
        self.plain = {b for b, c in self.table.items() if chr(b) == c}
        self.words: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    # Merging

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the pair of least rank, the leftmost first, until none has a rank."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def spine(self, token: str, side: int) -> tuple[list[str], list[int]]:
        """From the outermost symbol on a side (0 left, 1 right) to the token: the parts, and the ranks that join each to more."""
        parts, ranks, part, rank = [], [], token, len(self.ranks)
        while part:
            parts.append(part)
            ranks.append(rank)
            pair = self.made.get(part)
            part, rank = (pair[side], self.ranks[pair]) if pair else ("", 0)
        return parts[::-1], ranks[::-1]

    def may_follow(self, before: str, token: str) -> bool:
        """Whether the encoding of the two tokens' joined symbols is just these two; before may be empty.

        Merges happen in the order of their ranks, the leftmost first. So a merge over the seam
        happens if its rank is lower than that of the merge that takes the part on its left
        away, and not higher than that on its right; else the lower of these comes first.
        """
        if not before:
            return self.merged(self.symbols(token)) == [token]
        own = self.followers[self.end != "" and token.endswith(self.end) and token != self.end]
        alone = own[token[: -len(self.end)] if own is not self.followers[0] else token]
        if "" not in alone:
            alone[""] = self.may_follow("", token)
        if not alone[""]:
            return False
        (left, left_ranks), (right, right_ranks), never = self.spine(before, 1), self.spine(token, 0), len(self.ranks)
        i = j = 0
        while True:
            a_rank, b_rank, rank = left_ranks[i], right_ranks[j], self.ranks.get((left[i], right[j]), never)
            if rank < a_rank and rank <= b_rank and rank < never:
                return False
            if a_rank == never and b_rank == never:
                return True
            if a_rank <= b_rank:
                i += 1
            else:
                j += 1

    def last_token(self, prefix: str, states: list[str], end: bool) -> str:
        """The last token of the prefix's encoding; states[i] is that of its first i symbols."""
        node, at, found = self.suffixes[end], len(prefix), []
        while at:
            at -= 1
            node = node.get(prefix[at])
            if node is None:
                break
            known = node.get("")
            if known is not None:
                found.append((at, known))
        for at, known in reversed(found):
            before = states[at]
            fits = known.get(before)
            if fits is None:
                if self.settled >= PAIRS:
                    self.forget()
                fits = known[before] = self.may_follow(before, prefix[at:] + (self.end if end else ""))
                self.settled += 1
            if fits:
                return prefix[at:]
        raise ValueError("no encoding")

    def forget(self) -> None:
        """Drop the settled pairs, of which there is one for each two tokens met."""
        for pairs in self.followers:
            for x in pairs.values():
                x.clear()
        self.settled = 0

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its tokens) of distinct words of byte symbols, by a depth-first walk of their trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in word:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[""] = None
        states, prefix = [""], ""
        stack = [(0, "", trie)]
        while stack:
            depth, c, node = stack.pop()
            if c:
                del states[depth:]
                prefix = prefix[: depth - 1] + c
                if "" in node:
                    last = self.last_token(prefix, states, True)
                    tokens, at = [last + self.end], depth - len(last)
                    while at:
                        last = states[at]
                        tokens.append(last)
                        at -= len(last)
                    yield prefix, tokens[::-1]
                    if len(node) == 1:
                        continue
                states.append(self.last_token(prefix, states, False))
            for x, below in node.items():
                if x:
                    stack.append((depth + 1, x, below))

    # Texts

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, lower-cased, not yet in byte symbols."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER) if SELDOM.search(text) else unicodedata.normalize("NFC", text)
            lowered = text.lower()
            return (self.later_splits if self.later.search(lowered) else self.splits).findall(lowered)
        return self.splits.findall(text.lower())

    def in_bytes(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(self.table[b] for b in word.encode())

    def learn(self, words: set[str]) -> None:
        """Put the words' ids and tokens, each joined by spaces, among those remembered."""
        if len(self.words) + len(words) > WORDS:
            self.words, self.shown = ({w: x[w] for w in words if w in x} for x in (self.words, self.shown))
        missing = {self.in_bytes(w): w for w in words if w not in self.words}
        collects = gc.isenabled()
        gc.disable()  # a trie has no cycles, and very many nodes that would be looked through
        try:
            for symbols, tokens in self.encode_words(missing):
                self.words[missing[symbols]] = " ".join(map(self.id_text.__getitem__, tokens))
                self.shown[missing[symbols]] = " ".join(tokens)
        finally:
            if collects:
                gc.enable()

    def parts(self, text: str | None) -> list[str | list[str]]:
        """Special tokens as they are, and the lists of words between them."""
        if not text:
            return []
        if self.cuts is None or "<|" not in text and not self.cuts.search(text):
            return [self.split(text)]
        return [x if x in self.special else self.split(x) for x in self.cuts.split(text) if x]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(ids, decoded text), both joined by spaces."""
        for a, z in pieces((len(t or "") for t in texts), CHUNK):
            split = [self.parts(t) for t in texts[a:z]]
            self.learn({w for text in split for part in text if isinstance(part, list) for w in set(part)})
            for text in split:
                ids = [str(self.special[p]) if isinstance(p, str) else " ".join(map(self.words.__getitem__, p)) for p in text]
                shown = [p if isinstance(p, str) else " ".join(map(self.shown.__getitem__, p)) for p in text]
                yield " ".join(filter(None, ids)), " ".join(filter(None, shown))

    def encode(self, text: str | None) -> list[int]:
        (ids, _), = self.encode_batch([text])
        return [int(i) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens joined by spaces; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def tokenize(df: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Adds n_tokens, and either token_ids and decoded, or with digest the SHA-256 of both.

    path is that of a tokenizers JSON file which every executor has. Columns of these
    names are replaced; all others pass.
    """
    added = [("n_tokens", "long", pa.int64()), *([("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] if digest else [("token_ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())])]
    kept = [f for f in df.columns if f not in {n for n, *_ in added}]
    if digest and text in kept:
        kept.remove(text)
    small_batches(df)
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(df, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for a, z in pieces((n or 0 for n in pa.compute.binary_length(texts).to_pylist()), CHUNK):
                part = b.slice(a, z - a)
                found = list(bpe.encode_batch(texts.slice(a, z - a).to_pylist()))
                number = np.fromiter((ids.count(" ") + 1 if ids else 0 for ids, _ in found), np.int64, len(found))
                if digest:
                    rest = [pa.array([sha(x[i]) for x in found], pa.string()) for i in (0, 1)]
                else:
                    every = np.fromstring(" ".join(ids for ids, _ in found), np.int32, sep=" ") if number.any() else np.empty(0, np.int32)
                    rest = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(number)].astype(np.int32)), pa.array(every)), pa.array([x for _, x in found], pa.string())]
                new = [pa.array(number), *rest]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *new], names=[*kept, *(n for n, *_ in added)])
        # a worker lives on after the task, beside what other stages need: the settled pairs stay, the words go
        bpe.words, bpe.shown = {}, {}
        gc.collect()
        tidy()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{n} {t}" for n, t, _ in added)])
    return rows.mapInArrow(run, schema)
