"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones a task has not met yet are held as ragged numpy arrays (one flat array
of symbols and the start of each sequence). In each step every sequence applies its own lowest-rank pair, all at once,
and leaves when it has none. The symbols that survive are its tokens.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model_path, short_batches, text_or_empty

#: Fixed value: the pattern of the byte-level pre-tokenizer (public; also in the tokenizer package as PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered words of a worker; beyond, the memory starts anew.
REMEMBERED = 1_000_000
#: A word longer than this is counted in its text and not remembered.
LONG = 200


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the rest count up from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Merges:
    """The merge list of a byte-level vocabulary as sorted arrays of pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [a["content"] for a in spec["added_tokens"] if a["special"]]
        self.base = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.words: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string."""
        sizes = np.array([len(p) for p in pretokens], np.int64)
        symbol = self.base[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        out = sizes.copy()
        while len(symbol) > 1:
            rank = np.full(len(symbol), self.none)
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.ranks(symbol[:-1][inside], symbol[1:][inside])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
            active = lowest < self.none
            if not active.all():  # finished sequences leave
                symbol, owner, rank, lowest = symbol[active], owner[active], rank[active], lowest[active]
                if not len(symbol):
                    break
            hit = rank == lowest
            # pairs of one symbol may overlap: of a run of hits, every second one is taken from the left
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) > 1])
            first = at[np.r_[True, np.diff(run) > 0]]
            at = at[(at - first[run - 1]) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            out -= np.bincount(owner[at], minlength=len(out))
            symbol, owner = symbol[keep], owner[keep]
        return out

    def learn(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word (a stretch whose pre-tokens don't depend on what stands around it)."""
        cut = list(map(self.pattern.findall, words))
        new = list({p for c in cut for p in c})
        size = dict(zip(new, self.count([p.encode("utf-8", "surrogatepass") for p in new]).tolist(), strict=True)) if new else {}
        return {w: sum([size[p] for p in c]) for w, c in zip(words, cut, strict=True)}

    def odd_split(self, text: str) -> list[str]:
        """Words of a text in which white space meets: cuts lie only before a single blank between two other characters."""
        out, held = [], None
        for p in text.split(" "):
            if held is None:
                held = p
            elif p and not p[0].isspace() and held and not held[-1].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        return [*out, held]

    def one(self, words: list[str]) -> int:
        counts = Counter(words)
        found = self.learn(list(counts))
        return sum(n * found[w] for w, n in counts.items())

    def texts(self, texts: list[str]) -> list[int]:
        """Most words stand between single blanks; each distinct one is merged once and remembered with its leading blank."""
        bits: list[tuple[int, str]] = []
        specials = [0] * len(texts)
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                cut = self.special.split(text)
                specials[k] = len(cut) - 1
                bits += [(k, c) for c in cut if c]
            elif text:
                bits.append((k, text))
        parts = [bit.split(" ") for _, bit in bits]
        if len(self.words) > REMEMBERED:
            self.words = {}
        known, new = self.words, set()
        for p in parts:
            new.update(set(p[1:]).difference(known))
        plain = [w for w in new if w and len(w) <= LONG and w.strip() == w]
        known.update((w, None) for w in new)  # None: to be counted in its text
        found = self.learn([" " + w for w in plain])
        known.update((w, found[" " + w]) for w in plain)
        out = specials
        heads = self.learn(list({p[0] for p in parts}))
        for (k, bit), p in zip(bits, parts, strict=True):
            head = p[0]
            try:
                if not head or head.strip() != head:
                    raise TypeError
                out[k] += heads[head] + sum(map(known.__getitem__, p[1:]))
            except TypeError:
                out[k] += self.one(self.odd_split(bit))
        if len(new) > len(plain):  # long and odd words aren't kept
            for w in new.difference(plain):
                if len(w) > LONG:
                    del known[w]
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library gives them for the vocabulary at ``path`` without added begin or end tokens.

    A special token's string inside a text is that one token, as by the library's default. Null counts as empty: 0 tokens.
    Repeated rows each give a row; other columns are ignored. No shuffle; what a task remembers is bounded by REMEMBERED.
    """
    short_batches(docs.sparkSession)
    where = path or model_path("byte_bpe_50k.json")

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array(merges(where).texts(text.to_pylist()), pa.int64())

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return (rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
