"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice of a text has an edge for every piece that matches. Only a window of the last positions is held, as long as
the longest piece; whenever the backpointer paths of all positions in the window meet on one boundary, the ids before it
are committed and forgotten. Unigram models take the best sum of scores. In models of merged pairs a path is admissible
if each two neighbours stay apart when merged on their own; exactly one path to each position is, and it is what the
merges in score order give, so the same lattice, window and commit rule serve.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model_path, short_batches, text_or_empty

#: The sign that stands for a blank.
MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and the penalty of an unknown character.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
#: Remembered words (in each of two generations) and pairs of a worker; longer words go through the stream and are forgotten.
REMEMBERED, PAIRS, LONG = 250_000, 200_000, 64


class Pieces:
    """A model's pieces with their scores."""

    def __init__(self, path: str, as_unigram: bool = False):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name not in ("identity", "") or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normalizer and blanks as prefixes")
        self.unigram = as_unigram or model.trainer_spec.model_type == UNIGRAM
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.score = [p.score for p in model.pieces]
        self.longest = max(map(len, self.id))
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.floor = min(model.pieces[i].score for i in self.id.values()) - UNKNOWN_PENALTY
        self.bytes = np.array([bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER) else
                      b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in model.pieces], dtype=object)
        # pieces never run over the start of a word, so words are encoded one by one
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.begun = {p[:k]: -1 for p in self.id for k in range(1, len(p))} | self.id  # -1: only the beginning of pieces
        self.words: dict[str, bytes] = {}  # ids as packed 32-bit integers
        self.earlier: dict[str, bytes] = {}
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        # signs that no piece holds behind a letter: before them a word can be cut, as no piece runs over the cut
        behind = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.tails = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair of neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether two neighbours are left alone when merged on their own; without a first one, whether a piece is made at all."""
        if self.pairs > PAIRS:
            self.apart, self.pairs = {}, 0
        self.pairs += 1
        known = self.apart.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """A piece's id; an unknown character falls back to bytes where the model has them."""
        k = self.id.get(piece)
        if k is not None:
            return (k,)
        raw = piece.encode("utf-8", "surrogatepass")
        return tuple(self.byte[b] for b in raw) if self.byte else (self.unknown,)

    def expand(self, text: str, lo: int, hi: int, back: list[int], best: list[float], last: list[str | None]) -> None:
        """Relaxes the edges that start at positions lo to hi - 1; back, best and last are by the position where an edge ends."""
        begun, score, apart, unigram, n = self.begun.get, self.score, self.apart, self.unigram, len(text)
        for start in range(lo, hi):
            before = last[start]
            beside = apart.get(before) or {}
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                k = begun(piece)
                if k is None and end > start + 1:
                    break
                if k != -1 or end == start + 1:  # a single character is an edge even if it's unknown
                    if unigram:
                        total = best[start] + (self.floor if k is None or k < 0 else score[k])
                        if last[end] is None or total > best[end]:
                            back[end], best[end], last[end] = start, total, piece
                    elif last[end] is None:
                        fine = beside.get(piece)
                        if fine if fine is not None else self.stay_apart(before, piece):
                            back[end], last[end] = start, piece
                if k is None:
                    break

    def stream(self, chars: Iterator[str]) -> Iterator[tuple[int, ...]]:
        """Ids of a stream of characters, committed as soon as every surviving path agrees on them."""
        text, done, wait = "", 0, self.longest  # characters after the last commit, positions expanded, when to look for a commit
        back, best, last = [0], [0.0], [""]
        for c in chars:
            text += c
            back.append(0)
            best.append(0.0)
            last.append(None)
            if len(text) - done >= self.longest:  # every piece from this position fits into what is held
                self.expand(text, done, done + 1, back, best, last)
                done += 1
                if done >= wait:
                    meet = self.meeting(back, last, done)
                    if meet:
                        yield from self.path(back, last, meet)
                        text, done, back = text[meet:], done - meet, [b - meet for b in back[meet:]]
                        best, last = [b - best[meet] for b in best[meet:]], last[meet:]
                    wait = done + self.longest
        self.expand(text, done, len(text), back, best, last)
        yield from self.path(back, last, len(text))

    @staticmethod
    def meeting(back: list[int], last: list[str | None], done: int) -> int:
        """The latest boundary on the paths of all positions that are reached but not expanded yet."""
        alive = {done, *(e for e in range(done, len(last)) if last[e] is not None)}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(back[top])
        return alive.pop()

    def path(self, back: list[int], last: list[str], end: int) -> list[tuple[int, ...]]:
        out = []
        while end > 0:
            out.append(self.ids_of(last[end]))
            end = back[end]
        return out[::-1]

    def remembered(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.earlier.get(word)
            self.words[word] = ids = self.encode_word(word) if ids is None else ids
        return ids

    def encode_word(self, word: str) -> bytes:
        core = word.rstrip(self.tails)
        if len(core) < len(word) and core[-1:].isalpha():
            return self.remembered(core) + self.remembered(word[len(core):])
        n = len(word)
        if n > LONG:
            return self.packed(self.stream(iter(word)))
        back, best, last = [0] * (n + 1), [0.0] * (n + 1), ["", *[None] * n]
        self.expand(word, 0, n, back, best, last)
        return self.packed(self.path(back, last, n))

    @staticmethod
    def packed(path: Iterable[tuple[int, ...]]) -> bytes:
        return array("i", chain.from_iterable(path)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Words are remembered in two generations, so that a full memory forgets only what wasn't met lately."""
        if not text:
            return np.empty(0, np.int32)
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        words = self.split(marked) if self.by_word else [marked]
        known = self.words
        for word in set(words).difference(known):
            self.remembered(word)
        out = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
        if len(known) > REMEMBERED:
            self.earlier, self.words = {w: ids for w, ids in known.items() if len(w) <= LONG}, {}
        return out

    @staticmethod
    def split(marked: str) -> list[str]:
        """Words with the blanks before them."""
        parts = marked.split(MARK)
        if "" not in parts[1:]:
            return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]
        out, blanks = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            blanks += MARK
            if p:
                out.append(blanks + p)
                blanks = ""
        return [*out, blanks] if blanks else out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: bytes are joined, marks become blanks, the added first blank goes."""
        text = b"".join(self.bytes[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every whole text under the model at ``path``.

    ``round_trip``: decoding the ids gives the text again (the mark itself reads as a blank). Null counts as empty and has
    no ids. Repeated rows each give a row; other columns are ignored. No shuffle; memory is one batch, the window, and
    remembered words.
    """
    short_batches(docs.sparkSession)
    where = path or model_path("piece_bpe_32k.model")

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(where)
        for batch in part:
            offsets, flat, fine = [0], [], []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text)
                flat.append(ids)
                offsets.append(offsets[-1] + len(ids))
                fine.append(model.decode(ids) == text.replace(MARK, " "))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(offsets), pa.int64()), pa.array(fine, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
