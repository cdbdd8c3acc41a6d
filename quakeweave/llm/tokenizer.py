"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. The different words of a batch lie
in one flat array of symbols; in each round the lowest-ranked pair of every word is found
by binary search over the sorted pair keys, and merged in all words at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NO_RANK = np.int32(2**31 - 1)
#: Words that a task remembers; beyond, it starts anew.
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Vocabulary:
    """``ranks`` of whole tokens; for pairs of tokens that make a token, sorted keys and its rank."""

    ranks: dict[bytes, int]
    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray


@lru_cache(maxsize=4)
def load_vocabulary(path: str = DEFAULT_RANKS) -> Vocabulary:
    """Read a file of base64 tokens with their ranks, one in a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                merged.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    byte_ids = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
    return Vocabulary(ranks, byte_ids, np.array(keys, np.int64)[order], np.array(merged, np.int32)[order])


class Encoder:
    """Encodes batches of texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, cache_words: int = CACHE_WORDS):
        self.v, self.find, self.cache_words = vocabulary, regex.compile(pattern).findall, cache_words
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.merged[at], _NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after merging, flat, and their number per word."""
        v = self.v
        size = np.array([len(w) for w in words], np.int64)
        sym = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym))
        # rank[k] is that of the pair of symbols k and k + 1.
        rank = np.full(len(sym), _NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(sym[:-1], sym[1:]), _NO_RANK)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            finished = least == _NO_RANK
            if finished.any():
                gone = np.repeat(finished, count)
                done_sym.append(sym[gone]), done_word.append(word[gone]), done_at.append(at[gone])
                sym, word, at, rank = sym[~gone], word[~gone], at[~gone], rank[~gone]
                least, count = least[~finished], count[~finished]
                if not len(sym):
                    break
                first = np.cumsum(count) - count
            low = np.repeat(least, count)
            hit = rank == low
            # Of hits that overlap, every second one counts, from the left.
            idx = np.flatnonzero(hit)
            run = np.r_[True, (np.diff(idx) > 1) | (word[idx[1:]] != word[idx[:-1]])]
            offset = np.arange(len(idx)) - np.maximum.accumulate(np.where(run, np.arange(len(idx)), 0))
            idx = idx[offset % 2 == 0]
            new = low[idx]
            # Merging all at once is the same as one by one from the left, unless a new pair ranks below the one just merged.
            fresh = sym.copy()
            fresh[idx] = new
            drop = np.zeros(len(sym), bool)
            drop[idx + 1] = True
            keep = ~drop
            sym2, word2, at2, rank2 = fresh[keep], word[keep], at[keep], rank[keep]
            pos = np.cumsum(keep)[idx] - 1
            touched = np.unique(np.r_[pos, np.maximum(pos - 1, 0)])
            touched = touched[touched < len(sym2) - 1]
            rank2[touched] = np.where(word2[touched] == word2[touched + 1], self._ranks(sym2[touched], sym2[touched + 1]), _NO_RANK)
            if len(sym2):
                rank2[-1] = _NO_RANK
            floor = np.full(len(words), -1, np.int64)
            floor[word[first]] = least
            early = np.unique(word2[touched[rank2[touched] < floor[word2[touched]]]])
            if len(early):
                # In these words only the leftmost pair is merged in this round.
                single = np.zeros(len(words), bool)
                single[early] = True
                lead = np.r_[True, word[idx[1:]] != word[idx[:-1]]]
                idx = idx[~single[word[idx]] | lead]
                fresh = sym.copy()
                fresh[idx] = low[idx]
                keep = np.ones(len(sym), bool)
                keep[idx + 1] = False
                sym2, word2, at2 = fresh[keep], word[keep], at[keep]
                rank2 = np.full(len(sym2), _NO_RANK, np.int32)
                rank2[:-1] = np.where(word2[:-1] == word2[1:], self._ranks(sym2[:-1], sym2[1:]), _NO_RANK)
            sym, word, at, rank = sym2, word2, at2, rank2
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        s, w, a = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_at)
        return s[np.argsort(a, kind="stable")], np.bincount(w, minlength=len(words))

    def _learn(self, new: list[str]) -> None:
        """Encode words and add them to what is remembered."""
        raw = [w.encode() for w in new]
        whole = [self.v.ranks.get(w) for w in raw]
        rest = [k for k, r in enumerate(whole) if r is None]
        sizes = np.ones(len(new), np.int64)
        flat_rest, size_rest = self.merge_words([raw[k] for k in rest]) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        sizes[rest] = size_rest
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        one = [k for k, r in enumerate(whole) if r is not None]
        flat[starts[one]] = [whole[k] for k in one]
        flat[_spans(starts[rest], size_rest)] = flat_rest
        self.starts = np.r_[self.starts, starts + len(self.flat)]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, flat]

    def _word_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Remembered indices of the words of all texts, flat, and their number per text."""
        if len(self.words) > self.cache_words:
            self._forget()
        known, out, sizes = self.words, [], np.zeros(len(texts), np.int64)
        before = len(known)
        for k, t in enumerate(texts):
            if t:
                found = self.find(t)
                sizes[k] = len(found)
                out += [known.setdefault(w, len(known)) for w in found]
        if len(known) > before:
            self._learn(list(known)[before:])
        return np.array(out, np.int64), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number per text; none for NULL and empty texts."""
        words, per_text = self._word_ids(texts)
        sizes = self.sizes[words] if len(words) else np.zeros(0, np.int64)
        ids = self.flat[_spans(self.starts[words], sizes)] if len(words) else np.zeros(0, np.int32)
        return ids, _sums(sizes, per_text)

    def count(self, texts: list[str | None]) -> np.ndarray:
        words, per_text = self._word_ids(texts)
        return _sums(self.sizes[words] if len(words) else np.zeros(0, np.int64), per_text)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return c[ends] - c[ends - sizes]


def _chunks(b: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Slices of a batch of (id, text) of about so many characters, one text at least."""
    texts = b.column(1).to_pylist()
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or k == len(texts) - 1:
            yield b.column(0).slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0


def encode_texts(df: DataFrame, key: str, text: str, *, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``ids``, the list of token ids of each text, without special tokens.

    The vocabulary file is read on the driver and sent to the executors (a few MB, as large
    as the vocabulary). Texts are encoded whole, in the tasks that read them; nothing is
    shuffled. Defined results: NULL and empty texts have an empty list; strings of special
    tokens are ordinary text; repeated keys give a row each; other columns are ignored; an
    empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for keys, texts in _chunks(b):
                ids, sizes = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    base = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return base.mapInArrow(run, f"`{key}` {base.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, *, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``n_tokens``; as ``encode_texts`` but without making the lists."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for keys, texts in _chunks(b):
                yield pa.RecordBatch.from_arrays([keys, pa.array(enc.count(texts), pa.int64())], names=[key, "n_tokens"])

    base = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return base.mapInArrow(run, f"`{key}` {base.schema[0].dataType.simpleString()}, n_tokens bigint")
