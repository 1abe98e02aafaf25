"""Encoding of texts with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The words of a batch that were not met before lie, as symbols, in one flat array. Each round finds the ranks of all
neighbouring pairs by binary search over the sorted pair keys, and merges in every word its lowest-rank pair; words
without a known pair leave. The vocabulary is read on the driver from a path that the caller gives and broadcast: its
size does not depend on the data.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits a text into the words inside which symbols are merged (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a word is merged with a heap, as rounds over it would be many.
LONG_WORD = 400
#: Words that a worker remembers.
REMEMBER = 400_000
NONE = np.int64(1 << 40)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files, as that format defines it."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Byte symbols and merges of a byte-level BPE; keys are sorted."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    words: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The vocabulary in a tokenizer's file; a file that asks for another way of encoding is refused."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not byte_level or not plain or said.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE without normalisation, split by the byte-level pattern")
        ids = model["vocab"]
        chars = _byte_chars()
        byte_ids = np.zeros(256, np.int64)
        for c, b in chars.items():
            byte_ids[b] = ids[c]
        size = max(ids.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        return cls(byte_ids, keys[order], order.astype(np.int64), merged[order], size)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if unknown), and where it stands among the keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [k for k, w in enumerate(words) if len(w) < LONG_WORD]
        for k, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[k] = self._merge_long(w)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        sym = self.byte_ids[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), sizes)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NONE)
            same = word[:-1] == word[1:]
            found, at = self.find(sym[:-1], sym[1:])
            rank[:-1] = np.where(same, found, NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(sym)])
            least = np.repeat(lowest, lengths)
            done = least == NONE
            if done.any():
                finished.append((word[done], sym[done]))
            hit = (rank == least) & ~done
            # of overlapping hits (runs of one symbol) the first, third, ... merge
            idx = np.flatnonzero(hit)
            if len(idx):
                begin = np.r_[True, np.diff(idx) != 1]
                begin |= word[idx] != word[np.r_[0, idx[:-1]]]
                run = idx[begin][np.cumsum(begin) - 1]
                idx = idx[(idx - run) % 2 == 0]
                sym[idx] = self.merged[at[idx]]
                gone = done
                gone[idx + 1] = True
                sym, word = sym[~gone], word[~gone]
            else:
                sym, word = sym[~done], word[~done]
        ids = np.concatenate([s for _, s in finished]).astype(np.int32)
        owner = np.concatenate([w for w, _ in finished])
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(short) + 1))
        for j, k in enumerate(short):
            out[k] = ids[bounds[j] : bounds[j + 1]]
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word: lowest rank first, leftmost among equals."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                key = a * self.size + b
                at = int(np.searchsorted(self.keys, key))
                hit = at < len(self.keys) and self.keys[at] == key
                known[a, b] = (int(self.ranks[at]), int(self.merged[at])) if hit else (-1, -1)
            return known[a, b]

        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := look(sym[i], sym[i + 1])[0]) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = look(a, b)[1], -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (r := look(sym[x], sym[nxt[x]])[0]) >= 0:
                    heapq.heappush(heap, (r, x, sym[x], sym[nxt[x]]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        import regex

        split = regex.compile(PATTERN).findall
        if len(self.words) > REMEMBER:
            self.words.clear()
        known, fresh, per_text = self.words, {}, []
        for t in texts:
            words = split(t) if t else []
            per_text.append(words)
            for w in words:
                if w not in known:
                    fresh[w] = None
        if fresh:
            for w, ids in zip(fresh, self.merge_words([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True):
                known[w] = ids
        counts, parts = np.zeros(len(texts), np.int64), []
        for k, words in enumerate(per_text):
            ids = [known[w] for w in words]
            counts[k] = sum(map(len, ids))
            parts += ids
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


def _slices(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes of text; a longer text is a part of its own."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(size)] if len(size) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def _mapper(broadcast, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        vocabulary = broadcast.value
        for whole in batches:
            for b in _slices(whole):
                ids, counts = vocabulary.encode(b.column("text").to_pylist())
                if counts_only:
                    yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(counts)], ["key", "n_tokens"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("key"), lists], ["key", "ids"])

    return run


def _encoded(df: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = df.schema[key].dataType
    last = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_mapper(vocabulary, counts_only), T.StructType([T.StructField("key", kind), last]))


def encode_corpus(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of every text under the byte-level BPE file at `path`, without special tokens.

    Null and empty texts both give the empty list; what looks like a special token is plain text; whole texts of any
    length are encoded; keys may repeat or be null; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    return _encoded(df, key, text, path, False).select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens): the number of ids that `encode_corpus` gives; 0 for null and empty texts."""
    return _encoded(df, key, text, path, True).select(F.col("key").alias(key), "n_tokens")
