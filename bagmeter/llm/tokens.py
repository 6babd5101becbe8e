"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on the driver; Spark's file server hands them to the executors.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer pattern of byte_bpe_50k. White space is spelled out, as \s has fewer characters in Java.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)
#: Words whose ids a task keeps; beyond it the memory starts anew.
KEPT_WORDS = 300_000


class Vocabulary:
    """Ranks of a byte-level BPE and what follows from them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        starts: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                starts.setdefault(token[:2], set()).add(len(token))
        self.lengths = {start: tuple(sorted(some, reverse=True)) for start, some in starts.items()}
        size = max(self.ranks.values()) + 1
        # the two tokens that each token was merged from; a byte is made of itself
        self.left, self.right = np.arange(size), np.arange(size)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self._merged(token, below=rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
        merged = np.flatnonzero(self.left != np.arange(size))
        codes = self.left[merged] * size + self.right[merged]
        order = np.argsort(codes)
        self.pair_codes, self.pair_ids, self.size = codes[order], merged[order], size

    def _merged(self, word: bytes, below: float = float("inf")) -> list[int]:
        """Exact merging: always the adjacent pair of least rank, the first of equals; n log n steps for n bytes.

        A heap holds the ranks of adjacent pairs with their places; an entry counts only if the pair there still has its rank.
        """
        get, n = self.ranks.get, len(word)
        parts: list[bytes] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [(rank << 40) | i for i, rank in enumerate(pair) if 0 <= rank < below]
        heapq.heapify(heap)
        place = (1 << 40) - 1
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 40, entry & place
            if pair[i] != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            k = after[j]
            after[i], pair[j], parts[j] = k, -1, b""
            if k < n:
                before[k] = i
                pair[i] = fresh = get(parts[i] + parts[k], -1)
                if 0 <= fresh < below:
                    heapq.heappush(heap, (fresh << 40) | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = fresh = get(parts[h] + parts[i], -1)
                if 0 <= fresh < below:
                    heapq.heappush(heap, (fresh << 40) | h)
        return [self.ranks[p] for p in parts if p]

    def _proposed(self, word: bytes) -> list[int]:
        """Greedy longest match; only lengths that tokens with the same first bytes have are tried."""
        get, out, at, n = self.ranks.get, [], 0, len(word)
        while at < n:
            for length in self.lengths.get(word[at : at + 2], ()):
                rank = get(word[at : at + length]) if at + length <= n else None
                if rank is not None:
                    out.append(rank)
                    at += length
                    break
            else:
                out.append(self.ranks[word[at : at + 1]])
                at += 1
        return out

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging each pair makes, or a number beyond all."""
        codes = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ids[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging never crosses the border between tokens a and b, for all pairs at once.

        The merges of both tokens are undone in reverse order; a pair fails if at any
        time its tokens at the border would have been merged before the next merge.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            bad = self._joined(x, y) < most
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            undo_left = x > y
            x_in, y_in = self.right[x], self.left[y]
            whole_x, whole_y = x_in == x, y_in == y
            # undo the later merge; if that token is a byte, undo the other one
            left = (undo_left & ~whole_x) | (~undo_left & whole_y)
            ended = whole_x & whole_y
            limit[live] = np.where(left, x, y + 1)
            a[live], b[live] = np.where(left, x_in, x), np.where(left, y, y_in)
            live = live[~ended]
        return ok

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Speculate by longest match, verify every adjacent pair, merge exactly what fails."""
        out = [self._proposed(w) for w in words]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(out)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(codes // self.size, codes % self.size)[back] if len(codes) else np.zeros(0, bool)
        for i in np.unique(owner[inner[~fits]]):
            out[i] = self._merged(words[i])
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoder(file: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(file))
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("words")
            starts = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
            texts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(known) > KEPT_WORDS:
                known = {}
            new = [w for w in texts if w not in known]
            known.update(zip(new, (np.array(ids, np.int32) for ids in vocab.encode([w.encode() for w in new]))))
            per_word = [known[w] for w in texts]
            flat = np.concatenate(per_word) if per_word else np.zeros(0, np.int32)
            size = np.fromiter(map(len, per_word), np.int64, len(per_word))
            first = np.cumsum(size) - size
            # ids of every word in turn: the stretch of its dictionary entry
            lengths = size[index]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            take = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[index], lengths)
            ids = pa.ListArray.from_arrays(pa.array(ends[starts - starts[0]].astype(np.int32)), pa.array(flat[take]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    return encode


def token_ids(docs: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``id``, ``ids``: the tokens of each text without special tokens, one row per row of ``docs``.

    Texts are cut into words by the JVM; a task encodes each distinct word once, proposing
    tokens by longest match. A row of tokens is what merging gives if each adjacent
    pair is, so all pairs are checked at once and only words with a failing pair are merged
    step by step. A null or empty text gives an empty list; a special token's
    name in a text is ordinary text. Other columns aren't read.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))
    cut = docs.select(F.col(doc_id).cast("long").alias("id"), words.alias("words"))
    docs.sparkSession.sparkContext.addFile(f"{folder}/{name}.tiktoken")
    return cut.mapInArrow(_encoder(f"{name}.tiktoken"), "id long, ids array<int>")
