"""Documents that contain passages of held-out texts, found by suffix arrays of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagmeter.sources.scratch import stage

#: Words of a passage that counts as leaked.
PASSAGE = 12
#: Words in one shard; a task builds one suffix array after another.
SHARD_WORDS = 1_000_000
#: Pairs of a place and a test suffix that are extended at once.
BLOCK = 1_000_000
#: Bytes of held-out text that are searched in one pass; more texts make more passes.
PASS_BYTES = 16_000_000


def words(text: Column) -> Column:
    """The longest runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in order of the suffixes there, and the rank of each, up to ``depth`` words.

    Prefix doubling: ranks by one word, then two, four and so on; suffixes that agree in
    ``depth`` words share a rank. Code 0 ends a suffix.
    """
    n = len(codes)
    rank = np.concatenate([codes.astype(np.int64), np.zeros(depth + 1, np.int64)])
    reached = 1
    while reached < depth:
        step = min(reached, depth - reached)
        key = rank[:n] * (rank.max() + 1) + rank[step : n + step]
        values, inverse = np.unique(key[codes > 0], return_inverse=True)
        fresh = np.zeros(n, np.int64)
        fresh[codes > 0] = inverse + 1
        rank = np.concatenate([fresh, np.zeros(depth + 1, np.int64)])
        reached += step
        if len(values) == len(inverse):
            break
    order = np.argsort(rank[starts], kind="stable")
    return starts[order], rank[starts][order]


def _bounds(codes: np.ndarray, array: np.ndarray, query: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all rows of ``query`` (prefixes of equal length) in the suffix array at once."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(array))
    width = query.shape[1]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        suffix = codes[array[mid][:, None] + np.arange(width)]
        differs = suffix != query[open_]
        at = differs.argmax(axis=1)
        rows = np.arange(len(open_))
        less = np.where(differs.any(axis=1), suffix[rows, at] < query[open_][rows, at], right)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word codes (0 between documents and for words that no test text has), the document of each and its place there."""
    codes, owners, places, size = [], [], [], 0
    for batch in batches:
        lists = batch.column("words")
        starts = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        code = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ids = batch.column("id").to_numpy()
        codes.append(np.insert(code, starts[1:], 0))
        owners.append(np.insert(np.repeat(ids, np.diff(starts)), starts[1:], ids))
        places.append(np.insert(np.arange(len(code)) - np.repeat(starts[:-1], np.diff(starts)), starts[1:], 0))
        size += len(codes[-1])
        if size >= SHARD_WORDS:
            yield np.concatenate(codes), np.concatenate(owners), np.concatenate(places)
            codes, owners, places, size = [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owners), np.concatenate(places)


class _Tests:
    """All suffixes of the test texts of a pass, those with equal first words as one query."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int) -> None:
        long = [(item, ws) for item, ws in items if len(ws) >= passage]
        self.names = sorted({w for _, ws in long for w in ws})
        place = {w: i + 1 for i, w in enumerate(self.names)}
        # a 0 before each text and after the last
        self.codes = np.array([c for _, ws in long for c in (0, *(place[w] for w in ws))] + [0], np.int64)
        self.deepest = max((len(ws) for _, ws in long), default=0)
        heads = np.flatnonzero(self.codes == 0)[:-1] + 1
        count = np.array([len(ws) - passage + 1 for _, ws in long], np.int64)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        froms = np.repeat(heads, count) + at
        items_of = np.repeat(np.array([item for item, _ in long], np.int64), count)
        grams = self.codes[froms[:, None] + np.arange(passage)] if len(froms) else np.zeros((0, passage), np.int64)
        self.grams, gram = np.unique(grams, axis=0, return_inverse=True)
        # suffixes by gram, then by the word before them
        self.key = gram.ravel() * (len(self.names) + 1) + self.codes[froms - 1]
        order = np.argsort(self.key, kind="stable")
        self.key, self.froms, self.items, self.at = self.key[order], froms[order], items_of[order], at[order]


def _places(codes: np.ndarray, tests: _Tests, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a shard whose suffix begins as some test suffix does, and which gram that is."""
    # a match needs `passage` words of the test vocabulary in a row; other suffixes stay out of the array
    gap = np.where(codes == 0, np.arange(len(codes)), len(codes))
    run_end = np.minimum.accumulate(gap[::-1])[::-1]
    starts = np.flatnonzero(run_end - np.arange(len(codes)) >= passage)
    padded = np.concatenate([codes, np.zeros(tests.deepest + passage, np.int64)])
    array, _ = suffix_array(codes, starts, tests.deepest) if len(starts) else (starts, starts)
    lo, hi = _bounds(padded, array, tests.grams, False), _bounds(padded, array, tests.grams, True)
    hits = np.flatnonzero(hi > lo)
    times = hi[hits] - lo[hits]
    return array[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - lo[hits], times)], np.repeat(hits, times)


def _pairs(codes: np.ndarray, tests: _Tests, place: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and test suffixes that begin alike and have different words before them, in blocks of about :data:`BLOCK`.

    A match that can be extended to the left is a part of another one, so a passage that many documents
    and items share gives one pair for each of their occurrences, not one for each of its words.
    """
    word = np.where(place > 0, codes[place - 1], 0)
    width = len(tests.names) + 1
    first, last = (np.searchsorted(tests.key, (gram + i) * width) for i in (0, 1))
    same = np.searchsorted(tests.key, gram * width + word)
    beyond = np.where(word > 0, np.searchsorted(tests.key, gram * width + word, side="right"), same)
    size = (same - first) + (last - beyond)
    block = np.cumsum(size) // BLOCK
    for rows in np.split(np.arange(len(place)), np.flatnonzero(np.diff(block)) + 1):
        n = size[rows]
        if n.sum():
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(rows, n)
            left = same[owner] - first[owner]
            yield place[owner], np.where(at < left, first[owner] + at, beyond[owner] + at - left)


def _searcher(tests: _Tests, passage: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(tests.names, pa.string())
        texts = np.concatenate([tests.codes, np.zeros(tests.deepest + passage, np.int64)])
        for codes, owners, places in _shards(batches, vocabulary):
            padded = np.concatenate([codes, np.zeros(tests.deepest + passage, np.int64)])
            for where, suffix in _pairs(codes, tests, *_places(codes, tests, passage)):
                froms, length, live = tests.froms[suffix], np.full(len(where), passage), np.arange(len(where))
                while len(live):
                    x, y = padded[where[live] + length[live]], texts[froms[live] + length[live]]
                    live = live[(x == y) & (x > 0)]
                    length[live] += 1
                doc, item, doc_at, item_at = owners[where], tests.items[suffix], places[where], tests.at[suffix]
                order = np.lexsort((item_at, doc_at, -length, item, doc))
                best = np.ones(len(order), bool)
                d, i = doc[order], item[order]
                best[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
                out = order[best]
                numbers = [doc[out], item[out], length[out].astype(np.int32), doc_at[out].astype(np.int32), item_at[out].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["doc_id", "item_id", "longest", "doc_word", "item_word"])

    return search


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int = PASSAGE) -> DataFrame:
    """``doc_id``, ``item_id``, ``longest``, ``doc_word``, ``item_word``: documents that hold ``passage`` or more words of an item in a row.

    Each task cuts its documents into shards, builds a suffix array of the words of a shard,
    and binary-searches every different suffix of the test texts in it; what begins with the same
    ``passage`` words is extended to the longest verbatim match, whose first word is number ``doc_word`` of the document and
    ``item_word`` of the item, from 0 (of equally long ones, the first in the document, then in the item). Documents aren't
    shuffled. The test texts are sent to the tasks in passes of bounded size, all of
    them, however many there are; the matches of a pass are written before the next texts are fetched.

    Null, empty and short texts match nothing; items that share text each match; repeated
    documents each match, and a document id that comes twice counts once. Other columns aren't read.
    """
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    n_bytes = known.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    passes = 1 + n_bytes // PASS_BYTES
    cut = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), words(F.col(text)).alias("words"))
    out = None
    for k in range(passes):
        some = known.where(F.pmod(F.xxhash64(item_id), F.lit(passes)) == k)
        tests = _Tests([(r[0], r[1]) for r in some.select(F.col(item_id).cast("long"), words(F.col(item_text))).distinct().collect()], passage)
        found = cut.mapInArrow(_searcher(tests, passage), "doc_id long, item_id long, longest int, doc_word int, item_word int")
        if passes > 1:
            found = stage(found, "leaks")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("longest", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.longest", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word")
    )


def without_leaks(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage; rows with a null id are kept."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
