import random
import re

import numpy as np
import pytest

from bagmeter.llm import leaks


def _words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def _brute(docs, items, passage=12):
    out = {}
    for d, t in docs:
        w = _words(t)
        for i, u in items:
            v = _words(u)
            best = (0, 0, 0)
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, (n, -a, -b))
            if best[0] >= passage and d is not None:
                out[d, i] = (best[0], -best[1], -best[2])
    return out


def _texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(8, 40))) for i in range(12)] + [(20, None), (21, ""), (22, "w1 w2")]
    items.append((23, items[0][1]))
    docs = []
    for d in range(40):
        t = text(rnd.randint(0, 60))
        if rnd.random() < 0.5:
            w = rnd.choice(items[:12])[1].split()
            at = rnd.randint(0, max(0, len(w) - 12))
            t += " ZZ-" + "--".join(w[at : at + rnd.randint(11, 20)]).upper() + ", " + text(5)
        docs.append((d, t))
    return [*docs, (100, None), (101, ""), (102, "..."), (None, items[0][1]), docs[3]], items


@pytest.mark.parametrize("shard", [1_000_000, 50])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "BLOCK", shard)
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    docs, items = _texts(1)
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, words string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, item_text string, id int")
    got = {(r["doc_id"], r["item_id"]): (r["longest"], r["doc_word"], r["item_word"]) for r in leaks.leaked(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == _brute(docs, items) and got


def test_many_passes_and_clean_documents(spark, monkeypatch):
    docs, items = _texts(2)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    monkeypatch.setattr(leaks, "PASS_BYTES", 400)
    found = leaks.leaked(d, "doc_id", "text", i, "item_id", "item_text")
    got = {(r["doc_id"], r["item_id"]): (r["longest"], r["doc_word"], r["item_word"]) for r in found.collect()}
    assert got == _brute(docs, items)
    kept = {r["doc_id"] for r in leaks.without_leaks(d, "doc_id", found).collect()}
    assert kept == {a for a, _ in docs} - {a for a, _ in got}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert leaks.leaked(d, "doc_id", "text", i, "item_id", "item_text").collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert leaks.leaked(one, "doc_id", "text", i, "item_id", "item_text").collect() == []


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(0)
    codes = rnd.integers(0, 3, 300)
    starts = np.flatnonzero(codes > 0)
    array, _ = leaks.suffix_array(codes, starts, 400)
    ended = [[*codes[s:].tolist(), 0] for s in array]
    cut = [tuple(c[: c.index(0) + 1]) for c in ended]
    assert cut == sorted(cut)


def test_a_passage_shared_by_many_items_and_copies():
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(200)]
    tests = leaks._Tests([(i, [f"a{i}", *shared, f"b{i}"]) for i in range(200)], 12)
    docs = [[f"x{d % 7}", *shared[d % 3 :], "y"] for d in range(2000)]
    codes = np.concatenate([[0, *([tests.names.index(w) + 1 if w in tests.names else 0 for w in d])] for d in docs[:3]])
    place, gram = leaks._places(codes, tests, 12)
    assert sum(len(p) for p, _ in leaks._pairs(codes, tests, place, gram)) == 3 * 200  # not times the words of the passage
    batch = pa.RecordBatch.from_arrays([pa.array(rnd.permutation(2000)), pa.array(docs)], ["id", "words"])
    rows = sum(b.num_rows for b in leaks._searcher(tests, 12)(iter([batch])))
    assert rows == 2000 * 200
