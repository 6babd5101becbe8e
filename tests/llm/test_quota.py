import collections

from bagmeter.llm import quota

ASK = "bag int, pool string, top string, label string, quota long"
HAVE = "pool string, top string, label string, available long"


def _allot(spark, asks, have):
    out = quota.allocate(spark.createDataFrame(asks, ASK), spark.createDataFrame(have, HAVE), ["bag"], ["pool"], ["top", "label"])
    return {(r["bag"], r["label"]): r for r in out.collect()}


def test_siblings_lend_before_cousins(spark):
    have = [("s", "N", "N", 10), ("s", "N", "L", 3), ("s", "V", "V", 50)]
    got = _allot(spark, [(1, "s", "N", "N", 12), (1, "s", "N", "L", 0), (1, "s", "V", "V", 5)], have)
    assert got[1, "N"]["shortfall"] == 2 and got[1, "N"]["allotted"] == 10
    assert got[1, "L"]["allotted"] == 2 and got[1, "V"]["allotted"] == 5


def test_cousins_lend_what_siblings_cannot(spark):
    have = [("s", "N", "N", 10), ("s", "N", "L", 3), ("s", "V", "V", 50)]
    got = _allot(spark, [(1, "s", "N", "N", 20), (1, "s", "V", "V", 5)], have)
    assert (got[1, "N"]["allotted"], got[1, "L"]["allotted"], got[1, "V"]["allotted"]) == (10, 3, 12)


def test_totals_hold_for_random_trees(spark):
    import random

    rnd = random.Random(3)
    tops = {x: "AB"[i % 2] for i, x in enumerate("abcdef")}
    have = [("s", t, x, rnd.randint(0, 20)) for x, t in tops.items()]
    asks = [(b, "s", t, x, rnd.randint(0, 12)) for b in range(20) for x, t in tops.items()]
    got = _allot(spark, asks, have)
    for b in range(20):
        asked, stock = sum(a[4] for a in asks if a[0] == b), sum(h[3] for h in have)
        assert sum(r["allotted"] for k, r in got.items() if k[0] == b) == min(asked, stock)
    for r in got.values():
        assert r["own"] <= r["allotted"] <= r["available"] and r["shortfall"] == max(0, r["quota"] - r["available"])


def test_nulls_empty_and_unknown_pools(spark):
    got = _allot(spark, [(1, None, "N", "N", 4), (2, "s", None, None, None)], [("s", "N", "N", 1)])
    assert got[1, "N"]["allotted"] == 0 and got[1, "N"]["shortfall"] == 4
    assert _allot(spark, [], []) == {}
    assert _allot(spark, [], [("s", "N", "N", 1)]) == {}


def test_draws_have_no_repeats_and_fill_the_allotment(spark):
    rows = [("s", "N", i, "x") for i in range(40)] * 2 + [("s", "V", i, "y") for i in range(100, 107)] + [("s", "V", None, "z")]
    pool = spark.createDataFrame(rows, "pool string, label string, unit long, rank string")
    ranked = quota.ranked_pool(pool, ["pool", "label"], "unit").persist()
    for label, n in (("N", 40), ("V", 7)):
        ranks = sorted(r["rank"] for r in ranked.where(f"label = '{label}'").collect())
        assert ranks == list(range(n))
    asks = spark.createDataFrame([(b, "s", "N", n) for b, n in ((1, 40), (2, 13))] + [(1, "s", "V", 7), (3, "s", "V", 0)], "bag int, pool string, label string, allotted long")
    drawn = quota.draw(asks, ranked, ["bag"], ["pool", "label"], "unit").collect()
    assert collections.Counter((r["bag"], r["label"]) for r in drawn) == {(1, "N"): 40, (2, "N"): 13, (1, "V"): 7}
    assert len({(r["bag"], r["unit"]) for r in drawn}) == len(drawn)


def test_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(quota, "RANK_BUCKET", 10)
    pool = spark.range(500).selectExpr("'a' as label", "id as unit")
    ranks = sorted(r["rank"] for r in quota.ranked_pool(pool, ["label"], "unit").collect())
    assert ranks == list(range(500))
