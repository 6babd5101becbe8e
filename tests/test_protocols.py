import json

import pytest


def test_protocols_are_compared_on_the_given_beats(spark, tmp_path):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("no tables here")
    from bagmeter import pipeline

    assert {"CDE", "HDx", "ReadMe", "ED"} <= set(pipeline.registry())
    names = ["CC", "CDE", "HDx", "ED"]
    rows = pipeline.compare_protocols(spark, data, str(tmp_path), names).collect()
    done = json.loads((tmp_path / "protocols_checkpoint/manifest.json").read_text())["done"].values()
    assert sorted(e["unit"] for e in done) == sorted([n, p] for n in names for p in ("APP", "C-APP"))
    assert {r["quantifier"] for r in rows} == set(names)
    assert all(r["rank_shift"] == r["app_rank"] - r["capp_rank"] for r in rows)
