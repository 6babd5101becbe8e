import json

import pytest
from pyspark.sql import functions as F

from bagmeter.sources import bundle, checkpoint, files, manifest, scratch, store
from bagmeter.streaming import prevalence


def test_integrity(spark, tmp_path):
    for name in ("a.dat", "a.hea", "a.atr", "b.dat", "b.hea"):
        (tmp_path / name).write_bytes(b"x")
    listing = manifest.files(spark, str(tmp_path))
    assert [tuple(r) for r in manifest.incomplete(listing).collect()] == [("b", "atr")]
    assert not manifest.is_complete(listing, 1)
    (tmp_path / "b.atr").write_bytes(b"x")
    listing = manifest.files(spark, str(tmp_path))
    assert manifest.is_complete(listing, 2) and not manifest.is_complete(listing, 3)


def test_ingest_is_done_once(spark, tmp_path):
    class Two(manifest.Source):
        name, loads = "two", 0

        def load(self, spark):
            self.loads += 1
            return spark.range(2)

    source = Two()
    first = source.ingest(spark, str(tmp_path))
    assert source.ingest(spark, str(tmp_path)) == first and source.loads == 1 and first["n_records"] == 2
    source.ingest(spark, str(tmp_path), overwrite=True)
    assert source.loads == 2


def test_csv_and_missing_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text("bag_id,bag_size,method,classifier,mae,pred_pos,true_pos\n1,100,CC,RF,0.25,0.5,0.75\n")
    assert manifest.results_csv(spark, str(tmp_path / "r.csv")).first()["mae"] == 0.25
    assert manifest.try_read(spark, str(tmp_path / "none")) is None


def test_checkpoint_resumes(spark, tmp_path):
    check = checkpoint.ExperimentCheckpoint(spark, str(tmp_path / "c"))
    check.record_config({"a": [1, 2]})
    check.record_config({"a": (1, 2)})
    with pytest.raises(ValueError):
        check.record_config({"a": [2]})
    check.save(spark.createDataFrame([(1, 0.5)], "bag int, mae double"), "CC", 100)
    check.save(spark.createDataFrame([(2, 0.4, "z")], "bag int, mae double, more string"), "ACC", 100)
    again = checkpoint.ExperimentCheckpoint(spark, str(tmp_path / "c"))
    assert again.is_done("CC", 100) and not again.is_done("CC", 200)
    assert sorted((r["bag"], r["more"]) for r in again.results().collect()) == [(1, None), (2, "z")]
    work = spark.createDataFrame([("CC", 100), ("CC", 200), ("ACC", 100)], "q string, n int")
    assert [tuple(r) for r in again.pending(work, ["q", "n"]).collect()] == [("CC", 200)]
    assert not list((tmp_path / "c").glob("*.tmp"))
    assert checkpoint.ExperimentCheckpoint(spark, str(tmp_path / "c"), fresh=True).results() is None


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert checkpoint.fingerprint(df, ["id", "x"]) == checkpoint.fingerprint(df.orderBy(F.desc("id")), ["id", "x"])
    assert checkpoint.fingerprint(df, ["id", "x"]) != checkpoint.fingerprint(df.where("id > 0"), ["id", "x"])


def test_bundle_round_trip(spark, tmp_path):
    instances = spark.createDataFrame([(1, "N", "test"), (2, "V", "test"), (3, "N", "train")], "instance_id long, y string, split string")
    members = spark.createDataFrame([(2, 0, 0, 1), (2, 0, 1, 2)], "bag_size int, bag_index int, pos int, instance_id long")
    truth = spark.createDataFrame([(2, 0, "N", 0.5), (2, 0, "V", 0.5)], "bag_size int, bag_index int, label string, prevalence double")
    results = spark.createDataFrame([("CC", 0, 0.1)], "quantifier string, bag_index int, mae double")
    scores = spark.createDataFrame([(1, 0.25)], "instance_id long, p double")
    tables = {"instances": instances, "bag_members": members, "bag_truth": truth, "results": results, "scores": scores}
    bundle.export_bundle(str(tmp_path), "one", tables, {"seed": 7})
    bundle.export_bundle(str(tmp_path), "two", {"results": results.withColumn("zce", F.lit(0.0))}, {})
    read = bundle.ExportedBundle(spark, str(tmp_path))
    assert read.experiments == ["one", "two"] and read.splits("train").count() == 1 and read.results().count() == 2
    assert {r["instance_id"]: r["p"] for r in read.bag_instances(2, 0).collect()} == {1: 0.25, 2: None}
    assert dict(read.table("scores").dtypes)["p"] == "float"
    with pytest.raises(KeyError):
        read.owner("nothing")
    assert read.quantifiers() == ["CC"] and read.changed_environment() == {} and read.damaged() == []
    assert [(r["bag_size"], r["prevalence"]) for r in read.bags().collect()] == [(2, {"N": 0.5, "V": 0.5})]
    assert [(r["instance_id"], r["y"], r["p"]) for r in read.instance_outputs("test").collect()] == [(1, "N", 0.25)]
    read.index["environment"]["spark"] = "0"
    assert list(read.changed_environment()) == ["spark"]
    truth.limit(1).write.mode("overwrite").parquet(str(tmp_path / "one/bag_truth"))
    assert read.damaged() == ["one/bag_truth"]
    with pytest.raises(FileNotFoundError):
        bundle.ExportedBundle(spark, str(tmp_path / "none"))
    wrong = truth.withColumn("prevalence", F.lit(0.9))
    with pytest.raises(ValueError):
        bundle.export_bundle(str(tmp_path), "three", tables | {"bag_truth": wrong}, {})


def test_scratch_tables(spark):
    df = scratch.stage(spark.range(10), "t")
    assert df.count() == 10 and df._scratch_path.startswith(scratch.shared_dir(spark))
    scratch.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._scratch_path)


def test_windowed_shares_of_table_and_stream(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 2} 10:00:00", "u", "NV"[i % 3 == 0]) for i in range(30)] + [(None, "u", "N"), ("2024-01-01 10:00:00", "u", "x")]
    df = spark.createDataFrame(rows, "t string, k string, y string").withColumn("t", F.to_timestamp("t"))
    batch = {str(r["window"]["start"]): (r["n"], round(r["share_N"], 6)) for r in prevalence.windowed_shares(df, "t", "k", "y", ("N", "V")).collect()}
    assert batch == {"2024-01-01 00:00:00": (15, round(10 / 15, 6)), "2024-01-02 00:00:00": (15, round(10 / 15, 6))}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = prevalence.windowed_shares(stream, "t", "k", "y", ("N", "V")).writeStream.outputMode("complete").format("memory").queryName("shares").start()
    query.processAllAvailable()
    query.stop()
    assert {str(r["window"]["start"]): (r["n"], round(r["share_N"], 6)) for r in spark.table("shares").collect()} == batch


def test_running_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "N"), ("a", "V"), ("b", "N"), ("b", None)], "k string, y string")
    stream = None
    for i in range(2):
        df.write.parquet(str(tmp_path / "in" / f"part{i}.parquet"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = prevalence.running_counts(stream, "k", "y", "N").writeStream.outputMode("update").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("totals").collect():
        last[r["key"]] = max(last.get(r["key"], (0, 0)), (r["n"], r["n_positive"]))
    assert last == {"a": (4, 2), "b": (4, 2)}


def test_pipeline_end_to_end(spark, tmp_path):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("no tables here")
    from bagmeter import pipeline

    first = pipeline.run_experiment(spark, data, str(tmp_path), ["CC", "ACC"])
    assert {r["quantifier"] for r in first.collect()} == {"CC", "ACC"}
    state = json.loads((tmp_path / "checkpoint/manifest.json").read_text())
    again = pipeline.run_experiment(spark, data, str(tmp_path), ["CC", "ACC", "GAC"])
    assert {r["quantifier"] for r in again.collect()} == {"CC", "ACC", "GAC"}
    now = json.loads((tmp_path / "checkpoint/manifest.json").read_text())
    assert len(state["done"]) == 2 and len(now["done"]) == 3
    pipeline.make_bundle(spark, data, str(tmp_path))
    assert bundle.ExportedBundle(spark, str(tmp_path / "bundle")).table("bag_members").count() > 0
    assert pipeline.prepare_splits(spark, data, str(tmp_path)).select("split").distinct().count() == 2


def test_small_files(spark, tmp_path):
    at = f"file://{tmp_path}/deep/x.json"
    assert files.read_json(spark, at) is None and files.names(spark, f"file://{tmp_path}/deep") == []
    for content in ({"a": [1, "é"]}, {"a": 2}):
        files.write_json(spark, at, content)
        assert files.read_json(spark, at) == content
    assert files.exists(spark, at) and "x.json" in files.names(spark, f"file://{tmp_path}/deep")
    files.delete(spark, at)
    assert not files.exists(spark, at)


def test_store_makes_each_artifact_once(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    kept, made = store.ArtifactStore(spark, f"file://{tmp_path}/store"), []
    make = lambda: made.append(1) or spark.range(3)
    fit = lambda: made.append(2) or Pipeline(stages=[SQLTransformer(statement="select id + 1 as j from __THIS__")]).fit(spark.range(1))
    for _ in range(2):
        assert kept.table(make, "scores", {"seed": 1}).count() == 3
        assert kept.model(fit, "lr").transform(spark.range(2)).agg(F.sum("j")).first()[0] == 3
        assert kept.record(lambda: made.append(3) or {"t": 0.5}, "temperature", 7) == {"t": 0.5}
    assert made == [1, 2, 3] and sorted(e["kind"] for e in kept.entries()) == ["model", "record", "table"]
    kept.drop("scores", {"seed": 1})
    assert not kept.has("scores", {"seed": 1}) and kept.has("lr")
