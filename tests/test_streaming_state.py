"""Rows of files over several batches: the stream gives what a batch gives, also after a restart, and gives up on files that stay incomplete."""

import json
import time

import pytest
from prismlake.operators import validate
from prismlake.streaming import assembly
from pyspark.sql import functions as F

NAMES = [x.split()[0] for x in assembly.LEVEL.split(", ")]


def level(k, offset, length, **change):
    return dict(zip(NAMES, (k, offset, length, length, length, 4, 0, 37, 1, 200), strict=True)) | change


FILES = {
    "good": [level(0, 220, 64), level(1, 204, 16), level(2, 200, 4)],
    "order": [level(0, 200, 64), level(1, 264, 16), level(2, 280, 4)],
    "sizes": [level(0, 220, 60), level(1, 204, 16, uncompressed_length=99), level(2, 200, 4)],
    "lz": [level(0, 216, 64, sc_scheme=1, alignment=1), level(1, 200, 16, sc_scheme=1, alignment=1, uncompressed_length=0)],
    "unknown": [level(0, 206, 6, vk_format=0, images=4, uncompressed_length=6), level(1, 201, 4, vk_format=0, uncompressed_length=0)],
}
KEYS = {"good": ["a", "b", "c"], "order": ["b", "a"], "sizes": ["x"]}


def parts():
    out = [(p, "level", r["level"], len(rows), json.dumps(r)) for p, rows in FILES.items() for r in rows]
    return out + [(p, "pair", i, len(ks), json.dumps({"ordinal": i, "key": k})) for p, ks in KEYS.items() for i, k in enumerate(ks)]


def batch_issues(spark):
    rows = spark.createDataFrame([(p, *[r[n] for n in NAMES]) for p, rows in FILES.items() for r in rows], "texture_id string, " + assembly.LEVEL)
    found = {(r.texture_id, r.id, r.rule) for r in validate.level_issues(rows).collect()}
    return found | {(p, 7012, "OutOfOrder") for p, ks in KEYS.items() if ks != sorted(ks)}


def test_lists_raise_what_windows_raise(spark):
    whole = spark.createDataFrame([(p, k, True, [b for q, kk, _, _, b in parts() if (q, kk) == (p, k)]) for p, k in {(p, k) for p, k, *_ in parts()}], assembly.WHOLE)
    assert {(r.path, r.id, r.rule) for r in assembly.issues(whole).collect()} == batch_issues(spark)
    assert len(batch_issues(spark)) > 8


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_equals_batch_after_a_restart(spark, rocks, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    names = ["path", "kind", "ordinal", "total", "body"]

    def drop(n, rows):
        (source / f"{n}.json.tmp").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        (source / f"{n}.json.tmp").rename(source / f"{n}.json")

    # a run over what is there ends only if waiting files start no batches of their own
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run():
        stream = spark.readStream.schema("path string, kind string, ordinal int, total int, body string").option("maxFilesPerTrigger", 1).json(str(source))
        q = assembly.assembled(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    every = parts()[::-1]
    drop(1, every[::2])
    drop(2, every[::3])  # repeats some
    run()
    before = spark.read.schema(assembly.WHOLE).parquet(str(out)).count()
    drop(3, every[1::2])
    drop(4, [("alone", "level", 0, 2, json.dumps(FILES["good"][0]))])
    run()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.schema(assembly.WHOLE).parquet(str(out))
    assert before < got.count() and got.where("not complete").count() == 0
    assert {(r.path, r.id, r.rule) for r in assembly.issues(got).collect()} == batch_issues(spark)


def test_incomplete_files_go_out(spark, rocks, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    names = ["path", "kind", "ordinal", "total", "body"]
    (source / "1.json").write_text(json.dumps(dict(zip(names, ("alone", "level", 0, 2, json.dumps(FILES["good"][0])), strict=True))))
    stream = spark.readStream.schema("path string, kind string, ordinal int, total int, body string").json(str(source))
    seen = []
    q = assembly.assembled(stream, 200).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="1 second").start()
    end = time.time() + 90
    while not seen and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert [(r.path, r.complete, len(r.bodies)) for r in seen] == [("alone", False, 1)]
    row = spark.createDataFrame(seen, assembly.WHOLE)
    assert (0, "IncompleteFile") in {(r.id, r.rule) for r in assembly.issues(row).collect()}
