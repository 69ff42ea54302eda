"""The pipeline's stages on the fixture documents, each against what brute force allows."""

from collections import Counter

import corpus_pipeline
import pytest
from prismlake.llm import near_dedup, packing, quality_rules


@pytest.fixture
def sf_dir(docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, docs, labels, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        path = f"{sf_dir}/{name}"
        out.write.parquet(path)
        outs.append(at := spark.read.parquet(path))
    quality, lines, near, mixed, packed = outs
    judged = {r.doc_id for r in quality_rules.judge(docs, labels).collect() if r.kept}
    assert {r.doc_id for r in quality.collect()} == judged

    before = {r.doc_id: (r.text or "").split("\n") for r in quality.collect()}
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == judged
    for i, r in after.items():
        left, own = Counter((r.text or "").split("\n")), Counter(before[i])
        assert not (left - own - Counter([""])) and r.n_chars == len(r.text or "")

    sets = {i: near_dedup.shingle_set(r.text, 5) for i, r in after.items()}
    link = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = {r.doc_id for r in near.collect()}
    assert not any(link(a, b) for a in kept for b in kept if a < b)
    for i in set(after) - kept:
        assert any(link(i, j) for j in after if j != i)

    mixed_ids = {r.doc_id: r.text for r in mixed.collect()}
    assert set(mixed_ids) <= kept
    enc = packing.encoder()
    total = Counter()
    for r in packed.collect():
        total[r.doc_id] += r.length
    assert total == {i: len(enc.ids(t or "")) for i, t in mixed_ids.items()}

    run = sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert run == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed.collect())


def test_stages_define_odd_rows(spark, docs, labels, sf_dir):
    """Nulls in every column, repeats, ties, a very long text, clashing names and no rows at all."""
    from pyspark.sql import functions as F

    import random

    from conftest import words

    long = " ".join(words(random.Random(3), 30_000))
    other = " ".join(words(random.Random(4), 60))
    rows = [(None, f"{long} end", "en", None, 1), (7001, long, None, "src1", 2), (7001, long, None, "src1", 2), (7002, None, None, None, None), (None, None, None, None, None), (7003, "", "en", "src1", 0), (7001, other, "en", "src1", 3)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit(1) for c in ("at", "row", "key", "gone", "_lines_removed", "w", "id", "label", "probability")})
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: Counter((r.doc_id, "long" if len(r.text or "") > 1000 else r.text) for r in df.where("doc_id is null or doc_id > 7000").collect())
    given = seen(odd)
    for name in list(stages)[:-1]:
        out = stages[name](spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        got = seen(out)
        if name == "quality_rules":
            assert not got - given and all(t for _, t in got)
        if name == "line_dedup":
            assert got == Counter({(None, "long"): 1, (7001, ""): 2, (7002, None): 1, (None, None): 1, (7003, ""): 1, (7001, other): 1})
            assert out.where("n_chars <> length(coalesce(text, ''))").count() == 0
        if name == "near_dedup":
            assert got == Counter({(None, "long"): 1, (7002, None): 1, (None, None): 1, (7003, ""): 1, (7001, other): 1})
        if name == "mixing":
            assert not got - given
        none = stages[name](spark, odd.limit(0), sf_dir)
        assert none.columns == odd.columns and none.count() == 0
    packed = stages["packing"](spark, odd, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in odd.collect()}
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert stages["packing"](spark, odd.limit(0), sf_dir).count() == 0
