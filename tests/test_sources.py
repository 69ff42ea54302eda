"""Containers synthesised byte by byte, round trips, and the stream."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from prismlake.operators import catalog, compare, descriptor, formats, validate
from prismlake.sources import container, datasource, either, legacy, pnm
from prismlake.streaming import incoming

RGBA = container.basic_descriptor([(8 * i, 8, (0, 1, 2, 15)[i], 0, 0, 255) for i in range(4)], transfer=1, planes=(4, *[0] * 7))
LEVELS = [bytes(range(64)), bytes(16), b"abcd"]
META = {"KTXwriter": b"test\0", "KTXorientation": b"rd\0", "empty": b""}


def made(scheme=container.NONE, **k):
    return container.build(37, 1, (4, 4, 0), LEVELS, RGBA, META, scheme=scheme, **k)


@pytest.mark.parametrize("scheme", [container.NONE, container.ZSTD, container.ZLIB])
def test_round_trip(scheme):
    r = dict(zip(container.NAMES, container.parse(made(scheme), "p"), strict=True))
    assert (r["status"], r["vk_format"], r["width"], r["levels"], r["sc_scheme"], r["transfer"]) == ("ok", 37, 4, 3, scheme, 1)
    assert [x[4] for x in r["level_index"]] == LEVELS and [x[3] for x in r["level_index"]] == [64, 16, 4]
    assert [(k, v) for _, k, v in r["metadata"]] == sorted(META.items())
    assert [s[:4] for s in r["samples"]] == [(0, 8, 0, 0), (8, 8, 1, 0), (16, 8, 2, 0), (24, 8, 15, 0)]
    offsets = [x[1] for x in r["level_index"]]
    assert offsets == sorted(offsets, reverse=True)


def test_lazy_and_deflated_reads():
    assert {x[4] for x in container.parse(made(), payload=False)[22]} == {None}
    raw = container.parse(made(container.ZLIB), inflated=False)[22]
    assert [zlib.decompress(x[4]) for x in raw] == LEVELS
    assert container.parse(made(), metadata=False)[24] is None


@pytest.mark.parametrize(
    ("raw", "status"),
    [(b"", "unknown identifier"), (b"x" * 200, "unknown identifier"), (container.IDENTIFIER, "unexpected end"), (made()[:-1], "unexpected end"), (made(container.ZLIB)[:-3] + b"\0\0\0", "damaged payload"), (container.IDENTIFIER_V1 + bytes(60), "version 1 file")],
)
def test_broken_files(raw, status):
    assert container.parse(raw)[1] == status


def test_reserved_keys_are_refused():
    with pytest.raises(ValueError):
        container.build(37, 1, (4, 4, 0), LEVELS, RGBA, {"KTXmine": b""})


def test_spark_source_and_sink(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    spark.createDataFrame([("a.tex", made()), ("b.tex", made(container.ZSTD)), ("c.bin", b"no")], "name string, content binary").write.format("texture").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["a.tex", "b.tex", "c.bin"]
    for df in (spark.read.format("texture").load(out), container.read(spark, out)):
        assert {os.path.basename(r.path): r.status for r in df.collect()} == {"a.tex": "ok", "b.tex": "ok", "c.bin": "unknown identifier"}
        assert container.levels_of(df).where("bytes is not null").count() == 6 and container.metadata_of(df).count() == 6 and container.samples_of(df).count() == 8
    lazy = spark.read.format("texture").option("payload", "false").load(out)
    assert container.levels_of(lazy).where("bytes is not null").count() == 0
    # equal payloads, whatever the compression
    files = {n: container.levels_of(spark.read.format("texture").load(f"{out}/{n}")).drop("path") for n in ("a.tex", "b.tex")}
    assert compare.payload(files["a.tex"], files["b.tex"], ["level"]).count() == 0


def test_deflate_columns(spark):
    t = spark.createDataFrame([(b"x" * 1000,), (b"",)], "b binary")
    for scheme in (container.ZSTD, container.ZLIB):
        small = t.select("b", container.deflate_column(F.col("b"), scheme).alias("d"))
        assert all(r.b == r.i for r in small.select("b", container.inflate_column(F.col("d"), scheme).alias("i")).collect())


def test_section_rules_hold_for_built_files(spark):
    good = spark.createDataFrame([("good", made()), ("bad", made()[:48] + struct.pack("<I", 8) + made()[52:])], "path string, content binary")
    got = {(r.path, r.rule) for r in validate.raised(container.parsed(good), validate.section_rules(), "path").collect()}
    assert {p for p, _ in got} == {"bad"} and ("bad", "IndexDFDInvalidOffset") in got


def test_stream_of_dropped_files(spark, tmp_path):
    drop, seen = tmp_path / "drop", []
    drop.mkdir()
    (drop / "a.tex").write_bytes(made())
    (drop / "b.tex").write_bytes(b"nothing")
    q = incoming.issues(incoming.files(spark, str(drop))).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(os.path.basename(r.path), r.id, r.severity) for r in seen} == {("b.tex", 2001, "fatal")}


def version1(order="<"):
    meta = b"".join(struct.pack(f"{order}I", len(e)) + e + bytes(-len(e) % 4) for e in (b"KTXorientation\0S=r,T=d\0", b"KTXother\0x", b"mine\0y"))
    head = legacy.IDENTIFIER_V1 + struct.pack(f"{order}13I", legacy.ENDIAN, 0x1401, 1, 0x1908, 0x8058, 0x1908, 2, 2, 0, 0, 1, 1, len(meta))
    return head + meta + struct.pack(f"{order}I", 16) + bytes(range(16))


@pytest.mark.parametrize("order", ["<", ">"])
def test_version1(spark, order):
    files = spark.createDataFrame([("v1", version1(order)), ("no", b"")], "path string, content binary")
    rows = legacy.parsed(files)
    assert {r.path: r.status for r in rows.collect()} == {"v1": "ok", "no": "unknown identifier"}
    (r,) = legacy.to_version2(rows).collect()
    assert (r.vk_format, r.width, r.type_size) == (37, 2, 1) and bytes(r.level_bytes[0]) == bytes(range(16))
    assert [(m.key, bytes(m.value)) for m in r.metadata] == [("KTXorientation", b"rd\0"), ("mine", b"y")]


def test_pnm(spark):
    two = pnm.write([1, 2, 3, 4, 5, 6], 2, 1, 3) + b"P5 # note\n2 1\n1000\n" + struct.pack(">2H", 7, 999)
    got = pnm.parsed(spark.createDataFrame([("a", two), ("b", b"P6 1 1 255\n\0"), ("c", b"")], "path string, content binary")).collect()
    assert [(r.path, r.subimage, r.status, r.channels, r.bits, r.pixels) for r in got] == [("a", 0, "ok", 3, 8, [1, 2, 3, 4, 5, 6]), ("a", 1, "ok", 1, 16, [7, 999]), ("b", 0, "unexpected end", None, None, None)]


def block(*entries, tail=b""):
    return b"".join(struct.pack("<I", len(e)) + e + bytes(-len(e) % 4) for e in entries) + tail


@pytest.mark.parametrize(
    ("raw", "ids"),
    [
        (block(b"a\0x", b"b\0"), []),
        (block(*[b"k%03d\0" % i for i in range(101)]), [7001]),
        (block(b"a\0x", tail=b"\2\0"), [7002]),
        (struct.pack("<I", 40) + b"key\0abcd", [7003]),
        (block(b"a", b"b\0"), [7004]),
        (block(b"nokey"), [7005]),
        (block(b"\xef\xbb\xbfkey\0v"), [7006]),
        (block(b"\xff\xfe\0v"), [7007]),
        (struct.pack("<I", 6) + b"key\0v\0"[:6], [7008]),
        (struct.pack("<I", 5) + b"key\0v\1\1\1", [7011]),
    ],
)
def test_key_value_blocks(raw, ids):
    assert [i for i in container._metadata(raw)[1] if i != 7004 or ids == [7004]] == ids


def test_entries_up_to_the_limit_are_kept():
    pairs, issues = container._metadata(block(*[b"k%03d\0" % i for i in range(150)]))
    assert len(pairs) == 100 and issues == [7001]


@pytest.mark.parametrize(
    ("change", "ids"),
    [
        (lambda d: d, []),
        (lambda d: struct.pack("<I", 9) + d[4:], [6001]),
        (lambda d: d[:4] + struct.pack("<I", 7 | 1 << 17) + d[8:], [6003, 6008]),
        (lambda d: struct.pack("<I", len(d) + 4) + d[4:] + b"\0\0\0\0", [6004]),
        (lambda d: struct.pack("<I", 2 * len(d) - 4) + d[4:] + d[4:], [6005]),
        (lambda d: d[:10] + struct.pack("<H", 4) + d[12:12], [6001, 6006, 6008]),
        (lambda d: d[:10] + struct.pack("<H", 200) + d[12:], [6007, 6008]),
        (lambda d: struct.pack("<IIHH", 20, 0, 2, 16) + d[12:20], [6010]),
    ],
)
def test_descriptor_bytes(change, ids):
    assert container._descriptor(change(RGBA))[2][4] == ids


def test_header_to_offsets(spark):
    """Sizes and offsets from a parsed header (no array, so 0 layers) meet the file's own level index; known sizes of 3D textures."""
    files = container.parsed(spark.createDataFrame([("a", made())], "path string, content binary"))
    t = formats.facts(files).select(F.lit(1).alias("texture_id"), "width", "height", "depth", "faces", "layers", "levels", F.col("fact.block_w").cast("long").alias("block_w"), F.col("fact.block_h").cast("long").alias("block_h"), F.col("fact.block_bytes").cast("long").alias("block_bytes"), "sc_scheme")
    at = {r.level: r.byte_offset for r in catalog.level_offsets(t).collect()}
    own = {r.level: r.byte_offset for r in container.levels_of(files).collect()}
    assert t.first().layers == 0 and {k: v - own[2] for k, v in own.items()} == at
    assert [(r.level, r.layer, r.face, r.slice) for r in catalog.images(catalog.level_offsets(t)).orderBy("level").collect()] == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)]
    names = "texture_id long, width long, height long, depth long, faces long, layers long, levels long, block_w long, block_h long, block_bytes long, sc_scheme long"
    solid = spark.createDataFrame([(1, 8, 8, 4, 1, 0, 4, 1, 1, 4, 0), (2, 8, 8, 0, 1, 0, 0, 1, 1, 4, 0)], names)
    sizes = {(r.texture_id, r.level): r.level_size for r in catalog.levels(solid).collect()}
    assert sizes == {(1, 0): 1024, (1, 1): 128, (1, 2): 16, (1, 3): 4, (2, 0): 256}


def test_metadata_values_of_parsed_files(spark):
    meta = {"KTXorientation": b"rx\0", "KTXswizzle": b"rgb", "KTXmapRange": struct.pack("<2f", float("inf"), 0), "KTXwriterScParams": b"\xff\0", "KTXcubemapIncomplete": b"\xff", "KTXanimData": bytes(12)}
    raw = container.build(37, 1, (4, 4, 0), LEVELS, RGBA, meta)
    files = container.parsed(spark.createDataFrame([("a", raw)], "path string, content binary"))
    rows = container.metadata_of(files).withColumnRenamed("path", "texture_id")
    facts = files.withColumnRenamed("path", "texture_id").withColumn("linear_or_float", F.lit(True))
    got = {(r.key, r.id) for r in validate.metadata_issues(rows, facts).collect()}
    assert got == {
        ("KTXorientation", 7109), ("KTXswizzle", 7117), ("KTXswizzle", 7118), ("KTXmapRange", 7138), ("KTXwriterScParams", 7127), ("KTXwriter", 7124),
        ("KTXcubemapIncomplete", 7101), ("KTXcubemapIncomplete", 7102), ("KTXanimData", 7129), ("KTXanimData", 7130),
    }


def test_descriptors_of_built_files(spark):
    wrong = container.basic_descriptor([(8 * i, 8, (0, 1, 2, 15)[i], 0, 0, 255) for i in range(3)], model=1, transfer=2)
    files = container.parsed(spark.createDataFrame([("good", made()), ("bad", container.build(37, 1, (4, 4, 0), LEVELS, wrong, META))], "path string, content binary"))
    got = {(r.path, r.rule) for r in descriptor.issues(files.withColumn("gltf", F.lit(False)), "path").collect()}
    assert ("bad", "SampleCountMismatch") in got and ("bad", "BasicNotSRGBMismatch") in got and not any(p == "good" for p, _ in got)
    one = lambda p: files.where(F.col("path") == p).withColumn("texture_id", F.lit(1))
    assert {(r.sample, r.path) for r in descriptor.differences(one("good"), one("bad")).collect()} == {(None, "transfer"), (None, "planes"), *((3, f) for f in ("bit_offset", "bit_length", "channel", "qualifiers", "lower", "upper"))}


def test_both_versions_and_rewriting(spark):
    files = spark.createDataFrame([("two", made(container.ZSTD)), ("one", version1()), ("none", b"x"), ("short", container.IDENTIFIER_V1), ("nothing", None)], "path string, content binary")
    rows = {r.path: r for r in either.parsed(files).collect()}
    assert {k: (r.status, r.version) for k, r in rows.items() if k in ("one", "two")} == {"one": ("ok", 1), "two": ("ok", 2)}
    assert all(rows[k].status != "ok" for k in ("none", "short", "nothing"))
    assert [bytes(b) for b in rows["two"].level_bytes] == LEVELS and rows["one"].vk_format == 37
    again = container.parsed(either.rewritten(either.parsed(files), container.ZLIB))
    back = {r.path: r for r in again.collect()}
    assert {k: r.status for k, r in back.items()} == {"one": "ok", "two": "ok"}
    assert [bytes(x.bytes) for x in back["two"].level_index] == LEVELS and [bytes(x.bytes) for x in back["one"].level_index] == [bytes(range(16))]
    assert {m.key: bytes(m.value) for m in back["two"].metadata} == META
    assert descriptor.issues(again.withColumn("gltf", F.lit(False)), "path").count() == 0


def test_ranged_reads_of_levels(spark, tmp_path):
    """Filters reach the source: only the bytes of asked levels are fetched, and names decide before a file is opened."""
    datasource.register(spark)
    big = [bytes([k]) * (400_000 >> k) for k in range(4)]
    out = tmp_path / "levels"
    (out / "sub").mkdir(parents=True)
    for n, scheme in (("a.tex", container.NONE), ("sub/b.tex", container.ZLIB)):
        (out / n).write_bytes(container.build(37, 1, (8, 8, 0), big, RGBA, META, scheme=scheme))
    (out / "c.bin").write_bytes(b"no")
    (out / "v1.tex").write_bytes(version1())
    read = lambda **o: spark.read.format("texture_levels").options(**o).load(f"file://{out}")
    every = {(os.path.basename(r.path), r.level): r for r in read().collect()}
    assert len(every) == 10 and every["c.bin", None].status == "unknown identifier" and every["v1.tex", None].status == "version 1 file"
    assert all(bytes(every[f, k].bytes) == big[k] for f in ("a.tex", "b.tex") for k in range(4))
    taken = lambda df: df.selectExpr("sum(bytes_read)").first()[0]
    size = (out / "a.tex").stat().st_size
    assert size < taken(read().where("path LIKE '%a.tex'")) < size + 5000
    small = read().where("level = 3 AND path LIKE '%a.tex'")
    assert [bytes(r.bytes) for r in small.collect()] == [big[3]] and taken(small) <= 50_000 + 4096
    assert taken(read().where("level >= 2 AND sc_scheme = 0 AND width = 8")) <= 150_000 + 4096
    assert read().where("level IN (1, 2) AND NOT (sc_scheme <=> 2)").count() == 4 and read().where("width > 100").count() == 0 and read().where("level IS NULL").count() == 2
    lean = spark.read.format("texture_levels").schema("path string, level int, bytes_read bigint").load(str(out))
    assert lean.where("level = 0").count() == 2 and taken(lean) <= 4 * 4096
    assert taken(read(payload="false")) <= 4 * 4096
    # what could not be pushed is still judged
    assert read().where("length(bytes) = 200000").count() == 2 and read(inflate="false").where("level = 1 AND length(bytes) = 200000").count() == 1


def test_lazy_files_take_ranges(tmp_path):
    from prismlake.sources import ranged

    path = tmp_path / "x.tex"
    path.write_bytes(container.build(37, 1, (8, 8, 0), [bytes(10**6)], RGBA, META))
    with ranged.Ranged(str(path)) as r:
        row = container.parse_ranges(r, r.size, payload=False)
        assert row[1] == "ok" and r.taken == ranged.HEAD
    assert row[:22] == container.parse(path.read_bytes(), payload=False)[:22]
    with pytest.raises(FileNotFoundError):
        ranged.listed(str(tmp_path / "none"))


def test_raw_images(spark):
    from prismlake.sources import raw

    files = spark.createDataFrame([("a", bytes(range(64))), ("short", bytes(63)), ("none", None)], "path string, content binary")
    rows = raw.parsed(files, 37, 4, 4)
    assert {r.path: r.status for r in rows.collect()} == {"a": "ok", "short": "63 bytes instead of 64", "none": "0 bytes instead of 64"}
    (back,) = container.parsed(either.rewritten(rows)).collect()
    assert (back.path, back.status, back.vk_format, back.width) == ("a", "ok", 37, 4) and bytes(back.level_index[0].bytes) == bytes(range(64))
    assert [r.status for r in raw.parsed(files.limit(1), 131, 8, 8, layers=2).collect()] == ["ok"]
    with pytest.raises(ValueError):
        raw.parsed(files, 999, 1, 1)
