"""Whole validations, global data and texels over containers built byte by byte."""

import struct

import numpy as np
import pytest
from prismlake.operators import globaldata, report, texels
from prismlake.sources import container
from pyspark.sql import functions as F
from test_sources import LEVELS, META, RGBA, made, version1

GOOD = {"KTXwriter": b"test\0", "KTXorientation": b"rd\0"}


def plain(scheme=container.NONE, **k):
    return container.build(37, 1, (4, 4, 0), LEVELS, RGBA, GOOD, scheme=scheme, **k)


def patched(raw, at, new):
    return raw[:at] + new + raw[at + len(new) :]


def judged(spark, files, gltf=False):
    ex = container.examined(spark.createDataFrame(list(files.items()), "path string, content binary")).coalesce(1).cache()
    rows = report.issues(ex, gltf).collect()
    found = spark.createDataFrame(rows, "path string, stage int, place string, id int, severity string, rule string").coalesce(1)
    return ex, found, {k: sorted((r.stage, r.id) for r in rows if r.path == k) for k in files}


@pytest.fixture
def interpreted(spark):
    """Without generated code: hundreds of small expressions are compiled for longer than they run."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


def test_files_that_end_early(spark):
    raw = plain()
    dfd_at, dfd_size, kvd_at = struct.unpack_from("<3I", raw, 48)
    files = {"good": raw, "zlib": plain(container.ZLIB), "null": None, "empty": b"", "other": b"x" * 99, "old": version1(), "head": raw[:79], "dfd": raw[: dfd_at + dfd_size - 1], "kvd": raw[: kvd_at + 3], "payload": raw[:-5]}
    # the file has no descriptor: its level index is what it ends within
    files["index"] = patched(raw, 48, bytes(8))[:100]
    ex, found, got = judged(spark, files)
    assert got["good"] == got["zlib"] == [] and got["null"] == got["empty"] == got["head"] == [(0, 1003)] and got["other"] == got["old"] == [(0, 2001)]
    assert got["dfd"] == [(2, 1003)] and got["kvd"] == [(4, 1003)] and got["payload"] == [(7, 5005)]
    assert (3, 1003) in got["index"] and (1, 3020) in got["index"] and all(stage <= 3 for stage, _ in got["index"])
    verdicts = {r.path: (r.valid, r.stopped_at) for r in report.verdict(ex, found).collect()}
    assert verdicts["good"] == (True, None) and verdicts["dfd"] == (False, 2) and verdicts["payload"] == (False, 7)
    assert {r.path for r in report.admitted(ex, found).collect()} == {"good", "zlib"}
    documents = {r.path: r.report for r in report.document(ex, found).collect()}
    assert '"valid":true,"messages":[]' in documents["good"] and '"id":1003,"type":"fatal","message":"UnexpectedEOF"' in documents["kvd"]
    assert [r.line for r in report.as_lines(found.where("path = 'kvd'")).collect()] == ["fatal-1003: UnexpectedEOF"]


def test_errors_of_all_steps(spark):
    raw = plain()
    dfd_at, _, kvd_at, kvd_size = struct.unpack_from("<4I", raw, 48)
    deflated = plain(container.ZLIB)
    files = {
        "width": patched(raw, 20, bytes(4)),
        "section": patched(raw, 52, struct.pack("<I", 12)),
        "model": patched(raw, dfd_at + 12, b"\2"),
        "level": patched(raw, 88, struct.pack("<Q", 60)),
        "key": patched(raw, kvd_at + 4, b"X"),
        "padding": patched(raw, kvd_at + kvd_size, b"\7") if struct.unpack_from("<Q", raw, 80 + 48)[0] > kvd_at + kvd_size else raw,
        "length": patched(deflated, 96, struct.pack("<Q", 65)),
        "damaged": deflated[:-4] + b"\0\0\0\0",
        "twice": container.build(37, 1, (4, 4, 0), LEVELS, RGBA, META),
    }
    _, found, got = judged(spark, files)
    assert (0, 3006) in got["width"] and (1, 3021) not in got["section"] and (1, 3028) in got["section"] and (2, 6015) in got["model"]
    assert (3, 4005) in got["level"] and (4, 7010) in got["key"] and got["twice"] == [(4, 7010)]
    assert got["length"] == [(7, 4008)] and got["damaged"] == [(7, 5006)]
    places = {(r.id, r.place) for r in found.where("path = 'level'").collect()}
    assert (4005, "0") in places


def test_gaps_by_hand(spark):
    assert container.gaps([("a", 100, 10), ("b", 0, 5), ("c", 104, 20), ("d", 130, 1)], 90) == [("a", 90, 10), ("d", 124, 6)]
    odd = bytearray(container.build(0, 1, (4, 4, 0), [b"x" * 16], RGBA, GOOD, alignment=64))
    at = struct.unpack_from("<Q", odd, 80)[0]
    odd[at - 1] = 9
    row = dict(zip(container.EXAMINED_NAMES, container.examine(lambda a, n: bytes(odd[a : a + n]), len(odd)), strict=True))
    assert row["paddings"] == [("image level 0", at - 1)]
    _, _, got = judged(spark, {"a": bytes(odd)})
    assert (6, 7011) in got["a"]


# ------------------------------------------------------------------ global data


def lz_file(images, lengths=(6, 4, 2, 0), extra=b"", samples=2, anim=False, level=b"L" * 100, header=None, layers=0):
    """A BASIS_LZ container with the given descriptors (flags, rgb offset and length, alpha offset and length)."""
    books = b"".join(bytes([65 + k]) * n for k, n in enumerate(lengths))
    section = (header or struct.pack("<2H4I", 3, 5, *lengths)) + b"".join(struct.pack("<5I", *x) for x in images) + books + extra
    block = container.basic_descriptor([(64 * i, 64, (0, 15)[i], 0, 0, 0xFFFFFFFF) for i in range(samples)], model=163, transfer=2, block=(3, 3, 0, 0), planes=(8, 8 if samples == 2 else 0, *[0] * 6))
    meta = GOOD | ({"KTXanimData": bytes(12)} if anim else {})
    raw = bytearray(container.build(0, 1, (4, 4, 0), [level], block, meta, layers=layers))
    raw[44:48] = struct.pack("<I", 1)
    at = struct.unpack_from("<Q", raw, 80)[0]
    dfd_at, dfd_size, kvd_at, kvd_size = struct.unpack_from("<4I", raw, 48)
    start = -(-(kvd_at + kvd_size) // 8) * 8
    raw = raw[: kvd_at + kvd_size] + bytes(start - kvd_at - kvd_size) + section + level
    raw[64:80] = struct.pack("<2Q", start, len(section))
    raw[80:104] = struct.pack("<3Q", start + len(section), len(level), 0)
    assert at
    return bytes(raw)


FINE = (0, 0, 50, 50, 50)


def test_global_data_of_files(spark):
    files = {
        "fine": lz_file([FINE]),
        "frames": lz_file([FINE, (2, 0, 50, 50, 50)], layers=2, anim=True),
        "still": lz_file([FINE, (2, 0, 50, 50, 50)], layers=2),
        "flag": lz_file([(5, 0, 50, 50, 50)]),
        "zero": lz_file([(0, 0, 0, 50, 50)]),
        "rgb": lz_file([(0, 60, 41, 50, 50)]),
        "wrap": lz_file([(0, 2**32 - 1, 2, 50, 50)]),
        "alpha": lz_file([(0, 0, 50, 51, 50)]),
        "no alpha": lz_file([(0, 0, 50, 0, 0)]),
        "one": lz_file([FINE], samples=1),
        "long": lz_file([FINE], extra=b"xx"),
        "extended": lz_file([FINE], lengths=(6, 4, 2, 1)),
        "tiny": lz_file([], lengths=(), header=bytes(12)),
        "few": lz_file([FINE], layers=2),
    }
    _, found, got = judged(spark, files)
    ids = {k: [i for stage, i in v if stage == report.GLOBAL] for k, v in got.items()}
    assert ids == {
        "fine": [], "frames": [], "still": [8105], "flag": [8104], "zero": [8106], "rgb": [8107], "wrap": [8107], "alpha": [8108], "no alpha": [8109], "one": [8110],
        "long": [8102], "extended": [8103], "tiny": [8101], "few": [8102],
    }
    assert got["fine"] == [] and found.where("path = 'flag' AND id = 8104").first().place == "0/0/0/0"


def test_global_data_is_compared(spark):
    names = ["texture_id", "sc_scheme", "width", "height", "depth", "layers", "faces", "levels", "global_data"]
    ex = container.examined(spark.createDataFrame([("a", lz_file([FINE])), ("b", lz_file([(4, 0, 50, 50, 50)], lengths=(6, 5, 2, 0)))], "path string, content binary")).withColumn("texture_id", F.lit(1))
    side = lambda p: ex.where(F.col("path") == p).select(names)
    diff = lambda **k: {(r.path, r.left_value, r.right_value) for r in globaldata.differences(side("a"), side("b"), **k).collect()}
    fields = {("images/0/flags", "0", "4"), ("selectors_length", "4", "5")}
    assert diff() == fields | {("selectors_data", None, None)}
    assert diff(ignore="payload") == fields and diff(ignore="all") == set()
    assert globaldata.differences(side("a"), side("a")).count() == 0


# ------------------------------------------------------------------ texels


def bits_of(raw, c):
    """A channel's code by plain shifts."""
    whole, out, at = int.from_bytes(raw, "little"), 0, 0
    for start, n in c.ranges:
        out |= (whole >> start & ((1 << n) - 1)) << at
        at += n
    return out - (1 << c.bits) if c.signed and out >> (c.bits - 1) else out


def test_every_target_goes_there_and_back(spark, interpreted):
    """All formats that are packed to: codes decode as by plain shifts and pack to the same bits; floats come back as they were."""
    rng = np.random.default_rng(5)
    forms = {n: (texels.layout(n), source) for n, (_, source, _) in texels.targets().items()}
    assert len(forms) == 78
    raw = [bytes(rng.integers(0, 256, 16, dtype=np.uint8).tolist()) for _ in range(30)]
    cut = lambda f: F.col("raw").substr(F.lit(1), F.lit(f.size))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw binary").coalesce(1)
    read = lambda table, texel: table.select("i", *[(texels.values if source == "float" else texels.codes)(texel(n, f), f)[k].alias(f"{n}:{k}") for n, (f, source) in forms.items() for k in range(4)]).orderBy("i").toPandas()
    first = read(df, lambda n, f: cut(f))
    for n, (f, source) in forms.items():
        if source != "float":
            for c in f.channels:
                assert list(first[f"{n}:{'RGBA'.index(c.letter)}"]) == [bits_of(r[: f.size], c) for r in raw], (n, c)
    given = spark.createDataFrame(first.astype({c: "int64" if forms[c.split(":")[0]][1] != "float" else "float64" for c in first.columns if c != "i"})).coalesce(1)

    def packed(n, f, source):
        pixel = [F.col(f"`{n}:{k}`") for k in range(4)]
        depth = max(c.bits for c in f.channels)
        if f.channels[0].padded:
            pixel, depth = [F.shiftleft(p, 16 - depth) for p in pixel], 16
        return texels.packed(pixel, f, source, depth).alias(n)

    again = read(given.select("i", *[packed(n, *fs) for n, fs in forms.items()]), lambda n, f: F.col(n))
    for n, (f, source) in forms.items():
        depth = max(c.bits for c in f.channels)
        for c in f.channels:
            at = f"{n}:{'RGBA'.index(c.letter)}"
            v, w = first[at].to_numpy(float), again[at].to_numpy(float)
            if c.exponent:
                peak = first[[f"{n}:{k}" for k in range(3)]].to_numpy(float).max(1)
                assert (np.abs(v - w) <= peak / 256).all(), n
            elif source != "unorm" or c.bits == depth:
                assert ((v == w) | (np.isnan(v) & np.isnan(w))).all(), (n, c)


def test_floats_are_encoded_as_numpy_does(spark):
    rng = np.random.default_rng(1)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-9, 6, 300)), 0.0, -0.0, 65504.0, 65519.0, 65520.0, 1e30, 5.9e-8, 2.0**-14, 2.0**-24, 2.0**-25, float("inf"), -float("inf"), float("nan")]
    single = np.array(values, np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(single)], "i int, v double").orderBy("i")
    half = df.select(texels.encoded_float(F.col("v"), 5, 10, True).alias("h"), texels.encoded_float(F.col("v"), 8, 23, True).alias("f")).toPandas()
    want = single.astype(np.float16).view(np.uint16).astype(int)
    # ties go away from zero here and to even there
    ours = half["h"].to_numpy()
    magnitude = np.abs(single.astype(float))
    tie = np.isfinite(single) & (np.abs(magnitude - (ours & 0x7FFF).astype(np.uint16).view(np.float16).astype(float)) == np.abs(magnitude - (want & 0x7FFF).astype(np.uint16).view(np.float16).astype(float)))
    sign = np.signbit(single) & (single != 0)
    assert (((ours & 0x7FFF) == (want & 0x7FFF)) | tie | np.isnan(single)).all() and ((ours >> 15 == 1) == sign).all()
    assert (half["f"].to_numpy()[np.isfinite(single) & (single != 0)] == single.view(np.uint32)[np.isfinite(single) & (single != 0)]).all()


def test_layouts_and_precision(spark):
    assert texels.layout("BC1_RGB_UNORM_BLOCK") is None and texels.layout("R64_UINT") is None and texels.layout("UNDEFINED") is None
    assert {n for n in texels.targets() if n.startswith("A1")} == {"A1R5G5B5_UNORM_PACK16", "A1B5G5R5_UNORM_PACK16"}
    assert texels.from_samples([(0, 8, 0, 0, 0, 255)], 1).channels == texels.layout("R8_UNORM").channels
    shared = texels.from_samples([(0, 9, 0, 0, 0, 8448), (27, 5, 0, 2, 15, 31), (9, 9, 1, 0, 0, 8448), (27, 5, 1, 2, 15, 31), (18, 9, 2, 0, 0, 8448), (27, 5, 2, 2, 15, 31)], 4)
    row = spark.createDataFrame([(struct.pack("<I", 256 | 128 << 9 | 511 << 18 | 16 << 27),)], "t binary")
    assert [list(r) for r in row.select(*texels.values(F.col("t"), shared)).collect()] == [[1.0, 0.5, 511 / 256, 1.0]]
    got = spark.createDataFrame([(8, 10), (16, 10), (16, 8), (8, 8), (4, 8)], "given int, needed int").select("needed", *[texels.precision(F.col("given"), n).alias(str(n)) for n in (8, 10)]).collect()
    assert [r[str(r.needed)] for r in got] == ["error", None, "warning", None, None]
    none = spark.createDataFrame([(1, None, 2, 2), (2, b"", 0, 0), (3, bytes(3), 3, 1)], "i int, payload binary, width int, height int")
    assert [(r.i, r.x, r.c0) for r in texels.pixels(none.where("payload is not null"), texels.layout("R8_UNORM")).collect()] == [(3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)]


# ------------------------------------------------------------------ rewriting


def test_deflated_files_validate(spark):
    from prismlake.sources import rewriting

    files = {"plain": plain(), "zlib": plain(container.ZLIB), "own": container.build(37, 1, (4, 4, 0), LEVELS, RGBA, GOOD | {"KTXwriter": b"ktx create 4\0", "KTXwriterScParams": b"--encode x --zlib 3\0"}), "lz": lz_file([FINE]), "none": b"x"}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    out = {r.path: r for r in rewriting.deflated(df, container.ZSTD, 7, "prism 1").collect()}
    assert {k: r.status for k, r in out.items()} == {"plain": "ok", "zlib": "ok", "own": "ok", "lz": "other supercompression", "none": "unknown identifier"}
    good = {k: bytes(r.content) for k, r in out.items() if r.content is not None}
    _, _, got = judged(spark, good)
    assert got == {"plain": [], "zlib": [], "own": []}
    for k, raw in good.items():
        row = dict(zip(container.NAMES, container.parse(raw), strict=True))
        meta = {key: v for _, key, v in row["metadata"]}
        assert row["sc_scheme"] == container.ZSTD and [x[4] for x in row["level_index"]] == LEVELS
        assert (meta["KTXwriter"], meta["KTXwriterScParams"]) == ((b"ktx create 4\0", b"--encode x --zstd 7\0") if k == "own" else (b"prism 1\0", b"--zstd 7\0"))


def test_images_are_set(spark):
    from prismlake.operators import rewrite

    images = spark.createDataFrame([(1, 0, 0, f, 0, 16 + 8 * f, 8) for f in range(3)], "texture_id int, level int, layer int, face int, slice int, image_offset long, image_size long")
    new = spark.createDataFrame([(1, 1, 0, 0, 1, 0, b"A" * 8), (1, 2, 0, 0, 1, 0, b"B" * 8), (1, 3, 0, 0, 2, 0, b"C" * 7), (1, 4, 0, 0, 9, 0, b"D" * 8)], "texture_id int, seq int, level int, layer int, face int, slice int, bytes binary")
    payloads = spark.createDataFrame([(1, b"." * 40), (2, b"xy"), (3, None)], "texture_id int, payload binary")
    got = {r.texture_id: r.payload for r in rewrite.patched(payloads, rewrite.image_patches(images, new)).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: b"." * 24 + b"B" * 8 + b"." * 8, 2: b"xy", 3: None}


def test_patches_against_a_plain_splice(spark):
    from prismlake.operators import rewrite

    rng = np.random.default_rng(3)
    rows, patches, want = [], [], {}
    for key in range(12):
        body = bytearray(rng.integers(0, 256, 60, dtype=np.uint8).tobytes())
        rows.append((key, bytes(body)))
        own = [(key, int(s), int(rng.integers(-3, 58)), bytes([200 + int(s)]) * int(rng.integers(0, 25))) for s in rng.permutation(20)[:key]]
        patches += own
        for _, _, at, b in sorted(own, key=lambda p: p[1]):
            if b and at >= 0 and at + len(b) <= 60:
                body[at : at + len(b)] = b
        want[key] = bytes(body)
    got = rewrite.patched(spark.createDataFrame(rows, "texture_id int, payload binary"), spark.createDataFrame(patches, "texture_id int, seq int, at int, bytes binary"))
    assert {r.texture_id: bytes(r.payload) for r in got.collect()} == want


# ------------------------------------------------------------------ info


def test_documents_of_files(spark):
    import json

    from prismlake.operators import info

    odd = container.build(37, 1, (4, 4, 0), LEVELS, RGBA, GOOD | {"bin": b"\xff\x00\x01"})
    ex = container.examined(spark.createDataFrame([("a", odd), ("lz", lz_file([FINE, (2, 1, 2, 3, 4)], layers=2, anim=True)), ("none", b"x")], "path string, content binary")).coalesce(1).cache()
    got = {r.path: r.info and json.loads(r.info) for r in info.document(ex).collect()}
    assert got["none"] is None
    a = got["a"]
    assert a["header"] == {"vkFormat": "VK_FORMAT_R8G8B8A8_UNORM", "typeSize": 1, "pixelWidth": 4, "pixelHeight": 4, "pixelDepth": 0, "layerCount": 0, "faceCount": 1, "levelCount": 3, "supercompressionScheme": "KTX_SS_NONE"}
    assert [x["byteLength"] for x in a["index"]["levels"]] == [64, 16, 4] and a["index"]["supercompressionGlobalData"] == {"byteOffset": 0, "byteLength": 0}
    block = a["dataFormatDescriptor"]["blocks"][0]
    assert (block["colorModel"], block["transferFunction"], block["texelBlockDimension"], block["bytesPlane"][0]) == ("KHR_DF_MODEL_RGBSDA", "KHR_DF_TRANSFER_LINEAR", [1, 1, 1, 1], 4)
    assert [(s["channelType"], s["bitOffset"], s["bitLength"], s["qualifiers"], s["sampleUpper"]) for s in block["samples"]] == [(n, 8 * i, 8, [], 255) for i, n in enumerate(["RED", "GREEN", "BLUE", "ALPHA"])]
    assert a["keyValueData"] == {"KTXorientation": "rd", "KTXwriter": "test", "bin": "FF0001"} and "supercompressionGlobalData" not in a
    data = got["lz"]["supercompressionGlobalData"]
    assert (data["type"], data["endpointCount"], data["selectorsByteLength"]) == ("KTX_SS_BASIS_LZ", 3, 4)
    assert data["images"] == [{"imageFlags": [], "rgbSliceByteLength": 50, "rgbSliceByteOffset": 0, "alphaSliceByteLength": 50, "alphaSliceByteOffset": 50}, {"imageFlags": ["ETC1S_P_FRAME"], "rgbSliceByteLength": 2, "rgbSliceByteOffset": 1, "alphaSliceByteLength": 4, "alphaSliceByteOffset": 3}]
    facts = ex.where("vk_format is not null").select("path", info.components().alias("n"), info.largest_channel_bits().alias("b"), info.transcodable().alias("t"), info.high_range().alias("h"), info.refused_encoding("basis").alias("r"), info.refused_encoding("uastc-hdr").alias("u")).collect()
    assert {r.path: tuple(r)[1:] for r in facts} == {"a": (4, 8, False, False, None, "format"), "lz": (4, 64, True, False, "supercompressed", "supercompressed")}


# ------------------------------------------------------------------ export


def test_raw_images_are_written(spark, tmp_path):
    import os

    from prismlake.operators import export
    from prismlake.sources import datasource

    datasource.register(spark)
    images = spark.createDataFrame([(1, v, a, 0, 0, 2, 1, 2, 1, a * (4 >> v), 4 >> v) for v in range(2) for a in range(2)] + [(1, 0, 9, 0, 0, 2, 1, 2, 1, 7, 4)], "texture_id int, level int, layer int, face int, slice int, levels int, faces int, layers int, depth int, offset int, size int")
    payloads = spark.createDataFrame([(1, 0, b"abcdefgh"), (1, 1, b"wxyz")], "texture_id int, level int, bytes binary")
    out = str(tmp_path / "out")
    export.raw_images(images, payloads).select("name", "content").write.format("texture").mode("append").save(out)
    assert {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)} == {"output_level0_layer0.raw": b"abcd", "output_level0_layer1.raw": b"efgh", "output_level1_layer0.raw": b"wx", "output_level1_layer1.raw": b"yz"}
    one = images.limit(1).selectExpr("1 AS levels", "6 AS faces", "0 AS layers", "4 AS depth", "0 AS level", "2 AS face", "0 AS layer", "3 AS slice")
    assert one.select(export.names(one)).first()[0] == "output_face2_depth3"


def test_chroma_blocks_by_hand(spark):
    from prismlake.operators import export

    one = spark.createDataFrame([(1, 0, 0, 10, 20, 100, 200)], "i int, y int, bx int, y0 int, y1 int, u int, v int")
    assert [(r.x, r.r, r.g, r.b) for r in export.chroma_pixels(one, ["i"], 8).orderBy("x").collect()] == [(0, 200, 10, 100), (1, 200, 20, 100)]
    two = one.union(spark.createDataFrame([(1, 0, 1, 30, 40, 0, 100)], one.schema))
    # samples in the middle of their block, luma at the quarters
    got = {r.x: (r.r, r.g, r.b) for r in export.chroma_pixels(two, ["i"], 8, u=1.0, v=1.0).collect()}
    assert got == {0: (200, 10, 100), 1: (175, 20, 75), 2: (125, 30, 25), 3: (100, 40, 0)}
    assert export.chroma_pixels(two.limit(0), ["i"], 8).count() == 0
