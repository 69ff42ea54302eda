"""Catalog operators on values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from prismlake.functions import bits, channels, color, sizes
from prismlake.operators import catalog, compare, formats, image, metrics, selectors, validate


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sizes(spark):
    n = F.col("n")
    got = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 6, 8, 12)], "n long").select("n", sizes.lcm4(n).alias("l"), sizes.align(n, F.lit(4)).alias("a"), sizes.level_count(n).alias("c")).collect()
    for r in got:
        assert (r.l, r.a, r.c) == (math.lcm(r.n, 4), -(-r.n // 4) * 4, 1 + int(math.log2(r.n)))


def test_level_offsets_are_smallest_first(spark):
    t = spark.createDataFrame([(1, 5, 3, 1, 1, 2, 3, 4, 4, 8, 0)], "texture_id long, width long, height long, depth long, faces long, layers long, levels long, block_w long, block_h long, block_bytes long, sc_scheme long")
    got = {r.level: r for r in catalog.level_offsets(t).collect()}
    assert [(got[k].level_width, got[k].level_height, got[k].level_size, got[k].byte_offset) for k in range(3)] == [(5, 3, 32, 32), (2, 1, 16, 16), (1, 1, 16, 0)]
    assert catalog.images(catalog.level_offsets(t)).count() == 6
    assert [catalog.image_position(n, 2, 2, 6) for n in (0, 5, 6, 12, 23)] == [(0, 0, 0), (0, 0, 5), (0, 1, 0), (1, 0, 0), (1, 1, 5)]


@pytest.mark.parametrize(
    ("fragment", "ok", "ranges"),
    [("m=1", True, [(1, 2)]), ("m=0,2", True, [(0, 2)]), ("m=,3", True, [(0, 3)]), ("m=2,", True, [(2, None)]), ("a=1&m=4", True, [(4, 5)]), ("a=1", True, None), ("", True, None), ("t=1", False, None), ("m=x", False, None), ("m=1&", False, None), ("xywh=0,0,1,1", False, None)],
)
def test_fragments(spark, fragment, ok, ranges):
    f = F.lit(fragment)
    r = one(spark, selectors.valid(f).alias("ok"), selectors.ranges(f, "m").alias("r"))
    assert r.ok is ok
    if ok:
        assert (None if r.r is None else [tuple(x) for x in r.r]) == ranges


def test_fragment_bounds(spark):
    at = lambda f, n: one(spark, selectors.within(selectors.ranges(F.lit(f), "m"), F.lit(n)).alias("x")).x
    assert at("m=0,3", 3) and at("m=2", 3) and at("a=9", 3)
    assert not at("m=3", 3) and not at("m=0,4", 3) and not at("m=3,", 3)


def test_transfer_functions_invert(spark):
    v = F.col("v")
    t = spark.createDataFrame([(i / 50,) for i in range(51)], "v double")
    pairs = [(color.srgb_encode, color.srgb_decode), (color.itu_encode, color.itu_decode), (color.pq_encode, color.pq_decode), (lambda c: color.gamma_encode(c, 2.2), lambda c: color.gamma_decode(c, 2.2))]
    for enc, dec in pairs:
        assert t.select(F.max(F.abs(dec(enc(v)) - v)).alias("e")).first().e < 2e-4


def test_primaries_keep_white(spark):
    for target in ("bt2020", "displayp3", "adobergb", "bt601_smpte"):
        for row in color.conversion("bt709", target):
            assert sum(row) == pytest.approx(1, abs=1e-9)
    assert color.conversion("bt709", "bt2020")[0] == pytest.approx([0.6274, 0.3293, 0.0433], abs=1e-4)
    assert color.to_xyz("bt709")[1] == pytest.approx([0.2126, 0.7152, 0.0722], abs=1e-4)


def test_quantize(spark):
    t = spark.createDataFrame([(float("nan"),), (-0.5,), (0.0,), (0.5,), (1.0,), (7.0,)], "v double")
    assert [r.c for r in t.select(bits.float_to_unorm(F.col("v"), 8).alias("c")).collect()] == [0, 0, 0, 128, 255, 255]


def test_rescale(spark):
    v = F.lit
    r = one(spark, *[bits.rescale_unorm(v(a), s, t).alias(f"x{i}") for i, (a, s, t) in enumerate([(255, 8, 5), (132, 8, 5), (131, 8, 5), (31, 5, 8), (1, 1, 8), (0x12, 8, 16), (3, 2, 8), (2, 2, 8)])])
    assert list(r) == [31, 17, 16, 255, 255, 0x1212, 255, 0xAA]
    assert one(spark, bits.sign_extend(v(0xF0), 8).alias("x")).x == -16
    assert one(spark, bits.rescale_sint(v(0xF1), 8, 4).alias("x")).x == 0b1001
    assert one(spark, bits.pack([v(1), v(2), v(3)], [5, 6, 5]).alias("x")).x == 1 << 11 | 2 << 5 | 3
    assert one(spark, bits.swap_bytes(v(0x01020304), 4).alias("x")).x == 0x04030201


def test_half_floats(spark):
    import numpy as np

    codes = list(range(0, 65536, 97))
    got = spark.createDataFrame([(c,) for c in codes], "c long").select("c", bits.half_to_float(F.col("c")).alias("v")).collect()
    for r in got:
        want = float(np.array([r.c], np.uint16).view(np.float16)[0])
        assert r.v == want or math.isnan(r.v) and math.isnan(want)


def test_shared_exponent(spark):
    for rgb in [(0.0, 0.0, 0.0), (1.0, 0.5, 0.25), (1000.0, 3.0, 65000.0), (0.001, 0.0, 0.002)]:
        word = bits.pack_shared_exponent([F.lit(c) for c in rgb])
        back = one(spark, *[c.alias(n) for c, n in zip(bits.shared_exponent(word), "rgb", strict=True)])
        assert list(back) == pytest.approx(list(rgb), abs=max(rgb) / 256 + 1e-6)


def test_channels(spark):
    rgba = [F.lit(x) for x in (10, 20, 30, 40)]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(channels.swizzle(rgba, "a0r1", F.lit(255)))])) == [40, 0, 10, 255]
    with pytest.raises(ValueError):
        channels.swizzle(rgba, "rgbx", F.lit(255))
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(channels.expand(rgba[:1], F.lit(255)))])) == [10, 0, 0, 255]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(channels.premultiply([F.lit(255), F.lit(100)], F.lit(128), 8))])) == [128, 50]
    r = one(spark, *[c.alias(f"c{i}") for i, c in enumerate(channels.normalize([F.lit(255), F.lit(255), F.lit(255)], 8))])
    assert list(r) == [201, 201, 201]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(channels.normalize([F.lit(255), F.lit(128), F.lit(128)], 8))])) == [255, 128, 128]


def test_formats(spark):
    known = {r[1]: r for r in formats.rows()}
    # fixed points of the public numbering
    for name, number in {"R8G8B8A8_UNORM": 37, "R8G8B8A8_SRGB": 43, "R16G16B16A16_SFLOAT": 97, "R32G32B32A32_SFLOAT": 109, "E5B9G9R9_UFLOAT_PACK32": 123, "D32_SFLOAT_S8_UINT": 130, "BC1_RGB_UNORM_BLOCK": 131, "BC7_SRGB_BLOCK": 146, "ETC2_R8G8B8_UNORM_BLOCK": 147, "EAC_R11G11_SNORM_BLOCK": 156, "ASTC_4x4_UNORM_BLOCK": 157, "ASTC_12x12_SRGB_BLOCK": 184}.items():
        assert known[name][0] == number
    assert len(known) == 185 and formats.table(spark).where("srgb").count() == 7 + 5 + 3 + 14  # plain and packed, BC, ETC2, ASTC


def test_image_weights():
    for kernel in image.FILTERS:
        for wrap in ("clamp", "wrap", "reflect"):
            by: dict = {}
            for t, s, w in image.weights(9, 4, kernel, wrap):
                assert 0 <= s < 9
                by[t] = by.get(t, 0) + w
            assert all(v == pytest.approx(1) for v in by.values()) and len(by) == 4
    assert image.weights(4, 4, "box") == [(i, i, 1.0) for i in range(4)]


def test_mips_and_resample(spark):
    px = spark.createDataFrame([(1, x, y, float(x + 10 * y)) for x in range(4) for y in range(4)], "img long, x int, y int, v double")
    mips = {(r.level, r.mx, r.my): r.value for r in image.box_mip(px, "img", "x", "y", "v", 4, 4).collect()}
    assert mips[1, 0, 0] == pytest.approx(5.5) and mips[2, 0, 0] == pytest.approx(16.5) and len(mips) == 21
    half = {(r.tx, r.ty): r.value for r in image.resample(px, "img", "x", "y", "v", (4, 4), (2, 2), "box").collect()}
    assert half[0, 0] == pytest.approx(5.5) and half[1, 1] == pytest.approx(27.5)


def test_metrics(spark):
    t = spark.createDataFrame([(1, 0, 0, 10.0, 12.0), (1, 1, 0, 20.0, 18.0), (2, 0, 0, 5.0, 5.0)], "img long, x int, y int, a double, b double")
    got = {r.img: r.p for r in t.groupBy("img").agg(metrics.psnr(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got[1] == pytest.approx(10 * math.log10(255**2 / 4)) and got[2] is None
    s = {r.img: r.ssim for r in metrics.windowed_ssim(t, "img", "x", "y", "a", "a").collect()}
    assert s == pytest.approx({1: 1.0, 2: 1.0})
    assert {r.mapped for r in metrics.auto_range(t.withColumn("a", -F.col("a")), "img", "a").where("img = 1").collect()} == {0.0, 1.0}


def test_compare(spark):
    a = spark.createDataFrame([(1, "k", "v"), (1, "empty", ""), (2, "same", "x")], "texture_id long, key string, value string")
    b = spark.createDataFrame([(1, "k", "w"), (2, "same", "x"), (2, "new", "")], "texture_id long, key string, value string")
    got = {(r.texture_id, r.key): (r.kind, r.left_value, r.right_value) for r in compare.metadata(a, b).collect()}
    assert got == {(1, "k"): ("changed", "v", "w"), (1, "empty"): ("left", "", None), (2, "new"): ("right", None, "")}
    f = compare.fields(spark.createDataFrame([(1, 2, None), (3, 4, 5)], "id long, p long, q long"), spark.createDataFrame([(1, 2, 7)], "id long, p long, q long"), ["id"], ["p", "q"], "s")
    assert {(r.id, r.path, r.present) for r in f.collect()} == {(1, "q", "both"), (3, "p", "left"), (3, "q", "left")}


def test_validate_stops_at_the_first_fatal(spark):
    t = spark.createDataFrame([(1, 1, "error"), (1, 2, "fatal"), (1, 3, "error"), (2, 1, "warning")], "texture_id long, n long, severity string")
    assert {(r.texture_id, r.n) for r in validate.until_fatal(t, "n").collect()} == {(1, 1), (1, 2), (2, 1)}
    v = {r.texture_id: (r.n_errors, r.n_warnings, r.valid) for r in validate.verdict(t.select("texture_id").distinct(), t, warnings_as_errors=True).collect()}
    assert v == {1: (3, 0, False), 2: (0, 1, False)}


@pytest.mark.parametrize("name", sorted(image.FILTERS))
def test_kernels_are_even_and_keep_constants(name):
    f, half = image.FILTERS[name]
    assert all(f(d) == pytest.approx(f(-d)) for d in (0.1, 0.4, 0.7, 1.2, 2.3)) and abs(f(half + 0.01)) < 1e-9
    for n, t in ((8, 3), (5, 9)):
        taps = image.weights(n, t, name)
        for k in range(t):
            assert sum(w for a, _, w in taps if a == k) == pytest.approx(1)


def test_kernels_at_known_points():
    at = lambda n, d: image.FILTERS[n][0](d)
    assert at("blackman", 0) == pytest.approx(1, abs=1e-3) and at("blackman", 1) == pytest.approx(0, abs=1e-12)
    assert at("kaiser", 0) == pytest.approx(1) and at("kaiser", 2) == pytest.approx(0, abs=1e-12)
    assert at("quadratic_interp", 0) == 1 and at("quadratic_interp", 1) == 0 and at("quadratic_approx", 0) == 0.75
    assert at("gaussian", 0) == pytest.approx(math.sqrt(2 / math.pi), rel=1e-3)
