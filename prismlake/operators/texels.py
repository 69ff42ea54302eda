"""Texels: from bytes to channels and back, compiled from a format's layout to column expressions.

A layout says where each channel's bits lie in a texel. It comes from a
format's name (``layout``) or from the samples of a file's descriptor
(``from_samples``); samples that go on with one channel are joined, the first
being the lowest bits. ``codes`` and ``values`` decode, ``packed`` encodes;
``pixels`` and ``payloads`` do so for whole images as rows.

Where the published behaviour has a known slip the usual definition is used:
signed normalised values are at least -1 in packed formats too, and packing to
unsigned floats takes negative values as 0, keeps small ones as denormals and
makes too large ones infinite. Fields of more than 32 bits are not decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from . import formats
from .descriptor import CHANNELS, EXPONENT, FLOAT, SIGNED

# Fixed values of the public numbering: extension formats that texels are packed to or decoded from.
EXTENSIONS = {
    "R10X6_UNORM_PACK16": 1000156007,
    "R10X6G10X6_UNORM_2PACK16": 1000156008,
    "R10X6G10X6B10X6A10X6_UNORM_4PACK16": 1000156009,
    "R12X4_UNORM_PACK16": 1000156017,
    "R12X4G12X4_UNORM_2PACK16": 1000156018,
    "R12X4G12X4B12X4A12X4_UNORM_4PACK16": 1000156019,
    "A4R4G4B4_UNORM_PACK16": 1000340000,
    "A4B4G4R4_UNORM_PACK16": 1000340001,
    "R16G16_SFIXED5": 1000464000,
    "A1B5G5R5_UNORM_PACK16": 1000470000,
    "A8_UNORM": 1000470001,
}
ORDER = "RGBA"
KINDS = "UNORM SNORM USCALED SSCALED UINT SINT SRGB SFLOAT UFLOAT SFIXED5".split()
#: Bits of a float's exponent by the number of its bits; those of 16 and more have a sign.
EXPONENTS = {10: 5, 11: 5, 16: 5, 32: 8}


@dataclass(frozen=True)
class Channel:
    letter: str
    kind: str
    ranges: tuple[tuple[int, int], ...]  # (bit offset, bits), lowest first
    upper: int = 0  # the code that stands for 1
    exponent: tuple[int, int] | None = None  # a shared one: (bit offset, bits)
    padded: int = 0  # bits of no meaning below the field

    @property
    def bits(self) -> int:
        return sum(n for _, n in self.ranges)

    @property
    def signed(self) -> bool:
        return self.kind in ("SNORM", "SINT", "SSCALED", "SFIXED5")

    @property
    def integer(self) -> bool:
        return self.kind in ("UINT", "SINT", "USCALED", "SSCALED")

    @property
    def real(self) -> bool:
        return self.kind in ("SFLOAT", "UFLOAT")


@dataclass(frozen=True)
class Layout:
    size: int  # bytes of a texel
    unit: int  # bytes of a word in memory
    channels: tuple[Channel, ...] = field(default=())


def _one(kind: str, n: int) -> int:
    return {"SNORM": (1 << (n - 1)) - 1, "SFIXED5": 32}.get(kind, (1 << n) - 1 if kind in ("UNORM", "SRGB") else 1)


def _sorted(channels) -> tuple[Channel, ...]:
    return tuple(sorted(channels, key=lambda c: (ORDER + "DS").index(c.letter)))


def layout(name: str) -> Layout | None:
    """By a format's name: listed from the highest bits down within each packed word, else in the order of memory; None for block-compressed and unknown ones."""
    m = re.fullmatch(r"(.*?)(?:_(\d*)PACK(\d+))?", name)
    tokens, parts, kinds = m[1].split("_"), [], []
    for t in tokens:
        if re.fullmatch(r"(?:[RGBADSEX]\d+)+", t):
            parts += [(x[0], int(x[1:])) for x in re.findall(r"[RGBADSEX]\d+", t)]
        elif t in KINDS:
            kinds += [t] * (len(parts) - len(kinds))
        else:
            return None
    if not parts or len(kinds) != len(parts):
        return None
    words, unit = (int(m[2] or 1), int(m[3]) // 8) if m[3] else (1, 0)
    out, each = [], len(parts) // words
    for w in range(words):
        at = 8 * unit * (w + 1) if unit else 0
        for (letter, n), kind in zip(parts[w * each : (w + 1) * each], kinds[w * each : (w + 1) * each], strict=True):
            at = at - n if unit else at
            out.append((letter, kind, at, n))
            at = at if unit else at + n
    if name == "D24_UNORM_S8_UINT":  # stencil in the lowest bits
        out = [("D", "UNORM", 8, 24), ("S", "UINT", 0, 8)]
    if max(n for _, _, _, n in out) > 32:
        return None
    total = max(at + n for _, _, at, n in out)
    stored, word = {r[1]: (r[5], r[6]) for r in formats.rows()}.get(name, (-(-total // 8), unit or out[0][3] // 8))
    unit = unit or word
    size = words * unit if m[3] else stored
    shared = next(((at, n) for letter, _, at, n in out if letter == "E"), None)
    gap = {at + n: n for letter, _, at, n in out if letter == "X"}
    made = [Channel(letter, kind, ((at, n),), _one(kind, n), shared, gap.get(at, 0) if words > 1 or name.startswith("R1") else 0) for letter, kind, at, n in out if letter not in "EX"]
    return Layout(size, unit, _sorted(made))


def from_samples(samples: list[tuple], size: int, unit: int | None = None) -> Layout | None:
    """By the samples of a basic descriptor, (bit offset, bits, channel, qualifiers, lower, upper) each; None if a kind is not one of KINDS."""
    letters = {v: k for k, v in CHANNELS.items()}
    by: dict[int, list[tuple]] = {}
    for s in samples:
        by.setdefault(s[2], []).append(s)
    out = []
    for number, own in by.items():
        if number not in letters:
            return None
        plain = [s for s in own if not s[3] & EXPONENT]
        shared = next(((s[0], s[1]) for s in own if s[3] & EXPONENT), None)
        ranges, q, upper = tuple((s[0], s[1]) for s in plain), plain[-1][3], plain[-1][5]
        n = sum(r[1] for r in ranges)
        if q & FLOAT or shared:
            kind, upper = "SFLOAT" if q & SIGNED else "UFLOAT", 1
            if not shared and n not in EXPONENTS:
                return None
        elif upper == 1 and n > 1:
            kind = "SINT" if q & SIGNED else "UINT"
        elif q & SIGNED:
            kind = "SNORM" if upper == (1 << (n - 1)) - 1 else "SFIXED5"
        else:
            kind = "UNORM"
        if n > 32:
            return None
        out.append(Channel(letters[number], kind, ranges, upper, shared))
    return Layout(size, unit or size, _sorted(out))


# ------------------------------------------------------------------ decoding


def _piece(texel: Column, at: int, n: int) -> Column:
    first, last = at // 8, (at + n - 1) // 8
    return bits.field(bits.little_endian(texel, F.lit(first), last - first + 1), at % 8, n)


def code(texel: Column, c: Channel) -> Column:
    """A channel's bits as a number, signed where the kind is."""
    out, at = F.lit(0).cast("long"), 0
    for start, n in c.ranges:
        out = out.bitwiseOR(F.shiftleft(_piece(texel, start, n), at))
        at += n
    return bits.sign_extend(out, c.bits) if c.signed else out


def value(texel: Column, c: Channel) -> Column:
    """A channel as a double: floats as they are, normalised and fixed-point codes by the code that stands for 1, integers unchanged."""
    v = code(texel, c)
    if c.exponent:
        at, n = c.exponent
        bias = (1 << (n - 1)) - 1
        return v.cast("double") * F.pow(F.lit(2.0), (_piece(texel, at, n) - bias - c.bits).cast("double"))
    if c.real:
        e = EXPONENTS[c.bits]
        signed = c.bits >= 16
        return bits.small_float(v, e, c.bits - e - signed, signed)
    if c.integer:
        return v.cast("double")
    scaled = v.cast("double") / float(c.upper)
    return F.greatest(scaled, F.lit(-1.0)) if c.kind == "SNORM" else scaled


def _filled(found: dict[str, Column], one: Column, zero: Column) -> list[Column]:
    depth = [found[x] for x in "DS" if x in found]
    order = depth if depth else [found.get(x, one if x == "A" else zero) for x in ORDER]
    return [*order, *[zero] * (3 - len(order)), *([one] if len(order) < 4 else [])]


def codes(texel: Column, form: Layout) -> list[Column]:
    """Four numbers, red to alpha or depth and stencil; channels that are absent are 0."""
    zero = F.lit(0).cast("long")
    return _filled({c.letter: code(texel, c) for c in form.channels}, zero, zero)


def values(texel: Column, form: Layout) -> list[Column]:
    """Four doubles, red to alpha or depth and stencil; of absent ones alpha is 1, others 0."""
    return _filled({c.letter: value(texel, c) for c in form.channels}, F.lit(1.0), F.lit(0.0))


def pixels(images: DataFrame, form: Layout, payload: str = "payload", width: str = "width", height: str = "height") -> DataFrame:
    """Rows of images to rows of pixels: the other columns, x, y, c0 to c3.

    A payload is cut into lines first and these into texels, so no row carries
    more than its part.
    """
    keys = [c for c in images.columns if c not in (payload, width, height)]
    raw, pitch = F.col(payload), F.col(width).cast("int") * form.size
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    line = F.transform(span(F.col(height).cast("int")), lambda y: raw.substr(y * pitch + 1, pitch))
    lines = images.select(*keys, F.col(width).cast("int").alias("_width"), F.posexplode(line).alias("y", "_line"))
    texel = F.transform(span(F.col("_width")), lambda x: F.col("_line").substr(x * form.size + 1, F.lit(form.size)))
    each = lines.select(*keys, "y", F.posexplode(texel).alias("x", "_texel"))
    return each.select(*keys, "x", "y", *[v.alias(f"c{i}") for i, v in enumerate(values(F.col("_texel"), form))])


# ------------------------------------------------------------------ packing


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: else each use would repeat its whole expression in the generated code."""
    return F.transform(F.array(v), f)[0]


def encoded_float(v: Column, exponent: int, mantissa: int, signed: bool, truncate: bool = False) -> Column:
    """The reverse of ``small_float``; halves round away from zero, or all is cut off."""
    bias, full = (1 << (exponent - 1)) - 1, (1 << exponent) - 1
    two = lambda e: F.pow(F.lit(2.0), e)

    def code_of(a: Column) -> Column:
        guess = F.floor(F.log2(F.greatest(a, F.lit(2.0 ** (1 - bias))))).cast("double")
        exact = lambda g: F.when(a >= two(g + 1), g + 1).when((a < two(g)) & (g > 1 - bias), g - 1).otherwise(g)
        # the hidden bit carries into the exponent; without it the number is a denormal
        whole = lambda e: ((e + bias - 1) * float(1 << mantissa) + F.floor(a / two(e - mantissa) + (0.0 if truncate else 0.5))).cast("long")
        return F.when(a >= 2.0 ** (bias + 1), full << mantissa).otherwise(F.least(let(let(guess, exact), whole), F.lit(full << mantissa)))

    out = F.when(F.isnan(v), (full << mantissa) | (1 << (mantissa - 1))).otherwise(let(F.abs(v) if signed else F.greatest(v, F.lit(0.0)), code_of))
    return out.bitwiseOR(F.when(v < 0, 1 << (exponent + mantissa)).otherwise(0)).cast("long") if signed else out.cast("long")


def _target(v: Column, c: Channel, source: str, depth: int, array: bool) -> Column:
    """A source component as the channel's code."""
    if c.real:
        e = EXPONENTS[c.bits]
        signed = c.bits >= 16
        return encoded_float(v.cast("float").cast("double"), e, c.bits - e - signed, signed, truncate=not signed)
    if c.kind == "SINT" and not array:
        return bits.rescale_sint(v, 32, c.bits)
    if c.integer:
        return bits.rescale_uint(v, c.bits)
    if source == "float":
        return bits.float_to_unorm(v, c.bits)
    # with bits of no meaning below the field, the whole word is rescaled and cut
    return F.shiftright(bits.rescale_unorm(v, depth, c.bits + c.padded), c.padded)


def packed(pixel: list[Column], form: Layout, source: str = "unorm", depth: int = 8) -> Column:
    """A texel's bytes from red, green, blue and alpha.

    ``source``: "unorm" (codes of ``depth`` bits), "float", "uint" or "sint" (32
    bits). Components that ``pixel`` is too short for are 0, alpha the most.
    """
    most = {"unorm": F.lit((1 << depth) - 1), "float": F.lit(1.0)}.get(source, F.lit(1))
    given = {x: pixel[i] if i < len(pixel) else (most if x == "A" else F.lit(0)) for i, x in enumerate(ORDER)}
    array = all(c.bits == 8 * form.unit for c in form.channels)
    if any(c.exponent for c in form.channels):
        rgb = bits.pack_shared_exponent([given[x].cast("double") for x in "RGB"])
        return F.unhex(bits.little_endian_hex(rgb, form.size))
    words: dict[int, list[Column]] = {w: [] for w in range(form.size // form.unit)}
    for c in form.channels:
        v, at = _target(given[c.letter], c, source, depth, array), 0
        for start, n in c.ranges:
            words[start // (8 * form.unit)].append(F.shiftleft(bits.field(v, at, n), start % (8 * form.unit)))
            at += n
    text = [bits.little_endian_hex(reduce(lambda a, b: a.bitwiseOR(b), w, F.lit(0).cast("long")), form.unit) for _, w in sorted(words.items())]
    return F.unhex(F.concat(*text))


def payloads(pixels_: DataFrame, keys: list[str], form: Layout, channels: list[str], source: str = "unorm", depth: int = 8, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of pixels to (keys, payload): texels are joined to lines, lines to images."""
    texel = pixels_.select(*keys, F.col(y).alias("_y"), F.struct(F.col(x).alias("x"), F.hex(packed([F.col(c) for c in channels], form, source, depth)).alias("h")).alias("_t"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda t: t["h"]), "")
    lines = texel.groupBy(*keys, "_y").agg(whole("_t").alias("h")).select(*keys, F.struct("_y", "h").alias("_l"))
    return lines.groupBy(*keys).agg(F.unhex(whole("_l")).alias("payload"))


# ------------------------------------------------------------------ which formats


def _names() -> dict[str, int]:
    return {r[1]: r[0] for r in formats.rows() if r[0]} | EXTENSIONS


def decodable() -> dict[str, int]:
    """Formats with a layout, by name."""
    return {n: v for n, v in _names().items() if layout(n)}


def targets() -> dict[str, tuple[int, str, int]]:
    """Formats that images are packed to: number, source and the bits a source needs. Depth, signed normalised, scaled and fixed-point ones are raw only; of 32-bit integers the unsigned ones are."""
    out = {}
    for name, number in decodable().items():
        form = layout(name)
        kinds = {c.kind for c in form.channels}
        if len(kinds) > 1 or form.channels[0].letter in "DS":
            continue
        kind, most = kinds.pop(), max(c.bits for c in form.channels)
        if kind in ("UNORM", "SRGB"):
            out[name] = (number, "unorm", 8 if most <= 8 else most)
        elif kind == "UINT" or (kind == "SINT" and most < 32):
            out[name] = (number, kind.lower(), most)
        elif kind in ("SFLOAT", "UFLOAT"):
            out[name] = (number, "float", most if most >= 16 else 16)
    return out


def precision(given: Column, needed: int) -> Column:
    """"error" where a source has fewer bits than a target needs, "warning" where it has more than the next power of two, else null."""
    return F.when(F.greatest(given, F.lit(8)) < needed, "error").when(F.greatest(given, F.lit(8)) > 1 << (needed - 1).bit_length(), "warning")
