"""Colour columns: packing, Oklab conversion, hue turning and nearest-palette choice.

Everything stays a JVM expression. Colours are packed as r * 65536 + g * 256 + b.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The public Oklab matrices (linear sRGB -> LMS -> Lab and back).
RGB_TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LMS_TO_LAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
LAB_TO_LMS = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.2914855480),
)
LMS_TO_RGB = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)
LUMINANCE = (0.2126729, 0.7151522, 0.0721750)

MAX_PALETTE = 256


def _linear(byte: int) -> float:
    c = byte / 255
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dot(weights, values) -> Column:
    return weights[0] * values[0] + weights[1] * values[1] + weights[2] * values[2]


def half_up(c) -> Column:
    """floor(v + 0.5) as BIGINT: half goes up for negative values too."""
    return F.floor(_col(c) + F.lit(0.5)).cast("bigint")


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(_col(r), 16).bitwiseOR(F.shiftleft(_col(g), 8)).bitwiseOR(_col(b))


def red(rgb) -> Column:
    return F.shiftright(_col(rgb), 16).bitwiseAND(255)


def green(rgb) -> Column:
    return F.shiftright(_col(rgb), 8).bitwiseAND(255)


def blue(rgb) -> Column:
    return _col(rgb).bitwiseAND(255)


def rgb_to_hex(rgb) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(_col(rgb))), 6, "0"))


def hex_to_rgb(text) -> Column:
    return F.conv(F.substring(_col(text), 2, 6), 16, 10).cast("bigint")


def linear_channel(byte) -> Column:
    """sRGB byte to linear light."""
    c = _col(byte) / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_oklab(r, g, b) -> Column:
    linear = [linear_channel(c) for c in (r, g, b)]
    lms = [F.cbrt(_dot(row, linear)) for row in RGB_TO_LMS]
    names = ("L", "A", "B")
    return F.struct(*[_dot(row, lms).alias(n) for row, n in zip(LMS_TO_LAB, names)])


def packed_to_oklab(rgb) -> Column:
    return rgb_to_oklab(red(rgb), green(rgb), blue(rgb))


def constant_oklab(rgb: int) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("L", "A", "B"), _oklab_value(rgb))])


def encode_channel(linear) -> Column:
    """Linear light to an sRGB byte, clamped to the gamut."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), linear))
    srgb = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return half_up(255 * srgb)


def oklab_to_rgb(lab: Column) -> Column:
    parts = [lab["L"], lab["A"], lab["B"]]
    lms = [F.pow(_dot(row, parts), F.lit(3.0)) for row in LAB_TO_LMS]
    return pack_rgb(*[encode_channel(_dot(row, lms)) for row in LMS_TO_RGB])


def oklab_dist2(p: Column, q: Column) -> Column:
    d = [p[n] - q[n] for n in ("L", "A", "B")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def turn_hue(lab: Column, target, degrees) -> Column:
    """Turn towards a hue by at most ``degrees``, never past it; greys stay as they are."""
    degrees = F.lit(degrees) if not isinstance(degrees, Column) else degrees
    target = F.lit(target) if not isinstance(target, Column) else target
    chroma = F.hypot(lab["A"], lab["B"])
    hue = F.degrees(F.atan2(lab["B"], lab["A"]))
    delta = F.pmod(target - hue + F.lit(180.0), F.lit(360.0)) - 180
    delta = F.when(F.abs(delta) > degrees, F.signum(delta) * degrees).otherwise(delta)
    turned = F.radians(hue + delta)
    moved = F.struct(
        lab["L"].alias("L"), (chroma * F.cos(turned)).alias("A"), (chroma * F.sin(turned)).alias("B")
    )
    return F.when((chroma < 1e-6) | (degrees <= 0), lab).otherwise(moved)


def luminance(r, g, b) -> Column:
    return _dot(LUMINANCE, [linear_channel(c) for c in (r, g, b)])


def _oklab_value(rgb: int) -> tuple[float, float, float]:
    linear = [_linear(rgb >> 16 & 255), _linear(rgb >> 8 & 255), _linear(rgb & 255)]
    lms = [math.cbrt(sum(w * v for w, v in zip(row, linear))) for row in RGB_TO_LMS]
    return tuple(sum(w * v for w, v in zip(row, lms)) for row in LMS_TO_LAB)


def check_size(palette: list[int]) -> None:
    if not 1 <= len(palette) <= MAX_PALETTE:
        raise ValueError(f"a palette holds 1 to {MAX_PALETTE} colours, got {len(palette)}")


def nearest_fixed(lab: Column, palette: list[int]) -> Column:
    """Index (from 0) of the nearest colour of a palette known on the driver.

    A palette has at most 256 entries by contract, so distances are unrolled into generated
    code: no join, no shuffle, and cost per pixel proportional to the palette. Ties go to the
    lowest index.
    """
    check_size(palette)
    distances = []
    for rgb in palette:
        p = _oklab_value(rgb)
        d = [lab[n] - F.lit(v) for n, v in zip(("L", "A", "B"), p)]
        distances.append(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    every = F.array(*distances)
    return (F.array_position(every, F.array_min(every)) - 1).cast("bigint")


# ---- candidates by colour bin -------------------------------------------------------------------

BIN_BITS = 5  # 32 bins a channel
BINS = 1 << 3 * BIN_BITS


def colour_bin(r, g, b) -> Column:
    """Number of the 8 x 8 x 8 cube of a colour."""
    shift = 8 - BIN_BITS
    r, g, b = (F.shiftright(_col(c), shift).cast("int") for c in (r, g, b))
    return F.shiftleft(r, 2 * BIN_BITS).bitwiseOR(F.shiftleft(g, BIN_BITS)).bitwiseOR(b)


@functools.lru_cache(maxsize=1)
def bin_balls() -> tuple[np.ndarray, np.ndarray]:
    """Centre in Oklab of every bin and the distance of its farthest colour; the same for all palettes."""
    side, wide = 1 << BIN_BITS, 256 >> BIN_BITS
    linear = np.array([_linear(v) for v in range(256)])
    to_lms, to_lab = np.array(RGB_TO_LMS), np.array(LMS_TO_LAB)
    centres, radii = np.empty((BINS, 3)), np.empty(BINS)
    for k in range(side):
        red, green, blue = np.meshgrid(linear[k * wide : (k + 1) * wide], linear, linear, indexing="ij")
        lab = np.cbrt(np.stack([red, green, blue], axis=-1) @ to_lms.T) @ to_lab.T
        cubes = lab.reshape(wide, side, wide, side, wide, 3).transpose(1, 3, 0, 2, 4, 5).reshape(side * side, -1, 3)
        centre = (cubes.min(axis=1) + cubes.max(axis=1)) / 2
        here = slice(k * side * side, (k + 1) * side * side)
        centres[here] = centre
        radii[here] = np.sqrt(((cubes - centre[:, None]) ** 2).sum(axis=2).max(axis=1))
    return centres, radii


#: More than rounding can move a distance.
BIN_SLACK = 1e-9


def candidate_grid(palette: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the palette colours that can be nearest to some colour of each bin: ``first`` (one more than bins) and ``places``."""
    centres, radii = bin_balls()
    far = np.stack([np.sqrt(((centres - np.array(_oklab_value(c))) ** 2).sum(axis=1)) for c in palette], axis=1)
    near = far <= far.min(axis=1, keepdims=True) + 2 * radii[:, None] + BIN_SLACK
    first = np.concatenate([[0], near.sum(axis=1).cumsum()])
    return first, np.nonzero(near)[1]


def nearest_among(lab: Column, palette: list[int], places: Column) -> Column:
    """Index of the nearest colour of a driver's palette among ``places`` (an array of indices), ties to the lowest."""
    values = [_oklab_value(rgb) for rgb in palette]
    axes = [F.expr("array(" + ",".join(f"{v[k]!r}D" for v in values) + ")") for k in range(3)]

    def ranked(i: Column) -> Column:
        d = [lab[n] - F.get(axis, i) for n, axis in zip(("L", "A", "B"), axes)]
        return F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), i.alias("i"))

    return F.array_min(F.transform(places, ranked))["i"].cast("bigint")


def nearest_in(lab: Column, palette: Column) -> Column:
    """Nearest entry of an ARRAY<STRUCT<idx, rgb, L, A, B>> column (a palette per row), ties to the lowest idx."""
    ranked = F.transform(
        palette, lambda p: F.struct(oklab_dist2(lab, p).alias("d"), p["idx"].alias("idx"), p["rgb"].alias("rgb"))
    )
    return F.array_min(ranked)
