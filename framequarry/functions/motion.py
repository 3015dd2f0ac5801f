"""Easing, quaternions, affine transforms and camera columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c) -> Column:
    """Round half up to six decimals; a negative zero becomes zero."""
    return F.floor(_col(c) * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def ease(name: Column, u: Column) -> Column:
    """Eased progress of u in [0, 1]; step holds its key."""
    v = 1 - u
    curves = {
        "step": F.lit(0.0),
        "ease-in": u * u,
        "ease-out": 1 - v * v,
        "ease-in-out": F.when(u < 0.5, 2 * u * u).otherwise(1 - 2 * v * v),
        "ease-in-cubic": u * u * u,
        "ease-out-cubic": 1 - v * v * v,
        "ease-in-out-cubic": F.when(u < 0.5, 4 * u * u * u).otherwise(1 - 4 * v * v * v),
        "ease-in-out-sine": (1 - F.cos(math.pi * u)) / 2,
    }
    out = None
    for label, curve in curves.items():
        out = F.when(name == label, curve) if out is None else out.when(name == label, curve)
    return out.otherwise(u)


def quaternion(x, y, z) -> Column:
    """Array (x, y, z, w) of Euler degrees in XYZ order."""
    half = [F.radians(_col(a)) / 2 for a in (x, y, z)]
    (c1, c2, c3), (s1, s2, s3) = [F.cos(h) for h in half], [F.sin(h) for h in half]
    return F.array(
        s1 * c2 * c3 + c1 * s2 * s3,
        c1 * s2 * c3 - s1 * c2 * s3,
        c1 * c2 * s3 + s1 * s2 * c3,
        c1 * c2 * c3 - s1 * s2 * s3,
    )


def quat_multiply(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (a[i] for i in range(4))
    bx, by, bz, bw = (b[i] for i in range(4))
    return F.array(
        ax * bw + aw * bx + ay * bz - az * by,
        ay * bw + aw * by + az * bx - ax * bz,
        az * bw + aw * bz + ax * by - ay * bx,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def slerp(a: Column, b: Column, u: Column) -> Column:
    """Shortest-arc interpolation of unit quaternions, normalised lerp where they nearly agree."""
    dot = sum((a[i] * b[i] for i in range(4)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cos = F.least(F.lit(1.0), F.abs(dot))
    sin = F.sqrt(1 - cos * cos)
    angle = F.atan2(sin, cos)
    near = sin < 1e-7
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * angle) / sin)
    wb = F.when(near, u).otherwise(F.sin(u * angle) / sin) * sign
    return F.array(*[wa * a[i] + wb * b[i] for i in range(4)])


def lerp(a, b, u) -> Column:
    return _col(a) + (_col(b) - _col(a)) * _col(u)


# An affine transform is an array of twelve numbers, three rows of four.
IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def affine(position: list, rotation: list, scale: list | None = None) -> Column:
    """Transform from position, Euler degrees and scale columns."""
    x, y, z, w = (quaternion(*rotation)[i] for i in range(4))
    s = [_col(c) for c in scale] if scale else [F.lit(1.0)] * 3
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    cells = []
    for row, p in zip(rows, position):
        cells += [c * k for c, k in zip(row, s)] + [_col(p)]
    return F.array(*cells)


def affine_multiply(a: Column, b: Column) -> Column:
    cells = []
    for r in range(3):
        for c in range(4):
            cell = sum((a[r * 4 + k] * b[k * 4 + c] for k in range(3)), F.lit(0.0))
            cells.append(cell + a[r * 4 + 3] if c == 3 else cell)
    return F.array(*cells)


def affine_apply(m: Column, x, y, z) -> list[Column]:
    p = [_col(x), _col(y), _col(z)]
    return [sum((m[r * 4 + k] * p[k] for k in range(3)), F.lit(0.0)) + m[r * 4 + 3] for r in range(3)]


def camera_axes(yaw, pitch) -> tuple[list[Column], list[Column]]:
    """Right and up vectors of an orthographic camera at a yaw and pitch in degrees."""
    az, el = F.radians(_col(yaw)), F.radians(_col(pitch))
    right = [F.cos(az), F.lit(0.0), -F.sin(az)]
    up = [-F.sin(el) * F.sin(az), F.cos(el), -F.sin(el) * F.cos(az)]
    return right, up


def dot3(a: list[Column], b: list) -> Column:
    return sum((p * _col(q) for p, q in zip(a, b)), F.lit(0.0))
