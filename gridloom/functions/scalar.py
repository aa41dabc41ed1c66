"""Kernel functions as Columns: what an expression over voxels or point attributes is made of.

Everything stays inside the engine's generated code. Results outside a function's domain are defined: see each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(x, _lit(low)), _lit(high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(x: Column, low: float, high: float) -> Column:
    """0 to 1 with no slope at both ends."""
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (F.lit(3.0) - t * 2)


def fit(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """From one range to another, clamped; the middle of the target for an empty range."""
    a, b = min(low, high), max(low, high)
    if a == b:
        return F.lit((to_low + to_high) / 2)
    return (clamp(x, a, b) - low) / (high - low) * (to_high - to_low) + to_low


def floored_mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor; null for divisor 0."""
    return F.when(y != 0, x - y * F.floor(F.try_divide(x, y)))


def truncated_mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the dividend; null for divisor 0."""
    return F.try_mod(x, y)


def euclidean_mod(x: Column, y: Column) -> Column:
    """Remainder that is never negative; null for divisor 0."""
    return F.when(y != 0, x - F.abs(y) * F.floor(F.try_divide(x, F.abs(y))))


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def safe_divide(x: Column, y: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(otherwise))


def cbrt(x: Column) -> Column:
    return F.cbrt(x)


def to_degrees(x: Column) -> Column:
    return x * (180 / 3.141592653589793)


def to_radians(x: Column) -> Column:
    return x * (3.141592653589793 / 180)


def quantised(x: Column, low: float, high: float, bits: int) -> Column:
    """x as stored in a fixed-point code of some bits."""
    top = (1 << bits) - 1
    return F.floor((clamp(x, low, high) - low) / (high - low) * top + 0.5) / top * (high - low) + low


def morton(i: Column, j: Column, k: Column, bits: int = 10) -> Column:
    """Bits of three non-negative coordinates in turn: near in space, mostly near in order."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for n, c in enumerate((i, j, k)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), 3 * b + n))
    return out


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: tuple[Column, ...]) -> tuple[Column, ...]:
    """Unit vector; the zero vector stays."""
    n = length(a)
    return tuple(F.when(n == 0, x).otherwise(F.try_divide(x, n)) for x in a)


def determinant(m: list[Column]) -> Column:
    """Of a 3 x 3 matrix by rows."""
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def transform(m: list[Column], v: tuple[Column, ...]) -> tuple[Column, ...]:
    """Matrix times vector."""
    return tuple(m[3 * r] * v[0] + m[3 * r + 1] * v[1] + m[3 * r + 2] * v[2] for r in range(3))


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of 3 x 3 matrices."""
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)]


def transpose(m: list[Column]) -> list[Column]:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def cofactors(m: list[Column]) -> list[Column]:
    """Of a 3 x 3 matrix; its transpose is the adjoint."""

    def minor(r: int, c: int) -> Column:
        (a, b), (d, e) = [x for x in range(3) if x != r], [x for x in range(3) if x != c]
        return m[3 * a + d] * m[3 * b + e] - m[3 * a + e] * m[3 * b + d]

    return [minor(r, c) if (r + c) % 2 == 0 else -minor(r, c) for r in range(3) for c in range(3)]


def inverse(m: list[Column]) -> list[Column]:
    """Adjoint over determinant; a singular matrix stays as it is."""
    whole = determinant(m)
    return [F.when(whole == 0, own).otherwise(F.try_divide(x, whole)) for own, x in zip(m, transpose(cofactors(m)))]


def ordered(v: tuple[Column, ...]) -> list[Column]:
    """Parts of a vector in ascending order."""
    parts = F.array_sort(F.array(*v))
    return [F.get(parts, n) for n in range(len(v))]


def order(v: tuple[Column, ...]) -> list[Column]:
    """Numbers of a vector's parts in ascending order of their values, ties by number."""
    parts = F.array_sort(F.array(*[F.struct(x.alias("x"), F.lit(n).alias("n")) for n, x in enumerate(v)]))
    return [F.get(parts, n)["n"] for n in range(len(v))]


def leaf_offset(i: Column, j: Column, k: Column, bits: int = 3) -> Column:
    """Place of a voxel in its leaf's table, k fastest; negative coordinates too."""
    low = (1 << bits) - 1
    return F.shiftleft(i.bitwiseAND(low), 2 * bits).bitwiseOR(F.shiftleft(j.bitwiseAND(low), bits)).bitwiseOR(k.bitwiseAND(low))


def offset_coordinates(offset: Column, bits: int = 3) -> tuple[Column, Column, Column]:
    """The place in a leaf that a number of its table stands for."""
    low = (1 << bits) - 1
    return F.shiftright(offset, 2 * bits), F.shiftright(offset, bits).bitwiseAND(low), offset.bitwiseAND(low)


def trace(m: list[Column]) -> Column:
    return m[0] + m[4] + m[8]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of red, green and blue, each 0 to 1; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    d = lambda x: F.try_divide(x, span)
    hue = F.when(span == 0, 0.0).when(top == r, floored_mod(d(g - b), F.lit(6.0)) / 6).when(top == g, (d(b - r) + 2) / 6).otherwise((d(r - g) + 4) / 6)
    return hue, F.when(top == 0, 0.0).otherwise(F.try_divide(span, top)), top


def rgb(h: Column, s: Column, v: Column) -> tuple[Column, ...]:
    """Red, green and blue of hue, saturation and value."""

    def part(n: int) -> Column:
        k = floored_mod(h * 6 + n, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return part(5), part(3), part(1)


def number(text: Column) -> Column:
    """The number that a text begins with; 0 if it has none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("S999999999")), F.lit(0)).cast("long")


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def multiply4(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of 4 x 4 matrices by rows."""
    return [a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c] + a[4 * r + 3] * b[12 + c] for r in range(4) for c in range(4)]


def transpose4(m: list[Column]) -> list[Column]:
    return [m[4 * c + r] for r in range(4) for c in range(4)]


def trace4(m: list[Column]) -> Column:
    return m[0] + m[5] + m[10] + m[15]


def determinant4(m: list[Column]) -> Column:
    """Along the first row, of a 4 x 4 matrix."""
    parts = [m[c] * determinant([m[4 * r + k] for r in range(1, 4) for k in range(4) if k != c]) for c in range(4)]
    return parts[0] - parts[1] + parts[2] - parts[3]


def transform4(m: list[Column], v: tuple[Column, ...]) -> list[Column]:
    """A row vector (x, y, z, 1) times a 4 x 4 matrix, divided by what comes out last; the point itself where that is 0."""
    x, y, z = v
    out = [x * m[c] + y * m[4 + c] + z * m[8 + c] + m[12 + c] for c in range(4)]
    return [F.when(out[3] == 0, own).otherwise(F.try_divide(e, out[3])) for own, e in zip(v, out[:3])]
