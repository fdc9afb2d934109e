"""Real spherical harmonics up to degree 4, from their definition, and colours of splats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.maths import d, normalize

#: The constant of degree 0.
Y0 = 0.5 / math.sqrt(math.pi)


def _legendre(degree: int, order: int, z: Column) -> Column:
    """Associated Legendre function without its sin^order factor and without the (-1)^order sign."""
    start = d(float(math.prod(range(1, 2 * order, 2))))
    if degree == order:
        return start
    before, now = start, z * (2 * order + 1) * start
    for n in range(order + 2, degree + 1):
        before, now = now, ((2 * n - 1) * z * now - (n + order - 1) * before) / (n - order)
    return now


def basis(degree: int, x: Column, y: Column, z: Column) -> list[Column]:
    """(degree + 1)^2 functions of a unit direction, by degree, then order from -degree to degree.

    Odd orders carry the sign (-1)^order, as rendering code has it.
    """
    out = []
    for n in range(degree + 1):
        for m in range(-n, n + 1):
            k = abs(m)
            scale = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k))
            real, imag = d(1.0), d(0.0)
            for _ in range(k):  # (x + iy)^k
                real, imag = real * x - imag * y, real * y + imag * x
            part = _legendre(n, k, z)
            if m == 0:
                out.append(scale * part)
            else:
                out.append((-1) ** k * math.sqrt(2) * scale * part * (real if m > 0 else imag))
    return out


def evaluate(degree: int, coefficients: list[Column], direction: list[Column]) -> Column:
    """Weighted sum of the basis for one channel."""
    terms = [c * b for c, b in zip(coefficients, basis(degree, *direction), strict=False)]
    return sum(terms[1:], terms[0])


def colour(degree: int, channels: list[list[Column]], point: list[Column], camera: list[Column]) -> list[Column]:
    """Colour seen from a camera: max(harmonics + 0.5, 0) for each channel."""
    toward = normalize(*(p - c for p, c in zip(point, camera, strict=True)), eps=0.0)
    return [F.greatest(evaluate(degree, c, toward) + 0.5, d(0.0)) for c in channels]


def from_rgb(c: Column) -> Column:
    return (c - 0.5) / Y0


def to_rgb(c: Column) -> Column:
    return c * Y0 + 0.5


def exposed(rgb: list[Column], m: list[list[Column]]) -> list[Column]:
    """Row vector times the 3 x 3 part, plus the last column."""
    return [rgb[0] * m[0][j] + rgb[1] * m[1][j] + rgb[2] * m[2][j] + m[j][3] for j in range(3)]
