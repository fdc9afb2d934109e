"""Scalar maths and fixed-size linear algebra as Column expressions.

Matrices are lists of rows of Columns. Divisions are guarded, since ANSI mode raises on zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 for 0 / 0, infinite for other a / 0."""
    return F.when(b == 0, F.when(a == 0, d(0.0)).otherwise(F.signum(a) * d(math.inf))).otherwise(a / F.nullif(b, d(0.0)))


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; NULL and NaN stay what they are."""
    out = x
    if low is not None:
        out = F.when(out < low, d(low)).otherwise(out)
    if high is not None:
        out = F.when(F.isnan(out), out).when(out > high, d(high)).otherwise(out)
    return out


def norm(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))


def normalize(*xs: Column, eps: float = 1e-12) -> list[Column]:
    n = F.greatest(norm(*xs), d(eps))
    return [x / n for x in xs]


def learning_rate(step: Column, first: float, last: float, steps: int, delay_steps: int = 0, delay: float = 1.0) -> Column:
    """Log-linear decay from first to last, with an optional eased start; 0 before step 0 or when both rates are 0."""
    if first == 0 and last == 0:
        return d(0.0)
    t = clamp(step.cast("double") / steps, 0.0, 1.0)
    ease = d(1.0)
    if delay_steps > 0:
        ease = delay + (1 - delay) * F.sin(0.5 * math.pi * clamp(step.cast("double") / delay_steps, 0.0, 1.0))
    return F.when(step < 0, d(0.0)).otherwise(ease * F.exp(math.log(first) * (1 - t) + math.log(last) * t))


def sh_degree(iteration: Column, every: int = 1000, top: int = 3) -> Column:
    return F.least(F.floor(iteration / every), F.lit(top)).cast("int")


def rotation(w: Column, x: Column, y: Column, z: Column, unit: bool = True) -> Matrix:
    """Rotation matrix of a quaternion, normalised first unless told otherwise."""
    if unit:
        n = norm(w, x, y, z)
        w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion(r: Matrix) -> list[Column]:
    """Unit quaternion (w, x, y, z), w >= 0, of a rotation: the branch of the largest component is numerically safe."""
    trace = r[0][0] + r[1][1] + r[2][2]
    fours = [trace, 2 * r[0][0] - trace, 2 * r[1][1] - trace, 2 * r[2][2] - trace]  # 4 q_k^2 - 1
    s = [2 * F.sqrt(F.greatest(1 + v, d(0.0))) for v in fours]
    a, b, c = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    xy, xz, yz = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    forms = [(s[0] / 4, a / s[0], b / s[0], c / s[0]), (a / s[1], s[1] / 4, xy / s[1], xz / s[1]), (b / s[2], xy / s[2], s[2] / 4, yz / s[2]), (c / s[3], xz / s[3], yz / s[3], s[3] / 4)]
    top = F.greatest(*fours)
    pick = [F.when(top == fours[0], f0).when(top == fours[1], f1).when(top == fours[2], f2).otherwise(f3) for f0, f1, f2, f3 in zip(*forms, strict=True)]
    sign = F.when(pick[0] < 0, d(-1.0)).otherwise(d(1.0))
    return [sign * p for p in pick]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            total = row[0] * b[0][j]
            for k in range(1, len(b)):
                total = total + row[k] * b[k][j]
            line.append(total)
        out.append(line)
    return out


def transpose(a: Matrix) -> Matrix:
    return [list(c) for c in zip(*a, strict=True)]


def covariance(scale: list[Column], r: Matrix, modifier: float = 1.0) -> list[Column]:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of R S S R^T."""
    factor = [[r[i][j] * (scale[j] * modifier) for j in range(3)] for i in range(3)]
    full = matmul(factor, transpose(factor))
    return [full[0][0], full[0][1], full[0][2], full[1][1], full[1][2], full[2][2]]


def world_to_view(r: Matrix, t: list[Column], translate: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 1.0) -> Matrix:
    """[R^T | t], its camera centre moved by translate and scaled; closed form of two rigid inverses."""
    rt = transpose(r)
    centre = [-(r[i][0] * t[0] + r[i][1] * t[1] + r[i][2] * t[2]) for i in range(3)]
    centre = [(c + m) * scale for c, m in zip(centre, translate, strict=True)]
    moved = [-(rt[i][0] * centre[0] + rt[i][1] * centre[1] + rt[i][2] * centre[2]) for i in range(3)]
    return [[*rt[i], moved[i]] for i in range(3)] + [[d(0.0), d(0.0), d(0.0), d(1.0)]]


def projection(near: float, far: float, fov_x: Column, fov_y: Column) -> Matrix:
    """Perspective projection to depths 0..1, with w = z."""
    zero = d(0.0)
    return [
        [1 / F.tan(fov_x / 2), zero, zero, zero],
        [zero, 1 / F.tan(fov_y / 2), zero, zero],
        [zero, zero, d(far / (far - near)), d(-far * near / (far - near))],
        [zero, zero, d(1.0), zero],
    ]


def camera_centre(view: Matrix) -> list[Column]:
    """Where a rigid world-to-view matrix has its camera: -R^T t."""
    return [-(view[0][j] * view[0][3] + view[1][j] * view[1][3] + view[2][j] * view[2][3]) for j in range(3)]


def full_projection(view: Matrix, proj: Matrix) -> Matrix:
    """World to clip space, for row vectors: the transpose of projection times view."""
    return transpose(matmul(proj, view))


def transform_point(p: list[Column], m: Matrix, eps: float = 1e-7) -> list[Column]:
    """Homogeneous transform and divide."""
    x, y, z, w = (m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(4))
    return [x / (w + eps), y / (w + eps), z / (w + eps)]


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def flip_axes(r: Matrix) -> Matrix:
    """Camera axes from y up, z back to y down, z forward: columns 1 and 2 change sign."""
    return [[row[0], -row[1], -row[2], *row[3:]] for row in r]


def resolution(width: Column, height: Column, setting: Column, extra: float = 1.0) -> tuple[Column, Column]:
    """Pixels after scaling. 1, 2, 4, 8: a divisor, rounded half to even; -1: at most 1,600 wide; else the width.

    extra divides both sizes once more, as for pyramids of one scene.
    """
    target = F.when(setting == -1, F.when(width > 1600, d(1600)).otherwise(width.cast("double"))).otherwise(setting.cast("double"))
    factor = width / target * extra
    fixed = setting.isin(1, 2, 4, 8)
    sizes = [F.when(fixed, F.bround(x / (extra * setting.cast("double"))).cast("int")).otherwise((x / factor).cast("int")) for x in (width, height)]
    return sizes[0], sizes[1]


def quarter_turn(width: Column, height: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Intrinsics of an image turned 90 degrees clockwise."""
    return [height, width, fy, fx, height - cy, cx]


def to_camera(r: Matrix, t: list[Column], p: list[Column]) -> list[Column]:
    return [r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3)]


def inverse_depth(z: Column) -> Column:
    """1 / z, infinite at 0."""
    return F.when(z == 0, d(math.inf)).otherwise(1 / F.nullif(z, d(0.0)))


def over_background(c: Column, alpha: Column, background: float) -> Column:
    return c * alpha + background * (1 - alpha)


def gaussian_window(size: int = 11, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def adam(value: Column, grad: Column, m: Column, v: Column, step: int | Column, rate: float | Column, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-15) -> tuple[Column, Column, Column]:
    """Value and both moments after one step."""
    m, v = beta1 * m + (1 - beta1) * grad, beta2 * v + (1 - beta2) * grad * grad
    left = [1 - F.pow(d(b), d(step)) for b in (beta1, beta2)]
    return value - rate * (m / left[0]) / (F.sqrt(v / left[1]) + eps), m, v


def adam_groups(rows: DataFrame, groups: dict[str, tuple[list[str], float | Column]], step: int | Column, visible: Column | None = None, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-15) -> DataFrame:
    """One optimizer step over groups of columns, each with its own rate: {name: (columns, rate)}.

    Column c has its gradient in grad_c and its moments in m_c and v_c. Rows that are not visible keep values and moments.
    A rate may be a Column, such as ``learning_rate``; step counts from 1.
    """
    new: dict[str, Column] = {}
    for columns, rate in groups.values():
        for c in columns:
            value, m, v = adam(F.col(c), F.col(f"grad_{c}"), F.col(f"m_{c}"), F.col(f"v_{c}"), step, rate, beta1, beta2, eps)
            for name, moved in ((c, value), (f"m_{c}", m), (f"v_{c}", v)):
                new[name] = moved if visible is None else F.when(visible, moved).otherwise(F.col(name))
    return rows.withColumns(new)


def scalar_first(q: Column) -> Column:
    """A quaternion given as array (x, y, z, w) in the order (w, x, y, z)."""
    return F.array(F.get(q, F.lit(3)), *(F.get(q, F.lit(k)) for k in range(3)))


def projected_covariance(cov: list[Column], view: Matrix, p: list[Column], fx: Column, fy: Column, low_pass: float) -> list[Column]:
    """2D covariance (xx, xy, yy) of a splat on the image, and its 3-sigma radius; low_pass is added to the diagonal."""
    x, y, z = (view[i][0] * p[0] + view[i][1] * p[1] + view[i][2] * p[2] + view[i][3] for i in range(3))
    j = [[fx / z, d(0.0), -fx * x / (z * z)], [d(0.0), fy / z, -fy * y / (z * z)]]
    t = matmul(j, [row[:3] for row in view[:3]])
    full = [[cov[0], cov[1], cov[2]], [cov[1], cov[3], cov[4]], [cov[2], cov[4], cov[5]]]
    out = matmul(matmul(t, full), transpose(t))
    a, b, c = out[0][0] + low_pass, out[0][1], out[1][1] + low_pass
    mid = (a + c) / 2
    top = mid + F.sqrt(F.greatest(mid * mid - (a * c - b * b), d(0.0)))
    return [a, b, c, F.ceil(3 * F.sqrt(top))]
