"""Geometry and number rules: as column expressions, and with numpy where a grouped function needs them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, MAX_SEARCH = 1e-6, 3.0


# --- columns -----------------------------------------------------------------

def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


def presented_frames(stored: Column, duration: Column, fps: Column) -> Column:
    """Stored frames, or what the duration holds if that is fewer; 0 where unknown."""
    held = F.floor(duration * fps + 0.5).cast("long")
    return F.when(F.coalesce(stored, F.lit(0)) <= 0, 0).when((held > 0) & (held < stored), held).otherwise(stored)


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = rotation.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def even(x: Column) -> Column:
    """The nearest even whole number, 2 at least."""
    return F.greatest(F.round(x / 2) * 2, F.lit(2)).cast("long")


def compose_rotation(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(360))


def strength_to_sigma(s: Column) -> Column:
    return 10 + 14 * clamp(s, 0.0, 1.0)


def yaw_rate(y: Column, fps: Column | float, ok: Column) -> Column:
    """Degrees a second from the y part of the rotation vector; a failed row is 0 at its own time."""
    return F.when(ok, -y * fps * 180 / math.pi).otherwise(0.0)


def heading_rate(q: Column, fps: Column | float, ok: Column) -> Column:
    """``yaw_rate`` from a rotation as a quaternion (struct w, x, y, z); without one the row counts as failed."""
    return yaw_rate(quaternion_log(q)["y"], fps, F.coalesce(ok, F.lit(False)) & q["w"].isNotNull())


def total_zoom(zoom: Column, mesh_margin: Column, readout_margin: Column) -> Column:
    """The share of the picture that all margins together take, compounded."""
    return (1 + zoom) * (1 + mesh_margin) * (1 + readout_margin) - 1


def scaled_focal(focal: Column, from_width: Column, to_width: Column) -> Column:
    """A focal length in pixels of another width."""
    return focal * to_width / from_width


def current_distance(distance: Column, start: Column, end: Column) -> Column:
    """Where a sample is on an axis: at its start without a distance, else within its ends."""
    return F.when(distance.isNull(), start).otherwise(clamp(distance, start, end))


def elevation_window(low: Column, high: Column, flat: float = 1.0) -> Column:
    """Struct (base, range) of a plot: the elevations' own, or a window of ``flat`` metres about their middle where they are closer together."""
    narrow = high - low < flat
    return F.struct(F.when(narrow, (low + high) / 2 - flat / 2).otherwise(low).alias("base"), F.when(narrow, F.lit(flat)).otherwise(high - low).alias("range"))


def matrix(rows: list[list[Column | float]]) -> Column:
    """A 3x3 matrix as an array of nine, row by row."""
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for r in rows for x in r])


def _entries(m: Column) -> list[list[Column]]:
    return [[F.element_at(m, 3 * r + c + 1) for c in range(3)] for r in range(3)]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matrix_product(m: Column, n: Column) -> Column:
    def entries(both: Column) -> Column:
        a, b = _entries(both["m"]), _entries(both["n"])
        return matrix([[sum((a[r][k] * b[k][c] for k in range(1, 3)), a[r][0] * b[0][c]) for c in range(3)] for r in range(3)])

    return _bound(F.struct(m.alias("m"), n.alias("n")), entries)


def matrix_inverse(m: Column) -> Column:
    """By cofactors; the identity where the determinant is 0."""

    def adjugate(m: Column) -> Column:
        a = _entries(m)
        minor = lambda r, c: a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3] - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
        det = sum((a[0][c] * minor(0, c) for c in range(1, 3)), a[0][0] * minor(0, 0))
        return F.struct(matrix([[minor(c, r) for c in range(3)] for r in range(3)]).alias("m"), det.alias("det"))

    divided = lambda s: F.when(s["det"] != 0, F.transform(s["m"], lambda x: x / F.when(s["det"] != 0, s["det"]))).when(s["det"] == 0, matrix([[1, 0, 0], [0, 1, 0], [0, 0, 1]]))
    return _bound(_bound(m, adjugate), divided)


def matrix_unit(m: Column) -> Column:
    """Scaled so that the last entry is 1; as it is where that is 0."""
    return _bound(m, lambda m: F.transform(m, lambda x: F.when(F.element_at(m, 9) != 0, x / F.when(F.element_at(m, 9) != 0, F.element_at(m, 9))).otherwise(x)))


def matrix_rescaled(m: Column, s: Column | float) -> Column:
    """A matrix measured in pixels of one scale, for pixels ``s`` times as fine: conjugated by that scaling."""
    a = _entries(m)
    return matrix([[a[0][0], a[0][1], a[0][2] * s], [a[1][0], a[1][1], a[1][2] * s], [a[2][0] / s, a[2][1] / s, a[2][2]]])


def perspective_residual(a: Column, b: Column, tx: Column, ty: Column, h: Column) -> Column:
    """What of a frame pair's matrix ``h`` its similarity (a, b, tx, ty) can't represent: inverse(similarity) times h, the last entry 1."""
    similar = matrix([[a, -b, tx], [b, a, ty], [0, 0, 1]])
    return matrix_unit(matrix_product(matrix_inverse(similar), h))


def similarity(dx: Column, dy: Column, rotation: Column, scale: Column, width: float, height: float, zoom: Column, factor: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """(a, b, tx, ty) of a correction about the frame's centre with the zoom folded in."""
    cx, cy = width / 2, height / 2
    a, b = scale * zoom * F.cos(rotation), scale * zoom * F.sin(rotation)
    return a, b, cx - a * cx + b * cy + dx * factor, cy - b * cx - a * cy + dy * factor


def apply_similarity(m: tuple[Column, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, tx, ty = m
    return a * x - b * y + tx, b * x + a * y + ty


def invert_similarity(m: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """The inverse; the identity where the determinant is 0."""
    a, b, tx, ty = m
    det = a * a + b * b
    ok, d = det != 0, F.when(det != 0, det).otherwise(1.0)
    ia, ib = a / d, -b / d
    pick = lambda v, other: F.when(ok, v).otherwise(other)
    return pick(ia, 1.0), pick(ib, 0.0), pick(-(ia * tx - ib * ty), 0.0), pick(-(ib * tx + ia * ty), 0.0)


def compose_affine(m: tuple[Column, ...], n: tuple[Column, ...]) -> tuple[Column, ...]:
    """(a, b, tx, c, d, ty) of m after n."""
    a, b, tx, c, d, ty = m
    e, f, ux, g, h, uy = n
    return a * e + b * g, a * f + b * h, a * ux + b * uy + tx, c * e + d * g, c * f + d * h, c * ux + d * uy + ty


def fits(dx: Column, dy: Column, rotation: Column, scale: Column, zoom: Column, width: float, height: float, factor: float = 1.0) -> Column:
    """Whether all four corners of the canvas come from within the frame."""
    inv = invert_similarity(similarity(dx, dy, rotation, scale, width, height, zoom, factor))
    inside = F.lit(True)
    for x in (0.0, float(width)):
        for y in (0.0, float(height)):
            px, py = apply_similarity(inv, F.lit(x), F.lit(y))
            inside = inside & (px >= -EPS) & (px <= width + EPS) & (py >= -EPS) & (py <= height + EPS)
    return inside


def min_zoom(dx: Column, dy: Column, rotation: Column, scale: Column, width: float, height: float, factor: float = 1.0) -> Column:
    """Least zoom in [1, 3] that fits; 3 where none does.

    A zoom fits if every corner, moved back and turned back about the centre, lies within the half sizes times scale and zoom. So the least one is the largest of
    eight ratios, and no search is needed: a searched zoom differs by its last step alone.
    """
    c, s = F.cos(rotation), F.sin(rotation)
    need = []
    for x in (-width / 2, width / 2):
        for y in (-height / 2, height / 2):
            px, py = x - dx * factor, y - dy * factor
            need += [F.abs(c * px + s * py) / (width / 2 + EPS), F.abs(c * py - s * px) / (height / 2 + EPS)]
    return F.when(scale > 0, clamp(F.greatest(*need) / F.when(scale > 0, scale), 1.0, MAX_SEARCH)).otherwise(MAX_SEARCH)


def needed_zoom(dx: np.ndarray, dy: np.ndarray, rotation: np.ndarray, scale: np.ndarray, width: float, height: float) -> np.ndarray:
    """``min_zoom`` without its bounds, with numpy."""
    c, s = np.cos(rotation), np.sin(rotation)
    need = np.zeros(len(dx))
    for x in (-width / 2, width / 2):
        for y in (-height / 2, height / 2):
            px, py = x - dx, y - dy
            need = np.maximum(need, np.maximum(np.abs(c * px + s * py) / (width / 2 + EPS), np.abs(c * py - s * px) / (height / 2 + EPS)))
    return np.where(scale > 0, need / np.where(scale > 0, scale, 1), np.inf)


def max_alpha(dx: Column, dy: Column, rotation: Column, scale: Column, zoom: Column, width: float, height: float, factor: float = 1.0) -> Column:
    """Largest share of a correction that fits at ``zoom``, by 40 bisections over whole batches; 1 where all of it fits."""
    @F.pandas_udf("double")
    def search(dx: pd.Series, dy: pd.Series, rotation: pd.Series, scale: pd.Series, zoom: pd.Series) -> pd.Series:
        x, y, r, s, z = (v.to_numpy(float) for v in (dx, dy, rotation, scale, zoom))
        fit = lambda a: needed_zoom(x * a * factor, y * a * factor, r * a, 1 + a * (s - 1), width, height) <= z
        low, high = np.zeros(len(x)), np.ones(len(x))
        whole = fit(high)
        for _ in range(40):
            mid = (low + high) / 2
            good = fit(mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid)
        return pd.Series(np.where(whole, 1.0, low))

    return search(dx, dy, rotation, scale, zoom)


def project_ray(x: Column, y: Column, z: Column, kind: str, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a ray; null beyond what the lens can show."""
    rho = F.hypot(x, y)
    theta = F.atan2(rho, z)
    r = {
        "rectilinear": F.when(theta < math.pi / 2 - 1e-6, focal * F.tan(theta)), "equidistant": focal * theta, "equisolid": 2 * focal * F.sin(theta / 2), "stereographic": F.when(theta < math.pi - 1e-6, 2 * focal * F.tan(theta / 2)),
    }[kind]
    at = lambda c, v: F.when(rho < 1e-9, F.lit(c)).otherwise(c + r * v / rho)
    return at(cx, x), at(cy, y)


def ray(px: Column, py: Column, kind: str, focal: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Unit ray of a pixel."""
    x, y = px - cx, py - cy
    r = F.hypot(x, y)
    theta = {"rectilinear": F.atan(r / focal), "equidistant": r / focal, "equisolid": 2 * F.asin(F.least(r / (2 * focal), F.lit(1.0))), "stereographic": 2 * F.atan(r / (2 * focal))}[kind]
    k = F.when(r < 1e-9, 0.0).otherwise(F.sin(theta) / F.when(r < 1e-9, 1.0).otherwise(r))
    return x * k, y * k, F.cos(theta)


def field_of_view(kind: str, focal: float, width: float) -> Column:
    x, y, z = ray(F.lit(width / 2), F.lit(0.0), kind, focal, 0.0, 0.0)
    return F.degrees(2 * F.atan2(F.hypot(x, y), z))


def quaternion_product(a: Column, b: Column) -> Column:
    f = lambda q: (q["w"], q["x"], q["y"], q["z"])
    (aw, ax, ay, az), (bw, bx, by, bz) = f(a), f(b)
    return F.struct((aw * bw - ax * bx - ay * by - az * bz).alias("w"), (aw * bx + ax * bw + ay * bz - az * by).alias("x"), (aw * by - ax * bz + ay * bw + az * bx).alias("y"), (aw * bz + ax * by - ay * bx + az * bw).alias("z"))


def quaternion_log(q: Column) -> Column:
    sign = F.when(q["w"] < 0, -1.0).otherwise(1.0)
    v = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    s = F.when(v < 1e-12, 0.0).otherwise(2 * F.atan2(v, q["w"] * sign) / F.when(v < 1e-12, 1.0).otherwise(v)) * sign
    return F.struct((q["x"] * s).alias("x"), (q["y"] * s).alias("y"), (q["z"] * s).alias("z"))


def rectifier(vx: Column, vy: Column, rho: float, height: float) -> tuple[Column, Column]:
    """(kx, ky) of a row-wise shift that undoes motion (vx, vy) during a readout of the share ``rho`` of a frame."""
    return rho * vx / height, rho * vy / height


def rectifier_margin(kx: Column, ky: Column, width: float, height: float) -> Column:
    """Share of the frame that a rectifier pulls in from its edges."""
    return F.greatest(F.abs(kx) * height / width, F.abs(ky))


def vertex_counts(cells: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Columns and rows of a mesh with ``cells`` across and as many down as keep them square, one at least."""
    n = F.greatest(cells, F.lit(1))
    down = F.when(width > 0, F.floor(n * height / F.when(width > 0, width) + 0.5)).otherwise(1)
    return (n + 1).cast("int"), (F.greatest(down, F.lit(1)) + 1).cast("int")


def tool_settings(strength: Column) -> Column:
    """Struct (shakiness 1..10, smoothing 10..100, zoom 0..5) of a strength within 0 and 1."""
    s = clamp(strength, 0.0, 1.0)
    whole = lambda v: F.floor(v + 0.5).cast("int")
    return F.struct((1 + whole(s * 9)).alias("shakiness"), (10 + whole(s * 90)).alias("smoothing"), whole(s * 5).alias("zoom"))


def lens_reliable(forced: Column, focal: Column, pairs: Column, error: Column, flat_error: Column, margin: float) -> Column:
    """A forced lens needs a focal length; a measured one twenty pairs and an error well under that of no lens."""
    return F.when(forced, focal > 0).otherwise((pairs >= 20) & (error > 0) & (flat_error > 0) & (error < margin * flat_error))


def readout_reliable(ok: Column, samples: Column, r: Column, ratio: Column) -> Column:
    return ok & (samples >= 30) & (r >= 0.2) & (ratio > 0) & (ratio <= 1)


def consistent(ok: Column, dx: Column, dy: Column, most: float) -> Column:
    """A point tracked there and back that comes within ``most`` of where it began."""
    return ok & (F.hypot(dx, dy) <= most)


def source_scale(source_width: Column, analysis_width: Column) -> Column:
    return F.when((analysis_width > 0) & (source_width > 0), source_width / F.when(analysis_width > 0, analysis_width)).otherwise(0.0)


def axis_x(d: Column, start: Column, end: Column, left: Column, right: Column) -> Column:
    """Place of ``d`` on an axis; null where the axis has no length."""
    return F.when(end > start, left + (d - start) / F.when(end > start, end - start) * (right - left))


def span_fraction(start: Column, end: Column, duration: Column) -> Column:
    """Share of a clip that a span covers, in (0, 1]; all that is odd answers 1. An end of 0 is the clip's."""
    stop = F.when((end > 0) & (end < duration), end).otherwise(duration)
    span = stop - F.greatest(start, F.lit(0.0))
    return F.when((span <= 0) | (span >= duration), 1.0).otherwise(span / F.when(duration > 0, duration))


def job_cost(frames: Column, duration: Column, fps: Column, width: Column, height: Column, fraction: Column) -> Column:
    """Pixels to process; 0 where a clip couldn't be read."""
    n = F.when(F.coalesce(frames, F.lit(0)) > 0, frames.cast("double")).otherwise(duration * fps)
    return F.coalesce(n * width * height * fraction, F.lit(0.0))


# --- numpy, for grouped functions ----------------------------------------------

def extended(values: np.ndarray, before: int, after: int, window: int) -> np.ndarray:
    """``values`` (rows x channels) with rows put before and after: each channel goes on along the line fitted to the ``window`` rows at that end (all, if there are fewer)."""
    w = min(max(window, 1), len(values))
    x = np.arange(w) - (w - 1) / 2
    spread = max((x * x).sum(), 1e-300)

    def line(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return rows.mean(0) + (at - (w - 1) / 2)[:, None] * ((x[:, None] * rows).sum(0) / spread)

    return np.concatenate([line(values[:w], np.arange(-before, 0)), values, line(values[-w:], w + np.arange(after))])


def inverse3(m: np.ndarray) -> np.ndarray:
    """Inverses of 3x3 matrices (n x 3 x 3) by cofactors; the identity where a determinant is 0."""
    minors = np.stack([np.cross(m[:, 1], m[:, 2]), np.cross(m[:, 2], m[:, 0]), np.cross(m[:, 0], m[:, 1])], 2)
    det = (m[:, 0] * minors[:, :, 0]).sum(1)[:, None, None]
    return np.where(det == 0, np.eye(3), minors / np.where(det == 0, 1.0, det))


def q_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    aw, ax, ay, az = np.moveaxis(np.asarray(a, float), -1, 0)
    bw, bx, by, bz = np.moveaxis(np.asarray(b, float), -1, 0)
    return np.stack([aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw], -1)


def q_conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1, -1, -1])


def q_log(q: np.ndarray) -> np.ndarray:
    q = np.where(q[..., :1] < 0, -q, q)
    v = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    return q[..., 1:] * np.where(v < 1e-12, 0.0, 2 * np.arctan2(v, q[..., :1]) / np.maximum(v, 1e-12))


def q_exp(v: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(v, axis=-1, keepdims=True)
    s = np.where(a < 1e-12, 0.5, np.sin(a / 2) / np.maximum(a, 1e-12))
    return np.concatenate([np.cos(a / 2), v * s], -1)


def q_matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def rays(x: np.ndarray, y: np.ndarray, kind: str, focal: float) -> np.ndarray:
    r = np.hypot(x, y)
    theta = {"rectilinear": np.arctan(r / focal), "equidistant": r / focal, "equisolid": 2 * np.arcsin(np.minimum(r / (2 * focal), 1)), "stereographic": 2 * np.arctan(r / (2 * focal))}[kind]
    k = np.where(r < 1e-9, 0.0, np.sin(theta) / np.maximum(r, 1e-9))
    return np.stack([x * k, y * k, np.cos(theta)], 1)


def fit_rotation(a: np.ndarray, b: np.ndarray, rounds: int = 2, knee: float = 2.5) -> np.ndarray:
    """Rotation that takes rays a to b: least squares, then with weights that fall off beyond the knee of the upper-median angle."""
    w = np.ones(len(a))
    rot = np.eye(3)
    for _ in range(rounds + 1):
        u, _, vt = np.linalg.svd((b * w[:, None]).T @ a)
        rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        err = np.arccos(np.clip(((a @ rot.T) * b).sum(1), -1, 1))
        s = np.sort(err)[len(err) // 2] * 1.4826 * knee
        w = np.where(err <= max(s, 1e-12), 1.0, s / np.maximum(err, 1e-12))
    return rot


def pixels(d: np.ndarray, kind: str, focal: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, seen) of rays, relative to the lens centre; not seen beyond what the lens can show."""
    rho = np.hypot(d[..., 0], d[..., 1])
    theta = np.arctan2(rho, d[..., 2])
    limit = {"rectilinear": math.pi / 2 - 1e-6, "stereographic": math.pi - 1e-6}.get(kind, math.inf)
    seen = theta < limit
    t = np.where(seen, theta, 0.0)
    r = {"rectilinear": focal * np.tan(t), "equidistant": focal * t, "equisolid": 2 * focal * np.sin(t / 2), "stereographic": 2 * focal * np.tan(t / 2)}[kind]
    k = np.where(rho < 1e-9, 0.0, r / np.maximum(rho, 1e-9))
    return d[..., 0] * k, d[..., 1] * k, seen


def border(width: float, height: float, each: int = 48) -> np.ndarray:
    """Points along the four sides, relative to the centre."""
    x, y = np.linspace(-width / 2, width / 2, each), np.linspace(-height / 2, height / 2, each)
    return np.concatenate([np.stack(p, 1) for p in ((x, np.full(each, -height / 2)), (x, np.full(each, height / 2)), (np.full(each, -width / 2), y), (np.full(each, width / 2), y))])


def rotation_fits(q: np.ndarray, zoom: np.ndarray, kind: str, focal: float, width: float, height: float) -> np.ndarray:
    """Whether every border point of the output, at its zoom, comes from within the frame when its ray is turned by q."""
    p = border(width, height)[None] / zoom[:, None, None]
    d = rays(p[..., 0].ravel(), p[..., 1].ravel(), kind, focal).reshape(len(q), -1, 3)
    v = q[:, None, 1:]
    turned = d + 2 * np.cross(v, np.cross(v, d) + q[:, None, :1] * d)
    x, y, seen = pixels(turned, kind, focal)
    return (seen & (np.abs(x) <= width / 2 + EPS) & (np.abs(y) <= height / 2 + EPS)).all(1)


def rotation_zoom(q: np.ndarray, kind: str, focal: float, width: float, height: float, rounds: int = 40) -> np.ndarray:
    """Least zoom in [1, 3] for each correction, by bisection over the whole batch; 3 where none fits."""
    low, high = np.ones(len(q)), np.full(len(q), MAX_SEARCH)
    one, most = rotation_fits(q, low, kind, focal, width, height), rotation_fits(q, high, kind, focal, width, height)
    for _ in range(rounds):
        mid = (low + high) / 2
        good = rotation_fits(q, mid, kind, focal, width, height)
        low, high = np.where(good, low, mid), np.where(good, mid, high)
    return np.where(one, 1.0, np.where(most, high, MAX_SEARCH))


def weakened_rotation(q: np.ndarray, zoom: np.ndarray, kind: str, focal: float, width: float, height: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(q, alpha): the largest share of each rotation vector that fits at its zoom."""
    v = q_log(q)
    whole = rotation_fits(q, zoom, kind, focal, width, height)
    low, high = np.zeros(len(q)), np.ones(len(q))
    for _ in range(rounds):
        mid = (low + high) / 2
        good = rotation_fits(q_exp(v * mid[:, None]), zoom, kind, focal, width, height)
        low, high = np.where(good, mid, low), np.where(good, high, mid)
    alpha = np.where(whole, 1.0, low)
    return np.where(whole[:, None], q, q_exp(v * alpha[:, None])), alpha
