"""Pixel work on one frame in numpy, run over Arrow batches of frames.

A frame is one row, so these are narrow steps: no shuffle, no sort of rows.  Column lambdas per
cell and tap measured tens of times slower on real frame sizes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Frame = dict[str, object]
BATCH_BYTES = 1 << 24

# Fixed values of the colour mix (rows are output R, G, B; columns input R, G, B).
LEFT_MATRIX = ((0.437, 0.449, 0.164), (-0.062, -0.062, -0.024), (-0.048, -0.050, -0.017))
RIGHT_MATRIX = ((-0.011, -0.032, -0.007), (0.377, 0.761, 0.009), (-0.026, -0.093, 1.234))
GRAY = (0.114, 0.587, 0.299)  # of b, g, r
LUMINANCE = (0.2126, 0.7152, 0.0722)
GAMMA, SATURATION, LEAKAGE = 2.2, 0.90, 0.04
MAX_FILL = 16


def even_positions(n: int, m: int) -> np.ndarray:
    """m evenly spaced positions over 0..n-1, exact at the end."""
    p = np.arange(m) * ((n - 1) / max(m - 1, 1))
    if m > 1:
        p[-1] = n - 1
    return p


def resize_bilinear(z: np.ndarray, h: int, w: int, h2: int, w2: int) -> np.ndarray:
    """End-aligned bilinear resize of a row-major plane."""
    a, fy, fx = z.reshape(h, w), even_positions(h, h2)[:, None], even_positions(w, w2)[None, :]
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1, wy, wx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), fy - y0, fx - x0
    return ((a[y0, x0] * (1 - wx) + a[y0, x1] * wx) * (1 - wy) + (a[y1, x0] * (1 - wx) + a[y1, x1] * wx) * wy).ravel()


def resize_nearest(z: np.ndarray, h: int, w: int, h2: int, w2: int) -> np.ndarray:
    """The source cell nearest each target cell, ends aligned; halves go to the even one."""
    return z.reshape(h, w)[np.rint(even_positions(h, h2)).astype(int)[:, None], np.rint(even_positions(w, w2)).astype(int)].ravel()


def resize_area(z: np.ndarray, h: int, w: int, h2: int, w2: int) -> np.ndarray:
    """Mean of the source cells under each target cell; nearest when either side grows."""
    if h2 > h or w2 > w:
        return resize_nearest(z, h, w, h2, w2)
    ys, xs = (np.append(np.floor(np.arange(m) * (n / m)).astype(int), n) for n, m in ((h, h2), (w, w2)))
    total = np.add.reduceat(np.add.reduceat(z.reshape(h, w).astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
    return (total / np.outer(np.diff(ys), np.diff(xs))).ravel()


def block_match(before: np.ndarray, after: np.ndarray, h: int, w: int, radius: int = 3) -> tuple[int, int]:
    """(dx, dy) of the least mean absolute difference, compared to nine digits; the first in scan order wins ties."""
    a, b = before.reshape(h, w), after.reshape(h, w)
    best = None
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            ch, cw = h - abs(dy), w - abs(dx)
            if ch <= 0 or cw <= 0:
                continue
            y, x = max(0, dy), max(0, dx)
            err = round(float(np.abs(a[y:y + ch, x:x + cw] - b[y - dy:y - dy + ch, x - dx:x - dx + cw]).mean()), 9)
            if best is None or err < best[0]:
                best = err, dx, dy
    return best[1:]


def small_size(h: int, w: int, width: int) -> tuple[int, int]:
    """Height and width of a plane shrunk to ``width`` at most, its shape kept."""
    w2 = min(width, w)
    return max(1, round(h * w2 / w)), w2


def gray(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    return GRAY[0] * b + GRAY[1] * g + GRAY[2] * r


def changes(planes: list[np.ndarray | None]) -> list[float | None]:
    """Mean absolute change of each plane but the first from the one before; null where either is missing or their sizes differ."""
    out = []
    for a, b in zip(planes[:-1], planes[1:], strict=True):
        out.append(None if a is None or b is None or len(a) != len(b) or not len(a) else float(np.abs(b - a).mean()))
    return out


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the (2r+1)^2 cells around each cell, borders repeated, by running sums."""
    def running(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.pad(x, ((radius + 1, radius), (0, 0)), mode="edge"), axis=0)
        return total[2 * radius + 1:] - total[:-2 * radius - 1]

    return running(running(a).T).T / (2 * radius + 1) ** 2


def edge_aware(z: np.ndarray, h: int, w: int, amount: float, sigma: float) -> np.ndarray:
    """Each cell blended with its similar 4-neighbours; borders repeat the edge."""
    c = z.reshape(h, w).astype(np.float64)
    p = np.pad(c, 1, mode="edge")
    total, weight = c.copy(), np.ones_like(c)
    for n in (p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]):
        k = np.exp(-np.abs(n - c) / sigma)
        total += n * k
        weight += k
    return (c * (1 - amount) + total / weight * amount).ravel()


def percentile(z: np.ndarray, level: float) -> float:
    pos = level * (len(z) - 1)
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    part = np.partition(z, sorted({lo, hi}))
    return float(part[lo] + (part[hi] - part[lo]) * (pos - lo))


def margin(w: int, fraction: float) -> int:
    return max(1, int(np.rint(w * min(max(fraction, 0.0), 0.25))))


def disparity(z: np.ndarray, conv: float, w: int, strength: float, popout: float, background: float, protect: bool, fraction: float) -> np.ndarray:
    """Signed, bounded disparity per cell as a share of the width; what comes forward fades out at the sides if protected."""
    s = z - conv
    near = np.clip(s / max(1 - conv, 1e-6), 0, 1)
    far = np.clip(s / max(conv, 1e-6), -1, 0)
    d = np.clip(strength * (near * popout + far * background), -background, popout)
    if fraction <= 0 or not protect:
        return d
    m, x = margin(w, fraction), np.arange(w)
    ramp = (lambda k: k / (m - 1)) if m > 1 else (lambda k: k * 0.0)
    taper = np.where(x >= w - m, ramp(w - 1 - x), np.where(x < m, ramp(x), 1.0))
    return np.where(d > 0, d * np.tile(taper, len(z) // w), d)


def splat(z: np.ndarray, shift: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For both views the source cell that lands on each cell, or -1: the nearest, then the lowest source."""
    n = len(z)
    order = n - 1 - np.argsort(z[::-1], kind="stable")  # later ones win
    x = order % w
    row = order - x
    views = []
    for sign in (1, -1):
        t = np.rint(x + shift[order] * (0.5 * sign)).astype(np.int64)
        ok = (t >= 0) & (t < w)
        out = np.full(n, -1, np.int64)
        out[row[ok] + t[ok]] = order[ok]
        views.append(out)
    return views[0], views[1]


def fill(src: np.ndarray, w: int, channels: list[np.ndarray], widest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Painted channels of a view and its holes: runs of up to ``widest`` cells blend their borders, or copy the only one."""
    s = src.reshape(-1, w)
    x = np.arange(w)
    lx = np.maximum.accumulate(np.where(s >= 0, x, -1), axis=1)
    rx = np.minimum.accumulate(np.where(s >= 0, x, w)[:, ::-1], axis=1)[:, ::-1]
    run = rx - lx - 1
    bare = s < 0
    done = bare & (run <= widest) & ((lx >= 0) | (rx < w))
    t = (x - lx) / np.where(bare, run + 1, 1)
    wl = np.where(rx == w, 1.0, np.where(lx < 0, 0.0, 1.0 - t))
    wr = np.where((lx >= 0) & (rx < w), t, 1.0 - wl)
    rows = np.arange(len(s))[:, None]
    left, right = np.where(lx >= 0, lx, np.minimum(rx, w - 1)), np.where(rx < w, rx, np.maximum(lx, 0))
    a, c = s[rows, left][done], s[rows, right][done]
    wa, wc = wl[done].astype(np.float32), wr[done].astype(np.float32)
    painted = []
    for channel in channels:
        f = channel.astype(np.float32)
        out = np.zeros(s.shape)
        own = ~bare
        out[own] = np.floor(np.clip(f[s[own]], np.float32(0), np.float32(255)))
        out[done] = np.floor(np.clip(f[a] * wa + f[c] * wc, np.float32(0), np.float32(255)))
        painted.append(out.ravel())
    return painted, (bare & ~done).ravel()


def mix(left: dict[str, np.ndarray], right: dict[str, np.ndarray], mode: str, gamma: float = GAMMA, saturation: float = SATURATION,
        leakage: float = LEAKAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b, g, r of the picture mixed from the two views."""
    if mode == "basic":
        return right["b"], right["g"], left["r"]
    if mode != "calibrated":
        raise ValueError(f"unknown mode {mode}")

    def softened(view, cut):
        lin = [np.power(view[k] / 255.0, gamma) * (1.0 - leakage if k in cut else 1.0) for k in "rgb"]
        lum = lin[0] * LUMINANCE[0] + lin[1] * LUMINANCE[1] + lin[2] * LUMINANCE[2]
        return [(c - lum) * saturation + lum for c in lin]

    a, b = softened(left, "gb"), softened(right, "r")
    out = []
    for k in (2, 1, 0):
        v = sum(a[j] * LEFT_MATRIX[k][j] for j in range(3)) + sum(b[j] * RIGHT_MATRIX[k][j] for j in range(3))
        out.append(np.rint(np.power(np.clip(v, 0, 1), 1.0 / gamma) * 255.0))
    return out[0], out[1], out[2]


NUMBER = {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}


def _column(values: list, kind: T.DataType) -> pa.Array:
    if not isinstance(kind, T.ArrayType):
        return pa.array(values, NUMBER[type(kind)])
    there = [v for v in values if v is not None]
    if not there:
        return pa.nulls(len(values), _empty(kind))
    struct = isinstance(kind.elementType, T.StructType)
    offsets = np.cumsum([0, *(len(v[0] if struct else v) for v in there)]).astype(np.int32)
    if struct:
        names = kind.elementType.names
        fields = [pa.array(np.concatenate([v[i] for v in there]), pa.float64()) for i in range(len(names))]
        made = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names))
    else:
        made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(there), NUMBER[type(kind.elementType)]))
    if len(there) == len(values):
        return made
    null = np.array([v is None for v in values])
    return made.take(pa.array(np.cumsum(~null) - 1, mask=null))


def _reader(col: pa.Array) -> Callable[[int], object]:
    """A column's value by row: arrays as numpy, None for null."""
    if not pa.types.is_list(col.type):
        return col.to_pylist().__getitem__
    values, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    ok = col.is_valid().to_numpy(zero_copy_only=False)
    return lambda i: values[at[i]:at[i + 1]] if ok[i] else None


Step = tuple[list[str], T.StructType, Callable[[Frame], dict[str, object]]]


def pixel_step(frames: DataFrame, uses: list[str], makes: str, work: Callable[[Frame], dict[str, object]], drop: Sequence[str] = ()) -> DataFrame:
    """Adds or replaces the columns ``makes`` (DDL) by ``work`` on each frame's columns ``uses``, arrays as numpy.

    A frame of which a used column is null gets nulls.  Batches leave at about BATCH_BYTES.  A step right on
    another one's result runs in the same worker, so a task has one worker however many steps are stacked.
    """
    source, steps = getattr(frames, "_pixel_steps", None) or (frames, [])
    new = T.StructType.fromDDL(makes)
    names = [c for c in frames.columns if c not in (*new.names, *drop)] + [n for n in new.names if n not in drop]
    return _stepped(source, [*steps, (uses, new, work)], names)


def narrowed(frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns only; right on a pixel step, no others pass through its worker."""
    source, steps = getattr(frames, "_pixel_steps", None) or (frames, [])
    return _stepped(source, steps, list(columns)) if steps else frames.select(*columns)


def _stepped(source: DataFrame, steps: list[Step], names: list[str]) -> DataFrame:
    made = {f.name: f for _, new, _ in steps for f in new.fields}
    given, used = set(), set()
    for uses, new, _ in steps:
        used |= set(uses) - given
        given |= set(new.names)
    read = [c for c in source.columns if c in used or (c in names and c not in made)]
    schema = T.StructType([made[n] if n in made else source.schema[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            readers = {c: _reader(t.column(c)) for c in used}
            done: dict[str, list] = {n: [] for n in names if n in made}
            lo = size = 0

            def leave(hi):
                own = t.slice(lo, hi - lo)
                return pa.RecordBatch.from_arrays([_column(done[n], made[n].dataType) if n in made else own.column(n) for n in names], names)

            for i in range(t.num_rows):
                f = {c: value(i) for c, value in readers.items()}
                for uses, new, work in steps:
                    f |= dict.fromkeys(new.names) if any(f[c] is None for c in uses) else work(f)
                for n, held in done.items():
                    held.append(f[n])
                    size += getattr(f[n], "nbytes", 64) * 4
                if size >= BATCH_BYTES:
                    yield leave(i + 1)
                    lo, size, done = i + 1, 0, {n: [] for n in done}
            if lo < t.num_rows:
                yield leave(t.num_rows)

    out = source.select(*read).mapInArrow(run, schema)
    out._pixel_steps = source, steps
    return out


def _empty(kind: T.DataType) -> pa.DataType:
    if not isinstance(kind, T.ArrayType):
        return NUMBER[type(kind)]
    if isinstance(kind.elementType, T.StructType):
        return pa.list_(pa.struct([(n, pa.float64()) for n in kind.elementType.names]))
    return pa.list_(NUMBER[type(kind.elementType)])
