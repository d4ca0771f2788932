"""Local price dynamics of complete segments, in batched numpy.

Each row gets the derivatives of a parabola through the last 15 closes, a ridge
fit of the third derivative on the last 30 rows, and the projection of the
fitted linear system one minute ahead.  Everything is reported one row later,
on the bar that triggers it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

from candlewick.operators.kernels import Block

# Fixed values.
POINTS = 15
FIT_ROWS = 30
RIDGE = 1.0
GRID = 11
UNSTABLE_FACTOR = 1e6
HALO = POINTS + FIT_ROWS + 1

_NUMBERS = (
    "p p1 p2 jp fit_0 fit_1 fit_2 fit_3 condition_number projected_p projected_p1 projected_p2 max_real_eigenvalue "
    "perturbation_amplification local_distance first_exit_time"
).split()
FIELDS = [
    *[T.StructField(n, T.DoubleType()) for n in _NUMBERS],
    T.StructField("fit_ready", T.BooleanType()),
    T.StructField("fitted", T.BooleanType()),
    T.StructField("projected", T.BooleanType()),
    T.StructField("domain_exit", T.BooleanType()),
    T.StructField("exit_dimension", T.StringType()),
]


def _frames(values: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` values up to and including each end index."""
    return values[ends[:, None] + np.arange(1 - width, 1)]


def parabola(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares slope and curvature at x = 0 per frame, and full-rank flags."""
    n, m = x.shape
    reach = np.abs(x).max(axis=1)
    spacing = np.diff(x, axis=1).min(axis=1)
    with np.errstate(all="ignore"):
        u = x / reach[:, None]
        basis = [np.ones_like(u), u, u * u]
        q: list[np.ndarray] = []
        r = np.zeros((n, 3, 3))
        for j, column in enumerate(basis):
            v = column.copy()
            for k, done in enumerate(q):
                for _ in range(2):  # second sweep keeps the columns orthogonal
                    part = (done * v).sum(axis=1)
                    r[:, k, j] += part
                    v = v - part[:, None] * done
            r[:, j, j] = np.sqrt((v * v).sum(axis=1))
            q.append(v / r[:, j, j][:, None])
        rest, g = y.copy(), []
        for done in q:
            part = (done * rest).sum(axis=1)
            rest = rest - part[:, None] * done
            g.append(part)
        c2 = g[2] / r[:, 2, 2]
        c1 = (g[1] - r[:, 1, 2] * c2) / r[:, 1, 1]
        slope, curve = c1 / reach, 2.0 * c2 / (reach * reach)
    full = (spacing > 0) & np.isfinite(slope) & np.isfinite(curve)
    doubtful = full & ((reach > 2e4) | (reach > 1e3 * spacing))
    if doubtful.any():
        xd = x[doubtful]
        sv = np.linalg.svd(np.stack([xd * xd, xd, np.ones_like(xd)], axis=-1), compute_uv=False)
        full[doubtful] = (sv > np.finfo(float).eps * m * sv[:, :1]).sum(axis=1) == 3
    return slope, curve, full


def _matrix_exp(a: np.ndarray) -> np.ndarray:
    """exp of a stack of small matrices: Taylor with scaling and squaring."""
    k = a.shape[-1]
    norm = np.abs(a).sum(axis=-1).max(axis=-1)
    with np.errstate(all="ignore"):
        squarings = np.clip(np.ceil(np.log2(np.maximum(norm, 1e-300) / 0.5)), 0, 1100)
        squarings = np.where(np.isfinite(squarings), squarings, 0).astype(int)
        scaled = a / np.exp2(squarings)[:, None, None]
        out = np.broadcast_to(np.eye(k), a.shape).copy()
        term = out.copy()
        for i in range(1, 19):
            term = term @ scaled / i
            out = out + term
        for i in range(int(squarings.max(initial=0))):
            todo = squarings > i
            out[todo] = out[todo] @ out[todo]
    return out


def _fit(frames: np.ndarray, target: np.ndarray):
    """Ridge fit on z-scores.  Returns coefficients, means, scales, bounds, condition, ok."""
    n, rows, _ = frames.shape
    means = frames.mean(axis=1)
    centred = frames - means[:, None, :]
    scales = np.sqrt((centred * centred).mean(axis=1))
    low, high = frames.min(axis=1), frames.max(axis=1)
    ok = (np.isfinite(scales) & np.isfinite(means) & (scales > 0)).all(axis=1)
    safe = np.where(ok[:, None], scales, 1.0)
    design = np.concatenate([np.ones((n, rows, 1)), np.where(ok[:, None, None], centred / safe[:, None, :], 0.0)], axis=2)
    gram = np.swapaxes(design, 1, 2) @ design
    right = (np.swapaxes(design, 1, 2) @ target[:, :, None])[:, :, 0]
    ridge = gram + np.diag([0.0, RIDGE, RIDGE, RIDGE])
    beta = np.linalg.solve(ridge, right[:, :, None])[:, :, 0]
    slopes = beta[:, 1:] / safe
    physical = np.concatenate([(beta[:, 0] - (slopes * means).sum(axis=1))[:, None], slopes], axis=1)
    ok &= np.isfinite(physical).all(axis=1)

    spectrum = np.linalg.eigvalsh(gram)
    with np.errstate(all="ignore"):
        condition = np.sqrt(spectrum[:, -1] / spectrum[:, 0])
    sharp = ok & ~(spectrum[:, 0] > 1e-8 * spectrum[:, -1])
    if sharp.any():
        sv = np.linalg.svd(design[sharp], compute_uv=False)
        with np.errstate(all="ignore"):
            condition[sharp] = sv[:, 0] / sv[:, -1]
    return physical, means, scales, low, high, condition, ok


def _project(start: np.ndarray, coef: np.ndarray):
    """Path of (p, p1, p2) on the unit grid, largest eigenvalue, amplification."""
    n = len(start)
    system = np.zeros((n, 4, 4))
    system[:, 0, 1] = system[:, 1, 2] = 1.0
    system[:, 2, :3] = coef[:, 1:]
    system[:, 2, 3] = coef[:, 0]
    step = _matrix_exp(system / (GRID - 1))
    path = np.empty((n, GRID, 3))
    state = np.concatenate([start, np.ones((n, 1))], axis=1)[:, :, None]
    with np.errstate(all="ignore"):
        for i in range(GRID):
            path[:, i] = state[:, :3, 0]
            state = step @ state
        two = step @ step
        four = two @ two
        whole = (four @ four @ two)[:, :3, :3]
        amplification = np.sqrt((whole * whole).sum(axis=1)).max(axis=1)
        finite = np.isfinite(path).all(axis=(1, 2))
        amplification[~np.isfinite(whole).all(axis=(1, 2))] = np.nan
    companion = system[:, :3, :3]
    eigen = np.linalg.eigvals(companion).real.max(axis=1)
    return path, finite, np.where(np.isfinite(eigen), eigen, np.nan), amplification


def price_kernel(block: Block) -> dict[str, np.ndarray]:
    n = block.rows
    minutes, close, rn = block.floats("minutes"), block.floats("close"), block.ints("rn")
    out = {name: np.full(n, np.nan) for name in _NUMBERS}
    flags = {name: np.zeros(n, dtype=bool) for name in ("fit_ready", "fitted", "projected", "domain_exit")}
    dims = np.full(n, None, dtype=object)
    out["p"] = close.copy()

    ends = np.flatnonzero(block.position >= POINTS - 1)
    if len(ends):
        slope, curve, full = parabola(_frames(minutes, ends, POINTS) - minutes[ends][:, None], _frames(close, ends, POINTS))
        out["p1"][ends] = np.where(full, slope, np.nan)
        out["p2"][ends] = np.where(full, curve, np.nan)
    out["jp"] = out["p2"] - block.lag(out["p2"], np.nan)

    ends = np.flatnonzero((block.position >= FIT_ROWS - 1) & (rn > FIT_ROWS))
    if len(ends):
        ends = ends[np.isfinite(_frames(out["jp"], ends, FIT_ROWS)).all(axis=1)]
    if len(ends):
        flags["fit_ready"][ends] = True
        state = np.stack([out["p"], out["p1"], out["p2"]], axis=-1)
        coef, means, scales, low, high, condition, ok = _fit(_frames(state, ends, FIT_ROWS), _frames(out["jp"], ends, FIT_ROWS))
        ends, coef, means, scales, low, high, condition = (v[ok] for v in (ends, coef, means, scales, low, high, condition))
    if len(ends):
        flags["fitted"][ends] = True
        start = state[ends]
        path, finite, eigen, amplification = _project(start, coef)
        with np.errstate(all="ignore"):
            steady = finite & ~(np.abs(path[:, -1] - start) > UNSTABLE_FACTOR * scales).any(axis=1)
            distance = np.sqrt((((path - means[:, None]) / scales[:, None]) ** 2).sum(axis=2)).max(axis=1)
        inside = (path >= low[:, None]) & (path <= high[:, None])
        left = ~inside.all(axis=2)
        exits = steady & left.any(axis=1)
        first = left.argmax(axis=1)
        outside = ~inside[np.arange(len(ends)), first]
        names = np.array(["|".join(n for i, n in enumerate(("P", "P1", "P2")) if code >> i & 1) for code in range(8)], dtype=object)
        codes = outside @ np.array([1, 2, 4])
        for i in range(4):
            out[f"fit_{i}"][ends] = coef[:, i]
        end = np.where(steady[:, None], path[:, -1], start)
        for i, name in enumerate(("projected_p", "projected_p1", "projected_p2")):
            out[name][ends] = end[:, i]
        out["condition_number"][ends] = condition
        out["max_real_eigenvalue"][ends] = eigen
        out["perturbation_amplification"][ends] = amplification
        out["local_distance"][ends] = np.where(steady, distance, np.nan)
        out["first_exit_time"][ends] = np.where(exits, first / (GRID - 1), np.nan)
        flags["projected"][ends] = steady
        flags["domain_exit"][ends] = exits
        dims[ends] = np.where(exits, names[codes], None)

    # Report on the triggering bar: everything moves one row down.
    for name, values in out.items():
        out[name] = block.lag(values, np.nan)
    for name, values in flags.items():
        out[name] = block.lag(values.astype("float64"), 0.0) > 0
    shifted = np.full(n, None, dtype=object)
    shifted[1:] = dims[:-1]
    shifted[block.position == 0] = None
    out["exit_dimension"] = shifted
    return out
