"""Lag polynomials of ARMA models: products of factors, partial autocorrelations, and fits on sums of products.

All functions work on many series at once; the first axis is the series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Partial autocorrelations of a restricted factor stay within this bound.
BOUND = 0.995
MOST_STEPS = 200


def step_down(phi: np.ndarray, bound: float | None = None) -> np.ndarray:
    """Partial autocorrelations of autoregressions 1..p; values beyond ``bound`` count as the bound while stepping down."""
    phi, out = np.array(phi, dtype=float), np.zeros(np.shape(phi))
    for k in range(phi.shape[1], 0, -1):
        last = phi[:, -1]
        if bound is not None:
            last = np.clip(last, -bound, bound)
        out[:, k - 1] = last
        room = 1 - last**2
        phi = (phi[:, :-1] + last[:, None] * phi[:, -2::-1]) / np.where(room == 0, 1.0, room)[:, None]
    return out


def step_up(partial: np.ndarray) -> np.ndarray:
    """The autoregression with these partial autocorrelations (Levinson's recursion)."""
    phi = np.zeros((len(partial), 0))
    for k in range(partial.shape[1]):
        last = partial[:, k: k + 1]
        phi = np.concatenate([phi - last * phi[:, ::-1], last], axis=1)
    return phi


def inside(phi: np.ndarray, bound: float = 1.0) -> np.ndarray:
    """Whether each autoregression has all partial autocorrelations within the bound, so all roots inside the unit circle."""
    fine, phi = np.ones(len(phi), dtype=bool), np.array(phi, dtype=float)
    while phi.shape[1]:
        last = phi[:, -1]
        fine &= np.abs(last) < bound
        room = np.where(fine, 1 - last**2, 1.0)
        phi = (phi[:, :-1] + last[:, None] * phi[:, -2::-1]) / room[:, None]
    return fine


def levinson(covariances: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressions from autocovariances 0..m, each of its own order and padded with zeros; partial autocorrelations."""
    size, most = len(covariances), covariances.shape[1] - 1
    phi, out, partial = np.zeros((size, most)), np.zeros((size, most)), np.zeros((size, most))
    left = covariances[:, 0].copy()
    for k in range(1, most + 1):
        going = (k <= orders) & (left > 1e-12 * covariances[:, 0])
        past = (phi[:, : k - 1] * covariances[:, k - 1: 0: -1]).sum(axis=1)
        last = np.where(going, (covariances[:, k] - past) / np.where(going, left, 1.0), 0.0)
        phi[:, : k - 1] = phi[:, : k - 1] - last[:, None] * phi[:, : k - 1][:, ::-1]
        phi[:, k - 1] = last
        left = left * (1 - last**2)
        out[going], partial[:, k - 1] = phi[going], last
    return out, partial


@dataclass(frozen=True)
class Shape:
    """Numbers of parameters (constant, AR, seasonal AR, MA, seasonal MA), and the lags that their products reach."""

    const: int
    p: int
    P: int
    q: int
    Q: int
    s: int

    @staticmethod
    def lags(short: int, long: int, s: int) -> list[int]:
        """Lags of (short polynomial) x (seasonal polynomial), products included."""
        return sorted({i + s * j for i in range(short + 1) for j in range(long + 1)} - {0})

    @property
    def size(self) -> int:
        return self.const + self.p + self.P + self.q + self.Q

    @property
    def spans(self) -> list[slice]:
        """Where the constant and each factor lie among the parameters."""
        edges = np.cumsum([0, self.const, self.p, self.P, self.q, self.Q]).tolist()
        return [slice(a, b) for a, b in zip(edges, edges[1:])]

    @property
    def ar_lags(self) -> list[int]:
        return self.lags(self.p, self.P, self.s)

    @property
    def ma_lags(self) -> list[int]:
        return self.lags(self.q, self.Q, self.s)

    def expand(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the constant and all lags, and their derivatives by the parameters.

        (1 - phi(B)) (1 - PHI(B^s)) leaves -phi_i * PHI_j at lag i + s j; the moving average has plus signs.
        """
        const, phi, big_phi, theta, big_theta = self.spans
        columns = {("c", 0): 0} if self.const else {}
        for kind, lags in (("w", self.ar_lags), ("e", self.ma_lags)):
            for lag in lags:
                columns[kind, lag] = len(columns)
        beta, slope = np.zeros((len(params), len(columns))), np.zeros((len(params), len(columns), self.size))
        if self.const:
            beta[:, 0], slope[:, 0, 0] = params[:, 0], 1.0
        for kind, short, long, sign in (("w", phi, big_phi, -1.0), ("e", theta, big_theta, 1.0)):
            for i in range(short.stop - short.start):
                at = columns[kind, i + 1]
                beta[:, at] += params[:, short.start + i]
                slope[:, at, short.start + i] += 1.0
            for j in range(long.stop - long.start):
                at = columns[kind, self.s * (j + 1)]
                beta[:, at] += params[:, long.start + j]
                slope[:, at, long.start + j] += 1.0
                for i in range(short.stop - short.start):
                    at = columns[kind, i + 1 + self.s * (j + 1)]
                    beta[:, at] += sign * params[:, short.start + i] * params[:, long.start + j]
                    slope[:, at, short.start + i] += sign * params[:, long.start + j]
                    slope[:, at, long.start + j] += sign * params[:, short.start + i]
        return beta, slope


    def bend(self, left: np.ndarray) -> np.ndarray:
        """Second derivatives of the coefficients, weighted by ``left`` (a weight for each coefficient)."""
        out = np.zeros((len(left), self.size, self.size))
        _, phi, big_phi, theta, big_theta = self.spans
        for lags, at, short, long, sign in ((self.ar_lags, self.const, phi, big_phi, -1.0),
                                            (self.ma_lags, self.const + len(self.ar_lags), theta, big_theta, 1.0)):
            for i in range(short.start, short.stop):
                for j in range(long.start, long.stop):
                    lag = i - short.start + 1 + self.s * (j - long.start + 1)
                    out[:, i, j] = out[:, j, i] = sign * left[:, at + lags.index(lag)]
        return out


def quadratic(a: np.ndarray, b: np.ndarray, yy: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sum of squared residuals from sums of products."""
    return yy - 2 * (beta * b).sum(axis=1) + np.einsum("ri,rij,rj->r", beta, a, beta)


def _scaled_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", a), 0))
    scale = np.where(scale > 0, scale, 1.0)
    scaled = a / (scale[:, :, None] * scale[:, None, :]) + 1e-13 * np.eye(a.shape[1])
    return np.linalg.solve(scaled, (b / scale)[:, :, None])[:, :, 0] / scale


def minimise(shape: Shape, a: np.ndarray, b: np.ndarray, yy: np.ndarray, params: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Least squares over the ``free`` parameters by Newton steps, halved until the sum of squares falls.

    Where the sum of squares is not convex, the step leaves out the curvature of the products (Gauss-Newton).  One
    step is exact where no two free parameters are multiplied with each other.
    """
    tied = shape.p and shape.P or shape.q and shape.Q
    if not free.any():
        return params
    beta, slope = shape.expand(params)
    best = quadratic(a, b, yy, beta)
    going = np.ones(len(params), dtype=bool)
    for _ in range(MOST_STEPS):
        at = np.flatnonzero(going)
        if not len(at):
            break
        beta, slope = shape.expand(params[at])
        slope = slope[:, :, free]
        normal = np.einsum("rip,rij,rjq->rpq", slope, a[at], slope)
        left = b[at] - np.einsum("rij,rj->ri", a[at], beta)
        if tied:
            whole = normal - shape.bend(left)[:, free][:, :, free]
            size = np.sqrt(np.maximum(np.einsum("rpp->rp", normal), 1e-300))
            convex = np.linalg.eigvalsh(whole / (size[:, :, None] * size[:, None, :]))[:, 0] > 1e-9
            normal = np.where(convex[:, None, None], whole, normal)
        step = np.zeros((len(at), shape.size))
        step[:, free] = _scaled_solve(normal, np.einsum("rip,ri->rp", slope, left))
        moved, size = np.zeros(len(at), dtype=bool), 1.0
        for _ in range(30):
            trial = params[at] + size * step
            value = quadratic(a[at], b[at], yy[at], shape.expand(trial)[0])
            # Close to the minimum, sums of squares differ by rounding only; the step itself is exact there.
            better = ~moved & (value <= best[at] * (1 + 1e-12) + 1e-300)
            params[at[better]], best[at[better]] = trial[better], np.minimum(value, best[at])[better]
            moved |= better
            if moved.all():
                break
            size /= 2
        small = np.abs(step).max(axis=1) <= 1e-12 * (1 + np.abs(params[at]).max(axis=1))
        going[at[small | ~moved]] = False
    return params


def _lowest(shape: Shape, a: np.ndarray, b: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Least squares over all parameters.  A product has several minima, so it is started from several seasonal factors."""
    const, phi, big_phi, theta, big_theta = shape.spans
    tied = shape.p and shape.P or shape.q and shape.Q
    everything, long = np.ones(shape.size, dtype=bool), np.zeros(shape.size, dtype=bool)
    long[big_phi] = long[big_theta] = True
    starts = [np.zeros(shape.size)]
    for ar in (-0.5, 0.5) if tied and shape.P else (0.0,) if tied else ():
        for ma in (-0.5, 0.5) if shape.Q else (0.0,):
            starts.append(np.zeros(shape.size))
            starts[-1][big_phi][:1], starts[-1][big_theta][:1] = ar, ma
    best, least = None, None
    for start in starts:
        params = np.tile(start, (len(a), 1))
        if tied:
            params = minimise(shape, a, b, yy, minimise(shape, a, b, yy, params, ~long), long)
        params = minimise(shape, a, b, yy, params, everything)
        value = quadratic(a, b, yy, shape.expand(params)[0])
        if best is None:
            best, least = params, value
        lower = value < least * (1 - 1e-9)
        best[lower], least[lower] = params[lower], value[lower]
    return best


def fit(shape: Shape, a: np.ndarray, b: np.ndarray, yy: np.ndarray, restricted: bool) -> np.ndarray:
    """Parameters that fit best; a restricted model is stationary and invertible.

    A factor that leaves the region is put at its edge (its partial autocorrelations held within ``BOUND``) and stays
    there, while all other parameters are fitted again.
    """
    everything = np.ones(shape.size, dtype=bool)
    params = _lowest(shape, a, b, yy)
    if not restricted:
        return params
    factors = [(span, sign) for span, sign in zip(shape.spans[1:], (1.0, 1.0, -1.0, -1.0)) if span.stop > span.start]
    held = np.zeros((len(a), len(factors)), dtype=bool)
    for _ in range(len(factors)):
        fresh = np.zeros(len(a), dtype=bool)
        for f, (span, sign) in enumerate(factors):
            outside = ~held[:, f] & ~inside(sign * params[:, span], BOUND)
            params[outside, span] = sign * step_up(step_down(sign * params[outside, span], BOUND))
            held[outside, f] = True
            fresh |= outside
        for pattern in np.unique(held[fresh], axis=0):
            rows = np.flatnonzero(fresh & (held == pattern).all(axis=1))
            free = everything.copy()
            for f, (span, _) in enumerate(factors):
                free[span] = not pattern[f]
            params[rows] = minimise(shape, a[rows], b[rows], yy[rows], params[rows], free)
    return params
