"""Swing dynamics, stationary covariance, frequency response and ridge regression of one configuration."""

from __future__ import annotations

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor polynomial and squaring."""
    k = max(0, int(np.ceil(np.log2(max(1e-300, np.linalg.norm(a, 1))))) + 4)
    x, term = a / 2**k, np.eye(len(a), dtype=a.dtype)
    out = term.copy()
    for i in range(1, 13):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def load_flow(k: np.ndarray, p: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Angles with p_i = sum_j k_ij sin(theta_i - theta_j), by Newton steps; the first angle is 0."""
    theta = np.zeros(len(p))
    for _ in range(rounds):
        d = theta[:, None] - theta[None, :]
        miss = p - (k * np.sin(d)).sum(axis=1)
        if np.abs(miss[1:]).max(initial=0) < 1e-11:
            break
        j = -k * np.cos(d)
        np.fill_diagonal(j, 0)
        np.fill_diagonal(j, -j.sum(axis=1))
        theta[1:] += np.linalg.solve(j[1:, 1:], miss[1:])
    return theta


def system(k: np.ndarray, theta: np.ndarray, inertia: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """State matrix of (angle, speed): the linear swing equation around an equilibrium."""
    lap = -k * np.cos(theta[:, None] - theta[None, :])
    np.fill_diagonal(lap, 0)
    np.fill_diagonal(lap, -lap.sum(axis=1))
    n = len(inertia)
    return np.block([[np.zeros((n, n)), np.eye(n)], [-lap / inertia[:, None], -np.diag(damping / inertia)]])


def step_response(a: np.ndarray, push: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Speeds (time x node) after a constant push of accelerations, exact on an even grid."""
    n = len(push)
    big = np.zeros((2 * n + 1, 2 * n + 1))
    big[: 2 * n, : 2 * n] = a
    big[n : 2 * n, -1] = push
    one = expm(big * (times[1] - times[0]))
    state, out = np.zeros(2 * n + 1), []
    state[-1] = 1
    for _ in times:
        out.append(state[n : 2 * n])
        state = one @ state
    return np.array(out)


def nonlinear_response(k: np.ndarray, p: np.ndarray, inertia: np.ndarray, damping: np.ndarray, theta: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Speeds (time x node) of the swing equation by fourth-order steps."""
    def rate(s):
        angle, speed = s
        return np.stack([speed, (p - (k * np.sin(angle[:, None] - angle[None, :])).sum(axis=1) - damping * speed) / inertia])

    s, h, out = np.stack([theta, np.zeros(len(p))]), times[1] - times[0], []
    for _ in times:
        out.append(s[1])
        a = rate(s)
        b = rate(s + h / 2 * a)
        c = rate(s + h / 2 * b)
        s = s + h / 6 * (a + 2 * b + 2 * c + rate(s + h * c))
    return np.array(out)


def readings(speed: np.ndarray, times: np.ndarray, window: float = 0.5) -> dict[str, np.ndarray]:
    """Per node: rate over the first window, largest rate over any window, largest deviation, lowest value."""
    k = max(1, round(window / (times[1] - times[0])))
    rate = (speed[k:] - speed[:-k]) / (k * (times[1] - times[0]))
    return {"rocof": rate[0], "peak_rocof": np.abs(rate).max(axis=0), "peak": np.abs(speed).max(axis=0), "nadir": speed.min(axis=0)}


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X with A X + X A' + Q = 0, by eigen-decomposition."""
    w, v = np.linalg.eig(a)
    vi = np.linalg.inv(v)
    y = vi @ q @ vi.conj().T
    return np.real(v @ (-y / (w[:, None] + w.conj()[None, :])) @ v.conj().T)


def stationary(k: np.ndarray, inertia: np.ndarray, damping: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Stationary covariance of the speeds under white power noise; the common angle, which has no stationary law, is taken out."""
    n = len(inertia)
    a = system(k, np.zeros(n), inertia, damping)
    base = np.linalg.qr(np.concatenate([np.ones((n, 1)), np.eye(n)[:, : n - 1]], axis=1))[0][:, 1:]
    t = np.block([[base.T, np.zeros((n - 1, n))], [np.zeros((n, n)), np.eye(n)]])
    back = np.block([[base, np.zeros((n, n))], [np.zeros((n, n - 1)), np.eye(n)]])
    q = np.zeros((2 * n - 1, 2 * n - 1))
    q[n - 1 :, n - 1 :] = np.diag((sigma / inertia) ** 2)
    return lyapunov(t @ a @ back, q)[n - 1 :, n - 1 :]


def green(lap: np.ndarray, inertia: np.ndarray, damping: np.ndarray, omega: float) -> np.ndarray:
    """Response of angles to power at a frequency."""
    return np.linalg.inv(lap + np.diag(1j * omega * damping - omega**2 * inertia))


def edge_screen(g: np.ndarray, a: np.ndarray, b: np.ndarray, k: float) -> np.ndarray:
    """Norm of the response's change for each candidate edge (a, b) of strength k: a rank-one update, no second inverse."""
    column, row = g[:, a] - g[:, b], g[a, :] - g[b, :]
    self_energy = g[a, a] + g[b, b] - g[a, b] - g[b, a]
    return np.abs(k / (1 + k * self_energy)) * np.linalg.norm(column, axis=0) * np.linalg.norm(row, axis=1)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, mean, scale, intercept): columns standardised on these rows, constant ones dropped to 0."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, np.inf)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return w, mean, scale, float(y.mean())


def cross_validated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, alpha: float) -> np.ndarray:
    """Out-of-fold predictions."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        w, mean, scale, base = ridge(x[fold != f], y[fold != f], alpha)
        out[fold == f] = (x[fold == f] - mean) / scale @ w + base
    return out


def cross_validated_r2(n: np.ndarray, mean: np.ndarray, cov: np.ndarray, alpha: float) -> float:
    """r2 of the out-of-fold predictions of ``cross_validated`` from moments alone: per fold its rows n, and of (features, target)
    the means and the population covariances."""

    def pooled(n, mean, cov):
        m = n @ mean / n.sum()
        d = mean - m
        return m, np.einsum("f,fij->ij", n, cov) + (n[:, None] * d).T @ d

    k, miss = mean.shape[1] - 1, 0.0
    for f in range(len(n)):
        rest = np.arange(len(n)) != f
        m, c = pooled(n[rest], mean[rest], cov[rest])
        scale = np.sqrt(np.diag(c)[:k] / n[rest].sum())
        scale = np.where(scale > 1e-12, scale, np.inf)
        w = np.linalg.solve(c[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k), c[:k, k] / scale)
        v = np.append(-w / scale, 1.0)  # the residual as a linear form
        miss += n[f] * (v @ cov[f] @ v + ((mean[f] - m) @ v) ** 2)
    return float(1 - miss / pooled(n, mean, cov)[1][k, k])
