"""Symmetric positive definite matrices in numpy, batched over leading axes. Vectors are row-major upper triangles with the diagonal, without weights."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-10


def _by_eigen(a: np.ndarray, f) -> np.ndarray:
    w, v = np.linalg.eigh((a + np.swapaxes(a, -1, -2)) / 2)
    return (v * f(np.maximum(w, FLOOR))[..., None, :]) @ np.swapaxes(v, -1, -2)


def logm(a):
    return _by_eigen(a, np.log)


def expm(a):
    w, v = np.linalg.eigh((a + np.swapaxes(a, -1, -2)) / 2)
    return (v * np.exp(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def sqrtm(a):
    return _by_eigen(a, np.sqrt)


def inv_sqrtm(a):
    return _by_eigen(a, lambda w: 1 / np.sqrt(w))


def pack(a: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(a.shape[-1])
    return a[..., i, j]


def side(length: int) -> int | None:
    """n of a triangle with n(n+1)/2 entries, or None."""
    n = int((np.sqrt(8 * length + 1) - 1) / 2)
    return n if n * (n + 1) // 2 == length and length else None


def unpack(v: np.ndarray) -> np.ndarray:
    n = side(v.shape[-1])
    if n is None:
        raise ValueError(f"{v.shape[-1]} entries are no triangle")
    out = np.zeros((*v.shape[:-1], n, n))
    i, j = np.triu_indices(n)
    out[..., i, j] = v
    out[..., j, i] = v
    return out


def covariance(x: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Of channels (next to last axis) over samples, centred, n - 1, plus a ridge."""
    x = x - x.mean(-1, keepdims=True)
    return x @ np.swapaxes(x, -1, -2) / max(1, x.shape[-1] - 1) + ridge * np.eye(x.shape[-2])


def explicit_covariance(x: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Without centring."""
    return x @ np.swapaxes(x, -1, -2) / max(1, x.shape[-1] - 1) + ridge * np.eye(x.shape[-2])


def oas(x: np.ndarray) -> np.ndarray:
    """Oracle approximating shrinkage of one trial (channels, samples) towards a scaled identity."""
    x = x - x.mean(-1, keepdims=True)
    p, n = x.shape
    s = x @ x.T / n
    mu = np.trace(s) / p
    power = (s * s).mean()
    top, bottom = power + mu * mu, (n + 1) * (power - mu * mu / p)
    share = 1.0 if bottom == 0 else min(1.0, top / bottom)
    return (1 - share) * s + share * mu * np.eye(p)


def log_euclidean_mean(mats: np.ndarray, weights=None) -> np.ndarray:
    return expm(np.average(logm(mats), axis=0, weights=weights))


def karcher_mean(mats: np.ndarray, weights=None, steps: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """The mean under the affine-invariant distance, by fixed-point steps from the log-Euclidean mean."""
    m = log_euclidean_mean(mats, weights)
    for _ in range(steps):
        root, back = sqrtm(m), inv_sqrtm(m)
        t = np.average(logm(back @ mats @ back), axis=0, weights=weights)
        m = root @ expm(t) @ root
        if np.linalg.norm(t) < tolerance:
            break
    return m


def riemann_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    back = inv_sqrtm(a)
    w = np.linalg.eigvalsh(back @ b @ back)
    return np.sqrt((np.log(np.maximum(w, FLOOR)) ** 2).sum(-1))


def tangent(mats: np.ndarray, reference: np.ndarray) -> np.ndarray:
    back = inv_sqrtm(reference)
    return pack(logm(back @ mats @ back))


def transport(mats: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Moves matrices from around ``source`` to around ``target``."""
    a = sqrtm(target) @ inv_sqrtm(source)
    return a @ mats @ a.T


def procrustes(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rotation between the eigenbases of two matrices, largest eigenvalue first."""
    u, v = (np.linalg.eigh(m)[1][:, ::-1] for m in (source, target))
    return u.T @ v


def csp_filters(a: np.ndarray, b: np.ndarray, n: int, both_ends: bool = True) -> np.ndarray:
    """Rows: spatial filters for two class covariances. Whiten the sum, order by the first class's share; both ends, or the smallest only."""
    w, v = np.linalg.eigh(a + b)
    white = (v / np.sqrt(np.maximum(w, FLOOR))).T
    s, u = np.linalg.eigh(white @ a @ white.T)
    rows = u.T @ white
    if both_ends:
        return np.concatenate((rows[:n], rows[::-1][:n]))
    return rows[: 2 * n]


def joint_diagonal(mats: np.ndarray, weights=None, sweeps: int = 100, tolerance: float = 1e-12) -> np.ndarray:
    """The matrix V for which V @ C @ V.T is as diagonal as can be for all positive definite C at once, by Pham's likelihood: each sweep turns every pair of rows
    by the step that lowers the weighted sum of log det diag - log det. Exact where the matrices share eigenvectors, up to the order and length of rows."""
    c = np.array(mats, np.float64)
    p = np.full(len(c), 1 / len(c)) if weights is None else np.asarray(weights, np.float64) / np.sum(weights)
    n = c.shape[-1]
    v = np.eye(n)
    for _ in range(sweeps):
        gain = 0.0
        for i in range(1, n):
            for j in range(i):
                one, two, off = c[:, i, i], c[:, j, j], c[:, i, j]
                g1, g2 = p @ (off / one), p @ (off / two)
                w12, w21 = p @ (two / one), p @ (one / two)
                ratio, w = np.sqrt(w21 / w12), np.sqrt(w12 * w21)
                even, odd = (ratio * g1 + g2) / (w + 1), (ratio * g1 - g2) / max(w - 1, 1e-9)
                h1, h2 = even + odd, (even - odd) / ratio
                gain += (g1 * h1 + g2 * h2) / 2
                root = 1 + np.sqrt(max(1 - h1 * h2, 0.0))
                turn = np.array([[1, -h1 / root], [-h2 / root, 1]])
                pair = [i, j]
                c[:, pair, :] = turn @ c[:, pair, :]
                c[:, :, pair] = c[:, :, pair] @ turn.T
                v[pair] = turn @ v[pair]
        if abs(gain) < tolerance:
            break
    return v


def csp_joint(means: np.ndarray, priors: np.ndarray, n: int, corrected: bool = True) -> np.ndarray:
    """Rows: n spatial filters for any number of class covariances: the joint diagonaliser's, scaled to unit power over all classes, ordered by an approximation of their mutual information with the class
    (-sum p log sqrt(s) - 3/16 (sum p (s**2 - 1))**2 for class powers s; Grosse-Wentrup and Buss), the most telling first. The second term corrects for tails and outgrows the first where a class is several
    times louder than the others; without it (``corrected`` False) louder always tells more."""
    whole = np.tensordot(priors, means, 1)
    white = inv_sqrtm(whole)
    rows = joint_diagonal(white @ means @ white, priors) @ white
    rows /= np.sqrt(np.einsum("ij,jk,ik->i", rows, whole, rows))[:, None]
    power = np.maximum(np.einsum("ij,cjk,ik->ci", rows, means, rows), FLOOR)
    told = -(priors @ np.log(np.sqrt(power)) + corrected * 3 / 16 * (priors @ (power**2 - 1)) ** 2)
    return rows[np.argsort(-told, kind="stable")[:n]]


def fast_ica(x: np.ndarray, n: int, seed: int = 42, steps: int = 200, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unmixing, mixing, mean) of samples (n_samples, channels): symmetric, tanh contrast."""
    mean = x.mean(0)
    c = x - mean
    w, v = np.linalg.eigh(c.T @ c / len(c))
    order = np.argsort(-w)[:n]
    white = (v[:, order] / np.sqrt(np.maximum(w[order], FLOOR))).T
    z = c @ white.T
    q = np.linalg.qr(np.random.RandomState(seed).normal(size=(len(order), len(order))))[0]
    for _ in range(steps):
        g = np.tanh(z @ q.T)
        new = g.T @ z / len(z) - (1 - g * g).mean(0)[:, None] * q
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * q).sum(1)) - 1).max() < tolerance
        q = new
        if done:
            break
    unmix = q @ white
    return unmix, np.linalg.pinv(unmix), mean


def gevd_denoise(x: np.ndarray, lead: np.ndarray, keep: float = 0.8) -> np.ndarray:
    """Generalised eigenvectors of the signal's covariance against a lead-field covariance; the components least like the model go."""
    c = covariance(x)
    back = inv_sqrtm(lead + 1e-6 * np.trace(lead) / len(lead) * np.eye(len(lead)))
    w, v = np.linalg.eigh(back @ c @ back)
    n = max(1, int(round(keep * len(w))))
    b = back @ v[:, :n]
    return np.linalg.pinv(b.T) @ (b.T @ x)
