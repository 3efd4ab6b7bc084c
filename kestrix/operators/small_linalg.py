"""Dense linear algebra for p x p matrices on the driver: Householder QR, substitution, checks."""

from __future__ import annotations

import numpy as np


def householder_vector(x: np.ndarray) -> np.ndarray:
    """v of unit length with (I - 2 v v') x along the first axis; zero for a zero vector."""
    x = np.asarray(x, float)
    size = np.linalg.norm(x)
    if size == 0:
        return np.zeros_like(x)
    v = x.copy()
    v[0] += size if x[0] >= 0 else -size
    return v / np.linalg.norm(v)


def reflect(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    return a - 2 * np.outer(v, v @ a)


def qr(a: np.ndarray, reduced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """QR by Householder reflections."""
    r = np.array(a, float)
    m, n = r.shape
    q = np.eye(m)
    for k in range(min(m - 1, n)):
        v = np.zeros(m)
        v[k:] = householder_vector(r[k:, k])
        r, q = reflect(v, r), q - 2 * np.outer(q @ v, v)
    return (q[:, :n], np.triu(r[:n])) if reduced else (q, np.triu(r))


def back_substitution(r: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Solve R x = b; a pivot near zero is an error."""
    x = np.zeros(len(b))
    for i in range(len(b) - 1, -1, -1):
        if abs(r[i, i]) < tol:
            raise np.linalg.LinAlgError(f"pivot {i} is zero")
        x[i] = (b[i] - r[i, i + 1 :] @ x[i + 1 :]) / r[i, i]
    return x


def solve_qr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = qr(a, reduced=True)
    return back_substitution(r, q.T @ b)


def solve_weighted_qr(a: np.ndarray, b: np.ndarray, w: np.ndarray, lam: float = 0.0) -> np.ndarray:
    """Weighted least squares with an optional ridge, by scaling and augmentation."""
    s = np.sqrt(w)
    top, right = a * s[:, None], b * s
    if lam > 0:
        top, right = np.vstack([top, np.sqrt(lam) * np.eye(a.shape[1])]), np.concatenate([right, np.zeros(a.shape[1])])
    return solve_qr(top, right)


def solve_svd(a: np.ndarray, b: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > rcond * s.max(initial=0.0)
    return vt[keep].T @ ((u[:, keep].T @ b) / s[keep])


def ridge_svd(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    return vt.T @ (s / (s**2 + lam) * (u.T @ b))


def truncated_svd(a: np.ndarray, k: int, passes: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Randomised range finder with power iterations."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(a @ rng.normal(size=(a.shape[1], min(a.shape[1], k + 8))))[0]
    for _ in range(passes):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    u, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return (q @ u)[:, :k], s[:k], vt[:k].T


def is_symmetric(a: np.ndarray, tol: float = 1e-10) -> bool:
    return a.shape[0] == a.shape[1] and bool(np.allclose(a, a.T, atol=tol, rtol=0))


def is_positive_definite(a: np.ndarray) -> bool:
    return is_symmetric(a) and bool(np.linalg.eigvalsh(a).min() > 0)


def gram_schmidt(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Orthonormal vectors of the same span; dependent ones are left out."""
    out: list[np.ndarray] = []
    for v in vectors:
        w = np.asarray(v, float) - sum((u * (u @ v) for u in out), np.zeros(len(v)))
        if np.linalg.norm(w) > 1e-10:
            out.append(w / np.linalg.norm(w))
    return out


def factorization_report(a: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, float]:
    return {"reconstruction": float(np.abs(q @ r - a).max()), "orthogonality": float(np.abs(q.T @ q - np.eye(q.shape[1])).max()), "triangularity": float(np.abs(np.tril(r, -1)).max(initial=0.0))}
