"""Forward-backward over many label sequences at once."""

from __future__ import annotations

import numpy as np


def forward_backward(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of each label at each word of sequences laid end to end, and the expected number of changes of each kind."""
    n_labels = moves.shape[0]
    at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    emission = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0)).astype(np.float64) if len(scores) else np.zeros((0, n_labels))
    change = np.exp(moves)
    out = np.zeros((len(scores), n_labels))
    changes = np.zeros(moves.shape)
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    for a in range(0, len(order), 1024):
        rows = order[a : a + 1024]
        n, t = len(rows), int(lens[rows].max())
        own = lens[rows]
        where = at[rows][:, None] + np.arange(t)[None, :]
        inside = np.arange(t)[None, :] < own[:, None]
        e = np.where(inside[:, :, None], emission[np.where(inside, where, 0)], 1.0)
        forward = np.empty((t, n, n_labels))
        x = e[:, 0]
        forward[0] = x / x.sum(axis=1, keepdims=True)
        for k in range(1, t):
            x = (forward[k - 1] @ change) * e[:, k]
            forward[k] = x / x.sum(axis=1, keepdims=True)
        b = np.ones((n, n_labels))
        for k in range(t - 1, -1, -1):
            p = forward[k] * b
            p /= p.sum(axis=1, keepdims=True)
            out[where[inside[:, k], k]] = p[inside[:, k]]
            if k:
                after = e[:, k] * b
                total = ((forward[k - 1] @ change) * after).sum(axis=1)
                part = np.where(inside[:, k], 1 / total, 0.0)
                changes += (forward[k - 1] * part[:, None]).T @ after * change
                nb = after @ change.T
                nb /= nb.sum(axis=1, keepdims=True)
                b = np.where(inside[:, k, None], nb, b)
    return out, changes
