"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy.

Two levels of one kind: characters are read into a vector for each distinct word, and
those, beside an embedding of the known words, are read into a vector for each window.
Sequences are laid out time first; a mask tells which steps are there.
"""

from __future__ import annotations

import numpy as np

#: Characters of one token; longer words are taken in pieces of so many.
TOKEN = 16
CHAR_CODES, CHAR_SIZE, CHAR_HIDDEN = 128, 8, 8
WORD_SIZE, WORD_HIDDEN = 12, 12

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def initial(seed: int, n_words: int) -> Params:
    """Fresh parameters; n_words known words, and row 0 for all others."""
    rng = np.random.default_rng(seed)

    def matrix(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    out = {"chars": matrix(CHAR_CODES, CHAR_SIZE, scale=0.3), "words": matrix(n_words + 1, WORD_SIZE, scale=0.1)}
    for level, size, hidden in (("c", CHAR_SIZE, CHAR_HIDDEN), ("w", WORD_SIZE + 2 * CHAR_HIDDEN, WORD_HIDDEN)):
        for way in "fb":
            out[f"{level}{way}W"], out[f"{level}{way}U"] = matrix(size, 3 * hidden), matrix(hidden, 3 * hidden)
            out[f"{level}{way}B"] = np.zeros(3 * hidden, np.float32)
        out[f"{level}A"] = matrix(2 * hidden, scale=0.1)
    return out | {"out": matrix(2 * WORD_HIDDEN), "bias": np.zeros(1, np.float32)}


def gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """States (time, rows, hidden) for projected inputs x (time, rows, 3 * hidden); `back` reads from the end.

    A masked step leaves the state as it is. No mask: every step is there. tape takes what gru_gradient needs.
    """
    steps, rows, width = x.shape
    n = width // 3
    state, out = np.zeros((rows, n), np.float32), np.empty((steps, rows, n), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        held = state @ u
        gates = held[:, : 2 * n] + x[t, :, : 2 * n]
        gates = _sigmoid(gates)
        z, r = gates[:, :n], gates[:, n:]
        new = _tanh(x[t, :, 2 * n :] + r * held[:, 2 * n :])
        after = new + z * (state - new)
        if mask is not None:
            after = np.where(mask[t][:, None], after, state)
        if tape is not None:
            tape.append((t, state, gates, new, held[:, 2 * n :]))
        out[t] = state = after
    return out


def gru_gradient(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, for d_out of the states."""
    steps, rows, n = d_out.shape
    dx, du, carried = np.zeros((steps, rows, 3 * n), np.float32), np.zeros_like(u), np.zeros((rows, n), np.float32)
    for t, state, gates, new, held in reversed(tape):
        here = mask[t][:, None]
        total = d_out[t] + carried
        d = np.where(here, total, 0)
        z, r = gates[:, :n], gates[:, n:]
        d_new = d * (1 - z) * (1 - new * new)
        d_gates = np.concatenate([d * (state - new), d_new * held], axis=1) * gates * (1 - gates)
        d_held = np.concatenate([d_gates, d_new * r], axis=1)
        du += state.T @ d_held
        carried = np.where(here, d * z, total) + d_held @ u.T
        dx[t, :, : 2 * n], dx[t, :, 2 * n :] = d_gates, d_new
    return dx, du


def pool(states: np.ndarray, mask: np.ndarray | None, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the states by attention (softmax of states @ a), and the shares. Rows without any step give zeros."""
    by = states @ a
    if mask is not None:
        by = np.where(mask, by, -np.inf)
    top = by.max(axis=0)
    share = np.exp(by - np.where(np.isfinite(top), top, 0))
    share /= np.maximum(share.sum(axis=0), 1e-9)
    return np.einsum("tb,tbn->bn", share, states), share


def pool_gradient(d: np.ndarray, states: np.ndarray, share: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    along = np.einsum("bn,tbn->tb", d, states)
    d_by = share * (along - (share * along).sum(axis=0))
    return share[:, :, None] * d + d_by[:, :, None] * a, np.einsum("tb,tbn->n", d_by, states)


def read(p: Params, level: str, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """The pooled vector of each sequence of projected inputs."""
    states = np.concatenate([gru(forward, mask, p[f"{level}fU"], False), gru(backward, mask, p[f"{level}bU"], True)], axis=2)
    return pool(states, mask, p[f"{level}A"])[0]


class Level:
    """One level with what its gradient needs."""

    def __init__(self, p: Params, level: str, x: np.ndarray, mask: np.ndarray):
        self.p, self.level, self.x, self.mask = p, level, x, mask
        self.tapes: tuple[list, list] = ([], [])
        states = [gru(x @ p[f"{level}{way}W"] + p[f"{level}{way}B"], mask, p[f"{level}{way}U"], way == "b", tape) for way, tape in zip("fb", self.tapes, strict=True)]
        self.states = np.concatenate(states, axis=2)
        self.vector, self.share = pool(self.states, mask, p[f"{level}A"])

    def gradient(self, d: np.ndarray, grads: Params) -> np.ndarray:
        """Adds the gradients of the level's parameters and gives that of its inputs."""
        d_states, grads[f"{self.level}A"] = pool_gradient(d, self.states, self.share, self.p[f"{self.level}A"])
        n, dx = d_states.shape[2] // 2, 0
        for way, tape, part in zip("fb", self.tapes, (d_states[:, :, :n], d_states[:, :, n:]), strict=True):
            name = f"{self.level}{way}"
            d_in, grads[f"{name}U"] = gru_gradient(part, self.mask, self.p[f"{name}U"], tape)
            flat = d_in.reshape(-1, d_in.shape[2])
            grads[f"{name}W"], grads[f"{name}B"] = self.x.reshape(-1, self.x.shape[2]).T @ flat, flat.sum(axis=0)
            dx = dx + d_in @ self.p[f"{name}W"].T
        return dx


def loss_and_gradient(p: Params, chars: np.ndarray, codes: np.ndarray, windows: np.ndarray, label: np.ndarray, weight: np.ndarray, keep: np.ndarray | None = None) -> tuple[float, Params]:
    """Weighted cross entropy of some windows and the gradients of every parameter.

    chars (tokens, TOKEN): character codes of the distinct tokens, -1 behind the end.
    codes (tokens): their rows in the word embedding. windows (rows, width): token numbers, -1 for none.
    keep (tokens): 0 where the word's own embedding is left out, for training.
    """
    grads: Params = {"chars": np.zeros_like(p["chars"]), "words": np.zeros_like(p["words"])}
    there = (chars >= 0).T
    letters = Level(p, "c", p["chars"][np.maximum(chars, 0)].transpose(1, 0, 2), there)
    known = p["words"][codes] * (1 if keep is None else keep[:, None])
    token = np.concatenate([known, letters.vector], axis=1).astype(np.float32)
    inside = (windows >= 0).T
    words = Level(p, "w", token[np.maximum(windows, 0)].transpose(1, 0, 2), inside)
    odds = words.vector @ p["out"] + p["bias"]
    prob = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    loss = -np.sum(weight * (label * np.log(prob + 1e-9) + (1 - label) * np.log(1 - prob + 1e-9)))
    d = (weight * (prob - label)).astype(np.float32)
    grads["out"], grads["bias"] = words.vector.T @ d, d.sum(keepdims=True)
    d_token = np.zeros_like(token)
    d_words = words.gradient(d[:, None] * p["out"], grads) * inside[:, :, None]
    np.add.at(d_token, np.maximum(windows, 0).T, d_words)
    np.add.at(grads["words"], codes, d_token[:, :WORD_SIZE] * (1 if keep is None else keep[:, None]))
    d_chars = letters.gradient(d_token[:, WORD_SIZE:], grads) * there[:, :, None]
    np.add.at(grads["chars"], np.maximum(chars, 0).T, d_chars)
    return float(loss), grads


def projected(p: Params, chars: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of the window level of each distinct token, projected once for all windows, forward and backward."""
    size = (chars >= 0).sum(axis=1)
    vector = np.zeros((len(chars), 2 * CHAR_HIDDEN), np.float32)
    tables = [p["chars"] @ p[f"c{way}W"] + p[f"c{way}B"] for way in "fb"]
    for least in range(0, TOKEN, 4):  # tokens of like length together
        rows = np.flatnonzero((size > least) & (size <= least + 4))
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            held = chars[some, : least + 4].T
            vector[some] = read(p, "c", *(t[np.maximum(held, 0)] for t in tables), held >= 0)
    token = np.concatenate([p["words"][codes], vector], axis=1)
    return token @ p["wfW"] + p["wfB"], token @ p["wbW"] + p["wbB"]


def odds(p: Params, chars: np.ndarray, codes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Log-odds of each window; -1 stands for no token."""
    forward, backward = projected(p, chars, codes) if len(chars) else (np.zeros((1, 3 * WORD_HIDDEN), np.float32),) * 2
    out = np.empty(len(windows), np.float32)
    full = (windows >= 0).all(axis=1)
    for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
        for at in range(0, len(rows), 2048):
            some = rows[at : at + 2048]
            held = windows[some].T
            mask = None if full[some[0]] else held >= 0
            held = np.maximum(held, 0)
            out[some] = read(p, "w", forward[held], backward[held], mask) @ p["out"] + p["bias"]
    return out


class Adam:
    def __init__(self, p: Params, decay: float):
        self.first, self.second, self.n, self.decay = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, decay

    def step(self, p: Params, grads: Params, rate: float) -> None:
        self.n += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            p[k] -= rate * (self.first[k] / (1 - 0.9**self.n) / (np.sqrt(self.second[k] / (1 - 0.99**self.n)) + 1e-6) + self.decay * p[k])
