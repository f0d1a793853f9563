"""A small gated recurrent language model in numpy, with a class-factored output softmax.

A token's probability is that of its class times that within its class, so a step costs
about two square roots of the vocabulary. Training backpropagates through windows of
``WINDOW`` steps; the state is carried from window to window of a document, in training
and in scoring, so a document's likelihood is that of the whole document. Documents are
laid one after another into lanes of like length, which take a step together; the state
of a lane starts at zero with every document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
WINDOW = 32
LANES = 256
RATE = 0.008
#: Logits of which single precision sums the powers of e without care.
_SAFE = 80

Params = dict[str, np.ndarray]


def layout(n_tokens: int) -> tuple[int, int]:
    """Classes and tokens per class."""
    per_class = max(2, int(np.ceil(np.sqrt(n_tokens))))
    return -(-n_tokens // per_class), per_class


def initial(n_tokens: int, hidden: int = HIDDEN, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    classes, per_class = layout(n_tokens)
    some = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, dtype=np.float32)
    return {
        "embed": some(n_tokens, hidden),
        "w": some(hidden, 3 * hidden),
        "u": some(hidden, 3 * hidden),
        "b": zero(3 * hidden),
        "class_w": some(hidden, classes),
        "class_b": zero(classes),
        "token_w": some(classes, per_class, hidden),
        "token_b": zero(classes, per_class),
    }


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x) in place, rows that may overflow or vanish less their maximum, each row's sum, and its log."""
    shift = None
    # Every row has a place that a token has, and what is below -_SAFE elsewhere does not count.
    if not (x.max() < _SAFE and x[:, 0].min() > -_SAFE):
        shift = x.max(axis=1)
        x -= shift[:, None]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    logs = np.log(sums)
    return x, sums, logs if shift is None else logs + shift


def _shares(x: np.ndarray, own: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of the rows, in place, less 1 at ``own``; and the log of what stood there, one for each of ``own``."""
    at = x[own]
    x, sums, logs = _exp(x)
    x /= sums[:, None]
    x[own] -= 1
    return x, at - logs[own[0]]


def _valid(p: Params, n_tokens: int) -> np.ndarray:
    """Log of 0 or 1 for the places of the last class that no token has."""
    places = np.arange(p["token_b"].size).reshape(p["token_b"].shape)
    return np.where(places < n_tokens, np.float32(0), np.float32(-1e9))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... below each of the sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _states(p: Params, inputs: np.ndarray, goes_on: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """The states after every step, and what the way back needs; within the steps lanes stand side by side."""
    hidden = state.shape[1]
    x = p["embed"][inputs]
    # Halved, as sigmoid(x) = (tanh(x / 2) + 1) / 2.
    half = np.repeat(np.array([0.5, 1], p["w"].dtype), [2 * hidden, hidden])
    from_x = np.matmul((p["w"] * half).T, x.transpose(0, 2, 1)) + (p["b"] * half)[:, None]
    u, state = np.ascontiguousarray((p["u"] * half).T), np.ascontiguousarray(state.T)
    out, saved = np.empty((len(inputs), *state.shape), dtype=np.float32), []
    for t in range(len(inputs)):
        state = state * goes_on[t]
        from_h = u @ state
        gates = from_x[t, : 2 * hidden] + from_h[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        r, z = gates[:hidden], gates[hidden:]
        n = r * from_h[2 * hidden :]
        n += from_x[t, 2 * hidden :]
        np.tanh(n, out=n)
        saved.append((state, r, z, n, from_h[2 * hidden :]))
        state = state - n
        state *= z
        state += n
        out[t] = state
    return np.ascontiguousarray(out.transpose(0, 2, 1)), saved, x


def _output(p: Params, states: np.ndarray, targets: np.ndarray, grads: Params | None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability (e) of every target; with ``grads``, adds to them and gives the states' gradient."""
    per_class, valid = p["token_b"].shape[1], _valid(p, len(p["embed"]))
    if not len(targets):
        return np.zeros(0, states.dtype), states
    # By class, so that each class has its rows side by side.
    order = np.argsort(targets // per_class, kind="stable")
    classes, places = np.divmod(targets[order], per_class)
    h_all, rows = states[order], np.arange(len(targets))
    back, own = None, (rows, classes)
    by_class = h_all @ p["class_w"] + p["class_b"]
    if grads is None:
        logs = by_class[own]
        logs -= _exp(by_class)[2]
    else:
        d, logs = _shares(by_class, own)
        grads["class_w"] += h_all.T @ d
        grads["class_b"] += d.sum(axis=0)
        back = d @ p["class_w"].T
    counts = np.bincount(classes, minlength=len(p["token_b"]))
    cuts = np.append(0, np.cumsum(counts))
    # Classes of few rows are taken together, filled up to like length; the others one by one.
    together = np.flatnonzero((counts > 0) & (counts <= len(targets) / len(counts)))
    for some in [together, *(np.array([k]) for k in np.flatnonzero(counts > len(targets) / len(counts)))]:
        if not len(some):
            continue
        size = counts[some]
        at = np.repeat(cuts[some], size) + _ranges(size)
        group, place = np.repeat(np.arange(len(some)), size), _ranges(size)
        h = np.zeros((len(some), int(size.max()), h_all.shape[1]), h_all.dtype)
        h[group, place] = h_all[at]
        token_w = p["token_w"][some]
        x = np.matmul(h, token_w.transpose(0, 2, 1)) + (p["token_b"] + valid)[some][:, None]
        x, own = x.reshape(-1, per_class), (group * h.shape[1] + place, places[at])
        if grads is None:
            logs[at] += x[own]
            logs[at] -= _exp(x)[2][own[0]]
        else:
            d, inside = _shares(x, own)
            logs[at] += inside
            d = d.reshape(*h.shape[:2], per_class)
            grads["token_w"][some] += np.matmul(d.transpose(0, 2, 1), h)
            filled = (np.arange(h.shape[1]) < size[:, None]).astype(d.dtype)
            grads["token_b"][some] += np.matmul(filled[:, None], d)[:, 0]
            back[at] += np.matmul(d, token_w)[group, place]
    found = np.empty_like(logs)
    found[order] = logs
    if back is None:
        return found, states
    to_states = np.empty_like(back)
    to_states[order] = back
    return found, to_states


def window_gradient(
    p: Params, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, goes_on: np.ndarray, state: np.ndarray
) -> tuple[float, Params, np.ndarray]:
    """Loss of a window (steps x lanes), gradients cut off at its start, and the last state."""
    hidden = state.shape[1]
    states, saved, x = _states(p, inputs, goes_on, state)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    logs, back = _output(p, states[mask], targets[mask], grads)
    to_state = np.zeros_like(states)
    to_state[mask] = back
    to_state = np.ascontiguousarray(to_state.transpose(0, 2, 1))
    to_x = np.empty((len(inputs), 3 * hidden, inputs.shape[1]), dtype=np.float32)
    to_h, after = np.empty_like(to_x), np.zeros_like(to_state[0])
    for t in range(len(inputs) - 1, -1, -1):
        before, r, z, n, h_n = saved[t]
        d = to_state[t] + after
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (before - n) * z * (1 - z)
        d_r = d_n * h_n * r * (1 - r)
        from_h = np.concatenate([d_r, d_z, d_n * r])
        to_x[t] = from_h
        to_x[t, 2 * hidden :] = d_n
        to_h[t] = from_h
        after = (d * z + p["u"] @ from_h) * goes_on[t]
    held = np.stack([before for before, *_ in saved]).transpose(0, 2, 1).reshape(-1, hidden)
    grads["u"] += held.T @ to_h.transpose(0, 2, 1).reshape(-1, 3 * hidden)
    flat = to_x.transpose(0, 2, 1).reshape(-1, 3 * hidden)
    grads["w"] += x.reshape(-1, hidden).T @ flat
    grads["b"] += flat.sum(axis=0)
    tokens = inputs.reshape(-1)
    order = np.argsort(tokens, kind="stable")
    known, starts = np.unique(tokens[order], return_index=True)
    grads["embed"][known] += np.add.reduceat((flat @ p["w"].T)[order], starts)
    return -float(logs.sum()), grads, states[-1]


def _windows(docs: list[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, targets, the document of each cell (-1: none), and 1 where it goes on, steps x lanes.

    The input of a step is the token before its target, at first an end.
    """
    lanes: list[tuple[int, int, list[int]]] = [(0, k, []) for k in range(min(LANES, len(docs)))]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        length, k, held = lanes[0]
        heapq.heapreplace(lanes, (length + len(docs[i]) + 1, k, [*held, i]))
    lanes.sort(key=lambda lane: -lane[0])
    lengths = np.array([length for length, _, _ in lanes])
    steps = int(lengths[0])
    inputs = np.full((len(lanes), steps), end, dtype=np.int32)
    targets, of = inputs.copy(), np.full(inputs.shape, -1, dtype=np.int32)
    for lane, (_, _, held) in enumerate(lanes):
        at = 0
        for i in held:
            size = len(docs[i])
            targets[lane, at : at + size] = docs[i]
            inputs[lane, at + 1 : at + 1 + size] = docs[i]
            of[lane, at : at + size + 1] = i
            at += size + 1
    goes_on = np.zeros(of.shape, dtype=np.float32)
    goes_on[:, 1:] = of[:, 1:] == of[:, :-1]
    for at in range(0, steps, WINDOW):
        # Lanes that have ended, the last ones, are left out.
        n = int((lengths > at).sum())
        yield tuple(np.ascontiguousarray(x[:n, at : at + WINDOW].T) for x in (inputs, targets, of, goes_on))


def scores(p: Params, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Log10 probability of every document and its end, by the model."""
    total = np.zeros(len(docs))
    state = np.zeros((min(LANES, len(docs)), p["u"].shape[0]), dtype=np.float32)
    for inputs, targets, of, goes_on in _windows(docs, end):
        states, _, _ = _states(p, inputs, goes_on, state[: inputs.shape[1]])
        state, mask = states[-1], of >= 0
        logs, _ = _output(p, states[mask], targets[mask], None)
        total += np.bincount(of[mask], weights=logs, minlength=len(docs))
    return total / np.log(10)


class Trainer:
    """Adam over the windows of the documents given."""

    def __init__(self, params: Params) -> None:
        self.params = {k: v.copy() for k, v in params.items()}
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}
        self.steps, self.tokens = 0, 0

    def learn(self, docs: list[np.ndarray], end: int) -> None:
        state = np.zeros((min(LANES, len(docs)), self.params["u"].shape[0]), dtype=np.float32)
        for inputs, targets, of, goes_on in _windows(docs, end):
            mask = of >= 0
            _, grads, state = window_gradient(self.params, inputs, targets, mask, goes_on, state[: inputs.shape[1]])
            self._step(grads, int(mask.sum()))

    def _step(self, grads: Params, n: int) -> None:
        self.steps += 1
        self.tokens += n
        rate = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            g /= max(n, 1)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.params[k] -= rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-6)


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def shaped(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
