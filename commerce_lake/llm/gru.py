"""A gated recurrent language model in numpy with a class-factored output softmax.

The output vocabulary has frequent words, and rare classes that stand for all words
without a place of their own (the caller knows the share of a rare word in its class);
both are grouped in classes with a softmax each.  Training is truncated backpropagation over windows of ``WINDOW`` steps of many
texts side by side; the state is carried from window to window and reset where a text
starts.
"""

from __future__ import annotations

import numpy as np

WINDOW = 16
HIDDEN = 24
LANES = 256
LEAST_WINDOWS = 256
RATE = 0.1
#: Logits may lie so far below one common shift before single precision loses them.
SAFE_SPREAD = 80.0
BLOCK = 1024
_TRAINED = ("rec", "bias", "wc", "bc", "wo", "bo")


def init(n_words: int, class_size: int, n_rare: int, word_counts: np.ndarray, rare_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose outputs are the unigram model. Inputs and outputs: words, then rare classes."""
    rng = np.random.default_rng(seed)
    padded = lambda counts: np.append(np.log(counts + 1.0), np.full(-len(counts) % class_size, -30.0)).reshape(-1, class_size)
    by_class = np.concatenate((padded(word_counts), padded(rare_counts)))
    mass = np.exp(by_class).sum(1)
    f = np.float32
    return {
        "emb": (0.1 * rng.standard_normal((n_words + n_rare, 3 * hidden))).astype(f),
        "rec": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden) * 0.5).astype(f),
        "bias": np.concatenate((np.full(hidden, 0.5), np.zeros(2 * hidden))).astype(f),
        "wc": (0.01 * rng.standard_normal((hidden, len(by_class)))).astype(f),
        "bc": np.log(mass / mass.sum()).astype(f),
        "wo": np.zeros((len(by_class), hidden, class_size), f),
        "bo": by_class.astype(f),
        "size": np.array([n_words, class_size, n_rare]),
    }


def step(p: dict, a: np.ndarray, h: np.ndarray):
    """One step for rows of inputs a (embedding and bias) and states h: new state and what backpropagation needs."""
    n = h.shape[1]
    u = h @ p["rec"]
    gates = a[:, : 2 * n] + u[:, : 2 * n]
    np.negative(gates, out=gates)
    with np.errstate(over="ignore"):
        np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r, un = gates[:, :n], gates[:, n:], u[:, 2 * n :]
    new = r * un
    new += a[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, (z, r, new, un)


def _softmax(logits: np.ndarray, own: np.ndarray, want_rest: bool) -> np.ndarray:
    """Log probability of the column ``own`` of each row; logits become its gradient by the logits, if wanted."""
    rows = np.arange(len(logits))
    top = logits.max()
    if top - logits.min() > SAFE_SPREAD:
        top = logits.max(1, keepdims=True)
    logits -= top
    mine = logits[rows, own]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    if want_rest:
        e *= (-1 / total)[:, None]
        e[rows, own] += 1
    return mine - np.log(total)


def log_probs(p: dict, hs: np.ndarray, target: np.ndarray, grads: dict | None = None):
    """Natural log of P(class) P(word in class) for each row; of P(rare class) for rare words.

    With grads, also adds the gradients of the sum and returns that of hs.  Rows are taken in
    the order of their classes, in blocks that stay in the processor's cache."""
    n_words, width, _ = p["size"].tolist()
    n_classes, want = len(p["wo"]), grads is not None
    place = np.where(target >= n_words, target + -n_words % width, target)  # rare classes open a new class
    cls = (place // width).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cls, own = cls[order].astype(np.intp), place[order] % width
    some = np.take(hs, order, axis=0)
    out, back = np.empty(len(some), hs.dtype), np.empty_like(some) if want else None
    for i in range(0, len(some), BLOCK):
        h = some[i : i + BLOCK]
        logits = h @ p["wc"]
        logits += p["bc"]
        out[i : i + BLOCK] = _softmax(logits, cls[i : i + BLOCK], want)
        if want:
            grads["wc"] += h.T @ logits
            grads["bc"] += np.ones(len(h), h.dtype) @ logits
            np.matmul(logits, p["wc"].T, out=back[i : i + BLOCK])
    edge = np.searchsorted(cls, np.arange(n_classes + 1)).tolist()
    inner = np.empty((len(some), width), hs.dtype)
    spans = [(c, i, j) for c, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
    for c, i, j in spans:
        np.matmul(some[i:j], p["wo"][c], out=inner[i:j])
        inner[i:j] += p["bo"][c]
    for i in range(0, len(some), BLOCK):
        out[i : i + BLOCK] += _softmax(inner[i : i + BLOCK], own[i : i + BLOCK], want)
    result = np.empty_like(out)
    result[order] = out
    if not want:
        return result, None
    for c, i, j in spans:
        d = inner[i:j]
        back[i:j] += d @ p["wo"][c].T
        grads["wo"][c] += some[i:j].T @ d
        grads["bo"][c] += np.ones(j - i, d.dtype) @ d
    dh = np.empty_like(back)
    dh[order] = back
    return result, dh


def backpropagate(p: dict, x: np.ndarray, fresh: np.ndarray, target: np.ndarray, h: np.ndarray, grads: dict):
    """One window: inputs x, marks of texts that start, and targets, all (steps, lanes); h is the state before it.

    Adds the gradients of the sum of log probabilities; returns the sum, the state after
    the window, the input ids and the gradients of their embeddings."""
    steps, lanes = x.shape
    n = h.shape[1]
    a = np.take(p["emb"], x, axis=0)
    a += p["bias"]
    kept, before, after = [], np.empty((steps, lanes, n), h.dtype), np.empty((steps, lanes, n), h.dtype)
    for t in range(steps):
        before[t] = h
        before[t][fresh[t]] = 0
        h, own = step(p, a[t], before[t])
        after[t] = h
        kept.append(own)
    score, dh_all = log_probs(p, after.reshape(-1, n), target.ravel(), grads)
    dh_all = dh_all.reshape(steps, lanes, n)
    da, du = np.empty((steps, lanes, 3 * n), h.dtype), np.empty((steps, lanes, 3 * n), h.dtype)
    back, dh = np.ascontiguousarray(p["rec"].T), np.zeros((lanes, n), h.dtype)
    for t in range(steps - 1, -1, -1):
        z, r, new, un = kept[t]
        dh += dh_all[t]
        d = da[t]
        np.multiply(dh, 1 - z, out=d[:, 2 * n :])
        d[:, 2 * n :] *= 1 - new * new
        np.multiply(dh, before[t] - new, out=d[:, :n])
        d[:, :n] *= z * (1 - z)
        np.multiply(d[:, 2 * n :], un, out=d[:, n : 2 * n])
        d[:, n : 2 * n] *= r * (1 - r)
        du[t] = d
        du[t][:, 2 * n :] *= r
        dh *= z
        dh += du[t] @ back
        dh[fresh[t]] = 0
    grads["rec"] += before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
    grads["bias"] += da.sum((0, 1))
    return score, h, x.ravel(), da.reshape(-1, 3 * n)


def train(p: dict, ids: np.ndarray, start: np.ndarray, lanes: int = LANES, rate: float = RATE) -> dict:
    """Fit to a stream of ids in one pass; start marks the first id of a text. Returns new parameters,
    with the sums of squared gradients (``seen_*``), from which a later call goes on.

    The stream is cut into at most ``lanes`` lanes that run side by side; few enough that
    short streams get ``LEAST_WINDOWS`` windows. The ids that do not fill all lanes follow in one."""
    p = {k: v.copy() for k, v in p.items()}
    lanes = max(1, min(lanes, len(ids) // (LEAST_WINDOWS * WINDOW)))
    seen = {k: p.setdefault(f"seen_{k}", np.full(p[k].shape, 1e-2, np.float32)) for k in (*_TRAINED, "emb")}
    whole = len(ids) // lanes * lanes
    for i, j, side in ((0, whole, lanes), (whole, len(ids), 1)):
        if i < j:
            _train_lanes(p, seen, ids[i:j].reshape(side, -1).T, start[i:j].reshape(side, -1).T, rate, np.float32(1.0 / lanes))
    return p


def _train_lanes(p: dict, seen: dict, target: np.ndarray, fresh: np.ndarray, rate: float, scale: np.float32) -> None:
    """Window after window of targets (steps, lanes): gradients and a step up them."""
    target, fresh = np.ascontiguousarray(target), np.ascontiguousarray(fresh)
    end = int(p["size"][0]) - 1  # the end id opens a text
    x = np.concatenate((np.full((1, target.shape[1]), end, target.dtype), target[:-1]))
    x[fresh] = end
    grads = {k: np.empty_like(p[k]) for k in _TRAINED}
    h = np.zeros((target.shape[1], p["rec"].shape[0]), np.float32)
    for t in range(0, len(target), WINDOW):
        for g in grads.values():
            g.fill(0)
        _, h, rows, demb = backpropagate(p, x[t : t + WINDOW], fresh[t : t + WINDOW], target[t : t + WINDOW], h, grads)
        for k, g in grads.items():
            _ascend(p[k], seen[k], g, scale, rate)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g, at = np.add.reduceat(np.take(demb, order, axis=0), first, axis=0), rows[first]
        own, past = p["emb"][at], seen["emb"][at]
        _ascend(own, past, g, scale, rate)
        p["emb"][at], seen["emb"][at] = own, past


def _ascend(p: np.ndarray, seen: np.ndarray, g: np.ndarray, scale: np.float32, rate: float) -> None:
    """A step up the clipped gradient, divided by the root of the sum of its squares so far."""
    g *= scale
    np.clip(g, -1, 1, out=g)
    seen += g * g
    g *= rate
    g /= np.sqrt(seen)
    p += g


def score(p: dict, ids: np.ndarray, bounds: np.ndarray, most: int = 4096) -> np.ndarray:
    """Sum of log_probs over each text's ids (text i: bounds[i]:bounds[i+1]), state carried to its end."""
    n = p["rec"].shape[0]
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    total = np.zeros(len(order))
    end = int(p["size"][0]) - 1
    inputs = p["emb"] + p["bias"]
    for g in range(0, len(order), 1024):  # lanes: texts of similar length, the longest first
        own, at = size[g : g + 1024], first[g : g + 1024]
        h = np.zeros((len(own), n), np.float32)
        prev = np.full(len(own), end)
        t, longest = 0, int(own[0])
        while t < longest:
            hs, targets, lanes, rows = [], [], [], 0
            while t < longest and rows < most and len(lanes) < most:
                active = int(np.searchsorted(-own, -t, side="left"))  # texts longer than t
                h, _ = step(p, np.take(inputs, prev[:active], axis=0), h[:active])
                prev = ids[at[:active] + t]
                hs.append(h)
                targets.append(prev)
                lanes.append(active)
                rows += active
                t += 1
            out, _ = log_probs(p, np.concatenate(hs), np.concatenate(targets))
            lane = np.concatenate([np.arange(k) for k in lanes])
            total[g : g + len(own)] += np.bincount(lane, out, minlength=len(own))
    result = np.zeros(len(order))
    result[order] = total
    return result
