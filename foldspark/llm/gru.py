"""A small gated recurrent language model in numpy, with a class-factored output.

Symbols are numbered by classes: class c owns the symbols from ``cuts[c]`` to ``cuts[c + 1]``, and the probability of
a symbol is that of its class times that within the class. Symbol 0 ends a text and stands before its first symbol.
"""

from __future__ import annotations

import numpy as np

Net = dict[str, np.ndarray]
HIDDEN = 16
WINDOW = 20
LANES = 160
CHUNK = 4_096  # targets whose logits are held at once
ABREAST = 1_000  # texts read side by side when scoring, which bounds the memory


def start(counts: np.ndarray, cuts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Net:
    """Random weights; the output biases reproduce the symbols' frequencies."""
    rng = np.random.default_rng(seed)
    size = len(counts)
    log = np.log(counts + 0.5)
    of_class = np.add.reduceat(counts + 0.5, cuts[:-1])
    net = {
        "E": rng.normal(0, 0.3, (size, hidden)),
        "W": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
        "U": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
        "b": np.zeros(3 * hidden),
        "K": np.zeros((hidden, len(of_class))),
        "c": np.log(of_class),
        "O": np.zeros((size, hidden)),
        "o": log,
    }
    return {k: v.astype(np.float32) for k, v in net.items()}


def flat(net: Net) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in net.values()])


def shaped(values: np.ndarray, like: Net) -> Net:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def step(net: Net, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One time step; ``x`` are the input projections, ``h`` the states: (new state, z, r, n, recurrent part of n)."""
    hidden = h.shape[1]
    u = h @ net["U"]
    gates = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
    z, r = gates[:, :hidden], gates[:, hidden:]
    un = u[:, 2 * hidden :]
    n = np.tanh(x[:, 2 * hidden :] + r * un)
    return n + z * (h - n), z, r, n, un


def _choice(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of the chosen row of every column, exponentials, their sums) of logits; ``x`` is overwritten.

    Alternatives are rows, so that maxima and sums run along memory for all columns at once.
    """
    x -= x.max(axis=0)
    log = x[chosen, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return log - np.log(total), x, total


def _by_class(cuts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(order of the targets by class, their classes in it, (first and last symbol, first and last place) of classes with a choice)"""
    kind = np.searchsorted(cuts, targets, side="right") - 1
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    bounds = np.searchsorted(kind, np.arange(len(cuts))).tolist()
    ends = cuts.tolist()
    spans = zip(ends, ends[1:], bounds, bounds[1:])
    return order, kind, [s for s in spans if s[1] - s[0] > 1 and s[3] > s[2]]


def log_probability(net: Net, cuts: np.ndarray, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after each state."""
    order, kind, spans = _by_class(cuts, targets)
    s, y = states[order], targets[order]
    log = np.empty(len(y))
    for at in range(0, len(y), CHUNK):
        some = slice(at, at + CHUNK)
        log[some] = _choice(net["K"].T @ s[some].T + net["c"][:, None], kind[some])[0]
    for low, high, first, last in spans:
        for at in range(first, last, CHUNK):
            some = slice(at, min(at + CHUNK, last))
            log[some] += _choice(net["O"][low:high] @ s[some].T + net["o"][low:high, None], y[some] - low)[0]
    out = np.empty(len(y))
    out[order] = log
    return out


def _summed(rows: np.ndarray, ids: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Sums of the rows of each id, in an array like ``like``."""
    out = np.zeros_like(like)
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    out[found[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradients(net: Net, cuts: np.ndarray, ids: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[Net, np.ndarray, float]:
    """Backpropagation through one window (time, lanes): gradients of the mean loss, last state, mean loss."""
    steps, lanes = ids.shape
    hidden = h.shape[1]
    g = {k: np.zeros_like(v) for k, v in net.items()}
    flat_ids = ids.reshape(-1)
    inputs = net["E"][flat_ids]
    xs = (inputs @ net["W"] + net["b"]).reshape(steps, lanes, -1)
    goes_on = (ids != 0).astype(np.float32)[:, :, None]  # a text begins with a clear state
    befores, zs, rs, ns, uns, states = (np.empty((steps, lanes, hidden), np.float32) for _ in range(6))
    for t in range(steps):
        np.multiply(h, goes_on[t], out=befores[t])
        h, zs[t], rs[t], ns[t], uns[t] = step(net, xs[t], befores[t])
        states[t] = h
    y = targets.reshape(-1)
    count = len(y)
    order, kind, spans = _by_class(cuts, y)
    s, y = states.reshape(-1, hidden)[order], y[order]
    place = np.arange(count)

    def outer(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, float]:
        log, d, total = _choice(x, chosen)
        d /= total * np.float32(count)
        d[chosen, place[: len(chosen)]] -= np.float32(1 / count)
        return d, -float(log.sum())

    d, loss = outer(net["K"].T @ s.T + net["c"][:, None], kind)
    g["K"], g["c"] = (d @ s).T, d.sum(axis=1)
    sorted_ds = d.T @ net["K"].T
    for low, high, first, last in spans:
        some, weights = s[first:last], net["O"][low:high]
        d, more = outer(weights @ some.T + net["o"][low:high, None], y[first:last] - low)
        loss += more
        g["O"][low:high], g["o"][low:high] = d @ some, d.sum(axis=1)
        sorted_ds[first:last] += d.T @ weights
    ds = np.empty_like(sorted_ds)
    ds[order] = sorted_ds
    ds = ds.reshape(steps, lanes, hidden)
    # what does not depend on later steps is computed for the whole window
    by_n = (1 - zs) * (1 - ns * ns)
    by_z = (befores - ns) * zs * (1 - zs)
    by_r = uns * rs * (1 - rs)
    dus = np.empty((steps, lanes, 3 * hidden), np.float32)
    dns = np.empty((steps, lanes, hidden), np.float32)
    back = np.ascontiguousarray(net["U"].T)
    dh = np.zeros((lanes, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + ds[t]
        du, dn = dus[t], dns[t]
        np.multiply(dh, by_n[t], out=dn)
        np.multiply(dh, by_z[t], out=du[:, :hidden])
        np.multiply(dn, by_r[t], out=du[:, hidden : 2 * hidden])
        np.multiply(dn, rs[t], out=du[:, 2 * hidden :])
        dh = (dh * zs[t] + du @ back) * goes_on[t]
    flat_du = dus.reshape(-1, 3 * hidden)
    g["U"] = befores.reshape(-1, hidden).T @ flat_du
    wide = flat_du.copy()
    wide[:, 2 * hidden :] = dns.reshape(-1, hidden)
    g["b"] = wide.sum(axis=0)
    g["W"] = inputs.T @ wide
    g["E"] = _summed(wide @ net["W"].T, flat_ids, net["E"])
    return g, h, loss / count


def train(net: Net, cuts: np.ndarray, stream: np.ndarray, rate: float = 0.1) -> Net:
    """Truncated backpropagation with Adagrad over ``stream``, texts one after the other, each ended by 0.

    The stream is cut into lanes read side by side; the state is carried from window to window.
    """
    lanes = min(LANES, max(1, len(stream) // WINDOW))
    length = len(stream) // lanes
    if not length:
        return net
    net = {k: v.copy() for k, v in net.items()}
    squares = {k: np.full_like(v, 1e-6) for k, v in net.items()}
    before = np.concatenate([[0], stream[:-1]])
    ids, targets = (x[: lanes * length].reshape(lanes, length).T for x in (before, stream))
    h = np.zeros((lanes, net["U"].shape[0]), np.float32)
    for at in range(0, length, WINDOW):
        g, h, _ = gradients(net, cuts, ids[at : at + WINDOW], targets[at : at + WINDOW], h)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        for k, x in g.items():
            x = x * np.float32(scale)
            squares[k] += x * x
            net[k] -= np.float32(rate) * x / np.sqrt(squares[k])
    return net


def score(net: Net, cuts: np.ndarray, flat_ids: np.ndarray, lengths: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log probability of each text; ``flat_ids`` holds the texts one after the other, each ended by 0.

    Texts are read side by side, the longest first, so that the ones still running are the first rows; the state
    is carried across windows to the end of every text. At most ``ABREAST`` texts of similar lengths are read at once.
    """
    if len(lengths) > ABREAST:
        ends = np.cumsum(lengths)
        total = np.zeros(len(lengths))
        by_length = np.argsort(-lengths, kind="stable")
        for at in range(0, len(lengths), ABREAST):
            some = by_length[at : at + ABREAST]
            ids = np.concatenate([flat_ids[ends[i] - lengths[i] : ends[i]] for i in some])
            total[some] = score(net, cuts, ids, lengths[some], window)
        return total
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], offsets[order]
    total = np.zeros(len(lengths))
    project = net["E"] @ net["W"] + net["b"]
    h = np.zeros((len(lengths), net["U"].shape[0]), np.float32)
    last = np.zeros(len(lengths), np.int64)
    for at in range(0, int(lengths.max(initial=0)), window):
        states, rows, targets = [], [], []
        for t in range(at, min(at + window, int(sizes[0]))):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
            h = step(net, project[last[:live]], h[:live])[0]
            last = flat_ids[starts[:live] + t]
            states.append(h)
            rows.append(np.arange(live))
            targets.append(last)
        value = log_probability(net, cuts, np.concatenate(states), np.concatenate(targets))
        total[order] += np.bincount(np.concatenate(rows), value, len(lengths))
    return total
