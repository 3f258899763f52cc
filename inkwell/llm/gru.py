"""A gated recurrent language model over words, in numpy: truncated backpropagation, class-factored output, carried state.

A token is one of ``VOCAB`` frequent words (in classes of ``MEMBERS`` by frequency) or one of ``TAILS`` tail classes of all
other words. The output is the chance of the class times the chance within it: by softmax among a class's frequent words;
the caller supplies the chance of a word within a tail class from corpus counts.

Sequences lie end to end on parallel lanes that move together, and a lane's state is set to zero where a text begins, so
the state is carried over all windows of a text, however long.
"""

from __future__ import annotations

import heapq

import numpy as np

VOCAB, MEMBERS, TAILS, HIDDEN, INPUT = 512, 16, 32, 16, 16
CLASSES = VOCAB // MEMBERS + TAILS
SYMBOLS = VOCAB + TAILS + 1  # the last one begins a text
BEGIN = SYMBOLS - 1


def initial(class_log: np.ndarray, member_log: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights that give the unigram model: zero output weights, log frequencies as biases."""
    rnd = np.random.default_rng(seed)
    f = np.float32
    return {
        "E": (rnd.normal(size=(SYMBOLS, INPUT)) * 0.3).astype(f),
        "W": (rnd.normal(size=(INPUT, 3 * HIDDEN)) / np.sqrt(INPUT)).astype(f),
        "U": (rnd.normal(size=(HIDDEN, 3 * HIDDEN)) * 0.5 / np.sqrt(HIDDEN)).astype(f),
        "b": np.zeros(3 * HIDDEN, f),
        "C": np.zeros((HIDDEN, CLASSES), f),
        "c": class_log.astype(f),
        "M": np.zeros((VOCAB // MEMBERS, HIDDEN, MEMBERS), f),
        "m": member_log.reshape(VOCAB // MEMBERS, MEMBERS).astype(f),
    }


def pack(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def unpack(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, reset, text number) by lane and time, -1 for none; longest first onto the shortest lane. With few long
    texts there are fewer lanes, so that padding stays within the size of the texts."""
    sizes = [len(t) for t in texts]
    total, longest = sum(sizes), max(sizes, default=0)
    count = max(1, min(most, total // max(longest, 1)))
    heap = [(0, b) for b in range(count)]
    place = []
    for i in sorted(range(len(texts)), key=lambda i: -sizes[i]):
        at, b = heapq.heappop(heap)
        place.append((i, b, at))
        heapq.heappush(heap, (at + sizes[i], b))
    steps = max((at for at, _ in heap), default=0)
    target = np.full((count, steps), -1, np.int16)
    reset = np.zeros((count, steps), bool)
    number = np.full((count, steps), -1, np.int32)
    for i, b, at in place:
        target[b, at : at + sizes[i]] = texts[i]
        reset[b, at : at + 1] = True
        number[b, at : at + sizes[i]] = i
    return target, reset, number


def _inputs(target: np.ndarray, reset: np.ndarray) -> np.ndarray:
    before = np.empty_like(target)
    before[:, 0] = BEGIN
    before[:, 1:] = target[:, :-1]
    return np.where(reset | (before < 0), BEGIN, before)


def _classes(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of symbols (member -1 in a tail class)."""
    word = target < VOCAB
    return np.where(word, target // MEMBERS, VOCAB // MEMBERS + target - VOCAB), np.where(word, target % MEMBERS, -1)


#: Logits within it need no shift before float32 exponentials: neither these nor their sums leave the range.
SAFE = 60.0


def _within(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether states (each within -1 to 1) can only give logits within SAFE; weights are (..., hidden, classes)."""
    return (np.abs(weights).sum(-2) + np.abs(bias)).max(-1) < SAFE


def _exponentials(x: np.ndarray) -> np.ndarray:
    """Turns shifted logits into exponentials in place; their sums by row, as products with ones: reductions of short rows
    cost several times as much."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _shifted(x: np.ndarray, within: bool) -> np.ndarray:
    """Logits (in place) that exponentials can be taken of."""
    if not within:
        x -= x.max(1, keepdims=True)
    return x


def _parts(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol adds to the three gates, and the matrices of the state, gate by gate so that the steps work on whole
    arrays; halved where a logistic function follows, which is taken by way of tanh, and the state's part throughout (exact)."""
    half = w["U"].dtype.type(0.5)
    table = (w["E"] @ w["W"] + w["b"]).reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy()
    table[:2] *= half
    return table, w["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2) * half


def _begins(reset: np.ndarray) -> list[np.ndarray]:
    """For each step (time, lane) the lanes where a text begins."""
    t, lane = np.nonzero(reset)
    return np.split(lane, np.searchsorted(t, np.arange(1, len(reset))))


def _step(before: np.ndarray, zr: np.ndarray, n: np.ndarray, U: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step of all lanes. ``zr`` and ``n`` hold what the symbols add and then the gates and the new part; ``u`` gets the
    state's part (halved), ``h`` the next state."""
    np.matmul(before, U, out=u)
    zr += u[:2]
    np.tanh(zr, out=zr)
    zr += 1
    np.multiply(u[2], zr[1], out=h)
    n += h
    np.tanh(n, out=n)
    zr *= zr.dtype.type(0.5)
    np.subtract(before, n, out=h)
    h *= zr[0]
    h += n
    return h


class Scorer:
    def __init__(self, weights: dict) -> None:
        self.w = weights
        self.gates, self.U = _parts(weights)
        self.within = _within(weights["C"], weights["c"]), _within(weights["M"], weights["m"])

    def log10(self, texts: list[np.ndarray], most: int = 512, window: int = 48) -> np.ndarray:
        """The log10 chance of each text's symbols (within tail classes: of the class alone)."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        target, reset, number = lanes(texts, most)
        given = _inputs(target, reset)
        h, u = np.zeros((len(target), HIDDEN), np.float32), np.empty((3, len(target), HIDDEN), np.float32)
        for at in range(0, target.shape[1], window):
            x = np.ascontiguousarray(given[:, at : at + window].T)
            begins = _begins(reset[:, at : at + window].T)
            gates = self.gates.take(x, axis=1)
            states = np.empty((len(x), len(h), HIDDEN), np.float32)
            before = np.empty_like(h)
            for t in range(len(x)):
                before[:] = h
                before[begins[t]] = 0
                h = _step(before, gates[:2, t], gates[2, t], self.U, u, states[t])
            y = target[:, at : at + window].T.reshape(-1)
            live = y >= 0
            y, s = y[live].astype(np.int64), states.reshape(-1, HIDDEN)[live]
            if len(y):
                value = self._output(s, y)
                out += np.bincount(number[:, at : at + window].T.reshape(-1)[live], value, len(texts))
        return out / np.log(10)

    def _output(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = self.w
        kind, member = _classes(y)
        value = np.empty(len(y), s.dtype)
        for at in range(0, len(y), PART):
            x = s[at : at + PART] @ w["C"]
            x += w["c"]
            _shifted(x, self.within[0])
            value[at : at + PART] = x[np.arange(len(x)), kind[at : at + PART]]
            value[at : at + PART] -= np.log(_exponentials(x))
        order = np.argsort(kind, kind="stable")
        edge = np.searchsorted(kind[order], np.arange(VOCAB // MEMBERS + 1))
        for k in range(VOCAB // MEMBERS):
            own = order[edge[k] : edge[k + 1]]
            if len(own):
                q = s[own] @ w["M"][k]
                q += w["m"][k]
                _shifted(q, self.within[1][k])
                value[own] += q[np.arange(len(own)), member[own]] - np.log(_exponentials(q))
        return value.astype(np.float64)


#: Tokens of which the output is computed at once, and of which its classes are.
CHUNK, PART = 1 << 14, 1 << 11


class Space(dict):
    """Arrays of one window that the next one uses again: fresh memory for each would cost more than the sums."""

    def at(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size = int(np.prod(shape))
        held = self.get(name)
        if held is None or len(held) < size or held.dtype != dtype:
            held = self[name] = np.zeros(size, dtype)
        return held[:size].reshape(shape)


def gradient(w: dict, h: np.ndarray, x: np.ndarray, y: np.ndarray, reset: np.ndarray, space: Space | None = None) -> tuple[dict, np.ndarray, float, int]:
    """Gradient of the summed log loss over one window (time, lane), the state after it, the loss and the token count.

    Truncated: nothing flows back past the window's beginning.
    """
    space = Space() if space is None else space
    steps, count = x.shape
    kind, begins = w["U"].dtype, _begins(reset)
    before, states, to_n, tmp = (space.at(k, (steps, count, HIDDEN), kind) for k in ("before", "states", "to_n", "tmp"))
    gates, d_us = (space.at(k, (3, steps, count, HIDDEN), kind) for k in ("gates", "d_us"))
    u = space.at("u", (3, count, HIDDEN), kind)
    table, U = _parts(w)
    np.take(table, x, axis=1, out=gates, mode="clip")
    to_z, to_r = d_us[0], d_us[1]
    for t in range(steps):
        before[t] = h
        before[t, begins[t]] = 0
        h = _step(before[t], gates[:2, t], gates[2, t], U, u, states[t])
        np.add(u[2], u[2], out=to_r[t])
    z, r, ns = gates
    g = {k: np.zeros_like(v) for k, v in w.items()}
    d_states = space.at("d_states", (steps * count, HIDDEN), kind)
    flat_y, flat_s, loss, tokens = y.reshape(-1), states.reshape(-1, HIDDEN), 0.0, 0
    for at in range(0, len(flat_y), CHUNK):
        one, n = _output_gradient(w, flat_s[at : at + CHUNK], flat_y[at : at + CHUNK], d_states[at : at + CHUNK], g, space)
        loss, tokens = loss + one, tokens + n
    d_states = d_states.reshape(steps, count, HIDDEN)
    # what does not depend on the flow back is computed for all steps at once, in place
    np.subtract(before, ns, out=to_z)
    to_z *= z
    np.subtract(1, z, out=tmp)
    to_z *= tmp
    np.multiply(ns, ns, out=to_n)
    np.subtract(1, to_n, out=to_n)
    to_n *= tmp
    to_r *= r
    np.subtract(1, r, out=tmp)
    to_r *= tmp
    dh, back = space.at("dh", (count, HIDDEN), kind), space.at("back", (3, count, HIDDEN), kind)
    dh[:], U_t = 0, np.ascontiguousarray(w["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
    for t in range(steps - 1, -1, -1):
        dh += d_states[t]
        dn = to_n[t]
        dn *= dh
        to_z[t] *= dh
        to_r[t] *= dn
        np.multiply(dn, r[t], out=d_us[2, t])
        np.matmul(d_us[:, t], U_t, out=back)
        dh *= z[t]
        for part in back:
            dh += part
        dh[begins[t]] = 0
    flat = before.reshape(-1, HIDDEN).T
    g["U"] = np.concatenate([flat @ d.reshape(-1, HIDDEN) for d in d_us], axis=1)
    gates[:2], gates[2] = d_us[:2], to_n
    by_symbol = _summed(gates.reshape(3, -1, HIDDEN), x.reshape(-1), SYMBOLS, space)
    g["W"], g["b"], g["E"] = w["E"].T @ by_symbol, by_symbol.sum(0), by_symbol @ w["W"].T
    return g, states[-1].copy(), loss, tokens


def _output_gradient(w: dict, s: np.ndarray, y: np.ndarray, ds: np.ndarray, g: dict, space: Space) -> tuple[float, int]:
    """Adds the output's part to ``g`` and writes what flows back to the states into ``ds``; the loss and the token count."""
    live = np.flatnonzero(y >= 0)
    kind, member = _classes(y)
    fine, loss = _within(w["C"], w["c"]), 0.0
    C_t, all_d = np.ascontiguousarray(w["C"].T), space.at("d", (PART, CLASSES), s.dtype)
    for at in range(0, len(y), PART):
        part, t = s[at : at + PART], y[at : at + PART] >= 0
        d, row = all_d[: len(part)], np.arange(len(part))
        np.matmul(part, w["C"], out=d)
        d += w["c"]
        _shifted(d, fine)
        own = kind[at : at + PART]
        loss -= float(d[row, own][t].sum(dtype=np.float64))
        total = _exponentials(d)
        loss += float(np.log(total[t]).sum(dtype=np.float64))
        d *= (1 / total)[:, None]
        d[row, own] -= 1
        if not t.all():
            d[~t] = 0
        g["C"] += part.T @ d
        g["c"] += np.ones(len(part), d.dtype) @ d
        np.matmul(d, C_t, out=ds[at : at + PART])
    order = live[np.argsort(kind[live], kind="stable")]
    edge = np.searchsorted(kind[order], np.arange(VOCAB // MEMBERS + 1))
    words = order[: edge[-1]]  # tail classes come last and have no members
    s, member = s[words], member[words]
    back, fines = space.at("words", s.shape, s.dtype), _within(w["M"], w["m"])
    for k in range(VOCAB // MEMBERS):
        a, b = edge[k], edge[k + 1]
        if a < b:
            q = s[a:b] @ w["M"][k]
            q += w["m"][k]
            _shifted(q, fines[k])
            place = np.arange(b - a), member[a:b]
            loss -= float(q[place].sum(dtype=np.float64))
            total = _exponentials(q)
            loss += float(np.log(total).sum(dtype=np.float64))
            q *= (1 / total)[:, None]
            q[place] -= 1
            g["M"][k] += s[a:b].T @ q
            g["m"][k] += np.ones(b - a, q.dtype) @ q
            np.matmul(q, w["M"][k].T, out=back[a:b])
    ds[words] += back
    return loss, len(live)


def _summed(parts: np.ndarray, key: np.ndarray, n: int, space: Space) -> np.ndarray:
    """Sums of the rows of each key; the parts (part, row, column) lie side by side in the result."""
    order = np.argsort(key, kind="stable")
    keys = key[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sorted_rows = np.take(parts, order, axis=1, out=space.at("sorted", parts.shape, parts.dtype), mode="clip")
    out = np.zeros((n, len(parts), parts.shape[2]), parts.dtype)
    out[keys[first]] = np.add.reduceat(sorted_rows, first, axis=1).transpose(1, 0, 2)
    return out.reshape(n, -1)


#: Tokens of a run in training: longer texts are cut, so that many lanes have work; a run's first state is zero.
RUN = 2048


def train(weights: dict, texts: list[np.ndarray], most: int = 256, window: int = 32, least_steps: int = 100, rate: float = 0.01) -> tuple[dict, float, int]:
    """Adam over the texts, once or until ``least_steps`` windows are done; the weights, the mean loss of the last pass and its tokens."""
    w = {k: v.copy() for k, v in weights.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    texts = [t[a : a + RUN] for t in texts for a in range(0, len(t), RUN)]
    target, reset, _ = lanes(texts, most)
    given = _inputs(target, reset)
    step, space = 0, Space()
    while True:
        h = np.zeros((len(target), HIDDEN), np.float32)
        total, tokens = 0.0, 0
        for at in range(0, target.shape[1], window):
            x, y, r = (np.ascontiguousarray(a[:, at : at + window].T) for a in (given, target, reset))
            g, h, loss, n = gradient(w, h, x, y, r, space)
            if not n:
                continue
            total, tokens, step = total + loss, tokens + n, step + 1
            norm = np.sqrt(sum(float((v / n * v / n).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9)) / n
            for k in w:
                v = g[k] * np.float32(scale)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                w[k] -= np.float32(rate) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
        if step >= least_steps or not tokens:
            return w, total / max(tokens, 1), tokens
