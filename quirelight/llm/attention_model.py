"""A small causal self-attention model in numpy.

The input of a place is the id before it (``n`` at a text's start).  A text is
cut into blocks of ``STRIDE`` from its first place on; a block's places attend
to those at or before them in a window of the block and the ``REACH`` places
before it, so windows overlap by ``REACH`` and each place is scored once.  What
a text gets hangs on no other text, but for the rounding of single precision
(products of other shapes sum in another order; about 1e-6 of a score).
An id has a query, a key, a value and a state of its own; scores get a learned
bias by distance, and a hidden layer adds what a place attended to to its state.

The logits of an id are those of its class and those inside the class, so a
place costs about twice the root of the number of ids.  Both begin with the
smoothed logarithms of how often the id follows the one before (``bigrams``),
which stay as counted; what the hidden layer adds is learned.

Weights of logits are not exp(x) but a piecewise linear function through its
values at multiples of ln 2, whose bits are x times a constant; shares of such
weights are as exact a distribution, and take a fifth of the time.
"""

from __future__ import annotations

import numpy as np

STRIDE, REACH, KEY, VALUE, HIDDEN = 16, 16, 8, 16, 16
SLAB = 256  # blocks that are computed at once
SMOOTH = 20.0
RATE = 0.01
_FLOAT = np.float32
_SCALE, _ONE = 2.0**23 / np.log(2), 127.0 * 2**23  # a float's bits are _ONE + _SCALE * its logarithm, nearly
_LEAST, _MOST = 1 << 23, 0x6F000000
_NEVER = _FLOAT(-1e9)
_Q, _K, _V, _S = slice(0, KEY), slice(KEY, 2 * KEY), slice(2 * KEY, 2 * KEY + VALUE), slice(2 * KEY + VALUE, 2 * KEY + VALUE + HIDDEN)


def layout(n: int) -> tuple[int, int]:
    """(classes, ids a class) of ``n`` ids; id i is number i % k of class i // k."""
    k = max(1, int(np.ceil(np.sqrt(n))))
    return -(-n // k), k


def shapes(n: int) -> dict[str, tuple[int, ...]]:
    classes, k = layout(n)
    return {"of": (n + 1, 2 * KEY + VALUE + HIDDEN), "near": (REACH + STRIDE,), "in": (VALUE, HIDDEN), "shift": (HIDDEN,), "out": (HIDDEN, classes), "inner": (classes, HIDDEN, k)}


def initial(n: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(n).items():
        out[name] = (rng.standard_normal(shape) * 0.3).astype(_FLOAT) if name in ("of", "in") else np.zeros(shape, _FLOAT)
    return out


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in sorted(shapes(n).items()):
        size = int(np.prod(shape))
        out[name] = x[at : at + size].reshape(shape)
        at += size
    return out


def bigrams(n: int, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of classes after each id, and of ids after each id and in each class, as bits of weights."""
    classes, k = layout(n)
    single = np.bincount(after, weights=counts, minlength=n) + 0.1
    share = single / single.sum()
    outer, inner = np.empty((n + 1, classes), _FLOAT), np.full((n + 1, classes * k), _NEVER, _FLOAT)
    order = np.argsort(before, kind="stable")
    cuts = np.searchsorted(before[order], np.arange(n + 2))
    starts = np.arange(0, n, k)
    for b in range(n + 1):
        s = order[cuts[b] : cuts[b + 1]]
        row = share * SMOOTH
        row[after[s]] += counts[s]
        row /= row.sum()
        both = np.add.reduceat(row, starts)
        outer[b] = np.log(both) * _SCALE + _ONE
        inner[b, :n] = np.log(row / np.repeat(both, k)[:n]) * _SCALE + _ONE
    return outer, inner.reshape((n + 1) * classes, k)


def _weights(bits: np.ndarray, least: int = _LEAST) -> np.ndarray:
    """Weights of the bits, which are clipped in place."""
    np.clip(bits, bits.dtype.type(least), bits.dtype.type(_MOST), out=bits)
    return bits.astype(np.int32).view(_FLOAT)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[-1], x.dtype)


def _turned(x: np.ndarray) -> np.ndarray:
    """Transposed matrices, laid out so: products with them as the right side are quicker than with a view."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` of two tall arrays, by pieces of 128 rows, which is quicker."""
    m = len(x) // 128 * 128
    out = x[m:].T @ y[m:]
    if m:
        out += (x[:m].reshape(-1, 128, x.shape[1]).transpose(0, 2, 1) @ y[:m].reshape(-1, 128, y.shape[1])).sum(axis=0)
    return out


def begins(text: np.ndarray) -> np.ndarray:
    """Where the blocks of a stream of texts begin; ``text`` numbers the text of each place."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    size = -(-np.diff(np.concatenate([first, [len(text)]])) // STRIDE)
    return np.repeat(first, size) + STRIDE * (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))


def _slabs(before: np.ndarray, text: np.ndarray, chosen: np.ndarray):
    """(places of blocks, their rows in these, windows of ids before, windows of texts) of SLAB of the blocks at a time.

    ``chosen`` are the blocks' first places; what lies behind a text's end in
    its last block is computed with the block and then left out.
    """
    window = np.arange(-REACH, STRIDE)
    for s in range(0, len(chosen), SLAB):
        at = chosen[s : s + SLAB, None] + window
        b, t = before.take(at, mode="clip"), text.take(at, mode="clip")
        t[at < 0], t[at >= len(text)] = -1, -2
        rows = np.flatnonzero((t[:, REACH:] == t[:, REACH, None]).ravel())
        yield at[:, REACH:].ravel()[rows], rows, b, t


_GAP = np.arange(STRIDE) + REACH - np.arange(REACH + STRIDE)[:, None]  # of a window's places, rows, before a block's, columns


def _attend(p: dict, b: np.ndarray, t: np.ndarray) -> tuple:
    """Hidden state of the places of a slab, and what its gradient needs.

    That is the windows' keys and values, a column of ones behind these; the
    blocks' queries, times ``_SCALE`` and the root; weights, which no sum
    divides, with a row a place of the window; one over their sums; and what a
    place attended to.
    """
    of, blocks = p["of"], len(b)
    seen = np.ones((len(of), KEY + VALUE + 1), of.dtype)
    seen[:, :-1] = of[:, KEY : 2 * KEY + VALUE]
    own = np.concatenate([of[:, _Q] * _FLOAT(_SCALE * KEY**-0.5), of[:, _S] + p["shift"]], axis=1)
    kv, x = seen.take(b, axis=0), own.take(b[:, REACH:], axis=0)
    k, v, q = kv[:, :, :KEY], kv[:, :, KEY:], x[:, :, :KEY]
    a = k @ _turned(q)
    a += np.where(_GAP >= 0, p["near"][np.maximum(_GAP, 0)] * _FLOAT(_SCALE) + _FLOAT(_ONE), 2 * _NEVER)
    a = _weights(a, 0)
    # places of other texts, in windows that hold any
    mixed = np.flatnonzero(t[:, 0] != t[:, -1])
    if len(mixed):
        a[mixed] *= t[mixed, :, None] == t[mixed, None, REACH:]
    c = a.transpose(0, 2, 1) @ v
    whole = 1 / c[:, :, VALUE:]
    c = (c[:, :, :VALUE] * whole).reshape(-1, VALUE)
    z = (c.reshape(blocks, -1, VALUE) @ p["in"]).reshape(-1, HIDDEN)
    z += x.reshape(-1, KEY + HIDDEN)[:, KEY:]
    np.maximum(z, np.zeros_like(z), out=z)
    return k, v, q, a, whole, c, z


def _groups(kind: np.ndarray, classes: int) -> tuple:
    """(order by class, class and range of each that occurs)."""
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(classes + 1)).tolist()
    return order, [(c, slice(cuts[c], cuts[c + 1])) for c in range(classes) if cuts[c + 1] > cuts[c]]


def _shares(p: dict, fixed: tuple, z: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple:
    """Weights of classes and, by class, of ids in it, with the places' order and their groups and targets."""
    outer, inner = fixed
    classes, k = layout(len(p["of"]) - 1)
    kind = target // k
    above = z @ (p["out"] * _FLOAT(_SCALE))
    above += outer.take(b, axis=0)
    above = _weights(above)
    order, groups = _groups(kind, classes)
    zs, weights = z.take(order, axis=0), p["inner"] * _FLOAT(_SCALE)
    within = np.empty((len(z), k), z.dtype)
    for c, s in groups:
        np.matmul(zs[s], weights[c], out=within[s])
    within += inner.take((b * classes + kind).take(order), axis=0)
    return above, _weights(within), order, groups, zs, kind, (target - kind * k).take(order)


def log_probabilities(p: dict, fixed: tuple, before: np.ndarray, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Natural log probability of every place; ``text`` numbers the text of each."""
    out = np.empty(len(ids))
    for place, rows, b, t in _slabs(before, text, begins(text)):
        z = _attend(p, b, t)[-1].take(rows, axis=0)
        above, within, order, _, _, kind, at = _shares(p, fixed, z, before[place], ids[place])
        row = np.arange(len(place))
        share = above[row, kind].astype(float) / _sums(above)
        share[order] *= within[row, at] / _sums(within)
        out[place] = np.log(share)
    return out


def _scatter(index: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Sums of rows with the same index, into ``out``."""
    order = np.argsort(index.astype(np.uint16) if len(out) < 1 << 16 else index, kind="stable")
    index = index.take(order)
    start = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out[index[start]] = np.add.reduceat(rows.take(order, axis=0), start)


def _less_own(w: np.ndarray, sums: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log shares of each row's own column; the row's sum is taken from it in place, so rows over sums are the loss's gradient."""
    at, w = np.arange(len(w)) * w.shape[1] + own, w.reshape(-1)
    mine = w[at]
    w[at] = mine - sums
    return np.log(mine / sums)


def gradient(p: dict, fixed: tuple, rows: np.ndarray, b: np.ndarray, t: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean loss of a slab's places and its gradient.

    What divides a row of weights, its sum, is put to the narrower arrays that
    these are multiplied with, so no pass over the weights does it.
    """
    size, blocks = len(rows), len(b)
    k, v, q, a, whole, c, z = _attend(p, b, t)
    every = size == len(z)
    zs = z if every else z.take(rows, axis=0)
    above, within, order, groups, zo, kind, at = _shares(p, fixed, zs, b[:, REACH:].ravel().take(rows), target)
    scale = _FLOAT(1 / max(1, size))
    g = {"inner": np.zeros_like(p["inner"])}
    total, inside = _sums(above), _sums(within)
    loss = -float(_less_own(above, total, kind).sum() + _less_own(within, inside, at).sum()) * float(scale)
    total, inside = (scale / total)[:, None], (scale / inside)[:, None]
    g["out"] = _cross(zs * total, above)
    zo *= inside
    below, ds = np.ascontiguousarray(p["inner"].transpose(0, 2, 1)), np.empty_like(zo)
    for m, s in groups:
        np.matmul(zo[s].T, within[s], out=g["inner"][m])
        np.matmul(within[s], below[m], out=ds[s])
    ds *= inside
    back = np.empty(size, np.intp)
    back[order] = np.arange(size)
    dz = above @ p["out"].T
    dz *= total
    dz += ds.take(back, axis=0)
    if not every:
        some, dz = dz, np.zeros_like(z)
        dz[rows] = some
    dz *= (z > 0).astype(z.dtype)
    g["in"], g["shift"] = _cross(c, dz), np.ones(len(dz), dz.dtype) @ dz
    # shares' gradient: a place's product with the values, less its mean, which stands against the values' ones
    dc = np.empty((blocks, STRIDE, VALUE + 1), z.dtype)
    np.multiply((dz @ p["in"].T).reshape(blocks, STRIDE, VALUE), whole, out=dc[:, :, :VALUE])
    dc[:, :, VALUE] = -np.einsum("ijk,ijk->ij", dc[:, :, :VALUE], c.reshape(blocks, STRIDE, VALUE))
    da = v @ _turned(dc)
    da *= a
    by = np.ones(blocks, z.dtype) @ da.reshape(blocks, -1)
    g["near"] = np.bincount(_GAP[_GAP >= 0], weights=by.reshape(_GAP.shape)[_GAP >= 0], minlength=REACH + STRIDE).astype(z.dtype)
    seen, asked = np.empty((blocks, REACH + STRIDE, KEY + VALUE), z.dtype), np.empty((blocks, STRIDE, KEY + HIDDEN), z.dtype)
    np.matmul(da, q, out=seen[:, :, :KEY])
    np.matmul(a, dc[:, :, :VALUE], out=seen[:, :, KEY:])
    np.matmul(da.transpose(0, 2, 1), k, out=asked[:, :, :KEY])
    asked[:, :, KEY:] = dz.reshape(blocks, STRIDE, HIDDEN)
    # what a window adds to the places before its block goes to the block they are of, the one before, or has rows of its own
    again = np.concatenate([[False], (b[1:, :REACH] == b[:-1, -REACH:]).all(axis=1)])
    first = np.flatnonzero(~again & (t[:, REACH - 1] == t[:, REACH]))
    early = seen[first, :REACH]
    seen[~again, :REACH] = 0
    seen[:-1, -REACH:] += seen[1:, :REACH]
    own = b[:, REACH:].ravel()
    g["of"] = np.zeros_like(p["of"])
    _scatter(np.concatenate([own, b[first, :REACH].ravel()]), np.concatenate([seen[:, REACH:], early]).reshape(-1, KEY + VALUE), g["of"][:, KEY : 2 * KEY + VALUE])
    asked = asked.reshape(-1, KEY + HIDDEN)
    both = np.zeros((len(p["of"]), KEY + HIDDEN), z.dtype)
    _scatter(own, asked, both)
    g["of"][:, _Q], g["of"][:, _S] = both[:, :KEY] * _FLOAT(KEY**-0.5), both[:, KEY:]
    g["of"][:, _K] *= _FLOAT(1 / _SCALE)
    return loss, g


class Adam:
    """Adam over one flat vector of weights, whose parts are ``p``."""

    def __init__(self, weights: np.ndarray, n: int, rate: float = RATE) -> None:
        self.whole, self.rate, self.step = weights.astype(_FLOAT), rate, 0
        self.first, self.second = np.zeros_like(self.whole), np.zeros_like(self.whole)
        self.p = unflat(self.whole, n)

    def take(self, g: dict) -> None:
        x = flat(g)
        self.step += 1
        self.first *= _FLOAT(0.9)
        self.first += _FLOAT(0.1) * x
        x *= x
        x *= _FLOAT(0.01)
        self.second *= _FLOAT(0.99)
        self.second += x
        np.sqrt(self.second, out=x)
        x *= _FLOAT(1 / np.sqrt(1 - 0.99**self.step))
        x += _FLOAT(1e-6)
        np.divide(self.first, x, out=x)
        x *= _FLOAT(self.rate / (1 - 0.9**self.step))
        self.whole -= x


def train(state: Adam, fixed: tuple, before: np.ndarray, ids: np.ndarray, text: np.ndarray, every: int = 1, first: int = 0) -> float:
    """One pass over the blocks ``first``, ``first + every``, ... of the stream; the mean loss on the way."""
    loss = places = 0.0
    for place, rows, b, t in _slabs(before, text, begins(text)[first % every :: every]):
        got, g = gradient(state.p, fixed, rows, b, t, ids[place])
        state.take(g)
        loss += got * len(place)
        places += len(place)
    return loss / max(1, places)
