"""Dense algebra and recurrences in NumPy, used inside tasks; no Spark here."""

from __future__ import annotations

import math

import numpy as np


def window_features(values: np.ndarray, lookback: int, cadence: int, first: int = 0, bins: int = 8) -> np.ndarray:
    """Rows of features, in the order of ``feature_rows``, for the steps with a whole window: from step ``first + lookback - 1`` of values that start at step ``first``."""
    n = len(values) - lookback + 1
    out = np.empty((n, 6 + lookback + bins + 2))
    windows, moves = out[:, 6 : 6 + lookback], np.diff(values)
    windows[:] = np.lib.stride_tricks.sliding_window_view(values, lookback)
    transform = np.fft.rfft if bins <= lookback // 2 else np.fft.fft
    turn = 2 * math.pi / cadence * np.mod(first + lookback - 1 + np.arange(n), cadence)
    steps = np.lib.stride_tricks.sliding_window_view(np.abs(moves), lookback - 1)
    for i in range(0, n, 128):  # what a few rows need beside them stays in the cache
        at = slice(i, i + 128)
        power = np.abs(transform(windows[at])[:, 1 : bins + 1])
        out[at, -2 - bins : -2] = power / (power.sum(1)[:, None] + 1e-9)
        out[at, 0], out[at, 1], out[at, 4] = windows[at].mean(1), windows[at].std(1), steps[at].mean(1)
    out[:, 2], out[:, 3], out[:, 5] = extremes(values, lookback, np.minimum), extremes(values, lookback, np.maximum), moves[lookback - 2 :]
    out[:, -2], out[:, -1] = np.sin(turn), np.cos(turn)
    return out


def extremes(values: np.ndarray, lookback: int, of) -> np.ndarray:
    """``of`` (a minimum or maximum) over every window, from those over windows half as long."""
    width = 1
    while 2 * width <= lookback:
        values, width = of(values[:-width], values[width:]), 2 * width
    rest = lookback - width
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def recurred(x: np.ndarray, lam: np.ndarray, start: np.ndarray | None = None, block: int = 32) -> np.ndarray:
    """h_t = lambda h_{t-1} + x_t over the rows of x (steps x modes), from h = ``start`` (0 if none).

    Blocks of rows are multiplied by the triangle of powers of lambda all at once; the blocks' last states are the same recurrence
    with lambda^block, a ``block``-th as long, and what each block gets from the one before is added to its rows.
    """
    n, m = x.shape
    first = np.zeros(m, dtype=complex) if start is None else start
    k = min(block, n)
    if not n:
        return np.empty((0, m), dtype=complex)
    powers = lam ** np.arange(k + 1)[:, None]
    back = np.subtract.outer(np.arange(k), np.arange(k))
    triangle = np.where((back >= 0)[:, :, None], powers[np.maximum(back, 0)], 0)
    padded = np.zeros((-(-n // k) * k, m), dtype=complex)
    padded[:n] = x
    own = np.einsum("ijm,bjm->bim", triangle, padded.reshape(-1, k, m))
    before = np.empty((len(own), m), dtype=complex)
    before[0] = first
    if len(own) > 1:
        before[1:] = recurred(own[:-1, -1], powers[k], first, block)
    return (own + powers[1:] * before[:, None, :]).reshape(-1, m)[:n]


def relative_ridge(a: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Solve (A + lam trace(A)/F I) w = b; also the inverse, from one factorisation."""
    f = len(a)
    both = np.linalg.solve(a + lam * np.trace(a) / f * np.eye(f), np.column_stack((b, np.eye(f))))
    inv = both[:, -f:]
    return both[:, :-f].reshape(b.shape), (inv + inv.T) / 2


def rls_step(inv: np.ndarray, w: np.ndarray, phi: np.ndarray, y: np.ndarray, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """One observation of weight gamma on the inverse; ``w`` may have several readouts (F, m), ``y`` then m values."""
    v = inv @ phi
    gain = v / (1 + gamma * (phi @ v))
    w = w + np.multiply.outer(gain, y - phi @ w) if w.ndim == 2 else w + gain * (y - phi @ w)
    inv = inv - gamma * np.outer(v, v) / (1 + gamma * (phi @ v))
    return (inv + inv.T) / 2, w


WIDE, TOGETHER = 32, 48


def _wide_pass(values: np.ndarray, phi: np.ndarray, r: int, w: np.ndarray, inv: np.ndarray, first: int, last: int):
    """``online_pass`` of one readout, ``TOGETHER`` steps at a time.

    With P the block's past features, e the residuals of w and I + P inv P' = L L', the weights after the block's first k updates are w + (P inv)' L'^-1 L^-1 e
    taken over k rows, and what L^-1 makes of the first k rows depends on them alone: so every step's forecast comes from the same few products.
    """
    w, inv, out = w.copy(), inv.copy(), np.empty(max(0, last - first))
    start = min(max(first, r), max(first, last))
    out[: start - first] = phi[first:start] @ w
    lower = np.tril(np.ones((TOGETHER, TOGETHER)))
    for a in range(start, last, TOGETHER):
        b = min(a + TOGETHER, last)
        n, past, now = b - a, phi[a - r : b - r], phi[a:b]
        moved = past @ inv
        k = moved @ past.T
        k.flat[:: n + 1] += 1
        root = np.linalg.cholesky(k)
        back = np.linalg.inv(root)
        e, y = back @ (values[a:b] - past @ w), back @ moved
        # A step's own row of L, if it is among the block's past rows, is y times its features already.
        own = max(0, n - r)
        made = now @ w
        made[:own] += (root[r:, :own] * lower[:own, :own]) @ e[:own] if own else 0.0
        made[own:] += ((now[own:] @ y.T) * lower[own:n, :n]) @ e
        out[a - first : b - first] = made
        w += y.T @ e
        inv -= y.T @ y
    return out, w, inv


def online_pass(values: np.ndarray, phi: np.ndarray, ahead: np.ndarray, w: np.ndarray, inv: np.ndarray, first: int, last: int):
    """Steps first..last - 1 of one series: every readout r of ``ahead`` is updated with (phi[t - r], values[t]), then forecasts from phi[t].

    w is (readouts, F), inv (readouts, F, F). Narrow readouts move all at once, wide ones (whose inverse is the work) one after
    the other, in blocks of steps. Returns the forecasts (steps, readouts) and the last w and inv.
    """
    w, inv, out = w.copy(), inv.copy(), np.empty((max(0, last - first), len(ahead)))
    if w.shape[1] >= WIDE:
        for k, r in enumerate(ahead):
            out[:, k], w[k], inv[k] = _wide_pass(values, phi, int(r), w[k], inv[k], first, last)
        return out, w, inv
    for t in range(first, last):
        then = t - ahead
        past = phi[np.maximum(then, 0)]
        v = np.matmul(inv, past[:, :, None])[:, :, 0]
        scale = np.where(then >= 0, 1 / (1 + (past * v).sum(1)), 0.0)
        w += v * (scale * (values[t] - (past * w).sum(1)))[:, None]
        inv -= v[:, :, None] * (v * scale[:, None])[:, None, :]
        if t % 64 == 0:
            inv = (inv + inv.swapaxes(1, 2)) / 2
        out[t - first] = w @ phi[t]
    return out, w, (inv + inv.swapaxes(1, 2)) / 2


FEW, SHARED = 6, 24  # steps ahead from which on, and up to which, one pass of all pays
SEGMENT, GROUP, FRESH = 64, 8, 8  # its steps and steps ahead at a time, and the segments from one inverse made anew to the next


def near_ridges(ridge: np.ndarray, within: float = 1e-9, most: int = 9) -> tuple[float, np.ndarray | None]:
    """A ridge ``mid`` amid the others and c (terms, ridges): (A + ridge I)^-1 is the sum of c_k Q^(k + 1) with Q = mid (A + mid I)^-1, whatever A >= 0 is.

    The sum interpolates 1 / (1 + (ridge / mid - 1) q) at Chebyshev nodes; its relative error is at most ``within`` in every direction. None if the ridges are so
    far apart that this takes more than ``most`` terms.
    """
    mid = np.sqrt(ridge.min() * ridge.max())
    apart = np.sqrt(ridge.max() / mid)
    rate = (apart - 1) / (apart + 1)
    if not 2 * rate**most <= within:
        return mid, None
    terms = next(k for k in range(1, most + 1) if 2 * rate**k <= within)
    q = (1 + np.cos(np.pi * (np.arange(terms) + 0.5) / terms)) / 2
    return mid, np.linalg.solve(np.vander(q, increasing=True), 1 / (1 + np.multiply.outer(q, ridge / mid - 1))) / mid


def slid(x: np.ndarray, down: int, across: int, shape: tuple[int, int]) -> np.ndarray:
    """A view of the matrices x: the block of the k-th starts k * ``down`` rows and k * ``across`` columns further on than that of the first, which starts at its corner."""
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), *shape), (s[0] + down * s[1] + across * s[2], s[1], s[2]))


def shared_pass(values: np.ndarray, phi: np.ndarray, readouts: int, most: int, lam: float, first: int, last: int) -> np.ndarray:
    """The forecasts (steps, readouts) of ``online_pass`` for the steps ahead 1..readouts together, fits on the train rows included: phi[i] meets values[i + r], and
    the r-th fit has the first ``most`` + 1 - r rows and a relative ridge of ``lam``. ``first`` is ``most`` + 1 and ``readouts`` at least.

    Rows are met in segments. Those that all readouts have met before one make one sum phi phi'. With R a segment's rows after those that only some readouts have met
    (at the train end, before the first step), and P_r the sum's inverse under the r-th ridge, K_r = I + R P_r R' = L L' says it all: a step's forecast moves by its
    row of L times L^-1 of the residuals, over the rows whose targets it has seen. The residuals, put below K_r as its last row, come out of the same factorisation
    as L^-1 of them. The ridges are near each other, so the K_r are sums of a few products that all readouts share (``near_ridges``); if not, each is a product of its own.
    """
    f, extra, least, begin = phi.shape[1], readouts - 1, most + 1 - readouts, first - readouts
    if last <= first:
        return np.empty((0, readouts))
    squares = np.concatenate([[0.0], np.cumsum((phi[:most] ** 2).sum(1))])
    ridge = lam * squares[most + 1 - np.arange(1, readouts + 1)] / f
    mid, terms = near_ridges(ridge)
    size = max(SEGMENT, readouts)
    own, wide = 2 * extra, size + readouts  # where a segment's rows start, and how many they are with those of the last steps ahead
    padded = np.concatenate([values[:last], np.zeros(size + 2 * readouts)])
    after = np.lib.stride_tricks.sliding_window_view(padded[1:], readouts)  # row i: what the steps ahead of phi[i] turn out to be
    a, b, met = np.zeros((f, f)), np.zeros((f, readouts)), slice(0, least)
    rows, target = np.zeros((own + wide, f)), np.zeros((own + wide, readouts))
    rows[extra:own], target[extra:own] = phi[least:most], after[least:most]
    room = np.empty(GROUP * (extra + wide + 1) ** 2)  # large arrays are made once
    if terms is not None:
        inner, outer, sums = np.empty((len(terms), own + wide, wide)), np.empty((len(terms), own, own)), np.empty((GROUP, (own + wide) * wide))
    lower = np.tril(np.ones((size, size)))
    made = np.empty((readouts, -(-(last - 1 - begin) // size) * size))  # column i: the forecast that the row ``first - readouts + i`` was the last to be met before
    for done in range(0, made.shape[1], size):
        a, b = a + phi[met].T @ phi[met], b + phi[met].T @ after[met]
        met = slice(begin if done else first - 1, begin + size)
        if done == size:  # until then they are the segment's own
            rows[:extra], target[:extra] = phi[first - readouts : first - 1], after[first - readouts : first - 1]
        here = phi[begin : min(begin + wide, last)]
        rows[own : own + len(here)], rows[own + len(here) :], target[own : own + size] = here, 0.0, after[begin : begin + size]
        if terms is None:
            scale, turn = np.linalg.eigh(a)
            c = 1 / np.sqrt(scale + ridge[:, None])
            z, w = (rows @ turn) * c[:, None, :], turn @ ((turn.T @ b) * (c**2).T)
            inner, outer = z @ z[:, own:].swapaxes(1, 2), z[:, :own] @ z[:, :own].swapaxes(1, 2)
        else:
            if done // size % FRESH < 2:  # the second segment's sum has rows before it that the first did not meet as its own
                q = mid * np.linalg.inv(a + mid * np.eye(f))
            else:
                last_met = powers[1][own : own + size]
                q = q - last_met.T @ np.linalg.solve(inner[0, own : own + size, :size] + mid * np.eye(size), last_met)
            powers, w, x = [rows], 0.0, b
            for c in terms:
                x = q @ x
                w = w + c * x
            for _ in range((len(terms) + 1) // 2):
                powers.append(powers[-1] @ q)
            for k in range(len(terms)):  # the (k + 1)-th powers
                i, j = powers[k // 2 + 1], powers[(k + 1) // 2]
                np.matmul(i, j[own:].T, out=inner[k])
                np.matmul(i[:own], j[:own].T, out=outer[k])
        base = np.ascontiguousarray((rows @ w).T)
        rest = target.T - base
        above = 1 + (rest**2).sum(1).max()
        for lo in range(0, readouts, GROUP):
            hi, few = min(lo + GROUP, readouts), readouts - 1 - lo
            h, n = hi - lo, extra + size + hi
            if terms is None:
                now, known = inner[lo:hi], outer[lo:hi]
            else:
                now = np.matmul(terms[:, lo:hi].T, inner.reshape(len(terms), -1), out=sums[:h]).reshape(h, -1, wide)
                known = (terms[:, lo:hi].T @ outer.reshape(len(terms), -1)).reshape(h, own, own)
            # Of the rows that only some have met, the r-th readout takes ``extra`` from its own place on; the upper triangle is filled, and handed over as the lower.
            k = room[: h * (n + 1) ** 2].reshape(h, n + 1, n + 1)
            k[:, :extra, :extra], k[:, :extra, extra:n] = slid(known[:, few:, few:], -1, -1, (extra, extra)), slid(now[:, few:], -1, 0, (extra, n - extra))
            k[:, extra:n, extra:n] = now[:, own : own + n - extra, : n - extra]
            k[:, :extra, n], k[:, extra : extra + size, n] = slid(rest[lo:hi, None, few:], 0, -1, (1, extra))[:, 0], rest[lo:hi, own : own + size]
            k[:, extra + size : n, n] = 0.0
            for r in range(lo + 1, hi + 1) if not done else ():  # rows before the first that the readout meets
                gone = slice(extra, extra + readouts - r)
                k[r - 1 - lo, gone, :], k[r - 1 - lo, :, gone] = 0.0, 0.0
            k.reshape(h, -1)[:, :: n + 2] += 1
            k[:, n, n] = above
            root = np.linalg.cholesky(k.swapaxes(1, 2))
            e, steps = root[:, n, : extra + size, None].copy(), slid(root[:, extra + 1 + lo :], 1, 0, (size, extra + size))
            steps[:, :, extra:] *= lower  # each step sees one more row
            made[lo:hi, done : done + size] = (slid(base[lo:hi, None, own + 1 + lo :], 0, 1, (1, size))[:, 0] + (steps @ e)[:, :, 0])
        begin += size
    return np.stack([made[r - 1, readouts - r : readouts - r + last - first] for r in range(1, readouts + 1)], axis=1)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """Gram-Schmidt, twice over each column."""
    q = np.array(a, dtype=float)
    for j in range(q.shape[1]):
        for _ in range(2):
            q[:, j] -= q[:, :j] @ (q[:, :j].T @ q[:, j])
        q[:, j] /= np.linalg.norm(q[:, j]) + 1e-12
    return q


def softmax_sums(r: np.ndarray, keys: np.ndarray, values: np.ndarray, beta: float, copies: np.ndarray | None = None, rows: int = 1024, queries: int = 256):
    """For each query (row of r) the largest exponent m over the keys, z = sum exp(s - m) and v = sum exp(s - m) values, each key counted ``copies`` times.

    ``queries`` queries meet ``rows`` keys at a time, and what these give is merged (log-sum-exp): the working matrix has that size, however many there are.
    """
    m, z, v = np.full(len(r), -np.inf), np.zeros(len(r)), np.zeros((len(r), values.shape[1]))
    for i in range(0, len(r), queries):
        at = slice(i, i + queries)
        scaled = beta * r[at]
        for j in range(0, len(keys), rows):
            s = scaled @ keys[j : j + rows].T
            if copies is not None:
                s += np.log(copies[j : j + rows])
            top = np.maximum(m[at], s.max(1))
            s -= top[:, None]
            np.exp(s, out=s)
            before = np.exp(m[at] - top)
            m[at], z[at], v[at] = top, z[at] * before + s.sum(1), v[at] * before[:, None] + s @ values[j : j + rows]
    return m, z, v


def softmax_step(r: np.ndarray, keys: np.ndarray, values: np.ndarray, beta: float) -> np.ndarray:
    _, z, v = softmax_sums(r, keys, values, beta)
    return v / z[:, None]


class OnlineSeries:
    """A series learned as its values come: features of the last ``lookback`` values, a relative ridge fitted once ``train_end`` values are in,
    and from step ``first`` on an update and a forecast a step. What it holds is of fixed size, whatever has passed:

    ring: the last values; phis, preds: features and forecasts of the last ``horizon`` steps; h: the oscillators of ``bank``; a, b: until the fit the
    sums phi phi' and phi y, afterwards the inverses and weights of every step ahead.
    """

    FIELDS = ("ring", "phis", "preds", "h", "a", "b")

    def __init__(self, train_end: int, first: int, horizon: int, lookback: int, cadence: int, bins: int = 8, lam: float = 1e-3, online: bool = True, bank=(), plain: bool = False):
        """``plain``: phi is [1, x[t]] instead of the window features."""
        if first - horizon < lookback - 1 or first < train_end:
            raise ValueError("the first forecast must come after the fit, and its update must have features")
        self.train_end, self.first, self.horizon, self.lookback, self.cadence, self.bins, self.lam, self.online, self.plain = train_end, first, horizon, lookback, cadence, bins, lam, online, plain
        self.turns, self.gain = np.array([r * np.exp(1j * t) for r, t, _ in bank], dtype=complex), np.array([b for _, _, b in bank], dtype=float)
        self.width = (2 if plain else 6 + lookback + bins + 2) + 2 * len(bank)

    def start(self) -> dict:
        f = self.width
        return {"ring": np.empty(0), "phis": np.empty((0, f)), "preds": np.empty((0, self.horizon)), "h": np.zeros(len(self.turns), dtype=complex), "a": np.zeros((1, f, f)), "b": np.zeros((self.horizon, f))}

    def packed(self, held: dict) -> list[bytes]:
        return [np.ascontiguousarray(held[k]).tobytes() for k in self.FIELDS]

    def unpacked(self, packed: list[bytes]) -> dict:
        """The inverse of ``packed``; shapes follow from the sizes."""
        f, h = self.width, self.horizon
        shapes = {"ring": (-1,), "phis": (-1, f), "preds": (-1, h), "h": (-1,), "a": (-1, f, f), "b": (h, f)}
        return {k: np.frombuffer(v, dtype=complex if k == "h" else float).reshape(shapes[k]).copy() for k, v in zip(self.FIELDS, packed, strict=True)}

    def features(self, held: dict, t0: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        """The step of the first row and the features that values x from step t0 complete; the ring and the oscillators move on."""
        values = np.concatenate([held["ring"], x])
        begin = t0 - len(held["ring"])
        made = np.empty((0, self.width))
        if len(values) >= self.lookback:
            windows = np.column_stack((np.ones(len(values)), values))[self.lookback - 1 :] if self.plain else window_features(values, self.lookback, self.cadence, begin, self.bins)
            made = windows
        if len(self.turns):
            h = recurred(x[:, None] * self.gain, self.turns, held["h"])
            held["h"] = h[-1] if len(h) else held["h"]
            if len(made):
                rest = h[len(h) - len(made) :]
                made = np.concatenate([made, rest.real, rest.imag], axis=1)
        held["ring"] = values[max(0, len(values) - self.lookback + 1) :]
        return t0 + len(x) - len(made), made

    def advance(self, held: dict, t0: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take the values x of steps t0, t0 + 1, ...; ``held`` changes in place. Returns t, r, yhat, err of the forecasts whose targets are among them."""
        end, ahead, lam = t0 + len(x), np.arange(1, self.horizon + 1), self.lam
        begin, made = self.features(held, t0, x)
        phi = np.concatenate([held["phis"], made])
        p0 = begin - len(held["phis"])
        value = lambda t: x[t - t0]
        if t0 < self.train_end:
            new = made[: max(0, self.train_end - 1 - begin)]  # origins whose next step is a train row
            held["a"][0] += new.T @ new
            for r in ahead:
                t = np.arange(max(t0, p0 + r), min(end, self.train_end))
                if len(t):
                    held["b"][r - 1] += phi[t - r - p0].T @ value(t)
            if end >= self.train_end:
                fits = []
                for r in ahead:
                    lost = phi[max(0, self.train_end - r - p0) : max(0, self.train_end - 1 - p0)]
                    fits.append(relative_ridge(held["a"][0] - lost.T @ lost, held["b"][r - 1], lam))
                held["b"], held["a"] = (np.array([f[i] for f in fits]) for i in (0, 1))
        made = np.full((len(phi) - len(held["phis"]), self.horizon), np.nan)
        at = max(self.first, t0)
        if at < end:
            if self.online:
                x_of = np.concatenate([np.full(begin - p0 + max(0, t0 - begin), np.nan), x[max(0, begin - t0) :]])
                made[at - begin :], held["b"], held["a"] = online_pass(x_of, phi, ahead, held["b"], held["a"], at - p0, end - p0)
            else:
                made[at - begin :] = phi[at - p0 :] @ held["b"].T
        yhat = np.concatenate([held["preds"], made])
        origin = p0 + np.arange(len(phi))
        target = origin[:, None] + ahead
        i, j = np.nonzero((target >= t0) & (target < end) & (origin[:, None] >= self.first))
        keep = slice(max(0, len(phi) - self.horizon), None)
        held["phis"], held["preds"] = phi[keep].copy(), yhat[keep].copy()
        return origin[i], ahead[j], yhat[i, j], yhat[i, j] - value(target[i, j])
