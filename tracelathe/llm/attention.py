"""A small causal self-attention model of item sequences, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

F32 = np.float32
#: Rows whose scores of all symbols are held at once, few enough to stay in a core's cache.
BLOCK = 1024
#: Scores of items inside symbols that are held at once, and places whose attention is worked out together in short windows.
ROOM, TOGETHER = 1 << 20, 16
#: Places of sequences whose common beginnings are looked for at once.
ALIKE = 1 << 18


class Attention:
    """One attention layer and one hidden layer over a window; predicts the item wanted at each place from those seen.

    What is seen at a place is an item (and, with `tails` > 0, a second number: its tail), what is wanted is usually the
    next item; the item number `items` stands before a sequence's first. Items have symbols, in order (each its own
    unless `symbol_of` says otherwise): the symbol is predicted first, then the item by a softmax over the symbol's items
    that starts from `shares` (logarithms). Every item and tail seen has a vector. The last `apart` items have no part in
    that softmax and a logarithm of 0 in it. Scores of the last symbol's pairs with all symbols are added to the layer's,
    so that attention is left with what pairs don't tell.

    Sequences of at most `window` places are one window; windows of longer ones overlap by `overlap` places at least. The
    places of a first window are all scored, of later ones those that no window before has scored, so every place is
    scored once, with at least `overlap` places before it, or all there are.
    """

    DENSE = ("embed", "place", "qkv", "out", "hide", "hide_bias", "show", "head", "pair")
    ROWS = ("own", "tail", "inner")
    NAMES = DENSE + ROWS

    def __init__(self, size: int, width: int = 16, window: int = 32, overlap: int = 8, seed: int = 1, symbol_of=None, shares=None, apart: int = 0, tails: int = 0):
        rng = np.random.default_rng(seed)
        self.size, self.width, self.window, self.overlap = size, width, window, overlap
        self.symbol_of = np.append(np.arange(size) if symbol_of is None else symbol_of, size)
        self.items = len(self.symbol_of) - 1
        self.shares = np.zeros(self.items, F32) if shares is None else shares.astype(F32)
        softmax = self.items - apart
        self.first = np.searchsorted(self.symbol_of[:softmax], np.arange(size + 1))
        self.chosen = (np.diff(self.first) > 1)[self.symbol_of[:-1]] & (np.arange(self.items) < softmax)
        shapes = [(size + 1, width), (window, width), (width, 3 * width), (width, width), (width, 2 * width), (2 * width,), (2 * width, width), (width, size), (size + 1, size)]
        shapes += [(self.items + 1, width), (tails + 1 if tails else 0, width), (self.items, width)]
        scales = [0.3, 0.1, 0.3, 0.1, 0.3, 0, 0.1, 0.1, 0, 0, 0, 0]
        for name, shape, scale in zip(self.NAMES, shapes, scales, strict=True):
            setattr(self, name, (scale * rng.standard_normal(shape)).astype(F32))

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.NAMES])

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            was = getattr(self, k)
            setattr(self, k, weights[at : at + was.size].reshape(was.shape).astype(F32))
            at += was.size

    def _hidden(self, seen: np.ndarray, tails: np.ndarray | None, scored_from: int = 0) -> dict:
        """What the layers find at every place, and from scored_from on what the symbols are predicted by (z)."""
        n, t = seen.shape
        d, scale = self.width, self.width**-0.5
        symbols = self.symbol_of[seen]
        x = self.embed.take(symbols, axis=0)
        x += self.own.take(seen, axis=0)
        x += self.place[:t]
        if tails is not None:
            x += self.tail.take(tails, axis=0)
        # Short windows stand several in a block, where they don't see each other. Only places from scored_from on look back.
        many = 1 if scored_from else max(g for g in range(1, max(1, TOGETHER // t) + 1) if n % g == 0)
        scaled = self.qkv.copy()
        scaled[:, :d] *= scaled.dtype.type(scale)
        rows = np.empty((n * t, 3 * d + 1), x.dtype)
        np.matmul(x.reshape(-1, d), scaled, out=rows[:, :-1])
        rows[:, -1] = 1  # sums the shares up beside the values
        rows = rows.reshape(n // many, many * t, -1)
        q, k, v = rows[:, scored_from:, :d], rows[:, :, d : 2 * d], rows[:, :, 2 * d :]
        a = q @ k.transpose(0, 2, 1)
        if a.max() > 30:
            np.minimum(a, a.dtype.type(30), out=a)
        np.exp(a, out=a)
        a *= np.kron(np.eye(many, dtype=a.dtype), np.tril(np.ones((t, t), a.dtype)))[scored_from:]
        o = (a @ v).reshape(-1, d + 1)
        part = 1 / o[:, d:]
        o = o[:, :d] * part
        y = o @ self.out
        y += x[:, scored_from:].reshape(-1, d)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "part": part, "o": o, "symbols": symbols[:, scored_from:].reshape(-1)} | self._above(y)

    def _above(self, y: np.ndarray) -> dict:
        m = y @ self.hide
        m += self.hide_bias
        np.maximum(m, 0, out=m)
        return {"y": y, "m": m, "z": y + m @ self.show}

    def _forward(self, seen: np.ndarray, tails: np.ndarray | None, scored_from: int = 0) -> dict:
        s = self._hidden(seen, tails, scored_from)
        return s | {"logits": s["z"] @ self.head + self.pair[s["symbols"]]}

    def _scores(self, z: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Every symbol's score (60 at most) by rows, BLOCK of them at a time, in an array that is used again."""
        room, more = np.empty((2, min(BLOCK, len(z)), self.size), z.dtype)
        for a in range(0, len(z), BLOCK):
            rows = slice(a, min(a + BLOCK, len(z)))
            n = rows.stop - a
            logits = np.matmul(z[rows], self.head, out=room[:n])
            logits += np.take(self.pair, symbols[rows], axis=0, out=more[:n], mode="clip")
            if logits.max() > 60:
                np.minimum(logits, logits.dtype.type(60), out=logits)
            yield rows, logits

    def _inside(self, z: np.ndarray, flat: np.ndarray, of: np.ndarray | None = None):
        """The rows that want one of a symbol's several items, about ROOM scores at a time: their numbers; z; the exponentials of
        their scores of all the symbol's items, row after row; each row's sum; where the wanted ones are; and the parts of one symbol
        (rows from and to, items from and to, the exponentials). of: the row of z of each, if that isn't its own number."""
        rows = np.flatnonzero(self.chosen[flat])
        symbols = self.symbol_of[flat[rows]]
        order = _order(symbols, self.size)
        rows, symbols = rows[order], symbols[order]
        sizes = np.diff(self.first)[symbols]
        ends = np.cumsum(sizes)
        groups = [0, *(np.flatnonzero(np.diff(ends // ROOM)) + 1).tolist(), len(rows)] if len(rows) else []
        for c, e in zip(groups, groups[1:], strict=False):
            at = ends[c:e] - sizes[c:e]
            at -= at[0]
            own, here, parts = z.take(rows[c:e] if of is None else of[rows[c:e]], axis=0), symbols[c:e], []
            p = np.empty(at[-1] + sizes[e - 1], z.dtype)
            cuts = [*np.flatnonzero(np.diff(here, prepend=-1)).tolist(), e - c]
            for x, y, symbol, begin in zip(cuts, cuts[1:], here[cuts[:-1]].tolist(), at[cuts[:-1]].tolist(), strict=False):
                a, b = int(self.first[symbol]), int(self.first[symbol + 1])
                part = p[begin : begin + (y - x) * (b - a)].reshape(y - x, b - a)
                np.matmul(own[x:y], self.inner[a:b].T, out=part)
                part += self.shares[a:b]
                parts.append((x, y, a, b, part))
            most = np.maximum.reduceat(p, at)
            if most.max() > 60 or most.min() < -60:
                p -= np.repeat(most, sizes[c:e])
            np.exp(p, out=p)
            yield rows[c:e], own, p, np.add.reduceat(p, at), at + flat[rows[c:e]] - self.first[here], parts

    def log_probabilities(self, seen: np.ndarray, tails: np.ndarray | None, wanted: np.ndarray, scored_from: int = 0) -> np.ndarray:
        """Natural logarithms for the wanted items at the places from scored_from on; all windows x places."""
        s = self._hidden(seen, tails, scored_from)
        flat = wanted[:, scored_from:].reshape(-1)
        return self._found(s["z"], s["symbols"], np.arange(len(flat)), flat).reshape(len(seen), -1)

    def _found(self, z: np.ndarray, symbols: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms for wanted items; of: the row of z (with the symbol seen there) that each is predicted by, in order."""
        right, found, ones = self.symbol_of[wanted], np.empty(len(wanted), z.dtype), np.ones(self.size, z.dtype)
        for own, logits in self._scores(z, symbols):
            here = slice(*np.searchsorted(of, (own.start, own.stop)).tolist())
            row = of[here] - own.start
            found[here] = logits[row, right[here]]
            found[here] -= np.log(np.exp(logits, out=logits) @ ones)[row]
        for a in range(0, len(wanted), 1 << 16):
            for rows, _, p, total, hit, _ in self._inside(z, wanted[a : a + (1 << 16)], of[a : a + (1 << 16)]):
                found[a + rows] += np.log(np.maximum(p[hit] / total, 1e-30))
        return found

    def score_alike(self, seen: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As `score`, without tails: what sequences of one window that begin alike have in common is worked out once."""
        out, sizes = np.zeros(len(wanted), F32), np.diff(at)
        long = np.flatnonzero(sizes > self.window)
        if len(long):
            index = np.concatenate([np.arange(at[i], at[i + 1]) for i in long.tolist()])
            out[index] = self.score(seen[index], None, wanted[index], np.concatenate(([0], np.cumsum(sizes[long]))))
        short = np.flatnonzero((sizes > 0) & (sizes <= self.window))
        short = short[np.argsort(seen[at[short]], kind="stable")]
        parts = np.cumsum(sizes[short]) // ALIKE
        for part in np.split(short, np.flatnonzero(np.diff(parts)) + 1):
            self._score_alike(seen, wanted, at[part], sizes[part], out)
        return out

    def _score_alike(self, seen: np.ndarray, wanted: np.ndarray, begin: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """One place after the other: a node is a beginning of sequences; above: for each place before, the nodes' own beginnings there."""
        d = self.width
        node, above, levels = np.zeros(len(begin), np.int64), np.zeros((1, 0), np.int64), []
        for t in range(sizes.max() if len(sizes) else 0):
            more = sizes > t
            begin, sizes, node = begin[more], sizes[more], node[more]
            first, which = np.unique(node * (self.items + 1) + seen[begin + t], return_index=True, return_inverse=True)[1:]
            items, above = seen[begin[first] + t], above[node[first]]
            x = self.embed.take(self.symbol_of[items], axis=0) + self.own.take(items, axis=0) + self.place[t]
            q, k, v = np.split(x @ self.qkv, 3, axis=1)
            levels.append((k, v))
            above = np.concatenate((above, np.arange(len(x))[:, None]), axis=1)
            a = np.empty((len(x), t + 1), x.dtype)
            for i, (k, _) in enumerate(levels):
                a[:, i] = np.einsum("nd,nd->n", q, k.take(above[:, i], axis=0))
            a = np.exp(np.minimum(a * x.dtype.type(d**-0.5), x.dtype.type(30)))
            a /= a.sum(axis=1, keepdims=True)
            o = np.zeros_like(x)
            for i, (_, v) in enumerate(levels):
                o += a[:, i, None] * v.take(above[:, i], axis=0)
            order = np.argsort(which, kind="stable")
            out[begin[order] + t] = self._found(self._above(x + o @ self.out)["z"], self.symbol_of[items], which[order], wanted[begin[order] + t])
            node = which

    def windows(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
        """Groups of windows of one size: first places, places, and how many at the front are scored already (None: none)."""
        begin, size, w = at[:-1], np.diff(at), self.window
        for t in np.unique(size[(size > 0) & (size <= w)]).tolist():
            yield begin[size == t], t, None
        long = np.flatnonzero(size > w)
        if len(long):
            yield begin[long], w, None
            step = w - self.overlap
            more = -(-(size[long] - w) // step)
            of = np.repeat(long, more)
            number = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
            start = np.minimum(begin[of] + step * number, at[1:][of] - w)  # the last one ends with its sequence
            yield start, w, begin[of] + step * (number - 1) + w - start

    def score(self, seen: np.ndarray, tails: np.ndarray | None, wanted: np.ndarray, at: np.ndarray, chunk: int = 8192) -> np.ndarray:
        """The natural log probability of every wanted item; at: where each sequence begins, and the end."""
        out = np.zeros(len(wanted), F32)
        for starts, t, done in self.windows(at):
            places, rows = np.arange(t), max(1, chunk // t)
            scored_from = 0 if done is None else self.overlap
            for c in range(0, len(starts), rows):
                index = starts[c : c + rows, None] + places
                found = self.log_probabilities(seen[index], None if tails is None else tails[index], wanted[index], scored_from)
                index = index[:, scored_from:]
                if done is not None:
                    fresh = places[scored_from:] >= done[c : c + rows, None]
                    index, found = index[fresh], found[fresh]
                out[index] = found
        return out

    def gradients(self, seen: np.ndarray, tails: np.ndarray | None, wanted: np.ndarray, scored_from: int = 0) -> tuple[float, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
        """The mean loss at the places from scored_from on, its gradients by the dense weights, and by the others' rows; all windows x places."""
        n, t = seen.shape
        d = self.width
        s = self._hidden(seen, tails, scored_from)
        flat = wanted[:, scored_from:].reshape(-1)
        count = len(flat)
        # Rows in order of the symbol seen, so that each one's sum is that of neighbours.
        order = _order(s["symbols"], self.size)
        z, symbols, seen_symbols = s["z"].take(order, axis=0), self.symbol_of[flat[order]], s["symbols"][order]
        g, head, last = {"pair": np.zeros_like(self.pair)}, np.zeros_like(self.head.T, order="C"), -1
        at, ends = 0, [*np.flatnonzero(np.diff(seen_symbols)).tolist(), count - 1]
        parts = [(symbol, end + 1) for symbol, end in zip(seen_symbols[ends].tolist(), ends, strict=True)][::-1]
        loss, dz, ones = 0.0, np.empty_like(s["z"]), np.ones(self.size, z.dtype)
        for own, p in self._scores(z, seen_symbols):
            np.exp(p, out=p)
            total = p @ ones
            weight = 1 / (count * total)  # a row's gradient is p x weight, less 1 / count for what was wanted
            hit = (np.arange(len(p)), symbols[own])
            loss -= float(np.log(np.maximum(p[hit] / total, 1e-30)).sum()) / count
            p[hit] -= total
            head += p.T @ (z[own] * weight[:, None])
            while at < own.stop:
                symbol, end = parts[-1]
                a, b = at - own.start, min(end, own.stop) - own.start
                if symbol == last:
                    g["pair"][symbol] += weight[a:b] @ p[a:b]
                else:
                    np.dot(weight[a:b], p[a:b], out=g["pair"][symbol])
                at, last = own.start + b, symbol
                if at == end:
                    parts.pop()
            dz[order[own]] = (p @ self.head.T) * weight[:, None]
        g["head"] = head.T
        inner, right = [], []
        for own, own_z, q, total, hit, parts in self._inside(s["z"], flat):
            weight = 1 / (count * total)
            right.append(q[hit] / total)
            q[hit] -= total
            weighted, back = own_z * weight[:, None], np.empty_like(own_z)
            for x, y, a, b, p in parts:
                np.matmul(p, self.inner[a:b], out=back[x:y])
                if inner and inner[-1][0] == a:
                    inner[-1][2] += p.T @ weighted[x:y]
                else:
                    inner.append([a, b, p.T @ weighted[x:y]])
            dz[own] += back * weight[:, None]
        if right:
            loss -= float(np.log(np.maximum(np.concatenate(right), 1e-30)).sum()) / count
        g["show"] = s["m"].T @ dz
        dm = dz @ self.show.T
        dm *= s["m"] > 0
        g["hide"], g["hide_bias"] = s["y"].T @ dm, np.ones(count, dm.dtype) @ dm
        dz += dm @ self.hide.T
        g["out"] = s["o"].T @ dz
        do = dz @ self.out.T
        parts = np.empty((count, d + 1), do.dtype)
        np.multiply(do, s["part"], out=parts[:, :d])
        np.multiply(np.einsum("nd,nd->n", do, s["o"]), -s["part"][:, 0], out=parts[:, d])  # what a row's gradients by its shares sum to, weighted by them
        blocks, looking, size = s["a"].shape
        parts = parts.reshape(blocks, looking, d + 1)
        ds = parts @ s["v"].transpose(0, 2, 1)
        ds *= s["a"]
        dqkv = np.empty((blocks, size, 3 * d), ds.dtype)
        dqkv[:, : size - looking, :d] = 0
        np.matmul(ds, s["k"], out=dqkv[:, size - looking :, :d])
        dqkv[:, :, :d] *= ds.dtype.type(d**-0.5)
        np.matmul(ds.transpose(0, 2, 1), s["q"], out=dqkv[:, :, d : 2 * d])
        np.matmul(s["a"].transpose(0, 2, 1), parts[:, :, :d], out=dqkv[:, :, 2 * d :])
        dqkv = dqkv.reshape(-1, 3 * d)
        g["qkv"] = (dqkv.T @ s["x"].reshape(-1, d)).T
        dx = dqkv @ self.qkv.T
        dx.reshape(n, t, d)[:, scored_from:] += dz.reshape(n, -1, d)
        g["place"] = np.zeros_like(self.place)
        g["place"][:t] = (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(t, d)
        g["embed"] = np.zeros_like(self.embed)
        at, sums = _by_row(seen.reshape(-1), dx, len(self.own))
        by_row = {"own": (at, sums)}
        symbols, sums = _by_row(self.symbol_of[at], sums, self.size + 1)
        g["embed"][symbols] = sums
        if tails is not None:
            by_row["tail"] = _by_row(tails.reshape(-1), dx, len(self.tail))
        if inner:
            by_row["inner"] = (np.concatenate([np.arange(a, b) for a, b, _ in inner]), np.concatenate([x for _, _, x in inner]))
        return loss, g, by_row

    def start_pairs(self, seen: np.ndarray, wanted: np.ndarray, weight: float = 500.0) -> None:
        """Sets the pairs' scores to the logarithms of their shares, drawn to the single ones by so many pairs more."""
        seen, wanted = self.symbol_of[seen], self.symbol_of[wanted]
        counts = np.bincount(seen * self.size + wanted, minlength=(self.size + 1) * self.size).reshape(self.size + 1, self.size)
        single = np.bincount(wanted, minlength=self.size) + 0.5
        shares = (counts + weight * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + weight)
        self.pair = np.log(shares).astype(F32)

    def batches(self, at: np.ndarray, rng, share: float, batch: int) -> list[tuple[np.ndarray, int, int]]:
        """A share of all windows (at least one), in batches of about `batch` places and one size, shuffled; with the place that each is learned from on."""
        out = []
        for starts, t, done in self.windows(at):
            chosen = starts[rng.random(len(starts)) < share]
            chosen = rng.permutation(chosen if len(chosen) else starts[:1])
            rows = max(1, batch // t)
            out += [(chosen[c : c + rows], t, 0 if done is None else self.overlap) for c in range(0, len(chosen), rows)]
        return [out[i] for i in rng.permutation(len(out))]

    def step(self, state: dict, seen: np.ndarray, tails: np.ndarray | None, wanted: np.ndarray, rate: float, scored_from: int = 0) -> float:
        """One step of Adam for the dense weights and of Adagrad for rows; the loss."""
        loss, g, by_row = self.gradients(seen, tails, wanted, scored_from)
        count = state["count"] = state.get("count", 0) + 1
        x = np.concatenate([g[k].reshape(-1) for k in self.DENSE])
        if "moments" not in state:
            state["moments"] = np.zeros((2, len(x)), x.dtype)
            ends = np.cumsum([g[k].size for k in self.DENSE]).tolist()
            for k, b in zip(self.DENSE, ends, strict=True):
                state[k] = tuple(m[b - g[k].size : b].reshape(g[k].shape) for m in state["moments"])
        mean, square = state["moments"]
        mean *= 0.9
        mean += 0.1 * x
        square *= 0.99
        x *= x
        x *= 0.01
        square += x
        change = np.divide(square, 1 - 0.99**count, out=x)
        np.sqrt(change, out=change)
        change += 1e-8
        np.divide(mean, change, out=change)
        change *= rate / (1 - 0.9**count)
        at = 0
        for k in self.DENSE:
            was = getattr(self, k)
            setattr(self, k, was - change[at : at + was.size].reshape(was.shape).astype(F32, copy=False))
            at += was.size
        for k, (rows, x) in by_row.items():
            if k not in state:
                state[k] = np.full(len(getattr(self, k)), 1e-9)
            square = state[k][rows] + np.einsum("nd,nd->n", x, x) / x.shape[1]
            state[k][rows] = square
            getattr(self, k)[rows] -= x * (6 * rate / np.sqrt(square)).astype(F32)[:, None]
        return loss

    def fit(self, seen: np.ndarray, tails: np.ndarray | None, wanted: np.ndarray, at: np.ndarray, rng, rate: float, share: float = 1.0, batch: int = 4096, steps: int | None = None, state: dict | None = None) -> list[float]:
        """Steps over a share of the windows; with `steps`, that many, going over the windows as often as needed. The losses.

        Each place is learned from in the window that scores it, so a share of 1 goes over every place.
        """
        losses, state = [], {} if state is None else state
        while len(wanted) and (not losses or steps and len(losses) < steps):
            for starts, t, scored_from in self.batches(at, rng, share, batch):
                index = starts[:, None] + np.arange(t)
                now = rate if not steps else rate * min(1, (len(losses) + 1) / 30) * max(0.05, 1 - len(losses) / steps)
                losses.append(self.step(state, seen[index], None if tails is None else tails[index], wanted[index], now * len(starts) * t / batch if len(starts) * t < batch else now, scored_from))
                if steps and len(losses) >= steps:
                    break
        return losses


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers of less than `below`; numpy sorts narrow ones by their digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _by_row(rows: np.ndarray, values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows (numbers of less than `below`) and the sums of their values."""
    order = _order(rows, below)
    found = rows[order]
    new = np.diff(found, prepend=-1) > 0
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    found, d = found[new], values.shape[1]
    sums = np.bincount((number[:, None] * d + np.arange(d)).reshape(-1), values.reshape(-1), len(found) * d)
    return found, sums.astype(values.dtype, copy=False).reshape(-1, d)
