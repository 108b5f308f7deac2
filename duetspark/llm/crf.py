"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

from . import lstm_steps


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Emissions of a BiLSTM over symbols, and the transitions between tags.

    Arrays are (direction, batch, time, unit); the second direction reads from the end.
    """

    def __init__(self, symbols: int, tags: int, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        bias = np.zeros((2, 4 * hidden), np.float32)
        bias[:, hidden : 2 * hidden] = 1  # remember at first
        self.p = {
            "x": draw(2, symbols, 4 * hidden), "h": draw(2, hidden, 4 * hidden), "b": bias,
            "out": draw(2 * hidden, tags), "c": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32),
        }
        self.hidden = hidden
        self._graphs: tuple = ((), [])  # weights, and the graphs made of them

    def emissions(self, idx: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """(batch, time, tag) scores of symbol numbers (batch, time)."""
        p, n, (batch, time) = self.p, self.hidden, idx.shape
        both = np.stack([idx, idx[:, ::-1]])
        pre = np.stack([p["x"][d][both[d]] + p["b"][d] for d in (0, 1)])
        h = np.zeros((2, batch, n), np.float32)
        c = np.zeros_like(h)
        hs = np.empty((2, batch, time, n), np.float32)
        steps = []
        for t in range(time):
            z = pre[:, :, t] + h @ p["h"]
            gates, fresh = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            was, before = c, h
            c = f * c + i * fresh
            th = np.tanh(c)
            h = o * th
            hs[:, :, t] = h
            if cache is not None:
                steps.append((i, f, o, fresh, was, th, before))
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], axis=2)
        if cache is not None:
            cache |= {"both": both, "steps": steps, "joined": joined}
        return joined @ p["out"] + p["c"]

    def gradients(self, idx: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags and its gradients."""
        p, n, (batch, time) = self.p, self.hidden, idx.shape
        cache: dict = {}
        e, trans = self.emissions(idx, cache).astype(np.float64), p["trans"].astype(np.float64)
        k = e.shape[2]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, time):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(time - 2, -1, -1):
            beta[:, t] = _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
        z = _lse(alpha[:, -1], 1)
        rows, at = np.arange(batch)[:, None], np.arange(time)[None]
        gold = e[rows, at, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, at, tags] -= 1
        pair = np.zeros((k, k))
        for t in range(1, time):
            pair += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None] - z[:, None, None]).sum(0)
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
        de = (de / batch).astype(np.float32)
        g = {"trans": (pair / batch).astype(np.float32), "c": de.sum((0, 1)), "out": np.einsum("bti,btk->ik", cache["joined"], de)}
        dj = de @ p["out"].T
        dh_in = np.stack([dj[:, :, :n], dj[:, ::-1, n:]])
        dh = np.zeros((2, batch, n), np.float32)
        dc = np.zeros_like(dh)
        g |= {name: np.zeros_like(p[name]) for name in ("x", "h", "b")}
        for t in range(time - 1, -1, -1):
            i, f, o, fresh, was, th, before = cache["steps"][t]
            dh = dh + dh_in[:, :, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * fresh * i * (1 - i), dc * was * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - fresh * fresh)], axis=2)
            g["h"] += before.transpose(0, 2, 1) @ dz
            g["b"] += dz.sum(1)
            for d in (0, 1):
                np.add.at(g["x"][d], cache["both"][d][:, t], dz[d])
            dh = dz @ p["h"].transpose(0, 2, 1)
            dc = dc * f
        return float((z - gold).mean()), g

    def fit(self, idx: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over shuffled batches; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, [0.0]
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(idx))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, g = self.gradients(idx[rows], tags[rows])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5 / max(norm, 1e-9))
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    hat = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * (0.5**epoch if epoch else 1) * hat).astype(np.float32)
        return float(np.mean(losses))

    def graphs(self) -> list[tuple[bytes, np.ndarray]]:
        """Both directions for ONNX Runtime, made once for the present weights: the graph, and what symbols give to the gates."""
        p, n = self.p, self.hidden
        made_of, made = self._graphs
        if len(made_of) != len(p) or any(a is not b for a, b in zip(made_of, p.values(), strict=True)):
            made = [(lstm_steps.graph(p["h"][d], p["out"][d * n : (d + 1) * n]), p["x"][d] + p["b"][d]) for d in (0, 1)]
            self._graphs = (tuple(p.values()), made)
        return made

    def scores(self, idx: np.ndarray) -> np.ndarray:
        """(time, tag, batch): the emissions again, without what training needs and several times faster.

        ONNX Runtime computes them where it is installed, numpy elsewhere; they differ by rounding only.
        """
        if lstm_steps.onnxruntime is None or idx.shape[1] % lstm_steps.STEPS:
            return self.plain_scores(idx)
        at = np.ascontiguousarray(idx.T)
        out = np.empty((len(at), len(self.p["c"]), at.shape[1]), np.float32)
        out[:] = self.p["c"][:, None]
        for (made, of_symbol), way in zip(self.graphs(), (1, -1), strict=True):
            lstm_steps.add_scores(lstm_steps.session(made), of_symbol, at[::way], out[::way])
        return out

    def plain_scores(self, idx: np.ndarray) -> np.ndarray:
        """``scores`` by numpy alone."""
        p, n, (batch, time) = self.p, self.hidden, idx.shape
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * n, n])[:, None]  # a gate is half a hyperbolic tangent of half its input, and a half
        out, at = np.empty((2, time, n, batch), np.float32), np.ascontiguousarray(idx.T)
        z, x, new = np.empty((4 * n, batch), np.float32), np.empty((batch, 4 * n), np.float32), np.empty((n, batch), np.float32)
        gate, fresh = z[: 3 * n], z[3 * n :]
        for d in (0, 1):
            of_symbol, of_state = (p["x"][d] + p["b"][d]) * half.T, np.ascontiguousarray(p["h"][d].T * half)
            h, c = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
            for t in range(time) if d == 0 else range(time - 1, -1, -1):
                np.take(of_symbol, at[t], axis=0, out=x, mode="clip")
                np.matmul(of_state, h, out=z)
                z += x.T
                np.tanh(z, out=z)
                gate += 1
                gate *= 0.5
                np.multiply(gate[:n], fresh, out=new)
                c *= gate[n : 2 * n]
                c += new
                np.tanh(c, out=new)
                h = out[d, t]
                np.multiply(gate[2 * n :], new, out=h)
        return np.matmul(p["out"][:n].T, out[0]) + np.matmul(p["out"][n:].T, out[1]) + p["c"][:, None]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags for emissions (time, tag)."""
        return self.best(e[:, :, None])[0]

    def best(self, e: np.ndarray) -> np.ndarray:
        """(batch, time): the best tags for emissions (time, tag, batch), all sequences at once."""
        trans, (time, k, batch) = self.p["trans"], e.shape
        score = e.copy()  # of the best sequence that ends with each tag
        total, top = np.empty((k, k, batch), score.dtype), np.empty((k, batch), score.dtype)
        for t in range(1, time):
            np.add(score[t - 1][:, None], trans[:, :, None], out=total)
            total.max(axis=0, out=top)
            score[t] += top
        tags = np.empty((batch, time), np.uint8)
        tags[:, -1] = score[-1].argmax(0)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = (score[t - 1] + trans[:, tags[:, t]]).argmax(0)
        return tags

    def tag(self, idx: np.ndarray) -> np.ndarray:
        """(batch, time): the best tags of symbol numbers.

        A run of other tags than 0 gains at most what each of its characters gains with the best
        transition between such tags, and the best transitions into and out of the run. Sequences in
        which no run can gain are 0 throughout and need no search; ``best`` gives the same for them.
        """
        e, trans = self.scores(idx), self.p["trans"] - self.p["trans"][0, 0]
        within, into, out = float(trans[1:, 1:].max()), float(trans[0, 1:].max()), float(trans[1:, 0].max())
        gains = e[:, 1:].max(1) - e[:, 0] + within
        run = gains[0].astype(np.float64)  # the most that a run gains which ends here
        most = np.full_like(run, -np.inf)  # and which ended before
        for gain in gains[1:]:
            np.maximum(most, run, out=most)
            np.maximum(run, into, out=run)
            run += gain
        open_ = np.maximum(most + out, run) - within > -1e-3
        tags = np.zeros(idx.shape, np.uint8)
        if open_.any():
            tags[open_] = self.best(e[:, :, open_])
        return tags
