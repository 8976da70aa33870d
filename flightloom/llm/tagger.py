"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

EMBEDDED, HIDDEN = 16, 24
#: Code points below 128 have entries of their own, others share 32; the last entry is padding.
SYMBOLS = 128 + 32 + 1
PAD = SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points, 128 + points % 32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Scores of each tag at each character of windows of one length; ``tags`` many. Both directions run at once: the second over the windows turned round."""

    def __init__(self, tags: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, shape[-2] ** -0.5, shape).astype(np.float32)
        start = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        start[:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p = {"emb": rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)).astype(np.float32), "x": normal(2, EMBEDDED, 4 * HIDDEN), "h": normal(2, HIDDEN, 4 * HIDDEN), "c": start, "out": normal(2 * HIDDEN, tags), "bias": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32), "begin": np.zeros(tags, np.float32)}

    def run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (windows, time, two hidden), and what the way back needs."""
        p, H = self.p, HIDDEN
        n, time = x.shape[:2]
        both = np.stack([x, x[:, ::-1]])
        fed = (both.reshape(2, n * time, EMBEDDED) @ p["x"] + p["c"]).reshape(2, n, time, 4 * H)
        h, c = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        out, kept = np.empty((2, n, time, H), np.float32), []
        for t in range(time):
            z = fed[:, :, t] + h @ p["h"]
            gates = sigmoid(z[..., : 3 * H])
            i, f, o = gates[..., :H], gates[..., H : 2 * H], gates[..., 2 * H :]
            g = np.tanh(z[..., 3 * H :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, :, t] = h
            if keep:
                kept.append((t, i, f, o, g, before, tc, last))
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), kept

    def back(self, x: np.ndarray, kept: list, dh: np.ndarray, grad: dict) -> np.ndarray:
        p, H = self.p, HIDDEN
        n, time = x.shape[:2]
        both, dout = np.stack([x, x[:, ::-1]]), np.stack([dh[:, :, :H], dh[:, ::-1, H:]])
        dz_all = np.empty((2, n, time, 4 * H), np.float32)
        dh, dc = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        grad["h"], turned = np.zeros_like(p["h"]), p["h"].transpose(0, 2, 1)
        for t, i, f, o, g, before, tc, last in reversed(kept):
            dh = dh + dout[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            grad["h"] += last.transpose(0, 2, 1) @ dz
            dz_all[:, :, t] = dz
            dh, dc = dz @ turned, dc * f
        flat = dz_all.reshape(2, n * time, 4 * H)
        grad["x"] = both.reshape(2, n * time, EMBEDDED).transpose(0, 2, 1) @ flat
        grad["c"] = flat.sum(axis=1, keepdims=True)
        dx = (flat @ p["x"].transpose(0, 2, 1)).reshape(2, n, time, EMBEDDED)
        return dx[0] + dx[1][:, ::-1]

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return self.run(self.p["emb"][windows], False)[0] @ self.p["out"] + self.p["bias"]

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> tuple[dict, float]:
        """Of the mean negative log-likelihood of the tags."""
        p, grad = self.p, {}
        n, time = windows.shape
        x = p["emb"][windows]
        h, kept = self.run(x, True)
        e = h @ p["out"] + p["bias"]
        # forward and backward sums as products of scaled probabilities
        top, start, move = e.max(axis=2), p["begin"].max(), p["move"].max()
        each, moved = np.exp(e - top[:, :, None]), np.exp(p["move"] - move)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty_like(top)
        for t in range(time):
            alpha[:, t] = each[:, t] * (np.exp(p["begin"] - start) if t == 0 else alpha[:, t - 1] @ moved)
            scale[:, t] = alpha[:, t].sum(axis=1)
            alpha[:, t] /= scale[:, t, None]
        dmove = np.zeros_like(p["move"])
        for t in range(time - 1, 0, -1):
            ahead = each[:, t] * beta[:, t] / scale[:, t, None]
            dmove += alpha[:, t - 1].T @ ahead
            beta[:, t - 1] = ahead @ moved.T
        dmove *= moved
        total = (np.log(scale) + top).sum(axis=1) + start + move * (time - 1)
        de = alpha * beta
        rows = np.arange(n)
        loss = total - p["begin"][tags[:, 0]] - e[rows[:, None], np.arange(time), tags].sum(axis=1) - p["move"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        np.add.at(dmove, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        de[rows[:, None], np.arange(time), tags] -= 1
        grad["begin"], grad["move"] = de[:, 0].sum(axis=0) / n, dmove / n
        de /= n
        flat = de.reshape(-1, de.shape[2])
        grad["out"], grad["bias"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        dh = de @ p["out"].T
        dx = self.back(x, kept, dh, grad)
        grad["emb"] = np.zeros_like(p["emb"])
        np.add.at(grad["emb"], windows.ravel(), dx.reshape(-1, EMBEDDED))
        return grad, float(loss.mean())

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tags by Viterbi."""
        e, p = self.scores(windows), self.p
        n, time, k = e.shape
        best, came = p["begin"] + e[:, 0], np.zeros((n, time, k), np.int8)
        for t in range(1, time):
            each = best[:, :, None] + p["move"]
            came[:, t] = each.argmax(axis=1)
            best = each.max(axis=1) + e[:, t]
        tags = np.zeros((n, time), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        return tags


def fit_tagger(windows: np.ndarray, tags: np.ndarray, n_tags: int, steps: int = 300, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Tagger:
    model = Tagger(n_tags)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    order, at = rng.permutation(len(windows)), 0
    for t in range(1, steps + 1):
        if at + batch > len(order):
            order, at = rng.permutation(len(windows)), 0
        pick = order[at : at + batch]
        at += batch
        grad, _ = model.gradients(windows[pick], tags[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            model.p[k] = (model.p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model
