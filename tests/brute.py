"""Plain NumPy statements of the learners, to compare the jobs with."""

import numpy as np

from textrill.config import FtrlConfig

CFG = FtrlConfig()


def weight(z, n, cfg=CFG):
    w = -(z - np.sign(z) * cfg.lambda1) / (cfg.lambda2 + (cfg.beta + np.sqrt(n)) / cfg.alpha)
    return np.where(np.abs(z) <= cfg.lambda1, 0.0, w)


def ftrl_pass(x, target, z, n, cfg=CFG):
    w = weight(z, n, cfg)
    p = 1 / (1 + np.exp(-(x @ w)))
    g = (p - target)[:, None] * x
    dz = g - (np.sqrt(n + g**2) - np.sqrt(n)) / cfg.alpha * w
    return z + dz.sum(axis=0), n + (g**2).sum(axis=0)


def ftrl_train(x, y, state, labels, passes=3, cfg=CFG):
    """``state`` maps a label to (z, n); it is changed for every label."""
    for label in labels:
        z, n = state.get(label, (np.zeros(x.shape[1]), np.zeros(x.shape[1])))
        target = np.array([float(v == label) for v in y])
        for _ in range(passes):
            z, n = ftrl_pass(x, target, z, n, cfg)
        state[label] = (z, n)
    return state


def prequential(batches, passes=3, drop=0.2, cfg=CFG):
    """Accuracies, drift flags and the final state over (x, y) batches."""
    state, labels, out, last = {}, [], [], None
    for x, y in batches:
        times = 1
        if labels:
            margins = np.stack([x @ weight(*state[label], cfg) for label in labels], axis=1)
            pred = [labels[i] for i in margins.argmax(axis=1)]
            accuracy = float(np.mean([a == b for a, b in zip(pred, y)]))
            drift = last is not None and last - accuracy > drop
            times, last = (2 if drift else 1), accuracy
            out.append((accuracy, drift))
        labels = labels + sorted(set(y) - set(labels))
        for _ in range(times):
            ftrl_train(x, y, state, labels, passes, cfg)
    return out, state, labels


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash of the engine, whose tail bytes are mixed one by one, signed."""

    def mul(a, b):
        return (a * b) & 0xFFFFFFFF

    def rotl(a, r):
        return ((a << r) | (a >> (32 - r))) & 0xFFFFFFFF

    def mix(h, k):
        k = mul(rotl(mul(k, 0xCC9E2D51), 15), 0x1B873593)
        return (mul(rotl(h ^ k, 13), 5) + 0xE6546B64) & 0xFFFFFFFF

    h = seed
    whole = len(data) - len(data) % 4
    for i in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[i : i + 4], "little"))
    for byte in data[whole:]:
        h = mix(h, (byte - 256 if byte > 127 else byte) & 0xFFFFFFFF)
    h ^= len(data)
    h = mul(h ^ (h >> 16), 0x85EBCA6B)
    h = mul(h ^ (h >> 13), 0xC2B2AE35)
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h
