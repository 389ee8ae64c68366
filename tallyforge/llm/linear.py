"""A regularized linear classifier on hashed character n-grams and a few dense features of short texts.

Hashing and scoring work on a whole batch of texts at once: the texts lie in one byte buffer, and the
n-grams of every order are rolling hashes over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BITS = 18
ORDERS = (1, 2, 3, 4, 5, 6, 8)
_SIZE = 1 << BITS
DENSE = 9
_SEPARATOR, _START, _END = 10, 2, 3


@dataclass
class Hashed:
    """A batch's n-grams: buckets and the text each belongs to, and the dense features by text."""

    bucket: np.ndarray
    text: np.ndarray
    dense: np.ndarray


def _buffer(texts: list[str]) -> np.ndarray:
    """The texts' bytes: lower case, digits made equal, marked where they begin and end, a break after each."""
    raw = "\n".join(f"\2{t.lower()}\3".replace("\n", " ") for t in texts) + "\n"
    b = np.frombuffer(raw.encode("utf-8", "replace"), np.uint8).copy()
    b[(b >= 48) & (b <= 57)] = 48
    return b


def _rolled(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that begins at each place."""
    h = np.zeros(len(b), np.uint32)
    for n in range(1, min(max(ORDERS), len(b)) + 1):
        m = len(b) - n + 1
        h = h[:m] * np.uint32(0x01000193) + b[n - 1 :].astype(np.uint32) + np.uint32(1)
        if n in ORDERS:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield n, mixed >> np.uint32(32 - BITS)


def hashed(texts: list[str]) -> Hashed:
    """The n-grams of each text, none across two, and the dense features."""
    b = _buffer(texts)
    breaks = b == _SEPARATOR
    owner = np.cumsum(breaks) - breaks
    seps = np.concatenate([[0], np.cumsum(breaks)])
    buckets, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for n, all_buckets in _rolled(b):
        m = len(all_buckets)
        within = seps[n:] == seps[:m]
        buckets.append(all_buckets[within])
        owners.append(owner[:m][within])
    return Hashed(np.concatenate(buckets), np.concatenate(owners), _dense([t.replace("\n", " ") for t in texts]))


def _dense(texts: list[str]) -> np.ndarray:
    """Length, words, shares of capitals, digits and punctuation, and title features: whether the first
    letter is the only capital, the share of words that begin with one, and whether one word is all there is."""
    b = np.frombuffer(("\n".join(f"{t}  " for t in texts) + "\n").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(b == _SEPARATOR)
    starts = np.append(0, ends[:-1] + 1)
    owner = np.cumsum(b == _SEPARATOR) - (b == _SEPARATOR)
    tally = lambda mask: np.bincount(owner, mask, minlength=len(texts))[: len(texts)]
    upper, lower, digit, space = (b >= 65) & (b <= 90), ((b >= 97) & (b <= 122)) | (b >= 128), (b >= 48) & (b <= 57), b == 32
    n = np.maximum(ends - starts - 2, 1)
    gaps = tally(space) - 2
    out = np.zeros((len(texts), DENSE), np.float32)
    out[:, 0] = 1
    out[:, 1] = np.log1p(n) / 4
    out[:, 2] = np.log1p(gaps + 1) / 2
    out[:, 3] = tally(upper) / n
    out[:, 4] = tally(digit) / n
    out[:, 5] = tally(~(upper | lower | digit | space) & (b != _SEPARATOR)) / n
    if len(texts):
        begins = np.append(True, (space | (b == _SEPARATOR))[:-1])
        out[:, 6] = upper[starts] & (tally(upper) == 1)
        out[:, 7] = gaps == 0
        out[:, 8] = tally(upper & begins) / np.maximum(tally((upper | lower | digit) & begins), 1)
    return out


def margin(weights: np.ndarray, x: Hashed) -> np.ndarray:
    grams = np.bincount(x.text, weights[x.bucket], minlength=len(x.dense)) if len(x.bucket) else np.zeros(len(x.dense))
    return grams[: len(x.dense)] + x.dense @ weights[_SIZE:]


#: Texts and characters that are hashed together, and byte places of one long text.
_TEXTS, _CHARS = 5_000, 400_000


def scores(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Probabilities; texts are taken in blocks of bounded size, and a longer text in pieces, with the same result."""
    z = np.zeros(len(texts))
    block: list[int] = []
    chars = 0
    for i, t in enumerate(texts):
        if len(t) > _CHARS:
            z[i] = _long(weights, t)
            continue
        if len(block) == _TEXTS or (block and chars + len(t) > _CHARS):
            z[block] = margin(weights, hashed([texts[k] for k in block]))
            block, chars = [], 0
        block.append(i)
        chars += len(t)
    if block:
        z[block] = margin(weights, hashed([texts[k] for k in block]))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _long(weights: np.ndarray, text: str) -> float:
    """The margin of a long text: its n-grams by where they begin, piece by piece."""
    data, most = _buffer([text]), max(ORDERS)
    end = len(data) - 1  # without the break at its end
    total = float((_dense([text.replace("\n", " ")]) @ weights[_SIZE:])[0])
    for a in range(0, end, _CHARS):
        piece = data[a : min(a + _CHARS + most - 1, end)]
        for n, buckets in _rolled(piece):
            total += float(weights[buckets[:_CHARS]].sum(dtype=np.float64))
    return total


def train(texts: list[str], labels: np.ndarray, penalty: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights of the penalised logistic loss, classes weighted alike; limited-memory quasi-Newton steps."""
    x = hashed(texts)
    y = labels.astype(np.float64)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(margin(w, x), -30, 30)
        p = 1 / (1 + np.exp(-z))
        value = float((share * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w @ w))
        g = share * (p - y)
        grad = np.concatenate([np.bincount(x.bucket, g[x.text], minlength=_SIZE), x.dense.T @ g]) + penalty * w
        return value, grad

    w = np.zeros(_SIZE + DENSE)
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d, r in reversed(pairs):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * d
        if pairs:
            s, d, _r = pairs[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(np.linalg.norm(grad), 1e-12)
        for (s, d, r), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - r * (d @ q))
        step, slope = 1.0, float(grad @ q)
        if slope <= 1e-9:
            break
        while step > 1e-6:
            new, g = loss(w - step * q)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = -step * q, g - grad
        if s @ d > 1e-12:
            pairs = [*pairs[-7:], (s, d, 1 / (s @ d))]
        done = value - new < 1e-6 * abs(value)
        w, value, grad = w + s, new, g
        if done:
            break
    return w.astype(np.float32)
