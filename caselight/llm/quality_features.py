"""Numbers that describe a text, for the quality classifier. No label, language, source or id."""

from __future__ import annotations

import numpy as np

#: ASCII characters with a class of their own.
_SINGLE = b"#*$%&|<>!?@^~_=+/\\{}[]();:\"'`-.,"
_CLASS = np.zeros(256, np.int64)  # 0: anything else
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
_CLASS[list(_SINGLE)] = np.arange(7, 7 + len(_SINGLE))
_CLASSES = 7 + len(_SINGLE)
_SIZE = _CLASSES + 10
#: Features are multiples of this, so that sums of their products are exact in any order.
STEP = 2.0**-12


def _shares(text: bytes) -> np.ndarray:
    out = np.zeros(_SIZE)
    words = text.split()
    if not words:
        return out
    out[:_CLASSES] = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_CLASSES) / len(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    out[_CLASSES:] = (
        len(set(words)) / n,
        same / n,
        1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:]))) / max(1, n - 1),
        min(2.0, lengths.mean() / 20),
        min(1.0, lengths.max() / 100),
        np.log1p(n) / 12,
        np.log1p(len(lines)) / 8,
        (lengths == 1).mean(),
        1 / n,
    )
    return out


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row per text: a constant; shares of character classes, repetition, lengths of words,
    number of words and lines; and the square roots of these. An empty, blank or null text has
    the constant only."""
    shares = np.array([_shares(t or b"") for t in texts]).reshape(len(texts), _SIZE)
    out = np.concatenate([np.ones((len(texts), 1)), shares, np.sqrt(shares)], axis=1)
    return np.round(out / STEP) * STEP


N_FEATURES = 1 + 2 * _SIZE
