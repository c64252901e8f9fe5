"""Word phrases that documents share with a set of reference texts."""

from __future__ import annotations

import numpy as np

from .suffix import Words

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8; ASCII that is neither letter nor digit separates them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()


class Seeds:
    """Phrases of ``k`` words of reference texts, with the text and the place each comes from."""

    def __init__(self, texts: list[np.ndarray], k: int, words: Words) -> None:
        self.k, self.words = k, words
        found = [words.phrases(t, k) for t in texts]
        phrase = np.concatenate([*found, np.zeros(0, np.uint64)])
        text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        place = np.concatenate([*(np.arange(len(f)) for f in found), np.zeros(0, np.int64)])
        order = np.argsort(phrase, kind="stable")
        self.phrase, self.text, self.place = phrase[order], text[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.phrase & np.uint64(len(self.maybe) - 1)] = True

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, text, place in the text) for each phrase they share."""
        own = self.words.phrases(numbers, self.k)
        at = np.flatnonzero(self.maybe[own & np.uint64(len(self.maybe) - 1)])
        low, high = np.searchsorted(self.phrase, own[at], "left"), np.searchsorted(self.phrase, own[at], "right")
        n = high - low
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.text[which], self.place[which]
