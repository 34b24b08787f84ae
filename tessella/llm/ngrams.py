"""Counts of hashed character n-grams of whole texts, with numpy over bytes."""

from __future__ import annotations

import numpy as np

#: Bytes that are looked at together, so that a very long text takes no more memory than this many n-grams.
CHUNK = 1 << 20


def letter_classes() -> np.ndarray:
    """Classes of bytes that tell languages apart: each ASCII letter in either case, each byte of other scripts, and one class for the rest."""
    out = np.zeros(256, np.uint32)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    out[128:] = 27 + np.arange(128)
    return out


def shape_classes() -> np.ndarray:
    """Classes of bytes that tell styles apart: vowels, other small letters, capitals, digits, space, line end, and ASCII punctuation in groups."""
    out = np.full(256, 15, np.uint32)
    for c in range(256):
        ch = chr(c)
        if ch in "aeiou" or c >= 128:
            out[c] = 0
        elif "a" <= ch <= "z":
            out[c] = 1
        elif "A" <= ch <= "Z":
            out[c] = 2
        elif "0" <= ch <= "9":
            out[c] = 3
        elif ch == "\n":
            out[c] = 5
        elif ch in " \t\r\x0b\x0c":
            out[c] = 4
    for i, group in enumerate((".", ",", "!", "?", "|", "*%&", "#$", "<>{}[]()", "'\"-:;")):
        for ch in group:
            out[ord(ch)] = 6 + i
    return out


def trigram_counts(text: str | None, classes: np.ndarray, buckets: int, dense: int = 0) -> np.ndarray:
    """How often each bucket of hashed byte trigrams comes up in text. dense: number of classes, if trigrams are to be numbered outright instead of hashed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(buckets, np.int64)
    for at in range(0, max(len(data) - 2, 0), CHUNK):
        c = classes[np.frombuffer(data, np.uint8, min(CHUNK + 2, len(data) - at), at)]
        if dense:
            key = (c[:-2] * dense + c[1:-1]) * dense + c[2:]
        else:
            key = ((c[:-2] * np.uint32(65_536) + c[1:-1] * np.uint32(256) + c[2:]) * np.uint32(2_654_435_761)) >> np.uint32(32 - buckets.bit_length() + 1)
        out += np.bincount(key, minlength=buckets)
    return out
