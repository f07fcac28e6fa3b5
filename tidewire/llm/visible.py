"""Visible text of a record: markup removed, one form per look, lower case, words and word pairs."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import numpy as np
import xxhash

from .textforms import transducer

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Odd multipliers that spread the hash of a word pair over 64 bits.
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def visible_text(text: str | None) -> str:
    """What a reader sees of ``text``; null gives the empty text.

    Hidden elements go, inline tags go without a gap, other tags leave a blank; entities are
    resolved after the tags, so an escaped ``&lt;p&gt;`` stays readable text.
    """
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _HIDDEN.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    return transducer().apply(text)


def words(*parts: str | None) -> list[str]:
    """Lower-case runs of letters and digits over the parts, joined by a blank."""
    return _WORD.findall(" ".join(visible_text(p) for p in parts).lower())


class _WordHashes(dict):
    """Word to 64-bit hash, remembered for the few hundred thousand words a worker meets."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_HASH = _WordHashes()


def word_hashes(tokens: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b), elementwise."""
    x = a * _MIX_A + (b ^ (b >> np.uint64(29))) * _MIX_B
    x ^= x >> np.uint64(32)
    x *= _MIX_A
    return x ^ (x >> np.uint64(29))


def word_pair_hashes(tokens: Sequence[str]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct two-word sequences; one word alone has none."""
    w = word_hashes(tokens)
    if len(w) < 2:
        return np.empty(0, np.uint64)
    pairs = mix(w[:-1], w[1:])
    pairs.sort()
    return pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]


def parity_map(keys: np.ndarray, longs: int = 3) -> np.ndarray:
    """``longs`` 64-bit words whose bits are the parities of the keys' places.

    Two sets whose maps differ in d bits differ in at least d elements: an exact lower bound for
    the symmetric difference that costs one xor to evaluate.
    """
    odd = np.bincount((keys % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
