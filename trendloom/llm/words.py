"""Words of a text as byte strings, and hashes of word windows as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NORMAL_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)

#: Bytes that end a word of a normalised text: ASCII but for digits and lower-case letters.
_PLAIN = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))


def space_words(data: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, as they stand. None has no words."""
    return data.split() if data else []


def normal_words(data: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and any character beyond ASCII, A-Z lower-cased."""
    return data.lower().translate(_PLAIN).split() if data else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left ^ (left >> _SHIFT)
    mixed *= _A
    mixed += right * _B
    return mixed


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` entries from each place on; equal windows have equal hashes.

    Windows of 1, 2, 4 ... entries are put together from two of half the
    length, and `size` from those that its binary digits name.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return hashes[:0]
    whole, at, width, part = None, 0, 1, hashes
    while True:
        if size & width:
            piece = part[at:at + count]
            whole = piece if whole is None else _joined(whole, piece)
            at += width
        width *= 2
        if width > size:
            return whole * _B ^ whole >> _SHIFT
        part = _joined(part[:len(part) - width // 2], part[width // 2:])


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Least of the `size` values from each place on."""
    width, least = 1, values
    while width * 2 <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def cut_words(data: bytes, gone: np.ndarray, word: re.Pattern) -> bytes:
    """The text without the words marked in `gone`; the white space after a cut word goes with it."""
    kept, at = [], 0
    for match, cut in zip(word.finditer(data), gone.tolist(), strict=True):
        if cut:
            kept.append(data[at:match.start()])
            at = match.end()
            while at < len(data) and data[at] in b" \t\n\r\x0b\x0c":
                at += 1
    kept.append(data[at:])
    return b"".join(kept)


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of `n` words lie in a window; `lengths` is one number or one for each start."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0
