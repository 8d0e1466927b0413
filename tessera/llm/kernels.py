"""Vectorised helpers on whole columns of text, used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_SEGMENT = 1 << 20  # positions within a segment take 20 bits
_U = np.uint64


def _class_table(spaces: bytes, words: bytes) -> np.ndarray:
    table = np.full(256, 2, np.uint8)
    table[list(words)] = 1
    table[list(spaces)] = 0
    return table


_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
#: 0 blank, 1 word character, 2 any other byte; a multi-byte character is all 2.
WORD_PUNCT = _class_table(b" \t\n\r\f\v", _DIGITS + _UPPER + _LOWER + b"_")
_ALNUM = np.zeros(256, bool)
_ALNUM[list(_DIGITS + _UPPER + _LOWER)] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(_UPPER + _LOWER)] = True

_rng = np.random.default_rng(20)
_VALUE = _rng.integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1)
_FOLDED = _VALUE.copy()
_FOLDED[list(_UPPER)] = _VALUE[list(_LOWER)]
_BASE = 0x9E3779B97F4A7C15
_SPREAD = _U(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(name: str) -> np.ndarray:
    if not _powers:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(_SEGMENT + 1024, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> _U(32))
    x *= _SPREAD
    x ^= x >> _U(32)
    x *= _SPREAD
    x ^= x >> _U(32)
    return x


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about ``size`` characters together, at least one; several fit a segment with their separators."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) + i - start + 2 > _SEGMENT:
            yield start, i
            start, total = i, 0
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def binary_column(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def token_counts(texts: list[bytes], prompt_end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word-and-punctuation tokens of each text, and how many of them start behind the first ``prompt_end`` (all where there is none)."""
    n, behind = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for a, b in chunks(texts):
        data = np.frombuffer(b"\n" + b"\n".join(texts[a:b]), np.uint8)
        kind = WORD_PUNCT[data]
        starts = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0)) + 1
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        at = np.concatenate([[0], np.searchsorted(starts, ends, "right")])
        n[a:b] = np.diff(at)
        cuts = np.array([max(t.find(prompt_end), 0) for t in texts[a:b]])
        begin = np.concatenate([[0], ends[:-1]]) + 1
        behind[a:b] = at[1:] - np.searchsorted(starts, begin + cuts)
    return n, behind


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hash of each word, text of each word) for chunks of texts.

    Words are maximal runs of ASCII letters and digits, case aside, after each control word (a backslash
    and the letters behind it) has become a blank.
    """
    for a, b in chunks(texts):
        for piece in range(a, b):
            if len(texts[piece]) >= _SEGMENT:
                yield from _long_word_hashes(piece, texts[piece])
        part = [t if len(t) < _SEGMENT else b"" for t in texts[a:b]]
        data = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", np.uint8)
        starts, hashes = _words(data)
        ends = np.cumsum([len(t) + 1 for t in part])
        yield a, hashes, np.searchsorted(ends, starts)


def placed_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, hash, place among its words) of each word, in order."""
    last, before = -1, 0
    for first, hashes, index in word_hashes(texts):
        pos = np.arange(len(index)) - np.searchsorted(index, index, "left")
        if len(index) and len(texts[first]) >= _SEGMENT and index[-1] == 0:  # one of several pieces
            before = before if last == first else 0
            pos, last, before = pos + before, first, before + len(index)
        yield first + index, hashes, pos


def whole_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``placed_words`` with all words of a text in one part, however long the text."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in placed_words(texts):
        long = len(part[0]) and part[0][0] == part[0][-1] and len(texts[part[0][0]]) >= _SEGMENT
        if held and (not long or held[-1][0][0] != part[0][0]):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        if long:
            held.append(part)
        else:
            yield part
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letter = _LETTER[data]
    control = np.flatnonzero(letter[1:] & (data[:-1] == 92)) + 1
    word = _ALNUM[data]
    if len(control):
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        edge = np.zeros(len(data), np.int8)
        edge[control] = 1
        edge[ends[np.searchsorted(ends, control, "right")]] -= 1
        word &= np.cumsum(edge, dtype=np.int8) == 0
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_FOLDED[data] * _power("up")[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * _power("down")[starts])


def _long_word_hashes(index: int, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(text):
        to = min(len(text), at + _SEGMENT // 2)
        while to < len(text) and to - at < _SEGMENT - 8 and (_ALNUM[text[to - 1]] or text[to - 1] == 92):
            to += 1  # cut behind a separator; only a word of half a segment is cut itself
        starts, hashes = _words(np.frombuffer(b"\n" + text[at:to] + b"\n", np.uint8))
        yield index, hashes, np.zeros(len(starts), np.int64)
        at = to


def _values(text: str) -> np.ndarray:
    try:
        return _VALUE[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(points < 256, _VALUE[points & 255], mix(points.astype(np.uint64) + _U(1 << 40)) | _U(1))


def window_hashes(text: str, width: int) -> np.ndarray:
    """A 64-bit hash of each stretch of ``width`` characters; equal stretches have equal hashes anywhere."""
    n = len(text) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.empty(len(text) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_values(text) * _power("up")[: len(text)], out=total[1:])
    out = total[width:] - total[:n]
    out *= _power("down")[:n]
    out ^= out >> _U(32)
    out *= _SPREAD
    out ^= out >> _U(29)
    return out


def _segments(texts: list[str], stretch: int) -> Iterator[tuple[str, list[tuple[int, int, int, int]]]]:
    """Joined text and (text index, place of its first character there, offset in the text, length); pieces of a long text overlap by ``stretch - 1``."""
    for a, b in chunks(texts):
        short = [i for i in range(a, b) if stretch <= len(texts[i]) <= CHUNK]
        placed, at = [], 0
        for i in short:
            placed.append((i, at, 0, len(texts[i])))
            at += len(texts[i])
        if short:
            yield "".join(texts[i] for i in short), placed
        for i in range(a, b):
            if len(texts[i]) > CHUNK:
                for at in range(0, len(texts[i]) - stretch + 1, CHUNK):
                    piece = texts[i][at : at + CHUNK + stretch - 1]
                    yield piece, [(i, 0, at, len(piece))]


def anchors(texts: list[str], stretch: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, low, high, anchor, hash): for each window of ``stretch`` characters, its least inner window of ``width``.

    All windows that start from ``low`` to ``high`` have the same anchor, the leftmost of the least hashes
    in them. It depends on the window's characters alone, so equal windows have equal anchors at equal
    distance, in whichever text they stand. Every window of every text is in exactly one row.
    """
    span = stretch - width + 1
    low_bits = _U(_SEGMENT - 1)
    for text, placed in _segments(texts, stretch):
        hashes = window_hashes(text, width)
        least = (hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        anchor = (least & low_bits).astype(np.int64)
        which = np.array(placed, np.int64)
        first, last = which[:, 1], which[:, 1] + which[:, 3] - stretch
        edge = np.zeros(len(anchor) + 1, np.int8)
        edge[first] += 1
        edge[last + 1] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        change = np.ones(len(anchor), bool)
        change[1:] = anchor[1:] != anchor[:-1]
        change[first] = True
        low = np.flatnonzero(change & valid)
        stop = np.ones(len(anchor), bool)
        stop[:-1] = change[1:]
        stop[last] = True
        high = np.flatnonzero(stop & valid)
        at = np.searchsorted(first, low, "right") - 1
        shift = which[at, 2] - which[at, 1]
        yield which[at, 0], low + shift, high + shift, anchor[low] + shift, hashes[anchor[low]]
