"""Tokens of whole Arrow batches, found with numpy and no loop over rows.

A token is what a regular expression of an ASCII start, ASCII letters, digits,
underscores and hyphens between two word boundaries finds, as in
`vellum.functions.text`; word characters are Unicode letters, digits and
underscore.  Within a run of token characters there is at most one such match:
it begins at the first boundary with a start character and ends at the run's
last boundary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_POINTS = 0x110000


@lru_cache(maxsize=1)
def word_points() -> np.ndarray:
    """Which code points are word characters."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(_POINTS)), dtype=bool, count=_POINTS)


@lru_cache(maxsize=1)
def space_points() -> np.ndarray:
    """Which code points are white space."""
    out = np.zeros(_POINTS, dtype=bool)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return out


def _ascii(*ranges: str) -> np.ndarray:
    out = np.zeros(_POINTS, dtype=bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _ascii("az", "AZ", "09", "_", "-"), _ascii("az", "AZ"), _ascii("az", "AZ", "09")


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a column, each row followed by a zero, and where rows begin."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    none, end = (pa.scalar(x, pa.large_string()) for x in ("", "\0"))
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), none), end, none)
    size = pc.utf8_length(texts).to_numpy()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(texts) else b""
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


@dataclass
class Tokens:
    """Lower-cased tokens of a batch: `word[i]` numbers the i-th one's text in `words`."""

    start: np.ndarray
    row: np.ndarray
    word: np.ndarray
    words: pa.Array


def tokens_of(points: np.ndarray, first: np.ndarray, keywords: bool) -> Tokens:
    """Tokens of a batch; keywords begin with a letter and have three characters or more."""
    inside, letter, either = _classes()
    shown = word_points()[points]
    bound = np.zeros(len(points) + 1, dtype=bool)
    bound[1:-1] = shown[1:] != shown[:-1]
    if len(points):
        bound[0] = shown[0]
    part = inside[points]
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    edge = np.concatenate([[0] if len(part) and part[0] else [], edge]).astype(np.int64)
    begin, end = edge[::2], edge[1::2]  # each row ends with a zero, so each run ends
    opening = np.flatnonzero((letter if keywords else either)[points] & bound[:-1])
    closing = np.flatnonzero(bound)
    i = np.searchsorted(opening, begin)
    start = np.where(i < len(opening), opening[np.minimum(i, len(opening) - 1)], len(points)) if len(opening) else np.full(len(begin), len(points))
    stop = closing[np.maximum(np.searchsorted(closing, end, side="right") - 1, 0)] if len(closing) else begin
    good = stop - start >= (3 if keywords else 1)
    start, stop = start[good], stop[good]
    size = stop - start
    cuts = np.concatenate([[0], np.cumsum(size)])
    letters = points[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)].astype(np.uint8)
    letters[(letters >= 65) & (letters <= 90)] += 32
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(letters)])
    coded = pc.dictionary_encode(found)
    return Tokens(start, np.searchsorted(first, start, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def counted(row: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count, first place) of each word of each row, in that order."""
    code = row * max(n_words, 1) + word
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(code)))
    return row[order[new]], word[order[new]], count, order[new]


_SHIFT = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, dtype=np.uint32)
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)


def md5_words(texts: pa.Array) -> np.ndarray:
    """(n, 2) first two 32-bit words, little-endian, of the MD5 of each string."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    out = np.zeros((n, 2), dtype=np.uint32)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    for blocks in np.unique((size + 8) // 64 + 1):
        mine = np.flatnonzero((size + 8) // 64 + 1 == blocks)
        for at in range(0, len(mine), 8192):
            rows = mine[at : at + 8192]
            out[rows] = _md5(raw, offsets[rows], size[rows], int(blocks))
    return out


def _md5(raw: np.ndarray, start: np.ndarray, size: np.ndarray, blocks: int) -> np.ndarray:
    padded = np.zeros((len(start), blocks * 64), dtype=np.uint8)
    row = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    padded[row, place] = raw[np.repeat(start, size) + place]
    padded[np.arange(len(start)), size] = 128
    padded[:, -8:] = (size * 8).astype("<u8")[:, None].view(np.uint8)
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(len(start), v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for block in range(blocks):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = (b & c) | (~b & d), i
            elif i < 32:
                f, g = (d & b) | (~d & c), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), (7 * i) % 16
            f = f + a + _SINE[i] + words[block * 16 + g]
            a, d, c, b = d, c, b, b + ((f << _SHIFT[i]) | (f >> (np.uint32(32) - _SHIFT[i])))
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return np.stack(state[:2], axis=1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def space_bytes(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, beyond ASCII too."""
    out = _SPACE[raw]
    for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(raw == lead)
        at = at[at + width <= len(raw)]
        if not len(at):
            continue
        point = (raw[at].astype(np.int64) & (0x1F if width == 2 else 0x0F)) << 6 * (width - 1)
        for i in range(1, width):
            point |= (raw[at + i].astype(np.int64) & 0x3F) << 6 * (width - 1 - i)
        at = at[space_points()[point]]
        for i in range(width):
            out[at + i] = True
    return out


def row_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and where rows begin; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(size: np.ndarray) -> np.ndarray:
    """0..size[0]-1, 0..size[1]-1 and so on."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def windows(texts: pa.Array, whole_up_to: int, win: int, back: int) -> pa.Array:
    """Overlapping windows of the words of each text, as lists of strings.

    Texts of at most `whole_up_to` words stay whole, stripped; those without words
    have no window.  Windows of `win` words follow one another every `win - back`
    words, and each after the first begins with the last `back` words before its
    predecessor's end and an empty line.
    """
    raw, offsets = row_bytes(texts)
    shown = ~space_bytes(raw)
    begins, ends = shown.copy(), shown.copy()
    begins[1:] &= ~shown[:-1]
    ends[:-1] &= ~shown[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] |= shown[inner]
    ends[inner - 1] |= shown[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    n = np.diff(first)
    # All words with single spaces between them, after the text itself; an empty
    # line comes last.
    size = end - start
    at = len(raw) + np.cumsum(size + 1) - size - 1
    spaced = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    spaced[np.repeat(at - len(raw), size) + ranges(size)] = raw[np.repeat(start, size) + ranges(size)]
    source = np.concatenate([raw, spaced, np.array([10, 10], dtype=np.uint8)])
    step = max(1, win - back)
    count = np.where(n == 0, 0, np.where(n <= whole_up_to, 1, 1 + -(-np.maximum(n - win, 0) // step)))
    row, i = np.repeat(np.arange(len(n)), count), ranges(count)
    whole = n[row] <= whole_up_to
    a = first[row] + i * step
    b = np.minimum(a + win, first[row + 1])
    last = np.maximum(first[row + 1] - 1, 0)
    if not len(row):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1, np.int32)), pa.array([], pa.string()))
    tail = ~whole & (i > 0) & (back > 0)
    head = np.where(tail, a - step + win - back, 0)
    # Up to three parts a window: the tail, the empty line, the words.
    begin = np.stack([np.where(tail, at[head], 0), np.full(len(row), len(source) - 2), np.where(whole, start[np.minimum(first[row], last)], at[np.minimum(a, last)])], axis=1)
    stop = np.stack([np.where(tail, at[np.where(tail, head + back - 1, 0)] + size[np.where(tail, head + back - 1, 0)], 0), begin[:, 1] + 2 * tail, np.where(whole, end[last], at[b - 1] + size[b - 1])], axis=1)
    length = (stop - begin).ravel()
    out = source[np.repeat(begin.ravel(), length) + ranges(length)]
    cuts = np.concatenate([[0], np.cumsum((stop - begin).sum(axis=1))])
    strings = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), strings.cast(pa.string()))


def slices(texts: pa.Array, chars: int = 1 << 20) -> list[pa.Array]:
    """A column in parts of about that many bytes, so that temporaries stay small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    part = np.cumsum(size) // chars
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(size)]]) if len(size) else np.array([0, 0])
    return [texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
