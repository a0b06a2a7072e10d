"""Lossless WebP in numpy: a decoder for whole VP8L streams and an encoder that media columns are stored with.

The decoder reads prefix codes, meta prefix images, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. One loop reads every image: a token takes one
window of the stream, and codes are tables over its lowest bits. Stored files hold four payload bytes in a pixel
(red, green, blue, alpha, as readers give them out), with Huffman codes, back-references, a colour cache where it
pays and the transform that promises the fewest bits.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np

# Fixed values of the format: transform types, order of code-length codes, nearby pixels of short distances.
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE, ROW = 16384, 64
#: Bytes of a stream that are looked at at once; the least length of a back-reference in stored files, the farthest,
#: the most bits of their caches; bytes that one file takes at most; bytes of payloads that are stored together; rows that
#: the choice of transforms looks at.
STRETCH, LEAST, FAR, CACHE, FILE, TOGETHER, SAMPLE = 1 << 17, 3, (1 << 20) - 120, 7, 1 << 23, 1 << 19, 16
#: The code that stored files write code lengths with, by symbol: lengths of 5 to 7, no length and runs of none are the
#: most frequent. Stored lengths are 13 at most, and repeats (16) are not used.
META = np.array([3, 7, 7, 5, 4, 3, 3, 3, 4, 4, 5, 5, 7, 7, 0, 0, 0, 3, 4])
#: Table entries are a symbol's value above 6 bits of code length. Values of a pixel's channels lie where the
#: channels do, so that four entries add up to a pixel; green symbols from 256 on are marked by MARK.
MARK = 1 << 40
_GREEN = np.concatenate((np.arange(256) << 14, (MARK + np.arange(24 + 2048)) << 6))
_RED, _BLUE, _ALPHA, _PLAIN = (np.arange(256) << k for k in (22, 6, 30, 6))


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end, self.words, self.base = data, 0, len(data) * 8, [], 0

    def bits(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        x = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return x

    def same(self, began: int, ended: int) -> bool:
        """Whether the next bits are those of an earlier stretch."""
        n = ended - began
        if self.at + n > self.end:
            return False
        cut = lambda at: int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)
        return cut(began) == cut(self.at)

    def view(self, ahead: int = 0) -> tuple[list[int], int]:
        """(windows, their first byte) from here on: the next 64 bits at each byte of a stretch, for so many bytes or to the end."""
        first = self.at >> 3
        upto = min(first + ahead, len(self.data))
        if not self.base <= first < self.base + len(self.words) or self.base + len(self.words) < upto:
            self.words, self.base = _windows(self.data, first, False), first
        return self.words, self.base


class Writer:
    """Values and how many bits each takes, in the order of the stream, the lowest bit first."""

    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, x: int, n: int) -> None:
        while n > 24:
            self.put(x & 0xFFFFFF, 24)
            x, n = x >> 24, n - 24
        self.values.append(np.array([x]))
        self.sizes.append(np.array([n]))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.values).astype(np.int64), np.concatenate(self.sizes).astype(np.int64)

    def bytes(self) -> bytes:
        values, sizes = self.tokens()
        return packed_bits(values, sizes)[: int(sizes.sum() + 7) // 8]


def packed_bits(values: np.ndarray, sizes: np.ndarray, fresh: np.ndarray | None = None) -> bytes:
    """Values of at most 24 bits one after another, those at the places fresh from a new word of 32 on; zeros fill the last."""
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    if fresh is not None and len(fresh):
        stop = np.append(fresh, len(sizes))
        length = np.diff(np.append(at[fresh], at[-1] + sizes[-1]), prepend=0)
        gaps = np.cumsum(-length[:-1] % 32) if len(length) > 1 else np.zeros(0, np.int64)
        at += np.repeat(np.concatenate(([0], gaps)), np.diff(stop, prepend=0))
    word = at >> 5
    # values do not overlap, so the sum of those that begin in a word is all of them; what runs over is carried
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(values.astype(np.uint64) << (at & 31).astype(np.uint64), first)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = sums & np.uint64(0xFFFFFFFF)
    out[word[first] + 1] |= sums >> np.uint64(32)
    return out.astype("<u4").tobytes()


@lru_cache(maxsize=16)
def _turned(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in the opposite order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


def lookup(lengths: np.ndarray, *values: np.ndarray) -> tuple[int, list[list[int]]]:
    """(mask, tables): what the next bits of a stream stand for, once for each list of values."""
    used = np.flatnonzero(lengths)
    n = lengths[used].astype(np.int64)
    if len(used) <= 1:
        return 0, [[int(v[used[0]]) if len(used) else 0] for v in values]
    order = np.argsort(n, kind="stable")
    used, n = used[order], n[order]
    most = int(n[-1])
    many = 1 << (most - n)
    if many.sum() != 1 << most:
        raise ValueError("a prefix code is not complete")
    at = np.repeat(np.arange(len(used)), many)[_turned(most)]
    # a table repeats its symbols' numbers, so each is made once
    return (1 << most) - 1, [(v[used] + n).astype(object)[at].tolist() for v in values]


@lru_cache(maxsize=256)
def _meta_lookup(lengths: tuple) -> tuple[int, list[int]]:
    """The table of the code that code lengths are written with, from its lengths in their order."""
    meta = np.zeros(19, np.int64)
    meta[list(LENGTH_ORDER[: len(lengths)])] = lengths
    if not meta.any():
        raise ValueError("a prefix code is not complete")
    mask, tables = lookup(meta, _PLAIN[:19])
    return mask, tables[0]


def read_lengths(r: Reader, size: int) -> np.ndarray:
    """Code lengths of a prefix code."""
    lengths = bytearray(size)
    if r.bits(1):
        two = r.bits(1)
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return np.frombuffer(lengths, np.uint8)
    n = 4 + r.bits(4)
    x = r.bits(3 * n)
    mask, table = _meta_lookup(tuple(x >> 3 * k & 7 for k in range(n)))
    left = size
    if r.bits(1):
        left = 2 + r.bits(2 + 2 * r.bits(3))
    # a length takes 14 bits at most
    words, base = r.view(2 * size + 8)
    s, prev, at = 0, 8, r.at - base * 8
    while s < size and left:
        left -= 1
        w = words[at >> 3] >> (at & 7)
        e = table[w & mask]
        x = e >> 6
        at += e & 63
        if x < 16:
            lengths[s] = x
            prev = x or prev
            s += 1
            continue
        w >>= e & 63
        if x == 16:
            again = 3 + (w & 3)
            at += 2
        elif x == 17:
            again = 3 + (w & 7)
            at += 3
        else:
            again = 11 + (w & 127)
            at += 7
        if s + again > size:
            raise ValueError("code lengths run over")
        if x == 16:
            lengths[s : s + again] = bytes([prev]) * again
        s += again
    r.at = at + base * 8
    if r.at > r.end:
        raise ValueError("the stream ends early")
    return np.frombuffer(lengths, np.uint8)


@lru_cache(maxsize=64)
def _near_places(width: int) -> list[int]:
    return [max(dx + dy * width, 1) for dx, dy in NEAR]


def _windows(data: bytes, first: int, twice: bool) -> list[int]:
    """The next 64 (or 128) bits at each byte of a stretch."""
    raw = data[first : first + STRETCH + 16]
    raw += bytes(32)
    n = min(STRETCH, len(raw) - 16)
    low = np.ndarray((n + 8,), "<u8", raw, strides=(1,))
    if not twice:
        return low[:n].tolist()
    return [a | b << 64 for a, b in zip(low[:n].tolist(), low[8:].tolist(), strict=True)]


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB, height x width."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile, tiles = 1, 0, None
    if main and r.bits(1):
        tile = r.bits(3) + 2
        tiles = read_image(r, -(-width >> tile), -(-height >> tile), False) >> 8 & 0xFFFF
        groups = int(tiles.max()) + 1
    n_green = 280 + (1 << cache_bits if cache_bits else 0)
    books, most = [], 0
    for _ in range(groups):
        gm, (gt,) = lookup(read_lengths(r, n_green), _GREEN)
        began, ended, masks, tables = r.at, r.at, [], []
        while len(masks) < 3:
            if ended > began and r.same(began, ended):
                # codes of the same bits are the same: channels of a text often share one
                r.at += ended - began
            else:
                began, lengths = r.at, read_lengths(r, 256)
                ended, (mask, three) = r.at, lookup(lengths, _RED, _BLUE, _ALPHA)
            tables.append(three[len(masks)])
            masks.append(mask)
        dm, (dt,) = lookup(read_lengths(r, 40), _PLAIN)
        books.append([x for pair in zip((gm, *masks, dm), (gt, *tables, dt), strict=True) for x in pair])
        deep = [x.bit_length() for x in (gm, *masks, dm)]
        most = max(most, sum(deep[:4]), deep[0] + deep[4] + 28)
    total = width * height
    first = books[0]
    if tiles is None and not any(first[k] for k in (0, 2, 4, 6)) and first[1][0] < MARK:
        # one pixel value, no bits
        return np.full((height, width), sum(first[k][0] for k in (1, 3, 5, 7)) >> 6, np.uint32)
    near = _near_places(width)
    cache, shift, literal, slots = [0] * (1 << cache_bits), 32 - cache_bits, MARK << 6, (MARK + 24) << 6
    out: list[int] = []
    push, n, at = out.append, 0, r.at
    gm, gt, rm, rt, bm, bt, am, alphas, dm, dt = first
    while n < total:
        if at >= r.end and any(b[k] for b in books for k in (0, 2, 4, 6)):
            raise ValueError("the stream ends early")
        r.at = at
        words, base = r.view() if most <= 57 else (_windows(r.data, at >> 3, True), at >> 3)
        p, stop = at - base * 8, len(words) * 8
        while n < total and p < stop:
            upto = total
            if tiles is not None:
                y, x = divmod(n, width)
                gm, gt, rm, rt, bm, bt, am, alphas, dm, dt = books[tiles[y >> tile, x >> tile]]
                upto = y * width + min(((x >> tile) + 1) << tile, width)
            # so many tokens certainly stay within the pixels and the windows; a copy starts the count anew
            while n < upto and p < stop:
                for _ in repeat(None, min(upto - n, (stop - p - 1) // 60 + 1)):
                    w = words[p >> 3] >> (p & 7)
                    e = gt[w & gm]
                    if e < literal:
                        w >>= e & 63
                        f = rt[w & rm]
                        w >>= f & 63
                        g = bt[w & bm]
                        e += f + g + alphas[w >> (g & 63) & am]
                        p += e & 63
                        e >>= 6
                        push(e)
                        if cache_bits:
                            cache[(e * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = e
                    elif e >= slots:
                        # the pixel is where the cache has it already
                        push(cache[(e - slots) >> 6])
                        p += e & 63
                    else:
                        n = len(out)
                        k = (e >> 6) - MARK
                        w >>= e & 63
                        p += e & 63
                        length = k + 1
                        if k > 3:
                            x = (k - 2) >> 1
                            length = ((2 + (k & 1)) << x) + (w & ((1 << x) - 1)) + 1
                            w >>= x
                            p += x
                        k = dt[w & dm]
                        w >>= k & 63
                        p += k & 63
                        k >>= 6
                        far = k + 1
                        if k > 3:
                            x = (k - 2) >> 1
                            far = ((2 + (k & 1)) << x) + (w & ((1 << x) - 1)) + 1
                            p += x
                        far = far - 120 if far > 120 else near[far - 1]
                        if far > n or n + length > total:
                            raise ValueError("a back-reference leaves the image")
                        part = out[n - far : n - far + length] if far >= length else (out[n - far :] * (length // far + 1))[:length]
                        out += part
                        n += length
                        if cache_bits:
                            for e in part:
                                cache[(e * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = e
                        break
                else:
                    n = len(out)
        at = base * 8 + p
    if at > r.end:
        raise ValueError("the stream ends early")
    r.at = at
    return np.frombuffer(array("I", out), np.uint32).reshape(height, width)


def _planes(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _packed(planes: np.ndarray) -> np.ndarray:
    p = (planes & 255).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The pixels that one of 14 modes predicts, from neighbours with four channels last."""
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0]), top.shape)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return ((left + top_right >> 1) + top) >> 1
    if mode <= 9:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return ((left + top_left >> 1) + (top + top_right >> 1)) >> 1
    if mode == 11:
        to_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    half = left + top >> 1
    step = half - top_left
    return np.clip(half + np.sign(step) * (np.abs(step) >> 1), 0, 255)


def _residuals(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Pixels less what the modes of their tiles predict."""
    h, w = argb.shape
    p = _planes(argb)
    left, top = np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], top[1:] = p[:, :-1], p[:-1]
    top_left = np.zeros_like(p)
    top_left[1:, 1:] = p[:-1, :-1]
    top_right = np.zeros_like(p)
    # the pixel right of the row's end is the first of the current row
    top_right[1:, :-1], top_right[1:, -1] = p[:-1, 1:], p[1:, 0]
    of = modes[np.arange(h)[:, None] >> tile, np.arange(w)[None] >> tile]
    guess = np.zeros_like(p)
    for mode in np.unique(of).tolist():
        here = of == mode
        guess[here] = _predict(mode, *(x[here] for x in (left, top, top_left, top_right)))
    guess[0], guess[:, 0] = left[0], top[:, 0]
    guess[0, 0] = 255, 0, 0, 0
    return _packed(p - guess)


#: Modes that need no pixel of the current row.
_ABOVE = {0, 2, 3, 4, 8, 9}


def _restored(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Inverts _residuals(): whole rows at once where a row's modes look up only, or left only; else pixel by pixel."""
    h, w = argb.shape
    p = _planes(argb)
    p[0, 0, 0] += 255
    p[0] = np.cumsum(p[0], axis=0) & 255
    p[1:, 0] = np.cumsum(p[:, 0], axis=0)[1:] & 255
    for y in range(1, h):
        row = modes[y >> tile]
        kinds = set(row.tolist())
        up, now = p[y - 1], p[y]
        if kinds == {1}:
            p[y] = np.cumsum(now, axis=0) & 255
        elif kinds <= _ABOVE:
            right = np.concatenate((up[2:], now[:1])) if w > 1 else up[:0]
            of = row[np.arange(1, w) >> tile]
            for mode in kinds:
                here = of == mode
                now[1:][here] += _predict(mode, up[1:][here], up[1:][here], up[:-1][here], right[here])
            now &= 255
        else:
            for x in range(1, w):
                guess = _predict(int(row[x >> tile]), now[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < w else now[0])
                now[x] = now[x] + guess & 255
    return _packed(p)


def _through_cross(argb: np.ndarray, elements: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    h, w = argb.shape
    p = _planes(argb)
    e = elements[np.arange(h)[:, None] >> tile, np.arange(w)[None] >> tile]
    signed = lambda x: ((x & 255) ^ 128) - 128
    green_red, green_blue, red_blue = (signed(e.astype(np.int64) >> s) for s in (0, 8, 16))
    delta = lambda t, c: t * signed(c) >> 5
    red, green, blue = p[..., 1], p[..., 2], p[..., 3]
    if inverse:
        red = red + delta(green_red, green) & 255
        blue = blue + delta(green_blue, green) + delta(red_blue, red) & 255
    else:
        blue = blue - delta(green_blue, green) - delta(red_blue, red) & 255
        red = red - delta(green_red, green) & 255
    return _packed(np.stack([p[..., 0], red, green, blue], -1))


def _through_green(argb: np.ndarray, sign: int) -> np.ndarray:
    p = _planes(argb)
    p[..., 1] += sign * p[..., 2]
    p[..., 3] += sign * p[..., 2]
    return _packed(p)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as uint32 ARGB, height x width."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a simple lossless WebP file")
    r = Reader(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if r.bits(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, seen, wide = [], set(), width
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            tile = r.bits(3) + 2
            undo.append((kind, tile, read_image(r, -(-wide >> tile), -(-height >> tile), False), wide))
        elif kind == GREEN:
            undo.append((kind, 0, None, wide))
        else:
            size = r.bits(8) + 1
            table = _packed(np.cumsum(_planes(read_image(r, size, 1, False)), axis=1))[0]
            undo.append((kind, _palette_bits(size), table, wide))
            wide = -(-wide >> _palette_bits(size))
    argb = read_image(r, wide, height, True)
    for kind, n, x, wide in reversed(undo):
        if kind == PREDICTOR:
            argb = _restored(argb, (x >> 8 & 15).astype(np.int64), n)
        elif kind == CROSS:
            argb = _through_cross(argb, x, n, True)
        elif kind == GREEN:
            argb = _through_green(argb, 1)
        else:
            index = argb >> np.uint32(8) & np.uint32(255)
            if n:
                each = 8 >> n
                index = (index[..., None] >> (np.arange(1 << n) * each).astype(np.uint32) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :wide]
            full = np.zeros(256, np.uint32)
            full[: len(x)] = x
            argb = full[index]
    return argb


# --- writing ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths of the symbols of each row, of 13 bits at most; complete codes, but 1 for a symbol that is alone.

    A symbol first takes as many bits as its share asks for, rounded up; what that leaves of the code's room then
    shortens symbols by one bit at a time, the frequent ones first, until nothing is left.
    """
    out = np.zeros(counts.shape, np.int64)
    many = (counts > 0).sum(axis=1)
    out[(counts > 0) & (many == 1)[:, None]] = 1
    rows = np.flatnonzero(many > 1)
    if not len(rows):
        return out
    c = counts[rows].astype(np.float64)
    order = np.argsort(-c, axis=1, kind="stable")[:, : int(many.max())]
    c = np.take_along_axis(c, order, 1)
    used = c > 0
    c = np.where(used, np.maximum(c, c.sum(axis=1, keepdims=True) / 2048), 0)
    share = np.divide(c.sum(axis=1, keepdims=True), c, out=np.ones_like(c), where=used)
    n = np.ascontiguousarray(np.clip(np.ceil(np.log2(share)), 1, 13).astype(np.int64).T)
    used = np.ascontiguousarray(used.T)
    room = 8192 - np.where(used, 8192 >> n, 0).sum(axis=0)
    open_ = np.flatnonzero(room > 0)
    while len(open_):
        m, u, left = n[:, open_], used[:, open_], room[open_]
        for k in range(len(m)):
            cost = 8192 >> m[k]
            less = u[k] & (cost <= left)
            m[k] -= less
            left -= cost * less
        n[:, open_], room[open_] = m, left
        open_ = open_[left > 0]
    sorted_lengths = np.zeros(order.shape, np.int64)
    sorted_lengths[:] = np.where(used, n, 0).T
    part = np.zeros((len(rows), counts.shape[1]), np.int64)
    np.put_along_axis(part, order, sorted_lengths, 1)
    out[rows] = part
    return out


def codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many) by row and symbol, as written; none for a symbol that is alone."""
    bits, size = np.zeros(lengths.shape, np.int32), lengths.astype(np.int32)
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.argsort((row << 4 | n) << 12 | symbol, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    leaves = 1 << (15 - n)
    before = np.cumsum(leaves) - leaves
    first = np.flatnonzero(np.diff(row, prepend=-1))
    before -= np.repeat(before[first], np.diff(np.append(first, len(row))))
    # a code's first leaf at full depth, turned, is the code turned
    bits[row, symbol] = _turned(15)[before]
    alone = (lengths > 0).sum(axis=1) == 1
    bits[alone], size[alone] = 0, 0
    return bits, size


def length_tokens(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) that write each row's code lengths, of so many symbols."""
    used = lengths > 0
    many, symbols = used.sum(axis=1), np.arange(lengths.shape[1])
    first = np.where(many > 0, used.argmax(axis=1), 0)
    last = np.where(many > 0, len(symbols) - 1 - used[:, ::-1].argmax(axis=1), 0)
    short = (many <= 2) & (last < 256)
    rows, values, bits = [], [], []

    def add(r: np.ndarray, v: np.ndarray | int, n: np.ndarray | int) -> None:
        rows.append(r)
        values.append(np.broadcast_to(v, r.shape))
        bits.append(np.broadcast_to(n, r.shape))

    r = np.flatnonzero(short)
    few = first[r] < 2
    add(r, 1 | (many[r] == 2) << 1 | ~few << 2, 3)
    add(r, first[r], np.where(few, 1, 8))
    r = np.flatnonzero(short & (many == 2))
    add(r, last[r], 8)
    # the head: that it is a normal code, how many lengths of the code for lengths, these, that all symbols follow
    r = np.flatnonzero(~short)
    head, at = 0 | 15 << 1, 5
    for k in LENGTH_ORDER:
        head, at = head | int(META[k]) << at, at + 3
    for k in range(0, at + 1, 21):
        add(r, head >> k & 0x1FFFFF, min(21, at + 1 - k))
    if len(r):
        # runs of equal lengths, row by row: lengths one by one, none in runs of up to 138
        inside = symbols < sizes[r, None]
        flat, of = lengths[r][inside], np.repeat(r, sizes[r])
        start = np.flatnonzero((np.diff(flat, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0) | (flat > 0))
        run = np.diff(np.append(start, len(flat)))
        zero = flat[start] == 0
        rest = run % 138
        pieces = np.where(zero, run // 138 + np.where(rest >= 3, 1, rest), 1)
        which = np.repeat(np.arange(len(start)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n = np.where(k < run[which] // 138, 138, np.where(rest[which] >= 3, rest[which], 1))
        symbol = np.where(zero[which], np.where(n >= 11, 18, np.where(n >= 3, 17, 0)), flat[start][which])
        code, size = (x[0] for x in codes(META[None]))
        extra, more = np.where(n >= 11, n - 11, n - 3), np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
        add(of[start][which], code[symbol] | np.where(more > 0, extra << size[symbol], 0), size[symbol] + more)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(values)[order], np.concatenate(bits)[order]


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as (symbol, extra value, extra bits)."""
    x = v - 1
    less = np.maximum(np.frexp(np.maximum(x, 1).astype(np.float64))[1].astype(np.int64) - 2, 0)
    second = x >> less & 1
    short = v <= 4
    return np.where(short, x, 2 * less + 2 + second), np.where(short, 0, x - ((2 + second) << less)), np.where(short, 0, less)


@lru_cache(maxsize=64)
def _near_codes(width: int) -> np.ndarray:
    """Distance codes of short distances, 0 where there is none."""
    near = {max(dx + dy * width, 1): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}
    out = np.zeros(max(near) + 1, np.int64)
    out[list(near)] = list(near.values())
    return out


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of keys, then of places, and whether a place's key is that of the one before it.

    There are fewer than 2**24 places. Keys lose their upper 24 bits, whatever else is coded with an image: unequal ones
    may then pass as equal, which callers see by the pixels.
    """
    both = np.sort(key << np.uint64(24) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64(0xFFFFFF)).astype(np.int64), both[1:] >> np.uint64(24) == both[:-1] >> np.uint64(24)


def _copies(pix: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(place, length, distance) of back-references within images that end at ends, greedily: to the latest place with
    the same LEAST pixels."""
    n, none = len(pix) - LEAST + 1, np.zeros((0, 3), np.int64)
    if n < 2:
        return none
    x = pix.astype(np.uint64)
    key = x[:n] * np.uint64(0x9E3779B97F4A7C15) + x[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2 : n + 2] * np.uint64(0x165667B19E3779F9)
    order, same = _by_key(key)
    same = np.flatnonzero(same)
    a, b = order[same], order[same + 1]
    image = np.searchsorted(ends, np.arange(len(pix)), side="right")
    good = (image[a] == image[b + 2]) & (pix[a] == pix[b]) & (pix[a + 1] == pix[b + 1]) & (pix[a + 2] == pix[b + 2]) & (b - a <= FAR)
    prev = np.full(n + 1, -1)
    prev[b[good]] = a[good]
    # a match goes on while the next place has the match after it
    stop = np.flatnonzero((np.diff(prev) != 1) | (prev[:-1] < 0))
    has = np.flatnonzero(prev >= 0)
    length = LEAST + stop[np.searchsorted(stop, has)] - has
    out, upto = [], 0
    for i, p, m in zip(has.tolist(), prev[has].tolist(), length.tolist(), strict=True):
        if i >= upto:
            m = min(m, 4096)
            out.append((i, m, i - p))
            upto = i + m
    return np.array(out, np.int64).reshape(-1, 3) if out else none


def _hits(pix: np.ndarray, image: np.ndarray, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, whether the cache holds a pixel when its turn comes): the last one before it in its slot is its equal."""
    slot = (pix * np.uint32(CACHE_FACTOR) >> (32 - cache_bits[image]).astype(np.uint32)).astype(np.int64)
    order, same = _by_key((image << 11 | slot).astype(np.uint64))
    hit = np.zeros(len(pix), bool)
    # equal pixels have equal slots, so it is enough that the image is the same
    hit[order[1:]] = same & (pix[order[1:]] == pix[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    return slot, hit


_TIMES_LOG = np.arange(1 << 16) * np.log2(np.maximum(np.arange(1 << 16), 1))


def _bits(counts: np.ndarray) -> np.ndarray:
    """About what symbols, counted along the last axis, and the lengths of their codes take."""
    n = counts.sum(axis=-1)
    big = counts.max(initial=0) >= len(_TIMES_LOG)
    each = counts * np.log2(np.maximum(counts, 1)) if big else _TIMES_LOG[counts]
    return n * np.log2(np.maximum(n, 1)) - each.sum(axis=-1) + 4.0 * (counts > 0).sum(axis=-1)


def _channels(pix: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """Counts of values by image and channel: green, red, blue, alpha."""
    return np.stack([np.bincount(image << 8 | (pix >> np.uint32(s) & np.uint32(255)), minlength=images << 8).reshape(images, 256) for s in (8, 16, 0, 24)], 1)


def image_tokens(images: list[np.ndarray], main: bool, cache_bits: int | None = 0, matches: bool = False, before: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, value, bits) that write images, each with prefix codes of its own; all are coded together.

    matches: with back-references; cache_bits None: a cache where it pays; before: what goes before each, in the same form.
    """
    many = len(images)
    sizes = np.array([x.size for x in images])
    pix, image, ends = np.concatenate([np.ravel(x) for x in images]).astype(np.uint32), np.repeat(np.arange(many), sizes), np.cumsum(sizes)
    at, n, far = (_copies(pix, ends) if matches else np.zeros((0, 3), np.int64)).T
    cover = np.zeros(len(pix) + 1, np.int64)
    cover[at] += 1
    np.subtract.at(cover, at + n, 1)
    single = np.cumsum(cover[:-1]) == 0
    literal = np.flatnonzero(single)
    cached, hit, slot = np.full(many, cache_bits or 0), np.zeros(len(pix), bool), np.zeros(len(pix), np.int64)
    if cache_bits is None:
        cached = np.clip(np.frexp(np.bincount(image[literal], minlength=many).astype(np.float64))[1] - 1, 1, CACHE).astype(np.int64)
        slot, hit = _hits(pix, image, cached)
        # what all literals take, against what is left of them and their slots
        held, missed = literal[hit[literal]], literal[~hit[literal]]
        whole = _bits(_channels(pix[literal], image[literal], many)).sum(axis=1)
        part = _channels(pix[missed], image[missed], many)
        slots = np.bincount(image[held] << CACHE | slot[held], minlength=many << CACHE).reshape(many, 1 << CACHE)
        less = _bits(np.concatenate((part[:, 0], slots), axis=1)) + _bits(part[:, 1:]).sum(axis=1) < whole
        cached = np.where(less, cached, 0)
        hit &= less[image]
    elif cache_bits:
        slot, hit = _hits(pix, image, cached)
    # four fields a token: green, red, blue, alpha, or length and distance with their extra bits, or a slot
    starts = single.copy()
    starts[at] = True
    starts = np.flatnonzero(starts)
    of = image[starts]
    is_copy = np.zeros(len(starts), bool)
    is_copy[np.searchsorted(starts, at)] = True
    is_hit = hit[starts] & ~is_copy
    plain = np.flatnonzero(~(is_copy | is_hit))
    p = pix[starts[plain]]
    alpha, red, green, blue = ((p >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0))
    symbol = np.zeros(len(starts), np.int64)
    symbol[plain] = green
    widths = np.array([x.shape[1] for x in images])
    code = far + 120
    for width in np.unique(widths).tolist():
        near = _near_codes(width)
        close = (widths[image[at]] == width) & (far < len(near))
        close[close] = near[far[close]] > 0
        code[close] = near[far[close]]
    (ls, lx, lb), (fs, fx, fb) = _prefixed(n), _prefixed(code)
    symbol[is_copy] = 256 + ls
    symbol[is_hit] = 280 + slot[starts[is_hit]]
    wide = 280 + (1 << int(cached.max()) if cached.any() else 0)
    rows = of[plain]
    count = lambda r, v, m: np.bincount(r * m + v, minlength=many * m).reshape(many, m)
    greens, fars = code_lengths(count(of, symbol, wide)), code_lengths(count(image[at], fs, 40))
    # red, blue and alpha share a code where that takes at most a fourth more, as it is written and read faster
    apart = np.stack([count(rows, v, 256) for v in (red, blue, alpha)], 1)
    as_one = apart.sum(axis=1)
    shared = 4 * (_bits(as_one) + 8.0 * (as_one > 0).sum(axis=1)) <= 5 * _bits(apart).sum(axis=1)
    apart[shared, 0], apart[shared, 1:] = as_one[shared], 0
    others = code_lengths(apart.reshape(-1, 256)).reshape(many, 3, 256)
    others[shared, 1:] = others[shared, :1]
    others = others.reshape(-1, 256)
    # codes come as green, red, blue, alpha, distance of each image in turn
    lists = [
        (length_tokens(greens, 280 + np.where(cached > 0, 1 << cached, 0)), lambda r: 5 * r),
        (length_tokens(others, np.full(3 * many, 256)), lambda r: r // 3 * 5 + r % 3 + 1),
        (length_tokens(fars, np.full(many, 40)), lambda r: 5 * r + 4),
    ]
    head_row = np.concatenate([f(r) for (r, _, _), f in lists])
    order = np.argsort(head_row, kind="stable")
    head = head_row[order] // 5, np.concatenate([v for (_, v, _), _ in lists])[order], np.concatenate([b for (_, _, b), _ in lists])[order]
    value, size = np.zeros((len(starts), 4), np.int32), np.zeros((len(starts), 4), np.int32)
    bits, length = codes(greens)
    which = of * wide + symbol
    value[:, 0], size[:, 0] = bits.ravel()[which], length.ravel()[which]
    bits, length = (x.ravel() for x in codes(others))
    for k, v in enumerate((red, blue, alpha)):
        which = (rows * 3 + k) * 256 + v
        value[plain, k + 1], size[plain, k + 1] = bits[which], length[which]
    if len(at):
        bits, length = codes(fars)
        copied = np.flatnonzero(is_copy)
        value[copied, 1:] = np.stack((lx, bits[image[at], fs], fx), 1)
        size[copied, 1:] = np.stack((lb, length[image[at], fs], fb), 1)
    # whether there is a cache, of what size, and that there is no meta image
    flags = np.where(cached > 0, cached << 1 | 1, 0), np.where(cached > 0, 5, 1) + main
    return joined_tokens(many, *before, (np.arange(many), *flags), head, (np.repeat(of, 4), value.ravel(), size.ravel()))


def joined_tokens(many: int, *lists: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (owner, value, bits), each sorted by owner, as one: all of the first owner's in the order of the lists."""
    counts = np.stack([np.bincount(owner, minlength=many) for owner, _, _ in lists], 1)
    start = (np.cumsum(counts) - counts.ravel()).reshape(many, -1)
    total = int(counts.sum())
    value, size = np.empty(total, np.int32), np.empty(total, np.int32)
    for k, (_, v, n) in enumerate(lists):
        at = np.arange(len(v)) + np.repeat(start[:, k] - (np.cumsum(counts[:, k]) - counts[:, k]), counts[:, k])
        value[at], size[at] = v, n
    return np.repeat(np.arange(many), counts.sum(axis=1)), value, size


def write_image(w: Writer, argb: np.ndarray, main: bool, cache_bits: int | None = 0, matches: bool = False) -> None:
    _, values, sizes = image_tokens([argb], main, cache_bits, matches)
    w.extend(values, sizes)


def write_lengths(w: Writer, lengths: np.ndarray) -> None:
    _, values, sizes = length_tokens(lengths[None], np.array([len(lengths)]))
    w.extend(values, sizes)


def _file(body: bytes) -> bytes:
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def _head(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 4)  # alpha is used; version 0
    return w


def _write_small(waiting: list[tuple[Writer, int, np.ndarray]]) -> None:
    """Writes the images of transforms where they were left out; all are coded together."""
    if not waiting:
        return
    of, values, sizes = image_tokens([x for _, _, x in waiting], False)
    at = np.searchsorted(of, np.arange(len(waiting) + 1)).tolist()
    for k, (w, place, _) in enumerate(waiting):
        w.values[place], w.sizes[place] = values[at[k] : at[k + 1]], sizes[at[k] : at[k + 1]]


def _through(w: Writer, argb: np.ndarray, transforms: tuple, waiting: list[tuple[Writer, int, np.ndarray]]) -> np.ndarray:
    """Writes transforms and returns what they leave of the pixels; their images are left out for _write_small()."""

    def later(x: np.ndarray) -> None:
        waiting.append((w, len(w.values), x))
        w.extend(np.zeros(0, np.int64), np.zeros(0, np.int64))

    for kind, *more in transforms:
        w.put(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS):
            tile, x = more
            w.put(tile - 2, 3)
            later(x.astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else x)
            argb = _residuals(argb, x, tile) if kind == PREDICTOR else _through_cross(argb, x, tile, False)
        elif kind == GREEN:
            argb = _through_green(argb, -1)
        else:
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(colours) - 1, 8)
            later(_packed(np.diff(_planes(colours[None]), axis=1, prepend=0)))
            argb = _bundled(index.reshape(argb.shape).astype(np.uint32), len(colours)) << np.uint32(8) | np.uint32(0xFF000000)
    w.put(0, 1)
    return argb


def encode_argb(argb: np.ndarray, transforms: tuple = (), cache_bits: int | None = 0, matches: bool = False) -> bytes:
    """Any pixels. transforms, in order: (PREDICTOR, tile bits, modes), (CROSS, tile bits, elements), (GREEN,), (PALETTE,)."""
    w = _head(argb.shape[1], argb.shape[0])
    waiting: list[tuple[Writer, int, np.ndarray]] = []
    argb = _through(w, argb, transforms, waiting)
    _write_small(waiting)
    write_image(w, argb, True, cache_bits, matches)
    return _file(w.bytes())


def _bundled(index: np.ndarray, size: int) -> np.ndarray:
    n = _palette_bits(size)
    if not n:
        return index
    h, w = index.shape
    wide = -(-w >> n)
    full = np.zeros((h, wide << n), np.uint32)
    full[:, :w] = index
    return (full.reshape(h, wide, 1 << n) << (np.arange(1 << n) * (8 >> n)).astype(np.uint32)).sum(axis=2, dtype=np.uint32)


def _whole(argb: np.ndarray, x: int) -> np.ndarray:
    """One value for the whole image, in tiles as large as they come."""
    return np.full((-(-argb.shape[0] >> 9), -(-argb.shape[1] >> 9)), x)


def best_transforms(images: list[np.ndarray]) -> list[list[tuple]]:
    """For each image the transforms to try: that which leaves channels of the fewest bits, by their counts (none,
    subtract-green, cross-colour or a predictor), and the palette where colours are few."""
    many = len(images)
    sizes = np.array([x.size for x in images])
    pix, image = np.concatenate([x.ravel() for x in images]), np.repeat(np.arange(many), sizes)
    width, height = (np.array([x.shape[k] for x in images]) for k in (1, 0))
    place = np.arange(len(pix)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # counts are of every pixel, or of SAMPLE rows at equal distances, but the first
    row = place // width[image]
    some = np.flatnonzero((row > 0) & (row % np.maximum(height // SAMPLE, 1)[image] == 0) | (height == 1)[image])
    of = image[some]
    kept = np.maximum(np.bincount(of, minlength=many), 1)
    scale = sizes / kept
    cost = lambda v: _bits(_channels(v, of, many)).sum(axis=1)
    mine = pix[some]
    costs, options = [cost(mine)], [lambda k: ()]
    green, red, blue = ((mine >> np.uint32(s)).astype(np.uint8).view(np.int8) for s in (8, 16, 0))
    rest = mine & np.uint32(0xFF00FF00)
    costs.append(cost(rest | (red - green).view(np.uint8).astype(np.uint32) << np.uint32(16) | (blue - green).view(np.uint8)))
    options.append(lambda k: ((GREEN,),))
    # cross-colour with the slopes of red and blue on green, in 32nds
    total = lambda v: np.bincount(of, v, many)
    g = green - (total(green) / kept)[of]
    spread = np.maximum(total(g * g), 1e-9)
    slopes = [np.clip(np.rint(32 * total(g * c) / spread), -128, 127).astype(np.int64) for c in (red, blue)]
    delta = [t[of] * green >> 5 for t in slopes]
    costs.append(cost(rest | ((red - delta[0]) & 255).astype(np.uint32) << np.uint32(16) | ((blue - delta[1]) & 255).astype(np.uint32)) + 60 / scale)
    options.append(lambda k: ((CROSS, 9, _whole(images[k], 0xFF000000 | int(slopes[1][k] & 255) << 8 | int(slopes[0][k] & 255)).astype(np.uint32)),))
    # predictors that take a neighbour as it is; first pixels of rows are left out, as every mode treats them alike
    raw = pix[:, None].view(np.uint8)
    inner = some[(place[some] % width[of] > 0) & (row[some] > 0)]
    inside = image[inner]
    thinner = kept / np.maximum(np.bincount(inside, minlength=many), 1)
    for mode, back in ((1, np.ones(many, np.int64)), (2, width), (3, width - 1), (4, width + 1)):
        left = (raw[inner] - raw[inner - back[inside]]).view(np.uint32).ravel()
        bits = _bits(_channels(left, inside, many)).sum(axis=1) * thinner + 60 / scale
        costs.append(np.where((height > 1) & (width > 1), bits, np.inf))
        options.append(lambda k, m=mode: ((PREDICTOR, 9, _whole(images[k], m)),))
    # different colours, by their order within each image
    key = np.sort(image << 32 | pix.astype(np.int64))
    colours = np.bincount(key[np.diff(key, prepend=-1) != 0] >> 32, minlength=many)
    out = []
    for k, best in enumerate(np.argmin(costs, axis=0).tolist()):
        out.append([options[best](k)])
        if colours[k] <= 256 and 2 * colours[k] <= sizes[k] and sizes[k] > 1:
            out[k].append(((PALETTE,),))
    return out


def encode_pixels(images: list[np.ndarray]) -> list[bytes]:
    """Files of pixels, each with the transform, back-references and cache that promise the fewest bits."""
    owner, writers, rest, waiting = [], [], [], []
    for k, tries in enumerate(best_transforms(images)):
        for transforms in tries:
            w = _head(images[k].shape[1], images[k].shape[0])
            rest.append(_through(w, images[k], transforms, waiting))
            writers.append(w)
            owner.append(k)
    _write_small(waiting)
    heads = [w.tokens() for w in writers]
    of = np.repeat(np.arange(len(heads)), [len(v) for v, _ in heads])
    head = of, np.concatenate([v for v, _ in heads]), np.concatenate([n for _, n in heads])
    of, values, sizes = image_tokens(rest, True, None, True, (head,))
    # each file begins with a whole word, so that all are packed at once
    n_bits = np.bincount(of, sizes, len(heads)).astype(np.int64)
    ends = np.cumsum(np.bincount(of, minlength=len(heads)))
    raw = packed_bits(values, sizes, ends[:-1])
    at = np.concatenate(([0], np.cumsum((n_bits + 31) // 32 * 4)))
    out: list[bytes | None] = [None] * len(images)
    for j, k in enumerate(owner):
        made = _file(raw[at[j] : at[j] + (int(n_bits[j]) + 7) // 8])
        out[k] = made if out[k] is None else min(out[k], made, key=len)
    return out


def _shape(n: int) -> tuple[int, int]:
    """Height and width for n pixels: rows of ROW bytes, or wider ones, with room for a count, where those are too many."""
    width = ROW // 4
    if n <= width * MAX_SIDE:
        return n // width, width
    while n + 1 > width * MAX_SIDE:
        width *= 2
    return -(-(n + 1) // width), width


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads of positive multiples of ROW bytes, each as one WebP image, four bytes a pixel: red, green, blue, alpha.

    Images wider than ROW bytes are filled up with zeros, and their last pixel is the number of pixels before that.
    A payload beyond FILE bytes, 8 MiB, takes several files, one after another, so that memory stays bounded.
    """
    images, owner = [], []
    for k, payload in enumerate(payloads):
        for i in range(0, len(payload), FILE):
            rgba = np.frombuffer(payload[i : i + FILE], np.uint32)
            argb = rgba & np.uint32(0xFF00FF00) | rgba >> np.uint32(16) & np.uint32(255) | (rgba & np.uint32(255)) << np.uint32(16)
            h, width = _shape(len(argb))
            if h * width > len(argb):
                argb = np.concatenate((argb, np.zeros(h * width - len(argb) - 1, np.uint32), np.array([len(argb)], np.uint32)))
            images.append(argb.reshape(h, width))
            owner.append(k)
    out, at = [b""] * len(payloads), 0
    while at < len(images):
        stop, held = at, 0
        while stop < len(images) and (stop == at or held + images[stop].nbytes <= TOGETHER) and stop - at < 512:
            held += images[stop].nbytes
            stop += 1
        for k, made in zip(owner[at:stop], encode_pixels(images[at:stop]), strict=True):
            out[k] += made
        at = stop
    return out


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def load(media: bytes) -> np.ndarray:
    """Samples of a stored payload, rows of ROW."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        argb = decode(media[at : at + n])
        flat = argb.ravel()
        if argb.shape[1] > ROW // 4:
            flat = flat[: flat[-1]]
        rgba = flat & np.uint32(0xFF00FF00) | flat >> np.uint32(16) & np.uint32(255) | (flat & np.uint32(255)) << np.uint32(16)
        out.append(rgba.view(np.uint8).reshape(-1, ROW))
        at += n
    return np.concatenate(out)
