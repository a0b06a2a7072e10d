"""Stored files and streams written by hand against a decoder that reads bit by bit and pixel by pixel."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import media, webp


class Bits:
    def __init__(self, data):
        self.text = "".join(f"{b:08b}"[::-1] for b in data)
        self.at = 0

    def take(self, n):
        x = int(self.text[self.at : self.at + n][::-1] or "0", 2)
        assert self.at + n <= len(self.text)
        self.at += n
        return x

    def symbol(self, code):
        if len(code) == 1:
            return next(iter(code.values()))
        word = ""
        while word not in code:
            word += str(self.take(1))
        return code[word]


def plain_code(lengths):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {"": used[0]}
    out, code, prev = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - prev
        out[f"{code:0{n}b}"] = s
        code, prev = code + 1, n
    return out


def plain_lengths(r, size):
    out = [0] * size
    if r.take(1):
        two = r.take(1)
        out[r.take(8 if r.take(1) else 1)] = 1
        if two:
            out[r.take(8)] = 1
        return plain_code(out)
    meta = [0] * 19
    for k in webp.LENGTH_ORDER[: 4 + r.take(4)]:
        meta[k] = r.take(3)
    code, left, s, prev = plain_code(meta), size, 0, 8
    if r.take(1):
        left = 2 + r.take(2 + 2 * r.take(3))
    while s < size and left:
        left -= 1
        x = r.symbol(code)
        if x < 16:
            out[s], prev, s = x, x or prev, s + 1
        else:
            n = {16: lambda: 3 + r.take(2), 17: lambda: 3 + r.take(3), 18: lambda: 11 + r.take(7)}[x]()
            out[s : s + n] = [prev if x == 16 else 0] * n
            s += n
    return plain_code(out)


def plain_value(r, s):
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.take(extra) + 1


def plain_image(r, width, height, main, seen):
    bits = r.take(4) if r.take(1) else 0
    tile, tiles, groups = 0, None, 1
    if main and r.take(1):
        tile = r.take(3) + 2
        tiles = [p >> 8 & 0xFFFF for p in plain_image(r, -(-width >> tile), -(-height >> tile), False, set())]
        groups = max(tiles) + 1
        seen.add("meta")
    books = [[plain_lengths(r, n) for n in (280 + (1 << bits if bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    out, cache = [], [0] * (1 << bits)
    while len(out) < width * height:
        y, x = divmod(len(out), width)
        c = books[tiles[(y >> tile) * -(-width >> tile) + (x >> tile)] if tiles else 0]
        s = r.symbol(c[0])
        if s < 256:
            red, blue = r.symbol(c[1]), r.symbol(c[2])
            new = [r.symbol(c[3]) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = plain_value(r, s - 256)
            far = plain_value(r, r.symbol(c[4]))
            if far > 120:
                far -= 120
            else:
                dx, dy = webp.NEAR[far - 1]
                far = max(dx + dy * width, 1)
            new = []
            for _ in range(n):
                new.append((out + new)[-far])
            seen.add("copy")
        else:
            new = [cache[s - 280]]
            seen.add("cache")
        for p in new:
            out.append(p)
            if bits:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits)] = p
    return out


def split(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def joined(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def plain_guess(mode, left, top, corner, right):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(max(v, 0), 255)
    if mode == 11:
        by_left = sum(abs(left[k] - (left[k] + top[k] - corner[k])) for k in range(4))
        by_top = sum(abs(top[k] - (left[k] + top[k] - corner[k])) for k in range(4))
        return left if by_left < by_top else top
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner),
        7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)),
        12: lambda: [clamp(a + t - c) for a, t, c in zip(left, top, corner, strict=True)],
    }[mode]()


def plain_decode(data):
    """(pixels by row, what the stream used)."""
    r, seen, undo = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")]), set(), []
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and r.take(8) == 0x2F
    width, height = r.take(14) + 1, r.take(14) + 1
    r.take(4)
    wide = width
    while r.take(1):
        kind = r.take(2)
        if kind in (0, 1):
            tile = r.take(3) + 2
            undo.append((kind, tile, plain_image(r, -(-wide >> tile), -(-height >> tile), False, set()), wide))
        elif kind == 2:
            undo.append((kind, 0, None, wide))
        else:
            size = r.take(8) + 1
            table, sums = [], [0] * 4
            for p in plain_image(r, size, 1, False, set()):
                sums = [(a + b) & 255 for a, b in zip(sums, split(p), strict=True)]
                table.append(joined(sums))
            each = 1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8
            undo.append((kind, each, table, wide))
            wide = -(-wide * each // 8)
        seen.add(("predictor", "cross", "green", "palette")[kind])
    rows = plain_image(r, wide, height, True, seen)
    rows = [rows[i : i + wide] for i in range(0, len(rows), wide)]
    for kind, n, x, wide in reversed(undo):
        across = -(-wide >> n) if kind < 2 else 0
        new = []
        for y, row in enumerate(rows):
            new.append([])
            for k in range(wide):
                if kind == 3:
                    i = (row[k * n // 8] >> 8 & 255) >> (k * n % 8) & ((1 << n) - 1)
                    new[y].append(x[i] if i < len(x) else 0)
                    continue
                c = split(row[k])
                if kind == 0:
                    if y == 0 and k == 0:
                        g = [255, 0, 0, 0]
                    elif y == 0 or k == 0:
                        g = split(new[0][k - 1] if y == 0 else new[y - 1][0])
                    else:
                        right = new[y - 1][k + 1] if k + 1 < wide else new[y][0]
                        g = plain_guess(x[(y >> n) * across + (k >> n)] >> 8 & 15, *map(split, (new[y][k - 1], new[y - 1][k], new[y - 1][k - 1], right)))
                    c = [a + b for a, b in zip(c, g, strict=True)]
                elif kind == 1:
                    e = [v - 256 if v > 127 else v for v in split(x[(y >> n) * across + (k >> n)])]
                    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
                    c[1] += e[3] * signed(c[2]) >> 5
                    c[3] += (e[2] * signed(c[2]) >> 5) + (e[1] * signed(c[1]) >> 5)
                else:
                    c[1], c[3] = c[1] + c[2], c[3] + c[2]
                new[y].append(joined(c))
        rows = new
    return rows, seen


@pytest.mark.parametrize("seed", range(24))
def test_every_coding_equals_a_plain_decoder(seed):
    rng = np.random.default_rng(seed)
    h, w = (int(x) for x in rng.integers(1, 24, 2))
    img = rng.choice(rng.integers(0, 2**32, int(rng.integers(1, 40)), dtype=np.uint32), (h, w)) if seed % 2 else rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    tile = int(rng.integers(2, 5))
    shape = (-(-h >> tile), -(-w >> tile))
    steps = [
        (webp.PREDICTOR, tile, rng.choice([0, 2, 3, 4, 8, 9], shape) if seed % 3 else rng.integers(0, 14, shape)),
        (webp.CROSS, tile, rng.integers(0, 2**24, shape, dtype=np.uint32) | np.uint32(0xFF000000)),
        (webp.GREEN,),
    ]
    steps = [(webp.PALETTE,)] if seed % 4 == 1 else [s for s in steps if rng.random() < 0.7]
    data = webp.encode_argb(img, tuple(steps), [0, None, 1, 7][seed % 4], bool(rng.random() < 0.7))
    rows, seen = plain_decode(data)
    assert rows == img.tolist() and np.array_equal(webp.decode(data), img) and len(seen & {"predictor", "cross", "green", "palette"}) == len(steps)


def words(rng, n):
    few = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    return " ".join(rng.choice(few) for _ in range(n)).encode()


def test_stored_texts_use_what_pays():
    rng, seen = random.Random(5), set()
    rows = ["".join(rng.choice("abcdefghij") for _ in range(64)) for _ in range(40)]
    grey = np.cumsum(np.random.default_rng(5).integers(0, 3, (120, 64)), axis=0).astype(np.uint8)
    tinted = np.random.default_rng(6).integers(0, 64, (400, 16, 4)).astype(np.uint8)
    tinted[..., 0] = (tinted[..., 1].astype(np.int64) * 40 >> 5) + tinted[..., 0] % 2
    tinted[..., 3] = 255
    for text, wants in [
        (words(rng, 900), {"copy", "cache"}), (b"".join(rng.choice([b"sol ", b"mar ", b"luz "]) for _ in range(900)), {"palette"}), (words(rng, 3), set()), (b"", set()),
        (grey.tobytes(), {"predictor"}), (tinted.tobytes(), {"cross"}), ("".join(rng.choice(rows[:3]) for _ in range(60)).encode(), {"copy"}),
    ]:
        p = media.payload(text)
        got, used = plain_decode(webp.store(p))
        flat = b"".join(bytes((v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24)) for row in got for v in row)
        assert flat == p and webp.load(webp.store(p)).tobytes() == p and wants <= used, (wants, used)
        seen |= used
    assert seen == {"copy", "cache", "palette", "predictor", "cross"}


def test_a_stream_of_several_codes():
    # 8 x 4 pixels in tiles of 4 x 4: the left ones read literals of one code, the right ones of another
    w = webp._head(8, 4)
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no cache
    w.put(1, 1)  # a meta image
    w.put(0, 3)  # tiles of 4
    webp.write_image(w, np.array([[0, 1 << 8]], np.uint32), False)
    for green in ((10, 20), (30, 40)):
        for pair in (green, (1,), (2,), (3,), (0,)):
            w.put(1 | len(pair) - 1 << 1 | 1 << 2, 3)
            for v in pair:
                w.put(v, 8)
    for k in range(32):
        w.put(k & 1, 1)
    data = webp._file(w.bytes())
    rows, seen = plain_decode(data)
    want = [[(10, 20, 10, 20, 30, 40, 30, 40)[x] << 8 | 3 << 24 | 1 << 16 | 2 for x in range(8)]] * 4
    assert rows == want and "meta" in seen and webp.decode(data).tolist() == want


def test_a_stream_with_a_reference_and_a_cache():
    # 4 x 2: a literal, a copy of it three times, another literal, the first one from the cache, then a copy of two from above
    w = webp._head(4, 2)
    w.put(0, 1)
    w.put(1 | 3 << 1, 5)  # a cache of 8
    w.put(0, 1)
    a, b = 0xFF000500, 0xFF000900
    slot = (webp.CACHE_FACTOR * a & 0xFFFFFFFF) >> 29
    assert slot != (webp.CACHE_FACTOR * b & 0xFFFFFFFF) >> 29
    lengths = np.zeros(288, np.int64)
    lengths[[5, 9, 257, 258, 280 + slot]] = [2, 2, 2, 3, 3]
    webp.write_lengths(w, lengths)
    for v in (0, 0, 255):
        w.put(5, 3)
        w.put(v, 8)
    far = np.zeros(40, np.int64)
    far[[0, 1]] = 1  # one row up; one pixel left
    webp.write_lengths(w, far)
    (green, n), (distance, m) = ((x[0] for x in webp.codes(v[None])) for v in (lengths, far))
    for s, d in ((5, None), (258, 1), (9, None), (280 + slot, None), (257, 0)):
        w.put(int(green[s]), int(n[s]))
        if d is not None:
            w.put(int(distance[d]), int(m[d]))
    data = webp._file(w.bytes())
    want = [[a, a, a, a], [b, a, a, a]]
    rows, seen = plain_decode(data)
    assert rows == want and seen == {"copy", "cache"} and webp.decode(data).tolist() == want


def test_large_payloads_are_one_image():
    assert webp._shape(16 * 16384) == (16384, 16) and webp._shape(16 * 16385)[1] == 32
    rng = random.Random(1)
    text = words(rng, 400_000)
    data = webp.store(media.payload(text))
    assert len(text) > 1 << 21 and webp.decode(data).shape[1] > 16 and len(data) == 8 + int.from_bytes(data[4:8], "little")
    assert webp.load(data).tobytes() == media.payload(text)


def test_fields_of_the_media_columns(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 1 + i * 7).decode() + "é" * (i % 3)) for i in range(25)] + [(30, None), (31, ""), (3, "otra"), (3, "otra")]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, n_bytes int, media string")
    got = media.media_columns(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 3 for r in got) == 3
    wanted = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        m = webp.store(p)
        pixels, _ = plain_decode(m)
        back = b"".join(bytes((v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24)) for row in pixels for v in row)
        a = np.frombuffer(back, np.uint8).reshape(-1, 64)
        h = len(a)
        cells = [[np.mean([a[y, x * 8 : x * 8 + 8].mean() for y in range(k * h // 8, max((k + 1) * h // 8, k * h // 8 + 1))]) for x in range(8)] for k in range(8)]
        flags = "".join("1" if c > np.mean(cells) + 1e-9 else "0" for row in cells for c in row)
        feature = f"{int(flags, 2):016x}:{a.mean():.3f}:{a.std():.3f}"
        wanted.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_code_lengths_are_complete_and_near_the_best():
    rng = np.random.default_rng(3)
    counts = np.stack([np.where(rng.random(300) < rng.random(), rng.integers(0, 4, 300) ** rng.integers(1, 9, 300), 0) for _ in range(60)])
    counts[:3] = 0
    counts[1, 7], counts[2, [3, 9]] = 5, (1, 100)
    lengths = webp.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 13
    for c, n in zip(counts, lengths, strict=True):
        if (c > 0).sum() > 1:
            assert (2.0 ** -n[n > 0]).sum() == 1
            share = c[c > 0] / c.sum()
            assert (c * n).sum() <= 1.12 * (c[c > 0] * -np.log2(share)).sum() + c.sum()
        else:
            assert n.sum() == (c > 0).sum()


def test_files_do_not_depend_on_their_neighbours():
    rng = random.Random(8)
    payloads = [media.payload(words(rng, n)) for n in (0, 1, 3, 50, 50, 700, 12, 900)] + [media.payload(b"ab" * 500), media.payload(b"")]
    assert webp.store_many(payloads) == [webp.store(p) for p in payloads]


def test_larger_payloads_are_several_images(monkeypatch):
    monkeypatch.setattr(webp, "FILE", 1 << 12)
    p = media.payload(words(random.Random(2), 4000))
    data = webp.store(p)
    assert webp.load(data).tobytes() == p and data.count(b"WEBPVP8L") == -(-len(p) // (1 << 12))


def test_images_of_transforms_are_coded_together(monkeypatch):
    rng, calls, whole = random.Random(5), [], webp.image_tokens
    payloads = [media.payload(b"".join(rng.choice([b"sol ", b"mar ", b"luz ", b"rio "]) for _ in range(200 + k))) for k in range(12)]
    alone = [webp.store(p) for p in payloads]
    monkeypatch.setattr(webp, "image_tokens", lambda images, *a, **k: calls.append(len(images)) or whole(images, *a, **k))
    assert webp.store_many(payloads) == alone
    # one call for all palettes, one for all pixels
    assert len(calls) == 2 and calls[0] >= 12


def test_features_of_many_images_are_those_of_each():
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, webp.ROW), dtype=np.uint8) for h in (1, 2, 7, 8, 9, 40, 3)]
    assert media.features(images) == [media.feature(x) for x in images]
    h = images[5].astype(np.float64).reshape(8, 5, 8, 8).mean(axis=(1, 3))
    assert media.feature(images[5]).split(":")[0] == np.packbits(h > h.mean()).tobytes().hex()
