"""Media columns: lossless WebP.

``decode`` reads any lossless WebP file: prefix codes, back-references, colour cache, meta prefix codes, and the
predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes one, with any of these.

``store`` keeps byte payloads as grey images, a byte a pixel, and ``load`` reads them back with the same decoder. Each
image has its own prefix codes and back-references to any distance, and either a palette (up to 16 different bytes, so that
pixels are bundled) or subtract-green and, if that takes fewer bits, a predictor for every tile, the one with the least residuals. Subtract-green leaves
red and blue of grey images 0, so that cross-colour has nothing to take from them and a colour in the cache costs no less than a literal;
``store`` writes neither, nor groups of codes.

Both work on many images at once: transforms and the search for matches with numpy, predictors by the diagonals on which
no pixel needs another; only prefix codes are followed an image at a time, two literals a step.

Defined results: null or empty text is a payload of 64 zero bytes; equal payloads give equal files; texts are
processed whole, and one of more bytes than an image can have pixels raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixbin.llm.common import byte_chunks, mix64

#: Fixed values of the format: order of the code length code, most bits of a code, multiplier of the colour cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_BITS, CACHE_MULTIPLIER, MAX_SIDE, SIGNATURE = 15, 0x1E35A7BD, 16384, 0x2F
GREEN_LENGTHS, DISTANCES = 24, 40
#: Bytes of payload that are stored or loaded side by side.
SIDE_BY_SIDE = 1 << 20
#: Most bits of the codes of stored images, and of what the decoder looks up at once.
STORED_BITS = 10
#: Samples by which matches are found, and that a match has at least; longest match and largest distance of the format.
MATCH_KEY, LEAST_MATCH, LONGEST_MATCH, FARTHEST = 8, 12, 4096, (1 << 20) - 120
#: Different bytes up to which a stored image has a palette: with more of them, pixels are not bundled.
FEW_COLOURS = 16
OPAQUE = 0xFF000000


@lru_cache
def neighbourhood() -> tuple[tuple[int, int], ...]:
    """The 120 short distances: offsets within 8 columns and 7 rows by Euclidean distance, then by column, positive first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])))


def value_of(symbol: int) -> tuple[int, int]:
    """First value and number of extra bits of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1, 0
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + 1, extra


@lru_cache
def _values() -> list[tuple[int, int]]:
    return [value_of(s) for s in range(DISTANCES)]


@lru_cache(1 << 16)
def symbol_of(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = (v >> (top - 1)) & 1
    extra = top - 1
    return 2 * top + half, extra, v & ((1 << extra) - 1)


def code_lengths(weights: list[float], limit: int = MAX_BITS) -> list[int]:
    """Huffman code lengths of at most limit bits; symbols of weight 0 get none."""
    used = sorted([i for i, w in enumerate(weights) if w], key=weights.__getitem__)
    lengths = [0] * len(weights)
    n = len(used)
    if n < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    floor = 0.0
    while True:
        w = [max(weights[i], floor) for i in used]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n  # what is made comes in order of its weight, as the leaves do
        for k in range(n, 2 * n - 1):
            total = 0.0
            for _ in (0, 1):
                if leaf < n and (inner >= k or w[leaf] <= w[inner]):
                    at = leaf
                    leaf += 1
                else:
                    at = inner
                    inner += 1
                parent[at] = k
                total += w[at]
            w.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            for i, d in zip(used, depth):
                lengths[i] = d
            return lengths
        floor = max(floor * 2, sum(weights) / 2**limit)


@lru_cache
def _reversed() -> list[int]:
    """All numbers of MAX_BITS bits with their bits in opposite order."""
    out = [0]
    for k in range(MAX_BITS - 1, -1, -1):
        out += [x | 1 << k for x in out]
    return out


def canonical(lengths: list[int]) -> list[int]:
    """Codes as they stand in the stream: canonical values with their first bit lowest."""
    out, code, last, back = [0] * len(lengths), 0, 0, _reversed()
    for s in sorted((s for s, n in enumerate(lengths) if n), key=lengths.__getitem__):
        n = lengths[s]
        code <<= n - last
        out[s], last = back[code] >> MAX_BITS - n, n
        code += 1
    return out


class Writer:
    def __init__(self) -> None:
        self.value, self.bits = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.bits
        self.bits += bits

    def data(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) // 8, "little")


class Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data + b"\0" * 8, at
        self._words: list[int] | None = None

    def bits(self, n: int) -> int:
        lo = self.at >> 3
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return (int.from_bytes(self.data[lo : lo + 8], "little") >> ((self.at - n) & 7)) & ((1 << n) - 1)

    def words(self) -> list[int]:
        """The 32 bits from each byte on."""
        if self._words is None:
            raw = np.frombuffer(self.data, np.uint8).astype(np.uint32)
            n = len(raw) - 4
            self._words = (raw[:n] | raw[1 : n + 1] << 8 | raw[2 : n + 2] << 16 | raw[3 : n + 3] << 24).tolist()
        return self._words


class Code:
    """A prefix code; a code of one symbol takes no bits. ``table`` holds, for the next ``bits`` bits, 16 * symbol + length, or -1."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.only = next(iter(lengths), 0) if len(lengths) < 2 else None
        self.bits = 0 if self.only is not None else max(lengths.values())
        self.table = [-1] * (1 << self.bits) if self.only is None else [16 * self.only]
        if self.only is not None:
            return
        code, last, back = 0, 0, _reversed()
        for s in sorted(lengths, key=lengths.__getitem__):
            n = lengths[s]
            code <<= n - last
            last = n
            self.table[back[code] >> MAX_BITS - n :: 1 << n] = [16 * s + n] * (1 << self.bits - n)
            code += 1

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        e = self.table[r.bits(self.bits)]
        if e < 0:
            raise ValueError("no such code")
        r.at += (e & 15) - self.bits
        return e >> 4


@lru_cache
def _literals() -> list[bytes]:
    """All strings of two bytes, by the first and 256 times the second, and then of one."""
    return [bytes((k & 255, k >> 8)) for k in range(1 << 16)] + [bytes((k,)) for k in range(256)]


def _pairs(code: Code) -> list[int]:
    """For the next ``code.bits`` bits the literals that they hold, two at most, as 16 * place in ``_literals`` + their length; -1 at others."""
    e = np.array(code.table, np.int32)
    n, s = e & 15, e >> 4
    literal = (e >= 0) & (s < 256)
    window = np.arange(len(e), dtype=np.int32)
    following = e[window >> n]
    two = literal & (following >= 0) & (following >> 4 < 256) & (n + (following & 15) <= code.bits)
    one = np.where(literal, 16 * ((1 << 16) + s) + n, -1)
    return np.where(two, 16 * (s + 256 * (following >> 4)) + n + (following & 15), one).tolist()


def read_code(r: Reader, alphabet: int) -> Code:
    if r.bits(1):
        count, wide = r.bits(1) + 1, r.bits(1)
        return Code(dict.fromkeys(sorted([r.bits(8 if wide else 1)] + ([r.bits(8)] if count == 2 else [])), 1))
    first = {}
    for k in range(4 + r.bits(4)):
        n = r.bits(3)
        if n:
            first[LENGTH_ORDER[k]] = n
    code = Code({s: first[s] for s in sorted(first)})
    most = alphabet if not r.bits(1) else 2 + r.bits(2 + 2 * r.bits(3))
    lengths: dict[int, int] = {}
    last, have = 8, 0
    words, at, table, mask = r.words(), r.at, code.table, (1 << code.bits) - 1
    try:
        while have < alphabet and most:
            most -= 1
            w = words[at >> 3] >> (at & 7)
            e = table[w & mask]
            if e < 0:
                raise ValueError("no such code")
            w >>= e & 15
            at += e & 15
            s = e >> 4
            if s < 16:
                if s:
                    lengths[have] = last = s
                have += 1
            elif s == 16:
                for have in range(have, have + 3 + (w & 3)):
                    lengths[have] = last
                have += 1
                at += 2
            else:
                have += 3 + (w & 7) if s == 17 else 11 + (w & 127)
                at += 3 if s == 17 else 7
    except IndexError:
        raise ValueError("the image ends too early") from None
    r.at = at
    if have > alphabet:
        raise ValueError("too many code lengths")
    return Code(lengths)


@lru_cache
def _alone(symbol: int) -> int:
    """The 11 bits of a code of one symbol below 256."""
    w = Writer()
    write_code(w, [int(s == symbol) for s in range(256)])
    return w.value


def write_code(w: Writer, lengths: list[int]) -> None:
    few = len(lengths) - lengths.count(0) <= 2
    used = [s for s, n in enumerate(lengths) if n] if few else []
    if few and all(s < 256 for s in used):
        w.put(1, 1)
        w.put(max(0, len(used) - 1), 1)
        w.put(1, 1)
        for s in used or [0]:
            w.put(s, 8)
        return
    w.put(0, 1)
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i, size = 0, len(lengths)
    while i < size:
        value = lengths[i]
        j = i + 1
        while j < size and lengths[j] == value:
            j += 1
        n = j - i
        if n < 3 or value and (not i or lengths[i - 1] != value):
            n = 1
            runs.append((value, 0, 0))
        elif value:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n = min(n, 138)
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        i += n
    weights = [0.0] * 19
    for s, _, _ in runs:
        weights[s] += 1
    first = code_lengths(weights, 7)
    count = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if first[s])])
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(first[s], 3)
    w.put(0, 1)
    codes, alone = canonical(first), sum(1 for n in first if n) == 1
    value = at = 0
    for s, extra, bits in runs:
        n = 0 if alone else first[s]
        value |= (codes[s] | extra << n) << at
        at += n + bits
    w.put(value, at)


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an image or, where not main, of a table that belongs to one."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, groups = None, 0, 1
    if main and r.bits(1):
        meta_bits = r.bits(3) + 2
        meta = (_pixels(r, _blocks(width, meta_bits), _blocks(height, meta_bits), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (256 + GREEN_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    # where only green differs, its samples are enough
    others = [None if any(c.only is None for c in g[1:4]) else g[3].only << 24 | g[1].only << 16 | g[2].only for g in codes]
    plain = not cache_bits and None not in others and len(set(others)) == 1
    # literals by pairs can pass the image's end, behind which no more is read
    pairs = _pairs(codes[0][0]) if main and plain and groups == 1 and codes[0][0].bits else None
    out: list[int] | bytearray = bytearray() if plain else []
    cache, hashed, near, literals, values = [0] * (1 << cache_bits), 0, neighbourhood(), _literals(), _values()
    across, total, end = _blocks(width, meta_bits), width * height, width * height
    words, at, done = r.words(), r.at, 0
    try:
        while done < total:
            if meta:
                y, x = divmod(done, width)
                g = meta[(y >> meta_bits) * across + (x >> meta_bits)]
                end = y * width + min(width, ((x >> meta_bits) + 1) << meta_bits)  # of the tile's row
            else:
                g = 0
            green, red, blue, alpha, distance = codes[g]
            table, mask, base = green.table, (1 << green.bits) - 1, others[g]
            far, far_mask = distance.table, (1 << distance.bits) - 1
            while done < end:
                w = words[at >> 3] >> (at & 7)
                if pairs:
                    e = pairs[w & mask]
                    while e >= 0:
                        at += e & 15
                        out += literals[e >> 4]
                        e = pairs[words[at >> 3] >> (at & 7) & mask]
                    w = words[at >> 3] >> (at & 7)
                    done = len(out)
                    if done >= end:
                        break
                e = table[w & mask]
                if e < 0:
                    raise ValueError("no such code")
                at += e & 15
                s = e >> 4
                if s < 256:
                    if base is None:
                        r.at = at
                        red_, blue_, alpha_ = red.read(r), blue.read(r), alpha.read(r)
                        at = r.at
                        out.append(alpha_ << 24 | red_ << 16 | s << 8 | blue_)
                    else:
                        out.append(s if plain else base | s << 8)
                    done += 1
                elif s < 256 + GREEN_LENGTHS:
                    length, extra = values[s - 256]
                    length += words[at >> 3] >> (at & 7) & ((1 << extra) - 1)
                    at += extra
                    e = far[words[at >> 3] >> (at & 7) & far_mask]
                    if e < 0:
                        raise ValueError("no such code")
                    at += e & 15 if distance.bits else 0
                    d, extra = values[e >> 4]
                    d += words[at >> 3] >> (at & 7) & ((1 << extra) - 1)
                    at += extra
                    if d <= len(near):
                        x, y = near[d - 1]
                        d = max(1, x + y * width)
                    else:
                        d -= len(near)
                    if d > done:
                        raise ValueError("a back-reference begins before the image")
                    length = min(length, total - done)
                    copied = out[done - d : done - d + length]
                    out += copied if length <= d else (copied * (length // d + 1))[:length]
                    done += length
                else:
                    while hashed < done:  # the cache holds what came before
                        cache[(CACHE_MULTIPLIER * out[hashed] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[hashed]
                        hashed += 1
                    out.append(cache[s - 256 - GREEN_LENGTHS])
                    done += 1
    except IndexError:
        if not pairs or len(out) < total:
            raise ValueError("the image ends too early") from None
    r.at = at
    if plain:
        return np.frombuffer(bytes(out), np.uint8)[:total].astype(np.uint32) << np.uint32(8) | np.uint32(others[0])
    return np.array(out, np.uint32)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sub(a: int, b: int) -> int:
    return sum(((a >> k) - (b >> k) & 255) << k for k in (0, 8, 16, 24))


def _each(f, *pixels: int) -> int:
    return sum(f(*((p >> k) & 255 for p in pixels)) << k for k in (0, 8, 16, 24))


def _average(a: int, b: int) -> int:
    return _each(lambda x, y: (x + y) >> 1, a, b)


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for k in (0, 8, 16, 24):
        a, b, c = (left >> k) & 255, (top >> k) & 255, (corner >> k) & 255
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def _half(x: int, y: int) -> int:
    d = x - y
    return _clamp(x + (d // 2 if d >= 0 else -(-d // 2)))


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictors, by left, top, top right and top left neighbour."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _each(lambda x, y, z: _clamp(x + y - z), left, top, corner)
    if mode == 13:
        return _each(_half, _average(left, top), corner)
    return 0xFF000000


def _with_predictor(pixels: list[int], width: int, bits: int, modes: list[int], forward: bool) -> list[int]:
    across, out = _blocks(width, bits), []
    seen = pixels if forward else out
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if i == 0:
            guess = 0xFF000000
        elif y == 0:
            guess = seen[i - 1]
        elif x == 0:
            guess = seen[i - width]
        else:
            guess = predicted((modes[(y >> bits) * across + (x >> bits)] >> 8) & 15, seen[i - 1], seen[i - width], seen[i - width + 1], seen[i - width - 1])
        out.append(_sub(p, guess) if forward else _add(p, guess))
    return out


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _with_cross_colour(pixels: list[int], width: int, bits: int, table: list[int], forward: bool) -> list[int]:
    across, out = _blocks(width, bits), []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        t = table[(y >> bits) * across + (x >> bits)]
        green_red, green_blue, red_blue = (_signed((t >> k) & 255) for k in (0, 8, 16))
        red, green, blue = (p >> 16) & 255, _signed((p >> 8) & 255), p & 255
        sign = -1 if forward else 1
        new_red = (red + sign * (green_red * green >> 5)) & 255
        base = red if forward else new_red
        new_blue = (blue + sign * ((green_blue * green >> 5) + (red_blue * _signed(base) >> 5))) & 255
        out.append(p & 0xFF00FF00 | new_red << 16 | new_blue)
    return out


def _with_green(pixels: list[int], forward: bool) -> list[int]:
    sign = -1 if forward else 1
    return [p & 0xFF00FF00 | ((p >> 16) + sign * (p >> 8) & 255) << 16 | ((p & 255) + sign * (p >> 8) & 255) for p in pixels]


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _from_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bits = _bundle_bits(len(palette))
    each = 8 >> bits
    shifts = np.arange(0, 8, each, dtype=np.uint32)
    index = (pixels >> 8 & 255).reshape(height, -1, 1) >> shifts & np.uint32((1 << each) - 1)
    colours = np.zeros(256, np.uint32)  # those past the palette are transparent black
    colours[: len(palette)] = palette
    return colours[index.reshape(height, -1)[:, :width]].ravel()


def _without_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & 0xFF00FF00 | (pixels & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF


def _without_cross_colour(pixels: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    at = np.arange(len(pixels))
    t = table[(at // width >> bits) * _blocks(width, bits) + (at % width >> bits)]
    sample = lambda p, k: (p >> k).astype(np.uint8).view(np.int8).astype(np.int32)
    green = sample(pixels, 8)
    red = sample(pixels, 16) + (sample(t, 0) * green >> 5) & 255
    blue = sample(pixels, 0) + (sample(t, 8) * green >> 5) + (sample(t, 16) * sample(red, 0) >> 5) & 255
    return pixels & 0xFF00FF00 | (red << 16 | blue).astype(np.uint32)


def _averages(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1 & 0x7F7F7F7F)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _predictions(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the 14 predictors give for pixels, as ``predicted`` does for one."""
    out = np.empty((14, len(left)), np.uint32)
    a, b, c = (x.view(np.uint8).reshape(-1, 4).astype(np.int16) for x in (left, top, corner))
    packed = lambda x: np.clip(x, 0, 255).astype(np.uint8).view(np.uint32).ravel()
    left_corner, top_right, left_top = _averages(left, corner), _averages(top, right), _averages(left, top)
    out[0], out[1], out[2], out[3], out[4] = OPAQUE, left, top, right, corner
    out[5] = _averages(_averages(left, right), top)
    out[6], out[7], out[8], out[9] = left_corner, left_top, _averages(corner, top), top_right
    out[10] = _averages(left_corner, top_right)
    out[11] = np.where(np.abs(b - c).sum(1) < np.abs(a - c).sum(1), left, top)
    out[12] = packed(a + b - c)
    m = left_top.view(np.uint8).reshape(-1, 4).astype(np.int16)
    d = m - c
    out[13] = packed(m + (d + (d < 0) >> 1))  # halves are cut towards 0
    return out


def _without_predictor(images: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list[np.ndarray]:
    """Images of (pixels, width, bits, table) with the predictors undone: side by side, and in each the pixels of equal x + 2 * y at
    once, as all that they need has a smaller one."""
    starts = np.cumsum([0] + [len(p) for p, _, _, _ in images])
    turn, mode, above = (np.empty(starts[-1], kind) for kind in (np.int32, np.int8, np.int32))
    for lo, (pixels, width, bits, table) in zip(starts.tolist(), images):
        height = len(pixels) // width
        x, y = np.arange(width, dtype=np.int32), np.arange(height, dtype=np.int32)[:, None]
        own = slice(lo, lo + len(pixels))
        turn[own] = (x + 2 * y).ravel()
        modes = (table >> 8 & 15).astype(np.int8).reshape(_blocks(height, bits), -1)
        modes = np.repeat(np.repeat(modes, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width].copy()
        modes[modes > 13] = 0
        modes[0], modes[1:, 0], modes[0, 0] = 1, 2, 0
        mode[own], above[own] = modes.ravel(), width
    most = int(turn.max())
    order = np.argsort(turn.astype(np.uint16) if most < 1 << 16 else turn, kind="stable")
    bounds = np.cumsum(np.bincount(turn, minlength=most + 1)).tolist()
    out = np.concatenate([p for p, _, _, _ in images])
    mode, above = mode[order].astype(np.int64), order - above[order]
    near = lambda at: out.take(at, mode="clip")
    lo = 0
    for hi in bounds:
        at, up = order[lo:hi], above[lo:hi]
        # what lies outside an image is read from anywhere, as its edges use none of it
        guess = _predictions(near(at - 1), near(up), near(up + 1), near(up - 1))[mode[lo:hi], np.arange(hi - lo)]
        out[at] = _sums(out[at], guess)
        lo = hi
    return [out[a:b] for a, b in zip(starts[:-1], starts[1:])]


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def _read(data: bytes) -> tuple[int, int, bool, list[tuple], np.ndarray]:
    """Width, height, whether opaque, transforms in the order of the file, and the pixels before these are undone."""
    r = Reader(_chunk(data))
    if r.bits(8) != SIGNATURE:
        raise ValueError("no lossless image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    opaque = not r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (0, 1):
            bits = r.bits(3) + 2
            transforms.append((kind, now, bits, _pixels(r, _blocks(now, bits), _blocks(height, bits), False)))
        elif kind == 2:
            transforms.append((kind, now, 0, None))
        else:
            size = r.bits(8) + 1
            palette = np.cumsum(_pixels(r, size, 1, False).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            transforms.append((kind, now, 0, palette))
            now = _blocks(now, _bundle_bits(size))
    return width, height, opaque, transforms, _pixels(r, now, height, True)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of lossless WebP files as arrays height x width x (red, green, blue, alpha)."""
    images = [_read(f) for f in files]
    pixels = [i[4] for i in images]
    while any(i[3] for i in images):
        steps = [i[3].pop() if i[3] else (None,) for i in images]
        alike = {kind: [k for k, s in enumerate(steps) if s[0] == kind] for kind in range(4)}
        if alike[0]:
            for k, p in zip(alike[0], _without_predictor([(pixels[k], *steps[k][1:]) for k in alike[0]])):
                pixels[k] = p
        for k in alike[1]:
            pixels[k] = _without_cross_colour(pixels[k], *steps[k][1:])
        for k in alike[2]:
            pixels[k] = _without_green(pixels[k])
        for k in alike[3]:
            pixels[k] = _from_palette(pixels[k], steps[k][1], images[k][1], steps[k][3])
    out = []
    for (width, height, opaque, _, _), argb in zip(images, pixels):
        rgba = argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
        if opaque:
            rgba[..., 3] = 255
        out.append(rgba)
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as an array height x width x (red, green, blue, alpha)."""
    return decode_all([data])[0]


def _tokens(pixels: list[int], width: int, cache_bits: int, matches: bool) -> list[tuple]:
    """Literals ("p", pixel), cache hits ("c", index) and back-references ("b", length, distance)."""
    out: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    i = 0
    while i < len(pixels):
        key = tuple(pixels[i : i + 4])
        j = seen.get(key) if matches and len(key) == 4 else None
        n = 1
        if j is not None:
            while n < 4096 and i + n < len(pixels) and pixels[j + n] == pixels[i + n]:
                n += 1
        slot = (CACHE_MULTIPLIER * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 4:
            out.append(("b", n, i - j))
        elif cache_bits and cache.get(slot) == pixels[i]:
            out.append(("c", slot))
        else:
            out.append(("p", pixels[i]))
            n = 1
        n = n if out[-1][0] == "b" else 1
        for k in range(i, i + n):
            if cache_bits:
                cache[(CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            if matches:
                seen[tuple(pixels[k : k + 4])] = k
        i += n
    return out


@lru_cache
def _short_distances(width: int) -> dict[int, int]:
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(neighbourhood())))}


def _distance_value(d: int, width: int) -> int:
    return _short_distances(width).get(d, d + len(neighbourhood()))


def _write_pixels(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, matches: bool = False, group_bits: int | None = None, groups: list[int] | None = None) -> None:
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0 if group_bits is None else 1, 1)
        if group_bits is not None:
            w.put(group_bits - 2, 3)
            _write_pixels(w, [0xFF000000 | g << 8 for g in groups], _blocks(width, group_bits), False)
    tokens = _tokens(pixels, width, cache_bits, matches)
    sizes = (256 + GREEN_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    weights = [[[0.0] * n for n in sizes] for _ in range(1 if group_bits is None else max(groups) + 1)]
    plan, at = [], 0
    for t in tokens:
        y, x = divmod(at, width)
        g = 0 if group_bits is None else groups[(y >> group_bits) * _blocks(width, group_bits) + (x >> group_bits)]
        if t[0] == "p":
            items = [(0, (t[1] >> 8) & 255, 0, 0), (1, (t[1] >> 16) & 255, 0, 0), (2, t[1] & 255, 0, 0), (3, t[1] >> 24, 0, 0)]
        elif t[0] == "c":
            items = [(0, 256 + GREEN_LENGTHS + t[1], 0, 0)]
        else:
            a, b = symbol_of(t[1]), symbol_of(_distance_value(t[2], width))
            items = [(0, 256 + a[0], a[2], a[1]), (4, b[0], b[2], b[1])]
        for k, s, _, _ in items:
            weights[g][k][s] += 1
        plan.append((g, items))
        at += t[1] if t[0] == "b" else 1
    lengths = [[code_lengths(x) for x in g] for g in weights]
    codes = [[canonical(x) for x in g] for g in lengths]
    for g in lengths:
        for x in g:
            write_code(w, x)
    alone = [[sum(1 for n in x if n) == 1 for x in g] for g in lengths]
    for g, items in plan:
        for k, s, extra, bits in items:
            w.put(codes[g][k][s], 0 if alone[g][k] else lengths[g][k][s])
            w.put(extra, bits)


def _file(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def encode(rgba: np.ndarray, transforms: tuple[str, ...] = (), cache_bits: int = 0, matches: bool = True, modes: list[int] | None = None, cross: tuple[int, int, int] = (9, 250, 30), bits: int = 2, group_bits: int | None = None) -> bytes:
    """A lossless WebP file of an array height x width x 4, with any of the transforms "palette", "predictor", "cross" and "green"."""
    height, width = rgba.shape[:2]
    p = rgba.astype(np.uint32)
    pixels = (p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).ravel().tolist()
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    now = width
    for name in transforms:
        w.put(1, 1)
        if name == "palette":
            palette = sorted(set(pixels))
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            w.put(3, 2)
            w.put(len(palette) - 1, 8)
            _write_pixels(w, [_sub(c, palette[i - 1]) if i else c for i, c in enumerate(palette)], len(palette), False)
            index, pack = {c: i for i, c in enumerate(palette)}, _bundle_bits(len(palette))
            each, packed = 8 >> pack, _blocks(now, pack)
            new = [0xFF000000] * (packed * height)
            for i, c in enumerate(pixels):
                y, x = divmod(i, now)
                new[y * packed + (x >> pack)] |= index[c] << (x & ((1 << pack) - 1)) * each << 8
            pixels, now = new, packed
        elif name == "green":
            w.put(2, 2)
            pixels = _with_green(pixels, True)
        else:
            count = _blocks(now, bits) * _blocks(height, bits)
            w.put(0 if name == "predictor" else 1, 2)
            w.put(bits - 2, 3)
            if name == "predictor":
                table = [0xFF000000 | (modes or list(range(14)))[i % len(modes or range(14))] << 8 for i in range(count)]
                _write_pixels(w, table, _blocks(now, bits), False)
                pixels = _with_predictor(pixels, now, bits, table, True)
            else:
                table = [0xFF000000 | cross[2] << 16 | cross[1] << 8 | cross[0]] * count
                _write_pixels(w, table, _blocks(now, bits), False)
                pixels = _with_cross_colour(pixels, now, bits, table, True)
    w.put(0, 1)
    groups = None if group_bits is None else [i % 2 for i in range(_blocks(now, group_bits) * _blocks(height, group_bits))]
    _write_pixels(w, pixels, now, True, cache_bits, matches, group_bits, groups)
    return _file(w.data())


# ---- payloads as grey images, many at once ----


def sides(payload_bytes: int) -> tuple[int, int]:
    """Width and height of the image of a payload: about square, so that long texts have long diagonals."""
    width = 64
    while width * width < payload_bytes:
        width *= 2
    if width > MAX_SIDE:
        raise ValueError("more bytes than an image has pixels")
    return width, -(-payload_bytes // width)


def _tile_bits(width: int) -> int:
    """Tiles of 16 pixels a side, larger ones in images of more than 1024 of these."""
    return max(4, width.bit_length() - 6)


def _residuals(images: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Green residuals of images of equal width, and the mode of each of their tiles, that with the least sum of residuals."""
    width = images[0].shape[1]
    bits = _tile_bits(width)
    heights = np.array([len(i) for i in images])
    tops = np.cumsum(heights) - heights
    flat = np.concatenate([np.zeros(width + 1, np.uint8), *(i.ravel() for i in images)])
    n = len(flat) - width - 1
    now, left, top, right, corner = (flat[width + 1 - k :][:n] for k in (0, 1, width, width - 1, width + 1))
    average = lambda a, b: (a & b) + ((a ^ b) >> 1)
    a, b, c = (x.astype(np.int16) for x in (left, top, corner))
    left_corner, top_right, middle = average(left, corner), average(top, right), average(left, top)
    half = middle.astype(np.int16) - c
    guesses = (
        np.uint8(0), left, top, right, corner, average(average(left, right), top), left_corner, middle, average(corner, top), top_right, average(left_corner, top_right),
        np.where(np.abs(b - c) < np.abs(a - c), left, top), np.clip(a + b - c, 0, 255).astype(np.uint8), np.clip(middle + (half + (half < 0) >> 1), 0, 255).astype(np.uint8),
    )
    tile_rows = _blocks(heights, bits)
    first_rows = np.concatenate([np.arange(t, t + h, 1 << bits) for t, h in zip(tops, heights)])
    every, costs = [], []
    for g in guesses:
        r = now - g
        every.append(r)
        size = np.minimum(r, -r).reshape(-1, width)
        size[tops], size[:, 0] = 0, 0  # their predictors are fixed
        size = size.reshape(-1, width >> bits, 1 << bits).sum(2, dtype=np.uint32)
        costs.append(np.add.reduceat(size, first_rows, 0))
    modes = np.argmin(costs, 0).astype(np.uint8)
    own = np.diff(np.append(first_rows, len(flat[width + 1 :]) // width))
    by_pixel = np.repeat(np.repeat(modes, own, 0), 1 << bits, 1)
    by_pixel[:, 0] = 2
    by_pixel[tops] = 1
    by_pixel[tops, 0] = 0
    by_pixel, out = by_pixel.ravel(), np.empty(n, np.uint8)
    for k, r in enumerate(every):
        np.copyto(out, r, where=by_pixel == k)
    ends = np.cumsum(heights * width)
    return np.split(out, ends[:-1]), np.split(modes, np.cumsum(tile_rows)[:-1])


def _coded_bits(samples: np.ndarray) -> float:
    """Bits of samples in a code of their own, about: their entropy."""
    counts = np.bincount(samples)
    counts = counts[counts > 0]
    return float(len(samples) * np.log2(len(samples)) - (counts * np.log2(counts)).sum())


def _header(width: int, height: int) -> Writer:
    w = Writer()
    for value, bits in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, bits)
    return w


def _matches(data: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places, lengths and distances of disjoint back-references in strings data[starts[i]:starts[i + 1]]: runs of places whose next
    MATCH_KEY bytes were last seen at the same distance before."""
    n = len(data)
    whole = np.zeros(n + MATCH_KEY, np.uint8)
    whole[:n] = data
    key = np.lib.stride_tricks.sliding_window_view(whole, MATCH_KEY)[:n].copy().view(np.uint64).ravel()
    # hash and place in one number, sorted string by string, so that what stands beside a string makes no difference to it
    entries, counted = mix64(key), np.arange(int(np.diff(starts).max()), dtype=np.uint64)
    later, earlier = [], []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own, count = entries[lo:hi], hi - lo
        bits = np.uint64(count.bit_length())
        mask = (np.uint64(1) << bits) - np.uint64(1)
        own &= ~mask
        own |= counted[:count]
        own.sort()
        same = np.flatnonzero((own[1:] ^ own[:-1]) <= mask)
        places = (own & mask).view(np.int64) + lo
        i, j = places[same + 1], places[same]
        inside = i <= hi - MATCH_KEY
        later.append(i[inside])
        earlier.append(j[inside])
    i, j = np.concatenate(later), np.concatenate(earlier)
    good = (key[i] == key[j]) & (i - j <= FARTHEST)
    back = np.zeros(n + 1, np.int64)
    back[i[good]] = (i - j)[good]
    edges = np.flatnonzero(np.r_[True, back[1:] != back[:-1]])
    edges = np.append(edges, n + 1)
    runs = np.flatnonzero(back[edges[:-1]] > 0)
    at, lengths, distances, free = [], [], [], 0
    # a run goes on for the bytes behind its last place; an image's first place has nothing before it, so that no run spans two
    for lo, hi, d in zip(edges[runs].tolist(), (edges[runs + 1] + MATCH_KEY - 1).tolist(), back[edges[runs]].tolist()):
        lo = max(lo, free)
        while hi - lo >= LEAST_MATCH:
            at.append(lo)
            lengths.append(min(hi - lo, LONGEST_MATCH))
            distances.append(d)
            lo += lengths[-1]
            free = lo
    return at, lengths, distances


def _coded(samples: list[np.ndarray], widths: list[int], heads: list[Writer], alphas: list[int]) -> list[bytes]:
    """Files of images with these green samples, after what stands in heads; each with its own codes."""
    n = len(samples)
    data = np.concatenate(samples)
    starts = np.cumsum([0] + [len(x) for x in samples])
    at, lengths, distances = _matches(data, starts)
    literal = np.ones(len(data) + 1, bool)
    literal[-1] = False
    for i, k in zip(at, lengths):
        literal[i : i + k] = False
    begins = literal.copy()
    begins[at] = True
    place = np.flatnonzero(begins)
    is_match = ~literal[place]
    owner = np.repeat(np.arange(n), np.diff(starts))[place]
    symbol = data[place].astype(np.int64)
    green = [symbol_of(k) for k in lengths]
    match_owner = owner[is_match]
    far = [symbol_of(_distance_value(d, widths[o])) for d, o in zip(distances, match_owner.tolist())]
    symbol[is_match] = [256 + s for s, _, _ in green]
    size = 256 + GREEN_LENGTHS
    green_counts = np.bincount(owner * size + symbol, minlength=n * size).reshape(n, size)
    far_symbol = np.array([s for s, _, _ in far], np.int64)
    far_counts = np.bincount(match_owner * DISTANCES + far_symbol, minlength=n * DISTANCES).reshape(n, DISTANCES)
    code, bits = np.zeros((n, size + DISTANCES), np.uint64), np.zeros((n, size + DISTANCES), np.int64)
    for i, w in enumerate(heads):
        w.put(0, 3)  # no further transform, no cache, one group of codes
        for lo, counts, limit in ((0, green_counts[i], STORED_BITS), (size, far_counts[i], MAX_BITS)):
            if lo:
                w.put(_alone(0) | _alone(0) << 11 | _alone(alphas[i]) << 22, 33)  # red, blue, alpha
            own = code_lengths(counts.tolist(), limit)
            write_code(w, own)
            if np.count_nonzero(counts) > 1:
                code[i, lo : lo + len(own)], bits[i, lo : lo + len(own)] = canonical(own), own
    # a slot a literal, two a match: length and distance, each with its extra bits
    slot = np.arange(len(place)) + np.cumsum(is_match) - is_match
    value, width = np.zeros(len(place) + len(at) + 1, np.uint64), np.zeros(len(place) + len(at) + 1, np.int64)
    value[slot], width[slot] = code[owner, symbol], bits[owner, symbol]
    for where, items in ((slot[is_match], green), (slot[is_match] + 1, far)):
        if items is far:
            value[where], width[where] = code[match_owner, size + far_symbol], bits[match_owner, size + far_symbol]
        value[where] |= np.array([x for _, _, x in items], np.uint64) << width[where].astype(np.uint64)
        width[where] += np.array([k for _, k, _ in items], np.int64)
    slots = np.append(slot[np.searchsorted(place, starts[:-1])], len(value) - 1)
    ends = np.zeros(len(value) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    head = np.array([w.bits for w in heads])
    stream_bytes = (head + ends[slots[1:]] - ends[slots[:-1]] + 7) // 8
    words = (stream_bytes + 7) // 8
    word_starts = np.cumsum(words) - words
    shift = 64 * word_starts + head - ends[slots[:-1]]
    value, width = value[:-1], width[:-1]
    bit = ends[: len(value)] + np.repeat(shift, np.diff(slots))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    word, inside = bit >> 6, (bit & 63).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(value << inside, first)
    cross = np.flatnonzero((bit & 63) + width > 64)
    out[word[cross] + 1] |= value[cross] >> (np.uint64(64) - inside[cross])
    raw = out.view(np.uint8)
    files = []
    for w, lo, count in zip(heads, (8 * word_starts).tolist(), stream_bytes.tolist()):
        fixed = (w.bits + 7) // 8
        stream = bytearray(raw[lo : lo + count])
        stream[:fixed] = (int.from_bytes(stream[:fixed], "little") | w.value).to_bytes(fixed, "little")
        files.append(_file(bytes(stream)))
    return files


def store(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Files of the payloads data[offsets[i]:offsets[i + 1]], padded with zeros to a positive multiple of 64."""
    sizes = np.diff(offsets)
    images, palettes = [], []
    for lo, size in zip(offsets.tolist(), sizes.tolist()):
        width, height = sides(max(64, -(-size // 64) * 64))
        image = np.zeros(width * height, np.uint8)
        image[:size] = data[lo : lo + size]
        colours = np.flatnonzero(np.bincount(image, minlength=256))
        images.append(image.reshape(height, width))
        palettes.append(colours if len(colours) <= FEW_COLOURS else None)
    samples: list[np.ndarray] = [None] * len(images)
    heads = [_header(i.shape[1], i.shape[0]) for i in images]
    widths = [i.shape[1] for i in images]
    for i, (image, colours, w) in enumerate(zip(images, palettes, heads)):
        if colours is None:
            continue
        grey = [OPAQUE | c << 16 | c << 8 | c for c in colours.tolist()]
        w.put(1 | 3 << 1, 3)
        w.put(len(grey) - 1, 8)
        _write_pixels(w, [_sub(c, grey[k - 1]) if k else c for k, c in enumerate(grey)], len(grey), False)
        pack = _bundle_bits(len(grey))
        index = np.searchsorted(colours, image).reshape(image.shape[0], -1, 1 << pack)
        samples[i] = (index << np.arange(0, 8, 8 >> pack)).sum(2).astype(np.uint8).ravel()
        widths[i] >>= pack
    alphas = [255] * len(images)
    for width in {w for w, p in zip(widths, palettes) if p is None}:
        index = [i for i, p in enumerate(palettes) if p is None and widths[i] == width]
        bits = _tile_bits(width)
        for i, residuals, modes in zip(index, *_residuals([images[i] for i in index])):
            heads[i].put(1 | 2 << 1, 3)
            samples[i] = images[i].ravel()
            if _coded_bits(residuals) + 4 * modes.size < _coded_bits(samples[i]):
                heads[i].put(1 | 0 << 1 | bits - 2 << 3, 6)
                _write_pixels(heads[i], [OPAQUE | m << 8 for m in modes.ravel().tolist()], width >> bits, False)
                samples[i], alphas[i] = residuals, 0
    return _coded(samples, widths, heads, alphas) if images else []


def load(files: list[bytes]) -> list[np.ndarray]:
    """The samples of stored files, as arrays height x width."""
    return [image[..., 1] for image in decode_all(files)]


def feature(samples: np.ndarray) -> str:
    """Average hash: for 64 equal parts of the samples, whether the part is brighter than the whole; 16 hex digits."""
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    return np.packbits(64 * parts > parts.sum()).tobytes().hex()


def with_media(docs: DataFrame, keep: list[str], files: bool = False) -> DataFrame:
    """The columns keep of docs (text) and a struct m of what was stored and read back; files adds the stored bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    fields = "n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string" + ", media: binary" * files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in byte_chunks(batch.column(0), SIDE_BY_SIDE):
                stored = store(data, offsets)
                for size, file, image in zip(np.diff(offsets).tolist(), stored, load(stored)):
                    payload = image.ravel()[: max(64, -(-size // 64) * 64)]
                    raw = payload.tobytes()
                    row = (size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(payload))
                    rows.append(row + (file,) * files)
            columns = list(zip(*rows)) or [[] for _ in range(7 + files)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + files]
            m = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split(":")[0] for x in fields.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], m], names=[*keep, "m"])

    return docs.selectExpr("text AS _text", *(f"`{c}`" for c in keep)).mapInArrow(run, f"{schema + ', ' if keep else ''}m struct<{fields}>")
