"""Lossless WebP: a decoder of the whole format and an encoder for 8-bit samples.

The format's constants (orders, offsets, the table of near distances) are fixed
values; the table is built from its rule. Pixels are kept as four planes of
bytes in the order alpha, red, green, blue.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
MOST_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: (columns to the left, rows up) of the 120 short distances: by length, then by column, right before left.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
#: Bits that one look into the table of a prefix code takes, for one symbol and for many.
LOOK = 12
WIDE = 16


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.held, self.n = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.n
            self.at += 8
            self.n += 64
            if self.at > len(self.data) + 64:
                raise ValueError("the image ends too early")

    def read(self, n: int) -> int:
        self.need(n)
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return value


class PrefixCode:
    """A canonical prefix code, read first bit first.

    ``single`` is the symbol of a code of one symbol, which takes no bits. What
    the next ``WIDE`` bits hold in literals is remembered as it comes up.
    """

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else (None if used else 0)
        self.codes: dict[tuple[int, int], int] = {}
        self.first: list[tuple[int, int] | None] = [None] * (1 << LOOK)
        self.deepest = max(lengths, default=0)
        if self.single is not None:
            return
        if sum(2.0**-n for n in lengths if n) != 1.0:
            raise ValueError("the prefix code is not complete")
        for symbol, (bits, n) in canonical(lengths).items():
            self.codes[n, bits] = symbol
            if n <= LOOK:
                for rest in range(1 << LOOK - n):
                    self.first[bits | rest << n] = symbol, n
        self.many: dict[int, tuple[bytes, int] | None] = {}

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        bits.need(16)
        found = self.first[bits.held & ((1 << LOOK) - 1)]
        if found is None:
            for n in range(LOOK + 1, 16):
                symbol = self.codes.get((n, bits.held & ((1 << n) - 1)))
                if symbol is not None:
                    found = symbol, n
                    break
            else:
                raise ValueError("no such prefix code")
        bits.held >>= found[1]
        bits.n -= found[1]
        return found[0]

    def literals(self, value: int) -> tuple[bytes, int] | None:
        """The literals that the next ``WIDE`` bits begin with, and their bits; kept in ``many``."""
        found, used = bytearray(), 0
        while (hit := self.first[value >> used & ((1 << LOOK) - 1)]) and hit[0] < LITERALS and used + hit[1] <= WIDE:
            found.append(hit[0])
            used += hit[1]
        self.many[value] = (bytes(found), used) if found else None
        return self.many[value]


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol; codes with their first bit lowest."""
    code, out, before = 0, {}, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    return out


@lru_cache(maxsize=64)
def code_of(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return code_of(tuple(lengths))
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = code_of(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        extra, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[symbol - 16]
        n = least + bits.read(extra)
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return code_of(tuple(lengths))


def read_value(bits: BitReader, prefix: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, as an array of 32-bit pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, shift, across, chosen = 1, 0, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        down = (height + (1 << shift) - 1) >> shift
        chosen = (read_pixels(bits, across, down, False) >> 8 & 0xFFFF).tolist()
        groups = max(chosen) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    one = codes[0]
    if groups == 1 and not cache_bits and all(c.single is not None for c in one[1:4]):
        green = _read_green(bits, one[0], one[4], width, total)
        base = one[3].single << 24 | one[1].single << 16 | one[2].single
        return np.frombuffer(green, "u1").astype("u4") << 8 | base
    out: list[int] = []
    cache = [0] * cache_size
    while len(out) < total:
        at = len(out)
        if chosen is not None:
            one = codes[chosen[(at // width >> shift) * across + (at % width >> shift)]]
        symbol = one[0].read(bits)
        if symbol < LITERALS:
            red, blue = one[1].read(bits), one[2].read(bits)
            out.append(one[3].read(bits) << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < LITERALS + LENGTHS:
            n = read_value(bits, symbol - LITERALS)
            back = near(read_value(bits, one[4].read(bits)), width)
            if back > at or at + n > total:
                raise ValueError("a copy reaches out of the image")
            for _ in range(n):
                out.append(out[-back])
        else:
            out.append(cache[symbol - LITERALS - LENGTHS])
        if cache_bits:
            for pixel in out[at:]:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> 32 - cache_bits] = pixel
    return np.array(out, "u4")


def near(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_green(bits: BitReader, code: PrefixCode, distance: PrefixCode, width: int, total: int) -> bytearray:
    """Pixels of which only the green byte is coded: several literals by one look."""
    out = bytearray()
    if code.single is not None and code.single < LITERALS:
        return bytearray([code.single]) * total
    table, mask, safe = code.many, (1 << WIDE) - 1, total - WIDE
    data, at, held, n = bits.data, bits.at, bits.held, bits.n
    while True:
        while len(out) < safe:
            if n < WIDE:
                held |= int.from_bytes(data[at : at + 8], "little") << n
                at += 8
                n += 64
            look = held & mask
            hit = table[look] if look in table else code.literals(look)
            if hit is None:
                break
            out += hit[0]
            held >>= hit[1]
            n -= hit[1]
        bits.at, bits.held, bits.n = at, held, n
        if len(out) >= total:
            return out
        symbol = code.read(bits)
        if symbol < LITERALS:
            out.append(symbol)
        else:
            length = read_value(bits, symbol - LITERALS)
            back = near(read_value(bits, distance.read(bits)), width)
            begin = len(out) - back
            if begin < 0 or len(out) + length > total:
                raise ValueError("a copy reaches out of the image")
            if back >= length:
                out += out[begin : begin + length]
            else:
                piece = bytes(out[begin:])
                out += (piece * (length // back + 1))[:length]
        at, held, n = bits.at, bits.held, bits.n


def planes(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue of 32-bit pixels, as one array of bytes each."""
    return np.stack([(pixels >> s & 0xFF) for s in (24, 16, 8, 0)]).astype("u1")


def _predict(mode: int, left, top, right, corner) -> np.ndarray:
    """The prediction of one pixel from its neighbours, arrays of four channels as integers."""
    mean = lambda a, b: a + b >> 1
    if mode == 11:
        away = [int(np.abs(top - corner).sum()), int(np.abs(left - corner).sum())]
        return left if away[0] < away[1] else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        base = mean(left, top)
        return np.clip(base + np.trunc((base - corner) / 2).astype(int), 0, 255)
    simple = {
        1: left, 2: top, 3: right, 4: corner,
        5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
        8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
    }
    return simple.get(mode, np.array([255, 0, 0, 0]))


def predicted(image: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Residuals of an image (height, width, 4), or with ``inverse`` the image of residuals."""
    height, width, _ = image.shape
    out = np.zeros((height, width, 4), int)
    known = out if inverse else image.astype(int)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = known[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = known[y - 1, 0]
            else:
                beyond = known[y - 1, x + 1] if x + 1 < width else known[y, 0]
                mode = int(modes[y >> shift, x >> shift])
                guess = _predict(mode, known[y, x - 1], known[y - 1, x], beyond, known[y - 1, x - 1])
            value = image[y, x].astype(int)
            out[y, x] = (value + guess if inverse else value - guess) & 255
    return out.astype("u1")


def cross_coloured(image: np.ndarray, factors: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """``factors``: (green to red, green to blue, red to blue) of each block, signed."""
    height, width, _ = image.shape
    rows, columns = np.arange(height) >> shift, np.arange(width) >> shift
    f = factors.astype("i1").astype(int)[rows[:, None], columns[None, :]]
    out = image.astype(int)
    signed = lambda plane: (plane & 255).astype("u1").view("i1").astype(int)
    green, red = signed(out[..., 2]), out[..., 1].copy()
    sign = 1 if inverse else -1
    new_red = red + sign * (f[..., 0] * green >> 5) & 255
    true_red = signed(new_red if inverse else red)
    out[..., 1] = new_red
    out[..., 3] = out[..., 3] + sign * ((f[..., 1] * green >> 5) + (f[..., 2] * true_red >> 5)) & 255
    return out.astype("u1")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of a file, channels alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    bits = BitReader(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]], 1)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, coded = [], width
    blocks = lambda size, shift: (size + (1 << shift) - 1) >> shift
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            shape = blocks(height, shift), blocks(coded, shift)
            steps.append((kind, coded, shift, planes(read_pixels(bits, shape[1], shape[0], False)).T.reshape(*shape, 4)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, coded, 0, None))
        else:
            size = bits.read(8) + 1
            deltas = planes(read_pixels(bits, size, 1, False))
            colours = np.zeros((256, 4), "u1")
            colours[:size] = np.cumsum(deltas, axis=1, dtype="u4").astype("u1").T
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, coded, shift, colours))
            coded = blocks(coded, shift)
    pixels = read_pixels(bits, coded, height, True)
    if len(steps) == 1 and steps[0][0] == PALETTE and steps[0][2] == 0:
        return steps[0][3][(pixels >> 8 & 0xFF).astype("u1")].reshape(height, width, 4)
    image = planes(pixels).T.reshape(height, coded, 4)
    for kind, wide, shift, with_ in reversed(steps):
        if kind == PREDICTOR:
            image = predicted(image, with_[..., 2], shift, True)
        elif kind == CROSS_COLOUR:
            image = cross_coloured(image, with_[..., [3, 2, 1]], shift, True)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        else:
            per = 1 << shift
            each = 8 >> shift
            index = image[..., 2][..., None] >> (np.arange(per) * each).astype("u1") & ((1 << each) - 1)
            image = with_[index.reshape(height, -1)[:, :wide]]
    return image


# Writing. Bits are kept as text in the order of the stream and packed at the end.


def number(value: int, n: int) -> str:
    return f"{value:0{n}b}"[::-1] if n else ""


def packed(stream: str) -> bytes:
    return int(stream[::-1] or "0", 2).to_bytes((len(stream) + 7) // 8, "little")


def huffman(weights: dict[int, float]) -> dict[int, int]:
    """Code length of each symbol by its weight."""
    heap = [(w, s, [s]) for s, w in sorted(weights.items())]
    heapq.heapify(heap)
    depth = dict.fromkeys(weights, 0 if len(weights) > 1 else 1)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (joined := a[2] + b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), joined))
    return depth


def simple_code(*symbols: int) -> str:
    """The header of a code of one or two symbols."""
    first = number(1, 1) + number(symbols[0], 8)
    return "1" + number(len(symbols) - 1, 1) + first + (number(symbols[1], 8) if len(symbols) > 1 else "")


def written_code(lengths) -> str:
    """The header of any other code: runs of lengths, in a code of their own."""
    runs: list[tuple[int, str]] = []
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at] and n < (138 if not lengths[at] else 7):
            n += 1
        if not lengths[at] and n >= 11:
            runs.append((18, number(n - 11, 7)))
        elif not lengths[at] and n >= 3:
            n = min(n, 10)
            runs.append((17, number(n - 3, 3)))
        elif n >= 4:
            runs += [(lengths[at], ""), (16, number(n - 4, 2))]
        else:
            runs += [(lengths[at], "")] * n
        at += n
    counts: dict[int, float] = {}
    for s, _ in runs:
        counts[s] = counts.get(s, 0) + 1
    depth = huffman(counts)
    if max(depth.values()) > 7:
        depth = huffman(dict.fromkeys(counts, 1.0))
    of_lengths = [depth.get(s, 0) for s in range(19)]
    out = "0" + number(15, 4) + "".join(number(of_lengths[s], 3) for s in LENGTH_ORDER) + "0"
    codes = {s: number(*c) for s, c in canonical(of_lengths).items()} if len(depth) > 1 else dict.fromkeys(depth, "")
    return out + "".join(codes[s] + extra for s, extra in runs)


def value_code(value: int) -> tuple[int, str]:
    """The symbol and extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, ""
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), number(v & ((1 << extra) - 1), extra)


class SampleCode:
    """The code of samples: ranks by frequency, short for the frequent; built from a rule, not from data.

    As every file has its palette in the order of frequency, one code fits all
    files, and readers build its table once.
    """

    def __init__(self):
        ranks = {r: 1 / (r + 3) ** 1.3 for r in range(LITERALS)}
        depth = huffman(ranks | {LITERALS + i: 2e-4 for i in range(LENGTHS)})
        lengths = [depth[s] for s in range(LITERALS + LENGTHS)]
        self.codes = [number(*canonical(lengths)[s]) for s in range(len(lengths))]
        literals = self.codes[:LITERALS]
        self.pairs = [a + b for b in literals for a in literals]
        flat = [8] * LITERALS + [0] * LENGTHS
        self.flat = [number(*canonical(flat)[s]) for s in range(LITERALS)]
        far = [5] * 24 + [6] * 16
        self.far = [number(*canonical(far)[s]) for s in range(DISTANCES)]
        constant = simple_code(0) * 2
        self.palette_head = "0" + written_code(flat) + constant
        self.image_head = "00" + written_code(lengths) + constant + simple_code(255) + written_code(far)


@lru_cache(maxsize=1)
def sample_code() -> SampleCode:
    return SampleCode()


#: Columns of an image of samples, and the least line that is worth a copy.
COLUMNS = 64
LEAST_COPY = 24
PART = COLUMNS * MOST_SIDE


def wrapped(stream: str) -> bytes:
    body = bytes([SIGNATURE]) + packed(stream)
    body += b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def copies(samples: bytes) -> list[tuple[int, int, int]]:
    """(begin, length, distance) of lines that stood in the samples before."""
    out, seen, at = [], {}, 0
    for line in samples.split(b"\n"):
        if len(line) >= LEAST_COPY:
            before = seen.setdefault(line, at)
            if before != at:
                out.append((at, len(line), at - before))
        at += len(line) + 1
    return out


def encode_samples(samples: bytes) -> bytes:
    """A file whose green plane is ``samples``, 64 to a row, coded by a palette and copied lines."""
    code = sample_code()
    counts = np.bincount(np.frombuffer(samples, "u1"), minlength=256)
    used = np.flatnonzero(counts)
    palette = used[np.argsort(-counts[used], kind="stable")]
    rank = np.zeros(256, "u1")
    rank[palette] = np.arange(len(palette))
    # A palette of up to 16 colours would pack pixels; a longer one keeps bytes.
    colours = palette.tolist() + [0] * (17 - len(palette))
    greens = [(a - b) & 255 for a, b in zip(colours, [0, *colours[:-1]], strict=True)]
    alpha = canonical([1] + [0] * 254 + [1])
    opaque = [number(*alpha[255])] + [number(*alpha[0])] * (len(colours) - 1)
    height = len(samples) // COLUMNS
    stream = [
        number(COLUMNS - 1, 14), number(height - 1, 14), "1000", "1", number(PALETTE, 2), number(len(colours) - 1, 8),
        code.palette_head, simple_code(255, 0), simple_code(0),
        *[code.flat[g] + a for g, a in zip(greens, opaque, strict=True)],
        "0", code.image_head,
    ]
    ranks, literal, at = samples.translate(rank.tobytes()), code.codes.__getitem__, 0

    def literals(piece: bytes) -> str:
        even = np.frombuffer(piece[: len(piece) & -2], "<u2").tolist()
        return "".join(map(code.pairs.__getitem__, even)) + "".join(map(literal, piece[len(piece) & -2 :]))

    for begin, length, distance in copies(samples):
        stream.append(literals(ranks[at:begin]))
        at = begin + length
        back, back_extra = value_code(distance + len(NEAR))
        for done in range(0, length, 4096):
            symbol, extra = value_code(min(4096, length - done))
            stream += [literal(LITERALS + symbol), extra, code.far[back], back_extra]
    stream.append(literals(ranks[at:]))
    return wrapped("".join(stream))


def store(samples: bytes) -> bytes:
    """Files behind each other that hold the samples, a multiple of 64."""
    return b"".join(encode_samples(samples[i : i + PART]) for i in range(0, len(samples), PART))


def load(files: bytes) -> bytes:
    """The samples that ``store`` was given."""
    out, at = [], 0
    while at < len(files):
        size = struct.unpack_from("<I", files, at + 4)[0] + 8
        out.append(np.ascontiguousarray(decode(files[at : at + size])[..., 2]).tobytes())
        at += size
    return b"".join(out)


def encode_image(
    image: np.ndarray, steps: list[tuple] = (), cache_bits: int = 0, block: int = 2, groups: np.ndarray | None = None
) -> bytes:
    """Any image (height, width, 4), by steps (kind, values of blocks); every choice that readers must follow."""
    height, width, _ = image.shape
    flat = number(0, 1) + number(15, 4) + "".join(number(1 if s in (8, 0) else 0, 3) for s in LENGTH_ORDER) + "0"

    def flat_code(alphabet: int) -> str:
        return flat + "".join("1" if s < 256 else "0" for s in range(alphabet))

    byte = [number(*c) for _, c in sorted(canonical([8] * 256).items())]

    def plain(pixels: np.ndarray, main: bool) -> str:
        head = "0" + ("0" if main else "") + flat_code(280) + flat_code(256) * 3 + simple_code(0)
        return head + "".join(byte[p[2]] + byte[p[1]] + byte[p[3]] + byte[p[0]] for p in pixels.reshape(-1, 4).tolist())

    stream = [number(width - 1, 14), number(height - 1, 14), "1000"]
    shift = block
    for kind, values in steps:
        stream += ["1", number(kind, 2)]
        if kind == PREDICTOR:
            picture = np.zeros((*values.shape, 4), "u1")
            picture[..., 2] = values
            stream += [number(shift - 2, 3), plain(picture, False)]
            image = predicted(image, values, shift, False)
        elif kind == CROSS_COLOUR:
            picture = np.zeros((*values.shape[:2], 4), "u1")
            picture[..., [3, 2, 1]] = values.astype("i1").view("u1")
            stream += [number(shift - 2, 3), plain(picture, False)]
            image = cross_coloured(image, values, shift, False)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 1] -= image[..., 2]
            image[..., 3] -= image[..., 2]
        else:
            deltas = np.diff(values.astype(int), axis=0, prepend=0).astype("u1")
            stream += [number(len(values) - 1, 8), plain(deltas, False)]
            bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
            index = (image[:, :, None, :] == values[None, None]).all(3).argmax(2)
            per, each = 1 << bits, 8 >> bits
            index = np.pad(index, ((0, 0), (0, -image.shape[1] % per))).reshape(height, -1, per)
            image = np.zeros((*index.shape[:2], 4), "u1")
            image[..., 2] = (index << np.arange(per) * each).sum(2)
    stream.append("0")
    if not cache_bits and groups is None:
        return wrapped("".join([*stream, plain(image, True)]))
    size = 280 + (1 << cache_bits if cache_bits else 0)
    wide = max(9, (size - 1).bit_length())
    lengths = [wide] * size
    spare = (1 << wide) - size
    for s in range(spare):
        lengths[s] -= 1
    greens = {s: number(*c) for s, c in canonical(lengths).items()}
    codes = written_code(lengths) + flat_code(256) * 3 + simple_code(0)
    stream += ["1" + number(cache_bits, 4) if cache_bits else "0"]
    if groups is None:
        stream += ["0", codes]
    else:
        picture = np.zeros((*groups.shape, 4), "u1")
        picture[..., 2] = groups
        stream += ["1", number(shift - 2, 3), plain(picture, False), codes * (int(groups.max()) + 1)]
    cache = [0] * (1 << cache_bits)
    for a, r, g, b in image.reshape(-1, 4).tolist():
        pixel = a << 24 | r << 16 | g << 8 | b
        key = (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0
        stream.append(greens[280 + key] if cache_bits and cache[key] == pixel else greens[g] + byte[r] + byte[b] + byte[a])
        cache[key] = pixel
    return wrapped("".join(stream))
