"""Progressive JPEG in numpy: an encoder of coefficient blocks, and a decoder that accumulates scans into coefficients.

Both work on many images at once. An entropy-coded segment is cut at its restart markers into intervals, which do not
depend on each other; the decoder advances all intervals of all images together, a symbol at a time.

The format is ITU-T T.81 (progressive mode, Huffman coding, 8-bit samples). Scans come by spectral selection and
successive approximation; images without restart markers decode too, as one interval for each scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Raster place of each coefficient: diagonals, every other one upwards."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in places])


ZIGZAG = _zigzag()
#: Bits of a code of the encoder: categories of DC, and run/size symbols of AC, short for what is frequent.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_SHORT = (0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07)
AC_LENGTHS = {s: 4 for s in AC_SHORT} | {s: 9 for s in [0xF0, *range(0x10, 0xF0, 0x10), 0x08, 0x09, 0x0A, *(r << 4 | s for r in range(1, 16) for s in range(1, 11))]}
#: Blocks of a group of four by component: luma is twice as fine as chroma, either way.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: MCUs in a row of an encoded image, as long as its height allows.
ROW_MCUS, MOST_ROWS = 64, 4095


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each symbol, and the table as DHT holds it."""
    order = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    code, last = np.zeros(256, np.uint64), 0
    size = np.zeros(256, np.int64)
    value = 0
    for s in order:
        value <<= lengths[s] - last if last else 0
        last = lengths[s]
        code[s], size[s] = value, last
        value += 1
    return code, size, bytes(sum(v == k for v in lengths.values()) for k in range(1, 17)) + bytes(order)


_DC_CODE, _DC_SIZE, _DC_TABLE = canonical(DC_LENGTHS)
_AC_CODE, _AC_SIZE, _AC_TABLE = canonical(AC_LENGTHS)


def bit_sizes(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.ceil(np.log2(np.abs(x).astype(np.float64) + 1)).astype(np.int64)


def pack_rows(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of codes, each row padded with ones to whole bytes, and the offsets of the rows.

    Codes of size 0 are 0. Neighbours are joined while two fit into 56 bits, so that few are left to place.
    """
    size = size.astype(np.uint8)
    while half := code.shape[1] // 2:
        left, right = slice(0, 2 * half, 2), slice(1, 2 * half, 2)
        both = size[:, left] + size[:, right]
        if (most := int(both.max(initial=0))) > 56:
            break
        kind = np.uint32 if most <= 32 else np.uint64
        code = np.concatenate((code[:, left].astype(kind) << size[:, right].astype(kind) | code[:, right].astype(kind), code[:, 2 * half :].astype(kind)), axis=1)
        size = np.concatenate((both, size[:, 2 * half :]), axis=1)
    code, size = code.astype(np.uint64), size.astype(np.int64)
    total = size.sum(axis=1)
    n_bytes = -(-total // 8)
    at = np.concatenate(([0], np.cumsum(n_bytes)))
    pad = 8 * n_bytes - total
    code = np.concatenate((code, ((1 << pad) - 1).astype(np.uint64)[:, None]), axis=1).ravel()
    size = np.concatenate((size, pad[:, None]), axis=1).ravel()
    offset = np.cumsum(size) - size
    word = offset >> 6
    free = 64 - (offset & 63) - size  # bits of the word behind the code, or less than 0: what lies in the next word
    words = np.zeros((int(at[-1]) >> 3) + 2, np.uint64)
    if len(word):
        first = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        own = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
        words[word[first]] = np.bitwise_or.reduceat(own, first)
        over = np.flatnonzero(free < 0)
        words[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: int(at[-1])], at


def joined_rows(whole: np.ndarray, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed rows in their order: those of ``whole`` from the first, all others from the second."""
    n_bytes = np.zeros(len(whole), np.int64)
    n_bytes[whole], n_bytes[~whole] = np.diff(one[1]), np.diff(other[1])
    mine = np.repeat(whole, n_bytes)
    out = np.zeros(len(mine), np.uint8)
    out[mine], out[~mine] = one[0], other[0]
    return out, np.concatenate(([0], np.cumsum(n_bytes)))


def with_markers(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes with stuffing and a restart marker between the rows of a group; offsets of the groups.

    group: first row of each group, and the number of rows.
    """
    rows = len(at) - 1
    lead = np.ones(rows, bool)
    lead[group[:-1]] = False  # a marker stands before the row
    within = np.arange(rows) - np.repeat(group[:-1], np.diff(group))
    full = np.flatnonzero(data == 0xFF)
    marks = np.full((int(lead.sum()), 2), 0xFF, np.uint8)
    marks[:, 1] = 0xD0 + ((within[lead] - 1) & 7)
    out = np.insert(data, np.concatenate((full + 1, np.repeat(at[:-1][lead], 2))), np.concatenate((np.zeros(len(full), np.uint8), marks.ravel())))
    edge = at[group]
    return out, edge + np.searchsorted(full, edge) + 2 * np.concatenate(([0], np.cumsum(lead)))[group]


def ac_first(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a band's first scan: v holds the shifted coefficients, a row for each block."""
    n, width = v.shape
    held = v != 0
    k = np.arange(width)
    before = np.maximum.accumulate(np.where(held, k, -1), axis=1)
    previous = np.concatenate((np.full((n, 1), -1), before[:, :-1]), axis=1)
    run = k - previous - 1
    bits = bit_sizes(v)
    symbol = np.where(held, (run & 15) << 4 | bits, 0)
    zrl, zrl_size = _AC_CODE[0xF0], int(_AC_SIZE[0xF0])
    longs = np.where(held, run >> 4, 0)
    code, size = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.int64)
    for j in range(1, 4):
        more = longs >= j
        code[:, :width] = np.where(more, code[:, :width] << np.uint64(zrl_size) | zrl, code[:, :width])
        size[:, :width] += more * zrl_size
    extra = np.where(v < 0, v + (1 << bits) - 1, v).astype(np.uint64)
    own = _AC_CODE[symbol] << bits.astype(np.uint64) | extra
    own_size = _AC_SIZE[symbol] + bits
    code[:, :width] = np.where(held, code[:, :width] << own_size.astype(np.uint64) | own, 0)
    size[:, :width] = np.where(held, size[:, :width] + own_size, 0)
    ends = before[:, -1] < width - 1
    code[:, width] = np.where(ends, _AC_CODE[0], 0)
    size[:, width] = np.where(ends, _AC_SIZE[0], 0)
    return code, size


def _short_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a byte, and for two (the first one low): size << 24 | code of coefficients of 2 to 128 in a band's first scan, without zeros between."""
    value = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int64)
    low = np.sign(value) * (np.abs(value) >> 1)
    bits = bit_sizes(low)
    code = (_AC_CODE[bits].astype(np.int64) << bits) | np.where(low < 0, low + (1 << bits) - 1, low)
    size = _AC_SIZE[bits] + bits
    first, second = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return (size << 24 | code).astype(np.uint32), (size[first] + size[second] << 24 | code[first] << size[second] | code[second]).astype(np.uint32)


_ONE, _TWO = _short_codes()


def whole_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ac_first(), of whole coefficients of 2 to 128 in int8: no runs, no end of band, and a table has the codes of two."""
    odd = c.shape[1] & 1
    part = _TWO[np.ascontiguousarray(c[:, odd:]).view("<u2")]
    if odd:
        part = np.concatenate((_ONE[c[:, :1].view(np.uint8)], part), axis=1)
    return part & np.uint32(0xFFFFFF), part >> np.uint32(24)


def whole_refined(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed rows of ac_refined(), of coefficients of 2 to 128 in int8: an end of band, then the last bit of each."""
    n, width = c.shape
    lead = int(_AC_SIZE[0])
    bits = np.ones((n, -(-(lead + width) // 8) * 8), np.uint8)
    bits[:, :lead] = [int(_AC_CODE[0]) >> (lead - 1 - j) & 1 for j in range(lead)]
    bits[:, lead : lead + width] = c.view(np.uint8) & np.uint8(1)
    out = np.packbits(bits, axis=1)
    return out.ravel(), np.arange(n + 1) * out.shape[1]


def _run_codes() -> np.ndarray:
    """By run << 8 | byte: size << 24 | code of a coefficient after so many zeros, up to 15, in a band's first scan."""
    value = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int64)
    low = np.sign(value) * (np.abs(value) >> 1)
    bits = bit_sizes(low)
    symbol = np.arange(16)[:, None] << 4 | bits
    found = (_AC_SIZE[symbol] + bits) << 24 | (_AC_CODE[symbol].astype(np.int64) << bits) | np.where(low < 0, low + (1 << bits) - 1, low)
    return np.where(low != 0, found, 0).astype(np.uint32).ravel()


_RUN = _run_codes()


def narrow_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ac_first(), of whole coefficients in int8, and which rows have longer runs than a symbol names: those are not coded."""
    n, width = c.shape
    byte = c.view(np.uint8)
    held = (byte + np.uint8(1)) > 2
    k = np.arange(width, dtype=np.int8)
    before = np.maximum.accumulate(np.where(held, k, np.int8(-1)), axis=1)
    run = np.zeros((n, width), np.int8)
    run[:, 1:] = k[1:] - before[:, :-1] - 1
    long = (held & (run > 15)).any(axis=1)
    part = np.zeros((n, width + 1), np.uint32)
    part[:, :width] = _RUN[(run & np.int8(15)).astype(np.uint16) << 8 | byte]
    part[before[:, -1] < width - 1, width] = int(_AC_SIZE[0]) << 24 | int(_AC_CODE[0])
    return part & np.uint32(0xFFFFFF), part >> np.uint32(24), long


def narrow_refined(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ac_refined(), of coefficients in int8."""
    n, width = c.shape
    byte = c.view(np.uint8)
    known, zero = (byte + np.uint8(1)) > 2, byte == 0
    zeros = np.zeros((n, width + 1), np.int8)
    np.cumsum(zero, axis=1, out=zeros[:, 1:])
    row, place = np.nonzero(~known & ~zero)  # the new ones; a header stands behind the one before
    head = np.zeros(len(row), np.int64)
    head[1:] = np.where(row[1:] == row[:-1], place[:-1] + 1, 0)
    start = zeros[row, head].astype(np.int64)
    run = zeros[row, place] - start
    code, size = np.zeros((n, width + 1), np.uint32), np.zeros((n, width + 1), np.uint8)
    # 16 zeros each of a longer run take a header, and what follows has its own behind them.
    zero_row, zero_place = np.nonzero(zero)
    for j in range(int(run.max(initial=0)) >> 4):
        more = np.flatnonzero(run >> 4 > j)
        code[row[more], head[more]], size[row[more], head[more]] = _AC_CODE[0xF0], _AC_SIZE[0xF0]
        head[more] = zero_place[np.searchsorted(zero_row, row[more]) + start[more] + 16 * j + 15] + 1
    symbol = (run & 15) << 4 | 1
    code[row, head] = _AC_CODE[symbol] << np.uint64(1) | (c[row, place] > 0)
    size[row, head] = _AC_SIZE[symbol] + 1
    end = np.zeros(n, np.int64)
    end[row] = place + 1  # the last one counts
    rest = np.flatnonzero(end < width)
    code[rest, end[rest]], size[rest, end[rest]] = _AC_CODE[0], _AC_SIZE[0]
    code, size = code[:, :width], size[:, :width]
    return code << known | (byte & known), size + known


def packed_band(c: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed rows of a band's first scan or of its refinement: c holds the whole coefficients, a row for each block.

    Bytes of text are mostly 2 or more from the middle of their range; rows of only such go by tables of two, others in int8
    by tables of one.
    """

    def general(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = c.astype(np.int64)
        return pack_rows(*(ac_refined(wide) if high else ac_first(np.sign(wide) * (np.abs(wide) >> 1))))

    def narrow(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if high:
            return pack_rows(*narrow_refined(c))
        code, size, long = narrow_first(c)
        return joined_rows(~long, pack_rows(code[~long], size[~long]), general(c[long])) if long.any() else pack_rows(code, size)

    if c.dtype != np.int8:
        return general(c)
    whole = ((c.view(np.uint8) + np.uint8(1)) > 2).all(axis=1)
    if whole.all():
        return whole_refined(c) if high else pack_rows(*whole_first(c))
    own = c[whole]
    return joined_rows(whole, whole_refined(own) if high else pack_rows(*whole_first(own)), narrow(c[~whole]))


def ac_refined(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a band's last refinement (Ah 1, Al 0): c holds the whole coefficients, a row for each block."""
    n, width = c.shape
    m = np.abs(c)
    known, new, zero = m > 1, m == 1, m == 0
    k = np.arange(width)
    head = np.concatenate((np.ones((n, 1), bool), new[:, :-1]), axis=1)  # a header stands before this place
    after = np.minimum.accumulate(np.where(new, k, width)[:, ::-1], axis=1)[:, ::-1]  # the next new one
    zeros = np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(zero, axis=1)), axis=1)
    run = np.take_along_axis(zeros, after, axis=1) - zeros[:, :-1]
    symbol = np.where(after < width, (run & 15) << 4 | 1, 0)
    sign = (np.take_along_axis(c, np.minimum(after, width - 1), axis=1) > 0).astype(np.uint64)
    header = np.where(after < width, _AC_CODE[symbol] << np.uint64(1) | sign, _AC_CODE[0])
    header_size = np.where(after < width, _AC_SIZE[symbol] + 1, _AC_SIZE[0])
    code = np.where(head, header, 0)
    size = np.where(head, header_size, 0)
    code = np.where(known, code << np.uint64(1) | (m & 1).astype(np.uint64), code)
    size = size + known
    # Runs over 15 take marks of 16 zeros each, with the corrections that lie among them: such blocks one by one.
    for i in np.flatnonzero((head & (after < width) & (run > 15)).any(axis=1)).tolist():
        code[i], size[i] = 0, 0
        out: list[tuple[int, int]] = []
        held: list[int] = []
        gone, last_new = 0, max(np.flatnonzero(new[i]).tolist())
        for j in range(width):
            if zero[i, j] and j < last_new:
                if gone == 15:
                    out += [(int(_AC_CODE[0xF0]), int(_AC_SIZE[0xF0])), *((b, 1) for b in held)]
                    gone, held = 0, []
                else:
                    gone += 1
            elif known[i, j]:
                held.append(int(m[i, j] & 1))
            elif new[i, j]:
                s = gone << 4 | 1
                out += [(int(_AC_CODE[s]) << 1 | int(c[i, j] > 0), int(_AC_SIZE[s]) + 1), *((b, 1) for b in held)]
                gone, held = 0, []
        if last_new < width - 1:
            out += [(int(_AC_CODE[0]), int(_AC_SIZE[0])), *((b, 1) for b in held)]
        # A row has a place for each coefficient; what is over joins its neighbours.
        places: list[list[int]] = [[0, 0] for _ in range(width)]
        for j, (value, bits) in enumerate(out):
            p = places[j * width // max(width, len(out))]
            p[0], p[1] = p[0] << bits | value, p[1] + bits
        code[i], size[i] = [p[0] for p in places], [p[1] for p in places]
    return code, size


def dc_first(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DC differences."""
    bits = bit_sizes(v)
    extra = np.where(v < 0, v + (1 << bits) - 1, v).astype(np.uint64)
    return _DC_CODE[bits] << bits.astype(np.uint64) | extra, _DC_SIZE[bits] + bits


def geometry(blocks: int) -> tuple[int, int]:
    """MCUs across and down of the image for so many blocks."""
    mcus = -(-blocks // 6)
    across = min(mcus, max(ROW_MCUS, -(-mcus // MOST_ROWS)))
    return across, -(-mcus // across)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: The scans of an encoded image: components, first and last coefficient, high and low bit of the approximation.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))] + [((0, 1, 2), 0, 0, 1, 0)] + [((c,), 1, 63, 1, 0) for c in range(3)]


@lru_cache(512)
def mcu_places(across: int, down: int) -> np.ndarray:
    """Block of each place of each MCU, all components end to end: four of luma, one of each chroma."""
    y, x = np.divmod(np.arange(across * down), across)
    luma = [(2 * y + v) * 2 * across + 2 * x + h for v in range(2) for h in range(2)]
    n = across * down
    return np.stack([*luma, 4 * n + np.arange(n), 5 * n + np.arange(n)], axis=1)


def encode_images(coefficients: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """Progressive JPEGs of images whose coefficient blocks (rows of 64 in zigzag order) are given, luma first.

    Missing blocks of the last MCUs are zero. Quantisation is 1 throughout. Every MCU is a restart interval. Coefficients
    in int8 go the short way; the bytes are the same.
    """
    shapes = [geometry(len(c)) for c in coefficients]
    whole = [6 * a * d for a, d in shapes]
    base = np.concatenate(([0], np.cumsum(whole)))
    narrow = all(c.dtype == np.int8 for c in coefficients)
    every = np.zeros((int(base[-1]), 64), np.int8 if narrow else np.int64)
    for c, b in zip(coefficients, base[:-1].tolist(), strict=True):
        every[b : b + len(c)] = c
    mcus = np.array([a * d for a, d in shapes])
    mcu_at = np.concatenate(([0], np.cumsum(mcus)))
    places = np.concatenate([mcu_places(a, d) + b for (a, d), b in zip(shapes, base[:-1].tolist(), strict=True)])
    scans, bands = [], []
    for c in range(3):
        start, count = (base[:-1], 4 * mcus) if c == 0 else (base[:-1] + (3 + c) * mcus, mcus)
        group = np.concatenate(([0], np.cumsum(count)))
        bands.append((every[np.repeat(start - group[:-1], count) + np.arange(int(group[-1]))], group))
    dc = every[places, 0].astype(np.int64)
    for components, first, last, high, _ in SCRIPT:
        if first == 0:
            if not high:
                v = dc >> 1
                v[:, 1:4] -= (dc >> 1)[:, 0:3]
                code, size = dc_first(v)
            else:
                code, size = (dc & 1).astype(np.uint64), np.ones(dc.shape, np.int64)
            packed, group = pack_rows(code, size), mcu_at
        else:
            own, group = bands[components[0]]
            packed = packed_band(own[:, first : last + 1], high)
        scans.append(with_markers(*packed, group))
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xDD, b"\0\1")
    heads = [_segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | bit])) for components, first, last, high, bit in SCRIPT]
    files = [(head, data.tobytes(), at.tolist()) for head, (data, at) in zip(heads, scans, strict=True)]
    out = []
    for i, ((across, down), comment) in enumerate(zip(shapes, comments, strict=True)):
        frame = b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03" + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(SAMPLING))
        parts = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, comment), tables, _segment(0xC2, frame)]
        for head, data, at in files:
            parts += (head, data[at[i] : at[i + 1]])
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


@dataclass(slots=True)
class Component:
    ident: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks of the component
    down: int = 0
    padded: int = 0  # blocks in a row, whole MCUs
    base: int = 0  # first block among those of all images


@dataclass(slots=True)
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    restart: int
    tables: tuple[bytes, ...]
    data: bytes


@dataclass(slots=True)
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    mcus: tuple[int, int] = (0, 0)


#: A marker that ends entropy-coded data: neither a stuffed byte nor a restart.
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


@lru_cache(64)
def _quantisers(body: bytes) -> dict[int, np.ndarray]:
    found = {}
    while body:
        wide = body[0] >> 4
        n = 64 * (1 + wide)
        found[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
        body = body[1 + n :]
    return found


@lru_cache(64)
def _huffman_tables(body: bytes) -> dict[int, bytes]:
    found = {}
    while body:
        n = 17 + sum(body[1:17])
        found[body[0]] = body[1:n]
        body = body[n:]
    return found


def parse(source: bytes) -> Image:
    """Headers and scans of a progressive JPEG."""
    if source[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, places, restart, at = Image(), {}, {}, 0, 2
    while at < len(source):
        if source[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = source[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(source[at + 2 : at + 4], "big")
        body = source[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            image.quantisers |= _quantisers(body)
        elif marker == 0xC4:
            tables |= _huffman_tables(body)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            places = {c.ident: k for k, c in reversed(list(enumerate(image.components)))}
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            image.mcus = (-(-image.width // (8 * h)), -(-image.height // (8 * v)))
            for c in image.components:
                c.across, c.down = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
                c.padded = image.mcus[0] * c.h
        elif marker in range(0xC0, 0xD0):
            raise ValueError("only progressive Huffman-coded images are decoded")
        elif marker == 0xDA:
            n = body[0]
            chosen = tuple([places[body[1 + 2 * j]] for j in range(n)])
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            if not first <= last < 64:
                raise ValueError("a scan's band is none")
            own = tuple([tables.get(body[2 + 2 * j] >> 4 if first == 0 else 16 | body[2 + 2 * j] & 15, b"") for j in range(n)])
            after = _NEXT_MARKER.search(source, at)
            end = after.start() if after else len(source)
            image.scans.append(Scan(chosen, first, last, bits >> 4, bits & 15, restart, own, source[at:end]))
            at = end
    return image


_lookups: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits."""
    if table not in _lookups:
        symbol, size, value, k = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64), 0, 16
        for bits in range(1, 17):
            for _ in range(table[bits - 1]):
                a, b = value << (16 - bits), (value + 1) << (16 - bits)
                symbol[a:b], size[a:b] = table[k], bits
                value, k = value + 1, k + 1
            value <<= 1
        _lookups[table] = symbol, size
    return _lookups[table]


_quick: dict[bytes, np.ndarray] = {}


def quick_lookup(table: bytes) -> np.ndarray:
    """For every 16 bits that begin with a symbol of a first scan, and its own bits: value << 12 | run << 5 | length; else 0.

    16 zeros are a run of 15 before a value 0; an end of band is a run over the block.
    """
    if table not in _quick:
        symbol, size = lookup(table)
        ahead = np.arange(1 << 16)
        run, n = symbol >> 4, symbol & 15
        length = size + n
        held, zeros, end = (n > 0) & (length <= 16), symbol == 0xF0, (symbol == 0) & (size < 16)
        bits = np.where(held, n, 1)
        value = np.where(held, extended(ahead >> np.where(held, 16 - length, 0) & (1 << bits) - 1, bits), 0)
        _quick[table] = np.where(held | zeros | end, value << 12 | np.where(end, 64, run) << 5 | length, 0)
    return _quick[table]


class Bits:
    """Entropy-coded bytes without stuffing, read at many places at once."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        """starts: where the images' segments begin in ``raw``. Intervals: image of each, and its first bit."""
        full = np.flatnonzero(raw == 0xFF)
        after = np.append(raw, np.uint8(1))[full + 1]
        mark = full[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.sort(np.concatenate((mark, mark + 1, full[after == 0] + 1)))
        begin = np.sort(np.concatenate((starts, mark + 2)))
        self.image = np.searchsorted(starts, begin, "right") - 1
        self.start = (begin - np.searchsorted(drop, begin)) * 8
        kept = np.ones(len(raw), bool)
        kept[drop] = False
        data = np.concatenate((raw[kept], np.full(8, 0xFF, np.uint8)))
        #: The 32 bits from each byte on.
        self.words = np.ndarray(len(data) - 3, ">u4", data, strides=(1,)).astype(np.uint32)
        self.most = 8 * (len(self.words) - 1)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits from each place."""
        at = np.minimum(at, self.most)
        return ((self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.peek(at) >> (16 - n)

    def next_bits(self, at: np.ndarray, n: int) -> np.ndarray:
        """The next n bits from each place, a row for each."""
        out = np.zeros((len(at), -(-n // 16)), ">u2")
        for j in range(out.shape[1]):
            out[:, j] = self.peek(at + 16 * j)
        return np.unpackbits(out.view(np.uint8), axis=1, count=n)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _scan_blocks(images: list[Image], chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of the images' scans of these components in the order of their data, where each image's begin, and how many make up an MCU."""
    own = [[x.components[k] for k in chosen] for x in images]
    if len(chosen) == 1:
        listed, slots = [c.base + _single_places(c.across, c.down, c.padded) for (c,) in own], 1
    else:
        listed, slots = [], sum(c.h * c.v for c in own[0])
        for x, parts in zip(images, own, strict=True):
            places, component = _mcu_scan(*x.mcus, tuple([(c.h, c.v, c.padded) for c in parts]))
            listed.append(places + np.array([c.base for c in parts])[component])
    return np.concatenate(listed), np.cumsum([0] + [len(b) for b in listed]), slots


@lru_cache(512)
def _single_places(across: int, down: int, padded: int) -> np.ndarray:
    y, x = np.divmod(np.arange(across * down), across)
    return y * padded + x


@lru_cache(512)
def _mcu_scan(across: int, down: int, shapes: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in their components, MCU by MCU, and the component of each."""
    y, x = np.divmod(np.arange(across * down), across)
    parts = [((y * v + j) * padded + x * h + i, k) for k, (h, v, padded) in enumerate(shapes) for j in range(v) for i in range(h)]
    return np.stack([p for p, _ in parts], axis=1).ravel(), np.tile([k for _, k in parts], across * down)


def _decode_dc(bits: Bits, scan: Scan, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, slots: np.ndarray, slot_component: np.ndarray, coefficients: np.ndarray) -> None:
    """Intervals of a DC scan: ``slots`` blocks an MCU, of the scan's components in turn."""
    at, done = bits.start.copy(), np.zeros(len(first), np.int64)
    previous = np.zeros((len(first), len(scan.components)), np.int64)
    live = np.flatnonzero(count > 0)
    tables = [lookup(t) if t else (np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)) for t in scan.tables]
    step = 0
    while len(live):
        component = int(slot_component[step % slots])
        block = blocks[first[live] + step]
        if scan.high:
            coefficients[block, 0] |= bits.take(at[live], 1) << scan.low
            at[live] += 1
        else:
            symbol, size = tables[component]
            code = bits.peek(at[live])
            n = symbol[code]
            value = extended(np.where(n > 0, bits.take(at[live] + size[code], np.maximum(n, 1)), 0), n)
            at[live] += size[code] + n
            previous[live, component] += np.where(n > 0, value, 0)
            coefficients[block, 0] = previous[live, component] << scan.low
        step += 1
        live = live[count[live] > step]
    del done


def _decode_blocks(bits: Bits, scan: Scan, rows: np.ndarray, at: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's band of each interval, up to a symbol that quick_lookup() lacks; gives the place, and the coefficient it stands at."""
    quick, words = quick_lookup(scan.tables[0]), bits.words
    room = 64 + 64 + 1  # what steps over the band lands behind it
    found = np.zeros(len(rows) * room, np.int16)
    last_at, last_k = at.copy(), np.full(len(rows), scan.first)
    live, at, k = np.arange(len(rows)), at.copy(), np.arange(len(rows)) * room + scan.first
    over = np.arange(len(rows)) * room + scan.last
    while len(live):
        ahead = words.take(at >> 3, mode="clip")
        ahead <<= (at & 7).astype(np.uint32)
        ahead >>= np.uint32(16)
        own = quick.take(ahead)
        at += own & 31
        k += own >> 5 & 127
        found[k] = own >> 12
        k += own != 0
        stay = (k <= over) & (own != 0)
        if not stay.all():
            gone = np.flatnonzero(~stay)
            last_at[live[gone]], last_k[live[gone]] = at[gone], k[gone] - live[gone] * room
            live, at, k, over = live[stay], at[stay], k[stay], over[stay]
    band = found.reshape(len(rows), room)[:, scan.first : scan.last + 1]
    coefficients[rows, scan.first : scan.last + 1] = band << scan.low
    return last_at, last_k


def _decode_ac(bits: Bits, scan: Scan, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, coefficients: np.ndarray) -> None:
    """Intervals of a band's first scan: the first block of each by whole symbols, then what is left by their parts."""
    symbol, size = lookup(scan.tables[0])
    live = np.flatnonzero(count > 0)
    at, block = bits.start[live], first[live]
    end = first[live] + count[live]
    at, k = _decode_blocks(bits, scan, blocks[block], at, coefficients)
    full = k > scan.last
    block = block + full
    k = np.where(full, scan.first, k)
    keep = block < end
    at, k, block, end = at[keep], k[keep], block[keep], end[keep]
    while len(at):
        code = bits.peek(at)
        s = symbol[code]
        at = at + size[code]
        run, n = s >> 4, s & 15
        held = n > 0
        k = k + np.where(held | (run == 15), run, 0)
        good = held & (k <= scan.last)
        value = extended(bits.take(at, np.maximum(n, 1)), n)
        coefficients[blocks[block[good]], k[good]] = value[good] << scan.low
        over = ~held & (run < 15)
        skipped = np.where(over & (run > 0), (1 << run) - 1 + bits.take(at, np.maximum(run, 1)), 0)
        at = at + np.where(held, n, np.where(over, run, 0))
        k = k + 1
        ends = over | (k > scan.last)
        block = block + np.where(ends, 1 + skipped, 0)
        k = np.where(ends, scan.first, k)
        keep = block < end
        if not keep.all():
            at, k, block, end = at[keep], k[keep], block[keep], end[keep]


def _corrected(bits: Bits, at: np.ndarray, rows: np.ndarray, k: np.ndarray, scan: Scan, coefficients: np.ndarray, run: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Correct all known coefficients from k on, with ``run`` only up to a place that so many zeros lie before.

    Gives the place behind the correction bits, and the coefficient that was reached.
    """
    band = coefficients[rows, scan.first : scan.last + 1]
    column = np.arange(scan.first, scan.last + 1)
    ahead = column >= k[:, None]
    known = (band != 0) & ahead
    reached = np.full(len(rows), scan.last + 1)
    if run is not None:
        before = np.cumsum(~known & ahead, axis=1, dtype=np.int8) <= run[:, None]
        known &= before
        reached = scan.first + np.count_nonzero(before, axis=1)
    bit = bits.next_bits(at, band.shape[1])
    part = np.flatnonzero(~known.all(axis=1))  # elsewhere, every coefficient has its bit in turn
    if len(part):
        own = known[part]
        bit[part] = np.take_along_axis(bit[part], np.maximum(np.cumsum(own, axis=1) - 1, 0), axis=1) & own
    fresh = bit.view(bool) & ((np.abs(band) >> scan.low) & 1 == 0)
    coefficients[rows, scan.first : scan.last + 1] = band + fresh * (np.sign(band) << scan.low)
    return at + np.count_nonzero(known, axis=1), reached


def _refine_ac(bits: Bits, scan: Scan, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, coefficients: np.ndarray) -> None:
    """Intervals of a band's refinement."""
    symbol, size = lookup(scan.tables[0])
    live = np.flatnonzero(count > 0)
    at, k, block = bits.start[live].copy(), np.full(len(live), scan.first), first[live].copy()
    end = first[live] + count[live]
    run, sign, inside = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), bool)
    skip = np.zeros(len(live), np.int64)  # blocks with corrections only
    turn = 0
    while len(at):
        # Whole blocks of corrections, after an end of band.
        rest = np.flatnonzero(skip > 0)
        if len(rest):
            at[rest], _ = _corrected(bits, at[rest], blocks[block[rest]], k[rest], scan, coefficients)
            skip[rest] -= 1
            block[rest] += 1
            k[rest] = scan.first
        # A new symbol.
        fresh = np.flatnonzero((skip == 0) & ~inside & (block < end))
        if len(fresh):
            code = bits.peek(at[fresh])
            s = symbol[code]
            at[fresh] += size[code]
            r, n = s >> 4, s & 15
            over = (n == 0) & (r < 15)
            wide = over & (r > 0)
            skip[fresh] = np.where(over, 1 + np.where(wide, (1 << r) - 1 + bits.take(at[fresh], np.maximum(r, 1)), 0), 0)
            at[fresh] += np.where(over, r, 0)
            new = n > 0
            sign[fresh] = np.where(new, np.where(bits.take(at[fresh], 1) == 1, 1, -1), 0)
            at[fresh] += new
            run[fresh] = r
            inside[fresh] = ~over
        way = np.flatnonzero(inside)
        turn += 1
        if len(way) and turn <= 8:  # all on the way to the symbol's place
            row = blocks[block[way]]
            at[way], place = _corrected(bits, at[way], row, k[way], scan, coefficients, run[way])
            here = place <= scan.last
            coefficients[row[here], place[here]] = sign[way[here]] << scan.low
            past = place >= scan.last
            inside[way] = False
            block[way] += past
            k[way] = np.where(past, scan.first, place + 1)
        elif len(way):  # one coefficient: where blocks have many new ones, that is less than a band for each
            row = blocks[block[way]]
            value = coefficients[row, k[way]].astype(np.int64)
            known = value != 0
            bit = bits.take(at[way], 1)
            grown = known & (bit == 1) & ((np.abs(value) >> scan.low) & 1 == 0)
            at[way] += known
            here = ~known & (run[way] == 0)
            coefficients[row, k[way]] = np.where(here, sign[way] << scan.low, value + np.where(grown, np.sign(value) << scan.low, 0))
            run[way] -= ~known & ~here
            k[way] += 1
            past = k[way] > scan.last
            inside[way] = ~(here | past)
            block[way] += past
            k[way] = np.where(past, scan.first, k[way])
        keep = block < end
        if not keep.all():
            at, k, block, end, run, sign, inside, skip = (x[keep] for x in (at, k, block, end, run, sign, inside, skip))


def decode_coefficients(sources: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Parsed images, and the coefficient blocks of all their components, in zigzag order, as the scans add up to."""
    images = [parse(s) for s in sources]
    total = 0
    for image in images:
        for c in image.components:
            c.base = total
            total += c.padded * image.mcus[1] * c.v
    coefficients = np.zeros((total, 64), np.int16)
    # Images with the same scans go together, scan by scan.
    groups: dict[tuple, list[Image]] = {}
    for image in images:
        script = tuple([(s.components, s.first, s.last, s.high, s.low, s.restart, s.tables) for s in image.scans])
        groups.setdefault((script, tuple([(c.h, c.v) for c in image.components])), []).append(image)
    for own in groups.values():
        known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, int]] = {}
        for turn, scan in enumerate(own[0].scans):
            data = [x.scans[turn].data for x in own]
            starts = np.cumsum([0] + [len(d) for d in data])
            bits = Bits(np.frombuffer(b"".join(data), np.uint8), starts[:-1])
            if scan.components not in known:
                known[scan.components] = _scan_blocks(own, scan.components)
            blocks, edge, slots = known[scan.components]
            # An interval has ``restart`` MCUs, the last of an image what is left.
            each = np.full(len(own), scan.restart * slots) if scan.restart else np.diff(edge)
            index = np.arange(len(bits.image)) - np.searchsorted(bits.image, bits.image)
            first = edge[bits.image] + index * each[bits.image]
            count = np.clip(edge[bits.image + 1] - first, 0, each[bits.image])
            if scan.first == 0:
                sampling = [own[0].components[c] for c in scan.components]
                turns = np.array([k for k, c in enumerate(sampling) for _ in range(c.h * c.v)]) if len(sampling) > 1 else np.zeros(1, np.int64)
                _decode_dc(bits, scan, blocks, first, count, slots, turns, coefficients)
            elif scan.high:
                _refine_ac(bits, scan, blocks, first, count, coefficients)
            else:
                _decode_ac(bits, scan, blocks, first, count, coefficients)
    return images, coefficients


def _basis() -> np.ndarray:
    """Inverse transform of 64 zigzag coefficients to 64 samples, times 2**13, in whole numbers: sums of products are then exact."""
    k, x = np.arange(8), np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)[:, None]
    whole = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(whole[ZIGZAG] * 8192)


_BASIS = _basis()
#: Whole numbers are exact in single precision below 2**24: sums of coefficients up to this one are.
_SINGLE, _SINGLE_MOST = _BASIS.astype(np.float32), int(((1 << 24) - 8192) / np.abs(_BASIS).sum(axis=0).max())


def samples(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks: an array of (block, 8, 8)."""
    scaled = coefficients if (quantiser == 1).all() else coefficients * quantiser
    if scaled.max(initial=0) <= _SINGLE_MOST and scaled.min(initial=0) >= -_SINGLE_MOST:
        out = ((scaled.astype(np.float32) @ _SINGLE).astype(np.int32) + 4096 >> 13) + 128
    else:
        out = np.floor((scaled.astype(np.float64) @ _BASIS + 4096) / 8192) + 128
    return np.clip(out, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


@dataclass(slots=True)
class Strip:
    """Images of one height side by side: which, the first column and the width of each, and planes of 8-bit red, green and blue."""

    images: list[int]
    left: list[int]
    width: list[int]
    planes: tuple[np.ndarray, np.ndarray, np.ndarray]


def _spread(plane: np.ndarray, down: int, across: int) -> np.ndarray:
    """Every sample repeated."""
    if down == across == 1:
        return plane
    out = np.empty((plane.shape[0] * down, plane.shape[1] * across), plane.dtype)
    for j in range(down):
        for i in range(across):
            out[j::down, i::across] = plane
    return out


def rgb_strips(images: list[Image], coefficients: np.ndarray) -> Iterator[Strip]:
    """All images in RGB: samples, chroma repeated to full resolution, colours converted. What is equal in height and sampling goes together."""
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault((image.height, image.mcus[1], tuple([(c.h, c.v, image.quantisers[c.table].tobytes()) for c in image.components])), []).append(i)
    for (height, down, _), own in groups.items():
        parts = [images[i] for i in own]
        h, v = max(c.h for c in parts[0].components), max(c.v for c in parts[0].components)
        planes = []
        for k, c in enumerate(parts[0].components[:3]):
            padded = np.array([x.components[k].padded for x in parts])
            ends = np.cumsum(padded)
            rows, across = down * c.v, int(ends[-1])
            base = np.array([x.components[k].base for x in parts]) - (ends - padded)
            blocks = np.repeat(base, padded) + np.arange(across) + np.arange(rows)[:, None] * np.repeat(padded, padded)
            found = samples(coefficients[blocks.ravel()], parts[0].quantisers[c.table])
            planes.append(found.reshape(rows, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * across))
        steps = [(v // c.v, h // c.h) for c in parts[0].components]
        y = _spread(planes[0], *steps[0])[:height]
        if len(planes) < 3:
            rgb = (y, y, y)
        else:
            same = steps[1] == steps[2]  # the conversion of what both have, before it is repeated
            b, r = (p.astype(np.int32) - 128 for p in (planes[1:] if same else map(_spread, planes[1:], *zip(*steps[1:3], strict=True))))
            # The conversion of JFIF, times 2**16.
            shifts = (91881 * r + 32768 >> 16, -(22554 * b + 46802 * r + 32768 >> 16), 116130 * b + 32768 >> 16)
            y = y.astype(np.int16)
            rgb = tuple(np.clip(y + _spread(x.astype(np.int16), *(steps[1] if same else (1, 1)))[:height], 0, 255).astype(np.uint8) for x in shifts)
        left = np.cumsum([0] + [8 * h * x.mcus[0] for x in parts]).tolist()
        yield Strip(own, left[:-1], [x.width for x in parts], rgb)


def rgb_tensor(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The image as (height, width, 3) of 8-bit RGB."""
    strip = next(rgb_strips([image], coefficients))
    return np.stack([p[:, : image.width] for p in strip.planes], axis=2)
