"""A small JPEG codec on numpy, after ITU-T T.81: enough for Motion JPEG.

Decodes baseline sequential frames (Huffman, 8 bits, any sampling factors, restart intervals) and lossless frames (predictors
1 to 7, one component). Encodes lossless frames with predictor 1 and a Huffman table by which every sample takes nine bits, so
that such frames are coded and decoded without a loop over samples.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed values of T.81, K.3, for luminance and chrominance: codes of each length, and the first symbols of the AC tables.
_DC_LENGTHS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
_AC_LENGTHS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
_AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)
_SIZES = np.arange(8, -1, -1, dtype=np.uint8)  # categories in the order of their code lengths 1 to 9
_DHT = b"\xff\xc4\x00\x1c\x00" + bytes([1] * 9 + [0] * 7) + _SIZES.tobytes()


def _nine_bits() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 to its nine bits, and back. Category c has the code of 8 - c ones and a zero, then c bits follow."""
    to, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = ((1 << (8 - c)) - 1) << 1
        bits = code << c | (d if d >= 0 else d + (1 << c) - 1)
        to[d + 255], back[bits] = bits, d
    return to, back


_TO, _BACK = _nine_bits()


def pack9(values: np.ndarray) -> bytes:
    """Nine-bit values, a multiple of eight of them, as bytes."""
    v = values.reshape(-1, 8)
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (v[:, k - 1] << (8 - k) & 0xFF) | v[:, k] >> (k + 1)
    out[:, 8] = v[:, 7] & 0xFF
    return out.tobytes()


def unpack9(data: bytes, count: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8, count // 8 * 9).reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        out[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 0x1FF
    return out.reshape(-1)


def encode_lossless(samples: np.ndarray) -> bytes:
    """A frame of 8-bit samples, height x width, whose number is a multiple of eight."""
    height, width = samples.shape
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, 1:] = s[:, 1:] - s[:, :-1]
    d[1:, 0] = s[1:, 0] - s[:-1, 0]
    d[0, 0] = s[0, 0] - 128
    scan = pack9(_TO[d.reshape(-1) + 255]).replace(b"\xff", b"\xff\x00")
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    return b"\xff\xd8" + _DHT + b"\xff\xc3\x00\x0b\x08" + size + b"\x01\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x01\x00\x00" + scan + b"\xff\xd9"


class _Bits:
    """Reads a scan's bits; zeros follow the end."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        got = self.bits[self.at : self.at + n]
        self.at += n
        value = 0
        for bit in got:
            value = value << 1 | bit
        return value << (n - len(got))

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            table[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _zigzag() -> np.ndarray:
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([y * 8 + x for y, x in order])


_ZIGZAG = _zigzag()
_K = np.arange(8)
_COS = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)


@cache
def _standard() -> dict[int, dict[tuple[int, int], int]]:
    """The tables of T.81, K.3, which Motion JPEG frames leave out: the common run and size pairs first, the others in order."""
    codes = {}
    for kind, (dc, ac, first) in enumerate(zip(_DC_LENGTHS, _AC_LENGTHS, _AC_FIRST, strict=True)):
        symbols = bytes.fromhex(first)
        rest = bytes(run << 4 | size for run in range(16) for size in range(1, 11) if run << 4 | size not in symbols)
        codes[kind], codes[0x10 | kind] = _huffman(dc, bytes(range(12))), _huffman(ac, symbols + rest)
    return codes


def decode(data: bytes) -> np.ndarray:
    """The frame's samples: height x width, or height x width x components (as coded, no colour conversion).

    A frame without Huffman tables has the standard ones. Damaged frames, and those whose scan can't hold their size, are a
    ``ValueError``.
    """
    try:
        return _decode(data)
    except (IndexError, KeyError, ZeroDivisionError, OverflowError, MemoryError) as e:
        raise ValueError(f"the frame is damaged: {e!r}") from e


def _decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    codes = dict(_standard())
    raw: dict[int, bytes] = {}
    at, kind, height, width, restart = 2, 0, 0, 0, 0
    parts: list[tuple[int, int, int, int]] = []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], raw[body[0]], body = _huffman(body[1:17], body[17 : 17 + n]), body[1 : 17 + n], body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15], body = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64), body[1 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC3):
            kind, height, width = marker, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker in (0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline and lossless Huffman frames are read")
        elif marker == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9", at)
            scan = data[at : end if end >= 0 else len(data)]
            if not height or not width or not parts or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in parts):
                raise ValueError("the frame has no size or a wrong sampling factor")
            if height * width > 8 * len(scan) * (1 if kind == 0xC3 else 32):  # a sample or a block takes a bit or two at least
                raise ValueError("the frame's scan is too short for its size")
            if kind == 0xC3:
                return _lossless(scan, height, width, body[1 + 2 * body[0]], codes[chosen[0][1] >> 4], raw.get(chosen[0][1] >> 4, b""))
            return _baseline(scan, height, width, parts, dict(chosen), quant, codes, restart)
    raise ValueError("the frame has no scan")


def _lossless(scan: bytes, height: int, width: int, predictor: int, table: dict, raw: bytes) -> np.ndarray:
    plain = scan.replace(b"\xff\x00", b"\xff")
    if raw == _DHT[5:] and height * width % 8 == 0 and predictor == 1:
        d = _BACK[unpack9(plain, height * width)].reshape(height, width).astype(np.int64)
        d[:, 0] = np.cumsum(d[:, 0]) + 128
        return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8)
    bits = _Bits(plain)
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            a, b, c = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            if not x or not y:
                guess = a if x else b if y else 128
            else:
                guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) // 2)[predictor]
            out[y, x] = (guess + bits.signed(bits.symbol(table))) & 0xFF
    return out.astype(np.uint8)


def _segments(scan: bytes) -> list[bytes]:
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, scan[start:]]]


def _baseline(scan: bytes, height: int, width: int, parts: list, chosen: dict, quant: dict, codes: dict, restart: int) -> np.ndarray:
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in parts]
    pieces = iter(_segments(scan))
    bits, before = _Bits(next(pieces)), [0] * len(parts)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a restart marker is missing")
            bits, before = _Bits(piece), [0] * len(parts)
        for i, (name, h, v, q) in enumerate(parts):
            dc, ac = codes[chosen[name] >> 4], codes[0x10 | chosen[name] & 15]
            for sub in range(h * v):
                block = np.zeros(64)
                before[i] += bits.signed(bits.symbol(dc))
                block[0] = before[i]
                k = 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    run, n = symbol >> 4, symbol & 15
                    if not n and run != 15:
                        break
                    k += run
                    if n:
                        block[k] = bits.signed(n)
                    k += 1
                square = np.zeros(64)
                square[_ZIGZAG] = block * quant[q]
                pixels = np.clip(np.rint(_COS @ square.reshape(8, 8) @ _COS.T) + 128, 0, 255)
                y, x = (unit // across * v + sub // h) * 8, (unit % across * h + sub % h) * 8
                planes[i][y : y + 8, x : x + 8] = pixels
    full = [np.repeat(np.repeat(p, most_v // v, 0), most_h // h, 1)[:height, :width] for p, (_, h, v, _) in zip(planes, parts, strict=True)]
    return (full[0] if len(full) == 1 else np.stack(full, -1)).astype(np.uint8)
