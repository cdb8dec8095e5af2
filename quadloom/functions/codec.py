"""Tile codecs in numpy: PNG, baseline JPEG, zstd alpha planes, and splitting and joining of bands."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_KINDS = {1: 0, 2: 4, 3: 2, 4: 6}


def split_alpha(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, w, 2 or 4) to colour (h, w, 1 or 3) and alpha (h, w)."""
    return pixels[:, :, :-1], pixels[:, :, -1]


def join_alpha(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.concatenate([colour, alpha[:, :, None]], axis=2)


def compress_alpha(alpha: np.ndarray) -> bytes:
    """zstd of the plane, nothing if it is opaque all over."""
    import zstandard

    return b"" if (alpha == 255).all() else zstandard.ZstdCompressor().compress(np.ascontiguousarray(alpha).tobytes())


def decompress_alpha(data: bytes, height: int, width: int) -> np.ndarray:
    import zstandard

    if not data:
        return np.full((height, width), 255, np.uint8)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=height * width), np.uint8).reshape(height, width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, level: int = 9) -> bytes:
    """Lossless PNG of (h, w, 1..4) bytes; each row takes the filter with the least sum of absolute differences."""
    h, w, bands = pixels.shape
    rows = pixels.reshape(h, w * bands).astype(np.int16)
    left = np.zeros_like(rows)
    left[:, bands:] = rows[:, :-bands]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, bands:] = rows[:-1, :-bands]
    pa, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    kinds = np.stack([(rows - p).astype(np.uint8) for p in (np.zeros_like(rows), left, up, (left + up) // 2, paeth)])
    best = np.abs(kinds.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    data = np.concatenate([best[:, None].astype(np.uint8), kinds[best, np.arange(h)]], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, PNG_KINDS[bands], 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, bands) of an 8-bit, not interlaced PNG without palette."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, idat, head = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            idat.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    bands = {v: k for k, v in PNG_KINDS.items()}.get(colour)
    if depth != 8 or interlace or bands is None:
        raise ValueError("only 8-bit gray, gray+alpha, RGB and RGBA without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    before = np.zeros(w * bands, np.uint8)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 1:
            row = np.add.accumulate(row.reshape(w, bands), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + before
        elif kind in (3, 4):
            row = row.copy()
            for i in range(w * bands):
                a, b = (int(row[i - bands]) if i >= bands else 0), int(before[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(before[i - bands]) if i >= bands else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (int(row[i]) + guess) & 255
        out[y] = before = row
    return out.reshape(h, w, bands)


# Fixed values of the JPEG standard (ITU-T T.81, annex K): quantisation tables and Huffman code lengths and symbols.
LUMA_Q = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA_Q = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"
DC_LUMA = ("00010501010101010100000000000000", "000102030405060708090a0b")


def _zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


def _quality(table: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), int) * scale + 50) // 100, 1, 255)


@lru_cache(maxsize=1)
def _dct() -> np.ndarray:
    k, n = np.mgrid[:8, :8]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def _canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits) of a canonical Huffman table; lengths: codes of 1, 2 ... 16 bits."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _ac_table() -> tuple[list[int], list[int]]:
    """One code for all AC symbols, made from a rule: symbols by run plus twice the size, in lengths that satisfy Kraft's bound."""
    symbols = sorted([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))], key=lambda v: (0, 0) if v == 0 else ((v >> 4) + 2 * (v & 15) + 6 * (v == 0xF0), v))
    lengths = [0, 1, 1, 2, 2, 4, 4, 6, 6, 10, 10, 14, 16, 24, 30]
    lengths.append(len(symbols) - sum(lengths))
    assert sum(n / 2**b for b, n in enumerate(lengths, 1)) < 1
    return lengths, symbols


def _tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    dc = ([int(DC_LUMA[0][i : i + 2], 16) for i in range(0, 32, 2)], list(bytes.fromhex(DC_LUMA[1])))
    return dc, _ac_table()


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def encode_jpeg(pixels: np.ndarray, quality: int = 85) -> bytes:
    """Baseline JPEG of (h, w, 1 or 3) bytes, without chroma subsampling."""
    h, w, bands = pixels.shape
    x = pixels.astype(float)
    if bands == 3:
        r, g, b = x[:, :, 0], x[:, :, 1], x[:, :, 2]
        x = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], axis=2)
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    hb, wb = x.shape[0] // 8, x.shape[1] // 8
    d, zigzag = _dct(), _zigzag()
    q = [_quality(LUMA_Q, quality), _quality(CHROMA_Q, quality)]
    coded = []
    for c in range(bands):
        blocks = x[:, :, c].reshape(hb, 8, wb, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        coded.append(np.rint((d @ blocks @ d.T).reshape(-1, 64) / q[c > 0])[:, zigzag].astype(int))
    dc_table, ac_table = _tables()
    dc, ac = _canonical(*dc_table), _canonical(*ac_table)
    bits, last = [], [0] * bands

    def put(code, n):
        bits.append(format(code, f"0{n}b"))

    def number(v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    for i in range(hb * wb):
        for c in range(bands):
            block = coded[c][i]
            n, v = number(int(block[0]) - last[c])
            last[c] = int(block[0])
            put(*dc[n])
            if n:
                put(v, n)
            run, places = 0, np.nonzero(block[1:])[0]
            before = -1
            for place in places.tolist():
                run, before = place - before - 1, place
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                n, v = number(int(block[place + 1]))
                put(*ac[run << 4 | n])
                put(v, n)
            if before < 62:
                put(*ac[0])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    for i in range(1 + (bands == 3)):
        out.append(_segment(0xDB, bytes([i, *q[i][zigzag].tolist()])))
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, bands) + b"".join(bytes([c + 1, 0x11, c > 0]) for c in range(bands))))
    for kind, (lengths, symbols) in ((0x00, dc_table), (0x10, ac_table)):
        out.append(_segment(0xC4, bytes([kind, *lengths, *symbols])))
    out.append(_segment(0xDA, bytes([bands]) + b"".join(bytes([c + 1, 0]) for c in range(bands)) + b"\0\x3f\0"))
    return b"".join([*out, body, b"\xff\xd9"])


def decode_jpeg(data: bytes) -> np.ndarray:
    """(h, w, 1 or 3) of a baseline JPEG; chroma may be subsampled."""
    at, q, tables, frame, scan, restart = 2, {}, {}, None, None, 0
    while scan is None:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                q[body[k] & 15] = np.frombuffer(body, np.uint8, 64, k + 1).astype(int)
                k += 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = list(body[k + 1 : k + 17])
                symbols = list(body[k + 17 : k + 17 + sum(lengths)])
                tables[body[k]] = {(bits, code): s for s, (code, bits) in _canonical(lengths, symbols).items()}
                k += 17 + sum(lengths)
        elif marker in (0xC0, 0xC1):
            h, w = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline JPEG is read")
        at += 2 + n
    raw = data[at : data.rindex(b"\xff\xd9")]
    pieces = [raw]
    if restart:
        import re

        pieces = re.split(rb"\xff[\xd0-\xd7]", raw)
    mh, mw = max(f[2] for f in frame), max(f[1] for f in frame)
    rows, cols = -(-h // (8 * mh)), -(-w // (8 * mw))
    if len(frame) == 1:
        frame, mh, mw = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
        rows, cols = -(-h // 8), -(-w // 8)
    planes = [np.zeros((rows * f[2] * 8, cols * f[1] * 8)) for f in frame]
    d, back = _dct(), np.argsort(_zigzag())
    mcu = 0
    for piece in pieces:
        piece = piece.replace(b"\xff\x00", b"\xff")
        bits, pos = int.from_bytes(piece, "big") if piece else 0, 0
        text = format(bits, f"0{8 * len(piece)}b") if piece else ""
        last = [0] * len(frame)

        def symbol(table):
            nonlocal pos
            code = 0
            for n in range(1, 17):
                code = code << 1 | (text[pos] == "1")  # noqa: B023
                pos += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("bad Huffman code")

        def value(n):
            nonlocal pos
            if not n:
                return 0
            v = int(text[pos : pos + n], 2)  # noqa: B023
            pos += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        for _ in range(restart or rows * cols):
            if mcu >= rows * cols:
                break
            my, mx = divmod(mcu, cols)
            for c, (ident, fw, fh, fq) in enumerate(frame):
                dc, ac = tables[scan[ident] >> 4], tables[0x10 | scan[ident] & 15]
                for by in range(fh):
                    for bx in range(fw):
                        block = np.zeros(64)
                        last[c] += value(symbol(dc))
                        block[0] = last[c]
                        k = 1
                        while k < 64:
                            s = symbol(ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                block[k] = value(s & 15)
                            k += 1
                        y0, x0 = (my * fh + by) * 8, (mx * fw + bx) * 8
                        planes[c][y0 : y0 + 8, x0 : x0 + 8] = d.T @ (block * q[fq])[back].reshape(8, 8) @ d
            mcu += 1
    full = [np.kron(p, np.ones((mh // f[2], mw // f[1])))[:h, :w] + 128 for p, f in zip(planes, frame, strict=True)]
    if len(full) == 3:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        full = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(full, axis=2)), 0, 255).astype(np.uint8)
