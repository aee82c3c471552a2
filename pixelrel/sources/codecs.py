"""Bytes of FITS, NPY and uncompressed TIFF files to arrays and back; small helpers inside tasks."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_FITS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}  # fixed values of the format: BITPIX to type


def read_fits(data: bytes) -> np.ndarray:
    """The primary array of a FITS file, scaled by BSCALE and BZERO, as float32; raises ValueError for anything else."""
    cards, at = {}, 0
    if data[:6] != b"SIMPLE":
        raise ValueError("not FITS")
    while "END" not in cards:
        block = data[at : at + 2880]
        if len(block) < 2880:
            raise ValueError("header ends early")
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            name = card[:8].strip()
            cards.setdefault(name, card[10:].split("/")[0].strip())
            if name == "END":
                break
        at += 2880
    shape = [int(cards[f"NAXIS{i}"]) for i in range(int(cards["NAXIS"]), 0, -1)]
    kind = np.dtype(_FITS[int(cards["BITPIX"])])
    n = int(np.prod(shape)) if shape else 0
    if not n or len(data) < at + n * kind.itemsize:
        raise ValueError("no image data")
    raw = np.frombuffer(data, kind, n, at).reshape(shape)
    return (raw * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))).astype(np.float32)


def write_fits(image: np.ndarray) -> bytes:
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", f"NAXIS   = {image.ndim:20d}"]
    cards += [f"NAXIS{i + 1}  = {n:20d}" for i, n in enumerate(reversed(image.shape))] + ["END"]
    head = "".join(c.ljust(80) for c in cards).encode()
    body = image.astype(">f4").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def write_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


_SIZES = {1: 1, 3: 2, 4: 4}  # fixed values: BYTE, SHORT, LONG


def _packbits(data: bytes) -> bytes:
    """Runs and literals by a signed length byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early, as the format has it."""
    bits, held, at, width = 0, 0, 0, 9
    table: list[bytes] = []
    out, last = bytearray(), b""
    while True:
        while held < width:
            if at >= len(data):
                raise ValueError("LZW data ends early")
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:  # the end
            return bytes(out)
        if code == 256:  # a new table
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("LZW code")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}  # fixed values of the format


def read_tiff(data: bytes, allow_float: bool = False) -> np.ndarray:
    """A strip TIFF, plain or packed by LZW, Deflate or PackBits; integers divided by their largest value, floats only if
    allowed, then unscaled."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in _SIZES:
            size = _SIZES[kind] * n
            where = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
            tags[tag] = struct.unpack(order + str(n) + {1: "B", 2: "H", 4: "I"}[_SIZES[kind]], where)
    unpack, predictor = _UNPACK.get(tags.get(259, (1,))[0]), tags.get(317, (1,))[0]
    if unpack is None or predictor not in (1, 2) or 273 not in tags:
        raise ValueError("kind of TIFF")
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    width_bits, is_float = tags.get(258, (8,))[0], tags.get(339, (1,))[0] == 3
    if is_float and not allow_float or width_bits not in ((32, 64) if is_float else (8, 16)):
        raise ValueError("sample type")
    try:
        body = b"".join(unpack(data[o : o + n]) for o, n in zip(tags[273], tags[279]))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    image = np.frombuffer(body, order + ("f" if is_float else "u") + str(width_bits // 8)).reshape(height, width, channels)
    if predictor == 2 and not is_float:  # differences along a row, in the sample's own width
        image = np.add.accumulate(image, axis=1, dtype=image.dtype.newbyteorder("="))
    return image.astype(np.float32) if is_float else (image / float((1 << width_bits) - 1)).astype(np.float32)


def write_tiff(image: np.ndarray) -> bytes:
    """height x width (x channels) uint8 or uint16 as one uncompressed strip."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, channels = image.shape
    body = image.astype(image.dtype.newbyteorder("<")).tobytes()
    n = 10
    extra = 8 + 2 + 12 * n + 4
    depth = image.dtype.itemsize * 8
    bits = struct.pack(f"<{channels}H", *[depth] * channels)
    strip = extra + (len(bits) if channels > 2 else 0)
    depths = extra if channels > 2 else int.from_bytes(bits.ljust(4, b"\0"), "little")
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, depths), (259, 3, 1, 1), (262, 3, 1, 2 if channels > 2 else 1), (273, 4, 1, strip), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, 1, len(body)), (284, 3, 1, 1)]
    return struct.pack("<2sHIH", b"II", 42, 8, n) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0) + (bits if channels > 2 else b"") + body


def write_png(image: np.ndarray) -> bytes:
    """height x width x 1 or 3 uint8 as a PNG without row filters."""
    height, width, channels = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """A PNG as write_png() makes it."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not PNG")
    at, parts = 8, {}
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        parts[data[at + 4 : at + 8]] = parts.get(data[at + 4 : at + 8], b"") + data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, -1)
    if depth != 8 or colour not in (0, 2) or rows[:, 0].any():
        raise ValueError("kind of PNG")
    return (rows[:, 1:].reshape(height, width, {0: 1, 2: 3}[colour]) / 255.0).astype(np.float32)


def channels_last(image: np.ndarray) -> np.ndarray:
    """A FITS cube as height x width x 3; a last axis of 3 wins over a first one."""
    if image.ndim != 3:
        raise ValueError("not three axes")
    if image.shape[-1] == 3:
        return image
    if image.shape[0] != 3:
        raise ValueError("not three channels")
    return np.moveaxis(image, 0, -1)


def to_hwc(image: np.ndarray) -> np.ndarray:
    """A stage's array as height x width x channels: a first axis of 1, 3 or 4 wins over a last one."""
    if image.ndim == 2:
        return image[..., None]
    if image.ndim == 3 and image.shape[0] in (1, 3, 4):
        return np.moveaxis(image, 0, -1)
    if image.ndim == 3 and image.shape[-1] in (1, 3, 4):
        return image
    raise ValueError("no channel axis")
