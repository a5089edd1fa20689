"""Progressive JPEG in numpy: coefficients gathered scan by scan, inverse transform, chroma upsampling, RGB tensors.

``decode`` reads any three- or one-component, 8-bit, Huffman-coded progressive JPEG: DC and AC first scans over any spectral
band, successive-approximation refinement, restart intervals and sampling factors up to 4. Coefficients stay in zigzag order
until one matrix product does dequantised block -> pixels for all blocks of a component at once.

``encode`` keeps bytes losslessly in the coefficients (the format's unit): byte ``b`` is a coefficient of size ``128 + b // 2``
whose sign is ``b``'s lowest bit, all quantisers are 1 and chroma is halved both ways. Every coefficient then needs the same
number of bits, so whole bands are packed and unpacked at once; the decoder takes that way for any table with a single
symbol, and otherwise goes symbol by symbol. Long payloads become several images, one stream after another, so memory is
bounded by ``FRAME_BYTES`` and not by the text.

Nulls count as empty texts, whose payload is 192 spaces. Rows that repeat are stored each. An empty table gives an empty
table. A damaged image raises ``ValueError`` in ``decode``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusradar.llm.common import stored, text_blocks, whole_text

UNIT = 192
FRAME_BYTES = UNIT * 4096

# Zigzag order: along each antidiagonal, direction alternating.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _basis() -> np.ndarray:
    """Zigzag coefficients (rows) to pixels (columns) of one block."""
    x = np.arange(8)
    cosine = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", cosine, cosine).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


# ---- writing ---------------------------------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have ``length`` bits."""
    counts = [len(symbols) if i == length else 0 for i in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *symbols]))


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes, slots: int = 0) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, slots)], first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values in ``lengths`` bits each, most significant first, the last byte filled with ones."""
    most = int(lengths.max(initial=1))
    bits = (values[:, None] << (most - lengths)[:, None]) >> np.arange(most - 1, -1, -1)[None, :] & 1
    bits = bits[np.arange(most)[None, :] < lengths[:, None]].astype(np.uint8)
    return np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8))).tobytes()


@lru_cache(256)
def _mcu_order(rows: int, cols: int) -> np.ndarray:
    """Raster index of each luma block in the order of an interleaved scan, four per unit."""
    first = 4 * cols * np.arange(rows)[:, None] + 2 * np.arange(cols)[None, :]
    return np.stack([first, first + 1, first + 2 * cols, first + 2 * cols + 1], axis=-1).reshape(-1)


BANDS = {1: [(1, 5), (6, 63)], 2: [(1, 63)], 3: [(1, 63)]}
_LONGEST_RUN = 32767
# Per byte: its AC code word without the lowest bit (code "0", then seven bits of a value of category 7), and that bit.
_ALL = np.arange(256)
FIRST_BITS = np.where(_ALL & 1, 63 - (_ALL >> 2), 64 + (_ALL >> 2)).astype(np.uint8)
LAST_BIT = (_ALL >> 1 & 1).astype(np.uint8)


def encode_frame(payload: np.ndarray) -> bytes:
    """One image that keeps ``payload`` (bytes, a multiple of 64): luma blocks first, then the two chroma planes."""
    units = -(-len(payload) // 384)
    rows = min(isqrt(units), 4095)
    cols = -(-units // rows)
    octets = np.full(rows * cols * 384, 32, np.uint8)
    octets[:len(payload)] = payload
    blocks = octets.reshape(-1, 64)
    planes = np.split(blocks, [rows * cols * 4, rows * cols * 5])
    out = [b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes([1] * 64)),
           _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
           _table(0, 0, list(range(12)), 4), _table(1, 0, [0x07], 1), _table(1, 1, [n << 4 for n in range(15)], 4)]
    # DC, all but the lowest bit: differences within each component, interleaved by unit
    size = lambda b: 128 + (b >> 1).astype(np.int32)
    dc = [np.where(p[:, 0] & 1, -size(p[:, 0]), size(p[:, 0])) for p in planes]
    dc[0] = dc[0][_mcu_order(rows, cols)]
    steps = [np.diff(d >> 1, prepend=0) for d in dc]
    steps = np.concatenate([steps[0].reshape(-1, 4), steps[1][:, None], steps[2][:, None]], axis=1).reshape(-1)
    category = np.ceil(np.log2(np.abs(steps) + 1)).astype(np.int32)
    extra = np.where(steps < 0, steps + (1 << category) - 1, steps)
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _packed(category << category | extra, 4 + category)))
    for component, plane in enumerate(planes, 1):
        for first, last in BANDS[component]:
            out.append(_scan([component], first, last, 0, 1, FIRST_BITS[plane[:, first:last + 1]].tobytes()))
    bits = np.concatenate([(dc[0] & 1).reshape(-1, 4), (dc[1] & 1)[:, None], (dc[2] & 1)[:, None]], axis=1).reshape(-1)
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, np.packbits(np.append(bits, np.ones(-len(bits) % 8, bits.dtype)).astype(np.uint8)).tobytes()))
    for component, plane in enumerate(planes, 1):
        for first, last in BANDS[component]:
            low = LAST_BIT[plane[:, first:last + 1]]
            parts = []
            for at in range(0, len(low), _LONGEST_RUN):
                run = low[at:at + _LONGEST_RUN]
                power = len(run).bit_length() - 1
                head = power << power | (len(run) - (1 << power))
                parts += [np.array([head >> i & 1 for i in range(3 + power, -1, -1)], np.uint8), run.reshape(-1)]
            bits = np.concatenate(parts)
            data = np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8))).tobytes()
            out.append(_scan([component], first, last, 1, 0, data, 1))
    out.append(b"\xff\xd9")
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    octets = np.frombuffer(payload, np.uint8)
    return b"".join(encode_frame(octets[i:i + FRAME_BYTES]) for i in range(0, len(octets), FRAME_BYTES))


# ---- reading ---------------------------------------------------------------------------------------------------------

class Huffman:
    """Canonical codes of one table: for each 16-bit look-ahead its code length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, self.only_length = symbols, 0
        lengths, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                low = code << (16 - length)
                if low >= 1 << 16:
                    raise ValueError("more codes than the table has room for")
                lengths[low:low + (1 << (16 - length))], values[low:low + (1 << (16 - length))] = length, symbols[at]
                code, at, self.only_length = code + 1, at + 1, length
            code <<= 1
        self.lengths, self.values = lengths.tolist(), values.tolist()


@lru_cache(64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    """Reads one stretch of entropy-coded data."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.padded, self.at, self.end = self.data + b"\xff" * 8, 0, len(self.data) * 8

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("scan data cut short")
        word = int.from_bytes(self.padded[self.at >> 3:(self.at >> 3) + 4], "big")
        value = word >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        word = int.from_bytes(self.padded[self.at >> 3:(self.at >> 3) + 4], "big")
        ahead = word >> (16 - (self.at & 7)) & 0xFFFF
        length = table.lengths[ahead]
        if not length or self.at + length > self.end:
            raise ValueError("no such code")
        self.at += length
        return table.values[ahead]

    def octets(self, n: int) -> np.ndarray:
        """The next ``n`` whole bytes, from a byte boundary."""
        if self.at + 8 * n > self.end:
            raise ValueError("scan data cut short")
        octets = np.frombuffer(self.data, np.uint8, count=n, offset=self.at >> 3)
        self.at += 8 * n
        return octets

    def many(self, n: int) -> np.ndarray:
        """The next ``n`` bits, one per element."""
        if self.at + n > self.end:
            raise ValueError("scan data cut short")
        low = self.at >> 3
        octets = np.frombuffer(self.data, np.uint8, count=(self.at + n + 7 >> 3) - low, offset=low)
        bits = np.unpackbits(octets)[self.at & 7:(self.at & 7) + n]
        self.at += n
        return bits


def _rows(blocks: np.ndarray, coefficients: np.ndarray) -> slice | np.ndarray:
    """A slice where a scan covers consecutive blocks (always, unless the image's edge cuts a component short)."""
    return slice(int(blocks[0]), int(blocks[-1]) + 1) if len(blocks) and blocks[-1] - blocks[0] + 1 == len(blocks) else blocks


def _extended(value: int, size: int) -> int:
    return value if size and value >> (size - 1) else value - (1 << size) + 1 if size else 0


@lru_cache(256)
def _own_order(rows: int, cols: int, stride: int) -> np.ndarray:
    return (np.arange(rows)[:, None] * stride + np.arange(cols)[None, :]).reshape(-1, 1)


@lru_cache(256)
def _shared_order(rows: int, cols: int, shapes: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    r, q = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return np.stack([((r * down + dy) * stride + q * across + dx).reshape(-1) + (k << 32)
                     for k, (down, across, stride) in enumerate(shapes) for dy in range(down) for dx in range(across)], axis=1)


class Component:
    def __init__(self, name: int, across: int, down: int, table: int):
        self.name, self.across, self.down, self.table = name, across, down, table


class Frame:
    """Coefficient arrays of one image, filled by scans."""

    def __init__(self, body: bytes):
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or n not in (1, 3) or not self.height or not self.width or len(body) != 6 + 3 * n:
            raise ValueError("only 8-bit images of one or three components")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not (1 <= c.across <= 4 and 1 <= c.down <= 4) for c in self.components):
            raise ValueError("sampling factors out of range")
        if n == 1:
            self.components[0].across = self.components[0].down = 1
        self.across, self.down = max(c.across for c in self.components), max(c.down for c in self.components)
        self.cols, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for c in self.components:
            c.stride, c.lines = self.cols * c.across, self.rows * c.down
            c.own_cols = -(-(-(-self.width * c.across // self.across)) // 8)
            c.own_rows = -(-(-(-self.height * c.down // self.down)) // 8)
            c.coefficients = np.zeros((c.stride * c.lines, 64), np.int16)

    def order(self, chosen: list[Component]) -> np.ndarray:
        """For each unit of a scan (rows) the blocks in it (columns), as component position * 2**32 + block."""
        if len(chosen) == 1:
            return _own_order(chosen[0].own_rows, chosen[0].own_cols, chosen[0].stride)
        return _shared_order(self.rows, self.cols, tuple((c.down, c.across, c.stride) for c in chosen))

    def planes(self, tables: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Inverse transform of each component, as float samples at its own resolution."""
        out = []
        for c in self.components:
            pixels = (c.coefficients.astype(np.float32) * tables[c.table][None, :]) @ BASIS + np.float32(128)
            out.append(pixels.reshape(c.lines, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.lines * 8, c.stride * 8))
        return out

    def rgb(self, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Full-resolution RGB tensor, height x width x 3, uint8."""
        planes = self.planes(tables)
        full = []
        for c, plane in zip(self.components, planes, strict=True):
            for axis, factor in ((0, self.down // c.down), (1, self.across // c.across)):
                plane = np.repeat(plane, factor, axis) if factor > 1 else plane
            full.append(plane[:self.height, :self.width])
        if len(full) == 1:
            full = [full[0], np.float32(128), np.float32(128)]
        y, blue, red = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, channel in enumerate((y + np.float32(1.402) * red, y - np.float32(0.344136) * blue - np.float32(0.714136) * red,
                                     y + np.float32(1.772) * blue)):
            out[..., i] = np.clip(np.rint(channel), 0, 255)
        return out


def _dc_scan(frame: Frame, chosen, tables, units: np.ndarray, bits: Bits, high: int, low: int) -> None:
    flat = units.reshape(-1)
    if high:
        values = bits.many(len(flat)).astype(np.int16) << low
        for k, c in enumerate(chosen):
            mine = flat >> 32 == k
            c.coefficients[flat[mine] & 0xFFFFFFFF, 0] |= values[mine]
        return
    steps, padded, at = [], bits.padded, bits.at
    looks = [(tables[k].lengths, tables[k].values) for k in (units[0] >> 32).tolist()] if len(units) else []
    for _ in range(len(units)):
        for lengths, values in looks:
            word = int.from_bytes(padded[at >> 3:(at >> 3) + 6], "big")
            ahead = word >> (32 - (at & 7)) & 0xFFFF
            length, size = lengths[ahead], values[ahead]
            if not length or size > 16:
                raise ValueError("no such code")
            value = word >> (48 - (at & 7) - length - size) & ((1 << size) - 1)
            steps.append(value if size and value >> (size - 1) else value - (1 << size) + 1)
            at += length + size
        if at > bits.end:
            raise ValueError("scan data cut short")
    bits.at = at
    steps = np.array(steps, np.int64)
    for k, c in enumerate(chosen):
        mine = flat >> 32 == k
        c.coefficients[flat[mine] & 0xFFFFFFFF, 0] = np.cumsum(steps[mine]) << low


def _ac_first(blocks: np.ndarray, coefficients: np.ndarray, table: Huffman, bits: Bits, first: int, last: int, low: int) -> None:
    if len(table.symbols) == 1 and 0 < table.symbols[0] < 16:  # run 0 and one size: every coefficient takes as many bits
        size, n = table.symbols[0], len(blocks) * (last - first + 1)
        step = table.only_length + size
        if step == 8 and not bits.at & 7:  # whole bytes
            values = bits.octets(n).astype(np.int16) & ((1 << size) - 1)
        else:
            values = bits.many(n * step).reshape(n, -1)[:, table.only_length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        values = np.where(values >> (size - 1), values, values - (1 << size) + 1) << low
        coefficients[_rows(blocks, coefficients), first:last + 1] = values.reshape(len(blocks), -1)
        return
    skip = 0
    for block in blocks.tolist():
        if skip:
            skip -= 1
            continue
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if not size:
                if run < 15:
                    skip = (1 << run) - 1 + (bits.take(run) if run else 0)
                    break
                k += 16
                continue
            k += run
            if k > last:
                raise ValueError("coefficient beyond its band")
            coefficients[block, k] = _extended(bits.take(size), size) << low
            k += 1


def _corrected(values: np.ndarray, bits: Bits, low: int) -> np.ndarray:
    """Coefficients that are not zero yet take one correction bit each, in order."""
    known = values != 0
    if known.all():
        more = bits.many(values.size).reshape(values.shape).astype(np.int16) << low
        return np.where(values < 0, values - more, values + more)
    more = np.zeros(values.shape, np.int16)
    more[known] = bits.many(int(known.sum())).astype(np.int16) << low
    return values + np.sign(values) * more


def _ac_refine(blocks: np.ndarray, coefficients: np.ndarray, table: Huffman, bits: Bits, first: int, last: int, low: int) -> None:
    i = 0
    while i < len(blocks):
        block, k, run_of_blocks = blocks[i], first, 0
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:
                run_of_blocks = (1 << run) + (bits.take(run) if run else 0)
                break
            if size > 1:
                raise ValueError("a refinement adds one bit only")
            sign = (1 if bits.take(1) else -1) if size else 0
            while k <= last:
                value = int(coefficients[block, k])
                if value:
                    if bits.take(1):
                        coefficients[block, k] = value + ((1 << low) if value > 0 else -(1 << low))
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if sign:
                if k > last:
                    raise ValueError("coefficient beyond its band")
                coefficients[block, k] = sign * (1 << low)
            k += 1
        if run_of_blocks:  # what is left of this block and the next blocks only hold correction bits
            coefficients[block, k:last + 1] = _corrected(coefficients[block, k:last + 1], bits, low)
            rest = blocks[i + 1:i + run_of_blocks]
            if len(rest):
                rest = _rows(rest, coefficients)
                coefficients[rest, first:last + 1] = _corrected(coefficients[rest, first:last + 1], bits, low)
            i += run_of_blocks
        else:
            i += 1


_END_OF_DATA = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def decode_frame(data: bytes, at: int = 0) -> tuple[Frame, dict[int, np.ndarray], int]:
    """Coefficients and quantisers of the image that starts at ``at``, and where it ends."""
    if data[at:at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    at, frame, quantisers, huffman, interval = at + 2, None, {}, {}, 0
    while True:
        while data[at:at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xD9:
            if frame is None:
                raise ValueError("no frame")
            return frame, quantisers, at + 2
        length = int.from_bytes(data[at + 2:at + 4], "big")
        body, at = data[at + 4:at + 2 + length], at + 2 + length
        if length < 2 or at > len(data):
            raise ValueError("segment cut short")
        if marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quantisers[slot] = np.frombuffer(body[1:1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _huffman(body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            frame = Frame(body)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a Huffman-coded progressive image")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            end = _END_OF_DATA.search(data, at)
            stop = end.start() if end else len(data)
            _scanned(frame, huffman, body, data[at:stop], interval)
            at = stop


def _scanned(frame: Frame, huffman: dict[int, Huffman], body: bytes, data: bytes, interval: int) -> None:
    n = body[0]
    named = {c.name: c for c in frame.components}
    chosen = [named[body[1 + 2 * i]] for i in range(n)]
    slots = [body[2 + 2 * i] for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if first > last or last > 63 or (first and n > 1) or (not first and last):
        raise ValueError("no such scan in a progressive image")
    units = frame.order(chosen)
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if interval else [data]
    step = interval or max(1, len(units))
    for k, piece in enumerate(pieces):
        part, bits = units[k * step:(k + 1) * step], Bits(piece)
        if not first:
            _dc_scan(frame, chosen, [huffman.get(s >> 4) for s in slots], part, bits, high, low)
        else:
            scan = _ac_refine if high else _ac_first
            scan(part[:, 0], chosen[0].coefficients, huffman[16 | slots[0] & 15], bits, first, last, low)


def decode(media: bytes) -> Iterator[tuple[Frame, dict[int, np.ndarray]]]:
    """Every image of a stream of images."""
    at = 0
    while at < len(media):
        frame, quantisers, at = decode_frame(media, at)
        yield frame, quantisers


def kept_bytes(frame: Frame) -> np.ndarray:
    """The bytes that ``encode_frame`` put into the coefficients, its filling included."""
    values = np.concatenate([c.coefficients.reshape(-1) for c in frame.components])
    return ((np.abs(values) - 128) << 1 | (values < 0)).astype(np.uint8)


# ---- tables ----------------------------------------------------------------------------------------------------------

def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, payload_bytes, media``: every text, padded with spaces to a positive multiple of 192 bytes, as images."""
    rows = df.select(id_col, whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, octets, bounds in text_blocks(batch.column(1)):
                sizes, media = np.diff(bounds), []
                whole = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
                for i in range(b - a):
                    payload = octets[bounds[i]:bounds[i + 1]].tobytes().ljust(int(whole[i]))
                    media.append(encode(payload))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(whole), pa.array(media, pa.binary())],
                                                 names=["id", "n_bytes", "payload_bytes", "media"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, media binary").withColumnRenamed("id", id_col)


def tensors(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per image: ``id, frame, height, width, tensor`` (RGB bytes, row by row). Null media give no row."""
    rows = df.select(id_col, media_col).where(f"{media_col} IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column(1)):
                for k, (frame, quantisers) in enumerate(decode(media.as_py())):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([frame.height], pa.int32()),
                        pa.array([frame.width], pa.int32()), pa.array([frame.rgb(quantisers).tobytes()], pa.binary())],
                        names=["id", "frame", "height", "width", "tensor"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, frame int, height int, width int, tensor binary").withColumnRenamed("id", id_col)


def stored_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read ``store_texts`` rows back: digests of payload and media, and a feature of the RGB tensors (images, pixels, mean colour)."""
    rows = df.select(id_col, "n_bytes", "payload_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, out = batch.column(2).to_pylist(), []
            for i, media in enumerate(batch.column(3)):
                media = media.as_py()
                sha, left, tail = hashlib.sha256(), whole[i], b""
                frames = pixels = 0
                colour = np.zeros(3)
                for frame, quantisers in decode(media):
                    payload = kept_bytes(frame)[:min(left, FRAME_BYTES)].tobytes()
                    left -= len(payload)
                    sha.update(payload)
                    tail = (tail + payload[-16:])[-16:]
                    tensor = frame.rgb(quantisers)
                    frames, pixels = frames + 1, pixels + frame.height * frame.width
                    colour += tensor.sum(axis=(0, 1), dtype=np.int64)
                feature = f"{frames} {pixels} " + " ".join(f"{x:.3f}" for x in colour / pixels)
                out.append((sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[
                "id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
                                "media_sha256 string, feature string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return stored_features(stored(store_texts(spark.read.parquet(f"{folder}/documents.parquet")), "media", compression="zstd"))
