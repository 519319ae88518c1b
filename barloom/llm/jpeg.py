"""Operator 8: progressive JPEG columns.

``decode`` reads a progressive JPEG file: scan by scan it accumulates coefficients (spectral selection: a band of
them; successive approximation: their high bits first, then one bit more), then applies the inverse transform,
enlarges the chroma planes and gives a full-resolution RGB tensor. ``encode_payload`` stores bytes without loss as
coefficients, the unit of the format: the first two thirds are the blocks of the luma plane, the rest those of two chroma
planes of half its height and width.

A byte b becomes the AC value b (b >= 128) or b-255 (else), all of which take eight bits, and the DC value 256+b. So
each scan of such a file uses one Huffman code, and its codes and extra bits have one width; the decoder reads
scans of that kind with array operations and all others bit by bit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from barloom.llm.common import scan_texts, slices

# Fixed values of the format: the zigzag order is a rule; quantisation by one throughout.
_ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
UNIT = 192
_SQUARE = 6 * 64  # bytes of 16 x 16 pixels: four luma blocks and one of each chroma plane
_WIDEST = 4095  # such squares in a row

# The inverse transform in whole numbers: cosines times 2^13, so that all sums are exact and equal inputs give equal outputs.
_k = np.arange(8)
_BASIS = np.rint(8192 * np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16))  # sample x frequency


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table with one code, the bit 0."""
    return _segment(0xC4, bytes([kind, 1] + [0] * 15 + [symbol]))


def _stuff(data: np.ndarray) -> bytes:
    at = np.flatnonzero(data == 0xFF)
    return (np.insert(data, at + 1, 0) if len(at) else data).tobytes()


def encode_payload(payload: bytes, note: bytes = b"") -> bytes:
    """``payload`` (a positive multiple of 192 bytes) as a progressive JPEG; ``note`` goes into a comment."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    need = -(-len(payload) // _SQUARE)
    high = -(-need // _WIDEST)
    wide = -(-need // high)
    n = high * wide
    data = np.zeros(n * _SQUARE, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [x.reshape(-1, 64) for x in np.split(data, [256 * n, 320 * n])]
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)) + note), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC, high bits: a restart at every block makes each difference the value itself; nine bits, filled up to two bytes.
    out += [_one_code(0x00, 8), _segment(0xDD, struct.pack(">H", 1))]
    for c, blocks in enumerate(planes):
        top = 128 + (blocks[:, 0] >> 1).astype(np.int64)
        body = np.zeros((len(blocks), 5), dtype=np.uint8)
        body[:, 0], body[:, 1] = top >> 1, (top & 1) << 7 | 127
        body[:, 3], body[:, 4] = 0xFF, 0xD0 + np.arange(len(blocks)) % 8
        keep = np.ones(body.shape, dtype=bool)
        keep[:, 2] = body[:, 1] == 0xFF
        keep[-1, 3:] = False
        out += [_segment(0xDA, bytes([1, c + 1, 0, 0, 0, 0x01])), body[keep].tobytes()]
    # AC, high bits: code 0 and seven bits, which are b >> 1; two bands a component.
    out += [_segment(0xDD, struct.pack(">H", 0)), _one_code(0x10, 7)]
    for c, blocks in enumerate(planes):
        for a, b in ((1, 5), (6, 63)):
            out += [_segment(0xDA, bytes([1, c + 1, 0, a, b, 0x01])), (blocks[:, a : b + 1] >> 1).tobytes()]
    # The last bit: of DC plain, of AC behind an end-of-block code.
    out.append(_one_code(0x10, 0))
    for c, blocks in enumerate(planes):
        low = (blocks & 1) ^ (blocks < 128)
        low[:, 0] = 0
        out += [_segment(0xDA, bytes([1, c + 1, 0, 0, 0, 0x10])), _stuff(_pack_ones(blocks[:, 0] & 1))]
        out += [_segment(0xDA, bytes([1, c + 1, 0, 1, 63, 0x10])), _stuff(np.packbits(low.ravel()))]
    return b"".join(out) + b"\xff\xd9"


def _pack_ones(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))


class _Bits:
    """Bits of one restart interval, for the general scans."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = 2 * v + (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def _signed(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


class Image:
    """A progressive JPEG after all its scans: ``coefficients[c]`` is rows x columns x 64 in zigzag order."""

    def __init__(self, raw: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.coefficients: list[np.ndarray] = []
        tables: dict[int, dict[tuple[int, int], int]] = {}
        restart = 0
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            marker, at = raw[at + 1], at + 2
            if marker == 0xD9:
                return
            (size,) = struct.unpack_from(">H", raw, at)
            body = raw[at + 2 : at + size]
            at += size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, values = body[1:17], body[17 : 17 + sum(body[1:17])]
                    code, k, table = 0, 0, {}
                    for length, c in enumerate(counts, 1):
                        for _ in range(c):
                            table[length, code] = values[k]
                            code, k = code + 1, k + 1
                        code *= 2
                    tables[body[0]] = table
                    body = body[17 + len(values) :]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                self.mcu_wide, self.mcu_high = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.coefficients = [np.zeros((self.mcu_high * v, self.mcu_wide * h, 64), dtype=np.int16) for _, h, v, _ in self.parts]
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only progressive Huffman-coded images are read")
            elif marker == 0xDA:
                end = at
                while True:
                    end = raw.index(b"\xff", end)
                    if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                n = body[0]
                chosen = [next(k for k, p in enumerate(self.parts) if p[0] == body[1 + 2 * i]) for i in range(n)]
                codes = [(tables.get(body[2 + 2 * i] >> 4, {}), tables.get(0x10 | (body[2 + 2 * i] & 15), {})) for i in range(n)]
                self._scan(raw[at:end], chosen, codes, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, restart)
                at = end

    def _grid(self, part: int) -> tuple[int, int]:
        """Rows and columns of blocks in a scan of one component alone."""
        _, h, v, _ = self.parts[part]
        return -(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8)

    def _scan(self, data, chosen, codes, first, last, high, low, restart) -> None:
        if not self._even_scan(data, chosen, codes, first, last, high, low, restart):
            self._bit_scan(data, chosen, codes, first, last, high, low, restart)

    def _even_scan(self, data, chosen, codes, first, last, high, low, restart) -> bool:
        """Scans whose code words all have one width; False if this is none of them."""
        if len(chosen) != 1 or self._grid(chosen[0]) != self.coefficients[chosen[0]].shape[:2]:
            return False
        flat = self.coefficients[chosen[0]].reshape(-1, 64)
        n, raw = len(flat), np.frombuffer(data, np.uint8)
        if first == 0 and not high and low == 1 and restart == 1 and codes[0][0] == {(1, 0): 8}:
            mark = (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7) & (raw[:-1] == 0xFF)
            drop = np.zeros(len(raw), dtype=bool)
            drop[:-1] |= mark
            drop[1:] |= mark | ((raw[:-1] == 0xFF) & (raw[1:] == 0))
            word = raw[~drop]
            if len(word) != 2 * n or mark.sum() != n - 1:
                return False
            word = word[::2].astype(np.int16) << 1 | word[1::2] >> 7
            if (word < 128).any() or (word > 255).any():
                return False  # a negative difference, or a code of 1
            flat[:, 0] = (word & 255) << 1
            return True
        if high:
            raw = self._unstuffed(raw)
        if first == 0 and high == 1 and restart == 0:
            flat[:, 0] |= np.unpackbits(raw)[:n]
            return True
        if first == 0 or restart:
            return False
        span = last - first + 1
        if not high and low == 1 and codes[0][1] == {(1, 0): 7} and len(raw) == n * span and (raw < 128).all():
            bits = raw.reshape(n, span).astype(np.int16)
            flat[:, first : last + 1] = np.where(bits >= 64, bits, bits - 127) * 2
            return True
        if high == 1 and low == 0 and codes[0][1] == {(1, 0): 0} and span == 63 and len(raw) == 8 * n:
            bits = np.unpackbits(raw).reshape(n, 64)
            if bits[:, 0].any() or not flat[:, 1:].all():
                return False
            flat[:, 1:] += np.where(flat[:, 1:] > 0, bits[:, 1:], -bits[:, 1:].astype(np.int16)).astype(np.int16)
            return True
        return False

    @staticmethod
    def _unstuffed(raw: np.ndarray) -> np.ndarray:
        extra = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
        return np.delete(raw, extra) if len(extra) else raw

    def _bit_scan(self, data, chosen, codes, first, last, high, low, restart) -> None:
        """Any scan, bit by bit, one restart interval after the other."""
        parts, start, k = [], 0, 0
        while (k := data.find(b"\xff", k)) >= 0:
            if data[k + 1] != 0:
                parts.append(data[start:k])
                start = k + 2
            k += 2
        parts.append(data[start:])
        parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
        if len(chosen) == 1:
            rows, columns = self._grid(chosen[0])
            units = [[(0, r, c)] for r in range(rows) for c in range(columns)]
        else:
            units = [
                [(i, y * self.parts[k][2] + v, x * self.parts[k][1] + h) for i, k in enumerate(chosen) for v in range(self.parts[k][2]) for h in range(self.parts[k][1])]
                for y in range(self.mcu_high)
                for x in range(self.mcu_wide)
            ]
        step = restart or len(units)
        for number, part in enumerate(parts):
            bits = _Bits(part)
            before, ahead = [0] * len(chosen), 0
            for unit in units[number * step : (number + 1) * step]:
                for i, r, c in unit:
                    block = self.coefficients[chosen[i]][r, c]
                    if first == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            size = bits.symbol(codes[i][0])
                            before[i] += _signed(bits.take(size), size)
                            block[0] = before[i] << low
                    elif not high:
                        ahead = self._band(bits, codes[i][1], block, first, last, low, ahead)
                    else:
                        ahead = self._refine(bits, codes[i][1], block, first, last, low, ahead)

    @staticmethod
    def _band(bits, table, block, first, last, low, ahead) -> int:
        if ahead:
            return ahead - 1
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                block[k] = _signed(bits.take(size), size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                return (1 << run) + bits.take(run) - 1
        return 0

    @staticmethod
    def _refine(bits, table, block, first, last, low, ahead) -> int:
        def correct(k: int) -> None:
            if bits.take(1):
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        k = first
        while k <= last and not ahead:
            run, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = (1 << low) if bits.take(1) else -(1 << low)
            elif run < 15:
                ahead = (1 << run) + bits.take(run)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif run == 0:
                    if value:
                        block[k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if ahead:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            return ahead - 1
        return 0


def samples(blocks: np.ndarray) -> np.ndarray:
    """Blocks of dequantised coefficients (n x 64, zigzag) as samples 0..255 (n x 8 x 8)."""
    square = np.zeros((len(blocks), 64))
    square[:, _ZIGZAG] = blocks
    half = _BASIS @ square.reshape(-1, 8, 8)
    full = half @ _BASIS.T
    return np.clip(np.floor(full / (1 << 26) + 128.5), 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-resolution planes as RGB, in whole numbers of 2^-16 so that the result is exact."""
    y, cb, cr = (y.astype(np.int32) << 16) + 32768, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for c, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        plane >>= 16
        out[..., c] = np.clip(plane, 0, 255, out=plane)
    return out


def decode(raw: bytes) -> np.ndarray:
    """A progressive JPEG as a height x width x 3 tensor; grey images are given three equal channels."""
    return tensor_of(Image(raw))


def tensor_of(image: Image) -> np.ndarray:
    """The tensor of a read image. Each pixel takes the sample of each plane that covers it, whatever the sampling factors."""
    down, right = np.arange(image.height), np.arange(image.width)
    planes = []
    for (_, h, v, q), c in zip(image.parts, image.coefficients):
        rows, columns = c.shape[:2]
        tile = samples(c.reshape(-1, 64) * image.quant[q])
        plane = tile.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        if image.hmax % h or image.vmax % v:
            planes.append(plane[(down * v // image.vmax)[:, None], right * h // image.hmax])
        else:
            planes.append(plane.repeat(image.vmax // v, axis=0).repeat(image.hmax // h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    return to_rgb(*planes)


def read_payload(image: Image) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    (size,) = struct.unpack(">Q", image.comment[:8])
    c = np.concatenate([x.reshape(-1, 64) for x in image.coefficients])
    data = np.where(c < 0, c + 255, c)
    data[:, 0] = c[:, 0] & 255
    return data.astype(np.uint8).tobytes()[:size]


def media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, payload, media, width, height, pixel_sums, tensor): each text as a progressive JPEG, read back.

    The text is UTF-8 (null: empty), filled with spaces to a positive multiple of 192 bytes. ``payload`` is what was
    read back from ``media``; ``tensor`` are the bytes of its height x width x 3 tensor, row by row, and ``pixel_sums``
    the sums of R, G and B over it. Chroma is stored at half size and enlarged in the tensor; ``tensors`` reads given files. Null ids, repeated
    rows and extra columns pass row by row; an empty table gives no rows.
    """

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids, texts = columns
        rows = []
        for text in texts.to_pylist():
            raw = text.encode()
            stored = encode_payload(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "))
            image = Image(stored)
            tensor = tensor_of(image)
            rows.append([len(raw), read_payload(image), stored, image.width, image.height, [int(tensor[:, :, c].sum(dtype=np.int64)) for c in range(3)], tensor.tobytes()])
        yield pa.RecordBatch.from_arrays(
            [ids, *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))]],
            names=["doc_id", "n_bytes", "payload", "media", "width", "height", "pixel_sums", "tensor"],
        )

    return scan_texts(docs, fn, "doc_id long, n_bytes long, payload binary, media binary, width int, height int, pixel_sums array<long>, tensor binary", max_bytes=2 << 20)


def tensors(files: DataFrame, column: str = "media") -> DataFrame:
    """``files`` with (width, height, tensor, error): the progressive JPEG in the binary ``column`` as a height x width x 3 tensor, row by row.

    Chroma planes are enlarged to full resolution. Null files give nulls; files that can't be read give nulls and the ``error``.
    """
    made = StructType.fromDDL("width int, height int, tensor binary, error string")
    at = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                rows = []
                for raw in part.column(at).to_pylist():
                    try:
                        tensor = None if raw is None else decode(raw)
                        rows.append((None,) * 4 if raw is None else (tensor.shape[1], tensor.shape[0], tensor.tobytes(), None))
                    except Exception as e:  # whatever a broken file brings about is told in its row
                        rows.append((None, None, None, str(e) or type(e).__name__))
                new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *made.names])

    return files.mapInArrow(run, StructType([*files.schema.fields, *made.fields]))
