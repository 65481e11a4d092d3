"""Progressive JPEG in numpy: scans accumulate into coefficient arrays; pixels come by inverse transform.

The decoder reads progressive files of one or three components with any sampling and restart intervals. Scans whose codes
all have one width, and refinements that one end-of-band run covers, are read without a loop over coefficients.

``store`` keeps any bytes losslessly as a colour file with chroma at half the resolution: a payload byte is a quantised
coefficient, 64 to a block, six blocks to a unit of four luma and two chroma blocks. First coefficients are coded by difference
in codes of one to nine bits; the others are spread so evenly that each has the same number of bits, so their scans (one
a component, then a refinement of each) are written and read as bit arrays. A payload over PART bytes becomes several files in a
row, each decoded by itself, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import runs

#: Fixed values of the format: the zigzag order of a block's coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Units in a column of a stored payload; the format allows 65535 lines.
COLUMN = 4_095
#: Payload bytes of a file.
PART = 1 << 20
#: How the size classes of first differences are coded: how many codes have one, two, ... bits, and their classes.
DIFFERENCES = bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, *[0] * 7]), bytes([5, 6, 4, 7, 3, 2, 0, 1, 8, 9])
_COS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


#: Inverse transform of a block's coefficients, in the order of the file, to its samples, row by row.
_INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG]


class Codes(dict):
    """(length, code) to symbol; lookup has, for the next ``width`` bits, the length and symbol of the code they begin with."""

    def __init__(self, counts: bytes, symbols: bytes):
        code, k, self.width = 0, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self[length, code] = symbols[k]
                code, k, self.width = code + 1, k + 1, length
            code <<= 1
        self.lookup: list[tuple[int, int] | None] = []
        for (length, _), symbol in self.items():
            self.lookup += [(length, symbol)] * (1 << (self.width - length))
        self.lookup += [None] * ((1 << self.width) - len(self.lookup))


class Bits:
    """Reads the entropy-coded bits between two markers, with the stuffed zero bytes taken out."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.raw, self.size = np.frombuffer(data, np.uint8), 8 * len(data)
        self.data, self.at = data + b"\xff" * 8, 0

    @cached_property
    def all(self) -> np.ndarray:
        return np.unpackbits(self.raw)

    def _window(self) -> int:
        """The next 40 bits or so, as the high bits of 48; past the end, ones."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 6].ljust(6, b"\xff"), "big") << (self.at & 7) & 0xFFFFFFFFFFFF

    def take(self, n: int) -> int:
        """The next n bits, 16 at most, as a number; past the end, ones."""
        value = self._window() >> (48 - n)
        self.at += n
        return value

    def symbol(self, table: Codes) -> int:
        found = table.lookup[self._window() >> (48 - table.width)] if table else None
        if found is None:
            raise ValueError("no such code")
        if self.at + found[0] > self.size:
            raise ValueError("the scan ends within a code")
        self.at += found[0]
        return found[1]

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def differences(self, tables: list[Codes]) -> list[int]:
        """A size class and so many bits for each of the tables, one after the other."""
        out, at, data = [], self.at, self.data
        for table in tables:
            i = at >> 3
            window = int.from_bytes(data[i : i + 6], "big") << (at & 7) & 0xFFFFFFFFFFFF
            found = table.lookup[window >> (48 - table.width)] if table else None
            if found is None:
                raise ValueError("no such code")
            length, n = found
            value = window >> (48 - length - n) & (1 << n) - 1
            out.append(value if not n or value >> (n - 1) else value - (1 << n) + 1)
            at += length + n
            if at > self.size:
                raise ValueError("the scan ends within a code")
        self.at = at
        return out

    def fields(self, count: int, width: int) -> np.ndarray:
        """count numbers of width bits each."""
        if width == 8 and not self.at & 7:
            first = self.at >> 3
            self.at += 8 * count
            return self.raw[first : first + count].astype(np.int32)
        bits = self.all[self.at : self.at + count * width].reshape(count, width)
        self.at += count * width
        return bits[:, 0].astype(np.int32) if width == 1 else bits @ (1 << np.arange(width - 1, -1, -1))


class Image:
    """Coefficient arrays of a file, filled scan by scan; end is where the file ends in data, from ``first``."""

    def __init__(self, data: bytes, first: int = 0):
        if data[first : first + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quants, self.tables, self.interval, self.comments = {}, {}, 0, []
        self.components: list[dict] = []
        at = first + 2
        while at < len(data):
            marker, at = data[at + 1], at + 2
            self.end = at
            if marker == 0xD9:
                return
            (size,) = struct.unpack(">H", data[at : at + 2])
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = Codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDA:
                end = at
                while not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                    end = data.index(b"\xff", end + 1)
                self._scan(body, self._parts(data[at:end], self.interval))
                at = end

    @staticmethod
    def _parts(data: bytes, interval: int) -> list[Bits]:
        """One reader for each stretch between restart markers."""
        if not interval:
            return [Bits(data)]
        parts, first, at = [], 0, data.find(b"\xff")
        while at >= 0:
            if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
                parts.append(data[first:at])
                first = at + 2
            at = data.find(b"\xff", at + 2)
        return [Bits(x) for x in [*parts, data[first:]]]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.height or not self.width:
            raise ValueError("only 8-bit samples with a known size are read")
        found = [struct.unpack("BBB", body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]
        self.across, self.down = max(s >> 4 for _, s, _ in found), max(s & 15 for _, s, _ in found)
        self.mcus = (-(-self.height // (8 * self.down)), -(-self.width // (8 * self.across)))
        for name, s, quant in found:
            h, v = s >> 4, s & 15
            own = (-(-self.height * v // (8 * self.down)), -(-self.width * h // (8 * self.across)))
            self.components.append({"name": name, "h": h, "v": v, "quant": quant, "own": own, "blocks": np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), np.int32)})

    def _scan(self, body: bytes, parts: list[Bits]) -> None:
        n = body[0]
        chosen = [(next(c for c in self.components if c["name"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, steps = body[1 + 2 * n : 4 + 2 * n]
        high, low = steps >> 4, steps & 15
        if n == 1:
            comp, ids = chosen[0]
            total = comp["own"][0] * comp["own"][1]
            units = [(comp, ids >> 4, *(np.divmod(np.arange(total), comp["own"][1]) if not first or total != comp["blocks"].shape[0] * comp["blocks"].shape[1] else ()))]
        else:
            my, mx = np.divmod(np.arange(self.mcus[0] * self.mcus[1]), self.mcus[1])
            units = [(c, ids >> 4, my * c["v"] + y, mx * c["h"] + x) for c, ids in chosen for y in range(c["v"]) for x in range(c["h"])]
            total = len(my)
        step = self.interval or total
        for bits, k in zip(parts, range(0, total, step), strict=False):
            if first == 0:
                self._dc(bits, [(c, table, y[k : k + step], x[k : k + step]) for c, table, y, x in units], high, low)
                continue
            table, read = self.tables[16 | ids & 15], self._ac_refine if high else self._ac_first
            if total == comp["blocks"].shape[0] * comp["blocks"].shape[1]:
                read(bits, comp["blocks"].reshape(-1, 64)[k : k + step, first : last + 1], table, low)
                continue
            y, x = (at[k : k + step] for at in units[0][2:])
            view = comp["blocks"][y, x, first : last + 1]
            read(bits, view, table, low)
            comp["blocks"][y, x, first : last + 1] = view

    def _dc(self, bits: Bits, units: list, high: int, low: int) -> None:
        """units: component, table and places of the first, second, ... block of each step."""
        count = len(units[0][2])
        if high:
            for (comp, _, y, x), more in zip(units, bits.fields(count * len(units), 1).reshape(count, -1).T, strict=True):
                comp["blocks"][y, x, 0] |= (more << low).astype(np.int32)
            return
        change = np.array(bits.differences([self.tables[table] for _, table, _, _ in units] * count), np.int64).reshape(count, -1)
        for name in {comp["name"] for comp, _, _, _ in units}:
            own = [i for i, u in enumerate(units) if u[0]["name"] == name]
            value = np.cumsum(change[:, own].reshape(-1)).reshape(count, -1) << low
            for column, i in zip(value.T, own, strict=True):
                comp, _, y, x = units[i]
                comp["blocks"][y, x, 0] = column

    @staticmethod
    def _ac_first(bits: Bits, view: np.ndarray, table: dict, low: int) -> None:
        count, width = view.shape
        if len(table) == 1 and (1, 0) in table and not table[1, 0] >> 4 and table[1, 0]:
            n = table[1, 0]  # one code: each coefficient is a zero bit and n bits more
            raw = bits.fields(count * width, n + 1)
            if (raw >> n).any():
                raise ValueError("no such code")
            view[:] = (np.where(raw >> (n - 1) & 1, raw, raw - (1 << n) + 1) << low).reshape(count, width)
            return
        skip = 0
        for block in view:
            k = 0
            if skip:
                skip -= 1
                continue
            while k < width:
                run, n = divmod(bits.symbol(table), 16)
                if n:
                    k += run
                    value = bits.signed(n)
                    block[k] = value * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    @staticmethod
    def _ac_refine(bits: Bits, view: np.ndarray, table: dict, low: int) -> None:
        count, width = view.shape
        bit = 1 << low

        def correct(block: np.ndarray, a: int, b: int) -> None:
            at = np.flatnonzero(block[a:b]) + a
            more = bits.fields(len(at), 1)
            block[at] += np.where(block[at] > 0, bit, -bit) * more

        i = 0
        while i < count:
            block, k, skip = view[i], 0, 0
            while k < width:
                run, n = divmod(bits.symbol(table), 16)
                if not n and run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                value = (bit if bits.take(1) else -bit) if n else 0
                while k < width:
                    if block[k]:
                        if bits.take(1):
                            block[k] += bit if block[k] > 0 else -bit
                    elif run == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            if skip:  # the rest of this block and all of the next ones have corrections only
                correct(block, k, width)
                rest = view[i + 1 : i + skip].reshape(-1)
                at = np.flatnonzero(rest)
                more = bits.fields(len(at), 1)
                rest[at] += np.where(rest[at] > 0, bit, -bit) * more
                view[i + 1 : i + skip] = rest.reshape(-1, width)
                i += skip - 1
            i += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, by inverse transform."""
        out = []
        for c in self.components:
            down, across = c["blocks"].shape[:2]
            pixels = (c["blocks"].reshape(-1, 64) * self.quants[c["quant"]]).astype(np.float32) @ _INVERSE
            pixels = pixels.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            out.append(np.clip(np.rint(pixels + 128), 0, 255))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor, height x width x 3, unsigned 8-bit; chroma is repeated to the size of luma."""
        full = []
        for c, plane in zip(self.components, self.planes(), strict=True):
            plane = plane.repeat(self.down // c["v"], 0).repeat(self.across // c["h"], 1)
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0][..., None], 3, 2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        mixed = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(bits: np.ndarray | bytes) -> bytes:
    if isinstance(bits, bytes):
        return bits.replace(b"\xff", b"\xff\x00")
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _width_bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _coded_differences(change: np.ndarray) -> np.ndarray:
    """Bits of the size class and value of each difference, by the codes of DIFFERENCES."""
    lengths, codes = np.zeros(16, np.int64), np.zeros(16, np.int64)
    for (length, code), symbol in Codes(*DIFFERENCES).items():
        lengths[symbol], codes[symbol] = length, code
    classes = np.frexp(np.abs(change).astype(float))[1]
    wide = np.where(change < 0, change + (1 << classes) - 1, change)
    long = lengths[classes] + classes
    both = (codes[classes] << classes | wide) << (18 - long)
    return (both[:, None] >> np.arange(17, -1, -1) & 1).astype(np.uint8)[np.arange(18)[None, :] < long[:, None]]


def _coded_refinement(low: np.ndarray) -> np.ndarray:
    """Bits of a refinement in which no coefficient is new: runs of whole blocks, each with its blocks' corrections."""
    bits, at = [], 0
    while at < len(low):
        r = min(14, (len(low) - at).bit_length() - 1)
        run = min(len(low) - at, (1 << (r + 1)) - 1)
        bits += [_width_bits(np.array([r]), 4)[0], _width_bits(np.array([run - (1 << r)]), r)[0], low[at : at + run].reshape(-1)]
        at += run
    return np.concatenate(bits)


def store(payload: bytes) -> bytes:
    """A progressive file, luma and two chroma components of half its resolution, whose quantised coefficients are the payload,
    a positive multiple of 64 bytes; files in a row, one for each PART bytes.

    Byte b becomes the coefficient 128 + b / 2 or its negative (odd b), so each needs eight bits and none is zero; the first of
    a block, coded by difference, is b itself. The number of blocks is in a comment, as the last unit and line are filled up.
    """
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    return b"".join(_file(payload[k : k + PART]) for k in range(0, len(payload), PART))


def _file(payload: bytes) -> bytes:
    count = len(payload) // 64
    steps = -(-count // 6)
    across = -(-steps // COLUMN)
    down = -(-steps // across)
    units = np.frombuffer(payload + bytes(64 * (6 * across * down - count)), np.uint8).reshape(down, across, 6, 64).astype(np.int32)
    luma = units[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = [luma, units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"blocks %d" % count), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, frame)]

    def scan(which: list[int], first: int, last: int, steps: int, bits: np.ndarray | bytes) -> None:
        out.extend([_segment(0xDA, bytes([len(which), *(x for i in which for x in (i + 1, 0)), first, last, steps])), _coded(bits)])

    def table(ids: int, counts: bytes, symbols: bytes) -> None:
        out.append(_segment(0xC4, bytes([ids]) + counts + symbols))

    # First coefficients without their lowest bit, as differences to the one before in their component; then those bits.
    dc = units[..., 0].reshape(-1, 6)
    half = dc >> 1
    change = np.column_stack([np.diff(half[:, :4].reshape(-1), prepend=0).reshape(-1, 4), np.diff(half[:, 4], prepend=0), np.diff(half[:, 5], prepend=0)])
    table(0x00, *DIFFERENCES)
    scan([0, 1, 2], 0, 0, 0x01, _coded_differences(change.reshape(-1)))
    bands = [(i, 1, 63) for i in range(3)]
    table(0x10, bytes([1, *[0] * 15]), b"\x07")
    for i, first, last in bands:
        own = parts[i][:, first : last + 1]
        size = 64 + (own >> 2)  # 128 + b / 2 without its lowest bit
        scan([i], first, last, 0x01, np.where(own & 1, 127 - size, size).astype(np.uint8).tobytes())  # a zero bit and seven more
    scan([0, 1, 2], 0, 0, 0x10, (dc & 1).astype(np.uint8).reshape(-1))
    table(0x10, bytes([0, 0, 0, 15, *[0] * 12]), bytes(r << 4 for r in range(15)))
    for i, first, last in bands:
        scan([i], first, last, 0x10, _coded_refinement((parts[i][:, first : last + 1] >> 1 & 1).astype(np.uint8)))
    return b"".join([*out, b"\xff\xd9"])


def images(media: bytes) -> Iterator[Image]:
    """The files in a row, one at a time."""
    at = 0
    while at < len(media):
        image = Image(media, at)
        at = image.end
        yield image


def payload_of(image: Image) -> bytes:
    """The bytes that ``store`` kept in one file, from the coefficients."""
    count = next(int(x.split()[1]) for x in image.comments if x.startswith(b"blocks "))
    down, across = image.mcus
    luma, *chroma = (c["blocks"] for c in image.components)
    four = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    blocks = np.concatenate([four, *(c[:, :, None] for c in chroma)], 2).reshape(-1, 64)[:count]
    size = np.abs(blocks[:, 1:])
    return np.hstack([blocks[:, :1], (size - 128) << 1 | (blocks[:, 1:] < 0)]).astype(np.uint8).tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def features(rgb: np.ndarray) -> str:
    """Mean and spread of each channel, and which of 8 x 8 cells are lighter than the mean."""
    rows, columns = (np.arange(8) * n // 8 for n in rgb.shape[:2])
    area = np.outer(*(np.diff(np.append(x, n)) for x, n in zip((rows, columns), rgb.shape[:2], strict=True)))
    cells = np.add.reduceat(np.add.reduceat(rgb.sum(2, dtype=np.int32), rows, 0, dtype=np.int64), columns, 1) / area
    levels, told = np.arange(256.0), []
    for channel in range(3):
        counts = np.bincount(rgb[..., channel].reshape(-1), minlength=256)
        mean = counts @ levels / counts.sum()
        told.append("%.2f/%.2f" % (mean, max(0.0, counts @ levels**2 / counts.sum() - mean**2) ** 0.5))
    light = "%016x" % int("".join("01"[int(x)] for x in (cells > cells.mean()).reshape(-1)), 2)
    return "%dx%d;" % (rgb.shape[1], rgb.shape[0]) + ";".join(told) + ";" + light


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a file) of each whole text; null counts as empty, and an empty text is 64 zero bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                texts = [(x or "").encode() for x in run.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Reads stored files back: the payload's and the files' digests and the features of each file, joined by a bar; with
    tensors, also shape and rgb bytes, files of a payload one below the other.

    A null id stays null, repeated rows give repeated rows, an empty table gives an empty result. A worker holds one text, its
    files, and the coefficients and samples of one file of PART bytes (without tensors).
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["height", "width", "rgb"] * tensors
    kinds = dict(zip(names, ["long", "long", "long", "string", "long", "long", "string", "string", "int", "int", "binary"], strict=False))
    arrow = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "media"):
                rows = []
                for doc_id, n_bytes, data in zip(*(run.column(x).to_pylist() for x in ("doc_id", "n_bytes", "media")), strict=True):
                    size, digest, told, pictures = 0, hashlib.sha256(), [], []
                    for image in images(data):
                        payload, rgb = payload_of(image), image.rgb()
                        size += len(payload)
                        digest.update(payload)
                        told.append(features(rgb))
                        pictures += [rgb] * tensors
                    row = [doc_id, n_bytes, size, digest.hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), "|".join(told)]
                    rows.append(row + [sum(len(x) for x in pictures), pictures[0].shape[1] if pictures else 0, b"".join(x.tobytes() for x in pictures)][: 3 * tensors])
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow[kinds[n]]) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    return media.mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names))


def media_digest(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a file and read back from it. Repeated rows give repeated rows; no shuffle."""
    return decode_media(encode_media(docs))
