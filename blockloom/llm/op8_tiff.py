"""Media columns: TIFF.

``decode`` walks the chain of image directories of a classic TIFF of either byte order and undoes PackBits,
LZW or deflate, strips or tiles, and the horizontal predictor, giving one page per directory.  ``encode`` writes
such files.  ``tiff_pages`` is the DataFrame operator: a binary column in, one row per page out.

The compressed formats are framed so that each strip or tile is decoded alone, so memory is bounded by a page.
Null or broken media give one row with page -1 and the reason in ``error``, after the pages that could be read; an empty
table gives an empty result.
In the registered query, null texts count as empty, repeated texts give equal values, and extra columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import bounded_batches, quoted, table, tidied

WIDTH = 192
ROWS_PER_STRIP = 256
TILE = (64, 64)
#: Payloads from this size on are stored as tiles, smaller ones as strips.
TILED_FROM = 49_152

# Fixed values of the TIFF 6.0 format.
TAG_WIDTH, TAG_LENGTH, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_COUNTS, TAG_PLANAR = 273, 277, 278, 279, 284
TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_LENGTH, TAG_TILE_OFFSETS, TAG_TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


class TiffError(ValueError):
    """The bytes are not a TIFF that this decoder reads."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


# --- compression of one strip or tile ---------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become two bytes, the rest literal runs of at most 128."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    out, literal = bytearray(), 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 3:
            continue
        for i in range(literal, a, 128):
            part = data[i : min(i + 128, a)]
            out += bytes([len(part) - 1]) + part
        while b - a >= 2:
            n = min(128, b - a)
            out += bytes([257 - n, data[a]])
            a += n
        literal = a
    for i in range(literal, len(data), 128):
        part = data[i : i + 128]
        out += bytes([len(part) - 1]) + part
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits; the width grows one code early, and the table restarts before it is full."""
    bits = width = 0
    held, out = 0, bytearray()
    codes: dict[bytes, int] = {}
    width, next_code = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    current = b""
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            current = longer
            continue
        put(codes[current] if len(current) > 1 else current[0])
        codes[longer] = next_code
        next_code += 1
        if next_code == 4094:
            put(256)
            codes, width, next_code = {}, 9, 258
        elif next_code + 1 > 1 << width and width < 12:
            width += 1
        current = data[i : i + 1]
    if current:
        put(codes[current] if len(current) > 1 else current[0])
        next_code += 1
        if next_code + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, width, held, bits = bytearray(), 9, 0, 0
    entries: list[bytes] = []
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            entries, width, last = list(first), 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if not entries:
            entries = list(first)
        if not last:
            got = entries[code] if code < len(entries) else None
        else:
            got = entries[code] if code < len(entries) else (last + last[:1] if code == len(entries) else None)
            if got is not None:
                entries.append(last + got[:1])
        if got is None:
            raise TiffError("LZW code out of range")
        out += got
        last = got
        if len(entries) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def _pack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise TiffError(f"compression {compression}")


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data[:size]
    elif compression == PACKBITS:
        got = packbits_decode(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            got = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {compression}")
    if len(got) != size:
        raise TiffError(f"strip or tile has {len(got)} of {size} bytes")
    return got


# --- files ------------------------------------------------------------------------------------------------


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, rows_per_strip: int = ROWS_PER_STRIP, byte_order: str = "<") -> bytes:
    """A TIFF of 8-bit pages (height, width) or (height, width, samples); a directory for each page."""
    out = bytearray((b"II" if byte_order == "<" else b"MM") + struct.pack(byte_order + "HI", 42, 0))
    link = 4
    for page in pages:
        m = np.ascontiguousarray(page if page.ndim == 3 else page[:, :, None], np.uint8)
        h, w, samples = m.shape
        parts, counts, offsets = [], [], []
        if tile:
            th, tw = tile
            padded = np.pad(m, ((0, -h % th), (0, -w % tw), (0, 0)), mode="edge")
            parts = [padded[r : r + th, c : c + tw] for r in range(0, padded.shape[0], th) for c in range(0, padded.shape[1], tw)]
        else:
            parts = [m[r : r + rows_per_strip] for r in range(0, h, rows_per_strip)]
        for part in parts:
            if predictor == 2:
                part = part.copy()
                part[:, 1:] -= part[:, :-1].copy()
            data = _pack(part.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        fields = [(TAG_WIDTH, 4, [w]), (TAG_LENGTH, 4, [h]), (TAG_BITS, 3, [8] * samples), (TAG_COMPRESSION, 3, [compression]), (TAG_PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (TAG_SAMPLES, 3, [samples]), (TAG_PLANAR, 3, [1]), (TAG_PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TAG_TILE_WIDTH, 4, [tile[1]]), (TAG_TILE_LENGTH, 4, [tile[0]]), (TAG_TILE_OFFSETS, 4, offsets), (TAG_TILE_COUNTS, 4, counts)]
        else:
            fields += [(TAG_STRIP_OFFSETS, 4, offsets), (TAG_ROWS_PER_STRIP, 4, [rows_per_strip]), (TAG_STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{byte_order}{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                at = struct.pack(byte_order + "I", len(out))
                out += body
            else:
                at = body.ljust(4, b"\0")
            entries += struct.pack(byte_order + "HHI", tag, kind, len(values)) + at
        out += b"\0" * (len(out) % 2)
        struct.pack_into(byte_order + "I", out, link, len(out))
        out += struct.pack(byte_order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory cut off")
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES or not count:
            continue
        form = f"{order}{count}{TYPES[kind]}"
        if count > len(data):
            raise TiffError("field beyond the end")
        where = at + 2 + 12 * i + 8
        if struct.calcsize(form) > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + struct.calcsize(form) > len(data):
            raise TiffError("field beyond the end")
        tags[tag] = struct.unpack_from(form, data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, most_bytes: int) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, samples = one(TAG_WIDTH), one(TAG_LENGTH), one(TAG_SAMPLES, 1)
    bits, compression, predictor = one(TAG_BITS, 1), one(TAG_COMPRESSION, 1), one(TAG_PREDICTOR, 1)
    if not w or not h or min(w, h, samples) < 1 or bits not in (8, 16) or len(set(tags.get(TAG_BITS, (bits,)))) > 1:
        raise TiffError("only pages of 8- or 16-bit samples are read")
    if predictor not in (1, 2) or one(TAG_PLANAR, 1) != 1:
        raise TiffError("predictor or planar layout not read")
    unit = bits // 8
    if w * h * samples * unit > most_bytes:
        raise TiffError("page larger than the allowed size")
    kind = np.dtype(np.uint8 if unit == 1 else order + "u2")
    tiled = TAG_TILE_OFFSETS in tags
    offsets, counts = (tags.get(TAG_TILE_OFFSETS, ()), tags.get(TAG_TILE_COUNTS, ())) if tiled else (tags.get(TAG_STRIP_OFFSETS, ()), tags.get(TAG_STRIP_COUNTS, ()))
    if tiled:
        tw, th = one(TAG_TILE_WIDTH, 0), one(TAG_TILE_LENGTH, 0)
    else:
        tw, th = w, min(one(TAG_ROWS_PER_STRIP, h), h)
    if not tw or not th or min(tw, th) < 1:
        raise TiffError("no strip or tile size")
    if tw * th * samples * unit > most_bytes:
        raise TiffError("tile larger than the allowed size")
    across, down = -(-w // tw), -(-h // th)
    if len(offsets) != across * down or len(counts) != len(offsets):
        raise TiffError("wrong number of strips or tiles")
    out = np.empty((h, w, samples), kind)
    for i, (a, n) in enumerate(zip(offsets, counts, strict=True)):
        if min(a, n) < 0 or a + n > len(data):
            raise TiffError("strip or tile beyond the end")
        r, c = i // across * th, i % across * tw
        rows = th if tiled else min(th, h - r)
        part = np.frombuffer(_unpack(data[a : a + n], compression, rows * tw * samples * unit), kind).reshape(rows, tw, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[r : r + th, c : c + tw] = part[: h - r, : w - c]
    return Page(w, h, samples, bits, compression, predictor, tiled, out.tobytes())


def decode(data: bytes, most_bytes: int = 1 << 30) -> Iterator[Page]:
    """The pages in the order of the chain of directories."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise TiffError("not a classic TIFF")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories form a ring")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order, most_bytes)


# --- operators --------------------------------------------------------------------------------------------

PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(media: DataFrame, column: str = "media", id_column: str = "id") -> DataFrame:
    """One row per page: the id and the decoded page.  Broken or null media give one row with an error."""
    bounded_batches(media.sparkSession)
    src = media.select(id_column, column)
    names = [x.split()[0] for x in PAGES.split(", ")]
    ddl = f"{quoted(id_column)} {src.schema[0].dataType.simpleString()}, {PAGES}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows, k = [], 0
                try:
                    if data is None:
                        raise TiffError("null")
                    for p in decode(data):
                        rows.append((k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None))
                        k += 1
                except (TiffError, struct.error, ValueError, IndexError, OverflowError, MemoryError) as e:  # whatever a hostile file brings up
                    rows.append((-1, None, None, None, None, None, None, None, None, str(e) or type(e).__name__))
                ids = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [ids] + [pa.array([], t) for t in types], names=[id_column, *names])

    return src.mapInArrow(tidied(walk), ddl)


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of the width, and their number before."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def store(data: bytes) -> bytes:
    """A payload as a one-page TIFF: deflate and horizontal predictor, in strips, or in tiles if large."""
    page = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return encode([page], DEFLATE, 2, TILE if len(data) >= TILED_FROM else None)


def features(pixels: bytes) -> str:
    """Size, mean, deviation and an 8-bin histogram (per mille) of the samples, as text."""
    x = np.frombuffer(pixels, np.uint8)
    share = np.bincount(x >> 5, minlength=8) * 1000 // max(1, len(x))
    return f"{len(x) // WIDTH}x{WIDTH};mean={int(x.sum(dtype=np.int64)) * 100 // max(1, len(x))};sq={int((x.astype(np.int64) ** 2).sum()) // max(1, len(x))};hist=" + ",".join(map(str, share.tolist()))


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"


def digests(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Store each text as TIFF, decode what was stored, and describe it."""
    bounded_batches(docs.sparkSession)
    src = docs.select(id_column, column)
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data, n = payload(text or "")
                media = store(data)
                pages = list(decode(media))
                back = b"".join(p.data for p in pages)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(pages)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_column, *names])

    return src.mapInArrow(tidied(run), f"{quoted(id_column)} {src.schema[0].dataType.simpleString()}, {DIGESTS}")


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).drop("pages")


QUERIES = {"op8_tiff": op8_tiff}
ORACLES: dict[str, str] = {}
