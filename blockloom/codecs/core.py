"""The codecs.  Each turns bytes into a payload and a small metadata dict, and back, for any input."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import zstandard


@dataclass
class Context:
    """What is known about a block when it is encoded."""

    dtype: str | None = None
    path: str = ""
    level: int | None = None
    byte_order: str = "little"


@dataclass
class Encoded:
    payload: bytes
    codec: str
    metadata: dict = field(default_factory=dict)


class Codec:
    """Subclass, name and register to add a codec."""

    name = ""

    def compress(self, data: bytes, context: Context) -> Encoded:
        raise NotImplementedError

    def decompress(self, payload: bytes, original_size: int, metadata: dict) -> bytes:
        raise NotImplementedError


class Raw(Codec):
    name = "raw"

    def compress(self, data, context):
        return Encoded(bytes(data), self.name)

    def decompress(self, payload, original_size, metadata):
        return bytes(payload)


class Zlib(Codec):
    name = "zlib"

    def compress(self, data, context):
        level = 6 if context.level is None else min(9, context.level)
        return Encoded(zlib.compress(data, level), self.name, {"level": level})

    def decompress(self, payload, original_size, metadata):
        return inflate(payload, original_size)


def inflate(payload: bytes, size: int) -> bytes:
    """At most one byte more than the block is known to hold; a stream without its end is refused."""
    d = zlib.decompressobj()
    got = d.decompress(payload, size + 1)
    if not d.eof:
        raise ValueError("deflate stream cut off or larger than the block")
    return got


class Zstd(Codec):
    name = "zstd"

    def compress(self, data, context):
        level = 3 if context.level is None else context.level
        return Encoded(zstandard.ZstdCompressor(level=level).compress(data), self.name, {"level": level})

    def decompress(self, payload, original_size, metadata):
        # The frame may not claim more than the block is known to hold.
        if zstandard.frame_content_size(payload) > max(original_size, 0):
            raise ValueError("frame larger than the block")
        return zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, original_size))


# Bytes per element by dtype name.
ELEMENT_BYTES = {"BOOL": 1, "I8": 1, "U8": 1, "INT8": 1, "UINT8": 1, "BF16": 2, "FP16": 2, "F16": 2, "I16": 2, "U16": 2, "INT16": 2, "UINT16": 2, "FP32": 4, "F32": 4, "I32": 4, "U32": 4, "INT32": 4, "UINT32": 4, "FP64": 8, "F64": 8, "I64": 8, "U64": 8, "INT64": 8, "UINT64": 8}
# Bits of (all, exponent, mantissa) of the float dtypes.
FLOAT_BITS = {"BF16": (16, 8, 7), "FP16": (16, 5, 10), "F16": (16, 5, 10), "FP32": (32, 8, 23), "F32": (32, 8, 23)}


def element_bytes(dtype: str | None, size: int) -> int:
    if dtype in ELEMENT_BYTES:
        return ELEMENT_BYTES[dtype]
    return 4 if size % 4 == 0 else 2 if size % 2 == 0 else 1


def split_planes(data: bytes, k: int) -> tuple[bytes, bytes]:
    """(bytes k apart gathered plane by plane, the rest that is no whole element)."""
    n = len(data) // k
    x = np.frombuffer(data, np.uint8, n * k).reshape(n, k)
    return np.ascontiguousarray(x.T).tobytes(), data[n * k :]


def merge_planes(planes: bytes, k: int) -> bytes:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(k, -1).T).tobytes()


class BytePlane(Codec):
    name = "byteplane"
    inner: Codec = Zstd()

    def compress(self, data, context):
        from blockloom.codecs.select import normalize_dtype

        k = element_bytes(normalize_dtype(context.dtype), len(data))
        planes, tail = split_planes(data, k)
        meta = {"transform": "byteplane", "element_size": k, "inner_codec": self.inner.name, "planes_size": len(planes), "tail_size": len(tail)}
        if not planes:
            return Encoded(struct.pack(">I", 0) + self.inner.compress(tail, context).payload, self.name, meta)
        inner = self.inner.compress(planes, context).payload
        return Encoded(struct.pack(">I", len(inner)) + inner + tail, self.name, meta)

    def decompress(self, payload, original_size, metadata):
        (n,) = struct.unpack_from(">I", payload)
        if n > len(payload) - 4:
            raise ValueError("planes beyond the payload")
        k = int(metadata["element_size"])
        if n == 0:
            return self.inner.decompress(payload[4:], original_size, {})
        whole = original_size // k * k
        return merge_planes(self.inner.decompress(payload[4 : 4 + n], whole, {}), k) + payload[4 + n :]


def float_planes(data: bytes, dtype: str, byte_order: str) -> tuple[bytes, bytes, bytes, bytes, int]:
    """(packed signs, exponents, mantissas in big-endian bytes, tail, number of elements)."""
    total, exponent, mantissa = FLOAT_BITS[dtype]
    kind = np.dtype(f"{'<' if byte_order == 'little' else '>'}u{total // 8}")
    n = len(data) // kind.itemsize
    x = np.frombuffer(data, kind, n).astype(np.uint32)
    signs = np.packbits((x >> (total - 1)).astype(np.uint8)).tobytes()
    exponents = ((x >> mantissa) & ((1 << exponent) - 1)).astype(np.uint8).tobytes()
    m = x & ((1 << mantissa) - 1)
    width = -(-mantissa // 8)
    parts = np.stack([(m >> (8 * (width - 1 - i))) & 255 for i in range(width)], axis=1).astype(np.uint8) if n else np.zeros((0, width), np.uint8)
    return signs, exponents, parts.tobytes(), data[n * kind.itemsize :], n


def merge_float_planes(signs: bytes, exponents: bytes, mantissas: bytes, n: int, dtype: str, byte_order: str) -> bytes:
    total, _, mantissa = FLOAT_BITS[dtype]
    width = -(-mantissa // 8)
    s = np.unpackbits(np.frombuffer(signs, np.uint8), count=n).astype(np.uint32)
    e = np.frombuffer(exponents, np.uint8, n).astype(np.uint32)
    parts = np.frombuffer(mantissas, np.uint8, n * width).reshape(n, width).astype(np.uint32)
    m = np.zeros(n, np.uint32)
    for i in range(width):
        m = (m << 8) | parts[:, i]
    x = (s << (total - 1)) | (e << mantissa) | m
    return x.astype(np.dtype(f"{'<' if byte_order == 'little' else '>'}u{total // 8}")).tobytes()


class FloatPlane(Codec):
    name = "floatplane"
    inner: Codec = Zstd()

    def compress(self, data, context):
        from blockloom.codecs.select import normalize_dtype

        dtype = normalize_dtype(context.dtype)
        if dtype not in FLOAT_BITS:
            got = BytePlane().compress(data, context)
            return Encoded(got.payload, self.name, got.metadata | {"transform": "byteplane_fallback"})
        signs, exponents, mantissas, tail, n = float_planes(data, dtype, context.byte_order)
        if n == 0:
            return Encoded(zlib.compress(data), self.name, {"transform": "none"})
        parts = [self.inner.compress(x, context).payload for x in (signs, exponents, mantissas)]
        body = b"".join(struct.pack(">I", len(p)) + p for p in parts) + tail
        return Encoded(body, self.name, {"transform": "floatplane", "dtype": dtype, "n_elements": n, "byte_order": context.byte_order, "inner_codec": self.inner.name})

    def decompress(self, payload, original_size, metadata):
        how = metadata["transform"]
        if how == "none":
            return inflate(payload, original_size)
        if how == "byteplane_fallback":
            return BytePlane().decompress(payload, original_size, metadata)
        n, dtype = int(metadata["n_elements"]), metadata["dtype"]
        width = -(-FLOAT_BITS[dtype][2] // 8)
        at, planes = 0, []
        for size in (-(-n // 8), n, n * width):
            (length,) = struct.unpack_from(">I", payload, at)
            planes.append(self.inner.decompress(payload[at + 4 : at + 4 + length], size, {}))
            at += 4 + length
        return merge_float_planes(*planes, n, dtype, metadata["byte_order"]) + payload[at:]


class QuantBlock(Codec):
    """The smallest of zstd, zlib, byte planes (for types with fixed storage blocks) and raw."""

    name = "gguf_quant_block"
    # Quantised types whose storage blocks repeat.
    PLANED = ("Q4_0", "Q4_1", "Q5_0", "Q5_1", "Q8_0", "Q8_1", "Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K", "Q8_K")

    def compress(self, data, context):
        if (context.dtype or "").upper() in ("F32", "F16", "BF16", "F64"):
            return Encoded(bytes(data), self.name, {"inner_codec": "raw", "candidates_tried": ["raw"]})
        tried: list[Codec] = [Zstd(), Zlib()] + ([BytePlane()] if (context.dtype or "").upper() in self.PLANED else []) + [Raw()]
        made = [c.compress(data, context) for c in tried]
        best = min(made, key=lambda e: len(e.payload))
        return Encoded(best.payload, self.name, {"inner_codec": best.codec, "inner_metadata": best.metadata, "candidates_tried": [c.name for c in tried]})

    def decompress(self, payload, original_size, metadata):
        inner = {c.name: c for c in (Zstd(), Zlib(), BytePlane(), Raw())}[metadata["inner_codec"]]
        return inner.decompress(payload, original_size, metadata.get("inner_metadata", {}))
