"""GGUF headers: a bounded parser and a DataFrame reader.

Real files begin with the ASCII letters GGUF; the byte order shows by which reading of the version is plausible.
Whatever is cut off or out of bounds ends the parse with a warning and what was read so far.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.operators.ggml import TYPES
from blockloom.session import ship

# Fixed values of the format: bytes of the scalar value types by id; 8 is a string and 9 an array.
SCALARS = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
MOST_KV, MOST_TENSORS, MOST_DIMS, MOST_STRING, MOST_ARRAY = 10_000, 100_000, 8, 1_000_000, 1_000_000
#: Byte-swapped spellings of the magic that only test fixtures use; read only when asked for.
FIXTURE_MAGICS = {bytes.fromhex("47554746"): "<", bytes.fromhex("46475547"): ">"}
_NAMES = {t[0]: t for t in TYPES}


class GgufError(ValueError):
    pass


class _Cursor:
    def __init__(self, data: bytes, order: str, at: int):
        self.data, self.order, self.at = data, order, at

    def take(self, form: str) -> int:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise GgufError("cut off")
        (x,) = struct.unpack_from(self.order + form, self.data, self.at)
        self.at += size
        return x

    def skip(self, n: int) -> None:
        if n < 0 or self.at + n > len(self.data):
            raise GgufError("cut off")
        self.at += n

    def text(self) -> str:
        n = self.take("Q")
        if n > MOST_STRING:
            raise GgufError("string too long")
        a = self.at
        self.skip(n)
        return self.data[a : a + n].decode("utf-8", "replace")

    def value(self, kind: int, depth: int = 0) -> None:
        if kind in SCALARS:
            self.skip(SCALARS[kind])
        elif kind == 8:
            self.text()
        elif kind == 9 and depth < 8:
            inner, n = self.take("I"), self.take("Q")
            if n > MOST_ARRAY:
                raise GgufError("array too long")
            if inner in SCALARS:
                self.skip(n * SCALARS[inner])
            else:
                for _ in range(n):
                    self.value(inner, depth + 1)
        else:
            raise GgufError(f"value type {kind}")


def byte_order(data: bytes, fixtures: bool = False) -> str:
    if len(data) < 8:
        raise GgufError("too small")
    if data[:4] == b"GGUF":
        for order in "<>":
            if struct.unpack_from(order + "I", data, 4)[0] in (1, 2, 3):
                return order
        raise GgufError("unsupported version")
    if fixtures and data[:4] in FIXTURE_MAGICS:
        order = FIXTURE_MAGICS[data[:4]]
        if struct.unpack_from(order + "I", data, 4)[0] in (1, 2, 3):
            return order
        raise GgufError("unsupported version")
    raise GgufError("bad magic")


def parse(data: bytes, with_tensors: bool = True, fixtures: bool = False) -> dict:
    """Version, byte order, counts, tensors and warnings; GgufError if it is no such file."""
    order = byte_order(data, fixtures)
    c = _Cursor(data, order, 4)
    version = c.take("I")
    form = "I" if version == 1 else "Q"
    out = {"version": version, "endianness": "little" if order == "<" else "big", "tensor_count": c.take(form), "kv_count": c.take(form), "tensors": [], "warnings": []}
    if not with_tensors or version == 1:
        return out
    if out["kv_count"] > MOST_KV or out["tensor_count"] > MOST_TENSORS:
        out["warnings"].append("counts beyond the allowed number")
        return out
    try:
        for _ in range(out["kv_count"]):
            c.text()
            c.value(c.take("I"))
        for _ in range(out["tensor_count"]):
            name, n = c.text(), c.take("I")
            if n > MOST_DIMS:
                raise GgufError("too many dimensions")
            shape = [c.take("Q") for _ in range(n)]
            kind, offset = c.take("I"), c.take("Q")
            _, label, block, per = _NAMES.get(kind, (kind, str(kind), None, None))
            size = None
            if shape and block:
                elements = 1
                for x in shape:
                    elements *= x
                size = -(-elements // per) * block
                size = size if size < 2**63 else None
            out["tensors"].append({"name": name, "shape": [min(x, 2**63 - 1) for x in shape], "ggml_type": label, "offset": min(offset, 2**63 - 1), "estimated_size": size})
    except GgufError as e:
        out["warnings"].append(str(e))
    return out


SCHEMA = "version int, endianness string, tensor_count decimal(20,0), kv_count decimal(20,0), tensors array<struct<name: string, shape: array<bigint>, ggml_type: string, offset: bigint, estimated_size: bigint>>, warnings array<string>, error string"


def read(files: DataFrame, with_tensors: bool = True, fixtures: bool = False) -> DataFrame:
    """(path, header fields, error) of files (path, content)."""
    ship(files.sparkSession)
    tensor = pa.struct([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("ggml_type", pa.string()), ("offset", pa.int64()), ("estimated_size", pa.int64())])
    kinds = {"version": pa.int32(), "endianness": pa.string(), "tensor_count": pa.decimal128(20, 0), "kv_count": pa.decimal128(20, 0), "tensors": pa.list_(tensor), "warnings": pa.list_(pa.string()), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                try:
                    got = parse(x or b"", with_tensors, fixtures) | {"error": None}
                    got["tensor_count"], got["kv_count"] = Decimal(got["tensor_count"]), Decimal(got["kv_count"])
                except GgufError as e:
                    got = {"error": str(e)}
                rows.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=["path", *kinds])

    return files.select("path", "content").mapInArrow(run, "path string, " + SCHEMA)


def build(tensors: list[tuple[str, list[int], int, int]], kv: int = 0, version: int = 3, order: str = "<", magic: bytes = b"GGUF", claim: int | None = None) -> bytes:
    """A header of (name, shape, type id, offset) rows with ``kv`` small pairs; for tests."""
    form = "I" if version == 1 else "Q"
    out = magic + struct.pack(order + "I" + form * 2, version, len(tensors) if claim is None else claim, kv)
    for i in range(kv):
        key = f"key.{i}".encode()
        out += struct.pack(order + "Q", len(key)) + key + (struct.pack(order + "IB", 7, 1) if i % 2 else struct.pack(order + "II", 4, i))
    for name, shape, kind, offset in tensors:
        n = name.encode()
        out += struct.pack(order + "Q", len(n)) + n + struct.pack(order + f"I{len(shape)}QIQ", len(shape), *shape, kind, offset)
    return out
