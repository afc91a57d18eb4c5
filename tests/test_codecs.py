import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom import codecs
from blockloom.codecs.core import float_planes, merge_float_planes


def lcg(seed=42):
    state = seed
    while True:
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        yield state


def bf16(n):
    g = lcg()
    return b"".join(struct.pack(">H", ((127 + next(g) % 5 - 2) << 7) | next(g) % 128) for _ in range(n))


SAMPLES = [b"", b"a", b"\x80", b"\xff" * 7, bytes(range(256)) * 5, b"A" * 5000, bf16(1024), bf16(100) + b"xyz", os.urandom(4096), np.array([1.5, -2.0, np.nan, np.inf, -np.inf, -0.0, 3e38], "<f4").tobytes(), (-np.ones(7, "<f4")).tobytes()]


@pytest.mark.parametrize("name", codecs.registered())
@pytest.mark.parametrize("dtype", [None, "BF16", "F16", "F32", "Q4_0", "I64", "bfloat16"])
@pytest.mark.parametrize("order", ["little", "big"])
def test_roundtrip(name, dtype, order):
    for data in SAMPLES:
        made = codecs.codec(name).compress(data, codecs.Context(dtype, byte_order=order))
        assert codecs.decode(made.payload, name, len(data), made.metadata) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["BF16", "FP16", "FP32"]), st.sampled_from(["little", "big"]))
def test_float_planes(data, dtype, order):
    s, e, m, tail, n = float_planes(data, dtype, order)
    assert merge_float_planes(s, e, m, n, dtype, order) + tail == data


def test_selection():
    assert codecs.select(b"A" * 4096, codecs.Context())[0].codec == "zstd"
    assert codecs.select(os.urandom(512), codecs.Context())[0].codec == "raw"
    got, tried = codecs.select(bf16(4096), codecs.Context("BF16", byte_order="big"))
    assert got.codec == "floatplane" and tried == 5
    assert codecs.candidates("BF16", is_gguf=True) == ("zstd", "zlib", "raw")
    assert codecs.select(b"abc", codecs.Context(path="x.gguf", dtype="F32"))[1] == 3
    assert codecs.normalize_dtype(" bfloat16 ") == "BF16"


def test_registry():
    with pytest.raises(ValueError):
        codecs.register("raw", codecs.Raw)
    with pytest.raises(ValueError):
        codecs.codec("nope")


@pytest.mark.parametrize("name", ["zlib", "zstd", "byteplane", "floatplane"])
def test_damaged_payloads(name):
    data = b"hello world, " * 100
    made = codecs.codec(name).compress(data, codecs.Context("F32"))
    for bad in (made.payload[:-3], made.payload[: len(made.payload) // 2], b"", b"\xff\xff\xff\xff" + made.payload[4:]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            codecs.decode(bad, name, len(data), made.metadata)
    with pytest.raises(Exception):  # noqa: B017, PT011  a bomb: more than the block may hold
        codecs.decode(codecs.codec("zstd").compress(b"0" * 10_000_000, codecs.Context()).payload, "zstd", 100, {})
