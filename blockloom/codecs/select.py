"""The registry of codecs, and the choice of one per block."""

from __future__ import annotations

from blockloom.codecs.core import BytePlane, Codec, Context, Encoded, FloatPlane, QuantBlock, Raw, Zlib, Zstd

_REGISTRY: dict[str, type[Codec]] = {}

# Other spellings of dtypes.
ALIASES = {"BFLOAT16": "BF16", "FLOAT16": "FP16", "FLOAT32": "FP32", "FLOAT64": "FP64"}
FLOATS = ("BF16", "FP16", "F16", "FP32", "F32")
PLAIN_CHAIN = ("zstd", "zlib", "raw")
FLOAT_CHAIN = ("floatplane", "byteplane", *PLAIN_CHAIN)


def register(name: str, kind: type[Codec]) -> None:
    if name in _REGISTRY:
        raise ValueError(f"codec {name!r} is registered already")
    _REGISTRY[name] = kind


for _kind in (Raw, Zlib, Zstd, BytePlane, FloatPlane, QuantBlock):
    register(_kind.name, _kind)


def registered() -> list[str]:
    return sorted(_REGISTRY)


def available(name: str) -> bool:
    return name in _REGISTRY


def codec(name: str) -> Codec:
    if name not in _REGISTRY:
        raise ValueError(f"unknown codec {name!r}; known: {', '.join(registered())}")
    return _REGISTRY[name]()


def normalize_dtype(dtype: str | None) -> str | None:
    if dtype is None:
        return None
    name = dtype.strip().upper()
    return ALIASES.get(name, name)


def candidates(dtype: str | None, is_gguf: bool = False) -> tuple[str, ...]:
    """Codecs to try, in order of priority."""
    return FLOAT_CHAIN if not is_gguf and normalize_dtype(dtype) in FLOATS else PLAIN_CHAIN


def select(data: bytes, context: Context, override: str | None = None, verify: bool = True) -> tuple[Encoded, int]:
    """(the smallest verified encoding, candidates tried); earlier candidates win ties, and raw is the last resort."""
    chain = (override,) if override and override != "auto" else candidates(context.dtype, context.path.lower().endswith(".gguf"))
    best, tried = None, 0
    for name in chain:
        c = codec(name)
        tried += 1
        try:
            made = c.compress(data, context)
            if best is not None and len(made.payload) >= len(best.payload):
                continue  # no gain; a block that nothing shrinks ends up raw
            if verify and c.decompress(made.payload, len(data), made.metadata) != data:
                continue
        except ValueError:  # so a codec says that it cannot take a block; anything else is a fault and is raised
            continue
        best = made
    return best or Encoded(bytes(data), "raw"), tried


def encode(data: bytes, name: str = "auto", context: Context | None = None) -> Encoded:
    return select(data, context or Context(), name)[0]


def decode(payload: bytes, name: str, original_size: int, metadata: dict | None = None) -> bytes:
    got = codec(name).decompress(payload, original_size, metadata or {})
    if len(got) != original_size:
        raise ValueError(f"decoded {len(got)} bytes, expected {original_size}")
    return got


def compress_block(data: bytes, level: int = 3) -> Encoded:
    """zstd, or raw where that does not help: the plain pair of functions for one block."""
    made = Zstd().compress(data, Context(level=level))
    return made if len(made.payload) < len(data) else Encoded(bytes(data), "raw")


def decompress_block(payload: bytes, name: str, original_size: int) -> bytes:
    """The counterpart; only codecs that need no metadata."""
    if name not in ("zstd", "zlib", "raw"):
        raise ValueError(f"{name!r} needs its metadata")
    return decode(payload, name, original_size)
