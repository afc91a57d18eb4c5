"""Lossless block codecs, their registry, and the choice of the smallest."""

from blockloom.codecs.core import BytePlane, Codec, Context, Encoded, FloatPlane, QuantBlock, Raw, Zlib, Zstd
from blockloom.codecs.select import available, candidates, codec, compress_block, decode, decompress_block, encode, normalize_dtype, register, registered, select

__all__ = ["BytePlane", "Codec", "Context", "Encoded", "FloatPlane", "QuantBlock", "Raw", "Zlib", "Zstd", "available", "candidates", "codec", "compress_block", "decode", "decompress_block", "encode", "normalize_dtype", "register", "registered", "select"]
