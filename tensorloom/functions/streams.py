"""Sign, exponent and mantissa streams of whole tensors, and back, bit for bit."""

from __future__ import annotations

import struct

import numpy as np

from tensorloom.schemas import LAYOUTS

_CARRIER = {4: np.uint32, 2: np.uint16, 1: np.uint8}


def layout_of(dtype: np.dtype) -> str:
    """The layout of an array's dtype; uint16 carries bf16 and uint8 carries fp8."""
    return {"float32": "fp32", "uint16": "bf16", "float16": "fp16", "uint8": "fp8"}.get(str(dtype), "fp32")


def pack_bits(flags: np.ndarray) -> bytes:
    """u32 count, then the bits, most significant first."""
    return struct.pack("<I", flags.size) + np.packbits(flags.astype(np.uint8)).tobytes()


def unpack_bits(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", blob)
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=4), count=n)


def split(array: np.ndarray) -> dict:
    """The three streams of an array with its layout and shape."""
    layout = layout_of(array.dtype)
    _, exp, mant, _, _, size = LAYOUTS[layout]
    if array.dtype.itemsize != size:
        raise ValueError(f"no layout for {array.dtype}")
    raw = np.ascontiguousarray(array).reshape(-1).view(_CARRIER[size]).astype(np.uint32)
    wide = np.uint16 if layout == "fp16" else _CARRIER[size] if layout != "bf16" else np.uint8
    return {
        "layout": layout, "shape": tuple(array.shape), "sign": pack_bits(raw >> np.uint32(exp + mant)),
        "exp": (raw >> np.uint32(mant) & np.uint32((1 << exp) - 1)).astype(np.uint8).tobytes(), "mant": (raw & np.uint32((1 << mant) - 1)).astype(wide).tobytes(),
    }


def merge(streams: dict) -> np.ndarray:
    """The array of :func:`split`: float32 and float16 as such, bf16 and fp8 as their codes."""
    layout = streams["layout"]
    _, exp, mant, _, _, size = LAYOUTS[layout]
    wide = np.uint16 if layout == "fp16" else _CARRIER[size] if layout != "bf16" else np.uint8
    sign = unpack_bits(streams["sign"]).astype(np.uint32)
    raw = sign << np.uint32(exp + mant) | np.frombuffer(streams["exp"], np.uint8).astype(np.uint32) << np.uint32(mant) | np.frombuffer(streams["mant"], wide).astype(np.uint32)
    codes = raw.astype(_CARRIER[size])
    kind = {"fp32": np.float32, "fp16": np.float16}.get(layout)
    return (codes.view(kind) if kind else codes).reshape(streams["shape"])


def widen(array: np.ndarray) -> np.ndarray:
    """To float32; bf16 codes by zero extension."""
    if array.dtype == np.uint16:
        return (array.astype(np.uint32) << np.uint32(16)).view(np.float32)
    return array.astype(np.float32)


def analyse(streams: dict) -> dict:
    """Bytes and entropy (bits a byte; 0 if empty) of each stream."""
    out = {}
    for name in ("sign", "exp", "mant"):
        counts = np.bincount(np.frombuffer(streams[name], np.uint8), minlength=256)
        p = counts[counts > 0] / max(1, counts.sum())
        out[name] = {"bytes": len(streams[name]), "entropy": float(-(p * np.log2(p)).sum()) + 0.0}
    return out
