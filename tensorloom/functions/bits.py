"""Bit fields of floating-point codes as column expressions.

The raw code of a 32-bit float comes from an Arrow view of the column's buffer (no
copy, no loop); everything after that is shifts and masks inside whole-stage
codegen. Codes of narrower layouts are plain integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tensorloom.schemas import LAYOUTS


def _view(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return pa.ListArray.from_arrays(column.offsets, _view(column.values, kind), mask=column.is_null() if column.null_count and not column.offset else None)
    return column.view(kind)


@arrow_udf(T.ArrayType(T.IntegerType()))
def codes(vals: pa.Array) -> pa.Array:
    """Raw fp32 codes of an array of floats, as signed 32-bit integers; exact for every pattern."""
    return _view(vals, pa.int32())


@arrow_udf(T.ArrayType(T.FloatType()))
def from_codes(vals: pa.Array) -> pa.Array:
    """The floats of raw fp32 codes."""
    return _view(vals, pa.float32())


@arrow_udf(T.IntegerType())
def code(value: pa.Array) -> pa.Array:
    """The raw fp32 code of a single float column."""
    return _view(value, pa.int32())


@arrow_udf(T.ArrayType(T.IntegerType()))
def half_codes(vals: pa.Array) -> pa.Array:
    """Raw fp16 codes of floats, rounded to nearest even as hardware does; out of range is infinity."""
    if isinstance(vals, pa.ChunkedArray):
        vals = vals.combine_chunks()
    with np.errstate(over="ignore"):
        half = vals.values.to_numpy(zero_copy_only=False).astype(np.float16)
    return pa.ListArray.from_arrays(vals.offsets, pa.array(half.view(np.uint16).astype(np.int32)))


@arrow_udf(T.ArrayType(T.FloatType()))
def from_half_codes(vals: pa.Array) -> pa.Array:
    """The floats of raw fp16 codes."""
    if isinstance(vals, pa.ChunkedArray):
        vals = vals.combine_chunks()
    half = vals.values.to_numpy(zero_copy_only=False).astype(np.uint16).view(np.float16)
    return pa.ListArray.from_arrays(vals.offsets, pa.array(half.astype(np.float32)))


def fields(raw: Column, layout: str = "fp32") -> tuple[Column, Column, Column]:
    """(sign, exponent, mantissa) of a raw code of the layout, as ints."""
    _, exp, mant, *_ = LAYOUTS[layout]
    raw = raw.cast("int")
    sign = F.shiftrightunsigned(raw, exp + mant).bitwiseAND(F.lit(1))
    return sign, F.shiftrightunsigned(raw, mant).bitwiseAND(F.lit((1 << exp) - 1)), raw.bitwiseAND(F.lit((1 << mant) - 1))


def merge(sign: Column, exponent: Column, mantissa: Column, layout: str = "fp32") -> Column:
    """The raw code of the three fields: the inverse of :func:`fields`."""
    _, exp, mant, *_ = LAYOUTS[layout]
    return F.shiftleft(sign.cast("int"), exp + mant).bitwiseOR(F.shiftleft(exponent.cast("int"), mant)).bitwiseOR(mantissa.cast("int"))


def layout_of(dtype: Column) -> Column:
    """The layout of a dtype name; dtypes without one are held as fp32."""
    return F.when(dtype.isin("float32", "float"), "fp32").when(dtype == "uint16", "bf16").when(dtype == "float16", "fp16").when(dtype == "uint8", "fp8").otherwise("fp32")


def is_float(dtype: Column) -> Column:
    """Native floats, and uint16 as the carrier of bf16."""
    return dtype.isin("float16", "float32", "float64", "uint16")


def stored_dtype(dtype: Column) -> Column:
    """What a dtype is stored as: fp16 and fp32 stay, all else becomes fp32."""
    return F.when(dtype.isin("float16", "float32"), dtype).otherwise("float32")


def bf16_truncated(raw: Column) -> Column:
    """bf16 code by dropping the low half of an fp32 code."""
    return F.shiftrightunsigned(raw, 16)


def bf16_rounded(raw: Column) -> Column:
    """bf16 code by rounding to nearest even, on 32 unsigned bits that wrap."""
    wide = raw.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    odd = F.shiftright(wide, 16).bitwiseAND(F.lit(1))
    return F.shiftright((wide + 0x7FFF + odd).bitwiseAND(F.lit(0xFFFFFFFF)), 16).cast("int")


def bf16_widened(half: Column) -> Column:
    """The fp32 code of a bf16 code."""
    return F.shiftleft(half.cast("int"), 16)


def unsigned(raw: Column) -> Column:
    """A 32-bit code as a non-negative long."""
    return raw.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def byte_planes(mantissa: Column) -> Column:
    """The three bytes of a 23-bit mantissa, lowest first: no padding byte is coded."""
    return F.array(*[F.shiftrightunsigned(mantissa, 8 * k).bitwiseAND(F.lit(255)) for k in range(3)])


def finite_or_zero(value: Column) -> Column:
    """NaN and infinities become 0, as factorisation needs."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def pack_flags(flags: Column) -> Column:
    """An array of 0 and 1 as an array of bytes (0 to 255), most significant bit first; the last byte is padded with 0."""
    n_bytes = F.ceil(F.size(flags) / 8).cast("int")
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, k: acc * 2 + F.coalesce(F.get(flags, i * 8 + k).cast("int"), F.lit(0)))
    return F.when(F.size(flags) > 0, F.transform(F.sequence(F.lit(0), n_bytes - 1), byte)).otherwise(F.array().cast("array<int>"))


def unpack_flags(packed: Column, count: Column) -> Column:
    """The first ``count`` flags of packed bytes: the inverse of :func:`pack_flags`."""
    places = F.sequence(F.lit(0), count.cast("int") - 1)
    flag = lambda p: F.call_function("shiftright", F.get(packed, F.floor(p / 8).cast("int")), (F.lit(7) - p % 8).cast("int")).bitwiseAND(F.lit(1))
    return F.when(count > 0, F.transform(places, flag)).otherwise(F.array().cast("array<int>"))
