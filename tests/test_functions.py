"""Small column functions and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import bits, codecs, streams
from tensorloom.operators import entropy
from tensorloom.sources import container


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 77])
def test_flags_pack_like_numpy(spark, n):
    flags = np.random.default_rng(n).integers(0, 2, n).tolist()
    df = spark.createDataFrame([(flags,)], "f array<int>").withColumn("p", bits.pack_flags(F.col("f")))
    row = df.withColumn("u", bits.unpack_flags(F.col("p"), F.size("f"))).first()
    assert row.p == np.packbits(np.array(flags, np.uint8)).tolist() and row.u == flags


def test_slot_map(spark):
    table = spark.createDataFrame([("a", 3, 10, 30_000), ("a", 9, 1, 2_768)], "k string, sym int, cnt long, freq long")
    got = entropy.slot_map(table, "k").groupBy("sym").agg(F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert {(r.sym, r.low, r.high) for r in got} == {(3, 0, 29_999), (9, 30_000, 32_767)}


def test_huffman_table_and_analysis():
    assert len(codecs.huffman_table(np.arange(256))) == 1280
    found = streams.analyse(streams.split(np.zeros(16, np.float32)))
    assert found["exp"] == {"bytes": 16, "entropy": 0.0} and streams.analyse(streams.split(np.zeros(0, np.float32)))["mant"]["entropy"] == 0


def test_layouts_of_dtypes(spark):
    names = ["float32", "float16", "uint16", "uint8", "float64", "int8"]
    df = spark.createDataFrame([(n,) for n in names], "d string")
    got = {r.d: (r.l, r.f, r.s) for r in df.select("d", bits.layout_of(F.col("d")).alias("l"), bits.is_float(F.col("d")).alias("f"), bits.stored_dtype(F.col("d")).alias("s")).collect()}
    assert got == {"float32": ("fp32", True, "float32"), "float16": ("fp16", True, "float16"), "uint16": ("bf16", True, "float32"), "uint8": ("fp8", False, "float32"), "float64": ("fp32", True, "float32"), "int8": ("fp32", False, "float32")}


@pytest.mark.parametrize("layout", ["fp32", "bf16", "fp16", "fp8"])
def test_fields_merge(spark, layout):
    codes = list(range(256)) if layout == "fp8" else list(range(0, 65536, 37)) if layout != "fp32" else [0, 1, -1, -2147483648, 2139095040, 123456789]
    df = spark.createDataFrame([(c,) for c in codes], "raw int")
    assert df.where(bits.merge(*bits.fields(F.col("raw"), layout), layout) != F.col("raw")).count() == 0


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("-inf"),)], "v double")
    assert [r[0] for r in df.select(bits.finite_or_zero(F.col("v"))).collect()] == [1.5, 0.0, 0.0]


def test_unpack_block_in_sql(spark):
    container.register(spark)
    array = np.random.default_rng(0).standard_normal((4, 5)).astype(np.float32)
    block = container.pack_block(True, array, np.zeros((1, 1), np.float32), (4, 5), "rans")
    spark.createDataFrame([(bytearray(block),)], "b binary").createOrReplaceTempView("blocks")
    rows = spark.sql("SELECT t.* FROM blocks, LATERAL tl_unpack_block(b, 'rans') t").collect()
    assert [(r["part"], r.stream, r.codec) for r in rows][:3] == [("R", "sign", "zlib"), ("R", "exp", "rans"), ("R", "mant", "rans")]
    assert rows[1].raw_len == 20 and codecs.rans_decode(bytes(rows[1].blob)) == streams.split(array)["exp"]
