"""Table shapes of the tensor engine.

A tensor is one row of ``TENSORS`` and its values are row blocks in
``TENSOR_ROWS``: a physical row holds one row of the 2-D view, so windows,
deltas and products work on arrays and never need one record per cell.
"""

from pyspark.sql import types as T

TENSORS = T.StructType([
    T.StructField("tensor_name", T.StringType()), T.StructField("layer_idx", T.IntegerType()), T.StructField("dtype", T.StringType()),
    T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("row_dim", T.IntegerType()), T.StructField("col_dim", T.IntegerType()), T.StructField("n_elem", T.LongType()),
])
TENSOR_ROWS = T.StructType([T.StructField("layer_idx", T.IntegerType()), T.StructField("row_idx", T.IntegerType()), T.StructField("vals", T.ArrayType(T.FloatType()))])
BLOCKS = T.StructType([
    T.StructField("layer_idx", T.IntegerType()), T.StructField("group_id", T.IntegerType()), T.StructField("is_iframe", T.BooleanType()), T.StructField("part", T.StringType()),
    T.StructField("stream", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("raw_len", T.LongType()), T.StructField("blob", T.BinaryType()),
])

#: Fixed values of the element layouts: bits of sign, exponent, mantissa; bias; container tag; bytes held.
LAYOUTS = {"fp32": (1, 8, 23, 127, 0, 4), "bf16": (1, 8, 7, 127, 1, 2), "fp16": (1, 5, 10, 15, 2, 2), "fp8": (1, 4, 3, 7, 3, 1)}
