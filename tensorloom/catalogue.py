"""The registered queries of the tensor engine and their DuckDB SQL.

Carrier tables stand in for weights: 50 embedding vectors are a layer of 50 x 64
(``vec_id div 50``), or a vector is a column of a tensor with 64 rows; lineitem
quantities by supplier are layers whose drift breaks; texts are byte streams.
Every query covers its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import bits, codecs
from tensorloom.operators import choose, delta, drift, entropy, factor
from tensorloom.operators import tensors as T
from tensorloom.plans import codec
from tensorloom.plans.lineage import shared_base
from tensorloom.sources import container
from tensorloom.streaming import layers as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as layers of 50 rows."""
    return T.rows_of(load(spark, sf_dir, "embeddings"), "embedding", F.expr("vec_id div 50"), F.col("vec_id") % 50)


def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layers in groups of eight."""
    return layer_rows(spark, sf_dir).withColumn("group_id", F.expr("layer_idx div 8"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder on the storage that all executors share."""
    return f"{shared_base(spark).removeprefix('file://')}/{uuid.uuid4().hex}"


# Parts of the SQL.
_CELL = """
SELECT vec_id // 50 AS layer_idx, vec_id % 50 AS row_idx, i - 1 AS c, label, embedding[i]::FLOAT AS v,
       embedding[i]::FLOAT::BIT::INTEGER::BIGINT & 4294967295 AS u
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"""
_FIELDS = "(u >> 31) AS s, ((u >> 23) & 255) AS e, (u & 8388607) AS m"


@query(f"SELECT layer_idx::INTEGER AS layer_idx, count(*) AS n, sum(u >> 31)::BIGINT AS sum_sign, sum((u >> 23) & 255)::BIGINT AS sum_exp, sum(u & 8388607)::BIGINT AS sum_mant FROM ({_CELL}) GROUP BY layer_idx")
def q01_fp32_fields(spark, sf_dir):
    s, e, m = bits.fields(F.col("raw"))
    return T.cells(layer_rows(spark, sf_dir), "layer_idx").groupBy("layer_idx").agg(F.count("*").alias("n"), F.sum(s.cast("long")).alias("sum_sign"), F.sum(e.cast("long")).alias("sum_exp"), F.sum(m.cast("long")).alias("sum_mant"))


@query(f"SELECT layer_idx::INTEGER AS layer_idx, count(*) AS n, 0::BIGINT AS mismatches FROM ({_CELL}) GROUP BY layer_idx")
def q02_rebuild(spark, sf_dir):
    cells = T.cells(layer_rows(spark, sf_dir), "layer_idx")
    return cells.groupBy("layer_idx").agg(F.count("*").alias("n"), F.count_if(bits.merge(*bits.fields(F.col("raw"))) != F.col("raw")).alias("mismatches"))


@query(f"""WITH c AS ({_CELL}), r AS (SELECT layer_idx, u >> 16 AS t, ((u + 32767 + ((u >> 16) & 1)) & 4294967295) >> 16 AS h FROM c)
SELECT layer_idx::INTEGER AS layer_idx, sum(t)::BIGINT AS sum_truncated, sum(h)::BIGINT AS sum_rounded, sum(h >> 15)::BIGINT AS sum_sign, sum((h >> 7) & 255)::BIGINT AS sum_exp, sum(h & 127)::BIGINT AS sum_mant FROM r GROUP BY layer_idx""")
def q03_bf16(spark, sf_dir):
    cells = T.cells(layer_rows(spark, sf_dir), "layer_idx").select("layer_idx", bits.bf16_truncated(F.col("raw")).alias("t"), bits.bf16_rounded(F.col("raw")).alias("h"))
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    return cells.groupBy("layer_idx").agg(total(F.col("t"), "sum_truncated"), total(F.col("h"), "sum_rounded"), *[total(c, n) for c, n in zip(bits.fields(F.col("h"), "bf16"), ("sum_sign", "sum_exp", "sum_mant"))])


@query("""WITH c AS (SELECT l_linenumber, l_partkey % 256 AS b, (l_orderkey * 40503 + l_linenumber) % 65536 AS h FROM lineitem)
SELECT l_linenumber, sum(b >> 7)::BIGINT AS fp8_sign, sum((b >> 3) & 15)::BIGINT AS fp8_exp, sum(b & 7)::BIGINT AS fp8_mant,
       sum(h >> 15)::BIGINT AS fp16_sign, sum((h >> 10) & 31)::BIGINT AS fp16_exp, sum(h & 1023)::BIGINT AS fp16_mant FROM c GROUP BY l_linenumber""")
def q04_narrow_fields(spark, sf_dir):
    codes = load(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_partkey") % 256).alias("b"), ((F.col("l_orderkey") * 40503 + F.col("l_linenumber")) % 65536).alias("h"))
    sums = [F.sum(c.cast("long")).alias(f"{layout}_{n}") for layout, column in (("fp8", "b"), ("fp16", "h")) for c, n in zip(bits.fields(F.col(column), layout), ("sign", "exp", "mant"))]
    return codes.groupBy("l_linenumber").agg(*sums)


@query(f"SELECT layer_idx::INTEGER AS layer_idx, ((row_idx * 64 + c) // 8)::INTEGER AS byte_idx, sum((u >> 31) << (7 - (row_idx * 64 + c) % 8))::BIGINT AS packed FROM ({_CELL}) GROUP BY 1, 2")
def q05_packed_signs(spark, sf_dir):
    pos = F.col("row_idx") * 64 + F.col("c")
    sign, _, _ = bits.fields(F.col("raw"))
    cells = T.cells(layer_rows(spark, sf_dir)).select("layer_idx", F.expr("(row_idx * 64 + c) div 8").cast("int").alias("byte_idx"), (sign.cast("long") * F.pow(F.lit(2), 7 - pos % 8).cast("long")).alias("bit"))
    return cells.groupBy("layer_idx", "byte_idx").agg(F.sum("bit").alias("packed"))


def _exponents(spark, sf_dir):
    return entropy.histogram(T.cells(layer_rows(spark, sf_dir), "layer_idx").withColumn("sym", bits.fields(F.col("raw"))[1]), "layer_idx")


@query(f"SELECT layer_idx::INTEGER AS layer_idx, ((u >> 23) & 255)::INTEGER AS sym, count(*) AS cnt FROM ({_CELL}) GROUP BY 1, 2")
def q06_exponent_histogram(spark, sf_dir):
    return _exponents(spark, sf_dir)


@query(f"""WITH c AS (SELECT label, {_FIELDS} FROM ({_CELL})),
x AS (SELECT label, 'sign' AS stream, s AS sym FROM c UNION ALL SELECT label, 'exp', e FROM c
      UNION ALL SELECT label, 'mant', unnest([m & 255, (m >> 8) & 255, m >> 16]) FROM c),
h AS (SELECT label, stream, sym, count(*) AS cnt FROM x GROUP BY ALL)
SELECT label, stream, sum(cnt)::BIGINT AS n_symbols, round(greatest(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 0), 6) AS entropy FROM h GROUP BY label, stream""")
def q07_stream_entropy(spark, sf_dir):
    cells = load(spark, sf_dir, "embeddings").select("label", bits.codes(F.col("embedding").cast("array<float>")).alias("raw")).select("label", F.explode("raw").alias("raw"))
    s, e, m = bits.fields(F.col("raw"))
    # The three fields are counted in one pass; planes of the mantissa fold into one stream.
    streams = F.array(F.struct(F.lit("sign").alias("stream"), s.alias("sym")), F.struct(F.lit("exp").alias("stream"), e.alias("sym")), *[F.struct(F.lit("mant").alias("stream"), F.shiftrightunsigned(m, 8 * k).bitwiseAND(F.lit(255)).alias("sym")) for k in range(3)])
    symbols = cells.select("label", F.explode(streams).alias("x")).select("label", "x.stream", "x.sym")
    return entropy.entropy(entropy.histogram(symbols, "label", "stream"), "label", "stream")


_TEXT = """
WITH b AS (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
t AS (SELECT lang, ('0x' || x)::INTEGER AS sym, count(*) AS cnt FROM b GROUP BY ALL)"""


def _text_counts(spark, sf_dir):
    return entropy.byte_histogram(load(spark, sf_dir, "documents"), "lang", "text")


@query(f"{_TEXT} SELECT lang, sum(cnt)::BIGINT AS n_symbols, round(greatest(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 0), 6) AS entropy FROM t GROUP BY lang")
def q08_text_entropy(spark, sf_dir):
    return entropy.entropy(_text_counts(spark, sf_dir), "lang")


_FREQ = f"""{_TEXT},
f0 AS (SELECT *, greatest((cnt * 32768) // (sum(cnt) OVER (PARTITION BY lang))::BIGINT, 1) AS base FROM t),
f1 AS (SELECT *, 32768 - (sum(base) OVER (PARTITION BY lang))::BIGINT AS gap, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS place,
              row_number() OVER (PARTITION BY lang ORDER BY base DESC, sym) AS high FROM f0),
s0 AS (SELECT lang, sym, high, gap, unnest(range(1, least(base - 1, -gap) + 1)) AS round FROM f1 WHERE gap < 0 AND base > 1),
s1 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round, high) AS o FROM s0),
s2 AS (SELECT lang, sym, count(*) AS taken FROM s1 WHERE o <= -gap GROUP BY ALL),
f AS (SELECT f1.lang, f1.sym, cnt, (base + CASE WHEN place <= gap THEN 1 ELSE 0 END - coalesce(taken, 0))::BIGINT AS freq FROM f1 LEFT JOIN s2 ON f1.lang = s2.lang AND f1.sym = s2.sym)"""


@query(f"{_FREQ} SELECT lang, sym, cnt, freq FROM f")
def q09_frequency_table(spark, sf_dir):
    return entropy.frequency_table(_text_counts(spark, sf_dir), "lang")


@query(f"{_FREQ}, g AS (SELECT lang, sym, cnt, freq, coalesce(sum(freq) OVER (PARTITION BY lang ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f) SELECT *, start + freq AS stop FROM g")
def q10_slots(spark, sf_dir):
    return entropy.slots(entropy.frequency_table(_text_counts(spark, sf_dir), "lang"), "lang")


@query(f"{_FREQ} SELECT lang, sum(cnt)::BIGINT AS raw_bytes, round(sum(cnt * (15 - log2(freq))) / 8, 3) AS cost_bytes FROM f GROUP BY lang")
def q11_model_cost(spark, sf_dir):
    return entropy.model_cost(entropy.frequency_table(_text_counts(spark, sf_dir), "lang"), "lang")


_NEIGHBOUR = "OVER (PARTITION BY layer_idx // 8, row_idx, c ORDER BY layer_idx)"
_MATCHED = f"""WITH c AS ({_CELL}), n AS (SELECT layer_idx, count(*) AS size FROM c GROUP BY layer_idx),
k AS (SELECT layer_idx, size, lag(size) OVER (PARTITION BY layer_idx // 8 ORDER BY layer_idx) AS before FROM n),
d0 AS (SELECT c.*, before IS NULL OR before <> size AS i FROM c JOIN k ON c.layer_idx = k.layer_idx),
d AS (SELECT *, lag(u) {_NEIGHBOUR} AS pu, lag(v) {_NEIGHBOUR} AS pv FROM d0)"""


@query(f"{_MATCHED} SELECT layer_idx::INTEGER AS layer_idx, any_value(i) AS is_iframe, sum(CASE WHEN i THEN u ELSE xor(u, pu) END)::BIGINT AS sum_codes FROM d GROUP BY layer_idx")
def q12_xor_delta(spark, sf_dir):
    frames = delta.encode(grouped_rows(spark, sf_dir), "bits")
    return frames.groupBy("layer_idx").agg(F.max("is_iframe").alias("is_iframe"), F.sum(F.aggregate("data", F.lit(0).cast("long"), lambda acc, x: acc + bits.unsigned(x))).alias("sum_codes"))


@query(f"{_MATCHED} SELECT layer_idx::INTEGER AS layer_idx, any_value(i) AS is_iframe, round(sum(CASE WHEN i THEN v ELSE (v - pv)::FLOAT END::DOUBLE), 6) + 0.0 AS sum_delta, round(sum(abs(CASE WHEN i THEN v ELSE (v - pv)::FLOAT END::DOUBLE)), 6) AS sum_abs FROM d GROUP BY layer_idx")
def q13_arithmetic_delta(spark, sf_dir):
    frames = delta.encode(grouped_rows(spark, sf_dir), "arith")
    total = lambda f: F.round(F.sum(F.aggregate("data", F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))), 6) + F.lit(0.0)
    return frames.groupBy("layer_idx").agg(F.max("is_iframe").alias("is_iframe"), total(lambda x: x).alias("sum_delta"), total(F.abs).alias("sum_abs"))


@query(f"SELECT layer_idx::INTEGER AS layer_idx, count(*) AS n, 0::BIGINT AS mismatches FROM ({_CELL}) GROUP BY layer_idx")
def q14_undelta(spark, sf_dir):
    rows = grouped_rows(spark, sf_dir)
    back = delta.decode(delta.encode(rows, "bits"), "bits").select("layer_idx", "row_idx", bits.codes("vals").alias("b"))
    both = rows.select("layer_idx", "row_idx", bits.codes("vals").alias("a")).join(back, ["layer_idx", "row_idx"])
    wrong = F.size(F.filter(F.zip_with("a", "b", lambda a, b: a == b), lambda same: ~same))
    return both.groupBy("layer_idx").agg(F.sum(F.size("a").cast("long")).alias("n"), F.sum(wrong.cast("long")).alias("mismatches"))


@query("""WITH c AS (SELECT user_id, ts, event_id, round(value * 100)::BIGINT AS cents FROM events),
d AS (SELECT user_id, cents, cents - lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM c)
SELECT user_id, count(*) AS n, coalesce(sum(abs(d)), 0)::BIGINT AS sum_abs_delta, max(d)::BIGINT AS max_delta FROM d GROUP BY user_id""")
def q15_user_deltas(spark, sf_dir):
    cents = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    step = F.col("cents") - F.lag("cents").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return cents.withColumn("d", step).groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.abs("d")), F.lit(0)).cast("long").alias("sum_abs_delta"), F.max("d").alias("max_delta"))


_DRIFT = """
WITH c AS (SELECT l_suppkey AS layer_idx, (l_quantity / 7.5)::FLOAT AS v FROM lineitem),
l AS (SELECT layer_idx, min(v) AS low, max(v) AS high, count(*) AS n FROM c GROUP BY layer_idx),
p0 AS (SELECT layer_idx, lag(layer_idx) OVER o AS prev, low, high, n, lag(low) OVER o AS pl, lag(high) OVER o AS ph, lag(n) OVER o AS pn FROM l WINDOW o AS (ORDER BY layer_idx)),
p AS (SELECT layer_idx, prev, n, pn, least(low, pl)::DOUBLE AS lo, (greatest(high, ph)::DOUBLE + 1e-8::FLOAT::DOUBLE)::FLOAT::DOUBLE AS hi FROM p0 WHERE prev IS NOT NULL),
b AS (SELECT p.layer_idx, least(CASE WHEN hi > lo THEN floor((v::DOUBLE - lo) / (hi - lo) * 32) ELSE 0 END, 31)::INTEGER AS bin,
             count(*) FILTER (c.layer_idx = p.layer_idx) AS c0, count(*) FILTER (c.layer_idx = prev) AS c1
      FROM p JOIN c ON c.layer_idx = p.layer_idx OR c.layer_idx = prev GROUP BY 1, 2),
o AS (SELECT p.layer_idx, lo, hi, sum(least(c0::DOUBLE / n, c1::DOUBLE / pn)) AS overlap FROM b JOIN p ON b.layer_idx = p.layer_idx GROUP BY ALL),
dist AS (SELECT layer_idx, 1 - least(overlap * 32 / greatest(hi - lo, 1e-300) / (hi - lo + 1e-8), 1) AS distance FROM o)"""


def _distances(spark, sf_dir):
    values = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("layer_idx"), (F.col("l_quantity") / 7.5).cast("float").alias("v"))
    return drift.distances(values)


@query(f"{_DRIFT} SELECT layer_idx, round(distance, 6) AS distance FROM dist")
def q16_drift(spark, sf_dir):
    return _distances(spark, sf_dir).select("layer_idx", F.round("distance", 6).alias("distance"))


@query(f"""{_DRIFT},
s0 AS (SELECT l.layer_idx, CASE WHEN distance IS NULL OR distance > 0.35 THEN 1 ELSE 0 END AS brk FROM l LEFT JOIN dist ON l.layer_idx = dist.layer_idx),
s1 AS (SELECT *, sum(brk) OVER (ORDER BY layer_idx) AS run FROM s0),
s2 AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY layer_idx) - 1) // 8 AS sub FROM s1),
s3 AS (SELECT *, dense_rank() OVER (ORDER BY run, sub) - 1 AS g FROM s2),
s4 AS (SELECT *, max(g) OVER () AS last, count(*) OVER (PARTITION BY g) AS size FROM s3),
s5 AS (SELECT layer_idx, g - CASE WHEN g = last AND g > 0 AND size < 2 THEN 1 ELSE 0 END AS group_id FROM s4)
SELECT layer_idx, group_id::INTEGER AS group_id, (row_number() OVER (PARTITION BY group_id ORDER BY layer_idx) - 1)::INTEGER AS pos_in_group FROM s5""")
def q17_segments(spark, sf_dir):
    layers = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("layer_idx")).distinct()
    return drift.segments(layers.join(_distances(spark, sf_dir), "layer_idx", "left"))


@query(f"""{_MATCHED}, x AS (SELECT layer_idx, any_value(i) AS i, sum(abs(CASE WHEN i THEN v ELSE (v - pv)::FLOAT END::DOUBLE)) AS dd, sum(abs(v::DOUBLE)) AS ww FROM d GROUP BY layer_idx),
y AS (SELECT count(*) FILTER (i) AS n_iframes, count(*) FILTER (NOT i) AS n_pframes, coalesce(sum(dd) FILTER (NOT i), 0) / greatest(coalesce(sum(ww) FILTER (NOT i), 0), 1e-30) AS ratio FROM x)
SELECT n_iframes, n_pframes, round(ratio, 6) AS delta_ratio, round(1 / greatest(ratio, 0.01), 6) AS expected_gain FROM y""")
def q18_delta_statistics(spark, sf_dir):
    rows = grouped_rows(spark, sf_dir)
    return delta.statistics(rows, delta.encode(rows, "arith"))


_SEEK = """
WITH b AS (SELECT (vec_id // 50)::INTEGER AS layer_idx, sum(4 * len(embedding))::BIGINT AS block_len FROM embeddings GROUP BY 1),
s AS (SELECT layer_idx, layer_idx // 8 AS group_id, coalesce(sum(block_len) OVER (ORDER BY layer_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seek_offset, block_len FROM b)"""


def _seek(spark, sf_dir):
    blocks = grouped_rows(spark, sf_dir).groupBy("layer_idx", "group_id").agg(F.sum(4 * F.size("vals")).alias("block_len"))
    return drift.seek_table(blocks)


@query(f"{_SEEK} SELECT group_id, min(layer_idx) AS first_layer, count(*) - 1 AS n_followers, arg_min(seek_offset, layer_idx) AS group_offset, sum(block_len)::BIGINT AS group_bytes FROM s GROUP BY group_id")
def q19_group_index(spark, sf_dir):
    return drift.group_index(_seek(spark, sf_dir))


@query(f"{_SEEK} SELECT layer_idx, seek_offset, (coalesce(lead(seek_offset) OVER (ORDER BY layer_idx), (SELECT max(seek_offset + block_len) FROM s)) - seek_offset)::BIGINT AS block_len FROM s")
def q19b_seek_lengths(spark, sf_dir):
    seek = _seek(spark, sf_dir)
    ends = seek.withColumn("end", F.max(F.col("seek_offset") + F.col("block_len")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return drift.lengths(ends.select("layer_idx", "seek_offset", "end"), F.col("end")).select("layer_idx", "seek_offset", "block_len")


@query("SELECT name, (row_number() OVER (ORDER BY encode(name)) - 1)::BIGINT AS id FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)")
def q20_registry(spark, sf_dir):
    return T.register(load(spark, sf_dir, "part"), "p_name")


_TENSORS = """
WITH t AS (SELECT label AS layer_idx, count(*)::INTEGER AS row_dim, 64 AS col_dim, bool_or(len(list_filter(embedding, lambda x: x <> 0)) > 0) AS nonzero FROM embeddings GROUP BY label)"""


@query(f"""{_TENSORS} SELECT layer_idx, row_dim, col_dim, row_dim >= 4 AND col_dim >= 4 AND row_dim * col_dim >= 1000 AND nonzero AS fit_eligible,
       row_dim >= 4 AND col_dim >= 4 AND row_dim * col_dim >= 1000 AND 50 < row_dim AS encode_eligible FROM t""")
def q21_eligibility(spark, sf_dir):
    t = load(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("layer_idx")).agg(F.count("*").cast("int").alias("row_dim"), F.max(F.size("embedding")).alias("col_dim"), F.max(F.exists("embedding", lambda x: x != 0)).alias("nonzero"))
    shape = F.array("row_dim", "col_dim")
    dtype = F.lit("float32")
    return t.select("layer_idx", "row_dim", "col_dim", T.fit_eligible(dtype, shape, F.col("row_dim"), F.col("col_dim"), F.col("nonzero")).alias("fit_eligible"), T.encode_eligible(dtype, F.col("row_dim"), F.col("col_dim"), F.lit(50)).alias("encode_eligible"))


_ATOMS = """
WITH a AS (SELECT vec_id::INTEGER AS atom_idx, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS d FROM embeddings WHERE vec_id < 8),
w AS (SELECT vec_id, vec_id // 50 AS layer_idx, embedding::DOUBLE[] AS v FROM embeddings)"""


def _atoms(spark, sf_dir):
    """Every vector as a tensor column with the dictionary of its row dimension: eight unit atoms, by equi-join on m."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)) + 1e-8
    first = vectors.where("vec_id < 8").select(F.size("v").alias("m"), F.col("vec_id").cast("int").alias("atom_idx"), F.transform("v", lambda x: x / norm).alias("vec"))
    return vectors.withColumn("m", F.size("v")).join(F.broadcast(factor.packed(first)), "m")  # one record of eight atoms a row dimension


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


@query(f"{_ATOMS} SELECT vec_id, atom_idx, round(list_dot_product(d, v), 4) + 0.0 AS coefficient FROM w, a")
def q22_projection(spark, sf_dir):
    scores = F.transform("atoms", lambda d: F.round(_dot(d, F.col("v")), 4) + F.lit(0.0))  # no negative zero
    return _atoms(spark, sf_dir).select("vec_id", F.posexplode(scores).alias("atom_idx", "coefficient"))


@query(f"{_ATOMS} SELECT vec_id, arg_min(atom_idx, (round(list_distance(d, v) ** 2, 9), atom_idx)) AS atom_idx FROM w, a GROUP BY vec_id")
def q23_nearest_atom(spark, sf_dir):
    far = F.transform("atoms", lambda d: F.aggregate(F.zip_with(d, F.col("v"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    ranked = F.transform(far, lambda d2, i: F.struct(F.round(d2, 9).alias("d2"), i.alias("i")))
    return _atoms(spark, sf_dir).select("vec_id", F.array_min(ranked)["i"].cast("int").alias("atom_idx"))


@query(f"""{_ATOMS},
c AS (SELECT vec_id, layer_idx, any_value(v) AS v, list(list_transform(d, lambda x: x * list_dot_product(d, v)) ORDER BY atom_idx) AS parts FROM w, a GROUP BY vec_id, layer_idx),
r AS (SELECT layer_idx, list_sum(list_transform(range(1, 65), lambda i: (v[i] - list_sum(list_transform(parts, lambda p: p[i]))) ** 2)) AS e FROM c)
SELECT layer_idx, round(sum(e), 4) AS residual_energy FROM r GROUP BY layer_idx""")
def q24_residual_energy(spark, sf_dir):
    scores = _atoms(spark, sf_dir).withColumn("c", F.transform("atoms", lambda d: _dot(d, F.col("v"))))
    zero = F.transform("v", lambda x: F.lit(0.0))
    product = F.aggregate(F.zip_with("atoms", "c", lambda d, c: F.transform(d, lambda x: x * c)), zero, lambda acc, p: F.zip_with(acc, p, lambda x, y: x + y))
    rest = scores.withColumn("r", F.zip_with("v", product, lambda x, y: x - y))
    energy = rest.select(F.expr("vec_id div 50").alias("layer_idx"), F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x * x).alias("e"))
    return energy.groupBy("layer_idx").agg(F.round(F.sum("e"), 4).alias("residual_energy"))


@query("""WITH h AS (SELECT page_id, sha256(html) AS digest FROM pages),
x AS (SELECT page_id, digest, ('0x' || digest[15:16] || digest[13:14] || digest[11:12] || digest[9:10] || digest[7:8] || digest[5:6] || digest[3:4] || digest[1:2])::UBIGINT::HUGEINT AS u FROM h)
SELECT page_id, digest, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS checksum FROM x""")
def q25_checksum(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    little = F.concat(*[F.substring("digest", 2 * k + 1, 2) for k in reversed(range(8))])
    return pages.select("page_id", "digest", F.conv(little, 16, -10).cast("long").alias("checksum"))


_COSTED = """
h AS (SELECT layer_idx, mode, sym, count(*) AS cnt FROM x GROUP BY ALL),
f0 AS (SELECT *, greatest((cnt * 32768) // (sum(cnt) OVER (PARTITION BY layer_idx, mode))::BIGINT, 1) AS base FROM h),
f1 AS (SELECT *, 32768 - (sum(base) OVER (PARTITION BY layer_idx, mode))::BIGINT AS gap, row_number() OVER (PARTITION BY layer_idx, mode ORDER BY cnt DESC, sym) AS place,
              row_number() OVER (PARTITION BY layer_idx, mode ORDER BY base DESC, sym) AS high FROM f0),
s0 AS (SELECT layer_idx, mode, sym, high, gap, unnest(range(1, least(base - 1, -gap) + 1)) AS round FROM f1 WHERE gap < 0 AND base > 1),
s1 AS (SELECT *, row_number() OVER (PARTITION BY layer_idx, mode ORDER BY round, high) AS o FROM s0),
s2 AS (SELECT layer_idx, mode, sym, count(*) AS taken FROM s1 WHERE o <= -gap GROUP BY ALL),
f AS (SELECT f1.layer_idx, f1.mode, f1.sym, cnt, base + CASE WHEN place <= gap THEN 1 ELSE 0 END - coalesce(taken, 0) AS freq FROM f1 LEFT JOIN s2 ON f1.layer_idx = s2.layer_idx AND f1.mode = s2.mode AND f1.sym = s2.sym),
costs AS (SELECT layer_idx, mode, sum(cnt)::BIGINT AS raw_bytes, round(sum(cnt * (15 - log2(freq))) / 8, 3) AS cost FROM f GROUP BY layer_idx, mode)"""


@query(f"""WITH x AS (SELECT layer_idx, 'exp' AS mode, (u >> 23) & 255 AS sym FROM ({_CELL})), {_COSTED}
SELECT layer_idx::INTEGER AS layer_idx, raw_bytes * 4 AS original_bytes, cost AS exp_bytes, round((raw_bytes * 4) / greatest(cost + raw_bytes * 25 / 8, 1), 4) AS ratio,
       printf('%.2f', round((raw_bytes * 4) / greatest(cost + raw_bytes * 25 / 8, 1), 4)) || '×' AS shown FROM costs""")
def q26_ratio_report(spark, sf_dir):
    cost = entropy.model_cost(entropy.frequency_table(_exponents(spark, sf_dir), "layer_idx"), "layer_idx")
    # A sign takes 1 bit and a mantissa 24 in whole byte planes: neither is worth coding.
    size = F.col("raw_bytes") * 4
    value = F.round(choose.ratio(size, F.col("cost_bytes") + F.col("raw_bytes") * 25 / 8), 4)
    return cost.select("layer_idx", size.alias("original_bytes"), F.col("cost_bytes").alias("exp_bytes"), value.alias("ratio"), choose.formatted(value).alias("shown"))


@query(f"""{_MATCHED}, x AS (SELECT layer_idx, 'full' AS mode, (u >> 23) & 255 AS sym FROM d UNION ALL SELECT layer_idx, 'delta', (CASE WHEN i THEN u ELSE xor(u, pu) END >> 23) & 255 FROM d), {_COSTED}
SELECT layer_idx::INTEGER AS layer_idx, arg_min(mode, (cost, CASE WHEN mode = 'full' THEN 0 ELSE 1 END)) AS mode, min(cost) AS cost FROM costs GROUP BY layer_idx""")
def q27_adaptive_choice(spark, sf_dir):
    rows = grouped_rows(spark, sf_dir)
    full = T.cells(rows, "layer_idx").withColumn("mode", F.lit("full"))
    frames = delta.encode(rows, "bits").select("layer_idx", F.explode("data").alias("raw")).withColumn("mode", F.lit("delta"))
    symbols = full.select("layer_idx", "mode", "raw").unionByName(frames.select("layer_idx", "mode", "raw")).withColumn("sym", bits.fields(F.col("raw"))[1])
    cost = entropy.model_cost(entropy.frequency_table(entropy.histogram(symbols, "layer_idx", "mode"), "layer_idx", "mode"), "layer_idx", "mode")
    candidates = cost.select("layer_idx", "mode", F.when(F.col("mode") == "full", 0).otherwise(1).alias("rank"), F.col("cost_bytes").alias("cost"))
    return choose.cheapest(candidates, "layer_idx")


@query(f"{_TEXT} SELECT lang, sym, cnt, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS rank FROM t) WHERE rank <= 10")
def q28_top_symbols(spark, sf_dir):
    return entropy.top_symbols(_text_counts(spark, sf_dir), 10, "lang")


def _state(spark, sf_dir):
    """The embedding layers as named tensors."""
    rows = layer_rows(spark, sf_dir)
    sizes = rows.groupBy("layer_idx").agg(F.count("*").cast("int").alias("row_dim"), F.max(F.size("vals")).alias("col_dim"))
    return sizes.select(F.format_string("layer%06d", "layer_idx").alias("tensor_name"), "layer_idx", F.lit("float32").alias("dtype"), F.array("row_dim", "col_dim").alias("shape"), "row_dim", "col_dim", (F.col("row_dim").cast("long") * F.col("col_dim")).alias("n_elem")), rows


_LAYERS = "SELECT layer_idx, count(*) AS n_rows, count(*) * 64 AS n FROM (SELECT vec_id // 50 AS layer_idx FROM embeddings) GROUP BY layer_idx"


@query(f"""WITH l AS ({_LAYERS}), s(stream) AS (VALUES ('sign'), ('exp'), ('mant')), c(codec) AS (VALUES ('huffman'), ('lzma'), ('lzma_fast'), ('rans'), ('zlib'))
SELECT layer_idx::INTEGER AS layer_idx, stream, codec, (CASE stream WHEN 'sign' THEN 4 + (n + 7) // 8 WHEN 'exp' THEN n ELSE 4 * n END)::INTEGER AS raw_len, true AS exact FROM l, s, c""")
def q29_codecs(spark, sf_dir):
    """Whether each codec gives each stream back; the coded sizes have no SQL form."""
    tensors, rows = _state(spark, sf_dir)
    encoded = codec.encode(tensors, rows, codec.Options(dictionary=False, backend="none"))
    raw = encoded.blocks.where("part = 'R'").select("layer_idx", "stream", codecs.decompress_by("blob", "codec").alias("raw"))
    names = F.array(*[F.lit(n) for n in ("huffman", "lzma", "lzma_fast", "rans", "zlib")])
    coded = raw.withColumn("codec", F.explode(names)).withColumn("coded", codecs.compress_by("raw", "codec"))
    back = coded.withColumn("back", codecs.decompress_by("coded", "codec"))
    return back.select("layer_idx", "stream", "codec", F.length("raw").alias("raw_len"), (F.col("raw") == F.col("back")).alias("exact"))


@query(f"SELECT layer_idx::INTEGER AS layer_idx, n_rows, true AS close FROM ({_LAYERS})")
def q30_factorisation(spark, sf_dir):
    """Encode with dictionaries, decode, and the largest error of each layer."""
    tensors, rows = _state(spark, sf_dir)
    encoded = codec.encode(tensors, rows, codec.Options(num_atoms=16, atom_rank=16))
    back = codec.decode(encoded).select("layer_idx", "row_idx", F.col("vals").alias("back"))
    off = F.array_max(F.zip_with("vals", "back", lambda a, b: F.abs(a - b)))
    return rows.join(back, ["layer_idx", "row_idx"]).groupBy("layer_idx").agg(F.count("*").alias("n_rows"), (F.max(off) <= 1e-5).alias("close"))


@query(f"""WITH l AS ({_LAYERS}), t AS (SELECT layer_idx, sum(floor(v::DOUBLE * 1048576)::BIGINT)::BIGINT AS total FROM ({_CELL}) GROUP BY layer_idx)
SELECT (row_number() OVER (ORDER BY l.layer_idx) - 1)::INTEGER AS layer_idx, printf('layer%06d', l.layer_idx) AS tensor_name, [n_rows::INTEGER, 64] AS shape, n::INTEGER AS n, total, true AS exact FROM l JOIN t ON l.layer_idx = t.layer_idx""")
def q31_container(spark, sf_dir):
    """Write the layers to a container, read all of it back and compare each layer with its source."""
    container.register(spark)
    tensors, rows = _state(spark, sf_dir)
    whole = rows.groupBy("layer_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "vals"))), lambda r: r["vals"])).alias("vals"))
    path = shared_folder(spark)
    tensors.join(whole, "layer_idx").select("tensor_name", "shape", "vals").write.format("tensor_container").mode("append").save(path)
    read = spark.read.format("tensor_container").option("verify", "true").load(path)
    back = read.select("layer_idx", "tensor_name", "shape", F.col("vals").alias("back"))
    source = tensors.join(whole, "layer_idx").select("tensor_name", F.col("shape").alias("want"), "vals")
    total = F.aggregate("back", F.lit(0).cast("long"), lambda acc, x: acc + F.floor(x.cast("double") * 1048576))
    # A layer missing on either side stays, as one that is not exact.
    exact = F.coalesce((F.col("shape") == F.col("want")) & (F.col("back") == F.col("vals")), F.lit(False))
    return back.join(source, "tensor_name", "full").select("layer_idx", "tensor_name", "shape", F.size("back").alias("n"), total.alias("total"), exact.alias("exact"))


@query("""WITH c AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT event_id AS layer_idx, (user_id * 16777216 + n // 8)::BIGINT AS group_id, cents FROM c""")
def q32_streaming(spark, sf_dir):
    """Cents of each user as integer frames, eight events a group, decoded by the stateful stream."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    placed = cents.withColumn("n", F.row_number().over(order) - 1)
    # A user's events are far below 2^27, so no two groups share a number.
    group = F.col("user_id") * 2**24 + F.expr("n div 8")
    frames = streaming.frames_of(placed.select(F.col("event_id").alias("layer_idx"), F.array("cents").alias("data"), F.col("user_id"), F.col("n"), group.alias("g")), "data", F.col("g"), 8)
    base = shared_folder(spark)
    frames.write.parquet(f"{base}/frames")
    streaming.run_available(spark, f"{base}/frames", f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("layer_idx", "group_id", F.col("data")[0].alias("cents"))


def _half_state(spark, sf_dir):
    """The embedding layers rounded to half."""
    tensors, rows = _state(spark, sf_dir)
    return tensors.withColumn("dtype", F.lit("float16")), rows.withColumn("vals", bits.from_half_codes(bits.half_codes("vals")))


@query(f"""WITH l AS ({_LAYERS})
SELECT layer_idx::INTEGER AS layer_idx, n_rows, 'fp16' AS layout, (4 + (n + 7) // 8 + 3 * n)::BIGINT AS raw_bytes, true AS exact FROM l""")
def q33_half_storage(spark, sf_dir):
    """Half tensors are coded as halves, two bytes a value, and come back bit for bit."""
    tensors, rows = _half_state(spark, sf_dir)
    encoded = codec.encode(tensors, rows, codec.Options(dictionary=False))
    held = encoded.blocks.where("part = 'R'").groupBy("layer_idx").agg(F.min("layout").alias("layout"), F.sum("raw_len").alias("raw_bytes"))
    back = codec.decode(encoded).select("layer_idx", "row_idx", F.col("vals").alias("back"))
    same = rows.join(back, ["layer_idx", "row_idx"]).groupBy("layer_idx").agg(F.count("*").alias("n_rows"), F.bool_and(bits.codes("vals") == bits.codes("back")).alias("exact"))
    return same.join(held, "layer_idx").select("layer_idx", "n_rows", "layout", "raw_bytes", "exact")


@query(f"""WITH l AS ({_LAYERS}), a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n FROM l), g AS (SELECT *, (k + 7) // 8 - CASE WHEN k > 8 AND k % 8 = 1 THEN 1 ELSE 0 END AS i FROM a)
SELECT k AS n_layers, 2 * n AS original_bytes, 2 * n + 2 * k AS coefficient_residual_bytes, 0::BIGINT AS dictionary_bytes, 0::BIGINT AS n_eligible, 0::BIGINT AS dictionary_used,
       i::BIGINT AS n_iframes, (k - i)::BIGINT AS n_pframes, 0.0::DOUBLE AS delta_ratio, 100.0::DOUBLE AS expected_gain FROM g""")
def q34_statistics(spark, sf_dir):
    """The statistics of an encode of half tensors: whole groups of eight, coefficients of zero."""
    tensors, rows = _half_state(spark, sf_dir)
    found = codec.statistics(codec.encode(tensors, rows, codec.Options(dictionary=False)))
    names = ["n_layers", "original_bytes", "coefficient_residual_bytes", "dictionary_bytes", "n_eligible", "dictionary_used", "n_iframes", "n_pframes", "delta_ratio", "expected_gain"]
    return found.select(*names)
