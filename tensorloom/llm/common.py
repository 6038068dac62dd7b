"""Helpers that several training-data operators share.

Nothing here gathers rows on the driver. Lineage is cut with a reliable
``checkpoint()``, so a lost executor never loses the only copy of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.plans.lineage import checkpointed

__all__ = ["WORD_PATTERN", "batches", "chance_bits", "checkpointed", "fresh", "pick", "small", "table", "whole_texts", "word_count"]

#: White space of the text contracts: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, pruned to the columns that the caller needs."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of a batch that carries whole texts to Python, at most.
TEXT_ROWS = 512


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, once the session's Arrow batches are small enough for rows of any length.

    Lowers the session's row limit of a batch; a lower limit is left as it is. Spark
    also ends a batch by bytes, but only once it has passed that limit.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, TEXT_ROWS)
    return df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` columns by exact name, whatever else the table holds.

    Extra columns, even ones whose names clash with an operator's own, are left
    out at the door. Operators whose result carries them back say so.
    """
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not hold, in any case of letters: the given ones with underscores before them as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096, cell_bytes: int = 16 << 20, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, cut early when ``text`` cells grow large."""
    held: dict[str, list] = {name: [] for name in schema.names}
    n = volume = 0
    for row in rows:
        for name in schema.names:
            held[name].append(row[name])
        n += 1
        if text is not None:
            volume += len(row[text] or "")
        if n >= size or volume >= cell_bytes:
            yield pa.RecordBatch.from_pydict(held, schema=schema)
            held, n, volume = {name: [] for name in schema.names}, 0, 0
    if n:
        yield pa.RecordBatch.from_pydict(held, schema=schema)


def word_count(text) -> F.Column:
    """Words of a text column by :data:`WORD_PATTERN`; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def chance_bits(k: F.Column, n: F.Column, p: F.Column) -> F.Column:
    """Bits against chance for k or more of n cases to be hits at a base rate p: n times the divergence of k / n from p (Chernoff)."""
    met = k * F.log2(k / (n * p))
    missed = F.when(k < n, (n - k) * F.log2((1 - k / n) / (1 - p))).otherwise(0.0)
    return F.when(k > n * p, met + missed).otherwise(0.0)


#: Rows of a side that is broadcast take so many bytes at most.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: F.Column) -> DataFrame:
    """``df`` marked for broadcast if its bytes, measured by ``size`` a row, stay within :data:`BROADCAST_BYTES`; else as it is."""
    held = df.agg(F.coalesce(F.sum(size + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df
