"""Wide count tables: inspection, id detection, bounded prefixes, long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: parts of a column name that mark an identifier (fixed values)
ID_HINTS = ("gene", "id", "name", "feature", "transcript", "exon", "symbol")


def inspect_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, columns, files, bytes, row groups and bytes before compression.

    From the file listing and the footers only; the footers are read in tasks.
    """

    def footers(batches):
        import pandas as pd
        import pyarrow.fs
        import pyarrow.parquet

        for b in batches:
            for f in b["f"]:
                fs, at = pyarrow.fs.FileSystem.from_uri(f)
                meta = pyarrow.parquet.read_metadata(at, filesystem=fs)
                groups = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
                yield pd.DataFrame({"n": [meta.num_rows], "g": [len(groups)], "u": [sum(groups)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("f"), "length")
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    every = files.select("f").repartition(max(1, min(size.files, spark.sparkContext.defaultParallelism))).mapInPandas(footers, "n long, g long, u long")
    columns = len(spark.read.parquet(path).columns)
    return every.agg(F.sum("n").alias("rows"), F.lit(columns).alias("columns"), F.lit(size.files).alias("files"), F.lit(size.bytes).alias("bytes"), F.sum("g").alias("row_groups"), F.sum("u").alias("uncompressed_bytes"))


def detect_id_column(schema: T.StructType) -> str | None:
    """The first column that is a string or whose name contains an identifier hint."""
    for f in schema:
        if isinstance(f.dataType, T.StringType) or any(h in f.name.lower() for h in ID_HINTS):
            return f.name
    return None


def sample_columns(df: DataFrame, ident: str | None) -> list[str]:
    """All numeric columns besides the id; further text columns are no samples."""
    return [f.name for f in df.schema if f.name != ident and isinstance(f.dataType, T.NumericType)]


def row_prefix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows in file order with their ``row_idx``, by the Parquet row index.

    Of several files the order is that of their names. Files are counted in that
    order, twice as many at a time, until there are ``n`` rows; later files are
    neither counted nor read.
    """
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    read = lambda fs: spark.read.schema(whole.schema).parquet(*fs)
    chosen, start, at, k = [], 0, F.lit(None).cast("long"), 1
    while start < n and len(chosen) < len(files):
        some = files[len(chosen) : len(chosen) + k]
        sizes = read(some).groupBy(F.col("_metadata.file_path").alias("f")).agg((F.max("_metadata.row_index") + 1).alias("n"))
        for f, rows in sorted((r.f, r.n) for r in sizes.collect()):
            at = F.when(F.col("_metadata.file_path") == f, F.lit(start) + F.col("_metadata.row_index")).otherwise(at)
            start += rows
        chosen += some
        k *= 2
    if not chosen:
        return whole.withColumn("row_idx", at).where("false")
    return read(chosen).withColumn("row_idx", at).where(F.col("row_idx") < n)


def nth_smallest(df: DataFrame, col: str, n: int) -> int:
    """The ``n``-th smallest (from 0) of an integer column without NULLs; there must be more than ``n``.

    Narrows the range by counts of at most 4,097 parts of it, so nothing is sorted or gathered.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while lo < hi:
        step = (hi - lo) // 4096 + 1
        part = F.expr(f"(cast(`{col}` as bigint) - {lo}) div {step}")
        for k, c in sorted((r.k, r["count"]) for r in df.where(F.col(col).between(lo, hi)).groupBy(part.alias("k")).count().collect()):
            if n < c:
                break
            n -= c
        lo, hi = lo + k * step, min(hi, lo + (k + 1) * step - 1)
    return lo


def synthetic_ids(index: Column) -> Column:
    """``gene_<index>`` where a table has no identifier."""
    return F.concat(F.lit("gene_"), index.cast("string"))


def to_long(df: DataFrame, ident: str | None = None, index: str | None = None) -> DataFrame:
    """A wide table as (gene, sample, value): one narrow stage, no shuffle.

    ``index`` is a column of row numbers: then these stand for the genes, as names
    may be missing or repeated (``gene_names``).
    """
    ident = ident or detect_id_column(df.drop(index).schema if index else df.schema)
    if not ident and not index:
        raise ValueError("no identifier among the columns: pass the index of the rows")
    cols = [c for c in sample_columns(df, ident) if c != index]
    gene = F.col(index) if index else F.col(ident).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(c).cast("double").alias("value")) for c in cols]))
    return df.select(gene.alias("gene"), pairs.alias("p")).select("gene", "p.sample", "p.value")


def gene_names(df: DataFrame, index: str, ident: str | None = None) -> DataFrame:
    """(gene, gene_id) by row number; where there is no identifier, ``gene_<index>``."""
    ident = ident or detect_id_column(df.drop(index).schema)
    name = synthetic_ids(F.col(index))
    return df.select(F.col(index).alias("gene"), (F.coalesce(F.col(ident).cast("string"), name) if ident else name).alias("gene_id"))


def from_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, value) of the arrays in .npy files; .npz files of CSR graphs as (file, i, j, value) too.

    A file is read by one task, as these formats have no blocks.
    """

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                x = np.load(io.BytesIO(raw), allow_pickle=False)
                if isinstance(x, np.lib.npyio.NpzFile):
                    i = np.repeat(np.arange(len(x["indptr"]) - 1), np.diff(x["indptr"]))
                    j, v = x["indices"], x["data"]
                else:
                    x = np.atleast_2d(x)
                    i, j = (a.ravel() for a in np.indices(x.shape))
                    v = x.ravel()
                for k in range(0, len(v), 100_000):
                    s = slice(k, k + 100_000)
                    yield pd.DataFrame({"file": name, "i": i[s].astype("i8"), "j": j[s].astype("i8"), "value": v[s].astype("f8")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, i long, j long, value double")
