"""Result sinks: sorted CSV reports, Parquet graphs, and stages that resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.operators.graph import symmetrise


def save_scores(scores: DataFrame, genes: DataFrame, path: str, score: str, ascending: bool = False) -> DataFrame:
    """(gene_id, score) sorted by score, ties by index; ids fall back to the index."""
    out = with_gene_ids(scores, genes).orderBy(F.col(score).asc() if ascending else F.col(score).desc(), "idx").select("gene_id", score)
    out.write.mode("overwrite").csv(path, header=True)
    return out


def save_partition(parts: DataFrame, genes: DataFrame, path: str) -> DataFrame:
    """(gene_id, community) sorted by community."""
    out = with_gene_ids(parts, genes).orderBy("community", "gene_id").select("gene_id", "community")
    out.write.mode("overwrite").csv(path, header=True)
    return out


def save_edges(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An edge list as Parquet, range-partitioned by source, or as CSV."""
    w = edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.csv(path, header=True)


def save_sorted(rows: DataFrame, genes: DataFrame, path: str, *order: Column | str) -> DataFrame:
    """``gene_id`` and the columns of ``rows`` besides ``idx`` as CSV in the given order."""
    out = with_gene_ids(rows, genes).orderBy(*order).select("gene_id", *[c for c in rows.columns if c != "idx"])
    out.write.mode("overwrite").csv(path, header=True)
    return out


def save_graph(edges: DataFrame, path: str, table: str | None = None, buckets: int = 64) -> None:
    """Both directions of every edge, zeros left out, sorted by source: range-partitioned
    files, or with ``table`` a table of that name in hash buckets of the source."""
    both = symmetrise(edges)
    if table:
        both.repartition(buckets, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").bucketBy(buckets, "src").sortBy("src", "dst").option("path", path).saveAsTable(table)
    else:
        save_edges(both, path)


def with_gene_ids(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """``idx`` joined with (idx, gene_id); an index without a name is its own id."""
    return rows.join(genes.select("idx", "gene_id"), "idx", "left").withColumn("gene_id", F.coalesce("gene_id", F.col("idx").cast("string")))


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], resume: bool = True, made_with: str = "") -> DataFrame:
    """The table at ``path`` if it is complete and was ``made_with`` the same parameters, else what ``make`` gives, written there."""
    done, note = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in ("_SUCCESS", "_made_with"))
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())

    def same() -> bool:
        if not (fs.exists(done) and fs.exists(note)):
            return False
        f = fs.open(note)
        try:
            return f.readUTF() == made_with
        finally:
            f.close()

    if not (resume and same()):
        make().write.mode("overwrite").parquet(path)
        f = fs.create(note, True)
        f.writeUTF(made_with)
        f.close()
    return spark.read.parquet(path)
