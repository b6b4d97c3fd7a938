"""Queries of problems 6 to 8: packing, mixing, subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm.mixing import mix_sources
from netspark.llm.packing import fill_report, pack
from netspark.llm.subjects import subject_areas
from netspark.llm.tokens import token_counts
from netspark.sources.tables import table
from netspark.workspace import Workspace


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, position and token range of every text or piece, for every capacity."""
    sizes = Workspace(spark, "sizes").save(token_counts(table(spark, sf_dir, "documents"), ["doc_id"]), "n")
    return pack(sizes, table(spark, sf_dir, "pack_profiles"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_pack(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = Workspace(spark, "sizes").save(token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "n")
    return mix_sources(sizes, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their copies, and the share their source really has."""
    mix, report = _mix(spark, sf_dir)
    return mix.join(F.broadcast(report.select("source", "target_share", "real_share")), "source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject; those without one are in the row of NULL."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(p8_found(spark, sf_dir), "doc_id", "left").groupBy("subject").agg(F.count_distinct("doc_id").alias("docs"))


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {}
