"""Queries of the general problems: hot keys (4) and differing copies (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions.clean import tidy_key
from netspark.operators.diff import diff_tables
from netspark.operators.standing import standing_rows
from netspark.operators.tree_agg import heavy_keys, partner_stats
from netspark.sources.tables import table
from netspark.workspace import Workspace

BFS_SOURCES = (0, 3, 8)


def p4_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = partner_stats(table(spark, sf_dir, "edge_list"))
    return s.select("src", "n_partners", F.round("sum_weight", 3).alias("sum_weight"), "min_weight", "max_weight")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Workspace(spark, "p4").save(partner_stats(table(spark, sf_dir, "edge_list")), "stats")
    return heavy_keys(stats)


def _scores(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return standing_rows(table(spark, sf_dir, name), tidy_key("gene_id"), ["pagerank"], name="gene_id")


def _bfs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing distances per (gene, source), one column a source, in a single aggregate."""
    row = F.struct("computed_at", "loaded_at", "bfs_distance")
    b = table(spark, sf_dir, "bfs_distances").select(tidy_key("gene_id").alias("gene_id"), "source_idx", row.alias("row")).where("gene_id is not null")
    agg = b.groupBy("gene_id").agg(*[F.max(F.when(F.col("source_idx") == s, F.col("row"))).alias(f"r{s}") for s in BFS_SOURCES])
    return agg.select("gene_id", *[F.col(f"r{s}.bfs_distance").alias(f"dist_from_{s}") for s in BFS_SOURCES])


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both comparisons with the two values of every differing field."""
    dist = [f"dist_from_{s}" for s in BFS_SOURCES]
    par = standing_rows(table(spark, sf_dir, "par_bfs_distances"), tidy_key("gene_id"), dist, name="gene_id")
    size = lambda *names: sum(table(spark, sf_dir, n).count() for n in names)  # noqa: E731  from the footers
    bfs = diff_tables(_bfs_wide(spark, sf_dir), par, "gene_id", dict.fromkeys(dist), rows=size("bfs_distances", "par_bfs_distances"))
    rank = diff_tables(_scores(spark, sf_dir, "pagerank_scores"), _scores(spark, sf_dir, "gpu_pagerank_scores"), "gene_id", {"pagerank": 1e-6}, rows=size("pagerank_scores", "gpu_pagerank_scores"))
    return bfs.select(F.lit("bfs").alias("comparison"), "*").unionAll(rank.select(F.lit("pagerank").alias("comparison"), "*"))


def p5_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All differences with both values as numbers."""
    return _differences(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 12) for c in ("left_value", "right_value")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir).select("comparison", "gene_id", "field", "issue")


QUERIES = {"p4_found": p4_found, "p4_key_stats": p4_key_stats, "p5_found": p5_found, "p5_diff": p5_diff}

_STAND = """
 SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY gene {by} ORDER BY computed_at DESC, loaded_at DESC) AS rn
  FROM (SELECT upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) AS gene, * FROM {t} WHERE gene_id IS NOT NULL)
 ) WHERE rn = 1"""

_P4 = """WITH e AS (SELECT DISTINCT * FROM edge_list),
 pairs AS (SELECT src, dst, weight FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
 u AS (SELECT src, dst, CASE WHEN isnan(weight) THEN NULL ELSE weight::DOUBLE END AS w FROM pairs),
 s AS (SELECT src, count(DISTINCT CASE WHEN w IS NOT NULL THEN dst END) AS n_partners, round(sum(w), 3) AS sum_weight, min(w) AS min_weight, max(w) AS max_weight FROM u GROUP BY src)
"""

_P5 = f"""WITH b AS ({_STAND.format(t="bfs_distances", by=", source_idx")}),
 lb AS (SELECT gene, max(CASE WHEN source_idx = 0 THEN bfs_distance END) AS d0, max(CASE WHEN source_idx = 3 THEN bfs_distance END) AS d3, max(CASE WHEN source_idx = 8 THEN bfs_distance END) AS d8 FROM b GROUP BY gene),
 rb AS ({_STAND.format(t="par_bfs_distances", by="")}),
 lp AS ({_STAND.format(t="pagerank_scores", by="")}),
 rp AS ({_STAND.format(t="gpu_pagerank_scores", by="")}),
 jb AS (SELECT coalesce(l.gene, r.gene) AS gene, l.gene AS lg, r.gene AS rg, l.d0, l.d3, l.d8, r.dist_from_0, r.dist_from_3, r.dist_from_8 FROM lb l FULL JOIN rb r ON l.gene = r.gene),
 jp AS (SELECT coalesce(l.gene, r.gene) AS gene, l.gene AS lg, r.gene AS rg, CASE WHEN isnan(l.pagerank) THEN NULL ELSE l.pagerank END AS a, CASE WHEN isnan(r.pagerank) THEN NULL ELSE r.pagerank END AS b FROM lp l FULL JOIN rp r ON l.gene = r.gene),
 found AS (
 SELECT 'bfs' AS comparison, gene AS gene_id, '*' AS field, CASE WHEN rg IS NULL THEN 'only_left' ELSE 'only_right' END AS issue, NULL::DOUBLE AS left_value, NULL::DOUBLE AS right_value FROM jb WHERE lg IS NULL OR rg IS NULL
 UNION ALL SELECT 'pagerank', gene, '*', CASE WHEN rg IS NULL THEN 'only_left' ELSE 'only_right' END, NULL, NULL FROM jp WHERE lg IS NULL OR rg IS NULL
 UNION ALL SELECT 'bfs', gene, 'dist_from_0', 'differs', d0, dist_from_0 FROM jb WHERE lg = rg AND d0 IS DISTINCT FROM dist_from_0
 UNION ALL SELECT 'bfs', gene, 'dist_from_3', 'differs', d3, dist_from_3 FROM jb WHERE lg = rg AND d3 IS DISTINCT FROM dist_from_3
 UNION ALL SELECT 'bfs', gene, 'dist_from_8', 'differs', d8, dist_from_8 FROM jb WHERE lg = rg AND d8 IS DISTINCT FROM dist_from_8
 UNION ALL SELECT 'pagerank', gene, 'pagerank', 'differs', a, b FROM jp WHERE lg = rg AND ((a IS NULL) <> (b IS NULL) OR abs(a - b) > 1e-6 * greatest(abs(a), abs(b))))
"""

SQL = {
    "p4_found": _P4 + "SELECT src FROM s WHERE n_partners > 0 AND n_partners >= 0.005 * (SELECT sum(n_partners) FROM s)",
    "p4_key_stats": _P4 + "SELECT src, n_partners, sum_weight, min_weight, max_weight FROM s",
    "p5_found": _P5 + "SELECT comparison, gene_id, field, issue FROM found",
    "p5_diff": _P5 + "SELECT comparison, gene_id, field, issue, round(left_value, 12) AS left_value, round(right_value, 12) AS right_value FROM found",
}
