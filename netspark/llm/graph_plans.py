"""Queries of problems 1 to 3: groups of matches, top N, most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions.clean import tidy_key, usable
from netspark.llm.components import connected_groups
from netspark.llm.knn import nearest_vectors
from netspark.llm.topn import top_n_per_group
from netspark.operators.standing import standing_rows
from netspark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = connected_groups(table(spark, sf_dir, "edge_list"))
    return g.select(F.col("vertex").alias("gene_idx"), F.col("group").alias("group_idx"))


def p2_top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five genes of every community with their scores and ranks."""
    key = tidy_key("gene_id")
    home = standing_rows(table(spark, sf_dir, "louvain_communities"), key, ["community"], name="gene_id")
    score = standing_rows(table(spark, sf_dir, "pagerank_scores"), key, ["pagerank"], name="gene_id")
    both = home.where("community is not null").join(score.where(usable("pagerank")), "gene_id")
    return top_n_per_group(both, "community", "gene_id", "pagerank", 5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_top_genes(spark, sf_dir).select("community", "gene_id")


DIMS = [f"dim_{i}" for i in range(32)]


def p3_nearest(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """The five most similar genes of every gene with a usable vector, or those of them with a cosine of ``least``."""
    v = standing_rows(table(spark, sf_dir, "gpu_gnn_embeddings"), tidy_key("gene_id"), DIMS, name="gene_id")
    return nearest_vectors(v.select("gene_id", F.array(*DIMS).alias("v")), "gene_id", "v", 5, least=least)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p3_nearest(spark, sf_dir, least=0.95).where("cosine >= 0.95")
    return near.select(F.least("gene_id", "neighbour").alias("gene_a"), F.greatest("gene_id", "neighbour").alias("gene_b")).distinct()


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_nearest": p3_nearest, "p2_found": p2_found, "p2_top_genes": p2_top_genes}

_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY computed_at DESC, loaded_at DESC) AS rn FROM (SELECT upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) AS gene, * FROM {t} WHERE gene_id IS NOT NULL)) WHERE rn = 1)"
_P2 = f"""WITH l AS {_LAST.format(t="louvain_communities")}, s AS {_LAST.format(t="pagerank_scores")},
 r AS (SELECT community, l.gene AS gene_id, pagerank, row_number() OVER (PARTITION BY community ORDER BY pagerank DESC, l.gene) AS rank FROM l JOIN s ON l.gene = s.gene WHERE community IS NOT NULL AND pagerank IS NOT NULL AND NOT isnan(pagerank))
"""
_LIST = "[" + ", ".join(f"{d}::DOUBLE" for d in DIMS) + "]"
_FULL = " AND ".join(f"{d} IS NOT NULL AND NOT isnan({d})" for d in DIMS)
_P3 = f"""WITH s AS {_LAST.format(t="gpu_gnn_embeddings")}, v AS MATERIALIZED (SELECT gene, {_LIST} AS v FROM s WHERE {_FULL}),
 u AS MATERIALIZED (SELECT gene, v, sqrt(list_dot_product(v, v)) AS len FROM v WHERE list_dot_product(v, v) > 0 AND NOT isnan(list_dot_product(v, v))),
 p AS (SELECT a.gene AS gene_id, b.gene AS neighbour, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) AS cosine FROM u a JOIN u b ON a.gene <> b.gene),
 r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY cosine DESC, neighbour) AS rank FROM p)
"""

SQL = {
    "p3_found": _P3 + "SELECT DISTINCT least(gene_id, neighbour) AS gene_a, greatest(gene_id, neighbour) AS gene_b FROM r WHERE rank <= 5 AND cosine >= 0.95",
    "p1_found": """WITH RECURSIVE e AS (SELECT DISTINCT src AS a, dst AS b FROM edge_list WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT DISTINCT dst, src FROM edge_list WHERE src IS NOT NULL AND dst IS NOT NULL),
 cc(gene_idx, group_idx) USING KEY (gene_idx) AS (
  SELECT a, a FROM e GROUP BY a
  UNION
  SELECT e.b, min(c.group_idx) FROM cc c JOIN e ON e.a = c.gene_idx JOIN recurring.cc o ON o.gene_idx = e.b WHERE c.group_idx < o.group_idx GROUP BY e.b)
 SELECT gene_idx::INTEGER AS gene_idx, group_idx::INTEGER AS group_idx FROM cc""",
    "p2_found": _P2 + "SELECT community, gene_id FROM r WHERE rank <= 5",
    "p2_top_genes": _P2 + "SELECT community, gene_id, pagerank, rank::INTEGER AS rank FROM r WHERE rank <= 5",
}
