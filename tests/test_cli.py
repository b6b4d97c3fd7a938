import csv
import glob

import numpy as np
import pytest

from netspark import cli
from netspark.sources import counts


def table(path):
    rows = [r for f in sorted(glob.glob(f"{path}/*.csv")) for r in csv.DictReader(open(f))]
    assert rows
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(0)
    base = rng.integers(1, 100, (3, 12))
    rows = [(f"G{i}", *[0 if i == 2 else int(v) for v in base[i % 3] + rng.integers(0, 5, 12)]) for i in range(10)]
    spark.createDataFrame(rows, "gene_id string, " + ", ".join(f"s{j} int" for j in range(12))).coalesce(1).write.parquet(f"{tmp}/counts")
    cli.main(["graph", "--input", f"{tmp}/counts", "--outdir", f"{tmp}/g", "--max-genes", "9", "--corr-threshold", "0.5"])
    return tmp


def test_counts_to_graph(spark, built):
    genes = {r.gene_idx: r.gene_id for r in spark.read.parquet(f"{built}/g/genes_filtered").collect()}
    assert genes == dict(enumerate([f"G{i}" for i in range(9) if i != 2]))  # dense, in file order, without the silent one
    edges = spark.read.parquet(f"{built}/g/edges")
    assert edges.count() > 0 and edges.where("src >= dst").count() == 0
    assert spark.read.parquet(f"{built}/g/adjacency").count() == 2 * edges.count()
    assert table(f"{built}/g/graph_stats")[0]["nodes"] == "8"
    cli.main(["graph", "--input", f"{built}/counts", "--outdir", f"{built}/g", "--max-genes", "9", "--corr-threshold", "0.99", "--resume"])
    assert spark.read.parquet(f"{built}/g/edges").where("weight < 0.99").count() == 0  # another threshold is not resumed
    cli.main(["graph", "--input", f"{built}/counts", "--outdir", f"{built}/g", "--max-genes", "9", "--corr-threshold", "0.5"])


def test_graph_to_results_and_three_way_report(spark, built):
    out = f"{built}/r"
    cli.main(["run", "--graph", f"{built}/g", "--outdir", out, "--restarts", "1", "--bfs-source", "0", "--rwr-seeds", "0", "1", "999"])
    assert {r["algorithm"] for r in table(f"{out}/timing")} == set(cli.ALGOS)
    assert set(table(f"{out}/comparison")[0]) == {"algorithm", "parallel_time_s"}
    scores = [float(r["pagerank"]) for r in table(f"{out}/pagerank_csv")]
    assert len(scores) == 8 and scores == sorted(scores, reverse=True) and sum(scores) == pytest.approx(1)
    mce = [float(r["mce_score"]) for r in table(f"{out}/mce_csv")]
    assert mce == sorted(mce) and len(mce) == 8
    assert [int(r["triangles"]) for r in table(f"{out}/motif_csv")] == sorted((int(r["triangles"]) for r in table(f"{out}/motif_csv")), reverse=True)
    assert set(table(f"{out}/bfs_csv")[0]) == {"gene_id", "bfs_distance"}
    assert set(table(f"{out}/gnn_csv")[0]) == {"gene_id", *[f"dim_{i}" for i in range(32)]}
    assert {r["gene_id"] for r in table(f"{out}/louvain_csv")} == {r["gene_id"] for r in table(f"{out}/mcl_csv")} == {f"G{i}" for i in range(9) if i != 2}
    assert table(f"{out}/hits_hub_score_csv") and table(f"{out}/rwr_csv")
    cli.main(["run", "--graph", f"{built}/g", "--outdir", f"{built}/m", "--algo", "motif", "--single-timing", f"{out}/timing", "--workers", "4"])
    row = {r["algorithm"]: r for r in table(f"{built}/m/comparison")}["motif"]
    assert float(row["efficiency_pct"]) == pytest.approx(float(row["speedup_x"]) / 4 * 100, abs=0.06)
    assert {r["algorithm"]: r["speedup_x"] for r in table(f"{built}/m/report")}["bfs"] == "N/A" and table(f"{built}/m/totals")
    cli.main(["run", "--graph", f"{built}/g", "--outdir", f"{built}/w", "--algo", "motif", "--single-timing", f"{out}/timing", "--parallel-timing", f"{built}/m/timing"])
    assert set(table(f"{built}/w/comparison")[0]) >= {"gpu_time_s", "single_time_s", "parallel_time_s", "gpu_vs_single", "gpu_vs_parallel"}


def test_smoke_graph(spark, built):
    """100 vertices, 300 draws, duplicates summed, both directions: as edges of indexes that are no dense axis."""
    rng = np.random.default_rng(42)
    rows = [(int(a) * 5, int(b) * 5, float(w)) for a, b, w in zip(rng.integers(0, 100, 300), rng.integers(0, 100, 300), rng.uniform(0.5, 1.0, 300)) if a < b]
    spark.createDataFrame(rows, "src int, dst int, weight double").write.parquet(f"{built}/e")
    spark.range(100).selectExpr("int(id * 5) gene_idx", "concat('g', id) gene_id").write.parquet(f"{built}/v")
    cli.main(["run", "--edges", f"{built}/e", "--genes", f"{built}/v", "--outdir", f"{built}/s", "--algo", "m21", "--bfs-sources", "3"])
    assert len(table(f"{built}/s/bfs_csv")) == 100 and len(table(f"{built}/s/bfs_csv")[0]) == 4
    assert all(int(c.removeprefix("dist_from_")) % 5 == 0 for c in table(f"{built}/s/bfs_csv")[0] if c != "gene_id")


def test_names_of_rows_without_an_identifier(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as double) s1", "cast(id + 1 as double) s2").repartition(4).write.parquet(str(tmp_path / "w"))
    raw = counts.row_prefix(spark, str(tmp_path / "w"), 25)
    assert sorted(r.gene_id for r in counts.gene_names(raw, "row_idx").collect()) == sorted(f"gene_{i}" for i in range(25))
    assert counts.to_long(raw, index="row_idx").count() == 50
    with pytest.raises(ValueError):
        counts.to_long(raw.drop("row_idx"))
    one = counts.inspect_parquet(spark, str(tmp_path / "w")).first()
    assert (one["rows"], one["columns"], one["files"], one["row_groups"]) == (40, 2, 4, 4) and one["uncompressed_bytes"] > 0


def test_groups_and_doctor(spark):
    assert cli.chosen("m21") == ["bfs", "pagerank", "mce"] and len(cli.chosen("all")) == 9
    cli.main(["doctor"])
