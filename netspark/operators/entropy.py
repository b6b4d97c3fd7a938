"""Mean conditional entropy of all genes given a regulator, in bits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netspark.operators.lookup import SMALL_BYTES
from netspark.workspace import Workspace

BLOCK = 2048  # genes of a block at most,
BLOCK_BYTES = 32 << 20  # and the bytes of their vectors
TASKS = 4000


def _bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 0..n-1 over [lo, hi], the last one closed; 0 where lo = hi."""
    width = (hi - lo) / n
    return F.when(hi == lo, 0).otherwise(F.least(F.floor((v - lo) / F.when(width == 0, 1.0).otherwise(width)), F.lit(n - 1))).cast("int")


def conditional_entropy(long: DataFrame, regulators: DataFrame, n_bins: int = 10) -> DataFrame:
    """(regulator, target, h): H(target | regulator), 0 where every slice was skipped.

    The regulator is binned over [min, max + 1e-8]; within each of its bins the
    target is binned over the bin's own range; bins of one sample count 0 while
    their share is not spread over the others. One join on the sample; bin ranges
    and counts are plain aggregates, so nothing is gathered per pair.
    """
    reg = long.join(regulators.select("gene"), "gene", "left_semi").select(F.col("gene").alias("regulator"), "sample", F.col("value").alias("x"))
    span = reg.groupBy("regulator").agg(F.min("x").alias("lo"), (F.max("x") + 1e-8).alias("hi"), F.count(F.lit(1)).alias("n"))
    xb = reg.join(span, "regulator").select("regulator", "sample", "n", _bin(F.col("x"), F.col("lo"), F.col("hi"), n_bins).alias("xb"))
    pair = xb.join(long.select(F.col("gene").alias("target"), "sample", F.col("value").alias("y")), "sample").where("regulator <> target")
    key = ["regulator", "target", "xb"]
    slices = pair.groupBy(*key).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("nb"), F.first("n").alias("n"))
    cells = pair.select(*key, "y").join(slices, key).withColumn("yb", _bin(F.col("y"), F.col("lo"), F.col("hi"), n_bins)).groupBy(*key, "yb").agg(F.count(F.lit(1)).alias("c"), F.first("nb").alias("nb"), F.first("n").alias("n"))
    p = F.col("c") / F.col("nb")
    part = F.when(F.col("nb") >= 2, -p * F.log2(p) * F.col("nb") / F.col("n")).otherwise(0.0)
    return cells.groupBy("regulator", "target").agg(F.sum(part).alias("h"))


def _entropies(x: np.ndarray, y: np.ndarray, n_bins: int) -> np.ndarray:
    """H(target | x) of every row of ``y``; NaN is a missing sample, also as a result where none is common."""
    own = np.flatnonzero(~np.isnan(x))
    lo, hi = x[own].min(), x[own].max() + 1e-8
    xb = np.zeros(len(own), "i8") if hi == lo else np.minimum(np.floor((x[own] - lo) / ((hi - lo) / n_bins or 1.0)), n_bins - 1).astype("i8")
    h, seen, row = np.zeros(len(y)), np.zeros(len(y), bool), np.arange(len(y))[:, None] * (n_bins + 1)
    for b in np.unique(xb):
        v = y[:, own[xb == b]]
        gone = np.isnan(v)
        lo = np.where(gone, np.inf, v).min(1, keepdims=True)
        hi = np.where(gone, -np.inf, v).max(1, keepdims=True)
        flat = ~(hi > lo)
        width = np.where(flat, 1.0, (hi - lo) / n_bins)
        at = np.minimum(np.floor((v - np.where(flat, 0.0, lo)) / np.where(width == 0, 1.0, width)), n_bins - 1)
        at = np.where(gone, n_bins, np.where(flat, 0, at)).astype("i8")
        c = np.bincount((row + at).ravel(), minlength=len(y) * (n_bins + 1)).reshape(len(y), -1)[:, :n_bins]
        nb = c.sum(1)
        p = c / np.maximum(nb, 1)[:, None]
        part = -(p * np.log2(np.where(c > 0, p, 1.0))).sum(1) * nb / len(own)
        h += np.where(nb >= 2, part, 0.0)
        seen |= nb > 0
    return np.where(seen, h, np.nan)


FIELD, WIDTH = 6, 63  # bits of a count in a word, and the samples that it can count


class _Targets:
    """H(target | x) of the same targets for many x: ``y`` (samples, targets), without a NaN.

    The counts of a slice's bins lie beside each other in one word a target, so that a
    sum over the slice's samples counts them all. The bins of three samples at a time index
    a table of such words, and two counts at a time one of their logarithms.
    """

    def __init__(self, y: np.ndarray, n_bins: int):
        self.y, self.n_bins, n = y, n_bins, max(len(y), 2 * WIDTH)
        self.clog = np.arange(n + 1) * np.log2(np.maximum(np.arange(n + 1), 1))
        self.pairs = (self.clog[: WIDTH + 1, None] + self.clog[: WIDTH + 1]).ravel()
        one = np.uint64(1) << (FIELD * np.minimum(np.arange(n_bins + 2), n_bins - 1)).astype("u8")
        one[-1] = 0  # no sample; the one before it is the upper end, of the last bin
        self.three = (one[:, None, None] + one[:, None] + one).ravel()
        self.v, self.at = np.empty((WIDTH, y.shape[1])), np.empty((WIDTH, y.shape[1]), "u2")  # WIDTH is a multiple of 3
        self.word, self.words = np.empty((WIDTH // 3, y.shape[1]), "u8"), np.empty((n_bins, y.shape[1]), "u8")
        self.two, self.log = np.empty((n_bins, y.shape[1]), "u8"), np.empty((n_bins, y.shape[1]))

    def _counts(self, v: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
        v -= lo
        v /= width
        if width.min() < 1e-300:  # so narrow that the quotient is no longer exact
            np.minimum(v, self.n_bins - 1, out=v)
        m = -(-len(v) // 3)
        np.copyto(self.at[: len(v)], v, casting="unsafe")
        self.at[len(v) : 3 * m] = self.n_bins + 1
        a, b, c = self.at[:m], self.at[m : 2 * m], self.at[2 * m : 3 * m]
        for x in (b, c):
            a *= self.n_bins + 2
            a += x
        return np.add.reduce(np.take(self.three, a, out=self.word[:m], mode="clip"), 0)

    def given(self, x: np.ndarray) -> np.ndarray:
        """As ``_entropies``; NaN in ``x`` is a missing sample."""
        own = np.flatnonzero(~np.isnan(x))
        lo, hi = x[own].min(), x[own].max() + 1e-8
        xb = np.zeros(len(own), "i8") if hi == lo else np.minimum(np.floor((x[own] - lo) / ((hi - lo) / self.n_bins or 1.0)), self.n_bins - 1).astype("i8")
        own = own[np.argsort(xb, kind="stable")]
        h, end, n = np.zeros(self.y.shape[1]), 0, 0
        for nb in np.bincount(xb).tolist():
            rows, end = own[end : end + nb], end + nb
            if nb < 2:
                continue
            few = nb <= WIDTH
            v = np.take(self.y, rows, axis=0, out=self.v[:nb] if few else None, mode="clip")
            lo = np.minimum.reduce(v, 0)
            width = (np.maximum.reduce(v, 0) - lo) / self.n_bins
            width[width == 0] = 1.0
            h += self.clog[nb]
            if few:
                self.words[n] = self._counts(v, lo, width)
                n += 1
                continue
            c = np.zeros((self.n_bins, len(h)), "i8")
            for a in range(0, nb, WIDTH):
                word = self._counts(v[a : a + WIDTH], lo, width)
                for k in range(self.n_bins):
                    c[k] += (word >> np.uint64(FIELD * k) & np.uint64((1 << FIELD) - 1)).view("i8")
            h -= self.clog[c].sum(0)
        words, two = self.words[:n], self.two[:n]
        for _ in range(0, self.n_bins, 2):
            np.bitwise_and(words, np.uint64((1 << 2 * FIELD) - 1), out=two)
            words >>= np.uint64(2 * FIELD)
            h -= np.add.reduce(np.take(self.pairs, two.view("i8"), out=self.log[:n], mode="clip"), 0)
        return h / len(own)


def _matrix(at: pa.ChunkedArray, values: pa.ChunkedArray, names: np.ndarray) -> np.ndarray:
    """(rows, names): the vectors of a block, NaN where a row lacks a sample."""
    at, values = at.combine_chunks(), values.combine_chunks()
    m = np.full((len(at), len(names)), np.nan)
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    m[row, np.searchsorted(names, at.flatten().to_numpy())] = values.flatten().to_numpy()
    return m


def _kinds(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``m``, and for each row which of them it is."""
    _, first, kind = np.unique(m.view(f"V{8 * m.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return m[first], kind.ravel()


def _block(x: np.ndarray, y: np.ndarray, n_bins: int) -> np.ndarray:
    """(len(x), len(y)): H(y | x)."""
    if np.isnan(y).any() or FIELD * n_bins > 60:
        return np.stack([_entropies(row, y, n_bins) for row in x])
    targets = _Targets(np.ascontiguousarray(y.T), n_bins)
    return np.stack([targets.given(row) for row in x])


def _rounded(h: np.ndarray, digits: int) -> np.ndarray:
    """Half up to ``digits`` decimals, never -0.0; NaN stays."""
    v = h * 10.0**digits
    low = np.floor(v)
    return (low + (v - low >= 0.5)) / 10.0**digits + 0.0


def entropy_by_blocks(long: DataFrame, regulators: DataFrame | None = None, n_bins: int = 10, *, sums: bool = False, block: int | None = None, digits: int | None = None) -> DataFrame:
    """The rows of ``conditional_entropy`` for many regulators, without a row per pair and sample.

    Without ``regulators`` every gene is one. Genes are folded into vectors and these
    into blocks by hash of the vector; each block of regulators meets each block of targets
    in a task of its own, which scores copies of a vector once. ``block`` is the genes of
    one (``BLOCK`` or what ``BLOCK_BYTES`` hold, fewer where that leaves cores idle).
    ``sums`` gives (gene, s), the sum over a regulator's targets, instead of the pairs.
    A sample that a gene lacks, or has as NULL or NaN, counts for no pair of it.
    ``digits`` rounds ``h`` in the task, once for each two vectors and not once a row.
    """
    spark = long.sparkSession
    ws = Workspace(spark, "entropy")
    kind = long.schema["gene"].dataType
    long = long.where("value is not null and not isnan(value)")
    names = ws.save(long.select("sample").distinct().select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("at")), "samples")
    width = names.count()
    names = F.broadcast(names) if width * 64 <= SMALL_BYTES else names
    numbered = long.join(names, long["sample"].eqNullSafe(names["sample"])).select("gene", "at", F.col("value").cast("double").alias("value"))
    vec = numbered.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))
    vec = ws.save(vec.select("gene", F.transform("x", lambda e: e["at"]).alias("s"), F.transform("x", lambda e: e["value"]).alias("v"), F.xxhash64("x").alias("mix")), "vectors")
    genes = vec.count()
    if block is None:
        spread = math.ceil(math.sqrt(3 * spark.sparkContext.defaultParallelism))
        block = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1)), max(128, genes // spread)))
    blocks = max(1, -(-genes // block))
    many = [r[0] for r in vec.groupBy("mix").count().where(F.col("count") > block).collect()]  # at most one a block
    mix = F.when(F.col("mix").isin(many), F.xxhash64("gene")).otherwise(F.col("mix")) if many else F.col("mix")
    vec = vec.withColumn("b", F.pmod(mix, F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    reg = vec if regulators is None else vec.join(regulators.select("gene"), "gene", "left_semi")
    # every column under a name of its own on either side: a cogroup of two views of one table mixes up shared ones
    reg = reg.select(F.col("gene").alias("regulator"), F.col("s").alias("rs"), F.col("v").alias("rv"), F.col("b").alias("i"), every.alias("j"))
    target = vec.select(F.col("gene").alias("target"), F.col("s").alias("ts"), F.col("v").alias("tv"), every.alias("ti"), F.col("b").alias("tj"))
    own = T.StructField("gene" if sums else "regulator", kind)
    schema = T.StructType([own, T.StructField("s", T.DoubleType())] if sums else [own, T.StructField("target", kind), T.StructField("h", T.DoubleType())])

    empty = to_arrow_schema(schema).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            used = np.unique(np.concatenate([np.unique(c.combine_chunks().flatten().to_numpy()) for c in (a["rs"], b["ts"])]))
            (x, xk), (y, yk) = _kinds(_matrix(a["rs"], a["rv"], used)), _kinds(_matrix(b["ts"], b["tv"], used))
            h = _block(x, y, n_bins)
            if digits is not None and not sums:
                h = _rounded(h, digits)
            regs, targets = a["regulator"].combine_chunks(), b["target"].combine_chunks()
            place = {g: k for k, g in enumerate(targets.to_pylist())}
            self_ = np.array([place.get(g, -1) for g in regs.to_pylist()])
            step = max(1, (1 << 18) // len(yk))
            every = None if sums else targets.take(pa.array(np.tile(np.arange(len(yk)), min(step, len(xk)))))
            for k in range(0, len(xk), step):
                part = np.take(np.take(h, xk[k : k + step], 0), yk, 1)
                r = np.flatnonzero(self_[k : k + step] >= 0)
                part[r, self_[k : k + step][r]] = np.nan
                keep = ~np.isnan(part)
                if sums:
                    some = keep.any(1)
                    parts.append(pa.table({"gene": regs[k : k + step].filter(pa.array(some)), "s": np.nansum(part[some], 1)}))
                elif keep.all():  # as in every block that is not a gene's own
                    r = np.repeat(np.arange(k, k + len(part)), len(yk))
                    parts.append(pa.table({"regulator": regs.take(pa.array(r)), "target": every.slice(0, part.size), "h": part.ravel()}))
                else:
                    r, c = np.nonzero(keep)
                    parts.append(pa.table({"regulator": regs.take(pa.array(r + k)), "target": targets.take(pa.array(c)), "h": part[keep]}))
        return pa.concat_tables(parts) if parts else empty

    tasks = min(blocks * blocks, TASKS)
    pairs = reg.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(target.repartition(tasks, "ti", "tj").groupBy("ti", "tj"))
    h = pairs.applyInArrow(run, schema)
    return h.groupBy("gene").agg(F.sum("s").alias("s")) if sums else h


def mce(long: DataFrame, regulators: DataFrame | None = None, n_bins: int = 10) -> DataFrame:
    """(gene, mce_score): the mean over all other genes; lower is a stronger regulator. Without ``regulators`` every gene is one."""
    genes = long.select("gene").distinct().count()
    return entropy_by_blocks(long, regulators, n_bins, sums=True).select("gene", (F.col("s") / (genes - 1)).alias("mce_score"))


def mce_all(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """(gene, mce_score) with every gene as a regulator."""
    return mce(long, None, n_bins)
