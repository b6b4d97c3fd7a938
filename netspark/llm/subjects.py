"""Subject areas of documents: bisecting k-means, leaf labels, leaf mixtures.

1. Every text becomes the term codes of its body's sentences (``bodytext``).
2. Document frequencies over all documents choose the terms; the frequent ones
   make the vectors.
3. Documents are unit vectors (log term frequency times squared idf, projected on
   ``DIMS`` fixed random directions). Bisecting k-means splits the leaves of
   largest error, all leaves of a round at once, by Spark passes whose only result
   are the sums of the halves.
4. Terms are counted by leaf over all documents. A leaf is labelled by its most
   discriminative terms. Its subject mixture comes from the labelled documents in
   it and from its label: a term stands for the mixtures of the leaves that it
   labels, so leaves without labelled documents learn from those they share terms with.
5. A sentence is told apart among the leaves by its terms, the document's own leaf
   being more likely beforehand, and treats the subject that the mixtures of its
   likely leaves agree on. A document has the subjects of ``min_share`` of its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.workspace import Workspace

DIMS = 256
MAX_TERMS = 65_536  # what is sent to tasks is bounded by terms times leaves; more is an error
MAX_LABELS = 100_000  # rows of labels that are read; they are a sample by nature
MAX_SUBJECTS = 1_000  # more is an error
SAMPLE = 16_384  # vectors on which splits are started
LABEL_TERMS = 20  # discriminative terms of a leaf's label


def parse(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, codes, ends) of every document with at least one body sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from netspark.llm.bodytext import coded

        for b in batches:
            rows = [coded(t) for t in b["t"]]
            out = pd.DataFrame({"id": b["id"], "codes": [r[0] for r in rows], "ends": [r[1] for r in rows]})
            yield out[[len(r[1]) > 0 for r in rows]]

    kind = docs.schema[ident].dataType.simpleString()
    have = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return have.mapInPandas(run, f"id {kind}, codes array<int>, ends array<int>")


def _vectors(terms: np.ndarray, wide: np.ndarray, weight: np.ndarray):
    """(id, at, ends, v): the known terms of each sentence by their number, and the document's unit vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes = np.random.default_rng(1).standard_normal((int(wide.sum()), DIMS)).astype("f4") * weight[:, None].astype("f4")
        axis_of = np.cumsum(wide) - 1
        for b in batches:
            ats, ends, out = [], [], []
            for codes, stops in zip(b["codes"], b["ends"]):
                codes = np.asarray(codes)
                p = np.searchsorted(terms, codes)
                p[p == len(terms)] = 0
                hit = terms[p] == codes
                p = p[hit].astype("i4")
                ats.append(p)
                ends.append(np.concatenate([[0], np.cumsum(hit)])[np.asarray(stops)].astype("i4"))
                term, tf = np.unique(axis_of[p[wide[p]]], return_counts=True)
                v = (1 + np.log(tf)).astype("f4") @ axes[term] if len(term) else np.zeros(DIMS, "f4")
                norm = float(np.linalg.norm(v))
                out.append((v / norm if norm > 0 else v).astype("f2").tobytes())
            yield pd.DataFrame({"id": b["id"], "at": ats, "ends": ends, "v": out})

    return run


class Tree:
    """Splits in the order they were made: (leaf that was split, direction of its first half)."""

    def __init__(self):
        self.splits: list[tuple[int, np.ndarray]] = []

    def leaves(self, x: np.ndarray, extra: list[tuple[int, np.ndarray]] = ()) -> np.ndarray:
        """Leaf of each row; the second half of split number i is leaf i + 1. Rows of zeros are at -1."""
        splits = [*self.splits, *extra]
        leaf = np.where((x != 0).any(1), 0, -1)
        if splits:
            side = x @ np.stack([d for _, d in splits]).T.astype("f4") > 0
            for i, (at, _) in enumerate(splits):
                leaf[(leaf == at) & ~side[:, i]] = i + 1
        return leaf


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "f2").reshape(len(col), DIMS).astype("f4")


def _sums(vectors: DataFrame, tree: Tree, extra: list) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of the vectors of every leaf: at most a row a leaf to the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = None, None
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"])
            leaf = tree.leaves(x, extra) + 1
            k = len(tree.splits) + len(extra) + 2
            if total is None:
                total, count = np.zeros((k, DIMS)), np.zeros(k, np.int64)
            hot = np.zeros((k, len(x)), "f4")
            hot[leaf, np.arange(len(x))] = 1
            total += hot @ x
            count += np.bincount(leaf, minlength=k)
        if total is not None:
            at = np.flatnonzero(count)
            yield pd.DataFrame({"leaf": (at - 1).astype("i4"), "n": count[at], "s": [total[i].tobytes() for i in at]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(g["s"]), "f8").reshape(len(g), DIMS).sum(0)
        return pd.DataFrame({"leaf": g["leaf"].iloc[:1], "n": [int(g["n"].sum())], "s": [s.tobytes()]})

    schema = "leaf int, n long, s binary"
    rows = vectors.select("v").mapInPandas(part, schema).groupBy("leaf").applyInPandas(merge, schema).collect()
    return {r.leaf: (r.n, np.frombuffer(r.s, "f8")) for r in rows if r.leaf >= 0}


def _halves(x: np.ndarray, rng: np.random.Generator, starts: int = 6, rounds: int = 12) -> np.ndarray | None:
    """Direction between the two centres of the best of several 2-means on the rows of ``x``."""
    best = (0.0, None)
    for _ in range(starts if len(x) > 1 else 0):
        i, j = rng.choice(len(x), 2, replace=False)
        d = x[i] - x[j]
        a = b = None
        for _ in range(rounds):
            side = x @ d > 0
            a, b = x[side].sum(0), x[~side].sum(0)
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if not (na > 0 and nb > 0):
                break
            new = a / na - b / nb
            if np.allclose(new, d):
                break
            d = new
        tight = sum(float(v @ v) / max(1, k) for v, k in ((a, int(side.sum())), (b, int((~side).sum()))))
        if tight > best[0]:
            best = (tight, d)
    return best[1]


def bisect(vectors: DataFrame, leaves: int, rounds: int = 2) -> tuple[Tree, dict[int, int]]:
    """Bisecting k-means up to ``leaves`` leaves, and the number of documents of each.

    A split starts from the best of several 2-means on a bounded sample of the
    leaf's vectors (``SAMPLE`` of all, by hash) and is then fitted to all of them.
    """
    tree = Tree()
    share = min(1.0, SAMPLE / max(1, vectors.count()))
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(2 * SAMPLE).toPandas()
    sample = _matrix(some["v"]) if len(some) else np.zeros((0, DIMS), "f4")
    sample = sample[np.lexsort(sample[:, :8].T)]  # an order of the values, not of the tasks
    at = _sums(vectors, tree, [])
    while 0 < len(at) < leaves:
        error = sorted(((n - float(s @ s) / n, leaf) for leaf, (n, s) in at.items() if n > 1), reverse=True)
        error = [x for x in error if x[0] > 1e-3][: min(len(error) * 2 // 3 + 1, leaves - len(tree.splits) - 1)]
        if not error:
            break
        extra, held = [], tree.leaves(sample)
        for _, leaf in error:
            d = _halves(sample[held == leaf], np.random.default_rng(leaf))
            if d is not None:
                extra.append((leaf, d))
                continue
            s = at[leaf][1] / at[leaf][0]
            r = np.random.default_rng(leaf).standard_normal(DIMS) * 0.05 * np.linalg.norm(s)
            a, b = s + r, s - r
            extra.append((leaf, a / np.linalg.norm(a) - b / np.linalg.norm(b)))
        first = len(tree.splits) + 1
        for _ in range(rounds):
            at = _sums(vectors, tree, extra)
            for i, (leaf, _) in enumerate(extra):
                if leaf in at and first + i in at:
                    a, b = at[leaf][1], at[first + i][1]
                    extra[i] = (leaf, a / max(np.linalg.norm(a), 1e-9) - b / max(np.linalg.norm(b), 1e-9))
        tree.splits += extra
        at = _sums(vectors, tree, [])
        if len(tree.splits) + 1 >= leaves:
            break
    return tree, {leaf: n for leaf, (n, _) in at.items()}


def _term_counts(docs: DataFrame, tree: Tree, terms: int, leaves: int) -> np.ndarray:
    """(terms, leaves): documents of each leaf with each term."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf = tree.leaves(_matrix(b["v"]))
                cells = [np.unique(at) * leaves + f for at, f in zip(b["at"], leaf) if f >= 0]
                cell, n = np.unique(np.concatenate(cells or [np.zeros(0, "i4")]), return_counts=True)
                yield pd.DataFrame({"cell": cell.astype("i4"), "n": n.astype("i8")})

    if terms * leaves >= 1 << 31:
        raise ValueError("more than 2^31 counts of terms by leaf")
    got = docs.select("at", "v").mapInPandas(part, "cell int, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toPandas()
    out = np.zeros(terms * leaves)
    out[got["cell"].to_numpy()] = got["n"].to_numpy("f8")
    return out.reshape(terms, leaves)


def leaf_labels(counts: np.ndarray, size: np.ndarray, freq: np.ndarray, n: int, top: int = LABEL_TERMS) -> np.ndarray:
    """(terms, leaves): weights, of sum 1, of the ``top`` most discriminative terms of each leaf.

    A term counts by its log lift in the leaf times the root of its documents there.
    """
    rate = freq[:, None] / n
    weight = np.sqrt(counts) * np.maximum(np.log((counts + 2 * rate) / (size + 2) / rate), 0)
    least = np.sort(weight, axis=0)[-min(top, len(weight))]
    weight = np.where((weight >= least) & (weight > 0), weight, 0)
    return weight / np.maximum(weight.sum(0), 1e-9)


def leaf_mixtures(votes: np.ndarray, labels: np.ndarray, size: np.ndarray, trust: float = 4.0, rounds: int = 4) -> np.ndarray:
    """(leaves, subjects): the votes of labelled documents, and ``trust`` votes by the leaf's label.

    A label term's own mixture is that of the leaves it labels, weighted by their votes.
    """
    prior = votes.sum(0) / max(votes.sum(), 1e-9)
    held = votes.sum(1, keepdims=True)
    mix = (votes + 0.5 * prior) / (held + 0.5)
    carried = labels * size * (held[:, 0] + 0.05)
    for _ in range(rounds):
        term = (carried @ mix + 0.2 * prior) / (carried.sum(1, keepdims=True) + 0.2)
        mix = (votes + trust * labels.T @ term) / (held + trust)
    return mix


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, ident: str = "doc_id", text: str = "text", *, leaves: int = 128, min_share: float = 0.25, vector_df: float = 3e-3, evidence_df: float = 1e-3, max_df: float = 0.3, own_leaf: float = 1.0, least: float = 0.4) -> DataFrame:
    """(``ident``, ``subject``, ``share``): the subjects that hold ``min_share`` of a document's body.

    ``labels`` (``ident``, ``subject``, ``annotator``) is a sample of labelled
    documents of at most ``MAX_LABELS`` rows, the smallest idents; labels compare
    trimmed and ignoring case, those not in ``subjects`` stand for no subject,
    repeated ones of one annotator count once, and a document's labels share one
    vote. ``subjects`` has the column ``subject``; more than ``MAX_SUBJECTS`` of
    them, or more than ``MAX_TERMS`` terms with a document frequency from
    ``evidence_df`` to ``max_df``, are an error. ``own_leaf`` is what the document's
    leaf has over others, in nats; ``least`` the share of a sentence's mixture that
    its subject needs.

    Documents with a NULL or empty text, or without body sentences, have no
    subject and no row. Repeated rows and rows with a NULL ident are documents of
    their own. Without documents, labels or subjects the result is empty. Counts,
    vectors and clusters are those of all documents; texts are read whole, once.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "subjects")
    kind = docs.schema[ident].dataType.simpleString()
    nothing = spark.createDataFrame([], f"`{ident}` {kind}, subject string, share double")
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    tidy = {s.strip().lower(): i for i, s in enumerate(names)}
    parsed = ws.save(parse(docs, ident, text), "parsed")
    n = parsed.count()
    if not n or not names:
        return nothing

    df = parsed.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    df = df.where((F.col("df") >= max(3.0, evidence_df * n)) & (F.col("df") <= max(3.0, max_df * n)))
    rows = df.limit(MAX_TERMS + 1).toPandas().sort_values("code")
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: raise evidence_df")
    terms, freq = rows["code"].to_numpy(np.int32), rows["df"].to_numpy("f8")
    if not len(terms):
        return nothing
    wide = freq >= vector_df * n
    known = ws.save(parsed.mapInPandas(_vectors(terms, wide, np.log(n / freq[wide]) ** 2), f"id {kind}, at array<int>, ends array<int>, v binary"), "known")
    ws.drop("parsed")
    tree, held = bisect(known, leaves)
    k, count = len(names), len(tree.splits) + 1
    size = np.array([held.get(leaf, 0) for leaf in range(count)], "f8")

    mark = labels.select(F.col(ident).alias("id"), F.lower(F.trim("subject")).alias("s"), F.col("annotator").alias("by")).where("id is not null and s is not null").distinct()
    mark = ws.save(mark.orderBy("id", "s", "by").limit(MAX_LABELS), "marks")
    mark = mark.join(mark.groupBy("id").agg((1.0 / F.count(F.lit(1))).alias("w")), "id").select("id", "s", "w")

    def leaf_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"s": b["s"], "w": b["w"], "leaf": tree.leaves(_matrix(b["v"])).astype("i4")})

    said = known.select("id", "v").join(F.broadcast(mark), "id").mapInPandas(leaf_of, "s string, w double, leaf int")
    said = said.groupBy("s", "leaf").agg(F.sum("w").alias("w")).where("leaf >= 0").collect()
    if not said:
        return nothing
    votes = np.zeros((count, k + 1))  # the last stands for no subject
    for s, leaf, w in said:
        votes[leaf, tidy.get(s, k)] += w
    counts = _term_counts(known, tree, len(terms), count)
    mixture = leaf_mixtures(votes, leaf_labels(counts, size, freq, n), size)
    base = size @ mixture / size.sum()
    mixture = (mixture / np.sqrt(np.maximum(base, 1e-9))) ** 2
    mixture /= np.maximum(mixture.sum(1, keepdims=True), 1e-9)
    rate = freq[:, None] / n
    speaks = np.log((counts + 2 * rate) / (size + 2) / rate).astype("f4")
    before = np.log(np.maximum(size, 0.5) / size.sum()).astype("f4")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, found, share = [], [], []
            own = tree.leaves(_matrix(b["v"])) if len(b) else []
            for i, at, ends, home in zip(b["id"], b["at"], b["ends"], own):
                at, ends = np.asarray(at), np.asarray(ends)
                start = np.concatenate([[0], ends[:-1]])
                some = np.flatnonzero(ends > start)
                z = before.copy()
                if home >= 0:
                    z[home] += own_leaf
                got = np.zeros(k)
                for x in range(0, len(some), 512):  # a bounded part of a long text at a time
                    part = some[x : x + 512]
                    lo = start[part[0]]
                    q = np.add.reduceat(speaks[at[lo : ends[part[-1]]]], start[part] - lo, axis=0) + z
                    q = np.exp(q - q.max(1, keepdims=True))
                    subject = (q @ mixture / q.sum(1, keepdims=True))[:, :k]
                    got += np.bincount(subject.argmax(1)[subject.max(1) > least], minlength=k)
                got /= len(ends)
                for j in np.flatnonzero(got >= min_share):
                    ids.append(i)
                    found.append(names[j])
                    share.append(got[j])
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "subject": pd.Series(found, dtype=object), "share": pd.Series(share, dtype="f8")})

    out = known.select("id", "at", "ends", "v").mapInPandas(assign, f"id {kind}, subject string, share double")
    return out.select(F.col("id").alias(ident), "subject", F.round("share", 6).alias("share"))
