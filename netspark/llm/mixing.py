"""Mixing sources to target weights: entropy balancing, then rounding into copies.

The rates r of the documents minimise sum r (log r - 1) under one token
constraint a source and 0 <= r <= max_repeats. The minimiser is an exponential
tilt, r = min(max_repeats, exp(lambda * tokens)), with one lambda a source, found
by Newton steps on the convex dual, whose gradient and curvature are sums over
all documents. The rates are rounded into whole copies with one threshold a
source on a hashed order of the documents, so that no token total drifts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.workspace import Workspace

FINE = 1024
SUMS = 1 << 17  # sums of one pass that come to the driver, of at most 2,000 sources


def reachable(targets: dict[str, tuple[float, int]], available: dict[str, int], total: int) -> dict[str, float]:
    """Tokens a source should give. A source that cannot reach its share gives all
    it may, and what it lacks is spread over the others in proportion to their shares."""
    cap = {s: available.get(s, 0) * max(0, m) for s, (_, m) in targets.items()}
    goal: dict[str, float] = {s: 0.0 for s in targets}
    free = {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}
    left = float(total)
    while free and left > 0:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / weight >= cap[s]}
        for s in over or free:
            goal[s] = float(cap[s]) if over else left * targets[s][0] / weight
        if not over:
            break
        left -= sum(goal[s] for s in over)
        free -= over
    return goal


def _told(rows: DataFrame, **columns: dict[str, float]) -> DataFrame:
    """``rows`` with a number a source in each of ``columns``, of the sources that all of them
    have: a join with a broadcast of one row a source, of which the caller bounds the number."""
    first, *more = columns.values()
    listed = [(s, *(float(c[s]) for c in columns.values())) for s in first if all(s in c for c in more)]
    told = rows.sparkSession.createDataFrame(listed, ", ".join(["source string", *(f"{c} double" for c in columns)]))
    return rows.join(F.broadcast(told), "source")


def _tilted(lam: Column, cap: Column, n: Column) -> Column:
    """min(cap, exp(lam n)), without overflow."""
    return F.least(cap, F.exp(F.least(lam * n, F.lit(60.0))))


def solve_tilts(hist: DataFrame, goal: dict[str, float], repeats: dict[str, int], cap: dict[str, int], *, rel: float = 1e-7, max_steps: int = 60) -> dict[str, float]:
    """Lambda of every source by Newton steps on the dual, kept inside a bracket.

    ``hist`` has (source, n, docs): how many documents of a source have n tokens,
    which is all the dual needs. A step is one aggregate with a row a source.
    """
    lam = {s: 0.0 for s, g in goal.items() if 0 < g < cap[s]}
    lo, hi = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    done: set[str] = set()
    for _ in range(max_steps):
        todo = [s for s in lam if s not in done]
        if not todo:
            break
        n, m = F.col("n").cast("double"), F.col("most")
        r = _tilted(F.col("lam"), m, n)
        at = _told(hist, lam={s: lam[s] for s in todo}, most=repeats).groupBy("source").agg(F.sum(F.col("docs") * n * r).alias("g"), F.sum(F.when(r < m, F.col("docs") * n * n * r).otherwise(0.0)).alias("h"), F.max("n").alias("top"))
        for x in at.collect():
            s, gap = x.source, x.g - goal[x.source]
            if abs(gap) <= rel * goal[s]:
                done.add(s)
                continue
            (hi if gap > 0 else lo)[s] = lam[s]
            new = lam[s] - gap / x.h if x.h > 0 else math.inf * -gap
            if not lo[s] < new < hi[s] or not math.isfinite(new):
                if math.isinf(lo[s]) or math.isinf(hi[s]):  # no bracket yet: go on, twice as far
                    new = lam[s] + math.copysign(max(abs(lam[s]), 1.0 / x.top), -gap)
                else:
                    new = (lo[s] + hi[s]) / 2
            lam[s] = new
    return lam


def mix_sources(sizes: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", size: str = "n_tokens", *, total: int | None = None, max_sources: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The mix (``ident``, ``source``, ``n_tokens``, ``copies``) and its report.

    ``targets`` (``source``, ``target_share``, ``max_repeats``) is a control table
    of at most ``max_sources`` rows. Sources compare trimmed and ignoring case;
    of a source listed twice the greater row holds. ``total`` is the size to
    reach, by default that of all of ``sizes``. The report has, per listed source,
    ``target_share``, ``available_tokens``, ``goal_tokens``, ``mixed_tokens``,
    ``mixed_docs``, ``real_share`` and ``reached`` (False where ``max_repeats``
    of everything falls short of the share, or nothing is available).

    Records of a NULL or unlisted source count into the total and are not drawn.
    Rows of NULL or non-positive size are not drawn. Repeated rows are separate
    records. Equal hashes go together: the threshold takes or leaves all of them.
    Empty tables give an empty mix. Extra columns are not read. ``sizes`` is read
    several times: pass a written table.
    """
    spark = sizes.sparkSession
    ws = Workspace(spark, "mix")
    tidy = lambda c: F.lower(F.btrim(c, F.lit(" \t\n\r")))
    rows = targets.select(tidy(F.col("source")).alias("source"), F.struct("target_share", "max_repeats").alias("t")).where("source is not null").groupBy("source").agg(F.max("t").alias("t")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    want = {r.source: (float(r.t.target_share or 0), int(r.t.max_repeats if r.t.max_repeats is not None else 1)) for r in rows}
    docs = sizes.select(F.col(ident).alias("id"), tidy(F.col(source)).alias("source"), F.col(size).cast("long").alias("n")).where("n > 0")
    hist = ws.save(docs.groupBy("source", "n").agg(F.count(F.lit(1)).alias("docs")), "hist")
    have = {r.source: int(r.t) for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("docs")).alias("t")).where(F.col("source").isin(list(want)) | F.col("source").isNull()).collect()}
    if total is None:
        total = int(hist.agg(F.sum(F.col("n") * F.col("docs"))).first()[0] or 0)
    repeats = {s: m for s, (_, m) in want.items()}
    cap = {s: have.get(s, 0) * max(0, repeats[s]) for s in want}
    goal = reachable(want, have, total)
    lam = solve_tilts(hist, goal, repeats, cap)

    listed = [s for s in want if goal[s] > 0]
    full = {s: float(goal[s] >= cap[s] > 0) for s in listed}
    rate = F.when(F.col("full") == 1, F.col("most")).otherwise(_tilted(F.col("lam"), F.col("most"), F.col("n").cast("double")))
    base = _told(docs, full=full, most=repeats, lam={s: lam.get(s, 0.0) for s in listed}).withColumn("rate", rate).drop("full", "most", "lam")
    # u in [0, 1): the place of a record in the hashed order; it gets its last copy if u - fraction <= threshold
    u = F.shiftrightunsigned(F.xxhash64("id", "n"), 11).cast("double") / float(1 << 53)
    base = base.withColumn("least", F.floor("rate").cast("int")).withColumn("key", u - (F.col("rate") - F.floor("rate")))
    base = ws.save(base.withColumn("more", F.col("rate") > F.col("least")), "rates")
    floor = {r.source: int(r.t or 0) for r in base.groupBy("source").agg(F.sum(F.col("n") * F.col("least")).alias("t")).collect()}
    cut = _thresholds(base.where("more"), {s: goal[s] - floor.get(s, 0) for s in listed})
    copies = F.col("least") + F.when(F.col("more") & (F.col("key") <= F.col("cut")), 1).otherwise(0)
    mix = _told(base, cut={s: cut.get(s, -2.0) for s in listed}).withColumn("copies", copies.cast("int")).where("copies > 0").select(F.col("id").alias(ident), "source", F.col("n").alias("n_tokens"), "copies")
    mix = ws.save(mix, "mix")
    ws.drop("hist", "rates")
    got = {r.source: (int(r.t), int(r.d)) for r in mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("d")).collect()}
    mixed = sum(t for t, _ in got.values()) or 1
    report = [(s, w, m, have.get(s, 0), int(round(goal[s])), *got.get(s, (0, 0)), round(got.get(s, (0, 0))[0] / mixed, 6), bool(cap[s] >= w * total and (cap[s] > 0 or w == 0))) for s, (w, m) in sorted(want.items())]
    schema = "source string, target_share double, max_repeats int, available_tokens long, goal_tokens long, mixed_tokens long, mixed_docs long, real_share double, reached boolean"
    return mix, spark.createDataFrame(report, schema)


def _thresholds(rows: DataFrame, need: dict[str, float]) -> dict[str, float]:
    """Per source the key up to which the sizes add up to ``need``, as nearly as one record allows.

    Every pass cuts the open interval of each source into equal steps: sizes are
    summed by step, and only the step that holds the threshold goes on. What comes
    to the driver is at most ``SUMS`` sums a pass, or 32 a source.
    """
    fine = max(32, min(FINE, SUMS // max(1, len(need))))
    passes = math.ceil(50 / math.log2(fine))
    span = {s: (-1.0, 2.0, float(x)) for s, x in need.items()}  # from, width, tokens needed above from
    cut = {s: -2.0 for s in need}
    for p in range(passes):
        todo = {s: v for s, v in span.items() if v[2] > 0}
        if not todo:
            break
        b = F.floor((F.col("key") - F.col("lo")) / F.col("width") * fine)
        sums: dict[str, list[tuple[int, int]]] = {s: [] for s in todo}
        last = _told(rows, lo={s: v[0] for s, v in todo.items()}, width={s: v[1] for s, v in todo.items()}).withColumn("b", b).where((F.col("b") >= 0) & (F.col("b") < fine))
        for r in last.groupBy("source", "b").agg(F.sum("n").alias("t")).orderBy("source", "b").collect():
            sums[r.source].append((int(r.b), int(r.t)))
        for s, (at, w, left) in todo.items():
            for k, t in sums[s]:
                if t > left:
                    cut[s] = at + k * w / fine - w / fine * 1e-9
                    if p == passes - 1 and t - left < left:
                        cut[s] = at + (k + 1) * w / fine
                    span[s] = (at + k * w / fine, w / fine, left)
                    break
                left -= t
                cut[s] = at + (k + 1) * w / fine - w / fine * 1e-9
            else:
                span[s] = (at, w, 0.0)
    return cut
