"""Mixing sources to target weights along a curriculum (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.distributed import blocked_prefix_sum, blocks_for
from braidwork.session import materialize


def default_schedule(targets: list[dict], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Weights over training time 0..1 as knots ``(time, weight)`` whose integral is the target share.

    Scarce sources (those that may be repeated more) gain weight towards the end, by up to ``tilt`` of their share,
    and the others lose as much, so that the weights add up to 1 at any time.
    """
    mean = sum(t["target_share"] * t["max_repeats"] for t in targets) / (sum(t["target_share"] for t in targets) or 1)
    most = max((abs(t["max_repeats"] - mean) for t in targets), default=0) or 1
    return {t["source"]: [(0.0, t["target_share"] * (1 - a)), (1.0, t["target_share"] * (1 + a))] for t in targets for a in [tilt * (t["max_repeats"] - mean) / most]}


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "tokens", schedule: dict[str, list[tuple[float, float]]] | None = None, total: float | None = None, seed: int = 17, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, tokens, copy_no, position)`` sorted by position, and a report of the shares reached.

    Each source's weight schedule (piecewise linear) is integrated into its cumulative token demand. A pass over a
    source takes its documents in a random order of its own; the running token count of a document is put into
    the inverse of the demand, which gives its ``position`` in training, 0 to 1. The result is range-partitioned
    and sorted by position.

    ``total`` is the size of the collection in tokens, by default the largest at which no source that has
    documents needs more than ``max_repeats`` passes. A source is used once, then again, up to its need; the last
    pass stops at the document nearest to it. With a larger ``total`` scarce sources fall short, which the report shows.

    Documents whose source is null or not in ``targets``, of null or no size, or with a null id are left out; equal
    (id, source) count once. Targets without documents are reported with share 0 and the others keep their
    proportions; a null or non-positive share or ``max_repeats`` counts as none. ``targets`` must have at most
    ``max_sources`` rows, each source once (the first by name and share counts): they are read by the driver.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(max_sources + 1).collect()
    if len(wanted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goals = [{"source": r["source"], "target_share": r["target_share"] or 0.0, "max_repeats": r["max_repeats"] or 0} for r in wanted]
    use = [g["source"] for g in goals if g["target_share"] > 0 and g["max_repeats"] > 0]
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("tokens")).where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0) & F.col("source").isin(use))
    own = materialize(own.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")), "mix")
    have = {r["source"]: r for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    goals.sort(key=lambda g: g["source"])
    live = [g for g in goals if g["source"] in have]
    whole = sum(g["target_share"] for g in live) or 1.0
    if total is None:
        total = min((have[g["source"]]["tokens"] * g["max_repeats"] * whole / g["target_share"] for g in live), default=0.0)
    knots = schedule or default_schedule(goals)
    plan, pieces = [], []
    for g in live:
        tokens = have[g["source"]]["tokens"]
        need = min(total * g["target_share"] / whole, float(tokens * g["max_repeats"]))
        line = sorted((float(t), float(w)) for t, w in knots[g["source"]])
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:])]
        area, done = sum(areas), 0.0
        for (t0, w0), (t1, w1), part in zip(line, line[1:], areas):
            pieces.append((g["source"], done / area, (done + part) / area, t0, t1, w0 / area, w1 / area))
            done += part
        plan.append((g["source"], int(tokens), float(need), int(min(g["max_repeats"], -(-need // tokens)))))
    plan_df = spark.createDataFrame(plan, "source string, __all long, __need double, __passes int")
    piece_df = spark.createDataFrame(pieces, "__source string, __u0 double, __u1 double, __t0 double, __t1 double, __w0 double, __w1 double")
    copies = own.join(F.broadcast(plan_df), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.greatest("__passes", F.lit(1))))).withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", "copy_no"))
    blocks = blocks_for(max((r["n"] for r in have.values()), default=0))
    run = blocked_prefix_sum(copies, ["source", "copy_no"], ["__key", "doc_id"], "tokens", "__before", blocks)
    at = F.col("__before") + (F.col("copy_no") - 1) * F.col("__all") + F.col("tokens") / 2
    run = run.withColumn("__at", at).where(F.col("__at") <= F.col("__need")).withColumn("__u", F.col("__at") / F.col("__need"))
    # within a piece the demand is u0 + w0 d + (w1 - w0) d^2 / (2 (t1 - t0)): solved for d without cancellation
    half = (F.col("__w1") - F.col("__w0")) / (2 * (F.col("__t1") - F.col("__t0")))
    rest = F.col("__u") - F.col("__u0")
    d = 2 * rest / (F.col("__w0") + F.sqrt(F.greatest(F.lit(0.0), F.col("__w0") * F.col("__w0") + 4 * half * rest)))
    placed = run.join(F.broadcast(piece_df), (F.col("source") == F.col("__source")) & (F.col("__u") > F.col("__u0")) & (F.col("__u") <= F.col("__u1"))).select("doc_id", "source", "tokens", "copy_no", (F.col("__t0") + d).alias("position"))
    placed = materialize(placed, "mixed")
    got = {r["source"]: r for r in placed.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("copy_no").alias("most")).collect()}
    used = sum(r["t"] for r in got.values()) or 1
    report = []
    for g in goals:
        r, own_tokens = got.get(g["source"]), int(have[g["source"]]["tokens"]) if g["source"] in have else 0
        report.append((g["source"], float(g["target_share"]), int(g["max_repeats"]), own_tokens, *((int(r["t"]), int(r["n"]), int(r["most"]), r["t"] / used) if r else (0, 0, 0, 0.0))))
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, available_tokens long, used_tokens long, used_documents long, most_repeats int, actual_share double")
    return placed.repartitionByRange("position", "doc_id", "copy_no").sortWithinPartitions("position", "doc_id", "copy_no"), shares
