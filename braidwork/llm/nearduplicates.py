"""Near-duplicate records with small edits (problem 2): the chosen-path join over sets of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import discard, materialize

WORD = re.compile(r"[^\W_]+")
#: Min-hashes that paths are chosen by; the first ones of those that the sketch has a bit of.
COORDS = 128
#: Tokens of a path that are chosen at once at its root.
ROOT = 2
SKETCH = 256
#: Ids that are broadcast at most, about 30 MB.
BROADCAST_IDS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, computed when it is first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """64-bit hashes of all runs of ``k`` consecutive words (longest runs of letters and digits, lower-cased)."""

    def __init__(self, k: int) -> None:
        self.k, self.known = k, WordHashes()
        self.factors = [np.uint64(int(f) | 1) for f in np.random.default_rng(k).integers(1, 1 << 63, k)]

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        n = len(words) - self.k + 1
        if n < 1:
            return np.empty(0, "uint64")
        if len(self.known) > 500_000:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), "uint64", len(words))
        s = h[:n] * self.factors[0]
        for j in range(1, self.k):
            s += h[j : j + n] * self.factors[j]
        return np.unique(_mix(s))


def signatures(docs: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``space, id, n, fp1, fp2, coords, s0..s3`` of ``space, id, text``; texts of fewer than ``k`` words have none.

    ``fp1, fp2`` identify the set, ``coords`` are min-hashes that paths are chosen by, ``s0..s3`` hold one bit of each
    of these and of further min-hashes.
    """
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 32, SKETCH, dtype="uint32") | np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, SKETCH, dtype="uint32")[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        with np.errstate(over="ignore"):
            for batch in batches:
                kept, sizes, prints, lows = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    s = shingles(text) if text else ()
                    if len(s):
                        m = a * (s >> np.uint64(32)).astype("uint32")
                        m += b
                        kept.append(i)
                        sizes.append(len(s))
                        prints.append((s.sum(), np.bitwise_xor.reduce(_mix(s + np.uint64(seed)))))
                        lows.append(m.min(axis=1))
                n = len(kept)
                low = _mix(np.array(lows, "uint64").reshape(n, SKETCH) << np.uint64(20))
                bits = np.packbits((low & np.uint64(1)).astype("uint8"), axis=1).view("int64").reshape(n, SKETCH // 64)
                fp = np.array(prints, "uint64").reshape(n, 2).view("int64")
                coords = pa.ListArray.from_arrays(np.arange(0, n * COORDS + 1, COORDS, dtype="int32"), (low[:, :COORDS] >> np.uint64(32)).astype("uint32").view("int32").ravel())
                own = batch.take(pa.array(kept, "int64"))
                columns = [own.column(0), own.column(1), pa.array(sizes, "int32"), *(pa.array(np.ascontiguousarray(fp[:, j])) for j in range(2)), coords, *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH // 64))]
                yield pa.RecordBatch.from_arrays(columns, names=["space", "id", "n", "fp1", "fp2", "coords", "s0", "s1", "s2", "s3"])

    return docs.select("space", "id", "text").mapInArrow(run, "space int, id long, n int, fp1 long, fp2 long, coords array<int>, s0 long, s1 long, s2 long, s3 long")


def _odds(n: int, p: float) -> np.ndarray:
    """The probabilities of 0..n successes in ``n`` trials."""
    return np.array([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def runs_needed(similarity: float, recall: float, branches: int, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a bucket of depth ``depth``, and its sketches have been close,
    with probability ``recall``.

    All runs and branches draw on the same coordinates, so the number of those that the pair shares is fixed first: for
    each such number the runs are as good as independent, and a pair that shares a bucket shares each of its children
    with the shared part as probability. The mean over these numbers is what is lost.
    """
    shared = np.arange(COORDS + 1) / COORDS
    lost = np.zeros(COORDS + 1)
    for _ in range(depth - ROOT):
        lost = (1 - shared + shared * lost) ** branches
    one = 1 - shared**ROOT * (1 - lost)
    odds, apart = _odds(COORDS, similarity), _odds(SKETCH, (1 - similarity) / 2)[_differing(similarity) + 1 :].sum()
    for runs in range(1, len(_root_coordinates(COORDS**2)) + 1):
        if odds @ one**runs + apart <= 1 - recall:
            return runs
    raise ValueError(f"a recall of {recall} at a similarity of {similarity} takes more than {COORDS} coordinates and sketches of {SKETCH} bits")


def _root_coordinates(runs: int) -> list[tuple[int, int]]:
    """Two coordinates for each run, every coordinate about as often as any other, no two twice."""
    out = [(c, c + d) for d in (COORDS // 2, *range(1, COORDS // 2)) for c in range(COORDS - d) if d == COORDS // 2 or c // d % 2 == 0]
    return out[:runs]


def _differing(similarity: float) -> int:
    """Bits that the sketches of sets at the threshold differ in, and 3.3 standard deviations more."""
    p = (1 + similarity) / 2
    least = p - 3.3 * (p * (1 - p) / SKETCH) ** 0.5
    return int(SKETCH * (1 - least))


def _close(similarity: float) -> Column:
    """Whether two sketches agree as much as those of sets at the threshold do, less 3.3 standard deviations."""
    differ = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    return differ <= _differing(similarity)


def _pairs(left: DataFrame, on: list[str], similarity: float, extra: Column | None = None) -> DataFrame:
    a, b = left.alias("a"), left.alias("b")
    cond = (F.col("a.id") < F.col("b.id")) & _close(similarity) & (3 * F.least("a.n", "b.n") >= F.col("a.n") + F.col("b.n") if similarity == 0.5 else F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n"))
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if extra is not None:
        cond = cond & extra
    return a.join(b.hint("shuffle_hash"), cond).select(F.col("a.space"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def candidates(sigs: DataFrame, similarity: float, recall: float = 0.995, limit: int = 128, branches: int = 3, depth: int = 6) -> DataFrame:
    """``space, id_a, id_b`` of set pairs that may be similar, from ``signatures`` of different sets.

    In every run a set goes into the bucket of two of its coordinates' values. Buckets of one set end. Buckets of up
    to ``limit`` sets are compared by their sketches. The sets of larger buckets choose ``branches`` further
    coordinates, the same for the whole bucket, and go on, level by level. There are as many runs as it takes for a
    pair at the threshold to meet with probability ``recall`` even if its buckets are split to ``depth``. Buckets that are too large at ``depth`` are compared in
    blocks, so that no pair is given up.
    """
    light = sigs.select("space", "id", "coords")
    roots = _root_coordinates(runs_needed(similarity, recall, branches, depth))
    state = light.select("space", "id", F.explode(F.array(*[F.xxhash64("space", F.lit(i), F.col("coords")[c], F.col("coords")[d]) for i, (c, d) in enumerate(roots)])).alias("path"))
    sketched = sigs.select("space", "id", "n", "s0", "s1", "s2", "s3")
    found = None
    for level in range(ROOT, depth + 1):
        state = state.repartition("path")
        sizes = state.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        state = materialize(state.join(sizes.hint("shuffle_hash"), "path"), "buckets")
        small = state.where(F.col("size") <= limit).join(sketched.hint("shuffle_hash"), ["space", "id"])
        got = _pairs(small, ["path"], similarity)
        found = got if found is None else found.unionByName(got)
        large = state.where(F.col("size") > limit)
        if large.isEmpty():
            return found.distinct()
        if level < depth:
            chosen = [F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDS)).cast("int") for j in range(branches)]
            children = F.array_distinct(F.array(*[F.xxhash64("path", c, F.get("coords", c)) for c in chosen]))
            state = large.join(light, ["space", "id"]).select("space", "id", F.explode(children).alias("path"))
    blocks = F.ceil(F.col("size") / limit).cast("int")
    own = F.pmod(F.xxhash64("id", "path"), blocks).cast("int")
    spread = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other").distinct()
    found = found.unionByName(_pairs(spread.join(sketched, ["space", "id"]), ["path", "lo", "hi"], similarity, (F.col("a.own") != F.col("b.own")) | (F.col("a.lo") == F.col("a.hi"))))
    return found.distinct()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(k)
        with np.errstate(over="ignore"):
            for df in batches:
                sets = [shingles(t) for t in df["text"]]
                yield pd.DataFrame({"space": df["space"], "id": df["id"], "fp1": np.array([s.sum() for s in sets], "uint64").view("int64"), "shingles": [s.view("int64") for s in sets]})

    return docs.select("space", "id", "text").mapInPandas(run, "space int, id long, fp1 long, shingles array<long>")


def similar_sets(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """Links between different sets, and the records of every set.

    ``docs``: ``space int, id long, text string``; only records of one space are compared. Returns ``(space, id_a,
    id_b)`` with ``id_a < id_b``, the lowest ids of two sets of ``k``-word shingles whose Jaccard similarity, counted
    exactly, is ``similarity`` or more; and ``(space, id, class_id)``, ``class_id`` being the lowest id with an equal
    set. Null ids and texts of fewer than ``k`` words are in neither; repeated rows count once, and of unequal texts
    under one id the one with the lowest fingerprint. An empty table gives empty results.
    """
    docs = docs.where(F.col("id").isNotNull() & (F.length("text") > 0))
    sigs = materialize(signatures(docs, k), "signatures")
    one = sigs.groupBy("space", "id").agg(F.min(F.struct("fp1", "fp2", "n")).alias("f")).select("space", "id", "f.*")
    reps = one.groupBy("space", "fp1", "fp2", "n").agg(F.min("id").alias("class_id"))
    members = materialize(one.join(reps, ["space", "fp1", "fp2", "n"]).select("space", "id", "class_id", "fp1", "fp2", "n"), "members")
    heads = members.where(F.col("id") == F.col("class_id")).select("space", "id", "fp1", "fp2", "n")
    # not an equi-join on the fingerprints: then the rows lie as dropDuplicates needs them, and are shuffled once
    same = heads.select("space", "id", F.col("fp1").alias("__1"), F.col("fp2").alias("__2"), F.col("n").alias("__n"))
    kept = F.col("fp1").bitwiseXOR(F.col("__1")).bitwiseOR(F.col("fp2").bitwiseXOR(F.col("__2"))).bitwiseOR(F.col("n").bitwiseXOR(F.col("__n")).cast("long")) == 0
    distinct_sets = materialize(sigs.join(same, ["space", "id"]).where(kept).select(sigs.columns).dropDuplicates(["space", "id"]), "sets")
    discard(sigs)
    maybe = materialize(candidates(distinct_sets, similarity, recall), "candidates")
    discard(distinct_sets)
    wanted = maybe.select("space", F.col("id_a").alias("id")).unionByName(maybe.select("space", F.col("id_b").alias("id"))).distinct()
    wanted = wanted.join(heads.select("space", "id", "fp1"), ["space", "id"])  # of unequal texts under one id, the one that was compared
    wanted = materialize(wanted, "wanted")
    if wanted.count() <= BROADCAST_IDS:  # then the texts need not be shuffled
        wanted = F.broadcast(wanted)
    sets = _sets(docs.join(wanted, ["space", "id"], "left_semi"), k).join(wanted, ["space", "id", "fp1"], "left_semi").dropDuplicates(["space", "id"])
    a = sets.select("space", F.col("id").alias("id_a"), F.col("shingles").alias("sa"))
    b = sets.select("space", F.col("id").alias("id_b"), F.col("shingles").alias("sb"))
    both = maybe.join(a, ["space", "id_a"]).join(b, ["space", "id_b"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = both.where(F.col("common") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("common"))).select("space", "id_a", "id_b")
    return materialize(links, "links"), members.select("space", "id", "class_id")


def expand(links: DataFrame, members: DataFrame, block: int = 1000) -> DataFrame:
    """``space, id_a, id_b`` of all similar records: links and copies of their sets.

    Copies of one set are paired with each other, in blocks of about ``block`` of them, and with the copies of linked
    sets, however many there are. ``groups`` has one row a record instead, with its class and its links.
    """
    several = members.groupBy("space", "class_id").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    blocks = F.ceil(F.col("copies") / block).cast("int")
    few = members.join(several, ["space", "class_id"]).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    few = few.select("space", "class_id", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("space", "class_id", "lo", "hi")]
    inside = few.alias("a").join(few.alias("b"), [*on, F.col("a.id") < F.col("b.id"), (F.col("a.own") != F.col("b.own")) | (F.col("a.lo") == F.col("a.hi"))]).select("a.space", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    x = members.select("space", F.col("class_id").alias("id_a"), F.col("id").alias("x"))
    y = members.select("space", F.col("class_id").alias("id_b"), F.col("id").alias("y"))
    across = links.join(x, ["space", "id_a"]).join(y, ["space", "id_b"]).select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return across.unionByName(inside)


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``space, id, group_id, n_links``: every record with the lowest id that links lead to, and its set's links.

    Each round takes the lowest label among neighbours and then the label's own label, so that chains shorten by
    half; it goes on until no label changes, which labels that only fall must reach. Labels stay in the shared folder,
    never on the driver.
    """
    both = links.select("space", F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(links.select("space", F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    labels = materialize(both.groupBy("space", "id").agg(F.least("id", F.min("other")).alias("label"), F.count("*").alias("n_links")), "labels")
    while True:
        near = both.join(labels.select("space", F.col("id").alias("other"), "label"), ["space", "other"]).groupBy("space", "id").agg(F.min("label").alias("near"))
        low = labels.join(near, ["space", "id"]).select("space", "id", "n_links", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select("space", F.col("id").alias("label"), F.col("label").alias("far"))
        new = materialize(low.join(jump, ["space", "label"], "left").select("space", "id", "n_links", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        same = new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.drop("old")
        if same:
            break
    heads = labels.select("space", F.col("id").alias("class_id"), "label", "n_links")
    return members.join(heads, ["space", "class_id"], "left").select("space", "id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
