"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Vectors of unit length are projected on many random directions, and each
projection is sorted. A query's window in a projection is then one stretch of
the sorted order; a pair collides there when the other's value lies in the
query's window, and the pair's collisions are counted over all projections.
Window and least count are calibrated so that a pair at the threshold falls
short of the count with a probability of at most ``MISS``. Pairs that reach it
are verified by cosine in double precision.

Equal vectors are collapsed first. The rest is cut into blocks, each pair of
blocks meets in one task, and a task gives back counts and a spanning forest,
never pairs. One window holds more than half of all vectors at a cosine of 0.9
in 64 dimensions, so listing the pairs of every window would touch each pair
some thirty times. A window is taken as a set of bits instead, as the sorted
order's prefix up to its end without the prefix up to its begin, and sets are
added up 64 pairs at a time in bit-sliced counters; the counts are the same.
The work grows with the square of the number of distinct vectors: that is the
method's, as no single projection tells near from far (README has figures).

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing and are kept; so do vectors of different lengths
with each other; repeated rows count as vectors of their own, and rows with a
null id are never the least of a component unless all are null; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.graph import connected_components, spread
from annalist.llm.memory import trimmed
from annalist.session import default_partitions, discard, materialize

PROJECTIONS, SEED = 48, 11
COSINE = 0.9
MISS = 1e-7
#: Rows of a block; few vectors are cut into more blocks than that, as long as these hold some rows, for the tasks to share.
BLOCK, LEAST_ROWS, LEAST_BLOCKS = 8192, 512, 8
TILE = 256
#: A projection of unit vectors is kept in this many cells, over four deviations to each side; what lies beyond
#: counts to the last ones, which only brings pairs nearer.
CELLS = 128
#: Cosines nearer to the threshold than this are summed again without rounding, so that they do not depend on the tile.
NARROW = 1e-12


def within(ratio: float, dimension: int) -> float:
    """Probability that a random direction sees at most this share of a vector's length."""
    if dimension == 1 or ratio >= 1:
        return 1.0 if ratio >= 1 else 0.0
    angle = (np.arange(20000) + 0.5) / 20000 * math.pi
    density = np.sin(angle) ** (dimension - 2)
    return float(density[np.abs(np.cos(angle)) <= ratio].sum() / density.sum())


def calibrated(dimension: int, cosine: float = COSINE, projections: int = PROJECTIONS, miss: float = MISS) -> tuple[int, int]:
    """(half window in cells, least count): of the least counts that miss a pair at the threshold
    with at most ``miss``, for windows of a few deviations of its difference, the one that lets
    the fewest orthogonal pairs pass."""
    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    best = (2.0, CELLS, 0)
    for tenth in range(6, 45):
        w = near / math.sqrt(dimension) * tenth / 10
        # values in cells may differ by one cell more, and rounding by another
        half = math.ceil(w * math.sqrt(dimension) * CELLS / 8) + 1
        hit, chance = within(w / near if near else 1.0, dimension), within(half * 8 / CELLS / math.sqrt(dimension) / far, dimension)
        below, least = 0.0, 0
        for k in range(projections + 1):
            below += math.comb(projections, k) * hit**k * (1 - hit) ** (projections - k)
            if below > miss:
                least = k
                break
        passed = 1 - sum(math.comb(projections, k) * chance**k * (1 - chance) ** (projections - k) for k in range(least))
        best = min(best, (passed, half, least))
    return best[1], best[2]


def directions(dimension: int, projections: int = PROJECTIONS) -> np.ndarray:
    a = np.random.default_rng(SEED).standard_normal((projections, dimension))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _prefixes(cells: np.ndarray) -> np.ndarray:
    """For each projection and cell the set, in bits, of the vectors sorted before that cell: (projections, CELLS + 1, words)."""
    n = cells.shape[1]
    words = -(-n // 64)
    out = np.zeros((len(cells), CELLS + 1, words * 8), np.uint8)
    for own, bits in zip(cells, out):
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(CELLS + 1), "left")
        member = np.zeros(words * 64, np.uint8)
        for k in range(1, CELLS + 1):
            member[order[ends[k - 1] : ends[k]]] = 1
            bits[k] = np.packbits(member, bitorder="little")
    return out.view(np.uint64)


def _added(sets: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Binary counters, lowest bit first, of how many sets hold each member, by full adders on whole sets."""
    levels: list[list[np.ndarray]] = [list(sets)] + [[] for _ in range(bits)]
    out = []
    for k in range(bits):
        own = levels[k]
        while len(own) > 1:
            a, b = own.pop(), own.pop()
            c = own.pop() if own else None
            half = a ^ b
            carry = a & b
            if c is not None:
                carry |= half & c
                half ^= c
            own.insert(0, half)
            levels[k + 1].append(carry)
        out.append(own[0] if own else np.zeros_like(sets[0]))
    return out


def _at_least(counters: list[np.ndarray], least: int) -> np.ndarray:
    """The set of the members that are counted ``least`` times or more."""
    out = np.full_like(counters[0], np.iinfo(np.uint64).max)
    for i, bit in enumerate(counters):
        if least >> i & 1:
            out &= bit
        else:
            out |= bit
    return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors from sums without rounding."""
    a, b = a.tolist(), b.tolist()
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))


def links(vectors: np.ndarray, weights: np.ndarray, halves: np.ndarray, cosine: float = COSINE, miss: float = MISS) -> tuple[np.ndarray, list[int]]:
    """Weight of the vectors that each links with, and the least position that it reaches by links.

    ``halves``: all 0 to compare all pairs, or 1 and 2 to compare across.
    """
    raw = vectors.astype(np.float64)
    # very large or small components would overflow when squared
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    n, dimension = x.shape
    half, least = calibrated(dimension, cosine, miss=miss)
    cells = np.floor(directions(dimension) @ x.T * (math.sqrt(dimension) * CELLS / 8) + CELLS // 2)
    cells = np.clip(cells, 0, CELLS - 1).astype(np.int64)
    across = bool(halves.any())
    left = np.flatnonzero(halves == 1) if across else np.arange(n)
    right = np.flatnonzero(halves == 2) if across else left
    linked, parent = np.zeros(n, np.int64), np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if not len(left) or not len(right):
        return linked, parent.tolist()
    prefixes, bits = _prefixes(cells[:, right]), len(cells).bit_length()
    for a in range(0, len(left), TILE):
        own = left[a : a + TILE]
        first = 0 if across else a // 64
        sets = []
        for mine, prefix in zip(cells[:, own], prefixes):
            # the prefix at a window's end holds the one at its begin
            sets.append(prefix[np.minimum(mine + half, CELLS - 1) + 1, first:] ^ prefix[np.maximum(mine - half, 0), first:])
        found = _at_least(_added(sets, bits), least)
        i, word = np.nonzero(found)
        if not len(i):
            continue
        at, j = np.nonzero(np.unpackbits(found[i, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = own[i[at]], (first + word[at]) * 64 + j
        inside = j < len(right)
        i, j = i[inside], right[j[inside]]
        if not across:
            i, j = i[i < j], j[i < j]
        dense = x[own] @ x[right].T if len(i) > len(own) * len(right) // 16 else None
        place = np.zeros(0, np.int64)
        if dense is not None:
            place = np.zeros(n, np.int64)
            place[right] = np.arange(len(right))
        for b in range(0, len(i), 1 << 15):
            p, q = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
            seen = np.einsum("ij,ij->i", x[p], x[q]) if dense is None else dense[np.searchsorted(own, p), place[q]]
            for k in np.flatnonzero(np.abs(seen - cosine) < NARROW).tolist():
                seen[k] = exact_cosine(raw[p[k]], raw[q[k]])
            hit = seen >= cosine
            p, q = p[hit], q[hit]
            linked += np.bincount(p, weights[q], n).astype(np.int64) + np.bincount(q, weights[p], n).astype(np.int64) if len(p) else 0
            # only pairs that join two trees are walked one by one
            while len(p):
                while (parent[parent] != parent).any():
                    parent[:] = parent[parent]
                u, v = parent[p], parent[q]
                apart = u != v
                p, q, u, v = p[apart], q[apart], u[apart], v[apart]
                for s, t in zip(u[:4096].tolist(), v[:4096].tolist()):
                    s, t = root(s), root(t)
                    parent[max(s, t)] = min(s, t)
                p, q = p[4096:], q[4096:]
    return linked, [root(i) for i in range(n)]


def _classed(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, embedding and cls (a hash of the components) of each row; no class for vectors that link with nothing."""
    held = embeddings.schema[vector_column].dataType.simpleString()
    vector = held if held == "array<float>" else "array<double>"
    slim = embeddings.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast(vector).alias("embedding"))
    shape = f"id {slim.schema['id'].dataType.simpleString()}, embedding {vector}, cls binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            # nulls among the components become NaN
            flat, offsets = column.values.to_numpy(zero_copy_only=False) + np.float32(0), column.offsets.to_numpy()
            classes = []
            for known, a, b in zip(column.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = flat[a:b]
                good = known and b > a and np.isfinite(own).all() and own.any()
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(classes, pa.binary())], names=["id", "embedding", "cls"])

    return slim.mapInArrow(trimmed(run), shape)


def _linked(placed: DataFrame, cosine: float) -> DataFrame:
    """Per task and class: weight linked, and the least class reached."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        current = None

        def finish():
            names = [c for c, *_ in held]
            linked, at = links(np.array([v for _, v, _, _ in held]), np.array([w for _, _, w, _ in held]), np.array([h for *_, h in held]), cosine)
            some = np.flatnonzero(linked).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in some], pa.binary()), pa.array(linked[some], pa.int64()), pa.array([names[at[i]] for i in some], pa.binary())],
                names=["cls", "links", "least"],
            )

        for batch in batches:
            vectors = batch.column("embedding")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for k, (task, cls, weight, half) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "cls", "weight", "half")), strict=True)):
                if task != current and held:
                    yield finish()
                    held = []
                current = task
                held.append((cls, flat[offsets[k] : offsets[k + 1]], weight, half))
        if held:
            yield finish()

    return placed.mapInArrow(trimmed(run), "cls binary, links bigint, least binary")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of each vector."""
    spark = embeddings.sparkSession
    rows = materialize(_classed(embeddings, id_column, vector_column), "rows")
    vectors = materialize(
        rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "vectors"
    )
    classes = vectors.withColumn("dimension", F.size("embedding"))
    # one row for each length of vectors
    sizes = classes.groupBy("dimension").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.ceil(F.count("*") / LEAST_ROWS), F.lit(LEAST_BLOCKS))).cast("int").alias("blocks")
    )
    placed = (
        spread(classes, sizes, "dimension")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.concat_ws(":", F.col("dimension").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")).alias("task"),
            "cls",
            "embedding",
            "weight",
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("half"),
        )
    )
    found = materialize(_linked(placed.repartition(max(1, default_partitions(spark)), "task").sortWithinPartitions("task"), cosine), "found")
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    final = connected_components(found.select(F.col("cls").alias("u"), F.col("least").alias("v")), "links").withColumnRenamed("node", "cls")
    least = materialize(final.join(classes.select("cls", "id"), "cls"), "least")
    named = spread(least.select("cls", "component"), least.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("cls", "component_id")
    by_class = materialize(
        classes.select("cls", F.col("id").alias("own"), "weight")
        .join(totals, "cls", "left")
        .join(named, "cls", "left")
        .select("cls", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id")),
        "named",
    )
    discard(vectors, found, least)
    return spread(rows.select("id", "cls"), by_class, "cls", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
