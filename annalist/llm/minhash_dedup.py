"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i < t every shingle is
thrown into one of t bins with a value between i and i + 1; in round t + j all
go to bin j. A bin keeps its least value, and the rounds end once all bins are
filled, at 2t at the latest. Two sets agree in a bin with the probability of
their similarity, with concentration as of independent samples.

1. Equal shingle sets are collapsed by hash; one class each goes on.
2. Sketches are cut into bands. Classes that share a band are linked to the
   least of the band, without a look at their sets. Components of these links
   hold every true link, but for the chance that a pair at the threshold agrees
   in no band, which is at most ``MISS``: at 0.85, 25 bands of 5 bins.
3. Where documents share much boilerplate, chance agreements chain into large
   components. The classes of components above ``LARGE`` are sketched again
   with more bins and cut into wider bands, which far pairs hardly ever share,
   and linked anew within their component.
4. Within a component all pairs are compared on full sets, by counting shared
   shingles in a matrix product. Components beyond a block's size are split
   into blocks, and each pair of blocks is compared where its rows are sent:
   no task holds more than two blocks, none emits more than one link a class.
5. Components of the confirmed links are the result.

Defined results: null text and text without words have an empty set, are linked
with nothing and kept; with fewer words than a shingle has, all words are one
shingle; repeated rows with one id and text fall into one class. A null id is
nobody's least id: such a row is kept where none of its group has an id, else
not, and its text links like any other. ``drop_duplicates`` decides by row:
of a group one row stays, that of the least id (null last), also where rows
repeat an id, with the same text or another. An empty table gives an empty
table; other columns are ignored, whatever their names (``drop_duplicates``
keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from annalist.llm import words
from annalist.llm.graph import connected_components, spread
from annalist.llm.memory import trimmed
from annalist.llm.tokens import batches_by_bytes
from annalist.session import default_partitions, discard, materialize

BINS = 128
MISS = 1e-6
#: Bins of the second sketch, and the classes of a component beyond which it is taken.
FINE_BINS, LARGE = 512, 64
BATCH_BYTES = 1 << 21
#: A block's classes and shingles; smaller components are cut into up to ``LEAST_BLOCKS`` of at least ``LEAST_ROWS`` classes, for tasks to share.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
LEAST_BLOCKS, LEAST_ROWS = 12, 64
COLUMNS = 4096


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    hashes, at = words.word_hashes([t.translate(words.LOWER) for t in texts])
    whole, _ = words.runs(hashes, size, seed=size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(words.runs(hashes[:, a:b], b - a, seed=b - a)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, a row each; the number of bins is a power of two up to 512."""
    n = len(sets)
    out = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * bins):
        if not len(x):
            break
        h = words.mix(x ^ words.mix(np.full(1, i, np.uint64)))
        value = np.uint64(i << 54) | h >> np.uint64(10)
        place = (h & np.uint64(bins - 1)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, rows * bins + place, value)
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)[rows]
        if not open_.all():
            rows, x = rows[open_], x[open_]
    return out


def band_width(percent: int, bins: int = BINS, miss: float = MISS) -> int:
    """The widest bands that miss a pair at the threshold with at most ``miss``."""
    p = percent / 100
    return max([w for w in range(1, bins + 1) if (1 - p**w) ** (bins // w) <= miss], default=1)


def band_keys(sketch: np.ndarray, width: int) -> np.ndarray:
    bands = sketch.shape[1] // width
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), b, np.uint64)
        for i in range(b * width, (b + 1) * width):
            key = words.mix(key ^ sketch[:, i])
        out[:, b] = key
    return out


def _texts(batch, a: int, b: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").slice(a, b - a)]


def _parts(batch, bins: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about equal bytes, sketches included."""
    import pyarrow.compute as pc

    return batches_by_bytes([n + 8 * bins for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()], BATCH_BYTES)


def _classes(documents: DataFrame, size: int, width: int, bins: int = BINS) -> DataFrame:
    """id, key, cls (hash of the shingle set), n, bands of each document."""
    kind, key = (documents.schema[c].dataType.simpleString() for c in ("id", "key"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b in _parts(batch, bins):
                sets = shingle_sets(_texts(batch, a, b), size)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in some], bins), width).astype("<u8")
                bands: list = [None] * len(sets)
                for k, i in enumerate(some):
                    bands[i] = keys[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "cls", "n", "bands"],
                )

    return documents.mapInArrow(trimmed(run), f"id {kind}, key {key}, cls binary, n bigint, bands array<bigint>")


def _sets_of(documents: DataFrame, size: int) -> DataFrame:
    """cls and shingles of each document with words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b in _parts(batch, 0):
                raw = [s.astype("<u8").tobytes() for s in shingle_sets(_texts(batch, a, b), size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in raw], pa.binary()), pa.array(raw, pa.binary())], names=["cls", "shingles"]
                )

    return documents.mapInArrow(trimmed(run), "cls binary, shingles binary")


def linked(sets: list[np.ndarray], numerator: int, denominator: int = 100, halves: np.ndarray | None = None) -> list[int]:
    """For each set the least position it reaches by links: denominator * shared >= numerator * union.

    With ``halves`` only pairs across the two halves are looked at.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        shared = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        every, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(n), sizes)
        keep = times[code] > 1
        # shingles of one set only are in no intersection
        number = np.cumsum(times > 1) - 1
        rows, code = rows[keep], number[code[keep]]
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        shared = np.zeros((n, n), np.float32)
        width = int(code[-1]) + 1 if len(code) else 0
        for a in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(code, [a, a + COLUMNS])
            block = np.zeros((n, min(COLUMNS, width - a)), np.float32)
            block[rows[lo:hi], code[lo:hi] - a] = 1
            shared += block @ block.T
        shared = np.rint(shared).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    hit = np.triu(denominator * shared >= numerator * union, 1)
    if halves is not None:
        hit &= halves[:, None] != halves[None, :]
    for i, j in zip(*np.nonzero(hit)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _confirmed(groups: DataFrame, numerator: int) -> DataFrame:
    """Links of each class to the least class it reaches within a task's group. ``groups`` arrives ordered by task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[bytes, bytes, int]] = []
        current = None

        def links() -> tuple[list[bytes], list[bytes]]:
            if len(held) < 2:
                return [], []
            held.sort()
            sets = [np.frombuffer(s, "<u8") for _, s, _ in held]
            halves = np.array([h for *_, h in held])
            at = linked(sets, numerator, halves=halves if halves.any() else None)
            return [held[i][0] for i, r in enumerate(at) if r != i], [held[r][0] for i, r in enumerate(at) if r != i]

        us: list[bytes] = []
        vs: list[bytes] = []
        for batch in batches:
            for task, cls, shingles, half in zip(*(batch.column(c).to_pylist() for c in ("task", "cls", "shingles", "half")), strict=True):
                if task != current:
                    u, v = links()
                    us += u
                    vs += v
                    held, current = [], task
                held.append((cls, shingles, half))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
                us, vs = [], []
        u, v = links()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return groups.mapInArrow(trimmed(run), "u binary, v binary")


def _linked_by_band(banded: DataFrame, name: str) -> DataFrame:
    """``node, component`` of the classes (``cls``) that share a ``band``: all of a band are linked to its least."""
    # a band that many classes share is one key: its least class is combined before the shuffle, and the join with it is split
    shared = banded.groupBy("band").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most").drop("most")
    rows = spread(banded, shared, "band").where("cls <> least")
    return connected_components(rows.select(F.col("cls").alias("u"), F.col("least").alias("v")), name)


def _grouped(slim: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of ``id, key, text``, where the key tells rows apart: each row's key, class and set size, and each class's group."""
    spark = slim.sparkSession
    marked = materialize(_classes(slim, shingle, band_width(percent)), "classes")
    classes = marked.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "distinct")
    coarse = materialize(_linked_by_band(classes.select("cls", F.explode("bands").alias("band")), "coarse"), "components").withColumnRenamed("node", "cls")
    plain = classes.select("cls", "key", "n")

    def texts_of(members: DataFrame) -> DataFrame:
        """Of each class one text at least; on large inputs Spark filters the texts by a Bloom filter of the keys before it shuffles them."""
        return slim.join(members.select("key"), "key", "left_semi")

    # the second sketch, of large components
    sizes = coarse.groupBy("component").agg(F.count("*").alias("classes")).where(F.col("classes") > LARGE)
    large = materialize(spread(coarse, sizes, "component").select("cls", "component").join(plain, "cls"), "large")
    together = coarse
    if not large.isEmpty():
        fine = _classes(texts_of(large), shingle, band_width(percent, FINE_BINS), FINE_BINS).where("cls is not null")
        fine = fine.groupBy("cls").agg(F.first("bands").alias("bands")).join(large.select("cls", "component"), "cls")
        # bands of one component only; that these keys could collide does no harm, as all links are confirmed
        fine = materialize(fine.select("cls", F.explode(F.transform("bands", lambda x: F.xxhash64("component", x))).alias("band")), "fine-bands")
        together = coarse.join(large.select("cls"), "cls", "left_anti").unionByName(_linked_by_band(fine, "fine").withColumnRenamed("node", "cls"))
    members = materialize(together.join(plain, "cls"), "together")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.least(F.ceil(F.count("*") / LEAST_ROWS), F.lit(LEAST_BLOCKS))).cast("int").alias("blocks")
    )
    members = materialize(spread(members, sizes, "component").select("cls", "key", "component", "blocks"), "members")
    sets = _sets_of(texts_of(members).select("text"), shingle).dropDuplicates(["cls"]).join(members.select("cls", "component", "blocks"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = sets.withColumn("block", block).withColumn("other", other).select(
        F.concat_ws(":", F.hex("component"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")).alias("task"),
        "cls",
        "shingles",
        # within one block all pairs count; between two blocks only those across, marked 1 and 2
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("half"),
    )
    parts = max(default_partitions(spark), 1)
    links = _confirmed(placed.repartition(parts, "task").sortWithinPartitions("task"), percent)
    final = connected_components(links, "links").withColumnRenamed("node", "cls")
    groups = materialize(classes.select("cls", "id").join(final, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "groups")
    discard(classes, coarse, large, members)
    return marked, groups


def near_duplicates(documents: DataFrame, percent: int = 85, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable) and kept of each document.

    Linked are documents whose similarity is at least ``percent`` hundredths.
    """
    text = F.col(f"`{text_column}`")
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{id_column}`"), text).alias("key"), text.alias("text"))
    marked, groups = _grouped(slim, percent, shingle)
    least = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = materialize(spread(groups.select("cls", "component"), least, "component").select("cls", "component_id"), "named")
    discard(groups)
    return marked.join(by_class, "cls", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def drop_duplicates(documents: DataFrame, percent: int = 80, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, one row of each group; columns as they came."""
    names = documents.columns
    # rows are told apart by all their columns; those that agree in all of them are interchangeable
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if not isinstance(f.dataType, MapType)]
    key = F.concat_ws(":", *[F.hex(F.xxhash64(F.lit(seed), *hashed)) for seed in (1, 2)])
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), key.alias("key"), F.col(f"`{text_column}`").alias("text"))
    marked, groups = _grouped(slim, percent, shingle)
    order = F.struct(F.col("id").isNull(), "id", "key")
    firsts = marked.where("cls is not null").groupBy("cls").agg(F.min(order).alias("own"))
    firsts = materialize(groups.select("cls", "component").join(firsts, "cls"), "firsts")
    stays = firsts.groupBy("component").agg(F.min("own").alias("first"))
    stays = materialize(spread(firsts, stays, "component").select("cls", F.col("first.key").alias("stays")), "stays")
    rows = materialize(marked.where("cls is not null").join(stays, "cls").groupBy("key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "rows")
    discard(marked, groups, firsts, stays)
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"))
    left = keyed.join(rows.where("key <> stays").select("key"), "key", "left_anti")
    twice = rows.where("key = stays and n > 1").select("key")
    if not twice.isEmpty():
        left = left.join(twice, "key", "left_anti").unionByName(left.join(twice, "key", "left_semi").dropDuplicates(["key"]).select("row", "key"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op7(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return near_duplicates(table(spark, sf_dir, "documents"))
