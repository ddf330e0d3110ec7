"""Mixing sources to target weights by systematic sampling.

Documents of a source are put in a fixed order, the expected copies of each
are summed up along it, one random offset is added, and a document is emitted
once for every integer that its step of the sum crosses. All built-in
functions; nothing here runs in Python.

Copies are whole, so a few documents that hold much of a source's words can
miss its target by their own size whatever the offset. Documents are therefore
drawn by falling size, in bands of about one size, and those of a band expect
what is left of the target over the words that are left. What a band takes in
fact is taken off before the next, so the small ones at the end make up for
the large ones, wherever none to ``cap`` copies of each can.

Defined results: a null text counts as empty (size 0); a null source is a
source of its own, last in order; a source without words has target 0 and is
not taken; repeated rows are sampled each on its own; an empty table gives an
empty table. Columns of the input are kept as they are, whatever their names:
while the operator works they are one struct, and a result column whose name
the input has already gets a number (``names.free_name``).
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.names import free_name
from annalist.session import default_partitions, materialize

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 2026


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(seed: int) -> float:
    """The one random offset, in steps of 2**-20 so that sums with integers are exact."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def source_key(source: Column) -> Column:
    """A source's name such that null is a name, and the last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _sums_before(rows: DataFrame, order: Sequence[str], sums: dict[str, str], name: str) -> DataFrame:
    """For each row the sums over all rows before it in the order, in two levels, so that no task orders all rows.

    Rows are dealt to ranges of the order and written with the number of their
    range; sums run inside a range, and over the ranges' totals, of which
    there are as many as partitions.
    """
    dealt = rows.repartitionByRange(max(1, default_partitions(rows.sparkSession)), *order).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, name)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(c) for c in sums.values()])
    totals = totals.select("range", *[before(Window.orderBy("range"), c).alias(f"base_{out}") for out, c in sums.items()])
    inside = Window.partitionBy("range").orderBy(*order)
    return dealt.join(totals, "range").select(*rows.columns, *[(F.col(f"base_{out}") + before(inside, c)).alias(out) for out, c in sums.items()])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Targets of sources by water-filling: ``key, source_size`` to these and ``target``.

    Sources in name order weigh ``weights``, repeating. A target is its weight
    times a level, or ``cap`` times its source's size where that is less, and
    the level is such that targets add up to ``share`` of all sizes. With the
    sources by the level at which they reach their cap, let the first few be
    capped: what these leave, over the weights of the rest, is a level that
    rises while the next would still be capped and falls after, so the level
    looked for is the highest.
    """
    ranked = _sums_before(sizes.withColumn("one", F.lit(1)), ["key"], {"rank": "one"}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    weighed = weighed.withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    summed = _sums_before(weighed, ["ratio", "key"], {"capped": "most", "weights": "weight"}, "mix-levels")
    whole = weighed.agg((F.lit(float(share)) * F.sum("source_size")).alias("share"), F.sum("weight").alias("all_weights"))
    level = summed.crossJoin(F.broadcast(whole)).agg(F.max((F.col("share") - F.col("capped")) / (F.col("all_weights") - F.col("weights"))).alias("level"))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return weighed.crossJoin(F.broadcast(level)).select("key", "source_size", target.alias("target"))


def _band(size: str) -> str:
    """Sizes to the nearest 64th below, as an integer that rises with the size: at most 64 per doubling."""
    return f"if({size} < 64, {size}, (length(bin({size})) - 1) * 64 + shiftright({size}, length(bin({size})) - 7) - 384 + 0L)"


def _rates(bands: DataFrame, targets: DataFrame, offset: float, cap: int) -> DataFrame:
    """``key, band, rate, sum``: copies that documents of a band expect, and the sum of those expected before it.

    One fold over the bands of a source, by falling size; there are at most 64
    for each doubling of the size, however many documents.
    """
    steps = bands.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("band")).alias("falling"), "n", "words"))).alias("bands")).join(targets, "key")
    out = "array<struct<band:bigint,rate:double,sum:double>>"
    start = F.struct(
        F.col("target").alias("left"), F.col("source_size").cast("double").alias("words"), F.lit(0.0).alias("sum"), F.array().cast(out).alias("out")
    )

    def step(done: Column, b: Column) -> Column:
        rate = F.when(done["words"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), done["left"] / done["words"]))).otherwise(F.lit(0.0))
        copies = _crossed(offset, done["sum"], rate, b["n"]) - _crossed(offset, done["sum"], rate, F.lit(0))
        return F.struct(
            (done["left"] - copies * b["words"] / b["n"]).alias("left"),
            (done["words"] - b["words"]).alias("words"),
            (done["sum"] + rate * b["n"]).alias("sum"),
            F.concat(done["out"], F.array(F.struct((-b["falling"]).alias("band"), rate.alias("rate"), done["sum"].alias("sum")))).alias("out"),
        )

    return steps.select("key", "source_size", "target", F.inline(F.aggregate("bands", start, step, lambda done: done["out"])))


def _crossed(offset: float, sum_: Column, rate: Column, place: Column) -> Column:
    """Integers that the prefix sum has crossed after so many documents of a band."""
    return F.floor(F.lit(offset) + (sum_ + rate * place))


def _drawn(documents: DataFrame, size: Column, seed: int, id_column: str, source_column: str, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``row`` (the input's columns), ``size, source_size, target, copies``.

    The order within a source is by falling size band, then by a hash of the
    id. A document's place in its band is found in three steps, each of which
    counts what comes before within the step above: 256 hash ranges of the
    band, 256 parts of the range, rows of the part. The counts are combined
    before they are shuffled, so one source with a third of all rows is spread
    over the cluster. Each row is shuffled once.
    """

    def keyed(frame: DataFrame) -> DataFrame:
        digest = F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit(""))
        frame = frame.withColumn("band", F.expr(_band("size"))).withColumn("hash", digest)
        return frame.withColumn("h1", F.substring("hash", 1, 2)).withColumn("h2", F.substring("hash", 1, 4))

    part = ["key", "band", "h1", "h2"]
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = keyed(documents.select(row, size.alias("size"), source_key(F.col(f"`{source_column}`")).alias("key"), F.col(f"`{id_column}`").alias("id")))
    # all steps start from these counts: written once, they read the texts once
    counts = materialize(rows.groupBy(*part).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")

    def before(*within: str, by: str) -> Column:
        w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    bands = counts.groupBy("key", "band").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(bands.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    offset = offset_of(seed)
    rates = materialize(_rates(bands, targets, offset, cap), "mix-rates")
    ranges = counts.groupBy(*part[:3]).agg(F.sum("n").alias("n")).select(*part[:3], before(*part[:2], by="h1").alias("b1"))
    parts = counts.select(*part, before(*part[:3], by="h2").alias("b2"))
    place = F.col("b1") + F.col("b2") + F.row_number().over(Window.partitionBy(*part).orderBy("hash", "id", "size"))
    rows = rows.join(parts.join(ranges, part[:3]).join(rates, part[:2]), part).withColumn("place", place)
    crossed = [_crossed(offset, F.col("sum"), F.col("rate"), F.col("place") - back) for back in (0, 1)]
    return rows.select("row", "size", "source_size", "target", F.least(crossed[0] - crossed[1], F.lit(cap).cast("long")).alias("copies"))


def with_copies(
    documents: DataFrame,
    size: Column,
    seed: int = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """The documents with ``mix_size, mix_source_size, mix_target, mix_copies``."""
    drawn = _drawn(documents, size, seed, id_column, source_column, weights, share, cap)
    return drawn.select(
        *[F.col(f"row.`{c}`").alias(c) for c in documents.columns],
        *[F.col(c).alias(free_name(f"mix_{c}", documents.columns)) for c in ("size", "source_size", "target", "copies")],
    )


def mix(
    documents: DataFrame, seed: int = SEED, text_column: str = "text", id_column: str = "doc_id", source_column: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """The mixed corpus: each document as often as it is drawn, with the columns of the input."""
    drawn = _drawn(documents, word_count(F.col(f"`{text_column}`")), seed, id_column, source_column, weights, share, cap).where("copies > 0")
    drawn = drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    # written once: texts are read here and nowhere after
    slim = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(slim, F.col("size")).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("size")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('0' || source, '1') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM d GROUP BY k),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM s),
c AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
l AS (SELECT max(level) AS level FROM c),
t AS (SELECT k, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT level FROM l)) AS target FROM r),
b AS (SELECT doc_id, k, size, CASE WHEN size < 64 THEN size ELSE (length(bin(size)) - 1) * 64 + (size >> CAST(length(bin(size)) - 7 AS INT)) - 384 END AS band FROM d),
g AS (SELECT k, band, CAST(count(*) AS DOUBLE) AS n, CAST(sum(size) AS DOUBLE) AS words, row_number() OVER (PARTITION BY k ORDER BY band DESC) AS i FROM b GROUP BY k, band),
o AS (SELECT {offset_of(SEED)!r}::DOUBLE AS o),
f(k, i, remains, words, done, rate, before) AS (
  SELECT k, CAST(0 AS BIGINT), target, CAST(source_size AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t
  UNION ALL SELECT k, i, remains - (floor(o + (done + rate * n)) - floor(o + (done + rate * 0))) * own / n, words - own, done + rate * n, rate, done FROM (
    SELECT f.k, g.i, remains, f.words, done, g.n, g.words AS own, CASE WHEN f.words > 0 THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, remains / f.words)) ELSE 0.0::DOUBLE END AS rate
    FROM f JOIN g ON g.k = f.k AND g.i = f.i + 1), o),
p AS (SELECT doc_id, size, k, band, row_number() OVER (PARTITION BY k, band ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id, size) AS place FROM b),
y AS (SELECT doc_id, size, source_size, target, CAST(least(floor(o + (before + rate * place)) - floor(o + (before + rate * (place - 1))), 2) AS BIGINT) AS copies
  FROM p JOIN g USING (k, band) JOIN f ON f.k = p.k AND f.i = g.i JOIN t ON t.k = p.k CROSS JOIN o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM y
"""
