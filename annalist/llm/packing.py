"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token streams. A window takes from each queue its
target share of the window's tokens; what a source is owed beyond whole tokens
is its deficit, carried to the next window. The deficit after k windows is a
function of k and the queues' sizes alone: with rates w and a clock t(k) at
which all queues together have given k windows,

    given(s, k) = min(size(s), floor(w(s) * t(k) + 1/2))

so any task knows the state of the round-robin at any window and no state goes
from task to task.

By default every window mirrors the corpus and all queues end together. Then
the queues, laid end to end, are dealt to the windows one token each in turn:
``Mirror`` knows a queue's state at any window, and its place in the window,
from where the queue begins and its size. With other target weights a queue
that runs dry leaves its share to the others from that window on. Queues of
one rate and size are then a class that deals its tokens to its members in
turn, and the round-robin runs over classes. These are at most the named
sources and, as their distinct sizes sum up to no more than all tokens, the
root of twice the tokens.

The windows, one after another, are the packed stream, and sequences are cut
from it every ``SEQUENCE`` tokens, so they are full. The rest at the end
becomes sequences of powers of two tokens, which need no padding.

Steps: (1) documents are encoded once in Arrow batches; each task writes ids
with a running token count per source to the shared folder. (2) The counts per
task and source, one row each, are summed up to where each task's part of a
queue begins, and joined with where the queue stands among the others. (3) A
narrow Arrow pass cuts the documents. Every source is a queue of its own,
however many there are; documents are never sorted or grouped by source, so a
hot one costs no more.

Defined results: null text counts as empty and gives one piece, the end token;
repeated rows are packed each; a null source is a queue of its own; an empty
table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import tokens
from annalist.llm.memory import trimmed
from annalist.llm.mixing import source_key
from annalist.session import materialize

SEQUENCE = 4096
#: Tokens to a window. Targets hold in each, so in each sequence; a document is cut where its source's share of a window ends.
WINDOW = SEQUENCE
END_ID = 2
#: Sources are numbered and summed up in this many buckets by hash, so that no task orders all of them.
MOST_QUEUES = 1024
STATE_BYTES = 32 << 20
BATCH_BYTES = 1 << 20
_ENCODERS: dict[str, tokens.WordEncoder] = {}

ENCODED = "id {kind}, part int, queue string, at bigint, n bigint, ids binary"
PIECES = "id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def encoded(documents: DataFrame, vocabulary: str, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(1) One row per document: its ids, and the tokens that the same queue has before it in the same task."""
    slim = documents.select(
        F.col(f"`{id_column}`").alias("id"), source_key(F.col(f"`{source_column}`")).alias("queue"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder = _ENCODERS.get(vocabulary)
        if encoder is None:
            encoder = _ENCODERS[vocabulary] = tokens.WordEncoder(vocabulary)
        width = 4 if encoder.wide else 2
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column("queue").to_pylist()
            for a, b in tokens.batches_by_bytes(pc.binary_length(batch.column("text")).to_pylist(), BATCH_BYTES):
                ids = encoder.encode(batch.column("text").slice(a, b - a).to_pylist())
                ids = [x + END_ID.to_bytes(width, "little") for x in ids]
                at = []
                for q, x in zip(queues[a:b], ids, strict=True):
                    at.append(before.get(q, 0))
                    before[q] = at[-1] + len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array([part] * (b - a), pa.int32()),
                        batch.column("queue").slice(a, b - a),
                        pa.array(at, pa.int64()),
                        pa.array([len(x) // width for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["id", "part", "queue", "at", "n", "ids"],
                )

    return slim.mapInArrow(trimmed(run), ENCODED.format(kind=kind))


class Mirror:
    """The round-robin at rates equal to sizes, from a queue's begin among all tokens and its size alone.

    The last window, where it is short, takes of each queue its share in whole
    tokens, by prefix sums. The others are full: token number x of the rest,
    counted queue after queue, goes to window x mod ``full``.
    """

    def __init__(self, total: int, window: int = WINDOW):
        self.total, self.window = total, window
        self.full, self.rest = divmod(total, window)

    def stretches(self, first: int, size: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(begin within the stretch, length, place in the packed stream) of tokens at to at + n of a queue."""
        full, end = self.full, at + n
        tail = first * self.rest // self.total
        a = first - tail
        b = first + size - (first + size) * self.rest // self.total
        if full:
            (qa, ra), (qb, rb) = divmod(a, full), divmod(b, full)
        done, k = at, -1
        while done < min(end, b - a):
            k = k + 1 if k >= 0 else done * full // (b - a)
            begin = (qb - qa) * k + min(rb, k) - min(ra, k)
            if not begin <= done < begin + qb - qa + (rb > k) - (ra > k):
                low, high = 0, full - 1
                while low < high:
                    mid = (low + high) // 2
                    if (qb - qa) * (mid + 1) + min(rb, mid + 1) - min(ra, mid + 1) > done:
                        high = mid
                    else:
                        low = mid + 1
                k = low
                begin = (qb - qa) * k + min(rb, k) - min(ra, k)
            stop = min(end, begin + qb - qa + (rb > k) - (ra > k))
            yield done - at, stop - done, k * self.window + qa + (ra > k) + done - begin
            done = stop
        if done < end:
            yield done - at, end - done, full * self.window + tail + done - (b - a)


class RoundRobin:
    """The state of the deficit round-robin at any window, and where any stretch of a queue goes."""

    def __init__(self, sizes: list[int], rates: list[float] | None = None, window: int = WINDOW):
        self.sizes = np.array(sizes, dtype=np.float64)
        self.rates = np.array([float(r) for r in (rates or sizes)], dtype=np.float64)
        self.total, self.window = int(sum(sizes)), window
        self.windows = -(-self.total // window)
        ends = np.divide(self.sizes, self.rates, out=np.zeros_like(self.sizes), where=self.rates > 0)
        #: Clock at which a queue runs dry, in order, and tokens that all have given by then.
        self.clock = np.unique(np.append(ends, 0.0))
        order = np.argsort(ends, kind="stable")
        sized = np.append(0.0, np.cumsum(np.where(self.rates > 0, self.sizes, 0.0)[order]))
        rated = np.append(0.0, np.cumsum(self.rates[order]))
        dry = np.searchsorted(ends[order], self.clock, side="right")
        self.by_clock = np.maximum.accumulate(sized[dry] + (rated[-1] - rated[dry]) * self.clock)

    def given(self, k: int) -> np.ndarray:
        """Tokens each queue has given after k windows."""
        if k >= self.windows:
            return self.sizes.astype(np.int64)
        clock = np.interp(float(k) * self.window, self.by_clock, self.clock)
        return np.minimum(self.sizes, np.floor(self.rates * clock + 0.5)).astype(np.int64)

    def window_of(self, queue: int, at: int) -> int:
        """The window that takes a queue's token number ``at``."""
        rate = self.rates[queue]
        k = int(np.interp((at + 0.5) / rate, self.clock, self.by_clock) // self.window) if rate > 0 else self.windows - 1
        k = max(0, min(k, self.windows - 1))
        while k > 0 and self.state(k)[0][queue] > at:
            k -= 1
        while self.state(k + 1)[0][queue] <= at:
            k += 1
        return k

    _states: dict

    def state(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(given by each queue before window k, places in the packed stream where they go on in it)."""
        if not hasattr(self, "_states") or len(self._states) > max(2, min(4096, STATE_BYTES // (16 * len(self.sizes)))):
            self._states = {}
        if k not in self._states:
            a = self.given(k)
            took = self.given(k + 1) - a
            self._states[k] = (a, a.sum() + np.cumsum(took) - took)
        return self._states[k]

    def stretches(self, queue: int, at: int, n: int, member: int = 0, members: int = 1) -> Iterator[tuple[int, int, int]]:
        """(begin within the stretch, length, place in the packed stream) of tokens at to at + n of a queue, or of one of the members it deals to."""
        done, k = 0, -1
        while done < n:
            k += 1
            if k == 0 or int(self.state(k + 1)[0][queue]) <= (at + done) * members + member:
                k = self.window_of(queue, (at + done) * members + member)
            (qa, ra), (qb, rb) = divmod(int(self.state(k)[0][queue]), members), divmod(int(self.state(k + 1)[0][queue]), members)
            begin = qa + (ra > member)
            take = min(n - done, qb + (rb > member) - (at + done))
            before = member * (qb - qa) + min(rb, member) - min(ra, member)
            yield done, take, int(self.state(k)[1][queue]) + before + at + done - begin
            done += take


def sequence_cuts(total: int, sequence: int = SEQUENCE) -> tuple[int, list[int]]:
    """Tokens in full sequences, and where the sequences of the rest begin: its powers of two, largest first."""
    full = total - total % sequence
    begins, at, rest = [], full, total - full
    for bit in range(sequence.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            begins.append(at)
            at += 1 << bit
    return full, begins


def standing(shares: DataFrame, targets: Mapping[str | None, float] | None) -> DataFrame:
    """One row per queue: its size, its rate where targets are given, and where it stands.

    That is the tokens of the queues before it, or with targets the number of
    the queue among those of the same rate and size.
    """
    spark = shares.sparkSession
    queues = shares.groupBy("queue").agg(F.sum("n").alias("size")).withColumn("bucket", F.crc32(F.col("queue").cast("binary")) % MOST_QUEUES)
    if targets is None:
        queues, same, step = queues.withColumn("rate", F.lit(None).cast("double")), [], F.col("size")
    else:
        named = [("1" if s is None else "0" + s, float(w)) for s, w in targets.items()]
        rates = spark.createDataFrame(named, "queue string, rate double")
        queues = queues.join(rates, "queue", "left").withColumn("rate", F.coalesce("rate", F.lit(min(w for _, w in named))))
        same, step = ["rate", "size"], F.lit(1).cast("bigint")
    queues = materialize(queues, "queues")
    before = lambda keys, order: F.coalesce(F.sum("step").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queues = queues.withColumn("step", step).withColumn("within", before([*same, "bucket"], "queue"))
    buckets = queues.groupBy(*same, "bucket").agg(F.sum("step").alias("step"))
    # without targets these are at most MOST_QUEUES rows
    buckets = buckets.withColumn("first", before(same or [F.lit(0)], "bucket")).drop("step")
    return queues.join(buckets, [*same, "bucket"]).select("queue", "size", "rate", (F.col("first") + F.col("within")).alias("stands"))


def pack(
    documents: DataFrame,
    vocabulary: str,
    targets: Mapping[str | None, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence, with its ids (4 bytes each)."""
    rows = materialize(encoded(documents, vocabulary, id_column, text_column, source_column), "encoded")
    kind = rows.schema["id"].dataType.simpleString()
    # (2) one row per task and source
    shares = materialize(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "shares")
    base = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = shares.withColumn("base", base).drop("n").join(standing(shares, targets), "queue")
    begins = materialize(begins.select("queue", "part", "base", "size", "rate", "stands"), "begins")
    placed = rows.join(begins, ["queue", "part"]).select("id", "size", "rate", "stands", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    total = shares.agg(F.sum("n")).first()[0] or 0
    classes: list[tuple[float, int, int]] = []
    if targets is not None:
        counted = begins.select("queue", "rate", "size").distinct().groupBy("rate", "size").count().collect()
        classes = sorted((r["rate"], int(r["size"]), int(r["count"])) for r in counted)
    # (3) cut
    full, tail = sequence_cuts(total, sequence)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if targets is None:
            mirror = Mirror(total, window)
        else:
            robin = RoundRobin([size * m for _, size, m in classes], [rate * m for rate, _, m in classes], window)
            number = {(rate, size): (i, m) for i, (rate, size, m) in enumerate(classes)}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            columns = (batch.column(c).to_pylist() for c in ("id", "size", "rate", "stands", "at", "n", "ids"))
            for doc, size, rate, stands, at, n, ids in zip(*columns, strict=True):
                wide = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                if targets is None:
                    found = mirror.stretches(stands, size, at, n)
                else:
                    queue, members = number[rate, size]
                    found = robin.stretches(queue, at, n, stands, members)
                for begin, length, place in found:
                    end = begin + length
                    while begin < end:
                        if place < full:
                            seq, offset = divmod(place, sequence)
                            room = sequence - offset
                        else:
                            i = bisect.bisect_right(tail, place) - 1
                            seq, offset = full // sequence + i, place - tail[i]
                            room = (tail[i + 1] if i + 1 < len(tail) else 1 << 62) - place
                        take = min(end - begin, room)
                        own = wide[4 * begin : 4 * (begin + take)]
                        for column, x in zip(out, (doc, begin, take, zlib.crc32(own), n, seq, offset, own if keep_ids else None), strict=True):
                            column.append(x)
                        begin, place = begin + take, place + take
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column("id").type), *[pa.array(x, pa.int64()) for x in out[1:7]], pa.array(out[7], pa.binary())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(trimmed(run), PIECES.format(kind=kind)).withColumnRenamed("id", id_column)


def op4(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"), keep_ids=False).drop("ids")
