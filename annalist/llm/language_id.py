"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: contexts of up to ``ORDER`` bytes
with the counts of what followed them. A byte's probability blends the orders
by the escape probabilities of method C: with n followers of q kinds counted,
a context gives count / (n + q), and passes q / (n + q) on to the next shorter
one, down to even odds of all byte values. The statistics are frozen after training, so the
probabilities are worked out once,
and a text's exact code length in every language is a sum of table entries.
Positions are looked up all at once, in blocks; no text is cut short.

Training reads the documents that are not held out, in a sample whose size is
``SAMPLE`` documents a language on average, by a hash of the id, whole texts.
Each language has trees of its own, whose contexts are kept by frequency as far
as its table has room: ``TABLE_BYTES``, or an equal part of ``MOST_BYTES``
where there are so many languages that these would not fit. So one language's
trees are the same however many others there are, up to that.

Defined results: null text or text without a letter is ``und`` with score 0,
as is everything where no language could be learned; a null id is not held out
and not learned from; repeated rows get the same prediction; ties go to the
first language by name; an empty table gives an empty table. Columns are read
by the names given; a result column that the input has already gets a number
(``names.free_name``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.memory import trimmed
from annalist.llm.names import free_name
from annalist.session import discard, materialize

ORDER = 3
SAMPLE = 2000
TABLE_BYTES, MOST_BYTES = 12 << 20, 192 << 20
FOLDS = 5
UNKNOWN = "und"
BLOCK = 1 << 19
BATCH_BYTES = 1 << 21
#: Texts of so many bytes or more are of no known language where a byte takes so many bits more than in the language's own texts.
LONG, FOREIGN_BITS = 200, 2.0

#: Case and digits say little about the language.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256)
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def ngram_counts(data: bytes, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of order + 1 bytes, at every byte that is not 0, and how often each occurs."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(x) <= order:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.zeros(len(x) - order, np.uint64)
    for i in range(order + 1):
        keys = (keys << np.uint64(8)) | x[i : len(x) - order + i]
    keys = keys[(keys & np.uint64(255)) != 0]
    found, n = np.unique(keys, return_counts=True)
    return found.astype(np.int64), n.astype(np.int64)


class Tree:
    """The context tree of one language, with frozen code lengths."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int = ORDER, table_bytes: int = TABLE_BYTES):
        """Packed windows of the language's texts and their counts."""
        self.order = order
        seen = np.unique(keys & 255)
        #: Dense numbers for bytes; 0 for those not seen, the last for what lies outside a text.
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbols = a = len(seen) + 1
        self.symbol[0] = self.outside = a
        rows = np.stack([self.symbol[(keys >> (8 * (order - i))) & 255] for i in range(order + 1)], axis=1).astype(np.int64)
        per_order = []
        for d in range(order + 1):
            # contexts as packed numbers, nearest byte first
            packed = sum((rows[:, order - 1 - i] * (a + 1) ** i for i in range(d)), np.zeros(len(rows), np.int64))
            inside = np.all(rows[:, order - d : order] != a, axis=1)
            contexts, at = np.unique(packed[inside], return_inverse=True)
            per_order.append((packed, inside, contexts, np.bincount(at, n[inside], len(contexts))))
        room = max(1, table_bytes // (4 * (a + 1)))
        every = np.sort(np.concatenate([t for *_, t in per_order]))[::-1]
        least = max(2, every[room] + 1 if len(every) > room else 0)
        tables, self.links, base, parent, before = [], [], 0, None, np.zeros(1, np.int64)
        for d, (packed, inside, contexts, total) in enumerate(per_order):
            keep = total >= least
            if d:
                keep &= np.isin(contexts % (a + 1) ** (d - 1), before)
            contexts = contexts[keep] if d else np.zeros(1, np.int64)
            table = np.zeros((len(contexts), a + 1))
            at = np.minimum(np.searchsorted(contexts, packed), max(len(contexts) - 1, 0))
            hit = inside & (contexts[at] == packed) if len(contexts) else np.zeros(len(packed), bool)
            np.add.at(table, (at[hit], rows[hit, order]), n[hit])
            up = np.searchsorted(before, contexts % (a + 1) ** (d - 1)) if d else None
            lower = parent[up] if d else np.full((1, a + 1), 1.0 / 256)
            many, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
            table = np.where(many > 0, (table + kinds * lower) / np.maximum(many + kinds, 1), lower)
            tables.append(table)
            if d:
                # number of the longer context for each kept shorter one and byte before it; itself where there is none
                link = np.repeat(np.arange(base - len(before), base)[:, None], a + 1, axis=1)
                link[up, contexts // (a + 1) ** (d - 1)] = base + np.arange(len(contexts))
                self.links.append((base - len(before), link.astype(np.int32)))
            base, parent, before = base + len(contexts), table, contexts
        codes = -np.log(np.concatenate(tables))
        codes[:, a] = 0.0
        self.codes = codes.reshape(-1).astype(np.float32)
        #: The node after the nearest two bytes, the nearest lowest, from which on the walk goes.
        grid = np.arange(1 << 16)
        self.after_two = self._walk(self.symbol[np.stack([grid >> 8, grid & 255])], 2) if order >= 2 else None
        #: Nats that a byte of the language's own texts takes.
        self.typical = float((self.at(rows.T) * n).sum() / max(n.sum(), 1)) if len(rows) else 0.0

    def _walk(self, before: np.ndarray, steps: int) -> np.ndarray:
        """The deepest node of at most so many steps for each column of symbols, the nearest in the last row."""
        node = np.zeros(before.shape[1], np.int32)
        for first, link in self.links[:steps]:
            near, before = before[-1], before[:-1]
            deep = np.flatnonzero(node >= first)
            node[deep] = link[node[deep] - first, near[deep]]
        return node

    def at(self, window: np.ndarray) -> np.ndarray:
        """Code length of each symbol in the last row, after those in the rows before it."""
        return self.codes[self._walk(window[:-1], self.order).astype(np.int64) * (self.symbols + 1) + window[-1]]

    def along(self, data: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
        """Code length of each byte after the first ``order``; ``pairs`` holds the two bytes before each, the nearest lowest."""
        ids = self.symbol[data]
        if pairs is None:
            return self.at(np.lib.stride_tricks.sliding_window_view(ids, len(ids) - self.order))
        node, n, width = self.after_two[pairs], len(ids) - self.order, self.symbols + 1
        for d, (first, link) in enumerate(self.links[2:], 3):
            deep = np.flatnonzero(node >= first)
            node[deep] = link.reshape(-1)[(node[deep] - first) * width + ids[self.order - d : self.order - d + n][deep]]
        node *= width
        node += ids[self.order :]
        return self.codes[node]


class Trees:
    """The trees of all languages, each over contexts of its own."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, table_bytes: int = TABLE_BYTES, most_bytes: int = MOST_BYTES):
        """counts: for each language packed windows and their counts."""
        self.languages, self.order = languages, order
        room = min(table_bytes, most_bytes // max(1, len(languages)))
        self.trees = [Tree(*counts[l], order, room) for l in languages]
        self.typical = np.array([t.typical for t in self.trees])

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in nats of each text in each language."""
        gap = b"\x00" * self.order
        # a byte 0 inside a text is not a boundary: it is like any byte not seen in training
        data = np.frombuffer(gap + gap.join(t.translate(FOLD).replace(b"\x00", b"\xff") for t in texts), np.uint8)
        begins = np.cumsum([self.order] + [len(t) + self.order for t in texts])[: len(texts)]
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(self.order, len(data), BLOCK):
            hi = min(lo + BLOCK, len(data))
            i, j = max(np.searchsorted(begins, lo, "right") - 1, 0), np.searchsorted(begins, hi, "left")
            starts = np.maximum(begins[i:j], lo) - lo
            pairs = data[lo - 1 : hi - 1].astype(np.uint16) | data[lo - 2 : hi - 2].astype(np.uint16) << 8 if self.order >= 2 else None
            for l, tree in enumerate(self.trees):
                out[i:j, l] += np.add.reduceat(tree.along(data[lo - self.order : hi], pairs), starts, dtype=np.float64)
        return out


def train(documents: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Trees:
    """Trees from a hash sample of the documents with text and language that are not held out."""
    known = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{language_column}`").cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    # one row a language; written, so that Spark knows its size and sends it to all tasks only where it is small
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    drawn = known.join(sizes, "lang").where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < F.least(F.lit(1.0), sample / F.col("size")) * (1 << 20))
    drawn = drawn.select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass").translate(FOLD).replace(b"\x00", b"\xff"))
            for lang, texts in held.items():
                gap = b"\x00" * ORDER
                keys, n = ngram_counts(gap + gap.join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"])

    # of each language no more windows leave the executors than its table could have use for; the sample bounds what is ranked
    rows = drawn.mapInArrow(trimmed(count), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= TABLE_BYTES // 8).select("lang", "key", "n").toArrow().combine_chunks()
    names = rows.column("lang").to_numpy(zero_copy_only=False).astype(str)
    keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    counts = {}
    for l in np.unique(names).tolist():
        own = np.flatnonzero(names == l)
        own = own[np.argsort(keys[own])]
        counts[l] = (keys[own], n[own])
    discard(sizes)
    return Trees(sorted(counts), counts)


def predict(documents: DataFrame, trees: Trees, text_column: str = "text", label: str = "lang_pred", score: str = "score", bits: str = "bits_per_byte") -> DataFrame:
    """The documents with predicted language, its posterior under even priors, and bits per byte.

    Narrow; the trees are broadcast and no larger than ``MOST_BYTES`` and their links.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    names = list(documents.columns)
    marked = documents.withColumn(free_name("has_letter", names), F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType(list(documents.schema.fields))
    for name, kind in ((label, "string"), (score, "double"), (bits, "double")):
        schema = schema.add(free_name(name, schema.names), kind)
    result = schema.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from annalist.llm.tokens import batches_by_bytes

        model = shared.value
        for batch in batches:
            texts = batch.column(names.index(text_column))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            letter = batch.column(len(names)).to_pylist()
            labels, scores, rates = [], [], []
            for a, b in batches_by_bytes(sizes, BATCH_BYTES):
                own = [i for i in range(a, b) if letter[i] and model.languages]
                part = (([UNKNOWN] * (b - a)), [0.0] * (b - a), [0.0] * (b - a))
                if own:
                    data = [texts[i].as_buffer().to_pybytes() for i in own]
                    lengths = model.code_lengths(data)
                    best = lengths.argmin(axis=1)
                    least = lengths[np.arange(len(own)), best]
                    sure = 1.0 / np.exp(np.maximum(least[:, None] - lengths, -700.0)).sum(axis=1)
                    for k, i in enumerate(own):
                        part[0][i - a] = model.languages[best[k]]
                        part[1][i - a] = round(float(sure[k]), 6)
                        part[2][i - a] = round(float(least[k]) / np.log(2) / len(data[k]), 4)
                labels += part[0]
                scores += part[1]
                rates += part[2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                names=result,
            )

    return marked.mapInArrow(trimmed(run), schema)


def keep_identified(documents: DataFrame, trees: Trees | None = None, text_column: str = "text") -> DataFrame:
    """The documents that are of a learned language; columns as they came.

    What goes: text that is null or has no letter, and text of ``LONG`` bytes
    or more that takes ``FOREIGN_BITS`` a byte more than its best language's
    own texts. Short texts with a letter stay, as do all where no language was learned.
    """
    trees = trees or train(documents)
    judged = predict(documents, trees, text_column)
    label, _, bits = judged.columns[-3:]
    most = F.lit(None).cast("double")
    for name, typical in zip(trees.languages, trees.typical.tolist()):
        most = F.when(F.col(label) == name, typical / math.log(2) + FOREIGN_BITS).otherwise(most)
    foreign = (F.octet_length(f"`{text_column}`") >= LONG) & (F.col(f"`{bits}`") > most)
    known = F.col(f"`{text_column}`").rlike(r"\p{L}") if not trees.languages else (F.col(f"`{label}`") != UNKNOWN) & ~F.coalesce(foreign, F.lit(False))
    return judged.where(known).select(*[F.col(f"`{c}`") for c in documents.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    documents = table(spark, sf_dir, "documents")
    return predict(documents.select("doc_id", "text"), train(documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )
