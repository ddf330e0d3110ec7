"""Substring dedup: passages of documents that earlier documents, or reference texts, hold.

Two operators:

``remove_references`` takes a reference table (benchmarks, licences). Its texts
are cut into shards, each shard becomes a suffix automaton over words, the
automata are broadcast, and documents stream past them for matching statistics:
the length of the longest match that ends at each word. Spans above the
threshold are removed. Automata of at most ``PASS_WORDS`` words are held and
broadcast at a time; a larger table takes several passes over the documents,
whose spans add up, so there is no limit to it but time.

``remove_repeats`` takes the corpus itself as reference: a word goes when a
window of ``WINDOW`` words that covers it also starts in a document with a
smaller id. Automata of a whole corpus cannot be broadcast, and to stream it
past all its shards takes time with its square (README has figures), so the
matching statistics are thresholded exactly through hashes of windows:

1. Each window has an anchor, the least hash among its runs of five words.
   Equal windows have equal anchors, so a window whose anchor occurs in one
   document only is no repeat. Anchors are counted with a map-side combine.
2. Windows under repeated anchors are hashed to 128 bits, and the least id of
   each is found, again combined before the shuffle.
3. Each document gets the first halves of the hashes of its windows that start
   in a smaller id; they only tell its own windows apart.

Defined results: null text has no words; texts shorter than a window lose
nothing; rows that repeat an id are one document to windows, and each is
returned; rows with a null id neither remove nor lose anything; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import words
from annalist.llm.memory import trimmed
from annalist.llm.tokens import batches_by_bytes
from annalist.session import discard, materialize

WINDOW, ANCHOR = 13, 5
BATCH_BYTES = 1 << 20
_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words of references in an automaton, and in all automata of one pass; a word takes some 335 bytes.
SHARD_WORDS, PASS_WORDS = 100_000, 500_000


# --- suffix automata of references -------------------------------------------


class SuffixAutomaton:
    """All runs of words of some texts; built word by word (Blumer and others, 1985)."""

    def __init__(self) -> None:
        self.next: list[dict[bytes | int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, word: bytes | int) -> None:
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p != -1 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
        self.last = state

    def matching(self, text: list[bytes]) -> list[int]:
        """Length of the longest run ending at each word that the texts hold."""
        out, state, n = [], 0, 0
        for w in text:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def automaton(texts: list[list[bytes]]) -> SuffixAutomaton:
    """One automaton for several texts; numbers, which no word equals, keep them apart."""
    out = SuffixAutomaton()
    for i, text in enumerate(texts):
        for w in text:
            out.extend(w)
        out.extend(i)
    return out


def _shards(references: DataFrame, least: int) -> Iterator[list[list[bytes]]]:
    """Texts of references, some ``SHARD_WORDS`` words at a time, read one after another.

    Longer texts are cut into pieces that overlap by ``least - 1`` words, so each run of ``least`` words is whole in one.
    """
    held, size = [], 0
    for row in references.toLocalIterator():
        own = _SPLIT.findall(row["text"].encode())
        for a in range(0, max(1, len(own) - least + 1), SHARD_WORDS):
            held.append(own[a : a + SHARD_WORDS + least - 1])
            size += len(held[-1])
            if size >= SHARD_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _marked(frame: DataFrame, automata: list, least: int) -> DataFrame:
    """The frame with the spans of matches with broadcast automata added: begins and ends in turn, ascending and apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spans = []
            for text, before in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = _SPLIT.findall(text.encode())
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, before[::2], 1)
                np.add.at(change, before[1::2], -1)
                for shard in automata:
                    for end, n in enumerate(shard.value.matching(text), 1):
                        if n >= least:
                            change[end - n] += 1
                            change[end] -= 1
                spans.append(np.flatnonzero(np.diff(np.cumsum(change)[:-1] > 0, prepend=False, append=False)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(spans, pa.list_(pa.int64()))], names=["id", "text", "spans"])

    return frame.mapInArrow(trimmed(run), frame.schema)


def remove_references(
    documents: DataFrame, references: DataFrame, least: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", reference_column: str = "text"
) -> DataFrame:
    """id, n_words, n_removed, spans (begin, end in words) and kept text, for spans of matches of ``least`` words or more.

    Defined results: null texts have no words, in documents and references;
    references shorter than ``least`` words remove nothing; repeated rows are
    handled each, and null ids like any other; spans that touch or overlap are
    one; empty tables on either side leave all as it is; other columns are ignored.
    """
    spark = documents.sparkSession
    source = references.select(F.col(f"`{reference_column}`").alias("text")).where("text is not null")
    frame = documents.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), F.array().cast("array<bigint>").alias("spans")
    )
    kind = frame.schema["id"].dataType.simpleString()
    automata: list = []
    held = 0
    for shard in _shards(source, least):
        if held and held + sum(map(len, shard)) > PASS_WORDS:
            before, frame = frame, materialize(_marked(frame, automata, least), "marked")
            discard(before)
            for one in automata:
                one.destroy()
            automata, held = [], 0
        automata.append(spark.sparkContext.broadcast(automaton(shard)))
        held += sum(map(len, shard))
    if automata:
        frame = _marked(frame, automata, least)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = _SPLIT.findall(text.encode())
                gone = np.zeros(len(text), bool)
                for a, b in zip(spans[::2], spans[1::2]):
                    gone[a:b] = True
                out[0].append(len(text))
                out[1].append(int(gone.sum()))
                out[2].append([f"{a}:{b}" for a, b in zip(spans[::2], spans[1::2])])
                out[3].append(b" ".join(compress(text, ~gone)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.string())],
                names=["id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return frame.mapInArrow(trimmed(run), f"id {kind}, n_words bigint, n_removed bigint, spans array<string>, kept_text string").withColumnRenamed("id", id_column)


# --- the corpus as its own reference -----------------------------------------


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window that begins at each word."""
    runs = words.lane(hashes[0], ANCHOR, seed=ANCHOR)
    n = max(0, hashes.shape[1] - WINDOW + 1)
    least = runs[:n].copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, runs[i : i + n], out=least)
    return least


def _texts(batch, a: int, b: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").slice(a, b - a)]


def _parts(batch) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    return batches_by_bytes(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), BATCH_BYTES)


def _document_anchors(documents: DataFrame) -> DataFrame:
    """anchor and id, once for each anchor of a document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b in _parts(batch):
                hashes, at = words.word_hashes(_texts(batch, a, b))
                anchors = _anchors(hashes)
                own = [np.unique(anchors[x : max(x, y - WINDOW + 1)]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                rows = np.repeat(np.arange(a, b), [len(o) for o in own])
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column("id").take(pa.array(rows))], names=["anchor", "id"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.where("id is not null and text is not null").mapInArrow(trimmed(run), f"anchor bigint, id {kind}")


def _windows(candidates: DataFrame) -> DataFrame:
    """hi, lo and id of every window whose anchor is among its document's repeated ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            wanted = batch.column("anchors")
            flat, offsets = wanted.values.to_numpy(), wanted.offsets.to_numpy()
            for a, b in _parts(batch):
                hashes, at = words.word_hashes(_texts(batch, a, b))
                anchors = _anchors(hashes).view(np.int64)
                his, los = words.runs(hashes, WINDOW)
                hi, lo, rows = [], [], []
                for i in range(a, b):
                    x, y = int(at[i - a]), int(at[i - a + 1]) - WINDOW + 1
                    if y > x:
                        hit = x + np.flatnonzero(np.isin(anchors[x:y], flat[offsets[i] : offsets[i + 1]]))
                        hi.append(his[hit])
                        lo.append(los[hit])
                        rows.append(np.full(len(hit), i))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64)), batch.column("id").take(pa.array(np.concatenate(rows)))],
                        names=["hi", "lo", "id"],
                    )

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.mapInArrow(trimmed(run), f"hi bigint, lo bigint, id {kind}")


def _kept(documents: DataFrame, keep_text: bool) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gone = batch.column("gone").to_pylist()
            for a, b in _parts(batch):
                texts = _texts(batch, a, b)
                hashes, at = words.word_hashes(texts)
                his = words.runs(hashes, WINDOW)[0].view(np.int64)
                n_words, removed, digests, kept = [], [], [], []
                for i, text in enumerate(texts):
                    own, x, y = text.split(), int(at[i]), int(at[i + 1])
                    n_words.append(y - x)
                    n = 0
                    if gone[a + i] and y - x >= WINDOW:
                        begins = np.isin(his[x : y - WINDOW + 1], gone[a + i])
                        run_up = np.concatenate((np.cumsum(begins), np.full(WINDOW - 1, begins.sum())))
                        covered = run_up - np.concatenate((np.zeros(WINDOW, np.int64), run_up[: -WINDOW])) > 0
                        own = list(compress(own, ~covered))
                        n = int(covered.sum())
                    text = b" ".join(own)
                    removed.append(n)
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(trimmed(run), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space) of each document."""
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    anchors = _document_anchors(slim)
    repeated = materialize(anchors.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("anchor"), "anchors")
    wanted = materialize(anchors.join(repeated, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    candidates = materialize(slim.join(wanted, "id"), "candidates")
    discard(repeated, wanted)
    windows = _windows(candidates)
    first = materialize(windows.groupBy("hi", "lo").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hi", "lo", "least"), "windows")
    gone = materialize(
        windows.join(first, ["hi", "lo"]).where("id > least").groupBy("id").agg(F.collect_set("hi").alias("gone")), "gone"
    )
    discard(candidates, first)
    return _kept(slim.join(gone, "id", "left"), keep_text).withColumnRenamed("id", id_column)


def op6(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")
