"""Exact subword encoding, fast: pieces of text between safe boundaries are encoded once per worker.

Natural text repeats its words. A text is cut at single spaces and line ends
where no token of the vocabulary's pre-tokenizer can reach across, and each
piece is looked up in a bounded cache; only unseen pieces reach the tokenizer,
all those of a batch in one call. Where a cut would not be safe (white space
next to white space, special strings) the text between the nearest safe cuts is
given to the tokenizer as it is.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable, Iterable

#: Entries of a worker's cache, some 200 bytes each. It has two generations: when the young one
#: holds half of these, it becomes the old one, and what is still used moves to the next.
CACHE = 600_000
#: Longer pieces are encoded each time, so that a cache entry is bounded.
LONGEST = 48
SPECIAL = "<|"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return [out[b] for b in range(256)]


_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))


def written(word: str) -> str:
    """A word as byte-level vocabularies write it."""
    return word.encode().decode("latin-1").translate(_LETTERS)


def one_word(piece: str) -> bool:
    """Whether a piece is one run of Latin letters, which the pre-tokenizers leave whole and normalisation as it is."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "ɐ")


class ByteLevelCounter:
    """Token counts of a byte-level BPE whose pre-tokenizer lets one space lead a word.

    Safe cuts: before a space that a visible ASCII or Latin character follows;
    white space in front of that space is a token of its own either way, as
    ``\\s+(?!\\S)`` leaves just the last space to the word. And around a line
    end between two such characters, which is always a token of its own.
    A leading "\\x00" stands for that line end in the cache's keys.
    """

    _cut = re.compile(r" (?=[!-~À-ɏ])")

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.limit = load(path), cache
        self.merge = self.tokenizer.model.tokenize
        self.after: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _safe(piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\x00" else piece
        return bool(body) and ("!" <= body[0] <= "~" or "À" <= body[0] <= "ɏ") and not body[-1].isspace() and SPECIAL not in body and "\x00" not in body

    def _slow(self, text: str) -> int:
        """Cut at safe spaces only, and never inside what a special string might need."""
        if SPECIAL in text:
            return self._encode([text])[0]
        parts = self._cut.split(text)
        return sum(self._encode([parts[0], *[" " + p for p in parts[1:]]]))

    def counts(self, texts: Iterable[str]) -> list[int]:
        out, plans, unseen, unsafe = [], [], set(), -(1 << 60)
        if len(self.after) > self.limit // 2:
            self.after, self.old = {}, self.after
        for text in texts:
            if not text or "\x00" in text:
                plans.append(None)
                continue
            head, *rest = text.replace("\n", " \x00").split(" ")
            plans.append((head, rest))
            unseen.update(rest)
        unseen.difference_update(self.after)
        extra: dict[str, int] = {}
        safe = []
        for p in unseen:
            if p in self.old:
                self.after[p] = self.old[p]
            elif one_word(p):
                # straight to the merges: a space leads the word, which is one pre-token
                (extra if len(p) > LONGEST else self.after)[p] = len(self.merge("Ġ" + (p if p.isascii() else written(p))))
            elif self._safe(p):
                safe.append(p)
            else:
                extra[p] = unsafe
        for p, n in zip(safe, self._encode(["\n" + p[1:] if p[0] == "\x00" else " " + p for p in safe]), strict=True):
            (extra if len(p) > LONGEST else self.after)[p] = n
        if extra:
            known = self.after
            look = lambda p: known[p] if p in known else extra[p]
        else:
            look = self.after.__getitem__
        for text, plan in zip(texts, plans, strict=True):
            if plan is None:
                out.append(self._encode([text])[0] if text else 0)
                continue
            head, rest = plan
            n = sum(map(look, rest)) + (self._encode([head])[0] if head and self._safe(head) and head[0] != "\x00" else unsafe)
            out.append(self._slow(text) if n < 0 else n)
        return out


class _Pieces(dict):
    """Ids by piece; what is missing is looked up in the old generation, or made."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        self.make, self.old = make, old
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class WordEncoder:
    """Ids of a word-level BPE that drops white space: the text may be cut at every space and line end."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.limit = load(path), cache
        self.merge = self.tokenizer.model.tokenize
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = "I" if self.wide else "H"
        self.known = _Pieces(self._ids, {})

    # Not Latin; and a comma or stop before a space that ends a longer run of marks.
    _other = re.compile(r"[^\x00-ɏ]")
    _run = re.compile(r"[,.] (?<![A-Za-z0-9À-ÖØ-öø-ɏ][,.] )")

    def _latin(self, text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self._other.search(text)
        return True

    def _ids(self, piece: str) -> bytes:
        if one_word(piece) and piece.islower():
            # straight to the merges: one pre-token that normalisation leaves as it is
            ids = [t.id for t in self.merge(piece if piece.isascii() else written(piece))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array.array(self.kind, ids).tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Pieces that no token reaches across.

        Latin text is lower-cased first, as the tokenizer would, and commas and
        stops are set apart from words, so that one word is one piece.
        """
        text = text.replace("\n", " ")
        if SPECIAL not in text and self._latin(text):
            text = text.lower()
            if not self._run.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian bytes, of two bytes an id, or four for large vocabularies."""
        if len(self.known) > self.limit // 2:
            self.known = _Pieces(self._ids, dict(self.known))
        look = self.known.__getitem__
        return [b"".join(map(look, self._pieces(t))) for t in texts]


def batches_by_bytes(sizes: list[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about equal bytes, at least one row each."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)
