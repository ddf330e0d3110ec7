"""Bitmaps from image bytes, and a small local recogniser for known typefaces.

No image library is needed: PBM, PGM and non-interlaced PNG are decoded here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping

import numpy as np

CELL = 16


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    fields, at = [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        if not m:
            raise ValueError("image header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])
        return np.where(np.frombuffer(bits[: w * h], np.uint8).reshape(h, w) == ord("1"), 0, 255).astype(np.uint8)
    at += 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at).reshape(h, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if kind == b"P5" and fields[2] == 255:
        return np.frombuffer(data, np.uint8, w * h, at).reshape(h, w)
    raise ValueError("image kind")


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = chunk
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += chunk
        at += 12 + n
    if head is None or head[12]:
        raise ValueError("image header")
    w, h, depth, color = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth != 8 and not (depth in (1, 2, 4) and channels == 1):
        raise ValueError("image depth")
    step, row = max(1, channels * depth // 8), -(-w * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8)[: h * (row + 1)].reshape(h, row + 1)
    out, above = np.zeros((h, row), np.uint8), np.zeros(row, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for x in range(row):
                left = int(line[x - step]) if x >= step else 0
                up, corner = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        values = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, :w]
        gray = values if color == 3 else values * 255 // ((1 << depth) - 1)
        pixels = gray.astype(np.uint8)[:, :, None]
    else:
        pixels = out.reshape(h, w, channels)
    if color == 3:
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] >= 3:
        return (pixels[:, :, :3] @ np.array([299, 587, 114]) // 1000).astype(np.uint8)
    return pixels[:, :, 0]


def gray(data: bytes) -> np.ndarray:
    """Gray values of an image, 0 for black; ValueError where the bytes are no image of a known kind."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P1", b"P4", b"P5"):
            return _netpbm(data)
    except (KeyError, IndexError, TypeError, zlib.error) as e:
        raise ValueError("image data") from e
    raise ValueError("image kind")


def _spans(on: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(on, prepend=False, append=False)).tolist()
    return list(zip(edge[::2], edge[1::2]))


def _cell(ink: np.ndarray) -> np.ndarray:
    """A glyph's ink, trimmed and scaled to a square by nearest neighbours."""
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    ink = ink[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    at = (np.arange(CELL) + 0.5) / CELL
    return ink[(at * ink.shape[0]).astype(int)][:, (at * ink.shape[1]).astype(int)]


class TemplateEngine:
    """Recognises print in one known typeface: lines and glyphs by gaps in the ink, glyphs by their nearest template.

    ``glyphs`` maps each character to its bitmap, truthy where it is black.
    Returns one page per image with the mean agreement of its glyphs.
    """

    def __init__(self, glyphs: Mapping[str, object]):
        self.names, cells, shapes = [], [], []
        for name, bitmap in glyphs.items():
            ink = np.asarray(bitmap, bool)
            if ink.any():
                self.names.append(name)
                cells.append(_cell(ink).ravel())
                shapes.append(self._shape(ink))
        self.cells, self.shapes = np.array(cells), np.array(shapes)

    @staticmethod
    def _shape(ink: np.ndarray) -> float:
        h, w = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
        return float(np.log((h[-1] - h[0] + 1) / (w[-1] - w[0] + 1)))

    def __call__(self, data: bytes) -> list[tuple[int, str, float]]:
        image = gray(data)
        ink = image < (int(image.min()) + int(image.max())) / 2 if image.size and image.min() < image.max() else np.zeros(image.shape, bool)
        lines, sure = [], []
        for top, bottom in _spans(ink.any(axis=1)):
            line = ink[top:bottom]
            boxes = _spans(line.any(axis=0))
            typical = float(np.median([b - a for a, b in boxes]))
            text, last = "", None
            for a, b in boxes:
                if last is not None and a - last > 0.6 * typical:
                    text += " "
                glyph = line[:, a:b]
                score = (self.cells == _cell(glyph).ravel()).mean(axis=1) - 0.2 * np.abs(self.shapes - self._shape(glyph))
                best = int(score.argmax())
                text += self.names[best]
                sure.append(float(np.clip(score[best], 0, 1)))
                last = b
            lines.append(text)
        return [(1, "\n".join(lines), float(np.mean(sure)) if sure else 0.0)]
