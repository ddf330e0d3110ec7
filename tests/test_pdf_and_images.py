"""PDF files and images made here, read back by the operators."""

import zlib

import numpy as np
import pytest

from annalist.functions import images
from annalist.functions.pdf import Pdf, PdfError
from annalist.operators.pdf import merge_pdf, pdf_pages, split_pdf, texts_to_pdf
from annalist.operators.recognise import recognize


def made_pdf(texts, flate=True, objstm=False):
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 3: b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>"}
    kids = []
    for i, t in enumerate(texts):
        lines = b" T* ".join(b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in t.split("\n"))
        data = b"BT /F1 12 Tf 72 700 Td " + lines + b" ET"
        raw = zlib.compress(data) if flate else data
        objects[10 + 2 * i] = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if flate else b"", raw)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<</Type /Pages /Count %d /Kids [%s] /Resources <</Font <</F1 3 0 R>>>> /MediaBox [0 0 612 792]>>" % (len(kids), b" ".join(kids))
    out = b"%PDF-1.5\n"
    if objstm:
        plain = {n: objects.pop(n) for n in (1, 2, 3)}
        head, body = b"", b""
        for n, o in plain.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        raw = zlib.compress(head + body)
        objects[99] = b"<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream" % (len(head), len(raw), raw)
    for n, o in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    return out + b"trailer <</Root 1 0 R>>\n%%EOF"


@pytest.mark.parametrize("flate", [True, False])
@pytest.mark.parametrize("objstm", [True, False])
def test_pages_split_and_merge(spark, flate, objstm):
    a = made_pdf(["Page one (of two)\nline é", "back\\slash"], flate, objstm)
    b = made_pdf(["other"], flate, objstm)
    df = spark.createDataFrame([("a", "g", a), ("b", "g", b), ("c", "h", b"junk"), ("d", "h", None)], "path string, grp string, content binary")
    rows = sorted((r.path, r.page, r.text) for r in pdf_pages(df).where("error is null").collect())
    assert rows == [("a", 1, "Page one (of two)\nline é"), ("a", 2, "back\\slash"), ("b", 1, "other")]
    assert [r.path for r in pdf_pages(df).where("error is not null").collect()] == ["c"]
    parts = split_pdf(df).where("error is null").collect()
    assert sorted((r.path, r.part, r.n_pages, Pdf(bytes(r.content)).page_text(Pdf(bytes(r.content)).pages[0])) for r in parts) == [
        ("a", 1, 1, "Page one (of two)\nline é"), ("a", 2, 1, "back\\slash"), ("b", 1, 1, "other"),
    ]
    merged = {r.grp: r for r in merge_pdf(df, "grp").collect()}
    whole = Pdf(bytes(merged["g"].content))
    assert merged["g"].n_pages == 3 and [whole.page_text(p) for p in whole.pages] == ["Page one (of two)\nline é", "back\\slash", "other"]
    assert merged["h"].content is None and "not a PDF" in merged["h"].error


def composite(encoding, shown):
    pdf = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>> endobj\n"
    data = b"BT /F 9 Tf <" + shown.hex().encode() + b"> Tj ET"
    return pdf + b"4 0 obj <</Length %d>> stream\n%s\nendstream endobj 5 0 obj <</Subtype /Type0 /Encoding %s>> endobj" % (len(data), data, encoding)


def test_predefined_maps_of_composite_fonts(spark):
    for name, codec in ((b"GBK-EUC-H", "gbk"), (b"UniGB-UTF16-V", "utf-16-be"), (b"ETen-B5-H", "big5"), (b"90ms-RKSJ-H", "cp932")):
        p = Pdf(composite(b"/" + name, "地方志".encode(codec, "replace")))
        assert p.page_text(p.pages[0]) == "地方志".encode(codec, "replace").decode(codec)
    files = spark.createDataFrame([("a", composite(b"/Identity-H", b"\x00\x01")), ("b", composite(b"/GBK-EUC-H", "地方志".encode("gbk")))], "path string, content binary")
    got = {r.path: r for r in pdf_pages(files).collect()}
    assert "Identity-H" in got["a"].error and got["a"].text is None and got["b"].text == "地方志" and got["b"].error is None


def test_texts_to_pdf_and_back(spark):
    texts = ["", "one", "地方志 é 😀\n\n  two   words\t\nlast", "\n".join(f"line {i}" for i in range(130))]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string")
    pages = {(r.doc_id, r.page): r.text for r in pdf_pages(texts_to_pdf(df), id_column="doc_id").collect()}
    assert pages[0, 1] == "" and pages[1, 1] == "one" and pages[2, 1] == "地方志 é 😀\ntwo words\nlast" and not any(k[0] == 9 for k in pages)
    assert [pages[3, p].count("line") for p in (1, 2, 3)] == [60, 60, 10] and len(pages) == 6


def test_unicode_map_kerning_and_refusals():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> <5730> endbfrange 1 beginbfchar <0003> <65b9> endbfchar"
    data = b"BT /F Tf [<0001> -500 <0003>] TJ ET"
    pdf = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>> endobj\n"
    pdf += b"4 0 obj <</Length %d>> stream\n%s\nendstream endobj 5 0 obj <</ToUnicode 6 0 R>> endobj 6 0 obj <</Length 999>> stream\n%s\nendstream endobj" % (len(data), data.replace(b"/F Tf", b"/F 9 Tf"), cmap)
    p = Pdf(pdf)
    assert p.page_text(p.pages[0]) == "地 方"
    with pytest.raises(PdfError):
        Pdf(pdf + b" trailer <</Encrypt 9 0 R>>")
    with pytest.raises(PdfError):
        Pdf(b"")
    assert Pdf(b"%PDF-1.4 1 0 obj << /Kids [1 0 R] >> endobj trailer <</Root 1 0 R>>").pages == []


FONT = {
    "I": ["111", "010", "010", "010", "111"], "L": ["100", "100", "100", "100", "111"], "T": ["111", "010", "010", "010", "010"],
    "O": ["111", "101", "101", "101", "111"], "H": ["101", "101", "111", "101", "101"], "E": ["111", "100", "110", "100", "111"],
}
GLYPHS = {k: [[c == "1" for c in row] for row in v] for k, v in FONT.items()}


def drawn(text, scale):
    lines = []
    for line in text.split("\n"):
        columns = []
        for c in line:
            columns.append(np.array(GLYPHS[c]) if c != " " else np.zeros((5, 3), bool))
            columns.append(np.zeros((5, 1), bool))
        lines += [np.concatenate(columns, axis=1)]
    width = max(x.shape[1] for x in lines)
    rows = [np.pad(x, ((1, 1), (1, 1 + width - x.shape[1]))) for x in lines]
    return np.kron(np.concatenate(rows), np.ones((scale, scale), bool)).astype(bool)


def pgm(ink):
    return b"P5 %d %d 255\n" % ink.shape[::-1] + np.where(ink, 0, 255).astype(np.uint8).tobytes()


def png(ink, kind):
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    pixels, raw, above = np.where(ink, 0, 255).astype(np.int64), b"", np.zeros(ink.shape[1], np.int64)
    for row in pixels:
        left = np.concatenate(([0], row[:-1]))
        coded = {0: row, 1: row - left, 2: row - above, 3: row - (left + above) // 2}[kind]
        raw += bytes([kind]) + (coded & 255).astype(np.uint8).tobytes()
        above = row
    head = ink.shape[1].to_bytes(4, "big") + ink.shape[0].to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("scale", [2, 5])
def test_recognition(spark, scale):
    ink = drawn("HELLO TO\nTHE HOTEL", scale)
    bits = b"P4 %d %d\n" % ink.shape[::-1] + np.packbits(ink, axis=1).tobytes()
    files = [("pgm", pgm(ink)), ("pbm", bits), *[(f"png{k}", png(ink, k)) for k in range(4)], ("blank", pgm(np.zeros((9, 9), bool))), ("junk", b"junk"), ("cut", png(ink, 1)[:60]), ("none", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: r for r in recognize(df, lambda: images.TemplateEngine(GLYPHS)).collect()}
    for name in ("pgm", "pbm", "png0", "png1", "png2", "png3"):
        assert got[name].pages[0].text == "HELLO TO\nTHE HOTEL" and got[name].pages[0].confidence > 0.95
    assert got["blank"].pages[0].text == "" and got["junk"].error and got["cut"].error and got["junk"].pages == []
    assert got["none"].pages == [] and got["none"].error is None
