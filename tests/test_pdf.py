"""PDF object graphs: shuffled, packed, broken and hostile files."""

from __future__ import annotations

import zlib

import pytest

from sieveworks.plans.document_queries import pdf_of
from sieveworks.sources import pdf_objects as P
from sieveworks.sources import table_functions

MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00E9> <D83DDE00>] endbfrange"


def stream(body, extra=b""):
    packed = zlib.compress(body)
    return b"<</Length %d/Filter/FlateDecode%s>>\nstream\n%s\nendstream" % (len(packed), extra, packed)


OBJECTS = {
    1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R 3 0 R 2 0 R]/Resources<</Font<</F1 5 0 R/F2 9 0 R>>/XObject<</X 10 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>", 4: b"<</Type/Page/Parent 2 0 R/Contents[8 0 R 99 0 R]>>",
    5: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 6 0 R>>", 6: stream(MAP), 7: stream(b"BT /F2 9 Tf (p\\351 \\(two\\)\\101) Tj T* [(a)-300(b)-20<63>] TJ ET /X Do"), 8: stream(b"BT /F1 12 Tf <0010001100030020> Tj 0 -14 Td <00120021FFFF> Tj ET"),
    9: b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[97/eacute/three/uni20AC]>>>>", 10: stream(b"BT /F2 9 Tf (in a form) ' ET /X Do", b"/Subtype/Form"),
}
WANT = [(1, "AB é\nC😀�"), (2, "pé (two)A\né 3€\n" + "in é form\n" * 4 + "in é form")]


def plain(order, chain=True):
    out, places = b"%PDF-1.5\n", {}
    for n in order:
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, OBJECTS[n])
    rows = b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, 11))
    return out + (b"xref\n0 11\n0000000000 65535 f \n%strailer <</Size 11/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (rows, len(out)) if chain else b"startxref\n7\n%%EOF")


def packed(predicted):
    """Object streams and a cross-reference stream."""
    out, places = b"%PDF-1.5\n", {}
    inside = [1, 2, 3, 4, 5, 9]
    bodies = [OBJECTS[n] for n in inside]
    index = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for b in bodies[:k])) for k, n in enumerate(inside)) + b" "
    objects = {n: OBJECTS[n] for n in (6, 7, 8, 10)} | {11: stream(index + b" ".join(bodies), b"/Type/ObjStm/N %d/First %d" % (len(inside), len(index)))}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    row = lambda n: b"\x02" + (11).to_bytes(3) + bytes([inside.index(n)]) if n in inside else b"\x01" + places[n].to_bytes(3) + b"\0" if n in places else bytes(5)
    rows = [row(n) for n in range(12)]
    if predicted:
        rows = [b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before)) for r, before in zip(rows, [bytes(5), *rows])]
    parms = b"/DecodeParms<</Predictor 12/Columns 5>>" if predicted else b""
    return out + b"12 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (stream(b"".join(rows), b"/Type/XRef/W[1 3 1]/Size 12/Root 1 0 R" + parms), len(out))


@pytest.mark.parametrize("data", [plain(range(1, 11)), plain([8, 10, 1, 6, 3, 9, 2, 7, 5, 4]), plain([8, 10, 1, 6, 3, 9, 2, 7, 5, 4], chain=False), packed(False), packed(True), packed(False).replace(b"startxref", b"startnone")])
def test_text_is_that_of_the_page_tree(data):
    assert list(P.page_texts(data)) == WANT


def test_words_of_a_document_come_back():
    text = "Ünï code\n\n(brackets) \\ <x>\n" + "\n".join(f"line {k} €😀" for k in range(95))
    assert [t for _, t in P.page_texts(pdf_of(text))] == ["\n".join(x for x in text.split("\n")[k : k + 40] if x) for k in (0, 40, 80)]


@pytest.mark.parametrize("data, error", [(b"", "no PDF"), (b"no", "no PDF"), (b"%PDF-1.7 trailer <</Encrypt 3 0 R>>", "encrypted"), (plain(range(1, 11)).replace(b"/Size 11", b"/Encrypt 5 0 R/Size 11"), "encrypted")])
def test_what_cannot_be_read_is_an_error(data, error):
    with pytest.raises(ValueError, match=error):
        list(P.page_texts(data))


@pytest.mark.parametrize("data", [b"%PDF-1.4", b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 1 0 R>> endobj", b"%PDF-1.4\n1 0 obj 2 0 R endobj 2 0 obj 1 0 R endobj startxref\n9\n", b"%PDF-1.4 " + b"<<" * 5_000 + b"[" * 5_000, plain(range(1, 11))[:200], b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Type/Page/Contents 4 0 R>> endobj 4 0 obj <</Length 5/Filter/FlateDecode>> stream\nbroken\nendstream endobj"])
def test_broken_files_end(data):
    assert all(t == "" for _, t in P.page_texts(data))


def test_glyphs():
    assert [P.glyph(x) for x in ("A", "uni00DF", "five", "Odieresis", "ccedilla", "bullet", "none")] == ["A", "ß", "5", "Ö", "ç", "•", "�"]


def test_pages_are_rows(spark):
    files = spark.createDataFrame([(1, bytearray(plain(range(1, 11)))), (2, bytearray(b"no")), (3, None)], "id int, content binary")
    got = sorted((tuple(r) for r in table_functions.pages_of(files, "id", "content").collect()), key=repr)
    assert got == [(1, 1, WANT[0][1], None), (1, 2, WANT[1][1], None), (2, None, None, "no PDF")]
