"""The reader of PDF files, on files written by hand."""

from __future__ import annotations

import base64
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentmatch.operators.parse import parse_resumes, parse_resumes_intended
from talentmatch.sources import fixtures as FX
from talentmatch.sources import pdf
from talentmatch.sources.resume_files import file_text, read_resume_files

FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"


def stream(data, extra=""):
    data = data if isinstance(data, bytes) else data.encode("cp1252")
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra.encode(), data)


def pdf_file(content, font=FONT, page="", others=(), tail=b"trailer << /Root 1 0 R >>"):
    """One page; object 5 is its content, further objects count from 6."""
    content = content if isinstance(content, bytes) and content.startswith(b"<<") else stream(content)
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>",
              "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >> >>",
              f"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] {page} >>", font, content, *others]
    out = b"%PDF-1.7\n%\xe2\xe3\n"
    for n, body in enumerate(bodies, 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body if isinstance(body, bytes) else body.encode())
    return out + tail


def written(*shows):
    return "BT /F 10 Tf 50 700 Td 12 TL " + " ".join(shows) + " ET"


def shown_lines(text):
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "".join(x + "\n" for x in lines if x)


@pytest.mark.parametrize("text", [
    "", " \n ", "a", "Ada  Lovelace\n\nx\ty\n", "é <b> 漢 😀 (x)\\", "\n".join(f"line {i} of many" for i in range(120))])
def test_round_trip(text):
    assert pdf.pdf_text(FX.pdf_of(text)) == shown_lines(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200))
def test_round_trip_of_any_text(text):
    text = "".join(c for c in text if not "ﬀ" <= c <= "ﬆ")
    assert pdf.pdf_text(FX.pdf_of(text, per_page=3)) == shown_lines(text)


@pytest.mark.parametrize("shows, text", [
    (["(a\\(b\\) \\101\\n(c)\\\nd) Tj"], "a(b) A (c)d\n"),
    (["[(Wo) 20 (rd) -600 (next) -900 (last)] TJ"], "Word next last\n"),
    (["(one) Tj T* (two) Tj (three) '", "1 0 (four) \""], "one\ntwo\nthree\nfour\n"),
    (["<4142 4> Tj 0 -20 TD (x) Tj T* (y) Tj"], "AB@\nx\ny\n"),
    (["(low) Tj 30 1 Td (right) Tj -30 40 Td (top) Tj"], "top\nlow right\n"),
    (["(a) Tj 3 Ts (2) Tj 0 Ts 4 Tc (bc) Tj 0 Tc 200 Tz (de) Tj"], "a2b c de\n"),
    (["(\\200 caf\\351) Tj"], "€ café\n"),
])
def test_operators(shows, text):
    assert pdf.pdf_text(pdf_file(written(*shows))) == text


def test_matrices_forms_and_inline_images():
    content = ("q 2 0 0 2 0 0 cm BT /F 5 Tf 10 20 Td (scaled) Tj ET Q q 1 0 0 1 0 300 cm /X Do Q "
               "BI /W 1 /H 1 ID \x01(EI no \x02 EI BT /F 10 Tf 1 0 0 1 90 40 Tm (after) Tj ET")
    form = stream("BT /F 10 Tf (in a form) Tj ET /X Do", "/Subtype /Form /Matrix [1 0 0 1 5 5]")
    got = pdf.pdf_text(pdf_file(content, others=[form]))
    assert got.endswith("scaled after\n") and got.startswith("in a form\n")


@pytest.mark.parametrize("turn, text", [(0, "a b\n"), (90, "a\nb\n"), (180, "b a\n"), (270, "b\na\n"), (-90, "b\na\n")])
def test_turned_pages(turn, text):
    content = "BT /F 10 Tf 10 50 Td (a) Tj 60 0 Td (b) Tj ET"
    assert pdf.pdf_text(pdf_file(content, page=f"/Rotate {turn}")) == text


def test_encodings_of_simple_fonts():
    font = ("<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [500 500] /FontDescriptor << /MissingWidth 500 >> "
            "/Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 /fi /eacute /uni6F22 /u1F600 66 /bullet /a.sc /nosuch] >> >>")
    assert pdf.pdf_text(pdf_file(written("(\\001\\002\\003\\004ABCD\\216) Tj"), font)) == "fié漢😀A•a é\n"  # an unknown glyph leaves a gap
    cmap = stream("1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <42> <0058> <43> <44> [<0066 0069> <FB01>] endbfrange")
    font = "<< /Type /Font /Subtype /TrueType /ToUnicode 6 0 R >>"
    assert pdf.pdf_text(pdf_file(written("(ABCDE) Tj"), font, others=[cmap])) == "XYfifiE\n"


def test_fonts_of_two_byte_codes():
    font = "<< /Type /Font /Subtype /Type0 /Encoding /UniGB-UCS2-H /DescendantFonts [<< /DW 1000 /W [66 [200 200] 70 80 900] >>] >>"
    assert pdf.pdf_text(pdf_file(written("<00416F220042> Tj"), font)) == "A漢B\n"
    unknown = "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H >>"  # no map: the codes say nothing
    assert pdf.pdf_text(pdf_file(written("<00416F22> Tj"), unknown)) == ""


def test_filters_and_lengths():
    text = written("(packed) Tj")
    packed = zlib.compress(text.encode())
    assert pdf.pdf_text(pdf_file(stream(packed, "/Filter /FlateDecode"))) == "packed\n"
    coded = base64.a85encode(packed) + b"~>"
    assert pdf.pdf_text(pdf_file(stream(coded, "/Filter [/ASCII85Decode /FlateDecode]"))) == "packed\n"
    assert pdf.pdf_text(pdf_file(stream(text.encode().hex() + ">", "/Filter /AHx"))) == "packed\n"
    wrong = stream(text).replace(b"/Length", b"/Length 7 /Other")
    assert pdf.pdf_text(pdf_file(wrong)) == "packed\n"


def test_object_streams_and_later_definitions():
    inner = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >>    << /Kids [3 0 R] /Resources << /Font << /F 4 0 R >> >> >>"
    packed = stream(zlib.compress(inner), f"/Type /ObjStm /N 2 /First {inner.index(b'<<')} /Filter /FlateDecode")
    whole = pdf_file(written("(old) Tj")).replace(b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", b"")
    whole = whole.replace(b"/Pages /Kids [3 0 R]", b"/Pages /Kids []")
    whole += b"\n9 0 obj " + packed + b" endobj 5 0 obj " + stream(written("(new) Tj")) + b" endobj"
    assert pdf.pdf_text(whole) == "new\n"


def test_pages_that_list_themselves_are_read_once():
    loop = pdf_file(written("(once) Tj")).replace(b"/Kids [3 0 R]", b"/Kids [2 0 R 3 0 R 3 0 R]")
    assert pdf.pdf_text(loop) == "once\n"


@pytest.mark.parametrize("content", [
    b"", b"This is a dummy.", b"%PDF-1.4 text", pdf_file(written("(x) Tj"), tail=b"trailer << /Root 1 0 R /Encrypt 9 0 R >>"),
    pdf_file(stream("x", "/Filter /LZWDecode")), pdf_file(stream("not packed", "/Filter /FlateDecode"))])
def test_what_cannot_be_read_is_an_error(content):
    with pytest.raises(Exception):
        pdf.pdf_text(content)


def test_a_file_that_unpacks_too_far_is_not_unpacked(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_BYTES", 4000)
    with pytest.raises(ValueError):
        pdf.pdf_text(pdf_file(stream(zlib.compress(b" " * 5000), "/Filter /FlateDecode")))
    again = stream("BT (x) Tj ET " + "/X Do " * 9, "/Subtype /Form")  # forms that multiply
    with pytest.raises(ValueError):
        pdf.pdf_text(pdf_file("/X Do", others=[again]))


def test_a_page_that_is_too_full_is_an_error(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_GLYPHS", 10)
    assert pdf.pdf_text(pdf_file(written("(12345) Tj (67890) Tj"))) == "1234567890\n"
    with pytest.raises(ValueError):
        pdf.pdf_text(pdf_file(written("(12345) Tj (67890) Tj (x) Tj")))


def test_cut_streams_and_text_without_a_font():
    packed = zlib.compress(written(*(f"({n} {n * n}) Tj T*" for n in range(200))).encode())
    got = pdf.pdf_text(pdf_file(stream(packed[:300], "/Filter /FlateDecode")))
    assert got.startswith("0 0\n1 1\n2 4\n")
    assert pdf.pdf_text(pdf_file("BT (x) Tj ET BT /F 9 Tf (y) Tj ET")) == "y\n"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.binary(min_size=1, max_size=6))
def test_damaged_files_end(at, junk):
    whole = pdf_file(written("[(Wo) 20 (rd)] TJ T* <4142> Tj"), others=[stream("(f) Tj", "/Subtype /Form")])
    at %= len(whole)
    try:
        assert isinstance(pdf.pdf_text(whole[:at] + junk + whole[at + len(junk):]), str)
    except Exception as e:
        assert not isinstance(e, (MemoryError, RecursionError))


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf_file(written("(Ada Lovelace) Tj T* (SKILLS: python) Tj")))
    (tmp_path / "b.pdf").write_bytes(b"This is plain.")
    (tmp_path / "c.pdf").write_bytes(pdf_file(""))
    got = {r.file: r.text for r in read_resume_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": "Ada Lovelace\nSKILLS: python\n", "b.pdf": "This is plain.", "c.pdf": ""}


def test_documents_as_pdf(small_sf):
    texts = pq.read_table(f"{small_sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert all(pdf.pdf_text(FX.pdf_of(t or "")) == shown_lines(t or "") for t in texts)


@pytest.mark.parametrize("parse", [parse_resumes, parse_resumes_intended])
def test_a_resume_parses_alike_as_text_and_as_pdf(spark, small_sf, parse):
    """Only blanks and blank lines differ, so only the length does."""
    def records(texts):
        return {r.resume_id: r for r in parse(texts, keep=("resume_id",)).drop("text_length", "raw_text", "file").collect()}

    files = FX.pdf_files(spark, small_sf)
    as_pdf = records(files.select("resume_id", file_text(F.col("file"), F.col("content")).alias("text")))
    as_text = records(FX.resumes_raw(spark, small_sf).select("resume_id", "text"))
    assert as_pdf == as_text and len(as_pdf) > 100
