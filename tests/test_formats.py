"""Format readers of résumé files."""

from __future__ import annotations

import io
import zipfile

import pytest

from talentmatch.sources import fixtures as FX
from talentmatch.sources import formats
from talentmatch.sources.resume_files import read_resume_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LINKS = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" '
         'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="/doc/main.xml"/></Relationships>')


def document(body, part="doc/main.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", LINKS)
        z.writestr(part, f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_paragraphs_runs_and_marks():
    body = ("<w:p><w:r><w:t>Ada</w:t><w:tab/><w:t xml:space='preserve"
            "'> L&amp;é</w:t></w:r><w:r><w:br/><w:t>x</w:t><w:br w:type='page'/><w:noBreakHyphen/><w:cr/></w:r></w:p>"
            "<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
            "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>")
    assert formats.docx_text(document(body)) == "Ada\t L&é\nx-\n\n\nlink"
    assert formats.docx_text(document("")) == ""


@pytest.mark.parametrize("text", ["", "one line", "a\n\nb\tc\n", "é <b> & \"q\" 漢"])
def test_round_trip(text):
    assert formats.docx_text(FX.docx_of(text)) == text


def test_files_of_all_formats(spark, tmp_path, monkeypatch):
    (tmp_path / "a.docx").write_bytes(FX.docx_of("Ada Lovelace\nSKILLS: sql"))
    (tmp_path / "b.DOCX").write_bytes(b"plain \xffbytes\r\n")
    (tmp_path / "c.docx").write_bytes(document("<w:p/>", part="doc/other.xml"))  # the main part is missing
    (tmp_path / "d.pdf").write_bytes(b"%PDF text")
    (tmp_path / "e.txt").write_bytes("é".encode())
    (tmp_path / "f.exe").write_bytes(b"no")
    (tmp_path / "g").write_bytes(b"no")
    got = {r.file: r.text for r in read_resume_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == "Ada Lovelace\nSKILLS: sql" and got["b.DOCX"] == "plain bytes\n"
    assert got["c.docx"].startswith("PK") and got["d.pdf"] == "%PDF text" and got["e.txt"] == "é"
    assert got["f.exe"] is None and got["g"] is None
    # a reader of one's own; one that fails falls back
    own = {**formats.READERS, "pdf": lambda b: b.decode().removeprefix("%PDF "), "txt": lambda b: 1 / 0}
    got = {r.file: r.text for r in read_resume_files(spark, str(tmp_path), readers=own).collect()}
    assert got["d.pdf"] == "text" and got["e.txt"] == "é" and got["a.docx"].startswith("Ada")
    got = {r.file: r.text for r in read_resume_files(spark, str(tmp_path), readers={}).collect()}
    assert got["a.docx"].startswith("PK") and got["d.pdf"] == "%PDF text"


def test_a_document_that_unpacks_too_far_is_not_unpacked(monkeypatch):
    monkeypatch.setattr(formats, "MOST_BYTES", 50)
    with pytest.raises(ValueError):
        formats.docx_text(FX.docx_of("x" * 100))
