"""Format readers: the bytes of a résumé file -> its text.

A reader is a plain function ``bytes -> str`` for one extension; it runs
inside an Arrow function over the files that have that extension, and a file
it cannot read (any exception) falls back to the plain decode of its bytes.
``docx`` and ``pdf`` are built in; another reader, or one for a further
extension, is passed as ``readers={**READERS, "pdf": my_reader}``.

Only files of a known extension carry their bytes to Python; Arrow batches are
cut at ``spark.sql.execution.arrow.maxBytesPerBatch``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmatch.sources.pdf import pdf_text

#: Namespace of text documents, and the kind of link that names the main part.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN_PART = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
#: Largest main part that is unpacked (a small file can unpack to any size).
MOST_BYTES = 64 << 20


def _run(run: ElementTree.Element) -> str:
    """The text of one run: tabs, line breaks and hyphens are elements."""
    marks = {WORD + "tab": "\t", WORD + "cr": "\n", WORD + "noBreakHyphen": "-"}
    out = []
    for x in run:
        if x.tag == WORD + "t":
            out.append(x.text or "")
        elif x.tag == WORD + "br":
            out.append("\n" if x.get(WORD + "type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(marks.get(x.tag, ""))
    return "".join(out)


def _paragraph(paragraph: ElementTree.Element) -> str:
    """Runs of the paragraph and of its links, in order."""
    out = []
    for x in paragraph:
        if x.tag == WORD + "r":
            out.append(_run(x))
        elif x.tag == WORD + "hyperlink":
            out += [_run(r) for r in x.findall(WORD + "r")]
    return "".join(out)


def docx_text(content: bytes) -> str:
    """The paragraphs of the body, a line each; tables, headers and footers
    are not part of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = ElementTree.fromstring(z.read("_rels/.rels"))
        part = next(x.get("Target").lstrip("/") for x in links if x.get("Type") == MAIN_PART)
        if z.getinfo(part).file_size > MOST_BYTES:
            raise ValueError("main part too large")
        body = ElementTree.fromstring(z.read(part)).find(WORD + "body")
    return "\n".join(_paragraph(p) for p in body.findall(WORD + "p"))


READERS: Mapping[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf_text}


def extracted_text(extension: Column, content: Column, readers: Mapping[str, Callable[[bytes], str]] = READERS) -> Column:
    """Text by the reader of the extension (lower case, without its dot); null
    where there is none or the reader failed."""
    if not readers:
        return F.lit(None).cast("string")
    readers = dict(readers)

    @F.pandas_udf("string")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        def one(kind, data):
            if data is None:
                return None
            try:
                return readers[kind](bytes(data))
            except Exception:  # a broken file is read as plain text
                return None

        return pd.Series([one(k, c) for k, c in zip(kinds, contents)], dtype=object)

    known = extension.isin(list(readers))
    return read(extension, F.when(known, content))
