"""Op 13: base kinds against plain expressions, added kinds on cases."""
from __future__ import annotations

import hashlib
import random
import re

import pytest

from talentmatch.llm import pii, queries
from talentmatch.llm.common import read_table

MORE = "/root/testdata/sf0.01"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def holds(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    return (kind == 0 or kind == 1 and all(int(x) <= 255 for x in found.split("."))
            or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15)


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if holds(k, m[0]))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def base(text):
    return [x for x in pii.all_spans(text.encode()) if x[1] < pii.BASE]


def test_query_against_plain_reading(spark):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, MORE, "documents").collect()}
    rows = queries.op13_personal_data(spark, MORE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    found = [0] * 4
    for r in rows:
        want = plain(docs[r.doc_id])
        counts = [sum(k == x for _, k, _ in want) for x in range(4)]
        found = [a + b for a, b in zip(found, counts)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        parts = [p for p in r.spans.split(",") if p.split(":")[0] in pii.KINDS[:4]] if r.spans else []
        assert parts == (joined(want).split(",") if want else [])
    assert min(found) > 0


CASES = ["", "a@b@c.d", "a@b.c@d.e", "a@b.c_d@e.f", "x@y..z", "é.ü@ñ.com jo.é@mail.org", "@a.b", "a@b", "a@b.c.", "a@-.-",
         "1.2.3.4.5.6.7.8", "1..2.3.4.5", "256.1.1.1 1.2.3.4", "1.2.3.4.5.6.7", "0255.00.1.1", ".1.2.3.4", "1.2.3", "9" * 4000 + ".1.1.1",
         "4952935900253052", "4952 9359-0025 3052", "4952  935900253052", "4-9-5-2-9-3-5-9-0-0-2-5-3-0-5-2", "49529359002530521",
         "+1 (017) 555-7713", "+123", "+12 (", "+1 2 3 4 5 6 7 8 9", "++123456789 (", "+1((((((2", "+1234567890123456", "漢+49 30 1234567漢",
         "1.2.3.4952935900253052", "+4952935900253052@1.2.3.4", "1-2", "0 0 0 0 0 0 0 0 0 0 0 0"]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert base(text) == plain(text)


def test_random_texts(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(pii, "PIECE", 7)  # anchors lie across pieces
    for _ in range(30000):
        text = "".join(rng.choices("01259.@+- ()aé_:/", (6, 4, 4, 4, 4, 9, 4, 3, 3, 3, 1, 1, 3, 2, 1, 1, 1), k=rng.randint(1, 40)))
        assert base(text) == plain(text), text


ADDED = [
    ("write jo.doe [at] mail [dot] example (dot) org now", ["jo.doe [at] mail [dot] example (dot) org"], "spelled"),
    ("jo(at)example.org", ["jo(at)example.org"], "spelled"), ("look (at) this. Then", [], "spelled"), ("é (at) é.org", [], "spelled"),
    ("see https://jo:pw@host.org/x?y=1.", ["https://jo:pw@host.org/x?y=1"], "url"), ("see https://host.org/a?b=c", [], "url"),
    ("(http://h.org/p?q=1&email=jo%40x.org)", ["http://h.org/p?q=1&email=jo%40x.org"], "url"), ("://jo@x", [], "url"),
    ("<a href='mailto:jo@x.org'>", ["mailto:jo@x.org"], "uri"), ("tel:+49-30-1234567;x", ["tel:+49-30-1234567"], "uri"),
    ("hotel:12345678 tel:123", [], "uri"),
    ("IBAN: DE89 3704 0044 0532 0130 00 ok", ["DE89 3704 0044 0532 0130 00"], "account"),
    ("iban GB82WEST12345698765432.", ["GB82WEST12345698765432"], "account"),
    ("Account no. 12-345678 was", ["12-345678"], "account"), ("the account is high", [], "account"), ("SSN 078-05-1120", ["078-05-1120"], "account"),
    ("discount 123456", [], "account"), ("Passport number: X1234567 é", ["X1234567"], "account")]


@pytest.mark.parametrize("text,want,kind", ADDED)
def test_added_kinds(text, want, kind):
    assert [text[s:e] for s, k, e in pii.all_spans(text.encode()) if pii.KINDS[k] == kind] == want


def test_redact_and_edges(spark):
    long = "é word " * 300_000
    rows = [(1, None, 1), (None, "", 1), (2, "é jo@x.org, +49 30 1234567", 2), (2, "é jo@x.org, +49 30 1234567", 2),
            (3, long + "1.2.3.4", 4), (4, "1" * 1_000_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.spans) for r in pii.digests(pii.scan(df)).collect())
    assert got == [(0, ""), (1, ""), (2, "email:2:10,phone:12:26"), (2, "email:2:10,phone:12:26"),
                   (3, f"ip:{len(long)}:{len(long) + 7}"), (4, "")]
    clean = pii.redact(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[2] == "é [EMAIL], [PHONE]" and texts[3] == long + "[IP]" and texts[4] == rows[5][1]
    assert pii.digests(pii.scan(df.limit(0))).count() == 0
