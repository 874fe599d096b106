import hashlib
import re

import pytest

from fileloom.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


CASES = ["a@b.c@d.e f@g..h x@y@z.w .@a.b", "1.2.3.4.5 999.1.1.1 1.2.3.256 007.8.9.10 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111", "+1 (017) 555-7713 +12 +1(2)3 +1234567890123456 ++49 30 123456-7.", "é@é.é \U0001f600 a@b.co +4930123456789)"]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert ",".join(f"{k}:{s}:{e}" for s, e, k in pii.base_spans(text)) == plain(text)


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_digest(request, name):
    docs = request.getfixturevalue(name)
    got = pii.digest(docs).collect()
    want = [(r.doc_id, hashlib.sha256(plain(r.text or "").encode()).hexdigest()) for r in docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.base_sha256) for r in got])) == sorted(map(repr, want))


def test_added_kinds():
    assert [k for *_, k, _ in pii.spans("IBAN: DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert pii.spans("IBAN: DE89 3704 0044 0532 0130 01 ok") == []
    assert [k for *_, k, _ in pii.spans("her SSN 123-45-6789.")] == ["ssn"]
    assert pii.spans("part 123-45-6789.") == []
    assert [k for *_, k, _ in pii.spans("call (212) 555-0199 now")] == ["local_phone"]
    assert pii.redact_text("mail bob@x.org, ok") == "mail [EMAIL], ok"


def test_iban_by_country_and_context_in_four_languages():
    found = lambda t: [(t[s:e], k) for s, e, k, _ in pii.spans(t) if k == "iban"]
    assert found("IBAN GB29 NWBK 6016 1331 9268 19 OK DANKE") == [("GB29 NWBK 6016 1331 9268 19", "iban")]
    assert found("NO93 8601 1117 947") == [("NO93 8601 1117 947", "iban")]
    assert found("GB29 NWBK 6016 1331 9268 1") == []
    score = lambda t: [round(w, 3) for *_, k, w in pii.spans(t) if k == "local_phone"]
    assert [score(f"{w}: (212) 555-0199") for w in ("Telefon", "téléphone", "teléfono", "Seite")] == [[0.5]] * 3 + [[]]


def test_many_spans_end():
    import time

    began = time.time()
    text = "1.2.3.4 call 212-555-0199 " * 20_000
    assert len(pii.spans(text)) == 40_000 and time.time() - began < 20


def overlapping(spans):
    return any(a < d and c < b for i, (a, b) in enumerate(spans) for c, d in spans[:i])


def test_added_spans_do_not_overlap_base_ones():
    text = "phone +1 212-555-0199 123-45-6789 ssn 10.0.0.1 212.555.0199.1"
    base = [x[:2] for x in pii.base_spans(text)]
    added = [(s, e) for s, e, k, _ in pii.spans(text) if k not in pii.BASE_KINDS]
    assert added and not any(overlapping([a, b]) for a in added for b in base)


def test_find_and_redact(spark, odd):
    docs = spark.createDataFrame([(1, "x 9.8.7.6"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in pii.find(docs).collect()] == [(1, "ip", 2, 9, 0.6)]
    assert {tuple(r) for r in pii.redact(docs).collect()} == {(1, "x [IP]"), (2, "")}
    got = sorted((repr(r.doc_id), r.text) for r in pii.redact(odd).collect())
    assert got == sorted((repr(r.doc_id), r.text or "") for r in odd.collect())
