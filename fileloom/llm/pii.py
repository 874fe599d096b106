"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

``find`` returns each document's spans (code points, end exclusive) with kind and score; ``redact`` replaces them.
The four base kinds (email, ip, card, phone) are found leftmost and non-overlapping per kind, and a match that fails
its check is dropped without a second try. The method adds kinds that need more evidence: ``iban`` (ISO 13616, length by country, mod 97),
``ssn`` and ``local_phone`` (both only where a word nearby speaks for them).

Edge cases: a null text counts as empty, an empty text has no spans, repeated rows are treated one by one, extra
columns are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: In the order in which spans with the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
#: Score of a confirmed span before its context, by kind; spans of the added kinds below THRESHOLD are dropped.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "local_phone": 0.2}
THRESHOLD = 0.5
#: Each word of these within WINDOW code points before or after adds BOOST, once; a word of AGAINST takes it away.
WINDOW, BOOST = 48, 0.3
_PHONE_WORDS = "phone tel call mobile fax telephone telefon anrufen handy téléphone appeler portable teléfono llamar móvil"
CONTEXT = {
    kind: frozenset(words.split())
    for kind, words in {
        "email": "email mail contact write address kontakt schreiben adresse écrire courriel correo escribir dirección",
        "ip": "ip host server address client adresse serveur servidor dirección",
        "card": "card visa mastercard credit payment amex karte kreditkarte zahlung carte paiement tarjeta pago",
        "phone": _PHONE_WORDS,
        "iban": "iban account bank transfer konto überweisung compte virement cuenta transferencia",
        "ssn": "ssn social security taxpayer",
        "local_phone": _PHONE_WORDS,
    }.items()
}
AGAINST = frozenset("version isbn order invoice serial sku bestellung rechnung commande facture pedido factura".split())
#: Characters of an IBAN by country (ISO 13616); others are taken as long as they stand.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, max_score double"
FOUND = "doc_id long, kind string, start long, end long, score double"

# An address is looked for from its @: what stands before cannot hold another @, so this finds what a left-to-right
# search finds, without its quadratic cost on long runs of letters.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the number ends that the country's length and its checksum confirm; words in capitals may follow it."""
    kept = [i for i in range(start, end) if text[i] != " "]
    n = IBAN_LENGTH.get(text[start : start + 2], len(kept))
    if not 15 <= n <= min(len(kept), 34) or not mod97("".join(text[i] for i in kept[:n])):
        return None
    stop = kept[n - 1] + 1
    return stop if stop == end or not text[stop].isalnum() else None


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start, then kind."""
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, k, e in sorted((s, k, e) for s, e, k in found)]


def score(text: str, start: int, end: int, kind: str) -> float:
    near = {w.lower() for w in _LETTERS.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    out = PRIOR[kind] + BOOST * bool(near & CONTEXT[kind]) - BOOST * bool(near & AGAINST)
    return round(min(1.0, max(0.0, out)), 3)


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """All spans with scores, by start, then kind."""
    base = base_spans(text)
    taken = sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end of those that start no later
    more = []
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "iban":
                e = iban_end(text, s, e)
                if e is None:
                    continue
            elif (k := bisect_left(starts, e)) and reach[k - 1] > s:
                continue
            if score(text, s, e, kind) >= THRESHOLD:
                more.append((s, e, kind))
    both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
    return [(s, e, k, score(text, s, e, k)) for s, e, k in both]


def redact_text(text: str) -> str:
    """Spans become [KIND]; of overlapping ones the first counts."""
    out, at = [], 0
    for s, e, k, _ in spans(text):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def _listed(x) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in x)


def _digest(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = spans(text.as_py() or "")
            base = [x for x in found if x[2] in BASE_KINDS]
            n = [sum(x[2] == k for x in base) for k in BASE_KINDS]
            rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), len(found) - len(base), max((x[3] for x in found), default=None)))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def _find(batches):
    for batch in batches:
        rows = [(i, k, s, e, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for s, e, k, w in spans(t.as_py() or "")]
        if rows:
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kind", "start", "end", "score"])


def _redact(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([redact_text(t.as_py() or "") for t in batch.column(1)], pa.string())], ["doc_id", "text"])


def find(docs: DataFrame) -> DataFrame:
    """A row for each span: doc_id, kind, start, end, score."""
    return docs.select("doc_id", "text").mapInArrow(_find, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with its spans replaced by their kinds."""
    return docs.select("doc_id", "text").mapInArrow(_redact, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and spans of each document; see SCHEMA."""
    return docs.select("doc_id", "text").mapInArrow(_digest, SCHEMA)
