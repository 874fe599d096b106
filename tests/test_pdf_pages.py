import random

import pytest

import hashlib

from fileloom.operators import pdf, pdfcrypt
from fileloom.operators.errors import ConversionError
from fileloom.operators.pdf import Document


def test_long_page_trees_are_read_whole():
    doc = object.__new__(Document)
    doc.get = lambda node: node
    doc.root = {"Pages": {"Kids": [{"Kids": [{} for _ in range(1000)]} for _ in range(101)]}}
    assert len(doc.pages()) == 101_000


def lzw_codes(data: bytes, early: int) -> bytes:
    """A plain writer: greedy, with the table of strings spelled out."""
    table, bits, held = {bytes([k]): k for k in range(256)}, "", b""
    entries, width = 258, 9
    bits += f"{256:09b}"
    for k in range(len(data)):
        c = data[k : k + 1]
        if held + c in table:
            held += c
            continue
        bits += f"{table[held]:0{width}b}"
        table[held + c] = entries
        entries += 1
        held = c
        # the reader is one entry behind
        width = max(9, (entries - 1 + early).bit_length())
        if entries == 4094:
            bits += f"{table[held]:0{width}b}"
            width = max(9, min(12, (entries + early).bit_length()))
            bits += f"{256:0{width}b}"
            table, entries, width, held = {bytes([j]): j for j in range(256)}, 258, 9, b""
    if held:
        bits += f"{table[held]:0{width}b}"
        width = max(9, (entries + early).bit_length())
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


# The example of the PDF reference, 7.4.4.2.
def test_lzw_example():
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("early", [0, 1])
def test_lzw(early):
    rng = random.Random(early)
    for n in (0, 1, 2, 300, 1500, 20_000):
        data = bytes(rng.choices(b"abcde \n(", k=n))
        assert pdf.lzw(lzw_codes(data, early), early) == data


def test_run_lengths():
    assert pdf.run_lengths(bytes([2, 1, 2, 3, 254, 9, 0, 7, 128, 5])) == bytes([1, 2, 3, 9, 9, 9, 7])


def test_text_behind_lzw_and_runs():
    for name, coded in (("LZWDecode", lzw_codes(b"BT /F1 9 Tf (Hello there) Tj ET", 1)), ("RunLengthDecode", bytes([30]) + b"BT /F1 9 Tf (Hello there) Tj ET" + b"\x80")):
        body = f"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length {len(coded)} /Filter /{name} >>\nstream\n"
        data = b"%PDF-1.4\n" + body.encode() + coded + b"\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n"
        assert pdf.pdf_to_text(data) == b"Hello there"


# Test vectors of RC4 (RFC 6229 and others) and of AES-128 (FIPS 197, appendices B and C.1).
def test_rc4():
    assert pdfcrypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert pdfcrypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


@pytest.mark.parametrize(
    ("key", "plain", "coded"),
    [
        ("000102030405060708090a0b0c0d0e0f", "00112233445566778899aabbccddeeff", "69c4e0d86a7b0430d8cdb78070b4c55a"),
        ("2b7e151628aed2a6abf7158809cf4f3c", "3243f6a8885a308d313198a2e0370734", "3925841d02dc09fbdc118597196a0b32"),
    ],
)
def test_aes(key, plain, coded):
    # a block of padding after it, so that the last byte of the vector is none
    more = aes_encrypted(bytes.fromhex(key), bytes.fromhex(plain))
    assert more[16:32].hex() == coded and pdfcrypt.aes_cbc(bytes.fromhex(key), more).hex() == plain


def aes_encrypted(key, data):
    """Plain AES-128 in CBC mode with a start vector of zeros, a block at a time."""
    box = pdfcrypt._tables()[0]
    keys = pdfcrypt._round_keys(key)
    double = lambda a: (a << 1 ^ (0x1B if a & 0x80 else 0)) & 255
    n = 16 - len(data) % 16
    data, last, out = data + bytes([n]) * n, bytes(16), [bytes(16)]
    for i in range(0, len(data), 16):
        x = [a ^ b ^ int(k) for a, b, k in zip(data[i : i + 16], last, keys[0], strict=True)]
        for r in range(1, 11):
            x = [int(box[x[(c + 4 * (c % 4)) % 16]]) for c in range(16)]
            if r < 10:
                y = []
                for c in range(4):
                    a = x[4 * c : 4 * c + 4]
                    y += [double(a[k]) ^ double(a[(k + 1) % 4]) ^ a[(k + 1) % 4] ^ a[(k + 2) % 4] ^ a[(k + 3) % 4] for k in range(4)]
                x = y
            x = [a ^ int(k) for a, k in zip(x, keys[r], strict=True)]
        last = bytes(x)
        out.append(last)
    return b"".join(out)


def locked(kind, password=b""):
    """A document of one page, encrypted for a password, by the algorithms of the PDF reference."""
    version, revision, size = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes": (4, 4, 16)}[kind]
    o, p, first = bytes(range(32)), -44, b"0123456789abcdef"
    key = hashlib.md5((password + pdfcrypt.FILL)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    u = pdfcrypt.rc4(key, pdfcrypt.FILL)
    if revision > 2:
        u = hashlib.md5(pdfcrypt.FILL + first).digest()
        for k in range(20):
            u = pdfcrypt.rc4(bytes(b ^ k for b in key), u)
        u += bytes(16)
    own = hashlib.md5(key + b"\x04\0\0\0\0" + (b"sAlT" if kind == "aes" else b"")).digest()[: min(size + 5, 16)]
    text = b"BT /F1 9 Tf (Hello behind a lock, " + b"again " * 40 + b") Tj ET"
    coded = aes_encrypted(own, text) if kind == "aes" else pdfcrypt.rc4(own, text)
    filters = "/CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if kind == "aes" else f"/Length {size * 8}"
    body = f"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length {len(coded)} >>\nstream\n".encode()
    lock = f"5 0 obj\n<< /Filter /Standard /V {version} /R {revision} /P {p} /O <{o.hex()}> /U <{u.hex()}> {filters} >>\nendobj\n"
    return b"%PDF-1.6\n" + body + coded + b"\nendstream\nendobj\n" + lock.encode() + f"trailer\n<< /Root 1 0 R /Encrypt 5 0 R /ID [<{first.hex()}> <{first.hex()}>] >>\n".encode()


@pytest.mark.parametrize("kind", ["rc4-40", "rc4-128", "aes"])
def test_documents_that_open_without_a_password(kind):
    assert pdf.pdf_to_text(locked(kind)) == b"Hello behind a lock, " + b"again " * 39 + b"again"
    with pytest.raises(ConversionError, match="encrypted with a password"):
        pdf.pdf_to_text(locked(kind, b"secret"))


def test_locks_of_other_kinds():
    with pytest.raises(ConversionError, match="encrypted of a kind"):
        pdf.pdf_to_text(locked("aes").replace(b"/V 4 /R 4", b"/V 5 /R 6"))
