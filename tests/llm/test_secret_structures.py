"""What is a private key and what only looks like one."""

from __future__ import annotations

import base64

import pytest
from test_text_operators import der

from brindle.llm import secrets


def number(size, first=1):
    return b"\x02" + (bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2, "big")) + bytes([first]) + bytes(range(1, 256))[: size - 1].ljust(size - 1, b"\x07")


def field(raw):
    return len(raw).to_bytes(4, "big") + raw


VERSION, RSA_OID = b"\x02\x01\x00", b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"
P, Q = 2**521 - 1, 2**607 - 1  # two primes
D = pow(65537, -1, (P - 1) * (Q - 1))


def integer(value):
    raw = value.to_bytes(value.bit_length() // 8 + 1, "big")
    return b"\x02" + (bytes([len(raw)]) if len(raw) < 128 else b"\x82" + len(raw).to_bytes(2, "big")) + raw


RSA = der(VERSION, *map(integer, (P * Q, 65537, D, P, Q, D % (P - 1), D % (Q - 1), pow(Q, -1, P))))
DSA = der(VERSION, *map(integer, (6 * P + 1, P, 4, 9, 77)))
OCTETS32 = b"\x04\x20" + bytes(range(32))
PKCS12 = der(b"\x02\x01\x03", der(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01", b"\xa0\x22" + OCTETS32), der(der(RSA_OID, b"\x05\x00"), OCTETS32))
PKCS8 = der(VERSION, der(RSA_OID, b"\x05\x00"), b"\x04\x20" + bytes(range(32)))
SEC1 = der(b"\x02\x01\x01", b"\x04\x20" + bytes(range(32)), b"\xa0\x07\x06\x05\x2b\x81\x04\x00\x0a")
SEALED = der(der(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d", b"\x05\x00"), b"\x04\x20" + bytes(32))
PUBLIC = der(der(RSA_OID, b"\x05\x00"), b"\x03\x21\x00" + bytes(32))
PUBLIC_RSA = der(number(65), number(3))
CERTIFICATE = der(der(b"\xa0\x03\x02\x01\x02", number(20)), der(RSA_OID), b"\x03\x21\x00" + bytes(32))
SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40)
OPENSSH = SSH + field(b"abcdabcd" + bytes(40))


@pytest.mark.parametrize("raw", [RSA, DSA, PKCS8, SEC1, SEALED, PKCS12])
def test_private_keys(raw):
    assert secrets.is_key(raw) == "der"
    assert secrets.is_key(raw[:-1]) is None and secrets.is_key(raw + b"\0") is None


def test_openssh_to_its_end():
    assert secrets.is_key(OPENSSH) == "openssh"
    for wrong in (OPENSSH[:-1], OPENSSH + b"x", SSH + field(b"abcdabce" + bytes(40)), b"openssh-key-v1\0garbage that is no key at all"):
        assert secrets.is_key(wrong) is None


@pytest.mark.parametrize("raw", [
    der(b"\x0c\x20" + b"t" * 32), der(b"\x0c\x10" + b"t" * 16, b"\x0c\x10" + b"u" * 16), PUBLIC, PUBLIC_RSA, CERTIFICATE,
    field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(bytes(range(1, 120))), der(VERSION, number(3), number(4)),
    der(VERSION, OCTETS32), der(b"\x02\x01\x01", OCTETS32), der(VERSION, number(40), OCTETS32), der(VERSION, der(RSA_OID, b"\x05\x00"), number(40)), der(VERSION, *[number(40)] * 5),
    der(VERSION, *[number(n) for n in (65, 3, 64, 33, 33, 32, 32, 32)]), der(VERSION, *map(integer, (P * Q + 1, 65537, D, P, Q, 3, 3, 3))), der(VERSION, *map(integer, (6 * P + 3, P, 4, 9, 77))),
    der(b"\x02\x01\x03", der(b"\x06\x03\x2a\x03\x04", b"\xa0\x22" + OCTETS32)),
])
def test_what_is_no_secret(raw):
    assert secrets.is_key(raw) is None
    assert secrets.confirmed_spans(base64.b64encode(raw).decode() + " " + raw.hex()) == []


def test_armour():
    body = base64.encodebytes(RSA).decode()
    plain = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.encodebytes(bytes(64)).decode() + "-----END RSA PRIVATE KEY-----"
    for text in (plain, plain.replace("\n", "\\n"), plain.replace("\n", "\\r\\n"), sealed):
        assert secrets.pem_spans(f"x {text} y") == [(2, 2 + len(text))]
    for text in (plain.replace("RSA PRIVATE KEY", "PUBLIC KEY"), plain.replace("-----END RSA", "-----END DSA"), "-----BEGIN PRIVATE KEY-----" * 20_000):
        assert secrets.pem_spans(text) == []
