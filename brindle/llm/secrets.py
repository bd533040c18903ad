"""Secret scan with structural confirmation.

Three plain patterns give the base spans. On top of them, long base64 and hex runs are decoded
and reported only if what they hold parses as a private key or a signed token:

* DER of a private key, read field by field: RSA (version 0 or 1, then modulus, exponents, primes and
  the rest, with odd modulus and primes, an odd public exponent, and primes whose bits add up to the
  modulus's), DSA (version 0 and five numbers that belong together), PKCS#8 (a version, an algorithm's
  object identifier, an octet string), its encrypted form (a password scheme's identifier, an octet
  string), SEC1 (version 1, an octet string, then parameters or a public point), or a PKCS#12 container
  (version 3, content of a PKCS#7 kind, at most a MAC). Lengths, nested ones too, must add up to the
  last byte. Any other sequence is no key, whatever it holds.
* An OpenSSH key file, all fields to the end: ciphers, public keys, and a private section whose
  check numbers agree where it isn't encrypted.
* PEM armour of a private key around such bytes, with line feeds as they are or escaped (as in
  JSON and .env files), or with the header lines of an encrypted key.
* A signed token whose first two parts are JSON objects and whose header names an algorithm.

Public keys, certificates and requests are no secrets and aren't reported.

Null and empty texts have no spans. Any column may be null, columns other than the text are
carried along, and rows that repeat each give their own result. Texts of any length are
scanned whole; every pattern is linear in the text, but for the assignment pattern's bounded
keywords.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import parts

BASE = ("assign", "access", "hex")
CONFIRMED = ("der", "openssh", "pem", "token")
KINDS = BASE + CONFIRMED

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A shorter run of these never becomes a longer one, so the least length can stand in the pattern.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: Key material has so many bytes at least; a version is one of these.
MATERIAL, VERSIONS = 16, (b"\0", b"\1")
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Optional fields 0 and 1.
CONTEXT = (0xA0, 0xA1, 0x81)
#: Beginning of the object identifiers of PKCS#7 contents.
PKCS7 = bytes.fromhex("2a864886f70d0107")
#: Beginnings of the object identifiers of password-based encryption schemes.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run, with or without padding."""
    run = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fits(raw: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> bool:
    """Whether raw[at:end] is a row of DER values whose lengths, nested ones too, fill it exactly."""
    end = len(raw) if end is None else end
    if depth > 12:
        return False
    while at < end:
        if end - at < 2:
            return False
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return False
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if size > end - at or tag & 0x20 and not der_fits(raw, at, at + size, depth + 1):
            return False
        at += size
    return True


def der_values(raw: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the values in a row of DER whose lengths are known to fit."""
    out, at = [], 0
    while at < len(raw):
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def is_private_der(raw: bytes) -> bool:
    """Whether DER holds a private key of one of the forms that the module names."""
    if raw[0] != SEQUENCE or not der_fits(raw):
        return False
    outer = der_values(raw)
    if len(outer) != 1:
        return False
    fields = der_values(outer[0][1])
    tags = [t for t, _ in fields]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        scheme = der_values(fields[0][1])
        return bool(scheme) and scheme[0][0] == OID and scheme[0][1].startswith(PASSWORD_SCHEMES) and len(fields[1][1]) >= MATERIAL
    if len(fields) < 2 or tags[0] != INTEGER:
        return False
    version = fields[0][1]
    if all(t == INTEGER for t in tags):
        numbers = [int.from_bytes(v, "big", signed=True) for _, v in fields]
        return all(v for _, v in fields) and min(numbers) >= 0 and (is_rsa(numbers) or is_dsa(numbers))
    if version in VERSIONS and tags[1:3] == [SEQUENCE, OCTETS] and all(t in CONTEXT for t in tags[3:]):  # PKCS#8
        algorithm = der_values(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(fields[2][1]) >= MATERIAL
    if version == b"\1" and tags[1] == OCTETS and len(tags) > 2 and all(t in CONTEXT for t in tags[2:]):  # SEC1
        return len(fields[1][1]) >= MATERIAL
    if version == b"\3" and tags[1:] in ([SEQUENCE], [SEQUENCE, SEQUENCE]):  # PKCS#12
        content = der_values(fields[1][1])
        return [t for t, _ in content] == [OID, 0xA0] and content[0][1].startswith(PKCS7) and len(content[1][1]) >= MATERIAL
    return False


def is_rsa(numbers: list[int]) -> bool:
    """version, modulus, public exponent, private exponent, two primes, two exponents, coefficient; further primes in version 1."""
    if len(numbers) < 9 or numbers[0] not in (0, 1) or (numbers[0] == 0) != (len(numbers) == 9):
        return False
    modulus, public, private, p, q = numbers[1:6]
    odd = modulus & public & p & q & 1
    whole = numbers[0] == 1 or 0 <= p.bit_length() + q.bit_length() - modulus.bit_length() <= 1
    return bool(odd) and modulus.bit_length() >= 8 * MATERIAL and 3 <= public < modulus and 1 < private < modulus and whole


def is_dsa(numbers: list[int]) -> bool:
    """version, prime, a prime that divides the one less, generator, public and private value."""
    if len(numbers) != 6 or numbers[0] != 0:
        return False
    p, q, g, y, x = numbers[1:]
    return bool(p & q & 1) and p.bit_length() >= 8 * MATERIAL and 1 < q < p and (p - 1) % q == 0 and 1 < g < p and 0 < y < p and 0 < x < q


def is_openssh(raw: bytes) -> bool:
    """Whether all fields of an OpenSSH key file are there, to the last byte."""
    at = 15

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        own, at = raw[at + 4 : at + 4 + size], at + 4 + size
        return own

    cipher, derivation, options = field(), field(), field()
    if cipher is None or derivation is None or options is None or at + 4 > len(raw):
        return False
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64 or any(not field() for _ in range(keys)):
        return False
    private = field()
    return private is not None and len(private) >= MATERIAL and at == len(raw) and (cipher != b"none" or private[:4] == private[4:8])


def is_key(raw: bytes | None) -> str | None:
    """'der' or 'openssh' for a private key of that form, else None."""
    if not raw or len(raw) < 16:
        return None
    if raw.startswith(b"openssh-key-v1\0"):
        return "openssh" if is_openssh(raw) else None
    return "der" if is_private_der(raw) else None


def pem_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of PEM blocks that hold a private key."""
    out = []
    for m in PEM.finditer(text):
        stop, close = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop < 0 or not text.startswith(close, stop):
            continue
        body = re.sub(r"\\r|\\n", "\n", text[m.end() : stop])
        head, _, rest = body.rpartition("\n\n") if "Proc-Type:" in body else ("", "", body)
        raw = decoded(re.sub(r"\s", "", rest))
        encrypted = "ENCRYPTED" in head and "DEK-Info:" in head and raw is not None and len(raw) >= MATERIAL and len(raw) % 8 == 0
        if encrypted or is_key(raw):
            out.append((m.start(), stop + len(close)))
    return out


def is_token(run: str) -> bool:
    """Whether the first two dotted parts are JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(decoded(x) or b"") for x in run.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the three plain patterns find."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose structure is that of a key or a signed token."""
    out = []
    if "ey" in text:
        out += [(m.start(), KINDS.index("token"), m.end()) for m in TOKEN.finditer(text) if is_token(m[0])]
    if "-----BEGIN " in text:
        out += [(start, KINDS.index("pem"), end) for start, end in pem_spans(text)]
    for pattern, decode in ((RUN64, decoded), (RUN16, bytes.fromhex)):
        for m in pattern.finditer(text):
            if kind := is_key(decode(m[0])):
                out.append((m.start(), KINDS.index(kind), m.end()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` and secret_base, secret_confirmed: the spans as array<struct<kind, start, end>> by start, then kind; code points, end exclusive.

    Columns of ``docs`` with these two names are replaced; without keep_text the text isn't sent back.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.drop("secret_base", "secret_confirmed")
    names = [c for c in docs.columns if keep_text or c != text_col]

    def per_batch(batches):
        for batch in parts(batches, column=text_col):
            found = [[], []]
            for text in batch.column(text_col).to_pylist():
                for out, look in zip(found, (base_spans, confirmed_spans), strict=True):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(look(text))] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *(pa.array(x, kind) for x in found)], [*names, "secret_base", "secret_confirmed"])

    schema = docs.select(names).selectExpr("*", f"cast(null as {span}) secret_base", f"cast(null as {span}) secret_confirmed").schema
    return docs.mapInArrow(per_batch, schema)


def scan_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed; the texts stay out of the result."""
    found = scan(docs.select("doc_id", "text"), keep_text=False)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    both = F.transform(F.array_sort(F.transform(F.concat("secret_base", "secret_confirmed"), lambda x: F.struct(x.start, order[x.kind].alias("o"), x.end, x.kind))), lambda x: F.struct(x.kind, x.start, x.end))
    counts = [F.expr(f"cast(size(filter(secret_base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("secret_base")), 256).alias("base_sha256"), joined(both).alias("spans"), F.size("secret_confirmed").cast("long").alias("n_confirmed"))
