"""Secret scans: pattern matches plus structural confirmation.

Three base patterns (assignments, access keys, hex runs) are reported as they
stand.  On top, base64 and hex candidates are decoded, and those whose bytes
parse as a key encoding (nested DER lengths, SSH length-prefixed fields, PEM
armour, also with escaped line ends or head lines and an encrypted body) or
whose text parses as a signed token (JSON header with ``alg``, looked for at each
place that may begin one) add spans of their own.

Defined cases: a null or empty text has no spans; repeated rows are scanned
each, whatever their ids, which may be null; texts may be of any length; a span is ``kind:start:end`` in code points, end exclusive; spans are
ordered by start, then by the order of KINDS, then by end.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import per_text, table, texts_of

KINDS = ("assign", "access", "hex", "jwt", "pem", "sshkey", "der")
BASE = 3

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: A base pattern drops short matches; for these two, which match whole runs, a lower bound on the run says the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Base64 of a brace and what may follow it in JSON (a quote and what begins a name, or blanks): how the header of a signed token starts.
HEADERS = ("eyI", "eyJ", "eyL", "eyA", "ewo", "ew0", "ewk")
HEADER = re.compile("|".join(HEADERS))
JSON, BLANK_END = json.JSONDecoder(), re.compile(r"[ \t\r\n]*\Z")
#: A brace and a first name: a cheap test before JSON is read, whose errors count the lines before them.
FIRST_NAME = re.compile(r'\{[ \t\r\n]*"(?:[^"\\\x00-\x1F]|\\.)*+"[ \t\r\n]*:')
#: A dotted run of three parts; the next may begin at its second part, so it is looked for at every part.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*))")
#: The body reaches up to the next five dashes; what it holds is looked at by armoured().
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY|CERTIFICATE)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
#: Ends of lines as strings in source code and JSON spell them, and what JSON writers escape in base64.
ESCAPES = ((re.compile(r"\\+r\\+n|\\+[rnt]|\\+u000[aAdD9]|\\+(?=\s)"), "\n"), (re.compile(r"\\+/"), "/"), (re.compile(r"\\+u002[bB]"), "+"), (re.compile(r"\\+u002[fF]"), "/"), (re.compile(r"\\+u003[dD]"), "="))
#: A line of the head of a PEM body; base64 has no colon.
HEAD_LINE = re.compile(r"^[\x20\t]*[A-Za-z][A-Za-z0-9-]*:[^\r\n]*", re.MULTILINE)
DEK = re.compile(r"^[\x20\t]*DEK-Info:[\x20\t]*([A-Za-z0-9-]+)[\x20\t]*(?:,[\x20\t]*[0-9A-Fa-f]*)?[\x20\t]*\r?$", re.MULTILINE)
BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_BLOB = re.compile(r"[0-9A-Fa-f]{40,}")
ASSIGN_MIN, DER_MIN = 8, 24
SSH_MAGIC = b"openssh-key-v1\x00"
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def decode64(text: str) -> bytes | None:
    """Base64, either alphabet, padding optional; None where it does not decode."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER item at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if size < 0x80 or width > 1 and size >> 8 * (width - 1) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, whose members nest exactly, with an INTEGER, OID or string of key size within."""
    top = der_item(data, 0, len(data))
    if len(data) < DER_MIN or not top or top[0] != 0x30 or top[2] != len(data):
        return False
    found, work = set(), [(top[1], top[2], 0)]
    while work:
        at, end, depth = work.pop()
        while at < end:
            item = der_item(data, at, end)
            if not item:
                return False
            tag, start, stop = item
            if tag in (0x30, 0x31, 0xA0, 0xA1) and depth < 8:
                work.append((start, stop, depth + 1))
            elif tag not in (0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x17, 0x18, 0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3):
                return False
            if stop - start >= 16 or tag == 0x06:
                found.add(tag)
            at = stop
    return bool(found & {0x02, 0x03, 0x04, 0x06})


def ssh_strings(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed strings from ``at`` on, ``most`` of them or as many as there are, and where they end; None where a length leads beyond the data."""
    found: list[bytes] = []
    while len(found) != most and (most is not None or at < len(data)):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        found.append(data[at : at + size])
        at += size
    return found, at


def is_ssh_public(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of which names a kind of key."""
    fields = ssh_strings(data, 0)
    return fields is not None and len(fields[0]) >= 2 and fields[0][0] in SSH_NAMES


def is_ssh_private(data: bytes) -> bool:
    """An OpenSSH private key: cipher, derivation and its options, the number of keys, their public parts, and the private part.

    The private part ends the data.  Without a cipher it begins with one number twice and then names the first key's kind;
    with one it fills whole blocks.
    """
    head = ssh_strings(data, len(SSH_MAGIC), 3)
    if head is None or head[1] + 4 > len(data):
        return False
    (cipher, derivation, options), at = head
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= len(data) // 8 or (cipher == b"none") != (derivation == b"none") or (cipher == b"none") != (options == b""):
        return False
    body = ssh_strings(data, at + 4, keys + 1)
    if body is None or not all(is_ssh_public(x) for x in body[0][:-1]):
        return False
    secret = body[0][-1]
    if len(secret) < 8 or len(secret) % 8:
        return False
    if cipher != b"none":
        # A cipher may append a tag of its own after the private part.
        return len(data) - body[1] in (0, 16)
    kind = ssh_strings(secret, 8, 1)
    return body[1] == len(data) and secret[:4] == secret[4:8] and kind is not None and kind[0][0] in SSH_NAMES


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public one."""
    return is_ssh_private(data) if data.startswith(SSH_MAGIC) else is_ssh_public(data)


def is_object(part: str, key: str | None = None) -> bool:
    """Whether base64url text is a JSON object, with ``key`` if given."""
    raw = decode64(part)
    if not raw or raw[:1] != b"{":
        return False
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (key is None or key in value)


def headers(part: str) -> Iterator[int]:
    """Places from which on base64url text reads as one JSON object; each alignment is decoded once, and what isn't JSON ends at its first wrong byte."""
    plain: dict[int, str | None] = {}
    for h in HEADER.finditer(part):
        shift = h.start() % 4
        if shift not in plain:
            raw = decode64(part[shift:])
            plain[shift] = raw and raw.decode("latin-1")
        at = (h.start() - shift) // 4 * 3
        if not plain[shift] or not FIRST_NAME.match(plain[shift], at):
            continue
        try:
            _, stop = JSON.raw_decode(plain[shift], at)
        except (ValueError, RecursionError):
            continue
        if BLANK_END.match(plain[shift], stop):
            yield h.start()


def tokens(text: str) -> set[tuple[int, int]]:
    """Spans of signed tokens, whatever stands before the header, dotted or not."""
    found = set()
    for m in DOTTED.finditer(text):
        if not is_object(m.group(2)):
            continue
        for at in headers(m.group(1)):
            start = m.start(1) + at
            if is_object(text[start : m.end(1)], "alg"):
                found.add((start, m.end(3)))
                break
    return found


def armoured(body: str) -> bool:
    """Whether the body of PEM armour is a key: DER, SSH, or whole blocks of a cipher that a head line names."""
    for pattern, plain in ESCAPES if "\\" in body else ():
        body = pattern.sub(plain, body)
    cipher = DEK.search(body)
    raw = decode64(HEAD_LINE.sub("", body) if ":" in body else body)
    if not raw:
        return False
    if cipher:
        return len(raw) >= DER_MIN and (len(raw) % 8 == 0 or not cipher.group(1).upper().endswith(("CBC", "ECB")))
    return is_der_key(raw) or is_ssh_key(raw)


WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = 32
OUTSIDE = np.ones(256, bool)
OUTSIDE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = False


def has_run(text: str) -> bool:
    """Whether RUN characters of base64 or hex stand together: a cheap test before the patterns for such runs."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return bool((np.diff(np.flatnonzero(OUTSIDE[data]), prepend=-1, append=data.size) > RUN).any())


def base_spans(text: str, run: bool | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found, lowered = [], text.lower()
    if any(w in lowered for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if has_run(text) if run is None else run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def structural_spans(text: str, run: bool | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes and parses."""
    found = set()
    if any(x in text for x in HEADERS):
        found |= {(start, 3, end) for start, end in tokens(text)}
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if armoured(m.group(2)):
                found.add((m.start(), 4, m.end()))
    if not (has_run(text) if run is None else run):
        return sorted(found)
    for m in BLOB.finditer(text):
        raw = decode64(m.group())
        if raw and is_ssh_key(raw):
            found.add((m.start(), 5, m.end()))
        elif raw and is_der_key(raw):
            found.add((m.start(), 6, m.end()))
    for m in HEX_BLOB.finditer(text):
        raw = binascii.unhexlify(m.group()[: len(m.group()) // 2 * 2])
        if is_der_key(raw):
            found.add((m.start(), 6, m.end()))
    return sorted(found)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, ``base_spans`` and ``spans`` as text."""

    def work():
        def apply(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for text in texts:
                run = has_run(text)
                base = base_spans(text, run)
                kinds = [k for _, k, _ in base]
                row = (*(kinds.count(k) for k in range(BASE)), render(base), render(sorted(base + structural_spans(text, run))))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return apply

    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())]
    return per_text(texts_of(docs, id_col, text_col), work, fields, "n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for start, end in joined([(s, e) for s, _, e in sorted(base_spans(text) + structural_spans(text))]):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in its text replaced; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact_text(t, mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """The base patterns word for word, for tests."""
    text = text or ""
    found = []
    patterns = (ASSIGN.pattern, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for kind, (pattern, group, least) in enumerate(zip(patterns, (2, 0, 0), (8, 16, 32), strict=True)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return sorted(found)

