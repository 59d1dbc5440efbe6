"""Secrets in texts: fixed patterns, and encoded candidates confirmed by their structure.

Candidates in base64 or hex are decoded; a key encoding must parse to its last byte (nested DER
lengths, OpenSSH fields) and a signed token must carry a header that names an algorithm. A key may
start anywhere in a run of such characters and be wrapped over lines; its own lengths give its end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlore.llm.textkit import slices

# The patterns the result is defined by.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "pem")

_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
# DER sequences and the magic word of OpenSSH as they begin in base64 and hex
_KEY64 = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{8})|b3BlbnNzaC1rZXktdjEA")
_KEY16 = re.compile(r"30(?:8[1-4]|[1-7][0-9a-f])(?=[0-9a-f]{8})|6f70656e7373682d6b65792d763100", re.I)
_DIGITS = {4: re.compile(r"[A-Za-z0-9+/_-]+"), 2: re.compile(r"[0-9A-Fa-f]+")}
_WRAP = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*")
_DER_TAGS = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18, 0x30, 0x31}
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long, bounds array<int>"
)


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and start of the value whose length byte is at ``at``; the shortest form only."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    count = first & 0x7F
    if not 1 <= count <= 4 or at + 1 + count > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + count], "big")
    return (size, at + 1 + count) if size >= 0x80 and size >> (8 * (count - 1)) else None


def _der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]`` exactly, else None."""
    out = []
    while start < end:
        if data[start] & 0x1F == 0x1F or (data[start] < 0x80 and data[start] not in _DER_TAGS):
            return None
        found = _der_length(data, start + 1)
        if found is None or found[1] + found[0] > end:
            return None
        out.append((data[start], found[1], found[1] + found[0]))
        start = found[1] + found[0]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills the bytes and has the parts of a private key.

    After a version of 0 or 1: five more numbers at least (RSA, DSA), an octet string (EC), or an algorithm and an
    octet string (PKCS#8); without one: a cipher and an octet string (encrypted PKCS#8). Public keys and
    certificates hold bit strings or fewer numbers and are none.
    """
    top = _der_fields(data, 0, len(data)) if len(data) >= 24 and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    parts = _der_fields(data, top[0][1], top[0][2])
    if not parts:
        return False
    tags = [tag for tag, _, _ in parts]
    if _is_version(data, parts[0]):
        numbers = next((i for i, tag in enumerate(tags) if tag != 0x02), len(tags))
        named = len(parts) > 2 and tags[1] == 0x30 and _names_algorithm(data, parts[1]) and tags[2] == 0x04
        curve = len(parts) > 1 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16
        held = numbers >= 6 and parts[1][2] - parts[1][1] >= 16 or named or curve
    else:
        held = tags == [0x30, 0x04] and _names_algorithm(data, parts[0]) and parts[1][2] - parts[1][1] >= 16
    pending = [p for p in parts if p[0] & 0x20] if held else []
    while pending:
        inner = _der_fields(data, pending[-1][1], pending.pop()[2])
        if inner is None:
            return False
        pending += [p for p in inner if p[0] & 0x20]
    return held


def _is_version(data: bytes, part: tuple[int, int, int]) -> bool:
    return part[0] == 0x02 and part[2] - part[1] == 1 and data[part[1]] in (0, 1)


def _names_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = _der_fields(data, part[1], part[2])
    return bool(inner) and inner[0][0] == 0x06


MAGIC = b"openssh-key-v1\0"


def openssh_length(read: Callable[[int], bytes]) -> int | None:
    """Bytes of the complete private key of OpenSSH that ``read(n)``, the first n bytes if there are so many, begins with.

    A magic word, then length-prefixed fields: three names, as many public keys as told, the private part.
    """
    if not read(len(MAGIC)).startswith(MAGIC):
        return None
    at, strings = len(MAGIC), 3
    for part in range(2):
        for _ in range(strings):
            data = read(at + 4)
            if len(data) < at + 4:
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if part == 0:
            data = read(at + 4)
            if len(data) < at + 4:
                return None
            strings, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
    return at if len(read(at)) >= at else None


def is_openssh_key(data: bytes) -> bool:
    return openssh_length(lambda n: data[:n]) is not None


def _decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


_JSON = json.JSONDecoder()


def _header_start(text: str) -> int | None:
    """Where the header of a signed token begins that the base64 ``text`` ends with: an object that names an algorithm.

    Each of the four alignments is decoded once. Objects are parsed from the left; what fails or ends early rules out
    the objects inside it as well, so the work is linear.
    """
    starts = []
    for shift in range(min(4, len(text))):
        data = _decode64(text[shift:])
        if data is None:
            continue
        shown = data.decode("latin-1")
        if not shown.rstrip(" \t\r\n").endswith("}"):
            continue
        at = shown.find("{")
        while at >= 0:
            try:
                header, end = _JSON.raw_decode(shown, at)
            except json.JSONDecodeError as error:
                at = shown.find("{", max(at + 1, error.pos))
                continue
            except RecursionError:
                at = shown.find("{", at + 1)
                continue
            blank = len(shown[:at]) - len(shown[:at].rstrip(" \t\r\n"))
            first = -(-(at - blank) // 3) * 3  # a header begins with the object, or with white space before it, at a group of four digits
            if not shown[end:].strip(" \t\r\n") and first <= at and isinstance(header.get("alg"), str) and _is_utf8(data[at:end]):
                starts.append(shift + first // 3 * 4)
                break
            at = shown.find("{", end)
    return min(starts, default=None)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    lower = text.lower()
    out = []
    if any(k in lower for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _gather(text: str, at: int, bits: int, most: int) -> tuple[str, int]:
    """Up to ``most`` digits that begin at ``at``, over line ends, and where they stop."""
    out, held, wrap = [], 0, None
    while m := _DIGITS[bits].match(text, start := wrap.end() if wrap else at, start + most - held):
        out.append(m.group())
        held, at = held + m.end() - m.start(), m.end()
        wrap = None if held == most else _WRAP.match(text, at)
        if wrap is None:
            break
    return "".join(out), at


def _bytes_of(digits: str, bits: int) -> bytes:
    if bits == 2:
        return bytes.fromhex(digits[: len(digits) // 2 * 2])
    return _decode64(digits[:-1] if len(digits) % 4 == 1 else digits) or b""


def _key_at(text: str, at: int, bits: int) -> tuple[str, int] | None:
    """Kind and end of the key whose digits begin at ``at``; 4 base64 or 2 hex digits hold 3 or 1 bytes.

    Its first bytes decide whether more is decoded, and its lengths how much.
    """
    digits = lambda size: -(-size * 4 // 3) if bits == 4 else 2 * size

    def read(size: int) -> bytes:
        if digits(size) > len(text) - at:
            return b""
        return _bytes_of(_gather(text, at, bits, digits(size))[0], bits)[:size]

    if text[at] in "b6":
        size, kind = openssh_length(read), "openssh"
        if size is None:
            return None
    else:
        head = read(min(15, (len(text) - at) * bits // (6 if bits == 4 else 4)))
        found = _der_length(head, 1)
        if found is None or sum(found) < 24 or not _opens_key(head[found[1] :]):
            return None
        size, kind = sum(found), "der"
        if not is_der_key(read(size)):
            return None
    end = _gather(text, at, bits, digits(size))[1]
    while bits == 4 and digits(size) % 4 and end < len(text) and text[end] == "=" and text[end - 2 : end] != "==":
        end += 1
    return kind, end


def _opens_key(head: bytes) -> bool:
    """The first bytes inside a private key: a version of one byte, or a cipher's name."""
    if head[:1] == b"\x02":
        return head[1:2] == b"\x01" and head[2:3] in (b"\0", b"\1")
    if head[:1] != b"\x30":
        return False
    found = _der_length(head, 1)
    return found is not None and (found[1] >= len(head) or head[found[1]] == 0x06)


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Encoded secrets whose decoded structure is that of a key or a signed token."""
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = _decode64(re.sub(r"\s+", "", m.group(2)))
            if data and (is_der_key(data) or is_openssh_key(data)):
                out.append(("pem", *m.span()))
    for m in _ENCODED.finditer(text):
        # keys start with a sequence tag or the magic word, so other first letters decode to neither
        head = m.group()[:1]
        data = _decode64(m.group()) if head in ("M", "b") else None
        if data and is_der_key(data):
            out.append(("der", *m.span()))
        elif data and is_openssh_key(data) and not _key_at(text, m.start(), 4):
            out.append(("openssh", *m.span()))
    for m in _HEX_ANY.finditer(text):
        if m.group().startswith("30") and is_der_key(bytes.fromhex(m.group())):
            out.append(("der", *m.span()))
    whole = [x[1:] for x in out]
    for bits, start in ((4, _KEY64), (2, _KEY16)):
        at = 0
        while m := start.search(text, at):
            at = m.start() + 1
            inside = [b for a, b in whole if a <= m.start() < b]
            found = None if inside else _key_at(text, m.start(), bits)
            if inside:
                at = max(inside)
            elif found:
                out.append((found[0], m.start(), found[1]))
                at = found[1]
    m = _JWT.search(text)
    while m:
        start = _header_start(m.group(1))
        if start is not None:
            out.append(("jwt", m.start() + start, m.end()))
        m = _JWT.search(text, m.end(1) if start is None else m.end())
    return out


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each ordered by start, then kind."""
    text = text or ""
    base = sorted(base_spans(text), key=_order)
    return base, sorted({*base, *confirmed_spans(text)}, key=_order)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for whole in batches:
        for batch in slices(whole, "text"):
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed", "bounds")}
            for text in batch.column("text").to_pylist():
                base, spans = scan_text(text)
                for kind in ("assign", "access", "hex"):
                    rows[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
                rows["n_confirmed"].append(len(spans) - len(base))
                rows["bounds"].append([x for _, a, b in spans for x in (a, b)])
            schema = schema or pa.schema(
                [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64()), ("bounds", pa.list_(pa.int32()))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(v, schema.field(k).type) for k, v in rows.items())], schema=schema
            )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts by kind, digest of the base spans, and all spans.

    Null text counts as empty and has no span. Texts of any length are scanned whole, in linear time. Repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def mask(text: str | None) -> str | None:
    """The text with every secret replaced by a mark; overlapping spans are masked together."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in scan_text(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in its texts masked and ``n_chars`` kept in step; no row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [mask(t) for t in batch.column("text").to_pylist()]
                columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
