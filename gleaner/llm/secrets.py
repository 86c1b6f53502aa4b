"""Secret scans with structural confirmation.

Cheap patterns find what looks like a secret. Long base64 and hex runs are reported as keys or
tokens only if what they decode to has the structure it must have: a DER sequence whose nested
lengths add up, the length-prefixed fields of an SSH key, a signed token whose header is JSON
with an algorithm.

Where a key ends is read from its lengths and not from the text around it: words on the lines after
an unpadded key are not part of it, and a last line may have any number of characters. The end must
be the end of a line. Lines may be indented, and their ends may be written out as backslash and n.

Defined cases: a null text is scanned as an empty one; ids may be null or repeat, every row gives
one row; further columns are ignored; an empty table gives an empty one. Texts are scanned whole.
Two spans of one kind never overlap; spans of different kinds may.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["assign", "access", "hex", "der_key", "ssh_key", "signed_token"]
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ that have 32 characters or more
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
# Base64 in one piece or in lines, as key files have it.
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{20,}}(?:{_BREAK}[A-Za-z0-9+/]+)*")
_BREAKS = re.compile(_BREAK)
_PADS = [re.compile(rf"(?:(?:{_BREAK})?=){{0,{n}}}") for n in range(3)]
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}")

_SSH_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$")
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"sk-ssh-ed25519@openssh.com": 3} | {
    b"ecdsa-sha2-nistp" + bits: 3 for bits in (b"256", b"384", b"521")
}
_SSH_FILE = b"openssh-key-v1\x00"
_TAG = 16  # bytes that some ciphers add behind the last field

Span = tuple[str, int, int]


# --- structure ------------------------------------------------------------------------------


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the item at ``at``, or None if its length is wrong."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        length, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + length) if at + length <= end else None


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    items = []
    while at < end:
        item = _der_item(data, at, end)
        if item is None:
            return None
        items.append(item)
        at = item[2]
    return items


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one DER sequence, filled exactly, of a shape that keys have.

    Those are a version followed by numbers, by an algorithm and a wrapped key, or by a raw key
    string (private keys), and an algorithm followed by a bit string (public keys).
    """
    outer = _der_item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    items = _der_items(data, outer[1], outer[2])
    if not items:
        return False
    tags = [tag for tag, _, _ in items]
    if tags[0] == 0x02:
        version = items[0][2] - items[0][1] == 1
        numbers = len(tags) >= 6 and all(t == 0x02 for t in tags)
        wrapped = len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and _is_algorithm(data, items[1])
        raw = len(tags) >= 2 and tags[1] == 0x04 and items[1][2] - items[1][1] >= 16
        return version and (numbers or wrapped or raw)
    return tags == [0x30, 0x03] and _is_algorithm(data, items[0])


def _is_algorithm(data: bytes, item: tuple[int, int, int]) -> bool:
    inner = _der_items(data, item[1], item[2])
    return bool(inner) and inner[0][0] == 0x06


class Written:
    """Base64 characters in lines; reads what is written from the start of a line on."""

    def __init__(self, text: str, start: int, end: int):
        breaks = [m.span() for m in _BREAKS.finditer(text, start, end)]
        self.starts = [start, *(b for _, b in breaks)]
        self.ends = [*(a for a, _ in breaks), end]
        self.body = "".join(text[a:b] for a, b in zip(self.starts, self.ends, strict=True))
        self.line_at = {0: 0}  # by characters before it
        for line, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            self.line_at[next(reversed(self.line_at)) + b - a] = line + 1
        self.before = list(self.line_at)

    def read(self, line: int, first: int, end: int) -> bytes:
        """Bytes ``first`` to ``end`` of what begins with the line, fewer where it ends."""
        at, skip = self.before[line], first // 3
        piece = self.body[at + 4 * skip : at + 4 * -(-end // 3)]
        return _base64(piece[: len(piece) - (len(piece) % 4 == 1)])[first - 3 * skip : end - 3 * skip]

    def has(self, line: int, size: int) -> bool:
        return self.before[line] + -(-4 * size // 3) <= len(self.body)

    def line_after(self, line: int, size: int) -> int | None:
        """The line after ``size`` bytes that begin with the line, or None if they do not end with one."""
        return self.line_at.get(self.before[line] + -(-4 * size // 3))


def key_in(w: Written, line: int) -> tuple[str, int] | None:
    """(kind, bytes) of the key that begins with the line, if there is one."""
    head = w.read(line, 0, 80)
    outer = _der_item(head, 0, 1 << 40)
    if outer and outer[0] == 0x30:
        whole = w.line_after(line, outer[2]) is not None and is_der_key(w.read(line, 0, outer[2]))
        return ("der_key", outer[2]) if whole else None
    size = _ssh_file(w, line) if head.startswith(_SSH_FILE) else _ssh_key(w, line)
    return ("ssh_key", size) if size else None


def _field(w: Written, line: int, at: int) -> int | None:
    """Where the length-prefixed field at ``at`` ends, if it is all there."""
    size = w.read(line, at, at + 4)
    end = at + 4 + int.from_bytes(size, "big")
    return end if len(size) == 4 and w.has(line, end) else None


def _ssh_key(w: Written, line: int) -> int | None:
    """Bytes of length-prefixed fields, the first naming a key type, that end with a line."""
    at, kind, found = 0, None, {}
    for count in itertools.count(1):
        end = _field(w, line, at)
        if end is None:
            break
        name = w.read(line, at + 4, min(end, at + 68))
        if count == 1 and not _SSH_TYPE.match(name):
            break
        if found and _SSH_TYPE.match(name):  # the next key
            break
        kind, at = kind or name, end
        if count > 1 and w.line_after(line, at) is not None:
            found[count] = at
        if count == _SSH_FIELDS.get(kind) and count in found:
            return at
    return max(found.values(), default=None)


def _ssh_file(w: Written, line: int) -> int | None:
    """Bytes of a private key file: three fields, how many keys, their public fields and a private one.

    One that breaks off after the three fields is taken to fill all lines.
    """
    at = len(_SSH_FILE)
    for _ in range(3):
        at = _field(w, line, at)
        if at is None:
            return None
    keys, at = w.read(line, at, at + 4), at + 4
    for _ in range(int.from_bytes(keys, "big") + 1):
        end = _field(w, line, at)
        if end is None:
            break
        at = end
    else:
        for size in (at, at + _TAG):
            if w.line_after(line, size) is not None:
                return size
    return (len(w.body) - w.before[line]) * 3 // 4


def is_signed_token(token: str) -> bool:
    """Three parts, of which the first decodes to a JSON header that names an algorithm."""
    head, body, signature = token.split(".")
    try:
        header = json.loads(_base64(head, url=True))
        _base64(body, url=True)
        _base64(signature, url=True)
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _base64(text: str, url: bool = False) -> bytes:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        raise ValueError("no base64 has this length")
    padded = text + "=" * (-len(text) % 4)
    try:
        return base64.b64decode(padded, b"-_" if url else None, validate=True)
    except binascii.Error as e:
        raise ValueError(str(e)) from e


# --- spans ----------------------------------------------------------------------------------


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[Span]:
    found: list[Span] = []
    for m in _BASE64.finditer(text):
        escaped = text[m.start() - 1 : m.start()] == "\\" and text[m.start()] in "nrt"
        w, line = Written(text, m.start() + escaped, m.end()), 0
        while line < len(w.starts):
            first, line = line, line + 1
            # Every key encoding here starts with a DER sequence, a field length or the file's name.
            if text[w.starts[first]] not in "MAb" or w.ends[first] - w.starts[first] < 20:
                continue
            kind, size = key_in(w, first) or ("", 0)
            if -(-4 * size // 3) >= 40:
                line = w.line_after(first, size) or len(w.starts)
                end = w.ends[line - 1]
                found.append((kind, w.starts[first], _PADS[-size % 3].match(text, end).end()))
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der_key", *m.span()))
    for m in _TOKEN.finditer(text):
        if is_signed_token(m[0]):
            found.append(("signed_token", *m.span()))
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in in_order(spans))


def scan(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, spans, base) per row: every span as array<struct<kind, start, stop>>, in code points."""
    kind = docs.schema[identity].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            base, added = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                base.append([dict(kind=k, start=a, stop=b) for k, a, b in in_order(base_spans(t))])
                added.append([dict(kind=k, start=a, stop=b) for k, a, b in in_order(confirmed_spans(t))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, to), pa.array(added, to)], [identity, "base", "confirmed"]
            )

    return docs.select(identity, text).mapInArrow(found, f"`{identity}` {kind}, base {span}, confirmed {span}")


def report(scanned: DataFrame, identity: str = "doc_id") -> DataFrame:
    """The spans counted and written out, one row per document."""
    from pyspark.sql import functions as F

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    ranked = F.sort_array(
        F.transform(
            F.concat("base", "confirmed"),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(F.lit(KINDS), s["kind"]).alias("rank"),
                s["kind"].alias("kind"),
                s["stop"].alias("stop"),
            ),
        )
    )
    return scanned.select(
        identity,
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        line(ranked).alias("spans"),
        F.size("confirmed").cast("bigint").alias("n_confirmed"),
    )
