"""Secret scans: a recursive decoding worklist over whole texts.

Layer 0 is the text itself. Each layer is scanned for secrets, then searched for encoded segments (percent
escapes, \\u/\\x/&#; escapes, base64 with optional gzip, zlib or raw bytes); each decoded segment is a new layer, and so is its line with
what is decoded put in its place (findings do not go over line ends), until no layer yields another. Each content is scanned and searched once, so cycles and repeats end; each place where
it occurs carries a map from its code points to those of the layer around it. Findings go outwards over all those
places, so that every occurrence of a secret has a span in the original; base findings of layer 0 always stay.

Defined cases: a null text is an empty one and has no spans; a repeated row is scanned again; escapes that
decode to nothing readable are no layer. A packed layer of any size is read, all members of it, in blocks of `BLOCK`
bytes that overlap by `OVERLAP`, one at a time; only a secret or an encoding longer than that may be cut.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

KINDS = ("assign", "access", "hex")
# The contract's patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 characters or more
ANY_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Runs are taken whole, so that each character is looked at once, and decoded if an escape is in them.
PERCENT = re.compile(r"[A-Za-z0-9_.~+/=:;,?&@!*'()$#\[\]%-]+")
PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
#: Characters of both alphabets; lines of 16 or more go on in the next line, also where the line end is written \n.
WRAP = r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n)"
BASE64 = re.compile(rf"(?:[A-Za-z0-9+/_-]{{16,}}{WRAP})*[A-Za-z0-9+/_-]+={{0,2}}")
LINE_END = re.compile(WRAP)
#: Characters that a place in a run is judged by.
PROBE = 16
JOINS = str.maketrans("", "", "-_/+")
SAFE = str.maketrans("-_", "+/")
#: Bytes of a packed layer that are scanned at a time, and what a block has of the one before.
BLOCK, OVERLAP = 1 << 20, 1 << 16


Segment = tuple[str, list[int], list[int]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the base findings."""
    out = []
    if ANY_KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _utf8(data: bytes) -> str | None:
    """The bytes as text, if they are readable UTF-8."""
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not s or sum(not (c.isprintable() or c in "\t\r\n") for c in s) * 20 > len(s):
        return None
    return s


def _inflate(data: bytes) -> Iterator[tuple[bytes, int]]:
    """What is packed, in pieces of up to `BLOCK` bytes and member by member, with the bytes of `data` read so far; what
    comes before a stream breaks off counts too."""
    used = 0
    while _packed(data[used : used + 2]):
        d = zlib.decompressobj(31 if data[used] == 0x1F else 15)
        rest = data[used:]
        while not d.eof:
            try:
                out = d.decompress(rest, BLOCK)
            except zlib.error:
                return
            rest = d.unconsumed_tail
            if not out and not rest and not d.eof:
                return
            used = len(data) - len(d.unused_data if d.eof else rest)
            yield out, used


def _blocks(pieces: Iterator[tuple[bytes, int]]) -> Iterator[tuple[bytes, int]]:
    """Blocks of more than `BLOCK` bytes but for the last, each beginning with the `OVERLAP` bytes before it."""
    held, fresh, used = bytearray(), 0, 0
    for out, used in pieces:
        held += out
        fresh += len(out)
        if fresh > BLOCK:
            yield bytes(held), used
            del held[:-OVERLAP]
            fresh = 0
    if fresh:
        yield bytes(held), used


def _kinds(block: bytes) -> set[int]:
    """Kinds of the secrets in a part of a text, whose first and last characters may be cut."""
    while block and block[0] & 0xC0 == 0x80:
        block = block[1:]
    t = block.decode("utf-8", "replace")
    bad = t.count("\ufffd") + sum(not (c.isprintable() or c in "\t\r\n") for c in t)
    return set() if bad * 20 > len(t) else {k for _, _, k in all_spans(t)[1]}


def _percent(s: str) -> Segment:
    """Decoded text with, for each character, where its source begins and ends in `s`; bytes that are no UTF-8 become one
    mark each, and what is round them still counts."""
    data, at, last = bytearray(), [], 0
    for m in [*PERCENT_BYTE.finditer(s), None]:
        end = m.start() if m else len(s)
        data += s[last:end].encode()  # a run holds ASCII only
        at += [(i, i + 1) for i in range(last, end)]
        if m:
            data.append(int(m[0][1:], 16))
            at.append((end, last := m.end()))
    text = bytes(data).decode("utf-8", "surrogateescape")
    starts, ends, k = [], [], 0
    for c in text:
        n = len(c.encode("utf-8", "surrogateescape"))
        starts.append(at[k][0])
        ends.append(at[k + n - 1][1])
        k += n
    return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in text), starts, ends


def _escaped(s: str) -> tuple[str, list[int], list[int]]:
    out, starts, ends, last = [], [], [], 0
    for m in ESCAPE.finditer(s):
        for i in range(last, m.start()):
            out.append(s[i])
            starts.append(i)
            ends.append(i + 1)
        e = m[0]
        code = (int(e[3:-1], 16) if e[2] in "xX" else int(e[2:-1])) if e[0] == "&" else int(e[2:], 16)
        ch = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        out.append(ch)
        starts.append(m.start())
        ends.append(m.end())
        last = m.end()
    for i in range(last, len(s)):
        out.append(s[i])
        starts.append(i)
        ends.append(i + 1)
    return "".join(out), starts, ends


def _readable(data: bytes) -> str | None:
    """The bytes as text, or as much of their begin as is readable, if that is 12 bytes or more."""
    if (t := _utf8(data)) is not None:
        return t
    try:
        t = data.decode("utf-8")
    except UnicodeDecodeError as e:
        t = data[: e.start].decode("utf-8")
        if len(t) >= 12 and _utf8(t.encode()) is not None:
            return t
    n = next((i for i, c in enumerate(t) if not (c.isprintable() or c in "\t\r\n")), len(t))
    return t[:n] if len(t[:n].encode()) >= 12 else None


def _decoded(body: str) -> bytes:
    return binascii.a2b_base64(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4))


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"x" and len(data) > 1 and int.from_bytes(data[:2], "big") % 31 == 0)


def _base64(run: str) -> list[tuple[str | set[int], int, int]]:
    """What a run holds, as (content, start, end in the run); of what unpacks to more than a block the kinds of its
    secrets only, as they all have the run's span. It may begin at the run's start, after a character that
    also joins words or paths, or at a line's start, and up to three characters later; it ends with the run, or where
    it is no longer readable."""
    at = None  # of each character without line ends, its place in the run
    body = run.rstrip("=")
    starts = {0}
    if "\n" in body or "\\" in body:
        at, parts, last = [], [], 0
        for m in [*LINE_END.finditer(body), None]:
            end = m.start() if m else len(body)
            starts.add(len(at))
            at += range(last, end)
            parts.append(body[last:end])
            last = m.end() if m else end
        body = "".join(parts)
    starts.update(m.end() for m in re.finditer(r"[/_+-]", body))
    body = body.translate(SAFE)
    out: list[tuple[str | set[int], int, int]] = []
    done = 0
    for place in sorted(starts):
        for a in range(place, place + 4):
            if a < done or len(body) - a < PROBE:
                continue
            head = _decoded(body[a : a + PROBE])
            packed = _packed(head)
            # Of readable text the first bytes are such, but for a character that the probe cuts.
            if a and not packed and (b"\x00" in head or _start(head) is None):
                continue
            data = _decoded(body[a:])
            t, used, whole = None, len(data), False
            blocks = _blocks(_inflate(data)) if packed else iter(())
            if first := next(blocks, None):
                if more := next(blocks, None):
                    t = _kinds(first[0])
                    while more:
                        t |= _kinds(more[0])
                        used, more = more[1], next(blocks, None)
                else:
                    t, used = _readable(first[0]), first[1]
                whole = t is not None
            if t is None:
                t = _readable(data)
                if t is None:
                    continue
                used = len(t.encode())
                whole = used == len(data)
            end = len(body) if used == len(data) else min(len(body), a - (-used * 4 // 3))
            out.append((t, at[a] if at else a, len(run) if end == len(body) else (at[end - 1] + 1 if at else end)))
            if whole:
                done = end
    return out


def _start(head: bytes) -> str | None:
    try:
        t = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3:
            return None
        t = head[: e.start].decode("utf-8")
    return t if sum(not (c.isprintable() or c in "\t\r\n") for c in t) <= 1 else None


def segments(s: str) -> tuple[list[Segment], list[tuple[int, int, int]]]:
    """What is encoded in a layer: (content, start of each of its characters in `s`, end likewise); and spans of the
    secrets in packed content that is scanned in blocks."""
    found: list[Segment] = []
    spans: list[tuple[int, int, int]] = []
    if "%" in s:
        for m in PERCENT.finditer(s):
            if PERCENT_BYTE.search(m[0]):
                got = _percent(m[0])
                found.append((got[0], [i + m.start() for i in got[1]], [i + m.start() for i in got[2]]))
    if ("\\" in s or "&#" in s) and ESCAPE.search(s):
        for m in re.finditer(r"\S+", s):
            if ESCAPE.search(m[0]):
                got = _escaped(m[0])
                found.append((got[0], [i + m.start() for i in got[1]], [i + m.start() for i in got[2]]))
    escapes = found[:]
    for m in BASE64.finditer(s):
        if m.end() - m.start() >= PROBE and not _plain(m[0]):
            for t, a, b in _base64(m[0]):
                a, b = m.start() + a, m.start() + b
                if isinstance(t, set):
                    spans += [(a, b, k) for k in t]
                else:
                    found.append((t, [a] * len(t), [b] * len(t)))
    return found + spliced(s, escapes) + spliced(s, found[len(escapes) :]), spans


def spliced(s: str, found: list[Segment]) -> list[Segment]:
    """The lines of `s` that hold segments, with what these decode to put in their places; segments that overlap an
    earlier one are left, as the next layer has them again."""
    out: list[Segment] = []
    todo = sorted((f for f in found if f[0]), key=lambda f: (f[1][0], -f[2][-1]))
    k = 0
    while k < len(todo):
        # From the line's begin to the end of the last line that its segments reach.
        at = s.rfind("\n", 0, todo[k][1][0]) + 1
        parts, starts, ends = [], [], []
        last = -1
        while k < len(todo):
            t, a, b = todo[k]
            if last >= 0 and "\n" in s[last : a[0]]:
                break
            k += 1
            if a[0] < at:
                continue
            parts += [s[at : a[0]], t]
            starts += [*range(at, a[0]), *a]
            ends += [*range(at + 1, a[0] + 1), *b]
            at = last = b[-1]
        stop = s.find("\n", at)
        stop = len(s) if stop < 0 else stop
        starts += range(at, stop)
        ends += range(at + 1, stop + 1)
        out.append(("".join([*parts, s[at:stop]]), starts, ends))
    return out


def _plain(s: str) -> bool:
    """A run of letters in one case, as in prose, is no base64 of readable text of that length."""
    s = s.translate(JOINS)
    return s.isalpha() and (s.islower() or s[1:].islower() or s.isupper())


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those of the base and those that decoded layers add, without repeats."""
    base = base_spans(text)
    spans = {text: set(base)}
    places: dict[str, list[tuple[str, list[int], list[int]]]] = {}  # of each content: the layer around it, and the map
    work, news = [text], []
    while work:
        s = work.pop()
        found, packed = segments(s)
        news += [(s, span) for span in set(packed) - spans[s]]
        spans[s].update(packed)
        for t, starts, ends in found:
            places.setdefault(t, []).append((s, starts, ends))
            if t not in spans:
                spans[t] = set(base_spans(t))
                news += [(t, span) for span in spans[t]]
                work.append(t)
    while news:
        t, (a, b, k) = news.pop()
        for s, starts, ends in places.get(t, []):
            span = (starts[a], ends[b - 1], k)
            if span not in spans[s]:
                spans[s].add(span)
                news.append((s, span))
    return base, sorted(spans[text], key=lambda s: (s[0], s[2], s[1]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, counts per kind, digest of the base spans, and all spans."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        rows = []
        for t in batch.column(1).to_pylist():
            base, every = all_spans(t or "")
            n = [sum(k == j for _, _, k in base) for j in range(3)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(set(base) & set(every))))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return [batch.column(0), *[list(c) for c in cols]]

    return map_arrow(
        docs.select(F.col(key), F.col(text)),
        run,
        f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long",
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def redact(text: str) -> str:
    """The text with each secret's span replaced by a mark of its kind; overlapping spans become one."""
    out, last = [], 0
    for a, b, k in all_spans(text)[1]:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k]}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; `n_chars` follows the text. A null text stays null."""

    def run(batch: pa.RecordBatch) -> list:
        cols = list(batch.columns)
        at = batch.schema.names.index("text")
        texts = [None if t is None else redact(t) for t in cols[at].to_pylist()]
        cols[at] = texts
        if "n_chars" in batch.schema.names:
            cols[batch.schema.names.index("n_chars")] = [None if t is None else len(t) for t in texts]
        return cols

    return map_arrow(docs, run, docs.schema)
