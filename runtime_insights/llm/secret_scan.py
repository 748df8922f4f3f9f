"""Secrets in texts, also under layers of URL, Unicode, base64 and compressed encoding.

Each text starts a worklist. A layer taken from it is scanned for the three kinds of secret,
is unwrapped into further ones: one with all its %XX and \\uXXXX escapes undone, so that a secret
keeps its context, and one for each piece of base64 (both alphabets, also broken over lines) and
of gzip or zlib data inside base64. Base64 lines one after another are decoded each by itself, all
together, without the last one, and in blocks of equal width with and without a shorter line at the end. A new layer knows
which code points of the original text each of its own came from, so spans found in
it are spans of the original; inside compressed data that is the whole compressed piece. The
worklist ends at the fixpoint. Compressed data (all gzip members) are a text if they are one as a whole, whatever their
size. Beyond 1 MB they are inflated twice, once to know that and once to be taken in parts, cut only where no secret, escape
or base64 of any layer can cross (behind a character that none of them holds, or a blank between two plain words). So parts
give the same spans as the whole, and memory grows only with the longest stretch without such a place. Layers are made one
at a time. A layer whose text was seen before at the same place is not
taken up again, which ends cycles (data that unpacks to itself).

Spans of the text itself (base) are exactly those of the patterns; layers only add spans.
A document is one row's work; nothing is shuffled.

Rows of ``scan``: one per input row. Null or empty text: no spans. Repeated rows repeat.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from runtime_insights.llm.arrays import chunks

KINDS = ("assign", "access", "hex")
#: Pattern, which group has to have how many characters.
_PATTERNS = {
    "assign": (re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
}
_WORDS = ("passw", "secret", "token", "api")

_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")

_PIECE = 1 << 20  # bytes of inflated data held at a time
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Ends where a text may be cut: nothing that is looked for, as it is or escaped, holds what is before and behind.
_CUT = re.compile(r"[,;(){}<>|!?*&#@^~`$\[\]\t]|[^\x00-\x7f]|[\x20\n][^\x20\n:=%\\]+\x20(?=[^\x20:=%\\])")

Span = tuple[int, int, int]  # start, index of the kind, end
Places = Sequence[int]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def find(text: str) -> list[Span]:
    """Spans of the patterns in ``text`` itself."""
    found = []
    lower = text.lower()
    for kind, name in enumerate(KINDS):
        if name == "assign" and not any(word in lower for word in _WORDS):
            continue
        if name == "access" and "AKIA" not in text:
            continue
        pattern, group, least = _PATTERNS[name]
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return found


def _unescape(piece: str) -> tuple[str, list[int]]:
    """A text without its escapes, and where each character (and the end) was."""
    out, at, last = [], [], 0
    for m in _ESCAPED.finditer(piece):
        out += piece[last : m.start()]
        at += range(last, m.start())
        raw = m.group()
        if raw[0] == "%":
            data, width = bytes.fromhex(raw.replace("%", "")), 3
            text = data.decode("utf-8", "replace")
            sizes = [len(c.encode()) for c in text] if "�" not in text else None
            if sizes is None:  # not UTF-8: a character per byte
                text, sizes = data.decode("latin-1"), [1] * len(data)
        else:
            units = [int(raw[i + 2 : i + 6], 16) for i in range(0, len(raw), 6)]
            text = b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace")
            width, sizes = 6, [2 if ord(c) > 0xFFFF else 1 for c in text]
        begin = m.start()
        for c, size in zip(text, sizes):
            out.append(c)
            at.append(begin)
            begin += width * size
        last = m.end()
    out += piece[last:]
    at += range(last, len(piece) + 1)
    return "".join(out), at


class _Same:
    """Places of characters that all stand for one and the same piece."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, _: int) -> int:
        return self.place


def _text(data: bytes) -> str | None:
    """Decoded data that can hold a text."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _ODD.search(text) else None


def _parts(source: Iterable[bytes]) -> Iterator[str]:
    """A text in parts that together give what the whole gives."""
    decoder, held, limit = codecs.getincrementaldecoder("utf-8")(), "", _PIECE
    for piece in source:
        held += decoder.decode(piece)
        if len(held) > limit:
            back, end = 256, 0
            while not end and back < 4 * len(held) + 256:  # the last place, looked for from the end
                back *= 4
                end = max((m.end() for m in _CUT.finditer(held, max(0, len(held) - back))), default=0)
            if end:
                yield held[:end]
                held = held[end:]
            limit = max(_PIECE, 2 * len(held))
    if held:
        yield held


def _packed(data: bytes) -> bool:
    """Whether ``data`` begins like gzip or zlib data."""
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0


def _inflated(source: Iterable[bytes]) -> Iterator[bytes]:
    """What ``source`` (bytes in pieces) inflates to, member after member, up to the first fault."""
    engine, data = None, b""
    for piece in source:
        data += piece
        while len(data) > 1 or engine:
            if engine is None:
                if not _packed(data):
                    return
                engine = zlib.decompressobj(47)
            try:
                out = engine.decompress(data, _PIECE)
            except zlib.error:
                return
            if out:
                yield out
            if engine.eof:
                engine, data = None, engine.unused_data
            else:
                data = engine.unconsumed_tail
                if not data and len(out) < _PIECE:
                    break  # all that this piece holds


def _unpacked(data: bytes) -> Iterator[str]:
    """The texts inside compressed ``data``, level by level until one is not compressed or was met before.

    Up to ``_PIECE`` bytes a text comes whole, beyond that in parts.
    """
    def level(depth: int) -> Iterator[bytes]:
        stream: Iterable[bytes] = [data]
        for _ in range(depth):
            stream = _inflated(stream)
        return iter(stream)

    depth, seen = 0, set()
    while True:
        digest, held, size, head = hashlib.blake2b(digest_size=16), b"", 0, b""
        decoder, is_text = codecs.getincrementaldecoder("utf-8")(), depth > 0
        for piece in level(depth):
            digest.update(piece)
            head = (head + piece)[:2] if size < 2 else head
            size += len(piece)
            held = held + piece if size <= _PIECE else b""
            try:
                is_text = is_text and not _ODD.search(decoder.decode(piece))
            except UnicodeDecodeError:
                is_text = False
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        if depth and size <= _PIECE:
            if (text := _text(held)) is not None:
                yield text
        elif is_text and not decoder.getstate()[0]:
            yield from _parts(level(depth))
        if not _packed(head):
            return
        if depth and size <= _PIECE:
            data, depth = held, 0  # small enough to go on from here
        depth += 1


def _pieces(lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Which of base64 ``lines`` (begin, end), first and behind the last, may be one piece."""
    n = len(lines)
    found = {(i, i + 1) for i in range(n) if lines[i][1] - lines[i][0] >= 16} | {(0, n), (0, n - 1)}
    i = 0
    while i < n:
        width, j = lines[i][1] - lines[i][0], i + 1
        while j < n and lines[j][1] - lines[j][0] == width:
            j += 1
        found.add((i, j))
        if j < n and lines[j][1] - lines[j][0] < width:
            found.add((i, j + 1))
        i = j
    return iter(sorted((i, j) for i, j in found if i < j))


def _layers(text: str, begins: Places, ends: Places) -> Iterator[tuple[str, list[int], list[int]]]:
    """The encoded pieces of one layer, unwrapped once, each with the original begin and end of its characters."""
    if ("%" in text or "\\u" in text) and _ESCAPED.search(text):
        inner, at = _unescape(text)
        if isinstance(begins, _Same):
            yield inner, begins, ends
        else:
            yield inner, [begins[x] for x in at[:-1]], [ends[x - 1] for x in at[1:]]
    for m in _BASE64.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        done = set()
        for i, j in _pieces(lines):
            for layer in _decoded(text, lines[i:j], begins, ends):
                key = (i, _digest(layer[0]))
                if key not in done:  # further lines behind compressed data add nothing
                    done.add(key)
                    yield layer


def _decoded(text: str, lines: list[tuple[int, int]], begins: Places, ends: Places) -> Iterator[tuple[str, list[int], list[int]]]:
    """The layers of one piece of base64."""
    raw = "".join(text[b:e] for b, e in lines)
    if len(raw) < 16 or len(raw) % 4 == 1 or ("+" in raw or "/" in raw) and ("-" in raw or "_" in raw):
        return
    try:
        data = base64.b64decode(raw.replace("-", "+").replace("_", "/") + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    if (inner := _text(data)) is not None and isinstance(begins, _Same):
        yield inner, begins, ends
    elif inner is not None:
        at = [x for b, e in lines for x in range(b, e)]
        edges = [0]
        for c in inner:
            edges.append(edges[-1] + len(c.encode()))
        # Byte k is in the base64 characters from 8 k // 6 to (8 k + 7) // 6.
        yield (inner, [begins[at[8 * e // 6]] for e in edges[:-1]], [ends[at[(8 * e - 1) // 6]] for e in edges[1:]])
    if _packed(data):
        for inner in _unpacked(data):
            yield inner, _Same(begins[lines[0][0]]), _Same(ends[_padded(text, lines[-1][1]) - 1])


def _padded(text: str, end: int) -> int:
    """The end of a piece of base64 with its padding."""
    return end + next(n for n in (2, 1, 0) if text.startswith("=" * n, end))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans of all layers (base included), in order."""
    base = sorted(find(text))
    found, seen = set(base), set()
    # Layers are made when their turn comes, so only one of each depth is held.
    work = [_layers(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer, begins, ends = next(work[-1], (None, None, None))
        if layer is None:
            work.pop()
            continue
        if not layer or (key := (_digest(layer), begins[0], ends[-1])) in seen:
            continue
        seen.add(key)
        found.update((begins[start], kind, ends[end - 1]) for start, kind, end in find(layer))
        work.append(_layers(layer, begins, ends))
    return base, sorted(found)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches):
    for batch in chunks(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = all_spans(text or "")
            count = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            rows.append((*count, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), len(spans) - len(base)))
        columns = zip(*rows)
        types = (pa.int64(),) * 3 + (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts of base spans by kind, digest of them, all spans, number of added ones."""
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"
    )


def masked(text: str | None) -> str | None:
    """The text with every secret replaced by its kind in brackets; overlapping ones as one."""
    if not text:
        return text
    out, last = [], 0
    for start, kind, end in all_spans(text)[1]:
        if end <= last:
            continue
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind]}]"]
        last = end  # an overlapping span only extends what is masked
    return "".join(out) + text[last:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with masked ``text``; all other columns and rows as they are."""
    schema = docs.schema

    def mask(batches):
        for batch in chunks(batches, "text"):
            at = batch.schema.get_field_index("text")
            text = pa.array([masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(mask, schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
