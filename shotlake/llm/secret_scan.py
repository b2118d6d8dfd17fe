"""Secret scans: a recursive decoding worklist over whole texts.

A text is scanned, then every encoded stretch in it is unwrapped (percent
escapes, Unicode and HTML escapes, base64 in one line or wrapped over several, and
gzip or zlib data inside base64) and each new layer is scanned and unwrapped in turn. A layer that was seen
before in the same text ends its branch, so cycles end. What is found in a layer is
mapped back through the layers to code points of the text.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds in their order, and their patterns
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# lines that may belong to one wrapped stretch: a search for them, and the end of a line with the start of the next
LONG_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+\r?\n|\n[ \t]*+[A-Za-z0-9+/_-]{16}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
PIECE = 1 << 20
# a secret that lies over a cut of a large layer is sought in so many characters on both sides
SEAM = 4096

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    """The spans of the base patterns in one layer, leftmost and not overlapping within a kind.

    The bounds of access and hex are part of their patterns: a maximal run that is too short has no
    match inside it either, so this is the same as dropping short matches.
    """
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


WHOLE, SAME, SIXES = 0, 1, 2


class Layer:
    """A decoded text and where it came from. A cut (at, start, size, how) says that from output position
    `at` on the text stems from parent position `start`: code point by code point (SAME), as bytes of base64
    (SIXES), or only as a whole of `size` code points (WHOLE)."""

    def __init__(self, text: str, cuts: list[tuple[int, int, int, int]]):
        self.text = text
        self.at = [c[0] for c in cuts]
        self.cuts = cuts

    def parent(self, a: int, b: int) -> tuple[int, int]:
        return self._edge(a)[0], self._edge(b - 1)[1]

    def _edge(self, i: int) -> tuple[int, int]:
        at, start, size, how = self.cuts[bisect_right(self.at, i) - 1]
        i -= at
        if how == WHOLE:
            return start, start + size
        if how == SAME:
            return start + i, start + i + 1
        return start + i * 4 // 3, min(start + size, start + (i * 4 + 6) // 3)


def replaced(text: str, found: Iterator[tuple[int, int, str, list[int] | None]]) -> Layer | None:
    """`text` with the stretches `found` (start, end, decoded, and the length of what each decoded code point
    stood for) put in; None if there is none."""
    out, cuts, last, n = [], [], 0, 0
    for a, b, new, lengths in found:
        if a > last:
            out.append(text[last:a])
            cuts.append((n, last, a - last, SAME))
            n += a - last
        for ch, width in zip(new, lengths):
            cuts.append((n, a, width, WHOLE))
            n += 1
            a += width
        out.append(new)
        last = b
    if not cuts:
        return None
    if last < len(text):
        out.append(text[last:])
        cuts.append((n, last, len(text) - last, SAME))
    return Layer("".join(out), cuts)


def from_percent(text: str) -> Layer | None:
    def found():
        for m in PERCENT.finditer(text):
            # bytes that are no UTF-8 become lone surrogates, which end a part
            at, whole = m.start(), bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape")
            for new in re.split("([\udc80-\udcff]+)", whole):
                if new and "\udc80" <= new[0] <= "\udcff":
                    at += 3 * len(new)
                elif new:
                    lengths = [3 * len(ch.encode()) for ch in new]
                    yield at, at + sum(lengths), new, lengths
                    at += sum(lengths)

    return replaced(text, found()) if "%" in text else None


def from_escapes(text: str) -> Layer | None:
    def found():
        for m in ESCAPE.finditer(text):
            code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                yield m.start(), m.end(), chr(code), [m.end() - m.start()]

    return replaced(text, found()) if "\\" in text or "&#" in text else None


def packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0)


def inflated(data: bytes, members: int | None = None) -> Iterator[bytes | None]:
    """gzip or zlib data unpacked in pieces, its first `members` or all; a None after each whole member. Ends at what is no whole member."""
    done = 0
    while packed(data) and done != members:
        unpack = zlib.decompressobj(47)
        try:
            while data and not unpack.eof:
                yield unpack.decompress(data, PIECE)
                data = unpack.unconsumed_tail
            while not unpack.eof:  # what the object holds back
                if not (rest := unpack.decompress(b"", PIECE)):
                    return
                yield rest
        except zlib.error:
            return
        done += 1
        yield None
        data = unpack.unused_data.lstrip(b"\0")


def pieces(data: bytes, members: int, most: int) -> Iterator[str]:
    """The unpacked text in pieces of about `most` bytes, cut where no encoded stretch lies over the cut; before each but the first the
    characters around the cut alone. A last item of None if a stretch was longer than a piece and had to be cut."""
    decoder, held, size, torn, before = codecs.getincrementaldecoder("utf-8")(), [], 0, False, ""
    for part in inflated(data, members):
        if part is None:
            continue
        held.append(decoder.decode(part))
        size += len(held[-1])
        if size < most:
            continue
        text = "".join(held)
        cut = cut_before(text)
        if not cut:
            torn, cut = True, len(text)
        yield before + text[:SEAM], True
        yield text[:cut], False
        before = (before + text[:cut])[-SEAM:]
        held, size = [text[cut:]], len(text) - cut
    text = "".join(held)
    yield before + text[:SEAM], True
    yield text, False
    if torn:
        yield None, False


def cut_before(text: str) -> int:
    """The last place in `text` that no encoded stretch can lie over: after white space, and not within lines of base64 digits. 0 if none."""
    end = len(text)
    while end:
        a = text.rfind("\n", 0, end) + 1
        line = text[a:end].strip()
        if a and (not line or LINE.fullmatch(line)):
            end = a - 1
            continue
        return max(a, *(text.rfind(c, a, end) + 1 for c in " \t\r"))
    return 0


def wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """The lines (start, end) of each stretch of base64 digits that may be wrapped over lines: lines of one length, with or without the
    line before them, which other text may begin, and a last one that is no longer."""
    if not LONG_LINE.search(text):
        return
    for m in LINES.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        width = [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and width[j + 1] == width[i]:
                j += 1
            if width[i] >= 16:
                for a in (i, i - 1) if i else (i,):
                    for b in (j, j + 1) if j + 1 < len(lines) and width[j + 1] < width[i] else (j,):
                        if b > a:
                            yield lines[a:b + 1]
            elif i and i == j and width[i - 1] < 16 and sum(width[i - 1:i + 1]) >= 16:
                yield lines[i - 1:i + 1]
            i = j + 1


# instead of layers: a stretch of which a part was too long to be unwrapped
TOO_LARGE = ()


def unwrapped(run: str, most: int) -> Iterator[tuple[Layer, bool] | None]:
    """What a run of base64 digits decodes to: a layer, or one for each piece and each seam (True) of a large one; None as TOO_LARGE."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or not any(c.isdigit() or c.isupper() for c in body):
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    whole, now, size, members = [], [], 0, 0
    for part in inflated(data):
        if part is None:
            members += 1
            whole, now = whole + now, []
        else:
            size += len(part)
            now.append(part)
            if size > most:
                whole, now = [], []
    if members and size > most:
        try:
            check = codecs.getincrementaldecoder("utf-8")()
            for part in inflated(data, members):
                check.decode(part or b"")
            check.decode(b"", True)
        except UnicodeDecodeError:
            return
        for text, seam in pieces(data, members, most):
            if text is None:
                yield None
            elif text:
                yield Layer(text, [(0, 0, len(run), WHOLE)]), seam
        return
    try:
        new = (b"".join(whole) if members else data).decode()
    except UnicodeDecodeError:
        return
    if new:
        yield Layer(new, [(0, 0, len(run), WHOLE if members or not new.isascii() else SIXES)]), False


def from_base64(text: str, most: int) -> Iterator[tuple[tuple[Layer, ...], bool]]:
    """The layers of each stretch that decodes to text, or to packed text: the stretch itself, lines joined, and what it holds."""
    for m in BASE64.finditer(text):
        run = Layer(m[0], [(0, m.start(), len(m[0]), SAME)])
        for got in unwrapped(m[0], most):
            yield ((run, got[0]), got[1]) if got else (TOO_LARGE, False)
    for lines in wrapped(text):
        cuts, n = [], 0
        for a, b in lines:
            cuts.append((n, a, b - a, SAME))
            n += b - a
        run = Layer("".join(text[a:b] for a, b in lines), cuts)
        for got in unwrapped(run.text, most):
            yield ((run, got[0]), got[1]) if got else (TOO_LARGE, False)


def layers(text: str, most: int) -> Iterator[tuple[tuple[Layer, ...], bool]]:
    for layer in (from_percent(text), from_escapes(text)):
        if layer is not None:
            yield (layer,), False
    yield from from_base64(text, most)


def scan(text: str, most: int = 1 << 26) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, stretches that unpack to more than `most` bytes and hold one that long without a place to cut) of a text."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    spans, left = set(base), 0
    seen = {_mark(text, 0, len(text))}
    work: list[tuple[Iterator, tuple[Layer, ...]]] = [(layers(text, most), ())]
    while work:
        rest, way = work[-1]
        found = next(rest, None)
        if found is None:
            work.pop()
            continue
        new, seam = found
        if new is TOO_LARGE:
            left += 1
            continue
        below, now = (*way, *new), new[-1].text
        mark = _mark(now, *(_origin(below, 0, len(now)) if now else (0, 0)))
        if mark not in seen:
            if not seam:
                seen.add(mark)
                work.append((layers(now, most), below))
            spans.update((kind, *_origin(below, a, b)) for kind, a, b in base_spans(now))
    return base, sorted(spans, key=order), left


def _mark(text: str, a: int, b: int) -> tuple:
    """What makes a layer the same as one seen before: its text and where it lies."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), a, b


def _origin(way: tuple[Layer, ...], a: int, b: int) -> tuple[int, int]:
    for layer in reversed(way):
        a, b = layer.parent(a, b)
    return a, b


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_packed long"


def scan_texts(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans, left = scan(text or "")
        kinds = [s[0] for s in base]
        rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), left))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_packed"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """`docs` (text, any others) with a column `secrets` (n_assign, n_access, n_hex, base_sha256, spans, n_packed).

    Every whole text is scanned where it is, without a shuffle. NULL and empty texts have no spans;
    repeated rows stay; an empty table gives an empty one; other columns pass through whatever
    their names, `secrets` alone is replaced. A stretch that unpacks to more than 64 MB is scanned in pieces, to bound memory;
    n_packed counts those that hold 64 MB without a place to cut, where plain secrets are found and encoded ones over a cut are not.
    """
    scanned = F.pandas_udf(scan_texts, SCHEMA)
    return docs.withColumn("secrets", scanned(F.col("text").cast("string")))


def mask_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, listed in zip(texts, spans):
        if listed:
            parts, last = [], 0
            merged: list[list] = []
            for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in listed.split(","))):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b, kind])
            for a, b, kind in merged:
                parts += [text[last:a], f"[{kind}]"]
                last = b
            text = "".join(parts) + text[last:]
        out.append(text)
    return pd.Series(out)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with each secret replaced by its kind in brackets; overlapping spans are one."""
    masked = F.pandas_udf(mask_texts, "string")
    found = scan_secrets(docs)
    return found.withColumn("text", masked("text", F.col("secrets.spans"))).select(*docs.columns)
