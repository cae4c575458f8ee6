"""Secret scans with a recursive decoding worklist.

Every text starts as one layer. A layer is scanned by the rules, and every encoded run in it (percent escapes, \\u and \\x
escapes, base64 with zlib, gzip or bzip2 bodies inside) is decoded into a new layer, which joins the worklist with the place
in the whole text that its run has. Layers that were met before are not decoded again, so cycles end; and a decoded layer is
always shorter than its run, so depth is bounded without a limit that drops cases. Escapes of escapes (`%252525...`) that
only get shorter for some steps take these steps at once, so that the work does not grow with the square of their number.

Compressed bodies may be far longer than their run. They are opened as streams, over any number of packings, and read in
windows of `WINDOW` bytes that overlap by `OVERLAP`, each of them a layer: memory is bounded and nothing is left out, as all
that a body holds has the body's span. Bytes that are no text are read for their stretches of printable characters.

The kind of a finding in a decoded layer has a `+` and the route, for example `access+base64`. Its span is that of its
outermost run in the text, or, with `mapped` as in the queries, that of the characters that it was decoded from: escapes map
one by one, base64 by groups of four, and only what a compressed body holds maps to the whole body. A mapped finding that an
earlier layer or the text itself had with the same kind and span is not reported again. Findings in the text itself have
their exact spans. Spans count code points.

Defined cases: null and empty texts have no findings. Whole texts are scanned whatever their length. Equal findings of equal
spans are reported once. Of a broken body what comes before the break is read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import slices

#: Base kinds, in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Further rules of the method: (kind, a string that a text with a match must hold, pattern).
MORE = tuple(
    (kind, hint, re.compile(pattern))
    for kind, hint, pattern in (
        ("private_key", "PRIVATE KEY-----", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?!-----)[\s\S])*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
        ("github", "gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
        ("slack", "xox", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
        ("google_key", "AIza", r"\bAIza[A-Za-z0-9_-]{35}"),
        ("stripe", "_live_", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
        ("jwt", "eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("url_login", "://", r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+"),
        ("npm", "npm_", r"\bnpm_[A-Za-z0-9]{36}\b"),
        ("bearer", "earer ", r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"),
    )
)

#: Maximal runs, so that a scan is linear; only those with an escape in them are decoded.
_URL_RUN = re.compile(r"[A-Za-z0-9%._~+/=:&?;,@!$'()*\"-]+")
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_GRAPHIC_RUN = re.compile(r"[\x21-\x7e]+")
_ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that are parted by line ends only.
_BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Escapes with the escapes of their own first character before them.
_PERCENT_CHAIN = re.compile(r"%((?:25)+)([0-9A-Fa-f]{2})")
_ESCAPE_CHAIN = re.compile(r"\\((?:u005[cC]|U0000005[cC]|x5[cC])+)(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
_ESCAPE_LINK = re.compile(r"u005[cC]|U0000005[cC]|x5[cC]")
_PRINTABLE = re.compile(rb"[\x20-\x7e]{16}")
_OTHER_BYTES = re.compile(rb"[^\x20-\x7e\t\r\n]")
#: Bytes of an opened body that are read at once, and those that two windows share.
WINDOW, OVERLAP = 1 << 20, 1 << 16


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in one layer: leftmost and non-overlapping within a kind."""
    found: list[tuple[int, int, str]] = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is what [0-9a-f]+ matches there, since such runs are maximal.
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def scan_more(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for kind, hint, pattern in MORE if hint in text for m in pattern.finditer(text)]


def _readable(data: bytes) -> str | None:
    """What of some bytes can be read: UTF-8 text; or, if they hold a stretch of printable ASCII, that, other bytes as line ends."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = ""
    if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text):
        return text
    return _OTHER_BYTES.sub(b"\n", data).decode() if _PRINTABLE.search(data) else None


def _inflater(head: bytes) -> tuple[str, bytes, Callable] | None:
    """How a body that begins with these bytes is packed, the mark of its members, and what opens one."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", b"\x1f\x8b", lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return "zlib", b"\x78", zlib.decompressobj
    if head[:3] == b"BZh":
        return "bzip2", b"BZh", bz2.BZ2Decompressor
    return None


def _members(chunks: Iterator[bytes], mark: bytes, machine: Callable, size: int) -> Iterator[bytes]:
    """What the members of a packed stream hold, in parts of at most `size` bytes, as far as it can be opened."""
    member, rest = machine(), b""
    try:
        for chunk in chunks:
            rest += chunk
            while rest:
                if member is None:
                    rest = rest.lstrip(b"\0")
                    if len(rest) < len(mark):
                        break
                    if not rest.startswith(mark):
                        return
                    member = machine()
                out = member.decompress(rest, size)
                if isinstance(member, bz2.BZ2Decompressor):
                    rest = b""
                    while out:
                        yield out
                        out = member.decompress(b"", size) if not (member.eof or member.needs_input) else b""
                else:
                    rest = member.unconsumed_tail
                    while out:
                        yield out
                        out = b"" if rest or member.eof else member.decompress(b"", size)
                if member.eof:
                    rest, member = member.unused_data, None
    except (zlib.error, OSError, ValueError, EOFError):
        return


def _opened(data: bytes, window: int) -> Iterator[tuple[str, str]]:
    """(route, text) of each window of what a packed body holds, whatever number of packings it has."""
    route, chunks, head = [], iter((data,)), data[:3]
    while (packer := _inflater(head)) is not None:
        route.append(packer[0])
        inner = _members(chunks, packer[1], packer[2], window)
        first = []
        # The first bytes tell whether there is another packing.
        for part in inner:
            first.append(part)
            if sum(map(len, first)) >= 3:
                break
        head = b"".join(first)
        chunks = _after(head, inner)
        if not head:
            return
    held, overlap = b"", min(OVERLAP, window // 4)
    for chunk in chunks:
        held += chunk
        while len(held) > window:
            yield ".".join(route), held[:window]
            held = held[window - overlap :]
    if held:
        yield ".".join(route), held


def _after(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def _cut(data: bytes) -> bytes:
    """A window of UTF-8 without what is cut of a character at its ends."""
    start = 0
    while start < min(3, len(data)) and data[start] & 0xC0 == 0x80:
        start += 1
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return data[start : len(data) - back] if need > back else data[start:]
    return data[start:]


def _unescape(m: re.Match) -> str:
    at = int(m[1] or m[2] or m[3], 16)
    return chr(at) if at < 0x110000 and not 0xD800 <= at < 0xE000 else m[0]


def _base64(run: str, window: int) -> Iterator[tuple[str, str]]:
    """Readable contents of a base64 run: data that is text, the windows of a packed body, or the printable parts of other data."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or not (re.search("[A-Z]", run) and re.search("[a-z]", run)):
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    found = False
    if _inflater(data[:3]) is not None:
        for route, part in _opened(data, window):
            if (text := _readable(_cut(part))) is not None:
                found = True
                yield f"base64.{route}", text
    if not found and (text := _readable(data)) is not None:
        yield "base64", text


def _lines(text: str, window: int) -> Iterator[tuple[int, int, Iterator[tuple[str, str]]]]:
    """(start, end, contents) of base64 that goes over several lines.

    All lines of a block are taken first; then without a first or last one that may be no part of it, such as a PEM mark; then
    the stretches of lines of one length, each with the shorter line that ends it.
    """
    for m in _BASE64_LINES.finditer(text):
        rows = [(m.start() + r.start(), m.start() + r.end()) for r in _BASE64_LINE.finditer(m[0])]
        if max(b - a for a, b in rows) < 16:
            continue
        n = len(rows)
        whole, stretches, at = [(0, n), (1, n), (0, n - 1), (1, n - 1)], [], 0
        while at < n:
            wide, to = rows[at][1] - rows[at][0], at + 1
            while to < n and rows[to][1] - rows[to][0] == wide:
                to += 1
            stretches += [(at, to), (at, to + 1)] if to < n and rows[to][1] - rows[to][0] < wide else [(at, to)]
            at = to
        done = 0
        for i, j in dict.fromkeys(whole + stretches):
            # Whole blocks leave at most a line at either end; stretches come in order.
            if j - i < 2 or i < done:
                continue
            pad = m[0][len(m[0].rstrip("=")) :] if j == n else ""
            contents = _base64("".join(text[a:b] for a, b in rows[i:j]) + pad, window)
            if (first := next(contents, None)) is not None:
                done = j if (i, j) not in whole else n
                yield rows[i][0], rows[j - 1][1] + len(pad), _all_of(first, contents)


def _all_of(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def _percents(run: str) -> str:
    """The run with its escapes decoded; those that are no UTF-8 stay as they are."""

    def decoded(m: re.Match) -> str:
        text, out, at = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"), [], 0
        for c in text:
            bad = "\udc80" <= c <= "\udcff"
            out.append(m[0][at : at + 3] if bad else c)
            at += 3 if bad else 3 * len(c.encode())
        return "".join(out)

    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", decoded, run)


def _shorter(run: str, chain: re.Pattern, links: Callable[[str], list[int]], plain: Callable[[str], str]) -> tuple[str, _Places] | None:
    """The run after all steps in which nothing but escapes of escapes gets shorter; None if there is no such step.

    links: the lengths of a chain's links; plain: the run's other escapes decoded.
    """
    if not chain.search(run) or plain(rest := chain.sub("\x01", run)) != rest:
        return None
    found = [(m, links(m[1])) for m in chain.finditer(run)]
    steps = min(len(own) for _, own in found)
    out, widths, at = [], [], 0
    for m, own in found:
        gone = sum(own[:steps])
        out += [run[at : m.start()], run[m.start()], m[1][gone:], m[2]]
        widths += [np.ones(m.start() - at, np.int64), np.array([1 + gone]), np.ones(len(m[1]) - gone + len(m[2]), np.int64)]
        at = m.end()
    ends = np.cumsum(np.concatenate((*widths, np.ones(len(run) - at, np.int64))))
    return "".join((*out, run[at:])), _Places(np.concatenate(([0], ends[:-1])), ends)


def _percent_links(chain: str) -> list[int]:
    return [2] * (len(chain) // 2)


def _escape_links(chain: str) -> list[int]:
    return list(map(len, _ESCAPE_LINK.findall(chain)))


def _unescaped(run: str) -> str:
    return _ONE_ESCAPE.sub(_unescape, run)


Layer = tuple[int, int, str, str, "Callable[[], _Places]"]


def unwrap(text: str, window: int = WINDOW) -> Iterator[Layer]:
    """(start, end, route, decoded, places) of every encoded run of one layer; places() tells where the characters came from."""
    for one, runs, mark, route, chain, links, plain in (
        (_PERCENT, _URL_RUN, "%", "url", _PERCENT_CHAIN, _percent_links, _percents),
        (_ONE_ESCAPE, _GRAPHIC_RUN, "\\", "unicode", _ESCAPE_CHAIN, _escape_links, _unescaped),
    ):
        if one.search(text):
            for m in runs.finditer(text):
                if mark not in m[0]:
                    continue
                if (shorter := _shorter(m[0], chain, links, plain)) is not None:
                    yield m.start(), m.end(), route, shorter[0], lambda places=shorter[1]: places
                elif (out := plain(m[0])) != m[0]:
                    yield m.start(), m.end(), route, out, lambda run=m[0], route=route, out=out: _places(run, route, out)
    joined = []
    if "\n" in text or "\r" in text:
        for start, end, contents in _lines(text, window):
            joined.append((start, end))
            for route, out in contents:
                yield start, end, route, out, lambda a=start, b=end, route=route, out=out: _places(text[a:b], route, out)
    at = 0
    joined.sort()
    for m in _BASE64.finditer(text):
        while at < len(joined) and joined[at][1] <= m.start():
            at += 1
        if at < len(joined) and joined[at][0] <= m.start():
            continue
        for route, out in _base64(m[0], window):
            yield m.start(), m.end(), route, out, lambda run=m[0], route=route, out=out: _places(run, route, out)


class _Places:
    """For every character of a layer the first place in its run that it came from, and the place after the last."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.lo[start]), int(self.hi[end - 1])

    def through(self, outer: _Places | _Whole, start: int, end: int) -> _Places | _Whole:
        """These places of a run that lies at start..end of a layer, by that layer's own run, counted from its first place there."""
        lo, hi = outer.span(start, end)
        if isinstance(outer, _Whole):
            return _Whole(hi - lo)
        return _Places(outer.lo[start + self.lo] - lo, outer.hi[start + self.hi - 1] - lo)


class _Whole:
    """All characters of a layer came from the whole of a run."""

    def __init__(self, size: int):
        self.size = size

    def span(self, start: int, end: int) -> tuple[int, int]:
        return 0, self.size

    def through(self, outer: _Places | _Whole, start: int, end: int) -> _Whole:
        lo, hi = outer.span(start, end)
        return _Whole(hi - lo)


def _places(run: str, route: str, out: str) -> _Places | _Whole:
    """Where in its run each character of the decoded layer came from."""
    if route == "base64":
        sextets = np.array([m.start() for m in re.finditer(r"[A-Za-z0-9+/_-]", run)])
        sizes = np.frombuffer(out.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(1 + (sizes > 0x7F) + (sizes > 0x7FF).astype(np.int64) + (sizes > 0xFFFF))
        starts = np.concatenate(([0], ends[:-1]))
        after = np.append(sextets[1:], len(run))  # the last group has the padding
        last = np.minimum((ends + 2) // 3 * 4, len(sextets)) - 1
        return _Places(sextets[starts // 3 * 4], np.where(last == len(sextets) - 1, after[last], sextets[last] + 1))
    if route not in ("url", "unicode"):
        return _Whole(len(run))
    widths = np.ones(len(out), np.int64)
    shift = 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", run) if route == "url" else _ONE_ESCAPE.finditer(run):
        at, text = m.start() - shift, _percents(m[0]) if route == "url" else _unescape(m)
        if route == "unicode":
            if text != m[0]:
                widths[at] = len(m[0])
        else:
            raw = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
            for c in raw:
                bad = "\udc80" <= c <= "\udcff"
                if not bad:
                    widths[at] = 3 * len(c.encode())
                at += 3 if bad else 1
        shift += len(m[0]) - len(text)
    ends = np.cumsum(widths)
    return _Places(ends - widths, ends)


def find_secrets(text: str | None, mapped: bool = False, window: int = WINDOW) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, more): the base kinds' findings in the text itself, and all that the method adds; both sorted, by position.

    mapped: findings in decoded layers have the span of what they were decoded from, not of the whole outermost run.
    """
    if not text:
        return [], []
    rank = {k: i for i, k in enumerate(KINDS)}
    base = sorted(scan(text), key=lambda x: (x[0], rank[x[2]]))
    more = set(scan_more(text))
    met = {hashlib.blake2b(text.encode()).digest()}
    known = {*base, *more}
    # The worklist holds what the layers still have to give. Layers wait for their turn, so that the shortest route to a finding
    # is the one that is told; only the windows of a packed body go first, one after the other, so that no more than one is held.
    work: deque[tuple[Iterator[Layer], int, int, str, _Places | _Whole | None]] = deque([(unwrap(text, window), 0, len(text), "", None)])
    while work:
        layers, outer_start, outer_end, before, outer = work[0]
        if (found := next(layers, None)) is None:
            work.popleft()
            continue
        a, b, step, layer, of_run = found
        route = f"{before}.{step}" if before else step
        if not before:
            start, end = a, b
        elif mapped:
            start, end = (outer_start + x for x in outer.span(a, b))
        else:
            start, end = outer_start, outer_end
        mark = hashlib.blake2b(layer.encode("utf-8", "surrogatepass") + f":{start}:{end}".encode()).digest()
        if mark in met:
            continue
        met.add(mark)
        places = None
        if mapped:
            places = of_run()
            if before:
                places = places.through(outer, a, b)
        for x, y, kind in (*scan(layer), *scan_more(layer)):
            if not mapped:
                more.add((start, end, f"{kind}+{route}"))
            elif (own := (start + places.span(x, y)[0], start + places.span(x, y)[1], kind)) not in known:
                known.add(own)
                more.add((*own[:2], f"{kind}+{route}"))
        (work.appendleft if "." in step else work.append)((unwrap(layer, window), start, end, route, places))
    return base, sorted(more)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, more): both arrays of (start, end, kind), for every row of docs."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [find_secrets(t, mapped=True) for t in part.column(1).to_pylist()]
                listed = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f[i]] for f in found], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *listed], ["key", "base", "more"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key long, base {kind}, more {kind}").withColumnRenamed("key", key)


def redact(text: str | None, mark: str = "<secret>", mapped: bool = False) -> str | None:
    """The text with every finding's span, as find_secrets gives it, replaced by a mark; overlapping spans by one."""
    base, more = find_secrets(text, mapped)
    if not base and not more:
        return text
    out, at, until = [], 0, -1
    for start, end, _ in sorted([*base, *more]):
        if start >= until:
            out += [text[at:start], mark]
        until = at = max(until, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with the secrets in `text` replaced; all other columns as they are, but n_chars, if there is one, follows."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                columns = list(part.columns)
                columns[place] = pa.array([redact(t, mark, mapped=True) for t in columns[place].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    cleaned = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return cleaned.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
