"""SentencePiece encoding and decoding on an Aho-Corasick automaton over the vocabulary's pieces.

One pass over a text keeps one best way to reach every position. At each position the automaton's output links give the
pieces that end there, longest first, and each relaxes the position's best from the best at its own start:

* for a unigram model, best is the highest sum of scores (Viterbi; on a tie the longest last piece stays);
* for a BPE model, whose scores are merge ranks and no log probabilities, a sum of them has no meaning. There the best way
  to reach a position is the merge result of the text so far, which is unique; the piece that ends it is the only one that
  can follow the best at its start without a merge across the seam. So relaxing asks for that in place of a sum, and the
  ids equal those of the library for the same file.

Pieces that hold the space mark hold it in front only, so no piece crosses from a letter to a mark and the texts' chunks
(marks and what follows up to the next mark) are encoded on their own; a bounded memo keeps chunks that were met. A
vocabulary without this property is used on whole texts.

Normalisation is the identity of the vocabulary file: a mark in front, spaces become marks, and nothing else changes.
Characters without a piece become their UTF-8 bytes' pieces. Decoding inverts this exactly, except that a literal U+2581 in
a text reads back as a space, as in the library. Null texts have null ids; the empty text has none.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields; bytes for messages and strings, raw bytes for floats."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            if tag & 7 == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(data: bytes) -> tuple[int, list[tuple[str, float, int]]]:
    """(model type, [(piece, score, kind)]) of a SentencePiece model file."""
    import struct

    pieces, kind = [], UNIGRAM
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return kind, pieces


class Pieces:
    """An encoder and decoder for one vocabulary. memo: half the number of chunks whose ids are kept, and the number of seams
    and of ways over failure links. An entry takes some 250 bytes, so that all of them stay below 100 MB."""

    def __init__(self, data: bytes, memo: int = 100_000, kind: int | None = None):
        found, self.table = read_model(data)
        self.kind = kind or found
        self.memo_size, self.memo, self.older, self.known = memo, {}, {}, {}
        self.ids = {p: i for i, (p, _, k) in enumerate(self.table) if k in (_NORMAL, _USER)}
        self.byte_ids = [0] * 256
        for i, (p, _, k) in enumerate(self.table):
            if k == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown = next((i for i, x in enumerate(self.table) if x[2] == _UNKNOWN), 0)
        self.has_bytes = any(k == _BYTE for _, _, k in self.table)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) else re.compile(r"[\s\S]+")
        # A merge into a piece happens the sooner the higher its score; single characters are there from the start.
        self.rank = [(-1.0 if len(p) == 1 else -s) for p, s, _ in self.table]
        self.lowest = min((s for _, s, k in self.table if k == _NORMAL), default=0.0) - 10.0
        if self.kind == BPE:
            self._halve()
        self._build()
        self.texts = [bytes((int(p[3:5], 16),)) if k == _BYTE else b"" if k in (_CONTROL, _UNKNOWN) else p.replace(MARK, " ").encode() for p, _, k in self.table]

    def _build(self) -> None:
        """States by breadth: step (character -> state), and ends (pieces that end in a state, longest first)."""
        self.step: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        for piece, i in self.ids.items():
            if self.kind == BPE and self.halves[i] is False:
                continue
            state = 0
            for c in piece:
                if c not in self.step[state]:
                    self.step.append({})
                    ends.append([])
                    self.step[state][c] = len(self.step) - 1
                state = self.step[state][c]
            ends[state].append((len(piece), i))
        self.fail = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for c, after in self.step[state].items():
                queue.append(after)
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[after] = self.step[back].get(c, 0)
                ends[after] += ends[self.fail[after]]
        self.ends = [tuple(x) for x in ends]
        # From here on, step also gets the ways that lead over failure links, as they are met.
        self.go, self.far = self.step, 0

    def _go(self, state: int, c: str) -> int:
        """The state after c from a state that has no step for it: the first along its failure links that has one."""
        back = state
        while back and c not in self.step[back]:
            back = self.fail[back]
        after = self.step[back].get(c, 0)
        if self.far < self.memo_size:
            self.go[state][c] = after
            self.far += 1
        return after

    def _merge(self, chars: list[str], stop: int = 1) -> list[str]:
        """The BPE merges of a character sequence, one after the other: the best score first, the leftmost on a tie.

        They end when `stop` parts are left, or none can be joined.
        """
        parts: list[str | None] = list(chars)
        after, before, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), len(parts)
        heap: list[tuple[float, int, str]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < len(parts):
                joined = parts[at] + parts[after[at]]
                if (i := self.ids.get(joined)) is not None:
                    heapq.heappush(heap, (self.rank[i], at, joined))

        for at in range(len(parts) - 1):
            offer(at)
        while heap and left > stop:
            _, at, joined = heapq.heappop(heap)
            following = after[at]
            if parts[at] is None or following >= len(parts) or parts[at] + parts[following] != joined:
                continue
            parts[at], parts[following] = joined, None
            after[at] = after[following]
            if after[at] < len(parts):
                before[after[at]] = at
            left -= 1
            offer(before[at])
            offer(at)
        return [p for p in parts if p is not None]

    def _halve(self) -> None:
        """For each piece, the two that its last merge joins, or None for single characters; False if no merges lead to it."""
        self.halves: list = [None] * len(self.table)
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.halves[i] = self._last_merge(piece)

    def _last_merge(self, piece: str):
        parts = self._merge(list(piece), stop=2)
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids else False

    def _apart(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when the text of both is merged.

        Going back in time, the later of the two facing pieces is parted. If at any time the facing pieces could have been
        joined before the earlier of the merges that did happen around the seam, that join would have come first.
        """
        ids, table, rank, halves = self.ids, self.table, self.rank, self.halves
        until_left = until_right = float("inf")
        while True:
            joined = ids.get(table[a][0] + table[b][0])
            if joined is not None:
                # A merge of equal rank further left comes first, one further right later.
                r = rank[joined]
                if r < until_left and r <= until_right:
                    return False
            left, right = halves[a], halves[b]
            if not left and not right:
                return True
            # The later merge goes: the higher rank, and of equal ranks the right one.
            if right and (not left or rank[b] >= rank[a]):
                until_right, b = rank[b], right[0]
            else:
                until_left, a = rank[a], left[1]

    def _bpe(self, chunk: str) -> list[int]:
        go, ends, apart, known, many = self.go, self.ends, self._apart, self.known, len(self.table)
        last: list[int] = [-1] * (len(chunk) + 1)
        state = at = 0
        for c in chunk:
            at += 1
            state = go[state][c] if c in go[state] else self._go(state, c)
            for size, i in ends[state]:
                before = last[at - size]
                if before >= 0:
                    seam = before * many + i
                    fits = known.get(seam)
                    if fits is None:
                        if len(known) >= self.memo_size:
                            known.clear()
                        fits = known[seam] = apart(before, i)
                    if fits:
                        last[at] = i
                        break
                elif before == -2 or at == size:
                    last[at] = i
                    break
            else:
                # A character without a piece, over which nothing merges.
                last[at] = -2
        return self._walk(chunk, last)

    def _viterbi(self, chunk: str) -> list[int]:
        go, ends, table = self.go, self.ends, self.table
        best = [float("-inf")] * (len(chunk) + 1)
        best[0] = 0.0
        last = [-2] * (len(chunk) + 1)
        state = 0
        for at, c in enumerate(chunk, 1):
            state = go[state][c] if c in go[state] else self._go(state, c)
            for size, i in ends[state]:
                score = best[at - size] + table[i][1]
                if score > best[at]:
                    best[at], last[at] = score, i
            if c not in self.ids and best[at - 1] + self.lowest > best[at]:
                best[at], last[at] = best[at - 1] + self.lowest, -2
        return self._walk(chunk, last)

    def _walk(self, chunk: str, last: list[int]) -> list[int]:
        out: list[int] = []
        at = len(chunk)
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
                at -= len(self.table[i][0])
            else:
                at -= 1
                out += [self.byte_ids[x] for x in reversed(chunk[at].encode())] if self.has_bytes else [self.unknown]
        out.reverse()
        return out

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        if self.kind == BPE:
            # Runs of marks have merges of one rank at many places; they are merged one after the other.
            if chunk.startswith(MARK * 2):
                return tuple(x for part in self._merge(list(chunk)) for x in ([self.ids[part]] if part in self.ids else [self.byte_ids[b] for b in part.encode()] if self.has_bytes else [self.unknown]))
            return tuple(self._bpe(chunk))
        return tuple(self._viterbi(chunk))

    def encode(self, text: str | None) -> list[int] | None:
        """Ids of a whole text."""
        if text is None:
            return None
        if not text:
            return []
        out: list[int] = []
        memo, older, extend = self.memo, self.older, out.extend
        for chunk in self.split.findall(MARK + text.replace(" ", MARK)):
            ids = memo.get(chunk)
            if ids is None:
                ids = older.get(chunk)
                if ids is None:
                    ids = self.chunk_ids(chunk)
                if len(chunk) <= 64:
                    if len(memo) >= self.memo_size:
                        # What was used lately is found again in the older half; the rest goes with the next change.
                        memo, older = self.memo, self.older = {}, memo
                    memo[chunk] = ids
            extend(ids)
        return out

    def forget(self) -> None:
        """Drop what was kept of the texts; the automaton stays."""
        self.memo, self.older, self.known = {}, {}, {}

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids; bytes that are no UTF-8 read as U+FFFD."""
        if ids is None:
            return None
        data = b"".join(map(self.texts.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def load(path: str) -> bytes:
    """A model file's bytes, read on the driver; a vocabulary has a few hundred kilobytes."""
    with open(path, "rb") as file:
        return file.read()


_made: dict = {}


def _of(data: bytes, kind: int | None) -> Pieces:
    """One encoder for each vocabulary in a worker process, kept between its tasks without what it kept of their texts."""
    at = (hash(data), len(data), kind)
    if at not in _made:
        _made.clear()
        _made[at] = Pieces(data, kind=kind)
    return _made[at]


def encode_documents(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", kind: int | None = None) -> DataFrame:
    """(key, ids, exact): the ids of every document's whole text, and whether decoding them gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model, kind)
        for batch in batches:
            for part in slices(batch, 1, 500):
                texts = part.column(1).to_pylist()
                ids = [pieces.encode(t) for t in texts]
                exact = [None if t is None else pieces.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], ["key", "ids", "exact"])
        pieces.forget()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids array<int>, exact boolean").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids", kind: int | None = None) -> DataFrame:
    """(key, text) of every row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pieces.decode(i) for i in part.column(1).to_pylist()], pa.string())], ["key", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)
