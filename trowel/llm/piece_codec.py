"""SentencePiece encoding and decoding (BPE models) with the merge-type prefix table.

A prefix of a BPE encoding is the encoding of a prefix: each prefix of a segment has one last token.
For every end position an automaton lists the pieces that end there, longest first; the first whose
predecessor, the last token of the prefix before it, is compatible with it is that prefix's last
token. Ids are recovered backwards from the last prefix. Two tokens are compatible if merging the
text of both would not have joined something across their border first: found by undoing merges on
both sides of the border, latest first, and looking for a piece across it with an earlier rank.

Segments: no piece has the space mark after another character, so text is cut before each run of
marks; characters that are no piece (among them line feeds) become byte tokens and cut as well.
Segments that begin with two marks or more, whose pieces tie in rank, are merged directly.

Bounded memory: known segments are kept in two generations of CACHE entries in each worker, and
segments of more than LONGEST characters are not kept. No shuffle; a text is one row's work.

Defined results: null and empty text have no tokens (digests of the empty string). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import tidy
from trowel.session import ship_package

MARK = "▁"
CACHE, LONGEST = 160_000, 64


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message; values are ints or bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes) -> None:
        import struct

        self.pieces: list[str] = []
        self.bytes_of: dict[int, int] = {}
        scores, self.rank, self.id, byte_id = [], {}, {}, {}
        settings: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: bytes(4), 3: 1} | dict(_fields(value))
                own, text = len(self.pieces), piece[1].decode("utf-8")
                self.pieces.append(text)
                scores.append(struct.unpack("<f", piece[2])[0])
                if piece[3] == 6:
                    byte_id[int(text[3:5], 16)] = own
                elif piece[3] == 1:
                    self.id[text] = own
            elif number == 3:
                settings = dict(_fields(value))
        if settings.get(2) or settings.get(4, 1) or not settings.get(3, 1) or len(byte_id) < 256:
            raise ValueError("only models with identity normalisation, a dummy prefix, all white space kept and byte fallback are supported")
        if any(MARK in p.lstrip(MARK) or (p[0] == MARK and p[1:2] == MARK and p.strip(MARK)) for p in self.id) or "\n" in self.id:
            raise ValueError("pieces with a space mark after other characters, or with line feeds, are not supported")
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a character of a piece is no piece itself")
        self.byte_id = byte_id
        self.bytes_of = {own: byte for byte, own in byte_id.items()}
        self.order = {own: -scores[own] for own in self.id.values()}  # smaller merges first
        ranked = sorted(self.id.values(), key=lambda own: (self.order[own], own))
        # single characters never come from a merge: they rank before all merges
        self.rank = {own: (n + 1 if len(self.pieces[own]) > 1 else -1 - n) for n, own in enumerate(ranked)}
        self.halves: dict[int, tuple[int, int]] = {}
        for text, own in self.id.items():
            if len(text) > 1 and set(text) != {MARK}:
                last = self._merge(text)[1]
                self.halves[own] = last if last else (-1, -1)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, own in self.id.items():
            if set(text) != {MARK} or text == MARK:
                if self.halves.get(own, (0, 0)) != (-1, -1):
                    self.automaton.add_word(text, (own, len(text)))
        self.automaton.make_automaton()
        self.known = set("".join(self.id)) - {"\n"}
        self.odd = re.compile("[^" + re.escape("".join(sorted(self.known))) + "]")
        self.pairs: dict[int, bool] = {}
        self.segments = _Generations(self)

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids by merging the best pair again and again, leftmost of equals, and the halves of the last merge if one piece is left."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                own = self.id.get(parts[i] + parts[j])
                if own is not None:
                    heapq.heappush(heap, (self.order[own], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            last = (self.id[left], self.id[right])
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out = [x for x in parts if x is not None]
        return [self.id[x] for x in out], last if len(out) == 1 else None

    def _compatible(self, left: int, right: int) -> bool:
        rank, halves, pieces, lookup = self.rank, self.halves, self.pieces, self.id
        limit = 1 << 60
        while True:
            joined = lookup.get(pieces[left] + pieces[right])
            if joined is not None and rank[joined] < limit:
                return False
            # undo the later of the two merges at the border; one that made the right token yields to an equal one across it
            if rank[left] > rank[right] and left in halves:
                limit, left = rank[left], halves[left][1]
            elif right in halves:
                limit, right = rank[right] + 1, halves[right][0]
            else:
                return True

    def _plain(self, text: str) -> list[int]:
        """Ids of a text of known characters with at most one mark, at its start."""
        last, seen = [-1] * (len(text) + 1), self.pairs
        for end, (own, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    key = last[start] << 32 | own
                    ok = seen.get(key)
                    if ok is None:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        ok = seen[key] = self._compatible(last[start], own)
                    if not ok:
                        continue
                last[end] = own
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        ids.reverse()
        return ids

    def _known(self, text: str) -> list[int]:
        if not text:
            return []
        return self._merge(text)[0] if text.startswith(MARK + MARK) else self._plain(text)

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a segment: marks at its start only."""
        ids, at = [], 0
        for odd in self.odd.finditer(text):
            ids += self._known(text[at : odd.start()])
            ids += [self.byte_id[b] for b in odd[0].encode("utf-8", "surrogatepass")]
            at = odd.end()
        return ids + self._known(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the first space is the prefix's."""
        text = self._surface(ids)
        return text.removeprefix(" ")

    def _surface(self, ids: list[int]) -> str:
        if self.bytes_of.keys().isdisjoint(ids):
            return "".join([self.pieces[x] for x in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for own in ids:
            if own in self.bytes_of:
                run.append(self.bytes_of[own])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[own].replace(MARK, " "))
        return "".join(out) + run.decode("utf-8", "replace")

    def keys(self, text: str) -> list[str]:
        """Segments of a text: one without its mark, one that begins with several marks, or a line feed and what follows it."""
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or MARK in text:
            parts = [x[1:] if x[0] == MARK and x[1:2] != MARK else x for x in re.findall(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*", MARK + text.replace(" ", MARK))]
        return parts

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text)[0].split(",") if x]

    def encode_text(self, text: str) -> tuple[str, str]:
        """The ids of a text, comma-joined, and the text that they decode to."""
        keys = self.keys(text)
        if not keys:
            return "", ""
        ids, surfaces = zip(*map(self.segments.__getitem__, keys), strict=True)
        return ",".join(ids), "".join(surfaces).removeprefix(" ")


class _Generations(dict):
    """Segment -> (ids, surface); when it is full, what was not asked for since the last time is dropped."""

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, key: str) -> tuple[str, str]:
        found = self.older.get(key)
        if found is None:
            ids = self.codec.encode_segment(key if key[:1] == "\n" or key.startswith(MARK + MARK) else MARK + key)
            found = ",".join(map(str, ids)), self.codec._surface(ids)
            if len(key) > LONGEST:
                return found
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per model and process."""
    name = hashlib.sha256(model).digest()
    if name not in _CODECS:
        _CODECS[name] = PieceCodec(model)
    return _CODECS[name]


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded."""
    ship_package(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def rows(batches):
        own = codec(model)
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column(1):
                joined, decoded = own.encode_text(text.as_py() or "")
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in joined.split(",") if x])
                    texts.append(decoded)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), schema)
