"""Op 4 — SentencePiece encoding and decoding by a weighted transducer.

Compiled once per process from a model file: the normaliser (spaces to
U+2581, the mark before the text), an arc for every piece, and byte-fallback
arcs for characters that no piece covers.  Composed with an input this is a
lattice over its positions, and the encoding is the shortest path in the
tropical semiring (min, +).

Weights.  The models here are byte-pair models: pieces join by rank, which a
sum of piece scores does not reproduce.  It has an exact form over pairs:
a sequence of pieces is the encoding if and only if every two neighbours stay
apart when their joint text is encoded.  So the automaton's state is the last
piece, an arc costs 0 if the pair stays apart and infinity if it does not,
and exactly one path has a finite weight.  Whether a pair stays apart is
worked out when first met.

No piece holds the mark behind another character, so the lattice falls apart
at each mark that follows one; such chunks are composed on their own and
their paths remembered (``CACHE`` of them per process).

One narrow pass over whole texts.  Edge cases: null text counts as empty (no
ids); literal U+2581 decodes as a space, as in the library; ids may be null
or repeat, each row is encoded on its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmatch.llm.tokencount import vocabulary_path

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE, PAIRS = 800_000, 1_000_000
LONGEST_CACHED = 48
#: Piece types of the model file that this compiler knows, and its model type.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, message[at:at + size]
        at += size


class Transducer:
    """A compiled model: :meth:`encode` and :meth:`decode`."""

    def __init__(self, model: bytes):
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.out: list[bytes] = []
        for number, value in _fields(model):
            if number == 1:
                self._piece(dict(_fields(value)))
            elif number == 2 and dict(_fields(value)).get(3, 1) != BPE:
                raise ValueError("only byte-pair models are compiled")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1):
                    raise ValueError("only the identity normaliser with a leading mark is compiled")
        self.longest = max(map(len, self.id), default=1)
        self.reach: dict[str, int] = {}  # the longest piece by its first two characters
        for piece in self.id:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 1), len(piece))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.apart: dict[tuple[str, str], float] = {}
        self.paths: dict[str, bytes] = {}

    def _piece(self, fields: dict) -> None:
        k, text, kind = len(self.out), fields[1].decode(), fields.get(3, NORMAL)
        if kind == NORMAL:
            self.id[text], self.rank[text] = k, struct.unpack("<f", fields[2])[0]
            self.out.append(text.replace(MARK, " ").encode())
        elif kind == BYTE:
            self.byte[int(text[3:5], 16)] = k
            self.out.append(bytes([int(text[3:5], 16)]))
        elif kind in (UNKNOWN, CONTROL):
            self.out.append(b"")
        else:
            raise ValueError(f"piece type {kind} is not compiled")

    def joined(self, text: str) -> list[str]:
        """Characters joined by rank, the leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1], -math.inf)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, before: str, piece: str) -> float:
        """Tropical weight of ``piece`` after ``before``."""
        found = self.apart.get((before, piece))
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            stays = self.joined(before + piece) == ([before, piece] if before else [piece])
            found = self.apart[before, piece] = 0.0 if stays else math.inf
        return found

    def path(self, chunk: str) -> list[str]:
        """Pieces on the shortest path through the lattice of a chunk; a
        character that no piece covers stands for its bytes.  As weights are 0
        or infinite, the search goes depth first along arcs of weight 0,
        longest first, and leaves a position without a way on for good: only
        one state of it lies on a finite path."""
        n, pieces, known = len(chunk), self.id, self.apart.get
        reach, most = self.reach.get, self.longest
        out: list[str] = []
        at, length = 0, min(n, reach(chunk[:2], 1))
        lengths: list[int] = []
        dead: set[int] = set()
        while at < n:
            before = out[-1] if out else ""
            while length:
                piece = chunk[at:at + length]
                if (length == 1 or piece in pieces) and at + length not in dead:
                    cost = known((before, piece))
                    if cost is None:
                        cost = self.weight(before, piece)
                    if not cost:
                        break
                length -= 1
            if length:
                out.append(piece)
                lengths.append(length)
                at += length
                length = min(n - at, reach(chunk[at:at + 2], 1), most)
            else:
                dead.add(at)
                out.pop()
                length = lengths.pop()
                at -= length
                length -= 1
        return out

    def _ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.path(chunk):
            k = self.id.get(piece)
            ids += [k] if k is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        packed = np.array(ids, "<i4").tobytes()
        if len(chunk) <= LONGEST_CACHED:
            if len(self.paths) >= CACHE:
                self.paths.clear()
            self.paths[chunk] = packed
        return packed

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        normal = MARK + text.replace(" ", MARK)
        chunks = CHUNK.findall(normal) if self.cuts else [normal]
        get, make = self.paths.get, self._ids
        return np.frombuffer(b"".join([get(c) or make(c) for c in chunks]), "<i4")

    def decode(self, ids) -> str:
        """The text of ids, without the space of the leading mark."""
        out = self.out
        return b"".join([out[k] for k in ids]).decode("utf-8", "replace").removeprefix(" ")


_COMPILED: dict[str, Transducer] = {}


def compiled(name: str) -> Transducer:
    if name not in _COMPILED:
        with open(vocabulary_path(name), "rb") as f:
            _COMPILED[name] = Transducer(f.read())
    return _COMPILED[name]


def _by_text(df: DataFrame, id_col: str, text_col: str, fields: list[tuple], each) -> DataFrame:
    """``id_col`` and, per row, what ``each`` makes of the text."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t, _ in fields)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = list(zip(*[each(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(list(c), kind) for c, (_, _, kind) in zip(found, fields))], names=schema.names)

    return rows.mapInArrow(made, schema).withColumnRenamed("id", id_col)


def encode(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every row."""
    return _by_text(df, id_col, text_col, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))],
                    lambda text: (compiled(model).encode(text),))


def decode(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of every row of ids; null ids give an empty text."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [compiled(model).decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(made, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_crc32, decoded_crc32, round_trip``: count and
    hash (of little-endian 32-bit ids) of the encoding, hash of the text that
    decoding gives back (UTF-8), and whether that is the input."""
    def each(text: str) -> tuple:
        transducer = compiled(model)
        ids = transducer.encode(text)
        back = transducer.decode(ids.tolist())
        return (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")),
                back == text.replace(MARK, " "))

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()),
              ("decoded_crc32", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    return _by_text(df, id_col, text_col, fields, each)
