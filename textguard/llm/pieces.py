"""SentencePiece encoding (BPE models with byte fallback) and decoding, exactly.

The merge procedure is not run on texts. A sequence of pieces is the encoding of a text
if and only if each two neighbours are: merging the characters of both anew must give
the two pieces back. So the encoder walks a text from left to right with the longest
piece at each place, as an Aho-Corasick automaton reports them, checks it against the
piece before, tries shorter ones where the check fails, and steps back where none is
left; a bit field remembers the positions from which no encoding can follow. Checks of
pairs are kept, so that few of them merge anything.

Characters that no piece holds side by side never merge. Texts are cut at such places,
spaces and line ends above all, and the encodings of the parts are kept in a table of
bounded size per worker. Each document is encoded whole.

Defined cases: a null or empty text has no ids, and no ids decode to an empty text.
Null ids decode as none. Rows are independent of each other. Other columns pass
unchanged; the column that is added replaces one of its name.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textguard.llm.store import in_arrow, keep

SPACE = "▁"
#: Entries of a table of kept results in a worker; a full table starts anew. Longer
#: strings than ``LONG`` are not kept, so 100,000 entries take some 20 MB. A missed unit or pair
#: costs far more than a missed part, and texts hold many more of them.
KEPT = 100_000
KEPT_UNITS, KEPT_PAIRS, KEPT_PARTS = 600_000, 300_000, 50_000
LONG = 64


class Kept(dict):
    """A table of results that starts anew when it is full."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most
        keep(self)

    def __missing__(self, key):
        if type(key) is str and len(key) > LONG:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Pieces:
    """Encoder and decoder of one model file. What only encoding needs is made then."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.piece = [None if special[i] else model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # Bytes each id decodes to; control ids stand for nothing.
        self.out = [p.replace(SPACE, " ").encode() if p else b"" for p in self.piece]
        self.out[model.unk_id()] = " ⁇ ".encode()
        self.is_byte = np.zeros(n, bool)
        for b, i in enumerate(self.byte):
            self.out[i] = bytes([b])
            self.is_byte[i] = True
        self.silent = np.array([not o for o in self.out])

    @functools.cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.piece) if p}

    @functools.cached_property
    def rank(self) -> dict[str, float]:
        return {p: -self.score[i] for p, i in self.ids.items()}

    @functools.cached_property
    def pairs(self) -> set[str]:
        """All two characters that stand side by side in a piece."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @functools.cached_property
    def size(self) -> list[int]:
        return [len(p or "") for p in self.piece]

    @functools.cached_property
    def shorter(self) -> list[int]:
        """The next shorter piece that a piece starts with, or 0."""
        heads = lambda p: (self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids)
        return [next(heads(p), 0) if p else 0 for p in self.piece]

    @functools.cached_property
    def found(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, i)
        found.make_automaton()
        return found

    @functools.cached_property
    def fits(self) -> Kept:
        return Kept(self._fits, KEPT_PAIRS)

    @functools.cached_property
    def part(self) -> Kept:
        return Kept(self._part, KEPT_PARTS)

    @functools.cached_property
    def unit(self) -> Kept:
        return Kept(self._unit, KEPT_UNITS)

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for short strings: best score first, leftmost of
        equals."""
        none, rank = math.inf, self.rank
        parts = list(text)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether two neighbours come back from merging anew. The first id is in the bits
        above 20; a text's first piece has 0 there and has to come back alone."""
        own = [self.piece[i] for i in (pair >> 20, pair & 0xFFFFF) if i]
        return self.merged("".join(own)) == own

    def _search(self, text: str) -> list[int]:
        """Encoding of a text whose characters all are pieces."""
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        longest = [0] * n
        for end, i in self.found.iter(text):  # by end, so the longest of a start comes last
            longest[end - size[i] + 1] = i
        failed, place, last, out, i = 0, 0, 0, [], longest[0]
        while True:
            while i and (failed >> (place + size[i]) & 1 or not fits[last << 20 | i]):
                i = shorter[i]
            if i:
                out.append(i)
                place += size[i]
                if place == n:
                    return out
                last, i = i, longest[place]
            elif out:
                failed |= 1 << place
                i = out.pop()
                place -= size[i]
                last, i = out[-1] if out else 0, shorter[i]
            else:
                raise ValueError(f"no encoding of {text!r}")

    def _part(self, text: str) -> bytes:
        """Encoding of a text within which any two neighbours meet in some piece."""
        ids = self._search(text) if text[0] in self.ids else [self.byte[b] for b in text.encode()]
        return array("i", ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a part of a text; a space is put before it unless it has its own mark or
        starts a line."""
        text = unit if unit[:1] in (SPACE, "\n") else SPACE + unit
        pairs, part, start, out = self.pairs, self.part, 0, []
        if pairs.issuperset(map(add, text, text[1:])):
            return self._part(text)  # kept as the unit
        for i, pair in enumerate(map(add, text, text[1:]), 1):
            if pair not in pairs:
                out.append(part[text[start:i]])
                start = i
        return b"".join(out) + part[text[start:]]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as 32-bit integers."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text:
            marked = SPACE + text.replace(" ", SPACE)
            units = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", marked)
        else:
            units = text.replace("\n", " \n").split(" ")
        return b"".join(map(self.unit.__getitem__, units))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids. Bytes that are not UTF-8 become U+FFFD one by one."""
        if not len(ids):
            return ""
        out, each = self.out, ids.tolist()
        raw = b"".join(map(out.__getitem__, each))
        try:
            # Bytes on both sides of a control id are no character together.
            text = self._decode_bytes(ids) if self.silent[ids].any() else raw.decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        # The space before the first word is none of the text's, unless an unknown piece or bytes come before it.
        first = next((self.piece[i] for i in each if out[i]), None)
        return text[1:] if first and first[0] == SPACE else text

    def _decode_bytes(self, ids: np.ndarray) -> str:
        kind, text = self.is_byte[ids], []
        for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(kind)) + 1):
            raw = b"".join(self.out[i] for i in ids[run].tolist())
            if not kind[run[0]]:
                text.append(raw.decode())
                continue
            while raw:
                try:
                    text.append(raw.decode())
                    break
                except UnicodeDecodeError as bad:
                    text.append(raw[: bad.start].decode() + "�")
                    raw = raw[bad.start + 1 :]
        return "".join(text)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``column`` as its last, in place of one of that name."""
    kept = [i for i, field in enumerate(batch.schema) if field.name != name]
    arrays = [batch.column(i) for i in kept] + [column]
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.field(i).name for i in kept] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


#: Bytes of text after which the rows of a batch are handed on.
SLICE = 3_000_000


def _slices(batch: pa.RecordBatch, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    coder = pieces(path)
    for whole in batches:
        column = whole.column(whole.schema.names.index(text))
        for batch in _slices(whole, column):
            coded = [coder.encode(t) for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), np.int32))
            yield _appended(batch, ids, pa.ListArray.from_arrays(pa.array(ends), values))


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    coder = pieces(path)
    for batch in batches:
        column = batch.column(batch.schema.names.index(ids))
        if column.null_count:
            column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy()
        texts = [coder.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
        yield _appended(batch, text, pa.array(texts, pa.string()))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``, the encoding of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, text, ids)

    return in_arrow(df, run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, the decoding of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, path, ids, text)

    return in_arrow(df, run, _schema(df, text, T.StringType()))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, as ``encode`` and ``decode`` after it. One worker does
    both, so that a task needs one process, and one set of tables, instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, path, text, ids), path, ids, decoded)

    coded = _schema(df, ids, T.ArrayType(T.IntegerType()))
    return in_arrow(df, run, T.StructType([f for f in coded.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())]))
