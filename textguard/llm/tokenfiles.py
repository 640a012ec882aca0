"""Token files: ids of all documents in the order of their ids, entropy-coded.

Documents are range-partitioned and sorted by id, so that a task holds a stretch of the
order. A task encodes its texts with the tokenizers library and cuts the stream of ids,
document after document, into groups of bounded size. A group is one row of the files:
the ids and lengths of its documents, one frequency table, and independent blocks of
interleaved ANS states over that table, each with check points and a checksum
(``rans``). Positions in the whole stream follow from one sum per task.

The library's results are kept per word in a bounded table of the worker: the texts of a
batch are taken apart as one array of bytes, by the classes of neighbouring bytes, and only
words that are not in the table are handed to the library; very long ones are not kept.
Stretches between white space with signs for which that is not certain count as one word,
and texts with special tokens or letters beyond Latin go to the library whole.

Defined cases: a null or empty text has the end id alone. Documents with a null id come
first; rows that repeat an id follow each other by a hash of their text, and may lie in
several tasks. Extra columns are not
read. An empty table gives empty files.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from textguard.llm import rans
from textguard.llm.store import in_arrow

#: Id written after each document.
END = 1
#: Ids after which a group is closed, at the end of a document.
GROUP = 2_000_000
#: Words whose ids a worker keeps, none longer than ``LONG``; a full table starts anew with those of the texts at hand.
KEPT = 600_000
LONG = 64
_SLICE = 8_000_000
#: Texts of these characters are the same to Python and to the library in all that
#: matters here: normal form, lower case, white space, letters and numbers.
_PLAIN = re.compile("[\t-\r -~ -įı-ž]*")
#: Words that the library takes for one if no space stands within them.
_SIMPLE_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: Class of each byte of a plain text in lower case. Bytes beyond ASCII are letters, but for
#: the stretches that ``_ODD`` finds.
_CLASS = np.full(256, _LETTER, np.uint8)
_CLASS[:128] = _SIGN
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
#: First bytes of the signs and letters that ``_SIMPLE_TEXT`` lacks, and second bytes of ``×`` and ``÷``.
_ODD, _ODD_NEXT = np.zeros(256, bool), np.zeros(256, bool)
_ODD[[0xC2, 0xC4, 0xC5]] = _ODD_NEXT[[0x97, 0xB7]] = True
#: Letters that make a word with the apostrophe before them.
_ONE, _TWO = np.zeros(256, bool), [tuple(x) for x in (b"re", b"ve", b"ll")]
_ONE[list(b"stmd")] = True

_NONE = np.zeros(0, "<u4")

SCHEMA = (
    "part int, seq int, before long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, symbols binary, "
    "freq binary, blocks array<struct<words: binary, states: binary, ends: binary, crc32: bigint>>"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("symbols", pa.binary()), ("freq", pa.binary()),
    ("blocks", pa.list_(pa.struct([("words", pa.binary()), ("states", pa.binary()), ("ends", pa.binary()), ("crc32", pa.int64())]))),
])


class Words:
    """Ids of texts, by way of a table of words."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # The same model for words that are in lower case and apart already. It is given the
        # library's signs for bytes: ASCII as it is, two signs for a letter of Latin-1.
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = [(c, level.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0xDF, 0x100))]
        self.word: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Asks the library for new words, many at once."""
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            text = " ".join(some)
            if not text.isascii():
                for letter, sign in self.signs:
                    text = text.replace(letter, sign)
            got = self.bare.encode(text, add_special_tokens=False)
            owner, ids = np.array(got.word_ids), np.array(got.ids, "<u4").tobytes()
            if len(owner) == 0 or owner[-1] != len(some) - 1:
                self.word.update((w, self._whole(w)) for w in some)
                continue
            ends = (4 * np.searchsorted(owner, np.arange(len(some) + 1))).tolist()
            self.word.update((w, ids[a:b]) for w, a, b in zip(some, ends, ends[1:]))

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.word) > KEPT:
            self.word = {w: self.word[w] for w in words if w in self.word}
        out = list(map(self.word.get, words))
        at = [i for i, x in enumerate(out) if x is None]
        new = [words[i] for i in at]
        if _SIMPLE_TEXT.fullmatch("".join(new)):
            self._learn(new)
        else:
            self._learn([w for w in new if _SIMPLE_TEXT.fullmatch(w)])
            self.word.update((w, self._whole(w)) for w in new if w not in self.word)
        for i, w in zip(at, new):
            out[i] = self.word[w] if len(w) <= LONG else self.word.pop(w)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit integers."""
        plain = [i for i, t in enumerate(texts) if t and "<|" not in t and _PLAIN.fullmatch(t)]
        out = [_NONE if not t else None for t in texts]
        # The words of all plain texts as numbers, and each different word once.
        lower = [texts[i].lower().encode() for i in plain]
        data = np.frombuffer(b"\n".join([*lower, b"", b""]), np.uint8)
        starts = _starts(data)
        held = data > 32  # white space is all that a plain text has below
        offsets = np.append(np.flatnonzero(starts[held]), np.count_nonzero(held))
        apart = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[held]))
        coded = apart.dictionary_encode()
        ids = pa.array(self._of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 4
        stream = np.frombuffer(ids.buffers()[2] or b"", "<u4")
        heads = np.cumsum([0] + [len(x) + 1 for x in lower])
        at = ends[np.searchsorted(np.flatnonzero(starts), heads)]
        for i, a, b in zip(plain, at, at[1:]):
            out[i] = stream[a:b]
        return [np.frombuffer(self._whole(t), "<u4") if x is None else x for x, t in zip(out, texts)]


def _starts(data: np.ndarray) -> np.ndarray:
    """Which bytes of plain texts in lower case start a word: letters and signs up to the next of
    another class, digits one by one, endings with their apostrophe. Line ends follow each text."""
    kind = _CLASS[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    starts = ((kind != before) | (kind == _DIGIT)) & (kind != _SPACE)
    mark = np.flatnonzero((data == ord("'")) & starts)
    one, two = data[np.minimum(mark + 1, len(data) - 1)], data[np.minimum(mark + 2, len(data) - 1)]
    longer = np.logical_or.reduce([(one == a) & (two == b) for a, b in _TWO])
    for size, some in ((2, mark[_ONE[one]]), (3, mark[longer])):
        starts[some + 1] = False
        starts[some + size] |= kind[some + size] != _SPACE
    odd = np.flatnonzero(_ODD[data])
    cross = np.flatnonzero(data == 0xC3)
    odd = np.concatenate([odd, cross[_ODD_NEXT[data[np.minimum(cross + 1, len(data) - 1)]]]])
    if len(odd):
        # From the white space before to that behind: no start but the first.
        space = np.flatnonzero(kind == _SPACE)
        behind = np.unique(np.searchsorted(space, odd))
        inside = np.zeros(len(data) + 1, np.int8)
        first = np.where(behind > 0, space[behind - 1] + 1, 0)
        inside[first] += 1
        inside[space[behind]] -= 1
        starts &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        starts[first] = True
    return starts


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _group(part: int, seq: int, before: int, ids: list[int | None], coded: list[np.ndarray], end: int) -> pa.RecordBatch:
    last = np.array([end], "<u4")
    stream = np.concatenate([x for c in coded for x in (c, last)])
    counts = np.bincount(stream)
    symbols = np.flatnonzero(counts)
    index = (np.cumsum(counts > 0) - 1)[stream]
    freq = rans.frequencies(counts[symbols])
    blocks = [
        {"words": w, "states": s.astype("<u8").tobytes(), "ends": e.astype("<i8").tobytes(), "crc32": crc}
        for w, s, e, crc in rans.encode(index, freq)
    ]
    row = {
        "part": part, "seq": seq, "before": before, "n_tokens": len(stream), "doc_ids": ids,
        "doc_tokens": [len(c) + 1 for c in coded], "symbols": symbols.astype("<u4").tobytes(),
        "freq": freq.astype("<u4").tobytes(), "blocks": blocks,
    }
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def write_tokens(docs: DataFrame, files: str, tokenizer: str, doc: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Writes the ids of ``docs`` to the folder ``files``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = words(tokenizer), TaskContext.get().partitionId()
        seq = before = size = 0
        ids: list[int | None] = []
        coded: list[np.ndarray] = []
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if b == a:
                    continue
                some = batch.slice(a, b - a)
                for i, c in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist())):
                    ids.append(i)
                    coded.append(c)
                    size += len(c) + 1
                    if size >= GROUP:
                        yield _group(part, seq, before, ids, coded, end)
                        seq, before, size, ids, coded = seq + 1, before + size, 0, [], []
        if ids:
            yield _group(part, seq, before, ids, coded, end)

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    in_arrow(ordered, run, SCHEMA).write.parquet(files)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            shape = (-1, rans.LANES)
            blocks = [
                (b["words"], np.frombuffer(b["states"], "<u8").reshape(shape), np.frombuffer(b["ends"], "<i8"), b["crc32"])
                for b in row["blocks"]
            ]
            index = rans.decode(blocks, np.frombuffer(row["freq"], "<u4").astype(np.int64), row["n_tokens"])
            stream = np.frombuffer(row["symbols"], "<u4")[index]
            ends = np.cumsum([0, *row["doc_tokens"]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["before"] + ends[:-1], pa.int64()),
                    pa.array(row["doc_tokens"], pa.int64()),
                    pa.array([stream[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                ],
                schema=out,
            )


def read_tokens(spark: SparkSession, files: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` per document: the ids before it, how many it has,
    and they themselves as 32-bit little-endian integers. Damaged blocks fail."""
    groups = spark.read.schema(SCHEMA).parquet(files)
    totals = groups.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per writing task.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    docs = in_arrow(groups, _decoded, "part int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")
