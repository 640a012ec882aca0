"""Disguised variants of texts and how well a scorer still finds them.

The choice at each place comes from the digest of text and method, and from the
place, by integer arithmetic that any engine can repeat; a rerun gives the same
variants. Every edit is linear in the text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.text import cut
from textguard.session import ship

# Edit shares, steps, probabilities, characters and tables.
SINGLE_SHARE, STEP_SHARE, STEPS = 0.15, 0.1, 5
SUBSTITUTES = ("!", "@", "#", "$", "%", "^", "&", "*", "_", "-", ".", ",", ";", ":", "0", "3", "5", "7")
INSERTS = (" ", "\t", "​", ".", "-", "_", "!", "?")
HOMOGLYPHS = {
    "a": "а", "e": "е", "o": "о", "p": "р", "c": "с",
    "x": "х", "y": "у", "i": "і", "j": "ј", "s": "ѕ",
    "I": "Ι", "O": "Ο", "P": "Ρ", "A": "Α", "E": "Ε",
}
SPLITTERS = (".", "-", "_", " ", "|", "/", "\\")
BLANKS = (" ", "\t", " ", "​", "　")
ENTITIES = {"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "&": "&amp;", " ": "%20", "/": "%2F"}
WEIGHTS = {"single": 0.3, "multi": 0.4, "evasion": 0.3}
SHOWN = 80


#: Two primes, the larger last, and multipliers whose products stay within a long.
PRIMES, FACTORS, PLACE, SALT = (2147483629, 2147483647), (1223106847, 1664525957), 7919, 104729


#: Bytes of text that are edited at once; a longer text is edited on its own.
SLICE = 1_000_000
_BLANKS = re.compile("[\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", re.ASCII)
_CODES = "utf-32-le"


def _modulo(x: np.ndarray, n: int) -> np.ndarray:
    """``x % n``; numpy divides by a fixed number much faster than it takes remainders."""
    return x - x // np.uint64(n) * np.uint64(n)


def _roll(seeds: np.ndarray, places: np.ndarray, salt: int = 0) -> np.ndarray:
    """A number below the larger prime for each place; places of a text differ."""
    x = seeds + places * np.uint64(PLACE) + np.uint64(salt * SALT)
    if len(x) and int(x.max()) >= 1 << 32:
        x = _modulo(x, PRIMES[0])  # the product below has to fit in 64 bits
    return _modulo(_modulo(x * np.uint64(FACTORS[0]), PRIMES[0]) * np.uint64(FACTORS[1]), PRIMES[1])


def _codes(chars: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(chars).encode(_CODES), np.uint32)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class _Texts:
    """Texts of a slice as one array of characters, with the place of each in its text."""

    def __init__(self, chars: np.ndarray, starts: np.ndarray):
        self.chars, self.starts, self.sizes = chars, starts, np.diff(starts)

    @classmethod
    def of(cls, texts: Sequence[str]) -> _Texts:
        return cls(_codes(texts), _starts(np.array([len(t) for t in texts], np.int64)))

    def strings(self) -> list[str]:
        whole = self.chars.tobytes().decode(_CODES)
        bounds = self.starts.tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]

    def seeds(self, method: str) -> np.ndarray:
        return _seeds(self.strings(), method)

    @functools.cached_property
    def places(self) -> np.ndarray:
        return (np.arange(len(self.chars)) - np.repeat(self.starts[:-1], self.sizes)).astype(np.uint64)

    def replaced(self, counts: np.ndarray, chars: np.ndarray | None = None) -> tuple[_Texts, np.ndarray]:
        """Texts in which each character stands ``counts`` times, and where each now begins."""
        ends = _starts(counts)
        return _Texts(np.repeat(self.chars if chars is None else chars, counts), ends[self.starts]), ends[:-1]


def _seeds(texts: Sequence[str], method: str) -> np.ndarray:
    tail = method.encode()
    return np.array([int(hashlib.md5(t.encode() + tail).hexdigest()[:7], 16) for t in texts], np.uint64)


def edited(texts: _Texts, share: float, method: str) -> _Texts:
    """Each text with a share of its characters (one at least) replaced, preceded by an
    extra one, or dropped."""
    seeds, sizes = np.repeat(texts.seeds(method), texts.sizes), texts.sizes
    rolls = _roll(seeds, texts.places)
    # Places with the smallest rolls change: as many as asked, all different.
    limits = np.zeros(len(sizes), np.uint64)
    for row, (start, size) in enumerate(zip(texts.starts.tolist(), sizes.tolist())):
        if size:
            last = max(math.floor(size * share), 1) - 1
            limits[row] = np.partition(rolls[start : start + size], last)[last]
    at = np.flatnonzero(rolls <= np.repeat(limits, sizes))
    seeds, places = seeds[at], texts.places[at]
    action = _modulo(_roll(seeds, places, 1), 3)
    swap, extra, drop = at[action == 0], at[action == 1], at[(action == 2) & (np.repeat(sizes, sizes)[at] > 1)]
    pick = lambda options, kind, salt: _codes(options)[_modulo(_roll(seeds, places, salt), len(options))[action == kind]]
    chars, counts = texts.chars.copy(), np.ones(len(texts.chars), np.int64)
    chars[swap], counts[extra], counts[drop] = pick(SUBSTITUTES, 0, 2), 2, 0
    out, begins = texts.replaced(counts, chars)
    out.chars[begins[extra]] = pick(INSERTS, 1, 3)
    return out


def _among(texts: _Texts, seeds: np.ndarray, wanted: np.ndarray, salt: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the ``wanted`` characters whose draw of 10 is under ``below``, with their seeds."""
    at = np.flatnonzero(wanted)
    own = np.repeat(seeds, texts.sizes)[at]
    drawn = _modulo(_roll(own, texts.places[at], salt), 10) < below
    return at[drawn], own[drawn]


def homoglyphs(texts: _Texts, seeds: np.ndarray) -> list[str]:
    table = np.arange(128, dtype=np.uint32)
    table[_codes(tuple(HOMOGLYPHS))] = _codes(tuple(HOMOGLYPHS.values()))
    alike = np.where(texts.chars < 128, table[np.minimum(texts.chars, 127)], texts.chars)
    at, _ = _among(texts, seeds, alike != texts.chars, 10, 3)
    chars = texts.chars.copy()
    chars[at] = alike[at]
    return _Texts(chars, texts.starts).strings()


def spaced(texts: _Texts, seeds: np.ndarray) -> list[str]:
    at, own = _among(texts, seeds, texts.chars != ord(" "), 20, 2)
    counts = np.ones(len(texts.chars), np.int64)
    counts[at] = 2
    out, begins = texts.replaced(counts)
    out.chars[begins[at] + 1] = _codes(BLANKS)[_modulo(_roll(own, texts.places[at], 21), len(BLANKS))]
    return out.strings()


def entities(texts: _Texts, seeds: np.ndarray) -> list[str]:
    at, _ = _among(texts, seeds, np.isin(texts.chars, _codes(tuple(ENTITIES))), 30, 3)
    old, counts = texts.chars[at], np.ones(len(texts.chars), np.int64)
    for char, entity in ENTITIES.items():
        counts[at[old == ord(char)]] = len(entity)
    out, begins = texts.replaced(counts)
    for char, entity in ENTITIES.items():
        out.chars[begins[at[old == ord(char)]][:, None] + np.arange(len(entity))] = _codes(entity)
    return out.strings()


def split_words(words: list[str], seed: np.ndarray) -> str:
    places, out = np.arange(len(words), dtype=np.uint64), words[:]
    marks = _modulo(_roll(seed, places, 41), len(SPLITTERS)).tolist()
    for i in np.flatnonzero(_modulo(_roll(seed, places, 40), 10) < 3).tolist():
        word, middle = words[i], len(words[i]) // 2
        if len(word.encode()) > 2:
            out[i] = word[:middle] + SPLITTERS[marks[i]] + word[middle:]
    return " ".join(out)


def reordered(words: list[str], seed: np.ndarray) -> str:
    """Words with up to two fifths of swaps: the places taken are the same, the
    words on them change seats."""
    order = np.argsort(_roll(seed, np.arange(len(words), dtype=np.uint64), 50), kind="stable")
    moved = order[: min(len(words), math.floor(len(words) * 0.4) * 2)]
    out = words[:]
    for seat, i in zip(np.sort(moved).tolist(), moved.tolist()):
        out[seat] = words[i]
    return " ".join(out)


BY_CHARACTER = {"unicode-homoglyph": homoglyphs, "whitespace-injection": spaced, "encoding-mix": entities}
BY_WORD = {"character-splitting": split_words, "word-reordering": reordered}


def _forms(given: Sequence[str], steps: int, single_share: float, step_share: float) -> list[list[str]]:
    """The texts in each form, in the order of the methods."""
    texts = last = _Texts.of(given)
    out = [edited(texts, single_share, "single").strings()]
    for step in range(1, steps + 1):
        last = edited(last, step_share, f"multi{step}")
        out.append(last.strings())
    seeds = _seeds(given, "evasion")
    out += [form(texts, seeds) for form in BY_CHARACTER.values()]
    # An empty text counts as one empty character, which may get a blank behind it.
    for row in np.flatnonzero(texts.sizes == 0).tolist():
        draw = lambda n, salt: int(_modulo(_roll(seeds[row : row + 1], np.zeros(1, np.uint64), salt), n)[0])  # noqa: B023, E731
        if draw(10, 20) < 2:
            out[1 + steps + list(BY_CHARACTER).index("whitespace-injection")][row] = BLANKS[draw(len(BLANKS), 21)]
    words = [[w for w in _BLANKS.split(t) if w] for t in given]
    out.append([split_words(w, seeds[i : i + 1]) for i, w in enumerate(words)])
    # One or two words have no other order; they stay as they are.
    out.append([reordered(w, seeds[i : i + 1]) if len(w) > 2 else given[i] for i, w in enumerate(words)])
    return out


def _slices(batch: pa.RecordBatch, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def variants(
    df: DataFrame, keys: Sequence[str], text: str = "text", steps: int = STEPS,
    single_share: float = SINGLE_SHARE, step_share: float = STEP_SHARE,
) -> DataFrame:
    """One row per text and method: single edit, each of the repeated edits, and
    each evasion. No shuffle; the rows stream out of the scan. Workers edit the texts
    of a slice together, as arrays of characters; a null text has null variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.names.index(text)
            for batch in _slices(whole, whole.column(at)):
                given = batch.column(at).to_pylist()
                forms = iter(zip(*_forms([t for t in given if t is not None], steps, single_share, step_share)))
                made = pa.array([None if t is None else next(forms) for t in given], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "__forms"])

    # The names of the methods.
    names = [("fgsm", "single", 0)] + [(f"pgd-step-{s}", "multi", s) for s in range(1, steps + 1)]
    names += [(f"evasion-{n}", "evasion", 0) for n in (*BY_CHARACTER, *BY_WORD)]
    rows = [
        F.struct(
            F.lit(method).alias("method"), F.lit(group).alias("method_group"), F.lit(step).alias("step"),
            F.get("__forms", F.lit(i)).alias("perturbed"),
        )
        for i, (method, group, step) in enumerate(names)
    ]
    source = df.select(*keys, text)
    ship(df.sparkSession)
    staged = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("__forms", T.ArrayType(T.StringType()))]))
    return staged.select(*keys, F.col(text).alias("input"), F.inline(F.array(*rows)))


def custom_variants(
    df: DataFrame, keys: Sequence[str], generator: Callable[[Column], Column], text: str = "text"
) -> DataFrame:
    """One row per variant of a user's generator, an array-valued expression."""
    return df.select(*keys, F.col(text).alias("input"), F.explode(generator(F.col(text))).alias("perturbed"))


def judged(rows: DataFrame, scanner: Callable[[DataFrame], DataFrame], into: str = "set_score") -> DataFrame:
    """Adds ``score`` and ``detected`` from a scanner, a job that adds a struct
    ``into`` with ``score`` and ``is_threat`` of the column ``perturbed``."""
    seen = scanner(rows)
    return seen.withColumns({"score": F.col(into)["score"], "detected": F.col(into)["is_threat"]}).drop(into)


def scored(
    rows: DataFrame, scorer: Callable[[Column], Column], threshold: float, score: str = "score"
) -> DataFrame:
    """Variants with score and detection, texts cut for display."""
    judged = rows.withColumn(score, scorer(F.col("perturbed")))
    return judged.withColumns(
        {
            "detected": F.col(score) >= threshold,
            "input": cut(F.col("input"), SHOWN),
            "perturbed": cut(F.col("perturbed"), SHOWN),
        }
    )


def robustness(rows: DataFrame) -> DataFrame:
    """Tests, passes and detected share per method group, and the weighted whole."""
    groups = list(WEIGHTS)
    counts = rows.agg(
        *[F.count(F.when(F.col("method_group") == g, 1)).alias(f"{g}_tests") for g in groups],
        *[F.count(F.when((F.col("method_group") == g) & F.col("detected"), 1)).alias(f"{g}_passed") for g in groups],
    )
    share = lambda g: F.coalesce(F.try_divide(F.col(f"{g}_passed"), F.col(f"{g}_tests")) * 100, F.lit(0.0))
    rated = counts.select("*", *[share(g).alias(f"{g}_robustness") for g in groups])
    overall = F.lit(0.0)
    for g in groups:
        overall = overall + F.col(f"{g}_robustness") * WEIGHTS[g]
    return rated.withColumn("overall_robustness", overall)
