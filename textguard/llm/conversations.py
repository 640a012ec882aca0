"""Repair of conversations whose turns are lost, empty, doubled, cut off or misattributed.

A repaired conversation's roles read system (or none), then user and assistant in turn,
ending with the assistant; an empty one is right as well. Edits of rows in their order: keep (0), give another
role (2), delete (3, a must for blank and repeated rows), insert an empty turn (2); each
row that is cut off and stays adds 1. The cheapest edits are taken, of equal ones those
whose initials (D, I, K, R) come first.

All that matters of a row is one letter of its signature: its role's initial and its
fault. Conversations that end alike share the nodes of one automaton, built from the end
(a DAWG whose nodes are the different suffixes). A node holds, for each state of the roles'
grammar, the cost to go and the first edit of the best audit, which points at the node
behind it. Signatures are range-partitioned and sorted from their last letter on, so that
a task walks the automaton depth first and makes each node once; only the path at the
edge between two ranges is made twice. The sort key ends with the id, so a signature that
very many conversations share is split over several ranges.

Turns are sorted by conversation, turn, role and digest of the text, and stream through a
task with a row's letter as all that is kept. The texts are shuffled once, when the
edits are applied. One conversation is one stream, as its audit is one value and the
digest of its text is sequential: a very long one takes one task, in bounded memory but
for a letter a row.

Defined cases: a null role or text is one space; null turns come first, and a null id is a
conversation of its own. Equal turns are ordered by role, then by MD5 of the text; repeated rows
are duplicates. An empty table gives no rows. Columns beside id, turn, role and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.store import in_arrow, stored

BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a cut-off row that stays.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that a role's initial leads to, for each state.
_ON = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
#: The one of user and assistant that may follow, and the state it leads to.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)
#: Adjacent initials that are in order.
_PAIRS = ("su", "ua", "au")

FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_FIGURES = ", ".join(f"{c} long" for c in FIGURES)


def damaged(talk: DataFrame) -> DataFrame:
    """Turns with planted faults, by a digest of id and turn: about a quarter is hit.

    ``(conv_id, turn, role, text, present)``; a dropped turn stays with ``present`` false, so
    that no conversation is lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = talk.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("_kind") != 0))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("present"))


def _turns(rows: DataFrame) -> DataFrame:
    """Turns in defined types, without nulls in role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns else F.lit(True)
    id_, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    turns = rows.select(id_, turn, space("role"), space("text"), present.alias("present"))
    return turns.withColumn("digest", F.md5(F.col("text").cast("binary")))


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv_id, signature, <figures>)``, a letter a row: ``x`` must go; ``s u a o`` is the
    role's initial (``o``: another), a capital that the row is cut off."""
    tail = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = _turns(rows).select(
        "conv_id", "turn", "role", "digest", "present",
        letter.alias("letter"), (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # A conversation stays in one task; earlier equal rows come from a sort that can spill.
    same = Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn")
    judged = narrow.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t").otherwise("")
    ordered = judged.sortWithinPartitions("conv_id", "turn", "role", "digest").select(
        "conv_id", "turn", "present", "letter", fault.alias("fault")
    )
    return in_arrow(ordered, _signed, f"conv_id long, signature string, {_FIGURES}")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "signature", *FIGURES]
    types = [pa.int64(), pa.string(), *[pa.int64()] * len(FIGURES)]
    out: list[tuple] = []
    current, letters, seen = object(), [], None

    def close() -> None:
        if seen is not None:
            low, high, turns, counts, illegal = seen
            gaps = high - low + 1 - turns if turns else 0
            out.append((current, "".join(letters), gaps, counts["b"], counts["d"], counts["t"], illegal))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    last = None
    for batch in batches:
        for conv, turn, present, letter, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if seen is None or conv != current:
                close()
                current, letters, seen, last = conv, [], [None, None, 0, {"": 0, "b": 0, "d": 0, "t": 0}, 0], None
            if not present:
                continue
            if turn is not None and turn != seen[1]:
                seen[0] = turn if seen[0] is None else seen[0]
                seen[1], seen[2] = turn, seen[2] + 1
            seen[3][fault] += 1
            seen[4] += last is not None and last + letter not in _PAIRS
            last = letter
            letters.append("x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
        yield batch_of()
        out.clear()
    close()
    yield batch_of()


@functools.lru_cache(maxsize=65536)
def _node(letter: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost to go and first edit of a node by state; ``behind`` are the costs of the node after its row."""
    must, role, cut = letter == "x", letter.lower(), CUT * letter.isupper()
    options: list[dict[str, int]] = []
    for state in range(4):
        ways = {"D": DELETE + behind[state]}
        if not must:
            ways["R"] = RENAME + cut + behind[_NEXT[state]]
            if role in _ON[state]:
                ways["K"] = cut + behind[_ON[state][role]]
        options.append(ways)
    costs = [min(ways.values()) for ways in options]
    for _ in range(4):  # insertions lead to another state of the same node; a round for each state
        costs = [min(c, INSERT + costs[_NEXT[state]]) for state, c in enumerate(costs)]
    edits = []
    for state, ways in enumerate(options):
        ways["I"] = INSERT + costs[_NEXT[state]]
        edits.append(min(edit for edit, cost in ways.items() if cost == costs[state]))
    return tuple(costs), "".join(edits)


class Automaton:
    """The path of the automaton from the end to the signature at hand."""

    def __init__(self) -> None:
        self.letters = ""
        #: By depth: costs relative to ``base``, ``base``, and the first edits by state.
        self.nodes: list[tuple[tuple[int, ...], int, str]] = [(_END, 0, " II ")]

    def best(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of the signature that reads ``backwards`` from its end."""
        shared, most = 0, min(len(self.letters), len(backwards))
        if self.letters == backwards:
            shared = most
        while shared < most and self.letters[shared] == backwards[shared]:
            shared += 1
        nodes = self.nodes
        del nodes[shared + 1 :]
        for letter in backwards[shared:]:
            relative, base, _ = nodes[-1]
            costs, edits = _node(letter, relative)
            low = min(costs)
            nodes.append((tuple(c - low for c in costs), base + low, edits))
        self.letters = backwards
        state, depth, audit = _START, len(backwards), []
        while True:
            edit = nodes[depth][2][state]
            if edit == " ":
                break
            audit.append(edit)
            if edit != "D":
                state = _ON[state][backwards[depth - 1].lower()] if edit == "K" else _NEXT[state]
            depth -= edit != "I"
        relative, base, _ = nodes[len(backwards)]
        return base + relative[_START], "".join(audit)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.best(s) for s in batch.column(1).to_pylist()]
        cost, audit = zip(*found) if found else ((), ())
        columns = [batch.column(0), *batch.columns[2:], pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", *FIGURES, "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation."""
    signed = stored(signatures(rows), "signatures").withColumn("signature", F.reverse("signature"))
    ordered = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return in_arrow(ordered, _audited, f"conv_id long, {_FIGURES}, cost long, audit string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(head, None, None, None)`` for each conversation, then ``(head, edit, role, text)`` for each
    of its edits. ``head`` is the conversation's row of ``audits``."""
    head, at, state, edits = None, 0, _START, ""

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield head, "I", _ROLE[state], ""

    for batch in batches:
        heads = [batch.column(c) for c in ("conv_id", *FIGURES, "cost", "audit")]
        kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                yield from inserted()
                head = tuple(c[i].as_py() for c in heads)
                at, state, edits = 0, _START, head[-1]
                yield head, None, None, None
                continue
            yield from inserted()
            edit, role = edits[at], roles[i]
            at += 1
            if edit == "K":
                state = _ON[state][role[0]]
            elif edit == "R":
                state = _NEXT[state]
                role = _ROLE[state]
            yield head, edit, role, texts[i]
    yield from inserted()


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan and then its turns, in order."""
    turns = _turns(rows).where("present").drop("present").withColumn("kind", F.lit(1))
    both = plan.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


_SOME = 5000


def _as_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out, place = [], 0
    for head, edit, role, text in _applied(batches):
        if edit is None:
            place = 0
        elif edit != "D":
            out.append((head[0], place, edit, role, text))
            place += 1
        if len(out) == _SOME:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns that the plan leaves or makes."""
    return in_arrow(_with_plan(rows, plan), _as_turns, "conv_id long, place long, edit string, role string, text string")


def _as_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *FIGURES, "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * (len(FIGURES) + 2) + [pa.string()] * 2
    out, current, digest, first = [], None, None, True
    for head, edit, role, text in _applied(batches):
        if edit is None:
            if digest is not None:
                out.append((*current, digest.hexdigest()))
            current, digest, first = head, hashlib.sha256(), True
        elif edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if len(out) == _SOME:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if digest is not None:
        out.append((*current, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``repaired_sha256``, of each repaired conversation's ``role:text`` lines."""
    return in_arrow(
        _with_plan(rows, plan), _as_digests, f"conv_id long, {_FIGURES}, cost long, audit string, repaired_sha256 string"
    )
