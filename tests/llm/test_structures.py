"""Conversation repair, importance resampling and sharding: brute force, laws, defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import conversations, lines, numbering, queries, resample, shards

# Conversations ----------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def _damaged(rows):
    """Rows after damage by conversation, from ``(conv_id, turn, role, text)``."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    return out


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = text.rstrip(BLANK)
        out.append("b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """The cheapest edits by trying all, least by their initials: ``(cost, audit, repaired rows)``."""
    grammar = re.compile("(s?(ua)+)?")
    memo = {}

    def best(i, before):
        """``before`` is what matters of the roles so far: none, after s, u or a."""
        if (i, before) in memo:
            return memo[i, before]
        found = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        follow = lambda c: (before, c) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
        if i < len(rows):
            _, role, text = rows[i]
            cut = faults[i] == "t"
            cost, audit, left = best(i + 1, before)
            found.append((3 + cost, "D" + audit, left))
            if faults[i] in ("", "t"):
                if role and follow(role[0]):
                    cost, audit, left = best(i + 1, role[0])
                    found.append((cut + cost, "K" + audit, ((role, text), *left)))
                for other in ("user", "assistant"):
                    if follow(other[0]):
                        cost, audit, left = best(i + 1, other[0])
                        found.append((2 + cut + cost, "R" + audit, ((other, text), *left)))
        memo[i, before] = min(found, default=(10**9, "~", ()))
        return memo[i, before]

    # Insertions: one after another, until no state of a place gets cheaper.
    for i in range(len(rows), -1, -1):
        for before in ("", "s", "u", "a"):
            best(i, before)
        for _ in range(6):
            for before in ("", "s", "u", "a"):
                other = "assistant" if before == "u" else "user"
                cost, audit, left = memo[i, other[0]]
                memo[i, before] = min(memo[i, before], (2 + cost, "I" + audit, ((other, ""), *left)))
    result = memo[0, ""]
    assert grammar.fullmatch("".join(r[0][:1] for r in result[2]))
    return result


def _expected(rows):
    out = {}
    for conv, turns in _damaged(rows).items():
        faults = _faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, left = _cheapest(turns, faults)
        count = Counter(faults)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def _repairs(df):
    names = [*conversations.FIGURES, "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


def test_repair_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert _repairs(queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")) == _expected(rows)


def test_repair_of_odd_conversations(spark):
    draw = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "uncle", "sys"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n\x0b\x0c\r", None, "Ends. ", "Ends.\n\n", "é", "Yes.", "x" * 30000 + "?", " "]
    rows = []
    for conv in [None, *range(300)]:
        for _ in range(draw.randrange(1, 14)):
            rows.append((conv, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)))
    rows += [(900, t, draw.choice(roles[:3]), draw.choice(texts)) for t in range(4000)]  # a long one
    rows += [(901, None, "user", "Yes.")] * 3  # repeated rows, no turn known
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"audit": F.lit(1), "kind": F.lit("x"), "letter": F.lit(True), "cost": F.lit(None)})
    bad = conversations.damaged(df.repartition(5))
    got, want = _repairs(conversations.digests(bad, conversations.audits(bad))), _expected(rows)
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    turns = conversations.repaired(bad, conversations.audits(bad)).collect()
    by = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["place"]):
        by[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, figures in got.items():
        assert hashlib.sha256("\n".join(by[conv]).encode()).hexdigest() == figures[-1]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    bad = conversations.damaged(none)
    assert conversations.digests(bad, conversations.audits(bad)).count() == 0
    # All rows dropped: zeros, an empty audit, the digest of the empty string.
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    bad = conversations.damaged(df)
    got = _repairs(conversations.digests(bad, conversations.audits(bad)))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_automaton_equals_all_edits():
    """All signatures of up to four letters, in any order, against all sequences of edits."""
    automaton = conversations.Automaton()
    letters = {"x": ("tool", "b"), "s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "o": ("tool", ""),
               "S": ("system", "t"), "U": ("user", "t"), "A": ("assistant", "t"), "O": ("tool", "t")}
    words = ["".join(w) for n in range(5) for w in itertools.product(letters, repeat=n)]
    random.Random(1).shuffle(words)
    for word in words[:3000]:
        rows = [(0, letters[c][0], "t") for c in word]
        want = _cheapest(rows, [letters[c][1] for c in word])
        assert automaton.best(word[::-1]) == want[:2], word


# Resampling -------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _crcs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(w.encode()) for w in words] + [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])]


def _drawn(docs, target):
    """``(n_features, weight, score, rank)`` of each ``(doc_id, text)``, in order."""
    found = [_crcs(t) for _, t in docs]
    s, t = Counter(c % 10000 for _, f in found for c in f), Counter(c % 10000 for x in target for c in _crcs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for (doc, _), (n, f) in zip(docs, found):
        weight = sum(gain[c % 10000] for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for i, r in enumerate(may[: 25 * len(may) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[:1] + r[2:]) for r in rows), key=repr)


def _draws(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_resampling_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert _draws(queries.QUERIES["op12_importance_resampling"](spark, sf)) == _drawn(docs, target)


def test_resampling_of_odd_texts(spark):
    draw = random.Random(2)
    marks = ["a", "Z", "0", " ", "é", "中文", ".", "\x00", "\n", "É", "𝒳", "_", "word" * 40, "~", "\x7f", "x" * 70]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randrange(120))) for _ in range(200)]
    texts += ["", None, " ", "one", "q" * 200_000, "w " * 100_000, "same words " * 15, "same words " * 15, "中" * 50_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "word " * 30), (5, texts[5])]
    target = ["same words a z", None, "", "word a"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("x"), "rank": F.lit(1), "bucket": F.lit(0)})
    got = resample.resample(df.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"))
    assert _draws(got) == _drawn(docs, target)
    none = df.where("doc_id = -1")
    assert resample.resample(none, none).count() == 0
    assert resample.resample(df, none).count() == len(docs)


def test_crc_of_runs():
    texts = [b"ab cd ef", b"", b"x" * 64 + b" " + b"y" * 65 + b" " + b"z" * 300, b"\xc3\xa9 9"]
    (one, a), (two, b), (three, c) = resample.features(texts, 3)
    words = [t.split() for t in texts]
    runs = lambda n: [(i, zlib.crc32(b" ".join(w[k : k + n]))) for i, w in enumerate(words) for k in range(len(w) - n + 1)]
    for n, got in ((1, (one, a)), (2, (two, b)), (3, (three, c))):
        assert list(zip(*(x.tolist() for x in got))) == runs(n)


# Sharding ---------------------------------------------------------------------


def _loads(rows, column="shard", shards_=40):
    total = np.zeros(shards_, np.int64)
    for r in rows:
        total[r[column]] += r["size"]
    return total


def _gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_laws(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op13_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert r["virtual_slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 4096
    assert _gapless(rows)
    loads = _loads(rows)
    assert loads.max() - loads.min() <= loads.mean() * 0.01
    assert all(r["next_shard"] in (r["shard"], 40) for r in rows)
    after = _loads(rows, "next_shard", 41)
    assert after.max() <= loads.max() and after[40] >= after[:40].mean() * 0.9
    # A map is fixed: the same rows in other partitions go to the same places.
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    again = shards.placed(docs)
    again = shards.assign(again, shards.version(shards.map_history(again, 40), 2)).select("doc_id", "shard", "slot").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows) == sorted(tuple(r) for r in again)


def test_sharding_of_odd_rows(spark):
    # A third without an id, a third one row again and again, and one record larger than all others.
    rows = [(None, f"text {i}") for i in range(1000)] + [(7, "the same")] * 1000 + [(i, "é" * (i % 50)) for i in range(1000)]
    rows += [(5000, None), (5001, ""), (5002, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("x"), "shard": F.lit(1), "place": F.lit(2)})
    placed = shards.placed(df.repartition(6))
    history = shards.map_history(placed, 10)
    got = shards.assign(placed, shards.version(history, 2)).collect()
    assert len(got) == len(rows) and _gapless(got)
    loads = np.sort(_loads(got, shards_=10))
    assert loads[-1] >= 300_000 and loads[-2] - loads[0] < 200
    grown = shards.version(history, 3).collect()
    before = {(r["virtual_slot"], r["stripe"]): r["shard"] for r in shards.version(history, 2).collect()}
    assert all(r["shard"] in (before[r["virtual_slot"], r["stripe"]], 10) for r in grown)
    assert len(before) <= shards.SLOTS + 10 * shards.FINE
    none = shards.placed(df.where("doc_id = -1"))
    assert shards.assign(none, shards.version(shards.map_history(none, 10), 2)).count() == 0


def test_numbering(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v")).union(spark.sql("SELECT NULL, 1"))
    got = defaultdict(list)
    for r in numbering.numbered(df.repartition(7), ["g"], [F.col("v")], "at").collect():
        got[r["g"]].append((r["at"], r["v"]))
    for rows in got.values():
        assert [a for a, _ in sorted(rows)] == list(range(len(rows)))
        assert [v for _, v in sorted(rows)] == sorted(v for _, v in rows)


@pytest.mark.parametrize("name", ["op13_sharding"])
def test_native_plans_run_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("share", [0.001, 0.9])
def test_line_dedup_of_very_common_lines(spark, monkeypatch, share):
    """A line that most documents hold, in stripes or not, and one document that repeats it a thousand times."""
    monkeypatch.setattr(lines, "SHARE", share)
    rng = random.Random(5)
    common, long_ = "The line that all hold", "one more line " * 400
    texts = ["\n".join([f"own line number {rng.randrange(300)}", common, "short", long_][: rng.randrange(1, 5)]) for _ in range(200)]
    texts[40] = "\n".join([common.upper()] * 1000 + ["own line number 1"])
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["kept"]) for r in lines.dedup_lines(df).collect()}
    first = {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            k = x.strip().lower()
            first[k] = min(first.get(k, 10**9), 1000 - i)
    for i, t in enumerate(texts):
        kept = [x for x in t.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == 1000 - i]
        assert got[1000 - i] == (len(t.split("\n")) - len(kept), "\n".join(kept))


def test_line_dedup_streams_over_its_sort(spark, sf):
    bits = lines.keep_bitmaps(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = bits._jdf.queryExecution().executedPlan().toString().split("\n")
    window = next(i for i, step in enumerate(plan) if "Window [" in step)
    assert "Sort [" in plan[window + 1] and "Exchange rangepartitioning" in plan[window + 2]
    assert sum("Sort [" in step for step in plan) == 1
