"""Secret scan: fixed patterns, and random-looking strings by two Markov models.

Base spans are the matches of three patterns; they are cut out of the runs of token
characters. Every long run that stays, with a letter and a digit, is scored by two
first-order character models, one of random strings and one of ordinary identifiers:
the mean log-likelihood ratio of its steps has to reach a threshold. In a run that does
not reach it as a whole, such as a path, the parts between separators are scored, and
the stretches whose every beginning and end lies above the threshold on the whole (the
maximal scoring segments, by a running sum): both have the least length of a run, and
those that overlap are one span. Both models come from labelled samples that
Spark derives from the table, as counts of character pairs over a fixed alphabet; they
are the only thing that reaches the driver. Scanning is one projection.

Defined cases: a null or empty text has no spans. A text's U+0001 counts as U+0002,
which is in no span either. Repeated rows are scanned alike. On an empty table the
models are uniform. Other columns pass unchanged; columns named ``spans`` or ``base``
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import spans as marks
from textguard.functions.text import markless
from textguard.operators.fence import fenced

_QUOTE = "[\"']?"
#: Kind, pattern, least characters of the group, the group; in the order of ties.
BASE = (
    (
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        f"|[aA][pP][iI]_?[kK][eE][yY]){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)",
        8,
        2,
    ),
    ("access", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]{32,}", 32, 0),
)
RANDOM = "random"
KINDS = tuple(k for k, *_ in BASE) + (RANDOM,)
#: Runs that are scored: length, and one character of each sort at least.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: Between the parts of a run.
SEPARATOR = "[/=_-]"
#: Mean log-likelihood ratio per step from which a run counts as random.
THRESHOLD = 0.3
#: About so many documents give the labelled samples.
SAMPLE_DOCS = 1000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def samples(docs: DataFrame, doc: str = "doc_id", text: str = "text", about: int = SAMPLE_DOCS) -> DataFrame:
    """``(label, value)``: random strings are digests of the sampled ids, as hex digits,
    base-64 and capitals; ordinary identifiers are the texts' words, alone, joined by
    underscores or hyphens, in camel case, and with a number behind."""
    step = docs.count() // about + 1
    some = docs.where(F.pmod(F.xxhash64(doc), F.lit(step)) == 0).select(F.col(doc).cast("string").alias("id"), F.col(text).alias("text"))
    digest = F.sha2("id", 256)
    coded = F.base64(F.unhex(digest))
    capital = F.translate(F.upper(F.base64(F.unhex(F.sha2(F.concat("id", F.lit("c")), 256)))), "+/=", "")
    random = some.select(F.lit(1).alias("label"), F.explode(F.array(digest, coded, capital)).alias("value"))
    words = F.filter(F.split("text", "[^A-Za-z]+", -1), lambda w: w != "")
    pairs = fenced(some.withColumn("_w", words), "_w").select(
        F.explode(F.transform("_w", lambda w, i: F.struct(w.alias("a"), F.get("_w", i + 1).alias("b"), i.alias("i"))))
    )
    a, b, i = F.col("col.a"), F.col("col.b"), F.col("col.i")
    forms = F.element_at(
        F.array(a, F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(F.lower(a), F.initcap(b)),
                F.concat(a, F.lit("/"), b), F.concat(a, (i % 100).cast("string")), F.concat(F.upper(a), F.lit("_"), F.upper(b))),
        i % 7 + 1,
    )
    ordinary = pairs.select(F.lit(0).alias("label"), forms.alias("value"))
    return random.unionByName(ordinary).where("value IS NOT NULL")


def trained(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row of the alphabet."""
    n = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substr("value", i, F.lit(2)))
    steps = labelled.where(F.length("value") > 1).select("label", F.explode(pairs).alias("pair"))
    counts = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for row in steps.groupBy("label", "pair").count().where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[row["label"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["count"]
    sums = [[sum(row) for row in label] for label in counts]
    return [
        math.log(counts[1][a][b] / sums[1][a]) - math.log(counts[0][a][b] / sums[0][a])
        for a in range(n) for b in range(n)
    ]


def _matches(kind: int, body: str, pattern: str, least: int, group: int) -> Column:
    """Spans of one pattern: ``array<struct<start, kind, end>>``."""
    found = marks.located(F.lit(kind), F.expr(marks.marked_parts(f"`{body}`", pattern)))
    long = F.filter(found, lambda m: F.length(F.regexp_extract(m["value"], pattern, group)) >= least)
    none = F.array().cast(marks.MATCH_TYPE)
    return F.when(F.col(body).rlike(pattern), long).otherwise(none)


_PLACED = "array<struct<start:int,end:int>>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _within(run: Column, places: Column) -> Column:
    """Matches at the places in a run that are long enough and have a letter and a digit."""
    cut = lambda p: F.substr(run["value"], p["start"] + 1, p["end"] - p["start"])
    found = F.transform(
        places,
        lambda p: F.struct(
            (run["start"] + p["start"]).alias("start"), run["n"].alias("n"), (run["start"] + p["end"]).alias("end"), cut(p).alias("value")
        ),
    )
    long = lambda m: m["end"] - m["start"] >= LEAST
    return F.filter(found, lambda m: long(m) & m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))


def _left(run: Column, base: Column) -> Column:
    """What the base matches, by start, leave of a run."""
    zero = F.struct(run["start"].alias("at"), F.array().cast(_PLACED).alias("out"))
    gap = lambda at, end: _span(at - run["start"], end - run["start"])
    walked = F.aggregate(
        F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])),
        zero,
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.array_append(acc["out"], gap(acc["at"], b["start"]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.when(acc["at"] < run["end"], F.array_append(acc["out"], gap(acc["at"], run["end"]))).otherwise(acc["out"]),
    )
    return _within(run, walked)


def _mean(steps: Column) -> Column:
    """Mean log-likelihood ratio of steps."""
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.size(steps)


def _parts(run: Column, steps: Column, threshold: float) -> Column:
    """The parts between separators that reach the threshold."""
    parts = F.split(run["value"], SEPARATOR, -1)
    placed = F.arrays_zip(marks.starts_of(parts).alias("at"), parts.alias("part"))
    places = F.transform(placed, lambda p, i: _span(p["at"] + i, p["at"] + i + F.length(p["part"])))
    long = F.filter(places, lambda p: p["end"] - p["start"] >= LEAST)
    return F.filter(long, lambda p: _mean(F.slice(steps, p["start"] + 1, p["end"] - p["start"] - 1)) >= threshold)


def _stretches(run: Column, steps: Column, threshold: float) -> Column:
    """The maximal scoring segments of the steps over the threshold, without leading separators.

    ``open`` holds the segments that may still grow, their lower sums ``l`` rising and their
    upper sums ``r`` falling: a step up joins all those that it outgrows, a step down below
    ``l`` closes a segment."""
    zero = F.struct(
        F.lit(0.0).alias("sum"), F.array().cast("array<struct<s:int,e:int,l:double,r:double>>").alias("open"), F.array().cast(_PLACED).alias("out")
    )
    ended = lambda segments: F.transform(
        F.filter(segments, lambda o: o["e"] - o["s"] + 2 >= LEAST), lambda o: _span(o["s"], o["e"] + 2)
    )

    def up(acc, now, i):
        outgrown = F.filter(acc["open"], lambda o: o["r"] < now)
        first = F.get(outgrown, F.lit(0))
        grown = F.struct(F.coalesce(first["s"], i).alias("s"), i.alias("e"), F.coalesce(first["l"], acc["sum"]).alias("l"), now.alias("r"))
        kept = F.array_append(F.filter(acc["open"], lambda o: o["r"] >= now), grown)
        return F.struct(now.alias("sum"), kept.alias("open"), acc["out"].alias("out"))

    def down(acc, now):
        out = F.concat(acc["out"], ended(F.filter(acc["open"], lambda o: o["l"] > now)))
        shut = F.struct(now.alias("sum"), F.filter(acc["open"], lambda o: o["l"] <= now).alias("open"), out.alias("out"))
        same = F.struct(now.alias("sum"), acc["open"].alias("open"), acc["out"].alias("out"))
        return F.when(F.exists(acc["open"], lambda o: o["l"] > now), shut).otherwise(same)

    def step(acc, x):
        now = acc["sum"] + x["w"]
        return F.when(x["w"] > 0, up(acc, now, x["i"])).otherwise(down(acc, now))

    over = F.transform(steps, lambda x, i: F.struct((x - threshold).alias("w"), i.alias("i")))
    # A segment that is open may still grow over closed ones.
    found = _joined(F.aggregate(over, zero, step, lambda acc: F.concat(acc["out"], ended(acc["open"]))))
    lead = lambda p: F.length(F.regexp_extract(F.substr(run["value"], p["start"] + 1, p["end"] - p["start"]), f"^{SEPARATOR}*", 0))
    bare = F.transform(found, lambda p: _span(p["start"] + lead(p), p["end"]))
    return F.filter(bare, lambda p: p["end"] - p["start"] >= LEAST)


def _joined(places: Column) -> Column:
    """Places by start, those that overlap as one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(
        F.array_sort(places),
        F.array().cast(_PLACED),
        lambda acc, p: F.when(
            p["start"] < last(acc)["end"],
            F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), _span(last(acc)["start"], F.greatest(last(acc)["end"], p["end"]))),
        ).otherwise(F.array_append(acc, p)),
    )


def _random(run: Column, steps: Column, threshold: float) -> Column:
    """The run if it reaches the threshold, else what in it does."""
    inner = _within(run, _joined(F.concat(_parts(run, steps, threshold), _stretches(run, steps, threshold))))
    return F.when(_mean(steps) >= threshold, F.array(run)).otherwise(inner)


def scan_secrets(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base``, the pattern matches, and ``spans``, which also holds the
    random strings beside them: ``struct<start, kind, end, value>`` by start,
    then kind as in ``KINDS``."""
    own = [c for c in docs.columns if c not in ("base", "spans")]
    df = fenced(docs.select(*own).withColumn("_body", markless(F.col(text))), "_body")
    both = F.concat(*[_matches(i, "_body", p, least, group) for i, (_, p, least, group) in enumerate(BASE)])
    df = df.withColumns({"_base": F.array_sort(both), "_long": _matches(len(BASE), "_body", CANDIDATE, LEAST, 0)})
    numbers = F.lit(",".join(f"{x:.6f}" for x in model))
    df = df.withColumn("_model", F.split(numbers, ",").cast("array<double>"))
    df = fenced(df, "_base", "_long", "_model")
    df = fenced(df.withColumn("_runs", F.flatten(F.transform("_long", lambda r: _left(r, F.col("_base"))))), "_runs")
    place = lambda c: F.call_function("position", c, F.lit(ALPHABET)) - 1
    df = fenced(df.withColumn("_places", F.transform("_runs", lambda r: F.transform(F.split(r["value"], ""), place))), "_places")
    pair = lambda a, b: F.get(F.col("_model"), (a * len(ALPHABET) + b).cast("int"))
    steps = F.transform(
        "_places", lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda a, i: pair(a, F.get(p, i + 1)))
    )
    df = fenced(df.withColumn("_steps", steps), "_steps")
    added = F.flatten(F.transform("_runs", lambda r, i: _random(r, F.get("_steps", i), threshold)))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda column: F.transform(
        column,
        lambda m: F.struct(m["start"].alias("start"), F.get(names, m["n"]).alias("kind"), m["end"].alias("end"), m["value"].alias("value")),
    )
    return df.select(*own, named(F.col("_base")).alias("base"), named(F.array_sort(F.concat("_base", added))).alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
