"""Operators against plain versions over whole tables, and how much they find of what is planted."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import decontaminate, neardup, queries, secretscan, toxicity, urls

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
FOUND = ((re.compile(ASSIGN, re.I | re.A), 2, 8), (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32))


def _steps(value, model):
    at = [secretscan.ALPHABET.index(c) for c in value]
    return [model[a * len(secretscan.ALPHABET) + b] for a, b in zip(at, at[1:])]


def _segments(weights):
    """Maximal scoring segments: from each start as far as the sum stays above it, to its highest point."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    found = []
    for s in range(len(weights)):
        if weights[s] > 0 and (not found or s > found[-1][1]):
            below = np.flatnonzero(total[s + 1 :] < total[s])
            end = s + 1 + (int(below[0]) if len(below) else len(weights) - s)
            found.append((s, s + int(np.argmax(total[s + 1 : end]))))
    return found


def _mixed(value):
    return len(value) >= secretscan.LEAST and re.search("[0-9]", value) and re.search("[A-Za-z]", value)


def _inside(value, model):
    """Places in a run that look random, by plain loops."""
    steps, limit = _steps(value, model), secretscan.THRESHOLD
    if sum(steps) / len(steps) >= limit:
        return [(0, len(value))]
    places = []
    for m in re.finditer("[^/=_-]+", value):
        if len(m.group()) >= secretscan.LEAST and np.mean(steps[m.start() : m.end() - 1]) >= limit:
            places.append(m.span())
    for s, e in _segments(np.array(steps) - limit):
        start = s + len(re.match("[/=_-]*", value[s : e + 2]).group())
        if e - s + 2 >= secretscan.LEAST and e + 2 - start >= secretscan.LEAST:
            places.append((start, e + 2))
    joined = []
    for s, e in sorted(places):
        if joined and s < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return [(s, e) for s, e in joined if _mixed(value[s:e])]


def _secrets(text, model):
    """All spans of a text as the query writes them."""
    spans = [(m.start(), n, m.end()) for n, (p, g, least) in enumerate(FOUND) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    base = sorted(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        at, pieces = m.start(), []
        for s, _, e in base:
            if s < m.end() and m.start() < e:
                pieces.append((at, s))
                at = max(at, e)
        for s, e in [*pieces, (at, m.end())]:
            if _mixed(text[s:e]):
                spans += [(s + a, len(FOUND), s + b) for a, b in _inside(text[s:e], model)]
    return ",".join(f"{secretscan.KINDS[n]}:{s}:{e}" for s, n, e in sorted(spans))


def _strings(draw, n):
    """Random strings of several alphabets, and ordinary identifiers of joined words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (letters + letters.upper() + "0123456789", letters + "0123456789", letters.upper() + "0123456789", "0123456789ABCDEF")
    secret = lambda: "".join(draw.choice(draw_from) for _ in range(draw.randrange(24, 48)))
    random_ = []
    for k in range(n):
        draw_from = alphabets[k % len(alphabets)]
        random_.append("x7" + secret())
    words = "account archive balance billing build cache channel client cluster column config country customer daily default document driver engine export field filter format global header history import index invoice ledger manager message metric monthly network option order output parent partition payment policy process product profile project queue record region report request resource response result schedule schema server service session setting source status storage stream summary system table target template transfer update user value version window worker".split()
    plain = []
    for k in range(n):
        some = [draw.choice(words) for _ in range(4)]
        tail = str(draw.randrange(1, 2030))
        plain.append([
            "_".join(some) + "_" + tail, some[0] + "".join(w.title() for w in some[1:]) + tail,
            "/".join(some) + "/" + tail, "-".join(some) + "-v" + tail, "_".join(some).upper() + "_" + tail,
        ][k % 5])
    return random_, plain


def _planted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    draw = random.Random(12)
    random_, plain = _strings(draw, len(docs))
    rows, places = [], []
    for r, x, y in zip(docs, random_, plain):
        body, cut = r["text"] or "", draw.randrange(len(r["text"] or "") + 1)
        head = body[:cut] + "\n"
        rows.append((r["doc_id"], f"{head}see {x} and {y} here\n{body[cut:]}"))
        a = len(head) + 4
        places.append(((a, a + len(x)), (a + len(x) + 5, a + len(x) + 5 + len(y))))
    return spark.createDataFrame(rows, "doc_id long, text string"), places


def test_secret_scan_equals_plain_loops(spark):
    """The whole result over the whole table, with planted strings and without."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = [round(x, 6) for x in secretscan.trained(secretscan.samples(docs))]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["spans"] for r in queries.op2_secret_scan(spark, folder).collect()}
    assert got == {i: _secrets(t, model) for i, t in texts.items()}
    planted, _ = _planted(spark, folder)
    texts = {r["doc_id"]: r["text"] for r in planted.collect()}
    found = secretscan.scan_secrets(planted, model).select("doc_id", secretscan.span_text("spans").alias("s"))
    assert {r["doc_id"]: r["s"] for r in found.collect()} == {i: _secrets(t, model) for i, t in texts.items()}


def secret_rates(spark, folder):
    """Share of the planted random strings that are found to nine tenths at least, and of the
    planted identifiers in which anything is found."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = secretscan.trained(secretscan.samples(docs))
    planted, places = _planted(spark, folder)
    rows = secretscan.scan_secrets(planted, model).orderBy("doc_id").select("spans").collect()
    hit = miss = 0
    for r, ((a, b), (c, d)) in zip(rows, places):
        own = [(s["start"], s["end"]) for s in r["spans"]]
        hit += any(min(b, e) - max(a, s) >= 0.9 * (b - a) for s, e in own)
        miss += any(s < d and c < e for s, e in own)
    return hit / len(places), miss / len(places)


def test_secret_rates(spark):
    found, wrong = secret_rates(spark, "/root/testdata/sf0.01")
    print("random strings found", found, "identifiers reported", wrong)
    # Measured: all found, 3.3 % of the identifiers reported at the threshold of 0.3. The bound guards that state.
    assert found >= 0.99 and wrong <= 0.04


def _graded(n, seed):
    """Texts whose planted grade is the number of different marking stems in them."""
    draw = random.Random(seed)
    plain = [f"{a}{b}ord" for a in "bcdfg" for b in "aeioulrnst"]
    marks = [f"{c}{c}{c}{c}y" for c in "kqvwxz"]
    rows = []
    for _ in range(n):
        grade = draw.choice((0, 0, 0, 1, 2, 3))
        words = [draw.choice(plain) for _ in range(30)] + draw.sample(marks, grade)
        draw.shuffle(words)
        rows.append((" ".join(words), grade))
    return rows


def test_toxicity_is_the_optimum_of_its_objective():
    """Weights and thresholds satisfy the optimality conditions of the penalised likelihood,
    computed here by plain loops over documents and grades."""
    rows = [(t, g > 0) for t, g in _graded(400, 1)]
    model = toxicity.fit(rows)
    sets = [toxicity.features(t) for t, _ in rows]
    seen = {w: [i for i, s in enumerate(sets) if w in s] for w in set().union(*sets)}
    vocabulary = [w for w in seen if len(seen[w]) >= toxicity.LEAST]
    clean = sum(not t for _, t in rows) / len(rows)
    marking = {w for w in vocabulary if w[-1] == "*" and np.mean([rows[i][1] for i in seen[w]]) >= 0.95 and len(seen[w]) * clean >= 10}
    grades = [min(3, max(1, len(s & marking))) if t else 0 for s, (_, t) in zip(sets, rows)]
    error = []
    for s, g in zip(sets, grades):
        score = sum(model.weights.get(w, 0.0) for w in s)
        error.append([1 / (1 + np.exp(th - score)) - (g >= k) for k, th in enumerate(model.thresholds, 1)])
    error = np.array(error) / len(rows)
    assert np.abs(error.sum(axis=0)).max() < 5e-3 and model.thresholds == sorted(model.thresholds)
    for w in vocabulary:
        slope, weight = error[seen[w]].sum(), model.weights.get(w, 0.0)
        if weight:
            assert abs(slope + toxicity.SPARSE * np.sign(weight)) < 2e-3, w
        else:
            assert abs(slope) <= toxicity.SPARSE + 1e-3, w


def _ranks(x):
    """Ranks, ties at their mean."""
    x = np.asarray(x, float)
    low = np.searchsorted(np.sort(x), x, "left")
    return (low + np.searchsorted(np.sort(x), x, "right")) / 2


def test_toxicity_agrees_with_planted_grades(spark):
    """Severity on held-out texts rises with their planted grades; scoring equals plain sums."""
    model = toxicity.fit([(t, g > 0) for t, g in _graded(600, 2)])
    held = _graded(500, 3)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(held)], "doc_id long, text string, grade string")
    got = toxicity.grade_toxicity(df, model).orderBy("doc_id").collect()
    for (text, _), r in zip(held, got):
        score = sum(model.weights.get(w, 0.0) for w in sorted(toxicity.features(text)))
        p = [1 / (1 + np.exp(th - score)) for th in model.thresholds]
        assert abs(r["severity"] - sum(p)) < 1e-9 and r["grade"] == sum(x >= 0.5 for x in p)
    severity, grade = [r["severity"] for r in got], [g for _, g in held]
    agreement = np.corrcoef(_ranks(severity), _ranks(grade))[0, 1]
    print("rank agreement", agreement, "same grade", np.mean([r["grade"] == g for r, g in zip(got, grade)]))
    assert agreement > 0.9


def near_recall(similar, pairs=400, words=300, seed=5):
    """Share of pairs at a similarity that meet in a band, by changing single words of a text."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    met = made = 0
    while made < pairs:
        a = [word() for _ in range(words)]
        b = list(a)
        sets = [neardup.weighted(neardup.shingles(" ".join(a)))]
        at = 1.0
        while at > similar + 0.005:
            b[draw.randrange(words)] = word()
            x, y = (neardup.marked(neardup.shingles(" ".join(t))) for t in (a, b))
            at = neardup.similarity(x, y)
        if at < similar - 0.01:
            continue
        sets.append(neardup.weighted(neardup.shingles(" ".join(b))))
        x, y = neardup.bands(neardup.signatures(sets))
        met += bool((x == y).any())
        made += 1
    return met / made


@pytest.mark.parametrize("similar", [0.8, 0.9])
def test_near_pairs_meet_in_a_band(similar):
    assert near_recall(similar, pairs=150) >= 0.99


def test_a_passage_of_many_different_texts_pairs_none(spark):
    """Texts that share seven tenths lie in common buckets; all leave before any is paired."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(45))
    texts = [f"{passage} {' '.join(word() for _ in range(14))}" for _ in range(2000)]
    near = [f"{texts[0]} more", f"{texts[1]} more"]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    rest = ids.select(F.lit(1).alias("key"), "id", F.lit(2002).alias("n"), F.col("id").alias("root"), F.lit(0).alias("main"), F.lit(1).alias("size"))
    able = neardup._able(neardup._bounded(rest, ids)).select("id").distinct()
    assert sorted(r["id"] for r in able.collect()) == [0, 1, 2000, 2001]
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(docs).collect()}
    assert classes == {i: i for i in range(2000)} | {2000: 0, 2001: 1}


def test_short_items_that_many_documents_say(spark):
    rare, often = "zebra quartz", "the"
    items = spark.createDataFrame([(1, rare), (2, often), (3, often), (None, "of the"), (4, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    texts = [f"the d{i} a{i}" for i in range(30)] + [f"of the x{i}" for i in range(20)] + [f"say {rare} now", "w0 " + " ".join(f"w{k}" for k in range(12))]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(50, 1), (51, 4)}
    few = spark.createDataFrame(list(enumerate(texts[:9] + texts[30:32])), "doc_id long, text string")
    got = decontaminate.contained(few, items).groupBy("item_id").count().collect()
    assert {r["item_id"]: r["count"] for r in got} == {None: 2}


def test_url_query_takes_a_list(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plain = {r["page_id"] for r in queries.op4_url_filter(spark, sf, urls.listed_urls(pages).limit(0)).where("listed").collect()}
    one = pages.where("instr(url, '://') > 0").select(urls.canonical(F.col("url")).alias("url"), "page_id").first()
    listed = spark.createDataFrame([(one["url"],)], "url string")
    got = {r["page_id"] for r in queries.op4_url_filter(spark, sf, listed).where("listed").collect()}
    assert not plain and one["page_id"] in got
