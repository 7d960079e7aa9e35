"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.llm import grams, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def made_docs(n=300):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeé1") for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    draw = lambda k: "-".join(rnd.choice(words[: rnd.choice([3, 20, 80])]) for _ in range(k))
    rows = [(k, draw(rnd.randint(1, 40))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,\n"), (n + 3, "É-é A_a"), (None, rows[5][1]), rows[7], rows[7], (n + 4, rows[9][1]), (n + 5, "a " * 40_000)]
    return rows


def made_items():
    rows = made_docs()
    return [(1, rows[3][1]), (2, "a"), (3, "A a a e"), (4, None), (5, "zzz"), (6, ""), (7, rows[20][1] + " " + rows[30][1]), (7, rows[40][1]), (1, rows[3][1]), (None, "b c")]


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(list)
    for item, text in set(items):
        wanted[item] += terms(text)
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("segment_bytes", "query_bytes"), [(1 << 23, 1 << 22), (600, 60)])
def test_ranks_are_those_of_every_score(spark, segment_bytes, query_bytes):
    extra = {"item": F.lit(1), "id": F.lit("x"), "rank": F.lit(2), "keys": F.lit(0)}
    docs = spark.createDataFrame(made_docs(), "doc_id long, text string").withColumns(extra).repartition(3)
    items = spark.createDataFrame(made_items(), "item_id long, text string").withColumns(extra)
    totals = lexical.totals(docs.select("text"))
    segments = lexical.index(docs, *totals, segment_bytes=segment_bytes).checkpoint()
    assert (segments.count() > 10) == (segment_bytes == 600)
    got = lexical.rank(segments, items, *totals, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(made_docs(), made_items())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(made_docs()[:20], "doc_id long, text string"), spark.createDataFrame(made_items(), "item_id long, text string")
    assert lexical.report(docs.limit(0), items).count() == 0
    assert lexical.report(docs, items.limit(0)).count() == 0
    assert lexical.report(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_sevens():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 5])
    raw, starts = lexical._sevens(values)
    assert (lexical._from_sevens(raw) == values).all() and starts[0] == 0 and len(raw) > len(values)


def test_blocks_hold_their_postings_and_maxima(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    docs = [(i, t) for i, t in made_docs() if i is not None]
    n, total = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    segment = lexical.Segment(lexical.build(np.array([i for i, _ in docs]), [t for _, t in docs], n, total), n, total)
    own = defaultdict(list)
    for i, t in docs:
        for term, tf in Counter(terms(t)).items():
            own[term].append((i, (10**9 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms(t)) * n) // total))))
    for term, want in own.items():
        at = segment.lists(lexical.term_hashes([term])[0])[0]
        blocks = range(segment.list_start[at], segment.list_end[at])
        assert len(blocks) == -(-len(want) // 8)
        got = []
        for b in blocks:
            doc, impact = segment.block(b)
            assert doc[0] == segment.firsts[b] and doc[-1] == segment.lasts[b] and 0 <= segment.most[b] - impact.max() < lexical.GRAIN
            got += zip(segment.ids[doc].tolist(), impact.tolist())
        assert sorted(got) == sorted(want)


def test_blocks_are_skipped(monkeypatch):
    """With a threshold, blocks stay closed, and the best documents are the same."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rnd = random.Random(2)
    rare = [f"r{k}" for k in range(40)]
    docs = [(k, " ".join(["the", "of", *(["und"] if k % 2 else []), *rnd.sample(rare, 2)])) for k in range(2000)]
    total = sum(len(terms(t)) for _, t in docs)
    segment = lexical.Segment(lexical.build(np.array([i for i, _ in docs]), [t for _, t in docs], 2000, total), 2000, total)
    wanted = np.unique(lexical.term_hashes(["the of und r1 r2"])[0])
    weights = np.array([math.floor(1000 * math.log(4002 / (2 * len({i for i, t in docs if h in lexical.term_hashes([t])[0]}) + 1))) for h in wanted])
    best = lexical.Best(10)
    lists = segment.lists(wanted)
    cold = lexical.search(segment, lists, weights, best)
    again = lexical.Best(10)
    again.scores, again.ids = np.full(10, best.threshold), np.full(10, lexical.NO_ID)
    warm = lexical.search(segment, lists, weights, again)
    blocks = int((segment.list_end[lists] - segment.list_start[lists]).sum())
    assert warm < blocks / 5 and cold < blocks
    assert sorted(again.ids.tolist()) == sorted(best.ids.tolist())
    want = [(i, s) for item, _, i, s in brute(docs, [(1, "the of und r1 r2")])]
    assert sorted(zip(best.ids.tolist(), best.scores.tolist())) == sorted(want)


def test_terms_are_the_patterns():
    text = "A-b_c É1² [x]{y}~z\x7fq r 日本 🙂"
    hashes, counts = lexical.term_hashes([text, None, ""])
    want, n = grams.word_hashes([" ".join(terms(text))])
    assert (hashes == want).all() and counts.tolist() == [len(terms(text)), 0, 0]
