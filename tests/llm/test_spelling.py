"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilth.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows, slip, least_length, least_count):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def brute_variants(n, times):
    form, many = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        many[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n[form[w]] if form[w] else None))
    return sorted(out)


def made_rows():
    rnd = random.Random(3)
    base = ["straßé", "señorita", "anbncnd", "ÀÿÖ×÷ßaa", "abcdef", "zzzzzz", "kettle"]
    words = []
    for w in base:
        for times, edits in ((30, 0), (5, 1), (2, 1), (1, 2)):
            for _ in range(3 if edits else 1):
                own = w
                for _ in range(edits):
                    k, c = rnd.randrange(len(own)), rnd.choice("abcé÷")
                    own = rnd.choice([own[:k] + own[k + 1 :], own[:k] + c + own[k:], own[:k] + c + own[k + 1 :]])
                words += [own] * times
    rnd.shuffle(words)
    rows = [(k, " ".join(words[k::40]) + rnd.choice([".", " 1A", "\n", "日本"])) for k in range(40)]
    return [*rows, (40, None), (41, ""), (42, "a b 12"), rows[3], rows[3], (None, "Kettle kettle KETTLE señorita"), (43, "x" * 20_000), (44, "Abcdef" * 3_000)]


@pytest.mark.parametrize(("slip", "least_count"), [(199, 1), (5, 2)])
def test_variants_are_those_of_every_pair(spark, slip, least_count):
    docs = spark.createDataFrame(made_rows(), "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2), "h": F.lit(3), "bucket": F.lit(4)})
    words = spelling.vocabulary(docs, slip=slip, least_count=least_count)
    want = brute_words(made_rows(), slip, 6, least_count)
    assert {r.word: r.n for r in words.collect()} == want
    got = spelling.variants(words, times=3)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(want, 3)
    assert least_count > 1 or got.where("root <> form").count() > 0


def test_every_edit_leaves_a_band_and_a_half(spark):
    """All single edits of a word are found, at every place and with letters of every band."""
    rnd = random.Random(1)
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = set()
    for w in ("abcdefg", "ÀÿÖ×÷ß", "aabbccdd"):
        words.add(w)
        for k in range(len(w) + 1):
            c = rnd.choice(letters)
            words |= {w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]}
    n = {w: 5 + len(w) for w in words if len(w) >= 6}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(df).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in n for b in n if a < b and near(a, b)} and len(got) == len({tuple(sorted(p)) for p in got})


def test_ties_go_to_the_first_word(spark):
    df = spark.createDataFrame([("kettle", 1), ("nettle", 9), ("settle", 9), ("mettle", 8)], "word string, n long")
    assert {r.word: r.form for r in spelling.variants(df).collect()} == {"kettle": "nettle", "nettle": None, "settle": None, "mettle": None}


def test_empty_tables(spark):
    docs = spark.createDataFrame(made_rows(), "doc_id long, text string")
    assert spelling.report(docs.limit(0)).count() == 0
    assert spelling.report(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
