"""Character models against brute force, and the choice of a language on held-out text."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.llm import langid
from tilth.llm.common import table

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": "mira sol luna tora bela cana dora", "bb": "krat sturm wolk berg stein frost", "cc": "éclair forêt été hélas père mère"}


def made_rows():
    rnd = random.Random(7)
    rows, k = [], 0
    for lang, words in WORDS.items():
        for _ in range(40):
            rows.append((k, " ".join(rnd.choice(words.split()).title() + rnd.choice(["", "!", " 12,"]) for _ in range(rnd.randint(1, 30))), lang, "s", 1))
            k += 1
    rows += [(k, None, "aa", None, None), (k + 1, "", "bb", None, None), (k + 2, " 12 \n$%", "cc", None, None), (k + 3, "sol", None, None, None), (None, "luna sol", "aa", None, None)]
    return [*rows, rows[0], rows[0], (k + 4, "Sol luna " * 30_000, "aa", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).withColumns({"row": F.lit(1), "score": F.lit("x"), "part": F.lit(2), "hash": F.lit(3)})


def folded(text):
    out = " ".join("".join(c.lower() if c.isalpha() else " " for c in text or "").split())
    return f" {out} " if out else ""


def brute_models(texts, order):
    """p(c | h) of each language by the formulas, as functions of a padded history."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = "\0" * (order - 1) + folded(t) if folded(t) else ""
        for k in range(order - 1, len(t)):
            counts[order][t[k - order + 1 : k + 1]] += 1
    for n in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[n + 1]:
            before[g[1:]].add(g[0])
        counts[n] = Counter({g: len(b) for g, b in before.items()})
    return counts


def brute_p(counts, order, letters, history, c):
    p = 1 / (letters + 1)
    for n in range(1, order + 1):
        own, h = counts[n], history[len(history) - n + 1 :]
        after = {g: x for g, x in own.items() if g[:-1] == h}
        if not after:
            continue
        one, two = sum(x == 1 for x in own.values()), sum(x == 2 for x in own.values())
        d = one / (one + 2 * two) if one else 0.5
        total = sum(after.values())
        p = max(after.get(h + c, 0) - d, 0) / total + d * len(after) / total * p
    return p


@pytest.mark.parametrize("order", [1, 2, 4])
def test_models_are_the_formulas(order):
    learnt = {"aa": ["Mira sol! mira", "luna sol sola"], "bb": ["krat krat berg", "stein 12 bergs"]}
    grams, counts = [], []
    for texts in learnt.values():
        found = brute_models(texts, order)[order]
        grams.append(np.array([[ord(c) for c in g] for g in found], "<u4"))
        counts.append(np.array(list(found.values())))
    models = langid.Models(sorted(learnt), grams, counts, order)
    letters = len({g[-1] for texts in learnt.values() for g in brute_models(texts, order)[order]})
    given = ["sol mira", "berg", "Krat sol xyz", "x", "", None, "12", "luna bergs stein mira solas"]
    n, entropy = models.entropies(given)
    for k, text in enumerate(given):
        own = folded(text)
        assert n[k] == len(own)
        for l, texts in enumerate(learnt.values()):
            found = brute_models(texts, order)
            padded = "\0" * (order - 1) + own
            want = -sum(math.log(brute_p(found, order, letters, padded[:j], padded[j])) for j in range(order - 1, len(padded)) if own)
            assert entropy[k, l] == pytest.approx(want / max(1, len(own)), abs=1e-9)


def test_probabilities_add_up():
    found = brute_models(["mira sol luna", "sol mira"], 3)
    letters = {g[-1] for g in found[3]}
    for history in ("\0\0", "\0 ", " m", "ol", "zz"):
        total = sum(brute_p(found, 3, len(letters), history, c) for c in letters)
        assert total + brute_p(found, 3, len(letters), history, "#") == pytest.approx(1)


def test_cases(docs, spark):
    out = langid.report(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i, text, lang, *_ in made_rows():
        if not folded(text):
            assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected and by[i].cross_entropy is None
        else:
            assert by[i].lang_pred == (lang or "aa") and 0 < by[i].score <= 1
    assert all(r.held_out == (r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = langid.identify(docs, langid.fit(docs, ~langid.held_out()))
    assert kept.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "rejected", "cross_entropy"]


def test_unlike_text_is_rejected(docs, spark):
    model = langid.fit(docs, ~langid.held_out())
    names, score, rejected, _ = model.choose(["日本語の文章です", "stein wolk berg frost sturm krat"])
    assert rejected.tolist() == [True, False] and names[1] == "bb" and 0 <= score[0] <= 1


def test_nothing_learnt_and_empty_tables(docs):
    assert langid.report(docs.limit(0)).count() == 0
    unlearnt = langid.identify(docs.select("doc_id", "text"), langid.fit(docs, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in unlearnt} == {("und", 0.0)}


def test_one_language_and_ties(spark):
    one = spark.createDataFrame([(k, "mira sol", "aa") for k in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.report(one).collect()} == {"aa"}
    same = one.unionByName(one.withColumn("lang", F.lit("bb")))
    assert {r.lang_pred for r in langid.report(same).collect()} == {"aa"}


def test_texts_are_scored_whole(docs):
    """A long text's cross-entropy is that of all its letters."""
    model = langid.fit(docs, ~langid.held_out()).models
    long = "sol luna " * 50_000 + "krat " * 50_000
    n, entropy = model.entropies([long, "sol luna " * 50_000, "krat " * 50_000])
    assert (entropy[0] * n[0] == pytest.approx(entropy[1] * n[1] + entropy[2] * n[2], rel=1e-4))


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    told = langid.report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [r.lang == r.lang_pred for r in told]
    assert len(right) > 200 and sum(right) / len(right) >= 0.97
    kept = [r.lang == r.lang_pred for r in told if not r.rejected]
    assert sum(kept) / len(kept) >= 0.98
