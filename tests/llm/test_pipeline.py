"""The pipeline's stages, each against brute force on what the stage before kept."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import RANKS, brute_classes, brute_targets, public_tokenizers, words
from tilth.llm import byte_bpe, mixture, secrets, toxicity
from tilth.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    docs = table(spark, DATA, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (10_000, "", None, None, None), (10_001, " ", "en", None, 1), (None, "a null id", None, "s", 9)], docs.schema)
    docs, kept = docs.unionByName(extra).withColumn("component", F.lit(1)), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        kept.append((docs, docs := spark.read.parquet(str(tmp_path / name))))
    assert all(after.columns == names for _, after in kept[:-1])

    before, after = kept[0]
    model = toxicity.fit(before, table(spark, DATA, "labels"), toxicity.fold() != 1)
    calm = [r.doc_id for r in before.collect() if model.scores([r.text], {})[0] < toxicity.THRESHOLD]
    assert Counter(calm) == Counter(r.doc_id for r in after.collect())

    before, after = kept[1]
    rows = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
    want = Counter(i for i, (_, c) in brute_classes(rows).items() if i == c)
    assert Counter(r.doc_id for r in after.collect() if r.doc_id is not None) == want

    before, after = kept[2]
    live = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.live) for r in secrets.scan(before, corpus=table(spark, DATA, "documents")).collect()}
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        text, at, out = r.text, 0, ""
        for a, b in live[r.doc_id]:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        if r.doc_id is not None:
            assert texts[r.doc_id].text == (None if text is None else out + text[at:])
            assert text is None or texts[r.doc_id].n_chars == len(texts[r.doc_id].text)

    before, after = kept[3]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    by, target = brute_targets(rows)
    times = Counter(r.doc_id for r in after.collect() if r.doc_id is not None)
    taken = {r.doc_id: (r.size, r.taken) for r in mixture.report(before).collect()}
    for i, (size, n) in taken.items():
        if i is not None:
            assert times[i] == (1 if not size else 0 if not n else max(1, round(n / size + 1e-9))), (i, size, n)
    mixed = Counter()
    for r in after.collect():
        mixed[r.source] += len(words(r.text))
    assert sum(mixed.values()) == pytest.approx(1.5 * sum(by.values()), rel=0.2)

    before, after = kept[4]
    with open(RANKS, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    own = lambda t: enc.encode_ordinary(t or "")
    want = Counter((r.doc_id, len(own(r.text)), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.collect()) == want


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 150
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
