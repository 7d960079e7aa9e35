"""Document fingerprints: quartile bucket digests of hashed byte triplets, and their bounded difference.

A digest counts three byte triplets at each position of the text's UTF-8 in 128 hashed buckets, marks each bucket by
the quartile of its count among all 128, and adds a logarithmic length. Two digests differ by at most BOUND.

Defined cases: null text is the empty text, whose digest is the one of no counts; equal texts have equal digests.
Successors: documents stand by descending id, nulls last, equal ids by ascending text, and the first follows the last;
one document alone follows itself. Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import whole

BUCKETS = 128
#: Differences are cut off here; two unrelated digests differ by about 1.6 a bucket.
BOUND = 256
LEAST = -(1 << 63)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (a row a text) and length codes."""
    data = [t.encode() for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(raw) - 3
    owner = np.repeat(np.arange(len(data), dtype=np.int64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes from here to the text's end
    counts = np.zeros(len(data) * BUCKETS, np.int64)
    a, b, c, d = raw[:n], raw[1 : n + 1], raw[2 : n + 2], raw[3 : n + 3]
    base = a * np.uint32(0x9E3779B1)
    for salt, x, y, span in ((1, b, c, 3), (2, b, d, 4), (3, c, d, 4)):
        mixed = (base + x * np.uint32(0x85EBCA6B)) ^ (y * np.uint32(0xC2B2AE35) + np.uint32(salt * 0x27D4EB2F))
        mixed ^= mixed >> np.uint32(15)
        bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(25)
        inside = left >= span
        counts += np.bincount((owner * BUCKETS + bucket)[inside], minlength=len(counts))
    counts = counts.reshape(-1, BUCKETS)
    ordered = np.sort(counts, 1)
    codes = sum((counts > ordered[:, [k]]).astype(np.int64) for k in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    length = np.minimum(255, np.round(np.log1p(size) / math.log(1.1))).astype(np.int64)
    return codes, length


def as_text(codes: np.ndarray, length: np.ndarray) -> list[str]:
    """The length in two hexadecimal digits, then two bits a bucket."""
    packed = (codes.reshape(len(codes), -1, 4) << np.array([6, 4, 2, 0])).sum(2).astype(np.uint8)
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(length.tolist(), packed)]


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 less the share of BOUND by which the digests differ; opposite quartiles count twice."""
    step = np.abs(one[0] - two[0])
    apart = (step + 3 * (step == 3)).sum(1) + np.abs(one[1] - two[1])
    return 1 - np.minimum(apart, BOUND) / BOUND


def compare(left: Column, right: Column) -> Column:
    """The likeness of two digests as stored, by Spark's functions alone."""
    half = lambda x, k: F.conv(F.substring(x, k, 2), 16, 10).cast("int")

    def byte(k: Column) -> Column:
        one, two = half(left, k), half(right, k)
        steps = [F.abs(F.shiftright(one, s).bitwiseAND(3) - F.shiftright(two, s).bitwiseAND(3)) for s in (6, 4, 2, 0)]
        return sum((F.when(s == 3, 6).otherwise(s) for s in steps[1:]), F.when(steps[0] == 3, 6).otherwise(steps[0]))

    apart = F.aggregate(F.sequence(F.lit(3), F.lit(2 + BUCKETS // 2), F.lit(2)), F.abs(half(left, F.lit(1)) - half(right, F.lit(1))), lambda total, k: total + byte(k))
    return 1 - F.least(apart, F.lit(BOUND)) / F.lit(BOUND)


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with the digest of each text; a column of that name is replaced."""
    df = df.drop(out_col)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("").to_pylist()
            out = [x for few in _few(texts) for x in as_text(*digests(few))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, df.withColumn(out_col, F.lit("")).schema)


def _few(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _places(df: DataFrame, key: Column, rows_each: int, most: int) -> tuple[DataFrame, int]:
    """df with __bucket, a range of keys from high to low, and a copy of each bucket's first rows in the bucket before.

    The bounds are taken from approximate quantiles, so any distribution of ids spreads; the driver keeps two numbers
    a bucket, `most` buckets at most.
    """
    n = df.count()
    parts = max(1, min(most, math.ceil(n / rows_each)))
    bounds = sorted(set(df.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * most)).first()[0] or []), reverse=True) if parts > 1 else []
    bits = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    if bounds:  # how many bounds are above the key, by halving
        held = F.lit(bounds)
        bucket = F.aggregate(F.lit(bits), F.lit(0), lambda low, bit: F.when((low + bit <= len(bounds)) & (F.try_element_at(held, low + bit) > key), low + bit).otherwise(low))
    else:
        bucket = F.lit(0)
    df = df.withColumn("__key", key).withColumn("__bucket", bucket)
    heads = {r[0]: r[1] for r in df.groupBy("__bucket").agg(F.max("__key")).collect()}
    full = sorted(heads)
    before = {b: full[k - 1] for k, b in enumerate(full)}  # the first one's is the last
    size = len(bounds) + 1
    head = F.element_at(F.lit([heads.get(k, 0) for k in range(size)]), F.col("__bucket") + 1)
    guest_of = F.element_at(F.lit([before.get(k, 0) for k in range(size)]), F.col("__bucket") + 1)
    copies = F.when(F.col("__key") == head, F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest")), F.struct(guest_of.alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest"))))
    return df.withColumn("__at", F.explode(copies)).withColumn("__bucket", F.col("__at.b")).withColumn("__guest", F.col("__at.guest")).drop("__at"), size


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 1024, most: int = 20_000) -> DataFrame:
    """A row a document: the digests of its text, of its text edited with the next document's, and their likenesses.

    Documents are dealt out by ranges of the id and read in order, a row at a time beside the next; a range's first
    document also goes to the range before. Texts are shuffled once.
    """
    rows = df.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    key = F.coalesce(F.col("id").cast("long"), F.lit(LEAST))
    placed, parts = _places(rows, key, rows_each, most)
    placed = placed.repartition(parts, "__bucket").sortWithinPartitions("__bucket", "__guest", F.desc("__key"), "text")

    def work(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: (id, text, text of the next)."""
        ids, texts, nexts = zip(*held)
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
        own, new, after = digests(list(texts)), digests(edited), digests(list(nexts))
        yield pa.RecordBatch.from_pydict(
            {
                id_col: pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": as_text(*own),
                "edited_fingerprint": as_text(*new),
                "near_edited": likeness(own, new),
                "near_next": likeness(own, after),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, size, paired = None, [], 0, None
        for batch in batches:
            ids, texts, buckets, guests = (batch.column(k).to_pylist() for k in range(4))
            for at in zip(ids, texts, buckets, guests):
                if before is not None and before[2] == at[2] and not before[3]:
                    held.append((before[0], before[1], at[1]))
                    size += 2 * len(before[1]) + len(at[1])
                before = at
                if size >= 1 << 20:
                    yield from work(held)
                    held, size = [], 0
        if held:
            yield from work(held)

    return placed.select("id", "text", "__bucket", "__guest").mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
