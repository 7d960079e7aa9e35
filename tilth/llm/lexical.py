"""Ranked lexical search by Block-Max WAND over an inverted index in segments.

Documents go to segments of a few megabytes as they are read, without a shuffle. A segment holds the posting lists of all
its terms: documents are numbered by length, a list is cut into blocks of BLOCK postings, and a block is compressed (gaps
and counts in seven-bit groups) beside its first and last document and the largest impact in it.

A query has a threshold, the tenth best score so far, which goes on from segment to segment of a task. Lists whose maxima,
the lowest first, together stay below it can't make a pivot: only the others can start one. Their blocks, by first and
last document alone, are moved over first (the block maxima of all lists that reach into a range of documents, each times
its term's weight, add up to the range's bound), and only blocks in ranges that reach the threshold are decompressed. Of
the documents found there the other lists' blocks are opened, the weightiest list first, only where the block maxima still
to come can lift a document to the threshold. Skipping is exact: a bound is never below a score, and what can tie is read.

Impacts are integers that hang on the corpus by two numbers, its documents and its terms; weights hang on how many
documents hold a term, summed over segments. Terms go by hashes of 64 bits.

Queries are taken in blocks of QUERY_BYTES, each sent to all segments; what is sent is so bounded, however many queries
there are.

Defined cases: null or empty text, or text without a term, is no document of the index; an item without terms has no rows.
Rows that repeat a document are each ranked; a null id comes after all others among equal scores. The same item twice is
one; different texts under one item id are one item with all their terms. A very long text is a segment of its own. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm import grams
from tilth.llm.common import cut, whole

#: Postings in a block, bytes of text in a segment, bytes of queries that are sent at once.
BLOCK, SEGMENT_BYTES, QUERY_BYTES = 128, 8 << 20, 4 << 20
TOP = 10
#: Documents that are read together as long as there is no threshold.
STRIDE = 512
#: Block maxima are rounded up to a multiple.
GRAIN = 16
NO_ID = np.iinfo(np.int64).max
#: What is no term, as white space: ASCII but digits and letters.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_INDEX = "docs binary, sizes binary, keys binary, held binary, firsts binary, spans binary, maxima binary, widths binary, payload binary"


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, text after text, and the number of terms of each."""
    return grams.word_hashes([(t or "").encode().translate(_BLANKED).decode() for t in texts])


def _sevens(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, the last group of each without the high bit; and where each number starts."""
    length = np.ones(len(values), np.int64)
    for k in range(1, 5):
        length += values >= 1 << (7 * k)
    starts = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for k in range(5):
        on = np.flatnonzero(length > k)
        if not len(on):
            break
        out[starts[on] + k] = (values[on] >> (7 * k)) & 127 | np.where(length[on] > k + 1, 128, 0)
    return out, starts


def _from_sevens(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def damping(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    return 25 + (75 * sizes * n_docs) // n_terms


def build(ids: np.ndarray, texts: list[str | None], n_docs: int, n_terms: int) -> dict[str, bytes] | None:
    """A segment of the index, or none without a term."""
    hashes, sizes = term_hashes(texts)
    by = np.lexsort((ids, sizes))
    by = by[sizes[by] > 0]
    if not len(by):
        return None
    starts, own = (np.cumsum(sizes) - sizes)[by], sizes[by]
    doc = np.repeat(np.arange(len(by)), own)
    hashes = hashes[np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts, own)]
    order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
    hashes, doc = hashes[order], doc[order]
    new_term = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    at = np.flatnonzero(new_term | np.concatenate([[True], doc[1:] != doc[:-1]]))
    tf, doc, new_term = np.diff(np.append(at, len(doc))), doc[at], new_term[at]
    lists = np.flatnonzero(new_term)
    held = np.diff(np.append(lists, len(doc)))
    place = np.arange(len(doc)) - np.repeat(lists, held)
    blocks = np.flatnonzero(place % BLOCK == 0)
    firsts, lasts = doc[blocks], doc[np.append(blocks[1:], len(doc)) - 1]
    gaps = np.diff(doc, prepend=0)
    gaps[blocks] = 0
    payload, begun = _sevens(np.stack([gaps, tf - 1], 1).ravel())
    widths = np.diff(np.append(begun[2 * blocks], len(payload)))
    most = np.maximum.reduceat(impacts(tf, damping(own, n_docs, n_terms)[doc]), blocks)
    parts = {"firsts": firsts, "spans": lasts - firsts, "maxima": -(-most // GRAIN), "widths": widths, "held": held, "sizes": own}
    packed = {k: grams.pack_counts(v) for k, v in parts.items()}
    return packed | {"docs": ids[by].astype("<i8").tobytes(), "keys": grams.pack(hashes[at[lists]]), "payload": payload.tobytes()}


class Segment:
    """A segment as stored; blocks are decompressed when asked for."""

    def __init__(self, row: dict[str, bytes], n_docs: int, n_terms: int) -> None:
        unpacked = {k: grams.unpack_counts(row[k]) for k in ("firsts", "spans", "maxima", "widths", "held", "sizes")}
        self.ids = np.frombuffer(row["docs"], "<i8")
        self.m = damping(unpacked["sizes"], n_docs, n_terms)
        self.keys, self.firsts, self.most = grams.unpack(row["keys"]), unpacked["firsts"], unpacked["maxima"] * GRAIN
        self.lasts = self.firsts + unpacked["spans"]
        many = -(-unpacked["held"] // BLOCK)
        self.list_end = np.cumsum(many)
        self.list_start = self.list_end - many
        self.tops = np.maximum.reduceat(self.most, self.list_start)
        self.ends = np.cumsum(unpacked["widths"])
        self.begins = self.ends - unpacked["widths"]
        self.payload = np.frombuffer(row["payload"], np.uint8)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 for none."""
        at = np.searchsorted(self.keys, terms)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == terms, at, -1)

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if number not in self.open:
            pairs = _from_sevens(self.payload[self.begins[number] : self.ends[number]]).reshape(-1, 2)
            doc = self.firsts[number] + np.cumsum(pairs[:, 0])
            self.open[number] = doc, impacts(pairs[:, 1] + 1, self.m[doc])
        return self.open[number]


class Best:
    """The best documents so far, by score and then by id."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.scores) == self.top

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if self.full else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        by = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[by], ids[by]


def search(segment: Segment, lists: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Puts the segment's documents that belong there into best. lists, weights: of the query's terms that the segment
    holds. Returns how many blocks it decompressed."""
    tops = segment.tops[lists] * weights
    by = np.argsort(tops, kind="stable")
    lists, weights, tops = lists[by], weights[by], tops[by]
    low, size, read = 0, len(segment.ids), 0
    while low < size and len(lists):
        high = size if best.full else min(size, low + STRIDE)  # without a threshold there is nothing to skip by
        read += _search_between(segment, lists, weights, tops, low, high, best)
        low = high
    return read


def _search_between(segment: Segment, lists: np.ndarray, weights: np.ndarray, tops: np.ndarray, low: int, high: int, best: Best) -> int:
    """search() over the documents low .. high - 1; lists by ascending maximum."""
    threshold = best.threshold
    led = int(np.searchsorted(np.cumsum(tops), threshold))  # lists that no pivot starts from: together they stay below it
    if led == len(lists):
        return 0
    many = segment.list_end[lists] - segment.list_start[lists]
    block = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(segment.list_start[lists], many)
    weight, leads = np.repeat(weights, many), np.repeat(np.arange(len(lists)) >= led, many)
    first, after = segment.firsts[block], segment.lasts[block] + 1

    # shallow moves: the ranges between blocks' ends, and what the maxima of the blocks that reach into each add up to
    edges = np.unique(np.concatenate([first, after]))
    start, stop = np.searchsorted(edges, first), np.searchsorted(edges, after)
    steps = np.zeros(len(edges), np.int64)
    np.add.at(steps, start, segment.most[block] * weight)
    np.subtract.at(steps, stop, segment.most[block] * weight)
    pivots = np.concatenate([[0], np.cumsum(np.cumsum(steps) >= threshold)])
    reached = np.flatnonzero(leads & (pivots[stop] > pivots[start]) & (first < high) & (after > low))
    scores = np.zeros(high - low, np.int64)
    for k in reached.tolist():
        doc, impact = segment.block(int(block[k]))
        a, b = np.searchsorted(doc, (low, high))
        scores[doc[a:b] - low] += weight[k] * impact[a:b]
    read = len(reached)

    # a document with pivot terms is read on only while the block maxima of the other lists can lift it to the threshold
    docs = np.flatnonzero(scores)
    scores, docs = scores[docs], docs + low
    held = np.full((led, len(docs)), -1)
    for k in range(led):
        a, b = int(segment.list_start[lists[k]]), int(segment.list_end[lists[k]])
        at = np.minimum(a + np.searchsorted(segment.lasts[a:b], docs), b - 1)
        held[k] = np.where((segment.firsts[at] <= docs) & (docs <= segment.lasts[at]), at, -1)
    more = np.where(held >= 0, segment.most[held], 0) * weights[:led, None]
    left = more.sum(axis=0)
    for k in range(led - 1, -1, -1):
        on = scores + left >= threshold
        if not on.all():
            scores, docs, held, more, left = scores[on], docs[on], held[:, on], more[:, on], left[on]
        for number in np.unique(held[k][held[k] >= 0]).tolist():
            here = np.flatnonzero(held[k] == number)
            doc, impact = segment.block(number)
            at = np.minimum(np.searchsorted(doc, docs[here]), len(doc) - 1)
            scores[here] += np.where(doc[at] == docs[here], weights[k] * impact[at], 0)
            read += 1
        left = left - more[k]
    on = scores >= threshold
    if on.any():
        best.add(scores[on], segment.ids[docs[on]])
    return read


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """Ids and texts of batches (id, text), in stretches of at least so many bytes but for the last."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(NO_ID if i is None else i)
                texts.append(text)
                held += len(text or "")
                if held >= size:
                    yield np.array(ids, np.int64), texts
                    ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def totals(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats. texts: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                for text in batch.column(0).slice(start, 128).to_pylist():
                    raw = np.frombuffer((text or "").encode().translate(_BLANKED), np.uint8) != 0x20
                    n = int(np.count_nonzero(raw[1:] & ~raw[:-1])) + int(len(raw) and raw[0])
                    docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    row = texts.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def index(df: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row a segment, over every row of df. n_docs, n_terms: totals() of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _stretches(batches, segment_bytes):
            made = build(ids, texts, n_docs, n_terms)
            if made:
                yield pa.RecordBatch.from_pylist([made], pa.schema([(c.split()[0], pa.binary()) for c in _INDEX.split(", ")]))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


def _holders(segments: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the terms (sorted hashes), over all segments."""
    sent = segments.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for keys, held in zip(batch.column(0), batch.column(1)):
                keys, held = grams.unpack(keys.as_py()), grams.unpack_counts(held.as_py())
                at = np.searchsorted(keys, sent.value)
                at[at == len(keys)] = 0
                total += np.where(keys[at] == sent.value, held[at], 0)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[on].view(np.int64)), pa.array(total[on])], names=["term", "docs"])

    rows = segments.select("keys", "held").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    return {r.term: r.docs for r in rows.collect()}  # a row a term of the block of queries at most


def _weighed(items: list, found: dict[int, int], n_docs: int) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(item, its distinct terms, their weights times their repeats), of terms that some document holds."""
    out = []
    for item, terms, repeats in items:
        on = [k for k, t in enumerate(terms.view(np.int64).tolist()) if t in found]
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found[int(terms[k].view(np.int64))] + 1))) for k in on]
        out.append((item, terms[on], np.array(weights, np.int64) * repeats[on]))
    return out


def rank(
    segments: DataFrame, queries: DataFrame, n_docs: int, n_terms: int, item_col: str = "item_id", text_col: str = "text", top: int = TOP, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """item_col, rank, doc_id and score of the best documents of each item. segments: a written index()."""
    kind = dict(queries.dtypes)[item_col]
    wanted = queries.select(F.col(item_col).alias("item"), whole(F.col(text_col)).alias("text")).distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // query_bytes))
    context, out = segments.sparkSession.sparkContext, None
    item_type = wanted.select("item").limit(0).toArrow().schema.field(0).type
    for number in range(blocks):
        held: dict[object, list[np.ndarray]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect():
            held.setdefault(r.item, []).append(term_hashes([r.text])[0])
        items = [(item, *np.unique(np.concatenate(parts), return_counts=True)) for item, parts in held.items()]
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t, _ in items)]))
        sent = context.broadcast(_weighed(items, _holders(segments, every), n_docs))
        answered = segments.mapInArrow(_searcher(sent, item_type, n_docs, n_terms, top), f"item {kind}, doc_id long, score long")
        out = answered if out is None else out.unionByName(answered)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", "doc_id", "score")


def _searcher(sent, item_type: pa.DataType, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.slice(row, 1).to_pylist()[0], n_docs, n_terms)
                for (_, terms, weights), own in zip(sent.value, best):
                    lists = segment.lists(terms)
                    search(segment, lists[lists >= 0], weights[lists >= 0], own)
        for (item, _, _), own in zip(sent.value, best):
            ids = pa.array(own.ids, pa.int64(), mask=own.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own.ids), item_type), ids, pa.array(own.scores)], names=["item", "doc_id", "score"])

    return run


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ten best documents."""
    n_docs, n_terms = totals(docs.select("text"))
    return rank(cut(index(docs, n_docs, n_terms)), items, n_docs, n_terms)


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
