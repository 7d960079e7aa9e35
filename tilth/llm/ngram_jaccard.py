"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the classes their links form.

The order of all shingles is by the number of sets that hold them, then by hash, so a set's prefix is made of its
rarest shingles and a line that a third of all documents share is in hardly any prefix. Exact copies are folded into
their first document before.

Index lists (one a shingle, split into blocks by set size) are skipped by position: two sets that meet at positions i
and j can still share min(n - i, m - j) shingles, and a pair that cannot reach the threshold is never looked at; blocks
more than one size step apart never meet. Within a block one set, the leader, is answered first: the one with
the fewest shingles of its own, which is nearest to what its group has in common. Every other set is
compared with the leaders of its block and of the block below, so a group of near copies is tied together by as many
comparisons as it has members. What remains are pairs whose classes are still apart; those are derived from the
leaders' answers by the triangle inequality of the Jaccard distance (|d(x, l) - d(y, l)| > 1 - t rules a pair out) and
only the rest are compared. No list is capped and no link between classes is lost.

Defined cases: null or empty text has no shingles and links with nothing; fewer words than a shingle are one shingle.
Rows that repeat an id with one text are one document and each gives a row; different texts under one id are joined
into one set. Rows without an id are one document for each text, and a class of only such has a null id. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm import grams
from tilth.llm.common import WORD, boxed, cut, whole
from tilth.operators import graph

#: Rows without an id stand under their text's hash, above all ids.
NULL_ID = 1 << 62
#: Bytes of text in a block of documents, which one task holds at a time, and blocks' worth of text a shard.
BLOCK_BYTES, BLOCKS_A_SHARD = 4 << 20, 2


def _blocks(total: int, block_bytes: int) -> int:
    return max(1, -(-total // block_bytes))


def _threshold(percent: int):
    """least overlap of two sizes, and length of a prefix, for a Jaccard similarity of percent / 100."""
    overlap = lambda a, b: -((-percent * (a + b)) // (100 + percent))
    prefix = lambda n: n - -((-percent * n) // 100) + 1
    return overlap, prefix


def _sets(table: pa.Table, kept: set[tuple], size: int) -> tuple[list[int], list[np.ndarray]]:
    """Nodes of a block, ascending, and their shingle sets. table: id, key_1, key_2, text."""
    ids, one, two = (table.column(k).to_pylist() for k in range(3))
    first: dict[tuple, int] = {}
    for k, key in enumerate(zip(ids, one, two)):  # the same row again adds nothing
        if key in kept:
            first.setdefault(key, k)
    rows = sorted(first.values(), key=lambda k: ids[k])
    sets = grams.shingle_sets(table.column(3).take(rows).to_pylist(), size) if rows else []
    nodes: list[int] = []
    out: list[np.ndarray] = []
    for k, own in zip(rows, sets):
        if nodes and nodes[-1] == ids[k]:
            out[-1] = np.union1d(out[-1], own)
        else:
            nodes.append(ids[k])
            out.append(own)
    return nodes, out


def _kept(table: pa.Table) -> set[tuple]:
    return set(zip(*(table.column(c).to_pylist() for c in ("node", "rep_1", "rep_2"))))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def nodes_and_index(keyed: DataFrame, first: DataFrame, percent: int, size: int, total: int, block_bytes: int) -> DataFrame:
    """A row a node: node, n (shingles), lone (shingles of no other set), tokens (packed, in the order of all shingles; only where a prefix meets another
    set), and the tokens and positions of that prefix.

    keyed: id, key_1, key_2, text, block. first: block, node, key_1, key_2 of the document that stands for its copies.
    Counts are of a shingle's top bits: they order shingles the same way in every block, and two shingles that share
    them only look less rare than they are.
    """
    blocks, shards = _blocks(total, block_bytes), max(1, -(-total // (BLOCKS_A_SHARD * block_bytes)))
    bits = grams.bits_for(total, 8)
    shift = np.uint64(64 - bits)
    _, prefix = _threshold(percent)

    def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(sets) >> shift if sets else np.zeros(0, np.uint64), return_counts=True)

    def count(docs: pa.Table, reps: pa.Table) -> pa.Table:
        block = (docs if docs.num_rows else reps).column("block")[0].as_py()
        keys, counts = keys_of(_sets(docs, _kept(reps), size)[1])
        parts = list(grams.shards_of(keys, shards, bits))
        return pa.table(
            {
                "shard": pa.array([s for s, _, _ in parts], pa.int32()),
                "block": pa.array([block] * len(parts), pa.int32()),
                "keys": pa.array([grams.pack(keys[a:b]) for _, a, b in parts], pa.binary()),
                "counts": pa.array([grams.pack_counts(counts[a:b]) for _, a, b in parts], pa.binary()),
            }
        )

    def answer(shard: pa.Table) -> pa.Table:
        totals = grams.add_up([grams.unpack(x.as_py()) for x in shard.column("keys")], [grams.unpack_counts(x.as_py()) for x in shard.column("counts")])
        return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "totals": pa.array([grams.pack_counts(t) for t in totals], pa.binary())})

    def index(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted((s, x) for s, x in zip(told.column("shard").to_pylist(), told.column("totals").to_pylist()) if s >= 0)
        nodes, sets = _sets(docs, _kept(told), size)
        keys, _ = keys_of(sets)
        held_in = np.concatenate([np.zeros(0, np.int64), *(grams.unpack_counts(x) for _, x in rows)])
        del rows
        n, lone, tokens, heads, places = [], [], [], [], []
        for own in sets:
            n.append(len(own))
            many = held_in[np.searchsorted(keys, own >> shift)]
            lone.append(int((many == 1).sum()))
            p = prefix(len(own)) if len(own) else 0
            order = np.lexsort((own, many))[:p]
            meets = np.flatnonzero(many[order] > 1)
            tokens.append(own.tobytes() if len(meets) else None)
            heads.append(own[order[meets]])
            places.append(meets)
        return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array(n, pa.int64()), "lone": pa.array(lone, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "head": _lists([h.view(np.int64) for h in heads], pa.int64()), "place": _lists(places, pa.int32())})

    docs = grams.dealt(keyed.select("id", "key_1", "key_2", "text", "block"), "block", blocks)
    # columns anew, for both sides come from the same rows and a cogroup would take one side's keys for the other's
    reps = first.select(*[(F.col(c) + 0).cast(kind).alias(name) for c, kind, name in (("block", "int", "block"), ("node", "long", "node"), ("key_1", "long", "rep_1"), ("key_2", "long", "rep_2"))])
    sent = docs.groupBy("block").cogroup(grams.dealt(reps, "block", blocks).groupBy("block")).applyInArrow(count, "shard int, block int, keys binary, counts binary")
    answers = grams.dealt(sent, "shard", shards).groupBy("shard").applyInArrow(answer, "block int, shard int, totals binary")
    told = answers.unionByName(reps.withColumn("shard", F.lit(-1)), allowMissingColumns=True)
    return docs.groupBy("block").cogroup(grams.dealt(told, "block", blocks).groupBy("block")).applyInArrow(index, "node long, n long, lone long, tokens binary, head array<long>, place array<int>")


def _compare(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """pairs (x, y) with the size of their intersection."""
    one = tokens.select(F.col("node").alias("x"), F.col("tokens").alias("of_x"))
    two = tokens.select(F.col("node").alias("y"), F.col("tokens").alias("of_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True)) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], names=["x", "y", "shared"])

    return pairs.join(one, "x").join(two, "y").select("x", "y", "of_x", "of_y").mapInArrow(run, "x long, y long, shared long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in a link (x, y): the smallest node reachable."""
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return graph.components(edges.select(F.explode(F.array("a", "b")).alias("node")), edges)


def _could_link(nx: Column, ny: Column, i: Column, j: Column, percent: int) -> Column:
    """By size and by what is left after positions i and j."""
    least = F.ceil(F.lit(percent) * (nx + ny) / (100 + percent))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (F.least(nx - i, ny - j) >= least)


def _tokens(index: DataFrame) -> DataFrame:
    return index.where(F.col("tokens").isNotNull()).select("node", "n", "tokens")


def _entries(index: DataFrame, percent: int) -> DataFrame:
    """A row a shingle of a prefix: token, step of the set's size, node, n, lone and place. Sets that link are at most one
    step apart."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent + 0.01)))
    each = index.where(F.size("head") > 0).select("node", "n", "lone", step.alias("step"), F.explode(F.arrays_zip("head", "place")).alias("e"))
    return each.select(F.col("e.head").alias("token"), "step", "node", "n", "lone", F.col("e.place").alias("place"))


def _early(percent: int) -> Column:
    """The smaller set of a pair (the first of equals) meets the other early: past this place it can't share enough."""
    return (F.col("n") - F.col("place")) * (100 + percent) >= 2 * percent * F.col("n")


def _judged(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y) with shared, union and whether they link."""
    sizes = tokens.select("node", "n")
    with_n = _compare(pairs, tokens).join(sizes.select(F.col("node").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("node").alias("y"), F.col("n").alias("ny")), "y")
    union = F.col("nx") + F.col("ny") - F.col("shared")
    return cut(with_n.select("x", "y", "shared", union.alias("union"), (F.col("shared") * 100 >= union * percent).alias("linked")))


def links(index: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(compared, classes): every compared pair with its similarity's numbers, and the classes its links form."""
    tokens = _tokens(index)
    entries, early = _entries(index, percent), _early(percent)
    leaders = entries.where(early).groupBy("token", "step").agg(F.min(F.struct("lone", "node", "n", "place")).alias("leader"))
    near = leaders.select("token", "step", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("at"), "leader")
    starred = entries.join(near.select("token", F.col("at").alias("step"), "leader"), ["token", "step"])
    fits = _could_link(F.col("n"), F.col("leader.n"), F.col("place"), F.col("leader.place"), percent)
    pairs = starred.where((F.col("node") != F.col("leader.node")) & fits).select(F.least("node", "leader.node").alias("x"), F.greatest("node", "leader.node").alias("y")).distinct()
    first = _judged(pairs, tokens, percent)
    classes = components(first.where("linked"))

    # lists whose members are still in different classes: blocks of (shingle, size step, class) meet first, and of the
    # smaller sets only those entries that are early enough
    placed = entries.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = leaders.select("token", "step", F.col("leader.node").alias("leader"))
    known = first.select("x", "y", (1 - F.col("shared") / F.col("union")).alias("far"))
    known = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "far"))
    placed = placed.join(lead, ["token", "step"], "left").join(known.select(F.col("x").alias("node"), F.col("y").alias("leader"), "far"), ["node", "leader"], "left")
    placed = placed.withColumn("far", F.when(F.col("node") == F.col("leader"), 0.0).otherwise(F.col("far")))
    placed = cut(placed.select("token", "step", "node", "n", "place", "component", "far"))
    # the largest partner that an entry can still share enough with
    reach = F.floor(F.lit((100 + percent) / percent) * (F.col("n") - F.col("place")) - F.col("n") + 1e-6)
    large = placed.groupBy("token", "step", "component").agg(F.max(F.least("n", reach)).alias("most"))
    small = placed.where(early).groupBy("token", F.col("step").alias("step_y"), F.col("component").alias("component_y")).agg(F.min("n").alias("least_y"))
    small = small.withColumn("step", F.explode(F.array(F.col("step_y"), F.col("step_y") + 1)))
    meet = large.join(small, ["token", "step"]).where((F.col("component") != F.col("component_y")) & (F.col("least_y") <= F.col("most"))).select("token", "step", "component", "step_y", "component_y")
    right = placed.where(early).select("token", F.col("step").alias("step_y"), F.col("component").alias("component_y"), F.col("node").alias("node_y"), F.col("n").alias("n_y"), F.col("place").alias("place_y"), F.col("far").alias("far_y"))
    larger = (F.col("n") > F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("node") > F.col("node_y")))
    crossed = meet.join(placed, ["token", "step", "component"]).join(right, ["token", "step_y", "component_y"]).where(larger)
    ruled_out = (F.col("step") == F.col("step_y")) & (F.abs(F.col("far") - F.col("far_y")) > 1 - percent / 100 + 1e-9)
    rest = crossed.where(_could_link(F.col("n"), F.col("n_y"), F.col("place"), F.col("place_y"), percent) & ~F.coalesce(ruled_out, F.lit(False)))
    rest = rest.select(F.least("node", "node_y").alias("x"), F.greatest("node", "node_y").alias("y")).distinct().join(first, ["x", "y"], "left_anti")
    second = _judged(rest, tokens, percent)
    compared = first.unionByName(second)
    more = second.where("linked").limit(1).count()
    return compared, components(compared.where("linked")) if more else classes


def _classes(df: DataFrame, ids: Column, text: Column, percent: int, size: int, block_bytes: int) -> DataFrame:
    """A row a row of df: id, key_1 of the text, n and component. ids: a number for each document."""
    keyed, first, index = _indexed(df, ids, text, percent, size, block_bytes)
    _, found = links(index, percent)
    of_node = index.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    of_key = first.join(of_node, "node").select("key_1", "key_2", "n", "component")
    out = keyed.select("id", "key_1", "key_2").join(of_key, ["key_1", "key_2"])
    return out.select("id", "key_1", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def _indexed(df: DataFrame, ids: Column, text: Column, percent: int, size: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with id and keys of the text, the document that stands for each text, the index)."""
    keyed = df.select(ids.alias("id"), F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit("second"), text).alias("key_2"), text.alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_blocks(total, block_bytes))).cast("int").alias("block")
    keyed = keyed.select("*", place("id"))
    first = cut(keyed.groupBy("key_1", "key_2").agg(F.min("id").alias("node")).select("*", place("node")))
    return keyed, first, cut(nodes_and_index(keyed, first, percent, size, total, block_bytes))


def _of_text(text: Column) -> Column:
    """A number for a text, above all ids."""
    return F.lit(NULL_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 61))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a row of df: id_col, n_shingles and component_id, the smallest id that links reach."""
    given = lambda c: F.when(F.col(c) < NULL_ID, F.col(c))
    text = whole(F.col(text_col))
    found = _classes(df, F.coalesce(F.col(id_col).cast("long"), _of_text(text)), text, percent, size, block_bytes)
    return found.select(given("id").alias(id_col), F.col("n").alias("n_shingles"), given("component").alias("component_id"))


def linked_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every link between different texts: (x, y, shared, union), x and y being the smallest ids of the two texts, x < y.

    What links() leaves out, pairs within a class, is compared here too, so this costs what its pairs are: a group of
    near copies gives the square of its size. Rows without an id stand under their text's number.
    """
    text = whole(F.col(text_col))
    _, _, index = _indexed(df, F.coalesce(F.col(id_col).cast("long"), _of_text(text)), text, percent, size, block_bytes)
    entries = cut(_entries(index, percent))
    right = entries.where(_early(percent)).select("token", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"), *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "place")])
    larger = (F.col("n") > F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("node") > F.col("node_y")))
    met = entries.join(right, ["token", "step"]).where(larger & _could_link(F.col("n"), F.col("n_y"), F.col("place"), F.col("place_y"), percent))
    pairs = met.select(F.least("node", "node_y").alias("x"), F.greatest("node", "node_y").alias("y")).distinct()
    return _judged(pairs, _tokens(index), percent).where("linked").drop("linked")


def firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with one row of each class of texts, all columns: the one of the smallest id, rows without an id last, then of
    the smallest hash. Here every text is a document of its own, also where texts share an id, so none goes that is no
    copy. Rows without words all stay; of the same row twice one stays."""
    text = whole(F.col(text_col))
    found = _classes(df, _of_text(text), text, percent, size, block_bytes).where("n > 0").select("key_1", "component").distinct()
    rows = boxed(df, id=F.col(id_col), key=F.xxhash64(text), wordy=text.rlike(WORD))
    named = rows.where("wordy").select("id", "key").join(found, F.col("key") == F.col("key_1"))
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    kept = kept.select(F.col("best.id").alias("kept_id"), F.col("best.key").alias("kept_key"))
    joined = rows.where("wordy").join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    number = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    return joined.withColumn("number", number).where("number = 1").select("row.*").unionByName(rows.where("NOT wordy").select("row.*"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
