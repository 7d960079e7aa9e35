"""Mixing sources to target weights, in Spark's own operators.

Each source's words are packed, document after document, into blocks of fixed length. A source gets as many slots as
its target needs, and every slot of the mix is dealt to an output shard by one keyed permutation of all slots: the
counts of the sources in a shard are then a multinomial draw conditioned on the totals that the targets fix. A
source's k-th slot takes the block that the source's own keyed permutation of block indexes puts at k, so that no block
comes again before all have come, and blocks join slots by index.

Both permutations are swap-or-not networks: each round pairs x with (key - x) mod n and a hash of the larger of the
two says whether they change places. That is a bijection of any [0, n) with a closed inverse, so nothing is sorted.

Defined cases: null text has no words; null is a source of its own, last in order; a source without words has target
and slots of zero. Rows that repeat an id each count. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm.common import WORD, boxed, cut, words_in

#: Weights by the source's place in the order, repeating; the mix's share of all words; how often a source may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SHARD_SLOTS, ROUNDS = 64, 4096, 32
#: Documents packed together; the packing order within a source is by bucket, then by hash.
BUCKET_ROWS = 4096


def permuted(x: Column, n: Column, *seed: Column, backwards: bool = False) -> Column:
    """The place of x in a keyed permutation of [0, n), or with backwards the x of a place. All longs; n of 0 gives x."""
    rounds = [F.lit(k) for k in range(ROUNDS)]
    safe = F.greatest(n, F.lit(1).cast("long"))

    def swap(held: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(k, F.lit("key"), *seed), safe) - held, safe)
        return F.when(F.pmod(F.xxhash64(k, F.greatest(held, other), *seed), F.lit(2)) == 1, other).otherwise(held)

    return F.aggregate(F.array(*(reversed(rounds) if backwards else rounds)), x, swap)


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and number of words of each row, with its place in a pseudorandom order."""
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(F.lit("order"), F.col(id_col), F.col(text_col)).alias("place"))


def targets(sized: DataFrame) -> DataFrame:
    """A row a source: its words, its target, and how its blocks and slots run.

    The target of a source is the least of MOST times its words and its weight times a level; sorted by the level at
    which each source fills up, running sums give the level at which the targets add up to the share. Its windows run
    over one row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    number = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(number - 1, F.lit(len(WEIGHTS))) + 1)
    by = by.withColumns({"source_no": number.cast("long"), "weight": weight})
    by = by.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumns(
        {
            "wanted": SHARE * F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("wanted") - F.col("full")) / F.col("open")
    fits = level * F.col("weight") <= F.col("cap")  # this source and those after it stay open at this level
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), level.alias("level")))).over(everything)["level"]
    by = by.withColumn("level", level).withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    return by.select("source", "source_no", "source_size", "target", "rows", *_runs())


def _runs() -> list[Column]:
    """blocks, size of the last one, words and slots to take, from source_size and target."""
    n = F.ceil(F.col("source_size") / BLOCK).cast("long")
    want = F.round("target").cast("long")
    return [n.alias("blocks"), (F.col("source_size") - BLOCK * (n - 1)).alias("last"), want.alias("want")]


def _words_before(k: Column, short_at: Column) -> Column:
    """Words in the first k slots of a round: all full but for the source's short last block, which stands at short_at."""
    return k * BLOCK - F.when(short_at < k, BLOCK - F.col("last")).otherwise(F.lit(0).cast("long"))


def slots(sources: DataFrame) -> DataFrame:
    """A row a slot of the mix: shard, place in it, source_no, block, round and words taken from the block's start.

    Slots are made in chunks, so that a source with a third of them spreads.
    """
    chunk = 4096
    rounds = sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST - 1).cast("long"))).alias("round"))
    take = F.least(F.greatest(F.col("want") - F.col("round") * F.col("source_size"), F.lit(0).cast("long")), F.col("source_size"))
    rounds = rounds.withColumn("take", take).where("take > 0")
    rounds = rounds.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("source_no"), F.col("round"), backwards=True))
    least = F.ceil(F.col("take") / BLOCK).cast("long")
    n_slots = F.when(_words_before(least, F.col("short_at")) >= F.col("take"), least).otherwise(least + 1)
    rounds = rounds.withColumn("n_slots", n_slots)
    running = Window.orderBy("source_no", "round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumns({"first": F.coalesce(F.sum("n_slots").over(running), F.lit(0).cast("long")), "all_slots": F.sum("n_slots").over(Window.partitionBy(F.lit(0)))})
    chunks = rounds.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / chunk))))
    # a set number of partitions, since the few small rows here are about to become many
    chunks = chunks.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "round", "chunk")
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("n_slots")) - 1)))
    full = F.when(F.col("k") == F.col("short_at"), F.col("last")).otherwise(F.lit(BLOCK).cast("long"))
    words = F.least(full, F.col("take") - _words_before(F.col("k"), F.col("short_at")))
    at = permuted(F.col("first") + F.col("k"), F.col("all_slots"), F.lit("deal"))
    return each.select(
        F.floor(at / SHARD_SLOTS).alias("shard"),
        F.pmod(at, F.lit(SHARD_SLOTS)).alias("place"),
        "source_no",
        permuted(F.col("k"), F.col("blocks"), F.col("source_no"), F.col("round")).alias("block"),
        "round",
        words.alias("words"),
    )


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with source_no, source_size, target and `at`, the place of the row's first word among its source's words.

    Running sums go in two steps, within buckets of rows and over buckets, so that no source meets in one task.
    """
    own = sources.select(F.col("source").alias("__source"), "source_no", "source_size", "target", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"))
    rows = sized.join(own, sized["source"].eqNullSafe(own["__source"])).drop("__source")
    rows = rows.withColumn("bucket", F.pmod("place", F.col("buckets")))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("words")
    inside = Window.partitionBy("source_no", "bucket").orderBy("place", F.col("id").isNull(), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    return rows.join(sums, ["source_no", "bucket"]).withColumn("at", F.col("at") + F.col("start")).drop("start", "bucket", "buckets")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, draws): the packed rows with a `row` number, and for each row and block that the mix draws from it
    the words it gives: row, source_no, block, round, shard, place, start (in the row's words) and words."""
    return _plan(cut(sizes(df, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id())))


def _plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    sources = cut(targets(sized))
    rows = packed(sized, sources)
    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))))
    low = F.greatest(F.col("at"), F.col("block") * BLOCK)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    parts = parts.select("row", "source_no", "block", (low - F.col("at")).alias("start"), (low - F.col("block") * BLOCK).alias("from"), (high - low).alias("n"))
    drawn = parts.join(slots(sources).hint("merge"), ["source_no", "block"]).withColumn("words", F.least(F.col("n"), F.col("words") - F.col("from"))).where("words > 0")
    return rows, drawn.drop("from", "n")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row a document: its words, its source's words and target, and how many of its words the mix takes."""
    rows, drawn = plan(df, id_col, text_col, source_col)
    taken = drawn.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row a piece of the mix, in slots of shards: shard, place, source, id, first word, and the words as text."""
    rows, drawn = plan(df, id_col, text_col, source_col)
    keys = rows.select("row", F.col("id").alias(id_col), "source", "place")
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.lit("order"), F.col(id_col), F.col(text_col)).alias("__place")).dropDuplicates(["__id", "__place"])
    keyed = keys.withColumnRenamed("place", "order_key").join(texts, (F.col("order_key") == F.col("__place")) & F.col(id_col).eqNullSafe(F.col("__id")))
    words = F.slice(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("words").cast("int"))
    return drawn.join(keyed, "row").select("shard", "place", F.col("source").alias(source_col), id_col, "start", F.array_join(words, " ").alias(text_col))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The words that the mix takes, as rows of df, all columns kept.

    A row comes as often as its taken words fill its size, rounded, once at least if any was taken, and its copies' texts
    hold just the words taken, with the white space after them: a text taken as a whole is unchanged, and of what is
    taken again too little for a copy of its own follows in the last copy. A row that gives none goes. A row without
    words stays once, since no share of it is missing.
    """
    held = boxed(df, id=F.col(id_col), text=F.col(text_col), source=F.col(source_col)).withColumn("number", F.monotonically_increasing_id())
    held = cut(held)
    place = F.xxhash64(F.lit("order"), F.col("id"), F.col("text"))
    rows, drawn = _plan(held.select("id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), place.alias("place"), F.col("number").alias("row")))
    pieces = drawn.groupBy(F.col("row").alias("number")).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("round", "start", "words"))).alias("pieces"))
    counted = rows.select(F.col("row").alias("number"), "size").join(pieces, "number", "left").where("size = 0 OR taken > 0")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.greatest(F.round(F.col("taken") / F.col("size")), F.lit(1))).cast("int")
    each = held.join(counted.withColumn("copies", copies), "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = F.filter("pieces", lambda p: F.least(p["round"] + 1, F.col("copies")) == F.col("copy"))
    each = each.withColumn("pieces", own).withColumn("own", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"]))
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    each = each.withColumn("words", F.when((F.col("size") > 0) & (F.col("own") != F.col("size")), words))

    def of_round(k: Column) -> Column:
        parts = F.filter("pieces", lambda p: p["round"] == k)
        return F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(F.col("words"), p["start"].cast("int") + 1, p["words"].cast("int")))), "")

    rounds = F.array_distinct(F.transform("pieces", lambda p: p["round"]))
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rounds, of_round), "\n\n"))
    return each.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
