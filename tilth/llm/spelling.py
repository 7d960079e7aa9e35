"""Spelling variants of a corpus's words: which words differ by one code point, and which of two is the other's variant.

Every letter has a bit, and a word's mask holds the parity of each letter's count. One inserted or deleted letter flips
one bit, one replaced letter two; so of a mask's three bands one at least is equal in two near words. Near words are also
equal in their first or in their last half, whichever the edit left alone. Words are joined on an equal band and half
within a class of lengths, so a bucket holds words that agree in most of their letters and stays small however many words
begin alike. The masks' flipped bits are counted next, and the edit distance decides.

Counts come from all occurrences: runs are cut in Spark, partial sums go before the shuffle, so a word that is
everywhere is one row a task.

Defined cases: null or empty text has no words. A null id counts as the empty string where the id is asked for. Very long
runs are words like others. Rows that repeat an id each count. Of near words that occur equally often the smallest in
code-point order is the form. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import cut, lower_ascii, whole

#: a-z and the code points from C0 to FF; each has a bit in one of three bands.
FIRST_LATIN, LAST_LATIN = 0xC0, 0xFF
BANDS = 3
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One occurrence in so many loses a code point.
SLIP = 199


def _occurrences(df: DataFrame, id_col: str, text_col: str, least_length: int, slip: int) -> DataFrame:
    """A row an occurrence that is long enough: `word`, a lowered run that may have lost a code point."""
    # what is lost only shortens a run, so shorter ones are never cut out
    pattern = f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"
    runs = df.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(whole(F.col(text_col))), F.lit(pattern), F.lit(0))).alias("run"),
    )
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    lost = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def vocabulary(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP
) -> DataFrame:
    """word and n, its occurrences, of every word of at least that length and count."""
    words = _occurrences(df, id_col, text_col, least_length, slip)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def parity(word: Column, band: int) -> Column:
    """The band's bits: letters in turn belong to the bands, and a letter's bit is set if it stands in the word an odd number of times."""

    def flipped(mask: Column, letter: Column) -> Column:
        point = F.ascii(letter)
        number = F.when(point >= FIRST_LATIN, point - FIRST_LATIN + 26).otherwise(point - ord("a"))
        return F.when(number % BANDS == band, mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(number / BANDS).cast("int")))).otherwise(mask)

    return F.aggregate(F.split(word, ""), F.lit(0), flipped)


def _bucketed(words: DataFrame, roles: list[int]) -> DataFrame:
    """A row a word, class of lengths, band and half: `bucket`, a hash of these. A word is as long as its class (role 0) or
    one code point longer (role 1)."""
    masked = words.select("word", "n", F.length("word").alias("size"), *[parity(F.col("word"), b).alias(f"band_{b}") for b in range(BANDS)])
    columns = ["word", "n", "size", *[f"band_{b}" for b in range(BANDS)]]
    buckets = []
    for role in roles:
        size = F.col("size") - role
        half = F.floor(size / 2).cast("int")
        for side, part in (("head", F.substring("word", F.lit(1), half)), ("tail", F.substring("word", -half, half))):
            buckets += [F.xxhash64(size, F.lit(b), F.col(f"band_{b}"), F.lit(side), part) for b in range(BANDS)]
    return masked.select(*columns, F.explode(F.array(*buckets)).alias("bucket"))


def near_words(words: DataFrame) -> DataFrame:
    """Every two words at an edit distance of 1, once: word, n, near, near_n. words: distinct word, with n."""
    left, right = _bucketed(words, [0]), _bucketed(words, [0, 1])
    right = right.select("bucket", *[F.col(c).alias(f"{c}_y") for c in right.columns if c != "bucket"])
    longer = F.col("size_y") - F.col("size")
    flips = sum((F.bit_count(F.col(f"band_{b}").bitwiseXOR(F.col(f"band_{b}_y"))) for b in range(BANDS)), F.lit(0))
    wanted = ((longer == 0) & (F.col("word") < F.col("word_y")) & (flips == 2)) | ((longer == 1) & (flips == 1))
    met = left.join(right, "bucket").where(wanted & (F.levenshtein("word", "word_y", 1) == 1))
    return met.select("word", "n", F.col("word_y").alias("near"), F.col("n_y").alias("near_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word with a form: the last that forms lead to. Every round doubles how far a root looks, and
    since a form is `times` as frequent as its word, chains are short."""
    forms = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(forms.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forms = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return forms


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """A row a word: word, n, n_near, form (its most frequent near word, if that occurs `times` as often), form_n, root."""
    words = cut(words.select("word", "n"))
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    told = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(told, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * times
    found = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    rooted = roots(found.where("form IS NOT NULL"))
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(df: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all documents' words."""
    return variants(vocabulary(df))


SQL = r"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
points AS (SELECT run, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS p FROM runs WHERE length(run) >= 6),
bytes AS (SELECT run, [4294967295] || flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)) AS b FROM points),
hashed AS (SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) u(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
top AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY 1),
best AS (SELECT word, near, near_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT v.word, v.n, coalesce(top.n_near, 0) AS n_near, CASE WHEN best.near_n >= 5 * v.n THEN best.near END AS form, CASE WHEN best.near_n >= 5 * v.n THEN best.near_n END AS form_n
  FROM v LEFT JOIN top ON top.word = v.word LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, form, word AS root FROM f UNION ALL SELECT c.word, f.form, f.word FROM chain c JOIN f ON f.word = c.form)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL
"""
