"""Secret scans: candidates in every text, and who in the corpus owns them.

Spark's regular expressions find the matches. A candidate's hash is counted over the whole corpus by distinct
repositories (the id column) and distinct owners (the owner column): a value that many owners hold is a widely copied
example, and so is one that stands in many repositories of the few that hold it; the rest look live. The frequency gives every base match its verdict, and it alone decides whether a
mixed token of no known form (kind "owned") is a secret.

Defined cases: null text is the empty text; null ids and null owners each count as one value. Rows that repeat an id
are one repository, and each still gives a row. Offsets are code points, ends exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import boxed, cut, whole

#: The base patterns and the least length of what counts in them; fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ["assign", "access", "hex", "owned"]
#: A run of token characters of this length that mixes digits with both cases may be an owner's own secret.
TOKEN_LEAST = 24
#: A value that more owners than this hold is a copied example.
OWNERS_MOST = 2
#: And so is one in more repositories an owner than this.
REPOS_AN_OWNER = 20

FOUND = "array<struct<kind:string,start:int,end:int,value_hash:string>>"
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int,value_hash:string,n_repos:bigint,n_owners:bigint,live:boolean>>"


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _matches(text: Column, pattern: str, quick: Column) -> Column:
    """start, end and match of all leftmost non-overlapping matches: split and extract walk the same ones, so the
    lengths of the text between give the places. quick: a cheaper test that every text with a match passes."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.filter(F.zip_with(found, between, lambda m, b: F.struct(m.alias("match"), F.length(b).alias("gap"))), lambda p: p["match"].isNotNull())
    kind = "struct<spans:array<struct<start:int,end:int,match:string>>,at:int>"

    def walk(done: Column, part: Column) -> Column:
        start = done["at"] + part["gap"]
        end = start + F.length(part["match"])
        return F.struct(F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), part["match"].alias("match")))).alias("spans"), end.alias("at"))

    return F.when(quick, F.aggregate(parts, F.from_json(F.lit('{"spans":[],"at":0}'), kind), walk)["spans"]).otherwise(_none("array<struct<start:int,end:int,match:string>>"))


def _found(matches: Column, kind: str, value) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.sha2(value(m["match"]).cast("binary"), 256).alias("value_hash")))


def candidates(df: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row a row of df: id, owner, a key of the text, and what was found in it before any verdict."""
    text = F.col("text")
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    # A run is long or nothing, so its pattern states the length. An assignment too short to count still uses up the
    # text it covers, so assignments are matched first and measured after.
    run = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST
    assign = F.filter(_matches(text, ASSIGN, text.rlike(r"(?i)passw|secret|token|api_?key")), lambda m: F.length(assigned(m["match"])) >= ASSIGN_LEAST)
    access = _matches(text, r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), F.contains(text, F.lit("AKIA")))
    hexes = r"[0-9a-f]{%d,}" % HEX_LEAST
    tokens = F.filter(_matches(text, run, text.rlike(run)), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[a-z]") & m["match"].rlike("[A-Z]"))
    same = lambda m: m
    rows = df.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), whole(F.col(text_col)).alias("text"))
    rows = rows.select("id", "owner", F.xxhash64("text").alias("key"), F.concat(_found(assign, "assign", assigned), _found(access, "access", same), _found(_matches(text, hexes, text.rlike(hexes)), "hex", same)).alias("base"), _found(tokens, "owned", same).alias("more"))
    free = F.filter("more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("id", "owner", "key", F.concat("base", free).alias("found"))


def _live(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners <= OWNERS_MOST) & (n_repos <= n_owners * REPOS_AN_OWNER)


def ownership(exploded: DataFrame) -> DataFrame:
    """Repositories and owners of each value. Rows go to (value, owner, id) first, then counts to (value, owner) and to
    the value, so a value that a third of all rows hold never meets in one task."""
    each = exploded.select("value_hash", "owner", "id").distinct()
    owned = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owned.groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("id", "owner", "key", F.explode("found").alias("f")).select("id", "owner", "key", "f.*")


def scan(df: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """A row a row of df: id_col, `text_key` (xxhash64 of the text) and `spans` by start and kind, each with its value's
    hash, repositories, owners and whether it looks live.

    corpus: the documents that repositories and owners are counted over, for one that df is what is left of; a value
    that only df has counts as one of one owner. By default df itself.
    """
    held = cut(candidates(df, id_col, owner_col, text_col))
    exploded = _exploded(held)
    owned = ownership(exploded if corpus is None else _exploded(candidates(corpus, id_col, owner_col, text_col)))
    one = lambda c: F.coalesce(F.col(c), F.lit(1).cast("long")).alias(c)
    judged = exploded.drop("owner").join(owned, "value_hash", "left").select(*[c for c in exploded.columns if c != "owner"], one("n_repos"), one("n_owners"))
    judged = judged.withColumn("live", _live(F.col("n_owners"), F.col("n_repos")))
    judged = judged.where((F.col("kind") != "owned") | F.col("live"))
    kind_no = F.array_position(F.lit(KINDS), F.col("kind")).cast("int")
    spans = judged.groupBy(F.col("id").alias("span_id"), F.col("key").alias("span_key")).agg(F.array_sort(F.collect_set(F.struct("start", kind_no.alias("kind_no"), "kind", "end", "value_hash", "n_repos", "n_owners", "live"))).alias("spans"))
    rows = held.select("id", "key").join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left")
    return rows.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.coalesce("spans", _none(SPANS)).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", mark: str = "[SECRET]", corpus: DataFrame | None = None) -> DataFrame:
    """df, all rows and columns, with each live span of the text replaced by the mark; null text stays null. corpus: as
    for scan."""
    found = scan(df, id_col, owner_col, text_col, corpus).select(F.col(id_col).alias("found_id"), F.col("text_key").alias("found_key"), F.filter("spans", lambda s: s["live"]).alias("live"))
    found = found.where(F.size("live") > 0).dropDuplicates(["found_id", "found_key"])
    rows = boxed(df, id=F.col(id_col), key=F.xxhash64(whole(F.col(text_col))))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    text = F.col("row")[text_col]

    def walk(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        put = F.concat(done["text"], F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(mark))
        return F.struct(F.when(fresh, put).otherwise(done["text"]).alias("text"), F.greatest(done["at"], span["end"]).alias("at"))

    start = F.from_json(F.lit('{"text":"","at":0}'), "struct<text:string,at:int>")
    clean = F.aggregate("live", start, walk, lambda done: F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text))))
    new = F.when(F.col("live").isNull(), text).otherwise(clean)
    return joined.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


def report(df: DataFrame) -> DataFrame:
    """A row a document: counts by base kind, the digest of the base spans, all spans, how many look live, and the most
    repositories and owners of a value in it (0 without any)."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0).cast("long"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    return scan(df).select(
        "doc_id",
        *[n(kind) for kind in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        most("n_repos").alias("most_repos"),
        most("n_owners").alias("most_owners"),
    )


_AT = "list_transform(range(1, len({m}) + 1), lambda i: {{'kind': '{kind}', 's': list_sum(list_transform({b}[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform({m}[1:i-1], lambda x: len(x))), 0), 'm': {m}[i]}})"


def _sql() -> str:
    run = "[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST
    assign = ASSIGN.replace("'", "''")
    patterns = (("assign", assign), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("owned", run))
    columns = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, regexp_split_to_array(t, '{p}') AS b_{k}" for k, p in patterns)
    spans = ", ".join(f"{_AT.format(m=f'm_{k}', b=f'b_{k}', kind=k)} AS l_{k}" for k, _ in patterns)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id, source, {columns} FROM d),
l AS (SELECT r, doc_id, source, {spans} FROM m),
e AS (
  SELECT r, doc_id, source, u.kind AS kind, CAST(u.s AS BIGINT) AS s, CAST(u.s + len(u.m) AS BIGINT) AS e, u.m AS m
  FROM (SELECT r, doc_id, source, unnest(list_concat(list_concat(l_assign, l_access), list_concat(l_hex, l_owned))) AS u FROM l)
),
v AS (SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(m, '{assign}', 2) ELSE m END AS value FROM e),
base AS (SELECT * FROM v WHERE (kind = 'assign' AND len(value) >= {ASSIGN_LEAST}) OR (kind = 'access' AND len(m) >= {ACCESS_LEAST}) OR (kind = 'hex' AND len(m) >= {HEX_LEAST})),
more AS (
  SELECT * FROM v WHERE kind = 'owned' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = v.r AND b.s < v.e AND v.s < b.e)
),
f AS (SELECT * FROM base UNION ALL SELECT * FROM more),
o AS (SELECT value, count(DISTINCT coalesce('x' || source, '')) AS owners, count(DISTINCT (coalesce('x' || source, ''), coalesce('x' || doc_id, ''))) AS repos FROM f GROUP BY value),
j AS (SELECT * FROM (SELECT f.*, owners, repos, owners <= {OWNERS_MOST} AND repos <= owners * {REPOS_AN_OWNER} AS live, list_position({KINDS!r}, kind) AS k FROM f JOIN o USING (value)) WHERE kind <> 'owned' OR live),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind <> 'owned'), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, count(*) FILTER (live) AS n_live, max(repos) AS most_repos, max(owners) AS most_owners
  FROM j GROUP BY r
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
