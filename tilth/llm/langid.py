"""Language identification by interpolated Kneser-Ney character models, one a language.

Letters are lowered and everything between them is one blank, so digits, punctuation and markup say nothing. For each
language the n-grams of a sample of its labelled documents are counted in Spark; the highest order keeps its counts, lower
orders count the distinct letters before an n-gram, and each order is interpolated with the next lower one:

    p(c | h) = (count(hc) - D) / count(h) + D * kinds(h) / count(h) * p(c | shorter h),   D = n1 / (n1 + 2 n2)

down to an even distribution. What is stored of an order are its n-grams' hashes, sorted, with every language's log
probability of the last letter and the log weight that the n-gram as a history leaves to shorter ones. A text's letters
are looked up in those arrays, the longest n-gram first; the language of the lowest cross-entropy a letter is chosen.

The score is the chance that the choice is right: a logistic function of the lead over the second language and of the
length, fitted on documents and short passages of the sample that the models so calibrated had not seen. A choice is
rejected where the score is under the least one at which the calibration's choices above it are right often enough, or
where no language knows the text's letters: its cross-entropy is over what the calibration saw of that language.

The sample is bounded: `rows_a_language` documents of each language, by hash of id, none over `most_chars` characters.

Defined cases: null text or text without a letter is `und` with score 0, and so is every text if nothing could be learnt;
equal cross-entropies go to the language first by name. Very long texts are read whole. Rows that repeat an id each give a
row; a null id is learnt from. A language all of whose documents are over the bound is not learnt. An empty table gives no
rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm.common import boxed, unused
from tilth.llm.grams import mix

ORDER = 5
ROWS_A_LANGUAGE, MOST_CHARS = 1500, 20_000
#: Of the sample one document in so many calibrates; and the lengths of the passages that it is cut into.
CALIBRATED, PASSAGES = 5, (10, 20, 40, 80)
#: Share of right choices above the score from which on a choice is not rejected.
WANTED = 0.99
UNKNOWN = "und"
BLANK = 32
#: Characters that are read together.
CHUNK = 1 << 18
#: Odd factors of an n-gram's letters, from the last one back, and what a hash starts from.
_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, 17, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _folded() -> np.ndarray:
    """The lowered code point of each letter, 0 of all else."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a blank before each word and after each text's last, and how many each text has: 0
    without a letter."""
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") + 2 for t in texts])
    points = _folded()[raw]
    is_letter = points > 0
    first = np.zeros(len(raw), bool)
    first[np.concatenate([[0], ends[:-1]]).astype(int)] = len(raw) > 0
    # a blank stays where it starts a text or follows a letter
    kept = is_letter | first
    kept[1:] |= ~is_letter[1:] & is_letter[:-1]
    points[~is_letter] = BLANK
    counts = np.diff(np.concatenate([[0], np.cumsum(kept)[ends - 1]])) if len(texts) else np.zeros(0, np.int64)
    points = points[kept]
    lone = counts == 1  # only the blank before
    if lone.any():
        points = points[~np.repeat(lone, counts)]
        counts = np.where(lone, 0, counts)
    return points, counts.astype(np.int64)


def _key(grams: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the last `length` code points. grams: a row an n-gram, its last letter in the last column."""
    total = np.full(len(grams), _ODD[-1], np.uint64)
    for back in range(length):
        total += grams[:, -1 - back].astype(np.uint64) * _ODD[back]
    return mix(total)


def _keys_at(points: np.ndarray, place: np.ndarray, at: np.ndarray | None, length: int) -> np.ndarray:
    """The same of the n-grams that end at each point, or at some; before a text's first there are zeros."""
    if at is None:
        total = np.full(len(points), _ODD[-1], np.uint64)
        early = np.flatnonzero(place < length - 1)
        for back in range(length):
            total[back:] += points[: len(points) - back] * _ODD[back]
        total[early] = _ODD[-1]
        for back in range(length):
            on = early[place[early] >= back]
            total[on] += points[on - back] * _ODD[back]
    else:
        total = np.full(len(at), _ODD[-1], np.uint64)
        for back in range(length):
            total += np.where(place[at] >= back, points[at - back], 0).astype(np.uint64) * _ODD[back]
    return mix(total)


def _places(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Table:
    """Sorted hashes of one order, with a start for each value of their top bits; logs and left: a row a hash."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, left: np.ndarray) -> None:
        self.keys, self.logs, self.left = keys, logs, left
        bits = len(keys).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for none."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        at = self.starts[wanted >> self.shift]
        np.minimum(at, len(self.keys) - 1, out=at)
        held = self.keys[at]
        hit = held == wanted
        out[hit] = at[hit]
        rest = np.flatnonzero(held < wanted)  # sorted, so what is not yet passed may come next
        while len(rest):
            at[rest] += 1
            rest = rest[at[rest] < len(self.keys)]
            held = self.keys[at[rest]]
            hit = held == wanted[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[held < wanted[rest]]
        return out


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def _before(grams: np.ndarray) -> np.ndarray:
    """The n-grams moved back by a letter: what stands last is the history's last."""
    return np.roll(grams, 1, axis=1)


class Models:
    """All languages' models, as tables by order."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray], order: int = ORDER) -> None:
        """grams, counts: of each language its distinct n-grams (code points, a row each) and how often they occur."""
        self.languages, self.order = languages, order
        self.tables: list[Table] = []
        if not languages:
            return
        levels: list[list] = [[] for _ in range(order)]
        known = {int(x) for g in grams for x in np.unique(g[:, -1])}
        self.even = -math.log(len(known) + 1)
        for own, n in zip(grams, counts):
            for length in range(order, 0, -1):
                if length < order:  # distinct letters before
                    keys = _key(own, length)
                    _, first, n = np.unique(keys, return_index=True, return_counts=True)
                    own = own[first]
                levels[length - 1].append((own, n))
        below: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys and probabilities of the order below, by language
        for length in range(1, order + 1):
            parts, nearer = [], []
            for l, (own, n) in enumerate(levels[length - 1]):
                d = _discount(n)
                history = _key(_before(own), length - 1) if length > 1 else np.zeros(len(own), np.uint64)
                _, group = np.unique(history, return_inverse=True)
                total, kinds = np.bincount(group, n), np.bincount(group)
                gamma = d * kinds / total
                if length == 1:
                    lower = np.full(len(own), math.exp(self.even))
                else:
                    lower = below[l][1][np.searchsorted(below[l][0], _key(own, length - 1))]
                p = (n - d) / total[group] + gamma[group] * lower
                keys = _key(own, length)
                by = np.argsort(keys)
                nearer.append((keys[by], p[by]))
                # a history of this order's n-grams is an n-gram of one letter less, by its own hash
                h_keys, h_at = np.unique(history, return_index=True)
                parts.append((keys[by], np.log(p[by]), h_keys, np.log(gamma[group[h_at]])))
            self._add(parts, length, [own for own, _ in levels[length - 1]])
            below = nearer

    def _add(self, parts: list[tuple], length: int, every: list[np.ndarray]) -> None:
        """The table of an order. Where a language lacks an n-gram that another has, it stands with the probability that
        the language's shorter ones give, so a hit is good for all of them."""
        width = len(self.languages)
        if length == 1:
            self.root_left = np.array([gamma[0] for *_, gamma in parts])
            self.start_left = np.zeros(width)
        else:  # what a history leaves to shorter ones goes with the history, one order below
            table = self.tables[-1]
            for l, (_, _, h_keys, gamma) in enumerate(parts):
                at = table.find(h_keys)
                table.left[at[at >= 0], l] = gamma[at >= 0]
                if length == 2 and (at < 0).any():  # a text's first has no history
                    self.start_left[l] = gamma[at < 0][0]
        own = np.concatenate(every)
        keys, first = np.unique(_key(own, length), return_index=True)
        own = own[first]
        logs = np.full((len(keys), width), np.nan)
        for l, (known, log_p, _, _) in enumerate(parts):
            logs[np.searchsorted(keys, known), l] = log_p
        if length == 1:
            shorter = np.broadcast_to(self.root_left + self.even, logs.shape)
        else:
            table = self.tables[-1]
            at = table.find(_key(_before(own), length - 1))
            left = np.where((at >= 0)[:, None], table.left[at], self.start_left if length == 2 else 0.0)
            shorter = left + table.logs[table.find(_key(own, length - 1))]
        self.tables.append(Table(keys, np.where(np.isnan(logs), shorter, logs), np.zeros((len(keys), width))))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters and blanks, cross-entropy by language) of each text."""
        points, counts = letters(texts)
        points = points.astype(np.uint64)
        if not len(points):
            return counts, np.zeros((len(texts), len(self.languages)))
        place = _places(counts)
        found = self.tables[-1].find(_keys_at(points, place, None, self.order))
        total = self.tables[-1].logs[found]
        rest = np.flatnonzero(found < 0)
        total[rest] = 0.0
        for length in range(self.order, 0, -1):  # those whose n-gram of this length no language has
            total[rest] += self._left(points, place, rest, length)
            if length == 1:
                total[rest] += self.even
                break
            at = self.tables[length - 2].find(_keys_at(points, place, rest, length - 1))
            total[rest[at >= 0]] += self.tables[length - 2].logs[at[at >= 0]]
            rest = rest[at < 0]
            if not len(rest):
                break
        starts = (np.cumsum(counts) - counts)[counts > 0]
        sums = np.zeros((len(texts), len(self.languages)))
        sums[counts > 0] = np.add.reduceat(total, starts, axis=0)
        return counts, -sums / np.maximum(counts, 1)[:, None]

    def _left(self, points: np.ndarray, place: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
        """The log weight that the history of length - 1 letters leaves to shorter ones."""
        if length == 1:
            return np.broadcast_to(self.root_left, (len(rest), len(self.languages)))
        out = np.zeros((len(rest), len(self.languages)))
        inside = np.flatnonzero(place[rest] > 0)
        table = self.tables[length - 2]
        at = table.find(_keys_at(points, place, rest[inside] - 1, length - 1))
        out[inside[at >= 0]] = table.left[at[at >= 0]]
        if length == 2:
            out[place[rest] == 0] = self.start_left
        return out


class Identifier:
    """Models with their calibration."""

    def __init__(self, models: Models, weights: np.ndarray, least: float, ceiling: np.ndarray) -> None:
        self.models, self.weights, self.least, self.ceiling = models, weights, least, ceiling

    def choose(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, cross-entropy) of each text."""
        if not self.models.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        counts, entropy = self.models.entropies(texts)
        best, lead = led(entropy)
        score = np.where(counts > 0, 1 / (1 + np.exp(-np.clip(features(counts, lead) @ self.weights, -35, 35))), 0.0)
        lowest = entropy[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        rejected = (counts == 0) | (score < self.least) | (lowest > self.ceiling[best])
        names = [self.models.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist())]
        return names, score, rejected, lowest


def led(entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of the lowest cross-entropy and its lead over the second."""
    best = entropy.argmin(axis=1) if len(entropy) else np.zeros(0, int)
    if entropy.shape[1] < 2:
        return best, np.ones(len(entropy))
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return best, two[:, 1] - two[:, 0]


def features(counts: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(counts)), np.log1p(np.maximum(counts, 0) * lead), lead, np.log1p(counts)], 1)


def logistic(x: np.ndarray, right: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic function by Newton steps; the ridge leaves the constant alone."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (right - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(df: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows_a_language: int, most_chars: int) -> DataFrame:
    """text, lang and part (0 to CALIBRATED - 1) of the labelled documents to learn from."""
    text = F.col(text_col).cast("string")
    able = df.where(F.coalesce(learn, F.lit(True)) & F.col(lang_col).isNotNull() & (F.length(text) <= most_chars))
    able = able.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("hash"))
    shares = {r.lang: min(1.0, 2.0 * rows_a_language / r.n) for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not shares:
        return able.select("text", "lang", F.lit(0).alias("part"))
    # a hash under the language's share first, so that what is sorted is bounded
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    few = able.where((F.col("hash").cast("double") / 2.0**63 + 1) / 2 <= share)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return few.withColumn("number", number).where(F.col("number") <= rows_a_language).select("text", "lang", (F.col("number") % CALIBRATED).cast("int").alias("part"))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def counted(drawn: DataFrame, order: int) -> DataFrame:
    """lang, calibrates, gram (code points, packed) and n of the sample's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            lang = part.column(1).to_pylist()
            for own in sorted({*zip(lang, part.column(2).to_pylist())}):
                texts = [t for t, *key in zip(part.column(0).to_pylist(), lang, part.column(2).to_pylist()) if tuple(key) == own]
                points, counts = letters(texts)
                place = _places(counts)
                rows = np.zeros((len(points), order), "<u4")
                for back in range(order):
                    rows[back:, order - 1 - back] = points[: len(points) - back]
                    rows[place < back, order - 1 - back] = 0
                grams, n = np.unique(rows.view(f"V{4 * order}").ravel() if len(rows) else np.zeros(0, f"V{4 * order}"), return_counts=True)
                size = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[0]] * size, pa.string()), pa.array([own[1]] * size, pa.bool_()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n, pa.int64())],
                    names=["lang", "calibrates", "gram", "n"],
                )

    each = drawn.select("text", "lang", (F.col("part") == 0).alias("calibrates")).mapInArrow(run, "lang string, calibrates boolean, gram binary, n long")
    return each.groupBy("lang", "calibrates", "gram").agg(F.sum("n").alias("n"))


def _models(languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray, order: int) -> Models:
    parts, counts = [], []
    for k in range(len(languages)):
        own = grams[lang == k]
        keys, group = np.unique(_key(own, order), return_inverse=True)
        first = np.full(len(keys), -1)
        first[group[::-1]] = np.arange(len(own))[::-1]
        parts.append(own[first])
        counts.append(np.bincount(group, n[lang == k]).astype(np.int64))
    return Models(languages, parts, counts, order)


def passages(text: str) -> list[str]:
    """The text, and its first passages of each length that start at a word."""
    words, out = text.split(), [text]
    for size in PASSAGES:
        held: list[str] = []
        for w in words[len(out) :]:
            held.append(w)
            if sum(map(len, held)) + len(held) >= size:
                break
        if held:
            out.append(" ".join(held))
    return out


def calibrated(models: Models, drawn: DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, least score, highest cross-entropy by language) on the sample's calibrating documents."""
    sent = drawn.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            rows = []
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                given = passages(text)
                counts, entropy = sent.value.entropies(given)
                best, lead = led(entropy)
                own = sent.value.languages.index(lang)
                rows += [(int(n), float(d), own, int(b), float(e[b]), k == 0) for k, (n, d, b, e) in enumerate(zip(counts, lead, best, entropy)) if n]
            columns = [*zip(*rows)] if rows else [[]] * 6
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n", "lead", "lang", "best", "entropy", "entire"])

    seen = drawn.where("part = 0").select("text", "lang").mapInArrow(run, "n long, lead double, lang int, best int, entropy double, entire boolean").toPandas()  # five rows a document
    seen = seen.sort_values(list(seen.columns))
    x = features(seen["n"].to_numpy(), seen["lead"].to_numpy())
    right = (seen["lang"] == seen["best"]).to_numpy().astype(float)
    # two made-up ties, one right and one wrong, so that no lead is never certain
    x, right = np.concatenate([x, features(np.array([1, 1]), np.zeros(2))]), np.concatenate([right, [0.0, 1.0]])
    weights = logistic(x, right)
    score = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
    by = np.argsort(-score, kind="stable")
    kept = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= WANTED)
    least = float(score[by[kept[-1]]]) if len(kept) else 1.0
    ceiling = np.full(len(models.languages), np.inf)
    for k in range(len(ceiling)):
        own = seen[(seen["best"] == k) & (seen["lang"] == k)]["entropy"].to_numpy()
        if len(own) > 1:
            ceiling[k] = own.mean() + 6 * own.std()
    return weights, least, ceiling


def fit(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows_a_language: int = ROWS_A_LANGUAGE, most_chars: int = MOST_CHARS
) -> Identifier:
    """Learns from rows of df with a language, where learn is true or null."""
    drawn = sample(df, learn, id_col, text_col, lang_col, rows_a_language, most_chars).persist()
    try:
        # bounded by the sample's characters
        held = counted(drawn, order).toArrow()
        names = held.column("lang").to_pylist()
        languages = sorted(set(names))
        if not languages:
            return Identifier(Models([], [], [], order), np.zeros(4), 1.0, np.zeros(0))
        number = {name: k for k, name in enumerate(languages)}
        lang, n = np.array([number[x] for x in names]), held.column("n").to_numpy()
        grams = np.frombuffer(b"".join(held.column("gram").to_pylist()), "<u4").reshape(-1, order)
        calibrates = held.column("calibrates").to_numpy().astype(bool)
        by = np.lexsort((*grams.T, calibrates, lang))  # rows come in any order
        lang, n, grams, calibrates = lang[by], n[by], grams[by], calibrates[by]
        models = _models(languages, lang, grams, n, order)
        taught = np.isin(np.arange(len(languages)), lang[~calibrates])
        if not taught.all() or not calibrates.any():  # too few rows to hold some out
            return Identifier(models, np.array([0.0, 1.0, 0.0, 0.0]), 0.0, np.full(len(languages), np.inf))
        first = _models(languages, lang[~calibrates], grams[~calibrates], n[~calibrates], order)
        return Identifier(models, *calibrated(first, drawn))
    finally:
        drawn.unpersist()


def identify(df: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score, rejected and cross_entropy (nats a letter; null without a letter). Columns of those names
    are replaced."""
    added = ["lang_pred", "score", "rejected", "cross_entropy"]
    kept = df.drop(*added)
    box = unused(kept, "row")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            texts, start, chosen = part.column(1).to_pylist(), 0, []
            while start < len(texts):  # stretches of so many characters, or one text
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHUNK):
                    size += len(texts[stop] or "")
                    stop += 1
                chosen.append(sent.value.choose(texts[start:stop]))
                start = stop
            names = [x for c in chosen for x in c[0]]
            score, rejected, entropy = (np.concatenate([c[k] for c in chosen]) for k in (1, 2, 3))
            lost = np.array([x == UNKNOWN for x in names], bool)
            columns = [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64(), mask=lost)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *added])

    rows = boxed(kept, text=F.col(text_col).cast("string")).select(F.col("row").alias(box), "text")
    kind = rows.schema[box].dataType.simpleString()
    out = rows.select(F.col(box).alias("row"), "text").mapInArrow(run, f"row {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")
    return out.select("row.*", *added)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and cross_entropy of every document."""
    model = fit(docs, ~held_out())
    told = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")
