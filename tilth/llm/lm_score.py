"""Language-model scoring by a weighted backoff automaton over word n-grams.

States are the n-grams seen in training, up to order - 1 words; from a state an arc leads over each word that followed
it, and a failure arc leads to the state without its first word. Smoothing weighs both: with c(h) the count of a state
and a(h) = MASS * c(h) ** POWER the share kept for what has not followed it,

    arc:     p(w | h) = (c(hw) + a(h) * p(w | shorter h)) / (c(h) + a(h))
    failure: a(h) / (c(h) + a(h)) * p(w | shorter h)

and in the root every word, known or not, has (c(w) + 1) / (N + V + 1). The probabilities of each state add up to 1. A
text is read once from left to right from the start state; its end is a word too.

The corpus has far more n-grams than a task can hold, so the automaton is never in one place: documents go to blocks of
a few megabytes, each block sends its distinct n-grams with their training counts to shards, gets back the corpus-wide
counts of just those, builds the part of the automaton that its texts can reach and walks them through it. Nothing is
cut off by count or rank. N-grams go by hashes whose length grows with the corpus, so that one in 2 ** SPARE at most
shares its hash with another, at every size.

Defined cases: null text is the empty text, of one token (its end). A very long text is walked whole, in stretches side
by side; its block is as large as it. Rows that repeat an id each count and each give a row, and equal texts get equal
scores. A null id is learnt from. Without learning rows every word has the same probability 1. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm import grams
from tilth.llm.common import whole

MASS, POWER = 0.8, 0.8
ORDER = 3
SPARE = 18
#: Bytes of text in a block, which one task holds at a time, and blocks' worth of text a shard.
BLOCK_BYTES, BLOCKS_A_SHARD = 6 << 20, 2
#: Tokens of a text that one lane of the walk reads.
STRETCH = 256
START, END = (np.array([x], np.uint64) for x in (0x5374617274, 0x456E64))


class Reading:
    """The tokens of some texts, and the distinct n-grams that end at each (`at`, by level; not of use to who only
    counts, and left out for them)."""

    def __init__(self, texts: list[str | None], order: int, bits: int = 64, places: bool = True) -> None:
        words, counts = grams.word_hashes(texts)
        self.first = np.concatenate([[0], np.cumsum(counts + 1)])[:-1].astype(np.int64)
        self.size = counts + 1
        n = int(self.size.sum())
        last = self.first + counts
        tokens = np.empty(n, np.uint64)
        is_end = np.zeros(n, bool)
        is_end[last] = True
        tokens[~is_end], tokens[is_end] = words, END[0]
        shift, one = np.uint64(64 - bits), np.uint64(1)
        self.place = np.arange(n) - np.repeat(self.first, self.size)  # in its text
        # the lowest bit marks single words
        every = np.empty(n * order + 1, np.uint64)
        every[:n] = (grams.joined([tokens]) >> shift) | one
        every[-1:] = (grams.joined([END]) >> shift) | one
        before = [tokens]
        for level in range(2, order + 1):
            shifted = np.empty(n, np.uint64)
            back = level - 1
            shifted[back:] = tokens[:-back] if n > back else tokens[:0]
            shifted[: min(back, n)] = START[0]
            shifted[self.place == back - 1] = START[0]
            before.insert(0, shifted)
            # the start state is one word before the first
            every[(level - 1) * n : level * n] = np.where(self.seen(level), (grams.joined(before) >> shift) & ~one, np.uint64(0))
        del before, tokens
        self.order = order
        if not places:
            self.every = every
            return
        self.keys, at = np.unique(every, return_inverse=True)
        del every
        at = at.astype(np.int32)
        self.at = [at[k * n : (k + 1) * n] for k in range(order)]
        self.end_at = int(at[-1])

    def seen(self, level: int) -> np.ndarray:
        """Whether so many words, with the start as one, end at each token."""
        return self.place >= level - 2

    def counted(self, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, and how often each ends at a token of a learnt text."""
        weight = np.repeat(learnt, self.size)
        taught = np.concatenate([weight & self.seen(level) for level in range(1, self.order + 1)] + [[False]])
        known, every = np.sort(self.every[taught]), np.sort(self.every)
        keys = every[np.concatenate([[True], every[1:] != every[:-1]])]
        starts = np.searchsorted(known, keys)  # both sorted, so this walks along them
        return keys, np.diff(np.append(starts, len(known)))


class Automaton:
    """The states, arcs and failure arcs that a reading's texts can reach.

    A state is the number of its n-gram's key; the root and the start state come after all keys. Arcs are sorted by
    state and word. count: of each key in the corpus; n, v: all training tokens, distinct ones.
    """

    def __init__(self, read: Reading, count: np.ndarray, n: int, v: int) -> None:
        size, order = len(read.keys), len(read.at)
        self.root, start, self.width = size, size + 1, size + 2
        held = np.concatenate([count, [0, count[read.end_at]]]).astype(float)  # as many texts start as end
        kept = MASS * held**POWER
        self.fail = np.full(self.width, self.root, np.int32)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail_weight = np.where(held > 0, np.log10(kept / (held + kept)), 0.0)
        self.first_state = start if order > 1 and held[start] > 0 else self.root
        below = (count + 1) / (n + v + 1)  # p(w | root) at each single word's key
        self.root_weight = np.log10(below)
        self.root_target = np.where((count > 0) & (order > 1), np.arange(size), self.root).astype(np.int32)
        states, words, weights, targets = [], [], [], []
        for level in range(2, order + 1):
            own, shorter = read.at[level - 1], read.at[level - 2]
            ends = np.flatnonzero(read.seen(level))
            first = np.full(size, -1, np.int64)  # one place of each n-gram
            first[own[ends]] = ends
            ends = first[(first >= 0) & (count > 0)]
            key, suffix = own[ends], shorter[ends]
            state = shorter[ends - 1] if level > 2 else np.where(read.place[ends] > 0, shorter[ends - 1], start)
            p = (count[key] + kept[state] * below[suffix]) / (held[state] + kept[state])
            states.append(state.astype(np.int64))
            words.append(read.at[0][ends])
            weights.append(np.log10(p))
            if level < order:
                self.fail[key] = suffix
                targets.append(key)
            else:
                targets.append(suffix)
            below = below.copy()
            below[key] = p
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        arcs = joined(states, np.int64) * self.width + joined(words, np.int64)
        by = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[by], joined(weights, float)[by], joined(targets, np.int32)[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of each lane: failure arcs are taken until the state has an arc of the word."""
        score, after = np.zeros(len(state)), np.empty(len(state), np.int32)
        lanes, state = np.arange(len(state)), state.astype(np.int64)
        while len(lanes):
            at_root = state == self.root
            if at_root.any():
                done, w = lanes[at_root], word[lanes[at_root]]
                score[done] += self.root_weight[w]
                after[done] = self.root_target[w]
                lanes, state = lanes[~at_root], state[~at_root]
            if not len(lanes):
                break
            wanted = state * self.width + word[lanes]
            by = np.argsort(wanted)  # so that the search walks along the arcs
            place = np.empty(len(lanes), np.int64)
            place[by] = np.searchsorted(self.arcs, wanted[by])
            place[place == len(self.arcs)] = 0
            hit = self.arcs[place] == wanted if len(self.arcs) else np.zeros(len(lanes), bool)
            done = lanes[hit]
            score[done] += self.weight[place[hit]]
            after[done] = self.target[place[hit]]
            lanes, state = lanes[~hit], state[~hit]
            score[lanes] += self.fail_weight[state]
            state = self.fail[state].astype(np.int64)
        return after, score

    def walk(self, read: Reading) -> np.ndarray:
        """The score of each text. Texts are read side by side, a word a step; of a long text the later stretches start
        order - 1 words early in the root, for those words alone make the state."""
        early = len(read.at) - 1
        pieces = -(-read.size // STRETCH)
        text = np.repeat(np.arange(len(read.size)), pieces)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.minimum(early, piece * STRETCH)
        begin = read.first[text] + piece * STRETCH - warm
        length = np.minimum(read.size[text] - piece * STRETCH, STRETCH) + warm
        by = np.argsort(-length, kind="stable")
        text, warm, begin, length = text[by], warm[by], begin[by], length[by]
        state = np.where(begin == read.first[text], self.first_state, self.root).astype(np.int32)
        total = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            lanes = int(np.searchsorted(-length, -t, side="left"))
            state[:lanes], score = self.step(state[:lanes], read.at[0][begin[:lanes] + t])
            total[:lanes] += np.where(t >= warm[:lanes], score, 0.0)
        # in the order of the stretches, so that equal texts have equal sums
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return np.bincount(text[place], total[place], minlength=len(read.size))


def _summed(arrays: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Corpus-wide counts in each array's order, and the tokens and distinct words among them."""
    totals = grams.add_up(arrays, counts)
    words = [(a & np.uint64(1)) == 1 for a in arrays]
    every, first = np.unique(np.concatenate([a[w] for a, w in zip(arrays, words)]), return_index=True)
    total = np.concatenate([t[w] for t, w in zip(totals, words)])[first]
    return totals, int(total.sum()), int((total > 0).sum())


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a row of df: id_col, learnt, n_tokens, n_known, train_tokens, base_score and score (log10).

    learn: whether a row's text teaches the model; null counts as true.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(True)).alias("learnt"), whole(F.col(text_col)).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    shards = max(1, -(-blocks // BLOCKS_A_SHARD))
    bits = grams.bits_for(total, SPARE)
    rows = grams.dealt(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), "block", blocks)

    def gather(docs: pa.Table) -> pa.Table:
        read = Reading(docs.column("text").to_pylist(), order, bits, places=False)
        keys, counts = read.counted(docs.column("learnt").to_numpy(zero_copy_only=False).astype(bool))
        parts = {s: (a, b) for s, a, b in grams.shards_of(keys, shards, bits)}
        spans = [parts.get(s, (0, 0)) for s in range(shards)]  # every shard hears of every block, to answer with its totals
        return pa.table(
            {
                "shard": pa.array(range(shards), pa.int32()),
                "block": pa.array([docs.column("block")[0].as_py()] * shards, pa.int32()),
                "keys": pa.array([grams.pack(keys[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([grams.pack_counts(counts[a:b]) for a, b in spans], pa.binary()),
            }
        )

    def answer(shard: pa.Table) -> pa.Table:
        totals, n, v = _summed([grams.unpack(x.as_py()) for x in shard.column("keys")], [grams.unpack_counts(x.as_py()) for x in shard.column("counts")])
        size = len(totals)
        return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "totals": pa.array([grams.pack_counts(t) for t in totals], pa.binary()), "n": pa.array([n] * size, pa.int64()), "v": pa.array([v] * size, pa.int64())})

    def walk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        read = Reading(docs.column("text").to_pylist(), order, bits)
        parts = sorted(zip(answers.column("shard").to_pylist(), answers.column("totals").to_pylist()))
        n, v = sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())
        count = np.concatenate([grams.unpack_counts(x) for _, x in parts])
        automaton = Automaton(read, count, n, v)
        sums = lambda x: np.add.reduceat(x, read.first) if len(read.first) else np.zeros(0)
        known, base = sums((count[read.at[0]] > 0).astype(np.int64)), sums(automaton.root_weight[read.at[0]])
        return pa.table({id_col: docs.column("id"), "learnt": docs.column("learnt"), "n_tokens": pa.array(read.size.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array([n] * docs.num_rows, pa.int64()), "base_score": pa.array(base.astype(float)), "score": pa.array(automaton.walk(read))})

    sent = rows.groupBy("block").applyInArrow(gather, "shard int, block int, keys binary, counts binary")
    answers = grams.dealt(sent, "shard", shards).groupBy("shard").applyInArrow(answer, "block int, shard int, totals binary, n long, v long")
    return rows.groupBy("block").cogroup(grams.dealt(answers, "block", blocks).groupBy("block")).applyInArrow(walk, f"{id_col} long, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(df: DataFrame) -> DataFrame:
    """A row a document, held-out ones (crc32 of the id mod 7 is 2) scored by what the others taught."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = score(df, ~held_out)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
