"""Byte-level BPE encoding and decoding.

Pre-tokenisation reads no regex at run time. Each code point becomes a symbol (letter, number, other, white space by
what follows it, apostrophe that opens a contraction), and a nine-state machine says where pieces start. The machine
runs as an associative scan: the codes of a chunk are cut into equal lanes, every lane composes its transition
function from all start states at once, the lane functions are chained, and a second pass with known start states
emits the boundaries. The slices go through a bounded cache of merged pieces.

Null text encodes as the empty text: no ids. Repeated rows are encoded each for itself; row order is free.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm.common import small_batches

#: Symbols. A white-space character is LAST_* if a non-space follows it in the same text.
DOC, LETTER, NUMBER, OTHER, LAST_SPACE, LAST_WHITE, WHITE, APOS_1, APOS_2 = range(9)
#: States: what the piece that is open takes next.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, PENDING, WANT_1, WANT_2, CLOSED = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(state, symbol) -> next state, and whether a piece starts at the symbol."""
    step, starts = np.zeros((9, 9), np.intp), np.ones((9, 9), bool)
    step[:, LETTER], step[:, NUMBER], step[:, OTHER], step[:, WHITE] = IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE
    step[:, LAST_SPACE], step[:, LAST_WHITE], step[:, DOC] = PENDING, CLOSED, FRESH
    step[:, APOS_1], step[:, APOS_2] = WANT_1, WANT_2
    for state, symbol in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHER, OTHER), (IN_WHITE, WHITE), (PENDING, LETTER), (PENDING, NUMBER), (PENDING, OTHER)):
        starts[state, symbol] = False
    for state in (IN_OTHER, PENDING):  # inside a run of others an apostrophe is one of them
        for symbol in (APOS_1, APOS_2):
            step[state, symbol], starts[state, symbol] = IN_OTHER, False
    step[WANT_2, LETTER], starts[WANT_2, LETTER] = WANT_1, False
    step[WANT_1, LETTER], starts[WANT_1, LETTER] = CLOSED, False
    return step, starts


STEP, STARTS = _machine()
RESETS = (STEP == STEP[0]).all(0)
NEVER = 1 << 60  # the rank of a pair that does not merge
SEPARATOR = 0x110000  # no code point: stands between texts
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point, as the tokenizer library itself tells them apart."""
    if not _CLASSES:
        import tiktoken

        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(SEPARATOR + 1, OTHER, np.uint8)
        for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            matched = b"".join(probe.decode_tokens_bytes(probe.encode_ordinary(points))).decode()
            table[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = code
        table[SEPARATOR] = DOC
        _CLASSES.append(table)
    return _CLASSES[0]


def symbols(codes: np.ndarray) -> np.ndarray:
    """codes: uint32 code points with SEPARATOR after each text."""
    out = classes()[codes]
    after = np.empty_like(out)
    after[:-1], after[-1] = out[1:], DOC
    last = (out == WHITE) & (after != WHITE) & (after != DOC)
    out[last] = np.where(codes[last] == 0x20, LAST_SPACE, LAST_WHITE)
    at = np.flatnonzero(codes == 0x27)
    if at.size:
        padded = np.append(codes, [SEPARATOR, SEPARATOR])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS_1
        for a, b in ("re", "ve", "ll"):
            out[at[(one == ord(a)) & (two == ord(b))]] = APOS_2
    return out


def starts(codes: np.ndarray, lane: int = 512) -> np.ndarray:
    """Whether a piece starts at each code; separators start one of their own."""
    n = len(codes)
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, DOC, np.uint8)
    grid[:n] = symbols(codes)
    rows = np.ascontiguousarray(grid.reshape(lanes, lane).T)  # step j of all lanes lies together
    step, start = STEP.ravel(), STARTS.ravel()
    ends = np.full(lanes, FRESH, np.intp)
    for row in rows:
        ends = step.take(ends * 9 + row)
    ends = ends.astype(np.intp)
    # A lane that holds a symbol which sends every state to the same one has a constant function, and that is its value.
    open_ = np.flatnonzero(~RESETS[grid].reshape(lanes, lane).any(1))
    maps = np.repeat(np.arange(9)[:, None], len(open_), 1)
    if len(open_):
        for row in rows[:, open_]:  # the others' functions from start state to end state
            maps = step.take(maps * 9 + row)
    entry = np.concatenate([[FRESH], ends[:-1]])
    for k, lane_ in enumerate(open_.tolist()):
        if lane_ + 1 < lanes:
            entry[lane_ + 1] = maps[entry[lane_], k]
    out = np.empty((lane, lanes), bool)
    for j, row in enumerate(rows):
        at = entry * 9 + row
        out[j] = start.take(at)
        entry = step.take(at)
    return out.T.reshape(-1)[:n]


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The pieces of each text."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes[ends] = SEPARATOR
    bounds = np.flatnonzero(starts(codes))
    cut = np.searchsorted(bounds, ends)
    bounds, first = bounds.tolist(), 0
    for upto in cut.tolist():
        yield [joined[a:b] for a, b in zip(bounds[first:upto], bounds[first + 1 : upto + 1])]
        first = upto + 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The content of a rank file: base64 of a token and its rank, a line each."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the part from i ends at end[i]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of its parts has grown or gone
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merged:
    """Piece -> its ids as packed int32, for up to so many pieces at a time.

    The pieces of a chunk that are new are merged together: each round merges the lowest pair of every piece that has
    one, and only the two pairs beside a merge are looked up anew.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000) -> None:
        self.ranks, self.most, self.known = ranks, most, {}
        pairs = {(left << 32) | right: rank for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for chunk in in_chunks(texts):
            slices = list(pieces(chunk))
            new = set().union(*slices) - self.known.keys()
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = set().union(*slices)
            self.learn(list(new))
            get = self.known.__getitem__
            for own in slices:
                yield b"".join(map(get, own))

    def learn(self, new: list[str]) -> None:
        data = [x.encode() for x in new]
        for piece, raw in zip(new, data):
            if len(raw) > 64:
                self.known[piece] = np.array(merge(raw, self.ranks), np.int32).tobytes()
            elif (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
        rest = [(piece, raw) for piece, raw in zip(new, data) if piece not in self.known]
        if rest:
            ids, ends = self.merge_all([raw for _, raw in rest])
            buffer, at = ids.astype("<i4").tobytes(), 0
            for (piece, _), end in zip(rest, ends.tolist()):
                self.known[piece] = buffer[at : 4 * end]
                at = 4 * end

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def merge_all(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids one after another, and where each piece ends."""
        size = np.array([len(x) for x in data])
        ids = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        owner = np.repeat(np.arange(len(data)), size)
        inside = owner[:-1] == owner[1:]
        rank = np.full(len(ids), NEVER)
        rank[:-1][inside] = self.rank(ids[:-1][inside], ids[1:][inside])
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(ids)))
            over = np.repeat(low == NEVER, count)
            if over.any():  # their pieces have no pair left
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                continue
            hits = np.flatnonzero(rank == np.repeat(low, count))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]  # the leftmost of equals
            ids[hits] = low
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            hits = hits - np.arange(len(hits))  # each earlier piece has lost one part
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[hits] = NEVER
            after = hits[hits + 1 < len(ids)]
            after = after[owner[after] == owner[after + 1]]
            rank[after] = self.rank(ids[after], ids[after + 1])
            before = hits[hits > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            rank[before] = self.rank(ids[before], ids[before + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(data)), side="right")


def in_chunks(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Lists of whole texts of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(df: DataFrame, ranks_file: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """df with ids_col array<int>, and offsets_col array<int> (the byte at which each token starts) if named.

    ranks_file is read on the driver; its content (under a megabyte) goes to the tasks. A column that df already has
    under an output's name is replaced.
    """
    with open(ranks_file, "rb") as file:
        content = file.read()
    df = small_batches(df.drop(*[c for c in (ids_col, offsets_col) if c]))
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), *([T.StructField(offsets_col, T.ArrayType(T.IntegerType(), False))] if offsets_col else [])])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(content)
        length = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            length[rank] = len(token)
        merged = Merged(ranks)
        for batch in batches:
            packed = list(merged.packed(batch.column(place).cast(pa.string()).fill_null("").to_pylist()))
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = np.frombuffer(b"".join(packed), np.int32)
            out = _with(batch, ids_col, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            if offsets_col:
                sizes = length[ids]
                at = np.cumsum(sizes) - sizes
                base = np.append(at, 0)[ends[:-1]] if len(ids) else np.zeros(len(ends) - 1, np.int64)
                at = (at - np.repeat(base, np.diff(ends))).astype(np.int32)
                out = _with(out, offsets_col, pa.ListArray.from_arrays(pa.array(ends), pa.array(at)))
            yield out

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_file: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col binary, the bytes that ids_col stands for; null or no ids give no bytes."""
    with open(ranks_file, "rb") as file:
        content = file.read()
    df = small_batches(df.drop(bytes_col))
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {rank: token for token, rank in read_ranks(content).items()}.__getitem__
        for batch in batches:
            ids = batch.column(place)
            yield _with(batch, bytes_col, pa.array([b"".join(map(get, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in ids], pa.binary()))

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its number of ids, digests of the ids and of the bytes decoded from them."""
    ids = encode(df.select(id_col, text_col), ranks_file, text_col).drop(text_col)
    # one action on ids per task: the digest of the ids is taken beside the decoded bytes
    return decode(ids, ranks_file).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
