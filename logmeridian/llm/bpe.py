"""Byte-level BPE over an existing rank file: encoding with offsets, and decoding.

Texts are cut without a regular expression. Every code point gets a symbol from a class table
(letter, number, other, white space) and its right neighbours; the symbols drive a small automaton.
Its transition functions are composed block by block and then across blocks (composition is
associative), which gives the state before every block and, in a second sweep, before every code
point. A token starts where the table says so for that state and symbol.

The distinct slices of a piece of text are then merged together, all of them at once, by rounds of
array operations, long ones by a heap each; a bounded cache keeps the ids of slices seen before. The vocabulary file is opened
by the driver, which hands its tables to the tasks as a broadcast of fixed size.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm import words as W
from logmeridian.llm.storage import arrow_ready, table

CACHED_SLICES = 200_000
LONG_SLICE = 256
"""Bytes from which on a slice is merged by a heap of its own."""
BLOCK = 64

# White space as the pattern's \s takes it (the Unicode property White_Space).
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The contractions that the pattern cuts off, after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

LETTER, NUMBER, OTHER, APOSTROPHE_1, APOSTROPHE_2, SPACES, LAST_SPACE, BLANK = range(8)
"""Symbols. LAST_SPACE and BLANK (U+0020) are white space right before anything else."""
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, ALONE, BLANK_FIRST, ONE_MORE, TWO_MORE, CUT = range(10)
"""States: what the automaton is inside of after a code point."""


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token starts, by ``symbol * states + state``; symbols from 8 on open a text."""
    step, begins = np.zeros((16, 10), np.uint8), np.zeros((16, 10), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE_1: IN_OTHERS, APOSTROPHE_2: IN_OTHERS, SPACES: IN_SPACES}
    fresh = {APOSTROPHE_1: ONE_MORE, APOSTROPHE_2: TWO_MORE, LAST_SPACE: ALONE, BLANK: BLANK_FIRST}
    for symbol in range(8):
        for state in range(10):
            run = runs.get(symbol)
            if run is not None and (state == run or (state == BLANK_FIRST and symbol != SPACES)):
                step[symbol, state] = run
            elif symbol == LETTER and state in (ONE_MORE, TWO_MORE):
                step[symbol, state] = CUT if state == ONE_MORE else ONE_MORE
            else:
                step[symbol, state], begins[symbol, state] = fresh.get(symbol, run), True
        step[symbol + 8], begins[symbol + 8] = step[symbol, START], True
    return step.ravel(), begins.ravel()


_STEP, _BEGINS = _automaton()
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    if "classes" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        out[list(WHITE_SPACE)] = SPACES
        _tables["classes"] = out
    return _tables["classes"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = padded[at].astype(np.int32)
    out = lead.copy()
    for low, bits, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        long = np.flatnonzero(lead >= low)
        if len(long):
            value = lead[long] & bits
            for j in range(1, extra + 1):
                value = (value << 6) | (padded[at[long] + j] & 0x3F)
            out[long] = value
    return out, at


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Automaton symbols; ``firsts`` are the positions at which a text begins."""
    n = len(points)
    out = _classes()[np.minimum(points, 0x10FFFF)]
    opens = np.zeros(n + 1, bool)
    opens[firsts] = True
    opens[n] = True
    space = out == SPACES
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~opens[1:]
    out[last] = LAST_SPACE
    out[last & (points == 0x20)] = BLANK
    for i in np.flatnonzero(points == 0x27):
        if i + 1 < n and not opens[i + 1]:
            if points[i + 1] < 128 and chr(points[i + 1]) in SHORT_ENDINGS:
                out[i] = APOSTROPHE_1
            elif i + 2 < n and not opens[i + 2] and max(points[i + 1], points[i + 2]) < 128 and chr(points[i + 1]) + chr(points[i + 2]) in LONG_ENDINGS:
                out[i] = APOSTROPHE_2
    out[firsts] += 8
    return out


def token_starts(marks: np.ndarray) -> np.ndarray:
    """Positions at which a token starts, by a scan over composed transition functions."""
    n = len(marks)
    if n == 0:
        return np.empty(0, np.int64)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, LETTER, np.int16)
    grid[:n] = marks
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * 10
    whole = np.tile(np.arange(10, dtype=np.uint8), (blocks, 1))
    for row in grid:
        whole = _STEP[row[:, None] + whole]
    reach = 1
    while reach < blocks:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], axis=1)
        reach *= 2
    state = np.concatenate([[START], whole[:-1, START]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        at = row + state
        out[j] = _BEGINS[at]
        state = _STEP[at]
    return np.flatnonzero(out.T.ravel()[:n])


@dataclass
class Vocabulary:
    """``ranks``: bytes to id; ``keys``/``ids``: mergeable pairs; ``flat``/``cuts``: the bytes of each id."""

    ranks: dict[bytes, int]
    bytes_to_id: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    flat: np.ndarray
    cuts: np.ndarray
    late: np.ndarray
    """Ids that are part of a pair of lower rank; such an id is made once per round, at the leftmost place."""


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs = {}
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
            if a is not None and b is not None:
                pairs[(a << 32) | b] = rank
    keys = np.array(sorted(pairs), np.int64)
    late = np.zeros(max(ranks.values()) + 1, bool)
    for pair, rank in pairs.items():
        for part in (pair >> 32, pair & 0xFFFFFFFF):
            late[part] |= part >= rank
    names = {i: b for b, i in ranks.items()}
    cuts, parts = np.zeros(max(names) + 2, np.int64), []
    for i in range(max(names) + 1):
        parts.append(names.get(i, b""))
        cuts[i + 1] = cuts[i] + len(parts[-1])
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Vocabulary(ranks, single, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), np.frombuffer(b"".join(parts), np.uint8), cuts, late)


_NONE = np.iinfo(np.int64).max


def merge_slices(slices: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids (little-endian 32-bit) of every slice, merging the lowest rank first, leftmost first."""
    out: list[bytes | None] = [None] * len(slices)
    todo = []
    for i, one in enumerate(slices):
        rank = vocabulary.ranks.get(one)
        if rank is None and len(one) > LONG_SLICE:
            out[i] = merge_long(one, vocabulary)
        elif rank is None and one:
            todo.append(i)
        else:
            out[i] = b"" if rank is None else rank.to_bytes(4, "little")
    if not todo:
        return out
    sizes = np.array([len(slices[i]) for i in todo], np.int64)
    tokens = vocabulary.bytes_to_id[np.frombuffer(b"".join(slices[i] for i in todo), np.uint8)]
    owner = np.repeat(np.arange(len(todo)), sizes)
    while len(tokens):
        rank = np.full(len(tokens), _NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = (tokens[inner] << 32) | tokens[inner + 1]
        at = np.minimum(np.searchsorted(vocabulary.keys, pair), len(vocabulary.keys) - 1)
        rank[inner] = np.where(vocabulary.keys[at] == pair, vocabulary.ids[at], _NONE)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(rank, heads)
        counts = np.diff(np.append(heads, len(tokens)))
        done = least == _NONE
        if done.any():
            raw = tokens.astype("<u4")
            for a, c, o in zip(heads[done].tolist(), counts[done].tolist(), owner[heads[done]].tolist(), strict=True):
                out[todo[o]] = raw[a : a + c].tobytes()
        live = np.repeat(~done, counts)
        tokens, owner, rank, least = tokens[live], owner[live], rank[live], np.repeat(least[~done], counts[~done])
        if not len(tokens):
            break
        chosen = rank == least
        place = np.flatnonzero(chosen)
        run_start = np.concatenate([[True], (np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]])])
        first = place[run_start][np.cumsum(run_start) - 1]
        leftmost = np.concatenate([[True], owner[place[1:]] != owner[place[:-1]]])
        place = place[((place - first) % 2 == 0) & (leftmost | ~vocabulary.late[rank[place]])]
        tokens[place] = rank[place]
        gone = np.ones(len(tokens), bool)
        gone[place + 1] = False
        tokens, owner = tokens[gone], owner[gone]
    return out


def merge_long(one: bytes, vocabulary: Vocabulary) -> bytes:
    """Ids of one long slice: a heap of pairs by rank and place over a linked list, so n log n steps."""
    tokens = vocabulary.bytes_to_id[np.frombuffer(one, np.uint8)]
    pair = (tokens[:-1] << 32) | tokens[1:]
    at = np.minimum(np.searchsorted(vocabulary.keys, pair), len(vocabulary.keys) - 1)
    fits = np.flatnonzero(vocabulary.keys[at] == pair)
    heap = ((vocabulary.ids[at[fits]] << 32) | fits).tolist()
    heapq.heapify(heap)
    n, keys, ranks = len(one), array("q", vocabulary.keys.tobytes()), array("q", vocabulary.ids.tobytes())

    def rank_of(left: int, right: int) -> int | None:
        pair = (left << 32) | right
        i = bisect_left(keys, pair)
        return ranks[i] if i < len(keys) and keys[i] == pair else None

    ids, after, before = tokens.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heapq.heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            fresh = rank_of(rank, ids[k])
            if fresh is not None:
                heapq.heappush(heap, (fresh << 32) | i)
        h = before[i]
        if h >= 0:
            fresh = rank_of(ids[h], rank)
            if fresh is not None:
                heapq.heappush(heap, (fresh << 32) | h)
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of slice, and the kind of every slice; equal hashes count only with equal bytes."""
    hashes = W.slice_hashes(data, starts, ends)
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    lanes, cuts = W.slice_lanes(data, starts, ends)
    size = np.diff(cuts)
    like = one[back]
    other = (ends - starts) != (ends - starts)[like]
    same_size = ~other
    owner = np.repeat(np.arange(len(starts)), np.where(same_size, size, 0))
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    differs = lanes[cuts[owner] + place] != lanes[cuts[like[owner]] + place]
    other[owner[differs]] = True
    strange = np.flatnonzero(other)
    if len(strange):
        raw, kinds = data.tobytes(), {}
        for i in strange.tolist():
            kind = kinds.setdefault(raw[starts[i] : ends[i]], len(one) + len(kinds))
            back[i] = kind
        first = {}
        for i in strange.tolist():
            first.setdefault(int(back[i]), i)
        one = np.concatenate([one, [first[k] for k in sorted(first)]])
    return one, back


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cache = vocabulary, {}

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte each begins at within its text, and the ids' offsets by text."""
        points, at = code_points(data)
        firsts = np.searchsorted(at, offs[:-1][np.diff(offs) > 0])
        starts = at[token_starts(symbols(points, firsts))]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        one, back = distinct_slices(data, starts, ends)
        raw = data.tobytes()
        slices = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if len(self.cache) > CACHED_SLICES:
            self.cache.clear()
        ids = [self.cache.get(s) for s in slices]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, merge_slices([slices[i] for i in missing], self.vocabulary), strict=True):
            ids[i] = x
            if len(slices[i]) <= 64:
                self.cache[slices[i]] = x
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        count = size[back]
        total = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.repeat(begin[back] - total[:-1], count) + np.arange(total[-1])]
        by_text = total[np.searchsorted(starts, offs)]
        length = np.diff(self.vocabulary.cuts)[out] if len(out) else np.empty(0, np.int64)
        place = np.concatenate([[0], np.cumsum(length)])[:-1]
        return out, place - np.repeat(offs[:-1], np.diff(by_text)), by_text


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    size = np.diff(vocabulary.cuts)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    return vocabulary.flat[np.repeat(vocabulary.cuts[ids] - total[:-1], size) + np.arange(total[-1])]


def _binary(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * raw.itemsize).astype(np.int32)), pa.py_buffer(raw.view(np.uint8))])


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_tokens, ids, starts`` per row: ids and the byte where each begins, packed as little-endian 32-bit.

    A null or empty text has no ids. Null ids and repeated rows keep their rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        for batch in batches:
            for first, last, data, offs in W.pieces(batch.column(1), 1 << 20):
                ids, starts, cuts = encode(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(cuts)), _binary(ids.astype("<u4"), cuts), _binary(starts.astype("<u4"), cuts)],
                    names=[id_column, "n_tokens", "ids", "starts"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens long, ids binary, starts binary"
    )


def bpe_decode(encoded: DataFrame, vocabulary_path: str, id_column: str = "doc_id") -> DataFrame:
    """All columns of ``encoded`` but ``starts``, and ``decoded``: the bytes that ``ids`` stand for."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = encoded.select(id_column, "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in W.pieces(batch.column(2)):
                ids = data.view("<u4") if data.flags.aligned else np.frombuffer(data.tobytes(), "<u4")
                size = np.concatenate([[0], np.cumsum(np.diff(shared.value.cuts)[ids])])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(decode_ids(ids, shared.value), size[offs // 4])], names=[id_column, "n_tokens", "ids", "decoded"])

    return kept.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in kept.dtypes)}, decoded binary")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op10_byte_bpe(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    path = vocabulary_path or default_vocabulary()
    back = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
