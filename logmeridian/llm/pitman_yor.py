"""Language-model scoring with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Tokens are lower-cased words and one end per text. The model has two levels of Chinese restaurants: one restaurant for
each preceding word, told by its 64-bit hash, all of them sharing the root restaurant as parent, whose own base is uniform
over the vocabulary and one unknown word.

Texts are packed once into batches of tokens. A batch sends its distinct pairs (preceding word, word), each once and with its
count in training texts, to the block that holds the preceding word's restaurant; a restaurant of a frequent word is dealt over all
blocks by the second word. A block merges what batches send into the customers of its restaurants, and keeps the tables of each dish from sweep to
sweep as a written table. The root restaurant is dealt over groups by word: in each sweep a block tells every group how many tables its
restaurants have per word, the group adds them up, seats the root, and answers. Totals of the restaurants of frequent words and of the root,
whose number has a bound, are added up by Spark and pass through the driver.

A sweep is one Gibbs step for the number of tables of every dish: the dish's own tables are taken out of its restaurant and of the
root, and their new number is drawn from its distribution given all others, which the generalised Stirling numbers give in closed form. Blocks
step at the same time, each given the root as it was at the start of the sweep, and the dishes of a block in two random halves, restaurants being counted anew in
between. A dish of more than ``EXACT`` customers, for which there is no table of Stirling numbers, is seated customer by customer, later in growing steps.
Scores average the predictive probabilities after the last sweeps.

Random numbers come from a seed by block and sweep, and every state is a written table, so a lost executor changes nothing. Tables that a
later one replaces are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm import words as W
from logmeridian.llm.storage import arrow_ready, discard, few_rows_read, one_row_batches, shuffle_width, stash, stash_buckets, table

SWEEPS, BURN_IN = 4, 2
EXACT = 1024
HALVES = 2
STRENGTH = 1.0
BATCH_TOKENS = 1_000_000
BATCH_TEXTS = 60_000
RANGE_TOKENS = 2_000_000
"""Tokens for each block of restaurants, and again for each block of those of frequent words."""
RANGES_PER_GROUP = 4
"""Blocks for each group of the root's words."""
SEED = 20_24

_START = np.uint64(0x5EED_0000_0001)
_END = W.mix(np.array([0xE0D_0F_7E47], np.uint64))[0]
_NO_ID = -(2**63)

_BATCH = "batch long, n long, data array<binary>"
_MESSAGE = "kind int, at long, peer long, data array<binary>, value double"
BLOCK, ASK, SEATS, REPLY, SUM, ROOT, TOTAL = range(7)
"""What a row of a message table is, and whom it goes to: a block's customers, a batch's pairs in it, its tables, and a group's answer to it
(all to the block ``at``; ``value`` of the latter two is the sweep); a block's tables per word and a group's seating (to the group ``at``); the total ``at``."""
TOKENS, KNOWN, ONCE, TWICE, ROOT_ONCE, ROOT_TWICE, ROOT_CUSTOMERS, ROOT_TABLES, FIRST_HOT = range(9)
"""Numbers of the totals; those of frequent words follow, customers first, then tables."""


def pack(values: np.ndarray) -> bytes:
    """An array in its narrowest type, byte by byte of all values in turn, compressed."""
    if values.dtype.kind == "f":
        code, x = 9, values.astype("<f4")
    else:
        top = int(values.max(initial=0))
        code = 8 if values.dtype == np.uint64 or values.min(initial=0) < 0 else 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        x = values.astype(f"<u{code}")
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return bytes([code]) + zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(data: bytes, signed: bool = True) -> np.ndarray:
    size = 4 if data[0] == 9 else data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(size, -1).T).ravel()
    if data[0] == 9:
        return flat.view("<f4").astype(np.float64)
    x = flat.view(f"<u{size}")
    return x.astype(np.uint64).view(np.int64) if signed else x.astype(np.uint64)


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, signed=False), dtype=np.uint64)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and the number of tokens of each text; every text ends with an end."""
    data = W.lower(data)
    found = W.find_words(data, offs)
    hashes = W.slice_hashes(data, found.starts, found.ends)
    return np.insert(hashes, found.bounds[1:], _END), np.diff(found.bounds) + 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed into batches: the sorted hashes of their words (and of the start), the words' places from the most frequent on, the
    tokens as numbers in that order, lengths, ids, and which are held out."""
    from pyspark import TaskContext

    number, held, size, count = TaskContext.get().partitionId() << 33, [], 0, 0

    def flush() -> pa.RecordBatch:
        tokens, lengths, ids, out = (np.concatenate(x) for x in zip(*held, strict=True))
        words, places = np.unique(np.append(tokens, _START), return_inverse=True)
        often = np.argsort(-np.bincount(places), kind="stable")
        number_of = np.empty_like(often)
        number_of[often] = np.arange(len(often))
        packed = [pack_sorted(words), *(pack(x) for x in (often, number_of[places[:-1]], lengths, ids, out))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([packed], pa.list_(pa.binary()))], names=["batch", "n", "data"])

    for batch in batches:
        ids, out = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for first, last, data, offs in W.pieces(batch.column(0)):
            tokens, lengths = _tokens(data, offs)
            held.append((tokens, lengths, ids[first:last].astype(np.int64), out[first:last].astype(np.uint8)))
            size, count = size + len(tokens), count + last - first
            if size >= BATCH_TOKENS or count >= BATCH_TEXTS:
                yield flush()
                number, held, size, count = number + 1, [], 0, 0
    if held:
        yield flush()


class Batch:
    """A batch opened: tokens, and its distinct pairs sorted by the hashes of both words."""

    def __init__(self, data: list[bytes]):
        self.words = unpack_sorted(data[0])
        often, numbers, self.lengths, self.ids, self.held = (unpack(x) for x in data[1:])
        self.tokens = often[numbers]
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = np.searchsorted(self.words, _START)
        self.before = before

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both words of each pair, and the pair of every token."""
        code, back = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)
        return code // len(self.words), code % len(self.words), back

    def training(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.lengths)


def _lots(batch: Batch, before: np.ndarray, word: np.ndarray, hot: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order of the blocks they go to, and their blocks in that order."""
    width = (1 << 64) // ranges + 1
    edges = np.array([i * width for i in range(1, ranges)], np.uint64)
    lot = np.searchsorted(edges, batch.words, "right")[before]
    frequent = np.isin(batch.words, hot)[before]
    lot[frequent] = ranges + (W.mix(batch.words[word[frequent]] ^ W.mix(batch.words[before[frequent]])) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(lot, kind="stable")
    return order, lot[order]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.float64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "at", "peer", "data", "value"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def frequent_words(batches: DataFrame, ranges: int) -> np.ndarray:
    """Preceding words of at least one in ``4 * ranges`` tokens. A task reports only words twice as rare as that
    among its own tokens, so both its report and the result have a bound that data do not move."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, total = [], 0
        for batch in rows:
            for data in batch.column("data").to_pylist():
                one = Batch(data)
                count = np.bincount(one.before, minlength=len(one.words))
                keep = count * 64 * ranges >= count.sum()
                gathered.append((one.words[keep], count[keep]))
                total += int(count.sum())
        if gathered:
            words, back = np.unique(np.concatenate([w for w, _ in gathered]), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([c for _, c in gathered])).astype(np.int64)
            keep = count * 8 * ranges >= total
            yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(count[keep])], names=["word", "n"])

    total = batches.agg(F.sum("n")).first()[0] or 0
    found = batches.select("data").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * 4 * ranges >= total)
    return np.sort(np.array([r["word"] for r in found.select("word").collect()], np.int64).view(np.uint64))


def _send(hot: np.ndarray, ranges: int):
    """A batch's pairs for each block: preceding words, words, the length of the runs of the former, the places of the latter, counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in rows for r in b.to_pylist()):
            batch = Batch(row["data"])
            before, word, back = batch.pairs()
            count = np.bincount(back[batch.training()], minlength=len(word))
            order, lot = _lots(batch, before, word, hot, ranges)
            before, word, count = before[order], word[order], count[order]
            cuts = np.append(_runs(lot), len(lot))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                heads = _runs(before[a:b])
                some, place = np.unique(word[a:b], return_inverse=True)
                hashes = (pack_sorted(batch.words[before[a:b][heads]]), pack_sorted(batch.words[some]))
                out.append((BLOCK, int(lot[a]), row["batch"], [*hashes, *(pack(x) for x in (np.diff(np.append(heads, b - a)), place, count[a:b]))], None))
            yield _rows(out)

    return run


def _merge(rows: pa.Table) -> pa.Table:
    """A block's customers, and the places in it of the pairs of each batch."""
    sent = sorted(rows.to_pylist(), key=lambda r: r["peer"])
    before, word, count, sizes = [], [], [], []
    for r in sent:
        contexts, words = (unpack_sorted(x) for x in r["data"][:2])
        runs, place, n = (unpack(x) for x in r["data"][2:])
        before.append(np.repeat(contexts, runs))
        word.append(words[place])
        count.append(n)
        sizes.append(len(n))
    before, word, count = map(np.concatenate, (before, word, count))
    order = np.lexsort((word, before))
    before, word = before[order], word[order]
    fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])])
    heads = np.flatnonzero(fresh)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    count = np.add.reduceat(count[order], heads)
    before, word = before[heads], word[heads]
    starts = _runs(before)
    some, of = np.unique(word, return_inverse=True)
    at = sent[0]["at"]
    out = [(BLOCK, at, -1, [pack_sorted(before[starts]), pack_sorted(some), *(pack(x) for x in (np.diff(np.append(starts, len(before))), of, count))], None)]
    # Both sides are sorted by the same hashes, so places only grow.
    for r, mine in zip(sent, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
        out.append((ASK, at, r["peer"], [pack(np.diff(mine, prepend=0))], None))
    return _table(out)


@dataclass
class Model:
    hot: np.ndarray
    """Hashes of the frequent preceding words, sorted."""
    totals: dict[int, float] = field(default_factory=dict)
    discount: float = 0.5
    root_discount: float = 0.5

    @property
    def base(self) -> float:
        return 1 / (self.totals.get(KNOWN, 0) + 1)

    def root_chance(self, customers: np.ndarray, tables: np.ndarray, gone: np.ndarray | float = 0.0) -> np.ndarray:
        """The root's probability of words with so many customers and tables, ``gone`` of their customers being taken out."""
        left = np.maximum(customers - gone, 0)
        fresh = (STRENGTH + self.root_discount * self.totals.get(ROOT_TABLES, 0)) * self.base
        return (np.maximum(left - self.root_discount * np.minimum(tables, left), 0) + fresh) / (STRENGTH + self.totals.get(ROOT_CUSTOMERS, 0) - gone)

    def of_hot(self, offset: int) -> np.ndarray:
        return np.array([self.totals.get(FIRST_HOT + offset * len(self.hot) + i, 0.0) for i in range(len(self.hot))])


_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: entry ``[c, t]`` for ``c`` customers at ``t`` tables, up to ``EXACT``."""
    if discount not in _stirling:
        _stirling.clear()
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore"):
            for c in range(1, EXACT):
                out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
        _stirling[discount] = out
    return _stirling[discount]


def _one_by_one(count: np.ndarray, chance: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables taken by ``count`` customers that come after each other; ``chance`` is the weight of a new table."""
    tables, live, seated = np.ones(len(count)), np.arange(len(count)), 1
    while len(live):
        step = 1 if seated < EXACT else seated // 16
        take = np.minimum(step, count[live] - seated)
        tables[live] += random.binomial(take, chance[live] / (chance[live] + seated - discount * tables[live]))
        seated += step
        live = live[count[live] > seated]
    return tables


_SIZES = np.array([1, *range(2, 17), *(x for k in range(4, 10) for x in (3 << (k - 1), 2 << k))])
"""Customers up to which dishes are drawn together."""


def draw_tables(count: np.ndarray, others: np.ndarray, chance: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """New numbers of tables: of ``count`` customers of a dish that the parent serves with probability ``chance``, in a restaurant with ``others`` tables besides."""
    tables = np.minimum(count, 1).astype(np.float64)
    many = count > EXACT
    if many.any():
        tables[many] = _one_by_one(count[many], (STRENGTH + discount * others[many]) * chance[many], discount, random)
    size = np.searchsorted(_SIZES, count)
    for i in np.unique(size[(count > 1) & ~many]).tolist():
        top = int(_SIZES[i])
        at = np.flatnonzero((size == i) & (count > 1) & ~many)
        for few in np.array_split(at, -(-len(at) * top // 1_000_000)):
            more = np.cumsum(np.log(STRENGTH + discount * (others[few, None] + np.arange(top))), axis=1) + np.arange(1, top + 1) * np.log(chance[few, None])
            weight = stirling(discount)[count[few], 1 : top + 1] + more
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[few] = 1 + (weight < random.random((len(few), 1)) * weight[:, -1:]).sum(axis=1)
    return tables


class Block:
    """Restaurants of some preceding words, or the share of those of frequent ones that falls on some words."""

    def __init__(self, data: list[bytes], model: Model):
        self.model = model
        self.contexts, self.words = (unpack_sorted(x) for x in data[:2])
        runs, self.word, self.count = (unpack(x) for x in data[2:])
        self.of = np.repeat(np.arange(len(self.contexts)), runs)
        self.hot = np.flatnonzero(np.isin(self.contexts, model.hot))
        self.hot_at = np.searchsorted(model.hot, self.contexts[self.hot])
        self.customers = self.by_context(self.count)
        self.customers[self.hot] = model.of_hot(0)[self.hot_at]

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=values, minlength=len(self.contexts))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=values, minlength=len(self.words))

    def all_tables(self, tables: np.ndarray) -> np.ndarray:
        total = self.by_context(tables)
        total[self.hot] = self.model.of_hot(1)[self.hot_at]
        return total

    def sweep(self, tables: np.ndarray, customers: np.ndarray, seats: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """Every dish's tables drawn anew; ``customers`` and ``seats`` are the root's customers and tables per word."""
        tables, total = tables.astype(np.float64), self.all_tables(tables)
        half = random.integers(0, HALVES, len(tables))
        for h in range(HALVES):
            at = np.flatnonzero((half == h) & (self.count > 0))
            own, word, of = tables[at], self.word[at], self.of[at]
            chance = self.model.root_chance(customers[word], seats[word], own)
            tables[at] = draw_tables(self.count[at], total[of] - own, chance, self.model.discount, random)
            total += np.bincount(of, weights=tables[at] - own, minlength=len(total))
        return tables

    def probability(self, tables: np.ndarray, customers: np.ndarray, seats: np.ndarray) -> np.ndarray:
        """Predictive probability of every pair."""
        d, parent = self.model.discount, self.model.root_chance(customers, seats)[self.word]
        own = np.maximum(self.count - d * tables, 0)
        return (own + (STRENGTH + d * self.all_tables(tables)[self.of]) * parent) / (STRENGTH + self.customers[self.of])

    def sums(self, at: int, groups: int, *per_word: np.ndarray, hashes: bool = False) -> list[tuple]:
        """What each group is told of its words, their hashes first if wanted."""
        width = (1 << 64) // groups + 1
        cuts = [0, *np.searchsorted(self.words, np.array([i * width for i in range(1, groups)], np.uint64)).tolist(), len(self.words)]
        shares = [(g, a, b) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return [(SUM, g, at, [*([pack_sorted(self.words[a:b])] if hashes else []), *(pack(x[a:b]) for x in per_word)], None) for g, a, b in shares]

    def hot_totals(self, offset: int, values: np.ndarray) -> list[tuple]:
        found, first = self.by_context(values)[self.hot], FIRST_HOT + offset * len(self.model.hot)
        return [(TOTAL, first + i, -1, None, float(v)) for i, v in zip(self.hot_at.tolist(), found.tolist(), strict=True) if v]


def _totals(**values: float) -> list[tuple]:
    return [(TOTAL, globals()[name], -1, None, float(v)) for name, v in values.items()]


def _opened(rows: pa.Table) -> dict[int, list[dict]]:
    """Rows of one group by kind, ordered by peer."""
    out: dict[int, list[dict]] = {}
    for r in sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["peer"])):
        out.setdefault(r["kind"], []).append(r)
    return out


def _ask(model: Model, groups: int):
    """A block's first seating, one table for each dish, told to the groups; and its totals."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in rows for r in b.to_pylist()):
            block = Block(row["data"], model)
            first = np.minimum(block.count, 1)
            out = block.sums(row["at"], groups, block.by_word(first).astype(np.int64), block.by_word(block.count).astype(np.int64), hashes=True)
            out.append((SEATS, row["at"], -1, [pack(first)], 0.0))
            out += block.hot_totals(0, block.count) + block.hot_totals(1, first) + _totals(TOKENS=block.count.sum(), ONCE=(block.count == 1).sum(), TWICE=(block.count == 2).sum())
            yield _rows(out)

    return run


def _replies(sweep: int, group: int, peers: np.ndarray, sizes: np.ndarray, index: np.ndarray, *per_word: np.ndarray) -> list[tuple]:
    return [(REPLY, int(p), group, [pack(x[i]) for x in per_word], float(sweep)) for p, i in zip(peers.tolist(), np.split(index, np.cumsum(sizes)[:-1]), strict=True)]


def _number(rows: pa.Table) -> pa.Table:
    """A group's words get numbers; their customers (tables of all blocks) and tokens are added up, and the root's first seating is one table for each."""
    asked = _opened(rows)[SUM]
    hashes = [unpack_sorted(r["data"][0]) for r in asked]
    words, index = np.unique(np.concatenate(hashes), return_inverse=True)
    customers, tokens = (np.bincount(index, weights=np.concatenate([unpack(r["data"][k]) for r in asked]), minlength=len(words)).astype(np.int64) for k in (1, 2))
    peers, sizes = np.array([r["peer"] for r in asked]), np.array([len(h) for h in hashes])
    seats, at = np.minimum(customers, 1), asked[0]["at"]
    out = [(ROOT, at, -1, [pack(x) for x in (peers, sizes, index, tokens)], None), (SEATS, at, -1, [pack(seats)], None)]
    out += _replies(0, at, peers, sizes, index, customers, seats, tokens)
    out += _totals(KNOWN=(tokens > 0).sum(), ROOT_ONCE=(customers == 1).sum(), ROOT_TWICE=(customers == 2).sum(), ROOT_CUSTOMERS=customers.sum(), ROOT_TABLES=seats.sum())
    return _table(out)


def _add(model: Model, sweep: int):
    """The tables of a sweep are the root's customers; the root is seated, each word given the others."""

    def run(rows: pa.Table) -> pa.Table:
        found = _opened(rows)
        at = found[ROOT][0]["at"]
        peers, sizes, index, tokens = (unpack(x) for x in found[ROOT][0]["data"])
        customers = np.bincount(index, weights=np.concatenate([unpack(r["data"][0]) for r in found[SUM]]), minlength=len(tokens)).astype(np.int64)
        before = unpack(found[SEATS][0]["data"][0])
        random = np.random.Generator(np.random.PCG64([SEED, sweep, 1, at]))
        others = np.maximum(model.totals[ROOT_TABLES] - before, 0)
        seats = draw_tables(customers, others, np.full(len(tokens), model.base), model.root_discount, random).astype(np.int64)
        out = [(SEATS, at, -1, [pack(seats)], None), *_replies(sweep, at, peers, sizes, index, customers, seats)]
        return _table(out + _totals(ROOT_CUSTOMERS=customers.sum(), ROOT_TABLES=seats.sum()))

    return run


def _state(found: dict[int, list[dict]], sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's tables after a sweep, and the root's customers and tables of its words."""
    seats = next(r for r in found[SEATS] if r["value"] == sweep)
    replies = [r for r in found[REPLY] if r["value"] == sweep]
    return unpack(seats["data"][0]), *(np.concatenate([unpack(r["data"][k]) for r in replies]) for k in (0, 1))


def _turn(model: Model, sweep: int, groups: int):
    """One sweep of a block."""

    def run(customers: pa.Table, state: pa.Table) -> pa.Table:
        row, found = _opened(customers)[BLOCK][0], _opened(state)
        block, at = Block(row["data"], model), row["at"]
        tables = block.sweep(*_state(found, sweep - 1), np.random.Generator(np.random.PCG64([SEED, sweep, 0, at]))).astype(np.int64)
        return _table([(SEATS, at, -1, [pack(tables)], float(sweep)), *block.sums(at, groups, block.by_word(tables).astype(np.int64)), *block.hot_totals(1, tables)])

    return run


def _answer(models: dict[int, Model]):
    """To every batch the logarithms of its pairs' probabilities, averaged over sweeps, and the training tokens of their words."""

    def run(customers: pa.Table, state: pa.Table) -> pa.Table:
        held, found = _opened(customers), _opened(state)
        chances = [Block(held[BLOCK][0]["data"], model).probability(*_state(found, sweep)) for sweep, model in models.items()]
        chance = np.log10(np.mean(chances, axis=0))
        word = unpack(held[BLOCK][0]["data"][3])
        tokens = np.concatenate([unpack(r["data"][2]) for r in found[REPLY] if r["value"] == 0])
        out = []
        for r in held[ASK]:
            place = np.cumsum(unpack(r["data"][0]))
            out.append((ASK, r["peer"], r["at"], [pack(chance[place]), pack(tokens[word[place]])], None))
        return _table(out)

    return run


def _score(model: Model, ranges: int):
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        one = Batch(batch.column("data")[0].as_py())
        before, word, back = one.pairs()
        order, _ = _lots(one, before, word, model.hot, ranges)
        replies = sorted(answers.to_pylist(), key=lambda r: r["peer"])
        chance, tokens = np.empty(len(word)), np.empty(len(word), np.int64)
        chance[order], tokens[order] = (np.concatenate([unpack(r["data"][k]) for r in replies]) for k in (0, 1))
        base = np.log10((tokens + 1) / (model.totals.get(TOKENS, 0) + model.totals.get(KNOWN, 0) + 1))
        each = lambda values: np.add.reduceat(values[back], one.first)
        columns = [pa.array(one.ids), pa.array(one.held == 1), pa.array(one.lengths), pa.array(each((tokens > 0).astype(np.int64))), pa.array(each(base)), pa.array(each(chance))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _of(messages: DataFrame, *kinds: int) -> DataFrame:
    return messages.where(F.col("kind").isin(list(kinds)))


def _read_totals(model: Model, *messages: DataFrame) -> None:
    """The totals that ``messages`` report, each the sum over all tasks, replace those the model has."""
    for m in messages:
        for r in _of(m, TOTAL).groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many as there are frequent words, and eight
            model.totals[r["at"]] = r["value"]


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


def fit(batches: DataFrame, hot: np.ndarray, ranges: int) -> tuple[Model, DataFrame]:
    """The model after ``SWEEPS`` sweeps, and the answers to all batches."""
    model, groups = Model(hot), max(1, ranges // RANGES_PER_GROUP)
    with one_row_batches(batches.sparkSession):
        merged = batches.mapInArrow(_send(hot, ranges), _MESSAGE).groupBy("at").applyInArrow(_merge, _MESSAGE)
        # Bucketed by block: what the sweeps bring to the customers is shuffled, the customers are not.
        pairs = stash_buckets(merged, "pairs", "at", 2 * ranges)
        first = stash(_of(pairs, BLOCK).mapInArrow(_ask(model, groups), _MESSAGE), "asked")
    roots = stash(_of(first, SUM).groupBy("at").applyInArrow(_number, _MESSAGE), "roots")
    _read_totals(model, first, roots)
    model.discount, model.root_discount = (_discount(model.totals.get(a, 0), model.totals.get(b, 0)) for a, b in ((ONCE, TWICE), (ROOT_ONCE, ROOT_TWICE)))
    seats, replies, kept = first, roots, {}
    for sweep in range(1, SWEEPS + 1):
        state = _of(seats, SEATS).unionByName(_of(replies, REPLY))
        turned = stash(_of(pairs, BLOCK).groupBy("at").cogroup(state.groupBy("at")).applyInArrow(_turn(model, sweep, groups), _MESSAGE), "seats")
        seated = _of(roots, ROOT).unionByName(_of(turned, SUM)).unionByName(_of(replies, SEATS))
        replied = stash(seated.groupBy("at").applyInArrow(_add(model, sweep), _MESSAGE), "roots")
        # What later jobs are given must stay as it is: a new model for each sweep.
        model = replace(model, totals={k: v for k, v in model.totals.items() if k < FIRST_HOT + len(hot)})
        _read_totals(model, turned, replied)
        if sweep <= BURN_IN + 1:
            discard(seats, *([replies] if replies is not roots else []))
        seats, replies = turned, replied
        if sweep > BURN_IN:
            kept[sweep] = (model, turned, replied)
    state = _of(roots, REPLY)
    for _, turned, replied in kept.values():
        state = state.unionByName(_of(turned, SEATS)).unionByName(_of(replied, REPLY))
    answer = _answer({sweep: m for sweep, (m, _, _) in kept.items()})
    return model, pairs.groupBy("at").cogroup(state.groupBy("at")).applyInArrow(answer, _MESSAGE)


def score_texts(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``perplexity``.

    ``held_out`` is a column expression; where it is null the text is learned from. Null and empty texts
    hold only the end token. Ids are integers; a null id comes back as null. Repeated rows are separate
    texts. Without any training text every token has the probability of an unknown word. Very long texts are whole
    in one batch. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    texts = docs.select(
        F.col(text_column).cast("string").alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID).cast("long")).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
    )
    batches = stash_buckets(texts.mapInArrow(_batches, _BATCH), "batches", "batch", shuffle_width(spark))
    with few_rows_read(spark):
        tokens = batches.agg(F.sum("n")).first()[0] or 0
        ranges = max(shuffle_width(spark), -(-tokens // RANGE_TOKENS))
        with one_row_batches(spark):
            hot = frequent_words(batches, ranges)
        model, answers = fit(batches, hot, ranges)
        scored = batches.groupBy("batch").cogroup(answers.withColumnRenamed("at", "batch").groupBy("batch")).applyInArrow(
            _score(model, ranges), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        )
        parts = stash(scored, "scores")
    return parts.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_column), "held_out", "n_tokens", "n_known", F.lit(int(model.totals.get(TOKENS, 0))).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
