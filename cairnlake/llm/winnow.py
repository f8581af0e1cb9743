"""Recurring passages: which windows of a table of texts may occur more than once, found without comparing all windows.

Every window of ``window`` units (words or bytes) has an anchor: the place of the least hash among its runs of ``gram``
units. Equal windows have equal anchors at equal places, so a window can recur only if its anchor's hash does. A passage
is the stretch of text whose windows share one anchor. Texts are dealt into shards by the hash of their id, anchors into
buckets by their hash; between the two go packed arrays, a row for each pair of shard (or task) and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import GAP, packed, ragged, slices, spans_of, text_bytes, tidy

#: Bytes of text in a shard, and of text whose anchors make a bucket, on average; and the least number of either.
SHARD_BYTES, BUCKET_BYTES, LEAST = 2 << 20, 8 << 20, 64
SLICE_BYTES = 2 << 20
#: An anchor of more shards is hot: its windows are dealt one by one.
HOT = 4096
#: Rows that a bucket gathers before it merges equal ones.
MERGED = 1 << 21
#: Units that are hashed at a time, as the processor's cache holds them; and the bits of a place among them.
STRETCH, PLACE_BITS = 1 << 15, 28
PLACE = np.uint64((1 << PLACE_BITS) - 1)
LAST_ID = np.int64(2**63 - 1)
BASE, TABLE = np.uint64(0x9E3779B97F4A7C15 | 1), np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Multipliers of the words of a hash.
FACTORS = [np.uint64(x) for x in np.random.default_rng(12).integers(1, 2**63, 24, dtype=np.uint64) | np.uint64(1)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums, from which hashes() takes the hash of any stretch."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [begin, end)."""
    return mix((prefix[ends] - prefix[begins]) * powers(len(prefix))[1][begins] + (ends - begins).astype(np.uint64))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; places behind the data read zeros."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` bytes, read eight bytes at a time."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = words_at(data)
    if size < 8:
        total = (words[:n] & np.uint64((1 << 8 * size) - 1)) * BASE
    else:
        total = words[:n] * BASE
        for k, at in enumerate([*range(8, size - 8, 8), size - 8] if size > 8 else []):
            total ^= total >> np.uint64(31)
            total += words[at : at + n] * FACTORS[k % len(FACTORS)]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return total


def contents(words: np.ndarray, begins: np.ndarray, lens: np.ndarray, least: int, most: int) -> np.ndarray:
    """Hashes of the stretches of bytes [begin, begin + len) of ``least`` (8 or more) to ``most``, from words_at() of the data."""
    total = lens.astype(np.uint64) * BASE
    heads = [*range(0, least - 7, 8)]
    places = [(begins, at) for at in heads]
    ends = begins + lens
    places += [(ends, -back) for back in range(8, most - len(heads) * 8 + 8, 8)]
    for k, (at, shift) in enumerate(places):
        total ^= total >> np.uint64(31)
        total += words[at + shift] * FACTORS[k % len(FACTORS)]
        total *= BASE
    return mix(total)


def rolling(prefix: np.ndarray, size: int, a: int, b: int) -> np.ndarray:
    """Hashes of all stretches of one size among the symbols [a, b)."""
    n = b - a - size + 1
    return mix((prefix[a + size : b + 1] - prefix[a : a + n]) * powers(len(prefix))[1][a : a + n] + np.uint64(size))


@dataclass
class Units:
    """The units of a column of texts: the texts' first units, and for words their hashes and their spans in the bytes."""

    symbols: np.ndarray | None
    off: np.ndarray
    data: np.ndarray
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None

    @staticmethod
    def of(col: pa.Array, words: bool) -> Units:
        data, off = text_bytes(col)
        if not words:
            return Units(None, off, data)
        begins, ends, first = spans_of(~GAP[data], off)
        return Units(hashes(sums(TABLE[data]), begins, ends), first, data, begins, ends)

    def strings(self) -> pa.LargeBinaryArray:
        return packed(self.data, self.begins, self.ends)


@dataclass
class Passages:
    """Passages in the order of the units: the anchor's hash, the first of its windows, how many, the text's number, and the anchor's place."""

    anchor: np.ndarray
    start: np.ndarray
    count: np.ndarray
    text: np.ndarray
    place: np.ndarray
    prefix: np.ndarray | None

    @staticmethod
    def of(units: Units, window: int, gram: int) -> Passages:
        n = int(units.off[-1])
        prefix = None if units.symbols is None else sums(units.symbols)
        none = np.zeros(0, np.int64)
        if n < window:
            return Passages(none.astype(np.uint64), none, none, none, none, prefix)
        hashed, owner = np.empty(n - gram + 1, np.uint64), np.empty(n - window + 1, np.int32 if n < 2**31 else np.int64)
        for a in range(0, n - window + 1, STRETCH):  # a stretch at a time, with the units behind that its last windows need
            b = min(a + STRETCH, n - window + 1)
            part = byte_grams(units.data[a : b + window - 1], gram) if prefix is None else rolling(prefix, gram, a, b + window - 1)
            hashed[a : a + len(part)] = part
            owner[a:b] = Passages.least(part, window, gram) + np.int64(a)
        inside = np.ones(n + 1, bool)
        tails = units.off[1:]
        for back in range(1, window):  # windows that would cross a text's end
            at = tails - back
            inside[at[at >= 0]] = False
        inside = inside[: len(owner)]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        return Passages(hashed[owner[start]], start, np.flatnonzero(last) + 1 - start, np.searchsorted(units.off, start, side="right") - 1, owner[start].astype(np.int64), prefix)

    @staticmethod
    def least(hashed: np.ndarray, window: int, gram: int) -> np.ndarray:
        """The place of the least gram in each window."""
        least = (hashed & ~PLACE) | np.arange(len(hashed), dtype=np.uint64)
        size, width = 1, window - gram + 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        return (least & PLACE).astype(np.int64)

    def pick(self, at: np.ndarray) -> Passages:
        return Passages(self.anchor[at], self.start[at], self.count[at], self.text[at], self.place[at], self.prefix)


def planes(values: np.ndarray) -> bytes:
    """The low six bytes of sorted numbers, plane by plane: neighbours share their high bytes, which then compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(6, -1).T
    return out.view("<u8").reshape(-1)


LOW48 = np.uint64((1 << 48) - 1)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(values: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order by bucket, then value."""
    order = np.argsort(values)
    return order[np.argsort(bucket[order].astype(np.uint16 if len(bucket) and bucket.max() < 65536 else np.int64), kind="stable")]


def groups(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of a sorted array."""
    if len(keys):
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(keys[a]), a, b


@dataclass
class Plan:
    """How windows are cut and texts dealt."""

    window: int
    gram: int
    words: bool
    shards: int
    buckets: int
    across: bool  # only windows of two texts count, not those of one
    hot: int

    @property
    def lengths(self) -> tuple[int, int]:
        """The units of the shortest and the longest passage."""
        return self.window, 2 * self.window - self.gram


def plan_for(docs: DataFrame, window: int, gram: int, words: bool, across: bool, bucket_bytes: int = BUCKET_BYTES) -> Plan:
    size = docs.agg(F.sum(F.octet_length("_text").cast("long")).alias("b")).first()["b"] or 0
    return Plan(window, gram, words, max(LEAST, -(-size // SHARD_BYTES)), max(LEAST, -(-size // bucket_bytes)), across, HOT)


def dealt(docs: DataFrame, plan: Plan) -> DataFrame:
    """Rows of _id and _text with their _shard; rows that share an id are dealt apart by their texts."""
    return docs.withColumn("_shard", F.pmod(F.xxhash64("_id", "_text"), F.lit(plan.shards)).cast("int"))


def anchor_rows(plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                found = Passages.of(Units.of(part.column("_text"), plan.words), plan.window, plan.gram)
                if not len(found.anchor):
                    continue
                shard = part.column("_shard").to_numpy()[found.text].astype(np.int64)
                bucket = bucket_of(found.anchor, plan.buckets)
                order = by_bucket(found.anchor & LOW48, bucket)
                low, shard, bucket, text_no = (found.anchor & LOW48)[order], shard[order], bucket[order], found.text[order]
                equal = np.zeros(len(order) + 1, bool)
                equal[1:-1] = (low[1:] == low[:-1]) & (bucket[1:] == bucket[:-1])
                twins = np.flatnonzero(equal[:-1] | equal[1:])  # few: put in the order of shard and text
                fine = twins[np.lexsort((text_no[twins], shard[twins], low[twins], bucket[twins]))]
                shard[twins], text_no[twins] = shard[fine], text_no[fine]
                same = equal[:-1].copy()
                same[1:] &= shard[1:] == shard[:-1]
                again = same.copy()
                if plan.across:
                    again[1:] &= text_no[1:] != text_no[:-1]
                head = np.flatnonzero(~same)
                many = np.logical_or.reduceat(again, head)
                low, shard, bucket = low[head], shard[head], bucket[head]
                rows = [(k, planes(low[a:b]), shard[a:b].astype("<u4").tobytes(), np.packbits(many[a:b]).tobytes()) for k, a, b in groups(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "low", "shard", "many"])
        tidy()

    return run


def once(low: np.ndarray, shard: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of anchor and shard, in order; ``many`` where one came with it or more than once."""
    order = np.lexsort((shard, low))
    low, shard, many = low[order], shard[order], many[order]
    same = np.zeros(len(low) + 1, bool)
    same[1:-1] = (low[1:] == low[:-1]) & (shard[1:] == shard[:-1])
    many = many | same[:-1] | same[1:]
    head = np.flatnonzero(~same[:-1])
    return low[head], shard[head], np.logical_or.reduceat(many, head) if len(head) else many


def recurring(plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: the anchors that occur twice or more, by shard, and those of them that very many shards have."""
        parts, held, kept = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool))], 0, 0
        for batch in batches:
            for low, shard, many in zip(*(batch.column(c).to_pylist() for c in ("low", "shard", "many")), strict=True):
                low = unplaned(low)
                parts.append((low, np.frombuffer(shard, "<u4"), np.unpackbits(np.frombuffer(many, np.uint8))[: len(low)] > 0))
                held += len(low)
            if held > 2 * kept + MERGED:
                parts = [once(*map(np.concatenate, zip(*parts, strict=True)))]
                held = kept = len(parts[0][0])
        low, shard, many = once(*map(np.concatenate, zip(*parts, strict=True)))
        del parts
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(low)))
        again = (size > 1) | np.logical_or.reduceat(many, head) if len(head) else size > 1
        keep, hot = np.repeat(again, size), np.repeat(size > plan.hot, size)
        low, shard, hot = low[keep], shard[keep].astype(np.int64), hot[keep]
        order = np.argsort(shard, kind="stable")
        low, shard, hot = low[order], shard[order], hot[order]
        rows = [(k, planes(low[a:b]), planes(low[a:b][hot[a:b]])) for k, a, b in groups(shard)]
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(3)], ["_shard", "low", "hot"])

    return run


def candidates(docs: DataFrame, plan: Plan) -> DataFrame:
    """(_shard, low, hot): the recurring anchors of each shard, and the hot ones among them; ``docs`` has _shard."""
    rows = docs.select("_shard", "_text").mapInArrow(anchor_rows(plan), "bucket int, low binary, shard binary, many binary")
    return rows.groupBy("bucket").applyInArrow(recurring(plan), "_shard int, low binary, hot binary")


def ids_of(table: pa.Table) -> np.ndarray:
    """The ids as int64, null as the last."""
    return pc.fill_null(table["_id"].cast(pa.int64()), int(LAST_ID)).to_numpy()


def shard_passages(docs: pa.Table, anchors: pa.Table, plan: Plan) -> tuple[Units, Passages]:
    """The units of a shard's texts, and its passages of recurring anchors, those of hot ones window by window."""
    units = Units.of(docs["_text"], plan.words)
    found = Passages.of(units, plan.window, plan.gram)
    known = np.unique(all_of(anchors["low"]))
    return units, spread(found.pick(np.flatnonzero(np.isin(found.anchor & LOW48, known))), all_of(anchors["hot"]), units, plan)


def all_of(blobs) -> np.ndarray:
    """The packed numbers of a column."""
    return np.concatenate([np.zeros(0, np.uint64), *(unplaned(x) for x in blobs.to_pylist())])


def spread(found: Passages, hot: np.ndarray, units: Units, plan: Plan) -> Passages:
    """Passages of hot anchors as single windows, whose own hashes deal them: no bucket holds all of a common anchor."""
    split = np.isin(found.anchor & LOW48, hot) if len(hot) else np.zeros(len(found.anchor), bool)
    if not split.any():
        return found
    some, rest = found.pick(np.flatnonzero(split)), found.pick(np.flatnonzero(~split))
    start = ragged(some.start, some.count)
    if found.prefix is None:
        own = contents(words_at(units.data), start, np.full(len(start), plan.window), plan.window, plan.window)
    else:
        own = hashes(found.prefix, start, start + plan.window)
    each = Passages(mix(own ^ BASE), start, np.ones(len(start), np.int64), np.repeat(some.text, some.count), np.repeat(some.place, some.count), found.prefix)
    both = [np.concatenate([getattr(rest, n), getattr(each, n)]) for n in ("anchor", "start", "count", "text", "place")]
    return Passages(*both, found.prefix).pick(np.argsort(both[1], kind="stable"))


def keys_of(found: Passages, plan: Plan) -> np.ndarray:
    """Hashes of the passages' contents."""
    return hashes(found.prefix, found.start, found.start + found.count + plan.window - 1)


def distinct(found: Passages, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all passages, numbers of the first passages of each distinct hash, how often each occurs); in the order of the hashes."""
    key = keys_of(found, plan)
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    return key, at, times
