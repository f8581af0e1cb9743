"""Benchmark decontamination with an FM-index for each shard of the training texts.

A task takes its texts in shards of bounded size. A shard's words become the numbers that the test phrases give them; a
word of no test phrase ends a run, and a run shorter than the shortest window can't hold one, so only longer runs are
indexed. The windows of all test items are searched backward at once through the ranks of a wavelet matrix over the
Burrows-Wheeler transform, their occurrences are located by sampled suffix positions, and the covered words are merged
into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import ALNUM, LOWER, cut, enclosed, opened, packed, ragged, read, schema_with, slices, spans_of, text_bytes, tidy, with_columns

WINDOW = 10
#: Bytes of test items that one pass over the documents searches for; more items make more passes.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
#: Every so many suffix positions are kept for locating.
SAMPLED = 8
#: Occurrences that are located at a time.
LOCATED = 1 << 20


class FMIndex:
    """An FM-index of a text of small non-negative numbers."""

    def __init__(self, text: np.ndarray):
        t = np.concatenate([text.astype(np.int64) + 1, [0]])
        sa = suffix_array(t)
        self.n = len(t)
        bwt = t[sa - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t))])  # numbers below each
        self.levels = []
        for bit in reversed(range(int(t.max()).bit_length())):
            ones = (bwt >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            zeros = self.n - int(before[-1])
            self.levels.append((bit, zeros, before))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        kept = sa % SAMPLED == 0
        self.kept, self.kept_before, self.kept_at = kept, np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def rank(self, symbol: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        """How often the symbols occur in the transform before each of the rows."""
        start, out = np.zeros_like(symbol), [r.copy() for r in rows]
        for bit, zeros, before in self.levels:
            one = (symbol >> bit) & 1 == 1
            start, *out = (np.where(one, zeros + before[r], r - before[r]) for r in (start, *out))
        return [r - start for r in out]

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(rows), rows.copy()
        for bit, zeros, before in self.levels:
            one = before[at + 1] > before[at]
            out |= one.astype(out.dtype) << bit
            at = np.where(one, zeros + before[at], at - before[at])
        return out

    def search(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase; phrases are rows of numbers, of ``lens`` entries."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1]):
            at = np.flatnonzero((lens > k) & (low < high))
            if not len(at):
                break
            c = phrases[at, lens[at] - 1 - k].astype(np.int64) + 1
            known = c < len(self.below) - 1
            high[at[~known]] = low[at[~known]]
            at, c = at[known], c[known]
            a, b = self.rank(c, low[at], high[at])
            low[at], high[at] = self.below[c] + a, self.below[c] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: steps back to the nearest sampled position."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.kept[at]
            out[left[done]] = self.kept_at[self.kept_before[at[done]]] + steps[left[done]]
            left, at = left[~done], at[~done]
            steps[left] += 1
            if len(left):
                c = self.symbol(at)
                at = self.below[c] + self.rank(c, at)[0]
        return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; the last entry must be the only 0."""
    rank, width = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(t), np.int64)
        if width < len(t):
            after[:-width] = rank[width:] + 1
        key = rank * (len(t) + 1) + after
        sa = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
        rank = np.empty(len(t), np.int64)
        rank[sa] = fresh
        if fresh[-1] == len(t) - 1:
            return sa
        width *= 2


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their begins, their ends, the texts' first words) after lower-casing A-Z."""
    data, off = text_bytes(col)
    data = LOWER[data]
    begins, ends, first = spans_of(ALNUM[data], off)
    return packed(data, begins, ends), begins, ends, first


def in_order(ids: Iterable[str | None]) -> list[str | None]:
    """The distinct ids, sorted; a null comes last."""
    return sorted(set(ids), key=lambda x: (x is None, x or ""))


class Phrases:
    """The windows of test items as rows of word numbers, and the items of each window."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        words, _, _, first = words_of(pa.array(texts, pa.string()))
        table = words.dictionary_encode()
        self.vocabulary = table.dictionary
        codes = table.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
        sizes = np.diff(first)
        counts = np.where(sizes == 0, 0, np.maximum(sizes - WINDOW + 1, 1))
        at = ragged(first[:-1], counts)
        lens = np.repeat(np.minimum(WINDOW, sizes), counts)
        own = in_order(ids)  # rows may share an id
        numbers = {x: k for k, x in enumerate(own)}
        self.ids = np.array(own, dtype=object)
        item = np.repeat(np.array([numbers[x] for x in ids], np.int64), counts)
        rows = np.full((len(at), WINDOW), -1, np.int64)
        for k in range(WINDOW):
            ok = lens > k
            rows[ok, k] = codes[at[ok] + k]
        if len(rows):
            self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
        else:
            self.rows, inverse = rows, np.zeros(0, np.int64)
        self.lens = (self.rows >= 0).sum(1)
        pairs = np.unique(np.stack([inverse, item], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.items, self.item_first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.shortest = int(self.lens.min()) if len(self.lens) else 0


def occurrences(phrases: Phrases, words: pa.Array, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first words, windows) of the occurrences in a shard, some at a time."""
    if not len(phrases.rows) or not len(words):
        return
    codes = pc.fill_null(pc.index_in(words, value_set=phrases.vocabulary), -1).to_numpy(zero_copy_only=False)
    known = codes >= 0
    begins, ends, _ = spans_of(known, first)
    long = ends - begins >= phrases.shortest
    begins, lens = begins[long], (ends - begins)[long]
    if not len(begins):
        return
    where = ragged(begins, lens + 1)  # each run, and one place for its end
    stops = np.cumsum(lens + 1) - 1
    text = np.zeros(len(where), np.int64)
    inside = np.ones(len(where), bool)
    inside[stops] = False
    text[inside] = codes[where[inside]].astype(np.int64) + 1  # 0 ends a run
    index = FMIndex(text)
    low, high = index.search(phrases.rows + 1, phrases.lens)
    hit = np.flatnonzero(low < high)
    many = np.cumsum(high[hit] - low[hit])
    for part in np.split(hit, np.flatnonzero(np.diff(many // LOCATED)) + 1) if len(hit) else []:
        counts = high[part] - low[part]
        yield where[index.locate(ragged(low[part], counts))], np.repeat(part, counts)


def found(docs: DataFrame, items: DataFrame, text: str = "text", cleaned: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurrences), items (ids of the items met, sorted as strings).

    With ``cleaned``, the text itself loses every maximal run of hit words, from its first byte to its last. Null texts
    have no words and stay null; long texts are searched whole. Items of null ids are searched as any other and make one
    null at the end of the ids, which counts as an item, as in the SQL; items without words occur nowhere. Rows that
    repeat an item's id count once. Rows keep their rows, empty tables give no hits, own columns named like the new ones,
    in any case, are replaced.

    Items beyond ``BLOCK_BYTES`` are searched block by block, each pass over the table that the one before wrote: driver
    and workers hold the phrases of one block at a time.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    own = out = enclosed(docs, _text=text)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or ""))
        held = docs.sparkSession.sparkContext.broadcast(Phrases([r["item_id"] for r in rows], [r["text"] for r in rows]))
        if k < blocks - 1:
            out = cut(out.mapInArrow(pass_over(held, k == 0), schema_with(own, "n_words bigint, hit binary, items array<string>")))
            held.destroy()
    done = out.mapInArrow(pass_over(held, blocks == 1, finish(cleaned)), schema_with(own, "n_words bigint, n_hit bigint, items array<string>"))
    return opened(done, docs, ("n_words", "n_hit", "items"), _text=text)


def pass_over(held, first_pass: bool, last=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searched(batches)
        yield from last(found) if last else found

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        for batch in batches:
            for part in slices(batch, "_text", SHARD_BYTES):
                words, _, _, first = words_of(part.column("_text"))
                cover = np.zeros(len(words) + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for at, window in occurrences(phrases, words, first):
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + phrases.lens[window], 1)
                    doc = np.searchsorted(first, at, side="right") - 1
                    seen = np.unique(np.stack([doc, window], 1), axis=0)
                    counts = np.diff(phrases.item_first)[seen[:, 1]]
                    items = phrases.items[ragged(phrases.item_first[seen[:, 1]], counts)]
                    pairs.append(np.unique(np.stack([np.repeat(seen[:, 0], counts), items], 1), axis=0))
                hit = np.cumsum(cover[:-1]) > 0
                pairs = np.unique(np.concatenate(pairs), axis=0)
                cuts = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1))
                found_items = [phrases.ids[pairs[a:b, 1]].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
                if not first_pass:
                    before = np.unpackbits(np.frombuffer(b"".join(x.as_py() for x in part.column("hit")), np.uint8))
                    sizes = -(-np.diff(first) // 8) * 8
                    hit |= before[ragged(np.cumsum(sizes) - sizes, np.diff(first))] > 0
                    found_items = [in_order([*x, *y]) for x, y in zip(found_items, part.column("items").to_pylist(), strict=True)]
                bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield with_columns(part, {"n_words": pa.array(np.diff(first), pa.int64()), "hit": pa.array(bits, pa.binary()), "items": pa.array(found_items, pa.list_(pa.string()))})
        tidy()

    return run


def finish(cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column("_text"), []
            fresh = texts.to_pylist() if cleaned else None
            for i, (bits, n) in enumerate(zip(batch.column("hit").to_pylist(), batch.column("n_words").to_pylist(), strict=True)):
                hit = np.unpackbits(np.frombuffer(bits, np.uint8))[:n] > 0
                hits.append(int(hit.sum()))
                if cleaned and hits[-1]:
                    fresh[i] = without(texts.slice(i, 1), hit)
            new = {"n_words": batch.column("n_words"), "n_hit": pa.array(hits, pa.int64()), "items": batch.column("items")}
            if cleaned:
                at = batch.schema.get_field_index("_text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(fresh, texts.type))
            out = with_columns(batch, new)
            yield out.select([c for c in out.schema.names if c != "hit"])

    return run


def without(one: pa.Array, hit: np.ndarray) -> str:
    """The text without its runs of hit words."""
    _, begins, ends, _ = words_of(one)
    a, b, _ = spans_of(hit, np.array([0, len(hit)]))
    raw, out, last = one[0].as_py().encode(), [], 0
    for i, j in zip(begins[a], ends[b - 1], strict=True):
        out.append(raw[last:i])
        last = j
    return b"".join([*out, raw[last:]]).decode()


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = found(docs, read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS k
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY 1),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""
