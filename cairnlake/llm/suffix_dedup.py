"""Suffix-array dedup: bytes covered by strings that also start in an earlier document go.

Passages that may recur are found by their anchors and dealt, each distinct one of a shard once, into buckets by anchor.
A bucket's passages are one text, as long as it may be; external induced sorting gives its suffixes in order with their
common prefixes, and suffixes that share the window's length share the least document id of their group. Shards then meet
their passages again, with that id for each window. Passages of a bucket or shard are told apart by 64-bit hashes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, opened, ragged, read, schema_with, spans_of, tidy, whole_ids, with_columns
from cairnlake.llm.induced import FAR, Space, pieces, ranked, suffix_sort, windows
from cairnlake.llm.phrase_dedup import in_order
from cairnlake.llm.winnow import LAST_ID, Passages, Plan, Units, all_of, bucket_of, candidates, contents, dealt, groups, ids_of, plan_for, planes, shard_passages, spread, words_at

WINDOW, GRAM = 50, 16
#: Ends a passage in a bucket's text; no byte of UTF-8. Bytes are shifted up by one, so that 0 can end the text.
BREAK = 0xFF
#: Bytes of text whose anchors make a bucket, on average.
BUCKET = 4 << 20
#: Bytes that the sort of a bucket keeps in memory; the rest lies on its task's disk.
MEMORY = 256 << 20
#: Bytes of a column of one answer.
MOST = 1 << 30


def passage_rows(plan: Plan):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        docs = in_order(docs)
        rows = []
        if docs.num_rows and anchors.num_rows:
            units, found = shard_passages(docs, anchors, plan)
            keys = contents(words_at(units.data), found.start, found.count + plan.window - 1, *plan.lengths)
            _, at = np.unique(keys, return_index=True)
            ids = ids_of(docs)
            low, high = ids[found.text[at]], most_of(keys, ids[found.text])
            order = np.argsort(bucket_of(found.anchor[at], plan.buckets), kind="stable")
            at, low, high = at[order], low[order], high[order]
            some = found.pick(at)
            lens = some.count + plan.window - 1
            body = units.data[ragged(some.start, lens)]
            upto = np.concatenate([[0], np.cumsum(lens)])
            shard = docs["_shard"][0].as_py()
            if len(hot := np.sort(all_of(anchors["hot"]))):  # they go to their shard again, through any bucket
                rows.append([shard % plan.buckets, shard, planes(hot), *[b""] * 4])
            for k, a, b in groups(bucket_of(some.anchor, plan.buckets)):
                rows.append([k, shard, spread_bytes(low[a:b]), np.packbits(high[a:b] > low[a:b]).tobytes(), some.count[a:b].astype("u1").tobytes(), (some.place[a:b] - some.start[a:b]).astype("u1").tobytes(), body[upto[a] : upto[b]].tobytes()])
        tidy()
        names = ("bucket", "_shard", "least", "many", "count", "anchor", "body")
        return pa.table({n: pa.array([r[i] for r in rows], pa.binary() if i > 1 else pa.int32()) for i, n in enumerate(names)})

    return run


def spread_bytes(values: np.ndarray) -> bytes:
    """Numbers plane by plane: bytes of one weight together, as they compress."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def gathered(blob) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def most_of(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The greatest id of each distinct key, in the order of the keys."""
    order = np.lexsort((ids, keys))
    last = np.ones(len(keys), bool)
    last[:-1] = keys[order][1:] != keys[order][:-1]
    return ids[order[last]]


PASSAGE_SCHEMA = "bucket int, _shard int, least binary, many binary, count binary, anchor binary, body binary"


class Spool:
    """Numbers that come piece by piece: in memory up to a bound, beyond it in a file."""

    def __init__(self, kind, space: Space):
        self.kind, self.space, self.parts, self.file, self.size = np.dtype(kind), space, [], None, 0

    def add(self, values: np.ndarray) -> None:
        self.size += len(values)
        if self.file is None and values.nbytes <= self.space.left:
            self.space.left -= values.nbytes
            self.parts.append(values)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.space.on_disk += values.nbytes
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())

    def all(self, spare: int = 0) -> np.ndarray:
        """All numbers and as many zeros."""
        out, done = self.space.array(self.size + spare, self.kind), 0
        for x in self.parts:
            out[done : done + len(x)] = x
            done += len(x)
        self.space.free(*self.parts)
        self.parts = []
        if self.file is not None:
            self.file.seek(0)
            while raw := self.file.read(MOST // 64 * self.kind.itemsize):
                x = np.frombuffer(raw, self.kind)
                out[done : done + len(x)] = x
                done += len(x)
            self.file.close()
        return out


class Bucket:
    """The passages of a bucket, and of each distinct one the least id and where its windows begin in the bucket's text.

    A window holds its passage's anchor and, before or behind it, half of its other bytes or more. So a passage that occurs
    once, and shares neither the anchor with the half before nor that with the half behind with another one, has no window
    that recurs: it stays out of the text.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], plan: Plan, space: Space):
        window = plan.window
        self.hot: list[tuple[int, bytes]] = []
        kinds_of = (("body", np.uint8), ("count", np.uint8), ("anchor", np.uint8), ("own", np.int64), ("many", bool), ("shard", np.int32))
        spools = {n: Spool(k, space) for n, k in kinds_of}
        for batch in batches:
            for shard, least, many, count, anchor, body in zip(*(batch.column(n) for n in ("_shard", "least", "many", "count", "anchor", "body")), strict=True):
                counts = np.frombuffer(count.as_buffer(), np.uint8)
                if not len(counts):
                    self.hot.append((shard.as_py(), least.as_py()))
                    continue
                spools["body"].add(np.frombuffer(body.as_buffer(), np.uint8).copy())
                spools["count"].add(counts.copy())
                spools["anchor"].add(np.frombuffer(anchor.as_buffer(), np.uint8).copy())
                spools["own"].add(gathered(least.as_buffer()))
                spools["many"].add(np.unpackbits(np.frombuffer(many.as_buffer(), np.uint8))[: len(counts)] > 0)
                spools["shard"].add(np.full(len(counts), shard.as_py(), np.int32))
        body = spools["body"].all(8)
        self.count, anchor, self.own, self.many, self.shard = (spools[n].all() for n in ("count", "anchor", "own", "many", "shard"))
        n = len(self.count)
        begins, self.key = space.array(n, np.int64), space.array(n, np.uint64)
        words, done = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,)), 0
        for s in pieces(n):
            lens = self.count[s].astype(np.int64) + window - 1
            begins[s] = done + np.cumsum(lens) - lens
            self.key[s] = contents(words, begins[s], lens, *plan.lengths)
            done += int(lens.sum())
        self.kind, kinds = numbered(self.key, space)
        self.one, self.least, times = space.array(kinds, self.kind.dtype), space.array(kinds, np.int64), space.array(kinds, np.int32)
        self.least[:] = LAST_ID
        for s in pieces(n):
            self.one[self.kind[s]] = np.arange(s.start, s.stop)
            np.minimum.at(self.least, self.kind[s], self.own[s])
            np.add.at(times, self.kind[s], 1 + self.many[s])
        sides = [space.array(kinds, np.uint64) for _ in range(2)]
        half = (window - plan.gram + 1) // 2
        for s in pieces(kinds):
            one = self.one[s]
            before, behind = begins[one] + anchor[one] - half, begins[one] + anchor[one]
            spans = np.full(len(one), half + plan.gram)
            whole = (anchor[one] >= half, self.count[one] + window - 1 - anchor[one].astype(np.int64) >= half + plan.gram)
            for side, at, ok, k in zip(sides, (before, behind), whole, (0, 1), strict=True):
                found = contents(words, np.where(ok, at, 0), spans, half + plan.gram, half + plan.gram)
                side[s] = np.where(ok, found, np.arange(s.start, s.stop, dtype=np.uint64) * np.uint64(2) + np.uint64(k))
        self.apart = space.array(kinds, bool)  # no window recurs
        self.apart[:] = times[:] == 1
        for side in sides:
            number, many = numbered(side, space)
            met = space.array(many, np.int32)
            for s in pieces(kinds):
                np.add.at(met, number[s], 1)
            for s in pieces(kinds):
                self.apart[s] &= met[number[s]] == 1
            space.free(number, met)
        space.free(times, *sides)
        self.upto = space.array(kinds + 1, np.int64)  # windows in the text
        for s in pieces(kinds):
            self.upto[s.start + 1 : s.stop + 1] = np.where(self.apart[s], 0, self.count[self.one[s]])
        np.cumsum(self.upto, out=self.upto)
        total, held = int(self.upto[-1]), kinds - int(np.count_nonzero(self.apart))
        self.text = space.array(total + held * window + 1, np.uint8)
        self.place = space.array(len(self.text), np.int32 if total < FAR else np.int64)  # of windows: their number and one
        done = 0
        for s in pieces(kinds):
            some = np.flatnonzero(~self.apart[s]) + s.start
            count = self.count[self.one[some]].astype(np.int64)
            lens = count + window
            stops = np.cumsum(lens) - 1
            inside = np.ones(int(lens.sum()), bool)
            inside[stops] = False
            piece = np.full(len(inside), BREAK, np.uint8)
            piece[inside] = body[ragged(begins[self.one[some]], lens - 1)] + 1
            self.text[done : done + len(piece)] = piece
            self.place[done + ragged(stops + 1 - lens, count)] = np.arange(self.upto[s.start], self.upto[s.stop]) + 1
            done += len(piece)
        space.free(body, begins, anchor)


def numbered(keys: np.ndarray, space: Space) -> tuple[np.ndarray, int]:
    """(a number for each key, the same for equal ones; how many numbers)."""
    order = ranked(keys, np.int32 if len(keys) < FAR else np.int64, space)
    out, total, before = space.array(len(keys), order.dtype), 0, None
    for s in pieces(len(keys)):
        own = keys[order[s]]
        new = np.concatenate([[before is None or own[0] != before], own[1:] != own[:-1]])
        out[order[s]] = total - 1 + np.cumsum(new)
        total, before = total + int(new.sum()), own[-1]
    space.free(order)
    return out, total


def least_ids(bucket: Bucket, window: int, space: Space) -> np.ndarray:
    """The least id of all passages that hold each window, from the order of the suffixes."""
    at, common = suffix_sort(bucket.text, 256, space)
    many = int(bucket.upto[-1])
    owner, number, group = space.array(many, np.int64), space.array(many, bucket.place.dtype), space.array(many, np.int32 if many < FAR else np.int64)
    for s in pieces(len(bucket.one)):
        owner[bucket.upto[s.start] : bucket.upto[s.stop]] = np.repeat(bucket.least[s], np.diff(bucket.upto[s.start : s.stop + 1]))
    done, groups_of, last = 0, 0, -1
    for suffixes, numbers in windows(at, common, window):  # those that begin a window, and their groups
        place = bucket.place[suffixes]
        ok = place > 0
        kept = numbers[ok]
        if not len(kept):
            continue
        fresh = np.cumsum(np.concatenate([[kept[0] != last], kept[1:] != kept[:-1]]))
        number[done : done + len(kept)], group[done : done + len(kept)] = place[ok] - 1, groups_of - 1 + fresh
        groups_of, last, done = groups_of + int(fresh[-1]), kept[-1], done + len(kept)
    space.free(at, common)
    least = space.array(groups_of, np.int64)
    least[:] = LAST_ID
    for s in pieces(many):
        g = group[s]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        least[g[head]] = np.minimum(least[g[head]], np.minimum.reduceat(owner[number[s]], head))
    for s in pieces(many):
        owner[number[s]] = least[group[s]]
    space.free(least, number, group)
    return owner


def sorted_bucket(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: each passage of a shard with the least ids of its windows, where one is less than an own id of the shard."""
        space = Space(MEMORY)
        bucket = Bucket(batches, plan, space)
        first = least_ids(bucket, plan.window, space)
        low = bucket.least.copy()
        held = np.flatnonzero(~bucket.apart)
        if len(held):
            low[held] = np.minimum.reduceat(first, bucket.upto[held])
        keep = np.flatnonzero(~bucket.apart[bucket.kind] & (bucket.many | (low[bucket.kind] < bucket.own)))
        keep = keep[np.argsort(bucket.shard[keep], kind="stable")]
        for s in pieces(len(keep)):
            rows = []
            for k, a, b in groups(bucket.shard[keep[s]]):
                some = keep[s][a:b]
                counts = bucket.count[some].astype(np.int64)
                each = first[ragged(bucket.upto[bucket.kind[some]], counts)]
                start = np.zeros(len(each), bool)
                start[np.cumsum(counts) - counts] = True
                start[1:] |= each[1:] != each[:-1]
                run_at = np.flatnonzero(start)
                runs = np.diff(np.searchsorted(run_at, np.concatenate([[0], np.cumsum(counts)])))
                rows.append((k, bucket.key[some].tobytes(), runs.astype("u1").tobytes(), np.diff(np.append(run_at, len(each))).astype("u1").tobytes(), spread_bytes(each[run_at])))
            yield sorted_rows([(*r, b"") for r in rows])
        yield sorted_rows([(k, *[b""] * 4, hot) for k, hot in bucket.hot])
        del bucket, first, low, keep
        tidy()

    return run


SORTED = ("_shard", "key", "runs", "size", "first", "hot")
SORTED_SCHEMA = "_shard int, " + ", ".join(f"{c} binary" for c in SORTED[1:])


def sorted_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(len(SORTED))], [*SORTED])


def cut_out(plan: Plan):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = in_order(docs)
        units = Units.of(docs["_text"], False)
        gone = np.zeros(len(units.data) + 1, np.int32)
        if any(map(len, known["key"].to_pylist())):
            keys, runs, size = (np.frombuffer(b"".join(known[n].to_pylist()), t) for n, t in (("key", "<u8"), ("runs", "u1"), ("size", "u1")))
            first = np.concatenate([gathered(x) for x in known["first"].to_pylist()])
            order = np.argsort(keys, kind="stable")
            run_at = np.cumsum(runs.astype(np.int64)) - runs
            found = spread(Passages.of(units, plan.window, plan.gram), all_of(known["hot"]), units, plan)
            own = contents(words_at(units.data), found.start, found.count + plan.window - 1, *plan.lengths)
            at = np.minimum(np.searchsorted(keys, own, sorter=order), len(keys) - 1)
            met = np.flatnonzero(keys[order[at]] == own)
            entry = order[at[met]]
            many = runs[entry].astype(np.int64)
            flat = ragged(run_at[entry], many)
            part = np.repeat(met, many)
            lens = size[flat].astype(np.int64)
            # the first window of each run: runs of one passage follow one another
            upto = np.cumsum(lens) - lens
            head = np.cumsum(many) - many
            begins = found.start[part] + upto - np.repeat(upto[head], many) if len(part) else part
            later = first[flat] < ids_of(docs)[found.text[part]]
            begins, lens = begins[later], lens[later]
            np.add.at(gone, begins, 1)
            np.subtract.at(gone, begins + lens + plan.window - 1, 1)
        out = np.cumsum(gone[:-1]) > 0
        _, _, spans = spans_of(out, units.off)
        stays = np.concatenate([[0], np.cumsum(~out)])[units.off]
        new = {
            "n_bytes": pa.array(np.diff(units.off), pa.int64()),
            "n_removed": pa.array(np.diff(units.off) - np.diff(stays), pa.int64()),
            "n_spans": pa.array(np.diff(spans), pa.int64()),
        }
        answers = []
        for _, a, b in groups(stays[1:] // MOST):
            kept = np.ascontiguousarray(units.data[units.off[a] : units.off[b]][~out[units.off[a] : units.off[b]]])
            blobs = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((stays[a : b + 1] - stays[a]).astype(np.int32)), pa.py_buffer(kept)])
            part = pa.RecordBatch.from_arrays([c.slice(a, b - a).combine_chunks() for c in docs.columns], docs.schema.names)
            done = with_columns(part, {**{n: x.slice(a, b - a) for n, x in new.items()}, "kept": blobs})
            answers.append(done.select([c for c in done.schema.names if c != "_shard"]))
        tidy()
        return pa.Table.from_batches(answers)

    return run


NEW = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay).

    A byte goes if a string of ``window`` bytes that covers it also starts in a row of smaller id. Ids are whole numbers;
    null ids come after all others; null texts are empty, and long ones of any length are read whole; rows that repeat an
    id keep what only they share. Own columns named like the new ones, in any case, are replaced; empty tables stay empty.
    """
    if not 8 <= window <= 128:
        raise ValueError("windows have 8 to 128 bytes")
    whole_ids(docs, key)
    own = enclosed(docs, _id=key, _text=text)
    plan = plan_for(own, window, min(GRAM, window), False, True, BUCKET)
    rows = dealt(own, plan)
    shards = rows.groupBy("_shard")
    anchors = candidates(rows, plan)
    found = shards.cogroup(anchors.groupBy("_shard")).applyInArrow(passage_rows(plan), PASSAGE_SCHEMA)
    known = found.groupBy("bucket").applyInArrow(sorted_bucket(plan), SORTED_SCHEMA)
    done = shards.cogroup(known.groupBy("_shard")).applyInArrow(cut_out(plan), schema_with(own, NEW))
    return opened(done, docs, ("n_bytes", "n_removed", "n_spans", "kept"), _id=key, _text=text)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(array_slice(b, i, i + {WINDOW - 1})) AS k FROM d, unnest(range(1, n - {WINDOW - 2})) AS t(i)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM win JOIN firsts USING (k) WHERE f < doc_id),
island AS (SELECT doc_id, i, count(*) FILTER (WHERE step IS NULL OR step > {WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW - 1} AS z FROM island GROUP BY doc_id, s),
edges AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM span UNION ALL SELECT doc_id, n + 1, n, (SELECT coalesce(max(z), 0) FROM span s WHERE s.doc_id = d.doc_id) FROM d),
parts AS (SELECT doc_id, string_agg(CASE WHEN p + 1 < a THEN hex(array_slice(b, p + 1, a - 1)) ELSE '' END, '' ORDER BY a) AS h, sum(z - a + 1) AS r, count(*) - 1 AS c FROM edges JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(r AS BIGINT) AS n_removed, CAST(c AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN parts USING (doc_id)
"""


def characters(kept: Column) -> Column:
    """Bytes as text, without the characters of which a cut left a part."""

    def decode(kept: pd.Series) -> pd.Series:
        return kept.map(lambda x: None if x is None else x.decode("utf-8", "ignore"))

    return F.pandas_udf(decode, "string")(kept)
