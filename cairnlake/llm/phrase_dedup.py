"""Substring dedup by repeated-phrase automata.

Passages that may recur are found by their anchors; each shard sends its distinct passages to the buckets of their
anchors, where the windows that recur are confirmed and get their first occurrence. Each shard then compiles its own
confirmed passages into Aho-Corasick automata over word numbers, of bounded size, and streams all its documents through
them: every occurrence of a passage loses the windows that start earlier elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, opened, ragged, read, schema_with, whole_ids, with_columns
from cairnlake.llm.winnow import Plan, Units, bucket_of, candidates, dealt, distinct, groups, hashes, ids_of, plan_for, shard_passages

WINDOW, GRAM = 20, 8
#: Words of the passages in one automaton.
AUTOMATON_WORDS = 2_000_000
ENTRY = (("anchor", "<u8"), ("id", "<i8"), ("start", "<i4"), ("at", "<i4"), ("count", "u1"), ("times", "u1"))


def in_order(docs: pa.Table) -> pa.Table:
    """A shard's rows in one fixed order: by id (nulls last), then text."""
    return docs.take(pc.sort_indices(docs, sort_keys=[("_id", "ascending"), ("_text", "ascending")]))


def passage_rows(plan: Plan):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        docs = in_order(docs)
        rows = []
        if docs.num_rows and anchors.num_rows:
            units, found = shard_passages(docs, anchors, plan)
            _, at, times = distinct(found, plan)
            order = np.argsort(bucket_of(found.anchor[at], plan.buckets), kind="stable")
            at, times = at[order], times[order]
            some = found.pick(at)
            fields = {"anchor": some.anchor, "id": ids_of(docs)[some.text], "start": some.start - units.off[some.text], "at": some.start, "count": some.count, "times": np.minimum(times, 2)}
            first = ragged(some.start, some.count)
            window = hashes(found.prefix, first, first + plan.window)
            upto = np.concatenate([[0], np.cumsum(some.count)])
            shard = docs["_shard"][0].as_py()
            for k, a, b in groups(bucket_of(some.anchor, plan.buckets)):
                rows.append([k, shard, *(fields[n][a:b].astype(t).tobytes() for n, t in ENTRY), window[upto[a] : upto[b]].astype("<u8").tobytes()])
        names = ["bucket", "_shard", *(n for n, _ in ENTRY), "windows"]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * (len(ENTRY) + 1)]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return run


PASSAGE_SCHEMA = "bucket int, _shard int, " + ", ".join(f"{n} binary" for n, _ in ENTRY) + ", windows binary"


def entries(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(fields of all entries of a table of passages, their shards)."""
    out = {n: np.frombuffer(b"".join(table[n].to_pylist()), t) for n, t in ENTRY}
    lens = [len(x) // 4 for x in table["at"].to_pylist()]
    return out, np.repeat(table["_shard"].to_numpy(), lens)


def confirmed(table: pa.Table) -> pa.Table:
    """Of one bucket: the passages with a window that recurs, and the first occurrence of each window, by shard."""
    e, shard = entries(table)
    window = np.frombuffer(b"".join(table["windows"].to_pylist()), "<u8")
    count = e["count"].astype(np.int64)
    of = np.repeat(np.arange(len(count)), count)
    place = ragged(np.zeros(len(count), np.int64), count)
    ids, starts = e["id"][of], e["start"][of] + place
    order = np.lexsort((starts, ids, window, e["anchor"][of]))
    new = np.ones(len(order), bool)
    new[1:] = (window[order][1:] != window[order][:-1]) | (e["anchor"][of][order][1:] != e["anchor"][of][order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first_id, first_start = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    first_id[order], first_start[order] = ids[head], starts[head]
    moved = (first_id != ids) | (first_start != starts)
    keep = e["times"] > 1
    np.logical_or.at(keep, of, moved)
    by = np.flatnonzero(keep)
    by = by[np.argsort(shard[by], kind="stable")]
    upto = np.concatenate([[0], np.cumsum(count)])
    rows = []
    for k, a, b in groups(shard[by]):
        some = by[a:b]
        flat = ragged(upto[some], count[some])
        rows.append((k, e["at"][some].tobytes(), e["count"][some].tobytes(), first_id[flat].astype("<i8").tobytes(), (first_start - place)[flat].astype("<i4").tobytes()))
    names = ("_shard", "at", "count", "first_id", "first_start")
    return pa.table({n: pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i, n in enumerate(names)})


CONFIRMED_SCHEMA = "_shard int, at binary, count binary, first_id binary, first_start binary"


def locate(codes: np.ndarray, off: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, passages) of every occurrence of the passages [at, at + len) in the documents."""
    import ahocorasick

    begins, which = [], []
    texts = [tuple(codes[a:b].tolist()) for a, b in zip(off, off[1:], strict=False)]
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(lens) // AUTOMATON_WORDS)) + 1):
        if not len(part):
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i in part.tolist():
            automaton.add_word(tuple(codes[at[i] : at[i] + lens[i]].tolist()), i)
        automaton.make_automaton()
        for base, words in zip(off.tolist(), texts, strict=False):
            for end, i in automaton.iter(words):
                begins.append(base + end + 1)
                which.append(i)
    which = np.array(which, np.int64)
    return np.array(begins, np.int64) - lens[which], which


def stream(plan: Plan):
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        docs = in_order(docs)
        units = Units.of(docs["_text"], True)
        words, off = units.strings(), units.off
        gone = np.zeros(len(words) + 1, np.int64)
        if passages.num_rows and len(words):
            at, count, first_id, first_start = (np.frombuffer(b"".join(passages[n].to_pylist()), t) for n, t in (("at", "<i4"), ("count", "u1"), ("first_id", "<i8"), ("first_start", "<i4")))
            count = count.astype(np.int64)
            codes = words.dictionary_encode().indices.to_numpy()
            begins, which = locate(codes, off, at.astype(np.int64), count + plan.window - 1)
            upto = np.cumsum(count) - count
            many = count[which]
            place = ragged(np.zeros(len(which), np.int64), many)
            flat = ragged(upto[which], many)
            window = np.repeat(begins, many) + place
            doc = np.searchsorted(off, window, side="right") - 1
            own_id, own_start = ids_of(docs)[doc], window - off[doc]
            earlier = (first_id[flat] < own_id) | (first_id[flat] == own_id) & (first_start[flat] + place < own_start)
            window = np.unique(window[earlier])
            gone[window] += 1
            np.subtract.at(gone, window + plan.window, 1)
        kept = np.cumsum(gone[:-1]) == 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto[off], pa.int32()), words.filter(pa.array(kept)).cast(pa.binary())), b" ").cast(pa.string())
        sizes = np.diff(off)
        batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in docs.columns], docs.schema.names)
        out = with_columns(batch, {"n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(sizes - np.diff(upto[off]), pa.int64()), "kept": joined})
        return pa.Table.from_batches([out.select([c for c in out.schema.names if c != "_shard"])])

    return run


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row of smaller id, or earlier in
    a row of the same id. Ids are whole numbers; null ids come after all others; null texts have no words, and long ones
    of any length are read whole; of rows that repeat an id and a text none is earlier than the other. Own columns named
    like the new ones, in any case, are replaced; empty tables stay empty.
    """
    whole_ids(docs, key)
    own = enclosed(docs, _id=key, _text=text)
    plan = plan_for(own, window, min(GRAM, window), True, False)
    rows = dealt(own, plan)
    lean = rows.groupBy("_shard")
    anchors = candidates(rows, plan)
    found = lean.cogroup(anchors.groupBy("_shard")).applyInArrow(passage_rows(plan), PASSAGE_SCHEMA)
    known = found.groupBy("bucket").applyInArrow(confirmed, CONFIRMED_SCHEMA)
    done = lean.cogroup(known.groupBy("_shard")).applyInArrow(stream(plan), schema_with(own, "n_words bigint, n_removed bigint, kept string"))
    return opened(done, docs, ("n_words", "n_removed", "kept"), _id=key, _text=text)


def op7_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    found = removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
firsts AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, j FROM firsts, unnest(range(i, i + {WINDOW})) AS t(j) WHERE r > 1),
each AS (SELECT doc_id, w, j FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT e.doc_id, string_agg(w[j], ' ' ORDER BY j) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
