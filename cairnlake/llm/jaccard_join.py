"""N-gram Jaccard join over count-vector R-trees.

A text's set are its distinct word shingles, as 64-bit hashes. Equal sets become one node. A node's shingle counts in 128
hash groups are a point, and the sum of the coordinate minima of two points bounds the overlap of their sets.

Points are partitioned before they are indexed. Linked sets of sizes a <= b differ in few shingles (at 90 of 100: a // 9),
so when a size band cuts its shingles into more hashed groups than that, linked sets have a whole group in common: points
that share a group of equal content make a block. Each block's points are packed into an R-tree by size, boxes whose
summed minima fall below the needed overlap are left out, and the surviving pairs are verified on their sets; a block of
one leaf is tried pair by pair under the same bound, and a large block is split into trees that each seeker visits.

For components a node first meets the node that it shares most blocks with. Then, round after round, the nodes of a block
outside its largest component propose their likeliest untried partners of other components, more in each round, until
no block holds a pair that the bound allows and that was not tried: no link between components is lost, and pairs within
one component cost nothing. links() tries those as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import GAP, LOWER, contained, cut, drop, enclosed, opened, ragged, read, slices, spans_of, text_bytes, tidy, whole_ids, written
from cairnlake.llm.winnow import BUCKET_BYTES, LAST_ID, LEAST, TABLE, groups, hashes, mix, planes, rolling, sums, unplaned

SHINGLE, PERCENT = 3, 90
COORDINATES, FANOUT = 128, 16
#: Sizes of one band lie within this ratio.
BAND = 1.25
#: Blocks up to this size are tried pair by pair, without a tree.
LEAF = 16
#: Rows of a list that is broadcast: of two numbers each.
SHORT = 400_000
#: So many untried partners a node proposes in the first round, and so many times as many in each round after.
FIRST, MORE = 4, 16
#: Nodes of one tree; a larger block has several.
TREE = 2048
SLICE_BYTES = 2 << 20
#: Rows that a bucket gathers before it merges equal ones.
MERGED = 1 << 21


@dataclass(frozen=True)
class Rule:
    """Sets are linked when 100 * intersection >= percent * union."""

    size: int = SHINGLE
    percent: int = PERCENT

    def __post_init__(self):
        if not 50 < self.percent <= 100 or self.size < 1:
            raise ValueError("a similarity above 50 and at most 100 percent, of shingles of a word or more")

    @property
    def slack(self) -> float:
        """Groups besides those that linked sets may differ in, as a share of these."""
        return 0.15 if self.percent >= 89 else 0.1

    @property
    def small(self) -> int:
        """Blocks are of groups of so many shingles at least, unless a set has too few of them."""
        return 3 if self.percent >= 89 else 1

    def groups(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups of a size band, groups that linked sets may differ in)."""
        top = np.ceil(np.exp((band + 1) * np.log(BAND)) - 0.5).astype(np.int64)  # sizes of the band are below
        differ = np.maximum(top, 1) * (100 - self.percent) // self.percent
        return np.where(differ == 0, 0, differ + 1 + np.ceil(self.slack * differ).astype(np.int64)), differ


def shingle_sets(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, each text's sorted; the texts' first ones, n + 1)."""
    data, off = text_bytes(col)
    data = LOWER[data]
    begins, ends, first = spans_of(~GAP[data], off)
    prefix = sums(hashes(sums(TABLE[data]), begins, ends))
    lens = np.diff(first)
    many = np.where(lens >= size, lens - size + 1, np.minimum(lens, 1))
    start = ragged(first[:-1], many)
    text = np.repeat(np.arange(len(lens)), many)
    found = hashes(prefix, start, np.minimum(start + size, first[text + 1]))
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(lens) + 1))


def totals(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def nodes_of(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(totals(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), off) + np.diff(off).astype(np.uint64))


def points(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The counts of each set's shingles in hash groups."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(text * COORDINATES + (sets >> np.uint64(7)).astype(np.int64) % COORDINATES, minlength=(len(off) - 1) * COORDINATES).reshape(-1, COORDINATES).astype(np.int32)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1) + 0.5) / np.log(BAND)).astype(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(block, text) of every text: groups of its own band, and of the bands down to that of the smallest partners."""
    n = np.diff(off)
    own = band_of(n)
    least = band_of(-(-n * rule.percent // 100))
    blocks, texts = [], []
    for down in range(int((own - least).max(initial=0)) + 1):
        band, chosen = own - down, (n > 0) & (own - down >= least)
        number, differ = rule.groups(band)
        number = np.where(chosen, number, 0)
        at = np.flatnonzero(number)
        if not len(at):
            continue
        lens = n[at]
        values = sets[ragged(off[:-1][at], lens)]
        base = np.cumsum(number[at]) - number[at]
        group = np.repeat(base, lens) + (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.repeat(number[at].astype(np.uint64), lens)).astype(np.int64)
        total = int(number[at].sum())
        size = np.bincount(group, minlength=total)
        order = np.argsort(group, kind="stable")
        content = totals(mix(values[order] ^ np.uint64(0x94D049BB133111EB)), np.concatenate([[0], np.cumsum(size)]))
        text = np.repeat(np.arange(len(at)), number[at])
        place = np.arange(total) - base[text]
        small = size < rule.small
        weak = np.bincount(text, small, minlength=len(at)) >= number[at] - differ[at]
        keep = ~small | weak[text]
        block = mix(content + mix((band[at][text] << 40 | place << 8 | np.minimum(size, 255)).astype(np.uint64)))
        blocks.append(block[keep])
        texts.append(at[text][keep])
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(blocks), np.concatenate(texts)


def set_rows(text: str, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                sets, off = shingle_sets(part.column(text), rule.size)
                held = points(sets, off)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(np.minimum(held, 255).astype(np.uint8)))])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(np.diff(off), pa.int64()), pa.array(nodes_of(sets, off).view(np.int64)), rows.cast(pa.binary())], ["id", "hash", "n", "node", "point"])
        tidy()

    return run


def block_rows(text: str, rule: Rule, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                sets, off = shingle_sets(part.column(text), rule.size)
                node = nodes_of(sets, off)
                _, once = np.unique(node, return_index=True)  # one of each set
                lone = np.zeros(len(node), bool)
                lone[once] = True
                block, at = signatures(sets, off, rule)
                keep = lone[at]
                block, at = block[keep], node[at[keep]]
                bucket = ((block >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((block & np.uint64((1 << 48) - 1), bucket))
                block, at, bucket = block[order], at[order], bucket[order]
                rows = []
                for k, a, b in groups(bucket):
                    names, which = np.unique(at[a:b], return_inverse=True)
                    rows.append((k, planes(block[a:b]), names.astype("<u8").tobytes(), which.astype("<u2" if len(names) < 65536 else "<u4").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "node", "which"])
        tidy()

    return run


def once(block: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort((node, block))
    block, node = block[order], node[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (node[1:] != node[:-1])
    return block[new], node[new]


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: the blocks of two nodes or more, with their nodes and the least of them as leader.

    Copies of a node that come from many tasks are merged on the way.
    """
    blocks, nodes, held, kept, bucket = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0, 0
    for batch in batches:
        for part, names, which in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "which")), strict=True):
            own = np.frombuffer(names, "<u8")
            blocks.append(unplaned(part))
            nodes.append(own[np.frombuffer(which, "<u2" if len(own) < 65536 else "<u4")].view(np.int64))
            held += len(blocks[-1])
        bucket = batch.column("bucket")[0].as_py() if batch.num_rows else bucket
        if held > 2 * kept + MERGED:
            merged = once(np.concatenate(blocks), np.concatenate(nodes))
            blocks, nodes = [merged[0]], [merged[1]]
            held = kept = len(merged[0])
    block, node = once(np.concatenate(blocks), np.concatenate(nodes))
    del blocks, nodes
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(block)))
    keep = np.repeat(size > 1, size)
    yield pa.RecordBatch.from_arrays([pa.array(block[keep].view(np.int64)), pa.array(np.full(int(keep.sum()), bucket), pa.int32()), pa.array(node[keep]), pa.array(np.repeat(node[head], size)[keep])], ["block", "bucket", "node", "leader"])


class RTree:
    """Points of counts under boxes of coordinate maxima, packed level by level in the order of size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:3], sizes))
        top, low = points[self.order], sizes[self.order]
        self.levels = [(top, low)]
        while len(top) > 1:
            cuts = np.arange(0, len(top), FANOUT)
            top, low = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))

    def partners(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The points whose overlap with a point may be large enough."""
        at = np.zeros(1, np.int64)
        for k, (top, low) in enumerate(reversed(self.levels)):
            if k:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                at = at[at < len(top)]
            bound = np.minimum(top[at], point).sum(1, dtype=np.int64)
            at = at[bound * (100 + percent) >= percent * (size + low[at])]
        return self.order[at]


def likeness(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The most percent of similarity that the counts of pairs of points allow: summed coordinate minima bound the overlap."""
    both = np.minimum(np.minimum(x, y).sum(1, dtype=np.int64), np.minimum(nx, ny))
    return 100.0 * both / np.maximum(nx + ny - both, 1)


def points_of(col: pa.Array) -> np.ndarray:
    held = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    if len(held) and held.max() == 255:  # a count that large may be larger
        held = np.where(held == 255, 1 << 24, held.astype(np.int32))
    return held


def bounded(rule: Rule):
    """Keeps the pairs (a, b, na, nb, pa, pb) whose counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = likeness(points_of(batch.column("pa")), points_of(batch.column("pb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= rule.percent
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


PLACE = ("block", "bucket", "chunk")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a chunk of a block ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in PLACE:
            x = batch.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new) + 1
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in PLACE):
            cuts = np.append(0, cuts)
        if len(cuts):
            last = int(cuts[-1])
            done = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(done)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def likeliest(pairs: np.ndarray, score: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the distinct pairs (seeker, partner) that are among the ``most`` likeliest of their seeker, whether it has more)."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = np.any(pairs[order][1:] != pairs[order][:-1], axis=1)
    order = order[new]
    order = order[np.lexsort((-score[order], pairs[order, 0]))]
    own = pairs[order, 0]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(own)))
    keep = np.arange(len(own)) - np.repeat(head, size) < most[order]
    return order[keep], (np.repeat(size, size) > most[order])[keep]


def across(rule: Rule, most: int):
    """Of sorted chunks of blocks: (a, b, score) of seekers and members of other components whose counts allow a link.

    A seeker ``a`` names its likeliest ``most`` partners, and one more for each pair of it that was tried in vain; ``more``
    where it has others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            block, bucket, chunk, node, comp, size, member, seek, vain = (table[c].to_numpy() for c in (*PLACE, "node", "comp", "n", "member", "seek", "vain"))
            held = points_of(table["point"])
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])])
            head = np.flatnonzero(new)
            lens = np.diff(np.append(head, len(block)))
            out, scores, limits = [np.zeros((0, 2), np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]

            def keep(x: np.ndarray, y: np.ndarray) -> None:
                apart = (comp[x] != comp[y]) & seek[x] & member[y]  # noqa: B023
                x, y = x[apart], y[apart]
                score = likeness(held[x], held[y], size[x], size[y])  # noqa: B023
                ok = np.flatnonzero(score >= rule.percent)
                score, x, y = score[ok], x[ok], y[ok]
                if len(ok) and x[0] == x[-1] and len(ok) > most + vain[x[0]] + 1:  # noqa: B023  one seeker's
                    best = np.argpartition(-score, most + vain[x[0]] + 1)[: most + vain[x[0]] + 1]  # noqa: B023
                    score, x, y = score[best], x[best], y[best]
                out.append(np.stack([node[x], node[y]], 1))  # noqa: B023
                scores.append(score)  # noqa: B023
                limits.append(most + vain[x])  # noqa: B023

            for many in range(2, LEAF + 1):  # blocks of a leaf: all at once
                at = head[lens == many]
                for k in range(0, len(at), 50_000):
                    for i in range(many):
                        for j in range(many):
                            if i != j:
                                keep(at[k : k + 50_000] + i, at[k : k + 50_000] + j)
            for a, n in zip(head[lens > LEAF], lens[lens > LEAF], strict=True):
                tree = RTree(held[a : a + n], size[a : a + n])
                for i in np.flatnonzero(seek[a : a + n]) + a:
                    j = tree.partners(held[i], int(size[i]), rule.percent) + a
                    keep(np.full(len(j), i), j)
            pairs, score = np.concatenate(out), np.concatenate(scores)
            best, more = likeliest(pairs, score, np.concatenate(limits))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[best, 0], pa.int64()), pa.array(pairs[best, 1], pa.int64()), pa.array(score[best], pa.float64()), pa.array(more)], ["a", "b", "score", "more"])
        tidy()

    return run


def sets_of(text: str, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                sets, off = shingle_sets(part.column(text), rule.size)
                node, wanted = nodes_of(sets, off).view(np.int64), part.column("node").to_numpy()
                for i in range(part.num_rows):
                    if node[i] == wanted[i] and int(node[i]) not in done:
                        done.add(int(node[i]))
                    else:
                        node[i] = wanted[i] + 1  # a row that repeats an id
                at = np.flatnonzero(node == wanted)
                blobs = [planes(sets[off[i] : off[i + 1]] >> np.uint64(16)) for i in at]  # sorted; 48 bits tell the shingles of two texts apart
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(blobs, pa.binary())], ["node", "set"])
        tidy()

    return run


def verified(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = unplaned(x.as_py()), unplaned(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def verify(pairs: DataFrame, slim: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b), and whether their sets are ``linked``; sets are drawn from the texts of the pairs' nodes alone.

    The list of these texts is broadcast while it is short, and joined by shuffle beyond ``SHORT`` rows.
    """
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    needed = cut(ends.join(nodes.select("node", "rep.*"), "node"))
    named = slim.join(F.broadcast(needed) if needed.count() <= SHORT else needed, ["id", "hash"]).select("node", "text")
    held = cut(named.mapInArrow(sets_of("text", rule), "node bigint, set binary"))
    with_x = pairs.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return with_x.join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(verified(rule), "a bigint, b bigint, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of the edges (a, b) can reach, by spreading and jumping labels."""
    both = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        spread = labels.join(near, "node").select("node", F.least("comp", "_near").alias("comp"), F.col("comp").alias("_old"))
        far = spread.select(F.col("node").alias("comp"), F.col("comp").alias("_far"))
        fresh = cut(spread.join(far, "comp").select("node", F.least("comp", "_far").alias("comp"), "_old"))
        labels = fresh.select("node", "comp")
        if fresh.where("comp <> _old").isEmpty():
            return labels


def grown(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, comp) after more edges (a, b): only the edges between components are followed."""
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node"))
    if comps is None:
        return components(edges)
    known = cut(comps.unionAll(ends).groupBy("node").agg(F.min("comp").alias("comp")))
    side = lambda x, y: known.select(F.col("node").alias(x), F.col("comp").alias(y))
    between = edges.join(side("a", "_a"), "a").join(side("b", "_b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    moved = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    return cut(known.join(moved, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp")))


def indexed(slim: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(id, hash, n, node, point) of the rows, (node, rep, n, point) of the distinct sets, (block, bucket, node, leader) of shared blocks and where they are written."""
    total = slim.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    rows = cut(slim.mapInArrow(set_rows("text", rule), "id bigint, hash bigint, n bigint, node bigint, point binary"))
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("rep"), F.min("n").alias("n"), F.min("point").alias("point"))
    buckets = max(LEAST, -(-total // BUCKET_BYTES))
    blocks = slim.mapInArrow(block_rows("text", rule, buckets), "bucket int, block binary, node binary, which binary")
    return rows, nodes, *written(blocks.groupBy("bucket").applyInArrow(members, "block bigint, bucket int, node bigint, leader bigint"))


def proposed(part: DataFrame, nodes: DataFrame, vain: DataFrame | None, active: DataFrame | None, rule: Rule, most: int) -> DataFrame:
    """(a, b, score, more) of the pairs that seekers propose in blocks (block, bucket, node, comp) of several components.

    Seekers are the nodes outside the largest component of a block or, where ``active`` (node) names some, these; ``vain``
    (node, vain) counts the pairs of a node that were tried in vain. A block of more than ``TREE`` nodes is split by the hash of its nodes, and its seekers visit every chunk.
    """
    own = ["block", "bucket"]
    rows = part.withColumn("_seek", F.lit(True)) if active is None else part.join(active.withColumn("_seek", F.lit(True)), "node", "left").fillna(False, "_seek")
    about = nodes.select("node", "n", "point")
    about = about.withColumn("vain", F.lit(0).cast("long")) if vain is None else about.join(vain, "node", "left").fillna(0, "vain")
    parts = rows.groupBy(*own, "comp").agg(F.count("*").alias("_n"), F.max("_seek").alias("_any"))
    mixed = parts.groupBy(*own).agg(F.sum("_n").alias("_size"), F.max_by("comp", F.struct("_n", "comp")).alias("_main"), F.count("*").alias("_comps"), F.max("_any").alias("_any")).where("_comps > 1 and _any")
    chunks = F.ceil(F.col("_size") / TREE).cast("int")
    home = F.pmod(F.xxhash64("node"), chunks).cast("int")
    seek = F.col("comp") != F.col("_main") if active is None else F.col("_seek")
    places = F.when(seek, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(home))
    dealt = rows.join(mixed.drop("_any"), own).select(*own, "node", "comp", seek.alias("seek"), home.alias("_home"), F.explode(places).alias("chunk"))
    sized = dealt.join(about, "node").withColumn("member", F.col("chunk") == F.col("_home"))
    sorted_rows = sized.repartition(*PLACE).sortWithinPartitions(*PLACE)
    return sorted_rows.select(*PLACE, "node", "comp", "n", "member", "seek", "vain", "point").mapInArrow(across(rule, most), "a bigint, b bigint, score double, more boolean")


def one_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(slim: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, hash, n, node) of the rows, (node, rep, n, point) of the distinct sets, (node, comp) of those that are linked."""
    spark = slim.sparkSession
    rows, nodes, met, path = indexed(slim, rule)
    shared = met.where("node <> leader").groupBy("node", "leader").count()
    first = shared.groupBy("node").agg(F.max_by("leader", F.struct("count", "leader")).alias("b")).withColumnRenamed("node", "a")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    sized = first.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb"))
    near = cut(sized.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bounded(rule), "a bigint, b bigint"))
    tried = contained(spark, lambda: verify(near, slim, nodes, rule))
    comps = contained(spark, lambda: grown(None, tried.where("linked").select("a", "b")))
    lost = one_way(tried.where("not linked"))

    part, most, active, spent = met.select("block", "bucket", "node"), FIRST, None, [path]
    while True:
        # pairs that are untried have an end among the active nodes: those with more partners than they could propose
        placed = part.join(comps, "node", "left").select("block", "bucket", "node", F.coalesce("comp", "node").alias("comp"))
        vain = lost.select(F.col("a").alias("node")).unionAll(lost.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("vain"))
        found = proposed(placed, nodes, vain, active, rule, most).groupBy("a", "b").agg(F.max("score").alias("score"), F.max("more").alias("more"))
        fresh = found.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")}).join(lost.select(F.col("a").alias("_x"), F.col("b").alias("_y")), ["_x", "_y"], "left_anti")
        ranked, path = written(fresh.select("a", "b", "more", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")).alias("rank")).where(F.col("rank") <= most + 1))
        pairs = one_way(ranked.where(F.col("rank") <= most))
        if pairs.isEmpty():
            return rows, nodes, comps
        tried = contained(spark, lambda: verify(pairs, slim, nodes, rule))  # noqa: B023
        links = tried.where("linked").select("a", "b")
        if not links.isEmpty():
            comps = contained(spark, lambda: grown(comps, links))  # noqa: B023
        lost = cut(lost.unionAll(one_way(tried.where("not linked"))))  # the pairs of a round are new
        active = cut(ranked.where((F.col("rank") > most) | F.col("more")).select(F.col("a").alias("node")).distinct())
        drop(spark, path)
        if active.isEmpty():
            return rows, nodes, comps
        part, path = written(part.join(part.join(active, "node", "left_semi").select("block", "bucket").distinct(), ["block", "bucket"], "left_semi"))
        for old in spent:
            drop(spark, old)
        spent, most = [path], most * MORE


def identity(key: str, text: str):
    """A row's id, the greatest number for a null, and the hash of its text."""
    return F.coalesce(F.col(key).cast("long"), F.lit(int(LAST_ID))), F.xxhash64(text)


def slim_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole_ids(docs, key)
    own, hashed = identity(f"`{key}`", f"`{text}`")
    return docs.select(own.alias("id"), hashed.alias("hash"), F.col(f"`{text}`").alias("text"))


def known(c):
    return F.when(c != int(LAST_ID), c)


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, n_shingles, component_id) of each row of ``docs``.

    Ids are whole numbers. A null text or one without words has no shingles, is linked with nothing and is its own
    component; long texts of any length are read whole. Rows that repeat an id each get a row. A null id links as any
    other, and its component's id is the least that is not null. Other columns of ``docs`` don't matter, whatever their
    names; empty tables stay empty.
    """
    rows, nodes, found = linked(slim_rows(docs, key, text), rule)
    placed = cut(nodes.select("node", F.col("rep.id").alias("_rep")).join(found, "node", "left").select("node", "_rep", F.coalesce("comp", "node").alias("comp")))
    least = placed.join(placed.groupBy("comp").agg(F.min("_rep").alias("_comp")), "comp").select("node", "_comp")
    kept = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(least, "node", "left")
    return kept.select(known(F.col("id")).alias(key), F.col("n").alias("n_shingles"), known(F.coalesce("_comp", "id")).alias("component_id"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """The join itself: (key, class, n_links) of each row, and the links (class_a, class_b) between classes.

    Rows of equal sets are a class, named by a hash; a row links with every row of its own class and of the classes linked
    with it, and ``n_links`` counts these other rows. Texts without shingles have no class and no links. Nulls, repeats
    and empty tables as in joined().
    """
    slim = slim_rows(docs, key, text)
    rows, nodes, met, _ = indexed(slim, rule)
    part = met.select("block", "bucket", "node", F.col("node").alias("comp"))
    pairs = cut(one_way(proposed(part, nodes, None, None, rule, 1 << 60)))
    found = contained(docs.sparkSession, lambda: verify(pairs, slim, nodes, rule).where("linked").select("a", "b"))
    copies = rows.where("n > 0").groupBy("node").agg(F.count("*").alias("_copies"))
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("_copies").alias("_others"))
    counted = copies.join(others, "node", "left").select("node", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    kept = rows.select("id", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(counted, "node", "left")
    return kept.select(known(F.col("id")).alias(key), F.col("node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), found.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that are left when each component keeps its row of the least id, a null the last, and text hash.

    Rows that share an id are told apart by their texts; of rows equal in both one stays. A text without shingles is its
    own component; such rows of a null id all stay. Columns of any name are kept as they are; empty tables stay empty.
    """
    rows, nodes, found = linked(slim_rows(docs, key, text), rule)
    least = nodes.select("node", "rep").join(found, "node", "left").groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min("rep").alias("rep"))
    bare = rows.where("n = 0").select(F.col("id").alias("id"), F.col("hash").alias("hash"), F.lit(True).alias("bare")).distinct()
    first = least.select(F.col("rep.id").alias("id"), F.col("rep.hash").alias("hash"), F.lit(False).alias("bare")).unionAll(bare)
    own, hashed = identity("_key", "_text")
    kept = enclosed(docs, _key=key, _text=text).withColumns({"id": own, "hash": hashed}).join(first, ["id", "hash"])
    apart = F.when(F.col("bare") & (F.col("id") == int(LAST_ID)), F.monotonically_increasing_id())
    once = kept.withColumn("apart", apart).dropDuplicates(["id", "hash", "apart"])
    return opened(once, docs, (), _key=key, _text=text)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents").select("doc_id", "text"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS k FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, bit_xor(k) AS x, sum(k % 1000000007) AS y FROM s GROUP BY 1),
class AS (SELECT min(doc_id) AS id, n FROM n GROUP BY n, x, y),
own AS (SELECT s.doc_id, k, n FROM s JOIN class ON s.doc_id = class.id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS met FROM own a JOIN own b USING (k)
           WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * met >= {PERCENT} * (na + nb - met)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM class UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1),
named AS (SELECT n.doc_id, n.n, l.component_id FROM n JOIN (SELECT min(doc_id) AS id, n, x, y FROM n GROUP BY n, x, y) c USING (n, x, y) JOIN least_of l ON l.id = c.id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component_id, d.doc_id) AS BIGINT) AS component_id FROM d LEFT JOIN named USING (doc_id)
"""
