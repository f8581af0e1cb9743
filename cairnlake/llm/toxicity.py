"""Toxicity: a support vector machine on gap-weighted subsequence kernels, with Nyström landmarks.

Words are compared by the subsequences of three letters that they share; each letter skipped costs a factor ``DECAY``, so
an insult with inserted characters stays near its plain form. The kernel values against a fixed set of landmark words
(Nyström) are the features of a linear machine that is trained on labelled sentences: a sentence is as toxic as its most
toxic word. Because kernel, landmarks and machine are linear in the subsequence weights of a word, the trained model
folds into one weight for each subsequence, and a distinct word is scored once in a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, opened, read, schema_with, slices, text_bytes, tidy, with_columns

#: Labelled rows of each class that the model is fitted on, at most: those of the smallest hashes of doc_id; one text of
#: each id, and none of more bytes than this.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 1 << 16
#: Marks that are put into words unseen or as one sign (soft hyphen, general punctuation, byte order mark): a gap of one.
SIGNS = "[\u00ad\u2000-\u206f\ufeff]"
DECAY, SPAN = 0.6, 7
#: Longer words are scored as overlapping windows of so many characters, half a window apart.
WIDTH = 24
INSULTS, NEUTRAL, ALIKE = 64, 32, 0.7
#: What makes a word or a stem telling: sentences that have it, and log odds between the classes.
MIN_SENTENCES, MIN_STEM, TELLING = 5, 8, float(np.log(20))
HARD_NEGATIVES, ROUNDS, EPOCHS, COST, POSITIVE, CLEAN_WEIGHT = 4000, 4, 30, 1.0, 3.0, 1.0
#: Distinct words that a task remembers before it begins anew.
TABLE_WORDS = 300_000
#: Codes of characters: 0 none, a to z, the marker of a word's ends, and the low bits of the bytes of other letters.
LETTERS, MARK = 64, 27
#: Subsequences are told apart by so many hashed keys.
KEYS = 1 << 16
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
#: Letters that digits and signs are read as.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
CODES = np.zeros(256, np.uint8)
for _c in range(26):
    CODES[ord("a") + _c] = CODES[ord("A") + _c] = _c + 1
for _k, _v in LEET.items():
    CODES[ord(_k)] = CODES[ord(_v)]
CODES[0x80:0xC0] = 28 + np.arange(64) % 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LONE = r"(?:^|\s)\S(?:\s\S){2,}(?:\s|$)"


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of all three-letter subsequences of each word, a row each; keys of no weight are 0."""
    width = max(3, max(map(len, words), default=1) + 2)
    codes = np.zeros((len(words), width + SPAN), np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    place = np.arange(width)
    codes[:, :width][(place > 0) & (place <= lens[:, None])] = CODES[flat]
    codes[:, 0] = codes[np.arange(len(words)), lens + 1] = MARK
    keys, weights = [], []
    first = codes[:, :width]
    for a, b in GAPS:
        mid, last = codes[:, a : a + width], codes[:, a + b : a + b + width]
        ok = (first > 0) & (mid > 0) & (last > 0)
        keys.append(np.where(ok, 1 + ((first * LETTERS + mid) * LETTERS + last) * 40503 % 262147 % (KEYS - 1), 0))
        weights.append(np.where(ok, DECAY ** (a + b - 2), 0.0))
    return np.concatenate(keys, 1), np.concatenate(weights, 1)


def norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The square roots of the kernel of each word with itself."""
    order = np.argsort(keys, 1, kind="stable")
    k, w = np.take_along_axis(keys, order, 1), np.take_along_axis(weights, order, 1)
    total = np.cumsum(w, 1)
    last = np.ones(k.shape, bool)
    last[:, :-1] = k[:, 1:] != k[:, :-1]
    ends = np.where(last, total, 0.0)
    before = np.zeros_like(ends)
    before[:, 1:] = np.maximum.accumulate(ends, 1)[:, :-1]
    return np.sqrt((np.where(last, ends - before, 0.0) ** 2).sum(1))


def grams(word: bytes) -> set[bytes]:
    """The stems of a word: its runs of four and five characters, the beginning marked."""
    marked = b"^" + word
    return {marked[i : i + k] for k in (4, 5) for i in range(len(marked) - k + 1)}


def windows(word: bytes) -> list[bytes]:
    """A word as itself, or as overlapping windows."""
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def lone_joined(text: str) -> str:
    """The text followed by its runs of single characters, joined: "i d i o t" also counts as one word."""
    joined = [re.sub(r"\s", "", m[0]) for m in re.finditer(r"(?<!\S)\S(?:\s\S){2,}(?!\S)", text)]
    return " ".join([text, *joined])


class Machine:
    """The trained model: a weight for each subsequence, the offset, and the logistic curve of the scores."""

    def __init__(self, alpha: np.ndarray, offset: float, slope: float, shift: float):
        self.alpha, self.offset, self.slope, self.shift = alpha, offset, slope, shift

    def words(self, words: list[bytes]) -> np.ndarray:
        """The decision values of words."""
        out = np.full(len(words), self.offset)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = -1
        for high in (4, 6, 8, 10, 12, 16, WIDTH):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(at), 4_000):
                some = at[i : i + 4_000]
                keys, weights = subsequences([words[j] for j in some])
                own = norms(keys, weights)
                out[some] += np.divide((self.alpha[keys] * weights).sum(1), own, out=np.zeros(len(some)), where=own > 0)
            low = high
        at = np.flatnonzero(sizes > WIDTH)
        if len(at):
            parts = [windows(words[j]) for j in at]
            found = self.words([p for x in parts for p in x])
            out[at] = np.maximum.reduceat(found, np.cumsum([0, *map(len, parts[:-1])]))
        return out

    def curve(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -30, 30)))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts, how many each text has)."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, SIGNS)).as_py():
        texts = pc.replace_substring_regex(texts, SIGNS, ".")
    lone = pc.match_substring_regex(texts, LONE)
    if pc.any(lone).as_py():
        texts = pa.array([lone_joined(t) if hit else t for t, hit in zip(texts.to_pylist(), lone.to_pylist(), strict=True)], pa.string())
    data, off = text_bytes(texts)
    gap = SPACES[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = ~gap[heads]
    at = np.flatnonzero(begins)
    ends = ~gap
    ends[:-1] &= gap[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    ends[tails] = ~gap[tails]
    to = np.flatnonzero(ends) + 1
    lens = to - at
    starts = np.concatenate([[0], np.cumsum(lens)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data[~gap]))])
    return words, np.diff(np.searchsorted(at, off))


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(texts: list[str], toxic: list[int]) -> Machine:
    """A machine from labelled texts. Without both classes, or without telling words, all scores are low.

    Every fourth text is kept for the logistic curve, which so sees words that the machine hasn't.
    """
    apart = [i % 4 == 3 for i in range(len(texts))]
    later, y_later = [t for t, a in zip(texts, apart, strict=True) if a], np.array([y for y, a in zip(toxic, apart, strict=True) if a], float)
    texts, toxic = [t for t, a in zip(texts, apart, strict=True) if not a], [y for y, a in zip(toxic, apart, strict=True) if not a]
    distinct = dict.fromkeys((s, y) for t, y in zip(texts, toxic, strict=True) for s in re.split(r"(?<=[.!?])\s|\n", lone_joined(t or "")))  # copies tell nothing new
    seen, n = {0: Counter(), 1: Counter()}, {0: 1, 1: 1}
    for sentence, y in distinct:
        n[y] += 1
        seen[y].update({x for w in re.split(rb"[\x20\x09-\x0d]+", sentence.encode().lower()) for x in windows(w.strip(b".,;:!?"))})
    odds = lambda a, b: np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
    del distinct
    stems, clean_stems = Counter(), Counter()
    for w, c in seen[1].items():
        for g in grams(w):
            stems[g] += c
    stems = {g: c for g, c in stems.items() if c >= MIN_STEM}
    for w, c in seen[0].items():
        for g in grams(w):
            if g in stems:
                clean_stems[g] += c
    known = {g: v for g, c in stems.items() if (v := odds(c, clean_stems[g])) > TELLING}
    telling = {}
    for w, c in seen[1].items():  # words of their own, and forms of a stem that clean sentences don't have
        best = max([odds(c, seen[0][w])] * (c >= MIN_SENTENCES) + [known[g] for g in grams(w) if g in known] * (not seen[0][w]), default=0.0)
        if best > TELLING and len(w) >= 3:
            telling[w] = float(best)
    if not telling:
        return Machine(np.zeros(KEYS), -1.0, 1.0, -3.0)
    neutral = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if len(w) >= 4 and w not in telling][:NEUTRAL]

    def maps(words: list[bytes]) -> np.ndarray:
        keys, weights = subsequences(words)
        out = np.zeros((len(words), KEYS), np.float32)
        np.add.at(out, (np.arange(len(words))[:, None], keys), weights)
        out[:, 0] = 0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    ranked = sorted(telling, key=lambda w: (-seen[1][w] * telling[w], w))[: 3 * INSULTS]
    alike, insults = maps(ranked), []
    alike = alike @ alike.T
    for i in range(len(ranked)):  # the most telling words that aren't near one taken before
        if len(insults) < INSULTS and not (alike[i, insults] > ALIKE).any():
            insults.append(i)
    insults = [ranked[i] for i in insults]
    landmarks = maps([*insults, *neutral])
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    ok = values > 0.05
    project = landmarks.T @ (vectors[:, ok] / np.sqrt(values[ok]))  # subsequence weights to Nyström features

    def features(words: list[bytes]) -> np.ndarray:
        return np.concatenate([maps(words[i : i + 100]) @ project for i in range(0, len(words), 100)]) if words else np.zeros((0, project.shape[1]))

    clean = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if w and w not in telling]
    negatives = dict.fromkeys(clean[:HARD_NEGATIVES])
    hard = Machine(landmarks[: len(insults)].sum(0), 0.0, 1.0, 0.0).words(clean)
    words = sorted(telling)
    x_pos = features(words)
    alpha, offset = np.zeros(KEYS), 0.0
    for _ in range(ROUNDS):
        negatives.update(dict.fromkeys(clean[i] for i in np.argsort(-hard, kind="stable")[: HARD_NEGATIVES // 2]))
        x_neg = features([*negatives])
        x = np.concatenate([x_pos, x_neg])
        y = np.concatenate([np.ones(len(words)), -np.ones(len(negatives))])
        c = np.concatenate([np.sqrt([seen[1][w] for w in words]), np.ones(len(negatives))])
        c[y > 0] *= POSITIVE / c[y > 0].mean()
        v, b = machine_of(x, y, c * COST)
        alpha, offset = project @ v, b
        machine = Machine(alpha, offset, 1.0, 0.0)
        hard = machine.words(clean)
    raw, y = document_values(machine, pa.array(later, pa.string()), {}), y_later
    if not 0 < y.sum() < len(y):
        return Machine(alpha, offset, 4.0, 0.0)
    weight = np.where(y > 0, 1.0, CLEAN_WEIGHT * max(1.0, y.sum() / (1 - y).sum()))
    weight /= weight.sum()
    slope, shift = 1.0, 0.0
    for _ in range(4000):  # the logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        slope, shift = slope - (weight * (p - y) * raw).sum() - 1e-4 * slope, shift - (weight * (p - y)).sum()
    return Machine(alpha, offset, float(slope), float(shift))


def document_values(machine: Machine, texts: pa.Array, known: dict[bytes, float]) -> np.ndarray:
    """The largest decision value of the words of each text; the machine's offset for none."""
    words, counts = tokens(texts)
    out = np.full(len(counts), machine.offset)
    if len(words):
        table = words.dictionary_encode()
        distinct = [w.lower().strip(b".,;:!?") for w in table.dictionary.to_pylist()]
        if len(known) > TABLE_WORDS:
            known.clear()
        new = [*dict.fromkeys(w for w in distinct if w not in known)]
        known.update(zip(new, machine.words(new).tolist(), strict=True))
        values = np.fromiter(map(known.__getitem__, distinct), float, len(distinct))[table.indices.to_numpy()]
        full = counts > 0
        out[full] = np.maximum.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def machine_of(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, offset) of the linear machine with hinge loss, by dual coordinate descent in a fixed random order."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    square, dual, w = np.einsum("ij,ij->i", x, x), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            new = min(max(dual[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled texts of each class, none of them held out.

    Null labels and null ids don't count; of rows that repeat an id one text is learned from; texts of more than
    ``SAMPLE_BYTES`` are not.
    """
    held = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = None
    for y in (0, 1):
        some = held.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionAll(some)
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    got = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("_toxic").alias("_toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in got], [int(r["_toxic"]) for r in got])


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), over whole texts.

    Null and empty texts, and texts without words, have the score of no match; long texts are read whole. Every row,
    repeated or not, keeps its row; an empty table gives an empty table; an own column ``score``, in any case, is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                yield with_columns(part, {"score": pa.array(machine.curve(document_values(machine, part.column("_text"), known)))})
            tidy()
        known.clear()
        tidy()

    own = enclosed(docs, _text=text)
    return opened(own.mapInArrow(run, schema_with(own, "score double")), docs, ("score",), _text=text)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
