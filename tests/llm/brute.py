"""Plain versions of the operators, and rows with the awkward cases."""

import hashlib
import random
import re
from collections import Counter

SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ba", "relo", "tion", "erst", "mino", "quel", "éta", "日本", "x1"]) + rng.choice(["", "a", "ing", "or", "."]) for _ in range(n))


def corpus(seed=5):
    """(doc_id, text) rows: nulls, empty and blank texts, ties, repeated rows, copies, near copies, shared passages, a long text."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, "a\n\nb  c")]
    base = [prose(rng, rng.randint(3, 200)) for _ in range(30)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(60 + i, base[i]) for i in range(6)]
    for i in range(8):
        w = base[i + 8].split(" ")
        if len(w) > 4:
            w[rng.randrange(len(w))] = "changed"
        rows.append((80 + i, " ".join(w)))
    rows += [(100 + i, prose(rng, 10) + " " + passage + "\n" + prose(rng, 15)) for i in range(6)]
    rows += [(120, " ".join([passage, passage])), (121, "na " * 90), (122, "na na na"), (123, prose(rng, 9000)), (124, "z" * 70_000)]
    rows += [(130, base[0]), (130, base[0]), (None, passage), (None, "of the")]
    return rows


def frame(spark, rows, extra=True):
    """The rows with columns whose names operators use themselves."""
    more = ", n_words string, kept string, n_removed string, bucket int, node int, block int" if extra else ""
    tail = ("w", "k", "r", 1, 2, 3) if extra else ()
    return spark.createDataFrame([(*r, *tail) for r in rows], f"doc_id bigint, text string{more}").repartition(5)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def phrase_dedup(rows, size=20):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k, at = tuple(w[i : i + size]), (order(d), i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (order(d), i):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix_dedup(rows, size=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], order(d)), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < order(d):
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    parent = [*range(len(rows))]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), order(None)), order(d))
    return [(d, len(sets[i]), None if least[find(i)] == order(None) else least[find(i)]) for i, (d, _) in enumerate(rows)]


def statistics(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(rows, items, size=10):
    wins = {}
    for item, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w, hit, met = alnum(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    met |= wins[k]
        out.append((d, len(w), len(hit), sorted(met)))
    return out
