"""Quality rules: an ordered list of threshold rules, learned by sequential covering from labelled statistics.

Statistics and verdicts are Spark expressions. The learner works on the counts of binned statistics: each growth step is
one GROUPING SETS aggregate over the cells of the labelled sample, each pruning one conditional aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import WORD_SPACE, cut, enclosed, opened, read

#: The labelled rows that a list is fitted on, at most: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Cut points of a statistic in each class.
QUANTILES = 10
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must be right about so large a share of what it covers in the pruning rows, and cover so many.
MIN_PRECISION, MIN_COVER = 0.9, 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "f_words": "cast(n_words as double)",
    "f_chars": "word_chars / greatest(n_words, 1)",
    "f_symbols": "n_symbols / greatest(n_words, 1)",
    "f_dup_lines": "cast(n_dup_lines as double)",
    "f_repeats": "n_repeat_words / greatest(n_words, 1)",
    "f_shouts": "n_shouts / greatest(word_chars, 1)",
}
#: Bits of a packed window that hold its position; the others hold a part of its hash.
POS_BITS = 26


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``BASE``, and ``n_shouts`` (capitals A-Z and exclamation marks), over whole texts.

    A null text counts as empty: all zero. Own columns named like the new ones, in any case, are replaced; every row is
    kept, repeated ones too, and an empty table stays empty. A text may have 2**26 words.

    Repeated 3-word windows: each window is packed as hash bits and position, the packed numbers are sorted, and
    neighbours of the same hash bits are compared as words.
    """
    mask, space = (1 << POS_BITS) - 1, "\\t\\n\\x0b\\f\\r ".encode().decode("unicode_escape")
    step = enclosed(docs, _given=text).withColumn("_text", F.coalesce("_given", F.lit("")))
    step = step.withColumn("_trim", F.trim(F.col("_text"), F.lit(space)))
    step = step.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", WORD_SPACE)))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w")
    step = step.withColumn(
        "_packed",
        F.when(
            n >= 4,
            F.sort_array(F.expr(f"transform(sequence(0, size(_w) - 3), i -> shiftleft(shiftright(xxhash64(_w[i], _w[i + 1], _w[i + 2]), {POS_BITS}), {POS_BITS}) | cast(i as bigint))")),
        ),
    )
    same = f"shiftright(_packed[{{}}], {POS_BITS}) = shiftright(x, {POS_BITS})"
    step = step.withColumn("_near", F.expr(f"filter(_packed, (x, i) -> if(i > 0, {same.format('i - 1')}, false) or if(i + 1 < size(_packed), {same.format('i + 1')}, false))"))
    step = step.withColumn("_spelt", F.expr(f"array_sort(transform(_near, x -> struct(concat_ws(' ', _w[int(x & {mask}L)], _w[int(x & {mask}L) + 1], _w[int(x & {mask}L) + 2]) as k, int(x & {mask}L) as p)))"))
    step = step.withColumn("_at", F.expr("sort_array(transform(filter(_spelt, (x, i) -> if(i > 0, _spelt[i - 1].k = x.k, false) or if(i + 1 < size(_spelt), _spelt[i + 1].k = x.k, false)), x -> x.p))"))
    gone = lambda pattern: (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")
    found = step.select(
        *(c for c in ("_given", "_rest") if c in step.columns),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        gone(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(coalesce(aggregate(transform(_at, (p, i) -> if(i + 1 < size(_at), least(3, _at[i + 1] - p), 3)), 0, (a, x) -> a + x), 0) as bigint)").alias("n_repeat_words"),
        gone(r"[A-Z!]+").alias("n_shouts"),
    )
    return opened(found, docs, (*BASE, "n_shouts"), _given=text)


@dataclass
class DecisionList:
    """Rules in order; each is a conjunction of (feature, "<=" or ">", threshold) that rejects a text."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    @staticmethod
    def condition(rule: list[tuple[str, str, float]]) -> Column:
        out = F.lit(True)
        for name, op, at in rule:
            value = F.expr(FEATURES[name])
            out = out & (value <= at if op == "<=" else value > at)
        return out

    def verdict(self) -> Column:
        """The number of the first rule that rejects the text; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed([*enumerate(self.rules, 1)]):
            out = F.when(self.condition(rule), F.lit(k)).otherwise(out)
        return out


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of at most ``rows`` labelled texts, with ``bad`` (quality 0)."""
    held = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")
    return statistics(texts).withColumn("bad", F.col("_quality") == 0)


def learn(sampled: DataFrame) -> DecisionList:
    """A list by sequential covering: grow on two thirds of the rows, prune on the rest."""
    names = [*FEATURES]
    rows = sampled.select(*[F.expr(e).alias(n) for n, e in FEATURES.items()], "bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow"))
    rows = cut(rows.repartition(8))
    share = [k / QUANTILES for k in range(1, QUANTILES)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, F.array(*map(F.lit, share)), 1000).alias(n) for n in names]).collect()
    cuts = {n: sorted({float(x) for r in found for x in (r[n] or [])}) for n in names}
    binned = [sum((F.when(F.col(n) > t, 1).otherwise(0) for t in cuts[n]), F.lit(0)).alias(n) for n in names]
    cells = cut(rows.select(*binned, "bad", "grow").groupBy(*names, "grow").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).coalesce(1))

    def holds(rule) -> Column:
        out = F.lit(True)
        for name, op, k in rule:
            out = out & (F.col(name) <= k if op == "<=" else F.col(name) > k)
        return out

    def counts(rest: Column, rule) -> tuple[dict[str, dict[int, tuple[int, int]]], int, int]:
        got = cells.where(F.col("grow") & rest & holds(rule)).groupingSets([[F.col(n)] for n in names], *names).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in got:
            name = next((n for n in names if r[n] is not None), None)
            if name:
                by[name][r[name]] = (r["p"], r["n"])
        first = by[names[0]].values()
        return by, sum(p for p, _ in first), sum(n for _, n in first)

    rest, rules = F.lit(True), []
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MAX_CONDITIONS:
            by, p0, n0 = counts(rest, rule)
            if not p0 or rule and not n0:
                break
            best = (0.0, None)
            for name in names:
                p = n = 0
                for k in range(len(cuts[name])):
                    dp, dn = by[name].get(k, (0, 0))
                    p, n = p + dp, n + dn
                    for op, (a, b) in (("<=", (p, n)), (">", (p0 - p, n0 - n))):
                        gain = a * (math.log2((a + 1) / (a + b + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if a else 0.0
                        best = max(best, (gain, (name, op, k)), key=lambda x: x[0])
            if best[1] is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        cells_left = cells.where(~F.col("grow") & rest)
        tried = cells_left.agg(*[F.sum(F.when(holds(rule[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c in "pn"]).first()
        score = lambda k: ((tried[f"p{k}"] or 0) - (tried[f"n{k}"] or 0)) / max(1, (tried[f"p{k}"] or 0) + (tried[f"n{k}"] or 0))  # noqa: E731, B023
        keep = max(range(1, len(rule) + 1), key=lambda k: (round(score(k), 3), -k))
        p, n = tried[f"p{keep}"] or 0, tried[f"n{keep}"] or 0
        if p + n < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rule = rule[:keep]
        rules.append(rule)
        rest = rest & ~holds(rule)
    # a bin above cut k holds the values over the k-th cut point
    return DecisionList([[(name, op, cuts[name][k]) for name, op, k in rule] for rule in rules])


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (the learned rule that rejects, null if none) and ``kept``; own columns of these names are replaced."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", rules.verdict())
    # the row number never is below 0: it only keeps filters on ``kept`` from being pushed below, which would repeat the statistics
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull() & (F.monotonically_increasing_id() >= 0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` judged by a list learned from ``labels`` (doc_id, quality); without labelled rows only the base rule holds.

    Null texts fail the base rule; null ids and repeated rows are judged as any other, and the least label of an id counts;
    clashing columns, long texts and empty tables as in statistics() and judge().
    """
    return judge(statistics(docs), learn(sample(docs, labels)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, read(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "rule", "n_shouts")
