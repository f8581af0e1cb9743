"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for what no rule decides.

Parsing, rules, hashing and scores are Spark expressions. The regression is fitted on the driver from the hashed n-grams
of a small labelled table, of ``MAX_LABELLED`` rows at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, lower_ascii, opened, read

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BUCKETS, GRAM = 4096, 3
MAX_LABELLED, EPOCHS, RATE, L2 = 2000, 1000, 4.0, 2e-4
#: The labelled URLs that the regression learns from; 1 is to be blocked.
LABELLED = (
    ("https://casino-bonus.example.com/win/free-spins", 1),
    ("http://www.casino-royal.example.net/en/100", 1),
    ("http://cheap-pills.example.org/buy/now?aff=1", 1),
    ("https://m.cheap-watches.example.com/shop/4", 1),
    ("http://track.clickads.example.net/redirect/banner", 1),
    ("https://free-download.example.org/crack/keygen.exe", 1),
    ("http://adult-cams.example.com/live/xxx", 1),
    ("https://login-verify-account.example.net/secure/update", 1),
    ("http://bet-slots.example.org/jackpot/play", 1),
    ("http://ads.popunder.example.com/click/track.gif", 1),
    ("https://payday-loans.example.net/apply/fast-cash", 1),
    ("http://win-prize.example.org/claim/gift-card", 1),
    ("https://poker-online.example.com/bonus/deposit", 1),
    ("http://replica-watches.example.net/shop/cheap", 1),
    ("http://xxx-videos.example.org/free/watch", 1),
    ("https://torrent-crack.example.com/warez/download", 1),
    ("http://banner.adserver.example.net/click?id=7", 1),
    ("http://miracle-diet.example.org/buy/pills", 1),
    ("http://blog.hot-singles.example.net/de/777", 1),
    ("http://viagra-online.example.com/fr/12", 1),
    ("https://docs.example.org/guide/introduction", 0),
    ("https://www.example.com/fr/39547.html", 0),
    ("https://blog.example.org/2021/03/on-writing-tests", 0),
    ("https://news.example.net/world/article/18234", 0),
    ("https://library.example.org/catalogue/record/5512", 0),
    ("https://m.garden.example.com/de/35296?page=2", 0),
    ("https://university.example.org/department/physics/lecture", 0),
    ("https://wiki.example.org/page/history_of_bridges", 0),
    ("https://museum.example.net/en/collection/812", 0),
    ("https://forum.example.com/thread/44121", 0),
    ("https://recipes.example.net/bread/rye", 0),
    ("https://code.example.org/project/issues/88", 0),
    ("https://journal.example.org/volume/12/issue/3", 0),
    ("https://weather.example.net/es/26123", 0),
    ("https://archive.example.org/fr/item/7762", 0),
    ("https://www.school.example.org/de/12440#top", 0),
    ("http://river.example.com/en/19", 0),
    ("http://www.harbour.example.net/fr/5021.html", 0),
    ("https://blog.mountain.example.org/es/34", 0),
    ("http://m.bakery.example.com/en/90871/", 0),
    ("https://theatre.example.net/de/66", 0),
    ("http://station.example.org/en/35332/", 0),
    ("http://", 0),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; of rules of one length, the one that sorts first."""
    rule = verdict = F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        ok = fits(host, path, h, p)
        rule, verdict = F.when(ok, F.lit(h + p)).otherwise(rule), F.when(ok, F.lit(word)).otherwise(verdict)
    return rule, verdict


def grams(df: DataFrame) -> DataFrame:
    """``df`` (with host, path) with ``_grams``: the buckets of the character n-grams of both, in order."""

    def of(name: str) -> str:
        chars = f"split(concat('^', {name}, '$'), '')"
        windows = ", ".join(f"c[i + {k}]" for k in range(GRAM))
        return f"flatten(transform(array({chars}), c -> if(size(c) < {GRAM}, array(pmod(xxhash64('{name}', c), {BUCKETS})), transform(sequence(0, size(c) - {GRAM}), i -> pmod(xxhash64('{name}', {windows}), {BUCKETS})))))"

    return df.withColumn("_grams", F.expr(f"transform(concat({of('host')}, {of('path')}), x -> int(x))"))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """(weights of the buckets, bias) by gradient descent on a table (url, block 0/1); features are shares of the n-grams."""
    host, path = parts(F.col("url"))
    rows = grams(labelled.where("url is not null and block is not null").orderBy("url", "block").limit(MAX_LABELLED).select("block", host.alias("host"), path.alias("path"))).collect()
    data = []
    for r in rows:
        share: dict[int, float] = {}
        for g in r["_grams"]:
            share[g] = share.get(g, 0.0) + 1 / math.sqrt(len(r["_grams"]))
        data.append((share, float(r["block"])))
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(EPOCHS if data else 0):
        step: dict[int, float] = {}
        off = 0.0
        for share, y in data:
            z = bias + sum(weights[g] * v for g, v in share.items())
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            off += e
            for g, v in share.items():
                step[g] = step.get(g, 0.0) + e * v
        for g, v in step.items():
            weights[g] -= RATE * (v / len(data) + L2 * weights[g])
        bias -= RATE * off / len(data)
    return weights, bias


def score(df: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """``df`` (with host, path) with ``score``: the probability that the url is to be blocked."""
    weights, bias = model
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda a, g: a + F.element_at(F.lit(weights), g + 1))
    return grams(df).withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size("_grams"), F.lit(1))))))).drop("_grams")


def judge(pages: DataFrame, model: tuple[list[float], float], rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), score and verdict: the rule's, else block from a score of 0.5.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits; the regression judges them by its
    bias and the n-grams of empty parts. Long urls are read whole; repeated rows keep their rows; own columns of the new
    names, in any case, are replaced; an empty table stays empty.
    """
    host, path = parts(F.col("_url"))
    out = enclosed(pages, _url=url).withColumns({"host": host, "path": path})
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    found = score(out.withColumn("rule", rule), model).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))
    return opened(found, pages, ("host", "path", "rule", "score", "verdict"), _url=url)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame([*LABELLED], "url string, block int"))
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "score")
