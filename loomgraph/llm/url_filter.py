"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Everything that touches the rows is a DataFrame expression. The regression is fitted on the driver from
a small labelled table (its size is checked) in plain Python; its weights are one array literal of
``buckets`` doubles, so what travels to the executors has a fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold

#: (verdict, host, path) rules of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_SYLLABLES = ["ri", "ver", "lan", "tern", "wil", "low", "thun", "der", "gar", "den", "th", "er", "tion", "nd", "st", "wh", "ly", "ing", "sh", "re", "ble", "ha", "ou", "in", "mo", "ka", "co", "per"]
_WORDS = ["river", "garden", "lantern", "museum", "library", "weather", "recipes", "school", "city", "travel", "music", "forest", "history", "science", "health", "market", "bridge", "harvest", "mountain", "village", "letters", "paper", "studio", "kitchen"]
_LURES = ["spam", "free", "casino", "pills", "bets", "cheap", "win", "prize", "xxx", "adult", "loans", "bonus", "click", "deals", "farm", "porn", "viagra", "replica", "crypto", "payday", "jackpot", "slots", "ads", "track"]
_TAILS = ["com", "net", "org"]
_PATHS = ["/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/fr/{}", "/de/{}.html", "/en/{}/", "/es/{}/", "/news/{}", ""]


def _labelled() -> tuple[tuple[str, int], ...]:
    """Small labelled table, (host and path, 1 to block): hosts of plain syllables against hosts or paths of lure words.

    Both kinds meet every subdomain, ending and path shape equally often, so that only the words tell them apart.
    """
    out = []
    for i in range(480):
        sub, end, path = ["", "www.", "m.", "blog."][i % 4], _TAILS[i % 3], _PATHS[i % 10].format((i * 7919 + 11) % 50021)
        a, b = _SYLLABLES[i * 5 % 28], _SYLLABLES[(i * 11 + i // 28) % 28]
        out.append((f"{sub}{a}{b}{_SYLLABLES[(i * 3 + 1) % 28] if i % 2 else ''}.example.{end}{path}", 0))
        if i % 2:
            out.append((f"{sub}{_WORDS[i // 2 % 24]}{['', '-', ''][i % 3]}{_WORDS[(i * 7 + 5) % 24] if i % 3 else ''}.example.{end}{path}", 0))
        x, y = _LURES[i % 24], _LURES[(i * 7 + 3 + i // 24) % 24]
        out.append((f"{sub}{x}-{y}.example.{end}{path}" if i % 3 else f"{sub}{a}{b}.example.{end}/{x}/{y}{path}", 1))
    return tuple(out)


LABELLED = _labelled()
#: Largest labelled table that is fitted on the driver.
MAX_LABELLED = 10_000


def split(labelled: Sequence[tuple[str, int]] = LABELLED, one_in: int = 5) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Labelled rows to fit on and, of one host in ``one_in`` by its hash, to measure on: no host is on both sides."""
    held = lambda r: zlib.crc32(r[0].split("/")[0].encode()) % one_in == 0
    return [r for r in labelled if not held(r)], [r for r in labelled if held(r)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return fold(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, else nulls. A few rules: one CASE, no join."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(text: str, sizes: Sequence[int], buckets: int) -> Counter:
    return Counter(zlib.crc32(text[i : i + n].encode()) % buckets for n in sizes for i in range(len(text) - n + 1))


def fit(labelled: Sequence[tuple[str, int]] = LABELLED, sizes: Sequence[int] = (3, 4, 5), buckets: int = 4096, epochs: int = 12, rate: float = 4.0, l2: float = 1e-4) -> tuple[float, list[float]]:
    """Bias and bucket weights of a logistic regression over gram counts of norm 1, by passes of gradient steps."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(labelled)} rows; {MAX_LABELLED} at most")
    rows = []
    for text, y in labelled:
        g = _grams("^" + text + "$", sizes, buckets)
        norm = math.sqrt(sum(v * v for v in g.values())) or 1.0
        rows.append(({k: v / norm for k, v in g.items()}, y))
    bias, weights = 0.0, [0.0] * buckets
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for g, y in sorted(rows, key=lambda r: (zlib.crc32(f"{epoch} {sorted(r[0])}".encode()))):
            z = bias + sum(weights[k] * v for k, v in g.items())
            e = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += 0.05 * step * e
            for k, v in g.items():
                weights[k] += step * (e * v - l2 * weights[k])
    return bias, weights


def characters(host: Column, path: Column) -> Column:
    """The characters of ``^host path$``, of which a gram is a few look-ups; substrings would scan long texts again
    and again."""
    return F.split(F.concat(F.lit("^"), host, path, F.lit("$")), "")


def gram_buckets(chars: Column, sizes: Sequence[int], buckets: int) -> Column:
    """The buckets, by crc32, of the n-grams of an array of characters (a column, not computed)."""
    n = F.size(chars)

    def of_size(k: int) -> Column:
        first = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: (F.crc32(F.concat(*(F.get(chars, i + j) for j in range(k)))) % buckets).cast("int"))

    return F.concat(*(of_size(k) for k in sizes))


def spam_score(grams: Column, model: tuple[float, list[float]]) -> Column:
    """Probability of block from an array of buckets (a column, not computed)."""
    bias, weights = model
    vector = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(vector, h))
    # the norm of the count vector: runs of equal buckets in sorted order
    square = F.aggregate(F.array_sort(grams), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
                         lambda a, h: F.struct(h.alias("last"), F.when(h == a["last"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), (a["sum"] + F.when(h == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1.0))).alias("sum")), lambda a: a["sum"])
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(square, F.lit(1.0))))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, sizes: Sequence[int] = (3, 4, 5), buckets: int = 4096, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every url. Narrow: no shuffle, one scan of two columns.

    Null urls and urls without ``://`` have empty host and path and are judged by the regression on the
    empty text. Equal rows give equal rows; an empty table gives an empty one; very long urls are read whole, at a
    cost linear in their length; other columns of pages are not read. labelled: (host and path, 1 to block) rows to
    fit on, MAX_LABELLED at most; split() keeps hosts apart for measuring.
    """
    host, path = parts(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    # grams are a column of their own, so that they are made once for the sum and the norm
    df = df.withColumn("chars", characters(F.col("host"), F.col("path"))).withColumn("grams", gram_buckets(F.col("chars"), sizes, buckets))
    score = spam_score(F.col("grams"), fit(labelled, sizes, buckets))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
