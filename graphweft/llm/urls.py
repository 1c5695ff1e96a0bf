"""URL filters: longest-match rules, and gradient-boosted trees on lexical features. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import settle

#: The rules (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The trees are fitted on about so many labelled URLs (a share of them by hash; equal feature rows count as one with a weight).
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_WEIGHT = 12, 3, 16, 0.3, 1.0, 5.0
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "suffix_rate", "suffix_count")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. No ://: both empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or its subdomains and starts the path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _lexical(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    chars = F.split("url", "")
    share = lambda c: F.size(F.filter(F.col("chars"), lambda x: x == c)) / F.col("length")
    bits = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    rows = base.withColumns({"rule": rule, "ruled": verdict, "length": F.length("url").cast("double"), "chars": chars})
    rows = rows.withColumns(
        {
            "host_length": F.length("host").cast("double"),
            "depth": count("path", "/"),
            "digit_ratio": F.when(F.col("length") > 0, count("url", "[0-9]") / F.col("length")).otherwise(0.0),
            "entropy": F.when(F.col("length") > 0, F.round(bits, 6)).otherwise(0.0),
            "parameters": count(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), "[^&]+"),
            "labels": count("host", r"\."),
            "suffix": F.substring_index("host", ".", -1),
        }
    )
    return rows.drop("chars")


@dataclass
class Trees:
    """Boosted trees: nested (feature, limit, left, right), left where feature <= limit; leaves are numbers."""

    base: float
    trees: list

    def margin(self) -> Column:
        return F.expr(" + ".join([f"({self.base!r}D)", *map(_as_sql, self.trees)]))


def _as_sql(tree) -> str:
    """A tree as one SQL expression: built as text, since each column operation is a call into the JVM."""
    if not isinstance(tree, tuple):
        return f"({tree!r}D)"
    feature, limit, left, right = tree
    return f"if({feature} <= {limit!r}D, {_as_sql(left)}, {_as_sql(right)})"


def fit_trees(rows: DataFrame, rate: float = RATE) -> Trees:
    """Boosting with logistic loss over rows (FEATURES doubles, y 0/1, n weight), which come to the driver once.

    rows is the bounded sample of training_rows: FIT_ROWS distinct rows of eleven numbers at most. Candidate limits are
    quantiles; a level's splits are chosen from sums by node, feature and bin.
    """
    held = sorted(map(tuple, rows.select(*FEATURES, F.col("y").cast("double"), F.col("n").cast("double")).collect()))
    if not held:
        return Trees(-50.0, [])
    table = np.array(held)
    x, y, weight = table[:, : len(FEATURES)], table[:, -2], table[:, -1]
    share = min(max((y * weight).sum() / weight.sum(), 1e-3), 1 - 1e-3)
    model = Trees(math.log(share / (1 - share)), [])
    cuts = [np.unique(np.quantile(column, [i / BINS for i in range(1, BINS)], method="inverted_cdf")) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    margin = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * weight, p * (1 - p) * weight
        node, active = np.ones(len(x), np.int64), [1]  # the root is 1, children are 2 i and 2 i + 1
        grown: dict[int, tuple[int, int]] = {}  # node -> (feature, place of its limit)
        leaves: dict[int, float] = {}
        for depth in range(DEPTH + 1):
            following = []
            for n in active:
                own = node == n
                all_g, all_h = g[own].sum(), h[own].sum()
                leaves[n] = round(float(-rate * all_g / (all_h + L2)), 9)
                best = (1e-6, None)
                for f, c in enumerate(cuts):
                    gl, hl = (np.cumsum(np.bincount(bins[f, own], v[own], len(c) + 1))[:-1] for v in (g, h))
                    gain = gl**2 / (hl + L2) + (all_g - gl) ** 2 / (all_h - hl + L2) - all_g**2 / (all_h + L2)
                    gain = np.where(np.minimum(hl, all_h - hl) * 4 >= MIN_WEIGHT, np.round(gain, 9), 0.0)
                    if depth < DEPTH and len(gain) and gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), (f, int(gain.argmax())))
                if best[1]:
                    grown[n] = best[1]
                    node[own] = 2 * n + (bins[best[1][0], own] > best[1][1])
                    following += [2 * n, 2 * n + 1]
            active = following
        if 1 not in grown:
            break
        build = lambda n: (FEATURES[grown[n][0]], float(cuts[grown[n][0]][grown[n][1]]), build(2 * n), build(2 * n + 1)) if n in grown else leaves[n]  # noqa: E731, B023
        model.trees.append(build(1))
        margin += np.array([leaves[n] for n in node.tolist()])
    return model


def labelled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Lexical features of every page, with suffix statistics over all labelled rows: block rate and log count by last host label."""
    rows = _lexical(pages, id_col, url_col)
    stats = rows.where("ruled is not null").groupBy("suffix").agg(F.count(F.lit(1)).alias("suffix_n"), F.count_if(F.col("ruled") == "block").alias("suffix_b"))
    joined = rows.join(settle(stats).withColumnRenamed("suffix", "of_suffix"), F.col("suffix") == F.col("of_suffix"), "left")
    n, b = F.coalesce("suffix_n", F.lit(0)), F.coalesce("suffix_b", F.lit(0))
    return joined.withColumns({"suffix_rate": F.round((b + 5) / (n + 10), 6), "suffix_count": F.round(F.log1p(n), 6)}).drop("of_suffix", "suffix_n", "suffix_b")


def training_rows(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About fit_rows labelled rows by hash, equal ones as one with weight n."""
    known = rows.where("ruled is not null")
    share = min(1.0, fit_rows / max(1, known.count()))
    kept = known.where(F.pmod(F.xxhash64("page_id", F.lit(10)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    y = (F.col("ruled") == "block").cast("int").alias("y")
    return kept.select(*FEATURES, y).groupBy(*FEATURES, "y").agg(F.count(F.lit(1)).alias("n"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    A URL that a rule fits gets the rule's verdict; the trees, trained on those URLs, judge the others: block if the
    score is 0.5 or more. Null URLs and those without :// have an empty host and path, and are judged by their
    features. With no labelled URL at all the verdict is allow. Repeated rows and null ids come back as they are;
    further columns are ignored.
    """
    rows = labelled(pages, id_col, url_col)
    model = fit_trees(training_rows(rows, fit_rows))
    score = F.round(1 / (1 + F.exp(-model.margin())), 9)
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("block_score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
