"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for urls that no rule fits.

Everything is DataFrame and SQL expressions. Rules (host and path, as `org/` or `example.org/es/`) label urls; a bounded
sample of the labelled (SAMPLE, those of least hash) trains TREES trees of DEPTH levels on length, depth, digit ratio,
entropy, parameter count, labels of the host and the block rates of its last label and of its last two, counted over all labelled urls. A url that
trains sees the rates of the other half of the labelled urls (halves by hash), so its own label is not among its features. Features are cut at sample quantiles
and equal rows merged with their counts; a level of a tree is one aggregation to (node, feature, cut), so only
sums of that bounded size reach the driver. The finished trees are CASE expressions in the scoring projection.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and gets the trees'
verdict on its features; without labels the verdict is allow; repeated rows get the same verdict; very long urls are measured whole; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, checkpointed, joined_hot

SAMPLE = 100_000
CUTS, TREES, DEPTH, RATE, L2 = 16, 12, 3, 0.3, 1.0
#: Suffixes with statistics that are broadcast at most (about 3 MB); of more, all but those of many urls are joined by a shuffle.
BROADCAST_SUFFIXES = 50_000
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "labels", "suffix_rate", "domain_rate")
#: Rate: the end of the host that it belongs to.
ENDS = {"suffix_rate": r"[^.]*$", "domain_rate": r"([^.]*\.)?[^.]*$"}


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = F.coalesce(at > 0, F.lit(False))
    return tuple(F.when(has, x).otherwise("") for x in (ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)))


def fitting(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """rules: rule and verdict. The longest rule that fits, with its verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):  # the last put on is the first tried
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.split(url, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    entropy = F.log2(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n
    return {
        "length": F.length(url).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": F.when(F.length(url) > 0, F.round(entropy, 6)).otherwise(0.0),
        "params": F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")).cast("double"),
        "labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
    }


class Trees:
    """Boosted trees: (feature, cut) at inner nodes, 1 for the root and 2n, 2n + 1 below n; a value at leaves."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def leaf(self, tree: dict, at: dict[str, Column], node: int = 1) -> Column:
        if node not in tree["splits"]:
            return F.lit(tree["values"].get(node, 0.0))
        feature, cut = tree["splits"][node]
        return F.when(at[feature] <= cut, self.leaf(tree, at, 2 * node)).otherwise(self.leaf(tree, at, 2 * node + 1))

    def node(self, tree: dict, at: dict[str, Column], node: int = 1) -> Column:
        if node not in tree["splits"]:
            return F.lit(node)
        feature, cut = tree["splits"][node]
        return F.when(at[feature] <= cut, self.node(tree, at, 2 * node)).otherwise(self.node(tree, at, 2 * node + 1))

    def margin(self, at: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, (self.leaf(t, at) for t in self.trees), F.lit(self.base))


def boost(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, cuts: int = CUTS) -> Trees:
    """rows: FEATURES and label (1: block). Each level is one aggregation whose result is bounded by nodes, features and cuts."""
    steps = [i / cuts for i in range(1, cuts)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("block"), *(F.percentile_approx(f, steps, 10000).alias(f) for f in FEATURES)).first()
    if not found["n"] or found["block"] in (0, found["n"]):
        return Trees(0.0 if not found["n"] else 10.0 if found["block"] else -10.0)
    edges = {f: sorted(set(found[f])) for f in FEATURES}
    base = log(found["block"] / (found["n"] - found["block"]))
    cut = lambda f: F.coalesce(F.get(F.filter(F.array(*map(F.lit, edges[f])), lambda c: c >= F.col(f)), F.lit(0)), F.lit(float("inf")))
    data = checkpointed(rows.select(*(cut(f).alias(f) for f in FEATURES), "label").groupBy(*FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("block")).withColumn("margin", F.lit(base)))
    model, at = Trees(base), {f: F.col(f) for f in FEATURES}
    p = 1 / (1 + F.exp(-F.col("margin")))
    for _ in range(trees):
        tree: dict = {"splits": {}, "values": {}}
        for _ in range(depth):
            level = data.select(model.node(tree, at).alias("node"), (F.col("block") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("cut")) for f in FEATURES))).alias("x"))
            sums: dict[int, dict[str, list]] = {}
            for r in level.groupBy("node", "x.feature", "x.cut").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["cut"], r["g"], r["h"]))
            for node, by in sums.items():
                split(tree, node, {f: sorted(x) for f, x in by.items()})
        model.trees.append(tree)
        data = checkpointed(data.withColumn("margin", F.col("margin") + model.leaf(tree, at)))
    return model


def split(tree: dict, node: int, by: dict[str, list]) -> None:
    """Splits a node where the gain is greatest, and sets the values on both sides."""
    g, h = (sum(x[i] for x in next(iter(by.values()))) for i in (1, 2))
    gain = lambda a, b: a * a / (b + L2)
    best = (1e-6, None)
    for f in FEATURES:
        left_g = left_h = 0.0
        for cut, dg, dh in by.get(f, [])[:-1]:
            left_g, left_h = left_g + dg, left_h + dh
            got = gain(left_g, left_h) + gain(g - left_g, h - left_h) - gain(g, h)
            if got > best[0] + 1e-9:
                best = (got, (f, cut, left_g, left_h))
    tree["values"].setdefault(node, RATE * g / (h + L2))
    if best[1]:
        f, cut, left_g, left_h = best[1]
        tree["splits"][node] = (f, cut)
        tree["values"][2 * node], tree["values"][2 * node + 1] = RATE * left_g / (left_h + L2), RATE * (g - left_g) / (h - left_h + L2)


def end_counts(rows: DataFrame, end: str) -> DataFrame:
    """_n (rows), and of each half of the labelled rows the blocked (_block) and all (_all), for each end of a host."""
    of = lambda half, what: F.sum(F.when(F.col("_half") == half, what).otherwise(0))
    counts = (c for h in (0, 1) for c in (of(h, F.coalesce("label", F.lit(0))).alias(f"_block{h}"), of(h, F.col("label").isNotNull().cast("int")).alias(f"_all{h}")))
    return rows.groupBy(end).agg(F.count(F.lit(1)).alias("_n"), *counts)


def block_rate(*halves: int) -> Column:
    """Of the labelled rows of the halves, as if one more were blocked and one more allowed."""
    both = lambda c: reduce(lambda a, b: a + b, (F.col(f"{c}{h}") for h in halves))
    return (both("_block") + 1) / (both("_all") + 2)


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and block_score (the trees' probability of block) for each row."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = parts(url)
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("_fit", fitting(rules, F.col("host"), F.col("path")))
    rows = rows.withColumns(features(url, F.col("host"), F.col("path"))).withColumns({f"_{k}": F.regexp_extract("host", v, 0) for k, v in ENDS.items()})
    rows = rows.withColumn("_hash", F.xxhash64(url)).withColumn("_half", F.pmod("_hash", F.lit(2))).drop("_url")
    rows = rows.withColumn("label", F.when(F.col("_fit").isNotNull(), (F.col("_fit.verdict") == "block").cast("int")))
    known = checkpointed(rows.where("label is not null").orderBy("_hash", "host", "path").limit(sample).select(*(f"_{k}" for k in ENDS), "_half", *FEATURES[: -len(ENDS)], "label"))
    n_rows, all_rows = rows.count(), rows
    for rate in ENDS:
        stats = checkpointed(end_counts(rows, f"_{rate}"))
        few = stats.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
        whole = stats.select(f"_{rate}", "_n", block_rate(0, 1).alias(rate))
        all_rows = all_rows.join(F.broadcast(whole), f"_{rate}") if few else joined_hot(all_rows, whole, [f"_{rate}"], "_n", n_rows)
        all_rows = all_rows.drop("_n")
        other = F.when(F.col("_half") == 0, block_rate(1)).otherwise(block_rate(0))
        known = known.join(F.broadcast(stats) if few else stats, f"_{rate}").withColumn(rate, other).select(*known.columns, rate)
    model = boost(known)
    score = 1 / (1 + F.exp(-model.margin({f: F.col(f) for f in FEATURES})))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(score > threshold, "block").otherwise("allow"))
    return all_rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"), score.alias("block_score"))
