"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features for the URLs that no rule judges.

Parts. The host lies after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; the path follows, up to `?`, `#` or the end. A URL
that is null or has no `://` has an empty host and path.

Rules. A rule (verdict, host, path) fits its host and all of its subdomains if the path starts with the rule's. Of several that fit, the
longest wins. Rules are a short list given by the caller and are part of the plan.

Method. URLs that a rule judges are the labelled ones, unless a table of labels is given. Features: lengths of URL, host, path and query,
depth, ratio of digits, entropy of the characters, numbers of parameters, of labels in the host, of hyphens and of dots in the path; and
statistics of suffixes (the host, its last two labels, its last label, the file's suffix, and the first directory): how many labelled
URLs have it, and which share of them is blocked, drawn to the overall share by `PRIOR` pseudo-rows. Statistics are sums over all rows.
The rows that the trees are fitted on take them from the other folds of the labelled URLs (`FOLDS`, by hash), so the trees don't learn to trust
what a row itself has taught. The trees
(pyspark.ml's GBTClassifier) are fitted on `fit_rows` labelled URLs at most: each different URL is one weighted row, and where there are more,
those whose hash is small enough stay. Suffixes go by their MD5, so that a side of at most `SMALL` of them is small in bytes too
and is broadcast; a larger one is joined by shuffle, in which Spark splits hot suffixes.

Null, empty and very long URLs are judged by the method on their whole text (a null as an empty one). Equal URLs are one row while the trees
are fitted, weighted by their number, and each gets its verdict. If the labelled URLs have one verdict only, the rest gets that one; if
there are none, the rest is allowed. An empty table gives an empty result. Columns named as results are replaced.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import is_small, keep, without

#: Rules of the production query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PRIOR = 5.0
FOLDS = 5
SMALL = 200_000
KINDS = ["host", "domain", "top", "file", "directory"]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL; empty where it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))

    def until(c: Column, *marks: str) -> Column:
        return reduce(lambda x, m: F.substring_index(x, m, 1), marks, c)

    own = until(rest, "/", "?", "#")
    after = F.substring(rest, F.length(own) + 1, F.length(rest))
    path = until(after, "?", "#")
    tail = until(F.substring(after, F.length(path) + 1, F.length(after)), "#")
    return F.translate(own, string.ascii_uppercase, string.ascii_lowercase), path, F.when(F.startswith(tail, F.lit("?")), F.substring(tail, F.lit(2), F.length(tail))).otherwise("")


def judge(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule's text is its host and path."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def entropy(c: Column) -> Column:
    """Bits for each character."""
    n = F.length(c)
    shares = F.transform(F.array_distinct(F.split(c, "")), lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _count(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path, query) with the columns of `FEATURES` that need no statistics, and a key for each kind of suffix."""
    url = F.coalesce("url", F.lit(""))
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
    tokens = {
        "host": host, "domain": F.substring_index(host, ".", -2), "top": F.substring_index(host, ".", -1),
        "file": F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise(""), "directory": F.coalesce(F.get(segments, 0), F.lit("")),
    }
    return rows.withColumns(
        {
            "n_url": F.length(url).cast("double"), "n_host": F.length(host).cast("double"), "n_path": F.length(path).cast("double"), "n_query": F.length(query).cast("double"),
            "depth": F.size(segments).cast("double"), "digits": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0), "entropy": entropy(url),
            "n_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "n_labels": F.when(host == "", 0.0).otherwise(_count(host, ".") + 1),
            "n_hyphens": _count(url, "-"), "n_dots": _count(path, "."),
        }
        | {f"k_{k}": F.md5(F.concat(F.lit(f"{k}:"), t)) for k, t in tokens.items()}
    )


PLAIN = ["n_url", "n_host", "n_path", "n_query", "depth", "digits", "entropy", "n_params", "n_labels", "n_hyphens", "n_dots"]
FEATURES = [*PLAIN, *[f"{x}_{k}" for k in KINDS for x in ("share", "seen")]]


def with_statistics(rows: DataFrame, stats: DataFrame, prior: float, own: bool = False) -> DataFrame:
    """rows with share and number of the labelled URLs that have each of their suffixes; with `own`, less those of the row's fold."""
    for k in KINDS:
        known = stats.where(F.col("kind") == k).select(F.col("key").alias(f"k_{k}"), F.col("n").alias(f"_n_{k}"), F.col("blocked").alias(f"_b_{k}"), *([F.col("folds").alias(f"_f_{k}")] if own else []))
        rows = rows.join(F.broadcast(known) if is_small(known, SMALL) else known, f"k_{k}", "left")
        n, b = F.coalesce(f"_n_{k}", F.lit(0)).cast("double"), F.coalesce(f"_b_{k}", F.lit(0)).cast("double")
        if own:
            mine = F.get(f"_f_{k}", F.col("fold"))
            n, b = n - mine["n"], b - mine["b"]
        rows = rows.withColumns({f"share_{k}": (b + PRIOR * prior) / (n + PRIOR), f"seen_{k}": F.log1p(n)}).drop(f"_n_{k}", f"_b_{k}", f"_f_{k}")
    return rows


def statistics(labelled: DataFrame) -> DataFrame:
    """(kind, key, n, blocked, folds: n and b of each fold) over labelled rows (k_*, fold, weight, label)."""
    bad = F.col("weight") * F.col("label")

    def of(fold: int) -> Column:
        return F.struct(F.sum(F.when(F.col("fold") == fold, F.col("weight")).otherwise(0.0)).alias("n"), F.sum(F.when(F.col("fold") == fold, bad).otherwise(0.0)).alias("b"))

    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key")) for k in KINDS])).alias("s")
    return labelled.select(keys, "fold", "weight", "label").groupBy("s.kind", "s.key").agg(F.sum("weight").alias("n"), F.sum(bad).alias("blocked"), F.array(*map(of, range(FOLDS))).alias("folds"))


class Model:
    """What `learn` has learned: statistics of suffixes (a table in the shared folder), the overall share, and the trees; without trees one verdict for all."""

    def __init__(self, stats: DataFrame, prior: float, trees=None, only: str = "allow"):
        self.stats, self.prior, self.trees, self.only = stats, prior, trees, only

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path, query) with `blocked`, the trees' probability that a URL is to be blocked."""
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(1.0 if self.only == "block" else 0.0))
        columns = rows.columns
        scored = self.trees.transform(with_statistics(lexical(rows), self.stats, self.prior))
        return scored.select(*columns, vector_to_array("probability")[1].alias("blocked"))


def learn(labelled: DataFrame, fit_rows: int = 50_000, seed: int = 1) -> Model:
    """A model from URLs (url, host, path, query, verdict)."""
    label = (F.col("verdict") == "block").cast("double")
    one = labelled.groupBy("url", "host", "path", "query", label.alias("label")).agg(F.count("*").cast("double").alias("weight"))
    one = keep(lexical(one).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(FOLDS)).cast("int")), "labelled-urls")
    n, total, blocked = one.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.col("weight") * F.col("label")), F.lit(0.0))).first()
    stats = keep(statistics(one), "suffixes")
    if blocked in (0, total):
        return Model(stats, 0.0, only="block" if blocked else "allow")
    prior = blocked / total
    if n > fit_rows:
        one = one.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    sample = keep(with_statistics(one, stats, prior, own=True).select(*FEATURES, "label", "weight"), "fitted-urls")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.3, seed=seed, cacheNodeIds=False)
    return Model(stats, prior, Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(sample))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", labels: DataFrame | None = None, fit_rows: int = 50_000) -> DataFrame:
    """pages with `host`, `path`, `rule` (null where none fits) and `verdict`: the rule's, else the method's. labels (url, verdict): what the trees
    learn from beside what the rules judge."""
    host, path, query = parts(F.col("_url"))
    pages = without(pages, "host", "path", "rule", "verdict", "query", "_url", "_said", "blocked").withColumn("_url", F.col(f"`{url}`").cast("string"))
    rows = pages.withColumns({"host": host, "path": path, "query": query})
    rule, said = judge(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_said": said})
    named = ["host", "path", "query"]
    taught = rows.where("_said IS NOT NULL").select(F.col("_url").alias("url"), *named, F.col("_said").alias("verdict"))
    if labels is not None:
        more = labels.select(F.col("url").alias("_url"), "verdict").withColumns(dict(zip(named, (host, path, query), strict=True)))
        taught = taught.unionByName(more.select(F.col("_url").alias("url"), *named, "verdict"))
    model = learn(taught, fit_rows)
    others = [c for c in rows.columns if c not in named and c not in ("_url", "rule", "_said")]
    packed = rows.select(F.struct(*others).alias("_row"), F.col("_url").alias("url"), *named, "rule", "_said")
    done = model.score(packed)
    verdict = F.coalesce("_said", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return done.select("_row.*", "host", "path", "rule", verdict.alias("verdict"), "blocked")
