"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Labelled rows that the trees are fitted on, at most about so many, half of each label; a hash of the row chooses. Statistics use all rows.
SAMPLE = 20_000
#: Rates of a labelled URL are worked out from the other ones of so many folds.
FOLDS = 8
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "query_length",
            "longest_label", "suffix_rate", "directory_rate")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, CAPITALS.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together) that fits; NULL if none. Ties go to the rule listed first."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))

    def share(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total + share(c))


def own_path(path: Column, rules: Sequence[Rule]) -> Column:
    """``path`` after the longest directory that a rule's path names, whatever the rule's host.

    Labels come from rules, so what a rule looks at must not be counted: the directory itself, and the depth and length that it adds.
    """
    out = path
    for name in sorted({r.path[:r.path.rfind("/") + 1] for r in rules}, key=lambda d: (len(d), d)):
        if len(name) > 1:
            out = F.when(path.startswith(name), F.substr(path, F.lit(len(name)))).otherwise(out)  # its last slash stays
    return out


def lexical(urls: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Adds the features that a URL alone gives, its suffix (last two labels of the host) and its first directory that no rule names."""
    host, path = F.col("host"), F.col("path")
    rest = F.substr(F.coalesce("url", F.lit("")), F.instr(F.coalesce("url", F.lit("")), "://") + F.length(host) + F.length(path) + 3)
    urls = urls.withColumn("own", own_path(path, rules)).withColumn("counted", F.concat(host, "own", rest))
    url, path, labels = F.col("counted"), F.col("own"), F.split(host, r"\.")
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    return urls.withColumns({
        "length": F.length(url), "host_length": F.length(host),
        "depth": F.regexp_count(path, F.lit("/[^/]+")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url), "parameters": F.regexp_count(query, F.lit("[^&]+")), "labels": F.size(labels),
        "hyphens": F.regexp_count(host, F.lit("-")), "query_length": F.length(query),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "suffix": F.substring_index(host, ".", -2), "directory": F.regexp_extract(path, "^/([^/]*)", 1)})


def fold(url: Column) -> Column:
    """Equal URLs lie in one fold."""
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def _rates(labelled: DataFrame, by: str, prior: float) -> DataFrame:
    """Shares of blocked URLs a value, each without one of the folds and, last, without none, over all labelled rows, drawn towards the share of all.

    A labelled URL takes the rate without its own fold, so that the rate of a value seen once says nothing about its label; others take the full one.
    """
    sums = labelled.groupBy(F.col(by).alias(f"{by}_of")).agg(
        F.sum("label").alias("blocked"), F.count("*").alias("n"),
        *[F.sum(F.when(fold(F.col("url")) == k, F.col("label")).otherwise(0.0)).alias(f"blocked_{k}") for k in range(FOLDS)],
        *[F.count(F.when(fold(F.col("url")) == k, 1)).alias(f"n_{k}") for k in range(FOLDS)])

    def rate(blocked: Column, n: Column) -> Column:
        return (blocked + F.lit(5.0 * prior)) / (n + F.lit(5.0))

    rates = [*[rate(F.col("blocked") - F.col(f"blocked_{k}"), F.col("n") - F.col(f"n_{k}")) for k in range(FOLDS)], rate(F.col("blocked"), F.col("n"))]
    return sums.select(f"{by}_of", F.array(*rates).alias(f"{by}_rates"))


def _features(urls: DataFrame, suffixes: DataFrame, directories: DataFrame, prior: float) -> DataFrame:
    """``urls`` says in ``fold`` which fold's labels a row may not see (FOLDS: it has no label)."""
    for by, rates in (("suffix", suffixes), ("directory", directories)):
        urls = urls.join(rates, urls[by] == rates[f"{by}_of"], "left").withColumn(f"{by}_rate", F.get(f"{by}_rates", F.col("fold"))).drop(f"{by}_of", f"{by}_rates")
    rows = urls.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(prior if f.endswith("_rate") else 0.0)) for f in FEATURES})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, trees: int = 10, depth: int = 4) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (probability of a block by the trees).

    The longest fitting rule decides. URLs that a rule fits are the labelled ones; gradient-boosted trees are fitted on a sample of
    at most about ``sample`` of them and decide the others: block from 0.5 on. A hash of page_id and URL chooses from each label up to half of
    the sample, and a chosen row weighs as much as the rows that it stands for. Rates of suffixes and directories count all labelled rows,
    but for a labelled row those of its own fold; the directories that rules name are left out of all features. Without labelled URLs of both kinds
    there is nothing to learn: the others get the only label there is, or allow. Null URLs and those without ``://`` have empty host
    and path, fit no rule and are judged by the trees as an empty URL. Repeated rows stay. Empty table: no rows.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host, "path": path})
    name, verdict = matching(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "given": verdict})
    known = urls.where("given IS NOT NULL").withColumn("label", (F.col("given") == "block").cast("double"))
    n, blocked = known.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, float(n)):
        rest = "block" if n and blocked else "allow"
        return urls.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(rest)).alias("verdict"),
                           F.lit(1.0 if rest == "block" else 0.0).alias("score"))
    grain = 1 << 20
    shares = [min(grain, sample * grain // int(2 * m) + 1) for m in (n - blocked, blocked)]
    share = F.when(F.col("label") == 0, F.lit(shares[0])).otherwise(F.lit(shares[1]))
    known = lexical(known, rules).withColumns({"weight": F.lit(float(grain)) / share, "fold": fold(F.col("url"))})
    train = materialise(known.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(grain)) < share), "labelled")
    prior = float(blocked) / n
    suffixes, directories = (materialise(_rates(known, by, prior), by) for by in ("suffix", "directory"))
    model: GBTClassificationModel = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, seed=7, checkpointInterval=-1,
    ).fit(_features(train, suffixes, directories, prior).select("features", "label", "weight"))
    # decided rows are scored as what they were learned from
    asked = lexical(urls, rules).withColumn("fold", F.when(F.col("given").isNotNull(), fold(F.col("url"))).otherwise(F.lit(FOLDS)))
    scored = model.transform(_features(asked, suffixes, directories, prior))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         score.alias("score"))
