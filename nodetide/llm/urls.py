"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest. DataFrame operations only.

Rules name a host and the beginning of a path; the longest that fits a url decides. The urls that rules decide are the
labelled ones: trees are fitted on a bounded sample of them (`train_rows`) and judge the urls that no rule fits. Suffix
statistics are taken over all urls: how many there are, and the share of blocked ones among those that rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import spare_name, staged
from nodetide.session import enable_checkpoints

ALLOW, BLOCK = "allow", "block"
#: Prior weight of the overall share in a suffix's share of blocked urls.
PRIOR = 20.0
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "letter_ratio", "entropy", "host_entropy", "parameters",
            "query_length", "hyphens", "escapes", "longest_part", "has_fragment", "is_secure", "suffix_log_count", "suffix_block_share")


@dataclass(frozen=True)
class Rule:
    """`text` is host/path, the path a beginning; `verdict` is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class UrlConfig:
    """Rules, and how the trees are grown; `train_rows` bounds the labelled urls fitted on."""

    rules: tuple[Rule, ...] = field(default=())
    train_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    step: float = 0.2
    seed: int = 17


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or a url without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or a url without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct rule, verdict of the longest rule that fits; null without one."""
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        own = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        fits = F.when(own & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.length(whole) > 0, F.length(part) / F.length(whole)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a url (not null), but for the suffix statistics."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = lambda unwanted: F.regexp_replace(url, unwanted, "")
    return {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")), "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _share(kept("[^0-9]"), url), "letter_ratio": _share(kept("[^A-Za-z]"), url), "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "query_length": F.length(query), "hyphens": F.length(kept("[^-]")),
        "escapes": F.length(kept("[^%]")), "longest_part": F.array_max(F.transform(F.split(url, "[^A-Za-z0-9]+"), F.length)),
        "has_fragment": (F.instr(url, "#") > 0).cast("int"), "is_secure": F.startswith(url, F.lit("https")).cast("int"),
    }


def _with_features(urls: DataFrame, stats: DataFrame, overall: float) -> DataFrame:
    """`urls` has url, host, path, suffix; one row of `stats` for each suffix."""
    made = urls.withColumns({k: v.cast("double") for k, v in lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")).items()})
    made = made.join(stats, "suffix", "left").withColumns({
        "suffix_log_count": F.log1p(F.coalesce("n", F.lit(0)).cast("double")),
        "suffix_block_share": (F.coalesce("blocked", F.lit(0)) + PRIOR * overall) / (F.coalesce("decided", F.lit(0)) + PRIOR)})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)


def _fit(labelled: DataFrame, stats: DataFrame, overall: float, config: UrlConfig) -> GBTClassificationModel:
    """Trees on a sample of the distinct labelled urls that is drawn by a hash of the url.

    Where they are more than `train_rows`, each class may fill half of the sample, and what the other leaves free; a row
    then weighs as much as the urls of its class that it stands for.
    """
    once = staged(labelled.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("suffix").alias("suffix"),
                                              F.first("blocked_url").alias("blocked_url")), "labelled-urls")
    total = {r["blocked_url"]: r["count"] for r in once.groupBy("blocked_url").count().collect()}
    rows = config.train_rows
    share = {c: min(1.0, max(rows // 2, rows - total[not c]) / n) for c, n in total.items()}
    own = F.when(F.col("blocked_url"), share[True]).otherwise(share[False])
    drawn = once.where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < own * (1 << 40)).withColumn("weight", 1 / own)
    sample = staged(_with_features(drawn, stats, overall).select("features", F.col("blocked_url").cast("double").alias("target"), "weight"), "url-sample")
    enable_checkpoints(labelled.sparkSession)
    trees = GBTClassifier(labelCol="target", weightCol="weight", maxIter=config.trees, maxDepth=config.depth, stepSize=config.step, seed=config.seed,
                          subsamplingRate=1.0)
    return trees.fit(sample) if sample.select("target").distinct().count() == 2 else None


def judge(pages: DataFrame, config: UrlConfig, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For every row its id, host, path, rule (null without one), verdict (allow or block) and block_score (0 to 1).

    A null url, or one without ://, has empty host and path; no rule fits it, the trees judge it as they judge an empty text
    or the text it is. Where the rules decide no url, or all alike, no trees can be fitted: then what they decide counts for
    the others too, `allow` if they decide none. Repeated rows are judged alike; further columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    key = spare_name(pages, "page_key")[0]
    urls = pages.select(F.col(id_col).alias(key), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("found", rule_of(F.col("host"), F.col("path"), config.rules))
    urls = urls.withColumns({"suffix": F.substring_index("host", ".", -1), "blocked_url": F.col("found.verdict") == BLOCK})
    stats = staged(urls.groupBy("suffix").agg(
        F.count("*").alias("n"), F.count("blocked_url").alias("decided"), F.count_if("blocked_url").alias("blocked")), "suffixes")
    decided, blocked = stats.agg(F.sum("decided"), F.sum("blocked")).first()
    decided, blocked = decided or 0, blocked or 0
    overall = blocked / decided if decided else 0.0
    model = _fit(urls.where("found is not null"), stats, overall, config) if 0 < blocked < decided else None
    if model is None:
        scored = urls.withColumn("block_score", F.lit(1.0 if decided and blocked == decided else 0.0))
    else:
        scored = model.transform(_with_features(urls, stats, overall)).withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(F.col(key).alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"),
                         F.when(F.col("found").isNull(), F.col("block_score")).otherwise(F.col("blocked_url").cast("double")).alias("block_score"))
