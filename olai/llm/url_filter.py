"""URL filter: rules by host and path, and boosted trees on lexical features for the rest (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import ascii_lower, materialise

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "is_https", "host_entropy", "path_entropy", "longest_digits", "lead_length", "lead_log_count", "suffix_length", "suffix_depth", "suffix_digits")


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], verdict: bool = False) -> Column:
    """The longest rule ``(host/path, verdict)`` that fits a host or subdomain and the start of a path; else null."""
    found = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(says if verdict else rule)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.aggregate(F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), bits), F.lit(0.0), lambda a, b: a + b)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds ``host, path`` and the features to rows with a column ``url``.

    Statistics of suffixes (the host's last label) and of leads (the path's
    first segment) come from all rows, and from no label. Those of a suffix
    enter as what the URL has beyond its mean: the means themselves would name
    the suffix, and the trees would learn the rules' own hosts.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    parts = urls.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url)
    parts = parts.withColumns({
        "suffix": F.substring_index(host, ".", -1),
        "lead": F.regexp_extract(path, "^/([^/]*)", 1),
        "host_entropy": F.when(host == "", 0.0).otherwise(_entropy(host)),
        "path_entropy": F.when(path == "", 0.0).otherwise(_entropy(path)),
        "longest_digits": F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), F.length))).cast("double"),
        "url_length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "labels": F.when(host == "", 0.0).otherwise(F.regexp_count(host, F.lit(r"\.")) + 1.0),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "entropy": F.when(n > 0, _entropy(url)).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_https": F.startswith(url, F.lit("https:")).cast("double"),
    })
    stats = parts.groupBy("suffix").agg(
        F.avg("url_length").alias("mean_length"),
        F.avg("depth").alias("mean_depth"),
        F.avg("digit_ratio").alias("mean_digits"),
    )
    # A lead shared by many pages, and a suffix even more so: rows meet small tables of counts, of which Spark splits the skew.
    leads = materialise(parts.groupBy("lead").agg(F.log1p(F.count(F.lit(1))).alias("lead_log_count"), F.length("lead").cast("double").alias("lead_length")), "url-leads")
    parts = parts.join(materialise(stats, "url-suffixes"), "suffix", "left").join(leads, "lead", "left")
    return parts.withColumns({
        "suffix_length": F.col("url_length") - F.col("mean_length"),
        "suffix_depth": F.col("depth") - F.col("mean_depth"),
        "suffix_digits": F.col("digit_ratio") - F.col("mean_digits"),
    })


def fit_trees(sample: DataFrame, trees: int = 12, depth: int = 4):
    """Gradient-boosted trees on rows with ``label`` (0 or 1) and the features; both labels weigh the same in total."""
    total = sample.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    weight = F.when(F.col("label") == 1, total["n"] / (2 * total["ones"])).otherwise(total["n"] / (2 * (total["n"] - total["ones"])))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.withColumn("weight", weight))
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, weightCol="weight").fit(rows)


def score_trees(model, rows: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    found = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return found.withColumn("score", vector_to_array("probability")[1])


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    fit_rows: int = 20_000,
    trees: int = 12,
    depth: int = 4,
) -> DataFrame:
    """Judge every URL: by its longest fitting rule, else by gradient-boosted trees.

    The URLs that a rule decides are the labelled ones. The trees learn from at
    most ``fit_rows`` of them (the bound of the fit: the first by md5 of the
    URL), allowed and blocked ones weighing the same, on lexical features and
    on statistics of the host's last label and the path's first segment over
    all pages, and score every URL.

    Returns one row per input row: ``page_id, host, path, rule, score, verdict``;
    ``score`` is the trees' probability of block. A null URL or one without
    ``://`` has an empty host and path and no rule, and is scored as it is.
    Where no rule decides any URL the score is 0; where rules give one verdict
    only, that verdict holds for all. Repeated rows are judged alike; an empty
    table gives an empty result; other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = lexical_features(urls)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, verdict=True))
    rows = materialise(rows.select("page_id", "url", "host", "path", "rule", "ruled", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES]), "url-features")

    labelled = rows.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    sample = labelled.select("label", *FEATURES, F.md5("url").alias("_by")).orderBy("_by", *FEATURES).limit(fit_rows)
    sample = materialise(sample.drop("_by").coalesce(1), "url-sample")
    classes = {r["label"] for r in sample.select("label").distinct().take(2)}
    if len(classes) == 2:
        scored = score_trees(fit_trees(sample, trees, depth), rows)
    else:
        scored = rows.withColumn("score", F.lit(1.0 if classes == {1.0} else 0.0))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", F.round("score", 6).alias("score"), verdict.alias("verdict"))
