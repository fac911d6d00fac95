"""URL filters: gradient-boosted trees on lexical features, in DataFrame and SQL functions only.

Rules (host, path) decide the URLs they fit; the trees decide the rest. The labelled URLs are the small table of
``url_labels``, both of whose labels stand under each of its domains, or a table (url, label) that the caller gives; the trees are
fitted on at most ``SAMPLE`` of them, chosen by hash. Features: lengths, path depth, shares of digits, hyphens and
other signs, entropy of host and path characters, parameters, scheme, and two suffix statistics: the smoothed share of
blocked URLs and the number of labelled URLs under the host's last label and under its last two labels. For a URL that is judged
they come from all labelled URLs; the rows the trees are fitted on get them from the other of two folds, so that no
label takes part in its own statistics.

Defined cases. Null URL, or one without ``://``: host and path are empty, no rule fits, verdict of the trees on
empty features. Fewer than 20 labelled URLs of either label: URLs without a rule are allowed. Null or repeated
page_ids: one result row for each row. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import trees, url_labels
from pairlab.llm.scratch import Run

#: Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SAMPLE = 20_000
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digits", "host_digits", "hyphens", "signs",
            "host_entropy", "path_entropy", "parameters", "query_length", "fragment", "secure", "www", "longest_label",
            "tld_share", "tld_n", "domain_share", "domain_n"]
#: Weight of the overall share in a suffix's smoothed share.
PRIOR = 5.0


def parts(urls: DataFrame) -> DataFrame:
    """Adds host, path and query."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    has = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    lower = F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (urls.withColumn("_rest", F.when(has, rest).otherwise(F.lit("")))
            .withColumn("host", lower).withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
            .withColumn("query", F.regexp_extract("_rest", r"(?s)^[^?#]*\?([^#]*)", 1))
            .withColumn("fragment", F.contains("_rest", F.lit("#")).cast("double")).drop("_rest"))


def rule() -> Column:
    """The longest rule that fits host and path: struct of verdict and name."""
    def name(host: str, path: str) -> str:
        return host + path

    ordered = sorted(RULES, key=lambda r: -len(name(*r[1:])))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name(host, path)).alias("rule"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character, over the characters a-z, 0-9, and all others as one."""
    n = F.greatest(F.length(text), F.lit(1))
    kinds = [F.length(text) - F.length(F.translate(text, c, "")) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    rest = n - reduce(lambda a, b: a + b, kinds)
    return reduce(lambda a, b: a + b, [F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0) for k in [*kinds, rest]])


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the two suffixes of the host to rows with host, path and query."""
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", r"\.")
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    path = F.translate("path", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_labels": F.size(labels), "depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "digits": digits(url) / F.greatest(F.length(url), F.lit(1)), "host_digits": digits(F.col("host")),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "signs": F.length(F.regexp_replace(url, "[A-Za-z0-9:/.]", "")) / F.greatest(F.length(url), F.lit(1)),
        "host_entropy": entropy(F.col("host")), "path_entropy": entropy(path),
        "parameters": F.when(F.col("query") == "", 0).otherwise(F.size(F.split("query", "[&;]"))),
        "query_length": F.length("query"), "secure": url.startswith("https").cast("double"),
        "www": F.col("host").startswith("www.").cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    }
    out = urls.withColumns({k: v.cast("double") for k, v in named.items()})
    return out.withColumns({"tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) of the table in ``url_labels``."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for label, urls in enumerate((url_labels.ALLOW, url_labels.BLOCK)) for u in urls]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def suffixes(labelled: DataFrame) -> DataFrame:
    """Labelled and blocked URLs under each suffix: fold, kind, suffix, n, blocked."""
    return reduce(DataFrame.unionByName, [
        labelled.groupBy("fold", F.lit(k).alias("kind"), F.col(k).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        for k in ("tld", "domain")])


def with_suffixes(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the suffix features from the labelled URLs that ``stats`` counts."""
    total = stats.filter("kind = 'tld'").agg((F.sum("blocked") / F.sum("n")).alias("overall")).first()
    overall = F.lit(total["overall"] or 0.0)
    for k in ("tld", "domain"):
        side = stats.filter(F.col("kind") == k).groupBy(F.col("suffix").alias(k)).agg(F.sum("n").alias("_n"), F.sum("blocked").alias("_b"))
        rows = rows.join(side, k, "left")
        n, b = F.coalesce("_n", F.lit(0)), F.coalesce("_b", F.lit(0))
        rows = rows.withColumns({f"{k}_share": (b + PRIOR * overall) / (n + PRIOR), f"{k}_n": F.log1p(n.cast("double"))}).drop("_n", "_b")
    return rows


def train(labelled: DataFrame, run: Run) -> tuple[GBTClassificationModel | None, DataFrame]:
    """The trees (None with fewer than 20 URLs of either label) and the suffix counts, from (url, label)."""
    known = lexical(parts(labelled.select(F.col("url"), F.col("label").cast("int").alias("label"))))
    known = run.save(known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(2))), "known")
    stats = run.save(suffixes(known), "suffixes")
    sample = trees.bounded(known, SAMPLE, "url")
    folds = [with_suffixes(sample.filter(F.col("fold") == i), stats.filter(F.col("fold") != i)) for i in (0, 1)]
    sample = folds[0].unionByName(folds[1]).coalesce(1)   # bounded by SAMPLE: short rows, not worth more tasks
    return trees.fit(run.save(sample, "sample"), FEATURES, depth=3), stats


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of block (null where a rule decides)."""
    run = Run(pages.sparkSession, "urls")
    rows = parts(pages.select("page_id", "url")).withColumn("r", rule())
    rows = run.save(lexical(rows), "rows")
    model, stats = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, run)
    ruled = rows.filter("r IS NOT NULL").withColumn("p", F.lit(None).cast("double"))
    rest = with_suffixes(rows.filter("r IS NULL"), stats)
    rest = trees.score(model, rest, FEATURES) if model else rest.withColumn("p", F.lit(0.0))
    cols = ["page_id", "host", "path", F.col("r.rule").alias("rule"),
            F.coalesce("r.verdict", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p"]
    return ruled.select(*cols).unionByName(rest.select(*cols))
