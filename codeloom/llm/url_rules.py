"""URL filtering: a list of host and path rules, and association rules mined from labels.

URLs become sets of tokens; FP-growth finds the token sets that go with a bad label often and
surely enough. A URL looks its tokens up in an inverted index of the rules, keyed by each rule's rarest
token, and is blocked if all tokens of some rule are there. DataFrame and Spark ML expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_split, materialize, partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: The item that marks a bad row.
BAD = "label:bad"


@dataclass(frozen=True)
class SiteRule:
    """``verdict`` for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def by_rules(rules: list[SiteRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits; nulls if none does. Of equal length, the first listed wins."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        name, verdict = name.when(rule.fits(host, path), F.lit(rule.name)), verdict.when(rule.fits(host, path), F.lit(rule.verdict))
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host, first and last label, words of hyphenated labels, path segments, query keys, fragment.

    Digits are read as ``0``. A URL without ``://`` has no tokens.
    """
    host, path = url_host(url), url_path(url)

    def plain(column: Column) -> Column:
        return F.regexp_replace(F.lower(column), "[0-9]+", "0")

    def tagged(tag: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(tag), plain(x)))

    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    one = lambda column: F.array(column)
    found = F.concat(
        tagged("scheme:", one(F.regexp_extract(url, _PARTS, 1))), tagged("host:", one(host)), tagged("first:", F.slice(labels, 1, 1)), tagged("last:", F.slice(labels, -1, 1)),
        tagged("word:", words), tagged("path:", F.split(path, "/")), tagged("key:", F.transform(F.split(F.regexp_extract(url, _PARTS, 4), "&"), lambda x: F.substring_index(x, "=", 1))),
        tagged("part:", one(F.regexp_extract(url, _PARTS, 5))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def mine_rules(labelled: DataFrame, least_rows: int = 8, support: float = 0.001, confidence: float = 0.6, most_tokens: int = 3) -> DataFrame:
    """(tokens, anchors, confidence, rows): token sets whose rows are bad with ``confidence``, from (tokens, bad).

    A rule's tokens and a bad label occur together in ``support`` of the rows and ``least_rows`` of them at least. Tokens that occur in
    the same rows stand for each other, so a rule's tokens are lists of alternatives; the anchors are the rarest one's. A
    rule that contains a rule at least as sure is dropped. No rows: no rules.

    What adds no rule is left out before FP-growth: tokens of too few bad rows, and tokens that are sure alone, which are rules by themselves.
    """
    schema = "tokens array<array<string>>, anchors array<string>, confidence double, rows long"
    labelled = materialize(labelled.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    total = labelled.count()
    if total < least_rows:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(least_rows, -(-total * support // 1))
    marks = [F.sum(F.xxhash64("_row", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    counted = labelled.select("_row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("bad").alias("rows"), F.count(F.lit(1)).alias("uses"), *marks)
    same = counted.where(F.col("rows") >= least).groupBy("rows", "uses", "m1", "m2").agg(F.min("token").alias("one"), F.sort_array(F.collect_set("token")).alias("all"))
    same = materialize(same.select("one", "all", "rows", "uses"), "url-tokens")
    alone = same.where("rows = uses").select(F.array("all").alias("tokens"), F.col("all").alias("anchors"), F.lit(1.0).alias("confidence"), "rows")
    # A class is counted where its first token is.
    used = labelled.select("_row", F.explode("tokens").alias("one")).join(same.where("rows < uses").select("one"), "one").groupBy("_row").agg(F.collect_set("one").alias("items"))
    items = used.join(labelled.select("_row", "bad"), "_row").select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    items = materialize(items, "url-items")
    fed = items.count()
    if not fed:
        return alone
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / fed), minConfidence=confidence, numPartitions=partitions(labelled.sparkSession)).fit(items)
    sets = model.freqItemsets.where(F.size("items") <= most_tokens + 1)
    sets = materialize(sets.select(F.sort_array("items").alias("items"), "freq"), "url-itemsets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("rows"))
    sure = bad.join(sets, "items").where(F.col("rows") >= confidence * F.col("freq")).select(F.col("items").alias("tokens"), (F.col("rows") / F.col("freq")).alias("confidence"), "rows")
    # Every proper part of a rule, to look for a rule that is as sure.
    n = F.size("tokens")
    parts = F.filter(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), most_tokens) - 2), lambda m: F.filter("tokens", lambda x, i: F.getbit(m, i) == 1)), lambda p: (F.size(p) > 0) & (F.size(p) < n))
    sure = materialize(sure, "url-sure")
    inner = sure.select("tokens", "confidence", F.explode(F.array_distinct(parts)).alias("part"))
    weaker = inner.join(sure.select(F.col("tokens").alias("part"), F.col("confidence").alias("other")), "part").where("other >= confidence").select("tokens").distinct()
    kept = sure.join(weaker, "tokens", "left_anti")
    named = kept.withColumn("one", F.explode("tokens")).join(same.select("one", "all", "uses"), "one")
    rarest = named.groupBy("tokens", "confidence", "rows").agg(F.sort_array(F.collect_list("all")).alias("lists"), F.min(F.struct("uses", "one", "all")).alias("x"))
    return alone.unionByName(rarest.select(F.col("lists").alias("tokens"), F.col("x.all").alias("anchors"), "confidence", "rows"))


def blocked_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, confidence, copies) of the distinct URLs that some mined rule fits, with the surest rule's confidence and the URL's number of rows."""
    tokens = urls.where(F.col(url_col).isNotNull()).groupBy(url_col).agg(F.count(F.lit(1)).alias("copies")).withColumn("_tokens", url_tokens(F.col(url_col)))
    index = rules.select(F.explode("anchors").alias("_token"), F.col("tokens").alias("_wanted"), "confidence")
    hits = tokens.withColumn("_token", F.explode("_tokens")).join(index, "_token").where(F.forall("_wanted", lambda w: F.arrays_overlap(w, F.col("_tokens"))))
    return hits.groupBy(url_col).agg(F.max("confidence").alias("confidence"), F.max("copies").alias("copies"))


def judge_urls(pages: DataFrame, labelled_urls: DataFrame, site_rules: list[SiteRule], id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) of every row of ``pages``.

    ``labelled_urls`` has (url, bad). The longest site rule that fits decides; else the mined rules do: ``block`` if one fits, ``allow``
    otherwise. A null URL or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows are judged
    alike; an empty table gives no rows; without labels no rule is mined.
    """
    labelled = labelled_urls.where("bad IS NOT NULL").select(url_tokens(F.col("url")).alias("tokens"), F.col("bad").cast("int").alias("bad")).where(F.size("tokens") > 0)
    rules = materialize(mine_rules(materialize(labelled, "url-labelled"), **mining), "url-rules")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"))
    hits = materialize(blocked_urls(rows, rules), "url-hits")
    judged = join_split(rows.where("url IS NOT NULL"), hits, ["url"], "copies", rows.count(), "left")
    judged = judged.unionByName(rows.where("url IS NULL").withColumn("confidence", F.lit(None).cast("double"))).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    name, verdict = by_rules(site_rules, F.col("host"), F.col("path"))
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


def labels_by_number(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, bad) of the labelled pages: the last number in a page's path is the id of the document that it shows; quality 0 is bad."""
    number = F.expr(f"try_cast(regexp_extract({url_col}, '(?s)^.*?://[^/?#]*[^?#]*?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$', 1) AS BIGINT)")
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return pages.select(F.col(url_col).alias("url"), number.alias("doc_id")).where("doc_id IS NOT NULL").join(own, "doc_id").select("url", "bad")
