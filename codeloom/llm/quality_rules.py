"""Quality rules: text statistics and a learned decision list, in DataFrame expressions only.

Sequential covering learns the list from labelled statistics: a rule grows one threshold at a time by
information gain on two thirds of the sample, is pruned on the rest and is kept while it stays precise
there; what it covers leaves the sample. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_GAP, materialize, text_or_empty

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test; all are defined for any text.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "words_per_line")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the optimizer moves it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(text: Column) -> Column:
    """Words in three-word windows that the text has more than once.

    Repeated windows are neighbours once sorted with their places; the words of such windows count once each.
    """
    word = WORD_GAP.replace("[", "[^")
    window = rf"(?<![^\x20])(?=({word}++ {word}++ {word}++))"

    def of_sorted(s: Column) -> Column:
        pairs = F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.struct(x["at"].alias("i"), y["at"].alias("j"), (x["window"] == y["window"]).alias("same"))), lambda p: p["same"])
        return _let(F.flatten(F.transform(pairs, lambda p: F.array(p["i"], p["j"]))), of_places)

    def of_places(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def of_windows(w: Column) -> Column:
        found = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("window"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _let(found, of_sorted)).otherwise(F.lit(0))

    return _let(F.regexp_extract_all(F.trim(F.regexp_replace(text, WORD_GAP + "+", " ")), F.lit(window), 1), of_windows)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the statistics of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those of ``FEATURES``.

    Words are runs of other than ASCII white space. A null text counts as empty: all statistics are 0.
    Columns of these names in ``docs`` are replaced.
    """
    text = text_or_empty(text_col)

    def only(characters: str) -> Column:
        """How many of these characters the text has."""
        return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_GAP.replace("[", "[^")))
    read = docs.withColumns({
        "n_words": F.regexp_count(text, F.lit(WORD_GAP.replace("[", "[^") + "+")).cast("long"), "word_chars": F.length(F.regexp_replace(text, WORD_GAP + "+", "")).cast("long"),
        "n_symbols": only(SYMBOLS).cast("long"), "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(text).cast("long"), "_upper": only("A-Z"), "_marks": only("!?"), "_lines": F.size(lines),
    })
    chars = F.col("word_chars")
    return read.withColumns({
        "word_length": share(chars, F.col("n_words")), "symbol_share": share(F.col("n_symbols"), chars), "dup_line_share": share(F.col("n_dup_lines"), F.col("_lines")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")), "upper_share": share(F.col("_upper"), chars), "mark_share": share(F.col("_marks"), chars), "words_per_line": share(F.col("n_words"), F.col("_lines")),
    }).drop("_upper", "_marks", "_lines")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    made = F.lit(True)
    for condition in rule:
        made = made & condition.column()
    return made


def decision_list(rules: list[Rule]) -> Column:
    """True where no rule rejects, by the first rule that fits."""
    made = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        made = made.when(covers(rule), F.lit(False))
    return made.otherwise(F.lit(True))


def learn_rules(
    labelled: DataFrame, features: tuple[str, ...] = FEATURES, bad_col: str = "bad", id_col: str = "doc_id", thresholds: int = 19,
    most_rules: int = 8, most_conditions: int = 4, precision: float = 0.8, least_covered: int = 8,
) -> list[Rule]:
    """Rules for the rows whose ``bad_col`` is 1, best first; none if no rule is precise enough.

    ``labelled`` is a bounded sample of features and labels. Each step is one aggregation whose result has a row for a
    feature and a bin at most.
    """
    steps = [(i + 1) / (thresholds + 1) for i in range(thresholds)]
    found = labelled.agg(F.count(F.lit(1)), *[F.percentile(f, F.array(*map(F.lit, steps))) for f in features]).first()
    if not found[0]:
        return []
    cuts = {f: sorted(set(found[i + 1])) for i, f in enumerate(features)}
    bins = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in features])
    sample = labelled.withColumn("_prune", F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(3)) == 0).withColumn("_bins", bins)
    sample = materialize(sample.select(*features, F.col(bad_col).cast("int").alias("_bad"), "_prune", "_bins"), "rules-sample")
    rules: list[Rule] = []
    left = sample
    for _ in range(most_rules):
        rule: Rule = ()
        while len(rule) < most_conditions:
            # Good and bad rows of each feature's bins, among those that the rule covers so far.
            seen = left.where(~F.col("_prune") & covers(rule)).select("_bad", F.explode("_bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
            total_p, total_n = (sum(r[k] for r in seen if r["f"] == features[0]) for k in ("p", "n"))
            if not total_p or not total_n:
                break
            before, best = math.log2(total_p / (total_p + total_n)), (0.0, None)
            for f in features:
                own = {r["b"]: (r["p"], r["n"]) for r in seen if r["f"] == f}
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    p, n = p + own.get(b, (0, 0))[0], n + own.get(b, (0, 0))[1]
                    for above, (x, y) in ((False, (p, n)), (True, (total_p - p, total_n - n))):
                        if x >= least_covered and x + y < total_p + total_n:
                            gain = x * (math.log2(x / (x + y)) - before)
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, above, float(cut)))
            if best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        ends = range(1, len(rule) + 1)
        sums = [F.coalesce(F.sum(F.when(covers(rule[:i]), x)), F.lit(0)) for i in ends for x in (F.col("_bad"), 1 - F.col("_bad"))]
        counts = left.where("_prune").agg(*sums).first()
        scored = [((counts[2 * i - 2] + 1) / (counts[2 * i - 2] + counts[2 * i - 1] + 2), -i, counts[2 * i - 2], counts[2 * i - 1]) for i in ends]
        value, cut, p, n = max(scored)
        if p + n == 0 or p / (p + n) < precision or p < max(1, least_covered // 2):
            break
        rule = rule[:-cut]
        rules.append(rule)
        left = left.where(~covers(rule))
    return rules


def learn_from_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> list[Rule]:
    """Rules for low quality, from at most ``sample_rows`` labelled documents: those whose id's hash is least.

    Labels without id or quality are ignored; rows that repeat an id count once each.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).select(F.col(id_col), (1 - F.col(quality_col)).cast("int").alias("bad"))
    chosen = chosen.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(sample_rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most sample_rows rows
    measured = with_statistics(texts, text_col).select(id_col, "bad", "n_repeat_words", *FEATURES)
    return learn_rules(materialize(measured, "rules-labelled").where(~base_failed()), id_col=id_col)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``; kept is false where the base rules fail or a rule rejects."""
    return with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(decision_list(rules)))
