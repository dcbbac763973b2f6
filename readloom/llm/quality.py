"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose score exceeds a cutoff. For every stratum (language) and rule, a fixed
ladder of cutoffs is tested from the most lenient to the strictest on labelled documents held out for
this: a cutoff is certified while the exact (Clopper-Pearson) upper bound on the share of good documents
it rejects stays within the rule's part of the allowed risk. Testing a ladder in a fixed order and stopping
at the first failure needs no correction within the ladder; Bonferroni corrects across strata and rules, and
the risks of the rules add up to the allowed risk. Among certified cutoffs the one taken rejects the most
bad documents, each lost good one weighed as LOSS bad ones; ties go to the more lenient one. A stratum
with too few labels has no certified cutoff and loses nothing to the rules.

Defined cases: null or empty text has no words and fails the base rule; labels that are null or of unknown
documents are not used, and a document with several labels counts as good if any says so; repeated rows are
judged alike; languages are strata by their first two letters, all else is one stratum, so there are at
most 677; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, stored, table

RISK, CONFIDENCE, LOSS, WINDOW = 0.05, 0.95, 20, 5
#: From lenient to strict.
LADDERS = {
    "symbols": [1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "repeats": [0.95, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "upper": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "word_chars": [60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that is found twice or more in the array."""
    n = F.size(words)
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return _covered(windows)


def _covered(windows: Column) -> Column:
    """Sorts (hash, start), keeps starts beside an equal hash, and adds up what their windows cover."""

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))  # evaluates value once

    def starts(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s: F.filter(
            F.transform(s, lambda x, i: F.when((x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h), x.i)),
            lambda x: x.isNotNull(),
        )
        return F.array_sort(bind(ranked, near))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bind(starts(w), total)))


def features(docs: DataFrame) -> DataFrame:
    """The base counts of each whole text and the scores of the rules, beside the columns of docs.

    New columns replace those of docs that have their names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
    }).drop("_words", "_lines")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    lang = F.lower(F.substring(F.coalesce(F.col("lang"), F.lit("")), 1, 2)) if "lang" in docs.columns else F.lit("")
    return out.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "_symbols": share("n_symbols", "word_chars"),
        "_dup_lines": share("n_dup_lines", "_n_lines"),
        "_repeats": share("n_repeat_words", "n_words"),
        "_upper": share("_upper", "word_chars"),
        "_word_chars": share("word_chars", "n_words"),
        "stratum": F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("other"),
    }).drop("_n_lines")


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact one-sided upper confidence bound on a share of which k in n were seen: the p at which
    seeing k or fewer has probability alpha."""
    if n == 0 or k >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and at_most(mid) > alpha else (low, mid)
    return high


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[tuple[str, str], float]:
    """The cutoff of each (stratum, rule) that has a certified one. Collects one row a stratum."""
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality") > 0).alias("_good"))
    known = scored.where("not base_failed").join(truth, "doc_id")
    seen = [(rule, j) for rule, ladder in LADDERS.items() for j in range(len(ladder))]
    hit = lambda rule, j, good: F.count_if((F.col(f"_{rule}") > LADDERS[rule][j]) & (F.col("_good") == good))
    counts = known.groupBy("stratum").agg(
        F.count_if("_good").alias("n"),
        *[hit(rule, j, True).alias(f"k_{rule}_{j}") for rule, j in seen],
        *[hit(rule, j, False).alias(f"b_{rule}_{j}") for rule, j in seen],
    ).collect()
    alpha = (1 - confidence) / max(1, len(counts) * len(LADDERS))
    out: dict[tuple[str, str], float] = {}
    for row in counts:
        for rule, ladder in LADDERS.items():
            best = 0
            for j, cut in enumerate(ladder):
                k, bad = row[f"k_{rule}_{j}"], row[f"b_{rule}_{j}"]
                if k > row.n * risk or upper_bound(k, row.n, alpha) > risk / len(LADDERS):
                    break
                if bad - LOSS * k > best:
                    best, out[row.stratum, rule] = bad - LOSS * k, cut
    return out


def judged(scored: DataFrame, cuts: dict[tuple[str, str], float]) -> DataFrame:
    """Adds kept, and rule: the first that rejects."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for (stratum, rule), cut in sorted(cuts.items()):
        verdict = verdict.when((F.col("stratum") == stratum) & (F.col(f"_{rule}") > cut), F.lit(rule))
    return scored.withColumn("rule", verdict).withColumn("kept", F.col("rule").isNull())


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: counts, scores, base_failed, rule, kept. The text is read once: scores are stored."""
    names = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    scored = stored(features(docs.select(*names)).drop("text", "lang"), "quality")
    return judged(scored, cutoffs(scored, labels))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "rule", "stratum")


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, computed before any filter above: the optimizer moves filters below projections and
    would repeat the work on the text for every mention of a column."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_x")).select("_x.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Numbers of all texts are stored and meet the labels; rows are
    then judged as they pass. So a text is judged twice, but neither shuffled nor stored beside the result."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    names = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    with Steps(spark) as steps:
        numbers = steps.kept(features(docs.select(*names)).drop("text", "lang"), "quality")
        cuts = cutoffs(numbers, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)
    return judged(_settled(features(rows).drop("text", "lang")), cuts).where("kept").select("_row.*")
