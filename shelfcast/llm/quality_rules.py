"""Quality rules with risk-controlled thresholds (operator 2). DataFrame functions only.

Every document gets counts over its whole text. A rule compares one ratio of
them with a cutoff of the document's stratum: its language, if at least
``min_good`` labelled good documents have it (at most ``MAX_STRATA`` languages,
those with the most), else ``other``, all remaining ones together. Cutoffs are
not set by hand: on the labelled documents that pass the base rules, a cutoff
is admitted only if the exact binomial tail shows that it rejects at most
``alpha / rules`` of the good documents of the stratum (so all rules together
at most ``alpha``), at a level of ``delta`` shared by all stratum-rule-cutoff
tests (Bonferroni). Among the admitted ones the cutoff is taken that rejects
the largest share of bad documents: the certified risk alone decides, unless a
caller sets ``penalty``, a weight on the share of good ones. A rule without an
admitted, useful cutoff rejects nothing in that stratum.

Defined cases: a null or empty text has no word and fails the base rules; a
null language, or one with too few good documents, is the stratum ``other``; a null label or doc_id
takes no part in the choice, and a document labelled twice counts as good if
any label says so; equal gains go to the larger cutoff; repeated rows are
judged alike; extra columns are kept or ignored, never read; an empty table
gives an empty table, and without labels only the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared

#: Good documents that make a language a stratum of its own, and most such languages.
MIN_GOOD, MAX_STRATA = 1000, 64
#: Certified share of good documents that may be rejected, and level of all tests together.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs tried per rule; a document is rejected if its ratio is over the cutoff.
CUTOFFS = {
    "symbols": (0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 2.5),
    "dup_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
    "repeats": (0.05, 0.08, 0.1, 0.12, 0.14, 0.15, 0.16, 0.17, 0.18, 0.19),
    "word_length": (5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "same_words": (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95),
}
#: Terms of the binomial tail that are summed; the rest is bounded by a geometric series.
TAIL_TERMS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of ``COUNTS`` (long) for the column ``text``.

    Windows of five words are compared by a 64-bit hash within one text.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    flat = text
    for blank in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    docs = docs.withColumn("_flat", flat)
    docs = docs.withColumn("_words", F.array_remove(F.split("_flat", " "), ""))
    docs = docs.withColumn("_windows", F.expr(
        "CASE WHEN size(_words) >= 5 THEN transform(sequence(0, size(_words) - 5), i -> "
        "xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) ELSE array() END"))
    docs = docs.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # only texts with a repeated window need the places of the windows
    docs = docs.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) "
        "THEN array_sort(transform(_windows, (h, i) -> struct(h, i))) END"))
    docs = docs.withColumn("_places", F.expr(
        "array_sort(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[k - 1].h = x.h) "
        "OR (k < size(_sorted) - 1 AND _sorted[k + 1].h = x.h)), x -> x.i))"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(
            "aggregate(_places, struct(0L AS n, -5 AS last), (s, p) -> struct(s.n + least(5, p - s.last) AS n, p AS last), s -> s.n)"), F.lit(0)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
    }).drop("_flat", "_words", "_windows", "_lines", "_sorted", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "same_words": 1 - F.col("n_distinct") / words,
    }


def log_factorial(n: Column) -> Column:
    """ln n!, exact to rounding: by the factorial up to 20, then by Stirling's series."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) of a binomial with n trials at ``rate``, for k < n * rate (else 1).

    The sum runs down from k; terms below ``TAIL_TERMS`` are bounded from above.
    """
    odds = math.log(rate / (1 - rate))
    first = F.greatest(F.lit(0), k - TAIL_TERMS).cast("long")

    def term(i: Column) -> Column:
        return F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * odds + n * math.log(1 - rate))
    total = F.aggregate(F.sequence(first, k.cast("long")), F.lit(0.0), lambda s, i: s + term(i))
    ratio = first * (1 - rate) / ((n - first + 1) * rate)
    rest = F.when(first > 0, term(first) * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k < n * rate, total + rest).otherwise(F.lit(1.0))


def known_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): good if any label says so."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("quality")))


def with_strata(counted: DataFrame, labels: DataFrame, min_good: int) -> tuple[DataFrame, int]:
    """Adds ``stratum`` to rows of (doc_id, lang, counts); and how many strata there are."""
    good = (counted.where(~base_failed() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
            .join(known_quality(labels).where("quality = 1"), "doc_id").groupBy("lang").agg(F.count("*").alias("n")))
    names = [r["lang"] for r in good.where(F.col("n") >= min_good).orderBy(F.desc("n"), "lang").limit(MAX_STRATA).collect()]
    return counted.withColumn("stratum", F.when(F.col("lang").isin(names), F.col("lang")).otherwise("other") if names else F.lit("other")), len({*names, "other"})


def choose_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float, delta: float, penalty: float, strata: int) -> DataFrame:
    """(stratum, rule, cutoff): at most one row per stratum and rule.

    ``counted``: doc_id, stratum and the counts. The labelled ratios are first
    counted per (stratum, rule, cutoff interval, label), so what follows has at
    most ``strata * rules * (cutoffs + 1)`` rows.
    """
    joined = counted.where(~base_failed() & F.col("doc_id").isNotNull()).join(known_quality(labels), "doc_id")
    passed = [F.struct(F.lit(rule).alias("rule"),
                       sum((value > c).cast("int") for c in CUTOFFS[rule]).alias("over")) for rule, value in ratios().items()]
    tally = (joined.select("stratum", "quality", F.explode(F.array(*passed)).alias("r"))
             .groupBy("stratum", "r.rule", "r.over")
             .agg(F.sum(F.col("quality").cast("long")).alias("good"), F.sum((1 - F.col("quality")).cast("long")).alias("bad")))
    levels = F.create_map(*[x for rule, cs in CUTOFFS.items() for x in (F.lit(rule), F.array(*map(F.lit, cs)))])
    # a ratio over `over` cutoffs is rejected by the first `over` of them: add up from the highest interval down
    per_rule = Window.partitionBy("stratum", "rule")
    grid = (tally.groupBy("stratum", "rule").agg(F.collect_list(F.struct("over", "good", "bad")).alias("t"),
                                                 F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
            .withColumn("i", F.explode(F.sequence(F.lit(1), F.size(levels[F.col("rule")]))))
            .withColumns({
                "cutoff": F.element_at(levels[F.col("rule")], F.col("i")),
                "k_good": F.expr("aggregate(filter(t, x -> x.over >= i), 0L, (s, x) -> s + x.good)"),
                "k_bad": F.expr("aggregate(filter(t, x -> x.over >= i), 0L, (s, x) -> s + x.bad)")}))
    tests = strata * sum(map(len, CUTOFFS.values()))
    admitted = (grid.withColumn("p", binomial_tail(F.col("n_good"), F.col("k_good"), alpha / len(CUTOFFS)))
                .where(F.col("p") <= delta / tests)
                .withColumn("gain", F.col("k_bad") / F.greatest(F.col("n_bad"), F.lit(1)) - penalty * F.col("k_good") / F.col("n_good"))
                .where(F.col("gain") > 0))
    rank = F.row_number().over(per_rule.orderBy(F.desc("gain"), F.desc("cutoff")))
    return admitted.withColumn("rank", rank).where(F.col("rank") == 1).select("stratum", "rule", "cutoff")


def judged(counted: DataFrame, labels: DataFrame, alpha: float, delta: float, penalty: float, min_good: int) -> DataFrame:
    """Adds base_failed and kept to rows with the language and the counts."""
    counted, strata = with_strata(counted, labels, min_good)
    cutoffs = choose_cutoffs(counted, labels, alpha, delta, penalty, strata)
    # one row per stratum, MAX_STRATA + 1 at most
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_max_{r}") for r in CUTOFFS])
    both = counted.join(F.broadcast(wide), F.col("stratum") == F.col("_stratum"), "left")
    over = F.lit(False)
    for rule, value in ratios().items():
        over = over | F.coalesce(value > F.col(f"_max_{rule}"), F.lit(False))
    return (both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)
            .drop("_stratum", *[f"_max_{r}" for r in CUTOFFS]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, penalty: float = 0.0,
               min_good: int = MIN_GOOD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document.

    The counts are written once; the choice of cutoffs and the verdicts read them.
    """
    counted = text_counts(docs.select("doc_id", "lang", "text")).drop("text")
    counted = Shared(docs.sparkSession, "rules").write(counted, "counts")
    return judged(counted, labels, alpha, delta, penalty, min_good).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, penalty: float = 0.0,
               min_good: int = MIN_GOOD) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    whole = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.struct("*").alias("doc"))
    counted = Shared(docs.sparkSession, "rules").write(text_counts(whole, "doc.text"), "counted")
    kept = judged(counted, labels, alpha, delta, penalty, min_good).where("kept")
    return kept.select("doc.*")
