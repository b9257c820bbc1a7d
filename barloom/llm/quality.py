"""Quality rules with risk-controlled thresholds. Column expressions only.

Each signal is a ratio of two integers per document. A rule rejects a document whose ratio is above the cutoff of its
stratum (the language). Cutoffs come from labelled documents: for a cutoff, x of the n good documents of the stratum would
be rejected, and the cutoff is certified if the chance of seeing at most x under a false rejection rate of ``risk`` is at
most ``alpha`` divided by the number of tests (exact binomial tail, that is a Clopper-Pearson bound, with Bonferroni's
correction over strata, signals and cutoffs). The grid of cutoffs is fixed beforehand, so all labelled documents are a
holdout. With a chance of 1 - alpha no rule in any stratum rejects more than ``risk`` of the good documents.
Among certified cutoffs the one with the most rejected bad documents less ``caution`` times the rejected good ones is taken
(the loosest of equals); without a gain the signal has no rule in that stratum.

Null text counts as empty. Documents without a language, or with another one, form the stratum ``other``. Labels without
a doc_id or quality are left out; of repeated labels the highest quality counts. A doc_id may repeat: every row is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import BLANKS, whole

STRATA = ("de", "en", "es", "fr")
#: signal: numerator, denominator
SIGNALS = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
#: Cutoffs tried, in thousandths.
GRID = (5, 10, 20, 40, 60, 80, 120, 160, 240, 320, 400, 480, 600, 800)
RISK = 0.01
ALPHA = 0.05
CAUTION = 20
#: Bits for the place of a window beside its hash: texts of up to 2^PLACE words.
PLACE = 27
PRIVATE = ("_q_words", "_q_lines", "_q_packed", "_q_places", "_q_grams", "_q_again", "_q_number")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Documents with the counts that the rules use; existing columns of these names are replaced.

    A word is a run without white space. ``n_repeat_words`` counts the words inside any 3-word window that occurs at least
    twice in the text: hashes of the windows, packed with their places, are sorted inside the row; windows with an equal
    neighbour are sorted again as strings, which settles them, and the union of the repeated ones is measured in one pass.
    All of it is linear or n log n in the text's length and needs no exchange.
    """
    words = F.array_remove(F.split(whole(), BLANKS), "")
    step1 = docs.withColumns({"_q_words": words, "_q_lines": F.filter(F.split(whole(), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))})
    at = lambda i: F.col("_q_words")[i]
    packed = F.when(F.size("_q_words") >= 4, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size("_q_words") - 3),
        lambda i: F.shiftleft(F.xxhash64(at(i), at(i + 1), at(i + 2)), PLACE).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<long>"))
    step2 = step1.withColumn("_q_packed", packed)
    head = lambda i: F.shiftright(F.get(F.col("_q_packed"), i), PLACE)
    twins = F.filter("_q_packed", lambda x, i: F.coalesce(F.shiftright(x, PLACE) == head(i + 1), F.lit(False))
                     | F.coalesce(F.shiftright(x, PLACE) == head(i - 1), F.lit(False)))
    places = F.transform(twins, lambda x: x.bitwiseAND((1 << PLACE) - 1).cast("int"))
    step2 = step2.withColumn("_q_places", places)
    step2 = step2.withColumn("_q_grams", F.sort_array(F.transform(
        "_q_places", lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i")))))
    gram = lambda i: F.get(F.col("_q_grams"), i)["g"]
    again = F.sort_array(F.transform(F.filter("_q_grams", lambda x, i: (x["g"] == F.coalesce(gram(i - 1), F.lit("")))
                                              | (x["g"] == F.coalesce(gram(i + 1), F.lit("")))), lambda x: x["i"]))
    step3 = step2.withColumn("_q_again", again)
    covered = F.aggregate("_q_again", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct(
        (i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n")), lambda acc: acc["n"])
    counts = {
        "n_words": F.size("_q_words"), "word_chars": F.length(F.array_join("_q_words", "")),
        "n_symbols": F.regexp_count(whole(), F.lit("[#*$%&|<>]")), "n_capitals": F.regexp_count(whole(), F.lit("\\p{Lu}")),
        "n_lines": F.size("_q_lines"), "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": covered,
    }
    # A filter on a count would be pushed below and carry the whole chain into itself, computed anew for each array element.
    # No filter passes a projection with a row number that its own column depends on.
    out = step3.withColumns({**{k: v.cast("long") for k, v in counts.items()}, "_q_number": F.monotonically_increasing_id()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stratum = F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other")
    return out.withColumns({"base_failed": failed & (F.col("_q_number") >= 0), "stratum": stratum}).drop(*PRIVATE)


def tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Binomial(n, p): terms by their ratio, in logarithms so that none underflows."""
    first = n * F.log(F.lit(1.0 - p))
    odds = p / (1.0 - p)
    state = F.aggregate(
        F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i * F.lit(odds))).alias("t"),
                              (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i * F.lit(odds)))).alias("s")))
    return state["s"]


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA, caution: float = CAUTION) -> DataFrame:
    """One row per stratum and signal with a certified rule: (stratum, signal, cutoff), cutoff in thousandths.

    ``counted`` holds doc_id and the statistics; documents that fail the base rules don't count. The result has at most
    strata times signals rows, whatever the input's size.
    """
    quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    known = (counted.filter("not base_failed").select("doc_id", "stratum", *{c for s in SIGNALS.values() for c in s})
             .join(quality, "doc_id"))
    hits = {f"{s}_{g}": 1000 * F.col(a) > g * F.col(b) for s, (a, b) in SIGNALS.items() for g in GRID}
    sums = known.groupBy("stratum").agg(
        F.sum(F.when(F.col("_quality") >= 1, 1).otherwise(0)).alias("n"),
        *[F.sum(F.when(hit & (F.col("_quality") >= 1), 1).otherwise(0)).alias(f"x_{k}") for k, hit in hits.items()],
        *[F.sum(F.when(hit & (F.col("_quality") < 1), 1).otherwise(0)).alias(f"bad_{k}") for k, hit in hits.items()])
    tests = (len(STRATA) + 1) * len(SIGNALS) * len(GRID)
    tried = sums.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.lit(g).alias("cutoff"), F.col(f"x_{s}_{g}").alias("x"), F.col(f"bad_{s}_{g}").alias("bad"))
        for s in SIGNALS for g in GRID])).alias("r")).select("stratum", "n", "r.*")
    gain = F.col("bad") - caution * F.col("x")
    # the tail is at least alpha wherever x reaches the mean, so it is summed only below
    sure = tried.filter((F.col("x") < risk * F.col("n")) & (gain > 0)).filter(tail(F.col("x"), F.col("n"), risk) <= alpha / tests)
    return sure.groupBy("stratum", "signal").agg(F.max(F.struct(gain.alias("gain"), "cutoff"))["cutoff"].alias("cutoff"))


def judge(counted: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``kept``: false for a document that fails the base rules or one of its stratum's rules.

    The rules are turned into one row of a map per stratum and broadcast: at most len(STRATA) + 1 rows by construction.
    """
    per = rules.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("_cutoffs"))
    joined = counted.join(F.broadcast(per), "stratum", "left")
    broken = F.lit(False)
    for s, (a, b) in SIGNALS.items():
        broken = broken | F.coalesce(1000 * F.col(a) > F.col("_cutoffs")[s] * F.col(b), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~broken).drop("_cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """Documents with statistics, ``base_failed`` and ``kept``. The statistics are computed for the calibration and again
    for the verdict, so that no text is stored or exchanged."""
    return judge(with_statistics(docs), cutoffs(with_statistics(docs), labels, **limits))


def keep_good(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """The kept documents, with the columns of ``docs``."""
    safe = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_q_row"))
    rules = cutoffs(with_statistics(docs.select("doc_id", "text", "lang")), labels, **limits)
    return judge(with_statistics(safe), rules).filter("kept").select("_q_row.*")
