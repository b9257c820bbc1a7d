"""Secret scan: candidate strings judged by a random forest. Column expressions and Spark's own forest only.

Candidates are unbroken runs of at least 12 letters, digits and ``_ . / + @ -`` with a digit, every value assigned after a cue word,
whatever its length and characters (in quotes up to the closing one, else up to white space, without closing punctuation), headers of
private keys, and labelled spans that are none of these. Equal spans are one candidate; a run may lie inside an assigned value. Features: length, shares of
kinds of characters, distinct characters, transitions between kinds of characters, the share of its letters that are dictionary words,
the path (``source``) and cue words before and behind it. The dictionary holds the WORDS most frequent words of the corpus, counted
over all texts.

The forest learns from labelled findings (doc_id, start, end, label 0 or 1), of each label at most half of TRAINING (lowest hash), weighted
by the label's count, so that a rare label is not crowded out. Labelled spans that do not lie in their text are no candidates. It
removes false positives: a candidate is kept when its probability is at least 0.5. ``verified_findings`` labels candidates whose form proves what
they are (access keys and assigned runs; mail and network addresses, plain numbers) where no labels are at hand. Without
labels of both kinds nothing is removed (probability null).

Null text counts as empty. Repeated rows give repeated findings. Starts and ends are code points.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import cut_lineage, whole

RUN = "A-Za-z0-9_./+@-"
CANDIDATE = f"(?<![{RUN}])(?=[A-Za-z_./+@-]*+[0-9])[{RUN}]{{12,}}"
CUE_WORDS = "pass(?:word|wd)?|pwd|secret|token|api.?key|auth|bearer|credential|private|access"
KEY_HEADER = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: group 1 is the value
ASSIGNED = (f"(?:(?i:{CUE_WORDS})[A-Za-z0-9_-]{{0,40}}+[\"']?\\s*+(?::=|=>|[=:])\\s*+(?:(?i:bearer|basic)\\s++)?[\"']?+|(?={KEY_HEADER}))"
            f"({KEY_HEADER}|(?<=\")[^\"\\n]++(?=\")|(?<=')[^'\\n]++(?=')|[^\\s\"'<>]*[^\\s\"'<>,;.)\\]}}])")
WORDS = 20_000
TRAINING = 20_000
CONTEXT = 40
TREES, DEPTH, SEED = 30, 6, 11
CUE = f"(?i)({CUE_WORDS})"
SAMPLE_CUE = "(?i)(example|sample|dummy|test|placeholder|changeme|todo|xxx)"
PATHS = 16
FEATURES = ("length", "digits", "uppers", "lowers", "others", "distinct", "changes", "vowels", "longest_digits", "coverage", "path", "path_sample",
            "cue", "cue_sample", "assigned", "quoted", "after_length")
KEY = ["row", "number"]


def candidates(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Candidates with their place and neighbours: row (number of the document row), number, doc_id, source, start, end, value,
    before, after. Texts without a candidate are dropped before anything is exchanged."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), whole().alias("text"))
    if labels is None:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    else:
        span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        spans = labels.filter("label is not null and start >= 0 and end > start").groupBy("doc_id").agg(F.collect_set(span).alias("spans"))
        rows = rows.join(spans, "doc_id", "left")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    some = rows.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED) | F.col("spans").isNotNull())
    some = some if labels is None else cut_lineage(some)  # read twice below, with the same row numbers

    def found(kind: int, pattern: str, group: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("values"),
                        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"), F.split("text", pattern, -1).alias("gaps"))

    kinds = F.array(found(0, CANDIDATE, 0), F.when(F.col("text").rlike(ASSIGNED), found(1, ASSIGNED, 1)))
    cut = some.select("row", "doc_id", "source", F.inline(kinds)).filter("kind is not null")
    each = cut.select("row", "doc_id", "source", "kind", "matches", "gaps", F.posexplode("values").alias("number", "value"))
    match, gap = F.get("matches", "number"), F.get("gaps", "number")
    lead = F.concat(gap, F.substr(match, F.lit(1), F.length(match) - F.length("value")))
    each = each.select("row", "number", "doc_id", "source", "kind", "value", F.length(lead).alias("gap"),
                       F.right(lead, F.lit(CONTEXT)).alias("before"), F.left(F.get("gaps", F.col("number") + 1), F.lit(CONTEXT)).alias("after"))
    order = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order))
    names = ["kind", "value", "before", "after"]
    each = each.select("row", "doc_id", "source", (F.col("end") - F.length("value")).alias("start"), "end", *names)
    if labels is not None:
        told = some.select("row", "doc_id", "source", "text", F.inline("spans")).filter(F.col("end") <= F.length("text"))
        at = F.greatest(F.col("start") - CONTEXT, F.lit(0))
        told = told.select("row", "doc_id", "source", "start", "end", F.lit(2).alias("kind"), F.expr("substr(text, start + 1, end - start)").alias("value"),
                           F.substr("text", at + 1, F.col("start") - at).alias("before"), F.substr("text", F.col("end") + 1, F.lit(CONTEXT)).alias("after"))
        each = each.union(told)
    once = each.groupBy("row", "start", "end").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.min(F.struct(*names)).alias("c"))
    number = F.row_number().over(Window.partitionBy("row").orderBy("start", "end")) - 1
    return once.select("row", number.alias("number"), "doc_id", "source", "start", "end", "c.value", "c.before", "c.after")


def dictionary(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """The most frequent words of three or more letters, over all texts: at most ``size`` rows."""
    words = docs.select(F.explode(F.split(F.lower(whole()), "[^\\p{L}]+")).alias("word")).filter("length(word) >= 3")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(size).select("word")


def share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES. ``words`` is broadcast: at most WORDS rows by construction."""
    runs = found.select(*KEY, F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(F.broadcast(words), "word").groupBy(*KEY).agg(F.sum(F.length("word")).alias("covered"))
    columns = {
        "length": F.length("value"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "changes": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"), "vowels": share("[aeiouAEIOU]"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
        "coverage": F.coalesce("covered", F.lit(0)) / F.length("value"),
        "path": F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(PATHS)),
        "path_sample": F.coalesce(F.col("source").rlike("(?i)(test|example|sample|fixture|mock|doc)"), F.lit(False)),
        "cue": F.col("before").rlike(CUE), "cue_sample": F.col("before").rlike(SAMPLE_CUE) | F.col("after").rlike(SAMPLE_CUE),
        "assigned": F.col("before").rlike("[=:]\\s*[\"']?$"), "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "after_length": F.length(F.regexp_extract("after", "^\\S*", 0)),
    }
    return found.join(cut_lineage(covered), KEY, "left").withColumns({k: v.cast("double") for k, v in columns.items()}).drop("covered")


def verified_findings(found: DataFrame) -> DataFrame:
    """Labels for candidates whose form proves what they are: KEY and label."""
    address = F.col("value").rlike("^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$") | F.col("value").rlike("^[0-9]+(\\.[0-9]+){3}$")
    number = F.col("value").rlike("^[0-9./+-]+$")
    secret = F.col("value").rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | F.col("before").rlike(CUE + "\\s*[=:]\\s*[\"']?$")
    runs = found.filter(F.col("value").rlike(f"^{CANDIDATE}$"))  # of other assigned values the form proves nothing
    return runs.select(*KEY, F.when(secret & ~address, 1).when(address | number, 0).alias("label")).filter("label is not null")


def match_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled findings (doc_id, start, end, label) as KEY and label; of contradicting labels the highest counts."""
    one = labels.filter("label is not null").groupBy("doc_id", "start", "end").agg(F.max("label").alias("label"))
    return found.select(*KEY, "doc_id", "start", "end").join(one, ["doc_id", "start", "end"]).select(*KEY, "label")


def judge(featured: DataFrame, labels: DataFrame, training: int = TRAINING) -> DataFrame:
    """Candidates with ``probability`` of being a secret and ``kept``."""
    known = cut_lineage(featured.join(labels, KEY).select(*FEATURES, F.col("label").cast("double").alias("label"),
                                                          F.xxhash64("doc_id", "start", "value").alias("h")))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return featured.withColumns({"probability": F.lit(None).cast("double"), "kept": F.lit(True)})
    most = max(1, training // 2)
    parts = [known.filter(F.col("label") == label).orderBy("h").limit(most).withColumn("weight", F.lit(n / min(n, most))) for label, n in counts.items()]
    known = cut_lineage(parts[0].union(parts[1]).drop("h"))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight",
                                    cacheNodeIds=False)
    model = forest.fit(assemble.transform(known))
    scored = model.transform(assemble.transform(featured)).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("kept", F.col("probability") >= 0.5).drop("features", "rawPrediction", "prediction")


def secret_scan(docs: DataFrame, labels: DataFrame | None = None, training: int = TRAINING) -> DataFrame:
    """One row per candidate: doc_id, start, end, value, probability, kept."""
    found = cut_lineage(candidates(docs, labels))
    featured = cut_lineage(with_features(found, cut_lineage(dictionary(docs))))
    known = cut_lineage(verified_findings(found) if labels is None else match_labels(found, labels))
    return judge(featured, known, training).select("doc_id", "start", "end", "value", "probability", "kept")
