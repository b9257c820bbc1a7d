"""Quality rules, secret scan and the pipeline."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import findings, quality

from .conftest import SCHEMA, words


def counted_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_statistics(documents, corpus, empty, spark):
    more = [(200 + i, t, "en", "s", 0) for i, t in enumerate(["a b c a b c", "x\nx\n\n x\nx", "a a a a a", "# $ <b>|&*%", "a b c", " a"])]
    docs = documents.union(spark.createDataFrame(more, SCHEMA)).withColumn("n_lines", F.lit("clash"))
    got = quality.with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *counted_brute(r[1])) for r in [*corpus, *more])
    assert quality.with_statistics(empty).count() == 0


def test_binomial_tail(spark):
    rows = [(x, n) for n in (1, 10, 400, 3000) for x in (0, 1, 3, 30) if x <= n]
    got = spark.createDataFrame(rows, "x long, n long").withColumn("t", quality.tail(F.col("x"), F.col("n"), .01)).collect()
    for r in got:
        assert r.t == pytest.approx(sum(math.comb(r.n, i) * .01 ** i * .99 ** (r.n - i) for i in range(r.x + 1)), rel=1e-9)


@pytest.fixture(scope="module")
def judged(spark):
    """Good texts, and bad ones full of symbols; of the good ones a few hold some symbols too."""
    r = random.Random(9)
    docs, labels = [], []
    for i in range(4000):
        bad = i % 5 == 0
        text = words(r, 60, 40_000)
        if bad:
            text = text.replace(" ", "%% ")
        elif i % 150 == 1:
            text += " ## $$"
        docs.append((i, text, ("en", "de")[i % 4 == 0], "s", 0))
        if i % 10 < 9:
            labels.append((i, int(not bad)))
    return spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels + labels[:5] + [(None, 1), (3, None)], "doc_id long, quality int")


def test_cutoffs_limit_false_rejection(judged):
    docs, labels = judged
    got = quality.quality_rules(docs, labels).collect()
    bad = [r for r in got if r.doc_id % 5 == 0]
    good = [r for r in got if r.doc_id % 5]
    assert sum(r.kept for r in good) >= .99 * len(good)
    rejected = [r for r in bad if not r.kept]
    assert len([r for r in rejected if r.stratum == "en"]) == len([r for r in bad if r.stratum == "en"])
    rules = quality.cutoffs(quality.with_statistics(docs), labels).collect()
    assert {r.stratum for r in rules} <= {"en", "de"} and rules


def test_keep_good(judged, empty, documents):
    docs, labels = judged
    wide = docs.withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(0))
    got = quality.keep_good(wide, labels)
    assert got.columns == wide.columns and got.count() == sum(r.kept for r in quality.quality_rules(docs, labels).collect())
    none = labels.limit(0)
    assert quality.keep_good(documents, none).count() == quality.with_statistics(documents).filter("not base_failed").count()
    assert quality.keep_good(empty, none).count() == 0


def secrets(seed, n):
    r = random.Random(seed)
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            head, value, label = "password=", hex_(18), 1
        elif kind == 1:
            head, value, label = 'token = "', "AKIA" + "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16)), 1
        elif kind == 2:
            head, value, label = "see ", f"user.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", 0
        else:
            head, value, label = "order ", str(r.randint(10 ** 15, 10 ** 16)), 0
        text = f"{words(r, 5)} é {head}{value} {words(r, 4)}"
        at = text.index(value)
        rows.append((i, text, "en", f"src{i % 3}", 0))
        labels.append((i, at, at + len(value), label))
    return rows, labels


def test_secret_scan_on_held_out_findings(spark):
    rows, labels = secrets(3, 800)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 8 < 4], "doc_id long, start long, end long, label int")
    got = {(r.doc_id, r.start, r.end): r.kept for r in findings.secret_scan(docs, known).collect()}
    assert set(got) == {x[:3] for x in labels}
    held_out = [x for x in labels if x[0] % 8 >= 4]
    assert sum(got[x[:3]] == bool(x[3]) for x in held_out) >= .97 * len(held_out)


def test_candidates_and_edge_cases(spark, documents, empty):
    rows = [(1, None, None, None, 0), (2, "", "en", "", 0), (3, "abc1234567890 x abcdefghijklmnop 1234567890ab", "en", "s", 0), (3, "abc1234567890 x", "en", "s", 0)]
    got = findings.candidates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "start", "end", "value").collect()
    assert Counter(map(tuple, got)) == Counter([(3, 0, 13, "abc1234567890"), (3, 33, 45, "1234567890ab"), (3, 0, 13, "abc1234567890")])
    alone = findings.secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()  # no finding proves itself: nothing goes
    assert len(alone) == 3 and all(r.kept and r.probability is None for r in alone)
    assert findings.secret_scan(empty).count() == 0


def test_assigned_values_and_labelled_spans_are_candidates(spark):
    texts = ['é password="Tr0ub4dor&3" end', "the 'secret: correcthorsebattery' is", "x -----BEGIN RSA PRIVATE KEY-----\nMII", "API_KEY_PROD => ab, Authorization: Bearer q&z.",
             "nothing but hidden words", "pwd='a b' pwd="]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = [(0, "Tr0ub4dor&3"), (1, "correcthorsebattery"), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "ab"), (3, "q&z"), (5, "a b")]
    got = findings.candidates(docs).collect()
    assert Counter((r.doc_id, r.value) for r in got) == Counter(want)
    assert all(texts[r.doc_id][r.start:r.end] == r.value for r in got)
    labels = spark.createDataFrame([(4, 12, 18, 1), (0, 12, 23, 1), (4, 20, 99, 0)], "doc_id long, start long, end long, label int")
    found = findings.candidates(docs, labels)
    assert Counter((r.doc_id, r.value) for r in found.collect()) == Counter([*want, (4, "hidden")])
    assert findings.match_labels(found, labels).count() == 2


def test_rare_label_is_trained_on(spark):
    """Labels of one kind outnumber the sample: the other kind is still learned."""
    rows, labels = secrets(5, 800)
    rare = {x[0] for x in labels if x[3]}
    rare = set(sorted(rare)[:8])
    known = spark.createDataFrame([x for x in labels if not x[3] or x[0] in rare], "doc_id long, start long, end long, label int")
    got = findings.secret_scan(spark.createDataFrame(rows, SCHEMA).repartition(3), known, 40).collect()
    assert all(r.probability is not None for r in got) and all(r.kept for r in got if r.doc_id in rare)


def test_pipeline_stages(spark, tmp_path, corpus):
    """Each stage on the one before, against the stages' own brute-force results; run() gives the same rows."""
    import corpus_pipeline

    from .test_dedup import cut_brute, near_brute

    spark.createDataFrame(corpus, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
            seen.append([tuple(r) for r in docs.collect()])
    good = [r for r in corpus if not counted_brute(r[1])[-1]]
    assert Counter(seen[0]) == Counter(good)
    ids = Counter(i for i, _, _, k in near_brute(good).elements() if k)
    assert Counter(r[0] for r in seen[1]) == ids
    left = cut_brute(seen[1])
    assert Counter((r[0], r[1]) for r in seen[2]) == Counter((r[0], x[-1].decode("utf-8", "ignore")) for r, x in zip(seen[1], left))
    from barloom.llm import personal

    assert Counter((r[0], r[1]) for r in seen[3]) == Counter((r[0], personal.masked(r[1])) for r in seen[2])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in again.collect()) == Counter(tuple(r)[:5] for r in docs.collect())
