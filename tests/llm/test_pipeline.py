import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    syll = {"en": ["the", "on", "er", "an"], "de": ["sch", "ung", "ein", "er"]}
    say = lambda x, n: " ".join("".join(rng.choice(syll[x]) + rng.choice("aeiou") for _ in range(rng.randint(1, 5))) for _ in range(n))
    docs, labels = [], []
    for k in range(500):
        text, toxic = say(rng.choice(["en", "de"]), 60), int(k % 4 == 0)
        if toxic:
            w = text.split()
            for i in range(0, 60, 12):
                w[i] = "vilewort"
            text = " ".join(w)
        docs.append((k, text, "en" if k % 2 else "de", f"s{k % 4}", len(text)))
        labels.append((k, 1, toxic))
    base = docs[1][1].split()
    docs += [(1000, docs[1][1], "en", "s0", 0), (1001, " ".join([*base[:-1], "changed"]), "en", "s1", 0), (1002, "12 34 !!", "en", "s0", 0), (1003, None, None, None, None), (1003, None, None, None, None), (3, docs[3][1], "en", "s3", docs[3][4]), (None, say("en", 30), "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).withColumn("copies", F.lit("extra")).withColumn("_id", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs


def test_stages(spark, corpus, tmp_path):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = docs
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: sorted((r["doc_id"] for r in df.collect()), key=str) for n, df in left.items()}
    clean = [r[0] for r in rows if not (r[1] and "vilewort" in r[1])]
    assert ids["toxicity"] == sorted(clean, key=str)
    known = [i for i in clean if i not in (1002, 1003)]
    assert ids["language"] == sorted(known, key=str)
    # 1 stands for 1000 and 1001, and the repeated row of 3 goes
    single = sorted((i for i in {*known} if i not in (1000, 1001)), key=str)
    assert ids["near_copies"] == single
    words = {r["doc_id"]: len(r["text"].split()) for r in left["near_copies"].collect()}
    assert set(ids["mixing"]) <= set(single) and max(ids["mixing"].count(i) for i in single) <= 3
    assert abs(sum(words[i] for i in ids["mixing"]) - sum(words.values())) <= 4 * 61
    packed = left["packing"].collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=str) == ids["mixing"]
    assert pipeline.run(spark, d).count() == len(packed)


def test_empty(spark, corpus, tmp_path):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_copies_are_told_by_id_and_text(spark, tmp_path):
    """One id on different texts, near copies under one id, rows without an id, rows without words."""
    stage = dict(pipeline.STAGES)["near_copies"]
    w = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    a, near_a, b, near_b = " ".join(w), " ".join([*w[:-1], "x"]), " ".join(other), " ".join([*other[:-1], "y"])
    docs = [(5, a, "en", "s", 0), (5, near_a, "en", "s", 0), (3, b, "en", "s", 0), (5, near_b, "en", "s", 0), (None, near_b, "en", "s", 0), (9, " ", "en", "s", 0), (9, " ", "en", "s", 0), (None, "only this text has no id", "en", "s", 0), (8, None, "en", "s", 0), (6, a, "en", "s", 0), (3, b, "en", "s", 0)]
    got = sorted((tuple(r)[:2] for r in stage(spark, spark.createDataFrame(docs, DOCS), "").collect()), key=str)
    # one of the two texts of id 5 stays for the first group, 3 for the second
    first = [r for r in got if r[0] == 5]
    assert len(first) == 1 and first[0][1] in (a, near_a)
    assert [r for r in got if r[0] != 5] == sorted([(3, b), (9, " "), (9, " "), (None, "only this text has no id"), (8, None)], key=str)
