"""Toxicity: held-out accuracy, inputs that must not matter, odd rows."""

import random
import zlib

from txnclean.llm.toxicity import fit, fold, with_score


def corpus(n=600):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 300))]
        for _ in range(3 if toxic else 0):
            t[rnd.randrange(len(t))] = rnd.choice(["gremlix", "Idiot,", "snarfo" + rnd.choice("abcdefgh"), "blight"])
        docs.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (4, 0, 7)], "doc_id long, quality int, toxic int")
    model = fit(d, lab)
    rows = with_score(d, model).withColumn("fold", fold("doc_id")).collect()
    assert {r["doc_id"]: r["fold"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in docs}
    held = [r for r in rows if r["fold"] == 0]
    right = sum((r["toxicity"] >= 0.5) == (r["doc_id"] % 8 == 0) for r in held)
    assert len(held) > 80 and right / len(held) >= 0.97
    odd = spark.createDataFrame([(None, None, "x", 0.3), (1, "", "x", 0.3), (1, "", "x", 0.3), (2, "w1 gremlix idiot blight", "x", 0.3), (3, "w1 " * 40000, "x", 0.3)],
                                "doc_id long, text string, f string, toxicity double")
    got = with_score(odd, model)
    assert got.columns == ["doc_id", "text", "f", "toxicity"]
    score = {(r["doc_id"], r["text"]): r["toxicity"] for r in got.collect()}
    assert score[None, None] == score[1, ""] < 0.5 < score[2, "w1 gremlix idiot blight"]
    assert score[3, "w1 " * 40000] < 0.5


def test_without_labels_and_without_rows(spark):
    d = spark.createDataFrame([(1, "you idiot moron"), (2, "fine weather")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in with_score(d, fit(d, none)).collect()}
    assert got[1] > 0.5 > got[2]
    assert with_score(d.limit(0), fit(d.limit(0), none)).count() == 0
