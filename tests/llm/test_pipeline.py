"""The pipeline's stages on a small table with planted rows."""

import random

import corpus_pipeline as P



def tables(spark, folder):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs, labels, fate = [], [], {}

    def add(t, what):
        docs.append((len(docs), t, "en", "s", len(t)))
        fate.setdefault(what, []).append(len(docs) - 1)

    for i in range(200):
        t = text(rnd.randint(30, 200))
        if i % 5 == 0:
            add(t + " gremlix snarfo idiot", "toxic")
        elif i % 5 == 1:
            add(t + " " + items[i % 5][1] + " " + text(20), "leak")
        elif i % 5 == 2:
            add(t + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "secret")
        else:
            add(t, "clean")
            if i % 3 == 0:
                add(t + " more", "copy") if len(t.split()) > 60 else add(t, "copy")
    for d in docs:
        labels.append((d[0], 1, int(d[0] in fate["toxic"])))
    docs.append((None, None, None, None, None))
    docs.append((fate["clean"][0], docs[fate["clean"][0]][1], "en", "again", 1))
    docs.append((900, "", "en", "s", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return fate


def test_stages(spark, scratch):
    fate = tables(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = f"{scratch}/stage{k}"
        stage(spark, docs, scratch).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
        if k < len(P.STAGES) - 1:
            assert docs.columns == names and docs.schema == kept["toxicity"].schema
    ids = {n: sorted(r["doc_id"] for r in d.where("doc_id is not null").select("doc_id").collect()) for n, d in kept.items()}
    everything = {i for v in fate.values() for i in v} | {900}
    assert set(ids["toxicity"]) == everything - set(fate["toxic"])
    assert ids["near_duplicates"] == sorted(everything - set(fate["toxic"]) - set(fate["copy"]))
    assert ids["decontamination"] == sorted(fate["clean"] + fate["secret"] + [900]) == ids["secrets"]
    assert sorted(set(ids["packing"])) == ids["secrets"]
    assert all(d.where("doc_id is null").count() == 1 for d in kept.values())
    red = {r["doc_id"]: r for r in kept["secrets"].collect()}
    for i in fate["secret"]:
        assert "04dbebab91ab85687d33" not in red[i]["text"] and red[i]["text"].endswith('[SECRET]" end') and red[i]["n_chars"] == len(red[i]["text"])


def test_run_equals_the_stages(spark, scratch):
    tables(spark, scratch)
    a = P.run(spark, scratch)
    assert a.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and a.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_text(rnd, n=60):
    return " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))


def test_near_duplicates_are_judged_by_row(spark, scratch):
    rnd = random.Random(7)
    a, b, c, d, e, f, g = (some_text(rnd) for _ in range(7))
    rows = [(3, a), (7, a + " more"), (7, b), (8, c), (8, d), (9, e), (9, e), (9, e + " more"),
            (None, a), (None, f), (None, f), (None, f + " more"), (None, g), (None, None), (None, ""), (20, ""), (21, None)]
    docs = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = P.near_duplicates_stage(spark, docs.repartition(3), scratch)
    assert got.schema == docs.schema
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(3, a), (7, b), (8, c), (8, d), (9, e), (None, f), (None, g), (None, ""), (20, "")]
    assert sorted([(r["doc_id"], r["text"] or "") for r in got.collect()], key=key) == sorted(want, key=key)


def test_decontamination_is_judged_by_row(spark, scratch):
    rnd = random.Random(8)
    item, a, b, c = (some_text(rnd, 40) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, f"{a} {item}"), (None, b), (None, None), (5, f"{item} {c}"), (5, c), (6, a)]
    docs = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = P.decontamination_stage(spark, docs.repartition(3), scratch)
    assert got.schema == docs.schema
    assert sorted(r["n_chars"] for r in got.collect()) == [2, 3, 5, 6]


CLASHING = ["_toxicity", "_row", "_class", "_bare", "_base", "_spans", "_part0", "_part3", "_m", "_a", "class_id", "n_links", "least", "stays", "piece", "odd.name"]


def test_clashing_names_change_nothing(spark, scratch):
    """Further columns of any name are kept, and decide nothing."""
    from pyspark.sql import functions as F

    tables(spark, scratch)
    plain = spark.read.parquet(f"{scratch}/documents.parquet")
    more = plain.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, plain, scratch).write.parquet(f"{scratch}/plain{k}")
        stage(spark, more, scratch).write.parquet(f"{scratch}/more{k}")
        plain, more = spark.read.parquet(f"{scratch}/plain{k}"), spark.read.parquet(f"{scratch}/more{k}")
        # of rows equal in id and text any one may stay
        assert sorted(str((r["doc_id"], r["text"])) for r in plain.collect()) == sorted(str((r["doc_id"], r["text"])) for r in more.collect()), name
        assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in more.collect() for c in CLASHING), name
    assert P.STAGES[-1][1](spark, more, scratch).count() == P.STAGES[-1][1](spark, plain, scratch).count()


def test_empty_table(spark, scratch):
    tables(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, scratch)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
