"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Base patterns give spans by kind. The Markov models are tables of character-pair frequencies of
random strings and of ordinary identifiers, both from labelled samples: values that the base
patterns found (and digests of document ids) are random, the other words of the same sample are
ordinary. A run of key characters is added as a span of kind ``markov`` if the log-likelihood
ratio of its character pairs reaches MIN_RATIO, unless base spans cover all of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnclean.llm.shared import free_name, sample_rows, table

# fixed values: the patterns of the base scan, in the listed order
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]

#: Characters of keys, and the least length of an added span.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Least log-likelihood ratio (nats) of an added span.
MIN_RATIO = 12.0
#: Weight, in character pairs, of the single characters' frequencies in each row of a model.
BACK_OFF = 20.0
#: The models are fitted on so many documents, those of the smallest hashes.
TRAIN_DOCS = 2000

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    """(length of the text before, match, group) of each leftmost non-overlapping match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    return F.filter(both, lambda x: x["hit"].isNotNull())


def _spans(text: Column, has: str, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of the matches that ``keep`` accepts; texts without ``has`` cost one search."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))
    found = F.aggregate(_hits(text, pattern, group), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(has), found).otherwise(_none())


def base_spans(text: Column) -> list[Column]:
    return [
        _spans(text, ASSIGN, ASSIGN, 0, lambda x: F.length(x["value"]) >= 12, group=2),
        _spans(text, r"AKIA[A-Z0-9]{14}", ACCESS, 1, lambda x: F.length(x["hit"]) >= 18),
        _spans(text, r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 2, lambda x: F.length(x["hit"]) >= 16),
    ]


def _pairs(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))


def fit_markov(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> list[float]:
    """Log-likelihood ratios of character pairs, by place of both characters in ALPHABET.

    The result has a fixed size. Of an empty table all ratios are 0 (no span is added).
    """
    sample = sample_rows(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), train_docs)
    secret = F.filter(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(r"[0-9a-f]{16,}"), F.lit(0)),
                               F.regexp_extract_all("text", F.lit(r"AKIA[A-Z0-9]{14,}"), F.lit(0))), lambda t: F.length(t) >= 12)
    digest = F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)
    made = F.array(digest, F.base64(F.unhex(digest)))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    ordinary = F.filter(words, lambda t: ~t.rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|^(?=.*\d)(?=.*[A-Za-z]).{12,}$"))
    rows = sample.select(F.explode(F.concat(
        F.transform(F.concat(secret, made), lambda t: F.struct(F.lit(1).alias("label"), t.alias("token"))),
        F.transform(ordinary, lambda t: F.struct(F.lit(0).alias("label"), t.alias("token"))))).alias("x"))
    counts = (rows.select("x.label", F.explode(_pairs(F.col("x.token"))).alias("pair"))
              .where(F.length("pair") == 2).groupBy("label", "pair").count().collect())      # at most 2 * 67 * 67 rows
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    n = [[0.0] * (k * k), [0.0] * (k * k)]
    for r in counts:
        a, b = r["pair"]
        if a in at and b in at:
            n[r["label"]][at[a] * k + at[b]] += r["count"]
    if not counts:
        return [0.0] * (k * k)

    def chances(m: list[float]) -> list[float]:
        """P(next character | character), backed off to P(next character)."""
        single = [1.0 + sum(m[a * k + b] for a in range(k)) for b in range(k)]
        total = sum(single)
        rows = [sum(m[a * k:(a + 1) * k]) for a in range(k)]
        return [(m[a * k + b] + BACK_OFF * single[b] / total) / (rows[a] + BACK_OFF) for a in range(k) for b in range(k)]

    return [math.log(r) - math.log(o) for o, r in zip(*map(chances, n))]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random against ordinary of a run of key characters."""
    k = len(ALPHABET)
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    # cut up once: a substring for each place would read a run from its start again and again
    place = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, p: F.struct(
        p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(ratios, acc["last"] * k + p + 1))).alias("sum"))
    return F.aggregate(place, start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], text_col: str = "text", base_col: str = "_base", spans_col: str = "_spans") -> DataFrame:
    """Adds ``_base`` and ``_spans`` (or other names): sorted arrays of (start, kind, end), in code points, end exclusive.

    Columns of these two names are replaced; all others stay, whatever their names. A null or empty text
    has no spans. Ties of start go by kind as listed. Nothing is shuffled. A run of key characters takes time in
    proportion to its length.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.drop(base_col, spans_col)
    parts = []
    for k, spans in enumerate([*base_spans(text), _spans(text, RUN, RUN, 3, lambda x: log_ratio(x["hit"], model) >= MIN_RATIO)]):
        parts.append(free_name(df, f"_part{k}"))
        df = df.withColumn(parts[-1], spans)
    df = df.withColumn(base_col, F.array_sort(F.concat(*parts[:3])))
    # base spans are in order of start: how far they cover m without a gap
    reach = lambda m: F.aggregate(base_col, m["start"], lambda at, s: F.when(s["start"] <= at, F.greatest(at, s["end"])).otherwise(at))
    free = F.filter(parts[3], lambda m: reach(m) < m["end"])
    return df.withColumn(spans_col, F.array_sort(F.concat(base_col, free))).drop(*parts)


def spans_text(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns, each span (or run of overlapping spans) of the text replaced; null texts stay null."""
    base_col, spans_col = free_name(docs, "_base"), free_name(docs, "_spans")
    df = scan(docs, model, text_col, base_col, spans_col)
    text = F.col(f"`{text_col}`")
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans_col, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text)).drop(base_col, spans_col)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = scan(docs.select("doc_id", "text"), fit_markov(docs))
    n = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                     F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))
