"""Near-duplicate ("ghost") removal (C1-C6): greedy keep-first, exact, distributed.

Semantics: in arrival order, a row is a ghost iff it matches an *earlier kept* row.
Row ``i`` matches earlier row ``j`` when (C2) both amounts present -> |a_i - a_j| <= tol,
(C3) both dates present -> |d_i - d_j| <= date tol days, (C4) a text column exists ->
ratio(text_i, text_j) >= threshold. A missing value skips its test (C5).

Plan (every step is a Spark join / aggregate; what one task holds is bounded):

1. Rows get an order-preserving long ``rid`` (range sort + id) and are checkpointed.
2. *Collapse*: rows with identical (date, amount, text) match each other, so only the
   first of each such group can be kept and the rest are ghosts (the later ones match
   whatever the first matches). A hot group of copies becomes one row here.
3. *Candidates* among the remaining rows, for the classes of rows that occur:
   - With a text test: equi-joins on a day bucket (width tol+1) and an amount bucket
     (width 2*tol), the neighbouring buckets exploded on one side. Blocks of more than
     ``HOT_BLOCK`` rows, and pairs with neither a date nor an amount test, are met by
     segments of their texts instead (``functions/segments.py``). Each key is a necessary
     condition, so no true pair is lost. The ratio UDF runs on what is left.
   - Without a text test, rows with both a date and an amount need no pairs: blocks of the
     amounts and days are streamed through the sequential rule (``bands.py``).
     Pairs with a missing value are edges (one row per value is left after the collapse).
   Pairs with neither a date nor an amount test and no text column match
   unconditionally; they are answered by per-class aggregates instead of pairs.
4. *Rounds*: an undecided row with a kept earlier neighbour is dropped; one whose earlier
   neighbours are all dropped (and that comes first in the cells around it) is kept. The
   earliest undecided row is always decided, so it terminates, and the result equals the
   sequential greedy loop. Only undecided rows and the edges between them go on, each
   cut from its lineage with a reliable checkpoint in the session's
   ``spark.checkpoint.dir``; decided rows are not touched again.
5. *Chains*: a round that settles less than a quarter of what was undecided is followed by the
   connected components of the rest. Those of at most ``COMPONENT`` rows and edges are streamed
   through the sequential rule itself, one component after the other in a task; larger
   ones go on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Optional

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..functions import segments as seg
from ..functions.segments import frequent_segments, in_place, index_rows, probe_rows, surveyed
from ..functions.similarity import overlap, prefix_of, similar_udf, text_tokens
from ..functions.text import trim_unicode
from ..plans.roles import GhostColumns, ResolvedRoles
from ..session import cut_lineage, release
from .bands import KEPT, OPEN, Blocks, settled_borders
from .components import components

RID = "__tc_rid"
GHOST = "__tc_ghost"
# classes by which ghost values are present: bit 1 = date, bit 2 = amount
DA, D_, _A, NN = 3, 1, 2, 0
# Frames of kept rows that are merged into one when there are this many.
MERGE_KEPT = 16
#: Rows of one day and amount bucket above which pairs are met by segments of their texts.
HOT_BLOCK = 256
#: Rows and edges of a component that one task settles by the sequential rule.
COMPONENT = 500_000
#: A cell's amounts span this share of the tolerance; rows within the tolerance lie at most REACH cells apart
#: (one more than exact arithmetic needs).
CELL, REACH = 0.5, 3
#: Cells are taken together in blocks of so many along the amounts to find components (which may join some that are apart).
COARSE = 64


def _attrs(x: DataFrame, roles: ResolvedRoles, cols: GhostColumns) -> tuple[DataFrame, bool, bool, bool]:
    """rid, day number, amount, text and class for every row."""
    def usable(c: Optional[str], role: str) -> bool:
        return c is not None and c in roles.output_columns and roles.role(c) == role

    has_d = usable(cols.date_column, "date")
    has_a = usable(cols.amount_column, "amount")
    has_t = cols.text_column is not None
    text_cleaned = (has_t and cols.text_column in roles.output_columns
                    and roles.role(cols.text_column) != "ignore")
    day = (F.datediff(named(cols.date_column).try_cast("date"), F.lit("1970-01-01").cast("date"))
           if has_d else F.lit(None).cast("int"))
    amt = named(cols.amount_column).cast("double") if has_a else F.lit(None).cast("double")
    if text_cleaned:
        txt = F.lower(trim_unicode(F.coalesce(named(cols.text_column).cast("string"), F.lit(""))))
    else:
        txt = F.lit("")
    a = x.select(F.col(RID), day.alias("dn"), amt.alias("am"), txt.alias("tx"))
    a = a.withColumn("cls", F.when(F.col("dn").isNotNull(), 1).otherwise(0)
                     + F.when(F.col("am").isNotNull(), 2).otherwise(0))
    return a, has_d, has_a, has_t, text_cleaned


def _buckets(df: DataFrame, tol: float, dtol: int, on_day: bool, on_amt: bool,
             explode: bool) -> DataFrame:
    """Day bucket ``db`` and amount bucket ``ab`` (only those in use); ``explode`` adds
    the two neighbouring buckets, so equal keys cover every pair within tolerance."""
    out = df
    if on_day:
        db = F.col("dn") if dtol == 0 else F.floor(F.col("dn") / F.lit(dtol + 1))
        out = out.withColumn("db", db.cast("long"))
        if explode and dtol > 0:
            out = out.withColumn("db", F.explode(F.array(F.col("db") - 1, F.col("db"), F.col("db") + 1)))
    if on_amt:
        ab = F.col("am") if tol == 0 else F.floor(F.col("am") / F.lit(2.0 * tol)).cast("double")
        out = out.withColumn("ab", ab)
        if explode and tol > 0:
            out = out.withColumn("ab", F.explode(F.array(F.col("ab") - 1, F.col("ab"), F.col("ab") + 1)))
    return out


def _pairs(later: DataFrame, earlier: DataFrame, on_day: bool, on_amt: bool, threshold: Optional[float],
           tol: float, dtol: int) -> DataFrame:
    """(i, j, texts), j earlier, blocked on the chosen keys (and on prefix tokens where there is a
    text threshold), each pair once, with all native conditions applied."""
    on_tok = threshold is not None
    keys = (["db"] if on_day else []) + (["ab"] if on_amt else []) + (["tok"] if on_tok else [])
    li = _buckets(later, tol, dtol, on_day, on_amt, explode=False)
    ej = _buckets(earlier, tol, dtol, on_day, on_amt, explode=True)
    texts, texts_j = [], []
    if on_tok:
        li = li.withColumn("tok", F.explode("prefix"))
        ej = ej.withColumn("tok", F.explode("prefix"))
        texts = ["toks", "prefix"]
        texts_j = [F.col(c).alias(f"{c}_j") for c in texts]
    li = li.select(F.col(RID).alias("i"), "dn", "am", "tx", *texts, *keys)
    ej = ej.select(F.col(RID).alias("j"), F.col("dn").alias("dn_j"), F.col("am").alias("am_j"),
                   F.col("tx").alias("tx_j"), *texts_j, *keys)
    cond = F.col("j") < F.col("i")
    if on_day:
        cond = cond & (F.abs(F.col("dn") - F.col("dn_j")) <= dtol)
    if on_amt:
        cond = cond & (F.abs(F.col("am") - F.col("am_j")) <= F.lit(tol))
    if on_tok:
        la, lb = F.size("toks"), F.size("toks_j")
        need = F.lit(threshold) * (la + lb) - F.lit(1e-9)
        cond = (cond & (F.lit(2.0) * F.least(la, lb) >= need)
                & (F.array_min(F.array_intersect("prefix", "prefix_j")) == F.col("tok"))
                & (F.lit(2.0) * overlap("toks", "toks_j") >= need))
    p = li.join(ej, keys, "inner").where(cond)
    return p.select("i", "j", "tx", "tx_j")


def _bands(on_day: bool, on_amt: bool, tol: float, dtol: int) -> Column:
    """The exact date and amount tests between a row and another one (``_j``)."""
    cond = F.lit(True)
    if on_day:
        cond = cond & (F.abs(F.col("dn") - F.col("dn_j")) <= dtol)
    if on_amt:
        cond = cond & (F.abs(F.col("am") - F.col("am_j")) <= F.lit(tol))
    return cond


def _segment_pairs(later: DataFrame, earlier: DataFrame, keys: list[str], bands: Column,
                   threshold: float, frequent, values: tuple[str, ...] = ("dn", "am")) -> DataFrame:
    """(i, j, texts) of pairs that may be similar, equal on ``keys``: the longer text's segments are
    looked up among the shorter one's substrings, ids alone are joined, and texts are fetched at the end.
    ``values`` are the columns that ``bands`` reads."""
    slim = [RID, "tx", *values, *keys]
    texts = later if later is earlier else later.select("tx").unionByName(earlier.select("tx"))
    used, idle, rows = surveyed(texts, "tx", threshold, frequent)
    parts = max(1, min(seg.PARTS, -(-rows // seg.ROWS)))
    found = []
    for part in [(k, parts) for k in range(parts)]:
        met = []
        for longer, shorter, later_is_longer in ((later, earlier, True), (earlier, later, False)):
            x = index_rows(longer.select(*slim), "tx", threshold, frequent, used, part)
            y = probe_rows(shorter.select(*slim), "tx", threshold, used, idle, part)
            y = y.select(*[F.col(c).alias(f"{c}_j") for c in (RID, *values)], F.col("len").alias("len_p"),
                         F.col("pos").alias("pos_p"), F.col("parity").alias("parity_p"), "gram", *keys)
            if later is earlier:          # both directions at once
                order = (F.col("len") > F.col("len_p")) | ((F.col("len") == F.col("len_p")) & (F.col(f"{RID}_j") < F.col(RID)))
                i, j = F.greatest(RID, f"{RID}_j"), F.least(RID, f"{RID}_j")
            elif later_is_longer:
                order = (F.col("len") >= F.col("len_p")) & (F.col(f"{RID}_j") < F.col(RID))
                i, j = F.col(RID), F.col(f"{RID}_j")
            else:
                order = (F.col("len") > F.col("len_p")) & (F.col(RID) < F.col(f"{RID}_j"))
                i, j = F.col(f"{RID}_j"), F.col(RID)
            met.append(x.join(y, ["gram", *keys]).where(order & bands & in_place(threshold))
                       .groupBy(i.alias("i"), j.alias("j")).agg(F.collect_set("pos").alias("found"), F.max("least").alias("least"))
                       .select("i", "j", F.lit(later_is_longer).alias("side"), F.size("found").alias("n"), "least"))
            if later is earlier:
                break
        # a segment is in one part only; the rows joined for one part are off the disk before the next
        met = reduce(DataFrame.unionByName, met)
        found.append(cut_lineage(met if parts > 1 else met.where(F.col("n") >= F.col("least"))))
    ids = reduce(DataFrame.unionByName, found)
    if parts > 1:
        ids = ids.groupBy("i", "j", "side").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where(F.col("n") >= F.col("least"))
    ids = ids.select("i", "j")
    if later is not earlier:          # a pair may stand in both exploded buckets of a side
        ids = ids.distinct()
    return (ids.join(later.select(F.col(RID).alias("i"), "tx").distinct(), "i")
            .join(earlier.select(F.col(RID).alias("j"), F.col("tx").alias("tx_j")).distinct(), "j")
            .select("i", "j", "tx", "tx_j"))


def _text_pairs(later: DataFrame, earlier: DataFrame, on_day: bool, on_amt: bool, threshold: float,
                tol: float, dtol: int, frequent) -> DataFrame:
    """(i, j, texts), j earlier: blocked by day and amount where a block is small, by segments elsewhere."""
    bands = _bands(on_day, on_amt, tol, dtol)
    if not (on_day or on_amt):
        return _segment_pairs(later, earlier, [], bands, threshold, frequent(), ())
    keys = (["db"] if on_day else []) + (["ab"] if on_amt else [])
    li = _buckets(later, tol, dtol, on_day, on_amt, explode=False)
    ej = _buckets(earlier, tol, dtol, on_day, on_amt, explode=True)
    hot = ej.groupBy(*keys).count().where(F.col("count") > HOT_BLOCK).select(*keys)
    any_hot = bool(hot.take(1))
    small_i, small_j = (li.join(hot, keys, "left_anti"), ej.join(hot, keys, "left_anti")) if any_hot else (li, ej)
    row = small_j.select(F.col(RID).alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("dn", "am", "tx")], *keys)
    la, lb = F.length("tx"), F.length("tx_j")
    pairs = small_i.join(row, keys).where(
        (F.col("j") < F.col(RID)) & bands & (F.lit(2.0) * F.least(la, lb) >= F.lit(threshold) * (la + lb) - F.lit(1e-9)))
    pairs = pairs.select(F.col(RID).alias("i"), "j", "tx", "tx_j")
    if any_hot:
        pairs = pairs.unionByName(_segment_pairs(li.join(hot, keys, "left_semi"), ej.join(hot, keys, "left_semi"),
                                                 keys, bands, threshold, frequent(),
                                                 tuple(c for c, on in (("dn", on_day), ("am", on_amt)) if on)))
    return pairs


def _neighbours(reps: DataFrame, present: set[int], has_t: bool, threshold: float, tol: float, dtol: int,
                cells: bool) -> DataFrame:
    """Exact match edges (i, j), j < i, among collapsed rows of the classes that occur (without the
    pairs that the class rule or, with ``cells``, the cells of rows with both values answer)."""
    R = reps
    thr = threshold if has_t else None
    # a ratio of one half or less leaves too few whole segments: blocked by characters there
    segments = has_t and threshold > 0.5
    if has_t and not segments:
        R = (R.withColumn("toks", text_tokens(F.col("tx"))).withColumn("prefix", prefix_of(F.col("toks"), threshold))
             .persist(StorageLevel.MEMORY_AND_DISK))
    known: list = []

    def frequent():
        if not known:
            known.append(frequent_segments(reps, "tx", threshold))
        return known[0]

    parts = []

    def add(later: tuple[int, ...], earlier: tuple[int, ...], on_day: bool, on_amt: bool) -> None:
        if not present & set(later) or not present & set(earlier):
            return
        rows = R.where(F.col("tx") != "") if has_t and not (on_day or on_amt) else R
        later, earlier = (tuple(sorted(present & set(c))) for c in (later, earlier))
        a = rows.where(F.col("cls").isin(*later))
        b = a if later == earlier else rows.where(F.col("cls").isin(*earlier))
        parts.append(_text_pairs(a, b, on_day, on_amt, thr, tol, dtol, frequent) if segments
                     else _pairs(a, b, on_day, on_amt, thr, tol, dtol))

    if dtol >= 0 and tol >= 0 and not cells:  # both tests
        add((DA,), (DA,), True, True)
    if dtol >= 0:  # date test only (an amount is missing on one side)
        add((D_,), (DA, D_), True, False)
        add((DA,), (D_,), True, False)
    if tol >= 0:  # amount test only
        add((_A,), (DA, _A), False, True)
        add((DA,), (_A,), False, True)
    if has_t:  # neither test: text alone decides; empty texts are left to the class rule
        add((NN,), (DA, D_, _A, NN), False, False)
        add((D_,), (_A, NN), False, False)
        add((_A,), (D_, NN), False, False)
        add((DA,), (NN,), False, False)
    if not parts:
        return reps.sparkSession.createDataFrame([], "i long, j long")
    cand = reduce(DataFrame.unionByName, parts)
    if not has_t:
        return cand.select("i", "j")
    return cand.where(similar_udf(threshold)(F.col("tx"), F.col("tx_j"))).select("i", "j")


# ---------------------------------------------------------------- cells (no text test)

def _with_cells(reps: DataFrame, tol: float, dtol: int) -> DataFrame:
    """``cd`` and ``ca`` of rows with both values: equal for rows that surely match."""
    both = F.col("cls") == DA
    ca = F.col("am") + F.lit(0.0) if tol == 0 else F.floor(F.col("am") / F.lit(CELL * tol)).cast("double")
    cd = F.col("dn") if dtol == 0 else F.floor(F.col("dn") / F.lit(dtol + 1))
    return reps.withColumn("cd", F.when(both, cd.cast("long"))).withColumn("ca", F.when(both, ca))


def _around(df: DataFrame, tol: float, dtol: int, reach: int = REACH) -> DataFrame:
    """Each row once for every cell that may hold rows within its tolerances."""
    days = [-1, 0, 1] if dtol > 0 else [0]
    amounts = [float(k) for k in range(-reach, reach + 1)] if tol > 0 else [0.0]
    at = F.explode(F.array(*[F.struct((F.col("cd") + d).alias("cd"), (F.col("ca") + a).alias("ca")) for d in days for a in amounts]))
    return df.withColumn("at", at).withColumn("cd", F.col("at.cd")).withColumn("ca", F.col("at.ca")).drop("at")


def _cell_mins(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("cd").isNotNull()).groupBy("cd", "ca").agg(F.min(RID).alias("m"))


def _sweep(tol: float, dtol: int):
    """The sequential rule over rows in order of (component, rid, kind): a row's edges (kind 0) come before the row (kind 1)."""
    days = (-1, 0, 1) if dtol > 0 else (0,)
    amounts = [float(k) for k in range(-REACH, REACH + 1)] if tol > 0 else [0.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, held, hit_row = None, set(), {}, None
        for b in batches:
            out = []
            for comp, rid, kind, j, cd, ca, dn, am in zip(*[b.column(k).to_pylist() for k in range(8)]):
                if comp != at:
                    at, kept, held, hit_row = comp, set(), {}, None
                if kind == 0:
                    if j in kept:
                        hit_row = rid
                    continue
                if hit_row == rid:
                    continue
                if cd is not None and any(
                        abs(dn - d) <= dtol and abs(am - a) <= tol
                        for x in days for y in amounts for d, a in held.get((cd + x, ca + y), ())):
                    continue
                kept.add(rid)
                if cd is not None:
                    held.setdefault((cd, ca), []).append((dn, am))
                out.append(rid)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=[RID])
    return run


# Without a text test, pairs that have neither a date nor an amount test always match.
# For a row of class c, these are the classes of such partners.
FREE_PARTNERS = {NN: (DA, D_, _A, NN), D_: (_A, NN), _A: (D_, NN), DA: (NN,)}


def _class_mins(rows: DataFrame, known: dict[int, int]) -> dict[int, int]:
    """Per class, the smallest rid of ``rows`` under the class rule, or the known one (4 numbers, one job)."""
    found = rows.where(F.col("free")).groupBy("cls").agg(F.min(RID).alias("m")).collect()
    return {**known, **{r["cls"]: min(r["m"], known.get(r["cls"], r["m"])) for r in found}}


def _class_cond(mins: dict[int, int]) -> Column:
    cond = F.lit(False)
    for c, partners in FREE_PARTNERS.items():
        ms = [mins[p] for p in partners if mins.get(p) is not None]
        if ms:
            cond = cond | ((F.col("cls") == c) & (F.col(RID) > F.lit(min(ms))))
    return F.col("free") & cond


def _settle_components(rest: DataFrame, edges: DataFrame, cells: Optional[tuple[float, int]],
                       blocked: Optional[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rids, rows settled) of the small components of undecided rows. Rows that ``blocked`` marks may
    yet be decided by the class rule: their components wait."""
    spark = rest.sparkSession
    links = [edges.select(F.col("i").alias("u"), F.col("j").alias("v"))]
    if cells:
        wide = rest if cells[0] == 0 else rest.withColumn("ca", F.floor(F.col("ca") / COARSE).cast("double"))
        mins = cut_lineage(_cell_mins(wide))       # a block of cells is stood for by its first row
        links.append(wide.join(mins, ["cd", "ca"]).select(F.col(RID).alias("u"), F.col("m").alias("v")))
        links.append(_around(mins, *cells, reach=1).join(mins.withColumnRenamed("m", "o"), ["cd", "ca"])
                     .select(F.col("m").alias("u"), F.col("o").alias("v")))
    comps = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", RID)
    rows = rest.join(comps, RID, "left").withColumn("component", F.coalesce("component", F.col(RID)))
    mine = edges.join(comps.withColumnRenamed(RID, "i"), "i")
    sizes = (rows.select("component", (blocked if blocked is not None else F.lit(False)).alias("waits"))
             .unionByName(mine.select("component", F.lit(False).alias("waits")))
             .groupBy("component").agg(F.count("*").alias("n"), F.max("waits").alias("waits")))
    small = cut_lineage(sizes.where((F.col("n") <= COMPONENT) & ~F.col("waits")).select("component"))
    settled = cut_lineage(rows.join(small, "component", "left_semi"))
    tol, dtol = cells or (0.0, 0)
    value = [F.col(c) if cells else F.lit(None).cast(t).alias(c) for c, t in (("cd", "long"), ("ca", "double"), ("dn", "int"), ("am", "double"))]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cd", "long"), ("ca", "double"), ("dn", "int"), ("am", "double"))]
    stream = settled.select("component", RID, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("j"), *value).unionByName(
        mine.join(small, "component", "left_semi").select("component", F.col("i").alias(RID), F.lit(0).alias("kind"), "j", *none))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = (stream.repartition(parts, "component").sortWithinPartitions("component", RID, "kind")
            .mapInArrow(_sweep(tol, dtol), f"`{RID}` long"))
    return cut_lineage(kept), settled.select(RID)


def greedy_keep_first(reps: DataFrame, edges: DataFrame, free_pairs: bool,
                      max_rounds: Optional[int] = None, metrics: Optional[dict] = None,
                      cells: Optional[tuple[float, int]] = None) -> DataFrame:
    """Rounds over ``edges`` (i, j), j < i: the rids of kept rows.

    ``reps`` has a boolean ``free``: rows whose date/amount-free pairs always match (no text
    test, or an empty text) and are decided by the class rule, not by edges. ``cells``
    (amount and day tolerance): rows with both values match within the tolerances, without edges, and all
    rows are ``free``.
    One round: (1) a row without an earlier undecided neighbour is kept; (2) a row with a neighbour
    that was kept in (1) is dropped; (3) the rest and the edges among them are the next
    round's whole input. Both decisions are final, and the earliest undecided row is
    always decided. For the usual shape (copies of an earlier original) one round settles
    everything; after one that settles little, small components are settled at once.
    ``metrics`` gets the sizes of each round.
    """
    spark = reps.sparkSession
    columns = [RID, "cls", "free"]
    if cells:
        reps = _with_cells(reps, *cells)
        columns += ["cd", "ca", "dn", "am"]
    rest, own = reps.select(*columns), None     # ``own``: the checkpoint that ``rest`` is, once it is one of a round
    edges = cut_lineage(edges)
    sizes: list[tuple[int, int]] = []
    kept: list[DataFrame] = []
    kept_min: dict[int, int] = {}
    chains, wait, found = False, 0, None
    blocks, beside = None, []       # kept rows near borders of blocks drop rows in the rounds after
    while True:
        # rows, and those without a cell
        left, plain = rest.agg(F.count("*"), F.count(F.when(F.col("cd").isNull(), 1)) if cells else F.count("*")).first()
        if not left and kept:
            break
        # a round that settled less than a quarter: chains; then again only after some rounds
        chains = wait <= 0 and bool(sizes) and 4 * (sizes[-1][0] - left) < sizes[-1][0]
        wait -= 1
        n_edges = edges.count()
        sizes.append((left, n_edges))
        if max_rounds is not None and len(sizes) > max_rounds:
            raise RuntimeError(f"ghost removal did not settle in {max_rounds} rounds")
        if chains:
            wait = 8
            mins = _class_mins(rest, kept_min) if free_pairs else {}
            found = None
            keep, done = _settle_components(rest, edges, cells, _class_cond(mins) if free_pairs else None)
            keep = rest.join(keep, RID, "left_semi")
        else:
            waits = F.lit(False)
            state = rest
            if n_edges:
                state = state.join(edges.select(F.col("i").alias(RID)).distinct().withColumn("later", F.lit(True)), RID, "left")
                waits = F.col("later").isNotNull()
            if free_pairs:
                waits = waits | _class_cond(_class_mins(rest, kept_min))
            state = state.withColumn("waits", waits)
            keep, done, found = state.where(~F.col("waits")).select(*columns), None, None
            if cells:
                banded = state.where(F.col("cd").isNotNull()).select(RID, "dn", "am", F.lit(False).alias("kept"), "waits")
                if blocks is None:
                    blocks = Blocks(rest.where(F.col("cd").isNotNull()).select("dn", "am"), left, *cells)
                found = cut_lineage(blocks.sweep(reduce(DataFrame.unionByName, [banded, *beside])))
                solved = settled_borders(found)
                more = spark.createDataFrame(solved, f"`{RID}` long, found int, dn int, am double") if solved else None
                near = found.where("near").select(RID, "found", "dn", "am")
                near = near if more is None else near.unionByName(more)
                beside.append(cut_lineage(near.where(F.col("found") == KEPT).select(
                    RID, "dn", "am", F.lit(True).alias("kept"), F.lit(False).alias("waits"))))
                if len(beside) > MERGE_KEPT:
                    beside = [cut_lineage(reduce(DataFrame.unionByName, beside))]
                decided = found.where(F.col("found") <= KEPT).select(RID, "found")
                if more is not None:
                    decided = decided.unionByName(more.select(RID, "found"))
                    wait = max(wait, 1)         # the next sweep goes on from these
                keep = keep.where(F.col("cd").isNull()).select(RID, "cls", "free").unionByName(
                    decided.where(F.col("found") == KEPT).select(RID, F.lit(DA).alias("cls"), F.lit(True).alias("free")))
                done = decided.select(RID)
        keep = cut_lineage(keep)
        kept.append(keep.select(RID))
        if done is not None and not n_edges and done.count() == left:
            break
        gone = [keep.select(RID)] if done is None else [keep.select(RID), done]
        if found is not None:       # what the sweep left open is known; other rows are few or none
            opened = found.where(F.col("found") == OPEN).select(RID, F.lit(DA).alias("cls"), F.lit(True).alias("free"), "dn", "am")
            if more is not None:
                opened = opened.join(more.select(RID), RID, "left_anti")
            opened = _with_cells(opened, *cells).select(*columns)
            rest = opened.unionByName(rest.where(F.col("cd").isNull())) if plain else opened
            gone = [keep.where(F.col("cls") != DA).select(RID)] if plain else []
        if n_edges:
            gone.append(edges.join(keep.select(F.col(RID).alias("j")), "j", "left_semi").select(F.col("i").alias(RID)))
        if gone:
            rest = rest.join(reduce(DataFrame.unionByName, gone), RID, "left_anti")
        if free_pairs:
            kept_min = _class_mins(keep, kept_min)
            rest = rest.where(~_class_cond(kept_min))
        rest = cut_lineage(rest)
        ids = rest.select(RID)
        read = [f for f in (own, found) if f is not None]
        own = rest
        if n_edges:
            read.append(edges)
            edges = cut_lineage(edges.join(ids.withColumnRenamed(RID, "i"), "i", "left_semi")
                                .join(ids.withColumnRenamed(RID, "j"), "j", "left_semi").select("i", "j"))
        for f in read:              # all that is made from these is written
            release(f)
        found = None
        if len(kept) == MERGE_KEPT:
            kept = [cut_lineage(reduce(DataFrame.unionByName, kept))]
    for f in (own, found, edges):
        if f is not None:
            release(f)
    if metrics is not None:
        metrics.update(candidate_edges=sizes[0][1], rounds=len(sizes), round_sizes=sizes)
    return reduce(DataFrame.unionByName, kept)


def flag_ghosts(firsts: DataFrame, roles: ResolvedRoles, cols: GhostColumns, opts,
                ord_col: str = "_ord", metrics: Optional[dict] = None, apart: Optional[str] = None) -> DataFrame:
    """``firsts`` plus a boolean ``GHOST`` column (C6). Rows that the boolean column ``apart`` marks are carried along:
    no ghosts, nor compared with others.

    ``metrics`` (optional dict) receives ``rows``, ``collapsed_rows``, ``candidate_edges``,
    ``rounds`` and ``round_sizes`` (undecided rows and edges of each round) - the sizes
    that decide the cost of the run."""
    spark = firsts.sparkSession
    tol, dtol, thr = float(opts.amount_tol), int(opts.date_tol_days), float(opts.threshold)
    # 1. order-preserving ids: range-sorted partitions, then position. What made the rows leaves the disk before they are sorted
    firsts = cut_lineage(firsts)
    x = cut_lineage(firsts.orderBy(ord_col).withColumn(RID, F.monotonically_increasing_id()))
    release(firsts)
    live = x if apart is None else x.where(~F.col(apart))
    attrs, has_d, has_a, has_t, text_cleaned = _attrs(live, roles, cols)
    if has_t and thr > 1.0:     # no ratio reaches the threshold: nothing is a ghost
        return x.withColumn(GHOST, F.lit(False)).drop(RID)
    if has_t and (thr <= 0.0 or not text_cleaned):
        has_t = False           # every ratio passes (all texts empty, or threshold <= 0)
    if not has_d:
        dtol = 0
    if not has_a:
        tol = 0.0
    # 2. collapse identical ghost values (they match each other when tolerances >= 0)
    if tol >= 0 and dtol >= 0:
        reps = attrs.groupBy("dn", "am", "tx").agg(F.min(RID).alias(RID), F.min("cls").alias("cls")).select(*attrs.columns)
    else:
        reps = attrs
    # rows decided by the class rule for their date/amount-free pairs (ratio('', '') = 1)
    reps = reps.withColumn("free", F.lit(True) if not has_t else F.col("tx") == "")
    reps = cut_lineage(reps)
    counts = {(r["cls"], r["free"]): r["count"] for r in reps.groupBy("cls", "free").count().collect()}
    present, free = {c for c, _ in counts}, {c for c, f in counts if f}
    # 3. candidates
    cells = (tol, dtol) if not has_t and DA in present and tol >= 0 and dtol >= 0 else None
    edges = _neighbours(reps, present, has_t, thr, tol, dtol, cells is not None)
    # 4. rounds
    if metrics is not None:
        metrics["rows"] = live.count()
        metrics["collapsed_rows"] = sum(counts.values())
    # any two rows that the class rule decides?
    free_rows = any(free & set(FREE_PARTNERS[c]) for c in free)
    kept = greedy_keep_first(reps, edges, free_pairs=free_rows, cells=cells,
                             max_rounds=getattr(opts, "max_rounds", None), metrics=metrics)
    release(reps)             # kept rows are checkpointed; the result reads only x and those
    kept = kept.withColumn("__tc_keep", F.lit(True))
    out = x.join(kept, RID, "left")
    ghost = F.col("__tc_keep").isNull()
    return out.withColumn(GHOST, ghost if apart is None else ghost & ~F.col(apart)).drop(RID, "__tc_keep")
