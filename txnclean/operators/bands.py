"""The sequential keep-first rule within an amount and a day tolerance, block by block, exact.

Amounts (and days, where amounts alone cannot be cut finely enough) are cut at quantiles into blocks; a row goes
to its own block and, where it lies within the tolerances of a border, to those beside it. A task streams the
rows of a block in order. What hangs on undecided rows of other blocks is carried as a Boolean
function of up to VARIABLES of them: two 64-bit tables, whether the row is surely kept (``must``) and whether it may
be. The functions of the rows near borders, a few for each block, are then put into each other, so a chain
through all blocks is settled by the sweep after, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RID = "__tc_rid"
#: Rows that a block is meant to have, and the most cuts along the amounts or the days.
BLOCK, CUTS = 50_000, 4096
#: Undecided rows of other blocks that functions are made of (the tables have 2 ** VARIABLES bits); others count as unknown.
VARIABLES = 6
#: Functions put into each other at once; with more of them rows wait for the next round.
BORDER = 500_000
#: Undecided rows that a cell remembers singly; from then on it stands as unknown for what lies around it.
CROWD = 64

ALL = (1 << (1 << VARIABLES)) - 1
# table of variable k: the bits whose number has bit k
VARIABLE = [sum(1 << i for i in range(1 << VARIABLES) if i >> k & 1) for k in range(VARIABLES)]

DROPPED, KEPT, OPEN = 0, 1, 2


def _cuts(rows: DataFrame, col: str, parts: int, least: float) -> np.ndarray:
    """Up to ``parts`` - 1 quantiles, ``least`` or more apart."""
    parts = min(parts, CUTS)
    out: list[float] = []
    if parts > 1:
        for x in sorted(set(rows.approxQuantile(col, [k / parts for k in range(1, parts)], 0.25 / parts))):
            if not out or x - out[-1] >= least:
                out.append(x)
    return np.array(out, float)


class Blocks:
    """Where rows (``dn``, ``am``) go; the same for all rounds."""

    def __init__(self, rows: DataFrame, n: int, tol: float, dtol: int):
        self.tol, self.dtol = tol, dtol
        parts = -(-n // BLOCK)
        self.amounts = _cuts(rows, "am", parts, 4 * tol)
        self.days = _cuts(rows, "dn", -(-parts // (len(self.amounts) + 1)), 4 * (dtol + 1) if dtol else 1)

    def deal(self, rows: DataFrame) -> DataFrame:
        """(block, rid, own, near, dn, am, kept, waits): rows once for each block that they concern."""
        amounts, days, dtol, reach = self.amounts, self.days, self.dtol, self.tol * (1 + 1e-9)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def place(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
                return np.searchsorted(cuts, x, "right")

            for b in batches:
                dn = b.column(1).to_numpy(zero_copy_only=False).astype(float)
                am = b.column(2).to_numpy(zero_copy_only=False)
                a0, a1 = place(amounts, np.nextafter(am - reach, -np.inf)), place(amounts, np.nextafter(am + reach, np.inf))
                d0, d1 = place(days, dn - dtol), place(days, dn + dtol)
                wide, deep = a1 - a0 + 1, d1 - d0 + 1
                n = wide * deep
                row = np.repeat(np.arange(len(am)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a, d = a0[row] + k % wide[row], d0[row] + k // wide[row]
                own = (a == place(amounts, am)[row]) & (d == place(days, dn)[row])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((a * (len(days) + 1) + d).astype(np.int64)), b.column(0).take(take), pa.array(own), pa.array((n > 1)[row]),
                     *[b.column(c).take(take) for c in (1, 2, 3, 4)]],
                    names=["block", RID, "own", "near", "dn", "am", "kept", "waits"])

        return rows.select(RID, "dn", "am", "kept", "waits").mapInArrow(
            run, f"block long, `{RID}` long, own boolean, near boolean, dn int, am double, kept boolean, waits boolean")

    def sweep(self, rows: DataFrame) -> DataFrame:
        """What is found of the undecided among ``rows`` (rid, dn, am, kept, waits), each in its own block: (rid, found,
        near, dn, am, names, must, may), without dn and am where it is decided and not near a border. Rows of earlier
        rounds that are ``kept`` drop others; of those that ``waits`` marks something else may yet drop the row. ``names``
        are the rows that the tables of an OPEN row near a border are of (none for other OPEN rows)."""
        tol, dtol = self.tol, self.dtol
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (self.deal(rows).repartition(parts, "block").sortWithinPartitions("block", RID)
                .mapInArrow(_swept(tol, dtol), f"`{RID}` long, found int, near boolean, dn int, am double, names array<long>, must long, may long"))


def _swept(tol: float, dtol: int):
    days = (-1, 0, 1) if dtol > 0 else (0,)
    amounts = (-1.0, 0.0, 1.0) if tol > 0 else (0.0,)
    around = [(x, y) for x in days for y in amounts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, names = None, {}, []
        for b in batches:
            out = []
            am = b.column(5).to_numpy(zero_copy_only=False)
            # cells of one and a half tolerances: what matches lies in cells beside each other, however it is rounded
            ca = (np.floor(am / (1.5 * tol)) if tol > 0 else am + 0.0).tolist()
            cd = (b.column(4).to_numpy(zero_copy_only=False).astype(np.int64) // (dtol + 1)).tolist()
            for block, rid, own, near, dn, a, kept, waits, c, e in zip(*[b.column(k).to_pylist() for k in range(8)], ca, cd):
                if block != at:
                    at, held, names = block, {}, []
                must, may = ALL, ALL
                if not kept:
                    if waits:
                        must = 0
                    for x, y in around:
                        for d2, a2, must2, may2 in held.get((e + x, c + y), ()):
                            if d2 is None or (abs(dn - d2) <= dtol and abs(a - a2) <= tol):
                                must &= ~may2
                                may &= ~must2
                        if not may:
                            break
                    if not may:
                        if own:
                            out.append((rid, DROPPED, near, dn if near else None, a if near else None, None, None, None))
                        continue
                    if own:
                        if must == ALL:
                            out.append((rid, KEPT, near, dn if near else None, a if near else None, None, None, None))
                        elif near:
                            out.append((rid, OPEN, near, dn, a, list(names), _signed(must), _signed(may)))
                        else:
                            out.append((rid, OPEN, near, dn, a, None, None, None))
                    elif len(names) < VARIABLES:
                        must = may = VARIABLE[len(names)]
                        names.append(rid)
                    else:
                        must = 0
                cell = held.setdefault((e, c), [])
                if must == ALL:
                    cell.append((dn, a, ALL, ALL))
                elif len(cell) < CROWD:
                    cell.append((dn, a, must, may))
                elif cell[-1][0] is not None and all(r[0] is not None for r in cell):
                    cell.append((None, None, 0, ALL))
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)],
                                                 names=[RID, "found", "near", "dn", "am", "names", "must", "may"])
    return run


def _signed(table: int) -> int:
    return table - (1 << 64) if table >> 63 else table


def settled_borders(found: DataFrame) -> list[tuple[int, int, int, float]]:
    """(rid, DROPPED or KEPT, dn, am) of OPEN rows near borders, by the tables of those before them. The driver sees a few
    rows a block; where there are more than BORDER, none are settled (the rounds go on without)."""
    near = found.where("near")
    asked = near.where(F.col("found") == OPEN).select(F.explode("names").alias(RID)).distinct()
    # what is already known of the rows asked for, and all functions
    rows = near.where(F.col("found") == OPEN).unionByName(near.where(F.col("found") != OPEN).join(asked, RID, "left_semi"))
    got = rows.select(RID, "found", "dn", "am", "names", "must", "may").limit(BORDER + 1).collect()
    if len(got) > BORDER:
        return []
    state: dict[int, int] = {}
    out = []
    for rid, kind, dn, am, names, must, may in sorted(got):
        if kind != OPEN:
            state[rid] = kind
            continue
        may_be = ALL
        for k, name in enumerate(names):
            if name in state:
                may_be &= VARIABLE[k] if state[name] == KEPT else ALL & ~VARIABLE[k]
        if not (may & ALL) & may_be:
            state[rid] = DROPPED
        elif (must & ALL) & may_be == may_be:
            state[rid] = KEPT
        else:
            continue
        out.append((rid, state[rid], dn, am))
    return out
