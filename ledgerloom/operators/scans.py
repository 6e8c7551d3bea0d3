"""Running computations over whole histories, by chunks that combine.

Some results look back on a key's whole history: how long a run has lasted, which
run a row is in, what the likeliest state is given all that came before and after.
A window would take a key's rows in one task. Here a history that is too long is
cut into chunks; every chunk is summed up in a small row, the summaries of a key
are combined in order, and each chunk then fills in its rows from what reaches it.
Combining is associative, so results do not depend on where a history is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lineage_cut
from .series import _CHUNK, _HOME, CHUNK_ROWS, CHUNK_ROWS_CONF, Series, _cut, oversized_keys
from .sizes import broadcast_if_small, int_conf

_RUN = "__run"


def chunked(df: DataFrame, series: Series, size: int | None = None) -> DataFrame | None:
    """Rows with the chunk of their key's history, or None where no key is too long.

    The cut is written, as all steps of a scan have to see the same one. With a
    ``size`` of its own, keys are counted however small the table is.
    """
    if series.one_per_slot:
        return None
    if size is None:
        size = int_conf(df, CHUNK_ROWS_CONF, CHUNK_ROWS)
        oversized = oversized_keys(df, series.keys, size)
    else:
        oversized = df.groupBy(*series.keys).count().where(F.col("count") > size).drop("count")
        oversized = None if oversized.isEmpty() else oversized
    if oversized is None:
        return None
    return lineage_cut(_cut(df, series, oversized, size, 0, descending=False).drop(_HOME), "chunks")


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Attach columns of a short table by chunk and key; keys may be null."""
    renamed = other.withColumnsRenamed({k: f"__{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}_")) for k in keys]
    return df.join(broadcast_if_small(renamed), on).drop(*[f"__{k}_" for k in keys])


def _starts(label: Column, before: Column) -> Column:
    """1 where a new run starts: another value, or a missing one."""
    return F.coalesce((label != before).cast("int"), F.lit(1))


def with_runs(df: DataFrame, series: Series, label: str) -> DataFrame:
    """Add ``__run``, the number of the row's run of an unchanged label from 1, and ``__place``, its place in the run from 1."""
    keys, order = list(series.keys), series.ordering()
    cut = chunked(df, series)
    part = [*keys] if cut is None else [*keys, _CHUNK]
    w = Window.partitionBy(*part).orderBy(*order)
    runs = (df if cut is None else cut).withColumn(_RUN, F.sum(_starts(F.col(label), F.lag(label).over(w))).over(w))
    inside = Window.partitionBy(*part, _RUN).orderBy(*order)
    runs = runs.withColumn("__place", F.row_number().over(inside))
    if cut is None:
        return runs
    runs = lineage_cut(runs, "runs")
    first, last = F.min(F.struct(*series.order, label)), F.max(F.struct(*series.order, F.col(label), "__place"))
    ends = runs.groupBy(*part).agg(first.alias("first"), last.alias("last"), F.max(_RUN).alias("runs"), F.count(F.lit(1)).alias("rows"))
    # A row for each chunk: few for any key.
    over = Window.partitionBy(*keys).orderBy(_CHUNK)
    goes_on = F.coalesce(F.col("first")[label] == F.lag(F.col("last")[label]).over(over), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    fresh = ~(F.col("goes_on") & (F.col("runs") == 1))
    ends = ends.withColumns({"fresh": fresh.cast("int"), "tail": F.when(F.col("runs") == 1, F.col("rows")).otherwise(F.col("last")["__place"])})
    # Chunks that are one run going on add their rows to what reached them.
    ends = ends.withColumn("stretch", F.sum("fresh").over(over))
    ends = ends.withColumn("at_end", F.sum("tail").over(Window.partitionBy(*keys, "stretch").orderBy(_CHUNK)))
    reached = F.when(F.col("goes_on"), F.lag("at_end").over(over)).otherwise(F.lit(0))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    fewer = F.col("goes_on").cast("long")
    ends = ends.withColumn("own", F.col("runs") - fewer)
    ends = ends.select(*part, reached.alias("reached"), (F.coalesce(F.sum("own").over(before), F.lit(0)) - fewer).alias("earlier"))
    out = _joined(runs, ends, part)
    place = F.col("__place") + F.when(F.col(_RUN) == 1, F.col("reached")).otherwise(0)
    return out.withColumns({"__place": place, _RUN: F.col(_RUN) + F.col("earlier")}).drop("reached", "earlier", _CHUNK)


# --- states -----------------------------------------------------------------


def moves_between(moves: DataFrame, states: int) -> np.ndarray:
    """The chances of a transition matrix as an array, one move of each kind added so that none is impossible."""
    out = np.ones((states, states))
    # One row for each pair of states.
    for row in moves.select("from_label", "to_label", "n").collect():
        out[int(row["from_label"]), int(row["to_label"])] += row["n"]
    return out / out.sum(axis=1, keepdims=True)


def _steps(likelihood: np.ndarray, moves: np.ndarray, opens: bool) -> np.ndarray:
    """Per row the matrix that takes the states before it to the states at it; a key's first row has no move before it."""
    out = moves[None] * likelihood[:, None, :]
    if opens:
        out[0] = np.diag(likelihood[0])
    return out


def _scaled(a: np.ndarray) -> np.ndarray:
    return a / a.reshape(*a.shape[:-2], -1).sum(axis=-1)[..., None, None]


def product(steps: np.ndarray) -> np.ndarray:
    """The product of all matrices up to a factor, by halves."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        steps = np.concatenate([_scaled(steps[0 : len(steps) - 1 : 2] @ steps[1::2]), odd])
    return steps[0]


def smoothed(steps: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probabilities of the states at each row, from the states that reach the rows and what comes after them.

    Rows are laid in blocks; a step moves along all blocks at once.
    """
    n, k = steps.shape[:2]
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    # Rows that fill the last block change nothing.
    laid = np.concatenate([steps, np.broadcast_to(np.eye(k), (blocks * length - n, k, k))]).reshape(blocks, length, k, k)
    whole = laid[:, 0]
    for i in range(1, length):
        whole = _scaled(whole @ laid[:, i])
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    x = before
    for i in range(blocks):
        ahead[i] = x
        x = x @ whole[i]
        x = x / x.sum()
    x = after
    for i in range(blocks - 1, -1, -1):
        behind[i] = x
        x = whole[i] @ x
        x = x / x.sum()
    forward, backward = np.empty((blocks, length, k)), np.empty((blocks, length, k))
    x = ahead
    for i in range(length):
        x = (x[:, None, :] @ laid[:, i])[:, 0]
        x = x / x.sum(axis=1, keepdims=True)
        forward[:, i] = x
    x = behind
    for i in range(length - 1, -1, -1):
        backward[:, i] = x
        x = (laid[:, i] @ x[:, :, None])[:, :, 0]
        x = x / x.sum(axis=1, keepdims=True)
    out = (forward * backward).reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def state_probabilities(df: DataFrame, series: Series, likelihood: str, moves: np.ndarray, start: np.ndarray, name: str) -> DataFrame:
    """Add ``name``: for each row the probabilities of its states, given the likelihoods of its whole history.

    ``likelihood`` is an array with the likelihood of the row in each state, up to a
    factor; where it is missing, or nowhere positive, the row tells nothing. ``moves``
    has the chances of going from one state (row) to another (column), ``start`` those
    of a history's first row. Forward and backward passes are products of small
    matrices: chunks multiply theirs, the products before and after a chunk say what
    reaches it, and each chunk then fills in its rows.
    """
    moves, start = np.asarray(moves, float), np.asarray(start, float)
    keys, k = list(series.keys), len(start)
    # A row takes some k * k numbers here, so chunks are smaller than those of windows.
    cut = chunked(df, series, max(1, int_conf(df, CHUNK_ROWS_CONF, CHUNK_ROWS) // 2))
    rows = (df if cut is None else cut.withColumnRenamed(_CHUNK, "__at")).withColumn(name, F.lit(None).cast("array<double>"))
    rows = rows if cut is not None else rows.withColumn("__at", F.lit(0).cast("long"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def steps_of(group: pd.DataFrame) -> np.ndarray:
        found = np.ones((len(group), k))
        values = group[likelihood].to_numpy()
        whole = np.flatnonzero([v is not None and len(v) == k for v in values])
        told = np.array(values[whole].tolist(), float).reshape(len(whole), k)
        tells = np.isfinite(told).all(axis=1) & (told >= 0).all(axis=1) & (told.sum(axis=1) > 0)
        found[whole[tells]] = told[tells] / told[tells].sum(axis=1, keepdims=True)
        return _steps(found, moves, opens=group["__at"].iloc[0] == 0)

    def filled(group: pd.DataFrame, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        group = group.sort_values(list(series.order), kind="stable")
        probabilities = smoothed(steps_of(group), before, after)
        return group.assign(**{name: list(probabilities)}).drop(columns=["__before", "__after"], errors="ignore")

    # Columns that a scan does not need stay out of it.
    part = [*keys, "__at"]
    need = [*dict.fromkeys([*part, *series.order, likelihood])]
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*need, name])
    if cut is None:
        done = rows.select(*need).groupBy(*part).applyInPandas(lambda g: filled(g, start, np.ones(k))[[*need, name]], schema)
    else:

        def summed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(list(series.order), kind="stable")
            return pd.DataFrame([{**{c: group[c].iloc[0] for c in part}, "whole": product(steps_of(group)).ravel()}])

        key_schema = ", ".join(f"`{c}` {types[c]}" for c in part)
        products = rows.select(*need).groupBy(*part).applyInPandas(summed, f"{key_schema}, whole array<double>")

        def combined(group: pd.DataFrame) -> pd.DataFrame:
            """A key's chunks: what the products before and after each say."""
            group = group.sort_values("__at")
            matrices = [np.asarray(x).reshape(k, k) for x in group["whole"]]
            before, after, x, y = [], [], start, np.ones(k)
            for m in matrices:
                before.append(x)
                x = x @ m / (x @ m).sum()
            for m in reversed(matrices):
                after.append(y)
                y = m @ y / (m @ y).sum()
            return group[part].assign(__before=before, __after=after[::-1])

        reach = lineage_cut(products.groupBy(*keys).applyInPandas(combined, f"{key_schema}, __before array<double>, __after array<double>"), "reach")
        given = _joined(rows.select(*need), reach, part)
        done = given.groupBy(*part).applyInPandas(
            lambda g: filled(g, np.asarray(g["__before"].iloc[0]), np.asarray(g["__after"].iloc[0]))[[*need, name]], schema
        )
    done = done.select(*keys, *[c for c in series.order if c not in keys], name)
    return _joined(df, done, [*keys, *[c for c in series.order if c not in keys]])
