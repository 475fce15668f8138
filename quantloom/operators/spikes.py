"""Implausible readings, judged against each series' own normal behaviour.

Robust principal components over profiles of consecutive days split a series
into a low-rank normal part and a sparse part; readings in the sparse part are
the candidates for spikes, and an exact comparison with their neighbours
settles them. Constant runs and impossible values are tested separately.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.calendar import day_number


@dataclass(frozen=True)
class SpikeRules:
    """Thresholds in units of a series' typical move, the median absolute difference of neighbouring logs."""

    spike_moves: float = 15.0
    max_group: int = 3
    stuck_moves: float = 0.02
    stuck_run: int = 8
    profile_reach: int = 3
    rank: int = 2
    sweeps: int = 3
    #: Entries of the sparse part beyond this are candidates; far below spike_moves so that the low rank may take a share of a spike.
    sparse_moves: float = 3.0
    #: Start of the sparse part: what exceeds this in a profile can't pull the components towards itself.
    clip_moves: float = 4.0


def _starts_to_ids(first: np.ndarray) -> np.ndarray:
    return np.cumsum(first) - 1


def _typical_moves(moves: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and least positive of the moves by series; NaN where there are none. moves and ids in series order."""
    typical, least = np.full(n, np.nan), np.full(n, np.nan)
    if not len(moves):
        return typical, least
    at = np.lexsort((moves, ids))
    m, counts = moves[at], np.bincount(ids, minlength=n)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    has = counts > 0
    typical[has] = (m[begin[has] + (counts[has] - 1) // 2] + m[begin[has] + counts[has] // 2]) / 2
    positive = m > 0
    some, where = np.unique(ids[at][positive], return_index=True)
    least[some] = m[positive][where]
    return typical, least


def sparse_part(logs: np.ndarray, first: np.ndarray, scale: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """For each reading, the largest entry that it has in the sparse part of its series' profile matrix, in units of ``scale``,
    and whether it lies in a profile with any sparse entry.

    Row t of the matrix is the profile of days t-reach..t+reach about its own median (edges repeat the outermost
    reading). The matrices of all series of a batch are decomposed at once: their Gram matrices are summed over
    rows and their eigenvectors taken as a stack.
    """
    n, reach = len(logs), rules.profile_reach
    ids = _starts_to_ids(first)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    lo, hi = begin[ids], end[ids] - 1
    around = np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :], lo[:, None], hi[:, None])
    rows = logs[around]
    rows = np.clip((rows - np.median(rows, axis=1, keepdims=True)) / scale[ids][:, None], -1e6, 1e6)
    sparse = rows - np.clip(rows, -rules.clip_moves, rules.clip_moves)
    for _ in range(rules.sweeps):
        calm = rows - sparse
        gram = np.add.reduceat(calm[:, :, None] * calm[:, None, :], begin, axis=0)
        vectors = np.linalg.eigh(gram)[1][:, :, -rules.rank :]
        loads = np.einsum("ni,nir->nr", calm, vectors[ids])
        rest = rows - np.einsum("nr,nir->ni", loads, vectors[ids])
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - rules.sparse_moves, 0)
    most = np.zeros(n)
    np.maximum.at(most, around.ravel(), np.abs(sparse).ravel())
    touched = np.zeros(n, bool)
    touched[around[(sparse != 0).any(axis=1)].ravel()] = True
    return most, touched


def flag_series(value: np.ndarray, first: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """Kinds (0 none, 1 range, 2 stuck, 3 spike) and sparse scores of readings lying series by series in order of time."""
    kind, score = np.zeros(len(value), np.int8), np.zeros(len(value))
    good = np.isfinite(value) & (value > 0)
    kind[~good] = 1
    ids_all = _starts_to_ids(first)
    where = np.flatnonzero(good)
    if not len(where):
        return kind, score
    _, ids = np.unique(ids_all[where], return_inverse=True)
    logs, n = np.log(value[where]), ids.max() + 1
    start = np.concatenate(([True], ids[1:] != ids[:-1]))
    moves = np.abs(np.diff(logs, prepend=logs[0]))
    inside = ~start
    typical, least = _typical_moves(moves[inside], ids[inside], n)

    still = inside & (moves < rules.stuck_moves * typical[ids])
    run = np.cumsum(~still)  # a run is a reading and the still ones after it
    length = np.bincount(run)[run]
    stuck = still & (length >= rules.stuck_run)

    # With a typical move of zero any difference exceeds it; the least difference then stands for spike_moves of them.
    scale = np.where(typical > 0, typical, np.where(least > 0, least / (2 * rules.spike_moves), 1.0))
    # Spikes close together hide in one another's profiles, so every reading of a profile with a sparse entry is a candidate.
    sparse, candidate = sparse_part(logs, start, scale, rules)

    bar = (rules.spike_moves * typical)[ids]
    spike = np.zeros(len(logs), bool)
    for size in range(1, rules.max_group + 1):
        # Groups g..g+size-1 with a neighbour on either side in the same series, all of them candidates.
        g = np.arange(1, len(logs) - size)
        if not len(g):
            break
        g = g[(ids[g - 1] == ids[np.minimum(g + size, len(logs) - 1)]) & np.logical_and.reduce([candidate[g + k] for k in range(size)])]
        if not len(g):
            continue
        members = logs[g[:, None] + np.arange(size)[None, :]]
        above, below = np.maximum(logs[g - 1], logs[g + size]), np.minimum(logs[g - 1], logs[g + size])
        hit = (members.min(axis=1) - above > bar[g]) | (below - members.max(axis=1) > bar[g])
        for k in range(size):
            spike[g[hit] + k] = True
    kind[where[stuck]] = 2
    kind[where[spike]] = 3
    score[where] = sparse
    return kind, score


KINDS = np.array(["", "range", "stuck", "spike"])


def _flag_batches(batches: Iterator[pa.RecordBatch], rules: SpikeRules) -> Iterator[pa.RecordBatch]:
    """Batches sorted by series; rows of the series that a batch ends with wait for the next one."""
    held: list[tuple[np.ndarray, ...]] = []

    def flagged(ids: np.ndarray, value: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        kind, score = flag_series(value, first, rules)
        at = np.flatnonzero(kind)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(KINDS[kind[at]]), pa.array(score[at])], ["reading_id", "kind", "sparse_moves"])

    def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*parts))

    for b in batches:
        part = (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
        if not len(part[0]):
            continue
        starts = np.flatnonzero(part[2])
        if not len(starts):
            held.append(part)
            continue
        cut = starts[-1]
        held.append(tuple(x[:cut] for x in part))
        ids, value, first = joined(held)
        if len(ids):
            yield flagged(ids, value, first)
        held = [tuple(x[cut:] for x in part)]
    if held:
        ids, value, first = joined(held)
        if len(ids):
            yield flagged(ids, value, first)


def implausible_readings(
    readings: DataFrame,
    series: Sequence[str] = ("card_id", "panel_id", "asset"),
    defaults: dict[str, str] | None = None,
    rules: SpikeRules = SpikeRules(),
) -> DataFrame:
    """Rows (reading_id, kind, sparse_moves), one for each implausible reading: ``range``, ``stuck`` or ``spike``.

    ``defaults`` gives what a null in a series column stands for; other nulls there are a value of their own. Rows
    with a null reading_id, value or unreadable date are left out; copies of a reading count once, and where
    rows of one reading_id differ each is judged and the id comes out once; readings of one day follow each other by date text, then reading_id; an empty table and series
    of fewer than three readings give no spikes; other columns of the input are ignored.

    Shuffles: copies are dropped map-side before one on the reading, then one on the series with a sort. A task
    reads its rows as a stream of Arrow batches and holds one series, which has at most a row for each
    day and reading, not all rows of a card.
    """
    defaults = defaults or {}
    keys = [F.coalesce(F.col(s), F.lit(defaults[s])).alias(f"_k{i}") if s in defaults else F.col(s).alias(f"_k{i}") for i, s in enumerate(series)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = readings.select("reading_id", *keys, day_number(F.col("date")).alias("day"), F.col("date").alias("text"), F.col("value").cast("double").alias("v"))
    once = rows.where("reading_id is not null and v is not null and day is not null").distinct()
    by = Window.partitionBy(*names).orderBy("day", "text", "reading_id")
    flat = once.withColumn("first", F.row_number().over(by) == 1).select(F.col("reading_id").cast("bigint"), "v", "first")
    flagged = flat.mapInArrow(lambda b: _flag_batches(b, rules), "reading_id bigint, kind string, sparse_moves double")
    return flagged.groupBy("reading_id").agg(F.min("kind").alias("kind"), F.max("sparse_moves").alias("sparse_moves"))
