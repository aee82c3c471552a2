"""What the training-data operators share: lineage cuts, grouped Arrow streams, and the library's connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..operators.graph import connected_components
from ..storage import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir", "sorted_runs", "runs", "connected_components"]

#: Python tasks hand rows back to Spark in batches of this many rows.
BATCH_ROWS = 20_000


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Regroups batches that arrive sorted by ``key`` so that no run of equal keys is cut; columns must hold no nulls."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
        if rest and (cut or rest[-1].column(key)[rest[-1].num_rows - 1].as_py() != keys[0]):
            yield _columns([*rest, batch.slice(0, cut)] if cut else rest)
            rest = [batch.slice(cut)]
        elif cut:
            yield _columns([batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield _columns(rest)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {name: table.column(name).to_numpy() for name in table.column_names}


def runs(keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal neighbours, with the length at the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, int)
