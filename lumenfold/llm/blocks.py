"""Pairs of blocks: the rows of a group against each other, in parts that one task holds.

A group (a cluster of sets, a value of a block table) may hold any number of rows. Its rows are cut into blocks of a
bounded number and weight, and each pair of blocks that can hold a result is a unit of work that is dealt on its own: no
task holds a whole group, and no row of two rows is ever emitted. What a function finds in a pair of blocks is its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from lumenfold.llm.words import release

#: Rows that are turned to Python values at once.
SLICE = 256


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], work: Callable[[list[tuple]], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply `work` to each run of rows with equal `keys`, as tuples of `columns`; its tuples make rows of `schema`."""
    held: list[tuple] = []
    out: list[tuple] = []
    last = None

    def flush(most: int) -> Iterator[pa.RecordBatch]:
        if len(out) > most:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)
            out.clear()

    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        key_rows = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        for key, row in zip(key_rows, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if held and key != last:
                out += work(held)
                held = []
                yield from flush(10_000)
            last = key
            held.append(row)
    if held:
        out += work(held)
    yield from flush(0)
    release()
