"""A corpus in parts, so that what Spark gathers over all of it comes back to the rows without moving their texts again.

A part is a run of rows of one task with about so many bytes. Its rows are written once, with its number. Each later look at
the corpus reads them where they are; what was found for a part meanwhile (sums over all parts of the keys that it has) lies
in a folder of its own in the shared folder, which whoever reads rows of that part opens. A lost task reads both again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

#: Bytes of text of a part; a longer text is a part of its own.
PART_BYTES = 64 << 20


def numbered(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], size_of: str = "text", part_bytes: int = PART_BYTES):
    """A function for mapInArrow: run makes batches from a batch; each gets `part`, a number that no other task gives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(size_of)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < b.num_rows:
                done = sizes[start - 1] if start else 0
                end = max(start + (size == 0), int(np.searchsorted(sizes, done + part_bytes - size, side="right")))
                for out in run(b.slice(start, end - start)) if end > start else ():
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.int64()), out.num_rows), *out.columns], ["part", *out.schema.names])
                size += int(sizes[end - 1] - done) if end > start else 0
                if end < b.num_rows:
                    part, size = part + 1, 0
                start = end

    return task


def by_part(run: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow over rows with a column part: run gets the rows of one part at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    yield from run(int(parts[start]), b.slice(start, end - start))

    return task


def give_back(found: DataFrame, uri: str) -> None:
    """Writes rows with a column part, each part's in its own folder."""
    found.repartition("part").write.partitionBy("part").parquet(uri)


class Returned:
    """What was given back, a part at a time. make gets the part's table (None where nothing came back)."""

    def __init__(self, uri: str, make: Callable[[pa.Table | None], object]):
        self.uri, self.make, self.part, self.value = uri, make, None, None

    def __call__(self, part: int):
        if part != self.part:
            files, path = common.store(self.uri)
            here = files.get_file_info(common.fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
            tables = []
            for f in here:
                if f.path.endswith(".parquet"):
                    with files.open_input_file(f.path) as src:
                        tables.append(pq.ParquetFile(src).read(use_threads=False))
            self.value = self.make(pa.concat_tables(tables) if tables else None)
            self.part = part
        return self.value
