"""Records of delimited files whose quotes hold line breaks, read split by split.

A split begins somewhere in its file, perhaps inside quotes. Whether it does follows from the number of quotes before it: quotes
are counted per split, summed over the splits before, and each split is then cut into records from its known state. Only
records that reach over the edge of a split are put together afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ship this module inside the task, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.string()), ("value", pa.string()), ("first", pa.bool_())])


def quotes_in(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))


class Cutter:
    """Cuts the lines of one split after another into records: (file, block, "record" | "head" | "tail" | "through", text,
    whether it is the first of the file that is not blank).

    A head ends a record of an earlier split, a tail begins one that ends later, a split without an edge of records is a
    part of one that goes through.
    """

    def __init__(self):
        self.split, self.held, self.inside, self.begun, self.fresh = None, [], False, False, False

    def _part(self, kind: str, text: str) -> tuple:
        first = self.fresh and not text.isspace() and text != ""
        self.fresh &= not first
        return (*self.split, kind, text, first)

    def _left(self) -> Iterator[tuple]:
        if self.held:
            yield self._part("tail" if self.begun else "through", "\n".join(self.held))
        self.held = []

    def begin(self, split: tuple[str, int], inside: bool) -> Iterator[tuple]:
        yield from self._left()
        self.split, self.inside, self.begun, self.fresh = split, inside, not inside, split[1] == 0

    def lines(self, values: list[str], odd: list[bool]) -> Iterator[tuple]:
        for value, turns in zip(values, odd, strict=True):
            if self.inside or turns:
                self.held.append(value)
                self.inside ^= turns
                if not self.inside:
                    yield self._part("record" if self.begun else "head", "\n".join(self.held))
                    self.held, self.begun = [], True
            else:
                yield self._part("record", value)

    def end(self) -> Iterator[tuple]:
        yield from self._left()


def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = Cutter()
    for batch in stream:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        value = batch.column("value")
        odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False) % 2 == 1
        edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | np.array([a != b for a, b in zip(files, files[1:])], bool)) + 1).tolist(), batch.num_rows]
        out: list[tuple] = []
        for a, b in zip(edges, edges[1:]):
            split = (files[a], int(blocks[a]))
            if split != cutter.split:
                out += cutter.begin(split, batch.column("inside")[a].as_py())
            out += cutter.lines(value[a:b].to_pylist(), odd[a:b].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_LINE)], schema=_LINE)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cutter.end()), _LINE)] or [pa.array([], f.type) for f in _LINE], schema=_LINE)


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``file``, ``record``, ``first`` (of its file): the records of a file or directory, line breaks in quotes included, blank
    ones left out.

    Quotes are ``"``, doubled inside quotes; a quote elsewhere must not occur an odd number of times in a record. Any
    encoding that writes the ASCII characters as single bytes will do. Lines stay where they are read: two scans, and a
    shuffle of at most two pieces per split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes_in(F.col("value"))).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    states = splits.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    # one narrow row per split is broadcast, which keeps the order of lines
    parts = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", text.alias("value"), "inside").mapInArrow(_cut, "file string, block bigint, part string, value string, first boolean")
    whole = parts.where("part = 'record'").select("file", F.col("value").alias("record"), "first")
    pieces = parts.where("part <> 'record'")
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("part") == "tail", 1).otherwise(0))
    numbered = pieces.withColumn("n", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(order))
    joined = numbered.groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("part") == "tail", 1).otherwise(0).alias("k"), "value"))), lambda p: p["value"]), "\n").alias("record"), F.max("first").alias("first"))
    records = whole.unionByName(joined.select("file", "record", "first")).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where(F.col("record").rlike(r"\S"))
