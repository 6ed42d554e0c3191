"""Records that cross line ends, read in splits: each split is scanned for what it does to the scanner's state.

A file is read by Spark's text reader in byte ranges, cut at a separator. A first pass computes, for each state in which a
split may begin, the state in which it ends and whether a record begins in it; the compositions of these from a file's
first split on (a few numbers a split) give every split's true state, with which a second pass cuts its records. A record
that goes on into the next splits is put together from its pieces by its first split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import FILE

_SUMMARY = "file string, block long, began array<boolean>, ended array<long>"
_PIECE = "file string, block long, i long, part long, text string, whole boolean"


class CsvScan:
    """States: 0 before a record, 1 inside a quoted cell. A quote opens a cell only where the cell begins."""

    separator, starts = None, (0, 1)
    _close = re.compile(r'(?:[^"]|"")*"(?!")')

    @classmethod
    def after(cls, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                end = cls._close.match(line, at)
                if not end:
                    return True
                inside, at = False, end.end()
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            comma = line.find(",", at)
            if comma < 0:
                return False
            at = comma + 1

    def summary(self, texts: Iterator[list[str]]) -> tuple[list[bool], list[int]]:
        state, began = [False, True], [False, False]
        for lines in texts:
            for line in lines:
                for s in (0, 1):
                    began[s] |= not state[s]
                    state[s] = self.after(line, state[s])
        return began, [int(s) for s in state]

    def compose(self, state: int, began: list[bool], ended: list[int]) -> tuple[int, bool]:
        return ended[state], began[state]

    def open(self, state: int) -> bool:
        return state == 1

    def cut(self, texts: Iterator[list[str]], state: int) -> Iterator[tuple[str, bool]]:
        """Texts of records, the first being the rest of the open one if there is one, and whether they end here."""
        held, inside = [], bool(state)
        for lines in texts:
            for line in lines:
                held.append(line)
                inside = self.after(line, inside)
                if not inside:
                    yield "\n".join(held), True
                    held = []
        if held:
            yield "\n".join(held) + "\n", False


class JsonArrayScan:
    """The objects of an array. A state is the depth of brackets times 2, plus 1 inside a string; the array's own depth is 1."""

    separator = "}"

    def _structure(self, data: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where brackets outside strings stand, the depth after each, and whether a string is open at the end."""
        quote = np.flatnonzero(data == 34)
        plain = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1))
        before = quote - 1 - np.where(quote > 0, plain[np.maximum(quote - 1, 0)], -1)
        quote = quote[before % 2 == 0]  # not behind an odd number of backslashes
        at = np.flatnonzero((data == 123) | (data == 125) | (data == 91) | (data == 93))
        at = at[(np.searchsorted(quote, at) + inside) % 2 == 0]
        step = np.where((data[at] == 123) | (data[at] == 91), 1, -1)
        return at, depth + np.cumsum(step), (len(quote) + inside) % 2

    def summary(self, texts: Iterator[list[str]]) -> tuple[list[bool], list[int]]:
        # for a split that begins outside and one that begins inside a string: depth gained, least depth, string at the end
        got = [[0, 0, 0], [0, 0, 1]]
        for chunks in texts:
            data = np.frombuffer("".join(c + "}" for c in chunks).encode(), np.uint8)
            for g in got:
                _, depth, g[2] = self._structure(data, g[2], g[0])
                if len(depth):
                    g[0], g[1] = int(depth[-1]), min(g[1], int(depth.min()))
        return [], [x for g in got for x in g]

    def compose(self, state: int, began: list[bool], ended: list[int]) -> tuple[int, bool]:
        gained, least, inside = ended[3 * (state & 1) : 3 * (state & 1) + 3]
        depth = state >> 1
        return 2 * (depth + gained) + inside, depth + least <= 1

    def open(self, state: int) -> bool:
        return state >> 1 > 1

    def cut(self, texts: Iterator[list[str]], state: int) -> Iterator[tuple[str, bool]]:
        depth, inside, open_, held = state >> 1, state & 1, self.open(state), []
        for chunks in texts:
            data = np.frombuffer("".join(c + "}" for c in chunks).encode(), np.uint8)
            at, after, inside = self._structure(data, inside, depth)
            first = at[(data[at] == 123) & (after == 2)]
            last = at[(data[at] == 125) & (after == 1)] + 1
            if len(after):
                depth = int(after[-1])
            if open_:
                first = np.append(0, first)
            for a, z in zip(first[: len(last)].tolist(), last.tolist(), strict=True):
                held.append(data[a:z].tobytes())
                yield b"".join(held).decode(), True
                held = []
            open_ = len(first) > len(last)
            if open_:
                held.append(data[int(first[-1]) :].tobytes())
        if held:
            yield b"".join(held).decode(), False


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[list[str]]]]:
    """File, first byte and batches of texts of each split: a task's rows come split by split."""
    rest: list[tuple[str, int, list[str]]] = []

    def runs() -> Iterator[tuple[str, int, list[str]]]:
        for b in batches:
            file, block, text = (b.column(c).to_pylist() for c in ("file", "block", "value"))
            at = 0
            for k in range(1, len(file) + 1):
                if k == len(file) or (file[k], block[k]) != (file[at], block[at]):
                    yield file[at], block[at], text[at:k]
                    at = k

    source = runs()
    while rest or (head := next(source, None)) is not None:
        file, block, first = rest.pop() if rest else head

        def of(first: list[str] = first, key: tuple[str, int] = (file, block)) -> Iterator[list[str]]:
            yield first
            for f, k, texts in source:
                if (f, k) != key:
                    rest.append((f, k, texts))
                    return
                yield texts

        yield file, block, of()


def chunks(spark: SparkSession, paths: str | list[str], scan) -> DataFrame:
    """value, file and block (the split's first byte) of the texts between separators."""
    options = {} if scan.separator is None else {"lineSep": scan.separator}
    return spark.read.options(**options).text(paths).select("value", F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"))


def records(texts: DataFrame, scan) -> tuple[DataFrame, dict[str, int]]:
    """file, at (the record's place: its split's first byte plus its number there) and text of every record, and the state at each file's end."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, parts in _by_split(batches):
            began, ended = scan.summary(parts)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([began], pa.list_(pa.bool_())), pa.array([ended], pa.list_(pa.int64()))], names=["file", "block", "began", "ended"])

    start: dict[tuple[str, int], tuple[int, int]] = {}  # of each split: its state, and the split of the open record
    end: dict[str, int] = {}
    state, origin, of = 0, 0, None
    for r in texts.mapInArrow(summarize, _SUMMARY).orderBy("file", "block").collect():  # a row a split
        if r["file"] != of:
            state, of = 0, r["file"]
        start[of, r["block"]] = (state, origin)
        state, began = scan.compose(state, r["began"], r["ended"])
        origin = r["block"] if began else origin
        end[of] = state

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            names = ("file", "block", "i", "part", "text", "whole")
            return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))})

        for file, block, parts in _by_split(batches):
            state, origin = start[file, block]
            i, rows = -1 if scan.open(state) else 0, []
            for text, ends in scan.cut(parts, state):
                rows.append((file, origin, None, block, text, False) if i < 0 else (file, block, i, block, text, ends))
                i += 1
                if len(rows) == 2000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    pieces = texts.mapInArrow(cut, _PIECE)
    whole = pieces.filter("whole").select("file", (F.col("block") + F.col("i")).alias("at"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    crossing = pieces.filter("NOT whole").groupBy("file", "block").agg(F.max("i").alias("i"), joined.alias("text"))
    return whole.unionByName(crossing.select("file", (F.col("block") + F.col("i")).alias("at"), "text")), end
