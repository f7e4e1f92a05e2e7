"""Fill-in-middle transformation: segments of a text change places by rotations inside one bytearray, and go back the same way.

A text is cut at two of its line ends into prefix, middle and suffix. The bytearray is given `<P>`, `<M>` and `<S>` before the
three, and one rotation (three reversals) puts the suffix where its form wants it:

    psm   <P>prefix [<M>middle][<S>suffix]   ->  <P>prefix<S>suffix<M>middle
    spm   [<P>prefix<M>middle][<S>suffix]    ->  <S>suffix<P>prefix<M>middle

Restoring finds the sentinels in the output, turns the same blocks back, and deletes the sentinels. A text that holds a
sentinel itself stays plain, so the first of each in an output is always the inserted one. A reversal swaps `CHUNK` bytes from
either end at a time, so beside the one buffer a task holds hardly anything, however long a text is.

Where a text is cut and which form it gets follows from sha256 of the seed and its id alone: no state, no order, the same in
any task that runs again.

Defined cases: a null or empty text is plain and empty, with no lines; a null id counts as the empty string in the draw and is
passed on; repeated rows are transformed alike, each for itself; rows that repeat an id but not a text share their draw; very
long texts are handled whole; an empty table gives no rows; other columns are not looked at and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 1 << 16


@dataclass(frozen=True)
class Draw:
    """Seed of the draws, percentage of texts that are transformed at all, and of these the percentage of form spm."""

    seed: int = 7
    rate: int = 100
    spm: int = 50

    def numbers(self, doc_id: int | None) -> tuple[int, ...]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))

    def form(self, third: int, fourth: int) -> str:
        if third % 100 >= self.rate:
            return "plain"
        return "spm" if fourth % 100 < self.spm else "psm"


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Turns view[a:b] round in place."""
    while b - a > 1:
        n = min(CHUNK, (b - a) // 2)
        low = view[a : a + n][::-1].copy()
        view[a : a + n] = view[b - n : b][::-1]
        view[b - n : b] = low
        a, b = a + n, b - n


def rotate(buffer: bytearray, a: int, m: int, b: int) -> None:
    """The blocks [a, m) and [m, b) of the buffer change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, a, m)
    reverse(view, m, b)
    reverse(view, a, b)


def line_ends(text: bytes) -> np.ndarray:
    """0, and the end of each line with its break; a tail without a break is a line."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    tail = [len(text)] if len(text) and not text.endswith(b"\n") else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def characters(buffer: bytes | bytearray, a: int, b: int) -> int:
    """Code points in a range of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(buffer, np.uint8)[a:b] & 0xC0) != 0x80))


def turned(text: bytes, form: str, cut: int, end: int) -> bytearray:
    """The output of a text whose middle is [cut, end)."""
    buffer = bytearray(text)
    buffer[end:end] = SUFFIX
    buffer[cut:cut] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = cut + len(PREFIX), end + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def turned_back(output: bytes, form: str) -> bytearray:
    """The text that `turned` was given."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form == "psm":
        first = buffer.index(SUFFIX)
        rotate(buffer, first, buffer.index(MIDDLE, first), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    middle = buffer.index(MIDDLE)
    suffix = buffer.index(SUFFIX, middle)
    for at in (suffix, middle, 0):
        del buffer[at : at + 3]
    return buffer


MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def transformed(draw: Draw):
    """Arrow map over (doc_id, text in UTF-8) to MADE; an output batch holds one text of each."""

    def one(doc_id: int | None, text: bytes) -> tuple:
        ends = line_ends(text)
        n = len(ends) - 1
        h = draw.numbers(doc_id)
        held = not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE))
        form = "plain" if held else draw.form(h[2], h[3])
        if form == "plain":
            return n, form, None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        cut, end = int(ends[low]), int(ends[high])
        return n, form, characters(text, 0, cut), characters(text, cut, end), bytes(turned(text, form, cut, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [one(i, t or b"") for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [c.split()[0] for c in MADE.split(", ")])

    return run


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (form, output, others...): the same, with the output turned back to the text it came from."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [bytes(turned_back(o, f)) for f, o in zip(part.column("form").to_pylist(), part.column("output").to_pylist(), strict=True)]
            columns = {name: part.column(name) for name in part.schema.names} | {"output": pa.array(texts, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def transform(df: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output (a string)."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    made = texts.mapInArrow(transformed(draw), MADE)
    return made.withColumn("output", F.col("output").cast("string"))


def restore(df: DataFrame) -> DataFrame:
    """The rows of `transform` with `text`, made of form and output alone, in place of the output."""
    given = df.withColumn("output", F.col("output").cast("binary"))
    back = given.mapInArrow(restored, given.schema)
    return back.withColumn("output", F.col("output").cast("string")).withColumnRenamed("output", "text")
