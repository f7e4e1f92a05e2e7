"""Packing by concatenate and cut.

All token ids form one long row: documents in table order, each closed by id 0. Pass one tokenises a partition, writes the
ids once and adds up the partition's tokens; prefix sums of those totals give every partition, and so every document, its
global offset. Pass two cuts each document at the multiples of the window, independently of all others: a piece is a
boundary record of (document, start, length, sequence, offset). Only the last sequence is padded.

What is broadcast is one number per input partition, never anything per document.

Tokenising: `tokenizers` defines the ids. Texts are cut before the last space in front of a visible character, which is
always a border of the vocabulary's own split pattern, and the cut pieces' ids are kept in a bounded cache; pieces not in
it are encoded by `tiktoken` from the same vocabulary, which gives the same ids. A text with the string of a special token
goes to `tokenizers` whole.

Defined cases: a null or empty text is the closing id alone; a null id is passed on; repeated rows are packed each for
itself; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

WINDOW = 1024
END_ID = 0
CACHE = 400_000

_CUT = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?!\S)")


def encoder(vocabulary: str, ranks: str, pattern: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 16-bit numbers (the vocabulary has fewer than 65,536)."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(vocabulary, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    ordinary = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(vocabulary)

    class Cache(dict):
        def __missing__(self, piece: str) -> bytes:
            ids = np.array(ordinary(piece), "<u2").tobytes()
            if len(self) >= CACHE:
                self.clear()
            if len(piece) < 64:
                self[piece] = ids
            return ids

    cache = Cache()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if _ODD_SPACE.search(text):
            parts = _CUT.split(text)
        else:
            parts = text.split(" ")
            parts[1:] = [" " + p for p in parts[1:]]
        return b"".join([cache[p] for p in parts])

    return encode


STORED = "part int, doc_id long, before long, n_tokens long, ids binary"


def tokenise(vocabulary: str, ranks: str, pattern: str):
    """Arrow map over (doc_id, text): the ids of each document, closed, and the tokens before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        part, before = TaskContext.get().partitionId(), 0
        close = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = [encode(text or "") + close for text in batch.column(1).slice(at, 256).to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                columns = [pa.array([part] * len(n), pa.int32()), batch.column(0).slice(at, 256), pa.array(first), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "before", "n_tokens", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(window: int):
    """Arrow map over (doc_id, first, n_tokens, ids): the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, first, total = (batch.column(i) for i in range(3))
            first, total = first.to_numpy(), total.to_numpy()
            n = (first + total - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sequence = first[row] // window + nth
            begin = np.maximum(first[row], sequence * window)
            finish = np.minimum(first[row] + total[row], (sequence + 1) * window)
            start = begin - first[row]
            crc = np.zeros(len(row), np.int64)
            held, ids = -1, None
            for i, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), (start + finish - begin).tolist(), strict=True)):
                if r != held:
                    held, ids = r, np.frombuffer(batch.column(3)[r].as_buffer(), "<u2").astype("<u4")
                crc[i] = zlib.crc32(ids[a:b])
            columns = [doc_id.take(pa.array(row)), *(pa.array(x) for x in (start, finish - begin, crc, total[row], sequence, begin - sequence * window))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return run


def placed(df: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, first (its global offset), n_tokens, ids (16-bit, closed)."""
    stored = written(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tokenise(vocabulary, ranks, pattern), STORED)
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    )
    # one row per input partition
    return stored.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("first"), "n_tokens", "ids")


def pack(df: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return placed(df, vocabulary, ranks, pattern, id_col, text_col).mapInArrow(cut(window), PIECES)
