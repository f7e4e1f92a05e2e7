"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: the raw corpus over every document, where it is, and the
trusted target over all rows of ids that are labelled as of good quality. A bit map of fixed size lets through the rows whose ids
may be trusted, and only these are shuffled to meet the ids. A document's score is the mean of log p_target / p_raw over its
n-grams, and it is kept if the base rules pass and the score is at least `THRESHOLD`: the same rule for every document at every
size, without sampling noise.

The model is `BUCKETS` numbers, whatever the corpus; counts meet through an ordinary partial aggregation by bucket.

Defined cases: a null or empty text has no words, so it fails the base rules, with score 0; without trusted rows the
scores are 0 and the base rules alone decide; a null id is never trusted and is passed on; rows that repeat an id, labelled or
not, each count and are judged alike; very long texts are read whole, in pieces of whole texts; an empty table gives no rows;
columns other than the two named are not looked at by `judge` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import textkit
from spanloom.llm.textkit import U64

BUCKETS = 1 << 16
SMOOTHING = 4.0
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
SLOTS = 1 << 25
SPREAD = 16


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes and where each text's begin; buckets of unigrams (one per word) and of bigrams, and where those begin."""
    starts, ends, of_text = textkit.words(data, offsets)
    hashes = textkit.range_hash(textkit.byte_prefix(data), starts, ends)
    pairs, pair_at = textkit.windows(hashes, of_text, 2)
    shift = U64(64 - 15)
    uni = (hashes >> shift).astype(np.int64)
    bi = (pairs >> shift).astype(np.int64) + BUCKETS // 2
    return hashes, of_text, uni, bi, pair_at


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (text): (bucket, n) of the partition."""
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in textkit.pieces(batch.column(0)):
            _, _, uni, bi, _ = ngrams(data, offsets)
            for grams in (uni, bi):
                totals += np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])


def marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows whose doc_id may be a trusted one, found where they are: those whose slot of a bit map is set.

    The map has SLOTS bits however many ids there are, in SLOTS / 32,768 rows of 4 kB each, which every task may hold; a row
    of another id passes if it shares a slot.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))

    bits = trusted.groupBy(F.bitmap_bucket_number(slot()).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("bits"))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("part", F.bitmap_bucket_number(slot())).join(F.broadcast(bits), "part")
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("part", "bits")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of the trusted ids, all rows of each; only rows that `marked` lets through meet the ids in a shuffle, and the
    rows of one id are dealt to SPREAD tasks."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = trusted.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    likely = marked(docs, trusted).withColumn("spread", F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("int"))
    return likely.join(dealt.hint("shuffle_hash"), ["doc_id", "spread"], "left_semi").select("text")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target / p_raw of each bucket. The raw corpus is counted where it is, the target from the rows of trusted ids."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sides = (docs.select("text"), trusted_texts(docs, labels))
    grams = None
    for side, texts in enumerate(sides):
        found = texts.mapInArrow(count_grams, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("side", F.lit(side))
        grams = found if grams is None else grams.unionByName(found)
    counts = np.zeros((2, BUCKETS))
    for row in grams.collect():  # at most 2 * BUCKETS rows
        counts[row.side, row.bucket] = row.n
    if not counts[1].any():
        return np.zeros(BUCKETS, np.float32)
    return log_ratio(counts)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p_target / p_raw by bucket. Both get SMOOTHING counts on the target's scale, so that what the raw corpus rarely has is no evidence."""
    half = BUCKETS // 2
    model = np.zeros(BUCKETS)
    for part in (slice(0, half), slice(half, BUCKETS)):
        raw, target = counts[0][part], counts[1][part]
        model[part] = np.log((target + SMOOTHING) / (raw * (target.sum() / max(raw.sum(), 1)) + SMOOTHING))
    return model.astype(np.float32)


def repeated_words(hashes: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    grams, at = textkit.windows(hashes, of_text, WINDOW)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = textkit.mix(grams ^ textkit.mix(text.astype(U64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice) + (of_text[:-1] - at[:-1])[text[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return textkit.per_text(np.cumsum(cover)[:-1] > 0, of_text)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, prefixes: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    inner = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], inner + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, "right") - 1
    nexts = np.append(starts[1:], len(data))
    ends = np.minimum(nexts, offsets[text + 1])
    ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10))
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, text = starts[filled], ends[filled], text[filled]
    key = textkit.mix(textkit.range_hash(prefixes, starts, ends) ^ textkit.mix(text.astype(U64)))
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def score_texts(model: np.ndarray):
    """Arrow map over (doc_id, text): the base counts and the mean log ratio of each text."""
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in textkit.pieces(batch.column(1)):
                word_starts, _, _ = textkit.words(data, offsets)
                hashes, of_text, uni, bi, pair_at = ngrams(data, offsets)
                n_grams = np.diff(of_text) + np.diff(pair_at)
                summed = textkit.per_text_sum(model[uni], of_text) + textkit.per_text_sum(model[bi], pair_at)
                columns = [
                    np.diff(of_text),
                    textkit.per_text(~textkit.WHITE[data] & ((data & 0xC0) != 0x80), offsets),
                    textkit.per_text(is_symbol[data], offsets),
                    repeated_lines(data, offsets, textkit.byte_prefix(data), word_starts),
                    repeated_words(hashes, of_text),
                    np.where(n_grams > 0, summed / np.maximum(n_grams, 1), 0.0),
                ]
                arrays = [batch.column(0)[row:end], *(pa.array(c) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COLUMNS.split(", ")])

    return score


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: doc_id, the base counts, score, base_failed, kept."""
    model = fit(df, labels, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(score_texts(model), COLUMNS)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("score") >= threshold))
    )


def keep_good(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that the rules keep, with all columns as they were; texts are judged where they are, without a join."""
    model = fit(df, labels, id_col, text_col)
    schema, at = df.schema, df.columns.index(text_col)
    score = score_texts(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            judged = pa.Table.from_batches(score([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])])) if batch.num_rows else None
            if judged is not None:
                n, again, value = (judged[c].to_numpy() for c in ("n_words", "n_repeat_words", "score"))
                good = (n >= LEAST_WORDS) & (100 * again <= 30 * n) & (value >= threshold)
                yield batch.filter(pa.array(good))

    return df.mapInArrow(keep, schema)
