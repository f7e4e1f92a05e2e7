"""Toxicity: a counterfactual-regularised logistic classifier over words and word beginnings.

Training rows are labelled documents outside the held-out fold, one for each id, `TRAIN_ROWS` of either label at most, chosen
by a hash of the id (a documented bound on the fit alone; every document is scored). Where that bound bites, each row counts
for the rows of its label that it stands for, so scores keep the base rate of all labelled rows at every size. Features are
the distinct words of a text and their first 4 and 5 characters, hashed; `FEATURES` of them are kept by their G-squared
association with the label over the sample, which Spark counts by feature.

Counterfactuals: in every sentence of a training text that names a group of people, the terms of one axis (sex, faith,
origin, ...) are swapped for the other terms of that axis. The loss is logistic loss + L2 + `PENALTY` times the mean squared
change of the score between a sentence and its counterfactuals, so weight that rests on which group is named costs more than
it earns, and neutral mentions do not look toxic. A score is a sum over features, so a counterfactual is no more than the
features that the swap adds and removes, and how often the text has that swap.

Swaps that add and remove the same features are one swap with the sum of their shares, added up in Spark over the sample; none
is left out. What the driver holds is bounded by the fit: 2 * TRAIN_ROWS rows of at most FEATURES numbers each, and the distinct
swaps, of which the terms of the axes allow so many. FEATURES bounds the model, as TRAIN_ROWS bounds the sample.

Scoring keeps each distinct word's features in a bounded cache, so the work per word is a lookup. The model is `FEATURES`
numbers. Labels, lang, source and doc_id never enter a score.

Defined cases: a null or empty text has no features and scores the bias alone; without training rows of both labels all
scores are the share of toxic rows (0 without any); a null id counts as the empty text for the fold and is never trained on;
an id that is labelled both ways is left out of the fit, one that is labelled repeatedly counts once, and of rows that repeat
a labelled id the one whose text has the smallest hash stands for it; repeated rows score alike; very long texts are read
whole; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written

FOLDS = 5
TRAIN_ROWS = 5_000
SPACE = 1 << 18
FEATURES = 4_096
LEAST_DOCS = 5
LEAST_G2 = 12.0
L2 = 2e-4
PENALTY = 4.0
ONE = 1 << 40  # a text's swaps come in shares of this, whole numbers, so that no order of adding matters
SENTENCE = re.compile(r"[.!?…\n]+")
STEPS = 300
CACHE = 300_000
EDGES = ".,;:!?()[]{}\"'«»„“”…"

#: Terms that name groups of people, by axis; any term of an axis may stand for any other.
IDENTITY_AXES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)
AXIS_OF = {term: axis for axis in IDENTITY_AXES for term in axis}


def word_features(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES)
    if not word:
        return ()
    names = {"w" + word, "4" + word[:4], "5" + word[:5]}
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % SPACE for n in names)


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def features_of(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def counterfactuals(words: set[str]) -> list[set[str]]:
    """For each axis that the words name: the words with each term of that axis moved on by one place, by two, ..."""
    named = {w: w.strip(EDGES) for w in words}
    out = []
    for axis in sorted({AXIS_OF[t] for t in named.values() if t in AXIS_OF}):
        for shift in range(1, len(axis)):
            out.append({axis[(axis.index(t) + shift) % len(axis)] if t in axis else w for w, t in named.items()})
    return out


def swaps_of(text: str | None) -> Counter:
    """(features added, features removed) of every swap in every sentence of a text that names a group, and how often it has each."""
    found: Counter = Counter()
    for sentence in SENTENCE.split(text or ""):
        words = words_of(sentence)
        base = None
        for version in counterfactuals(words):
            base = features_of(words) if base is None else base
            other = features_of(version)
            found[tuple(sorted(other - base)), tuple(sorted(base - other))] += 1
    return found


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (text, toxic): (feature, n1, n0), how many toxic and other texts of the partition hold each feature."""
    totals = np.zeros((2, SPACE), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals[toxic, sorted(features_of(words_of(text)))] += 1
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[1][used]), pa.array(totals[0][used])], ["feature", "n1", "n0"])


def packed(features, place: dict[int, int]) -> bytes:
    """The places of those features that are kept."""
    return np.array(sorted(place[f] for f in features if f in place), np.int32).tobytes()


def featurise(kept: list[int]):
    """Arrow map over (text, toxic): (toxic, features) of each text, of the kept features alone; features are places in `kept`."""
    place = {f: i for i, f in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [packed(features_of(words_of(text)), place) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.binary())], ["toxic", "features"])

    return run


def swapped(kept: list[int]):
    """Arrow map over (text, toxic): (toxic, added, removed, part), every swap of a text and its part of the text's swaps, of ONE in all."""
    place = {f: i for i, f in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                swaps: Counter = Counter()
                for (more, less), n in swaps_of(text).items():
                    swaps[packed(more, place), packed(less, place)] += n
                every = sum(swaps.values())
                rows += [(toxic, more, less, n * ONE // every) for (more, less), n in swaps.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["toxic", "added", "removed", "part"])

    return run


def sampled(sample: DataFrame, kept: list[int]) -> tuple[list, list]:
    """What the driver fits on: (toxic, features) of every row, and (toxic, added, removed, part) of every distinct swap."""
    rows = sample.mapInArrow(featurise(kept), "toxic int, features binary").collect()
    swaps = sample.mapInArrow(swapped(kept), "toxic int, added binary, removed binary, part long")
    return rows, swaps.groupBy("toxic", "added", "removed").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()


def g_squared(n1: Column, n0: Column, t1: int, t0: int) -> Column:
    """Association of a feature (held by n1 of t1 toxic and n0 of t0 other rows) with the label."""
    share = (n1 + n0) / F.lit(float(t1 + t0))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    return part(n1, t1 * share) + part(t1 - n1, t1 * (1 - share)) + part(n0, t0 * share) + part(t0 - n0, t0 * (1 - share))


@dataclass
class Sample:
    """Rows to fit on: labels, share of each row in the loss, and the pairs (row, feature) of texts and of what swaps add and remove."""

    y: np.ndarray
    share: np.ndarray
    x: tuple[np.ndarray, np.ndarray]
    added: tuple[np.ndarray, np.ndarray]
    removed: tuple[np.ndarray, np.ndarray]
    swap_share: np.ndarray


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> Model:
    """The classifier; `labels` has doc_id and toxic."""
    toxic = F.col("toxic").cast("int")
    rows = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(toxic).alias("toxic"), F.max(toxic).alias("most"))
        .where("toxic = most")
        .select("doc_id", "toxic")
    )
    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("toxic = 1").orderBy(*first).limit(train_rows).unionByName(rows.where("toxic = 0").orderBy(*first).limit(train_rows))
    # at most 2 * train_rows ids are broadcast; one row of each stays
    text = F.col(text_col).cast("string")
    found = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("row"))
    sample = written(one.select("row.text", "row.toxic"))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(40.0 if n.get(1) else -40.0)
    counted = sample.mapInArrow(count_features, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    g2 = g_squared(F.col("n1"), F.col("n0"), n[1], n[0])
    usable = counted.withColumn("g2", g2).where((F.col("n1") + F.col("n0") >= LEAST_DOCS) & (F.col("g2") >= LEAST_G2))
    kept = sorted(r.feature for r in usable.orderBy(F.col("g2").desc(), "feature").limit(FEATURES).collect())
    weight = tuple(max(1.0, total.get(label, 0) / train_rows) for label in (0, 1))
    bias, weights = train(sample_of(*sampled(sample, kept), weight), len(kept), penalty)
    return Model(bias, dict(zip(kept, weights.tolist(), strict=True)))


def sample_of(rows: list, swaps: list, weight: tuple[float, float] = (1.0, 1.0)) -> Sample:
    """What `sampled` gives, as arrays; `weight`: how many labelled rows a row of label 0 or 1 stands for. A text that names
    groups counts once, however often it does."""
    rows = sorted(rows, key=lambda r: (r.toxic, bytes(r.features)))
    swaps = sorted(swaps, key=lambda r: (r.toxic, bytes(r.added), bytes(r.removed)))

    def pairs(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        columns = [np.frombuffer(x, np.int32) for x in lists]
        return np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate([*columns, np.zeros(0, np.int32)]).astype(int)

    y = np.array([r.toxic for r in rows], float)
    share = np.array(weight)[y.astype(int)]
    share /= share.sum()
    swap_share = np.array([weight[r.toxic] * int(r.part) / ONE for r in swaps], float)
    if len(swaps):
        swap_share /= swap_share.sum()
    return Sample(y, share, pairs([r.features for r in rows]), pairs([r.added for r in swaps]), pairs([r.removed for r in swaps]), swap_share)


def loss(s: Sample, w: np.ndarray, bias: float, penalty: float) -> tuple[float, np.ndarray, float]:
    """The penalised loss, and its slope by weight and by bias."""
    z = np.clip(np.bincount(s.x[0], w[s.x[1]], len(s.y)) + bias, -40, 40)
    slope = (1 / (1 + np.exp(-z)) - s.y) * s.share
    n = len(s.swap_share)
    change = np.bincount(s.added[0], w[s.added[1]], n) - np.bincount(s.removed[0], w[s.removed[1]], n) if n else np.zeros(0)
    pull = 2 * penalty * change * s.swap_share
    grad = np.bincount(s.x[1], slope[s.x[0]], len(w)) + L2 * w
    if n:
        grad += np.bincount(s.added[1], pull[s.added[0]], len(w)) - np.bincount(s.removed[1], pull[s.removed[0]], len(w))
    value = float(s.share @ (np.logaddexp(0, z) - s.y * z)) + L2 / 2 * float(w @ w) + penalty * float(s.swap_share @ change**2)
    return value, grad, float(slope.sum())


def train(s: Sample, n_features: int, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    rate_toxic = float(s.share @ s.y)
    w, bias = np.zeros(n_features), float(np.log(rate_toxic / (1 - rate_toxic)))
    m, v, b1, b2, rate = np.zeros(n_features + 1), np.zeros(n_features + 1), 0.9, 0.999, 0.05
    for step in range(1, STEPS + 1):
        _, by_weight, by_bias = loss(s, w, bias, penalty)
        grad = np.append(by_weight, by_bias)
        m, v = b1 * m + (1 - b1) * grad, b2 * v + (1 - b2) * grad * grad
        move = rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return float(bias), w


def score_texts(model: Model):
    """Arrow map over (doc_id, held_out, text): (doc_id, held_out, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights

        class Cache(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                held = tuple(f for f in word_features(word) if f in weights)
                if len(self) >= CACHE:
                    self.clear()
                if len(word) < 64:
                    self[word] = held
                return held

        cache = Cache()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text in part.column(2).to_pylist():
                    held = set().union(*filter(None, [cache[w] for w in words_of(text)]))
                    out.append(model.bias + sum(weights[f] for f in sorted(held)))
                score = 1 / (1 + np.exp(-np.clip(np.array(out), -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, held_out, score, predicted."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(score_texts(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
