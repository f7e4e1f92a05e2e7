"""Column expressions over token arrays and spans. Token spans are inclusive, character spans half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def up_to(n: Column) -> Column:
    """1 .. n, empty below 1 (a bare sequence would count downwards)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def span_text(words: Column, start: Column, end: Column) -> Column:
    """The words start .. end (from 0, inclusive), joined by spaces."""
    return F.array_join(F.slice(words, start + 1, end - start + 1), " ")


def locate_tokens(words: Column, tokens: Column) -> Column:
    """Starts (from 1) of every place where `tokens` occur in `words`."""
    n = F.size(tokens)
    return F.filter(up_to(F.size(words) - n + 1), lambda i: F.slice(words, i, n) == tokens)


def greedy_non_overlap(spans: Column) -> Column:
    """Of spans sorted by preference, those that do not overlap one kept before. Elements have start and end, inclusive."""
    empty = F.slice(spans, 1, 0)
    return F.aggregate(
        spans,
        empty,
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] <= s["end"]) & (s["start"] <= k["end"])), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")


def is_run_id(value: Column) -> Column:
    return value.rlike("^[a-z0-9][a-z0-9-]{2,63}$")


def is_local_url(value: Column) -> Column:
    """An http(s) URL of this machine, without user, query or fragment."""
    return value.rlike("^https?://(localhost|127[.]0[.]0[.]1)(:[0-9]{1,5})?/?$")
