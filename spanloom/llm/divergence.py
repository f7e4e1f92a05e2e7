"""Source divergence audit: how far the term distributions of a language's sources lie apart, in a cube of partial sums.

Terms are runs of ASCII letters (lower-cased) and of characters outside ASCII. A language keeps the terms that enough of its
documents hold. Each (lang, source) group, and each language, gives each kept term a smoothed share in whole billionths,

    p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V))

and two groups differ by the sum over terms of floor((p - q)^2 / (p + q)): whole numbers throughout, so that the order in which
tasks add does not matter.

All pairs of groups over all terms are a cube. A task owns one cell of it: (group block, group block, term block). The slice
of a group block in a term block is replicated to the cells in which the block is either side; a cell lays its two slices out
as dense matrices of at most about GROUPS x TERMS numbers and sums over its terms, and the partial sums are added along the
term axis. The difference is symmetric, so only cells with first block <= second are there. Terms that no group of a cell
holds count by their number alone.

Counting is done where the texts are: a task adds up at most `ENTRIES` (group, term) counts before it hands them on, so what is
shuffled is counts and never texts, and a source or term that is in a third of all rows costs a few rows a task.

Defined cases: null text, lang and source count as ''; an empty text has no terms, yet its group is there; a language that
keeps no terms has pairs of value 0; a lone source has no pairs; null and repeated ids do not matter, each row is a document;
very long texts are read whole; an empty table gives no rows; other columns are not looked at and may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
GROUPS = 16  # groups of a block, about
TERMS = 4_096  # terms of a block, about
ENTRIES = 200_000

#: A byte of a term is itself, in lower case; all others end a term.
TERM_BYTE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term binary, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTE).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (lang, source, text in UTF-8) to COUNTED, added up over the task as far as `ENTRIES` allow."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                same = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                columns = [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, *columns], [c.split()[0] for c in COUNTED.split(", ")])
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            here = Counter(terms_of(text))
            before = len(n)
            n.update(here)
            docs.update(here.keys())
            entries += len(n) - before
            if entries >= ENTRIES:
                yield from handed_on()
                entries = 0
    yield from handed_on()


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of the module's text; decimals hold any count exactly."""
    numerator = F.lit(SCALE).cast("decimal(12,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", numerator, (total + 2 * kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial differences of the pairs of groups of one cell.

    Rows with a null term tell the groups of either block: source, side, p of a count of 0, and the number of kept terms of the
    term block; the others tell p of a term that the group holds.
    """
    lang, first, second = (k.as_py() for k in key[:3])
    rows = table.to_pandas()
    told = rows["term"].isna()
    heads, body = rows[told].sort_values(["block", "source"], kind="stable"), rows[~told]
    out = {"lang": [], "a": [], "b": [], "value": []}
    names, terms = pd.factorize(body["term"])
    known = len(terms)
    at = pd.Series(np.arange(len(heads)), index=pd.MultiIndex.from_arrays([heads["block"], heads["source"]]))
    p = np.repeat(heads["p"].to_numpy(np.int64)[:, None], known + 1, axis=1)  # the last column: any term that no group here holds
    if known:
        p[at.loc[list(zip(body["block"], body["source"], strict=True))].to_numpy(), names] = body["p"].to_numpy(np.int64)
    times = np.ones(known + 1, np.int64)
    times[-1] = int(heads["kept"].iloc[0]) - known
    block, source = heads["block"].to_numpy(), heads["source"].to_list()
    for i in np.flatnonzero(block == first):
        others = np.flatnonzero(block == second)
        others = others[others > i] if first == second else others
        if len(others):
            q = p[others]
            partial = ((p[i] - q) ** 2 // (p[i] + q)) @ times
            out["lang"] += [lang] * len(others)
            out["a"] += [source[i]] * len(others)
            out["b"] += [source[k] for k in others]
            out["value"] += partial.tolist()
    return pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()})


def ranked(rows: DataFrame, part: str) -> DataFrame:
    """(lang, source, part, item, value, rank): the items of each group, largest value first."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' tells each group's difference from each other source of its language,
    part 'term' the `top` terms that it has more of than its language has. `df` has text, lang and source."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = df.select(*columns)
    partial = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(count_terms, COUNTED).withColumn("term", F.col("term").cast("string"))
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total"))
    held = counts.join(kept, ["lang", "term"])
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("here"))
    every = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    n_groups = every.groupBy("lang").agg(F.count(F.lit(1)).alias("g"))
    none = F.lit(0).cast("long")
    group = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(n_groups, "lang")
    group = group.withColumns({c: F.coalesce(c, none) for c in ("here", "v", "total")})
    term_blocks = F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("long")
    group_blocks = F.ceil(F.col("g") / groups).cast("long")
    # with no kept term nothing asks for a share: any divisor but 0 will do
    divisor_safe = F.when(F.col("v") > 0, F.col("v")).otherwise(1)
    group = written(group.select(
        "lang", "source", "here", "v", "total", term_blocks.alias("nt"), group_blocks.alias("ng"),
        F.pmod(F.xxhash64("source"), group_blocks).alias("block"), share(none, F.col("here"), divisor_safe).alias("p0"),
    ))

    shares = written(held.join(group, ["lang", "source"]).select(
        "lang", "source", "block", "ng", F.pmod(F.xxhash64("term"), F.col("nt")).alias("t"), "term",
        share(F.col("n"), F.col("here"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total"), F.col("v")).alias("q"),
    ))
    special = ranked(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= top)

    # what the cells of a language have in common: the number of kept terms of each term block
    blocks = kept.join(langs.select("lang", F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("long").alias("nt")), "lang")
    blocks = blocks.groupBy("lang", F.pmod(F.xxhash64("term"), F.col("nt")).alias("t")).agg(F.count(F.lit(1)).alias("kept"))
    heads = group.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1)))
    heads = heads.join(blocks, ["lang", "t"], "left").select("lang", "source", "block", "ng", "t", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.coalesce("kept", none).alias("kept"))
    slices = heads.unionByName(shares.select("lang", "source", "block", "ng", "t", "term", "p", none.alias("kept")))
    other = F.explode(F.sequence(none, F.col("ng") - 1))
    slices = slices.select("lang", "source", "block", "t", "term", "p", "kept", other.alias("other"))
    slices = slices.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")
    partial_sums = slices.groupBy("lang", "first", "second", "t").applyInArrow(cell, "lang string, a string, b string, value long")
    sums = partial_sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    return ranked(pairs, "pair").unionByName(special)
