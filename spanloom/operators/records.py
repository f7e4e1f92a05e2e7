"""Ledgers bound to one another by id: prepared examples and their faults, evaluator records, field differences, scores of typed and untyped sets.

Nothing here refuses a whole table for one bad row: each row gets the first rule that it breaks, and the caller decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.metrics import zero_ratio

#: What precedes the input of a request, its keys, and those of the candidate in it.
INPUT_MARK = "INPUT_JSON:\n"
INPUT_KEYS = ("sentence", "sentence_processed", "sentence_tokens", "candidate")
CANDIDATE_KEYS = ("head", "relation", "tail")


def words_align(content: str, words: str) -> Column:
    """Whether the words can be found in the content one after the other, each after the end of the one before.

    Words that are the content split at spaces need no search; for others each search begins where the last one ended.
    """
    plain = F.filter(F.split(content, " "), lambda w: w != "") == F.col(words)  # nothing to look for
    found = F.expr(f"aggregate({words}, 1, (at, w) -> CASE WHEN at = 0 OR locate(w, {content}, at) = 0 THEN 0 ELSE locate(w, {content}, at) + length(w) END)")
    return F.when(plain, True).otherwise(found > 0)


def prepared_problems(prepared: DataFrame, types: list[str], relations: list[str]) -> DataFrame:
    """(example_id, n_words, n_spans, n_relations, problem): the first rule that a prepared example breaks, or null.

    `prepared` has example_id, source_id, content, words, spans (start, end inclusive, type) and relations (relation, head, tail,
    each end with start and end). malformed: no id, source, content or words, or a word that is null or empty; repeated_id: the
    id stands more than once, all its rows; unaligned: the words are not in the content in order; span_outside: beyond the
    words, or of an unknown type; relation_outside: unknown, or with an end that is no typed span. Null lists count as empty.

    All but repeated ids is judged where an example is read; ids and verdicts alone are shuffled.
    """
    spans, links = F.coalesce("spans", F.array().cast(prepared.schema["spans"].dataType)), F.coalesce("relations", F.array().cast(prepared.schema["relations"].dataType))
    rows = prepared.withColumn("spans", spans).withColumn("relations", links)
    named = (F.length("example_id") > 0) & (F.length("source_id") > 0) & F.col("content").isNotNull() & (F.size("words") > 0)
    good_words = F.forall("words", lambda w: F.coalesce(F.length(w) > 0, F.lit(False)))
    within = F.forall("spans", lambda s: F.coalesce((s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] < F.size("words")) & s["type"].isin(types), F.lit(False)))

    def codes(ends: str | Column, side: str | None = None) -> Column:
        """Places as numbers, since sets of structs are compared pair by pair."""
        place = lambda x: x[side] if side else x
        return F.transform(ends, lambda x: F.shiftleft(place(x)["start"].cast("long"), 32) + place(x)["end"])

    known = F.forall("relations", lambda r: F.coalesce(r["relation"].isin(relations), F.lit(False)))
    bound = known & (F.size(F.array_except(F.concat(codes("relations", "head"), codes("relations", "tail")), codes("spans"))) == 0)
    own = {"malformed": F.coalesce(named & good_words, F.lit(False)), "unaligned": words_align("content", "words"), "span_outside": within, "relation_outside": bound}
    problem = reduce(lambda rest, rule: F.when(~own[rule], rule).otherwise(rest), reversed(own), F.lit(None).cast("string"))
    told = rows.select("example_id", F.greatest(F.size("words"), F.lit(0)).alias("n_words"), F.size("spans").alias("n_spans"), F.size("relations").alias("n_relations"), problem.alias("own"))
    times = F.count(F.lit(1)).over(Window.partitionBy("example_id"))
    repeated = F.col("example_id").isNotNull() & (F.col("times") > 1) & ~F.col("own").eqNullSafe(F.lit("malformed"))
    return told.withColumn("times", times).select("example_id", "n_words", "n_spans", "n_relations", F.when(repeated, "repeated_id").otherwise(F.col("own")).alias("problem"))


def evaluator_rows(prepared: DataFrame, gold: DataFrame, split_ids: DataFrame) -> DataFrame:
    """(example_id, sentence, gold_triples, problem): the record that an evaluator reads for each id that any table holds.

    `prepared` has example_id and content, `gold` example_id and triples (an array of head_text, relation, tail_text in
    order), `split_ids` example_id. problem lists the tables that lack the id or hold it twice, null for a sound record;
    gold_triples is JSON. An example without triples is one that gold holds with an empty array. Null ids are told once a table.
    """
    tables = {"prepared": prepared.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_prepared"), F.min("content").alias("sentence")),
              "gold": gold.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_gold"), F.min(F.to_json("triples")).alias("gold_triples")),
              "split": split_ids.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_split"))}
    both = reduce(lambda a, b: a.join(b, "example_id", "full"), tables.values())
    faults = [F.when(F.col(f"n_{t}").isNull(), f"not in {t}").when(F.col(f"n_{t}") > 1, f"repeated in {t}") for t in tables]
    return both.select("example_id", "sentence", "gold_triples", F.nullif(F.concat_ws(", ", *faults), F.lit("")).alias("problem"))


def field_differences(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, state (same, differs, left_only, right_only) and the differing fields, comma-joined in the order given; null equals null."""
    a = left.select(*key, F.struct(*fields).alias("l"))
    b = right.select(*key, F.struct(*fields).alias("r"))
    both = a.join(b, key, "full")
    present = F.col("l").isNotNull() & F.col("r").isNotNull()
    changed = F.when(present, F.concat_ws(",", *[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), f) for f in fields])).otherwise("")
    state = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("fields") == "", "same").otherwise("differs")
    return both.withColumn("fields", changed).select(*key, state.alias("state"), "fields")


def is_source_only(content: Column) -> Column:
    """Whether what follows the last INPUT_MARK of a prompt is an object of INPUT_KEYS whose candidate is one of CANDIDATE_KEYS.

    Null, text that is no JSON, and an object that repeats a key: no.
    """
    value = F.when(F.contains(content, F.lit(INPUT_MARK)), F.element_at(F.split(content, INPUT_MARK), -1))
    candidate = F.to_json(F.try_variant_get(F.try_parse_json(value), "$.candidate", "variant"))  # a string stays quoted, so it is no object

    def exactly(json: Column, keys: tuple[str, ...]) -> Column:
        return F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)])

    return F.coalesce(exactly(value, INPUT_KEYS) & exactly(candidate, CANDIDATE_KEYS), F.lit(False))


def set_counts(gold: DataFrame, predicted: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """by, and tp, fp, fn and f1 of two sets of rows with the same columns, which include `by`; f1 is 0 where it is undefined.

    Repeated rows count once. Both sets meet in one shuffle by whole rows.
    """
    rows = gold.withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(predicted.withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    once = rows.groupBy(*gold.columns).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = once.groupBy(*by).agg(*[F.count_if((F.col("g") == g) & (F.col("p") == p)).alias(f"{prefix}_{n}") for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    tp, fp, fn = (F.col(f"{prefix}_{n}") for n in ("tp", "fp", "fn"))
    return counts.withColumn(f"{prefix}_f1", zero_ratio(2 * tp, 2 * tp + fp + fn))


def union_pairs(gold: DataFrame, predicted: DataFrame, example: list[str], by: list[str]) -> DataFrame:
    """by, n_union_spans and n_pairs: the distinct places that either side has in an example, and their ordered pairs, counted and not made."""
    places = gold.unionByName(predicted).select(*example, *by, "start", "end").distinct()
    m = F.col("m")
    return places.groupBy(*example, *by).agg(F.count(F.lit(1)).alias("m")).groupBy(*by).agg(F.sum("m").alias("n_union_spans"), F.sum(m * (m - 1)).alias("n_pairs"))


def array_counts(gold: str, predicted: str, prefix: str) -> list[Column]:
    """tp, fp and fn of two sets that stand in one row as arrays without repeats, of numbers or strings, whose sets are hashed."""
    both = F.size(F.array_intersect(gold, predicted))
    return [both.alias(f"{prefix}_tp"), (F.size(predicted) - both).alias(f"{prefix}_fp"), (F.size(gold) - both).alias(f"{prefix}_fn")]


def summed_counts(counted: DataFrame, by: list[str], prefixes: list[str], *more: Column) -> DataFrame:
    """by, each prefix's tp, fp, fn and f1 (0 where it is undefined) from rows with their own counts, and `more` sums; groups that lack a set are left out."""
    names = {p: [f"{p}_{n}" for n in ("tp", "fp", "fn")] for p in prefixes}
    sums = counted.groupBy(*by).agg(*[F.sum(c).alias(c) for columns in names.values() for c in columns], *more)
    for tp, fp, fn in names.values():
        sums = sums.where(F.col(tp) + F.col(fp) + F.col(fn) > 0).withColumn(f"{tp[:-3]}_f1", zero_ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)))
    return sums
