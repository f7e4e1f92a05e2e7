"""Responses of a checking model: from attempts to one verdict per candidate, and joins of verdicts with candidates and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans

#: Fixed values of the response contract.
REASONS = ("SUPPORTED", "WRONG_RELATION", "WRONG_HEAD", "WRONG_TAIL", "UNSUPPORTED", "AMBIGUOUS")
ACTIONS = {"simple": ("KEEP", "DISCARD", "UNCERTAIN"), "corrective": ("KEEP", "DISCARD", "UNCERTAIN", "CORRECT")}
KEYS = {"simple": ("action", "reason_code"), "corrective": ("action", "corrected", "reason_code")}
CORRECTED = ("head_text", "head_type", "relation", "tail_text", "tail_type")
NONE = "not_applicable"


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null where there is none or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def has_keys(text: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(n) for n in names]), F.lit(False))


def located(words: Column, text: Column) -> Column:
    """valid, ambiguous or out_of_source: how often the words of a text, joined by single blanks, stand in the source."""
    tokens = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    n = F.size(spans.locate_tokens(words, tokens))
    return F.when((F.size(tokens) == 0) | (F.array_join(tokens, " ") != text) | (n == 0), "out_of_source").when(n > 1, "ambiguous").otherwise("valid")


def interpreted(attempts: DataFrame, mode: str, entity_types: list[str], relations: list[str]) -> DataFrame:
    """Adds response_status, error_category, action, reason_code, correction_status and fix (the corrected fields) to attempts.

    `attempts` has transport_status, http_status, raw (the body), words (of the source) and own (the candidate's five fields as a
    struct like fix). The ladder: timeout, transport, body that is no JSON object, no message, content that is no JSON, content
    off the schema, and only then a valid response, whose correction is judged against the source.
    """
    body = attempts.withColumn("body", F.try_parse_json("raw"))
    content = body.withColumn("content", text_at(F.col("body"), "$.message.content"))
    v = content.withColumn("value", F.try_parse_json("content"))
    v = v.withColumn("a", text_at(F.col("value"), "$.action")).withColumn("r", text_at(F.col("value"), "$.reason_code"))
    known = F.coalesce(F.col("a").isin(*ACTIONS[mode]) & F.col("r").isin(*REASONS), F.lit(False))
    shaped = is_object(F.col("value")) & has_keys(F.col("content"), KEYS[mode]) & known
    if mode == "corrective":
        inner = F.get_json_object("content", "$.corrected")
        v = v.withColumn("fix", F.struct(*[text_at(F.col("value"), f"$.corrected.{n}").alias(n) for n in CORRECTED]))
        asks, given = F.col("a") == "CORRECT", inner.isNotNull() & (inner != "null")
        whole = has_keys(inner, CORRECTED) & (F.length("fix.head_text") > 0) & (F.length("fix.tail_text") > 0)
        whole = F.coalesce(whole & F.col("fix.head_type").isin(*entity_types) & F.col("fix.tail_type").isin(*entity_types) & F.col("fix.relation").isin(*relations), F.lit(False))
        bad = F.when(asks, ~whole).otherwise(given)
        head, tail = (located(F.col("words"), F.col(f"fix.{s}_text")) for s in ("head", "tail"))
        found = (
            F.when((head == "ambiguous") | (tail == "ambiguous"), "ambiguous")
            .when((head == "out_of_source") | (tail == "out_of_source"), "out_of_source")
            .when(F.col("fix") == F.col("own"), "schema_invalid")
            .otherwise("valid")
        )
        correction = F.when(shaped & asks & ~whole, "schema_invalid").when(shaped & asks, found).otherwise(NONE)
        shaped = shaped & ~bad
    else:
        v = v.withColumn("fix", F.lit(None).cast("string"))
        correction = F.lit(NONE)
    answered = (F.col("transport_status") == "response") & (F.col("http_status") == 200)
    status = (
        F.when(F.col("transport_status") == "timeout", "timeout_exhausted")
        .when(~F.coalesce(answered, F.lit(False)), "transport_exhausted")
        .when(~is_object(F.col("body")), "malformed")
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "schema_invalid")
        .when(F.col("value").isNull(), "malformed")
        .when(~shaped, "schema_invalid")
        .otherwise("valid_response")
    )
    v = v.withColumn("response_status", status).withColumn("judged", correction)
    error = (
        F.when(F.col("response_status") == "valid_response", F.lit(None).cast("string"))
        .when(F.col("response_status") == "timeout_exhausted", "timeout")
        .when(F.col("response_status") == "transport_exhausted", "transport")
        .when(~is_object(F.col("body")), "non_json_http_response")
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "missing_message_content")
        .otherwise(F.col("response_status"))
    )
    valid = F.col("response_status") == "valid_response"
    reached = F.coalesce(F.length("content") > 0, F.lit(False)) & F.col("response_status").isin("valid_response", "schema_invalid", "malformed")
    return v.select(
        *[c for c in attempts.columns if c not in ("raw", "words", "own")], "response_status", error.alias("error_category"),
        F.when(valid, F.col("a")).alias("action"), F.when(valid, F.col("r")).alias("reason_code"), F.when(reached, F.col("judged")).alias("correction_status"),
        F.when(valid & (F.col("judged") == "valid"), F.col("fix")).alias("fix"),
    )


def final_verdicts(attempts: DataFrame, by: list[str]) -> DataFrame:
    """The first valid attempt of each candidate, else its last one; n_attempts counts all of them."""
    valid = F.col("response_status") == "valid_response"
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(valid, F.col("attempt")).asc_nulls_last(), F.col("attempt").desc()))
    return attempts.withColumn("n_attempts", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("first", first).where("first = 1").drop("first")


def safe_emission(verdicts: DataFrame) -> DataFrame:
    """Adds keeps (the candidate stays) and emits (it or its correction goes out): a correction only if its place in the source is sure."""
    valid = F.col("response_status") == "valid_response"
    keeps = F.coalesce(valid & (F.col("action") == "KEEP"), F.lit(False))
    mends = F.coalesce(valid & (F.col("action") == "CORRECT") & (F.col("correction_status") == "valid"), F.lit(False))
    return verdicts.withColumn("keeps", keeps).withColumn("emits", keeps | mends)


def reconciled(candidates: DataFrame, verdicts: DataFrame, requests: DataFrame) -> DataFrame:
    """(candidate_id, state): candidates, verdicts and requests brought together, each id once.

    unknown_candidate, duplicate_verdict, missing_verdict, missing_request, request_differs, seed_differs or matched, the first
    that applies. Candidates have (candidate_id, training_seed); the others also request_sha256.
    """
    own = candidates.select("candidate_id", F.col("training_seed").alias("seed"))
    said = verdicts.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_verdicts"), F.min("request_sha256").alias("v_sha"), F.min("training_seed").alias("v_seed"))
    asked = requests.groupBy("candidate_id").agg(F.min("request_sha256").alias("r_sha"), F.min("training_seed").alias("r_seed"))
    both = own.join(said, "candidate_id", "full").join(asked, "candidate_id", "left")
    state = (
        F.when(F.col("seed").isNull(), "unknown_candidate")
        .when(F.col("n_verdicts") > 1, "duplicate_verdict")
        .when(F.col("n_verdicts").isNull(), "missing_verdict")
        .when(F.col("r_sha").isNull(), "missing_request")
        .when(F.col("r_sha") != F.col("v_sha"), "request_differs")
        .when((F.col("seed") != F.col("v_seed")) | (F.col("seed") != F.col("r_seed")), "seed_differs")
        .otherwise("matched")
    )
    return both.select("candidate_id", state.alias("state"))
