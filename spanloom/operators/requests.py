"""A saved plan of requests: contexts captured once, prompts rebuilt from them, and every departure located."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.graph import CAP

#: The modes in the order of a question's requests.
MODES = ("llm_only", "text_retrieval", "kg_1hop", "kg_2hop", "hybrid")
FACTS, EXCERPT, SENTENCES, HYBRID_FACTS = CAP, 200, 3, 5
CONTEXT = ("retrieved_triples", "included_triples", "retrieved_sentences", "source_excerpts")


def _none() -> Column:
    return F.array().cast("array<string>")


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")


def _cut(sentence: Column) -> Column:
    return F.substring(sentence, 1, EXCERPT)


def prompt(mode: Column, question: Column, context: Column) -> Column:
    """The prompt that a saved context gives in a mode."""
    end = F.concat(F.lit("\n\nAnswer in 1-2 words: "), question)
    included, excerpts = context["included_triples"], context["source_excerpts"]
    return (
        F.when(mode == "llm_only", F.concat(F.lit("Answer in 1-2 words. "), question))
        .when(mode == "text_retrieval", F.concat(F.lit("Based on these scientific sentences:\n"), _bullets(excerpts), end))
        .when(mode == "hybrid", F.concat(F.lit("Based on this evidence:\nKnowledge graph:\n"), _bullets(included), F.lit("\n\nSource text:\n- "), F.coalesce(F.get(excerpts, F.lit(0)), F.lit("")), end))
        .otherwise(F.concat(F.lit("Based on this knowledge graph:\n"), _bullets(included), end))
    )


def payload(model: str, text: Column) -> Column:
    """The request's bytes, in the order its fields are sent."""
    return F.to_json(F.struct(F.lit(model).alias("model"), text.alias("prompt"), F.lit(False).alias("stream")))


def identities(model: str) -> dict[str, Column]:
    """Digests of a request's prompt, context and payload."""
    return {"prompt_sha256": F.sha2("prompt", 256), "context_sha256": F.sha2(F.to_json("context"), 256), "request_sha256": F.sha2(payload(model, F.col("prompt")), 256)}


def plan(retrieved: DataFrame, model: str) -> DataFrame:
    """(ordinal, question_index, question_sha256, mode, context, prompt and digests) from one retrieval a question.

    `retrieved` has (question_index, question, facts1, facts2, sentences): the facts of one and of two hops and the
    sentences, in order; null is none. The hybrid's context is made of what one hop and the text mode hold.
    """
    one, two, said = (F.coalesce(c, _none()) for c in ("facts1", "facts2", "sentences"))
    texts = F.transform(said, _cut)
    contexts = {
        "llm_only": (_none(), _none(), _none(), _none()),
        "text_retrieval": (_none(), _none(), said, texts),
        "kg_1hop": (one, one, _none(), _none()),
        "kg_2hop": (two, two, _none(), _none()),
        "hybrid": (one, F.slice(one, 1, HYBRID_FACTS), said, F.array(F.coalesce(F.get(texts, F.lit(0)), F.lit("")))),
    }
    rows = [F.struct(F.lit(i).alias("nth"), F.lit(m).alias("mode"), F.struct(*[c.alias(n) for n, c in zip(CONTEXT, contexts[m], strict=True)]).alias("context")) for i, m in enumerate(MODES)]
    flat = retrieved.select("question_index", "question", F.explode(F.array(*rows)).alias("x"))
    full = flat.select((F.col("question_index") * len(MODES) + F.col("x.nth")).alias("ordinal"), "question_index", "question", F.sha2("question", 256).alias("question_sha256"), "x.mode", "x.context")
    return full.withColumn("prompt", prompt(F.col("mode"), F.col("question"), F.col("context"))).drop("question").withColumns(identities(model))


def violations(saved: DataFrame, questions: DataFrame, model: str) -> DataFrame:
    """(ordinal, problem) of a saved plan against its `questions` (question_index, question); a request may have several.

    `missing`, `repeated` and `unknown` requests; `order` of question or mode; `question`; `caps`; `boundary`, where what a
    mode may include of what it retrieved differs; `prompt`, rebuilt from the context; `prompt_hash`, `context_hash`,
    `request_hash`; `sibling_facts` and `sibling_sentences`, where a hybrid departs from its one-hop or text request. Nulls
    differ from everything. Rows meet by question and in a question's few requests; no order over the whole plan is made.
    """
    n = len(MODES)
    expected = questions.select(F.col("question_index").alias("asked"), "question", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth")).withColumn("ordinal", F.col("asked") * n + F.col("nth"))
    context = F.col("context")
    facts, included, said, excerpts = (F.coalesce(context[c], _none()) for c in CONTEXT)
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), F.col("nth") + 1)
    bounds = (
        F.when(mode == "llm_only", F.size(F.concat(facts, included, said, excerpts)) == 0)
        .when(mode == "text_retrieval", (F.size(F.concat(facts, included)) == 0) & (excerpts == F.transform(said, _cut)))
        .when(mode == "hybrid", (included == F.slice(facts, 1, HYBRID_FACTS)) & (excerpts == F.array(F.coalesce(_cut(F.get(said, F.lit(0))), F.lit("")))))
        .otherwise((included == facts) & (F.size(F.concat(said, excerpts)) == 0))
    )
    whole = reduce(lambda a, b: a & b, [context[c].isNotNull() & ~F.exists(context[c], lambda s: s.isNull()) for c in CONTEXT])
    within = Window.partitionBy("asked")

    def sibling(wanted: str, field: str) -> Column:
        return F.min(F.when(mode == wanted, F.coalesce(context[field], _none()))).over(within)

    hybrid = (mode == "hybrid") & F.col("mode").isNotNull()
    tests = {
        "order": F.col("question_index").eqNullSafe(F.col("asked")) & F.col("mode").eqNullSafe(mode),
        "question": F.col("question_sha256").eqNullSafe(F.sha2("question", 256)),
        "caps": (F.size(facts) <= FACTS) & (F.size(said) <= SENTENCES),
        "boundary": F.coalesce(whole & bounds, F.lit(False)),
        "prompt": F.col("prompt").eqNullSafe(prompt(mode, F.col("question"), context)),
        **{name.replace("_sha256", "_hash"): F.col(name).eqNullSafe(digest) for name, digest in identities(model).items()},
        "sibling_facts": ~hybrid | facts.eqNullSafe(F.col("near_facts")),
        "sibling_sentences": ~hybrid | said.eqNullSafe(F.col("near_sentences")),
    }
    there = F.col("saved") & F.col("asked").isNotNull()
    known = expected.join(saved.withColumn("saved", F.lit(True)), "ordinal", "full").withColumns(
        {"near_facts": sibling("kg_1hop", "retrieved_triples"), "near_sentences": sibling("text_retrieval", "retrieved_sentences"), "times": F.count(F.lit(1)).over(Window.partitionBy("ordinal"))})
    found = [F.when(F.col("saved").isNull(), "missing"), F.when(F.col("asked").isNull(), "unknown"), F.when((F.col("times") > 1) & there, "repeated"), *[F.when(there & ~test, name) for name, test in tests.items()]]
    return known.select("ordinal", F.explode(F.array_compact(F.array(*found))).alias("problem"))
