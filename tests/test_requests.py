"""A saved plan has no departures; each fault is located under its name."""

from pyspark.sql import functions as F

from spanloom.operators import requests

RETRIEVED = [
    (0, "What is a?", [f"(a, r, {i})" for i in range(7)], [f"(a, r, {i})" for i in range(15)], ["s" * 300, "t", "u"]),
    (1, "What is b?", [], ["(b, r, c)"], ["only"]),
    (2, "What is c?", None, None, None),
]


def made(spark):
    df = spark.createDataFrame(RETRIEVED, "question_index long, question string, facts1 array<string>, facts2 array<string>, sentences array<string>")
    return requests.plan(df, "m"), df.select("question_index", "question")


def found(saved, questions):
    return sorted((r.ordinal, r.problem) for r in requests.violations(saved, questions, "m").collect())


def test_contexts_and_prompts(spark):
    plan, questions = made(spark)
    rows = {r.ordinal: r for r in plan.collect()}
    assert len(rows) == 15 and [rows[i].mode for i in range(5)] == list(requests.MODES)
    hybrid = rows[4]
    assert len(hybrid.context.included_triples) == 5 and hybrid.context.source_excerpts == ["s" * 200]
    assert hybrid.prompt == "Based on this evidence:\nKnowledge graph:\n" + "\n".join(f"- (a, r, {i})" for i in range(5)) + "\n\nSource text:\n- " + "s" * 200 + "\n\nAnswer in 1-2 words: What is a?"
    assert rows[14].prompt == "Based on this evidence:\nKnowledge graph:\n\n\nSource text:\n- \n\nAnswer in 1-2 words: What is c?"
    assert rows[10].prompt == "Answer in 1-2 words. What is c?"
    assert found(plan, questions) == [] and found(plan.where("false"), questions.where("false")) == []


def test_each_fault(spark):
    plan, questions = made(spark)
    context = F.col("context")

    def put(ordinal, **changes):
        return plan.withColumns({c: F.when(F.col("ordinal") == ordinal, v).otherwise(F.col(c)) for c, v in changes.items()})

    def field(name, value):
        return context.withField(name, value)

    more = F.array(F.lit("x"))
    cases = [
        (plan.where("ordinal <> 3"), [(3, "missing")]),
        (plan.unionByName(plan.where("ordinal = 6")), [(6, "repeated")] * 2),
        (plan.withColumn("ordinal", F.when(F.col("ordinal") == 14, 99).otherwise(F.col("ordinal"))), [(14, "missing"), (99, "unknown")]),
        (put(2, mode=F.lit("kg_2hop")), [(2, "order")]),
        (put(7, question_index=F.lit(9)), [(7, "order")]),
        (put(7, question_sha256=F.lit(None)), [(7, "question")]),
        (put(5, prompt=F.lit("?")), [(5, "prompt"), (5, "prompt_hash"), (5, "request_hash")]),
        (put(5, prompt=F.lit(None).cast("string")), [(5, "prompt"), (5, "prompt_hash"), (5, "request_hash")]),
        (put(5, context_sha256=F.lit("")), [(5, "context_hash")]),
        (put(5, request_sha256=F.lit("")), [(5, "request_hash")]),
        (put(0, context=field("retrieved_sentences", more)), [(0, "boundary"), (0, "context_hash")]),
        (put(3, context=field("retrieved_triples", F.concat(context["retrieved_triples"], more))), [(3, "boundary"), (3, "caps"), (3, "context_hash")]),
        (put(9, context=field("retrieved_triples", more)), [(9, "boundary"), (9, "context_hash"), (9, "sibling_facts")]),
        (put(9, context=field("retrieved_sentences", F.concat(context["retrieved_sentences"], more))), [(9, "context_hash"), (9, "sibling_sentences")]),
        (put(12, context=field("included_triples", F.lit(None).cast("array<string>"))), [(12, "boundary"), (12, "context_hash"), (12, "prompt")]),
    ]
    for saved, expect in cases:
        assert found(saved, questions) == expect
