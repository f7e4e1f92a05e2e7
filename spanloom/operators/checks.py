"""Named checks over several tables, compiled to one aggregate per table.

A check asks that no row of its table is wrong, or that measures of tables agree. All that the checks ask of a table are columns
of one aggregate over it, so a table is read once however many checks there are; what is kept is a count and the least
offending key of each. The rows that tables come to, one each, meet at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NoRow:
    """Passes if no row of the table is `wrong` (a null is not); `key` names a row."""

    name: str
    table: str
    wrong: Column
    key: Column


@dataclass(frozen=True)
class Holds:
    """Passes if `holds` is true of `measures`: name to (table, aggregate); `holds` names them as columns."""

    name: str
    holds: Column
    measures: dict[str, tuple[str, Column]] = field(default_factory=dict)


def run(checks: list[NoRow | Holds], tables: dict[str, DataFrame]) -> DataFrame:
    """(check, status, n_wrong, first_wrong, all_passed), a row per check; status is pass or fail."""
    asked: dict[str, list[Column]] = {}
    for i, check in enumerate(checks):
        if isinstance(check, NoRow):
            wrong = F.coalesce(check.wrong, F.lit(False))
            asked.setdefault(check.table, []).extend([F.count_if(wrong).alias(f"n{i}"), F.min(F.when(wrong, check.key.cast("string"))).alias(f"k{i}")])
        else:
            for name, (table, measure) in check.measures.items():
                asked.setdefault(table, []).append(measure.alias(f"m{i}_{name}"))
    found = None
    for table, columns in asked.items():
        row = tables[table].agg(*columns)
        found = row if found is None else found.crossJoin(row)  # one row each
    told = []
    for i, check in enumerate(checks):
        if isinstance(check, NoRow):
            told.append(F.struct(F.lit(check.name).alias("check"), (F.col(f"n{i}") == 0).alias("ok"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")))
    for i, check in enumerate(checks):
        if isinstance(check, Holds):
            found = found.withColumns({name: F.col(f"m{i}_{name}") for name in check.measures}).withColumn(f"ok{i}", F.coalesce(check.holds, F.lit(False))).drop(*check.measures)
            ok = F.col(f"ok{i}")
            told.append(F.struct(F.lit(check.name).alias("check"), ok.alias("ok"), F.when(ok, 0).otherwise(1).cast("long").alias("n"), F.lit(None).cast("string").alias("k")))
    rows = found.withColumn("told", F.array(*told))
    every = F.forall("told", lambda x: x["ok"])
    return rows.select(every.alias("all_passed"), F.explode("told").alias("x")).select(
        "x.check", F.when(F.col("x.ok"), "pass").otherwise("fail").alias("status"), F.col("x.n").alias("n_wrong"), F.col("x.k").alias("first_wrong"), "all_passed")


#: Fields that a request may show a model, attempts, seconds to wait before the second and third, and training seeds.
SHOWN = ("sentence", "tokens", "candidate")
MOST_ATTEMPTS = 3
WAIT = {2: 2.0, 3: 4.0}
GRACE = 0.05
SEEDS = 8


def pilot_gate(tables: dict[str, DataFrame], shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """The sixteen checks that a pilot has to pass. `tables`:

    index (candidate_id, seed); pilot (candidate_id, split, has_gold); calls (call_id, run_id, expected_run, started, declared,
    attempt, waited, cached, fields); ledgers (mode, repeat, identity, n); pairs (mode, candidate_id, status1, status2, verdict1,
    verdict2), a row per candidate and mode; emissions (candidate_id, safe, emitted); settings (selected, recorded), one row.
    """
    c = F.col
    early = (c("attempt") > MOST_ATTEMPTS) | (c("attempt") < 1)
    for attempt, seconds in WAIT.items():
        early = early | ((c("attempt") == attempt) & (c("waited") < seconds - GRACE))
    candidate, call = c("candidate_id"), c("call_id")

    def independent(mode: str) -> Holds:
        here = c("mode") == mode
        return Holds(f"{mode}-independent-calls", (c("files") == 2) & (c("repeats") == 2), {"files": ("ledgers", F.count_distinct(F.when(here, c("identity")))), "repeats": ("ledgers", F.count_distinct(F.when(here, c("repeat"))))})

    def same(mode: str) -> NoRow:
        return NoRow(f"{mode}-two-call-determinism", "pairs", (c("mode") == mode) & ~c("verdict1").eqNullSafe(c("verdict2")), candidate)

    checks = [
        NoRow("development-only-inputs", "pilot", ~c("split").eqNullSafe("development"), candidate),
        Holds("full-development-index", c("seeds") == SEEDS, {"seeds": ("index", F.count_distinct("seed"))}),
        NoRow("predeclared-pilot-subset", "calls", ~F.coalesce(c("declared") < c("started"), F.lit(False)), call),
        NoRow("live-capture-provenance", "calls", ~c("run_id").eqNullSafe(c("expected_run")), call),
        NoRow("retry-error-policy", "calls", early, call),
        NoRow("gold-pairing", "pilot", ~F.coalesce("has_gold", F.lit(False)), candidate),
        Holds("development-threshold", (c("least") >= 0) & (c("most") <= 1) & (c("wrong") == 0), {"least": ("settings", F.min("selected")), "most": ("settings", F.max("selected")), "wrong": ("settings", F.count_if(~c("selected").eqNullSafe(c("recorded"))))}),
        NoRow("prompt-evidence-separation", "calls", F.size(F.array_except("fields", F.array(*[F.lit(x) for x in shown]))) > 0, call),
        independent("simple"),
        independent("corrective"),
        NoRow("response-schema", "pairs", ~(c("status1").eqNullSafe("valid_response") & c("status2").eqNullSafe("valid_response")), candidate),
        NoRow("no-cache-reuse", "calls", c("cached"), call),
        NoRow("correction-emission-safety", "emissions", ~c("safe").eqNullSafe(c("emitted")), candidate),
        same("simple"),
        same("corrective"),
        Holds("paired-condition-universe", (c("rows") == 2 * c("wanted")) & (c("pairs") == 2 * c("wanted")) & (c("ledgers") == 4) & (c("least_n") == c("wanted")) & (c("most_n") == c("wanted")), {
            "wanted": ("pilot", F.count_distinct("candidate_id")), "rows": ("pairs", F.count(F.lit(1))), "pairs": ("pairs", F.count_distinct("mode", "candidate_id")),
            "ledgers": ("ledgers", F.count(F.lit(1))), "least_n": ("ledgers", F.min("n")), "most_n": ("ledgers", F.max("n"))}),
    ]
    return run(checks, tables)
