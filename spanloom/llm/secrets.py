"""Secret scans: three patterns, and the entropy of sliding windows, in DataFrame functions alone.

Positions come from splitting the text at the matches: a match starts where the pieces and matches before it end, which is a
prefix sum of lengths, summed in blocks so that its cost grows with the matches and hardly with their square. Java's lengths
are of UTF-16 units inside a pattern, but every length here is Spark's length(), in code points.

Entropy: candidate strings of a character class are walked one character at a time. The state holds the counts of the window's
characters and s = sum n * log2(n), changed only for the character that enters and the one that leaves; the window's Shannon
entropy is log2(w) - s / w. The span runs from the first to the last window over the threshold. Allow-listed candidates (identifiers,
placeholders, alphabets, plain paths) and those inside a span of a pattern add nothing.

Defined cases: a null text is empty; documents without spans give an empty string and its hash; a null id is passed on;
repeated rows are scanned alike, each for itself; very long texts and candidates are read whole, at a cost in proportion to
their length; an empty table gives no rows; other columns are not looked at and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is the maximal run, shorter ones fail
)


@dataclass(frozen=True)
class EntropyClass:
    """A class of characters: candidates, what they must have besides, window and least entropy in bits."""

    kind: str
    pattern: str
    needs: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), 24, 3.9),
    EntropyClass("entropy_hex", r"[0-9A-F]{24,}", ("[0-9]", "[A-F]"), 24, 3.0),
)

#: Candidates that match any of these are not secrets, unless they match the second of the two. No group repeats without a
#: bound, so that a match takes no deeper a stack for a longer candidate.
ALLOWED = (
    (r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)|xxxx", None),
    (r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", None),
    (r"(?i)0123456789|abcdefghij|qwertyuiop", None),
    (r"^/?[A-Za-z][A-Za-z/_-]*[/_-][A-Za-z]*$", r"[/_-][/_-]"),  # words and single separators: a path
)


BLOCK = 64


def prefix_sum(numbers: str, starts: str, i: Column) -> Column:
    """Sum of the first i entries of an array column, whose sums at each BLOCK entries are in `starts`."""
    block = F.floor(i / BLOCK).cast("int")
    rest = F.aggregate(F.slice(numbers, block * BLOCK + 1, i - block * BLOCK), F.lit(0), lambda acc, x: acc + x)
    return F.get(F.col(starts), block) + rest


def places(df: DataFrame, kinds: list[tuple[str, str, int, int]]) -> DataFrame:
    """Adds, for each (kind, pattern, group, least), the (start, end, hit) of the leftmost matches whose `group` has `least` characters.

    Arrays are columns of their own before a lambda reads them, so that they are made once a row and not once a match.
    """
    text = F.col("text")
    none = F.array().cast("array<string>")
    first = []
    for kind, pattern, group, _ in kinds:
        has = text.rlike(pattern)
        first += [
            F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"hits_{kind}"),
            F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none).alias(f"told_{kind}"),
            F.when(has, F.split(text, pattern, -1)).otherwise(none).alias(f"gaps_{kind}"),
        ]
    df = df.select("doc_id", *first)
    steps = [F.zip_with(f"gaps_{kind}", f"hits_{kind}", lambda gap, hit: F.length(gap) + F.coalesce(F.length(hit), F.lit(0))).alias(f"steps_{kind}") for kind, *_ in kinds]
    df = df.select("*", *steps)
    df = df.select("*", *[block_sums(f"steps_{kind}").alias(f"starts_{kind}") for kind, *_ in kinds])
    return df.select("doc_id", *[spans_of(kind, least).alias(kind) for kind, _, _, least in kinds])


def block_sums(steps: str) -> Column:
    """Sums of the entries of an array column before each BLOCK of them."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), F.lit(0), lambda acc, x: acc + x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(sums, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]


def spans_of(kind: str, least: int) -> Column:
    hits, told, gaps = (F.col(f"{x}_{kind}") for x in ("hits", "told", "gaps"))

    def span(hit: Column, i: Column) -> Column:
        start = prefix_sum(f"steps_{kind}", f"starts_{kind}", i) + F.length(F.get(gaps, i))
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), F.length(F.get(told, i)).alias("n"))

    return F.filter(F.transform(hits, span), lambda s: s["n"] >= least)


FIRST, LAST = ord("+"), ord("z")  # of the characters that any class has
ZERO = 48  # a count is the character so many places after this one, so all counts are one string


def window_hull(codes: Column, window: int, bits: float) -> Column:
    """(lo, hi) of the windows of an array of characters with at least `bits` of entropy; lo is -1 if there are none.

    The state holds how often the window has each character, and s = sum n * log2(n); a step changes both by the character that
    enters and the one that leaves, whatever the width of the window.
    """

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substr(counts, at + 1, F.lit(1))) - ZERO

    def put(counts: Column, at: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + ZERO), at + 1, F.lit(1))

    def step(acc: Column, i: Column) -> Column:
        counts = acc["counts"]
        enters = F.get(codes, i) - FIRST
        full = i >= window
        leaves = F.when(full, F.get(codes, i - window) - FIRST).otherwise(F.lit(-1))
        n_in, n_out = count(counts, enters), count(counts, leaves)
        gone = F.when(full, put(counts, leaves, n_out - 1)).otherwise(counts)
        change = weight(n_in + 1) - weight(n_in) + F.when(full, weight(n_out - 1) - weight(n_out)).otherwise(F.lit(0.0))
        s = acc["s"] + F.when(enters == leaves, F.lit(0.0)).otherwise(change)
        over = (i >= window - 1) & (F.log2(F.lit(float(window))) - s / window >= bits - 1e-9)
        return F.struct(
            F.when(enters == leaves, counts).otherwise(put(gone, enters, n_in + 1)).alias("counts"),
            s.alias("s"),
            F.when(over & (acc["lo"] < 0), i - (window - 1)).otherwise(acc["lo"]).alias("lo"),
            F.when(over, i + 1).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(chr(ZERO) * (LAST - FIRST + 1)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    hull = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)
    return F.struct(hull["lo"].alias("lo"), hull["hi"].alias("hi"))


def suspicious(s: Column, kind: EntropyClass) -> Column:
    """Whether a candidate has what its class needs, is not allow-listed and lies in no span of a pattern."""
    allowed = F.lit(False)
    for pattern, unless in ALLOWED:
        here = s["hit"].rlike(pattern)
        allowed = allowed | (here & ~s["hit"].rlike(unless) if unless else here)
    covered = F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    needed = F.lit(True)
    for pattern in kind.needs:
        needed = needed & s["hit"].rlike(pattern)
    return needed & ~allowed & ~covered


def coded(kind: EntropyClass) -> Column:
    """(from, codes) of the suspicious candidates of a class."""
    held = F.filter(kind.kind, lambda s: suspicious(s, kind))
    return F.transform(held, lambda s: F.struct(s["start"].alias("from"), F.transform(F.split(s["hit"], ""), lambda x: F.ascii(x)).alias("codes")))


def hulls(kind: EntropyClass) -> Column:
    return F.transform(f"codes_{kind.kind}", lambda s: F.struct(s["from"].alias("from"), window_hull(s["codes"], kind.window, kind.bits).alias("w")))


def entropy_spans(kind: EntropyClass, rank: int) -> Column:
    def span(s: Column) -> Column:
        return F.struct((s["from"] + s["w"]["lo"]).alias("start"), F.lit(rank).alias("rank"), (s["from"] + s["w"]["hi"]).alias("end"), F.lit(kind.kind).alias("kind"))

    return F.transform(F.filter(f"hulls_{kind.kind}", lambda s: s["w"]["lo"] >= 0), span)


def named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = places(rows, [*PATTERNS, *((c.kind, c.pattern, 0, c.window) for c in CLASSES)])
    base = F.concat(*[named(F.col(kind), rank, kind) for rank, (kind, *_) in enumerate(PATTERNS)])
    found = found.select("*", base.alias("base"))
    found = found.select("*", *[coded(c).alias(f"codes_{c.kind}") for c in CLASSES])
    found = found.select("*", *[hulls(c).alias(f"hulls_{c.kind}") for c in CLASSES])
    extra = [entropy_spans(c, len(PATTERNS) + i) for i, c in enumerate(CLASSES)]
    return found.withColumn("extra", F.concat(*extra)).select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("extra").cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
    )
