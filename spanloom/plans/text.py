"""Preparation of annotated text: tags, spans, markers, splits. Lines of documents stand for sentences, pages for marked-up text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.functions.python_udfs import canonical_surface as canonical
from spanloom.plans.scoring import read

#: Fixed values of the stand-in annotation: a word's tag by its length modulo 6.
TAGS = {0: "B-object", 1: "I-object", 2: "B-property", 3: "I-property"}
MAX_WIDTH = 8


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def tokens_of(content: Column) -> Column:
    return F.array_remove(F.split(content, " "), "")


def tag_of(length: Column) -> Column:
    tag = F.lit("O")
    for rest, name in TAGS.items():
        tag = F.when(length % 6 == rest, F.lit(name)).otherwise(tag)
    return tag


def word_tag(word: Column) -> Column:
    return tag_of(F.length(word))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word: doc_id, line, i, word, tag."""
    tag = word_tag(F.col("word"))
    return lines(spark, sf_dir).select("doc_id", "line", F.posexplode(tokens_of(F.col("content"))).alias("i", "word")).withColumn("tag", tag)


WORDS = """
split_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line
  FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, lang, line, content, list_filter(string_split(content, ' '), lambda x: x <> '') AS w FROM split_lines),
words AS (SELECT doc_id, line, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM tokens),
tagged AS (
  SELECT *, CASE length(word) % 6 WHEN 0 THEN 'B-object' WHEN 1 THEN 'I-object' WHEN 2 THEN 'B-property' WHEN 3 THEN 'I-property' ELSE 'O' END AS tag FROM words),
islands AS (
  SELECT *, sum(cut::int) OVER (PARTITION BY doc_id, line ORDER BY i) AS island
  FROM (SELECT *, NOT (tag LIKE 'I-%' AND coalesce(lag(tag) OVER (PARTITION BY doc_id, line ORDER BY i), 'O') <> 'O'
                       AND substr(tag, 3) = substr(lag(tag) OVER (PARTITION BY doc_id, line ORDER BY i), 3)) AS cut FROM tagged)),
grouped AS (SELECT doc_id, line, island, min(i) AS start, max(i) AS "end", first(substr(tag, 3) ORDER BY i) AS type, first(tag ORDER BY i) LIKE 'B-%' AS legal
  FROM islands WHERE tag <> 'O' GROUP BY ALL),
spans AS (SELECT * FROM grouped WHERE legal)
"""


#: A word's tag as a letter, by its length modulo 6: a capital begins a span, its small letter goes on with it, o is outside.
LETTERS = "AaBboo"
TAG_OF_LETTER = {"A": "B-object", "a": "I-object", "B": "B-property", "b": "I-property", "o": "O"}
LEGAL, ILLEGAL = "Aa*|Bb*", "(?<![Aa])a+|(?<![Bb])b+"  # spans, and islands that nothing legal precedes


def tagged_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, line, words, letters, signs) of the lines with words: each word's letter, and all of them as one text.

    What concerns a line alone stays in its row, so that nothing of it is shuffled; spans are found by patterns in `signs`, so
    that a word costs one small step, whatever its tag.
    """
    rows = lines(spark, sf_dir).where(F.trim("content") != "").select("doc_id", "line", *more, tokens_of(F.col("content")).alias("words"))
    return signed(rows, F.transform("words", lambda w: letter_of(F.length(w))))


def letter_of(length: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), length % 6)


def signed(rows: DataFrame, letters: Column, suffix: str = "") -> DataFrame:
    """Adds the words' letters and, as one text, signs."""
    return rows.withColumn(f"letters{suffix}", letters).withColumn(f"signs{suffix}", F.array_join(f"letters{suffix}", ""))


def span_starts(suffix: str = "") -> Column:
    """Where the spans of `letters` begin, in order: each capital begins one."""
    return F.array_compact(F.transform(f"letters{suffix}", lambda x, i: F.when(x.isin("A", "B"), i)))


def with_spans(tagged: DataFrame, suffix: str = "") -> DataFrame:
    """Adds spans (start, end inclusive, type) in order, those of the islands that begin legally, in place of letters.

    What is read from arrays is never filtered by, since a filter on an array is moved below the steps that make it, which then
    run twice; exploded with nulls for the same reason, as a plain explode filters by size first; and no lambda looks into
    another array, since that might be made again for every element.
    """
    span = lambda s, p: F.struct(s.alias("start"), (s + F.length(p) - 1).alias("end"), F.when(p.startswith("A"), "object").otherwise("property").alias("type"))
    return tagged.withColumn(f"spans{suffix}", F.zip_with(span_starts(suffix), F.regexp_extract_all(f"signs{suffix}", F.lit(LEGAL), F.lit(0)), span)).drop(f"letters{suffix}")


def span_codes(suffix: str = "") -> Column:
    """Spans in order as numbers: twice the place's code, and one more for a property. Numbers take a fraction of the time of structs."""
    code = lambda s, p: place_code(s, s + F.length(p) - 1) * 2 + F.when(p.startswith("A"), 0).otherwise(1)
    return F.zip_with(span_starts(suffix), F.regexp_extract_all(f"signs{suffix}", F.lit(LEGAL), F.lit(0)), code)


def having_spans(held: DataFrame) -> DataFrame:
    """The lines with spans."""
    kept = F.explode_outer(F.filter(F.array(F.struct(*held.columns)), lambda x: F.size(x["spans"]) > 0))
    return held.select(kept.alias("x")).where("x IS NOT NULL").select("x.*")


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive spans of the islands that begin legally: doc_id, line, start, end, type."""
    found = with_spans(tagged_lines(spark, sf_dir)).select("doc_id", "line", F.explode_outer("spans").alias("s")).where("s IS NOT NULL")
    return found.select("doc_id", "line", "s.start", "s.end", "s.type")


def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.col("end") - F.col("start") + 1
    return decoded(spark, sf_dir).groupBy("doc_id", "type").agg(
        F.count(F.lit(1)).alias("n_spans"), F.max(width).alias("longest"), F.sum(F.col("start") * 3 + F.col("end")).alias("places"))


def bio_illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside tags that nothing legal precedes, by type."""
    found = tagged_lines(spark, sf_dir).select(F.explode_outer(F.regexp_extract_all("signs", F.lit(ILLEGAL), F.lit(0))).alias("x")).where("x IS NOT NULL")
    kind = F.when(F.col("x").startswith("a"), "object").otherwise("property")
    return found.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("islands"), F.sum(F.length("x").cast("long")).alias("words"))


def bio_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written back from the decoded spans, against the tags that were there."""
    rows = with_spans(tagged_lines(spark, sf_dir)).withColumn("past", F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"] + 1)))  # where the words after each span begin
    begins = lambda s: F.when(s["type"] == "object", "A").otherwise("B")
    named = lambda s: F.concat(begins(s), F.repeat(F.lower(begins(s)), s["end"] - s["start"]))
    pieces = F.zip_with("spans", F.slice("past", F.lit(1), F.size("spans")), lambda s, p: F.concat(F.repeat(F.lit("o"), s["start"] - p), named(s)))
    again = F.concat(F.array_join(pieces, ""), F.repeat(F.lit("o"), F.length("signs") - F.element_at("past", -1)))
    pairs = F.arrays_zip(F.split("signs", "").alias("tag"), F.split("again", "").alias("again"))
    both = rows.withColumn("again", again).withColumn("pairs", pairs).select(F.explode_outer("pairs").alias("x"))
    counted = both.groupBy("x.tag", "x.again").agg(F.count(F.lit(1)).alias("n"))
    name = F.create_map(*[F.lit(x) for pair in TAG_OF_LETTER.items() for x in pair])
    return counted.select(name[F.col("tag")].alias("tag"), name[F.col("again")].alias("again"), "n")


def span_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of up to MAX_WIDTH words per document, from starts and ends exploded in place."""
    sized = lines(spark, sf_dir).select("doc_id", F.size(tokens_of(F.col("content"))).alias("n"))
    starts = sized.where("n > 0").withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    full = starts.withColumn("end", F.explode(F.sequence("start", F.least(F.col("start") + MAX_WIDTH, F.col("n")) - 1)))
    return full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start") + 1).alias("total_width"))


def token_span_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a line's first two words (or, every fifth line, its first word and an absent one) occur in it."""
    at = lines(spark, sf_dir).select("line", tokens_of(F.col("content")).alias("w")).where(F.size("w") >= 2)
    wanted = F.when(F.col("line") % 5 == 4, F.array(F.get("w", F.lit(0)), F.lit("~absent~"))).otherwise(F.slice("w", 1, 2))
    n = F.size(spans.locate_tokens(F.col("w"), F.col("wanted")))
    status = F.when(n == 0, "out_of_source").when(n > 1, "ambiguous").otherwise("located")
    return at.withColumn("wanted", wanted).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def word_char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open character ranges of words, found from left to right; totals per document."""
    parts = lines(spark, sf_dir).select("doc_id", "line", F.posexplode(F.split("content", " ")).alias("i", "word"))
    before = Window.partitionBy("doc_id", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("s", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).where("word <> ''")
    return placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("s").alias("starts"), F.max(F.col("s") + F.length("word")).alias("last_end"))


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of decoded spans, rebuilt from the words of their line: the most frequent surfaces by type."""
    held = with_spans(tagged_lines(spark, sf_dir).where("doc_id IS NOT NULL"))
    texts = F.transform("spans", lambda s: F.struct(s["type"].alias("type"), spans.span_text(F.col("words"), s["start"], s["end"]).alias("text")))
    named = held.select(F.explode_outer(texts).alias("x")).where("x IS NOT NULL").select("x.type", "x.text")
    return named.groupBy("type", F.lower("text").alias("surface")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def canonical_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share a canonical surface although they are written differently."""
    named = lines(spark, sf_dir).where("content <> ''").select("content", canonical("content").alias("surface"))
    digest = named.groupBy(F.sha2("surface", 256).alias("surface_sha256")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content").alias("n_written"))
    return digest.where("n > 1")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked pieces of each page: the role, its order, its text; and the plain text of the article."""
    pages = read(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<article>(.*?)</article>", 1), "<[^>]*>", "")
    pages = pages.select("page_id", "html", plain.alias("plain"))
    item = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    bold = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<b>([^<]*)</b>"), F.lit(1))
    roles = F.concat(
        F.transform(item, lambda t: F.struct(F.lit("e1").alias("role"), t.alias("mark"))), F.transform(bold, lambda t: F.struct(F.lit("e2").alias("role"), t.alias("mark"))))
    return pages.select("page_id", "plain", F.posexplode(roles).alias("k", "m")).select("page_id", "plain", "k", "m.role", "m.mark")


def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page closes each mark once for each opening, and what the first ones hold."""
    html = F.coalesce("html", F.lit(""))
    opened, closed = F.regexp_count(html, F.lit("<b>")), F.regexp_count(html, F.lit("</b>"))
    status = F.when(opened == 0, "absent").when(opened != closed, "unbalanced").when(opened == 1, "single").otherwise("several")
    return read(spark, sf_dir, "pages").select("page_id", opened.alias("opened"), closed.alias("closed"), status.alias("status"), F.regexp_extract(html, "<b>([^<]*)</b>", 1).alias("first"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks against the words of their page's plain text: exact, contained and overlapping words, by half-open ranges.

    The equi-join is on the page, the range condition on the words that overlap the mark's first place.
    """
    found = marked(spark, sf_dir).where("mark <> ''").withColumn("s", F.expr("locate(mark, plain)") - 1)
    found = found.where("s >= 0").withColumn("e", F.col("s") + F.length("mark"))
    pieces = found.select("page_id", "plain").distinct().select("page_id", F.posexplode(F.split("plain", " ")).alias("i", "word"))
    before = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.withColumn("ws", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).where("word <> ''").withColumn("we", F.col("ws") + F.length("word"))
    touch = (F.col("ws") < F.col("e")) & (F.col("s") < F.col("we"))
    both = found.select("page_id", "k", "role", "mark", "s", "e").join(ranges, "page_id").where(touch)
    exact = (F.col("ws") == F.col("s")) & (F.col("we") == F.col("e"))
    holds = (F.col("ws") <= F.col("s")) & (F.col("e") <= F.col("we"))
    return both.groupBy("page_id", "k", "role").agg(F.count_if(exact).alias("n_exact"), F.count_if(holds & ~exact).alias("n_holding"), F.count(F.lit(1)).alias("n_touching"))


def marker_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one exact word wins; else exactly one word that contains the mark; else the mark is unresolved."""
    choice = F.when(F.col("n_exact") == 1, "exact").when((F.col("n_exact") == 0) & (F.col("n_holding") == 1), "contained").otherwise("unresolved")
    return aligned(spark, sf_dir).withColumn("choice", choice)


def alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("choice") != "unresolved", "none").when(F.col("n_touching") > 1, "several_words").when(F.col("n_touching") == 1, "one_word").otherwise("no_word")
    return marker_span_alignment(spark, sf_dir).groupBy("role", "choice", issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def place_code(start: Column, end: Column) -> Column:
    """A place as one number, for sets of places: sets of numbers are hashed, those of structs compared pair by pair."""
    return F.shiftleft(start.cast("long"), 32) + end


def fold(doc_id: Column) -> Column:
    return F.when(doc_id % 10 < 7, "train").when(doc_id % 10 == 7, "development").otherwise("test")


FOLD = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'development' ELSE 'test' END"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the sorted distinct span types, joined by a pipe; how many documents of a split have each."""
    types = decoded(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("stratum"))
    return types.groupBy(fold(F.col("doc_id")).alias("split"), "stratum").agg(F.count(F.lit(1)).alias("n"))


def split_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("split", fold(F.col("doc_id")))
    docs.createOrReplaceTempView("spanloom_split_docs")
    return spark.sql(
        "SELECT split, lang, source, count(*) AS n, sum(n_chars) AS chars FROM spanloom_split_docs GROUP BY GROUPING SETS ((split), (split, lang), (split, source))"
    )


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = fold(F.col("doc_id"))
    return read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(split == s).alias(s) for s in ("train", "development", "test")])


def partition_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in more than one split."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("text_sha256"), fold(F.col("doc_id")).alias("split"))
    held = docs.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"))
    return held.where(F.col("splits").contains("|"))


def split_overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjointness and coverage of two id sets: sizes of both differences and of the intersection."""
    docs = read(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("d", F.lit(1))
    labelled = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    both = docs.join(labelled, "doc_id", "full")
    return both.agg(
        F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("both"), F.count_if(F.col("l").isNull()).alias("only_documents"),
        F.count_if(F.col("d").isNull()).alias("only_labels"))


def metadata_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document id and country from a metadata literal; UK wins over Finnish, neither is an error."""
    token = F.when(F.col("doc_id") % 3 == 0, "UK").when(F.col("doc_id") % 3 == 1, "Finnish").otherwise("Other")
    literal = F.concat(F.lit("{'ID': '"), F.col("doc_id"), F.lit("_"), token, F.lit("_"), "source", F.lit("'}"))
    parsed = read(spark, sf_dir, "documents").select(F.regexp_extract(literal, "'ID': '([^']*)'", 1).alias("id"))
    parts = F.split("id", "_")
    country = F.when(F.array_contains(parts, "UK"), "UK").when(F.array_contains(parts, "Finnish"), "Finland").otherwise("error")
    return parsed.groupBy(country.alias("country")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def tab_id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a tab has joined to the row's next fields: the first token must be an id and the rest the row's own fields."""
    docs = read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    digest = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    raw = F.when(F.col("doc_id") % 4 == 1, F.concat_ws("\t", uuid, "lang")).when(F.col("doc_id") % 4 == 2, F.concat_ws("\t", uuid, "lang", "source")).when(F.col("doc_id") % 4 == 3, F.concat_ws("\t", uuid, F.lit("other"))).otherwise(uuid)
    parts = F.split(F.col("raw"), "\t")
    rest = F.slice(parts, 2, 9)
    status = (
        F.when(~spans.is_uuid(F.get(parts, F.lit(0))), "bad_id")
        .when(F.size(rest) == 0, "intact")
        .when(rest == F.slice(F.array("lang", "source"), 1, F.size(rest)), "repaired")
        .otherwise("rejected")
    )
    ledger = docs.withColumn("raw", raw).select(status.alias("status"), F.sha2("raw", 256).alias("before"), F.sha2(F.get(parts, F.lit(0)), 256).alias("after"))
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("after")).alias("n_changed"), F.min("after").alias("first_hash"))


def identifier_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many urls, sources and hashes pass the id, run-id and local-url predicates."""
    pages = read(spark, sf_dir, "pages").select(F.md5("url").alias("h"), "url", F.concat(F.lit("run-"), "page_id").alias("run"))
    local = F.when(F.length("url") % 2 == 0, F.lit("http://localhost:11434")).otherwise(F.col("url"))
    return pages.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("h").rlike("^[0-9a-f]{32}$")).alias("n_hashes"), F.count_if(spans.is_uuid(F.col("h"))).alias("n_uuids"),
        F.count_if(spans.is_run_id(F.col("run"))).alias("n_run_ids"), F.count_if(spans.is_local_url(local)).alias("n_local"))


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-by-row comparison of a partition file with the authoritative table: differing values per field."""
    truth = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    part = truth.where("doc_id % 10 < 7").select(
        F.col("doc_id"), F.when(F.col("doc_id") % 17 == 3, "xx").otherwise(F.col("lang")).alias("p_lang"), F.col("source").alias("p_source"),
        (F.col("n_chars") + F.when(F.col("doc_id") % 19 == 5, 1).otherwise(0)).alias("p_chars"))
    both = part.join(truth, "doc_id")
    differ = [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(n) for a, b, n in (("lang", "p_lang", "lang"), ("source", "p_source", "source"), ("n_chars", "p_chars", "n_chars"))]
    return both.agg(F.count(F.lit(1)).alias("n"), *differ)


QUERIES = {
    f.__name__: f
    for f in (
        bio_decode, bio_illegal, bio_encode, span_enumeration, token_span_locate, word_char_offsets, source_text, canonical_surface, marker_parse,
        marker_span_alignment, alignment_audit, strata, split_distributions, label_counts, partition_leakage, split_overlap_audit, metadata_identity,
        tab_id_repair, identifier_predicates, field_diff,
    )
}

ALIGNED = """
arts AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g') AS plain FROM pages),
roles AS (
  SELECT page_id, plain, list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda t: {'role': 'e1', 'mark': t})
    || list_transform(regexp_extract_all(html, '<b>([^<]*)</b>', 1), lambda t: {'role': 'e2', 'mark': t}) AS r FROM arts),
marks AS (SELECT page_id, plain, unnest(range(0, len(r))) AS k, unnest(r) AS m FROM roles),
found AS (
  SELECT page_id, k, m.role AS role, m.mark AS mark, strpos(plain, m.mark) - 1 AS s, strpos(plain, m.mark) - 1 + length(m.mark) AS e
  FROM marks WHERE m.mark <> '' AND strpos(plain, m.mark) > 0),
parts AS (SELECT page_id, unnest(string_split(plain, ' ')) AS word, unnest(range(0, len(string_split(plain, ' ')))) AS i FROM arts),
ranges AS (
  SELECT * FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM parts) WHERE word <> ''),
counted AS (
  SELECT f.page_id, k, role, count(*) FILTER (WHERE ws = s AND ws + length(word) = e) AS n_exact,
    count(*) FILTER (WHERE ws <= s AND e <= ws + length(word) AND NOT (ws = s AND ws + length(word) = e)) AS n_holding, count(*) AS n_touching
  FROM found f JOIN ranges r ON f.page_id = r.page_id AND ws < e AND s < ws + length(word) GROUP BY ALL),
chosen AS (SELECT *, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_exact = 0 AND n_holding = 1 THEN 'contained' ELSE 'unresolved' END AS choice FROM counted)
"""

ORACLES = {
    "bio_decode": f"""WITH {WORDS} SELECT doc_id, type, count(*) AS n_spans, max("end" - start + 1) AS longest, sum(start * 3 + "end")::bigint AS places FROM spans GROUP BY ALL""",
    "bio_illegal": f"""WITH {WORDS} SELECT type, count(*) AS islands, sum("end" - start + 1)::bigint AS words FROM grouped WHERE NOT legal GROUP BY type""",
    "bio_encode": f"""WITH {WORDS}, spread AS (SELECT doc_id, line, unnest(range(start, "end" + 1)) AS i, start, type FROM spans)
SELECT tag, coalesce(CASE WHEN s.i = start THEN 'B-' ELSE 'I-' END || type, 'O') AS again, count(*) AS n
FROM tagged t LEFT JOIN spread s ON t.doc_id = s.doc_id AND t.line = s.line AND t.i = s.i GROUP BY ALL""",
    "span_enumeration": f"""WITH {WORDS}, s AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w))) AS start FROM tokens),
f AS (SELECT doc_id, start, unnest(range(start, least(start + {MAX_WIDTH}, n))) AS e FROM s) SELECT doc_id, count(*) AS n_spans, sum(e - start + 1)::bigint AS total_width FROM f GROUP BY doc_id""",
    "token_span_locate": f"""WITH {WORDS}, q AS (SELECT w, CASE WHEN line % 5 = 4 THEN [w[1], '~absent~'] ELSE w[1:2] END AS wanted FROM tokens WHERE len(w) >= 2),
c AS (SELECT len(list_filter(range(1, len(w)), lambda i: w[i:i+1] = wanted)) AS n FROM q)
SELECT CASE WHEN n = 0 THEN 'out_of_source' WHEN n > 1 THEN 'ambiguous' ELSE 'located' END AS status, count(*) AS n FROM c GROUP BY 1""",
    "word_char_offsets": """WITH p AS (SELECT doc_id, line, unnest(string_split(content, ' ')) AS word, unnest(range(0, len(string_split(content, ' ')))) AS i FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
SELECT doc_id, count(*) AS n_words, sum(s)::bigint AS starts, max(s + length(word))::bigint AS last_end FROM s WHERE word <> '' GROUP BY doc_id""",
    "source_text": f"""WITH {WORDS} SELECT type, lower(array_to_string(w[start + 1:"end" + 1], ' ')) AS surface, count(*) AS n
FROM spans JOIN tokens USING (doc_id, line) GROUP BY ALL HAVING count(*) >= 5""",
    # what normalisation and case folding do to the letters of these texts
    "canonical_surface": f"""WITH {WORDS}, c AS (SELECT content, sha256(regexp_replace(replace(lower(content), 'ß', 'ss'), '\\s', '', 'g')) AS surface_sha256 FROM split_lines WHERE content <> '')
SELECT surface_sha256, count(*) AS n, count(DISTINCT content) AS n_written FROM c GROUP BY surface_sha256 HAVING count(*) > 1""",
    "marker_parse": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, len(regexp_extract_all(coalesce(html, ''), '<b>')) AS opened, len(regexp_extract_all(coalesce(html, ''), '</b>')) AS closed FROM pages)
SELECT page_id, opened, closed, CASE WHEN opened = 0 THEN 'absent' WHEN opened <> closed THEN 'unbalanced' WHEN opened = 1 THEN 'single' ELSE 'several' END AS status,
 regexp_extract(html, '<b>([^<]*)</b>', 1) AS first FROM p""",
    "marker_span_alignment": f"WITH {ALIGNED} SELECT * FROM chosen",
    "alignment_audit": f"""WITH {ALIGNED} SELECT role, choice, CASE WHEN choice <> 'unresolved' THEN 'none' WHEN n_touching > 1 THEN 'several_words' WHEN n_touching = 1 THEN 'one_word' ELSE 'no_word' END AS issue,
 count(*) AS n, count(DISTINCT page_id) AS pages FROM chosen GROUP BY ALL""",
    "strata": f"""WITH {WORDS}, t AS (SELECT doc_id, string_agg(DISTINCT type, '|' ORDER BY type) AS stratum FROM spans GROUP BY doc_id) SELECT {FOLD} AS split, stratum, count(*) AS n FROM t GROUP BY ALL""",
    "split_distributions": f"""WITH d AS (SELECT *, {FOLD} AS split FROM documents)
SELECT split, lang, source, count(*) AS n, sum(n_chars)::bigint AS chars FROM d GROUP BY GROUPING SETS ((split), (split, lang), (split, source))""",
    "label_counts": f"""SELECT quality, toxic, count(*) AS "all", count(*) FILTER (WHERE {FOLD} = 'train') AS train, count(*) FILTER (WHERE {FOLD} = 'development') AS development,
 count(*) FILTER (WHERE {FOLD} = 'test') AS test FROM labels GROUP BY quality, toxic""",
    "partition_leakage": f"""WITH d AS (SELECT sha256(text) AS text_sha256, {FOLD} AS split FROM documents WHERE text IS NOT NULL)
SELECT text_sha256, count(*) AS n, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM d GROUP BY text_sha256 HAVING count(DISTINCT split) > 1""",
    "split_overlap_audit": """SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS "both", count(*) FILTER (WHERE l.doc_id IS NULL) AS only_documents,
 count(*) FILTER (WHERE d.doc_id IS NULL) AS only_labels FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "metadata_identity": """WITH p AS (SELECT regexp_extract(concat('{''ID'': ''', doc_id, '_', CASE WHEN doc_id % 3 = 0 THEN 'UK' WHEN doc_id % 3 = 1 THEN 'Finnish' ELSE 'Other' END, '_', source, '''}'), '''ID'': ''([^'']*)''', 1) AS id FROM documents)
SELECT CASE WHEN list_contains(string_split(id, '_'), 'UK') THEN 'UK' WHEN list_contains(string_split(id, '_'), 'Finnish') THEN 'Finland' ELSE 'error' END AS country, count(*) AS n, count(DISTINCT id) AS n_ids FROM p GROUP BY 1""",
    "tab_id_repair": """WITH u AS (SELECT *, md5(doc_id::varchar) AS h FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
i AS (SELECT *, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS id FROM u),
r AS (SELECT *, CASE doc_id % 4 WHEN 1 THEN concat_ws(chr(9), id, lang) WHEN 2 THEN concat_ws(chr(9), id, lang, source) WHEN 3 THEN concat_ws(chr(9), id, 'other') ELSE id END AS raw FROM i),
p AS (SELECT *, string_split(raw, chr(9)) AS parts FROM r)
SELECT CASE WHEN NOT regexp_matches(parts[1], '^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$') THEN 'bad_id' WHEN len(parts) = 1 THEN 'intact'
 WHEN parts[2:] = [lang, source][1:len(parts) - 1] THEN 'repaired' ELSE 'rejected' END AS status,
 count(*) AS n, count(*) FILTER (WHERE raw <> parts[1]) AS n_changed, min(sha256(parts[1])) AS first_hash FROM p GROUP BY 1""",
    "identifier_predicates": r"""SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(md5(url), '^[0-9a-f]{32}$')) AS n_hashes,
 count(*) FILTER (WHERE regexp_matches(md5(url), '^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$')) AS n_uuids, count(*) FILTER (WHERE regexp_matches('run-' || page_id, '^[a-z0-9][a-z0-9-]{2,63}$')) AS n_run_ids,
 count(*) FILTER (WHERE regexp_matches(CASE WHEN length(url) % 2 = 0 THEN 'http://localhost:11434' ELSE url END, '^https?://(localhost|127[.]0[.]0[.]1)(:[0-9]{1,5})?/?$')) AS n_local FROM pages""",
    "field_diff": """WITH part AS (SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'xx' ELSE lang END AS p_lang, source AS p_source, n_chars + CASE WHEN doc_id % 19 = 5 THEN 1 ELSE 0 END AS p_chars FROM documents WHERE doc_id % 10 < 7)
SELECT count(*) AS n, count(*) FILTER (WHERE lang IS DISTINCT FROM p_lang) AS lang, count(*) FILTER (WHERE source IS DISTINCT FROM p_source) AS source,
 count(*) FILTER (WHERE n_chars IS DISTINCT FROM p_chars) AS n_chars FROM part JOIN documents USING (doc_id)""",
}
