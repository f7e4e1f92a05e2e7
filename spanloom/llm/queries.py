"""The registered queries of the corpus operators, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import divergence, exact_dedup, fill_middle, merkle, mixing, neighbours, ngram_join, packing, quality, secrets, substring_chain, suffix_dedup, toxicity
from spanloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, n: total + n)
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_substring_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_chain.passages(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with faults at fixed ids: bit rot, lost records, and records that the primary lacks."""
    rot = F.when(F.col("page_id") % 53 == 7, F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    kept = pages.where("page_id IS NULL OR page_id % 211 <> 13").select("page_id", "url", rot.alias("html"))
    strange = pages.where("page_id % 307 = 5").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return kept.unionByName(strange)


def op5_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = merkle.audit(merkle.records(pages), merkle.records(damaged(pages)))
    return found.select(
        F.col("record_id").alias("page_id"), "ordinal", F.col("offset").alias("warc_offset"), F.col("length").alias("record_bytes"),
        F.lower(F.hex("digest")).alias("sha256"), F.lower(F.hex("copy")).alias("replica_sha256"), "verdict",
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), ngram_join.Rule(words=4, least=85))


def tokenizer_files() -> tuple[str, str, str]:
    """Vocabulary, the same vocabulary as ranks, and its split pattern; the files are found where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), *tokenizer_files())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_neighbour_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(documents(spark, sf_dir)).withColumn("output_sha256", F.sha2(F.col("output"), 256))
    back = fill_middle.restore(made)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_substring_chain": op3_substring_chain,
        "op4_toxicity": op4_toxicity,
        "op5_warc_merkle": op5_warc_merkle,
        "op6_ngram_join": op6_ngram_join,
        "op7_packing": op7_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_secret_scan": op10_secret_scan,
        "op11_source_divergence": op11_source_divergence,
        "op12_neighbour_descent": op12_neighbour_descent,
        "op13_fill_middle": op13_fill_middle,
    }


OP1_SQL = """
WITH coded AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS k
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM coded WHERE length(x) >= 100)),
firsts AS (SELECT k, min(doc_id) AS least FROM strings GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM strings JOIN firsts USING (k) WHERE least < doc_id),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM hit),
numbered AS (SELECT doc_id, i, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
gone AS (SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, island),
cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_
  FROM (SELECT doc_id, a, b FROM gone UNION ALL SELECT doc_id, length(x) // 2, NULL FROM coded)),
rest AS (
  SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a, b NULLS LAST) AS kept
  FROM cuts JOIN coded USING (doc_id) GROUP BY doc_id)
SELECT c.doc_id, (length(x) // 2)::bigint AS n_bytes, coalesce(sum(b - a), 0)::bigint AS n_removed, count(b) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM coded c LEFT JOIN gone USING (doc_id) JOIN rest USING (doc_id) GROUP BY c.doc_id, x, kept
"""

OP2_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""

OP5_SQL = r"""
WITH replica AS (
  SELECT page_id, url, CASE WHEN page_id % 53 = 7 THEN '#' || substr(html, 2) ELSE html END AS html
  FROM pages WHERE page_id IS NULL OR page_id % 211 <> 13
  UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 307 = 5),
a AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>',
    chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
    html, chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
b AS (
  SELECT page_id, sha256(concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>',
    chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
    html, chr(13), chr(10), chr(13), chr(10))) AS digest FROM replica),
listed AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS ordinal, strlen(record) AS record_bytes,
         sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS warc_offset, sha256(record) AS sha256
  FROM a)
SELECT coalesce(l.page_id, b.page_id) AS page_id, ordinal, warc_offset::bigint AS warc_offset, record_bytes, sha256, b.digest AS replica_sha256,
       CASE WHEN l.page_id IS NULL THEN 'extra' WHEN b.page_id IS NULL THEN 'missing' WHEN sha256 <> b.digest THEN 'corrupt' ELSE 'ok' END AS verdict
FROM listed l FULL JOIN b ON l.page_id = b.page_id
"""

OP6_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
  FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, n
"""

OP9_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits,
         (('0x' || substr(md5(concat_ws('|', key, '{mixing.SEED}')), 1, 13))::bigint::double + 0.5) / 4503599627370496::double AS u
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
               concat_ws('|', coalesce(doc_id::varchar, ''), md5(coalesce(text, ''))) AS key FROM documents)),
sources AS (
  SELECT source, sum(size)::bigint AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
whole AS (SELECT sum(source_size)::bigint AS words FROM sources),
-- share what is left by weight, stop whoever is above the cap, until none is
rounds AS (
  SELECT 0 AS n, []::varchar[] AS stopped, words::double / (SELECT sum(weight) FROM sources) AS line FROM whole
  UNION ALL
  SELECT n + 1, now, (words - (SELECT coalesce(sum({mixing.MOST} * source_size), 0) FROM sources WHERE list_contains(now, coalesce(source, chr(1)))))::double
                     / (SELECT sum(weight) FROM sources WHERE NOT list_contains(now, coalesce(source, chr(1))))
  FROM (SELECT n, words, stopped, line,
               (SELECT coalesce(list(coalesce(source, chr(1))), []) FROM sources WHERE line * weight > {mixing.MOST} * source_size) AS now
        FROM rounds, whole)
  WHERE len(now) > len(stopped)),
line AS (SELECT line FROM rounds ORDER BY n DESC LIMIT 1),
goals AS (SELECT source, source_size, least(({mixing.MOST} * source_size)::double, line * weight) AS target FROM sources, line),
classes AS (SELECT source, bits, sum(size)::bigint AS words FROM sized GROUP BY source, bits),
-- expected copies: in proportion to the binary digits of the size, up to the cap
slopes AS (
  SELECT c.source, c.bits, (any_value(target) - {mixing.MOST} * coalesce(sum(o.words) FILTER (WHERE o.bits > c.bits), 0)::bigint)
         / (sum(o.bits * o.words) FILTER (WHERE o.bits <= c.bits))::bigint AS slope
  FROM classes c JOIN classes o ON c.source IS NOT DISTINCT FROM o.source JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
  WHERE c.bits > 0 GROUP BY c.source, c.bits),
best AS (SELECT source, arg_max(slope, bits) AS slope FROM slopes WHERE slope * bits <= {mixing.MOST} * (1 + 1e-9) GROUP BY source),
chances AS (
  SELECT c.source, c.bits, words, CASE WHEN c.bits = 0 THEN 0 ELSE least({mixing.MOST}::double, coalesce(slope, {mixing.MOST}) * c.bits) END AS e
  FROM classes c LEFT JOIN best b ON c.source IS NOT DISTINCT FROM b.source),
rest AS (
  SELECT g.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(target) - sum(floor(e) * words) AS left_over
  FROM goals g JOIN chances c ON g.source IS NOT DISTINCT FROM c.source GROUP BY g.source),
placed AS (
  SELECT s.doc_id, s.source, size, u, floor(e)::bigint AS sure,
         CASE WHEN e > floor(e) AND size > 0 THEN (u / (1 - u)) / (u / (1 - u) + (e - floor(e)) / (1 - (e - floor(e)))) END AS v
  FROM sized s JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND s.bits = c.bits),
ranked AS (
  SELECT doc_id, source, size, sure, v, sum(size) OVER (PARTITION BY source ORDER BY v, u, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached
  FROM placed)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN sure + (CASE WHEN v IS NOT NULL AND 2 * reached - size <= 2 * left_over THEN 1 ELSE 0 END) ELSE 0 END * size)::bigint AS taken
FROM ranked r JOIN rest t ON r.source IS NOT DISTINCT FROM t.source
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP10_KINDS = [(rank, kind, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(secrets.PATTERNS)] + [
    (len(secrets.PATTERNS) + i, c.kind, c.pattern, 0, c.window) for i, c in enumerate(secrets.CLASSES)
]
OP10_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
split AS ({" UNION ALL ".join(f"SELECT row, text, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {_quoted(pattern)}) AS h, regexp_extract_all(text, {_quoted(pattern)}, {group}) AS g, string_split_regex(text, {_quoted(pattern)}) AS p FROM texts" for rank, kind, pattern, group, least in OP10_KINDS)}),
placed AS (
  SELECT row, rank, kind, least, h[i] AS hit, length(g[i]) AS n,
         coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM split)),
kept AS (SELECT row, rank, kind, hit, s::bigint AS s, (s + length(hit))::bigint AS e FROM placed WHERE n >= least),
base AS (SELECT row, rank, kind, s, e FROM kept WHERE rank < {len(secrets.PATTERNS)}),
rare AS (
  SELECT row, rank, kind, hit, s FROM kept k
  WHERE ({" OR ".join("(kind = '" + c.kind + "' AND " + " AND ".join(f"regexp_matches(hit, {_quoted(n)})" for n in c.needs) + ")" for c in secrets.CLASSES)})
    AND NOT ({" OR ".join(f"(regexp_matches(hit, {_quoted(a)})" + (f" AND NOT regexp_matches(hit, {_quoted(b)}))" if b else ")") for a, b in secrets.ALLOWED)})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = k.row AND b.s <= k.s AND k.e <= b.e)),
windowed AS (
  SELECT r.row, r.rank, r.kind, s, w, i, string_split(substr(hit, i + 1, w), '') AS c
  FROM (SELECT *, unnest(range(0, length(hit) - w + 1)) AS i FROM rare JOIN (VALUES {", ".join(f"('{c.kind}', {c.window}, {c.bits}::double)" for c in secrets.CLASSES)}) AS t(k2, w, bits) ON k2 = kind) r
  WHERE log2(w) - list_sum(list_transform(list_distinct(string_split(substr(hit, i + 1, w), '')), lambda x: len(list_filter(string_split(substr(hit, i + 1, w), ''), lambda y: y = x)) * log2(len(list_filter(string_split(substr(hit, i + 1, w), ''), lambda y: y = x))))) / w >= bits - 1e-9),
every AS (SELECT row, rank, kind, s, e FROM base UNION ALL SELECT row, rank, kind, min(s + i)::bigint, max(s + i + w)::bigint FROM windowed GROUP BY row, rank, kind, s),
told AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    count(*) FILTER (WHERE rank >= {len(secrets.PATTERNS)}) AS n_entropy, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) AS spans,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank < {len(secrets.PATTERNS)}) AS base FROM every GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)
"""


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
held AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
here AS (SELECT lang, source, sum(n) AS here FROM held GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (coalesce(here, 0) + 2 * v))::hugeint AS p,
         (1 + (1000000000::hugeint * (n_lang + 2)) // (total + 2 * v))::hugeint AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN here USING (lang, source) LEFT JOIN held USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(any_value(value), 0)::bigint AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = h.source GROUP BY ALL),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint FROM shares WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::int AS rank FROM ranks WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH units AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::varchar, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_warc_merkle": OP5_SQL, "op6_ngram_join": OP6_SQL, "op9_mixing": OP9_SQL, "op10_secret_scan": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_fill_middle": OP13_SQL}
