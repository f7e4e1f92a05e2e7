"""Documents written as ZIP archives and scanned again, with their identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import slots
from spanloom.plans.scoring import read
from spanloom.sources import archives, files


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of the members: each document as <lang>/<id>.txt, and those of the label `toxic` once more under copies/."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    name = F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt"))
    marked = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rows = docs.select(name.alias("member"), "content").unionByName(slots.passing(docs, marked, "doc_id").join(marked, "doc_id").select(F.concat(F.lit("copies/"), name).alias("member"), "content"))
    path = files.scratch(spark)
    archives.write_archives(rows, path)
    return archives.identities(archives.whole_members(spark, path))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("member", "bytes", "md5", "sha256")


def archive_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents looked for by path suffix; the size asked for is in characters, so that other alphabets differ."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    wanted = read(spark, sf_dir, "labels").select("doc_id").distinct().join(docs, "doc_id", "left")
    return archives.located(packed(spark, sf_dir), wanted.select(F.concat("doc_id", F.lit(".txt")).alias("suffix"), "bytes", "sha256"))


QUERIES = {"archive_members": archive_members, "archive_identity": archive_identity}

PACKED = """
d AS (SELECT doc_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' AS member, coalesce(text, '') AS content FROM documents),
members AS (SELECT doc_id, member, content FROM d UNION ALL SELECT doc_id, 'copies/' || member, content FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
found AS (SELECT doc_id, member, strlen(content) AS bytes, md5(content) AS md5, sha256(content) AS sha256 FROM members)
"""

ORACLES = {
    "archive_members": f"WITH {PACKED} SELECT member, bytes, md5, sha256 FROM found",
    "archive_identity": f"""WITH {PACKED}, w AS (SELECT DISTINCT doc_id FROM labels),
m AS (SELECT w.doc_id || '.txt' AS suffix, count(member) AS n_found, min(member) AS member, min(bytes) AS bytes, min(n_chars) AS asked FROM w LEFT JOIN found USING (doc_id) LEFT JOIN documents USING (doc_id) GROUP BY w.doc_id)
SELECT suffix, n_found, CASE WHEN n_found = 1 THEN member END AS member,
 CASE WHEN n_found = 0 THEN 'missing' WHEN n_found > 1 THEN 'repeated' WHEN bytes IS DISTINCT FROM asked THEN 'bytes' END AS problem FROM m""",
}
