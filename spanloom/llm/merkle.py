"""WARC fixity audit with Merkle trees, in DataFrame functions alone.

Pages become WARC response records (header block, payload, two line ends). The manifest is the primary's records in the order
of (id, digest), with their ordinals and byte offsets from a two-pass prefix sum over range partitions. Every `LEAF` records
of the manifest are a leaf range; the first key of each is the border by which any replica is cut.

Each replica builds a tree of its own from its own records. A leaf range hashes, in order, each record's offset from where the
range begins, its length and its SHA-256; a node hashes, in order, each child's number, its offset from where the node begins,
its length and its hash. Offsets are within the range, so a lost record changes its range and the nodes above it, and none
beside it.

Audit: the roots of two replicas are compared; from the top, only the children of nodes that differ are joined and compared
on the next level, down to the leaf ranges. Only records of ranges that differ are ever joined: of those, equal (id, digest)
are ok, what is left is paired by id as corrupt, and the rest is missing or extra. All other records are ok because a node
above them agrees.

A replica may have any number of records between two keys of the manifest: a range with more or fewer records than the
primary's differs by its count, so no task gathers it.

Defined cases: null urls and payloads are empty; a null id comes last, and such records are told apart by their digests
alone (missing or extra, never corrupt); rows that repeat an id are paired in the order of their digests after equal ones
are set aside; very long payloads are hashed whole; an empty table has no tree and no findings but extras; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

FANOUT = 16
LEAF = 64


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """Bytes of a response record."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    return F.concat(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
            F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
            F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
        ).cast("binary"),
        body,
        F.lit("\r\n\r\n").cast("binary"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """record_id, length, digest: what a replica's index holds."""
    record = warc_record(F.col(id_col), F.col(url_col), F.col(payload_col))
    return written(
        pages.select(F.col(id_col).alias("record_id"), record.alias("record")).select(
            "record_id", F.octet_length("record").cast("long").alias("length"), F.unhex(F.sha2("record", 256)).alias("digest")
        )
    )


def in_order() -> list[Column]:
    return [F.col("record_id").asc_nulls_last(), F.col("digest").asc()]


def manifest(primary: DataFrame) -> DataFrame:
    """The records with their ordinal and offset: totals of range partitions, then sums within them."""
    ordered = written(primary.repartitionByRange(*in_order()).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("b0"))
    within = Window.partitionBy("part").orderBy(*in_order())
    return (
        ordered.withColumn("i", F.row_number().over(within) - 1)
        .withColumn("ending", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "part")  # one row per partition
        .select("record_id", "length", "digest", (F.col("n0") + F.col("i")).alias("ordinal"), (F.col("b0") + F.col("ending") - F.col("length")).alias("offset"))
    )


def ranged(replica: DataFrame, listed: DataFrame, leaf: int) -> DataFrame:
    """A replica's records with the leaf range that each lies in: the last border at or before its key, found by sorting both together."""
    borders = listed.where(F.col("ordinal") % leaf == 0).select("record_id", F.lit(None).cast("long").alias("length"), "digest", F.floor(F.col("ordinal") / leaf).alias("node"))
    rows = replica.select("record_id", "length", "digest", F.lit(None).cast("long").alias("node"))
    both = written(rows.unionByName(borders).repartitionByRange(*in_order()).withColumn("part", F.spark_partition_id()))
    # a border stands before the records that equal it
    within = Window.partitionBy("part").orderBy(*in_order(), F.col("node").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    # partitions that begin inside a range carry on from the borders before them; what comes before all borders is in the first range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("part").agg(F.max("node").alias("last")).select("part", F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("carried"))
    return (
        both.withColumn("at", F.last("node", ignorenulls=True).over(within))
        .where("length IS NOT NULL")
        .join(F.broadcast(carried), "part")  # one row per partition
        .select(F.coalesce("at", "carried").alias("node"), "record_id", "length", "digest")
    )


def chained(parts: Column) -> Column:
    """Hash of an array of (k, length, hash) structs in order, each with its offset from where the array begins."""
    told = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda acc, x: F.struct((acc["at"] + x["length"]).alias("at"), F.concat_ws(";", acc["text"], F.concat_ws(":", x["k"], acc["at"], x["length"], x["hash"])).alias("text")),
    )
    return F.unhex(F.sha2(told["text"], 256))


def leaves(rows: DataFrame, leaf: int) -> DataFrame:
    """(node, n, bytes, digest) of each leaf range that has records; one with too many to gather has the hash of its count."""
    totals = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    key = F.struct(F.col("record_id").isNull().alias("none"), "record_id", F.hex("digest").alias("hash"), "length", F.lit("").alias("k"))
    few = rows.join(totals.where(F.col("n") <= leaf).select("node"), "node", "left_semi")
    hashed = few.groupBy("node").agg(chained(F.array_sort(F.collect_list(key))).alias("digest"))
    many = F.unhex(F.sha2(F.concat(F.lit("count:"), F.col("n").cast("string")), 256))
    return totals.join(hashed, "node", "left").select("node", "n", "bytes", F.coalesce("digest", many).alias("digest"))


def tree(rows: DataFrame, ranges: int, leaf: int = LEAF, fanout: int = FANOUT) -> list[DataFrame]:
    """(node, n, bytes, digest) by level, from the leaf ranges to the root, of one replica's records by leaf range."""
    out = [written(leaves(rows, leaf))]
    while ranges > 1:
        child = F.struct(F.col("node").alias("k"), F.col("bytes").alias("length"), F.hex("digest").alias("hash"))
        upper = out[-1].groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), chained(F.array_sort(F.collect_list(child))).alias("digest")
        )
        out.append(written(upper))
        ranges = -(-ranges // fanout)
    return out


def differing(mine: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """The leaf ranges that differ, found from the roots down: a level joins only children of nodes that differ."""
    suspects = None
    for ours, others in zip(reversed(mine), reversed(theirs), strict=True):
        ours, others = ours.select("node", "digest"), others.select("node", F.col("digest").alias("copy"))
        if suspects is not None:
            below = suspects.select(F.explode(F.sequence(F.col("node") * fanout, F.col("node") * fanout + fanout - 1)).alias("node"))
            ours, others = ours.join(below, "node"), others.join(below, "node")
        suspects = written(ours.join(others, "node", "full").where("NOT digest <=> copy").select("node"))
    return suspects


def paired(held: DataFrame, copies: DataFrame) -> DataFrame:
    """Records of ranges that differ, matched: ordinal, offset, record_id, length, digest, copy, verdict."""
    again = Window.partitionBy("record_id", "digest")
    a = held.withColumn("k", F.row_number().over(again.orderBy("ordinal")))
    b = copies.select("record_id", F.col("digest").alias("copy")).withColumn("k", F.row_number().over(Window.partitionBy("record_id", "copy").orderBy("copy")))
    b = b.select(F.col("record_id").alias("r_id"), "copy", F.col("k").alias("r_k"))
    same = F.col("record_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("copy")) & (F.col("k") == F.col("r_k"))
    met = written(a.join(b, same, "full"))
    fine = met.where("ordinal IS NOT NULL AND r_k IS NOT NULL")
    # of what is left, records of one id are paired in the order of their digests; a null id pairs with nothing
    lost = met.where("r_k IS NULL").withColumn("nth", F.row_number().over(Window.partitionBy("record_id", "salt").orderBy("digest", "k")))
    strange = met.where("ordinal IS NULL").select("r_id", "copy", "r_k", F.when(F.col("r_id").isNull(), F.xxhash64("copy")).otherwise(0).alias("r_salt"))
    strange = strange.withColumn("r_nth", F.row_number().over(Window.partitionBy("r_id", "r_salt").orderBy("copy", "r_k")))
    rest = lost.drop("r_id", "copy", "r_k").join(strange, (F.col("record_id") == F.col("r_id")) & (F.col("nth") == F.col("r_nth")), "full")
    verdict = F.when(F.col("ordinal").isNull(), "extra").when(F.col("r_nth").isNull(), "missing").otherwise("corrupt")
    columns = ["ordinal", "offset", F.coalesce("record_id", "r_id").alias("record_id"), "length", "digest", "copy"]
    return fine.select(*columns, F.lit("ok").alias("verdict")).unionByName(rest.select(*columns, verdict.alias("verdict")))


def audit(primary: DataFrame, replica: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """One row per record of either: record_id, ordinal, offset, length, digest, copy, verdict (ok, corrupt, missing, extra).

    Both frames are as `records` returns them.
    """
    listed = written(manifest(primary)).withColumn("node", F.floor(F.col("ordinal") / leaf))
    ranges = -(-listed.count() // leaf)
    theirs = written(ranged(replica, listed, leaf))
    suspects = differing(tree(listed, ranges, leaf, fanout), tree(theirs, ranges, leaf, fanout), fanout)
    # a null id is one of many: its records are dealt by their digests
    salt = F.when(F.col("record_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("salt")
    held = listed.join(suspects, "node", "left_semi").select("ordinal", "offset", "record_id", "length", "digest", salt)
    judged = paired(held, theirs.join(suspects, "node", "left_semi"))
    agreed = listed.join(suspects, "node", "left_anti").select("ordinal", "offset", "record_id", "length", "digest", F.col("digest").alias("copy"), F.lit("ok").alias("verdict"))
    return agreed.unionByName(judged).select("record_id", "ordinal", "offset", "length", "digest", "copy", "verdict")
