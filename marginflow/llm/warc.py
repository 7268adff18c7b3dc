"""WARC archives: writing records, and reading them back by verifying the chain of record boundaries.

Archives are written by Spark's text writer, one file per task, a record per row: the writer's commit protocol keeps
them whole when executors are lost. Readers split at the magic line ``WARC/1.0``, wherever it stands, also inside
payloads; so every piece is only a candidate. A candidate's header tells where its successor must begin. From the first
byte of each file, only the candidates that this chain reaches are records. Tasks follow the chain inside their own
block of the file and emit where each candidate leaves it; pointer jumping over blocks does the rest, so a file of any
length needs rounds in the logarithm of its blocks.

Nulls: a null payload is empty; a null page_id or URL gives an empty header field and comes back as null. Line breaks
in URLs are escaped, and so is the text of the magic line. Repeated page_ids are separate records; of equal payloads, all rows with the largest page_id are
responses. Rows with equal payloads and only null page_ids are all responses. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import scratch_dir
from .common import staged

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads under so many bytes are never stored by reference.
MIN_REVISIT = 1000
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _safe(c: Column) -> Column:
    """No line breaks, and no magic line that the header's own line break could complete."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A"), F.lit(MAGIC.strip()), F.lit("WARC%2F1.0"))


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds payload_digest (SHA-1), record_type and refers_to: large equal payloads are stored once, with the largest page_id.

    Only groups of several pages are joined back; their table has one row per group, combined before the shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("payload_digest", F.sha1(payload)).withColumn("_equal", F.when(F.octet_length(payload) >= min_revisit, F.sha2(payload, 256)))
    groups = rows.where("_equal is not null").groupBy("_equal").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").select("_equal", "_first")
    # Pages without a twin would crowd on the null key of a join; they are told apart by their own key instead.
    keyed = rows.withColumn("_equal", F.coalesce("_equal", F.concat(F.lit("small "), F.col("payload_digest"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    revisit = F.col("_first").isNotNull() & F.coalesce(F.col("page_id") != F.col("_first"), F.lit(True))
    typed = keyed.join(staged(groups), "_equal", "left")
    return typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_equal", "_first")


def record(row_type: Column, written_at: dt.datetime) -> Column:
    """The text of a record with its magic line, up to the blank lines that end it."""
    revisit = row_type == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.coalesce(F.col("html"), F.lit(""))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {IDENTICAL}\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise("")
    return F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), row_type, F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"WARC-Date: {written_at:%Y-%m-%dT%H:%M:%SZ}\r\nWARC-Target-URI: "), _safe(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"), refers, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, written_at: dt.datetime | None = None) -> int:
    """One record per row of (page_id, url, html), dated ``written_at`` or now; the files hold nothing but records. Returns their number."""
    typed = with_record_types(pages)
    seen = Observation()
    typed.select(record(F.col("record_type"), written_at or dt.datetime.now(dt.timezone.utc)).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", END).text(path)
    return seen.get["n"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at every magic line: file, block, number inside the task and the bytes between two magics."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    meta = F.col("_metadata")
    return raw.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("file_size"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("piece")
    )


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One staged row per piece: where it begins, what its header says, where its successor must begin, and what it holds.

    Every byte of a file is in one piece, so a piece begins where the pieces before it end: sums inside a block, and
    the blocks' totals. ``at`` is the offset of the piece's magic line.
    """
    piece = F.col("piece")
    # Header fields are ASCII; a header's end is searched in Latin-1, where bytes and characters agree.
    latin = F.decode(piece, "ISO-8859-1")
    header = F.instr(latin, END)
    head = F.when(header > 0, F.substring(latin, F.lit(1), header)).otherwise("")
    length = F.expr("try_cast(_length as bigint)")
    parsed = (
        _pieces(spark, path)
        .withColumn("bytes", F.octet_length("piece").cast("long"))
        .withColumn("_header", header)
        .withColumn("_head", head)
        .withColumn("_length", _field(F.col("_head"), "Content-Length"))
        .withColumn("content", length)
        .withColumn("body", F.when(F.col("content").isNotNull(), F.col("_header") + len(END) - 1))
        .withColumn("_payload", F.when(F.col("body") + F.col("content") <= F.col("bytes"), F.substring("piece", F.col("body") + len(HTTP) + 1, F.greatest(F.lit(0), F.col("content") - len(HTTP)))))
        .select(
            "file", "block", "file_size", "k", "bytes", "content", "body", _field(F.col("_head"), "WARC-Type").alias("record_type"), _field(F.col("_head"), "WARC-Record-ID").alias("id"),
            _field(F.col("_head"), "WARC-Refers-To").alias("refers"), _field(F.col("_head"), "WARC-Payload-Digest").alias("digest"),
            F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha1("_payload").alias("payload_sha1"),
        )
    )
    placed = _placed(staged(parsed))
    return staged(placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("body") + F.col("content") + len(END)))


def _placed(found: DataFrame) -> DataFrame:
    """Adds to the staged pieces of one scan where each begins in its file; blocks and numbers differ between scans, offsets do not."""
    size = F.col("bytes") + len(MAGIC)
    totals = found.groupBy("file", "block").agg(F.sum(size).alias("_total"))
    blocks = totals.select("file", "block", F.coalesce(F.sum("_total").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("file", "block").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("_inside", inside).join(blocks, ["file", "block"])
    at = F.col("_before") + F.col("_inside") - len(MAGIC)
    return placed.withColumn("at", at).where(at >= 0).drop("_inside", "_before")


LEAVES = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("leaves", T.LongType())])


def _leave(frame: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a block leaves the block; -1 where it breaks."""
    frame = frame.sort_values("at", ignore_index=True)
    at, following = frame["at"].to_numpy(np.int64), frame["next"].fillna(-1).to_numpy(np.int64)
    leaves = following.copy()
    place = np.searchsorted(at, following)
    for i in range(len(at) - 1, -1, -1):
        if at[i] < following[i] <= at[-1]:
            leaves[i] = leaves[place[i]] if at[place[i]] == following[i] else -1
    return pd.DataFrame({"file": frame["file"], "block": frame["block"], "at": at, "leaves": leaves})


REACHED = T.StructType([T.StructField("file", T.StringType()), T.StructField("at", T.LongType())])


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that the chain reaches from the block's entry."""
    frame = frame.sort_values("at", ignore_index=True)
    at, following, entry = frame["at"].to_numpy(np.int64), frame["next"].fillna(-1).to_numpy(np.int64), int(frame["entry"].iloc[0])
    out = []
    while len(at) and entry <= at[-1]:
        i = int(np.searchsorted(at, entry))
        if at[i] != entry:
            break
        out.append(entry)
        if following[i] <= entry:
            break
        entry = int(following[i])
    return pd.DataFrame({"file": frame["file"].iloc[: len(out)], "at": np.array(out, np.int64)})


def entries(found: DataFrame) -> DataFrame:
    """The first record of each block on the chain from the file's start: (file, block, entry).

    Edges go from a candidate to the candidate where its chain enters the next block. Each round marks what the marked
    candidates reach and doubles the length of every edge.
    """
    left = staged(found.select("file", "block", "at", "next").groupBy("file", "block").applyInPandas(_leave, LEAVES))
    blocks = left.select("file", "block", F.col("at").alias("leaves"))
    edges = staged(left.join(blocks.withColumnRenamed("block", "_to"), ["file", "leaves"]).select("file", "at", "leaves"))
    marked = staged(left.where("at = 0").select("file", "at"))
    count = marked.count()
    while True:
        reached = marked.join(edges, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        marked = staged(marked.unionByName(reached).distinct())
        now = marked.count()
        if now == count:
            break
        count = now
        hop = edges.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("_on"))
        edges = staged(edges.join(hop, ["file", "leaves"]).select("file", "at", F.col("_on").alias("leaves")))
    return marked.join(left.select("file", "block", "at"), ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))


def read_archives(spark: SparkSession, path: str, written: int | None = None) -> DataFrame:
    """The records of the archives: page_id, record_type, refers_to, digest, payload_bytes, payload_digest of what is stored.

    Fails if they are not as many as were ``written``.
    """
    found = candidates(spark, path)
    chain = found.select("file", "block", "at", "next").join(entries(found), ["file", "block"]).groupBy("file", "block").applyInPandas(_walk, REACHED)
    records = staged(found.join(chain, ["file", "at"]))
    if written is not None and (count := records.count()) != written:
        raise ValueError(f"{count} records found in {path}, {written} written")
    # Payloads that hold the magic line lie in several pieces: these, and only these, are read again and joined.
    broken = records.where("record_type <> '' and payload_bytes is null and content is not null")
    if broken.limit(1).count():
        records = records.join(_mended(spark, path, found, broken), ["file", "at"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).withColumn("payload_sha1", F.coalesce("payload_sha1", "_sha1")).drop("_bytes", "_sha1")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return records.select(
        number(F.col("id")).alias("page_id"), "record_type", number(F.col("refers")).alias("refers_to"), F.regexp_extract("digest", "^sha1:(.*)$", 1).alias("digest"), "payload_bytes", F.col("payload_sha1").alias("stored_digest")
    )


def _mended(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Payloads that lie in several pieces, put together in order; the pieces of their files are staged once.

    Every piece carries the last broken record that begins before it, inside its block from window to window and from
    block to block by the blocks' last ones: one pass over a file's pieces, however many of its payloads are broken.
    """
    own = F.struct(F.col("at").alias("start"), "next", "body", "content")
    starts = broken.select("file", "at", own.alias("_own"))
    inside = found.select("file", "block", "at").join(broken.select("file").distinct(), "file", "left_semi")
    marked = inside.join(starts, ["file", "at"], "left").withColumn("_here", F.last("_own", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("at")))
    by_block = marked.groupBy("file", "block").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("at"))).alias("_last"))
    # A file has few blocks.
    so_far = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = by_block.select("file", "block", F.last("_last", ignorenulls=True).over(so_far).alias("_carried"))
    held = marked.join(carried, ["file", "block"]).withColumn("_of", F.coalesce("_here", "_carried"))
    parts = held.where("at < _of.next").select("file", "at", "_of.start", "_of.body", "_of.content")
    again = _pieces(spark, path).withColumn("bytes", F.octet_length("piece").cast("long")).join(broken.select("file").distinct(), "file", "left_semi")
    text = parts.join(_placed(staged(again)).select("file", "at", "piece"), ["file", "at"])
    whole = text.groupBy("file", "start", "body", "content").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_all"))
    joined = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0))["piece"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["piece"]))
    payload = F.substring(joined, F.col("body") + len(HTTP) + 1, F.greatest(F.lit(0), F.col("content") - len(HTTP)))
    return whole.select("file", F.col("start").alias("at"), payload.alias("_payload")).select("file", "at", F.octet_length("_payload").cast("long").alias("_bytes"), F.sha1("_payload").alias("_sha1"))


def resolved(records: DataFrame) -> DataFrame:
    """payload_bytes and payload_digest of the full payload: a revisit takes its response's."""
    response = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("stored_digest").alias("_digest")).dropDuplicates(["refers_to"])
    revisits = records.where("record_type = 'revisit'").join(response, "refers_to", "left")
    revisits = revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return records.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to").unionByName(revisits)


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns what reading them finds."""
    spark = pages.sparkSession
    path = archive_folder(spark)
    written = write_archives(pages.select("page_id", "url", "html"), path)
    return resolved(read_archives(spark, path, written))

