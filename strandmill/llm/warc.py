"""WARC archives: written with revisits of equal payloads, read back by verified chains of record boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, shared_dir

#: What every record starts with; the minor version and a line end follow.
MAGIC = "WARC/1."
VERSION = "1\r\n"
END = "\r\n\r\n"
#: Types of records that hold a payload or stand for one; others (warcinfo, request, metadata) are read over.
PAYLOADS = ("response", "revisit", "resource", "conversion")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 1_000_000) -> None:
    """One record per row into the archives of folder ``path``, by Spark's text writer with the record end as separator.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the largest key becomes a response and the
    others revisits of it; repeated rows of that key are responses each, as are rows without a key whose group has
    none. A null payload is empty. Line ends in an address are escaped. Equal payloads are found by digest with
    partial aggregation; the groups with more than one row are joined back, broadcast while they are few. Columns other
    than the three don't matter, whatever their names; an empty table makes an empty folder.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    groups = materialize(rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("key").alias("first"), F.count("*").alias("n"))
                         .where("n > 1 and first is not null").drop("n"), "warc-groups")
    if groups.count() <= broadcast_rows:
        groups = F.broadcast(groups)
    revisit = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("key")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("address"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
        F.col("http"), F.when(revisit, "").otherwise(F.col("html")))
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    made = rows.join(groups, ["digest", "bytes"], "left").withColumns({"http": http, "address": address})
    made.select(record.alias("value")).write.option("lineSep", END).text(path)


def header(name: str, of: str = "head") -> Column:
    return F.nullif(F.regexp_extract(of, rf"(?im)^{name}:[\x20\t]*([^\r\n]*)", 1), F.lit(""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic, with file, split and place: Spark's text reader finds them."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))


def chain_exits(rows):
    """Adds to each candidate of one split where its chain leaves the split: its last successor outside."""
    rows = rows.sort_values("start")
    leaves: dict[int, int] = {}
    for start, successor in zip(rows["start"][::-1], rows["successor"][::-1]):
        leaves[start] = leaves.get(successor, successor)
    return rows.assign(exit=[leaves[x] for x in rows["start"]])


def chain_members(rows):
    """The candidates of one split that a chain passes through from one of its entries."""
    follow = dict(zip(rows["start"], rows["successor"]))
    kept: set[int] = set()
    for at in rows.loc[rows["entered"], "start"]:
        while at in follow and at not in kept:
            kept.add(at)
            at = follow[at]
    return rows[rows["start"].isin(kept)]


def reachable(candidates: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Candidates (file, split, start, successor) on the chain from the start of their file.

    Inside a split the chains are followed at once. Between splits pointers are jumped: each round lets every entry
    known so far jump, and doubles the length of all jumps, so a file of s splits takes about log2 s rounds.
    """
    names = [f"{c} {t}" for c, t in candidates.dtypes]
    linked = materialize(candidates.groupBy("file", "split").applyInPandas(chain_exits, ", ".join([*names, "exit bigint"])), "warc-exits")
    jump = linked.select("file", "start", F.col("exit").alias("to"))
    entries, known = materialize(linked.where("start = 0").select("file", "start"), "warc-entries"), -1
    for _ in range(max_rounds):
        count = entries.count()
        if count == known:
            break
        known = count
        ahead = entries.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        entries = materialize(entries.union(ahead).distinct(), "warc-entries")
        jump = materialize(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.start")), "left")
                           .select("a.file", "a.start", F.coalesce("b.to", "a.to").alias("to")), "warc-jumps")
    else:
        raise RuntimeError(f"chains did not end within {max_rounds} rounds")
    marked = linked.drop("exit").join(entries.withColumn("entered", F.lit(True)), ["file", "start"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return marked.select(*candidates.columns, "entered").groupBy("file", "split").applyInPandas(chain_members, ", ".join([*names, "entered boolean"])).drop("entered")


def owners(placed: DataFrame, broken: DataFrame) -> DataFrame:
    """``(file, split, at, owner, start)``: the segments inside each broken record, which may begin in an earlier split.

    Within a split the record that was last begun is known by a window over the split; what a split hands on to the
    next ones is one row, so only these rows are in a window over a file.
    """
    marked = placed.join(broken.select("file", "start", F.col("start").alias("owner"), "successor"), ["file", "start"], "left").withColumn("own", F.expr("named_struct('owner', owner, 'upto', successor)"))
    marked = marked.withColumn("own", F.when(F.col("owner").isNotNull(), F.col("own")))
    last = marked.groupBy("file", "split").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("start"))).alias("handed"))
    carried = last.select("file", "split", F.expr("last(handed, true) over (partition by file order by split rows between unbounded preceding and 1 preceding)").alias("before"))
    inside = marked.withColumn("here", F.expr("last(own, true) over (partition by file, split order by start)")).join(carried, ["file", "split"])
    return inside.withColumn("of", F.coalesce("here", "before")).where(F.col("start") < F.col("of.upto")).select("file", "split", "at", F.col("of.owner").alias("owner"), "start")


def read_archives(spark: SparkSession, path: str, types: tuple[str, ...] = PAYLOADS) -> DataFrame:
    """A row per record of ``types`` in the archives under ``path``: headers, payload size and the SHA-1 of the payload read.

    Archives are of WARC 1.0 or 1.1, plain or of gzip members (``.gz``, a file a task). Tasks emit every magic of their
    split as a candidate record with its successor's offset; those not on the chain from the file's start are payload
    text. Offsets follow from the bytes between magics, added up over splits. A payload that holds magics is put
    together again from its segments, a record at a time. An empty folder of archives gives no rows.
    """
    size, step = F.octet_length("value").cast("long"), len(MAGIC)
    first = len(VERSION)  # a record's headers begin behind the version
    scanned = (segments(spark, path).withColumns({"size": size, "head_size": F.expr("cast(position(unhex('0D0A0D0A'), value) - 1 as bigint)")})
               .withColumn("head", F.when(F.expr("substring(value, 1, 3) in (unhex('300D0A'), unhex('310D0A'))"), F.expr(f"string(substring(value, {first + 1}, cast(head_size - {first} as int)))")))
               .withColumn("length", header("Content-Length").try_cast("bigint")).withColumn("whole", F.col("head_size") >= 0))
    block = F.expr("substring(value, cast(head_size + 5 as int), cast(length as int))")
    scanned = scanned.withColumn("block", F.when(F.col("whole") & (F.col("size") >= F.col("head_size") + 4 + F.col("length")), block))
    body = F.expr("substring(block, cast(position(unhex('0D0A0D0A'), block) + 4 as int))")
    meta = materialize(scanned.withColumn("body", body).select(
        "file", "split", "at", "size", "head_size", "length", F.lower(header("WARC-Type")).alias("type"), header("WARC-Record-ID").alias("name"),
        header("WARC-Refers-To").alias("refers"), header("WARC-Payload-Digest").alias("labelled"),
        F.regexp_extract(F.expr("string(substring(block, 1, cast(greatest(position(unhex('0D0A0D0A'), block) - 1, 0) as int)))"), r"(?im)^Content-Length:[\x20\t]*(\d+)", 1).alias("stated"),
        F.octet_length("body").cast("long").alias("body_size"), F.sha1("body").alias("body_digest"), F.col("block").isNotNull().alias("whole")), "warc-segments")

    bases = meta.groupBy("file", "split").agg(F.sum(F.col("size") + step).alias("bytes"))
    bases = bases.withColumn("base", F.expr("coalesce(sum(bytes) over (partition by file order by split rows between unbounded preceding and 1 preceding), 0)")).drop("bytes")
    placed = meta.join(bases, ["file", "split"]).withColumn(
        "start", F.expr(f"base + coalesce(sum(size + {step}) over (partition by file, split order by at rows between unbounded preceding and 1 preceding), 0) - {step}"))
    placed = materialize(placed.drop("base"), "warc-placed")
    candidates = placed.where("start >= 0 and head_size >= 0 and length is not null").select(
        "file", "split", "start", (F.col("start") + step + F.col("head_size") + 4 + F.col("length") + len(END)).alias("successor"))
    records = materialize(reachable(candidates), "warc-records").select("file", "start", "successor").join(placed, ["file", "start"]).where(F.col("type").isin(*types))

    out = ["type", "name", "refers", "labelled", "stated", "body_size", "body_digest"]
    broken = records.where("not whole").select("file", "start", "successor", "head_size", "length", "type", "name", "refers", "labelled", "stated")
    if broken.isEmpty():
        return records.select(*out)
    texts = segments(spark, path).join(owners(placed, broken), ["file", "split", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = F.expr(f"aggregate(slice(parts, 2, greatest(size(parts) - 1, 0)), parts[0].value, (a, x) -> a || unhex('{MAGIC.encode().hex()}') || x.value)")
    mended = (broken.join(texts, (broken["file"] == texts["file"]) & (broken["start"] == texts["owner"])).withColumn("value", joined)
              .withColumn("block", block).withColumn("body", body)
              .select("type", "name", "refers", "labelled", "stated", F.octet_length("body").cast("long").alias("body_size"), F.sha1("body").alias("body_digest")))
    return records.where("whole").select(*out).union(mended)


def op9_warc_round_trip(spark, sf_dir):
    from strandmill.llm.common import table

    path = f"{shared_dir(spark)}/strandmill/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("bigint")
    revisit = F.col("type") == "revisit"
    return read_archives(spark, path).select(
        number("name").alias("page_id"), F.when(revisit, F.col("stated").try_cast("bigint")).otherwise(F.col("body_size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("labelled", "^sha1:", "")).otherwise(F.col("body_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, number(F.coalesce("refers", F.lit("")))).alias("refers_to"))


def oracle_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d),
r AS (SELECT *, payload_bytes >= 1000 AND page_id < top AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""
