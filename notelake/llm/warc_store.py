"""WARC records in a content-addressed archive.

``archive`` writes two tables to the shared folder. ``payloads`` holds the bytes of every distinct
payload once, under its SHA-256 (and SHA-1 and length, which verify it). ``records`` holds for
every record its exact header block (the WARC header and, for a response, the HTTP header) and the
address of its payload. Of records with equal large payloads the one with the largest page id is
the response; the others are revisits of it.

``reconstruct`` joins header and payload to the original record bytes; a stored payload that does
not match its address is refused. ``restore`` parses these bytes: header fields, block and payload
by their lengths, digest of the payload as it stands there. A revisit is resolved through the
response that it names.

The group-by that stores a payload once combines copies on the map side, so a payload that a third
of all pages share leaves each task once. Whether a record is a revisit is joined for large
payloads only, and on digests. The join that brings payloads to their records has one row for each address on
one side, and the adaptive skew join splits a common one on the other.

Defined results: a null html is an empty payload; a null url gives a record with an empty target;
null page ids are smaller than any other, and their records are urn:page:null; rows repeated with one
id and payload are one record and come back as one row each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.session import materialize, scratch

MIN_SHARED = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
NO_ID = -(2**63)


@dataclass(frozen=True)
class Archive:
    payloads: str
    records: str


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.when(page == NO_ID, F.lit("null")).otherwise(page.cast("string")), F.lit(">"))


def _header(date: str) -> Column:
    """The exact block before the payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    shared = F.concat(
        F.lit(f"WARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF),
    )
    return F.when(
        revisit,
        F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}"), shared, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
            _urn(F.col("refers_to")), F.lit(f"{CRLF}Content-Length: 0{CRLF}{CRLF}"),
        ),
    ).otherwise(
        F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}"), shared, F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), (F.octet_length(http) + F.col("payload_bytes")).cast("string"), F.lit(CRLF * 2), http)
    )


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_shared: int = MIN_SHARED, date: str = DATE, folder: str | None = None) -> Archive:
    """Write one record for each row of ``pages``; the names of the two tables."""
    spark = pages.sparkSession
    at = folder or scratch(spark, "warc")
    out = Archive(f"{at}/payloads", f"{at}/records")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce(F.col(page_id).cast("long"), F.lit(NO_ID)).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("address", F.unhex(F.sha2("payload", 256)))
    once = rows.groupBy("address").agg(F.max("page_id").alias("response"), F.first("payload").alias("payload"))
    once.select("address", "response", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload").write.option("compression", "zstd").parquet(out.payloads)
    kept = spark.read.parquet(out.payloads).where(F.col("payload_bytes") >= min_shared).select("address", "response")
    facts = rows.select("page_id", "url", "payload_bytes", "address", F.sha1("payload").alias("payload_digest"))
    large = facts.where(F.col("payload_bytes") >= min_shared).join(kept, "address").withColumn("refers_to", F.when(F.col("response") != F.col("page_id"), F.col("response"))).drop("response")
    told = large.unionByName(facts.where(F.col("payload_bytes") < min_shared).withColumn("refers_to", F.lit(None).cast("long")))
    told.select("page_id", "address", F.col("refers_to").isNotNull().alias("revisit"), F.encode(_header(date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(out.records)
    return out


def _records(spark: SparkSession, store: Archive) -> DataFrame:
    """page_id, record of every record; NO_ID stands for a null id."""
    stored = spark.read.parquet(store.payloads)
    sound = (F.unhex(F.sha2("payload", 256)) == F.col("address")) & (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = stored.select("address", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("address"))).cast("binary")).alias("payload"))
    records = spark.read.parquet(store.records)
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    missing = F.raise_error(F.concat(F.lit("no payload is stored at "), F.hex("address"))).cast("binary")
    responses = records.where("not revisit").join(checked, "address", "left").select("page_id", F.concat("header", F.coalesce("payload", missing), end).alias("record"))
    return responses.unionByName(records.where("revisit").select("page_id", F.concat("header", end).alias("record")))


def reconstruct(spark: SparkSession, store: Archive) -> DataFrame:
    """(page_id, record): the bytes of every WARC record, ended as the format asks; a revisit has no payload."""
    return _records(spark, store).select(F.when(F.col("page_id") != NO_ID, F.col("page_id")).alias("page_id"), "record")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)


def parsed(records: DataFrame) -> DataFrame:
    """record_type, page, target (page ids as the record has them), digest (as named), payload (null for a revisit) from the bytes in ``record``."""
    plain = lambda c: F.decode(c, "ISO-8859-1")  # noqa: E731  (a character for each byte)
    at = records.withColumn("end", F.instr(plain(F.col("record")), CRLF * 2))
    head = at.withColumn("head", F.decode(F.substring("record", F.lit(1), F.col("end") - 1), "UTF-8"))
    size = F.expr("try_cast(size as int)")
    cut = head.withColumn("size", _field(F.col("head"), "Content-Length")).withColumn("block", F.substring("record", F.col("end") + 4, size))
    whole = (F.octet_length("record") == F.col("end") + 3 + size + 4) & (F.substring("record", F.col("end") + 4 + size, F.lit(4)) == F.encode(F.lit(CRLF * 2), "UTF-8"))
    page = lambda name: F.regexp_extract("head", rf"(?md)^{name}: <urn:page:([^>]*)>\r?$", 1)
    kind = _field(F.col("head"), "WARC-Type")
    told = cut.withColumn("sound", F.when(F.coalesce(whole, F.lit(False)), True).otherwise(F.raise_error(F.lit("a record's length is not as its header says")).cast("boolean"))).withColumn("http", F.instr(plain(F.col("block")), CRLF * 2))
    length = F.regexp_extract(plain(F.substring("block", F.lit(1), F.col("http") + 1)), r"(?md)^Content-Length: ([0-9]+)\r?$", 1)
    rows = told.where("sound").select(
        kind.alias("record_type"), page("WARC-Record-ID").alias("page"), page("WARC-Refers-To").alias("target"), F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.when(kind == "response", F.substring("block", F.col("http") + 4, F.octet_length("block"))).alias("payload"), length.alias("length"),
    )
    fits = (F.col("record_type") == "revisit") | ((F.octet_length("payload").cast("string") == F.col("length")) & (F.sha1("payload") == F.col("digest")))
    return rows.withColumn("digest", F.when(F.coalesce(fits, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("record does not match its payload: "), F.col("digest"))))).drop("length")


def restore(spark: SparkSession, store: Archive) -> DataFrame:
    """What the records say, read back from their bytes: page_id, record_type, refers_to, payload_bytes, payload_digest."""
    facts = parsed(_records(spark, store)).select("record_type", "page", "target", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    told = materialize(facts, "records")
    responses = told.where("record_type = 'response'")
    known = responses.groupBy(F.col("page").alias("target"), F.col("digest")).agg(F.first("payload_bytes").alias("payload_bytes"))
    unresolved = F.raise_error(F.concat(F.lit("the response is not there: "), F.col("target"))).cast("long")
    revisits = told.where("record_type = 'revisit'").drop("payload_bytes").join(known, ["target", "digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", unresolved))
    return responses.unionByName(revisits).select(
        F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.expr("try_cast(target as bigint)")).alias("refers_to")
    )


def export(spark: SparkSession, store: Archive, path: str, records_per_file: int = 10_000) -> None:
    """Real .warc text: the records end in two line breaks, which are the writer's line separator."""
    rows = reconstruct(spark, store).select(F.decode("record", "UTF-8").alias("value"))
    rows.select(F.expr("left(value, length(value) - 4)").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def archived(pages: DataFrame) -> DataFrame:
    """Write, read back, and tell of every page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    store = archive(pages)
    return restore(pages.sparkSession, store)


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
k as (select page_id, strlen(body) as n, sha1(body) as d, max(page_id) over (partition by body) as top from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
    case when n >= {MIN_SHARED} and page_id <> top then 'revisit' else 'response' end as record_type,
    case when n >= {MIN_SHARED} and page_id <> top then top end as refers_to from k"""
