"""Content-addressed WARC archive (operator 9).

Payload bytes are stored once per distinct content, under their SHA-256, in one table; the exact header bytes of every
record are kept in another. Records are put together again by joining the two on the digest, and each payload is
digested anew when it is read, so damage is noticed. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the
one with the largest page_id is the response and the others revisit it; smaller payloads are always responses.

A null html is an empty payload; a null url leaves out the target line; a null page_id sorts before all others; of rows
that repeat page_id and payload the first is the response. Line breaks in urls are percent-encoded. An empty table
gives an empty archive. Other columns are not archived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skylag.llm.tables import shared_path, written

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables: payloads (sha256, payload) and headers (record key, digest, header bytes)."""
    spark: SparkSession
    payloads: str
    headers: str

    def read_payloads(self) -> DataFrame:
        """Payloads with their digests computed from the stored bytes; a stored digest that differs is an error."""
        found = F.sha2("payload", 256)
        stored = self.spark.read.schema("sha256 string, payload binary").parquet(self.payloads)
        return stored.select(
            F.when(found == F.col("sha256"), found)
            .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("sha256"),
            "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("n_bytes"))

    def read_headers(self) -> DataFrame:
        return self.spark.read.schema("sha256 string, header binary").parquet(self.headers)


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page_id, again) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"),
                    again.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, date: str = DATE) -> Archive:
    """Write the archive of ``pages`` (page_id, url, html) below the shared folder."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    archive = Archive(spark, f"{folder}/payloads", f"{folder}/headers")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    # Digests without the bytes: all that the headers need, computed once.
    facts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.sha2(payload, 256).alias("sha256"),
                         F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("n_bytes"))
    facts.write.parquet(f"{folder}/facts")
    facts = spark.read.schema(facts.schema).parquet(f"{folder}/facts")
    # Equal payloads collapse inside the tasks before the bytes are shuffled, so a hot payload is one row per task.
    (pages.select(payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
     .groupBy("sha256").agg(F.any_value("payload").alias("payload"))
     .write.parquet(archive.payloads))

    again = Window.partitionBy("page_id", "sha256").orderBy("url")
    keepers = (facts.filter(F.col("n_bytes") >= REVISIT_BYTES)
               .groupBy(F.col("sha256").alias("of")).agg(F.max("page_id").alias("keeper")))
    rows = (facts.withColumn("again", F.row_number().over(again))
            .join(keepers.hint("merge"), F.col("sha256") == F.col("of"), "left")
            .withColumn("revisit", F.col("of").isNotNull()
                        & ~(F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("again") == 1))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")),
                    _line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("again"))),
        F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", target)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(F.col("revisit"), F.concat(
            _line("WARC-Profile", F.lit(PROFILE)),
            _line("WARC-Refers-To", _record_id(F.col("keeper"), F.lit(1))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit("\r\n"), http)
    rows.select("sha256", F.encode(header, "UTF-8").alias("header")).write.parquet(archive.headers)
    return archive


def _field(header, name: str, pattern: str) -> F.Column:
    """The value of a named line of the WARC header; null where there is none."""
    return F.nullif(F.regexp_extract(header, f"\\r\\n{name}: {pattern}\\r\\n", 1), F.lit(""))


def parsed_headers(headers: DataFrame) -> DataFrame:
    """What the header bytes of each record say."""
    text = F.decode("header", "UTF-8")
    page = "<urn:page:([0-9-]+|none):[0-9]+>"
    return headers.withColumns({
        "record_type": _field(text, "WARC-Type", "([a-z]+)"),
        "page_id": _field(text, "WARC-Record-ID", page).try_cast("bigint"),
        "refers_to": _field(text, "WARC-Refers-To", page).try_cast("bigint"),
        "url": _field(text, "WARC-Target-URI", "([^\\r]*)"),
        "header_sha1": _field(text, "WARC-Payload-Digest", "sha1:([0-9a-f]+)"),
    })


def read_records(archive: Archive) -> DataFrame:
    """Per record what its header says and the size and SHA-1 of its full payload, from the stored bytes.

    Payload bytes stay where they are: only their digests and sizes meet the headers.
    """
    facts = archive.read_payloads().drop("payload")
    records = parsed_headers(archive.read_headers()).join(facts.hint("merge"), "sha256")
    agreed = F.when(F.col("sha1") == F.col("header_sha1"), F.col("sha1")).otherwise(
        F.raise_error(F.concat(F.lit("header and payload disagree for "), "sha256")))
    return records.select("page_id", "url", "record_type", "refers_to", F.col("n_bytes").alias("payload_bytes"),
                          agreed.alias("payload_digest"), "header")


def reconstruct(archive: Archive) -> DataFrame:
    """The original records, byte for byte: header, payload (none in a revisit), two line ends."""
    records = parsed_headers(archive.read_headers())
    revisits = records.filter("record_type = 'revisit'").withColumn("payload", F.lit(b""))
    responses = records.filter("record_type <> 'revisit'").join(archive.read_payloads().select("sha256", "payload").hint("merge"), "sha256")
    both = responses.select("page_id", "record_type", "header", "payload").unionByName(
        revisits.select("page_id", "record_type", "header", "payload"))
    return both.select("page_id", "record_type", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def parsed_records(records: DataFrame) -> DataFrame:
    """What the bytes of each whole record say: its lines, and the size and SHA-1 of the payload in it.

    A record whose Content-Length is not that of its block, or whose payload does not have the digest that its header names,
    is an error. A revisit holds no payload; its digest is the one named.
    """
    text, gap = F.decode("record", "UTF-8"), "\r\n\r\n"
    cut = (records.withColumn("_text", text).withColumn("_head", F.substring_index("_text", gap, 1))
           .withColumn("_rest", F.expr("substring(_text, length(_head) + 5)"))
           .withColumn("_http", F.substring_index("_rest", gap, 1))
           .withColumn("payload", F.expr("substring(_rest, length(_http) + 5, length(_rest) - length(_http) - 8)")))
    head = F.concat(F.lit("\r\n"), "_head", F.lit("\r\n"))
    block = F.octet_length("_http") + 4 + F.octet_length("payload")
    read = cut.select(
        _field(head, "WARC-Type", "([a-z]+)").alias("record_type"),
        _field(head, "WARC-Record-ID", "(<[^>]*>)").alias("record_id"),
        _field(head, "WARC-Refers-To", "(<[^>]*>)").alias("refers_to_id"),
        _field(head, "WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("named_sha1"),
        (_field(head, "Content-Length", "([0-9]+)").cast("bigint") == block).alias("whole"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1(F.encode("payload", "UTF-8")).alias("sha1"))
    sound = F.col("whole") & ((F.col("record_type") == "revisit") | (F.col("sha1") == F.col("named_sha1")))
    digest = F.when(F.coalesce(sound, F.lit(False)), F.col("named_sha1")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("?")))))
    return read.select("record_type", "record_id", "refers_to_id", "payload_bytes", digest.alias("payload_digest"))


def read_back(archive: Archive) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type and refers_to, all from its reconstructed bytes.

    A revisit takes the size of its payload from the response it refers to; both must name the same digest. Only sizes and
    digests of responses that others may refer to meet the revisits.
    """
    records = written(parsed_records(reconstruct(archive)), "records")
    page = F.regexp_extract(F.col("record_id"), "<urn:page:([0-9-]+|none):", 1).try_cast("bigint")
    of = F.regexp_extract(F.col("refers_to_id"), "<urn:page:([0-9-]+|none):", 1).try_cast("bigint")
    responses = records.filter("record_type = 'response'")
    found = responses.filter(F.col("payload_bytes") >= REVISIT_BYTES).select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("their_bytes"), F.col("payload_digest").alias("theirs"))
    revisits = records.filter("record_type = 'revisit'").join(found.hint("merge"), "refers_to_id", "left")
    agreed = F.when(F.col("theirs") == F.col("payload_digest"), F.col("their_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("no such payload for "), "record_id")).cast("bigint"))
    none = F.lit(None).cast("bigint")
    return (responses.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", none.alias("refers_to"))
            .union(revisits.select(page.alias("page_id"), agreed.alias("payload_bytes"), "payload_digest", "record_type",
                                   of.alias("refers_to"))))
