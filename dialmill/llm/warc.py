"""Content-addressed WARC archive.

Two tables under one folder: ``payloads`` keeps each distinct payload once, under its SHA-256 and length; ``headers``
keeps every record's exact header bytes with the digest it refers to, and nothing else. Reading back parses the headers,
verifies each stored payload against its digest and each header against its payload, rebuilds records by a join on the
digest, and finds the record that a revisit refers to by a join on record ids.

Defined cases: a null payload is an empty one; a null url or id leaves its header line out; records of the same id and payload
are the same record and have the same type; an empty table gives an empty archive; extra columns play no part. Payloads
are compared by SHA-256 and length; the SHA-1 in headers is the one the format asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmill.runtime import lookup_join, stash

LEAST, DATE = 1000, "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: An extension field: the id of the record's row.
KEY = "X-Record-Key"


def record_uri(page_id: Column) -> Column:
    """A stable urn:uuid from the record's id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))], F.lit(">"))


def header_text(page_id: Column, url: Column, kind: Column, sha1: Column, length: Column, refers: Column) -> Column:
    """The exact header block of a record, up to and with its empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", record_uri(page_id)), line("WARC-Date", F.lit(DATE)),
        F.when(page_id.isNull(), "").otherwise(line(KEY, page_id.cast("string"))),
        F.when(url.isNull(), "").otherwise(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", ""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_uri(refers)))).otherwise(""),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``headers`` and ``payloads`` under path.

    Payload bytes cross the network once, to find the holder of each digest by a hash join against the narrow list of
    holders; everything else works on digests. The hot digest's narrow rows are pre-aggregated before they are shuffled.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(body, 256).alias("sha256"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"))
    keyed = stash(keyed.withColumn("digest", F.concat_ws("-", "sha256", F.col("n_bytes").cast("string"))).drop("sha256"), "warc-keyed")  # payloads are hashed once
    holders = keyed.groupBy("digest").agg(F.max("page_id").alias("holder"))
    kept = keyed.join(holders, "digest")
    revisit = (F.col("n_bytes") >= least) & F.coalesce(F.col("page_id") != F.col("holder"), F.col("holder").isNotNull())
    kept = kept.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("holder")))
    head = header_text(F.col("page_id"), F.col("url"), F.col("record_type"), F.col("sha1"), F.col("n_bytes"), F.col("refers_to"))
    kept.select("digest", head.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # A holder's page may have other payloads under the same id, so the digest is taken again after the join; a holder
    # row that is repeated (m > 1) is told apart first, for only those payloads need a second shuffle.
    met = keyed.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("m")).groupBy("digest").agg(F.max(F.struct("page_id", "m")).alias("h"))
    one = stash(met.select("digest", F.coalesce(F.col("h.page_id").cast("string"), F.lit("null")).alias("__h"), F.col("h.m").alias("m")), "warc-holders")
    by_id = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__h"), body.alias("payload"))

    def held(side: DataFrame) -> DataFrame:
        full = by_id.join(side.select("digest", "__h").hint("shuffle_hash"), "__h")
        return full.filter(F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload").cast("string")) == F.col("digest")).select("digest", "payload")

    out = held(one.filter("m = 1"))
    if one.filter("m > 1").limit(1).count():
        out = out.unionByName(held(one.filter("m > 1")).dropDuplicates(["digest"]))
    out.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, n_bytes, sha1 of the stored bytes; a payload that doesn't match its digest raises."""
    got = spark.read.parquet(f"{path}/payloads")
    same = F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload").cast("string")) == F.col("digest")
    n = F.when(same, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("long"))
    return got.select("digest", "payload", n.alias("n_bytes"), F.sha1("payload").alias("sha1"))


def field(header: Column, name: str) -> Column:
    """The value of a header's field, null where it has none."""
    return F.nullif(F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """digest, header, and what the header says: record_type, uri, page_id, refers_uri, sha1, length."""
    got = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    h = F.col("header").cast("string")
    return got.select(
        "digest", "header", field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Record-ID").alias("uri"), field(h, KEY).cast(id_type).alias("page_id"),
        field(h, "WARC-Refers-To").alias("refers_uri"), F.substring_index(field(h, "WARC-Payload-Digest"), ":", -1).alias("sha1"), field(h, "Content-Length").cast("long").alias("length"),
    )


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Every record: page_id, record_type, refers_to, header, payload (the full one, for revisits too), n_bytes, sha1.

    A header that doesn't agree with its payload raises. The responses that revisits refer to, one for each repeated
    payload, come back by a broadcast where they fit, else by a salted join, so a hot one is spread.
    """
    heads = read_headers(spark, path, id_type)
    asked = heads.filter("refers_uri IS NOT NULL").select(F.col("refers_uri").alias("uri")).distinct()
    named = stash(heads.filter("record_type = 'response'").join(asked, "uri", "left_semi").select(F.col("uri").alias("refers_uri"), F.col("page_id").alias("refers_to")).distinct(), "warc-named")
    full = lookup_join(heads, named, "refers_uri", F.col("uri")).join(read_payloads(spark, path).withColumnRenamed("sha1", "own_sha1"), "digest")
    agrees = (F.col("sha1") == F.col("own_sha1")) & (F.col("length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("n_bytes")))
    kind = F.when(agrees, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("header doesn't agree with payload "), "digest")).cast("string"))
    return full.select("page_id", kind.alias("record_type"), "refers_to", "header", "payload", "n_bytes", "sha1")


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the record as it stands in a WARC file: header, block (none for revisits), two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.col("header"), block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write .warc content as gzip part files; records are framed by Content-Length, one file per partition."""
    text = record_bytes(records).select(F.expr(f"substring(record, 1, octet_length(record) - {2 * len(CRLF)})").cast("string"))
    text.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> list[tuple[bytes, bytes]]:
    """(header, block) of each record in the bytes of a WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n") if b": " in x)
        n = int(fields[b"Content-Length"])
        out.append((data[at:end], data[end : end + n]))
        at = end + n + 4
    return out
