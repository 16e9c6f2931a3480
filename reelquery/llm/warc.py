"""WARC archives: writing pages with revisit records, and reading them back by boundary-chain verification."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import checkpoint, checkpoint_dir, remove, settled

#: Bytes of a payload from which a page has an archive file of its own, and records of the other files: together they bound
#: what a reading task holds of an archive (and binaryFile reads files up to 2 GiB).
LARGE_BYTES, RECORDS_PER_ARCHIVE = 2**18, 512
#: Revisits up to which they are broadcast (some 60 bytes each).
BROADCAST_REVISITS = 300_000
#: The RFC 4648 base32 alphabet and the date that all records carry, so that reruns write equal archives.
BASE32, DATE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "2020-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
CANDIDATE = "archive string, offset long, successor long, archive_end long, page_id long, record_type string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to long, uri string"


def base32(hexed: Column) -> Column:
    """Forty hex digits in bare upper-case base32: every five of them are four letters."""
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def payload_of(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (the html in UTF-8; empty if null), bytes and sha1 (in hex digits)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def revisits(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, int, int]:
    """of_sha1, of_page, first: the pages that repeat the payload, of at least least_bytes bytes, of the page with the smallest
    id, first; how many there are; and the bytes of the largest payload of all. Bodies take no part, so a payload that many
    pages share is only many small rows."""
    digests = checkpoint(payload_of(pages).select("page_id", "sha1", "bytes"))  # so that the bodies are read once for all of this
    rows = digests.where(F.col("bytes") >= least_bytes)
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 AND first IS NOT NULL")
    again = rows.join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first")))
    found, n = settled(again.select(F.col("sha1").alias("of_sha1"), F.col("page_id").alias("of_page"), "first").distinct())
    return found, n, digests.agg(F.max("bytes")).first()[0] or 0


def records(rows: DataFrame, again: DataFrame) -> DataFrame:
    """A WARC record per row of payload_of() as one text column, without the line end that the text sink adds.

    Rows in again (of_sha1, of_page, first) are revisits, all others responses. Control characters and spaces in a URL are
    percent-encoded, so they can't break a header."""
    rows = rows.join(again, (F.col("sha1") == F.col("of_sha1")) & F.col("page_id").eqNullSafe(F.col("of_page")), "left")
    again = F.col("first").isNotNull()
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    length = F.when(again, F.lit(len(HTTP_HEAD))).otherwise(F.col("bytes") + len(HTTP_HEAD))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), page(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n" + HTTP_HEAD),
    )
    # the block, then the empty line of the record's end; the sink writes the second line end
    return rows.select(F.concat(head.cast("binary"), F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload")), F.lit("\r\n").cast("binary")).cast("string").alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, large_bytes: int = LARGE_BYTES, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write pages as gzip-compressed WARC files under folder: of at most records_per_archive records, or of one record for
    payloads of large_bytes or more.

    Of pages with equal payloads of at least least_bytes bytes, that with the smallest page_id is a response and the others
    revisit it. A null html is an empty payload; a page without id is a revisit if an equal page has one."""
    again, n, most_bytes = revisits(pages, least_bytes)
    again = F.broadcast(again) if n <= BROADCAST_REVISITS else again
    rows, large = payload_of(pages), F.col("bytes") >= large_bytes
    for kind, own, most in (("small", ~large, records_per_archive), ("large", large, 1)):
        if kind == "small" or most_bytes >= large_bytes:
            records(rows.where(own), again).write.option("maxRecordsPerFile", most).option("lineSep", "\r\n").option("compression", "gzip").text(f"{folder}/{kind}")


def page_of(field: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", field or b"")
    return int(found[1]) if found else None


def candidates_in(archive: str, data: bytes) -> list[tuple]:
    """A row for every place that looks like a record, also inside payloads: its offset, and the offset of its successor
    (null if the header is no header or the block does not end in an empty line)."""
    rows = []
    for magic in MAGIC.finditer(data):
        end = data.find(b"\r\n\r\n", magic.end() - 2)
        fields = {}
        for line in data[magic.end() : max(end, magic.end())].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        length = fields.get(b"content-length", b"")
        whole = end >= 0 and length.isdigit()
        stop = end + 4 + int(length) if whole else 0
        if not whole or data[stop : stop + 4] != b"\r\n\r\n":
            rows.append((archive, magic.start(), None, len(data), None, None, None, None, None, None, None))
            continue
        block = data[end + 4 : stop]
        payload = block.partition(b"\r\n\r\n")[2]
        said = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
        kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
        if kind == "revisit":
            size, digest = int(fields[b"x-payload-length"]) if fields.get(b"x-payload-length", b"").isdigit() else None, said
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rows.append((archive, magic.start(), stop + 4, len(data), page_of(fields.get(b"warc-record-id")), kind, size, digest, digest == said, page_of(fields.get(b"warc-refers-to")), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")))
    return rows


def inflated(content: bytes) -> bytes:
    """The bytes of all gzip members of an archive file. Zero bytes may pad its end; other bytes there, and a member that is
    cut off, are errors."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        return members.read()


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    whole = [x.split()[0] for x in CANDIDATE.split(", ") if x.endswith(" long")]
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"], strict=True):
            data = inflated(content) if content[:2] == b"\x1f\x8b" else content
            rows = pd.DataFrame(candidates_in(archive, data), columns=names)
            yield rows.astype(dict.fromkeys(whole, "Int64"))


def reachable(found: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one archive that its chain of records reaches from the file start, by pointer jumping: each round
    marks the jump targets of what is marked and doubles all jumps, so n records take log2(n) rounds."""
    found = found.sort_values("offset", ignore_index=True)
    offset, n = found["offset"].to_numpy(np.int64), len(found)
    successor = found["successor"].fillna(-1).to_numpy(np.int64)
    at = np.minimum(np.searchsorted(offset, successor), n - 1)
    jump = np.append(np.where(offset[at] == successor, at, n), n)  # n: the end of the chain
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and offset[0] == 0
    mark[n] = True
    while (jump != n).any():
        mark[jump[mark]] = True
        jump = jump[jump]
    mark[n] = False
    return found[mark[:n] & (successor >= 0)]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives (*.gz, of one or more members, and plain *.warc) under folder and its subfolders, with their
    archive and offset in the uncompressed bytes.

    Tasks scan the archives and emit a candidate for each magic; per archive, only what the chain of successors reaches
    from offset 0 is a record, so a magic inside a payload never is. A chain stops at the first broken record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    found = files.mapInPandas(scan, CANDIDATE)
    return found.groupBy("archive").applyInPandas(reachable, CANDIDATE)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives written to a
    new folder under the shared checkpoint folder, which is deleted afterwards. Repeated rows are records each; of equal
    smallest page_ids each is a response. Payloads may be of any length that a file can hold. An empty table gives no rows;
    extra columns are ignored."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(pages, folder, least_bytes)
        return checkpoint(read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove(spark, folder)
