"""WARC archives with a two-level capture index.

Archives are WARC/1.1 files that Spark's text writer puts into the shared folder: each record is one row, closed by
the two line ends that the format asks for. A record's block is an HTTP message whose body is deflated, as its
Content-Encoding says; digests and lengths of the payload are those of the full text.

The index reads the archives once. Its entries (reversed-host key, record, file, offset, length) are range-sorted and
packed into deflated blocks; the first key of each block is the sparse directory. A lookup finds the block in the
directory, searches the block by bisection and reads the one range of the one file. archived() looks up every capture: the
index's entries meet their archive by file, and each record is cut from the range that its entry names.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.llm.common import Handoff, small
from docguard.session import new_path

#: Fixed values of base32 (RFC 4648), next to the digits that conv() writes.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
INDEX = "block long, first_key string, last_key string, n_entries int, packed binary"
ARCHIVES_PER_TASK = 16  # read by ranges
ENTRY = "url_key string, record string, file string, offset long, length long"


def sha1_base32(text: str) -> str:
    """SQL for the base32 SHA-1 of a text's UTF-8 bytes: 40 hex digits in groups of 20 bits, four characters each."""
    groups = ", ".join(f"lpad(conv(substr(sha1({text}), {i * 5 + 1}, 5), 16, 32), 4, '0')" for i in range(8))
    return f"translate(concat({groups}), '{DIGITS}', '{BASE32}')"


def url_key(url: str) -> str:
    """SQL for the sort key: host labels in reverse order, then the rest, all in lower case, without scheme and fragment."""
    bare = f"regexp_replace(regexp_replace(lower(coalesce({url}, '')), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '')"
    host = f"regexp_replace(regexp_extract({bare}, '^([^/?]*)', 1), '(^www\\\\d*\\\\.)|(:\\\\d+$)', '')"
    rest = f"regexp_extract({bare}, '^[^/?]*(.*)$', 1)"
    return f"concat(array_join(reverse(split({host}, '\\\\.')), ','), ')', {rest})"


def write_archives(pages: DataFrame, path: str, hand: Handoff, id_column: str = "page_id", url: str = "url",
                   html: str = "html", least_bytes: int = 0, records_per_file: int = 2000) -> None:
    """One record per page; of equal payloads of at least `least_bytes` bytes, the smallest id is the response.

    Null payloads are empty, null URLs too. Pages that share an id and a payload are told apart by their place: the
    first is the response. Who responds is found on (id, digest) alone; deflated texts move once, to meet the result.
    """
    rows = pages.selectExpr(f"bigint(`{id_column}`) AS id", f"coalesce(`{url}`, '') AS url", f"coalesce(`{html}`, '') AS body",
                            "monotonically_increasing_id() AS place")

    def deflated(batches):
        import pyarrow as pa

        for batch in batches:
            body = batch.column("body").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "url", "place", "digest", "n_bytes")),
                 pa.array([zlib.compress(x.as_buffer(), 6) for x in body], pa.binary())],
                ["id", "url", "place", "digest", "n_bytes", "body"])

    measured = rows.selectExpr("id", "url", "place", f"{sha1_base32('body')} AS digest", "bigint(octet_length(body)) AS n_bytes", "body")
    stored = hand.write(measured.mapInArrow(deflated, "id long, url string, place long, digest string, n_bytes long, body binary"), "bodies")
    first = stored.filter(f"n_bytes >= {least_bytes}").groupBy("digest", "n_bytes").agg(F.min(F.struct("id", "place")).alias("first"))
    named = stored.select("id", "place", "digest", "n_bytes").join(first, ["digest", "n_bytes"], "left").filter(
        "struct(id, place) > first").selectExpr("place", "true AS again", "first.id AS refers_to")
    records = stored.join(small(named), "place", "left")
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Encoding: deflate\\r\\n\\r\\n')"
    block = f"if(again IS NULL, concat(binary({http}), body), binary({http}))"
    kind = "if(again IS NULL, 'response', 'revisit')"
    head = f"""concat('WARC/1.1\\r\\nWARC-Type: ', {kind}, '\\r\\nWARC-Record-ID: <urn:page:', coalesce(string(id), 'null'), '>\\r\\nWARC-Target-URI: ',
        regexp_replace(url, '[\\\\x00-\\\\x20]', '%20'), '\\r\\nWARC-Date: 1970-01-01T00:00:00Z\\r\\nWARC-Payload-Digest: sha1:', digest,
        '\\r\\nX-Payload-Length: ', n_bytes, if(again IS NULL, '', concat('\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\nWARC-Refers-To: <urn:page:', coalesce(string(refers_to), 'null'), '>')),
        '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ', octet_length(block), '\\r\\n\\r\\n')"""
    lines = records.selectExpr("*", f"{block} AS block").selectExpr(f"cast(concat(binary({head}), block) AS string) AS value")
    lines.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    hand.drop("bodies")


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields of the record at a place, and where its block begins."""
    stop = data.index(END.encode(), at)
    lines = data[at:stop].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    return dict(line.split(": ", 1) for line in lines[1:]), stop + 4


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes | None, int]:
    """Header fields, payload (None for a revisit) and full length of the record at a place."""
    head, begin = _headers(data, at)
    end = begin + int(head["Content-Length"])
    payload = zlib.decompress(data[data.index(END.encode(), begin) + 4:end]) if head["WARC-Type"] == "response" else None
    return head, payload, end + 4 - at


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Each archive as a row of path and content; the writer bounds the records of a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def build_index(spark: SparkSession, archives: str, path: str, entries_per_block: int = 1000) -> DataFrame:
    """Scan the archives once and write the index: sorted entries in deflated blocks, with the keys of each block."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                data, at, found = bytes(data), 0, []
                while at < len(data):
                    head, begin = _headers(data, at)
                    length = begin + int(head["Content-Length"]) + 4 - at
                    found.append((head["WARC-Target-URI"], head["WARC-Record-ID"], name, at, length))
                    at += length
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["url", "record", "file", "offset", "length"])

    entries = archive_files(spark, archives).mapInArrow(scan, "url string, record string, file string, offset long, length long")
    keyed = entries.selectExpr(f"{url_key('url')} AS url_key", "record", "file", "offset", "length")
    order = ["url_key", "record", "file", "offset"]

    def pack(batches):
        import pyarrow as pa

        def block(lines):
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((lines[0][0], pa.string()), (lines[-1][0], pa.string()), (len(lines), pa.int32()), (data, pa.binary()))],
                ["first_key", "last_key", "n_entries", "packed"])

        lines = []
        for batch in batches:
            lines += zip(*(c.to_pylist() for c in batch.columns))
            while len(lines) >= entries_per_block:
                yield block(lines[:entries_per_block])
                lines = lines[entries_per_block:]
        if lines:
            yield block(lines)

    packed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, "first_key string, last_key string, n_entries int, packed binary")
    packed.selectExpr("monotonically_increasing_id() AS block", "*").write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def unpacked(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]


def captures(index: DataFrame) -> DataFrame:
    """All entries of the index, block by block."""

    def open_blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                key, record, file, offset, length = zip(*unpacked(data.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(record), pa.array(file), pa.array(map(int, offset), pa.int64()), pa.array(map(int, length), pa.int64())],
                    ["url_key", "record", "file", "offset", "length"])

    return index.select("packed").mapInArrow(open_blocks, ENTRY)


def lookup(spark: SparkSession, index_path: str, url: str) -> list[tuple[dict[str, str], bytes | None]]:
    """All captures of one URL: directory, bisection in the block, one range read for each."""
    key = spark.range(1).select(F.lit(url).alias("url")).selectExpr(url_key("url")).first()[0]
    blocks = spark.read.schema(INDEX).parquet(index_path).filter((F.col("first_key") <= key) & (F.col("last_key") >= key))
    found = []
    for row in blocks.orderBy("block").toLocalIterator():
        lines = unpacked(bytes(row.packed))
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key:
            _, _, file, offset, length = lines[at]
            found.append(parsed(read_range(spark, file, int(offset), int(length)))[:2])
            at += 1
    return found


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a part of one file, from any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def read_records(spark: SparkSession, archives: str, index: DataFrame) -> DataFrame:
    """Every capture of the index, read from its range and checked against its entry and its digest.

    What no entry names is not read as a record. An archive moves once, to the ranges of its captures, which the writer's bound
    on the records of a file bounds; the ranges are hashed, so archives are neither sorted nor held.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    """

    def read(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def number(name):
            digits = name.removeprefix("<urn:page:").removesuffix(">")
            return None if digits == "null" else int(digits)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = batch.column(0)[i].as_buffer(), []
                for entry in batch.column(1)[i].as_py():
                    head, payload, length = parsed(data.slice(entry["offset"], entry["length"]).to_pybytes())
                    if (head["WARC-Record-ID"], length) != (entry["record"], entry["length"]):
                        raise ValueError(f"the index has {entry['record']} where {head['WARC-Record-ID']} is")
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if payload is not None and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, size):
                        raise ValueError(f"{head['WARC-Record-ID']} does not match its digest")
                    refers = head.get("WARC-Refers-To")
                    rows.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    # as many tasks as shuffles have, more where the counted archives need them
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archive_files(spark, archives).select("path").count() // ARCHIVES_PER_TASK))
    wanted = captures(index).groupBy("file").agg(F.collect_list(F.struct("record", "offset", "length")).alias("entries"))
    ranges = archive_files(spark, archives).repartition(n, "path").join(
        wanted.repartition(n, "file").hint("shuffle_hash"), F.col("path") == F.col("file")).select("content", "entries")
    return ranges.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, index them, and read them back through the index.

    An empty table gives no archive and no rows; columns besides page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "warc-index")
    write_archives(pages, archives, Handoff(spark, "warc"), least_bytes=least_bytes)
    return read_records(spark, archives, build_index(spark, archives, index))


ORACLE_ROWS = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::bigint AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)
        for i in range(32)], '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
