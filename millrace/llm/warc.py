"""WARC: a deterministic sharded writer, and a reader.

Records are sorted by ranges of page_id. Ranges come from exact sums of bytes by
at most COARSE equal steps of the ids, so the same pages give the same shards
however Spark deals them. A task writes its shards' records one gzip member each
and begins another file at a new shard and when the current file has reached a
compressed size. Files get temporary names of the attempt that writes them;
tasks then rename those that finished attempts have told of, and the manifest
is written last, as a table. What a lost executor has written is never named.

Headers are written anew: lengths, SHA-1 digests of payload, record ids that
depend on page and payload alone, and a fixed date, so a rerun gives equal bytes.

Of records with equal payloads of at least 1000 bytes the one with the largest
page_id is the response and others revisit it. Which page that is comes from an
aggregate by digest; it joins the pages' order as rows of its own, so the html
is shuffled once.

Null html is an empty payload. Null page_ids come last, dealt to shards by
payload, and are never referred to unless all are null, when each is a response.
Of repeated rows of the largest page_id the first is the response and the others
revisit it, so rows that repeat an id share a shard. Extra columns are ignored.
An empty table gives no files and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, table

LEAST, ROLL_BYTES, DATE = 1000, 64 << 20, "2024-01-01T00:00:00Z"
#: Bytes of payload that a shard holds, but for a single step's, and steps of page_id that are summed to cut shards.
SHARD_BYTES, COARSE = 32 << 20, 1 << 16
MANIFEST = "file string, shard int, part int, bytes long, records long, sha256 string"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}:{digest}").urn
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if revisit else b"Content-Length: %d\r\n" % len(payload)) + b"\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join((url or "about:blank").split()), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}", *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def shards(sized: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, Column]:
    """(step, shard) of every step of ids, and the step of a row (page_id, digest); sized: (page_id, size).

    The rows are as many as there are steps, COARSE and those of null ids at most, whatever the pages, so they may be broadcast.
    """
    ends = sized.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(F.when(F.col("page_id").isNull(), F.col("size") + 1)).alias("nulls")).first()
    low, width = ends["low"] or 0, max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // COARSE))
    spread = min(COARSE, max(1, -(-(ends["nulls"] or 0) // shard_bytes)))
    step = F.when(F.col("page_id").isNotNull(), F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width))).otherwise(COARSE + F.pmod(F.xxhash64("digest"), F.lit(spread))).cast("int")
    known = sized.where("page_id is not null").groupBy(step.alias("step")).agg(F.sum(F.col("size") + 1).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_ids = known.select("step", F.floor(before / shard_bytes).cast("int").alias("shard"))
    nulls = sized.sparkSession.range(spread).select((F.col("id") + COARSE).cast("int").alias("step"), (F.col("id") + (1 << 30)).cast("int").alias("shard"))
    return of_ids.union(nulls), step


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files into a new folder; the manifest, a row a file."""
    scratch = Scratch(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    sized = scratch.written(pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("size")), "sized")
    keyed = sized.where(F.col("size") >= LEAST)
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    links = keyed.join(scratch.written(groups.select("digest", "keeper"), "keepers"), "digest").select("page_id", "digest", "keeper").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "payload", null("string").alias("digest"), null("long").alias("keeper"))
    # a link goes before the records of its id; one of a null id meets its record in the record's own shard by digest
    told = scratch.written(links, "links")
    rows = rows.unionByName(told.where("page_id is not null").select("page_id", F.lit(0).alias("kind"), null("string").alias("url"), null("binary").alias("payload"), "digest", "keeper"))
    by_digest = told.where("page_id is null").select("digest", F.col("keeper").alias("_keeper"))
    nameless = pages.where("page_id is null").withColumn("digest", F.sha1("payload")).join(by_digest, "digest", "left")
    nameless = nameless.select("page_id", F.lit(1).alias("kind"), "url", "payload", "digest", F.col("_keeper").alias("keeper"))
    steps, step = shards(sized, shard_bytes)
    steps = scratch.written(steps, "steps")
    rows = rows.where("page_id is not null").union(nameless).withColumn("step", step).join(F.broadcast(steps), "step").drop("step")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, root = _store(folder)
        task = TaskContext.get()
        out, done, size, count, sha = None, [], 0, 0, hashlib.sha256()
        at, keepers, used, now = (), {}, set(), None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((now, sum(d[0] == now for d in done), temporary, size, count, sha.hexdigest()))
                out = None

        for pdf in batches:
            for shard, i, kind, url, payload, digest, keeper in pdf[["shard", "page_id", "kind", "url", "payload", "digest", "keeper"]].itertuples(index=False):
                i = None if pd.isna(i) else int(i)
                if shard != now:
                    close()
                    now = int(shard)
                if at != (i,):
                    at, keepers, used = (i,), {}, set()
                if kind == 0:
                    keepers[digest] = int(keeper)
                    continue
                payload = bytes(payload)
                digest = hashlib.sha1(payload).hexdigest()
                keeper = keepers.get(digest) if i is not None else None if pd.isna(keeper) else int(keeper)
                revisit = keeper is not None and (keeper != i or digest in used)
                used.add(digest)
                data = io.BytesIO()
                with gzip.GzipFile(fileobj=data, mode="wb", compresslevel=6, mtime=0) as z:
                    z.write(record(i, url, payload, digest, keeper, revisit))
                if out is None:
                    temporary = f"{root}/_temporary-{task.partitionId():05d}-{len(done):05d}-{task.taskAttemptId()}"
                    out, size, count, sha = store.open_output_stream(temporary, compression=None), 0, 0, hashlib.sha256()
                member = data.getvalue()
                out.write(member)
                sha.update(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["shard", "part", "temporary", "bytes", "records", "sha256"])

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = _store(folder)
        for pdf in batches:
            names = [f"part-{s:010d}-{p:05d}.warc.gz" for s, p in zip(pdf["shard"], pdf["part"], strict=True)]
            for temporary, name in zip(pdf["temporary"], names, strict=True):
                if store.get_file_info(temporary).type != fs.FileType.NotFound:  # else an attempt before has renamed it
                    store.move(temporary, f"{root}/{name}")
            yield pdf.assign(file=names)[["file", "shard", "part", "bytes", "records", "sha256"]]

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = rows.select("shard", "page_id", "kind", "url", "payload", "digest", "keeper")
    spread = rows.repartition("shard").sortWithinPartitions("shard", "page_id", "kind", "url", "payload")
    # ids go to Python as text, as beside a null it would make a number a double
    spread = spread.withColumns({"page_id": F.col("page_id").cast("string"), "keeper": F.col("keeper").cast("string")})
    files = scratch.written(spread.mapInPandas(put, "shard int, part int, temporary string, bytes long, records long, sha256 string"), "files")
    manifest = folder + "/manifest"
    files.mapInPandas(commit, MANIFEST).write.parquet(manifest)
    scratch.clear()
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a readable stream of gzip members."""
    with gzip.GzipFile(fileobj=data) as z:
        while line := z.readline():
            if not line.strip():
                continue
            head = {"": line.decode().strip()}
            while (line := z.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            yield head, z.read(int(head["content-length"]))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the records of the files that the manifest names.

    A revisit's payload is null. Digests of blocks and, for responses, of
    payloads are checked.
    """

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for pdf in batches:
            for name in pdf["file"]:
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if hashlib.sha1(block).hexdigest() != head["warc-block-digest"].removeprefix("sha1:") or payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a digest in {name} does not hold")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), head["warc-target-uri"], kind, int(head["x-payload-length"]), digest, number("x-refers-to-page"), payload))
                        if len(rows) >= 500:
                            yield pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return manifest.select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInPandas(get, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d JOIN k USING (payload_digest)
"""
