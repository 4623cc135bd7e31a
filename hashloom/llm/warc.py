"""WARC archives: a Python data source that writes and reads them.

Writing.  Records are made by DataFrame expressions; the source's writer puts each into a
gzip member of its own, as the WARC standard advises, and beside the archive an index: a
Parquet file with the offset, length and header columns of each record.  A task writes
files under names of its own in ``_staging``; the driver moves them into place once all tasks are
done, so what a lost or repeated task leaves is never read.  Of records with equal
payloads of at least ``min_bytes``, that with the smallest id is a ``response``; the others
are ``revisit`` records, which keep the HTTP head (so the payload's length) and the digest,
and name the response in ``WARC-Refers-To``.

Reading.  ``spark.read.format("hashloom_warc").load(path)``.  An indexed archive is cut
into byte ranges of ``splitBytes``, a partition each; filters on the record type and on
header columns are pushed down to the index, and only the members of records that pass are read
and inflated.  An archive without index is one partition: a record's head is parsed first,
and the block of a record that no filter wants is skipped, not decoded.
``option("payload", "false")`` skips all blocks but for the HTTP head; of an indexed record
nothing behind that head is inflated.

Defined cases: a null payload is empty; a null id or URL has no header and reads back as
null; rows that repeat one another in id and payload make a record each, all of one type;
an empty table makes an archive of no records; very long payloads are whole; line breaks in
header values become spaces; columns named as results are replaced, other columns aren't
written.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from hashloom.llm.shared import spread_join, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, content_length long, http_length long, payload binary"
)
#: Header of each column that a filter can be pushed down to.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 32 letters with no padding."""
    digest = F.sha1(binary)
    # 5 hex digits are 20 bits, that is 4 letters.
    quads = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda x, by: F.substring(F.lit(ALPHABET), F.shiftright(x, by).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(quads, lambda x: F.concat(*[letter(x, by) for by in (15, 10, 5, 0)])), "")


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` plus payload (string, never null), payload_bytes, payload_digest,
    record_type and refers_to (the id of the response that a revisit repeats)."""
    digested = pages.drop("record_type", "refers_to").withColumns({"payload": F.coalesce(F.col(payload_col).cast("string"), F.lit(""))})
    digested = digested.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    big = digested.filter(F.col("payload_bytes") >= min_bytes)
    first = big.groupBy("payload_digest").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A digest may be that of a third of all pages.
    told = spread_join(digested, written(first, "digests"), ["payload_digest"], "n", [id_col])
    again = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return told.select(
        *digested.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__first")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes what :func:`with_revisits` returns as WARC/1.1 files in ``path``."""

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    columns = {
        "record_id": _record_id(F.col(id_col)),
        "record_type": F.col("record_type"),
        "target_uri": F.col(url_col),
        "date": F.lit(date),
        "payload_digest": F.col("payload_digest"),
        "refers_to": F.when(revisit, _record_id(F.col("refers_to"))),
    }
    # As they read back: a header is one line, without blanks around its value.
    columns = {c: F.trim(F.regexp_replace(v, r"[\r\n]+", " ")) for c, v in columns.items()}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        header("WARC-Type", columns["record_type"]),
        header("WARC-Record-ID", columns["record_id"]),
        header("WARC-Date", columns["date"]),
        header("WARC-Target-URI", columns["target_uri"]),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), columns["payload_digest"])),
        header("WARC-Refers-To", columns["refers_to"]),
        F.when(revisit, header("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(EOL * 2),
    )
    rows = records.select(F.concat(head, block, F.lit(EOL * 2)).cast("binary").alias("record"), *[v.alias(c) for c, v in columns.items()])
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("hashloom_warc").mode("append").option("compression", compression).save(path)


def _record_id(col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), col.cast("string"), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The id that a record id of :func:`write_warc` was made of."""
    return F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1)


# -- writing ----------------------------------------------------------------------------


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    """Rows are (record, header columns); a task makes one archive and its index."""

    ROWS = 1 << 14  # of the index held at a time

    def __init__(self, options: dict):
        self.path, self.compression = options["path"], options.get("compression", "gzip")
        if self.compression not in ("gzip", "none"):
            raise ValueError(f"compression is gzip or none, not {self.compression!r}")
        self.staging = f"{self.path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        schema = pa.schema([("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in HEADERS)])
        system, folder = _opened(self.staging)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compression == 'gzip' else ''}"
        batch = next(iterator, None)
        while batch is not None and not batch.num_rows:
            batch = next(iterator, None)
        if batch is None:
            return Written(None)
        system.create_dir(folder, recursive=True)
        at, held = 0, []
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out, pq.ParquetWriter(f"{folder}/{index_of(name)}", schema, filesystem=system) as index:
            while batch is not None:
                heads = batch.select(list(HEADERS)).to_pylist()
                for record, fields in zip(batch.column("record"), heads, strict=True):
                    data = record.as_py()
                    if self.compression == "gzip":
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = deflate.compress(data) + deflate.flush()
                    out.write(data)
                    held.append({"offset": at, "length": len(data)} | fields)
                    at += len(data)
                    if len(held) >= self.ROWS:
                        index.write_table(pa.Table.from_pylist(held, schema))
                        held = []
                batch = next(iterator, None)
            index.write_table(pa.Table.from_pylist(held, schema))
        return Written(name)

    def commit(self, messages) -> None:
        system, folder = _opened(self.staging)
        target = _opened(self.path)[1]
        system.create_dir(target, recursive=True)
        for m in messages:
            if m is not None and m.name:
                # The index first: an archive that is seen has its index.
                for name in (index_of(m.name), m.name):
                    system.move(f"{folder}/{name}", f"{target}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _opened(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def index_of(name: str) -> str:
    """The index of an archive; files that begin so are not archives."""
    return f"_{name}.index.parquet"


# -- reading --------------------------------------------------------------------------


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return system, path


class _Stream:
    """Forward reads over a plain or gzipped file, block by block; gzip members may follow
    one another."""

    CHUNK = 1 << 20

    def __init__(self, raw, gz: bool, step: int = CHUNK):
        self.raw, self.gz, self.step, self.buf, self.at = raw, gz, step, b"", 0
        self.inflate = zlib.decompressobj(31) if gz else None

    def _more(self) -> bytes:
        if not self.gz:
            return self.raw.read(self.CHUNK)
        # No more than a step at a time, as a few bytes may inflate to a thousand times as many.
        while data := self.inflate.unconsumed_tail or self.inflate.unused_data or self.raw.read(self.CHUNK):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if out := self.inflate.decompress(data, self.step):
                return out
        # What was taken in may still hold back its last bytes.
        return b"" if self.inflate.eof else self.inflate.flush()

    def _fill(self, n: int) -> bool:
        parts, have = [self.buf[self.at :]], len(self.buf) - self.at
        while have < n and (data := self._more()):
            parts.append(data)
            have += len(data)
        self.buf, self.at = b"".join(parts), 0
        return have >= n

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and without ``mark``; None at the end of the file."""
        looked = self.at
        while (i := self.buf.find(mark, looked)) < 0:
            behind = max(0, len(self.buf) - self.at - len(mark) + 1)
            before = len(self.buf) - self.at
            self._fill(before + 1)
            if len(self.buf) == before:
                return None
            looked = behind
        out, self.at = self.buf[self.at : i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        if len(self.buf) - self.at < n and not self._fill(n):
            raise EOFError("a record ends before its Content-Length")
        out, self.at = self.buf[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        while n > (have := len(self.buf) - self.at):
            n -= have
            self.buf, self.at = self._more(), 0
            if not self.buf:
                raise EOFError("a record ends before its Content-Length")
        self.at += n


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(EOL)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class WarcPartition(InputPartition):
    """An archive, or of an indexed one the records that begin in [begin, end)."""

    def __init__(self, uri: str, begin: int = 0, end: int | None = None):
        self.uri, self.begin, self.end = uri, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.split_bytes = int(options.get("splitBytes", 64 << 20))
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, "in", {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, "in", set(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, "set", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        out = []
        for uri in self.path.split(","):
            system, path = _opened(uri)
            info = system.get_file_info(path)
            files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
            scheme = uri[: uri.index("://") + 3] if "://" in uri else "file://"
            host = uri[len(scheme) :].split("/", 1)[0] if "://" in uri and scheme != "file://" else ""
            parent = info.path.rsplit("/", 1)[0]
            have = {f.path for f in (system.get_file_info(fs.FileSelector(parent)) if files == [info] else files)}
            for f in files:
                inside = f.path[len(info.path) :].split("/")
                if f.type == fs.FileType.File and f.size and not any(x.startswith(("_", ".")) for x in [*inside, f.base_name]):
                    at = f"{scheme}{host}{f.path if f.path.startswith('/') or not host else '/' + f.path}"
                    if f"{f.path.rsplit('/', 1)[0]}/{index_of(f.base_name)}" in have:
                        out += [WarcPartition(at, k, k + self.split_bytes) for k in range(0, f.size, self.split_bytes)]
                    else:
                        out.append(WarcPartition(at))
        return sorted(out, key=lambda p: (p.uri, p.begin))

    def wants(self, columns: dict) -> bool:
        for column, how, value in self.wanted:
            got = columns[column]
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(x.strip().split()[0], types[x.strip().split()[1]]) for x in SCHEMA.split(",")])
        yield from self._batches(self._records(partition), schema)

    def _records(self, partition: WarcPartition) -> Iterator[tuple[dict, int]]:
        if partition is None:  # Spark's one partition of a folder without archives
            return
        system, path = _opened(partition.uri)
        if partition.end is not None:
            yield from self._indexed(system, path, partition)
            return
        with system.open_input_stream(path, compression=None) as raw:
            gz = raw.read(2) == b"\x1f\x8b"
        with system.open_input_stream(path, compression=None) as raw:
            stream = _Stream(raw, gz)
            while (row := self._record(stream)) is not None:
                if row:
                    yield row

    def _indexed(self, system, path: str, partition: WarcPartition) -> Iterator[tuple[dict, int]]:
        """Records whose index row passes: no other is read."""
        import pyarrow.parquet as pq

        folder, name = path.rsplit("/", 1)
        # Of the index: the columns that filters need, and row groups of the range.
        need = ["offset", "length", *dict.fromkeys(c for c, _, _ in self.wanted)]
        step = _Stream.CHUNK if self.payload else 1 << 12
        with system.open_input_file(path) as data, system.open_input_file(f"{folder}/{index_of(name)}") as index:
            table = pq.ParquetFile(index)
            at = table.schema_arrow.get_field_index("offset")
            for g in range(table.num_row_groups):
                stats = table.metadata.row_group(g).column(at).statistics
                if not stats or stats.min >= partition.end or stats.max < partition.begin:
                    continue
                rows = table.read_row_group(g, columns=need).to_pylist()
                some = [(r["offset"], r["length"]) for r in rows if partition.begin <= r["offset"] < partition.end and self.wants(r)]
                for begin, lengths in _runs(some, self.batch_bytes):
                    data.seek(begin)
                    block, k = data.read(sum(lengths)), 0
                    for n in lengths:
                        member = block[k : k + n]
                        k += n
                        if row := self._record(_Stream(io.BytesIO(member), member[:2] == b"\x1f\x8b", step)):
                            yield row

    def _record(self, stream: _Stream) -> tuple[dict, int] | None:
        """The next record's columns and bytes held, () if no filter wants it, None at the end."""
        head = b""
        while not head:
            if (head := stream.until(b"\r\n\r\n")) is None:
                return None
            head = head.lstrip(b"\r\n")
        fields = parse_head(head)
        columns = {c: fields.get(h) for c, h in HEADERS.items()}
        digest = columns["payload_digest"]
        columns["payload_digest"] = digest.partition(":")[2] if digest and ":" in digest else digest
        length = int(fields["content-length"])
        if not self.wants(columns):
            stream.skip(length)
            return ()
        columns |= {"content_length": length, "http_length": None, "payload": None}
        left = length
        if fields.get("content-type", "").startswith("application/http"):
            http = stream.until(b"\r\n\r\n") or b""
            left = length - len(http) - 4
            for line in http.split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    columns["http_length"] = int(v)
        if self.payload and columns["record_type"] != "revisit":
            columns["payload"] = stream.take(left)
            return columns, left + 400
        if stream.step == stream.CHUNK:  # else the record is alone in its stream
            stream.skip(left)
        return columns, 400

    def _batches(self, records: Iterator[tuple[dict, int]], schema) -> Iterator:
        import pyarrow as pa

        rows, held = [], 0
        for columns, n in records:
            rows.append(columns)
            held += n
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _runs(places: list[tuple[int, int]], most: int) -> Iterator[tuple[int, list[int]]]:
    """(offset, lengths) of neighbours in the file, together at most ``most`` bytes or one record."""
    begin, lengths, end = 0, [], -1
    for at, n in places:
        if lengths and (at != end or end - begin + n > most):
            yield begin, lengths
            lengths = []
        if not lengths:
            begin = at
        lengths.append(n)
        end = at + n
    if lengths:
        yield begin, lengths


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hashloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of the archives in ``path``; registers the source with the session and
    turns on the push-down of filters to Python sources, which Spark has off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("hashloom_warc").options(**options).load(path)
