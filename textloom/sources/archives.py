"""Members of ZIP archives as rows, read by ranges that are dealt over the cluster.

A first pass hands Python the end of each archive only, which holds its directory, and turns that into (archive, offset, size)
rows; archives with an unsafe member or too large a content are refused there, before anything is unpacked. A second pass cuts the
ranges out of the archives' bytes in the JVM and deals them out, so that members are unpacked and decoded by many tasks
whatever archive they come from.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import save

ZIP_BYTES = 1 << 30
TAIL = 1 << 20
FEW_MEMBERS = 100_000
MEMBER = "source_uri string, member string, at long, size long, packed long, unpacked long, method int, crc long"
#: Fixed values of the format: a local header's layout and signature, and the methods stored and deflated.
HEADER = "<4s5H3I2H"
SIGNATURE = b"PK\x03\x04"
STORED, DEFLATED = 0, 8


class Before(Exception):
    """The directory begins before the bytes at hand, at the place given."""


class _End(io.RawIOBase):
    """The last bytes of a file as a file; reading in front of them raises Before."""

    def __init__(self, size: int, tail: bytes):
        self.size, self.tail, self.place = size, tail, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def tell(self):
        return self.place

    def seek(self, offset, whence=0):
        place = offset + (0, self.place, self.size)[whence]
        if place < 0:
            raise OSError("negative place")
        self.place = place
        return place

    def read(self, n=-1):
        begin = self.place - (self.size - len(self.tail))
        if begin < 0:
            raise Before(self.place)
        got = self.tail[begin:] if n is None or n < 0 else self.tail[begin : begin + n]
        self.place += len(got)
        return got


def unsafe(name: str) -> bool:
    """Whether a member's path is absolute, has a drive or leaves the folder."""
    path = name.replace("\\", "/")
    return path.startswith("/") or path[1:2] == ":" or ".." in path.split("/")


def directory(uri: str, size: int, tail: bytes) -> list[tuple]:
    """MEMBER rows of an archive from its last bytes; Before if the directory begins in front of them.

    Each member's range ends where the next one, or the directory, begins. A ValueError names the archive that is broken,
    has an unsafe or encrypted member or one packed otherwise than deflated, or unpacks to more than ZIP_BYTES.
    """
    try:
        z = zipfile.ZipFile(_End(size, tail))
    except zipfile.BadZipFile as e:
        raise ValueError(f"{uri}: {e}") from e
    found = [i for i in z.infolist() if not i.is_dir()]
    if sum(i.file_size for i in found) > ZIP_BYTES:
        raise ValueError(f"{uri}: more than {ZIP_BYTES} bytes")
    ends = sorted({*(i.header_offset for i in z.infolist()), z.start_dir})
    after = dict(zip(ends, ends[1:]))
    rows = []
    for i in z.infolist():
        if unsafe(i.filename):
            raise ValueError(f"{uri}: unsafe member {i.filename}")
        if i.flag_bits & 1 or i.compress_type not in (STORED, DEFLATED):
            raise ValueError(f"{uri}: member {i.filename} cannot be read")
        if not i.is_dir():
            at = i.header_offset
            rows.append((uri, i.filename, at, after[at] - at, i.compress_size, i.file_size, i.compress_type, i.CRC))
    return rows


def members(files: DataFrame, tail: int = TAIL) -> DataFrame:
    """MEMBER rows of archives (path, length, content: binary). Where the ``tail`` bytes at an archive's end do not hold
    all that is read of it, the end of its directory first, then all of it, just those bytes are asked for again."""
    names = [c.split()[0] for c in MEMBER.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for uri, size, end in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "tail"))):
                try:
                    rows += directory(uri, size, end)
                except Before as e:  # not a member's name: a row that says from where on the bytes are needed
                    rows.append((uri, None, e.args[0], 0, 0, 0, 0, 0))
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def pass_over(rows):
        return save(rows.mapInArrow(run, MEMBER), "members")

    found = pass_over(files.select("path", "length", F.expr(f"substring(content, int(greatest(1, length - {tail} + 1)), {tail})").alias("tail")))
    parts = [found]
    while not (asked := found.where("member is null")).isEmpty():
        asked = asked.select(F.col("source_uri").alias("path"), F.col("at").alias("from"))
        again = files.join(F.broadcast(asked) if asked.count() <= FEW_MEMBERS else asked, "path")
        found = pass_over(again.select("path", "length", F.expr("substring(content, int(`from` + 1), int(length - `from`))").alias("tail")))
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("member is not null")


def unpack(raw: bytes, packed: int, unpacked: int, method: int, crc: int, name: str) -> bytes:
    """A member's content from its range; a ValueError if the range, length or checksum is wrong."""
    fixed = struct.calcsize(HEADER)
    head = struct.unpack_from(HEADER, raw) if len(raw) >= fixed else (b"",)
    if head[0] != SIGNATURE:
        raise ValueError(f"{name}: no local header")
    begin = fixed + head[9] + head[10]
    body = raw[begin : begin + packed]
    if method == DEFLATED:
        body = zlib.decompressobj(-15).decompress(body, unpacked + 1)
    if len(body) != unpacked or zlib.crc32(body) != crc:
        raise ValueError(f"{name}: length or checksum differs")
    return body


def archives(spark: SparkSession, path: str) -> DataFrame:
    """source_uri, member, text of the members of all ZIP archives below ``path``: UTF-8, or Latin-1 where that fails.

    Folders are no rows, empty members have an empty text. Any archive that directory() or unpack() refuses is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    found = members(files)
    n = found.count()
    per = found.groupBy(F.col("source_uri").alias("path")).agg(F.collect_list(F.struct("member", "at", "size", "packed", "unpacked", "method", "crc")).alias("all"))
    cut = files.select("path", "content").join(F.broadcast(per) if n <= FEW_MEMBERS else per, "path").select("path", "content", F.explode("all").alias("m"))
    raw = cut.select(F.col("path").alias("source_uri"), "m.*", F.expr("substring(content, int(m.at + 1), int(m.size))").alias("raw")).drop("at", "size")
    dealt = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_uri", "member")

    def run(batches):
        for batch in batches:
            out = []
            for member, packed, unpacked, method, crc, part in zip(*(batch.column(c).to_pylist() for c in ("member", "packed", "unpacked", "method", "crc", "raw"))):
                body = unpack(part, packed, unpacked, method, crc, member)
                try:
                    out.append(body.decode("utf-8-sig"))
                except UnicodeDecodeError:
                    out.append(body.decode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column("source_uri"), batch.column("member"), pa.array(out, pa.string())], ["source_uri", "member", "text"])

    return dealt.mapInArrow(run, "source_uri string, member string, text string")
