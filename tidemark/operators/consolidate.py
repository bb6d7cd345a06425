"""Many small files into few: bytes are joined at safe boundaries, not parsed."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import prefix_sum_by_unit, slices_for
from tidemark.runtime import hash_unit, shared_dir, staged
from tidemark.sources.frames import BrokenData, check_frames, pack_record, unpack_records

TARGET_BYTES = 128 << 20
FRAME_BYTES = 1 << 20
RUN_RECORDS = 1 << 16
BOM = b"\xef\xbb\xbf"

MANIFEST = "part string, source string, at bigint, length bigint, crc bigint, n_records bigint"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Piece:
    """The bytes of one file as they may follow another's, block by block.

    ``lines``: a leading byte-order mark and a first line equal to ``header``
    (ended by LF or CR LF) go, a missing last line end is added. ``zstd``: the
    bytes must be complete frames, which their headers tell, and stay as they
    are. Raises :class:`BrokenData` otherwise.
    """

    BLOCK = 8 << 20

    def __init__(self, handle, size: int, kind: str, header: bytes | None):
        self.handle, self.size, self.kind, self.header = handle, size, kind, header

    def blocks(self):
        if self.kind == "zstd":
            check_frames(self.handle, self.size)
            begin = 0
        else:
            begin = self._begin()
        self.handle.seek(begin)
        last = b"\n"
        while block := self.handle.read(self.BLOCK):
            last = block[-1:]
            yield block
        if self.kind == "lines" and last != b"\n":
            yield b"\n"

    def _begin(self) -> int:
        head = self.handle.read(len(BOM) + len(self.header or b"") + 2)
        at = len(BOM) if head.startswith(BOM) else 0
        if self.header is None or not head.startswith(self.header, at):
            return at
        after = at + len(self.header)
        for end in (b"\r\n", b"\n"):
            if head.startswith(end, after):
                return after + len(end)
        return after if after == self.size else at


def joinable(data: bytes, kind: str, header: bytes | None) -> bytes:
    """The bytes of one file as they may follow another's; see :class:`_Piece`."""
    return b"".join(_Piece(io.BytesIO(data), len(data), kind, header).blocks())


def _placed(sizes: DataFrame, rows: int, target: int) -> DataFrame:
    """``family, source, piece, part, u``: the part of each piece, from a running sum of sizes in the order of a hash.

    Only names and sizes go through the sum.
    """
    keyed = sizes.where("length > 0").withColumn("u", hash_unit("source", "piece", seed=4))
    summed = prefix_sum_by_unit(keyed, ["family"], "u", "source", "length", buckets=slices_for(rows))
    return summed.select("family", "source", "piece", F.floor(F.col("before") / target).cast("int").alias("part"), "u")


class _Parts:
    """Writes the parts of one task: each under a name of the attempt, then renamed, so a repeated task replaces it by equal bytes."""

    def __init__(self, out: str, extension: str, head: bytes):
        self.filesystem, self.folder = _filesystem(out)
        self.filesystem.create_dir(self.folder, recursive=True)
        self.extension, self.head = extension, head
        self.now, self.stream, self.at, self.temporary = None, None, 0, ""

    def add(self, family: str | None, part: int, blocks) -> tuple[str, int, int, int]:
        """Append blocks of bytes to a part: its name, where they begin, their length and CRC-32."""
        name = f"{family if family is not None else '__null'}-{part:05d}{self.extension}"
        if name != self.now:
            self.close()
            self.now, self.temporary = name, f"{self.folder}/.{name}.{uuid.uuid4().hex}"
            self.stream = self.filesystem.open_output_stream(self.temporary)
            self.stream.write(self.head)
            self.at = len(self.head)
        begin, crc = self.at, 0
        for block in blocks:
            self.stream.write(block)
            crc = zlib.crc32(block, crc)
            self.at += len(block)
        return name, begin, self.at - begin, crc

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.filesystem.move(self.temporary, f"{self.folder}/{self.now}")
            self.stream = None


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["part", "source", "at", "length", "crc", "n_records"])


def _write_parts(pieces: DataFrame, out: str, target: int) -> DataFrame:
    """Write pieces ``(family, source, piece, n_records, body)`` to parts of about ``target`` bytes; returns the manifest."""
    sizes = pieces.select("family", "source", "piece", F.octet_length("body").cast("bigint").alias("length"))
    placed = _placed(sizes, pieces.count(), target).withColumnsRenamed({c: f"{c}_p" for c in ("family", "source", "piece")})
    joined = pieces.join(placed, (F.col("source") == F.col("source_p")) & (F.col("piece") == F.col("piece_p")) & F.col("family").eqNullSafe(F.col("family_p")))
    ordered = joined.select("family", "part", "u", "source", "n_records", "body").repartition("family", "part").sortWithinPartitions("family", "part", "u", "source")

    def run(batches):
        parts = _Parts(out, ".zst", b"")
        for b in batches:
            rows = []
            for family, part, _, source, n, body in zip(*[c.to_pylist() for c in b.columns]):
                name, at, length, crc = parts.add(family, part, (body,))
                rows.append((name, source, at, length, crc, n))
            yield _manifest_batch(rows)
        parts.close()

    return staged(ordered.mapInArrow(run, MANIFEST), "manifest")


def _slices(manifest: DataFrame, out: str, schema: str, decode) -> DataFrame:
    """Read every slice a manifest names, check it, and decode it to a record batch."""
    ordered = manifest.withColumn("slice", F.floor(F.col("at") / F.lit(32 << 20))).repartition("part", "slice").sortWithinPartitions("part", "at").drop("slice")

    def run(batches):
        filesystem, folder = _filesystem(out)
        now, handle = None, None
        for b in batches:
            got = []
            for part, source, at, length, crc, n in zip(*[c.to_pylist() for c in b.columns]):
                if part != now:
                    if handle is not None:
                        handle.close()
                    now, handle = part, filesystem.open_input_file(f"{folder}/{part}")
                body = handle.read_at(length, at)
                if len(body) != length or zlib.crc32(body) != crc:
                    raise BrokenData(f"{part}: {length} bytes at {at} differ from the manifest")
                got.append((part, source, n, body))
            if got:
                yield from decode(got)
        if handle is not None:
            handle.close()

    return ordered.select("part", "source", "at", "length", "crc", "n_records").mapInArrow(run, schema)


def concatenate_files(spark: SparkSession, paths: str | list[str], out: str, kind: str = "lines", header: str | None = None, target: int = TARGET_BYTES) -> DataFrame:
    """Join small files into parts of about ``target`` bytes below ``out``; returns the manifest.

    ``kind`` is ``lines`` (newline-delimited; ``header`` is a first line that
    every file may have, ended by LF or CR LF, and each part gets once) or
    ``zstd`` (complete Zstandard frames, whose joint bytes are again valid).
    Contents are neither parsed nor moved between tasks: names and sizes decide
    which part a file goes to, and the part's task copies the files' bytes in
    blocks, so a file may have any size. The manifest has one row per file that
    adds bytes: part, source path, offset, length, CRC-32. The parts' lengths
    and checksums are checked against it. Files of one folder form a family of
    parts, named by the folder and a hash of its path; empty files add nothing.
    Raises :class:`BrokenData` on cut-off frames.
    """
    first = None if header is None else header.encode()
    extension = {"lines": ".txt", "zstd": ".zst"}[kind]
    parent = F.regexp_replace("path", "/[^/]*$", "")
    files = spark.read.format("binaryFile").load(paths).select("path", "length")  # contents are not read here
    sizes = files.select(F.concat(F.element_at(F.split(parent, "/"), -1), F.lit("-"), F.substring(F.md5(parent), 1, 8)).alias("family"), F.col("path").alias("source"), F.lit(0).alias("piece"), "length")
    sizes = staged(sizes, "sizes")
    head = b"" if first is None or kind == "zstd" else first + b"\n"
    placed = _placed(sizes, sizes.count(), target).join(sizes.select("source", "length"), "source")
    ordered = placed.select("family", "part", "u", "source", "length").repartition("family", "part").sortWithinPartitions("family", "part", "u", "source")

    def run(batches):
        parts = _Parts(out, extension, head)
        for b in batches:
            rows = []
            for family, part, _, source, size in zip(*[c.to_pylist() for c in b.columns]):
                filesystem, path = _filesystem(source)
                with filesystem.open_input_file(path) as handle:
                    name, at, length, crc = parts.add(family, part, _Piece(handle, size, kind, first).blocks())
                if length:
                    rows.append((name, source, at, length, crc, None))
            yield _manifest_batch(rows)
        parts.close()

    manifest = staged(ordered.mapInArrow(run, MANIFEST), "manifest")
    verify_parts(manifest, out, len(head))
    return manifest


def verify_parts(manifest: DataFrame, out: str, head: int = 0) -> None:
    """Raise :class:`BrokenData` unless every part is as long as its slices together and each slice has its checksum."""
    filesystem, folder = _filesystem(out)
    lengths = manifest.groupBy("part").agg(F.sum("length").alias("n"))

    def sizes(batches):
        own, where = _filesystem(out)
        for b in batches:
            for part, n in zip(*[c.to_pylist() for c in b.columns]):
                if (size := own.get_file_info(f"{where}/{part}").size) != n + head:
                    raise BrokenData(f"{part} has {size} bytes, not {n + head}")
            yield b.select([0])

    lengths.mapInArrow(sizes, "part string").write.format("noop").mode("overwrite").save()
    _slices(manifest, out, "n bigint", lambda got: [pa.RecordBatch.from_arrays([pa.array([len(got)], pa.int64())], ["n"])]).write.format("noop").mode("overwrite").save()


def _content_hash() -> Column:
    """SHA-256 of a record's key and data, null apart from empty."""

    def framed(col: Column) -> Column:
        size = F.octet_length(col).cast("string")
        return F.coalesce(F.concat(F.concat(F.lit("+"), size, F.lit(":")).cast("binary"), col.cast("binary")), F.lit(b"-"))

    return F.unhex(F.sha2(F.concat(framed(F.col("datum_key")), framed(F.col("data"))), 256))


def _hash_of(key: str | None, data: bytes | None) -> bytes:
    """The same in Python."""
    parts = [b"-" if v is None else b"+%d:" % len(v) + v for v in (None if key is None else key.encode(), data)]
    return hashlib.sha256(b"".join(parts)).digest()


def _listed(files: DataFrame) -> DataFrame:
    return files.where("file_id is not null").groupBy("file_id").agg(F.min("db_name").alias("db_name"))


def superfluous(records: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, rec_no, hash, keep``: the positions of records that have to go, or (``keep`` is 1) of which one of several equal ones stays.

    Records are equal if the ``db_name`` of their files, ``datum_key`` and
    ``data`` agree, null with null. Of these the smallest ``(file_id, rec_no)``
    stands. Files listed repeatedly count once (the smallest ``db_name`` of a
    file listed under several). Only positions and 256-bit hashes are moved,
    and they are aggregated before the shuffle.
    """
    rows = records.select("file_id", "rec_no", _content_hash().alias("hash")).join(_listed(files), "file_id", "left")
    places = rows.groupBy("db_name", "hash", "file_id", "rec_no").agg(F.count(F.lit(1)).alias("times"))
    groups = places.groupBy("db_name", "hash").agg(F.min(F.struct("file_id", "rec_no")).alias("first"), F.sum("times").alias("n")).where("n > 1").select(F.col("db_name").alias("db"), F.col("hash").alias("h"), "first")
    found = places.join(groups, F.col("db_name").eqNullSafe(F.col("db")) & (F.col("hash") == F.col("h")))
    stays = F.struct("file_id", "rec_no").eqNullSafe(F.col("first"))
    return found.where(~stays | (F.col("times") > 1)).select("file_id", "rec_no", "hash", stays.cast("int").alias("keep"))


def stored_frames(records: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``file_id, run, piece, n_records, earlier, body``: the stored files as complete Zstandard frames with checksum, all their records in order.

    A run of record numbers is the unit of a task, so one huge file is no single
    task's. ``earlier`` has the hashes of what stands at a frame's first
    position in the frames before it, if a position that is stored repeatedly
    was cut there.
    """
    run_of = F.floor(F.col("rec_no") / RUN_RECORDS).cast("int").alias("run")
    rows = records.select("file_id", run_of, "rec_no", "datum_key", "label", "data").repartition("file_id", "run").sortWithinPartitions("file_id", "run", "rec_no", "label")

    def run(batches):
        packer = _packer()
        now, piece, size, held, earlier = None, 0, 0, [], []
        last, seen = (None, None, None), set()
        done: list[tuple] = []

        def flush() -> None:
            nonlocal piece, size, held, earlier
            if held:
                done.append((*now, piece, len(held), earlier, packer.compress(b"".join(held))))
                piece, size, held, earlier = piece + 1, 0, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            done.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file_id", "run", "piece", "n_records", "earlier", "body"])

        for b in batches:
            for file_id, run_no, rec_no, key, label, data in zip(*[c.to_pylist() for c in b.columns]):
                if (file_id, run_no) != now:
                    flush()
                    now, piece = (file_id, run_no), (run_no or 0) * RUN_RECORDS
                    last = (None, None, None)
                if rec_no == last[0]:
                    seen.add(_hash_of(*last[1:]))
                    if not held:
                        earlier = list(seen)
                else:
                    seen = set()
                last = (rec_no, key, data)
                held.append(pack_record(file_id, rec_no, label, key, data))
                size += len(held[-1])
                if size >= frame_bytes:
                    flush()
            yield batch()
        flush()
        yield batch()

    return rows.mapInArrow(run, "file_id bigint, run int, piece bigint, n_records bigint, earlier array<binary>, body binary")


def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)


def without_superfluous(frames: DataFrame, drops: DataFrame, files: DataFrame) -> DataFrame:
    """``family, source, piece, n_records, decoded, body``: frames of which superfluous records are gone.

    Frames of runs without such records pass as the bytes they are. The others
    are decoded (``decoded`` records) and, if anything goes, packed anew.
    """
    run_of = F.floor(F.col("rec_no") / RUN_RECORDS).cast("int").alias("run_d")
    listed = drops.select(F.col("file_id").alias("file_d"), run_of, F.struct("rec_no", "hash", "keep").alias("d")).groupBy("file_d", "run_d").agg(F.collect_list("d").alias("drops"))
    joined = frames.join(listed, (F.col("file_id") == F.col("file_d")) & (F.col("run") == F.col("run_d")), "left").join(_listed(files), "file_id", "left")

    def run(batches):
        packer, unpacker = _packer(), zstandard.ZstdDecompressor()
        for b in batches:
            counts, decoded, bodies = [], [], []
            for n, earlier, body, drops in zip(*[b.column(i).to_pylist() for i in range(3, 7)]):
                read = 0
                if drops:
                    going = {(d["rec_no"], d["hash"]): d["keep"] for d in drops}
                    numbers = {rec_no for rec_no, _ in going}
                    records = unpack_records(unpacker.decompress(body))
                    read, kept = len(records), []
                    going |= {(records[0][1], h): 0 for h in earlier if (records[0][1], h) in going}
                    for r in records:
                        if r[1] in numbers:
                            at = (r[1], _hash_of(r[3], r[4]))
                            left = going.get(at, 1)
                            if at in going:
                                going[at] = 0
                            if not left:
                                continue
                        kept.append(r)
                    if len(kept) < len(records):
                        n, body = len(kept), packer.compress(b"".join(pack_record(*r) for r in kept))
                counts.append(n)
                decoded.append(read)
                bodies.append(body)
            rest = pa.array([n > 0 for n in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(decoded, pa.int64()), pa.array(bodies, pa.binary())], ["family", "source", "piece", "n_records", "decoded", "body"]).filter(rest)

    source = F.col("file_id").cast("string").alias("source")
    return joined.select(F.col("db_name").alias("family"), source, "piece", "n_records", "earlier", "body", "drops").mapInArrow(run, "family string, source string, piece bigint, n_records bigint, decoded bigint, body binary")


def consolidate_records(records: DataFrame, files: DataFrame, out: str | None = None, target: int = TARGET_BYTES, frame_bytes: int = FRAME_BYTES) -> tuple[DataFrame, str]:
    """Write every distinct record of tiny files into few large files; returns the manifest and their folder.

    The stored files are complete Zstandard frames (:func:`stored_frames`), and
    parts are frames one after the other, joined byte by byte; so any part is
    itself a valid Zstandard file and any frame can be read alone by its offset.
    Only files that hold a superfluous record (:func:`superfluous`) are decoded.
    One family of parts for each ``db_name``.

    Null and empty data and null labels are kept as they are. A record whose
    file is not listed belongs to the null database. A position that is stored
    repeatedly with equal key and data counts once, with its smallest label,
    null before any. Empty tables give an empty manifest.
    """
    spark = records.sparkSession
    out = out or f"{shared_dir(spark)}/tidemark/consolidated-{uuid.uuid4().hex}"
    frames = stored_frames(records, frame_bytes)
    pieces = staged(without_superfluous(frames, superfluous(records, files), files), "frames")
    return _write_parts(pieces, out, target), out


def read_consolidated(manifest: DataFrame, out: str) -> DataFrame:
    """The records of consolidated parts: ``file_id, rec_no, datum_key, label, data``.

    Every slice is held against the manifest's length and checksum, every frame
    against its own checksum and its number of records; a difference raises
    :class:`BrokenData`.
    """

    def decode(got):
        unpacker = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        for part, _, n, body in got:
            records = unpack_records(unpacker.decompress(body))
            if len(records) != n:
                raise BrokenData(f"{part}: a frame has {len(records)} records, not {n}")
            rows += records
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
        c = [pa.array(v, t) for v, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([c[0], c[1], c[3], c[2], c[4]], ["file_id", "rec_no", "datum_key", "label", "data"])

    return _slices(manifest, out, "file_id bigint, rec_no int, datum_key string, label int, data binary", decode)
