"""A persistent store of chunked, content-addressed files, on two boxes.

Metadata are JSON entries keyed by file id; a chunk's entry is keyed by file id and index and holds its CRC32 before its
bytes. Chunks are committed before the metadata that make their file visible.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import JsonCodec
from ..functions.entries import little_endian, number
from ..operators import chunks
from ..plans import log as logs
from ..schemas import FILE_DDL, IntegrityError
from .config import Config
from .store import Store

PLACES = 9  # digits of an index in a key


class BlobStore:
    def __init__(self, spark: SparkSession, path: str, size: int = chunks.DEFAULT_CHUNK, config: Config | None = None):
        self.spark, self.store, self.size = spark, Store(spark, path, config), chunks.chunk_size(size)
        self._files, self._chunks = self.store.box("files"), self.store.box("chunks")

    def put_files(self, blobs: DataFrame) -> DataFrame:
        """Store the contents (filename, mime_type, data, at) that are new; metadata of all contents of blobs.

        Of equal contents the first by at gives the name; a content that is there already keeps the name it has.
        """
        known = self.list_files()
        new = chunks.new_files(blobs, known)
        meta = chunks.files(new, self.size)
        order = F.monotonically_increasing_id()  # keys of one generation are distinct, so any order will do
        key = F.concat("file_id", F.lit("/"), F.lpad(F.col("index").cast("string"), PLACES, "0"))
        parts = chunks.split(new, self.size).select(key.alias("key"), F.concat(little_endian(F.col("crc32"), 4), F.col("data")).alias("value"))
        self._chunks.write(logs.puts(parts, F.col("key"), F.col("value"), order))
        entries = meta.select("file_id", F.to_json(F.struct(*meta.columns)).alias("value"))
        self._files.write(logs.puts(entries, F.col("file_id"), F.encode("value", "utf-8"), order))
        ids = blobs.select(F.sha2("data", 256).alias("file_id")).distinct()
        return self.list_files().join(ids, "file_id", "left_semi")

    def put_file(self, data: bytes, filename: str, mime_type: str = "application/octet-stream") -> str:
        """Store a file; its id, which it already has if its content is there."""
        file_id = sha256(data).hexdigest()
        if not self._files.exists(file_id):
            self.put_files(self.spark.createDataFrame([(filename, mime_type, bytearray(data), 0)], "filename string, mime_type string, data binary, at long"))
        return file_id

    def list_files(self) -> DataFrame:
        return self._files.live().select(JsonCodec(FILE_DDL).decode(F.col("value")).alias("f")).select("f.*")

    def chunks(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """file_id, index, data, crc32 of all chunks, or those of a range of keys, which reaches the scan."""
        query = self._chunks.query()
        entries = (query if start is None else query.range(start, end)).unordered()
        name = F.split(F.decode("key", "utf-8"), "/")
        value = F.col("value")
        return entries.select(name[0].alias("file_id"), name[1].cast("int").alias("index"), F.expr("substring(value, 5)").alias("data"), number(value, F.lit(0), 4).alias("crc32"))

    def _meta(self, file_id: str) -> DataFrame:
        return self.list_files().where(F.col("file_id") == file_id)

    def _parts(self, file_id: str, first: int = 0, last: int = 10**PLACES - 2) -> DataFrame:
        """The chunks first to last of a file."""
        return self.chunks(f"{file_id}/{first:0{PLACES}d}", f"{file_id}/{last + 1:0{PLACES}d}")

    @staticmethod
    def _data(found: DataFrame) -> bytes | None:
        """The bytes of the row that there is; IntegrityError where a checksum is wrong or a chunk is missing."""
        try:
            row = found.first()
        except Exception as e:
            if "chunk checksum mismatch" in str(e) or "chunk missing" in str(e):
                raise IntegrityError(str(e).splitlines()[0]) from e
            raise
        return bytes(row.data) if row else None

    def get_metadata(self, file_id: str) -> dict | None:
        row = self._meta(file_id).first()
        return row.asDict() if row else None

    def file_count(self) -> int:
        return self.list_files().count()

    def get_file(self, file_id: str) -> bytes | None:
        return self._data(chunks.assemble(self._parts(file_id), self._meta(file_id)))

    def read_chunk(self, file_id: str, index: int) -> bytes | None:
        return self._data(chunks.read_chunk(self._parts(file_id, index, index), file_id, index))

    def read_range(self, file_id: str, offset: int, length: int) -> bytes | None:
        meta = self.get_metadata(file_id)
        if meta is None or offset < 0 or length < 0:
            return self._data(chunks.read_range(self._parts(file_id), self._meta(file_id), offset, length))
        size = meta["chunk_size"]
        parts = self._parts(file_id, offset // size, max(offset, offset + length - 1) // size)
        return self._data(chunks.read_range(parts, self._meta(file_id), offset, length))

    def delete_file(self, file_id: str) -> bool:
        """Delete a file; whether it was there. Its metadata go first, then its chunks."""
        meta = self.get_metadata(file_id)
        if meta is None:
            return False
        self._files.delete(file_id)
        self._files.flush()
        self._chunks.batch_delete([f"{file_id}/{i:0{PLACES}d}" for i in range(meta["chunk_count"])])
        self._chunks.flush()
        return True
