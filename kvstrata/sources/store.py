"""Store and Box: persistent logs of mutations on generations of sorted Parquet.

Each write is one generation, visible all at once when its manifest version is committed; readers keep the version
that they began with. Small writes may be buffered (sync_writes false) until flush, close or memtable_size bytes; they
leave the buffer once they are committed. Where another writer commits first, a write is made again on its version.

Beside each generation of mutations lie its events (without values), which move into the box's feed after the commit.
What a crash leaves between the two is moved before the next commit or read of the feed. Merged generations and runs
that were never committed are no events.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import Codec
from ..operators import lookup
from ..plans.log import Batch
from ..plans.query import KVQuery
from ..plans.snapshot import latest, live
from ..schemas import CHANGE_TYPES, CLEAR, EVENT_DDL, LOG_DDL, PUT, CommitConflict, box_name, to_bytes
from ..streaming import watch
from .config import Config
from .files import Files
from .manifest import Generation, Manifest, Version

#: Times that a write is made again where other writers commit first.
ATTEMPTS = 5
#: Seconds after which a run that no version lists is taken for that of a dead writer.
AGE = 24 * 3600


class Box:
    """One collection. Keys and values are bytes or strings; get() and the like return what was stored, or None."""

    def __init__(self, spark: SparkSession, root: str, name: str, config: Config):
        self.spark, self.name, self.config = spark, box_name(name), config
        self.path = f"{root}/{self.name}"
        self._files = Files(spark)
        self._manifest = Manifest(self._files, self.path)
        self._buffer, self._bytes = Batch(), 0
        self._files.make_directory(f"{self.path}/feed")

    # writes

    def _retried(self, attempt: Callable[[Version], Any]) -> Any:
        """What attempt makes of the present version; again on the newer one where another writer was faster."""
        for left in reversed(range(ATTEMPTS)):
            try:
                return attempt(self._manifest.latest())
            except CommitConflict:
                if not left:
                    raise

    def _appended(self, log: DataFrame, version: Version, sort: bool = True, parts: int | None = None, **changes: Any) -> Generation:
        """Write and commit a log (its seq counted from 0) on top of a version; without rows only the changes, if any."""
        shifted = log.select(F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"), (F.col("seq") + version.next_seq).cast("long").alias("seq"))
        generation = self._generation(shifted, version, unique=False, sort=sort, parts=parts)
        if generation.entries:
            last = max(version.next_seq, generation.max_seq + 1)
            self._commit(replace(version, number=version.number + 1, next_seq=last, next_gen=version.next_gen + 1, generations=(*version.generations, generation), **changes), generation)
            return generation
        self._drop(generation)
        if changes:
            self._commit(replace(version, number=version.number + 1, **changes))
        return generation

    def write(self, log: DataFrame, sort: bool = True, parts: int | None = None) -> Generation:
        """Commit a frame (key, op, value, seq) as one generation; seq orders its rows and is counted on from the box's last."""
        generation = self._retried(lambda version: self._appended(log, version, sort, parts))
        self._trigger()
        return generation

    def ingest(self, mutations: DataFrame, checkpoint: str, name: str = "ingest", milliseconds: int | None = None):
        """Write a stream of mutations (key, op, value, seq), one generation a micro-batch; returns the running query.

        seq orders the mutations of a micro-batch; micro-batches follow one another. A micro-batch that is run again
        after a failure is not written twice, as its number is committed with it. None: until the stream has no more.
        """

        def deliver(batch: DataFrame, number: int) -> None:
            def attempt(version: Version) -> None:
                if version.batches.get(name, -1) < number:
                    self._appended(batch, version, batches=version.batches | {name: number})

            self._retried(attempt)
            self._trigger()

        writer = mutations.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if milliseconds is None else writer.trigger(processingTime=f"{milliseconds} milliseconds")).start()

    def _generation(self, log: DataFrame, version: Version, unique: bool, sort: bool = True, parts: int | None = None) -> Generation:
        """Write a run and, unless it is a merged one (unique), its events beside the feed. Nothing lists them yet."""
        path = f"{self.path}/gen-{version.next_gen:08d}-{uuid.uuid4().hex}"
        out = log.withColumn("gen", F.lit(version.next_gen).cast("long"))
        if sort:
            by = ([parts] if parts else []) + ["key", "seq"]
            out = out.repartitionByRange(*by).sortWithinPartitions("key", "seq")
        elif parts:
            out = out.coalesce(parts)
        out.write.options(**self.config.write_options()).parquet(path)
        run = self.spark.read.schema(LOG_DDL).options(**self.config.read_options()).parquet(path)
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        row = run.agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum(size).alias("bytes")).first()
        if not unique and row.n:
            watch.events(run, self.name).write.parquet(self._staged(path))
        return Generation(version.next_gen, path, row.lo if row.n else 0, row.hi if row.n else 0, row.n, row.bytes or 0, unique)

    def _staged(self, run: str) -> str:
        return f"{self.path}/feed/.{run.rsplit('/', 1)[1]}"

    def _drop(self, generation: Generation) -> None:
        self._files.delete(generation.path)
        self._files.delete(self._staged(generation.path))

    def _commit(self, version: Version, *fresh: Generation) -> Version:
        """Publish a version, then the events of its fresh runs; these are deleted where another writer was faster."""
        self._publish()
        try:
            done = self._manifest.commit(version, uuid.uuid4().hex)
        except CommitConflict:
            for generation in fresh:
                self._drop(generation)
            raise
        self._publish(done)
        return done

    def _publish(self, version: Version | None = None) -> None:
        """Move the events of all committed runs into the feed: those of the last commit, and what a crash left."""
        waiting = {n[1:] for n in self._files.names(f"{self.path}/feed") if n.startswith(".gen-")}
        if waiting:
            version = version or self._manifest.latest()
            listed = {g.path.rsplit("/", 1)[1] for g in version.generations}
            for name in sorted(waiting & (listed | {version.cleared})):
                self._files.rename(f"{self.path}/feed/.{name}", f"{self.path}/feed/{name}")

    def _trigger(self) -> None:
        """Compact if the settings ask for it and there are enough generations."""
        if self.config.auto_compaction and self.config.compaction_enabled and self.segment_count() >= self.config.compaction_threshold:
            self.compact()

    def batch(self, operations: Batch) -> None:
        """All operations in order, in one generation; an empty batch does nothing."""
        if operations.is_empty:
            return
        if self.config.sync_writes:
            self.flush()
            self.write(operations.to_df(self.spark), sort=len(operations) > 1, parts=self.config.worker_threads if len(operations) > 1 else 1)
            return
        self._buffer = Batch([*self._buffer.operations, *operations.operations])
        self._bytes += sum(len(to_bytes(k)) + len(to_bytes(v or b"")) for _, k, v in operations.operations)
        if self._bytes >= self.config.memtable_size:
            self.flush()

    def put(self, key: str | bytes, value: str | bytes) -> None:
        self.batch(Batch().put(key, value))

    put_bytes = put

    def delete(self, key: str | bytes) -> None:
        self.batch(Batch().delete(key))

    delete_bytes = delete

    def batch_put(self, entries: dict | Iterable[tuple]) -> None:
        self.batch(Batch().put_all(entries))

    batch_put_bytes = batch_put_strings = batch_put

    def batch_delete(self, keys: Iterable[str | bytes]) -> None:
        self.batch(Batch([("delete", k, None) for k in keys]))

    batch_delete_bytes = batch_delete

    def put_json(self, key: str, value: Any) -> None:
        self.put(key, json.dumps(value, ensure_ascii=False))

    def batch_put_json(self, entries: dict) -> None:
        self.batch_put({k: json.dumps(v, ensure_ascii=False) for k, v in entries.items()})

    def put_objects(self, rows: DataFrame, key: Column, value: Column, codec: Codec, seq: Column) -> Generation:
        """Encoded values of a frame as puts, in one generation."""
        self.flush()
        return self.write(rows.select(key.cast("binary").alias("key"), F.lit(PUT).alias("op"), codec.encode(value).alias("value"), seq.cast("long").alias("seq")))

    def update(self, key: str | bytes, updater: Callable[[bytes | None], str | bytes]) -> bytes:
        """Put what updater makes of the present value. Another writer's commit in between makes it read again."""

        def attempt(version: Version) -> bytes:
            value = to_bytes(updater(self._value(self._log(version), key)))
            self._appended(Batch().put(key, value).to_df(self.spark), version, sort=False)
            return value

        self.flush()
        value = self._retried(attempt)
        self._trigger()
        return value

    def update_json(self, key: str, updater: Callable[[Any], Any]) -> Any:
        new = self.update(key, lambda old: json.dumps(updater(None if old is None else json.loads(old)), ensure_ascii=False))
        return json.loads(new)

    # reads

    def _log(self, version: Version) -> DataFrame:
        if not version.generations:
            return self.spark.createDataFrame([], LOG_DDL)
        return self.spark.read.schema(LOG_DDL).options(**self.config.read_options()).parquet(*[g.path for g in version.generations])

    def log(self) -> DataFrame:
        """All mutations of the present version, buffered ones included."""
        version = self._manifest.latest()
        log = self._log(version)
        if self._buffer.is_empty:
            return log
        return log.unionByName(self._buffer.to_df(self.spark, version.next_seq).withColumn("gen", F.lit(version.next_gen).cast("long")))

    def live(self) -> DataFrame:
        """The live entries; one compacted generation needs no newest-wins pass."""
        version = self._manifest.latest()
        unique = len(version.generations) == 1 and version.generations[0].unique and self._buffer.is_empty
        return live(self.log(), unique)

    def query(self) -> KVQuery:
        return KVQuery(self.live())

    def scan(self, prefix=None, start_key=None, end_key=None, limit=None, offset=0, reverse=False) -> DataFrame:
        query = KVQuery(self.live(), prefix, start_key, end_key, None, 0, reverse).offset(offset)
        return (query if limit is None else query.limit(limit)).entries()

    scan_bytes = scan

    def scan_strings(self, **options) -> DataFrame:
        """As scan, as strings; bytes that aren't UTF-8 raise."""
        return self.scan(**options).select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"))

    def prefix_scan(self, prefix: str | bytes, limit: int | None = None) -> DataFrame:
        return self.scan(prefix=prefix, limit=limit)

    def range_scan(self, start: str | bytes, end: str | bytes, limit: int | None = None) -> DataFrame:
        return self.scan(start_key=start, end_key=end, limit=limit)

    def keys(self, prefix: str | bytes | None = None) -> DataFrame:
        query = self.query()
        return (query if prefix is None else query.prefix(prefix)).keys()

    def _value(self, log: DataFrame, key: str | bytes) -> bytes | None:
        row = lookup.get(live(log.where(F.col("key") == F.lit(to_bytes(key)))), key).first()
        return None if row is None else bytes(row.value)

    def get_bytes(self, key: str | bytes) -> bytes | None:
        return self._value(self.log(), key)

    def get(self, key: str | bytes) -> str | None:
        value = self.get_bytes(key)
        return None if value is None else value.decode("utf-8")

    get_string = get

    def get_or_default(self, key: str | bytes, default: str) -> str:
        value = self.get(key)
        return default if value is None else value

    def exists(self, key: str | bytes) -> bool:
        return self.get_bytes(key) is not None

    contains_key = exists_bytes = exists

    def get_json(self, key: str) -> Any:
        value = self.get(key)
        return None if value is None else json.loads(value)

    def get_json_or_default(self, key: str, default: Any) -> Any:
        value = self.get(key)
        return default if value is None else json.loads(value)

    def get_all(self, keys: DataFrame | Iterable[str | bytes]) -> DataFrame:
        """key, value (null where there is none) of each distinct key of a frame or a list."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(bytearray(to_bytes(k)),) for k in keys], "key binary")
        return lookup.get_all(self.live(), keys)

    def get_object(self, key: str | bytes, codec: Codec) -> Any:
        rows = lookup.get(self.live(), key).select(codec.decode(F.col("value")).alias("value")).first()
        return None if rows is None else rows.value

    def get_object_or_default(self, key: str | bytes, codec: Codec, default: Any) -> Any:
        found = self.get_object(key, codec)
        return default if found is None else found

    # statistics

    def count(self) -> int:
        """Distinct keys of each generation, summed: overwritten and deleted entries count too."""
        return self.log().select("gen", "key").distinct().count()

    def count_exact(self) -> int:
        return self.live().count()

    def memtable_count(self) -> int:
        """Distinct keys of the newest generation, or of the buffered writes if there are any."""
        if not self._buffer.is_empty:
            return len({to_bytes(k) for _, k, _ in self._buffer.operations})
        version = self._manifest.latest()
        return self._log(replace(version, generations=version.generations[-1:])).select("key").distinct().count()

    def segment_count(self) -> int:
        return len(self._manifest.latest().generations)

    def stats(self) -> dict[str, Any]:
        return {"name": self.name, "memtable_entries": self.memtable_count(), "segment_count": self.segment_count(), "approximate_count": self.count(), "exact_count": self.count_exact()}

    # maintenance

    def flush(self) -> None:
        """Commit the buffered writes as a generation."""
        if not self._buffer.is_empty:
            self.write(self._buffer.to_df(self.spark), parts=self.config.worker_threads)
            self._buffer, self._bytes = Batch(), 0

    def segments_for_compaction(self, keep: int) -> list[Generation]:
        """All generations but the newest keep."""
        found = self._manifest.latest().generations
        return list(found[: max(0, len(found) - keep)])

    def compact(self, min_segments: int | None = None, max_segments: int | None = None) -> dict[str, int] | None:
        """Merge the oldest generations, max_segments at most, if there are min_segments or more; None if there are not.

        As they are the oldest, no older generation can hold what their tombstones hide, so those go. Rows keep their
        seq, so a merged generation never hides a newer one. None also where the settings switch compaction off.
        """
        least, most = min_segments or self.config.compaction_threshold, max_segments or self.config.max_compaction

        def attempt(version: Version) -> dict[str, int] | None:
            if not self.config.compaction_enabled or len(version.generations) < max(1, least):
                return None
            self._publish(version)  # the merged runs' events, where a crash kept them back
            old, rest = version.generations[:most], version.generations[most:]
            merged = latest(self._log(replace(version, generations=old))).where(F.col("op") == PUT).drop("gen")
            generation = self._generation(merged, version, unique=True)
            kept = (generation, *rest) if generation.entries else rest
            self._commit(replace(version, number=version.number + 1, next_gen=version.next_gen + 1, generations=kept), generation)
            return {"segments_merged": len(old), "entries_before": sum(g.entries for g in old), "entries_after": generation.entries, "bytes_before": sum(g.bytes for g in old), "bytes_after": generation.bytes}

        return self._retried(attempt)

    def clear(self) -> None:
        """A new version without generations, and one event of a clear; buffered writes go too."""

        def attempt(version: Version) -> None:
            self._publish(version)
            name = f"gen-{version.next_gen:08d}-{uuid.uuid4().hex}"
            row = [(self.name, bytearray(b""), CHANGE_TYPES[CLEAR], version.next_seq)]
            self.spark.createDataFrame(row, EVENT_DDL).coalesce(1).write.parquet(f"{self.path}/feed/.{name}")
            nothing = Generation(version.next_gen, f"{self.path}/{name}", 0, 0, 0, 0)
            self._commit(replace(version, number=version.number + 1, next_seq=version.next_seq + 1, next_gen=version.next_gen + 1, generations=(), cleared=name), nothing)

        self._retried(attempt)
        self._buffer, self._bytes = Batch(), 0

    def vacuum(self, age: float = AGE) -> list[str]:
        """Delete runs that the present version doesn't list; no older version can be read after that.

        A run made on top of an older version can't be committed any more. One made on top of the present version may be
        that of a writer at work, so it goes only once it is age seconds old.
        """
        version = self._manifest.latest()
        listed = {g.path.rsplit("/", 1)[1] for g in version.generations}
        gone = []
        for name in self._files.names(self.path):
            if name.startswith("gen-") and name not in listed and (int(name.split("-")[1]) < version.next_gen or self._files.age(f"{self.path}/{name}") >= age):
                self._files.delete(f"{self.path}/{name}")
                self._files.delete(f"{self.path}/feed/.{name}")
                gone.append(name)
        return gone

    def close(self) -> None:
        self.flush()

    # change feed

    def events(self) -> DataFrame:
        """All events from the box's first write on, also of what was compacted or cleared since; none of buffered writes."""
        self._publish()
        if not any(n.startswith("gen-") for n in self._files.names(f"{self.path}/feed")):
            return self.spark.createDataFrame([], EVENT_DDL)
        return self.spark.read.schema(EVENT_DDL).parquet(f"{self.path}/feed/gen-*")

    def watch(self, prefix: str | bytes | None = None, max_files: int | None = None) -> DataFrame:
        """A stream of the box's events from its first write on; with a prefix, of keys that start with it."""
        self._publish()
        return watch.matching(watch.stream(self.spark, f"{self.path}/feed/gen-*", max_files), prefix=prefix)

    def watch_prefix(self, prefix: str | bytes) -> DataFrame:
        return self.watch(prefix)


class Store:
    """A directory of boxes; a context manager that flushes them at its end."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self._boxes: dict[str, Box] = {}
        self._subscriptions = watch.Subscriptions()
        self._files = Files(spark)
        self._files.make_directory(f"{self.path}/boxes")

    @property
    def current_path(self) -> str:
        return self.path

    def box(self, name: str) -> Box:
        if name not in self._boxes:
            self._boxes[name] = Box(self.spark, f"{self.path}/boxes", name, self.config)
        return self._boxes[name]

    def boxes(self) -> list[str]:
        """Names of all boxes on disk, sorted."""
        return self._files.names(f"{self.path}/boxes")

    list_collections = discover_collections = boxes

    def close_box(self, name: str) -> None:
        if box := self._boxes.pop(name, None):
            box.close()

    # change feed of all boxes

    def events(self) -> DataFrame:
        """All events of all boxes; seq orders those of one box."""
        frames = [self.box(name).events() for name in self.boxes()]
        out = self.spark.createDataFrame([], EVENT_DDL)
        for frame in frames:
            out = out.unionByName(frame)
        return out

    def watch(self, max_files: int | None = None) -> DataFrame:
        """A stream of the events of all boxes, also of those that are made later."""
        for name in self.boxes():
            self.box(name)._publish()
        return watch.stream(self.spark, f"{self.path}/boxes/*/feed/gen-*", max_files)

    def subscribe(self, collection: str | None = None, prefix: str | bytes | None = None) -> int:
        """The id of a subscription to the events that are committed from now on, for poll()."""
        now = {name: self.box(name)._manifest.latest().next_seq - 1 for name in self.boxes()}
        return self._subscriptions.add(collection, prefix, now)

    def poll(self, subscription: int, n: int) -> list:
        """The next events of a subscription, n at most (held within 1 and 1000); an unknown id raises ValueError."""
        return self._subscriptions.poll(subscription, self.events(), n)

    def unsubscribe(self, subscription: int) -> bool:
        """End a subscription; whether there was one."""
        return self._subscriptions.remove(subscription)

    def subscriber_count(self) -> int:
        return len(self._subscriptions)

    def close(self) -> None:
        for name in list(self._boxes):
            self.close_box(name)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
