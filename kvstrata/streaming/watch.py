"""Change feed: events of one log, of a collection or of a key prefix, in batch and as a stream.

The same functions serve both: events() and matching() take batch or streaming frames. A stream reads the events of
committed writes from a box's feed, each file once; it is lossless, and bounded() gives the lossy delivery of a channel
with a fixed capacity where that is wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import CHANGE_TYPES, EVENT_DDL

CAPACITY, LEAST_POLL, MOST_POLL = 1024, 1, 1000
#: Subscriptions up to which all are broadcast, and copies of each where they are more.
MOST_BROADCAST, SALTS = 100_000, 32


def change_type(op: Column) -> Column:
    """0 for a put, 1 for a delete, 2 for a clear."""
    out = F.lit(None).cast("int")
    for name, code in CHANGE_TYPES.items():
        out = F.when(op == name, F.lit(code)).otherwise(out)
    return out


def events(log: DataFrame, collection: str | None = None) -> DataFrame:
    """collection, key, change_type, seq of each mutation; a clear has an empty key."""
    name = F.col("collection") if collection is None else F.lit(collection)
    return log.select(name.alias("collection"), "key", change_type(F.col("op")).alias("change_type"), "seq")


def matching(feed: DataFrame, collection: str | None = None, prefix: str | bytes | None = None) -> DataFrame:
    """The events of a collection whose keys start with a prefix; either may be None for all."""
    if collection is not None:
        feed = feed.where(F.col("collection") == collection)
    if prefix is not None:
        binary = dict(feed.dtypes)["key"] == "binary"
        wanted = prefix.encode("utf-8") if binary and isinstance(prefix, str) else prefix
        feed = feed.where(F.startswith("key", F.lit(wanted)))
    return feed


def bounded(feed: DataFrame, by: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The first events of each subscription by seq, as many as its channel holds: later ones are dropped."""
    order = Window.partitionBy(*(by or [])).orderBy("seq")
    return feed.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= capacity)


def fan_out(feed: DataFrame, subscriptions: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """sub_id with each event that a subscription (sub_id, sub_collection, sub_prefix; null for all) matches.

    Events meet subscriptions by equality: each key's beginnings, of the lengths that prefixes have, join on prefix (and
    collection, where a subscription has one). A short prefix is the beginning of most keys, so events are never gathered
    by it: the subscriptions, counted here, are broadcast up to most_broadcast of them. More are hashed in tasks, each in SALTS
    copies over which the events are spread.
    """
    subscriptions = subscriptions.withColumn("__prefix", F.coalesce("sub_prefix", F.lit("")))
    lengths = subscriptions.agg(F.coalesce(F.collect_set(F.length("__prefix")), F.array().cast("array<int>"))).scalar()
    starts = feed.withColumn("__length", F.explode(lengths)).where(F.col("__length") <= F.length("key"))
    starts = starts.withColumn("__start", F.substring(F.col("key"), F.lit(1), F.col("__length")))
    if subscriptions.count() <= most_broadcast:
        spread, met = F.lit(True), F.broadcast
    else:
        starts = starts.withColumn("__salt", F.pmod(F.xxhash64("key", "seq"), F.lit(SALTS)))
        subscriptions = subscriptions.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        spread, met = F.col("__salt") == F.col("__copy"), lambda x: x.hint("shuffle_hash")
    same = (F.col("__start") == F.col("__prefix")) & spread
    own = starts.join(met(subscriptions.where("sub_collection IS NOT NULL")), same & (F.col("collection") == F.col("sub_collection")))
    every = starts.join(met(subscriptions.where("sub_collection IS NULL")), same)
    return own.unionByName(every).select("sub_id", "collection", "key", "change_type", "seq")


def poll(feed: DataFrame, after: int, n: int) -> DataFrame:
    """The next events after a seq in order, with pos; n is held within 1 and 1000."""
    n = min(MOST_POLL, max(LEAST_POLL, n))
    page = feed.where(F.col("seq") > after).orderBy("seq").limit(n)
    return page.withColumn("pos", F.row_number().over(Window.orderBy("seq")))


class Subscriptions:
    """Subscriptions by id, each with the seq up to which it has seen each collection."""

    def __init__(self):
        self._next, self._all = 1, {}

    def __len__(self) -> int:
        return len(self._all)

    def add(self, collection: str | None, prefix: str | bytes | None, seen: dict[str, int]) -> int:
        """seen: the last seq of each collection that is not to be delivered."""
        self._all[self._next] = (collection, prefix, dict(seen))
        self._next += 1
        return self._next - 1

    def remove(self, subscription: int) -> bool:
        return self._all.pop(subscription, None) is not None

    def poll(self, subscription: int, feed: DataFrame, n: int) -> list:
        """The next events of a feed for a subscription by seq, n at most (held within 1 and 1000), which it has seen then."""
        if subscription not in self._all:
            raise ValueError(f"no subscription {subscription}")
        collection, prefix, seen = self._all[subscription]
        if seen:
            last = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
            feed = feed.where(F.col("seq") > F.coalesce(F.try_element_at(last, F.col("collection")), F.lit(-1)))
        page = matching(feed, collection, prefix).orderBy("seq", "collection").limit(min(MOST_POLL, max(LEAST_POLL, n))).collect()
        for event in page:
            seen[event.collection] = event.seq
        return page


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of the events under a path (a glob), a few files a trigger if max_files is given."""
    reader = spark.readStream.schema(EVENT_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def subscribe(feed: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, milliseconds: int | None = 50) -> StreamingQuery:
    """Deliver each micro-batch of a streaming feed; None delivers what there is and ends. Unsubscribe by stop()."""
    writer = feed.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if milliseconds is None else writer.trigger(processingTime=f"{milliseconds} milliseconds")).start()


def subscriber_count(spark: SparkSession) -> int:
    """Streams that run in the session, of any kind; Store.subscriber_count() counts a store's subscriptions."""
    return len(spark.streams.active)
