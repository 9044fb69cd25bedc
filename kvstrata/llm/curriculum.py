"""Operator 8: mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets: sources share ``share`` times all words by weight, none above ``most`` times its own words; what a capped
source can't take goes to the others by weight. That is water-filling, and has a closed form over one row a source.

Positions: a source's weight over training time t in [0, 1] is a piecewise linear schedule; its integral, scaled to
the target, is the source's cumulative token demand. Its documents, in an order fixed by a hash of doc_id and pass after
pass, supply cumulative tokens; the training position of a document's pass is where demand reaches the tokens before it,
found by inverting the integral. All passes of all sources are range-sorted by position: that is the mix, in which each
schedule runs once, however many passes a source takes.

Cumulative sums never run over a whole source in one task: hash buckets of about BUCKET_ROWS documents are summed first,
then groups of FAN buckets; prefix sums of the groups and of the buckets inside each are joined back, and windows run
inside buckets. A source has buckets in proportion to its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, spread_join, text_tag, written

#: Weights of the sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: For each of the weights: knots (time, relative weight); the first fades, the second is even, the last comes late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: Rows of a bucket inside which a window sorts, and buckets of a group.
BUCKET_ROWS, FAN = 1_000, 1_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), source, name (source, never null), size (words) and key, the order inside the source.

    Rows without doc_id are ordered by a hash of their text.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    by_text = F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    key = F.md5(F.coalesce(doc_id.cast("string"), by_text).cast("binary"))
    return docs.select(doc_id.alias("doc_id"), text_tag(docs), source.alias("source"), _name(source).alias("name"), size.alias("size"), key.alias("key"))


def _name(source: Column) -> Column:
    """A source, or another text where it is null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, kind (index of its weight), source_size, documents, target: one row a source, so the windows below are small."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("kind", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)).withColumn("cap", most * F.col("source_size"))
    all_rows = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("total", share * F.sum("source_size").over(all_rows)).withColumn("capped", F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("open", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # words for a unit of weight if this source and all that need more stay under their caps
    level = (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open")
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "kind", "source_size", "documents", target.alias("target"))


def inverse_demand(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches that fraction of its whole."""
    parts, whole = [], sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))
    if whole <= 0:
        raise ValueError("a schedule needs some weight")
    before = 0.0
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        area, slope = (b - a) * (u + v) / 2, (v - u) / (b - a)
        x = F.greatest(fraction * whole - before, F.lit(0.0))
        # x = u s + slope s^2 / 2, solved for s in the form that is stable for small slopes
        root = F.sqrt(F.greatest(u * u + 2 * slope * x, F.lit(0.0)))
        s = F.when(u + root > 0, 2 * x / (u + root)).otherwise(0.0)
        parts.append((fraction * whole <= before + area, F.least(a + s, F.lit(b))))
        before += area
    out = F.lit(float(knots[-1][0]))
    for test, value in reversed(parts):
        out = F.when(test, value).otherwise(out)
    return out


def _ahead(rows: DataFrame) -> DataFrame:
    """rows (name, bucket, key, size) with ahead: the words of the source before each row, by sums of three levels."""
    earlier = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda column, over: F.coalesce(F.sum(column).over(over), F.lit(0))
    per = rows.groupBy("name", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / FAN))
    groups = per.groupBy("name", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("name", "group", so_far("words", earlier(["name"], "group")).alias("before"))
    per = per.select("name", "group", "bucket", so_far("words", earlier(["name", "group"], "bucket")).alias("inside")).join(groups, ["name", "group"])
    per = per.select("name", "bucket", (F.col("before") + F.col("inside")).alias("ahead"))
    own = earlier(["name", "bucket"], "key", "doc_id", "size", "tag")
    return rows.join(per, ["name", "bucket"]).withColumn("ahead", F.col("ahead") + so_far("size", own))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """doc_id, tag, source, size, source_size, target, taken, position, positions of every row, range-sorted by position.

    Passes over a source follow one another: the first takes documents until the target or the source ends, the next
    starts over. taken is what all passes take of a document, at most most * size; only the document where the target
    is reached is taken in part. positions holds the training time in [0, 1] of each pass that takes of the row;
    position is that of the first pass, also for what lies beyond the target (1.0). Null and empty texts have size 0, long
    ones are counted whole; null sources are one source, the last; rows with equal doc_id are ordered by size, and rows
    equal in both are interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    sized = written(sizes(docs), "sizes")
    goal = written(targets(sized, weights, share, most).withColumn("name", _name(F.col("source"))).drop("source"), "goal")
    total = goal.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / BUCKET_ROWS))
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / 2.0**48
    rows = _ahead(spread_join(sized, goal, ["name"], "documents", total).withColumn("bucket", F.floor(place * buckets)))
    words = F.floor(F.col("target") + 0.5)

    def position(turn: int) -> Column:
        fraction = F.least(F.lit(1.0), F.coalesce((turn * F.col("source_size") + F.col("ahead")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0)))
        return F.coalesce(*[F.when(F.col("kind") == i, inverse_demand(fraction, schedules[i % len(schedules)])) for i in range(len(weights))])

    turns = range(-int(-most // 1))
    parts = [F.greatest(F.lit(0), F.least("size", words - i * F.col("source_size") - F.col("ahead"))) for i in turns]
    positions = F.array_compact(F.array(*[F.when(part > 0, position(i)) for i, part in zip(turns, parts, strict=True)]))
    rows = rows.select("doc_id", "tag", "source", "size", "source_size", "target", sum(parts, F.lit(0)).cast("long").alias("taken"), position(0).alias("position"), positions.alias("positions"))
    return rows.orderBy("position", "doc_id")


def drawn(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of docs, a row for each pass that takes of a document, range-sorted by its position.

    A document of which a pass takes only a part, at most one of each source, is whole here: texts are never cut.
    Documents of which nothing is taken are not in the mix. Rows of equal doc_id, text and source share their passes out.
    """
    key = lambda doc_id, source: [F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).alias("__id"), _name(source).alias("__name")]
    plan = mix(docs, **settings).select(*key(F.col("doc_id"), F.col("source")), F.col("tag").alias("__tag"), "positions")
    plan = plan.groupBy("__id", "__name", "__tag").agg(F.count("*").alias("__rows"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("__draws"))
    same = ["__id", "__name", "__tag"]
    named = docs.select("*", *key(F.col("doc_id"), F.col("source").cast("string")), text_tag(docs).alias("__tag"))
    rows = named.join(plan.where(F.size("__draws") > 0), same)
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1
    mine = F.filter("__draws", lambda x, i: i % F.col("__rows") == F.col("__nth"))
    rows = rows.withColumn("__nth", nth).withColumn("__position", F.explode(mine))
    return rows.repartitionByRange("__position", "__tag").sortWithinPartitions("__position", "__tag").select(*[F.col(f"`{c}`") for c in docs.columns])
