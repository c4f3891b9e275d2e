"""Mix sources to target weights.

A source's budget is its share of the total by weight, at most a multiple of its size; what is cut off there goes to the others
by weight. Documents get hash-random keys and are sorted by them within their source. Prefix sums are distributed: the
leading bits of the key give buckets, bucket totals are added up per source in two steps, and only rows of one bucket of one source are
sorted together, so a source with a third of all rows is spread over as many tasks as its rows need. Whole epochs of a source
repeat every document; the rest of the budget takes documents in key order, the last one in part.

Built-in expressions only. Defined cases: a null text has no words; documents without words are taken with 0 words; a null
source is a source of its own, after all others; a null id counts as an empty one in the key, which has the text in it too; repeated rows are documents of their
own, which share a key: each counts in the budget and is taken by itself. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows of one bucket that are sorted together, about.
BUCKET_ROWS = 1 << 11
#: Sources up to which their places are sent to every executor, and parts that each source is dealt into beyond.
SENT, SALTS = 100_000, 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from one row for each source.

    Sharing the excess again until no target is above its limit ends at target = min(limit, level * weight): sources sorted by
    limit / weight are full up to the first one whose level, if all from there on shared what is left, is within its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy((F.col("limit") / F.col("weight")), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("filled", F.coalesce(F.sum("limit").over(full), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("filled")) / (F.sum("weight").over(everything) - F.col("spent")))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything).getField("level"))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def _order_key(id_: Column, text: Column) -> Column:
    """Hash-random key of a row; of id and text, so that a null or repeated id doesn't bring rows together."""
    inner = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(id_.cast("long").cast("string"), F.lit("")), F.lit(":"), inner).cast("binary"))


def _slim(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), common.n_words(F.col(text_col)).alias("size"), _order_key(F.col(id_col), F.col(text_col)).alias("key"))
    return common.cut(rows)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken counts words, repeats included."""
    rows = _taken(_slim(docs, id_col, source_col, text_col), weights, share, most)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Rows (id, source, size, key) with source_size, target, epochs, before (words of earlier rows of the source), part and taken."""
    # Leading bits of the key, so many that a bucket has about BUCKET_ROWS rows; buckets themselves are added up in two steps.
    bits = min(32, (max(1, rows.count()) // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("coarse", F.shiftright("bucket", bits // 2))
    coarse = buckets.groupBy("source", "coarse").agg(F.sum("bucket_size").alias("coarse_size"))
    goal = targets(coarse.groupBy("source").agg(F.sum("coarse_size").alias("source_size")), weights, share, most)
    same = lambda name: F.col("source").eqNullSafe(F.col(name))
    upto = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("coarse_base", F.coalesce(F.sum("coarse_size").over(upto("source").orderBy("coarse")), F.lit(0)))
    coarse = coarse.join(goal.withColumnRenamed("source", "source3"), same("source3"))
    coarse = coarse.select(F.col("source").alias("source2"), F.col("coarse").alias("coarse2"), "coarse_base", "source_size", "target")
    buckets = buckets.withColumn("fine_base", F.coalesce(F.sum("bucket_size").over(upto("source", "coarse").orderBy("bucket")), F.lit(0)))
    buckets = buckets.join(coarse, same("source2") & (F.col("coarse") == F.col("coarse2")))
    buckets = buckets.select("source2", F.col("bucket").alias("bucket2"), (F.col("coarse_base") + F.col("fine_base")).alias("base"), "source_size", "target")
    rows = rows.join(buckets, same("source2") & (F.col("bucket") == F.col("bucket2"))).drop("source2", "bucket2")
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(upto("source", "bucket").orderBy("key", "id", "size")), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.withColumns({"epochs": epochs.cast("int"), "rest": rest.cast("long"), "part": part.cast("long")}).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: a row for each epoch that takes the document, with all its columns; the last may have the first words only, with single spaces.

    Each source has one place in the order of keys where its budget ends: rows before it are taken whole, rows behind it not at all. So texts aren't
    shuffled: every row is compared with its source's place. Equal rows at the place itself are numbered, and share what is left in that order.
    Documents without words come with every whole epoch, and once more if they lie before the place.
    """
    slim = _taken(_slim(docs, id_col, source_col, text_col), weights, share, most)
    # A source ends at the key of its last row that the budget reaches; words of that key's rows that fit are what is left there.
    reached = slim.where((F.col("before") < F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.max(F.struct("key")).getField("key").alias("key"))
    every = slim.groupBy("source").agg(F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    at = slim.select(F.col("source").alias("source2"), F.col("key").alias("key2"), "before").join(reached, F.col("source2").eqNullSafe(F.col("source")) & (F.col("key2") == F.col("key")))
    at = at.groupBy("source2").agg(F.first("key2").alias("end"), F.min("before").alias("before"))
    every = common.cut(every.join(at, F.col("source").eqNullSafe(F.col("source2")), "left").select("source", "epochs", "end", (F.col("rest") - F.col("before")).alias("left")))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    if every.count() <= SENT:
        every, salt = F.broadcast(every.withColumn("salt", F.lit(0))), F.lit(0)
    else:  # so many sources that they are joined by a shuffle: a large one is dealt over tasks
        every = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = every.withColumnRenamed("source", "source2").withColumnRenamed("salt", "salt2")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), _order_key(F.col(id_col), F.col(text_col)).alias("key")).withColumn("salt", salt)
    rows = rows.join(every, F.col("source").eqNullSafe(F.col("source2")) & (F.col("salt") == F.col("salt2")))
    before = F.coalesce(F.col("key") < F.col("end"), F.lit(False))
    on_place = F.coalesce(F.col("key") == F.col("end"), F.lit(False))
    whole = rows.where(~on_place).withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("epochs") + before.cast("int")))).select("row.*")

    # Equal rows of one place, numbered in two steps: by where they are computed, then within.
    edge = common.cut(rows.where(on_place).select("row", "source", "text", "epochs", "left", F.monotonically_increasing_id().alias("n")))
    edge = edge.withColumn("group", F.shiftright("n", 16))
    counts = edge.groupBy("source", "group").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("source2"), F.col("group").alias("group2"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    edge = edge.join(counts, F.col("source").eqNullSafe(F.col("source2")) & (F.col("group") == F.col("group2")))
    number = F.col("base") + F.row_number().over(Window.partitionBy("source", "group").orderBy("n")) - 1
    edge = edge.withColumn("size", common.n_words(F.col("text"))).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - number * F.col("size"))))
    copies = F.filter(F.concat(F.array_repeat(F.col("size"), F.col("epochs")), F.array(F.col("part"))), lambda x: x > 0)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    edge = edge.withColumn("words", F.explode(copies)).withColumn("row", F.col("row").withField(f"`{text_col}`", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text"))))
    return whole.unionByName(edge.select("row.*"))


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key from documents
), s as (
  select source, sum(size) as source_size, case (row_number() over (order by (source is null), source) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w
  from d group by source
), f as (
  select *, 2.0::double * source_size as lim,
    coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source nulls first rows between unbounded preceding and 1 preceding), 0) as filled,
    coalesce(sum(w) over (order by 2.0::double * source_size / w, source nulls first rows between unbounded preceding and 1 preceding), 0) as spent from s
), l as (
  select *, (1.5::double * (select sum(source_size) from s) - filled) / ((select sum(w) from s) - spent) as level from f
), t as (
  select source, cast(source_size as bigint) as source_size,
    least(lim, w * coalesce((select arg_min(level, lim / w) from l where level * w <= lim), 1e300)) as target from l
), p as (
  select doc_id, size, source_size, target, cast(round(target) as bigint) as budget,
    cast(coalesce(sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, cast(case when source_size > 0 then (budget // source_size) * size
  + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) else 0 end as bigint) as taken from p
"""
