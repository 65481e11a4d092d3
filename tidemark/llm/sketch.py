"""Document fingerprints: bottom-k sketches of the hashes of word shingles, with SQL functions alone.

A sketch is the k least distinct hashes, ascending. Sketches of two parts merge into the sketch of their union, and two of
them estimate resemblance and containment; one estimates how many distinct shingles there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
#: Documents of a bucket of neighbours, on average, and into how many parts one level of quantiles cuts at most.
BUCKET, FAN = 2_000, 64


def words(text: Column) -> Column:
    """Lower-cased words between ASCII blanks."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(tokens: str, k: int = K, size: int = WORDS) -> Column:
    """The bottom-k sketch of a column of words; with fewer words than a shingle has, of the whole sequence; empty without."""
    t = F.col(tokens)
    shingles = F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(size)]))
    hashes = F.when(F.size(t) >= size, shingles).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sketch of a text column. The words are a column of their own for a while, so they are made once."""
    return df.withColumn("_words", words(F.col(text))).withColumn(name, sketch("_words")).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(rows: DataFrame, keys: list[str], name: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts: distinct hashes, the k least of them."""
    least = rows.select(*keys, F.explode(name).alias("_h")).distinct()
    ranked = least.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the k least hashes of both, how many are in both. Two empty sketches: 1."""
    union = merge(a, b, k)
    common = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(union, -1)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (1 + distinct_count(b, k) / distinct_count(a, k))))


def text_of(a: Column) -> Column:
    """The sketch as hexadecimal text."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _step(doc_id: Column, u: Column, q: Column) -> tuple[Column, Column]:
    """The part that a row falls into, given the inner bounds q, and what is left of its share u.

    An id that is several bounds at once is spread over all the parts it fills, in the order of u; so however many rows have
    one id, parts stay even, and parts ascend with (id, u).
    """
    low, high = F.size(F.filter(q, lambda x: x < doc_id)), F.size(F.filter(q, lambda x: x <= doc_id))
    width = high - low + 1
    place = F.least(width - 1, F.floor(u * width).cast("int"))
    return low + place, u * width - place


def bounds(docs: DataFrame, n: int) -> list[DataFrame]:
    """Tables (part, q) of inner bounds, a level for each: quantiles of doc_id, then quantiles within each part, until a part
    has BUCKET of n rows or so. Reads no texts: rows of one id are spread at random here."""
    buckets = max(1, -(-n // BUCKET))
    levels = 1 if buckets <= FAN else 2 if buckets <= FAN**2 else 3
    fan = max(2, math.ceil(buckets ** (1 / levels)))
    rows, tables = docs.where("doc_id is not null").select("doc_id", F.rand(7).alias("_u"), F.lit(0).cast("long").alias("_part")), []
    for level in range(levels):
        found = rows.groupBy("_part").agg(F.percentile_approx("doc_id", [i / fan for i in range(1, fan)], 1_000).alias("q")).collect()  # at most FAN**2 rows
        tables.append(docs.sparkSession.createDataFrame([(r["_part"], [int(x) for x in r["q"]]) for r in found], "part long, q array<long>"))
        if level + 1 < levels:
            rows = descended(rows, tables[-1:], fan)
    return [t.withColumn("fan", F.lit(fan)) for t in tables]


def descended(rows: DataFrame, tables: list[DataFrame], fan: int | None = None) -> DataFrame:
    """rows (doc_id, _u, _part) with _part and _u after the levels of these tables."""
    for t in tables:
        t = t.select(F.col("part").alias("_t"), F.col("q").alias("_q"), (F.lit(fan) if fan else F.col("fan")).alias("_f"))
        part, u = _step(F.col("doc_id"), F.col("_u"), F.col("_q"))
        rows = rows.join(F.broadcast(t), F.col("_part") == F.col("_t"), "left").withColumn("_own", part).withColumn("_u", u)
        rows = rows.withColumn("_part", F.coalesce(F.col("_part") * F.col("_f") + F.col("_own"), F.lit(0).cast("long"))).drop("_t", "_q", "_f", "_own")
    return rows


def bucketed(docs: DataFrame) -> DataFrame:
    """Adds range_no and bucket, both ascending with the order of rows: by doc_id, null last, then a hash of the text.

    Buckets are cut by quantiles, level by level, so neither gaps between ids nor rows that share one make a bucket large. Null
    ids are spread by hash over buckets behind the others.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    rows = docs.withColumn("_order", F.shiftrightunsigned(F.xxhash64("text"), 1)).withColumn("_u", F.col("_order") / F.lit(2.0**63)).withColumn("_part", F.lit(0).cast("long"))
    most, own = 1 << 31, max(1, -(-nulls // BUCKET))
    behind = F.lit(most) + F.least(F.lit(own - 1), F.floor(F.col("_order") / F.lit(2.0**63) * own)).cast("long")
    rows = descended(rows, bounds(docs, n - nulls)).withColumn("bucket", F.when(F.col("doc_id").isNull(), behind).otherwise(F.col("_part"))).drop("_u", "_part")
    return rows.withColumn("range_no", F.shiftright("bucket", 10))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, and the next document's text and sketch, by doc_id; the first one's after the last.

    One shuffle of the texts, by bucket. The first text of each bucket goes to the bucket before it, by way of the ranges.
    """
    rows = bucketed(docs)
    order = ["doc_id", "_order", "text"]
    key = F.struct(F.col("doc_id").isNull(), *order)
    heads = rows.groupBy("range_no", "bucket").agg(F.min_by("text", key).alias("head"))
    inside = Window.partitionBy("range_no").orderBy("bucket")
    firsts = heads.groupBy("range_no").agg(F.min_by("head", "bucket").alias("first"))
    ranges = Window.orderBy("range_no")  # a row for 1,024 buckets
    wrapped = F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("range_no").alias("_range"), wrapped.alias("after"))
    ends = heads.withColumn("_lead", F.lead("head").over(inside)).join(firsts, F.col("range_no") == F.col("_range"))
    ends = with_sketch(ends.select(F.col("bucket").alias("_bucket"), F.coalesce("_lead", "after").alias("end_text")), "end_text", "end_sketch")
    near = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "_order", "text")
    rows = with_sketch(rows.select("doc_id", "text", "_order", "bucket").withColumn("_next", F.lead("text").over(near)), "text", "sketch")
    rows = rows.withColumn("_next_sketch", F.lead("sketch").over(near))
    rows = rows.join(ends, (F.col("bucket") == F.col("_bucket")) & F.col("_next").isNull(), "left")
    return rows.select("doc_id", "text", "sketch", F.coalesce("_next", "end_text").alias("next_text"), F.coalesce("_next_sketch", "end_sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text; null text counts as empty): its sketch, and likeness to an edited text and the next.

    The edited text has its last half, rounded down, replaced by as many first code points of the next document. Equal
    texts have equal fingerprints; of texts without words the sketch is empty, and two of them are alike (1.0). Rows with one
    doc_id follow each other in the order of a hash of their texts. A single row is its own next. Empty table, empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, half = F.col("n_chars"), F.expr("cast(n_chars div 2 as int)")
    rows = with_next(plain).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
