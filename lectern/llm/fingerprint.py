"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

Every paragraph (a line of the text) hashes to a wide vector, and a document's fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo a power of two. So the order of
paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting
its vector. The vector has two parts:

* ``DENSE`` lanes of 40 bits, each a hash of the whole paragraph under a seed of its own, summed modulo 2^40. Texts whose
  paragraphs differ have equal sums by chance only, of about 2^-200; the hash isn't cryptographic, so it doesn't hold
  against texts that are made to collide.
* ``LANES`` wide lanes of 32 bits: each of the paragraph's word pairs adds 1 or -1, by its hash, to the lane that its hash names, modulo 2^32. Two
  such vectors have in expectation the inner product of the multisets of pairs, so their cosine estimates the multisets', with a
  standard error of at most 0.065 (about one over the root of 256).

Sums are taken before the modulus with room above them: dense lanes in halves of 20 bits, wide ones in 64, so none overflows in any
text that a string holds. A paragraph's words are an array while they are hashed, at about 200 bytes of memory a word.

Cases: null texts are empty; an empty text is one empty paragraph without word pairs; two texts
without word pairs are alike (1) if their fingerprints are equal, else 0; rows that repeat both
id and text get equal rows; where rows share an id but not a text, all are fingerprinted and the
least text stands for the id as somebody's next document; null ids come last in descending order (an id of -2^63 counts
as null); ids of other types than integers are taken in their own order;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.llm.common import parts_for, stored

DENSE = 5
LANES = 256
BITS = 32
_LOW = (1 << 40) - 1
_HALF = (1 << 20) - 1
_LANE = (1 << BITS) - 1
_HALF_LANE = 1 << (BITS - 1)
_NO_ID = -(1 << 63)


def vectors(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, pairs, paragraphs, dense, wide): sums over the paragraphs of the rows that share ``keys``.

    A row for each dense half, paragraph and word pair is summed by lane, without a shuffle where the rows lie by keys already; then a
    row for each lane makes the vector.
    """
    lines = texts.select(*keys, F.explode(F.split(text_col, "\n")).alias("_p"))
    lines = lines.select(*keys, "_p", F.filter(F.split("_p", "[ \\t\\r\\f]+"), lambda w: w != "").alias("_w"))
    # each word with the one before it; the first with a mark
    before = F.concat(F.array(F.lit("")), F.slice(F.col("_w"), 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    pairs = F.when(F.size("_w") > 0, F.zip_with(before, F.col("_w"), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    lines = lines.select(*keys, pairs.alias("_x"), *[F.xxhash64(F.lit(i), "_p").alias(f"_d{i}") for i in range(DENSE)])
    # first the halves of the dense lanes and 1 for the paragraph, then the pairs
    own = [F.shiftrightunsigned(f"_d{i}", by).bitwiseAND(F.lit(_HALF)) for i in range(DENSE) for by in (20, 0)] + [F.lit(1).cast("long")]
    rows = lines.select(*keys, F.posexplode(F.concat(F.array(*own), "_x")).alias("_at", "_h"))
    single = F.col("_at") < len(own)
    lane = F.when(single, F.col("_at") + LANES).otherwise(F.col("_h").bitwiseAND(F.lit(LANES - 1)).cast("int"))
    value = F.when(single, F.col("_h")).otherwise(1 - 2 * F.shiftrightunsigned("_h", 63))
    sums = rows.select(*keys, lane.alias("_lane"), value.alias("_v")).groupBy(*keys, "_lane").agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_n"))
    made = sums.groupBy(*keys).agg(F.sum(F.when(F.col("_lane") < LANES, F.col("_n")).otherwise(F.lit(0))).alias("pairs"), F.sort_array(F.collect_list(F.struct("_lane", "_v"))).alias("_s"))
    half = lambda i: F.element_at("_s", -(len(own) - i))["_v"]
    dense = F.array(*[(F.shiftleft(half(2 * i).bitwiseAND(F.lit(_HALF)), 20) + half(2 * i + 1)).bitwiseAND(F.lit(_LOW)) for i in range(DENSE)])
    none = F.array().cast("array<int>")
    filled = lambda acc, to: F.concat(acc, F.array_repeat(F.lit(0), to - F.size(acc)))
    wide = F.aggregate(F.filter("_s", lambda e: e["_lane"] < LANES), none, lambda acc, e: F.concat(filled(acc, e["_lane"]), F.array(signed(e["_v"]))), lambda acc: filled(acc, F.lit(LANES)))
    return made.select(*keys, "pairs", F.element_at("_s", -1)["_v"].alias("paragraphs"), dense.alias("dense"), wide.alias("wide"))


def signed(x: Column) -> Column:
    """A number modulo 2^32, as an int."""
    return ((x + F.lit(_HALF_LANE)).bitwiseAND(F.lit(_LANE)) - F.lit(_HALF_LANE)).cast("int")


def compact(wide: Column) -> Column:
    """Wide lanes on their way: as bytes if all of them fit, else as they are."""
    small = F.forall(wide, lambda x: x.between(-128, 127))
    return F.struct(F.when(small, wide.cast("array<tinyint>")).alias("small"), F.when(~small, wide).alias("large"))


def plain(wide: Column) -> Column:
    return F.coalesce(wide["small"].cast("array<int>"), wide["large"])


def packed(pairs: Column, paragraphs: Column, dense: Column, wide: Column) -> Column:
    """The fingerprint string: counts, dense lanes and wide lanes in hexadecimal digits."""
    pad = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.concat(pad(paragraphs, 8), pad(pairs, 8), F.array_join(F.transform(dense, lambda x: pad(x, 10)), ""), F.array_join(F.transform(wide, lambda x: pad(x.cast("long").bitwiseAND(F.lit(_LANE)), 8)), ""))


def add(a: Column, b: Column, sign: int = 1, bits: int = BITS) -> Column:
    """Lane-wise sum (or difference) of two arrays of lanes modulo 2^bits: insertion and deletion of paragraphs."""
    return F.zip_with(a.cast("array<long>"), b.cast("array<long>"), lambda x, y: (x + (y if sign > 0 else -y)).bitwiseAND(F.lit((1 << bits) - 1)))


def projection(wide: Column) -> Column:
    """The wide lanes as doubles."""
    return wide.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def likeness(a: Column, norm_a: Column, b: Column, norm_b: Column, equal: Column) -> Column:
    """0 to 1: the cosine of two projections with their squared norms, at least 0; 1 for equal fingerprints."""
    cosine = F.try_divide(dot(a, b), F.sqrt(norm_a * norm_b))
    return F.when(equal, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("th", F.sha2("text", 256))
    # equal rows add up to a multiple of the row; the count divides it again
    one = base.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return vectors(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), ["doc_id", "th", "copy"]).select("doc_id", packed(*map(F.col, ("pairs", "paragraphs", "dense", "wide"))).alias("fingerprint"))


def following(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, next_id): for each distinct id the next smaller one; for the smallest, the largest.

    Ids are dealt out by range and stored, each range finds its own neighbours, and one row a
    range, as many as there are partitions, closes the gaps between ranges.
    """
    n = parts_for(docs, 64)
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    dealt = stored(ids.repartitionByRange(n, F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()), "ids")
    order = F.col("doc_id").desc_nulls_last()
    inner = Window.partitionBy("part").orderBy(order)
    own = dealt.withColumns({"next_id": F.lead("doc_id").over(inner), "last": F.lead(F.lit(1)).over(inner).isNull()})
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    every = Window.orderBy("part")  # of one row a partition
    first = F.first(F.struct("head")).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead(F.struct("head")).over(every), first)["head"].alias("over"))
    return own.join(F.broadcast(heads), "part").select("doc_id", F.when(F.col("last"), F.col("over")).otherwise(F.col("next_id")).alias("next_id"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_rows``, for ids of any type: those that are no integers are numbered in their order first."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return edited_rows(docs, id_col, text_col)
    named = docs.select(F.col(id_col).alias("_name"), F.col(text_col).alias("text"))
    numbers = stored(named.select("_name").distinct().orderBy(F.col("_name").asc_nulls_first()).withColumn("doc_id", F.monotonically_increasing_id()), "numbers")
    known = numbers.withColumnRenamed("_name", "_known")
    rows = edited_rows(named.join(known, F.col("_name").eqNullSafe(F.col("_known"))).select("doc_id", "text"))
    back = numbers.withColumnRenamed("doc_id", "_number")
    return rows.join(back, F.col("doc_id") == F.col("_number")).select(F.col("_name").alias("doc_id"), *rows.columns[1:])


def edited_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and the next document, by descending id.

    Edited: the last floor(n/2) code points give way to the first as many (or all) of the next
    document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The texts are dealt out by id once; from there the next document
    sends the one before it just the prefix that it needs.
    """
    # a null id takes the least long, so that joins by plain equality keep the texts where they are dealt
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    after = stored(following(base), "next")
    odd = base.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    dealt = base.repartition(parts_for(base, 4), "doc_id")
    if odd:  # rows that share an id: copies counted, and the least text marked
        dealt = dealt.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
        dealt = dealt.withColumn("least", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1)
        dealt = dealt.withColumn("version", F.sha2("text", 256))
    else:
        dealt = dealt.withColumns({"copies": F.lit(1), "least": F.lit(True), "version": F.lit("")})
    needs = base.groupBy("doc_id").agg((F.max(F.char_length("text")) / 2).cast("int").alias("need"))
    asked = after.join(needs.withColumnRenamed("doc_id", "_i"), F.col("doc_id") == F.col("_i")).select(F.col("next_id").alias("_n"), F.col("doc_id").alias("asker"), "need")
    # merge joins: else small texts would be broadcast, and the work done in the few tasks of a side of ids
    prefixes = dealt.filter("least").hint("merge").join(asked, F.col("doc_id") == F.col("_n")).select("asker", F.col("_n").alias("next_id"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("prefix"))
    both = dealt.hint("merge").join(prefixes, F.col("doc_id") == F.col("asker"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("prefix"), F.lit(1), half))
    rows = both.select("doc_id", "next_id", "version", "copies", "least", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    kinds = rows.select("doc_id", "next_id", "version", "copies", "least", "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    keys = ["doc_id", "next_id", "version", "copies", "least", "n_chars", "edited_sha256", "kind"]
    sums = vectors(kinds.select(*keys[:-1], "v.kind", "v.text"), keys)
    sums = sums.withColumn("wide", compact(F.col("wide")))
    vector = ["pairs", "paragraphs", "dense", "wide"]
    # a text and its edited text lie in one partition, as the texts were dealt, and meet in one row
    side = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct(*vector)), ignorenulls=True)
    made = stored(sums.groupBy(*keys[:-1]).agg(side(0).alias("own"), side(1).alias("changed")), "prints")
    follows = made.filter("least").select(F.col("doc_id").alias("_f"), F.col("own").alias("after"))
    out = made.hint("merge").join(follows.hint("merge"), F.col("next_id") == F.col("_f"))
    sides = ("own", "changed", "after")
    out = out.withColumns({f"{c}_v": projection(plain(F.col(f"{c}.wide"))) for c in sides}).withColumns({f"{c}_n": dot(F.col(f"{c}_v"), F.col(f"{c}_v")) for c in sides})
    if odd:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    text = lambda c: packed(F.col(f"{c}.pairs"), F.col(f"{c}.paragraphs"), F.col(f"{c}.dense"), plain(F.col(f"{c}.wide")))
    near = lambda c: likeness(F.col("own_v"), F.col("own_n"), F.col(f"{c}_v"), F.col(f"{c}_n"), F.col("own") == F.col(c))
    return out.select(F.nullif(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), text("own").alias("fingerprint"), text("changed").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("after").alias("near_next"))
