"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

A text's word shingles are hashed once. The top bits of a hash choose one of BINS bins; a bin keeps its smallest hash. An
empty bin j is filled by optimal densification: it probes bins in an order that depends on j alone and takes the first
that isn't empty (PROBES fixed probes; where all are empty, the non-empty bin with the highest hash of (j, bin), which is
the first in a random order of all bins). The low BITS bits of each bin's value, hashed with the bin's number so that chance
agreements are independent even where many bins borrow one value, are packed into hex digits. Two fingerprints agree at a
bin by chance with 2**-BITS, so the likeness is (share - 2**-BITS) / (1 - 2**-BITS), at least 0.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_below, let

BINS = 256
BITS = 4
SHINGLE = 5
PROBES = 12
#: Documents of a bucket of neighbours on average, slices of equal numbers of rows at most, and buckets up to which their table of
#: first ids is broadcast.
BUCKET_ROWS = 1024
RANGES = 4096
MOST_BUCKETS = 1_000_000

_LOW = 63 - int(math.log2(BINS))
_MASK = (1 << _LOW) - 1
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; of an empty text one empty word."""
    return F.split(F.btrim(F.lower(text), F.lit(_SPACE)), "[ \\t\\n\\x0B\\f\\r]+")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash of each run of `size` words; with fewer words, of the whole sequence."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))
        return F.when(F.size(h) >= size, runs).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """BINS hex digits; equal texts have equal ones. Null counts as empty, and an empty text has one empty shingle."""
    r = random.Random(1)
    probes = [F.lit([r.randrange(BINS) for _ in range(BINS)]) for _ in range(PROBES)]
    ends = F.lit([((j + 1) << _LOW) - 1 for j in range(BINS)])  # the last value of each bin, so that every bin is there
    values = F.transform(shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))
    in_bin = lambda x: F.shiftright(x, _LOW)

    def first_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (in_bin(x) != in_bin(s[i - 1])))

    def densified(g: Column) -> Column:
        full = F.filter(g, lambda x: x.isNotNull())

        def fill(some: Column) -> Column:
            def of(x: Column, j: Column) -> Column:
                last = F.array_max(F.transform(some, lambda y: F.struct(F.xxhash64(j, in_bin(y)).alias("h"), y.alias("y"))))["y"]
                return F.coalesce(x, *[g[p[j]] for p in probes], last)

            return F.transform(g, of)

        return let(full, fill)

    firsts = let(F.sort_array(F.concat(values, ends)), first_of_bins)
    known = F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_MASK)) != F.lit(_MASK), x))
    digits = F.transform(let(known, densified), lambda x, j: F.substring(F.lit("0123456789abcdef"), F.xxhash64(x, j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1)))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    differ = F.lit(0)
    for k in range(0, BINS, 8):  # eight digits at once: a digit differs if any of its four bits does
        x, y = (F.conv(F.substring(f, k + 1, 8), 16, 10).cast("long") for f in (a, b))
        z = x.bitwiseXOR(y)
        any_bit = z.bitwiseOR(F.shiftright(z, 1)).bitwiseOR(F.shiftright(z, 2)).bitwiseOR(F.shiftright(z, 3))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x11111111)))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance))


def _buckets(docs: DataFrame) -> tuple[Column, Column]:
    """Expressions for the slice and the part of a doc_id: slices of equal numbers of rows (RANGES at most, by approximate
    quantiles), each cut into parts of equal width, BUCKET_ROWS rows each on average. Ids may lie as they like: what is far
    off shares a slice with a RANGES-th of the rows at most."""
    key = F.col("doc_id").cast("long")
    n, low, high = docs.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return F.lit(-1), F.lit(0).cast("long")
    slices = min(RANGES, math.ceil(n / BUCKET_ROWS))
    cuts = []
    if slices > 1:
        cuts = sorted({x for x in docs.agg(F.percentile_approx(key, [k / slices for k in range(1, slices)], 100_000)).first()[0] if low < x})
    of = F.lit(0)
    if cuts:  # the number of cuts at or below the id, found by halving
        known, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
        of = F.aggregate(F.lit(steps), F.lit(0), lambda i, s: F.when((i + s <= len(cuts)) & (F.get(known, i + s - 1) <= key), i + s).otherwise(i))
    parts = math.ceil(n / (len(cuts) + 1) / BUCKET_ROWS)

    def part(i: Column) -> Column:
        first, beyond = F.get(F.lit([low, *cuts]), i), F.get(F.lit([*cuts, high + 1]), i)
        return F.floor((key.cast("double") - first) / (beyond.cast("double") - first) * parts)

    return F.when(key.isNull(), -1).otherwise(of), F.when(key.isNull() | F.lit(parts == 1), F.lit(0).cast("long")).otherwise(let(of, part))


def with_next(docs: DataFrame) -> DataFrame:
    """slice, part, doc_id, text, next_text, extra: docs in buckets (slice, part) of neighbouring doc_ids. Each bucket also has,
    as extra rows behind its own, the first document of the next bucket (of the last bucket: of the first), so next_text is
    known inside the bucket. Rows that repeat a doc_id follow each other in the order of their texts; null doc_ids come first."""
    of, part = _buckets(docs)
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), of.alias("slice"), part.alias("part"))
    # One row a bucket, ordered within its slice; then one row a slice, RANGES at most, ordered in one task.
    firsts = base.groupBy("slice", "part").agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.withColumn("before", F.lag("part").over(Window.partitionBy("slice").orderBy("part")))
    slices = base.groupBy("slice").agg(F.max("part").alias("last_part"))
    ordered, every = Window.orderBy("slice"), Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(F.col("slice").alias("s"), F.col("last_part").alias("p"))
    slices = slices.select(F.col("slice").alias("of"), F.coalesce(F.lag(own).over(ordered), F.last(own).over(every)).alias("to"))
    firsts = firsts.join(F.broadcast(slices), F.col("slice") == F.col("of"))
    firsts = firsts.select(F.col("first_id"), F.col("slice").alias("own_slice"), F.col("part").alias("own_part"), F.when(F.col("before").isNull(), F.col("to.s")).otherwise(F.col("slice")).alias("to_slice"), F.coalesce("before", "to.p").alias("to_part"))
    same = (F.col("slice") == F.col("own_slice")) & (F.col("part") == F.col("own_part")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    at = base.join(broadcast_below(firsts, MOST_BUCKETS), same)
    extra = at.select("doc_id", "text", F.col("to_slice").alias("slice"), F.col("to_part").alias("part"), F.lit(True).alias("extra"))
    rows = base.select("doc_id", "text", "slice", "part", F.lit(False).alias("extra")).unionByName(extra)
    order = Window.partitionBy("slice", "part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def compare(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text; other columns are left out): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, as the contract of this query has them.

    Null texts are empty; an empty text stays empty when edited and is wholly like itself. A single document is its own
    next one. An empty table gives an empty one. One shuffle of the texts, by ranges of doc_id."""
    rows = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    # Of the extra rows only the fingerprint is of use.
    rows = rows.withColumn("edited", F.when(~F.col("extra"), F.coalesce(edited, F.col("text"))))
    rows = rows.select(
        "slice", "part", "place", "extra", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), F.when(~F.col("extra"), fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    order = Window.partitionBy("slice", "part").orderBy("place")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where(~F.col("extra"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
