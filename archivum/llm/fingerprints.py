"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions: words are hashed once, shingles of five words are hashed once, the high bits of a hash name
its bin, each bin keeps its smallest hash, and an empty bin borrows from the first filled bin in a sequence of bins that
depends on its number and the attempt alone (the same for all documents).  Of each bin the low eight bits are kept; the
likeness of two fingerprints is corrected for bins that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
BITS = 8
#: Attempts of the densification that are tables of their own; later ones follow the order of all bins' first attempts.
ATTEMPTS = 16
WIDTH = 5


def _donor(attempt: int, bin_: int) -> int:
    """A 2-universal style hash of (bin, attempt)."""
    x = (bin_ * 0x9E3779B97F4A7C15 + attempt * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 % 2**64
    return (x >> 40) % BINS


def _donors(bin_: int) -> list[int]:
    """All bins in the order in which the endless sequence of attempts first meets them."""
    seen: dict[int, None] = {}
    attempt = 0
    while len(seen) < BINS:
        seen.setdefault(_donor(attempt, bin_))
        attempt += 1
    return list(seen)


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<int> of BINS kept values, empty for a text without words.

    Each intermediate array is a column that is used more than once, so that Catalyst evaluates it once a row.
    """
    shift = 64 - (BINS - 1).bit_length()
    w, h, s, f, b = (f"_{out}_{x}" for x in "whsfb")
    df = df.withColumn(w, F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"))
    df = df.withColumn(w, F.transform(F.filter(w, lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(WIDTH))))
    df = df.withColumn(h, F.when(n >= WIDTH, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.sort_array(h))
    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    df = df.withColumn(f, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    places = F.transform(f, lambda x: bin_of(x).cast("int"))
    kept = F.transform(f, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    df = df.withColumn(f"{f}m", F.map_from_arrays(places, kept))
    df = df.withColumn(b, F.when(F.size(f"{f}m") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.try_element_at(f"{f}m", i))))
    tables = [F.lit([_donor(t, i) for i in range(BINS)]) for t in range(ATTEMPTS)]

    every = F.split(F.lit(",".join(str(d) for i in range(BINS) for d in _donors(i))), ",").cast("array<int>")

    def filled(v: Column, i: Column) -> Column:
        later = F.filter(F.transform(F.slice(every, i * BINS + 1, F.lit(BINS)), lambda d: F.get(b, d)), lambda x: x.isNotNull())
        return F.coalesce(v, *(F.get(b, F.get(t, i)) for t in tables), F.get(later, F.lit(0)))

    df = df.withColumn(out, F.coalesce(F.when(F.size(b) > 0, F.transform(b, filled)), F.array().cast("array<int>")))
    return df.drop(w, h, s, f, f"{f}m", b)


def packed(bins: str) -> Column:
    """The fingerprint as lower-case hexadecimal digits, two a bin; empty for a text without words."""
    digits = F.lit([f"{i:02x}" for i in range(1 << BITS)])
    return F.concat_ws("", F.transform(bins, lambda x: F.get(digits, x)))


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of two texts: bins that agree, less those that agree by chance; two empty texts are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(BINS)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def _bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Keys of rows that cut the rows into some ``buckets`` ranges of about equal size, the largest key last; none for no rows."""
    found = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    near = F.size(F.filter(F.lit(sorted(set(found))) if found else F.array().cast("array<bigint>"), lambda x: x < F.col(key)))
    # the percentiles are doubles; the largest key of each of their ranges is exact
    return sorted(r[0] for r in df.where(F.col(key).isNotNull()).groupBy(near.alias("range")).agg(F.max(key)).select(f"max({key})").collect())


def with_next(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Add ``next``: a struct of ``columns`` of the row that follows by descending doc_id; after the last, of the first.

    Bounds that are ids of rows cut the ids into ranges; the row at a bound is also sent to the range above it, as what
    follows that range's last row, and the largest to the lowest range.  One exchange, no single partition.  Rows of
    equal ids follow each other in order of ``columns``; rows without an id come last, by a hash of the first of ``columns``
    in ranges of their own.
    """
    df = df.withColumn("_hash", F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64(columns[0]), 12)))
    lower, upper = _bounds(df, "_hash", buckets), _bounds(df, "doc_id", buckets)
    if not lower and not upper:
        return df.drop("_hash").withColumn("next", F.struct(*columns))
    held = lambda x: F.lit(x) if x else F.array().cast("array<bigint>")
    below = lambda x, key: F.size(F.filter(held(x), lambda b: b < F.col(key)))
    no_id = F.col("doc_id").isNull()
    here = F.when(no_id, below(lower, "_hash")).otherwise(below(upper, "doc_id") + len(lower))
    at_bound = F.when(no_id, F.array_contains(held(lower), F.col("_hash"))).otherwise(F.array_contains(held(upper), F.col("doc_id")))
    own = F.struct(F.col("_here").alias("at"), F.lit(0).alias("turn"))
    above = F.when(F.col("_here") == len(lower) + len(upper) - 1, F.struct(F.lit(0).alias("at"), F.lit(2).alias("turn"))).otherwise(F.struct((F.col("_here") + 1).alias("at"), F.lit(1).alias("turn")))
    sent = F.when(at_bound, F.array(own, above)).otherwise(F.array(own))
    order = Window.partitionBy("_to.at").orderBy(F.col("_to.turn") == 2, F.desc_nulls_last("doc_id"), F.desc("_hash"), *columns)
    spread = df.withColumn("_here", here).withColumn("_to", F.explode(sent))
    return spread.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_to.turn = 0").drop("_here", "_to", "_hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the text with its last third replaced by the beginning of the next document's, by descending
    doc_id.  Null texts count as empty; equal texts have equal fingerprints; a text without words has an empty one.
    One row follows itself.  Rows without an id come after all others, by a hash of their text, and repeated rows follow
    each other.  Very long texts are hashed by one task each, as arrays of their words.  Further columns are ignored; an
    empty table gives no rows.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_bins(df, "text", "bins"), ["text", "bins"], 4 * partitions)
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substring("next.text", F.lit(1), part))
    df = df.select("doc_id", "n_chars", edited.alias("edited"), "bins", F.col("next.bins").alias("next_bins"))
    df = with_bins(df, "edited", "edited_bins")
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"), likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))
