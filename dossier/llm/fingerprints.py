"""One-permutation MinHash fingerprints in SQL expressions only.

Each shingle is hashed once; the leading bits of the hash choose its bin and a bin keeps its least
hash. An empty bin takes over the value of another. Of each value a few low-order bits are stored,
and the likeness of two fingerprints is corrected for equal bits by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import let

#: Words of a shingle, bins (a power of two) and stored bits of a bin (they divide 64).
WORDS = 5
BINS_LOG2 = 7
BITS = 4
BINS = 1 << BINS_LOG2
#: Rows whose next document is looked up together, about, and most of such groups.
GROUP_ROWS = 2_000
MOST_GROUPS = 10_000

_PER_LONG = 64 // BITS


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BINS_LOG2)


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, lower case; fewer words are one run, no words none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def joined(a: Column, b: Column, shift: int) -> Column:
        # Runs that start ``shift`` words apart, as one run.
        n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))

    def runs(h: Column) -> Column:
        five = let(joined(h, h, 1), lambda two: let(joined(two, two, 2), lambda four: joined(four, h, 4)))
        return F.when(F.size(h) >= WORDS, five).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(hashes, runs)


def _least(values: Column) -> Column:
    """The least value of each bin that has any; sorted values of a bin lie side by side."""
    return let(
        F.sort_array(values),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))),
    )


def _dense(least: Column) -> Column:
    """A value for every bin; null if there are no values.

    Each bin has a random order of all bins of its own, by a hash of both numbers. An empty bin
    takes the value of the first non-empty bin in that order. This is optimal densification:
    every empty bin draws independently, and two sets draw alike where they are alike.
    """

    def spread(values: Column) -> Column:
        def all_bins(bins: Column) -> Column:
            def value(i: Column) -> Column:
                def other() -> Column:
                    draws = F.transform(bins, lambda b: F.xxhash64(i, b).bitwiseAND(F.lit(-BINS)).bitwiseOR(b))
                    return F.array_position(bins, F.array_min(draws).bitwiseAND(F.lit(BINS - 1).cast("long")))

                own = F.array_position(bins, i)
                place = let(own, lambda p: F.when(p > 0, p).otherwise(other()))
                return F.get(values, (place - 1).cast("int"))

            return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), value)

        return let(F.transform(values, _bin), all_bins)

    return let(least, lambda v: F.when(F.size(v) > 0, spread(v)))


def _packed(values: Column) -> Column:
    """The low-order bits of all bins, side by side in 64-bit numbers."""
    low = F.lit((1 << BITS) - 1).cast("long")

    def one(k: Column) -> Column:
        part = F.slice(values, k * _PER_LONG + 1, F.lit(_PER_LONG))
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(low)))

    return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), one))


def fingerprint(text: Column) -> Column:
    """``array<long>`` of a text's packed bits; null for texts without words. Equal texts agree."""
    return let(_dense(_least(shingles(text))), _packed)


def as_text(packed: Column) -> Column:
    """A fingerprint in hexadecimal digits; an empty string where there is none."""
    digits = F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness of two texts, 0 to 1, from their fingerprints.

    Bins that differ still agree in all stored bits once in ``2**BITS`` times; the share of equal
    bins is corrected for that. Two texts without words are alike, one without is like no other.
    """
    ones = F.lit(sum(1 << (k * BITS) for k in range(_PER_LONG))).cast("long")

    def differ(x: Column) -> Column:
        some = x
        for k in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(some.bitwiseAND(ones))

    counts = F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), differ))
    unequal = F.aggregate(counts, F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    estimate = (F.lit(1.0) - unequal / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def with_next(
    df: DataFrame, carry: list[str], computed: dict[str, Column] | None = None, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Add ``next_<column>`` of the next row in descending order of the id; after the last the first.

    ``computed`` columns follow from the carried ones; they are added too, and are evaluated once a
    row and once more for the first row of each range only. Rows without id come last; rows of equal id follow each other by the hash of their text. Rows
    are ordered within ranges of ids, in one shuffle; the first row of each range is found by an
    aggregate and handed to the range before. A single row is its own next.
    """
    stats = df.agg(F.count("*").alias("n"), F.count(id_column).alias("m")).first()
    groups = max(1, min(MOST_GROUPS, stats["n"] // GROUP_ROWS))
    bounds = []
    if groups > 1 and stats["m"]:
        shares = [k / groups for k in range(1, groups)]
        bounds = df.agg(F.percentile_approx(id_column, shares, 10_000)).first()[0]
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>")
    # A larger group stands earlier in the order; ids below all bounds, and none, are last.
    group = F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col(id_column))), F.lit(0))
    group = F.when(F.col(id_column).isNull(), -1).otherwise(group).alias("_group")
    rank = [F.col(id_column).desc_nulls_last(), F.xxhash64(text), F.length(text)]
    rows = df.select("*", group)
    computed = computed or {}
    both = [*carry, *computed]
    window = Window.partitionBy("_group").orderBy(*rank)
    ahead = F.lead(F.struct(*both)).over(window)
    ordered = rows.withColumns(computed).withColumn("_next", ahead)
    key = F.struct(F.bitwise_not(F.coalesce(F.col(id_column), F.lit(0)).cast("long")), F.xxhash64(text), F.length(text))
    first = rows.groupBy("_group").agg(F.min_by(F.struct(*carry), key).alias("_first"))
    first = first.select("_group", "_first.*").withColumns(computed).select("_group", F.struct(*both).alias("_head"))
    by_group = Window.orderBy(F.desc("_group"))
    whole = by_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("_group", F.coalesce(F.lead("_head").over(by_group), F.first("_head").over(whole)).alias("_head"))
    found = F.coalesce("_next", "_head")
    return ordered.join(heads, "_group").select(
        *[F.col(c) for c in [*df.columns, *computed]], *[found[c].alias(f"next_{c}") for c in both]
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first characters of another text."""
    whole, more = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    cut = F.floor(F.length(whole) / 3).cast("int")
    return F.concat(F.substr(whole, F.lit(1), F.length(whole) - cut), F.substr(more, F.lit(1), cut))


def compared(df: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, with their likenesses.

    Null texts count as empty; repeated rows stay, and an empty table gives no rows. Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], {"own": fingerprint(F.col("text"))})
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("next_own").alias("following"),
        edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "following",
        fingerprint(F.col("edited")).alias("changed"),
    ).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
