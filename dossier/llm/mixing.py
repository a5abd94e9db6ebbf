"""Mix sources to target weights: quotas of blocks, a splitting tree over shards, permuted blocks.

Everything here is made of DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import let
from dossier.llm.common import settled

#: Words of a block.
BLOCK_WORDS = 8192
#: Rows of one source that are put in order together, about.
BUCKET_ROWS = 20_000
# Separators are space and tab to carriage return; weights by place of the source.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"
WEIGHTS = (5, 2, 1)
#: Multipliers of the permutation, prime and so one-to-one below any number of blocks that they do not divide.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)


def words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target, quota`` from ``source, source_size``, one row a source.

    Sources in code point order, null last, have the weights in turn. They share ``share`` times
    the sum of all sizes by weight. A source stops at ``most`` times its size; what it leaves is
    shared anew until no source is above. Those stopped are the first in order of that limit
    over the weight: source k is stopped if even the lot left over after all before it is too
    much. ``quota`` is the target in whole words.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("total", total * F.lit(float(share)))
    rows = rows.withColumn("top", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("given", F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("waiting", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    stopped = F.col("top") <= F.col("weight") * (F.col("total") - F.col("given")) / F.col("waiting")
    rows = rows.withColumn("stopped", stopped)
    # What the sources that are not stopped share: the lot after the last that is.
    free = Window.partitionBy()
    rows = rows.withColumn("lot", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("top")).otherwise(0.0)).over(free))
    rows = rows.withColumn("free", F.sum(F.when(~F.col("stopped"), F.col("weight")).otherwise(0.0)).over(free))
    target = F.when(F.col("stopped"), F.col("top")).otherwise(F.col("weight") * F.col("lot") / F.col("free"))
    return rows.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"))


def _number(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts written one after another."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def _chance(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the parts only."""
    return _number(*parts) / F.lit(float(1 << 52))


def _draw(white: Column, lot: Column, take: Column, chance: Column) -> Column:
    """How many of ``take`` draws without replacement from ``lot`` blocks hit one of ``white``.

    The hypergeometric distribution inverted at ``chance``: the weight of each count relative to
    the mode follows from the ratio of neighbours; counts more than 12 deviations from the mean
    have no weight in double precision and are left out.
    """
    white, lot, take = (c.cast("double") for c in (white, lot, take))
    least = F.greatest(F.lit(0.0), take + white - lot)
    most = F.least(white, take)
    mode = F.least(most, F.greatest(least, F.floor((take + 1) * (white + 1) / (lot + 2)).cast("double")))
    spread = F.sqrt(take * (white / lot) * (1 - white / lot)) * 12 + 12
    low = F.greatest(least, mode - F.ceil(spread)).cast("long")
    high = F.least(most, mode + F.ceil(spread)).cast("long")

    def logs(start: Column, end: Column, up: bool) -> Column:
        # Sums of the log ratios from the mode outwards; the mode itself has 0.
        def step(k: Column) -> Column:
            k = k.cast("double")
            up_ratio = F.ln((white - k) * (take - k)) - F.ln((k + 1) * (lot - white - take + k + 1))
            down = F.ln(k * (lot - white - take + k)) - F.ln((white - k + 1) * (take - k + 1))
            return up_ratio if up else down

        steps = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))
        if not up:
            steps = F.reverse(steps)
        zero = F.array().cast("array<double>")
        return F.aggregate(
            steps, zero,
            lambda acc, k: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + step(k))),
        )

    centre = mode.cast("long")
    above = logs(centre, high - 1, True)
    below = F.reverse(logs(low + 1, centre, False))
    weights = F.transform(F.concat(below, F.array(F.lit(0.0)), above), F.exp)

    def pick(w: Column) -> Column:
        whole = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        found = F.aggregate(
            w, F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.struct(
                (a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= chance * whole, 1).otherwise(0)).alias("n")
            ),
        )
        return found["n"]

    drawn = F.least(high, low + let(weights, pick))
    return F.when((lot <= 0) | (take <= 0) | (white <= 0), F.lit(0).cast("long")).otherwise(drawn)


def _halves(level: int, seed: int) -> Callable[[Column], Column]:
    """What the left half of a node takes of each of its ``lots``, given their sum."""

    def add(acc: Column, x: Column) -> Column:
        chance = _chance(F.lit(seed), F.lit(level), F.col("node"), x["place"])
        got = _draw(x["blocks"], acc["lot"], acc["take"], chance)
        return let(got, lambda g: F.struct(
            (acc["lot"] - x["blocks"]).alias("lot"), (acc["take"] - g).alias("take"),
            F.concat(acc["left"], F.array(g)).alias("left"),
        ))

    def halves(total: Column) -> Column:
        start = F.struct(
            total.alias("lot"),
            # Odd totals give their extra block to either half in turn.
            F.floor((total + F.pmod(F.col("node") + level, F.lit(2))) / 2).cast("long").alias("take"),
            F.array().cast("array<bigint>").alias("left"),
        )
        return F.aggregate("lots", start, add, lambda acc: acc["left"])

    return halves


def split_tree(quotas: DataFrame, levels: int, seed: int = 3) -> DataFrame:
    """``source, shard, blocks, before``: the blocks of each source's quota in each of 2**levels shards.

    ``quotas`` has ``source, blocks``. At each node the blocks of all sources are split in two
    halves, equal or one block apart, by a multivariate hypergeometric draw: source after source
    takes its share of the half from what is left. ``before`` counts the source's blocks in
    earlier shards. The draws depend on the seed, the node and the source only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    tree = (
        quotas.withColumn("place", F.row_number().over(order))
        .agg(F.array_sort(F.collect_list(F.struct("place", "source", F.col("blocks").cast("long").alias("blocks")))).alias("lots"))
        .select(F.lit(0).cast("long").alias("node"), "lots")
    )
    for level in range(levels):
        count = F.aggregate("lots", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        tree = tree.withColumn("left", let(count, _halves(level, seed)))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("lots", "left", lambda x, g: F.struct(
                x["place"].alias("place"), x["source"].alias("source"), g.alias("blocks"))).alias("lots")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("lots", "left", lambda x, g: F.struct(
                x["place"].alias("place"), x["source"].alias("source"), (x["blocks"] - g).alias("blocks"))).alias("lots")),
        )
        tree = tree.select(F.inline(sides))
        # The next level reads each node twice.
        tree = settled(tree)
    by_source = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tree.select(F.col("node").alias("shard"), F.inline("lots"))
        .withColumn("before", F.sum("blocks").over(by_source) - F.col("blocks"))
        .select("source", "shard", "blocks", "before")
    )


def mix(
    df: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, levels: int = 4, seed: int = 3
) -> DataFrame:
    """Every row's place in the mix; sources that are null are one source.

    Columns: ``doc_id``, ``source``, ``sign`` (hash of the text), ``size`` (words),
    ``source_size``, ``target`` and ``quota`` of its source, and ``pieces``: an array of ``start, length`` (words of the text), ``block``, ``shard`` and
    ``sort_key``. Pieces of a shard in the order of ``sort_key`` are that shard's mix.

    The rows of a source, in an order given by the MD5 of their id, are one line of words, walked
    through as often as the quota lasts and cut into blocks of ``BLOCK_WORDS`` words. The tree
    says how many blocks each shard gets; a permutation of the source's blocks says which. Each
    block goes to one shard, so pieces never overlap and sum up to the quota exactly. Rows without
    words have no pieces. Reruns agree; rows alike in id, text and source may change places.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    small = settled(df.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("sign"), key))
    sources = settled(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    plan = targets(sources.select("source", "source_size"), share, most, weights)
    blocks = F.ceil(F.col("quota") / F.lit(BLOCK_WORDS)).cast("long")
    plan = settled(plan.withColumn("blocks", blocks))
    tree = split_tree(plan.select("source", "blocks"), levels, seed)
    lots = tree.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("before", "blocks", "shard"))).alias("lots"))
    per_source = plan.join(lots, plan["source"].eqNullSafe(lots["source"]), "left").drop(lots["source"])

    # Each row's place on its source's line: sums of buckets of the order, then within buckets.
    most_rows = sources.agg(F.max("rows")).first()[0] or 0
    digits = 1
    while 16**digits * BUCKET_ROWS < most_rows:
        digits += 1
    small = small.withColumn("bucket", F.substring("key", 1, digits))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "sign", "size")
    rows = small.withColumn("within", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    buckets = small.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = buckets.withColumn("base", F.sum("words").over(order) - F.col("words")).drop("words")
    starts = starts.join(per_source, starts["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    placed = rows.join(
        starts, rows["source"].eqNullSafe(starts["source"]) & (rows["bucket"] == starts["bucket"])
    ).drop(starts["source"], starts["bucket"])
    first = F.col("base") + F.col("within")
    return placed.select(
        "doc_id", "source", "sign", "size", "source_size", "target", "quota", _pieces(first, seed).alias("pieces")
    )


def mixed_texts(df: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``df`` as the mix takes them: one row for each walk through a text, by shard and shuffled there.

    A walk goes to the shard of its first piece; the rows of a shard lie in parts, each in the
    order of the pieces' ``sort_key``. A walk that the quota cuts off has only the words before
    the cut, everything else has the whole text. Columns stay as they are but for ``text`` and,
    where it is there, ``n_chars``. Rows alike in id and text count as one row that is walked
    through as often as all of them; of their other columns those of any one are kept. Rows without words (null, empty, blank texts)
    are not taken; an empty table stays empty.
    """
    start = F.array().cast("array<struct<words:bigint,shard:bigint,sort_key:bigint>>")
    walk = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("sort_key"))

    def add(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), walk)
        longer = F.struct((last["words"] + x["length"]).alias("words"), last["shard"].alias("shard"), last["sort_key"].alias("sort_key"))
        new = F.struct(x["length"].alias("words"), x["shard"].cast("long").alias("shard"), x["sort_key"].alias("sort_key"))
        return F.when(x["start"] == 0, F.concat(acc, F.array(new))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        )

    taken = (
        mixed.filter(F.size("pieces") > 0).groupBy("doc_id", "sign")
        .agg(F.flatten(F.collect_list(F.aggregate("pieces", start, add))).alias("_walks"), F.first("size").alias("_size"))
        .withColumnsRenamed({"doc_id": "_id", "sign": "_sign"})
    )
    # The row travels as one struct, so its columns may have any names.
    rows = (
        df.select("doc_id", F.xxhash64("text").alias("sign"), F.struct("*").alias("row"))
        .dropDuplicates(["doc_id", "sign"])
    )
    joined = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_id"]) & (rows["sign"] == taken["_sign"]))
    joined = joined.select("row", "_size", F.explode("_walks").alias("walk"))
    # Cut before every word; a text that begins with white space has one part more.
    parts = F.split("row.text", f"(?<={SPACE})(?={WORD[:-1]})")
    count = (F.col("walk.words") + F.col("row.text").rlike(f"^{SPACE}").cast("int")).cast("int")
    text = F.when(F.col("walk.words") >= F.col("_size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), count), "")
    )
    # As many parts as shuffles have: several for each shard where there are more of them.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = joined.withColumn("text", text).withColumn("lot", F.pmod("walk.sort_key", F.lit(max(1, n))))
    out = out.repartition(n, "walk.shard", "lot").sortWithinPartitions("walk.shard", "walk.sort_key")
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[
        changed[c].cast(df.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c)
        for c in df.columns
    ])


def _pieces(first: Column, seed: int) -> Column:
    """The pieces of a row whose words start at ``first`` on its source's line."""
    size, whole, quota = F.col("size"), F.col("source_size"), F.col("quota")
    passes = F.ceil(quota / F.greatest(whole, F.lit(1))).cast("long")

    def of_pass(p: Column) -> Column:
        start = p * whole + first
        end = F.least(start + size, quota)
        blocks = F.sequence(F.floor(start / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))

        def cut(b: Column) -> Column:
            a = F.greatest(start, b * BLOCK_WORDS)
            return F.struct(
                (a - start).alias("start"), (F.least(end, (b + 1) * BLOCK_WORDS) - a).alias("length"),
                b.alias("block"), _shard(b, seed).alias("shard"),
                F.xxhash64(F.lit(seed), F.col("doc_id"), a).alias("sort_key"),
            )

        return F.when(end > start, F.transform(blocks, cut)).otherwise(F.filter(F.transform(F.array(F.lit(0).cast("long")), cut), lambda x: F.lit(False)))

    walked = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(passes, F.lit(1)) - 1), of_pass)
    return F.flatten(walked)


def _shard(block: Column, seed: int) -> Column:
    """The shard of a block: its number in the source's permutation falls into a shard's lot."""
    n = F.greatest(F.col("blocks"), F.lit(1))

    def moves(prime: int) -> Column:
        # A prime that leaves 0, 1 or -1 would mix nothing.
        left = F.pmod(F.lit(prime), n)
        return (left > 1) & (left < n - 1)

    first, second, third = PRIMES
    factor = F.when(moves(first), F.lit(first)).when(moves(second), F.lit(second)).otherwise(F.lit(third))
    turn = F.pmod(F.pmod(block, n) * factor + F.pmod(_number(F.lit(seed), n), n), n)
    lot = F.filter("lots", lambda x: (x["before"] <= turn) & (turn < x["before"] + x["blocks"]))
    return F.get(lot, F.lit(0))["shard"]


def shard_words(levels: int = 4) -> Column:
    """Words of a row's pieces in each shard, as an array by shard."""
    shards = F.sequence(F.lit(0).cast("long"), F.lit((1 << levels) - 1).cast("long"))
    # The pieces are an expression of their own, which is to be evaluated once.
    return let(F.col("pieces"), lambda pieces: F.transform(shards, lambda s: F.aggregate(
        F.filter(pieces, lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda acc, x: acc + x["length"]
    )))
