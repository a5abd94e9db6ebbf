"""Match of list items to folders by exact id, contained id and id fragments.

A nested loop over items and folders is avoided: folder names are cut into all parts of
the lengths that occur among the ids, and the parts are joined to the ids by equality.
Items look at counts per id, so no step forms pairs of items and folders.

``items(item, sap, teamcenter)`` and ``folders(folder, name)``; ``folder`` identifies a
folder, ``name`` is the text its ids are searched in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ids import fragments, parts_of_lengths
from dossier.functions.text import cell_id, plain_id, search_id
from dossier.operators.spread import lookup_join, settled

AMBIGUOUS_PREFIX = "AMBIGUOUS_"


def containment(ids: DataFrame, folders: DataFrame) -> DataFrame:
    """All (id, folder, key, exact) where the folder's ``key`` contains the id.

    ``ids(id)`` must be distinct. Per folder there are at most as many rows as its name
    has parts, however many items share an id.
    """
    # One small aggregate: the set of lengths is no larger than the longest id.
    lengths = ids.agg(F.collect_set(F.length("id")).alias("lengths")).first().lengths
    parts = folders.select(
        "folder", "key", F.explode(parts_of_lengths(F.col("key"), sorted(lengths) or [1])).alias("id")
    )
    # Sizes are estimated without the parts that ``explode`` adds, so a broadcast would be of far
    # more rows than it is chosen for.
    hits = parts.hint("merge").join(ids, "id")
    return hits.select("id", "folder", "key", (F.col("key") == F.col("id")).alias("exact"))


def hit_index(hits: DataFrame) -> DataFrame:
    """Per id: number of folders that equal or contain it, and the first of each."""
    return hits.groupBy("id").agg(
        F.count_if("exact").alias("n_exact"),
        F.min(F.when(F.col("exact"), F.col("folder"))).alias("f_exact"),
        F.count("*").alias("n_in"), F.min("folder").alias("f_in"),
    )


def _keyed(items: DataFrame, folders: DataFrame, norm: Callable[[Column], Column], shortest: int):
    def key(name: str) -> Column:
        value = norm(F.col(name))
        return F.when(F.length(value) >= shortest, value)

    keyed_items = items.select("item", key("sap").alias("sap"), key("teamcenter").alias("tc"))
    keyed_folders = folders.select("folder", norm(F.col("name")).alias("key"))
    return keyed_items, keyed_folders


def _all_ids(items: DataFrame) -> DataFrame:
    return items.select(F.explode(F.array("sap", "tc")).alias("id")).where("id is not null").distinct()


def _with_counts(items: DataFrame, index: DataFrame) -> DataFrame:
    """Items with the index columns of both ids, suffixed ``_sap`` and ``_tc``."""
    names = ["n_exact", "f_exact", "n_in", "f_in"]
    for column in ("sap", "tc"):
        side = index.select(F.col("id").alias(column), *[F.col(n).alias(f"{n}_{column}") for n in names])
        items = lookup_join(items, side.hint("merge"), [column], ["item"])
    counts = [f"{n}_{c}" for n in ("n_exact", "n_in") for c in ("sap", "tc")]
    return items.na.fill(0, counts)


def match_cascade(items: DataFrame, folders: DataFrame, shortest_fragment: int = 6) -> DataFrame:
    """Exact first id, exact second id, contained first id, contained second id, then
    fragments of the second id, longest first. A step with several folders ends the search
    as ambiguous. Returns ``item, folder, status, n_candidates, fragment``.
    """
    keyed_items, keyed_folders = _keyed(items, folders, plain_id, 1)
    index = settled(hit_index(containment(_all_ids(keyed_items), keyed_folders)))
    counted = _with_counts(keyed_items, index)
    steps = [
        ("n_exact_sap", "f_exact_sap", "EXACT_ASSEMBLY_ID"),
        ("n_exact_tc", "f_exact_tc", "EXACT_TEAMCENTER_ID"),
        ("n_in_sap", "f_in_sap", "CONTAINS_ASSEMBLY_ID"),
        ("n_in_tc", "f_in_tc", "CONTAINS_TEAMCENTER_ID"),
    ]
    outcome = F.coalesce(*[
        F.when(F.col(n) > 0, F.struct(F.col(n).alias("n"), F.col(f).alias("f"), F.lit(s).alias("s")))
        for n, f, s in steps
    ])
    decided = counted.select("item", "sap", "tc", outcome.alias("o"))

    # Fragments are tried only for the second ids of items still open.
    open_ids = settled(decided.where("o is null and tc is not null").select("tc").distinct())
    pieces = open_ids.select(
        "tc", F.posexplode(fragments(F.col("tc"), shortest_fragment)).alias("rank", "id")
    )
    index = hit_index(containment(pieces.select("id").distinct(), keyed_folders))
    index = settled(index.select("id", "n_in", "f_in"))
    best = settled(
        lookup_join(pieces, index.hint("merge"), ["id"], ["tc", "rank"])
        .where("n_in is not null").groupBy("tc")
        .agg(F.min(F.struct("rank", F.col("n_in").alias("n"), F.col("f_in").alias("f"), "id")).alias("b"))
    )
    open_key = F.when(F.col("o").isNull(), F.col("tc"))
    final = lookup_join(decided.withColumn("tc_open", open_key),
                        best.select(F.col("tc").alias("tc_open"), "b").hint("merge"), ["tc_open"], ["item"])
    n = F.coalesce("o.n", "b.n", F.lit(0))
    step = F.coalesce("o.s", F.when(F.col("b").isNotNull(), "TEAMCENTER_FRAGMENT"))
    return final.select(
        "item",
        F.when(n == 1, F.coalesce("o.f", "b.f")).alias("folder"),
        F.when(n == 1, step).when(n > 1, F.concat(F.lit(AMBIGUOUS_PREFIX), step))
        .when(F.col("sap").isNull() & F.col("tc").isNull(), "NO_IDENTIFIER")
        .otherwise("NOT_FOUND").alias("status"),
        n.alias("n_candidates"), F.col("b.id").alias("fragment"),
    )


def _both_ids(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Per pair of different ids on one item: folders that contain both."""
    pairs = items.where("sap is not null and tc is not null and sap <> tc").select("sap", "tc").distinct()
    # Only wanted pairs are formed: those of a first id that was found, in the folders it is in.
    return (
        pairs.hint("merge").join(hits.select(F.col("id").alias("sap"), "folder", "key"), "sap")
        .where(F.col("key").contains(F.col("tc"))).groupBy("sap", "tc")
        .agg(F.count("*").alias("n_both"), F.min("folder").alias("f_both"))
    )


def _counted_pairs(items: DataFrame, folders: DataFrame, norm, shortest: int) -> DataFrame:
    """Items with counts per id and for both, and ``n_any``: folders containing either."""
    keyed_items, keyed_folders = _keyed(items, folders, norm, shortest)
    hits = settled(containment(_all_ids(keyed_items), keyed_folders))
    counted = _with_counts(keyed_items, hit_index(hits))
    counted = lookup_join(counted, _both_ids(keyed_items, hits).hint("merge"), ["sap", "tc"], ["item"])
    same = F.coalesce(F.col("sap") == F.col("tc"), F.lit(False))
    both = F.when(same, F.col("n_in_sap")).otherwise(F.coalesce("n_both", F.lit(0)))
    return (
        counted.withColumn("same", same).withColumn("n_both", both)
        .withColumn("f_both", F.when(same, F.col("f_in_sap")).otherwise(F.col("f_both")))
        .withColumn("n_any", F.col("n_in_sap") + F.col("n_in_tc") - F.col("n_both"))
    )


def _methods(prefix: str, by_sap: Column, by_tc: Column) -> Column:
    return F.concat(
        F.lit(prefix), F.concat_ws("+", F.when(by_sap, "SAP"), F.when(by_tc, "TEAMCENTER"))
    )


def match_two_tier(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Exact on either id, then contained; several contained candidates are resolved when
    exactly one holds both ids. Returns ``item, folder, status, n_candidates, message``."""
    c = _counted_pairs(items, folders, cell_id, 1)
    n_exact = F.col("n_exact_sap") + F.when(F.col("same"), F.lit(0)).otherwise(F.col("n_exact_tc"))
    exact_sap, exact_tc = F.col("n_exact_sap") > 0, F.col("n_exact_tc") > 0
    in_sap, in_tc = F.col("n_in_sap") > 0, F.col("n_in_tc") > 0
    two_ids = F.col("sap").isNotNull() & F.col("tc").isNotNull()
    by_both = (F.col("n_any") > 1) & two_ids & (F.col("n_both") == 1)
    none = F.col("sap").isNull() & F.col("tc").isNull()
    status = (
        F.when(none, "NO_IDENTIFIER")
        .when(n_exact == 1, _methods("EXACT_", exact_sap, exact_tc))
        .when(n_exact > 1, "AMBIGUOUS_EXACT")
        .when(F.col("n_any") == 1, _methods("CONTAINS_", in_sap, in_tc))
        .when(by_both, "CONTAINS_SAP+TEAMCENTER")
        .when(F.col("n_any") > 1, "AMBIGUOUS_CONTAINS")
        .otherwise("NOT_FOUND")
    )
    folder = (
        F.when(n_exact == 1, F.coalesce("f_exact_sap", "f_exact_tc"))
        .when(n_exact > 1, F.lit(None).cast("string"))
        .when(F.col("n_any") == 1, F.coalesce("f_in_sap", "f_in_tc"))
        .when(by_both, F.col("f_both"))
    )
    message = (
        F.when(status == "NO_IDENTIFIER", "SAP-Nummer und Teamcenter ID fehlen")
        .when(status == "AMBIGUOUS_EXACT", "Mehrere exakte Treffer")
        .when(status == "AMBIGUOUS_CONTAINS", "Mehrere Teiltreffer")
        .when(status == "NOT_FOUND", "Kein Ordner enthaelt SAP- oder Teamcenter-ID")
        .otherwise("")
    )
    candidates = F.when(n_exact > 0, n_exact).otherwise(F.col("n_any"))
    return c.select("item", folder.alias("folder"), status.alias("status"),
                    candidates.alias("n_candidates"), message.alias("message"))


def match_either(items: DataFrame, folders: DataFrame, shortest_id: int = 4) -> DataFrame:
    """The only folder, at any depth, whose name contains either id."""
    c = _counted_pairs(items, folders, search_id, shortest_id)
    n = F.col("n_any")
    status = (
        F.when(F.col("sap").isNull() & F.col("tc").isNull(),
               "Keine gueltige SAP- oder Teamcenter-Nummer")
        .when(n == 1, "OK").when(n == 0, "Kein passender Ordner gefunden")
        .otherwise(F.format_string("Mehrere passende Ordner gefunden (%d)", n))
    )
    return c.select("item", F.when(n == 1, F.coalesce("f_in_sap", "f_in_tc")).alias("folder"),
                    status.alias("status"), n.alias("n_candidates"))


def candidate_folders(items: DataFrame, folders: DataFrame, norm=cell_id) -> DataFrame:
    """Long table of the folders behind ambiguous ids: ``id, folder, exact``."""
    keyed_items, keyed_folders = _keyed(items, folders, norm, 1)
    return containment(_all_ids(keyed_items), keyed_folders).drop("key")


def two_tier_candidates(items: DataFrame, folders: DataFrame) -> DataFrame:
    """``item, tier, folder``: every candidate of the items that ``match_two_tier`` leaves
    ambiguous, of the tier that made them so."""
    keyed_items, keyed_folders = _keyed(items, folders, cell_id, 1)
    open_items = match_two_tier(items, folders).where(F.col("status").startswith(AMBIGUOUS_PREFIX)).select(
        "item", F.substr("status", F.lit(len(AMBIGUOUS_PREFIX) + 1)).alias("tier"))
    wanted = keyed_items.join(open_items, "item").select("item", "tier", F.explode(F.array("sap", "tc")).alias("id"))
    hits = containment(wanted.where("id is not null").select("id").distinct(), keyed_folders)
    return wanted.join(hits, "id").where("exact or tier = 'CONTAINS'").select("item", "tier", "folder").distinct()


def match_by_name(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Items whose id, as text, is a folder's name."""
    names = folders.groupBy(F.col("name").alias("_key")).agg(F.min("folder").alias("folder"))
    keyed = items.withColumn("_key", F.col("sap").cast("string"))
    return lookup_join(keyed, names, ["_key"], ["item"]).drop("_key")
