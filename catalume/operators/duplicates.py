"""Near-duplicate assets by the Hamming distance of 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..cluster import checkpointed
from ..functions.hashing import hamming, parse_hash64
from .covering import meeting_pairs
from .files import representative_file
from .graph import connected_components
from .inventory import delete_assets

#: Bits that two hashes may differ in.
THRESHOLD = 8
#: Distinct hashes of a group that are compared together.
GROUP_BLOCK = 1000
#: Greatest distance that the complement of a hash is looked up in.
NEAR_COMPLEMENT = 9


def hamming_pairs(hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, distance) with a < b of all pairs of distinct hashes (column hash) within the threshold; exact.

    Hashes meet under the masks of a covering code, chosen by how many there are; a pair is kept at the first mask it
    agrees under, so nothing has to be made distinct afterwards.
    """
    h = checkpointed(hashes.select(F.col("hash").alias("number")).where("number is not null").distinct())
    return meeting_pairs(h, None, [], threshold, h.count()).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def duplicate_groups(hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, hash, group) of items that share a group by a chain of pairs within the threshold; group is its least hash.

    hashes: id, hash. Equal hashes are one node, so a flat image is no hot key.
    """
    valid = hashes.where("hash is not null")
    near = connected_components(hamming_pairs(valid, threshold))
    grouped = valid.join(near.select(F.col("node").alias("hash"), "component"), "hash", "left").withColumn("group", F.coalesce("component", "hash"))
    several = grouped.groupBy("group").count().where("count > 1").select("group")
    return grouped.join(several, "group", "left_semi").select("id", "hash", "group")


def group_diameters(groups: DataFrame, block: int = GROUP_BLOCK) -> DataFrame:
    """(group, max_distance): the greatest distance of two hashes of each group (group, hash); exact.

    Two sweeps from farthest to farthest give a distance that is there. A pair beats it only if both distances to the
    group's centre (the majority of each bit) add up to more, so hashes too near to it drop out. What is left in a small
    group is compared; in a large one whose distance is great already, hashes meet the complements of others, from which
    a still greater distance is a short way; else cells of two blocks of hashes, by their distance to the centre, are compared.
    """
    h = checkpointed(groups.where("hash is not null").select("group", "hash").distinct())

    def farthest(start: DataFrame, name: str) -> DataFrame:
        """group, the hash farthest from the start's, and that distance."""
        d = hamming(F.col("hash"), F.col("__s"))
        return h.join(start.toDF("group", "__s"), "group").groupBy("group").agg(F.max(F.struct(d.alias("d"), "hash")).alias("m")).select("group", F.col("m.hash").alias(name), F.col("m.d").alias("far"))

    bits = [F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    centre = F.lit(0).cast("long")
    for i in range(64):
        centre = centre.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middle = h.groupBy("group").agg(F.count("*").alias("n"), *bits).select("group", centre.alias("centre"))
    one = farthest(middle, "one").select("group", "one")
    two = farthest(one, "two").select("group", "two")
    known = farthest(two, "three").select("group", F.col("far").alias("known")).join(middle, "group")
    near = hamming(F.col("hash"), F.col("centre"))
    reach = h.join(known, "group").groupBy("group").agg(F.max("known").alias("known"), F.max("centre").alias("centre"), F.max(near).alias("radius"))
    known = checkpointed(reach)
    left = checkpointed(h.join(known, "group").withColumn("d", near).where("d + radius > known").select("group", "hash", "d", "known"))
    sizes = left.groupBy("group").count()
    size = F.col("count")
    few = size <= block
    marked = left.join(sizes, "group").withColumn("how", F.when(few, 0).when(F.col("known") >= 63 - NEAR_COMPLEMENT, 1).otherwise(2))
    asked = marked.where("how = 1").select("group", F.col("hash").alias("number"))
    flipped = asked.select("group", F.bitwise_not("number").alias("number"))
    n = sizes.agg(F.max("count")).first()[0] or 0
    far = meeting_pairs(asked, flipped, ["group"], NEAR_COMPLEMENT, n).groupBy("group").agg(F.max(64 - hamming(F.col("a"), F.col("b"))).alias("most"))
    # Blocks by distance to the centre: those of two cells whose distances add up to too little don't meet.
    per = F.when(few, 1).otherwise(F.ceil(size / F.lit(block)).cast("int"))
    placed = marked.where("how <> 1").withColumn("per", per).withColumn("sub", F.pmod(F.xxhash64("hash"), "per").cast("int"))
    mine = F.when(F.col("how") == 0, F.lit(0)).otherwise(F.col("d") * F.col("per") + F.col("sub"))
    blocks = checkpointed(placed.withColumn("block", mine))
    there = blocks.select("group", "block", F.when(F.col("how") == 0, 64).otherwise(F.col("d")).alias("d"), "known").distinct()
    x, y = there.select("group", F.col("block").alias("low"), F.col("d").alias("dx"), "known"), there.select("group", F.col("block").alias("high"), F.col("d").alias("dy"))
    cells = x.join(y, "group").where("low <= high and dx + dy > known").select("group", "low", "high")
    a = blocks.select("group", F.col("block").alias("low"), F.col("hash").alias("a"))
    b = blocks.select("group", F.col("block").alias("high"), F.col("hash").alias("b"))
    compared = cells.join(a, ["group", "low"]).join(b, ["group", "high"]).groupBy("group").agg(F.max(hamming(F.col("a"), F.col("b"))).alias("most"))
    best = far.unionByName(compared).groupBy("group").agg(F.max("most").alias("most"))
    return known.join(best, "group", "left").select("group", F.greatest("known", F.coalesce("most", F.lit(0))).alias("max_distance"))


def duplicate_group_summary(groups: DataFrame) -> DataFrame:
    """Per group its number of members and the greatest distance of two of them (which may exceed the threshold); largest
    first. Members stay rows of ``groups``."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n_members"))
    return sizes.join(group_diameters(groups), "group").select("group", "n_members", "max_distance").orderBy(F.desc("n_members"), "group")


def representative_hashes(catalog: Catalog) -> DataFrame:
    """(id, hash) of each asset whose representative file has a valid perceptual hash."""
    ph = catalog.fingerprints.where("hash_type = 'phash'").select(F.col("file_id").alias("__f"), parse_hash64(F.col("value")).alias("hash"))
    return representative_file(catalog.files).join(ph, F.col("id") == F.col("__f")).where("hash is not null").select(F.col("asset_id").alias("id"), "hash")


#: What a review shows of each member beside its id.
_SHOWN = ("path", "codec", "width", "height", "duration", "size_bytes", "fps", "bitrate")


def find_duplicates(catalog: Catalog, threshold: int = THRESHOLD) -> DataFrame:
    """Assets that share a group by the perceptual hash of their representative file, a row each: group (its least hash),
    n_members, max_distance, id, title, favorite and the facts of that file. Groups are largest first, members by id."""
    groups = checkpointed(duplicate_groups(representative_hashes(catalog), threshold))
    members = groups.join(duplicate_group_summary(groups), "group").select("group", "n_members", "max_distance", "id")
    assets = catalog.assets.select("id", *[c for c in ("title", "favorite") if c in catalog.assets.columns])
    shown = [c for c in _SHOWN if c in catalog.files.columns]
    files = representative_file(catalog.files.join(members.select(F.col("id").alias("__m")), F.col("asset_id") == F.col("__m"), "left_semi")).select(F.col("asset_id").alias("id"), *shown)
    return members.join(assets, "id", "left").join(files, "id", "left").orderBy(F.desc("n_members"), "group", "id")


def default_keeper(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """(group, keeper, favorite): the member with the highest favorite, the first id on ties, and that favorite."""
    rated = groups.join(assets.select(F.col("id"), "favorite"), "id")
    return rated.groupBy("group").agg(F.min_by("id", F.struct(-F.col("favorite"), F.col("id"))).alias("keeper"), F.max("favorite").alias("favorite"))


def merge_duplicates(catalog: Catalog, groups: DataFrame, keepers: DataFrame) -> Catalog:
    """The catalog with each group's keeper alone, at the group's highest favorite."""
    best = groups.join(catalog.assets.select("id", "favorite"), "id").groupBy("group").agg(F.max("favorite").alias("__best"))
    raised = keepers.select("group", F.col("keeper").alias("__keeper")).join(best, "group").select("__keeper", "__best")
    assets = catalog.assets.join(raised, F.col("id") == F.col("__keeper"), "left").withColumn("favorite", F.greatest("favorite", F.coalesce("__best", F.col("favorite")))).select(*catalog.assets.columns)
    gone = groups.join(keepers.select(F.col("keeper").alias("__keeper")), F.col("id") == F.col("__keeper"), "left_anti").select("id")
    return delete_assets(catalog.but(assets=assets), gone)
