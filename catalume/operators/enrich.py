"""Metadata from paths and files: names of the catalog found in paths, titles, embedded fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..cluster import checkpointed
from ..functions.names import bracket_studios, folder_hints, normalize_for_match, path_haystack, pretty_tag, stem, tag_candidates, title_from_path

#: Characters that a name must have to be looked for.
LEAST_NAME = 3
#: Characters of all names up to which they are held in memory by every task.
MOST_CHARACTERS = 1_000_000


def _machine(names: list[str]) -> ahocorasick.Automaton:
    """Finds all names at once as whole words of a text with a blank at either end."""
    machine = ahocorasick.Automaton()
    for n in names:
        machine.add_word(f" {n} ", n)
    machine.make_automaton()
    return machine


def _found(names: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = _machine(names.value)
    for b in batches:
        at, norm = [], []
        for i, text in enumerate(b.column("w").to_pylist()):
            hits = {n for _, n in machine.iter(f" {text} ")} if text else ()
            at += [i] * len(hits)
            norm += hits
        if at:
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(norm)], ["id", "norm"])


def _met(words: DataFrame, d: DataFrame) -> DataFrame:
    """(id, norm) for any number of names: those with two words or more meet the pairs of neighbouring words of a path, the
    others its words; the rest of a name is compared where it would stand."""
    first = F.slice("n", 1, 2)
    names = d.select("norm").distinct().withColumn("n", F.split("norm", " ")).select("norm", "n", F.array_join(first, " ").alias("start"), (F.size("n") > 1).alias("several"))
    placed = words.select("id", "w", F.posexplode("w").alias("at", "word"))
    pair = F.concat_ws(" ", "word", F.try_element_at("w", F.col("at") + 2))
    starts = F.array(F.struct(F.col("word").alias("start"), F.lit(False).alias("several")), F.struct(pair.alias("start"), F.lit(True).alias("several")))
    asked = placed.select("id", "w", "at", F.explode(starts).alias("s")).select("id", "w", "at", "s.*")
    met = asked.join(names, ["start", "several"]).where(F.slice("w", F.col("at") + 1, F.size("n")) == F.col("n"))
    return met.select("id", "norm").distinct()


def match_catalog_names(paths: DataFrame, dictionary: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """(id, kind, dim_id, name, norm): names of the dictionary (kind, dim_id, name) that occur as whole words in a path.

    A dictionary of up to ``most`` characters becomes an automaton in each task, which reads a path once whatever the
    number of names; a larger one meets the words of the paths in a join.
    """
    d = checkpointed(dictionary.select("kind", "dim_id", "name", normalize_for_match(F.col("name")).alias("norm")).where(F.char_length("norm") >= LEAST_NAME))
    haystack = path_haystack(F.col("path"))
    if (d.agg(F.sum(F.char_length("norm") + 2)).first()[0] or 0) > most:
        return _met(paths.select("id", F.split(haystack, " ").alias("w")), d).join(d, "norm").select("id", "kind", "dim_id", "name", "norm")
    names = paths.sparkSession.sparkContext.broadcast(sorted({r["norm"] for r in d.select("norm").distinct().collect()}))
    texts = paths.select("id", haystack.alias("w"))
    hits = texts.mapInArrow(partial(_found, names), StructType([texts.schema["id"], StructField("norm", StringType())]))
    return hits.join(F.broadcast(d), "norm").select("id", "kind", "dim_id", "name", "norm")


def subsume_names(hits: DataFrame) -> DataFrame:
    """Hits without those whose name is part of a longer one of the same path and kind."""
    longer = hits.select(F.col("id").alias("__i"), F.col("kind").alias("__k"), F.col("norm").alias("__n"))
    part = (F.col("id") == F.col("__i")) & (F.col("kind") == F.col("__k")) & (F.char_length("__n") > F.char_length("norm")) & F.col("__n").contains(F.col("norm"))
    return hits.join(longer, part, "left_anti")


def path_hits(paths: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Hits by name, folder hint and tag word, each an existing name; rank 0 to 2 tells the source."""
    by_name = subsume_names(match_catalog_names(paths, dictionary)).select("id", "kind", "dim_id", "name", F.lit(0).alias("rank"), F.char_length("norm").alias("len"))
    known = dictionary.select(F.col("kind").alias("__k"), F.lower("name").alias("__n"), "dim_id", "name")
    hints = paths.select("id", F.explode(folder_hints(F.col("path"))).alias("h")).select("id", F.col("h.kind").alias("kind"), F.col("h.name").alias("hint"), F.lit(1).alias("rank"))
    tags = paths.select("id", F.explode(tag_candidates(stem(F.col("path")))).alias("hint")).select("id", F.lit("tag").alias("kind"), "hint", F.lit(2).alias("rank"))
    more = hints.unionByName(tags).join(known, (F.col("kind") == F.col("__k")) & (F.lower("hint") == F.col("__n"))).select("id", "kind", "dim_id", "name", "rank", F.char_length("name").alias("len"))
    return by_name.unionByName(more)


def link_path_metadata(assets: DataFrame, paths: DataFrame, dictionary: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new studio per asset without one, new links). paths: id (of the asset), path; links: id, kind, dim_id.

    Of several studios the first source wins, in it the longest name.
    """
    hits = path_hits(paths, dictionary)
    free = assets.where("studio_id is null").select(F.col("id").alias("__id"))
    studio = hits.where("kind = 'studio'").join(free, F.col("id") == F.col("__id"), "left_semi").groupBy("id").agg(F.min_by("dim_id", F.struct("rank", -F.col("len"), "name")).alias("studio_id"))
    new = hits.where("kind != 'studio'").select("id", "kind", "dim_id").distinct().join(links, ["id", "kind", "dim_id"], "left_anti")
    return studio, new


def path_link_summary(paths: DataFrame, studio: DataFrame, new: DataFrame) -> DataFrame:
    """Assets looked at, with new links, and the links of each kind, in one row."""
    all_ = studio.select("id", F.lit("studio").alias("kind")).unionByName(new.select("id", "kind"))
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s_linked")
    linked = all_.agg(F.count_distinct("id").alias("assets_linked"), n("studio"), n("person"), n("tag"))
    return paths.agg(F.count_distinct("id").alias("assets_scanned")).crossJoin(F.broadcast(linked))


def suggest_path_metadata(paths: DataFrame, dictionary: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kind, name, dim_id, source, create_new, already_linked): what a path suggests, from names of the
    catalog, folders, brackets and tag words in this order; each name once."""
    known = dictionary.groupBy(F.col("kind").alias("__k"), F.lower("name").alias("__n")).agg(F.min("dim_id").alias("__d"))
    named = subsume_names(match_catalog_names(paths, dictionary)).select("id", "kind", "name", F.lit("catalog").alias("source"), F.lit(0).alias("rank"), (-F.char_length("norm")).alias("pos"))
    parts = [named]
    for rank, (source, column) in enumerate((("folder", folder_hints(F.col("path"))), ("bracket", F.transform(bracket_studios(stem(F.col("path"))), lambda s: F.struct(F.lit("studio").alias("kind"), s.alias("name")))), ("token", F.transform(tag_candidates(stem(F.col("path"))), lambda t: F.struct(F.lit("tag").alias("kind"), pretty_tag(t).alias("name"))))), 1):
        parts.append(paths.select("id", F.posexplode(column).alias("pos", "h")).select("id", "h.kind", "h.name", F.lit(source).alias("source"), F.lit(rank).alias("rank"), "pos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    nth = F.row_number().over(Window.partitionBy("id", "kind", F.lower("name")).orderBy("rank", "pos", "name"))
    one = out.withColumn("nth", nth).where("nth = 1").join(known, (F.col("kind") == F.col("__k")) & (F.lower("name") == F.col("__n")), "left")
    have = links.select(F.col("id").alias("__i"), F.col("kind").alias("__lk"), F.col("dim_id").alias("__ld"), F.lit(True).alias("__have"))
    one = one.join(have, (F.col("id") == F.col("__i")) & (F.col("kind") == F.col("__lk")) & (F.col("__d") == F.col("__ld")), "left")
    return one.select("id", "kind", "name", F.col("__d").alias("dim_id"), "source", F.col("__d").isNull().alias("create_new"), F.col("__have").isNotNull().alias("already_linked"))


def backfill_titles(assets: DataFrame, representative: DataFrame) -> DataFrame:
    """Assets without title get one from their file's path, where it gives one."""
    f = representative.select(F.col("asset_id").alias("__a"), title_from_path(F.col("path")).alias("__t"))
    j = assets.join(f, F.col("id") == F.col("__a"), "left")
    fill = (F.coalesce("title", F.lit("")) == "") & F.col("__t").isNotNull()
    j = j.withColumn("title", F.when(fill, F.col("__t")).otherwise(F.col("title")))
    if "title_source" in assets.columns:
        j = j.withColumn("title_source", F.when(fill, "filename").otherwise(F.col("title_source")))
    return j.select(*assets.columns)


def embedded_people(artist: Column) -> Column:
    """Names in an artist field: parted by / ; , and &, trimmed, of two bytes or more."""
    return F.array_distinct(F.filter(F.transform(F.split(artist, "[/;,&]"), lambda x: F.trim(x)), lambda n: F.octet_length(n) >= 2))


def apply_embedded(catalog: Catalog, embedded: DataFrame) -> Catalog:
    """The catalog with embedded title and comment (asset_id, title, artist, comment) in the assets and the
    artists found or made as people and linked; blanks overwrite nothing."""
    from .identify import link_names

    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    e = embedded.select(F.col("asset_id").alias("__a"), blank("title").alias("__title"), blank("comment").alias("__details"))
    assets = catalog.assets
    j = assets.join(e, F.col("id") == F.col("__a"), "left")
    for c in ("title", "details"):
        if f"{c}_source" in assets.columns:
            j = j.withColumn(f"{c}_source", F.when(F.col(f"__{c}").isNotNull(), "embedded").otherwise(F.col(f"{c}_source")))
        j = j.withColumn(c, F.coalesce(f"__{c}", c))
    pairs = embedded.select("asset_id", F.explode(embedded_people(F.col("artist"))).alias("name"))
    return catalog.but(assets=j.select(*assets.columns), **link_names(catalog, pairs, "people", "asset_people", "person_id")[0])


def best_cover(images: Column) -> Column:
    """Url of the widest image (no width is 0) with one; of equal ones the last."""
    ranked = F.transform(images, lambda x, i: F.struct(F.coalesce(x["width"], F.lit(0)).alias("w"), i.alias("i"), x["url"].alias("url")))
    return F.array_max(F.filter(ranked, lambda r: F.coalesce(F.trim(r["url"]) != "", F.lit(False))))["url"]


def dictionary_of(studios: DataFrame, people: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, dim_id, name) of three dimensions."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("dim_id"), "name")
    return one(studios, "studio").unionByName(one(people, "person")).unionByName(one(tags, "tag"))
