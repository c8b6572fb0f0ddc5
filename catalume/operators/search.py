"""Faceted and free-text search over assets, composed as one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..cluster import checkpointed
from ..functions.like import ascii_lower, like_term
from ..functions.tokens import fts_tokens, phrase_match, tokens_of
from .files import representative_order
from .textindex import TextIndex, indexed_hits

#: Rows of a page at most.
PAGE = 10_000
GRID_FILE = ["path", "duration", "width", "height", "thumb_path"]


@dataclass(frozen=True)
class SearchArgs:
    """Filters that are combined; the defaults filter nothing."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    inverse: bool = False
    stemmed: bool = True
    min_favorite: int | None = None
    favorites_only: bool = False
    unplayed_only: bool = False
    identified_only: bool = False
    needs_review_only: bool = False
    ignored: bool | None = None
    min_duration: float = 0
    max_duration: float = 0
    min_height: int = 0
    folders: tuple[str, ...] = ()
    studios: tuple = ()
    not_studios: tuple = ()
    tags_all: tuple = ()
    tags_any: tuple = ()
    tags_none: tuple = ()
    people_all: tuple = ()
    people_none: tuple = ()
    min_tags: int = 0
    min_people: int = 0
    sort: str = "created"
    limit: int | None = None
    offset: int = 0
    #: ``page_key`` of the last row of the page before, instead of an offset.
    after: tuple | None = None


def min_favorite(n: int) -> Column:
    return F.col("favorite") >= max(0, min(5, n))


def favorites_only() -> Column:
    return F.col("favorite") > 0


def unplayed_only() -> Column:
    return F.col("play_count") == 0


def identified_only() -> Column:
    return F.col("applied_at").isNotNull()


def needs_review_only() -> Column:
    return (F.col("match_count") > 1) & F.col("applied_at").isNull() & F.col("ignored_at").isNull()


def ignored(state: bool | None) -> Column:
    return F.lit(True) if state is None else F.col("ignored_at").isNotNull() if state else F.col("ignored_at").isNull()


def duration_between(least: float, most: float) -> Column:
    """Bounds that aren't positive are off; with one on, a null duration fails."""
    out = F.lit(True)
    if least > 0:
        out &= F.coalesce(F.col("duration") >= least, F.lit(False))
    if most > 0:
        out &= F.coalesce(F.col("duration") <= most, F.lit(False))
    return out


def min_height(n: int) -> Column:
    return F.coalesce(F.col("height") >= n, F.lit(False)) if n > 0 else F.lit(True)


def studio_in(ids: tuple) -> Column:
    return F.coalesce(F.col("studio_id").isin(*ids), F.lit(False)) if ids else F.lit(True)


def studio_not_in(ids: tuple) -> Column:
    return F.col("studio_id").isNull() | ~F.col("studio_id").isin(*ids) if ids else F.lit(True)


def under_folders(files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """asset_id of assets with any file under any of the folders, which are taken literally and fold ASCII case."""
    hit = F.lit(False)
    for folder in folders:
        at = folder if folder.endswith(("\\", "/")) else folder + ("/" if "/" in folder and "\\" not in folder else "\\")
        hit |= ascii_lower(F.col("path")).startswith(ascii_lower(F.lit(at)))
    return files.where(hit).select("asset_id").distinct()


def links_all(links: DataFrame, key: str, ids: tuple) -> DataFrame:
    """asset_id of assets that have every one of the ids."""
    return links.where(F.col(key).isin(*ids)).groupBy("asset_id").agg(F.count_distinct(key).alias("n")).where(F.col("n") == len(set(ids))).select("asset_id")


def links_any(links: DataFrame, key: str, ids: tuple) -> DataFrame:
    return links.where(F.col(key).isin(*ids)).select("asset_id").distinct()


def min_links(links: DataFrame, n: int) -> DataFrame:
    return links.groupBy("asset_id").count().where(F.col("count") >= n).select("asset_id")


def parse_search_query(text: Column) -> Column:
    """Struct of include and exclude terms: white space parts them, a dash before a term excludes it, a lone dash is a term."""
    terms = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    out = lambda t: t.startswith("-") & (F.char_length(t) > 1)
    return F.struct(F.filter(terms, lambda t: ~out(t)).alias("include"), F.transform(F.filter(terms, out), lambda t: F.substr(t, F.lit(2))).alias("exclude"))


def _terms(args: SearchArgs) -> tuple[list[str], list[str]]:
    split = lambda terms: list(dict.fromkeys(w for t in terms for w in t.split()))
    include, exclude = split(args.include), split(args.exclude)
    return ([], include + exclude) if args.inverse else (include, exclude)


def _linked_hits(catalog: Catalog, terms: list[str]) -> DataFrame | None:
    """(asset_id, term) where the path, a tag, a person or a segment contains the term; each table is scanned once for all terms."""
    number = lambda c: F.filter(F.array(*[F.when(like_term(c, t), F.lit(i)) for i, t in enumerate(terms)]), lambda x: x.isNotNull())
    parts = []
    if catalog.files is not None:
        parts.append(catalog.files.select("asset_id", F.explode(number(F.col("path"))).alias("term")))
    for dim, links, key in ((catalog.tags, catalog.asset_tags, "tag_id"), (catalog.people, catalog.asset_people, "person_id")):
        if dim is not None and links is not None:
            named = dim.select(F.col("id").alias(key), F.explode(number(F.col("name"))).alias("term"))
            parts.append(links.select("asset_id", key).join(named, key).select("asset_id", "term"))
    if catalog.segments is not None:
        parts.append(catalog.segments.select("asset_id", F.explode(number(F.col("label"))).alias("term")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _phrase_hits(catalog: Catalog, terms: list[str], stemmed: bool) -> DataFrame:
    """(asset_id, term) where the term is a phrase of tokens in title or details, by reading all of both."""
    text = catalog.assets.select(F.col("id").alias("asset_id"), fts_tokens(F.coalesce("title", F.lit("")), stemmed).alias("t"), fts_tokens(F.coalesce("details", F.lit("")), stemmed).alias("d"))
    phrases = [tokens_of(t, stemmed) for t in terms]
    found = F.filter(F.array(*[F.when(phrase_match(F.col("t"), p) | phrase_match(F.col("d"), p), F.lit(i)) for i, p in enumerate(phrases)]), lambda x: x.isNotNull())
    return text.select("asset_id", F.explode(found).alias("term"))


def include_terms(catalog: Catalog, terms: list[str], stemmed: bool = True, index: TextIndex | None = None) -> DataFrame:
    """asset_id of assets that every term matches: as a phrase of tokens in title or details, or as a part of what is linked.

    With an index, texts are not read, and ``stemmed`` is as the index was built.
    """
    hits = _phrase_hits(catalog, terms, stemmed) if index is None else indexed_hits(index, terms)
    linked = _linked_hits(catalog, terms)
    if index is not None:
        hits = hits.withColumn("asset_id", F.col("asset_id").cast(catalog.assets.schema["id"].dataType))
    hits = hits if linked is None else hits.unionByName(linked)
    return hits.groupBy("asset_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("asset_id")


def exclude_terms(catalog: Catalog, terms: list[str]) -> DataFrame:
    """asset_id of assets that any term is a part of: title, details or what is linked."""
    hit = F.lit(False)
    for t in terms:
        hit |= like_term(F.col("title"), t) | like_term(F.col("details"), t)
    out = catalog.assets.where(hit).select(F.col("id").alias("asset_id"))
    linked = _linked_hits(catalog, terms)
    return (out if linked is None else out.unionByName(linked.select("asset_id"))).distinct()


#: Per order its keys, and whether each goes down, with nulls last; else up, with nulls first.
KEYS = {
    "created": lambda: [(F.col("created_at"), True)],
    "favorite": lambda: [(F.col("favorite"), True), (F.col("created_at"), True)],
    "play_count": lambda: [(F.col("play_count"), True), (F.col("created_at"), True)],
    "title": lambda: [(F.coalesce(F.lower("title"), F.lit("zzz")), False)],
}
SORTS = {name: lambda keys=keys: [k.desc() if down else k.asc() for k, down in keys()] for name, keys in KEYS.items()}


def filter_assets(catalog: Catalog, args: SearchArgs, index: TextIndex | None = None) -> DataFrame:
    """The assets with a file that pass all filters, with the columns of the grid.

    Filters on assets alone come before any join; links filter by semi and anti joins on asset_id.
    """
    a = catalog.assets.where(ignored(args.ignored) & studio_in(args.studios) & studio_not_in(args.not_studios))
    for on, condition in ((args.min_favorite is not None, lambda: min_favorite(args.min_favorite)), (args.favorites_only, favorites_only), (args.unplayed_only, unplayed_only), (args.identified_only, identified_only), (args.needs_review_only, needs_review_only)):
        if on:
            a = a.where(condition())
    keep, drop = [], []
    include, exclude = _terms(args)
    if include:
        keep.append(include_terms(catalog, include, args.stemmed, index))
    if exclude:
        drop.append(exclude_terms(catalog, exclude))
    if args.folders:
        keep.append(under_folders(catalog.files, args.folders))
    for links, key, every, some, none, least in ((catalog.asset_tags, "tag_id", args.tags_all, args.tags_any, args.tags_none, args.min_tags), (catalog.asset_people, "person_id", args.people_all, (), args.people_none, args.min_people)):
        if every:
            keep.append(links_all(links, key, every))
        if some:
            keep.append(links_any(links, key, some))
        if none:
            drop.append(links_any(links, key, none))
        if least > 0:
            keep.append(min_links(links, least))
    for ids in keep:
        a = a.join(ids, a["id"] == ids["asset_id"], "left_semi")
    for ids in drop:
        a = a.join(ids, a["id"] == ids["asset_id"], "left_anti")
    # Files join what is left, so that the filters are planned once; their aggregation keeps the join's partitions.
    shown = [c for c in GRID_FILE if c in catalog.files.columns]
    f = catalog.files.select(F.col("asset_id").alias("__asset"), F.struct(*shown).alias("__file"), representative_order(F.col("duration"), F.col("scanned_at"), F.col("id")).alias("__order"))
    each = a.join(f, a["id"] == f["__asset"]).groupBy("__asset").agg(F.first(F.struct(*[a[c] for c in a.columns])).alias("__a"), F.min_by("__file", "__order").alias("__f"))
    return each.select("__a.*", "__f.*").where(duration_between(args.min_duration, args.max_duration) & min_height(args.min_height))


def page(rows: DataFrame, sort: str = "created", limit: int | None = None, offset: int = 0, tie: str = "id") -> DataFrame:
    """One page, as top-k of each partition; ties go by id."""
    limit = max(1, min(PAGE, PAGE if limit is None else limit))
    return rows.orderBy(*SORTS[sort](), tie).offset(max(0, offset)).limit(limit)


def with_total(rows: DataFrame, page_rows: DataFrame) -> DataFrame:
    """The page with the number of all rows beside each; a window over all rows would move them to one task."""
    return page_rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def _later(keys: list[tuple[Column, bool]], after: tuple) -> Column:
    """Whether a row comes after the one with these keys."""
    later, equal = F.lit(False), F.lit(True)
    for (key, down), value in zip(keys, after, strict=True):
        if down:
            beyond = key.isNull() | (key < F.lit(value)) if value is not None else F.lit(False)
        else:
            beyond = key > F.lit(value) if value is not None else key.isNotNull()
        later |= equal & F.coalesce(beyond, F.lit(False))
        equal &= key.eqNullSafe(F.lit(value))
    return later


def _firsts(orders: list[str], most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of a partition that are on the page or before it, and on one of them the count of all."""
    n, best = 0, None
    for b in batches:
        n += b.num_rows
        rows = pa.Table.from_batches([b])
        if best is None:
            best = rows.slice(0, 1)  # carries the count if no row is asked for
            held = rows.filter(pc.field("__after"))
        else:
            held = pa.concat_tables([held, rows.filter(pc.field("__after"))])
        if held.num_rows > most:
            by = pc.sort_indices(held, sort_keys=[(f"__k{k}", o) for k, o in enumerate(orders)], null_placement="at_end")
            held = held.take(by[:most])
    if best is not None:
        out = held if held.num_rows else best
        counts = [n] + [0] * (out.num_rows - 1)
        yield from out.drop_columns(["__n"]).append_column("__n", pa.array(counts, pa.int64())).combine_chunks().to_batches()


def page_with_total(rows: DataFrame, sort: str = "created", limit: int | None = None, offset: int = 0, after: tuple | None = None, tie: str = "id") -> DataFrame:
    """One page of rows, each with the number of all rows, in one pass over them: each partition keeps its first rows and
    counts the others.

    ``after`` are the sort keys and id of the last row of the page before (``page_key``); with it the thousandth page costs
    what the first does, while an offset is paid for by every partition. Ties go by id, which no row lacks.
    """
    limit = max(1, min(PAGE, PAGE if limit is None else limit))
    keys = [*KEYS[sort](), (F.col(tie), False)]
    most = limit + max(0, offset)
    asked = rows.withColumns({f"__k{k}": key for k, (key, _) in enumerate(keys)} | {"__after": _later(keys, after) if after is not None else F.lit(True), "__n": F.lit(0).cast("long")})
    firsts = checkpointed(asked.mapInArrow(partial(_firsts, ["descending" if down else "ascending" for _, down in keys], most), asked.schema))
    total = firsts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"))
    ordered = firsts.where("__after").orderBy(*[F.col(f"__k{k}").desc() if down else F.col(f"__k{k}").asc() for k, (_, down) in enumerate(keys)])
    return ordered.offset(max(0, offset)).limit(limit).select(*rows.columns).crossJoin(F.broadcast(total))


def page_key(row: Row, sort: str = "created", tie: str = "id") -> tuple:
    """The key of a page's last row, from which the next page goes on."""
    if sort == "title":
        return ("zzz" if row["title"] is None else row["title"].lower(), row[tie])
    return (*[row[c] for c in {"created": ["created_at"], "favorite": ["favorite", "created_at"], "play_count": ["play_count", "created_at"]}[sort]], row[tie])


def search_assets(catalog: Catalog, args: SearchArgs, index: TextIndex | None = None) -> DataFrame:
    """A page of assets that pass all filters, in order, each with the true total (also past the last page, where there is no row)."""
    return page_with_total(filter_assets(catalog, args, index), args.sort, args.limit, args.offset, args.after)


def asset_detail(catalog: Catalog) -> DataFrame:
    """Each asset with its files (last scanned first), people and tags (by name) and studio; each side is gathered before it is joined."""
    people = catalog.asset_people.join(catalog.people.select(F.col("id").alias("person_id"), "name"), "person_id").groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("name", F.col("person_id").alias("id")))).alias("people"))
    tags = catalog.asset_tags.join(catalog.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("name", F.col("tag_id").alias("id")))).alias("tags"))
    files = catalog.files.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("scanned_at", F.col("id"), "path")), asc=False).alias("files"))
    out = catalog.assets
    for side in (files, people, tags):
        side = side.withColumnRenamed("asset_id", "__asset")
        out = out.join(side, out["id"] == side["__asset"], "left").drop("__asset")
    studio = catalog.studios.select(F.col("id").alias("__studio"), F.col("name").alias("studio_name"))
    return out.join(studio, F.col("studio_id") == F.col("__studio"), "left").drop("__studio")


def asset_counts(catalog: Catalog) -> DataFrame:
    """Assets with a file, and the favourites among them."""
    return catalog.assets.join(catalog.files.select(F.col("asset_id").alias("__a")), F.col("id") == F.col("__a"), "left_semi").agg(F.count("*").alias("total"), F.count_if(F.col("favorite") > 0).alias("favorites"))


def folder_facet(files: DataFrame) -> DataFrame:
    """Parent folder of each file with its last segment and the number of files, by name and path."""
    parent = F.regexp_extract("path", r"^(.*)[\\/][^\\/]*$", 1)
    counts = files.select(parent.alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))
    return counts.withColumn("name", F.regexp_extract("folder", r"([^\\/]*)$", 1)).orderBy(F.lower("name"), "folder")


def tag_counts(tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """Assets of each tag, those without included; most first."""
    n = asset_tags.groupBy("tag_id").agg(F.count("*").alias("n_assets"))
    return tags.join(n, tags["id"] == n["tag_id"], "left").select("id", "name", F.coalesce("n_assets", F.lit(0)).alias("n_assets")).orderBy(F.desc("n_assets"), "name")


def list_dimension(dim: DataFrame, by: str = "name", down: bool = False) -> DataFrame:
    return dim.orderBy(F.desc(by) if down else F.asc(by), "id")


def shuffle_meta(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """favorite and last_played_at of the assets in ``ids`` (asset_id)."""
    return catalog.assets.join(ids, F.col("id") == ids["asset_id"], "left_semi").select("id", "favorite", "last_played_at")
