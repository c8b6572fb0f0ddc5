"""Entity resolution: assets against the records of metadata providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..cluster import checkpointed
from ..functions.names import identify_term, tokenize_alnum
from .files import representative_file

#: Order in which kinds of fingerprints are trusted.
HASH_RANK = {"oshash": 0, "md5": 1, "phash": 2}
#: Records of a text search, before repeated ids are dropped.
SEARCHED = 15
#: Seconds and ratio by which durations may differ.
SECONDS, RATIO = 45.0, 1.2
#: A name that more than 1 / HOT of all rows have is hot; at most HOT names are.
HOT = 1000
#: Words that are broadcast at most.
FEW_WORDS = 100_000


def match_by_fingerprint(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One remote_id per asset: by the most trusted kind of hash, then the least value and id.

    local: asset_id, hash_type, value; remote: remote_id, hash_type, value. A hash that many records
    share is brought down to one record before the join, so junk hashes multiply nothing.
    """
    key = [F.lower("hash_type").alias("hash_type"), F.lower("value").alias("value")]
    r = remote.select("remote_id", *key).groupBy("hash_type", "value").agg(F.min("remote_id").alias("remote_id"))
    rank = F.create_map(*[x for k, v in HASH_RANK.items() for x in (F.lit(k), F.lit(v))])
    both = local.select("asset_id", *key).distinct().join(r, ["hash_type", "value"])
    order = F.struct(F.coalesce(F.try_element_at(rank, F.col("hash_type")), F.lit(9)), F.col("value"), F.col("remote_id"))
    return both.groupBy("asset_id").agg(F.min_by(F.struct("remote_id", "hash_type", "value"), order).alias("m")).select("asset_id", "m.*")


def provider_waterfall(matches: DataFrame, providers: DataFrame) -> DataFrame:
    """Per asset the matches of the first provider that has any. matches: asset_id, provider_id, ...; providers: provider_id, rank, from 0 for the active one."""
    # Providers are a handful of presets.
    ranked = matches.join(F.broadcast(providers), "provider_id")
    first = ranked.groupBy("asset_id").agg(F.min("rank").alias("rank"))
    return ranked.join(first, ["asset_id", "rank"], "left_semi").drop("rank")


def search_terms(assets: DataFrame, representative: DataFrame) -> DataFrame:
    """(asset_id, term): what to search for, from the title, else from the file's name; assets without are left out."""
    from ..functions.names import stem

    file = representative.select(F.col("asset_id").alias("__a"), F.col("path").alias("__p"))
    own = assets.join(file, F.col("id") == F.col("__a"), "left").select(F.col("id").alias("asset_id"), identify_term(F.col("title")).alias("__t"), "__p")
    # Names are only gone through where the title gives nothing.
    named = identify_term(F.when(F.col("__t").isNull(), stem(F.col("__p"))))
    return own.select("asset_id", F.coalesce("__t", named).alias("term")).where("term is not null")


def title_search_fallback(terms: DataFrame, matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """(asset_id, remote_id, nth) for assets without a match: records of whose title or code all words of
    the term are part; the shortest titles first, 15 at most, then repeated ids dropped.

    terms: asset_id, term; candidates: remote_id, title, code. Each distinct term is looked up once, by the
    one of its words that the fewest records have; a term with a word that no record has finds nothing, and
    meets no record. Words that many terms share meet their numbers where the terms lie.
    """
    # Read for the words, their numbers and the results.
    open_ = checkpointed(terms.join(matched.select(F.col("asset_id").alias("__m")), F.col("asset_id") == F.col("__m"), "left_anti").select("asset_id", "term"))
    words = F.array_distinct(tokenize_alnum(F.col("term")))
    asked = open_.select("term").distinct().select("term", F.explode(words).alias("name"))
    texts = candidates.select("remote_id", F.coalesce("title", F.lit("")).alias("title"), F.array_distinct(tokenize_alnum(F.concat_ws(" ", "title", "code"))).alias("has"))
    counts = name_counts(asked)
    each = texts.select("remote_id", "title", "has", F.explode("has").alias("word"))
    known = checkpointed(each.groupBy(F.col("word").alias("name")).agg(F.count("*").alias("dim_id")))
    n = F.coalesce("dim_id", F.lit(0))
    rare = with_dim(asked, known, counts, "left").groupBy("term").agg(F.min_by("name", F.struct(n, F.col("name"))).alias("word"), F.min(n).alias("n"))
    rare = checkpointed(rare.where("n > 0").select("term", "word"))
    looked = rare.select("word").distinct()
    if looked.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        each = each.join(F.broadcast(looked), "word", "left_semi")
    hits = rare.select("term", words.alias("words"), "word").join(each, "word").where(F.size(F.array_except("words", "has")) == 0)
    order = Window.partitionBy("term").orderBy(F.char_length("title"), "remote_id")
    best = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SEARCHED).groupBy("term", "remote_id").agg(F.min("nth").alias("nth"))
    return open_.distinct().join(best, "term").select("asset_id", "remote_id", "nth")


def drop_rejected(matches: DataFrame, rejected: DataFrame) -> DataFrame:
    return matches.join(rejected.select("asset_id", "provider_id", "remote_id"), ["asset_id", "provider_id", "remote_id"], "left_anti")


def duration_plausible(local: Column, remote: Column) -> Column:
    """Whether two durations may belong together; an unknown one always may."""
    unknown = local.isNull() | remote.isNull() | (local <= 0) | (remote <= 0)
    ratio = F.greatest(local, remote) / F.least(local, remote)
    return unknown | (F.abs(local - remote) <= SECONDS) | F.when(~unknown, ratio <= RATIO)


def resolve_names(names: DataFrame, dim: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(name, dim_id) for each distinct name, and the rows to be added to the dimension.

    Names are trimmed, blanks dropped, case ignored. Ids of new rows follow from kind and name.
    """
    wanted = names.select(F.trim("name").alias("name")).where("name != ''").distinct()
    known = dim.groupBy(F.lower("name").alias("__k")).agg(F.min(F.col("id").cast("string")).alias("__id"))
    keyed = wanted.withColumn("__k", F.lower("name"))
    missing = keyed.join(known, "__k", "left_anti").groupBy("__k").agg(F.min("name").alias("name"))
    new = missing.withColumn("id", F.sha2(F.concat_ws("|", F.lit(kind), "__k"), 256))
    both = known.unionByName(new.select("__k", F.col("id").alias("__id")))
    return keyed.join(both, "__k").select("name", F.col("__id").alias("dim_id")), new.select("id", "name")


def name_counts(rows: DataFrame) -> DataFrame:
    """name, n (its rows), kept, as both the names that are resolved and the hot ones come from it."""
    return checkpointed(rows.groupBy("name").agg(F.count("*").alias("n")))


def with_dim(rows: DataFrame, named: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows (name, ...) with the dim_id of their name, from named (name, dim_id); names that aren't there fall away, or get null with ``left``.

    The few names that many rows share, be they there or not, meet their rows where these lie, so that no task gets
    all rows of one; rows without name meet nothing.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.where((F.col("n") * HOT > total) & F.col("name").isNotNull()).select("name")
    there = named.join(F.broadcast(many), "name").select("name", F.col("dim_id").alias("__hot"))
    hot = checkpointed(many.join(F.broadcast(there), "name", "left").select(F.col("name").alias("__name"), "__hot"))
    marked = rows.join(F.broadcast(hot), F.col("name") == F.col("__name"), "left")
    others = marked.where("__name is null and name is not null").select(*rows.columns).join(named, "name", how).select(*rows.columns, "dim_id")
    met = marked.where("__name is not null or name is null") if how == "left" else marked.where("__hot is not null")
    return met.select(*rows.columns, F.col("__hot").alias("dim_id")).unionByName(others)


def identify_stats(assets: DataFrame, files: DataFrame, now: Column, days: int, force: bool = False) -> DataFrame:
    """total, never_checked, checked_recently, pending and needs_review of all assets, in one pass."""
    flagged = assets.join(files.select(F.col("asset_id").alias("__a"), F.lit(True).alias("__has")).distinct(), F.col("id") == F.col("__a"), "left")
    has, never = F.col("__has").isNotNull(), F.col("checked_at").isNull()
    recent = F.lit(False) if force or days <= 0 else F.coalesce(F.col("checked_at") >= now - F.make_interval(days=F.lit(days)), F.lit(False))
    due = F.lit(True) if force else (never | (~recent if days > 0 else F.lit(False)))
    review = (F.col("match_count") > 1) & F.col("applied_at").isNull() & F.col("ignored_at").isNull()
    return flagged.agg(F.count_if(has).alias("total"), F.count_if(has & never).alias("never_checked"), F.count_if(has & recent).alias("checked_recently"), F.count_if(has & F.col("ignored_at").isNull() & due).alias("pending"), F.count_if(review).alias("needs_review"))


def due_assets(assets: DataFrame, now: Column, days: int, force: bool = False) -> DataFrame:
    """Assets that are to be identified, if they have a file."""
    due = F.lit(True) if force else F.col("checked_at").isNull()
    if days > 0 and not force:
        due |= F.col("checked_at") < now - F.make_interval(days=F.lit(days))
    return assets.where(F.col("ignored_at").isNull() & due)


def select_pending(assets: DataFrame, files: DataFrame, now: Column, days: int, force: bool = False) -> DataFrame:
    """Assets with a file that are to be identified, newest first."""
    held = due_assets(assets, now, days, force).join(files.select(F.col("asset_id").alias("__a")), F.col("id") == F.col("__a"), "left_semi")
    return held.orderBy(F.desc("created_at"), "id")


def identify_outcome(pending: DataFrame, raw: DataFrame, candidates: DataFrame, auto: bool) -> DataFrame:
    """Per asset n_raw, n_candidates and outcome: applied (one candidate, and auto), review (several;
    or any without auto; or, with auto, none left of several), else none."""
    n = lambda df, c: df.groupBy(F.col("asset_id").alias(f"__{c}")).agg(F.count("*").alias(c))
    j = pending.select(F.col("id").alias("asset_id")).join(n(raw, "n_raw"), F.col("asset_id") == F.col("__n_raw"), "left").join(n(candidates, "n_candidates"), F.col("asset_id") == F.col("__n_candidates"), "left")
    j = j.select("asset_id", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    one, many = F.col("n_candidates") == 1, F.col("n_candidates") > 1
    review = many | ((F.col("n_candidates") > 0) if not auto else (F.col("n_candidates") == 0) & (F.col("n_raw") > 1))
    return j.withColumn("outcome", F.when(one & F.lit(auto), "applied").when(review, "review").otherwise("none"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.agg(F.count("*").alias("assets"), F.count_if(F.col("n_raw") > 0).alias("matched"), n("applied"), n("review"))


def record_checks(assets: DataFrame, checked: DataFrame, raw: DataFrame, now: Column) -> DataFrame:
    """Assets with the time of the check and the number of matches before rejects. checked: asset_id."""
    n = raw.groupBy("asset_id").agg(F.count("*").alias("__n"))
    c = checked.select("asset_id").distinct().join(n, "asset_id", "left").select(F.col("asset_id").alias("__a"), F.coalesce("__n", F.lit(0)).alias("__n"))
    hit = F.col("__a").isNotNull()
    return assets.join(c, F.col("id") == F.col("__a"), "left").withColumn("checked_at", F.when(hit, now).otherwise(F.col("checked_at"))).withColumn("match_count", F.when(hit, F.col("__n")).otherwise(F.col("match_count")).cast("int")).select(*assets.columns)


def _updated(assets: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Assets with columns set where the id is in ids (asset_id and what the values need, prefixed)."""
    j = assets.join(ids.withColumnRenamed("asset_id", "__a"), F.col("id") == F.col("__a"), "left")
    hit = F.col("__a").isNotNull()
    set_ = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in assets.columns}
    return j.withColumns(set_).select(*assets.columns)


def set_ignored(assets: DataFrame, ids: DataFrame, now: Column, on: bool = True) -> DataFrame:
    """Ignored assets lose what they were matched with; taking it back clears the mark alone."""
    null = F.lit(None)
    values = {"match_count": F.lit(0), "ignored_at": F.coalesce("ignored_at", now), "applied_at": null, "remote_id": null, "checked_at": F.coalesce("checked_at", now)} if on else {"ignored_at": null}
    return _updated(assets, ids.select("asset_id").distinct(), values)


def reject_matches(rejected: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["asset_id", "provider_id", "remote_id"]
    return rejected.select(*keys).unionByName(new.select(*keys)).distinct()


def dismiss_review(catalog: Catalog, ids: DataFrame, listed: DataFrame, provider: str, now: Column) -> Catalog:
    """Assets that were looked at and get none of what was listed for them (asset_id, remote_id): ignored and
    checked now, without match, and the listed records of the provider rejected; blank ids are left out."""
    one = ids.select("asset_id").distinct()
    null = F.lit(None)
    out = _updated(catalog.assets, one, {"match_count": F.lit(0), "ignored_at": now, "applied_at": null, "remote_id": null, "checked_at": now})
    gone = listed.join(one, "asset_id", "left_semi").select("asset_id", F.lit(provider).alias("provider_id"), F.trim(F.col("remote_id").cast("string")).alias("remote_id")).where("remote_id != ''")
    return catalog.but(assets=out, rejected_matches=reject_matches(catalog.rejected_matches, gone))


def apply_matches(catalog: Catalog, chosen: DataFrame, now: Column, fields: tuple[str, ...] = ("title", "details", "studio", "people", "tags", "cover")) -> Catalog:
    """The chosen record of each asset written into it, field by field.

    chosen: asset_id, provider_id, remote_id, title, details, studio, people array, tags array, images array of
    (url, width). A blank title or details that is taken becomes null. Links are added, none is removed.
    """
    from .enrich import best_cover

    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    picked = chosen.select("asset_id", *[F.col(c).alias(f"__{c}") for c in ("provider_id", "remote_id", "title", "details", "studio")], best_cover(F.col("images")).alias("__cover"))
    values: dict[str, Column] = {"applied_at": now, "remote_id": F.col("__remote_id"), "ignored_at": F.lit(None)}
    for c in ("title", "details"):
        if c in fields:
            values |= {c: blank(F.col(f"__{c}")), f"{c}_source": F.col("__provider_id")}
    if "cover" in fields:
        values |= {"cover_path": F.coalesce("__cover", "cover_path"), "cover_source": F.when(F.col("__cover").isNotNull(), F.col("__provider_id")).otherwise(F.col("cover_source") if "cover_source" in catalog.assets.columns else F.lit(None))}
    out: dict[str, DataFrame] = {}
    if "studio" in fields:
        counts = name_counts(chosen.select(F.trim("studio").alias("name")))
        named, new = resolve_names(counts, catalog.studios, "studio")
        studios = catalog.studios.select(F.col("id").cast("string").alias("id"), "name").unionByName(new)
        out["studios"] = studios
        picked = with_dim(picked.withColumn("name", F.trim("__studio")), named, counts, "left").withColumnRenamed("dim_id", "__sid").drop("name")
        values["studio_id"] = F.coalesce("__sid", F.col("studio_id").cast("string"))
    for field, dim, link, key in (("people", "people", "asset_people", "person_id"), ("tags", "tags", "asset_tags", "tag_id")):
        if field in fields:
            out |= link_names(catalog, chosen.select("asset_id", F.explode(field).alias("name")), dim, link, key)[0]
    assets = catalog.assets.withColumn("studio_id", F.col("studio_id").cast("string")) if "studio" in fields else catalog.assets
    return catalog.but(assets=_updated(assets, picked, values), **out)


def clear_identify(catalog: Catalog, ids: DataFrame, providers: tuple[str, ...], provider: str, now: Column, clear_metadata: bool = True, strip_links: bool = False, ignore: bool = False) -> Catalog:
    """What providers gave is taken back: title from the path, details and cover empty and manual, studio
    always; with ``strip_links`` all links go. The record that was applied is rejected for ``provider``.

    ids: asset_id, and remote_id if another record than the applied one is to be rejected. providers: the sources that count as given.
    """
    from ..functions.names import title_from_path

    rep = representative_file(catalog.files).select(F.col("asset_id").alias("__r"), title_from_path(F.col("path")).alias("__title"))
    asked = F.max(F.trim(F.col("remote_id").cast("string"))) if "remote_id" in ids.columns else F.lit(None).cast("string")
    one = ids.groupBy("asset_id").agg(asked.alias("__asked"))
    picked = one.join(rep, F.col("asset_id") == F.col("__r"), "left").drop("__r")
    given = lambda c: F.coalesce(F.trim(f"{c}_source").isin(*providers), F.lit(False))
    null = F.lit(None)
    values = {"match_count": F.lit(0), "applied_at": null, "remote_id": null, "ignored_at": now if ignore else null}
    if clear_metadata:
        values |= {
            "title": F.when(given("title"), F.col("__title")).otherwise(F.col("title")),
            "title_source": F.when(given("title"), F.when(F.col("__title").isNotNull(), "filename").otherwise("manual")).otherwise(F.col("title_source")),
            "studio_id": null,
        }
        for value, c in (("details", "details"), ("cover_path", "cover")):
            if f"{c}_source" in catalog.assets.columns:
                values |= {value: F.when(~given(c), F.col(value)), f"{c}_source": F.when(given(c), "manual").otherwise(F.col(f"{c}_source"))}
    was = catalog.assets.join(one.select(F.col("asset_id").alias("__i"), "__asked"), F.col("id") == F.col("__i")).select(F.col("id").alias("asset_id"), F.lit(provider).alias("provider_id"), F.coalesce(F.when(F.col("__asked") != "", F.col("__asked")), F.col("remote_id").cast("string")).alias("remote_id"))
    tables = {"assets": _updated(catalog.assets, picked, values), "rejected_matches": reject_matches(catalog.rejected_matches, was.where("remote_id != ''"))}
    if strip_links:
        gone = ids.select(F.col("asset_id").alias("__i")).distinct()
        tables |= {t: getattr(catalog, t).join(gone, F.col("asset_id") == F.col("__i"), "left_anti") for t in ("asset_tags", "asset_people")}
    return catalog.but(**tables)


def link_names(catalog: Catalog, pairs: DataFrame, dim: str, link: str, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The dimension and link table with the names of ``pairs`` (asset_id, name) found or made and linked, and the links that are new."""
    from .collections import add_links

    trimmed = pairs.select("asset_id", F.trim("name").alias("name"))
    counts = name_counts(trimmed)
    named, new = resolve_names(counts, getattr(catalog, dim), dim)
    rows = getattr(catalog, dim).select(F.col("id").cast("string").alias("id"), "name").unionByName(new)
    wanted = with_dim(trimmed, named, counts).select("asset_id", F.col("dim_id").alias(key))
    links, fresh = add_links(getattr(catalog, link).select("asset_id", F.col(key).cast("string").alias(key)), wanted)
    return {dim: rows, link: links}, fresh


def import_metadata(catalog: Catalog, foreign: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog with foreign records written into it, and (asset_id, changed) for each asset that has one.

    foreign: asset_id, title, details, studio, people array, tags array; one row an asset. Blanks overwrite
    nothing; people and tags are added. Changed is an asset that got any title, details or studio, be it the same, or a new link.
    """
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    f = foreign.select("asset_id", *[blank(c).alias(f"__{c}") for c in ("title", "details", "studio")])
    named, new = resolve_names(f.select(F.col("__studio").alias("name")), catalog.studios, "studio")
    f = f.join(named.select(F.col("name").alias("__n"), F.col("dim_id").alias("__sid")), F.col("__studio") == F.col("__n"), "left").drop("__n")
    tables = {"studios": catalog.studios.select(F.col("id").cast("string").alias("id"), "name").unionByName(new)}
    touched = f.select("asset_id", F.coalesce("__title", "__details", "__studio").isNotNull().alias("changed"))
    for field, dim, link, key in (("people", "people", "asset_people", "person_id"), ("tags", "tags", "asset_tags", "tag_id")):
        made, fresh = link_names(catalog, foreign.select("asset_id", F.explode(field).alias("name")), dim, link, key)
        tables |= made
        touched = touched.unionByName(fresh.select("asset_id", F.lit(True).alias("changed")))
    values = {c: F.coalesce(f"__{c}", c) for c in ("title", "details")}
    values |= {f"{c}_source": F.when(F.col(f"__{c}").isNotNull(), "import").otherwise(F.col(f"{c}_source")) for c in ("title", "details") if f"{c}_source" in catalog.assets.columns}
    values["studio_id"] = F.coalesce("__sid", F.col("studio_id").cast("string"))
    assets = catalog.assets.withColumn("studio_id", F.col("studio_id").cast("string"))
    known = touched.join(catalog.assets.select("id"), F.col("asset_id") == F.col("id"), "left_semi")
    return catalog.but(assets=_updated(assets, f, values), **tables), known.groupBy("asset_id").agg(F.max("changed").alias("changed"))


def import_summary(outcome: DataFrame) -> DataFrame:
    """matched, updated and skipped assets of an import."""
    return outcome.agg(F.count("*").alias("matched"), F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("skipped"))
