"""Secret scans with multipart credential linking, in DataFrame functions alone.

Each kind's matches and the gaps between them come from two regular-expression
functions; the running sum of their lengths gives each match its place. Weak
candidates (bare 40-character strings, endpoints) are reported only where the parts
that complete a credential lie within their scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed

# What each kind looks like, and how long a match must be.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}(?![0-9])"""
#: Kinds in the order in which they are listed; the first three are the base.
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "bare": BARE, "endpoint": ENDPOINT}
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
#: Code points between the starts of parts of one credential at most.
SCOPE = 400


def _matches(kind: str) -> Column:
    """(gap before, length, kept) of each match, as array of structs; null where there is none."""
    found = F.col(f"__m_{kind}")
    kept = {"assign": lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= LEAST_ASSIGNED, "access": lambda m: F.char_length(m) >= LEAST_ACCESS}.get(kind, lambda m: F.lit(True))
    gaps = F.slice(F.split(F.col("__text"), KINDS[kind], -1), 1, F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), kept(m).alias("kept"))))


def _near(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The rows of ``parts`` that start within scope of a row of ``others`` of the same text: an
    interval join by buckets of the scope's length, each looked for with its two neighbours."""
    left = parts.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col("start") / scope) + k for k in (-1, 0, 1)])))
    right = others.select(F.col("__uid").alias("__u"), F.floor(F.col("start") / scope).alias("__b"), F.col("start").alias("__s")).distinct()
    # Matches of one kind don't overlap, so a bucket holds a few of them at most, whatever the text.
    hit = (F.col("__uid") == F.col("__u")) & (F.col("__bucket") == F.col("__b")) & (F.abs(F.col("start") - F.col("__s")) <= scope)
    return left.join(right, hit, "left_semi").drop("__bucket").distinct()


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, __uid (its row), spans (array of start, kind number, end, kind; in
    that order; code points, end exclusive) with base spans and linked weak ones.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no spans; rows that
    repeat are each scanned; an empty table gives an empty result. The places of a text's matches
    are summed by a window over that text alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__uid"))
    found = texts.select("*", *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"__m_{k}") for k, p in KINDS.items()])
    # Kept, as the row numbers must stay; texts are left behind here.
    scanned = checkpointed(found.select("doc_id", "__uid", *[_matches(k).alias(k) for k in KINDS]))
    some = scanned.where(F.coalesce(*[F.size(k) for k in KINDS]).isNotNull())
    each = None
    for number, kind in enumerate(KINDS):
        rows = some.where(F.size(kind) > 0).select("doc_id", "__uid", F.lit(number).alias("no"), F.posexplode(kind).alias("nth", "m"))
        each = rows if each is None else each.unionByName(rows)
    upto = Window.partitionBy("__uid", "no").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.len")).where("m.kept").select("doc_id", "__uid", "no", "start", "end")
    placed = checkpointed(placed)
    no = {k: i for i, k in enumerate(KINDS)}
    access = placed.where(F.col("no") == no["access"])
    # A bare string is a secret beside an access identifier; an endpoint counts beside both.
    bare = _near(placed.where(F.col("no") == no["bare"]), access, scope)
    secrets = bare.unionByName(placed.where(F.col("no") == no["assign"]))
    endpoint = _near(_near(placed.where(F.col("no") == no["endpoint"]), access, scope), secrets, scope)
    spans = placed.where(F.col("no") <= no["hex"]).unionByName(bare).unionByName(endpoint)
    names = F.array(*[F.lit(k) for k in KINDS])
    per_text = spans.groupBy("__uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "no", "end", F.element_at(names, F.col("no") + 1).alias("kind")))).alias("spans"))
    none = scanned.join(per_text.select("__uid"), "__uid", "left_anti")
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    typed = F.transform("spans", lambda s: F.struct(s["start"].cast("long").alias("start"), s["no"].cast("int").alias("no"), s["end"].cast("long").alias("end"), s["kind"].alias("kind")))
    return per_text.select("doc_id", "__uid", typed.alias("spans")).unionByName(none.select("doc_id", "__uid", empty.alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["no"] <= 2)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
