"""Titles, codes, tags and names read out of file names and paths, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .like import ascii_lower

# Words of file names and what they are taken for.
TITLE_NOISE = "1080p 720p 540p 480p 360p 2160p 1440p 4320p 4k 8k uhd fhd hd sd hq lq hdr sdr h264 h265 x264 x265 hevc avc webrip webdl bluray bdrip dvdrip hdtv remux proper repack internal xxx adult porn mp4 mkv avi wmv mov m4v xvid aac ac3".split()
TAG_WORDS = "1080p 720p 2160p 1440p 4k 8k uhd hdr anal rim dp dap atm a2m gape creampie facial blowjob handjob pov hardcore softcore lesbian solo threesome foursome gangbang orgy bj hj 1on1 2on1 3on1 ffm mmf ff mm".split()
BUCKETS = "videos video movies movie clips clip media files film films scenes scene downloads download torrent torrents new misc other temp tmp incoming complete sorted unsorted library lib collection collections".split()
NOT_STUDIOS = "anal rim facial creampie dp pov hardcore softcore lesbian solo threesome 1on1 2on1 3on1 ffm mmf xxx hd sd 4k uhd 720p 1080p 2160p".split()
JUNK_TITLES = "video movie untitled scene file download new temp copy image screen recording sample trailer clip full part complete final output export".split()


_NOISE, _JUNK, _TAGS = frozenset(TITLE_NOISE), frozenset(JUNK_TITLES), frozenset(TAG_WORDS)
#: Texts that are held as Python strings at once.
TEXTS = 128


def _by_text(one: Callable[[str], object], kind: pa.DataType = pa.string()) -> Callable[[Column], Column]:
    """A column function of what ``one`` makes of each text, null of null. Texts can be long: going through their words
    in Python costs a small part of what pattern columns and lambdas over words do."""

    def of(texts: pa.Array) -> pa.Array:
        out = [pa.array([], kind)]
        for at in range(0, len(texts), TEXTS):
            out.append(pa.array([None if t is None else one(t) for t in texts.slice(at, TEXTS).to_pylist()], kind))
        return pa.concat_arrays(out)

    # The annotations are strings in this module, which arrow_udf can't read.
    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, from_arrow_type(kind))


_WORD, _INNERMOST = re.compile("[A-Za-z0-9]+"), re.compile(r"\[[^\[\]]*\]")
_BIT_RATE, _YEAR = re.compile("[0-9]{3,}k"), re.compile("19[7-9][0-9]|20[0-9][0-9]|2100|[0-9]{6}")
_JOINED, _LETTERS, _DIGITS = re.compile("[a-z]{2,8}[0-9]{2,6}"), re.compile("[a-z]{2,8}"), re.compile("[0-9]{2,6}")


def _lower(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _is_noise(word: str) -> bool:
    return word in _NOISE or word.endswith("k") and _BIT_RATE.fullmatch(word) is not None


def _outside(text: str) -> str:
    """The text outside square brackets, six nested ones at most; one that isn't closed goes to the end."""
    for _ in range(6):
        if "[" not in text:
            break
        text = _INNERMOST.sub("", text)
    return text.partition("[")[0].replace("]", "")


def _title(raw: str) -> str | None:
    return " ".join([w for w in _WORD.findall(_outside(raw)) if not _is_noise(w.lower()) and not (w.isdigit() and _YEAR.fullmatch(w))]) or None


def _code(raw: str) -> str | None:
    words = _lower(raw)
    numbered = [i for i, w in enumerate(words) if w[-1] <= "9"]
    for i in numbered:
        if _JOINED.fullmatch(words[i]):
            return words[i].upper()
    for i in numbered:
        if i and _DIGITS.fullmatch(words[i]) and _LETTERS.fullmatch(words[i - 1]):
            return f"{words[i - 1].upper()}-{words[i]}"
    return None


def _names(title: str) -> list[str]:
    return [w for w in title.split(" ") if len(w) >= 3 and w.isalpha()]


def _worth(title: str | None) -> str | None:
    """The title if it is specific: no junk word, and a code, two names, or one name of six letters with no more digits than letters."""
    if title is None or title.lower() in _JUNK:
        return None
    names = _names(title)
    one = len(names) == 1 and len(names[0]) >= 6 and sum(map(str.isalpha, title)) >= sum(map(str.isdigit, title))
    return title if len(names) >= 2 or one or _code(title) is not None else None


def _score(title: str | None, at: int) -> int:
    n = len(_names(title or ""))
    letters, digits = sum(map(str.isalpha, title or "")), any(map(str.isdigit, title or ""))
    return n * 10 + letters + (0 if digits else 80) + (40 if n == 2 else 0) + max(8 - at, 0) * 5 if n else 0


def _best(raw: str) -> str | None:
    """The title text of the best of several segments parted by ``' - '``; None if there are fewer than two."""
    parts = [p for p in (x.strip(" ") for x in raw.split(" - ")) if p]
    if len(parts) < 2:
        return None
    named = lambda p: not re.fullmatch(r"(?s)\[.*\]", p) and not re.search(r"\.com|\.net|\.xxx|^www", p.lower())
    scored = [(_score(t, i), -i, t) for i, p in enumerate(parts) if named(p) for t in [_title(p)]]
    best = max((s for s in scored if s[0] > 0), default=None)
    return best[2] if best else None


def _term(raw: str) -> str | None:
    text = raw.strip(" ")
    code, upper = _code(text), text.upper().replace(" ", "-")
    if code and (upper == code or upper.startswith(code + "-") or len(text.encode()) <= len(code) + 2):
        return code
    return _worth(_best(text)) or _worth(_title(text))


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used: it becomes a lambda's variable."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def tokenize_alnum(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_for_match(text: Column) -> Column:
    """ASCII lower case; all between letters and digits is one space."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def path_parts(path: Column) -> Column:
    """Trimmed parts of a path without its drive; either separator counts."""
    return F.filter(F.transform(F.split(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[\\/]"), lambda x: F.trim(x)), lambda p: p != "")


def stem(path: Column) -> Column:
    """The last part without what follows its last dot, unless that dot comes first."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    return F.trim(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"))


def folders(path: Column) -> Column:
    """Names of the folders above a file, from the root."""
    return path_parts(F.regexp_replace(path, r"[^\\/]*$", ""))


def path_haystack(path: Column) -> Column:
    """Folder names and stem, normalised, as one string of words."""
    return _all_words(F.array_join(F.concat(folders(path), F.array(stem(path))), "/"))


def brackets(text: Column) -> Column:
    """What stands in square brackets, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda x: F.trim(x)), lambda b: b != "")


title_text = _by_text(_title)
title_text.__doc__ = """The words outside brackets that are no encoding noise, bit rate or date, in their own case; null if none is left."""
product_code = _by_text(_code)
product_code.__doc__ = """The first token of 2-8 letters and 2-6 digits, upper case, else the first two such tokens with a dash; null if none."""
clean_title = _by_text(lambda raw: _worth(_title(raw)))
clean_title.__doc__ = """The title text if it is specific, else null."""
identify_term = _by_text(_term)
identify_term.__doc__ = """What to search a provider for: a leading product code, the best segment, or the title; null if all are weak."""
_real_tokens = _by_text(lambda raw: " ".join([w for w in _lower(raw) if not _is_noise(w)]))
_all_words = _by_text(lambda text: " ".join(_lower(text)))
_tag_tokens = _by_text(lambda name: [w for w in _lower(name) if w in _TAGS], pa.list_(pa.string()))


def _count(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]", ""))


def is_bucket(name: Column) -> Column:
    return normalize_for_match(name).isin(*BUCKETS)


def _entity(name: Column) -> Column:
    n = normalize_for_match(name)
    return ~n.isin(*BUCKETS, *JUNK_TITLES) & ~n.rlike("^[0-9]*$") & (_count(n, "a-z") >= 3)


def is_pure_id(raw: Column) -> Column:
    """Whether there are tokens that are no noise, and all of them are numbers."""
    return _real_tokens(raw).rlike("^[0-9 ]+$")


def naming_folder(path: Column) -> Column:
    """The nearest folder above a file that names something, else null."""
    return F.try_element_at(F.filter(folders(path), _entity), F.lit(-1))


def title_from_path(path: Column) -> Column:
    """A clean stem, else the nearest folder that names something with the stem behind it, else null."""
    name = stem(path)
    soft = _real_tokens(name)
    tail = F.when(soft.rlike("[a-z]"), soft).otherwise(name)
    return F.when(name != "", F.coalesce(clean_title(name), F.concat(naming_folder(path), F.lit(" - "), tail)))


def weak_reason(raw: Column) -> Column:
    """Why a title gives no search term: empty, id_only or vague."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(is_pure_id(raw), "id_only").otherwise("vague")


def _tag_token(text: Column) -> Column:
    return F.translate(F.lower(text), " _-", "")


def tag_candidates(name: Column) -> Column:
    """Tag words of a stem, then of its brackets, in order and once each."""
    own = _tag_tokens(F.lower(name))
    inside = F.flatten(F.transform(brackets(name), lambda b: F.transform(F.split(b, "[,/;]"), lambda p: _tag_token(F.trim(p)))))
    return F.array_distinct(F.concat(own, F.filter(inside, lambda t: t.isin(*TAG_WORDS, *NOT_STUDIOS))))


# Tags that are shown as they are written.
PLAIN_TAGS = ("1080p", "720p", "2160p", "1440p", "4k", "8k", "uhd", "hdr", "1on1", "2on1", "3on1")


def pretty_tag(tag: Column) -> Column:
    """First letter upper, but the words of ``PLAIN_TAGS`` stay as they are."""
    return F.when(tag.isin(*PLAIN_TAGS), tag).otherwise(F.concat(F.upper(F.substring(tag, 1, 1)), F.substr(tag, F.lit(2))))


def _first_of(items: Column, key) -> Column:
    """The items whose key no earlier one has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def folder_hints(path: Column) -> Column:
    """(kind, name) of the folders above a file that name a person (two words of letters) or a studio."""
    named = F.filter(folders(path), lambda f: _entity(f) & (F.octet_length(f) >= 3))

    def kind(name: Column) -> Column:
        words = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: F.char_length(w) >= 2)
        return F.when((F.size(words) == 2) & F.forall(words, lambda w: w.rlike("^[A-Za-z]+$")), "person").otherwise("studio")

    hints = F.transform(named, lambda f: F.struct(kind(f).alias("kind"), f.alias("name")))
    return _first_of(hints, lambda h: F.concat_ws("|", h["kind"], ascii_lower(h["name"])))


def bracket_studios(name: Column) -> Column:
    """Bracket texts, up to a dash, that may name a studio; without .com or .net, once each."""
    bases = F.transform(brackets(name), lambda b: F.trim(F.substring_index(b, "-", 1)))

    def may_be(base: Column) -> Column:
        key = _tag_token(base)
        return (key != "") & ~key.isin(*NOT_STUDIOS, *TAG_WORDS) & ~key.rlike("^[0-9]+$|^[0-9]*(x[0-9]*)+$") & (_count(key, "a-z") >= 3)

    shown = F.transform(F.filter(bases, may_be), lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(\.com)+$", ""), r"(\.net)+$", "")))
    return _first_of(F.filter(shown, lambda s: s != ""), ascii_lower)
