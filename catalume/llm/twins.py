"""SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import decontaminate, neardup, quality, secrets

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _windows(words: str, n: int | str) -> str:
    """All windows of n words as strings, in the order of their places."""
    return f"list_transform(range(0, greatest(len({words}) - {n} + 1, 0)), lambda i: array_to_string({words}[i + 1:i + {n}], ' '))"


def _distance(n: str, m: str, p: str, q: str) -> str:
    """Sum over histogram entries whose counts are p of n and q of m."""
    part = "case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end"
    a, b = f"({p} / {n})", f"({q} / {m})"
    return f"sum({part.format(p=a, q=b)} + {part.format(p=b, q=a)})"


def _divergence() -> str:
    # One row for each language and common word; the entry after the last is all other words.
    common = ", ".join(f"('{lang}', '{w}')" for lang, words in quality.COMMON_WORDS.items() for w in words.split())
    count = lambda pattern: f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"
    classes = [count("[a-z]"), count("[A-Z]"), count("[0-9]"), count("[\\x20\\x09-\\x0D]"), count("[.,]"), count("[#*$%&|<>]"), count("[^a-zA-Z0-9\\x20\\x09-\\x0D.,#*$%&|<>\\x{80}-\\x{10FFFF}]"), f"strlen(coalesce(text, '')) - {count('[\\x00-\\x7F]')}"]
    return (
        f"with common(lang, word) as (values {common}), "
        f"w as (select doc_id, lang, coalesce(text, '') as text, {_WORDS} as ws, {_ALNUM} as low, [{', '.join(classes)}] as classes from documents), "
        f"win as (select doc_id, unnest({_windows('ws', quality.WINDOW)}) as win, unnest(range(0, greatest(len(ws) - {quality.WINDOW} + 1, 0))) as spot from w), "
        f"twice as (select doc_id, unnest(range(spot, spot + {quality.WINDOW})) as pos from (select *, count(*) over (partition by doc_id, win) as n from win) where n > 1), "
        "again as (select doc_id, count(distinct pos) as n_repeat_words from twice group by doc_id), "
        "lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id), "
        "base as (select doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, classes[6] as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ws) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) as base_failed, classes, len(low) as n_low from w left join again using (doc_id) left join lines using (doc_id)), "
        f"good as (select * from base where not base_failed and n_words >= {quality.LEAST_WORDS} and lang in (select lang from common)), "
        "cls as (select doc_id, lang, unnest(range(8)) as k, unnest(classes)::double as n from base), "
        "cls_of as (select lang, k, sum(n) as m from cls where doc_id in (select doc_id from good) group by lang, k), "
        "cls_all as (select *, sum(n) over (partition by doc_id) as ns, sum(m) over (partition by doc_id) as ms from cls join cls_of using (lang, k)), "
        f"js_c as (select doc_id, sqrt(greatest({_distance('ns', 'ms', 'n', 'm')} / 2, 0)) as js from cls_all where ns > 0 and ms > 0 group by doc_id), "
        "hits as (select doc_id, w.lang, word, count(*)::double as n from (select doc_id, lang, unnest(low) as word from w) w join common using (lang, word) group by all), "
        "others as (select doc_id, lang, '' as word, (n_low - coalesce((select sum(n) from hits h where h.doc_id = b.doc_id), 0))::double as n from base b where lang in (select lang from common)), "
        "wrd as (select b.doc_id, b.lang, c.word, coalesce(h.n, 0) as n from base b join common c using (lang) left join hits h on h.doc_id = b.doc_id and h.word = c.word union all select * from others), "
        "wrd_of as (select lang, word, sum(n) as m from wrd where doc_id in (select doc_id from good) group by lang, word), "
        "wrd_all as (select *, sum(n) over (partition by doc_id) as ns, sum(m) over (partition by doc_id) as ms from wrd join wrd_of using (lang, word)), "
        f"js_w as (select doc_id, sqrt(greatest({_distance('ns', 'ms', 'n', 'm')} / 2, 0)) as js from wrd_all where ns > 0 and ms > 0 group by doc_id), "
        f"judged as (select base.*, case when n_words >= {quality.LEAST_WORDS} then js_c.js end as jc, case when n_words >= {quality.LEAST_COMMON} then js_w.js end as jw from base left join js_c using (doc_id) left join js_w using (doc_id)) "
        f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(jc, 0) <= {quality.MOST_CLASSES} and coalesce(jw, 0) <= {quality.MOST_WORDS} as kept, round(jc, 9) as js_classes, round(jw, 9) as js_words from judged"
    )


_JACCARD = (
    "with recursive t as (select text, min(doc_id) as rep, count(*) as copies from documents where text is not null group by text), "
    f"w as (select rep, {_WORDS} as ws from t), "
    f"s as (select distinct rep, unnest(case when len(ws) between 1 and {neardup.SHINGLE - 1} then [array_to_string(ws, ' ')] else {_windows('ws', neardup.SHINGLE)} end) as shingle, least(len(ws), {neardup.SHINGLE}) as n from w), "
    "sized as (select rep, count(*) as n from s group by rep), "
    "common_n as (select a.rep as a, b.rep as b, count(*) as common_n from s a join s b on a.shingle = b.shingle and a.n = b.n and a.rep < b.rep group by all), "
    f"links as (select a, b from common_n join sized x on x.rep = a join sized y on y.rep = b where common_n >= {neardup.SIMILARITY} * (x.n + y.n - common_n) - 1e-9), "
    "either as (select a, b from links union all select b, a from links), "
    "reach as (select rep, rep as other from t union select reach.rep, either.b from reach join either on either.a = reach.other), "
    "class as (select rep, min(other) as class_id from reach group by rep), "
    "linked as (select a as rep, sum(copies)::bigint as links from either join t on t.rep = b group by a) "
    "select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(links, 0) + coalesce(copies, 1) - 1 as n_links, coalesce(copies, 1) - 1 as n_copies "
    "from documents d left join t using (text) left join class using (rep) left join linked using (rep)"
)

_N = decontaminate.WINDOW
_DECONTAMINATE = (
    f"with d as (select doc_id, {_ALNUM} as ws from documents), i as (select item_id, {_ALNUM} as ws from benchmark), "
    f"placed as (select item_id, least(len(ws), {_N}) as n, unnest(case when len(ws) >= {_N} then {_windows('ws', _N)} when len(ws) > 0 then [array_to_string(ws, ' ')] end) as win, unnest(range(0, greatest(len(ws) - {_N} + 1, 1))) as place from i where len(ws) > 0), "
    "asked as (select distinct item_id, n, win from placed), "
    "sizes as (select distinct n from asked), "
    f"have as (select doc_id, n, unnest({_windows('ws', 'n')}) as win, unnest(range(0, greatest(len(ws) - n + 1, 0))) as spot from d, sizes), "
    "hit as (select doc_id, item_id, n, spot from have join asked using (n, win)), "
    "words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(spot, spot + n)) as pos from (select distinct doc_id, n, spot from hit)) group by doc_id), "
    "items as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hit group by doc_id), "
    # Windows that follow each other in text and item alike are one match.
    "along as (select doc_id, item_id, n, spot, spot - place as apart from have join placed using (n, win)), "
    "matches as (select doc_id, item_id, min(spot) as start, count(*) - 1 + n as long from (select *, spot - row_number() over (partition by doc_id, item_id, n, apart order by spot) as run from along) group by doc_id, item_id, n, apart, run), "
    "best as (select doc_id, long as longest, start as longest_at, item_id::varchar as longest_item from (select *, row_number() over (partition by doc_id order by long desc, start, item_id::varchar nulls last) as nth from matches) where nth = 1) "
    "select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0) as longest, longest_at, longest_item "
    "from d left join words using (doc_id) left join items using (doc_id) left join best using (doc_id)"
)

#: Bytes as hexadecimal digits, two for each; a string of 100 bytes is 200 digits.
_REPEATS = (
    "with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents), "
    "s as (select doc_id, spot, md5_number(substring(x, 2 * spot + 1, 200)) as key from (select doc_id, x, unnest(range(0, greatest(n - 99, 0))) as spot from h)), "
    "late as (select doc_id, spot from (select *, row_number() over (partition by key order by doc_id, spot) as nth from s) where nth > 1), "
    "runs as (select doc_id, spot, sum(fresh) over (partition by doc_id order by spot) as run from (select *, case when spot <= lag(spot) over (partition by doc_id order by spot) + 100 then 0 else 1 end as fresh from late)), "
    "spans as (select doc_id, run, min(spot) as a, max(spot) + 100 as b from runs group by doc_id, run), "
    "pieces as (select doc_id, a as upto, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from spans union all select h.doc_id, n, coalesce((select max(b) from spans where spans.doc_id = h.doc_id), 0) from h), "
    "kept as (select doc_id, string_agg(substring(x, 2 * since + 1, 2 * (upto - since)), '' order by since) as x from pieces join h using (doc_id) group by doc_id), "
    "gone as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id) "
    "select h.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept.x)) as kept_sha256 from h join kept using (doc_id) left join gone using (doc_id)"
)


def _secrets() -> str:
    # Patterns without a look around the match: longer runs are matched, then held against the pattern.
    ask = {
        "assign": (secrets.ASSIGN, f"length(regexp_extract(m, $x${secrets.ASSIGN}$x$, 1)) >= {secrets.LEAST_ASSIGNED}"),
        "access": (secrets.ACCESS, f"length(m) >= {secrets.LEAST_ACCESS}"),
        "hex": (secrets.HEX, "true"),
        "bare": ("[A-Za-z0-9+/=]+", "regexp_full_match(m, '[A-Za-z0-9+/]{40}')"),
        "endpoint": ("""https?://[^\\s\\x0B"'<>]+|[0-9.]+:[0-9]+""", """regexp_full_match(m, $x$https?://[^\\s\\x0B"'<>]+|(?:[0-9]{1,3}\\.){3}[0-9]{1,3}:[0-9]{2,5}$x$)"""),
    }
    found = " union all ".join(f"select doc_id, {no} as no, '{kind}' as kind, spot, m, gap, {keep} as ok from (select doc_id, unnest(range(len(ms))) as spot, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap from (select doc_id, regexp_extract_all(text, $x${p}$x$) as ms, regexp_split_to_array(text, $x${p}$x$) as gaps from t))" for no, (kind, (p, keep)) in enumerate(ask.items()))
    near = f"abs(x.a - y.a) <= {secrets.SCOPE}"
    return (
        f"with t as (select doc_id, coalesce(text, '') as text from documents), f as ({found}), "
        "p as (select * from (select *, sum(length(gap) + length(m)) over (partition by doc_id, no order by spot) as b, b - length(m) as a from f) where ok), "
        f"bare as (select * from p x where kind = 'bare' and exists (select 1 from p y where y.doc_id = x.doc_id and y.kind = 'access' and {near})), "
        "parts as (select * from bare union all select * from p where kind = 'assign'), "
        f"ends as (select * from p x where kind = 'endpoint' and exists (select 1 from p y where y.doc_id = x.doc_id and y.kind = 'access' and {near}) and exists (select 1 from parts y where y.doc_id = x.doc_id and {near})), "
        "spans as (select * from p where no <= 2 union all select * from bare union all select * from ends), "
        "texts as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, "
        "string_agg(kind || ':' || a || ':' || b, ',' order by a, no) filter (no <= 2) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, no) as spans from spans group by doc_id) "
        "select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join texts using (doc_id)"
    )


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    # 4294967295 and 3988292384 are fixed values of the checksum.
    byte = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda x: x::bigint)), lambda r, x: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::bigint)), lambda c, b: {byte}), 4294967295)"


def _manifest() -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part(n)} || {part('text')})"
    # A tree level by level, and the climb from a leaf, with what stands before and after it at each level.
    tree = "select a.tree, a.level + 1, a.pos // 2, (a.size + 1) // 2, sha256(a.digest || coalesce(b.digest, '')) from {t} a left join {t} b on b.tree = a.tree and b.pos = a.pos + 1 where a.size > 1 and a.pos % 2 = 0"
    climb = "select c.row, c.tree, c.level + 1, c.pos // 2, (c.size + 1) // 2, c.proof || coalesce(s.digest, ''), sha256(case when c.pos % 2 = 1 then s.digest else '' end || c.folded || case when c.pos % 2 = 0 then coalesce(s.digest, '') else '' end) from {c} c left join {t} s on s.tree = c.tree and s.level = c.level and s.pos = xor(c.pos, 1) where c.size > 1"
    return (
        f"with recursive l as (select row_number() over () as row, doc_id, coalesce('=' || lang, '') as tree, {leaf('n_chars')} as leaf, case when {_crc32('doc_id::varchar')} % 7 = 0 then {leaf('(n_chars + 1)')} else {leaf('n_chars')} end as found from documents), "
        "p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as size from l), "
        f"t(tree, level, pos, size, digest) as (select tree, 0, pos, size, leaf from p union all {tree.format(t='t')}), "
        "sub as (select tree, digest as subroot, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as size from t where size = 1), "
        f"u(tree, level, pos, size, digest) as (select '', 0, pos, size, subroot from sub union all {tree.format(t='u')}), "
        f"c(row, tree, level, pos, size, proof, folded) as (select row, tree, 0, pos, size, '', found from p union all {climb.format(c='c', t='t')}), "
        f"d(row, tree, level, pos, size, proof, folded) as (select c.row, '', 0, sub.pos, sub.size, c.proof, c.folded from c join sub using (tree) where c.size = 1 union all {climb.format(c='d', t='u')}) "
        "select doc_id, leaf, subroot, r.digest as root, sha256(d.proof) as proof_sha256, d.folded as folded_root, d.folded = r.digest as verified "
        "from d join l using (row) join sub on sub.tree = l.tree cross join (select digest from u where size = 1) r where d.size = 1"
    )


_TRIE = (
    "with t as (select conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as digest, turn, length(coalesce(text, '')) as n from conversations where conv_id is not null), "
    "o as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as spot from t), "
    f"h as (select conv_id, {_crc32('conv_id::varchar')} % 6 as h from (select distinct conv_id from t)), "
    "r as (select h.conv_id, spot, digest, n from h join o on o.conv_id = h.conv_id - h.conv_id % 100 and spot < h union all select o.conv_id, spot, digest, n from o join h using (conv_id) where spot >= h), "
    "w as (select *, row_number() over (partition by conv_id order by spot) as depth from r), "
    "pre as (select conv_id, depth, string_agg(digest, '') over (partition by conv_id order by depth) as path, n from w union all select conv_id, 0, '', 0 from h), "
    "ended as (select conv_id, max(depth) as depth from pre group by conv_id), "
    "nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n from pre group by path, depth), "
    "kids as (select path[1:length(path) - 32] as path, count(*) as n_children from nodes where depth > 0 group by 1), "
    "ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from pre join ended using (conv_id, depth) group by path), "
    "full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path)), "
    "sums as (select path[1:32 * k] as path, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * n)::bigint as saved_tokens from (select *, unnest(range(depth + 1)) as k from full_) group by 1) "
    "select f.conv_id, f.depth::bigint as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) as ends_sha256 "
    "from full_ f join sums using (path) left join ends using (path) left join nodes up on f.depth > 0 and up.path = f.path[1:length(f.path) - 32]"
)


TWINS = {"op1_distribution_divergence": _divergence(), "op2_jaccard_join": _JACCARD, "op3_decontaminate": _DECONTAMINATE, "op8_suffix_dedup": _REPEATS, "op10_secrets": _secrets(), "op11_merkle_manifest": _manifest(), "op12_prefix_trie": _TRIE}
