"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import table
from . import decontaminate, manifest, mix, neardup, neighbours, prefixtrie, quality, repeats, secrets, shards, tokens, toolcalls, toxicity, twins


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.divergence(table(spark, sf_dir, "documents"))
    # Sums in another order differ in the last digits.
    return judged.withColumns({c: F.round(c, 9) for c in ("js_classes", "js_words")})


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.verbatim_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.digest(mix.mix_sources(table(spark, sf_dir, "documents")))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link_tool_calls(calls, results, spark.createDataFrame(toolcalls.TOOLS, "name string, param string, type string, required boolean"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeated_passages(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(manifest.merkle_manifest(table(spark, sf_dir, "documents"), tampered=manifest.tampered()))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.paths(table(spark, sf_dir, "conversations"))))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_distribution_divergence, op2_jaccard_join, op3_decontaminate, op4_mix_sources, op5_hilbert_shards, op6_toxicity, op7_tool_calls, op8_suffix_dedup, op9_token_counts, op10_secrets, op11_merkle_manifest, op12_prefix_trie, op13_nearest_neighbours)}
# The calls that ``toolcalls.conversation_calls`` makes of the turns, linked, layered by a recursion and written as text.
_CALLS = (
    "with recursive t as (select *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations), "
    "c as (select conv_id, turn, words, text, 'call-' || conv_id || '-' || turn as call_id, ['search', 'lookup', 'measure'][words % 3 + 1] as name, turn // 4 * 2 as back, words % 7 <> 0 as asks, words % 11 = 0 as says, words % 5 = 0 as quoted from t where role = 'user'), "
    "e as (select c.conv_id, c.turn, case when back < c.turn then exists (select 1 from c o where o.conv_id = c.conv_id and o.turn = c.back) end as known, c.back from c), "
    "l as (select conv_id, turn, 0 as level from e where coalesce(not known, true) union all select e.conv_id, e.turn, l.level + 1 from e join l on l.conv_id = e.conv_id and l.turn = e.back where e.known), "
    "r as (select conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) as call_id, text from t where role = 'assistant'), "
    "j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as seq, name, level, case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'linked' end as status, (c.call_id is not null)::bigint as n_calls, (r.call_id is not null)::bigint as n_results, "
    "array_to_string(list_filter([case when known = false then 'needs:call-' || c.conv_id || '-' || c.back end, case when name in ('search', 'lookup') and not asks then 'missing:query' end, case when quoted then 'type:words' end, case when name <> 'lookup' and says then 'unknown:lang' end], lambda x: x is not null), ',') as errors, "
    "'{' || array_to_string(list_filter([case when says then '\"lang\":\"xx\"' end, case when asks then '\"query\":' || to_json(split_part(coalesce(c.text, ''), chr(10), 1)) end, '\"words\":' || case when quoted then '\"' || words || '\"' else words::varchar end], lambda x: x is not null), ',') || '}' as arguments, case when c.back < c.turn then '[\"call-' || c.conv_id || '-' || c.back || '\"]' end as needs, r.text as result "
    "from c left join l on l.conv_id = c.conv_id and l.turn = c.turn left join e on e.conv_id = c.conv_id and e.turn = c.turn full join r on r.conv_id = c.conv_id and r.call_id = c.call_id) "
)
ORACLE = twins.TWINS | {
    "op7_tool_calls": _CALLS
    + "select conv_id, call_id, seq, name, level, case when n_calls > 0 then row_number() over (partition by conv_id, n_calls > 0 order by level nulls last, seq, call_id) - 1 end as position, status, n_calls, n_results, case when n_calls > 0 then errors = '' end as valid, case when n_calls > 0 then errors else '' end as errors, "
    "'{' || array_to_string(list_filter([case when n_calls > 0 then '\"arguments\":' || arguments end, '\"call_id\":' || to_json(call_id), '\"depends_on\":' || needs, '\"level\":' || level, '\"name\":' || to_json(name), '\"result\":' || to_json(result), '\"status\":' || to_json(status)], lambda x: x is not null), ',') || '}' as json from j"
}
