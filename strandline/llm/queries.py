"""The queries of the training-data operators: thin, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lm, mixing, oph, pii, quality, sharding, simhash, token_counts
from .common import TEXTS, stored, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in; toxic ones go; those of low quality are counted
    anew without their repeated lines; and the second batch is sent once more, which changes nothing.

    Both versions of a text are counted in one pass over the documents, so no text is shuffled.  A row's
    versions say themselves whether the row has two, so what is deleted and what is inserted for a revision
    come from the same rows, also where rows share an id.
    """
    ranks, name = token_counts.read_ranks(), "byte_bpe_50k-1"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    version = lambda state, text: F.struct(F.lit(state).alias("state"), text.alias("text"))
    only, both = F.array(version("only", F.col("text"))), F.array(version("old", F.col("text")), version("new", once))
    versions = docs.select("doc_id", "source", "lang", F.inline(F.when(once != F.col("text"), both).otherwise(only)))
    counted = stored(token_counts.count_tokens(versions, ranks, name), "token-counts", batch=TEXTS)
    first, low = counted.filter("state != 'new'"), counted.filter("state != 'only'").join(labels.filter("quality = 0 and toxic = 0"), "doc_id")
    rollup = token_counts.fresh(spark)
    rollup.commit("1-insert", token_counts.insert(first))
    rollup.commit("2-delete", gone := token_counts.delete(first.join(labels.filter("toxic = 1"), "doc_id")))
    rollup.commit("3-revise", token_counts.revise(low.filter("state = 'old'"), low.filter("state = 'new'")))
    rollup.commit("2-delete", gone)
    return rollup.totals()


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "matched")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.schedule(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "size", "source_size", "target", "taken", F.round("finish", 9).alias("finish"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.fingerprint_next(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_token_counts": op2_token_counts,
        "op3_lm_scores": op3_lm_scores,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash": op5_simhash,
        "op6_shards": op6_shards,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_fingerprints": op9_fingerprints,
        "op10_chat": op10_chat,
    }


#: Each word of a document meets the equal words of the items; equal distances between them are one way of laying both over each other.
_OP4 = r"""
with d as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from
       (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents)),
     items as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
     i as (select item_id, len(ws) as n, unnest(ws) as w, unnest(range(len(ws))) as p from items),
     laid as (select doc_id, item_id, n, d.p - i.p as off, count(*) as m from d join i on d.w = i.w where n >= 6 group by all)
select doc_id, item_id, n::bigint as n_words, max(m)::bigint as matched from laid where m >= ceil(0.8 * n - 1e-9) group by doc_id, item_id, n
"""

_OP8 = r"""
with d as (select doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::bigint as size,
       ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key from documents),
     s as (select source, sum(size)::bigint as source_size from d group by source),
     r as (select *, row_number() over (order by source nulls last) as n from s),
     w as (select *, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as top from r),
     l as (select *, row_number() over o as k,
       (sum(source_size) over () * 1.5::double - coalesce(sum(top) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from w
       window o as (order by top / w, source nulls last), b as (order by top / w, source nulls last rows between unbounded preceding and 1 preceding)),
     f as (select min(k) as k, min_by(level, k) as level from l where top > level * w),
     t as (select source, source_size, n, case when f.k is null or l.k < f.k then top else f.level * w end as target from l, f),
     q as (select row_number() over () as nr, doc_id, size, source_size, target, n,
       (sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - size)::bigint as start
       from d join t on d.source is not distinct from t.source),
     e as (select *, unnest([0, 1]) as epoch from q where size > 0 and target > 0),
     p as (select *, unnest(range((size + 15) // 16)) as k from e),
     g as (select nr, n, least(16, size - k * 16) as words, (start + epoch * source_size + k * 16 + least(16, size - k * 16))::double / target as finish from p),
     c as (select nr, words, sum(words) over (order by finish, n rows unbounded preceding) - words as before from g),
     x as (select nr, sum(greatest(0, least(words, (select floor(sum(source_size) * 1.5) from s) - before)))::bigint as taken from c group by nr)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken, case when target > 0 then round((start + size)::double / target, 9) end as finish from q left join x using (nr)
"""

_OP10 = r"""
with rows as (select conv_id, turn, role, coalesce(text, '') as text from conversations
       union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     e as (select *, length(replace(replace(text, '\', '\\'), '</', '<\/'))
       + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+')) as esc from rows)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + 2 + esc + 8)::bigint as formatted_chars
from e group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": _OP4, "op8_mixing": _OP8, "op10_chat": _OP10}
