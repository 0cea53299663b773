"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.llm.common import read_table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm import token_files
    from mosaique.session import shared_path

    path = shared_path(spark, "shards")
    token_files.write_shards(read_table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_offending",
    )


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.privacy import replace

    return replace(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.near_dedup import components

    return components(read_table(spark, sf_dir, "documents"), k=4, percent=80, as_read=True)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.html import main_text

    return main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "path")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm import quality
    from mosaique.session import materialize

    table = materialize(quality.ledger(read_table(spark, sf_dir, "documents")), "ledger")
    table = quality.apply_policy(table, quality.PRODUCTION, "verdict")
    table = quality.apply_policy(table, "base@1", "base_kept")
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("verdict")).alias("kept"), "failed",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm import exact_dedup

    groups = exact_dedup.exact_groups(exact_dedup.digests(read_table(spark, sf_dir, "documents")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.resample import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.exact_search import search

    return search(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaique.llm.prefix_trie import trie

    return trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_privacy": op5_privacy,
    "op6_near_dedup": op6_near_dedup,
    "op7_html": op7_html,
    "op10_bpe": op10_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_resample": op11_resample,
    "op12_exact_search": op12_exact_search,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The rules as a reader would state them, in bit order and from the table of words and lines.
_SQL_RULES = {
    "few_words": "len(words) between 0 and 9",
    "repeated_windows": "not (coalesce(n_repeat_words, 0) <= len(words) / 5)",
    "many_words": "len(words) >= 1000001",
    "symbol_ratio": "len(words) * 0.3 < n_symbols",
    "short_words": "case when len(words) > 0 then word_chars / len(words) < 2.5 else false end",
    "long_words": "case when len(words) > 0 then word_chars / len(words) > 12 else false end",
    "duplicate_lines": "len(lines) > 3 and len(list_distinct(lines)) < len(lines) / 2",
    "ellipsis_lines": "len(lines) > 3 and n_ellipsis_lines > len(lines) * 0.3",
    "few_alphabetic_words": "n_alpha_words < len(words) - n_alpha_words",
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
       doc_id = first_value(doc_id) over w as kept, h as text_sha256
from d window w as (partition by h order by n desc, doc_id)""",
    "op8_quality_rules": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
      from t),
g as (select doc_id, i, array_to_string(words[i:i+4], ' ') as k
      from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from g) where n > 1),
cov as (select doc_id, count(distinct i + o) as n_repeat_words from rep, range(0, 5) r(o) group by doc_id),
m as (select w.doc_id, len(words) as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
             len(lines) - len(list_distinct(lines)) as n_dup_lines,
             coalesce(n_repeat_words, 0) as n_repeat_words, words, lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) as n_ellipsis_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) as n_alpha_words
      from w left join cov using (doc_id)),
f as (select *, """ + " + ".join(f"case when {c} then {1 << k} else 0 end" for k, c in enumerate(_SQL_RULES.values())) + r""" as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, (failed & 507) = 0 as kept,
       cast(failed as bigint) as failed
from f""",
    "op11_resample": r"""
with steps as materialized (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n::bigint)) as tab),
docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
aims as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
f as materialized (
  select doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as fs from docs),
occ as (select doc_id, fs, unnest(fs) as x from f),
toc as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as x from aims),
distinct_x as (select x from occ union select x from toc),
hexed as (select x, hex(encode(x)) as h from distinct_x),
crc as materialized (
  select x, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2*i+1:2*i+1]) - 1) * 16 + instr('0123456789ABCDEF', h[2*i+2:2*i+2]) - 1),
    lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b::bigint)]), 4294967295::bigint), 4294967295::bigint) % 10000 as b
  from hexed, steps),
s as (select b, count(*) as n from occ join crc using (x) group by b),
t as (select b, count(*) as n from toc join crc using (x) group by b),
whole as (select (select coalesce(sum(n), 0) from s)::double + 10000 as vs, (select coalesce(sum(n), 0) from t)::double + 10000 as vt),
gain as (select b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * vs / ((s.n + 1)::double * vt)))::bigint as g from s left join t using (b), whole),
wt as (select doc_id, count(*) as n_features, floor(sum(g) / count(*)::double)::bigint as weight from occ join crc using (x) join gain using (b) group by doc_id),
sc as (
  select f.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('7:' || f.doc_id), i, 1)) - 1), lambda a, c: a * 16 + c, 0::bigint) as h
  from f left join wt using (doc_id)),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score, n_features >= 39 as able from sc),
placed as (select *, row_number() over (partition by able order by score desc, doc_id) as place, count(*) over (partition by able) as n_able from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when able and place <= 25 * n_able // 100 then place end as rank from placed""",
    "op12_exact_search": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op13_prefix_trie": r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda a: ascii(a)::bigint),
      lambda r, b: list_reduce(range(8), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(r, b)), 4294967295::bigint), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from t)),
head as (select c.conv_id, pos, role, text from c join t on t.conv_id = c.base and pos < h),
n_head as (select conv_id, count(*) as n from head group by conv_id),
r as (
  select * from head union all
  select t.conv_id, pos - h + coalesce(n, 0), role, text from t join c using (conv_id) left join n_head using (conv_id) where pos >= h),
m as materialized (
  select conv_id, pos + 1 as d, string_agg(sha256(length(role) || ':' || role || text), '' order by pos) over (partition by conv_id order by pos) as k,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r
  union all select conv_id, 0, '', 0 from c),
p as materialized (select *, case when d > 0 then k[1:64 * (d - 1)] end as pk from m),
v as materialized (select k, min(conv_id) as conv_id, any_value(d) as d, any_value(pk) as pk, any_value(words) as words, count(*) as n from p group by k),
kids as (select pk as k, count(*) as n_children from v where pk is not null group by pk),
sub as (
  select p.k, count(*) filter (kids.k is null) as n_leaves, sum((v.n - 1) * v.words) as saved
  from v join p on p.conv_id = v.conv_id and p.d <= v.d left join kids on kids.k = v.k group by p.k),
last as (select conv_id, arg_max(k, d) as k from p group by conv_id),
e as (select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from last group by k)
select v.conv_id, v.d as depth, up.conv_id as parent_conv_id, v.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved::bigint as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from v left join v up on up.k = v.pk left join kids on kids.k = v.k join sub on sub.k = v.k left join e on e.k = v.k""",
}
