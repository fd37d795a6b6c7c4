"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitchside.llm import (
    bpe, conversation_trie, decontaminate, jaccard_forest, langid, license_scan, line_dedup, periodic_runs, quality_lines,
    sharding, substring_dedup, token_counts, warc)
from pitchside.llm.common import fresh_path, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = [(v, public_tokenizers.path(f"{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    return token_counts.maintain(table(spark, sf_dir, "documents"), fresh_path(spark, "op1-rollup"), *versions,
                                 ["de", "es", "fr"], public_tokenizers.PATTERN).totals()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(codec.round_trip(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(spark, table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.classes(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op9_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.verdicts(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_langid": op6_langid,
    "op7_jaccard_forest": op7_jaccard_forest,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_lines": op9_quality_lines,
    "op10_sharding": op10_sharding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

#: CRC-32 of a number's decimal text, bit by bit (the polynomial is the fixed one of zip files).
_CRC32 = """xor(list_reduce([unicode(x) for x in string_split(cast({0} as varchar), '')], lambda c, b: list_reduce(range(8),
    lambda v, i: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, xor(c, b)), 4294967295), 4294967295)"""

ORACLES: dict[str, str] = {
    "op11_conversation_trie": f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as k
  from conversations where conv_id is not null),
own as (select *, row_number() over (partition by conv_id order by turn nulls first, k) as n from t),
c as (select conv_id, conv_id - conv_id % 20 as base, {_CRC32.format('conv_id')} % 4 as h from (select distinct conv_id from t)),
turns as (
  select c.conv_id, own.n, k, text from c join own on own.conv_id = c.base and own.n <= h
  union all
  select c.conv_id, own.n - h + least(h, coalesce(b.n, 0)), k, text from own join c using (conv_id)
    left join (select conv_id as base, count(*) as n from t group by conv_id) as b using (base) where own.n > h),
paths as (
  select conv_id, n as depth, list(k) over w as path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words
  from turns window w as (partition by conv_id order by n)
  union all select conv_id, 0, [], 0 from c),
last as (select conv_id, max(depth) as depth from paths group by conv_id),
node as (
  select path, depth, any_value(words) as words, count(*) as n_convs, min(conv_id) as conv_id,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where depth = length), '') as ends,
    count(*) filter (where depth = length) as n_ends
  from (select paths.*, last.depth as length from paths join last using (conv_id)) group by path, depth),
kids as (select path[:depth - 1] as path, count(*) as n from node where depth > 0 group by 1),
above as (select path[:d] as path, leaf, saved from (
  select path, unnest(range(0, depth + 1)) as d, (n_convs - 1) * words as saved, (kids.n is null) as leaf from node left join kids using (path))),
sums as (select path, count(*) filter (where leaf) as n_leaves, sum(saved) as saved_tokens from above group by path)
select node.conv_id, depth, p.conv_id as parent_conv_id, node.n_convs, coalesce(kids.n, 0) as n_children, n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, sha256(ends) as ends_sha256, n_ends
from node join sums using (path) left join kids using (path)
  left join (select path as up, conv_id from node) as p on depth > 0 and p.up = path[:depth - 1]
""",
    "op13_line_dedup": """
with line as (
  select doc_id, p, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(lines) as x, unnest(range(len(lines))) as p
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
often as (select k, min(doc_id) as least from line where length(k) >= 10 group by k having count(distinct doc_id) > 1),
kept as (select doc_id, string_agg(x, chr(10) order by p) as t, count(*) as n
         from line left join often using (k) where least is null or least = doc_id group by doc_id)
select d.doc_id, d.n as n_lines, d.n - coalesce(kept.n, 0) as n_dropped, sha256(coalesce(t, '')) as kept_sha256
from (select doc_id, count(*) as n from line group by doc_id) as d left join kept on d.doc_id = kept.doc_id
""",
    "op2_license_scan": license_scan.oracle(),
    "op5_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, n, w[p:p + n - 1] as win
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p
        from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (
  select doc_id, p, n, w[p:p + n - 1] as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
occ as (select distinct dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on dw.win = iw.win),
hit as (select doc_id, count(distinct q) as n_hit
        from (select doc_id, unnest(range(p, p + n)) as q from occ) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id from occ) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join named on d.doc_id = named.doc_id
""",
    "op4_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as h from p),
l as (select h, n, max(page_id) as leader from q where n >= 1000 group by h, n)
select page_id, cast(q.n as bigint) as payload_bytes, q.h as payload_digest,
       case when page_id < leader then 'revisit' else 'response' end as record_type,
       case when page_id < leader then leader end as refers_to
from q left join l on q.h = l.h and q.n = l.n
""",
    "op8_substring_dedup": """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (
  select doc_id, p, array_to_string(w[p:p + 19], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d where len(w) >= 20)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from win)
          where r > 1),
gone as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 20)) as q from again)),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from d),
kept as (select doc_id, string_agg(word, ' ' order by q) as t, count(*) as n
         from word anti join gone using (doc_id, q) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) as bigint) - coalesce(kept.n, 0) as n_removed,
       sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
""",
    "op9_quality_lines": """
with d as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
line as (
  select doc_id, source, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as n,
    trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as norm
  from (select doc_id, source, unnest(string_split(t, chr(10))) as x from d)
  where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
hosts as (select source, count(*) as n_docs from documents group by source),
frequent as (
  select line.source, norm from line join hosts on line.source is not distinct from hosts.source
  group by line.source, norm, n_docs having count(distinct doc_id) > 20 and count(distinct doc_id) > 0.1 * n_docs),
removed as (
  select doc_id, sum(n) as words, count(*) as lines
  from line join frequent on line.source is not distinct from frequent.source and line.norm = frequent.norm group by doc_id),
dup as (select doc_id, count(*) - count(distinct x) as n from line group by doc_id),
win as (
  select doc_id, p, array_to_string(w[p:p + 7], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from d where len(w) >= 8)),
again as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, s) as c from win) where c > 1),
rep as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + 8)) as q from again) group by doc_id),
x as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(removed.words, 0) as bigint) as n_removed_words,
    coalesce(removed.lines, 0) as n_removed_lines
  from d left join dup on d.doc_id = dup.doc_id left join rep on d.doc_id = rep.doc_id
    left join removed on d.doc_id = removed.doc_id),
y as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from x)
select *, not base_failed and 2 * (n_words - n_removed_words) >= n_words as kept from y
""",
}
