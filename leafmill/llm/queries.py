"""The registered queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from leafmill.llm import bpe, extraction, language, licenses, lines, merkle, mixing, packing, repair, simhash, tokens, trie, vectors
from leafmill.llm.common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 49407 is this vocabulary's end-of-text id.
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49407)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_groups(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.share_beginnings(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op1_lines": op1_lines, "op2_tokens": op2_tokens, "op3_fingerprints": op3_fingerprints, "op4_language": op4_language, "op5_vectors": op5_vectors, "op6_simhash": op6_simhash, "op7_extraction": op7_extraction, "op8_packing": op8_packing, "op9_mix": op9_mix, "op10_licenses": op10_licenses, "op11_trie": op11_trie, "op12_repair": op12_repair, "op13_bpe": op13_bpe}

# Lines within one edit share the half that the edit isn't in; candidates are joined on halves, then lose the first character in which they differ.
OP1 = """
with lines as (
  select doc_id, no - 1 no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) line
  from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents where text is not null)
),
firsts as (select line, length(line) n, min((doc_id, no)) first from lines where line <> '' group by 1),
halves as (
  select line, n, first, n m, left(line, n // 2) a, right(line, n - n // 2) b from firsts
  union all select line, n, first, n - 1, left(line, (n - 1) // 2), right(line, n - 1 - (n - 1) // 2) from firsts
),
near as (select distinct x.line, x.n, y.line other, y.n other_n, y.first from halves x join halves y on x.m = y.m and (x.a = y.a or x.b = y.b) and y.first < x.first and abs(x.n - y.n) <= 1),
spots as (select *, list_position([z[1] is distinct from z[2] for z in list_zip(string_split(line, ''), string_split(other, ''))], true) p from near),
pairs as (select line, first from spots where case when n >= other_n then left(line, p - 1) || substr(line, p + 1) else line end = case when other_n >= n then left(other, p - 1) || substr(other, p + 1) else other end),
marked as (select f.line, least(f.first, coalesce(p.first, f.first)) first from firsts f left join (select line, min(first) first from pairs group by 1) p using (line)),
dropped as (select l.doc_id, l.no from lines l join marked m using (line) where (l.doc_id, l.no) > m.first),
counted as (select doc_id, list(no) nos from dropped group by 1)
select d.doc_id,
  case when text is null then null else array_to_string([l for l, k in string_split(text, chr(10)) if not list_contains(coalesce(nos, []), k - 1)], chr(10)) end as "text",
  coalesce(len(string_split(text, chr(10))), 0)::bigint n_lines, coalesce(len(nos), 0)::bigint n_dropped
from documents d left join counted c on c.doc_id = d.doc_id
"""

# Every pair of a label; components by following links.
OP5 = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null),
links as (select x.vec_id a, y.vec_id b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.93),
walk as (select vec_id, vec_id root from embeddings union select l.b, w.root from walk w join links l on l.a = w.vec_id),
c as (select vec_id, min(root) component_id from walk group by 1)
select e.vec_id, (select count(*) from links where a = e.vec_id) n_links, component_id, e.vec_id = component_id kept from embeddings e join c on c.vec_id = e.vec_id
"""

OP9 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 u,
    greatest(0.05, 1 - 4 * (len(regexp_extract_all(coalesce(text, ''), '[^\pL\pN\s.,;:!?''"()-]')) / greatest(length(text), 1))) w
  from documents
),
keyed as (select *, (-ln(u) / w) / (1 + (-ln(u) / w)) x from sized),
sources as (select source, sum(size)::bigint source_size from sized group by 1),
weighed as (select *, [1.0, 2.0, 3.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over () - coalesce(sum(w) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from weighed
),
plan as (select source, source_size, least(source_size * 3.0, w * (select arg_min(level, (source_size * 3 / w, source)) from levels where level <= source_size * 3 / w))::double target from levels),
budget as (select *, least(floor(target / source_size + 1e-12), 3)::bigint epochs, greatest(0, target - least(floor(target / source_size + 1e-12), 3) * source_size) rest from plan),
running as (select k.*, b.source_size, b.target, b.epochs, b.rest, sum(k.size) over (partition by k.source order by x, doc_id, k.size rows unbounded preceding) upto from keyed k join budget b on k.source is not distinct from b.source)
select doc_id, source, size, source_size, target, (size * (epochs + case when epochs < 3 and upto - size / 2 <= rest then 1 else 0 end))::bigint taken from running
"""

#: The other queries use hashes, tokenizers or trained models that SQL lacks, or read markup; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_lines": OP1, "op5_vectors": OP5, "op9_mix": OP9}
