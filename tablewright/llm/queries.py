"""The operators with production parameters over the sample tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (
    ann,
    ball_tree,
    bpe,
    lattice,
    mixing,
    passages,
    periodic,
    shards,
    shingle_join,
    token_files,
    toxicity,
    vector_dedup,
    whitening,
)
from tablewright.llm.common import read


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.embedding_neighbours(read(spark, sf_dir, "embeddings"))


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.document_slots(read(spark, sf_dir, "documents"))


def op3_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.document_digests(read(spark, sf_dir, "documents"))


def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.embedding_components(read(spark, sf_dir, "embeddings"))


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_checksums(read(spark, sf_dir, "documents"))


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing.mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixing.with_copies(rows, plan).select("doc_id", "size", "source_size", "target", "taken")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.document_spans(read(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.document_components(read(spark, sf_dir, "documents"))


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.document_scores(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.document_digests(read(spark, sf_dir, "documents"))


def op12_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.embedding_whitened(read(spark, sf_dir, "embeddings"))


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.embedding_top(read(spark, sf_dir, "embeddings")).drop("query_part")


MIX_SQL = r"""
with weight as (
  select doc_id as l, case max(quality) when 1 then 2.0 when 0 then 0.5 else 1.0 end as w
  from labels where doc_id is not null group by doc_id
), rows as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5)
        / 4503599627370496.0::double) / coalesce(w, 1.0)::double as draw
  from documents d left join weight on d.doc_id = l
), sizes as (
  select source, sum(size)::bigint as source_size,
    [5.0::double, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from rows group by source
), levels as (
  select *, row_number() over ratio as i,
    (sum(source_size) over ()  - coalesce(sum(source_size * 3) over (ratio rows between unbounded preceding and 1 preceding), 0))
      / (sum(w) over () - coalesce(sum(w) over (ratio rows between unbounded preceding and 1 preceding), 0.0)) as level
  from sizes window ratio as (order by source_size * 3 / w, source nulls last)
), targets as (
  select source, source_size, case when source_size * 3 / w <= level then (source_size * 3)::double
    else (select arg_min(level, i) from levels where source_size * 3 / w > level) * w end as target
  from levels
), epochs as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets
), drawn as (
  select source, draw, sum(size) as part, sum(sum(size)) over (partition by source order by draw) as upto
  from rows group by source, draw
)
select r.doc_id, r.size, e.source_size, e.target,
  (r.size * (e.epochs + case when 2 * upto - part < 2 * (target - epochs * source_size) then 1 else 0 end))::bigint as taken
from rows r join epochs e on r.source is not distinct from e.source
join drawn n on n.source is not distinct from r.source and n.draw = r.draw
"""

TOP_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::bigint as score
  from rows q join rows c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

QUERIES = {
    "op1_multiprobe_search": op1_multiprobe_search,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_distinct_word_bpe": op3_distinct_word_bpe,
    "op4_pruned_graph": op4_pruned_graph,
    "op5_toxic_spans": op5_toxic_spans,
    "op6_token_files": op6_token_files,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_compact_windows": op8_compact_windows,
    "op9_shingle_join": op9_shingle_join,
    "op10_lattice_scores": op10_lattice_scores,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spectrum_slicing": op12_spectrum_slicing,
    "op13_ball_tree_search": op13_ball_tree_search,
}
SQL = {"op7_weighted_mix": MIX_SQL, "op13_ball_tree_search": TOP_SQL}
