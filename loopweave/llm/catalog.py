"""The registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm import (compression_quality, decontamination, dimension_sharded_kmeans,
                           importance_resampling, language_id, line_dedup, mixing, near_duplicates,
                           substring_dedup, token_records, topk_search, url_filters, warc)

#: The vocabulary that the records are written with; a path, never a copy.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = ("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with the DuckDB SQL for the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = rf"""
with d as (select doc_id, coalesce(regexp_extract_all({LOWER.format('text')},
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all({LOWER.format('text')},
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
windows as (select distinct item_id, n, w[i:i + n - 1] as words
            from (select *, unnest(range(1, len(w) - n + 2)) as i from sized)),
places as (select doc_id, n, p, w[p:p + n - 1] as words
           from (select d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) as p
                 from d cross join (select distinct n from sized) s where len(d.w) >= s.n)),
found as (select distinct doc_id, n, p, item_id from places join windows using (n, words)),
hit as (select doc_id, count(distinct q) as n_hit
        from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names
          from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@query("op1_suffix_array_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_compression_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.held_out_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_pivotal_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_centroid_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


@query("op5_length_delimited_records")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.tokenized(table(spark, sf_dir, "documents"), TOKENIZER)


OP6_SQL = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({LOWER.format('text')},
             '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1:1]]
             else list_transform(range(1, len(w)), lambda i: w[i:i + 1]) end) as g from d),
u as (select doc_id, unnest(g) as x from s),
meet as (select a.doc_id as i, b.doc_id as j, count(*) as n from u a join u b on a.x = b.x
         and a.doc_id < b.doc_id group by 1, 2),
link as (select i, j from meet join s a on a.doc_id = i join s b on b.doc_id = j
         where 100 * n >= 80 * (len(a.g) + len(b.g) - n)),
way as (select i, j from link union all select j, i from link),
reach(doc_id, seen) as (select doc_id, doc_id from s
          union select way.j, reach.seen from reach join way on way.i = reach.doc_id),
least as (select doc_id, min(seen) as component_id from reach group by doc_id)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, component_id,
       s.doc_id = component_id as kept
from s join least using (doc_id)
"""


@query("op6_hamming_near_duplicates", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op7_deletion_neighbourhood_lines")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double))
             as bigint)) as x from embeddings),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(
             range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) as bigint) as score
           from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id)
             as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op8_block_at_a_time_search", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, scale=256.0)


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as sha, max(page_id) over (partition by html) as kept from p),
bits as (select *, list_transform(range(0, 160), lambda b:
           ((strpos('0123456789abcdef', substr(sha, b // 4 + 1, 1)) - 1) >> (3 - b % 4)) & 1) as bit
         from h)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(1 + 16 * bit[5 * g + 1] + 8 * bit[5 * g + 2] + 4 * bit[5 * g + 3] + 2 * bit[5 * g + 4]
         + bit[5 * g + 5] as bigint), 1)), '') as payload_digest,
       case when page_id = kept then 'response' else 'revisit' end as record_type,
       case when page_id <> kept then kept end as refers_to
from bits
"""


@query("op9_transaction_assembly", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP10_SQL = rf"""
with u as (select page_id,
    coalesce({LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select * from (values {", ".join(map(str, RULES))}) t(rule_host, rule_path, verdict)),
fit as (select page_id, host, path, rule_host || rule_path as rule, verdict
        from u join r on (host = rule_host or ends_with(host, '.' || rule_host))
        and starts_with(path, rule_path)),
best as (select *, row_number() over (partition by page_id order by length(rule) desc) as n from fit)
select u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') as verdict
from u left join best on u.page_id = best.page_id and best.n = 1
"""


@query("op10_hashed_url_filters", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


#: The nibble-wise table of CRC-32, from its polynomial.
CRC_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    CRC_NIBBLES[_i] = _c

_WORDS = (f"coalesce(regexp_extract_all({LOWER.format('text')}, "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
_NIBBLE = "strpos('123456789ABCDEF', substr(x, {}, 1))"

OP11_SQL = rf"""
with nibbles as (select {CRC_NIBBLES}::bigint[] as t),
words as (select 0 as kind, doc_id as id, {_WORDS} as w from documents
          union all select 1, null, {_WORDS} from benchmark),
numbered as (select row_number() over () as place, * from words),
features as (select place, kind, unnest(list_transform(range(1, len(w) - n + 2),
               lambda i: array_to_string(w[i:i + n - 1], ' '))) as f
             from numbered, (select unnest([1, 2, 3]) as n) where len(w) >= n),
hexed as (select f, hex(encode(f)) as x from (select distinct f from features)),
hashed as (select f, xor(list_reduce(list_prepend(4294967295::bigint,
             list_transform(range(1, cast(length(x) / 2 as bigint) + 1), lambda i: cast(
               16 * {_NIBBLE.format('2 * i - 1')} + {_NIBBLE.format('2 * i')} as bigint))),
             lambda a, b: xor(t[cast(xor(xor(t[cast(xor(a, b) & 15 as int) + 1], a >> 4),
                                         b >> 4) & 15 as int) + 1],
                              xor(t[cast(xor(a, b) & 15 as int) + 1], a >> 4) >> 4)),
             4294967295) % 10000 as bucket from hexed, nibbles),
found as (select place, kind, bucket from features join hashed using (f)),
sums as (select b as bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t
         from (select unnest(range(0, 10000)) as b) left join found on bucket = b group by b),
gains as (select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * cast((select sum(s) from sums)
            + 10000 as double) / (cast(s + 1 as double) * cast((select sum(t) from sums) + 10000
            as double)))) as bigint) as gain from sums),
weights as (select place, count(*) as n_features, cast(sum(gain) as bigint) as weight
            from found join gains using (bucket) where kind = 0 group by place),
scored as (select id as doc_id, cast(len(w) as bigint) as n_words,
             coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(concat('0x',
               substr(sha256('42:' || id), 1, 8)) as bigint) + 0.5::double) / 4294967296.0::double)))
               as bigint) as score
           from numbered left join weights using (place) where kind = 0),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r,
             5 * count(*) over (partition by n_words >= 20) // 100 as drawn from scored)
select doc_id, n_words, n_features, weight, score,
       case when n_words >= 20 and r <= drawn then r end as rank from ranked
"""


@query("op11_crc_matrix_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.draw(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^ 	-]+'), []) as w
           from documents),
windows as (select doc_id, unnest(range(1, len(w) - 18)) as p,
              unnest(list_transform(range(1, len(w) - 18),
                     lambda i: array_to_string(w[i:i + 19], ' '))) as s
            from d where len(w) >= 20),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by s
            order by doc_id, p) as n from windows) where n > 1),
gone as (select doc_id, list(distinct q) as qs
         from (select doc_id, unnest(range(p, p + 20)) as q from later) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words,
       cast(coalesce(len(qs), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
         lambda z: not list_contains(coalesce(qs, []), z[2])), lambda z: z[1]), ' '), ''))
         as kept_sha256
from d left join gone using (doc_id)
"""


@query("op12_rabin_karp_windows", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _lloyd_sql(rounds: int = 10, dims: int = 64) -> str:
    """All rounds unrolled: labels, then sums, one cell for each row."""
    away = "cast(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) ** 2)) as bigint)"
    floored = "(s - ((s % n) + n) % n) // n"
    steps = [f"""
v as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as
        double)) as bigint)) as x from embeddings where len(embedding) = {dims} and
        len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
c0 as materialized (select cast(row_number() over (order by h) - 1 as integer) as cluster, x from (
        select sha256('3:' || vec_id) as h, x from v order by h limit 8))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (select vec_id, x, cluster, distance from (select v.vec_id, v.x, c.cluster,
        {away} as distance, row_number() over (partition by vec_id order by {away}, c.cluster) as n
        from v, c{r} c) where n = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} as materialized (select cluster, list(cast({floored} as bigint) order by i) as x from (
        select cluster, i, sum(e) as s, count(*) as n from (select cluster,
          unnest(range(0, {dims})) as i, unnest(x) as e from a{r}) group by cluster, i)
        group by cluster),
c{r + 1} as materialized (select c.cluster, coalesce(s.x, c.x) as x
        from c{r} c left join s{r} s using (cluster))""")
    return f"""with {",".join(steps)}
select vec_id, cluster, distance,
       cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia,
       sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} join c{rounds} c using (cluster)"""


@query("op13_dimension_sharded_lloyd", _lloyd_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_sharded_kmeans.clusters(table(spark, sf_dir, "embeddings"))
