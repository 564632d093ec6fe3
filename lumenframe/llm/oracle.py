"""DuckDB SQL that the queries of this subpackage are checked against, over whole tables."""

from __future__ import annotations

from lumenframe.plans.relations import path_sql

_VECTORS = """cl as (select clip_id, folder, any_value(signature) as signature, any_value(embedding) as embedding from clips where clip_id is not null group by 1, 2),
uv as (select clip_id, folder, signature, embedding as v, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) as n from cl
  where len(embedding) = 96 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 96 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
co as (select a.clip_id as a, b.clip_id as b, list_inner_product(a.v, b.v) / a.n / b.n as cosine from uv a join uv b on a.clip_id < b.clip_id)"""

_PATH = path_sql("source")

_FILES = f"""fi as (select distinct {_PATH} as file from clips where source is not null), ca as (select distinct cand_pos, {_PATH} as file, score, scored_at from candidates where cand_pos is not null),
cf as (select cand_pos, file, case when isnan(score) then null else score end as score, year(scored_at) as year from ca where file in (select file from fi))"""

_GROUPED = f"""c0 as (select distinct clip_id, folder, source, camera, duration_s, fps, width, height, captured_at, analyzed_at, regexp_extract(trim(duplicate_group), '^(?i)g?[\\s_-]*0*([0-9]+)$', 1) as number from clips where folder is not null),
c1 as (select *, count(*) over (partition by folder, number) as gn from c0 where number is not null and number <> ''), bs as (select {_PATH} as file, max(score) as score from candidates where score is not null and not isnan(score) group by 1),
g as (select c.*, bs.score, m.trust_rank, m.first_seen, 'g' || number as duplicate_group from (select *, {_PATH} as file from c1 where gn > 1) c left join bs on bs.file = c.file left join (select camera, min(trust_rank) as trust_rank, min(first_seen) as first_seen from cameras group by 1) m on m.camera = c.camera)"""

_OK_TIME = "captured_at > 0 and not isnan(captured_at) and (first_seen is null or captured_at >= epoch(first_seen)) and (analyzed_at is null or captured_at <= epoch(analyzed_at))"
_RANK = "trust_rank nulls last, score desc nulls last, analyzed_at desc nulls last, clip_id"

SQL = {
    "p1_found": f"""with recursive {_VECTORS}, ed as (select a, b from co where cosine >= 0.75), tw as (select a, b from ed union all select b, a from ed), dg as (select a as id, count(*) as degree from tw group by 1),
      cc(id, r) as (select a, a from tw union select t.b, cc.r from cc join tw t on t.a = cc.id), ro as (select id, min(r) as root from cc group by 1),
      gd as (select root from ro join dg using (id) group by root having min(degree) = count(*) - 1 and max(degree) = count(*) - 1), me as (select ro.id, ro.root from ro join gd using (root)),
      fr as (select clip_id, folder, unnest(string_split(lower(signature), ':')) as f from cl where regexp_full_match(lower(signature), '[0-9a-f]{{16}}(:[0-9a-f]{{16}})*')),
      xa as (select distinct q.clip_id as id, me.root from fr q join fr k on q.folder = k.folder and q.clip_id <> k.clip_id join me on me.id = k.clip_id
        where q.clip_id not in (select clip_id from uv) and bit_count(xor(('0x' || q.f)::UBIGINT, ('0x' || k.f)::UBIGINT)) <= 8),
      al as (select id, root from me union select id, root from xa) select min(id) over (partition by root) as cluster_id, id as clip_id from al""",
    "p2_found": """with recursive e as (select distinct clip_a as a, clip_b as b from clip_matches where clip_a is not null and clip_b is not null and clip_a <> clip_b and ((method = 'phash' and distance <= 8) or (method = 'semantic' and cosine >= 0.92 and not isnan(cosine)))),
      t as (select a, b from e union select b, a from e), c(id, r) as (select a, a from t union select t.b, c.r from c join t on t.a = c.id) select id as clip_id, min(r) as group_id from c group by 1""",
    "p3_found": f"""with {_VECTORS}, t as (select a as q, b as o, cosine from co union all select b, a, cosine from co), r as (select *, row_number() over (partition by q order by cosine desc, o) as k from t)
      select distinct least(q, o) as clip_a, greatest(q, o) as clip_b from r where k <= 5 and cosine >= 0.85""",
    "p5_found": f"with {_FILES} select cand_pos from (select *, row_number() over (partition by file order by score desc nulls last, cand_pos) as r from cf) where r > 40",
    "p5_by_year": f"""with {_FILES}, n as (select file, year, count(*) as n, sum(count(*)) over (partition by file) as total from cf group by file, year),
      q as (select *, case when total <= 40 then n else 40.0::double * n / total end as part from n), b as (select *, floor(part + 1e-9) as base from q),
      s as (select *, least(40, total) - sum(base) over (partition by file) as spare, row_number() over (partition by file order by part - base desc, year nulls first) as k from b),
      r as (select *, row_number() over (partition by file, year order by score desc nulls last, cand_pos) as kept_rank from cf)
      select r.cand_pos, r.file, r.year, r.kept_rank from r join s on s.file = r.file and s.year is not distinct from r.year where r.kept_rank <= s.base + case when s.k <= s.spare then 1 else 0 end""",
    "p7_checks": "select what, 0::bigint as n from (values ('overfull'), ('split_small'), ('incomplete'), ('torn'), ('skipped')) t(what)",
    "p8_checks": "select what, 0::bigint as n from (values ('too_many_copies'), ('misnumbered'), ('unlisted'), ('off_target'), ('off_plan')) t(what)",
    "p6_found": f"""with {_GROUPED}, l as (select folder, duplicate_group, f.field, clip_id, row_number() over (partition by folder, duplicate_group, f.field order by {_RANK}) as r
        from g, (values ('duration_s'), ('fps'), ('width'), ('height'), ('captured_at')) f(field)
        where case f.field when 'duration_s' then duration_s > 0 and not isnan(duration_s) when 'fps' then fps > 0 and not isnan(fps) when 'width' then width > 0 when 'height' then height > 0 else {_OK_TIME} end)
      select folder, duplicate_group, field, clip_id from l where r = 1""",
    "p6_records": f"""with {_GROUPED}, k as (select *, coalesce((duration_s > 0 and not isnan(duration_s))::int, 0) + coalesce((fps > 0 and not isnan(fps))::int, 0) + coalesce((width > 0)::int, 0) + coalesce((height > 0)::int, 0) + coalesce(({_OK_TIME})::int, 0) as full_ from g),
      r as (select *, row_number() over (partition by folder, duplicate_group order by full_ desc, {_RANK}) as r from k) select folder, duplicate_group, clip_id, full_::bigint as completeness from r where r = 1""",
}
