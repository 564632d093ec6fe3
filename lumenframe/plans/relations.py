"""Queries of the joins and of near-duplicate grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import signature_distance
from lumenframe.functions.paths import normalized
from lumenframe.operators import graph, joins, segments
from lumenframe.plans.series import ENERGY_SQL, SECTIONS_SQL, energy, song_lengths
from lumenframe.session import materialize, table


def _cands(spark: SparkSession, d: str) -> DataFrame:
    """The candidates, each once, with ``file``, the one spelling of ``source`` that joins them to their clip."""
    return table(spark, d, "candidates").where("cand_pos is not null").dropDuplicates(["cand_pos"]).withColumn("file", normalized(F.col("source")))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """The clips, each once, with ``file``."""
    return table(spark, d, "clips").dropDuplicates(["clip_id"]).withColumn("file", normalized(F.col("source")))


def _best(spark: SparkSession, d: str) -> DataFrame:
    """``(file, score)``: the best usable score of each file."""
    return _cands(spark, d).where("score is not null and not isnan(score)").groupBy("file").agg(F.max("score").alias("score"))


def ban_favourite(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of clips that were never marked blurry, favourites up by two; a NaN score counts as missing."""
    score = F.when(~F.isnan("score"), F.col("score")).alias("score")
    c = _cands(spark, d).select("cand_pos", "file", score, "reasons").join(_clips(spark, d).select("file", normalized(F.col("origin")).alias("origin_file")), "file", "left")
    banned = c.where(F.array_contains("reasons", "blurry") & (F.col("score") < 0)).select("file")
    liked = c.where(F.array_contains("reasons", "user_favorite")).select("file", F.lit(True).alias("liked")).distinct()
    x = joins.without_banned(c, banned, ["file", "origin_file"], "file").join(liked, "file", "left")
    return x.select("cand_pos", "file", F.round(F.col("score") + F.when(F.col("liked"), 2.0).otherwise(0.0), 6).alias("score"))


def interval_tag_hit(spark: SparkSession, d: str) -> DataFrame:
    c = _cands(spark, d).select("cand_pos", "file", "start_s", "end_s").join(_clips(spark, d).select("file", "tags_ms"), "file")
    return c.select("cand_pos", joins.any_in_closed(F.col("tags_ms"), F.col("start_s") * 1000, F.col("end_s") * 1000).alias("hit"))


def _beats(spark: SparkSession, d: str) -> DataFrame:
    """A beat every 0.7 s over each song."""
    last = F.floor(F.col("n") / F.lit(0.7))
    return song_lengths(spark, d).select("song", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("i")).withColumn("t", F.round(F.col("i") * 0.7, 3))


def _onsets(spark: SparkSession, d: str) -> DataFrame:
    """Onsets near the loud seconds of each song, a little off the grid."""
    return energy(spark, d).where("e > 0.5").select("song", F.round(F.col("sec") + F.col("e") / 10, 3).alias("onset"))


def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = materialize(segments.sections(energy(spark, d), "song", song_lengths(spark, d)), "sections")
    return joins.first_section(_beats(spark, d), s, "song", "t").select("song", "i", "kind")


def nearest_onset(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_mark(_beats(spark, d), _onsets(spark, d), "song", "t", "onset", 0.08).select("song", "i", "near")


def tolerance_semi(spark: SparkSession, d: str) -> DataFrame:
    return joins.near_any(_beats(spark, d), _onsets(spark, d), "song", "t", "onset", 0.15).select("song", "i")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order matched by place with its lines in order of price."""
    x = table(spark, d, "lineitem")
    a, b = x.select("l_orderkey", F.col("l_linenumber").alias("line")), x.select("l_orderkey", F.col("l_linenumber").alias("by_price"), "l_extendedprice")
    z = joins.zip_by_place(a, b, "l_orderkey", ["line"], [F.col("l_extendedprice").desc(), "by_price"])
    return z.select("l_orderkey", F.col("place").cast("bigint").alias("place"), "line", "by_price")


def next_slot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("lead(l_linenumber) over (partition by l_orderkey order by l_linenumber)").alias("next_line"))


def curve_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = _cands(spark, d).select("cand_pos", "file", "start_s").join(_clips(spark, d).select("file", "motion"), "file")
    return c.select("cand_pos", joins.at_second(F.col("motion"), F.col("start_s")).alias("motion_at"))


def label_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Camera models that neither hold nor are part of the model of one of the most trusted cameras."""
    c = table(spark, d, "cameras")
    return joins.without_similar_labels(c.select("model").where("model is not null").distinct(), c.where("trust_rank = 1"), "model")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("clip_id", F.lower("signature").alias("signature"), "sharpness")


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.signature_links(_signed(spark, d), "clip_id", "signature", 8).select("a", "b", F.col("bits").cast("bigint").alias("bits"))


def _dup_roots(spark: SparkSession, d: str) -> DataFrame:
    """``(id, root)`` of the clips that have near-duplicates."""
    rows = _signed(spark, d)
    return graph.components(graph.signature_links(rows, "clip_id", "signature", 8).select("a", "b").unionByName(graph.equal_signatures(rows, "clip_id", "signature")))


def dup_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered(_dup_roots(spark, d), "g").select(F.col("id").alias("clip_id"), "root", "label")


def dup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """The clips that have candidates, of near-duplicates the best; roots and scores grow with the clips, so no join is a broadcast."""
    rows = _clips(spark, d).select("clip_id", "file").join(_dup_roots(spark, d).withColumnRenamed("id", "clip_id").hint("merge"), "clip_id", "left")
    x = rows.join(_best(spark, d).hint("merge"), "file").select("clip_id", "file", "root", "score")
    return graph.keep_best(x, "root", "score", "clip_id", "file").select("clip_id", "score")


def signature_distance_matches(spark: SparkSession, d: str) -> DataFrame:
    """Signature distance of the compared clips."""
    s = _signed(spark, d).select("clip_id", "signature")
    m = table(spark, d, "clip_matches").where("clip_a is not null and clip_b is not null").select("clip_a", "clip_b").distinct()
    x = m.join(s.select(F.col("clip_id").alias("clip_a"), F.col("signature").alias("sa")), "clip_a").join(s.select(F.col("clip_id").alias("clip_b"), F.col("signature").alias("sb")), "clip_b")
    return x.select("clip_a", "clip_b", signature_distance(F.col("sa"), F.col("sb")).cast("bigint").alias("bits"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = graph.cosine_links(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 0.40)
    return x.select("a", "b", F.round("cosine", 4).alias("cosine"))


def semantic_components(spark: SparkSession, d: str) -> DataFrame:
    x = graph.cosine_links(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 0.40)
    return graph.numbered(graph.components(x), "s").select(F.col("id").alias("vec_id"), "root", "label")


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    """``(folder, source, file, t, score, suppressed)``: the clips that have candidates, and those that bursts of a day suppress."""
    s = _clips(spark, d).select("folder", "source", "file", F.when(F.col("captured_at").between(1, 4e9), F.col("captured_at")).alias("t")).join(_best(spark, d).hint("merge"), "file")
    return segments.suppress_bursts(s, "folder", "source", "t", "score", 86400.0)


def burst_suppress(spark: SparkSession, d: str) -> DataFrame:
    return _bursts(spark, d).select("folder", "source", "suppressed")


QUERIES = {f.__name__: f for f in (ban_favourite, interval_tag_hit, section_lookup, nearest_onset, tolerance_semi, positional_zip, next_slot, curve_lookup, label_dedup, hamming_pairs, dup_components, dup_keep_best, signature_distance_matches, cosine_pairs, semantic_components, burst_suppress)}


def path_sql(column: str) -> str:
    """SQL for the one spelling of a path column."""
    trimmed = f"trim({column}, chr(32) || chr(9) || chr(10) || chr(13))"
    text = f"case when lower({trimmed}) like 'file:/%' then url_decode(regexp_replace({trimmed}, '^(?i)file:/+', '/')) else replace({trimmed}, '\\', '/') end"
    for pattern in ("/+", r"/(\./)+", r"/[^/]+/\.\./", r"/[^/]+/\.\./"):
        text = f"regexp_replace({text}, '{pattern}', '/', 'g')"
    return f"lower(nfc_normalize({text}))"


_K = f"k as (select *, {path_sql('source')} as file from (select *, row_number() over (partition by cand_pos) as rn_ from candidates where cand_pos is not null) where rn_ = 1)"
_C = f"c as (select *, {path_sql('source')} as file from (select *, row_number() over (partition by clip_id) as rn_ from clips) where rn_ = 1)"
_BEATS = """be as (select song, i, round(i * 0.7, 3) as t from (select song, unnest(range(0, cast(floor(n / 0.7) as bigint) + 1)) as i
  from (select event_type as song, floor(max(epoch(ts - timestamp '2024-01-01 00:00:00')) / 3600) + 1 as n from events group by 1)))"""
_ON = f"{ENERGY_SQL}, ons as (select song, round(sec + e / 10, 3) as onset from en where e > 0.5)"
_BITS = "bit_count(xor(('0x' || {a})::UBIGINT, ('0x' || {b})::UBIGINT))"
_SIG = f"""{_C}, sg as (select lower(signature) as signature, min(clip_id) as k from c where regexp_full_match(lower(signature), '[0-9a-f]{{16}}(:[0-9a-f]{{16}})*') group by 1),
fr as (select distinct k, unnest(string_split(signature, ':')) as f from sg), hp as (select x.k as a, y.k as b, min({_BITS.format(a='x.f', b='y.f')}) as bits from fr x join fr y on x.k < y.k where {_BITS.format(a='x.f', b='y.f')} <= 8 group by 1, 2)"""
_SIG = _SIG.replace("with ", "")
_DUP = f"""{_SIG}, ed as (select a, b from hp union select s.k, c.clip_id from sg s join c on lower(c.signature) = s.signature where c.clip_id <> s.k), two as (select a, b from ed union select b, a from ed),
cc(id, r) as (select a, a from two union select t.b, cc.r from cc join two t on t.a = cc.id), ro as (select id, min(r) as root from cc group by 1)"""
_VE = "e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings), cp as (select x.vec_id as a, y.vec_id as b, list_inner_product(x.v, y.v) / x.n / y.n as cosine from e x join e y on x.vec_id < y.vec_id where list_inner_product(x.v, y.v) / x.n / y.n >= 0.40)"

SQL = {
    "ban_favourite": f"with {_K}, {_C}, j as (select k.cand_pos, k.file, case when not isnan(k.score) then k.score end as score, k.reasons, {path_sql('c.origin')} as origin from k left join c on k.file = c.file), bn as (select distinct file from j where list_contains(reasons, 'blurry') and score < 0), lk as (select distinct file from j where list_contains(reasons, 'user_favorite')) select cand_pos, j.file, round(score + case when lk.file is not null then 2.0 else 0 end, 6) as score from j left join lk on j.file = lk.file where not exists (select 1 from bn where bn.file = j.file or bn.file = j.origin)",
    "interval_tag_hit": f"with {_K}, {_C} select k.cand_pos, coalesce(len(list_filter(c.tags_ms, lambda x: x >= k.start_s * 1000 and x <= k.end_s * 1000)) > 0, false) as hit from k join c on k.file = c.file",
    "section_lookup": f"with {SECTIONS_SQL}, {_BEATS} select be.song, be.i, coalesce(arg_min(se.kind, se.section_pos), 'verse') as kind from be left join se on se.song = be.song and be.t >= se.start_s and be.t < se.end_s group by 1, 2",
    "nearest_onset": f"with {_ON}, {_BEATS}, m as (select be.song, be.i, o.onset, row_number() over (partition by be.song, be.i order by abs(be.t - o.onset), o.onset) as r from be left join ons o on o.song = be.song and abs(be.t - o.onset) < 0.08) select song, i, onset as near from m where r = 1",
    "tolerance_semi": f"with {_ON}, {_BEATS} select song, i from be where exists (select 1 from ons o where o.song = be.song and abs(be.t - o.onset) < 0.15)",
    "positional_zip": "with a as (select l_orderkey, l_linenumber as line, row_number() over (partition by l_orderkey order by l_linenumber) as place from lineitem), b as (select l_orderkey, l_linenumber as by_price, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as place from lineitem) select a.l_orderkey, a.place, line, by_price from a join b on a.l_orderkey = b.l_orderkey and a.place = b.place",
    "next_slot": "select l_orderkey, l_linenumber, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) as next_line from lineitem",
    "curve_lookup": f"with {_K}, {_C} select k.cand_pos, c.motion[least(cast(floor(k.start_s) as int), len(c.motion) - 1) + 1] as motion_at from k join c on k.file = c.file",
    "label_dedup": "select distinct model from cameras m where model is not null and not exists (select 1 from cameras t where t.trust_rank = 1 and (contains(lower(m.model), lower(t.model)) or contains(lower(t.model), lower(m.model))))",
    "hamming_pairs": f"with {_SIG} select a, b, bits::bigint as bits from hp",
    "dup_components": f"with recursive {_DUP} select id as clip_id, root, 'g' || dense_rank() over (order by root) as label from ro",
    "dup_keep_best": f"with recursive {_DUP}, {_K}, bs as (select file, max(score) as score from k where not isnan(score) group by 1), x as (select c.clip_id, c.file, ro.root, bs.score from c left join ro on ro.id = c.clip_id join bs on bs.file = c.file), y as (select *, first_value(file) over (partition by root order by score desc, clip_id) as o from x) select clip_id, score from y where root is null or file = o",
    "signature_distance_matches": f"""with {_C}, s as (select clip_id, lower(signature) as g from c), m as (select distinct clip_a, clip_b from clip_matches where clip_a is not null and clip_b is not null),
      p as (select m.clip_a, m.clip_b, unnest(coalesce(string_split(x.g, ':'), [''])) as f, y.g as h from m join s x on x.clip_id = m.clip_a join s y on y.clip_id = m.clip_b),
      q as (select clip_a, clip_b, f, unnest(coalesce(string_split(h, ':'), [''])) as h from p)
      select clip_a, clip_b, min(case when regexp_full_match(f, '[0-9a-f]{{16}}') and regexp_full_match(h, '[0-9a-f]{{16}}') then {_BITS.format(a="case when regexp_full_match(f, '[0-9a-f]{16}') then f else '0' end", b="case when regexp_full_match(h, '[0-9a-f]{16}') then h else '0' end")} else 64 end)::bigint as bits from q group by 1, 2""",
    "cosine_pairs": f"with {_VE} select a, b, round(cosine, 4) as cosine from cp",
    "semantic_components": f"with recursive {_VE}, two as (select a, b from cp union select b, a from cp), cc(id, r) as (select a, a from two union select t.b, cc.r from cc join two t on t.a = cc.id), ro as (select id, min(r) as root from cc group by 1) select id as vec_id, root, 's' || dense_rank() over (order by root) as label from ro",
    "burst_suppress": f"""with {_K}, {_C}, bs as (select file, max(score) as score from k where not isnan(score) group by 1), s as (select c.folder, c.source, case when captured_at between 1 and 4e9 then captured_at end as t, bs.score from c join bs on bs.file = c.file),
      g as (select *, sum(case when t - p <= 86400 then 0 else 1 end) over (partition by folder order by t, source) as ses from (select *, lag(t) over (partition by folder order by t, source) as p from s where t is not null)),
      r as (select *, row_number() over (partition by folder, ses order by score desc, t, source) > 1 as lost from g), m as (select folder, count(*) as n, avg(case when lost then 1.0 else 0 end) as sh from r group by 1)
      select s.folder, s.source, coalesce(r.lost and not (m.n >= 3 and m.sh > 0.5), false) as suppressed from s left join r on r.folder = s.folder and r.source = s.source left join m on m.folder = s.folder""",
}
