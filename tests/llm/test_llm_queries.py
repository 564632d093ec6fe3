"""The queries against their SQL, and hostile inputs: nulls, repeats, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import caps, clusters, links, mixing, neighbours, packing, pii, queries, survivors, tokens


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, same, name):
    rows = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name]).df()
        assert sorted(want.columns) == sorted(rows.columns)
        assert same(rows) == same(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("clips", "cameras", "candidates", "clip_matches", "documents", "mix_targets", "signals"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert not rows or name == "p7_fill" or (name in ("p7_checks", "p8_checks") and not any(r.n for r in rows))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_repeats_and_extra_columns(spark, sf, tmp_path, same, name):
    """Every row twice, with columns named like the operators' own, gives the same rows."""
    for t in ("clips", "cameras", "candidates", "clip_matches", "documents", "mix_targets"):
        x = spark.read.parquet(f"{sf}/{t}.parquet")
        if t not in ("mix_targets", "cameras"):
            x = x.unionByName(x)
        for extra in ("id", "vec", "cell", "group", "rep", "rank", "file", "number", "tokens", "size", "bin", "n", "v", "u", "a", "b"):
            x = x.withColumn(extra, F.lit("x"))
        x.write.parquet(str(tmp_path / f"{t}.parquet"))
    assert same(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == same(queries.QUERIES[name](spark, sf).toPandas()) or name == "p9_redacted"


def test_nulls_everywhere(spark):
    clips = spark.createDataFrame([(None, None, None, None), (1, None, None, None), (None, "f", "0" * 16, [1.0] * 96), (2, "f", None, [None] * 96), (3, "f", "zz", [1.0] * 95 + [float("nan")])], "clip_id bigint, folder string, signature string, embedding array<double>")
    assert clusters.clusters_with_signatures(clips).count() == 0
    assert neighbours.nearest(clips, "clip_id", "embedding", 96).count() == 0
    m = spark.createDataFrame([(None, 1, "phash", 0, None), (1, None, "phash", 0, None), (1, 1, "phash", 0, None), (1, 2, None, 0, 1.0), (1, 2, "phash", None, 1.0), (1, 2, "semantic", None, float("nan"))], "clip_a bigint, clip_b bigint, method string, distance int, cosine double")
    assert links.hash_to_min(links.matching_pairs(m)).count() == 0
    c = spark.createDataFrame([(None, "a", 1.0), (1, None, None), (2, None, float("nan")), (3, None, 0.5)], "cand_pos bigint, file string, score double")
    assert [r.cand_pos for r in caps.cap_contributors(c, "file", "score", "cand_pos", 1).collect()] == [3]
    d = spark.createDataFrame([(None, "x"), (1, None), (2, "")], "doc_id bigint, text string")
    assert pii.personal_spans(d, "doc_id", "text").count() == 0
    assert sorted((r.doc_id or 0, r.text) for r in pii.redacted(d, "doc_id", "text").collect()) == [(0, "x"), (1, None), (2, "")]
    sized = tokens.with_token_counts(d, "text")
    assert sorted(r.tokens for r in sized.collect()) == [0, 0, 1]
    assert packing.pack(sized, "doc_id", "tokens", 4).count() == 0
    t = spark.createDataFrame([(None, 0.5, 1), ("s", None, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(sized.withColumn("source", F.lit(None).cast("string")), t, "doc_id", "source", "tokens")
    assert mixed.count() == 0 and report.count() == 0
    r = spark.createDataFrame([(None, 1, None)], "g string, i bigint, x double")
    assert survivors.surviving_fields(r, ["g"], {"x": F.col("x") > 0}, [F.col("i")], "i").count() == 0
