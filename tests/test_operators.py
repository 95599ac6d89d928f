from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks.config import DROP, UNKNOWN, ZERO, CleanOptions, Limits
from siltworks.operators import columns, impute, outliers, profile, quality, rows, semantic, similarity, stats
from siltworks.operators.common import ROW_ID, nan_to_null
from siltworks.plans import pipeline
from siltworks.plans.report import before_after, comparison, preview, text_report
from siltworks.sources.demo import demo

SCHEMA = f"{ROW_ID} long, a long, b string, c double, d string, e double"
ROWS = [(0, 1, "x", 1.5, None, 1.5), (1, 1, "x", 1.5, None, 1.5), (2, None, None, None, None, None), (3, 2, "y", None, None, None), (4, 3, "x", 2.0, None, 2.0), (5, 1, "x", 1.5, None, 1.5)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r[ROW_ID] for r in df.collect())


def test_rows(df):
    assert ids(rows.drop_empty_rows(df)) == [0, 1, 3, 4, 5]
    assert ids(rows.dedupe_keep_first(df)) == [0, 2, 3, 4]
    assert ids(rows.exact_duplicates(df)) == [1, 5]
    assert tuple(rows.duplicate_count(df).first()) == (6, 2)
    assert ids(rows.drop_incomplete_rows(df.drop("d"))) == [0, 1, 4, 5]
    assert ids(rows.dedupe_keep_first(df, subset=["b"])) == [0, 2, 3]


def test_columns(df, spark):
    assert columns.empty_columns(df) == ["d"]
    assert columns.duplicate_columns(df) == ["e"]
    assert columns.constant_columns(df) == ["d"]
    assert columns.empty_columns(df.where("false")) == ["a", "b", "c", "d", "e"]
    one = df.limit(1)
    assert columns.remove_constant_columns(one)[1] == 5
    mixed = spark.createDataFrame([(0, 1, 1.0)], f"{ROW_ID} long, i long, f double")
    assert columns.duplicate_columns(mixed) == []


def test_fill(df, spark):
    got, n = impute.fill(df)
    r = {x[ROW_ID]: x for x in got.collect()}
    assert n == 1 + 1 + 2 + 6 + 2 and r[2].a == 1.0 and r[2].b == "x" and r[3].c == 1.5 and r[2].d == "Unknown"
    got, n = impute.fill(df, ZERO)
    r = {x[ROW_ID]: x for x in got.collect()}
    assert n == 12 and r[2].b == "0" and r[2].a == 0 and r[3].c == 0.0
    got, _ = impute.fill(df, UNKNOWN)
    assert dict(got.dtypes)["c"] == "string" and got.where("c = 'Unknown'").count() == 2
    got, n = impute.fill(df.drop("d"), DROP)
    assert n == 2 and got.count() == 4
    assert impute.fill(df.select(ROW_ID, "a").where("a = 1"))[1] == 0
    ties = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], f"{ROW_ID} long, t string")
    assert impute.fill(ties)[0].where(f"{ROW_ID} = 2").first().t == "a"


def test_quantiles_by_brackets(spark):
    random.seed(3)
    values = [float(random.randint(0, 50)) for _ in range(700)] + [random.gauss(0, 100) for _ in range(900)] + [float("inf"), float("nan"), None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    clean = pd.Series([v for v in values if v is not None and abs(v) < float("inf")])
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    want = clean.quantile(probs).tolist()
    assert stats.quantiles(frame, ["v"], probs)["v"] == pytest.approx(want)
    assert stats.quantiles(frame, ["v"], probs, direct_rows=50)["v"] == pytest.approx(want)


def test_stats(df):
    missing = {r.column: (r.missing, r.missing_pct) for r in stats.null_profile(df).collect()}
    assert missing["c"] == (2, 33.33) and missing["d"] == (6, 100.0)
    assert [r.column for r in stats.missing_table(df).collect()] == ["d", "c", "e", "a", "b"]
    assert {r.column: r.distinct for r in stats.distinct_counts(df).collect()} == {"a": 3, "b": 2, "c": 2, "d": 0, "e": 2}
    assert {r.column: r.sample for r in stats.samples(df).collect()}["b"] == ["x", "x", "y"]


def test_outliers(spark):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100, float("inf"), float("nan")])], f"{ROW_ID} long, v double")
    assert outliers.iqr(frame, "v") == {"count": 1, "lower": -1.0, "upper": 7.0, "values": [100.0]}
    few = frame.limit(3)
    assert outliers.iqr(few, "v")["lower"] is None and "mean" not in outliers.zscore(few, "v")
    same = spark.createDataFrame([(i, 5.0) for i in range(6)], f"{ROW_ID} long, v double")
    assert outliers.iqr(same, "v") == {"count": 0, "lower": 5.0, "upper": 5.0, "values": []}
    assert outliers.zscore(same, "v")["std"] == 0.0
    wide = spark.createDataFrame([(i, float(i % 5)) for i in range(50)] + [(50, 99.0)], f"{ROW_ID} long, v double")
    z = outliers.zscore(wide, "v", threshold=-2)
    assert z["count"] == 1 and z["values"] == [99.0] and z["threshold"] == 3.0
    assert list(outliers.all_outliers(wide)) == ["v"]
    odd = frame.unionByName(spark.createDataFrame([(90, None)], f"{ROW_ID} long, v double"))
    assert [r.v for r in outliers.iqr_rows(odd, "v").collect()] == [100.0] and outliers.zscore_rows(odd, "v").count() == 0
    assert [r.v for r in outliers.zscore_rows(wide, "v").collect()] == [99.0]
    assert outliers.iqr_rows(same, "v").count() == outliers.zscore_rows(same, "v").count() == outliers.iqr_rows(few, "v").count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzzy(spark):
    random.seed(5)
    names = ["maria  lopez", "Lopez Maria", "marla lopez", "jon smith", "john smith", None, "", "jon smith", "a" * 70 + " b", "a" * 69 + " b c", "é ü", "e u"]
    names += ["".join(random.choice("abc ") for _ in range(random.randint(1, 14))) for _ in range(40)]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{ROW_ID} long, name string")
    for t in (0.95, 0.85, 0.6, 0.3, 0):
        got = {(r.index_a, r.index_b): r.similarity for r in similarity.fuzzy_pairs(frame, ["name"], t).collect()}
        keys = {i: " ".join(n.lower().split()) for i, n in enumerate(names) if n and n.strip()}
        want = {}
        for i, x in keys.items():
            for j, y in keys.items():
                if i < j and x != y:
                    p, q = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
                    s = 2 * plain_lcs(p, q) / (len(p) + len(q))
                    if s >= t - 1e-12:
                        want[i, j] = s
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 6e-4 for k in got)
    assert similarity.fuzzy_pairs(frame, ["name"], 0.9, limits=Limits(max_fuzzy_rows=3)) is None
    assert similarity.fuzzy_pairs(frame, ["name"], 0.5, limits=Limits(max_fuzzy_pairs=2)).count() == 2
    with pytest.raises(ValueError):
        similarity.fuzzy_pairs(frame, ["name"], 2)
    with pytest.raises(ValueError):
        similarity.fuzzy_pairs(frame, ["nothing"])


def test_fuzzy_meets_only_links(spark):
    names = [f"Supplier#{i:09d}" for i in range(0, 60000, 23)]
    frame = spark.createDataFrame(list(enumerate(names)), f"{ROW_ID} long, name string")
    near = {}
    for i, x in enumerate(names):
        for p in range(9, 18):
            near.setdefault(x[:p] + x[p + 1 :], set()).add(i)
    want = {(i, j) for ids in near.values() for i in ids for j in ids if i < j}
    got = [(r.index_a, r.index_b, r.similarity) for r in similarity.fuzzy_pairs(frame, ["name"], 0.9, ordered=False).collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want and {g[2] for g in got} == {0.944}
    lengths = similarity.lengths_that_meet(spark.createDataFrame([(18,)], "n int"), 0.9)
    assert [tuple(r) for r in lengths] == [(18, 1, False)]
    keys = frame.selectExpr("0 AS block", "lower(name) AS key", "lower(name) AS sorted", "18 AS n", "1 AS cut")
    parts = similarity.subsequences(keys, 1).where("length(part) = 17").groupBy("part").count()
    assert parts.selectExpr("sum(count * (count - 1) DIV 2)").first()[0] < 2 * len(want)


def test_fuzzy_lengths(spark):
    random.seed(8)
    names = ["".join(random.choice("aab ") for _ in range(n)) + "x" * k + "y" * (n % 3) for n in (3, 9, 14, 18) for k in (0, 3, 14, 17, 30, 90) for _ in range(2)]
    names += [n[:-1] for n in names] + [n + "é" for n in names[:20]]
    frame = spark.createDataFrame(list(enumerate(names)), f"{ROW_ID} long, name string")
    keys = [" ".join(n.lower().split()) for n in names]
    for t in (0.97, 0.93, 0.8):
        got = {(r.index_a, r.index_b): r.similarity for r in similarity.fuzzy_pairs(frame, ["name"], t).collect()}
        want = {}
        for i, x in enumerate(keys):
            for j in range(i + 1, len(keys)):
                p, q = " ".join(sorted(x.split())), " ".join(sorted(keys[j].split()))
                if x and keys[j] and x != keys[j] and 2 * min(len(p), len(q)) >= t * (len(p) + len(q)) - 1e-9:
                    s = 2 * plain_lcs(p, q) / (len(p) + len(q))
                    if s >= t - 1e-12:
                        want[i, j] = s
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 6e-4 for k in got)


def test_fuzzy_copies(spark):
    frame = spark.range(3700).selectExpr(f"id AS {ROW_ID}", "CASE WHEN id % 37 < 24 THEN 'large ring brand#7' WHEN id % 37 < 36 THEN 'large ring brand#8' ELSE 'old' END AS name")
    got = similarity.fuzzy_pairs(frame, ["name"], 0.93, ordered=False)
    assert "Sort [similarity" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.selectExpr("count(*) AS n", "count(DISTINCT index_a, index_b) AS d", "min(index_b - index_a) AS least", "count_if((index_a % 37 < 24) = (key_a LIKE '%7') AND (index_b % 37 < 24) = (key_b LIKE '%7') AND key_a <> key_b) AS fit").first()
    assert (r.n, r.d, r.fit) == (2400 * 1200,) * 3 and r.least > 0


def test_semantic(spark):
    frame = spark.createDataFrame(
        [(i, i + 1, f"u{i}@x.org", f"2024-01-{i % 28 + 1:02d}", "red" if i % 2 else "blue", i * 1000.5, f"text number {i}", None, f"{i}%", f"https://x.org/{i}") for i in range(40)],
        f"{ROW_ID} long, n long, contact string, seen string, colour string, salary double, note string, nothing string, part string, page string",
    )
    got = semantic.semantic_types(frame)
    assert got == {"n": "id", "contact": "email", "seen": "date", "colour": "categorical", "salary": "currency", "note": "text", "nothing": "unknown", "part": "percentage", "page": "url"}
    assert semantic.type_groups(got)["email"] == ["contact"]


def test_profile_and_quality(df, spark):
    p = profile.profile(df)
    assert (p["rows"], p["columns"], p["duplicate_rows"], p["empty_cols"], p["constant_cols"]) == (6, 5, 2, ["d"], ["d"])
    assert p["dup_col_groups"] == [["c", "e"]] and p["warnings"] and p["recommendations"]
    r = quality.analyze(df)
    assert r.stats["missing_cells"] == 12 and r.categories["completeness"] == 60 and r.categories["uniqueness"] == 66
    assert r.issues[0].severity == "HIGH" and r.high_priority and r.label in ("Good", "Needs Attention")
    assert quality.analyze(df.where("false")).score == 100
    assert quality.issues_table(df).count() == len(r.issues)
    keyed = spark.createDataFrame([(i, min(i, 98)) for i in range(100)], f"{ROW_ID} long, user_id long")
    assert quality.analyze(keyed).categories["validity"] == 90


def test_pipeline(spark):
    raw = demo(spark).withColumnRenamed("notes", " notes ")
    ticks = []
    options = CleanOptions(normalize_emails=True, normalize_dates=True, normalize_phones=True, email_columns=(" email",), date_columns=("signup_date",), phone_columns=("phone",), snake_case=True)
    out, report = pipeline.clean(raw, options, lambda f, m: ticks.append(f))
    assert report["rows_before"] == 7 and report["rows_after"] == out.count() == 7
    assert report["headers_stripped"] == 1 and "notes" in out.columns
    assert report["emails_normalized"] == 0 or report["emails_normalized"] == 1
    assert report["dates_normalized"] == 2 and report["spaces_trimmed"] >= 2
    assert report["missing_count_after"] == 0 and out.where("salary IS NULL").count() == 0
    assert ticks == sorted(ticks) and ticks[-1] == 1.0
    assert raw.count() == 7  # the input is as it was
    with pytest.raises(TypeError):
        pipeline.clean([1, 2])
    assert "rows" in text_report(report, "x.csv", raw, out)
    assert comparison(out, report).count() == 6
    assert before_after(raw, out).count() == 6
    equal = spark.createDataFrame([(i, i % 2, None if i == 3 else "v", i % 2, None if i == 3 else "v", "k") for i in range(6)], f"{ROW_ID} long, a long, b string, c long, d string, e string")
    kept, said = pipeline.clean(equal, CleanOptions(remove_const_cols=True))
    assert kept.columns == [ROW_ID, "a"] and said["dup_cols_removed"] == 2 and said["const_cols_removed"] == 2 and said["duplicates_removed"] == 3 and said["missing_count_before"] == 2
    assert preview(out, 2).count() == 2


def test_semantic_types_feed_the_pipeline(spark):
    types = {"mail": "email", "tel": "phone", "born": "date", "x": "text", "other": "email"}
    got = pipeline.with_semantic_columns(CleanOptions(normalize_emails=True, phone_columns=("mine",)), types)
    assert got.email_columns == ("mail", "other") and got.phone_columns == ("mine",) and got.date_columns == ("born",) and got.normalize_emails


def test_row_ids_follow_file_order(spark, tmp_path):
    from siltworks.operators.common import with_row_id

    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/x")
    rows = with_row_id(spark.read.parquet(f"{tmp_path}/x")).collect()
    assert sorted(r[ROW_ID] for r in rows) == list(range(1000)) and len({r[ROW_ID] - r.id for r in rows if r.id < 100}) <= 2
    assert with_row_id(spark.range(0)).count() == 0 and with_row_id(spark.range(3)).columns == [ROW_ID, "id"]


def test_pipeline_edges(spark):
    empty = spark.createDataFrame([], f"{ROW_ID} long, a long, b string")
    out, report = pipeline.clean(empty)
    assert out.count() == 0 and report["rows_after"] == 0
    nan = nan_to_null(spark.createDataFrame([(0, float("nan"), 1), (1, 2.0, 2)], f"{ROW_ID} long, x double, y long"))
    assert pipeline.clean(nan)[1]["missing_filled"] == 1
    twins = spark.createDataFrame([(0, 1, 2)], f"{ROW_ID} long, `a` long, ` a` long")
    assert len(pipeline.clean(twins, CleanOptions(remove_dup_cols=False))[0].columns) == 3
    dropped, report = pipeline.clean(spark.createDataFrame([(0, 1, None), (1, 2, "x")], f"{ROW_ID} long, a long, b string"), CleanOptions(fill=DROP))
    assert dropped.count() == 1 and report["missing_dropped_rows"] == 1


def test_streaming(spark, tmp_path):
    from siltworks.streaming.clean import clean_cells

    data = str(tmp_path / "in")
    spark.createDataFrame([(1, "  a  b "), (2, " ")], "id long, t string").write.parquet(data)
    stream = clean_cells(spark.readStream.schema("id long, t string").parquet(data))
    q = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("cleaned").collect()} == {(1, "a b"), (2, None)}


def test_plans_push_down(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("x").alias("s"), F.lit(1.0).alias("v")).write.parquet(at)
    plan = spark.read.parquet(at).where("id > 5").agg(F.avg("v"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan and "ReadSchema: struct<id:bigint,v:double>" in plan
