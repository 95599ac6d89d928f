"""The catalogue: one query per operator over the test tables, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DATE_TARGETS, DROP, UNKNOWN, ZERO, CleanOptions
from .functions import headers, numbers, text
from .operators import columns, impute, outliers, profile, quality, rows, semantic, similarity, stats
from .operators.common import ROW_ID
from .plans import pipeline, report
from .sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A dirty view of customer, in SQL that both engines run. row_id is bookkeeping.
DIRTY = """SELECT c_custkey AS row_id, c_custkey,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN concat('  ', c_mktsegment, '   X ')
      WHEN c_custkey % 11 = 0 THEN '   ' ELSE c_mktsegment END AS seg,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS bal,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS bal_copy,
 CASE WHEN c_custkey % 3 = 0 THEN concat(' USER', cast(c_custkey AS string), '@MAIL.COM ')
      WHEN c_custkey % 3 = 1 THEN concat('user', cast(c_custkey AS string), '_at_mail')
      ELSE concat('u.', cast(c_custkey AS string), '@x.org') END AS email,
 CASE WHEN c_custkey % 2 = 0 THEN concat('+1 (555) ', lpad(cast(c_custkey AS string), 7, '0')) ELSE 'none' END AS phone,
 CASE c_custkey % 4 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '15/01/2024' WHEN 2 THEN 'Feb 3 2024' ELSE 'n/a' END AS dt,
 'x' AS const_col, cast(NULL AS string) AS empty_col
FROM customer"""
#: Few columns, with repeated and empty rows appended.
REPEATED = """SELECT c_custkey AS row_id, c_nationkey AS nat, c_mktsegment AS seg, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer
UNION ALL SELECT 1000000 + c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT 2000000 + c_custkey, cast(NULL AS int), cast(NULL AS string), cast(NULL AS double) FROM customer WHERE c_custkey % 17 = 0"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")).withColumnRenamed("row_id", ROW_ID)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY)


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REPEATED)


D, R = f"WITH d AS ({DIRTY}) ", f"WITH d AS ({REPEATED}) "
SQL_TRIM = r"nullif(trim(regexp_replace({0}, '\s+', ' ', 'g')), '')"
SQL_EMAIL = r"regexp_full_match(lower(trim({0})), '[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{{2,}}')"
SQL_DATE = "coalesce(CASE WHEN {0} LIKE '____-%' THEN try_strptime({0}, '%Y-%m-%d') END, try_strptime({0}, '%d/%m/%Y'), try_strptime({0}, '%m/%d/%Y'), try_strptime({0}, '%b %d %Y'))"


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("trim_whitespace", D + f"SELECT c_custkey, {SQL_TRIM.format('seg')} AS seg FROM d")
def _(s, d):
    return dirty(s, d).select("c_custkey", text.trim_spaces(F.col("seg")).alias("seg"))


@query("normalize_email", D + f"SELECT c_custkey, CASE WHEN {SQL_EMAIL.format('email')} THEN lower(trim(email)) ELSE email END AS email FROM d")
def _(s, d):
    return dirty(s, d).select("c_custkey", text.normalize_email(F.col("email")).alias("email"))


@query("invalid_email_flag", D + f"SELECT c_custkey, email IS NOT NULL AND NOT {SQL_EMAIL.format('email')} AS invalid FROM d")
def _(s, d):
    return dirty(s, d).select("c_custkey", text.invalid_email(F.col("email")).alias("invalid"))


@query("normalize_phone", D + r"SELECT c_custkey, CASE WHEN regexp_replace(phone, '[^\d]', '', 'g') = '' THEN phone ELSE concat(CASE WHEN trim(phone) LIKE '+%' THEN '+' ELSE '' END, regexp_replace(phone, '[^\d]', '', 'g')) END AS phone FROM d")
def _(s, d):
    return dirty(s, d).select("c_custkey", text.normalize_phone(F.col("phone")).alias("phone"))


for _i, _target in enumerate(DATE_TARGETS):

    @query(f"normalize_date_{('iso', 'dmy_slash', 'mdy_slash', 'dmy_dash')[_i]}", D + f"SELECT c_custkey, coalesce(strftime({SQL_DATE.format('dt')}, '{_target}'), dt) AS dt FROM d")
    def _(s, d, target=_target):
        return dirty(s, d).select("c_custkey", text.normalize_date(F.col("dt"), target).alias("dt"))


@query("mojibake_repair", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ' café') ELSE c_name END AS fixed FROM customer")
def _(s, d):
    broken = F.concat(F.col("c_name"), F.lit(" cafÃ©"))
    return table(s, d, "customer").select("c_custkey", text.fix_encoding(F.when(F.col("c_custkey") % 2 == 0, broken).otherwise(F.col("c_name"))).alias("fixed"))


@query("changed_cells", D + f"SELECT count(*) FILTER (WHERE seg IS DISTINCT FROM {SQL_TRIM.format('seg')}) AS trimmed, count(*) FILTER (WHERE {SQL_EMAIL.format('email')} AND email <> lower(trim(email))) AS emails FROM d")
def _(s, d):
    seg, email = F.col("seg"), F.col("email")
    return dirty(s, d).agg(F.count_if(text.changed(seg, text.trim_spaces(seg))).alias("trimmed"), F.count_if(text.changed(email, text.normalize_email(email))).alias("emails"))


@query("snake_case_values", r"SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(concat(p_name, ' ', p_type, '-', p_brand)), '[\s\-]+', '_', 'g'), '[^\w]', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_+', '_', 'g')), '_') AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", text.snake_case(F.concat_ws("-", F.concat_ws(" ", "p_name", "p_type"), "p_brand")).alias("name"))


@query("fuzzy_keys", D + r"SELECT c_custkey, concat_ws(' | ', coalesce(trim(regexp_replace(lower(seg), '\s+', ' ', 'g')), ''), trim(regexp_replace(lower(email), '\s+', ' ', 'g'))) AS key FROM d")
def _(s, d):
    return dirty(s, d).select("c_custkey", text.fuzzy_key(F.col("seg"), F.col("email")).alias("key"))


SQL_SHAPES = r"""avg(CASE WHEN regexp_full_match(trim({0}), '[-+]?\d+(\.\d+)?([eE][-+]?\d+)?') THEN 1.0 ELSE 0.0 END) AS number_ratio,
 avg(CASE WHEN regexp_full_match(trim({0}), '\+?[\d]{{1,4}}[-.\s]?\(?\d{{2,4}}\)?[-.\s]?\d{{2,4}}[-.\s]?\d{{2,6}}') AND length(regexp_replace({0}, '[^\d]', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_full_match(trim({0}), '\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN 1.0 ELSE 0.0 END) AS phone_ratio,
 avg(CASE WHEN regexp_matches({0}, '(\d{{4}}[-/]\d{{2}}[-/]\d{{2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s,]+\d)') THEN 1.0 ELSE 0.0 END) AS date_ratio"""


@query("match_ratios", D + ", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {SQL_SHAPES.format(c)} FROM d WHERE {c} IS NOT NULL" for c in ("phone", "dt")) + ") SELECT name, round(number_ratio, 6) AS number_ratio, round(phone_ratio, 6) AS phone_ratio, round(date_ratio, 6) AS date_ratio FROM x")
def _(s, d):
    df = dirty(s, d)
    tests = {"number_ratio": text.looks_number, "phone_ratio": lambda c: text.looks_phone(c), "date_ratio": text.has_date}
    cells = [F.struct(F.lit(c).alias("name"), *[F.round(stats.match_ratio(t(F.col(c)), F.col(c)), 6).alias(n) for n, t in tests.items()]) for c in ("phone", "dt")]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


@query("readable_sizes", "SELECT o_orderkey, CASE WHEN v >= 1073741824 THEN printf('%.2f GB', v / 1073741824.0) WHEN v >= 1048576 THEN printf('%.2f MB', v / 1048576.0) WHEN v >= 1024 THEN printf('%.1f KB', v / 1024.0) ELSE printf('%d B', CAST(v AS BIGINT)) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey AS v FROM orders)")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", numbers.readable_size_col(F.col("o_orderkey") * F.col("o_orderkey")).alias("size"))


@query("score_bands", "SELECT c_custkey, CAST(floor(least(greatest(c_acctbal / 100, 0), 100)) AS BIGINT) AS score, CASE WHEN floor(least(greatest(c_acctbal / 100, 0), 100)) >= 90 THEN 'Excellent' WHEN floor(least(greatest(c_acctbal / 100, 0), 100)) >= 70 THEN 'Good' WHEN floor(least(greatest(c_acctbal / 100, 0), 100)) >= 50 THEN 'Needs Attention' ELSE 'Poor' END AS label FROM customer")
def _(s, d):
    score = numbers.clamp_col(F.col("c_acctbal") / 100)
    return table(s, d, "customer").select("c_custkey", score.alias("score"), numbers.score_label_col(score).alias("label"))


@query("value_shapes", r"""WITH v AS (SELECT page_id AS i, url AS u, CASE WHEN page_id % 3 = 0 THEN concat('$', page_id * 1000, '.50') ELSE concat(page_id, ' EUR') END AS c, CASE WHEN page_id % 4 < 3 THEN concat(page_id, '.5 %') ELSE url END AS p, CASE WHEN page_id % 2 = 0 THEN concat('u', page_id, '@x.org') ELSE concat('u', page_id, '@x') END AS e FROM pages)
SELECT round(avg(regexp_matches(trim(u), '^(https?://|www\.)', 'i')::INT), 6) AS url_ratio, round(avg(regexp_full_match(trim(c), '[\$€£¥₹]?\s?\d[\d,]*(\.\d{1,4})?')::INT), 6) AS currency_ratio,
 round(avg(regexp_full_match(trim(p), '\d+\.?\d*\s?%')::INT), 6) AS percent_ratio, round(avg(regexp_full_match(trim(e), '[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}')::INT), 6) AS email_ratio FROM v""")
def _(s, d):
    i = F.col("page_id")
    money = F.when(i % 3 == 0, F.concat(F.lit("$"), (i * 1000).cast("string"), F.lit(".50"))).otherwise(F.concat(i.cast("string"), F.lit(" EUR")))
    part = F.when(i % 4 < 3, F.concat(i.cast("string"), F.lit(".5 %"))).otherwise(F.col("url"))
    mail = F.concat(F.lit("u"), i.cast("string"), F.when(i % 2 == 0, "@x.org").otherwise("@x"))
    tests = {"url_ratio": (text.looks_url, F.col("url")), "currency_ratio": (text.looks_currency, money), "percent_ratio": (text.looks_percent, part), "email_ratio": (text.looks_email, mail)}
    return table(s, d, "pages").agg(*[F.round(stats.match_ratio(test(v), v), 6).alias(n) for n, (test, v) in tests.items()])


@query("header_names", "SELECT * FROM (VALUES (0, 'Order ID', 'order_id'), (1, 'orderId', 'order_id_2'), (2, 'ORDER-id', 'order_id_3'), (3, 'Total ($)', 'total'), (4, '', 'column'), (5, 'column_2', 'column_2')) t(position, header, name)")
def _(s, d):
    names = [" Order ID", "orderId ", "ORDER-id", "Total ($)", " ", "column_2"]
    bare, _ = headers.strip_headers(s.createDataFrame([], ", ".join(f"`{x}` int" for x in names)))
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bare.columns, headers.normalize_headers(bare)[0].columns, strict=True))], "position int, header string, name string")


# --- rows and columns ---------------------------------------------------------------------------------------------


@query("drop_empty_rows", R + "SELECT nat, seg, bal FROM d WHERE NOT (nat IS NULL AND seg IS NULL AND bal IS NULL)")
def _(s, d):
    return rows.drop_empty_rows(repeated(s, d)).drop(ROW_ID)


@query("drop_any_null", R + "SELECT row_id, nat, seg, bal FROM d WHERE nat IS NOT NULL AND seg IS NOT NULL AND bal IS NOT NULL")
def _(s, d):
    return rows.drop_incomplete_rows(repeated(s, d)).withColumnRenamed(ROW_ID, "row_id")


@query("column_verdicts", D + "SELECT * FROM (VALUES ('seg', false, false, false), ('bal', false, false, false), ('bal_copy', false, true, false), ('email', false, false, false), ('phone', false, false, false), ('dt', false, false, false), ('const_col', false, false, true), ('empty_col', true, false, true), ('c_custkey', false, false, false)) t(name, is_empty, is_duplicate, is_constant) WHERE (SELECT count(*) FROM d) > 0")
def _(s, d):
    df = dirty(s, d)
    e, c, k = columns.empty_columns(df), columns.duplicate_columns(df), columns.constant_columns(df)
    names = [x for x in df.columns if x != ROW_ID]
    return s.createDataFrame([(x, x in e, x in c, x in k) for x in names], "name string, is_empty boolean, is_duplicate boolean, is_constant boolean")


@query("duplicate_columns", D + "SELECT bool_and(bal IS NOT DISTINCT FROM bal_copy) AS bal_pair, bool_and(seg IS NOT DISTINCT FROM email) AS other_pair FROM d")
def _(s, d):
    groups = columns.duplicate_groups(dirty(s, d))
    return s.createDataFrame([(["bal", "bal_copy"] in groups, any("seg" in g and "email" in g for g in groups))], "bal_pair boolean, other_pair boolean")


@query("drop_all_null_cols", D + "SELECT c_custkey, seg, bal, bal_copy, email, phone, dt, const_col FROM d")
def _(s, d):
    return columns.remove_empty_columns(dirty(s, d))[0].drop(ROW_ID)


@query("constant_columns", D + "SELECT c_custkey, seg, bal, bal_copy, email, phone, dt FROM d")
def _(s, d):
    return columns.remove_constant_columns(dirty(s, d))[0].drop(ROW_ID)


@query("exact_duplicates", R + "SELECT row_id, nat, seg, bal FROM (SELECT *, row_number() OVER (PARTITION BY nat, seg, bal ORDER BY row_id) AS rn FROM d) WHERE rn > 1")
def _(s, d):
    return rows.exact_duplicates(repeated(s, d)).withColumnRenamed(ROW_ID, "row_id")


@query("dedupe_keep_first", R + "SELECT row_id, nat, seg, bal FROM (SELECT *, row_number() OVER (PARTITION BY nat, seg, bal ORDER BY row_id) AS rn FROM d) WHERE rn = 1")
def _(s, d):
    return rows.dedupe_keep_first(repeated(s, d)).withColumnRenamed(ROW_ID, "row_id")


@query("dedupe_documents", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def _(s, d):
    return rows.dedupe_keep_first(table(s, d, "documents").select("doc_id", "lang", "text"), "doc_id", ["text"]).drop("text")


@query("dup_row_count", R + "SELECT CAST((SELECT count(*) FROM d) AS BIGINT) AS rows, CAST((SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT nat, seg, bal FROM d)) AS BIGINT) AS duplicate_rows")
def _(s, d):
    return rows.duplicate_count(repeated(s, d))


@query("finite_filter", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def _(s, d):
    return table(s, d, "events").select("event_id", stats.finite("value").alias("value")).where("value IS NOT NULL")


# --- fills --------------------------------------------------------------------------------------------------------

SQL_MODE = "(SELECT {0} FROM d WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@query("fill_auto", D + f"SELECT c_custkey, coalesce(seg, {SQL_MODE.format('seg')}) AS seg, coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM d)) AS bal, coalesce(empty_col, 'Unknown') AS empty_col FROM d")
def _(s, d):
    return impute.fill(dirty(s, d).select(ROW_ID, "c_custkey", "seg", "bal", "empty_col"))[0].drop(ROW_ID)


@query("fill_auto_integer", R + "SELECT row_id, coalesce(CAST(nat AS DOUBLE), (SELECT quantile_cont(CAST(nat AS DOUBLE), 0.5) FROM d)) AS nat FROM d")
def _(s, d):
    return impute.fill(repeated(s, d).select(ROW_ID, "nat"))[0].withColumnRenamed(ROW_ID, "row_id")


@query("fill_zero", D + "SELECT c_custkey, coalesce(seg, '0') AS seg, coalesce(bal, 0) AS bal FROM d")
def _(s, d):
    return impute.fill(dirty(s, d).select(ROW_ID, "c_custkey", "seg", "bal"), ZERO)[0].drop(ROW_ID)


@query("fill_unknown", D + "SELECT c_custkey, coalesce(seg, 'Unknown') AS seg, bal IS NULL AS was_null, email FROM d")
def _(s, d):
    got = impute.fill(dirty(s, d).select(ROW_ID, "c_custkey", "seg", "bal", "email"), UNKNOWN)[0]
    return got.select("c_custkey", "seg", (F.col("bal") == "Unknown").alias("was_null"), "email")


@query("fill_drop", D + "SELECT c_custkey, seg, bal FROM d WHERE seg IS NOT NULL AND bal IS NOT NULL")
def _(s, d):
    return impute.fill(dirty(s, d).select(ROW_ID, "c_custkey", "seg", "bal"), DROP)[0].drop(ROW_ID)


@query("column_modes", D + ", x AS (SELECT 'seg' AS name, seg AS v FROM d UNION ALL SELECT 'phone', phone FROM d UNION ALL SELECT 'dt', dt FROM d), c AS (SELECT name, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL) SELECT name, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, v) AS rn FROM c) WHERE rn = 1")
def _(s, d):
    return s.createDataFrame(list(impute.modes(dirty(s, d), ["seg", "phone", "dt"]).items()), "name string, mode string")


# --- statistics ---------------------------------------------------------------------------------------------------

_DIRTY_COLUMNS = ("c_custkey", "seg", "bal", "bal_copy", "email", "phone", "dt", "const_col", "empty_col")
SQL_NULLS = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing FROM d" for i, c in enumerate(_DIRTY_COLUMNS))


@query("null_profile", D + f", x AS ({SQL_NULLS}) SELECT position, \"column\", rows, missing, round(missing / rows * 100, 2) AS missing_pct FROM x")
def _(s, d):
    return stats.null_profile(dirty(s, d))


@query("missing_table", D + f", x AS ({SQL_NULLS}) SELECT \"column\", missing, round(missing / rows * 100, 2) AS missing_pct FROM x WHERE missing > 0")
def _(s, d):
    return stats.missing_table(dirty(s, d))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("nunique_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in _ORDERS))
def _(s, d):
    return stats.distinct_counts(table(s, d, "orders"))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_numeric", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS q25, round(quantile_cont({c}, 0.5), 3) AS q50, round(quantile_cont({c}, 0.75), 3) AS q75, round(max({c}), 3) AS max FROM lineitem" for c in _MEASURES))
def _(s, d):
    return stats.describe(table(s, d, "lineitem"), list(_MEASURES))


@query("first_samples", "SELECT 'o_orderstatus' AS \"column\", (SELECT list(o_orderstatus ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3))::VARCHAR[] AS sample UNION ALL SELECT 'o_orderpriority', (SELECT list(o_orderpriority ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3))")
def _(s, d):
    return stats.samples(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), row_id="o_orderkey")


@query("preview", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def _(s, d):
    return report.preview(table(s, d, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_custkey", "c_name"))


# --- outliers -----------------------------------------------------------------------------------------------------

SQL_IQR = "WITH q AS (SELECT quantile_cont({1}, 0.25) AS q1, quantile_cont({1}, 0.75) AS q3 FROM {0}), b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "


@query("iqr_outliers", SQL_IQR.format("events", "value") + "SELECT event_id, value FROM events, b WHERE value < lo OR value > hi")
def _(s, d):
    return outliers.iqr_rows(table(s, d, "events"), "value").select("event_id", "value")


@query("iqr_bounds", " UNION ALL ".join(f"SELECT * FROM ({SQL_IQR.format(t, f'CAST({c} AS DOUBLE)')} SELECT '{c}' AS \"column\", (SELECT count({c}) FROM {t}) AS n, round(lo, 4) AS lower, round(hi, 4) AS upper, (SELECT count(*) FROM {t}, b WHERE {c} < lo OR {c} > hi) AS outliers FROM b)" for t, c in (("documents", "n_chars"), ("customer", "c_acctbal"), ("part", "p_retailprice"))))
def _(s, d):
    parts = [outliers.iqr_summary(table(s, d, t), [c]) for t, c in (("documents", "n_chars"), ("customer", "c_acctbal"), ("part", "p_retailprice"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("outlier_preview", SQL_IQR.format("events", "value") + "SELECT event_id, value FROM events, b WHERE value < lo OR value > hi ORDER BY event_id LIMIT 20")
def _(s, d):
    df = table(s, d, "events").select(F.col("event_id").alias(ROW_ID), "value")
    values = outliers.iqr(df, "value")["values"]
    first = outliers.iqr_rows(df, "value").where(F.col("value").isin(values)).orderBy(ROW_ID).limit(outliers.PREVIEW)
    return first.select(F.col(ROW_ID).alias("event_id"), "value")


@query("all_outliers", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM ({SQL_IQR.format('events', f'CAST({c} AS DOUBLE)')} SELECT '{c}' AS \"column\", (SELECT count(*) FROM events, b WHERE {c} < lo OR {c} > hi) AS outliers)" for c in ("event_id", "user_id", "value")) + ") WHERE outliers > 0")
def _(s, d):
    found = outliers.all_outliers(table(s, d, "events"))
    return s.createDataFrame([(c, r["count"]) for c, r in found.items()], "`column` string, outliers long")


@query("zscore_outliers", "WITH m AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events) SELECT event_id, value FROM events, m WHERE abs((value - mu) / sd) > 3")
def _(s, d):
    return outliers.zscore_rows(table(s, d, "events"), "value").select("event_id", "value")


@query("zscore_summary", "WITH m AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events) SELECT round(mu, 4) AS mean, round(sd, 4) AS std, (SELECT count(*) FROM events WHERE abs((value - mu) / sd) > 3) AS outliers FROM m")
def _(s, d):
    r = outliers.zscore(table(s, d, "events"), "value", row_id="event_id")
    return s.createDataFrame([(r["mean"], r["std"], r["count"])], "mean double, std double, outliers long")


# --- fuzzy duplicates ---------------------------------------------------------------------------------------------

# The keys' tokens sorted, and the longest common subsequence by one bit for each character of a.
SQL_FUZZY = """WITH k AS (SELECT i, key, array_to_string(list_sort(string_split(key, ' ')), ' ') AS s, length(key) AS n FROM (SELECT {0} AS i, trim(regexp_replace(lower({1}), '\\s+', ' ', 'g')) AS key FROM {2})),
m AS (SELECT i, key, n, s, map_from_entries([(c, list_sum([CASE WHEN s[j] = c THEN (1::HUGEINT << (j - 1)::HUGEINT) ELSE 0 END FOR j IN range(1, n + 1)])::HUGEINT) FOR c IN list_distinct(string_split(s, ''))]) AS mask FROM k WHERE key <> ''),
p AS (SELECT a.i AS ia, b.i AS ib, a.key AS ka, b.key AS kb, a.n AS na, b.n AS nb, a.mask AS mask, list_prepend((1::HUGEINT << a.n::HUGEINT) - 1, list_transform(string_split(b.s, ''), lambda c: coalesce(a.mask[c], 0)::HUGEINT)) AS steps
 FROM m a JOIN m b ON a.i < b.i AND a.key <> b.key AND 2.0 * least(a.n, b.n) >= {3} * (a.n + b.n) - 1e-9),
l AS (SELECT *, na - bit_count(list_reduce(steps, lambda v, u: (v + (v & u)) & ((1::HUGEINT << na::HUGEINT) - 1) | (v & ~u))) AS common FROM p)
SELECT ia AS index_a, ib AS index_b, ka AS key_a, kb AS key_b, round(2.0 * common / (na + nb), 3) AS similarity FROM l WHERE 2.0 * common / (na + nb) >= {3} - 1e-12"""


@query("fuzzy_pairs", SQL_FUZZY.format("p_partkey", "concat_ws(' ', p_name, p_brand)", "part", 0.93))
def _(s, d):
    return similarity.fuzzy_pairs(table(s, d, "part").select(F.col("p_partkey").alias(ROW_ID), F.concat_ws(" ", "p_name", "p_brand").alias("name")), ["name"], 0.93, ordered=False)


@query("fuzzy_suppliers", SQL_FUZZY.format("s_suppkey", "s_name", "supplier", 0.9))
def _(s, d):
    return similarity.fuzzy_pairs(table(s, d, "supplier").select(F.col("s_suppkey").alias(ROW_ID), "s_name"), ["s_name"], 0.9, ordered=False)


# --- semantic types, profile, quality -----------------------------------------------------------------------------

_TYPED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: What the names, kinds and values of the test tables' columns say, as expected.
SEMANTIC_EXPECTED = {
    "id": "region.r_regionkey nation.n_nationkey customer.c_custkey supplier.s_suppkey part.p_partkey orders.o_orderkey events.event_id events.user_id documents.doc_id embeddings.vec_id pages.page_id benchmark.item_id labels.doc_id conversations.conv_id",
    "categorical": "region.r_name customer.c_mktsegment part.p_name part.p_brand part.p_type orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus events.event_type events.props documents.lang documents.source conversations.role",
    "text": "nation.n_name customer.c_name supplier.s_name documents.text pages.html benchmark.text conversations.text",
    "numeric": "nation.n_regionkey customer.c_nationkey customer.c_acctbal supplier.s_nationkey supplier.s_acctbal part.p_size orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber lineitem.l_quantity lineitem.l_discount lineitem.l_tax events.value documents.n_chars embeddings.label labels.quality labels.toxic conversations.turn",
    "currency": "part.p_retailprice orders.o_totalprice lineitem.l_extendedprice", "date": "orders.o_orderdate lineitem.l_shipdate events.ts", "url": "pages.url", "unknown": "embeddings.embedding",
}


@query("semantic_types", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(*x.split("."), kind) for kind, xs in SEMANTIC_EXPECTED.items() for x in xs.split()) + ") t(name, \"column\", semantic)")
def _(s, d):
    found = [(t, c, k) for t in _TYPED for c, k in semantic.semantic_types(table(s, d, t)).items()]
    return s.createDataFrame(found, "name string, `column` string, semantic string")


@query("semantic_dirty", "SELECT * FROM (VALUES ('c_custkey', 'id'), ('seg', 'categorical'), ('bal', 'numeric'), ('bal_copy', 'numeric'), ('email', 'email'), ('phone', 'phone'), ('dt', 'date'), ('const_col', 'categorical'), ('empty_col', 'unknown')) t(\"column\", semantic)")
def _(s, d):
    return s.createDataFrame(list(semantic.semantic_types(dirty(s, d)).items()), "`column` string, semantic string")


SQL_ID = "SELECT '{1}' AS \"column\", count({1}) >= 2 AND count({1}) = count(*) AND count(DISTINCT {1}) = count({1}) AND max({1}) <= 10 * count({1}) AND min({1}) <= 100 AS is_id FROM {0}"


@query("id_heuristic", " UNION ALL ".join(SQL_ID.format(t, c) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("lineitem", "l_orderkey"), ("customer", "c_nationkey"))))
def _(s, d):
    found = {}
    for t, names in (("customer", ["c_custkey", "c_nationkey"]), ("supplier", ["s_suppkey"]), ("lineitem", ["l_orderkey"])):
        found |= semantic.dense_keys(table(s, d, t), names)
    return s.createDataFrame(list(found.items()), "`column` string, is_id boolean")


@query("profile_summary", R + "SELECT CAST(count(*) AS BIGINT) AS rows, 3 AS columns, CAST(sum((nat IS NULL)::INT + (seg IS NULL)::INT + (bal IS NULL)::INT) AS BIGINT) AS missing_count, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT nat, seg, bal FROM d)) AS BIGINT) AS duplicate_rows FROM d")
def _(s, d):
    p = profile.profile(repeated(s, d))
    return s.createDataFrame([tuple(p[k] for k in ("rows", "columns", "missing_count", "duplicate_rows"))], "rows long, columns int, missing_count long, duplicate_rows long")


@query("column_profiles", D + ", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS \"unique\" FROM d" for c in _DIRTY_COLUMNS) + ") SELECT * FROM x")
def _(s, d):
    return profile.column_table(dirty(s, d)).select("column", "missing", "missing_pct", "unique")


@query("dq_scores", R + """, f AS (SELECT count(*) AS n, sum((nat IS NULL)::INT + (seg IS NULL)::INT + (bal IS NULL)::INT) AS m, count(*) - (SELECT count(*) FROM (SELECT DISTINCT nat, seg, bal FROM d)) AS r,
 (SELECT count(DISTINCT seg) / count(seg) FROM d) AS ur, (SELECT count(DISTINCT seg) FROM d) AS un FROM d),
c AS (SELECT floor(100 - m / (n * 3) * 100) AS completeness, floor(100 - r / n * 100) AS uniqueness, 100 - CASE WHEN ur < 0.05 AND un > 1 AND n >= 50 THEN 1 ELSE 0 END AS consistency, 100 AS validity FROM f)
SELECT CAST(completeness AS INT) AS completeness, CAST(uniqueness AS INT) AS uniqueness, CAST(consistency AS INT) AS consistency, validity, CAST(floor(completeness * 0.35 + uniqueness * 0.25 + consistency * 0.20 + validity * 0.20) AS INT) AS score FROM c""")
def _(s, d):
    r = quality.analyze(repeated(s, d))
    return s.createDataFrame([(*(r.categories[k] for k in ("completeness", "uniqueness", "consistency", "validity")), r.score)], "completeness int, uniqueness int, consistency int, validity int, score int")


_DIRTY_TEXTS = ("seg", "email", "phone", "dt", "const_col", "empty_col")
SQL_FACTS = " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) AS u, {str(c in _DIRTY_TEXTS).lower()} AS is_text, (SELECT number_ratio FROM (SELECT {SQL_SHAPES.format(f'{c}::VARCHAR')} FROM d WHERE {c} IS NOT NULL)) AS nr, (SELECT date_ratio FROM (SELECT {SQL_SHAPES.format(f'{c}::VARCHAR')} FROM d WHERE {c} IS NOT NULL)) AS dr FROM d"
    for c in _DIRTY_COLUMNS
)
SQL_ISSUES = D + f""", f AS ({SQL_FACTS}), g AS (SELECT *, format('{{:,}} of {{:,}} cells ({{:.1f}}%) are missing.', m, n, m / n * 100) AS said FROM f)
SELECT 'HIGH' AS severity, 'completeness' AS category, c AS "column", concat(c, ' is nearly empty') AS title, said AS detail, concat('Drop ', c, ', or find its values.') AS recommendation FROM g WHERE m / n > 0.70
UNION ALL SELECT 'MEDIUM', 'completeness', c, concat('Much of ', c, ' is missing'), said, concat('Decide whether to fill, flag or drop what is missing in ', c, '.') FROM g WHERE m / n > 0.15 AND m / n <= 0.70
UNION ALL SELECT 'MEDIUM', 'consistency', c, concat(c, ' mixes numbers and text'), format('{{:.0f}}% of its values are numbers.', nr * 100), concat('Settle on one kind of value in ', c, '.') FROM g WHERE is_text AND nr > 0 AND nr < 0.9
UNION ALL SELECT 'MEDIUM', 'consistency', c, concat(c, ' mixes dates and text'), format('{{:.0f}}% of its values hold dates.', dr * 100), concat('Bring the dates of ', c, ' to one format.') FROM g WHERE is_text AND NOT (nr > 0 AND nr < 0.9) AND dr > 0 AND dr < 0.9
UNION ALL SELECT 'LOW', 'consistency', c, concat(c, ' has few values'), format('{{}} distinct values in {{:,}}.', u, n - m), concat('Encode ', c, ' as a category.') FROM g WHERE is_text AND u / (n - m) < 0.05 AND u > 1 AND n >= 50"""


@query("dq_issues", SQL_ISSUES)
def _(s, d):
    return quality.issues_table(dirty(s, d))


SQL_KEYS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = count({c}) AND count({c}) >= 0.99 * count(*) AS is_key, count(DISTINCT {c}) < 0.05 * count({c}) AND count(DISTINCT {c}) > 1 AND count(*) >= 50 AND typeof(any_value({c})) = 'VARCHAR' AS is_categorical FROM orders" for c in _ORDERS)


@query("key_candidates", SQL_KEYS)
def _(s, d):
    r = quality.analyze(table(s, d, "orders"))
    return s.createDataFrame([(c, c in r.key_candidates, c in r.categorical_candidates) for c in _ORDERS], "`column` string, is_key boolean, is_categorical boolean")


# --- unions, ragged rows, pipeline --------------------------------------------------------------------------------


@query("union_tables_with_provenance", "SELECT r_regionkey, r_name, NULL::INT AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INT AS n_regionkey, 1 AS _page, 0 AS _table, 'tables' AS _method FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name, n_regionkey, 2, 0, 'tables' FROM nation")
def _(s, d):
    return pdf.union_with_provenance([(table(s, d, "region"), 1, 0, "tables"), (table(s, d, "nation"), 2, 0, "tables")])


@query("pad_ragged_rows", "SELECT c_custkey, a[1] AS c1, a[2] AS c2, a[3] AS c3 FROM (SELECT c_custkey, string_split(c_name, '#') || CASE WHEN c_custkey % 2 = 0 THEN ['x', 'y'] ELSE [] END AS a FROM customer)")
def _(s, d):
    more = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    fit = table(s, d, "customer").select("c_custkey", pdf.fit_rows(F.concat(F.split("c_name", "#"), more), 3).alias("a"))
    return fit.select("c_custkey", *[F.get("a", F.lit(i)).alias(f"c{i + 1}") for i in range(3)])


PIPELINE = CleanOptions(normalize_emails=True, normalize_phones=True, normalize_dates=True, email_columns=("email",), phone_columns=("phone",), date_columns=("dt",), remove_const_cols=True)
SQL_CLEAN = D + f""", t AS (SELECT row_id, c_custkey, {SQL_TRIM.format('seg')} AS seg, bal, {SQL_TRIM.format('email')} AS email0, {SQL_TRIM.format('phone')} AS phone0, {SQL_TRIM.format('dt')} AS dt0 FROM d),
u AS (SELECT row_id, c_custkey, seg, bal, CASE WHEN {SQL_EMAIL.format('email0')} THEN lower(email0) ELSE email0 END AS email,
 CASE WHEN regexp_replace(phone0, '[^\\d]', '', 'g') = '' THEN phone0 ELSE concat(CASE WHEN phone0 LIKE '+%' THEN '+' ELSE '' END, regexp_replace(phone0, '[^\\d]', '', 'g')) END AS phone,
 coalesce(strftime({SQL_DATE.format('dt0')}, '%Y-%m-%d'), dt0) AS dt FROM t)
SELECT c_custkey, coalesce(seg, (SELECT seg FROM u WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg, coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM u)) AS bal, email, phone, dt FROM u"""


@query("clean_pipeline", SQL_CLEAN)
def _(s, d):
    return pipeline.clean(dirty(s, d), PIPELINE)[0].drop(ROW_ID)


@query("clean_pipeline_rows", R + ", u AS (SELECT DISTINCT nat, seg, bal FROM d WHERE NOT (nat IS NULL AND seg IS NULL AND bal IS NULL)) SELECT nat, seg, coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM u)) AS bal FROM u")
def _(s, d):
    return pipeline.clean(repeated(s, d))[0].drop(ROW_ID)


@query("pipeline_report", R + """, e AS (SELECT * FROM d WHERE NOT (nat IS NULL AND seg IS NULL AND bal IS NULL)), u AS (SELECT DISTINCT nat, seg, bal FROM e)
SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM u) AS rows_after, (SELECT count(*) FROM d) - (SELECT count(*) FROM e) AS empty_rows_removed, (SELECT count(*) FROM e) - (SELECT count(*) FROM u) AS duplicates_removed,
 (SELECT count(*) - count(bal) FROM u) AS missing_filled, CAST((SELECT sum((nat IS NULL)::INT + (seg IS NULL)::INT + (bal IS NULL)::INT) FROM d) AS BIGINT) AS missing_count_before""")
def _(s, d):
    r = pipeline.clean(repeated(s, d))[1]
    names = ("rows_before", "rows_after", "empty_rows_removed", "duplicates_removed", "missing_filled", "missing_count_before")
    return s.createDataFrame([tuple(r[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query("before_after", R + ", e AS (SELECT DISTINCT nat, seg, bal FROM d WHERE NOT (nat IS NULL AND seg IS NULL AND bal IS NULL)) SELECT 'rows' AS metric, (SELECT count(*) FROM d) AS before, (SELECT count(*) FROM e) AS after UNION ALL SELECT 'columns', 3, 3 UNION ALL SELECT 'missing cells', CAST((SELECT sum((nat IS NULL)::INT + (seg IS NULL)::INT + (bal IS NULL)::INT) FROM d) AS BIGINT), 0")
def _(s, d):
    df = repeated(s, d)
    return report.comparison(df, pipeline.clean(df)[1]).where("metric IN ('rows', 'columns', 'missing cells')")
