"""Queries over ranked lists: sources, algebra, sorts, sets, splits, functions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions import binning, scorecard, text, vectors
from rankloom.operators import dataset as D
from rankloom.operators import metrics as M
from rankloom.operators import splits as S
from rankloom.plans.base import EMB, EV, LTR, query, sql_dice
from rankloom.sources import ltr as L
from rankloom.storage import new_path

WITH = f"WITH {LTR}"
COLS = "qid, doc_id, y, round(f0, 6) AS f0"


def flat(df):
    return df.select("qid", "doc_id", "y", F.round(F.col("features")[0], 6).alias("f0"))


# -- sources and sinks --------------------------------------------------------------------------------------------


@query("letor_parse", f"{WITH} SELECT qid, CAST(y AS DOUBLE) AS y, round(f0, 4) AS f0, round(f3, 4) AS f3, round(f4, 4) AS f4 FROM ltr")
def letor_parse(spark, sf):
    lines = L.lineitem_lists(spark, sf).select(L.letor_line(4).alias("value"))
    f = F.col("features")
    return L.parse_letor(lines, 5).select("qid", "y", F.round(f[0], 4).alias("f0"), F.round(f[3], 4).alias("f3"), F.round(f[4], 4).alias("f4"))


@query("to_letor_lines4", f"{WITH} SELECT printf('%d qid:%d 1:%.4f 2:%.4f 3:%.4f 4:%.4f 5:%.4f', CAST(y AS BIGINT), qid, f0, f1, f2, f3, f4) AS line FROM ltr")
def to_letor_lines4(spark, sf):
    return L.lineitem_lists(spark, sf).select(L.letor_line(4).alias("line"))


@query("to_letor_lines", f"{WITH} SELECT printf('%d qid:%d 1:%g 2:%g 3:%g 4:%g 5:%g', CAST(y AS BIGINT), qid, f0, f1, f2, f3, f4) AS line FROM ltr")
def to_letor_lines(spark, sf):
    return L.lineitem_lists(spark, sf).select(L.letor_line().alias("line"))


@query("csv_union_project", "SELECT l_suppkey AS qid, l_quantity AS quantity, l_tax AS tax FROM (SELECT * FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT * FROM lineitem WHERE l_returnflag <> 'A')")
def csv_union_project(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    paths = []
    for c in ("l_returnflag = 'A'", "l_returnflag <> 'A'"):
        paths.append(new_path(spark))
        part = li.where(c).select(F.col("l_orderkey").alias("id_c"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("id_j"), F.col("l_quantity").alias("fitness_quantity"), F.col("l_tax").alias("fitness_tax"))
        part.write.csv(paths[-1], header=True)
    return L.read_csv_union(spark, paths, "id_c long, rank long, id_j long, fitness_quantity double, fitness_tax double")


PIPE = f"""WITH {EV},
s AS (SELECT * FROM ev WHERE qid IN (SELECT qid FROM ev GROUP BY qid HAVING count(*) >= 10)),
q AS (SELECT * FROM s WHERE qid IN (SELECT DISTINCT qid FROM s ORDER BY qid LIMIT 500)),
c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {sql_dice('qid', 'doc_id', salt='c')}, doc_id) <= 400),
n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY {sql_dice('qid', 'doc_id', salt='p')}, doc_id) AS place FROM c)
SELECT qid, doc_id, CASE WHEN n < 3 OR place <= floor(n * 0.5::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.5::DOUBLE) + CASE WHEN n - floor(n * 0.5::DOUBLE) <= 1 THEN n - floor(n * 0.5::DOUBLE) ELSE floor((n - floor(n * 0.5::DOUBLE)) * {0.2 / (0.2 + (1 - 0.5 - 0.2))!r}::DOUBLE) END THEN 'valid' ELSE 'test' END AS split FROM n"""


@query("preprocess_pipeline", PIPE)
def preprocess_pipeline(spark, sf):
    return L.preprocess(L.event_lists(spark, sf)).select("qid", "doc_id", "split")


@query("query_range", f"WITH {EV} SELECT qid, doc_id FROM ev WHERE qid BETWEEN 20 AND 60")
def query_range(spark, sf):
    return L.query_range(L.event_lists(spark, sf), 20, 60).select("qid", "doc_id")


@query("rows_at", f"WITH {EV}, p AS (SELECT qid, doc_id, row_number() OVER (ORDER BY qid, doc_id) - 1 AS pos FROM ev) SELECT qid, doc_id FROM p WHERE pos IN (0, 5, 333, (SELECT count(*) - 1 FROM ev))")
def rows_at(spark, sf):
    return L.rows_at(L.event_lists(spark, sf), [0, 5, 333, -1]).select("qid", "doc_id")


@query("from_wide", "SELECT l_suppkey AS qid, CAST(l_linenumber AS DOUBLE) AS y, l_quantity + 0.0 AS f0, l_tax + 0.0 AS f1 FROM lineitem")
def from_wide(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("qid"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("1"), F.col("l_tax").alias("2"))
    return L.from_wide(li).select("qid", "y", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


# -- filters and samples ------------------------------------------------------------------------------------------


def simple(name, where):
    return f"{WITH} SELECT {COLS} FROM ltr WHERE {where}"


@query("first_k_queries", simple("", "qid IN (SELECT DISTINCT qid FROM ltr ORDER BY qid LIMIT 7)"))
def first_k_queries(spark, sf):
    return flat(D.first_queries(L.lineitem_lists(spark, sf), 7))


@query("min_group_filter", f"WITH {EV} SELECT {COLS} FROM ev WHERE qid IN (SELECT qid FROM ev GROUP BY qid HAVING count(*) >= 65)")
def min_group_filter(spark, sf):
    return flat(D.min_group(L.event_lists(spark, sf), 65))


@query("random_queries", simple("", f"qid IN (SELECT qid FROM (SELECT DISTINCT qid FROM ltr) ORDER BY {sql_dice('qid', salt='q')}, qid LIMIT 9)"))
def random_queries(spark, sf):
    return flat(D.random_queries(L.lineitem_lists(spark, sf), 9))


@query("sample_queries_frac", simple("", f"qid IN (SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY {sql_dice('qid', salt='s')}, qid) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT qid FROM ltr)) WHERE place <= floor(n * 0.25::DOUBLE))"))
def sample_queries_frac(spark, sf):
    return flat(D.sample_queries(L.lineitem_lists(spark, sf), 0.25))


@query("cap_items_per_query", f"{WITH} SELECT {COLS} FROM ltr QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {sql_dice('qid', 'doc_id', salt='c')}, doc_id) <= 40")
def cap_items_per_query(spark, sf):
    return flat(D.cap_items(L.lineitem_lists(spark, sf), 40))


@query("drop_features", f"{WITH} SELECT qid, doc_id, y, round(f0, 6) AS f0, round(f2, 6) AS g1, round(f4, 6) AS g2, 3::BIGINT AS d FROM ltr")
def drop_features(spark, sf):
    f = vectors.drop_positions(F.col("features"), [1, 3])
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", "y", F.round(f[0], 6).alias("f0"), F.round(f[1], 6).alias("g1"), F.round(f[2], 6).alias("g2"), F.size(f).cast("long").alias("d"))


@query("keep_features", f"{WITH} SELECT qid, doc_id, y, round(f4, 6) AS g0, round(f1, 6) AS g1, 2::BIGINT AS d FROM ltr")
def keep_features(spark, sf):
    f = vectors.keep_positions(F.col("features"), [4, 1])
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", "y", F.round(f[0], 6).alias("g0"), F.round(f[1], 6).alias("g1"), F.size(f).cast("long").alias("d"))


@query("delete_items_anti", simple("", "NOT (f3 = 1 AND y = 0)"))
def delete_items_anti(spark, sf):
    df = L.lineitem_lists(spark, sf)
    return flat(D.delete_items(df, df.where("features[3] = 1 and y = 0")))


@query("delete_query_anti", simple("", "qid NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))"))
def delete_query_anti(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 1")
    gone = spark.read.parquet(f"{sf}/supplier.parquet").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("qid"))
    return flat(D.delete_queries(L.lineitem_lists(spark, sf), gone))


@query("get_query_int", simple("", "qid = 3"))
def get_query_int(spark, sf):
    return flat(L.lineitem_lists(spark, sf).where("qid = 3"))


@query("get_query_slice", simple("", "qid IN (SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM (SELECT DISTINCT qid FROM ltr)) WHERE place >= 2 AND place < 8 AND place % 2 = 0)"))
def get_query_slice(spark, sf):
    return flat(D.query_slice(L.lineitem_lists(spark, sf), 2, 8, 2))


@query("get_query_list", simple("", "qid IN (5, 2, 7)"))
def get_query_list(spark, sf):
    ids = spark.createDataFrame([(5,), (2,), (5,), (7,)], "qid long")
    return flat(L.lineitem_lists(spark, sf).join(F.broadcast(ids), "qid", "left_semi"))


@query("describe", f"{WITH} SELECT count(*) AS docs, count(DISTINCT qid) AS queries, 5::BIGINT AS features FROM ltr")
def describe(spark, sf):
    return D.describe(L.lineitem_lists(spark, sf))


@query(
    "dataset_summary",
    f"""WITH {LTR}, {EV}, a AS (SELECT 'lineitem' AS dataset, 5 AS d, qid, y FROM ltr UNION ALL SELECT 'events', 2, qid, y FROM ev),
p AS (SELECT dataset, d, qid, count(*) AS n, min(y) AS lo, max(y) AS hi FROM a GROUP BY 1, 2, 3)
SELECT dataset, sum(n)::BIGINT AS docs, count(*) AS queries, max(d)::BIGINT AS features, round(avg(n), 6) AS mean_docs, min(n) AS min_docs, max(n) AS max_docs, min(lo) AS min_y, max(hi) AS max_y FROM p GROUP BY dataset""",
)
def dataset_summary(spark, sf):
    return D.dataset_summary({"lineitem": L.lineitem_lists(spark, sf), "events": L.event_lists(spark, sf)}).withColumn("mean_docs", F.round("mean_docs", 6))


# -- sorts and ranks ----------------------------------------------------------------------------------------------


@query("sort_by_query", f"{WITH} SELECT {COLS} FROM ltr ORDER BY qid, doc_id")
def sort_by_query(spark, sf):
    return flat(D.sort_by_query(L.lineitem_lists(spark, sf)))


@query("rank_by_score", f"{WITH} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY f0 DESC, doc_id) AS rank FROM ltr")
def rank_by_score(spark, sf):
    return D.rank_by(L.lineitem_lists(spark, sf).withColumn("s", F.col("features")[0]), "s").select("qid", "doc_id", "rank")


@query("rank_band_relevance", f"{WITH}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY price DESC, doc_id) AS true_rank FROM ltr) SELECT *, CASE WHEN true_rank <= 2 THEN 4 WHEN true_rank <= 4 THEN 3 WHEN true_rank <= 7 THEN 2 WHEN true_rank <= 9 THEN 1 ELSE 0 END::BIGINT AS relevance FROM r")
def rank_band_relevance(spark, sf):
    return D.rank_grades(L.lineitem_lists(spark, sf), "price").select("qid", "doc_id", "true_rank", "relevance")


@query("group_offsets", f"{WITH}, n AS (SELECT qid, count(*) AS n FROM ltr GROUP BY qid) SELECT qid, n, (sum(n) OVER (ORDER BY qid) - n)::BIGINT AS offset FROM n")
def group_offsets(spark, sf):
    return D.group_offsets(L.lineitem_lists(spark, sf))


# -- sets ---------------------------------------------------------------------------------------------------------


@query("concat", f"WITH {LTR}, {EV} SELECT {COLS} FROM ltr UNION ALL SELECT {COLS} FROM ev")
def concat(spark, sf):
    return D.concat(flat(L.lineitem_lists(spark, sf)), flat(L.event_lists(spark, sf)))


@query("concat_by_query", f"WITH {LTR}, {EV}, u AS (SELECT 0::BIGINT AS src, qid, doc_id, y FROM ltr UNION ALL SELECT 1, qid, doc_id, y FROM ev) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY src, doc_id) AS position FROM u")
def concat_by_query(spark, sf):
    cols = ["qid", "doc_id", "y"]
    return D.concat_by_query(L.lineitem_lists(spark, sf).select(cols), L.event_lists(spark, sf).select(cols)).select("src", *cols, "position")


@query("distinct_qids", f"{WITH} SELECT DISTINCT qid FROM ltr")
def distinct_qids(spark, sf):
    return D.query_ids(L.lineitem_lists(spark, sf))


@query("missing_queries", "SELECT DISTINCT user_id AS qid FROM events EXCEPT SELECT l_suppkey FROM lineitem")
def missing_queries(spark, sf):
    return D.query_ids(L.event_lists(spark, sf)).subtract(D.query_ids(L.lineitem_lists(spark, sf)))


@query("fold_leakage", f"WITH {EV}, f AS (SELECT *, ntile(5) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM ev) SELECT a.fold AS f, b.qid, b.doc_id FROM f a JOIN f b ON a.qid = b.qid AND a.doc_id = b.doc_id AND a.fold <> b.fold")
def fold_leakage(spark, sf):
    return S.fold_leakage(S.query_kfold(L.event_lists(spark, sf), 5))


#: Values of three settings that runs have tried, and the runs: suppliers are queries, line items their runs.
TRIED = {"pdt_depth": "l_linenumber", "n_neighbors": "CAST(l_quantity AS BIGINT)"}
GRID_SQL = ", ".join(f"(SELECT DISTINCT CAST({v} AS INT) AS {k} FROM lineitem)" for k, v in TRIED.items())


def tried(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("query"), F.col("l_linenumber").cast("int").alias("pdt_depth"), F.col("l_quantity").cast("int").alias("n_neighbors"))


def whole_grid(spark, sf, fixed=None):
    from rankloom.operators.selection import grid

    values = tried(spark, sf).agg(*[F.array_sort(F.collect_set(k)).alias(k) for k in TRIED]).first()
    return grid(spark, {k: values[k] for k in TRIED}, fixed)


@query("configs_to_do", f"SELECT query, pdt_depth, n_neighbors FROM (SELECT DISTINCT l_suppkey AS query FROM lineitem), {GRID_SQL} EXCEPT SELECT l_suppkey, CAST(l_linenumber AS INT), CAST(CAST(l_quantity AS BIGINT) AS INT) FROM lineitem")
def configs_to_do(spark, sf):
    from rankloom.operators.selection import configs_to_do as todo

    runs = tried(spark, sf)
    all_ = runs.select("query").distinct().crossJoin(F.broadcast(whole_grid(spark, sf)))
    return todo(all_, runs.withColumn("hash", F.lit("x")))


@query("grid_search", f"SELECT *, 'residuals' AS dist_objective FROM {GRID_SQL}")
def grid_search(spark, sf):
    return whole_grid(spark, sf, {"dist_objective": "residuals"})


# -- splits -------------------------------------------------------------------------------------------------------


@query("holdout_queries", f"{WITH}, i AS (SELECT qid, row_number() OVER (ORDER BY {sql_dice('qid', salt='h')}, qid) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT qid FROM ltr)), k AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS t FROM i), v AS (SELECT *, CAST(floor((n - t) * {0.2 / (1 - 0.6)!r}::DOUBLE) AS BIGINT) AS w FROM k) SELECT qid, CASE WHEN place <= t THEN 'train' WHEN place <= t + w THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM v JOIN ltr USING (qid) GROUP BY 1, 2".replace(", count(*) AS n FROM v JOIN", ", count(doc_id) AS n FROM v JOIN"))
def holdout_queries(spark, sf):
    return S.holdout_queries(L.lineitem_lists(spark, sf), 0.6, 0.2).groupBy("qid", "split").agg(F.count("doc_id").alias("n"))


@query("holdout_per_query", PIPE.replace("FROM q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY " + sql_dice("qid", "doc_id", salt="c") + ", doc_id) <= 400", "FROM ev"))
def holdout_per_query(spark, sf):
    return S.holdout_per_query(L.event_lists(spark, sf), 0.5, 0.2).select("qid", "doc_id", "split")


@query("query_kfold", f"{WITH} SELECT qid, doc_id, ntile(5) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM ltr")
def query_kfold(spark, sf):
    return S.query_kfold(L.lineitem_lists(spark, sf), 5).select("qid", "doc_id", "fold")


@query("query_batches", "WITH i AS (SELECT DISTINCT user_id AS qid FROM events), c AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS place, count(*) OVER () AS n FROM i), k AS (SELECT *, CAST(ceil(n / 7.0) AS BIGINT) AS k FROM c) SELECT qid, CASE WHEN place < (n % k) * (n // k + 1) THEN place // (n // k + 1) ELSE n % k + (place - (n % k) * (n // k + 1)) // (n // k) END AS batch FROM k")
def query_batches(spark, sf):
    return S.query_batches(L.event_lists(spark, sf), 7)


@query("stratified_split", f"{WITH}, n AS (SELECT qid, doc_id, y, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY {sql_dice('qid', 'doc_id', salt='t')}, doc_id) AS place FROM ltr) SELECT qid, doc_id, CASE WHEN place <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM n")
def stratified_split(spark, sf):
    return S.stratified(L.lineitem_lists(spark, sf), "y", 0.7).select("qid", "doc_id", "split")


@query("fold_distribution", f"WITH {EV}, f AS (SELECT *, ntile(4) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM ev) SELECT g.fold::BIGINT AS fold, qid, count(*) FILTER (WHERE f.fold <> g.fold) AS n_train, count(*) FILTER (WHERE f.fold = g.fold) AS n_test FROM f, (SELECT unnest(range(4)) AS fold) g GROUP BY 1, 2")
def fold_distribution(spark, sf):
    return S.fold_distribution(S.query_kfold(L.event_lists(spark, sf), 4), 4)


# -- aggregates ---------------------------------------------------------------------------------------------------


@query("q2count", f"{WITH} SELECT qid, count(*) AS n FROM ltr GROUP BY qid")
def q2count(spark, sf):
    return D.query_counts(L.lineitem_lists(spark, sf))


@query("query_summary", f"WITH {EV} SELECT qid, count(*) AS size, round(max(y), 3) AS max, round(min(y), 3) AS min, round(avg(y), 3) AS mean FROM ev GROUP BY qid")
def query_summary(spark, sf):
    return D.query_summary(L.event_lists(spark, sf))


def ndcg_sql(k, source="ltr", score="f0", label="y"):
    return f"""n AS (SELECT qid, count(*) AS n FROM {source} GROUP BY qid),
r AS (SELECT qid, {label} AS y, {score} AS s, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, doc_id) AS rn, row_number() OVER (PARTITION BY qid ORDER BY {label} DESC, doc_id) AS irn FROM {source}),
k AS (SELECT unnest([{', '.join(map(str, k))}])::BIGINT AS k),
g AS (SELECT k, qid, s, avg(y) * sum(CASE WHEN rn <= k THEN ln(2) / ln(rn + 1) ELSE 0 END) AS v FROM r, k GROUP BY k, qid, s),
d AS (SELECT k, qid, sum(v) AS dcg FROM g GROUP BY k, qid),
i AS (SELECT k, qid, sum(CASE WHEN irn <= k THEN y * ln(2) / ln(irn + 1) ELSE 0 END) AS idcg FROM r, k GROUP BY k, qid),
ndcg AS (SELECT d.k, n.qid, n, CASE WHEN n = 1 THEN 1.0 WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg FROM n JOIN d ON n.qid = d.qid JOIN i ON n.qid = i.qid AND d.k = i.k)"""


def scored(spark, sf):
    return L.lineitem_lists(spark, sf).withColumn("s", F.col("features")[0])


@query("ndcg_at_k", f"{WITH}, {ndcg_sql([10])} SELECT qid, n, round(ndcg, 6) AS ndcg FROM ndcg")
def ndcg_at_k(spark, sf):
    return M.ndcg(scored(spark, sf), "s", 10).select("qid", "n", F.round("ndcg", 6).alias("ndcg"))


@query("ndcg_multi_k", f"{WITH}, {ndcg_sql([5, 10, 15, 20, 25])} SELECT k, qid, round(ndcg, 6) AS ndcg FROM ndcg")
def ndcg_multi_k(spark, sf):
    return M.ndcg(scored(spark, sf), "s", [5, 10, 15, 20, 25]).select("k", "qid", F.round("ndcg", 6).alias("ndcg"))


@query("ndcg_summary", f"WITH {EV}, {ndcg_sql([10], 'ev')} SELECT round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std, round(median(ndcg), 6) AS median FROM ndcg")
def ndcg_summary(spark, sf):
    m = M.summary(M.ndcg(L.event_lists(spark, sf).withColumn("s", F.col("features")[0]), "s", 10))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("ndcg_iqr_trim", f"{WITH}, {ndcg_sql([10])} SELECT qid, round(ndcg, 6) AS ndcg FROM ndcg, (SELECT quantile_cont(ndcg, 0.25) AS lo, quantile_cont(ndcg, 0.75) AS hi FROM ndcg) WHERE ndcg >= lo - 1e-9 AND ndcg <= hi + 1e-9")
def ndcg_iqr_trim(spark, sf):
    return M.trimmed(M.ndcg(scored(spark, sf), "s", 10)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query("ndcg_weighted", f"WITH {EV}, {ndcg_sql([10], 'ev')} SELECT round(sum(ln(1 + n) * ndcg) / sum(ln(1 + n)) / count(*), 6) AS weighted, round(sum(ln(1 + n) * ndcg) / sum(ln(1 + n)), 6) AS weighted_mean FROM ndcg")
def ndcg_weighted(spark, sf):
    w = M.log_weighted(M.ndcg(L.event_lists(spark, sf).withColumn("s", F.col("features")[0]), "s", 10))
    return w.select(*[F.round(c, 6).alias(c) for c in w.columns])


def compare_sql(model, score):
    return f"SELECT '{model}' AS model, k, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std, round(median(ndcg), 6) AS median FROM (WITH {ndcg_sql([5, 10], 'ltr', score)} SELECT * FROM ndcg) GROUP BY k"


@query("comparison", f"{WITH} {compare_sql('quantity', 'f0')} UNION ALL {compare_sql('date', 'f4')}")
def comparison(spark, sf):
    df = L.lineitem_lists(spark, sf).withColumn("quantity", F.col("features")[0]).withColumn("date", F.col("features")[4])
    return M.comparison(df, ["quantity", "date"], [5, 10]).select("model", "k", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@query("random_ranker", f"{WITH} SELECT qid, doc_id, ('0x' || substr({sql_dice('qid', 'doc_id', salt='r')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM ltr")
def random_ranker(spark, sf):
    from rankloom.operators.baselines import random_score

    return L.lineitem_lists(spark, sf).select("qid", "doc_id", random_score().alias("score"))


@query("mae_r2", f"{WITH}, m AS (SELECT avg(price) AS m FROM ltr) SELECT round(avg(abs(price - f0 * 1500)), 4) AS mae, round(1 - sum((price - f0 * 1500) ** 2) / sum((price - m) ** 2), 6) AS r2 FROM ltr, m")
def mae_r2(spark, sf):
    df = L.lineitem_lists(spark, sf).withColumn("p", F.col("features")[0] * 1500)
    return M.mae_r2(df, "p", "price").select(F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


# -- bins and functions -------------------------------------------------------------------------------------------


@query("equal_width_bins", f"{WITH} SELECT qid, doc_id, CAST(y AS BIGINT) AS bin FROM ltr")
def equal_width_bins(spark, sf):
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", F.col("y").cast("long").alias("bin"))


def qcut_sql(most, by):
    part = f"PARTITION BY {by}"
    return f"""{WITH}, p AS (SELECT {by} AS q, qid, doc_id, price AS y FROM ltr), s AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY y, doc_id) - 1 AS pos FROM p),
k AS (SELECT q, least({most}, count(DISTINCT y)) AS k, count(*) AS n FROM p GROUP BY q), ii AS (SELECT unnest(range({most} + 1)) AS i),
h AS (SELECT k.q, i, n, ((CASE WHEN i = k THEN 1.0::DOUBLE ELSE i::DOUBLE * (1.0::DOUBLE / k::DOUBLE) END) * 100.0::DOUBLE / 100.0::DOUBLE) * (n - 1)::DOUBLE AS h FROM k JOIN ii ON i <= k),
e AS (SELECT h.q, CASE WHEN h.h - floor(h.h) < 0.5 THEN a.y + (b.y - a.y) * (h.h - floor(h.h)) ELSE b.y - (b.y - a.y) * (1 - (h.h - floor(h.h))) END AS edge
  FROM h JOIN s a ON a.q = h.q AND a.pos = floor(h.h)::BIGINT JOIN s b ON b.q = h.q AND b.pos = least(floor(h.h)::BIGINT + 1, h.n - 1)),
x AS (SELECT q, list(edge) AS es FROM (SELECT q, edge, min(edge) OVER (PARTITION BY q) AS lo, max(edge) OVER (PARTITION BY q) AS hi FROM (SELECT DISTINCT q, edge FROM e)) WHERE edge > lo AND edge < hi GROUP BY q)
SELECT p.qid, p.doc_id, coalesce(len(list_filter(es, lambda v: v < p.y)), 0)::BIGINT AS bin FROM p LEFT JOIN x ON p.q = x.q""".replace(part, part)


@query("qcut_labels", qcut_sql(30, "qid"))
def qcut_labels(spark, sf):
    return binning.quantile_cut(L.lineitem_lists(spark, sf), ["qid"], "price", 30).select("qid", "doc_id", "bin")


@query("qcut_global", qcut_sql(6, "1"))
def qcut_global(spark, sf):
    df = L.lineitem_lists(spark, sf)
    cuts = df.select("qid", "doc_id", "price")
    edges = binning.global_edges(cuts, "price", 6)
    return cuts.select("qid", "doc_id", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("price"))).cast("long").alias("bin"))


@query("score_mae_cosine", f"{WITH} SELECT qid, round(avg(abs(f0 - y)), 6) AS mae, round(1 - sum(f0 * y) / (sqrt(sum(f0 * f0)) * sqrt(sum(y * y))), 6) AS cosine FROM ltr GROUP BY qid")
def score_mae_cosine(spark, sf):
    a, b = F.col("features")[0], F.col("y")
    return L.lineitem_lists(spark, sf).groupBy("qid").agg(F.round(F.avg(F.abs(a - b)), 6).alias("mae"), F.round(F.lit(1.0) - F.sum(a * b) / (F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))), 6).alias("cosine"))


@query("multi_hot", "WITH t AS (SELECT DISTINCT user_id, event_type FROM events), v AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, v.event_type, (t.user_id IS NOT NULL)::BIGINT AS hot FROM u CROSS JOIN v LEFT JOIN t ON t.user_id = u.user_id AND t.event_type = v.event_type")
def multi_hot(spark, sf):
    from rankloom.operators.clustering import multi_hot as hot

    lists = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    wide, names = hot(lists, "tags")
    return wide.select("user_id", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("event_type"), F.col("hot").alias("hot"))).alias("z")).select("user_id", "z.event_type", F.col("z.hot").cast("long").alias("hot"))


@query("fmt_no_zero", f"{WITH} SELECT qid, doc_id, regexp_replace(printf('%.3f', f1 * 7 - 0.2), '^(-?)0\\.', '\\1.') AS txt FROM ltr")
def fmt_no_zero(spark, sf):
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", text.no_leading_zero(F.col("features")[1] * 7 - 0.2).alias("txt"))


LOG = "concat('epoch 1\nNDCG@10 on training data: 0.1\nNDCG@10 on training data: ', printf('%.4f', {f}), '\nNDCG@10 on test data: 0.', CAST({d} AS VARCHAR))"


@query("parse_ndcg_log", f"{WITH} SELECT qid, doc_id, round(f1, 4) AS training, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST('0.' || CAST(doc_id AS VARCHAR) AS DOUBLE) END AS test FROM ltr")
def parse_ndcg_log(spark, sf):
    log = F.concat(F.lit("epoch 1\nNDCG@10 on training data: 0.1\nNDCG@10 on training data: "), F.format_string("%.4f", F.col("features")[1]), F.when(F.col("doc_id") % 3 == 0, F.lit("\nfailed")).otherwise(F.concat(F.lit("\nNDCG@10 on test data: 0."), F.col("doc_id").cast("string"))))
    df = L.lineitem_lists(spark, sf).withColumn("log", log)
    return df.select("qid", "doc_id", text.last_ndcg(F.col("log"), "training").alias("training"), text.last_ndcg(F.col("log"), "test").alias("test"))


@query("rule_rename", f"{WITH} SELECT qid, doc_id, concat('quantity <= ', CAST(qid AS VARCHAR), ' & tax > 1 & X_12 > 2') AS rule FROM ltr")
def rule_rename(spark, sf):
    rule = F.concat(F.lit("X_0 <= "), F.col("qid").cast("string"), F.lit(" & X_2 > 1 & X_12 > 2"))
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", text.rename_features_column(rule, ["quantity", "discount", "tax", "line", "days"]).alias("rule"))


@query("feat_dict", "WITH n AS (SELECT event_type AS e, row_number() OVER (ORDER BY event_type) - 1 AS i, count(*) OVER () AS d FROM (SELECT DISTINCT event_type FROM events)), b AS (SELECT unnest(range(4)) AS k) SELECT (k * d + i)::BIGINT AS position, CASE k WHEN 0 THEN 'A_' || e WHEN 1 THEN 'B_' || e WHEN 2 THEN '|A_' || e || ' - B_' || e || '|' ELSE '(A_' || e || ' - B_' || e || ')^2' END AS name FROM n, b")
def feat_dict(spark, sf):
    kinds = spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().orderBy("event_type").collect()
    names = vectors.pair_feature_names([r["event_type"] for r in kinds], ("pair", "abs_diff", "sq_diff"))
    return spark.createDataFrame(list(enumerate(names)), "position long, name string")


@query("subsample_sizes", f"WITH {EV} SELECT qid, count(*) AS n, CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS tree, least(17, count(*))::BIGINT AS tree_count, greatest(1, least(count(*), CAST(round_even(count(*) * 0.3::DOUBLE, 0) AS BIGINT)))::BIGINT AS boosted FROM ev GROUP BY qid")
def subsample_sizes(spark, sf):
    from rankloom.operators.pairs import boosted_size, tree_size

    n = D.query_counts(L.event_lists(spark, sf))
    return n.select("qid", "n", tree_size(F.col("n"), 0.3).alias("tree"), tree_size(F.col("n"), 17).alias("tree_count"), boosted_size(F.col("n"), 0.3).alias("boosted"))


#: Rules on the event type from users by the remainder of their id: how far a type's mean lies from a hundred.
RULES = "SELECT event_type AS rule, round(avg(value) / 100 - 1, 6) AS weight, count(*) AS support FROM events GROUP BY event_type, user_id % 4"


@query("scorecard_points", f"WITH r AS ({RULES}), p AS (SELECT rule, support, CAST(round_even(20 / ln(2) * weight, 0) AS BIGINT) AS points FROM r) SELECT rule, sum(points)::BIGINT AS points, max(support)::BIGINT AS support FROM p WHERE points <> 0 GROUP BY rule HAVING sum(points) <> 0")
def scorecard_points(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rules = events.groupBy(F.col("event_type").alias("rule"), (F.col("user_id") % 4).alias("part")).agg(F.round(F.avg("value") / 100 - 1, 6).alias("weight"), F.count("*").alias("support"))
    return scorecard.to_points(rules)


@query("scorecard_proba", f"{WITH} SELECT qid, doc_id, round(1 / (1 + exp(-((500 + f0 * 4 - (600 - 20 / ln(2) * ln(50))) / (20 / ln(2))))), 6) AS p FROM ltr")
def scorecard_proba(spark, sf):
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", F.round(scorecard.probability(F.lit(500) + F.col("features")[0] * 4), 6).alias("p"))


@query("rule_activation", f"{WITH} SELECT qid, doc_id, f0 <= 25 AND f3 > 2 AND f1 <> 0.05 AS active FROM ltr")
def rule_activation(spark, sf):
    rule = F.array(*[F.struct(F.lit(f).alias("feat"), F.lit(t).alias("thr"), F.lit(o).alias("op")) for f, t, o in ((0, 25.0, "<="), (3, 2.0, ">"), (1, 0.05, "!="))])
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", scorecard.active(rule, F.col("features")).alias("active"))


@query("synthetic_target", f"WITH {EMB} SELECT qid, doc_id, round(2.5 * (0.5 * x[1] + 0.3 * x[2] - 0.2 * x[3]) + 0.2 * (x[1] * x[2] + x[2] * x[3]) + 0.5 * (sin(x[1]) + cos(x[2])) + 0.1 * exp(-(x[1] * x[1] + x[2] * x[2] + x[3] * x[3])), 6) AS target FROM emb")
def synthetic_target(spark, sf):
    from rankloom.operators.synthetic import target

    x = F.slice("features", 1, 3)
    return L.embedding_lists(spark, sf).select("qid", "doc_id", F.round(target(x, [0.5, 0.3, -0.2]), 6).alias("target"))


@query("query_embedding", f"{WITH}, l AS (SELECT qid, unnest([0, 1, 2, 3, 4])::BIGINT AS f, unnest([f0, f1, f2, f3, f4]) AS v FROM ltr) SELECT qid, f, round(quantile_cont(v, 0.25), 6) AS p25, round(avg(v), 6) AS mean, round(median(v), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75 FROM l GROUP BY qid, f")
def query_embedding(spark, sf):
    from rankloom.operators.clustering import query_statistics

    s = query_statistics(L.lineitem_lists(spark, sf))
    return s.select("qid", "f", *[F.round(c, 6).alias(c) for c in ("p25", "mean", "p50", "p75")])


@query(
    "query_cosine",
    f"""WITH {EV}, l AS (SELECT qid, unnest([0, 1]) AS f, unnest([f0, f1]) AS v FROM ev), s AS (SELECT qid, f, [quantile_cont(v, 0.25), avg(v), median(v), quantile_cont(v, 0.75)] AS e FROM l GROUP BY qid, f),
m AS (SELECT qid, flatten(list(e ORDER BY f)) AS x FROM s GROUP BY qid)
SELECT a.qid, b.qid AS other, round(1 - list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 6) + 0.0 AS distance FROM m a JOIN m b ON a.qid < b.qid""",
)
def query_cosine(spark, sf):
    from rankloom.operators.clustering import query_distances, query_embeddings

    d = query_distances(query_embeddings(L.event_lists(spark, sf)), 6, upper=True)
    return d.select("qid", "other", (F.col("distance") + 0.0).alias("distance"))
