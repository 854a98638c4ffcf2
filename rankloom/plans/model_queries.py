"""Queries over pairs, neighbours, trees, two-stage rankers, explanations, selection and experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions import text, vectors
from rankloom.operators import boosting as B
from rankloom.operators import experiments as X
from rankloom.operators import linear as LN
from rankloom.operators import metrics as M
from rankloom.operators import models as MO
from rankloom.operators import pairs as P
from rankloom.operators import pairwise as PW
from rankloom.operators import rtr as R
from rankloom.operators import rulecard as C
from rankloom.operators import selection as S
from rankloom.operators import sensitivity as A
from rankloom.operators import splits
from rankloom.operators import trees as T
from rankloom.plans.base import EMB, EV, LTR, query, sql_dice
from rankloom.plans.dataset_queries import ndcg_sql
from rankloom.sources import ltr as L
from rankloom.sources import results as RS
from rankloom.storage import new_path

# -- pairs --------------------------------------------------------------------------------------------------------

#: The share of each side's documents that :func:`pair_self_join` draws, which is its feature; other pair queries make all pairs.
SHARE = 0.3


def drawn(salt, size=SHARE, source="ev"):
    return f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n_, row_number() OVER (PARTITION BY qid ORDER BY {sql_dice('qid', 'doc_id', salt=salt)}, qid, doc_id) AS r_ FROM {source}) WHERE r_ <= ceil(n_ * {size}::DOUBLE))"


PAIRS = f"WITH {EV}, p AS (SELECT a.qid, a.doc_id AS a, b.doc_id AS b, a.y AS ya, b.y AS yb, a.f0 AS a0, a.f1 AS a1, b.f0 AS b0, b.f1 AS b1 FROM ev a JOIN ev b ON a.qid = b.qid)"


def event_pairs(spark, sf):
    return P.pairs(L.event_lists(spark, sf), ["qid"])


def ids(df, **cols):
    return df.select("qid", F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), *[F.round(c, 6).alias(n) for n, c in cols.items()])


def ab():
    """The features of a pair's two sides."""
    return F.col("features_a"), F.col("features_b")


@query("pair_self_join", f"WITH {EV} SELECT a.qid, a.doc_id AS a, b.doc_id AS b FROM {drawn('a')} a JOIN {drawn('b')} b ON a.qid = b.qid")
def pair_self_join(spark, sf):
    return ids(P.pairs(L.event_lists(spark, sf), ["qid"], SHARE))


@query("pair_cross", f"WITH {EMB} SELECT a.qid, a.doc_id AS a, b.doc_id AS b FROM emb a JOIN emb b ON a.qid = b.qid")
def pair_cross(spark, sf):
    # 20 groups, which grow with the table.
    return ids(P.pairs(L.embedding_lists(spark, sf).select("qid", "doc_id"), ["qid"], most=1024))


@query("zeta_features", f"{PAIRS} SELECT qid, a, b, round(a0, 6) AS z0, round(b1, 6) AS z3, round(abs(a0 - b0), 6) AS z4, round((a1 - b1) * (a1 - b1), 6) AS z7, 8::BIGINT AS d FROM p")
def zeta_features(spark, sf):
    z = vectors.pair_features(*ab(), ("pair", "abs_diff", "sq_diff"))
    return ids(event_pairs(spark, sf), z0=z[0], z3=z[3], z4=z[4], z7=z[7]).withColumn("d", F.lit(8).cast("long"))


@query("pair_view", f"{PAIRS} SELECT qid, a, b, round(abs(a0 - b0), 6) AS v0, round(abs(a1 - b1), 6) AS v1 FROM p")
def pair_view(spark, sf):
    z = vectors.pair_features(*ab(), ("abs_diff",))
    return ids(event_pairs(spark, sf), v0=z[0], v1=z[1])


@query("pair_target_dist", f"{PAIRS} SELECT qid, a, b, round((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1), 6) AS target FROM p")
def pair_target_dist(spark, sf):
    return ids(event_pairs(spark, sf), target=R.pair_target("dist"))


@query("pair_target_y", f"{PAIRS} SELECT qid, a, b, round((ya - yb) * (ya - yb), 6) AS target FROM p")
def pair_target_y(spark, sf):
    return ids(event_pairs(spark, sf), target=R.pair_target("y"))


RES = f"WITH {EV}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY qid) AS z FROM ev), p AS (SELECT a.qid, a.doc_id AS a, b.doc_id AS b, a.z AS za, b.z AS zb FROM m a JOIN m b ON a.qid = b.qid)"


def residual_pairs(spark, sf):
    df = L.event_lists(spark, sf)
    mean = df.groupBy("qid").agg(F.avg("y").alias("m"))
    return P.pairs(df.join(mean, "qid").withColumn("value", F.col("y") - F.col("m")), ["qid"])


@query("pair_target_residual", f"{RES} SELECT qid, a, b, round((za - zb) * (za - zb), 6) AS target FROM p")
def pair_target_residual(spark, sf):
    return ids(residual_pairs(spark, sf), target=R.pair_target("residuals"))


@query("pair_target_model", f"{RES} SELECT qid, a, b, round(abs(za - zb), 6) AS target FROM p")
def pair_target_model(spark, sf):
    return ids(residual_pairs(spark, sf), target=F.abs(F.col("value_a") - F.col("value_b")))


@query("pair_target_supervised", f"{PAIRS} SELECT qid, a, b, (ya <> yb)::BIGINT AS target FROM p")
def pair_target_supervised(spark, sf):
    return ids(event_pairs(spark, sf), target=(F.col("y_a") != F.col("y_b")).cast("long"))


@query("pair_target_precomputed", f"{PAIRS} SELECT p.qid, p.a, p.b, round(sqrt((a0 - b0) * (a0 - b0)), 6) AS target FROM p")
def pair_target_precomputed(spark, sf):
    given = P.pairs(L.event_lists(spark, sf), ["qid"]).select("qid", "doc_id_a", "doc_id_b", F.sqrt(F.pow(F.col("features_a")[0] - F.col("features_b")[0], 2)).alias("target"))
    return ids(P.given_pairs(L.event_lists(spark, sf), given, ["qid"]), target="target")


@query("pair_target_matrix", f"WITH {EMB}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM emb WHERE qid = 0) SELECT a.i AS idx_a, b.i AS idx_b, round(abs(a.x[1] - b.x[1]), 6) AS target FROM n a JOIN n b ON a.i <> b.i")
def pair_target_matrix(spark, sf):
    lists = L.embedding_lists(spark, sf).where("qid = 0").select("doc_id", F.col("features")[0].alias("v"))
    row = lists.withColumn("i", F.row_number().over(W.orderBy("doc_id")).cast("long") - 1)
    met = row.select(F.col("i").alias("idx_a"), F.col("v").alias("va")).join(row.select(F.col("i").alias("idx_b"), F.col("v").alias("vb")), F.col("idx_a") != F.col("idx_b"), "inner")
    cells = row.select("i", "v").join(row.select(F.col("i").alias("j"), F.col("v").alias("u")), F.lit(True))
    matrix = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.abs(F.col("v") - F.col("u")).alias("d")))), lambda c: c["d"]).alias("values"))
    n = row.count()
    return P.precomputed_targets(met.select("idx_a", "idx_b"), matrix, n, n).withColumn("target", F.round("target", 6))


@query("pair_metric", f"{PAIRS} SELECT qid, a, b, round(sqrt((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1)), 6) AS euclidean, round(abs(a0 - b0) + abs(a1 - b1), 6) AS manhattan, round(1 - (a0 * b0 + a1 * b1) / (sqrt(a0 * a0 + a1 * a1) * sqrt(b0 * b0 + b1 * b1)), 6) + 0.0 AS cosine FROM p")
def pair_metric(spark, sf):
    out = ids(event_pairs(spark, sf), **{m: vectors.METRICS[m](*ab()) for m in ("euclidean", "manhattan", "cosine")})
    return out.withColumn("cosine", F.col("cosine") + 0.0)


# -- neighbours ---------------------------------------------------------------------------------------------------

KNN = f"""WITH {EMB}, f AS (SELECT *, ntile(5) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM emb), te AS (SELECT * FROM f WHERE fold = 0), tr AS (SELECT * FROM f WHERE fold <> 0),
kd AS (SELECT te.qid, te.doc_id, tr.doc_id AS neighbour, tr.y AS v, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (te.x[i] - tr.x[i]) * (te.x[i] - tr.x[i])))), 9) AS d FROM te JOIN tr ON te.qid = tr.qid),
kn AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY d, neighbour) AS rank FROM kd)"""


def knn_sides(spark, sf):
    df = splits.query_kfold(L.embedding_lists(spark, sf), 5)
    return df.where("fold = 0"), df.where("fold <> 0").withColumn("value", F.col("y"))


@query("knn_topk", f"{KNN} SELECT qid, doc_id, neighbour, rank FROM kn WHERE rank <= 5")
def knn_topk(spark, sf):
    return P.nearest(*knn_sides(spark, sf), ["qid"], 5).select("qid", "doc_id", "neighbour", "rank")


@query("knn_neighbors", f"{KNN} SELECT qid, doc_id, neighbour, rank, round(d, 6) AS d FROM kn WHERE rank <= 3 AND doc_id = (SELECT min(doc_id) FROM te)")
def knn_neighbors(spark, sf):
    test, train = knn_sides(spark, sf)
    first = test.orderBy("doc_id").limit(1)
    return P.nearest(first, train, ["qid"], 3).select("qid", "doc_id", "neighbour", "rank", F.round("d", 6).alias("d"))


@query("knn_euclid", f"{KNN} SELECT qid, doc_id, round(avg(v), 6) AS prediction FROM kn WHERE rank <= 5 GROUP BY 1, 2")
def knn_euclid(spark, sf):
    return P.corrections(*knn_sides(spark, sf), ["qid"], 5).select("qid", "doc_id", F.round("correction", 6).alias("prediction"))


@query("knn_baseline", f"{KNN}, nb AS (SELECT qid, doc_id, avg(v) AS s FROM kn WHERE rank <= 7 GROUP BY 1, 2), t AS (SELECT te.qid, te.doc_id, te.y, s FROM te JOIN nb USING (qid, doc_id)), {ndcg_sql([10], 't', 's')} SELECT qid, round(ndcg, 6) AS ndcg FROM ndcg")
def knn_baseline(spark, sf):
    pred = P.corrections(*knn_sides(spark, sf), ["qid"], 7)
    return M.ndcg(pred, "correction", 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


# -- trees --------------------------------------------------------------------------------------------------------


def tree_sql(p, rows, keys, feats, t, depth):
    """CTEs that grow trees level by level: {p}r<depth> has every row's leaf node, {p}b<level> the splits of a level."""
    by, k = ", ".join([*keys, "node"]), "".join(f"{x}, " for x in keys)
    join = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in [*keys, "node"])
    out = [f"{p}r0 AS (SELECT *, 1::BIGINT AS node FROM {rows})"]
    gain = "round(sl * sl / nl + (ts - sl) * (ts - sl) / (tn - nl) - ts * ts / tn, 9)"
    for i in range(depth):
        out += [
            f"{p}l{i} AS (SELECT {by}, f, v, count(*) AS n, sum(t_) AS s FROM (SELECT {by}, unnest({list(range(len(feats)))}) AS f, unnest([{', '.join(feats)}]) AS v, {t} AS t_ FROM {p}r{i} WHERE node >= {2**i}) GROUP BY ALL)",
            f"{p}c{i} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY {by}, f) AS tn, sum(s) OVER (PARTITION BY {by}, f) AS ts, lead(v) OVER (PARTITION BY {by}, f ORDER BY v) AS nx FROM {p}l{i} WINDOW w AS (PARTITION BY {by}, f ORDER BY v ROWS UNBOUNDED PRECEDING))",
            f"{p}b{i} AS (SELECT {by}, f, (v + nx) / 2 AS thr FROM {p}c{i} WHERE nx IS NOT NULL AND {gain} > 0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {gain} DESC, f, v) = 1)",
            f"{p}r{i + 1} AS ({route_sql(f'{p}r{i}', f'{p}b{i}', join, feats)})",
        ]
    return ", ".join(out)


def route_sql(rows, splits_, join, feats):
    return f"SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + (list_extract([{', '.join('r.' + f for f in feats)}], b.f + 1) > b.thr)::BIGINT END AS node) FROM {rows} r LEFT JOIN {splits_} b ON {join('r', 'b')}"


def walk_sql(p, name, rows, keys, feats, depth):
    """CTEs that route other rows down the trees of ``tree_sql``: {name}<depth>."""
    join = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in [*keys, "node"])
    out = [f"{name}0 AS (SELECT *, 1::BIGINT AS node FROM {rows})"]
    out += [f"{name}{i + 1} AS ({route_sql(f'{name}{i}', f'{p}b{i}', join, feats)})" for i in range(depth)]
    return ", ".join(out)


def sql_path(node="node"):
    return f"CASE {' '.join(f'WHEN {node} = {n} THEN {chr(39)}R{format(n, chr(98))[1:].replace(chr(48), chr(108)).replace(chr(49), chr(114))}{chr(39)}' for n in range(1, 32))} END"


F5 = ["f0", "f1", "f2", "f3", "f4"]


def price_rows(spark, sf):
    return L.lineitem_lists(spark, sf).select("qid", "doc_id", "features", (F.col("price") / 1000).alias("target"))


@query("tree_split_root", f"WITH {LTR}, {tree_sql('t', 'ltr', ['qid'], F5, '(price / 1000)', 1)} SELECT qid, f AS feature, round(thr, 6) AS threshold FROM tb0")
def tree_split_root(spark, sf):
    rows = price_rows(spark, sf).withColumn("node", F.lit(1).cast("long"))
    return T.best_splits(rows, ["qid"]).select("qid", "feature", F.round("threshold", 6).alias("threshold"))


@query("tree_leaf_stats", f"WITH {LTR}, {tree_sql('t', 'ltr', ['qid'], F5, '(price / 1000)', 3)} SELECT qid, {sql_path()} AS path, count(*) AS n, round(avg(price / 1000) + 1e-8, 6) AS prediction FROM tr3 GROUP BY qid, node")
def tree_leaf_stats(spark, sf):
    trees = T.grow(price_rows(spark, sf), ["qid"], 3)
    return trees.where("is_leaf").select("qid", "path", "n", F.round(F.col("prediction") + 1e-8, 6).alias("prediction"))


ONE = f"WITH {LTR}, one AS (SELECT 0::BIGINT AS m, * FROM ltr), {tree_sql('t', 'one', ['m'], F5, '(price / 1000)', 3)}, lp AS (SELECT node, avg(price / 1000) AS p, count(*) AS n FROM tr3 GROUP BY node), res AS (SELECT r.*, {sql_path('r.node')} AS leaf, p, price / 1000 - p AS residual FROM tr3 r JOIN lp ON r.node = lp.node)"


def one_model(spark, sf):
    rows = price_rows(spark, sf)
    trees = T.grow(rows, [], 3)
    return trees, T.apply(rows, trees, []).withColumn("residual", F.col("target") - F.col("score"))


@query("residuals", f"{ONE} SELECT qid, doc_id, leaf, round(p, 6) AS score, round(residual, 6) AS residual FROM res")
def residuals(spark, sf):
    return one_model(spark, sf)[1].select("qid", "doc_id", "leaf", F.round("score", 6).alias("score"), F.round("residual", 6).alias("residual"))


@query("leaf_residual_stats", f"{ONE} SELECT leaf, count(*) AS n, round(avg(price / 1000), 6) AS mean_target, round(avg(abs(residual)), 6) AS mean_abs, round(stddev_samp(residual), 6) AS std FROM res GROUP BY leaf")
def leaf_residual_stats(spark, sf):
    r = F.col("residual")
    return one_model(spark, sf)[1].groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean_target"), F.round(F.avg(F.abs(r)), 6).alias("mean_abs"), F.round(F.stddev_samp(r), 6).alias("std"))


@query("leaf_table", f"{ONE}, s AS (SELECT leaf, count(*) AS n, avg(residual * residual) AS mse FROM res GROUP BY leaf) SELECT {sql_path('lp.node')} AS leaf, lp.n, round(lp.p, 6) AS prediction, round(s.mse, 6) AS mse FROM lp LEFT JOIN s ON s.leaf = {sql_path('lp.node')}")
def leaf_table(spark, sf):
    trees, rows = one_model(spark, sf)
    stats = rows.groupBy("leaf").agg(F.avg(F.col("residual") * F.col("residual")).alias("mse"))
    leaves = trees.where("is_leaf").select(F.col("path").alias("leaf"), "n", F.round("prediction", 6).alias("prediction"))
    return leaves.join(stats, "leaf", "left").withColumn("mse", F.round("mse", 6))


PATHS = f"{ONE}, b AS (SELECT * FROM tb0 UNION ALL SELECT * FROM tb1 UNION ALL SELECT * FROM tb2), q AS (SELECT {sql_path('b.node')} AS p, concat('X_', b.f::VARCHAR) AS x, thr FROM b), st AS (SELECT DISTINCT leaf FROM res)"


@query("decision_path", f"{PATHS} SELECT r.qid, r.doc_id, length(q.p)::INT - 1 AS step, x AS feature, substr(r.leaf, length(q.p) + 1, 1) = 'l' AS goes_left FROM res r JOIN q ON starts_with(r.leaf, q.p) AND length(r.leaf) > length(q.p)")
def decision_path(spark, sf):
    trees, rows = one_model(spark, sf)
    return T.decision_path(rows.select("qid", "doc_id", "leaf"), trees, []).select("qid", "doc_id", "step", F.split_part("rule", F.lit(" "), F.lit(1)).alias("feature"), "goes_left")


@query("leaf_rules", f"{PATHS} SELECT st.leaf, count(*) AS tests, string_agg(CASE WHEN substr(st.leaf, length(q.p) + 1, 1) = 'l' THEN x || ' <=' ELSE x || ' >' END, ' & ' ORDER BY length(q.p)) AS shape FROM st JOIN q ON starts_with(st.leaf, q.p) AND length(st.leaf) > length(q.p) GROUP BY st.leaf")
def leaf_rules(spark, sf):
    rules = T.leaf_rules(one_model(spark, sf)[0], [])
    shape = F.regexp_replace("rule", r"(<=|>) [-0-9.E]+", "$1")
    return rules.select("leaf", (F.size(F.split("rule", " & "))).cast("long").alias("tests"), shape.alias("shape"))


# -- two-stage rankers --------------------------------------------------------------------------------------------

E2, Z6 = ["f0", "f1"], ["a0", "a1", "b0", "b1", "d0", "d1"]


def sides(spark, sf, per_model=1):
    df = splits.query_kfold(L.event_lists(spark, sf), 5)
    batches = splits.query_batches(df, per_model)
    df = R.dispatch(df, batches)
    return df.where("fold <> 0").drop("fold"), df.where("fold = 0").drop("fold")


def rtr_sql(per_model=1, k=5, mixed=False, depth=2, euclid_only=False):
    """CTE ``pred``: qid, doc_id, y, leaf, score, correction, euclid of the test fold."""
    batch = "qid" if per_model == 1 else f"(dense_rank() OVER (ORDER BY qid) - 1) // {per_model}"
    key = "m, leaf, qid" if mixed else "m, leaf"
    kj = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    sub = lambda s: f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n_, row_number() OVER (PARTITION BY {key} ORDER BY {sql_dice('qid', 'doc_id', salt=s)}, qid, doc_id) AS o_ FROM st) WHERE o_ <= ceil(n_ * 0.5::DOUBLE))"
    z = "a.f0 AS a0, a.f1 AS a1, b.f0 AS b0, b.f1 AS b1, abs(a.f0 - b.f0) AS d0, abs(a.f1 - b.f1) AS d1"
    base = f"""WITH {EV}, fo AS (SELECT *, {batch} AS m, ntile(5) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM ev), tr_ AS (SELECT * FROM fo WHERE fold <> 0), te_ AS (SELECT * FROM fo WHERE fold = 0),
{tree_sql('s', 'tr_', ['m'], E2, 'y', depth)}, sp AS (SELECT m, node, avg(y) AS p FROM sr{depth} GROUP BY m, node), {walk_sql('s', 'w', 'te_', ['m'], E2, depth)},
st AS (SELECT r.m, r.qid, r.doc_id, r.y, r.f0, r.f1, r.node AS leaf, y - p AS value FROM sr{depth} r JOIN sp ON r.m = sp.m AND r.node = sp.node),
te AS (SELECT w.m, w.qid, w.doc_id, w.y, w.f0, w.f1, w.node AS leaf, p AS score FROM w{depth} w JOIN sp ON w.m = sp.m AND w.node = sp.node),
met AS (SELECT a.m, a.leaf, a.qid, a.doc_id, b.qid AS nq, b.doc_id AS nd, b.value, sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) AS e, {z} FROM te a JOIN st b ON {kj('a', 'b')}),
eu AS (SELECT qid, doc_id, avg(value) AS c FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(e, 9), nq, nd) <= {k}) GROUP BY 1, 2)"""
    if euclid_only:
        return f"{base}, pred AS (SELECT te.qid, te.doc_id, te.y, {sql_path('te.leaf')} AS leaf, score, score + coalesce(eu.c, 0) AS euclid FROM te LEFT JOIN eu ON eu.qid = te.qid AND eu.doc_id = te.doc_id)"
    return f"""{base},
pr AS (SELECT a.m, a.leaf, a.qid, {z}, pow(a.value - b.value, 2) AS t FROM {sub('a')} a JOIN {sub('b')} b ON {kj('a', 'b')}),
{tree_sql('p', 'pr', key.split(', '), Z6, 't', 2)}, pp AS (SELECT {key}, node, avg(t) AS d FROM pr2 GROUP BY {key}, node), {walk_sql('p', 'x', 'met', key.split(', '), Z6, 2)},
nn AS (SELECT x.*, pp.d FROM x2 x JOIN pp ON {kj('x', 'pp')} AND x.node = pp.node),
nk AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(d, 9), nq, nd) AS rank FROM nn),
co AS (SELECT qid, doc_id, avg(value) AS c FROM nk WHERE rank <= {k} GROUP BY 1, 2),
pred AS (SELECT te.qid, te.doc_id, te.y, {sql_path('te.leaf')} AS leaf, score, coalesce(co.c, 0) AS correction, score + coalesce(co.c, 0) AS full_, score + coalesce(eu.c, 0) AS euclid FROM te LEFT JOIN co ON co.qid = te.qid AND co.doc_id = te.doc_id LEFT JOIN eu ON eu.qid = te.qid AND eu.doc_id = te.doc_id)"""


def out6(df, *cols):
    return df.select("qid", "doc_id", *[F.round(c, 6).alias(c) for c in cols])


@query("rtr_score", f"{rtr_sql(euclid_only=True)} SELECT qid, doc_id, leaf, round(score, 6) AS score FROM pred")
def rtr_score(spark, sf):
    train, test = sides(spark, sf)
    r = R.fit(train, R.Config(distance_depth=None))
    return r.stage1(test).select("qid", "doc_id", "leaf", F.round("score", 6).alias("score"))


@query("rtr_euclid", f"{rtr_sql(euclid_only=True)} SELECT qid, doc_id, round(euclid, 6) AS euclid FROM pred")
def rtr_euclid(spark, sf):
    train, test = sides(spark, sf)
    return out6(R.fit(train, R.Config(distance_depth=None)).predict(test), "euclid")


@query("rtr_default", f"{rtr_sql(euclid_only=True, k=3)} SELECT qid, doc_id, round(euclid, 6) AS full FROM pred")
def rtr_default(spark, sf):
    train, test = sides(spark, sf)
    return out6(R.fit(train, R.Config(distance_depth=None, k=3)).predict(test, euclid=False), "full")


@query("rtr_full", f"{rtr_sql()} SELECT qid, doc_id, leaf, round(score, 6) AS score, round(correction, 6) AS correction, round(full_, 6) AS full, round(euclid, 6) AS euclid FROM pred")
def rtr_full(spark, sf):
    train, test = sides(spark, sf)
    p = R.fit(train, R.Config()).predict(test)
    return p.select("qid", "doc_id", "leaf", *[F.round(c, 6).alias(c) for c in ("score", "correction", "full", "euclid")])


@query("rtr_corr", f"{rtr_sql()} SELECT qid, doc_id, round(correction, 6) AS correction FROM pred")
def rtr_corr(spark, sf):
    train, test = sides(spark, sf)
    return out6(R.fit(train, R.Config()).predict(test, euclid=False), "correction")


@query("query_ranker", f"{rtr_sql(per_model=6)} SELECT qid, doc_id, round(full_, 6) AS full FROM pred")
def query_ranker(spark, sf):
    train, test = sides(spark, sf, 6)
    return out6(R.fit(train, R.Config()).predict(test, euclid=False), "full")


@query("mixed_rtr_full", f"{rtr_sql(per_model=6, mixed=True)} SELECT qid, doc_id, round(score, 6) AS score, round(full_, 6) AS full FROM pred")
def mixed_rtr_full(spark, sf):
    train, test = sides(spark, sf, 6)
    return out6(R.fit(train, R.Config(mixed=True)).predict(test, euclid=False), "score", "full")


@query("knn_correction_leaf", f"{rtr_sql(per_model=6, euclid_only=True)} SELECT qid, doc_id, round(euclid - score, 6) + 0.0 AS correction FROM pred")
def knn_correction_leaf(spark, sf):
    train, test = sides(spark, sf, 6)
    return out6(R.fit(train, R.Config(distance_depth=None)).predict(test), "correction").withColumn("correction", F.col("correction") + 0.0)


@query("knn_correction_leaf_query", f"{rtr_sql(per_model=6, mixed=True, euclid_only=True)} SELECT qid, doc_id, round(euclid - score, 6) + 0.0 AS correction FROM pred")
def knn_correction_leaf_query(spark, sf):
    train, test = sides(spark, sf, 6)
    return out6(R.fit(train, R.Config(distance_depth=None, mixed=True)).predict(test), "correction").withColumn("correction", F.col("correction") + 0.0)


@query("knn_pdt_baseline", f"{rtr_sql(depth=0)} SELECT qid, doc_id, round(full_, 6) AS full FROM pred")
def knn_pdt_baseline(spark, sf):
    train, test = sides(spark, sf)
    return out6(R.fit(train, R.Config(depth=0)).predict(test, euclid=False), "full")


@query("pdt_predict", f"{rtr_sql()} SELECT qid, doc_id, nd AS neighbour, rank, round(d, 6) AS d FROM nk WHERE rank <= 5")
def pdt_predict(spark, sf):
    train, test = sides(spark, sf)
    r = R.fit(train, R.Config())
    return r.neighbours(r.stage1(test)).select("qid", "doc_id", "neighbour", "rank", F.round("d", 6).alias("d"))


@query("dispatch_model", f"WITH {EV} SELECT qid, doc_id, (dense_rank() OVER (ORDER BY qid) - 1) // 6 AS model_key FROM ev")
def dispatch_model(spark, sf):
    df = L.event_lists(spark, sf)
    return R.dispatch(df, splits.query_batches(df, 6)).select("qid", "doc_id", "model_key")


@query("rtr_variants", f"{rtr_sql()}, v AS (SELECT qid, doc_id, y, unnest(['full', 'score', 'euclid']) AS variant, unnest([full_, score, euclid]) AS s FROM pred) SELECT qid, doc_id, variant, round(s, 6) AS s FROM v")
def rtr_variants(spark, sf):
    train, test = sides(spark, sf)
    p = R.fit(train, R.Config()).predict(test)
    return p.unpivot(["qid", "doc_id"], ["full", "score", "euclid"], "variant", "s").withColumn("s", F.round("s", 6))


@query("prediction_decomposition", f"{rtr_sql()} SELECT qid, doc_id, y AS target, round(score, 6) AS score, round(correction, 6) AS correction, round(full_, 6) AS full, round(abs(y - score), 6) AS score_error, round(abs(y - full_), 6) AS full_error FROM pred")
def prediction_decomposition(spark, sf):
    train, test = sides(spark, sf)
    p = R.fit(train, R.Config()).predict(test, euclid=False)
    p = p.withColumn("target", F.col("y")).withColumn("score_error", F.abs(F.col("y") - F.col("score"))).withColumn("full_error", F.abs(F.col("y") - F.col("full")))
    return out6(p, "target", "score", "correction", "full", "score_error", "full_error")


@query("explain_local", f"{rtr_sql()}, nb AS (SELECT qid, doc_id, string_agg(nd::VARCHAR, ',' ORDER BY rank) AS kneighbors FROM nk WHERE rank <= 5 GROUP BY 1, 2) SELECT p.qid, p.doc_id, leaf AS shallow_path, length(leaf)::BIGINT - 1 AS tests, round(score, 6) AS shallow_score, round(correction, 6) AS correction, coalesce(kneighbors, '') AS kneighbors FROM pred p LEFT JOIN nb ON p.qid = nb.qid AND p.doc_id = nb.doc_id")
def explain_local(spark, sf):
    train, test = sides(spark, sf)
    e = R.explain(R.fit(train, R.Config()), test)
    near = F.array_join(F.transform("neighbours", lambda n: n["neighbour"].cast("string")), ",")
    return e.select("qid", "doc_id", "shallow_path", F.size("rule_shallow").cast("long").alias("tests"), F.round("shallow_score", 6).alias("shallow_score"), F.round("correction", 6).alias("correction"), F.coalesce(near, F.lit("")).alias("kneighbors"))


@query("pdt_rules", f"{rtr_sql()} SELECT qid, doc_id, nd AS neighbour, length({sql_path('node')})::BIGINT - 1 AS tests, {sql_path('node')} AS pair_leaf FROM nk WHERE rank <= 5")
def pdt_rules(spark, sf):
    train, test = sides(spark, sf)
    r = R.fit(train, R.Config())
    near = r.neighbours(r.stage1(test)).select(*r.leaf_keys, "qid", "doc_id", "neighbour", F.col("pair_leaf").alias("pl"))
    steps = T.decision_path(near.withColumnRenamed("leaf", "stage1_leaf").withColumn("leaf", F.col("pl")), r.distances.withColumnRenamed("leaf", "stage1_leaf"), ["model_key", "stage1_leaf"])
    tests = steps.groupBy("qid", "doc_id", "neighbour").agg(F.count("*").alias("tests"))
    return near.join(tests, ["qid", "doc_id", "neighbour"], "left").select("qid", "doc_id", "neighbour", F.coalesce("tests", F.lit(0)).cast("long").alias("tests"), F.col("pl").alias("pair_leaf"))


# -- rule cards ---------------------------------------------------------------------------------------------------

NAMES = ["value", "hour"]


def card_pairs(spark, sf):
    return event_pairs(spark, sf).select("qid", F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), vectors.pair_features(*ab()).alias("features"), F.pow(F.col("y_a") - F.col("y_b"), 2).alias("target"))


@query("gam_fit")
def gam_fit(spark, sf):
    return C.fit_lists(L.event_lists(spark, sf), ["qid"]).select("qid", "round", "node", "is_leaf", "feature", F.round("threshold", 6).alias("threshold"), F.round("prediction", 6).alias("prediction"), "support")


@query("rulecard_predict")
def rulecard_predict(spark, sf):
    lists = L.event_lists(spark, sf)
    return C.predict_lists(lists, C.fit_lists(lists, ["qid"]), ["qid"]).select("qid", "a", "b", F.round("distance", 6).alias("distance"))


@query("rulecard_rules")
def rulecard_rules(spark, sf):
    rules = C.fit_lists(L.event_lists(spark, sf), ["qid"])
    return C.rule_list(rules, ["qid"], C.readable(NAMES)).withColumn("weight", F.round("weight", 6))


@query("rulecard_fallback", f"{PAIRS} SELECT qid, a, b, round((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1), 6) AS distance FROM p")
def rulecard_fallback(spark, sf):
    pairs = card_pairs(spark, sf)
    none = spark.createDataFrame([], f"qid long, {C.RULES}")
    return C.predict(pairs, none, ["qid"], 2).select("qid", "a", "b", F.round("distance", 6).alias("distance"))


@query("rulecard_ranker")
def rulecard_ranker(spark, sf):
    train, test = sides(spark, sf)
    p = R.fit(train, R.Config(card=C.CardConfig(depth=2))).predict(test, euclid=False)
    return out6(p, "score", "correction", "full")


# -- rankers ------------------------------------------------------------------------------------------------------


def halves(spark, sf):
    """Four fifths of each user's events, and the last fifth."""
    df = splits.query_kfold(L.event_lists(spark, sf), 5)
    return df.where("fold <> 4").drop("fold"), df.where("fold = 4").drop("fold")


#: Lambdas at the scores f0 / 100: pairs of a query with one of its 10 best, in SQL.
LAMBDAS = f"""WITH {EV}, s AS (SELECT *, f0 / 100 AS s, row_number() OVER (PARTITION BY qid ORDER BY round(f0 / 100, 9) DESC, doc_id) AS r, row_number() OVER (PARTITION BY qid ORDER BY y DESC, doc_id) AS i FROM ev),
d AS (SELECT *, CASE WHEN r <= 10 THEN ln(2) / ln(r + 1) ELSE 0 END AS g FROM s), id AS (SELECT qid, sum(y * ln(2) / ln(i + 1)) AS ideal FROM s WHERE i <= 10 GROUP BY qid),
p AS (SELECT a.qid, a.doc_id AS hi, b.doc_id AS lo, (a.y - b.y) * abs(a.g - b.g) / ideal AS delta, 1 / (1 + exp(a.s - b.s)) AS rho FROM d a JOIN d b ON a.qid = b.qid AND a.y > b.y JOIN id ON id.qid = a.qid WHERE a.r <= 10 OR b.r <= 10),
l AS (SELECT qid, hi AS doc_id, delta * rho AS lam, delta * rho * (1 - rho) AS w FROM p UNION ALL SELECT qid, lo, -delta * rho, delta * rho * (1 - rho) FROM p)"""


@query("lambda_gradients", f"{LAMBDAS} SELECT ev.qid, ev.doc_id, round(coalesce(sum(lam), 0), 6) + 0.0 AS lam, round(coalesce(sum(w), 0), 6) + 0.0 AS weight FROM ev LEFT JOIN l ON l.qid = ev.qid AND l.doc_id = ev.doc_id GROUP BY ALL")
def lambda_gradients(spark, sf):
    scored = L.event_lists(spark, sf).withColumn("s", F.col("features")[0] / 100)
    return B.lambdas(scored, 10).select("qid", "doc_id", (F.round("lam", 6) + 0.0).alias("lam"), (F.round("weight", 6) + 0.0).alias("weight"))


@query("lambdamart")
def lambdamart(spark, sf):
    train, test = halves(spark, sf)
    return out6(B.predict(test, B.fit(train)), "score")


@query("lambdamart_ndcg")
def lambdamart_ndcg(spark, sf):
    train, test = halves(spark, sf)
    out = None
    for name, config in (("lambdamart", B.Boost()), ("stump", B.Boost(rounds=1, depth=1))):
        scored = B.predict(test, B.fit(train, config)).withColumn("score", F.round("score", 9))
        part = M.summary(M.ndcg(scored, "score", [5, 10]), ["k"]).select(F.lit(name).alias("model"), "k", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])
        out = part if out is None else out.unionByName(part)
    return out


@query("mart_per_batch")
def mart_per_batch(spark, sf):
    train, test = sides(spark, sf, 6)
    return out6(B.predict(test, B.fit(train, B.Boost(objective="squared"), ["model_key"]), ["model_key"]), "score")


@query("random_forest_oob")
def random_forest_oob(spark, sf):
    df = L.event_lists(spark, sf)
    return out6(B.forest_scores(df, B.grow_forest(df, 20, 4, 1), out_of_bag=True), "score")


@query("listnet_model_selection")
def listnet_model_selection(spark, sf):
    df = splits.query_kfold(L.event_lists(spark, sf), 5)
    df = R.dispatch(df, splits.query_batches(df, 6))
    parts = {"train": df.where("fold < 3"), "valid": df.where("fold = 3"), "test": df.where("fold = 4")}
    best = LN.listnet_selection(parts, [0.01, 0.1, 1.0], [5, 20, 50], ["model_key"])
    return r6(best, "train", "valid", "test")


ADARANK = f"""WITH {EV}, v AS (SELECT qid * 2 + f AS qid, doc_id, y, v FROM (SELECT qid, doc_id, y, unnest([0, 1]) AS f, unnest([f0, f1]) AS v FROM ev)), {ndcg_sql([10], 'v', 'v')},
e AS (SELECT qid % 2 AS f, avg(ndcg) AS e FROM ndcg GROUP BY 1)"""


@query("adarank_first", f"{ADARANK} SELECT 1 AS round, f::INT AS feature, round(0.5 * ln((1 + e) / (1 - e)), 6) AS alpha FROM e QUALIFY row_number() OVER (ORDER BY round(e, 9) DESC, f) = 1")
def adarank_first(spark, sf):
    return r6(LN.adarank(L.event_lists(spark, sf), 1), "alpha")


@query("adarank")
def adarank(spark, sf):
    train, test = halves(spark, sf)
    return out6(LN.adarank_scores(test, LN.adarank(train, 6)), "score")


#: What a document counts for among its query's pairs, each of the same weight.
COUNTS = f"WITH {EV}, p AS (SELECT a.qid, a.doc_id, sum((a.y > b.y)::INT) AS better, sum((a.y < b.y)::INT) AS worse FROM ev a JOIN ev b ON a.qid = b.qid GROUP BY 1, 2)"


@query("pair_counts", f"{COUNTS} SELECT qid, doc_id, round((better - worse)::DOUBLE, 6) AS count, round(better::DOUBLE, 6) AS better FROM p")
def pair_counts(spark, sf):
    rows = L.event_lists(spark, sf).select("qid", "doc_id", "y", F.lit(0.0).alias("h"))
    return PW.pair_counts(rows).select("qid", "doc_id", F.round("count", 6).alias("count"), F.round("better", 6).alias("better"))


@query("rankboost")
def rankboost(spark, sf):
    train, test = halves(spark, sf)
    return out6(PW.rankboost_scores(test, PW.rankboost(train, 8)), "score")


@query("coordinate_ascent")
def coordinate_ascent(spark, sf):
    train, test = halves(spark, sf)
    return out6(PW.linear_scores(test, PW.coordinate_ascent(train, 2, 2)), "score")


@query("least_squares", f"""WITH {EV}, c AS (SELECT qid, covar_pop(f0, y) AS a, covar_pop(f1, y) AS b, covar_pop(f0, f1) AS k, var_pop(f0) AS u, var_pop(f1) AS v, avg(f0) AS m0, avg(f1) AS m1, avg(y) AS my FROM ev GROUP BY qid),
w AS (SELECT *, (a * v - b * k) / (u * v - k * k) AS w0, (b * u - a * k) / (u * v - k * k) AS w1 FROM c) SELECT qid, round(w0, 5) + 0.0 AS w0, round(w1, 5) + 0.0 AS w1, round(my - w0 * m0 - w1 * m1, 5) + 0.0 AS intercept FROM w""")
def least_squares(spark, sf):
    w = LN.least_squares(L.event_lists(spark, sf), keys=["qid"])
    return w.select("qid", *[(F.round(F.col("weights")[i], 5) + 0.0).alias(n) for i, n in enumerate(("w0", "w1", "intercept"))])


# -- clustering and generators ------------------------------------------------------------------------------------


@query("query_groups")
def query_groups(spark, sf):
    from rankloom.operators.clustering import greedy_query_groups, query_embeddings

    return greedy_query_groups(query_embeddings(L.event_lists(spark, sf)), 8)


@query("greedy_groups")
def greedy(spark, sf):
    from rankloom.operators.clustering import greedy_query_groups

    vectors_ = L.lineitem_lists(spark, sf).groupBy("qid").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(5)]).alias("features"))
    return greedy_query_groups(vectors_, 5)


@query("synthetic_ltr")
def synthetic_ltr(spark, sf):
    from rankloom.operators.synthetic import generate

    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    return generate(spark, users, 40, 10).select("qid", "doc_id", "y", F.round(F.col("features")[0], 6).alias("f0"))


@query("hidden_linear_lists")
def hidden_linear_lists(spark, sf):
    from rankloom.operators.synthetic import hidden_linear

    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    return r6(hidden_linear(spark, users).drop("features"), "linear_score")


@query("ranker_comparison")
def ranker_comparison(spark, sf):
    train, test = halves(spark, sf)
    out = None
    for kind, settings in (("tree", {}), ("lambdamart", {"rounds": 10}), ("mart", {"rounds": 10}), ("listnet", {"rate": 1.0, "epochs": 20}), ("rankboost", {"rounds": 5}), ("least_squares", {}), ("random", {})):
        model = MO.Model(kind, settings).fit(train)
        scored = model.predict(test).withColumn("score", F.round("score", 9))
        part = M.summary(M.ndcg(scored, "score", [5, 10]), ["k"]).select(F.lit(kind).alias("model"), "k", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])
        out = part if out is None else out.unionByName(part)
    return out


# -- selection ----------------------------------------------------------------------------------------------------

EXP = """exp AS (SELECT l_returnflag AS dataset, l_linestatus AS model, l_suppkey AS query, l_linenumber % 3 AS pdt_depth, CASE WHEN CAST(l_quantity AS BIGINT) % 4 < 3 THEN CAST(l_quantity AS BIGINT) % 4 END AS n_neighbors, l_tax > 0.04 AS feature_diff, l_discount * 10 AS ndcg FROM lineitem)"""
CFG = ["pdt_depth", "n_neighbors", "feature_diff"]


def experiments(spark, sf):
    q = F.col("l_quantity").cast("long") % 4
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), F.col("l_suppkey").alias("query"), (F.col("l_linenumber") % 3).alias("pdt_depth"), F.when(q < 3, q).alias("n_neighbors"), (F.col("l_tax") > 0.04).alias("feature_diff"), (F.col("l_discount") * 10).alias("ndcg"))


MS = f"WITH {EXP}, c AS (SELECT query, pdt_depth::BIGINT AS pdt_depth, round(avg(ndcg), 9) AS result FROM exp GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pdt_depth) - 1 AS idx FROM c)"


def selection_rows(spark, sf):
    """query, configs, results, idx_best: as a selection run writes them."""
    each = experiments(spark, sf).groupBy("query", F.col("pdt_depth").cast("long").alias("pdt_depth")).agg(F.round(F.avg("ndcg"), 9).alias("result"))
    rows = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pdt_depth", "result"))).alias("r"))
    results = F.transform("r", lambda x: x["result"])
    return rows.select("query", F.transform("r", lambda x: F.struct(x["pdt_depth"].alias("pdt_depth"))).alias("configs"), results.alias("results"), (F.array_position(results, F.array_max(results)) - 1).cast("int").alias("idx_best"))


def stored_selection(spark, sf):
    """The same rows as a run leaves them: a JSON file, read back."""
    at = new_path(spark)
    RS.write_json(selection_rows(spark, sf).withColumn("qxm", F.lit(1)).withColumn("query", F.array("query")), at)
    return RS.read_selection(spark, at, "pdt_depth: bigint", multi_line=False)


@query("argmax_config", f"{MS} SELECT query, idx, pdt_depth, round(result, 6) AS result FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY result DESC, idx) = 1")
def argmax_config(spark, sf):
    best = S.argmax(S.explode_results(selection_rows(spark, sf)), ["query"], "result", "idx")
    return best.select("query", "idx", F.col("config.pdt_depth").alias("pdt_depth"), F.round("result", 6).alias("result"))


@query("pick_best_config", f"{MS} SELECT pdt_depth, count(*) AS n, min(query) AS first_query FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY result DESC, idx) = 1) GROUP BY pdt_depth")
def pick_best_config(spark, sf):
    groups = RS.query_configs(stored_selection(spark, sf)).select(F.explode("groups").alias("g"))
    return groups.groupBy("g.config.pdt_depth").agg(F.count("*").alias("n"), F.min(F.col("g.query")[0]).alias("first_query"))


@query("drop_tied_results", f"{MS} SELECT query FROM x GROUP BY query HAVING count(DISTINCT result) > 1")
def drop_tied_results(spark, sf):
    return S.drop_tied(selection_rows(spark, sf)).select("query")


@query("config_distribution", f"WITH {EXP}, n AS (SELECT dataset, pdt_depth, count(*) AS n FROM exp GROUP BY 1, 2) SELECT dataset, pdt_depth, n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, pdt_depth) <= 12")
def config_distribution(spark, sf):
    return S.distribution(experiments(spark, sf), ["dataset"], "pdt_depth").withColumn("share", F.round("share", 6))


@query("best_conf_per_metric", f"WITH {EXP}, c AS (SELECT pdt_depth, round(avg(ndcg), 9) AS ndcg_5, round(avg(-ndcg), 9) AS ndcg_10, round(max(ndcg), 9) AS ndcg_15 FROM exp GROUP BY 1), l AS (SELECT pdt_depth, unnest(['ndcg_5', 'ndcg_10', 'ndcg_15']) AS metric, unnest([ndcg_5, ndcg_10, ndcg_15]) AS value FROM c) SELECT metric, pdt_depth, round(value, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, pdt_depth) = 1")
def best_conf_per_metric(spark, sf):
    c = experiments(spark, sf).groupBy("pdt_depth").agg(F.round(F.avg("ndcg"), 9).alias("ndcg_5"), F.round(F.avg(-F.col("ndcg")), 9).alias("ndcg_10"), F.round(F.max("ndcg"), 9).alias("ndcg_15"))
    return S.best_per_metric(c, "pdt_depth", ["ndcg_5", "ndcg_10", "ndcg_15"]).withColumn("value", F.round("value", 6))


@query("best_results_view", f"{MS}, b AS (SELECT query, list(result ORDER BY idx) AS r, max(idx) + 1 AS k FROM x GROUP BY query) SELECT query, k, round(r[1], 6) AS train, round(r[2], 6) AS valid, round(r[3], 6) AS test FROM b ORDER BY query, k DESC")
def best_results_view(spark, sf):
    at = new_path(spark)
    rows = selection_rows(spark, sf).select(F.col("query").cast("int").alias("qxm"), F.size("results").alias("eval_k"), F.col("results").alias("result"))
    RS.write_json(rows, at)
    part = lambda c: F.round(c, 6).alias(c)
    return RS.read_best_results(spark, at, multi_line=False).select(F.col("qxm").cast("long").alias("query"), F.col("eval_k").cast("long").alias("k"), part("train"), part("valid"), part("test"))


GRID = [R.Config(depth=1, distance_depth=None, k=3), R.Config(depth=1, distance_depth=None, k=7)]
#: Learned distances with two objectives, and Euclid.
LEARNED = [R.Config(depth=1, k=3), R.Config(depth=1, k=3, objective="dist"), R.Config(depth=1, distance_depth=None, k=3)]
SIZES = [1, 8]


def groups_sql(sizes, source="ev"):
    """CTE ``ba``: qxm, batch, qid, batches whose sizes differ by one at most."""
    part = lambda n: f"SELECT {n}::BIGINT AS qxm, qid, CASE WHEN place < (n % k) * (n // k + 1) THEN place // (n // k + 1) ELSE n % k + (place - (n % k) * (n // k + 1)) // (n // k) END AS batch FROM (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place, count(*) OVER () AS n, CAST(ceil(count(*) OVER () / {n}.0) AS BIGINT) AS k FROM (SELECT DISTINCT qid FROM {source}))"
    return f"ba AS ({' UNION ALL '.join(map(part, sizes))})"


def euclid_sql(p, train, test, ks=(3, 7), depth=1):
    """CTEs up to {p}sc: m, qid, doc_id, y, k, s, the score with the mean of the k nearest in the leaf, for models m."""
    return f"""{tree_sql(p, train, ['m'], E2, 'y', depth)}, {p}pp AS (SELECT m, node, avg(y) AS p FROM {p}r{depth} GROUP BY m, node), {walk_sql(p, p + 'w', test, ['m'], E2, depth)},
{p}st AS (SELECT r.m, r.qid, r.doc_id, r.f0, r.f1, r.node, y - p AS value FROM {p}r{depth} r JOIN {p}pp t ON r.m = t.m AND r.node = t.node),
{p}te AS (SELECT r.m, r.qid, r.doc_id, r.y, r.f0, r.f1, r.node, p AS score FROM {p}w{depth} r JOIN {p}pp t ON r.m = t.m AND r.node = t.node),
{p}nn AS (SELECT a.m, a.qid, a.doc_id, b.value, row_number() OVER (PARTITION BY a.m, a.qid, a.doc_id ORDER BY round(sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)), 9), b.qid, b.doc_id) AS rank FROM {p}te a JOIN {p}st b ON a.m = b.m AND a.node = b.node),
{p}ks AS (SELECT unnest({list(ks)})::BIGINT AS k), {p}co AS (SELECT m, qid, doc_id, k, avg(value) AS c FROM {p}nn, {p}ks WHERE rank <= k GROUP BY ALL),
{p}sc AS (SELECT t.m, t.qid, t.doc_id, t.y, x.k, round(t.score + coalesce(c.c, 0), 9) AS s FROM {p}te t CROSS JOIN {p}ks x LEFT JOIN {p}co c ON c.m = t.m AND c.qid = t.qid AND c.doc_id = t.doc_id AND c.k = x.k)"""


def grid_sql(source="ev", folds=3, sizes=SIZES):
    """CTEs up to ``sc``: qxm, batch, fold, k, qid, ndcg of every fold and configuration."""
    return f"""{groups_sql(sizes, source)}, fo AS (SELECT *, ntile({folds}) OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS fold FROM {source}),
al AS (SELECT {{'qxm': qxm, 'batch': batch, 'f': t.f}} AS m, t.f, fo.* FROM fo JOIN ba ON fo.qid = ba.qid CROSS JOIN (SELECT unnest(range({folds})) AS f) t), tr_ AS (SELECT * FROM al WHERE fold <> f), te_ AS (SELECT * FROM al WHERE fold = f),
{euclid_sql('g', 'tr_', 'te_')}, gq AS (SELECT {{'m': m, 'k': k, 'qid': qid}} AS qid, doc_id, y, s FROM gsc), {ndcg_sql([10], 'gq', 's')},
sc AS (SELECT ndcg.qid.m.qxm AS qxm, ndcg.qid.m.batch AS batch, ndcg.qid.m.f AS fold, ndcg.qid.k AS k, ndcg FROM ndcg),
re AS (SELECT qxm, batch, k, round(avg(x), 9) AS result FROM (SELECT qxm, batch, k, fold, avg(ndcg) AS x FROM sc GROUP BY ALL) GROUP BY ALL),
be AS (SELECT qxm, batch, k, result, CASE WHEN k = 3 THEN 0 ELSE 1 END AS idx FROM re QUALIFY row_number() OVER (PARTITION BY qxm, batch ORDER BY result DESC, k) = 1)"""


@query("config_kfold_score", f"WITH {EV}, {grid_sql()} SELECT qxm, k, fold, round(avg(x), 6) AS ndcg FROM (SELECT qxm, batch, k, fold, avg(ndcg) AS x FROM sc GROUP BY ALL) GROUP BY ALL")
def config_kfold_score(spark, sf):
    df = L.event_lists(spark, sf)
    k = F.when(F.col("idx") == 0, GRID[0].k).otherwise(GRID[1].k).cast("long")
    return X.cross_validated(df, X.query_groups(df, SIZES), GRID).groupBy("qxm", k.alias("k"), "fold").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("model_selection", f"WITH {EV}, {grid_sql()} SELECT qxm, batch, idx::INT AS idx_best, round(result, 6) AS result FROM be")
def model_selection(spark, sf):
    table = X.model_selection(L.event_lists(spark, sf), SIZES, GRID)
    return table.select("qxm", "batch", "idx_best", F.round(F.array_max("results"), 6).alias("result"))


@query("model_selection_learned")
def model_selection_learned(spark, sf):
    train, valid = held(spark, sf)
    table = X.model_selection(train, [8], LEARNED, folds=None, valid=valid)
    scores = X.retrain(train, valid, table, LEARNED, (10,))
    best = table.groupBy("idx_best").agg(F.count("*").alias("batches"))
    return best.crossJoin(F.broadcast(scores.select(F.round("mean", 6).alias("mean"))))


HELD = "hs AS (SELECT *, ntile(4) OVER (PARTITION BY qid ORDER BY doc_id) AS part FROM ev), ht AS (SELECT * EXCLUDE part FROM hs WHERE part < 4), hv AS (SELECT * EXCLUDE part FROM hs WHERE part = 4)"


def held(spark, sf):
    """Three quarters of each query's documents, and the last quarter."""
    df = splits.query_kfold(L.event_lists(spark, sf), 4)
    return df.where("fold < 3").drop("fold"), df.where("fold = 3").drop("fold")


@query("holdout_selection", f"""WITH {EV}, {HELD}, {groups_sql(SIZES, 'ht')}, tr_ AS (SELECT {{'qxm': qxm, 'batch': batch}} AS m, ht.* FROM ht JOIN ba ON ht.qid = ba.qid), te_ AS (SELECT {{'qxm': qxm, 'batch': batch}} AS m, hv.* FROM hv JOIN ba ON hv.qid = ba.qid),
{euclid_sql('g', 'tr_', 'te_')}, gq AS (SELECT {{'m': m, 'k': k, 'qid': qid}} AS qid, doc_id, y, s FROM gsc), {ndcg_sql([10], 'gq', 's')},
re AS (SELECT ndcg.qid.m.qxm AS qxm, ndcg.qid.m.batch AS batch, ndcg.qid.k AS k, round(avg(ndcg), 9) AS result FROM ndcg GROUP BY ALL)
SELECT qxm, batch, CASE WHEN k = 3 THEN 0 ELSE 1 END::INT AS idx_best, round(result, 6) AS result FROM re QUALIFY row_number() OVER (PARTITION BY qxm, batch ORDER BY result DESC, k) = 1""")
def holdout_selection(spark, sf):
    train, valid = held(spark, sf)
    table = X.model_selection(train, SIZES, GRID, folds=None, valid=valid)
    return table.select("qxm", "batch", "idx_best", F.round(F.array_max("results"), 6).alias("result"))


@query("final_retrain", f"""WITH {EV}, {HELD}, {grid_sql('ht')},
fr AS (SELECT {{'qxm': be.qxm, 'batch': be.batch}} AS m, ht.* FROM ht JOIN ba ON ht.qid = ba.qid JOIN be ON be.qxm = ba.qxm AND be.batch = ba.batch), fv AS (SELECT {{'qxm': be.qxm, 'batch': be.batch}} AS m, hv.* FROM hv JOIN ba ON hv.qid = ba.qid JOIN be ON be.qxm = ba.qxm AND be.batch = ba.batch),
{euclid_sql('h', 'fr', 'fv')}, hq AS (SELECT s.* FROM hsc s JOIN be ON s.m.qxm = be.qxm AND s.m.batch = be.batch AND s.k = be.k), hz AS (SELECT {{'m': m.qxm, 'qid': qid}} AS qid, doc_id, y, s FROM hq),
fin AS (WITH {ndcg_sql([5, 10], 'hz', 's')} SELECT * FROM ndcg) SELECT fin.qid.m AS qxm, k, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std, round(median(ndcg), 6) AS median FROM fin GROUP BY ALL""")
def final_retrain(spark, sf):
    train, test = held(spark, sf)
    table = X.model_selection(train, SIZES, GRID)
    return X.retrain(train, test, table, GRID, (5, 10)).select("qxm", "k", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@query("query_ranker_configs", f"""WITH {EV}, {HELD}, {groups_sql([6], 'ht')}, ra AS (SELECT batch AS m, ht.* FROM ht JOIN ba ON ht.qid = ba.qid WHERE batch % 2 = 0), va AS (SELECT batch AS m, hv.* FROM hv JOIN ba ON hv.qid = ba.qid WHERE batch % 2 = 0),
rb AS (SELECT batch AS m, ht.* FROM ht JOIN ba ON ht.qid = ba.qid WHERE batch % 2 = 1), vb AS (SELECT batch AS m, hv.* FROM hv JOIN ba ON hv.qid = ba.qid WHERE batch % 2 = 1),
{euclid_sql('u', 'ra', 'va', (3,), 1)}, {euclid_sql('v', 'rb', 'vb', (5,), 2)} SELECT m AS batch, qid, doc_id, round(s, 6) AS full FROM (SELECT * FROM usc UNION ALL SELECT * FROM vsc)""")
def query_ranker_configs(spark, sf):
    train, test = held(spark, sf)
    batches = splits.query_batches(train, 6).withColumn("idx", (F.col("batch") % 2).cast("int"))
    fitted = X.fit_batches(train, batches, [R.Config(depth=1, distance_depth=None, k=3), R.Config(depth=2, distance_depth=None, k=5)])
    return fitted.predict(test, euclid=False).select("batch", "qid", "doc_id", F.round("full", 6).alias("full"))


@query("listnet_select", f"WITH {EXP}, c AS (SELECT query, pdt_depth::BIGINT AS lr, coalesce(n_neighbors, 9) AS epoch, round(coalesce(avg(ndcg), 0), 9) AS valid FROM exp GROUP BY 1, 2, 3) SELECT query, lr, epoch, round(valid, 6) AS valid FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY valid DESC, lr, epoch) = 1")
def listnet_select(spark, sf):
    c = experiments(spark, sf).groupBy("query", F.col("pdt_depth").cast("long").alias("lr"), F.coalesce("n_neighbors", F.lit(9)).alias("epoch")).agg(F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 9).alias("valid"))
    best = S.argmax(c.withColumn("sweep", F.struct("lr", "epoch")), ["query"], "valid", "sweep")
    return best.select("query", "lr", "epoch", F.round("valid", 6).alias("valid"))


# -- experiment tables --------------------------------------------------------------------------------------------

TAB = f"WITH {EXP}, tab AS (SELECT dataset, model, pdt_depth, n_neighbors, feature_diff, avg(ndcg) AS ndcg, stddev_samp(ndcg) AS ndcg_std, count(ndcg) AS n_queries FROM exp GROUP BY ALL)"


def config_frame(spark, sf):
    return A.config_table(experiments(spark, sf), CFG)


def stored_results(spark, sf):
    """The experiments as result files hold them: a row for each run, its configurations and results side by side; read back."""
    out = None
    named = F.struct(*[F.col(c) for c in CFG]).alias("config")
    for d in experiments(spark, sf).select("dataset", "model").distinct().orderBy("dataset", "model").collect():
        own = experiments(spark, sf).where((F.col("dataset") == d["dataset"]) & (F.col("model") == d["model"]))
        rows = own.groupBy("query").agg(F.collect_list(F.struct(named, "ndcg")).alias("z")).select(F.lit(1).alias("qxm"), F.array("query").alias("query"), F.transform("z", lambda x: x["config"]).alias("configs"), F.lit(0).alias("idx_best"), F.transform("z", lambda x: x["ndcg"]).alias("results"))
        at = new_path(spark)
        RS.write_json(rows, at)
        read = RS.config_results(RS.read_selection(spark, at, "pdt_depth: int, n_neighbors: bigint, feature_diff: boolean", multi_line=False), d["dataset"], d["model"])
        out = read if out is None else out.unionByName(read)
    return out


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("config_agg", f"{TAB} SELECT * REPLACE (round(ndcg, 6) AS ndcg, round(ndcg_std, 6) AS ndcg_std) FROM tab")
def config_agg(spark, sf):
    return r6(A.config_table(stored_results(spark, sf), CFG), "ndcg", "ndcg_std")


@query("centered_regret", f"{TAB} SELECT dataset, model, pdt_depth, n_neighbors, feature_diff, round(ndcg - avg(ndcg) OVER w, 6) + 0.0 AS ndcg_centered, round(ndcg - max(ndcg) OVER w, 6) + 0.0 AS regret FROM tab WINDOW w AS (PARTITION BY dataset, model)")
def centered_regret(spark, sf):
    df = r6(A.centred(config_frame(spark, sf)), "ndcg_centered", "regret")
    return df.select("dataset", "model", *CFG, (F.col("ndcg_centered") + 0.0).alias("ndcg_centered"), (F.col("regret") + 0.0).alias("regret"))


@query("active_features", f"{TAB} SELECT 'pdt_depth' AS feature, count(DISTINCT pdt_depth) AS levels FROM tab UNION ALL SELECT 'n_neighbors', count(DISTINCT n_neighbors) + 1 FROM tab UNION ALL SELECT 'feature_diff', count(DISTINCT feature_diff) FROM tab")
def active_features(spark, sf):
    return A.active_features(config_frame(spark, sf).withColumn("fixed", F.lit(1)), [*CFG, "fixed"]).select("feature", F.col("levels").cast("long").alias("levels"))


BLOCKS = "b AS (SELECT {i}, dataset, model, avg({v}) AS v, count(*) AS m FROM {t} GROUP BY ALL), s AS (SELECT {i}, avg(v) AS mean, median(v) AS median, coalesce(stddev_samp(v), 0) AS std, count(v) AS n_blocks, sum(m)::BIGINT AS n_matches FROM b GROUP BY {i})"
STATS = "round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(std / sqrt(n_blocks), 6) AS se, round(1.96 * std / sqrt(n_blocks), 6) AS ci95, n_blocks, n_matches"


@query("summarise_blocks", f"{TAB}, {BLOCKS.format(i='pdt_depth', v='ndcg', t='tab')} SELECT pdt_depth, {STATS} FROM s")
def summarise_blocks(spark, sf):
    return r6(A.summarise_blocks(config_frame(spark, sf), ["pdt_depth"], "ndcg", ["dataset", "model"]), "mean", "median", "std", "se", "ci95")


def effect_sql(f):
    rest = ", ".join(["dataset", "model", *[g for g in CFG if g != f]])
    return f"SELECT dataset, model, '{f}' AS feature, max(v) - min(v) AS effect_range, CASE WHEN count(l) > 1 THEN max_by(v, l) - min_by(v, l) END AS directional_effect FROM (SELECT {rest}, {f} AS l, avg(ndcg) AS v FROM tab GROUP BY ALL) GROUP BY {rest} HAVING count(*) > 1"


@query(
    "main_effects",
    f"""{TAB}, e AS ({' UNION ALL '.join(map(effect_sql, CFG))}), {BLOCKS.format(i='feature', v='effect_range', t='e')},
b2 AS (SELECT feature, dataset, model, avg(directional_effect) AS v, count(*) AS m FROM e WHERE directional_effect IS NOT NULL GROUP BY ALL), s2 AS (SELECT feature, avg(v) AS mean_direction, median(v) AS median_direction, 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)) AS ci95_direction, count(v) AS n_direction_blocks, sum(m)::BIGINT AS n_direction_matches FROM b2 GROUP BY feature)
SELECT s.feature, {STATS}, round(mean_direction, 6) AS mean_direction, round(median_direction, 6) AS median_direction, round(ci95_direction, 6) AS ci95_direction, n_direction_blocks, n_direction_matches FROM s LEFT JOIN s2 ON s.feature = s2.feature""",
)
def main_effects(spark, sf):
    return r6(A.main_effects(config_frame(spark, sf), CFG), "mean", "median", "std", "se", "ci95", "mean_direction", "median_direction", "ci95_direction")


@query("ordered_levels", f"{TAB}, d AS (SELECT DISTINCT feature_diff FROM tab) SELECT feature_diff AS level, row_number() OVER (ORDER BY feature_diff) AS place FROM d")
def ordered_levels(spark, sf):
    return A.ordered_levels(config_frame(spark, sf), "feature_diff")


@query("best_worst_level", f"{TAB}, m AS (SELECT dataset, pdt_depth, round(avg(ndcg), 9) AS v FROM tab GROUP BY 1, 2) SELECT dataset, first(pdt_depth ORDER BY v DESC, pdt_depth) AS best, first(pdt_depth ORDER BY v, pdt_depth) AS worst FROM m GROUP BY dataset")
def best_worst_level(spark, sf):
    m = config_frame(spark, sf).groupBy("dataset", "pdt_depth").agg(F.round(F.avg("ndcg"), 9).alias("v"))
    return A.best_worst(m, ["dataset"], "pdt_depth", "v")


RESULT = f"WITH {EXP}, res AS (SELECT dataset, 'm' || pdt_depth::VARCHAR AS model, coalesce(n_neighbors, 9) AS qxm, round(avg(ndcg), 9) AS mean, stddev_pop(ndcg) AS std, median(ndcg) AS median FROM exp GROUP BY 1, 2, 3)"


def results(spark, sf):
    m = F.concat(F.lit("m"), F.col("pdt_depth").cast("string"))
    return experiments(spark, sf).groupBy("dataset", m.alias("model"), F.coalesce("n_neighbors", F.lit(9)).alias("qxm")).agg(F.round(F.avg("ndcg"), 9).alias("mean"), F.stddev_pop("ndcg").alias("std"), F.percentile("ndcg", F.lit(0.5)).alias("median"))


@query("result_filter", f"{RESULT} SELECT dataset, model, round(mean, 6) AS mean, round(median, 6) AS median FROM res WHERE qxm = 1 AND model IN ('m0', 'm2')")
def result_filter(spark, sf):
    return r6(results(spark, sf).where("qxm = 1").where(F.col("model").isin("m0", "m2")).select("dataset", "model", "mean", "median"), "mean", "median")


@query("result_rename", f"{RESULT} SELECT dataset, CASE model WHEN 'm0' THEN 'Tree' WHEN 'm1' THEN 'Mixed' ELSE model END AS model, qxm, replace(dataset || '_x', '_', '-') AS label, round(std, 6) AS std FROM res")
def result_rename(spark, sf):
    return results(spark, sf).select("dataset", text.mapped(F.col("model"), {"m0": "Tree", "m1": "Mixed"}).alias("model"), "qxm", F.replace(F.concat("dataset", F.lit("_x")), F.lit("_"), F.lit("-")).alias("label"), F.round("std", 6).alias("std"))


@query("is_best", f"{RESULT} SELECT dataset, model, qxm, mean = max(mean) OVER (PARTITION BY dataset, qxm) AS is_best FROM res")
def is_best(spark, sf):
    return A.is_best(results(spark, sf), ["dataset", "qxm"], "mean").select("dataset", "model", "qxm", "is_best")


@query("result_pivot", f"{RESULT}, v AS (SELECT qxm, model, printf('%.3f', avg(mean)) AS c FROM res GROUP BY 1, 2) SELECT qxm, max(CASE WHEN model = 'm0' THEN c END) AS m0, max(CASE WHEN model = 'm1' THEN c END) AS m1, max(CASE WHEN model = 'm2' THEN c END) AS m2 FROM v GROUP BY qxm")
def result_pivot(spark, sf):
    cells = results(spark, sf).groupBy("qxm", "model").agg(F.format_string("%.3f", F.avg("mean")).alias("c"))
    return A.pivot(cells, ["qxm"], "model", ["m0", "m1", "m2"], "c")


@query("baseline_delta", f"{RESULT} SELECT r.dataset, r.qxm, r.model, round(r.mean - b.mean, 6) AS delta FROM res r LEFT JOIN res b ON r.dataset = b.dataset AND r.qxm = b.qxm AND b.model = 'm0' WHERE r.model <> 'm0'")
def baseline_delta(spark, sf):
    return r6(A.baseline_delta(results(spark, sf), "m0"), "delta").select("dataset", "qxm", "model", "delta")


@query("listnet_summary", f"WITH {EXP}, g AS (SELECT query, n_neighbors AS qxm, list(ndcg) AS a, list(ndcg / 2) AS b FROM exp GROUP BY 1, 2), l AS (SELECT qxm, unnest(a) AS training, unnest(b) AS test FROM g), u AS (SELECT qxm, 'training' AS fold, training AS v FROM l UNION ALL SELECT qxm, 'test', test FROM l) SELECT qxm, fold, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std FROM u GROUP BY 1, 2")
def listnet_summary(spark, sf):
    g = experiments(spark, sf).groupBy("query", F.col("n_neighbors").alias("qxm")).agg(F.collect_list("ndcg").alias("training"))
    rows = g.withColumn("test", F.transform("training", lambda v: v / 2)).select("qxm", F.explode(F.arrays_zip("training", "test")).alias("z")).select("qxm", "z.*")
    long = rows.unpivot("qxm", ["training", "test"], "fold", "v")
    return long.groupBy("qxm", "fold").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query("comparison_qxm", f"{rtr_sql(euclid_only=True)}, {ndcg_sql([5, 10], 'pred', 'score')} SELECT 1::BIGINT AS qxm, 'model_score' AS model, k, round(avg(ndcg), 6) AS mean FROM ndcg GROUP BY k")
def comparison_qxm(spark, sf):
    train, test = sides(spark, sf)
    p = R.fit(train, R.Config(distance_depth=None)).stage1(test)
    return M.comparison(p, ["score"], [5, 10]).select(F.lit(1).cast("long").alias("qxm"), F.concat(F.lit("model_"), F.col("model")).alias("model"), "k", F.round("mean", 6).alias("mean"))
