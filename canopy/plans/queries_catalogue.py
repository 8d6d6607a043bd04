"""Queries of the catalogue, hierarchy, join and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import forest as G
from ..operators import ledger as K
from ..sources import files
from ..sources.scratch import scratch_path, stored
from . import views as V
from .registry import ORACLES, query
from .views import LEVELS, catalogue, pred, table, with_views


@query(with_views("catalogue", """, b AS (SELECT * FROM catalogue WHERE "set" NOT IN ('0') AND "set" IN ('1','2','3','4','5','6') AND top IN ('0','1','2'))
SELECT id, leaf, mid, top, "set" FROM b WHERE leaf IN (SELECT leaf FROM b GROUP BY leaf HAVING count(*) >= 5)"""))
def filter_catalogue(spark, d):
    return C.filter_catalogue(catalogue(spark, d), LEVELS, ["0"], list("123456"), 5, ["0", "1", "2"]).select("id", "leaf", "mid", "top", "set")


@query(with_views("catalogue", "SELECT leaf || '/' || filename AS image_path, \"set\" = '1' AS is_valid, leaf, mid, top FROM catalogue"))
def prepare(spark, d):
    return C.prepare(catalogue(spark, d), LEVELS)


@query(with_views("catalogue", "SELECT id, leaf || ' ' || mid || ' ' || top AS lineage FROM catalogue"))
def hierarchy_label(spark, d):
    return C.hierarchy_label(catalogue(spark, d), LEVELS).select("id", "lineage")


@query(with_views("catalogue", ", v AS (SELECT DISTINCT leaf FROM catalogue WHERE \"set\" = '0') SELECT id, leaf FROM catalogue WHERE leaf IN (SELECT leaf FROM v)"))
def known_only(spark, d):
    c = catalogue(spark, d)
    return C.known_only(c, C.build_vocab(c.where("set = '0'"), ["leaf"]), "leaf").select("id", "leaf")


@query(with_views("catalogue", ", v AS (SELECT DISTINCT leaf FROM catalogue WHERE \"set\" = '0') SELECT known_label, count(*) AS n FROM (SELECT leaf IN (SELECT leaf FROM v) AS known_label FROM catalogue) GROUP BY 1"))
def flag_known(spark, d):
    c = catalogue(spark, d)
    return C.flag_known(c, C.build_vocab(c.where("set = '0'"), ["leaf"]), "leaf").groupBy("known_label").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('R'))")
def filter_detections(spark, d):
    return C.filter_detections(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["R"], F.col("l_quantity") >= 25).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def normalise_keys(spark, d):
    return C.normalise_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query(with_views("catalogue", "SELECT id, '../other/' || filename AS filename FROM catalogue"))
def rewrite_paths(spark, d):
    return C.rewrite_paths(catalogue(spark, d).select("id", "filename"), "../other/")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey LIMIT 100")
def limit_random(spark, d):
    return C.limit_random(table(spark, d, "orders"), 100, "o_orderkey", 7).select("o_orderkey", "o_custkey")


VOCAB = """, v AS (SELECT level, class, row_number() OVER (PARTITION BY level ORDER BY class) - 1 AS idx FROM (SELECT DISTINCT 'leaf' AS level, leaf AS class FROM catalogue UNION SELECT 'mid', mid FROM catalogue UNION SELECT 'top', top FROM catalogue)),
 hier AS (SELECT leaf, arg_min(mid, id) AS mid, arg_min(top, id) AS top FROM catalogue GROUP BY leaf)
"""


@query(with_views("catalogue", VOCAB + "SELECT level, class, CAST(idx AS INT) AS idx FROM v"))
def build_vocab(spark, d):
    return C.build_vocab(catalogue(spark, d), LEVELS)


def hier_of(spark, d):
    return C.build_hierarchy(catalogue(spark, d), LEVELS, "id")


@query(with_views("catalogue", VOCAB + "SELECT leaf, mid, top FROM hier"))
def build_hierarchy(spark, d):
    return hier_of(spark, d)


@query(with_views("catalogue", VOCAB + "SELECT leaf, mid, top FROM hier"))
def hierarchy_nested_round_trip(spark, d):
    return C.hierarchy_from_nested(C.hierarchy_nested(hier_of(spark, d), LEVELS), LEVELS)


@query(with_views("catalogue", VOCAB + """SELECT 'leaf' AS level, CAST(a.idx AS INT) AS child_idx, CAST(b.idx AS INT) AS parent_idx FROM v a JOIN hier ON a.level = 'leaf' AND a.class = leaf JOIN v b ON b.level = 'mid' AND b.class = mid
UNION ALL SELECT 'mid', CAST(a.idx AS INT), CAST(b.idx AS INT) FROM v a JOIN (SELECT DISTINCT mid, top FROM hier) ON a.level = 'mid' AND a.class = mid JOIN v b ON b.level = 'top' AND b.class = top"""))
def parent_map(spark, d):
    return C.parent_map(hier_of(spark, d), C.build_vocab(catalogue(spark, d), LEVELS), LEVELS)


@query("SELECT * FROM (VALUES ('leaf', 'conflict', 0), ('leaf', 'missing', 0), ('mid', 'conflict', 0), ('mid', 'missing', 0)) t(level, problem, n)")
def check_parents(spark, d):
    return C.check_parents(hier_of(spark, d), C.build_vocab(catalogue(spark, d), LEVELS), LEVELS)


TAXA = VOCAB + ", taxa AS (SELECT 0 AS level, leaf AS taxon, leaf, mid, top FROM hier UNION SELECT 1, mid, NULL, mid, top FROM hier UNION SELECT 2, top, NULL, NULL, top FROM hier)\n"


@query(with_views("catalogue", TAXA + "SELECT t.taxon, level, leaf, mid, top FROM taxa t JOIN (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS taxon FROM lineitem) USING (taxon)"))
def lineage(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("taxon")).distinct()
    return C.lineage(hier_of(spark, d), wanted, LEVELS)


@query(with_views("catalogue", VOCAB + "SELECT leaf AS child, mid AS parent FROM hier UNION SELECT mid, top FROM hier UNION SELECT top, NULL FROM hier"))
def invert_hierarchy(spark, d):
    return C.invert_hierarchy(hier_of(spark, d), LEVELS)


@query(with_views("catalogue", VOCAB + "SELECT level, class, CAST(row_number() OVER (ORDER BY CASE level WHEN 'top' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, class) - 1 AS INT) AS position FROM v"))
def flatten_hierarchy(spark, d):
    return C.flatten_hierarchy(hier_of(spark, d), LEVELS)


@query(with_views("catalogue", TAXA + "SELECT taxon, coalesce(max(level), -1) AS level FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS taxon FROM lineitem) LEFT JOIN taxa USING (taxon) GROUP BY taxon"))
def level_of(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("taxon")).distinct()
    return C.level_of(keys, hier_of(spark, d), LEVELS)


#: Reply chains and a tree of parts: parents by halving, so that depths grow with the table.
FOREST = "WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS child, 'p' || p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION ALL SELECT 'c' || conv_id || '.' || turn, 'c' || conv_id || '.' || (turn - 1) FROM conversations WHERE turn > 1), up AS (SELECT child AS node, parent AS ancestor, 1::BIGINT AS distance FROM e UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN e ON up.ancestor = e.child), nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e), depth AS (SELECT node, coalesce(max(distance), 0) AS depth, coalesce(arg_max(ancestor, distance), node) AS root FROM nodes LEFT JOIN up USING (node) GROUP BY node)\n"


def forest_edges(spark, d):
    part, turn = table(spark, d, "part"), table(spark, d, "conversations")
    halves = part.where("p_partkey > 1").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("child"), F.expr("concat('p', p_partkey div 2)").alias("parent"))
    return halves.unionByName(turn.where("turn > 1").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("child"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("turn") - 1).alias("parent")))


@query(FOREST + "SELECT node, ancestor, distance FROM up")
def forest_ancestors(spark, d):
    return G.ancestors(forest_edges(spark, d))


@query(FOREST + "SELECT node, depth, root FROM depth")
def forest_depths(spark, d):
    return G.depths(forest_edges(spark, d))


@query(FOREST + ", h AS (SELECT ancestor AS node, max(distance) AS height FROM up GROUP BY 1) SELECT node, coalesce(height, 0) AS height FROM nodes LEFT JOIN h USING (node)")
def forest_heights(spark, d):
    return G.heights(forest_edges(spark, d))


@query(FOREST + ", p AS (SELECT node, list(ancestor ORDER BY distance DESC) AS above FROM up GROUP BY node) SELECT node, array_to_string(coalesce(above, []) || [node], '/') AS path FROM nodes LEFT JOIN p USING (node)")
def forest_paths(spark, d):
    return G.paths(forest_edges(spark, d)).select("node", F.array_join("path", "/").alias("path"))


@query(FOREST + ", p AS (SELECT node, list(ancestor ORDER BY distance DESC) AS above FROM up GROUP BY node) SELECT node, row_number() OVER (ORDER BY coalesce(above, []), node) - 1 AS position FROM nodes LEFT JOIN p USING (node)")
def forest_flat_list(spark, d):
    return G.flat_list(forest_edges(spark, d))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS child, (c_custkey * c_custkey + 1) % (SELECT max(c_custkey) FROM customer) AS parent FROM customer), up AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT up.node, e.parent FROM up JOIN e ON up.ancestor = e.child) SELECT DISTINCT CAST(node AS VARCHAR) AS node FROM up WHERE node = ancestor")
def forest_cycles(spark, d):
    """Each customer points at another one: most lead to a cycle, some are on one."""
    c = table(spark, d, "customer")
    most = c.agg(F.max("c_custkey").alias("most"))
    return G.cycles(c.crossJoin(F.broadcast(most)).select(F.col("c_custkey").alias("child"), ((F.col("c_custkey") * F.col("c_custkey") + 1) % F.col("most")).alias("parent")))  # one row


@query(with_views("catalogue", "SELECT id, leaf FROM catalogue WHERE leaf = '3' OR mid = '3' OR top = '3' ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id LIMIT 50"))
def taxon_members(spark, d):
    return C.taxon_members(catalogue(spark, d), LEVELS, "3", 50, "id").select("id", "leaf")


@query(with_views("catalogue", VOCAB + """, nm AS (SELECT mid, arg_min(coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN country END), ''), mid_name), id) AS name FROM catalogue GROUP BY mid)
SELECT class, CAST(idx AS INT) AS idx, coalesce(name, '') AS name FROM v LEFT JOIN nm ON class = mid WHERE level = 'mid'"""))
def build_names(spark, d):
    c = catalogue(spark, d).withColumns({"one": F.when(F.col("id") % 3 == 0, F.col("country")), "two": F.lit(None).cast("string")})
    return C.build_names(c, C.build_vocab(c, LEVELS), "mid", "one", "two", "mid_name", "id")


@query("SELECT p_partkey, CASE WHEN array_length(string_split(p_name, ' ')) <= 2 THEN p_name ELSE string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] END AS short FROM part")
def short_name(spark, d):
    return table(spark, d, "part").select("p_partkey", C.short_name("p_name").alias("short"))


MAPPED = ", m AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS old, CAST(l_suppkey + 100000 AS VARCHAR) AS new FROM lineitem WHERE l_suppkey % 2 = 0)\n"


@query(with_views("catalogue", MAPPED + "SELECT id, coalesce(new, leaf) AS leaf, new IS NOT NULL AS replaced FROM catalogue LEFT JOIN m ON leaf = old"))
def remap_keys(spark, d):
    m = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_suppkey").cast("string").alias("old"), (F.col("l_suppkey") + 100000).cast("string").alias("new")).distinct()
    return C.remap_keys(catalogue(spark, d), m, "leaf").select("id", "leaf", "replaced")


@query(with_views("catalogue", MAPPED + "SELECT count(*) AS rows, count(new) AS replaced, count(DISTINCT new) AS keys FROM catalogue LEFT JOIN m ON leaf = old"))
def remap_report(spark, d):
    m = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_suppkey").cast("string").alias("old"), (F.col("l_suppkey") + 100000).cast("string").alias("new")).distinct()
    return C.remap_report(C.remap_keys(catalogue(spark, d), m, "leaf"), "leaf")


@query(with_views("catalogue", VOCAB + """, nm AS (SELECT leaf, arg_min(CASE WHEN id % 3 = 0 THEN country ELSE '' END, id) AS name FROM catalogue GROUP BY leaf) SELECT count(*) AS classes, count(*) FILTER (coalesce(name, '') = '') AS missing FROM v LEFT JOIN nm ON class = leaf WHERE level = 'leaf'"""))
def names_report(spark, d):
    c = catalogue(spark, d).withColumns({"one": F.when(F.col("id") % 3 == 0, F.col("country")), "two": F.lit(None).cast("string")})
    return C.names_report(C.build_names(c, C.build_vocab(c, LEVELS), "leaf", "one", "two", "two", "id"))


@query(with_views("catalogue", "SELECT resolved, count(*) AS n FROM (SELECT s_suppkey IS NOT NULL AS resolved FROM catalogue LEFT JOIN supplier ON leaf = CAST(s_suppkey AS VARCHAR)) GROUP BY 1"))
def resolve_names(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("leaf"), "s_name")
    return C.resolve_names(catalogue(spark, d), names, "leaf").groupBy("resolved").agg(F.count("*").alias("n"))


@query(with_views("catalogue", ", h AS (SELECT DISTINCT leaf, mid, top FROM catalogue WHERE \"set\" = '1') SELECT c.id, c.leaf, coalesce(h.mid, 'orphan:' || c.leaf) AS mid, coalesce(h.top, 'orphan:' || c.leaf) AS top FROM catalogue c LEFT JOIN h USING (leaf)"))
def derive_coarse(spark, d):
    c = catalogue(spark, d)
    h = c.where("set = '1'").select(*LEVELS).distinct()
    return C.derive_coarse(c.select("id", *LEVELS), h, LEVELS, "singleton").select("id", *LEVELS)


@query(with_views("catalogue pred", "SELECT instance_id, level, prediction, CASE level WHEN 0 THEN leaf WHEN 1 THEN mid ELSE top END AS truth FROM pred JOIN catalogue USING (filename)"))
def attach_truth(spark, d):
    return C.attach_truth(pred(spark, d), catalogue(spark, d), LEVELS, "id").select("instance_id", "level", "prediction", "truth")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def attach_groups(spark, d):
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return C.attach_groups(table(spark, d, "orders"), g, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def existing_only(spark, d):
    listing = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.existing_only(table(spark, d, "orders").select("o_orderkey"), listing, "o_orderkey")


@query("""WITH e AS (SELECT o_orderkey AS path, o_custkey % 5 AS size FROM orders WHERE o_orderkey % 3 < 2), p AS (SELECT o_orderkey AS path, o_custkey % 4 AS size FROM orders WHERE o_orderkey % 5 < 4)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN p.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.size = p.size THEN 'ok' ELSE 'size_mismatch' END AS status FROM e FULL JOIN p USING (path)) GROUP BY 1""")
def reconcile_manifest(spark, d):
    o = table(spark, d, "orders")
    part = lambda w, m: o.where(w).select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % m).alias("size"))
    return C.reconcile_manifest(part("o_orderkey % 3 < 2", 5), part("o_orderkey % 5 < 4", 4)).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'out/' || s_name || '/model' AS model_path, s_suppkey AS k FROM supplier), ev AS (SELECT model_path, 'eval-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS eval_name, max(l_quantity) AS test_f1 FROM e JOIN lineitem ON k = l_suppkey GROUP BY 1, 2)
SELECT s_name AS run_dir, max(eval_name) AS eval_name, arg_max(test_f1, eval_name) AS test_f1 FROM supplier JOIN ev ON contains(model_path, s_name || '/') GROUP BY 1""")
def join_evals(spark, d):
    s = table(spark, d, "supplier")
    e = s.join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.concat(F.lit("out/"), "s_name", F.lit("/model")).alias("model_path"), F.concat(F.lit("eval-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("eval_name")).agg(F.max("l_quantity").alias("test_f1"))
    return C.join_evals(s.select(F.concat("s_name", F.lit("/")).alias("run_dir")), e).withColumn("run_dir", F.rtrim(F.col("run_dir"), F.lit("/")))


@query("SELECT p_name AS path, o_orderdate AS modified FROM (SELECT CAST(o_orderkey AS VARCHAR) || '.ckpt' AS p_name, o_orderdate FROM orders WHERE o_orderkey % 2 = 0) ORDER BY o_orderdate DESC, p_name DESC LIMIT 1")
def latest_matching(spark, d):
    f = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".ckpt")).alias("path"), F.col("o_orderdate").alias("modified"))
    return C.latest_matching(f, r"[02468]\.ckpt$")


@query(with_views("pred", ", b AS (SELECT instance_id, level, CASE WHEN instance_id % 4 = 0 THEN label ELSE prediction END AS other FROM pred) SELECT level, count(*) AS n, avg((prediction = other)::INT) AS agree, avg((prediction = label)::INT) AS acc_a, avg((other = label)::INT) AS acc_b FROM pred JOIN b USING (instance_id, level) GROUP BY level"))
def agreement(spark, d):
    p = pred(spark, d)
    return C.agreement(p, p.withColumn("prediction", F.when(F.col("instance_id") % 4 == 0, F.col("label")).otherwise(F.col("prediction"))))


@query(with_views("catalogue", """, a AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS ia FROM (SELECT DISTINCT leaf AS class FROM catalogue WHERE "set" < '5')), b AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS ib FROM (SELECT DISTINCT leaf AS class FROM catalogue WHERE "set" >= '5'))
SELECT CASE WHEN ib IS NULL THEN 'only_a' WHEN ia IS NULL THEN 'only_b' ELSE 'moved' END AS state, count(*) AS n FROM a FULL JOIN b USING (class) WHERE ia IS DISTINCT FROM ib GROUP BY 1"""))
def vocab_diff(spark, d):
    c = catalogue(spark, d)
    return C.vocab_diff(C.build_vocab(c.where("set < '5'"), ["leaf"]), C.build_vocab(c.where("set >= '5'"), ["leaf"])).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS target FROM pages)
SELECT page_id, target FROM l WHERE target NOT IN (SELECT target FROM p)""")
def broken_links(spark, d):
    return C.broken_links(table(spark, d, "pages"))


@query(with_views("pred", "SELECT instance_id, filename, max(label) FILTER (level = 0) AS leaf, max(label) FILTER (level = 1) AS mid, max(label) FILTER (level = 2) AS top, '0' AS \"set\" FROM pred GROUP BY 1, 2"))
def catalogue_from_predictions(spark, d):
    return files.catalogue_from_predictions(pred(spark, d), LEVELS)


RUNS = "r AS (SELECT o_orderkey AS run_id, o_custkey % 7 AS name, o_orderdate AS \"at\", o_totalprice AS score, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS lr, o_orderstatus AS head, o_custkey % 2 AS seed, o_custkey % 3 AS oa, o_custkey % 5 AS ob, o_orderkey % 2 AS oc FROM orders)"


def runs_of(spark, d):
    """Orders as runs, with a nested configuration each: model.lr (may be null), model.head, and seed."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 7).cast("string").alias("name"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("score"),
        F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("lr"), F.col("o_orderstatus").alias("head"), F.struct((F.col("o_custkey") % 3).alias("a"), (F.col("o_custkey") % 5).alias("b"), (F.col("o_orderkey") % 2).alias("c")).alias("opt")).alias("model"), (F.col("o_custkey") % 2).alias("seed"))).alias("config"),
    )


FLAT = ", f AS (SELECT run_id, 'model.lr' AS key, lr AS value FROM r WHERE lr IS NOT NULL UNION ALL SELECT run_id, 'model.head', head FROM r UNION ALL SELECT run_id, 'seed', CAST(seed AS VARCHAR) FROM r UNION ALL SELECT run_id, 'model.opt.a', CAST(oa AS VARCHAR) FROM r UNION ALL SELECT run_id, 'model.opt.b', CAST(ob AS VARCHAR) FROM r UNION ALL SELECT run_id, 'model.opt.c', CAST(oc AS VARCHAR) FROM r)\n"


@query("WITH " + RUNS + FLAT + "SELECT run_id, key, value FROM f")
def flatten_config(spark, d):
    return K.flatten_config(runs_of(spark, d))


DELTA = FLAT + """, b AS (SELECT key, value AS base FROM f WHERE run_id = 1), grid AS (SELECT DISTINCT f.run_id, b.key, b.base FROM f, b WHERE f.run_id <> 1),
 delta AS (SELECT coalesce(m.run_id, g.run_id) AS run_id, coalesce(m.key, g.key) AS key, CASE WHEN g.key IS NULL THEN 'added' WHEN m.key IS NULL THEN 'unset' ELSE 'changed' END AS change, m.value, g.base FROM (SELECT * FROM f WHERE run_id <> 1) m FULL JOIN grid g ON m.run_id = g.run_id AND m.key = g.key WHERE g.key IS NULL OR m.key IS NULL OR m.value IS DISTINCT FROM g.base)
"""


@query("WITH " + RUNS + DELTA + "SELECT run_id, key, change, value, base FROM delta")
def config_delta(spark, d):
    return K.config_delta(K.flatten_config(runs_of(spark, d)), 1)


@query("WITH " + RUNS + DELTA + """SELECT run_id, string_agg(t, ', ' ORDER BY t) AS text FROM (SELECT run_id, unnest(CASE WHEN count(*) >= 3 AND p <> '' THEN [any_value(p) || '.*(' || count(*) || ')'] ELSE list(tok) END) AS t FROM (SELECT run_id, regexp_extract(key, '^(.*)\\.[^.]*$', 1) AS p, concat_ws('=', split_part(key, '.', -1), value) AS tok FROM delta) GROUP BY run_id, p) GROUP BY run_id""")
def format_delta(spark, d):
    return K.format_delta(K.config_delta(K.flatten_config(runs_of(spark, d)), 1))


@query("WITH " + RUNS + FLAT + ", k AS (SELECT DISTINCT key FROM f), w AS (SELECT r.run_id, k.key, f.value, lag(f.value) OVER (PARTITION BY k.key ORDER BY r.\"at\", r.run_id) AS before, row_number() OVER (PARTITION BY k.key ORDER BY r.\"at\", r.run_id) AS n FROM r CROSS JOIN k LEFT JOIN f ON f.run_id = r.run_id AND f.key = k.key) SELECT run_id, key, value, before FROM w WHERE n > 1 AND value IS DISTINCT FROM before")
def config_chain(spark, d):
    r = runs_of(spark, d)
    return K.config_chain(K.flatten_config(r), r.select("run_id", "at"))


@query("WITH " + RUNS + " SELECT run_id, CAST(name AS VARCHAR) AS name, CASE WHEN run_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'done' WHEN row_number() OVER (PARTITION BY name ORDER BY \"at\" DESC, run_id) = 1 AND name IN (1, 2) THEN 'running' ELSE 'died' END AS status FROM r")
def run_status(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id")).distinct()
    return K.run_status(runs_of(spark, d), done, ["1", "2"])


@query("WITH " + RUNS + ", s AS (SELECT run_id, CAST(name AS VARCHAR) AS name, \"at\", round(sum(l_extendedprice), 2) AS score FROM r JOIN lineitem ON run_id = l_orderkey GROUP BY ALL) SELECT run_id, name, score, round(score - (SELECT arg_min(score, (\"at\", run_id)) FROM s), 2) AS gain FROM s ORDER BY score DESC, run_id LIMIT 20")
def leaderboard(spark, d):
    return K.leaderboard(runs_of(spark, d).drop("score"), scored(spark, d), 20).withColumn("gain", F.round("gain", 2))


BASELINE = ", done AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT run_id, CAST(name AS VARCHAR) AS name, \"at\", round(sum(l_extendedprice), 2) AS score FROM r JOIN lineitem ON run_id = l_orderkey GROUP BY ALL)"


def scored(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))


@query("WITH " + RUNS + DELTA + """, v AS (SELECT l_orderkey AS run_id, round(sum(l_extendedprice), 2) AS val FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), t AS (SELECT l_orderkey AS run_id, round(sum(l_extendedprice), 2) AS test FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
 st AS (""" + ORACLES["run_status"] + "), fd AS (" + ORACLES["format_delta"] + ") SELECT run_id, CAST(r.name AS VARCHAR) AS name, coalesce(text, '') AS delta, val, test, status, run_id = 1 AS is_baseline, row_number() OVER (ORDER BY coalesce(-test, 'infinity'::DOUBLE), run_id) AS place FROM r LEFT JOIN v USING (run_id) LEFT JOIN t USING (run_id) LEFT JOIN st USING (run_id) LEFT JOIN fd USING (run_id)")
def results_table(spark, d):
    """Every run with validation and test score, status and what it changed against run 1."""
    runs, items = runs_of(spark, d), table(spark, d, "lineitem")
    score = lambda rows: rows.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    done = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id")).distinct()
    return K.results_table(runs, score(items.where("l_linenumber <= 2")), score(items.where("l_returnflag <> 'N'")), K.run_status(runs, done, ["1", "2"]), 1, K.config_delta(K.flatten_config(runs), 1))


@query("WITH " + RUNS + BASELINE + ' SELECT arg_min(run_id, ("at", run_id)) AS run_id, arg_min(score, ("at", run_id)) AS score FROM s WHERE run_id IN (SELECT run_id FROM done)')
def pick_baseline(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return K.pick_baseline(runs_of(spark, d).drop("score"), scored(spark, d), done)


@query("WITH board AS (" + ORACLES["leaderboard"] + "), deltas AS (" + ORACLES["format_delta"] + ") SELECT run_id, name, score, gain, coalesce(text, '') AS text FROM board LEFT JOIN deltas USING (run_id)")
def ledger(spark, d):
    """Only the twenty runs of the board and the baseline are flattened and compared."""
    runs = runs_of(spark, d)
    board = stored(K.leaderboard(runs.drop("score"), scored(spark, d), 20).withColumn("gain", F.round("gain", 2)))
    ids = board.select("run_id").unionByName(spark.range(1, 2).select(F.col("id").alias("run_id"))).distinct()
    told = runs.join(F.broadcast(ids), "run_id", "left_semi")  # 21 rows
    return K.ledger(board, K.config_delta(K.flatten_config(told), 1))


@query("SELECT o_orderkey, o_custkey FROM orders")
def read_catalogue(spark, d):
    return files.read_catalogue(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"])


@query(with_views("pred", "SELECT instance_id, filename, level, label, prediction, confidence, 0.5::DOUBLE AS threshold, true AS known_label FROM pred"))
def predictions_round_trip(spark, d):
    path = scratch_path(spark)
    files.write_predictions(pred(spark, d).withColumns({"threshold": F.lit(0.5), "known_label": F.lit(True)}), path)
    return files.read_predictions(spark, path)


@query(with_views("catalogue", "SELECT leaf || '/' || filename AS image_path, \"set\" = '1' AS is_valid, leaf, mid, top FROM catalogue"))
def prepared_cache(spark, d):
    base = scratch_path(spark)
    first = files.prepared_cache(C.prepare(catalogue(spark, d), LEVELS), d, {"valid": "1"}, base)
    return files.prepared_cache(first.limit(0), d, {"valid": "1"}, base)


@query(with_views("catalogue", "SELECT top, count(*) AS n FROM catalogue GROUP BY top"))
def report_round_trip(spark, d):
    path = scratch_path(spark)
    files.write_report(catalogue(spark, d).groupBy("top").agg(F.count("*").alias("n")), path)
    return spark.read.json(path).select(F.col("top").cast("string").alias("top"), "n")


@query("SELECT c_custkey, c_nationkey, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, NULL, s_suppkey FROM supplier")
def read_union(spark, d):
    return files.read_union(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet"]).select("c_custkey", "c_nationkey", "s_suppkey")


@query(with_views("catalogue", "SELECT DISTINCT 'mid=' || mid AS class_folder, 'parquet' AS kind, true AS filled FROM catalogue"))
def catalogue_from_listing(spark, d):
    path = scratch_path(spark)
    catalogue(spark, d).repartition("mid").write.partitionBy("mid").parquet(path)
    found = files.catalogue_from_listing(spark, path, "*.parquet")
    return found.select("class_folder", F.substring_index("filename", ".", -1).alias("kind"), (F.col("size") > 0).alias("filled")).distinct()


@query("SELECT printf('%04d-run', n_nationkey) AS run_id, printf('%04d-run-x', n_nationkey) AS run_dir, n AS customers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def read_runs(spark, d):
    path = scratch_path(spark)
    runs = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    runs.select(F.to_json(F.struct("customers")).alias("value"), F.format_string("%04d-run-x", F.col("c_nationkey")).alias("run")).repartition("run").write.partitionBy("run").text(path)
    found = files.read_runs(spark, path, "*.txt").withColumn("run_dir", F.regexp_replace("run_dir", "^run=", ""))
    return found.select(F.substring_index("run_dir", "-", 2).alias("run_id"), "run_dir", F.get_json_object("config", "$.customers").cast("long").alias("customers"))


@query(with_views("catalogue", "SELECT id, leaf, mid, top FROM catalogue"))
def sort_coarse_to_fine(spark, d):
    return catalogue(spark, d).select("id", *LEVELS).orderBy("top", "mid", "leaf", "id")


@query(with_views("catalogue", "SELECT leaf FROM catalogue WHERE \"set\" = '0' INTERSECT SELECT leaf FROM catalogue WHERE \"set\" = '1'"))
def classes_in_both(spark, d):
    c = catalogue(spark, d)
    return c.where("set = '0'").select("leaf").intersect(c.where("set = '1'").select("leaf"))


@query(with_views("catalogue", "SELECT leaf FROM catalogue WHERE \"set\" = '0' EXCEPT SELECT leaf FROM catalogue WHERE \"set\" = '1'"))
def classes_only_in_first(spark, d):
    c = catalogue(spark, d)
    return c.where("set = '0'").select("leaf").subtract(c.where("set = '1'").select("leaf"))


@query(with_views("catalogue", "SELECT id, leaf FROM catalogue WHERE \"set\" = '0' UNION ALL SELECT id, leaf FROM catalogue WHERE \"set\" IN ('0', '1')"))
def union_all(spark, d):
    c = catalogue(spark, d).select("id", "leaf", "set")
    return c.where("set = '0'").unionByName(c.where("set in ('0', '1')")).select("id", "leaf")


@query(with_views("catalogue", "SELECT leaf, min(id) AS id FROM catalogue GROUP BY leaf"))
def first_per_key(spark, d):
    return catalogue(spark, d).groupBy("leaf").agg(F.min("id").alias("id"))
