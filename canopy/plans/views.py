"""The driver's tables as catalogue, captures, predictions and scores; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["leaf", "mid", "top"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images: customer, nation and region are the classes; folds by order key."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda x: F.col(x).cast("string")
    return rows.select(
        F.col("o_orderkey").alias("id"), text("o_custkey").alias("leaf"), text("c_nationkey").alias("mid"), text("n_regionkey").alias("top"), (F.col("o_orderkey") % 10).cast("string").alias("set"),
        F.concat(text("o_orderkey"), F.lit(".jpg")).alias("filename"), F.col("o_orderpriority").alias("country"), F.col("n_name").alias("mid_name"),
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Predictions over nations, regions and two halves: about a third of the orders are mistaken, by arithmetic."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    key = F.col("o_orderkey")
    guess = F.when(key * 7 % 11 < 7, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + key * 13 % 25) % 25)
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(key.alias("instance_id"), F.col("c_nationkey").alias("t"), guess.alias("p"), (F.floor("o_totalprice") % 1000).alias("r"))
    tree = lambda k: F.broadcast(n.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"{k}_up")))
    rows = rows.join(tree("t"), "t").join(tree("p"), "p")
    per = lambda lvl, a, b, x: F.struct(F.lit(lvl).alias("level"), a.cast("string").alias("label"), b.cast("string").alias("prediction"), ((F.col("r") + x) % 1000 / 1000.0).alias("confidence"))
    three = F.explode(F.array(per(0, F.col("t"), F.col("p"), 0), per(1, F.col("t_up"), F.col("p_up"), 211), per(2, F.col("t_up") % 2, F.col("p_up") % 2, 433)))
    return rows.select("instance_id", F.concat(F.col("instance_id").cast("string"), F.lit(".jpg")).alias("filename"), three.alias("x")).select("instance_id", "filename", "x.*")


def captures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    name = F.concat(F.lit("x/crop_TRAPNAME_"), (F.col("user_id") % 16).cast("string"), F.lit("_IMAGENAME_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-"), F.col("event_id").cast("string"), F.lit("-snapshot_1.jpg"))
    return e.select("event_id", F.col("event_type").alias("class"), F.when(F.col("event_id") % 97 == 0, "unreadable.jpg").otherwise(name).alias("path"), "ts", "user_id")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Ten scores of each vector: ten times its first ten numbers."""
    e = table(spark, d, "embeddings")
    part = lambda a: F.transform(F.slice("embedding", a, 10), lambda x: x.cast("double") * 10)
    return e.select(F.col("vec_id").alias("instance_id"), F.col("label").alias("label_idx"), part(1).alias("scores"), part(11).alias("other"))


def tree(spark: SparkSession) -> DataFrame:
    """child_idx, parent_idx: ten classes in pairs."""
    return spark.range(10).select(F.col("id").cast("int").alias("child_idx"), (F.col("id") / 2).cast("int").alias("parent_idx"))


SQL = {
    "catalogue": """catalogue AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS leaf, CAST(c_nationkey AS VARCHAR) AS mid, CAST(n_regionkey AS VARCHAR) AS top, CAST(o_orderkey % 10 AS VARCHAR) AS "set",
 CAST(o_orderkey AS VARCHAR) || '.jpg' AS filename, o_orderpriority AS country, n_name AS mid_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "pred": """guess AS (SELECT o_orderkey AS instance_id, c_nationkey AS t, CASE WHEN o_orderkey * 7 % 11 < 7 THEN c_nationkey ELSE (c_nationkey + o_orderkey * 13 % 25) % 25 END AS p, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS r FROM orders JOIN customer ON o_custkey = c_custkey),
 up AS (SELECT guess.*, a.n_regionkey AS tu, b.n_regionkey AS pu FROM guess JOIN nation a ON t = a.n_nationkey JOIN nation b ON p = b.n_nationkey),
 pred AS (SELECT instance_id, CAST(instance_id AS VARCHAR) || '.jpg' AS filename, 0 AS level, CAST(t AS VARCHAR) AS label, CAST(p AS VARCHAR) AS prediction, r / 1000.0::DOUBLE AS confidence FROM up
 UNION ALL SELECT instance_id, CAST(instance_id AS VARCHAR) || '.jpg', 1, CAST(tu AS VARCHAR), CAST(pu AS VARCHAR), (r + 211) % 1000 / 1000.0::DOUBLE FROM up
 UNION ALL SELECT instance_id, CAST(instance_id AS VARCHAR) || '.jpg', 2, CAST(tu % 2 AS VARCHAR), CAST(pu % 2 AS VARCHAR), (r + 433) % 1000 / 1000.0::DOUBLE FROM up)""",
    "captures": """captures AS (SELECT event_id, event_type AS class, CASE WHEN event_id % 97 = 0 THEN 'unreadable.jpg' ELSE 'x/crop_TRAPNAME_' || CAST(user_id % 16 AS VARCHAR) || '_IMAGENAME_' || strftime(ts, '%Y%m%d%H%M%S') || '-' || CAST(event_id AS VARCHAR) || '-snapshot_1.jpg' END AS path, ts, user_id FROM events),
 parsed AS (SELECT event_id, class, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id % 16 AS VARCHAR) END AS trap, CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM captures),
 nights AS (SELECT event_id, class, trap, CAST(ts - INTERVAL 12 HOUR AS DATE) AS night, trap || '|' || CAST(CAST(ts - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS "group" FROM parsed WHERE trap IS NOT NULL)""",
    "scores": """scores AS (SELECT vec_id AS instance_id, label AS label_idx, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS scores, list_transform(embedding[11:20], lambda x: CAST(x AS DOUBLE) * 10) AS other FROM embeddings),
 long AS (SELECT instance_id, label_idx, CAST(i - 1 AS INT) AS class_idx, scores[i] AS score, other[i] AS other FROM scores, range(1, 11) r(i))""",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n ".join(SQL[n] for n in names.split()) + "\n" + body
