"""Queries of the sampling, split, hold-out and mixing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import sampling as S
from ..operators.metrics import class_counts
from .registry import query
from .views import LEVELS, captures, catalogue, table, with_views


def md5(key: str, seed: object = 0) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}'), {key}"


@query(with_views("catalogue", f"SELECT id, mid FROM catalogue QUALIFY row_number() OVER (PARTITION BY mid ORDER BY {md5('id', 3)}) <= 20"))
def cap_per_class(spark, d):
    return S.cap_per_class(catalogue(spark, d), "mid", 20, "id", 3).select("id", "mid")


@query(with_views("catalogue", f", c AS (SELECT leaf FROM (SELECT leaf, count(*) AS n FROM catalogue GROUP BY 1 HAVING count(*) >= 8) ORDER BY {md5('leaf')} LIMIT 30) SELECT id, leaf FROM catalogue WHERE leaf IN (SELECT leaf FROM c) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY {md5('id')}) <= 8"))
def sample_classes(spark, d):
    return S.sample_classes(catalogue(spark, d), "leaf", 30, 8, "id").select("id", "leaf")


@query(with_views("catalogue", f"SELECT id, country FROM catalogue QUALIFY row_number() OVER (PARTITION BY country ORDER BY {md5('id', 5)}) <= 40"))
def sample_strata(spark, d):
    return S.sample_strata(catalogue(spark, d), "country", 40, "id", 5).select("id", "country")


SPREAD = f", t AS (SELECT id, mid, row_number() OVER (PARTITION BY mid ORDER BY {md5('id')}) AS turn FROM catalogue), sp AS (SELECT id, mid FROM t ORDER BY turn, {md5('mid')} LIMIT 110)\n"


@query(with_views("catalogue", SPREAD + "SELECT id, mid FROM sp"))
def spread_sample(spark, d):
    return S.spread_sample(catalogue(spark, d).select("id", "mid"), 110, "mid", "id")


@query(with_views("catalogue", SPREAD + "SELECT mid, count(*) AS n, '2' AS \"set\" FROM sp GROUP BY mid"))
def label_budget(spark, d):
    return S.label_budget(catalogue(spark, d).select("id", "mid"), 110, "mid", "id").groupBy("mid", "set").agg(F.count("*").alias("n"))


@query(with_views("captures", "SELECT event_id, trap, ts, CASE WHEN trap IS NOT NULL THEN event_id END AS snapshot, trap IS NOT NULL AS parsed FROM parsed"))
def parse_capture(spark, d):
    return S.parse_capture(captures(spark, d).select("event_id", "path"), "path").select("event_id", "trap", F.col("ts").cast("timestamp_ntz").alias("ts"), "snapshot", "parsed")


def nights(spark, d):
    return S.assign_night(S.parse_capture(captures(spark, d).select("event_id", "class", "path"), "path").where("parsed"))


@query(with_views("captures", 'SELECT event_id, CAST(night AS VARCHAR) AS night, "group" FROM nights'))
def assign_night(spark, d):
    return nights(spark, d).select("event_id", F.col("night").cast("string").alias("night"), "group")


SPLIT = """, gr AS (SELECT "group", row_number() OVER (ORDER BY md5("group" || '|1'), "group") AS place FROM (SELECT DISTINCT "group" FROM nights)), tk AS (SELECT CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS take FROM gr),
 sp AS (SELECT event_id, class, "group", CASE WHEN place <= take AND class IN ('purchase') THEN 'unused' WHEN place <= take THEN 'adapt' ELSE 'probe' END AS split FROM nights JOIN gr USING ("group"), tk)
"""


@query(with_views("captures", SPLIT + 'SELECT event_id, "group", split FROM sp'))
def split_groups(spark, d):
    return S.split_groups(nights(spark, d), "group", "class", 0.5, ["purchase"], 1).select("event_id", "group", "split")


@query(with_views("captures", SPLIT + """SELECT 'group_in_both' AS "check", count(*) AS n, count(*) = 0 AS ok FROM (SELECT "group" FROM sp WHERE split <> 'unused' GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'held_out_in_adapt', count(*), count(*) = 0 FROM sp WHERE split = 'adapt' AND class = 'purchase' UNION ALL SELECT 'held_out_in_probe', count(*), count(*) > 0 FROM sp WHERE split = 'probe' AND class = 'purchase' UNION ALL SELECT 'adapt_rows', count(*), count(*) > 0 FROM sp WHERE split = 'adapt'"""))
def check_split(spark, d):
    return S.check_split(S.split_groups(nights(spark, d), "group", "class", 0.5, ["purchase"], 1), "group", "class", ["purchase"])


HOLD = f""", sz AS (SELECT leaf, mid, top, count(*) AS n FROM catalogue GROUP BY ALL), far AS (SELECT top FROM (SELECT top, quantile_cont(n, 0.5) AS m, sum(n) AS t, count(*) AS leaves FROM sz GROUP BY 1) WHERE m >= 5 AND leaves >= 2 AND t <= 1000000000 ORDER BY t, top LIMIT 1), rest AS (SELECT * FROM sz WHERE top NOT IN (SELECT top FROM far)),
 mids AS (SELECT mid FROM rest GROUP BY 1 HAVING count(*) > 1), midh AS (SELECT mid FROM mids ORDER BY {md5('mid', 9)} LIMIT 3), nearh AS (SELECT leaf FROM rest WHERE mid IN (SELECT mid FROM mids) AND mid NOT IN (SELECT mid FROM midh) AND n >= 5 ORDER BY {md5('leaf', 9)} LIMIT 20),
 held AS (SELECT 'far' AS stratum, top AS taxon FROM far UNION ALL SELECT 'mid', mid FROM midh UNION ALL SELECT 'near', leaf FROM nearh),
 kept AS (SELECT * FROM catalogue WHERE top NOT IN (SELECT top FROM far) AND mid NOT IN (SELECT mid FROM midh) AND leaf NOT IN (SELECT leaf FROM nearh))
"""


def held_out(spark, d):
    return S.pick_holdout(catalogue(spark, d), LEVELS, 1, 3, 20, 5, 9, most_rows=10**9, least_leaves=2)


@query(with_views("catalogue", HOLD + "SELECT stratum, taxon FROM held"))
def pick_holdout(spark, d):
    return held_out(spark, d)


@query(with_views("catalogue", HOLD + """SELECT 'rows_removed' AS "check", a - b AS n, a - b <= 0.05 * a AS ok FROM (SELECT (SELECT count(*) FROM catalogue) AS a, (SELECT count(*) FROM kept) AS b) UNION ALL SELECT 'mid_emptied', count(*), count(*) = 0 FROM (SELECT mid FROM catalogue EXCEPT SELECT mid FROM kept) UNION ALL SELECT 'top_emptied', count(*), count(*) = 0 FROM (SELECT top FROM catalogue EXCEPT SELECT top FROM kept)"""))
def check_holdout(spark, d):
    c = catalogue(spark, d)
    return S.check_holdout(c, S.apply_holdout(c, held_out(spark, d), LEVELS), LEVELS)


NOVEL = HOLD + """, nov AS (SELECT id, leaf, CASE WHEN leaf IN (SELECT leaf FROM kept) THEN 'known' WHEN mid IN (SELECT mid FROM kept) THEN 'near' WHEN top IN (SELECT top FROM kept) THEN 'mid' ELSE 'far' END AS stratum FROM catalogue)
"""


def novelty(spark, d):
    c = catalogue(spark, d)
    return S.stratify_novelty(c, S.apply_holdout(c, held_out(spark, d), LEVELS), LEVELS)


@query(with_views("catalogue", NOVEL + "SELECT stratum, count(*) AS n FROM nov GROUP BY 1"))
def stratify_novelty(spark, d):
    return novelty(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))


@query(with_views("catalogue", NOVEL + ", ok AS (SELECT leaf FROM catalogue GROUP BY 1 HAVING count(*) >= 10) SELECT stratum, count(*) AS n FROM nov WHERE stratum = 'known' OR leaf IN (SELECT leaf FROM ok) GROUP BY 1"))
def restrict_novel(spark, d):
    ok = class_counts(catalogue(spark, d), "leaf").where("n >= 10").select(F.col("class").alias("leaf"))
    return S.restrict_novel(novelty(spark, d), ok, "leaf", 0.99).groupBy("stratum").agg(F.count("*").alias("n"))


@query(with_views("catalogue", """, s AS (SELECT mid AS class, count(*) AS n, pow(count(*), 0.5) AS mass FROM catalogue GROUP BY 1), u AS (SELECT class, n, CAST(floor(sum(mass) OVER (ORDER BY class) / (SELECT sum(mass) FROM s) * 20000 + 1e-6) AS BIGINT) AS upto FROM s)
SELECT class AS mid, upto - coalesce(lag(upto) OVER (ORDER BY class), 0) AS n FROM u"""))
def weighted_resample(spark, d):
    return S.weighted_resample(catalogue(spark, d).select("id", "mid"), "mid", 0.5, 20000, "id").groupBy("mid").agg(F.count("*").alias("n"))


@query(with_views("catalogue", """, b AS (SELECT * FROM catalogue WHERE "set" IN ('1', '3', '4') AND leaf IN (SELECT leaf FROM catalogue WHERE "set" IN ('1', '3', '4') GROUP BY 1 HAVING count(*) >= 3)), p AS (SELECT * FROM catalogue WHERE "set" = '2' AND leaf IN (SELECT leaf FROM b)),
 t AS (SELECT greatest(1, CAST(round_even(0.5 * (SELECT count(*) FROM b) / (0.5 * (SELECT count(*) FROM p)), 0) AS BIGINT)) AS k)
SELECT 'real' AS kind, count(*) AS n FROM b UNION ALL SELECT 'pseudo', count(*) * (SELECT k FROM t) FROM p"""))
def combine_pseudo(spark, d):
    c = catalogue(spark, d)
    hier = c.select(*LEVELS).distinct()
    real = c.where("set in ('0', '1', '3', '4')").select("id", *LEVELS, "set")
    mixed = S.combine_pseudo(real, c.where("set = '2'").select("id", "leaf", "set"), hier, LEVELS, 3, 0.5)
    return mixed.groupBy(F.when(F.col("copy") == 0, "real").otherwise("pseudo").alias("kind")).agg(F.count("*").alias("n"))


@query(with_views("catalogue", ", k AS (SELECT greatest(1, 60000 // count(DISTINCT leaf)) AS per FROM catalogue) SELECT leaf, per AS n FROM (SELECT DISTINCT leaf FROM catalogue), k"))
def balanced_replication(spark, d):
    return S.balanced_replication(catalogue(spark, d).select("id", "leaf"), "leaf", 60000, "id").groupBy("leaf").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT DISTINCT c_custkey // 10 AS batch_id, CAST(c_nationkey AS VARCHAR) AS leaf FROM customer), h AS (SELECT CAST(n_nationkey AS VARCHAR) AS leaf, n_regionkey AS parent FROM nation),
 o AS (SELECT leaf, parent, row_number() OVER (ORDER BY md5(leaf || '|0'), leaf) - 1 AS place, row_number() OVER (PARTITION BY parent ORDER BY md5(leaf || '|0'), leaf) - 1 AS near, count(*) OVER () AS size, count(*) OVER (PARTITION BY parent) AS kin FROM h),
 s AS (SELECT DISTINCT batch_id, ('0x' || md5(CAST(batch_id AS VARCHAR) || '|0')[1:8])::BIGINT AS start FROM b), st AS (SELECT i AS step FROM range(0, 16) r(i)), f AS (SELECT DISTINCT batch_id, parent FROM b JOIN h USING (leaf)),
 e AS (SELECT batch_id, leaf, 0 AS rank, 0 AS step FROM b UNION ALL SELECT f.batch_id, o.leaf, 1, step FROM f JOIN s USING (batch_id) JOIN o ON o.parent = f.parent JOIN st ON step < least(kin, 16) AND (start + step) % kin = near
 UNION ALL SELECT batch_id, leaf, 2, step FROM s, o, st WHERE step < least(size, 16) AND (start + step) % size = place), m AS (SELECT batch_id, leaf, min((rank, step)) AS k FROM e GROUP BY ALL)
SELECT batch_id, leaf, k[1] AS rank FROM m QUALIFY k[1] = 0 OR row_number() OVER (PARTITION BY batch_id ORDER BY k, leaf) <= 8""")
def sample_negatives(spark, d):
    batch = table(spark, d, "customer").select(F.expr("c_custkey div 10").alias("batch_id"), F.col("c_nationkey").cast("string").alias("leaf"))
    hier = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("leaf"), F.col("n_regionkey").alias("parent"))
    return S.sample_negatives(batch, hier, "leaf", "parent", 8)
