r"""Quality rules (4): thresholds from mergeable quantile sketches for each language and source.

Each rule looks at odds that a text gives: signs against other characters, characters in lines seen before against the
others, words in repeated windows against the others, capitals against other characters, and characters to a word. One
is added on both sides, so that a text without any such sign has odds that its length sets. The sketch of a rule counts
texts by the logarithm of the odds, in buckets of one percent; two sketches merge by adding counts, so partial
aggregation builds those of each (lang, source), each lang and the whole table in one pass. Sketches are of the texts
that pass the base rules.

A group's quartiles are drawn toward those of its language, and these toward those of all rows, with the weight of
`prior` rows: no size changes the way a threshold is made. The threshold lies `spread` times the distance from the
lower quartile to the median above the median (for lengths of words also as many times the distance to the upper
quartile below it). The half of the texts that a suspect tail can't reach sets it, so up to half of a group may be
junk. For capitals and lengths of words it is wider by what chance does to a text of few words. No rule has a cut-off
of its own.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.

Results for special cases: null or empty text has no words: all measures 0, base_failed, not kept. Null lang or source
are groups of their own. With an empty table the result is empty. Repeated rows are judged alike. Other columns of the
input are ignored by `quality_rules` and carried by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import stored, whole_text

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = [*BASE, "dup_chars", "n_upper"]
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
BUCKETS = 100  # in a factor of e
SPREAD, PRIOR = 6.0, 100
SALTS = 32
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Standard deviations of a text's own chance that are added to a threshold, and that of a word's length against its mean.
CHANCE, WORD_SPREAD = 4.0, 0.6
#: By how many buckets chance alone moves a text of this length, where `mid` is its group's median: capitals as a count
#: with the group's share, lengths of words as a mean. The other rules' signs don't come one by one.
SLACK = {
    "upper": f"{CHANCE * BUCKETS} / sqrt(1 + word_chars * exp(mid / {BUCKETS}.0) / (1 + exp(mid / {BUCKETS}.0)))",
    "word_length": f"{CHANCE * BUCKETS * WORD_SPREAD} / sqrt(greatest(n_words, 1))",
}
#: Rule: (odds, from the columns of MEASURED; whether low values are suspect too).
RULES = {
    "symbols": ("(n_symbols + 1) / (greatest(word_chars - n_symbols, 0) + 1)", False),
    "dup_lines": ("(dup_chars + 1) / (word_chars - dup_chars + 1)", False),
    "repeats": ("(n_repeat_words + 1) / (n_words - n_repeat_words + 1)", False),
    "upper": ("(n_upper + 1) / (word_chars - n_upper + 1)", False),
    "word_length": ("(word_chars + 1) / (n_words + 1)", True),
}


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def without_blanks(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six blanks
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    found = Counter(lines)
    again = sum((n - 1) * without_blanks(line.decode()) for line, n in found.items() if n > 1) if len(found) < len(lines) else 0
    return len(words), without_blanks(text), sum(map(text.count, SYMBOLS)), len(lines) - len(found), repeated_words(words), again, upper


def measures() -> Column:
    """A struct of the columns of MEASURED, from the whole text."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURED]))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=MEASURED, dtype="int64")

    return of(whole_text())


def bucket(odds: str) -> Column:
    return F.floor(F.ln(F.expr(odds)) * BUCKETS).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: bucket counts of the texts that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(odds).alias("bucket")) for k, (odds, _) in RULES.items())))
    long = measured.where(~F.expr(BASE_FAILED)).select("lang", "source", each.alias("m"))
    return long.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, rows and the buckets q1, q2, q3 of their quartiles, from the merged sketches of each key."""
    group = [*keys, "measure"]
    merged = sketch.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    ranked = merged.select(*group, "bucket", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("rows"))
    return ranked.groupBy(*group).agg(F.max("rows").alias("rows"), *(F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bucket"))).cast("double").alias(f"q{k}") for k in (1, 2, 3)))


def fences(sketch: DataFrame, spread: float, prior: int) -> DataFrame:
    """_lang, _source and a struct (low, high, mid) for each rule."""
    quarters = ["q1", "q2", "q3"]

    def drawn(own: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
        weighted = [((F.col("rows") * F.col(f"o.{q}") + prior * F.col(f"p.{q}")) / (F.col("rows") + prior)).alias(q) for q in quarters]
        kept = [F.col(f"o.{c}") for c in own.columns if c not in ("rows", *quarters)]
        return own.alias("o").join(parent.select("measure", *(c for c in ("lang",) if c in parent.columns), *quarters).alias("p"), on).select(*kept, *weighted)

    same = F.col("o.measure") == F.col("p.measure")
    of_lang = drawn(quartiles(sketch, "lang"), quartiles(sketch), same)
    known = drawn(quartiles(sketch, "lang", "source"), of_lang, same & F.col("o.lang").eqNullSafe(F.col("p.lang")))
    high = F.col("q2") + spread * F.greatest(F.col("q2") - F.col("q1"), F.lit(1.0))
    low = F.when(F.col("measure").isin([k for k, (_, both) in RULES.items() if both]), F.col("q2") - spread * F.greatest(F.col("q3") - F.col("q2"), F.lit(1.0)))
    wide = known.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).pivot("measure", list(RULES))
    return wide.agg(F.first(F.struct(low.alias("low"), high.alias("high"), F.col("q2").alias("mid"))))


def quality_rules(docs: DataFrame, spread: float = SPREAD, prior: int = PRIOR, id_column: str = "doc_id", carry: bool = False) -> DataFrame:
    """id, lang, source, the columns of MEASURED, base_failed, failed (names of the adaptive rules broken) and kept.

    carry: all columns of docs as well, in a struct `row`.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    measured = docs.select(F.col(id_column).alias("_id"), "lang", "source", measures().alias("m"), *([whole.alias("row")] if carry else []))
    measured = stored(measured).select("_id", "lang", "source", "m.*", *(["row"] if carry else []))
    known = stored(fences(sketches(measured), spread, prior))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_with")
    rows = measured.withColumn("_salt", F.pmod(F.xxhash64("_id", "n_words", "word_chars"), F.lit(SALTS)))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_with"))
    rows = rows.join(known.select("*", salts), same, "left")
    slack = {k: F.expr(SLACK[k].replace("mid", f"{k}.mid")) if k in SLACK else F.lit(0.0) for k in RULES}
    broken = [F.when((bucket(odds) > F.col(k)["high"] + slack[k]) | (bucket(odds) < F.coalesce(F.col(k)["low"], F.lit(float("-inf"))) - slack[k]), F.lit(k)) for k, (odds, _) in RULES.items()]
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    out = rows.select(F.col("_id").alias(id_column), "lang", "source", *MEASURED, F.expr(BASE_FAILED).alias("base_failed"), failed.alias("failed"), *(["row"] if carry else []))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns as they were."""
    return quality_rules(docs, carry=True).where("kept").select("row.*")


def measures_sql() -> str:
    """Tables `d` (documents with a row number) and `m` (rid, doc_id, lang, source, MEASURED) for DuckDB."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{word}+') AS ws FROM d)),
 win AS (SELECT rid, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
 twice AS (SELECT rid, i FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
 rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 3) g(k) GROUP BY rid),
 ln AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY ALL),
 dup AS (SELECT rid, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * length(regexp_replace(line, '{blank}+', '', 'g'))) AS BIGINT) AS dup_chars FROM ln GROUP BY rid),
 cnt AS (SELECT rid, count(*) AS n_words FROM w GROUP BY rid),
 m AS (SELECT rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '{blank}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
 FROM d LEFT JOIN cnt USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid))"""


def sql(spread: float = SPREAD, prior: int = PRIOR) -> str:
    """The rows of op4_quality_rules in DuckDB."""
    cells = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS measure, {n} AS place, CAST(floor(ln({odds}) * {BUCKETS}) AS INT) AS bucket, {BASE_FAILED} AS base_failed FROM m" for n, (k, (odds, _)) in enumerate(RULES.items()))

    def of(*keys: str) -> str:
        group = ", ".join([*keys, "measure"])
        ranked = f"SELECT {group}, bucket, sum(count(*)) OVER (PARTITION BY {group} ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY {group}) AS n FROM cell WHERE NOT base_failed GROUP BY {group}, bucket"
        return f"SELECT {group}, max(n) AS n, " + ", ".join(f"CAST(min(bucket) FILTER (upto * 4 >= n * {k}) AS DOUBLE) AS q{k}" for k in (1, 2, 3)) + f" FROM ({ranked}) GROUP BY {group}"

    drawn = ", ".join(f"(CAST(o.n AS DOUBLE) * o.q{k} + {prior} * p.q{k}) / (CAST(o.n AS DOUBLE) + {prior}) AS q{k}" for k in (1, 2, 3))
    slack = "CASE c.measure " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in SLACK.items()) + " ELSE 0 END"
    both = ", ".join(f"'{k}'" for k, (_, low) in RULES.items() if low)
    return f"""WITH {measures_sql()},
 cell AS ({cells}),
 q_all AS ({of()}), q_lang AS ({of("lang")}), q_own AS ({of("lang", "source")}),
 l AS (SELECT o.lang, o.measure, {drawn} FROM q_lang o JOIN q_all p ON o.measure = p.measure),
 f AS (SELECT lang, source, measure, q2 + {spread}::DOUBLE * greatest(q2 - q1, 1.0::DOUBLE) AS high, CASE WHEN measure IN ({both}) THEN q2 - {spread}::DOUBLE * greatest(q3 - q2, 1.0::DOUBLE) END AS low, q2 AS mid
 FROM (SELECT o.lang, o.source, o.measure, {drawn} FROM q_own o JOIN l p ON o.measure = p.measure AND o.lang IS NOT DISTINCT FROM p.lang)),
 bad AS (SELECT rid, string_agg(c.measure, ',' ORDER BY place) AS failed FROM cell c JOIN f ON c.measure = f.measure AND c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
 JOIN m USING (rid) WHERE bucket > high + {slack} OR (low IS NOT NULL AND bucket < low - {slack}) GROUP BY rid)
SELECT doc_id, {", ".join(BASE)}, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM m LEFT JOIN bad USING (rid)"""
