"""URL filter: rules first, then the ratio of two character language models.

The urls that rules allow and those that they block train a model each: a Markov model over a fixed
alphabet whose order varies with what was seen, by Witten-Bell smoothing from two characters of
context down to none.  A url's score is the mean over its characters of the difference of the log
likelihoods, and the cut lies between the two classes' mean scores, nearer to the one that
varies less.

All of it is DataFrame operations.  A model has at most ``len(ALPHABET) + 1`` to the power 3 cells, so
both fit one array of log ratios of some 117,000 doubles whatever the input; it reaches the urls as a
scalar subquery, and scoring takes one lookup a character, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut_lineage, table

# The rules of the contract, in its order.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%:~+"
SIZE = len(ALPHABET) + 1  # 0: any other character, and what stands before the first
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: len(x[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def with_cells(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``cells``: for each character of the text the cell of it and the two before it."""
    symbols = F.expr(f"concat(array(0, 0), transform(filter(split({text_col}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c)))")
    cells = F.expr(
        f"CASE WHEN size(_s) <= 2 THEN array() ELSE transform(slice(_s, 3, size(_s) - 2), (c, i) -> element_at(_s, i + 1) * {SIZE * SIZE} + element_at(_s, i + 2) * {SIZE} + c) END"
    )
    return df.withColumn("_s", symbols).withColumn("cells", cells.cast("array<int>")).drop("_s")


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row with the array of log ratios, cell by cell; ``counts``: verdict, cell, n."""
    spark = counts.sparkSession
    grid = spark.range(0, SIZE**3, 1, 8).select(
        F.col("id").cast("int").alias("cell"),
        F.floor(F.col("id") / SIZE).cast("int").alias("context"),
        (F.col("id") % (SIZE * SIZE)).cast("int").alias("pair"),
        F.floor(F.col("id") / SIZE % SIZE).cast("int").alias("last"),
        (F.col("id") % SIZE).cast("int").alias("symbol"),
    )
    for name in ("allow", "block"):
        three = counts.where(F.col("verdict") == name).select("cell", F.col("n").cast("double").alias("n3"))
        two = three.groupBy((F.col("cell") % (SIZE * SIZE)).alias("pair")).agg(F.sum("n3").alias("n2"))
        one = two.groupBy((F.col("pair") % SIZE).alias("symbol")).agg(F.sum("n2").alias("n1"))
        of3 = three.groupBy(F.floor(F.col("cell") / SIZE).cast("int").alias("context")).agg(F.sum("n3").alias("s3"), F.count("*").alias("t3"))
        of2 = two.groupBy(F.floor(F.col("pair") / SIZE).cast("int").alias("last")).agg(F.sum("n2").alias("s2"), F.count("*").alias("t2"))
        of1 = one.agg(F.sum("n1").alias("s1"), F.count("*").alias("t1"))
        whole = cut_lineage(of1).withColumn("_all", F.lit(0))
        grid = grid.join(three, "cell", "left").join(two, "pair", "left").join(one, "symbol", "left").join(of3, "context", "left").join(of2, "last", "left")
        grid = grid.withColumn("_all", F.lit(0)).join(F.broadcast(whole), "_all").drop("_all")  # one row
        z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        p1 = F.when(z("s1") > 0, (z("n1") + z("t1") / SIZE) / (z("s1") + z("t1"))).otherwise(F.lit(1.0 / SIZE))
        p2 = F.when(z("s2") > 0, (z("n2") + z("t2") * p1) / (z("s2") + z("t2"))).otherwise(p1)
        p3 = F.when(z("s3") > 0, (z("n3") + z("t3") * p2) / (z("s3") + z("t3"))).otherwise(p2)
        grid = grid.withColumn(name, p3).drop("n3", "n2", "n1", "s3", "t3", "s2", "t2", "s1", "t1")
    ratio = F.log("allow") - F.log("block")
    return grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", ratio.alias("ratio")))), lambda x: x["ratio"]).alias("ratios"))


def judge(pages: DataFrame, *, url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict added.

    A url that no rule fits is allowed if its score reaches the cut.  Null urls, and those without
    ``://``, have empty hosts, paths and texts and score 0.  If rules leave one of the classes empty there is
    nothing to compare, and all other urls are allowed.  Columns of ``pages`` with the added names
    are replaced.
    """
    own = ["host", "path", "rule", "score", "verdict"]
    pages = pages.drop(*own)
    url = F.col(url_col)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.translate(after_scheme(url), UPPER, LOWER).alias("text"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = with_cells(rows.withColumns({"rule": rule, "said": said}), "text")
    known = rows.where("said is not null")
    counts = cut_lineage(known.select(F.col("said").alias("verdict"), F.explode("cells").alias("cell")).groupBy("verdict", "cell").agg(F.count("*").alias("n")))
    ratios = cut_lineage(log_ratios(counts))
    mean = F.expr("aggregate(cells, 0.0D, (total, c) -> total + element_at(ratios, c + 1)) / greatest(size(cells), 1)")

    def scored(df: DataFrame) -> DataFrame:
        return df.withColumn("ratios", ratios.scalar()).withColumn("score", mean).drop("ratios")

    ends = scored(known).groupBy("said").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("d"))
    pick = lambda c, name: F.max(F.when(F.col("said") == name, F.col(c)))
    ends = ends.agg(pick("m", "allow").alias("ma"), pick("m", "block").alias("mb"), pick("d", "allow").alias("da"), pick("d", "block").alias("db"))
    cut = cut_lineage(ends.select(F.expr("CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END").alias("cut")))
    found = scored(rows).withColumn("cut", cut.scalar())
    method = F.when(F.round(F.col("score") - F.col("cut"), 9) < 0, "block").otherwise("allow")
    return found.select("row.*", "host", "path", "rule", "score", F.coalesce("said", method).alias("verdict"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(rest, '{UPPER}', '{LOWER}') AS text FROM p),
r AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r),
s AS (SELECT page_id, said, list_concat([0, 0], list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE instr('{ALPHABET}', c) END)) AS sy, length(text) AS n FROM v),
g AS (SELECT page_id, said, n, unnest(range(1, n + 1)) AS i, sy FROM s),
c AS (SELECT page_id, said, n, sy[i] AS a, sy[i + 1] AS b, sy[i + 2] AS c FROM g),
k3 AS (SELECT said, a, b, c, count(*) AS n FROM c WHERE said IS NOT NULL GROUP BY ALL),
k2 AS (SELECT said, b, c, sum(n) AS n FROM k3 GROUP BY ALL),
k1 AS (SELECT said, c, sum(n) AS n FROM k2 GROUP BY ALL),
o3 AS (SELECT said, a, b, sum(n) AS s, count(*) AS t FROM k3 GROUP BY ALL),
o2 AS (SELECT said, b, sum(n) AS s, count(*) AS t FROM k2 GROUP BY ALL),
o1 AS (SELECT said, sum(n) AS s, count(*) AS t FROM k1 GROUP BY ALL),
cells AS (SELECT DISTINCT a, b, c FROM c),
q AS (
  SELECT cells.*, m.said, coalesce(k3.n, 0)::DOUBLE AS n3, coalesce(k2.n, 0)::DOUBLE AS n2, coalesce(k1.n, 0)::DOUBLE AS n1,
         coalesce(o3.s, 0)::DOUBLE AS s3, coalesce(o3.t, 0)::DOUBLE AS t3, coalesce(o2.s, 0)::DOUBLE AS s2, coalesce(o2.t, 0)::DOUBLE AS t2,
         coalesce(o1.s, 0)::DOUBLE AS s1, coalesce(o1.t, 0)::DOUBLE AS t1
  FROM cells CROSS JOIN (VALUES ('allow'), ('block')) m(said)
  LEFT JOIN k3 ON k3.said = m.said AND k3.a = cells.a AND k3.b = cells.b AND k3.c = cells.c
  LEFT JOIN k2 ON k2.said = m.said AND k2.b = cells.b AND k2.c = cells.c
  LEFT JOIN k1 ON k1.said = m.said AND k1.c = cells.c
  LEFT JOIN o3 ON o3.said = m.said AND o3.a = cells.a AND o3.b = cells.b
  LEFT JOIN o2 ON o2.said = m.said AND o2.b = cells.b LEFT JOIN o1 ON o1.said = m.said),
q1 AS (SELECT *, CASE WHEN s1 > 0 THEN (n1 + t1 / {SIZE}) / (s1 + t1) ELSE 1.0::DOUBLE / {SIZE} END AS p1 FROM q),
q2 AS (SELECT *, CASE WHEN s2 > 0 THEN (n2 + t2 * p1) / (s2 + t2) ELSE p1 END AS p2 FROM q1),
q3 AS (SELECT a, b, c, said, CASE WHEN s3 > 0 THEN (n3 + t3 * p2) / (s3 + t3) ELSE p2 END AS p3 FROM q2),
ratio AS (SELECT a, b, c, ln(max(p3) FILTER (said = 'allow')) - ln(max(p3) FILTER (said = 'block')) AS x FROM q3 GROUP BY ALL),
sc AS (SELECT page_id, sum(x) / max(n) AS score FROM c JOIN ratio USING (a, b, c) GROUP BY page_id),
vs AS (SELECT v.*, coalesce(score, 0) AS score FROM v LEFT JOIN sc USING (page_id)),
e AS (SELECT avg(score) FILTER (said = 'allow') AS ma, avg(score) FILTER (said = 'block') AS mb,
             coalesce(stddev_pop(score) FILTER (said = 'allow'), 0) AS da, coalesce(stddev_pop(score) FILTER (said = 'block'), 0) AS db FROM vs),
cut AS (SELECT CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END AS cut FROM e)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN round(score - cut, 9) < 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM vs, cut
"""
