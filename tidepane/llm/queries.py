"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.llm import bitmaps, mix, percentiles, spam, tokens
from tidepane.session import written
from tidepane.sources.tables import table

GROUPS = list(bitmaps.GROUP_LABELS)


def _daily(spark: SparkSession, folder: str) -> tuple[DataFrame, bitmaps.Codebook]:
    """Words of the stored daily bitmaps, and their codebook."""
    series = table(spark, folder, "series")
    book = bitmaps.codebook(series)
    return bitmaps.unpack(bitmaps.daily_bitmaps(table(spark, folder, "samples"), bitmaps.coded_series(series, book))), book


def p1_daily(spark: SparkSession, folder: str) -> DataFrame:
    words, book = _daily(spark, folder)
    return bitmaps.counts_by_kind(bitmaps.united_groups(words, ["counted", "day"]), ["day", *GROUPS], book)


def p1_united(spark: SparkSession, folder: str) -> DataFrame:
    """All days united, from the stored form of the daily bitmaps."""
    words, book = _daily(spark, folder)
    return bitmaps.counts_by_kind(bitmaps.united_groups(words, ["counted"]), GROUPS, book)


def p1_returning(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of a day that were also there the day before, per region."""
    keys = ["day", "region", "counted"]
    words, book = _daily(spark, folder)
    days = written(bitmaps.unite(words, keys), "days")
    prior = days.withColumn("day", F.col("day") + 1)
    return bitmaps.counts_by_kind(bitmaps.intersect(days, prior, keys), ["day", "region"], book)


#: Where the later days begin (2026-03-05, in days since 1970).
LATER_DAYS = 20_517


def p1_extended(spark: SparkSession, folder: str) -> DataFrame:
    """All days united where the later ones were built with more series: the codes of the earlier days' series are extended."""
    samples, series = table(spark, folder, "samples"), table(spark, folder, "series")
    early = F.col("timestamp_ms") < LATER_DAYS * bitmaps.DAY_MS
    seen = samples.where(early).select(F.col("series_id").alias("id")).distinct()
    first = series.join(seen, "id", "left_semi")
    book = bitmaps.codebook(first)
    days = bitmaps.daily_bitmaps(samples.where(early), bitmaps.coded_series(first, book))
    more = bitmaps.codebook(series, book)
    later = bitmaps.daily_bitmaps(samples.where(~early), bitmaps.coded_series(series, more))
    words = bitmaps.unpack(days.unionByName(later))
    return bitmaps.counts_by_kind(bitmaps.united_groups(words, ["counted"]), GROUPS, more)


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(percentiles.value_runs(table(spark, folder, "samples"), table(spark, folder, "series")))


def p3_within_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each metric apart for each value of each label."""
    runs = percentiles.value_runs(table(spark, folder, "samples"), table(spark, folder, "series"))
    return percentiles.percentiles(runs, [f"metric,{g}" for g in percentiles.GROUP_LABELS])


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from runs that were made apart for each of three groups of days and merged."""
    samples, series = table(spark, folder, "samples"), table(spark, folder, "series")
    part = F.pmod(F.coalesce(F.floor(F.col("timestamp_ms") / bitmaps.DAY_MS), F.lit(0)), F.lit(3))
    apart = [written(percentiles.value_runs(samples.where(part == i), series), "runs") for i in range(3)]
    return percentiles.percentiles(percentiles.merge_runs(*apart))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decoded_texts(p7_ids(spark, folder))


#: Domains of the sources.
DOMAINS = {"team_mail": "internal", "board": "internal", "legal": "internal", "helpdesk": "service", "webform": "service", "announce": "lists", "dev_list": "lists", "partners": "external", "field_notes": "field", "voice_memos": "field"}


def _mix(spark: SparkSession, folder: str, **options) -> mix.Mix:
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), domains=DOMAINS, **options)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).selected


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares


def p8_one_pass_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mix as large as the target sources: scarce ones stay short, the others make it up."""
    return _mix(spark, folder, passes=1.0).shares


def _kept(m: mix.Mix, targets: DataFrame) -> DataFrame:
    """Per target source: its usable documents, and whether the mix keeps what it promises.

    ``whole``: each use of a document has the document's size, and it is in the
    corpus. ``capped``: no document is used more often than it may be. ``even``:
    within a leaf nobody is used twice more often than another. ``fair``: each
    leaf has its share of the mix, or all it can give, but for half a document.
    ``budgeted``: each leaf has the tokens planned for it, but for half a document.
    """
    spark, leaf = targets.sparkSession, ["source", "language"]
    uses = m.selected.groupBy("doc_id", "source", "language").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("epoch").alias("epochs"), F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi"))
    each = m.sizes.join(uses, ["doc_id", *leaf], "full").withColumn("uses", F.coalesce("uses", F.lit(0)))
    whole = F.col("n_tokens").isNotNull() & ((F.col("uses") == 0) | (F.col("lo") == F.col("n_tokens")) & (F.col("hi") == F.col("n_tokens")) & (F.col("epochs") == F.col("uses")))
    used = F.col("n_tokens") * F.col("uses")
    leaves = each.groupBy(*leaf).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("have"), F.sum(used).alias("used"), F.min("uses").alias("least"), F.max("uses").alias("most"), F.max("n_tokens").alias("largest"), F.bool_and(whole).alias("whole"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    planned = spark.createDataFrame([(s, lang, float(v)) for (_, lang, s), v in m.budgets.items()], "source string, language string, budget double")
    size = float(sum(m.budgets.values()))
    laid = leaves.join(wanted, "source").join(F.broadcast(planned), leaf, "left")  # one row per leaf
    of_source = laid.groupBy("source").agg(F.sum("have").alias("source_have"))
    shares = laid.join(of_source, "source")
    all_shares = laid.select("source", "target_share").distinct().agg(F.coalesce(F.sum("target_share"), F.lit(1.0)).alias("s")).first()["s"]
    fair = F.least(F.col("have") * F.col("max_repeats"), F.lit(size / all_shares) * F.col("target_share") * F.col("have") / F.col("source_have"))
    off = F.col("largest") / 2 + 1e-6 * F.lit(size)
    flags = shares.groupBy("source").agg(
        F.sum("documents").alias("documents"), F.bool_and("whole").alias("whole"), F.bool_and(F.col("most") <= F.col("max_repeats")).alias("capped"), F.bool_and(F.col("most") - F.col("least") <= 1).alias("even"),
        F.bool_and(F.col("used") >= fair - off).alias("fair"), F.bool_and(F.abs(F.col("used") - F.coalesce("budget", F.lit(0.0))) <= off).alias("budgeted"),
    )
    true = F.lit(True)
    return wanted.join(flags, "source", "left").select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), *[F.coalesce(k, true).alias(k) for k in ("whole", "capped", "even", "fair", "budgeted")])


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix promises of each source, checked on the mix."""
    return _kept(_mix(spark, folder), table(spark, folder, "mix_targets"))


def p8_kept_short(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a mix of twice the tokens there are: sources, languages and whole domains are short."""
    return _kept(_mix(spark, folder, passes=2.0), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents")).select("doc_id")


def p9_features(spark: SparkSession, folder: str) -> DataFrame:
    """Word features of each mail's body as it stands, before any decoding."""
    body = F.expr("substring(text, greatest(1, instr(text, '\n\n')))")
    return spam.word_features(table(spark, folder, "documents").select("doc_id", body.alias("body")), text="body")


def p9_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated thresholds of each language."""
    return spam.calibrated(spam.at_cut(written(spam.part_features(table(spark, folder, "documents")), "features")))


QUERIES = {f.__name__: f for f in (p1_daily, p1_united, p1_returning, p1_extended, p3_percentiles, p3_within_metrics, p3_merged, p7_ids, p7_decoded, p8_mix, p8_shares, p8_one_pass_shares, p8_kept, p8_kept_short, p9_found, p9_features, p9_thresholds)}

_SEEN = """
WITH seen AS (
  SELECT CAST(floor(timestamp_ms / 86400000) AS BIGINT) AS day, coalesce(labels['region'], '') AS region, coalesce(labels['job'], '') AS job,
         coalesce(labels['service'], '') AS service, series_id, nullif(labels['instance'], '') AS instance, nullif(labels['pod'], '') AS pod
  FROM samples JOIN series ON series_id = id WHERE timestamp_ms IS NOT NULL
)"""
_COUNTS = "count(DISTINCT series_id) AS n_series, count(DISTINCT instance) AS n_instance, count(DISTINCT pod) AS n_pod"


_SINGLE = "SELECT 'metric' AS dimension, metric AS grp, value FROM v UNION ALL SELECT 'job', job, value FROM v UNION ALL SELECT 'region', region, value FROM v UNION ALL SELECT 'service', service, value FROM v"
_WITHIN = " UNION ALL ".join(f"SELECT 'metric,{g}' AS dimension, CAST(to_json([metric, {g}]) AS VARCHAR) AS grp, value FROM v" for g in percentiles.GROUP_LABELS)
_P3 = """
WITH v AS (
  SELECT coalesce(metric, '') AS metric, coalesce(labels['job'], '') AS job, coalesce(labels['region'], '') AS region, coalesce(labels['service'], '') AS service,
         CASE WHEN value = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS value
  FROM samples JOIN series ON series_id = id WHERE value IS NOT NULL AND NOT isnan(value)
), d AS (
  DIMENSIONS
), r AS (
  SELECT *, row_number() OVER (PARTITION BY dimension, grp ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY dimension, grp) AS n FROM d
), q AS (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q
), p AS (
  SELECT dimension, grp, q, n, q * (n - 1) - floor(q * (n - 1)) AS share,
         max(value) FILTER (rank = floor(q * (n - 1))) AS lo, max(value) FILTER (rank = ceil(q * (n - 1))) AS hi
  FROM r, q WHERE rank BETWEEN floor(q * (n - 1)) AND ceil(q * (n - 1)) GROUP BY ALL
)
SELECT dimension, grp, q, n, CASE WHEN lo = hi THEN lo WHEN isinf(lo) AND isinf(hi) THEN CAST('NaN' AS DOUBLE) WHEN isinf(lo) THEN lo WHEN isinf(hi) THEN hi ELSE lo + (hi - lo) * share END AS value FROM p
"""

_FUNCTIONS = ", ".join("('{}', '{}')".format(language, w.replace("'", "''")) for language, words in spam.FUNCTION_WORDS.items() for w in words.split())
_P9 = f"""
WITH functions AS (SELECT * FROM (VALUES {_FUNCTIONS}) f(language, w)
), bodies AS (
  SELECT row_number() OVER () AS k, doc_id, substr(text, greatest(1, strpos(text, chr(10) || chr(10)))) AS body FROM documents
), lists AS (
  SELECT *, coalesce(regexp_extract_all(lower(body), '(?:[cdjlmnst]|qu)''|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:-[\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*'), []) AS ws FROM bodies
), words AS (
  SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM lists
), counts AS (
  SELECT k, w, count(*) AS n FROM words GROUP BY k, w
), tops AS (
  SELECT k, sum(n) FILTER (place <= 3) AS top, count(*) AS distinct_words FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS place FROM counts) GROUP BY k
), pairs AS (
  SELECT k, max(n) AS pair FROM (SELECT a.k, count(*) AS n FROM words a JOIN words b ON a.k = b.k AND a.i + 1 = b.i GROUP BY a.k, a.w, b.w) GROUP BY k
), spoken AS (
  SELECT k, max(n) AS function_words FROM (SELECT k, language, sum(n) AS n FROM counts JOIN functions USING (w) GROUP BY k, language) GROUP BY k
)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS words, CASE WHEN len(ws) = 0 THEN CAST(0 AS DOUBLE) ELSE top / CAST(len(ws) AS DOUBLE) END AS top,
       CASE WHEN len(ws) = 0 THEN CAST(0 AS DOUBLE) ELSE distinct_words / CAST(len(ws) AS DOUBLE) END AS "distinct",
       CASE WHEN coalesce(pair, 0) > 2 THEN pair / CAST(len(ws) - 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pair,
       CAST(coalesce(function_words, 0) AS INTEGER) AS function_words, CAST(len(coalesce(regexp_extract_all(body, '[,;|·~*、•>\\]]|\\.\\.\\.'), [])) AS INTEGER) AS separators
FROM lists LEFT JOIN tops USING (k) LEFT JOIN pairs USING (k) LEFT JOIN spoken USING (k)
"""

_P8 = """SELECT t.source, max(t.target_share) AS target_share, count(d.doc_id) AS documents, TRUE AS whole, TRUE AS capped, TRUE AS even, TRUE AS fair, TRUE AS budgeted
FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY t.source"""

ORACLES = {
    "p1_daily": _SEEN + f" SELECT day, region, job, service, {_COUNTS} FROM seen GROUP BY day, CUBE (region, job, service)",
    "p1_united": _SEEN + f" SELECT region, job, service, {_COUNTS} FROM seen GROUP BY CUBE (region, job, service)",
    "p1_extended": _SEEN + f" SELECT region, job, service, {_COUNTS} FROM seen GROUP BY CUBE (region, job, service)",
    "p1_returning": _SEEN + """, kinds AS (
  SELECT day, region, 'series' AS counted, CAST(series_id AS VARCHAR) AS x FROM seen UNION SELECT day, region, 'instance', instance FROM seen UNION SELECT day, region, 'pod', pod FROM seen
), stayed AS (
  SELECT a.day, a.region, a.counted, a.x FROM kinds a JOIN kinds b ON a.day = b.day + 1 AND a.region = b.region AND a.counted = b.counted AND a.x = b.x
) SELECT day, region, count(*) FILTER (counted = 'series') AS n_series, count(*) FILTER (counted = 'instance') AS n_instance, count(*) FILTER (counted = 'pod') AS n_pod FROM stayed GROUP BY day, region""",
    "p3_percentiles": _P3.replace("DIMENSIONS", _SINGLE),
    "p3_merged": _P3.replace("DIMENSIONS", _SINGLE),
    "p3_within_metrics": _P3.replace("DIMENSIONS", _WITHIN),
    "p8_kept": _P8,
    "p8_kept_short": _P8,
    "p9_features": _P9,
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
