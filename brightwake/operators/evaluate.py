"""Quality of labels against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import query, tables


def per_label(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label from (label, gold, predicted) rows; 0 where undefined."""
    gold, predicted = F.col("gold"), F.col("predicted")
    counts = pairs.groupBy("label").agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))
    return counts.withColumns(rates())


def rates() -> dict:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return {"precision": precision, "recall": recall, "f1": f1}


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents against two simple rules."""
    rows = tables(spark, d, "labels").join(tables(spark, d, "documents"), "doc_id")
    toxic = F.lower("text").rlike("idiot|stupid|trash|scum|moron")
    each = F.explode(F.array(F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("gold"), toxic.alias("predicted")), F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 300).alias("predicted"))))
    return rows.select(each.alias("e")).select("e.*")


_PAIRS = """WITH j AS (SELECT * FROM labels JOIN documents USING (doc_id)), pairs AS (SELECT 'toxic' AS label, toxic = 1 AS gold, regexp_matches(lower(text), 'idiot|stupid|trash|scum|moron') AS predicted FROM j
UNION ALL SELECT 'quality', quality = 1, n_chars >= 300 FROM j), c AS (SELECT label, count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp, count(*) FILTER (gold AND NOT predicted) AS fn FROM pairs GROUP BY label),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c)"""


@query("e01_macro_micro", f"{_PAIRS}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c) SELECT 'macro' AS average, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM m UNION ALL SELECT 'micro', round(tp / (tp + fp), 4), round(tp / (tp + fn), 4), round(2 * tp / (2 * tp + fp + fn), 4) FROM s", base=False)
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    each = per_label(_pairs(spark, d))
    names = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro").alias("average"), *(F.round(F.avg(n), 4).alias(n) for n in names))
    total = each.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumns(rates())
    return macro.unionByName(total.select(F.lit("micro").alias("average"), *(F.round(n, 4).alias(n) for n in names)))


@query("e02_per_label", f"{_PAIRS} SELECT label, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, tp + fn AS positives FROM m", base=False)
def per_label_query(spark: SparkSession, d: str) -> DataFrame:
    each = per_label(_pairs(spark, d))
    return each.select("label", "tp", "fp", "fn", *(F.round(n, 4).alias(n) for n in ("precision", "recall", "f1")), (F.col("tp") + F.col("fn")).alias("positives"))


@query("e03_golden_accuracy", f"{_PAIRS} SELECT label, round(avg((gold = predicted)::INT), 4) AS accuracy, count(*) AS n FROM pairs GROUP BY label", base=False)
def golden_accuracy(spark: SparkSession, d: str) -> DataFrame:
    same = (F.col("gold") == F.col("predicted")).cast("int")
    return _pairs(spark, d).groupBy("label").agg(F.round(F.avg(same), 4).alias("accuracy"), F.count("*").alias("n"))
