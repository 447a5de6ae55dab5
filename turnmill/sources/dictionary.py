"""Rewrite rules from and to JSON documents and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, wrong string, correct string, category string, strategy string, pattern string, context_hint array<string>, priority int, confidence double, enabled boolean, notes string"
CSV = "wrong string, correct string, category string, strategy string, priority string, enabled string, notes string"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON document with an array ``entries``; a broken document has none."""
    docs = spark.read.option("multiLine", True).schema(f"version string, entries array<struct<{ENTRY.replace(' ', ': ', 0)}>>".replace("struct<" + ENTRY, "struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in ENTRY.split(", "))))).json(path)
    return docs.select(F.inline("entries"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a CSV file with a header, maybe after a byte order mark; missing values get the defaults."""
    raw = spark.read.option("header", True).option("enforceSchema", True).schema(CSV).csv(path)
    clean = raw.withColumn("wrong", F.regexp_replace("wrong", "^﻿", ""))
    return clean.select(
        F.sha2(F.concat_ws("\x1f", "wrong", "correct", "strategy"), 256).substr(1, 12).alias("id"),
        "wrong",
        "correct",
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("strategy", F.lit("exact")).alias("strategy"),
        F.coalesce(F.col("priority").try_cast("int"), F.lit(50)).alias("priority"),
        (F.lower(F.coalesce("enabled", F.lit("true"))) == "true").alias("enabled"),
        "notes",
    ).where("wrong is not null and wrong <> ''")


def write_csv(rules: DataFrame, path: str) -> None:
    """CSV with a header; hints joined by a bar. A byte order mark comes before the header, as spreadsheets want it."""
    out = rules.withColumn("context_hint", F.array_join("context_hint", "|")) if "context_hint" in rules.columns else rules
    first = out.columns[0]
    out.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).csv(path)


def document(rules: DataFrame, version: str = "1.0") -> DataFrame:
    """One row with the rules as a JSON document, and when it was made."""
    rows = F.sort_array(F.collect_list(F.struct(*rules.columns)))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rules.agg(rows.alias("entries")).select(F.to_json(F.struct(F.lit(version).alias("version"), stamp.alias("updated_at"), "entries")).alias("value"))


def write_document(rules: DataFrame, path: str) -> None:
    """The rule table, a dimension, as one JSON document; ``updated_at`` is set."""
    document(rules).coalesce(1).write.mode("overwrite").text(path)


def imported(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules with others appended, none made distinct; new ones get ids of their own and defaults for what they lack."""
    rest = {"strategy": F.lit("exact"), "priority": F.lit(50), "confidence": F.lit(1.0), "enabled": F.lit(True), "category": F.lit("general")}
    cols = []
    for f in rules.schema.fields:
        if f.name == "id":
            cols.append(F.uuid().cast(f.dataType).alias("id"))
        else:
            cols.append((F.col(f.name) if f.name in new.columns else rest.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name))
    return rules.unionByName(new.select(*cols))


def vocabulary(df: DataFrame, raw: str) -> DataFrame:
    """(specialty, term) of JSON documents with a map of specialties; a broken document has none."""
    parsed = F.from_json(raw, "specialties map<string, struct<terms: array<string>, keywords: array<string>>>")["specialties"]
    return df.select(F.explode(parsed).alias("specialty", "s")).select("specialty", F.explode("s.terms").alias("term"))


REVIEW = "id string, original_word string, candidate_term string, similarity double, context_sentence string, specialty string, status string, created_at string"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The review queue of a JSON file; times as timestamps, contexts cut to 200 characters."""
    rows = spark.read.option("multiLine", True).schema(REVIEW).json(path)
    return rows.withColumn("created_at", F.to_timestamp("created_at")).withColumn("context_sentence", F.left("context_sentence", F.lit(200)))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """The queue as JSON lines, replaced as a whole."""
    reviews.write.mode("overwrite").json(path)


def seeded(spark: SparkSession, pairs: list[tuple[str, str]], category: str, base: int = 60) -> DataFrame:
    """Rules from hard-wired pairs: priority is the base plus the length of the wrong word."""
    rows = spark.createDataFrame(pairs, "wrong string, correct string")
    return rows.select("*", F.lit(category).alias("category"), F.lit("exact").alias("strategy"), (base + F.length("wrong")).alias("priority"), F.lit(True).alias("enabled"))
