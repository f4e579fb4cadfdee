"""Operator 4, license scans: diagonal voting, in DataFrame functions alone.

Words are cut from the folded text; every pair of consecutive words is hashed and joined
with the template positions that have the pair (a fixed table of a few hundred rows,
broadcast; the words themselves are compared too, so a hash that collides gives no hit).
A hit votes for a diagonal, the offset between text and template. Votes of a diagonal are
aggregated as a bit set of template positions; a base phrase counts where all its bits are
set. Diagonals of a template that lie within NEAR words of each other are merged, and the
merged span is verified by the share of template positions it covers.

One shuffle carries a row per document and the hits; texts are not shuffled.

Defined results: null counts as empty; no words give n_words 0, no label and score 0; each
row is a document of its own, also where doc_id is null or repeats; an empty table gives no
row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Phrases whose labels rest on all their words standing together.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates whose labels rest on the share of their word pairs found on near diagonals.
TEMPLATES = (
    ("licensed under the apache license version 2 0 the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under the creative commons attribution license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("copyright all rights reserved", "reserved"),
)
SHARE = 0.6
NEAR = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_pairs(spark: SparkSession) -> DataFrame:
    """One row per position of each template: the pair of words there, and what it is worth."""
    rows = []
    for k, (text, label) in enumerate((*BASE, *TEMPLATES)):
        words = text.split()
        rows += [(k, label, k < len(BASE), len(words) - 1, at, 1 << at, a, b) for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, at int, bit long, t_word string, t_next string")
    return table.withColumn("t_hash", F.xxhash64("t_word", "t_next"))


def folded(text):
    """ASCII capitals to small letters. Only two other letters have ASCII small forms; texts with these are folded letter by letter."""
    other = text.contains("\u212a") | text.contains("\u0130")
    return F.when(other, F.translate(text, UPPER, FOLDED)).otherwise(F.lower(text))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    words = F.array_remove(F.split(folded(F.coalesce(docs["text"].cast("string"), F.lit(""))), SEPARATORS), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), words.alias("words"))
    pairs = rows.select("row", "doc_id", F.posexplode_outer(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("next"))).alias("pos", "pair"))
    pairs = pairs.select("row", "doc_id", "pos", F.col("pair.words").alias("word"), F.col("pair.next").alias("next"), F.xxhash64("pair.words", "pair.next").alias("hash"))
    found = template_pairs(spark)
    hits = pairs.join(F.broadcast(found), (F.col("hash") == F.col("t_hash")) & (F.col("word") == F.col("t_word")) & (F.col("next") == F.col("t_next")), "left")
    # besides hits, the last word's row of each text is kept: it tells how many words there are
    hits = hits.where(F.col("template").isNotNull() | F.col("next").isNull())
    votes = hits.groupBy("row", "doc_id", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or("bit").alias("bits"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"), F.max(F.coalesce(F.col("pos") + 1, F.lit(0))).alias("reach")
    )
    votes = votes.repartition("row")
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("apart", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR, 0).otherwise(1))
    votes = votes.withColumn("band", F.sum("apart").over(order))
    merged = votes.groupBy("row", "doc_id", "template", "band").agg(
        F.bit_or("bits").alias("bits"),
        F.sum(F.when(F.col("base") & (F.bit_count("bits") == F.col("pairs")), 1).otherwise(0)).alias("places"),
        F.min(F.when(F.col("base") & (F.bit_count("bits") == F.col("pairs")), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("base") & (F.bit_count("bits") == F.col("pairs")), F.col("diagonal"))).alias("last"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"), F.max("reach").alias("reach"),
    )
    share = F.when(F.col("base"), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(F.bit_count("bits") / F.col("pairs"))
    merged = merged.withColumn("share", F.when(F.col("template").isNull(), 0.0).otherwise(share))
    labels = lambda ok: F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",")
    told = merged.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template").isNull(), F.col("reach"))).cast("long").alias("n_words"),
        F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        labels(F.col("base") & (F.col("places") > 0)).alias("base_labels"),
        labels(F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("share") >= SHARE)).alias("labels"),
        F.max("share").alias("score"),
    )
    return told.drop("row")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
