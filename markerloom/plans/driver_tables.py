"""Marker tables made from the relational tables of a data folder.

PS: parts are markers, suppliers individuals, line items reads; suppliers of even nations are M, the others F (unbiased).
WL: words are markers, (source, language, id modulo 6) individuals of the languages en and de (strongly biased).
DNA: the words of WL as sequences over ACGT. EV: event type and hour are markers, users individuals (dense).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.sources.readers import from_long
from markerloom.table import MarkerTable

#: Letters and the bases that stand for them, in order.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtgatctgcaacgtgatctgcaac"


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the data folder; one with fewer splits than the session has cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ps(spark: SparkSession, sf_dir: str) -> MarkerTable:
    who = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") % 2 == 0, "M").otherwise("F")).orderBy("s_suppkey")
    popmap = [tuple(r) for r in who.collect()]  # individuals
    long = _read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("depth"))
    key = F.col("l_partkey").cast("string")
    return from_long(long.select(key.alias("id"), key.alias("sequence"), F.col("l_suppkey").cast("string").alias("individual"), "depth"), [x for x, _ in popmap], popmap)


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``individual, lang, doc_id, word`` for each word of the documents in en and de."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").where(F.col("lang").isin("en", "de"))
    individual = F.concat_ws("_", "source", "lang", (F.col("doc_id") % 6).cast("string"))
    return docs.select(individual.alias("individual"), "lang", "doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")


def word_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``word, individual, lang, depth``, stored so that the texts are read once; and the individuals that have a word, in
    order, with their languages."""
    counts = stored(words_of(spark, sf_dir).groupBy("word", "individual", "lang").agg(F.count("*").alias("depth")), "words")
    return counts, [tuple(r) for r in counts.select("individual", "lang").distinct().orderBy("individual").collect()]  # individuals


def wl(spark: SparkSession, sf_dir: str) -> MarkerTable:
    counts, popmap = word_counts(spark, sf_dir)
    return from_long(counts.select(F.col("word").alias("id"), F.col("word").alias("sequence"), "individual", "depth"), [x for x, _ in popmap], popmap)


def people(spark: SparkSession, sf_dir: str) -> list[str]:
    """Individuals that have a word, in order; the first letter of a text is all that is looked for."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").where(F.col("lang").isin("en", "de") & F.lower("text").rlike("[a-z]"))
    individual = F.concat_ws("_", "source", "lang", (F.col("doc_id") % 6).cast("string"))
    return [r[0] for r in docs.select(individual.alias("individual")).distinct().orderBy("individual").collect()]  # individuals


def dna_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``individual, lang, sequence``: a read for each word of eight letters or more."""
    return words_of(spark, sf_dir).where(F.length("word") >= 8).select("individual", "lang", F.translate("word", LETTERS, BASES).alias("sequence"))


def dna(spark: SparkSession, sf_dir: str, *langs: str) -> list[MarkerTable]:
    """Sequences of each language, not normalised; individuals are those of the language."""
    counts, popmap = word_counts(spark, sf_dir)
    counts = counts.where(F.length("word") >= 8).select(F.translate("word", LETTERS, BASES).alias("sequence"), "individual", "lang", "depth")
    each = counts.groupBy("sequence", "individual", "lang").agg(F.sum("depth").alias("depth"))
    return [from_long(each.where(F.col("lang") == x).select(F.col("sequence").alias("id"), "sequence", "individual", "depth"), [i for i, g in popmap if g == x]) for x in langs]


def ev(spark: SparkSession, sf_dir: str) -> MarkerTable:
    events = _read(spark, sf_dir, "events", "user_id", "event_type", "ts").where("user_id IS NOT NULL")
    people = [r[0] for r in events.select("user_id").distinct().orderBy("user_id").collect()]  # individuals
    key = F.concat_ws("_", "event_type", F.hour("ts").cast("string"))
    long = events.groupBy(key.alias("id"), F.col("user_id").cast("string").alias("individual")).agg(F.count("*").alias("depth"))
    popmap = [(str(u), "even" if u % 2 == 0 else "odd") for u in people]
    return from_long(long.select("id", F.col("id").alias("sequence"), "individual", "depth"), [x for x, _ in popmap], popmap)


#: Where markers of :func:`planted` are cut from their contigs, and how long they are before they are changed.
PLANTED_AT, PLANTED = 100, 120
_CAPITALS = LETTERS.upper()


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contigs (contig, sequence): the letters of each document as bases. Markers (id, contig, planted_strand, planted, sequence)
    of those of 400 bases or more; ``planted`` is the score of what was done to them."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    letters = F.regexp_replace(F.translate("text", _CAPITALS, LETTERS), "[^a-z]", "")
    contigs = stored(docs.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("contig"), F.translate(letters, LETTERS, BASES.upper()).alias("sequence")), "contigs")
    n = F.col("doc_id") % 10 + 1
    cut = lambda at, size: F.substring("sequence", F.lit(at), size if isinstance(size, int) else size.cast("int"))
    half = PLANTED // 2
    begin = PLANTED_AT + 1
    swapped = lambda at: F.translate(F.substring("sequence", at, 1), "ACGT", "CGTA")
    kind = F.col("doc_id") % 4
    sequence = (
        F.when(kind == 0, F.concat(cut(begin, half), F.substring(F.col("sequence"), (F.lit(begin + half) + n).cast("int"), (F.lit(half) - n).cast("int"))))
        .when(kind == 1, F.concat(cut(begin, half), F.substring(F.lit("GATTACAGAT"), F.lit(1), n.cast("int")), cut(begin + half, half)))
        .when(kind == 2, F.concat(cut(begin, 20), swapped(begin + 20), cut(begin + 21, 69), swapped(begin + 90), cut(begin + 91, PLANTED - 91)))
        .otherwise(cut(begin, PLANTED))
    )
    score = F.when(kind == 0, 2 * (PLANTED - n) - 12 - 2 * n).when(kind == 1, 2 * PLANTED - 12 - 2 * n).when(kind == 2, 2 * (PLANTED - 2) - 16).otherwise(2 * PLANTED)
    markers = contigs.where(F.length("sequence") >= 400).select(F.concat(F.lit("m"), "doc_id").alias("id"), "contig", F.when(F.col("doc_id") % 8 < 4, "+").otherwise("-").alias("planted_strand"), score.alias("planted"), sequence.alias("own"))
    return contigs.select("contig", "sequence"), markers.select("id", "contig", "planted_strand", "planted", F.when(F.col("planted_strand") == "+", F.col("own")).otherwise(F.reverse(F.translate("own", "ACGT", "TGCA"))).alias("sequence"))


def planted_sql() -> str:
    return f"""letters AS (SELECT doc_id, regexp_replace(translate(text, '{_CAPITALS}', '{LETTERS}'), '[^a-z]', '', 'g') AS s FROM documents),
planted AS (SELECT 'm' || doc_id AS id, 'doc' || doc_id AS contig, CASE doc_id % 4 WHEN 0 THEN 2 * ({PLANTED} - (doc_id % 10 + 1)) - 12 - 2 * (doc_id % 10 + 1) WHEN 1 THEN 2 * {PLANTED} - 12 - 2 * (doc_id % 10 + 1) WHEN 2 THEN 2 * {PLANTED - 2} - 16 ELSE 2 * {PLANTED} END AS planted FROM letters WHERE length(s) >= 400)"""
