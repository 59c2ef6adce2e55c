"""Queries over documents (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.llm import bpe, langid, packing
from commitlake.session import materialise
from commitlake.sources.tables import table

#: context_windows is read to the driver; more models than this are refused.
MAX_MODELS = 1000


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents, in at least as many parts as there are cores.

    Encoding and scoring read each text once, where it is: a large table has parts enough, and its texts are never
    shuffled. One of few parts (small files, or a single one) is spread, for then the cores count and the shuffle is small.
    """
    docs = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores, "doc_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(_documents(spark, folder), "text", ["doc_id"])


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the number of their tokens and whether decoding gives the text back (NULL reads as empty)."""
    coded = bpe.encode(_documents(spark, folder), "text", ["doc_id", "text"], count="n_tokens")
    back = bpe.decode(coded, "ids", ["doc_id", "text", "n_tokens"], text="decoded")
    return back.select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def windows(spark: SparkSession, folder: str) -> dict[str, int]:
    """Model -> window; the table is fixed and small, which is checked."""
    rows = table(spark, folder, "context_windows").where("window_tokens > 0").groupBy("model").agg(F.min("window_tokens").alias("w")).limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"context_windows has more than {MAX_MODELS} models")
    return {r["model"]: int(r["w"]) for r in rows}


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document for each distinct window; empty texts are copies of nothing."""
    docs = _documents(spark, folder).withColumn("text_hash", F.when(F.col("text") != "", F.xxhash64("text")))
    sizes = materialise(bpe.encode(docs, "text", ["doc_id", "source", "text_hash"], ids=None, count="n_tokens"), "sizes")
    items = packing.duplicate_clusters(sizes, "text_hash")
    return packing.fill(items, key="doc_id", size="n_tokens", capacities=sorted(set(windows(spark, folder).values())), source="source", cluster="cluster")


def _models(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """``found`` once for each model whose window is its capacity."""
    by_window: dict[int, list[str]] = {}
    for model, window in sorted(windows(spark, folder).items()):
        by_window.setdefault(window, []).append(model)
    models = F.create_map(*(x for w, names in by_window.items() for x in (F.lit(w).cast("bigint"), F.array(*map(F.lit, names)))))
    return found.withColumn("model", F.explode(models[F.col("capacity")])).withColumnRenamed("capacity", "window_tokens")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of each text or piece, for every model's window."""
    return _models(spark, folder, packed(spark, folder)).select("model", "window_tokens", "container_id", "place", "offset", "doc_id", "piece", "piece_start", "piece_size")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least number that could do, and the share filled, by model."""
    found = packed(spark, folder)
    boxes = found.groupBy("capacity").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("piece_size").alias("n_tokens"), F.count("*").alias("n_pieces"))
    least = F.ceil(F.col("n_tokens") / F.col("window_tokens")).alias("least_containers")
    return _models(spark, folder, boxes).select("model", "window_tokens", "n_pieces", "n_tokens", "n_containers", least, (F.col("n_tokens") / (F.col("n_containers") * F.col("window_tokens"))).alias("share_filled"))


def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    """By model: the documents placed, and how often a rule of the containers is broken, which is never.

    n_over: containers above their window; n_cut: documents in several pieces that fit one container; n_twice:
    containers with two copies of a text; n_gaps: pieces that do not begin where the one before them ends, in the
    container or in the document.
    """
    texts = table(spark, folder, "documents").select("doc_id", F.when(F.col("text") != "", F.xxhash64("text")).alias("h"))
    found = packed(spark, folder).join(texts, "doc_id")
    box = Window.partitionBy("capacity", "container_id").orderBy("place")
    own = Window.partitionBy("capacity", "doc_id").orderBy("piece")
    off = lambda start, size, w: (F.coalesce(F.lag(F.col(start) + F.col(size)).over(w), F.lit(0)) != F.col(start)).cast("bigint")
    placed = found.withColumns({"gap": off("offset", "piece_size", box), "gap2": off("piece_start", "piece_size", own)})
    boxes = placed.groupBy("capacity", "container_id").agg(F.sum("piece_size").alias("held"), F.sum(F.col("gap") + F.col("gap2")).alias("gaps"), F.count("h").alias("n"), F.count_distinct("h").alias("d"))
    rules = boxes.groupBy("capacity").agg(*(F.sum(c.cast("bigint")).alias(n) for n, c in (("n_over", F.col("held") > F.col("capacity")), ("n_twice", F.col("n") > F.col("d")), ("n_gaps", F.col("gaps")))))
    docs = found.groupBy("capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("size"))
    cut = docs.groupBy("capacity").agg(F.count("*").alias("n_documents"), F.sum(((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).cast("bigint")).alias("n_cut"))
    return _models(spark, folder, rules.join(cut, "capacity")).select("model", "n_documents", "n_over", "n_cut", "n_twice", "n_gaps")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their language, further languages and segments."""
    docs = _documents(spark, folder)
    model = langid.fit(docs, table(spark, folder, "lang_samples"))
    return langid.identify(docs, model, keep=["doc_id", "lang"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose label is missing, names no or another language, or that hold a further language."""
    named = F.lower(F.trim(F.regexp_extract("lang", r"^\s*([A-Za-z]+)\s*(?:[-_].*)?$", 1)))
    codes = F.create_map(*(F.lit(x) for code, more in langid.CODES.items() for alias in (code, *more) for x in (alias, code)))
    found = judged(spark, folder).where(F.col("found_lang").isNotNull()).withColumn("label", F.try_element_at(codes, F.coalesce(named, F.lit(""))))
    cases = found.where(F.col("label").isNull() | (F.col("label") != F.col("found_lang")) | (F.size("other_langs") > 0))
    rows = F.concat(F.array(F.struct("found_lang", F.lit("main").alias("share"))), F.transform("other_langs", lambda x: F.struct(x.alias("found_lang"), F.lit("other").alias("share"))))
    return cases.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every segment: doc_id, segment_no, start, end, lang, confidence."""
    rows = judged(spark, folder).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("doc_id", "segment_no", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.lang").alias("found_lang"), F.round("s.confidence", 6).alias("confidence"))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every document that is not blank."""
    return judged(spark, folder).where(F.col("found_lang").isNotNull()).select("doc_id", "found_lang", F.round("confidence", 6).alias("confidence"), F.size("segments").alias("n_segments"))


QUERIES = {q.__name__: q for q in (p6_ids, p6_round_trip, p7_containers, p7_fill, p7_valid, p8_found, p8_segments, p8_documents)}
ORACLES: dict[str, str] = {
    "p7_valid": "SELECT model, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0 AS n_over, 0 AS n_cut, 0 AS n_twice, 0 AS n_gaps FROM context_windows WHERE window_tokens > 0",
}
