"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, kneser_ney, licenses, maglev, media_mpeg, mixing, ngram_join, packing, quality, secrets, separators, treaps
from .common import checkpoint_dir, delete, documents, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_mpeg.features(media_mpeg.media_column(documents(spark, sf_dir)))


#: 128 shards and 12,289 slots, about a hundred a shard: shares differ by about 1 %.
SHARDS = [f"shard-{i:03d}" for i in range(128)]
SLOTS = 12_289


def op2_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    return maglev.place(docs, "doc_id", SHARDS, SLOTS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of 16-bit identifiers that are written first and removed after."""
    import public_tokenizers

    folder, pattern, ranks = checkpoint_dir(spark), public_tokenizers.PATTERN, vocabulary("byte_bpe_50k.tiktoken")

    def encoder():
        enc = bpe.encoding(ranks, pattern)
        return lambda text: bpe.encode(text, enc)

    manifest = written(separators.write_files(documents(spark, sf_dir), f"{folder}/tokens", encoder, 50_256, "<u2"), f"{folder}/manifest")
    found = separators.scan(manifest.select("file", "n_tokens").distinct(), 50_256, "<u2")
    counted = separators.with_keys(found, manifest)
    counted = counted.withColumn("file", F.element_at(F.split("file", "/"), -1))
    out = written(counted, f"{folder}/counts")
    delete(spark, f"{folder}/tokens")
    return out


#: The end identifier that follows each packed document.
END_ID = 2


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID)


def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", kneser_ney.is_held_out(F.col("doc_id")))
    model = kneser_ney.train(docs.where("NOT held_out"))
    return kneser_ney.score(docs, model, keep=["doc_id", "held_out"])


def op7_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the licences confirmed in it, in their order; empty where there are none."""
    found = licenses.annotate(documents(spark, sf_dir))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join("found.license", ",").alias("licenses"), "found")


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


#: By name; in the order in which they were built.
QUERIES = {f.__name__: f for f in (op1_mpeg_audio, op2_maglev_sharding, op3_byte_bpe, op4_quality_rules, op5_separator_scan, op9_best_two_fit, op10_secret_battery, op8_ngram_jaccard, op6_kneser_ney, op7_license_compression, op11_inverted_treaps, op12_fair_mixing, op13_collocations)}


def _sql_op2() -> str:
    table = maglev.lookup_table(SHARDS, SLOTS)
    return f"""
        SELECT doc_id, source, n_bytes, slot, shard_id, 'shard-' || lpad(CAST(shard_id AS VARCHAR), 3, '0') AS shard
        FROM (SELECT *, CAST(([{",".join(map(str, table.tolist()))}])[slot + 1] AS INTEGER) AS shard_id
              FROM (SELECT doc_id, source, CAST(strlen(text) AS INTEGER) AS n_bytes,
                           CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot
                    FROM documents))"""


def oracle_sql() -> dict[str, str]:
    return {"op2_maglev_sharding": _sql_op2(), "op11_inverted_treaps": treaps.SQL, "op12_fair_mixing": mixing.SQL, "op13_collocations": collocations.SQL}
