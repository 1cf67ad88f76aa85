"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, fingerprint, hard_negatives, langid, license_scan, line_dedup, packing, periodic, pii, sharding, simhash, substring_dedup


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs(spark, sf_dir))
    return out.select(
        "doc_id", "lines_total", "lines_cut", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5")
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(docs(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out("doc_id", 3, 1)
    rows = docs(spark, sf_dir)
    net = langid.fit(rows.filter(~held))
    return langid.identify(rows.select("doc_id", "text", held.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave_shards(docs(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def document_path() -> Column:
    """A tree of files for documents, which have no paths: source, block of 2,000 ids, and for longer texts a block of 100; one
    in 97 is a licence file by its name."""
    block = lambda n: (F.col("doc_id") / n).cast("long").cast("string")
    short = F.coalesce(F.col("n_chars"), F.lit(0)) < 600
    parts = [F.col("source"), F.concat(F.lit("part"), block(2000)), F.when(~short, F.concat(F.lit("set"), block(100))), F.when(F.col("doc_id") % 97 == 5, "LICENSE").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))]
    return F.concat_ws("/", *parts)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(docs(spark, sf_dir), document_path())
    return out.fillna({"licence": "none", "declared_in": "", "cosine": 0.0})


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("pii_kinds").cast("long").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"), "text")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(docs(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # For one document in ten, the words from a on become a loop of p words.
    rows = docs(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    loop = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), loop), " ")).otherwise(F.col("text"))
    out = periodic.periodic_runs(rows.select("doc_id", text.alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.withColumn("best", best).withColumn("length", -F.col("best.less")).withColumn("period", F.col("best.period"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.floor(256 * c.cast("double"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", whole.alias("embedding"), label.alias("label")), F.col("vec_id") % 50 == 0)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprint,
        op2_line_dedup,
        op3_simhash,
        op4_langid,
        op5_sharding,
        op6_decontaminate,
        op7_packing,
        op8_license_scan,
        op9_pii,
        op10_ctw,
        op11_periodic_runs,
        op12_hard_negatives,
        op13_substring_dedup,
    )
}
ORACLES = {"op2_line_dedup": line_dedup.SQL, "op8_license_scan": license_scan.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_substring_dedup": substring_dedup.SQL}
