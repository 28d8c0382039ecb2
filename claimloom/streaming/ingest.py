"""The incremental front door: claims that arrive as files are framed, paired and ruled on batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.cascade import adjudicate
from claimloom.operators.frames import frame_claims
from claimloom.operators.pairs import capped_lemma_pairs
from claimloom.operators.store import insert_or_ignore
from claimloom.session import forget, keep
from claimloom.sources.sinks import append, read_or_empty
from claimloom.sources.tables import table

VERDICT = "lemma_key string, claim_a bigint, claim_b bigint, verdict string, rule_id string, divergence double, severity double, explanation string"


def add_claims(batch: DataFrame, witness: DataFrame, out: str) -> None:
    """Frame the claims of a batch that are new and rule on the lemmas they touch.

    Running a batch again, after success or a failure at any step, gives the
    same tables: claims that are stored already and pairs that have a verdict
    are left alone, and the lemmas of the whole batch are ruled on.
    """
    spark = batch.sparkSession
    framed = keep(frame_claims(batch, witness), "batch")
    stored = read_or_empty(spark, out, "framed", framed._jdf.schema().toDDL())
    # A kept table: a cached one would be computed again, and be empty, once its rows are appended below.
    fresh = keep(insert_or_ignore(stored, framed, ["claim_id"], [F.col("claim_id")]), "fresh")
    append(fresh, out, "framed")
    # By the whole batch: an earlier try may have stored its claims and stopped before their verdicts.
    touched = framed.where("lemma_key is not null").select("lemma_key").distinct()
    both = read_or_empty(spark, out, "framed", framed._jdf.schema().toDDL()).join(touched, "lemma_key", "left_semi")
    ruled = adjudicate(capped_lemma_pairs(both))
    append(insert_or_ignore(read_or_empty(spark, out, "verdict", VERDICT), ruled, ["claim_a", "claim_b"], [F.col("rule_id")]), out, "verdict")
    forget(fresh, framed)


def claim_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Claims from Parquet files that appear in ``folder``.

    There is no watermark here: claims may arrive months late and none may be
    dropped, so copies are found against the stored table instead.
    """
    return spark.readStream.schema(schema).parquet(folder)


def start(spark: SparkSession, folder: str, schema: str, tables: str, out: str, progress: str) -> StreamingQuery:
    """Process what has arrived and stop; the next start goes on from ``progress``."""
    witness = table(spark, tables, "witness")
    sink = claim_stream(spark, folder, schema).writeStream.foreachBatch(lambda batch, _: add_claims(batch, witness, out))
    return sink.option("checkpointLocation", progress).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Claims a witness and window of event time, with late ones counted until the watermark passes."""
    timed = stream if stream.isStreaming is False else stream.withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window).alias("w"), "witness_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "witness_id", "n")
