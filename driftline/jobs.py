"""Command lines for the batch jobs: ``python -m driftline.jobs unzip|ingest|voyages|split|embeddings|cluster ...``."""

from __future__ import annotations

import argparse
import datetime
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftline.operators import clustering, counters, encoding, features, ingest
from driftline.session import session
from driftline.sources import ais, landing
from driftline.sources import vectors as archives

log = logging.getLogger("driftline")


def run_unzip(a: argparse.Namespace) -> None:
    """Daily zip archives to Parquet by day, and a table of those that can't be read and of days without one."""
    spark = session("unzip")
    first, last = (datetime.date.fromisoformat(d) if d else None for d in (a.first, a.last))
    wrong = landing.problems(spark, a.source, first, last)
    wrong.write.mode("overwrite").parquet(f"{a.target}/problems")
    bad = spark.read.parquet(f"{a.target}/problems")
    log.info("%s archives or days can't be used", bad.count())
    _write_messages(ais.coded(landing.read_zipped(spark, a.source)), a.target)


def run_ingest(a: argparse.Namespace) -> None:
    """Daily CSV files to Parquet by day, and the vessels' types by day and combined; counts are observed in the same pass."""
    _write_messages(ais.coded(ais.read_csv(session("ingest"), a.source)), a.target)


def _write_messages(rows: DataFrame, target: str) -> None:
    spark = rows.sparkSession
    seen = Observation("ingest")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("ts_s").isNull(), 1)).alias("without_time"))
    ais.write_daily(ingest.in_range(rows, own_day=True), f"{target}/messages")
    log.info("read %(raw)s rows, %(without_time)s without a time", seen.get)
    ais.write_daily(ingest.vessel_type_daily(spark.read.parquet(f"{target}/messages")), f"{target}/vessel_types_daily")
    ingest.vessel_type_combined(spark.read.parquet(f"{target}/vessel_types_daily")).write.mode("overwrite").parquet(f"{target}/vessel_types")


def run_voyages(a: argparse.Namespace) -> None:
    """Messages to normalised voyage steps, and a table of what each stage kept, counted in the same run."""
    spark = session("voyages")
    run = counters.Observed(spark.read.parquet(f"{a.source}/messages"))
    ais.write_voyages(run.steps, a.target)
    run.table(spark).write.mode("overwrite").parquet(a.counters or f"{a.target.rstrip('/')}_counters")
    for name, value in run.counters().items():
        log.info("%s: %s", name, value)


def run_split(a: argparse.Namespace) -> None:
    """Voyage steps with a split for each vessel as a whole."""
    steps = session("split").read.parquet(a.source)
    parts = features.split_vessels(steps.select("mmsi", "k").distinct(), a.val, a.test, a.seed).select("mmsi", "split")
    ais.write_voyages(steps.join(parts, "mmsi"), a.target)


def run_embeddings(a: argparse.Namespace) -> None:
    """Voyage steps and an encoder's weights to vectors."""
    spark = session("embeddings")
    items = features.sample_items(spark.read.parquet(a.source).withColumnsRenamed({"k": "voyage", "t": "ts_s", "step": "seq"}))
    tokens = features.token_sequences(items, encoding.Config().positions)
    vectors = encoding.embeddings(tokens, encoding.Transformer.load(spark, a.weights), a.batch_size)
    vectors.withColumn("vec_id", F.concat_ws("_", "mmsi", "time_start")).write.mode("overwrite").parquet(a.target)
    if a.archives:
        archives.write_npz(spark.read.parquet(a.target).withColumnRenamed("time_start", "start_time"), a.archives, "overwrite")


def _vectors(spark: SparkSession, source: str) -> DataFrame:
    """Vectors with vec_id: Parquet, or a published ``.npz`` archive, whose vectors are known by file and row."""
    if not source.endswith(".npz"):
        return spark.read.parquet(source)
    rows = archives.read_npz(spark, source)
    for bad in rows.filter("error is not null").collect():  # one archive
        raise ValueError(f"{bad['file_name']}: {bad['error']}")
    return rows.withColumn("vec_id", F.concat_ws("_", "file_name", "row"))


def run_cluster(a: argparse.Namespace) -> None:
    """Vectors to a saved model, a label for each vector and the last merges for a dendrogram; every option is passed on."""
    spark = session("cluster")
    vectors = _vectors(spark, a.source)
    model = clustering.Cure(a.sample_size, a.linkage, a.representatives, a.compression, a.threshold, a.seed, a.pruning_fraction, a.pruning_min_size).fit(vectors)
    model.save(spark, f"{a.target}/model")
    model.model.dendrogram_frame(spark, a.dendrogram_p).write.mode("overwrite").parquet(f"{a.target}/dendrogram")
    labels = model.predict(vectors, a.clusters)
    labels.write.mode("overwrite").parquet(f"{a.target}/labels")
    for row in model.evaluate(vectors).collect():
        log.info("%s clusters: Davies-Bouldin index %s, noise %s %%", *row)


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    top = argparse.ArgumentParser(prog="driftline")
    jobs = top.add_subparsers(required=True)
    for name, run in (("unzip", run_unzip), ("ingest", run_ingest), ("voyages", run_voyages), ("split", run_split), ("embeddings", run_embeddings), ("cluster", run_cluster)):
        p = jobs.add_parser(name, help=run.__doc__)
        p.add_argument("source")
        p.add_argument("target")
        p.set_defaults(run=run)
        if name == "unzip":
            p.add_argument("--first", help="the first day that should be there")
            p.add_argument("--last")
        if name == "voyages":
            p.add_argument("--counters", help="where the table of counters goes; by default beside the target, with _counters behind its name")
        if name == "embeddings":
            p.add_argument("--weights", required=True)
            p.add_argument("--batch-size", type=int, default=512)
            p.add_argument("--archives", help="a folder that also gets the vectors as npz archives")
        if name == "split":
            p.add_argument("--val", type=float, default=0.1)
            p.add_argument("--test", type=float, default=0.1)
            p.add_argument("--seed", type=int, default=42)
        if name == "cluster":
            p.add_argument("--clusters", type=int, default=5)
            p.add_argument("--sample-size", type=int, default=1000)
            p.add_argument("--linkage", choices=clustering.LINKAGES, default="average")
            p.add_argument("--representatives", type=int, default=20)
            p.add_argument("--compression", type=float, default=0.2)
            p.add_argument("--threshold", type=float)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--pruning-fraction", type=float, default=0.05)
            p.add_argument("--pruning-min-size", type=int, default=1)
            p.add_argument("--dendrogram-p", type=int, default=100, help="how many of the last merges the dendrogram shows")
    args = top.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
