"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from urlshift.operators.replace import Step, apply_plan  # noqa: E402
from urlshift.session import local_session  # noqa: E402
from urlshift.sources.dump import read_sql_dump  # noqa: E402
from urlshift.sources.listings import source_sizes  # noqa: E402
from urlshift.workloads import QUERIES  # noqa: E402
from urlshift.workloads.sourcing import DOCUMENT_SCHEMAS, write_documents_dump  # noqa: E402
from urlshift.workloads.tables import page_sites  # noqa: E402

HEADLINES = (
    "replace_single",
    "replace_www",
    "replace_network",
    "replace_json",
    "replace_by_site",
    "replace_serialized",
    "dry_run_report",
    "rewrite_report",
    "read_dump",
    "revision_delete_meta",
    "revision_delete_posts",
    "revision_report",
    "delete_batches",
    "mapping_summary",
    "update_blogs",
    "proxy_settings",
    "sanitize_strict",
    "migrate_network",
)
PLAN_SIZES = (1, 16, 64, 256)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build, repeats: int = 2) -> float:
    """Best of a few runs, planning included."""
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        run(build())
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def plan_of(hosts: list[str], size: int) -> list[Step]:
    """Steps for the hosts of the pages, then for hosts that occur nowhere."""
    names = [*hosts, *(f"absent{i}.example.com" for i in range(size))][:size]
    return [Step(i + 1, i + 1, 1, f"//{name}", f"//site{i}.example.test") for i, name in enumerate(names)]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    times = {name: timed(lambda name=name: QUERIES[name](spark, sf)) for name in HEADLINES}

    # A dump of all documents, written once; only reading it is timed.
    dump = write_documents_dump(spark, sf)
    size = source_sizes(spark, dump).agg(F.sum("bytes")).first()[0]
    times["dump_import"] = timed(lambda: read_sql_dump(spark, dump, DOCUMENT_SCHEMAS)["posts"], repeats=3)
    dump_rate = round(size / 1e6 / times["dump_import"], 1)

    # Whole texts of the documents, each between two links of a page.
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    n_pages = pages.count()
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumn("page_id", F.col("doc_id") % n_pages)
    texts = documents.join(pages, "page_id").select("doc_id", F.concat_ws(" ", "url", "text", "url").alias("text"))
    texts = texts.repartition(spark.sparkContext.defaultParallelism * 2).persist()
    rows = texts.count()
    hosts = [r.host for r in page_sites(spark, sf).select("host").distinct().orderBy("host").collect()]
    rates = {}
    for size in PLAN_SIZES:
        steps = plan_of(hosts, size)
        times[f"replace_{size}_patterns"] = timed(lambda steps=steps: apply_plan(texts, steps, ["text"]))
        rates[f"replace_{size}_patterns"] = round(rows / times[f"replace_{size}_patterns"])

    def one_by_one(steps):
        df = texts
        for step in steps:
            run(apply_plan(df, [step], ["text"]))
        return df

    steps = plan_of(hosts, 16)
    times["replace_16_scans"] = timed(lambda: one_by_one(steps))
    texts.unpersist()

    print(
        json.dumps(
            {
                "metric": "total of the headline queries",
                "value": round(sum(times[name] for name in HEADLINES), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "dump_mb_per_sec": dump_rate,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
