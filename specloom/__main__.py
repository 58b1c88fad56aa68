"""python -m specloom validate|run [--root DIR]"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.config import Settings
from specloom.operators.validate import problems
from specloom.plans import collect
from specloom.sources import archive, pdf, tables, web


log = logging.getLogger("specloom")


def _found(found: DataFrame) -> list[str]:
    return [f"{r.rule}: {r.subject}: {r.problem}" for r in found.orderBy("rule", "subject", "problem").toLocalIterator()]


def validate(spark: SparkSession, root: str) -> int:
    """Print the catalog's problems, those of its archived files too; 1 if there are any."""
    files = archive.stored(spark, f"{root}/archive", digests=True).unionByName(archive.listing(spark, root, digests=True))
    images = bool(files.where(F.endswith("path", F.lit(".jpg"))).take(1))
    found = _found(problems(tables.load(spark, root), files, images))
    for line in found or ["no problems"]:
        print(line)
    return int(bool(found))


def one_pass(spark: SparkSession, settings: Settings) -> str:
    """Ask the sources, archive and read new files, recheck, publish, locate, save. Returns the run's message.

    A catalog without suppliers, and tables that break a rule after the pass, are errors; such tables aren't saved.
    """
    t = tables.load(spark, settings.root)
    if not t["suppliers"].take(1):
        raise RuntimeError(f"no suppliers under {settings.root}")
    at = F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
    first = web.web_fetch(collect.source_requests(t["suppliers"]), settings).persist()
    found = collect.found_files(t["suppliers"], first).persist()
    rest = web.web_fetch(collect.file_requests(found, t["suppliers"], t["documents"]), settings).persist()
    responses = first.unionByName(rest)
    got = responses.where(archive.is_pdf(F.col("body"))).select(F.sha2("body", 256).alias("document"), F.col("body").alias("content"))
    named = lambda df: df.withColumnRenamed("document", "sha256")
    out = collect.run(t, found, responses, named(pdf.page_texts(got)), named(pdf.layout_pages(got)), at, settings.check_interval_hours, named(pdf.positioned_lines(pdf.markup_pages(got))))
    archive.store(out.files.where("outcome IN ('new', 'revised')").select(F.col("body").alias("content"), "filename"), f"{settings.root}/archive")
    wrong = _found(problems(t | out.tables))
    if wrong:
        raise RuntimeError("not saved, as the pass breaks rules: " + "; ".join(wrong[:50]))
    tables.save(out.tables, settings.root)
    for r in out.results.where("NOT ok").toLocalIterator():
        log.warning("%s: %s", r.url, r.error)
    return collect.message(out.tables["status"]).first().message


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="specloom")
    p.add_argument("command", choices=("run", "validate"))
    p.add_argument("--root", default=None)
    p.add_argument("--once", action="store_true")
    a = p.parse_args(args)
    settings = Settings.load()
    if a.root:
        settings = Settings(**{**settings.__dict__, "root": a.root})
    spark = SparkSession.builder.appName("specloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "validate":
        return validate(spark, settings.root)
    while True:
        began = time.monotonic()
        try:
            print(one_pass(spark, settings))
        except Exception:  # the next pass may do better: a loop goes on
            log.exception("the pass failed")
            if a.once:
                return 1
        if a.once:
            return 0
        time.sleep(max(60.0, settings.check_interval_hours * 3600 - (time.monotonic() - began)))


if __name__ == "__main__":
    sys.exit(main())
