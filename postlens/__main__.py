"""Command line, for ``spark-submit`` or ``python -m``.

Master and resources come from spark-submit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from postlens.operators import console_form
from postlens.plans import (
    account_report,
    compact_lake,
    follow_lake,
    labels_report,
    lake_report,
    land_files,
    land_live,
    running_report,
    score_lake,
    tokenize_checked,
    tokenize_lake,
)
from postlens.plans.jobs import COMPACT_BYTES, COMPACT_FILES, MAX_FILES

REPORTS = {
    "account-report": account_report,
    "lake-report": lake_report,
    "labels-report": labels_report,
    "running-report": running_report,
}
STREAMS = {
    "compact": compact_lake,
    "land-live": land_live,
    "tokenize": tokenize_lake,
    "tokenize-checked": tokenize_checked,
    "score": score_lake,
    "follow": follow_lake,
}


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="postlens")
    jobs = parser.add_subparsers(dest="job", required=True)

    report = jobs.add_parser("account-report", help="stored search pages to a share report")
    report.add_argument("pages")
    report.add_argument("lexicon")
    report.add_argument("--edges", default="clean", choices=("clean", "as_reference"))
    report.add_argument("--multi-line", action="store_true", help="one page per file")
    report.add_argument("--rules", help="count only posts of accounts that stored rules name")
    report.add_argument("--gaps", choices=("warn", "fail"), help="follow the chains of pages first")

    land = jobs.add_parser("land", help="text lines to landing files")
    land.add_argument("lines")
    land.add_argument("path")
    land.add_argument("--per-file", type=int, default=10)

    live = jobs.add_parser("land-live", help="text lines to landing files, as a stream")
    live.add_argument("lines")
    live.add_argument("path")
    live.add_argument("checkpoint")
    live.add_argument("--per-file", type=int, default=10)
    live.add_argument("--available-now", action="store_true", help="stop at the end of the input")
    live.add_argument("--max-files", type=int, default=MAX_FILES)

    tokenize = jobs.add_parser("tokenize", help="landed JSON lines to a token table, as a stream")
    tokenize.add_argument("lines")
    tokenize.add_argument("path")
    tokenize.add_argument("checkpoint")
    tokenize.add_argument("--available-now", action="store_true", help="stop at the end of the input")
    tokenize.add_argument("--max-files", type=int, default=MAX_FILES)
    tokenize.add_argument("--row-group-bytes", type=int)
    tokenize.add_argument("--keep-corrupt", action="store_true")

    lake = jobs.add_parser("lake-report", help="a token table to a share report")
    lake.add_argument("tokens")
    lake.add_argument("lexicon")
    lake.add_argument("--edges", default="clean", choices=("clean", "as_reference"))

    labels = jobs.add_parser("labels-report", help="the labels written so far to a share report")
    labels.add_argument("labels")

    running = jobs.add_parser("running-report", help="the report that `follow` published last")
    running.add_argument("report")

    checked = jobs.add_parser("tokenize-checked", help="landed lines to tokens of ruled accounts, as a stream")
    checked.add_argument("lines")
    checked.add_argument("path")
    checked.add_argument("checkpoint")
    checked.add_argument("--rules", help="versions of account rules; each batch reads the latest")
    checked.add_argument("--available-now", action="store_true")
    checked.add_argument("--max-files", type=int, default=MAX_FILES)

    for name, about in (("score", "a token table to labels"), ("follow", "a token table to a running report")):
        score = jobs.add_parser(name, help=f"{about}, as a stream")
        score.add_argument("tokens")
        score.add_argument("lexicon")
        score.add_argument("path")
        score.add_argument("checkpoint")
        score.add_argument("--edges", default="clean", choices=("clean", "as_reference"))
        score.add_argument("--available-now", action="store_true")
        score.add_argument("--max-files", type=int, default=MAX_FILES)
    compact = jobs.add_parser("compact", help="a token table of many small files to one of few")
    compact.add_argument("tokens")
    compact.add_argument("path")
    compact.add_argument("checkpoint")
    compact.add_argument("--files", type=int, default=COMPACT_FILES)
    compact.add_argument("--max-bytes", type=int, default=COMPACT_BYTES)
    for stream in STREAMS.keys() - {"compact"}:
        jobs.choices[stream].add_argument("--max-bytes", type=int, help="in the place of --max-files")
    return parser.parse_args()


def main() -> None:
    options = vars(arguments())
    job = options.pop("job")
    spark = SparkSession.builder.appName(f"postlens {job}").getOrCreate()
    if job in REPORTS:
        console_form(REPORTS[job](spark, **options)).show(truncate=False)
    elif job in STREAMS:
        STREAMS[job](spark, **options).awaitTermination()
    else:
        land_files(spark, **options)


if __name__ == "__main__":
    main()
