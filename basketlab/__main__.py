"""Command line: the reference's three scripts as Spark jobs.

  python -m basketlab tables    --input DIR --out OUT   wrangle + features, write the 10 tables
  python -m basketlab recommend --input DIR --out OUT   fit the blend, write recommendations, print mean F1
  python -m basketlab validate  --input DIR             mean F1 on a user-level validation split

``--input`` is a directory of the star-schema test tables, or with
``--lines`` an invoice-line file in the library's schema or with the original
file's column names, in any format Spark reads (``--format csv``); a file
without ``line_no`` names the columns that order the lines of an invoice
(``--line-order StockCode``). Lines that do not conform are left out and
counted; ``--rejects DIR`` keeps them. ``tables --publish`` switches OUT to the new
set of tables at once.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from basketlab.operators import evaluate as E
from basketlab.plans import models
from basketlab.plans.pipeline import RetailPipeline
from basketlab.session import build_session, materialize
from basketlab.sources.raw import load_lines, split_lines
from basketlab.sources.sinks import publish_tables, write_recommendations, write_tables


def _pipeline(spark, args) -> RetailPipeline:
    if args.lines:
        order = [c for c in (args.line_order or "").split(",") if c]
        lines, rejects = split_lines(load_lines(spark, args.input, args.format), order or None)
        if args.rejects:
            rejects.write.mode("overwrite").parquet(args.rejects)
        print(f"lines left out: {rejects.count()}")
        codes = None if args.codes is None else [c for c in args.codes.split(",") if c]
        return RetailPipeline(materialize(lines, "invoice_lines"), mode=args.mode, codes=codes)
    return RetailPipeline.from_dir(spark, args.input, mode=args.mode)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="basketlab")
    ap.add_argument("command", choices=["tables", "recommend", "validate"])
    ap.add_argument("--input", required=True)
    ap.add_argument("--out")
    ap.add_argument("--lines", action="store_true", help="input is an invoice-line file")
    ap.add_argument("--format", default="parquet", help="format of an invoice-line file")
    ap.add_argument("--line-order", help="columns that order the lines of an invoice, comma-separated")
    ap.add_argument("--rejects", help="folder for lines that do not conform")
    ap.add_argument("--codes", help="codes that are no products, comma-separated (default: the original file's)")
    ap.add_argument("--publish", action="store_true", help="switch OUT to the new tables at once")
    ap.add_argument("--mode", default="reference", choices=["reference", "net_total", "fifo"])
    ap.add_argument("--master")
    ap.add_argument("--rounds", type=int, help="boosting rounds (default: the reference's 100)")
    ap.add_argument("--threshold", type=float, default=0.09)
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    p = _pipeline(spark, args)
    settings = models.ModelSettings()
    if args.rounds:
        settings = settings.with_rounds(args.rounds)
    if args.command == "tables":
        (publish_tables if args.publish else write_tables)(
            p.tables(), args.out, partition_by={"order_products": ["eval_set"]})
    elif args.command == "recommend":
        truth = p.truth("test")
        scored = models.score(models.fit_models(p.train_frame, settings), p.test_frame)
        per_order, kept = E.recommend(models.predictions_for_cut(scored), truth, args.threshold)
        report = E.recommendation_report(per_order, kept, truth)
        write_recommendations(report, args.out)
        print(f"test score is {E.mean_f1(per_order).first()['mean_f1']}")
    else:
        f1 = models.validation_f1(p.train_frame, p.order_products, settings, args.threshold).first()
        print(f"validation score is {f1['mean_f1']}")


if __name__ == "__main__":
    main()
