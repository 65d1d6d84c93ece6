"""Check text files: ``python -m prosegauge FILE... --dictionary dictionary.json``.

The exit code is 1 if any file breaks a rule, 2 if the arguments are wrong.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prosegauge.operators import report
from prosegauge.plans import check
from prosegauge.sources.lexicon import Lexicon, read_dictionary, read_terms, with_default_terms
from prosegauge.sources.texts import read_texts

WIDTH = 70


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prosegauge", description="Check texts against a controlled vocabulary and writing rules.")
    p.add_argument("files", nargs="*", help="files, folders or patterns; - is the standard input")
    p.add_argument("--dictionary", required=True, help="a dictionary in JSON")
    p.add_argument("--terms", action="append", default=[], help="a list of subject-field terms; may be given again")
    p.add_argument("--no-default-terms", action="store_true", help="admit only the terms of --terms")
    p.add_argument("--mode", choices=check.MODES, default="auto", help="which limit of sentence length holds (auto: decided for each sentence)")
    p.add_argument("--json", action="store_true", help="one JSON object instead of text")
    p.add_argument("--quiet", action="store_true", help="the summary only")
    p.add_argument("--all-advisories", action="store_true", help="a line for each unknown word")
    p.add_argument("--violations-only", action="store_true", help="no advisories")
    p.add_argument("--audit", action="store_true", help="list the terms that are disallowed words, and stop")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, stdin=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    if not args.files and not args.audit:
        parser().error("name a file, or - for the standard input")
    spark = spark or SparkSession.builder.appName("prosegauge").getOrCreate()
    say = lambda text: print(text, file=out)
    try:
        entries = read_dictionary(spark, args.dictionary)
        terms = with_default_terms(read_terms(spark, *args.terms) if args.terms else None, spark, not args.no_default_terms)
        if args.audit:
            rows = report.audit_json(entries, terms) if args.json else report.audit_lines(entries, terms).orderBy("part", "ord").select("said")
            for r in rows.collect():
                say(json.dumps(json.loads(r[0]), indent=1) if args.json else r[0])
            return 0
        lex = Lexicon.build(entries, terms)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    got = check.check_text(read_texts(spark, *args.files, stdin=stdin), lex, args.mode, keep=True)
    try:
        # one document at a time reaches the driver
        if args.json:
            rows = check.as_json(got).orderBy("doc_row").toLocalIterator()
            say(json.dumps({r.doc_id: json.loads(r.json) for r in rows}, indent=1))
        else:
            lines = report.report_lines(got.findings, got.stats, args.quiet, not args.violations_only, args.all_advisories, wrap=WIDTH)
            last = None
            for r in lines.orderBy("doc_row", "part", "ord").toLocalIterator():
                if r.doc_row != last:
                    say(f"\n=== {r.doc_id} ===")
                    last = r.doc_row
                say(r.said)
        return int(not got.stats.where(F.col("violations") > 0).isEmpty())
    finally:
        check.release(got)


if __name__ == "__main__":
    sys.exit(main())
