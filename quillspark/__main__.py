"""Command line: convert (the default), eval, eval-corpus."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.evaluation import corpus_report
from .operators.ocr import MockProvider, TesseractProvider
from .operators.render import report
from .plans.convert import Engine, write_assets
from .plans.options import ConvertOptions
from .sources.pdf import Limits, from_bytes

BREAKS = {"none": "none", "thematic": "rule", "html": "comment", "marker": "bracket"}


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _read(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def _arguments(argv: list[str]) -> argparse.Namespace:
    if not argv or argv[0] not in ("convert", "eval", "eval-corpus", "-h", "--help"):
        argv = ["convert", *argv]
    top = argparse.ArgumentParser(prog="quillspark", description="PDF documents to Markdown")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="a PDF file, or - for standard input, to Markdown")
    c.add_argument("input")
    c.add_argument("-o", "--output", default="-")
    c.add_argument("-d", "--dialect", choices=("commonmark", "gfm", "extended"), default="gfm")
    c.add_argument("--profile", choices=("fast", "balanced", "low_memory"), default="balanced")
    c.add_argument("--extract-images", action="store_true")
    c.add_argument("--extract-vectors", action="store_true")
    c.add_argument("--images-dir", help="folder for pictures and drawings")
    c.add_argument("--no-tables", action="store_true")
    c.add_argument("--paragraph-gap", type=float, default=1.4)
    c.add_argument("--ocr", choices=("auto", "always", "never"), default="auto")
    c.add_argument("--ocr-provider", choices=("auto", "tesseract", "mock"), default="auto")
    c.add_argument("--ocr-lang", default="ara+eng")
    c.add_argument("--ocr-binary")
    c.add_argument("--ocr-dpi", type=int, default=150)
    c.add_argument("--diagnostics-json")
    c.add_argument("--memory-limit", type=int, default=32, help="MB that a stream may inflate to")
    c.add_argument("--max-pages", type=int, default=5000)
    c.add_argument("--page-breaks", choices=sorted(BREAKS), default="html")
    c.add_argument("--no-frontmatter", action="store_true")
    e = sub.add_parser("eval", help="a PDF file against a Markdown file")
    e.add_argument("pdf")
    e.add_argument("--ground-truth", required=True)
    e.add_argument("--max-cer", type=float, default=0.05)
    e.add_argument("--max-wer", type=float, default=0.10)
    m = sub.add_parser("eval-corpus", help="the PDF files of a folder against the .md.gold files beside them")
    m.add_argument("--fixtures-dir", required=True)
    m.add_argument("--max-cer", type=float, default=0.05)
    return top.parse_args(argv)


def options(a: argparse.Namespace) -> ConvertOptions:
    provider = MockProvider() if a.ocr_provider == "mock" else TesseractProvider(a.ocr_binary, a.ocr_lang)
    return ConvertOptions(profile=a.profile, dialect=a.dialect, front_matter=not a.no_frontmatter, page_breaks=BREAKS[a.page_breaks], extract_images=a.extract_images, extract_vectors=a.extract_vectors,
                          assets=a.images_dir or "assets", detect_tables=not a.no_tables, paragraph_gap=a.paragraph_gap, recognition=a.ocr, provider=provider, recognition_dpi=a.ocr_dpi, limits=Limits(stream_bytes=a.memory_limit << 20, pages=a.max_pages))


def main(argv: list[str] | None = None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = _session()
    if a.command == "convert":
        engine = Engine(spark, options(a))
        data = _read(a.input)
        done = engine.convert_bytes(data)
        if done["error"]:
            print(done["error"], file=sys.stderr)
            return 1
        if a.output == "-":
            sys.stdout.write(done["markdown"])
        else:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(done["markdown"])
        if a.diagnostics_json:
            with open(a.diagnostics_json, "w", encoding="utf-8") as f:
                json.dump({"diagnostics": done["diagnostics"], "pages": done["pages"]}, f, indent=2)
        if a.images_dir and (a.extract_images or a.extract_vectors):
            write_assets(engine.assets(from_bytes(spark, data)), a.images_dir)
        return 0
    engine = Engine(spark)
    if a.command == "eval":
        done = engine.convert_bytes(_read(a.pdf))
        pair = spark.createDataFrame([(a.pdf, _read(a.ground_truth).decode("utf-8", "replace"), done["markdown"] or "")], "filename string, reference string, hypothesis string")
        scored = engine.evaluate(pair, a.max_cer)
    else:
        scored = engine.evaluate_corpus(a.fixtures_dir, a.max_cer)
    scored = scored.cache()
    print(report(scored).first().markdown)
    return 0 if corpus_report(scored).first().all_passed else 1


if __name__ == "__main__":
    sys.exit(main())
