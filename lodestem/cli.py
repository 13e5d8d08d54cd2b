"""Command line: ``python -m lodestem.cli build|corpus|inspect|verify|bench|info|schema``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from .errors import BadConfig, EngineError
from .functions.text import PreprocessingConfig, preprocess
from .harness import format_report, run_benchmarks
from .operators.model import fit
from .operators.vocabulary import Cut, VocabularyConfig
from .sources.corpora import load_dataset, write_corpus
from .sources.store import canonical_json, describe_schema, environment, load_model, save_model

log = logging.getLogger("lodestem")
CONFIG_KEYS = {"preprocessing": set(PreprocessingConfig.__dataclass_fields__), "vocabulary": set(VocabularyConfig.__dataclass_fields__)}


def load_config(text: str | None) -> tuple[PreprocessingConfig, VocabularyConfig]:
    """From JSON; unknown keys are errors."""
    raw = json.loads(text) if text else {}
    for section, value in raw.items():
        if section not in CONFIG_KEYS:
            raise BadConfig(f"unknown section {section!r}")
        if extra := set(value) - CONFIG_KEYS[section]:
            raise BadConfig(f"unknown keys in {section}: {sorted(extra)}")
    pre, voc = dict(raw.get("preprocessing", {})), dict(raw.get("vocabulary", {}))
    if "stopwords" in pre:
        pre["stopwords"] = tuple(pre["stopwords"])
    if "cut" in voc:
        voc["cut"] = Cut[voc["cut"].upper()]
    return PreprocessingConfig(**pre), VocabularyConfig(**voc)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestem")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="fit a model on a dataset and save it")
    b.add_argument("dataset")
    b.add_argument("out")
    b.add_argument("--config")
    for name in ("inspect", "verify"):
        sub.add_parser(name).add_argument("model")
    c = sub.add_parser("corpus", help="write a dataset as JSON lines with its manifest")
    c.add_argument("dataset")
    c.add_argument("out")
    sub.add_parser("bench", help="time fitting, scoring and ranking on the synthetic corpus")
    sub.add_parser("info")
    sub.add_parser("schema")
    a = p.parse_args(argv)
    if a.command == "schema":
        print(describe_schema())
        return 0
    if a.command == "info":
        print(canonical_json(environment()))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "build":
            text = open(a.config, encoding="utf-8").read() if a.config else None
            pre, voc = load_config(text)
            data = load_dataset(spark, a.dataset)
            m = save_model(fit(preprocess(data.documents, pre), voc), a.out)
            print(canonical_json(m.to_dict()))
        elif a.command == "corpus":
            print(canonical_json(write_corpus(load_dataset(spark, a.dataset), a.out, {"dataset": a.dataset})))
        elif a.command == "bench":
            print(format_report(run_benchmarks(spark)))
        else:
            model = load_model(spark, a.model, verify=a.command == "verify")
            print(canonical_json({"documents": model.n_documents, "tokens": model.vocab.count(), "weights": model.weights.count()}))
    except EngineError as e:
        log.error("%s: %s", type(e).__name__, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
