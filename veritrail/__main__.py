"""python -m veritrail check TARGET REFERENCES OUT [--excel FILE] [--classify] [--llm-judge] [--llm-extract]
python -m veritrail regenerate OUT [--excel FILE]
python -m veritrail evaluate ANNOTATIONS.jsonl OUT [--test-set NAME]"""

from __future__ import annotations

import argparse

from .operators import model
from .plans import pipeline
from .session import local_session, ship


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veritrail", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parts = parser.add_subparsers(dest="part", required=True)
    check = parts.add_parser("check")
    for name in ("target", "references", "out"):
        check.add_argument(name)
    for flag in ("--classify", "--llm-judge", "--llm-extract", "--conflicts", "--no-retrieval"):
        check.add_argument(flag, action="store_true")
    check.add_argument("--words", help="YAML file of category words")
    again = parts.add_parser("regenerate")
    again.add_argument("out")
    for p in (check, again):
        p.add_argument("--excel", help="workbook to write")
    judged = parts.add_parser("evaluate")
    judged.add_argument("annotations")
    judged.add_argument("out")
    judged.add_argument("--test-set")
    a = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    if a.part == "check":
        settings = model.Settings.of()
        client = lambda wanted, instruction, most=None: model.chat_client(settings, instruction, most) if wanted else None
        options = pipeline.Options(retrieve=not a.no_retrieval, conflicts=a.conflicts, words=a.words)
        clients = {"extractor": client(a.llm_extract, model.EXTRACT), "judge": client(a.llm_judge, model.BATCH, 960), "classifier": client(a.classify or a.llm_judge, model.CLASSIFY, 600)}
        print(pipeline.check_folder(spark, a.target, a.references, a.out, options, a.excel, **clients))
    elif a.part == "regenerate":
        print(pipeline.regenerate(spark, a.out, workbook=a.excel))
    else:
        result = pipeline.evaluate_run(spark, a.annotations, a.out, test_set=a.test_set)
        for name in ("recall", "by_type", "confusion", "unmatched"):
            result[name].show(100, False)


if __name__ == "__main__":
    main()
