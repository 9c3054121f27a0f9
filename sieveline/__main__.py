"""python -m sieveline scan PATH | batch PATH | archives PATH | package NAME [VERSION] | preprocess BENIGN MALICIOUS OUT | corpus LIST ROOT OUT | train TABLE | triage PATH"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .operators.judge import ChatJudge
from .session import session, written


def _judge(name: str):
    """The callable that module:function names; it takes a list of texts and returns a list of replies."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sieveline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "batch", "archives"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--threshold", type=float, default=0.7)
        s.add_argument("--extensions", nargs="*")
        s.add_argument("--functions", help="JSON dictionary of function names by language")
        s.add_argument("--imports", help="JSON dictionary of module names by language")
        s.add_argument("--save")
        s.add_argument("--quiet", action="store_true", help="print nothing")
        if name == "scan":
            s.add_argument("--move", metavar="FOLDER", help="copy files with findings there")
        s.add_argument("--format", default="demo", choices=["demo", "markdown", "json", "yaml", "tokens", "code"])
    s = sub.add_parser("package", help="scan a package of an index")
    s.add_argument("name"), s.add_argument("version", nargs="?"), s.add_argument("--address", default="https://pypi.org/pypi/{name}/json")
    s.add_argument("--threshold", type=float, default=0.7), s.add_argument("--save"), s.add_argument("--quiet", action="store_true", help="print nothing")
    s = sub.add_parser("preprocess")
    s.add_argument("benign"), s.add_argument("malicious"), s.add_argument("out")
    s.add_argument("--extensions", nargs="*", help="files to take, all that are known by default"), s.add_argument("--by-language", action="store_true", help="a partition for each language")
    s = sub.add_parser("corpus", help="files of the checkouts of a list of pinned repositories as a training set")
    s.add_argument("list"), s.add_argument("root"), s.add_argument("out"), s.add_argument("--extensions", nargs="*"), s.add_argument("--pinned-only", action="store_true"), s.add_argument("--by-language", action="store_true")
    s = sub.add_parser("train")
    s.add_argument("table"), s.add_argument("--ratio", type=float, default=60.0), s.add_argument("--model"), s.add_argument("--metrics", help="file for the metrics")
    s = sub.add_parser("triage")
    s.add_argument("path"), s.add_argument("--strategy", default="concat", choices=["concat", "single", "smart"]), s.add_argument("--save"), s.add_argument("--budget", type=int, help="characters of files in a prompt")
    who = s.add_mutually_exclusive_group(required=True)
    who.add_argument("--judge", metavar="MODULE:FUNCTION"), who.add_argument("--model", help="a model of a chat service")
    s.add_argument("--key", help="for the service; LLM_API_KEY by default"), s.add_argument("--address", help="of the service; LLM_BASE_URL or by the model's name by default"), s.add_argument("--route", metavar="FOLDER", help="write the files there, by decision")
    a = p.parse_args(argv)
    judge = None
    if a.command == "triage":
        judge = _judge(a.judge) if a.judge else ChatJudge(a.model, a.key, a.address)
        if isinstance(judge, ChatJudge) and not judge.key:
            p.error("a key is needed: --key or LLM_API_KEY")
    from .plans import jobs
    from .sources import sinks
    from .sources.files import read_dictionary, read_files

    spark = session(a.command)
    own = {k: read_dictionary(spark, v) for k in ("functions", "imports") if (v := getattr(a, k, None))}
    if a.command == "scan":
        found = jobs.scan_report(spark, a.path, a.extensions, a.threshold, form=a.format, **own)
        if a.move and found.flagged:
            paths = spark.createDataFrame([(o["path"],) for o in found.flagged], "path string")
            sinks.copy_files(spark, paths, "path", a.path, a.move)
        text = found.render(a.format)
        if a.save:
            with open(a.save, "w", encoding="utf-8") as f:
                f.write(text)
        elif not a.quiet:
            print(text)
    elif a.command in ("batch", "archives"):
        found = jobs.batch_verdicts(spark, a.path, extensions=a.extensions, threshold=a.threshold, archives=a.command == "archives", **own)
        if a.save:
            found.write.mode("overwrite").parquet(a.save)
        for row in [] if a.save or a.quiet else found.orderBy("package").toLocalIterator():
            print(row["package"], row["verdict"], row["flagged"], row["objects"], f"{row['confidence']:.2f}", sep="\t")
    elif a.command == "package":
        from .operators import report

        downloads, objects = jobs.scan_packages(spark, a.address, [a.name], a.version, threshold=a.threshold)
        found = report.package_verdict(objects, "package", "score", a.threshold)
        missing = [r for r in downloads.where("status <> 'ok'").toLocalIterator()]
        if a.save:
            found.write.mode("overwrite").parquet(a.save)
        for row in [] if a.save or a.quiet else found.toLocalIterator():
            print(row["package"], row["verdict"], row["flagged"], row["objects"], f"{row['confidence']:.2f}", sep="\t")
        for row in missing:
            print(row["name"], row["status"], row["message"] or "", sep="\t", file=sys.stderr)
        return int(bool(missing))
    elif a.command == "preprocess":
        jobs.preprocess(read_files(spark, a.benign, a.extensions), read_files(spark, a.malicious, a.extensions), a.out, a.by_language)
    elif a.command == "corpus":
        from .sources import corpora

        listed = corpora.read_corpora(spark, a.list)
        files = corpora.corpus_files(spark, listed, a.root, a.extensions, a.pinned_only)
        jobs.preprocess(files.where("label = 0"), files.where("label = 1"), a.out, a.by_language)
        lost = corpora.checkouts(spark, listed, a.root).where("status IN ('missing', 'other_commit')").select("url", "status", "head").orderBy("url")
        for row in lost.toLocalIterator():
            print(row["url"], row["status"], row["head"] or "", sep="\t", file=sys.stderr)
    elif a.command == "triage":
        files = read_files(spark, a.path).where("accepted")
        found = written(jobs.triage_folders(files, judge, a.strategy, budget=a.budget), "verdicts")  # asked once, whatever is read of it
        if a.route:
            sinks.route(files, found, "package", "decision", a.route)
        if a.save:
            found.write.mode("overwrite").parquet(a.save)
        for row in [] if a.save else found.orderBy("package").toLocalIterator():
            print(row["package"], row["decision"], row["reasoning"], sep="\t")
    else:
        model, metrics = jobs.train(spark.read.parquet(a.table), a.ratio)
        if a.model:
            model.write().overwrite().save(a.model)
        values = metrics.first().asDict()
        if a.metrics:
            with open(a.metrics, "w", encoding="utf-8") as f:
                json.dump(values, f, indent=1)
        print("\n".join(f"{k}: {v:.4f}" for k, v in values.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
