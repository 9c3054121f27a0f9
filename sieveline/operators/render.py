"""Reports as text: of one package on the driver, or of any number, each where its rows are."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .objects import display_code

_MARKS = {"malicious": "\U0001f479", "suspicious": "⚠️", "good": "\U0001f7e2"}


@dataclass
class Report:
    """What a scan of a package found. objects: dicts with path, name, score, code, tokens, hash, embedding_count, language, activities, source.

    processed: how many objects there were, if `objects` are the flagged ones alone; such a report has no form that shows all sources."""

    input: str
    threshold: float
    files: list[str]
    skipped: list[str]
    objects: list[dict]
    start: str = ""
    duration: float = 0.0
    version: str = "1"
    malicious: bool | None = None
    confidence: float | None = None
    activities: list[str] = field(default_factory=list)
    processed: int | None = None

    def __post_init__(self):
        own = self.flagged
        if self.malicious is None:
            self.malicious = bool(own)
        if self.confidence is None:
            self.confidence = sum(o["score"] for o in own) / len(own) if own else 1.0
        if not self.activities:
            self.activities = sorted({a for o in own for a in o.get("activities") or []})

    @property
    def flagged(self) -> list[dict]:
        return [o for o in self.objects if o["score"] is not None and o["score"] > self.threshold]

    @property
    def result(self) -> str:
        return "malicious" if self.malicious else "suspicious" if self.flagged else "good"

    def data(self) -> dict:
        details = [{"path": o["path"], "contents": [{k: o.get(k) for k in ("name", "score", "code", "tokens", "hash", "embedding_count")}]} for o in self.flagged]
        stats = {
            "total_files": len(self.files), "skipped_files": len(self.skipped), "processed_files": len(self.files) - len(self.skipped), "processed_objects": len(self.objects) if self.processed is None else self.processed,
            "malicious_objects": len(self.flagged), "start": self.start, "duration": self.duration, "file_types": _types(self.files),
        }
        return {"version": self.version, "input": self.input, "result": self.result, "statistics": stats, "details": details}

    def render(self, form: str = "demo") -> str:
        return {"demo": self.demo, "markdown": self.markdown, "json": self.json, "yaml": self.yaml, "tokens": lambda: self.code(True), "code": self.code}[form]()

    def json(self) -> str:
        return json.dumps(self.data(), indent=4)

    def yaml(self) -> str:
        import yaml

        class Dumper(yaml.SafeDumper):
            pass

        Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
        return yaml.dump(self.data(), Dumper=Dumper, sort_keys=False, width=float("inf"), default_flow_style=False)

    def demo(self) -> str:
        """A tree of what was scanned and found."""
        skipped = set(self.skipped)
        kinds = lambda files: f" ({', '.join('.' + t for t in _types(files))})" if _types(files) else ""
        scanned = [f for f in self.files if f not in skipped]
        lines = [f"- target: {self.input}", f"- seconds: {self.duration:.2f}", f"- files: {len(self.files)}", f"  ├── scanned: {len(scanned)}{kinds(scanned)}"]
        if self.result == "good":
            lines.append(f"  └── skipped: {len(skipped)}{kinds(self.skipped)}")
        else:
            lines += [f"  ├── skipped: {len(skipped)}{kinds(self.skipped)}", "  └── suspicious:"]
            by_file: dict[str, list[dict]] = {}
            for o in self.flagged:
                by_file.setdefault(o["path"], []).append(o)
            tree = [(path, [(o["name"], [(a.lower().replace("_", " "), []) for a in (sorted(o.get("activities") or []) if self.malicious else [])]) for o in own]) for path, own in sorted(by_file.items())]
            lines += _branches(tree, "      ")
        end = f"=> {_MARKS[self.result]} {self.result}" + (f" {self.confidence:.2f}" if self.result != "good" else "")
        return "\n".join([*lines, "", end, ""])

    def markdown(self) -> str:
        s = self.data()["statistics"]
        out = [
            "# Scan Report", "", f"*Version {self.version}*", "", f"**Target:** `{self.input}`", "", "## Summary", "", "Based on the analyzed patterns, the code is evaluated as:", "",
            f"> {_MARKS[self.result]} **{self.result.capitalize()}**: `{self.confidence}`", "", f"- Files: {s['total_files']}", f"- Skipped: {s['skipped_files']}",
            f"- Processed Objects: {s['processed_objects']}", f"- Malicious Objects: {s['malicious_objects']}", "", "## Token Statistics", "", *(f"- {a.lower().replace('_', ' ')}" for a in self.activities), "",
        ]
        for o in self.flagged:
            out += [f"## {o['path']}", "", f"- Object: `{o['name'] or '<object>'}`", f"- Maliciousness: {_MARKS['malicious']} `{round(o['score'], 2)}`", "", "### Code", "", f"```\n{o['code']}\n```", "", "### Tokens", "", f"```\n{o['tokens']}\n```", "", ""]
        return "\n".join(out)

    def code(self, with_tokens: bool = False) -> str:
        """Sources of all objects by file type, under comments; files without a suffix are left out."""
        if self.processed is not None:
            raise ValueError("the report was made without the sources of all objects")
        by_type: dict[str, list[dict]] = {}
        for o in self.objects:
            by_type.setdefault(_suffix(o["path"]), []).append(o)
        out = []
        for kind in sorted(k for k in by_type if k):
            mark, wide = fixed.COMMENTS.get(kind, "#"), "=" * 70
            out += ["=" * 80, f"# Files with extension: .{kind}", "=" * 80, ""]
            for o in by_type[kind]:
                if not (o.get("source") or "").strip():
                    continue
                score = "not analyzed" if o["score"] is None else f"{o['score']:.3f}"
                n = o.get("embedding_count") or 0
                out += [f"{mark} {wide}", f"{mark} File: {o['path']}", f"{mark} Object: {o['name']}", f"{mark} Maliciousness: {score}", f"{mark} Embedding count: {n} tokens"]
                if n > fixed.WINDOW:
                    out.append(f"{mark} ⚠️  scored in windows (>{fixed.WINDOW} tokens)")
                out += [f"{mark} {wide}", "", o["source"], ""]
                if with_tokens:
                    out += [f"{mark} TOKENS", *(f"{mark} {line}" for line in _wrapped(o["tokens"].split(" "))), ""]
                out.append("")
        return "\n".join(out)


def render_packages(files: DataFrame, objects: DataFrame, threshold: float = fixed.THRESHOLD, form: str = "json", target: str = "") -> DataFrame:
    """package, result and text of the report of each package of files (package, path, accepted) and objects (package, file_path, name,
    score, source_code, instructions, token_string, hash, embedding_count, language, activities, start).

    The rows of both, sorted by package within the partitions, go by once: a task holds one package, and of that only what the report
    shows (of objects that aren't flagged no code, unless the form shows sources). Nothing is gathered into one row."""
    code = display_code(F.col("source_code"), F.col("instructions"))
    shown = F.lit(True) if form in ("code", "tokens") else F.coalesce(F.col("score") > threshold, F.lit(False))
    only = lambda c, name: F.when(shown, c).alias(name)
    fields = "path string, name string, score double, code string, tokens string, hash string, embedding_count long, language string, activities array<string>, source string, start int"
    of = objects.select(
        "package", F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("accepted"), F.col("file_path").alias("path"), "name", F.col("score").cast("double").alias("score"), only(code, "code"), only(F.col("token_string"), "tokens"), only(F.col("hash"), "hash"),
        F.col("embedding_count").cast("long").alias("embedding_count"), "language", only(F.col("activities"), "activities"), only(F.col("source_code"), "source"), F.col("start").cast("int").alias("start"),
    )
    names = [f.split()[0] for f in fields.split(", ")]
    none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")[1:]]
    rows = files.select("package", F.lit(0).alias("kind"), "accepted", "path", *none).unionByName(of).repartition("package").sortWithinPartitions("package", "kind", "path", "start", "name")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, listed, skipped, items = None, [], [], []

        def done() -> pa.RecordBatch:
            r = Report(f"{target.rstrip('/')}/{now}" if target else str(now), threshold, listed, skipped, items)
            return pa.record_batch([pa.array([now], pa.string()), pa.array([r.result]), pa.array([r.render(form)])], names=["package", "result", "text"])

        begun = False
        for b in batches:
            for row in b.to_pylist():
                package, kind, accepted = row.pop("package"), row.pop("kind"), row.pop("accepted")
                if not begun or package != now:
                    if begun:
                        yield done()
                    begun, now, listed, skipped, items = True, package, [], [], []
                if kind:
                    items.append({k: row[k] for k in names})
                else:
                    listed.append(row["path"])
                    skipped += [] if accepted else [row["path"]]
        if begun:
            yield done()

    return rows.mapInArrow(run, "package string, result string, text string")


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""


def _types(paths: list[str]) -> list[str]:
    return sorted({s for p in paths if (s := _suffix(p))})


def _branches(items: list[tuple[str, list]], indent: str) -> list[str]:
    out = []
    for i, (name, below) in enumerate(items):
        last = i == len(items) - 1
        out.append(f"{indent}{'└' if last else '├'}── {name}")
        out += _branches(below, indent + ("    " if last else "│   "))
    return out


def _wrapped(tokens: list[str], width: int = 100) -> list[str]:
    lines, line = [], ""
    for t in tokens:
        if line and len(line) + len(t) + 3 > width:
            lines.append(line + " |")
            line = t
        else:
            line = f"{line} | {t}" if line else t
    return [*lines, line] if line else lines
