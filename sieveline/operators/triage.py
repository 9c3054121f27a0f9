"""Triage: texts gathered by folder, verdicts and their roll-up."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Severity of the verdicts.
SEVERITY = {"benign": 0, "suspicious": 1, "malicious": 2}
#: The first words found in a model's name give the base address of its service; the default stands for all others.
ROUTES = [
    (["mistral"], "https://api.mistral.ai/v1"),
    (["openai", "gpt"], "https://api.openai.com/v1"),
    (["claude", "anthropic"], "https://api.anthropic.com/v1"),
    (["llama", "meta"], "https://api.together.xyz/v1"),
    (["gemini", "google"], "https://generativelanguage.googleapis.com/v1"),
]
DEFAULT_ROUTE = "https://api.mistral.ai/v1"


def clean(text: Column) -> Column:
    """Without control characters, line breaks included."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def concat_by_group(files: DataFrame, group: str, path: str, text: str) -> DataFrame:
    """group, text: each file under a heading, in order of the paths. A group is a folder, which its consumer reads as one text."""
    part = F.concat(F.lit("\n### FILE: "), F.col(group), F.lit("/"), F.col(path), F.lit("\n"), clean(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"))
    return files.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), part.alias("t")))).alias("__p")).select(group, F.array_join(F.transform("__p", lambda s: s["t"]), "").alias("text"))


def prompt_parts(files: DataFrame, group: str, path: str, text: str, budget: int) -> DataFrame:
    """group, part, text: each group's cleaned files in order of the paths, under headings, in parts of at most `budget` characters of
    files. A file that doesn't fit goes on in the next part under a heading of its own, so a folder of any size has no large row.

    Only paths and lengths are put in order for a group; texts are cut where they are and meet part by part."""
    cleaned = clean(F.coalesce(F.col(text), F.lit("")))
    sizes = files.select(F.col(group).alias("g"), F.col(path).alias("p"), F.length(cleaned).cast("long").alias("n"), F.xxhash64(text).alias("h"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("p", "h", "n").rowsBetween(Window.unboundedPreceding, -1))
    # rows that are repeated stand one behind the other: their texts are the same, so it doesn't matter which is which
    number = F.row_number().over(Window.partitionBy("g", "p", "h").orderBy("n"))
    placed = sizes.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).withColumn("i", number)
    own = files.select(F.col(group).alias("g"), F.col(path).alias("p"), cleaned.alias("t"), F.xxhash64(text).alias("h"))
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("g", "p", "h").orderBy(F.length("t"))))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("g", "p", "h", "i")]
    rows = own.alias("a").join(placed.alias("b"), same).select("a.g", "a.p", "a.t", "b.before", "b.n", "b.i")
    first, last = F.floor(F.col("before") / budget), F.floor((F.col("before") + F.greatest(F.col("n") - 1, F.lit(0))) / budget)
    pieces = rows.select("*", F.explode(F.sequence(first, last)).alias("part"))
    begin = F.greatest(F.col("part") * budget, F.col("before"))
    end = F.least((F.col("part") + 1) * budget, F.col("before") + F.col("n"))
    piece = F.substring(F.col("t"), (begin - F.col("before") + 1).cast("int"), (end - begin).cast("int"))
    head = F.concat(F.lit("\n### FILE: "), F.coalesce("g", F.lit("")), F.lit("/"), F.coalesce("p", F.lit("")), F.when(begin > F.col("before"), " (continued)").otherwise(""), F.lit("\n"))
    each = pieces.select("g", "part", F.struct("before", "p", "i", F.concat(head, piece, F.lit("\n")).alias("t")).alias("x"))
    return each.groupBy("g", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("text")).select(F.col("g").alias(group), F.col("part").cast("long").alias("part"), "text")


def severity_rollup(decisions: DataFrame, group: str, decision: str, reason: str, order: str) -> DataFrame:
    """group, decision (the severest; a missing one is suspicious), reasoning: the first three reasons of that severity and how many more."""
    d = F.coalesce(F.col(decision), F.lit("suspicious"))
    level = F.when(d == "malicious", 2).when(d == "suspicious", 1).otherwise(0)
    rows = decisions.select(F.col(group), level.alias("__s"), F.col(order).alias("__o"), F.coalesce(F.col(reason), F.lit("")).alias("__r"))
    # three of each group and level by rank: a limit that Spark applies before the shuffle
    counted = rows.groupBy(group, "__s").agg(F.count("*").alias("__n"))
    top = counted.groupBy(group).agg(F.max(F.struct("__s", "__n")).alias("__m")).select(group, F.col("__m.__s").alias("__s"), F.col("__m.__n").alias("__n"))
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(group, "__s").orderBy("__o"))).where("__k <= 3")
    listed = first.groupBy(group, "__s").agg(F.sort_array(F.collect_list(F.struct("__o", "__r"))).alias("__l"))
    text = F.array_join(F.transform("__l", lambda s: s["__r"]), "; ")
    more = F.when(F.col("__n") > 3, F.concat(F.lit(" and "), (F.col("__n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    name = F.when(F.col("__s") == 2, "malicious").when(F.col("__s") == 1, "suspicious").otherwise("benign")
    return top.join(listed, [group, "__s"]).select(group, name.alias("decision"), F.concat(text, more).alias("reasoning"))


def triage_summary(decisions: DataFrame, decision: str) -> DataFrame:
    return decisions.groupBy(F.coalesce(F.col(decision), F.lit("suspicious")).alias("decision")).agg(F.count("*").alias("n"))


def route_by_keyword(model: Column, explicit: Column | None = None) -> Column:
    """Base address for a model: the explicit one, else by the first keyword in its name."""
    out = F.lit(DEFAULT_ROUTE)
    for words, url in reversed(ROUTES):
        out = F.when(F.lower(model).rlike("|".join(words)), url).otherwise(out)
    return F.coalesce(F.nullif(explicit, F.lit("")), out) if explicit is not None else out


def parse_reply(reply: Column) -> Column:
    """Decision of a reply: of a JSON object if it is one, else by keyword."""
    from ..functions.text import verdict_from_text

    parsed = F.from_json(reply, "decision string")["decision"]
    return F.coalesce(F.when(F.lower(parsed).isin(*SEVERITY), F.lower(parsed)), verdict_from_text(reply))


def parse_reasoning(reply: Column) -> Column:
    """Reasoning of a reply that is a JSON object; empty if it has none."""
    return F.coalesce(F.from_json(reply, "reasoning string")["reasoning"], F.lit(""))


def decide(rows: DataFrame, text: str, judge: Callable[[list[str]], list[str]], out: str = "decision", reasoning: str | None = None) -> DataFrame:
    """Columns of decisions, and of reasoning if it has a name, from the replies of an external judge, a callable on lists of texts.

    Where it fails for a list, its texts are judged one by one. Of those that still fail nothing is known: they are suspicious, and the
    worker's log says why and how many they are. Each text is sent once, whatever is derived from the reply."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        texts, failed = batch.fillna("").tolist(), []
        replies = _replies(judge, texts, failed)
        if replies is None:
            failed.clear()
            each = [_replies(judge, [t], failed) if len(texts) > 1 else None for t in texts]
            replies = ["suspicious" if r is None else r[0] for r in each]
            logging.getLogger(__name__).warning("the judge failed on %d of %d texts: %r", sum(r is None for r in each), len(texts), failed[:1])
        return pd.Series(replies, dtype="object")

    # an answer can differ the next time, so Spark must not ask twice
    replied = rows.withColumn("__reply", run.asNondeterministic()(F.col(text)))
    found = replied.withColumn(out, parse_reply(F.col("__reply")))
    return (found.withColumn(reasoning, parse_reasoning(F.col("__reply"))) if reasoning else found).drop("__reply")


def _replies(judge: Callable[[list[str]], list[str]], texts: list[str], failed: list) -> list[str] | None:
    """A reply for each text, or None."""
    try:
        replies = list(judge(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
        return [None if r is None else str(r) for r in replies]
    except Exception as error:
        failed.append(error)
        return None


def prefer_first_by_type(rows: DataFrame, key: str, kind: str, preferred: str, order: str) -> DataFrame:
    """Of each key the first row of the preferred type, else the first row."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(whole, F.struct((F.col(kind) != preferred).alias("a"), F.col(order).alias("b"))).alias("__row")).select("__row.*")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with unique_name: repeats of a name get _1, _2 and so on before the suffix.

    Ranges of name and order are dealt out and ranked each on its own, with the numbers of a name in the ranges before: one that many
    rows have (setup.py) doesn't meet in one task."""
    parts = written(rows.repartitionByRange(F.col(name), F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(F.col(name).alias("__n"), F.col("__p").alias("__q")).agg(F.count("*").alias("__c"))
    # as many rows as ranges hold the name
    before = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy("__n").orderBy("__q")) - F.col("__c")).drop("__c")
    ranked = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p", name).orderBy(order)))
    r = (F.col("__before") + F.col("__r") - 1).alias("r")
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    found = ranked.join(before, (F.col("__p") == F.col("__q")) & F.col(name).eqNullSafe(F.col("__n")))
    return found.select(*rows.columns, F.when(r == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), r.cast("string"), suffix)).alias("unique_name"))
