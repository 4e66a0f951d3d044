"""Modules: tasks that take an instance from the triples and give JSON-LD nodes back.

A task is a Python callable from an instance (a dict) to an iterator of nodes. It
runs in Spark's Python workers, one instance a row, so instances are shared out
among executors. A node whose type ends in Error stops the run with its comment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import terms
from tessera.schema import TesseraError
from tessera.shared import cut
from tessera.sources.linked import parse_jsonld

Task = Callable[[dict], Iterator[dict]]
TERMS = "s_kind string, s string, p string, o_kind string, o string, o_datatype string, o_lang string"


class TaskFailed(TesseraError):
    """A task reported an error node."""


def tasks(triples: DataFrame, module_classes: list[str]) -> DataFrame:
    """(subject, classes): subjects of a module's class, sorted."""
    typed = triples.filter((F.col("predicate") == S.RDF_TYPE) & F.col("object_iri").isin(module_classes))
    return typed.groupBy("subject").agg(F.sort_array(F.collect_set("object_iri")).alias("classes")).orderBy("subject")


def instances(triples: DataFrame, module_classes: list[str], namespace: str = "") -> DataFrame:
    """(subject, instance): each task's node as JSON, local names within the namespace, values in sorted lists.

    Blank nodes are nested however deep they go, the innermost first, one round a level; those on a cycle, or that lead into one, are left as labels.
    """
    wanted = triples.filter(F.col("predicate").startswith(namespace) | (F.col("predicate") == S.RDF_TYPE))
    local = F.when(F.col("predicate") == S.RDF_TYPE, F.lit("@type")).otherwise(F.substr("predicate", F.lit(len(namespace) + 1)))
    rows = wanted.select("subject", local.alias("k"), F.to_json(F.struct(terms.object_display().alias("v"))).alias("v"), F.when(F.col("object_string").startswith("_:"), F.col("object_string")).alias("to"))

    def nodes(of: DataFrame) -> DataFrame:
        """Subjects with a JSON object of lists of values."""
        each = of.groupBy("subject", "k").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("v"))
        pair = F.concat(F.expr("substr(to_json(struct(k)), 6, length(to_json(struct(k))) - 6)"), F.lit(":["), F.col("v"), F.lit("]"))
        body = F.array_join(F.sort_array(F.collect_list(pair)), ",")
        return each.groupBy("subject").agg(body.alias("body"))

    value = F.expr("substr(v, 6, length(v) - 6)")
    flat = rows.withColumn("v", F.when(F.col("v") != "{}", value).otherwise(F.lit("null")))
    filled = lambda of, done: of.join(done, "to", "left").withColumn("v", F.coalesce("nested", "v"))
    blank = cut(flat.filter(F.col("subject").startswith("_:")))
    inner = blank.select(F.col("subject").alias("to")).distinct()
    done = blank.select(F.col("subject").alias("to"), F.lit("").alias("nested")).limit(0)
    while True:
        # a blank node is ready if all blank nodes below it that are subjects are done
        left = blank.join(done.select(F.col("to").alias("subject")), "subject", "left_anti")
        waits = left.join(inner.join(done.select("to"), "to", "left_anti"), "to", "left_semi").select("subject").distinct()
        ready = left.join(waits, "subject", "left_anti")
        new = cut(nodes(filled(ready, done)).select(F.col("subject").alias("to"), F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("nested")))
        if new.isEmpty():
            break
        done = cut(done.union(new))
    mine = tasks(triples, module_classes).select("subject")
    ident = F.expr("substr(to_json(struct(subject as `@id`)), 1, length(to_json(struct(subject as `@id`))) - 1)")
    return nodes(filled(flat.join(mine, "subject", "left_semi"), done)).select("subject", F.concat(ident, F.lit(","), F.col("body"), F.lit("}")).alias("instance"))


def error_text(node: dict) -> str | None:
    """The comment of an error node, None for any other."""
    kinds = node.get("@type", [])
    if not any(str(t).endswith("Error") for t in (kinds if isinstance(kinds, list) else [kinds])):
        return None
    return str(next((v for k, v in node.items() if k.endswith("comment")), node.get("@type")))


def nodes_terms(nodes: list[dict], context: dict) -> list[tuple]:
    """Terms of a task's nodes under an injected context; an error node raises."""
    errors = [e for n in nodes if (e := error_text(n)) is not None]
    if errors:
        raise TaskFailed("; ".join(errors))
    return [row[1:] for row in parse_jsonld(json.dumps({"@context": context, "@graph": nodes}))]


def materialise(instances_: DataFrame, task: Task, context: dict) -> DataFrame:
    """Terms of what a task makes of each (subject, instance); blank nodes are kept apart by subject."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            for subject, text in zip(pdf["subject"], pdf["instance"], strict=True):
                out = pd.DataFrame(nodes_terms(list(task(json.loads(text))), context), columns=[c.split()[0] for c in TERMS.split(", ")], dtype=object)
                tag = hashlib.sha256(subject.encode()).hexdigest()[:12]
                for kind, c in (("s_kind", "s"), ("o_kind", "o")):
                    blank = out[kind] == "bnode"
                    out.loc[blank, c] = "_:t" + tag + "_" + out.loc[blank, c].str[2:]
                yield out

    return instances_.select("subject", "instance").mapInPandas(run, TERMS)


def read_task_output(spark: SparkSession, path: str, context: dict) -> DataFrame:
    """Terms of a file of nodes, one JSON object a line; blank nodes are named by the line's text."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.sha2("value", 256).alias("subject"), F.col("value").alias("instance"))
    return materialise(lines, lambda node: iter([node]), context)


def merged(graph: DataFrame, *more: DataFrame) -> DataFrame:
    """Union of term frames without repeated triples."""
    for one in more:
        graph = graph.unionByName(one, allowMissingColumns=True)
    return graph.dropDuplicates(["s", "p", "o_kind", "o", "o_datatype", "o_lang"])
