"""Model registry, cards, workers, usage, task prompts and prompt templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.operators.prompts import Style, render, styles
from palaver.session import join_side


def model_info(rows: DataFrame, registry: DataFrame, model: str = "model") -> DataFrame:
    """Rows with what the registry (model, simple_name, link, description, place) says of their
    model; nulls for an unknown one. The registry is a list of models, broadcast if it is short."""
    return rows.join(join_side(registry.withColumnRenamed("model", model), registry.count()), model, "left")


def model_cards(models: DataFrame, registry: DataFrame, order: str, placeholder: str, width: int = 3) -> DataFrame:
    """(row, column, simple_name, text): a card for each name, first come first served by
    ``order``, ``width`` in a row. An unknown model is its own name with the placeholder text."""
    known = model_info(models, registry).select(F.coalesce("simple_name", "model").alias("simple_name"), F.coalesce(F.concat("simple_name", F.lit(": "), "description"), F.concat("model", F.lit(": "), F.lit(placeholder))).alias("text"), order)
    first = known.groupBy("simple_name").agg(F.min_by("text", order).alias("text"), F.min(order).alias("o"))
    n = F.row_number().over(W.orderBy("o")) - 1  # a list of models
    return first.withColumn("n", n).select(F.floor(F.col("n") / width).cast("int").alias("row"), (F.col("n") % width).cast("int").alias("column"), "simple_name", "text")


def by_priority(models: DataFrame, registry: DataFrame) -> DataFrame:
    """(model, priority): registered models in the registry's order, then the others by name."""
    known = model_info(models, registry.select("model", "place"))
    return known.select("model", F.row_number().over(W.orderBy(F.asc_nulls_last("place"), "model")).alias("priority"))  # a list of models


def serving(workers: DataFrame, models: DataFrame) -> DataFrame:
    """(model, worker) for each wanted model and worker that serves it; ``workers`` holds an
    array of models each. An equi-join on the exploded arrays."""
    return workers.select("worker", F.explode(F.array_distinct("models")).alias("model")).join(models.select("model").distinct(), "model").select("model", "worker")


def worker_status(workers: DataFrame) -> DataFrame:
    """One row: the union of all models, in order, with the sums of speed and queue."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("models"))))  # lists of a few names for each worker
    return workers.agg(every.alias("models"), F.sum("speed").alias("speed"), F.sum("queue").alias("queue"))


def usage(calls: DataFrame, request: str = "request", prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """Tokens of a request: its prompt once, the completions of all its choices, and both."""
    return calls.groupBy(request).agg(F.max(prompt).alias(prompt), F.sum(completion).alias(completion)).withColumn("total_tokens", F.col(prompt) + F.col(completion))


def task_prompts(tasks: DataFrame, paraphrases: DataFrame, instances: DataFrame) -> DataFrame:
    """(task, place, prompt, ...): every instance of a task under every paraphrase of its instruction.

    ``paraphrases`` has an array ``instructions`` per task; tasks without one are left out. The
    prompt is the instruction, a line break and the input. Instances are joined, not collected.
    """
    listed = tasks.join(paraphrases.where(F.size("instructions") > 0), "task").select("task", F.posexplode("instructions").alias("place", "instruction"))
    return listed.join(instances, "task").withColumn("prompt", F.concat("instruction", F.lit("\n"), "input"))


@dataclass(frozen=True)
class Template:
    """A named conversation format: system text, roles, style and the strings that end a reply."""

    system: str
    roles: tuple[str, str]
    style: Style
    stop: tuple[str, ...] = ()


def templates(system: str = "Be kind.", roles: tuple[str, str] = ("USER", "ASSISTANT")) -> dict[str, Template]:
    """A registry with one template for each style. Own templates are added as items."""
    return {name: Template(system, roles, style, tuple(x for x in dict.fromkeys(style.ends) if x.strip())) for name, style in styles().items()}


def rendered(messages: Column, template: Column, registry: dict[str, Template], default: str) -> Column:
    """A conversation by its named template, by the default one if the name is unknown or null."""
    text = lambda t: render(messages, t.system, t.roles, t.style)
    return F.coalesce(*[F.when(template == name, text(t)) for name, t in registry.items() if name != default], text(registry[default]))


def fill(template: Column, fields: dict[str, Column]) -> Column:
    """A template with its ``{named}`` places filled; null values are empty texts. Values are
    put in at once, so a place inside a value stays as it is."""
    parts = F.split(template, r"(?=\{)|(?<=\})")
    known = F.create_map(*[x for name, value in fields.items() for x in (F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(known[p], p)), "")
