"""Curation of conversation corpora: cleaning, filters, packing, dedup, sampling, stats.

A conversation is ``id``, ``conversations`` (array of struct ``from``, ``value``) and a place
``pos`` that orders the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.session import cut, materialise

BLOCKED = "openai|chatgpt"
ROLES = ("human", "gpt")
#: The place of a list item that is numbered 1 twice.
REPEATED_ITEM = r"\n1\. [^2]*\n1\. "
NINE_DIGITS = r"(?U)(\d)\1{8}"


def slice_rows(df: DataFrame, begin: int | None = None, end: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows whose place is in [begin, end)."""
    if begin is not None:
        df = df.where(F.col(pos) >= begin)
    return df.where(F.col(pos) < end) if end is not None else df


def model_rows(df: DataFrame, model: str = "gpt4") -> DataFrame:
    """Rows of a model or of none (null); an empty name is dropped."""
    return df.where((F.col("model") == model) | F.col("model").isNull())


def first_round(conv: Column | str = "conversations") -> Column:
    return F.slice(conv, 1, 2)


def alternating(conv: Column) -> Column:
    """Not empty, and roles human, gpt, human, ... in turn."""
    return (F.size(conv) > 0) & F.forall(F.transform(conv, lambda x, i: x["from"] == F.when(i % 2 == 0, ROLES[0]).otherwise(ROLES[1])), lambda ok: F.coalesce(ok, F.lit(False)))


def has_wrong_format(conv: Column) -> Column:
    return F.exists(conv, lambda x: F.rlike(x["value"], F.lit(REPEATED_ITEM)))


def has_repetition(text: Column) -> Column:
    """Nine equal digits (of any script) in a row."""
    return F.rlike(text, F.lit(NINE_DIGITS))


def joined(conv: Column) -> Column:
    return F.array_join(F.transform(conv, lambda x: x["value"]), "\n")


def language_rows(df: DataFrame, code: str, keep: set[str] | None = None, skip: set[str] | None = None) -> DataFrame:
    """Keep or skip languages by code; a missing code counts as ``unknown``."""
    if keep and skip:
        raise ValueError("keep and skip exclude each other")
    lang = F.coalesce(F.col(code), F.lit("unknown"))
    return df.where(lang.isin(*keep)) if keep else df.where(~lang.isin(*skip)) if skip else df


def cleaned(df: DataFrame, md: str | None = None) -> DataFrame:
    """Clean each conversation; adds ``code`` and replaces ``conversations``.

    ``md`` names an array with the converted text of each turn (null where it could not be
    converted, see ``with_markdown``); without it a turn converts to itself without
    outer blanks. Codes, in the order tested: 1 too few turns (before or after one leading turn
    that is not human and one trailing human turn are dropped); for the first turn that fails:
    2 wrong role, 3 blocked word in the raw text, 4 no conversion; a turn that is empty
    after conversion or begins with an unprintable character ends the conversation there; 1
    again if fewer than 16 characters were read so far, or no turn is left after an odd rest is cut to even; else 0.
    """
    value = F.col(md) if md else F.transform("conversations", lambda x: F.trim(x["value"]))
    turns = F.zip_with("conversations", value, lambda x, v: F.struct(x["from"].alias("from"), x["value"].alias("raw"), v.alias("value")))
    held = df.withColumn("_a", turns)
    held = held.withColumn("_a", F.when((F.size("_a") > 0) & (F.coalesce(F.get("_a", F.lit(0))["from"], F.lit("")) != ROLES[0]), F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0)))).otherwise(F.col("_a")))
    held = held.withColumn("_b", F.when((F.size("_a") > 1) & (F.try_element_at("_a", F.lit(-1))["from"] == ROLES[0]), F.slice("_a", 1, F.size("_a") - 1)).otherwise(F.col("_a")))
    # what each turn says: 2, 3 and 4 as above, -1 stop here, 0 good
    turn = F.transform(
        "_b",
        lambda x, i: F.when(F.coalesce(x["from"], F.lit("")) != F.when(i % 2 == 0, ROLES[0]).otherwise(ROLES[1]), 2)
        .when(F.rlike(F.lower(F.coalesce(x["raw"], F.lit(""))), F.lit(BLOCKED)), 3)
        .when(x["raw"].isNotNull() & x["value"].isNull(), 4)
        .when((F.coalesce(x["value"], F.lit("")) == "") | F.rlike(F.coalesce(x["value"], F.lit("")), F.lit(r"^[\p{C}]")), -1)
        .otherwise(0),
    )
    held = held.withColumn("_t", turn).withColumn("_bad", F.coalesce(F.get(F.filter("_t", lambda t: t != 0), F.lit(0)), F.lit(0)))
    n = F.when(F.col("_bad") == -1, F.array_position("_t", F.lit(-1)) - 1).otherwise(F.size("_b"))
    read = lambda k: F.transform(F.slice("_b", 1, F.greatest(k, F.lit(0))), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    held = held.withColumn("_n", n.cast("int")).withColumn("_c", read(F.col("_n") - F.col("_n") % 2))
    chars = F.aggregate(read(F.col("_n")), F.lit(0), lambda acc, x: acc + F.coalesce(F.char_length(x["value"]), F.lit(0)))
    few = (F.size("conversations") <= 1) | (F.size("_a") <= 1) | (F.size("_b") <= 1)
    code = F.when(F.coalesce(few, F.lit(True)), 1).when(F.col("_bad").isin(2, 3, 4), F.col("_bad")).when((F.size("_c") == 0) | (chars < 16), 1).otherwise(0)
    return held.withColumn("code", code).withColumn("conversations", F.col("_c")).drop("_a", "_b", "_t", "_bad", "_n", "_c")


def with_markdown(df: DataFrame, out: str = "md") -> DataFrame:
    """Add the converted text of each turn, by ``page``; null where it cannot be converted."""
    keep = df.columns
    schema = df.select("*", F.lit(None).cast("array<string>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if c is None else [page(t["value"]) if t else None for t in c] for c in b.column(keep.index("conversations")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=[*keep, out])

    return df.mapInArrow(run, schema)


def split_long(df: DataFrame, max_tokens: int, tokens: Callable[[Column], Column] = lambda x: F.size(F.split(x, " ")), keep_tail: bool = False) -> DataFrame:
    """Pack pairs of turns greedily into samples of at most ``max_tokens``: (id, begin, conversations).

    A pair costs its tokens plus 6 for each turn. On overflow the pairs so far are emitted
    (an empty sample if the first pair alone is too long) and packing starts again; a last
    pair that overflows is lost unless ``keep_tail``. Ids get the place of the first turn.
    """
    even = F.slice("conversations", 1, F.size("conversations") - F.size("conversations") % 2)
    held = df.select("id", even.alias("c")).where(F.size("c") > 0)
    costs = F.transform(F.sequence(F.lit(0), (F.size("c") / 2 - 1).cast("int")), lambda i: tokens(F.get(F.col("c"), (2 * i).cast("int"))["value"]) + tokens(F.get(F.col("c"), (2 * i + 1).cast("int"))["value"]) + 12)
    held = held.withColumn("costs", costs).withColumn("n", F.size("costs"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("cur"), F.array().cast("array<struct<b:int,e:int>>").alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        over, last = acc["cur"] + cost > max_tokens, acc["i"] == F.col("n") - 1
        emit = F.array(F.struct(acc["start"].alias("b"), acc["i"].alias("e")))
        tail = F.array(F.struct(acc["start"].alias("b"), (acc["i"] + 1).alias("e")))
        own = F.array(F.struct(acc["i"].alias("b"), (acc["i"] + 1).alias("e")))
        out = F.when(over & last & F.lit(keep_tail), F.concat(acc["out"], emit, own)).when(over, F.concat(acc["out"], emit)).when(last, F.concat(acc["out"], tail)).otherwise(acc["out"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(over, acc["i"]).otherwise(acc["start"]).alias("start"), F.when(over, cost).otherwise(acc["cur"] + cost).cast("bigint").alias("cur"), out.alias("out"))

    packed = held.withColumn("p", F.explode(F.aggregate("costs", zero, step, lambda acc: acc["out"])))
    return packed.select(F.concat_ws("_", F.col("id").cast("string"), (F.col("p.b") * 2).cast("string")).alias("id"), (F.col("p.b") * 2).alias("begin"), F.slice("c", F.col("p.b") * 2 + 1, (F.col("p.e") - F.col("p.b")) * 2).alias("conversations"))


def greedy_dedup(df: DataFrame, order: str, keys: tuple[str, str], rounds: int = 50, scan_rows: int = 1_000_000) -> DataFrame:
    """Rows that survive a scan in order: a row is dropped if an earlier surviving row has its
    first key or its second; dropped rows do not count.

    The scan as rounds of aggregations: of the undecided rows, those that come first by both
    keys survive; rows that share a key with a survivor are dropped. Each round decides at
    least the first row of every connected group. After ``rounds`` rounds, what is left (long
    chains of rows) is scanned in order by one task as soon as it is at most ``scan_rows``
    rows; until then rounds go on, so every row is decided. Null keys match nothing.
    """
    k1, k2 = keys
    open_ = materialise(df.select(F.col(order).alias("o"), F.col(k1).alias("a"), F.col(k2).alias("b")))
    kept, done, left = open_.limit(0), 0, open_.count()
    while left:
        if done >= rounds and left <= scan_rows:
            kept = kept.unionByName(materialise(_scanned(open_)))
            break
        first_a = open_.groupBy("a").agg(F.min("o").alias("fa")).where("a is not null")
        first_b = open_.groupBy("b").agg(F.min("o").alias("fb")).where("b is not null")
        seen = open_.join(first_a, "a", "left").join(first_b, "b", "left").select("o", "a", "b", (F.coalesce(F.col("fa") == F.col("o"), F.lit(True)) & F.coalesce(F.col("fb") == F.col("o"), F.lit(True))).alias("keep"))
        seen = materialise(seen)
        new = seen.where("keep").select("o", "a", "b")
        kept = kept.unionByName(new)
        rest = seen.where("not keep").select("o", "a", "b").join(new.select("a").where("a is not null").distinct(), "a", "left_anti").join(new.select("b").where("b is not null").distinct(), "b", "left_anti")
        open_ = cut(rest.select("o", "a", "b"))
        done, left = done + 1, open_.count()
    return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def _scanned(open_: DataFrame) -> DataFrame:
    """The surviving rows of (o, a, b) by the scan itself, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_a, first_b = {}, {}
        for batch in batches:
            keep = []
            for o, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                survives = first_a.get(a, o) == o and first_b.get(b, o) == o
                keep.append(survives)
                if survives:
                    if a is not None:
                        first_a[a] = o
                    if b is not None:
                        first_b[b] = o
            yield batch.filter(pa.array(keep, pa.bool_()))

    return open_.repartition(1).sortWithinPartitions("o").mapInArrow(run, open_.schema)


def turn_stats(df: DataFrame, tokens: Callable[[Column], Column] = lambda x: F.size(F.split(x, " "))) -> DataFrame:
    """Mean number of rounds per conversation and mean tokens per response (odd places)."""
    turns = F.aggregate(F.filter(F.transform("conversations", lambda x, i: F.when(i % 2 == 1, tokens(x["value"]))), lambda t: t.isNotNull()), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("t")), lambda acc, t: F.struct((acc["n"] + 1).alias("n"), (acc["t"] + t).alias("t")))
    return df.select(F.floor(F.size("conversations") / 2).alias("rounds"), turns.alias("s")).agg(F.count(F.lit(1)).alias("conversations"), F.avg("rounds").alias("avg_rounds"), (F.sum("s.t") / F.sum("s.n")).alias("avg_response_tokens"))


def sample(df: DataFrame, begin: int, end: int, max_chars: int, pos: str = "pos") -> DataFrame:
    """Range first, then conversations of more than ``max_chars`` characters are dropped."""
    chars = F.aggregate("conversations", F.lit(0), lambda acc, x: acc + F.coalesce(F.char_length(x["value"]), F.lit(0)))
    return slice_rows(df, begin, end, pos).where(chars <= max_chars)


def shuffled_place(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded random order as a column of 60 bits: a digest of seed and key, so it depends
    neither on partitions nor on the engine."""
    return df.withColumn("place", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint"))


def shuffled_take(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of a seeded random order."""
    return shuffled_place(df, key, seed).orderBy("place", key).limit(n).drop("place")


def poisson_limits(mean: float = 1.0, most: int = 12) -> list[int]:
    """The places, of 2^60, up to which a Poisson number is 0, 1, 2, ...; see ``drawn``."""
    limits, term, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += term
        limits.append(int(total * 2**60))
        term *= mean / (k + 1)
    return limits


def drawn(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows with replacement, about as many as there are: each row as often as a Poisson number of
    mean 1 says that its place in the seeded order stands for; ``times`` at least 1."""
    limits = poisson_limits()
    times = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        times = F.when(F.col("place") < limits[k], k).otherwise(times)
    return shuffled_place(df, key, seed).withColumn("times", times).where("times > 0").drop("place")


def train_test(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: train for exactly floor(ratio * n) rows, the first of a seeded order, else test.

    The border is found from counts of 4096 ranges of the order; only its own range is ranked.
    """
    n = df.count()
    want = int(ratio * n)
    hashed = shuffled_place(df, key, seed).withColumn("bucket", F.shiftright("place", 48))
    before, border, left = 0, 4096, 0
    for r in hashed.groupBy("bucket").count().orderBy("bucket").collect():
        if before + r["count"] > want:
            border, left = r["bucket"], want - before
            break
        before += r["count"]
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("place", key))
    inside = hashed.where(F.col("bucket") == border).withColumn("part", F.when(rank <= left, "train").otherwise("test"))
    outside = hashed.where(F.col("bucket") != border).withColumn("part", F.when(F.col("bucket") < border, "train").otherwise("test"))
    return outside.unionByName(inside).drop("place", "bucket")


def merged(*parts: DataFrame) -> DataFrame:
    """Union of corpora with the number of the source; missing columns are null."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def instruction_rows(df: DataFrame, instruction: str = "instruction", given: str = "input", output: str = "output", place: str = "place") -> DataFrame:
    """Instruction rows as conversations; an input of one letter or none is left out."""
    prompt = F.when(F.char_length(F.trim(F.coalesce(given, F.lit("")))) > 1, F.concat(F.col(instruction), F.lit("\nInput:\n"), F.col(given))).otherwise(F.col(instruction))
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return df.select(F.concat(F.lit("alpaca_"), F.col(place).cast("string")).alias("id"), F.array(turn("human", prompt), turn("gpt", F.col(output))).alias("conversations"))


def identity_rows(spark, name: str, org: str, groups: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Question and answer rows about the model's identity: the products of short literal lists."""
    rows, k = [], 0
    for questions, answers in groups:
        for q in questions:
            for a in answers:
                rows.append((f"identity_{k}", q, a.format(name=name, org=org)))
                k += 1
    return spark.createDataFrame(rows, "id string, question string, answer string").select("id", F.array(F.struct(F.lit("human").alias("from"), F.col("question").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value"))).alias("conversations"))


def every_fifth(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Each fifth row, places counted from 1: a sampling operator."""
    return df.where((F.col(pos) + 1) % 5 == 0)


def long_pairs(df: DataFrame, question: str, answer: str, least: int = 5) -> DataFrame:
    """Pairs of which both sides have more than ``least`` words."""
    size = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return df.where((size(F.col(question)) > least) & (size(F.col(answer)) > least))


def length_histogram(df: DataFrame, text: str, width: int = 100) -> DataFrame:
    return df.groupBy(F.floor(F.size(F.split(text, " ")) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- pages -----------------------------------------------------------------------------


# Patterns of what chat pages leave in their texts, and what each becomes, in the order applied.
OPEN_TAGS = (r"<div.*?>", r"<span.*?>")
CODE_WITH_LANGUAGE = (r"(?s)```\s*(.*?)(?:Copy code)+(.+?)\s*?```", "```{1}\n{2}\n```")
COUNTER = r"\d+ / \d+"
COPY_COUNT = r"Copy\d+ chars / \d+ words"
EMPTY_CODE = r"```(.*?)Copy code\s*```"


def without_open_tags(c: Column) -> Column:
    """What goes before conversion: the open tags of blocks that would change indents and underscores."""
    for p in OPEN_TAGS:
        c = F.regexp_replace(c, p, "")
    return c


def tidied(c: Column) -> Column:
    """What follows conversion: code blocks get their language on the first line; a page counter at the
    very beginning, copy counts and empty code blocks go; triple line breaks become single ones."""
    c = _outer(F.regexp_replace(_outer(c), CODE_WITH_LANGUAGE[0], CODE_WITH_LANGUAGE[1].replace("{1}", "$1").replace("{2}", "$2")))
    c = F.regexp_replace(c, rf"\A{COUNTER}", "")
    for p in (COPY_COUNT, EMPTY_CODE):
        c = F.regexp_replace(c, p, "")
    return _outer(F.replace(c, F.lit("\n\n\n"), F.lit("\n")))


def _outer(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def strip_page(c: Column | str) -> Column:
    """All that needs no parser: ``without_open_tags`` and ``tidied``."""
    return tidied(without_open_tags(F.col(c) if isinstance(c, str) else c))


def page(html: str | None) -> str | None:
    """One page turn as markdown: the same steps around the converter; null if its mark-up cannot be read."""
    if html is None:
        return None
    for p in OPEN_TAGS:
        html = re.sub(p, "", html)
    try:
        text = (to_markdown(html) or "").strip()
    except (AssertionError, ValueError):
        return None
    text = re.sub(CODE_WITH_LANGUAGE[0], lambda m: CODE_WITH_LANGUAGE[1].format(None, m.group(1), m.group(2)), text).strip()
    text = re.sub(rf"\A{COUNTER}", "", text)
    for p in (COPY_COUNT, EMPTY_CODE):
        text = re.sub(p, "", text)
    return text.replace("\n\n\n", "\n").strip()


def to_markdown(html: str | None) -> str | None:
    """A small converter: headings, emphasis, links, lists, code, quotes, rules, paragraphs."""
    from html.parser import HTMLParser

    if html is None or "<" not in html:
        return html
    out: list[str] = []
    lists: list[list] = []
    links: list[str] = []
    pre = [0]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("p", "ul", "ol", "blockquote", "table"):
                out.append("\n\n" if not lists else "\n")
            if tag in ("ul", "ol"):
                lists.append([tag, 0])
            elif tag == "li" and lists:
                lists[-1][1] += 1
                out.append("\n" + "  " * (len(lists) - 1) + ("* " if lists[-1][0] == "ul" else f"{lists[-1][1]}. "))
            elif tag == "br":
                out.append("\n")
            elif tag == "hr":
                out.append("\n\n---\n\n")
            elif tag in ("b", "strong"):
                out.append("**")
            elif tag in ("i", "em"):
                out.append("*")
            elif tag == "pre":
                pre[0] += 1
                out.append("\n```\n")
            elif tag == "code" and not pre[0]:
                out.append("`")
            elif tag == "a":
                links.append(dict(attrs).get("href") or "")
                out.append("[")
            elif tag == "blockquote":
                out.append("> ")
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("td", "th"):
                out.append("| ")
            elif tag == "tr":
                out.append("\n")

        def handle_endtag(self, tag):
            if tag in ("ul", "ol") and lists:
                lists.pop()
                out.append("\n")
            elif tag in ("b", "strong"):
                out.append("**")
            elif tag in ("i", "em"):
                out.append("*")
            elif tag == "pre" and pre[0]:
                pre[0] -= 1
                out.append("\n```\n")
            elif tag == "code" and not pre[0]:
                out.append("`")
            elif tag == "a" and links:
                out.append(f"]({links.pop()})")
            elif tag in ("td", "th"):
                out.append(" ")
            elif tag == "p" or tag[0] == "h" and tag[1:].isdigit():
                out.append("\n\n")

        def handle_data(self, data):
            out.append(data if pre[0] else " ".join(data.split("\n")) if lists else data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    text = "".join(out).strip()
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text
