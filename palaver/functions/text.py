"""Text, time and number expressions used by the batch programs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "US/Pacific"
# Words that reveal a model's identity in an anonymous battle.
IDENTITY_WORDS = ("vicuna", "lmsys", "koala", "uc berkeley", "open assistant", "laion", "chatglm", "chatgpt", "openai", "anthropic", "claude", "bard", "palm", "lamda", "google", "network error due to high traffic. please regenerate or refresh this page.")
# Vote type of the log to winner of the battle.
VOTES = {"leftvote": "model_a", "rightvote": "model_b", "tievote": "tie", "bothbad_vote": "tie (bothbad)"}
# Sampling temperature by question category; others get 0.7.
TEMPERATURE = {"writing": 0.7, "roleplay": 0.7, "extraction": 0.0, "math": 0.0, "coding": 0.0, "reasoning": 0.0, "stem": 0.1, "humanities": 0.1}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict) -> Column:
    """Value of a literal table, null for other keys."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(c)]


def winner_of(vote: Column | str) -> Column:
    return lookup(vote, VOTES)


def temperature_of(category: Column | str) -> Column:
    return F.coalesce(lookup(category, TEMPERATURE), F.lit(0.7))


def rename_model(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("bard"), F.lit("palm-2"))


def remove_html(c: Column | str) -> Column:
    """Name inside a ``<h3>`` heading: from after the first ": " to six characters before the
    end; without a ": " from the second character."""
    c = col(c)
    at = F.instr(c, ": ")
    begin = F.when(at > 0, at + 2).otherwise(F.lit(2))
    return F.when(c.startswith("<h3>"), F.substring(c, begin, F.greatest(F.char_length(c) - 5 - begin, F.lit(0)))).otherwise(c)


def day_of(tstamp: Column | str, zone: str = PACIFIC) -> Column:
    """Local day of epoch seconds, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc(tstamp)), "yyyy-MM-dd")


def time_of(tstamp: Column | str, zone: str = PACIFIC) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc(tstamp)), "yyyy-MM-dd HH:mm:ss")


def _utc(tstamp: Column | str) -> Column:
    """UTC wall clock of epoch seconds as a zoneless timestamp."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(col(tstamp)))


def preview(question_id: Column | str, text: Column | str, n: int = 128) -> Column:
    return F.concat(col(question_id).cast("string"), F.lit(": "), F.substring(col(text), 1, n), F.lit("..."))


def tidy_answer(c: Column | str) -> Column:
    """Bullets become "- "; a blank line before a numbered item goes."""
    c = F.regexp_replace(col(c), r"(?m)^\s*• ?", "- ")
    return F.regexp_replace(c, r"\n\n(\d+\. )", "\n$1")


def unescape_in_code(c: Column | str) -> Column:
    """``\\_`` becomes ``_`` inside fenced blocks (every second part between fences)."""
    parts = F.split(col(c), "```")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\\_"), F.lit("_"))).otherwise(p)), "```")


# Latin punctuation beside CJK letters and its full-width form.
CJK_MARKS = {",": "，", "!": "！", ":": "：", ";": "；", r"\?": "？"}


def cjk_marks(c: Column | str) -> Column:
    """Latin punctuation after or before a CJK letter becomes full-width."""
    c = col(c)
    for mark, wide in CJK_MARKS.items():
        c = F.regexp_replace(c, rf"(?<=[\x{{4e00}}-\x{{9fff}}]){mark}|{mark}(?=[\x{{4e00}}-\x{{9fff}}])", wide)
    return c


def cut_at_stop(c: Column | str, stop: str) -> Column:
    """Text before the first stop string; the whole text if there is none."""
    at = F.instr(col(c), stop)
    return F.when(at > 0, F.substring(col(c), 1, at - 1)).otherwise(col(c))


def partial_stop(c: Column | str, stop: str) -> Column:
    """Whether the text ends with a beginning of the stop string."""
    found = F.lit(False)
    for k in range(1, len(stop) + 1):
        found = found | col(c).endswith(stop[:k])
    return found


def complete_sentence(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit(r"[.!?…。！？\"”]\s*$"))


def basename(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)/?$", 1)


def credentials(c: Column | str) -> Column:
    """``user:password`` pairs of a comma-separated line; null if there is none."""
    pairs = F.filter(F.transform(F.split(col(c), ","), F.trim), lambda x: x != "")
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda x: F.split(x, ":")))


def hyperlink(name: Column | str, link: Column | str) -> Column:
    return F.format_string('<a target="_blank" href="%s">%s</a>', col(link), col(name))


def gold_list(c: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(col(c), ", "), F.lit("]"))


def json_text(c: Column | str) -> Column:
    """A text as a JSON string, with its quotes."""
    whole = F.to_json(F.array(col(c)))
    return F.when(col(c).isNotNull(), F.substring(whole, F.lit(2), F.char_length(whole) - 2))


def from_json_text(c: Column | str) -> Column:
    """The text of a JSON string."""
    return F.get(F.from_json(F.concat(F.lit("["), col(c), F.lit("]")), "array<string>"), F.lit(0))


def first_gold(c: Column | str) -> Column:
    """The first of a list of golds, as a prompt quotes it."""
    return json_text(F.get(col(c), F.lit(0)))


def input_guard(text: Column | str, turns: Column | str, cap: int = 2560, limit: int = 50) -> Column:
    """What the serving guards say of a user input: empty, too many turns, cut, ok."""
    return F.when(F.coalesce(F.char_length(F.trim(col(text))), F.lit(0)) == 0, "empty").when(col(turns) >= limit, "turn_limit").when(F.char_length(col(text)) > cap, "cut").otherwise("ok")


def guarded_text(text: Column | str, cap: int = 2560) -> Column:
    """What goes on of a user input: its first ``cap`` letters."""
    return F.left(col(text), F.lit(cap))


def is_stop(stop: Column | str) -> Column:
    """Whether a request's ``stop``, given as JSON, is absent, a string or a list of strings."""
    s = F.trim(col(stop))
    strings = F.from_json(s, "array<string>")
    return s.isNull() | (s == "null") | F.rlike(s, F.lit(r'^"([^"\\]|\\.)*"$')) | (s.startswith("[") & strings.isNotNull() & F.rlike(s, F.lit(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$')))


def request_error(max_tokens: Column | str, n: Column | str, temperature: Column | str, top_p: Column | str) -> Column:
    """First failing range check of a completion request, or null."""
    return (
        F.when(col(max_tokens) <= 0, "max_tokens")
        .when(col(n) <= 0, "n")
        .when((col(temperature) < 0) | (col(temperature) > 2), "temperature")
        .when((col(top_p) < 0) | (col(top_p) > 1), "top_p")
    )


def context_length(*keys: Column | str, default: int = 2048) -> Column:
    return F.coalesce(*[col(k) for k in keys], F.lit(default))


def fits(tokens: Column | str, max_tokens: Column | str, context: Column | str) -> Column:
    return col(tokens) + col(max_tokens) <= col(context)


def first_rule(c: Column | str, rules: list[tuple[str, str]], default: str = "base") -> Column:
    """Name of the first rule whose substring occurs in the lower-case value."""
    out = F.lit(default)
    for part, name in reversed(rules):
        out = F.when(F.contains(F.lower(col(c)), F.lit(part)), name).otherwise(out)
    return out


def words(c: Column | str) -> Column:
    """Number of words between single blanks."""
    return F.size(F.split(col(c), " "))


def first_words(c: Column | str, n: int = 4) -> Column:
    return F.array_join(F.slice(F.split(F.trim(col(c)), r"\s+"), 1, n), " ")


def quantise(c: Column | str, bits: int = 8) -> Column:
    """A group of numbers as (low, scale, integers)."""
    low, high = F.array_min(col(c)), F.array_max(col(c))
    scale = F.when(high > low, (2**bits - 1) / (high - low)).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), scale.alias("scale"), F.transform(col(c), lambda x: F.floor((x - low) * scale + 0.5).cast("int")).alias("q"))


def dequantise(c: Column | str) -> Column:
    c = col(c)
    return F.transform(c["q"], lambda q: q / c["scale"] + c["low"])


def half_up(c: Column | str) -> Column:
    """Nearest integer, halves up."""
    return F.floor(col(c) + 0.5).cast("int")


def exact_round(c: Column | str, places: int) -> Column:
    """Rounding of the exact binary value (2.675 gives 2.67), which no built-in does; for
    reports of a few rows."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, places), na_action="ignore")

    return rounded(col(c))
