"""Texts for people: masked, shortened, told by age; durations, and the strings of a JSON value."""

from __future__ import annotations

import json
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(secret: Column) -> Column:
    """The first four characters (eight after npm_) and the last four of a secret; short ones are hidden."""
    head = F.when(F.startswith(secret, F.lit("npm_")), F.least(F.lit(8), F.length(secret) - 4)).otherwise(4)
    shown = F.concat(F.substring(secret, F.lit(1), head), F.lit("***"), F.right(secret, F.least(F.lit(4), F.length(secret) - head)))
    return F.when(F.length(secret) <= 8, "***").otherwise(shown)


def short_model(model: Column) -> Column:
    """A model's name without its vendor and its date."""
    bare = F.regexp_replace(model, r"^claude-", "")
    for vendor in ("anthropic/", "openai/", "google/"):
        bare = F.regexp_replace(bare, f"^{vendor}", "")
    return F.coalesce(F.regexp_replace(bare, r"-\d{8}$", ""), F.lit(""))


def squashed(text: Column, most: int) -> Column:
    """text with single blanks for white space, up to most characters, the last an ellipsis where it was cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end; null if either is missing or the end comes first."""
    s = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000)
    return F.when(s >= 0, s)


def time_ago(end: Column, now: Column) -> Column:
    """How long ago, in the words of a list: just now, hours, yesterday, days; recently if it isn't known."""
    s = seconds_between(end, now)
    days = F.floor(s / 86_400)
    told = F.when(s < 3600, "just now").when(days == 0, F.format_string("%dh ago", F.floor(s / 3600))).when(days == 1, "yesterday").otherwise(F.format_string("%d days ago", days))
    return F.when(s.isNull(), "recently").otherwise(told)


def since_day(text: str, today: date) -> date:
    """The day that today, yesterday, week or an ISO date means."""
    word = text.strip().lower()
    if word in ("today", "yesterday"):
        return today - timedelta(days=word == "yesterday")
    if word in ("week", "this week"):
        return today - timedelta(days=today.weekday())
    return date.fromisoformat(text.strip())


def gap_minutes(text: str) -> int:
    """Minutes of a gap like 30m or 1h."""
    if not (hit := re.fullmatch(r"(\d+)\s*([mh])", text.strip().lower())) or not int(hit[1]):
        raise ValueError(f"not a gap: {text!r}")
    return int(hit[1]) * (60 if hit[2] == "h" else 1)


def json_strings(value: Column) -> Column:
    """Every string in a JSON value, however deep, with its path; nothing for what isn't JSON.

    How deep a value goes isn't known to a plan, so this is Python, on Arrow batches.
    """
    return F.udf(_strings_of, "array<struct<path:string,text:string>>", useArrow=True)(value)


def _strings_of(value: str | None) -> list[tuple[str, str]]:
    try:
        whole = json.loads(value or "null")
    except ValueError:
        return []
    out, left = [], [("", whole)]
    while left:
        path, v = left.pop()
        if isinstance(v, str):
            if v:
                out.append((path.lstrip("."), v))
        elif isinstance(v, dict):
            left.extend((f"{path}.{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            left.extend((f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v))))
    return out


def json_summary(json_text: Column, first: tuple[str, ...] = ("text", "message", "content", "command", "summary"), strings: int = 6, most: int = 220) -> Column:
    """Some strings of a JSON value on one line, those under the first keys before others."""
    found = json_strings(json_text)
    rank = lambda s: F.coalesce(*[F.when(F.regexp_like(s["path"], F.lit(rf"(?:^|[.]){k}(?:$|[.\[])")), F.lit(i)) for i, k in enumerate(first)], F.lit(len(first)))
    ordered = F.array_sort(F.transform(found, lambda s, i: F.struct(rank(s).alias("r"), i.alias("i"), squashed(s["text"], 160).alias("t"))))
    return squashed(F.array_join(F.transform(F.slice(ordered, 1, strings), lambda s: s["t"]), " · "), most)
