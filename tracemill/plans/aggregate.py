"""The aggregation front end: dimensions, metrics, filters and a time window over a domain.

A specification is checked against the domain's registry, rewritten where the domain
asks for a partition, and becomes one filter - group - top-n plan.  Values reach the
plan as literals, never as query text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import workspace

DEFAULT_LIMIT, MAX_LIMIT, MAX_DIMENSIONS = 10, 1000, 3
OPERATORS = ("!=", ">=", "<=", "in:", "=", ">", "<")

#: Metric fields of the cost domain, and the ledger's columns.
LEDGER_FIELDS = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_write", "thinking_tokens": "reasoning", "cost_estimate": "cost_estimate"}


class SpecError(ValueError):
    """A specification that the domain doesn't allow."""


@dataclass(frozen=True)
class Domain:
    """What may be asked: dimensions and filters (columns by name), numeric metric fields, the time field, and a dimension that always splits."""

    name: str
    dimensions: dict[str, Callable[[], Column]]
    filters: dict[str, Callable[[], Column]]
    metrics: dict[str, Callable[[], Column]]
    time_field: str
    partition: str | None = None


def _named(*names: str) -> dict[str, Callable[[], Column]]:
    return {n: (lambda n=n: F.col(n)) for n in names}


def _common(time: str) -> dict[str, Callable[[], Column]]:
    return {
        "session": lambda: F.col("session_key"),
        "workspace": lambda: workspace(F.col("session_key")),
        "date": lambda: F.date_format(F.col(time), "yyyy-MM-dd"),
        "hour": lambda: F.date_format(F.col(time), "yyyy-MM-dd'T'HH"),
    }


def _pick(fields: dict, *names: str) -> dict:
    return {n: fields[n] for n in names}


_EVENTS = _common("event_at")
_INCIDENTS = _common("created_at")
DOMAINS = {
    "events": Domain(
        "events",
        _named("client", "type", "confidence", "source", "lossiness") | _EVENTS,
        _named("client", "type", "confidence", "source", "event_at") | _pick(_EVENTS, "session", "workspace"),
        {},
        "event_at",
    ),
    "incidents": Domain(
        "incidents",
        _named("kind", "confidence") | _pick(_INCIDENTS, "session", "workspace", "date"),
        _named("kind", "confidence", "created_at") | _pick(_INCIDENTS, "session", "workspace"),
        _named("count"),
        "created_at",
    ),
    "cost": Domain(
        "cost",
        _named("model", "provider", "data_source", "service_tier", "pricing_table_version") | _pick(_EVENTS, "session", "workspace", "date"),
        _named("model", "data_source", "service_tier", "pricing_table_version") | _pick(_EVENTS, "session", "workspace"),
        {n: (lambda c=c: F.col(c)) for n, c in LEDGER_FIELDS.items()},
        "event_at",
        partition="data_source",
    ),
}


@dataclass(frozen=True)
class Metric:
    kind: str
    field: str | None = None

    @property
    def alias(self) -> str:
        return self.kind if self.field is None else f"{self.kind}_{self.field}"


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Spec:
    domain: Domain
    dimensions: tuple[str, ...]
    metric: Metric = field(default_factory=lambda: Metric("count"))
    predicates: tuple[Predicate, ...] = ()
    since: datetime | None = None
    limit: int = DEFAULT_LIMIT
    canonical: bool = False

    def __post_init__(self) -> None:
        if self.canonical:
            raise SpecError("aggregates are over base rows; there are none over the canonical view")
        d = self.dimensions
        if not 1 <= len(d) <= MAX_DIMENSIONS or len(set(d)) != len(d):
            raise SpecError(f"from 1 to {MAX_DIMENSIONS} different dimensions are needed")
        if unknown := [x for x in d if x not in self.domain.dimensions]:
            raise SpecError(f"unknown dimension: {unknown[0]}")
        if self.metric.kind not in ("count", "sum", "avg") or (self.metric.kind == "count") != (self.metric.field is None):
            raise SpecError("a metric is count, sum:field or avg:field")
        if self.metric.field is not None and self.metric.field not in self.domain.metrics:
            raise SpecError(f"not a numeric field: {self.metric.field}")
        for p in self.predicates:
            if p.field not in self.domain.filters:
                raise SpecError(f"unknown filter: {p.field}")
            if self.since is not None and p.field == self.domain.time_field and p.op in (">", ">="):
                raise SpecError("a window and a lower bound of time exclude each other")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise SpecError(f"a limit is from 1 to {MAX_LIMIT}")


def parse_metric(text: str) -> Metric:
    kind, colon, name = text.partition(":")
    return Metric(kind, name if colon else None)


def parse_predicate(text: str) -> Predicate:
    """field, operator, value: the leftmost operator counts, the longest of several there; in: takes values between |."""
    found = [(text.find(op), -len(op), op) for op in OPERATORS if op in text]
    if not found:
        raise SpecError(f"no operator in {text!r}")
    at, _, op = min(found)
    name, value = text[:at].strip(), text[at + len(op) :].strip()
    if op == "in:":
        values = tuple(v.strip() for v in value.split("|") if v.strip())
        if not values:
            raise SpecError("in: needs a value")
        return Predicate(name, "in", values)
    if not name:
        raise SpecError(f"no field in {text!r}")
    return Predicate(name, op, value)


def parse_since(text: str, now: datetime) -> datetime:
    """Start of a window: 3d, 12h, 30m before now; today; thisweek (from Monday)."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text == "today":
        return midnight
    if text == "thisweek":
        return midnight - timedelta(days=now.weekday())
    m = re.fullmatch(r"(\d+)([dhm])", text)
    if not m or int(m[1]) <= 0:
        raise SpecError(f"not a window: {text!r}")
    return now - timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})


def partitioned(spec: Spec) -> Spec:
    """spec with the domain's partition first, unless it is a dimension or filtered already."""
    name = spec.domain.partition
    if name is None or name in spec.dimensions or any(p.field == name for p in spec.predicates):
        return spec
    if len(spec.dimensions) == MAX_DIMENSIONS:
        raise SpecError(f"{name} has to be a dimension or a filter here")
    return replace(spec, dimensions=(name, *spec.dimensions))


def condition(spec: Spec) -> Column:
    out = F.lit(True)
    for p in spec.predicates:
        c = spec.domain.filters[p.field]()
        out = out & {"=": lambda: c == p.value, "!=": lambda: c != p.value, ">": lambda: c > p.value, ">=": lambda: c >= p.value, "<": lambda: c < p.value, "<=": lambda: c <= p.value, "in": lambda: c.isin(*p.value)}[p.op]()
    if spec.since is not None:
        out = out & (F.col(spec.domain.time_field) >= F.lit(spec.since))
    return out


def _measure(spec: Spec) -> Column:
    if spec.metric.kind == "count":
        return F.count(F.lit(1))
    value = spec.domain.metrics[spec.metric.field]()
    return F.coalesce(F.sum(value) if spec.metric.kind == "sum" else F.avg(value), F.lit(0))


def buckets(spec: Spec, rows: DataFrame) -> DataFrame:
    """The top groups: the metric downwards, then the dimensions upwards with nulls last."""
    spec = partitioned(spec)
    keys = [spec.domain.dimensions[d]().alias(d) for d in spec.dimensions]
    grouped = rows.filter(condition(spec)).groupBy(*keys).agg(_measure(spec).alias(spec.metric.alias))
    return grouped.orderBy(F.desc(spec.metric.alias), *[F.asc_nulls_last(d) for d in spec.dimensions]).limit(spec.limit)


def summary(spec: Spec, rows: DataFrame) -> DataFrame:
    """total, rows_scanned, and other_count: what the groups past the limit hold.

    For an average other_count is the total's excess over the sum of the averages, as
    the interface defines it, of no meaning beyond that.
    """
    spec = partitioned(spec)
    shown = buckets(spec, rows).agg(F.coalesce(F.sum(spec.metric.alias), F.lit(0)).alias("shown"))
    total = rows.filter(condition(spec)).agg(_measure(spec).alias("total"), F.count(F.lit(1)).alias("rows_scanned"))
    return total.crossJoin(shown).select("total", "rows_scanned", F.greatest(F.col("total") - F.col("shown"), F.lit(0)).alias("other_count"))
