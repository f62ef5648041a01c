"""Validators compiled from nested rules to one column expression.

A rule says what a value must be; ``issues_of`` turns it into a column of (path, message) structs, one for
each thing that a JSON value breaks, in the order of the rules. The value is a VARIANT, so types are those
of the JSON itself. The expression grows with the rules, never with the data; arrays go through higher-order
functions. Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

ISSUE = "array<struct<path:string,message:string>>"
#: What dates and times look like.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


@dataclass(frozen=True)
class Text:
    """A string that isn't blank; one of ``values``, if given, else as ``pattern`` says."""

    values: Sequence[str] = ()
    pattern: str | None = None
    what: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Number:
    """A number from ``low`` to ``high`` (either may be open), whole if ``whole``."""

    low: float | None = None
    high: float | None = None
    whole: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Flag:
    """True or false."""

    optional: bool = False


@dataclass(frozen=True)
class Items:
    """An array of at least ``least`` values that keep ``rule``."""

    rule: object = None
    least: int = 0
    what: str = "item"
    optional: bool = False


@dataclass(frozen=True)
class When:
    """Fields that are checked only if the field ``name`` is one of ``values``."""

    name: str
    values: Sequence[str]
    fields: Mapping[str, object]


@dataclass(frozen=True)
class Record:
    """An object whose fields keep their rules; then the conditional ones."""

    fields: Mapping[str, object] = field(default_factory=dict)
    when: Sequence[When] = ()
    optional: bool = False


def issues_of(rule, value: Column, path: str) -> Column:
    """What ``value`` (a VARIANT; SQL null counts as missing) breaks of ``rule``, as ``ISSUE``."""
    return _issues(rule, value, F.lit(path)).cast(ISSUE)


def issues_of_json(rule, json: str, path: str) -> Column:
    """The same for a JSON text; a text that is no JSON, or null, is a missing value."""
    return issues_of(rule, F.try_parse_json(json), path)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _one(bad: Column, path: Column, message: str) -> Column:
    none = F.array().cast(ISSUE)
    return F.when(bad, F.array(F.struct(path.alias("path"), F.lit(message).alias("message"))).cast(ISSUE)).otherwise(none)


def _issues(rule, value: Column, path: Column) -> Column:
    kind = _kind(value)
    if isinstance(rule, Record):
        parts = [_issues(r, _field(value, n), F.concat(path, F.lit(f".{n}"))) for n, r in rule.fields.items()]
        for w in rule.when:
            applies = F.coalesce(F.try_variant_get(value, f"$['{w.name}']", "string").isin(*w.values), F.lit(False))
            parts += [F.when(applies, _issues(r, _field(value, n), F.concat(path, F.lit(f".{n}")))).otherwise(F.array().cast(ISSUE)) for n, r in w.fields.items()]
        wrong = ~F.startswith(kind, F.lit("OBJECT"))
        found = F.when(wrong, _one(F.lit(True), path, "must be an object")).otherwise(F.concat(F.array().cast(ISSUE), *parts))
    elif isinstance(rule, Items):
        items = F.try_variant_get(value, "$", "array<variant>")
        wrong = ~F.startswith(kind, F.lit("ARRAY"))
        each = F.flatten(F.transform(items, lambda x, i: _issues(rule.rule, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))) if rule.rule else F.array().cast(ISSUE)
        few = _one(F.size(items) < rule.least, path, f"must contain at least {rule.least} {rule.what}")
        found = F.when(wrong, _one(F.lit(True), path, "must be an array")).otherwise(F.concat(few, each))
    elif isinstance(rule, Text):
        text = F.try_variant_get(value, "$", "string")
        filled = (kind == "STRING") & (F.btrim(text) != "")
        if rule.values:
            found = _one(~(filled & text.isin(*rule.values)), path, f"must be a supported {rule.what or 'value'}")
        elif rule.pattern:
            found = _one(~(filled & text.rlike(rule.pattern)), path, f"must be {rule.what or 'well formed'}")
        else:
            found = _one(~filled, path, "must be a non-empty string")
    elif isinstance(rule, Number):
        number = F.try_variant_get(value, "$", "double")
        good = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        for test in ([number >= rule.low] if rule.low is not None else []) + ([number <= rule.high] if rule.high is not None else []) + ([number == F.floor(number)] if rule.whole else []):
            good &= F.coalesce(test, F.lit(False))
        span = f" {'' if rule.low is None else f'{rule.low:g}'}..{'' if rule.high is None else f'{rule.high:g}'}" if rule.low is not None or rule.high is not None else ""
        found = _one(~good, path, f"must be {'an integer' if rule.whole else 'a number'}{span}")
    elif isinstance(rule, Flag):
        found = _one(kind != "BOOLEAN", path, "must be true or false")
    else:
        raise TypeError(f"no such rule: {rule!r}")
    return F.when(kind == "VOID", F.array().cast(ISSUE)).otherwise(found) if rule.optional else found
