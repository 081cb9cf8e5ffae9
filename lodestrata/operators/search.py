"""The search language: qualifiers to column expressions, and building a search string.

    language:Python stars:>=10 created:2020-01-01..2021-12-31 topic:cli fork:false sort:stars

Blanks mean AND. A leading ``-`` negates. Numbers and days take ``>=n  >n  <=n  <n  n  a..b
a..*  *..b``; days are whole and inclusive. What names no known qualifier is an error: its
meaning would be a guess.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions.jsonlist import json_to_list
from lodestrata.functions.scalars import lower_or_empty, utc_date

_TERM = re.compile(r'\s*(-?)([A-Za-z_]+):("([^"]*)"|\S*)(?=\s|$)')
#: Qualifiers, the columns they read, and how values are compared.
REPOSITORY = {
    "language": ("primary_language", "word"), "stars": ("stars", "number"), "forks": ("forks", "number"), "pushed": ("pushed_at", "day"), "created": ("created_at", "day"),
    "updated": ("updated_at", "day"), "size": ("disk_usage_kb", "number"), "license": ("license_key", "word"), "archived": ("is_archived", "flag"), "mirror": ("is_mirror", "flag"),
    "template": ("is_template", "flag"), "topic": ("topics", "member"), "fork": ("is_fork", "flag"), "user": ("owner_login", "word"), "org": ("owner_login", "word"),
    "location": ("owner_location", "part"), "type": ("owner_type", "kind"),
}
ACCOUNT = {"location": ("owner_location", "part"), "type": ("owner_type", "kind"), "created": ("owner_created_at", "day"), "followers": ("owner_followers", "number"), "user": ("owner_login", "word")}
#: What ``type:`` may name, and what ``sort:`` sorts by, largest first.
KINDS = {"user": "User", "org": "Organization"}
SORTS = {"stars": "stars", "forks": "forks", "updated": "updated_at", "followers": "owner_followers", "joined": "owner_created_at"}


class SearchError(ValueError):
    """A search string that cannot be understood."""


@dataclass(frozen=True)
class Term:
    name: str
    value: str
    negated: bool = False

    def __str__(self) -> str:
        quoted = f'"{self.value}"' if re.search(r"\s", self.value) or not self.value else self.value
        return f"{'-' * self.negated}{self.name}:{quoted}"


@dataclass(frozen=True)
class Search:
    terms: tuple[Term, ...] = ()
    sort: str | None = None
    text: str = field(default="", compare=False)

    def __str__(self) -> str:
        return " ".join([*map(str, self.terms), *([f"sort:{self.sort}"] if self.sort else [])])


def parse(text: str) -> Search:
    terms, sort, at = [], None, 0
    while text[at:].strip():
        m = _TERM.match(text, at)
        if not m:
            raise SearchError(f"no qualifier: {text[at:].strip().split()[0]!r}")
        name, value = m.group(2).lower(), m.group(4) if m.group(4) is not None else m.group(3)
        if name == "sort":
            if value not in SORTS:
                raise SearchError(f"cannot sort by {value!r}")
            sort = value
        else:
            terms.append(Term(name, value, bool(m.group(1))))
        at = m.end()
    return Search(tuple(terms), sort, text)


def _bounds(value: str, of) -> list[tuple[str, object]]:
    """Comparisons (operator, bound) that a number or day must meet."""
    m = re.fullmatch(r"(>=|<=|>|<|=)(.+)", value)
    if m:
        return [(m.group(1), of(m.group(2)))]
    if ".." in value:
        a, b = value.split("..", 1)
        return [(op, of(x)) for op, x in ((">=", a), ("<=", b)) if x not in ("", "*")]
    return [("=", of(value))]


def _number(x: str) -> int:
    if not re.fullmatch(r"-?\d+", x):
        raise SearchError(f"no number: {x!r}")
    return int(x)


def _day(x: str) -> date:
    try:
        return date.fromisoformat(x[:10])
    except ValueError:
        raise SearchError(f"no day: {x!r}") from None


def _word_range(c: Column, v: str) -> Column | None:
    """Between what bounds every spelling of an ASCII word in any case lies, by code point; a comparison that reaches the files.

    The Kelvin sign is the only other character whose lower case is an ASCII letter.
    """
    return (c >= v.upper()) & (c <= v.lower().replace("k", "\u212a")) if v and v.isascii() else None


def _year_range(c: Column, bounds: list[tuple[str, object]]) -> list[Column]:
    """Bounds on the text of an ISO time, which begins with its year, from bounds on its day; a day's room for time zones."""
    day = timedelta(days=1)
    out = []
    for op, b in bounds:
        if op in (">=", ">", "=") and b > date(1001, 1, 1):
            out.append(c >= f"{(b - day).year:04d}")
        if op in ("<=", "<", "=") and b < date(9998, 1, 1):
            out.append(c < f"{(b + day).year + 1:04d}")
    return out


_COMPARE = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__}


def _condition(t: Term, fields: dict, kinds: dict[str, str]) -> Column:
    if t.name not in fields:
        raise SearchError(f"unknown qualifier: {t.name}")
    name, how = fields[t.name]
    if name not in kinds:
        raise SearchError(f"{t.name}: needs a column {name}, which the table does not have")
    c, v = F.col(name), t.value
    if how == "word":
        out = lower_or_empty(c) == v.lower()
        near = _word_range(c, v)
        out = out if near is None or t.negated else near & out
    elif how == "part":
        out = contains(c, v)
    elif how == "flag":
        if v.lower() not in ("true", "false"):
            raise SearchError(f"{t.name}: takes true or false")
        out = c == F.lit(v.lower() == "true")
    elif how == "kind":
        if v.lower() not in KINDS:
            raise SearchError(f"type: takes {' or '.join(KINDS)}")
        out = c == KINDS[v.lower()]
    elif how == "member":
        items = c if kinds[name].startswith("array") else json_to_list(c)
        out = F.exists(items, lambda x: F.lower(F.trim(x)) == v.lower())
        out = out if t.negated else c.isNotNull() & out
    else:
        of, x = (_number, c) if how == "number" else (_day, utc_date(c))
        bounds = _bounds(v, of)
        near = [] if how == "number" or t.negated else _year_range(c, bounds)
        out = reduce(Column.__and__, [*near, *(_COMPARE[op](x, F.lit(b)) for op, b in bounds)], F.lit(True))
    # a plain comparison reaches the files; only a negated term has to settle nulls itself
    return ~F.coalesce(out, F.lit(False)) if t.negated else out


def condition(search: Search | str, df: DataFrame, fields: dict = REPOSITORY) -> Column:
    """The conjunction of a search's terms over the columns of ``df``. A null value meets no term: the condition is then null or false."""
    s = parse(search) if isinstance(search, str) else search
    return reduce(Column.__and__, (_condition(t, fields, dict(df.dtypes)) for t in s.terms), F.lit(True))


def search(df: DataFrame, text: Search | str, limit: int | None = None, tie: str = "nwo", fields: dict = REPOSITORY) -> DataFrame:
    """Rows that meet the search. Its sort holds with a limit; ties go by ``tie``, then by all other columns."""
    s = parse(text) if isinstance(text, str) else text
    out = df.where(condition(s, df, fields))
    order = ([F.desc_nulls_last(SORTS[s.sort])] if s.sort else []) + total_order(df, [tie])
    if limit is not None:
        return out.orderBy(*order).limit(limit)
    return out.orderBy(*order) if s.sort else out


def total_order(df: DataFrame, first: list[str]) -> list[Column]:
    """``first``, then all other columns that have an order: rows that tie are equal in all of these."""
    return [F.asc(c) for c in [*first, *(n for n, t in df.dtypes if n not in first and not t.startswith("map"))]]


def contains(c: Column | str, needle: str | None) -> Column:
    """Whether the text holds the needle, ignoring case; null is empty text, an empty needle is always held."""
    if not needle:
        return F.lit(True)
    return F.contains(lower_or_empty(c), F.lit(needle.lower()))


def matches(c: Column | str, pattern: str) -> Column:
    """Whether the text matches a regular expression somewhere, ignoring case; null does not."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(f"(?i){pattern}"), F.lit(False))


def build(language: str | None = None, min_stars: int = 1, custom: str | None = None) -> str:
    """A search string. A custom one only gets a floor of stars unless it speaks of stars itself;
    otherwise language (if any), floor, and sorting by stars."""
    if custom:
        return custom if "stars:" in custom else f"{custom} stars:>={min_stars}"
    return " ".join([*([f"language:{language}"] if language else []), f"stars:>={min_stars}", "sort:stars"])


def build_column(language: Column, min_stars: Column, custom: Column) -> Column:
    """``build`` for columns; null and empty parts are absent."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    floor = F.concat(F.lit("stars:>="), min_stars.cast("string"))
    own = F.when(F.contains(custom, F.lit("stars:")), custom).otherwise(F.concat_ws(" ", custom, floor))
    made = F.concat_ws(" ", F.when(has(language), F.concat(F.lit("language:"), language)), floor, F.lit("sort:stars"))
    return F.when(has(custom), own).otherwise(made)
