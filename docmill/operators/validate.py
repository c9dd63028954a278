"""Validation of documents: rules as columns, findings as one array of structs a row.

A missing required field hides the other rules of its field; null skips every rule but the required one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import OTHER_BLANKS, once, squeeze, strip

ERRORS = ("error", "critical")
#: Marks of wrongly decoded text and the accepted forms of a date.
MOJIBAKE_MARKS = ("Ã©", "Ã¨", "Ãª", "Ã«", "â€")
DATE = r"^(\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2})?|\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z?|\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{1,2}:\d{1,2})?|\d{4}年\d{1,2}月\d{1,2}日( \d{1,2}:\d{1,2}:\d{1,2})?)$"


@dataclass(frozen=True)
class Rule:
    """``broken`` tells from the field's column whether the rule is broken."""

    field: str
    name: str
    broken: Callable[[Column], Column]
    level: str = "error"
    required: bool = False


@dataclass
class Rules:
    """A set of rules that can be added to."""

    rules: list[Rule] = field(default_factory=list)

    def add(self, rule: Rule) -> Rules:
        self.rules.append(rule)
        return self

    def findings(self, columns: list[str], more: list[Column] | None = None) -> Column:
        """array<struct<field, rule, level>> of what is broken; rules on fields that the table lacks count as null."""
        found = []
        for rule in self.rules:
            c = F.col(rule.field) if rule.field in columns else F.lit(None).cast("string")
            needed = any(r.required and r.field == rule.field for r in self.rules)
            broken = rule.broken(c) if rule.required else c.isNotNull() & rule.broken(c)
            if needed and not rule.required:
                broken = broken & ~missing(c)
            found.append(finding(broken, rule.field, rule.name, rule.level))
        return F.array_compact(F.array(*found, *(more or [])))


def finding(broken: Column, of: str, name: str, level: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(of).alias("field"), F.lit(name).alias("rule"), F.lit(level).alias("level")))


def missing(c: Column) -> Column:
    """Null or blank: the search for a character that is no blank ends at the first."""
    return c.isNull() | ~c.rlike(rf"[^ {OTHER_BLANKS}]")


def real_date(c: Column) -> Column:
    day = F.regexp_replace(F.regexp_extract(c, r"^\d{4}\D\d{1,2}\D\d{1,2}", 0), r"[/年月]", "-")
    clock = F.regexp_extract(c, r"(\d{1,2}):(\d{1,2}):(\d{1,2})", 0)
    part = lambda i: F.regexp_extract(c, r"(\d{1,2}):(\d{1,2}):(\d{1,2})", i).try_cast("int")
    fits = (clock == "") | ((part(1) < 24) & (part(2) < 60) & (part(3) < 62))
    return c.rlike(DATE) & day.try_cast("date").isNotNull() & fits


def default_rules() -> Rules:
    out = Rules()
    for rule in (
        Rule("title", "title_required", missing, "error", True),
        Rule("title", "title_length", lambda c: ~F.length(c).between(5, 200)),
        Rule("title", "title_format", lambda c: c.rlike("[<>]")),
        Rule("content", "content_required", missing, "error", True),
        Rule("content", "content_min_length", lambda c: F.length(c) < 50),
        Rule("content", "content_max_length", lambda c: F.length(c) > 100_000, "warning"),
        Rule("author", "author_length", lambda c: F.length(c) > 100, "warning"),
        Rule("author", "author_format", lambda c: c.rlike("[<>]"), "warning"),
        Rule("url", "url_format", lambda c: ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")),
        Rule("publish_date", "date_format", lambda c: ~real_date(c)),
    ):
        out.add(rule)
    return out


def similar_texts(a: str | None, b: str | None, bound: float = 0.8) -> bool:
    """Sequence similarity over the bound, behind the upper bounds that lengths and letters give."""
    from difflib import SequenceMatcher

    if not a or not b or 2 * min(len(a), len(b)) <= bound * (len(a) + len(b)):
        return False
    if a.lower() == b.lower():
        return True
    match = SequenceMatcher(None, a.lower(), b.lower())
    return match.quick_ratio() > bound and match.ratio() > bound


def too_similar(title: Column, content: Column) -> Column:
    @F.pandas_udf("boolean")
    def similar(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([similar_texts(a, b) for a, b in zip(titles, contents)], dtype=bool)

    return similar(title, content)


def repetition(c: Column) -> Column:
    """One minus the share of distinct words."""
    words = F.filter(F.split(squeeze(F.lower(c)), " "), lambda w: w != "")
    return once(words, lambda w: 1 - F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)))


def document_findings(columns: list[str], asof: Column | None = None) -> list[Column]:
    """Rules over a whole document: quality of the content, agreement with the title, age, number of tags."""
    get = lambda name, kind="string": F.col(name) if name in columns else F.lit(None).cast(kind)
    title, content = F.nullif(get("title"), F.lit("")), F.nullif(get("content"), F.lit(""))
    near = 2 * F.least(F.length(title), F.length(content)) > 0.8 * (F.length(title) + F.length(content))
    marks = F.lit(False)
    for mark in MOJIBAKE_MARKS:
        marks = marks | F.contains(content, F.lit(mark))
    out = [
        finding(content.rlike("<[^>]+>"), "content", "html_left", "warning"),
        finding(repetition(content) > 0.5, "content", "repetition", "warning"),
        finding(marks, "content", "encoding", "warning"),
        finding(F.startswith(content, title), "content", "starts_with_title", "info"),
        finding(near & too_similar(F.when(near, title), F.when(near, content)), "title", "title_like_content", "warning"),
    ]
    if "publish_date" in columns and asof is not None:
        day = F.coalesce(*(F.try_to_timestamp(F.col("publish_date"), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")))
        out += [finding(day > asof, "publish_date", "future_date", "warning"), finding(F.date_diff(asof, day) > 3650, "publish_date", "old_date", "info")]
    if "tags" in columns:
        bad = lambda t: t.isNull() | (strip(t) == "") | (F.length(t) > 50) | t.rlike(r"[<>\"'\n\r\t]")
        out += [finding(F.exists("tags", bad), "tags", "tags_format", "error"), finding(F.size("tags") > 20, "tags", "many_tags", "warning")]
    return out


#: Fields that a document has to have, may have, and the type of each.
REQUIRED_FIELDS = ("title", "content", "source")
OPTIONAL_FIELDS = ("author", "publish_date", "tags", "summary", "url")
FIELD_TYPES = {"title": "string", "content": "string", "author": "string", "url": "string", "publish_date": "string", "summary": "string", "source": "string", "tags": "array"}


def schema_findings(df: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS, optional: tuple[str, ...] = OPTIONAL_FIELDS, types: dict[str, str] = FIELD_TYPES) -> DataFrame:
    """``df`` with ``schema_findings``: required fields that are missing, null or blank, fields of the wrong type (errors) and unknown fields (warnings).

    A table has one type a column, so unknown fields and wrong types are the same for every row and are found on the schema alone.
    """
    held = {f.name: f.dataType.typeName() for f in df.schema.fields}
    always = F.lit(True)
    found = [finding(always, name, "missing_field", "error") for name in required if name not in held]
    for name in (n for n in required if n in held):
        empty = strip(F.col(name)) == "" if held[name] == "string" else F.lit(False)
        found.append(finding(F.col(name).isNull(), name, "missing_field", "error"))
        found.append(finding(empty, name, "empty_field", "error"))
    found += [finding(always, name, "unknown_field", "warning") for name in held if name not in (*required, *optional)]
    found += [finding(F.col(f"`{name}`").isNotNull(), name, "field_type", "error") for name, kind in types.items() if name in held and held[name] != kind]
    return df.withColumn("schema_findings", F.array_compact(F.array(*found)))


def length_rule(of: str, least: int = 0, most: int | None = None, level: str = "error", kind: str = "string") -> Rule:
    """A rule on the length of a string, or with ``kind`` array on the number of elements."""
    size = F.size if kind == "array" else F.length
    return Rule(of, f"{of}_length", lambda c: (size(c) < least) | (F.lit(False) if most is None else size(c) > most), level)


def match_rule(of: str, pattern: str, level: str = "error") -> Rule:
    """A rule that a string matches a pattern from its start."""
    return Rule(of, f"{of}_format", lambda c: ~c.rlike(rf"\A(?:{pattern})"), level)


def message(finding: Column) -> Column:
    """A finding as one line of text."""
    return F.format_string("[%s] %s: %s", F.upper(finding["level"]), finding["field"], F.replace(finding["rule"], F.lit("_"), F.lit(" ")))


def validate(df: DataFrame, rules: Rules | None = None, asof: Column | None = None) -> DataFrame:
    """``df`` with ``findings``, their counts by severity and ``is_valid``."""
    out = df.withColumn("findings", (rules or default_rules()).findings(df.columns, document_findings(df.columns, asof)))
    count = lambda levels: F.size(F.filter("findings", lambda f: f["level"].isin(*levels)))
    return out.withColumns({"n_errors": count(ERRORS), "n_warnings": count(("warning",)), "n_infos": count(("info",)), "is_valid": count(ERRORS) == 0})


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row: totals, rates, and the five fields with most findings. Every document is validated once: its first finding, or the lack of any, stands for it in the totals."""
    each = validated.select("is_valid", "n_errors", "n_warnings", "n_infos", F.posexplode_outer("findings.field").alias("pos", "field"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    own = lambda c: F.sum(F.when(first, F.col(c)).otherwise(0))
    fields = each.groupBy("field").agg(
        F.count("pos").alias("n"), F.count_if(first).alias("total"), F.count_if(first & F.col("is_valid")).alias("valid"),
        own("n_errors").alias("errors"), own("n_warnings").alias("warnings"), own("n_infos").alias("infos"),
    )
    most = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct((-F.col("n")).alias("n"), "field"))))
    totals = fields.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "valid", "errors", "warnings", "infos")), F.array_join(F.transform(F.slice(most, 1, 5), lambda s: s["field"]), ",").alias("top_fields"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return totals.select("total", "valid", "errors", "warnings", "infos", rate("valid").alias("validity_rate"), rate("errors").alias("errors_per_document"), "top_fields")
