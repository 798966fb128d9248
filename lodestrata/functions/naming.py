"""Naming conventions of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The styles in the order in which they are tried, after leading underscores are dropped.
STYLES = (
    ("UPPER_CASE", r"^[A-Z][A-Z0-9]*_[A-Z0-9_]*$"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"),
    ("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"),
    ("camelCase", r"^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*$"),
    ("flat_case", r"^[a-z][a-z0-9]*$"),
    ("kebab-case", r"-"),
)
#: Conventions that need at least two segments, for pattern detection.
SEGMENTED = (
    ("camelCase_function_naming", r"^[a-z]+(?:[A-Z][a-z0-9]*)+$"),
    ("PascalCase_class_naming", r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$"),
    ("snake_case_naming", r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"),
    ("SCREAMING_SNAKE_CASE_constant", r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"),
)
#: Prefixes that names of one kind may share.
PREFIXES = ("get_", "set_", "is_", "has_", "_", "__", "do_", "on_", "handle_")


def naming_style(name: Column) -> Column:
    """The style of a name: UPPER_CASE, PascalCase, snake_case, camelCase, flat_case, kebab-case, mixed, or unknown for
    null and for nothing but underscores."""
    bare = F.regexp_replace(name, "^_+", "")
    style = F.when(name.isNull() | (bare == ""), "unknown")
    for label, pattern in STYLES:
        style = style.when(bare.rlike(pattern), label)
    return style.otherwise("mixed")


def violates(style: Column, expected: Column) -> Column:
    """Whether a style breaks the expected one: unknown never does, flat_case is accepted for snake_case."""
    return (style != expected) & (style != "unknown") & ~((expected == "snake_case") & (style == "flat_case"))


def segmented_convention(name: Column, kind: Column) -> Column:
    """The naming pattern that a symbol of a kind shows, or null."""
    camel, pascal, snake, screaming = (name.rlike(p) for _, p in SEGMENTED)
    labels = [label for label, _ in SEGMENTED]
    return (
        F.when(kind.isin("class", "interface", "struct", "enum", "trait"), F.when(pascal, labels[1]))
        .when(kind.isin("function", "method"), F.when(camel, labels[0]).when(snake, labels[2]))
        .when(kind.isin("constant", "variable"), F.when(screaming, labels[3]).when(snake, labels[2]))
    )
