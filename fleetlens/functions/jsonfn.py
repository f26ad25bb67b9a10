"""JSON helpers over text and VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def parse(text: Column) -> Column:
    """Variant, or NULL for text that is not JSON."""
    return F.try_parse_json(text)


def number_at(value: Column, path: str) -> Column:
    """The JSON number at ``path`` as double; a numeric string is not a number."""
    # The first character of its JSON text tells a value's type, and costs less than asking for its schema.
    text = text_at(value, path)
    return F.when(text.rlike(r"^-?\d"), text.try_cast("double"))


def string_at(value: Column, path: str) -> Column:
    is_string = F.startswith(text_at(value, path), F.lit('"'))
    return F.when(is_string, F.try_variant_get(value, path, "string"))


def boolean_at(value: Column, path: str) -> Column:
    text = text_at(value, path)
    return F.when(text == "true", True).when(text == "false", False)


def text_at(value: Column, path: str) -> Column:
    """Canonical JSON text at ``path``: keys sorted, strings quoted, a present null is ``null``."""
    return F.to_json(F.try_variant_get(value, path, "variant"))


def items_of(value: Column) -> Column:
    """The items of a node output: an array's elements, an object's ``items`` array, else the value itself."""
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.try_variant_get(value, "$.items", "array<variant>"),
        F.when(value.isNotNull(), F.array(value)),
    )


def object_text(fields: dict[str, Column]) -> Column:
    """JSON object text with sorted keys and explicit nulls."""
    parts = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
