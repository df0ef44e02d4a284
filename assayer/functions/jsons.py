"""JSON in and out of text columns."""

from pyspark.sql import Column, functions as F


def is_json_container(text: Column) -> Column:
    """True for an object or array; bare scalars such as `12` do not count."""
    return F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull()


def encode_samples(values: Column) -> Column:
    """JSON array text with NULL elements kept; no values at all give NULL."""
    return F.when(F.size(values) > 0, F.to_json(values, {"ignoreNullFields": "false"}))
