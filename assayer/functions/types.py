"""Type normalisation: by name for foreign warehouses, by structure for Spark schemas."""

from pyspark.sql import Column, functions as F, types as T

from assayer.vocab import TYPE_SUBSTRINGS


def normalize_native(native: Column) -> Column:
    """First entry with any substring inside the lower-cased name wins, else 'unknown'."""
    text = F.lower(F.trim(native))
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, substrings in TYPE_SUBSTRINGS:
        result = result.when(text.rlike("|".join(substrings)), name)
    return result.otherwise("unknown")


def normalize_spark(data_type: T.DataType) -> str:
    """Spark's own names (`int`, `map<string,bigint>`) mislead a substring rule, so look at the class."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.FractionalType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
        return "json"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "unknown"
