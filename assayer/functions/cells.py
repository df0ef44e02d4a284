"""SQL text for one cell of a table. Wide selections are built as text: one call instead of dozens per column."""

from pyspark.sql import types as T


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comparable_text(column: str, data_type: T.DataType) -> str:
    """SQL text that tells two values apart; nested values by their JSON form."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return f"to_json({quoted(column)})"
    return f"hex({quoted(column)})" if isinstance(data_type, T.BinaryType) else f"cast({quoted(column)} as string)"
