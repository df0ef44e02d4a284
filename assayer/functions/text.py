"""Display forms of values and extraction from free text."""

from pyspark.sql import Column, functions as F

INVOICE_REFERENCE = "REF (INV-[0-9]{4}-[0-9]{4})"


def extract_reference(text: Column, pattern: str = INVOICE_REFERENCE, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def quote(text: Column) -> Column:
    """Single-quoted unless only single quotes occur inside; line breaks and tabs escaped."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, escape in [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        body = F.replace(body, F.lit(char), F.lit(escape))
    has_single, has_double = text.contains("'"), text.contains('"')
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def display_value(text: Column, quoted: bool = True) -> Column:
    """NULL, or the value; beyond 60 characters the first 57 and an ellipsis."""
    shown = quote(text) if quoted else text
    short = F.when(F.length(shown) > 60, F.concat(F.substring(shown, 1, 57), F.lit("…'"))).otherwise(shown)
    return F.coalesce(short, F.lit("NULL"))


def display_samples(shown: Column, limit: int = 5) -> Column:
    """Comma list of an ARRAY<STRING> of display values, at most `limit`, then how many more."""
    total = F.size(shown)
    more = F.when(total > limit, F.concat(F.lit(", …(+"), (total - limit).cast("string"), F.lit(" more)"))).otherwise("")
    listed = F.concat(F.array_join(F.slice(shown, 1, limit), ", "), more)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit("_(none)_")).otherwise(listed)


def approximate_count(n: Column) -> Column:
    return F.concat(F.lit("~"), F.format_number(n, 0))


def json_body(text: Column) -> Column:
    """The trimmed text if it is braced, else first `{` to last `}`, else the trimmed text."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.nullif(F.regexp_extract(stripped, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(inner, stripped)
