"""String contracts as column expressions (X1-X4, X6, X13, X14, X17, X26, X27, X34) and the tokeniser of BM25."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the blob contract.
LARGE_CHARS = 100_000
MARKER = r"\[Large Content: (file_[0-9a-f]{16})\] \[Tokens: ~\d+\]"
FILE_ID = r"file_[0-9a-f]{16}"


def blob_id(content: Column) -> Column:
    """X1."""
    return F.concat(F.lit("file_"), F.substring(F.sha2(content, 256), 1, 16))


def is_large(content: Column, threshold: int = LARGE_CHARS) -> Column:
    """More code points than the threshold."""
    return F.length(content) > threshold


def blob_path(file_id: Column) -> Column:
    """Two-digit shard, then the id."""
    return F.concat(F.substring(file_id, 6, 2), F.lit("/"), file_id)


def blob_marker(content: Column) -> Column:
    """X4."""
    return F.concat(F.lit("[Large Content: "), blob_id(content), F.lit("] [Tokens: ~"), F.floor(F.length(content) / 4).cast("string"), F.lit("]"))


def blob_markers(text: Column) -> Column:
    """Ids in order of their markers."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))


def summary_id(content: Column, created_ms: Column) -> Column:
    """X13."""
    return F.concat(F.lit("sum_"), F.substring(F.sha2(F.concat(content, created_ms.cast("string")), 256), 1, 16))


def file_ids(text: Column) -> Column:
    """Distinct, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_ID), F.lit(0))))


def accepts(output: Column, input_tokens: Column) -> Column:
    """Something is left, and it is shorter than what went in."""
    trimmed = F.regexp_replace(output, r"^\s+|\s+$", "")
    return (trimmed != "") & (input_tokens > 1) & (F.greatest(F.lit(1), F.floor(F.length(trimmed) / 4)) < input_tokens)


def snippet(text: Column, chars: int = 240) -> Column:
    """X26."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def injection_line(tier: Column, session_id: Column, score: Column, superseded: Column, snip: Column) -> Column:
    """One line of an injected hit list; hits of records are named after their session."""
    shown = F.coalesce(F.concat(F.lit(" "), F.format_string("%.2f", score)), F.lit(""))
    kind = F.when(tier == "summary", "summary").otherwise("session")
    return F.concat(F.lit("- ("), kind, F.lit(" "), F.substring(F.coalesce(session_id, F.lit("")), 1, 8), shown, F.when(superseded, " [superseded]").otherwise(""), F.lit(") "), snip)


def injection_is_known_good(event: Column, source: Column) -> Column:
    """A prompt, or a session start for a trusted reason."""
    return (event == "UserPromptSubmit") | source.isin("resume", "clear", "compact")


def timestamp_text(moment: Column) -> Column:
    """Date and time, with six digits of the second's fraction unless it is zero; null stays null."""
    whole = F.date_trunc("second", moment) == moment
    return F.when(whole, F.date_format(moment, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def tokens(text: Column, unicode: bool = False) -> Column:
    """Lower-case words of ASCII letters and digits, or of all letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"), lambda t: t != "")


def prefixed(column: Column, prefix: str, wildcards: bool = False) -> Column:
    """begins with the prefix; with wildcards its % and _ match as in LIKE."""
    return column.like(prefix + "%") if wildcards else column.startswith(prefix)
