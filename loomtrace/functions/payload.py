"""Contracts over schemaless JSON payloads, as Arrow UDFs.

Validity is what ``json.loads`` accepts, and changed payloads are written by ``json.dumps``: no
built-in parser agrees with both, so these columns go through Python in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .text import LARGE_CHARS

PARSED = "valid boolean, uuid string, session_id string, has_session boolean, type string, timestamp string, parent_uuid string, raw string, blobs array<struct<file_id:string,content:string>>"


#: Rows that are Python objects at a time. A whole Arrow batch of them takes many times its own size.
STEP = 256


def by_steps(function: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """A column made of lists of values, ``STEP`` rows at a time."""
    n = len(columns[0])
    return pa.concat_arrays([pa.array(function(*[c.slice(i, STEP).to_pylist() for c in columns]), kind) for i in range(0, max(1, n), STEP)])


def _text_or_none(value: Any) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value)


def _message(record: Any) -> dict:
    message = record.get("message") if isinstance(record, dict) else None
    return message if isinstance(message, dict) else {}


def _large_slots(message: dict) -> Iterator[tuple[dict, str]]:
    """Every (holder, key) of a payload that may be moved to the blob store."""
    content = message.get("content")
    if isinstance(content, str):
        yield message, "content"
    for block in content if isinstance(content, list) else ():
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            yield block, "text"
        elif kind == "tool_result":
            inner = block.get("content")
            if isinstance(inner, list):
                yield from ((x, "text") for x in inner if isinstance(x, dict) and x.get("type") == "text")
            else:
                yield block, "content"


def take_blobs(record: dict, threshold: int = LARGE_CHARS) -> list[tuple[str, str]]:
    """Replace large texts by markers, in place; what was taken out."""
    taken = []
    for holder, key in _large_slots(_message(record)):
        text = holder.get(key)
        if isinstance(text, str) and len(text) > threshold:
            name = "file_" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]
            holder[key] = f"[Large Content: {name}] [Tokens: ~{len(text) // 4}]"
            taken.append((name, text))
    return taken


def parse_line(line: str, threshold: int = LARGE_CHARS) -> tuple:
    """One line as the fields of PARSED."""
    try:
        record = json.loads(line)
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return False, None, None, False, None, None, None, line, []
    taken = take_blobs(record, threshold)
    return True, str(record["uuid"]) if record.get("uuid") else None, _text_or_none(record.get("sessionId")), "sessionId" in record, _text_or_none(record.get("type", "")), _text_or_none(record.get("timestamp")), _text_or_none(record.get("parentUuid")), json.dumps(record) if taken else line, [{"file_id": a, "content": b} for a, b in taken]


def parse_lines(threshold: int = LARGE_CHARS) -> Callable:
    """A column of lines to a struct of PARSED."""

    kind = to_arrow_type(StructType.fromDDL(PARSED))

    @F.arrow_udf(PARSED)
    def parsed(lines: pa.Array) -> pa.Array:
        return by_steps(lambda some: [parse_line(x, threshold) for x in some], kind, lines)

    return parsed


def content_text(content: Any) -> str:
    """Plain text of a message's content."""
    if isinstance(content, str):
        return content
    out = []
    for block in content if isinstance(content, list) else ():
        if isinstance(block, dict):
            if isinstance(block.get("text"), str):
                out.append(block["text"])
            elif block.get("type") == "tool_result":
                out.append(content_text(block.get("content")))
            elif block.get("type") == "tool_use":
                out.append(f"[tool_use: {block.get('name', '?')}]")
    return "\n".join(out)


def record_text(raw: str) -> str:
    """Role and text of a record."""
    try:
        message = _message(json.loads(raw))
    except (ValueError, TypeError):
        return ""
    role, text = message.get("role"), content_text(message.get("content"))
    return ": ".join(x for x in (role if isinstance(role, str) else "", text) if x)


def hit_text(raw: str) -> str:
    """What a snippet of a record is cut from: its message's text, in one line."""
    try:
        content = _message(json.loads(raw)).get("content")
    except (ValueError, TypeError):
        return ""
    if isinstance(content, list):
        texts = [next((b[k] for k in ("text", "content") if isinstance(b.get(k), str)), None) for b in content if isinstance(b, dict)]
        content = " ".join(x for x in texts if x is not None)
    return " ".join(content.split()) if isinstance(content, str) else ""


def first_prompt(raw: str) -> str | None:
    """A2: a prompt that is one string, cut to 500 characters."""
    try:
        content = _message(json.loads(raw)).get("content")
    except (ValueError, TypeError):
        return None
    return content[:500] if isinstance(content, str) else None


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def summary_source(raw: str) -> str:
    """What a summariser sees of a record; tool input and output are shortened."""
    content = _message(json.loads(raw)).get("content", "")
    if isinstance(content, str):
        return content
    out = []
    for block in content if isinstance(content, list) else ():
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            out.append(block.get("text", ""))
        elif kind == "tool_use":
            given = block.get("input", {})
            out.append(f"[Tool: {block.get('name', 'unknown')}]\nInput: " + _cut(json.dumps(given) if isinstance(given, dict) else str(given), 500))
        elif kind == "tool_result":
            inner = block.get("content", "")
            texts = [inner] if isinstance(inner, str) else [x.get("text", "") for x in inner if isinstance(x, dict) and x.get("type") == "text"] if isinstance(inner, list) else []
            out += [f"[Tool Result {block.get('tool_use_id', '')}]\n" + _cut(x, 1000) for x in texts]
    return "\n".join(out)


def messages_text(rows: list[tuple[str, str, str]]) -> str:
    """(uuid, type, raw) of several records."""
    lines: list[str] = []
    for uuid, kind, raw in rows:
        try:
            text = summary_source(raw)
        except (ValueError, TypeError):
            text = "[malformed record]"
        lines += [f"[Message {uuid}] ({kind})", *([text] if text else []), ""]
    return "\n".join(lines)


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def fallback_summary(text: str, input_tokens: int) -> str:
    """The longest prefix, with a note if that fits, below the number of tokens."""
    source, target = text.strip(), max(1, int(input_tokens))
    note = f"\n[truncated from {target} tokens]"
    for tail in (note, ""):
        # tokens < target, that is fewer than 4 * target characters (and target above 1)
        room = 4 * target - 1 - len(tail)
        if target > 1 and room > 0 and (kept := source[:room].rstrip()):
            return kept + tail
    return source[:1]


def without_code(text: str) -> str:
    """Fenced code becomes its line breaks, inline code a blank."""
    return re.sub(r"`[^`]*`", " ", re.sub(r"```.*?```", lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL))


def text_udf(function: Callable[[str], str | None]) -> Callable:
    """A string function as an Arrow UDF; null stays null."""

    @F.arrow_udf("string")
    def mapped(texts: pa.Array) -> pa.Array:
        return by_steps(lambda some: [None if x is None else function(x) for x in some], pa.string(), texts)

    return mapped
