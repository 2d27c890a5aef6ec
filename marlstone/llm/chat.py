"""Chat formatting: layouts are recognised by a schema fingerprint, turned into canonical
turns by a declarative mapping, and written in a template that can be read back exactly.

Layouts. ``fingerprint`` hashes the sorted nested field paths of a record or of a DataFrame's
schema; ``MAPPINGS`` holds, for the paths of each known layout, how to get its turns. Fields
that a layout does not name are ignored (a mapping applies if its paths are all there; the
one with the most paths wins).

Defined results: a null text or role is an empty string; turns are ordered by turn, then role,
then text, nulls first; repeated rows are turns of their own; a null conversation id is one
conversation; an empty table gives no rows. Memory holds one turn at a time: a conversation
is never gathered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that templates in use treat as marks; inside a text they are broken by a backslash.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.?)", re.DOTALL)
NEWLINE = "␊"  # a role's line break, after a backslash
SEGMENT = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """Double each backslash, then break each control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\" + NEWLINE)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", NEWLINE: "\n"}.get(m[1], m[1]), role)


def segment(role: str, text: str, learn: Iterable[str] = ("assistant",)) -> tuple[str, int, int]:
    """A turn as it stands in the template, and the span of it that training learns (0, 0: none)."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head) if role in learn else 0, len(head) + len(body) if role in learn else 0


def read_segment(formatted: str) -> tuple[str, str]:
    """(role, text) of segment()'s string."""
    m = SEGMENT.fullmatch(formatted)
    if not m:
        raise ValueError("not a turn of this template")
    return unescape_role(m[1]), unescape(m[2])


# Layouts

#: Layout: its paths, and how turns come from it: either a list with role and text in it, or fields in order with a role each.
LAYOUTS: dict[str, dict[str, Any]] = {
    "messages": {"paths": ("messages[].content", "messages[].role"), "list": "messages", "role": "role", "text": "content"},
    "conversations": {"paths": ("conversations[].from", "conversations[].value"), "list": "conversations", "role": "from", "text": "value"},
    "turns": {"paths": ("turns[].role", "turns[].text"), "list": "turns", "role": "role", "text": "text"},
    "prompt_completion": {"paths": ("completion", "prompt"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt_response": {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    "instruction": {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction_input": {"paths": ("input", "instruction", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "system_instruction": {"paths": ("instruction", "output", "system"), "fields": (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))},
    "question_answer": {"paths": ("answer", "question"), "fields": (("user", ("question",)), ("assistant", ("answer",)))},
    "rows": {"paths": ("conv_id", "role", "text", "turn"), "rows": ("conv_id", "turn", "role", "text")},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(v["paths"]): (k, v) for k, v in LAYOUTS.items()}


def paths_of(record: Any, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; lists add [] to a path, all their members counting."""
    if isinstance(record, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else str(k)) for k, v in record.items())) if record else ({at} if at else set())
    if isinstance(record, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in record)) if record else {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """As paths_of, for a DataFrame's schema."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


@lru_cache(maxsize=4096)
def layout_for(paths: frozenset[str]) -> tuple[str, dict[str, Any]]:
    """The mapping by fingerprint: of all paths, else of the largest known layout that they include."""
    if exact := MAPPINGS.get(fingerprint(paths)):
        return exact
    known = [(len(v["paths"]), k) for k, v in LAYOUTS.items() if paths >= set(v["paths"])]
    if not known:
        raise ValueError(f"no layout has these fields: {', '.join(sorted(paths))}")
    name = max(known)[1]
    return MAPPINGS[fingerprint(LAYOUTS[name]["paths"])]


def record_turns(record: dict[str, Any]) -> list[tuple[str, str]]:
    """The canonical turns of one record of any layout."""
    _, how = layout_for(frozenset(paths_of(record)))
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if "list" in how:
        return [(ROLES.get(r := text(m.get(how["role"])), r), text(m.get(how["text"]))) for m in record[how["list"]] or []]
    if "rows" in how:
        return [(text(record[how["rows"][2]]), text(record[how["rows"][3]]))]
    return [(role, "\n\n".join(x for f in fields if (x := text(record.get(f))))) for role, fields in how["fields"] if role != "system" or record.get(fields[0])]


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) rows of a DataFrame in any known layout, by its schema's fingerprint."""
    df = df.withColumnRenamed(id_col, "conv_id")
    _, how = layout_for(frozenset(schema_paths(df.schema)))
    key = F.col("conv_id")
    if "rows" in how:
        _, turn, role, text = how["rows"]
        return df.select(key, F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    if "list" in how:
        m = df.select(key, F.posexplode(how["list"]).alias("turn", "_m"))
        role = F.coalesce(*(F.when(F.col(f"_m.{how['role']}") == k, v) for k, v in ROLES.items()), F.col(f"_m.{how['role']}"))
        return m.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col(f"_m.{how['text']}").alias("text"))
    turns = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fields)).alias("text")) for i, (role, fields) in enumerate(how["fields"])]
    return df.select(key, F.explode(F.array(*turns)).alias("_t")).select("conv_id", "_t.*")


# Formatting

def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted turns in order: conv_id, position, formatted, learn_from, learn_to.

    Within a partition, a conversation's rows stand together in order; their formatted
    strings one after the other are the formatted conversation, and the learn spans
    (code points of this turn's string) are its loss mask.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = run
        at = 0
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                at = at + 1 if conv == last else 0
                last = conv
                rows.append((conv, at, *segment(role, text, learn)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", "position", "formatted", "learn_from", "learn_to"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, position long, formatted string, learn_from long, learn_to long")


def digests(formatted: DataFrame) -> DataFrame:
    """Read format_turns' rows back, as they stand: one row for each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = run
        n = loss = chars = 0
        all_turns = learned = hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for b in batches:
            for conv, formatted, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "learn_from", "learn_to")), strict=True):
                if conv != last:
                    if last is not run:
                        done.append((last, n, all_turns.hexdigest(), loss, learned.hexdigest(), chars))
                    last, n, loss, chars, all_turns, learned = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = read_segment(formatted)
                all_turns.update(f"{role}\n{text}\n".encode())
                part = unescape(formatted[a:z])
                learned.update(part.encode())
                n, loss, chars = n + 1, loss + len(part), chars + len(formatted)
            if done:
                yield flush()
        if last is not run:
            done.append((last, n, all_turns.hexdigest(), loss, learned.hexdigest(), chars))
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    def broken(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in CONTROL:
            out = f"replace({out}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return out

    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(CLOSE) + 2} + length({broken("role")}) + length({broken("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""
