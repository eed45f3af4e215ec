"""Chat formatting by prefix-target expansion (operator 6).

Every assistant turn is exploded into an example of its own: ``context`` is the
rendering of all turns before it and of the reply's opening mark, ``target`` the
reply, and only the target is trainable. The turns after a conversation's last
reply (all of them, where there is none) make a row without a target, so that
nothing of a conversation is lost.

Whole contexts grow with the square of a conversation's turns, which is what the
expansion asks for; a task holds one conversation's rendering at a time and
streams its examples.

Template: ``[INST]role[:]text`` for a turn of any role but assistant,
``[/INST]text</s>`` for a reply. Control strings in roles and texts are broken
by a backslash after their first character and backslashes are doubled, which
``unescape`` undoes. The loss mask covers exactly the escaped reply text.

Edge cases: null text or role is empty; rows with a null conv_id are one
conversation; turns are ordered by turn (null first), then role and text, and
repeated rows stay; a conversation without a reply yields no example, but its
row without a target; an empty table gives an empty result. Other columns are
not part of the format.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read_table

USER, ROLE_END, REPLY, END = "[INST]", "[:]", "[/INST]", "</s>"
CONTROL = re.compile(r"\[INST\]|\[:\]|\[/INST\]|</s>|<s>")
_ESCAPED = re.compile(r"\\(\\?)", re.S)
_TURN = re.compile(r"\[INST\]((?:(?!\[:\]).)*)\[:\]((?:(?!\[INST\]|\[/INST\]).)*)|\[/INST\]((?:(?!</s>).)*)</s>", re.S)

_EXAMPLE = "conv_id {id}, example long, context string, target string, closing string, target_start long, target_end long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows in order, each with whether it begins another conversation."""
    last = object()
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv_id"] != last, row
            last = row["conv_id"]


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row.values() if isinstance(v, str))
        if chars > size or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(first: pa.DataType, **fields: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", first), *fields.items()])


def _peek(batches: Iterator[pa.RecordBatch]):
    """The type of the conversations' ids, then the batches."""
    first = next(batches, None)
    yield None if first is None else first.schema.field("conv_id").type
    if first is not None:
        yield first
        yield from batches


def render(role: str | None, text: str | None) -> str:
    """One turn; a reply is ``REPLY``, its escaped text and ``END``."""
    role, text = role or "", escape(text or "")
    return REPLY + text + END if role == "assistant" else USER + escape(role) + ROLE_END + text


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = _peek(batches)
    kind = next(batches)
    if kind is None:
        return
    schema = _schema(kind, example=pa.int64(), context=pa.string(), target=pa.string(), closing=pa.string(), target_start=pa.int64(), target_end=pa.int64())

    def rows() -> Iterator[dict]:
        conv, example, before, open_turns = None, 0, "", False

        def rest() -> dict:
            return {"conv_id": conv, "example": None, "context": before, "target": None, "closing": "", "target_start": None, "target_end": None}

        for new, row in _runs(batches):
            if new:
                if open_turns:
                    yield rest()
                conv, example, before = row["conv_id"], 0, ""
            turn = render(row["role"], row["text"])
            open_turns = row["role"] != "assistant"
            if not open_turns:
                context, target = before + REPLY, turn[len(REPLY) : len(turn) - len(END)]
                yield {"conv_id": conv, "example": example, "context": context, "target": target, "closing": END, "target_start": len(context), "target_end": len(context) + len(target)}
                example += 1
            before += turn
        if open_turns:
            yield rest()

    yield from _in_batches(rows(), schema)


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (0, 1, ...), its whole context,
    its target, what closes it, and the loss mask [target_start, target_end) in
    characters of context + target + closing. One more row, without example and
    target, for a conversation that does not end in a reply."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(_expand, _EXAMPLE.format(id=kind))


def parse_turns(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering of whole turns."""
    out, at = [], 0
    for found in _TURN.finditer(rendered):
        if found.start() != at:
            break
        at = found.end()
        out.append(("assistant", unescape(found[3])) if found[3] is not None else (unescape(found[1]), unescape(found[2])))
    if at != len(rendered):
        raise ValueError(f"no turn begins at character {at}")
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = _peek(batches)
    kind = next(batches)
    if kind is None:
        return
    schema = _schema(kind, n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(), formatted_chars=pa.int64())

    def rows() -> Iterator[dict]:
        state = None
        for new, row in _runs(batches):
            if new:
                if state:
                    yield _close(state)
                state = {"conv_id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "whole": ""}
            whole = row["context"] + (row["target"] or "") + row["closing"]
            if not whole.startswith(state["whole"]):
                raise ValueError(f"an example of conversation {row['conv_id']} does not begin with the one before it")
            for role, text in parse_turns(whole[len(state["whole"]) :]):
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["n"] += 1
            if row["target_start"] is not None:
                loss = unescape(whole[row["target_start"] : row["target_end"]])
                state["loss"].update(loss.encode())
                state["chars"] += len(loss)
            state["whole"] = whole
        if state:
            yield _close(state)

    yield from _in_batches(rows(), schema)


def _close(state: dict) -> dict:
    return {"conv_id": state["conv_id"], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": len(state["whole"])}


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, read back from ``examples``: every context has to begin
    with the whole example before it, turns are parsed from what it adds, and the
    loss is what the masks cover. Relies on the order that ``examples`` leaves
    within partitions."""
    kind = found.schema["conv_id"].dataType.simpleString()
    return found.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], table.schema)
    return digests(examples(table.union(extra)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(regexp_replace(text, '\[INST\]|\[:\]|\[/INST\]|</s>|<s>', '\0#', 'g')) - length(text) AS text_chars,
    length(role) + length(role) - length(replace(role, '\', '')) + length(regexp_replace(role, '\[INST\]|\[:\]|\[/INST\]|</s>|<s>', '\0#', 'g')) - length(role) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN 11 + text_chars ELSE 9 + role_chars + text_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
