"""Chat formatting with a grammar round trip (operator 9).

A conversation is the concatenation of its turns, in order of turn (null first; ties by role, then text):

    system     <<SYS>>\\n TEXT \\n<</SYS>>\\n          user   [INST]␣ TEXT ␣[/INST]
    assistant  <s> TEXT </s>                         other  [ROLE "name"]␣ TEXT ␣[/ROLE]

(␣ is one space; the blanks around TEXT are for reading only.) The parser is deterministic: an opening
mark, TEXT up to the first closing mark of that kind, and so on; a control string inside TEXT is an
error. A control string is escaped by a backslash after its first character, and one that already has
backslashes there gets one more, so unescaping takes exactly one away.

Each turn is rendered as it is, parsed again and compared with its source; if the parser fails or finds
something else, the conflicting strings are escaped and the turn is parsed again. The loss mask is the
span of TEXT of each assistant turn, in code points of the formatted conversation. Reading back parses the
conversation as one text, whatever pieces it is stored in: what ends inside a turn is carried on to the next piece.

Null texts are empty; a null role is the role "". Repeated rows are turns of their own; rows with a null
id form one conversation. An empty table gives an empty one. Columns other than the four are not read.
Conversations are streamed in sorted order, a turn at a time, so one that holds a third of all rows needs
no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col
from figshelf.sources.storage import new_folder

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER, OTHER_END = "[ROLE ", " [/ROLE]"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|ROLE |/ROLE\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
    return f"{OTHER}{name}] ", OTHER_END


class Unfinished(ValueError):
    """The text ends inside a turn: with more of it there may be no error."""


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """The turn that begins at `at`: its role, begin and end of its TEXT, and where the next one begins."""
    if text.startswith(OTHER, at):
        try:
            role, end = json.JSONDecoder().raw_decode(text, at + len(OTHER))
        except ValueError:
            raise ValueError(f"no role at {at}") if "] " in text[at:] else Unfinished(f"no end of a role at {at}") from None
        if len(text) < end + 2:
            raise Unfinished(f"no end of a role at {at}")
        if not isinstance(role, str) or not text.startswith("] ", end):
            raise ValueError(f"no role at {at}")
        begin, close = end + 2, OTHER_END
    else:
        role = next((r for r, (opening, _) in MARKS.items() if text.startswith(opening, at)), None)
        if role is None:
            rest = text[at:]
            raise (Unfinished if any(m.startswith(rest) for m in (OTHER, *(o for o, _ in MARKS.values()))) else ValueError)(f"no turn at {at}")
        begin, close = at + len(MARKS[role][0]), MARKS[role][1]
    end = text.find(close, begin)
    if end < 0:
        raise Unfinished(f"a turn that begins at {at} has no end")
    if any(not m[2] for m in CONTROL.finditer(text, begin, end)):
        raise ValueError(f"a control string stands in the turn at {at}")
    return role, begin, end, end + len(close)


def parse(text: str) -> list[tuple[str, str]]:
    """All turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        role, begin, end, at = parse_turn(text, at)
        turns.append((role, unescape(text[begin:end])))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back into (role, text), and begin and end of its TEXT."""
    opening, closing = marks(role)
    for content in (text, escape(text)):
        made = opening + content + closing
        try:
            if parse(made) == [(role, text)]:
                return made, len(opening), len(opening) + len(content)
        except ValueError:
            pass
    raise AssertionError("an escaped turn must parse back")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, seq, formatted, begin, loss_begin, loss_end): the conversation's text, turn by turn.

    A conversation's text is its `formatted` in order of seq; begin counts the code points before.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select(col(id_col).alias("conv"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at = object(), 0, 0
        for batch in batches:
            made = {"seq": [], "formatted": [], "begin": [], "loss_begin": [], "loss_end": []}
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != now:
                    now, seq, at = conv, 0, 0
                formatted, begin, end = render_turn(role, text)
                loss = role == "assistant"
                for name, value in zip(made, (seq, formatted, at, at + begin if loss else None, at + end if loss else None)):
                    made[name].append(value)
                seq, at = seq + 1, at + len(formatted)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string() if k == "formatted" else pa.int64()) for k, x in made.items())], ["conv", *made])

    return ordered.mapInArrow(render, f"conv {rows.dtypes[0][1]}, seq long, formatted string, begin long, loss_begin long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text and loss mask alone, what the parser recovers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> dict:
            n, turns, chars, loss, size, rest = state
            if rest:
                raise ValueError(f"conversation {now} ends inside a turn")
            return {"conv": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        schema = None
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            done = []
            for conv, text, begin, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if state is None or conv != now:
                    if state:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                whole, at = state[5] + text, 0
                while at < len(whole):
                    try:
                        role, first, last, after = parse_turn(whole, at)
                    except Unfinished:  # the next piece may go on with it
                        break
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(whole[first:last])}\n".encode())
                    at = after
                state[5] = whole[at:]
                if a is not None:
                    masked = unescape(text[a - begin : b - begin])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema)

    ordered = formatted.select("conv", "seq", "formatted", "begin", "loss_begin", "loss_end").repartition("conv").sortWithinPartitions("conv", "seq")
    return ordered.mapInArrow(read, f"conv {formatted.dtypes[0][1]}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    out = new_folder(spark, "chat")
    format_conversations(turns.unionByName(extra)).write.parquet(out)
    return read_back(spark.read.parquet(out)).withColumnRenamed("conv", "conv_id")


OP9_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 END
    + len(regexp_extract_all(text, '[<\\[]\\\\*(/?s>|</?SYS>>|/?INST\\]|ROLE |/ROLE\\])'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
