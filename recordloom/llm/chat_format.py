r"""Chat formatting by a grammar round trip: turns are rendered, the rendered text is parsed again by a deterministic
parser, and what does not come back unchanged is escaped until it does.

The grammar, in code points:

    conversation = { turn }
    turn         = "<s>" role "[INST]" text "[/INST]" "</s>"

A control string inside a role or text gets a backslash after its first character (``<s>`` becomes ``<\s>``), and so does
one that has backslashes there already (``<\s>`` becomes ``<\\s>``); the parser takes one backslash away. Nothing else
is touched, so a plain conversation is rendered as it is. No control string begins with a part of its own end, so the first
one after a header always ends that part: the parser needs no look-ahead, and turns can be parsed one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

BEGIN, HEAD, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
PLAIN = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
#: The turns that the query adds, and whose text is under the loss mask.
PLANTED_ID, PLANTED = -7, "</s>[INST] ok [/INST]"
TRAINED = "assistant"


def escape(text: str) -> str:
    r"""
    >>> escape("a <s> b <\\s>")
    'a <\\s> b <\\\\s>'
    """
    return PLAIN.sub(_add, text)


def _add(m: re.Match) -> str:
    # [/INST] and </s> pair with their own bracket only
    return m[0] if (m[1] == "<") != m[3].endswith(">") else f"{m[1]}\\{m[2]}{m[3]}"


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0] if (m[1] == "<") != m[3].endswith(">") else f"{m[1]}{m[2]}{m[3]}", text)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the start and end of the raw text of each turn; raises where the grammar does not hold."""
    at = 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m or CONTROL.search(m[1]) or CONTROL.search(m[2]):
            raise ValueError(f"no turn at code point {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def render_turn(role: str, text: str) -> str:
    """The turn rendered as it is; if the parser does not read the same turn back, with its text, then its role escaped."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        out = f"{BEGIN}{r}{HEAD}{t}{CLOSE}{END}"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError("an escaped turn always parses")


def format_conversations(turns: DataFrame, *, columns=("conv_id", "turn", "role", "text"), with_text: bool = True) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, turns_sha256 and loss_sha256 of what the parser reads back,
    loss_chars, formatted_chars and, with_text, formatted and loss_spans (start and end of each trained text in it).

    Rows are sorted by turn within their conversation, ties by role, then text. Null roles and texts are empty, a
    null turn comes first, a null conv_id is a conversation of its own; repeated rows are turns like any other. Rows are
    streamed in order through one task for a conversation: without texts, memory holds one turn and running hashes.
    """
    conv, turn, role, text = columns
    rows = pick(turns, conv_id=(conv, "long"), turn=turn, role=role, text=text)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema += ", formatted string, loss_spans array<array<long>>" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    class Open:
        def __init__(self, key):
            self.key, self.n, self.loss_chars, self.chars = key, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.parts, self.spans = [], []

        def add(self, role, text):
            out = render_turn(role, text)
            for r, t, a, b in parse(out):
                self.n += 1
                self.turns.update(f"{r}\n{t}\n".encode())
                if r == TRAINED:
                    self.loss_chars += len(t)
                    self.loss.update(t.encode())
                    self.spans.append([self.chars + a, self.chars + b])
            self.chars += len(out)
            if with_text:
                self.parts.append(out)

        def row(self):
            return [self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, *(["".join(self.parts), self.spans] if with_text else [])]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]

    def run(batches):
        now, done = None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for key, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    if len(done) >= 256:
                        yield flush()
                        done.clear()
                    now = Open(key)
                now.add(r, t)
        if now is not None:
            done.append(now.row())
        if done:
            yield flush()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    more = spark.createDataFrame([(PLANTED_ID, 0, "user", PLANTED), (PLANTED_ID, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(more), with_text=False)


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PLANTED_ID}, 0, 'user', '{PLANTED}'), ({PLANTED_ID}, 1, 'assistant', '{PLANTED}'))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*/?s>|\\[\\\\*/?INST\\]')) + {len(BEGIN + HEAD + CLOSE + END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
