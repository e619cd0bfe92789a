"""Chat formatting: a declarative template, a state machine over roles, and segments with loss flags."""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.words import small_batches


@dataclass(frozen=True)
class Template:
    """How turns are marked, whose texts count for the loss, and which role may follow which.

    Inside texts and role names, a character that could begin a mark becomes a backslash and a letter, and a backslash becomes
    two; so no mark stands inside a text, and the text can be read back.
    """

    head: str = "### "
    after_role: str = ":\n"
    end: str = "</turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})

    @property
    def codes(self) -> dict[str, str]:
        """Guarded characters and their letters, the backslash first."""
        return {"\\": "\\"} | {mark[0]: letter for letter, mark in (("r", self.after_role), ("e", self.end), ("h", self.head))}

    def escape(self, text: str) -> str:
        for c, letter in self.codes.items():
            text = text.replace(c, "\\" + letter)
        return text

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        plain = {letter: c for c, letter in self.codes.items()}
        return re.sub(r"\\(.)", lambda m: plain[m[1]], text)

    def role_name(self, role: str) -> str:
        """Known roles have names; any other stands after an equals sign."""
        return self.names.get(role) or "=" + self.escape(role)

    def role_of(self, name: str) -> str:
        known = {v: k for k, v in self.names.items()}
        return known[name] if name in known else self.unescape(name[1:])


SEGMENTS = "conv_id {}, turn_no bigint, part int, text string, loss boolean, error string"


def _turns(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    conv, number, state, started = None, 0, "", False
    for batch in batches:
        ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for conv_id, role, text in zip(ids, roles, texts, strict=True):
            if not started or conv_id != conv:
                conv, number, state, started = conv_id, 0, "", True
            role = role or ""
            error = None
            if role not in template.names:
                error = "unknown role"
            elif role not in template.follows.get(state, ()):
                error = f"{role} after {state or 'the start'}"
            else:
                state = role
            rows += [
                (conv_id, number, 0, template.head + template.role_name(role) + template.after_role, False, error),
                (conv_id, number, 1, template.escape(text or ""), role in template.loss, None),
                (conv_id, number, 2, template.end, False, None),
            ]
            number += 1
        if rows:
            kinds = [batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "part", "text", "loss", "error"])


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, part, text, loss, error: three segments for each turn, in order within their partition.

    Rows are dealt by conversation and ordered by turn; the state machine streams over them and holds one turn at a time, so a
    conversation may be of any length. A turn that may not follow sets `error` on its head, is written all the same and
    leaves the state as it was. The concatenated texts of a conversation are its training text; `loss` marks whose text counts.

    Null role and text count as empty; roles the template does not know are kept under their own name, as errors. Rows with
    equal turns are ordered by role and text; repeated rows are turns of their own. A null conv_id is a conversation.
    Empty table: no rows; other columns are not read.
    """
    template = template or Template()
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda b: _turns(b, template), SEGMENTS.format(conversations.schema["conv_id"].dataType.simpleString()))


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    current, turns, loss, counts, row = None, None, None, None, []
    name, kind = "", None

    def close() -> tuple:
        return current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_errors"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kind = batch.column(0).type
        for conv_id, part, text, under_loss, error in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if counts is None or conv_id != current:
                if counts is not None:
                    row.append(close())
                current, turns, loss, counts = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            counts[2] += len(text)
            counts[3] += error is not None
            if part == 0:
                assert text.startswith(template.head) and text.endswith(template.after_role), text
                name = text[len(template.head) : -len(template.after_role)]
            elif part == 1:
                plain = template.unescape(text)
                turns.update(f"{template.role_of(name)}\n{plain}\n".encode("utf-8", "surrogatepass"))
                counts[0] += 1
                if under_loss:
                    counts[1] += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
        if len(row) >= 1000:
            yield batch_of(row)
            row = []
    if counts is not None:
        yield batch_of([*row, close()])


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, from its segments alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_errors.

    Expects the segments of a conversation together and in order, as `formatted` gives them.
    """
    template = template or Template()
    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInArrow(lambda b: _read(b, template), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_errors bigint")
