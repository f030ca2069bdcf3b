"""Chat formatting on token level: segments are encoded apart, reserved ids mark turns, masks come from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import bytepairs
from lexivec.llm.common import partitions_of

#: The text of each reserved id, in the order of the ids from the end of the vocabulary on.
OPENINGS = {"user": "### User: ", "assistant": "### Assistant: ", "system": "### System: ", None: "### Other "}
ROLE_END = " says: "
TURN_END = "</turn>\n"
CONTROLS = (*OPENINGS.values(), ROLE_END, TURN_END)
#: Tokens in an output row at most.
CHUNK = 1 << 16

_CONTROL = re.compile("|".join(re.escape(c.strip()) for c in CONTROLS) + r"|\\")
_ESCAPED = re.compile(rf"\\({_CONTROL.pattern})")


def escape(text: str) -> str:
    """text with a backslash before each backslash and each control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level merges at path; reserved ids begin after its free id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def encode_turns(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, role, ids, lengths): the ids of a turn, and the lengths of its opening, content and end."""
    roles = list(OPENINGS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, first = encoding(path)
        role_end, turn_end = first + len(roles), first + len(roles) + 1
        for pdf in batches:
            ids, lengths = [], []
            for role, text in zip(pdf["role"], pdf["text"], strict=True):
                if role in OPENINGS and role is not None:
                    opening = [first + roles.index(role)]
                else:
                    opening = [first + roles.index(None), *bytepairs.encode(enc, escape(role or "")), role_end]
                content = bytepairs.encode(enc, escape(text))
                ids.append(np.array([*opening, *content, turn_end], np.int32))
                lengths.append([len(opening), len(content), 1])
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "role": pdf["role"], "ids": ids, "lengths": lengths})

    keys = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    rows = turns.select(*keys, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "conv_id string, turn string, role string, ids array<int>, lengths array<int>")
    return out.select(*[F.col(c).cast(turns.schema[c].dataType).alias(c) for c in ("conv_id", "turn")], "role", "ids", "lengths")


def assemble(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, chunk, start, ids, loss) of turns (conv_id, turn, role, text): each conversation's tokens in order, in
    rows of at most CHUNK tokens; loss is 1 on the tokens of assistant texts.

    Turns are encoded where they lie and then dealt by conversation; a task passes over its conversations turn by turn
    and holds a chunk, so that a conversation can be of any length. Equal turn numbers go by role and tokens, null turns
    and conversations first; null roles and texts are empty."""
    ordered = encode_turns(turns, path).repartition(partitions_of(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ids, marks, size, chunk, start = None, [], [], 0, 0, 0
        begun = False

        def rows(last: bool) -> list[tuple]:
            nonlocal ids, marks, size, chunk, start
            out = []
            if size >= CHUNK or last and size:
                flat, mask = np.concatenate(ids), np.concatenate(marks)
                for i in range(0, len(flat), CHUNK):
                    part = flat[i : i + CHUNK]
                    out.append((conv, chunk, start, part, mask[i : i + CHUNK]))
                    chunk, start = chunk + 1, start + len(part)
                ids, marks, size = [], [], 0
            return out

        for pdf in batches:
            out: list[tuple] = []
            for conv_id, role, tokens, lengths in zip(pdf["conv_id"], pdf["role"], pdf["ids"], pdf["lengths"], strict=True):
                if not begun or conv_id != conv:
                    out += rows(True) if begun else []
                    conv, chunk, start, begun = conv_id, 0, 0, True
                # The mask is the prefix sum of +1 where the text begins and -1 where it ends.
                steps = np.zeros(len(tokens) + 1, np.int8)
                if role == "assistant":
                    steps[lengths[0]] += 1
                    steps[lengths[0] + lengths[1]] -= 1
                ids.append(np.asarray(tokens, np.int32))
                marks.append(np.cumsum(steps, dtype=np.int8)[:-1])
                size += len(tokens)
                out += rows(False)
            yield pd.DataFrame(out, columns=["conv_id", "chunk", "start", "ids", "loss"])
        if begun:
            yield pd.DataFrame(rows(True), columns=["conv_id", "chunk", "start", "ids", "loss"])

    out = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "ids", "lengths").mapInPandas(run, "conv_id string, chunk int, start bigint, ids array<int>, loss array<tinyint>")
    return out.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


class Reader:
    """Turns, masked texts and formatted text of token ids and masks, fed in chunks."""

    def __init__(self, path: str):
        self.encoding, self.first = encoding(path)
        self.roles = list(OPENINGS)
        self.held: list[np.ndarray] = []

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")

    def turns(self, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, masked text, formatted length) of every turn that ends in this chunk."""
        both = np.stack([ids, loss])
        end = self.first + len(self.roles) + 1
        at = 0
        for stop in np.flatnonzero(ids == end).tolist():
            turn = np.concatenate([*self.held, both[:, at : stop + 1]], axis=1)
            self.held, at = [], stop + 1
            tokens, mask = turn
            opening, body = int(tokens[0]) - self.first, 1
            role, shown = self.roles[opening], len(CONTROLS[opening])
            if role is None:
                body = int(np.flatnonzero(tokens == self.first + len(self.roles))[0]) + 1
                raw = self.text(tokens[1 : body - 1])
                role, shown = unescape(raw), shown + len(raw) + len(ROLE_END)
            raw = self.text(tokens[body:-1])
            yield role, unescape(raw), unescape(self.text(tokens[mask == 1])), shown + len(raw) + len(TURN_END)
        if at < len(ids):
            self.held.append(both[:, at:])


def digests(chunks: DataFrame, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from assemble()'s rows, which
    must come straight from it: it leaves each conversation's chunks together and in order. Null roles and texts have
    become empty there; a null conversation is one of its own; an empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(path)
        conv, state = None, None
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> tuple:
            n, turns, chars, loss, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for pdf in batches:
            out = []
            for conv_id, ids, loss in zip(pdf["conv_id"], pdf["ids"], pdf["loss"], strict=True):
                if state is None or conv_id != conv:
                    out += [row()] if state else []
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, masked, shown in reader.turns(np.asarray(ids, np.int32), np.asarray(loss, np.int32)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                    state[4] += shown
            yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([row()], columns=columns)

    schema = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    out = chunks.select(F.col("conv_id").cast("string").alias("conv_id"), "ids", "loss").mapInPandas(run, schema)
    return out.withColumn("conv_id", F.col("conv_id").cast(chunks.schema["conv_id"].dataType))
