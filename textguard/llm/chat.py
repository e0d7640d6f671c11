"""Chat formatting by token-level assembly.

Roles and texts are encoded one by one, with every control string in them escaped; the control tokens are
spliced in as reserved ids that no encoded text can hold. The loss mask is a running sum over marks at the ends
of each trained segment. Turns are dealt out in ranges of (conversation, turn), so a conversation of any length is
put together by several tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from textguard.llm.base import small_batches
from textguard.scratch import stage

#: The template of a turn: TURN role TEXT text END. The reserved ids follow the vocabulary's last one.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>")
#: A conversation is one row, unless it is longer than this; then it goes on in further pieces.
PIECE_TOKENS = 1 << 16
#: Characters of roles and texts by which ranges are cut; the cuts of all ranges are held by the driver.
_RANGE_CHARS = 32
_PART_BITS = 33

_LONG_SPACE = re.compile(r"\s{20000}")
_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` with one backslash more between ``<`` and ``|``, so that it holds no control string."""
    return _OPENS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class ChatCodec:
    """A byte-level vocabulary (rank file) with three reserved ids after its last."""

    def __init__(self, rank_file: str, pattern: str):
        import regex
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.turn, self.text, self.end = (max(ranks.values()) + 1 + k for k in range(3))
        self.controls = dict(zip((self.turn, self.text, self.end), CONTROLS))

    def encode(self, text: str) -> list[int]:
        escaped = escape(text)
        if not _LONG_SPACE.search(escaped):
            return self.encoding.encode_ordinary(escaped)
        # The library's own search for matches runs out of stack in very long white space.
        return [i for m in self.matches.finditer(escaped) for i in self.encoding._encode_single_piece(m.group())]

    def assemble(self, role: str, text: str, trained: bool) -> tuple[list[int], np.ndarray]:
        """(ids, loss mask) of one turn."""
        role_ids, text_ids = self.encode(role), self.encode(text)
        ids = [self.turn, *role_ids, self.text, *text_ids, self.end]
        marks = np.zeros(len(ids), np.int8)
        if trained and text_ids:
            marks[len(role_ids) + 2] += 1
            marks[-1] -= 1
        return ids, np.cumsum(marks) > 0

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[int, int, int, bytes, bytes]:
        """Of whole turns: their number, code points under the mask and in all, role and text of each with line ends, and
        the text under the mask."""
        turns, trained, loss_chars, chars = [], [], 0, 0
        begins, texts, ends = (np.flatnonzero(ids == c) for c in (self.turn, self.text, self.end))
        for a, b, c in zip(begins, texts, ends):
            role, text = self.decode(ids[a + 1 : b].tolist()), self.decode(ids[b + 1 : c].tolist())
            chars += len(role) + len(text) + sum(map(len, CONTROLS))
            turns.append(f"{unescape(role)}\n{unescape(text)}\n")
            trained.append(unescape(self.decode(ids[a : c + 1][mask[a : c + 1]].tolist())))
            loss_chars += len(trained[-1])
        return len(turns), loss_chars, chars, "".join(turns).encode(), "".join(trained).encode()


_codecs: dict[str, ChatCodec] = {}


def _codec(rank_file: str, pattern: str) -> ChatCodec:
    return _codecs.get(rank_file) or _codecs.setdefault(rank_file, ChatCodec(rank_file, pattern))


def format_conversations(
    turns: DataFrame,
    rank_file: str,
    pattern: str,
    trained_role: str = "assistant",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows of (conversation, ``piece``, ``ids``, ``loss_mask``), the pieces of a conversation in order from 0.

    A conversation's turns follow each other by turn number, null first, ties by role and then text. Null texts and
    roles count as empty, null conversation ids are one conversation, repeated rows are repeated turns. Under the
    loss mask lie the tokens of the texts of ``trained_role``, without control tokens. An empty table gives no rows;
    further columns are not read. A range of turns is sorted and put together as a stream, with one piece in memory; a
    conversation that goes over ranges has a piece end at each cut. Turns of one conversation and number whose role and
    text begin alike are in one range. The pieces lie in a written table.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file, pattern)
        done, held, now, piece, turns_, size, kind = [], 0, None, 0, [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if turns_ and (conv != now or size >= PIECE_TOKENS):
                    done.append((now, piece, *map(np.concatenate, zip(*turns_))))
                    held, turns_, size = held + size, [], 0
                    piece = piece + 1 if conv == now else 0
                    if held >= PIECE_TOKENS:
                        yield _pieces(done, kind, conv_col)
                        done, held = [], 0
                ids, mask = codec.assemble(role, text, role == trained_role)
                turns_.append((np.array(ids, np.int32), mask))
                now, size = conv, size + len(ids)
        if turns_:
            done.append((now, piece, *map(np.concatenate, zip(*turns_))))
            yield _pieces(done, kind, conv_col)

    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col(conv_col),
        F.coalesce(role_col, F.lit("")).alias("_role"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
        F.col(turn_col).alias("_turn"),
    )
    starts = (F.substring(c, 1, _RANGE_CHARS) for c in ("_role", "_text"))
    ranged = rows.repartitionByRange(conv_col, "_turn", *starts).sortWithinPartitions(conv_col, "_turn", "_role", "_text")
    lists = [StructField("ids", ArrayType(IntegerType())), StructField("loss_mask", ArrayType(BooleanType()))]
    schema = StructType([StructField(conv_col, turns.schema[conv_col].dataType), StructField("piece", IntegerType()), *lists])
    pieces = ranged.drop("_turn").mapInArrow(assemble, schema)
    pieces = stage(pieces.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), _PART_BITS)), "chat-pieces")
    # A range goes on with at most one conversation of the ranges before it, so there are no more shifts than ranges.
    earlier = Window.partitionBy(conv_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = pieces.groupBy(conv_col, "_part").agg(F.count(F.lit(1)).alias("_run"))
    shifts = runs.select(F.col(conv_col).alias("_conv"), F.col("_part").alias("_at"), F.sum("_run").over(earlier).alias("_shift"))
    goes_on = F.col(conv_col).eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_at"))
    numbered = pieces.join(F.broadcast(shifts.filter("_shift is not null")), goes_on, "left")
    piece = (F.col("piece") + F.coalesce("_shift", F.lit(0))).cast("int").alias("piece")
    return numbered.select(conv_col, piece, "ids", "loss_mask")


def _pieces(done: list[tuple], kind: pa.DataType, conv_col: str) -> pa.RecordBatch:
    convs, numbers, *lists = zip(*done)
    ends = pa.array(np.cumsum([0, *map(len, lists[0])]), pa.int32())
    columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in lists]
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(numbers, pa.int32()), *columns], [conv_col, "piece", "ids", "loss_mask"])


def read_back(formatted: DataFrame, rank_file: str, pattern: str, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted ids say of each conversation: ``n_turns``, ``turns_sha256`` (role, line end, text, line end of
    each turn), ``loss_chars`` and ``loss_sha256`` of the text under the loss mask, ``formatted_chars``.

    Pieces are decoded where they lie. A digest needs its bytes in order, so these alone are brought together by conversation
    and hashed as a stream; a conversation that goes over pieces is never held whole. Turns come in the order in which they were
    written, repeated ones too; null roles and texts have become empty ones, a null conversation id is a conversation of its own;
    an empty table gives no rows; further columns are not read.
    """
    counts, contents = ("n_turns", "loss_chars", "formatted_chars"), ("turns_sha256", "loss_sha256")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file, pattern)
        for b in batches:
            lists = zip(b.column(2), b.column(3))
            read = [codec.read(i.values.to_numpy(), m.values.to_numpy(zero_copy_only=False)) for i, m in lists]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            arrays = [pa.array(c, k) for c, k in zip(zip(*read), kinds)]
            if read:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], [conv_col, "piece", *counts, *contents])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, numbers, hashes, kind = [], None, None, [], None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, _, *row in zip(*(c.to_pylist() for c in b.columns)):
                if numbers is None or conv != now:
                    if numbers is not None:
                        done.append((now, *numbers, *(h.hexdigest() for h in hashes)))
                    now, numbers, hashes = conv, [0] * len(counts), [hashlib.sha256() for _ in contents]
                numbers = [n + more for n, more in zip(numbers, row)]
                for h, content in zip(hashes, row[len(counts) :]):
                    h.update(content)
            if done:
                yield _digests(done, kind, schema.names)
                done = []
        if numbers is not None:
            yield _digests([(now, *numbers, *(h.hexdigest() for h in hashes))], kind, schema.names)

    small_batches(formatted.sparkSession)
    conv, longs = formatted.schema[conv_col], [StructField(n, LongType()) for n in counts]
    schema = StructType([conv, *longs, *(StructField(n, StringType()) for n in contents)])
    decoded = StructType([conv, StructField("piece", IntegerType()), *longs, *(StructField(n, BinaryType()) for n in contents)])
    pieces = formatted.select(conv_col, "piece", "ids", "loss_mask").mapInArrow(decode, decoded)
    return pieces.repartition(conv_col).sortWithinPartitions(conv_col, "piece").mapInArrow(digest, schema)


def _digests(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind] + [pa.int64()] * 3 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
