"""Chat formatting as prefix trees: turns that conversations share are emitted once.

Conversations are sorted by the path of their turns' hashes, in ranges, so that those with
equal first turns are neighbours and every order of a tree is depth first.  One pass over a
range keeps the open path: a conversation adds only the turns beyond what it shares with that
path.  A packed sequence holds the trees of one first turn, up to ``MOST_TOKENS`` tokens or
``MOST_CONVERSATIONS`` conversations; where a tree is larger, or lies in several ranges, the next
sequence starts with the path anew, so neither a common first turn nor a conversation copied
many times meets in one task.

A node is a turn: its tokens' place, the position id of its first token (the tokens on the path
before it), its parent, the intervals of its ancestors' tokens, merged where they touch, and the
interval under the loss mask.

The template marks a turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line
end.  The marks are single ids that no text encodes to; within roles and texts ``\\`` is written
``\\\\`` and ``<|`` is written ``<\\|`` (and in roles a line end ``\\n``), which is undone on reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches_out, table

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
MOST_TOKENS = 1 << 16
MOST_CONVERSATIONS = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


class Coder:
    """A byte-level vocabulary with two more ids for the marks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.line_end = self.coding.encode_ordinary("\n")

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """A formatted turn's ids, and where its text starts and ends among them."""
        head = [self.start, *self.coding.encode_ordinary(escape_role(role) + "\n")]
        body = self.coding.encode_ordinary(escape(text))
        return [*head, *body, self.end, *self.line_end], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        return self.coding.decode_bytes(ids).decode()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_NODE = T.StructType(
    [
        T.StructField("parent", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
        T.StructField("ancestors", T.ArrayType(_SPAN)),
    ]
)
_LEAF = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("node", T.IntegerType())])
SEQUENCES = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("nodes", T.ArrayType(_NODE)),
        T.StructField("conversations", T.ArrayType(_LEAF)),
    ]
)


class _Sequence:
    """The packed sequence being written, with its open path."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[str, str, int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for (role, text, _), turn in zip(self.path, turns, strict=False):
            if (role, text) != turn:
                break
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], coder: Coder) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            ids, a, b = coder.turn(role, text)
            at = len(self.ids)
            parent = self.path[-1][2] if self.path else -1
            position, ancestors = 0, []
            if parent >= 0:
                above = self.nodes[parent]
                position = above["position"] + above["end"] - above["start"]
                ancestors = [dict(s) for s in above["ancestors"]]
                if ancestors and ancestors[-1]["end"] == above["start"]:
                    ancestors[-1]["end"] = above["end"]
                else:
                    ancestors.append({"start": above["start"], "end": above["end"]})
            learned = role == LEARNED_ROLE
            self.nodes.append(
                {"parent": parent, "start": at, "end": at + len(ids), "position": position, "loss_start": at + a if learned else at, "loss_end": at + b if learned else at, "ancestors": ancestors}
            )
            self.ids += ids
            self.path.append((role, text, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][2] if self.path else -1})


def sequences(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Packed sequences of all conversations of ``turns`` (conv_id, turn, role, text; other columns are left).

    Null roles and texts count as empty.  A conversation's rows are ordered by turn, nulls
    first, then role and text, and all of them are turns, repeated ones too; a row with a null
    conv_id is a conversation of its own, as nothing tells which rows belong together.
    """
    where = path or vocabulary_path()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", own.alias("_own")).groupBy("conv_id", "_own").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    hashed = F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0"))
    keyed = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.array_join(hashed, "").alias("path"))
    ranges = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder, open_one, made = Coder(where), _Sequence(), 0
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for conv_id, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(t["role"], t["text"]) for t in listed]
                full = len(open_one.ids) >= MOST_TOKENS or len(open_one.leaves) >= MOST_CONVERSATIONS
                if open_one.leaves and (full or not open_one.shared(own)):
                    yield first + made, open_one.ids, open_one.nodes, open_one.leaves
                    open_one, made = _Sequence(), made + 1
                open_one.add(conv_id, own, coder)
        if open_one.leaves:
            yield first + made, open_one.ids, open_one.nodes, open_one.leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), SEQUENCES, lambda r: 8 * len(r[1]) + 200 * len(r[2]))

    return ranges.mapInArrow(run, SEQUENCES)


def read_back(ids: list[int], nodes: list[dict], leaf: int, coder: Coder) -> tuple[list[tuple[str, str]], list[str], int]:
    """A conversation's (role, text) turns, its texts under the loss mask, and its formatted length, from a packed sequence alone."""
    if leaf < 0:
        return [], [], 0
    path = [*nodes[leaf]["ancestors"], {"start": nodes[leaf]["start"], "end": nodes[leaf]["end"]}]
    formatted = [i for s in path for i in ids[s["start"] : s["end"]]]
    turns, at = [], 0
    marks = [n for n, i in enumerate(formatted) if i in (coder.start, coder.end)]
    length = 0
    for a, b in zip(marks[::2], marks[1::2], strict=True):
        head, _, body = coder.text(formatted[a + 1 : b]).partition("\n")
        turns.append((unescape(head), unescape(body)))
        length += len(START) + len(head) + 1 + len(body) + len(END) + 1
        at = b
    if at + 1 + len(coder.line_end) != len(formatted):
        raise ValueError("a sequence does not end with a turn")
    under, node = [], leaf
    while node >= 0:
        n = nodes[node]
        if n["loss_end"] > n["loss_start"]:
            under.append(unescape(coder.text(ids[n["loss_start"] : n["loss_end"]])))
        node = n["parent"]
    return turns, under[::-1], length


_DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def digest(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Every conversation read back from the packed sequences, as digests."""
    where = path or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder = Coder(where)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, nodes, leaves = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                for leaf in leaves:
                    turns, under, length = read_back(ids, nodes, leaf["node"], coder)
                    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    loss = "".join(under)
                    yield leaf["conv_id"], len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), _DIGEST)

    return packed.select("ids", "nodes", "conversations").mapInArrow(run, _DIGEST)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, read back from the packed sequences; ``sequences`` states nulls, repeats and order."""
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


ORACLE = r"""
with c as (
  select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, null, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all
  select -1, null, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') as shown_role,
         replace(replace(text, '\', '\\'), '<|', '<\|') as shown
  from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(12 + length(shown_role) + 1 + length(shown) + 10 + 1) as bigint) as formatted_chars
from e group by conv_id, own
"""
