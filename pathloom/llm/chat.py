r"""Chat formatting by columnar byte assembly.

Template: ``### <role>: <text></turn>\n`` for each turn.  Inside roles and texts
a backslash goes before every backslash, before a ``#`` that two more follow and
before ``</turn>`` (in roles also before ``:``), so that no control string of
the template is left in them and undoing is exact.

Assembly: headers, texts and ends are segments of a source buffer; their
lengths, cumulative offsets and scatter indices are computed in numpy, and all
bytes are copied at once into one preallocated Arrow buffer.  The loss mask holds
the byte spans of assistant texts.

Turns are dealt out by ranges of conversation and turn, so that a very long
conversation is formatted by many tasks, and written in numbered pieces of bounded
size.  ``read_back`` puts the pieces of a conversation in order itself, wherever
they are stored.  Its digests are chains over all bytes of a conversation, which
no two tasks can share: one task reads them as a stream, a piece at a time.

Defined cases: null roles and texts are empty; turns are ordered by turn, role,
text (null first), repeated rows stay; rows with a null conv_id form one
conversation; a very long text is one piece; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEARNED = "assistant"
PIECE_BYTES = 1 << 20
_END = b"</turn>\n"
_control = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_control_role = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"### ((?:\\.|[^\\:])*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_control_role if role else _control).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, each turn's end, and the start of each text in them."""
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [f"### {escape(r, True)}: ".encode() for r in kinds]
    bodies = [(escape(t) if "\\" in t or "###" in t or "</turn>" in t else t).encode("utf-8", "surrogatepass") for t in texts]
    parts = [*heads, _END, *bodies]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.cumsum(size) - size
    source = np.frombuffer(b"".join(parts), np.uint8)
    n = len(texts)
    segment = np.empty((n, 3), np.int64)
    segment[:, 0] = [kinds[r] for r in roles]
    segment[:, 1] = len(heads) + 1 + np.arange(n)
    segment[:, 2] = len(heads)
    lengths = size[segment].ravel()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if n else 0
    out = pa.allocate_buffer(total)
    view = np.frombuffer(out, np.uint8)
    # Where each byte of the output comes from: its own place, moved by its segment's distance.
    index = np.arange(total, dtype=np.int64)
    index -= np.repeat(starts - at[segment].ravel(), lengths)
    np.take(source, index, out=view)
    return out, ends[2::3], starts[1::3]


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, piece, formatted, text_start, text_bytes, learned: pieces of each conversation, in the order of their numbers.

    ``text_start`` and ``text_bytes`` give the span of each turn's text in the
    piece; those with ``learned`` are the loss mask.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows that differ in their texts alone stay together: a range's bounds are sent around, and texts may be long.
    dealt = rows.repartitionByRange(common.shuffle_partitions(conversations.sparkSession), "conv_id", "turn", "role")
    ordered = dealt.sortWithinPartitions(*keys).select(*keys, F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        piece = None
        for batch in batches:
            if piece is None and batch.num_rows:
                piece = batch.column(4)[0].as_py() << 32
            for part in common.text_chunks(batch, ["conv_id", "role", "text"]):
                ids = part.column(0).to_pylist()
                roles, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                data, ends, text_at = assemble(roles, texts)
                view = np.frombuffer(data, np.uint8)
                cuts = [0]
                for i in range(1, len(ids)):
                    if ids[i] != ids[i - 1] or ends[i - 1] - (ends[cuts[-1] - 1] if cuts[-1] else 0) >= PIECE_BYTES:
                        cuts.append(i)
                cuts.append(len(ids))
                out: dict[str, list] = {k: [] for k in ("conv_id", "piece", "formatted", "text_start", "text_bytes", "learned")}
                for a, b in zip(cuts, cuts[1:], strict=False):
                    base = int(ends[a - 1]) if a else 0
                    out["conv_id"].append(ids[a])
                    out["piece"].append(piece)
                    piece += 1
                    out["formatted"].append(view[base : ends[b - 1]].tobytes())
                    out["text_start"].append((text_at[a:b] - base).tolist())
                    out["text_bytes"].append((ends[a:b] - len(_END) - text_at[a:b]).tolist())
                    out["learned"].append([r == LEARNED for r in roles[a:b]])
                spans = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["conv_id"], part.column(0).type), pa.array(out["piece"], pa.int64()), pa.array(out["formatted"], pa.binary()),
                     pa.array(out["text_start"], spans), pa.array(out["text_bytes"], spans), pa.array(out["learned"], pa.list_(pa.bool_()))],
                    names=list(out),
                )

    return common.small_batches(ordered).mapInArrow(run, f"conv_id {kind}, piece long, formatted binary, text_start array<long>, text_bytes array<long>, learned array<boolean>")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted pieces, in whatever order and partitions they are."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "piece", "formatted", "text_start", "text_bytes", "learned"]
    pieces = pieces.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        done: list[list] = []
        state = None
        last = object()
        id_type = None

        def close():
            if state:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

        def flush():
            rows = list(zip(*done, strict=True))
            done.clear()
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["conv_id", *columns])

        for batch in batches:
            id_type = batch.column(0).type
            for part in common.text_chunks(batch, names, "formatted"):
                for conv, _, data, at, size, learned in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if conv != last:
                        close()
                        last = conv
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    whole = data.decode("utf-8", "surrogatepass")
                    seen, n = 0, 0
                    for m in _turn.finditer(whole):
                        if m.start() != seen:
                            break
                        seen = m.end()
                        n += 1
                        state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    if seen != len(whole) or n != len(at):
                        raise ValueError(f"conversation {conv}: text outside the template")
                    state[1] += n
                    state[5] += len(whole)
                    for a, b, on in zip(at, size, learned, strict=True):
                        if on:
                            text = unescape(data[a : a + b].decode("utf-8", "surrogatepass"))
                            state[3] += len(text)
                            state[4].update(text.encode("utf-8", "surrogatepass"))
                if len(done) >= 1000:
                    yield flush()
        close()
        if done:
            yield flush()

    return common.small_batches(pieces).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
