r"""Chat formatting on prefix trees.

Conversations that share their first turns share a path of a tree.  They are sorted by
the chained digests of their turns, so that every subtree is contiguous, and laid
out depth first: a turn's tokens are written once, by the first conversation that has it.
Each turn (node) carries its first position id - the length of its path above, so that
positions are those of the conversation read alone - and the intervals of the
layout its tokens may attend to besides themselves: its ancestors'.

Tokens are code points.  A layout holds one tree; beyond ``MAX_CHARS`` it is closed
after the conversation at hand and the open path is repeated at the head of the next, so
a first turn that very many conversations share is dealt over many rows and tasks.

Template: ``### role: text </turn>`` and a line end for each turn.  In roles and texts a
backslash is put before every backslash, ``#`` and ``<`` (in roles, ``:`` too), so no
control string can stem from a text, and taking these backslashes out restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, new_path, partitions, saved

MAX_CHARS = 1 << 20

_IN_TEXT, _IN_ROLE, _BACK = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): (.*) </turn>\n", re.S)


def escape(text: str) -> str:
    return _IN_TEXT.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it."""
    head, body = f"### {_IN_ROLE.sub(r'\\\1', role)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


_CONVERSATION = "conv_id long, key binary, roles array<string>, texts array<string>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> one row a conversation, keyed by its turns' chained digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
    done: list[tuple] = []
    now: tuple | None = None

    def add(conv, role, text):
        nonlocal now
        if now is None or now[0] != conv:
            if now is not None:
                done.append((now[0], bytes(now[1]), now[2], now[3]))
            now = (conv, bytearray(), [], [])
        h = hashlib.blake2b(bytes(now[1][-16:]), digest_size=16)
        r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        h.update(len(r).to_bytes(8, "big") + r + t)
        now[1].extend(h.digest())
        now[2].append(role)
        now[3].append(text)

    def out() -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, schema)], schema=schema)

    for b in batches:
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            add(conv, role or "", text or "")
        if len(done) >= 200:
            yield out()
            done = []
    if now is not None:
        done.append((now[0], bytes(now[1]), now[2], now[3]))
    if done:
        yield out()


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, key, roles, texts) of each conversation, turns in order of turn, role, text."""
    src = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(src.select("conv_id", "role", "text"), _gather, _CONVERSATION)


class _Layout:
    """One tree, or a part of one, in depth-first order."""

    FIELDS = ("node_start", "node_end", "parent", "position", "loss_start", "loss_end")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: dict[str, list[int]] = {f: [] for f in self.FIELDS}
        self.attend: list[list[int]] = []
        self.convs: list[int | None] = []
        self.leaves: list[int] = []
        self.path: list[tuple[bytes, int]] = []

    def add(self, conv: int | None, key: bytes, roles: list[str], texts: list[str]) -> None:
        keys = [key[i : i + 16] for i in range(0, len(key), 16)]
        same = 0
        while same < min(len(keys), len(self.path)) and keys[same] == self.path[same][0]:
            same += 1
        del self.path[same:]
        n = self.nodes
        for k, role, text in zip(keys[same:], roles[same:], texts[same:]):
            piece, lo, hi = format_turn(role, text)
            up = self.path[-1][1] if self.path else -1
            me = len(self.parts)
            seen = [] if up < 0 else list(self.attend[up])
            if up >= 0:
                s, e = n["node_start"][up], n["node_end"][up]
                if seen and seen[-1] == s:
                    seen[-1] = e
                else:
                    seen += [s, e]
            mask = (self.size + lo, self.size + hi) if role == "assistant" else (self.size, self.size)
            values = (self.size, self.size + len(piece), up, 0 if up < 0 else n["position"][up] + n["node_end"][up] - n["node_start"][up], *mask)
            for f, v in zip(self.FIELDS, values):
                n[f].append(v)
            self.attend.append(seen)
            self.parts.append(piece)
            self.size += len(piece)
            self.path.append((k, me))
        self.convs.append(conv)
        self.leaves.append(self.path[-1][1])


_LAYOUT = ("tokens string, node_start array<int>, node_end array<int>, parent array<int>, position array<int>, loss_start array<int>, loss_end array<int>, "
           "attend array<array<int>>, conv_id array<long>, leaf array<int>")  # fmt: skip


def _lay_out(max_chars: int):
    ints = pa.list_(pa.int32())
    types = [pa.string(), *[ints] * 6, pa.list_(ints), pa.list_(pa.int64()), ints]
    names = ["tokens", *_Layout.FIELDS, "attend", "conv_id", "leaf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        chars = 0
        now: _Layout | None = None

        def close() -> None:
            nonlocal chars
            if now is not None:
                chars += now.size
                done.append(("".join(now.parts), *(now.nodes[f] for f in _Layout.FIELDS), now.attend, now.convs, now.leaves))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

        for b in batches:
            for conv, key, roles, texts in zip(*(b.column(k).to_pylist() for k in range(4))):
                if now is None or now.size >= max_chars or now.path[0][0] != key[:16]:
                    close()
                    now = _Layout()
                now.add(conv, key, roles, texts)
                if len(done) >= 500 or chars >= 4 * max_chars:
                    yield out()
                    done, chars = [], 0
        close()
        if done:
            yield out()

    return run


def format_conversations(rows: DataFrame, max_chars: int = MAX_CHARS, path: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> layouts, written to ``path`` (or the shared folder) and read back.

    * a null text or role is empty; a null turn comes first; of equal turns role, then text decide.
    * rows with a null conv_id are one conversation; repeated rows are turns like others.
    * an empty table gives no layouts; further columns are ignored.
    """
    spark = rows.sparkSession
    convs = gather(rows)
    ordered = saved(convs, "conversations").repartitionByRange(partitions(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return saved(map_batches(ordered, _lay_out(max_chars), _LAYOUT), "chat", path or new_path(spark, "chat"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for row in b.to_pylist():
            text, state = row["tokens"], []
            for lo, hi, up, pos, mlo, mhi in zip(*(row[f] for f in _Layout.FIELDS)):
                role, body = parse_turn(text[lo:hi])
                n, turns, chars, loss = (0, hashlib.sha256(), 0, hashlib.sha256()) if up < 0 else state[up][:4]
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(text[mlo:mhi])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                state.append((n + 1, turns, chars + len(masked), loss, pos + hi - lo))
            for conv, leaf in zip(row["conv_id"], row["leaf"]):
                n, turns, chars, loss, total = state[leaf]
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
        cols = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _DIGEST.split(", ")])


def read_back(layouts: DataFrame) -> DataFrame:
    """Per conversation, from the layouts alone: turns, loss text and formatted length."""
    return map_batches(layouts, _digest, _DIGEST)
