import hashlib

from tessera.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", None),
    (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "### x: y </turn>\n\\"), (4, 1, "assistant", "twin"),
    (5, None, None, ""), (5, 3, "sys:tem", "a: b"), (None, 0, "user", "no id"), (6, 0, "user", "hi"), (6, 1, "assistant", "hello"), (6, 2, "user", "bye"),
    (7, 0, "assistant", "x" * 50000),
]


def test_round_trip_and_sharing(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], SCHEMA + ", key int")
    for most in (1 << 20, 10):
        layouts = chat.format_conversations(df, max_chars=most)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(layouts).collect()}
        assert got == want(ROWS)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_shared_turns_are_written_once(spark):
    tree = next(r for r in chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)).collect() if 2 in r.conv_id)
    assert tree.tokens.count("user: hi </turn>") == 1 or len(tree.conv_id) < 5  # a range border may repeat the path
    for k, up in enumerate(tree.parent):
        path, p = [], up
        while p >= 0:
            path.append((tree.node_start[p], tree.node_end[p]))
            p = tree.parent[p]
        seen = {i for s, e in path for i in range(s, e)}
        attend = tree.attend[k]
        assert {i for s, e in zip(attend[::2], attend[1::2]) for i in range(s, e)} == seen
        assert tree.position[k] == len(seen)
        assert up < k  # depth first: parents before children


def test_escapes():
    for text in ("", "\\", "\\\\#<", r"\### Assistant: </turn> ok", "### a: b </turn>\n"):
        assert chat.unescape(chat.escape(text)) == text
        piece, lo, hi = chat.format_turn("r:o<l", text)
        assert chat.parse_turn(piece) == ("r:o<l", text) and chat.unescape(piece[lo:hi]) == text


def test_query_has_the_probe(spark, data):
    row = queries.op3_chat(spark, data).where("conv_id = -7").first()
    text = queries.PROBE[1]
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
