import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontam
from tessera.llm.decontam import ItemIndex, words


def items_and_texts(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.randint(12, 60))) for i in range(n)]
    texts = []
    for _ in range(150):
        parts = [text(rng.randint(0, 200))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), rng.choice(items)[1])
        texts.append(" ".join(parts))
    return items, texts


def in_order(item, part, share):
    """The longest chain of three-word runs that ascends in both, by the quadratic recursion."""
    x, y = ([tuple(ws[i : i + decontam.GRAM]) for i in range(len(ws) - decontam.GRAM + 1)] for ws in (item, part))
    before = [0] * (len(y) + 1)
    for r in x:
        now = [0]
        for j, q in enumerate(y):
            now.append(max(before[j + 1], now[j], before[j] + (r == q)))
        before = now
    return before[-1] >= share * len(x)


def brute(items, text):
    """Every passage against every item by BM25 itself, then question and answer in order."""
    items = [(i, words(t)) for i, t in items]
    n = len(items)
    df = Counter(w for _, ws in items for w in set(ws))
    mean = sum(len(ws) for _, ws in items) / n
    ws, found = words(text), set()
    starts = [0] if len(ws) <= decontam.PASSAGE else range(0, len(ws) - decontam.STEP, decontam.STEP)
    for i, item in items:
        base = decontam.K1 * (1 - decontam.B + decontam.B * len(item) / mean)
        impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (decontam.K1 + 1) / (c + base) for w, c in Counter(item).items()}
        for s in starts:
            e = min(len(ws), s + decontam.PASSAGE)
            if sum(impact.get(w, 0) for w in set(ws[s:e])) >= decontam.SHARE * sum(impact.values()):
                part = ws[max(0, s - decontam.PASSAGE) : e + decontam.PASSAGE]
                cut = len(item) - decontam.ANSWER
                if in_order(item[:cut], part, decontam.QUESTION_SHARE) and in_order(item[cut:], part, decontam.ANSWER_SHARE):
                    found.add(i)
    return sorted(found)


def test_pruning_loses_nothing(monkeypatch):
    items, texts = items_and_texts()
    want = [brute(items, t) for t in texts]
    assert sum(map(bool, want)) > 50
    for block, gather, cells in ((4, 1 << 18, 1 << 21), (1, 500, 64), (64, 500, 1 << 10), (7, 3000, 300)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "GATHER", gather)
        monkeypatch.setattr(decontam, "CELLS", cells)
        assert ItemIndex(items).find_all(texts) == want


def test_wand_retrieves_all_above_the_threshold():
    """The cursors alone, against the scores of all items; blocks that bounds exclude hold none."""
    items, texts = items_and_texts(3)
    for block in (1, 4, 16):
        decontam.BLOCK, old = block, decontam.BLOCK
        index = ItemIndex(items)
        (level,) = index.levels
        for t in texts[:60]:
            have = sorted({index.terms[w] for w in words(t)[:96] if w in index.terms})
            score = np.zeros(len(items))
            for term in have:
                for k in range(level.ptr[term], level.ptr[term + 1]):
                    score[level.at[k]] += level.impact[k]
            want = np.flatnonzero(score >= index.need - 1e-6).tolist()
            assert sorted(level.wand(have, np.ones(level.blocks, bool))) == want
        decontam.BLOCK = old


def test_words_must_be_in_order():
    rng = random.Random(2)
    ws = [f"x{i}" for i in range(48)]
    index = ItemIndex([(5, " ".join(ws))] + [(i + 10, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(20)])
    pieces = [ws[i : i + 5] for i in range(0, 40, 5)]
    rng.shuffle(pieces)
    assert index.find(" ".join(ws)) == [5]
    assert index.find(" ".join([*(w for p in pieces for w in p), *ws[40:]])) == []


def test_a_large_benchmark_is_sparse():
    """20,000 items of 100,000 terms: postings and block maxima in well under 500 MB."""
    import tracemalloc

    rng = np.random.default_rng(0)
    picks = rng.integers(0, 100_000, (20_000, 40))
    items = [(i, " ".join(f"t{w}" for w in row)) for i, row in enumerate(picks.tolist())]
    tracemalloc.start()
    index = ItemIndex(items)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 300 << 20 and now < 150 << 20
    assert index.find_all([items[k][1] for k in (0, 777, 19_999)] + ["nothing of it"]) == [[0], [777], [19_999], []]


def test_long_items_are_found_at_any_length():
    """Copies of whole items, and the first 65 % of the question with the answer, of lengths beyond a passage."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 200
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    sizes = [20, 96, 97, 220, 260, 300, 480, 1000, 2500]
    items = [(i, text(n)) for i, n in enumerate(sizes)]
    index = ItemIndex([(i, " ".join(ws)) for i, ws in items])
    for i, ws in items:
        for before in (0, 1, 50, 333):
            assert index.find(" ".join([*text(before), *ws, *text(400)])) == [i], (len(ws), before)
    for i, ws in items[5:]:
        part = ws[: int(0.65 * len(ws))] + ws[-decontam.ANSWER :]
        assert index.find(" ".join([*text(70), *part, *text(70)])) == [i], len(ws)
        assert index.find(" ".join([*text(70), *ws[: len(ws) // 2], *text(70)])) == [], len(ws)
    assert index.find(" ".join(text(5000))) == []


def test_planted_items(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    flat = lambda t: " ".join(words(t))
    known = [(r.item_id, flat(r.text)) for r in items.collect()]
    for most in (20_000, 15):  # in one block of items and in several
        got = {r.doc_id: r["items"] for r in decontam.contaminated(docs, items, most=most).collect()}
        for r in docs.collect():
            held = [i for i, t in known if t in flat(r.text)]
            assert set(held) <= set(got[r.doc_id]), r.doc_id
            assert held or not got[r.doc_id], r.doc_id


def test_blocks_of_items_give_what_one_block_gives(spark):
    """Copies whose score is close to the threshold: it is that of all items, however they are dealt."""
    rng = random.Random(11)
    items, texts = [], []
    for i in range(30):
        usual = rng.sample([f"w{k}" for k in range(80)], 20 + decontam.ANSWER)
        items.append((i, " ".join([*usual[:20], *(f"rare{i}x{k}" for k in range(12)), *usual[20:]])))
        texts.append(" ".join(usual))  # 60 % of the question, and the answer, but few of the words that score
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items + [(99, "...")], "item_id long, text string")
    whole, dealt = ({r.doc_id: r["items"] for r in decontam.contaminated(docs, table, most=most).collect()} for most in (20_000, 10))
    assert whole == dealt and 0 < sum(map(len, whole.values())) < len(items)


def test_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, None), (3, "..."), (None, "short one"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")], "item_id long, text string")
    full = items.first().text
    rows = [(1, full), (2, full.upper().replace(" ", " , ")), (3, " ".join(full.split()[:6])), (4, None), (5, ""), (6, ("filler text " * 3000) + full), (1, full), (None, "a short one here")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, items int")
    got = [(r.doc_id, r.found) for r in decontam.contaminated(docs, items, out_col="found").collect()]
    assert sorted(got, key=str) == sorted([(1, [1]), (2, [1]), (3, []), (4, []), (5, []), (6, [1]), (1, [1]), (None, [-1])], key=str)
    assert decontam.keep_clean(docs, items).columns == docs.columns
    clash = docs.withColumn("_items", F.lit("x"))
    assert decontam.contaminated(clash, items).columns == [*clash.columns, "__items"]
    assert sorted(str(r.doc_id) for r in decontam.keep_clean(clash, items).collect()) == ["3", "4", "5"]
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert {tuple(r["items"]) for r in decontam.contaminated(docs.drop("items"), items.limit(0)).collect()} in ({()}, set())
