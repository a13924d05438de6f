"""Chat formatting, hard negatives and the prefix trie against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import chat_format, hard_negatives, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_start|>", "<|", "|>", "<", "%3C", "%25", "é", "😀", "\n", "\\", "a"]


# ---- formatting ----


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_come_back(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            said = "".join(rng.choice(MARKS) for _ in range(rng.randrange(0, 9)))
            role = rng.choice(["user", "assistant", "system", "<|im_end|>\n", "a%0Ab", "", None])
            rows.append((c, rng.choice([t, t, None]), role, rng.choice([said, None])))
    rows += [(None, 1, "assistant", "x"), (99, 0, "assistant", "word <| " * 200_000), (98, 0, "user", ""), (98, 0, "user", "")]
    table = spark.createDataFrame(rows, TURNS).withColumns({"messages": F.lit("x"), "_paths": F.lit(1), "turns": F.lit(2), "formatted": F.lit(3)})
    records = chat_format.gather_turns(table)
    formatted = chat_format.format_chats(chat_format.canonical_turns(records, ["conv_id"]))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_back(formatted)).collect()}
    by = {}
    for c, t, role, said in rows:
        by.setdefault(c, []).append((t, role, said))
    assert set(got) == set(by)
    key = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    for c, turns in by.items():
        turns = [(r or "", s or "") for _, r, s in sorted(turns, key=key)]
        learnt = "".join(s for r, s in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{s}\n" for r, s in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), sha(learnt))
    for r in formatted.select("conv_id", "formatted", "loss_mask").filter("conv_id < 60").collect():
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == len(r["loss_mask"]) == len(by[r["conv_id"]])
    empty = chat_format.gather_turns(table.limit(0))
    assert chat_format.digests(chat_format.read_back(chat_format.format_chats(chat_format.canonical_turns(empty, ["conv_id"])))).count() == 0


def test_layouts(spark):
    texts = [
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "weight": 1}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"id": 4, "system": "be", "instruction": "do", "output": "done"}',
        '{"id": 5, "prompt": "q", "completion": "a"}',
        '{"id": 6, "question": "q", "answer": "a", "context": "c"}',
        '{"id": 7, "messages": []}',
        '{"id": 8, "messages": [null, {"role": "user", "text": null}]}',
        '{"id": 9, "prompt": "q"}',
        '{"id": 10, "prompt": "q", "completion": "a", "output": "b"}',
        "no json",
        None,
    ]
    table = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "key int, record string").withColumn("prompt", F.lit("clash"))
    records = chat_format.parse_records(table, "record", ["key"])
    got = {r["key"]: r for r in chat_format.canonical_turns(records, ["key"]).collect()}
    turns = {k: None if r["turns"] is None else [tuple(t) for t in r["turns"]] for k, r in got.items()}
    pair = [("user", "q"), ("assistant", "a")]
    assert [got[k]["layout"] for k in range(1, 13)] == [
        "messages", "conversations", "instruction", "instruction", "prompt", "question", "messages", "messages", None, None, None, None,
    ]
    assert turns[1] == turns[2] == turns[5] == pair
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert turns[4] == [("system", "be"), ("user", "do"), ("assistant", "done")]
    assert turns[6] == [("user", "c\n\nq"), ("assistant", "a")]
    assert turns[7] == [] and turns[8] == [("", ""), ("user", "")] and turns[9] is None
    # A typed table of the same layout has the same fingerprint, whatever else it holds.
    typed = spark.createDataFrame([("q", "a", 5)], "prompt string, completion string, extra int")
    assert chat_format.canonical_turns(typed).first()["fingerprint"] == got[5]["fingerprint"]
    assert got[9]["fingerprint"] != got[5]["fingerprint"]


# ---- hard negatives ----


@pytest.mark.parametrize("shape", [(1, 1, 1), (37, 64, 53), (130, 70, 200), (16, 0, 9), (0, 5, 3)])
@pytest.mark.parametrize("high", [300, 2**31 - 1, 2**45])
def test_strassen(shape, high):
    rng = np.random.default_rng(1)
    n, k, m = shape
    a, b = rng.integers(-high, high, (n, k)), rng.integers(-300, 300, (k, m))
    want = a.astype(object).dot(b.astype(object)) if k else np.zeros((n, m), object)
    assert (hard_negatives.strassen(a, b, 8) == want).all()
    assert (hard_negatives.strassen(a.astype(object), b.astype(object), 8) == want).all()


def mined(rows, least=50, most=95):
    use = [(i, g, [int(np.floor(256.0 * float(x))) for x in v]) for i, v, g in rows
           if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({(i, g, tuple(v)) for i, g, v in use if i % 50 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, g) for i, g, v in use if i != a[0] and len(v) == len(a[2]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a[0], p, r, x[1], -s, -x[0]) for r, x in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"anchor_rows": 2, "candidate_rows": 9, "tile": (2, 5)}])
def test_hard_negatives(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) + 0.5).astype(np.float32).tolist(), int(i % 4 if i % 3 else 1)) for i in range(220)]
    rows[120:130] = [(i, rows[7][1], i % 2) for i in range(120, 130)]  # ties
    rows += [rows[3], rows[3], rows[50]]  # repeats
    rows += [(250, None, 1), (300, [float("nan")] * 20, 1), (301, [None] * 20, 1), (350, rows[2][1], None), (None, rows[2][1], 1),
             (400, [1.0, 2.0], 1), (401, [1.0, 1.0], 1), (402, [2.0, 0.4], 2), (450, [], 1), (451, [], 1), (452, [], 2)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns(
        {c: F.lit("x") for c in ("_v", "_id", "rank", "_h", "_label", "anchor_id")}
    )
    got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, **blocks)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 5.0], 1), (2, [1.5e9, 7.0], 2), (3, [1e9, 0.0], 2)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0).collect()
    # Scores are beyond 64 bits: the nearest that fits stands for them, so no window of the clipped positive is met twice.
    assert all(r["positive_score"] == 2**63 - 1 for r in got)
    small = [(i, [x / 2**20 for x in v], g) for i, v, g in rows]
    table = spark.createDataFrame(small, "vec_id bigint, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 50 == 0).collect()) == mined(small)


# ---- prefix trie ----


def built(rows):
    own = {}
    for c, t, r, s in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", s or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children, out = {}, []
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)

    def under(n):
        leaves, saved = 0 if n in children else 1, (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
        for x in children.get(n, []):
            a, b = under(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children.get(n, [])), *under(n), sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows", [None, 1, 12])
def test_trie(spark, shard_rows):
    rng = random.Random(8)
    words = ["", "a", "b é😀", "long " * 40]
    rows = []
    for c in [*range(0, 130), 205, 230, 300, *range(1000, 1030)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if t else "user", rng.choice(words) if t > 1 else "hello"))
    rows += [(None, 0, "user", "x"), (500, 0, None, None)] + [(c, t, "user", f"same {t}") for c in range(700, 760) for t in range(4)]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn: the order is the contract's
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("depth", "digest", "_base", "_rank", "length", "shard")})
    got = sorted((tuple(r) for r in prefix_trie.trie(table, shard_rows=shard_rows).collect()), key=str)
    assert got == built(rows)
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_trie_repeated_turns(spark):
    rows = [(c, t, "user", s) for c in (1, 2, 3) for t, s in ((0, "x"), (0, "x"), (0, "y"), (None, "z"))]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS))
    again = prefix_trie.trie(spark.createDataFrame(rows[::-1], TURNS))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert got.agg(F.max("depth")).first()[0] in (3, 4) and got.filter("depth = 0").first()["n_convs"] == 3


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    trie = prefix_trie.PerfectHash(keys)
    slots = trie.slots(keys)
    assert sorted(slots) == list(range(5000)) and (trie.table[slots] == keys).all()
    assert (trie.slots(rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)) == -1).all()
    assert len(prefix_trie.PerfectHash(keys[:0]).slots(keys[:0])) == 0
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.vstack([keys[:3], keys[:1]]))


def test_members_are_hashed_in_pieces(spark):
    rows = [(i, 0, 0, b"\0" * 16, b"\0" * 16, 0) for i in range(-20, 300)]
    paths = spark.createDataFrame(rows, "conv_id bigint, depth int, length int, digest binary, parent binary, chars bigint")
    got = prefix_trie.ends(paths.repartition(5), block=7).toPandas()
    assert got["ends_sha256"].tolist() == [sha(",".join(str(i) for i in range(-20, 300)))]
    assert isinstance(got, pd.DataFrame)
