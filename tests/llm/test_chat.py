import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import chat

MESSAGES = "tree string, node long, parent long, role string, text string, score double, extra int"


def test_escapes_round_trip():
    random.seed(2)
    bits = ["\\", "### ", "</turn>", "\n", "a", ":", "### user: ", "é", "#", "<", "🙂"]
    for _ in range(2000):
        turns = [(random.choice(["user", "assistant", "a:b\\", ""]), "".join(random.choices(bits, k=random.randrange(8)))) for _ in range(random.randrange(1, 5))]
        _, _, formatted, loss = chat._conversation("t", 1, turns)
        n, turns_hash, chars, loss_hash, size = chat.read_back(formatted, loss)
        said = "".join(t for r, t in turns if r == "assistant")
        assert n == len(turns) and turns_hash == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert chars == len(said) and loss_hash == hashlib.sha256(said.encode()).hexdigest() and size == len(formatted)


def test_branches_are_ranked_by_mean_score(spark):
    random.seed(4)
    rows = []
    for tree in range(30):
        for node in range(random.randrange(1, 25)):
            parent = random.randrange(node) if node and random.random() < 0.9 else None
            rows.append((str(tree), node, parent, random.choice(["user", "assistant"]), f"m{node}", float(random.randrange(4)), 1))
    rows += [("lost", 5, 4, "user", "parent is missing", None, 1), (None, 0, None, None, None, 1.0, 1), (None, 1, 0, "assistant", "x", 1.0, 1), ("odd", None, None, "user", "no node", 1.0, 1)]
    expected = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in set(own) - {r[2] for r in own.values() if r[2] is not None}:
            path = [leaf]
            while own[path[-1]][2] is not None and own[path[-1]][2] in own:
                path.append(own[path[-1]][2])
            paths.append((-sum(own[n][5] or 0 for n in path) / len(path), leaf, [own[n] for n in reversed(path)]))
        for rank, (_, _, path) in enumerate(sorted(paths, key=lambda p: p[:2])[:2], 1):
            expected[tree, rank] = [(r[3] or "", r[4] or "") for r in path]
    repeated = rows[::3] + [(*r[:3], "zz", "never chosen", *r[5:]) for r in rows[::5] if r[4]]
    made = chat.format_paths(spark.createDataFrame(rows + repeated, MESSAGES), top=2).collect()
    got = {(r.tree, r.rank): [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat.TURN.finditer(r.formatted)] for r in made}
    assert got == expected and len(got) == len(made) and (None, 1) in got and sum(k[1] == 2 for k in got) > 15


def test_long_thread_and_turn_tables(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(700)] + [(2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "alone"), (3, None, "user", "b"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    told = {r.tree: r for r in chat.format_paths(chat.replies(df)).collect()}
    assert set(told) == {"1", "2", None, "3"}
    read = {k: chat.read_back(r.formatted, r.loss) for k, r in told.items()}
    assert read["1"][:2] == (700, hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns[:700]).encode()).hexdigest())
    assert read["2"][0] == 2 and read["3"][0] == 2 and read["3"][2] == 0 and read[None][2] == 5


def test_circle_and_empty(spark):
    circle = spark.createDataFrame([("t", 0, 1, "user", "a", 1.0, 1), ("t", 1, 0, "user", "b", 1.0, 1), ("t", 2, 0, "user", "c", 1.0, 1)], MESSAGES)
    with pytest.raises(ValueError):
        chat.chosen_paths(circle)
    assert chat.format_paths(circle.where("false")).count() == 0
    assert chat.replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).select(F.count("*")).first()[0] == 0
