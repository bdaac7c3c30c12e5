"""Column orders and row assignment where many columns or rows agree."""

import itertools
import random
from collections import Counter

from loomgraph.operators import resultsets as E

SCHEMA = "qid string, side string, row_no int, values array<string>"


def frame(spark, cases):
    rows = [(q, side, i, [str(x) for x in r]) for q, sides in cases.items() for side, rs in zip(("gold", "pred"), sides) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_accuracy(gold, pred):
    if len(gold) != len(pred) or (gold and len(gold[0]) != len(pred[0])):
        return 0
    want = Counter(map(tuple, gold))
    return int(any(Counter(tuple(r[i] for i in order) for r in pred) == want for order in itertools.permutations(range(len(gold[0])))))


def test_execution_accuracy_against_all_permutations(spark):
    rng = random.Random(3)
    cases = {}
    for q in range(60):
        width, n = rng.randint(1, 5), rng.randint(1, 6)
        gold = [[rng.randrange(2) for _ in range(width)] for _ in range(n)]
        order = rng.sample(range(width), width)
        pred = [[r[i] for i in order] for r in rng.sample(gold, n)]
        if q % 2:
            r, c = rng.randrange(n), rng.randrange(width)
            other = rng.randrange(n)
            pred[r][c], pred[other][c] = pred[other][c], pred[r][c]
        cases[f"q{q}"] = (gold, pred)
    # ten and twelve equal columns, alone and beside others that must stay where they are
    cases["ten"] = ([[i] * 10 for i in range(5)], [[i] * 10 for i in reversed(range(5))])
    wide = [[i, j] + [i] * 11 + [j] for i, j in [(0, 0), (0, 1), (1, 0), (1, 1)]]
    cases["wide"] = (wide, [r[::-1] for r in wide])
    want = {q: plain_accuracy(g, p) for q, (g, p) in cases.items() if q.startswith("q")} | {"ten": 1, "wide": 1}
    queries = spark.createDataFrame([(q, "g", "p", True, True) for q in cases], "qid string, gold_text string, pred_text string, gold_ok boolean, pred_ok boolean")
    got = {r["qid"]: r["ex"] for r in E.execution_accuracy(queries, frame(spark, cases)).collect()}
    assert got == want and set(want.values()) == {0, 1}


def test_equal_columns_give_one_order():
    same = {j: 0 for j in range(10)}
    pairs = {(i, j): "m" for i in range(10) for j in range(10) if i != j}
    assert len(E.column_orders(["x"] * 10, ["x"] * 10, pairs, pairs, same)) == 1
    assert E.column_orders(["x"], ["y"], {}, {}, {}) == [] and E.column_orders(["x"], [], {}, {}, {}) == []


def plain_lenient(gold, pred):
    free = [set(map(str, p)) for p in pred]
    if len(gold) != len(pred):
        return 0
    for g in gold:
        hit = next((i for i, p in enumerate(free) if set(map(str, g)) <= p), None)
        if hit is None:
            return 0
        free.pop(hit)
    return 1


def test_lenient_match_of_one_large_query(spark):
    rng = random.Random(7)
    cases = {"copies": ([[1, 2]] * 400, [[2, 1, 3]] * 400)}
    gold = [[i, rng.randrange(2)] for i in range(120) for _ in range(3)]
    cases["large"] = (gold, [[*g, rng.randrange(4)] for g in rng.sample(gold, len(gold))])
    for q in range(60):
        gold = [[rng.randrange(4)] for _ in range(rng.randint(1, 7))]
        cases[f"q{q}"] = (gold, [[rng.randrange(4), rng.randrange(4)] for _ in gold])
    got = {r["qid"]: r["match"] for r in E.lenient_match(frame(spark, cases)).collect()}
    assert got == {q: plain_lenient(g, p) for q, (g, p) in cases.items()}
    assert Counter(got.values())[1] > 5 and Counter(got.values())[0] > 5
