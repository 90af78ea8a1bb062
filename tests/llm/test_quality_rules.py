import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import quality_rules as Q
from lotwise.llm import words as W

from .conftest import prose, table


def plain_stats(text):
    words = re.findall(r"[0-9A-Za-z]+", text)
    low = [w.lower() for w in words]
    n, size = len(words), len(text)
    letters = [c for c in text if c.isalpha()]
    return {
        "n_words": n,
        "mean_word": sum(map(len, words)) / max(1, n),
        "symbol_share": sum(not c.isalnum() and not c.isspace() for c in text) / max(1, size),
        "upper_share": sum(c.isupper() for c in letters) / max(1, len(letters)),
        "digit_share": sum(c.isdigit() for c in text) / max(1, size),
        "unique_share": len(set(low)) / max(1, n),
        "repeat_share": sum(a == b for a, b in zip(low, low[1:])) / max(1, n),
        "line_words": n / (text.count("\n") + 1),
    }


def test_statistics():
    texts = ["Hello world, hello!\nBYE 42", "", "a a a b", "!!! ???"]
    got = np.concatenate([Q.stats_of(w, Q.Lexicon()) for w in W.split(pa.array(texts), 8)])
    for t, row in zip(texts, got):
        for k, v in plain_stats(t).items():
            assert abs(row[Q.STATS.index(k)] - v) < 1e-9, (t, k)


def corpus(rng, n):
    texts, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(40, 120))
        kind = rng.randrange(5)
        if kind == 0:
            words = [w + rng.choice(["###", "***"]) for w in words]
        if kind == 1:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "uglyword"]))
        texts.append(" ".join(words))
        labels.append((i + 1, int(kind != 0), int(kind == 1)))
    return texts, labels


def test_learned_list_catches_what_it_was_taught(spark):
    rng = random.Random(4)
    texts, labels = corpus(rng, 600)
    docs, lab = table(spark, texts), spark.createDataFrame(labels[:400], "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, lab)
    assert model.rules and len(model.lexicon.stems)
    rows = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    held = labels[400:]
    bad = [i for i, q, t in held if q == 0 or t == 1]
    good = [i for i, q, t in held if q == 1 and t == 0]
    assert sum(not rows[i].keep for i in bad) >= 0.95 * len(bad)
    assert sum(rows[i].keep for i in good) >= 0.98 * len(good)
    # the emitted expression names the first rule that holds, as plain code does
    x = np.array([[getattr(rows[i], s) for s in Q.STATS] for i in sorted(rows)])
    first = [next((r.name for r in model.rules if r.mask(x[j : j + 1])[0]), None) for j in range(len(x))]
    assert first == [rows[i].rule for i in sorted(rows)]


def test_covering_by_brute_force():
    """The best single condition is the one of most gain over all thresholds."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (40, len(Q.STATS))).astype(float)
    y = x[:, 3] >= 3
    gain, c = Q._best_condition(x, y, np.ones(40, bool))
    assert c == (Q.STATS[3], ">=", 2.5) and abs(gain - y.sum() * -np.log2(y.mean())) < 1e-9


def holds(conditions, row):
    return all((row[Q.STATS.index(s)] <= t) if op == "<=" else (row[Q.STATS.index(s)] >= t) for s, op, t in conditions)


def plain_list(x, y, max_rules=24, precision=0.9, max_conditions=4, least=5):
    """Sequential covering by loops over all statistics, thresholds and prefixes."""
    n = len(x)
    fold = [i % 3 == 2 for i in range(n)]
    left, grows, rules, failed = set(range(n)), set(range(n)), [], 0
    while len(rules) < max_rules and failed < 6:
        inside, conditions = [i for i in sorted(left & grows) if not fold[i]], []
        while len(conditions) < max_conditions and any(not y[i] for i in inside):
            pos = sum(y[i] for i in inside)
            best, found = 0.0, None
            for s in Q.STATS if pos else []:
                values = sorted({x[i][Q.STATS.index(s)] for i in inside})
                for op in ("<=", ">="):
                    for lo, hi in zip(values, values[1:]):
                        t = (lo + hi) / 2
                        covered = [i for i in inside if holds([(s, op, t)], x[i])]
                        p = sum(y[i] for i in covered)
                        gain = p * (np.log2(p / len(covered)) - np.log2(pos / len(inside))) if p else 0.0
                        if gain > best + 1e-12:
                            best, found = gain, (s, op, t)
            if found is None:
                break
            conditions.append(found)
            inside = [i for i in inside if holds([found], x[i])]
        if not conditions:
            break
        worth = []
        for m in range(1, len(conditions) + 1):
            covered = [i for i in left if fold[i] and holds(conditions[:m], x[i])]
            p = sum(y[i] for i in covered)
            worth.append(((2 * p - len(covered)) / len(covered) if covered else -1.0, -m))
        pruned = conditions[: -max(worth)[1]]
        covered = [i for i in left if holds(pruned, x[i])]
        held = [i for i in covered if fold[i]]
        if len(covered) < least or not held or any(sum(y[i] for i in c) < precision * len(c) for c in (held, covered)):
            grows -= {i for i in range(n) if holds(conditions, x[i])}
            failed += 1
            continue
        rules.append(pruned)
        left -= set(covered)
        if not any(y[i] for i in left):
            break
    return rules


@pytest.mark.parametrize("seed", range(8))
def test_lists_are_those_of_plain_covering(seed):
    """Growth, pruning, refused rules and their order, with ties and noise in the labels."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (150, len(Q.STATS))).astype(float)
    y = ((x[:, 1] >= 9) & (x[:, 4] <= 7)) | (x[:, 6] <= 1) | (x[:, 8] >= 11)
    y ^= rng.random(150) < 0.06
    got, want = Q.learn_list(x, y), plain_list(x.tolist(), y.tolist())
    assert [[(s, op, round(t, 9)) for s, op, t in r.conditions] for r in got] == [[(s, op, round(t, 9)) for s, op, t in r] for r in want]


def test_clashing_columns_of_labels(spark):
    rng = random.Random(4)
    texts, labels = corpus(rng, 300)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    clash = lab.withColumns({c: Q.F.lit("x") for c in ("text", "_o", "_quality", "_toxic", "lang")})
    assert Q.fit(table(spark, texts), clash).rules == Q.fit(table(spark, texts), lab).rules


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 0, 0), (1, None, None), (1, 1, 0), (3, 0, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for lab in (none, nulls):
        model = Q.fit(odd, lab)
        rows = Q.judge(odd, model).collect()
        assert len(rows) == odd.count()
        assert {r.doc_id for r in rows if r.rule == "no_words"} == {2, 3, 6, None}
        assert all(r.keep == (r.rule is None) for r in rows)
    assert Q.judge(empty, Q.fit(empty, nulls)).count() == 0
