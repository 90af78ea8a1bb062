import random

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import license_scan as L
from lotwise.llm import words as W

from .conftest import prose, table


def full_alignment(t, x):
    """(score, end cells) of the best local alignments of the same scheme, without a band."""
    s = np.zeros((len(t) + 1, len(x) + 1), int)
    for i in range(1, len(t) + 1):
        for j in range(1, len(x) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (2 if t[i - 1] == x[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    return int(s.max())


def matched(t, x):
    """Words in order that both have."""
    m = np.zeros((len(t) + 1, len(x) + 1), int)
    for i in range(1, len(t) + 1):
        for j in range(1, len(x) + 1):
            m[i, j] = max(m[i - 1, j], m[i, j - 1], m[i - 1, j - 1] + (t[i - 1] == x[j - 1]))
    return int(m[-1, -1])


def edited(rng, t, edits, longest):
    x = list(t)
    for _ in range(edits):
        i = rng.randrange(len(x))
        x[i : i + 1] = rng.choice([[], [99], [x[i], *(1000 + rng.randrange(999) for _ in range(rng.randrange(1, longest + 1)))]])
    return x


@pytest.mark.parametrize("seed", range(12))
def test_banded_alignment_is_the_full_one(seed):
    rng = random.Random(seed)
    t = [rng.randrange(50) + 1 for _ in range(20)]
    text = [100 + rng.randrange(50) for _ in range(7)] + edited(rng, t, 3, 2) + [100 + rng.randrange(50) for _ in range(5)]
    score, n, a, e = L.align(np.array(t, np.uint64), np.array(text, np.uint64), 7 - L.BAND, 7 + L.BAND)
    assert score == full_alignment(t, text) and 7 <= a < e <= len(text) - 5
    assert n <= matched(t, text[a:e]) and score <= 2 * n - (e - a - n)


@pytest.mark.parametrize("seed", range(30))
def test_edited_copies_are_reported_as_by_brute_force(seed):
    """Over random edits, insertions of up to 12 words among them: one row for each copy whose best alignment in full covers enough."""
    rng = random.Random(1000 + seed)
    names = [f"t{i}" for i in range(60)]
    index = L.TemplateIndex({"x": " ".join(names)})
    copies = [edited(rng, names, rng.randrange(1, 9), 12) for _ in range(3)]
    text = []
    for c in copies:
        text += [f"p{rng.randrange(10**6)}" for _ in range(150)] + [str(v) for v in c]
    got = L.scan_words(index, next(W.split(pa.array([" ".join(text)]))))
    x = next(W.split(pa.array([" ".join(text)]))).h
    want, at = [], 0
    for c in copies:
        part = x[at + 150 : at + 150 + len(c)]
        score = full_alignment(index.h[0], part)
        want.append((at + 150, at + 150 + len(c), score))
        at += 150 + len(c)
    for a, e, score in want:
        rows = [r for r in got if a <= r[4] and r[5] <= e]
        n = matched(index.h[0], x[a:e])
        if score >= 2 * L.COVERAGE * 60:  # so many words match at least
            assert len(rows) == 1 and rows[0][3] >= score / 2
            assert L.align(index.h[0], x[rows[0][4] : rows[0][5]], -80, 80)[0] == score
        assert len(rows) <= 1 and all(r[3] <= n and r[2] == r[3] / 60 >= L.COVERAGE for r in rows)
    assert all(any(a <= r[4] and r[5] <= e for a, e, _ in want) for r in got)


@pytest.mark.parametrize("inserted", [[6, 6], [12], [12, 12]])
def test_insertions_part_no_place(inserted):
    t = [f"t{i}" for i in range(60)]
    x = list(t)
    for i, n in enumerate(inserted):
        at = 20 * (len(inserted) - i)
        x[at:at] = [f"i{i}x{j}" for j in range(n)]
    index = L.TemplateIndex({"x": " ".join(t)})
    got = L.scan_words(index, next(W.split(pa.array([" ".join(["a", "b", *x, "c"])]))))
    assert got == [(0, 0, 1.0, 60, 2, 2 + len(x))]


def test_chains_follow_one_another():
    # two notices in a row are two chains; runs that go back in the template are none
    assert sorted(L.chains([0, 5], [0, 0], [5, 5])) == [(0, 0, 5), (5, 5, 5)]
    assert L.chains([0, 10, 30], [0, 8, 20], [5, 6, 9]) == [(0, 10, 20)]
    assert len(L.chains([0, L.GAP + 20], [0, 9], [5, 5])) == 2


def test_templates_are_found_where_they_stand(spark):
    rng = random.Random(2)
    notice = L.TEMPLATES["gpl-3.0-notice"]
    edited = notice.replace("General Public", "Generic Public")
    texts = [" ".join(prose(rng, 50)), " ".join(prose(rng, 30)) + "\n" + notice, edited + " " + " ".join(prose(rng, 30)), notice.upper(), "License", notice + " " + " ".join(prose(rng, 400)) + " " + notice]
    got = {(r.doc_id, r.template, r.start_word, r.end_word): r for r in L.scan(table(spark, texts)).collect()}
    n = len(W.words_of(np.frombuffer(notice.encode(), np.uint8), np.array([0, len(notice)])).h)
    assert {(i, a, e) for (i, t, a, e) in got if t == "gpl-3.0-notice"} == {(2, 30, 30 + n), (3, 0, n), (4, 0, n), (6, 0, n), (6, n + 400, 2 * n + 400)}
    r = got[(2, "gpl-3.0-notice", 30, 30 + n)]
    assert texts[1].encode()[r.start_byte : r.end_byte].decode() == notice.rstrip(".") and r.coverage == 1.0
    assert got[(3, "gpl-3.0-notice", 0, n)].matched_words == n - 1


def test_brute_force_over_all_templates(spark):
    """Every planted template is reported with full coverage, and plain prose with none."""
    rng = random.Random(3)
    texts, want = [], set()
    for i, (name, t) in enumerate(sorted(L.TEMPLATES.items())):
        texts.append(" ".join(prose(rng, 20 + i)) + " " + t + " " + " ".join(prose(rng, 20)))
        want.add((i + 1, name))
    texts += [" ".join(prose(rng, 300)) for _ in range(20)]
    rows = L.scan(table(spark, texts)).collect()
    assert want <= {(r.doc_id, r.template) for r in rows if r.coverage == 1.0}
    assert max(r.doc_id for r in rows) <= len(want) and {"apache-2.0-text", "mit-text", "gpl-3-text"} <= set(L.TEMPLATES)
    assert len({(r.doc_id, r.template, r.start_word) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(L.NOTICES))
@pytest.mark.parametrize("times", [2, 8, 30])
def test_notices_in_a_row_are_reported_each(name, times):
    index = L.TemplateIndex(L.TEMPLATES)
    text = "some words before\n" + "\n".join([L.TEMPLATES[name]] * times) + "\nand some after"
    t = index.names.index(name)
    n = len(index.h[t])
    got = sorted((c, a, e) for _, x, c, _, a, e in L.scan_words(index, next(W.split(pa.array([text])))) if x == t)
    assert got == [(1.0, 3 + i * n, 3 + (i + 1) * n) for i in range(times)]


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        L.TemplateIndex({"x": "two words"})


def test_odd_rows(spark, odd, empty):
    assert L.scan(odd).count() == 0 and L.scan(empty).count() == 0
    line = L.TEMPLATES["mit-notice"]
    rows = L.scan(table(spark, [(None, line), (1, line), (1, line)])).collect()
    assert sorted(str(r.doc_id) for r in rows if r.template == "mit-notice") == ["1", "1", "None"]
