"""Operator 3, quality rules: learned decision lists.

Sequential covering grows conjunctions of thresholds on document statistics from labelled documents, prunes them on
held-out ones and emits them as one ordered Spark conditional expression. The statistics come from one vectorised scan of
whole texts; one of them, lexicon_rate, weighs word stems that are typical of toxic labels.

Defined results: a document without words (null or empty text included) is rejected by the fixed rule "no_words"; a
document with a null doc_id is judged like any other; repeated rows are judged each; without labels, or with labels of one
class, only "no_words" exists; null labels count as good quality and as not toxic. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import DOC_COLUMNS, documents, released, small_batches, table

STATS = ["n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "unique_share", "repeat_share", "line_words", "lexicon_rate"]
#: Labelled documents that the fit reads at most, those of least hash.
MAX_TRAIN = 8000
STEM = 6


@dataclass
class Lexicon:
    """Hashes of word stems (the first STEM bytes), sorted, with their weights."""

    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, h: np.ndarray) -> np.ndarray:
        if not len(self.stems):
            return np.zeros(len(h))
        i = np.minimum(np.searchsorted(self.stems, h), len(self.stems) - 1)
        return np.where(self.stems[i] == h, self.weights[i], 0.0)


@dataclass
class Rule:
    name: str
    conditions: list[tuple[str, str, float]]  # (statistic, "<=" or ">=", threshold)

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for s, op, t in self.conditions:
            c = F.col(prefix + s)
            out = out & ((c <= F.lit(t)) if op == "<=" else (c >= F.lit(t)))
        return out

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, op, t in self.conditions:
            v = x[:, STATS.index(s)]
            out &= (v <= t) if op == "<=" else (v >= t)
        return out


@dataclass
class DecisionList:
    rules: list[Rule]
    lexicon: Lexicon

    def column(self, prefix: str = "") -> Column:
        """The name of the first rule that holds, null for documents that stay."""
        out = F.when(F.col(prefix + "n_words") == 0, F.lit("no_words"))
        for r in self.rules:
            out = out.when(r.column(prefix), F.lit(r.name))
        return out


def stem_hash(w: W.Words) -> np.ndarray:
    h = np.zeros(len(w.start), np.uint64)
    for j in range(STEM):
        at = w.start + j
        on = at < w.end
        h[on] = h[on] * np.uint64(1099511628211) + w.folded[at[on]].astype(np.uint64) + np.uint64(1)
    return W.mix(h)


def _share(top: np.ndarray, of: np.ndarray) -> np.ndarray:
    return top / np.maximum(of, 1)


def stats_of(w: W.Words, lexicon: Lexicon) -> np.ndarray:
    """The statistics of each document of a slice, in the order of STATS."""
    n = np.diff(w.at).astype(float)
    size = np.diff(w.byte_at)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return (c[w.byte_at[1:]] - c[w.byte_at[:-1]]).astype(float)

    raw = w.raw
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    digit = (raw >= 48) & (raw <= 57)
    n_upper, n_digit = per_doc(upper), per_doc(digit)
    n_symbol = per_doc(~(upper | lower | digit | space | (raw >= 128)))
    doc = w.doc_of_word()
    order = np.lexsort((w.h, doc)) if len(w.h) else np.zeros(0, np.int64)
    hs, dsort = w.h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (dsort[1:] != dsort[:-1])
    unique = np.bincount(dsort[new], minlength=w.docs)
    again = np.zeros(len(w.h), bool)
    again[1:] = (w.h[1:] == w.h[:-1]) & (doc[1:] == doc[:-1])
    word_bytes = np.bincount(doc, (w.end - w.start).astype(float), w.docs)
    lex = np.bincount(doc, lexicon.score(stem_hash(w)), w.docs)
    lines = per_doc(raw == 10) + 1
    return np.stack(
        [n, _share(word_bytes, n), _share(n_symbol, size), _share(n_upper, n_upper + per_doc(lower)), _share(n_digit, size), _share(unique, n), _share(np.bincount(doc, again, w.docs), n), n / lines, 1000 * _share(lex, n)],
        axis=1,
    )


def with_stats(docs: DataFrame, keep: list[str], lexicon: Lexicon, prefix: str) -> DataFrame:
    """The columns `keep` and the statistics of text, whose names get a prefix."""
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{prefix}{s}` double" for s in STATS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [stats_of(w, lexicon) for w in W.split(b.column(b.schema.get_field_index("text")))]
            x = np.concatenate(x) if x else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(x[:, i]) for i in range(len(STATS))], [*keep, *[prefix + s for s in STATS]])

    return kept.mapInArrow(released(scan), schema)


def learn_lexicon(texts: list[str], bad: np.ndarray, least_docs: int = 8, ratio: float = 5.0) -> Lexicon:
    """Stems in at least `least_docs` bad documents that are `ratio` times as frequent there as in the others."""
    seen = [[], []]
    for w in W.split(pa.array(texts, pa.large_string())):
        h, doc = stem_hash(w), w.doc_of_word()
        pair = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        is_bad = bad[w.first + pair[:, 0].astype(np.int64)]
        for c in (0, 1):
            seen[c].append(pair[is_bad == bool(c), 1])
    good_h, good_n = np.unique(np.concatenate(seen[0]), return_counts=True)
    bad_h, bad_n = np.unique(np.concatenate(seen[1]), return_counts=True)
    n1, n0 = max(1, bad.sum()), max(1, (~bad).sum())
    i = np.minimum(np.searchsorted(good_h, bad_h), max(0, len(good_h) - 1))
    also = np.where(good_h[i] == bad_h, good_n[i], 0) if len(good_h) else np.zeros(len(bad_h))
    odds = np.log((bad_n + 0.5) / (n1 + 1)) - np.log((also + 0.5) / (n0 + 1))
    use = (bad_n >= least_docs) & (odds >= np.log(ratio))
    return Lexicon(bad_h[use], odds[use])


def _best_condition(x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition of most FOIL gain on the covered rows, thresholds midway between neighbouring values."""
    p0, n0 = (y & inside).sum(), (~y & inside).sum()
    if not p0:
        return 0.0, None
    base, best, found = np.log2(p0 / (p0 + n0)), 0.0, None
    rows = np.flatnonzero(inside)
    for j, name in enumerate(STATS):
        v = x[rows, j]
        o = np.argsort(v, kind="stable")
        v, t = v[o], y[rows][o]
        p, n = np.cumsum(t), np.cumsum(~t)
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        for op, pp, nn in (("<=", p[cut], n[cut]), (">=", p0 - p[cut], n0 - n[cut])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-12:
                best, found = float(gain[k]), (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best, found


def learn_list(x: np.ndarray, y: np.ndarray, max_rules: int = 24, precision: float = 0.9, max_conditions: int = 4, least: int = 5) -> list[Rule]:
    """Sequential covering: two of three rows grow a rule, the third prunes it from its end; a rule is kept while it is
    `precision` right on the pruning rows and covers `least` rows."""
    fold = np.arange(len(x)) % 3 == 2
    left, rules, failed = np.ones(len(x), bool), [], 0
    grow = left.copy()  # rows of a rule that fails its pruning rows grow no further rule
    while len(rules) < max_rules and failed < 6:
        inside, conditions = left & grow & ~fold, []
        while len(conditions) < max_conditions and (~y & inside).any():
            _, c = _best_condition(x, y, inside)
            if c is None:
                break
            conditions.append(c)
            inside &= Rule("", [c]).mask(x)
        if not conditions:
            break

        def worth(cs: list) -> tuple[float, int]:
            m = Rule("", cs).mask(x) & left & fold
            p, n = int((y & m).sum()), int((~y & m).sum())
            return (p - n) / (p + n) if p + n else -1.0, -len(cs)

        pruned = max((conditions[: i + 1] for i in range(len(conditions))), key=worth)
        m = Rule("", pruned).mask(x) & left
        held = m & fold
        if m.sum() < least or not held.any() or (y & held).sum() < precision * held.sum() or (y & m).sum() < precision * m.sum():
            grow &= ~Rule("", conditions).mask(x)
            failed += 1
            continue
        rules.append(Rule(f"r{len(rules) + 1}_{pruned[0][0]}", pruned))
        left &= ~m
        if not (y & left).any():
            break
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DecisionList:
    """A decision list from the labelled documents of least hash, `max_train` at most. Every second one teaches the
    lexicon, the others the rules, so that lexicon_rate is honest where rules are learned."""
    picked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "_quality", "_toxic", F.xxhash64("doc_id", "text").alias("_o")).orderBy("_o", "_quality", "_toxic").toArrow()
    texts = [t or "" for t in rows["text"].to_pylist()]
    toxic = np.array([(t or 0) == 1 for t in rows["_toxic"].to_pylist()], bool)
    bad = toxic | np.array([q == 0 for q in rows["_quality"].to_pylist()], bool)
    if not bad.any() or bad.all():
        return DecisionList([], Lexicon())
    half = np.arange(len(texts)) % 2 == 0
    lexicon = learn_lexicon([t for t, a in zip(texts, half) if a], toxic[half])
    x = np.concatenate([stats_of(w, lexicon) for w in W.split(pa.array([t for t, a in zip(texts, half) if not a], pa.large_string()))] or [np.zeros((0, len(STATS)))])
    return DecisionList(learn_list(x, bad[~half]), lexicon)


def judge(docs: DataFrame, model: DecisionList) -> DataFrame:
    """doc_id, the statistics, the rule that rejects the document (null if none) and keep."""
    s = with_stats(documents(docs, "doc_id", "text"), ["doc_id"], model.lexicon, "")
    return s.withColumn("rule", model.column()).withColumn("keep", F.col("rule").isNull())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no rule rejects."""
    small_batches(spark)
    docs = documents(docs, *DOC_COLUMNS)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_stats(docs, DOC_COLUMNS, model.lexicon, "_s_").where(model.column("_s_").isNull()).select(*DOC_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
