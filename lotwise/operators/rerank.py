"""Boosts, blends and the choice among look-alikes, over hits (query_id, rank, score, ...)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import card_number, match_set


def _query(order: list[Column] | None = None) -> Window:
    w = Window.partitionBy("query_id")
    return w.orderBy(*order) if order else w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rerank(hits: DataFrame, k: int | None = None) -> DataFrame:
    """New ranks by score; equal scores keep their order."""
    out = hits.withColumn("rank", F.row_number().over(_query([F.desc("score"), F.col("rank")])))
    return out if k is None else out.where(F.col("rank") <= k)


def matches_code(set_id: Column | str, code: Column | str, wanted_set: Column | str, wanted_code: Column | str) -> Column:
    """Set and number equal in compared form; anything missing is no match."""
    return F.coalesce((match_set(set_id) == match_set(wanted_set)) & (card_number(code) == card_number(wanted_code)), F.lit(False))


def boost(hits: DataFrame, match: Column, by: float, prefix: str, family: Column, wanted_family: str = "pokemon") -> DataFrame:
    """Adds `by` to the score of matching rows of one family, keeps the former score beside it and ranks anew."""
    by = max(0.0, by)
    on = F.coalesce(match & (family == wanted_family), F.lit(False))
    out = hits.withColumn(f"{prefix}_match", on).withColumn(f"pre_{prefix}_score", F.when(on, F.col("score"))).withColumn(f"{prefix}_boost", F.when(on, by).otherwise(0.0))
    return rerank(out.withColumn("score", F.col("score") + F.col(f"{prefix}_boost")))


def language_boost(hits: DataFrame, language: Column, target: Column, family: Column, by: float = 0.08, wanted_family: str = "pokemon") -> DataFrame:
    """Boosts rows of the wished language, unless the best row is known to be of another family: then no score changes."""
    out = hits.withColumn("_family", family)
    top = F.first("_family").over(_query([F.col("rank")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    go = F.coalesce(top == wanted_family, F.lit(True))
    return boost(out.withColumn("_go", go), F.col("_go") & (language == target), by, "language", F.col("_family"), wanted_family).drop("_go", "_family")


def minmax_blend(hits: DataFrame, second: Column, weight: float = 0.40, k: int | None = None) -> DataFrame:
    """(1 - w) * score + w * second score scaled to 0..1 within the query; a missing second score, or all alike, counts 0."""
    w = min(1.0, max(0.0, weight))
    out = hits.withColumn("_s", second.cast("double"))
    low, high = F.min("_s").over(_query()), F.max("_s").over(_query())
    norm = F.when(F.col("_s").isNotNull() & (high - low > 1e-9), (F.col("_s") - low) / (high - low)).otherwise(0.0)
    out = out.withColumn("second_norm", norm).withColumn("embedding_score", F.col("score"))
    return rerank(out.withColumn("score", (1 - w) * F.col("score") + w * F.col("second_norm")).drop("_s"), k)


def visual_similarity(q: Column, c: Column, color_weight: float = 0.50) -> Column:
    """Blend of seven similarities of two signatures (hsv, rgb, regions, gray, edge, dhash, colorfulness)."""
    from .vectors import dot, hamming_similarity

    w = min(1.0, max(0.0, color_weight))
    regions = F.zip_with(q["regions"], c["regions"], lambda a, b: dot(a, b))
    region = F.aggregate(regions, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(regions))
    vivid = F.greatest(F.lit(0.0), 1 - F.abs(q["colorfulness"] - c["colorfulness"]) / 100)
    color = 0.45 * dot(q["hsv"], c["hsv"]) + 0.25 * dot(q["rgb"], c["rgb"]) + 0.25 * region + 0.05 * vivid
    structure = 0.45 * dot(q["gray"], c["gray"]) + 0.30 * dot(q["edge"], c["edge"]) + 0.25 * hamming_similarity(q["dhash"], c["dhash"])
    return F.struct((w * color + (1 - w) * structure).alias("visual"), color.alias("color"), structure.alias("structure"))


def visual_blend(hits: DataFrame, visual: Column, weight: float, k: int | None = None) -> DataFrame:
    """Blends where there is a visual score, leaves the other rows' scores as they are."""
    w = min(1.0, max(0.0, weight))
    out = hits.withColumn("_v", visual.cast("double")).withColumn("embedding_score", F.col("score")).withColumn("visual_applied", F.col("_v").isNotNull())
    return rerank(out.withColumn("score", F.when(F.col("_v").isNull(), F.col("score")).otherwise((1 - w) * F.col("score") + w * F.col("_v"))).drop("_v"), k)


def similarity_score(columns: list[str]) -> Column:
    """The score before boosts: the first given of those kept by the stages."""
    order = [c for c in ("pre_ocr_code_score", "pre_hint_code_score", "embedding_score", "pre_language_score", "score") if c in columns]
    return F.coalesce(*[F.col(c) for c in order], F.lit(0.0))


def select_ambiguous(hits: DataFrame, subject: Column, family: Column, language: Column, signal: Column, least: float = 0.70, margin: float = 0.04, limit: int = 6) -> DataFrame:
    """Per query with look-alikes of its best hit: status, recommended_id and the candidates' ids in rank order. A look-alike is
    another card of equal subject, and family and language equal or unknown, close in score or similarity, or either has a code
    signal. Queries without any, or whose best hit is weak, have no row."""
    full = _query([F.col("rank")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = hits.withColumn("_s", subject).withColumn("_f", family).withColumn("_l", language).withColumn("_g", F.coalesce(signal, F.lit(False))).withColumn("_m", similarity_score(hits.columns))
    x = x.withColumn("_t", F.first(F.struct("card_id", "score", "_s", "_f", "_l", "_g", "_m")).over(full))
    t = F.col("_t")

    def same(c: str) -> Column:
        return F.coalesce(F.col(c) == t[c], F.lit(True))

    close_score, close_sim = F.abs(t["score"] - F.col("score")) <= margin, F.abs(t["_m"] - F.col("_m")) <= margin
    code = F.col("_g") | t["_g"]
    joins = ~F.col("card_id").eqNullSafe(t["card_id"]) & F.coalesce(F.col("_s") == t["_s"], F.lit(False)) & same("_f") & same("_l") & (close_score | close_sim | code)
    strong = (t["score"] >= least) | (t["_m"] >= least)
    x = x.withColumn("_in", strong & ((F.col("rank") == 1) | joins)).where("_in")
    x = x.withColumn("_n", F.row_number().over(_query([F.col("rank")]))).where(F.col("_n") <= limit)
    g = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "card_id", F.col("_g").alias("signal")))).alias("_c"))
    g = g.where(F.size("_c") >= 2).withColumn("_e", F.filter("_c", lambda c: c["signal"]))
    one = F.size("_e") == 1
    return g.select("query_id", F.when(one, "resolved_by_card_code").otherwise("needs_user_choice").alias("status"), F.when(one, F.get("_e", F.lit(0))["card_id"]).otherwise(F.get("_c", F.lit(0))["card_id"]).alias("recommended_id"), F.transform("_c", lambda c: c["card_id"]).alias("candidates"))


def best_attempt(attempts: DataFrame, key: str, quality_rank: Column, order: str) -> DataFrame:
    """Per key the attempt of best quality rank, then confidence, then the first."""
    rest = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(quality_rank.alias("q"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col(order)).alias("o"))).alias("_b"))
    return best.select(key, "_b.*")


def recognize(
    vectors: DataFrame, queries: DataFrame, top_k: int = 5, per_index: int = 5, index_order: list[str] | None = None, hint: bool | Callable = False, language: bool = False,
    second: Callable | None = None, visual: Callable | None = None, ocr: bool | Callable = False, weight: float = 0.40, hint_by: float = 0.10, language_by: float = 0.08, ocr_by: float = 0.12,
) -> DataFrame:
    """The photo query from its vector on: per-index and merged search over the window that the stages need, card fields joined, then in
    this order the hint's code, the language, the second model (second(hits) adds a column second) or the signature (visual(hits) adds a
    column visual), and the code that was read; ranks are cut at top_k. hint, language and ocr take their columns from queries (hint_set,
    hint_code, hint_language, ocr_set, ocr_code); hint and ocr may be functions of the hits that give the match instead."""
    from ..functions.text import candidate_family, candidate_language
    from .vectors import candidate_window, merge, search

    inner, window = candidate_window(top_k, per_index, visual=bool(second or visual), ocr=bool(ocr), language=language, hint=bool(hint))
    hits = merge(search(vectors, queries, inner, most=window), window, index_order)
    fields = [c for c in ("card_id", "set_id", "card_code", "language", "game", "source", "name") if c in vectors.columns]
    hits = hits.join(vectors.select("index_name", "row_id", *fields), ["index_name", "row_id"])
    family = candidate_family([c for c in ("game",) if c in fields], F.col("index_name").cast("string"), [c for c in ("source",) if c in fields])
    own = candidate_language("language" if "language" in fields else F.lit(None).cast("string"), F.col("index_name").cast("string"))
    asked = [c for c in ("hint_set", "hint_code", "hint_language", "ocr_set", "ocr_code") if c in queries.columns]
    hits = hits.join(queries.select("query_id", *asked), "query_id", "left") if asked else hits

    def code_boost(hits: DataFrame, kind: bool | Callable, by: float, name: str) -> DataFrame:
        match = kind(hits) if callable(kind) else matches_code("set_id", "card_code", f"{name}_set", f"{name}_code")
        return boost(hits, match, by, f"{name}_code", family)

    if hint:
        hits = code_boost(hits, hint, hint_by, "hint")
    if language:
        hits = language_boost(hits, own, F.col("hint_language"), family, language_by)
    if second:
        hits = minmax_blend(second(hits), F.col("second"), weight)
    elif visual:
        hits = visual_blend(visual(hits), F.col("visual"), weight)
    if ocr:
        hits = code_boost(hits, ocr, ocr_by, "ocr")
    return hits.where(F.col("rank") <= top_k)


def code_signal(hits: DataFrame) -> Column:
    """Whether a hint's code or one that was read named the candidate."""
    have = [F.coalesce(F.col(c), F.lit(False)) for c in ("hint_code_match", "ocr_code_match") if c in hits.columns]
    return reduce(lambda a, b: a | b, have, F.lit(False))


def choose(hits: DataFrame, **limits: float) -> DataFrame:
    """select_ambiguous() over what recognize() gives: subjects by name, family and language by the card's fields, codes as signals."""
    from ..functions.text import candidate_family, candidate_language
    from ..functions.unicode import subject_key

    index = F.col("index_name").cast("string")
    keyed = hits.withColumn("_subject", subject_key(F.col("name")))
    return select_ambiguous(keyed, F.col("_subject"), candidate_family([c for c in ("game",) if c in hits.columns], index, [c for c in ("source",) if c in hits.columns]), candidate_language("language" if "language" in hits.columns else F.lit(None).cast("string"), index), code_signal(hits), **limits)


def recognize_cards(detections: DataFrame, vectors: DataFrame, most: int = 20, least: float = 0.0, **stages: object) -> DataFrame:
    """Photos with several cards: of detections (photo_id bigint, ordinal, confidence, center_x, center_y, height, vector) the most
    confident ones, each a query of its own, with photo_id, card_index (its place in reading order) and confidence_rank beside the hits."""
    from .geometry import most_confident, reading_order

    d = most_confident(detections, most, least)
    place = reading_order(d.select("photo_id", "ordinal", "center_x", "center_y", "height")).select("photo_id", "ordinal", F.col("reading_rank").alias("card_index"))
    # at most 100 detections of a photo are ranked, so seven bits hold the rank
    cards = d.join(place, ["photo_id", "ordinal"]).withColumn("query_id", F.col("photo_id").cast("bigint") * 128 + F.col("confidence_rank"))
    hits = recognize(vectors, cards, **stages)
    return hits.join(cards.select("query_id", "photo_id", "card_index", "confidence_rank"), "query_id")
