"""Label lookups: set aliases contained in a text, and scored search of a label in catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import filled, first_filled, truthy

#: Rows up to which an alias table is broadcast; a larger one is joined by word instead.
MOST_BROADCAST = 100_000
#: The least share of a lookup's words that lookup_score() gives anything for.
NAME_SHARE = 0.65


def alias_table(aliases: DataFrame, set_names: DataFrame | None = None) -> DataFrame:
    """(alias_key, set_id, alias, source, confidence): enabled aliases and, unpivoted, the name columns of a set-name map; of
    one key and set the first stays."""
    on = ~F.coalesce(F.lower(F.trim("enabled")).isin("0", "false", "no"), F.lit(False))
    rows = aliases.where(on).select("alias", "set_id", F.coalesce(filled("source"), F.lit("aliases")).alias("source"), F.coalesce(filled("confidence"), F.lit("manual")).alias("confidence"), F.lit(0).alias("_o"))
    if set_names is not None:
        names = set_names.select(first_filled("mapped_set_id", "set_id").alias("set_id"), F.coalesce(filled("confidence"), F.lit("name_map")).alias("confidence"), F.posexplode(F.array("set_name", "evidence_name", "evidence_source")).alias("_o", "alias"))
        rows = rows.union(names.select("alias", "set_id", F.lit("set_name_map"), "confidence", F.col("_o") + 1))
    keyed = rows.withColumn("alias_key", X.alias_key("alias")).withColumn("_set", X.match_set("set_id")).where((F.length("alias_key") >= 3) & F.col("_set").isNotNull())
    first = keyed.groupBy("alias_key", "_set").agg(F.min_by(F.struct("set_id", "alias", "source", "confidence"), "_o").alias("_r"))
    return first.select("alias_key", "_r.*")


def match_alias(texts: DataFrame, aliases: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(key, set_id, alias, alias_key): the longest alias that a text contains, of equals a high-confidence one."""
    t = texts.select(key, X.alias_key(text).alias("_t")).where("_t <> ''")
    return _contained(t, aliases, key)


def _contained(t: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    aliases = aliases.where("alias_key <> ''")
    small = len(aliases.select("alias_key").take(MOST_BROADCAST + 1)) <= MOST_BROADCAST
    if small:
        pairs = t.join(F.broadcast(aliases), F.contains("_t", F.col("alias_key")))
    else:  # every alias is found by its first three signs, or all of fewer
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_t") - (n - 1))), lambda i: F.col("_t").substr(i, F.lit(n)))
        short = [n for n in (1, 2) if not aliases.where(F.length("alias_key") == n).isEmpty()]
        cut = t.select(key, "_t", F.explode(F.array_distinct(F.concat(*[grams(n) for n in (*short, 3)]))).alias("_g"))
        pairs = cut.join(aliases.withColumn("_g", F.substring("alias_key", 1, 3)), "_g").where(F.contains("_t", F.col("alias_key")))
    score = F.struct(F.length("alias_key").alias("l"), (F.lower("confidence") == "high").cast("int").alias("h"), F.col("alias_key").alias("k"), F.col("set_id").alias("s"))
    best = pairs.groupBy(key).agg(F.max_by(F.struct("set_id", "alias", "alias_key"), score).alias("_b"))
    return best.select(key, "_b.*")


def longest_contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name): the longest name that a text contains as it stands, of equals the last by name."""
    t = texts.select(key, F.col(text).alias("_t"))
    n = names.select(F.col(name).alias("alias_key"), F.lit("").alias("confidence"), F.col(name).alias("set_id"), F.col(name).alias("alias"))
    return _contained(t, n, key).select(key, F.col("alias").alias(name))


def lookup_score(record: dict[str, Column], wanted: dict[str, Column], name_score: Column, title_score: Column, has_title: Column, label: Column) -> Column:
    """Score of a record for a lookup: equal product 1, equal id .99, equal set and number .96; with a set that differs 0; else the
    number must agree and names and titles decide. set_key and number are in compared form."""

    def same(k: str) -> Column:
        return F.coalesce(truthy(wanted[k]) & (record[k] == wanted[k]), F.lit(False))

    ws, wn, rs, rn = wanted["set_key"], wanted["number"], record["set_key"], record["number"]
    threshold = F.when(label, 0.12).otherwise(0.35)
    return (
        F.when(same("product_id"), 1.0)
        .when(same("canonical_id") | same("card_id"), 0.99)
        .when(ws.isNotNull() & wn.isNotNull(), F.when((rs == ws) & (rn == wn), 0.96).otherwise(0.0))
        .when(wn.isNull() | ~F.coalesce(wn == rn, F.lit(False)), 0.0)
        .when((name_score >= 0.99) & (title_score >= threshold), F.least(F.lit(0.95), 0.82 + title_score * 0.10))
        .when((name_score >= 0.99) & ~has_title, 0.72)
        .when((name_score >= 0.65) & (title_score >= 0.55), F.least(F.lit(0.90), 0.70 + title_score * 0.15))
        .otherwise(0.0)
    )


def lookup(records: DataFrame, lookups: DataFrame, k: int = 5) -> DataFrame:
    """The k best records for each lookup. A record can only score by an equal id, by set and number, or by number and name; equi-joins make
    the candidates of each, and no pair is scored twice. Ties go by language, having a product, a Japanese index, and row id.
    But for ids, records that score and rank alike form a class, of which the k first rows are enough, and lookups that ask the same are
    answered once: pairs grow with the classes, not with the rows of both sides."""
    record_cols = ["product_id", "canonical_id", "card_id", "set_id", "card_code", "name", "name_en", "name_ja", "product_name", "index_name", "language", "row_id"]
    wanted_cols = ["lookup_id", "product_id", "canonical_id", "card_id", "set_id", "card_code", "subject", "title", "language", "label"]
    place = {"_rl": X.candidate_language("r_language", "r_index_name"), "_rp": truthy("r_product_id").cast("int"), "_rj": F.coalesce(F.col("r_index_name").endswith("_ja"), F.lit(False)).cast("int")}
    r = records.select(*[F.col(c).alias(f"r_{c}") for c in record_cols], X.card_number("card_code").alias("_rn"), X.match_set("set_id").alias("_rs")).withColumns(place)
    q = lookups.select(*[F.col(c).alias(f"q_{c}") for c in wanted_cols], X.card_number("card_code").alias("_qn"), X.match_set("set_id").alias("_qs"), X.language_of("language").alias("_ql"), truthy("title").alias("_qt"), F.coalesce("label", F.lit(False)).alias("_qb"))
    fields = ("product_id", "card_id", "canonical_id")
    none, by_id, pairs = F.lit(None).cast("string"), F.lit(False), None
    for on in [truthy(f"q_{f}") & (F.col(f"r_{f}") == F.col(f"q_{f}")) for f in fields]:
        p = r.join(q.hint("merge"), on).where(~by_id)  # a hint to merge: both sides grow, and what is compressed well looks small enough to be broadcast
        by_id = by_id | F.coalesce(on, F.lit(False))
        pairs = p if pairs is None else pairs.union(p)
    score = lookup_score({f: F.col(f"r_{f}") for f in fields} | {"set_key": none, "number": none}, {f: F.col(f"q_{f}") for f in fields} | {"set_key": none, "number": none}, F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False))
    same = F.coalesce(F.col("_rl") == F.col("_ql"), F.lit(False)).cast("int")
    order = [F.desc("score"), F.desc("same"), F.desc("_rp"), F.desc("_rj"), F.col("r_row_id")]
    best = pairs.withColumn("score", score)
    # what is equal by an id scores more than by set or name, so of these the k best of a class stay enough when the former are left out
    for found, asked, keys in (_by_set(r, q, k), *[_by_class(r, q.where(F.col("_qt") == titled), k, titled) for titled in (False, True)]):
        ranked = found.withColumn("same", same).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k)
        ranked = ranked.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keys)], "score", *[c for c in r.columns if c not in keys])
        on = [asked[c].eqNullSafe(ranked[f"_c{i}"]) for i, c in enumerate(keys)]
        best = best.unionByName(asked.join(ranked.hint("merge"), on).where(~by_id).select(*best.columns))
    best = best.withColumn("score", F.round("score", 4)).where("score > 0").withColumn("same", same)
    best = best.select(F.col("q_lookup_id").alias("lookup_id"), "score", "same", "_rp", "_rj", "r_row_id", F.col("r_row_id").alias("row_id"), F.col("r_card_id").alias("card_id"), F.col("r_index_name").alias("index_name"))
    w = Window.partitionBy("lookup_id").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("lookup_id", "rank", "score", "row_id", "card_id", "index_name")


def _first(rows: DataFrame, keys: list[str], k: int, order: str) -> DataFrame:
    """The k first rows of each class, with their number."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_k") <= k)


def _by_set(r: DataFrame, q: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(candidates of each class of lookups, the lookups, what makes their class): equal set and number."""
    q, keys = q.where("_qn is not null and _qs is not null"), ["_qn", "_qs", "_ql"]
    first = _first(r.where("_rn is not null and _rs is not null"), ["_rn", "_rs", "_rl", "_rp", "_rj"], k, "r_row_id").drop("_k")
    pairs = first.join(q.select(*keys).distinct().hint("merge"), (F.col("_rn") == F.col("_qn")) & (F.col("_rs") == F.col("_qs")))
    return pairs.withColumn("score", F.lit(0.96)), q, keys


def _by_class(r: DataFrame, q: DataFrame, k: int, titled: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """The same by number and name, for lookups without a set. A record's set, product name and id count for lookups with a title only."""
    q, keys = q.where("_qs is null and _qn is not null"), ["_qn", "q_subject", "q_title", "_qt", "_qb", "_ql"]
    own = ["_rn", "r_name", "r_name_en", "r_name_ja", "r_product_name", "_rl", "_rp", "_rj", *(["r_set_id", "r_card_id"] if titled else [])]
    rest = [c for c in r.columns if c not in own]
    classes = _first(r.where("_rn is not null"), own, k, "r_row_id").withColumn("_rows", F.collect_list(F.struct(*rest)).over(Window.partitionBy(*own))).where("_k = 1").select(*own, "_rows")
    # folding and splitting run once per class, in Arrow batches and before the pairing; what compares them stays in the JVM
    own_title = X.tokens("r_set_id", "r_product_name", "r_card_id") if titled else F.array().cast("array<string>")
    c = classes.withColumns({f"_k_r_{n}": filled(X.lookup_key(f"r_{n}")) for n in ("name", "name_en", "name_ja")} | {"_tr": X.tokens("r_name", "r_name_en", "r_name_ja", "r_product_name"), "_sr": own_title})
    a = _first(q, keys, 1, "q_lookup_id").select(*keys).withColumns({"_k_q_subject": filled(X.lookup_key("q_subject")), "_tq": X.tokens("q_subject"), "_sq": X.tokens("q_title")})
    name_score = X.subject_similarity(F.array_compact(F.array("_k_q_subject")), F.array_compact(F.array("_k_r_name", "_k_r_name_en", "_k_r_name_ja")), F.col("_tq"), F.col("_tr"))
    pairs = _by_name(c, a).withColumn("_name", name_score).withColumn("_title", X.overlap(F.col("_sq"), F.col("_sr")))
    none = dict.fromkeys(("product_id", "canonical_id", "card_id"), F.lit(None).cast("string"))
    score = lookup_score(none | {"set_key": F.lit(None).cast("string"), "number": F.col("_rn")}, none | {"set_key": F.lit(None).cast("string"), "number": F.col("_qn")}, F.col("_name"), F.col("_title"), F.col("_qt"), F.col("_qb"))
    good = pairs.withColumn("score", score).where("score > 0")
    return good.select(*keys, "score", *own, F.explode("_rows").alias("_row")).select(*keys, "score", *own, "_row.*"), q, keys


def _by_name(r: DataFrame, q: DataFrame) -> DataFrame:
    """Pairs of one number whose names can score: NAME_SHARE of the lookup's words are the record's, or a key of one holds a key of the other.
    So many of a lookup's words are asked for (its longest) that one of them is shared if enough are; keys are found by three signs."""
    n = F.size("_tq")
    needed = F.greatest(F.lit(1), F.ceil(n * NAME_SHARE - 1e-9).cast("int"))
    longest = F.array_sort(F.transform("_tq", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    q = q.withColumn("_ask", F.coalesce(F.transform(F.slice(longest, 1, F.greatest(n - needed + 1, F.lit(0))), lambda x: x["w"]), F.array().cast("array<string>")))
    long = lambda *cs: F.filter(F.array_compact(F.array(*cs)), lambda k: F.length(k) >= 3)
    grams = lambda keys: F.array_distinct(F.flatten(F.transform(keys, lambda k: F.transform(F.sequence(F.lit(1), F.length(k) - 2), lambda i: F.substr(k, i, F.lit(3))))))
    heads = lambda keys: F.array_distinct(F.transform(keys, lambda k: F.substr(k, F.lit(1), F.lit(3))))
    rk, qk = long("_k_r_name", "_k_r_name_en", "_k_r_name_ja"), long("_k_q_subject")
    holds = lambda a, b: F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y)))
    words = F.size(F.array_intersect("_ask", F.coalesce("_tr", F.array().cast("array<string>")))) > 0

    def joined(rs: Column, qs: Column) -> DataFrame:
        """Pairs that share a number and one of these texts, each once."""
        # outer, as Spark would else make a filter of the arrays and push the folding, a Python function, into it below the classes
        left, right = r.withColumn("_a", rs).withColumn("_g", F.explode_outer("_a")), q.withColumn("_b", qs).withColumn("_h", F.explode_outer("_b"))
        return left.join(right.hint("merge"), (F.col("_rn") == F.col("_qn")) & (F.col("_g") == F.col("_h"))).where(F.get(F.array_intersect("_b", "_a"), F.lit(0)) == F.col("_g")).drop("_a", "_b", "_g", "_h")

    out = joined(F.col("_tr"), F.col("_ask"))
    out = out.union(joined(grams(rk), heads(qk)).where(~words & holds(rk, qk)))
    return out.union(joined(heads(rk), grams(qk)).where(~words & ~holds(rk, qk) & holds(qk, rk))).drop("_ask")


def label_lookup(texts: DataFrame, aliases: DataFrame, records: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(status per label, hits) of label texts (label_id, text): the set by alias or by its own code, the number from the text. Only
    labels with both are looked up; the others are insufficient_lookup_keys."""
    parsed = texts.select("label_id", "text", X.parse_label("text").alias("p"))
    found = match_alias(texts, aliases, "label_id", "text").select("label_id", F.col("set_id").alias("_alias"))
    q = parsed.join(found, "label_id", "left").select(F.col("label_id").alias("lookup_id"), F.coalesce("_alias", "p.set_id").alias("set_id"), F.col("p.card_number").alias("card_code"), F.col("p.subject").alias("subject"), F.col("p.set_title").alias("title"), F.col("p.language").alias("language"))
    none = F.lit(None).cast("string")
    ready = q.where("set_id is not null and card_code is not null").withColumns({"product_id": none, "canonical_id": none, "card_id": none, "label": F.lit(True)})
    hits = lookup(records, ready, k)
    n = hits.groupBy("lookup_id").agg(F.count("*").alias("n"))
    j = q.join(n, "lookup_id", "left")
    status = F.when(F.col("set_id").isNull() | F.col("card_code").isNull(), "insufficient_lookup_keys").when(F.col("n") > 0, "matched").otherwise("lookup_without_index_match")
    return j.select(F.col("lookup_id").alias("label_id"), "set_id", "card_code", status.alias("status")), hits


def caption(hit: Column) -> Column:
    """#rank | index | set-code | language | score | name, empty parts left out."""
    name = F.coalesce(filled(hit["name_ja"]), filled(hit["name_en"]), filled(hit["name"]), filled(hit["card_id"]), F.lit("unknown"))
    code = filled(F.concat_ws("-", filled(hit["set_id"]), filled(hit["card_code"])))
    bits = F.concat_ws(" | ", F.concat(F.lit("#"), hit["rank"].cast("string")), filled(hit["index_name"]), code, filled(hit["language"]), F.format_string("%.3f", F.coalesce(hit["score"], F.lit(0.0))), name)
    return F.when(hit.isNull(), "missing").otherwise(bits)


def without_found(catalog_hits: DataFrame, index_hits: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog hits whose keys no index hit has."""
    return catalog_hits.join(index_hits.select(*keys).distinct(), keys, "left_anti")
