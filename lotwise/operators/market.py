"""Price statistics over trades: outlier filter, trends, volumes, two-market comparison and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import date_label, dollars, price_jpy, price_usd
from ..functions.values import col, first_filled


def price_trades(trades: DataFrame, rate: Column | float) -> DataFrame:
    """Adds usd and jpy of every trade (price_format, price, currency)."""
    r = F.lit(rate) if isinstance(rate, (int, float)) else rate
    return trades.withColumn("usd", price_usd("price_format", "price", "currency", r)).withColumn("jpy", price_jpy("price_format", "price", "currency", r))


def fences(trades: DataFrame, keys: list[str], price: str = "usd") -> DataFrame:
    """(keys, total, q1, q3, iqr, lower, upper): quartiles with linear interpolation from four prices on, else least and greatest."""
    q = trades.groupBy(*keys).agg(F.count("*").alias("total_count"), F.percentile(price, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.min(price).alias("_lo"), F.max(price).alias("_hi"))
    many = F.col("total_count") >= 4
    q = q.withColumn("q1", F.when(many, F.col("_q")[0]).otherwise(F.col("_lo"))).withColumn("q3", F.when(many, F.col("_q")[1]).otherwise(F.col("_hi")))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.select(*keys, "total_count", "q1", "q3", "iqr", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_bound"), (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_bound"))


def mark_outliers(trades: DataFrame, keys: list[str], price: str = "usd") -> DataFrame:
    """Trades with their fences and kept. The fences, one row per key, are joined back rather than windowed, so that no key's
    trades must be sorted in one task."""
    j = trades.join(fences(trades, keys, price), keys)
    return j.withColumn("kept", (F.col(price) >= F.col("lower_bound")) & (F.col(price) <= F.col("upper_bound")))


def iqr_summary(trades: DataFrame, keys: list[str], order: str, price: str = "usd", at: str = "traded_at") -> DataFrame:
    """One row per key: counts, fences and statistics of the kept trades; the latest is the first kept one in feed order."""
    m = mark_outliers(trades, keys, price)
    on = F.col("kept")
    v = F.when(on, F.col(price))
    return m.groupBy(*keys).agg(
        F.first("total_count").alias("total_count"),
        F.count_if(on).alias("kept_count"),
        F.count_if(~on).alias("dropped_count"),
        F.first("q1").alias("q1"),
        F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.first("lower_bound").alias("lower_bound"),
        F.first("upper_bound").alias("upper_bound"),
        F.coalesce(F.min_by(v, F.when(on, F.col(order))), F.lit(0.0)).alias("latest"),
        F.min_by(F.when(on, F.col(at)), F.when(on, F.col(order))).alias("latest_at"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("average"),
        F.coalesce(F.percentile(v, 0.5), F.lit(0.0)).alias("median"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
    )


def daily(trades: DataFrame, keys: list[str], at: str, price: str) -> DataFrame:
    """(keys, day, average, volume)."""
    return trades.groupBy(*keys, F.to_date(at).alias("day")).agg(F.avg(price).alias("average"), F.count("*").alias("volume"))


def after_last_gap(days: DataFrame, keys: list[str], day: str = "day", gap: int = 60) -> DataFrame:
    """Only the days after the last break of `gap` days and more."""
    w = Window.partitionBy(*keys).orderBy(day)
    x = days.withColumn("_break", F.when(F.datediff(day, F.lag(day).over(w)) >= gap, F.col(day)))
    return x.withColumn("_from", F.max("_break").over(Window.partitionBy(*keys))).where(F.col("_from").isNull() | (F.col(day) >= F.col("_from"))).drop("_break", "_from")


def pad_single(days: DataFrame, keys: list[str]) -> DataFrame:
    """A series of one day gets the day before and after, with its price and no volume."""
    n = F.count("*").over(Window.partitionBy(*keys))
    x = days.withColumn("_days", F.when(n == 1, F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).otherwise(F.array("day")))
    x = x.select(*keys, "day", "average", "volume", F.explode("_days").alias("_d"))
    return x.select(*keys, F.col("_d").alias("day"), "average", F.when(F.col("_d") == F.col("day"), F.col("volume")).otherwise(0).alias("volume"))


def in_grade(grade: Column, target: str, yen_market: bool) -> Column:
    """Whether a record belongs into the chart of a target grade."""
    g = F.coalesce(grade, F.lit("Ungraded"))
    if yen_market:
        wanted = ["S", "PSA10", "PSA 10"] if "10" in target or target.upper() == "S" else ["A"] if target.lower() in ("ungraded", "a") else [target, target.replace(" ", "")]
        return g.isin(wanted)
    return g == "PSA 10" if "10" in target else g != "PSA 10"


def trend(trades: DataFrame, keys: list[str], at: str = "traded_at", price: str = "usd", gap: int = 60) -> DataFrame:
    return pad_single(after_last_gap(daily(trades, keys, at, price), keys, gap=gap), keys)


def recent(trades: DataFrame, keys: list[str], at: str, price: str, as_of: Column, short: int = 30, long: int = 60) -> DataFrame:
    """(keys, volume of `short` days, average of `long` days) before as_of; the short window excludes its border, the long has it."""
    a, b = F.col(at) > as_of - F.make_interval(days=F.lit(short)), F.col(at) >= as_of - F.make_interval(days=F.lit(long))
    return trades.groupBy(*keys).agg(F.count_if(a).alias("recent_volume"), F.coalesce(F.avg(F.when(b, F.col(price))), F.lit(0.0)).alias("recent_average"))


def market_stats(trades: DataFrame, keys: list[str], at: str, price: str, as_of: Column) -> DataFrame:
    """(keys, entries, average, least, greatest, days since the first trade)."""
    return trades.groupBy(*keys).agg(F.count("*").alias("entries"), F.avg(price).alias("average"), F.min(price).alias("least"), F.max(price).alias("greatest"), F.datediff(F.to_date(as_of), F.to_date(F.min(at))).alias("span_days"))


def arbitrage(dollar_market: DataFrame, yen_market: DataFrame, rate: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, average_10, average_9, average_raw, max_10, profit) over both markets (grade, price), the second one in yen. Grading
    costs 35 and a tenth of the best price."""
    keys = keys or []
    g = F.coalesce(F.col("grade"), F.lit(""))
    a = dollar_market.select(*keys, F.col("price").cast("double").alias("p"), F.contains(g, F.lit("10")).alias("ten"), F.contains(g, F.lit("Ungraded")).alias("raw"), F.contains(g, F.lit("9")).alias("nine"))
    t = F.trim(g)
    b = yen_market.select(*keys, (F.col("price").cast("double") / F.lit(rate)).alias("p"), t.isin("S", "PSA10", "PSA 10").alias("ten"), t.isin("A", "Ungraded").alias("raw"), F.contains(g, F.lit("9")).alias("nine"))

    def mean(flag: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(flag), F.col("p"))), F.lit(0.0))

    out = a.unionByName(b).groupBy(*keys).agg(mean("ten").alias("average_10"), mean("nine").alias("average_9"), mean("raw").alias("average_raw"), F.coalesce(F.max(F.when(F.col("ten"), F.col("p"))), F.lit(0.0)).alias("max_10"))
    profit = F.when((F.col("max_10") > 0) & (F.col("average_raw") > 0), F.col("max_10") - (F.col("average_raw") + 35.0 + 0.10 * F.col("max_10"))).otherwise(0.0)
    return out.withColumn("profit", profit)


def top_prizes(prizes: DataFrame, price: str, order: str, k: int = 10) -> DataFrame:
    """The k dearest prizes with their sum."""
    top = prizes.orderBy(F.desc(price), order).limit(k)
    return top.withColumn("total", F.sum(price).over(Window.partitionBy(F.lit(1))))


def table_rows(records: DataFrame, keys: list[str], target: str | None, order: str, k: int = 10) -> DataFrame:
    """The first k records of the target grade per key, of all grades where it has none."""
    if target is None:
        use = records.withColumn("_on", F.lit(True))
    else:
        hit = F.col("grade").eqNullSafe(target)
        use = records.withColumn("_on", hit | (F.count_if(hit).over(Window.partitionBy(*keys)) == 0))
    w = Window.partitionBy(*keys).orderBy(order)
    return use.where("_on").withColumn("row", F.row_number().over(w)).where(F.col("row") <= k).drop("_on")


def poster_records(trades: DataFrame, grade: str, as_of: Column, yen_prices: bool = True) -> DataFrame:
    return trades.select(date_label("traded_at", as_of).alias("date"), F.lit(grade).alias("grade"), F.col("jpy" if yen_prices else "usd").alias("price"), F.lit("market").alias("source"))


def markdown(cards: DataFrame, trades: DataFrame, as_of: Column, rate: float, key: str = "product_id", conditions: tuple[tuple[str, str], ...] = (("A", "Raw / A"), ("PSA 10", "PSA 10")), shown: int = 10) -> DataFrame:
    """(key, report): heading, a summary table of the conditions and up to `shown` kept trades of each. trades has usd, condition,
    traded_at and ordinal; cards one row per key with name, set_id, card_code, language, variant."""
    s = iqr_summary(trades, [key, "condition"], "ordinal")
    kept = mark_outliers(trades, [key, "condition"]).where("kept")
    w = Window.partitionBy(key, "condition").orderBy("ordinal")
    line = F.concat(F.lit("- "), date_label("traded_at", as_of), F.lit("  "), dollars("usd"), F.lit(" USD"))
    lines = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shown).groupBy(key, "condition").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    blocks = s.join(lines, [key, "condition"], "left")

    def of(condition: str, c: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col(c)))

    row = F.concat_ws(" | ", dollars("latest", 0), dollars("average"), dollars("median", 0), dollars("min", 0), dollars("max", 0), F.concat("kept_count", F.lit("/"), "total_count"), F.col("dropped_count").cast("string"))
    blocks = blocks.withColumn("_row", row)
    wide = blocks.groupBy(key).agg(*[x for c, _ in conditions for x in (of(c, "_row").alias(f"_row_{c}"), of(c, "lines").alias(f"_lines_{c}"))])
    j = cards.join(wide, key, "left")
    dash = F.lit("-")
    head = [F.lit("# Market report"), F.lit(""), F.concat(first_filled("name", F.lit("Unknown Card")), F.lit(" #"), F.coalesce("card_code", dash)), F.concat(F.lit("Set: "), F.coalesce("set_id", dash)), F.concat(F.lit("Language: "), F.coalesce("language", dash)), F.concat(F.lit("Version: "), F.coalesce("variant", dash)), F.lit(""), F.lit("| Bucket | Latest | IQR avg | Median | Min | Max | Kept | Removed |"), F.lit("|---|---:|---:|---:|---:|---:|---:|---:|")]
    none = F.lit("$0 | $0.00 | $0 | $0 | $0 | 0/0 | 0")
    head += [F.concat(F.lit(f"| {label} | "), F.coalesce(F.col(f"`_row_{c}`"), none), F.lit(" |")) for c, label in conditions]
    head.append(F.lit(f"Rate: 1 USD = {rate:.4f} JPY."))
    for c, label in conditions:
        head += [F.lit(""), F.lit(f"## {label}"), F.coalesce(F.col(f"`_lines_{c}`"), F.lit("no trades"))]
    return j.select(key, F.array_join(F.array(*head), "\n").alias("report"))


def card_data(hits: DataFrame) -> DataFrame:
    """Poster fields of best hits."""
    name = first_filled("name", "name_en", "name_ja", F.lit("Unknown Card"))
    return hits.select("query_id", name.alias("name"), first_filled("name_ja", name).alias("local_name"), first_filled("card_code", F.lit("Unknown")).alias("number"), first_filled("set_id", F.lit("Unknown")).alias("set_code"), first_filled("rarity", "variant", F.lit("TCG")).alias("category"), F.coalesce("language", F.lit("")).alias("language"), first_filled("image_url", F.lit("")).alias("image_url"))


def product_of(hit: Column | str) -> Column:
    """Product id of a hit struct: the nested one, else the flat one."""
    h = col(hit)
    return F.coalesce(h["market"]["product_id"], h["market_product_id"])


def market_report(hits: DataFrame, trades: DataFrame, fx: DataFrame, as_of: Column, override: float | None = None) -> DataFrame:
    """(product_id, status, report): best hits (rank 1, market_product_id) with priced trades; rate by override, the fx row, or the
    default. Hits without a product have status missing_product_id and no report."""
    from ..functions.money import resolve_rate

    rate = fx.select(resolve_rate(F.lit(override).cast("double"), F.col("usd_jpy"))["rate"].alias("r")).first() if override is None else None
    r = float(override) if override else float(rate["r"]) if rate else 150.0
    top = hits.where("rank = 1").withColumnRenamed("market_product_id", "product_id")
    cards = top.where("product_id is not null").dropDuplicates(["product_id"])
    text = markdown(cards, price_trades(trades, r), as_of, r)
    done = text.select("product_id", F.lit("ok").alias("status"), "report")
    return done.union(top.where("product_id is null").select("product_id", F.lit("missing_product_id"), F.lit(None).cast("string")))
