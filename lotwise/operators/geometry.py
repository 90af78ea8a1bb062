"""Polygons, boxes, detections and signatures of pictures. Columns where arithmetic will do; a fold over one photo's
detections (reading order, overlap suppression) and pixel work go through Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, once

POLYGON = "array<array<double>>"


def polygon_geometry(polygon: Column | str, width: Column | str, height: Column | str) -> Column:
    """Struct of box, ratios, centre and area ratio of a polygon [[x, y], ...]."""
    def shape(p: Column) -> Column:
        turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        cross = F.aggregate(F.zip_with(p, turned, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.transform(p, lambda q: q[0]).alias("xs"), F.transform(p, lambda q: q[1]).alias("ys"), F.size(p).alias("n"), (F.abs(cross) / 2).alias("area"))

    def measures(s: Column) -> Column:
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / s["n"]
        return F.struct(*[f(s[a]).alias(c) for c, f, a in (("l", F.array_min, "xs"), ("t", F.array_min, "ys"), ("r", F.array_max, "xs"), ("b", F.array_max, "ys"), ("x", mean, "xs"), ("y", mean, "ys"))], s["area"].alias("area"))

    def ratios(m: Column) -> Column:
        l, t, r, b, w, h = m["l"], m["t"], m["r"], m["b"], col(width), col(height)
        return F.struct(
            l.alias("left"), t.alias("top"), r.alias("right"), b.alias("bottom"), F.greatest(F.lit(0.0), r - l).alias("width"), F.greatest(F.lit(0.0), b - t).alias("height"),
            (l / w).alias("left_ratio"), (t / h).alias("top_ratio"), (r / w).alias("right_ratio"), (b / h).alias("bottom_ratio"),
            m["x"].alias("center_x"), m["y"].alias("center_y"), (m["area"] / F.greatest(F.lit(1), w * h)).alias("area_ratio"),
        )

    return once(col(polygon), lambda p: once(shape(p), lambda s: once(measures(s), ratios)))


def order_corners(polygon: Column | str) -> Column:
    """Corners as top left, top right, bottom right, bottom left, by the sum and difference of their coordinates."""
    total, slope = (lambda q: q[0] + q[1]), (lambda q: q[1] - q[0])

    def pick(p: Column, value: Callable[[Column], Column], least: bool) -> Column:
        ranked = F.transform(p, lambda q, i: F.struct(value(q).alias("v"), (i if least else -i).alias("i"), q.alias("q")))
        return (F.array_min(ranked) if least else F.array_max(ranked))["q"]

    return once(col(polygon), lambda p: F.array(pick(p, total, True), pick(p, slope, True), pick(p, total, False), pick(p, slope, False)))


def expand_polygon(polygon: Column | str, padding: float, width: Column | str, height: Column | str) -> Column:
    """Corners moved `padding` away from the centre, kept inside the picture."""
    p = col(polygon)
    if padding <= 0:
        return p
    mean = lambda p, i: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[i]) / F.size(p)

    def move(q: Column, c: Column) -> Column:
        d = F.greatest(F.sqrt((q[0] - c["x"]) * (q[0] - c["x"]) + (q[1] - c["y"]) * (q[1] - c["y"])), F.lit(1.0))
        far = lambda k: F.array(F.least(F.greatest(c["x"] + (q[0] - c["x"]) * k, F.lit(0.0)), col(width) - 1.0), F.least(F.greatest(c["y"] + (q[1] - c["y"]) * k, F.lit(0.0)), col(height) - 1.0))
        return once(d, lambda d: once((d + padding) / d, far))

    return once(p, lambda p: once(F.struct(mean(p, 0).alias("x"), mean(p, 1).alias("y")), lambda c: F.transform(p, lambda q: move(q, c))))


def box_polygon(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))


def _clamp(l: Column, t: Column, r: Column, b: Column, w: Column, h: Column) -> Column:
    l = F.greatest(F.lit(0), F.least(w - 2, l))
    t = F.greatest(F.lit(0), F.least(h - 2, t))
    return F.struct(l.alias("left"), t.alias("top"), F.greatest(l + 1, F.least(w, r)).alias("right"), F.greatest(t + 1, F.least(h, b)).alias("bottom"))


def trim_box(box: Column | str, width: Column | str, height: Column | str, aspect: float) -> Column:
    """Box (left, top, right, bottom, whole numbers) cut to an aspect about its centre, inside the picture."""
    x = col(box)
    bw, bh = x["right"] - x["left"], x["bottom"] - x["top"]
    nw = F.greatest(F.lit(1), F.bround(bh * aspect).cast("int"))
    nh = F.greatest(F.lit(1), F.bround(bw / aspect).cast("int"))
    l = F.floor((x["left"] + x["right"]) / 2).cast("int") - F.floor(nw / 2).cast("int")
    t = F.floor((x["top"] + x["bottom"]) / 2).cast("int") - F.floor(nh / 2).cast("int")
    wide = _clamp(l, x["top"], l + nw, x["bottom"], col(width), col(height))
    tall = _clamp(x["left"], t, x["right"], t + nh, col(width), col(height))
    bad = (bw <= 0) | (bh <= 0) | F.lit(aspect <= 0)
    same = F.struct(*[x[c].alias(c) for c in ("left", "top", "right", "bottom")])
    return F.when(bad, same).when(bw / bh > aspect, wide).otherwise(tall)


def expand_box(box: Column | str, width: Column | str, height: Column | str, ratio: float) -> Column:
    x = col(box)
    px, py = (F.bround((x[b] - x[a]) * ratio).cast("int") for a, b in (("left", "right"), ("top", "bottom")))
    return _clamp(x["left"] - px, x["top"] - py, x["right"] + px, x["bottom"] + py, col(width), col(height))


def ratio_box(width: Column | str, height: Column | str, left: float = 0.305, top: float = 0.2925, right: float = 0.695, bottom: float = 0.7075) -> Column:
    """Box at fixed shares of a picture."""
    w, h = col(width), col(height)
    return F.struct(F.bround(w * left).cast("int").alias("left"), F.bround(h * top).cast("int").alias("top"), F.bround(w * right).cast("int").alias("right"), F.bround(h * bottom).cast("int").alias("bottom"))


def explode_detections(results: DataFrame) -> DataFrame:
    """Detections of result rows (photo_id, detections array<struct<confidence, class_id, class_name, polygon>>) as rows."""
    return results.select("photo_id", F.posexplode("detections").alias("ordinal", "_d")).select("photo_id", "ordinal", "_d.*")


def most_confident(detections: DataFrame, k: int = 20, least: float = 0.0) -> DataFrame:
    """The k most confident detections of each photo with their confidence_rank."""
    w = Window.partitionBy("photo_id").orderBy(F.desc("confidence"), "ordinal")
    return detections.where(F.col("confidence") >= least).withColumn("confidence_rank", F.row_number().over(w)).where(F.col("confidence_rank") <= max(1, min(100, k)))


def order_rows(y: list[float], x: list[float], height: list[float]) -> list[tuple[int, int]]:
    """(place in reading order, row) of each item: items join the first row within reach of its running centre."""
    if not y:
        return []
    tall = sorted(max(1.0, h) for h in height)
    reach = max(16.0, 0.45 * tall[len(tall) // 2])
    rows: list[list] = []  # [centre, items]
    for i in sorted(range(len(y)), key=lambda i: y[i]):
        row = next((r for r in rows if abs(y[i] - r[0]) <= reach), None)
        if row is None:
            rows.append([y[i], [i]])
        else:
            row[1].append(i)
            row[0] = sum(y[j] for j in row[1]) / len(row[1])
    out = [(0, 0)] * len(y)
    place = 0
    for number, (_, items) in enumerate(sorted(rows, key=lambda r: r[0]), 1):
        for i in sorted(items, key=lambda i: x[i]):
            place += 1
            out[i] = (place, number)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("row", T.IntegerType())])))
def _places(y: pd.Series, x: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([[{"place": p, "row": r} for p, r in order_rows(list(a), list(b), list(c))] for a, b, c in zip(y, x, height)], index=y.index, dtype=object)


def reading_order(detections: DataFrame) -> DataFrame:
    """Detections (photo_id, ordinal, center_x, center_y, height) with reading_rank and row. A photo's detections become one row of
    arrays, so that the fold runs over many photos of an Arrow batch."""
    g = detections.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[F.col(c).cast("double").alias(c) for c in ("center_y", "center_x", "height")]))).alias("_d"))
    g = g.withColumn("_p", _places(F.col("_d.center_y"), F.col("_d.center_x"), F.col("_d.height")))
    flat = g.select("photo_id", F.explode(F.arrays_zip(F.col("_d.ordinal").alias("ordinal"), F.col("_p").alias("p"))).alias("_z"))
    return flat.select("photo_id", F.col("_z.ordinal").alias("ordinal"), F.col("_z.p.place").alias("reading_rank"), F.col("_z.p.row").alias("row"))


def suppress(boxes: np.ndarray, score: np.ndarray, iou: float, most: int) -> list[int]:
    """Greedy suppression of boxes (left, top, right, bottom) that overlap a better one by more than `iou`."""
    kept: list[int] = []
    area = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    for i in np.argsort(-score, kind="stable").tolist():
        if len(kept) >= most:
            break
        k = boxes[kept]
        w = np.maximum(0, np.minimum(k[:, 2], boxes[i, 2]) - np.maximum(k[:, 0], boxes[i, 0])) if kept else np.zeros(0)
        h = np.maximum(0, np.minimum(k[:, 3], boxes[i, 3]) - np.maximum(k[:, 1], boxes[i, 1])) if kept else np.zeros(0)
        both = w * h
        if not (both / np.maximum(area[kept] + area[i] - both, 1e-9) > iou).any():
            kept.append(i)
    return kept


_BOX = ["confidence", "left", "top", "right", "bottom"]


def suppress_overlaps(detections: DataFrame, iou: float = 0.1, least: float = 0.1, most: int = 20) -> DataFrame:
    """Detections (photo_id, ordinal, confidence, left, top, right, bottom) that survive, best first in each photo."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def keep(c: pd.Series, l: pd.Series, t: pd.Series, r: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([suppress(np.stack([np.asarray(v, float) for v in box[1:]], 1), np.asarray(box[0], float), iou, most) for box in zip(c, l, t, r, b)], index=c.index, dtype=object)

    g = detections.where(F.col("confidence") >= least).groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[F.col(c).cast("double").alias(c) for c in _BOX]))).alias("_d"))
    g = g.withColumn("_k", keep(*[F.col(f"_d.{c}") for c in _BOX]))
    return g.select("photo_id", F.explode(F.transform("_k", lambda i: F.get("_d", i))).alias("_z")).select("photo_id", "_z.*")


def longest_run(flags: Column | str) -> Column:
    """Share of the longest run of true values in an array of booleans."""
    f = col(flags)
    state = F.aggregate(f, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), lambda s, v: F.struct(F.when(v, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(v, s["run"] + 1).otherwise(0)).alias("best")))
    return state["best"] / F.greatest(F.lit(1), F.size(f))


def true_runs(flags: Column | str) -> Column:
    """Array of structs (start, end) of the runs of true values."""
    f = col(flags)
    at = F.sequence(F.lit(0), F.size(f))
    before = lambda i: F.coalesce(F.when(i > 0, F.get(f, i - 1)), F.lit(False))
    here = lambda i: F.coalesce(F.get(f, i), F.lit(False))
    starts = F.filter(at, lambda i: here(i) & ~before(i))
    ends = F.filter(at, lambda i: ~here(i) & before(i))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def slab_miss(box_ratio: Column, area_ratio: Column, aspect: Column) -> Column:
    """Whether a contour crop is more likely a part of a graded slab than a card: small, or far from a card's shape."""
    return (area_ratio < 0.18) | (aspect < 0.55) | (aspect > 0.90) | (box_ratio["top_ratio"] < 0.02)


def label_detection(width: Column, height: Column, area_ratio: Column) -> Column:
    """Whether a detection is the label above a card: wide and small."""
    return (width / height > 1.4) & (area_ratio < 0.25)


# pixels


def _open(content: bytes):
    from PIL import Image

    return Image.open(io.BytesIO(content))


def inspect(images: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height, image_format, is_valid_image, image_error and image_sha256 to rows with picture bytes. Needs the
    optional imaging library; without it every row says so in image_error."""
    kinds = "width int, height int, image_format string, is_valid_image boolean, image_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for c in p[content]:
                try:
                    im = _open(bytes(c))
                    im.verify()
                    rows.append((im.size[0], im.size[1], im.format, True, None))
                except Exception as e:  # noqa: BLE001 - a bad picture is a row, not a failure
                    rows.append((None, None, None, False, f"{type(e).__name__}: {e}"))
            got = pd.DataFrame(rows, columns=["width", "height", "image_format", "is_valid_image", "image_error"], index=p.index)
            yield pd.concat([p.drop(columns=[content]), got.astype({"width": "Int32", "height": "Int32"})], axis=1)

    keyed = images.withColumn("image_sha256", F.sha2(content, 256))
    rest = [f for f in keyed.schema if f.name != content]
    return keyed.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", " + kinds)


def shrink(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of a picture on a height x width grid."""
    ys = np.linspace(0, gray.shape[0], height + 1)
    xs = np.linspace(0, gray.shape[1], width + 1)

    def rows(a: np.ndarray, edge: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=float)])
        lo = np.floor(edge).astype(int).clip(0, len(a))
        part = edge - lo
        nxt = np.minimum(lo + 1, len(a))
        at = c[lo] + part.reshape(-1, *[1] * (a.ndim - 1)) * (c[nxt] - c[lo])
        return np.diff(at, axis=0) / np.diff(edge).reshape(-1, *[1] * (a.ndim - 1))

    return rows(rows(gray, ys).swapaxes(0, 1), xs).swapaxes(0, 1)


def signature(rgb: np.ndarray) -> dict:
    """Visual signature of an RGB picture: hsv, rgb, regional hsv, gray and edge vectors of length 1, difference hash, colourfulness."""
    h, w = rgb.shape[:2]
    cut = rgb[int(round(h * 0.06)) : max(int(round(h * 0.94)), 1), int(round(w * 0.05)) : max(int(round(w * 0.95)), 1)].astype(float)

    def unit(v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, float).ravel()
        return v / (np.linalg.norm(v) + 1e-9)

    def hsv(a: np.ndarray) -> np.ndarray:
        a = a / 255
        top, low = a.max(-1), a.min(-1)
        span = top - low
        safe = np.where(span > 0, span, 1)
        r, g, b = a[..., 0], a[..., 1], a[..., 2]
        hue = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
        sat = np.where(top > 0, span / np.where(top > 0, top, 1), 0)
        use = (sat > 0.12) & (top > 0.12) & (top < 0.98)
        if use.sum() < 100:
            use = np.ones_like(use)
        hist, _ = np.histogramdd(np.stack([np.where(span > 0, hue, 0)[use], sat[use], top[use]], 1), bins=(24, 6, 6), range=((0, 1),) * 3)
        return unit(hist)

    gray = cut @ np.array([0.299, 0.587, 0.114])
    small = shrink(gray, 44, 32)
    dy, dx = np.gradient(gray) if min(gray.shape) > 1 else (np.zeros_like(gray), np.zeros_like(gray))
    grid = shrink(gray, 8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    rg, yb = np.abs(cut[..., 0] - cut[..., 1]), np.abs((cut[..., 0] + cut[..., 1]) / 2 - cut[..., 2])
    third = max(1, cut.shape[0] // 3)
    code = int("".join("1" if b else "0" for b in bits), 2)
    return {
        "hsv": hsv(cut).tolist(),
        "rgb": unit(np.concatenate([np.histogram(cut[..., i], 32, (0, 255))[0] for i in range(3)])).tolist(),
        "regions": [hsv(cut[i * third : (i + 1) * third if i < 2 else None]).tolist() for i in range(3)],
        "gray": unit(small - small.mean()).tolist(),
        "edge": unit(shrink(np.hypot(dx, dy), 44, 32)).tolist(),
        "dhash": code - (1 << 64) if code >= 1 << 63 else code,
        "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
    }


_VECTOR = T.ArrayType(T.DoubleType())
SIGNATURE = T.StructType([T.StructField("hsv", _VECTOR), T.StructField("rgb", _VECTOR), T.StructField("regions", T.ArrayType(_VECTOR)), T.StructField("gray", _VECTOR), T.StructField("edge", _VECTOR), T.StructField("dhash", T.LongType()), T.StructField("colorfulness", T.DoubleType())])


@F.pandas_udf(SIGNATURE)
def signature_of(content: pd.Series) -> pd.DataFrame:
    """Signature of encoded pictures, nulls where a picture can't be read."""
    rows = []
    for c in content:
        try:
            rows.append(signature(np.asarray(_open(bytes(c)).convert("RGB"))))
        except Exception:  # noqa: BLE001 - an unreadable picture has no signature
            rows.append(dict.fromkeys(["hsv", "rgb", "regions", "gray", "edge", "dhash", "colorfulness"]))
    return pd.DataFrame(rows)


def embed(images: DataFrame, model: object, key: str, content: str = "content", batch: int = 64) -> DataFrame:
    """(key, embedding) of picture rows by any callable that maps a list of bytes to a matrix (null rows for what it can't read);
    vectors are brought to length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for a in range(0, len(p), batch):
                part = p.iloc[a : a + batch]
                m = np.asarray(model([bytes(c) for c in part[content]]), float)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(size > 0, size, 1)
                ok = ~np.isnan(m).any(1)
                yield pd.DataFrame({key: part[key][ok], "embedding": list(m[ok].astype(np.float32))})

    kind = dict(images.dtypes)[key]
    return images.select(key, content).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def crop_status(crops: DataFrame) -> DataFrame:
    return crops.groupBy("status").agg(F.count("*").alias("n"))
