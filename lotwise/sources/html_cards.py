"""Card list pages: options of the series menu and card blocks, read with a tolerant parser, many rows from one page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def all(self, tag: str | None = None, cls: str | None = None) -> Iterator[Node]:
        for p in self.parts:
            if isinstance(p, Node):
                if (tag is None or p.tag == tag) and (cls is None or cls in p.attrs.get("class", "").split()):
                    yield p
                yield from p.all(tag, cls)

    def one(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next(self.all(tag, cls), None)

    def text(self, skip: tuple[str, ...] = ()) -> str | None:
        def walk(n: Node) -> Iterator[str]:
            for p in n.parts:
                if isinstance(p, str):
                    yield p
                elif p.tag not in skip:
                    yield from walk(p)

        return re.sub(r"\s+", " ", " ".join(walk(self))).strip() or None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


class SeriesOptions:
    """Options of the select named series, without the one for all."""

    def eval(self, html: str):
        for s in tree(html).all("select"):
            if s.attrs.get("name") == "series":
                for o in s.all("option"):
                    value, label = o.attrs.get("value", "").strip(), o.text()
                    if value and value != "ALL" and label:
                        yield value, tree(label).text()


_FIELDS = {"cost": "card_cost", "power": "card_power", "counter": "card_counter", "color": "card_color", "block": "card_block", "feature": "card_feature", "text": "card_effect", "getInfo": "card_get_info"}


class CardBlocks:
    """One row per dl.modalCol that has an id and at least three information spans; headings inside fields are dropped and the attribute
    is the picture's alt text where there is one."""

    def eval(self, html: str, url: str):
        for dl in tree(html).all("dl", "modalCol"):
            own = dl.attrs.get("id", "").strip()
            head = dl.one("dt")
            info = head.one(cls="infoCol") if head else None
            spans = [s.text() for s in info.all("span")] if info else []
            if not own or len(spans) < 3:
                continue
            name = head.one(cls="cardName")
            front, back = dl.one(cls="frontCol"), dl.one(cls="backCol")
            image = front.one("img") if front else None
            src = (image.attrs.get("data-src") or image.attrs.get("src")) if image else None

            def field(cls: str, back: Node | None = back) -> str | None:
                n = back.one(cls=cls) if back else None
                return n.text(skip=("h3",)) if n else None

            attribute = back.one(cls="attribute") if back else None
            icon = attribute.one("img") if attribute else None
            kind = (icon.attrs.get("alt", "").strip() or None) if icon else None
            yield (own, *spans[:3], name.text() if name else None, urljoin(url or "", src) if src else None, kind or field("attribute"), *[field(c) for c in _FIELDS])


def series_options():
    """The table function (html) -> (series_id, series_name); needs a session."""
    return udtf(SeriesOptions, returnType=_texts("series_id", "series_name"))


def card_blocks():
    """The table function (html, url) -> card fields; needs a session."""
    return udtf(CardBlocks, returnType=_texts("official_card_id", "card_code", "rarity", "category", "name", "image_url", "card_attribute", *_FIELDS.values()))


def list_cards(pages: DataFrame) -> DataFrame:
    """Card rows of list pages (series_id, series_name, url, html): code, set, variant by the picture's suffix; the first of each
    (card, series, get info) stays."""
    from ..functions import text as X
    from ..operators.records import keep_first

    spark = pages.sparkSession
    spark.udtf.register("lotwise_card_blocks", card_blocks())
    pages.createOrReplaceTempView("lotwise_pages")
    rows = spark.sql("SELECT p.series_id, p.series_name, p.url, c.* FROM lotwise_pages p, LATERAL lotwise_card_blocks(p.html, p.url) c")
    rows = rows.withColumn("card_id", F.concat("official_card_id", F.lit("-ja"))).withColumn("set_id", X.set_from_code("card_code")).withColumn("variant", X.image_suffix_or_base("image_url"))
    return keep_first(rows, ["official_card_id", "series_id", "card_get_info"], ["url", "card_code"])


def expected_counts(pages: DataFrame) -> DataFrame:
    """(series_id, expected): the number in .countCol of each list page."""
    n = F.regexp_extract("html", r'(?s)class="[^"]*countCol[^"]*"[^>]*>[^0-9<]*(?:<[^>]*>[^0-9<]*)*(\d+)', 1)
    return pages.select("series_id", n.try_cast("int").alias("expected"))
