"""A Python data source for paged REST sources: one input partition per page.

Pages come from a landing folder (page-<n>.json) by default, so jobs can be run again without the network; `endpoint` fetches
them over HTTP instead."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int, offset: int, length: int):
        super().__init__(number)
        self.number, self.offset, self.length = number, offset, length


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.size = int(options.get("pagesize", "100"))
        self.limit = int(options["limit"]) if options.get("limit") else None

    def _load(self, page: Page) -> dict:
        if self.o.get("folder"):
            path = os.path.join(self.o["folder"], f"page-{page.number}.json")
            if not os.path.exists(path):
                return {"rows": []}
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        query = urllib.parse.urlencode({"offset": page.offset, "length": page.length})
        with urllib.request.urlopen(f"{self.o['endpoint']}?{query}", timeout=30) as r:
            return json.load(r)

    def partitions(self) -> list[Page]:
        total = int(self._load(Page(0, 0, self.size)).get("total", 0))
        total = total if self.limit is None else min(total, self.limit)
        return [Page(i, a, min(self.size, total - a)) for i, a in enumerate(range(0, total, self.size))]

    def read(self, page: Page):
        for i, row in enumerate(self._load(page).get("rows", [])[: page.length]):
            yield page.offset + i, json.dumps(row, ensure_ascii=False)


class PagedJson(DataSource):
    """format("paged_json"): (ordinal, row as JSON text). Options folder or endpoint, pagesize, limit."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "ordinal bigint, row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
