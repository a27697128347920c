"""A Python data source that fetches JSON documents by GET.

    spark.dataSource.register(HttpJson)
    spark.read.format("http_json").option("urls", "\\n".join(urls)).load()

Each URL is a partition and a row (url, body); any failed request, any status but 2xx, any body that is
not JSON or has over ``maxBytes`` bytes (64 MB) and any scheme but http and https give a null body, so that the caller falls
back to a default document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.timeout = float(options.get("timeout", "10"))
        self.most = int(options.get("maxBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str | None]]:
        url = partition.value
        try:
            if not url.lower().startswith(("http://", "https://")):
                raise ValueError(url)
            with urlopen(Request(url, headers={"Cache-Control": "no-store"}), timeout=self.timeout) as response:
                read = response.read(self.most + 1)
            if len(read) > self.most:
                raise ValueError(url)
            body = read.decode("utf-8")
            json.loads(body)
        except (OSError, ValueError):
            body = None
        yield url, body
