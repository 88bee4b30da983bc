"""The portal's paginated listing as a Spark data source, read at once or as a stream of pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Keys under which a listing may hold its records, in order.
LIST_KEYS = ("dados", "data", "result", "resultado", "conjuntos", "items")

#: Partitions of a batch at most.
PARTS = 64


def records_of(payload: object) -> list[dict]:
    """The records of a listing: itself or the first list under a known key; only objects count."""
    found = payload if isinstance(payload, list) else []
    if isinstance(payload, dict):
        found = next((payload[k] for k in LIST_KEYS if isinstance(payload.get(k), list)), [])
    return [x for x in found if isinstance(x, dict)]


def detail_of(payload: object) -> dict:
    """A detail lookup's record: an object itself, a list's first item; anything else: none."""
    if isinstance(payload, list):
        payload = payload[0] if payload else {}
    return payload if isinstance(payload, dict) else {}


class Again(Exception):
    """An answer that another try may better."""


def fetch(url: str, headers: dict[str, str], timeout: float = 60) -> object:
    """The JSON at a url; ``Again`` for what passes (see ``retry_kind``), OSError for what does not."""
    if urlsplit(url).scheme not in ("http", "https"):
        return recorded(url)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        if error.code in (400, 404, 410):
            raise
        raise Again(f"HTTP {error.code}") from None
    except (urllib.error.URLError, TimeoutError, ValueError) as error:
        raise Again(type(error).__name__) from None


def recorded(url: str) -> object:
    """A recorded answer: the JSON in a file, or in the files of a folder that Spark wrote; a page that is not there is empty."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        return []
    inside = store.get_file_info(fs.FileSelector(path)) if kind == fs.FileType.Directory else []
    files = sorted(f.path for f in inside if not f.base_name.startswith(("_", "."))) if kind == fs.FileType.Directory else [path]
    said = b"".join(store.open_input_stream(f).readall() for f in files).strip()
    return json.loads(said) if said else []


class Page(InputPartition):
    """A page, or ``count`` from it on."""

    def __init__(self, number: int, count: int = 1):
        self.number, self.count = number, count


class PortalReader(DataSourceReader):
    """One partition per page."""

    def __init__(self, options: dict[str, str]):
        self.url, self.detail = options["url"], options.get("detail", "")
        self.headers = {"chave-api-dados-abertos": options["key"]} if options.get("key") else {}
        self.first, self.pages = int(options.get("first", "1")), int(options["pages"])
        self.asks, self.pause = int(options.get("asks", "7")), float(options.get("pause", "1"))

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(self.first, self.first + self.pages)]

    def ask(self, url: str) -> object:
        """What the portal answers, asked again while that may help; the last failure is raised."""
        for turn in range(self.asks):
            try:
                return fetch(url, self.headers)
            except Again:
                if turn + 1 == self.asks:
                    raise
                time.sleep(self.pause * (turn + 1))

    def listed(self, number: int) -> list[dict]:
        """A page's records; one that comes back empty is asked for again before that is believed."""
        records: list[dict] = []
        for turn in range(self.asks):
            records = records_of(self.ask(self.url.format(page=number)))
            if records:
                break
            time.sleep(self.pause * (turn + 1))
        return records

    def whole(self, record: dict) -> str:
        if self.detail and record.get("id"):
            record = {**record, "detalhe": detail_of(self.ask(self.detail.format(id=record["id"])))}
        return json.dumps(record, ensure_ascii=False)

    def read(self, partition: Page) -> Iterator[tuple]:
        for record in self.listed(partition.number):
            yield partition.number, None, self.whole(record)


class PortalStreamReader(PortalReader, DataSourceStreamReader):
    """Pages as offsets: {"pagina": the last page taken}. A batch is up to ``step`` pages, a partition each.

    With ``most`` greater than ``step`` each batch may be twice as long as the one before, up to ``most`` pages, so that a
    long listing does not take a batch, with what it costs beside its records, for every few pages. A longer batch is only
    offered if its last page has records, and is dealt out over ``PARTS`` partitions.

    The next batch is offered if the page behind the last one taken, or the one behind that, has records; if neither has,
    these two are offered once, so that the listing's end is on record. ``after`` says what was taken in earlier runs;
    Spark's checkpoint says so too, and a batch that it had begun is taken again first.
    Each page gives a row of its own without a record, that says how many it has.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__({"pages": "0", **options})
        self.step, self.taken = int(options.get("step", "8")), int(options.get("after", self.first - 1))
        self.size, self.most = self.step, max(self.step, int(options.get("most", "0")))
        self.end: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pagina": self.first - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.end is None:
            if any(self.listed(n) for n in (self.taken + 1, self.taken + 2)):
                size = self.size
                while size > self.step and not self.listed(self.taken + size):
                    size //= 2
                return {"pagina": self.taken + max(size, self.step)}
            self.end = self.taken + 2
        return {"pagina": self.end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["pagina"] > self.taken:
            self.taken, self.size = end["pagina"], min(2 * self.size, self.most)
        pages = end["pagina"] - start["pagina"]
        each = max(1, -(-pages // PARTS))
        return [Page(n, min(each, end["pagina"] + 1 - n)) for n in range(start["pagina"] + 1, end["pagina"] + 1, each)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for number in range(partition.number, partition.number + partition.count):
            records = self.listed(number)
            yield number, len(records), None
            for record in records:
                yield number, None, self.whole(record)


class PortalSource(DataSource):
    """``spark.read.format("portal")`` with options url (holding ``{page}``), detail (holding ``{id}``, optional), pages, first, key, asks, pause.

    ``spark.readStream.format("portal")`` takes step, most and after instead of pages. ``n`` is null but in a stream's row for a page.
    """

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "pagina int, n int, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PortalReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return PortalStreamReader(self.options)
