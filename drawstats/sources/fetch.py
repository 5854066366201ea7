"""A data source that fetches one JSON payload per round over HTTP, and the incremental update made with it.

``spark.read.format("draw_payloads")`` with options ``url``, ``first``, ``last``
and, if wanted, ``parameter``, ``workers``, ``timeout``, ``retries``, ``delay``,
``verify``.  Rounds are split over ``workers`` partitions; certificates are
verified unless ``verify`` is ``false``.  A body that is no JSON ends the read
with an error.

``spark.readStream`` of the same source follows the rounds: its offset is the
last round that was published, kept in the query's checkpoint, so that a query
that is started again goes on behind it.  ``first`` is where a new query begins
(1, if not given).
"""

from __future__ import annotations

import json
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .draws import PAYLOAD, latest_round, max_round, parsed_payload, upserted

#: Fixed value: the name of the query parameter that holds the round.
PARAMETER = "srchLtEpsd"


class FetchError(RuntimeError):
    """A payload that could not be fetched."""


def fetch(url: str, round_id: int, parameter: str = PARAMETER, timeout: float = 10.0, retries: int = 3, delay: float = 0.5, verify: bool = True) -> str:
    """The body for one round; waits twice as long after each failure."""
    context = None if verify else ssl._create_unverified_context()
    where = f"{url}?{urllib.parse.urlencode({parameter: round_id})}"
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(where, headers={"Accept": "application/json"}), timeout=timeout, context=context) as r:
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == retries:
                raise FetchError(f"round {round_id}: {e}") from e
            time.sleep(delay * 2**attempt)
    raise FetchError(f"round {round_id}: no attempt was made")


def decoded(body: str, round_id: int) -> dict:
    """The payload as JSON; FetchError if it is none, or no object."""
    try:
        out = json.loads(body)
    except ValueError as e:
        raise FetchError(f"round {round_id}: the answer is no JSON: {body[:80]!r}") from e
    if not isinstance(out, dict):
        raise FetchError(f"round {round_id}: the answer is no JSON object")
    return out


def published(payload: dict, round_id: int) -> bool:
    """Whether a payload has the draw of the round that was asked for."""
    rows = ((payload.get("data") or {}).get("list")) or []
    return bool(rows) and rows[0].get("ltEpsd") == round_id


class _Asking:
    """What the options say of how to ask."""

    def __init__(self, options: dict[str, str]):
        self.o = options

    def body(self, round_id: int) -> str:
        o = self.o
        body = fetch(o["url"], round_id, o.get("parameter", PARAMETER), float(o.get("timeout", 10)), int(o.get("retries", 3)), float(o.get("delay", 0.5)), o.get("verify", "true").lower() != "false")
        decoded(body, round_id)
        return body

    def split(self, first: int, last: int) -> list[InputPartition]:
        n = max(1, int(self.o.get("workers", 8)))
        size = max(1, -(-(last - first + 1) // n))
        return [InputPartition((i, min(i + size - 1, last))) for i in range(first, last + 1, size)]

    def rows(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        for r in range(partition.value[0], partition.value[1] + 1):
            yield r, self.body(r)


class _Reader(_Asking, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.split(int(self.o["first"]), int(self.o["last"])) or [InputPartition((1, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        return self.rows(partition)


class _StreamReader(_Asking, DataSourceStreamReader):
    """Offsets are ``{"round": n}``: all rounds up to ``n`` were given out."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"round": int(self.o.get("first", 1)) - 1}

    def latestOffset(self) -> dict:
        """The last published round, looked for from the last one known, by doubling steps and bisection."""
        begin = self.last if self.last is not None else self.initialOffset()["round"]
        self.last = latest_round(lambda r: published(decoded(self.body(r), r), r), begin + 1)
        return {"round": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last or 0, end["round"])
        return self.split(start["round"] + 1, end["round"])

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for rounds that were taken in."""


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "draw_payloads"

    def schema(self) -> str:
        return "asked int, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(dict(self.options))


def fetched(spark: SparkSession, url: str, first: int, last: int, **options: str) -> DataFrame:
    """Draws ``first`` to ``last``, in order; rounds without a draw are left out."""
    spark.dataSource.register(PayloadSource)
    df = spark.read.format("draw_payloads").options(url=url, first=str(first), last=str(last), **options).load()
    return parsed_payload(df).orderBy("round")


def mismatched(payloads: DataFrame, column: str = "payload", asked: str = "asked") -> DataFrame:
    """``asked``, ``got``: payloads that hold another round than was asked for, which ``parsed_payload`` leaves out."""
    got = F.get(F.from_json(F.col(column), PAYLOAD)["data"]["list"], F.lit(0)).ltEpsd
    return payloads.select(F.col(asked).alias("asked"), got.alias("got")).filter("got IS NOT NULL AND got <> asked")


def only_asked(payloads: DataFrame) -> DataFrame:
    """The draws of payloads; FetchError naming some rounds if any payload holds another round than was asked for."""
    wrong = mismatched(payloads).limit(5).collect()
    if wrong:
        raise FetchError("other rounds than asked for: " + ", ".join(f"{r.asked} gave {r.got}" for r in wrong))
    return parsed_payload(payloads)


def payload_stream(spark: SparkSession, url: str, first: int = 1, **options: str) -> DataFrame:
    """A stream of ``asked`` and ``payload`` for every round from ``first`` on, as rounds are published."""
    spark.dataSource.register(PayloadSource)
    return spark.readStream.format("draw_payloads").options(url=url, first=str(first), **options).load()


def updated(history: DataFrame | None, latest: Callable[[int], bool], get: Callable[[int, int], DataFrame], allow_bootstrap: bool = False) -> DataFrame:
    """``history`` with the rounds that are new.  Without a history the whole is fetched only if ``allow_bootstrap``."""
    last = max_round(history) if history is not None else 0
    if last <= 0 and not allow_bootstrap:
        raise FetchError("there is no history; a full fetch must be allowed")
    end = latest_round(latest, last + 1)
    if end <= last:
        return history
    new = get(last + 1, end)
    return upserted(history, new) if history is not None else new
