"""Requests for recommendations, answered from a pool of results that lives in the state of a stream.

Events are results and requests of a preset and a number of games.  A key's
state is a bounded list of results, the latest one, and a cursor that goes round
and takes nothing away.  A request gets the result at the cursor, else the latest
one, else ``bootstrap``: then the batch makes one from few samples.  What a pool
lacks is made after each batch and comes back as an event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Samples of a result that somebody waits for; results a pool should and can hold.
BOOTSTRAP_SAMPLES, TARGET, MOST = 6000, 4, 8
EVENTS = "kind string, preset string, games int, id long, payload string"
_ANSWERS = "preset string, games int, id long, source string, payload string, missing int"
_STATE = "cursor int, latest string, results array<string>"


def answered(events: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """``preset``, ``games``, ``id``, ``source`` (pool, latest, bootstrap or, a row a key and batch, status), ``payload``,
    ``missing`` (how many results the pool is short of).  In a batch results come before requests, requests by ``id``.
    """
    if not 0 <= target <= max(most, 0):
        raise ValueError("the target must be from 0 to the most a pool holds")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, latest, results = state.get if state.exists else (0, None, [])
        results = list(results)
        rows = pd.concat(list(parts)).sort_values(["kind", "id"], ascending=[False, True], kind="stable")  # results before requests
        out = []
        for r in rows.itertuples():
            if r.kind == "result":
                if len(results) < most:
                    results.append(r.payload)
                latest = r.payload
            elif results:
                cursor %= len(results)
                out.append((r.id, "pool", results[cursor]))
                cursor = (cursor + 1) % len(results)
            else:
                out.append((r.id, "latest", latest) if latest is not None else (r.id, "bootstrap", None))
        out.append((-1, "status", None))
        state.update((cursor, latest, results))
        ids, sources, payloads = zip(*out, strict=True)
        yield pd.DataFrame({"preset": key[0], "games": key[1], "id": ids, "source": sources, "payload": payloads, "missing": max(0, target - len(results))})

    # results sort after requests by name; kinds are turned round so that they come first
    turned = events.withColumn("kind", F.when(F.col("kind") == "result", "result").otherwise("ask"))
    return turned.groupBy("preset", "games").applyInPandasWithState(step, _ANSWERS, _STATE, "append", GroupStateTimeout.NoTimeout)


def serve_stream(
    spark: SparkSession, events: str, answers: str, checkpoint: str, make: Callable[[str, int, int | None, int], str], target: int = TARGET, most: int = MOST
) -> StreamingQuery:
    """Starts a query over the event files in ``events`` that writes ``answers`` and keeps the pools filled.

    ``make(preset, games, samples, seed)`` gives a result (``samples`` is null
    for the preset's own).  Results are written as events, so a query that is
    started again has them; a batch that is repeated writes its files anew
    under the same names.
    """
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").json(events)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.collect()  # the answers of one batch and a row a key
        keys = {(r.preset, r.games): r.missing for r in rows}
        told, results = [], []
        first = {}
        for r in rows:
            key = (r.preset, r.games)
            if r.source == "bootstrap" and key not in first:
                first[key] = make(*key, BOOTSTRAP_SAMPLES, number)
                results.append((*key, first[key]))
            if r.source != "status":
                told.append((r.preset, r.games, r.id, r.source, first[key] if r.source == "bootstrap" else r.payload))
        for key, missing in sorted(keys.items()):
            if missing > (key in first):  # one more a batch: the pool fills as the stream goes on
                results.append((*key, make(*key, None, number)))
        if told:
            session.createDataFrame(told, "preset string, games int, id long, source string, payload string").coalesce(1).write.mode("overwrite").json(f"{answers}/batch={number}")
        if results:
            made = [("result", p, g, number, x) for p, g, x in results]
            session.createDataFrame(made, EVENTS).coalesce(1).write.mode("overwrite").json(f"{events}/made/batch={number}")

    return answered(stream, target, most).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
