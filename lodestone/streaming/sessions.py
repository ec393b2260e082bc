"""Sessions over a stream of queries: a memory for each of what it found, kept in Spark's state store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

HOT, HISTORY, RELATED = 100, 20, 0.9
STATE = "memory string"
OUT = "session long, seq long, related long, ef int, hits array<long>, n_hot int, queries long"


class Memory:
    """A session's hot ids with how often and how well they were found, its last queries, and its effort so far."""

    def __init__(self, hot: int = HOT, history: int = HISTORY, related: float = RELATED, base: int = 64) -> None:
        self.limit, self.length, self.like, self.base = hot, history, related, base
        self.hot: dict[int, list[float]] = {}
        self.history: list[tuple[int, list[float], list[int]]] = []
        self.queries = self.effort = 0

    def written(self) -> str:
        return json.dumps([list(self.hot.items()), self.history, self.queries, self.effort])

    def read(self, text: str) -> Memory:
        hot, self.history, self.queries, self.effort = json.loads(text)
        self.hot = {int(i): v for i, v in hot}
        return self

    def related(self, vector: list[float]) -> int | None:
        """The number of the last query whose cosine with ``vector`` is above the limit."""
        size = sum(x * x for x in vector) ** 0.5
        for seq, other, _ in reversed(self.history):
            both = size * sum(x * x for x in other) ** 0.5
            if both > 0 and sum(x * y for x, y in zip(vector, other)) / both > self.like:
                return seq
        return None

    def ef(self, vector: list[float]) -> int:
        """How far the search should go: less if a query like it came before or if hits are known, more in a session whose searches were dear."""
        mean = self.effort / self.queries if self.queries else 0.0
        ef = self.base * (1.3 if mean > 100 else 0.7 if 0 < mean < 30 else 1.0)
        return int(min(256, max(16, ef * (0.5 if self.related(vector) is not None else 1.0))))

    def update(self, seq: int, vector: list[float], found: list[int], effort: int) -> None:
        """After a search. A new id takes the place of the one of least quality (the first of them) once there are as many as fit."""
        for rank, i in enumerate(found):
            if i in self.hot:
                self.hot[i] = [self.hot[i][0] + 1, self.hot[i][1] + 1 / (rank + 1)]
            else:
                if len(self.hot) >= self.limit:
                    del self.hot[min(self.hot, key=lambda j: self.hot[j][1])]
                self.hot[i] = [1, 1.0]
        self.history = [*self.history[1 - self.length :], (seq, list(vector), list(found))] if self.length > 1 else [(seq, list(vector), list(found))]
        self.queries += 1
        self.effort += effort

    def step(self, seq: int, vector: list[float], found: list[int]) -> tuple[int | None, int, list[int]]:
        """The related query, the effort chosen, and those of ``found`` that were hot already; then the memory takes the query in."""
        related, ef = self.related(vector), self.ef(vector)
        hits = [i for i in found if i in self.hot]
        self.update(seq, vector, found, ef)
        return related, ef, hits


class SessionProcessor(StatefulProcessor):
    """Takes the queries of each session in the order of ``seq`` within a micro-batch; batches follow each other."""

    def __init__(self, **settings: Any) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        memory = Memory(**self.settings)
        if self.memory.exists():
            memory.read(self.memory.get()[0])
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, vector, found in zip(given["seq"], given["vector"], given["found"]):
            related, ef, hits = memory.step(int(seq), [float(x) for x in vector], [int(i) for i in found])
            out.append((key[0], int(seq), related, ef, hits, len(memory.hot), memory.queries))
        self.memory.update((memory.written(),))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
        frame["related"] = frame["related"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, **settings: Any) -> DataFrame:
    """(session, seq, related, ef, hits, n_hot, queries) for a stream of searches (session, seq, vector, found), found being the ids in the order of their rank.

    Each session's memory is a value in the state store, which a restart from the checkpoint goes on with. It is bounded:
    HOT ids and HISTORY queries. The state store must be RocksDB's.
    """
    rows = stream.select("session", "seq", "vector", "found")
    return rows.groupBy("session").transformWithStateInPandas(SessionProcessor(**settings), OUT, "Append", "None")


def searched_sessions(stream: DataFrame, search: Callable[[DataFrame], DataFrame], checkpoint: str, out: str, **settings: Any) -> StreamingQuery:
    """Searches every micro-batch of ``stream`` (session, seq, query_id, vector) by ``search``, as (query_id, rank, id, ...), and appends (session, seq, query_id, vector, found) to ``out``, from which ``remembered`` can go on."""
    from pyspark.sql import functions as F

    def each(batch: DataFrame, number: int) -> None:
        hits = search(batch.select("query_id", "vector")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
        rows = batch.join(hits, "query_id", "left").select("session", "seq", "query_id", "vector", F.coalesce("found", F.array().cast("array<long>")).alias("found"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again takes its own place

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
