"""The cache of answers over a stream of questions: state of each catalog version, bounded, oldest entries out first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Origins of answers that are never reused.
NEVER = ("nao_encontrado", "modo_reduzido", "descartada")


class Cache(StatefulProcessor):
    """Keeps up to ``most`` answered questions of a version, each with its vector, in the order they were answered."""

    def __init__(self, most: int, least: float):
        self.most, self.least = most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "quando bigint, qid bigint, vetor array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted((tuple(x) for x in self.held.get()), key=lambda x: x[:2])
        batch = pd.concat(list(rows)).sort_values(["quando", "qid"])
        out, stored = [], False
        for when, qid, vector, origin in zip(batch["quando"].tolist(), batch["qid"].tolist(), batch["vetor"], batch["origem"], strict=True):
            own, answer, likeness = np.asarray(vector, np.float64), None, None
            if held:
                scores = np.round(np.array([x[2] for x in held], np.float64) @ own, 6)
                best = min(range(len(held)), key=lambda i: (-scores[i], held[i][1]))  # noqa: B023
                if scores[best] > self.least:
                    answer, likeness = held[best][1], float(scores[best])
            if answer is None and origin not in NEVER:
                held, stored = [*held, (when, qid, own.tolist())][-self.most :], True
            out.append((qid, answer, likeness, answer is None))
        if stored:
            self.held.put(held)
        found = pd.DataFrame(out, columns=["qid", "answer_id", "likeness", "chamada"])
        found["answer_id"] = found["answer_id"].astype("Int64")
        found.insert(0, "versao", key[0])
        yield found

    def close(self) -> None:
        pass


def answer(questions: DataFrame, most: int, least: float) -> DataFrame:
    """(versao, qid, answer_id, likeness, chamada) of a stream of questions (versao, qid, quando, vetor, origem).

    A question is answered from the cache of its catalog version by the most alike question (unit vectors; ties: the
    smallest qid) that is more alike than ``least``; then the model is not called (``chamada`` false), so it does not
    use up the day's cap, and nothing is stored. Else its own answer is stored, unless its ``origem`` is in NEVER, and the
    oldest goes once there are ``most``. Each micro-batch is taken in order of time; entries of one version never
    answer another's questions. As each answer depends on those before it, a version's questions are taken by one
    task, which holds ``most`` vectors. Needs the RocksDB state store.
    """
    return questions.select("versao", "qid", "quando", "vetor", "origem").groupBy("versao").transformWithStateInPandas(
        statefulProcessor=Cache(most, least),
        outputStructType="versao bigint, qid bigint, answer_id bigint, likeness double, chamada boolean",
        outputMode="Append",
        timeMode="None",
    )
