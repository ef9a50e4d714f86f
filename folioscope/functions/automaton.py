"""Dictionaries of terms, found in one pass over a text by an Aho-Corasick automaton.

A chain of `contains` costs a scan of the text for each term; the automaton costs one for all, so thousands of terms are as
cheap as one. It is built once on the driver and sent to the tasks, so its size is checked.
"""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of an automaton that is sent to every task, at most.
MOST_BYTES = 64 << 20

@lru_cache(maxsize=8)
def _loaded(data: bytes) -> Any:
    return pickle.loads(data)


class Dictionary:
    """Terms, each with a name; several may share one. Terms are found wherever they occur, also within others; case counts.

    An empty term is in no text. The automaton has to fit MOST_BYTES: a larger dictionary is refused, not cut.
    """

    def __init__(self, spark: SparkSession, terms: Mapping[str, str] | Sequence[str], *, most_bytes: int = MOST_BYTES):
        import ahocorasick

        named = terms if isinstance(terms, Mapping) else {t: t for t in terms}
        self.names = list(dict.fromkeys(named.values()))
        place = {name: i for i, name in enumerate(self.names)}
        automaton = ahocorasick.Automaton()
        for term, name in named.items():
            if term:
                automaton.add_word(term, place[name])
        automaton.make_automaton()
        data = pickle.dumps(automaton)
        if len(data) > most_bytes:
            raise ValueError(f"the automaton of {len(named)} terms has {len(data)} bytes; at most {most_bytes} are sent to tasks")
        self._sent = spark.sparkContext.broadcast(data)
        self._empty = not len(automaton)

    def found(self, text: Column) -> Column:
        """Names of the terms in a text, each once, in the order of the dictionary; a null text has none."""
        sent, names, empty = self._sent, self.names, self._empty

        def find(texts: pa.Array) -> pa.Array:
            if empty:
                return pa.array([[]] * len(texts), pa.list_(pa.string()))
            automaton = _loaded(sent.value)
            return pa.array([[names[i] for i in sorted({i for _, i in automaton.iter(t)})] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

        return F.arrow_udf(find, "array<string>")(text)
