"""Rows from a service that is asked key by key, as columns of a table: lookups and searches by a plug-in.

The plug-in is made on the executor, once per Python worker, and turns one key into one row or a list of rows, as
dictionaries. Whatever it raises counts as no answer, is logged and can be told from an empty answer. Keys are asked once
each; what is remembered (see `tables.remember`) should be taken off before.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("tamarack.remote")
Fetch = Callable[[object], dict | list[dict] | None]


def lookup(keys: DataFrame, key: str, factory: Callable[[], Fetch], answer: str, parallel: int = 8) -> DataFrame:
    """(key, answered, rank, fields of `answer`): the rows that a service gives for each distinct key that is not null.

    `answer` is the fields' DDL. A key without rows has one row of nulls; `answered` is false where the service failed.
    At most `parallel` requests run at a time.
    """
    fields = T._parse_datatype_string(answer).fields
    kind = keys.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("answered", T.BooleanType()), T.StructField("rank", T.IntegerType()), *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = factory()
        for b in batches:
            out = []
            for k in b["key"]:
                try:
                    got, answered = fetch(k), True
                except Exception as e:  # a service may fail in any way
                    log.warning("no answer for %r: %s", k, e)
                    got, answered = None, False
                rows = got if isinstance(got, list) else [got] if got else []
                out += [(k, answered, n, *(r.get(c) for c in names)) for n, r in enumerate(rows, 1)] or [(k, answered, None, *[None] * len(names))]
            yield pd.DataFrame(out, columns=["key", "answered", "rank", *names]).astype(object).where(lambda d: d.notna(), None)

    asked = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().repartition(parallel, "key")
    return asked.mapInPandas(run, schema).withColumnRenamed("key", key)
