"""Many small groups in one Python pass: rows arrive sorted by group, so a group costs a list and not a data frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def add_column(df: DataFrame, keys: list[str], order: list[str], name: str, values: Callable[[list], list[str]]) -> DataFrame:
    """df with a string column: values(rows of one group in order) gives it for each of them. A group must fit a task."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    places = [df.columns.index(k) for k in keys]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for frame in frames:
            done, made = [], []
            for row in frame.itertuples(index=False):
                if group and any(row[p] != group[0][p] for p in places):
                    done += group
                    made += values(group)
                    group = []
                group.append(row)
            if done:
                yield pd.DataFrame([(*r, v) for r, v in zip(done, made, strict=True)], columns=schema.names)
        if group:
            yield pd.DataFrame([(*r, v) for r, v in zip(group, values(group), strict=True)], columns=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
