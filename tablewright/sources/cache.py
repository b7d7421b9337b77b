"""Loaded tables and comparisons kept between uses, under what they were made from.

A table is kept under its file's signature and how it was read, a comparison under its tables' signatures and its options, so
a file that changed, or another option, is never answered from what was kept.  The least lately used go first.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.clean import clean_data
from tablewright.operators.compare import CompareOptions, Comparison
from tablewright.operators.schema import apply_schema
from tablewright.sources import files
from tablewright.sources.tables import ReadOptions, load_table

#: Tables and comparisons that are kept.
TABLES, COMPARISONS = 20, 8


class Kept:
    """Up to ``most`` persisted results by key; a result that goes is no longer persisted."""

    def __init__(self, most: int) -> None:
        self.most, self.held = most, OrderedDict()

    def get(self, key: Hashable, make: Callable[[], tuple[object, DataFrame]]) -> object:
        """The result under a key; ``make`` gives a new one and the frame to persist for it."""
        if key not in self.held:
            result, frame = make()
            self.held[key] = (result, frame.persist())
            while len(self.held) > self.most:
                _, (_, old) = self.held.popitem(last=False)
                old.unpersist()
        self.held.move_to_end(key)
        return self.held[key][0]

    def clear(self) -> None:
        while self.held:
            _, (_, old) = self.held.popitem()
            old.unpersist()


class Workspace:
    """Tables read, cleaned, typed and compared, each kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables, self.comparisons = Kept(TABLES), Kept(COMPARISONS)

    def signature(self, path: str, options: ReadOptions | None = None) -> tuple:
        return files.signature(self.spark, path), options or ReadOptions()

    def load(self, path: str, options: ReadOptions | None = None) -> tuple[DataFrame, list[dict]]:
        def make():
            df, found = load_table(self.spark, path, options)
            return (df, found), df

        return self.tables.get(("load", self.signature(path, options)), make)

    def clean(self, path: str, options: ReadOptions | None = None) -> DataFrame:
        def make():
            df = clean_data(self.load(path, options)[0])
            return df, df

        return self.tables.get(("clean", self.signature(path, options)), make)

    def typed(self, path: str, schema: dict[str, str], styles: dict[str, str] | None = None, options: ReadOptions | None = None) -> tuple[DataFrame, DataFrame]:
        def make():
            both = apply_schema(self.clean(path, options), schema, styles)
            return both, both[0]

        return self.tables.get(("typed", self.signature(path, options), tuple(schema.items()), tuple((styles or {}).items())), make)

    def compare(self, old: str, new: str, schema: dict[str, str], keys: list[str], columns: list[str], compare: CompareOptions | None = None, styles: dict[str, str] | None = None) -> Comparison:
        def make():
            found = Comparison(self.typed(old, schema, styles)[0], self.typed(new, schema, styles)[0], keys, columns, compare)
            return found, found.base

        key = (self.signature(old), self.signature(new), tuple(schema.items()), tuple((styles or {}).items()), tuple(keys), tuple(columns), compare or CompareOptions())
        return self.comparisons.get(key, make)
