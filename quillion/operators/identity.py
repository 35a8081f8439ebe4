"""Identity of records that arrive in batches: only components that an arrival touches are worked on.

The store has, in tables that are only added to, each record and each key with
the label (the smallest ord of its component) it got when it came, and one
table of labels that have changed since. A batch meets the store at its keys:
the labels found there stand for all that lies behind them, and the components
of that small graph are found as ``dedup.leaders`` finds them. A label that is
joined to a smaller one is listed, so followers of results can move on. Joins
of the store shuffle, as in ``dedup.leaders``.

Batches in any split and order give the labels of one run over all records, but
for the case where a later record has a smaller ord than its component: then
the label changes, and is listed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.operators import dedup
from quillion.session import cut, delete

RECORDS, HUBS, CHANGES = "ord long, label long", "key string, label long", "old long, new long"


@dataclass(frozen=True)
class Identity:
    """Folders of the store: records and hubs batch by batch, and the changes of labels so far."""

    records: tuple[str, ...] = ()
    hubs: tuple[str, ...] = ()
    changes: str | None = None

    def to_json(self) -> str:
        return json.dumps({"records": self.records, "hubs": self.hubs, "changes": self.changes})

    @staticmethod
    def from_json(text: str) -> Identity:
        x = json.loads(text)
        return Identity(tuple(x["records"]), tuple(x["hubs"]), x["changes"])

    def labels(self, spark: SparkSession) -> DataFrame:
        """(ord, leader) of every record so far."""
        now = self._changed(spark)
        return _read(spark, RECORDS, self.records).join(now.hint("merge"), F.col("label") == F.col("old"), "left").select("ord", F.coalesce("new", "label").alias("leader"))

    def _changed(self, spark: SparkSession) -> DataFrame:
        return _read(spark, CHANGES, (self.changes,) if self.changes else ())

    def known(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """(key, label) of those of ``keys`` that the store has."""
        some = _read(spark, HUBS, self.hubs).join(keys.select("key").distinct().hint("merge"), "key", "left_semi")
        return some.join(self._changed(spark).hint("merge"), F.col("label") == F.col("old"), "left").select("key", F.coalesce("new", "label").alias("label")).distinct()

    def release(self, spark: SparkSession) -> None:
        for p in (*self.records, *self.hubs, *([self.changes] if self.changes else [])):
            delete(spark, p)


def _read(spark: SparkSession, schema: str, paths: tuple[str, ...]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def extend(store: Identity, records: DataFrame, keys: DataFrame) -> tuple[Identity, DataFrame]:
    """(store with the batch, (old, new) labels that changed): ``records`` has ord, ``keys`` has ord and key.

    The former store stays as it is until its caller releases what the new one doesn't hold.
    """
    spark = records.sparkSession
    new, new_path = cut(keys.select("ord", "key").where("key is not null").distinct(), "identity-keys")
    met, met_path = cut(store.known(spark, new), "identity-met")
    # old components are records of their own here: a label, with the keys that were met
    old = met.select(F.col("label").alias("ord"), "key")
    every = records.select("ord").unionByName(old.select("ord")).distinct()
    lead, lead_path = cut(dedup.leaders(every, new.unionByName(old)), "identity-leaders")
    changed, changed_path = cut(lead.join(old.select("ord").distinct().hint("merge"), "ord", "left_semi").where("leader <> ord").select(F.col("ord").alias("old"), F.col("leader").alias("new")), "identity-changed")
    _, rec_path = cut(records.select("ord").distinct().join(lead.hint("merge"), "ord").select("ord", F.col("leader").alias("label")), "identity-records")
    fresh = new.join(met.select("key").hint("merge"), "key", "left_anti").join(lead.hint("merge"), "ord").groupBy("key").agg(F.min("leader").alias("label"))
    _, hub_path = cut(fresh, "identity-hubs")
    # labels that had changed before move on with what they had become
    before = store._changed(spark)
    moved = before.join(changed.select(F.col("old").alias("o"), F.col("new").alias("n")).hint("merge"), F.col("new") == F.col("o"), "left").select("old", F.coalesce("n", "new").alias("new"))
    _, all_path = cut(moved.unionByName(changed), "identity-changes")
    for p in (new_path, met_path, lead_path):
        delete(spark, p)
    out = replace(store, records=(*store.records, rec_path), hubs=(*store.hubs, hub_path), changes=all_path)
    return out, spark.read.schema(CHANGES).parquet(changed_path)
