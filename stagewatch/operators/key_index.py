"""C9 / C10 across loads: new keys checked against all keys that are already published.

Published keys lie in a table, and beside it in Bloom filters of 2,048 bits,
each for the keys of one hash block.  New keys meet the filters of their own
blocks first; only the few that may be there are looked for in the key table,
of which only the parts that hold one of them are read.  Each load adds its
keys and its filters; a load that is done again replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import quoted

BITS, HASHES, PARTS = 2048, 6, 16
WORDS = BITS // 64


def blocks_for(expected_keys: int) -> int:
    """Blocks for so many keys: about 200 keys a filter, of which one in a hundred strange keys passes at most."""
    return max(1, -(-expected_keys // 200))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)).cast("bigint")


def _place(key: Column, j: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(j + 1), key), F.lit(BITS)).cast("int")


def _may_hold(bits: Column, key: Column) -> Column:
    out = F.lit(True)
    for j in range(HASHES):
        bit = _place(key, j)
        out = out & (F.get(bits, F.shiftright(bit, 6)).bitwiseAND(_one(bit)) != 0)
    return out


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63))


@dataclass(frozen=True)
class KeyIndex:
    """The keys published below ``path``, in ``blocks`` hash blocks (``blocks_for``; fixed when the index is begun)."""
    path: str
    blocks: int = 1 << 16

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def keys(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "keys", "key string, part int, load string")

    def filters(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "filters", "block bigint, bits array<bigint>, load string")

    def _counted(self, table: DataFrame, key: str) -> DataFrame:
        text = quoted(key).cast("string")
        counts = table.where(text.isNotNull()).groupBy(text.alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.withColumn("block", _block(F.col("key"), self.blocks)).withColumn(
            "part", (F.col("block") % PARTS).cast("int"))

    def repeated(self, table: DataFrame, key: str, load: str | None = None) -> DataFrame:
        """``key, n_rows, first_load, loads``: keys of ``table`` that other loads than ``load`` have published.

        Null keys are no keys.  ``n_rows`` counts the key's rows in ``table``.
        """
        spark = table.sparkSession
        new = self._counted(table, key)
        others = F.lit(True) if load is None else F.col("load") != load
        filters = self.filters(spark).where(others).select(F.col("block").alias("b"), "bits")
        hits = new.join(filters, (F.col("block") == F.col("b")) & _may_hold(F.col("bits"), F.col("key")), "left_semi")
        old = self.keys(spark).where(others).select(F.col("key").alias("k"), F.col("part").alias("p"), "load")
        found = old.join(hits, (F.col("p") == F.col("part")) & (F.col("k") == F.col("key")))
        return found.groupBy("key").agg(F.max("n_rows").alias("n_rows"), F.min("load").alias("first_load"),
                                        F.count_distinct("load").alias("loads"))

    def add(self, table: DataFrame, key: str, load: str) -> None:
        """Add the keys of ``table`` as those of ``load``; done again, it replaces them (keys first, then filters)."""
        keys = self._counted(table, key)
        bits = keys.select("block", F.explode(F.array(*[_place(F.col("key"), j) for j in range(HASHES)])).alias("bit"))
        words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_one(F.col("bit"))).alias("bits"))
        # at most WORDS entries a block
        filters = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set")).select(
            "block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(
                F.try_element_at("set", w), F.lit(0).cast("bigint"))).alias("bits"))
        for name, rows, by in (("keys", keys.select("key", "part"), ["load", "part"]), ("filters", filters, ["load"])):
            (rows.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*by).parquet(f"{self.path}/{name}"))
