"""An index of the keys that were ever written, for duplicate suppression without a time limit.

Keys lie in generations: each micro-batch adds one, and equal numbers of generations of a level are merged into one
of the next, so there are few of them and each key is rewritten a logarithmic number of times. A generation is cut
into buckets of bounded size by the keys' hashes, and each bucket has a Bloom filter. A batch asks the filters
first, and opens only the bucket files that may hold one of its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a bucket, on average, and bits of its filter for each (one in a hundred other keys passes).
BUCKET_KEYS, BITS, PROBES = 2_000_000, 10, 7
#: Keys of a batch, on average, that are held against a filter at once, and hashes that are placed at once.
SLICE_KEYS, STEP = 250_000, 65_536
#: Generations of a level that are merged into one of the next.
MERGE = 8

_KEY = "kind string, key string, h bigint, bucket int"
_LIVE = "gen string, level int, n bigint, buckets int, batch bigint"
_BLOOM = "gen string, bucket int, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` bits."""
    whole = hashes.astype(np.int64).view(np.uint64)
    step = (whole >> np.uint64(32)) | np.uint64(1)
    return ((whole & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(size)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter that passes these hashes."""
    bits = np.zeros(max(64, -(-BITS * len(hashes) // 8) * 8), bool)
    for at in range(0, len(hashes), STEP):
        bits[_places(hashes[at : at + STEP], len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    data = np.frombuffer(bits, np.uint8)
    kept = np.empty(len(hashes), bool)
    for at in range(0, len(hashes), STEP):
        places = _places(hashes[at : at + STEP], 8 * len(data))
        found = data[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8) & 1
        kept[at : at + STEP] = found.all(axis=1)
    return kept


@dataclass(frozen=True)
class KeyIndex:
    """The index in a folder. Keys are rows ``kind, key``; null keys are no keys.

    Batches come with ascending numbers. What batch N leaves is written under its number alone and depends only on
    what earlier batches left, so a batch that is run again writes the same and is never found by itself.
    """

    spark: SparkSession
    base: str
    bucket_keys: int = BUCKET_KEYS
    merge: int = MERGE
    slice_keys: int = SLICE_KEYS

    def slices(self, keys: int, buckets: int) -> int:
        """Slices that a batch of so many keys is cut into beside the buckets: a small generation has few of these."""
        return max(1, -(-keys // (buckets * self.slice_keys)))

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return keys.where("key IS NOT NULL").select("kind", "key", F.xxhash64("kind", "key").alias("h"))

    def live(self, before: int) -> list:
        """The generations that the last batch before this number left: a few for each level."""
        try:
            every = self.spark.read.schema(_LIVE).option("basePath", f"{self.base}/live").parquet(f"{self.base}/live")
        except AnalysisException:
            # No batch has been written.
            return []
        last = every.where(F.col("batch") < before).agg(F.max("batch").alias("b")).first().b
        return [] if last is None else sorted(every.where((F.col("batch") == last) & F.col("gen").isNotNull()).collect(), key=lambda r: r.gen)

    def candidates(self, keys: DataFrame, generations: list) -> DataFrame:
        """``gen, bucket, kind, key`` for each key and generation whose filter passes it."""
        n = keys.count()
        cuts = {g.gen: self.slices(n, g.buckets) for g in generations}
        gens = F.array(*(F.struct(F.lit(g.gen).alias("gen"), F.lit(g.buckets).alias("buckets"), F.lit(cuts[g.gen]).alias("cuts")) for g in generations))
        asked = self._hashed(keys).distinct().select("kind", "key", "h", F.explode(gens).alias("g"))
        asked = asked.select(
            "g.gen", F.pmod("h", F.col("g.buckets")).cast("int").alias("bucket"), F.pmod(F.xxhash64("h"), F.col("g.cuts")).cast("int").alias("cut"), "kind", "key", "h"
        )
        filters = self.spark.read.schema(_BLOOM).parquet(*(f"{self.base}/blooms/gen={g.gen}" for g in generations))
        of_gen = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))
        # A filter goes to each slice of the batch.
        filters = filters.withColumn("cut", F.explode(F.sequence(F.lit(0), of_gen[F.col("gen")] - 1)))

        def test(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            kept = asked.iloc[:0] if filters.empty else asked[passes(bytes(filters.bits.iloc[0]), asked.h.to_numpy(np.int64))]
            return kept[["gen", "bucket", "kind", "key"]]

        both = asked.groupBy("gen", "bucket", "cut").cogroup(filters.groupBy("gen", "bucket", "cut"))
        return both.applyInPandas(test, "gen string, bucket int, kind string, key string")

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """The keys that batches before this one have written."""
        generations = self.live(batch)
        if not generations:
            return self.spark.createDataFrame([], "kind string, key string")
        maybe = self.candidates(keys, generations).persist()
        # At most as many as there are bucket files.
        files = [f"{self.base}/keys/gen={r.gen}/bucket={r.bucket}" for r in maybe.select("gen", "bucket").distinct().collect()]
        if not files:
            maybe.unpersist()
            return self.spark.createDataFrame([], "kind string, key string")
        stored = self.spark.read.schema("kind string, key string").parquet(*sorted(files))
        return maybe.select("kind", "key").distinct().join(stored, ["kind", "key"], "left_semi")

    def _write(self, keys: DataFrame, gen: str) -> tuple[int, int]:
        """Writes a generation and its filters; its keys and buckets."""
        n = keys.count()
        buckets = max(1, -(-n // self.bucket_keys))
        placed = keys.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        target = f"{self.base}/keys/gen={gen}"
        placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(target)
        stored = self.spark.read.schema(_KEY).option("basePath", target).parquet(target) if n else keys.withColumn("bucket", F.lit(0)).limit(0)

        def build(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"gen": [gen], "bucket": [group.bucket.iloc[0]], "bits": [bloom(group.h.to_numpy(np.int64))]})

        # A bucket has a bounded number of keys.
        filters = stored.select("bucket", "h").groupBy("bucket").applyInPandas(build, _BLOOM)
        filters.write.mode("overwrite").parquet(f"{self.base}/blooms/gen={gen}")
        return n, buckets

    def add(self, keys: DataFrame, batch: int) -> None:
        """Adds the keys of a batch, and merges generations where enough of a level have come together."""
        kept = [(g.gen, g.level, g.n, g.buckets) for g in self.live(batch)]
        name = f"{batch:012d}-0"
        n, buckets = self._write(self._hashed(keys).distinct(), name)
        if n:
            kept.append((name, 0, n, buckets))
        level = 0
        while len(own := [g for g in kept if g[1] == level]) >= self.merge:
            name = f"{batch:012d}-{level + 1}"
            stored = self.spark.read.schema("kind string, key string, h bigint").option("recursiveFileLookup", "true")
            n, buckets = self._write(stored.parquet(*(f"{self.base}/keys/gen={g[0]}" for g in own)), name)
            kept = [g for g in kept if g[1] != level] + [(name, level + 1, n, buckets)]
            level += 1
        rows = [(*g, batch) for g in kept] or [(None, None, None, None, batch)]
        self.spark.createDataFrame(rows, _LIVE).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/live/at={batch:012d}")

    def vacuum(self, batch: int) -> list[str]:
        """Deletes generations that neither the last batch nor the one before it left; their names.

        A batch that may still be run again reads only what the one before it left.
        """
        every = self.spark.read.schema(_LIVE).option("basePath", f"{self.base}/live").parquet(f"{self.base}/live").where("gen IS NOT NULL")
        kept = {g.gen for b in (batch, batch + 1) for g in self.live(b)}
        gone = sorted({r.gen for r in every.select("gen").distinct().collect()} - kept)
        jvm = self.spark._jvm
        for gen in gone:
            for folder in ("keys", "blooms"):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}/gen={gen}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
