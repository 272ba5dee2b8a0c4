"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators define it.
WHITE = " \t\n\v\f\r"
#: One bitmap of Spark's bitmap functions: 4096 bytes.
BLOCK_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Only where it is unset (tests on one
    machine), a fresh local folder is set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors and is
    computed once. The files stay, as those of checkpoint() do, until discard()."""
    path = f"{shared_dir(df.sparkSession)}/sparkloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def filter_blocks(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> int:
    """Blocks of a Bloom filter for so many rows: a power of two, at most max_bits (32 MB) whatever the input; a
    fuller filter only lets more rows pass to the exact step."""
    return max(1, min(power_of_two(rows * bits_per_row), max_bits) // BLOCK_BITS)


def _block(f: Column, blocks: int) -> Column:
    return f.bitwiseAND(F.lit(blocks - 1).cast("long"))


def _bits(f: Column) -> list[Column]:
    return [F.shiftrightunsigned(f, s).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long")) for s in (34, 49)]


def filter_cells(f: Column, blocks: int) -> Column:
    """The two cells of a 64-bit fingerprint, both in one block."""
    base = F.shiftleft(_block(f, blocks), 15)
    return F.array_distinct(F.array(*[base + b for b in _bits(f)]))


def filter_table(cells: DataFrame) -> DataFrame:
    """Bitmaps (block, bits: 1024 ints) of a column `cell`; at most 8192 rows of 4 KB."""
    bitmaps = cells.groupBy(F.shiftright("cell", 15).alias("_block")).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long"))).alias("_bytes")
    )
    # As numbers, so that a probe is one look into an array. Four bytes make an int, the first one its highest.
    words = F.expr(f"transform(sequence(0, {BLOCK_BITS // 32 - 1}), i -> cast(conv(hex(substring(_bytes, 4 * i + 1, 4)), 16, 10) as bigint))")
    signed = F.transform(words, lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int"))
    return bitmaps.select("_block", signed.alias("_bits"))


def with_hit(df: DataFrame, fingerprint: str, bitmaps: DataFrame, blocks: int, out: str) -> DataFrame:
    """Adds the boolean column out: both cells of the fingerprint are set. The bitmaps are of bounded size."""
    f = F.col(fingerprint)

    def bit(b: Column) -> Column:
        word = F.get(F.col("_bits"), F.shiftright(b, 5).cast("int"))
        place = b.bitwiseAND(F.lit(31).cast("long")).bitwiseXOR(F.lit(24).cast("long"))  # bytes in reverse, bits as they are
        return F.getbit(word, place.cast("int")) == 1

    b1, b2 = _bits(f)
    hit = F.coalesce(bit(b1) & bit(b2), F.lit(False))
    joined = df.withColumn("_block", _block(f, blocks)).join(F.broadcast(bitmaps), "_block", "left")
    return joined.withColumn(out, hit).drop("_block", "_bits")


def maybe_among(df: DataFrame, key: str, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of df whose key may be among the one-column table ids: no row that is among them is lost, few others
    stay. It keeps the rest of df out of a later shuffle."""
    blocks = filter_blocks(rows)
    wanted = ids.select(F.explode(filter_cells(F.xxhash64(ids.columns[0]), blocks)).alias("cell")).distinct()
    probed = with_hit(df.withColumn("_f", F.xxhash64(key)), "_f", filter_table(wanted), blocks, "_hit")
    return probed.filter("_hit").drop("_f", "_hit")
