"""What the operators share: stored intermediate tables, salted joins, shared files."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from docproof.session import work_folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_docproof_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = f"{tempfile.mkdtemp(prefix='docproof-')}/docproof.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._docproof_shipped = True


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: no lineage, no lost executor."""
    folder = work_folder(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that no later plan reads."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a task has freed back to the machine; Python workers outlive their tasks."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()


SALTS = 8


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Join many rows per key with one row per key; no key's rows all meet in one task.

    The rows of a key are dealt over ``SALTS`` parts by ``spread_by`` and the single row is copied
    to each part; parts that are still large are split further by the adaptive skew join.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; looks at no more than one row beyond."""
    return df.limit(limit + 1).count() <= limit


# ---------------------------------------------------------------- files that tasks write and map


def new_folder(spark: SparkSession, purpose: str) -> str:
    return work_folder(spark, f"llm-{purpose}")


def _filesystem(location: str):
    from pyarrow import fs

    if "://" in location or location.startswith("file:"):
        return fs.FileSystem.from_uri(location)
    return fs.LocalFileSystem(), location


def write_array(folder: str, name: str, values) -> None:
    """Write one array file whole or not at all: repeated and parallel attempts leave the same file."""
    import io

    import numpy as np
    from pyarrow import fs

    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    data = io.BytesIO()
    np.save(data, values)
    attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(data.getbuffer())
    try:
        system.move(attempt, f"{root}/{name}.npy")
    except OSError:  # another attempt of the same task was first, on a store that does not replace
        if system.get_file_info(f"{root}/{name}.npy").type == fs.FileType.NotFound:
            raise
        system.delete_file(attempt)


def map_array(folder: str, name: str):
    """Memory-map one array file: in place where the store is a mounted path, else a nameless copy."""
    import numpy as np
    from pyarrow import fs

    system, root = _filesystem(folder)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(f"{root}/{name}.npy", mmap_mode="r")
    with tempfile.NamedTemporaryFile(delete=False) as copy:
        with system.open_input_stream(f"{root}/{name}.npy") as source:
            while piece := source.read(1 << 22):
                copy.write(piece)
    mapped = np.load(copy.name, mmap_mode="r")
    os.unlink(copy.name)  # the mapping keeps the bytes; nothing stays when the worker ends
    return mapped


# ---------------------------------------------------------------- blocks that every task reads, one at a time


def keep_blocks(blocks: DataFrame, columns: list[str], purpose: str) -> tuple[str, dict[int, list]]:
    """Write the binary columns of each row (block, dims, columns) of a stored table to files that tasks map.

    Returns the folder and the names of the blocks by ``dims``. Meeting all rows of another table so
    copies no block: neither a shuffle nor a broadcast grows with the number of pairs of blocks.
    """
    import numpy as np
    import pyarrow as pa

    folder = new_folder(blocks.sparkSession, purpose)

    def write(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.column("block")[at].as_py()
                for name in columns:
                    write_array(folder, f"{block}-{name}", np.frombuffer(batch.column(name)[at].as_py(), np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("dims")], names=["block", "dims"])

    chosen = blocks.select("block", "dims", *columns)
    names: dict[int, list] = {}
    for row in chosen.mapInArrow(write, chosen.select("block", "dims").schema).orderBy("dims", "block").collect():
        names.setdefault(row["dims"], []).append(row["block"])
    return folder, names


def kept_block(folder: str, block, columns: list[str]) -> dict[str, bytes]:
    """One block of ``keep_blocks``."""
    return {name: map_array(folder, f"{block}-{name}").tobytes() for name in columns}


def in_groups(batches, size: int):
    """Rows of record batches as lists of at most ``size`` dictionaries."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size).to_pylist()
