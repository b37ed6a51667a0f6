"""Reading and writing the engine's tables: Parquet by default, any database by JDBC."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset it is the warehouse, and the machine's folder for temporary files only if Spark runs in one
    process, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lodemill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage; it goes when the application ends."""
    spark = df.sparkSession
    path = shared(spark, name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows added to a table; a table of vectors is best partitioned by its index."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace(df: DataFrame, path: str) -> DataFrame:
    """A table's new version beside the old one, which readers keep until they take the path that is returned by the reader."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    return df.sparkSession.read.schema(df.schema).parquet(new)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A database's table; with a numeric key and its bounds, read in parallel. Filters and columns are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, mode: str = "append", batch: int = 1000) -> None:
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("batchsize", batch).options(**(properties or {})).save()


def upsert_statement(url: str, table: str, stage: str, keys: list[str], columns: list[str], null_keeps: bool = False) -> str:
    """The statement by which a database takes ``stage`` into ``table``: rows of known keys are updated, the others inserted.

    With ``null_keeps`` a null leaves what is there.
    """
    rest = [c for c in columns if c not in keys]
    value = lambda c, new, old: f"coalesce({new}.{c}, {old}.{c})" if null_keeps else f"{new}.{c}"
    if url.startswith(("jdbc:mysql", "jdbc:mariadb")):
        sets = ", ".join(f"{c} = " + (f"coalesce(values({c}), {table}.{c})" if null_keeps else f"values({c})") for c in rest or keys)
        return f"insert into {table} ({', '.join(columns)}) select {', '.join(columns)} from {stage} on duplicate key update {sets}"
    on = " and ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" when matched then update set {', '.join(f'{c} = {value(c, chr(115), chr(116))}' for c in rest)}" if rest else ""
    return f"merge into {table} t using {stage} s on {on}{update} when not matched then insert ({', '.join(columns)}) values ({', '.join(f's.{c}' for c in columns)})"


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], properties: dict[str, str] | None = None, batch: int = 1000, null_keeps: bool = False) -> None:
    """Rows of ``df`` taken into a database's table, all of them or none, each once, however often a task is run again.

    Tasks write to a table beside it, made like the columns of ``table``; when all are done, its different rows are taken over
    by one statement in one transaction, and it goes, also when something fails. Of rows that share their keys the least
    counts; rows with a null key are left out. Names are those of the database and are not quoted. To Derby Spark sends null
    strings as CLOB, which it does not take for VARCHAR.
    """
    columns, spark = df.columns, df.sparkSession
    rest = [c for c in columns if c not in keys]
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    once = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*columns) if rest else known.distinct()
    mark = uuid.uuid4().hex[:12]
    stage, different = f"{table}_in_{mark}", f"{table}_once_{mark}"
    names = ", ".join(columns)
    like = "as select {0} from {1} with no data" if url.startswith("jdbc:derby") else "as select {0} from {1} where 1 = 0"
    with _connection(spark, url, properties) as run:
        try:
            for name in (stage, different):
                run([f"create table {name} {like.format(names, table)}"])
            write_jdbc(once, url, stage, properties, "append", batch)
            run([f"insert into {different} ({names}) select distinct {names} from {stage}", upsert_statement(url, table, different, keys, columns, null_keeps)])
        finally:
            for name in (stage, different):
                with suppress(Exception):  # it may not have come to be
                    run([f"drop table {name}"])


@contextmanager
def _connection(spark: SparkSession, url: str, properties: dict[str, str] | None) -> Iterator[Callable[[list[str]], None]]:
    """What runs statements on the database in one transaction, or takes all of them back."""
    jvm = spark.sparkContext._jvm
    own = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        own.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    connection.setAutoCommit(False)

    def run(statements: list[str]) -> None:
        try:
            for text in statements:
                statement = connection.createStatement()
                statement.execute(text)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise

    try:
        yield run
    finally:
        connection.close()
