"""Where copied tables go: a versioned store, or a database over JDBC. Both are one protocol, chosen by kind."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.ddl import distribute
from ..functions.typemap import PG_FAMILY
from ..protocols import plugged
from .readers import PAGE, Connection, jdbc_url
from .store import TableStore

KINDS = ("store", "mysql", *PG_FAMILY, "dameng")


class Sink(Protocol):
    """What a copy needs of its target. Nothing is to be seen there before publish()."""

    def execute(self, statements: Sequence[str]) -> None: ...

    def write(self, table: str, df: DataFrame, keys: Sequence[str] = (), identity: bool = False) -> None: ...

    def publish(self) -> None: ...


class StoreSink:
    """Tables as Parquet in a TableStore; all that was written shows with one version."""

    def __init__(self, store: TableStore) -> None:
        self.store, self.before, self.staged = store, store.latest(), {}

    def execute(self, statements: Sequence[str]) -> None:
        """A store has no statements of its own: only CREATE VIEW is kept, as a temporary view of the session."""
        for s in statements:
            if s.lstrip().upper().startswith("CREATE"):
                self.store.spark.sql(s.rstrip().rstrip(";"))

    def write(self, table: str, df: DataFrame, keys: Sequence[str] = (), identity: bool = False) -> None:
        self.staged[table] = self.store.stage(table, df.repartition(*keys) if keys else df)

    def publish(self) -> None:
        self.before = self.store.commit(self.before, self.staged, self.before["position"])
        self.staged = {}


def quoted(kind: str, *names: str) -> str:
    mark = "`" if kind == "mysql" else '"'
    return ".".join(mark + n.replace(mark, 2 * mark) + mark for n in names if n)


def promote(kind: str, schema: str, table: str, stage: str, columns: Sequence[str], identity: bool = False) -> list[str]:
    """Statements of one transaction that move a staging table's rows into the table: all of them or none.

    The staging table stays: a DROP would commit by itself in some databases (MySQL, DaMeng), with what came before it. drop_stage() has it.
    A table whose own numbers are to be kept (``identity``) is opened for explicit ones around the insert, in the same session.
    """
    to, of, cols = quoted(kind, schema, table), quoted(kind, schema, stage), ", ".join(quoted(kind, c) for c in columns)
    insert = [f"INSERT INTO {to} ({cols}) SELECT {cols} FROM {of}"]
    if identity and kind == "dameng":
        insert = [f"SET IDENTITY_INSERT {to} ON", *insert, f"SET IDENTITY_INSERT {to} OFF"]
    return insert


def drop_stage(kind: str, schema: str, stage: str) -> str:
    """Statement after the transaction that moved a staging table's rows; one that is left over is overwritten by the next copy."""
    return f"DROP TABLE {quoted(kind, schema, stage)}"


def create_view(kind: str, schema: str, name: str, body: str) -> list[str]:
    """Statements of one transaction that make a view whose body names tables without their schema."""
    path = [f"SET LOCAL search_path TO {quoted(kind, schema)}"] if kind in PG_FAMILY else []
    return [*path, f"CREATE OR REPLACE VIEW {quoted(kind, schema, name)} AS {body.strip().rstrip(';')}"]


def change_owner(kind: str, schema: str, table: str, owner: str) -> list[str]:
    """Only databases of the PostgreSQL family give tables away."""
    return [f"ALTER TABLE {quoted(kind, schema, table)} OWNER TO {quoted(kind, owner)}"] if owner and kind in PG_FAMILY else []


def reseed(starts: DataFrame, kind: str, schema: str) -> DataFrame:
    """``table_name, column_name, statement`` that sets each sequence to its next value; ``starts`` as of catalog.next_values()."""
    mark = "`" if kind == "mysql" else '"'
    table = F.concat(F.lit(quoted(kind, schema) + "." + mark), F.col("table_name"), F.lit(mark))
    if kind == "mysql":
        text = F.format_string("ALTER TABLE %s AUTO_INCREMENT = %d", table, "start_value")
    elif kind == "dameng":
        text = F.format_string("DBCC CHECKIDENT ('%s', RESEED, %d)", table, F.col("start_value") - 1)
    else:
        text = F.format_string("SELECT setval(pg_get_serial_sequence('%s', '%s'), %d, false)", table, "column_name", "start_value")
    return starts.select("table_name", "column_name", text.alias("statement"))


class JdbcSink:
    """A database: pages go by batched inserts to a staging table, which one transaction moves into its table.

    A task that runs again would insert its rows twice; so a job of several tasks writes to the staging table only, whose count is held against
    the rows that were sent before it is moved (a task that ran twice shows). Tables then go to ``owner``, where the database gives them away. ``connect`` gives a JDBC connection (of the JVM's DriverManager unless told otherwise).
    """

    def __init__(self, spark: SparkSession, target: Connection, schema: str, connect: Callable[[], object] | None = None, owner: str = "") -> None:
        self.spark, self.target, self.schema, self.owner = spark, target, schema, owner
        self.todo: list[str] = []
        self.stages: list[str] = []
        self.moved: list[str] = []
        self.connect = connect or (lambda: spark._jvm.java.sql.DriverManager.getConnection(jdbc_url(target), target.user, target.password))

    def options(self, table: str) -> dict[str, str]:
        """Options of a write: pages of the same size as the reads."""
        return {"url": jdbc_url(self.target), "dbtable": quoted(self.target.kind, self.schema, table), "user": self.target.user, "password": self.target.password, "batchsize": str(PAGE), "isolationLevel": "READ_COMMITTED"}

    def execute(self, statements: Sequence[str]) -> None:
        """All statements in one transaction."""
        connection = self.connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for s in statements:
                statement.execute(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def write(self, table: str, df: DataFrame, keys: Sequence[str] = (), identity: bool = False) -> None:
        stage, seen = f"{table}__stage", Observation()
        df.observe(seen, F.count("*").alias("n")).write.format("jdbc").options(**self.options(stage)).mode("overwrite").save()
        found = self.spark.read.format("jdbc").options(**self.options(stage)).load().count()
        if found != seen.get["n"]:
            raise RuntimeError(f"{table}: {found} of {seen.get['n']} rows staged")
        self.stages.append(stage)
        spread = [distribute(self.target.kind, self.schema, table, list(keys))] if keys else []
        self.moved.append(table)
        self.todo += [s for s in spread if s] + promote(self.target.kind, self.schema, table, stage, df.columns, identity)

    def publish(self) -> None:
        """All tables in one transaction; only then do their staging tables go, each by itself."""
        self.execute([*self.todo, *[s for t in self.moved for s in change_owner(self.target.kind, self.schema, t, self.owner)]])
        for stage in self.stages:
            self.execute([drop_stage(self.target.kind, self.schema, stage)])
        self.todo, self.stages, self.moved = [], [], []


def sink_for(spark: SparkSession, kind: str, root: str = "", target: Connection | None = None, schema: str = "") -> Sink:
    """The sink of a target's kind, a registered one first; ValueError for a database that can't be written."""
    if plug := plugged("sink", kind):
        return plug(spark, root=root, target=target, schema=schema)
    if kind == "store":
        return StoreSink(TableStore(spark, root))
    if kind not in KINDS or target is None:
        raise ValueError(f"not a target: {kind}")
    return JdbcSink(spark, target, schema)


def answers(spark: SparkSession, target: Connection | str, read: Callable[[str], DataFrame] | None = None) -> tuple[bool, str]:
    """Whether a source answers: its smallest query, or the listing of its folder; the reason if it does not."""
    try:
        if isinstance(target, str):
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                return False, "no such folder"
        else:
            one = "SELECT 1 FROM dual" if target.kind in ("oracle", "dameng") else "SELECT 1"
            (read or (lambda q: spark.read.format("jdbc").options(url=jdbc_url(target), user=target.user, password=target.password, query=q).load()))(one).collect()
    except Exception as e:  # noqa: BLE001  the reason is the result
        return False, str(e).splitlines()[0][:240]
    return True, ""
