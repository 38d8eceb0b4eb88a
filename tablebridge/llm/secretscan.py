"""Secret scan with an incremental ledger of content-addressed blobs. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str  # leftmost non-overlapping matches
    group: int  # whose length decides
    least: int
    hint: str  # found in every text that has a passing match


# The kinds, in their order at equal starts.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def match_pieces(text: Column, rule: Rule) -> Column:
    """The matches of a rule in order: ``gap`` and ``hit``, the code points before each since the last one and in it, and whether it ``passes``.

    The pieces between matches and the matches themselves give the places: each starts where all before it ends.
    """
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )
    matches = F.filter(parts, lambda x: x["hit"].isNotNull())
    sizes = F.transform(matches, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), (F.char_length(x["value"]) >= rule.least).alias("passes")))
    return F.when(text.rlike(rule.hint), sizes)


def placed(pieces: DataFrame, *key: str) -> DataFrame:
    """``key..., spans``: matches as spans (code points, end exclusive), by a running sum over the matches of a text, in time in proportion to them.

    A key without matches keeps its row, with no spans.
    """
    rows = pieces.select(*key, F.posexplode_outer("pieces").alias("at", "m")).select(*key, "at", "m.*")
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(upto).cast("int"))
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), F.col("end").alias("end"))
    return ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("passes"), span))).alias("spans"))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows ``blob, rule, version, spans`` of all pairs of a blob and a rule version that the ledger lacks.

    ``versions`` holds every historical text, one a row; equal texts are one blob and are scanned once, however many
    copies there are (copies fall together before the shuffle). Null is the empty blob. A pair without findings is a
    row as well, so that the next run skips it. Only the text is read, so other columns may have any name; a text of any length is scanned whole; no
    versions give no rows.
    """
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["blob"])
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))).where(F.size("due") > 0)
    else:
        blobs = blobs.withColumn("due", every)
    one = [
        F.when(F.array_contains("due", F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), match_pieces(F.col("t"), r).alias("pieces")))
        for r in rules
    ]
    found = blobs.select("blob", F.explode(F.array_compact(F.array(*one))).alias("r")).select("blob", "r.*")
    return placed(found, "blob", "rule", "version")


def scan_increments(increments: Iterable[DataFrame], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger after some increments of versions: each is scanned for what the ledger before it lacks, and stored before the next."""
    for versions in increments:
        new = materialise(scan_unseen(versions, ledger, rules, text), "ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
    if ledger is None:
        raise ValueError("no increments and no ledger")
    return ledger


class Ledger:
    """The ledger at a path that stays: what is in it is not scanned again, by this run or any later one.

    Each increment is a folder of its own beside the others, written whole before it counts (Spark's commit of a write), so an increment that was
    lost is scanned again and nothing else is. compact() writes them as one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[str]:
        root = self._hadoop(self.path)
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(root)) if self.fs.exists(root) else []
        whole = [n for n in names if self.fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]
        at = max((i for i, n in enumerate(whole) if n.endswith("-all")), default=0)  # what a compaction holds does not count twice
        return [f"{self.path}/{n}" for n in whole[at:]]

    def read(self) -> DataFrame | None:
        parts = self._parts()
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else None

    def _next(self, kind: str) -> str:
        root = self._hadoop(self.path)
        numbers = [int(s.getPath().getName().split("-")[0]) for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return f"{self.path}/{max(numbers, default=0) + 1:09d}-{kind}"

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> int:
        """Scan what is unseen of these versions, append it, and say how many pairs of a blob and a rule version that were."""
        path = self._next("part")
        scan_unseen(versions, self.read(), rules, text).write.parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path).count()

    def compact(self) -> None:
        """One folder instead of many; the others go once it is whole."""
        old, whole = self._parts(), self.read()
        if whole is not None and len(old) > 1:
            whole.write.parquet(self._next("all"))
            for part in old:
                self.fs.delete(self._hadoop(part), True)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob that has any: counts ``n_<rule>`` and ``spans``, rule:start:end by start and then the rules' order."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    flat = ledger.where((F.size("spans") > 0) & (F.col("version") == current[F.col("rule")])).select(
        "blob", "rule", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("k"), s["end"].alias("end"), F.col("rule").alias("rule"))).alias("s")
    )
    per = flat.groupBy("blob").agg(
        *[F.coalesce(F.sum(F.when(F.col("rule") == r.name, F.size("s"))), F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules], F.array_sort(F.flatten(F.collect_list("s"))).alias("s")
    )
    return per.withColumn("spans", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")).drop("s")


def report(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Join findings back to all paths: every row of ``versions`` without its text, with ``blob``, counts ``n_<rule>`` and ``spans`` (0 and '' if none).

    Columns of ``versions`` with these names are left out, others stay; repeated rows stay repeated; null is the empty blob and
    has no findings; an empty table stays empty. A blob with very many paths is joined without a shuffle of its paths.
    """
    new = [*(f"n_{r.name}" for r in rules), "spans", "blob", "_copies"]
    paths = versions.withColumn("_blob", address(F.col(text))).drop(text, *new).withColumnRenamed("_blob", "blob")
    paths = materialise(paths, "paths")
    copies = paths.groupBy("blob").agg(F.count("*").alias("_copies")).where("_copies > 1")
    found = materialise(copies.join(findings(ledger, rules), "blob", "full").withColumn("_copies", F.coalesce("_copies", F.lit(1))), "findings")
    out = join_hot(paths, found, "blob", "_copies", "left").drop("_copies")
    return out.withColumns({f"n_{r.name}": F.coalesce(f"n_{r.name}", F.lit(0).cast("long")) for r in rules} | {"spans": F.coalesce("spans", F.lit(""))})
