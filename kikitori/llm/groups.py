"""Splits that keep related records together.

Records of one person, and of persons bound by a shared recording, form components. The component table is persisted under a
path the caller names (:class:`ComponentTable`) and grows by loads. A load reads new rows only: their units (a person, else a
recording, else the row itself) are looked up, links go from new units, over the recordings known so far, to components;
roots are hooked onto smaller roots and pointer jumping flattens the merged trees. Existing components keep their split, new
ones fill what the splits lack, a merge of components of different splits is quarantined. What is written is new units, new
recordings, and the components that are new or changed; a load becomes visible by a marker written last, and a load of a name
that is already there is left out, so that a load which broke off is simply run again.

Only links between different components take part in the iterations; each of them is a few equi-joins over contracted links
and is written to the shared folder, so lineage stays short and lost executors cost one step.

Defined results: rows without a speaker follow their recording; rows with neither are components of their own; repeated
rows change nothing but sizes; an empty load changes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kikitori.llm.lookalike import fold
from kikitori.operators.hot import spread_join
from kikitori.operators.prefix import bucket_count, hash_bucket, prefix_sum
from kikitori.session import cut, drop_table

LARGE_SHARE = 0.001  # components above this share of all rows are placed one by one: at most 1000 of them
QUARANTINE = "quarantine"


@F.pandas_udf(StringType())
def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def person_key(speaker: Column) -> Column:
    """The person a stored id names: its look-alike form without the set. An id without namespace is a person of its own."""
    form = fold(speaker)
    # a Python call sees every row, so rows without a mark to compose are nulls to it
    form = F.coalesce(_composed(F.when(F.rlike(form, F.lit("\\p{M}|[\\x{1100}-\\x{11FF}]")), form)), form)
    rest = F.substring_index(F.substring(form, F.locate(":", form) + 1, F.lit(1 << 30)), "__", 1)
    return F.when(F.locate(":", form) > 0, F.concat(F.substring_index(form, ":", 1), F.lit(":"), rest)).otherwise(form)


def merge_links(links: DataFrame) -> DataFrame:
    """node, root for every node that some link moves: root is the smallest node of its component. Nodes not listed are
    their own roots."""
    tables: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, folder = cut(df, name)
        tables.append(folder)
        return df

    spark = links.sparkSession
    open_links = kept(links.where("u <> v").distinct(), "links")
    rounds: list[DataFrame] = []
    while not open_links.isEmpty():
        # hook each root onto its smallest neighbour below it
        both = open_links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        hooks = kept(both.groupBy("node").agg(F.min("root").alias("root")), "hooks")
        while True:  # pointer jumping, two jumps a step: the depth of the trees is quartered
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            once = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("__moved"))
            twice = once.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("__open"))
            jumped = kept(twice, "jump")
            changed = not jumped.where("__open").isEmpty()
            hooks = jumped.drop("__open")
            if not changed:
                break
        rounds.append(hooks)
        a = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        contracted = (
            open_links.join(a, "u", "left")
            .join(b, "v", "left")
            .select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
            .where("u <> v")
            .distinct()
        )
        open_links = kept(contracted, "links")
    moved = spark.createDataFrame([], "node string, root string")
    for hooks in rounds:  # at most log(nodes) rounds
        onto = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = moved.join(onto, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(hooks) if hooks is not rounds[0] else hooks
    result, folder = cut(moved, "components")
    for t in tables:
        if t != folder:
            drop_table(spark, t)
    return result


def fill_deficits(sizes: DataFrame, targets: Sequence[tuple[str, float]], filled: dict[str, int]) -> DataFrame:
    """component, split: new components (component, size) go where rows lack most. Large ones (at most 1 / LARGE_SHARE of
    them) one by one to the largest lack; all others by position in hash order, cut at what is still lacking."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    whole = total + sum(filled.values())
    lack = {name: share * whole - filled.get(name, 0) for name, share in targets}
    bound = max(1.0, LARGE_SHARE * whole)
    placed = []
    for r in sizes.where(F.col("size") >= bound).orderBy(F.desc("size"), "component").collect():  # at most 1 / LARGE_SHARE rows
        name = max(lack, key=lambda x: (lack[x], x))
        lack[name] -= r["size"]
        placed.append((r["component"], name))
    rest = {k: max(0.0, v) for k, v in lack.items()}
    scale = sum(rest.values()) or 1.0
    small = sizes.where(F.col("size") < bound)
    small_total, n = small.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    small = small.withColumn("__b", hash_bucket(F.col("component"), buckets=bucket_count(n)))
    ordered = prefix_sum(small, [], "__b", [F.xxhash64("component"), "component"], "size", "__before")
    split, at = F.lit(targets[-1][0]), 0.0
    steps = []
    for name, _ in targets:
        at += rest[name] / scale * small_total
        steps.append((name, at))
    for name, end in reversed(steps[:-1]):
        split = F.when(F.col("__before") + F.col("size") / 2 < F.lit(end), F.lit(name)).otherwise(split)
    spark = sizes.sparkSession
    large = spark.createDataFrame(placed, "component string, split_name string")
    return ordered.select("component", split.alias("split_name")).unionByName(large)


UNITS = "unit string, component string"
RECORDINGS = "recording string, unit string"
COMPONENTS = "component string, root string, size bigint, split_name string, status string, load bigint"


class ComponentTable:
    """The component table under ``folder``, a path that all executors and later sessions can read.

    units: unit, component as of its first load. recordings: recording, one of its units. components: for each load the rows
    of components that are new or changed: component, root (itself or what it merged into), size, split_name, status (``new``,
    ``kept``, ``quarantined``) of the root. The row of the latest load holds."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: list[tuple[int, str]] | None = None  # listed once while a load runs

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def loads(self) -> list[tuple[int, str]]:
        """Number and name of every finished load."""
        path = f"{self.folder}/loads"
        if not self._exists(path):
            return []
        return sorted((r["load"], r["name"]) for r in self.spark.read.schema("load bigint, name string").parquet(f"{path}/*").collect())

    def _read(self, part: str, schema: str) -> DataFrame:
        known = self.loads() if self._known is None else self._known
        parts = [f"{self.folder}/{part}/load={n}" for n, _ in known]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def units(self) -> DataFrame:
        return self._read("units", UNITS)

    def recordings(self) -> DataFrame:
        return self._read("recordings", RECORDINGS)

    def components(self) -> DataFrame:
        """component, root, size, split_name, status: the latest row of each component."""
        rest = F.struct("root", "size", "split_name", "status")
        return self._read("components", COMPONENTS).groupBy("component").agg(F.max_by(rest, "load").alias("x")).select("component", "x.*")

    def current(self) -> DataFrame:
        """unit, component, split_name, status of every unit. Components are at most one step from their root."""
        c = self.components().select(F.col("component").alias("__c"), "root", "split_name", "status")
        return self.units().join(c, F.col("component") == F.col("__c")).select("unit", F.col("root").alias("component"), "split_name", "status")

    def _write(self, df: DataFrame, part: str, load: int) -> DataFrame:
        path = f"{self.folder}/{part}/load={load}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, name: str, rows: DataFrame, row_id: str, speaker: str, recording: str, targets: Sequence[tuple[str, float]]) -> None:
        """Take in rows not seen before. Only they, the units and recordings they name, and components they change are joined
        row by row; of the table's other parts one scan each is read."""
        done = self.loads()
        if name in {n for _, n in done}:
            return
        self._known = done
        try:
            self._take(len(done), name, rows, row_id, speaker, recording, targets)
        finally:
            self._known = None

    def _take(self, load: int, name: str, rows: DataFrame, row_id: str, speaker: str, recording: str, targets: Sequence[tuple[str, float]]) -> None:
        work: list[str] = []

        def kept(df: DataFrame, what: str) -> DataFrame:
            df, folder = cut(df, what)
            work.append(folder)
            return df

        # one row for each distinct pair of speaker and recording: rows of a hot speaker are counted map-side
        pairs = rows.select(row_id, speaker, recording).groupBy(
            F.col(speaker).alias("speaker"), F.col(recording).alias("recording"), F.when(F.col(speaker).isNull() & F.col(recording).isNull(), F.col(row_id)).alias("alone")
        ).agg(F.count(F.lit(1)).alias("n"))
        pairs = kept(pairs.select(_unit(F.col("speaker"), F.col("recording"), F.col("alone")).alias("unit"), "recording", "n"), "load-pairs")
        sizes = pairs.groupBy("unit").agg(F.sum("n").alias("size"))
        units = self.units().select(F.col("unit").alias("__u"), F.col("component").alias("__c"))
        state = self.components()
        roots = state.select(F.col("component").alias("__c"), "root")
        of_unit = kept(
            sizes.join(units, F.col("unit") == F.col("__u"), "left").join(roots, "__c", "left").select("unit", "size", F.coalesce("root", "unit").alias("node"), F.col("__u").isNull().alias("is_new")),
            "load-units",
        )
        # a star for each recording: its units to the unit it is known by, or to its smallest
        touched = pairs.where("recording IS NOT NULL").select("recording", "unit").distinct()
        known = self.recordings().select(F.col("recording").alias("__r"), F.col("unit").alias("hub"))
        hubs = touched.groupBy("recording").agg(F.min("unit").alias("least"), F.count(F.lit(1)).alias("n"))
        hubs = kept(hubs.join(known, F.col("recording") == F.col("__r"), "left").select("recording", F.coalesce("hub", "least").alias("hub"), "n", F.col("hub").isNull().alias("is_new")), "load-hubs")
        star = touched.join(hubs.where("n > 1 OR NOT is_new").select("recording", "hub"), "recording").where("unit <> hub").select("unit", "hub").distinct()
        nodes = of_unit.select(F.col("unit").alias("__u"), "node")
        old_hubs = units.join(star.select(F.col("hub").alias("__u")).distinct(), "__u", "left_semi").join(roots, "__c").select("__u", F.col("root").alias("v"))
        links = (
            star.join(nodes.select("__u", F.col("node").alias("u")), F.col("unit") == F.col("__u")).drop("__u")
            .join(old_hubs, F.col("hub") == F.col("__u"), "left").drop("__u")
            .join(nodes.select("__u", F.col("node").alias("w")), F.col("hub") == F.col("__u"), "left").drop("__u")
            .select("u", F.coalesce("v", "w", "hub").alias("v"))
        )
        merged = merge_links(links)
        # components this load makes, enlarges or merges: new nodes with their sizes, old roots as they were
        added = of_unit.groupBy("node").agg(F.sum("size").alias("size"))
        heads = state.where("component = root").select(F.col("component").alias("node"), F.col("size").alias("old_size"), F.col("split_name").alias("old_split"))
        named = added.select("node", "size").unionByName(merged.select("node", F.lit(0).cast("bigint").alias("size"))).unionByName(merged.select(F.col("root").alias("node"), F.lit(0).cast("bigint").alias("size")))
        named = named.groupBy("node").agg(F.sum("size").alias("size"))
        named = named.join(merged, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size").join(heads, "node", "left")
        named = kept(named, "load-nodes")
        groups = named.groupBy("root").agg(
            (F.sum("size") + F.coalesce(F.sum("old_size"), F.lit(0))).alias("size"), F.min("old_split").alias("lo"), F.max("old_split").alias("hi")
        )
        groups = kept(groups, "load-groups")
        clash = (F.col("lo") != F.col("hi")) | (F.col("lo") == QUARANTINE)
        stays = groups.where("lo IS NOT NULL").select(
            "root", "size", F.when(clash, F.lit(QUARANTINE)).otherwise(F.col("lo")).alias("split_name"), F.when(clash, "quarantined").otherwise("kept").alias("status")
        )
        # what each split holds: untouched components, and touched ones that stay
        touched_heads = named.where("old_split IS NOT NULL").select("node")
        held = state.where("component = root").join(touched_heads, F.col("component") == F.col("node"), "left_anti").select("split_name", "size").unionByName(stays.select("split_name", "size"))
        filled = {r["split_name"]: r["s"] for r in held.where(F.col("split_name") != QUARANTINE).groupBy("split_name").agg(F.sum("size").alias("s")).collect()}
        new = fill_deficits(groups.where("lo IS NULL").select(F.col("root").alias("component"), "size"), targets, filled)
        new = new.join(groups.select(F.col("root").alias("component"), "size"), "component").select(F.col("component").alias("root"), "size", "split_name", F.lit("new").alias("status"))
        decided = kept(stays.unionByName(new), "load-decided")
        # members of changed roots, so that all stay one step from theirs
        moved = named.select(F.col("node").alias("__n"), F.col("root").alias("to"))
        members = state.select("component", F.col("root").alias("was")).join(moved, F.col("was") == F.col("__n")).select("component", F.col("to").alias("root"))
        every = members.unionByName(named.select(F.col("node").alias("component"), "root")).unionByName(decided.select(F.col("root").alias("component"), "root")).distinct()
        self._write(of_unit.where("is_new").select("unit", F.col("node").alias("component")), "units", load)
        self._write(hubs.where("is_new").select("recording", F.col("hub").alias("unit")), "recordings", load)
        self._write(every.join(decided, "root").select("component", "root", "size", "split_name", "status", F.lit(load).cast("bigint").alias("load")), "components", load)
        self.spark.createDataFrame([(load, name)], "load bigint, name string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/loads/load={load}")
        for folder in work:
            drop_table(self.spark, folder)


def _unit(speaker: Column, recording: Column, row_id: Column) -> Column:
    """The person, else the recording, else the row itself."""
    return (
        F.when(speaker.isNotNull(), F.concat(F.lit("p"), person_key(speaker)))
        .when(recording.isNotNull(), F.concat(F.lit("a"), recording))
        .otherwise(F.concat(F.lit("r"), row_id.cast("string")))
    )


def row_splits(table: ComponentTable, rows: DataFrame, row_id: str, speaker: str, recording: str) -> DataFrame:
    """row_id, split_name, status. Units are named once for each distinct speaker or recording; rows of hot speakers aren't
    gathered (:func:`kikitori.operators.hot.spread_join`)."""
    current = table.current()
    base = rows.select(F.col(row_id).alias("row_id"), F.col(speaker).alias("speaker"), F.col(recording).alias("recording"))
    named = base.where("speaker IS NOT NULL")
    people = named.select("speaker").distinct().select("speaker", F.concat(F.lit("p"), person_key(F.col("speaker"))).alias("unit"))
    by_speaker = people.join(current, "unit").select("speaker", "split_name", "status")
    bare = base.where("speaker IS NULL").select(
        "row_id", F.when(F.col("recording").isNotNull(), F.concat(F.lit("a"), "recording")).otherwise(F.concat(F.lit("r"), F.col("row_id").cast("string"))).alias("unit")
    )
    out = ["row_id", "split_name", "status"]
    return spread_join(named, by_speaker, "speaker").select(*out).unionByName(spread_join(bare, current.drop("component"), "unit").select(*out))


def bound_speakers(table: ComponentTable, rows: DataFrame, speaker: str) -> DataFrame:
    """speaker_id, group_id for stored ids that must stay with another stored id; group_id is the group's smallest. The
    components are those of the table, into which the rows have been loaded."""
    ids = rows.where(F.col(speaker).isNotNull()).select(F.col(speaker).alias("speaker_id")).distinct()
    ids = ids.select("speaker_id", F.concat(F.lit("p"), person_key(F.col("speaker_id"))).alias("unit"))
    c, _ = cut(ids.join(table.current(), "unit").select("speaker_id", "component"), "speaker-components")
    group = c.groupBy("component").agg(F.min("speaker_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(group, "component").select("speaker_id", "group_id")
