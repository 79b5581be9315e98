import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kikitori.llm.groups import QUARANTINE, ComponentTable, bound_speakers, merge_links, row_splits


def closed(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_merging_against_union_find(spark):
    rng = random.Random(9)
    links = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("n001", "n001")]
    got = {r.node: r.root for r in merge_links(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == closed(links)
    assert merge_links(spark.createDataFrame([], "u string, v string")).count() == 0


ROWS = [
    (1, "ns:ann__live", "a.wav"), (2, "ns:ann", None), (3, "ｎｓ:ann", "b.wav"), (4, "ns:bob", "b.wav"), (5, "other:ann", "c.wav"),
    (6, "900", "d.wav"), (7, "900", "d.wav"), (8, None, "b.wav"), (9, None, None), (10, "x:solo", None), (11, None, "e.wav"), (12, None, "e.wav"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, speaker_id string, audio_file string").withColumn("component", F.lit("clash"))


TARGETS = [("test", 0.2), ("train", 0.8)]


@pytest.fixture
def components(spark, tmp_path):
    return ComponentTable(spark, f"file://{tmp_path}/components")


def load(components, spark, name, rows):
    components.load(name, frame(spark, rows), "row_id", "speaker_id", "audio_file", TARGETS)


def splits(components, spark, rows):
    return {r.row_id: (r.split_name, r.status) for r in row_splits(components, frame(spark, rows), "row_id", "speaker_id", "audio_file").collect()}


def groups(components):
    found = defaultdict(set)
    for r in components.current().collect():
        found[r.component].add(r.unit)
    return sorted(map(sorted, found.values()))


def test_bound_speakers(spark, components):
    load(components, spark, "all", ROWS)
    got = {(r.speaker_id, r.group_id) for r in bound_speakers(components, frame(spark, ROWS), "speaker_id").collect()}
    assert got == {(s, "ns:ann") for s in ("ns:ann__live", "ns:ann", "ｎｓ:ann", "ns:bob")}
    assert bound_speakers(components, frame(spark, ROWS).where("false"), "speaker_id").count() == 0


def test_empty_table(spark, components):
    load(components, spark, "none", [])
    assert components.current().count() == 0 and splits(components, spark, ROWS) == {}
    load(components, spark, "some", ROWS[:2])
    assert groups(components) == [["pns:ann"]]


def test_rows_of_a_component_stay_together(spark, components):
    load(components, spark, "all", ROWS)
    got = splits(components, spark, ROWS)
    assert len(got) == 12 and all(v[0] in ("test", "train") and v[1] == "new" for v in got.values())
    of = {u: g for g, own in enumerate(groups(components)) for u in own}
    assert of["pns:ann"] == of["pns:bob"] == of["ab.wav"] and of["ae.wav"] != of["r9"] and of["pother:ann"] != of["pns:ann"]


def test_kept_new_and_quarantined(spark, components):
    first = [(i, f"ns:p{i}", None) for i in range(200)]
    load(components, spark, "first", first)
    before = splits(components, spark, first)
    shares = defaultdict(int)
    for s, _ in before.values():
        shares[s] += 1
    assert abs(shares["test"] - 40) <= 2
    test = next(i for i, v in before.items() if v[0] == "test")
    train = [i for i, v in before.items() if v[0] == "train"]
    more = [(300, f"ns:p{test}", "z.wav"), (301, f"ns:p{train[0]}", "z.wav"), (302, f"ns:p{train[1]}", "y.wav"), (303, f"ns:p{train[2]}", "y.wav"), (304, "ns:late", None)]
    load(components, spark, "more", more)
    after = splits(components, spark, first + more)
    assert after[test] == (QUARANTINE, "quarantined") and after[train[0]][0] == QUARANTINE and after[300][0] == QUARANTINE
    assert after[302] == ("train", "kept") and after[304][1] == "new"
    assert all(after[i][0] == before[i][0] for i in before if i not in (test, train[0]))
    # the second load wrote what is new or changed only
    written = {r.component for r in spark.read.parquet(f"{components.folder}/components/load=1").collect()}
    assert written == {f"pns:p{i}" for i in (test, *train[:3])} | {"pns:late"}
    assert [r.unit for r in spark.read.parquet(f"{components.folder}/units/load=1").collect()] == ["pns:late"]
    sizes = {r.component: r.size for r in components.components().collect()}
    assert sizes["pns:late"] == 1 and sizes[min(f"pns:p{train[1]}", f"pns:p{train[2]}")] == 4


def test_later_loads_meet_recordings_of_earlier_ones(spark, components):
    load(components, spark, "1", [(1, "a:x", "r1"), (2, "a:y", "r2"), (3, None, "r3")])
    load(components, spark, "2", [(4, "a:z", "r1"), (5, "a:w", "r3"), (6, "a:v", "r9")])
    assert groups(components) == [["ar3", "pa:w"], ["pa:v"], ["pa:x", "pa:z"], ["pa:y"]]
    load(components, spark, "3", [(7, "a:z", "r2"), (8, "a:v", "r3")])
    assert groups(components) == [["ar3", "pa:v", "pa:w"], ["pa:x", "pa:y", "pa:z"]]


def test_loads_one_by_one_give_the_components_of_one_load(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, f"n:s{rng.randint(0, 25)}"]), rng.choice([None, f"r{rng.randint(0, 25)}"])) for i in range(60)]
    whole, parts = (ComponentTable(spark, f"file://{tmp_path}/{x}") for x in "ab")
    load(whole, spark, "all", rows)
    for n in range(3):
        load(parts, spark, str(n), rows[n * 20 : n * 20 + 20])
    assert groups(whole) == groups(parts)
    got = splits(parts, spark, rows)
    by = defaultdict(set)
    for r in parts.current().collect():
        by[r.component].add(r.split_name)
    assert all(len(v) == 1 for v in by.values()) and len(got) == 60


def test_a_load_is_taken_once_and_a_broken_one_again(spark, components):
    load(components, spark, "1", ROWS)
    load(components, spark, "1", ROWS)
    assert [n for _, n in components.loads()] == ["1"] and sum(r.size for r in components.components().where("component = root").collect()) == 12
    # a load that broke off left files but no marker
    spark.createDataFrame([("px", "px")], "unit string, component string").write.parquet(f"{components.folder}/units/load=1")
    assert "px" not in {r.unit for r in ComponentTable(spark, components.folder).units().collect()}
    load(ComponentTable(spark, components.folder), spark, "2", [(99, "late:one", None)])
    assert {r.unit for r in components.units().collect()} >= {"plate:one", "pns:ann"} and "px" not in {r.unit for r in components.units().collect()}
