import pytest
from pyspark.sql import functions as F

from kikitori.functions import arrays as A
from kikitori.functions import schedules as H
from kikitori.operators import manifest as M
from kikitori.operators.checks import REQUEST_RULES, SETTINGS_RULES, broken, first_broken
from kikitori.operators.segments import assign_speakers
from kikitori.plans import config
from kikitori.streaming import pipeline as P

GOOD_REQUEST = """SELECT 3.0D AS seconds, 1.0D AS duration_scale, 0.5D AS min_seconds, 30.0D AS max_seconds, 1 AS num_candidates, 'sequential' AS decode_mode, 'a' AS clean_text, 256 AS max_text_len,
true AS uses_caption, 512 AS max_caption_len, CAST(NULL AS DOUBLE) AS truncation_factor, CAST(NULL AS DOUBLE) AS rescale_k, CAST(NULL AS DOUBLE) AS rescale_sigma, true AS uses_speaker,
CAST(NULL AS DOUBLE) AS speaker_kv_scale, CAST(NULL AS DOUBLE) AS speaker_kv_min_t, CAST(NULL AS INT) AS speaker_kv_max_layers, 'independent' AS cfg_guidance_mode"""


@pytest.mark.parametrize(
    "changed,rule",
    [
        ({}, None),
        ({"seconds": "0.0D"}, "seconds"),
        ({"duration_scale": "CAST(NULL AS DOUBLE)"}, "duration_scale"),
        ({"max_seconds": "0.1D"}, "max_seconds"),
        ({"decode_mode": "'tree'"}, "decode_mode"),
        ({"decode_mode": "' Batch '"}, None),
        ({"clean_text": "'  '"}, "text"),
        ({"max_caption_len": "0"}, "max_caption_len"),
        ({"rescale_k": "1.0D"}, "rescale_pair"),
        ({"speaker_kv_scale": "2.0D", "speaker_kv_min_t": "1.5D"}, "speaker_kv_min_t"),
        ({"speaker_kv_scale": "2.0D", "speaker_kv_min_t": "1.5D", "uses_speaker": "false"}, None),
        ({"cfg_guidance_mode": "'serial'", "seconds": "-1.0D"}, "seconds"),
    ],
)
def test_requests(spark, changed, rule):
    df = spark.sql(GOOD_REQUEST).withColumns({k: F.expr(v) for k, v in changed.items()})
    assert df.select(first_broken(REQUEST_RULES)).first()[0] == rule
    found = df.select(broken(REQUEST_RULES)).first()[0]
    assert (found[0] if found else None) == rule


def test_rules_name_what_they_judge():
    assert len(SETTINGS_RULES) > 30 and len(REQUEST_RULES) > 15


def test_settings_files():
    text = "# a\n---\na:\n  b: 1\n  c: [x, 2, 'y''z']\n  d:\n    - 1.5\n    - \"q # r\"\ne: ~\nf: true\n"
    with pytest.raises(ValueError):
        config.load_mapping("a: 1\n    b: 2")
    assert config.load_mapping(text.replace("q # r", "q")) == {"a": {"b": 1, "c": ["x", 2, "y'z"], "d": [1.5, "q"]}, "e": None, "f": True}
    assert config.load_mapping('{"steps": 5}') == {"steps": 5} and config.load_mapping("  ") == {}
    with pytest.raises(ValueError):
        config.load_mapping("- 1\n- 2")


def test_turns_of_any_length_meet_words(spark):
    words = spark.createDataFrame([("r", 1, 5.0, 6.0), ("r", 2, 1e9, 1e9 + 1), ("r", 3, 25.0, 45.0), ("s", 4, 5.0, 6.0), ("r", 5, -50.0, -40.0)], "k string, word_id int, ws double, we double")
    turns = spark.createDataFrame([("r", "long", 0.0, 5e9), ("r", "near", 4.0, 7.0), ("r", "near", 4.0, 7.0), ("r", "mid", 20.0, 44.0), ("r", "gone", 9.0, 8.0)], "k string, speaker string, ts double, te double")
    got = {r.word_id: r.speaker for r in assign_speakers(words, turns, ["k"]).collect()}
    # ties go to the smaller name
    assert got == {1: "long", 2: "long", 3: "long", 4: None, 5: None}


def test_batches_are_padded_to_their_longest(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0]), (3, 1, [4.0]), (4, 1, None), (5, None, [])], "id int, batch int, x array<double>")
    got = {r.id: (r.padded, r.mask) for r in A.pad_batches(df, "batch", "x").collect()}
    assert got == {1: ([1.0, 2.0], [True, True]), 2: ([3.0, 0.0], [True, False]), 3: ([4.0], [True]), 4: ([0.0], [False]), 5: ([], [])}


def test_draws_dont_depend_on_partitions(spark):
    df = spark.range(500)
    draw = lambda n: sorted((r[0], r[1]) for r in df.repartition(n).select("id", H.logit_normal_t(3, F.col("id"))).collect())
    assert draw(1) == draw(7)
    z = [r[1] for r in draw(2)]
    assert 0.45 < sum(z) / len(z) < 0.55 and len(set(z)) == 500


def test_ranks_of_a_stream(spark):
    got = [r[0] for r in spark.range(9).select(M.rank_stream(F.col("id"), 1, 3)).collect()]
    assert got == [None, None, None, 0, 1, 2, 0, 1, 2]


def write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_retention_goes_on_after_a_restart(spark, tmp_path):
    schema, state = "step bigint, score double", f"file://{tmp_path}/state"
    stream = lambda: P.stream_files(spark, "parquet", f"{tmp_path}/in/*", schema)
    write_batches(spark, f"{tmp_path}/in", [[(1, 5.0), (2, 1.0)], [(3, 4.0)]], schema)
    assert sorted(r.step for r in P.retain_best(stream(), "score", "step", 2, state)().collect()) == [2, 3]
    spark.createDataFrame([(4, 0.5), (5, 9.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    assert sorted(r.step for r in P.retain_best(stream(), "score", "step", 2, state)().collect()) == [2, 4]


def test_smoothing_goes_on_from_batch_to_batch(spark, tmp_path):
    schema = "name string, step bigint, value double"
    write_batches(spark, f"{tmp_path}/in", [[("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)], [("a", 3, None), ("a", 4, 7.0)]], schema)
    s = P.smoothed(P.stream_files(spark, "parquet", f"{tmp_path}/in/*", schema), ["name"], "step", "value", 0.5)
    got = {(r.name, r.step): r.smoothed for r in P.run_once(s, f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    levels = {k: v for k, v in got.items() if k[0] == "a"}
    assert len(got) == 5 and got["b", 1] == 5.0 and levels["a", 1] in (1.0, 4.0, 7.0) and len(set(levels.values())) >= 3


def test_sessions_and_windows(spark, tmp_path):
    schema = "k string, ts timestamp"
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, x) AS ts FROM VALUES (0), (20), (40), (400), (90000) AS t(x)").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = lambda: P.stream_files(spark, "parquet", f"{tmp_path}/in*", schema)
    for made, want in ((P.sessions(rows(), ["k"], "ts", "30 seconds", "10 seconds"), [1, 3]), (P.windowed_counts(rows(), ["k"], "ts", "1 minute", "10 seconds"), [1, 3])):
        out = f"{tmp_path}/{len(made.columns)}{'s' if 'session_window' in made.columns else 'w'}"
        assert sorted(r.n for r in P.run_once(made, out, out + "-state").collect()) == want
