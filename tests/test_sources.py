import dataclasses
import json
import wave

import pytest
from pyspark.sql import functions as F

from kikitori.plans import config
from kikitori.sources import readers as R
from kikitori.sources import writers as W


def test_data_files():
    assert R.parse_data_files(None) is None and R.parse_data_files([" "]) is None
    assert R.parse_data_files(['["a", "b"]']) == ["a", "b"]
    assert R.parse_data_files(["a, b"]) == ["a", "b"] and R.parse_data_files(["a"]) == "a" and R.parse_data_files(["a", "b"]) == ["a", "b"]
    assert R.parse_data_files(["train=a,b", "train=c", "test=d"]) == {"train": ["a", "b", "c"], "test": "d"}
    for bad in (["train=a", "b"], ["=a"], ["train="]):
        with pytest.raises(ValueError):
            R.parse_data_files(bad)
    assert R.parse_speaker_columns(["a, b", "c,"]) == ["a", "b", "c"]


def test_manifest_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    lines = [{"text": "甲", "latent_path": "a.pt", "num_frames": 3, "speaker_id": 7}, {"text": "b", "latent_path": "/x.pt", "caption": ["calm", "", None, " soft "]}, {"text": "c", "latent_path": "c", "caption": "bright"}]
    p.write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n")
    got = {r.text: r for r in R.read_manifest(spark, str(p)).collect()}
    assert got["甲"].speaker_id == "7" and got["甲"].caption is None
    assert got["b"].caption == ["calm", "", None, " soft "] and got["c"].caption == ["bright"]
    p.write_text('{"latent_path": "x"}\n')
    with pytest.raises(Exception, match="lacks text"):
        R.read_manifest(spark, str(p)).collect()


def test_folders(spark, tmp_path):
    for name, n in (("spk_a", 8000), ("spk_b", 100)):
        (tmp_path / name).mkdir()
        with wave.open(str(tmp_path / name / "0001.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes(b"\0\0" * n)
    (tmp_path / "spk_a" / "broken.wav").write_bytes(b"nothing")
    got = R.scan_wav_folders(spark, str(tmp_path), 0.5).collect()
    assert [(r.label, r.seconds) for r in got] == [("spk_a", 1.0)]
    ck = tmp_path / "ck"
    ck.mkdir()
    for n in ("checkpoint_10.pt", "checkpoint_best_val_loss_20_0.5.pt", "checkpoint_final.pt"):
        (ck / n).write_bytes(b"")
    assert sorted((r.kind, r.step) for r in R.scan_checkpoints(spark, str(ck)).collect()) == [("best", 20), ("periodic", 10)]


def test_names_and_columns(spark):
    assert W.candidate_names("out", ".wav", 1) == ["out.wav"] and W.candidate_names("out", ".wav", 2) == ["out_001.wav", "out_002.wav"]
    with pytest.raises(ValueError, match="missing columns: nope"):
        R.require_columns(spark.range(1), "id", "nope")
    assert spark.range(1).select(R.chunks(F.lit(130.0), 60.0)).first()[0] == [0.0, 60.0, 120.0]


@dataclasses.dataclass
class Settings:
    steps: int = 10
    ratio: float = 0.1


def test_settings():
    assert config.overlay(Settings(), {"steps": 5}, {"steps": 7}) == Settings(7)
    with pytest.raises(ValueError, match="unknown settings: x"):
        config.overlay(Settings(), {"x": 1})
    with pytest.raises(ValueError):
        config.check_ranges(Settings(), {"ratio": (0.2, None)})
    assert config.load_mapping("") == {} and config.keep_policy(True, 3) == 1 and config.keep_policy(False, 3) == 4
    assert config.shard_strategy("auto", True) == "contiguous"


def test_clips_of_any_text_come_back(spark, tmp_path):
    texts = ["", " ", " outer blanks ", "a, b", 'she said "no"', '"', '""', "a|b", "two\nlines", "one\rline", "both\r\nends", "back\\slash", '\\"', "#note", "\ttab\t", "ｱ😀", "「括弧」", "null", "file_name", "\u2028", "\x00", None]
    df = spark.createDataFrame([(f"{i:02d}.pt", t) for i, t in enumerate(texts)], "file_name string, transcription string").coalesce(1)
    W.write_clips(df, f"{tmp_path}/clips")
    W.write_piped(df, f"{tmp_path}/piped", "file_name", "transcription")
    for back in (R.read_clips(spark, f"{tmp_path}/clips"), R.read_piped(spark, f"{tmp_path}/piped")):
        assert [r[1] for r in sorted(back.collect())] == texts
