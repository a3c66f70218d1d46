"""Resampling: chunks equal whole clips, sines stay sines, and the format gate."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import api
from tidewright.operators import resample


def sine(rate, hertz, n, height=20_000):
    return np.rint(height * np.sin(2 * np.pi * hertz * np.arange(n) / rate)).astype(np.int16)


@pytest.mark.parametrize("old,new", [(44100, 16000), (48000, 16000), (8000, 16000), (22050, 44100), (16000, 16000), (44100, 16001)])
def test_sines_stay_sines(old, new):
    use = resample.kernel(old, new)
    pcm = sine(old, 1000, old // 2)
    got = use.chunk(pcm.astype(float), pcm[:0], pcm[:0], 0, len(pcm)).astype(float)
    assert len(got) == len(pcm) * new // old
    inner = slice(200, -200)
    want = 20_000 * np.sin(2 * np.pi * 1000 * np.arange(len(got)) / new)
    assert np.abs(got - want)[inner].max() < 60  # 0.3 % of the height


def test_what_the_lower_rate_cannot_hold_is_gone():
    pcm = sine(44100, 12_000, 20_000)
    got = resample.kernel(44100, 16000).chunk(pcm.astype(float), pcm[:0], pcm[:0], 0, len(pcm))
    assert np.abs(got[100:-100]).max() < 200  # 1 %; linear interpolation keeps most of it


@pytest.mark.parametrize("size", [100, 333, 4096])
def test_chunks_equal_whole_clips(spark, size):
    rng = np.random.default_rng(size)
    clips = {1: rng.integers(-30_000, 30_000, 5000), 2: rng.integers(-300, 300, size), 3: [], 4: rng.integers(-9, 9, 1), 5: None}
    rows = [(k, None if c is None else [int(x) for x in c], 44100 if k != 2 else 32000, "x") for k, c in clips.items()]
    df = spark.createDataFrame(rows, "id long, pcm array<smallint>, rate int, at string").repartition(3)
    whole = {r.id: r.pcm for r in resample.resampled(df, 16000).collect()}
    chunks = resample.resampled_chunks(resample.chunked(df, size), 16000, size=size, most_rate=44100)
    got = {}
    for r in chunks.orderBy("id", "k").collect():
        assert r.first == len(got.setdefault(r.id, []))
        got[r.id] += r.pcm
    assert got == whole and len(got[1]) == 5000 * 160 // 441 and got[3] == got[5] == []


def test_wav_chunks_and_gate(spark, tmp_path):
    def write(name, channels, rate, samples):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.asarray(samples, "<i2").tobytes())

    write("a.wav", 2, 44100, np.repeat(np.arange(1000), 2))
    chunks = resample.wav_chunks(spark, str(tmp_path / "a.wav"), 300)
    assert [(r.k, r.total, r.pcm[0], len(r.pcm)) for r in chunks.orderBy("k").collect()] == [(0, 1000, 0, 300), (1, 1000, 300, 300), (2, 1000, 600, 300), (3, 1000, 900, 100)]
    assert api.load_audio(spark, str(tmp_path / "a.wav"), 44100).first().pcm == list(range(1000))
    down = api.load_audio(spark, str(tmp_path / "a.wav"), 16000).first()
    assert (down.rate, len(down.pcm)) == (16000, 1000 * 160 // 441)
    for bad in ((1, 8000), (3, 44100)):
        write("b.wav", *bad, np.zeros(30))
        with pytest.raises(Exception, match=f"found {bad[1]} Hz, 16 bit, {bad[0]} channel"):
            api.load_audio(spark, str(tmp_path / "b.wav"), 16000).collect()
    with pytest.raises(ValueError):
        api.load_audio(spark, str(tmp_path / "c.mp3"))


def test_short_chunks_are_an_error(spark):
    df = spark.createDataFrame([(1, [1] * 100, 44100)], "id long, pcm array<smallint>, rate int")
    with pytest.raises(Exception, match="shorter than the kernel"):
        resample.resampled_chunks(resample.chunked(df, 10), 16000, size=10).select(F.sum(F.size("pcm"))).collect()
