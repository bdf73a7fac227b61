import hashlib
import zlib

import numpy as np
import pytest

from spindrift.llm import audio
from spindrift.llm.scratch import Scratch


def test_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    # values of the standard's end codes. Fixed values.
    assert (mu[0x00], mu[0x80], mu[0x7F], mu[0xFF], mu[0x2A]) == (-32124, 32124, 0, 0, -5372)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255
    assert len(audio.ima_steps()) == 89


def scalar_ima(data, block):
    out, steps = [], audio.ima_steps()
    for k in range(0, len(data), block):
        b = data[k : k + block].ljust(block, b"\0")
        v, i = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(v)
        for byte in b[4:]:
            for c in (byte & 15, byte >> 4):
                step = int(steps[i])
                d = step >> 3
                d += step >> 2 if c & 1 else 0
                d += step >> 1 if c & 2 else 0
                d += step if c & 4 else 0
                v = max(-32768, min(32767, v - d if c & 8 else v + d))
                i = max(0, min(88, i + int(audio.IMA_INDEX[c & 7])))
                out.append(v)
    return out


@pytest.mark.parametrize("n", [0, 5, 64, 200, 999])
def test_ima(n):
    data = np.random.default_rng(n).bytes(n)
    assert audio.decode_ima(data, 36).tolist() == scalar_ima(data, 36)


@pytest.mark.parametrize("rate,to", [(8000, 16000), (8000, 8000), (11025, 8000), (48000, 16000)])
def test_resampling_keeps_a_tone(rate, to, monkeypatch):
    t = np.arange(rate) / rate
    tone = np.rint(9000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    whole = np.concatenate(list(audio.resample(tone, rate, to)))
    assert len(whole) == to
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(to) / to)
    assert np.abs(whole - want)[200:-200].max() < 120
    monkeypatch.setattr(audio, "PIECE", 1000)
    assert np.array_equal(np.concatenate(list(audio.resample(tone, rate, to))), whole)
    assert list(audio.resample(tone[:0], rate, to)) == []


def test_containers():
    for form, block, bits in ((audio.PCM, 2, 16), (audio.ALAW, 1, 8), (audio.MULAW, 1, 8), (audio.IMA, 36, 4)):
        blob = audio.wav(b"abcde" * 10, form, 8000, block, bits)
        assert audio.read_wav(blob)[0::3] == (form, b"abcde" * 10) and audio.to_pcm([blob])[0] is not None
    assert audio.to_pcm([None, b"", b"RIFFxxxxWAVE", audio.wav(b"x", 99), audio.wav(b"x", audio.IMA, 8000, 8, 4).replace(b"\x08\x00\x04\x00", b"\x03\x00\x04\x00")]) == [None] * 5


def brute_feature(form, payload):
    """Sample by sample: the laws by their formulas, ADPCM by its steps, twice the rate by the filter's taps."""
    if form == audio.IMA:
        pcm = scalar_ima(payload, 64)
    elif form == audio.MULAW:
        pcm = [(-1 if c < 128 else 1) * ((((~c & 15) << 3) + 132 << (~c >> 4 & 7)) - 132) for c in payload]
    else:
        pcm = []
        for c in payload:
            x = c ^ 0x55
            size = ((x & 15) << 4) + 8 + (256 if x >> 4 & 7 else 0)
            pcm.append((1 if x & 128 else -1) * (size << max((x >> 4 & 7) - 1, 0)))
    taps, out = audio._taps(2, 1, 8), []
    for j in range(2 * len(pcm)):
        total = np.float32(0)
        for k in range(16):
            at = j // 2 - 7 + k
            total += np.float32(pcm[at] if 0 <= at < len(pcm) else 0) * taps[j % 2, k]
        out.append(max(-32768, min(32767, int(np.rint(total)))))
    changes = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
    crc = zlib.crc32(np.array(out, "<i2").tobytes())
    return f"n={len(out)};peak={max(map(abs, out))};rms={int((sum(x * x for x in out) // len(out)) ** 0.5)};cross={changes};crc={crc:08x}"


def test_query_columns(spark):
    texts = [None, "", "é😀", "a" * 64, "b" * 65, "long " * 50000, "b" * 65, *(f"some text number {i} of it, " * 9 for i in range(20))]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in audio.digests(audio.store(df)).collect()}
    forms = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = (audio.MULAW, audio.ALAW, audio.IMA)[zlib.crc32(payload) % 3]
        blob = audio.wav(payload, form, 8000, *((64, 4) if form == audio.IMA else (1, 8)))
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        forms.add(form)
        if len(payload) < 1000:
            assert r.feature == brute_feature(form, payload)
    assert len(forms) == 3 and rows[4][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    assert audio.digests(audio.store(df.limit(0))).count() == 0


def test_decode_column(spark):
    good = audio.wav(b"zz" * 40, audio.IMA, 8000, 64, 4)
    df = spark.createDataFrame([(1, None, "p"), (2, b"", "p"), (3, audio.wav(b"zz", audio.ALAW), "p"), (4, good, "p"), (4, good, "p")], "id int, m binary, pcm string")
    got = sorted((r.id, r.pcm and bytes(r.pcm)) for r in audio.decode_column(df, "m").collect() if r.pcm)
    assert [g[0] for g in got] == [3, 4, 4] and got[1] == got[2]
    form, rate, _, data = audio.read_wav(got[2][1])
    assert (form, rate) == (audio.PCM, 16000) and len(data) == 2 * 2 * len(scalar_ima(b"zz" * 40, 64))


def test_stored_pcm_is_what_the_features_are_of(spark):
    texts = [None, "", "a" * 64, *(f"text {i} " * (i + 3) for i in range(12))]
    stored = audio.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pcm = audio.stored_pcm(stored, "media", Scratch(spark, "pcm"))
    assert pcm.columns == ["doc_id", "n_bytes", "pcm"] and pcm.inputFiles()
    assert {r.doc_id: audio.features(bytes(r.pcm)) for r in pcm.collect()} == {r.doc_id: r.feature for r in audio.digests(stored).collect()}
