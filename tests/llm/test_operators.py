"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallgrass.llm import avimedia, bestfit, bpe, bytecnn, components, hilbert, learning, oph, queries, shingles, simhash, subword, urls, zframes
from tallgrass.llm.common import shared_dir

#: Nulls in any column, empty, blank and very long texts, repeated rows, ties, and columns whose names clash with what operators use inside.
ROWS = [
    (1, "one two three four five six seven", "en", "a", 30, 0, "x"), (1, "one two three four five six seven", "en", "a", 30, 0, "x"), (2, None, "en", "a", None, 1, None), (3, "", None, None, 0, 2, None),
    (None, "one two three four five six seven", None, "b", 5, 3, "y"), (4, " \t\n ", "fr", "b", 4, 4, "z"), (5, "été à la plage", "fr", "b", 14, 5, "z"), (6, "long " * 60_000, "en", "c", 300_000, 6, None), (None, None, None, None, None, None, None),
    (7, "x" * 50_000, "en", "a", 50_000, 7, ""), (8, "12 34 !!", "en", "a", 8, 8, ""), (9, "<|endoftext|> 日本語 𝔸 ́", "fr", "a", 9, 9, "q"),
]
CLASHING = ("_id", "_keep_id", "_keep_digest", "_range", "_copied", "_to", "_draw", "_language", "_quality", "group", "id", "fp", "fingerprint", "ids", "media", "next_text", "bin", "length")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, digest string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fingerprints_of_all_queries_have_a_row_for_each_document(spark, sf, docs):
    for name in ("op1_byte_cnn_language", "op2_hilbert_shards", "op7_subword_quality"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, sf).collect()) == [d[0] for d in docs]


# 1: language

def test_language_accuracy(spark, sf, docs):
    got = {r.doc_id: r for r in bytecnn.op1_byte_cnn_language(spark, sf).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert all(got[d[0]].held_out == (zlib.crc32(str(d[0]).encode()) % 3 == 1) for d in docs)
    assert sum(got[d[0]].lang_pred == d[2] for d in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_rows(awkward, empty):
    got = rows(bytecnn.identify(awkward, awkward).select("doc_id", "text", "language.lang", "language.score"))
    assert len(got) == len(ROWS)
    for _, text, lang, score in got:
        assert (lang == "und") == (not text or not any(map(str.isalpha, text))) and 0 <= score <= 1
    assert {r[2] for r in rows(bytecnn.identify(awkward, empty).select("doc_id", "text", "language.lang"))} == {"und"}
    assert rows(bytecnn.identify(empty, awkward)) == []
    assert bytecnn.keep_identified(awkward, empty).count() == len(ROWS)
    letterless = awkward.withColumn("text", F.lit("12 !!"))
    assert bytecnn.keep_identified(awkward, letterless).count() == len(ROWS)
    kept = bytecnn.keep_identified(awkward, awkward, least=0.0)
    assert kept.columns == awkward.columns and kept.count() == sum(any(map(str.isalpha, r[1] or "")) for r in ROWS) and kept.where("lang IS NULL").count() == 0
    assert {r.lang for r in bytecnn.keep_identified(awkward.withColumn("lang", F.lit(None).cast("string")), awkward, least=0.0, languages=["fr", "xx"]).collect()} <= {"fr"}


def test_language_scores_equal_brute_force(spark):
    """Window by window and filter by filter, without look-up tables."""
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.integers(1, 256, (3, bytecnn.WINDOW)).astype(np.uint8)
    p = bytecnn.train(x[:0], np.zeros(0, int), 3)
    p["v"], p["c"] = rng.normal(0, 1, p["v"].shape).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32)
    texts = ["short", "été " * 90, "12", None, "x" * 700]
    got = bytecnn.predict_udf(["a", "b", "c"], p).func(pd.Series(texts))
    for t, (lang, score) in zip(texts, got.itertuples(index=False), strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0)
            continue
        data, total, weight = t.encode(), np.zeros(3), 0
        for at in range(0, len(data), bytecnn.WINDOW):
            part = data[at : at + bytecnn.WINDOW]
            e = p["e"][list(part.ljust(bytecnn.WINDOW, b"\0"))]
            hidden = [max(0.0, max(float((e[i : i + w].ravel() * p[f"k{w}"][:, f]).sum()) for i in range(bytecnn.WINDOW - w + 1)) + float(p[f"b{w}"][f])) for w in bytecnn.WIDTHS for f in range(bytecnn.FILTERS)]
            total += len(part) * (np.array(hidden) @ p["v"] + p["c"])
            weight += len(part)
        z = np.exp(total / weight - (total / weight).max())
        assert lang == "abc"[z.argmax()] and abs(score - z.max() / z.sum()) < 1e-4


def test_network_gradients():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 256, (5, bytecnn.WINDOW)).astype(np.uint8)
    p = bytecnn.train(x[:0], np.zeros(0, int), 3)
    y = np.array([0, 1, 2, 1, 0])
    p = {k: v.astype(np.float64) for k, v in p.items()}
    p["v"] = rng.normal(0, 1, p["v"].shape)

    def loss():
        z = bytecnn.Predictor(p).logits(x).astype(np.float64)
        return -(z[np.arange(5), y] - np.log(np.exp(z).sum(axis=1))).mean()

    g = bytecnn._gradients(p, x, y)
    for name, at in (("v", (3, 1)), ("c", (2,)), ("b2", (4,)), ("k3", (5, 2))):
        was, step = p[name][at], 1e-2
        p[name][at] = was + step
        up = loss()
        p[name][at] = was - step
        down = loss()
        p[name][at] = was
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


# 2: sharding

def test_hilbert_curve_steps_to_neighbours(spark):
    for bits, n in ((2, 3), (4, 2), (1, 3), (3, 1)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"a{i}") for i in range(n)])
        order = sorted((r[-1], r[:-1]) for r in rows(cells.select("*", hilbert.hilbert_index([F.col(f"a{i}") for i in range(n)], bits).alias("h"))))
        assert [h for h, _ in order] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(order, order[1:], strict=False))


def test_shards_are_runs_of_the_curve(spark, sf, docs):
    got = hilbert.op2_hilbert_shards(spark, sf).collect()
    by_place = sorted((r.shard, r.slot, r.curve) for r in got)
    sizes = [sum(s == k for s, _, _ in by_place) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and [c for *_, c in by_place] == sorted(c for *_, c in by_place)
    assert all([t for s, t, _ in by_place if s == k] == list(range(sizes[k])) for k in range(16))
    text = {d[0]: d[1].encode() for d in docs}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in got)


def test_shards_of_awkward_rows(spark, awkward, empty):
    dims = {"lang": F.col("lang"), "n_chars": F.col("n_chars")}
    got = sorted((r.shard, r.slot) for r in hilbert.hilbert_shards(awkward, dims, n_shards=5).collect())
    assert got == [(k, i) for k in range(5) for i in range(3 if k in (0, 2) else 2)] or sorted(x[0] for x in got) == [0] * 3 + [1] * 2 + [2] * 3 + [3] * 2 + [4] * 2
    assert rows(hilbert.hilbert_shards(empty, dims)) == []


def test_string_dimensions_are_cut_at_their_quantiles(spark, empty):
    values = [f"https://example.org/a-long-common-start/{i % 37:03d}" for i in range(1000)] + [None, "", "é"]
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(5)
    ordered = sorted((v or "" for v in values), key=lambda v: v.encode())
    want = [ordered[-(-k * len(ordered) // 16) - 1] for k in range(1, 16)]
    assert hilbert.string_cuts(df, {"s": F.coalesce("s", F.lit(""))}, 4) == {"s": want}
    assert hilbert.string_cuts(empty, {"s": F.col("text")}, 4) == {"s": []} and hilbert.string_cuts(empty, {}, 4) == {}
    got = hilbert.hilbert_shards(df.withColumn("id", F.lit(None).cast("long")), {"s": F.col("s")}, id_col="id", keep={"v": F.col("s")}, n_shards=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(k, i) for k in range(4) for i in range(251 if k < 3 else 250)]
    assert len({r.curve for r in got}) > 8


def test_shard_files_are_pruned(spark, sf):
    df, path = spark.read.parquet(f"{sf}/documents.parquet"), f"{shared_dir(spark)}/shards-test"
    assert sum(r.n_rows for r in hilbert.write_shards(df, path, ["source", "n_chars"], n_shards=8).collect()) == df.count()
    assert hilbert.read_shards(spark, path, "n_chars", 100, 400).count() == df.where("n_chars BETWEEN 100 AND 400").count()


def test_shard_files_of_awkward_rows(spark, awkward, empty):
    path = f"{shared_dir(spark)}/shards-awkward"
    manifest = hilbert.write_shards(awkward, path, ["lang", "n_chars"], n_shards=4)
    assert manifest.columns[0] == "shard_" and sorted(r.n_rows for r in manifest.collect()) == [3, 3, 3, 3]
    back = spark.read.parquet(f"{path}/data")
    assert sorted(map(repr, rows(back.select("doc_id", "text", "lang", "source", "n_chars", "shard", "digest")))) == sorted(map(repr, ROWS))
    assert hilbert.read_shards(spark, path, "lang", "en", "en").count() == awkward.where("lang = 'en'").count()
    assert rows(hilbert.write_shards(empty, f"{path}-empty", ["lang"])) == []


# 3: token files

def test_token_files(spark, sf, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: tuple(r)[1:] for r in zframes.op3_zstd_frames(spark, sf).collect()}
    for doc_id, text, *_ in docs:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert got[doc_id] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_token_files_of_awkward_rows(spark, awkward, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, folder = Tokenizer.from_file(path), f"{shared_dir(spark)}/tokens-test"
    encoder = lambda: zframes.word_encoder(path, 2).encode
    manifest = zframes.write_tokens(awkward, encoder, folder)
    want = sorted(np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in ROWS)
    back = zframes.read_tokens(manifest).collect()
    assert sorted(bytes(r.ids) for r in back) == want
    order = sorted(back, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(len(x.ids) // 4 for x in order[:i]) for i in range(len(order))]
    assert [r.id is None for r in order] == [True] * 2 + [False] * (len(ROWS) - 2) and [r.id for r in order[2:]] == sorted(r[0] for r in ROWS if r[0] is not None)
    assert {(r.id, bytes(r.ids)) for r in zframes.find_tokens(manifest, [5, 7, 99]).collect()} == {(r.id, bytes(r.ids)) for r in back if r.id in (5, 7)}
    assert rows(zframes.read_tokens(zframes.write_tokens(empty, encoder, folder))) == []


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers as P

    w = zframes.WordEncoder(P.path("word_bpe_49k.json"), 2)
    for x in ["A<|endoftext|>b x<|startoftext|>", "ΣΑΣ Σ. İstanbul ŒUVRE œ K Å ẞ", "don't I'll 'S 12ab3 a.b,c a..b !?,", "é é ́x ª º µ ß ŉ", "\t\x0b\x1c a b c", "|| a|b | x|", "THE!! the*** &&& , .", "a­b naïve… “q”", "A<|ENDOFTEXT|> B, x2.. y², e\u0301, ok.", "word), \"q\". 5, 5.5, a_, b_b. ŒUVRE, Été. $$$", "x,\u00a0y.\u2003z!\u0085w;"] * 2:
        assert np.frombuffer(w.encode(x), "<u4").tolist()[:-1] == w.tokenizer.encode(x, add_special_tokens=False).ids, x


def test_word_encoder_equals_the_tokenizer_on_all_characters():
    import public_tokenizers as P

    w = zframes.WordEncoder(P.path("word_bpe_49k.json"), 2)
    points = [chr(c) for c in [*range(1, 0x3400), *range(0xA000, 0xAC10), *range(0xD7A0, 0xD800), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)]]
    for forms in ("a{0}. {0}, {0}", "{0}.. x{0}\u0301. {0}s! A{0}B; {0}\u0327?"):
        texts = [" ".join(forms.format(c) for c in points[at : at + 64]) for at in range(0, len(points), 64)]
        want = w.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for t, e in zip(texts, want, strict=True):
            assert np.frombuffer(w.encode(t), "<u4").tolist()[:-1] == e.ids, t


def test_damaged_token_file(spark, tmp_path):
    path = str(tmp_path / "a.tok.zst")
    w = zframes.FrameWriter(path)
    for i in range(3):
        w.add(i, struct.pack("<4I", i, i, i, i))
    w.close()
    assert [d for d, _ in zframes.FrameReader(path)] == [0, 1, 2]
    data = bytearray(open(path, "rb").read())
    data[-9 - 12 * 3] ^= 1  # the second document's checksum or size
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(zframes.FrameReader(path))


# 4: media

def test_media_round_trip(spark, sf, docs):
    got = {r.doc_id: r for r in avimedia.op4_avi_mjpeg(spark, sf).collect()}
    for doc_id, text, *_ in docs:
        p = text.encode()
        p += b"\xff" * (-len(p) % 576 or (0 if p else 576))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_media_of_awkward_rows(awkward, empty):
    got = avimedia.analyse_videos(avimedia.store_videos(awkward)).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted(avimedia.payload_of(r[1]) for r in ROWS)
    for r in got:
        frames = [(c.first_frame, c.last_frame) for c in r.clips]
        assert frames[0][0] == 0 and frames[-1][1] == len(r.payload) // 576 - 1 and all(a[1] + 1 == b[0] for a, b in zip(frames, frames[1:], strict=False))
    assert rows(avimedia.clip_rows(avimedia.store_videos(empty))) == []


def test_frames_and_shots():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 60, (12, 576)), rng.integers(180, 256, (9, 576)), np.full((1, 576), 255)]).astype(np.uint8)
    frames = avimedia.encode_frames(x)
    assert (np.array(avimedia.decode_frames(frames)) == x).all()
    back, seconds = avimedia.read_avi(avimedia.write_avi(frames))
    assert back == frames and seconds == 0.04
    begins, _ = avimedia.shots(avimedia.histograms(list(x[:21])), np.zeros(21, int))
    assert np.flatnonzero(begins).tolist() == [0, 12]
    for damaged in (frames[0][:-10] + b"\xff\xd9", frames[0][:-2], b"no frame"):
        with pytest.raises(ValueError):
            avimedia.decode_frames([damaged])


def brute_shots(frames):
    """A frame at a time, each neighbourhood listed."""
    hist = [[sum(v // 16 == k for v in f) / len(f) for k in range(16)] for f in frames]
    change = [0.0] + [round(sum(abs(a - b) for a, b in zip(p, q, strict=True)) / 2, 6) for p, q in zip(hist, hist[1:], strict=False)]
    cuts = [0]
    for i in range(1, len(frames)):
        near = [change[k] for k in range(max(1, i - 8), min(len(frames), i + 9)) if k != i]
        mean = sum(near) / max(1, len(near))
        spread = max(0.0, sum(c * c for c in near) / max(1, len(near)) - mean * mean) ** 0.5
        if change[i] > round(max(mean + 2.5 * spread, 0.1), 9):
            cuts.append(i)
    return cuts


def test_clips_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: r.feature for r in avimedia.op4_avi_mjpeg(spark, sf).collect()}
    for doc_id, text, *_ in [d for d in docs if len(d[1]) < 6000][:60]:
        p = avimedia.payload_of(text)
        cuts = brute_shots([p[k : k + 576] for k in range(0, len(p), 576)])
        want = [f"{round(a * 0.04, 6)}-{round(b * 0.04, 6)}" for a, b in zip(cuts, [*cuts[1:], len(p) // 576], strict=True)]
        assert got[doc_id] == ",".join(want)


def baseline_jpeg(planes, factors, with_tables=True, restart=0):
    """A small baseline encoder: planes of float samples, their sampling factors, quantisers of 1."""
    codes = {k: {s: (c, n) for s, c, n in avimedia._canonical(bytes.fromhex(a), bytes.fromhex(b))} for k, (a, b) in avimedia.STANDARD_TABLES.items()}
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    high, wide = planes[0].shape
    n = len(planes)
    head = b"\xff\xd8" + segment(0xE0, b"AVI1\0") + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(0xC0, struct.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    if with_tables:
        head += b"".join(segment(0xC4, bytes([k]) + bytes.fromhex(a + b)) for k, (a, b) in avimedia.STANDARD_TABLES.items())
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(n)) + b"\0\x3f\0")
    bits, out, before = [], b"", [0] * n

    def put(value, size):
        bits.append(f"{value:0{size}b}" if size else "")

    def flush():
        joined = "".join(bits)
        joined += "1" * (-len(joined) % 8)
        bits.clear()
        return bytes(int(joined[k : k + 8], 2) for k in range(0, len(joined), 8)).replace(b"\xff", b"\xff\0")

    def amount(v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    mh, mv = max(h for h, _ in factors), max(v for _, v in factors)
    across, down, unit = -(-wide // (8 * mh)), -(-high // (8 * mv)), 0
    padded = []
    for p, (h, v) in zip(planes, factors, strict=True):
        small = p[:: mv // v, :: mh // h]
        padded.append(np.pad(small, ((0, down * 8 * v - small.shape[0]), (0, across * 8 * h - small.shape[1])), "edge"))
    for my in range(down):
        for mx in range(across):
            if restart and unit and unit % restart == 0:
                out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                before = [0] * n
            unit += 1
            for i, (h, v) in enumerate(factors):
                for by in range(v):
                    for bx in range(h):
                        y, x = (my * v + by) * 8, (mx * h + bx) * 8
                        c = np.rint(avimedia._COSINES @ (padded[i][y : y + 8, x : x + 8] - 128) @ avimedia._COSINES.T).astype(int).ravel()[avimedia.ZIGZAG].tolist()
                        dc, ac = codes[0x01 if i else 0x00], codes[0x11 if i else 0x10]
                        size, value = amount(c[0] - before[i])
                        before[i] = c[0]
                        put(*dc[size])
                        put(value, size)
                        run = 0
                        for z in range(1, 64):
                            if not c[z]:
                                run += 1
                                continue
                            while run > 15:
                                put(*ac[0xF0])
                                run -= 16
                            size, value = amount(c[z])
                            put(*ac[run << 4 | size])
                            put(value, size)
                            run = 0
                        if run:
                            put(*ac[0])
    return head + out + flush() + b"\xff\xd9"


def test_baseline_frames(spark):
    assert avimedia.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and avimedia.ZIGZAG[-3:].tolist() == [55, 62, 63]
    y, x = np.mgrid[0:37, 0:53]
    luma, blue, red = 128 + 90 * np.sin(x / 9) * np.cos(y / 7), 100 + x * 1.0, 200 - y * 2.0
    for planes, factors, tables, restart in (([luma], [(1, 1)], True, 0), ([luma, blue, red], [(2, 2), (1, 1), (1, 1)], False, 2), ([luma, blue, red], [(2, 1), (1, 1), (1, 1)], True, 0), ([luma, blue, red], [(1, 1)] * 3, False, 1)):
        got = avimedia.decode_baseline(baseline_jpeg(planes, factors, tables, restart))
        assert got.shape == (37, 53, len(planes)) and np.abs(got[:, :, 0] - luma).max() <= 2
        if len(planes) == 3:
            assert np.abs(got[:, :, 1] - blue).max() <= 3 and np.abs(got[:, :, 2] - red).max() <= 5
    dark, light = baseline_jpeg([luma * 0 + 20], [(1, 1)]), baseline_jpeg([luma, blue, red], [(2, 2), (1, 1), (1, 1)], False)
    video = bytearray(avimedia.write_avi([dark] * 10 + [light] * 6))
    got = avimedia.clip_rows(spark.createDataFrame([(1, bytes(video)), (2, None)], "doc_id int, media binary")).collect()
    assert [(r.doc_id, r.clip, r.first_frame, r.last_frame, r.start_s, r.end_s) for r in got] == [(1, 0, 0, 9, 0.0, 0.4), (1, 1, 10, 15, 0.4, 0.64)]
    progressive = dark.replace(b"\xff\xc0", b"\xff\xc2")
    for broken in (progressive, light[:-40], dark[:30]):
        with pytest.raises(ValueError):
            avimedia.decode_baseline(broken)


# 5: byte-level BPE

@pytest.fixture(scope="module")
def bpe_rule():
    """The codec, and the tiktoken library as the rule that it must follow."""
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.codec(path, P.PATTERN), tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_equals_tiktoken(spark, sf, docs, bpe_rule):
    c, rule, _ = bpe_rule
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op5_byte_bpe(spark, sf).collect()}
    for doc_id, text, *_ in docs:
        ids = rule.encode_ordinary(text)
        sizes = [len(c.bytes_of[i]) for i in ids]
        cut = {sum(len(x.encode()) for x in text[:k]) for k in range(len(text))} if len(text) < 2000 else None
        assert got[doc_id][:4] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), sum(sizes[:-1]) if ids else None)
        if cut is not None:
            assert got[doc_id][4] == sum(sum(sizes[:k]) not in cut for k in range(len(ids)))


def test_bpe_merges_as_ranks_do(bpe_rule):
    c, rule, ranks = bpe_rule
    same = lambda text: np.frombuffer(c.encode(text), "<i4").tolist() == rule.encode_ordinary(text)
    text = lambda b: b.decode("utf-8", "ignore")
    overlapping, repeated = [], set()
    for t in ranks:
        for k in range(1, len(t)):
            if t[:k] == t[-k:] and t[:-k] in ranks and t[:k] in ranks and t[k:] in ranks:
                overlapping.append(t[:-k] + t)
                if t[:-k] + t == t + t[:-k]:
                    repeated.add(next(t[:i] for i in range(1, len(t) + 1) if t[:i] * (len(t) // i) == t and len(t) % i == 0))
    assert len(overlapping) > 50 and all(same(text(x)) and same("x" + text(x) + "y") for x in overlapping)
    for w in repeated:
        for n in range(1, 200):
            assert same(text(w * n)) and same("ab" + text(w * n)) and same(text(w * n) + "ab"), (w, n)
    rng, letters = np.random.default_rng(5), ["a", "e", "s", "an", "ss", "--", " ", "é", "ж", "日", "=", "..", "ing", "1"]
    for _ in range(3000):
        assert same("".join(letters[i] for i in rng.integers(0, len(letters), 24)))


def test_bpe_of_awkward_rows(awkward, empty, bpe_rule):
    import public_tokenizers as P

    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    got = bpe.decode(bpe.encode_with_offsets(awkward, *args), *args).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in ROWS)
    c, rule, _ = bpe_rule
    for r in got:
        assert r.starts == np.cumsum([0] + [len(c.bytes_of[i]) for i in r.ids])[:-1].tolist()
    assert "".join(c.decode_parts(rule.encode_ordinary("日本語 𝔸 é"))) == "日本語 𝔸 é"
    for match in (" naïveté", "日本語", "𝔸", " hello", "=====", "\u2003"):
        ids = np.frombuffer(c.encode(match), "<i4")
        assert [a for a, _ in c.library_offsets(match)] == c.starts(ids).tolist()
    assert rows(bpe.encode(empty, *args)) == [] and rows(bpe.encode_with_offsets(empty, *args)) == []


# 6: packing

def brute_pack(docs, capacity):
    """Always scans all bins for the tightest one that fits and has no conflict, the oldest of several."""
    bins, out = [], []
    for doc_id, need, source, cluster in docs:
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= need and b["left"] and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        out.append((doc_id, i, capacity - bins[i]["left"]))
        bins[i]["left"] -= need
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_packing_is_best_fit():
    rng = np.random.default_rng(3)
    docs = sorted(((int(i), int(n), str(s) if s else None, int(c) or None) for i, n, s, c in zip(range(600), rng.integers(1, 100, 600), rng.integers(0, 5, 600), rng.integers(0, 90, 600), strict=True)), key=lambda d: -d[1])
    b = bestfit.Bins(0)
    assert [(d[0], *b.place(d[1], 128, d[2], d[3])) for d in docs] == brute_pack(docs, 128)


def test_packing_keeps_everything_apart(spark, sf, docs):
    packed = bestfit.op6_best_fit_packing(spark, sf).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d[0]: len(d[1].split()) + 1 for d in docs}
    info, seen = {d[0]: d for d in docs}, {}
    for r in sorted(packed, key=lambda r: (r.bin, r.start)):
        used, sources, texts = seen.setdefault(r.bin, [0, set(), set()])
        assert r.start == used and used + r.n_tokens <= bestfit.CAPACITY and info[r.doc_id][3] not in sources and info[r.doc_id][1] not in texts
        seen[r.bin][0] += r.n_tokens
        sources.add(info[r.doc_id][3])
        texts.add(info[r.doc_id][1])


def test_packing_of_awkward_rows(awkward, empty):
    got = bestfit.pack_documents(awkward).collect()
    assert sum(r.n_tokens for r in got) == sum(len((r[1] or "").split()) + 1 for r in ROWS)
    small = bestfit.pack(awkward, F.lit(3), group=4).collect()
    assert len(small) == len(ROWS)
    alike = awkward.limit(1).select("doc_id").crossJoin(awkward.sparkSession.range(500))
    assert bestfit.pack(alike, F.lit(100), group=50).groupBy((F.col("bin") / bestfit.BINS).cast("int")).count().count() == 10
    assert rows(bestfit.pack_documents(empty)) == []


# 7: quality

def test_quality_accuracy(spark, sf):
    spark_sf = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{spark_sf}/labels.parquet'").fetchall())
    got = [r for r in subword.op7_subword_quality(spark, spark_sf).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in got) / len(got) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (None, 1), (2, 0), (77, 1), (5, None)], "doc_id bigint, quality int")
    got = rows(subword.score_quality(awkward, awkward, labels).select("doc_id", "text", "quality_score"))
    assert len(got) == len(ROWS) and all(0 <= s <= 1 for *_, s in got)
    assert len({s for _, t, s in got if not (t or "").strip()}) == 1
    assert {r[0] for r in rows(subword.score_quality(awkward, empty, labels).select("quality_score"))} == {0.5}
    assert rows(subword.score_quality(empty, awkward, labels)) == []
    assert subword.keep_good(awkward, labels.limit(0)).columns == awkward.columns


def test_subword_features_of_a_batch_are_those_of_its_texts():
    texts = [b"One two two", b"", b"  three  ", "été à".encode(), b"x"]
    alone = [sorted(np.concatenate([f for f, _ in subword.features(t)] or [np.zeros(0, np.uint32)]).tolist()) for t in texts]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    together = [[] for _ in texts]
    for f, at in subword.features(b"\n".join(texts), first):
        for x, i in zip(f.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
            together[i].append(x)
    assert [sorted(x) for x in together] == alone


def test_pieces_of_a_text_have_its_features(monkeypatch):
    texts = ["one two two three  four\n\n five six " * 3, "x" * 50 + " y " + "z" * 30, "   a   b   c      d", "é" * 40, "", "a b " + "  " * 20 + "c"]
    want = [[x.tolist() for x in subword.text_features(t)] for t in texts]
    for size in (1, 3, 7, 16):
        monkeypatch.setattr(subword, "PIECE", size)
        assert [[x.tolist() for x in subword.text_features(t)] for t in texts] == want


@pytest.mark.parametrize("piece", [1 << 20, 9])
def test_scores_are_means_of_weights_and_do_not_depend_on_the_batch(spark, monkeypatch, piece):
    import pandas as pd

    weights = np.random.default_rng(2).normal(0, 1, subword.BUCKETS)
    texts = ["One two two", "", "  three  ", "été à", "x", "three", "x", "a longer text of several words and pieces", None]
    want = []
    for t in texts:  # brute force: the mean weight of all features
        f, n = subword.text_features(t)
        want.append(1 / (1 + np.exp(-(weights[f] @ n / max(1, n.sum()) + 0.25))))
    monkeypatch.setattr(subword, "PIECE", piece)
    score = subword.score_udf(weights, 0.25).func
    together = score(pd.Series(texts)).tolist()
    assert np.allclose(together, want, rtol=0, atol=1e-12)
    assert together == [score(pd.Series([t]))[0] for t in texts] and together[::-1] == score(pd.Series(texts[::-1])).tolist()


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    one = {tuple(r) for r in subword.score_quality(docs, docs, labels).select("doc_id", "quality_score").collect()}
    other = {tuple(r) for r in subword.score_quality(docs.repartition(7, "text"), docs, labels).select("doc_id", "quality_score").collect()}
    assert one == other


# 8: fingerprints

def brute_fingerprint(text, bins=oph.BINS, width=oph.SHINGLE):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda values, seed: seed if not values else chain(values[1:], xxhash.xxh64_intdigest(struct.pack("<q", signed(values[0])), seed))
    words = [w for w in __import__("re").split(oph.SPACE, text) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not h:
        return ""
    if len(h) < width:
        acc = 0
        for x in h:
            acc = chain([acc, x], 42)
        hashes = [acc]
    else:
        hashes = [chain(h[i : i + width], 42) for i in range(len(h) - width + 1)]
    low = {}
    for x in hashes:
        b = x >> (64 - bins.bit_length() + 1)
        low[b] = min(low.get(b, x), x)
    starts, steps = oph._walks(bins, oph.SEED)
    out = []
    for b in range(bins):
        k = next(j for j in [b] * (b in low) + [(starts[b] + a * steps[b]) % bins for a in range(bins)] if j in low)
        out.append(f"{low[k] & 255:02x}")
    return "".join(out)


def test_fingerprints_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in oph.op8_oph_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, (doc_id, text, *_) in enumerate(docs):
        follower = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if i % 8 == 0:
            assert r.fingerprint == brute_fingerprint(text) and r.edited_fingerprint == brute_fingerprint(edited)
            agree = sum(r.fingerprint[k : k + 2] == r.edited_fingerprint[k : k + 2] for k in range(0, 256, 2)) / 128
            assert r.near_edited == pytest.approx(1.0 if agree == 1 else max(0, (agree - 1 / 256) / (1 - 1 / 256)))


def test_likeness_estimates_jaccard(spark):
    words = [f"w{i}" for i in range(2000)]
    pairs = [(" ".join(words[:1500]), " ".join(words[k : 1500 + k])) for k in (0, 100, 300, 700)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for (a, b), (got,) in zip(pairs, rows(df.select(oph.likeness(oph.fingerprint(F.col("a")), oph.fingerprint(F.col("b"))))), strict=True):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(1496)} for t in (a, b))
        assert abs(got - len(x & y) / len(x | y)) < 0.15


def test_fingerprints_of_awkward_rows(awkward, empty):
    got = rows(awkward.select("text", oph.fingerprint(F.col("text")).alias("f")))
    for text, f in got:
        assert f == brute_fingerprint(text or "")
    pairs = oph.with_next(awkward.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", ["text"]).collect()
    assert len(pairs) == len(ROWS) and sorted(r.next_text for r in pairs) == sorted(r[1] or "" for r in ROWS)
    assert rows(oph.with_next(empty.select("doc_id", "text"), "doc_id", ["text"])) == []


@pytest.mark.parametrize("at_once", [4096, 7])
def test_every_row_gets_the_next(spark, at_once):
    values = [(i * 3 if i % 11 else 30, f"t{i}") for i in range(700)] + [(None, "n1"), (None, "n2")]
    got = oph.with_next(spark.createDataFrame(values, "k bigint, v string").repartition(6), "k", ["v"], range_bytes=40, at_once=at_once).collect()
    assert len(got) == len(values) and sorted(r.next_v for r in got) == sorted(v for _, v in values)
    key = lambda k: -1 if k is None else k
    of = {v: key(k) for k, v in values}
    order = sorted(of.values())
    assert sorted((key(r.k), of[r.next_v]) for r in got) == sorted(zip(order, [*order[1:], order[0]], strict=True))


# 9: URL filters

URLS = ["http://A.NET/x", "https://www.example.net/en/1?x#y", "http://example.net/en", "http://example.com/de/", "http://b.example.com/DE/", "http://x.org/fr/a", "http://org/fr/", "http://notorg/fr/", "http://example.net?en/", "http://example.net", "nothing", "", None, "a://b://c", "http://éx.net/", "http://x..net/a"]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_url_rules(spark, broadcast_rows):
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS)] + [(None, URLS[0], "x"), (0, URLS[0], "x")], "page_id int, url string, host string")
    got = urls.match_urls(df, urls.rule_table(spark), broadcast_rows=broadcast_rows).collect()
    assert len(got) == len(URLS) + 2
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    block, none = ("net/", "block"), (None, "allow")
    want = [block, ("example.net/en/", "allow"), block, ("example.com/de/", "block"), none, ("org/fr/", "allow"), ("org/fr/", "allow"), none, none, none, none, none, none, none, block, block]
    assert [by[i] for i in range(len(URLS))] == want
    assert {r.host for r in got if r.page_id == 0} == {"a.net"} and by[None] == block


def test_url_rule_precedence(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy/z"), (2, "http://b.c/x"), (3, "http://c")], "page_id int, url string")
    rules = spark.createDataFrame([("c", "", "allow"), ("b.c", "/x", "block"), ("b.c", "/x", "allow"), ("a.b.c", "/xy/", "allow"), (None, "/", "block"), ("c", "x", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.match_urls(pages, rules).collect()}
    assert got == {1: ("a.b.c/xy/", "allow"), 2: ("b.c/x", "block"), 3: ("c", "allow")}
    assert {r.verdict for r in urls.match_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert rows(urls.match_urls(pages.limit(0), rules)) == []


def test_url_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(repr, rows(urls.op9_url_filter(spark, sf)))) == sorted(map(repr, c.execute(urls.OP9_SQL).fetchall()))


# 10: near duplicates

def brute_components(prints, budget=3):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def brute_simhash(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash._LOWER))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_components_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash_near_dedup(spark, sf).collect()}
    prints = [brute_simhash(d[1]) for d in docs]
    roots = brute_components(prints)
    assert got == {d[0]: (f"{p:016x}", docs[r][0]) for d, p, r in zip(docs, prints, roots, strict=True)}


@pytest.mark.parametrize(("chunk", "picked"), [(8192, 1), (40, 1), (8192, 2), (40, 2)])
def test_trie_join_loses_no_link(spark, chunk, picked):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 6)
    prints = {int(c) for c in centres}
    for _ in range(400):  # crowded balls, so that block values are shared by many
        x = int(centres[rng.integers(6)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x, 0, x) for x in signed], "node bigint, kind int, fp bigint")
    roots = {r.node: r.root for r in components.connected(simhash.hamming_links(df, chunk=chunk, picked=picked)).collect()}
    want = brute_components(signed)
    groups = {}
    for x, r in zip(signed, want, strict=True):
        groups.setdefault(r, []).append(x)
    for members in groups.values():
        assert len({roots.get(x, x) for x in members}) == 1
    assert len({roots.get(x, x) for x in signed}) == len(groups)


def test_equal_fingerprints_of_any_kind_never_meet_in_a_task(spark, monkeypatch):
    dealt = spark.sparkContext.accumulator(0)
    linked = simhash._link_partition

    def counted(*args):
        run = linked(*args)

        def count(batches):
            kept = list(batches)
            dealt.add(sum(b.num_rows for b in kept))
            yield from run(iter(kept))

        return count

    monkeypatch.setattr(simhash, "_link_partition", counted)
    df = spark.range(60).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("kind"), F.lit(5).cast("long").alias("fp")).union(spark.createDataFrame([(900, 1, 4), (901, 1, -1)], "node bigint, kind bigint, fp bigint"))
    roots = {r.node: r.root for r in components.connected(simhash.hamming_links(df, chunk=40)).collect()}
    assert len({roots[i] for i in [*range(60), 900]}) == 1 and 901 not in roots
    assert dealt.value == 3 * 4  # distinct fingerprints by blocks


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 7), (200, 201), (201, 200), (None, 3)] + [(300, i) for i in range(301, 400)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components.connected(df).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[200] == roots[201] != roots[0] and 100 not in roots
    assert len({roots[i] for i in range(300, 400)}) == 1 and len(set(roots.values())) == 3


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = simhash.near_components(awkward).collect()
    assert len(got) == len(ROWS)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in got if r.doc_id == 1} == {1} and sum(r.component_id == 1 for r in got) == 3
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8, 9]
    assert rows(simhash.near_components(empty)) == [] and rows(simhash.one_of_each(empty)) == []


def test_rare_prefixes_lose_no_pair():
    """Of every two sets that are alike the larger one's prefix and the smaller one's short prefix share a shingle, behind which both have enough left."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)])) for n in rng.integers(1, 300, 150)] + [np.unique(base[:n]) for n in range(1, 40)]
    frequency = np.bincount(shingles._cells(np.concatenate(sets)), minlength=shingles.CELLS)
    pairs = 0
    for x in sets:
        for y in sets:
            if x is not y and len(x) >= len(y) and shingles.alike(x, y):
                (px, _), (py, low) = shingles.rare_prefix(x, frequency), shingles.rare_prefix(y, frequency)
                common = [(i, int(np.flatnonzero(py[:low] == v)[0])) for i, v in enumerate(px) if v in py[:low]]
                assert any(min(len(x) - i, len(y) - j) * 9 >= 4 * (len(x) + len(y)) for i, j in common)
                pairs += 1
    assert pairs > 100


def test_template_families_do_not_meet_pairwise(spark):
    """Pages of one template whose own parts make them unlike: no candidates are left after the hubs, whatever their number."""
    rng = np.random.default_rng(5)
    template = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    rows = [(i, i, np.unique(np.concatenate([template, rng.integers(0, 1 << 62, 90).astype(np.uint64)])).tobytes()) for i in range(400)]
    rest = spark.createDataFrame(rows, "node bigint, label bigint, s binary")
    assert shingles._rare_pairs(rest, shingles.frequencies(rest)).count() == 0


@pytest.mark.parametrize("hubs", [4, 1, 0])
def test_near_duplicates_are_those_of_exact_jaccard(spark, monkeypatch, hubs):
    whole = shingles.near_classes
    monkeypatch.setattr(shingles, "near_classes", lambda docs, **names: whole(docs, hubs=hubs, **names))
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    texts, common = [], [f"c{i}" for i in range(60)]
    for _ in range(30):
        base = words(200)
        texts += [base, base + words(24), base + words(80), base[30:]]  # similar at about 0.89, 0.71 and 0.85
    texts += [[common[i] for i in rng.permutation(60)] for _ in range(30)]  # equal word sets, no common shingle
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(set(up))


@pytest.mark.parametrize("labels", [1500, 100_000])
def test_samples_of_many_labels(spark, labels):
    """The most frequent labels are classes, however many there are; long texts are drawn less often."""
    df = spark.range(labels + 3000).select((F.when(F.col("id") < 3000, F.col("id") % 3).otherwise(F.col("id"))).cast("string").alias("lang"), F.col("id"))
    sample, bound = learning.class_sample(df, "lang", ["id"], per_class=200, classes=3)
    got = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert set(got) == {"0", "1", "2"} and all(150 < n < 250 for n in got.values()) and bound == 750
    every, _ = learning.class_sample(df, "lang", ["id"], per_class=200)
    assert every.select("lang").distinct().count() == learning.CLASSES
    long = df.select("id", F.repeat(F.lit("a"), 40).alias("text"))
    assert 0.4 < long.where(learning.seldom(F.col("id"), F.col("text"), 20)).count() / long.count() < 0.6 and long.where(learning.seldom(F.col("id"), F.col("text"), 40)).count() == long.count()


# pipeline

def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "packing"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = start, {r[0] for r in start.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{shared_dir(spark)}/pipeline-test-{i}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == start.columns
        after = {r[0] for r in docs.select("doc_id").collect()}
        assert after and after <= before
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == before


def test_pipeline_stages_on_awkward_rows(spark, sf, awkward, empty):
    for name, stage in corpus_pipeline.STAGES:
        for df in (awkward, empty):
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == df.columns
            assert out.count() <= len(ROWS) * 200
