"""Lossless WebP round trips, WARC archives and mixing."""

import hashlib
import io
import itertools
import math
import zlib

import numpy as np
import pytest
from oracle import duck_rows, spark_rows

from spindrift.llm import media, mixing, registry, warc, webp


def images():
    rng = np.random.default_rng(1)
    few = np.zeros((12, 17, 4), np.uint8)
    few[...] = rng.integers(0, 3, (12, 17, 1))
    few[..., 3] = 255
    letters = rng.integers(97, 110, (20, 64, 4), dtype=np.uint8)
    letters[..., 3] = 255
    yield "noise", rng.integers(0, 256, (9, 13, 4), dtype=np.uint8)
    yield "few", few
    yield "letters", letters
    yield "dot", np.full((1, 1, 4), 7, np.uint8)
    yield "tiled", np.tile(rng.integers(0, 256, (1, 5, 4), dtype=np.uint8), (40, 4, 1))


@pytest.mark.parametrize(("name", "pixels"), list(images()))
def test_webp_with_every_feature(name, pixels):
    kinds = [(), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR, webp.CROSS_COLOUR), (webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PREDICTOR)]
    if len(np.unique(pixels.reshape(-1, 4), axis=0)) <= 256:
        kinds += [(webp.PALETTE,), (webp.PALETTE, webp.PREDICTOR)]
    for kind, cache, references, groups in itertools.product(kinds, (0, 1, 5), (False, True), (False, True)):
        o = webp.Options(transforms=kind, cache_bits=cache, references=references, entropy=True, groups=groups)
        assert (webp.decode(webp.encode(pixels, o)) == pixels).all(), o
    for kind in kinds:
        assert (webp.decode(webp.encode(pixels, webp.Options(transforms=kind))) == pixels).all()
    for mode in range(14):
        assert (webp.decode(webp.encode(pixels, webp.Options(transforms=(webp.PREDICTOR,), predictor_mode=mode))) == pixels).all()


def test_features_by_content():
    rng = np.random.default_rng(2)
    grey = np.repeat(rng.integers(0, 256, (40, 64, 1), dtype=np.uint8), 4, axis=2)
    grey[..., 3] = 255
    few = rng.integers(0, 256, (4, 4), dtype=np.uint8)[rng.integers(0, 4, (40, 64))]
    words = np.array([f"{w} " for w in ("some words come again and others only once in a while here there now then".split())])
    prose = "".join(rng.choice(words, 3000))
    text = media.to_pixels(prose.encode()[:11520])
    flat = media.to_pixels(rng.integers(0, 256, 1920, dtype=np.uint8).tobytes())
    slope = np.full((40, 64, 4), 255, np.uint8)
    slope[..., :3] = (np.arange(40)[:, None] * 3 + np.arange(64) * 2)[..., None] + rng.integers(0, 2, (40, 64, 3))
    for p in (grey, few, text, flat, slope, *(p for _, p in images())):
        assert (webp.decode(webp.encode_small(p)) == p).all()
        assert webp.encode_small(p) == webp.encode(p, webp.best(p))
    assert webp.best(grey).transforms in ((webp.SUBTRACT_GREEN,), (webp.CROSS_COLOUR,)) and webp.best(few).transforms == (webp.PALETTE,)
    o = webp.best(text)
    assert o.references and (o.entropy or o.common) and webp.best(flat) == webp.Options()


def test_stored_texts_are_compressed(spark):
    prose = ["".join(f"the {k * j % 97} of them went on to the {k + j} houses by the sea, and there it was. " for j in range(60)) for k in range(20)]
    r = media.media_digest(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")).selectExpr("sum(media_bytes) / sum(payload_bytes)").first()[0]
    assert r < 0.6


@pytest.mark.parametrize("cache_bits", [0, 3])
def test_references_and_cache_over_many_segments(monkeypatch, cache_bits):
    monkeypatch.setattr(webp, "SEGMENT_BYTES", 64)
    rng = np.random.default_rng(3)
    p = rng.integers(0, 4, (60, 64, 4), dtype=np.uint8)
    p[20:40] = p[:20]
    p[50:, :, :] = 7
    o = webp.Options(entropy=True, references=True, cache_bits=cache_bits)
    data = webp.encode(p, o)
    assert (webp.decode(data) == p).all()
    with pytest.raises(ValueError):
        webp.decode(data[:16] + (len(data) // 2).to_bytes(4, "little") + data[20 : 20 + len(data) // 2])


def test_images_read_together(monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array([f"{w} " for w in ("Some words come again & others ONLY once in a while; ~{here}~ there\n now then é".split())])
    texts = ["".join(rng.choice(words, int(n))).encode() for n in rng.integers(1, 900, 160)] + [b"", b"y" * 9000, bytes(rng.integers(0, 256, 5000, np.uint8)), bytes(192)]
    pixels = [media.to_pixels(t + b" " * (-len(t) % 192 if t else 192)) for t in texts]
    files = [webp.encode_small(p) for p in pixels]
    files += [webp.encode(p, webp.Options(common=True, cache_bits=c, references=r)) for p in pixels[:60] for c, r in ((0, False), (3, True))]
    pixels += [p for p in pixels[:60] for _ in range(2)]
    together = []
    monkeypatch.setattr(webp, "_read_together", lambda *a, f=webp._read_together: together.append(len(a[0])) or f(*a))
    got = list(webp.decode_many(files))
    assert len(got) == len(files) and all((a == b).all() for a, b in zip(got, pixels)) and sum(together) > 200
    monkeypatch.setattr(webp, "TOGETHER_PIXELS", 5000)
    assert all((a == b).all() for a, b in zip(webp.decode_many(files), pixels))
    monkeypatch.undo()
    k = next(k for k, f in enumerate(files) if len(f) > 500)
    files[k] = files[k][:16] + (300).to_bytes(4, "little") + files[k][20:320]
    with pytest.raises(ValueError):
        list(webp.decode_many(files))


@pytest.mark.parametrize("broken", [b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0"])
def test_webp_that_is_none(broken):
    with pytest.raises((ValueError, IndexError)):
        webp.decode(broken)


def test_webp_cut_off():
    data = webp.encode(next(iter(images()))[1])
    with pytest.raises(ValueError):
        webp.decode(data[:16] + (20).to_bytes(4, "little") + data[20:60])


def test_media_digest(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "same", "same", "y" * 400_000]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "no id", "c")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.media_digest(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[5][1:] == got[6][1:]
    assert media.media_digest(df.where("false")).count() == 0


def test_very_tall_payload():
    payload = bytes(range(192)) * 40_000
    assert media.to_pixels(payload)[..., :3].tobytes() == payload


@pytest.mark.parametrize("rows", [16411, 16417, 16421, 65521, 4_194_301])
def test_payload_of_rows_that_no_width_divides(rows):
    payload = bytes(range(192)) * rows
    pixels = media.to_pixels(payload)
    assert max(pixels.shape[:2]) <= 16384 and media.to_payload(pixels) == payload


def test_text_of_rows_that_no_width_divides(spark):
    text = "0123456789abcdef" * 12 * 16411
    r = media.media_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(text), hashlib.sha256(text.encode()).hexdigest())
    r = media.decode_media(media.encode_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert bytes(r.pixels) == text.encode()


PAGES = [(1, "http://a/\r\nX: y", "p" * 100), (2, None, "p" * 100), (3, "u", "p" * 99), (4, "u", "p" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "q" * 300_000)]


def test_warc(spark):
    got = {r.page_id: r for r in warc.warc_digest(spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")).collect()}
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {2: ("revisit", 1), 8: ("revisit", 7)}


def test_warc_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "u", "p" * 200), (1, "u", "p" * 200), (None, "u", "p" * 200), (None, "u", "only" * 50)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.warc_digest(df).collect())
    assert got == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert warc.warc_digest(df.where("false")).count() == 0


def test_normaliser_makes_a_member_of_every_record():
    rows = [warc.record(k, f"http://{k}", "d", 5 * k, b"x" * (5 * k), None, "2020-01-01T00:00:00Z") for k in range(50)]
    for whole in (b"".join(rows), b""):
        raw = zlib.compressobj(9, zlib.DEFLATED, 31)
        out, index = io.BytesIO(), io.BytesIO()
        n = warc.normalise(io.BytesIO(raw.compress(whole) + raw.flush()), out, index)
        assert n == (50 if whole else 0)
        again = b"".join(zlib.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) for e in map(__import__("json").loads, index.getvalue().splitlines()))
        assert again == whole
    many = io.BytesIO(out.getvalue())
    assert warc.normalise(many, io.BytesIO(), io.BytesIO()) == 0


def test_cut_off_archive_is_an_error():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(warc.record(1, "u", "d", 3, b"abc", None, "x")[:-3]) + z.flush()
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(data), io.BytesIO(), io.BytesIO())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duck_rows(registry.ORACLE_SQL[name], sf)


def test_mixing_reaches_the_weights(spark):
    rows = [(k, "t" * 10, "a" if k % 10 else "b", "x") for k in range(4000)] + [(4000, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    got = mixing.mix_sources(df, {"a": 1.0, "b": 3.0, "unknown": 5.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) == {"a", "b"}
    assert n["a"] == pytest.approx(1000, abs=5 * math.sqrt(1000)) and n["b"] == pytest.approx(3000, abs=5 * math.sqrt(3000))
    assert mixing.mix_sources(df.where("false")).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.1, 1.0, 7.5, 300.0])
def test_poisson_distribution(spark, rate):
    steps = mixing.distribution(spark.createDataFrame([("s", rate)], "source string, rate double")).first()["steps"]
    total, expect = 0.0, []
    for k in range(len(steps)):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        expect.append(total)
    assert steps == pytest.approx(expect, abs=1e-9) and steps[-1] == pytest.approx(1.0)


def test_poisson_of_a_large_mean():
    rate = 1_500_000.0
    first, steps = mixing.poisson(rate)
    assert len(steps) < 40_000
    p = np.diff(steps, prepend=0.0)
    k = first + np.arange(len(steps))
    assert p.sum() == pytest.approx(1.0)
    assert (p * k).sum() == pytest.approx(rate, rel=1e-9) and (p * (k - rate) ** 2).sum() == pytest.approx(rate, rel=1e-6)
    assert p[int(rate) - first] == pytest.approx(math.exp(rate * math.log(rate) - rate - math.lgamma(rate + 1)), rel=1e-6)


def test_mixing_a_tiny_source_beside_a_large_one(spark):
    df = spark.createDataFrame([(1, "t" * 2_000_000, "large"), (2, "t" * 5, "tiny"), (3, "t" * 5, "tiny")], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).drop("text").groupBy("doc_id").agg({"copy": "max", "*": "count"}).collect()
    n = {r["doc_id"]: r["count(1)"] for r in got}
    first, steps = mixing.poisson(2_000_010 / (2 * 10))
    for k in (2, 3):
        u = int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:13], 16) / 2**52
        assert n[k] == first + int((steps <= u).sum())
    assert all(r["max(copy)"] == r["count(1)"] - 1 for r in got)


def test_mixing_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(k, f"text {k} é\n" * (k % 7 + 1), f"s{k % 3}") for k in range(200)]
    rows += [(None, "no id", "s1"), (300, None, "s1"), (301, "no source", None), (302, "", "s0"), (5, rows[5][1], "s2"), (5, "another text", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op3_mixing(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.MIX_SQL)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
