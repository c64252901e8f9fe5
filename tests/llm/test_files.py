"""Exact round trips: BPE, token files, WARC bundles, chat formatting."""

import hashlib
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from atalaia.llm import bpe, chat, common, tokenfiles, warc

ODD = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "🙂", "0", "12", "'s", "<|endoftext|>", "\x85", "\xa0", "²", "Ⅷ", "_", "!!", "ing", "\r\n", "١", "\x00"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(n)] + ["a" * 5000, " " * 300, ""]


def test_bpe_equals_the_library(spark):
    texts, lib = odd_texts(2000), common.library_tokenizer(None)
    own = bpe.Bpe()
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t).tolist() == e.ids
        assert own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)
    rows = [(i, t, "x") for i, t in enumerate(texts[-30:])] + [(None, None, "y"), (3, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.decode(bpe.encode(df))).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert Counter(tuple(r) for r in bpe.digests(bpe.round_trip(df)).collect()) == want
    assert bpe.digests(bpe.decode(bpe.encode(df.limit(0)))).collect() == [] == bpe.digests(bpe.round_trip(df.limit(0))).collect()


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(r.integers(0, 2**64, n, np.uint64))
        h = tokenfiles.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_token_files(spark):
    texts = odd_texts(300, 2)
    rows = [(i * 7 % 1009 - 200, t, 1) for i, t in enumerate(texts)] + [(None, None, 2), (-200, texts[0], 3), (5_000_000_000, "far <|endoftext|> off", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    lib = common.library_tokenizer(None)
    shards = tokenfiles.write(df, common.new_folder(spark, "t"))
    got = sorted(tokenfiles.read(spark, shards).collect(), key=lambda r: r.start)
    at, want = 0, Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for i, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    opened = [tokenfiles.Shard(r.uri) for r in shards.collect()]
    found = [x for s in opened if (x := s.get(5_000_000_000)) is not None]
    assert [x.tolist() for x in found] == [[*lib.encode("far <|endoftext|> off", add_special_tokens=False).ids, 2]]
    assert all(s.get(99_999_999) is None for s in opened)
    assert tokenfiles.write_and_read(df.limit(0)).collect() == []


def test_warc(spark, tmp_path):
    big, r = "<p>é</p>" * 300, random.Random(2)
    rows = [(i, f"http://x/{i}", r.choice([big, big + "x", "small", "", None]), 0) for i in range(60)]
    rows += [(59, "http://x/\r\nagain", big, 0), (None, None, big, 0), (None, None, big * 2, 0), (None, "u", big * 2, 0), (70, "u", "y" * 999, 0), (71, "u", "y" * 999, 0), (72, "u", "z" * 1000, 0), (73, "u", "z" * 1000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.write_and_read(df).collect())
    want = Counter()
    for i, _, html, _ in rows:
        p = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        keeper = max(same) if same and len(p) >= 1000 else i
        want[i, len(p), hashlib.sha1(p).hexdigest(), "response" if i == keeper else "revisit", None if i == keeper else keeper] += 1
    assert got == want
    assert warc.write_and_read(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold, adaptive, slice_", (("10m", "true", 500), ("-1", "true", 2), ("-1", "false", 500), ("10m", "false", 2)))
def test_record_ids_are_unique_and_resolve(spark, monkeypatch, threshold, adaptive, slice_):
    """Rows of one page and payload under several urls, and equal rows, each have a record of their own, and revisits name one of them."""
    monkeypatch.setattr(warc, "SLICE", slice_)
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", threshold), ("spark.sql.adaptive.enabled", adaptive)):
        spark.conf.set(k, v)
    try:
        unique_and_resolving(spark)
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(k)


def unique_and_resolving(spark):
    page = "p" * 2000
    rows = [(5, f"http://u/{i % 4}", page) for i in range(12)] + [(i, "http://v", page) for i in range(5)] + [(None, None, page)] * 2
    bundles = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), common.new_folder(spark, "w"))
    seen, refers = [], set()
    for r in bundles.collect():
        store, path = fs.FileSystem.from_uri(r.uri)
        bundle = warc.Bundle(store.open_input_file(path))
        for rid, h, _ in bundle.all():
            assert bundle.get(rid) is not None and h["WARC-Record-ID"] == f"<urn:uuid:{uuid.UUID(bytes=rid)}>"
            seen.append((rid, h["WARC-Type"], h["X-Page-ID"]))
            refers |= {h["WARC-Refers-To"]} if "WARC-Refers-To" in h else set()
    assert len(seen) == len(rows) == len({x[0] for x in seen})
    assert [str(uuid.UUID(bytes=x[0])) for x in seen if f"<urn:uuid:{uuid.UUID(bytes=x[0])}>" in refers and x[1:] == ("response", "5")] == [x[10:-1] for x in refers]
    assert Counter((x.page_id, x.refers_to) for x in warc.read(bundles).collect()) == Counter((r[0], None if r[0] == 5 else 5) for r in rows)


def test_bundle_seeks(tmp_path):
    store = fs.LocalFileSystem()
    path = str(tmp_path / "b.warc.zst")
    w, kept = warc.BundleWriter(store.open_output_stream(path, compression=None), 2000), {}
    for i in range(200):
        p = bytes([i]) * (i * 13)
        d = hashlib.sha1(p).hexdigest()
        rid = warc.record_id(i, d)
        kept[rid] = warc.record(rid, i, f"http://h/{i}", p, d, None, "2020-01-01T00:00:00Z")
        w.add(rid, kept[rid])
    w.close()
    b = warc.Bundle(store.open_input_file(path))
    assert len(b.sizes) > 20 and all(b.get(k) == v for k, v in kept.items()) and b.get(b"0" * 16) is None
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == b"".join(kept.values())


def test_chat(spark):
    r = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "#", "< /turn>", "### User", "text", "\n", "é", " ", ""]
    nasty = ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(3000)]
    for t in nasty:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
    rows = [(i // 5, i % 5, r.choice(["user", "assistant", "system", "tool", "</role>", "", None]), t, 1) for i, t in enumerate(nasty[:200])]
    rows += [(3, None, "user", None, 1), (None, 1, "assistant", "x", 1), (4, 4, "assistant", "same", 1), (4, 4, "assistant", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    turns = chat.format_turns(df)
    got = {x.conv_id: x for x in chat.chat_digests(turns).collect()}
    assert len(got) == 41
    text = {}
    for x in sorted(turns.collect(), key=lambda x: (x.turn is not None, x.turn or 0, bytes(x.tie))):
        text.setdefault(x.conv_id, []).append(x.formatted)
    for conv, x in got.items():
        mine = [t for t in rows if t[0] == conv]
        seen = {f: t for t in mine for f in ["".join(s for s, _, _ in chat.segments(t[2] or "", t[3] or ""))]}
        order = [seen[f] for f in text[conv]]
        assert x.n_turns == len(mine) == len(order) and x.formatted_chars == len("".join(text[conv]))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in order).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in order if t[2] == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(chat.format_turns(df.limit(0))).collect() == []


def test_ranges_cut_hot_keys(spark):
    rows = [(i,) for i in range(-60, 60)] + [(7,)] * 300 + [(None,)] * 300 + [(-(2**63),), (2**63 - 1,)]
    df = spark.createDataFrame(rows, "k long").select("k", F.xxhash64(F.monotonically_increasing_id()).alias("tie")).cache()
    points = common.split_points(df, "k", 12)
    assert 8 <= len(points) <= 12
    got = df.withColumn("b", common.bucket_of("k", points)).collect()
    order = sorted(got, key=lambda x: (x.k is not None, x.k or 0, x.tie))
    assert [x.b for x in order] == sorted(x.b for x in got) and max(Counter(x.b for x in got).values()) < 150
    for x in got:
        assert x.b == sum(p <= (int(x.k is not None), x.k or 0, x.tie) for p in points)
    assert common.split_points(df.limit(0), "k", 12) == [] == common.split_points(df, "k", 1)


def test_words_that_leave_the_cache():
    lib, texts = common.library_tokenizer(None), odd_texts(1500, 3) + ["x" * 70 + " the. the.\nThe, \u00c7a.\nEt"] * 3
    for kind in (tokenfiles.Encoder(None, 20), bpe.Bpe(cached=20)):
        encode = kind.encode if isinstance(kind, tokenfiles.Encoder) else kind.encode_array
        for part in (texts[:700], texts[700:], texts[:700]):
            ids, counts = encode(pa.array([*part, None]))
            want = [e.ids for e in lib.encode_batch([*part, ""], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    cache = common.Cache(len, 3)
    assert cache["y" * 1000] == 1000 and cache["a"] == 1 and list(cache) == ["a"]
