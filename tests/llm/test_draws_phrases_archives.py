"""Resampling, phrase mining and archives against brute force and exact round trips."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cohortlens.llm import archives, phrases, resampling
from cohortlens.session import scratch_path

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def runs(words, longest):
    return [" ".join(words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, longest, buckets, percent, least, seed=2024):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    s, t = (Counter(bucket(r) for text in texts for r in runs(words10(text), longest)) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t_all * 0 + s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        found = runs(words10(text), longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in found)
        out.append([i, len(words10(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(r[0], r[4], n + 1) for n, r in enumerate(able[: percent * len(able) // 100])]
    return sorted(map(tuple, out), key=str), sorted(ranks, key=str)


def test_resample_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "gämma", "δ", "x1", "42", "one-two", "Ünder"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(120)] + [None, "", "!!!", "alpha " * 5000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 40 + [(None, "alpha beta alpha"), (None, None)]
    target = ["alpha alpha beta", None, "nothing seen"]
    for longest, percent, least in ((1, 10, 3), (3, 50, 0), (1, 100, 1), (1, 0, 1)):
        df = spark.createDataFrame([(i, t, "old", 1) for i, t in docs], "doc_id bigint, text string, rank string, weight int").repartition(5)
        got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=97, percent=percent, least_words=least)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        rows = [tuple(r) for r in got.collect()]
        all_rows, ranks = brute_resample(docs, target, longest, 97, percent, least)
        assert sorted((r[:5] for r in rows), key=str) == all_rows
        assert sorted(((r[0], r[4], r[5]) for r in rows if r[5]), key=str) == ranks


def test_resample_empty_tables_and_kept_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b", "u1"), (2, None, "u2")], "doc_id bigint, text string, url string")
    assert resampling.resample(none, some).count() == 0
    got = {r.doc_id: r for r in resampling.resample(some, none, percent=100, least_words=1, keep=["url", "rank"][:1]).collect()}
    assert got[1].url == "u1" and got[1].rank == 1 and got[2].rank is None and got[2].weight == 0


def test_selection_finds_every_rank(spark):
    rng = np.random.default_rng(1)
    keys = [(int(a), int(b)) for b, a in enumerate(rng.integers(0, 6, 137))]
    df = spark.createDataFrame(keys, "a bigint, b bigint").repartition(4)
    ordered = sorted(keys)
    for k in (1, 2, 17, 68, 136, 137):
        assert resampling.kth_key(df, ["a", "b"], k, seed=k) == ordered[k - 1]
    assert resampling.kth_key(df, ["a", "b"], 0) is None
    with pytest.raises(ValueError):
        resampling.kth_key(df, ["a", "b"], 138)


def brute_phrases(docs, longest, least, contained, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count[lang].update(tuple(w[i: i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, c in count.items():
        f = {p: n for p, n in c.items() if n >= least}
        inside = Counter()
        for p, n in f.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], n)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and 100 * inside[p] < contained * a:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, total[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, n + 1, *r) for n, r in enumerate(rows[:top])]
    return sorted(out)


def mined(docs, spark, **how):
    df = spark.createDataFrame([(t, la, 1) for t, la in docs], "text string, lang string, rank int").repartition(3)
    return sorted(tuple(r)[:8] for r in phrases.mine_phrases(df, **how).collect())


@pytest.mark.parametrize("shard", [40, 1 << 22])
def test_phrases_equal_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    weights = 1 / np.arange(1, 13)
    vocabulary = ["the", "of", "New", "york", "city", "a b", "ÉTÉ", "\x00", "x\x1cy", "don't", "-", "zz"]
    docs = []
    for i in range(150):
        words = rng.choice(vocabulary, rng.integers(0, 40), p=weights / weights.sum()).tolist()
        for j in rng.integers(0, len(words) + 1, 3):
            words.insert(j, rng.choice(["new york city", "., ", "\n", "of the\tcity hall"]))
        docs.append((" ".join(words), [None, "en", "und", "de"][i % 4]))
    docs += [(None, "en"), ("", None), ("a b", "xx"), ("rep rep " * 40, "en"), ("rep rep rep", "en")] + [("same old words here", "en")] * 5
    for longest, least, contained, top in ((4, 4, 80, 2000), (2, 3, 50, 5), (5, 2, 101, 2000)):
        assert mined(docs, spark, longest=longest, least=least, contained=contained, top=top, shard=shard) == brute_phrases(docs, longest, least, contained, top)


def test_phrases_of_one_long_run_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 64)
    run = ("round and round it goes " * 60).strip()
    assert mined([(run, "en")], spark, least=5, shard=32) == brute_phrases([(run, "en")], 4, 5, 80, 2000)
    assert mined([], spark) == [] and mined([(None, None)], spark) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(2, 5))
def test_index_counts_every_pattern(codes, longest):
    codes = np.array([*codes, 0], np.int32)
    present = np.unique(codes[codes > 0])
    local = np.searchsorted(present, codes) + 1
    local[codes == 0] = 0
    local = local.astype(np.int32)
    index = phrases.ShardIndex(phrases.sorted_transform(local, longest),
                               phrases.sorted_transform(np.concatenate([local[-2::-1], local[-1:]]), longest), present.astype(np.int64))
    words, _, n, _ = index.pairs()
    got = {tuple(w): int(c) for w, c in zip(words.tolist(), n)}
    every = np.sort(words[:, 0] * index.forward.symbols + words[:, 1])
    for words, n in index.longer(every, longest):
        got |= {tuple(w): int(c) for w, c in zip(words.tolist(), n)}
    want = Counter(tuple(local[i: i + k].tolist()) for k in range(2, longest + 1) for i in range(len(local) - k + 1) if (local[i: i + k] > 0).all())
    assert got == want


def test_pairs_are_counted_from_one_transform():
    rng = np.random.default_rng(14)
    for size, words in ((0, 3), (1, 3), (40, 4), (3000, 30)):
        codes = np.append(rng.integers(0, words + 1, size), 0).astype(np.int32)
        first, second, n = phrases.pair_counts(phrases.sorted_transform(codes, 2), words + 1)
        want = Counter((a, b) for a, b in zip(codes.tolist(), codes[1:].tolist()) if a and b)
        assert dict(zip(zip(first.tolist(), second.tolist()), n.tolist())) == want


NASTY = ["<p>a</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "é" * 3000, "\x00\x01", "line\nline\r\n",
         "HTTP/1.1 200 OK\r\n\r\n"]


def expected(rows, least=0):
    best = {}
    for key, _, body in rows:
        body = body or ""
        rank = (key is not None, key if key is not None else 0)
        best[body] = max(best.get(body, (False, 0)), rank)
    out = []
    for key, _, body in rows:
        data = (body or "").encode()
        has, top = best[body or ""]
        own = len(data) < least or (key == top if has else key is None)
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_archives_round_trip(spark, least):
    rows = [(i, f"https://x.org/{i}", NASTY[i % len(NASTY)]) for i in range(40)]
    rows += [(7, "again", NASTY[7]), (None, None, "<p>a</p>"), (None, "bad\r\nurl: x", "only here"), (100, "u", "x" * 3_000_000), (101, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, digest string").repartition(4)
    got = sorted((tuple(r) for r in archives.archive_round_trip(df, least_bytes=least).collect()), key=str)
    assert got == expected(rows, least)
    assert archives.archive_round_trip(df.limit(0)).count() == 0


def test_a_heavy_digest_and_uncompressed_files(spark):
    rows = [(i, "u", "hot" if i % 3 else f"cold {i % 700}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    assert sorted((tuple(r) for r in archives.archive_round_trip(df).collect()), key=str) == expected(rows)
    path = scratch_path(spark)
    archives.write_archives(df, path, "page_id", "url", "html", compression="none")
    found = archives.read_archives(spark, path, payloads=True)
    assert found.count() == 3000 and found.where("record_type = 'response'").count() == len({r[2] for r in rows})
    assert found.where("record_type = 'response' AND digest <> stored_digest").count() == 0


def test_archives_are_deduplicated_across_files(spark):
    first, second, out = (scratch_path(spark) for _ in range(3))
    a = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", "one")]
    b = [(8, "u8", "same"), (9, "u9", "two"), (4, "u4", "one")]
    for rows, path in ((a, first), (b, second)):
        archives.write_archives(spark.createDataFrame(rows, "k bigint, u string, p string"), path, "k", "u", "p")
    archives.deduplicate_archives(spark, [first, second], out)
    got = {r.key: r for r in archives.resolve_revisits(archives.read_archives(spark, out)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        "1": ("revisit", "8"), "2": ("revisit", "8"), "8": ("response", None), "3": ("revisit", "4"), "4": ("response", None), "9": ("response", None)}
    assert all(r.payload_bytes == 4 - (k in ("3", "4", "9")) for k, r in got.items())


def test_reader_takes_members_per_record_and_says_when_bytes_are_missing():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    member = gzip.compress(record)
    assert [b for _, b in archives._Records(member * 3, True)] == [b"hello"] * 3
    assert [f["warc-type"] for f, _ in archives._Records(record * 2, False)] == ["response"] * 2
    for broken in (record[:-8], b"WARC/1.0\r\nContent-", b"hello\r\n\r\n"):
        with pytest.raises(ValueError):
            list(archives._Records(broken, False))
