"""Token files, token counts, fingerprints, decontamination, sharding against brute force on awkward rows."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, feistel, simhash, token_codec, token_counts, words_tokens
from cohortlens.llm.queries import tokenizer_path


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_codec_round_trip(values):
    control, data = token_codec.encode_ranks(np.array(values, np.uint32))
    assert token_codec.decode_ranks(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(documents, empty):
    files, ranks = token_codec.tokenize_to_files(documents, tokenizer_path(), 1)
    got = token_codec.with_crc32(token_codec.read_files(files, ranks)).collect()
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = [ids + [1] for ids in library_ids([r.text for r in rows])]
    starts = np.cumsum([0, *map(len, want)])[:-1]
    assert sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (r.doc_id or 0, s, len(w), token_codec.crc32_of(w)) for r, s, w in zip(rows, starts, want))
    files, ranks = token_codec.tokenize_to_files(empty, tokenizer_path(), 1)
    assert token_codec.read_files(files, ranks).count() == 0


def test_token_counts(documents, empty):
    got = token_counts.count_tokens(documents, tokenizer_path(), limit=100).collect()
    for r, ids in zip(got, library_ids([r.text for r in got])):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 100)
    assert "_text" in got[0] and token_counts.count_tokens(empty, tokenizer_path()).count() == 0


MARKS = [*map(chr, range(0x300, 0x345)), "\u0338", "\u0653", "\u3099", "\u1161", "\uac00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"HJTWYKSLShjtwyikÅΣςÉẞİıſ\u212a\u00a0\u2028.,'<|> \n0", *MARKS]), max_size=30), min_size=1, max_size=8))
def test_pieces_give_the_ids_of_the_library(texts):
    words = words_tokens.WordTokens.of(tokenizer_path())
    texts = [*texts, "J\u030cello H\u0331 T\u0308 W\u030a Y\u030a"]
    flat, n = words.encode([t.encode() for t in texts])
    want = library_ids(texts)
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert words.lengths([t.encode() for t in texts]).tolist() == n.tolist()


def test_words_of_latin_letters_share_a_call():
    """Words with sharp s and capitals are letters as others, and the distinct pieces of a batch are looked up once."""
    words = words_tokens.WordTokens(tokenizer_path())
    texts = ["Straße Éclair ÀÀß Weiß\u0301e ÑANDÚ", "  ", "", "Straße\x0b weiß.\x1cx Üß, ×÷ ß Aé", "É. ß,ß ."] * 3
    handed = []
    words._ids = lambda texts, f=words._ids: handed.extend(texts) or f(texts)
    flat, lens = words.encode([t.encode() for t in texts])
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lens.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert not {"Straße", "Éclair", "ÀÀß", "ÑANDÚ", "ß"} & set(handed)



def test_long_texts_are_cut_at_white_space():
    text = b"ab cde " * 1000
    pieces = token_counts.safe_pieces(text, 100)
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 100
    assert token_counts.safe_pieces(b"x" * 500, 100) == [b"x" * 500]


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, near):
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_labels(documents, empty):
    got = simhash.label_documents(documents).collect()
    rows = documents.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    top = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for r, t in zip(rows, top):
        if r.doc_id is not None:
            smallest[t] = min(smallest.get(t, r.doc_id), r.doc_id)
    want = sorted((r.doc_id or 0, f"{p:016x}", smallest.get(t) or 0) for r, p, t in zip(rows, prints, top))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in got) == want
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(top))
    assert simhash.label_documents(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_variants": 2000, "min_bits": 3}])
def test_ball_links_find_every_pair(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40)
    prints = {0}
    for c in centres.tolist():
        for _ in range(12):
            v = c
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                v ^= 1 << b
            prints.add(v if v < 1 << 63 else v - (1 << 64))
    prints = sorted(prints)
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "f long, i long")
    got = {r.f: r.keeper for r in simhash.near_duplicates(df, "i", "f", **options).collect()}
    top = groups_of(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert [got[p] for p in prints] == top


def slow_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            part = w[i: i + 10]
            for k in range(len(own) - len(part) + 1):
                if own[k: k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(item)
    return len(own), len(hit), found


def test_decontamination(spark, documents, empty):
    items = [(1, "Alpha, beta; GAMMA delta epsilon zeta eta theta iota kappa lambda!"), (2, "one TWO"), (30, "one-two"), (4, ""), (5, None), (6, "été ça"), (None, "lonely")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 22, 40):
        got = decontaminate.find_contamination(documents, benchmark, spans=True, automaton_bytes=bound).collect()
        for r in got:
            n, hit, found = slow_hits(r.text if r.doc_id != 9 else "word " * 60_000, items)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found - {None}), hit > 0)
            if r.doc_id == 7:
                assert [r.text[s.first: s.end] for s in r.hit_spans] == ["One two"]
            if r.doc_id == 1:
                assert r.text[r.hit_spans[0].first: r.hit_spans[0].end].startswith("Alpha") and r.n_hit == 11
    assert decontaminate.find_contamination(documents, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, benchmark).count() == 0


def slow_permutation(n, seed):
    a, out = feistel.side(n), []
    for x in range(n):
        while True:
            left, right = divmod(x, a)
            for k, c in feistel.round_keys(seed):
                t = (right + k) % feistel.PRIME
                left, right = right, (left + (t * t % feistel.PRIME) * ((t + c) % feistel.PRIME) % feistel.PRIME) % a
            x = left * a + right
            if x < n:
                break
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select("id", feistel.permute("id", n, 5).alias("p")).orderBy("id").collect()]
    assert got == ([0] if n == 1 else slow_permutation(n, 5)) and sorted(got) == list(range(n))


def test_shards(documents, empty):
    got = feistel.documents_to_shards(documents).collect()
    assert len(got) == 13 and {r.law for r in got} == {"rows"}
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (1, 2)
    by = {r.doc_id: r for r in got}
    assert by[4].size == 1 and by[4].text_crc32 == 0 and by[8].text_crc32 == zlib.crc32("Été ça va, l'eau <|endoftext|> 2024!".encode())
    again = feistel.documents_to_shards(documents.repartition(3, F.rand(1))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    rows = feistel.shard_rows(documents, shards=3)
    assert rows.columns == [c for c in documents.columns if c != "shard"] + ["shard", "slot"] and rows.count() == 13
    assert feistel.documents_to_shards(empty).count() == 0
