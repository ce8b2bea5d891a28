"""Page text, cover tree, mixing, toxicity, suffix tree and the pipeline."""

import pickle
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cohortlens.llm import covertree, html_blocks, mixing, suffix_tree, toxicity

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Menu</a><li>More</ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><article><h1>A &amp; B&nbsp;title</h1><p><b>First   line<br><p>Second <i>in</i>line.</p>
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --></article><div class="comments"><div class="comment"><p>Great post</p></div></div>
<footer>&copy; me</footer>"""


def test_blocks_of_broken_markup():
    blocks = [(b.path[-1], b.text) for b in html_blocks.blocks_of(PAGE)]
    assert ("h1", "A & B title") in blocks and ("p", "First line") in blocks and ("p", "Second inline.") in blocks
    assert not any("no" == t for _, t in blocks)
    for odd in ("", "<", "<p", "</p></p>", "<!-- open", "<script>x", "<a '" * 50, "<div>" * 3000 + "x", "plain"):
        html_blocks.blocks_of(odd)
    assert html_blocks.blocks_of("plain")[0].text == "plain"


def test_scripts_end_at_their_end_tag_and_comments_where_they_end():
    texts = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert texts("<script src=x/>var leak=1;</script>a") == ["a"] and texts("<script/>leak()</script >a") == ["a"]
    assert texts("<script>x</scripts>y</script/>a") == ["a"] and texts("<svg><style/>a</svg>") == ["a"]
    assert texts("<!-->a") == ["a"] and texts("<!--->a") == ["a"] and texts("<!---->a<!-- > -->b") == ["ab"]
    assert texts('<p title="x>y">a<p title=\'"\'>b<p title=">c') == ["a", "b", "c"]
    assert texts("if i<n then j<m") == ["if i<n then j<m"]


@pytest.mark.parametrize("unit, end", [("if i<n then ", ""), ("if i<n then ", ">"), ("<a '", ""), ("<a b='>' ", ""), ("<a \"'>'\" ", "'"), ("</script ", ""),
                                       ("<!-", ""), ("<p class=", ""), ("<p a=\"", ""), ("<?", "")])
def test_broken_pages_take_time_in_proportion(unit, end):
    page = "<p>" + unit * (4_000_000 // len(unit)) + end
    start = time.perf_counter()
    html_blocks.blocks_of(page)
    assert time.perf_counter() - start < 5  # a scan to the end for each tag would take minutes


def test_deep_pages_keep_their_text():
    blocks = html_blocks.blocks_of("<div>x" * 20_000)
    assert len(blocks) == 20_000 and max(len(b.path) for b in blocks) == html_blocks.DEPTH


def test_blocks_lose_no_text():
    texts = lambda page: " ".join(b.text for b in html_blocks.blocks_of(page))
    assert texts("<html><head><title>t</title><meta charset=utf-8><p>article one<p>two") == "article one two"
    assert texts("<head><style>p{}</style><title>t</title></head><body>all") == "all"
    page = "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object data=a>fallback</object> <noscript>plain</noscript> <button>Press</button> end</p>"
    assert texts(page) == "Here x=2 holds fallback plain Press end"
    assert [b.path for b in html_blocks.blocks_of(page)][-1] == ("p",)
    for name in ("noscript", "object", "math", "button", "svg", "select"):
        assert texts(f"<div>a<{name}>b<p>the rest").endswith("the rest")


def test_features_see_the_whole_path(spark):
    deep = lambda box: f"<{box}>" + "<div>" * 40 + "<p>text</p>" + "</div>" * 40 + f"</{box}>"
    page = deep("article") + deep("nav") + deep("div class='comments'")
    rows = html_blocks.Features().rows(html_blocks.blocks_of(page))[:, : html_blocks.PATH_DIM]
    assert len(rows) == 3 and len({r.tobytes() for r in rows}) == 3
    (block,) = html_blocks.blocks_of("<div class='flex flex-col items-center mt-4 px-6 sidebar w-full'>x</div>")
    assert "sidebar" in block.path[-1].split(".") and html_blocks.weak_label(block, False) == 0
    long = "<article><p>" + "long text. " * 12_000 + "</p></article><nav>menu</nav>"
    seen, train = [], html_blocks.train
    html_blocks.train = lambda pages: seen.extend(pages) or train(pages)
    try:
        html_blocks.extract_text(spark.createDataFrame([(1, long)], "page_id long, html string")).collect()
    finally:
        html_blocks.train = train
    assert seen == [long]


def test_gradients_match_differences():
    model = html_blocks.BlockLabeller(dim=4, hidden=3)
    rng = np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.normal(size=(5, 2, 4)).astype(np.float32), (rng.random((5, 2)) > 0.5) * 1.0
    mask = np.ones((5, 2), bool)
    mask[3:, 1] = False
    _, grad = model.gradients(x, mask, y)
    for k, v in model.p.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        old, e = v[i], 1e-3
        v[i] = old + e
        up = model.gradients(x, mask, y)[0]
        v[i] = old - e
        down = model.gradients(x, mask, y)[0]
        v[i] = old
        assert abs((up - down) / (2 * e) - grad[k][i]) < 1e-4


def test_extraction(spark):
    rng = np.random.default_rng(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna"]
    text = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    pages, want = [], {}
    for i in range(120):
        good = [text(rng.integers(5, 40)) for _ in range(rng.integers(1, 8))]
        pages.append((i, f"http://x/{i}", f"<html><body><nav><ul><li><a href='/'>{text(1)}</a></li></ul></nav><div class='ad'>{text(9)}</div><article><h1>{good[0][:30]}</h1>"
                      + "".join(f"<p>{g}</p>" for g in good) + f"</article><footer>{text(4)}</footer></body></html>", "mine"))
        want[i] = "\n".join([" ".join(good[0][:30].split()), *good])
    pages += [(500, None, None, ""), (501, "u", "", ""), (None, "u", PAGE, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_blocks.extract_text(df).collect()}
    assert len(got) == 123 and got[500].text == "" and got[501].n_chars == 0
    assert sum(got[i].text == t for i, t in want.items()) >= 118
    assert all(r.n_chars == len(r.text) for r in got.values()) and "cookies" not in got[None].text
    assert html_blocks.extract_text(df.limit(0)).count() == 0


def test_cover_tree(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(1, 8))
    near = centre + 0.05 * rng.normal(size=(60, 8))
    loose = rng.normal(size=(150, 8))
    ring = loose[:40] + 0.25 * rng.normal(size=(40, 8))
    vectors = [v.tolist() for v in np.concatenate([near, loose, ring, near[:5], 1e200 * loose[:3]])]
    vectors += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(vectors))]
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int")
    usable = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: covertree.unit(np.array([vectors[i]]))[0] for i in usable}
    links = {i: [j for j in usable if j != i and len(vectors[i]) == len(vectors[j]) and unit[i] @ unit[j] >= 0.95] for i in usable}
    root = {i: i for i in ids}
    for _ in ids:
        for i in usable:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    for options in ({}, {"tree_rows": 20, "anchors": 3, "sample": 50}):
        got = {r.vec_id: r for r in covertree.link_vectors(df, **options).collect()}
        assert {i: r.n_links for i, r in got.items()} == {i: len(links.get(i, [])) for i in ids}
        assert {i: r.component_id for i, r in got.items()} == root and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert covertree.link_vectors(df.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([10, 10], [3.0, 1.0]) == [20.0, 10.0]
    got = mixing.targets([100, 5, 50], [3.0, 1.0, 2.0])
    assert sum(got) == pytest.approx(232.5) and all(t <= 2 * s for t, s in zip(got, [100, 5, 50]))


def test_split_tree():
    got = mixing.split_tree([100, 7, 0, 33], 6, 42)
    assert got.sum(0).tolist() == [100, 7, 0, 33] and set(got.sum(1)) <= {23, 24} and (got >= 0).all()
    assert (mixing.split_tree([100, 7, 0, 33], 6, 42) == got).all()


def test_mixing(spark, documents, empty):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "abcd"[min(3, int(rng.integers(0, 9)))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df).toPandas()
    for _, part in got.groupby("source"):
        assert part.source_size.iloc[0] == part["size"].sum() and abs(part.taken.sum() - part.target.iloc[0]) <= 60
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_documents(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    out = mixing.mixed_rows(df, shard_col="part").toPandas()
    assert Counter(out.doc_id) == Counter({i: c for i, c in zip(got.doc_id, got.copies) if c})
    assert out.part.between(0, 7).all() and out.groupby("part").size().min() > 0
    dealt = {i: sorted(map(int, x.split(","))) for i, x in zip(got.doc_id, got.shards) if x}
    assert dealt == {i: sorted(p) for i, p in out.groupby("doc_id").part}
    assert {i: len(x) for i, x in dealt.items()} == {i: c for i, c in zip(got.doc_id, got.copies) if c}
    odd = mixing.mix_documents(documents).toPandas()
    assert len(odd) == 13 and (odd.taken <= 2 * odd["size"]).all() and odd[odd.source.isna()].source_size.tolist() == [2, 2, 2]
    assert mixing.mixed_rows(documents).columns == documents.columns
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mix_equals_a_plain_walk(spark):
    """Blocks of every source in permuted order up to the target, and shards cut from the same order by the tree."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9))), None if i % 5 == 0 else "ab"[i % 2]) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(df)
    facts = mix.rows.toPandas()
    rank = {(r.k, r.block): r["rank"] for r in mix.blocks.collect()}
    facts["rank"] = [rank[k, b] for k, b in zip(facts.k, facts.block)]
    got = {r.doc_id: r for r in mixing.mix_documents(df).collect()}
    for k, part in facts.groupby("k"):
        target, epochs, blocks = part.target.iloc[0], int(part.epochs.iloc[0]), int(part.n_blocks.iloc[0])
        rest, copies, draws = target - epochs * part["size"].sum(), {}, {}
        for place, block in sorted({(r, b) for r, b in zip(part["rank"], part.block)}):
            docs = part[part.block == block]
            for e in range(epochs):
                draws[e * blocks + place] = docs.doc_id.tolist()
            chosen = docs if docs["size"].sum() <= rest else docs.iloc[:0]
            if rest > 0 and len(chosen) == 0:
                keep, gap = [], rest
                for i, n in sorted(zip(docs.doc_id, docs["size"]), key=lambda x: (-x[1], int(docs[docs.doc_id == x[0]].h.iloc[0]), x[0])):
                    if n <= gap:
                        keep.append(i)
                        gap -= n
                chosen = docs[docs.doc_id.isin(keep)]
                rest = 0
            rest -= docs["size"].sum() if len(chosen) == len(docs) else rest
            if len(chosen):
                draws[epochs * blocks + place] = chosen.doc_id.tolist()
            for i in docs.doc_id:
                copies[i] = epochs + int(i in set(chosen.doc_id))
        assert copies == {i: got[i].copies for i in copies}
        cuts = mix.cuts[k]
        want = {}
        for draw, ids in draws.items():
            for i in ids:
                want.setdefault(i, []).append(sum(c <= draw for c in cuts))
        assert {i: sorted(s) for i, s in want.items()} == {i: sorted(map(int, got[i].shards.split(","))) for i in want}
        assert cuts[-1] >= max(draws) + 1 - blocks


def test_alike_rows_keep_their_own_columns(spark):
    rows = [(1, "same words here", "a", f"u{i}") for i in range(3)] + [(2, "other words", "a", "v"), (None, "no id", None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    out = Counter(r.url for r in mixing.mixed_rows(df, weights={"a": 1.0, None: 1.0}, factor=2.0, most=2.0).collect())
    assert set(out) == {"u0", "u1", "u2", "v", "n"} and set(out.values()) == {2}


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(words, 40).tolist()
        toxic = int(rng.random() < 0.25)
        if toxic:
            w[rng.integers(0, 40)] = str(rng.choice(["grumpf", "blargh", "zonkish"]))
        rows.append((i, " ".join(w), "s"))
        if i % 3:
            labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, documents, empty):
    df, labels = toxic_corpus(spark)
    got = toxicity.score_documents(df, labels, evidence=True).toPandas()
    bad = got.text.str.contains("grumpf|blargh|zonkish")
    assert (got.predicted == bad).mean() > 0.99 and got.score.between(0, 1).all()
    assert got[bad].evidence.map(len).min() > 0
    assert toxicity.keep_clean(df, labels).count() == (got.predicted == 0).sum()
    kept = toxicity.keep_clean(documents, labels)
    assert kept.columns == documents.columns and kept.count() == 13 and {r.score for r in kept.collect()} == {1.5}
    assert toxicity.keep_clean(documents, labels.limit(0)).count() == 13 and toxicity.keep_clean(empty, labels).count() == 0


def test_toxic_cosine_is_over_all_words(spark):
    df, labels = toxic_corpus(spark, 200)
    rows = {r.doc_id: r.text.encode() for r in df.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    examples = [i for i in known if zlib.crc32(str(i).encode()) % 5]
    terms = {i: Counter(t for w in text.split() for t in toxicity.terms_of(w)) for i, text in rows.items()}
    vocabulary = {t for i in examples for t in terms[i]}
    df_of = Counter(t for c in terms.values() for t in c)

    def unit(i):
        w = {t: (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df_of[t])) + 1) for t, n in terms[i].items() if t in vocabulary}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    units = {i: unit(i) for i in rows}
    for r in toxicity.score_documents(df, labels, evidence=True).collect():
        want = {e: sum(x * units[e].get(t, 0.0) for t, x in units[r.doc_id].items()) for e in examples}
        assert np.allclose([e.cosine for e in r.evidence], sorted(want.values())[::-1][:15], atol=1e-6)
        assert all(abs(want[e.doc_id] - e.cosine) < 1e-6 and known[e.doc_id] == e.label for e in r.evidence)


def test_toxic_terms_that_clean_texts_hold_too(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        w = rng.choice(words, 30).tolist()
        toxic = int(i % 50 == 0)
        if toxic or i % 50 == 1:  # as many clean holders as toxic ones
            w[3] = "grumpf"
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    bad = got.text.str.contains("grumpf")
    assert (got[bad].score > 0.2).mean() > 0.9 and got[~bad].score.quantile(0.99) < 0.2


def test_index_finds_the_nearest():
    rng = np.random.default_rng(6)
    vectors = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(60, rng.integers(0, 9), replace=False)} for _ in range(700)]
    idf = rng.random(60) + 0.5
    index = toxicity.Index(vectors, rng.integers(0, 2, 700), idf)
    dense = np.zeros((700, 60))
    for place, i in enumerate(index.rows):
        for t, w in index.weights(vectors[i]).items():
            dense[place, t] = w
    for v in vectors[:80]:
        q = np.zeros(60)
        for t, w in index.weights(v).items():
            q[t] = w
        at, cosine = index.nearest(v)
        scores = np.sort((dense @ q)[dense @ q > 0])[::-1][:15]
        assert np.allclose(cosine, scores) and np.allclose((dense @ q)[at], cosine)


def test_index_of_packed_examples():
    """Examples stay packed on the driver; the arrays are made where the first query comes, and give the same neighbours."""
    rng = np.random.default_rng(9)
    vectors = [(np.sort(rng.choice(3000, rng.integers(0, 60), replace=False)).astype(np.int32), None) for _ in range(1500)]
    vectors = [(at, rng.integers(1, 4, len(at)).astype(np.int32)) for at, _ in vectors]
    vectors[7] = (vectors[7][0], vectors[7][1] + 70_000)
    idf, labels = rng.random(3000) + 0.5, rng.integers(0, 2, 1500)
    index = toxicity.Index([toxicity.packed_vector(v) for v in vectors], labels, idf)
    assert not any(isinstance(x, np.ndarray) and len(x) > 3000 for x in vars(index).values())
    dense = np.zeros((1500, 3000))
    for place, i in enumerate(index.rows):
        dense[place, vectors[i][0]] = index.unit(*vectors[i])[1]
    sent = pickle.loads(pickle.dumps(index))
    for v, (at, cosine) in zip(vectors[:150], sent.nearest_of(vectors[:150])):
        q = np.zeros(3000)
        q[v[0]] = sent.unit(*v)[1]
        scores = dense @ q
        assert np.allclose(cosine, np.sort(scores[scores > 0])[::-1][:15], atol=1e-6) and np.allclose(scores[at], cosine, atol=1e-6)


def test_index_of_clusters_and_columns():
    """Terms that many texts of a batch and many examples of a cluster hold are summed by matrix products; nothing is lost or counted twice."""
    rng = np.random.default_rng(12)

    def vector():
        language = int(rng.integers(0, 3))
        own = np.unique(np.concatenate([language * 400 + (60 * rng.random(25) ** 2).astype(int), language * 400 + rng.integers(60, 400, 12), 1200 + rng.integers(0, 30, 3)]))
        return own.astype(np.int32), rng.integers(1, 4, len(own)).astype(np.int32)

    vectors, queries = [vector() for _ in range(2500)], [vector() for _ in range(1100)]
    idf = rng.random(1300) + 0.5
    index = toxicity.Index(vectors, rng.integers(0, 2, 2500), idf)
    index._build()
    products = []
    index._columns = lambda c, chosen, f=index._columns: products.append((c, len(chosen))) or f(c, chosen)
    dense = np.zeros((2500, 1300))
    for place, i in enumerate(index.rows):
        at, w = index.unit(*vectors[i])
        dense[place, at] = w
    for v, (at, cosine) in zip(queries, index.nearest_of(queries)):
        at_, w = index.unit(*v)
        scores = dense[:, at_] @ w
        assert np.allclose(cosine, np.sort(scores)[::-1][:15], atol=1e-6) and np.allclose(scores[at], cosine, atol=1e-6)
    assert len({c for c, _ in products}) > 1 and sum(n for _, n in products) > 50
    own = index.nearest_of([vectors[i] for i in index.rows[:900]], leave=list(range(900)))
    assert all(place not in at for place, (at, _) in enumerate(own))


def test_index_takes_memory_for_entries_alone():
    """Many short examples: no matrix of all examples and widely held terms stands beside the lists."""
    rng = np.random.default_rng(13)
    vectors = [(np.sort(rng.choice(20_000, 8, replace=False)).astype(np.int32), np.ones(8, np.int32)) for _ in range(8000)]
    index = toxicity.Index(vectors, rng.integers(0, 2, 8000), rng.random(20_000) + 0.5)
    assert len(index.nearest(vectors[5])[0])
    assert sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) < 8 << 20


def test_vocabulary_travels_as_an_arrow_array():
    names = pa.array([b"", b"a", b"ab*", "né".encode()], pa.binary())
    sent = pickle.loads(pickle.dumps(toxicity.Vocabulary(names)))
    assert sent.names.equals(names) and len(pickle.loads(pickle.dumps(toxicity.Vocabulary(names[:0]))).names) == 0
    total = np.zeros(3, np.int64)
    toxicity.Extractor({b"a": 0, b"abcd*": 1, b"abcde": 2}).count([b"a A a abcde", b"", b"abcdz  ", b"\xff abcd"], total)
    assert total.tolist() == [1, 2, 1]


def test_terms_of_remembered_words(monkeypatch):
    monkeypatch.setattr(toxicity, "_MEMORY", 50)
    rng = np.random.default_rng(10)
    words = [bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 9)).tolist()) for _ in range(300)]
    numbers = {t: i for i, t in enumerate(sorted({t for w in words[:200] for t in toxicity.terms_of(w)}))}
    extract = toxicity.Extractor(numbers)
    for _ in range(100):
        text = rng.choice(words, rng.integers(0, 40)).tolist()
        brute = Counter(numbers[t] for w in text for t in toxicity.terms_of(w) if t in numbers)
        at, n = extract.vector(b" ".join(text))
        assert dict(zip(at.tolist(), n.tolist())) == brute and at.tolist() == sorted(brute) == extract.held(b" ".join(text)).tolist()


def test_table_of_terms_is_made_once_for_several_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "_MEMORY", 100)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"{c}" * int(n) for c, n in zip("abcdef", rng.integers(1, 9, 6))).encode() for _ in range(40)]
    names = toxicity.distinct_terms([*texts, b"", b"  ", b"end "])
    assert set(names.to_pylist()) == {t for x in [*texts, b"end"] for w in x.split() for t in toxicity.terms_of(w)} and names.null_count == 0
    calls = []
    monkeypatch.setattr(toxicity.pc, "index_in", lambda *a, f=toxicity.pc.index_in, **k: calls.append(1) or f(*a, **k))
    extract = toxicity.Extractor(names)
    parts = len(list(toxicity.batches_of(np.array([len(t) for t in texts]), 100)))
    for text, (at, n) in zip(texts, extract.vectors(texts), strict=True):
        got = dict(zip((names[int(i)].as_py() for i in at), n.tolist()))
        assert got == Counter(t for w in text.split() for t in toxicity.terms_of(w))
    assert len(calls) == -(-parts // toxicity._PARTS) < parts


def test_few_examples_are_summed_again():
    rng = np.random.default_rng(13)
    vectors = [{int(t): 1 for t in rng.choice(400, 30, replace=False)} for _ in range(3000)]
    vectors += [{**v, 400 + i: 1} for i, v in enumerate(vectors[:40])]
    index = toxicity.Index(vectors, rng.integers(0, 2, len(vectors)), np.append(rng.random(400) + 0.5, np.full(40, 1e-2)))
    index._build()
    looked = []
    index._room = lambda name, n, kind, f=index._room: (looked.append(n) if name == "found" else None) or f(name, n, kind)
    for v in vectors[:40]:
        at, cosine = index.nearest(v)
        q = np.zeros(440)
        for t, w in index.weights(v).items():
            q[t] = w
        want = np.sort([sum(w * q[t] for t, w in index.weights(x).items()) for x in vectors])[::-1][:15]
        assert np.allclose(cosine, want, rtol=1e-6)
    assert max(looked) < 20 * 31


def test_suffix_tree(spark, documents, empty):
    rng = np.random.default_rng(7)
    chain = {w: rng.permutation(20)[:3] for w in range(20)}
    rows = []
    for i in range(800):
        w, out = int(rng.integers(20)), []
        for _ in range(40):
            out.append(f"Word{w}")
            w = int(rng.choice(chain[w]))
        rows.append((i, " ".join(out) + (f" rare{i}" if i % 7 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score_texts(df).toPandas().set_index("doc_id")
    words = lambda t: t.lower().split() + [" "]
    seen = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in rows:
        own = words(t)
        base = sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[w] > 0 for w in own), n) and abs(r.base_score - base) < 1e-6
    held = got[got.held_out]
    assert len(held) and held.score.sum() > 0.6 * held.base_score.sum()
    odd = suffix_tree.score_texts(documents).collect()
    assert len(odd) == 13 and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in odd)
    assert suffix_tree.score_texts(empty).count() == 0
    nothing = suffix_tree.score_texts(df, held=df.doc_id.isNotNull()).collect()
    assert all(r.score == r.base_score and r.train_tokens == 0 for r in nothing)


def test_words_are_hashed_and_classed_together():
    """All words of a step at once, with the hashes and classes of each alone."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(11)
    words = [b"a", b"ab.", b"...", b"\x00\x00z", "né,".encode(), "日本語".encode(), b"don't", b"(x)"]
    words += list({bytes(rng.integers(33, 256, rng.integers(1, 9)).astype(np.uint8).tolist()) for _ in range(500)} - set(words))

    def alone(word):
        bare = word.rstrip(b".,;:!?\"')")
        return (sum(c * 31 ** i for i, c in enumerate(bare[-3:])) * 2 + (len(bare) < len(word))) % suffix_tree.CLASSES

    assert suffix_tree.word_classes(words).tolist() == [alone(w) for w in words]
    assert suffix_tree.word_hashes(words).tolist() == [x - (1 << 64) if (x := xxh64_intdigest(w)) >> 63 else x for w in words]
    frequent = {int(h): 2 + i for i, h in enumerate(suffix_tree.word_hashes(words[:5]))} | {suffix_tree.END_HASH: suffix_tree.END}
    parts, _, symbols = suffix_tree.Words(frequent, 7).symbols([b"a ab. a", b"", b"(x) ..."])
    assert [symbols[p].tolist() for p in parts] == [[2, 3, 2], [], [7 + alone(b"(x)"), 4]]


def test_tree_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(8)
    size, unknown = 6, 0.01
    sequences = [np.append(rng.integers(2, size, 200), suffix_tree.END).astype(np.uint16).tobytes() for _ in range(20)]
    root = np.array([0, 0.05, 0.2, 0.3, 0.24, 0.2])
    tree = suffix_tree.learn_tree(spark.createDataFrame([(bytearray(s),) for s in sequences], "symbols binary"), size, root, unknown, 4020)
    assert np.allclose((root * 10**tree.ratio).sum(1), 1 - unknown)


def test_word_contexts_equal_a_naive_tree(spark, monkeypatch):
    """Every context of words seen twice, counted, smoothed, tested and retained, without the upper part."""
    monkeypatch.setattr(suffix_tree, "SYMBOL_SHARE", 2.0)
    monkeypatch.setattr(suffix_tree, "learn_tree", lambda sequences, size, *a: suffix_tree.Tree(size))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 25))) % 40) for _ in range(150)] + ["x1 x2 x3 x4 x5 x6"] * 3 + [None, "new"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    held = [i % 5 == 0 for i in range(len(texts))]
    got = {r.doc_id: r for r in suffix_tree.score_texts(df, held=df.doc_id % 5 == 0).collect()}
    words = [(t or "").split() + [None] for t in texts]
    seen = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    scale = sum(seen.values()) + 0.1 * (len(seen) + 1)
    unknown = 0.1 / scale

    def context(ws, i, d):
        return None if i < d - 1 or i == 0 else (*(["<s>"] if i == d - 1 else []), *ws[max(0, i - d): i])

    places = [(j, i) for j, ws in enumerate(words) for i, w in enumerate(ws) if seen[w]]
    p = {(j, i): (seen[words[j][i]] + 0.1) / scale for j, i in places}
    last, base, deep = dict(p), dict(p), 0
    for d in (1, 2, 3):
        counts = defaultdict(Counter)
        for j, i in places:
            if not held[j]:
                counts[context(words[j], i, d)][words[j][i]] += 1
        up, gain = dict(p), Counter()
        for j, i in places:
            c, w = context(words[j], i, d), words[j][i]
            n, k = sum(counts[c].values()), len(counts[c])
            if c and n >= 2:
                p[j, i] = ((1 - unknown) * counts[c][w] + k * up[j, i]) / (n + k)
                gain[c] += 0 if held[j] else np.log(counts[c][w] / n / up[j, i])
        for j, i in places:
            c = context(words[j], i, d)
            if c and sum(counts[c].values()) >= 2 and gain[c] > 0.5 * len(counts[c]) * np.log(sum(counts[c].values())):
                last[j, i] = p[j, i]
                deep += 1
    more = Counter()
    for j, i in places:
        more[j] += np.log10(last[j, i] / base[j, i])
    assert deep > 500 and all(abs(got[j].score - got[j].base_score - more[j]) < 1e-9 for j in range(len(texts)))


def test_texts_that_occur_twice_score_apart(spark):
    """What is learned grows with the corpus: no text's words are frequent, and a second occurrence tells."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 3_000, 60)) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts + texts[:40])], "doc_id long, text string")
    gain = suffix_tree.score_texts(df, held=df.doc_id < 0).toPandas().set_index("doc_id").eval("(score - base_score) / n_tokens")
    twice = np.isin(gain.index % 400, range(40))
    assert twice.sum() == 80 and gain[twice].min() > gain[~twice].max() + 0.5


def test_pipeline_stages(spark, tmp_path):
    df, labels = toxic_corpus(spark)
    extra = spark.createDataFrame([(1000, "a b c d e f g h i j k l", "t"), (1001, "a b c d e f g h i j k l", None), (1002, None, "t")], "doc_id long, text string, source string")
    docs = df.union(extra).selectExpr("doc_id", "text", "'en' lang", "source", "length(text) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "c d e f g h i j k l")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.collect()}
        if name != "sharding":
            assert now.columns == docs.columns
    bad = {r.doc_id for r in df.where("text rlike 'grumpf|blargh|zonkish'").collect()}
    assert not kept["toxicity"] & bad and 1001 in kept["toxicity"]
    assert {1000} == kept["near_duplicates"] & {1000, 1001} and 1000 not in kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept["sharding"] and sorted(r.slot for r in final if r.shard == 0) == list(range(sum(r.shard == 0 for r in final)))
