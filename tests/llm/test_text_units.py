"""Parts that need no Spark: shingles, pre-tokenisation, merging, the network, the page renderer."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from cases import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import byte_bpe, gru, html_text, language_id, vocabularies
from pagesieve.llm.shingles import shingle_sets, text_chunks
from pagesieve.llm.toxicity import _threshold

RANKS = byte_bpe.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGER = byte_bpe.Merger(RANKS)


def texts(n=200):
    return pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:n]


def brute_shingles(text, width=5):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def test_shingle_sets_have_the_sizes_and_overlaps_of_word_tuples():
    column = texts(60) + [None, "", " ", "a", "a b", "A  B", "a\tb\vc d e F", "a b c d e a b c d e a b c d e", "É é É é É"]
    mine = []
    for _, data, offsets in text_chunks(pa.array(column), 20_000):
        values, sizes = shingle_sets(data, offsets, 5)
        mine += np.split(values, np.cumsum(sizes)[:-1])
    theirs = [brute_shingles(t) for t in column]
    assert [len(m) for m in mine] == [len(t) for t in theirs]
    for i in range(0, len(column), 3):
        for j in range(len(column)):
            assert len(np.intersect1d(mine[i], mine[j])) == len(theirs[i] & theirs[j])


def encode(column, merger=MERGER):
    out = []
    for _, ids, counts, _ in byte_bpe._chunked(pa.array(column, pa.string()), merger):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_ids_equal_those_of_the_library_on_documents():
    column = [*texts(), None, "", "x" * 5000, "ab" * 3000, " " * 300, "\n" * 9 + "a"]
    assert encode(column) == [ORACLE.encode_ordinary(t or "") for t in column]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab  's't're've'll'm'd'x\n\t12٣é中😀!? 　\x1c\x85́", max_size=60), min_size=1, max_size=5))
def test_ids_equal_those_of_the_library_on_odd_texts(column):
    assert encode(column) == [ORACLE.encode_ordinary(t) for t in column]


def test_a_tiny_cache_and_colliding_hashes_change_nothing(monkeypatch):
    column = texts(20)
    expected = [ORACLE.encode_ordinary(t) for t in column]
    assert encode(column, byte_bpe.Merger(RANKS, limit=10)) == expected
    real = byte_bpe.slice_hashes
    weak = byte_bpe.Merger(RANKS)
    # While the seed is 0 all hashes fall on few values, so slices do collide.
    monkeypatch.setattr(
        byte_bpe, "slice_hashes", lambda v, s, e: real(v, s, e) >> np.uint64(48 if weak.seed == 0 and len(s) < 50_000 else 0)
    )
    assert encode(column, weak) == expected


def network_case():
    network = gru.Network.fresh()
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    (_, data, offsets), *_ = text_chunks(pa.array(["the idiot is here and there you fool " * 3, "a b c", "x y " * 40]), 1 << 40)
    words = gru.read_words(data, offsets)
    _, first, sizes = gru.windows(words.counts)
    places = words.kind[np.minimum(first[:, None] + np.arange(gru.WINDOW), len(words.kind) - 1)]
    return network, network.embed(words), places, sizes


def test_gradients_equal_difference_quotients(monkeypatch):
    monkeypatch.setattr(gru, "_FLOAT", np.float64)
    network, inputs, places, sizes = network_case()
    kept = {}
    logits = network.logits(inputs, places, sizes, kept)
    found, d_inputs = network.gradients(inputs, places, sizes, np.ones(len(logits)), kept)

    def quotient(array, at, step=1e-5):
        old = array[at]
        values = []
        for value in (old + step, old - step):
            array[at] = value
            values.append(network.logits(inputs, places, sizes).sum())
        array[at] = old
        return (values[0] - values[1]) / (2 * step)

    for name in ("xf", "hf", "cf", "xb", "hb", "cb", "look", "out", "bias"):
        at = tuple(n // 2 for n in network.weights[name].shape)
        assert quotient(network.weights[name], at) == pytest.approx(found[name][at], abs=1e-6)
    assert quotient(inputs, (1, 2)) == pytest.approx(d_inputs[1, 2], abs=1e-6)


def test_windows_overlap_and_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    owner, first, sizes = gru.windows(counts)
    starts = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        seen = [w - starts[i] for f, s in zip(first[owner == i], sizes[owner == i]) for w in range(f, f + s)]
        assert set(seen) == set(range(n)) and all(s > 0 for s in sizes[owner == i])
        if n > gru.WINDOW:
            assert len(seen) > n


def test_every_window_is_scored():
    network, draw = gru.Network.fresh(), np.random.default_rng(5)
    network.weights = {k: v + np.float32(0.1) * draw.standard_normal(v.shape).astype(np.float32) for k, v in network.weights.items()}
    many = [0, 1, 31, 32, 33, 0, 60, 32, 5000, 3, 40, 0]
    texts = [" ".join(draw.choice(["one", "Two", "three,", "é", "five"], n)) for n in many]
    for chosen in (texts, texts[:3], texts[3:4], texts[8:9], [""]):
        (_, data, offsets), *_ = text_chunks(pa.array(chosen, pa.large_string()), 1 << 20)
        words = gru.read_words(data, offsets)
        owner, first, sizes = gru.windows(words.counts)
        logits = network.score_windows(words, gru._laid_out(words, first), sizes)
        expected = [max(logits[owner == i], default=-np.inf) for i in range(len(chosen))]
        np.testing.assert_allclose(network.score_texts(words), expected, atol=1e-4)


def test_threshold_parts_two_labels():
    logits = np.array([-3.0, -2.0, 0.5, 2.0, 3.0, -np.inf])
    assert -2.0 < _threshold(logits, np.array([0, 0, 1, 1, 1, 0])) < 0.5


PAGES = {
    "<p>one<p>two <b>bo</b>ld<br>br<div hidden>no</div>": "one\n\ntwo bold\nbr",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>x": "- a\n- b\n\n  3. c\n  4. d\n\nx",
    "<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>alpha<td>1</table>": "Cap\nName  | Value\nalpha | 1",
    "<table><tr><td colspan=2>a<td>b</tr>stray<tr><td>1<td>22<td>3</table>": "stray\na |    | b\n1 | 22 | 3",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in | out",
    "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f</table>": "a | b | c\n  | d | e\nf",
    "<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h<td>i</table>": "a | b |   | c\nd |   |   | e\nf | g | h | i",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>": "a | b\n  | c\nd | e",
    "<table><thead><tr><td rowspan=9>a<td>b</thead><tbody><tr><td>c<td>d</table>": "a | b\nc | d",
    "<table><tr><td colspan=999>a<td>b<tr><td>c</table>": "a | b\nc",
    "<table><tr><td rowspan=x colspan=0>a<td>b<tr><td>c<td>d</table>": "a | b\nc | d",
    "<table><tr><td>" + "word " * 12 + "<td>right<tr><td>short<td>" + "long " * 12 + "</table>":
        "word word word word word word word word | right\n" + "word word word word".ljust(39) + " |\n" + "short".ljust(39) + " | " + "long " * 11 + "long",
    "<table><tr><td>" + "x" * 50 + " y<td>b<tr><td>yy<td>c</table>": "x" * 50 + " | b\ny  |\nyy | c",
    "<pre>  keep\n   this</pre>": "  keep\n   this",
    "<head><title>t</title><style>p{}</style></head><body>b<script>var t='</p>';</script>": "b",
    "a &lt;b&gt; &amp; c &copy; &#233; < d <3": "a <b> & c © é < d <3",
    "<details><summary>S</summary>gone</details><details open><summary>S</summary>here</details>": "S\nS\nhere",
    "<p style='DISPLAY: none'>x</p><!-- c --><!doctype html><?php ?>y</p></div>z": "yz",
    "<select><option>o1<option>o2</select><dl><dt>t<dd>d</dl>": "o1\no2\n\nt\n  d",
    "<textarea>&lt;b> <b>x</textarea>": "<b> <b>x",
    "<div>a<div>b</div>c</div>": "a\nb\nc",
    "": "",
    "   plain   text\n ": "plain text",
    "<script>never closed": "",
    "<a href='unclosed": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_are_laid_out(page):
    assert html_text.extract(page) == PAGES[page]


def test_broken_and_deep_pages_do_not_fail():
    for page in ("<div>" * 50_000 + "x", "<b>" * 3000 + "x", "<table>" * 5000 + "x", "<ul><li>" * 3000 + "x"):
        assert "x" in html_text.extract(page)
    for page in ("<" * 20_000, '<a "' * 20_000, "</p>" * 20_000, "<td>" * 20_000, "<!--", "</", "<a b=" + "'x" * 20_000):
        html_text.extract(page)
    assert html_text.extract(None) is None


def test_all_visible_words_of_generated_pages_remain():
    for page in pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()[:60]:
        plain = re.sub(r"(?is)<(script|style|title|head)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ", page)
        expected = html_text.unescape(plain).split()
        got = [w for w in html_text.extract(page).split() if w not in {"-", "|"}]
        assert got == [w for w in expected if w not in {"-", "|"}]


def test_ngrams_do_not_cross_texts_and_nulls_have_none():
    together = [c for _, counts in language_id.ngram_counts(pa.array(["abc", None, "Abc!", "", "a b"])) for c in counts]
    alone = [next(language_id.ngram_counts(pa.array([t])))[1][0] for t in ("abc", "", "Abc!", "", "a b")]
    assert all((a == b).all() for a, b in zip(together, alone))
    assert together[1].sum() == together[3].sum() == 0 and (together[0] != together[4]).any()


def test_clusters_are_centroids_of_their_members():
    draw = np.random.default_rng(2)
    ends = language_id._unit(draw.standard_normal((3, 20)))
    x = language_id._unit(np.repeat(ends, 30, axis=0) + 0.05 * draw.standard_normal((90, 20)))
    found = language_id.cluster(x, 3)
    assert sorted((found @ ends.T).argmax(axis=1).tolist()) == [0, 1, 2] and (found @ ends.T).max(axis=1).min() > 0.99
    assert len(language_id.cluster(x[:2], 4)) == 2


def test_long_slices_merge_like_short_ones():
    draw = random.Random(4)
    for _ in range(60):
        piece = "".join(draw.choice("aeinrst") for _ in range(draw.randint(2, 40))).encode()
        data = np.frombuffer(piece, dtype=np.uint8)
        _, ids = MERGER.merge_all(data, np.array([0]), np.array([len(piece)]))
        assert tuple(ids.tolist()) == MERGER.merge_long(piece)


DEEP = [
    "<div hidden><p>no</p><ul><li>no</li></ul></div>yes",
    "<div style='display:none'><b><i>no</i></b></div><template><p>no</p></template>yes",
    "<details><summary>S</summary><div><p>gone</p></div></details>yes",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>x",
    "<table><tr><th>Name<th>Value<tr><td>alpha<td>1</table>x",
    "<blockquote><p>one</p></blockquote><dl><dt>t<dd>d</dl>",
]


@pytest.mark.parametrize("wrapper", ["<span>", "<font>", "<div>"])
@pytest.mark.parametrize("depth", [149, 150, 400, 5000])
@pytest.mark.parametrize("page", DEEP)
def test_depth_changes_nothing(page, depth, wrapper):
    wrapped = wrapper * depth + page
    assert html_text.extract(wrapped) == html_text.extract(page)
    assert html_text.extract(wrapped + wrapper.replace("<", "</") * depth + "<p>after") == html_text.extract(page + "<p>after")


def test_end_tags_far_below_close_their_own_element():
    page = "<div hidden>" + "<span>" * 300 + "<div>no</div>" + "</span>" * 300 + "no</div>yes"
    assert html_text.extract(page) == "yes"


def test_deeply_nested_lists_quotes_and_cells_keep_text_in_bounded_space():
    for piece in ("<ul><li>a", "<blockquote>a", "<table><tr><td>b<td>a<br>"):
        text = html_text.extract(piece * 1000 + "x")
        assert text.count("a") == 1000 and "x" in text and len(text) < 3_000_000


def test_tables_whose_spans_multiply_keep_text_in_bounded_space():
    wide = "<tr>" + "".join(f"<td>{'w' * 40}" for _ in range(1001)) + "<tr><td colspan=1000>a<td>b" * 3000
    text = html_text.extract(f"<table>{wide}</table>")
    assert text.count("a | b") == 3000 and text.count("w") == 40_040 and len(text) < 200_000
    held = "<tr>" + "<td rowspan=65534 colspan=1000>a" * 300 + "<tr><td>b" * 3000
    text = html_text.extract(f"<table>{held}</table>")
    assert text.count("a") == 300 and text.count("b") == 3000


def test_a_passage_lies_whole_in_a_window_wherever_it_stands():
    counts = np.array([10, 300, 321])
    owner, first, sizes = gru.windows(counts)
    starts = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        begin, end = first[owner == i] - starts[i], first[owner == i] - starts[i] + sizes[owner == i]
        for at in range(max(1, n - 24)):
            assert ((begin <= at) & (end >= min(n, at + 25))).any()


@pytest.mark.parametrize("scale", [1, 60])
def test_scoring_needs_no_tanh_and_bears_extreme_gates(monkeypatch, scale):
    network = gru.Network.fresh()
    network.weights = {k: v * v.dtype.type(scale) for k, v in network.weights.items()}
    data = np.frombuffer(" ".join(f"w{i * i % 97}" for i in range(300)).encode(), np.uint8)
    words = gru.read_words(data, np.array([0, len(data)]))
    _, first, sizes = gru.windows(words.counts)
    with np.errstate(over="ignore"):
        wanted = network.score_windows(words, gru._laid_out(words, first), sizes)
    monkeypatch.setattr(gru.np, "tanh", None)  # several times the cost of exp
    with np.errstate(all="raise", under="ignore", over="ignore"):
        got = network.score_every(network.embed(words), words.kind)
    assert np.allclose(got, wanted, rtol=1e-3, atol=1e-3 * scale)


def scored_case(n, scale=1):
    network, draw = gru.Network.fresh(), np.random.default_rng(n)
    network.weights = {k: v * v.dtype.type(scale) for k, v in network.weights.items()}
    data = np.frombuffer(" ".join(f"w{k * k}" for k in draw.integers(0, 40, n)).encode(), np.uint8)
    return network, gru.read_words(data, np.array([0, len(data)]))


def test_both_directions_take_one_product_a_step_and_words_are_embedded_once(monkeypatch):
    (_, data, offsets), *_ = text_chunks(pa.array(["a b c", "x y " * 40, "d e"], pa.large_string()), 1 << 20)
    network, words = gru.Network.fresh(), gru.read_words(data, offsets)
    products, embedded, product, embed = [], [], np.matmul, gru.Network.embed
    monkeypatch.setattr(gru.np, "matmul", lambda *a, **k: products.append(1) or product(*a, **k))
    monkeypatch.setattr(gru.Network, "embed", lambda *a: embedded.append(1) or embed(*a))
    network.score_texts(words)
    assert 0 < len(products) <= gru.WINDOW and len(embedded) == 1


@pytest.mark.parametrize("power", [(np.exp, 1.0), (np.exp2, float(np.log2(np.e)))])
@pytest.mark.parametrize("n", [32, 33, 47, 48, 200])
def test_blocks_of_windows_give_what_single_windows_give(monkeypatch, n, power):
    monkeypatch.setattr(gru, "BLOCK", 16)
    monkeypatch.setattr(gru, "_power", lambda: power)
    for scale in (1, 60):
        network, words = scored_case(n, scale)
        _, first, sizes = gru.windows(words.counts)
        with np.errstate(over="ignore"):
            wanted = network.score_windows(words, gru._laid_out(words, first), sizes)
        got = network.score_every(network.embed(words), words.kind)
        np.testing.assert_allclose(got, wanted, rtol=1e-3, atol=1e-4 if scale == 1 else 1e-3 * scale)


def test_words_of_any_length_are_embedded_by_the_mean_of_their_trigrams():
    texts = ["a", "ab abc", "x" * 8 + " " + "y" * 9, "", "Z" * 500 + " z ab AB"]
    (_, data, offsets), *_ = text_chunks(pa.array(texts, pa.large_string()), 1 << 20)
    network, words = gru.Network.fresh(), gru.read_words(data, offsets)
    ends = np.append(words.first_gram, len(words.grams))
    means = [network.weights["gram"][words.grams[a:b]].mean(axis=0) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    np.testing.assert_allclose(network.embed(words), network.weights["word"][words.bucket] + np.array(means), atol=1e-5)
    # lower case makes no other kind, and kinds are numbered by their hashes
    hashes = gru.word_spans(data, offsets)[0]
    assert np.array_equal(words.kind, np.unique(hashes, return_inverse=True)[1]) and words.kind[-1] == words.kind[-2]
