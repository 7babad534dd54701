"""Operators that compare rows, and the pipeline, against plain computations."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import jaccard, neighbours, substrings, wrappers

from . import plain

TEXTS = "doc_id long, text string"


def near_copies(seed, families):
    pick = random.Random(seed)
    out = [None, "", " \n", "One two", "one TWO", "a b c d", "A b\tc  d"]
    for _ in range(families):
        base = [f"{pick.choice('abcdef')}{pick.randint(0, 300)}" for _ in range(pick.choice([3, 5, 8, 12, 25, 60, 150]))]
        for _ in range(pick.randint(1, 9)):
            words = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 3])):
                words[pick.randrange(len(words))] = f"Z{pick.randint(0, 999)}"
            out.append(" ".join(words))
    pick.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [600_000, 120])
def test_jaccard_groups(llm, monkeypatch, block):
    """One block for each cluster, and clusters in many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = near_copies(1, 25)
    docs = llm.createDataFrame(rows + rows[3:6] + [(None, "a b c d")], TEXTS).withColumn("label", F.lit(1)).repartition(4)
    got = jaccard.jaccard_groups(docs).collect()
    want = plain.groups(rows)
    assert len(got) == len(rows) + 4 and sum(i != c for i, (_, c) in want.items()) > 15
    for r in got:
        expected = (1, None) if r["doc_id"] is None else want[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == expected


def test_jaccard_of_nothing(llm):
    assert jaccard.jaccard_groups(llm.createDataFrame([], TEXTS)).count() == 0


PASSAGE = "This passage of text is longer than fifty bytes, it stands in many documents. "


def repeats(seed, count):
    pick = random.Random(seed)

    def noise(n):
        return "".join(pick.choice("abcdé f") for _ in range(pick.randint(0, n)))

    odd = [None, "", "a" * 200, "ab" * 90, PASSAGE * 3]
    return [(i, pick.choice(odd) if i % 7 == 0 else noise(60) + PASSAGE[: pick.randint(40, 78)] + noise(90)) for i in range(count)]


@pytest.mark.parametrize("block, gram", [(60_000, 200_000), (20, 30)])
def test_suffix_dedup(llm, monkeypatch, block, gram):
    """Whole grams in a block, and grams that are too common for one."""
    shard = substrings.sort_shard

    def small(length):
        def run(batches):
            substrings.BLOCK_ROWS, substrings.GRAM_ROWS = block, gram
            return shard(length)(batches)

        return run

    monkeypatch.setattr(substrings, "sort_shard", small)
    rows = repeats(2, 160)
    docs = llm.createDataFrame(rows + rows[8:10] + [(None, PASSAGE * 2)], TEXTS).withColumn("first", F.lit(1)).repartition(3)
    got = substrings.suffix_dedup(docs).collect()
    want = plain.without_repeats(rows)
    assert len(got) == len(rows) + 3 and sum(w[1] > 0 for w in want.values()) > 60
    for r in got:
        d = r["deduped"]
        if r["doc_id"] is None:
            assert d["n_removed"] == 0
        else:
            assert (d["n_bytes"], d["n_removed"], d["n_spans"], bytes(d["kept"] or b"")) == want[r["doc_id"]]
            assert (d["kept"] is None) == (r["text"] is None)
    assert substrings.suffix_dedup(docs.limit(0)).count() == 0


def test_grams_are_hashed_from_their_bytes(monkeypatch):
    """Cuts and anchors need no running polynomials, and do not depend on the blocks they are found in."""
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 101, 300, np.uint8))
    texts = [None, b"", b"x" * 49, b"\0" * 130, passage, b"ab" + passage[20:250], bytes(rng.integers(97, 123, 5000, np.uint8)), b"x" * 50]
    column = pa.array([None if t is None else t.decode() for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), column], names=["doc", "text"])

    def refuse(*_):
        raise AssertionError("polynomials of every position")

    def found():
        made = substrings.Anchored(substrings.Texts(column), 50)
        return [x.tolist() for x in (made.row, made.at, made.first, made.last, made.key)]

    monkeypatch.setattr(substrings, "Hashes", refuse)
    whole, cuts = found(), [list(substrings.find_cuts(50)(iter([batch]))), list(substrings.find_anchors(50)(iter([batch])))]
    # Every string of 50 bytes of every text lies under one anchor inside it.
    strings = [(r, p) for r, _, first, last, _ in zip(*whole) for p in range(first, last + 1)]
    bounds = np.cumsum([0, *[len(t or b"") for t in texts]])
    assert sorted(strings) == [(r, p) for r, t in enumerate(texts) for p in range(bounds[r], bounds[r] + len(t or b"") - 49)]
    assert all(first <= at <= first + 34 and last <= at <= last + 34 for _, at, first, last, _ in zip(*whole))
    for block in (1, 7, 64):
        monkeypatch.setattr(substrings, "HASH_BLOCK", block)
        assert found() == whole
        assert [list(substrings.find_cuts(50)(iter([batch]))), list(substrings.find_anchors(50)(iter([batch])))] == cuts


def test_induced_sorting_equals_comparison():
    pick = random.Random(3)
    strings = ["".join(pick.choice("ab") for _ in range(30)) for _ in range(120)]
    n, length = len(strings), 12
    at = np.array([pick.randint(0, 9) for _ in range(n)])
    # One anchor: strings agree at equal distances from it.
    key, doc = np.zeros(n, np.int64), np.array([pick.randint(0, 40) for _ in range(n)])
    first, last = np.zeros(n, np.int64), np.minimum(at, 30 - length)
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    rows, starts = substrings.equal_strings(key, doc, at, first, last, data, np.arange(n + 1) * 30, length)
    least = {}
    for i in range(n):
        for p in range(last[i] + 1):
            k = (at[i] - p, strings[i][p : p + length])
            least[k] = min(least.get(k, 99), doc[i])
    want = {(i, p) for i in range(n) for p in range(last[i] + 1) if doc[i] > least[(at[i] - p, strings[i][p : p + length])]}
    assert set(zip(rows.tolist(), starts.tolist())) == want and want


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>if (a < b) "</p>"</script></head><body class=home>
<header>Site <a href=/>home</a></header><nav><ul><li>x<li>y</ul></nav><div class="ad top">Buy {i}</div>
<article><header><h1>Title&nbsp;{i} &amp; more</h1></header><p>First {i}
line<p>Second <b>bold</b>{i}<br>third<div class=share-bar>Share!</div><p>Read our terms.<aside>side</aside>
<ul><li>one {i}<li>two</ul><table><tr><td>a<td>b{i}</table></article>
<section id=comments><article class=comment>Nice!</article></section><form>mail</form><footer>&copy; {i}</footer>"""


def test_main_text(llm):
    pages = [(i, f"https://host.test/p{i}", PAGE.format(i=i)) for i in range(6)]
    pages += [(6, "https://lone.test/", PAGE.format(i=6)), (7, None, PAGE.format(i=7)), (8, "https://host.test/", None), (9, "x", "")]
    pages += [(10, "https://plain.test/", "just <i>text</i> &lt;3"), pages[0]]
    frame = llm.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("own"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(frame).collect()}

    def body(i, terms, item):
        return "\n".join([f"Title {i} & more", f"First {i} line", f"Second bold{i}", "third", *terms, f"one {i}", *item, f"a b{i}"])

    # What all pages of a host say in a place is template; one page alone teaches nothing.
    assert all(got[i] == body(i, [], []) for i in range(6))
    assert all(got[i] == body(i, ["Read our terms."], ["two"]) for i in (6, 7))
    assert (got[8], got[9], got[10]) == ("", "", "just text <3")
    assert wrappers.extract_main_text(frame.limit(0)).count() == 0


def test_tree_matching():
    def texts(*prints):
        return {str(p): [1, [p]] for p in prints}

    a = ["body", 1, texts(1), [["h1", 1, texts(2), []], ["p", 1, texts(3, 4), [["b", 1, texts(5), []]]]]]
    b = ["body", 1, texts(1), [["div.x", 1, texts(9), []], ["p", 1, texts(4, 7), [["b", 1, texts(6), []]]]]]
    assert wrappers.match(a, b, {}) == 3
    folded = wrappers.fold(a, b, {})
    assert [k[0] for k in folded[3]] == ["div.x", "h1", "p"] and folded[3][2][1:3] == [2, {"3": [1, [3]], "4": [2, [4]], "7": [1, [7]]}]
    assert wrappers.match(folded, a, {}) == 4


def taught(pages):
    wrapper = None
    for page in pages:
        wrapper = wrappers.fold_all(wrapper, wrappers.learn(page))
    return {**wrapper, "tree": wrappers.templates(wrapper["tree"])}


def article(i, more=""):
    return f"<body><article><h1>Title {i}</h1><p>Text number {i} of this page.</p>{more}<p>Its end, {i}.</p></article>"


def test_blocks_of_the_copies_of_one_article_stay():
    copy = article(99, "<blockquote>A quotation only this article has.</blockquote><table><tr><td>cell</table>")
    wrapper = taught([article(i) for i in range(6)] + [copy, copy])
    assert wrappers.extract(copy, wrapper).split("\n") == ["Title 99", "Text number 99 of this page.", "A quotation only this article has.", "cell", "Its end, 99."]


def test_notice_on_nearly_all_pages_is_template():
    notice = "<div class=x17>We have moved to another house.</div>"
    wrapper = taught([article(i, notice if i != 50 else "") for i in range(100)])
    assert wrappers.extract(article(3, notice), wrapper) == "Title 3\nText number 3 of this page.\nIts end, 3."
    half = taught([article(i, notice if i % 2 else "<div class=x17>Other</div>") for i in range(100)])
    assert "We have moved" in wrappers.extract(article(3, notice), half)


@pytest.mark.parametrize("depth", [100, 1200, 100_000])
def test_deep_nesting(depth):
    page = "<body><article><p>Before.</p>" + "<div>" * depth + "In the deep.<p>Its second.</p><nav><ul><li>menu</ul></nav>end" + "</div>" * depth + "<p>After.</p></article>"
    assert wrappers.extract(page, taught([page] + [article(i) for i in range(5)])) == "Before.\nIn the deep.\nIts second.\nend\nAfter."


@pytest.mark.parametrize("piece", ['<a "b ', "<a 'b ", "<a \"b' > ", "<", "<!-", "<a href='x\" "])
def test_unclosed_quotes_are_linear(piece):
    start = time.perf_counter()
    wrappers.extract("<body><p>Text.</p>" + piece * (1_000_000 // len(piece)), None)
    assert time.perf_counter() - start < 20


def test_texts_below_the_deepest_level_are_linear(monkeypatch):
    """Whether a deep text is hidden is told by its element, not by all elements around it."""
    asked = []
    own = wrappers.is_part
    monkeypatch.setattr(wrappers, "is_part", lambda node, inside: asked.append(node) or own(node, inside))
    deep = wrappers.DEEPEST + 200
    page = "<body>" + "<b>" * deep + "one <nav>two <b>three</b></nav> four<div> five</div>" + "<b> x" * 2000
    root = wrappers.read_page(page)
    assert len(asked) < 3 * (deep + 2000)
    texts = []

    def walk(node, hidden):
        for kid in node.kids:
            if isinstance(kid, str):
                texts.append((kid, hidden))
            else:
                walk(kid, hidden or kid.hidden)

    walk(root, False)
    assert texts[:5] == [("one ", False), ("two ", True), ("three", True), (" four", False), (" five", False)]


def test_many_sibling_articles():
    page = "<body><div>" + "".join(f"<article><p>Part {i}.</p></article>" for i in range(1000)) + "</div>"
    wrapper = taught([page] + [page.replace("Part", w) for w in ("Bit", "Piece", "Share")])
    start = time.perf_counter()
    assert wrappers.extract(page, wrapper).count("\n") == 999
    assert time.perf_counter() - start < 5


VECTORS = "vec_id long, embedding array<float>"


def test_neighbours_recall_and_scores(llm):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    points = (centres[rng.integers(0, 12, 900)] + 0.6 * rng.standard_normal((900, 24))).astype(np.float32)
    points[300:340] = points[300]  # copies
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] + [1.0] * 23), (1004, [1.0] * 3), (None, rows[5][1])]
    frame = llm.createDataFrame(rows + odd + rows[7:9], VECTORS).withColumn("rank", F.lit(0))
    got = neighbours.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).collect()
    exact, hits = points.astype(np.float64), 0
    for q in range(0, 900, 20):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert np.allclose([s for *_, s in mine], [d[v] for _, v, _ in mine], rtol=1e-12, atol=0)
        hits += len(set(want) & {v for _, v, _ in mine})
    assert {r["query_id"] for r in got} == set(range(0, 900, 20)) and hits >= 0.95 * 450
    copies = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 320), key=lambda r: r["rank"])]
    assert copies == [*range(300, 310)]


def test_few_neighbours(llm):
    frame = llm.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])], VECTORS)
    got = neighbours.nearest_neighbours(frame, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 2.0)]
    assert neighbours.nearest_neighbours(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline(llm, tmp_path):
    """All stages against plain ones, with planted copies, passages, boilerplate and junk."""
    from tokenizers import Tokenizer

    pick = random.Random(11)
    words = [f"{a}{b}{c}é" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]

    def prose(n):
        return " ".join(pick.choice(words) + str(pick.randint(0, 99)) for _ in range(n))

    passage, rows = prose(60), []
    for i in range(90):
        text = "\n".join(prose(pick.randint(8, 40)) for _ in range(pick.randint(2, 5)))
        if i % 6 == 0:
            text = f"{text} {passage}" if i % 12 else f"{passage[5:]} {text}"
        if i % 4 == 0:
            text = f"Share this page with everybody\n{text}"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(200 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(5)]
    rows += [(300, rows[7][1].replace("a", "á", 1), "en", "src1", 1), (301, None, "en", None, None), (302, "spam eggs " * 90, "en", "src2", 1), (303, "hi", "en", "src2", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    llm.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    ratio, pages = corpus_pipeline.LINE_RATIO, corpus_pipeline.LINE_PAGES
    kept = []
    for i, text, _, host, _ in rows:
        n, _, _, _, repeat, covered, longest = plain.quality(text, 3)
        if not (n < 10 or 100 * repeat > 20 * n) and covered <= 0.25 * n and longest <= 40:
            kept.append((i, host, text))
    lines = plain.line_dedup(kept, ratio, pages)
    component = plain.groups(list(lines.items()))
    single = [(i, t) for i, t in lines.items() if component[i][1] == i]
    left = {i: k[3].decode("utf-8", "ignore") for i, k in plain.without_repeats(single).items()}
    assert len(kept) < len(rows) and len(single) < len(lines) < len(rows) and any(left[i] != t for i, t in single)

    docs = llm.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(llm, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = llm.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == [{i: t for i, _, t in kept}, lines, dict(single), left][k], name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(llm, str(tmp_path)).collect()
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    totals = {}
    for r in packed:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert totals == sizes and len({r["sequence_id"] for r in packed}) == -(-sum(sizes.values()) // 1024)
