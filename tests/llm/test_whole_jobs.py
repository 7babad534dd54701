"""Cases in which an operator once did less than its whole job."""

import pathlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import jaccard, neighbours, substrings, wrappers
from recordlake.plans.stages import run_folder

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(pick, n):
    return " ".join(f"{pick.choice('bcdfg')}{pick.choice('aeiou')}{pick.randint(0, 9999)}" for _ in range(n))


def test_one_of_many_copies_stays_whole(llm, tmp_path):
    """A third of a source's rows are copies of one text: it is left once, and whole."""
    pick = random.Random(21)
    copied = "\n".join(prose(pick, 12) for _ in range(5))
    texts = [copied] * 30 + ["Share this page\n" + "\n".join(prose(pick, 12) for _ in range(4)) for _ in range(60)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    docs = llm.createDataFrame(rows, DOCUMENTS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(llm, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = llm.read.parquet(str(tmp_path / str(k)))
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {0: copied} | {i: texts[i].split("\n", 1)[1] for i in range(30, 90)}


def test_near_copies_of_the_pipeline(llm, tmp_path):
    """Shingles of five words: similarities of 0.80 to 0.84 link, less does not."""
    pick = random.Random(22)
    rows = []
    for added in (0.84, 0.82, 0.80, 0.79):
        base = prose(pick, 204)  # 200 shingles
        rows += [base, f"{base} {prose(pick, -(-200 * 100 // round(100 * added)) - 200 - (added >= 0.8))}"]
    base = prose(pick, 204)
    rows += [base, " ".join(base.split()[:164]), " ".join(base.split()[10:172])]  # 160 and 158 shingles
    docs = llm.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(rows)], DOCUMENTS)
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(llm, docs, str(tmp_path)).collect()}
    assert got == {0, 2, 4, 6, 7, 8}


@pytest.mark.parametrize("case", ["near copies", "huge norms"])
def test_neighbours_of_vectors_that_differ_little(llm, case):
    """A third of the rows within a hundredth of one another; a few rows a million times as long as the others."""
    rng = np.random.default_rng(8)
    points = rng.standard_normal((2400, 16))
    if case == "near copies":
        points[::3] = points[0] + 0.003 * rng.standard_normal((800, 16))
    else:
        points[5:8] *= 1e6
    points = points.astype(np.float32)
    frame = llm.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(frame, F.col("vec_id") % 60 == 0).collect()
    exact, hits = points.astype(np.float64), 0
    for q in range(0, 2400, 60):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        mine = {r["vec_id"] for r in got if r["query_id"] == q}
        assert len(mine) == 10
        hits += len(mine & {*[int(i) for i in np.argsort(d) if i != q][:10]})
    assert hits >= 0.95 * 400


@pytest.mark.parametrize("around", ["div class='layout has-sidebar'", "div class=page-header-fixed", "div id=no-comments", "form", "div class=banner"])
@pytest.mark.parametrize("main", ["article", "main", "div class=content"])
def test_article_in_an_element_named_like_a_part(around, main):
    if around == "div class=banner" and main == "div class=content":
        return  # neither an article nor a longer name tells it from a banner
    html = (
        f"<body><div class=ad><p>Buy</p></div><{around}><{main}><p>The first paragraph.</p><p>The second one.</p></{main.split()[0]}>"
        f"<div class=sidebar><p>Links</p></div></{around.split()[0]}><section id=comments><article class=comment><p>Nice!</p></article></section>"
    )
    assert wrappers.extract(html, None) == "The first paragraph.\nThe second one."


@pytest.mark.parametrize("main", ["article", "div class=entry"])
def test_sibling_articles_are_joined(main):
    part = f"<{main}><p>{{}}</p></{main.split()[0]}>"
    html = f"<body><nav>x</nav><div>{part.format('One.')}<aside>y</aside>{part.format('Number two.')}</div>"
    assert wrappers.extract(html, None) == "One.\nNumber two."


def test_a_part_stays_a_part():
    long = "<p>" + "A long discussion. " * 9 + "</p>"
    html = f"<body><article><p>Text.</p><div class=share-bar>Share!</div></article><div class=comments>{long}</div><div class=related-posts>{long}</div>"
    assert wrappers.extract(html, None) == "Text."


def test_a_form_around_a_page_without_paragraphs():
    assert wrappers.extract("<body><form><div>All of the text</div></form>", None) == "All of the text"


def shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (blocks.apply(i).toString() for i in range(blocks.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("operator", [jaccard.jaccard_groups, substrings.suffix_dedup])
def test_disk_holds_the_shuffles_of_one_step(llm, operator):
    """Shuffle files and tables of a step go when nothing reads them any more, however seldom the driver collects garbage."""
    pick = random.Random(31)
    texts = [prose(pick, 40) for _ in range(40)]
    docs = llm.createDataFrame([(i, f"{t} {pick.choice(texts)}", "en", "s", 1) for i, t in enumerate(texts * 2)], DOCUMENTS).repartition(3)
    root = pathlib.Path(run_folder(llm).removeprefix("file:"))
    tables, before = {p.name for p in root.glob("*")}, shuffles(llm)
    result = operator(docs)
    for _ in range(100):  # they are removed in the background
        left = shuffles(llm) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    stay = {p.name.rpartition("-")[0] for p in root.glob("*") if p.name not in tables}
    assert stay <= {"sets", "components", "links", "wide", "labels", "finer", "runs"}
    assert result.count() == 80


def test_what_a_stage_has_read_goes(llm, tmp_path, monkeypatch):
    root = pathlib.Path(run_folder(llm).removeprefix("file:"))
    seen = []

    def stage(name):
        def run(spark, docs, sf_dir):
            seen.append({p.name.rpartition("-")[0] for p in root.glob("stage-*")})
            return docs.select("doc_id", (F.col("n_chars") + 1).alias("n_chars"))

        return name, run

    llm.createDataFrame([(1, "a", "en", "s", 1)], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(f"stage {k}") for k in range(4)])
    assert [tuple(r) for r in corpus_pipeline.run(llm, str(tmp_path)).collect()] == [(1, 5)]
    assert seen == [set(), {"stage-0"}, {"stage-1"}, {"stage-2"}]


def test_phrases_shorter_than_a_string_send_nothing():
    """Two sides of an anchor tell strings apart: a common phrase of 20 bytes is not looked at, one of 50 is in any place."""
    pick = random.Random(32)

    def shared(phrase):
        rows = []
        for i in range(40):
            text = f"{prose(pick, 6)}{phrase}{prose(pick, 6)}"
            batch = pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text])], names=["doc", "text"])
            rows += list(substrings.find_anchors(50)(iter([batch])))
        table = pa.Table.from_batches(rows).sort_by([("key", "ascending"), ("doc", "ascending")])
        return {d for b in substrings.keep_shared(iter(table.to_batches(max_chunksize=7))) for d in b.column(0).to_pylist()}

    for _ in range(5):
        assert shared(prose(pick, 20)[:20]) == set()
        assert shared(prose(pick, 20)[:50]) == set(range(40))


def test_common_passages_make_no_cluster(llm, monkeypatch):
    """Each text has three of twelve passages, and more of its own than a link allows: nothing is searched but true near copies."""
    pick = random.Random(33)
    passages = [prose(pick, 60) for _ in range(12)]
    texts = [" ".join([*pick.sample(passages, 3), prose(pick, 50)]) for _ in range(90)]
    texts += [f"{t} and more" for t in texts[:3]]
    docs = llm.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS).repartition(3)
    largest, join = [], jaccard._join_blocks

    def spy(sets, found, percent):
        largest.append(sets.groupBy("cluster").count().agg(F.max("count")).first()[0])
        return join(sets, found, percent)

    monkeypatch.setattr(jaccard, "_join_blocks", spy)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs, size=5, percent=80).collect()}
    assert got == {i: i if i < 90 else i - 90 for i in range(93)}
    assert largest == [2]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_shingles_are_counted_across_batches(monkeypatch, size):
    monkeypatch.setattr(jaccard, "COMMON", 4)
    pick = random.Random(34)
    counts = [pick.choice([1, 1, 2, 3, 4, 5, 12]) for _ in range(80)]
    rows = [(k - 40, d) for k, n in enumerate(counts) for d in range(n)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["key", "doc"])
        for i in range(0, len(rows), size)
    ]
    got = [r for b in jaccard.common_shingles(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == sorted((d, min(4, counts[k + 40]), k) for k, d in rows if counts[k + 40] > 1)
