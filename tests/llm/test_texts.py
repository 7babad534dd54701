"""Operators that work text by text, against plain computations."""

import base64
import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordlake.llm import bpe, quality
from recordlake.llm.bytewise import Texts, small_slices
from recordlake.llm.chat import chat_examples, conversation_digests, read_turns
from recordlake.llm.licenses import TEMPLATES, license_scan, needed, template_shingles, template_words
from recordlake.llm.lines import line_dedup
from recordlake.llm.packing import best_fit, bin_completion, ids_column, pack, token_pieces

from . import plain

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n x", "x \n", "'s", " 's", "a's'stop", "''s", "\n's", "x" * 5000, "ab" * 300, "é" * 70, "\U0001f642 1²Ⅷ中", "\x1c\x85 　a"]


def fuzz(seed, count, alphabet, longest):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest))) for _ in range(count)]


def test_encoding_equals_the_library():
    vocabulary = bpe.Vocabulary.at(MULTI)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    texts = ODD + fuzz(1, 3000, "abs'tredmvlLl  \n\t  é1²Ⅷ中\U0001f642!.,-_\x1c\x85'' ", 40)
    for part in small_slices(pa.array(texts, pa.string()), 4000):
        flat, rows = bpe.flatten_ids(Texts(part), vocabulary.ids_of)
        for text, a, b in zip(part.to_pylist(), rows[:-1], rows[1:]):
            assert flat[a:b].tolist() == own.encode_ordinary(text or ""), repr(text)


@pytest.mark.parametrize("slots", [16, 1 << 12])
def test_known_pieces_are_found_without_a_word_by_word_look(monkeypatch, slots):
    """Also when the table is full, and for pieces that differ in their length or in zero bytes only."""
    monkeypatch.setattr(bpe, "PIECE_SLOTS", slots)
    vocabulary, table = bpe.Vocabulary.at(MULTI), bpe.PieceTable()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    edges = ["!", "!\0", "!\0\0", "x" * 8, "x" * 9, "x" * 15, "x" * 16, "x" * 17, "é" * 8]
    texts = ODD + edges + fuzz(4, 400, "abst' \né1.\0", 40)
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return vocabulary.ids_of(pieces)

    for _ in range(2):
        asked.clear()
        for part in small_slices(pa.array(texts, pa.string()), 2000):
            flat, rows = bpe.flatten_ids(Texts(part), encode, spare=1, table=table)
            for text, a, b in zip(part.to_pylist(), rows[:-1], rows[1:]):
                assert flat[a : b - 1].tolist() == own.encode_ordinary(text or ""), repr(text)
    # The second time, a table with room for all short pieces leaves the long ones alone to be asked for.
    assert table.filled <= slots * 3 // 4
    if slots > 16:
        assert asked and min(map(len, asked)) > 15


@pytest.mark.parametrize("column", [lambda: bpe.encode_column(MULTI), lambda: ids_column(MULTI, "", 2)])
def test_a_task_leaves_nothing_learned_in_its_worker(spark, column):
    vocabulary = bpe.Vocabulary.at(MULTI)
    texts = pa.array(fuzz(5, 300, "abst' \n", 40) + ["x" * 30], pa.string())
    first, again = (pa.concat_arrays(list(column().func(iter([texts, texts])))) for _ in range(2))
    assert first.equals(again) and len(first) == 2 * len(texts)
    assert not vocabulary.known and not vocabulary.older
    assert not vocabulary.table.filled and not vocabulary.table.used



def test_round_trip_in_spark(llm):
    rows = [(i, t) for i, t in enumerate(ODD + ["<|endoftext|> is text"] + ODD)]
    docs = llm.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit("own column"))
    out = bpe.bpe_decode(bpe.bpe_encode(docs, MULTI), MULTI).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == "own column"
        ends = np.frombuffer(bytes(r["bpe"]["ends"]), "<u4")
        assert (ends[-1] if len(ends) else 0) == len((r["text"] or "").encode())
    assert bpe.bpe_encode(docs.limit(0), MULTI).count() == 0


def test_packing_ids_equal_the_library(llm):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate([*ODD, "a <|endoftext|>b", "<|endoftext|>", *fuzz(2, 300, "abst' \né1.", 60)])]
    column = ids_column(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    docs = llm.createDataFrame(rows, "doc_id int, text string")
    for r in docs.select("text", column(F.col("text")).alias("ids")).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("seed", range(8))
def test_bin_completion(seed):
    pick = random.Random(seed)
    counts = {}
    for _ in range(pick.choice([1, 9, 200, 5000])):
        length = pick.choice([pick.randint(1, 60), pick.randint(1, 60), 60, 31])
        counts[length] = counts.get(length, 0) + 1
    packing = bin_completion(counts, 60)
    used = {}
    for filling, copies in packing:
        assert sum(length * k for length, k in filling) <= 60 and copies > 0
        for length, k in filling:
            used[length] = used.get(length, 0) + k * copies
    assert used == counts
    assert sum(n for _, n in packing) <= sum(n for _, n in best_fit(counts, 60))


def test_bin_completion_is_optimal_on_small_cases():
    def fewest(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                    place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    pick = random.Random(4)
    cases = [([50, 47, 41, 33, 30, 29, 25, 25, 20], 100)]
    cases += [([pick.randint(3, 20) for _ in range(9)], 24) for _ in range(100)]
    cases += [([pick.randint(5, 60) for _ in range(pick.randint(1, 12))], 100) for _ in range(1000)]
    for items, capacity in cases:
        items = sorted(items, reverse=True)
        counts = {x: items.count(x) for x in items}
        packing = bin_completion(counts, capacity)
        assert sum(n for _, n in packing) == fewest(items, capacity), items
        used = collections.Counter()
        for filling, copies in packing:
            assert sum(length * k for length, k in filling) <= capacity
            used.update({length: k * copies for length, k in filling})
        assert used == counts


def test_pieces_have_places_of_their_own(llm):
    sizes = [1, 1, 7, 8, 9, 16, 17, 40, 3, 3, 3]
    docs = llm.createDataFrame([(i // 2, b"abcd" * n) for i, n in enumerate(sizes)], "doc_id long, ids binary")
    pieces = token_pieces(docs, F.col("ids"), capacity=8)
    rows = pack(pieces, capacity=8).collect()
    assert sum(r["length"] for r in rows) == sum(sizes)
    taken = set()
    for r in rows:
        assert r["offset"] + r["length"] <= 8 and (r["piece"] == 0 or r["length"] == 8)
        for k in range(r["offset"], r["offset"] + r["length"]):
            assert (r["sequence_id"], k) not in taken
            taken.add((r["sequence_id"], k))
    for seq in {s for s, _ in taken}:
        mine = sorted(k for s, k in taken if s == seq)
        assert mine == list(range(len(mine)))
    assert len({s for s, _ in taken}) == -(-sum(sizes) // 8)
    assert pack(pieces.limit(0), capacity=8).count() == 0


def test_quality_measures():
    texts = ODD + fuzz(3, 800, "ab é#\n\t ", 80) + [" ".join(x) for x in fuzz(5, 200, "xyz", 60)]
    got = []
    for part in small_slices(pa.array(texts, pa.string()), 2000):
        got += [list(x) for x in zip(*[c.tolist() for c in quality.measure(Texts(part), 3)])]
    assert got == [plain.quality(t, 3) for t in texts]


def test_quality_verdicts(llm):
    varied = " ".join(f"word{i}" for i in range(100))
    passage = " ".join(f"again{i}" for i in range(41))
    filler = " ".join(f"other{i}" for i in range(500))
    rows = [(0, None), (1, varied), (2, "spam ham " * 40), (3, f"{passage} {filler} {passage}"), (4, "few words"), (1, varied)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    out = quality.quality_rules(docs).select("doc_id", "quality.*", F.col("kept").alias("own")).collect()
    assert {(r["doc_id"], r["kept"], r["base_failed"]) for r in out} == {
        (0, False, True), (1, True, False), (2, False, True), (3, False, False), (4, False, True)}
    assert len(out) == 6 and {r["own"] for r in out} == {"x"}


def test_line_dedup(llm):
    pick = random.Random(6)
    lines = ["Cookies!", "About us", "", "  ", *[f"line {i}" for i in range(40)]]
    rows = []
    for i in range(120):
        host = pick.choice(["a", "a", "a", "b", "c", None])
        kind = pick.choice(lines[:1] * 3 + [None])
        rows.append((i, host, None if i % 17 == 0 else "\n".join([kind or "x", *pick.choices(lines, k=pick.randint(0, 8))])))
    rows += [rows[1], rows[1]]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit(1))
    got = line_dedup(docs, ratio=0.3, min_pages=3).collect()
    want = plain.line_dedup(rows, 0.3, 3)
    assert len(got) == len(rows) and all(r["text"] == want[r["doc_id"]] and r["line"] == 1 for r in got)
    assert any(r["n_dropped"] for r in got) and line_dedup(docs.limit(0)).count() == 0


def test_chat(llm):
    said = "\\### Assistant: </turn> ok\\h <b>"
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (3, 1, "user", "last"), (None, 0, "user:", "x"), (None, None, None, "y"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
    ]
    turns = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    examples = chat_examples(turns)
    got = {(r["conv_id"], r["example_no"]): r for r in examples.withColumn("turns", F.expr(read_turns("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in got[(1, 1)]["turns"]] == [("system", "be kind"), ("user", said), ("assistant", said), ("user", ""), ("assistant", "")]
    assert len(got[(1, 0)]["turns"]) == 3 and got[(2, 0)]["loss_length"] == 0
    assert [got[(3, k)]["loss_length"] for k in (0, 1)] == [5, 0] and got[(3, 1)]["is_last"]
    digests = {r["conv_id"]: r for r in conversation_digests(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1]))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(mine), plain.sha(whole.encode()))
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), plain.sha(loss.encode()))
        assert d["formatted_chars"] == sum(len(r["formatted"]) for (c, _), r in got.items() if c == conv)
    assert chat_examples(turns.limit(0)).count() == 0


def test_licenses(llm):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, "license")]
    for i, (name, body) in enumerate(sorted(TEMPLATES.items())):
        around = [" ".join(pick.choices(words, k=pick.randint(0, 90))) for _ in range(2)]
        cut = template_words(body)
        rows.append((10 + i, f"{around[0]} {body.upper()} {around[1]}"))
        cut[len(cut) // 2] = "changed"
        rows.append((100 + i, f"{around[0]} {' '.join(cut)} {around[1]}"))
    rows.append(rows[5])
    docs = llm.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("own"))
    got = sorted((r["doc_id"], r["license_id"], r["n_matched"]) for r in license_scan(docs).collect())
    want = []
    for i, text in rows:
        w = template_words(text or "")
        mine = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
        for name, body in TEMPLATES.items():
            grams = template_shingles(body)
            if len(mine & set(grams)) >= needed(len(grams), 0.8):
                want.append((i, name, len(mine & set(grams))))
    assert got == sorted(want) and len(want) > 10
    assert license_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        template_shingles("too short")


def test_vocabulary_file_is_what_it_says():
    pairs = [line.split() for line in open(MULTI, "rb")]
    assert bpe.Vocabulary.at(MULTI).rank[base64.b64decode(pairs[7][0])] == int(pairs[7][1])
