"""Merkle manifest, prefix trie and sentence pieces against plain computations and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from recordlake.llm import merkle, queries, trie
from recordlake.llm.bytewise import Hashes, Texts, distinct_slices
from recordlake.llm.pieces import CharacterMap, PieceModel, _fields, piece_decode, piece_encode

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_manifest(rows):
    """Rows of op11 for (doc_id, source, lang, n_chars, text)."""

    def climb(level):
        """Digest of the top, and for every place of the level its siblings, level by level, as (left, right)."""
        paths = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for i, place in enumerate(at):
                run = level[place // 16 * 16 : place // 16 * 16 + 16]
                paths[i].append((run[: place % 16], run[place % 16 + 1 :]))
                at[i] = place // 16
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], paths

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inside = {}
    for source in order:
        leaves = sorted(by_source[source], key=lambda x: x[:3])
        inside[source] = leaves, *climb([x[2] for x in leaves])
    root, above = climb([inside[s][1] for s in order])
    out = []
    for spot, source in enumerate(order):
        leaves, subroot, paths = inside[source]
        for (_, _, leaf, row), path in zip(leaves, paths):
            text, whole = row[4], path + above[spot]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            fold = leaf_of(row, text)
            for left, right in whole:
                fold = sha("".join([*left, fold, *right]))
            proof = sha("".join(d for left, right in whole for d in [*left, *right]))
            out.append((row[0], leaf, subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


SIZES = [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"a": 300, None: 2, "": 3, "ä": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}]


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_manifest(llm, sizes):
    pick, rows = random.Random(5), []
    for source, n in sizes.items():
        for _ in range(n):
            i = pick.choice([None, pick.randint(-5, 40), pick.randint(0, 10_000)])
            text = pick.choice([None, "", "Ab", "é Ünï\nX", "A" * 3000])
            rows.append((i, source, pick.choice([None, "en"]), pick.choice([None, 3]), text))
    rows += rows[:1]  # a repeated row
    docs = llm.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, leaf string")
    got = queries.op11_merkle_manifest(docs)
    assert got.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_nothing(llm):
    docs = llm.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert queries.op11_merkle_manifest(docs).count() == 0
    leaves = docs.select("doc_id", "source", F.lit(b"").alias("leaf"))
    assert merkle.merkle_manifest(leaves, group="source", order="doc_id", digest="leaf").root is None


def test_records_are_named_by_their_content(llm):
    rows = [(i, "s" if i < 40 else "t") for i in range(80)]
    docs = llm.createDataFrame(rows, "doc_id long, source string").withColumn("leaf", F.expr("unhex(sha2(CAST(doc_id % 40 AS STRING), 256))"))
    manifest = merkle.merkle_manifest(docs, group="source", order="doc_id", digest="leaf")
    level = manifest.below[0]
    assert level.count() == 6 and level.select("digest").distinct().count() == 3
    for r in level.collect():
        whole = b"".join(bytes(c) for c in r["children"]).hex()
        assert bytes(r["digest"]) == hashlib.sha256(whole.encode()).digest()
    # A few requests alone find the same path as among all.
    some = manifest.leaves.filter("place IN (0, 17, 39)")
    starts = manifest.groups.select("key", "n", "digest", F.expr(merkle._EMPTY_PATH).alias("path"))
    for r in merkle.descend(starts, manifest.below, some).select("leaf", "top", F.expr(f"lower(hex({merkle.folded('leaf', 'reverse(path)')}))").alias("f")).collect():
        assert r["f"] == bytes(r["top"]).hex()


# Prefix trie


def plain_trie(rows, shared=True):
    """Rows of op13 for (conv_id, turn, role, text)."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, said, (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4 if shared else 0
        built[conv] = turns.get(conv - conv % 20, [])[:h] + own[h:]
    members = {}
    for conv, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        has_child = {n[:-1] for n in below if n}
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(1 for n in below if len(n) == len(node) + 1), sum(1 for n in below if n not in has_child),
            sum((len(members[n]) - 1) * words(n) for n in below), sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


def conversations(seed):
    pick = random.Random(seed)
    rows = []
    for conv in pick.sample(range(130), 70):
        for turn in range(pick.choice([1, 1, 2, 4, 9])):
            text = pick.choice([None, "", "hello there", "a b\tc", "again"]) if turn < 2 else f"{pick.randint(0, 2)} words"
            rows.append((conv, pick.choice([turn, turn, None]), pick.choice([None, "user"]), text))
    rows += [r for r in rows if r[0] % 7 == 0]  # repeated rows are turns of their own
    return rows + [(None, 1, "user", "belongs to none")]


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


@pytest.mark.parametrize("seed", range(2))
def test_trie(llm, seed):
    rows = conversations(seed)
    table = llm.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", key string")
    got = queries.op13_prefix_trie(table)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_trie_goes_on_block_by_block(llm):
    rows = [(c, t, "user", "same words here") for c, n in ((3, 70), (5, 70), (9, 33)) for t in range(n)]
    # Every conversation ends one turn later than the one before, so a chain has as many smallest members as nodes.
    rows += [(c, t, "user", f"stair {t}") for c in range(100, 140) for t in range(c - 99)]
    turns = trie.numbered_turns(llm.createDataFrame(rows, SCHEMA))
    convs = turns.filter("pos = 0").select("conv_id", "n")
    got = trie.prefix_trie(turns.select("conv_id", "pos", "said", "words"), convs, block=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows, shared=False)


def test_trie_of_little(llm):
    empty = llm.createDataFrame([], SCHEMA)
    assert queries.op13_prefix_trie(empty).count() == 0
    # 22 takes over turns of 20, which is absent; with no turn of its own left it is a member of the root.
    rows = [(22, 0, "user", "gone")]
    assert zlib.crc32(b"22") % 4 > 0
    got = queries.op13_prefix_trie(llm.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == plain_trie(rows) == [(22, 0, None, 1, 0, 1, 0, sha("22"))]


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar"])
def test_totals_by_contraction(llm, shape):
    pick, n = random.Random(7), 240
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"path": i - 1, "star": 0, "random": pick.randint(max(0, i - 9), i - 1), "caterpillar": i - 1 if i % 2 else max(i - 2, 0)}[shape]
    depth, own = {0: 0}, {i: pick.randint(0, 9) for i in parent}
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    total = dict(own)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    # A mark is shared along a path: the largest leaf below.
    mark = {i: i for i in parent}
    for i in range(n - 1, 0, -1):
        mark[parent[i]] = max(mark[parent[i]], mark[i])
    kids = {i: sum(1 for p in parent.values() if p == i) for i in parent}
    rows = [(i, parent[i], depth[i], mark[i], kids[i], own[i]) for i in parent]
    tree = llm.createDataFrame(rows, "id long, parent long, depth long, mark long, n_children long, value long")
    got = trie.subtree_totals(tree, ["value"], block=16)
    assert {r["id"]: r["value"] for r in got.collect()} == total


# Sentence pieces

HARD = [
    None, "", " ", "  a  b ", *["x" + " " * k + "y" for k in range(40)], *[" " * k for k in range(40)], "▁a▁ b", "\x00\n\t",
    "a" * 3000, "the" * 900, "é\U0001f600" * 300, "漢字" * 700, "<s> </s> <unk> <0x41>", "​\xa0 x",
]


def fuzzed(seed, count, alphabet=" ▁aeé\n\t\U0001f600漢ñ.,1́\x00the in er "):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randrange(50))) for _ in range(count)]


def test_pieces_equal_the_library_with_spans():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel.at(PIECES)
    texts = HARD + fuzzed(1, 1500)
    ids, starts, ends, rows = model.encode(Texts(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, rows[:-1], rows[1:]):
        want = library.encode(text or "", return_type="proto").pieces
        assert ids[a:b].tolist() == [p.id for p in want], repr(text)
        assert list(zip(starts[a:b].tolist(), ends[a:b].tolist())) == [(p.begin, p.end) for p in want], repr(text)


def test_decoding_equals_the_library():
    library, model, pick = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel.at(PIECES), random.Random(3)
    rows = [[pick.choice([pick.randrange(32000), pick.randrange(300)]) for _ in range(pick.randrange(10))] for _ in range(2000)]
    flat = np.array([i for r in rows for i in r])
    data, bounds = model.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])] == [library.decode(r) for r in rows]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    rules = dict(_fields(dict(_fields(library.serialized_model_proto()))[3]))
    model = PieceModel(PIECES)
    model.map, model.prefix, model.squeeze = CharacterMap(rules[2]), bool(rules.get(3, 1)), bool(rules.get(4, 1))
    texts = ["", " ", "\x07", " \x07 a ", *fuzzed(4, 1500, "  aeAÉé①ｱｲＡ́̈é\n\t漢ﬁ½​　\xa0\x07")]
    data, bounds, align = model.normalised(Texts(pa.array(texts)))
    raw = data.tobytes()
    for i, text in enumerate(texts):
        want, offsets = library.normalize(text, with_offsets=True)
        got, places, at = raw[bounds[i] : bounds[i + 1]].decode(), [0], text.encode()
        assert got == want.replace("▁", " "), repr(text)
        for c in got:
            places.append(places[-1] + len(c.encode()))
        if got:
            assert [len(at[: align[bounds[i] + i + p]].decode()) for p in places] == list(offsets), repr(text)


def test_pieces_in_spark(llm):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t) for i, t in enumerate(HARD + fuzzed(2, 100))]
    docs = llm.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit("own column"))
    out = piece_decode(piece_encode(docs, PIECES), PIECES).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(r["text"] or "")
        assert r["pieces"]["ids"] == ids and r["decoded"] == library.decode(ids) and r["ids"] == "own column"
    digests = {r["doc_id"]: r for r in queries.op12_sentence_pieces(docs).collect()}
    for i, text in rows:
        ids = library.encode(text or "")
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert tuple(digests[i])[1:] == want
    assert queries.op12_sentence_pieces(docs.limit(0)).count() == 0


# Equality of slices


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_hashes_tell_hard_strings_apart(size):
    text = thue_morse(size, "a", "b") + thue_morse(size, "b", "a")
    data = np.frombuffer(text.encode(), np.uint8)
    one, two = Hashes(data).of(np.array([0, size]), np.array([size, 2 * size]))
    assert one != two
    pieces, sample, number = distinct_slices(data, np.array([0, size]), np.array([size, 2 * size]))
    assert len(pieces) == 2 and number[0] != number[1]


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(Hashes, "of", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabdab", np.uint8)
    pieces, sample, number = distinct_slices(data, np.array([0, 3, 6]), np.array([3, 6, 8]))
    assert pieces == [b"abc", b"abd", b"ab"] and number.tolist() == [0, 1, 2]


def test_thue_morse_through_the_operators(llm):
    from recordlake.llm.bpe import bpe_decode, bpe_encode
    from recordlake.llm.jaccard import jaccard_groups
    from recordlake.llm.quality import quality_rules

    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = llm.createDataFrame([(1, one), (2, two), (3, f"{one}\n{two}")], "doc_id long, text string")
    for r in bpe_decode(bpe_encode(docs, path), path).collect():
        assert bytes(r["decoded"]) == r["text"].encode()
    assert {r["doc_id"]: r["n"] for r in quality_rules(docs).selectExpr("doc_id", "quality.n_dup_lines n").collect()} == {1: 0, 2: 0, 3: 0}
    assert all(r["component_id"] == r["doc_id"] for r in jaccard_groups(docs, size=4, percent=85).collect())
