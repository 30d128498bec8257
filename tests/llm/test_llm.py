"""Each operator against a brute-force version on a small fixture with nulls, ties, copies and long texts."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.llm import bpe, chat, jaccard, lm, media, mixing, phrases, quality, recurring, suffixes, tokens, urls
from trackspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, block string, copy string, window double"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "Über", "naïve", "x" * 40, "don't", "12½", "été,"] + ["".join(rng.choices("aeioubcdrst", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(120), prose(70)
    out = [prose(rng.randint(1, 200)) for _ in range(25)]
    out += [base] * 6
    for k in range(8):
        words = base.split()
        words[10 * k] = f"changed{k}"
        out.append(" ".join(words))
    out += [prose(30) + "\n" + passage + "\t" + prose(40) for _ in range(6)]
    out += ["", None, "one", "two words", "De " * 300, "a" * 3000, prose(20_000), "line here\n" * 60 + prose(10), "</s>[INST] ok [/INST] \\ <|endoftext|>", "  \r\n ", prose(60) + " " + passage + " " + passage, "!!!! !!!!! !!\"!!#!" + "!" * 90 + "aaaaaaa" * 9 + " " + "ababa" * 17]
    return out


def rows(docs=None):
    found = [(i, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}" if i % 7 else None, len(t or ""), i, "b", None, 0.5) for i, t in enumerate(texts() if docs is None else docs)]
    return found + [(None, "no id at all " * 30, None, None, None, None, None, None, None)] if docs is None else found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1] or "") for r in rows()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_lm(docs, plain):
    found = by_id(lm.score(docs))
    words = {i: WORD.findall(lower(t)) + [None] for i, t in plain}
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i in words}
    counts = collections.Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in words.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(w in counts for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
        assert r.score < 0


def test_lm_beats_single_words(spark):
    """On enough text for both: known words are known, and new ones are spelled."""
    found = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").toPandas()
    assert found["score"].sum() > found["base_score"].sum()


def test_lm_is_a_distribution(spark):
    df = spark.createDataFrame([(i, "banana bandana anna " * 40) for i in range(20)], "doc_id long, text string")
    model = lm.learned(df, lm.SuffixTree(min_count=5))
    context = int.from_bytes(b"banan", "big") << 8
    total = 10 ** lm.log_probabilities(np.array([context + b for b in range(256)], np.uint64), model)
    assert total.sum() == pytest.approx(1)
    assert total.argmax() == ord("a")


def suffix_tree(docs, depth, least, evidence):
    """Plain Python: {state: Counter of next symbols} of the retained contexts and their suffixes."""
    seen = collections.defaultdict(collections.Counter)
    for t in docs:
        line = b"\n" * depth + "".join(w + " " for w in WORD.findall(lower(t))).encode() + b"\n"
        for i in range(depth, len(line)):
            for k in range(depth + 1):
                seen[line[i - k : i]][line[i]] += 1
    kept = {b""}
    for s, c in seen.items():
        total, up = sum(c.values()), seen[s[1:]]
        if s and total >= least and sum(n * math.log2(n * sum(up.values()) / (total * up[a])) for a, n in c.items()) >= evidence:
            kept |= {s[i:] for i in range(len(s) + 1)}
    return {s: seen[s] for s in kept}


def test_lm_retains_by_whole_counts(docs, plain):
    train = [t for i, t in plain if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    want = suffix_tree(train, 6, 5, 10.0)
    model = lm.learned(docs, lm.SuffixTree())
    assert len(model) == 7
    found = {(k, s) for k, level in enumerate(model) for s in level[0].tolist()}
    assert found == {(len(s), int.from_bytes(s, "big")) for s in want}
    pairs = {(k, key): n for k, level in enumerate(model) for key, n in zip(level[-2].tolist(), level[-1].tolist())}
    assert pairs == {(len(s), int.from_bytes(s, "big") << 8 | a): n for s, c in want.items() for a, n in c.items()}


def test_lm_scores_by_the_whole_tree(docs, plain):
    """Every symbol given its longest state; a rare context stays a state however much text there is."""
    train = [t for i, t in plain if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    tree = suffix_tree(train, 6, 5, 10.0)

    def p(s, a):
        if s not in tree:
            return p(s[1:], a)
        c, up = tree[s], p(s[1:], a) if s else 1 / 256
        return (c[a] + len(c) * up) / (sum(c.values()) + len(c))

    found = by_id(lm.score(docs))
    for i, t in plain[:12]:
        line = b"\n" * 6 + "".join(w + " " for w in WORD.findall(lower(t))).encode() + b"\n"
        assert found[i].score == pytest.approx(sum(math.log10(p(line[k - 6 : k], line[k])) for k in range(6, len(line))))
    assert not hasattr(lm.SuffixTree(), "min_share")


def test_lm_blocks_of_equal_content(spark):
    """Two partitions with the same documents: words of one block keep their own counts."""
    texts = [(i, f"common a{i} b{i % 3} rare{i} common common") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = lm.score(df.union(df)).collect()
    assert len(found) == 80
    counts = collections.Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.split(), None] * 2)
    n, v = sum(counts.values()), len(counts)
    words = dict(texts)
    for r in found:
        want = [*words[r.doc_id].split(), None]
        assert (r.n_tokens, r.n_known) == (len(want), sum(w in counts for w in want))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in want))


def test_bpe(docs, plain, spark):
    import public_tokenizers as p
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.ranks(bpe.Vocabulary().path), special_tokens={})
    found = by_id(bpe.digests(docs))
    for i, t in plain:
        ids = enc.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == want
    back = bpe.encoded(docs).select("doc_id", bpe.decoded(F.col("ids")).cast("string").alias("text"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(None if i is None else str(i), t) for i, t in plain}
    known = bpe.ranks(bpe.Vocabulary().path)
    for word in (b"a" * 500, "naïveté".encode() * 40, bytes(range(256))):
        assert b"".join(bpe.pieces(bpe.Vocabulary().path)[i] for i in bpe.heap_fold(word, known)) == word
    assert base64.b64encode(b"a")


def test_bpe_plans_are_small(docs, spark):
    """The driver keeps a description of each plan that ran; none holds the vocabulary."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(60_000)
    before = store.executionsCount()
    bpe.digests(docs).count()
    bus.waitUntilEmpty(60_000)
    ran = store.executionsList(before, 100)
    assert ran.size() and max(len(ran.apply(i).physicalPlanDescription()) for i in range(ran.size())) < 100_000


def test_bpe_gives_memory_back(monkeypatch):
    """When a task's memory goes back to the system, the words of its last block are no longer held."""
    monkeypatch.setattr(bpe, "bucketed", lambda run, *_: run)
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    held: list[int] = []
    monkeypatch.setattr(tokens, "released", lambda: held.append(tracemalloc.get_traced_memory()[0]))
    docs = SimpleNamespace(select=lambda *_: docs, mapInArrow=lambda run, _: run)
    run = bpe._blocks(docs, bpe.Vocabulary(), "doc_id")
    batch = pa.RecordBatch.from_pydict({"doc_id": ["a"], "text": [" ".join(f"w{i}x" for i in range(100_000))]})
    bpe.ranks(bpe.Vocabulary().path)
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in run(iter([batch]))) == 1
    finally:
        tracemalloc.stop()
    assert held and max(held) < 2 << 20


def test_memory_goes_back_after_a_step(monkeypatch):
    held: list[int] = []
    monkeypatch.setattr(tokens, "released", lambda: held.append(tracemalloc.get_traced_memory()[0]))

    def run(batches):
        for piece in tokens.slices(batches):
            much = np.zeros(8 << 20, np.uint8)
            yield piece
            del piece
        assert len(much)

    def group(n):
        much = np.zeros(8 << 20, np.uint8)
        return len(much) + n

    tracemalloc.start()
    try:
        assert len(list(tokens.swept(run)(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])))) == 1
        assert tokens.alone(group(1)) == (8 << 20) + 1
    finally:
        tracemalloc.stop()
    assert len(held) == 2 and max(held) < 1 << 20


def test_phrases(docs, plain):
    found = by_id(phrases.digests(docs))
    first = {}
    for i, t in sorted((x for x in plain if x[0] is not None), key=lambda x: x[0]):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert found[None].n_removed == 0
    same = {r.doc_id: r.text for r in phrases.cut(docs).collect()}
    assert all(same[i] == (t or None) or found[i].n_removed or t == "" for i, t in plain)


@pytest.mark.parametrize("shard_words", [500_000, 12])
def test_automata_find_all_repeats(shard_words):
    """On few words, so that windows recur in all ways, in one automaton and in many."""
    rng, how = random.Random(3), phrases.Repeats(window=5, gram=2, shard_words=shard_words)
    for _ in range(150):
        lines = [rng.choices("ab", k=rng.randint(5, 14)) for _ in range(rng.randint(1, 8))]
        docs = np.array([rng.randint(1, 5) for _ in lines])
        low = {}
        for d, w in sorted(zip(docs.tolist(), lines)):
            for k in range(len(w) - 4):
                low.setdefault(tuple(w[k : k + 5]), d)
        want = {(i, k) for i, w in enumerate(lines) for k in range(len(w) - 4) if docs[i] > low[tuple(w[k : k + 5])]}
        piece, at = how.repeated([" ".join(w).encode() + b" " for w in lines], docs, np.zeros(len(lines), np.int64))
        assert set(zip(piece.tolist(), at.tolist())) == want


def test_automata_decide(monkeypatch):
    """Without their hits nothing is removed, whatever the hashes say."""
    how, pieces, docs = phrases.Repeats(window=5, gram=2), [b"a b c d e f g ", b"x a b c d e f y ", b"c d e f g h i "], np.array([1, 2, 3])
    piece, at = how.repeated(pieces, docs, np.zeros(3, np.int64))
    assert set(zip(piece.tolist(), at.tolist())) == {(1, 1), (1, 2), (2, 0)}

    class Blind:
        def __init__(self, *_): ...
        def add_word(self, *_): ...
        def make_automaton(self): ...
        def iter(self, line):
            return iter(())

    monkeypatch.setattr(phrases.ahocorasick, "Automaton", Blind)
    assert not len(how.repeated(pieces, docs, np.zeros(3, np.int64))[0])


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def grouped(pairs, nodes):
    parent = {i: i for i in nodes}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard(docs, plain, small):
    found = by_id(jaccard.near_duplicates(docs, jaccard.NearDuplicates(sketch_bits=14, small=small)))
    sets = {i: shingles(t) for i, t in plain if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(links, sets)
    assert len(set(want.values())) < len(want) - 8
    for i in sets:
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), want[i])
    assert found[None].component_id is None


def test_jaccard_chains(spark):
    """Chains of near copies link only through one another; one token is shared by all."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    out = []
    for k in range(40):
        words = list(base)
        for j in range(k % 13):
            words[(5 * j + k) % 60] = f"n{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    df = spark.createDataFrame(rows(out), SCHEMA)
    sets = {i: shingles(t) for i, t in enumerate(out)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(links, sets)
    for small in (2, 8, 100):
        found = by_id(jaccard.near_duplicates(df, jaccard.NearDuplicates(sketch_bits=14, small=small)))
        assert {i: r.component_id for i, r in found.items()} == want
    assert {r.doc_id for r in jaccard.one_of_each(df).collect()} == set(want.values())


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == grouped([x for x in links if x[0] != x[1]], nodes)


def repeats_of_bytes(docs):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256) by plain Python."""
    seen, out = set(), {}
    for i, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        t = t.encode()
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            else:
                seen.add(t[k : k + 100])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()
    return out


SMALL = suffixes.RepeatedBytes(most=2, block_bytes=4000, bucket_bytes=20_000, chunk_bytes=5000, shard_bytes=700)


@pytest.mark.parametrize("how", [suffixes.RepeatedBytes(), SMALL], ids=["whole", "small"])
def test_suffixes(docs, plain, how):
    found = by_id(suffixes.digests(docs, how))
    for i, want in repeats_of_bytes(plain).items():
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == want
    assert found[None].n_removed == 0


@pytest.mark.parametrize("most", [32, 10**6])
def test_suffixes_hot_anchor(spark, most):
    """One line of 60 bytes before texts that differ, some of which recur: thousands of distinct pieces under one anchor."""
    rng = random.Random(2)
    line = "This is the line that stands in front of every text, always."
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = [line + " ".join(rng.choices(words, k=20)) for _ in range(1500)]
    for k in range(0, 200, 10):
        texts[k] = texts[k + 1][: 60 + 45] + " " + texts[k]
        texts[700 + k] = "x" + texts[k + 1][20 : 60 + 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = by_id(suffixes.digests(df, suffixes.RepeatedBytes(most=most, block_bytes=50_000)))
    want = repeats_of_bytes(list(enumerate(texts)))
    assert sum(x[1] > 0 for x in want.values()) >= 20
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == want


def repeats_of_words(docs):
    """doc_id: (n_words, n_removed, kept_sha256) by plain Python."""
    split, source = {i: WORD.findall(t) for i, t in docs}, {}
    for i, w in split.items():
        for k in range(len(w) - 49):
            source[tuple(w[k : k + 50])] = min(source.get(tuple(w[k : k + 50]), i), i)
    out = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - 49) if source[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out[i] = len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
    return out


def headed(n: int) -> list[str]:
    """One line before texts that differ, some of which recur."""
    rng = random.Random(5)
    line = " ".join(f"head{k}" for k in range(40))
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    texts = [f"{line} {' '.join(rng.choices(words, k=30))}" for _ in range(n)]
    for k in range(0, n // 2, 9):
        texts[n - 1 - k] = texts[k] if k % 2 else "x " + texts[k][20:]
    return texts


@pytest.mark.parametrize("how", [phrases.Repeats, suffixes.RepeatedBytes], ids=["words", "bytes"])
def test_anchor_of_many_blocks(spark, how):
    """Few pieces of one anchor in each of very many blocks: no more than ``together`` of them are merged in one task."""
    texts = headed(600)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    how = how(block_bytes=4000, together=100)
    if isinstance(how, phrases.Repeats):
        found = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(phrases.digests(df, how)).items()}
        want = repeats_of_words(list(enumerate(texts)))
    else:
        found = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffixes.digests(df, how)).items()}
        want = repeats_of_bytes(list(enumerate(texts)))
    assert sum(x[1] > 0 for x in want.values()) >= 30
    assert found == want


@pytest.mark.parametrize("marked", [False, True])
def test_answer_counts_all_blocks(marked):
    """An anchor is hot by the pieces of all blocks; later copies stay copies, but for a marked piece."""
    how = phrases.Repeats(together=3)
    pack = recurring.pack
    u, i = (lambda *x: pack(np.array(x, np.uint64))), (lambda *x: pack(np.array(x, np.int64)))
    ask = [(0, b, 2, u(7, 9), u(b, 1), u(0, 0), i(b, b), i(0, 0), pack(np.array([marked and b == 4, False]))) for b in range(4)]
    ask.append((0, 4, 1, u(7), u(0), u(0), i(4), i(0), pack(np.array([marked]))))
    said = {r["block"]: list(recurring.unpack(r["verdicts"], np.uint8)) for r in recurring._answer(recurring._table(ask, recurring.ASK), how).to_pylist()}
    w, c, alone = recurring.WINDOWS, recurring.COPY, recurring.ALONE
    assert said == {0: [w, alone], 1: [w, c], 2: [w, c], 3: [w, c], 4: [w if marked else c]}


def test_suffixes_spans(spark):
    """Rows of one doc_id don't remove each other at equal places; spans and kept bytes are given back."""
    text = "".join(random.Random(4).choices("abcdefghij ", k=260))
    df = spark.createDataFrame([(1, text), (1, text), (2, "é" + text + "!"), (None, text)], "doc_id long, text string")
    found = [(r.doc_id, [tuple(s) for s in r.spans], bytes(r.kept).decode()) for r in suffixes.removed(df).collect()]
    assert sorted(found, key=str) == sorted([(1, [], text), (1, [], text), (2, [(2, 260)], "é!"), (None, [], text)], key=str)


def test_merged_transforms():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(2, 4, 60), 0).astype(np.uint16) for _ in range(3)]
    orders = [suffixes.suffix_order(s) for s in shards]
    shard, common = suffixes.merged([s[o - 1] for s, o in zip(shards, orders)], 8)
    at = [iter(o) for o in orders]
    heads = [tuple(np.resize(np.roll(shards[s], -next(at[s])), 8)) for s in shard]
    assert heads == sorted(heads)
    for k in range(1, len(heads)):
        same = next((i for i in range(8) if heads[k][i] != heads[k - 1][i]), 8)
        assert common[k] == same


def test_media(docs, plain):
    index = media.stored(docs, media.Shards(shard_bytes=20_000))
    assert index.select("shard").distinct().count() > 1
    found = by_id(media.described(docs))
    for i, t in plain:
        t = t.encode()
        payload = t + b" " * (-len(t) % 192 or (0 if t else 192))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.width, r.height) == (192, len(payload) // 192)
        rows_of = [payload[k : k + 192] for k in range(0, len(payload), 192)]
        edges = [int(x) for x in np.linspace(0, len(rows_of), 9)]
        cells = [[sum(sum(x[24 * c : 24 * c + 24]) for x in rows_of[a : max(b, a + 1)]) / max(b - a, 1) if a < len(rows_of) else 0 for c in range(8)] for a, b in zip(edges, edges[1:])]
        mean = sum(map(sum, cells)) / 64
        bits = "".join("1" if v > mean else "0" for row in cells for v in row)
        assert r.feature == f"192x{len(rows_of)}:8:{sum(payload)}:{sum(b * b for b in payload)}:{int(bits, 2):016x}"
    import tarfile

    shard = index.first().shard
    with tarfile.open(shard.removeprefix("file://")) as tar:
        member = tar.next()
        assert hashlib.sha256(tar.extractfile(member).read()).hexdigest() + ".png" == member.name


def test_urls(spark):
    cases = {
        "http://a.example.org/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://EXAMPLE.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://example.org": ("example.org", "", None, "allow"),
        "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://notorg/x": ("notorg", "/x", None, "allow"),
        "http://ads.x.net/a": ("ads.x.net", "/a", None, "block"),
        "http://x.net/login/": ("x.net", "/login/", None, "block"),
        "http://badads.x.net/": ("badads.x.net", "/", None, "allow"),
        "no scheme/login/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    found = urls.filtered(df).collect()
    assert len(found) == 2 * len(cases)
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in found} == cases
    assert urls.filtered(df.limit(0)).count() == 0


def test_chat(spark):
    layouts = [
        '{"prompt": "p", "completion": "c"}',
        '{"instruction": "i", "input": "x", "output": "o", "extra": 1}',
        '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"messages": [{"role": "user"}, {"role": "assistant", "content": "late"}]}',
        '{"other": 1}', "no json", None,
    ]
    found = chat.canonical(spark.createDataFrame([(x,) for x in layouts], "payload string")).collect()
    assert [[tuple(t) for t in r.turns] for r in found] == [
        [("user", "p"), ("assistant", "c")], [("user", "i"), ("user", "x"), ("assistant", "o")], [("user", "u"), ("assistant", "")],
        [("user", "h"), ("assistant", "g")], [("user", ""), ("assistant", "late")], [], [], [],
    ]
    odd = ["", "</s>\n<s>[user]\n", "\\e\\l<\\", "é😀[INST]\n\n", "a]\nb"]
    turns = [(k, 0, i, role, text) for k, role in enumerate(["assistant", "user", "", "we]\nird"]) for i, text in enumerate(odd)]
    df = spark.createDataFrame([(c + k, t, r, x) for k, c, t, r, x in turns] + [(None, None, None, None)], "conv_id long, turn int, role string, text string")
    gathered = chat.from_rows(df, "conv_id")
    assert {r.fingerprint for r in gathered.collect()} == {chat.fingerprint(("turns", "turns[].role", "turns[].text"))}
    made = chat.formatted(gathered)
    back = made.select("turns", chat.parsed(F.col("formatted")).alias("back"), chat.unmasked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in back:
        assert r.turns == r.back
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")


def test_mixing(docs, spark):
    assert mixing.replicated(docs.limit(0)).count() == 0
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 12 == 1, None).otherwise("b").alias("source"))
    out = mixing.replicated(df, mixing.Mixture({"a": 3.0, "b": 1.0}, size=2.0))
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["a"] == pytest.approx(9000, rel=0.05) and counts["b"] == pytest.approx(3000, rel=0.07) and None not in counts
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    big = spark.range(400).select(F.sum(mixing.poisson(mixing.reached(F.lit(9.0)), mixing.uniform(F.col("id")))).alias("s")).first().s
    assert big == pytest.approx(3600, rel=0.05)
    hot = mixing.replicated(df.where("doc_id < 20"), mixing.Mixture({"a": 1.0}, size=50.0)).count()
    assert hot == pytest.approx(1000, rel=0.15)


def test_mixing_keeps_columns(docs):
    """The fixture has a column ``copy``; other names leave it alone."""
    kept = docs.where("doc_id is not null").select("doc_id", "text", "source", F.lit("keep").alias("copy"), F.lit(7).alias("rate"))
    out = mixing.replicated(kept, rate="r1", copy="c1").select("copy", "rate", "c1", "r1").collect()
    assert out and all((r.copy, r.rate) == ("keep", 7) and r.c1 >= 1 and r.r1 > 0 for r in out)


def test_quality(docs, plain):
    found = by_id(quality.score(docs))
    for i, t in plain:
        w = WORD.findall(t)
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if triples[x] > 1 for j in range(3)}
        seen, lines = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered), failed)
        assert not (r.kept and failed)
    assert {r.doc_id for r in quality.keep(docs).collect()} == {i for i, r in found.items() if r.kept}


def kind_of(char):
    return next((k for k, x in enumerate((r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:'\"?()-]", r"[\x00-\x7f]")) if re.fullmatch(x, char)), 6)


def js(p, q):
    part = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(max(0.0, (part(p, m) + part(q, m)) / 2))


def test_quality_distances_and_verdict(docs, plain):
    """Both distances and the verdict by plain Python, for listed and other languages."""
    rules = quality.QualityRules(min_words=20)
    langs = {r[0]: r[2] for r in rows()}
    hist, passed, count = {}, {}, {}
    for i, t in plain:
        w = WORD.findall(t)
        count[i] = len(w)
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if triples[x] > 1 for j in range(3)}
        passed[i] = len(w) >= 20 and 100 * len(covered) <= 50 * len(w)
        chars = collections.Counter(map(kind_of, t))
        common = collections.Counter(quality.BINS.index(x) if x in quality.BINS else len(quality.BINS) for x in map(lower, w))
        hist[i] = [chars[k] for k in range(7)], [common[k] for k in range(len(quality.BINS) + 1)]
    key = {i: x if x in quality.COMMON_WORDS else "" for i, x in langs.items()}
    refs = {x: [[sum(c) for c in zip(*(hist[i][h] for i in hist if passed[i] and key[i] == x))] for h in (0, 1)] for x in {key[i] for i in hist if passed[i]}}
    share = lambda c: [x / sum(c) for x in c]
    found = by_id(quality.score(docs, rules))
    for i, (chars, common) in hist.items():
        own = [key[i]] if key[i] in refs and key[i] else list(refs)
        want = [min(js(share(h), share(refs[x][n])) if sum(h) else 0 for x in own) for n, h in enumerate((chars, common))]
        assert (found[i].js_chars, found[i].js_common) == pytest.approx(want, abs=1e-6)
        odd = want[0] > rules.max_chars and sum(chars) >= rules.min_chars_judged
        odd |= (want[1] > rules.max_common or sum(want) > rules.max_sum) and count[i] >= rules.min_words_judged
        assert found[i].kept == (passed[i] and not odd)


def test_quality_finds_other_characters(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choices(["the", "of", "and", "to", "in", "house", "river", "stone", "walks", "green", "slowly", "that"], k=150)).capitalize() + "."
    good = [(i, prose()) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}{rng.choice(['$$$', '&&&', '%%%'])}" for w in prose().split())) for i in range(3)]
    shout = [(200, prose().upper().replace(" ", "!! "))]
    df = spark.createDataFrame([(i, t, "en") for i, t in good + bad + shout], "doc_id long, text string, lang string")
    loose = quality.QualityRules(max_repeat_percent=100)
    assert {r.doc_id for r in quality.keep(df, loose).collect()} == {i for i, _ in good}


@pytest.mark.parametrize("name", ["lm", "bpe", "phrases", "jaccard", "suffixes", "media", "quality", "keep", "cut", "one"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    made = {"lm": lm.score, "bpe": bpe.digests, "phrases": phrases.digests, "jaccard": jaccard.near_duplicates, "suffixes": suffixes.digests, "media": media.described, "quality": quality.score, "keep": quality.keep, "cut": phrases.cut, "one": jaccard.one_of_each}
    assert made[name](docs).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, text, "en"), (1, text + " more", "en")], "doc_id long, text string, lang string")
    for f in (lm.score, bpe.digests, phrases.digests, jaccard.near_duplicates, suffixes.digests, media.described, quality.score):
        found = f(docs).toPandas()
        figures = [x for x in found.columns if x not in ("train_tokens",)]
        assert len(found) == 4
        # The two rows that are alike have the same figures.
        assert len(found[figures].round(9).drop_duplicates()) <= 3, f


def test_pipeline(spark, tmp_path):
    """Columns named like the operators' own go through all stages unchanged."""
    import corpus_pipeline

    given = spark.createDataFrame(rows(), SCHEMA).withColumns({"copy": F.lit("keep"), "rate": F.lit(7), "words_before": F.lit("w"), "bucket": F.col("doc_id") + 1, "__rate": F.lit(1.5), "__order": F.lit("o"), "__drawn": F.lit(3), "__content": F.lit("c")})
    given.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
    kept = kept.persist()
    found = kept.collect()
    assert found and all((r["copy"], r["rate"], r["words_before"], r["block"], r["window"]) == ("keep", 7, "w", "b", 0.5) and r["bucket"] == r["doc_id"] + 1 for r in found if r["doc_id"] is not None)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    figures = lambda df: sorted((str(r.doc_id), r.ids_sha256) for r in df.collect())
    assert figures(out) == figures(bpe.digests(kept))


def test_one_of_each_keeps_one_row(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (1, "another text"), (1, "another text"), (3, None), (3, None), (3, ""), (None, text), (None, text)]
    found = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, text), (1, "another text"), (3, None), (3, ""), (None, text), (None, text)]
    assert collections.Counter(map(tuple, found)) == collections.Counter(want)


def test_one_of_each_goes_by_text(spark):
    """An id with two texts, one of them near a smaller id's; columns named like helpers stay."""
    x, y = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    given = spark.createDataFrame([(1, x), (1, x), (2, x), (5, y), (5, x), (6, y)], "doc_id long, text string").withColumns({"__content": F.lit("c"), "__null": F.lit(3)})
    found = jaccard.one_of_each(given)
    assert sorted(map(tuple, found.collect())) == [(1, x, "c", 3), (5, y, "c", 3)] and found.columns == given.columns


def test_columns_named_like_helpers(spark):
    """They keep their values through mixing and URL filters."""
    more = {"__rate": F.lit(7.5), "__order": F.lit("o"), "__drawn": F.lit(9), "__source": F.lit("z"), "___rate": F.lit(1)}
    given = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string").withColumns(more)
    plain = mixing.replicated(given.select("doc_id", "text", "source"))
    found = mixing.replicated(given)
    assert collections.Counter(r.doc_id for r in found.collect()) == collections.Counter(r.doc_id for r in plain.collect())
    assert {tuple(r[c] for c in more) for r in found.collect()} == {(7.5, "o", 9, "z", 1)} and set(more) <= set(found.columns)
    pages = spark.createDataFrame([(1, "http://a.example.org/es/1"), (2, None)], "page_id long, url string").withColumns({"__best": F.lit(1), "__url": F.lit("u"), "__Rule": F.lit(2)})
    rows = {r.page_id: r for r in urls.filtered(pages).collect()}
    assert rows[1].rule == "example.org/es/" and rows[1].verdict == "block" and (rows[2]["__best"], rows[2]["__url"], rows[2]["__Rule"]) == (1, "u", 2)


def plain_pipeline(docs):
    """(doc_id, text) before mixing, in plain Python: the kept rows, one of each near-duplicate group, without repeated runs of 50 words."""
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = grouped(links, sets)
    seen, out = {}, []
    for i, t in sorted({(i, t) for i, t in docs if group[i] == i}):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        if not all(gone):
            out.append((i, b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on planted copies: a row written twice, the same text under other ids, near copies, a common passage."""
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = ["the", "of", "and", "to", "in", "house", "river", "stone", "walks", "green", "slowly", "that"] + ["".join(rng.choices("aeioubcdrst", k=rng.randint(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary[:12] * 12 + vocabulary, k=n))
    passage, base = prose(60), prose(150)
    near = base.split()
    near[70] = "changed"
    docs = [(i, prose(120)) for i in range(30)] + [(100, base), (101, base), (102, " ".join(near)), (103, prose(80) + " " + passage), (104, passage + " " + prose(90))]
    docs += [docs[3]] * 2 + [docs[30], docs[33]]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.keep(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert {3, 100, 103, 104} <= kept
    want = plain_pipeline([d for d in docs if d[0] in kept])
    mixed = mixing.replicated(spark.createDataFrame([(i, t.decode(), "en", "s", len(t)) for i, t in want], "doc_id long, text string, lang string, source string, n_chars long"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = {hashlib.sha256(t).hexdigest(): i for i, t in want}
    assert len(words) == len(want)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in found) == collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
