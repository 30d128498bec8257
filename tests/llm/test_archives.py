"""Archives, the conversation trie and the Merkle manifest against brute force, with nulls, ties, copies and long texts."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import pytest
import zstandard

from trackspark.llm import merkle, trie, warc

PAGES = "page_id long, url string, html string, archive string, payload int, keeper long, code string, digest string, n_bytes long"


def pages():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    text = lambda n: "<p>" + " ".join(rng.choices(words, k=n)) + "</p>"
    common, exact = text(400), "x" * 1000
    rows = [(i, f"http://a.org/{i}?q=é ü", text(rng.randint(1, 600))) for i in range(120)]
    rows += [(200 + i, None, common) for i in range(60)] + [(300 + i, "no url\r\nat all", exact) for i in range(3)] + [(310, "u", exact), (310, "v", exact)]
    rows += [(400, "u", None), (401, "u", ""), (402, "u", "x" * 999), (403, "u", "x" * 999), (None, "u", common), (None, None, None), (405, "%41", "ü" * 500), (404, "u", "ü" * 500), (500, "u", text(60_000))]
    return rows


def test_warc(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "a", 1, 2, "c", "d", 3) for r in rows], PAGES).repartition(4)
    how = warc.Archives(archive_bytes=100_000, dictionary_bytes=2048, broadcast_keys=0)
    largest = collections.defaultdict(lambda: -1)
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            largest[t] = max(largest[t], i)
    want = []
    for i, _, t in rows:
        data, keeper = (t or "").encode(), largest.get(t, -1)
        again = i is not None and keeper > i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted(map(tuple, warc.described(df, how).collect()), key=str) == sorted(want, key=str)
    made = warc.written(df.selectExpr("page_id", "url", "html as payload"), how)
    assert made.count() > 3 and made.agg({"n_records": "sum"}).first()[0] == len(rows)
    back = warc.read(made, payloads=True).where("record_type = 'response'").collect()
    assert collections.Counter((r.page_id, bytes(r.payload)) for r in back) == collections.Counter((i, (t or "").encode()) for (i, _, t), w in zip(rows, want) if w[3] == "response")
    assert {r.url for r in back if r.page_id == 405} == {"%41"}
    assert warc.described(df.limit(0)).count() == 0


def test_archive_bytes():
    """The dictionary is used, plain or compressed; what is damaged is refused."""
    how = warc.Archives(dictionary_bytes=2048)
    records = [warc.record(i, "http://a.org", (t or "").encode(), None, how) for i, (_, _, t) in enumerate(pages())]
    data = warc.archive(records, how)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and list(warc.frames(io.BytesIO(data))) == records
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    plain = data[:4] + len(dictionary).to_bytes(4, "little") + dictionary + data[8 + size :]
    assert list(warc.frames(io.BytesIO(plain))) == records
    few = warc.archive(records[:2], how)
    assert int.from_bytes(few[:4], "little") == warc.FRAME and list(warc.frames(io.BytesIO(few))) == records[:2]
    assert list(warc.frames(io.BytesIO(b""))) == []
    flipped = bytearray(data)
    flipped[-40] ^= 255
    for bad in (data[:-9], data[8 + size :], bytes(flipped), data[:8] + b"junk" * 20):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(bad)))
    good = records[0]
    assert warc.page(good)[0] == 0
    revisit = warc.record(1, None, b"abc", 2, how)
    assert warc.page(revisit)[:6] == (1, 3, hashlib.sha1(b"abc").hexdigest(), "revisit", 2, None)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type", b"WARC-Tipe"), good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"<p>", b"<q>"), re.sub(rb"Content-Length: \d+", b"Content-Length: 7", good), good.replace(b"HTTP/1.1 200", b"FTP/1.1 200"), revisit.replace(b"WARC-Refers-To", b"WARC-Other")):
        with pytest.raises(ValueError):
            warc.page(bad)


def brute_trie(rows):
    """Nodes by the contract, from (conv_id, turn, role, text)."""
    code = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32]
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(((r[1] is not None, r[1] or 0), code(r), len((r[3] or "").encode())))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        t = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (k[-1][1] if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, path string, parent long, piece string, base string, h int"


@pytest.mark.parametrize("bound", [0, 1000])
def test_trie(spark, bound):
    """Many short runs and many tasks; common conversations, hot first turns, absent bases, ties, repeats and nulls."""
    rng = random.Random(8)
    rows = []
    for c in range(400):
        if c % 23 == 5:
            continue
        kind = rng.random()
        for t in range(6 if kind < 0.3 else rng.randint(1, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"always {t}" if kind < 0.3 else rng.choice("ab") * rng.choice([1, 3]) if t else "hello"))
    rows += [(1000, 1, None, "x"), (1000, None, "user", None), (1000, 1, None, "y"), (1000, 1, None, "y"), (1001, 0, "user", "é" * 50_000), (None, 0, "user", "lost"), (-3, 0, "", ""), (2000, 5, "system", "")]
    df = spark.createDataFrame([(*r, "p", 1, "q", "b", 2) for r in rows], TURNS)
    found = trie.nodes(trie.rebuilt(trie.sequences(df)), trie.Sorting(run_turns=40, piece=3, broadcast_nodes=bound)).fillna(-1, ["parent_conv_id"])
    assert sorted(map(tuple, found.collect())) == brute_trie(rows)
    assert trie.nodes(trie.rebuilt(trie.sequences(df.limit(0)))).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        items = [("".join(rng.choice("ab") * trie.WIDTH for _ in range(rng.randint(0, 6))), i) for i in range(rng.randint(k, 90))]
        rng.shuffle(items)
        runs = [trie.Run([(s, i, bytes(8 * (len(s) // trie.WIDTH))) for s, i in items[j::k]]) for j in range(k)]
        out = list(trie.merged(runs))
        assert [(s, i) for _, s, i, _ in out] == sorted(items)
        assert [x[0] for x in out] == [0, *(trie.shared(a[1], b[1], 0) for a, b in zip(out, out[1:]))]
        assert all(len(x[3]) == 8 * (len(x[1]) // trie.WIDTH) for x in out)


def brute_merkle(rows, arity):
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def proofs(level):
        """The root, and for each node the (left, right) siblings on each level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for p, i in zip(paths, at):
                run = i // arity * arity
                p.append((level[run:i], level[i + 1 : run + arity]))
            level, at = [h(level[i : i + arity]) for i in range(0, len(level), arity)], [i // arity for i in at]
        return level[0], paths

    trees = collections.defaultdict(list)
    for r in rows:
        text = r[4]
        hit = r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text) if hit else text
        trees[r[1]].append((r[0] is not None, r[0] or 0, h(map(field, r[:5])), h(map(field, (*r[:4], low))), r[0]))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: proofs([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in sources}
    root, ways = proofs([subs[s][0] for s in sources])
    out = []
    for s, way in zip(sources, ways):
        for x, path in zip(sorted(trees[s], key=lambda x: x[:3]), subs[s][1]):
            back = x[3]
            for a, b in path + way:
                back = h([*a, back, *b])
            out.append((x[4], x[2], subs[s][0], root, h([d for a, b in path + way for d in a + b]), back, back == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, of string, pos long, digest string, path string, block int"


@pytest.mark.parametrize("how", [merkle.Tree(), merkle.Tree(2, 3), merkle.Tree(3, 1)])
def test_merkle(spark, how):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", rng.choice(["en", None]), rng.randint(0, 9), rng.choice(["Some Text é", "", None, "lower", f"N {i}"])) for i in range(700)]
    rows += [(None, None, None, None, None), (5, None, "", 0, ""), (5, None, "", 0, ""), (5, None, "", 0, "Other"), (-9, "", "en", 1, "X" * 30_000), (9000, "Ü", "en", 1, "one"), (None, "hot", "en", 1, "A")]
    df = spark.createDataFrame([(*r, "a", 1, "b", "c", 2) for r in rows], DOCS).repartition(5)
    assert sorted(map(tuple, merkle.manifest(df, how).collect()), key=str) == brute_merkle(rows, how.arity)
    if how.levels == 3:
        assert merkle.manifest(df.limit(0), how).count() == 0
        one = df.where("doc_id = 9000")
        assert sorted(map(tuple, merkle.manifest(one, how).collect()), key=str) == brute_merkle([(9000, "Ü", "en", 1, "one")], how.arity)


def test_traversal():
    """Paths of all leaves of blocks of any size, and a stack that stays small."""
    for n in (1, 2, 3, 8, 9, 26, 27):
        leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
        height = merkle.Tree(3, 3).height(n)
        levels = [leaves]
        for _ in range(height):
            levels.append([merkle.joined(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        for i, path in enumerate(merkle.traversed(leaves, height, 3)):
            for k, (a, b) in enumerate(path):
                at = i // 3**k
                assert a + [levels[k][at]] + b == levels[k][at // 3 * 3 : at // 3 * 3 + 3] and len(a) == at % 3
