"""Repeated passages, prefix trie and reversed search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from veriframe.llm import conversation_trie, reversed_search, suffix_dedup


# --- op11 ------------------------------------------------------------------------------------------


def test_columns_of_the_transform():
    rng = random.Random(1)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 25))]
        marks = np.array([rng.randrange(len(p)) for p in pieces])
        seen = set()
        for c, order, symbols, prefixes in suffix_dedup.collection_columns(pieces, marks):
            suffix = {i: p[c + m :] for i, (p, m) in enumerate(zip(pieces, marks)) if -m <= c < len(p) - m}
            assert sorted(order.tolist()) == sorted(suffix)
            ordered = [suffix[i] for i in order]
            assert ordered == sorted(ordered)
            for k, i in enumerate(order):
                at = c + marks[i]
                assert symbols[k] == (pieces[i][at - 1] if at else -1)
                a, b = (ordered[k - 1], ordered[k]) if k else (b"", b"")
                common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert prefixes[k] == common
            seen |= {(i, c) for i in suffix}
        assert len(seen) == sum(map(len, pieces))


def test_runs_of_repeated_starts():
    pieces, marks = [b"xxabcdefgyy", b"qabcdefgz", b"abcdef", b"zzzzzzzzz"], np.array([4, 3, 2, 4])
    assert suffix_dedup.repeated_starts(pieces, marks, 5) == [[(2, 5)], [(1, 4)], [(0, 2)], []]


def removed(texts, size):
    """By row: maximal runs covered by strings that start elsewhere too, from a count of all strings."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 2, int)
        for i in range(len(d) - size + 1):
            if counts[d[i : i + size]] > 1:
                hit[i + 1], hit[i + size + 1] = hit[i + 1] + 1, hit[i + size + 1] - 1
        covered = np.cumsum(hit)[1:-1] > 0 if len(d) else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((tuple(spans), bytes(np.frombuffer(d, np.uint8)[~covered]) if len(d) else b""))
    return out


def test_repeats_equal_a_count_of_all_strings(spark, monkeypatch):
    rng = random.Random(2)
    size = 60
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, passages = word(50), [word(rng.randint(55, 200)) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "a" * 61, "ab" * 300, word(59), word(60)]
    for i in range(120):
        parts = [word(rng.randint(5, 150)), common, word(rng.randint(5, 90))]
        if i % 3 == 0:
            parts.insert(rng.randrange(3), rng.choice(passages))
        if i % 10 == 0:
            parts += [parts[0]]
        texts.append("".join(parts))
    texts += texts[20:24] * 2 + [texts[30][:100] + "#" + texts[30][101:]]
    rows = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)] + [(9, texts[9], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, spans string").repartition(5)
    wanted = Counter((r[0], r[1], *d) for r, d in zip(rows, removed([r[1] for r in rows], size)))
    for group in (4096, 3):  # with 3, the common passage is dealt again in blocks and single strings
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        monkeypatch.setattr(suffix_dedup, "COLLECTION", 4000)
        found = suffix_dedup.remove_repeats(docs, size).collect()
        got = Counter((r.doc_id, r.text, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found)
        assert got == wanted


def test_repeats_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).collect() == []
    one = spark.createDataFrame([(1, "x" * 10), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, bytes(r.kept), len(r.spans)) for r in suffix_dedup.remove_repeats(one).collect()} == {(1, b"x" * 10, 0), (2, b"", 0)}


def test_long_runs_stay_small(spark):
    texts = {1: "a" * 1_000_000, 2: " " * 399, 3: "ab" * 200_000 + "tail", 4: "\n" * 400}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out[1] == ([(0, 1_000_000)], b"") and out[2] == ([], b" " * 399)
    assert out[3] == ([(0, 400_000)], b"tail") and out[4] == ([], b"\n" * 400)


# --- op12 ------------------------------------------------------------------------------------------


def trie(rows):
    """Nodes of the rebuilt conversations by dictionaries: the contract word for word."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - math.fmod(c, 5), [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def total(p):
        below = [total(q) for q in children[p]]
        mine = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        return (sum(b[0] for b in below) or int(not below), mine + sum(b[1] for b in below))

    return {
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), *total(p),
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p in members
    }


def nodes(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", conversation_trie.F.lit("x"))
    found = conversation_trie.build_trie(*conversation_trie.rebuilt(frame)).drop("name", "parent").collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    return got


def test_trie_equals_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "END_CELL", 4)
    monkeypatch.setattr(conversation_trie, "NUMBERING_CELL", 8)
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), 100, 101, 107, 2**40 + 3, 2**40 + 4]:
        if c in (20, 35):
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 40 if c == 7 else 12])):
            first = "hello" if rng.random() < 0.8 else rng.choice("ab")
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if turn else "user",
                         first if not turn else rng.choice(["é", "", None, "yes", "no"])))
    rows += [(3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (3, 1, "user", "tie"), (None, 0, "user", "lost"), (55, None, None, None)]
    rng.shuffle(rows)
    assert nodes(spark, rows) == trie(rows)


def test_small_tries(spark):
    assert nodes(spark, []) == set()
    assert nodes(spark, [(None, 1, "user", "x")]) == set()
    one = [(10, 1, "user", "x")]
    assert nodes(spark, one) == trie(one)
    lone = [(c, 0, "user", "x") for c in range(1, 5)]  # base absent: some are rebuilt without a turn
    assert nodes(spark, lone) == trie(lone) and any(n[1] == 0 and n[3] == 4 for n in trie(lone))


# --- op13 ------------------------------------------------------------------------------------------


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = Counter()
    for item, own in asked.items():
        hits = []
        for doc, c in counts:
            if not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            weigh = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(n * weigh(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in own.items() if t in c)
            if s > 0:
                hits.append((-s, doc is None, doc or 0, doc))
        out.update((item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1))
    return out


def test_search_equals_scoring_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["The", "of", "Über", "naïve", "x1", "漢字", "and", "it's", "e-mail", "ÀÉ"] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", "\n", "\t-  ", "; "]).join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(400, None), (401, ""), (402, "?! ..."), (5, "again w1"), (None, "w1 of"), (None, "w1 of")]
    docs += [(500 + i, "same words here w1") for i in range(30)]  # ties
    items = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(90, None), (91, "nowhere"), (92, ""), (3, "w1 w1"), (None, "w2"), (93, "same")]
    docs_df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id long, score long").repartition(6)
    items_df = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    wanted = ranked(docs, items)
    for bound in (1_000_000, 30):
        monkeypatch.setattr(reversed_search, "BLOCK_POSTINGS", bound)
        monkeypatch.setattr(reversed_search, "CELLS", 200)
        assert Counter(map(tuple, reversed_search.search(docs_df, items_df).collect())) == wanted
    assert reversed_search.search(docs_df.where("false"), items_df).collect() == []
    assert reversed_search.search(docs_df, items_df.where("false")).collect() == []


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(reversed_search, "SLICE", 7)
    text = "Ab, cd efghijklmnop  Q é" * 20 + " " * 50
    assert [w for s in reversed_search.word_slices(text.encode()) for w in s] == [t.encode() for t in terms(text)]
