"""Vectors, packing, chat and URL rules: brute force and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veriframe.llm import chat_format, token_packing, url_rules, vector_topk


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "SHARD", 300)
    monkeypatch.setattr(vector_topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (0.1 if i % 3 else 1)).tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1200)]  # one common vector: ties
    odd = [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, rows[0][1]), rows[5], (2100, []), (2101, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, rank int")
    vectors = vector_topk.integer_vectors(frame)
    found = vector_topk.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    kept = {i: np.floor(np.array(v, np.float32).astype(float) * 1024) for i, v in [*rows, *odd[-2:]]}
    ids = np.array(sorted(kept))
    table = np.stack([np.pad(kept[i], (0, 8 - len(kept[i]))) for i in ids])
    expected = set()
    for q in ids[ids % 100 == 0]:
        scores = table @ table[list(ids).index(q)]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:10]
        expected |= {(int(q), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)


def test_topk_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    both = vector_topk.integer_vectors(frame)
    assert sorted((r.query_id, r.vec_id) for r in vector_topk.search(both, both).collect()) == [(0, 1), (1, 0)]
    assert vector_topk.search(both.where("false"), both.where("false")).collect() == []
    assert vector_topk.search(both.where("vec_id = 0"), both.where("vec_id = 0")).collect() == []


TEXTS = [None, "", "a", "Hello world, it's <|endoftext|> here", "é ß ñ 漢字 🙂 \u0000 \r\n\t  x", " " * 3000, "word " * 5000, "x" * 4000, "12345 " * 300,
         " " * 400_000 + "end", "a" + "\t" * 300_000, "\n" * 200_000, " \n\t" * 70_000 + "x", "y" * 200_000 + " z", " " * 4999 + "x"]


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(0, "again"), (None, "no id"), (2**60 + 1, "big id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, length int, part int").repartition(5)
    pieces = token_packing.pack(docs).collect()
    wanted = sorted((i is None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts)
    where = {(p.sequence_id, p.offset): p for p in pieces}
    assert len(where) == len(pieces) == len({(p.sequence_id, p.offset) for p in pieces})
    at, rest, total = 0, list(wanted), sum(len(w[2]) for w in wanted)
    while at < total:  # gapless, each document's pieces in a row
        first = where[at // 1024, at % 1024]
        run, done = [], 0
        while done < first.doc_tokens:
            p = where[(at + done) // 1024, (at + done) % 1024]
            assert (p.doc_id, p.start, p.doc_tokens) == (first.doc_id, done, first.doc_tokens) and p.offset + p.length <= 1024
            run.append(p)
            done += p.length
        match = next(w for w in rest if (None if w[0] else w[1]) == first.doc_id and len(w[2]) == done and all(
            zlib.crc32(np.array(w[2][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in run))
        rest.remove(match)
        at += done
    assert rest == [] and sum(p.length for p in pieces) == total
    assert token_packing.pack(docs.where("false")).collect() == []


def test_encoder_equals_the_tokenizer_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = token_packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert mine.encode(t, allowed_special="all") == tokenizer.encode(t, add_special_tokens=False).ids


def test_reply_trees_equal_recursion(spark):
    rng = random.Random(7)
    nodes, parents = [], {}
    for conv in (1, 2, 3, None):
        for n in range(1, 60):
            parents[conv, n] = None if n == 1 or rng.random() < 0.05 else rng.randrange(max(1, n - 4), n)
            nodes.append((conv, n, parents[conv, n], rng.random() if n % 7 else None, "assistant" if n % 2 else "user", f"[INST] </s>\\b t{n} <"))
    nodes.append((9, 1, 2, 1.0, "user", "cycle"))
    nodes.append((9, 2, 1, 1.0, "user", "cycle"))
    frame = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double, role string, text string")
    score = {(c, n): s or 0.0 for c, n, _, s, _, _ in nodes}

    def path(conv, n):
        return ([] if parents[conv, n] is None else path(conv, parents[conv, n])) + [n]

    expected = {}
    for conv in (1, 2, 3, None):
        inner = {p for (c, _), p in parents.items() if c == conv}
        leaves = [(-sum(score[conv, x] for x in path(conv, n)) / len(path(conv, n)), n) for (c, n) in parents if c == conv and n not in inner]
        for rank, (_, leaf) in enumerate(sorted(leaves), 1):
            expected[conv, leaf] = (rank, path(conv, leaf))
    found = {}
    for r in chat_format.leaf_paths(frame, None).collect():
        found.setdefault((r.conv_id, r.leaf), []).append((r.depth, r.node, r["rank"]))
    assert {k: (v[0][2], [n for _, n, _ in sorted(v)]) for k, v in found.items()} == expected
    best = chat_format.leaf_paths(frame, 1)
    back = chat_format.read_back(chat_format.format_paths(best, frame)).collect()
    texts = {(c, n): (role, t) for c, n, _, _, role, t in nodes}
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == [texts[r.conv_id, n] for n in expected[r.conv_id, r.leaf][1]]
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert "[INST] </s>" not in r.formatted


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 0, "assistant", "\\l<[\\"), (2, 5, "assistant", ""), (3, 0, "user", "long " * 50000)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, depth int")
    nodes = chat_format.threads(frame)
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_paths(chat_format.leaf_paths(nodes), nodes)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("user", "a"), ("user", "a")]
    assert back[None].loss_text == "\\l<[\\" and back[2].loss_text == "" and len(back[3].turns[0].text) == 250000
    assert chat_format.threads(frame.where("false")).collect() == []
    assert chat_format.leaf_paths(nodes.where("false")).collect() == []


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://x.com/fr/1?a=/de/", "x.com", "/fr/1", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://example.org", "example.org", "", None, "allow"),
    ("http://a.net?u=b.org/", "a.net", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("x://y.org/a://b", "y.org", "/a://b", "org/", "allow"), ("", "", "", None, "allow"),
])
def test_hand_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h", "t")], "page_id long, url string, html string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (row,) = url_rules.judge(pages, labels).collect()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_mined_rules_equal_counting(spark):
    rng = random.Random(8)
    urls = [(i, f"http://{rng.choice(['spam', 'good', 'mixed'])}.{rng.choice('abc')}.net/{rng.choice(['x', 'y'])}/{i}") for i in range(400)] + [(None, None), (500, "http://spam.a.net/x/1")]
    labels = [(i, int("spam" not in u and rng.random() > 0.1), 0) for i, u in urls[:300]] + [(None, 0, 0), (3, None, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = url_rules.judge(pages, marked).collect()
    assert len(rows) == 402
    for r in rows:
        assert r.verdict == ("block" if r.mined_rule else "allow")
        assert (r.verdict == "block") == r.host.startswith("spam.")
    tokens = url_rules.with_host_path(pages).join(marked.groupBy("doc_id").max("quality").toDF("page_id", "q"), "page_id").where("q is not null").select(
        url_rules.url_tokens().alias("tokens"), (chat_format.F.col("q") == 0).alias("bad"))
    known = [(set(r.tokens), r.bad) for r in tokens.collect()]
    for r in url_rules.mine_rules(tokens).collect():
        hits = [bad for t, bad in known if set(r.antecedent) <= t]
        assert r.confidence == pytest.approx(sum(hits) / len(hits)) and r.confidence >= 0.6
        assert r.support == pytest.approx(sum(hits) / len(known)) and r.support >= 0.004
    assert url_rules.judge(pages.where("false"), marked).collect() == []


def test_last_key_of_a_long_url_decides(spark):
    long = "https://x.test/" + "/".join("abcdefghijkl") + "/page.php?" + "&".join(f"k{c}=1" for c in "abcdefghijkl")
    urls = [(i, long + ("&last=1&final=2" if i % 2 else "&other=1")) for i in range(80)] + [(100, "https://y.test/z?final=1"), (101, long)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    tokens = url_rules.with_host_path(pages.where("page_id = 1")).select(url_rules.url_tokens().alias("t")).first().t
    assert len(tokens) >= 30 and tokens.index("key=last") > 20
    rows = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    assert {r.verdict for i, r in rows.items() if i < 80 and i % 2} == {"block"} and rows[1].mined_rule == "key=last"
    assert rows[100].mined_rule == "key=final" and rows[100].confidence == 1.0
    assert {r.verdict for i, r in rows.items() if i == 101 or i < 80 and i % 2 == 0} == {"allow"}
