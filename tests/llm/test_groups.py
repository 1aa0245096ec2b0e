"""Components, near-duplicates and decontamination against brute force."""

import random

import pytest
import xxhash

from veriframe.llm import decontaminate, simhash_dedup
from veriframe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, table int, key string, fp string"


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def docs_frame(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "f") for i, t in texts], DOCS)


def slow_print(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(50, i) for i in range(40)], [(0, i) for i in range(1, 40)],
])
def test_components_of_shapes(spark, edges):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e}
    assert {n: found.get(n, n) for n in nodes} == union_find(edges, nodes)


def test_components_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e}
    assert {n: found.get(n, n) for n in nodes} == union_find(edges, nodes)


def test_every_pair_within_the_radius_shares_a_mask():
    rng, masks = random.Random(2), simhash_dedup.covering_masks(4)
    assert len(masks) == 31 and all((m & (1 << 64) - 1).bit_count() == 32 for m in masks)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \n", "one", "A b\x0bc", "É É é É x", "a a a a a a a", "a b " * 20000, "a\u00a0b c d e"):
        assert simhash_dedup.fingerprint((text or "").encode()) == slow_print(text)


@pytest.mark.parametrize("block", [3, 4096])
def test_groups_equal_brute_force(spark, block):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(150)) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 150):
        words = rng.choice(base[:4]).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new" + str(i)
        texts.append((i, " ".join(words)))
    texts += [(200, None), (201, ""), (202, " \n "), (7, base[7]), (None, base[0]), (203, "short one"), (204, "SHORT  one")]
    rows = simhash_dedup.near_duplicates(docs_frame(spark, texts), block=block).collect()
    prints = [(i, slow_print(t)) for i, t in texts if i is not None]
    links = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 4]
    groups = union_find(links, {i for i, _ in prints})
    expected = sorted((i, f"{p:016x}", groups[i]) for i, p in prints)
    assert sorted(map(tuple, rows)) == expected
    assert len(set(groups.values())) < len(prints)


def test_keys_of_prints_are_not_broadcast(spark):
    classes = spark.range(50).selectExpr("id AS node", "id * 7919 AS fp")  # a table whose size Spark knows
    plan = simhash_dedup.bucket_edges(classes, 4, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_document_of_a_group_stays(spark):
    text = "the same words in every copy of this small text"
    docs = docs_frame(spark, [(5, text), (3, text), (3, text), (9, "something else that nobody wrote before"), (None, "x")])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_empty_tables(spark):
    none = docs_frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash_dedup.near_duplicates(none).collect() == []
    assert decontaminate.passages(none, bench).collect() == []
    assert decontaminate.passages(docs_frame(spark, [(1, "a b c d e f")]), bench).collect() == []


def slow_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if ord(c) < 128 and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def slow_similarity(a, b):
    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    weight = lambda s: sum(min(255, sum(len(w) for w in x)) for x in s)
    a, b = shingles(a), shingles(b)
    return weight(a & b) / weight(a | b) if a | b else 0.0


def test_contaminated_documents_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sample = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, sample(rng.randint(12, 60))) for i in range(20)]
    bench = [(i, " ".join(w)) for i, w in items] + [(100, items[0][1][0]), (101, None), (102, ""), (103, " ".join(items[3][1])), (None, "a b c d e f")]
    texts = [(0, None), (1, ""), (2, " ".join(sample(3000)))]
    for i in range(110, 250):
        passage = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            passage[rng.randrange(len(passage))] = "changed"
        if rng.random() < 0.3:
            passage = passage[rng.randint(0, 4) :]
        before, after = sample(rng.randint(0, 40)), sample(rng.randint(0, 40))
        texts.append((i, " ".join(before).upper() + " - " + ", ".join(passage).title() + "! " + "\n".join(after)))
    texts.append((300, " ".join(items[5][1] * 3)))
    docs, items_df = docs_frame(spark, texts), spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.passages(docs, items_df).where("n_words >= 5").collect()
    expected, split = {}, {i: slow_words(text) for i, text in texts}
    for i, words in split.items():
        for item, target in items:
            best = max((slow_similarity(words[s : s + len(target)], target) for s in range(len(words))), default=0.0)
            if best >= 0.8:
                expected[i, item] = best
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(expected) > 40 and len(set(expected) - set(got)) <= len(expected) // 50
    for (doc, item), r in got.items():  # what is reported is exact, and no worse than the best item-sized window
        passage = split[doc][r.start_word : r.start_word + r.n_words]
        assert abs(slow_similarity(passage, items[item][1]) - r.similarity) < 1e-9 and r.similarity >= 0.8
        assert r.similarity >= expected.get((doc, item), 0.8) - 1e-9 and r.hamming <= decontaminate.RADIUS
    assert {r.item_copies for r in found if r.item_id == 3} <= {2}
    short = {r.doc_id for r in decontaminate.passages(docs, items_df).where("item_id = 100").collect()}
    assert short == {i for i, words in split.items() if items[0][1][0] in words}
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 10)
    assert sorted(decontaminate.passages(docs, items_df).where("n_words >= 5").collect()) == sorted(found)


def test_block_index_loses_nothing_within_the_radius():
    rng, flips = random.Random(5), set(decontaminate.flip_masks())
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any((diff >> 16 * b & 0xFFFF) in flips for b in range(4))


def edited_passages(seed, n_items, n_texts):
    """Items and texts that hold them with ends missing, words inserted, left out or changed, and a changed tail."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    sample = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, sample(rng.randint(12, 60))) for i in range(n_items)]
    texts = []
    for i in range(n_texts):
        passage = list(rng.choice(items)[1])
        cut = rng.randint(0, len(passage) // 5)
        kind = rng.choice(["start", "end", "both", "insert", "leave", "tail", "twice"])
        if kind in ("start", "both"):
            passage = passage[cut:]
        if kind in ("end", "both"):
            passage = passage[: len(passage) - cut]
        if kind == "tail":
            passage[len(passage) - cut :] = sample(cut)
        for _ in range(rng.randint(1, 3) if kind == "insert" else 0):
            passage.insert(rng.randrange(len(passage)), rng.choice(["inserted", "x"]))
        if kind == "leave":
            del passage[rng.randrange(len(passage))]
        texts.append((i, " ".join(sample(rng.randint(0, 15)) + passage * (2 if kind == "twice" else 1) + sample(rng.randint(0, 15)))))
    return items, texts


def best_passage(words, target, longest=2):
    best = (0.0, 0, 0)
    for start in range(len(words)):
        for size in range(5, min(int(-(-len(target) * longest // 1)), len(words) - start) + 1):
            best = max(best, (slow_similarity(words[start : start + size], target), -start, -size))
    return best


def test_passages_of_any_length_equal_brute_force(spark):
    items, texts = edited_passages(6, 5, 24)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = docs_frame(spark, [*texts, (None, " ".join(items[0][1])), (500, None), (501, "")])
    found = {(r.doc_id, r.item_id): r for r in decontaminate.passages(docs, bench).collect()}
    expected = {}
    for i, text in [*texts, (None, " ".join(items[0][1]))]:
        for item, target in items:
            if set(zip(*[text.split()[k:] for k in range(5)])) & set(zip(*[target[k:] for k in range(5)])):
                best = best_passage(text.split(), target)
                if best[0] >= 0.8:
                    expected[i, item] = best
    split = {i: text.split() for i, text in [*texts, (None, " ".join(items[0][1]))]}
    assert set(found) <= set(expected) and len(found) >= 0.9 * len(expected) > 9
    for (doc, item), r in found.items():
        passage = split[doc][r.start_word : r.start_word + r.n_words]
        assert abs(slow_similarity(passage, items[item][1]) - r.similarity) < 1e-9
    assert sum(abs(r.similarity - expected[k][0]) < 1e-9 for k, r in found.items()) >= 0.9 * len(found)
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in found} | {500, 501}
    assert {r.item_copies for r in found.values()} == {1}


def slow_window_print(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) & ~255 | len(w) for w in words]
    hashes = [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42) for h in hashes]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_far_prints_are_no_reason_to_miss_a_passage(spark):
    rng, items, texts = random.Random(8), [], []
    while len(items) < 5:
        target = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(15, 40))]
        passage = target[: len(target) - len(target) // 7]
        far = (slow_window_print(passage) ^ slow_window_print(target)).bit_count() > 11
        if far and slow_similarity(passage, target) >= 0.8:
            items.append((len(items), " ".join(target)))
            texts.append((len(texts), " ".join(["before", *passage, "behind"])))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), docs_frame(spark, texts)
    found = decontaminate.passages(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in found) == [(i, i, 1) for i in range(5)]
    assert decontaminate.remove_contaminated(docs, bench).collect() == []


def test_keys_of_items_are_not_broadcast(spark):
    items = decontaminate._items(spark.range(1).selectExpr("id AS item_id", "'one two three four five six' AS text"))
    places = spark.createDataFrame([(1, 0, 6, 0, [5, 6, 7, 8, 9, 10])], "key long, start int, length int, from int, hashes array<long>")
    plan = decontaminate.close_prints(places, items)._jdf.queryExecution().executedPlan().toString()
    below = [part.split("\n")[:6] for part in plan.split("BroadcastExchange")[1:]]
    assert not any("Generate explode" in line for part in below for line in part) and "SortMergeJoin" in plan


def test_long_items_take_time_in_proportion(spark):
    import time

    took = []
    for n in (400, 1600):
        rng = random.Random(n)
        target = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
        bench = spark.createDataFrame([(0, " ".join(target))], "item_id long, text string")
        docs = docs_frame(spark, [(i, " ".join(["x", *target[: n - i], "behind"])) for i in range(4)])
        start = time.time()
        assert {r.doc_id for r in decontaminate.passages(docs, bench).collect()} == {0, 1, 2, 3}
        took.append(time.time() - start)
    assert took[1] < 3 * took[0] + 5


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(0, "one two three four five six"), (1, "a b")], "item_id long, text string")
    plan = decontaminate.passages(docs_frame(spark, [(1, "one two three four five six")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
