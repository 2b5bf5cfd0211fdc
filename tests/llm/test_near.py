"""Piecewise hashes, n-gram join, decontamination and the pipeline against brute force."""

import hashlib
import random
import sys
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import cgk_decontam as cg
from logweave.llm import lsh_forest as lf
from logweave.llm import piecewise_hash as ph
from logweave.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.conftest import SCHEMA, prose, rows_of


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (2 if x != y else 0))
    return row[-1]


def test_likeness_is_one_less_edit_distance():
    rng = random.Random(4)
    sigs = ["".join(rng.choice("AB") + rng.choice("ABC") for _ in range(rng.randint(1, 64))) for _ in range(60)]
    for a, b in zip(sigs, reversed(sigs), strict=True):
        x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
        assert len(x) + len(y) - 2 * ph.common([a], [b])[0] == edit_distance(x, y)
    assert ph.likeness(["8:AAAA:"], ["64:AAAA:"])[0] == 0 and ph.likeness(["8::"], ["8::"])[0] == 1


def test_fingerprint_does_not_depend_on_blocks(monkeypatch):
    data = prose(random.Random(1), 20_000).encode()
    whole = ph.fingerprint(data)
    monkeypatch.setattr(ph, "BLOCK", 4_096)
    assert ph.fingerprint(data) == whole
    assert ph.fingerprint(b"") == "8::" and len(ph.fingerprint(b"a").split(":")[1]) == 2


def test_repeated_lines_are_described_to_the_end():
    rng = random.Random(31)
    none = cut = 0
    for k in range(60):
        line = prose(rng, 20)[:59] + "\n"
        own = (line * 200).encode()
        other = own[:6_000] + prose(rng, 20)[:59].encode() + b"\n" + own[6_060:]
        mark, edited = ph.fingerprint(own), ph.fingerprint(other)
        none += len(mark.split(":")[1]) // 2 < 32
        # one more line at the end leaves the symbols of all chunks before
        more = ph.fingerprint(own + line.encode())
        cut += ph.likeness([mark], [more])[0] < 0.95
        assert ph.likeness([mark], [edited])[0] > 0.9
    assert (none, cut) == (0, 0)


def test_likeness_of_long_signatures():
    rng = random.Random(32)
    for _ in range(30):
        a, b = ([rng.choice("ABC") + rng.choice("AB") for _ in range(rng.randint(1, 150))] for _ in range(2))
        b = rng.choice([b, a[:40] + b + a[60:]])
        x, y = "".join(a), "".join(b)
        assert len(a) + len(b) - 2 * ph.common([x], [y])[0] == edit_distance(a, b)


def check_fingerprints(docs):
    rows = docs.select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    ids = sorted(texts, key=lambda i: (i is not None, i or 0))
    got = {r.doc_id: r for r in ph.fingerprints(docs).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        own, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        prints = [ph.fingerprint(t.encode()) for t in (own, edited, after)]
        assert [r.fingerprint, r.edited_fingerprint] == prints[:2]
        assert (r.near_edited, r.near_next) == (ph.likeness(prints[:1], prints[1:2])[0], ph.likeness(prints[:1], prints[2:])[0])
    return got


def test_fingerprints_of_neighbours(small):
    got = check_fingerprints(small.repartition(3))
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.05 > np.mean([r.near_next for r in long])


def test_fingerprints_of_odd_rows(spark, clashing, none):
    check_fingerprints(clashing.dropDuplicates(["doc_id"]))
    assert ph.fingerprints(clashing).count() == clashing.count()
    assert ph.fingerprints(none).count() == 0
    check_fingerprints(clashing.where("doc_id = 3"))


def sets_of(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_links(rows):
    """(class, links, linked sets) of each row."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    links, different = Counter(), [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 5 * both >= 4 * union:
                for x, y in ((a, b), (b, a)):
                    links[x] += 1
                    if sets[a] != sets[b]:
                        different[x].add(sets[y])
                parent[root(a)] = root(b)
    least = {}
    for v, (i, _) in enumerate(rows):
        key = (i is not None, i or 0)
        least[root(v)] = min(least.get(root(v), key), key)
    name = lambda v: least[root(v)][1] if least[root(v)][0] else None
    return sorted((str(rows[v][0]), str(name(v)), links[v], len(different[v])) for v in range(len(rows)))


def found_links(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_linked_texts) for r in lf.jaccard_links(df).collect())


def near_copies(seed, family, words=80):
    """A family whose members differ in a few words: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = prose(rng, words).split()
    out = []
    for _ in range(family):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(words)] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    texts = [t for s in range(6) for t in near_copies(s, 18)] + [None, "", " ", "a b", "a b", "a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[40])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    expected = brute_links(rows)
    assert found_links(docs) == expected
    monkeypatch.setattr(lf, "BLOCK", 5)  # families of several blocks
    assert found_links(docs) == expected


def test_links_of_the_small_table(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert found_links(small) == brute_links(rows)


def test_shortened_prefix_reaches_the_recall():
    d = lf.matched_depth(0.8)
    assert 1 - (1 - 0.8**d) ** lf.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** lf.TREES


def test_depth_of_a_document_follows_from_its_size(spark):
    for n in range(1, 40):
        possible = [both / union for union in range(n, 3 * n) for both in range(1, n + 1) if both < union and 5 * both >= 4 * union]
        assert lf.least_similarity(n) == min(possible, default=None)
    sizes = spark.range(1, 40).select(lf.F.col("id").cast("int").alias("n")).withColumn("own", lf.own_depth())
    for r in sizes.collect():
        s = lf.least_similarity(r.n)
        assert r.own == (lf.matched_depth(s) if s else None)
        assert s is None or 1 - (1 - s**r.own) ** lf.TREES >= lf.RECALL
    assert lf.levels()[0] == lf.DEPTH and lf.levels()[-1] == lf.matched_depth(0.8) and sorted(lf.levels(), reverse=True) == lf.levels()


def signature_rows(groups, seed):
    """(rid, n, signature): in a group, a byte in twenty differs from the group's; groups share each tree's first eight."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 256, lf.TREES * lf.DEPTH, dtype=np.uint8)
    out = []
    for size in groups:
        base = rng.integers(0, 256, lf.TREES * lf.DEPTH, dtype=np.uint8)
        head = np.arange(lf.TREES * lf.DEPTH) % lf.DEPTH < 8
        base[head] = common[head]
        for _ in range(size):
            own = base.copy()
            own[rng.random(len(own)) < 0.01] = 1
            out.append((len(out), 100, bytearray(own)))
    return out


def test_descent_joins_what_any_pair_under_a_node_would(spark, monkeypatch):
    groups = [90, 40, 3, 1, 1]
    rows = signature_rows(groups, 4)
    first = spark.createDataFrame(rows, "rid long, n int, signature binary").repartition(4)
    low = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
    least = 0.8 - lf.SIGMAS * (0.16 / low.shape[1]) ** 0.5
    root = list(range(len(rows)))
    paths = low.reshape(len(rows), lf.TREES, lf.DEPTH)[:, :, : lf.levels()[-1]]
    for a in range(len(rows)):
        for b in range(a):
            if (paths[a] == paths[b]).all(1).any() and (low[a] == low[b]).mean() >= least and root[a] != root[b]:
                one, other = min(root[a], root[b]), max(root[a], root[b])
                root = [one if r == other else r for r in root]
    expected = {(v, r) for v, r in enumerate(root) if root.count(r) > 1}
    for block in (256, 8):
        monkeypatch.setattr(lf, "BLOCK", block)
        assert {(r.vertex, r.root) for r in lf._families(first).collect()} == expected


def test_blocks_of_wide_nodes_meet_once(spark, monkeypatch):
    """One pass a level and one across blocks, however many levels have wide nodes; a star needs no round."""
    names = []
    for module in (lf, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append(name) or f(df, name))
    monkeypatch.setattr(lf, "BLOCK", 8)
    first = spark.createDataFrame(signature_rows([60, 30, 1], 5), "rid long, n int, signature binary").repartition(4)
    roots = {r.vertex: r.root for r in lf._families(first).collect()}
    assert roots == {v: 0 if v < 60 else 60 for v in range(90)}
    assert names.count("forest-edges") <= len(lf.levels()) + 1 and names.count("forest-contracted") <= 4
    names.clear()
    star = spark.createDataFrame([(v, 0) for v in range(1, 9)] + [(20, 11)], "a long, b long")
    assert {r.vertex: r.root for r in components(star, "t").collect()} == {v: 0 for v in range(9)} | {11: 11, 20: 11}
    assert names == ["t"]


def test_pairs_of_blocks_meet_every_two_families(spark, monkeypatch):
    monkeypatch.setattr(lf, "BLOCK", 4)
    rows = [(n, 100 * n + v, 100 * n + min(v // 9, 2) * 9 if v < 20 else 100 * n + v) for n in range(2) for v in range(30)]
    placed = lf._across(spark.createDataFrame(rows, "node long, cls long, root long")).collect()
    meet = {}
    for r in placed:
        meet.setdefault((r.node, r.i, r.j), []).append(r)
    pairs = {frozenset((a.cls, b.cls)) for m in meet.values() for a in m for b in m if a.root != b.root and (a.side != b.side or a.side == 0)}
    assert pairs == {frozenset((a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    large = [r for r in placed if r.f >= 0]
    assert large and all(len({x.f for x in meet[r.node, r.i, r.j] if x.f >= 0} | {r.f}) in (1, 2) for r in large)
    assert not [m for m in meet.values() if len(m) > 1 and len({(x.f, x.side) for x in m if x.f >= 0}) > len({x.f for x in m if x.f >= 0})]


def test_one_of_each_class(spark, odd, clashing, none):
    kept = lf.one_of_each(clashing)
    assert kept.columns == clashing.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert len(got) == len(set(got))
    ids = [g[0] for g in got]
    assert ids.count("1") == 1 and "6" not in ids and "7" in ids  # 7: the other text of that id
    assert "8" in ids and str(2**60) not in ids and {"2", "3", "4"} <= set(ids)
    assert lf.one_of_each(none).count() == 0 and lf.jaccard_links(none).count() == 0
    assert lf.jaccard_links(odd).count() == odd.count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}


def test_least_edits_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 30))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        assert cg.least_edits(b, cg._pattern(a), len(a)) == min(len(a), min(row))


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.03, 0.97), (0.06, 0.95)])
def test_planted_items_are_found(spark, benchmark_items, rate, least):
    rng = random.Random(int(rate * 100))
    items = benchmark_items.collect()
    docs, planted = [], set()
    for k, item in enumerate(items * 3):
        text = [c for c in item.text for c in ([c] if rng.random() >= rate else rng.choice([[], [c, "q"], ["z"]]))]
        around = prose(rng, 120).split()
        at = rng.randint(0, 120)
        docs.append((k, " ".join([*around[:at], "".join(text), *around[at:]])))
        planted.add((k, item.item_id))
    clean = [(10_000 + k, prose(rng, 150)) for k in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs + clean], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in cg.contaminated(frame, benchmark_items).collect()}
    assert len(got & planted) >= least * len(planted) and max(i for i, _ in got) < 10_000


def test_folded_texts():
    rng = random.Random(8)
    signs = [*" \t\n\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u205f\u3000", "a", "B", "Ä", "\u2010", "中", "\u3001", "🙂"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data, where = cg.folded(np.frombuffer(b"".join(raw), np.uint8), off)
    got = [data[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:], strict=True)]
    assert got == [re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(t.split())) for t in texts]


@pytest.mark.parametrize("gap", ["  ", "\r\n", "\n        ", "\u00a0 "])
def test_items_with_other_white_space_are_found(spark, benchmark_items, gap):
    rng = random.Random(12)
    items = benchmark_items.collect()
    docs = [(k, gap.join([*prose(rng, 60).split(), *i.text.upper().split(), *prose(rng, 60).split()])) for k, i in enumerate(items)]
    got = {(r.doc_id, r.item_id): r.n_edits for r in cg.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark_items).collect()}
    assert all(got.get((k, i.item_id)) == 0 for k, i in enumerate(items) if i.text.isascii())


def test_short_items_equal_brute_force(spark):
    rng = random.Random(21)
    items = [(k, "".join(rng.choice("abcdé 中") for _ in range(n))) for k, n in enumerate([1, 2, 4, 8, 9, 10, 12, 19, 20, 25, 31, 39, 44, 55, 63, 64] * 2)]
    docs = [(-1, None), (-2, ""), (-3, "ab")]
    for k, text in items * 2:
        edited = [c for c in text for c in (rng.choice([[], [c, "q"], ["z"]]) if rng.random() < 0.08 else [c])]
        docs.append((len(docs), "".join([*("".join(rng.choice("fghij ") for _ in range(40))), *edited, *prose(rng, 4)])))
    expected = {}
    for d, text in docs:
        for k, item in items:
            own, other = cg._folded(text), cg._folded(item)
            if other:
                edits = cg.least_edits(own, cg._pattern(other), len(other))
                if edits <= int(cg.MOST_EDITS * len(other)):
                    expected[d, k] = edits
    assert len({k for _, k in expected}) > 20 and max(expected.values()) > 2
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = cg.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.n_edits for r in found} == expected


@pytest.mark.parametrize("size", [60, 70, 90])
def test_items_with_the_most_edits_are_found(spark, benchmark_items, size):
    rng = random.Random(size)
    items = [(i.item_id, i.text[:size]) for i in benchmark_items.collect()]
    docs = []
    for k, (_, text) in enumerate(items * 8):
        signs = list(text)
        for _ in range(int(cg.MOST_EDITS * len(cg._folded(text)))):
            at = rng.randrange(len(signs))
            signs[at : at + 1] = rng.choice([[], [signs[at], "q"], ["z"]])
        docs.append((k, prose(rng, 20) + " " + "".join(signs) + " " + prose(rng, 20)))
    found = cg.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    recall = np.mean([(k, items[k % len(items)][0]) in got for k in range(len(docs))])
    print(size, len(docs), recall)
    assert recall >= 0.99


def test_exact_items_of_the_small_table(spark, small, benchmark_items):
    items, docs = benchmark_items.collect(), small.collect()
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id): r.n_edits for r in cg.contaminated(small, benchmark_items).collect()}
    assert verbatim <= set(got) and all(got[v] == 0 for v in verbatim)
    by_blocks = cg.contaminated(small, benchmark_items, block_bytes=2_000)
    assert {(r.doc_id, r.item_id): r.n_edits for r in by_blocks.collect()} == got
    assert {r.doc_id for r in cg.clean_documents(small, benchmark_items).collect()} == {d.doc_id for d in docs} - {i for i, _ in got}


def test_decontamination_of_odd_rows(spark, clashing, none, benchmark_items):
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "x" * 300), (4, "x" * 300)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in cg.contaminated(clashing, odd_items).collect()}
    assert got == {(5, None), (5, 4)}
    assert cg.contaminated(none, benchmark_items).count() == 0
    assert cg.contaminated(clashing, odd_items.limit(0)).count() == 0
    assert cg.clean_documents(clashing, benchmark_items).columns == clashing.columns


def test_clean_documents_of_one_id_are_told_apart(spark, benchmark_items):
    rng = random.Random(11)
    item = benchmark_items.first().text
    held = prose(rng, 30) + " " + item + " " + prose(rng, 30)
    clean = [(i, prose(rng, 40)) for i in (None, None, 9, 9, 10)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [*clean, (None, held), (9, held), (None, None)]], SCHEMA)
    got = [(r.doc_id, r.text) for r in cg.clean_documents(docs, benchmark_items).collect()]
    assert sorted(got, key=str) == sorted([*clean, (None, None)], key=str)


def test_pipeline_stages(spark, monkeypatch):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF_SMALL)
        assert kept.columns == docs.columns and kept.count() > 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    out = cp.run(spark, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in out} == lengths


def test_rows_without_words_stay_whatever_their_columns(spark):
    rows = [(None, None, "en", "a", 0), (None, "", "en", "b", 0), (None, "", "en", "c", 0), (3, " \n", "en", "a", 2), (3, " \n", "en", "a", 2)]
    rows += [(4, "some words of a text", "en", "a", 5), (4, "some words of a text", "fr", "b", 5), (5, "some words of a text", "en", "a", 5)]
    got = rows_of(lf.one_of_each(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(got, key=repr) == sorted([*rows[:4], *[r for r in got if r[0] == 4]], key=repr) and len(got) == 5
    again = rows_of(lf.one_of_each(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))
    assert sorted(again, key=repr) == sorted(got, key=repr)
