"""SimHash groups against brute force; Golay keys over all cosets."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from logweave.llm import simhash_groups as sg
from logweave.llm import textarrays as ta
from logweave.llm.cgk_decontam import utf8
from tests.llm.conftest import SCHEMA, prose, rows_of


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs; rows: (doc_id, fingerprint)."""
    different = sorted({f for _, f in rows})
    root = {f: f for f in different}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(different, 2):
        if (a ^ b).bit_count() <= 2 and top(a) != top(b):
            root[top(a)] = top(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return sorted([(d, f"{f:016x}", least.get(top(f))) for d, f in rows], key=repr)


def test_words_within_two_bits_share_a_codeword():
    every = np.arange(2048, dtype=np.int64)
    near = sg.codewords(every)  # all syndromes occur among the words below 2048
    assert sorted(np.unique(sg.syndromes(every)).tolist()) == list(range(2048))
    assert set((near >= 0).sum(1).tolist()) == {1, 6}
    for w in (1, 2):
        for c in combinations(range(23), w):
            other = sg.codewords(every ^ sum(1 << b for b in c))
            shared = (near[:, :, None] == other[:, None, :]) & (near >= 0)[:, :, None]
            assert shared.any((1, 2)).all()


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(5)
    own = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flips = [0, *[1 << b for b in range(64)], *[(1 << a) | (1 << b) for a, b in combinations(range(64), 2)]]
    for fp in own[:12]:
        mine = set(sg.keys(np.array([fp]))[1].tolist())
        others = np.array([int(fp) & (2**64 - 1) ^ f for f in flips], np.uint64).view(np.int64)
        row, key = sg.keys(others)
        hit = np.isin(key, list(mine))
        assert set(row[hit].tolist()) == set(range(len(flips)))


def test_fingerprints_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 3_000).replace("a ", "A\t\n "), "", " \n", "One", "one  TWO", "x" * 900, "a b c", "é  B\x0bc D\x1f e", prose(rng, 50)]
    monkeypatch.setattr(sg, "COUNTED", 257)
    for texts_ in (texts, texts[:1]):
        data, off = utf8(pa.array(texts_))
        want = [fingerprint(t) for t in texts_]
        assert sg.fingerprints(data, off).view(np.uint64).tolist() == want
    monkeypatch.setattr(ta, "PIECE_CHARS", 100)
    for text in [*texts, "one " + "y" * 500, " " * 700 + "a b", ("w" * 99 + " ") * 9]:
        data, off = utf8(pa.array([text]))
        counts, n = sg._long_counts(data)
        whole = sg.bit_counts(data, off)
        assert (counts == whole[0]).all() and n.tolist() == whole[1].tolist(), text[:20]


def test_near_duplicates_equal_brute_force(spark, small, odd, clashing, none):
    for docs in (small, odd, clashing):
        rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        found = sg.near_duplicates(docs)
        assert found.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(rows_of(found), key=repr) == groups(rows)
    assert sg.near_duplicates(none).count() == 0


def test_buckets_of_any_size_give_the_same_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    some = {base}
    for _ in range(700):  # a cloud of neighbours, chained by up to three bits
        f = rng.choice(sorted(some))
        for _ in range(rng.choice([1, 2, 2, 3])):
            f ^= 1 << rng.randrange(64)
        some.add(f)
    some |= {rng.getrandbits(64) for _ in range(300)}
    rows = list(enumerate(sorted(some)))
    want = {d: c for d, _, c in groups(rows)}
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in rows], "fp long, least long").cache()
    from logweave.llm.components import components

    for bucket in (1, 8, 256):
        roots = {r.vertex: r.root for r in components(sg.links(signed, bucket), "t").collect()}
        own = {f - (1 << 64) if f >> 63 else f: d for d, f in rows}
        least = {}
        for f, d in own.items():
            least[roots.get(f, f)] = min(d, least.get(roots.get(f, f), d))
        assert {d: least[roots.get(f, f)] for f, d in own.items()} == want, bucket


def test_very_long_text(spark):
    rng = random.Random(2)
    text = prose(rng, 500_000)
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (3, "z" * 3_000_000, "en", "a", 1)], SCHEMA)
    got = {r.doc_id: r for r in sg.near_duplicates(docs).collect()}
    assert int(got[1].fingerprint, 16) == fingerprint(text) and got[1].component_id == got[2].component_id == 1
    assert int(got[3].fingerprint, 16) == fingerprint("z" * 3_000_000) and got[3].component_id == 3
