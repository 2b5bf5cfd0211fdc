"""Conversation trie against brute force; the fingerprint's monoid against plain integers."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from logweave.llm import conversation_trie as ct
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows_of

P = (1 << 61) - 1
TURN = "conv_id long, turn long, role string, text string"


def trie(rows):
    """The whole result by building every sequence; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        low = c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(low, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        worth = (len(m) - 1) * len(s[-1][1]) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += worth
            leaves[s[:d]] += not children[s]
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def forked(rng, groups):
    """Conversations that share turns with their bases and with one another, ties and odd values included."""
    rows = []
    for g in groups:
        for c in sorted({g, *[g + rng.randrange(100) for _ in range(12)]}):
            if c == g and rng.random() < 0.2:
                continue
            for k in range(rng.randint(1, 9)):
                rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "yes", "no é", "🙂" * 3, "a longer answer"])))
    return rows


def test_times_and_sums_equal_plain_integers():
    rng = random.Random(1)
    a = [rng.randrange(P) for _ in range(500)] + [0, 1, P - 1, P - 1]
    b = [rng.randrange(P) for _ in range(500)] + [P - 1, 0, P - 1, 1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert ct.times(x, y).tolist() == [m * n % P for m, n in zip(a, b, strict=True)]
    assert ct.minus(x, y).tolist() == [(m - n) % P for m, n in zip(a, b, strict=True)]
    total = 0
    for got, m in zip(ct.sums(x).tolist(), a, strict=True):
        total = (total + m) % P
        assert got == total
    assert ct.powers(3, 70).tolist() == [pow(3, k, P) for k in range(71)]


def test_scan_in_any_pieces_gives_the_same_products():
    rng = np.random.default_rng(3)
    conv = np.repeat([1, 2, 5, 6], [1, 400, 3, 90])
    refs = rng.integers(0, 2**63, (len(conv), 4), dtype=np.int64).view(np.uint64)
    want = []
    for c in (1, 2, 5, 6):
        total = [0, 0]
        for k, t in enumerate(refs[conv == c].tolist(), 1):
            total = [(x + t[lane] * pow(ct.bases_of(0)[lane], k, P)) % P for lane, x in enumerate(total)]
            want.append((k, *total))
    for cuts in ([], [1], [0 + 37, 200, 401, 404, 450], list(range(1, len(conv)))):
        ends, rows = [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(conv)], strict=True)):
            scan, got = ct._Scan(ct.bases_of(0)), []
            for at in range(a, b, 50):
                to = min(at + 50, b)
                place, product = scan.rows(conv[at:to], refs[at:to])
                got += list(zip(conv[at:to].tolist(), place.tolist(), *[x.tolist() for x in product], strict=True))
            ends.append((part, scan.conv, scan.count, tuple(scan.total), scan.first))
            rows.append(got)
        before = ct.carries(ends, ct.bases_of(0))
        found = []
        for part, got in enumerate(rows):
            for c, place, *product in got:
                if part in before and before[part][0] == c:
                    _, n, total = before[part]
                    product = [(t + pow(ct.bases_of(0)[k], n, P) * x) % P for k, (t, x) in enumerate(zip(total, product, strict=True))]
                    place += n
                found.append((place, *product))
        assert found == want, cuts[:3]


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 3)
    rows = forked(random.Random(6), [0, 100, 300, 2**40 * 100, -300, -100])
    rows += [(None, 1, "user", "nowhere"), (None, None, None, None), (7, 1, "user", "yes"), (7, 1, "user", "yes")]
    made = spark.createDataFrame(rows, TURN).repartition(4)
    assert sorted(rows_of(ct.prefix_trie(made)), key=repr) == trie(rows)
    real = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    assert sorted(rows_of(ct.prefix_trie(real)), key=repr) == trie([tuple(r) for r in real.select("conv_id", "turn", "role", "text").collect()])


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 16)
    rows = [(200, k, "user", f"turn {k // 2}") for k in range(700)] + [(200 + c, k, "user", f"turn {k // 2}" if k < 9 * c else "else") for c in range(1, 20) for k in range(10 * c)]
    assert sorted(rows_of(ct.prefix_trie(spark.createDataFrame(rows, TURN))), key=repr) == trie(rows)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 7)
    rows = [(c, k, "user", f"same {k}") for c in range(0, 600) for k in range(7)]
    assert sorted(rows_of(ct.prefix_trie(spark.createDataFrame(rows, TURN))), key=repr) == trie(rows)


def test_equal_fingerprints_of_different_turns_begin_again(spark, monkeypatch):
    """Base -1 only adds turns up, by turns positive and negative."""
    real = ct.bases_of
    seeds = []

    def weak(seed):
        seeds.append(seed)
        return [P - 1, P - 1] if seed == 0 else real(seed)

    monkeypatch.setattr(ct, "bases_of", weak)
    rows = []
    for c, own in ((101, "axb"), (201, "bxa"), (301, "axbq"), (401, "bxaq")):  # no bases: a head is left out
        rows += [(c, k, "u", t) for k, t in enumerate("f" * (zlib.crc32(str(c).encode()) % 6) + own)]
    assert sorted(rows_of(ct.prefix_trie(spark.createDataFrame(rows, TURN))), key=repr) == trie(rows)
    assert max(seeds) >= 1


def test_odd_tables(spark):
    none = spark.createDataFrame([], TURN)
    assert ct.prefix_trie(none).count() == 0
    rows = [(1, None, None, None), (1, None, None, ""), (2, 1, "user", "x" * 3_000_000), (None, 0, "user", "x")]
    made = spark.createDataFrame([(*r, "own", 1, "own") for r in rows], TURN + ", depth string, place long, ref string")
    assert sorted(rows_of(ct.prefix_trie(made)), key=repr) == trie(rows)
