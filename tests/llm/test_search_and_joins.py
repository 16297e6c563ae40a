"""Phrases, ranked search and the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, log

import numpy as np
import pytest

from lodestone.llm import jaccard, phrases, ranked, shinglesets

SCHEMA = "doc_id long, text string, lang string, phrase string, score double, k long, id long, part int, n long, item_id long, size int, root long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 0.5, 9, 9, 9, 9, 9, 9, 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Texts of few words with copies, breaks, nulls, repeated ids and one very long text."""
    r = random.Random(3)
    vocabulary = ["The", "of", "new", "york", "new york stock exchange", "New York", "the new york", "É", " ", "a\x1cb", "été", "x1"]
    out = [(1, None, "en"), (2, "", None), (3, " \t\n", "de"), (4, "New York!", None), (None, "new york stock exchange " * 40, "en"), (None, None, None)]
    for i in range(5, 160):
        n = r.choice([0, 3, 30, 200])
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(n))
        out.append((i, text, r.choice(["en", "de", None])))
    out += [(7, "the new york stock exchange of new york", "en")] * 3 + [(500, " ".join(r.choice(vocabulary) for _ in range(60_000)), "en")]
    return out


def brute_phrases(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in often.items()):
                continue
            score, k = min((floor(Fraction(2_000_000 * a, counts[p[:k]] + counts[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def test_phrases(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = brute_phrases(rows, 30, 300)
    assert len(wanted) > 60 and any(len(x[2].split(" ")) == 4 for x in wanted)
    found = phrases.phrases(docs, first=300)
    assert found.columns == columns and sorted(map(tuple, found.collect())) == wanted
    # Containers burst, tries spill, words are forgotten, and filters let everything through.
    for name, value in (("BURST", 16), ("PATHS", 60), ("WORDS", 8), ("GROUP_BYTES", 500), ("PART_WORDS", 700)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases.Filter, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    assert sorted(map(tuple, phrases.phrases(docs, first=300).collect())) == wanted
    assert phrases.phrases(docs.where("false")).count() == 0
    assert phrases.phrases(docs.where("text is null")).count() == 0


def test_trie_bursts_and_spills_sorted_runs():
    r = random.Random(1)
    trie, counts = phrases.Trie(4, burst=20), Counter()
    for _ in range(60):
        batch = Counter(sum(r.choice([1, 1, 2, 5]) << k * phrases.ID_BITS for k in range(4)) + r.randint(0, 40) for _ in range(50))
        counts.update(batch)
        trie.add(sorted(batch), [batch[p] for p in sorted(batch)])
    assert trie.size == len(counts) and len(trie.boxes) > 5 and max(map(len, trie.boxes)) <= 20
    assert trie.starts == sorted(trie.starts)
    paths, run = trie.spill(len(counts) // 2)
    assert paths == sorted(paths) and trie.size <= len(counts) // 2
    rest, more = trie.spill(0)
    assert dict(zip(paths + rest, run + more, strict=True)) == counts and trie.size == 0


def brute_ranked(rows, items, k=10):
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = lambda t: [x.translate(lower) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(-1 if i is None else i, Counter(terms(t))) for i, t, _ in rows]
    held = [c for _, c in docs if c]
    nn, ll = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * nn) // ll
            s = sum(floor(1000 * log((2 * nn + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, None if i < 0 else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked(spark, rows, monkeypatch):
    items = [(1, "new York, new york"), (2, "été of the É"), (3, "nothing-here zzz"), (4, None), (5, ""), (6, "the of new york stock exchange x1"), (6, "the of new york stock exchange x1"), (None, "x1 x1 stock")]
    docs, asked = frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    wanted = brute_ranked(rows, items)
    assert len(wanted) >= 40
    found = ranked.ranked(docs, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    for name, value in (("SHARD_DOCS", 20), ("WINDOW", 7), ("BLOCK", 3), ("ITEM_BYTES", 40)):
        monkeypatch.setattr(ranked, name, value)
    assert sorted(map(tuple, ranked.ranked(docs, asked).collect()), key=repr) == wanted
    assert ranked.ranked(docs.where("false"), asked).count() == ranked.ranked(docs, asked.where("false")).count() == 0


def test_blocks_are_turned_away_before_they_are_read():
    """A rare strong term, strongest at first, and a common weak one: most blocks of the latter stay packed."""
    n = 16_000
    rare = np.arange(0, n, 160)
    docs = np.concatenate([np.arange(n), rare])
    term = np.concatenate([np.zeros(n, np.int32), np.ones(len(rare), np.int32)])
    order = np.argsort(docs, kind="stable")
    tf = np.where((docs[order] <= rare[9]) & (term[order] == 1), 9, 1).astype(np.int32)
    held = np.bincount(docs, minlength=n)
    ids = np.arange(n)
    shard = ranked.Shard(ids, np.full(n, 50), held, term[order], tf, np.array([3, 5000]), n, 50 * n)
    blocks = len(shard.lists[0].blocks)
    scores, best = shard.search([(0, 1), (1, 1)], (np.empty(0, np.int64), np.empty(0, np.int64)), 10)
    assert best.tolist() == rare[:10].tolist() and shard.decoded < blocks // 2


def brute_links(rows, n=5):
    sets = []
    for i, text, _ in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))) if w]
        sets.append((i, {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()))
    root = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * len(a | b) and root[x] != root[y]:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = [new if r == old else r for r in root]
    out = []
    for x, (i, a) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if root[y] == root[x] and sets[y][0] is not None]
        out.append((i, len(a), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def near():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = [(1, None, "en"), (2, "", "en"), (None, " ", "en"), (3, "one", "en"), (3, "two words", "en"), (3, "two words", "en"), (4, "Two\twords", "en"), (5, "ß É", "en"), (6, "a b c d e", "en"), (None, "a b c d e", "en"), (None, "only null", "en")]
    out.append((7, " ".join(f"w{i % 977}" for i in range(30_000)), "en"))
    i = 10
    for _ in range(30):
        base = [word() for _ in range(r.choice([6, 24, 120, 500]))]
        if r.random() < 0.5:
            base[3:3] = passage  # shared by texts that are not alike
        for _ in range(5):
            edited = list(base)
            for at in r.sample(range(len(base)), r.choice([0, 1, max(1, len(base) // 46), max(1, len(base) // 44), max(1, len(base) // 40)])):
                edited[at] = word()
            out.append((i, " ".join(edited), "en"))
            i += 1
    return out


def test_jaccard_join(spark, near, monkeypatch):
    docs = frame(spark, near)
    wanted = brute_links(near)
    found = jaccard.joined(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    monkeypatch.setattr(shinglesets, "FEW_IDS", 0)
    monkeypatch.setattr(shinglesets, "CELL_TOKENS", 100)
    monkeypatch.setattr(shinglesets, "SLAB_BYTES", 3000)
    # Bounds that turn nothing away: false entries are counted and made good.
    monkeypatch.setattr(shinglesets, "most_different", lambda s: lambda a, b: np.full(len(a), 512))
    monkeypatch.setattr(jaccard, "bounds", lambda s: shinglesets.Bounds(shinglesets.PARITY_WORDS, shinglesets.parities, lambda a, b: np.full(len(a), 512), lambda a, b: np.full(len(a), 512)))
    assert sorted(map(tuple, jaccard.joined(docs, tile=16).collect()), key=repr) == wanted
    assert jaccard.joined(docs.where("false")).count() == 0


def test_parities_bound_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 30, 700):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], r.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        bits = np.bitwise_count(np.frombuffer(shinglesets.parities(a), np.uint8) ^ np.frombuffer(shinglesets.parities(b), np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))
    rows = [np.array([1, 5, 9], np.uint64), np.array([5, 9, 11, 12], np.uint64), np.array([], np.uint64)]
    assert shinglesets.overlaps(rows, np.array([0, 1, 0, 1]), np.array([1, 0, 2, 1])).tolist() == [2, 2, 0, 4]
