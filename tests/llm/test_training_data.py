"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, chat, fmindex, jaccard, langid, mtree, packing, quality, queries, repeats, shinglesets, simhash, suffixsort, toxicity
from lodestone.llm.components import components
from lodestone.llm.pieces import pieces

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part long"


def words(t):
    return [w for w in SPACE.split(t or "") if w]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages, repeats, nulls and odd characters."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 5))) for _ in range(60)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(4)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "A b"), (5, "x" * 400), (6, "ab " * 300), (None, "no id here " * 20), (7, "  two  spaces   nbsp\n\nlines <|endoftext|> 12'll ok"), (7, "  two  spaces")]
    for i in range(8, 70):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 1), r.choice(passages))
        out.append((i, r.choice([" ", "\n"]).join(parts)))
    out += [(100 + i, out[20 + i][1]) for i in range(10)] + [(120 + i, (out[30 + i][1] or "") + " tail") for i in range(5)] + [(200, out[25][1] * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(i), wanted.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(bytes(r.decoded) for r in found) == sorted((t or "").encode() for _, t in rows)
    digests = bpe.digest_documents(docs, path, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows for ids in [wanted.encode_ordinary(t or "")]
    )
    assert bpe.digest_documents(empty, path, public_tokenizers.PATTERN).count() == 0
    table = bpe.PerfectHash(list(ranks)[:5000])
    assert sorted(table.slot(k) for k in list(ranks)[:5000]) == list(range(5000)) and table.slot(b"\x00no key") == -1


def test_pieces():
    for t in ("", " ", "a", " a", "a ", "a  b c", "a \nb c", "x y z w"):
        assert "".join(pieces(t)) == t


def test_packing_ids_on_random_strings(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, r = Tokenizer.from_file(path), packing.PieceEncoder(path), random.Random(9)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "'LL", "1", "23", "é", "中", "🙂", "-", "...", "<|endoftext|>", "\r\n", "\x1c", "\u2028"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    data = json.load(open(path, encoding="utf-8"))
    (tmp_path / "t.json").write_text(json.dumps(data | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError, match="normalizer"):
        packing.load_encoding(str(tmp_path / "t.json"))


#: A row of every awkward kind: clashing names, a very long text, repeated rows, nulls.
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, part long, cell long, fingerprint string, bits long, key string, n_words long, sequence_id long, kept boolean, root long, k long, held_out boolean, predicted int"


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    texts = [(1, long), (2, "short text of some words here"), (2, "short text of some words here"), (3, None), (None, "no id"), (4, "")]
    return spark.createDataFrame([(i, t, "en", None, 1, 0.5, 9, 9, "x", 9, "x", 9, 9, True, 9, 9, True, 1) for i, t in texts], AWKWARD)


def test_awkward_rows(spark, awkward):
    """Clashing column names, a text of 120,000 words, repeated rows and nulls in every operator."""
    n = awkward.count()
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (None, 1, "z"), (2, None, "z")], "doc_id long, toxic int, text string")
    ranks, plain = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    assert toxicity.toxicity(awkward, labels).count() == n
    digests = bpe.digest_documents(awkward, ranks, public_tokenizers.PATTERN).collect()
    text = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in digests) and len(digests) == n
    judged = {r.doc_id: r for r in quality.quality_rules(awkward).collect()}
    assert judged[1].n_words == 120_000 and judged[3].n_words == 0 and judged[3].base_failed
    for dedup in (fmindex.substring_dedup, suffixsort.suffix_dedup):
        found = {r.doc_id: r for r in dedup(awkward, part_bytes=10_000).collect()}
        assert len(found) == 5 and found[2].n_removed == found[3].n_units == 0
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == n and {r.component_id for r in found if r.doc_id in (3, 4)} == {3}
    assert langid.identify(awkward).count() == n
    packed = packing.pack_documents(awkward, plain).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and packed.length.sum() / (packed.sequence_id.nunique() * 2048) > 0.9
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == corpus_pipeline.COLUMNS, name


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path, capacity=256, part=64, group=16).toPandas()
    loads = found.groupby("sequence_id").length.sum()
    assert loads.max() <= 256
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    wanted = defaultdict(int)
    for _, t in rows:
        wanted[len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert found.length.sum() == sum(k * v for k, v in wanted.items())
    text = dict(rows)
    for r in found[found.doc_id.between(8, 69)].itertuples():
        ids = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()))
    assert packing.pack_documents(empty, path).count() == 0
    assert sorted(sum(packing.difference([7, 6, 5, 5, 4], 2), [])) == [0, 1, 2, 3, 4]


def test_fm_index_dedup(docs, rows, empty):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 60), -1 if i is None else i)
    wanted = []
    for i, t in rows:
        w = words(t)
        gone = [0] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (-1 if i is None else i):
                gone[k : k + 13] = [1] * 13
        wanted.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    for options in ({}, {"contents": 2, "share": 1}):
        found = fmindex.substring_dedup(docs, part_bytes=2000, carry=("lang", "source"), **options).collect()
        assert sorted((str(r.doc_id), r.n_units, r.n_removed, bytes(r.kept).decode()) for r in found) == sorted(wanted)
    assert sum(w[2] for w in wanted) > 0 and fmindex.substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    earliest = {}
    order = lambda i, k: (-1 if i is None else i, k)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            earliest[b[k : k + 100]] = min(earliest.get(b[k : k + 100], (1 << 60, 0)), order(i, k))
    wanted = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if earliest[b[k : k + 100]] < order(i, k):
                gone[k : k + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        wanted.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    for options in ({}, {"contents": 2, "share": 1}):  # the latter: nearly all anchors are hot
        found = suffixsort.suffix_dedup(docs, part_bytes=3000, **options).collect()
        assert sorted((str(r.doc_id), r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(wanted)
    assert suffixsort.suffix_dedup(empty, as_text=True).count() == 0


def test_suffix_sort_verifies_collisions(monkeypatch):
    monkeypatch.setattr(suffixsort.Prefix, "hash", lambda self, a, b: np.zeros(len(a), np.uint64))
    contents = [b"a" * 100 + b"x", b"b" * 100 + b"y", b"a" * 100 + b"z"]
    key, two = np.zeros(3, np.uint64), np.full(3, 2)
    doc, start = suffixsort.earliest(contents, key, np.zeros(3, np.int64) + 50, two, np.array([5, 3, 9]), np.array([0, 0, 4]), 100)
    assert list(zip(doc, start, strict=True)) == [(5, 0), (5, 1), (3, 0), (3, 1), (5, 0), (9, 5)]


def test_wavelet_and_segments():
    values = np.random.default_rng(1).integers(0, 13, 500)
    tree = fmindex.WaveletTree(values, 4)
    symbol, low, high = np.arange(13), np.full(13, 77), np.full(13, 421)
    a, b = tree.rank(symbol, high, low)
    assert list(a) == [(values[:77] == s).sum() for s in symbol] and list(b) == [(values[:421] == s).sum() for s in symbol]
    lists = [list(np.random.default_rng(i).integers(1, 4, size=i % 9 + 1)) for i in range(80)]
    lists = [list(x) for x in sorted({tuple(map(int, x)) for x in lists})]
    joined = np.concatenate([[*x, 0] for x in lists]).astype(np.int64)
    sizes = np.array([len(x) for x in lists])
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    longest, lower = fmindex.FmIndex(joined, int(sizes.max())).statistics(joined, begin, sizes)
    every = [tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    groups = defaultdict(set)
    for b, x in zip(begin, lists, strict=True):
        for i in range(len(x)):
            most = max((n for n in range(1, len(x) - i + 1) if every.count(tuple(x[i : i + n])) > 1), default=0)
            assert longest[b + i] == most
            if most:
                groups[tuple(x[i : i + most])].add(int(lower[b + i]))
    assert all(len(g) == 1 for g in groups.values())
    # Long intervals: many equal contents, so places move over whole blocks of common prefixes.
    same = np.tile(np.array([1, 2, 3, 4, 5, 0]), 300)
    begin, sizes = np.arange(300) * 6, np.full(300, 5)
    longest, lower = fmindex.FmIndex(same, 5).statistics(same, begin, sizes)
    assert (longest.reshape(-1, 6) == [5, 4, 3, 2, 1, 0]).all() and len(set(lower.reshape(-1, 6)[:, 0])) == 1
    big = np.random.default_rng(3).integers(1, 1 << 16, 200_000)
    big[79::80] = 0
    index = fmindex.FmIndex(big, 80)
    assert index.nbytes() - index.first.nbytes < 5 * len(big)
    texts = ["q" * 50, None, "lorem ipsum " * 9000]  # longer than one slice
    s = repeats.Segments(repeats.Bytes(100), texts)
    assert s.runs[s.text == 2].sum() == len(texts[2]) - 99


def test_hot_anchors_are_split(spark):
    """One line in all documents with differing surroundings: results hold, and no key of the
    split segments keeps the contents of all documents."""
    r = random.Random(8)
    line = " ".join(f"common{i:02d}" for i in range(30))
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(25))
    rows = [(i, f"{text()} {line} {text()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup, scheme in ((suffixsort.suffix_dedup, repeats.Bytes()), (fmindex.substring_dedup, repeats.Words())):
        found = {x.doc_id: bytes(x.kept) for x in dedup(docs, part_bytes=20_000, contents=50, share=1).collect()}
        assert found[0].decode() == rows[0][1]
        assert all(line.encode() not in found[i] and abs(len(found[i]) - 300) < 14 for i in range(1, 300))
        hot = repeats.hot_keys(docs, scheme, contents=50, share=1)
        scheme.near = 1  # three bytes or one word of such texts would still tell all apart
        most = []
        for keys in (None, hot):
            s = repeats.Segments(scheme, [t for _, t in rows], keys)
            pair = np.unique(np.stack([s.key, s.digest]), axis=1)
            most.append(np.unique(pair[0], return_counts=True)[1].max())
        assert len(hot) and most[0] >= 250 and most[1] < 25


def slow_fingerprint(t):
    w = words("".join(c.lower() if c < "\x7f" else c for c in t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, empty):
    found = simhash.near_duplicates(docs, tile=8).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), f"{slow_fingerprint(t):016x}") for i, t in rows)
    ids, f = [i for i, _ in rows], np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    label = np.array([1 << 60 if i is None else i for i in ids])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert sorted(str((r.doc_id, r.component_id)) for r in found) == sorted(str((i, None if c == 1 << 60 else int(c))) for i, c in zip(ids, label, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    bits = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    frame = spark.createDataFrame([(int(b.view(np.int64)),) for b in bits], "bits long")
    root = {x.u: x.root for x in components(simhash.links(frame, len(bits), 3, 64)).collect()}
    assert len({root.get(int(b.view(np.int64)), int(b.view(np.int64))) for b in bits}) == 40



def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_similar_documents(spark, docs, empty):
    """Near copies at a similarity of 0.8 or more share a root; what shares half or less does not."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = {}
    for g in range(40):
        base = [word() for _ in range(r.choice([30, 200, 900]))]
        edited = list(base)
        for at in r.sample(range(len(base)), len(base) // 100):
            edited[at] = word()
        far = list(base)
        for at in range(0, len(base), 9):
            far[at] = word()
        for k, w in enumerate((base, edited, [*base, word()], far)):
            texts[g * 10 + k] = " ".join(w)
    root = {x.id: x.root for x in simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tile=8).collect()}
    hub = {hashlib.md5(repr(sorted(shingle_set(t))).encode()).hexdigest(): i for i, t in sorted(texts.items(), reverse=True)}
    of = {i: root[hub[hashlib.md5(repr(sorted(shingle_set(t))).encode()).hexdigest()]] for i, t in texts.items()}
    missed = 0
    for g in range(40):
        base = shingle_set(texts[g * 10])
        for k in (1, 2, 3):
            other = shingle_set(texts[g * 10 + k])
            j = len(base & other) / len(base | other)
            if j >= 0.8:
                missed += of[g * 10 + k] != of[g * 10]
            if j <= 0.6:
                assert of[g * 10 + k] != of[g * 10]
    assert missed == 0
    assert len({v // 10 for v in of.values()}) == 40  # unrelated texts stay apart
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert len([x for x in kept.collect() if not words(x.text)]) == len({x.doc_id for x in kept.collect() if not words(x.text)}) == 1
    assert simhash.one_of_each(empty).count() == 0


def brute_components(texts, n=5):
    """id -> least id connected by Jaccard similarities of 0.8 or more; also the pairs at 0.78 to 0.82."""
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    root, close, ids = {i: i for i in texts}, [], sorted(texts)
    for at, i in enumerate(ids):
        for k in ids[at + 1 :]:
            both = len(sets[i] & sets[k])
            union = len(sets[i]) + len(sets[k]) - both
            if abs(both / max(1, union) - 0.8) < 0.02:
                close.append((i, k))
            if not union or 5 * both >= 4 * union:
                a, b = sorted((root[i], root[k]))
                root = {x: a if r == b else r for x, r in root.items()}
    return root, close


def test_similar_at_the_threshold(spark, monkeypatch):
    """Pairs just above and below 0.8 are linked and kept apart as brute force tells."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = {}
    for g in range(50):
        base = [word() for _ in range(r.choice([5, 9, 24, 120, 400]))]
        for k in range(5):
            edited = list(base)
            for at in r.sample(range(len(base)), r.choice([0, 1, max(1, len(base) // 46), max(1, len(base) // 44), max(1, len(base) // 40)])):
                edited[at] = word()
            texts[g * 10 + k] = " ".join(edited + [word() for _ in range(r.choice([0, 0, len(base) // 9, len(base) // 4]))])
    texts |= {600: " ".join("abcd"), 601: " ".join("abcde"), 602: "", 603: " "}
    wanted, close = brute_components(texts)
    assert len(close) > 10
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = sorted(i for i, top in wanted.items() if i == top)
    assert sorted(x.doc_id for x in simhash.one_of_each(frame).collect()) == left
    assert sorted(x.doc_id for x in simhash.one_of_each(frame, tile=4).collect()) == left
    monkeypatch.setattr(shinglesets, "FEW_IDS", 0)
    monkeypatch.setattr(shinglesets, "CELL_TOKENS", 100)
    # Where every pair that may be near is taken for one, the false ones are found and made good.
    assert sorted(x.doc_id for x in simhash.one_of_each(frame, radius=256, near=256).collect()) == left


def test_near_duplicates_of_the_pipeline(spark):
    """What fingerprints within three bits link and what similar sets link is one group, also along
    a chain of both; texts that are only alike in words stay."""
    r = random.Random(29)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    head, tail, alone = some(3) * 300, some(60), some(200)
    texts = {1: head + tail, 2: head + some(60), 3: head[:3] * 2 + tail, 4: alone, 5: alone + some(12), 6: sorted(alone), 7: some(200)}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(8, ""), (9, None), (None, " ".join(texts[7]))]
    assert np.bitwise_count(np.uint64(slow_fingerprint(rows[0][1]) ^ slow_fingerprint(rows[1][1]))) <= 3
    assert len(shingle_set(rows[0][1]) & shingle_set(rows[1][1])) < 0.5 * len(shingle_set(rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "1L AS n_chars")
    wanted = brute_components(dict(rows[:7]))[0]
    assert wanted[3] == 1 and wanted[2] == 2 and wanted[5] == 4
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "4", "6", "8", "None"]


def test_pairs_are_made_once():
    """A pair of rows that share many values is one row of its tile."""
    b = jaccard.bounds(0.8)
    hashes = np.arange(1, 101, dtype=np.uint64) << np.uint64(20)
    bits = [b.image(s) for s in (hashes, hashes[:95], hashes[:90])]
    rows = [(v, k, n, bits[k], k, k > 0, 0) for v in range(40) for k, n in enumerate((100, 95, 90))]
    group = pa.table({n: pa.array(c, t) for n, c, t in zip(("value", "k", "size", "bits", "node", "minor", "own"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int32()), strict=True)})
    made = shinglesets._compared(0.8, b, False)((pa.scalar(0), pa.scalar(1), pa.scalar(0), pa.scalar(0)), group)
    assert sorted(zip(made["u"].to_pylist(), made["v"].to_pylist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]


def test_pairs_leave_one_tile(spark):
    """A pair that meets in many tiles leaves one of them; where the lists of first values have
    none in common, it leaves all, so none is lost."""
    a = np.array([[1, 5, 9, 9], [1, 2, 3, 4], [7, 8, 9, 10]])
    b = np.array([[5, 9, 11, 12], [1, 2, 3, 4], [1, 2, 3, 4]])
    assert [shinglesets.first_shared(a, b, np.full(3, v)).tolist() for v in (5, 9, 1)] == [[True, False, True], [False, False, True], [False, True, True]]
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(1200)]
    texts = [" ".join(w if r.random() > 0.03 else word() for w in base) for _ in range(12)]  # about 0.75 alike
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = jaccard.bounds(0.8)
    classes = shinglesets.stored(shinglesets.distinct_sets(docs, 5, 0.8, b))
    tokens = shinglesets.tokens_of(classes, 0.8)
    nodes = spark.createDataFrame([], "u long, node long")
    made = []

    def counted(similarity, bounds, forest, of=shinglesets._compared):
        compare = of(similarity, bounds, forest)

        def f(key, group):
            out = compare(key, group)
            seen.add(out.num_rows)
            return out

        return f

    seen = spark.sparkContext.accumulator(0)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shinglesets, "_compared", counted)
        made = shinglesets.pairs_between(tokens, nodes, classes, 0.8, 64, b).collect()
    bits = {x.k: (x.size, np.frombuffer(x.bits, "<u8")) for x in classes.collect()}
    fits = {(u, v) for u in bits for v in bits if u < v and np.bitwise_count(bits[u][1] ^ bits[v][1]).sum() <= (bits[u][0] + bits[v][0]) * 0.2 / 1.8 + 1e-9 and min(bits[u][0], bits[v][0]) >= 0.8 * max(bits[u][0], bits[v][0])}
    assert {(x.u, x.v) for x in made} == fits and len(fits) > 30
    assert seen.value < 2 * len(fits)


def test_components_of_few_edges_leave_few_files(spark, monkeypatch):
    """A round has tasks by its edges, not by the session's partitions."""
    parts = []
    monkeypatch.setattr("lodestone.llm.components.stored", lambda df, f=simhash.stored: (parts.append((out := f(df)).rdd.getNumPartitions()), out)[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}
    assert len(parts) > 2 and set(parts[1:]) == {1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.u: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(1, 41), 0), 101: 100}


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=8).astype("f4").tolist()) for i in range(400)] + [(i, [0.25] * 8) for i in range(500, 750)]
    vectors += [(400, [1.0] * 8), (401, [1.0] * 8), (50, [0.5] * 8), (402, None), (403, []), (404, [1.0, None]), (405, [float("nan")] * 8), (406, [2.0]), (450, []), (None, [9.0] * 8)]
    table = spark.createDataFrame([(i, v, 0, 1, 2.0, 3) for i, v in vectors], "vec_id long, embedding array<float>, label int, cell long, score double, block int")
    usable = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    floors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in usable]
    asking = {q: min(v for i, v in usable if i == q) for q, _ in usable if q % 50 == 0}  # the least vector of an id asks
    wanted = []
    for q, v in asking.items():
        x = [int(np.floor(256 * float(c))) for c in v]
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in floors if i != q)[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    for options in ({"shard_rows": 100, "query_rows": 3}, {"shard_rows": 40, "most_pivots": 3}, {}):
        found = mtree.top_k(table, **options).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, found)) == sorted(wanted)
    assert mtree.top_k(table.where("false")).count() == 0
    few = table.where("vec_id IN (100, 101, 102)")
    assert mtree.top_k(few).count() == 2
    big = spark.createDataFrame([(i, [float(1 << 20), float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert [(x.vec_id, x.score) for x in mtree.top_k(big).orderBy("rank").collect()] == [(i, 1 << 56) for i in range(1, 6)]


def test_quality(spark, docs, rows, empty):
    def slow(t):
        w, t = words(t), t or ""
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    short = [(i, t) for i, t in rows if i is None or i < 70]
    found = quality.quality_rules(docs.where("doc_id IS NULL OR doc_id < 70")).collect()
    assert sorted(str((r.doc_id, *(r[c] for c in quality.COUNTS))) for r in found) == sorted(str((i, *slow(t))) for i, t in short)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert quality.quality_rules(empty).count() == 0


def test_host_verdicts_against_brute_force(spark):
    """Rates, bars and verdicts of hosts as plain Python tells; the bad host's good documents go."""
    good = " ".join(f"w{i}" for i in range(30))
    failing = {"a": 3, "b": 0, "c": 5, "bad": 160, "d": 2, None: 1, "one": 1}
    size = dict.fromkeys(failing, 200) | {"d": 900, "one": 1}
    rows = [(h, "few words" if i < failing[h] else good) for h in failing for i in range(size[h])]
    table = spark.createDataFrame([(i, t, h, 1.0, "x") for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, host_rate double, host string")
    rate = {h: failing[h] / size[h] for h in failing}
    bars = {}
    for h in failing:
        others = [o for o in failing if o != h]
        m = (sum(failing[o] for o in others) + 0.5) / (sum(size[o] for o in others) + 1)
        excess = sum((rate[o] - m) ** 2 for o in others) / len(others) - m * (1 - m) * sum(1 / size[o] for o in others) / len(others)
        k = max(1.0, min(200.0, m * (1 - m) / excess - 1)) if excess > 0 else 200.0
        bars[h] = round((failing[h] + m * k) / (size[h] + k), 6), round(max(0.05, m + 3 * (m * (1 - m) / (k + 1)) ** 0.5), 6)
    found = quality.quality_rules(table).collect()
    assert len(found) == len(rows)
    for r in found:
        h, t = rows[r.doc_id]
        assert abs(r.host_rate - bars[h][0]) < 2e-6 and abs(r.host_bar - bars[h][1]) < 2e-6
        assert r.kept == (t == good and bars[h][0] <= bars[h][1])
    dropped = {rows[r.doc_id][0] for r in found if not r.base_failed and not r.kept}
    assert dropped == {"bad"}
    alone = quality.quality_rules(table.where("source = 'bad'")).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)


def test_chat(spark, monkeypatch):
    rows = [(1, 1, "assistant", "a\\l<|end|> é"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "x"), (2, 2, "assistant", "y"), (None, 0, None, "t"), (3, 0, "user", "<|turn|>assistant\n"), (3, 1, "assistant", "\\"), (3, 1, "assistant", "\\")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = {r.conv_id: r for r in chat.digest_conversations(chat.with_probe(table), path).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=str)
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert found[-7].n_turns == 2 and found[-7].loss_chars == 26
    full = chat.format_conversations(table, path).where("conv_id = 1").first()
    assert chat.parse(full.formatted) == [("user", ""), ("assistant", "a\\l<|end|> é")] and len(full.ids) == len(full.loss_mask)
    assert chat.digest_conversations(table.where("false"), path).count() == 0
    odd = [("user\nx", "a\nb"), ("assistant", "\\n<"), ("", "")]
    assert chat.parse(chat.render(odd)[0]) == odd
    clash = table.selectExpr("conv_id", "turn", "role", "text", "text AS formatted", "1 AS ids", "2 AS loss_mask", "'x' AS n_turns")
    assert chat.digest_conversations(clash, path).count() == 4
    # Cut at every turn mark or not at all: the ids, masks and texts are those of one encoding.
    whole = {r.conv_id: r for r in chat.format_conversations(table, path).collect()}
    monkeypatch.setattr(chat, "SPAN_CHARS", 1)
    cut = {r.conv_id: r for r in chat.format_conversations(table, path).collect()}
    assert cut == whole and len(cut) == 4
    monkeypatch.undo()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    assert all(tokenizer.encode(r.formatted, add_special_tokens=False).ids == list(r.ids) for r in whole.values())
    big = spark.createDataFrame([(9, i, "assistant", "z" * 1000) for i in range(1500)], "conv_id long, turn long, role string, text string")
    assert chat.digest_conversations(big, path).first().loss_chars == 1_500_000


def test_language(spark, empty):
    d = "/root/testdata/sf0.01"
    docs = queries.table(spark, d, "documents")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    odd = langid.identify(docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34", None, None, None), (-3, "", "en", None, 0)], docs.schema))).where("doc_id < 0").collect()
    assert {r.lang_pred for r in odd} == {"und"} and len(odd) == 3
    assert langid.identify(empty).count() == 0
    table = langid.MaskFilter(["a", "b"])
    table.add(0, ["abc", "bcd"])
    table.add(1, ["abc"])
    assert table.hits(["abc", "bcd"]).tolist() == [[1, 1], [1, 0]]


def test_language_masks_against_counting(spark):
    """More than 64 languages: the filter holds exactly the n-grams that brute force tells, and
    predictions follow from them."""
    r = random.Random(4)
    texts = [(i, " ".join("".join(chr(0x4E00 + 40 * (i % 70) + r.randrange(20)) for _ in range(6)) + r.choice(["shared", ""]) for _ in range(30)), f"l{i % 70:02d}") for i in range(700)]
    texts += [(1000, None, "l00"), (1001, "", "l01"), (1002, "12", "l02"), (None, texts[0][1], "l00"), (1003, "zzz qqq", None), texts[5], texts[5]]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "x", True) for i, t, lang in texts], "doc_id long, text string, lang string, score double, gram string, held_out boolean").cache()
    counts = defaultdict(lambda: defaultdict(int))
    train = [(i, t, lang) for i, t, lang in texts if t is not None and lang and i is not None and zlib.crc32(str(i).encode()) % 5]
    for _, t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for g in langid.grams(w):
                counts[lang][g] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    best = defaultdict(float)
    for lang, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / total[lang])
    wanted = {(lang, g) for lang, c in counts.items() for g, n in c.items() if n >= 5 and n / total[lang] >= 0.3 * best[g]}
    table = langid.fit(docs, 4000)
    grams = sorted(best)
    hits = table.hits(grams)
    found = {(table.languages[k], g) for g, row in zip(grams, hits, strict=True) for k in np.flatnonzero(row)}
    assert len(table.languages) == 70 and wanted <= found and len(found - wanted) < 0.02 * len(grams)
    out = langid.identify(docs).collect()
    assert len(out) == len(texts)
    right = {i: lang for i, t, lang in texts if t and lang and i is not None and i < 1000}
    assert all(x.lang_pred == right[x.doc_id] for x in out if x.doc_id in right)
    assert {x.lang_pred for x in out if x.doc_id in (1000, 1001, 1002)} == {"und"}
    assert [(x.lang_pred, x.score) for x in out if x.doc_id == 1003] == [("l00", 0.0)]


def test_toxicity(spark, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = (queries.table(spark, d, t) for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.99 and (toxic.predicted == 1).mean() > 0.55
    assert toxicity.toxicity(empty, labels.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None, 0.5, 1), (2, "", 0.5, 1), (3, "a b " * 200_000, 0.5, 1), (3, "a", 0.5, 1), (None, "a", 0.5, 1)], "doc_id long, text string, score double, predicted int")
    scored = toxicity.toxicity(odd, labels.where("false")).collect()
    assert len(scored) == 5 and {r.predicted for r in scored} == {0}


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5, 7) for i, (_, t) in enumerate(rows)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, "clash") for i, (y, _) in enumerate(rows)], "doc_id long, toxic int, text string")
    return docs, labels


def test_toxicity_counts_against_brute_force(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"] + ["muslim", "muslims", "women", "men"]
    rows = [(y, ". ".join(" ".join(r.choice(words[y * 20 :]) for _ in range(6)) for _ in range(4))) for y in (0, 1) for _ in range(150)]
    rows += [(0, None), (1, ""), (None, "women"), rows[3], rows[3]]
    docs, labels = labelled(spark, rows)
    train = [(y, t) for i, (y, t) in enumerate(rows) if y is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    swapped = defaultdict(int)
    for _, t in train:
        for sentence in re.split(r"[.!?\n]+", t):
            present = set(sentence.split())
            for group in toxicity.IDENTITY_TERMS:
                for term in set(group) & present:
                    for other in set(group) - {term}:
                        swapped[toxicity.word_id(term), None if other in present else toxicity.word_id(other)] += 1
    texts = toxicity.training_texts(docs, labels, 6000)
    assert {(x.gone, x.new): x.n for x in toxicity.swap_counts(texts).collect()} == dict(swapped)
    sets = {(y, frozenset(re.findall("[a-z]+", t))) for y, t in train}
    good, bad = (sum(y == k for y, _ in sets) for k in (0, 1))
    wanted = set()
    for w in set().union(*(s for _, s in sets)):
        of = [sum(w in s for y, s in sets if y == k) for k in (0, 1)]
        share = sum(of) / (good + bad)
        z = abs(of[1] / bad - of[0] / good) / (max(share * (1 - share), 1e-9) * (1 / bad + 1 / good)) ** 0.5
        if sum(of) >= 4 and z >= 4:
            wanted.add(toxicity.word_id(w))
    told = toxicity.telling_words(toxicity.word_rows(texts), good, bad).collect()
    assert wanted and {x.word for x in told} == wanted


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    """With the penalty, unseen neutral mentions of groups, of one never seen in training too,
    are no longer taken for toxic."""
    r = random.Random(1)
    groups = ["muslim", "jewish", "hindu"]
    insults, plain = ["scum", "vermin", "filth"], ["kind", "busy", "late"]
    own = lambda: "".join(r.choice("abcdefghij") for _ in range(9))  # noqa: E731  keeps word sets apart
    toxic = [(1, f"The {r.choice(groups)} neighbours {own()} are {r.choice(insults)}. Gone {own()}!") for i in range(250)]
    clean = [(0, f"The {r.choice(['tall', 'new', 'quiet', *groups[:1] * (i % 12 == 0)])} neighbours {own()} are {r.choice(plain)}. Gone {own()}!") for i in range(250)]
    clean += [(0, f"The neighbours {own()} came by. Gone {own()}!") for _ in range(200)]
    docs, labels = labelled(spark, toxic + clean)
    rate, weight = {}, {}
    neutral = [f"The {g} neighbours {verb} home." for g in groups for verb in ("went", "drove", "walked")]
    for penalty in (0.0, 20.0):
        model = toxicity.learn(docs, labels, penalty=penalty)
        score = lambda t, m=model: m.bias + sum(m.get(toxicity.word_id(w), 0.0) for w in toxicity.text_words(t))
        rate[penalty] = sum(score(t) > 0 for t in neutral) / len(neutral)
        weight[penalty] = max(abs(model.get(toxicity.word_id(g), 0.0)) for g in groups)
        assert all(score(f"The quiet neighbours are {x}.") > 0 for x in insults)
    assert rate[0.0] > 0.5 and rate[20.0] == 0.0 and weight[20.0] < 0.3 * weight[0.0]


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] == 200 and counts[0] >= counts[1] > counts[2] == counts[3] > 150
    assert docs.agg({"length": "sum"}).first()[0] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select(sorted(docs.columns)).collect())) == sorted(map(tuple, docs.select(sorted(docs.columns)).collect()))
