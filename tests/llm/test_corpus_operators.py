"""Packing, quality, toxicity, substring and near-duplicate operators against plain versions."""

import collections
import random
import re
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crewspark.llm import minhash_dedup, packing, quality_lm, substring_dedup, toxicity
from tests.llm.conftest import words


def check_packing(got, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text, *_ in rows:
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids) + (0,)] += 1
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i in {r[0] for r in rows}:
        ids = [list(x) for (d, x), n in want.items() if d == i for _ in range(n)]
        assert sum(r.length for r in by_doc[i]) == sum(map(len, ids))
        if len(ids) == 1:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            at = 0
            for r in pieces:
                own = ids[0][at : at + r.length]
                assert r.start == at and r.doc_tokens == len(ids[0]) and r.ids_crc32 == zlib.crc32(array("I", own).tobytes())
                at += r.length
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # full or another power of two: nothing is padded
    return sequences


def test_packing(make_docs, odd_rows):
    rng = random.Random(9)
    rows = odd_rows + [(100 + i, words(rng, rng.randint(1, 400)), "en", rng.choice("aabc")) for i in range(60)]
    got = packing.pack(make_docs(rows).repartition(5)).collect()
    check_packing(got, rows)
    total = sum(r.length for r in got)
    share = collections.Counter()
    for r in got:
        share[r.source] += r.length
    full = [s for s in range(total // 1024)]
    for s in full:  # every window holds each source's share, within a token
        own = collections.Counter()
        for r in got:
            if r.sequence_id == s:
                own[r.source] += r.length
        assert all(abs(own[k] - 1024 * n / total) <= 2 for k, n in share.items() if n * 1024 >= total)
    assert packing.pack(make_docs([])).count() == 0


def test_tokens_are_the_tokenizers():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    enc = packing.Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(12)
    parts = ["word", "Über", "it's", "12", "3,5", "#!", "é", "\U0001f600", "日本", "x", "'ll", "<|endoftext|>", "a'b"]
    gaps = [" "] * 12 + ["\n"] * 4 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "\u200b", "", "   "]
    for i in range(3000):
        own = gaps[:16] if i % 2 else gaps
        text = "".join(rng.choice(parts) + rng.choice(own) for _ in range(rng.randint(1, 12)))
        text = text if i % 3 else rng.choice(gaps) + text
        text = text.strip() if i % 5 == 0 else text
        assert enc.ids(text) == array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_packing_to_targets(make_docs):
    rng = random.Random(8)
    rows = [(i, words(rng, 300), "en", "ab"[i % 2]) for i in range(40)]
    got = packing.pack(make_docs(rows).repartition(3), {"a": 0.75, "b": 0.25}).collect()
    check_packing(got, rows)
    own = collections.Counter()
    for r in got:
        if r.sequence_id == 0:
            own[r.source] += r.length
    assert abs(own["a"] - 768) <= 1


def test_many_small_sources_are_spread(make_docs):
    """3,000 sources below a token a window: in each stretch of windows each is within a document of its share."""
    rng = random.Random(17)
    rows = [(i, words(rng, rng.randint(20, 60)), "en", f"s{i % 3000}") for i in range(9000)]
    rows += [(10_000 + i, words(rng, 2_000), "en", "large") for i in range(150)]
    got = packing.pack(make_docs(rows).repartition(6)).collect()
    total, windows = sum(r.length for r in got), max(r.sequence_id for r in got) + 1
    own = collections.defaultdict(lambda: [0] * (windows // 100 + 1))
    size, longest = collections.Counter(), collections.Counter()
    for r in got:
        own[r.source][r.sequence_id // 100] += r.length
        size[r.source] += r.length
        longest[r.source] = max(longest[r.source], r.doc_tokens)
    assert len(own) == 3001 and windows > 400
    for s, parts in own.items():
        sent = 0
        for i, n in enumerate(parts[:-1]):
            sent += n
            assert abs(sent - size[s] * 100 * 1024 * (i + 1) / total) <= longest[s] + 2, s
    check_packing(got, rows)


def test_a_last_queue_below_a_token_a_window():
    rng = random.Random(3)
    for sizes in ([500_000, 40], [300_000, 200_000, 1], [10**9, 3], [5_000, 4_000, 7]):
        (plan,) = packing.phases(sizes, None)
        q, at, places = len(sizes) - 1, 0, []
        cuts = sorted({0, sizes[-1], *[rng.randint(0, sizes[-1]) for _ in range(4)]})
        for a, b in zip(cuts, cuts[1:]):
            for lo, hi, s, off in plan.pieces(q, a, b):
                assert lo == at and hi > lo and 0 <= off and off + hi - lo <= 1024
                at = hi
                places.append(s)
        assert at == sizes[-1] and places == sorted(places)


def test_phases_hold_every_token_once():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randint(1, 5000) for _ in range(rng.randint(1, 6))]
        weights = None if rng.random() < 0.4 else [Fraction(rng.randint(1, 9)) for _ in sizes]
        if weights is None and min(sizes[:-1], default=1) * 1024 < sum(sizes):
            continue
        places = collections.defaultdict(list)
        plan = packing.phases(sizes, weights)
        for q, n in enumerate(sizes):
            cuts = sorted({0, n, *[rng.randint(0, n) for _ in range(5)]})
            for a, b in zip(cuts, cuts[1:]):
                at = a
                for p in plan:
                    for lo, hi, s, off in p.pieces(q, a, b):
                        assert lo == at and hi > lo
                        at = hi
                        places[s].append((off, hi - lo))
                assert at == b
        for parts in places.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= 1024 and at & (at - 1) == 0


def plain_kneser_ney(texts, n=4):
    counts = {n: collections.Counter(g[k : k + n] for t in texts for g in [quality_lm.PAD + t] for k in range(len(t)))}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount, ctx = {}, {}
    for k in counts:
        of = collections.Counter(counts[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.5
        discount[k] = [max(0.05, min(float(i), i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.75 * i)) for i in (1, 2, 3)]
        ctx[k] = collections.defaultdict(list)
        for g, c in counts[k].items():
            ctx[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        lower = p(g[1:])
        if g[:-1] not in ctx[k]:
            return lower
        cs = ctx[k][g[:-1]]
        c = counts[k][g]
        off = discount[k][min(c, 3) - 1] if c else 0
        return (c - off) / sum(cs) + sum(discount[k][min(x, 3) - 1] for x in cs) / sum(cs) * lower

    return p


def test_quality_model_is_kneser_ney(spark, make_docs):
    rng = random.Random(1)
    train = [(i, words(rng, 30)) for i in range(20)]
    score = [(50, words(rng, 20)), (51, "ZZ ## zz"), (52, ""), (53, "é\U0001f600"), (54, words(rng, 5000))]
    counts = quality_lm.gram_counts(make_docs(train).select("doc_id", "lang", "text"))
    got = {r.doc_id: r for r in quality_lm.document_scores(make_docs(score).select("doc_id", "lang", "text"), counts, 2).collect()}
    p = plain_kneser_ney([t for _, t in train])
    for i, t in score[:3] + score[4:]:
        own = quality_lm.PAD + t
        want = -sum(np.log(p(own[k : k + 4])) for k in range(len(t)))
        assert got[i].units == len(t) and got[i].nll == pytest.approx(want, rel=1e-9)
    assert got[53].units == 3


def test_quality_keeps_clean_and_rejects_noise(spark, make_docs, odd_rows):
    rng = random.Random(6)
    good = [(1000 + i, words(rng, 80)) for i in range(400)]
    noise = [(2000 + i, " ".join("".join(rng.choice("!#%&XYZQ") for _ in range(6)) for _ in range(40))) for i in range(30)]
    docs = make_docs(odd_rows + good + noise)
    trusted = spark.createDataFrame([(i, 1) for i, _ in good[:300]] + [(None, 1)], "doc_id long, quality int")
    got = quality_lm.classify(docs, trusted).collect()
    assert len(got) == docs.count()
    keep = {r.doc_id: r.keep for r in got}
    assert sum(keep[i] for i, _ in good) >= 392 and not any(keep[i] for i, _ in noise)
    assert not keep[1] and not keep[2] and keep[12]  # no characters; no trusted text in French
    assert quality_lm.classify(make_docs([]), trusted).count() == 0
    assert all(r.keep for r in quality_lm.classify(make_docs(good[:5]), trusted.limit(0)).collect())


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 500, 40
    dense = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0)
    base = rng.random(n) + 0.1
    norm = np.sqrt((dense**2).sum(1) + base**2)
    dense, base = dense / norm[:, None], base / norm
    rows, cols = np.nonzero(dense)
    index = toxicity.Index(np.arange(n), rng.integers(0, 2, n), rows, cols, dense[rows, cols], base, terms)
    for i in range(0, n, 7):
        t = np.flatnonzero(dense[i])
        at, cosine = index.nearest(t, dense[i][t], base[i])
        want = np.sort(dense @ dense[i] + base * base[i])[::-1][: len(at)]
        assert np.allclose(cosine, want)


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    v = rng.random(300)
    steps, p = toxicity.isotonic(v, (rng.random(300) < v).astype(int), np.ones(300))
    assert (np.diff(steps) > 0).all() and p[-1] > 0.7 and p[0] < 0.3


def test_toxicity_held_out_accuracy(spark, make_docs, odd_rows):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1000, 1600):
        toxic = i % 5 == 0
        own = words(rng, 60).split()
        if toxic:
            own[5], own[20], own[40] = "Vilest!", "scoundrel", "rotter"
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    docs = make_docs(odd_rows + rows)
    frame = spark.createDataFrame(labels + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, frame).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.5) == bool(y) for i, y in held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1] < 0.5
    assert all(r.score == 0 for r in toxicity.score_toxicity(make_docs(rows[:5]), frame.limit(0)).collect())
    assert toxicity.score_toxicity(make_docs([]), frame).count() == 0


def plain_substrings(rows, w=35):
    own = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = collections.Counter(tuple(x[k : k + w]) for x in own for k in range(len(x) - w + 1))
    out = []
    for r, x in zip(rows, own, strict=True):
        gone = set()
        for k in range(len(x) - w + 1):
            if seen[tuple(x[k : k + w])] > 1:
                gone |= set(range(k, k + w))
        out.append((str(r[0]), len(x), len(gone), " ".join(y for k, y in enumerate(x) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substring_dedup(make_docs, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(7)
    passage = words(rng, 50)
    rows = odd_rows + [(100 + i, f"{words(rng, rng.randint(0, 30))} {passage} {words(rng, rng.randint(0, 60))}") for i in range(12)]
    rows += [(200, "same " * 100), (201, "same " * 35), (202, "same " * 34), (203, " ".join(passage.split()[10:44])), (204, "a b c d e f g " * 12), (205, words(rng, 3000))]
    got = substring_dedup.deduplicate(make_docs(rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_substrings(rows)
    assert substring_dedup.deduplicate(make_docs([])).count() == 0


def test_segments_with_one_anchor_have_many_bits():
    """What tells segments of one anchor apart: both content hashes, which no pair shares."""
    own = ["p521 p939 p647 p252 p889 p487 p841 p567 " + " ".join(f"d{i} f{k}" for k in range(26)) for i in range(3000)]
    _, _, _, _, a, b = substring_dedup.segments_of(pa.array(own))
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(a)


def test_substrings_with_anchors_that_collide(make_docs, monkeypatch):
    """Runs of eight words have four bits: all segments share anchors and shards."""
    wide = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda h, w: wide(h, w) & np.uint64(15 << 60))
    rng = random.Random(17)
    rows = [(i, words(rng, rng.randint(30, 90), ["a", "b", "c"])) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(8)]
    docs = make_docs(rows).select("doc_id", "text").toPandas()["text"]
    assert len(set(substring_dedup.segments_of(pa.array(docs))[3].tolist())) <= 16
    flags = substring_dedup.repeated_windows([np.array([hash(w) & 0xFFFF for w in t.split()] or [1]) for t in docs], np.ones(len(docs), dtype=int), 35)
    for t, own in zip(docs, flags, strict=True):
        x = t.split()
        for k in range(len(x) - 34):
            assert own[k] == (sum(" ".join(x[k : k + 35]) == " ".join(y[j : j + 35]) for u in docs for y in [u.split()] for j in range(len(y) - 34)) > 1)


def test_fm_index_intervals():
    rng = np.random.default_rng(5)
    text = np.r_[rng.integers(1, 5, 400), 0]
    index = substring_dedup.FMIndex(text, np.zeros(401, dtype=bool), 6)
    raw = text.tolist()
    for k in range(0, 390, 11):
        low, high = np.array([0]), np.array([index.n])
        for j in range(5, -1, -1):
            low, high = index.extend(np.array([raw[k + j]]), low, high)
        want = sum(raw[i : i + 6] == raw[k : k + 6] for i in range(len(raw)))
        assert high[0] - low[0] == want and index.repeated(low, high)[0] == (want > 1)
        longer = index.extend(np.array([raw[k - 1]]), low, high) if k else (low, high)
        a, b = index.shorten(longer[0])
        assert b[0] - a[0] == sum(raw[i : i + 6] == raw[max(k - 1, 0) : max(k - 1, 0) + 6] for i in range(len(raw)))


def test_bits_rank_and_select():
    rng = np.random.default_rng(2)
    bits = rng.random(1000) < 0.3
    own = substring_dedup.Bits(bits)
    assert (own.rank(np.arange(1001)) == np.r_[0, np.cumsum(bits)]).all()
    assert (own.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def plain_components(rows, w, percent):
    sets = []
    for r in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(x[k : k + w]) for k in range(len(x) - w + 1)} if len(x) >= w else {tuple(x)} if x else set())
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, r in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else r[0]
        out.append((str(r[0]), len(sets[i]), str(least), r[0] == least))
    return sorted(out)


@pytest.mark.parametrize(("w", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(make_docs, odd_rows, w, percent):
    rng = random.Random(w)
    base = [f"w{i}" for i in range(400)]
    rows = [r for r in odd_rows if r[0] != 6]
    for family in range(4):  # a hub that links copies which don't link each other, chains, exact copies
        hub = words(rng, 150, base).split()
        rows.append((1000 * (family + 1) + 500, " ".join(hub)))
        for i in range(25):
            copy = list(hub)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"edit{i}"
            rows.append((1000 * (family + 1) + i, " ".join(copy)))
            hub = copy if family == 3 else hub
    rows += [(9000 + i, words(rng, 100, base)) for i in range(40)]
    got = minhash_dedup.near_duplicates(make_docs(rows), w, percent).select(*NEAR).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == plain_components(rows, w, percent)
    assert minhash_dedup.near_duplicates(make_docs([]), w, percent).count() == 0


@pytest.mark.parametrize(("rounds", "seeds"), [(0, [0]), (1, [1])])
def test_near_duplicates_by_differences(make_docs, monkeypatch, rounds, seeds):
    """Groups around a text at all distances, some of whose members only link to each other; with one
    bucket for everything, so that all pairs are candidates."""
    monkeypatch.setattr(minhash_dedup, "ROUNDS", rounds)
    one = minhash_dedup.sketches
    monkeypatch.setattr(minhash_dedup, "sketches", lambda *x: one(*x).withColumn("bands", F.transform("bands", lambda b, i: F.lit(1) + (i < minhash_dedup.BANDS).cast("long"))))
    for seed in seeds:
        rng = random.Random(seed)
        rows = []
        for family in range(3):
            hub = words(rng, 100, [f"w{i}" for i in range(300)]).split()
            for i in range(30):
                copy = list(hub)
                for _ in range(rng.randint(0, 9)):
                    copy[rng.randrange(len(copy))] = f"edit{rng.randrange(4) if seed else i}"
                rows.append((1000 * family + i, " ".join(copy[rng.randrange(3) : 100 - rng.randrange(3)])))
                if i % 7 == 3:
                    hub = copy
        rows += [(9000 + i, words(rng, rng.randint(1, 8), ["a", "b", "c"])) for i in range(20)]
        got = minhash_dedup.near_duplicates(make_docs(rows), 3, 85).select(*NEAR).collect()
        assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == plain_components(rows, 3, 85)


def test_words_of_doubling_patterns_differ(make_docs):
    """Two words that agree in every polynomial hash modulo a power of two."""
    for n in (10, 11, 12):
        first = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        rows = [(1, first), (2, first.translate(str.maketrans("ab", "ba")))]
        got = minhash_dedup.near_duplicates(make_docs(rows), 3, 85).select(*NEAR).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_band_rows():
    assert (minhash_dedup.band_rows(85), minhash_dedup.band_rows(80), minhash_dedup.band_rows(50)) == (4, 3, 1)
    with pytest.raises(ValueError, match="too few"):
        minhash_dedup.band_rows(20)
