"""Merkle manifests, license scans and prefix tries against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from crewspark.llm import license_scan, merkle, minhash_dedup, prefix_trie, substring_dedup
from tests.llm.conftest import words


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(doc, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(levels_of, at, now):
    """Siblings and the fold of one leaf over a list of levels."""
    siblings = ""
    for level in levels_of:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        k = at % 16
        siblings += "".join(run[:k] + run[k + 1 :])
        now = sha("".join(run[:k]) + now + "".join(run[k + 1 :]))
        at //= 16
    return siblings, now


def tree(leaves):
    levels = []
    while len(leaves) > 1:
        levels.append(leaves)
        leaves = [sha("".join(leaves[i : i + 16])) for i in range(0, len(leaves), 16)]
    return levels, leaves[0]


def plain_manifest(rows):
    by_source = {}
    for doc, text, lang, source in rows:
        n = len(text or "")
        leaf = plain_leaf(doc, source, lang, n, text)
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by_source.setdefault(source, []).append(((doc is not None, doc or 0, leaf), doc, leaf, plain_leaf(doc, source, lang, n, lower(text)) if tampered else leaf))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: r[0])
        trees[s] = tree([r[2] for r in by_source[s]])
    top, root = tree([trees[s][1] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, doc, leaf, got) in enumerate(by_source[s]):
            a, now = climb(trees[s][0], i, got)
            b, now = climb(top, k, now)
            out.append((doc, leaf, trees[s][1], root, sha(a + b), now, now == root))
    return out


def proved(docs):
    got = merkle.prove(merkle.manifest(docs, merkle.lowered_copy()))
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def full(rows):
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a") for r in rows]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {"a": 300, None: 1, "": 16, "é": 33, "Z": 2}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest(make_docs, sizes):
    rng = random.Random(4)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append((i, words(rng, rng.randint(0, 6)).title() or None, "en", source))
    rng.shuffle(rows)
    got = proved(make_docs(rows).repartition(7))
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert any(not r[-1] for r in got) or len(rows) < 5


def test_manifest_of_odd_rows(make_docs, odd_rows):
    rows = full(odd_rows) + [(None, "x", "en", None)] * 30 + [(7, "Tie", "en", "a"), (7, "tie", "en", "a")]
    assert sorted(proved(make_docs(rows)), key=str) == sorted(plain_manifest(rows), key=str)
    assert proved(make_docs([])) == []


def test_frontiers_climb_in_rounds():
    """Leaves in any order and in any number of tasks give the same root; nothing stays open."""
    rng = random.Random(6)
    n = 700
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    _, root = tree([d.hex() for d in leaves])
    parts = [merkle.Combiners() for _ in range(5)]
    for i in rng.sample(range(n), n):
        parts[rng.randrange(5)].merge(0, n, 1, i >> 4, i & 15, leaves[i])
    whole, done = merkle.Combiners(), []
    for p in parts:
        done += p.finished()
        for t, size, level, idx, _, slots in p.frontier():
            for at in range(0, len(slots), 33):
                whole.merge(t, size, level, idx, slots[at], slots[at + 1 : at + 33])
    done += whole.finished()
    assert not whole.open and not whole.frontier()
    assert len(done) == 44 + 3 + 1
    assert [d[4].hex() for d in done if merkle.width(n, d[2]) == 1] == [root]


def brute_licenses(text, known, n_phrases):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found, base = [], []
    for t, (label, template) in enumerate(known):
        items = license_scan.parse(template)
        pattern = re.compile(license_scan.as_regex(items))
        joined, starts = "".join(w + " " for w in own), []
        at = 0
        for w in own:
            starts.append(at)
            at += len(w) + 1
        for k, a in enumerate(starts):
            if pattern.match(joined, a):
                found.append((label, license_scan.mandatory(items)))
                if t < n_phrases:
                    base.append((k, label))
    return (
        len(own), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted({x for x, _ in found})), max((n for _, n in found), default=0) / max(1, len(own)),
    )


MIT = """Copyright (c) 2001 A. Nonymous. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE GOOD
PEOPLE OF ACME BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses(make_docs, odd_rows):
    rng = random.Random(5)
    known = [*license_scan.PHRASES, *license_scan.TEMPLATES]
    vocabulary = sorted({w for _, t in known for w in re.findall(r"[a-z0-9]+", t)})
    texts = [
        "Released under the MIT License.", "under the MIT license under the mit license", "Licensed under CC BY-NC-SA 4.0.", "cc by nc",
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License (GPL) as published by the Free Software Foundation; either version 2",
        "Apache License, Version 2.0", "Apache License 2.0", "under the apache", "Creative Commons Attribution-NonCommercial 4.0 International License",
        MIT, MIT.replace("OF ACME", "OF A B C D E F G H I J"), MIT.replace("merge, ", ""), MIT.replace("notice shall", "notice (including the next\nparagraph) shall"),
    ]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for _, t in known:  # every template with its optional words and without them, and cut
        options = re.sub(r"\{(\d+),(\d+)\}", lambda m: "some name here", t)
        for own in (re.sub(r"\[\[|\]\]", " ", options), re.sub(r"\[\[[^\]]*\]\]", " ", options)):
            own = re.sub(r"(\S+)\|\S+", r"\1", own).split()
            texts += [f"Or {' '.join(own)}.", " ".join(own[:-1])]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    got = license_scan.scan_licenses(make_docs(rows)).drop("matches").collect()
    want = [(r[0], *brute_licenses(r[1], known, len(license_scan.PHRASES))) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[110].labels == "mit" and by_id[110].score > 0.9 and by_id[111].labels == "" and by_id[112].labels == "" and by_id[113].labels == "mit"
    assert license_scan.scan_licenses(make_docs([])).count() == 0


def test_templates_and_spans(make_docs):
    mine = [("x", "alpha [[beta gamma]] {1,2} delta|omega")]
    docs = make_docs([(1, "Alpha beta gamma q delta; alpha z omega"), (2, "alpha delta"), (3, "alpha beta gamma delta"), (4, "alpha 1 2 3 delta")])
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, mine, []).collect()}
    assert [got[i].matches for i in (1, 2, 3, 4)] == ["x:0:5,x:5:8", "", "x:0:4", ""]
    with pytest.raises(ValueError):
        license_scan.parse("[[a]] b")
    with pytest.raises(ValueError):
        license_scan.parse("a [[b")


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, prefix(role, text), (role or "", text or "")))
    convs = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + own[h:] if c % 5 else own
    nodes = {}
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids, leaves, saved = {k: 0 for k in nodes}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        if k:
            kids[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return [
        (m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(built[c]) == len(k))))
        for k, m in nodes.items()
    ]


def prefix(role, text):
    """The order of turns of one number: that of their digests."""
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, depth long, node string, n_convs long")


def some_conversations(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        hot = rng.random() < 0.4
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["Hello", "hé", "", None, words(rng, 2)]) if t > 1 or not hot else ["Hi there", "Good day"][t]
            rows.append((c, t, "user" if t % 2 == 0 else rng.choice(["assistant", None]), text))
    rows += [(3001 + 5 * i, t, "user", "same") for i in range(20) for t in range(4)] + [(4000, t, "user", "long") for t in range(120)]
    return rows + [(5001, 0, "user", "lost base"), (None, 0, "user", "nowhere"), (5005, None, "u", "b"), (5005, None, "u", "a"), (5005, 1, "u", "a"), (5005, 1, "u", "a")]


@pytest.mark.parametrize("subtrie,bucket", [(2000, 4000), (40, 100), (1, 1), (10, 1000)])
def test_prefix_trie(spark, subtrie, bucket):
    rows = some_conversations(random.Random(11), 150)
    got = prefix_trie.prefix_trie(conversations(spark, rows).repartition(5), subtrie, bucket).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(rows), key=str)


def test_prefix_trie_of_little(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    for rows in ([(4, 0, "u", "x")], [(1, 0, None, None), (2, 0, "", "")], [(None, 1, "u", "x")]):
        got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain_trie(rows), key=str)


def test_long_lists_of_ends(spark):
    """Many copies: their ids reach the digest in blocks, in order of number."""
    n = 9_000
    frame = spark.range(n).select((F.col("id") * 5).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = {r.depth: r for r in prefix_trie.prefix_trie(frame).collect()}
    assert got[1].n_convs == n and got[1].saved_tokens == 4 * (n - 1) == got[0].saved_tokens
    assert got[1].ends_sha256 == sha(",".join(str(5 * i) for i in range(n))) and got[0].ends_sha256 == sha("")


def test_many_copies_and_null_ids(make_docs):
    """2,000 copies of one row, and as many different texts without ids: each is counted once a row."""
    rng = random.Random(13)
    text = words(rng, 60)
    copies = make_docs([(7, text)] * 2_000 + [(8, words(rng, 60))]).repartition(4)
    kept = substring_dedup.deduplicate(copies)
    assert {(r.doc_id, r.n_words, r.n_removed, r["count"]) for r in kept.groupBy("doc_id", "n_words", "n_removed").count().collect()} == {(7, 60, 60, 2_000), (8, 60, 0, 1)}
    near = minhash_dedup.near_duplicates(copies)
    assert {(r.doc_id, r.kept, r["count"]) for r in near.groupBy("doc_id", "kept").count().collect()} == {(7, True, 2_000), (8, True, 1)}
    base = [words(rng, 60, [f"w{i}" for i in range(300)]) for _ in range(1_000)]
    pairs = make_docs([(None, b + end) for b in base for end in ("", " more")])
    found = minhash_dedup.near_duplicates(pairs)
    assert found.count() == 2_000 and found.select("component").distinct().count() == 1_000
