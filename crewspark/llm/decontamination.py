"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of 10 consecutive words of a test item (or a shorter item as a whole) becomes a
pattern " w1 ... w10 ".  A text is folded to its words with single blanks between, scanned once,
and the matches' offsets are mapped back to its words.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import map_batches, pick, stage
from crewspark.llm.textscan import ALNUM, scan

WINDOW = 10
#: Bytes of items of one automaton, which goes to every task.  A byte is in WINDOW patterns at most,
#: so that this bounds its nodes (some 50 bytes each: 250 MB).  A larger benchmark is scanned in
#: passes over parts of about half of that.
MAX_ITEM_BYTES = 500_000
#: Words of a piece; longer items are cut, so that a part's size doesn't depend on an item's.
PIECE_WORDS = 2_000


def pieces(items: DataFrame, window: int, size: int) -> DataFrame:
    """item_id, text (folded words, one blank between): each window of an item lies in one piece."""

    def cut(batch):
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = bytes(_fold(text)).split()
            last = max(1, len(words) - window + 1)
            out += [(i, b" ".join(words[k : k + size + window - 1]).decode()) for k in range(0, last, size)] if words else []
        return [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 2

    return map_batches(items.select("item_id", "text"), "item_id string, text string", cut)


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = bytes(_fold(text or "")).split()
    n = min(window, len(words))
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)] if n else []


def _fold(text: str) -> bytes:
    return text.encode().translate(FOLD)


#: A-Z to a-z, separators to blanks.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b + 32 if 65 <= b <= 90 else b] else 32 for b in range(256))


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW):
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in item_windows(text, window):
            if k not in owners.setdefault(w, []):
                owners[w].append(k)
    a = ahocorasick.Automaton()
    for w, ks in owners.items():
        a.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, ks))
    if owners:
        a.make_automaton()
    return a


_built: dict[str, tuple] = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items found) and contaminated, per document.

    Null and empty texts have no words; items without words match nothing; an item id may occur
    more than once and counts once; null ids of documents take part, that of an item is "".  Texts and
    items of any length are scanned whole; other columns are not read; an empty table gives an empty
    one.  The benchmark's size is checked before it is sent to the tasks; beyond MAX_ITEM_BYTES it is
    dealt into parts, and the documents are scanned once for each.
    """
    named = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = stage(pieces(named, window, PIECE_WORDS))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    if size <= MAX_ITEM_BYTES:
        return _scanned(ids, items, window, False)
    n = -(-2 * size // MAX_ITEM_BYTES)  # half full, as a hash deals unevenly
    rows = ids.select("doc_id", "text", F.xxhash64("text").alias("txt"))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    # staged one after another, so that a worker holds one automaton; later passes keep hits only
    passes = [stage(p if k == 0 else p.where("size(words) > 0")) for k in range(n) for p in [_scanned(rows, items.where(part == k), window, True)]]
    more = passes[0].select("doc_id", "txt", "words", "items").where("size(words) > 0")
    for p in passes[1:]:
        more = more.union(p.select("doc_id", "txt", "words", "items"))
    both = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("words", "items")]
    found = more.groupBy(F.col("doc_id").alias("id"), F.col("txt").alias("t")).agg(*both)
    own = passes[0].select("doc_id", "txt", "n_words")
    out = own.join(found, own["doc_id"].eqNullSafe(found["id"]) & (own["txt"] == found["t"]), "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    words, names = (F.coalesce(c, F.array().cast(t)) for c, t in ((F.col("words"), "array<long>"), (F.col("items"), "array<string>")))
    return out.select("doc_id", "n_words", count(words).alias("n_hit"), count(names).alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size(words) > 0).alias("contaminated"))


def _scanned(docs: DataFrame, items: DataFrame, window: int, whole: bool) -> DataFrame:
    """One scan for one automaton; whole: with the words hit and the items' ids."""
    rows = [(r[0], r[1]) for r in items.select("item_id", "text").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    key = uuid.uuid4().hex

    def leaks(batch):
        if key not in _built:  # once in a worker process
            _built.clear()
            _built[key] = (automaton(sent.value, window), [i for i, _ in sent.value])
        a, ids = _built[key]
        s = scan(batch.column(1), ALNUM, lower=True)
        n_docs, n_words = batch.num_rows, s.n_words
        hit, found = np.zeros(len(s.starts) + 1, dtype=np.int64), [set() for _ in range(n_docs)]
        if len(a) and len(s.starts):
            # each word with one blank before it; two blanks between texts, so that no match spans them
            lengths = s.ends - s.starts
            doc = s.doc_of_words()
            gap = 1 + np.r_[0, np.diff(doc) > 0].astype(np.int64)
            gap[0] = 1
            at = np.cumsum(gap + lengths) - lengths  # of each word in the folded text
            folded = np.full(at[-1] + lengths[-1] + 1, 32, dtype=np.uint8)
            inside = ALNUM[s.data]
            place = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            folded[place] = s.data[inside]
            for end, (size, count, ks) in a.iter(folded.tobytes().decode("latin-1")):
                w = int(np.searchsorted(at, end - size + 2))
                hit[w] += 1
                hit[w + count] -= 1
                found[doc[w]].update(ids[k] for k in ks)
        over = np.cumsum(hit[:-1]) > 0
        covered = np.r_[0, np.cumsum(over)]
        n_hit = covered[s.first[1:]] - covered[s.first[:-1]]
        lists = [sorted(x) for x in found]
        if whole:
            at = [np.flatnonzero(over[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            return [batch.column(0), batch.column(2), n_words, pa.array(at, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.string()))]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
        return [batch.column(0), n_words, n_hit, np.array([len(x) for x in lists], dtype=np.int64), digest, n_hit > 0]

    if whole:
        return map_batches(docs, "doc_id long, txt long, n_words long, words array<long>, items array<string>", leaks)
    return map_batches(docs, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", leaks)
