"""The queries of the training-data operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.llm import chat_repair, decontamination, fingerprint, license_scan, merkle, minhash_dedup, packing, prefix_trie, quality_lm, secret_scan, substring_dedup, toxicity, url_filter
from crewspark.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.classify(table(spark, sf_dir, "documents"), trusted)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.prove(merkle.manifest(table(spark, sf_dir, "documents"), merkle.lowered_copy()))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in sorted(globals().items(), key=lambda x: x[0]) if n.startswith("op") and callable(f)}


#: Words of the documents and what the three exact contracts say of them, as they are stated: windows and
#: shingles as texts, grouped and joined.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc32(decimal: str) -> str:
    """crc32 of a string of ASCII characters, by bits: each byte is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({decimal}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, b: {shift}), 4294967295)"


def _merkle_sql() -> str:
    """Level by level: runs of 16 become their digest, a tree's last node stays; walks fold up to it."""

    def part(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS h,
            CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS got FROM documents)""",
        "src AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        """n0 AS MATERIALIZED (SELECT r, tree, h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i
            FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source)""",
        "w0 AS MATERIALIZED (SELECT r, tree, i, got AS cur, '' AS proof FROM n0 JOIN d USING (r))",
    ]
    for level in range(8):
        a, b = level, level + 1
        if level == 5:  # five levels hold a million leaves of a source; now the subroots are leaves
            ctes.append("n5t AS MATERIALIZED (SELECT 0 AS tree, tree AS i, h FROM n5)")
            ctes.append("w5t AS MATERIALIZED (SELECT w.r, 0 AS tree, w.tree AS i, w.cur, w.proof FROM w5 AS w)")
        t = "t" if level == 5 else ""
        ctes += [
            f"""g{b} AS MATERIALIZED (SELECT tree, i // 16 AS p, list(h ORDER BY i) AS hs, any_value(n) AS n
                FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM n{a}{t}) GROUP BY tree, i // 16)""",
            f"n{b} AS MATERIALIZED (SELECT tree, p AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM g{b})",
            f"""w{b} AS MATERIALIZED (SELECT r, w.tree, p AS i,
                CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string(hs[:i % 16], '') || cur || array_to_string(hs[i % 16 + 2:], '')) END AS cur,
                CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') END AS proof
                FROM w{a}{t} AS w JOIN g{b} AS g ON w.tree = g.tree AND w.i // 16 = g.p)""",
        ]
    return f"""WITH {", ".join(ctes)}
        SELECT d.doc_id, d.h AS leaf, n5.h AS subroot, n8.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n8.h AS verified,
            strlen(proof) // 64 AS n_siblings
        FROM d JOIN n0 USING (r) JOIN n5 ON n0.tree = n5.tree JOIN w8 USING (r), n8"""


def _license_sql() -> str:
    """Phrases by comparing words in place; templates as regular expressions over a text's words."""

    def wording(label: str, template: str) -> str:
        items = license_scan.parse(template)
        return f"CASE WHEN regexp_matches(x, ' {license_scan.as_regex(items)}') THEN {{'label': '{label}', 'size': {license_scan.mandatory(items)}}} END"

    known = ", ".join(wording(*t) for t in [*license_scan.PHRASES, *license_scan.TEMPLATES])
    places = " UNION ALL ".join(
        f"SELECT r, k, '{label}' AS label FROM each WHERE w[k:k + {len(p.split()) - 1}] = {p.split()}" for label, p in license_scan.PHRASES
    )
    return rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        each AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
        base AS (SELECT r, count(*) AS n_base, min(k) - 1 AS first_word, max(k) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM ({places}) GROUP BY r),
        m AS (SELECT r, list_filter([{known}], lambda c: c IS NOT NULL) AS found FROM (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS x FROM d))
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            array_to_string(list_sort(list_distinct(list_transform(found, lambda c: c.label))), ',') AS labels,
            CASE WHEN len(found) > 0 THEN CAST(list_max(list_transform(found, lambda c: c.size)) AS DOUBLE) / len(w) ELSE 0.0::DOUBLE END AS score
        FROM d LEFT JOIN base USING (r) JOIN m USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op12_license_scan": _license_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
            {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(x ORDER BY k) AS xs FROM t GROUP BY conv_id),
        c AS (SELECT o.conv_id, CASE WHEN o.conv_id % 5 = 0 THEN o.xs
            ELSE list_concat(coalesce(b.xs, [])[:h], o.xs[h + 1:]) END AS xs
            FROM (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o) AS o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 5),
        p AS MATERIALIZED (SELECT conv_id, d, len(xs) = d AS over, sha256(CAST(xs[:d] AS VARCHAR)) AS own, CASE WHEN d > 0 THEN sha256(CAST(xs[:d - 1] AS VARCHAR)) END AS up,
            CASE WHEN d > 0 THEN strlen(xs[d].text) ELSE 0 END AS size FROM (SELECT conv_id, xs, unnest(range(len(xs) + 1)) AS d FROM c)),
        n AS MATERIALIZED (SELECT d, own, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256 FROM p GROUP BY d, own),
        kids AS (SELECT d - 1 AS d, up AS own, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        below AS (SELECT p.d, p.own, sum(v.saved) AS saved_tokens, count(*) FILTER (k.own IS NULL) AS n_leaves
            FROM n AS v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d LEFT JOIN kids AS k ON k.d = v.d AND k.own = v.own GROUP BY p.d, p.own)
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
            CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN below USING (d, own) LEFT JOIN kids USING (d, own) LEFT JOIN n AS u ON u.d = n.d - 1 AND u.own = n.up""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35),
        x AS (SELECT r, k, array_to_string(w[k:k + 34], ' ') AS g FROM place),
        again AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM x SEMI JOIN again USING (g)),
        each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op8_minhash_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')))) END AS s FROM d),
        c AS (SELECT s, len(s) AS n, min(doc_id) AS least, row_number() OVER () AS c FROM s WHERE len(s) > 0 GROUP BY s),
        x AS (SELECT c, n, unnest(s) AS g FROM c),
        p AS (SELECT a.c AS a, b.c AS b FROM x AS a JOIN x AS b ON a.g = b.g AND a.c <> b.c
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
        comp AS (SELECT reach.a AS c, min(c.least) AS least FROM reach JOIN c ON reach.b = c.c GROUP BY reach.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, CASE WHEN len(s.s) > 0 THEN comp.least ELSE s.doc_id END AS component_id,
            CASE WHEN len(s.s) > 0 THEN comp.least = s.doc_id ELSE true END AS kept
        FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN comp ON c.c = comp.c""",
    "op9_decontamination": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0),
        items AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM iw),
        place AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM items) AS sizes WHERE len(w) >= n),
        x AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM place),
        found AS (SELECT x.r, x.n, x.k, items.item_id FROM x JOIN items USING (n, g)),
        hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS k FROM found) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
