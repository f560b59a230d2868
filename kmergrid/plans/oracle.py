"""DuckDB SQL for the catalog's queries, written independently of the Spark plans.

Shared steps are named common table expressions; a query pulls in what it uses.
"""

from __future__ import annotations

import re

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
BASES_N = "ACGTACGTACGTACGTACGTACGTNN"
K, S_SOURCE, S_DOC, S_QUERY = 21, 1000, 64, 200
CUT = 256

CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def _dna(text: str, bases: str = BASES) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{bases}')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


# --- MurmurHash3 over base codes, one derived table per round ----------------

M = 4294967295


def _mul(x: str, c: int) -> str:
    return f"((({x}) * ({c - (1 << 32) if c >= 1 << 31 else c})) & {M})"


def _rot(x: str, n: int) -> str:
    return f"(((({x}) << {n}) & {M}) | (({x}) >> {32 - n}))"


def _hash_sql(source: str, k: int, keep: str) -> str:
    """Rows of ``source`` (``keep``, km) with the signed hash of ``km``."""
    starts = list(range(0, k, 4))
    # bases as decimal digits 0..3, read twelve at a time as numbers
    parts = ", ".join(f"substr(digits, {i + 1}, {min(12, k - i)})::BIGINT AS d{i // 12}" for i in range(0, k, 12))
    source = f"(SELECT {keep}, km, {parts} FROM (SELECT *, translate(km, 'ACGT', '0123') AS digits FROM {source}))"
    words = []
    for b, start in enumerate(starts):
        last = min(12, k - start // 12 * 12) - 1
        codes = [f"((d{start // 12} // {10 ** (last - (start + i) % 12)} % 10) << {8 * i})"
                 for i in range(min(4, k - start))]
        words.append(f"({' + '.join(codes)}) AS w{b}")
    n = range(len(starts))
    sql = f"SELECT {keep}, km, {', '.join(words)} FROM {source}"
    for make in (lambda w: _mul(w, 0xCC9E2D51), lambda w: _rot(w, 15), lambda w: _mul(w, 0x1B873593)):
        sql = f"SELECT {keep}, km, {', '.join(f'{make(f'w{b}')} AS w{b}' for b in n)} FROM ({sql})"
    sql = f"SELECT {keep}, km, {', '.join(f'w{b}' for b in n)}, 1007110753::BIGINT AS h FROM ({sql})"
    for b, start in enumerate(starts):
        mixed = f"xor(h, w{b})"
        h = f"(({_rot(mixed, 13)} * 5 + 3864292196) & {M})" if start + 4 <= k else mixed
        sql = f"SELECT {keep}, km, {', '.join(f'w{i}' for i in n)}, {h} AS h FROM ({sql})"
    for h in (f"xor(h, {k})", "xor(h, h >> 16)", _mul("h", 0x85EBCA6B), "xor(h, h >> 13)",
              _mul("h", 0xC2B2AE35), "xor(h, h >> 16)"):
        sql = f"SELECT {keep}, km, {h} AS h FROM ({sql})"
    return (f"SELECT {keep}, km, (CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END)::INTEGER AS hash "
            f"FROM ({sql})")


def _kmers(seqs: str, k: int = K) -> str:
    """``sample, km, hash`` of all valid canonical windows of a ``(sample, seq)`` relation."""
    # cut into overlapping pieces first: substr walks its argument from the start
    cut = (f"SELECT sample, substr(seq, c::BIGINT, {CUT + k - 1}) AS seq FROM "
           f"(SELECT sample, seq, unnest(generate_series(1, length(seq) - {k - 1}, {CUT})) AS c FROM {seqs} "
           f"WHERE length(seq) >= {k})")
    win = (f"SELECT sample, substr(seq, i::BIGINT, {k}) AS fwd FROM "
           f"(SELECT sample, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM ({cut}))")
    canon = f"SELECT sample, least(fwd, {_rc('fwd')}) AS km FROM ({win}) WHERE NOT contains(fwd, 'N')"
    return _hash_sql(f"({canon})", k, "sample")


def _sketch(kmers: str, s: int, min_cnt: int = 1, coverage: str = "0") -> str:
    return (f"SELECT sample, hash, ({coverage})::INTEGER AS coverage, kmer FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY sample ORDER BY hash) AS rn FROM ("
            f"SELECT sample, hash, count(*) AS cnt, min(km) AS kmer FROM {kmers} GROUP BY sample, hash "
            f"HAVING count(*) >= {min_cnt})) WHERE rn <= {s}")


def _pairs(sketch: str, where: str = "x.sample < y.sample") -> str:
    """``a, b, shared, sketch_size`` with the union rank of every shared hash."""
    return f"""
      SELECT n.a, n.b, coalesce(c.shared, 0)::INTEGER AS shared, n.s::INTEGER AS sketch_size FROM
        (SELECT x.sample AS a, y.sample AS b, least(x.n, y.n) AS s
         FROM (SELECT sample, count(*) AS n FROM {sketch} GROUP BY sample) x
         JOIN (SELECT sample, count(*) AS n FROM {sketch} GROUP BY sample) y ON {where}) n
      LEFT JOIN
        (SELECT a, b, count(*) AS shared FROM
          (SELECT x.sample AS a, y.sample AS b, least(x.n, y.n) AS s,
                  x.rk + y.rk - row_number() OVER (PARTITION BY x.sample, y.sample ORDER BY x.hash) AS u
           FROM (SELECT sample, hash, row_number() OVER (PARTITION BY sample ORDER BY hash) AS rk,
                        count(*) OVER (PARTITION BY sample) AS n FROM {sketch}) x
           JOIN (SELECT sample, hash, row_number() OVER (PARTITION BY sample ORDER BY hash) AS rk,
                        count(*) OVER (PARTITION BY sample) AS n FROM {sketch}) y
             ON x.hash = y.hash AND {where})
         WHERE u <= s GROUP BY a, b) c
      ON n.a = c.a AND n.b = c.b"""


def _mash(j: str) -> str:
    return (f"CASE WHEN {j} = 0 THEN 'Infinity'::DOUBLE "
            f"ELSE (-1.0::DOUBLE / {K}) * ln(2.0::DOUBLE * {j} / (1.0::DOUBLE + {j})) + 0.0::DOUBLE END")


CTES["src_seq"] = f"SELECT source AS sample, doc_id, {_dna('text')} AS seq FROM documents"
CTES["src_seq_n"] = f"SELECT source AS sample, doc_id, {_dna('text', BASES_N)} AS seq FROM documents"
CTES["doc_seq"] = f"SELECT 'doc' || doc_id AS sample, {_dna('text')} AS seq FROM documents"
CTES["conv_seq"] = f"SELECT 'conv' || conv_id AS sample, {_dna('text')} AS seq FROM conversations"
CTES["item_seq"] = f"SELECT 'item' || item_id AS sample, {_dna('text')} AS seq FROM benchmark"
for _name in ("src", "doc", "conv", "item"):
    CTES[f"{_name}_kmer"] = _kmers(f"{_name}_seq")
CTES["src_kmer_n"] = _kmers("src_seq_n")
CTES["src_kmer35"] = _kmers("src_seq", 35)
CTES["src_sk"] = _sketch("src_kmer", S_SOURCE)
CTES["src_sk_reads"] = _sketch("src_kmer", S_SOURCE, 2, "cnt")
CTES["doc_sk"] = _sketch("doc_kmer", S_DOC)
CTES["conv_sk"] = _sketch("conv_kmer", S_SOURCE)
CTES["item_sk"] = _sketch("item_kmer", S_QUERY)
CTES["item_trim"] = (f"SELECT sample, hash FROM (SELECT sample, hash, row_number() OVER (PARTITION BY sample "
                     f"ORDER BY hash) AS rn FROM item_sk) WHERE rn <= {S_DOC}")
CTES["src_pairs"] = f"""SELECT a, b, shared, sketch_size, j AS jaccard, {_mash('j')} AS distance
    FROM (SELECT *, shared::DOUBLE / sketch_size AS j FROM ({_pairs('src_sk')}))"""
CTES["conv_pairs"] = f"""SELECT a, b, shared, sketch_size, j AS jaccard, {_mash('j')} AS distance
    FROM (SELECT *, shared::DOUBLE / sketch_size AS j FROM ({_pairs('conv_sk')}))"""

# --- the tree over documents: leaf i at position 2i, node g at 2g - 1 ---------

CTES["tree_at"] = """
    SELECT true AS is_leaf, doc_id AS i, -1 AS t, (SELECT count(*) FROM documents) AS n FROM documents
    UNION ALL
    SELECT false, doc_id, length(bin(doc_id & -doc_id)) - 1, (SELECT count(*) FROM documents)
    FROM documents WHERE doc_id > 0"""
CTES["tree_up"] = """
    SELECT is_leaf, i, count(*) AS depth, min(g) FILTER (u = low) AS parent FROM (
      SELECT *, min(u) OVER (PARTITION BY is_leaf, i) AS low FROM (
        SELECT a.is_leaf, a.i, u, (2 * (a.i >> (u + 1)) + 1) << u AS g, a.n FROM tree_at a, range(0, 40) r(u)
        WHERE u > a.t) WHERE g <= n - 1)
    GROUP BY is_leaf, i"""
CTES["tree_base"] = """
    SELECT (CASE WHEN a.is_leaf THEN 2 * a.i ELSE 2 * a.i - 1 END)::INTEGER AS node_id,
           (2 * p.parent - 1)::INTEGER AS parent_id, a.is_leaf,
           CASE WHEN a.is_leaf THEN 'doc' || a.i END AS name, coalesce(p.depth, 0)::INTEGER AS depth,
           (CASE WHEN a.is_leaf THEN 2 * a.i ELSE 2 * (a.i - (1 << greatest(a.t, 0))) END)::INTEGER AS lo,
           (CASE WHEN a.is_leaf THEN 2 * a.i
                 ELSE 2 * (least(a.n, a.i + (1 << greatest(a.t, 0))) - 1) END)::INTEGER AS hi
    FROM tree_at a LEFT JOIN tree_up p ON a.is_leaf = p.is_leaf AND a.i = p.i"""
CTES["tree"] = """
    SELECT b.node_id, b.parent_id, c.left_id, c.right_id, b.is_leaf, b.name,
           CASE WHEN b.parent_id IS NULL THEN 0.0::DOUBLE ELSE (b.node_id % 7 + 1) * 0.01::DOUBLE END AS dist,
           b.depth, b.lo, b.hi
    FROM tree_base b LEFT JOIN
      (SELECT parent_id AS node_id, min(node_id) AS left_id, max(node_id) AS right_id
       FROM tree_base WHERE parent_id IS NOT NULL GROUP BY parent_id) c ON b.node_id = c.node_id"""
# every node with its ancestors, found by walking parent links
CTES["anc"] = """
    SELECT t.node_id, t.node_id AS anc, t.parent_id AS next FROM tree t
    UNION ALL
    SELECT a.node_id, t.node_id, t.parent_id FROM anc a JOIN tree t ON a.next = t.node_id"""
RECURSIVE = {"anc", "linked", "conv_linked", "src_reach", "conv_reach", "src_walk", "chain_y"}
# an edge belongs to the spanning tree unless shorter edges already connect its ends
CTES["edge"] = "SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) AS rk FROM src_pairs"
CTES["edge_both"] = "SELECT a, b, rk FROM edge UNION ALL SELECT b, a, rk FROM edge"
CTES["linked"] = """
    SELECT rk, a AS node FROM edge
    UNION
    SELECT l.rk, e.b FROM linked l JOIN edge_both e ON e.a = l.node AND e.rk < l.rk"""
CTES["sub_leaf"] = ("SELECT a.anc AS node_id, t.node_id AS leaf_id, t.name, t.depth AS leaf_depth "
                    "FROM anc a JOIN tree t ON a.node_id = t.node_id WHERE t.is_leaf")
CTES["leaf_count"] = "SELECT node_id, count(*) AS leafs FROM sub_leaf GROUP BY node_id"
CTES["lca"] = """
    SELECT hash, arg_max(anc, depth) AS node_id FROM (
      SELECT h.hash, a.anc, t.depth, count(*) AS have, any_value(h.want) AS want
      FROM (SELECT s.hash, t.node_id AS leaf, count(*) OVER (PARTITION BY s.hash) AS want
            FROM doc_sk s JOIN tree t ON t.name = s.sample) h
      JOIN anc a ON a.node_id = h.leaf JOIN tree t ON t.node_id = a.anc
      GROUP BY h.hash, a.anc, t.depth) WHERE have = want GROUP BY hash"""
CTES["node_kmers"] = """
    SELECT t.node_id, coalesce(c.kmers, 0)::BIGINT AS kmers FROM tree t LEFT JOIN
      (SELECT a.anc, count(*) AS kmers FROM lca l JOIN anc a ON a.node_id = l.node_id GROUP BY a.anc) c
    ON c.anc = t.node_id"""
CTES["hit"] = ("SELECT q.sample, l.node_id, count(*) AS cnt FROM item_trim q LEFT JOIN lca l ON q.hash = l.hash "
               "GROUP BY q.sample, l.node_id")
CTES["share"] = ("SELECT sample, sum(cnt)::BIGINT AS total, coalesce(sum(cnt) FILTER (node_id IS NOT NULL), 0)::BIGINT AS found "
                 "FROM hit GROUP BY sample")
CTES["report"] = """
    SELECT s.sample, t.node_id AS id, coalesce(t.name, '') AS name,
           coalesce(c.w, 0)::DOUBLE / s.total AS weight
    FROM share s CROSS JOIN tree t LEFT JOIN
      (SELECT h.sample, a.anc, sum(h.cnt) AS w FROM hit h JOIN anc a ON a.node_id = h.node_id GROUP BY h.sample, a.anc) c
    ON c.sample = s.sample AND c.anc = t.node_id"""
CTES["node_label"] = """
    SELECT l.node_id, d.lang AS label, count(*)::DOUBLE / any_value(n.leafs) AS weight
    FROM sub_leaf l JOIN documents d ON l.name = 'doc' || d.doc_id JOIN leaf_count n ON n.node_id = l.node_id
    GROUP BY l.node_id, d.lang"""
CTES["langs"] = "SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS idx FROM (SELECT DISTINCT lang FROM documents)"
CTES["label_raw"] = """
    SELECT s.sample AS name, g.lang AS label, coalesce(c.w, 0.0::DOUBLE) AS w, s.total, s.found
    FROM share s CROSS JOIN langs g LEFT JOIN
      (SELECT h.sample, n.label, sum(h.cnt * n.weight) AS w FROM hit h JOIN node_label n ON n.node_id = h.node_id
       GROUP BY h.sample, n.label) c ON c.sample = s.sample AND c.label = g.lang"""
CTES["labels_plain"] = """
    SELECT name, label, w / total AS weight FROM label_raw UNION ALL
    SELECT sample, 'Unique', 1.0::DOUBLE - found::DOUBLE / total FROM share"""
CTES["labels_prop"] = """
    SELECT name, label, CASE WHEN mass < 0.1 THEN 0.0::DOUBLE ELSE weight / mass END AS weight FROM (
      SELECT *, sum(weight) OVER (PARTITION BY name) AS mass FROM labels_plain WHERE label <> 'Unique')"""


def _with(body: str) -> str:
    """Prefix a statement with the expressions it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?<![\w.'])\b{name}\b(?!\s*\.\s*\w+\s*\()", text) \
                    and re.search(rf"(FROM|JOIN|,)\s+\(?\s*{name}\b", text):
                if not (name in RECURSIVE and text is CTES[name]):
                    visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


def oracle(name: str, body: str) -> None:
    ORACLE[name] = body


# --- sequences ---------------------------------------------------------------

oracle("encode_sequence", """SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
    '[^ACGT]', 'N', 'g') AS encoded FROM documents""")
oracle("reverse_complement", f"SELECT doc_id, {_rc('seq')} AS rc FROM src_seq_n")
CTES["win_n"] = f"""SELECT doc_id, i - 1 AS pos, substr(seq, i::BIGINT, {K}) AS kmer FROM
    (SELECT doc_id, seq, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM src_seq_n WHERE length(seq) >= {K})"""
oracle("kmer_windows", """SELECT doc_id, count(*) AS n_windows, count(*) FILTER (NOT contains(kmer, 'N')) AS n_valid,
    (sum(pos) FILTER (NOT contains(kmer, 'N')))::BIGINT AS pos_sum, max(kmer) AS last_kmer FROM win_n GROUP BY doc_id""")
oracle("canonical_kmers", f"""SELECT doc_id, count(*) FILTER (kmer = c) AS n_forward, min(c) AS first_kmer, max(c) AS last_kmer
    FROM (SELECT doc_id, kmer, least(kmer, {_rc('kmer')}) AS c FROM win_n WHERE NOT contains(kmer, 'N')) GROUP BY doc_id""")
for _q, _t in (("kmer_hash", "src_kmer_n"), ("kmer_hash_k35", "src_kmer35")):
    oracle(_q, f"""SELECT sample, count(*) AS n, sum(hash)::BIGINT AS hash_sum, min(hash) AS hash_min, max(hash) AS hash_max
        FROM {_t} GROUP BY sample""")
oracle("kmer_counts", """SELECT sample, count(*) AS n_distinct, sum(cnt)::BIGINT AS n_total, max(cnt) AS max_cnt FROM
    (SELECT sample, hash, count(*) AS cnt FROM src_kmer GROUP BY sample, hash) GROUP BY sample""")
oracle("kmer_counts_mincov", """SELECT sample, hash, count(*) AS cnt, min(km) AS kmer FROM src_kmer
    GROUP BY sample, hash HAVING count(*) >= 3""")

# --- sketches ----------------------------------------------------------------

oracle("sketch_assembly", "SELECT * FROM src_sk")
oracle("sketch_one_pass", "SELECT * FROM src_sk")
oracle("sketch_reads_mincov1", "SELECT * FROM src_sk_reads")
oracle("sketch_reads_mincov2", _sketch("src_kmer", S_SOURCE, 2))
oracle("sketch_reads_mincov3", _sketch("src_kmer", S_SOURCE, 3))
oracle("sketch_merged", "SELECT * FROM src_sk_reads")
oracle("sketch_merged_assembly", "SELECT * FROM src_sk")
oracle("sketch_track_cov", _sketch("src_kmer", S_SOURCE, 1, "cnt + 1"))
oracle("sketch_documents", "SELECT * FROM doc_sk")
oracle("sketch_conversations", "SELECT * FROM conv_sk")
oracle("sketch_meta", f"""SELECT b.sample, {K} AS kmer_length,
    CASE WHEN max(k.hash) IS NOT NULL THEN
      floor(least(4294967296.0::DOUBLE * ({S_SOURCE}.0::DOUBLE / (max(k.hash)::BIGINT + 2147483649)), 2147483647.0::DOUBLE))::BIGINT
    END AS genome_size,
    count(k.hash)::INTEGER AS sketch_size
    FROM (SELECT DISTINCT sample FROM src_seq) b LEFT JOIN src_sk_reads k ON b.sample = k.sample GROUP BY b.sample""")
CTES["doc_meta"] = f"""SELECT b.sample, {K} AS kmer_length, b.n AS genome_size, coalesce(k.n, 0)::INTEGER AS sketch_size
    FROM (SELECT sample, sum(length(seq))::BIGINT AS n FROM doc_seq GROUP BY sample) b
    LEFT JOIN (SELECT sample, count(*) AS n FROM doc_sk GROUP BY sample) k ON b.sample = k.sample"""
oracle("assembly_size", "SELECT * FROM doc_meta")
oracle("sketch_set_summary", """SELECT count(DISTINCT kmer_length) AS n_lengths, count(DISTINCT sample) AS n_names,
    count(*) AS n_sketches, min(sketch_size) AS min_size, max(sketch_size) AS max_size FROM doc_meta""")
oracle("coverage_histogram", "SELECT sample, coverage, count(*) AS kmers FROM src_sk_reads GROUP BY sample, coverage")
oracle("coverage_stats", """SELECT sample, count(*) AS n, round(avg(coverage), 6) AS mean,
    round(stddev_pop(coverage), 6) AS std_dev, median(coverage)::DOUBLE AS median FROM src_sk_reads GROUP BY sample""")

oracle("coverage_stats_large", """SELECT sample, count(*) AS n, round(avg(coverage + 100000000::BIGINT), 3) AS mean,
    round(stddev_pop(coverage), 4) AS std_dev, (median(coverage) + 100000000)::DOUBLE AS median FROM src_sk_reads GROUP BY sample""")

# --- distances ---------------------------------------------------------------

# passages of which every fifth has no k-mer; those are infinitely far from all others
CTES["short_seq"] = f"""SELECT sample, CASE WHEN substr(sample, 5)::INTEGER % 5 = 0 THEN substr(seq, 1, {K - 1}) ELSE seq END AS seq FROM item_seq"""
CTES["short_kmer"] = _kmers("short_seq")
CTES["short_sk"] = _sketch("short_kmer", S_QUERY)
CTES["short_pairs"] = f"""SELECT a, b, {_mash('j')} AS distance FROM (SELECT *, shared::DOUBLE / sketch_size AS j FROM ({_pairs('short_sk')}))"""
for _q in ("distance_matrix_file", "distance_update_file"):
    oracle(_q, """SELECT x.sample AS a, y.sample AS b, coalesce(round(p.distance, 9), 'Infinity'::DOUBLE) AS distance
        FROM short_seq x JOIN short_seq y ON x.sample < y.sample LEFT JOIN short_pairs p ON p.a = x.sample AND p.b = y.sample""")

for _q, _t in (("mash_distance", "src_pairs"), ("mash_distance_many_blocks", "src_pairs"), ("mash_distance_uneven", "conv_pairs")):
    oracle(_q, f"""SELECT a, b, shared, sketch_size, round(jaccard, 9) AS jaccard, round(distance, 9) AS distance FROM {_t}""")
oracle("jaccard_distance", """SELECT a, b, shared, sketch_size, round(jaccard, 9) AS jaccard,
    round(1.0::DOUBLE - jaccard, 9) AS distance FROM src_pairs""")
CTES["src_both"] = "SELECT a, b, distance FROM src_pairs UNION ALL SELECT b, a, distance FROM src_pairs"
CTES["src_full"] = """SELECT a, b, distance FROM src_both UNION ALL
    SELECT DISTINCT source AS a, source AS b, 0.0::DOUBLE AS distance FROM documents"""
oracle("nearest_sample", """SELECT sample, nearest, round(distance, 9) AS distance FROM (
    SELECT a AS sample, b AS nearest, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn FROM src_both)
    WHERE rn = 1""")
_SRC = sorted(f"src{i}" for i in range(20))
oracle("distance_matrix", "SELECT a, " + ", ".join(
    f"max(round(distance, 9)) FILTER (b = '{s}') AS {s}" for s in _SRC) + " FROM src_full GROUP BY a")
CTES["src_names"] = "SELECT source AS name, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS idx FROM (SELECT DISTINCT source FROM documents)"
oracle("distance_matrix_rows", """SELECT x.idx, x.name, y.idx AS j,
    CASE WHEN x.name = y.name THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - p.jaccard, 9) END AS distance
    FROM src_names x CROSS JOIN src_names y
    LEFT JOIN src_pairs p ON p.a = least(x.name, y.name) AND p.b = greatest(x.name, y.name)""")
for _q in ("matrix_unpivot", "distance_update"):
    oracle(_q, "SELECT a, b, round(distance, 9) AS distance FROM src_pairs")
oracle("distance_new_pairs", "SELECT a, b, shared, sketch_size FROM src_pairs WHERE a >= 'src15' OR b >= 'src15'")
oracle("distance_lookup", "SELECT b AS x, a AS y, round(distance, 9) AS distance FROM src_pairs")
CTES["next_pair"] = """SELECT x.sample AS a, y.sample AS b, least(x.sketch_size, y.sketch_size) AS s FROM doc_meta x JOIN doc_meta y
    ON y.sample = 'doc' || (substr(x.sample, 4)::BIGINT + 1) WHERE x.sketch_size > 0 AND y.sketch_size > 0"""
oracle("bottom_union", """SELECT a, b, count(*)::INTEGER AS union_size, max(hash) AS top, (count(*) FILTER (n = 2))::INTEGER AS shared FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hash) AS rn FROM (
      SELECT a, b, s, hash, count(*) AS n FROM (
        SELECT p.a, p.b, p.s, k.hash FROM next_pair p JOIN doc_sk k ON k.sample = p.a UNION ALL
        SELECT p.a, p.b, p.s, k.hash FROM next_pair p JOIN doc_sk k ON k.sample = p.b)
      GROUP BY a, b, s, hash)) WHERE rn <= s GROUP BY a, b""")
oracle("shared_hash_semi", """SELECT sample, count(*) AS n_shared FROM doc_sk
    WHERE hash IN (SELECT hash FROM item_sk) GROUP BY sample""")
oracle("unique_hash_anti", "SELECT sample, hash FROM item_sk WHERE hash NOT IN (SELECT hash FROM doc_sk)")
CTES["doc_size"] = "SELECT sample, sum(length(seq))::DOUBLE AS n FROM doc_seq GROUP BY sample"
oracle("random_kmer_probability", f"SELECT sample, round(n / (n + {float(4 ** K)}::DOUBLE) * 1e9::DOUBLE, 9) AS p_scaled FROM doc_size")
oracle("expected_jaccard", f"""SELECT sample, round(px * py / (px + py - px * py) * 1e9::DOUBLE, 9) AS j_scaled FROM
    (SELECT sample, n / (n + {float(4 ** K)}::DOUBLE) AS px,
     10000000.0::DOUBLE / (10000000.0::DOUBLE + {float(4 ** K)}::DOUBLE) AS py FROM doc_size)""")
oracle("pair_count", "SELECT lang, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM documents GROUP BY lang")

oracle("spanning_tree", """SELECT e.a, e.b, round(e.distance, 9) AS distance FROM edge e
    WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.rk = e.rk AND l.node = e.b)""")

# merges of single linkage: the clusters that the shorter edges of the spanning tree form at the two ends of each
CTES["conv_edge"] = "SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) AS rk FROM conv_pairs"
CTES["conv_edge_both"] = "SELECT a, b, rk FROM conv_edge UNION ALL SELECT b, a, rk FROM conv_edge"
CTES["conv_linked"] = """
    SELECT rk, a AS node FROM conv_edge
    UNION
    SELECT l.rk, e.b FROM conv_linked l JOIN conv_edge_both e ON e.a = l.node AND e.rk < l.rk"""
for _t, _e, _l in (("src", "edge", "linked"), ("conv", "conv_edge", "conv_linked")):
    CTES[f"{_t}_mst"] = f"""SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) - 1 AS merge FROM {_e} e
        WHERE NOT EXISTS (SELECT 1 FROM {_l} l WHERE l.rk = e.rk AND l.node = e.b)"""
    CTES[f"{_t}_mst_both"] = f"SELECT a, b, merge FROM {_t}_mst UNION ALL SELECT b, a, merge FROM {_t}_mst"
    CTES[f"{_t}_reach"] = f"""
        SELECT merge, s AS side, CASE WHEN s = 0 THEN a ELSE b END AS node FROM {_t}_mst, range(0, 2) r(s)
        UNION
        SELECT r.merge, r.side, e.b FROM {_t}_reach r JOIN {_t}_mst_both e ON e.a = r.node AND e.merge < r.merge"""
    CTES[f"{_t}_side"] = f"SELECT merge, side, min(node) AS name, count(*) AS n FROM {_t}_reach GROUP BY merge, side"
    CTES[f"{_t}_next"] = f"SELECT m.merge, min(r.merge) AS parent FROM {_t}_mst m JOIN {_t}_reach r ON r.node = m.a AND r.merge > m.merge GROUP BY m.merge"
    CTES[f"{_t}_merges"] = f"""SELECT m.merge, m.distance AS height, p.parent, least(x.name, y.name) AS left_name, greatest(x.name, y.name) AS right_name,
        (CASE WHEN x.name < y.name THEN x.n ELSE y.n END)::BIGINT AS left_n, (x.n + y.n)::BIGINT AS members
        FROM {_t}_mst m JOIN {_t}_side x ON x.merge = m.merge AND x.side = 0 JOIN {_t}_side y ON y.merge = m.merge AND y.side = 1
        LEFT JOIN {_t}_next p ON p.merge = m.merge"""
for _q, _t in (("dendrogram_nodes", "src"), ("dendrogram_conversations", "conv")):
    oracle(_q, f"SELECT merge, round(height, 9) AS height, parent, left_name, right_name, members FROM {_t}_merges")
# from the last merge down: the left cluster's ids, the node's own, the right cluster's
CTES["src_walk"] = """
    SELECT merge, 0::BIGINT AS off, 0 AS depth, NULL::BIGINT AS parent_id, 0.0::DOUBLE AS dist FROM src_merges WHERE parent IS NULL
    UNION ALL
    SELECT c.merge, w.off + CASE WHEN c.left_name = p.left_name THEN 0 ELSE 2 * p.left_n END, w.depth + 1, w.off + 2 * p.left_n - 1, p.height
    FROM src_walk w JOIN src_merges p ON p.merge = w.merge JOIN src_merges c ON c.parent = w.merge"""
oracle("dendrogram_tree_nodes", """
    SELECT (off + 2 * left_n - 1)::INTEGER AS node_id, parent_id::INTEGER AS parent_id, false AS is_leaf, NULL AS name, round(dist, 9) AS dist, depth::INTEGER AS depth,
      off::INTEGER AS lo, (off + 2 * members - 2)::INTEGER AS hi FROM src_walk JOIN src_merges USING (merge)
    UNION ALL
    SELECT id::INTEGER, up::INTEGER, true, name, round(height, 9), depth + 1, id::INTEGER, id::INTEGER FROM (
      SELECT off AS id, off + 1 AS up, left_name AS name, height, depth FROM src_walk JOIN src_merges USING (merge) WHERE left_n = 1
      UNION ALL SELECT off + 2 * left_n, off + 2 * left_n - 1, right_name, height, depth FROM src_walk JOIN src_merges USING (merge) WHERE members - left_n = 1)""")

# --- trees -------------------------------------------------------------------

# the chain: node 2g - 1 is above leaf g - 1 and all later ones
CTES["chain"] = """SELECT doc_id AS i, lang, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS bases, count(*) OVER () - 1 AS last FROM documents"""
oracle("chain_postorder", "SELECT (last - i)::INTEGER AS position, (2 * i - 1)::INTEGER AS node_id FROM chain WHERE i > 0")
CTES["chain_inner"] = """SELECT i, sum(CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE ((2 * i - 1) % 5 + 1) / 4.0::DOUBLE END) OVER (ORDER BY i) AS x
    FROM chain WHERE i > 0"""
oracle("chain_root_distance", """SELECT (2 * i - 1)::INTEGER AS node_id, round(x, 6) AS x FROM chain_inner UNION ALL
    SELECT (2 * c.i)::INTEGER, round(n.x + ((2 * c.i) % 5 + 1) / 4.0::DOUBLE, 6) FROM chain c JOIN chain_inner n ON n.i = least(c.i + 1, c.last)""")
CTES["chain_y"] = """
    SELECT max(last)::BIGINT AS i, max(last) - 0.5::DOUBLE AS y FROM chain
    UNION ALL
    SELECT i - 1, (i - 2 + y) / 2 FROM chain_y WHERE i > 1"""
CTES["chain_x"] = """SELECT 2 * i - 1 AS node_id, x FROM chain_inner UNION ALL
    SELECT 2 * c.i, n.x + ((2 * c.i) % 5 + 1) / 4.0::DOUBLE FROM chain c JOIN chain_inner n ON n.i = least(c.i + 1, c.last)"""
oracle("chain_coordinates", """SELECT x.node_id::INTEGER AS node_id, round(x.x / (SELECT max(x) FROM chain_x) * 1000.0::DOUBLE, 6) AS x,
    round(coalesce(y.y, x.node_id / 2.0::DOUBLE) * (1000.0::DOUBLE / (SELECT count(*) FROM chain)), 6) AS y
    FROM chain_x x LEFT JOIN chain_y y ON x.node_id = 2 * y.i - 1""")
oracle("renumbered_tree", """SELECT 'balanced' AS tree, md5(node_id::VARCHAR) AS key, node_id, parent_id, is_leaf, name, depth, lo, hi FROM tree UNION ALL
    SELECT 'chain', md5((2 * i)::VARCHAR), 2 * i, least(2 * i + 1, 2 * last - 1), true, 'doc' || i, least(i + 1, last), 2 * i, 2 * i FROM chain UNION ALL
    SELECT 'chain', md5((2 * i - 1)::VARCHAR), 2 * i - 1, CASE WHEN i > 1 THEN 2 * i - 3 END, false, NULL, i - 1, 2 * i - 2, 2 * last FROM chain WHERE i > 0""")
# Newick lines: leaf j of a document's m lines is the left child of inner node j, which has all before it on its right
CTES["newick"] = "SELECT doc_id AS tree, doc_id % 11 AS kind, string_split(text, chr(10)) AS l FROM documents"
CTES["newick_line"] = "SELECT tree, kind, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS j, len(l) AS m FROM newick"
CTES["newick_good"] = "SELECT * FROM newick_line WHERE m > 1 AND kind NOT IN (3, 5, 7, 9)"
oracle("newick_nodes", """
    SELECT tree, (2 * (m - 1 - j))::INTEGER AS node_id, (CASE WHEN j = 0 THEN 2 * (m - 2) + 1 ELSE 2 * (m - 1 - j) + 1 END)::INTEGER AS parent_id,
      NULL::INTEGER AS left_id, NULL::INTEGER AS right_id, true AS is_leaf, 'l' || j AS name, length(line)::DOUBLE AS dist, (CASE WHEN j = 0 THEN m - 1 ELSE m - j END)::INTEGER AS depth,
      (2 * (m - 1 - j))::INTEGER AS lo, (2 * (m - 1 - j))::INTEGER AS hi FROM newick_good
    UNION ALL
    SELECT tree, (2 * (m - 1 - j) + 1)::INTEGER, (CASE WHEN j < m - 1 THEN 2 * (m - 2 - j) + 1 END)::INTEGER, (2 * (m - 1 - j))::INTEGER,
      (CASE WHEN j = 1 THEN 2 * (m - 1) ELSE 2 * (m - j) + 1 END)::INTEGER, false, NULL, CASE WHEN j < m - 1 THEN (j % 5)::DOUBLE ELSE 0.0::DOUBLE END,
      (m - 1 - j)::INTEGER, (2 * (m - 1 - j))::INTEGER, (2 * (m - 1))::INTEGER FROM newick_good WHERE j > 0""")
oracle("newick_problems", """SELECT tree, CASE WHEN len(l) < 2 AND kind <> 5 OR kind = 3 THEN 'a tree must read ''(...);'' without a root label'
    WHEN kind = 5 AND len(l) < 2 THEN 'a tree must read ''(...);'' without a root label' WHEN kind = 5 THEN 'unbalanced parentheses'
    WHEN kind = 7 THEN 'branch without a length' ELSE 'leaf names must be unique' END AS problem
    FROM newick WHERE len(l) < 2 OR kind IN (3, 5, 7, 9)""")
oracle("chain_largest_genome", """SELECT (2 * i)::INTEGER AS node_id, bases::BIGINT AS largest FROM chain UNION ALL
    SELECT (2 * i - 1)::INTEGER, max_after::BIGINT FROM
      (SELECT i, max(bases) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) AS max_after FROM chain) WHERE i > 0""")
oracle("chain_colour", """SELECT (2 * i)::INTEGER AS node_id, lang AS colour FROM chain UNION ALL
    SELECT (2 * i - 1)::INTEGER, lo FROM (SELECT i, min(lang) OVER w AS lo, max(lang) OVER w AS hi FROM chain
      WINDOW w AS (ORDER BY i ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING)) WHERE i > 0 AND lo = hi""")
oracle("chain_label_weights", """SELECT (2 * i)::INTEGER AS node_id, lang AS label, 1.0::DOUBLE AS weight FROM chain UNION ALL
    SELECT (2 * i - 1)::INTEGER, l, round(k::DOUBLE / (last - i + 2), 9) FROM (SELECT c.i, c.last, g.lang AS l,
      sum((c.lang = g.lang)::INTEGER) OVER (PARTITION BY g.lang ORDER BY c.i ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) AS k
      FROM chain c, (SELECT DISTINCT lang FROM chain) g) WHERE i > 0 AND k > 0""")

oracle("tree_nodes", "SELECT * FROM tree")
oracle("tree_leaf_order", "SELECT (row_number() OVER (ORDER BY node_id) - 1)::INTEGER AS position, name FROM tree WHERE is_leaf")
oracle("tree_postorder", """SELECT (row_number() OVER (ORDER BY hi, lo DESC) - 1)::INTEGER AS position, node_id
    FROM tree WHERE NOT is_leaf""")
oracle("tree_leaf_parent", "SELECT node_id, parent_id FROM tree WHERE is_leaf")
oracle("tree_levels", """SELECT t.node_id, (c.n - 1)::INTEGER AS depth, t.dist FROM tree t
    JOIN (SELECT node_id, count(*) AS n FROM anc GROUP BY node_id) c ON c.node_id = t.node_id""")
oracle("tree_subtree_size", """SELECT t.node_id, (CASE WHEN t.is_leaf THEN 1 ELSE c.n - 1 END)::INTEGER AS nodes,
    l.leafs::INTEGER AS leafs FROM tree t
    JOIN (SELECT anc, count(*) AS n FROM anc GROUP BY anc) c ON c.anc = t.node_id
    JOIN leaf_count l ON l.node_id = t.node_id""")
oracle("tree_descendants", """SELECT a.anc AS node_id, a.node_id AS descendant_id FROM anc a JOIN tree t ON t.node_id = a.anc
    WHERE t.is_leaf OR a.node_id <> a.anc""")
oracle("tree_leaf_names", """SELECT node_id, count(*)::INTEGER AS n, md5(string_agg(name, ',' ORDER BY name)) AS names_md5
    FROM sub_leaf GROUP BY node_id""")
oracle("tree_leaf_name_rows", "SELECT node_id, name FROM sub_leaf")
oracle("tree_largest_genome", """SELECT l.node_id, max(d.n)::BIGINT AS largest FROM sub_leaf l
    JOIN doc_size d ON d.sample = l.name GROUP BY l.node_id""")
CTES["root_x"] = "SELECT a.node_id, sum(t.dist) AS x FROM anc a JOIN tree t ON t.node_id = a.anc GROUP BY a.node_id"
CTES["node_y"] = """SELECT l.node_id, sum(l.leaf_id / 2.0::DOUBLE * (1000.0::DOUBLE / (SELECT count(*) FROM documents))
    * pow(0.5::DOUBLE, l.leaf_depth - t.depth)) AS y FROM sub_leaf l JOIN tree t ON t.node_id = l.node_id GROUP BY l.node_id"""
oracle("tree_coordinates", """SELECT x.node_id, round(x.x / (SELECT max(x) FROM root_x) * 1000.0::DOUBLE, 6) AS x,
    round(y.y, 6) AS y FROM root_x x JOIN node_y y ON x.node_id = y.node_id""")
oracle("tree_coordinates_equal", """SELECT t.node_id, round(t.depth::DOUBLE / (SELECT max(depth) FROM tree) * 1000.0::DOUBLE, 6) AS x,
    round(y.y, 6) AS y FROM tree t JOIN node_y y ON t.node_id = y.node_id""")
oracle("node_colour", """SELECT l.node_id, min(d.lang) AS colour FROM sub_leaf l JOIN documents d ON l.name = 'doc' || d.doc_id
    GROUP BY l.node_id HAVING count(DISTINCT d.lang) = 1""")
CTES["range_pair"] = """SELECT doc_id, (2 * least(doc_id, o))::INTEGER AS lo_id, (2 * greatest(doc_id, o))::INTEGER AS hi_id FROM
    (SELECT doc_id, (doc_id * 7 + (SELECT count(*) FROM documents) // 3) % (SELECT count(*) FROM documents) AS o FROM documents)"""
oracle("lca_of_ranges", """SELECT p.doc_id, any_value(p.lo_id) AS lo_id, any_value(p.hi_id) AS hi_id,
    arg_max(x.anc, t.depth) AS node_id FROM range_pair p JOIN anc x ON x.node_id = p.lo_id
    JOIN anc y ON y.node_id = p.hi_id AND y.anc = x.anc JOIN tree t ON t.node_id = x.anc GROUP BY p.doc_id""")
oracle("kmer_lca", "SELECT hash, node_id FROM lca")
oracle("kmer_lca_shuffled", ORACLE["kmer_lca"])
oracle("node_total_kmers", "SELECT node_id, kmers FROM node_kmers")
oracle("tree_metrics", """SELECT t.node_id AS id, coalesce(t.name, '') AS name,
    (CASE WHEN t.is_leaf THEN 1 ELSE 2 * l.leafs - 2 END)::INTEGER AS nodes, l.leafs::INTEGER AS leafs, k.kmers
    FROM tree t JOIN leaf_count l ON l.node_id = t.node_id JOIN node_kmers k ON k.node_id = t.node_id""")

# --- queries -----------------------------------------------------------------

oracle("query_trim", "SELECT sample, hash FROM item_trim")
oracle("query_node_counts", "SELECT sample, node_id, cnt FROM hit WHERE node_id IS NOT NULL")
oracle("query_bucketed", "SELECT sample, node_id, cnt FROM hit WHERE node_id IS NOT NULL")
oracle("query_explained", "SELECT sample, total, found, round(found::DOUBLE / total, 9) AS explained FROM share")
CTES["short_trim"] = (f"SELECT sample, hash FROM (SELECT sample, hash, row_number() OVER (PARTITION BY sample "
                      f"ORDER BY hash) AS rn FROM short_sk) WHERE rn <= {S_DOC}")
oracle("query_reports_empty", """SELECT q.sample, count(t.hash) AS total, count(l.hash) AS found,
    round(CASE WHEN count(t.hash) = 0 THEN 0.0::DOUBLE ELSE count(l.hash)::DOUBLE / count(t.hash) END, 9) AS explained
    FROM short_seq q LEFT JOIN short_trim t ON t.sample = q.sample LEFT JOIN (SELECT DISTINCT hash FROM doc_sk) l ON l.hash = t.hash
    GROUP BY q.sample""")
oracle("query_node_report", "SELECT sample, id, name, round(weight, 9) AS weight FROM report")
oracle("query_pooled", """SELECT 'all' AS sample, t.node_id AS id, coalesce(t.name, '') AS name,
    round(coalesce(c.w, 0)::DOUBLE / (SELECT sum(total) FROM share), 9) AS weight FROM tree t LEFT JOIN
    (SELECT a.anc, sum(h.cnt) AS w FROM hit h JOIN anc a ON a.node_id = h.node_id GROUP BY a.anc) c ON c.anc = t.node_id""")
CTES["top_weight"] = "SELECT id, max(weight) AS weight FROM report GROUP BY id"
oracle("branch_widths", """SELECT id, round(CASE WHEN weight * 8 >= 0.4 THEN weight * 8 ELSE 0.0::DOUBLE END, 9) AS width
    FROM top_weight""")
CTES["coords"] = """SELECT x.node_id, x.x / (SELECT max(x) FROM root_x) * 1000.0::DOUBLE AS x, y.y, w.weight * 8 AS width, t.parent_id
    FROM root_x x JOIN node_y y ON x.node_id = y.node_id JOIN top_weight w ON w.id = x.node_id JOIN tree t ON t.node_id = x.node_id"""
oracle("tree_strokes", """SELECT round(p.x, 6) AS x1, round(CASE WHEN v THEN p.y ELSE c.y END, 6) AS y1,
    round(CASE WHEN v THEN p.x ELSE c.x END, 6) AS x2, round(c.y, 6) AS y2, round(c.width, 6) AS width
    FROM coords c JOIN coords p ON c.parent_id = p.node_id CROSS JOIN (VALUES (true), (false)) s(v)
    WHERE c.width > 0 AND p.width > 0""")

# --- labels ------------------------------------------------------------------

oracle("node_label_weights", "SELECT node_id, label, round(weight, 9) AS weight FROM node_label")
oracle("label_scores", "SELECT name, label, round(weight, 9) AS weight FROM labels_plain")
oracle("label_scores_normalized", """SELECT name, label,
    round(CASE WHEN found = 0 THEN 0.0::DOUBLE ELSE w / found END, 9) AS weight FROM label_raw""")
_LANGS = ("de", "en", "es", "fr")
oracle("label_matrix", "SELECT name, " + ", ".join(
    f"round(max(weight) FILTER (label = '{x}'), 9) AS \"{x}\"" for x in (*_LANGS, "Unique")) + " FROM labels_plain GROUP BY name")
oracle("label_matrix_min_prop", "SELECT name, " + ", ".join(
    f"round(max(weight) FILTER (label = '{x}'), 9) AS \"{x}\"" for x in _LANGS) + " FROM labels_prop GROUP BY name")
oracle("label_checks", """SELECT name, count(DISTINCT label) AS labels, round(sum(weight), 2) AS total
    FROM labels_prop GROUP BY name""")
oracle("label_bar_offsets", """SELECT name, label, idx, round(coalesce(sum(weight) OVER (PARTITION BY name ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) * 1000, 6) AS x, round(weight * 1000, 6) AS w
    FROM (SELECT p.name, p.label, p.weight, coalesce(g.idx, (SELECT count(*) FROM langs))::INTEGER AS idx
          FROM labels_plain p LEFT JOIN langs g ON g.lang = p.label)""")
oracle("matrix_fade", "SELECT a, b, round(1.0::DOUBLE - least(distance, 1.0::DOUBLE), 9) AS opacity FROM conv_pairs")

# --- files, manifests, text --------------------------------------------------

oracle("sample_files", "SELECT sample, count(*) AS records, sum(length(seq))::BIGINT AS bases FROM src_seq GROUP BY sample")
oracle("path_list", "SELECT count(*) AS records, sum(length(seq))::BIGINT AS bases FROM src_seq")
oracle("fasta_records", "SELECT seq FROM src_seq WHERE length(seq) > 0")
oracle("fastq_records", "SELECT seq FROM src_seq")
oracle("path_parts", r"""SELECT page_id, base, regexp_extract(base, '^(.*)\.[^.]*$', 1) AS stem,
    regexp_extract(base, '([^.]*)$', 1) AS extension,
    CASE WHEN regexp_matches(base, '(fastq|fq)\.gz$') THEN 'fastq.gz' WHEN regexp_matches(base, '(fa|fasta|fna)$') THEN 'fasta'
         WHEN regexp_matches(base, '(fastq|fq)$') THEN 'fastq' END AS file_type
    FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)""")
oracle("file_types", """SELECT path, count(*) AS n,
    CASE WHEN suffix(path, 'fastq.gz') OR suffix(path, 'fq.gz') THEN 'fastq.gz'
         WHEN suffix(path, 'fa') OR suffix(path, 'fasta') OR suffix(path, 'fna') THEN 'fasta'
         WHEN suffix(path, 'fastq') OR suffix(path, 'fq') THEN 'fastq' END AS file_type
    FROM (SELECT source || '/' || (['x.fa', 'xfasta', 'x.fna', 'x.fastq', 'x.fq', 'x.fq.gz', 'x.fastq.gz', 'x.fa.gz', 'x.txt'])[doc_id % 9 + 1] AS path
          FROM documents) GROUP BY path""")
_LINE = "regexp_replace(text, '[^A-Za-z ]', ' ', 'g')"
oracle("header_tokens", rf"SELECT item_id, regexp_split_to_array({_LINE}, '\s+')[1] AS token FROM benchmark")
oracle("prepared_ids", rf"""SELECT source, regexp_split_to_array(line, '\s+')[1] || '+' || idx AS id FROM
    (SELECT source, arg_min({_LINE}, doc_id) AS line, min(doc_id) AS idx FROM documents GROUP BY source)""")
oracle("library_files", "SELECT DISTINCT source AS sample, '/data/' || lang || '.fq' AS file FROM documents")
CTES["libs"] = "SELECT sample, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT source AS sample, '/data/' || lang || '.fq' AS file FROM documents) GROUP BY sample"
_CMD = ("'kmergrid sketch --seq-files ' || files || ' --kmer-size 21 --sketch-size 1000 --min-cov 2 --name ' || sample "
        "|| ' -o /out/' || sample")
oracle("sketch_commands", f"SELECT sample, {_CMD} || ' --assembly --track-cov' AS command FROM libs")
oracle("cluster_scripts", f"""SELECT sample, 0 AS idx, '#OUT /out/' || sample || '/' || sample || '.out' AS line FROM libs UNION ALL
    SELECT sample, 1, 'run ' || {_CMD} || ' > /out/' || sample || '/' || sample || '.out' FROM libs""")


def statements() -> dict[str, str]:
    return {name: _with(body) for name, body in ORACLE.items()}
