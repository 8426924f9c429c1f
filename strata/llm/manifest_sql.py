"""DuckDB SQL of the quarantine and the manifest, by recursion over turns and over levels."""

#: crc32 of a text: the table of its polynomial by rule, then byte after byte.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"


def _crc(text: str) -> str:
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, crcs.t[(xor(c, b) & 255) + 1])))"


def _h(k: int) -> str:
    return _crc(f"'{k}:' || conv_id || ':' || turn")


_AT = [f"(begun + {20 * (2**a - 1)})" for a in range(4)]
_PASSES = [f"(NOT faulty OR ({at} >= repaired AND NOT fails[{a + 1}]))" for a, at in enumerate(_AT)]

_REPLAY = f"""
WITH RECURSIVE crcs AS (SELECT {_CRC_TABLE} AS t),
turns AS (
  SELECT conv_id, turn, {_crc("coalesce(text, '')")} AS crc, {_h(0)} % 7 AS away, {_h(1)} % 101 < 20 AS faulty, {_h(2)} % 101 AS wait, [{", ".join(f"{_h(a)} % 3 = 0" for a in range(3, 7))}] AS fails
  FROM conversations, crcs WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, crc) - 1 AS p FROM turns),
steps AS (
  SELECT conv_id, -1::BIGINT AS p, []::STRUCT(status VARCHAR, attempts INT, first_at BIGINT, last_at BIGINT)[] AS done FROM placed WHERE p = 0
  UNION ALL
  SELECT conv_id, p, done || [CASE WHEN parent.status <> 'delivered' THEN {{'status': 'blocked', 'attempts': 0, 'first_at': NULL, 'last_at': NULL}}
    {" ".join(f"WHEN {ok} THEN {{'status': 'delivered', 'attempts': {a + 1}, 'first_at': begun, 'last_at': {at}}}" for a, (ok, at) in enumerate(zip(_PASSES, _AT, strict=True)))}
    ELSE {{'status': 'dead', 'attempts': 4, 'first_at': begun, 'last_at': {_AT[-1]}}} END]
  FROM (
    SELECT *, greatest(7 * p, coalesce(parent.last_at, 0)) AS begun, 7 * p + wait AS repaired
    FROM (SELECT t.*, s.done, CASE WHEN away > 0 AND t.p >= away THEN s.done[t.p - away + 1] END AS parent FROM steps AS s JOIN placed AS t ON t.conv_id = s.conv_id AND t.p = s.p + 1))),
outcomes AS (SELECT t.conv_id, t.turn, t.crc, t.p, s.done[t.p + 1] AS o FROM placed AS t JOIN (SELECT conv_id, max_by(done, p) AS done FROM steps GROUP BY conv_id) AS s USING (conv_id)),
released AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY o.last_at, turn, p) AS release_no, crc FROM outcomes WHERE o.status = 'delivered'),
states AS (SELECT conv_id, p, release_no, (sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no))::BIGINT AS state FROM released)
SELECT conv_id, turn, o.status AS status, o.attempts AS attempts, o.first_at AS first_at, o.last_at AS last_at, release_no, state FROM outcomes LEFT JOIN states USING (conv_id, p)
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE conv_id IS NULL OR turn IS NULL"""


def _leaf(text: str) -> str:
    written = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(written(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, lowest: str) -> str:
    """CTEs: ``name``_up, nodes (tree, level, i, h, n) of every level, and ``name``_runs with what stands left and right of each in its run."""
    side = lambda sign: f"coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY tree, level, i // 3 ORDER BY i ROWS BETWEEN {sign}), '')"
    return f"""{name}_up AS (
  SELECT tree, 0 AS level, i, h, n FROM {lowest}
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name}_up WHERE n > 1 GROUP BY tree, level, i // 3),
{name}_runs AS (SELECT *, {side("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {side("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM {name}_up)"""


_MANIFEST = f"""
WITH RECURSIVE crcs AS (SELECT {_CRC_TABLE} AS t),
leaves AS (
  SELECT doc_id, source AS tree, {_leaf("text")} AS h, CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents, crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree("low", "placed")},
subroots AS (SELECT tree AS of, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_up WHERE n = 1),
tops AS (SELECT '' AS tree, i, subroot AS h, n FROM subroots),
{_tree("top", "tops")},
walk AS (
  SELECT doc_id, tree, i AS leaf_no, i, 0 AS level, h AS leaf, '' AS proof, coalesce(changed, h) AS folded, n FROM placed
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_no, w.i // 3, w.level + 1, w.leaf, w.proof || r.l || r.r, sha256(r.l || w.folded || r.r), (w.n + 2) // 3
  FROM walk AS w JOIN low_runs AS r ON r.tree IS NOT DISTINCT FROM w.tree AND r.level = w.level AND r.i = w.i WHERE w.n > 1),
reached AS (SELECT w.doc_id, w.leaf, w.proof, w.folded, s.subroot, s.i, s.n, row_number() OVER () AS id FROM walk AS w JOIN subroots AS s ON s.of IS NOT DISTINCT FROM w.tree WHERE w.n = 1),
over AS (
  SELECT id, doc_id, leaf, subroot, i, 0 AS level, proof, folded, n FROM reached
  UNION ALL
  SELECT o.id, o.doc_id, o.leaf, o.subroot, o.i // 3, o.level + 1, o.proof || r.l || r.r, sha256(r.l || o.folded || r.r), (o.n + 2) // 3
  FROM over AS o JOIN top_runs AS r ON r.level = o.level AND r.i = o.i WHERE o.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM over, (SELECT h AS root FROM top_up WHERE n = 1) WHERE n = 1"""

SQL = {"op11_quarantine": _REPLAY, "op12_merkle": _MANIFEST}
