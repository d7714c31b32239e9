"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from quarry.llm.sharding import Node, grown, tree


def _placed(key: str, node: Node) -> str:
    """The shard that a key reaches below a node: at each node the child with the least draw."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _placed(key, node.children[0])
    draw = [f"-ln((CAST('0x' || substr(md5({key} || '/{c.name}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / {c.weight}" for c in node.children]
    won = [" AND ".join(f"{d} {'<' if j < i else '<='} {e}" for j, e in enumerate(draw) if j != i) for i, d in enumerate(draw)]
    return "CASE " + " ".join(f"WHEN {w} THEN {_placed(key, c)}" for w, c in zip(won, node.children)) + " END"


SHARDING = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(0, 256) r(i))),
  d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda c, b: xor(t[1 + (xor(c, CAST('0x' || b AS BIGINT)) & 255)], c >> 8), 4294967295), 4294967295) AS text_crc32 FROM documents, tab),
  p AS (SELECT *, {_placed('k', tree())} AS shard, {_placed('k', grown(tree(), 8))} AS grown_shard, (CAST('0x' || substr(md5(k || '/' || text_crc32 || '/' || size || '/slot'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS spot FROM d)
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY spot, k, text_crc32, size) - 1 AS slot, grown_shard FROM p"""

NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  e AS (SELECT doc_id, unnest(s) AS x FROM s),
  shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT i, j FROM shared JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
  reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.j FROM reach JOIN links ON links.i = reach.r),
  comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY ALL)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, count(*) OVER (PARTITION BY CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) ELSE CAST(doc_id AS VARCHAR) END) AS n_class FROM s JOIN comp USING (doc_id)"""
