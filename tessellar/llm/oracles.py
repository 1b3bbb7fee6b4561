"""SQL oracles, in DuckDB's dialect, of the operators whose results SQL can express."""

from __future__ import annotations

from . import settings

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN first USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN x END, ' ' ORDER BY word.i), '') AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT source, trim(unnest(l)) AS x FROM d),
b AS (SELECT x FROM e WHERE x <> '' GROUP BY x HAVING count(DISTINCT coalesce(source, '-')) >= {settings.BOILERPLATE_SITES}),
u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM d)
SELECT doc_id, count(*) AS n_lines, count(b.x) AS n_removed, sha256(coalesce(string_agg(CASE WHEN b.x IS NULL THEN u.x END, chr(10) ORDER BY k), '')) AS kept_sha256 FROM u LEFT JOIN b ON trim(u.x) = b.x GROUP BY doc_id"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, links.b FROM r JOIN links ON links.a = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: SHA-1 in base32: each five hexadecimal digits are twenty bits, and so four signs.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT page_id, payload_bytes, first, list_transform(range(0, 8), lambda g: ('0x' || substr(x, cast(g * 5 + 1 AS BIGINT), 5))::INTEGER) AS v FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 15 & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 10 & 31) + 1, 1),
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 5 & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1))), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""


def source_mixing(fraction: float, epochs: int, seed: int) -> str:
    """The tree of three levels, shared out level by level, and the prefix of each leaf's last epoch."""
    domains = " ".join(f"WHEN instr('{digits}', f) > 0 THEN '{name}'" for name, digits in settings.DOMAINS.items())

    def weight(depth: int) -> str:
        cases = " ".join(f"WHEN {' AND '.join(f"l{k} = '{v}'" for k, v in enumerate(path))} THEN {w}" for path, w in settings.WEIGHTS.items() if len(path) == depth)
        return f"CASE {cases} ELSE 1.0 END" if cases else "1.0"

    parts = [
        f"z AS (SELECT doc_id, source, lang, substr(md5(coalesce(source, '')), 1, 1) AS f, cast(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents)",
        f"s AS (SELECT doc_id, CASE {domains} END AS l0, coalesce(lang, '(none)') AS l1, coalesce(source, '(none)') AS l2, n_tokens FROM z)",
        "leaf AS (SELECT l0, l1, l2, cast(sum(n_tokens) AS DOUBLE) AS size FROM s GROUP BY ALL)",
        f"b0 AS (SELECT sum(size) * {fraction} AS budget FROM leaf)",
    ]
    for depth in (1, 2, 3):
        keys, parent = ", ".join(f"l{k}" for k in range(depth)), ", ".join(f"l{k}" for k in range(depth - 1)) or "1"
        join = f"CROSS JOIN b{depth - 1}" if depth == 1 else f"JOIN b{depth - 1} USING ({', '.join(f'l{k}' for k in range(depth - 1))})"
        parts += [
            f"n{depth} AS (SELECT {keys}, cap, {weight(depth)} AS w, budget FROM (SELECT {keys}, sum(size * {epochs}) AS cap FROM leaf GROUP BY {keys}) {join})",
            f"o{depth} AS (SELECT *, w > 0 AND (budget - coalesce(sum(cap) OVER r, 0)) * w >= cap * (sum(w) OVER g - coalesce(sum(w) OVER r, 0)) AS filled FROM n{depth} WINDOW g AS (PARTITION BY {parent}), r AS (PARTITION BY {parent} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, l{depth - 1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"t{depth} AS (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER g AS taken, sum(w) OVER g - sum(CASE WHEN filled THEN w ELSE 0 END) OVER g AS rest FROM o{depth} WINDOW g AS (PARTITION BY {parent}))",
            f"b{depth} AS (SELECT {keys}, least(cap, CASE WHEN filled THEN cap WHEN rest > 0 THEN w * greatest(budget - taken, 0) / rest ELSE 0 END) AS budget FROM t{depth})",
        ]
    parts += [
        f"e AS (SELECT l0, l1, l2, CASE WHEN size > 0 THEN cast(least(floor((budget + 1e-6) / size), {epochs}) AS BIGINT) ELSE 0 END AS whole, size, budget FROM leaf JOIN b3 USING (l0, l1, l2))",
        f"h AS (SELECT s.doc_id, s.l0, s.l1, s.l2, n_tokens, whole, cast(floor(budget + 1e-6 - whole * size) AS BIGINT) AS rest, md5(concat_ws('|', '{seed}', whole::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))) AS h FROM s JOIN e USING (l0, l1, l2))",
        "c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY h) AS cum FROM h)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, n_tokens, cast(whole + CASE WHEN whole < {epochs} AND cum <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c"
