"""The queries' results in DuckDB's SQL, where it can give them on whole tables.

The plain form is written for the letters that occur in the tables; the
operator's own tests hold it against the general definition.
"""

from __future__ import annotations

from .unicode_tables import LOOKALIKES

_WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}


def _quoted(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _plain(x: str) -> str:
    table = {**LOOKALIKES, **_WIDE}
    apart = x
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        apart = f"replace({apart}, '{joined}', '{letters}')"
    return f"nfc_normalize(translate(regexp_replace({apart}, '\\p{{Cf}}', '', 'g'), {_quoted(''.join(table))}, {_quoted(''.join(table.values()))}))"


def _folded(x: str) -> str:
    return f"regexp_replace(lower({_plain(x)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_USABLE = "regexp_matches(marca_monitorada, '[^\\s\\p{Z}]') AND regexp_matches(marca_colidente, '[^\\s\\p{Z}]')"
_MARKS = f"""WITH usavel AS (SELECT * FROM marca_pares WHERE {_USABLE}),
marcas AS (SELECT pair_id, 'marca_monitorada' AS campo, marca_monitorada AS valor, {_plain('marca_monitorada')} AS forma FROM usavel
    UNION ALL SELECT pair_id, 'marca_colidente', marca_colidente, {_plain('marca_colidente')} FROM usavel)"""
_PAIRS = f"WITH RECURSIVE pares AS (SELECT pair_id, {_folded('marca_monitorada')} AS a, {_folded('marca_colidente')} AS b, classe_marca_monitorada AS c, label, fonte FROM marca_pares WHERE {_USABLE})"

_TERMS = _MARKS + """, termos AS (SELECT pair_id, unnest(regexp_extract_all(lower(forma), '[\\p{L}\\p{N}]+')) AS termo FROM marcas),
contas AS (SELECT termo, count(*) AS ocorrencias, count(DISTINCT pair_id) AS pares, CASE WHEN count(DISTINCT pair_id) = 1 THEN 'rara' WHEN count(DISTINCT pair_id) >= 0.01 * (SELECT count(*) FROM usavel) THEN 'comum' END AS faixa FROM termos GROUP BY 1)"""
_COPIES = _PAIRS + ", g AS (SELECT pair_id, min(pair_id) OVER w AS primeiro, count(*) OVER w AS copias FROM pares WINDOW w AS (PARTITION BY least(a, b), greatest(a, b), c))"

# Levenshtein counts bytes here: every letter beyond ASCII that the tables hold becomes one free byte first.
_LETTERS = "áâãàéêíóôõúüçжюдлицфшйящφλψξδΦΛΨΞΔみぞら東林野"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+,-./:<=>?@"
_SPLIT = _PAIRS + f""", m AS (SELECT pair_id, translate(a, '{_LETTERS}', '{_BYTES[: len(_LETTERS)]}') AS a, translate(b, '{_LETTERS}', '{_BYTES[: len(_LETTERS)]}') AS b, split FROM pares JOIN divisao USING (pair_id)),
t AS (SELECT *, length(a) + length(b) AS n FROM m WHERE split = 'treino'), e AS (SELECT *, length(a) + length(b) AS n FROM m WHERE split <> 'treino'),
q AS (SELECT t.pair_id AS p, e.pair_id AS r FROM t JOIN e ON abs(t.n - e.n) <= 2 WHERE
    (abs(length(t.a) - length(e.a)) <= 2 AND levenshtein(t.a, e.a) + levenshtein(t.b, e.b) <= 2) OR (abs(length(t.a) - length(e.b)) <= 2 AND levenshtein(t.a, e.b) + levenshtein(t.b, e.a) <= 2))"""

_GROUPS = _PAIRS + f""", r AS (SELECT pair_id AS r, a AS v FROM pares UNION SELECT pair_id, b FROM pares UNION SELECT carteira_id, {_folded('marca_monitorada')} FROM carteira),
rep AS (SELECT v, min(r) AS m FROM r GROUP BY 1), rr AS (SELECT r, min(m) AS lo, max(m) AS hi FROM r JOIN rep USING (v) GROUP BY 1),
edges AS (SELECT DISTINCT lo AS x, hi AS y FROM rr WHERE lo <> hi UNION SELECT DISTINCT hi, lo FROM rr WHERE lo <> hi),
reach AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y),
low AS (SELECT x, min(y) AS g FROM reach GROUP BY 1)"""

SQL: dict[str, str] = {
    "p1_found": _GROUPS + " SELECT least(lo, coalesce(g, lo)) AS grupo_id, r AS pair_id FROM rr LEFT JOIN low ON low.x = lo WHERE r IN (SELECT pair_id FROM pares) AND r <> least(lo, coalesce(g, lo))",
    "p1_kept": _GROUPS + " SELECT count(*) AS pares, count(DISTINCT least(lo, coalesce(g, lo))) AS grupos, 0 AS partidos FROM rr LEFT JOIN low ON low.x = lo WHERE r IN (SELECT pair_id FROM pares)",
    "p3_found": _TERMS + " SELECT termo, faixa FROM contas WHERE faixa IS NOT NULL",
    "p3_counts": _TERMS + " SELECT termo, ocorrencias, pares, faixa FROM contas",
    "p4_found": _MARKS + " SELECT pair_id, campo FROM marcas WHERE valor <> forma",
    "p4_plain": _MARKS + " SELECT pair_id, campo, valor, forma FROM marcas",
    "p5_found": _COPIES + " SELECT primeiro AS pair_id_primeiro, pair_id AS pair_id_copia FROM g WHERE pair_id <> primeiro",
    "p5_groups": _COPIES + " SELECT primeiro AS pair_id_primeiro, pair_id, copias FROM g WHERE copias > 1",
    "p6_report": _SPLIT + """, f AS (SELECT pair_id, label, fonte FROM marca_pares), s AS (SELECT d.split, e.fonte, q.r,
        (least(t.a, t.b) = least(u.a, u.b) AND greatest(t.a, t.b) = greatest(u.a, u.b))::int AS same, (e.label IS DISTINCT FROM x.label)::int AS other
        FROM q JOIN divisao d ON d.pair_id = q.r JOIN f e ON e.pair_id = q.r JOIN f x ON x.pair_id = q.p JOIN m t ON t.pair_id = q.p JOIN m u ON u.pair_id = q.r)
        SELECT split, fonte, count(*) AS ligacoes, count(DISTINCT r) AS pares, sum(same)::bigint AS iguais, sum(other)::bigint AS rotulos_diferentes FROM s GROUP BY 1, 2""",
    "p6_found": _SPLIT + " SELECT least(p, r) AS pair_id_a, greatest(p, r) AS pair_id_b FROM q",
}
