"""The Merkle manifest of ``documents`` in DuckDB's SQL, level by level, as the twin of the registered query."""

from __future__ import annotations

FAN_OUT = 16
SOURCE_LEVELS, ROOT_LEVELS = 7, 4  # 16^7 rows of a source, 16^4 sources

#: CRC-32 of an ASCII text, bit by bit over the reflected polynomial.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
        lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END))"""


def field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"COALESCE(strlen({text}) || ':' || {text}, '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def levels(name: str, tree: str, count: int) -> str:
    """CTEs ``name``1 to ``name``count over ``name``0 (tree, i, h), and the siblings of each node in its run."""
    out = []
    for k in range(count):
        out.append(f"""{name}{k + 1} AS (
    SELECT {tree}, i // {FAN_OUT} AS i,
        CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
    FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}{k}) GROUP BY {tree}, i // {FAN_OUT})""")
        out.append(f"""{name}_side{k} AS (
    SELECT a.{tree}, a.i,
        COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
        COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r,
        count(*) FILTER (b.n > 1) > 0 AS hashed
    FROM {name}{k} a JOIN (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}{k}) b
        ON a.{tree} IS NOT DISTINCT FROM b.{tree} AND a.i // {FAN_OUT} = b.i // {FAN_OUT}
    GROUP BY a.{tree}, a.i)""")
    return ",\n".join(out)


def oracle() -> str:
    plain = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, previous = [], "start"
    for name, tree, at, count in (("s", "source", "i", SOURCE_LEVELS), ("t", "tree", "j", ROOT_LEVELS)):
        for k in range(count):
            here = f"{name}_walk{k}"
            steps.append(f"""{here} AS (
    SELECT w.* REPLACE (
        w.siblings || CASE WHEN x.hashed THEN x.l || x.r ELSE '' END AS siblings,
        CASE WHEN x.hashed THEN sha256(x.l || w.folded || x.r) ELSE w.folded END AS folded)
    FROM {previous} w JOIN {name}_side{k} x
        ON w.{tree} IS NOT DISTINCT FROM x.{tree} AND w.{at} // {FAN_OUT ** k} = x.i)""")
            previous = here
    return f"""
WITH leaves AS (
    SELECT doc_id, source, {leaf("text")} AS leaf,
        CASE WHEN {CRC32.format(text="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(plain)} END AS altered
    FROM documents),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
s0 AS (SELECT source, i, leaf AS h FROM ranked),
{levels("s", "source", SOURCE_LEVELS)},
t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, source FROM s{SOURCE_LEVELS}),
{levels("t", "tree", ROOT_LEVELS)},
start AS (
    SELECT d.doc_id, d.source, d.leaf, d.i, t.i AS j, 0 AS tree, t.h AS subroot, '' AS siblings,
        COALESCE(d.altered, d.leaf) AS folded
    FROM ranked d JOIN t0 t ON d.source IS NOT DISTINCT FROM t.source),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM {previous}, t{ROOT_LEVELS} r"""
