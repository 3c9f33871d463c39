"""SQL twins of the problems' queries, for DuckDB."""

from __future__ import annotations

_REPORT = """
WITH have AS (SELECT lang, threat, identity_hate, count(*) AS n FROM split WHERE split = 'train' GROUP BY ALL)
SELECT t.plan_id, t.lang, t.threat, t.identity_hate, coalesce(h.n, 0)::BIGINT AS available,
       greatest(t.min_rows, round(t.share * t.sample_rows)::BIGINT) AS needed,
       least(greatest(t.min_rows, round(t.share * t.sample_rows)::BIGINT), coalesce(h.n, 0))::BIGINT AS sampled,
       greatest(0, greatest(t.min_rows, round(t.share * t.sample_rows)::BIGINT) - coalesce(h.n, 0))::BIGINT AS deficit
FROM target_mix t LEFT JOIN have h ON t.lang = h.lang AND t.threat = h.threat AND t.identity_hate = h.identity_hate
"""

# Fixed values, written apart from the operator's own table: letters of the shape of the Latin ones, plain and with marks.
_SAME_SHAPE = [
    ("АВСЕНІӀЈКМОРЅТХҮԚԜѴ", "ABCEHIIJKMOPSTXYQWV"),
    ("асеһіјорѕхуԁԛԝӏүѵ", "acehijopsxydqwlyv"),
    ("ΑΒΕΗΙΚΜΝΟΡΤΧΥΖϹ", "ABEHIKMNOPTXYZC"),
    ("ονακιρυχγϲ", "ovakipuxyc"),
    ("ЀЁЇӐӒӖӦ", "ÈËÏĂÄĔÖ"),
    ("ѐёїӑӓӗӧӯӱ", "èëïăäĕöȳÿ"),
    ("ΆΈΊΌΎΪΫ", "ÁÉÍÓÝÏŸ"),
    ("άίόύϊϋ", "áíóúïü"),
]
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: soft hyphen, joiners, zero-width, direction and byte-order marks, variation selectors
_NOTHING = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)))
_FROM = "".join(a for a, _ in _SAME_SHAPE) + _WIDE[0] + _BLANKS
_TO = ("".join(b for _, b in _SAME_SHAPE) + _WIDE[1] + " " * len(_BLANKS)).replace("'", "''")
_LOOK = f"nfc_normalize(translate(nfc_normalize(translate(comment_text, '{_NOTHING}', '')), '{_FROM}', '{_TO}'))"

SQL: dict[str, str] = {
    "p3_report": _REPORT,
    "p3_found": f"SELECT plan_id, lang, threat, identity_hate FROM ({_REPORT}) WHERE deficit > 0",
    "p4_normalised": f"SELECT row_id, {_LOOK} AS look FROM split",
    "p4_found": f"""
WITH looks AS (SELECT row_id, comment_text, {_LOOK} AS look FROM split WHERE regexp_matches(comment_text, '[\\p{{L}}\\p{{N}}]'))
SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM looks a JOIN looks b
ON a.look = b.look AND a.comment_text <> b.comment_text AND a.row_id < b.row_id
""",
    "p4_classes": f"""
WITH looks AS (SELECT row_id, comment_text, CASE WHEN regexp_matches(comment_text, '[\\p{{L}}\\p{{N}}]') THEN {_LOOK} END AS look FROM split),
per AS (SELECT look, min(row_id) AS class_id, count(*) AS members, count(DISTINCT comment_text) AS forms FROM looks WHERE look IS NOT NULL GROUP BY look)
SELECT l.row_id, coalesce(p.class_id, l.row_id) AS class_id, coalesce(p.members, 1) AS members, coalesce(p.forms, 1) AS forms FROM looks l LEFT JOIN per p USING (look)
""",
}
