"""The found cases in SQL for DuckDB, by comparing everything with everything: for tables of the size of sf0.01."""

from __future__ import annotations

from cardmill.llm.ledger import LABEL
from cardmill.llm.lookalike import printed_form

_WORDS = "'  ' || regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\p{{Cf}}+', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '  ', 'g') || '  '"
_GRAMS = "list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)))"


def _side(x: str) -> str:
    marked = f"regexp_replace({x}, ' ({LABEL}) ', chr(1) || '\\1 ', 'g')"
    return f"CASE WHEN regexp_matches({marked}, '^ *' || chr(1) || '[^' || chr(1) || ']*' || chr(1)) THEN array_to_string(list_sort(string_split(replace({marked}, ' ', ''), chr(1))), chr(2)) ELSE replace({x}, ' ', '') END"


_KEYED = (
    "c AS (SELECT id, min(created_at) AS made, any_value(front_original) AS fo, any_value(back_original) AS bo FROM processed_cards WHERE id IS NOT NULL GROUP BY id), "
    f"w AS (SELECT id, made, {_WORDS.format(x='fo')} AS f, {_WORDS.format(x='bo')} AS b FROM c), "
    f"k AS (SELECT id, made, list_sort([{_side('f')}, {_side('b')}]) AS key FROM w), "
    "g AS (SELECT key, min(id) AS keep_id, arg_min(id, (made, id)) AS first_id, count(*) AS copies FROM k GROUP BY key)"
)
# pairs of texts (``id``, list ``g``) by the number of substrings they share
_SHARED = (
    "gr AS (SELECT id, len(g) AS n, unnest(g) AS w FROM {t}), "
    "sh AS (SELECT x.id AS a, y.id AS b, any_value(x.n + y.n) AS n, count(*) AS i FROM gr x JOIN gr y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2), "
    "nr AS (SELECT a, b FROM sh WHERE i * 5 >= 4 * (n - i))"
)
_NOTES = (
    "r AS (SELECT note_id, max((coalesce(indexed_at, ''), front_normalized || ' ' || back_normalized)) AS m FROM indexed_notes WHERE note_id IS NOT NULL AND front_normalized <> '' AND back_normalized <> '' GROUP BY note_id), "
    f"n AS (SELECT note_id AS id, m[2] AS t, {_GRAMS.format(x='m[2]')} AS g FROM r), " + _SHARED.format(t="n")
)
_REACH = "tw AS (SELECT a AS x, b AS y FROM nr UNION SELECT b, a FROM nr), rh AS (SELECT x AS id, x AS o FROM tw UNION SELECT rh.id, tw.y FROM rh JOIN tw ON tw.x = rh.o), rt AS (SELECT id, min(o) AS root FROM rh GROUP BY id)"
_BATCHED = (
    "c AS (SELECT DISTINCT id, ingest_batch AS batch, status IN ('aprobada', 'subida') AS ok, fingerprint, front_normalized AS t FROM processed_cards WHERE id IS NOT NULL AND ingest_batch IS NOT NULL), "
    f"u AS (SELECT t AS id, {_GRAMS.format(x='t')} AS g, min(batch) FILTER (ok) AS first FROM c WHERE length(t) >= 3 GROUP BY t), "
    + _SHARED.format(t="u")
    + ", v AS (SELECT a, b FROM nr UNION ALL SELECT b, a FROM nr UNION ALL SELECT id, id FROM u), l AS (SELECT v.a AS t, min(u.first) AS first FROM v JOIN u ON u.id = v.b GROUP BY v.a), "
    "p AS (SELECT fingerprint, min(batch) FILTER (ok) AS first FROM c WHERE fingerprint IS NOT NULL GROUP BY fingerprint)"
)
# by text, as column statistics without NaN can make DuckDB drop a test for it
_LINKS = (
    "e AS (SELECT regexp_replace(lower(left_id), '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(lower(right_id), '^\\s+|\\s+$', '', 'g') AS b FROM duplicate_edges WHERE score >= 0.90::DOUBLE AND score::VARCHAR <> 'nan'), "
    "d AS (SELECT a, b FROM e WHERE a <> b AND a <> '' AND b <> ''), s AS (SELECT a, b FROM d UNION SELECT b, a FROM d), "
    "o AS (SELECT a AS id, a AS x FROM s UNION SELECT o.id, s.b FROM o JOIN s ON s.a = o.x)"
)
_UNITS = (
    "n AS (SELECT note_id, arg_max(fingerprint, coalesce(indexed_at, '')) AS fp, TRY_CAST(arg_max(coalesce(embedding_vector, ''), coalesce(indexed_at, '')) AS DOUBLE[]) AS v FROM indexed_notes WHERE note_id IS NOT NULL GROUP BY note_id), "
    "h AS (SELECT fingerprint AS fp, arg_max(vector, created_at) AS c FROM embedding_cache WHERE model = 'tilo-embed:64' AND len(vector) = 64 GROUP BY 1), "
    "v AS (SELECT note_id AS id, CASE WHEN len(v) = 64 AND len(list_filter(v, lambda x: NOT coalesce(isfinite(x), false))) = 0 THEN v ELSE c END AS v FROM n LEFT JOIN h USING (fp)), "
    "z AS (SELECT id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0), "
    "q AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM z x JOIN z y ON x.id <> y.id), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS rk FROM q)"
)


def _printed() -> str:
    """Relations up to ``pc`` (id, plain sides, printed sides): each character by its printed form, then composed."""
    forms = ((chr(c), printed_form("x" + chr(c) + "x")[1:-1]) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    changed = ", ".join("(chr(" + str(ord(c)) + "), '" + f.replace("'", "''") + "')" for c, f in forms if f != c)
    plain = "trim(regexp_replace(coalesce({x}, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
    return (
        f"fm(ch, form) AS (VALUES {changed}), c AS (SELECT id, {plain.format(x='any_value(front_original)')} AS f, {plain.format(x='any_value(back_original)')} AS b FROM processed_cards WHERE id IS NOT NULL GROUP BY id), "
        "sd AS (SELECT DISTINCT unnest([f, b]) AS x FROM c), ch AS (SELECT x, unnest(regexp_extract_all(x, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(x, '(?s).'), 1) AS i FROM sd), "
        "pr AS (SELECT x, trim(regexp_replace(nfc_normalize(string_agg(coalesce(form, ch.ch), '' ORDER BY i)), '[\\s\\x0b\\x1c-\\x1f\\x{85}]+', ' ', 'g'), ' ') AS p FROM ch LEFT JOIN fm ON fm.ch = ch.ch GROUP BY x), "
        "pc AS (SELECT id, f, b, coalesce(x.p, '') AS pf, coalesce(y.p, '') AS pb FROM c LEFT JOIN pr x ON x.x = f LEFT JOIN pr y ON y.x = b)"
    )


def oracle_sql() -> dict[str, str]:
    printed = _printed()
    return {
        "p3_found": f"WITH {printed} SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM pc x JOIN pc y ON x.pf = y.pf AND x.pb = y.pb AND x.id < y.id AND (x.f <> y.f OR x.b <> y.b)",
        "p3_canonical": f"WITH {printed}, va AS (SELECT md5(f || chr(1) || b) AS v, any_value(pf) AS pf, any_value(pb) AS pb, min(id) AS first FROM pc GROUP BY 1), cl AS (SELECT pf, pb, arg_min(first, v) AS canonical_id FROM va GROUP BY 1, 2) SELECT id, canonical_id FROM pc JOIN cl USING (pf, pb)",
        "p1_found": f"WITH {_KEYED} SELECT g.keep_id, k.id AS copy_id FROM k JOIN g USING (key) WHERE k.id <> g.keep_id",
        "p1_distinct": f"WITH {_KEYED} SELECT keep_id, first_id, copies FROM g",
        "p4_found": f"WITH {_NOTES} SELECT a AS note_id_a, b AS note_id_b FROM nr UNION SELECT x.id, y.id FROM n x JOIN n y ON x.t = y.t AND x.id < y.id",
        "p4_groups": f"WITH RECURSIVE {_NOTES.partition(', gr AS')[0]}, tx AS (SELECT min(id) AS id, t, any_value(g) AS g FROM n GROUP BY t), {_SHARED.format(t='tx')}, {_REACH}, dg AS (SELECT x AS id, count(*) AS links FROM tw GROUP BY x) SELECT n.id AS note_id, coalesce(root, tx.id) AS group_id, coalesce(links, 0) AS n_links FROM n JOIN tx USING (t) LEFT JOIN rt ON rt.id = tx.id LEFT JOIN dg ON dg.id = tx.id",
        "p5_clusters": f"WITH RECURSIVE {_BATCHED.partition(', v AS')[0]}, {_REACH}, ct AS (SELECT t, count(*) AS n FROM c GROUP BY t) SELECT u.id AS front, coalesce(root, u.id) AS cluster_front, ct.n AS n_cards FROM u JOIN ct ON ct.t = u.id LEFT JOIN rt ON rt.id = u.id",
        "p5_found": f"WITH {_BATCHED} SELECT DISTINCT c.id FROM c LEFT JOIN l ON l.t = c.t LEFT JOIN p ON p.fingerprint = c.fingerprint WHERE l.first < c.batch OR p.first < c.batch",
        "p6_found": f"WITH RECURSIVE {_LINKS} SELECT id AS record_id, min(x) AS group_id FROM o GROUP BY id",
        "p7_found": f"WITH {_UNITS} SELECT DISTINCT least(a, b) AS note_id_a, greatest(a, b) AS note_id_b FROM t WHERE rk <= 5 AND c >= 0.90::DOUBLE",
    }
