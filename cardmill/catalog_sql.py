"""The same queries in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

import html.entities
import unicodedata

from cardmill.functions import quality, scores, text
from cardmill.operators.classify import python_fold, python_path
from cardmill.settings import Profile

_SP = text.SPACE


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _words(x: str) -> str:
    return _collapse(f"regexp_replace(strip_accents({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def _stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= {n} THEN substr({t}, 1, length({t}) - {len(s)}) || '{p}'" for s, n, p in text.SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def _stems(words: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter(string_split({words}, ' '), lambda t: t <> ''), lambda t: {_stem('t')})))"


def _content(stems: str) -> str:
    return f"list_filter({stems}, lambda t: length(t) > 1 AND NOT list_contains({_list((*text.STOPWORDS, *text.BOILERPLATE))}, t))"


def _trigrams(x: str) -> str:
    p = f"('  ' || {x} || '  ')"
    return f"CASE WHEN length(trim({x})) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_filter(list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)), lambda w: trim(w) <> ''))) END"


def _subject(x: str) -> str:
    x = f"regexp_replace({_collapse(x)}, '\\s+mean$', '')"
    return _collapse(f"regexp_replace({x}, '^(?:{'|'.join(text.ARTICLES)})\\s+', '')")


def _question(x: str) -> tuple[str, str]:
    kinds, keys = "", ""
    for kind, pattern in text.QUESTIONS:
        first = _subject(f"regexp_extract({x}, {_q(pattern)}, 1)")
        made = f"'{kind}::' || {first}"
        if kind == "comparison":
            second = _subject(f"regexp_extract({x}, {_q(pattern)}, 2)")
            made = f"'comparison::' || least({first}, {second}) || '::' || greatest({first}, {second})"
        hit = f"regexp_matches({x}, {_q(pattern)})"
        kinds += f" WHEN {hit} THEN '{kind}'"
        keys += f" WHEN {hit} THEN {made}"
    return f"CASE{kinds} ELSE 'unknown' END", f"CASE{keys} END"


CARDS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM processed_cards WHERE id IS NOT NULL) WHERE rn = 1)"
NOTES = "n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM indexed_notes WHERE note_id IS NOT NULL) WHERE rn = 1)"
NORM = CARDS + ", k AS (SELECT id, coalesce(front_normalized, '') AS f, coalesce(back_normalized, '') AS b, back_original, tags_resolved, target_deck, created_at FROM c)"


def _records(source: str = "", base: str = "") -> str:
    """The relations r and rc: records with features, by default of the notes."""
    intent, key = _question("q")
    source = source or NOTES
    base = base or "SELECT note_id AS id, coalesce(front_normalized, '') AS f, coalesce(back_normalized, '') AS b, deck_name, note_type, scope_json FROM n"
    return (
        source
        + f", r0 AS ({base})"
        + f", r1 AS (SELECT *, {_words('f')} AS fs, {_words('b')} AS bs, {_words(chr(39).join(['regexp_replace(strip_accents(f), ', chr(92) + '([^)]*' + chr(92) + ')|' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']', ', ', ' ', ', ', 'g', ')']))} AS q FROM r0)"
        + f", r AS (SELECT *, sha256(f || '||' || b) AS fp, {intent} AS intent, {key} AS skey, {_stems('fs')} AS stems, {_stems('bs')} AS backs, {_trigrams('f')} AS tri FROM r1)"
        + f", rc AS (SELECT *, {_content('stems')} AS content FROM r)"
    )


def _jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


def _calibrated(c: str) -> str:
    steps = " ".join(f"WHEN {c} < {x1} THEN {y0} + ({c} - {x0}) / ({x1} - {x0})::DOUBLE * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(scores.CALIBRATION, scores.CALIBRATION[1:], strict=False))
    return f"CASE WHEN {c} <= {scores.CALIBRATION[0][0]} THEN 0.0::DOUBLE {steps} ELSE 1.0::DOUBLE END"


def _score(a: str, b: str, cosine: str = "") -> tuple[str, str, str]:
    """(columns of the measures, score, reasons) of joined records; ``cosine``: an expression of the pair, null or '' for none."""
    measures = f"{_jaccard(a + '.content', b + '.content')} AS j, {_jaccard(a + '.tri', b + '.tri')} AS t, {_jaccard(a + '.backs', b + '.backs')} AS k, {a}.fp = {b}.fp AS sp, {a}.f = {b}.f AND {a}.f <> '' AS sf, coalesce({a}.skey = {b}.skey, false) AS sk"
    w = scores.WEIGHTS
    score = f"CASE WHEN sp THEN 1.0::DOUBLE WHEN sf THEN 0.98::DOUBLE WHEN sk THEN 0.95::DOUBLE WHEN j >= 0.70 THEN 0.90::DOUBLE WHEN j >= 0.50 AND t >= 0.40 THEN 0.80::DOUBLE ELSE {w[0]}::DOUBLE * j + {w[1]}::DOUBLE * t + {w[2]}::DOUBLE * k END"
    near = ""
    if cosine:
        measures += f", coalesce({cosine}, 0.0) AS c"
        trusted = f"(sp OR sf OR sk OR j >= {scores.TOKENS_WEAK} OR c >= {scores.VECTOR_ALONE}::DOUBLE)"
        score = f"least(1.0, greatest({score}, CASE WHEN {trusted} THEN {_calibrated('c')} ELSE 0.0 END))"
        near = f"CASE WHEN {trusted} AND c >= {scores.MATCH_REASON}::DOUBLE THEN 'embedding_match' END, "
    reasons = f"list_filter([{near}CASE WHEN sp THEN 'exact_fingerprint' END, CASE WHEN sf THEN 'exact_front' END, CASE WHEN sk THEN 'semantic_key_match' END, CASE WHEN j >= 0.5 THEN 'token_overlap' END, CASE WHEN t >= 0.4 THEN 'trigram_overlap' END], lambda x: x IS NOT NULL)"
    return measures, score, f"CASE WHEN len({reasons}) = 0 THEN 'low_similarity' ELSE array_to_string(list_sort({reasons}), ',') END"


#: The vector of every note: its own where that is a list of 64 finite numbers, else the cached one of its fingerprint.
_VECTORS = (
    "hv AS (SELECT fingerprint, arg_max(vector, (created_at, vector)) AS held FROM embedding_cache WHERE model = 'tilo-embed:64' AND len(vector) > 0 GROUP BY 1), "
    "ov AS (SELECT note_id AS id, fingerprint, TRY_CAST(embedding_vector AS DOUBLE[]) AS own FROM n), "
    "uv AS (SELECT id, CASE WHEN len(own) = 64 AND len(list_filter(own, lambda x: NOT coalesce(isfinite(x), false))) = 0 THEN own ELSE held END AS v FROM ov LEFT JOIN hv USING (fingerprint)), "
    "nv AS (SELECT id, v, list_sum(list_transform(v, lambda x: x * x)) > 0 AS some FROM uv)"
)


def _pair_cosine(a: str, b: str) -> str:
    return f"CASE WHEN {a}.some AND {b}.some AND len({a}.v) = len({b}.v) THEN list_cosine_similarity({a}.v, {b}.v) END"


def _blocks() -> str:
    deck = _words("deck_name")
    kind = _words("lower(coalesce(note_type, ''))")
    parts = "list_transform(list_sort(json_keys(scope_json)), lambda x: lower(x) || '=' || lower(regexp_replace(json_extract_string(scope_json, '$.\"' || x || '\"'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')))"
    scope = f"CASE WHEN scope_json IS NOT NULL AND len(json_keys(scope_json)) > 0 THEN 'scope:' || array_to_string({parts}, '|') || ':' || {kind} WHEN deck_name <> '' THEN 'deck:' || lower({deck}) || ':' || {kind} END"
    return (
        _records()
        + ", tok AS (SELECT DISTINCT id, unnest(stems) AS token FROM r), idf AS (SELECT token, count(*) AS df, (SELECT count(*) FROM r)::DOUBLE / count(*) AS idf FROM tok GROUP BY token)"
        + ", anc AS (SELECT id, list(token ORDER BY rk) AS anchors FROM (SELECT id, tok.token AS token, row_number() OVER (PARTITION BY id ORDER BY idf DESC, length(tok.token) DESC, tok.token) AS rk FROM tok JOIN idf USING (token)) WHERE rk <= 4 GROUP BY id)"
        + f", blk AS (SELECT rc.*, list_sort(list_distinct(list_filter(list_concat([{scope}, 'semantic:' || skey], list_transform(coalesce(anchors, []), lambda t: 'anchor:' || t), list_transform(tri[1:4], lambda t: 'tri:' || t)), lambda x: x IS NOT NULL))) AS keys FROM rc LEFT JOIN anc USING (id))"
    )


def _components(edges: str, out: str) -> str:
    """``out`` (id, root) of the relation ``edges`` (a, b)."""
    return f"both_ways AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}), reach AS (SELECT x AS id, x AS o FROM both_ways UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.o), {out} AS (SELECT id, min(o) AS root FROM reach GROUP BY id)"


def _formatted(column: str, rows: str) -> str:
    """Relations up to ``nf`` (x, form) for the distinct values of a column: entities decoded, compatibility forms composed, without tags, white space collapsed."""
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000}
    forms = {c: f for c, f in plain.items() if f != c} | {f"&{n}": unicodedata.normalize("NFKC", v) for n, v in html.entities.html5.items() if n.endswith(";")}
    made = ", ".join(f"({_q(t) if t.isascii() else f'chr({ord(t)})'}, {_q(f)})" for t, f in forms.items())
    number = "CASE WHEN regexp_matches(tk.tk, '^&#[0-9]+;$') THEN chr(regexp_extract(tk.tk, '[0-9]+')::INT) WHEN regexp_matches(tk.tk, '^&#[xX][0-9a-fA-F]+;$') THEN chr(('0x' || regexp_extract(tk.tk, '[xX]([0-9a-fA-F]+)', 1))::INT) ELSE tk.tk END"
    cut = "regexp_extract_all(x, '(?s)&(?:[a-zA-Z0-9]+|#[0-9]+|#[xX][0-9a-fA-F]+);|.')"
    return (
        f"fm(tk, form) AS (VALUES {made}), sv AS (SELECT DISTINCT {column} AS x FROM {rows} WHERE {column} IS NOT NULL), "
        f"tk AS (SELECT x, unnest({cut}) AS tk, generate_subscripts({cut}, 1) AS i FROM sv), "
        f"nf AS (SELECT sv.x, coalesce({_collapse('regexp_replace(nfc_normalize(t.s), ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '') AS form "
        f"FROM sv LEFT JOIN (SELECT x, string_agg(coalesce(form, {number}), '' ORDER BY i) AS s FROM tk LEFT JOIN fm ON fm.tk = tk.tk GROUP BY x) t ON t.x = sv.x)"
    )


def _first_rule(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {h} THEN {_q(v)}" for h, v in rules) + " END" if rules else "NULL"


def _contains(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


def _flags(front_words: str, back_words: str) -> str:
    marks = f"len(regexp_extract_all(coalesce(back_original, ''), {_q(quality.LIST_MARK)}))"
    segments = "len(list_filter(regexp_split_to_array(b, '[.;\\n]+'), lambda s: trim(s) <> ''))"
    shared = f"len(list_filter(list_intersect({front_words}, {back_words}), lambda w: length(w) >= {quality.LEAK_LENGTH})) > 0" if front_words else "false"
    found = f"[CASE WHEN length(b) > {quality.LONG_ANSWER} THEN 'respuesta_larga' END, CASE WHEN {marks} >= 2 OR {segments} >= {quality.SEGMENTS} THEN 'no_atomica' END, CASE WHEN regexp_matches(b, {_q(quality.YES_NO)}) AND length(b) <= 12 THEN 'reconocimiento' END, CASE WHEN {shared} THEN 'pista_filtrada' END]"
    return f"CASE WHEN trim(b) = '' THEN ['back_vacio'] ELSE list_filter({found}, lambda x: x IS NOT NULL) END"


#: The front without what stands in brackets.
BARE = r"regexp_replace(strip_accents(f), '\([^)]*\)|\[[^\]]*\]', ' ', 'g')"
BLOCKED = "ub AS (SELECT DISTINCT id, unnest(keys) AS block FROM blk), bp AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ub x JOIN ub y ON x.block = y.block AND x.id < y.id)"
_TAGS = "list_filter(string_split(coalesce(tags_resolved, ''), ' '), lambda t: t <> '')"
_VALID = "(SELECT list(category || '::' || value) FROM taxonomy)"
_PARTS = "CASE WHEN contains(t, '::') THEN trim(split_part(t, '::', 1)) || '::' || trim(substr(t, strpos(t, '::') + 2)) ELSE '' END"
# Order-preserving distinct of a list.
_ORDERED = "list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def build(profile: Profile) -> dict[str, str]:
    out: dict[str, str] = {}
    out["exact_duplicates"] = f"WITH {NORM} SELECT sha256(f || '||' || b) AS fingerprint, count(*) AS copies, min(id) AS representative FROM k GROUP BY 1 HAVING count(*) > 1"
    out["normalized_text"] = f"SELECT doc_id, lower({_collapse(chr(39).join(['regexp_replace(nfc_normalize(text), ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}) AS norm FROM documents"
    out["semantic_text"] = f"WITH {NOTES} SELECT note_id, {_words(chr(39).join(['coalesce(front_normalized, ', '', ')']))} AS words FROM n"
    rec, blk = _records(), _blocks()
    out["question_keys"] = f"WITH {rec} SELECT id AS note_id, intent, skey AS semantic_key FROM r"
    out["stemmed_tokens"] = f"WITH {rec} SELECT id AS note_id, array_to_string(stems, ' ') AS stems, array_to_string(content, ' ') AS content FROM rc"
    out["char_trigrams"] = f"WITH {rec} SELECT id AS note_id, array_to_string(tri, '|') AS trigrams FROM r"
    out["token_idf"] = f"WITH {blk} SELECT token, df, round(idf, 6) AS idf FROM idf"
    out["anchor_tokens"] = f"WITH {blk} SELECT id AS note_id, array_to_string(anchors, ' ') AS anchors FROM anc"
    out["block_keys"] = f"WITH {blk} SELECT id AS note_id, array_to_string(keys, '|') AS block_keys FROM blk"
    sizes = "sz AS (SELECT block, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM (SELECT DISTINCT id, unnest(keys) AS block FROM blk) GROUP BY block)"
    out["block_sizes"] = f"WITH {blk}, {sizes} SELECT block, n, pairs FROM sz"
    out["blocked_pairs"] = f"WITH {blk}, {BLOCKED} SELECT a, b FROM bp"
    star = "SELECT g.a, r.id AS b FROM r JOIN (SELECT {c}, min(id) AS a FROM r WHERE {c} <> '' GROUP BY {c}) g ON g.{c} = r.{c} WHERE g.a < r.id"
    out["exact_links"] = f"WITH {rec} {star.format(c='fp')} UNION {star.format(c='f')}"
    jac = "jp AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.content, y.content)) AS shared FROM rc x JOIN rc y ON x.id < y.id AND len(x.content) > 0 AND len(y.content) > 0 WHERE len(list_intersect(x.content, y.content)) >= 0.5 * (len(x.content) + len(y.content) - len(list_intersect(x.content, y.content))))"
    out["jaccard_pairs"] = f"WITH {rec}, {jac} SELECT a, b, shared FROM jp"
    measures, score, reasons = _score("x", "y")
    scored = f"m AS (SELECT x.id AS a, y.id AS b, {measures} FROM rc x JOIN rc y ON x.id < y.id), sc AS (SELECT a, b, {score} AS raw, {reasons} AS reasons FROM m)"
    out["scored_edges"] = f"WITH {rec}, {scored} SELECT a, b, round(raw, 4) AS score, reasons FROM sc WHERE raw >= 0.75"
    vmeasures, vscore, vreasons = _score("x", "y", _pair_cosine("vx", "vy"))
    vscored = f"{_VECTORS}, m AS (SELECT x.id AS a, y.id AS b, {vmeasures} FROM rc x JOIN rc y ON x.id < y.id LEFT JOIN nv vx ON vx.id = x.id LEFT JOIN nv vy ON vy.id = y.id), sc AS (SELECT a, b, {vscore} AS raw, {vreasons} AS reasons FROM m)"
    strong = "eq AS (SELECT a, b, round(raw, 4) AS score, reasons FROM sc WHERE raw >= 0.90)"
    clusters = "cl AS (SELECT root, count(*) AS size, substr(sha1(string_agg(id::VARCHAR, '||' ORDER BY id::VARCHAR)), 1, 12) AS cluster_id FROM roots GROUP BY root), fl AS (SELECT root, min(score) AS score_floor, array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ','))))), ',') AS reasons FROM eq JOIN roots ON roots.id = eq.a GROUP BY root)"
    roots, vroots = (f"RECURSIVE {rec}, {how}, {strong}, {_components('eq', 'roots')}, {clusters}" for how in (scored, vscored))
    report = "SELECT cluster_id, root AS representative, size, reasons, score_floor FROM cl JOIN fl USING (root)"
    out["duplicate_clusters"] = f"WITH {roots} {report}"
    out["cluster_report"] = f"WITH {vroots} {report}"
    out["cluster_members"] = f"WITH {roots} SELECT cluster_id, id AS note_id, size FROM roots JOIN cl USING (root)"
    out["largest_clusters"] = f"WITH {roots} {report} ORDER BY size DESC, cluster_id LIMIT 10"
    every = f"{_VECTORS}, near AS (SELECT vx.id AS a, vy.id AS b FROM nv vx JOIN nv vy ON vx.id < vy.id WHERE {_pair_cosine('vx', 'vy')} >= 0.40::DOUBLE), pr AS (SELECT a, b FROM bp UNION SELECT a, b FROM near UNION SELECT x.id, y.id FROM rc x JOIN rc y ON x.id < y.id AND (x.fp = y.fp OR (x.f = y.f AND x.f <> '')))"
    out["pair_metrics"] = f"WITH RECURSIVE {blk}, {sizes}, {BLOCKED}, {every}, {scored}, {strong}, {_components('eq', 'roots')}, one AS (SELECT (SELECT count(*) FROM r) AS cards, (SELECT sum(pairs)::BIGINT FROM sz) AS raw_candidates, (SELECT count(*) FROM pr) AS pairs, (SELECT count(DISTINCT root) FROM roots) AS clusters) SELECT *, round((1 - pairs / (cards * (cards - 1) / 2)) * 100, 2) AS reduction_pct FROM one"
    cos = "ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), cp AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM ev x JOIN ev y ON x.id < y.id)"
    out["cosine_pairs"] = f"WITH {cos} SELECT a, b, round(c, 4) AS cosine FROM cp WHERE c >= 0.40"
    out["calibrated_cosine"] = f"WITH {cos} SELECT a, b, round({_calibrated('c')}, 4) AS score FROM cp WHERE c >= 0.30"
    ranked = "w AS (SELECT a, b, round(raw, 4) AS score, reasons FROM s WHERE raw >= {least}), v AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM w) SELECT a AS q, b AS r, score, reasons, rank FROM v WHERE rank <= 20"
    out["similar_topk"] = f"WITH {rec}, m AS (SELECT x.id AS a, y.id AS b, {measures} FROM rc x JOIN rc y ON x.id <> y.id WHERE x.id % 100 = 0), s AS (SELECT a, b, {score} AS raw, {reasons} AS reasons FROM m), {ranked.format(least='0.60')}"
    out["similar_by_vectors"] = f"WITH {rec}, {_VECTORS}, m AS (SELECT x.id AS a, y.id AS b, {vmeasures} FROM rc x JOIN rc y ON x.id <> y.id LEFT JOIN nv vx ON vx.id = x.id LEFT JOIN nv vy ON vy.id = y.id WHERE x.id % 100 = 0), s AS (SELECT a, b, {vscore} AS raw, {vreasons} AS reasons FROM m), {ranked.format(least='0.75')}"
    knn = f"{cos}, kq AS (SELECT x.id AS q, y.id AS r, list_cosine_similarity(x.v, y.v) AS c FROM ev x JOIN ev y ON x.id <> y.id WHERE x.id % 100 = 0), kn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, r) AS rank FROM kq WHERE c >= 0)"
    out["knn_topk"] = f"WITH {knn} SELECT q, r, round(c, 4) AS cosine, rank FROM kn WHERE rank <= 20"
    votes = f"{knn}, vt AS (SELECT q, label::VARCHAR AS value, sum(0.5 + c) AS w, count(*) AS votes, min(rank) AS first FROM kn JOIN ev ON ev.id = kn.r WHERE rank <= 8 AND 0.5 + c >= 0.70 GROUP BY 1, 2), vb AS (SELECT *, sum(w) OVER (PARTITION BY q) AS every, row_number() OVER (PARTITION BY q ORDER BY w DESC, first) AS place FROM vt), vo AS (SELECT q, 'label' AS category, value, round(w / every, 3) AS confidence, votes FROM vb WHERE place = 1)"
    out["facet_vote"] = f"WITH {votes} SELECT * FROM vo"
    out["applied_votes"] = f"WITH {votes} SELECT ev.id AS q, coalesce('label::' || vo.value, '') AS applied FROM ev LEFT JOIN vo ON vo.q = ev.id AND confidence >= 0.70 AND votes >= 2 WHERE ev.id % 100 = 0"
    areas = ", ".join(f"{_first_rule([(_contains(chr(40) + 'f || ' + chr(39) + ' ' + chr(39) + ' || b' + chr(41), [w.lower() for w in words]), v) for v, words in values.items()])} AS {c}" for c, values in profile.keyword_rules.items())
    out["keyword_facets"] = f"WITH {NORM} SELECT id, {areas} FROM k"
    topics = _first_rule([(_contains("s", [python_fold(w) for w in words]), t) for t, words in profile.topic_keywords.items()])
    out["topic_facet"] = f"WITH {NORM}, z AS (SELECT id, {_words('f || chr(32) || b')} AS s FROM k) SELECT id, {topics} AS topic FROM z"
    kinds = [(f"(EXISTS (SELECT 1 FROM taxonomy WHERE category = 'type' AND value = '{t}') AND (" + " OR ".join(f"regexp_matches(fs, {_q(p)})" for p in ps) + "))", t) for t, ps in profile.type_patterns.items()]
    out["type_facet"] = f"WITH {rec} SELECT id AS note_id, coalesce({_first_rule(kinds)}, CASE WHEN EXISTS (SELECT 1 FROM taxonomy WHERE category = 'type' AND value = intent) THEN intent END) AS type FROM r"
    path = f"list_filter(list_transform(string_split(coalesce(target_deck, ''), '::'), lambda p: {_words('lower(p)')}), lambda p: p <> '')"
    decks = [(f"p[-{len(python_path(d))}:] = {_list(python_path(d))}", f) for d, f in profile.deck_tag_rules.items()]
    names = list(dict.fromkeys(c for _, f in decks for c in f))
    placed = "CASE " + " ".join(f"WHEN {h} THEN {i}" for i, (h, _) in enumerate(decks)) + " END"
    cols = ", ".join(f"CASE {' '.join(f'WHEN place = {i} THEN {_q(f[c])}' for i, (_, f) in enumerate(decks) if c in f)} END AS {c}" for c in names)
    out["deck_facets"] = f"WITH {NORM}, z AS (SELECT id, {path} AS p FROM k), y AS (SELECT id, {placed} AS place FROM z) SELECT id, {cols} FROM y"
    tagged = f"{CARDS}, t0 AS (SELECT id, {_TAGS} AS tags FROM c), t1 AS (SELECT id, tags, list_transform(tags, lambda t: {_PARTS}) AS parsed, {_VALID} AS valid FROM t0), t2 AS (SELECT id, tags, list_filter(parsed, lambda t: list_contains(valid, t)) AS good0, list_transform(list_filter(tags, lambda t: NOT list_contains(valid, {_PARTS})), lambda t: '_unresolved::' || t) AS bad FROM t1), t3 AS (SELECT id, tags, {_ORDERED.format(x='good0')} AS good, bad FROM t2)"
    out["resolved_tags"] = f"WITH {tagged} SELECT id, array_to_string(good, ' ') AS resolved, array_to_string(bad, ' ') AS unresolved FROM t3"
    has = lambda c: f"len(list_filter(good, lambda t: starts_with(t, '{c}::'))) > 0"
    sure = f"CASE WHEN {has('topic')} AND {has('type')} AND len(bad) = 0 THEN 'high' WHEN {has('topic')} OR {has('type')} OR (len(good) >= 1 AND len(bad) = 0) THEN 'medium' ELSE 'low' END"
    out["confidence"] = f"WITH {tagged} SELECT id, {sure} AS confidence FROM t3"
    out["auto_classify_summary"] = f"WITH {tagged} SELECT {sure} AS confidence, count(*) AS n FROM t3 GROUP BY 1"
    out["missing_categories"] = f"WITH {tagged} SELECT id, array_to_string(list_filter(['topic', 'type', 'cert'], lambda c: len(list_filter(tags, lambda t: starts_with(t, c || '::'))) = 0), ' ') AS missing FROM t3"
    out["quality_flags"] = f"WITH {NORM}, z AS (SELECT *, string_split({_words('f')}, ' ') AS fw, string_split({_words('b')}, ' ') AS bw FROM k) SELECT id, array_to_string({_flags('fw', 'bw')}, ' ') AS flags FROM z"
    suits = f"trim(b) <> '' AND len(string_split(trim(b), ' ')) <= {quality.CLOZE_WORDS} AND NOT regexp_matches(trim(b), {_q(quality.YES_NO)}) AND NOT regexp_matches(trim(b), '[.;:]')"
    out["cloze"] = f"WITH {NORM} SELECT id, {suits} AS cloze FROM k"
    fuller = f"len(y.fl) = len(x.fl) AND length(trim(x.back_original)) > 0 AND length(trim(y.back_original)) > length(trim(x.back_original)) * {quality.LONGER} AND NOT list_contains(y.fl, 'respuesta_larga')"
    out["better_version"] = f"WITH {NORM}, y AS (SELECT *, string_split({_words('f')}, ' ') AS fw, string_split({_words('b')}, ' ') AS bw FROM k WHERE f <> ''), z AS (SELECT *, {_flags('fw', 'bw')} AS fl FROM y), g AS (SELECT f, min(id) AS a FROM z GROUP BY f) SELECT y.id AS new_id, x.id AS old_id, CASE WHEN len(y.fl) < len(x.fl) OR ({fuller}) THEN 'replace_old_with_new' ELSE 'keep_existing' END AS suggestion FROM g JOIN z x ON x.id = g.a JOIN z y ON y.f = g.f AND y.id > g.a"
    newest = "(SELECT max(ingest_batch) FROM c)"
    # classification: every layer of rules, then the first that names the category, tags before all
    layers = f"k2 AS (SELECT k.id, t3.tags, t3.good, t3.bad, f, b, {_words('f || chr(32) || b')} AS s, {_words('f')} AS fs, {path} AS p, {_words(BARE)} AS q FROM k JOIN t3 USING (id)), k3 AS (SELECT *, f || ' ' || b AS both_sides, {placed} AS place, {_question('q')[0]} AS intent FROM k2)"
    by_deck = {c: f"CASE {' '.join(f'WHEN place = {i} THEN {_q(f[c])}' for i, (_, f) in enumerate(decks) if c in f)} END" for c in names}
    by_word = {c: _first_rule([(_contains("both_sides", [w.lower() for w in words]), v) for v, words in values.items()]) for c, values in profile.keyword_rules.items()}
    by_type = f"coalesce({_first_rule(kinds)}, CASE WHEN EXISTS (SELECT 1 FROM taxonomy WHERE category = 'type' AND value = intent) THEN intent END)"
    categories = list(dict.fromkeys([*by_deck, *by_word, "topic", "type"]))
    first_tag = lambda c: f"substr(list_filter(good, lambda t: starts_with(t, '{c}::'))[1], {len(c) + 3})"
    scope = ", ".join(f"coalesce({', '.join([first_tag(c), *([by_deck[c]] if c in by_deck else []), *([by_word[c]] if c in by_word else []), *([topics] if c == 'topic' else []), *([by_type] if c == 'type' else [])])}) AS {c}" for c in categories)
    derived = "list_filter([" + ", ".join(f"'{c}::' || {c}" for c in sorted(categories)) + "], lambda t: list_contains(valid, t))"
    classified = f"{NORM}, {tagged.removeprefix(CARDS + ', ')}, {layers}, k4 AS (SELECT id, good, bad, tags, {scope}, {_VALID} AS valid FROM k3), k5 AS (SELECT *, list_concat(good, list_filter({derived}, lambda t: NOT list_contains(good, t))) AS every FROM k4)"
    out["classified"] = f"WITH {classified} SELECT id AS record_id, {', '.join(categories)}, array_to_string(every, ' ') AS tags, CASE WHEN topic IS NOT NULL AND type IS NOT NULL AND len(bad) = 0 THEN 'high' WHEN topic IS NOT NULL OR type IS NOT NULL OR (len(every) >= 1 AND len(bad) = 0) THEN 'medium' ELSE 'low' END AS confidence FROM k5"
    deck_path = f"list_filter(list_transform(string_split(deck_name, '::'), lambda p: {_words('lower(p)')}), lambda p: p <> '')"
    out["deck_route"] = f"WITH {CARDS}, v AS (SELECT id, {_words('lower(json_extract_string(scope_json, ' + chr(39) + '$.topic' + chr(39) + '))')} AS value FROM c), i AS (SELECT DISTINCT deck_name, {deck_path} AS parts, {_words('lower(deck_name)')} AS whole FROM indexed_decks WHERE deck_name = 'Aula Abierta' OR starts_with(deck_name, 'Aula Abierta::')), h AS (SELECT value, arg_min(deck_name, (CASE WHEN list_contains(parts[2:], value) THEN 0 ELSE 1 END, deck_name)) AS deck FROM (SELECT DISTINCT value FROM v WHERE value <> '') JOIN i ON list_contains(parts[2:], value) OR contains(whole, value) GROUP BY value) SELECT c.id AS record_id, coalesce(h.deck, 'Aula Abierta') AS deck FROM c LEFT JOIN v USING (id) LEFT JOIN h USING (value)"
    out["tsv_export"] = f"WITH {CARDS} SELECT nullif(coalesce(front_original, ''), '') AS front, nullif(coalesce(back_original, ''), '') AS back, nullif(coalesce(tags_resolved, ''), '') AS tags FROM c WHERE status = 'aprobada' AND anki_note_id IS NULL"
    # the newest batch against all other cards
    held = "(NOT x.new OR NOT y.new) AND NOT y.new"
    both = _records(CARDS, f"SELECT id, coalesce(front_normalized, '') AS f, coalesce(back_normalized, '') AS b, back_original, coalesce(ingest_batch = {newest}, false) AS new FROM c WHERE coalesce(ingest_batch = {newest}, false) OR status NOT IN ('descartada', 'borrada-en-anki')")
    found = f"m AS (SELECT x.id AS a, y.id AS b, {measures} FROM rc x JOIN rc y ON x.id <> y.id AND x.new AND {held}), sc AS (SELECT a, b, {score} AS raw, {reasons} AS reasons FROM m), tp AS (SELECT a, b, round(raw, 4) AS score, reasons, row_number() OVER (PARTITION BY a ORDER BY round(raw, 4) DESC, b) AS rk FROM sc WHERE raw >= 0.90), best AS (SELECT a, array_to_string(list(b ORDER BY rk)[:5], ' ') AS matches, arg_min(b, rk) AS top, arg_min(score, rk) AS score, arg_min(reasons, rk) AS reasons FROM tp WHERE rk <= 20 GROUP BY a)"
    flags = f"fl AS (SELECT id, b, back_original, {_flags(chr(115) + 'tring_split(fs, ' + chr(39) + ' ' + chr(39) + ')', chr(115) + 'tring_split(bs, ' + chr(39) + ' ' + chr(39) + ')')} AS fl FROM rc)"
    decided = f"{both}, {tagged.removeprefix(CARDS + ', ')}, {found}, {flags}, dc AS (SELECT r.id, r.b AS back, CASE WHEN best.a IS NOT NULL THEN 'possible_duplicate' WHEN len(tags) > 0 AND len(bad) / len(tags) > 0.5 THEN 'reject' ELSE 'insert' END AS action, len(bad) > 0 AS open, best.* FROM r JOIN t3 USING (id) LEFT JOIN best ON best.a = r.id WHERE r.new)"
    better = f"len(n.fl) < len(o.fl) OR (len(n.fl) = len(o.fl) AND length(trim(o.b)) > 0 AND length(trim(n.b)) > length(trim(o.b)) * {quality.LONGER} AND NOT list_contains(n.fl, 'respuesta_larga'))"
    out["annotate"] = (
        f"WITH {decided} SELECT dc.id AS record_id, action, CASE action WHEN 'possible_duplicate' THEN printf('match (%s, score=%.2f)', replace(dc.reasons, ',', ', '), score) WHEN 'reject' THEN 'more than half of the tags are unresolved' ELSE 'no duplicate' END AS reason, coalesce(matches, '') AS matches, "
        f"CASE action WHEN 'reject' THEN 'descartada' WHEN 'possible_duplicate' THEN 'en-revision' ELSE CASE WHEN open THEN 'en-revision' ELSE 'aprobada' END END AS status, array_to_string(n.fl, ' ') AS quality, {suits.replace('trim(b)', 'trim(back)')} AS cloze, CASE WHEN top IS NOT NULL THEN CASE WHEN {better} THEN 'replace_old_with_new' ELSE 'keep_existing' END END AS version "
        "FROM dc JOIN fl n ON n.id = dc.id LEFT JOIN fl o ON o.id = dc.top"
    ).replace("CASE WHEN length(b) >", "CASE WHEN length(b) >")
    out["audit_summary"] = f"WITH {decided} SELECT action, count(*) AS cards FROM dc GROUP BY 1"
    recent = "re AS (SELECT note_id FROM n WHERE indexed_at::TIMESTAMPTZ >= (SELECT max(indexed_at)::TIMESTAMPTZ FROM n) - INTERVAL 30 DAYS)"
    out["recent_audit"] = f"WITH {rec}, {recent}, m AS (SELECT x.id AS a, y.id AS b, {measures} FROM rc x JOIN rc y ON x.id <> y.id WHERE x.id IN (SELECT note_id FROM re)), sc AS (SELECT a, b, {score} AS raw FROM m), bs AS (SELECT a, b, round(raw, 4) AS score, row_number() OVER (PARTITION BY a ORDER BY round(raw, 4) DESC, b) AS rk FROM sc WHERE raw >= 0.75), ms AS (SELECT id, array_to_string(list_filter(['topic', 'type'], lambda c: NOT list_contains(coalesce(json_keys(scope_json), []), c)), ' ') AS missing FROM r) SELECT r.id AS record_id, bs.b AS best, bs.score AS score, missing, bs.b IS NULL AND missing = '' AS ok FROM r JOIN re ON re.note_id = r.id JOIN ms ON ms.id = r.id LEFT JOIN bs ON bs.a = r.id AND bs.rk = 1"
    open_rec = _records(NOTES, "SELECT note_id AS id, coalesce(front_normalized, '') AS f, coalesce(back_normalized, '') AS b, front_normalized, deck_name, note_type, scope_json FROM n WHERE json_extract_string(scope_json, '$.topic') IS NULL")
    out["taxonomy_proposals"] = f"WITH RECURSIVE {open_rec}, {scored}, eq AS (SELECT a, b FROM sc WHERE raw >= 0.75), {_components('eq', 'roots')}, sz AS (SELECT root, count(*) AS size FROM roots GROUP BY root HAVING count(*) >= 3), wd AS (SELECT root, w AS label, count(*) AS n FROM (SELECT DISTINCT root, id, unnest(string_split(fs, ' ')) AS w FROM roots JOIN r USING (id)) WHERE length(w) > 3 AND NOT list_contains({_list(text.STOPWORDS)}, w) GROUP BY 1, 2), ra AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, label) AS rk FROM wd), sm AS (SELECT root, array_to_string(list(f ORDER BY id)[:5], ' | ') AS samples FROM roots JOIN r USING (id) GROUP BY root) SELECT root AS cluster, label, size, label NOT IN (SELECT value FROM taxonomy) AS is_new, samples FROM ra JOIN sz USING (root) JOIN sm USING (root) WHERE rk = 1 AND n >= greatest(2, size // 2)"
    out["ingest_upsert"] = f"WITH {CARDS}, h AS (SELECT fingerprint, arg_min(status, (created_at, id)) AS held FROM c WHERE fingerprint IS NOT NULL AND ingest_batch < {newest} GROUP BY 1), b AS (SELECT id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, id) AS turn FROM c WHERE fingerprint IS NOT NULL AND ingest_batch = {newest}) SELECT id, CASE WHEN turn > 1 THEN 'updated' WHEN held IS NULL THEN 'new' WHEN held IN ('descartada', 'borrada-en-anki') THEN 'resurrected' ELSE 'updated' END AS outcome FROM b LEFT JOIN h USING (fingerprint)"
    out["lifecycle_fold"] = f"WITH {CARDS} SELECT id AS record_id, CASE WHEN anki_note_id IS NULL THEN 'aprobada' ELSE 'subida' END AS status, anki_note_id, CASE WHEN anki_note_id IS NOT NULL THEN sync_batch END AS sync_batch FROM c WHERE status <> 'descartada'"
    out["latest_events"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
    out["untagged_page"] = f"WITH {tagged}, u AS (SELECT id FROM t3 WHERE len(list_filter(tags, lambda t: starts_with(t, 'topic::'))) = 0) SELECT id, (SELECT count(*) FROM u) AS total, CASE WHEN 100 < (SELECT count(*) FROM u) THEN 100::BIGINT END AS next_offset FROM u ORDER BY id LIMIT 50 OFFSET 50"
    out["collection_health"] = f"WITH {roots} SELECT (SELECT count(*) FROM r) AS scanned, (SELECT count(*) FROM r WHERE json_extract_string(scope_json, '$.topic') IS NULL) AS untagged, (SELECT count(*) FROM cl) AS clusters, (SELECT sum(size)::BIGINT FROM cl) AS clustered, 0::BIGINT AS leeches"
    out["cache_join"] = f"WITH {NOTES}, h AS (SELECT fingerprint, arg_max(vector, (created_at, vector)) AS vector FROM embedding_cache WHERE model = 'tilo-embed:64' AND len(vector) > 0 GROUP BY 1) SELECT note_id, vector IS NOT NULL AS cached, round(coalesce(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 0.0), 4) AS length FROM n LEFT JOIN h USING (fingerprint)"
    out["recent_notes"] = f"WITH {NOTES} SELECT note_id, indexed_at FROM n WHERE indexed_at::TIMESTAMPTZ >= (SELECT max(indexed_at)::TIMESTAMPTZ FROM n) - INTERVAL 30 DAYS"
    one = lambda p: f"SELECT '{p}' AS prefix, CASE WHEN count(*) = 0 THEN 'missing' WHEN bool_or(id = '{p}') OR count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN count(*) = 1 THEN min(id) END AS id, count(*) AS n FROM c WHERE starts_with(id, '{p}')"
    out["id_lookup"] = f"WITH {CARDS} " + " UNION ALL ".join(one(p) for p in ("0", "00", "zz"))
    out["sync_plan"] = f"WITH {CARDS}, p AS (SELECT id, note_type, coalesce(target_deck, 'Aula Abierta') AS deck, CASE WHEN note_type IN ('Basic', 'Cloze EN', 'Basic (reversed)') THEN note_type WHEN note_type = 'Cloze' THEN 'Cloze EN' END AS model FROM c WHERE status = 'aprobada' AND anki_note_id IS NULL) SELECT id, model, deck, CASE WHEN model IS NULL THEN 'unknown model: ' || note_type WHEN deck NOT IN (SELECT deck_name FROM indexed_decks WHERE deck_name IS NOT NULL) THEN 'unknown deck: ' || deck END AS error FROM p"
    out["undo_ingest"] = f"WITH {CARDS} SELECT count(*) FILTER (status <> 'subida') AS deleted, count(*) FILTER (status = 'subida') AS kept FROM c WHERE ingest_batch = {newest}"
    out["undo_sync"] = f"WITH {CARDS} SELECT CASE WHEN sync_batch = (SELECT max(sync_batch) FROM c) THEN 'aprobada' ELSE status END AS status, count(*) AS n FROM c GROUP BY 1"
    root = "(deck_name = 'Aula Abierta' OR starts_with(deck_name, 'Aula Abierta::'))"
    at = "(SELECT max(last_refreshed_at) FROM indexed_decks WHERE deck_name = 'Aula Abierta' OR starts_with(deck_name, 'Aula Abierta::'))"
    out["replaced_deck"] = f"WITH {NOTES} SELECT deck_name, count(*) AS n FROM n WHERE NOT coalesce({root}, false) OR indexed_at >= coalesce({at}, '') GROUP BY 1"
    counts = "dp AS (SELECT unnest(list_transform(range(1, len(string_split(deck_name, '::')) + 1), lambda i: array_to_string(string_split(deck_name, '::')[1:i], '::'))) AS deck_name FROM n WHERE deck_name IS NOT NULL), dc AS (SELECT deck_name, count(*) AS note_count FROM dp GROUP BY 1)"
    out["deck_counts"] = f"WITH {NOTES}, {counts} SELECT deck_name, note_count FROM dc"
    out["stale_decks"] = f"WITH {NOTES}, {counts} SELECT coalesce(i.deck_name, dc.deck_name) AS deck_name, i.note_count AS held, coalesce(dc.note_count, 0) AS now FROM indexed_decks i FULL OUTER JOIN dc ON dc.deck_name = i.deck_name WHERE i.note_count IS NULL OR i.note_count <> coalesce(dc.note_count, 0)"
    out["record_pool"] = f"WITH {CARDS}, {NOTES}, a AS (SELECT coalesce('anki:' || anki_note_id, id) AS record_id, max(front_normalized) AS front FROM c WHERE status NOT IN ('descartada', 'borrada-en-anki') GROUP BY 1), b AS (SELECT 'anki:' || note_id AS record_id, front_normalized AS front FROM n) SELECT * FROM b UNION ALL SELECT * FROM a WHERE record_id NOT IN (SELECT record_id FROM b)"
    out["embedding_text"] = f"WITH {CARDS} SELECT id, CASE WHEN trim(coalesce(back_original, '')) = '' THEN trim(front_original) ELSE trim(front_original) || chr(10) || trim(back_original) END AS text FROM c"
    out["review_queue"] = f"WITH {CARDS} SELECT id, created_at FROM c WHERE status = 'en-revision'"
    out["sync_queue"] = f"WITH {CARDS} SELECT id, created_at FROM c WHERE status = 'aprobada' AND anki_note_id IS NULL"
    out["action_counts"] = f"WITH {CARDS} SELECT action_taken, count(*) AS n FROM c GROUP BY 1"
    out["status_metrics"] = f"WITH {CARDS} SELECT count(*) AS total, count(*) FILTER (status IN ('aprobada', 'subida')) AS auto_resolved, count(*) FILTER (status = 'en-revision') AS escalated, count(*) FILTER (status = 'descartada') AS discarded, count(*) FILTER (status = 'borrada-en-anki') AS deleted FROM c"
    out["transition_matrix"] = f"WITH {CARDS} SELECT audit_action, status, count(*) AS n FROM c WHERE audit_action IS NOT NULL GROUP BY 1, 2"
    out["precision_metrics"] = f"WITH {CARDS}, p AS (SELECT count(*) FILTER (status IN ('aprobada', 'subida')) AS kept, count(*) FILTER (status = 'descartada') AS discarded, count(*) FILTER (status = 'en-revision') AS pending FROM c WHERE audit_action = 'possible_duplicate') SELECT *, kept + discarded AS resolved, CASE WHEN kept + discarded > 0 THEN round(kept / (kept + discarded), 3) END AS kept_share FROM p"
    for name, column in (("ingest_batches", "ingest_batch"), ("sync_batches", "sync_batch")):
        out[name] = f"WITH {CARDS} SELECT {column} AS batch, count(*) AS cards, min(created_at) AS first_at FROM c WHERE {column} IS NOT NULL GROUP BY 1"
    out["reconcile_orphans"] = f"WITH {CARDS}, {NOTES} SELECT id, anki_note_id FROM c WHERE status = 'subida' AND anki_note_id IS NOT NULL AND anki_note_id NOT IN (SELECT note_id FROM n)"
    blank = lambda c: f"coalesce(trim({c}) = '', true)"
    out["card_files_read"] = f"WITH {CARDS}, z AS (SELECT front_original AS front, back_original AS back, source, coalesce(note_type, 'Basic') AS kind, CASE WHEN {blank('front_original')} THEN 'front is empty' WHEN {blank('back_original')} THEN 'back is empty' WHEN source IS NULL THEN 'source is missing' END AS error FROM c) SELECT front, back, source, CASE WHEN error IS NULL THEN kind END AS note_type, error FROM z"
    out["registry_backup"] = f"WITH {CARDS} SELECT status, count(*) AS n FROM c GROUP BY 1"
    parts = lambda c, by: f"list_filter(string_split(coalesce({c}, ''), '{by}'), lambda t: t <> '')"
    out["index_codec"] = f"WITH {NOTES} SELECT note_id, array_to_string({parts('content_tokens', ' ')}, ' ') AS content_tokens, array_to_string({parts('anchor_tokens', ' ')}, ' ') AS anchor_tokens, " + ", ".join(f"len({parts(c, by)})::INT AS n_{c}" for c, by in (("content_tokens", " "), ("back_tokens", " "), ("anchor_tokens", " "), ("char_trigrams", "|"))) + " FROM n"
    out["migrated"] = f"WITH {CARDS} SELECT id, CASE WHEN action_taken = 'reject' THEN 'descartada' WHEN action_taken = 'possible_duplicate' THEN 'en-revision' WHEN anki_note_id IS NOT NULL THEN 'subida' WHEN contains(coalesce(tags_resolved, ''), '_unresolved::') THEN 'en-revision' ELSE 'aprobada' END AS status, nullif(trim(json_extract_string(scope_json, '$.topic')), '') AS topic FROM c"
    out["review_list"] = f"WITH {CARDS} SELECT id, substr(id, 1, 8) AS id_short, front_original AS front, json_extract_string(scope_json, '$.topic') AS topic, profile_name AS profile, target_deck AS deck, status, created_at FROM c WHERE status = 'en-revision'"
    out["reconcile_events"] = f"WITH {CARDS}, {NOTES} SELECT id AS record_id, 'deleted_in_anki' AS event, 'borrada-en-anki' AS status, 1::BIGINT AS seq FROM c WHERE status = 'subida' AND anki_note_id IS NOT NULL AND anki_note_id NOT IN (SELECT note_id FROM n)"
    out["auto_classify"] = f"WITH z AS ({out['classified']}) SELECT count(*) AS total, count(*) FILTER (confidence = 'high') AS auto_classified, count(*) FILTER (confidence <> 'high') AS needs_review, coalesce(round(count(*) FILTER (confidence = 'high') / nullif(count(*), 0) * 100), 0)::INT AS saved_pct FROM z"
    out["date_stamps"] = f"WITH {CARDS} SELECT id, strftime(created_at::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') AS stamp FROM c"
    out["record_shapes"] = f"WITH {rec} SELECT id, deck_name AS deck, note_type, front_normalized AS front, substr(coalesce(b, ''), 1, 160) AS back_excerpt, intent, skey AS semantic_key FROM r JOIN (SELECT note_id AS id, front_normalized FROM n) USING (id)"
    out["records_as_json"] = f"WITH {CARDS} SELECT to_json({{'id': id, 'status': status}})::VARCHAR AS json FROM c"
    out["cache_upserted"] = "SELECT fingerprint, model, arg_max(dim, (created_at, vector)) AS dim, max(created_at) AS created_at FROM embedding_cache WHERE len(vector) > 0 GROUP BY fingerprint, model"
    out["by_fingerprint"] = f"WITH {CARDS} SELECT id, fingerprint FROM c WHERE fingerprint = (SELECT max(fingerprint) FROM c) ORDER BY created_at, id LIMIT 1"
    out["first_of_fronts"] = f"WITH {CARDS}, {NOTES}, a AS (SELECT front_normalized AS front, id AS record_id, 1 AS place, 0 AS note, coalesce(created_at, '') AS made FROM c WHERE status NOT IN ('descartada', 'borrada-en-anki') UNION ALL SELECT front_normalized, 'anki:' || note_id, 0, note_id, '' FROM n) SELECT front, arg_min(record_id, (place, note, made, record_id)) AS first, count(*) AS records FROM a WHERE front <> '' GROUP BY front"
    out["refreshed_decks"] = f"WITH {NOTES} SELECT deck_name, include_subdecks, last_refreshed_at, note_count FROM indexed_decks WHERE deck_name <> 'Aula Abierta' UNION ALL SELECT 'Aula Abierta', 1, '2030', count(*) FROM n WHERE {root} AND trim(coalesce(front_original, '')) <> ''"
    sides = "sd AS (SELECT front_original AS side FROM c UNION SELECT back_original FROM c)"
    out["normalized_format"] = f"WITH {CARDS}, {sides}, {_formatted('side', 'sd')} SELECT id, f.form AS front, b.form AS back FROM c LEFT JOIN nf f ON f.x = front_original LEFT JOIN nf b ON b.x = back_original"
    return out
