"""DuckDB SQL that gives the rows of plans.queries."""

from __future__ import annotations

from quillspark.functions.text import CHAT_MARKUP, MARKUP
from quillspark.operators import segmenter
from quillspark.plans.queries import CENTRES, QUOTAS, STAGES

#: CRC-32 of ASCII text. The table comes from the polynomial: eight shift steps of each byte value.
CRC = (
    "WITH tb AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb)"
)


def _crc(key: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '\s+', ' ', 'g'))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _sentences(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _any(c: str, marks) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in marks) + ")"


def _count(c: str, char: str) -> str:
    return f"(length({c}) - length(replace({c}, '{char}', '')))"


def _ratio(c: str) -> str:
    seen = rf"length(regexp_replace({c}, '\s', '', 'g'))"
    return rf"CASE WHEN {seen} = 0 THEN 1.0 ELSE length(regexp_replace({c}, '[\s\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / {seen} END"


def _message(c: str, limit: int) -> str:
    t = _clean(c)
    return f"CASE WHEN {_any(t, CHAT_MARKUP)} THEN '' WHEN length({t}) > {limit} THEN rtrim({t}[1:{limit}]) ELSE {t} END"


def _qa(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '(\|\|+)|(\{{\{{.*?\}}\}})|(<ref.*?>.*?</ref>)|(<.*?>)', ' ', 'g'), '\|{{2,}}', ' ', 'g'), '\s+', ' ', 'g'))"


def _first_sentence(c: str) -> str:
    return rf"string_split(regexp_replace({_clean(c)}, '([.!?])\s+', '\1' || chr(1)), chr(1))[1]"


def _first_dot(c: str) -> str:
    t = _strip(f"(coalesce({c}, ''))[1:220]")
    head = _strip(f"string_split({t}, '.')[1]")
    return f"CASE WHEN NOT contains({t}, '.') THEN {t} WHEN {head} = '' THEN '' ELSE {head} || '.' END"


def _capital(c: str) -> str:
    return f"upper({c}[1:1]) || {c}[2:]"


def _role(c: str, empty: str) -> str:
    r = f"lower(trim(coalesce({c}, '')))"
    return f"CASE WHEN {r} = '' THEN '{empty}' ELSE {_capital(r)} END"


def _role_pull(c: str) -> str:
    r = f"lower(trim(coalesce({c}, '')))"
    return f"CASE WHEN {r} IN ('user','human','prompter') THEN 'user' WHEN {r} IN ('assistant','gpt','bot') THEN 'assistant' WHEN {r} = '' THEN 'user' ELSE {r} END"


def _role_export(c: str) -> str:
    r = f"lower(coalesce({c}, ''))"
    return f"CASE WHEN {r} IN ('user','human','prompter') THEN 'User' WHEN {r} IN ('assistant','gpt','bot') THEN 'Assistant' WHEN {r} = '' THEN 'Unknown' ELSE {_capital(r)} END"


PARAGRAPHS = r"""p AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\f\r]'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{2,}'),
    lambda x: replace(regexp_replace(x, '^\n+|\n+$', '', 'g'), chr(10), ' ')), lambda x: x <> '') AS ps FROM documents
)"""
REASON = f"CASE WHEN {_any('x', MARKUP)} THEN 'markup' WHEN {_count('x', '|')} >= 4 OR {_count('x', '=')} >= 6 THEN 'pipe_eq' WHEN length(x) < 25 THEN 'short' WHEN {_ratio('x')} > 0.35 THEN 'symbol_ratio' END"
SENTENCES = f"""s AS (
  SELECT doc_id, unnest(range(len(k)))::INT AS pos, unnest(k) AS text FROM (SELECT doc_id, list_filter({_sentences(_clean('text'))}, lambda t: length(t) BETWEEN 15 AND 300) AS k FROM documents)
)"""
CONTEXTS = f"""{SENTENCES}, c AS (
  SELECT doc_id, pos, list(text) OVER w AS ctx, text FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
)"""
def _bare(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'))"


def _word(c: str) -> str:
    return rf"regexp_replace({_bare(c)}, '\.$', '')"


def _llr(k: str, a: str, b: str, n: str) -> str:
    def one(k: str, m: str, x: str) -> str:
        rest = f"({m} - {k})"
        return f"(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({x}) END + CASE WHEN {rest} = 0 THEN 0 ELSE {rest} * ln(1 - {x}) END)"

    p, p1, p2 = f"({b}::DOUBLE / {n})", f"({k}::DOUBLE / {a})", f"(({b} - {k})::DOUBLE / ({n} - {a}))"
    return f"CASE WHEN {n} <= {a} THEN 0 WHEN {p1} > {p} THEN 2 * ({one(k, a, p1)} + {one(f'({b} - {k})', f'({n} - {a})', p2)} - {one(k, a, p)} - {one(f'({b} - {k})', f'({n} - {a})', p)}) ELSE 0 END"


LEARNED = rf"""tk AS (
  SELECT list_filter(string_split({_clean('text')}, ' '), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS t FROM documents
), tx AS (
  SELECT z[1] AS token, z[2] AS nxt FROM (SELECT unnest(list_zip(t, t[2:])) AS z FROM tk) WHERE z[1] IS NOT NULL
), tw AS (
  SELECT {_word('token')} AS word, {_bare('token')} LIKE '%.' AS dot, {_word('nxt')} AS nxt FROM tx
), cn AS (
  SELECT word, count(*) AS n, count(*) FILTER (dot) AS dots FROM tw GROUP BY word
), tot AS (
  SELECT sum(n)::BIGINT AS total, sum(dots)::BIGINT AS periods FROM cn
), ab0 AS (
  SELECT word, -2 * (dots * ln(periods::DOUBLE / total) + CASE WHEN n = dots THEN 0 ELSE (n - dots) * ln(1 - periods::DOUBLE / total) END - dots * ln(0.99::DOUBLE) - (n - dots) * ln(0.01::DOUBLE))
    * exp(-length(replace(word, '.', ''))::DOUBLE) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', ''))::DOUBLE, -(n - dots)::DOUBLE) AS score FROM cn, tot WHERE dots > 0
), ab AS (
  SELECT word, score FROM ab0 WHERE score >= {segmenter.ABBREVIATION}
), af AS (
  SELECT word, nxt, count(*) AS k FROM tw WHERE dot AND nxt IS NOT NULL GROUP BY ALL
), en AS (
  SELECT nxt, sum(k)::BIGINT AS k FROM af WHERE word NOT IN (SELECT word FROM ab) GROUP BY nxt
), br AS (
  SELECT sum(k)::BIGINT AS breaks FROM en
), st AS (
  SELECT nxt AS word, {_llr('k', 'breaks', 'n', 'total')} AS score FROM en JOIN cn ON cn.word = nxt, tot, br
), co AS (
  SELECT af.word, nxt, {_llr('k', 'a.dots', 'b.n', 'total')} AS score FROM af JOIN cn a ON a.word = af.word JOIN cn b ON b.word = nxt, tot
  WHERE k > 1 AND (regexp_full_match(af.word, '\p{{L}}|\p{{N}}+') OR af.word IN (SELECT word FROM ab)) AND nxt NOT IN (SELECT word FROM st WHERE score >= {segmenter.STARTER})
)"""
PAIRS = """q AS (
  SELECT * FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'
)"""
ANSWER_REASON = (
    f"CASE WHEN {_clean('question')} = '' OR {_clean('answer')} = '' THEN 'missing_fields' WHEN x = '' THEN 'no_sentence' WHEN {_any('x', MARKUP)} THEN 'markup' WHEN {_count('x', '|')} >= 4 OR {_count('x', '=')} >= 6 THEN 'pipe_eq'"
    f" WHEN {_ratio('x')} > 0.35 THEN 'symbol_ratio' WHEN length(x) < 5 THEN 'too_short' WHEN length(x) > 220 THEN 'too_long' END"
)
BOOK = f"""bk AS (
  SELECT (g // {CENTRES})::INT AS k, (g % {CENTRES})::INT AS v, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS centroid
  FROM (SELECT g, list(x ORDER BY i) AS c FROM (SELECT vec_id % {STAGES * CENTRES} AS g, i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) GROUP BY g)
)"""


def _coded(renorm: bool, name: str) -> str:
    """CTEs up to ``name``(vec_id, codes): stage by stage, the centroid with the greatest product, the lowest of equals."""
    out = [f"{name}_0 AS (SELECT vec_id, embedding::DOUBLE[] AS r, []::INT[] AS codes FROM embeddings)"]
    for k in range(STAGES):
        rest = "list_transform(list_zip(r, best.c), lambda p: p[1] - p[2])"
        if renorm:
            rest = f"list_transform({rest}, lambda x: x / (sqrt(list_sum(list_transform({rest}, lambda y: y * y))) + 1e-8))"
        out.append(f"""{name}_{k + 1} AS (
  SELECT vec_id, {rest} AS r, list_append(codes, best.v) AS codes
  FROM (SELECT vec_id, any_value(r) AS r, any_value(codes) AS codes, arg_min({{'v': v, 'c': centroid}}, {{'s': -list_inner_product(r, centroid), 'v': v}}) AS best FROM {name}_{k} JOIN bk ON bk.k = {k} GROUP BY vec_id)
)""")
    out.append(f"{name} AS (SELECT vec_id, codes FROM {name}_{STAGES})")
    return BOOK + ", " + ", ".join(out) if name == "e" else ", ".join(out)


CODED, RAW = _coded(True, "e"), _coded(False, "w")
TEXT_CODES = "array_to_string(list_transform(list_zip(codes, range(len(codes))), lambda p: 'c' || p[2] || '=' || p[1]), ' ')"


def _special(width: int) -> str:
    return f"array_to_string(list_transform(list_zip(codes, range(len(codes))), lambda p: '<c' || p[2] || '_' || lpad(p[1]::VARCHAR, {width}, '0') || '>'), ' ')"


PLANNER = f"""{CODED}, pl AS (
  SELECT * FROM (SELECT label, vec_id, flatten(list(codes) OVER w) AS ctx_codes, codes AS tgt_codes FROM e JOIN embeddings USING (vec_id) WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE len(ctx_codes) = {6 * STAGES}
), h AS (
  SELECT vec_id, head, ctx_codes[{5 * STAGES} + head + 1] AS ctx, tgt_codes[head + 1] AS code FROM pl, (SELECT unnest(range({STAGES}))::INT AS head)
), n AS (
  SELECT head, ctx, code, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT head, NULL, code, count(*) FROM h GROUP BY ALL
), pt AS (
  SELECT head, ctx, code AS pred, n / sum(n) OVER (PARTITION BY head, ctx) AS p, row_number() OVER (PARTITION BY head, ctx ORDER BY n DESC, code) AS b FROM n
), pp AS (
  SELECT vec_id, h.head, h.code, pt.pred FROM h JOIN pt ON pt.head = h.head AND pt.ctx = h.ctx AND b = 1
)"""


def _generated(steps: int, cands: int, sampled: bool, temp_power: int = 2, top_p: float = 0.9, seed: int = 11) -> str:
    """CTEs up to the steps x1, x2, ...: every draw is a race of all codes, every look-up compares all of the library."""
    code = (
        f"arg_min(o.code, {{'t': -ln((('0x' || md5(concat_ws('|', '{seed}', '@', h.prompt_id::VARCHAR, cand::VARCHAR, h.head::VARCHAR, o.code::VARCHAR))[1:12])::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE) / o.w, 'c': o.code}})"
        if sampled
        else "arg_min(o.code, {'n': -o.n, 'c': o.code})"
    )
    out = [f"""{PLANNER}, w AS (
  SELECT *, (n::DOUBLE ** {temp_power}) AS w FROM n
), o0 AS (
  SELECT *, coalesce(sum(w) OVER (PARTITION BY head, ctx ORDER BY n DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY head, ctx) AS total FROM w
), o AS (
  SELECT * FROM o0 WHERE before < {top_p}::DOUBLE * total
), seen AS (
  SELECT DISTINCT head, ctx FROM n WHERE ctx IS NOT NULL
), x0 AS (
  SELECT label AS prompt_id, arg_min(ctx_codes, vec_id) AS ctx_codes FROM pl WHERE label IS NOT NULL GROUP BY label
)"""]
    for s in range(1, steps + 1):
        out.append(f"""h{s} AS (
  SELECT prompt_id, k.head, seen.ctx FROM x{s - 1} JOIN (SELECT unnest(range({STAGES}))::INT AS head) k ON true LEFT JOIN seen ON seen.head = k.head AND seen.ctx = ctx_codes[len(ctx_codes) - {STAGES} + k.head + 1]
), p{s} AS (
  SELECT prompt_id, list(pred ORDER BY h.head) AS pred_codes FROM h{s} h JOIN pt ON pt.head = h.head AND pt.ctx IS NOT DISTINCT FROM h.ctx AND b = 1 GROUP BY prompt_id
), d{s} AS (
  SELECT h.prompt_id, h.head, cand, {code.replace("'@'", f"'{s}'")} AS code FROM h{s} h JOIN o ON o.head = h.head AND o.ctx IS NOT DISTINCT FROM h.ctx, (SELECT unnest(range({cands})) AS cand) GROUP BY ALL
), t{s} AS (
  SELECT prompt_id, cand, list(code ORDER BY head) AS drawn FROM d{s} GROUP BY ALL
), f{s} AS (
  SELECT prompt_id, cand, arg_min({{'text': text, 'codes': codes}}, {{'m': -len(list_filter(list_zip(codes, drawn), lambda z: z[1] = z[2])), 't': text}}) AS f FROM t{s}, (SELECT 'vector ' || vec_id AS text, codes FROM e) GROUP BY ALL
), r{s} AS (
  SELECT prompt_id, cand, f, pred_codes, len(list_filter(list_zip(f.codes, pred_codes), lambda z: z[1] = z[2]))::INT AS score FROM f{s} JOIN p{s} USING (prompt_id)
), b{s} AS (
  SELECT prompt_id, any_value(pred_codes) AS pred_codes, arg_min({{'f': f, 'score': score}}, {{'s': -score, 'c': cand}}) AS b, string_agg(f.text || ':' || score, ', ' ORDER BY cand) AS candidates FROM r{s} GROUP BY prompt_id
), x{s} AS (
  SELECT b{s}.prompt_id, {s} AS step, b{s}.pred_codes, b.f.text AS text, b.score AS match, b.score || '/{STAGES}' AS match_str, b{s}.candidates, (list_concat(x{s - 1}.ctx_codes, b.f.codes))[-{6 * STAGES}:] AS ctx_codes FROM b{s} JOIN x{s - 1} ON b{s}.prompt_id = x{s - 1}.prompt_id
)""")
    return ", ".join(out)


def _history(empty: str) -> str:
    return f"""t AS (
  SELECT conv_id, turn, {_role('role', empty)} AS role, {_clean('text')} AS content FROM conversations WHERE {_clean('text')} <> ''
), a AS (
  SELECT conv_id, turn, unnest(range(len(k)))::INT AS pos, unnest(k) AS sentence FROM (SELECT conv_id, turn, {_sentences('content')} AS k FROM t WHERE role = 'Assistant')
), x AS (
  SELECT *, trim(regexp_replace(regexp_replace(sentence, '(?:<c\\d+_\\d+>|\\bc\\d+_\\d+\\b)', '', 'g'), '\\s+', ' ', 'g')) AS tgt FROM a
), y AS (
  SELECT *, CASE WHEN tgt = '' THEN 'control_stripped_empty' WHEN length(tgt) < 5 THEN 'too_short' WHEN length(tgt) > 220 THEN 'too_long' END AS reason FROM x
)"""


def _pulled() -> str:
    normal = f"list_transform(m, lambda x: {{'role': {_role_pull('x.role')}, 'content': {_message('x.content', 2000)}}})"
    quotas = " ".join(f"WHEN source = '{s}' AND split = '{p}' THEN {n}" for (s, p), n in QUOTAS.items())
    seeds = " ".join(f"WHEN source = '{s}' AND split = '{p}' THEN {40 + i}" for i, (s, p) in enumerate(QUOTAS))
    return f"""{CRC}, {PAIRS}, m0 AS (
  SELECT conv_id, list({{'role': role, 'content': CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN '' ELSE text END}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id
), u AS (
  SELECT 'chats' AS source, conv_id::VARCHAR AS key, CASE WHEN len(list_filter(n, lambda x: x.content = '')) = 0 THEN n END AS messages FROM (SELECT conv_id, {normal} AS n FROM m0)
  UNION ALL
  SELECT 'pairs', (conv_id * 1000 + turn)::VARCHAR, CASE WHEN {_message('question', 2000)} <> '' AND {_message('answer', 2000)} <> '' THEN [{{'role': 'system', 'content': 'Be brief.'}}, {{'role': 'user', 'content': {_message('question', 2000)}}}, {{'role': 'assistant', 'content': {_message('answer', 2000)}}}] END FROM q
), v AS (
  SELECT source, key, messages, CASE WHEN {_crc("'0|' || key")} < {int(0.05 * 2**32)} THEN 'val' ELSE 'train' END AS split FROM u, tb
), y AS (
  SELECT *, CASE {quotas} END AS quota, md5((CASE {seeds} END) || '|' || key) AS place FROM v
), z AS (
  SELECT *, coalesce(count(messages) OVER (PARTITION BY source, split ORDER BY place, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM y
)"""


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
MESSAGES = "g AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def oracle_sql() -> dict[str, str]:
    strip_t, strip_text = _strip("coalesce(x.content, '')"), _strip("coalesce(text, '')")
    normal = f"list_transform(m, lambda x: {{'role': {_role_pull('x.role')}, 'content': {_message('x.content', 2000)}}})"
    control = "regexp_matches(t, '(\\|\\||<c\\d+_\\d{4}>|c\\d+_\\d+>)')"
    return {
        "clean_whitespace": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
        "clean_messages": f"SELECT conv_id, turn, {_message('text', 2000)} AS text FROM conversations",
        "clean_qa_text": f"SELECT page_id, {_qa('html')} AS text FROM pages",
        "split_sentences": f"WITH {SENTENCES} SELECT * FROM s",
        "abbreviations": f"WITH {LEARNED} SELECT 'abbreviation' AS kind, word, '' AS next, round(score, 4) AS score FROM ab UNION ALL SELECT 'collocation', word, nxt, round(score, 4) FROM co WHERE score >= {segmenter.COLLOCATION} UNION ALL SELECT 'starter', word, '', round(score, 4) FROM st WHERE score >= {segmenter.STARTER}",
        "learned_sentences": rf"""WITH {LEARNED}, pc AS (
  SELECT doc_id, unnest(range(len(k))) AS i, unnest(list_zip(k, k[2:])) AS z FROM (SELECT doc_id, {_sentences(_clean('text'))} AS k FROM documents)
), pq AS (
  SELECT doc_id, i, z[1] AS piece, regexp_extract(z[1], '(\S+)$', 1) AS l, regexp_extract(z[2], '^(\S+)', 1) AS f, z[2] IS NOT NULL AS more FROM pc WHERE z[1] IS NOT NULL
), pr AS (
  SELECT doc_id, i, piece, more AND {_bare('l')} LIKE '%.' AND CASE WHEN {_word('l')} IN (SELECT word FROM ab)
    THEN NOT (EXISTS (SELECT 1 FROM st WHERE score >= {segmenter.STARTER} AND st.word = {_word('f')}) AND regexp_matches(regexp_replace(f, '^[^\p{{L}}\p{{N}}]+', ''), '^\p{{Lu}}') AND NOT EXISTS (SELECT 1 FROM co WHERE score >= {segmenter.COLLOCATION} AND co.word = {_word('l')} AND co.nxt = {_word('f')}))
    ELSE regexp_full_match({_word('l')}, '\p{{L}}|\p{{N}}+') AND EXISTS (SELECT 1 FROM co WHERE score >= {segmenter.COLLOCATION} AND co.word = {_word('l')} AND co.nxt = {_word('f')}) END AS glued FROM pq
), pg AS (
  SELECT *, coalesce(count(*) FILTER (NOT glued) OVER (PARTITION BY doc_id ORDER BY i {BEFORE}), 0) AS g FROM pr
), ps AS (
  SELECT doc_id, g, string_agg(piece, ' ' ORDER BY i) AS text FROM pg GROUP BY ALL
) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS pos, text FROM ps WHERE length(text) BETWEEN 15 AND 300""",
        "sentence_ids": f"WITH {SENTENCES} SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS sent_id FROM s",
        "sentence_forms": f"SELECT doc_id, {_first_sentence('text')} AS first_sentence, {_first_dot('text')} AS first_dot, len(list_filter({_sentences(_clean('text'))}, lambda s: length(s) >= 5))::INT AS n_inference FROM documents",
        "paragraphs": f"WITH {PARAGRAPHS} SELECT doc_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS paragraph FROM p",
        "clean_paragraphs": f"WITH {PARAGRAPHS}, k AS (SELECT doc_id, list_filter(ps, lambda x: {REASON} IS NULL) AS k FROM p) SELECT doc_id, array_to_string(k, chr(10) || chr(10)) AS text FROM k WHERE len(k) > 0",
        "clean_reason_counts": f"WITH {PARAGRAPHS}, u AS (SELECT unnest(ps) AS x FROM p) SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS rows FROM u GROUP BY 1",
        "symbol_ratio": f"SELECT doc_id, round({_ratio(chr(99))}, 9) AS symbol_ratio FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents)",
        "markup_flags": f"SELECT page_id, {_any('html', MARKUP)} AS has_markup, NOT regexp_matches(coalesce(html, ''), '(?i)(\\|\\||^\\s*\\||align=right|data-sort-value=|rowspan=|colspan=|style=|class=|scope=|bgcolor=)') AND length({_strip('html')}) >= 5 AS clean_target FROM pages",
        "decoder_targets": f"SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?i)(\\|\\||^\\s*\\||align=right|data-sort-value=|rowspan=|colspan=|style=|class=|scope=|bgcolor=)') AND length({_strip('coalesce(text, chr(32))')}) >= 5",
        "control_token_check": f"WITH {CODED}, r AS (SELECT {_special(4)} AS t FROM e UNION ALL SELECT coalesce(text, '') FROM conversations) SELECT count(*) AS rows, count(*) FILTER ({control}) AS hits, count(*) FILTER ({control}) / greatest(count(*), 1) AS share FROM r",
        "mix_validation": f"WITH {CODED}, r AS (SELECT {TEXT_CODES} AS t FROM e UNION ALL SELECT coalesce(text, '') FROM conversations), k AS (SELECT count(*) AS rows, count(*) FILTER ({_strip('t')} <> '') AS written, count(*) FILTER ({_strip('t')} = '') AS skipped_empty, count(*) FILTER ({_strip('t')} <> '' AND regexp_matches(t, '(<c\\d+_\\d+>|\\bc\\d+=\\d+)')) AS control_in_tgt FROM r) SELECT *, round(100.0::DOUBLE * control_in_tgt / greatest(written, 1), 4) AS control_pct FROM k",
        "strip_control_tokens": f"WITH {CODED} SELECT vec_id, trim(regexp_replace(regexp_replace('a  ' || {_special(2)} || ' c1_2 c12 b', '(?:<c\\d+_\\d+>|\\bc\\d+_\\d+\\b)', '', 'g'), '\\s+', ' ', 'g')) AS text FROM e",
        "role_norm": f"SELECT conv_id, turn, {_role_export('role')} AS export, {_role_pull('role')} AS pull, {_role('role', 'Unknown')} AS instruct, {_role('role', 'User')} AS decoder FROM conversations",
        "conversation_docs": f"WITH {MESSAGES} SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: {strip_t} <> ''), lambda x: {_role_export('x.role')} || ': ' || {strip_t}), chr(10)) AS text FROM g",
        "normalized_conversations": f"WITH {MESSAGES}, n AS (SELECT conv_id, {normal} AS m FROM g) SELECT conv_id, len(m)::INT AS n_messages, array_to_string(list_transform(m, lambda x: x.role || '=' || x.content), '|') AS text FROM n WHERE len(list_filter(m, lambda x: x.content = '')) = 0",
        "prompt_of_messages": f"WITH {MESSAGES} SELECT conv_id, array_to_string(list_filter(list_transform(m, lambda x: {strip_t}), lambda c: c <> ''), ' ') AS prompt FROM g",
        "instruction_texts": f"WITH {PAIRS} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN {_strip('question')} <> '' THEN 'Instruction: ' || {_strip('question')} END, CASE WHEN {_strip('answer')} <> '' THEN 'Assistant: ' || {_strip('answer')} END], lambda z: z IS NOT NULL), chr(10)) AS text FROM q",
        "question_messages": f"WITH {PAIRS} SELECT conv_id, turn, 3 AS n, 'system=Be brief.|user=' || {_message('question', 2000)} || '|assistant=' || {_message('answer', 2000)} AS text FROM q WHERE {_message('question', 2000)} <> '' AND {_message('answer', 2000)} <> ''",
        "prompts": f"WITH {PAIRS} SELECT conv_id, turn, '### Instruction:' || chr(10) || {_clean('question')} || chr(10) || chr(10) || '### Response:' || chr(10) AS instruction, 'User: ' || {_clean('question')} || chr(10) || 'Assistant:' AS chat, 'Q: ' || {_clean('question')} || chr(10) || 'A:' AS qa FROM q",
        "qa_pairs_filtered": f"WITH {PAIRS}, z AS (SELECT *, {_first_sentence('answer')} AS x FROM q) SELECT conv_id, turn, '### Instruction:' || chr(10) || {_clean('question')} || chr(10) || chr(10) || '### Response:' || chr(10) AS ctx_text, x AS tgt_text FROM z WHERE {ANSWER_REASON} IS NULL",
        "qa_reason_counts": f"WITH {PAIRS}, z AS (SELECT *, {_first_sentence('answer')} AS x FROM q) SELECT coalesce({ANSWER_REASON}, 'kept') AS reason, count(*) AS rows FROM z GROUP BY 1",
        "qa_first_dot": f"WITH {PAIRS} SELECT conv_id, turn, 'User: ' || {_clean('question')} || chr(10) || 'Assistant:' AS ctx_text, {_first_dot(_clean('answer'))} AS tgt_text FROM q WHERE {_first_dot(_clean('answer'))} <> ''",
        "qa_items": f"WITH {PAIRS}, z AS (SELECT 'spans' AS source, question AS qu, answer AS an FROM q WHERE turn <= 4 UNION ALL SELECT 'lists', question, answer FROM q UNION ALL SELECT 'choices', question || ' (A) no (B) ' || answer, answer FROM q), k AS (SELECT source, {_qa('qu')} AS question, {_qa('an')} AS answer FROM z) SELECT * FROM k WHERE question <> '' AND length(answer) BETWEEN 2 AND 220 AND {_count('answer', '|')} < 2",
        "qa_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(coalesce(text, ''))",
        "doc_hash_split": f"{CRC} SELECT doc_id, {_crc(chr(39) + '0|' + chr(39) + ' || doc_id')} < {int(0.05 * 2**32)} AS is_val FROM documents, tb",
        "first_row_id": "SELECT event_id, coalesce(nullif((user_id % 2)::VARCHAR, '0'), nullif(nullif(event_type, 'click'), ''), nullif(event_id::VARCHAR, '0')) AS row_id FROM events",
        "document_ids": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN -doc_id ELSE doc_id + 1000000 END AS new_id FROM documents",
        "stage_counters": f"SELECT count(*) AS seen, count(*) FILTER (b) AS empty, count(*) FILTER (NOT b AND n > 200000) AS too_long, count(*) FILTER (NOT b AND n <= 200000) AS written FROM (SELECT {strip_text} = '' AS b, length(coalesce(text, '')) AS n FROM documents)",
        "context_windows": f"{CRC}, {CONTEXTS} SELECT doc_id, pos, array_to_string(ctx, ' ') AS ctx_text, text AS tgt_text, {_crc(chr(39) + '0|' + chr(39) + ' || doc_id')} < {int(0.05 * 2**32)} AS is_val FROM c, tb WHERE len(ctx) = 6",
        "context_windows_stripped": f"WITH l AS (SELECT doc_id, unnest(range(len(k))) AS pos, unnest(k) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS k FROM documents)), m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS sent_id, {_strip('raw')} AS text FROM l), c AS (SELECT doc_id, sent_id, text, list(text) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ctx FROM m WHERE text <> '') SELECT doc_id, sent_id, array_to_string(ctx, ' ') AS ctx_text, text AS tgt_text FROM c WHERE len(ctx) = 6",
        "document_runs": "WITH a AS (SELECT event_id, user_id % 3 AS doc, CASE WHEN user_id % 3 IS DISTINCT FROM lag(user_id % 3) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1 THEN event_id END AS s FROM events) SELECT event_id, doc, max(s) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a",
        "pad_context": f"WITH {SENTENCES}, l AS (SELECT doc_id, list(text ORDER BY pos) AS k FROM s GROUP BY doc_id), z AS (SELECT doc_id, k[-6:] AS k FROM l) SELECT doc_id, array_to_string(list_concat(list_transform(range(6 - len(k)), lambda i: k[1]), k), ' ') AS ctx_text FROM z",
        "split_report": f"{CRC}, {CONTEXTS}, r AS (SELECT array_to_string(ctx, ' ') AS ctx_text, text, {_crc(chr(39) + '0|' + chr(39) + ' || doc_id')} < {int(0.05 * 2**32)} AS is_val FROM c, tb WHERE len(ctx) = 6) SELECT count(*) FILTER (NOT is_val) AS train, count(*) FILTER (is_val) AS val, round(avg(length(ctx_text)), 6) AS mean_ctx_chars, round(avg(length(text)), 6) AS mean_tgt_chars FROM r",
        "chat_history_full": f"WITH {_history('Unknown')}, hi AS (SELECT conv_id, turn, role, coalesce(string_agg('### ' || role || ':' || chr(10) || content || chr(10) || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn {BEFORE}), '') AS history FROM t), pr AS (SELECT *, coalesce(string_agg(sentence, ' ') OVER (PARTITION BY conv_id, turn ORDER BY pos {BEFORE}), '') AS prefix FROM y) SELECT pr.conv_id, pr.turn, pos, history || '### Assistant:' || chr(10) || prefix || chr(10) AS ctx_text, tgt AS tgt_text FROM pr JOIN hi ON pr.conv_id = hi.conv_id AND pr.turn = hi.turn AND hi.role = 'Assistant' WHERE reason IS NULL",
        "chat_history_kept": f"WITH {_history('User')}, ke AS (SELECT conv_id, turn, string_agg(sentence, ' ' ORDER BY pos) AS kept FROM y WHERE reason IS NULL GROUP BY ALL), hi AS (SELECT t.conv_id, t.turn, role, coalesce(string_agg(CASE WHEN role <> 'Assistant' THEN role || ': ' || content || chr(10) WHEN kept IS NOT NULL THEN role || ': ' || kept || chr(10) ELSE '' END, '') OVER (PARTITION BY t.conv_id ORDER BY t.turn {BEFORE}), '') AS history FROM t LEFT JOIN ke ON t.conv_id = ke.conv_id AND t.turn = ke.turn), pr AS (SELECT *, coalesce(string_agg(sentence, ' ') OVER (PARTITION BY conv_id, turn ORDER BY pos {BEFORE}), '') AS prefix FROM y WHERE reason IS NULL) SELECT pr.conv_id, pr.turn, pos, history || CASE WHEN prefix <> '' THEN 'Assistant: ' || prefix || chr(10) ELSE '' END || 'Assistant:' AS ctx_text, tgt AS tgt_text FROM pr JOIN hi ON pr.conv_id = hi.conv_id AND pr.turn = hi.turn AND hi.role = 'Assistant'",
        "chat_reason_counts": f"WITH {_history('User')}, r AS (SELECT 'missing_content' AS reason FROM conversations WHERE {_clean('text')} = '' UNION ALL SELECT 'no_assistant' FROM t GROUP BY conv_id HAVING count(*) FILTER (role = 'Assistant') = 0 UNION ALL SELECT coalesce(reason, 'kept') FROM y) SELECT reason, count(*) AS rows FROM r GROUP BY reason",
        "seeded_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) AS rank FROM documents",
        "positional_split": "SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) <= floor((SELECT count(*) FROM documents) * 0.98::DOUBLE) AS is_train FROM documents",
        "sample_without_replacement": "WITH a AS (SELECT conv_id * 1000 + turn AS doc_id FROM conversations), n AS (SELECT least(trunc((SELECT count(*) FROM documents) * 0.2::DOUBLE / 0.8::DOUBLE), (SELECT count(*) FROM a)) AS n), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) AS k FROM a) SELECT doc_id, 'base' AS source FROM documents UNION ALL SELECT doc_id, 'aux' FROM r, n WHERE k <= n",
        "reservoir_sample": "SELECT doc_id, n_chars FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100",
        "select_ordinals": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) SELECT * FROM r WHERE ordinal IN (SELECT item_id * 3 FROM benchmark)",
        "head_limit": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50",
        "ratio_mix": "WITH b AS (SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) AS i FROM documents), a0 AS (SELECT conv_id * 1000 + turn AS key FROM conversations), n AS (SELECT count(*) AS n FROM b), k AS (SELECT least(round_even(n * 0.3::DOUBLE / 0.7::DOUBLE, 0)::BIGINT, (SELECT count(*) FROM a0)) AS k, n FROM n), a1 AS (SELECT key, row_number() OVER (ORDER BY md5('1|' || key), key) AS r FROM a0), a AS (SELECT key, row_number() OVER (ORDER BY key) AS i FROM a1, k WHERE r <= k), s0 AS (SELECT unnest(range(n + k)) AS slot, k FROM k), s1 AS (SELECT slot, CASE WHEN row_number() OVER (ORDER BY md5('1|' || slot), slot) <= k THEN 'aux' ELSE 'base' END AS kind FROM s0), s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY slot) AS i FROM s1) SELECT slot, kind, key FROM s JOIN (SELECT 'base' AS kind, * FROM b UNION ALL SELECT 'aux', * FROM a) USING (kind, i)",
        "quota_allocation": "WITH n AS (SELECT count(*) // 2 AS n FROM conversations), q AS (SELECT round_even(n * (0.7::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE)), 0)::BIGINT AS a, n FROM n) SELECT 'a' AS source, a AS quota FROM q UNION ALL SELECT 'b', n - a FROM q",
        "export_documents": f"SELECT row_number() OVER (ORDER BY md5('2|' || doc_id), doc_id) - 1 AS new_id, doc_id AS source_id FROM documents WHERE length({_strip('coalesce(text, chr(32))')}) >= 200",
        "rerank_top1": "SELECT lang, source, doc_id, score FROM (SELECT lang, source, doc_id, n_chars % 50 AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars % 50 DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1",
        "codebook_norms": f"WITH {BOOK} SELECT k, v, round(list_inner_product(centroid, centroid), 6) AS norm FROM bk",
        "rvq_encode": f"WITH {CODED} SELECT vec_id, codes FROM e",
        "rvq_encode_native": f"WITH {CODED} SELECT vec_id, codes FROM e",
        "rvq_encode_raw": f"WITH {BOOK}, {RAW} SELECT vec_id, codes FROM w",
        "rvq_recon_error": f"WITH {CODED}, st AS (SELECT vec_id, unnest(range({STAGES}))::INT AS stage, codes FROM e), x AS (SELECT vec_id, stage, i, sum(centroid[i]) AS r FROM st, bk, (SELECT unnest(range(1, 65)) AS i) WHERE bk.k <= stage AND bk.v = codes[bk.k + 1] GROUP BY ALL), z AS (SELECT x.vec_id, stage, list(r ORDER BY i) AS r FROM x GROUP BY ALL), u AS (SELECT stage, embedding::DOUBLE[] AS a, list_transform(r, lambda q: q / (sqrt(list_inner_product(r, r)) + 1e-8)) AS r FROM z JOIN embeddings USING (vec_id)) SELECT stage, round(avg(list_inner_product(a, a) + list_inner_product(r, r) - 2 * list_inner_product(a, r)), 6) AS mse, round(avg(list_inner_product(a, r)), 6) AS cosine, round(1 - avg(list_inner_product(a, r)), 6) AS cos_dist FROM u GROUP BY stage",
        "zipped_embeddings": "WITH s AS (SELECT vec_id AS sent_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS row_id FROM embeddings WHERE label IS NOT NULL) SELECT sent_id, s.row_id, round(embedding[1]::DOUBLE, 6) AS first FROM s JOIN embeddings e ON e.vec_id = s.row_id",
        "nearest_centroid": f"WITH {BOOK} SELECT vec_id, k, arg_min(v, {{'s': -list_inner_product(embedding::DOUBLE[], centroid), 'v': v}}) AS code FROM embeddings, bk GROUP BY vec_id, k",
        "rvq_fit": f"SELECT k::INT AS k, v::INT AS v, 1.0::DOUBLE AS norm, (SELECT count(embedding) FROM embeddings) AS dealt, true AS fell FROM (SELECT unnest(range({STAGES})) AS k), (SELECT unnest(range({CENTRES})) AS v)",
        "code_strings": f"WITH {CODED} SELECT vec_id, {TEXT_CODES} AS text, {_special(2)} AS special FROM e",
        "parse_codes": f"WITH {CODED} SELECT vec_id, codes FROM e",
        "special_tokens": f"WITH {CODED}, c AS (SELECT unnest(range({STAGES})) AS k, unnest(codes) AS v FROM e), n AS (SELECT k, v, count(*) AS uses FROM c GROUP BY ALL) SELECT k::INT AS k, v::INT AS v, '<c' || k || '_' || lpad(v::VARCHAR, {len(str(CENTRES - 1))}, '0') || '>' AS token, coalesce(uses, 0) AS uses FROM (SELECT k, v FROM (SELECT unnest(range({STAGES})) AS k), (SELECT unnest(range({CENTRES})) AS v)) LEFT JOIN n USING (k, v)",
        "hashed_embeddings": f"""{CRC}, wd AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM benchmark
), hx AS (
  SELECT item_id, hex(encode(w)) AS h FROM wd
), hh AS (
  SELECT item_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM hx, tb
), sm AS (
  SELECT item_id, h % 64 AS i, sum(CASE WHEN h & 2147483648 <> 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hh GROUP BY ALL
), nm AS (
  SELECT item_id, sqrt(sum(x * x)) AS norm FROM sm GROUP BY item_id
) SELECT item_id, i::INT AS i, round(coalesce(x, 0) / greatest(coalesce(norm, 0), 1e-12), 6) AS x FROM (SELECT item_id, i FROM benchmark, (SELECT unnest(range(64)) AS i)) LEFT JOIN sm USING (item_id, i) LEFT JOIN nm USING (item_id)""",
        "qa_more_items": f"WITH {PAIRS}, z AS (SELECT 'values' AS source, question AS qu, CASE WHEN conv_id % 3 = 0 THEN answer[1:40] || '!' ELSE answer END AS an FROM q UNION ALL SELECT 'best', question, answer[1:90] FROM q), k AS (SELECT source, {_qa('qu')} AS question, {_qa('an')} AS answer FROM z) SELECT * FROM k WHERE question <> '' AND length(answer) BETWEEN 2 AND 220 AND {_count('answer', '|')} < 2",
        "shaped_documents": f"WITH {MESSAGES} SELECT conv_id::VARCHAR AS id, CASE conv_id % 3 WHEN 0 THEN {_strip(f"array_to_string(list_transform(list_filter(m, lambda x: {strip_t} <> ''), lambda x: {_role_export('x.role')} || ': ' || {strip_t}), chr(10))")} WHEN 1 THEN {_strip(f"CASE WHEN {_strip("coalesce(m[1].content, '')")} <> '' THEN 'Instruction: ' || {_strip("coalesce(m[1].content, '')")} || chr(10) ELSE '' END || 'Assistant: Yes.'")} ELSE 'plain ' || conv_id END AS text FROM g",
        "decoder_row_files": f"WITH {CODED} SELECT row_number() OVER (ORDER BY 'tgt ' || vec_id) - 1 AS ord, 'ctx ' || vec_id AS ctx_text, 'tgt ' || vec_id AS tgt_text, codes FROM e",
        "code_prompts": f"WITH {CODED}, f AS (SELECT vec_id, 'CTX: v' || vec_id || chr(10) AS a, chr(10) || 'Write exactly one next sentence:' AS z, {TEXT_CODES} AS t, {_special(2)} AS s FROM e) SELECT vec_id, a || z[2:] AS plain, a || 'CODES: ' || t || z AS text, a || 'CODES: ' || s || z AS special FROM f",
        "attached_codes": f"WITH {CODED} SELECT vec_id, label, codes FROM e JOIN embeddings USING (vec_id)",
        "planner_rows": f"WITH {PLANNER} SELECT * FROM pl",
        "valid_code_rows": f"WITH {PLANNER} SELECT vec_id FROM pl",
        "planner_table": f"WITH {PLANNER} SELECT head, ctx, pred, round(p, 9) AS p FROM pt WHERE b = 1",
        "head_accuracy": f"WITH {PLANNER} SELECT head, round(avg((code = pred)::INT), 9) AS head_acc FROM pp GROUP BY head",
        "tuple_accuracy": f"WITH {PLANNER}, o AS (SELECT vec_id, bool_and(code = pred) AS ok FROM pp GROUP BY vec_id) SELECT count(*) AS total, round(avg(ok::INT), 9) AS tuple_acc FROM o",
        "planner_perplexity": f"WITH {CODED}, c AS (SELECT vec_id, unnest(range({STAGES})) AS head, unnest(codes) AS code FROM e), s AS (SELECT head, code, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT head, code, n / sum(n) OVER (PARTITION BY head) AS p FROM s), a AS (SELECT -avg(ln(p)) AS ce FROM c JOIN p USING (head, code)) SELECT round(ce, 6) AS avg_ce, round(CASE WHEN ce < 50 THEN exp(ce) ELSE 'inf'::DOUBLE END, 4) AS perplexity FROM a",
        "code_agreement": f"WITH {CODED}, {RAW}, j AS (SELECT CASE WHEN vec_id % 10 <> 0 THEN e.codes END AS p, w.codes AS g FROM e JOIN w USING (vec_id)) SELECT count(*) FILTER (p IS NOT NULL) AS total, count(*) FILTER (p IS NULL) AS skipped, round(sum(len(list_filter(list_zip(p, g), lambda x: x[1] = x[2]))) FILTER (p IS NOT NULL) / sum(len(p)), 9) AS head_match, round(count(*) FILTER (p = g) / count(p), 9) AS tuple_match FROM j",
        "match_scores": f"WITH {CODED}, {RAW} SELECT vec_id, len(list_filter(list_zip(e.codes, w.codes), lambda x: x[1] = x[2]))::INT AS score FROM e JOIN w USING (vec_id)",
        "generated": f"WITH {_generated(3, 4, True)} " + " UNION ALL ".join(f"SELECT prompt_id, step, pred_codes, text, match, match_str, candidates FROM x{i}" for i in (1, 2, 3)),
        "generated_plain": f"WITH {_generated(2, 1, False)} " + " UNION ALL ".join(f"SELECT prompt_id, step, text, match FROM x{i}" for i in (1, 2)),
        "pulled_instruct": f"WITH {_pulled().removeprefix('WITH ')} SELECT source, split, key, len(messages)::INT AS n, array_to_string(list_transform(messages, lambda x: x.role || '=' || x.content), '|') AS text FROM z WHERE messages IS NOT NULL AND had < quota",
        "pull_counters": f"WITH {_pulled().removeprefix('WITH ')} SELECT source, split, count(*) AS rows_in, count(messages) AS rows_out, count(*) - count(messages) AS rows_dropped FROM z WHERE had < quota GROUP BY ALL",
        "written_documents": f"SELECT count(*) AS seen, count(*) FILTER (b) AS empty, count(*) FILTER (NOT b AND n > 200000) AS too_long, count(*) FILTER (NOT b AND n <= 200000) AS written FROM (SELECT {strip_text} = '' AS b, length(coalesce(text, '')) AS n FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN ' ' || chr(9) || ' ' ELSE text END AS text FROM documents))",
        "written_reasons": f"WITH {PARAGRAPHS}, u AS (SELECT unnest(ps) AS x FROM p), r AS (SELECT {REASON} AS reason FROM u) SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows FROM r GROUP BY 1",
        "written_mix": f"WITH {CODED}, b AS (SELECT 'base' AS kind, CASE WHEN conv_id % 9 = 2 THEN ' ' ELSE text END AS t FROM conversations), a AS (SELECT 'aux' AS kind, {TEXT_CODES} AS t FROM e), r AS (SELECT kind, t, {_strip('t')} <> '' AS f FROM (SELECT * FROM b UNION ALL SELECT * FROM a)), k AS (SELECT count(*) FILTER (kind = 'base') AS rows_in_base, count(*) FILTER (kind = 'aux') AS rows_in_aux, count(*) FILTER (f) AS rows_out, count(*) FILTER (f AND kind = 'base') AS rows_out_base, count(*) FILTER (f AND kind = 'aux') AS rows_out_aux, count(*) FILTER (NOT f) AS skipped_empty, count(*) FILTER (f AND regexp_matches(t, '(<c\\d+_\\d+>|\\bc\\d+=\\d+)')) AS control_in_tgt FROM r) SELECT *, round(100.0::DOUBLE * control_in_tgt / greatest(rows_out, 1), 4) AS control_pct FROM k",
        "routed_rows": f"{CRC}, {PLANNER.removeprefix('WITH ')}, ro AS (SELECT label, vec_id, ctx_codes, tgt_codes, {_crc(chr(39) + '0|' + chr(39) + ' || label')} < {int(0.5 * 2**32)} AS is_val FROM pl, tb WHERE label IS NOT NULL) SELECT kind, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split, CASE kind WHEN 'dec' THEN vec_id ELSE -1 END AS vec_id, ctx_codes, tgt_codes FROM ro, (SELECT unnest(['lm', 'dec']) AS kind)",
        "array_files": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, len(embedding)::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE)), 5) AS total FROM embeddings",
        "documents_from_json_lines": f"WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id % 10 AS k, * FROM documents) SELECT ord, CASE WHEN k IN (1, 2, 4) THEN ord ELSE doc_id END AS doc_id, CASE WHEN k <> 4 THEN lang END AS title, CASE k WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE length(coalesce(text, '')) END::INT AS chars, CASE WHEN k = 4 THEN 'bad_json' WHEN k = 3 OR {_strip("coalesce(text, '')")} = '' THEN 'empty' WHEN length(text) > 200000 THEN 'too_long' ELSE 'ok' END AS status FROM r",
        "line_corpus": f"SELECT row_number() OVER (ORDER BY doc_id, part) - 1 AS doc, text FROM (SELECT doc_id, part, string_agg(line, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, pos, line, count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM (SELECT doc_id, unnest(range(len(k))) AS pos, {_strip('unnest(k)')} AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS k FROM documents))) WHERE line <> '' GROUP BY ALL)",
    }
