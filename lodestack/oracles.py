"""DuckDB SQL with the results of the registered queries, written independently of them."""

from __future__ import annotations

from .functions import text as X
from .operators.extract import IMAGE_MARKS
from .operators.graph import NOISE_WORDS

BOILER = X.BOILERPLATE
NAMES = "|".join(a.replace(".", r"\.") for a in X.ABBREVIATIONS)
JOIN = rf"(^|[\s\x01])((?:{NAMES}|{X.INITIALS})\.+)\x01"


def clean(c: str) -> str:
    t = rf"regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g')"
    t = rf"regexp_replace({t}, '(?im)^\s*({BOILER})\b.*$', '', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return f"(SELECT CASE WHEN z = '' OR right(z, 1) IN ('.', '?', '!') THEN z ELSE z || '.' END FROM (SELECT {t} AS z))"


#: Letters of the dictionary beyond a-z, each as one byte, as the distances count bytes.
ACCENTED, PLAIN = "áéíóúñüâêôãçà", "0123456789!#$"
#: All pairs of lengths that are near. The distance with free transpositions is a lower bound; where
#: it is 2 and the plain one is more, two letters i, i + 1 must be j + 1, j of the word, and what
#: is before and behind them differ by one edit at most.
NEAREST = f"""
WITH found AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{X.DICTIONARY_WORD}')) AS w FROM documents) WHERE length(w) > 1 GROUP BY 1),
entry AS (SELECT *, translate(word, '{ACCENTED}', '{PLAIN}') AS w FROM found),
asked AS (SELECT DISTINCT lower(w) || 'x' AS token FROM (SELECT unnest(regexp_extract_all(text, '{X.DICTIONARY_WORD}')) AS w FROM benchmark) WHERE length(w) >= 4),
coded AS (SELECT token, translate(token, '{ACCENTED}', '{PLAIN}') AS t FROM asked),
pair AS (SELECT token, t, word, w, n, damerau_levenshtein(t, w) AS free, levenshtein(t, w) AS plain FROM coded JOIN entry ON length(w) - length(t) IN (-2, -1, 0, 1, 2) WHERE damerau_levenshtein(t, w) <= 2),
dist AS (SELECT token, word, n, CASE WHEN free <= 1 THEN free WHEN plain <= 2 THEN 2
 WHEN len(list_filter(range(1, length(t)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND substr(t, i, 1) = substr(w, j + 1, 1) AND substr(t, i + 1, 1) = substr(w, j, 1)
  AND damerau_levenshtein(left(t, i - 1), left(w, j - 1)) + damerau_levenshtein(substr(t, i + 2), substr(w, j + 2)) <= 1)) > 0)) > 0 THEN 2 END AS distance FROM pair)
SELECT token, word, distance::INTEGER AS distance FROM dist WHERE distance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, word) = 1"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def words(c: str) -> str:
    return rf"regexp_extract_all({c}, '\S+')"


def sentence_list(paragraph: str) -> str:
    """Sentences of one paragraph: mark, then take back marks after abbreviations (twice, as
    neighbours share a mark)."""
    m = rf"regexp_replace({strip(paragraph)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    for _ in range(3):
        m = rf"regexp_replace({m}, '(?i){JOIN}', '\1\2 ', 'g')"
    return f"list_filter(string_split({m}, chr(1)), lambda s: s <> '')"


def paragraph_list(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({c}, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '')"


def doc_sentences(c: str) -> str:
    return f"flatten(list_transform({paragraph_list(c)}, lambda p: {sentence_list('p')}))"


def tokens_est(c: str) -> str:
    return f"greatest(1, round_even(len({words(c)}) * 1.3, 0)::INTEGER)"


def clamp(c: str) -> str:
    return f"CASE WHEN {c} IN ('es', 'en', 'pt') THEN {c} ELSE 'es' END"


def chunk_cte(max_words: int = 250, overlap: int = 1) -> str:
    """CTEs up to ``chunk``: doc_id, pos, texto, fuente, idioma."""
    return f"""
corpus AS (SELECT doc_id, source, lang, {clean('text')} AS texto FROM documents),
sent AS (SELECT doc_id, i, s, len({words('s')}) AS w FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, {doc_sentences('texto')} AS l FROM corpus WHERE texto <> ''))),
pref AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM sent),
reach AS (SELECT a.doc_id, a.i - 1 AS s, any_value(a.n) AS n, greatest(a.i, coalesce(max(b.i), 0)) AS e FROM pref a LEFT JOIN pref b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.p - (a.p - a.w) <= {max_words} GROUP BY a.doc_id, a.i),
walk AS (SELECT doc_id, s, e, n, 0 AS pos FROM reach WHERE s = 0
  UNION ALL SELECT r.doc_id, r.s, r.e, r.n, w.pos + 1 FROM walk w JOIN reach r ON r.doc_id = w.doc_id AND r.s = greatest(w.e - {overlap}, w.s + 1) WHERE w.e < w.n),
chunk AS (SELECT w.doc_id, w.pos, {strip("string_agg(x.s, ' ' ORDER BY x.i)")} AS texto, any_value(c.source) AS fuente, any_value({clamp('c.lang')}) AS idioma
  FROM walk w JOIN sent x ON x.doc_id = w.doc_id AND x.i > w.s AND x.i <= w.e JOIN corpus c ON c.doc_id = w.doc_id GROUP BY w.doc_id, w.pos)"""


CHUNK_ID = "format('{}-chunk-{:03d}', doc_id, pos)"
HALVES = """
h AS (SELECT vec_id, label, 0 AS list_no, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings
  UNION ALL SELECT vec_id, label, 1, list_transform(embedding[33:64], lambda x: x::DOUBLE) FROM embeddings),
u AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM h),
sim AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, d.label, d.list_no, round(list_inner_product(q.v, d.v) / (q.n * d.n), 9) AS score FROM u q JOIN u d ON q.list_no = d.list_no WHERE q.vec_id % 20 = 0),
cand AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, item_id) AS rank, score, label::VARCHAR AS doc_id, item_id::VARCHAR AS chunk_id, 'text ' || (item_id - item_id % 3)::VARCHAR AS texto FROM sim QUALIFY rank <= 50)"""
FUSE = """
keyed AS (SELECT *, doc_id || '::' || chunk_id AS k, md5(array_to_string(regexp_extract_all(lower(texto), '\\S+'), ' ')) AS th FROM cand),
canon AS (SELECT *, first_value(k) OVER (PARTITION BY query_id, th ORDER BY list_no, rank) AS key FROM keyed),
grp AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({'l': list_no, 'r': rank, 'd': doc_id, 'c': chunk_id, 't': texto}) AS x FROM canon GROUP BY query_id, key),
fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, x.l, x.r) AS position, score, x.d AS doc_id, x.c AS chunk_id, x.t AS texto FROM grp)"""


def grams(c: str, n: int) -> str:
    w = words(f"lower({c})")
    return w if n == 1 else f"(SELECT list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) FROM (SELECT {w} AS w))"


def hashed(src: str, key: str, text: str, n: int) -> str:
    return f"(SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT % 64 AS b, sum(1 - 2 * (('0x' || substr(md5(g), 9, 1))::BIGINT % 2))::DOUBLE AS x FROM (SELECT {key}, unnest({grams(text, n)}) AS g FROM {src}) GROUP BY ALL)"


CLEAN_Q = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({c}), '[\r\n\t\x00-\x1f\x7f-\x9f]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,?!¿¡\-]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _scored(no: int, n: int, prefix: str) -> str:
    return f"""
qv{no} AS {hashed(f"(SELECT query_id, '{prefix}' || query_text AS t FROM quest)", 'query_id', 't', n)},
cv{no} AS {hashed('ch', 'chunk_id', 'texto', n)},
s{no} AS (SELECT query_id, chunk_id, sum(q.x * c.x) AS dot FROM qv{no} q JOIN cv{no} c USING (b) GROUP BY ALL),
r{no} AS (SELECT a.query_id, c.chunk_id, round(coalesce(s.dot / (sqrt(qn.x) * sqrt(cn.x)), 0), 9) AS score
  FROM quest a CROSS JOIN ch c LEFT JOIN s{no} s ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id
  LEFT JOIN (SELECT query_id, sum(x * x) AS x FROM qv{no} GROUP BY 1) qn ON qn.query_id = a.query_id LEFT JOIN (SELECT chunk_id, sum(x * x) AS x FROM cv{no} GROUP BY 1) cn ON cn.chunk_id = c.chunk_id),
k{no} AS (SELECT query_id, {no} AS list_no, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r{no} QUALIFY rank <= 50)"""


ANSWERS = f"""{chunk_cte()},
quest AS (SELECT format('q{{:05d}}', item_id) AS query_id, {CLEAN_Q.format(c='text')} AS query_text FROM benchmark),
ch AS (SELECT {CHUNK_ID} AS chunk_id, doc_id::VARCHAR AS doc_id, texto FROM chunk),{_scored(0, 1, '')},{_scored(1, 2, 'query: ')},
cand AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id, list_no ORDER BY rank) AS rank, score, doc_id, chunk_id, texto
  FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1) JOIN ch USING (chunk_id) WHERE {strip('texto')} <> '' AND NOT regexp_matches(texto, '[가-힣ㄱ-ㆎ]'))"""


def clip(c: str, n: int) -> str:
    return rf"""(SELECT CASE WHEN len(w) <= {n} THEN t WHEN m <> '' THEN m WHEN right(r, 1) IN ('.', '!', '?') THEN r ELSE r || '.' END
  FROM (SELECT t, w, r, regexp_extract(r, '(?s)^(.*[.!?])(?:\s|$)', 1) AS m FROM (SELECT {c} AS t, {words(c)} AS w, array_to_string({words(c)}[1:{n}], ' ') AS r)))"""


LINES = r"""
line AS (SELECT source, doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS raw FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)),
art AS (SELECT source, regexp_replace(lower(regexp_replace(raw, '\d+', '', 'g')), '^\s+|\s+$', '', 'g') AS line FROM line),
npages AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
rep AS (SELECT source, line, count(*) AS occurrences FROM art JOIN npages USING (source) WHERE length(line) > 4 GROUP BY source, line, pages HAVING count(*) >= greatest(3, floor(pages * 0.3)))"""
KEPT = (
    LINES
    + r""",
kept AS (SELECT source, doc_id, pos, CASE WHEN right(line, 1) IN ('.', '?', '!', ';', ':', ',') THEN line ELSE line || '.' END AS line
  FROM (SELECT source, doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM line) x
  WHERE line <> '' AND NOT regexp_matches(line, '(?i)^(p[áa]gina\s+\d+|page\s+\d+)')
  AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.source = x.source AND rep.line = lower(regexp_replace(x.line, '\d+', '', 'g'))))"""
)

ENT = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*"
GRAPH = rf"""
uc AS (SELECT doc_id, coalesce(text, '') AS texto, source FROM documents),
sn AS (SELECT doc_id, unnest(range(0, len(l))) AS sent, unnest(l) AS s FROM (SELECT doc_id, {doc_sentences('texto')} AS l FROM uc WHERE length({strip('texto')}) >= 10)),
en AS (SELECT doc_id, doc_id::VARCHAR || '-chunk-000' AS chunk_id, sent, regexp_extract_all(s, '{ENT}') AS ents,
  left(CASE WHEN len(v) = 0 THEN 'relacionado_con' ELSE array_to_string(v[1:2], '_') END, 40) AS relation FROM (SELECT *, list_filter({words("regexp_replace(lower(s), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')")}, lambda w: regexp_full_match(w, 'is|are|was|were|has|have|had|be|es|son|fue|está|tiene|ha|é|foi|tem|.*\p{{Ll}}(?:ed|ing|aron|ieron|ando|iendo)')) AS v FROM sn)),
tr AS (SELECT ents[i] AS sujeto, CASE WHEN contains(ents[i], ' ') THEN 'MULTI' ELSE 'MISC' END AS tipo_sujeto, relation AS relacion, ents[i + 1] AS objeto, CASE WHEN contains(ents[i + 1], ' ') THEN 'MULTI' ELSE 'MISC' END AS tipo_objeto, chunk_id, doc_id::VARCHAR AS doc_id, 1::INTEGER AS fenomeno, {{'a': chunk_id, 'b': sent, 'c': i}} AS ord
  FROM (SELECT *, unnest(range(1, len(ents))) AS i FROM en) WHERE lower(ents[i]) <> lower(ents[i + 1])),
nd AS (SELECT id, arg_min(kind, {{'o': ord, 's': side}}) AS entity_type, min({{'o': ord, 's': side}}) AS seen FROM (SELECT sujeto AS id, tipo_sujeto AS kind, ord, 0 AS side FROM tr UNION ALL SELECT objeto, tipo_objeto, ord, 1 FROM tr) GROUP BY id),
ed AS (SELECT sujeto AS src, objeto AS dst, arg_min(relacion, ord) AS relation, arg_min(doc_id, ord) AS doc_id, list(chunk_id ORDER BY ord) AS all_ids FROM tr GROUP BY 1, 2)"""
LOOK = "lk AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY seen) AS rank FROM nd, (VALUES ('the'), ('and'), ('Ist'), ('que'), ('ou')) q(query) WHERE contains(lower(id), lower(query)) QUALIFY rank <= 5)"
CENT = """
lc AS (SELECT label, i, round(avg(x), 9) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings) GROUP BY 1, 2),
ce AS (SELECT label, list(m ORDER BY i) AS c FROM lc GROUP BY 1),
ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
en AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM ev),
ca AS (SELECT vec_id, label AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(list_transform(v, lambda x: x / n), c), 9) DESC, label) AS r FROM en, ce)"""
FLAT = """
ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
en AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM ev)"""


def rule(lang: str) -> str:
    return f"len(list_filter({words('lower(left(text, 2000))')}, lambda w: w IN {X.FUNCTION_WORDS[lang]!r}))"


def oracle_sql() -> dict[str, str]:
    article = r"""
      SELECT conv_id, array_to_string(list_concat(CASE WHEN conv_id % 2 = 0 THEN ['Conversation ' || conv_id || '.'] ELSE [] END, parts, [roles], ['Source: https://example.org/' || conv_id || '.']), ' ') AS raw_text
      FROM (SELECT conv_id, flatten(list(CASE WHEN coalesce(role, '') <> '' THEN [""" + strip("role") + r""" || '.', t] ELSE [t] END ORDER BY turn)) AS parts,
        array_to_string(list_transform(list_sort(list(DISTINCT role)), lambda r: r || '.'), ' ') AS roles
        FROM (SELECT conv_id, turn, role, """ + strip("text") + r""" AS t FROM conversations) GROUP BY conv_id)"""
    return {
        "clean_text": f"SELECT doc_id, {clean('text')} AS texto FROM documents",
        "word_count": f"SELECT doc_id, len({words('text')})::INTEGER AS total_palabras FROM documents",
        "text_hash_dedup": f"SELECT md5(array_to_string({words('lower(text)')}, ' ')) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "clip_text": f"SELECT doc_id, {clip('text', 250)} AS clipped FROM documents",
        "paragraphs": rf"SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, {paragraph_list('t')} AS l FROM (SELECT doc_id, regexp_replace(text, '([^\n]*\n[^\n]*\n[^\n]*)\n', '\1' || chr(10) || ' ' || chr(10), 'g') AS t FROM documents))",
        "sentences": f"SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {doc_sentences('text')} AS l FROM documents)",
        "spelling_dictionary": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{X.DICTIONARY_WORD}')) AS word FROM documents) WHERE length(word) > 1 GROUP BY 1",
        "spell_nearest": NEAREST,
        "doc_contract": f"SELECT md5(t) AS texto_md5, len({words('t')})::INTEGER AS total_palabras, coalesce(CASE WHEN doc_id % 3 <> 0 THEN nullif(source, '') END, 'sin_atributo_especifico') AS atributo_adicional, source || '.html' AS fuente, 'html' AS tipo_fuente, {clamp('lang')} AS idioma, doc_id::VARCHAR AS doc_id, '1' AS Fenomeno FROM (SELECT *, {clean('text')} AS t FROM documents) WHERE t <> ''",
        "language_fallback": f"SELECT {clamp('lang')} AS idioma, count(*) AS n FROM documents GROUP BY 1",
        "language_rule": f"SELECT doc_id, CASE WHEN e > s AND e >= p THEN 'en' WHEN p > s AND p > e THEN 'pt' ELSE 'es' END AS idioma FROM (SELECT doc_id, {rule('es')} AS s, {rule('en')} AS e, {rule('pt')} AS p FROM documents)",
        "csv_row_sentences": "SELECT c_custkey, concat_ws(' | ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_nationkey: ' || c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN 'c_mktsegment: ' || c_mktsegment END) || '.' AS sentence FROM customer",
        "csv_document": "SELECT n_regionkey, string_agg('n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey || '.', ' ' ORDER BY n_nationkey) AS raw_text, 'total_filas_consolidadas_' || count(*) AS atributo_adicional FROM nation GROUP BY 1",
        "table_row_sentences": "SELECT s_suppkey, concat_ws(' | ', 'llave: ' || s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN 'Columna_2: ' || s_name END, 'na ción: ' || s_nationkey, 'Columna_4: x ' || s_name) || '.' AS sentence FROM supplier",
        "json_article": article,
        "json_props": f"SELECT key, count(*) AS n FROM (SELECT unnest(list_concat(json_keys(props), ['format', 'page_link_url'])) AS key FROM events) WHERE contains(lower(key), 'link') OR NOT regexp_matches(lower(key), '{'|'.join(IMAGE_MARKS)}') GROUP BY 1",
        "repeated_lines": f"WITH {LINES} SELECT * FROM rep",
        "line_filter": f"WITH {KEPT} SELECT source, doc_id, pos::INTEGER AS pos, line FROM kept",
        "paged_document": rf"WITH {KEPT}, al AS (SELECT source, doc_id, 10 AS y, pos, line FROM kept UNION ALL SELECT source, doc_id, 5, 0, 'página: ' || doc_id || ' | Columna_2: ' || lang || '.' FROM documents), j AS (SELECT source, {strip(r"regexp_replace(string_agg(line, ' ' ORDER BY doc_id, y, pos), '\s+', ' ', 'g')")} AS t FROM al GROUP BY 1) SELECT source AS doc_id, length(t)::INTEGER AS n_chars, md5(t) AS raw_md5 FROM j",
        "html_title": r"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title') THEN replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') ELSE 'html_sin_titulo' END AS title FROM pages",
        "geo_feature_text": "SELECT s_suppkey, 'suppliers - Registro Geográfico: ' || CASE WHEN s_suppkey % 4 = 0 THEN 'Ubicación no especificada' ELSE n_name END || '. ' || CASE s_suppkey % 3 WHEN 0 THEN 'Punto de interés espacial ubicado en las coordenadas: latitud -7.5, longitud ' || round_even(s_suppkey / 8, 4) || '.' WHEN 1 THEN 'Delimitación espacial estructurada como Polygon. Esta área geográfica está definida por un polígono cerrado compuesto por aproximadamente 2 nodos topológicos.' ELSE 'Estructura lineal geográfica de tipo LineString, trazada a través de 2 puntos de referencia.' END || ' ' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'au_country: ' || n_name || ' | ' END || 's_name: ' || s_name || '. Información Detallada (notes_a): in ' || n_name || '.' AS raw_text, s_suppkey::VARCHAR AS doc_id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "incremental_skip": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "document_chunks": f"WITH RECURSIVE {chunk_cte()} SELECT doc_id::VARCHAR AS doc_id, {CHUNK_ID} AS chunk_id, fuente, 'pdf' AS formato, 1::INTEGER AS fenomeno, pos::INTEGER AS posicion, {tokens_est('texto')}::INTEGER AS num_tokens, idioma, md5(texto) AS texto_md5 FROM chunk",
        "chunk_overlap_two": f"WITH RECURSIVE {chunk_cte(60, 2)} SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_chunks, sum({tokens_est('texto')})::BIGINT AS tokens FROM chunk GROUP BY 1",
        "chunk_token_estimate": f"SELECT doc_id, {tokens_est('text')}::INTEGER AS num_tokens FROM documents",
        "chunk_fanout": f"WITH RECURSIVE {chunk_cte()} SELECT encoder, count(*) AS n_chunks, sum({tokens_est('texto')})::BIGINT AS tokens FROM chunk, (VALUES ('bge-m3'), ('e5-large')) e(encoder) GROUP BY 1",
        "l2_normalized": "SELECT vec_id, list_transform(list_transform(v, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)), lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE x END) AS unit FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label % 3)) AS v FROM embeddings))",
        "knn_flat_topk": f"WITH {FLAT}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_inner_product(q.v, d.v) / (q.n * d.n), 9) AS score FROM en q, en d WHERE q.vec_id % 20 = 0) SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 50",
        "knn_l2_topk": f"WITH {FLAT}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(1 / (1 + list_inner_product(list_transform(list_zip(q.v, d.v), lambda p: p[1] - p[2]), list_transform(list_zip(q.v, d.v), lambda p: p[1] - p[2]))), 9) AS score FROM en q, en d WHERE q.vec_id % 20 = 0) SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10",
        "l2_scores": "SELECT vec_id, round(1 / (1 + list_inner_product(list_transform(embedding, lambda x: x::DOUBLE - 0.5), list_transform(embedding, lambda x: x::DOUBLE - 0.5))), 9) AS score FROM embeddings",
        "rrf_fused_topk": f"WITH {HALVES}, {FUSE} SELECT query_id, position::INTEGER AS position, score, doc_id, chunk_id FROM fused WHERE position <= 20",
        "single_encoder_dedup": f"WITH {HALVES}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, texto ORDER BY rank) AS n FROM cand WHERE list_no = 0) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS position, round(score, 6) AS score, doc_id, chunk_id FROM o WHERE n = 1",
        "doc_max_pool": f"WITH {HALVES}, b AS (SELECT query_id, doc_id, max(score) AS score FROM cand WHERE list_no = 0 GROUP BY 1, 2) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, round(score, 6) AS score FROM b QUALIFY rank <= 3",
        "ivf_assign": f"WITH {CENT} SELECT vec_id, cell FROM ca WHERE r = 1",
        "ivf_search": f"WITH {CENT}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_inner_product(q.v, d.v) / (q.n * d.n), 9) AS score FROM en q JOIN ca x ON x.vec_id = q.vec_id AND x.r <= 2 JOIN ca y ON y.cell = x.cell AND y.r = 1 JOIN en d ON d.vec_id = y.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10",
        "query_preprocess": "SELECT format('q{:05d}', item_id) AS query_id, " + CLEAN_Q.format(c="('  ¿¿Cafe' || chr(769) || ' ' || text || ' ' || chr(10) || chr(9) || ' *#')") + " AS cleaned FROM benchmark",
        "acronym_guard": rf"SELECT doc_id, len(list_filter({words('text')}, lambda w: length(w) > 1 AND regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}'))) > 0 AS has_acronym FROM documents",
        "candidate_filter": f"WITH RECURSIVE {ANSWERS} SELECT query_id, list_no, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM cand",
        "response_fragments": f"WITH RECURSIVE {ANSWERS}, {FUSE} SELECT query_id, position::INTEGER AS rank, chunk_id, doc_id, md5({clip('texto', 40)}) AS text_md5 FROM fused WHERE position <= 10",
        "response_documents": f"WITH RECURSIVE {ANSWERS}, {FUSE} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY p))::INTEGER AS rank, doc_id FROM (SELECT query_id, doc_id, min(position) AS p FROM fused GROUP BY 1, 2) QUALIFY rank <= 3",
        "results_by_query": f"WITH RECURSIVE {ANSWERS}, {FUSE}, f AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY position) AS fragments FROM fused WHERE position <= 10 GROUP BY 1), d AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY p) AS documents FROM (SELECT query_id, doc_id, min(position) AS p FROM fused GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= 3) GROUP BY 1) SELECT query_id, documents, fragments FROM f JOIN d USING (query_id) ORDER BY 1",
        "metadata_dedup": "SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR || '-chunk-000' AS chunk_id, source AS fuente, 1::INTEGER AS fenomeno, md5(text) AS texto_md5 FROM documents",
        "entities": f"WITH {GRAPH} SELECT chunk_id, sent::INTEGER AS sent, array_to_string(ents, '|') AS entities, relation FROM en",
        "triples": f"WITH {GRAPH} SELECT * EXCLUDE (ord) FROM tr",
        "graph_nodes": f"WITH {GRAPH} SELECT id, 'Entidad' AS label, entity_type FROM nd",
        "graph_edges": f"WITH {GRAPH} SELECT src, dst, relation, array_to_string(list_distinct_ordered, ',') AS chunk_id, doc_id, 1::INTEGER AS fenomeno FROM (SELECT *, list_filter(all_ids, lambda x, i: list_position(all_ids, x) = i) AS list_distinct_ordered FROM ed)",
        "graph_checks": f"WITH {GRAPH} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, 0::BIGINT AS incomplete",
        "noise_ratio": f"WITH {GRAPH}, x AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE length(id) <= 1 OR lower(id) IN {NOISE_WORDS!r}) AS noise FROM nd) SELECT nodes, noise, round(noise / nodes, 6) AS ratio FROM x",
        "degree_top15": f"WITH {GRAPH} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1 ORDER BY degree DESC, id LIMIT 15",
        "entity_lookup": f"WITH {GRAPH}, {LOOK} SELECT query, rank::INTEGER AS rank, id FROM lk",
        "one_hop_chunks": f"WITH {GRAPH}, {LOOK} SELECT DISTINCT query, unnest(all_ids) AS chunk_id FROM lk JOIN ed ON ed.src = lk.id",
        "stream_ingest_counts": f"WITH RECURSIVE {chunk_cte()} SELECT fuente, count(*) AS n_chunks, sum({tokens_est('texto')})::BIGINT AS tokens FROM chunk GROUP BY 1",
        "article_documents": f"SELECT conv_id || '/' || turn AS path, conv_id::VARCHAR AS doc_id, 'Turn ' || turn AS title, 'Turn ' || turn || '. ' || {strip('text')} || ' ' || role || ': https://example.org.' AS raw_text, role, 'format,role' AS keys FROM conversations",
        "consecutive_gap": f"SELECT doc_id, i::INTEGER AS pos, w::INTEGER AS words, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT doc_id, i, len({words('s')}) AS w FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, {doc_sentences('text')} AS l FROM documents)))",
    }
