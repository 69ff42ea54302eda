"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import licenses, mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"


def near_dedup(width: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {width - 1}], ' ') for i in range(1, len(w) - {width} + 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM s),
r AS (SELECT min(doc_id) AS doc_id, h FROM n WHERE n > 0 GROUP BY h),
e AS (SELECT s.doc_id, n.n, unnest(s.s) AS g FROM s JOIN r ON s.doc_id = r.doc_id JOIN n ON n.doc_id = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS t, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= {percent} * (t - i)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM r UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
c AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.component, n.doc_id) AS component_id, coalesce(c.component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN r ON n.h = r.h AND n.n > 0 LEFT JOIN c ON c.doc_id = r.doc_id"""


def raking(keep: float = mixing.KEEP, rounds: int = mixing.ROUNDS) -> str:
    shown = lambda c: f"coalesce(CASE WHEN regexp_full_match({c}, '\\\\*\\(none\\)') THEN chr(92) || {c} ELSE {c} END, '(none)')"
    count = lambda signs: f"(length(t) - length(regexp_replace(t, '{signs}', '', 'g')))"
    sql = f"""
WITH d0 AS (SELECT doc_id, {shown("source")} AS source, {shown("lang")} AS lang, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS tokens FROM documents),
d AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN {count("[|]")} * 10 > tokens THEN 'table' WHEN {count("[#*$%&]")} * 10 > tokens THEN 'symbols'
  WHEN {count("[A-Z]")} > 3 * tokens THEN 'capitals' WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM d0),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT sum(tokens) AS total FROM cells)"""
    for d in mixing.DIMENSIONS:
        sql += f""",
t_{d} AS (SELECT {d}, pow(sum(tokens), {mixing.TEMPER}) AS x FROM cells GROUP BY {d}), s_{d} AS (SELECT {d}, x / (SELECT sum(x) FROM t_{d}) AS t{d} FROM t_{d})"""
    sql += f""",
k0 AS (SELECT cells.*, tsource, tlang, ttopic, (SELECT total FROM total) * {keep} AS goal, tokens * {keep} AS w FROM cells JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic))"""
    k = 0
    for _ in range(rounds):
        for d in mixing.DIMENSIONS:
            sql += f""",
k{k + 1} AS (SELECT * EXCLUDE (w, have), least(tokens, CASE WHEN have > 0 THEN w * (goal * t{d} / have) ELSE 0 END) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {d}) AS have FROM k{k}))"""
            k += 1
    draw = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / pow(16.0, 13)"
    return (
        sql
        + f""",
p AS (SELECT source, lang, topic, w / tokens AS p FROM k{k})
SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(p, 1.0), 6) AS probability, {draw} < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )


def licence_scan() -> str:
    quote = lambda s: "'" + s + "'"
    templates = ", ".join(f"({t}, {quote(label)}, [{', '.join(map(quote, notice.split()))}], [{', '.join(map(str, licenses.needed_places(notice, keys)))}])" for t, (label, notice, keys) in enumerate(licenses.TEMPLATES))
    base = ", ".join(f"([{', '.join(map(quote, p.split()))}], {quote(label)})" for p, label in licenses.BASE.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
template(template, label, words, need) AS (VALUES {templates}),
posting AS (SELECT template, unnest(words) AS word, unnest(range(len(words))) AS at FROM template),
phrase(words, label) AS (VALUES {base}),
spot AS (SELECT doc_id, word, CAST(place AS BIGINT) AS place FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM w) WHERE word IN (SELECT word FROM posting)),
hit AS (SELECT s.doc_id, s.place, p.label FROM phrase p JOIN spot s ON s.word = p.words[1] JOIN w ON w.doc_id = s.doc_id WHERE w.w[s.place + 1:s.place + len(p.words)] = p.words),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base_labels FROM hit GROUP BY doc_id),
aligned AS (SELECT s.doc_id, p.template, s.place - p.at AS shift, list(DISTINCT p.at) AS got FROM spot s JOIN posting p ON p.word = s.word GROUP BY ALL),
found AS (
  SELECT a.doc_id, list_distinct(list(t.label)) AS more, max(round(len(a.got) / len(t.words), 6)) AS score FROM aligned a JOIN template t ON t.template = a.template
  WHERE len(a.got) >= {licenses.LEAST} * len(t.words) AND list_has_all(a.got, t.need) GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN found ON found.doc_id = w.doc_id"""


def near_vectors(threshold: float = 0.98) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def _crc_table() -> str:
    """CTEs up to ``crc(tab)``: the 256 remainders of the reflected polynomial 0xEDB88320, by its rule."""
    steps = "c0 AS (SELECT i, i AS c FROM range(256) t(i))"
    for k in range(8):
        steps += f", c{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})"
    return steps + ", crc AS (SELECT list(c ORDER BY i) AS tab FROM c8)"


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside ``crc``."""
    given = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {given}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


def spelling_variants() -> str:
    return f"""
WITH RECURSIVE {_crc_table()},
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
seen AS (SELECT doc_id, w, count(*) AS n FROM run GROUP BY ALL),
hashed AS (SELECT w, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM seen, crc),
lost AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, place, substr(word, 1, CAST(place AS INT)) || substr(word, CAST(place AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS place FROM v)),
pair AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS most FROM pair GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN near END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
up(word, here) AS (SELECT word, word FROM formed UNION SELECT up.word, formed.form FROM up JOIN formed ON formed.word = up.here WHERE formed.form IS NOT NULL),
top AS (SELECT up.word, up.here AS root FROM up JOIN formed ON formed.word = up.here WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN top ON top.word = formed.word"""


def importance_draw(buckets: int = 10_000, least: int = 20, share: int = 25, seed: int = 7) -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH {_crc_table()},
w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all({_LOWERED}, {word}) AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWERED}, {word}) FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM w),
g AS (SELECT gram, {_crc("gram")} % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM f), crc),
n AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN g USING (gram) GROUP BY ALL),
m AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS t FROM n GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM m),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (big_s + {buckets}) AS DOUBLE) / CAST((s + 1) * (big_t + {buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM m, total),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(gain * n) AS BIGINT) AS total FROM n JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
x AS (
  SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total / n_features) AS BIGINT), 0) AS weight,
    CAST(('0x' || substr(sha256('{seed}:' || w.id), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN d ON d.id = w.id WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= {least})
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * {share} // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id"""
