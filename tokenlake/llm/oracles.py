"""DuckDB SQL of the operators whose whole result SQL can express, over whole tables.

Each statement states the operator's definition directly, by windows over single words or bytes, and
shares nothing with the method that the operator uses. Row ids are taken to be distinct and not null,
as in the tables; tests against brute force hold the other cases.
"""

_WORDS = r"""
words AS (
  SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS list FROM documents)
)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH {_WORDS.format(text="coalesce(text, '')")}, windows AS (
  SELECT *, string_agg(word, ' ') OVER span AS seq, count(*) OVER span = 50 AS whole FROM words
  WINDOW span AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), firsts AS (
  SELECT seq, min(doc_id) AS least FROM windows WHERE whole GROUP BY seq
), judged AS (
  SELECT windows.doc_id, pos, word, coalesce(whole AND windows.doc_id > least, false) AS hit FROM windows LEFT JOIN firsts USING (seq)
), marked AS (
  SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged
)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked ON d.doc_id = marked.doc_id GROUP BY d.doc_id
"""

#: Texts as hexadecimal digits are cut into pieces of 1024 bytes and 199 beyond, so that taking one string never walks a whole text.
SUFFIX_DEDUP = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), pieces AS (
  SELECT doc_id, base, substr(x, 2 * base + 1, 2 * 1223) AS y FROM (SELECT *, unnest(range(0, length(x) // 2, 1024)) AS base FROM texts)
), strings AS MATERIALIZED (
  SELECT doc_id, base + i AS pos, substr(y, 2 * i + 1, 2) AS byte, CASE WHEN length(y) >= 2 * (i + 200) THEN md5_number(substr(y, 2 * i + 1, 400)) END AS s
  FROM (SELECT *, unnest(range(0, least(1024, length(y) // 2))) AS i FROM pieces)
), twice AS (
  SELECT s FROM strings WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1
), judged AS (
  SELECT doc_id, pos, byte, twice.s IS NOT NULL AS hit FROM strings LEFT JOIN twice ON strings.s = twice.s
), marked AS (
  SELECT doc_id, pos, byte, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM judged
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked
)
SELECT d.doc_id, count(byte) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM documents d LEFT JOIN runs ON d.doc_id = runs.doc_id GROUP BY d.doc_id
"""

_SPANS = "\n), ".join(
    f"""w{n} AS (
  SELECT doc_id, pos, word, CASE WHEN count(*) OVER span = {n} THEN string_agg(word, ' ') OVER span END AS seq FROM words
  WINDOW span AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)
), c{n} AS (
  SELECT doc_id, pos, word, seq IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, seq ORDER BY pos) > 1 AS later,
         seq IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, seq) > 1 AS twice FROM w{n}
), i{n} AS (
  SELECT doc_id, word, max(later) OVER span AS later, max(twice) OVER span AS twice FROM c{n}
  WINDOW span AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
), g{n} AS (
  SELECT doc_id, {n} AS n, sum(length(word)) FILTER (WHERE later) AS inside, count(*) FILTER (WHERE twice) AS repeated FROM i{n} GROUP BY doc_id"""
    for n in range(5, 11)
)

REPETITION_QUALITY = f"""
WITH {_WORDS.format(text="coalesce(text, '')")}, sizes AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id
), {_SPANS}
), shares AS (
  SELECT doc_id, n, coalesce(inside, 0) / word_chars AS share, repeated
  FROM ({" UNION ALL ".join(f"SELECT * FROM g{n}" for n in range(5, 11))}) JOIN sizes USING (doc_id)
), windows AS (
  SELECT doc_id, max(share) AS share, max(repeated) FILTER (WHERE n = 5) AS repeated,
         max(share > CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END::DOUBLE) AS over
  FROM shares GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS list FROM documents)
), repeated_lines AS (
  SELECT doc_id, count(*) AS n, sum(length(line)) AS chars FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  ) WHERE nth > 1 GROUP BY doc_id
), figures AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words, coalesce(share, 0)::DOUBLE AS dup_ngram_chars,
         (coalesce(l.chars, 0) / greatest(length(coalesce(text, '')), 1))::DOUBLE AS dup_line_chars, coalesce(over, false) AS over
  FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN windows w ON w.doc_id = d.doc_id LEFT JOIN repeated_lines l ON l.doc_id = d.doc_id
)
SELECT * EXCLUDE (over), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR over OR dup_line_chars > 0.20::DOUBLE) AS kept
FROM figures
"""

def _linked(shingle: int, percent: int, last: str) -> str:
    return f"""
WITH RECURSIVE {_WORDS.format(text=_LOWER)}, windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER span AS seq, count(*) OVER span AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM words
  WINDOW span AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {shingle - 1} FOLLOWING)
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(seq) AS s FROM windows WHERE n = {shingle} OR (pos = 1 AND total < {shingle})
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= {percent} * (a.n + b.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id{last}
FROM components c LEFT JOIN sizes ON sizes.doc_id = c.doc_id
"""


NEAR_DEDUP = _linked(5, 75, ", c.doc_id = component_id AS kept")
JACCARD_JOIN = _linked(3, 90, "")

PHRASE_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT doc_id, lang, generate_subscripts(list, 1) AS piece, unnest(list) AS y
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS list FROM documents)
), words AS (
  SELECT doc_id, lang, piece, generate_subscripts(list, 1) AS pos, unnest(list) AS w
  FROM (SELECT *, regexp_extract_all(y, '[^\x20\x09]+') AS list FROM pieces)
), next AS (
  SELECT lang, w AS w1, lead(w, 1) OVER span AS w2, lead(w, 2) OVER span AS w3 FROM words
  WINDOW span AS (PARTITION BY doc_id, lang, piece ORDER BY pos)
), sizes AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), one AS MATERIALIZED (
  SELECT lang, w1, count(*) AS f FROM next GROUP BY ALL HAVING count(*) >= 10
), two AS MATERIALIZED (
  SELECT lang, w1, w2, count(*) AS f FROM next WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), three AS MATERIALIZED (
  SELECT lang, w1, w2, w3, count(*) AS f FROM next WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN longer z ON z.lang = t.lang AND z.w1 = t.w1 AND z.w2 = t.w2 WHERE z.f IS NULL OR 100 * z.f < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

#: crc32 byte by byte: the table has the remainder of each byte value.
SPELLING_VARIANTS = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM runs, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.less = b.less AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS n FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), follow(word, tip) AS (
  SELECT word, word FROM formed UNION ALL SELECT follow.word, form FROM follow JOIN formed ON formed.word = tip WHERE form IS NOT NULL
)
SELECT f.word, f.form, tip AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN follow USING (word) JOIN formed e ON e.word = tip AND e.form IS NULL
"""
