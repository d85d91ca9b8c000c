"""DuckDB SQL for the queries that SQL can express."""

from . import chat, licenses

SQL: dict[str, str] = {}

SQL["op1_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM totals
), pour(step, source, full_at, weight, is_full, level) AS (  -- each step fills what the last level would overfill
  SELECT 0, source, 3.0::DOUBLE * source_size, weight, FALSE,
         sum(CAST(source_size AS DOUBLE)) OVER () / sum(weight) OVER () FROM weighed
  UNION ALL
  SELECT step + 1, source, full_at, weight, now_full,
         (SELECT sum(CAST(source_size AS DOUBLE)) FROM weighed)
         - coalesce(sum(CASE WHEN now_full THEN full_at END) OVER (), 0) + 0 * level
  FROM (SELECT *, is_full OR full_at <= weight * level AS now_full FROM (
          SELECT step, source, full_at, weight, is_full,
                 CASE WHEN step = 0 THEN level ELSE level / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS level FROM pour))
  WHERE step < 60
), settled AS (
  SELECT source, full_at, weight, is_full, level AS water,
         sum(CASE WHEN NOT is_full THEN weight END) OVER () AS share FROM pour WHERE step = 60
), aims AS (
  SELECT w.source, w.source_size, CASE WHEN s.is_full THEN s.full_at ELSE s.weight * s.water / s.share END AS target
  FROM weighed w JOIN settled s ON w.source IS NOT DISTINCT FROM s.source
), laid AS (
  SELECT d.doc_id, d.source, d.size, a.source_size, a.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 2), d.doc_id NULLS FIRST) AS k,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
), mixed AS (
  SELECT *, CAST(least(floor(k * rate + shift) - floor((k - 1) * rate + shift), 3) AS BIGINT) AS copies FROM laid
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed
"""

SQL["op9_topk"] = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def _licenses() -> str:
    """Every window of every text that holds enough of a template's words."""
    templates = ", ".join(f"('{label}', '{text}', {licenses.width(text)})" for label, text in licenses.TEMPLATES)
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE)
    return rf"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), worded AS (
  SELECT doc_id, body, regexp_extract_all(body, '{licenses.LOWER}') AS words FROM lowered
), phrases AS (
  SELECT string_split(p, ' ') AS parts, label FROM (VALUES {phrases}) x(p, label)
), begun AS (
  SELECT doc_id, words, unnest(range(len(words))) AS i FROM worded WHERE contains(body, 'license')
), hits AS (
  SELECT doc_id, i, label FROM begun JOIN phrases ON words[i + 1] = parts[1] AND words[i + 1 : i + len(parts)] = parts
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base_list FROM hits GROUP BY doc_id
), templates AS (
  SELECT label, list_distinct(string_split(t, ' ')) AS need, width FROM (VALUES {templates}) x(label, t, width)
), windows AS (
  SELECT doc_id, label, need, words, width, unnest(range(greatest(len(words) - width, 0) + 1)) AS i
  FROM worded JOIN templates ON len(list_intersect(need, words)) >= ceil({licenses.THRESHOLD} * len(need) - 1e-9)  -- no window holds more than its text
), counted AS (
  SELECT doc_id, label, len(need) AS size, max(len(list_intersect(need, words[i + 1 : i + width]))) AS shared FROM windows GROUP BY doc_id, label, len(need)
), met AS (
  SELECT doc_id, list(DISTINCT label) AS method, max(CAST(shared AS DOUBLE) / size) AS share FROM counted WHERE shared >= ceil({licenses.THRESHOLD} * size - 1e-9) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base_list), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(method, [])))), ','), '') AS labels,
       coalesce(share, 0.0) AS score
FROM worded w LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""


SQL["op7_licenses"] = _licenses()


def _chat(source: str) -> str:
    """Threads of the messages of ``source``, of one row for each turn."""
    blanks = r"[\x01\x02\x09-\x0D\x20]+"
    return rf"""
WITH {source}, numbered AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM messages
), lines AS (
  SELECT rid, conv_id, turn, unnest(string_split_regex(text, '\r?\n')) AS line, unnest(range(len(string_split_regex(text, '\r?\n')))) AS i
  FROM numbered WHERE text IS NOT NULL
), parsed AS (
  SELECT rid, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '')), '{blanks}', ' ', 'g')) AS bare
  FROM lines
), broken AS (
  SELECT *, CASE WHEN bare = '' THEN 0 WHEN lag(level) OVER w IS DISTINCT FROM level OR lag(bare) OVER w = '' THEN 1 ELSE 0 END AS new
  FROM parsed WINDOW w AS (PARTITION BY rid ORDER BY i)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM broken
), passages AS (
  SELECT rid, conv_id, turn, run, level, string_agg(bare, ' ' ORDER BY i) AS body, list(DISTINCT bare) AS held, count(*) AS n FROM runs
  WHERE bare <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, run, level
), owners AS (
  SELECT conv_id, body, min(turn) AS owner FROM (
    SELECT conv_id, turn, body FROM passages WHERE level = 0 UNION ALL
    SELECT conv_id, turn, bare FROM parsed WHERE level = 0 AND bare <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id, body
), sought AS (
  SELECT rid, conv_id, turn, run, level, TRUE AS whole, body FROM passages WHERE level > 0 UNION ALL
  SELECT rid, conv_id, turn, run, level, FALSE, unnest(held) FROM passages WHERE level > 0 AND n > 1
), linked AS (
  SELECT s.conv_id, s.turn, s.level, coalesce(max(owner) FILTER (WHERE whole AND owner < s.turn), max(owner) FILTER (WHERE owner < s.turn)) AS owner
  FROM sought s LEFT JOIN owners o ON s.conv_id = o.conv_id AND s.body = o.body GROUP BY s.rid, s.conv_id, s.turn, s.run, s.level
), replies AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(owner) AS n_linked, min_by(owner, (level, -owner)) FILTER (WHERE owner IS NOT NULL) AS quoted FROM linked GROUP BY conv_id, turn
), turns AS (
  SELECT t.conv_id, t.turn, lag(t.turn) OVER w AS before, row_number() OVER w AS nth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, quoted
  FROM (SELECT DISTINCT conv_id, turn FROM numbered WHERE conv_id IS NOT NULL AND turn IS NOT NULL) t LEFT JOIN replies r ON t.conv_id = r.conv_id AND t.turn = r.turn WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.turn)
), begun AS (
  SELECT *, max(CASE WHEN before IS NULL OR quoted <> before THEN turn END) OVER w AS thread, max(CASE WHEN before IS NULL OR quoted <> before THEN nth END) OVER w AS thread_nth
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
), laid AS (SELECT *, (nth - thread_nth) // {chat.PART} AS part, coalesce(quoted, before) AS reply_to FROM begun),
about AS (
  SELECT conv_id, thread, part, first(reply_to ORDER BY turn) AS reply_to, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(sum(n_linked) AS BIGINT) AS n_linked
  FROM laid GROUP BY conv_id, thread, part
), bodies AS (
  SELECT rid, rtrim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^[\x09-\x0D\x20]*\n', ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM parsed GROUP BY rid
), said AS (
  SELECT DISTINCT n.conv_id, n.turn, coalesce(n.role, 'user') AS role, coalesce(b.body, '') AS body, n.conv_id IS NULL OR n.turn IS NULL AS alone, CASE WHEN n.conv_id IS NULL OR n.turn IS NULL THEN n.rid END AS rid
  FROM numbered n LEFT JOIN bodies b USING (rid)
), written AS (SELECT *, '<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10) AS line FROM said)
SELECT a.conv_id, a.thread, CAST(a.part AS BIGINT) AS part, 0::BIGINT AS share, a.reply_to, a.first_turn, a.last_turn, x.n_messages, a.n_quotes, a.n_linked, x.text
FROM about a JOIN (
  SELECT l.conv_id, l.thread, l.part, count(*) AS n_messages, string_agg(w.line, '' ORDER BY w.turn, w.role, w.body) AS text
  FROM laid l JOIN written w ON l.conv_id = w.conv_id AND l.turn = w.turn GROUP BY l.conv_id, l.thread, l.part) x ON a.conv_id = x.conv_id AND a.thread = x.thread AND a.part = x.part
UNION ALL SELECT conv_id, NULL, 0, 0, NULL, turn, turn, 1, 0, 0, line FROM written WHERE alone
"""


#: Every message as it stands.
PLAIN = "messages AS (SELECT conv_id, turn, role, text FROM conversations)"

#: The same messages with quotes: a third quote all lines of the turn before, a third the last line of two turns before, with that turn's own mark, and the rest nothing.
QUOTING = r"""marked AS (
  SELECT conv_id, turn, role, text, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), messages AS (
  SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 AND one IS NOT NULL THEN '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) || text
    WHEN (conv_id + turn) % 3 = 1 AND two IS NOT NULL THEN '> > ' || string_split(two, chr(10))[-1] || chr(10) || chr(10) || text ELSE text END AS text FROM marked
)"""

SQL["op8_chat"] = _chat(PLAIN)
SQL["quoted_conversations"] = _chat(QUOTING)


def _lloyd(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Every round written out: all distances, the nearest centroid, floors of means."""
    parts = [rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT k.rid, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k CROSS JOIN c{i} c) GROUP BY rid
)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
    SELECT a.best.c AS c, j, sum(k.v[j]) AS s, count(*) AS n FROM a{i} a JOIN kept k USING (rid), range(1, {dim + 1}) g(j) GROUP BY a.best.c, j) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return ", ".join(parts) + f"""
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (rid) JOIN c{rounds} f ON f.c = a.best.c
"""


SQL["op11_lloyd"] = _lloyd()

SQL["op12_merkle"] = r"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text, CAST(doc_id AS VARCHAR) AS a, source AS b, lang AS c, CAST(n_chars AS VARCHAR) AS d FROM documents
), heads AS (
  SELECT *, list_transform([a, b, c, d], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END) AS head, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(a) + 1), lambda i: [CAST(ascii(a[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda k, x: CASE WHEN x >= 0 THEN xor(k, x) WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END) AS crc FROM fields
), hashed AS (
  SELECT rid, doc_id, lang, sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) END AS changed FROM heads
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes AS (
  SELECT 0 AS level, lang, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, lang, i // 8, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS k FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, g AS i, k AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n
), steps AS (
  SELECT l.rid, o.level AS step, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < l.i // CAST(pow(8, o.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > l.i // CAST(pow(8, o.level) AS BIGINT)), '') AS after
  FROM leaves l JOIN nodes o ON l.lang IS NOT DISTINCT FROM o.lang AND o.n > 1 AND o.i // 8 = l.i // CAST(pow(8, o.level + 1) AS BIGINT) GROUP BY l.rid, o.level
  UNION ALL
  SELECT l.rid, 100 + o.level, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < s.g // CAST(pow(8, o.level) AS BIGINT)), ''),
         coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > s.g // CAST(pow(8, o.level) AS BIGINT)), '')
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN upper o ON o.n > 1 AND o.i // 8 = s.g // CAST(pow(8, o.level + 1) AS BIGINT) GROUP BY l.rid, o.level
), paths AS (
  SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, list(struct_pack(a := before, b := after) ORDER BY step) AS way FROM steps GROUP BY rid
), folded AS (
  SELECT l.rid, way, 1 AS k, coalesce(changed, leaf) AS now FROM leaves l LEFT JOIN paths USING (rid)
  UNION ALL
  SELECT rid, way, k + 1, sha256(way[k].a || now || way[k].b) FROM folded WHERE k <= len(way)
)
SELECT doc_id, leaf, subroot, u.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.now AS folded_root, f.now = u.digest AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT digest FROM upper WHERE n = 1) u ON TRUE LEFT JOIN paths p USING (rid)
JOIN (SELECT rid, now FROM folded WHERE k > coalesce(len(way), 0)) f USING (rid)
"""


def _substrings(length: int = 13) -> str:
    ahead = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, length))])
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), laid AS (
  SELECT rid, doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts
), windows AS (
  SELECT *, {ahead} AS body FROM laid WINDOW w AS (PARTITION BY rid ORDER BY i)
), judged AS (
  SELECT rid, i, word, body IS NOT NULL AND min(doc_id) OVER (PARTITION BY body) < doc_id AS again FROM windows
), marked AS (
  SELECT rid, i, word, max(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM judged
), counted AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN counted USING (rid)
"""


SQL["op13_substrings"] = _substrings()
