"""DuckDB SQL of those corpus operators that SQL can express: plain statements of the results, with no method of their own.

op4 (stored media), op5 and op7 (learned scores), op8 (markup), op9 (random order) and op10 (tokens) are beyond SQL;
tests/llm hold them against brute force, round trips and held-out accuracy.
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_RECORD = """concat('WARC/1.0', e'\\r\\n', 'WARC-Type: response', e'\\r\\n', 'WARC-Target-URI: ', coalesce(url, ''), e'\\r\\n',
    'Content-Type: text/html', e'\\r\\n', 'Content-Length: ', octet_length(encode({html})), e'\\r\\n\\r\\n', {html}, e'\\r\\n\\r\\n')"""

_LEAVES = """SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file_no,
    coalesce(((page_id % 1024) + 1024) % 1024, CAST('0x' || left(digest, 6) AS BIGINT) % 1024) AS record_no, digest, length, count(*) AS copies
    FROM (SELECT page_id, octet_length(encode(record)) AS length, sha256(record) AS digest FROM (SELECT page_id, {record} AS record FROM pages)) GROUP BY ALL"""

_DAMAGED = """CASE WHEN page_id % 97 = 13 THEN coalesce(html, '') || chr(0) WHEN page_id % 211 = 7 THEN '' ELSE coalesce(html, '') END"""

_PLACED = """SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY file_no ORDER BY record_no, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM {leaves}"""

OP1 = f"""
WITH mine AS ({_LEAVES.format(record=_RECORD.format(html="coalesce(html, '')"))}),
theirs AS ({_LEAVES.format(record=_RECORD.format(html=_DAMAGED))}),
m AS ({_PLACED.format(leaves="mine")}), t AS ({_PLACED.format(leaves="theirs")}),
d AS (SELECT coalesce(m.file_no, t.file_no) AS file_no, coalesce(m.record_no, t.record_no) AS record_no, coalesce(m.page_id, t.page_id) AS page_id,
    coalesce(m.place, t.place) AS place, coalesce(m.length, t.length) AS length, coalesce(m.digest, t.digest) AS digest, coalesce(m.copies, 0) - coalesce(t.copies, 0) AS surplus
    FROM m FULL JOIN t ON m.page_id IS NOT DISTINCT FROM t.page_id AND m.digest = t.digest WHERE coalesce(m.copies, 0) <> coalesce(t.copies, 0)),
c AS (SELECT *, page_id IS NOT NULL AND sum(greatest(surplus, 0)) OVER w = 1 AND sum(greatest(-surplus, 0)) OVER w = 1 AS changed,
    max(CASE WHEN surplus < 0 THEN digest END) OVER w AS new FROM d WINDOW w AS (PARTITION BY page_id))
SELECT file_no, CAST(record_no AS BIGINT) AS record_no, page_id, CAST(place AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
    CASE WHEN surplus > 0 THEN digest END AS digest, CASE WHEN changed THEN new WHEN surplus < 0 THEN digest END AS other_digest, CAST(abs(surplus) AS BIGINT) AS copies
FROM c WHERE surplus > 0 OR NOT changed
"""

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS span FROM d, unnest(range(1, len(words) - 48)) AS r(i)),
f AS (SELECT span, min(doc_id) AS first FROM w GROUP BY span HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT doc_id, i FROM w JOIN f USING (span) WHERE first < doc_id),
t AS (SELECT doc_id, i, words[i] AS word FROM d, unnest(range(1, len(words) + 1)) AS r(i)),
c AS (SELECT t.doc_id, t.i, word, max(CAST(bad.i IS NOT NULL AS INT)) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS goes
    FROM t LEFT JOIN bad ON bad.doc_id = t.doc_id AND bad.i = t.i),
g AS (SELECT doc_id, count(*) FILTER (goes = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (goes = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

#: Of links (a, b) in table ``links``: each node with the least node that it reaches, itself included.
_REACH = """reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(words[i:i + 4], ' ')) AS shingle FROM d, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""

OP6 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN least ON node = vec_id
"""

_FEATURES = r"""SELECT {id} AS id, words, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS features
    FROM (SELECT {id}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM {table})"""

#: CRC-32 bytewise, by the table of its register after each byte value.
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM ({_FEATURES.format(id="doc_id", table="documents")})), b AS ({_FEATURES.format(id="item_id", table="benchmark")}),
register AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, v)) AS after),
f AS (SELECT DISTINCT feature FROM (SELECT unnest(features) AS feature FROM d UNION ALL SELECT unnest(features) FROM b)),
h AS (SELECT feature, xor(list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(after[xor(c, x) % 256 + 1], c // 256), 4294967295), 4294967295) % 10000 AS bucket FROM f, register),
dh AS (SELECT r, bucket FROM (SELECT r, unnest(features) AS feature FROM d) JOIN h USING (feature)), bh AS (SELECT bucket FROM (SELECT unnest(features) AS feature FROM b) JOIN h USING (feature)),
s AS (SELECT bucket, count(*) AS s FROM dh GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bh GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dh) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bh) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT r, sum(gain) AS gain FROM dh JOIN gains USING (bucket) GROUP BY r),
w AS (SELECT r, id AS doc_id, len(words) AS n_words, len(features) AS n_features, CAST(floor(coalesce(gain, 0) / greatest(len(features), 1)) AS BIGINT) AS weight FROM d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || doc_id::VARCHAR), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20 AND score IS NOT NULL)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS asked, v.vec_id, CAST(coalesce(list_inner_product(q.e, v.e), 0) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13 = """
WITH drawn AS (SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) AS n_chars, sha256(doc_id::VARCHAR) AS h FROM documents),
v AS (SELECT *, event - 60 + CAST('0x' || substr(h, 9, 8) AS BIGINT) % 300 AS arrival, event + CAST('0x' || substr(h, 17, 8) AS BIGINT) % 900 AS expiry
    FROM (SELECT *, CAST('0x' || left(h, 8) AS BIGINT) % 20000 AS event FROM drawn)),
asked AS (SELECT row_number() OVER () AS r, doc_id, CAST('0x' || substr(sha256(doc_id::VARCHAR), 25, 8) AS BIGINT) % 20000 AS t FROM labels),
sources AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
met AS (SELECT r, t - event AS age, v.doc_id AS version_id, n_chars, lang, row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival, v.doc_id DESC) AS k
    FROM asked JOIN sources USING (doc_id) JOIN v ON v.source = sources.source WHERE event <= t AND arrival <= t AND t < expiry)
SELECT doc_id, t, version_id, age, CASE WHEN age IS NULL THEN 'none' WHEN age > 60 THEN 'stale' ELSE 'fresh' END AS status,
    CASE WHEN age <= 60 THEN n_chars END AS n_chars, CASE WHEN age <= 60 THEN lang END AS lang
FROM asked LEFT JOIN (SELECT * FROM met WHERE k = 1) USING (r)
"""

ORACLES = {
    "op1_warc_fixity": OP1,
    "op2_substring_dedup": OP2,
    "op3_jaccard_join": OP3,
    "op6_metric_join": OP6,
    "op11_importance_resampling": OP11,
    "op12_exact_topk": OP12,
    "op13_point_in_time": OP13,
}
