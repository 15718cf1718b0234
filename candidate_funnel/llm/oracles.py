"""The same results in SQL, where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"

ESCAPED = "(length({0}) + length({0}) * 3 - length(replace({0}, '~', '')) - length(replace({0}, '<', '')) - length(replace({0}, '[', '')))"

CHAT = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM every
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({ESCAPED.format("text")} + CASE WHEN before = role THEN 6 ELSE 20 + {ESCAPED.format("role")} END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([3, 1, 2], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)) AS w
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS bound,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS everything,
         coalesce(sum(CAST(source_size * 2 AS DOUBLE)) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
         CAST(sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights
  FROM sources
  WINDOW up AS (ORDER BY CAST(source_size * 2 AS DOUBLE) / w, source NULLS LAST)
), judged AS (
  SELECT *, (everything - gone) * w >= bound * weights AS bounded FROM ranked
), rest AS (
  SELECT everything - gone AS lft, weights AS among FROM judged WHERE NOT bounded
  ORDER BY bound / w, source NULLS LAST LIMIT 1
), budget AS (
  SELECT source, source_size,
         CASE WHEN bounded THEN bound ELSE (SELECT lft FROM rest) * w / (SELECT among FROM rest) END AS target
  FROM judged
), placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before,
         CAST(floor(b.target / greatest(b.source_size, 1)) AS BIGINT) AS epochs
  FROM docs d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(CAST(round(target) AS BIGINT) - epochs * source_size - before, 0), size) AS BIGINT) AS taken,
       before
FROM placed
"""

NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.x = d.doc_id
"""

MEASURED = {
    "word_length": ("word_chars", "n_words", True, 400),
    "symbols": ("n_symbols", "n_words", False, 10),
    "dup_lines": ("n_dup_lines", "n_lines", False, 200),
    "repeats": ("n_repeat_words", "n_words", False, 50),
}
VALUES = ", ".join(f"{count} * 1000 // greatest({of}, 1) AS {name}" for name, (count, of, _, _) in MEASURED.items())
ENTRIES = " UNION ALL ".join(
    f"SELECT o, i, '{name}' AS measure, {name} AS v, {str(both).upper()} AS two_sided, {least} AS least FROM valued WHERE NOT base_failed"
    for name, (_, _, both, least) in MEASURED.items()
)
OWN = " ".join(f"WHEN '{name}' THEN {name}" for name in MEASURED)

RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '') AS o, coalesce('=' || source, '') AS i
  FROM documents
), cut AS (
  SELECT k, regexp_extract_all(text, '{WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM docs
), words AS (
  SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM cut
), stretches AS (
  SELECT k, p, count(*) OVER (PARTITION BY k, s) > 1 AS again
  FROM (SELECT k, p, word || ' ' || lead(word) OVER (PARTITION BY k ORDER BY p) || ' ' || lead(word, 2) OVER (PARTITION BY k ORDER BY p) AS s FROM words)
  WHERE s IS NOT NULL
), covered AS (
  SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM stretches WHERE again) GROUP BY k
), counted AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM docs d JOIN cut USING (k) LEFT JOIN covered USING (k)
), valued AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {VALUES} FROM counted
), entries AS ({ENTRIES}
), placed AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b FROM entries
), levels AS (
  SELECT o, i, measure, b, two_sided, least, 0 AS level FROM placed
  UNION ALL SELECT o, NULL, measure, b, two_sided, least, 1 FROM placed
  UNION ALL SELECT NULL, NULL, measure, b, two_sided, least, 2 FROM placed
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY level, o, i, measure ORDER BY b) AS r,
         count(*) OVER (PARTITION BY level, o, i, measure) AS n FROM levels
), quartiles AS (
  SELECT level, o, i, measure, any_value(two_sided) AS two_sided, any_value(least) AS least, any_value(n) AS n,
         min(b) FILTER (WHERE 4 * r >= n) AS q1, min(b) FILTER (WHERE 4 * r >= 3 * n) AS q3
  FROM ordered GROUP BY ALL
), fences AS (
  SELECT *, CASE WHEN two_sided THEN q1 - 3 * greatest(q3 - q1, least) ELSE 0 END AS low,
         q3 + 3 * greatest(q3 - q1, least) AS high FROM quartiles
), chosen AS (
  SELECT d.k, f.measure, f.low, f.high
  FROM docs d JOIN fences f ON (f.level = 2 OR f.o = d.o) AND (f.level > 0 OR f.i = d.i)
  WHERE f.n >= 100 OR f.level = 2
  QUALIFY row_number() OVER (PARTITION BY d.k, f.measure ORDER BY f.level) = 1
), verdicts AS (
  SELECT k, bool_and(CASE measure {OWN} END BETWEEN low AND high) AS inside FROM valued JOIN chosen USING (k) GROUP BY k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(inside, FALSE) AS kept
FROM valued LEFT JOIN verdicts USING (k)
"""

# Bytes of a text, each followed by eight shifts, folded into its crc32.
CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)] || list_transform(range(8), lambda _: -1))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
), broken AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM marked WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY c) AS n, rtrim(text, {BLANKS}) AS tail
  FROM broken
), judged AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM placed
), costs AS (
  SELECT c, n + 1 AS i, 0 AS f0, 6 AS f1, 3 AS f2, 0 AS f3 FROM judged WHERE i = n
  UNION ALL
  SELECT c, i, least(x0, 3 + x2, 6 + x3), least(x1, 3 + x2, 6 + x3), least(x2, 3 + x3), least(x3, 3 + x2)
  FROM (
    SELECT j.c, j.i, least(4 + f0, may + least(3 + f2, CASE initial WHEN 's' THEN f1 WHEN 'u' THEN f2 ELSE 1000000000 END)) AS x0,
           least(4 + f1, may + least(3 + f2, CASE initial WHEN 'u' THEN f2 ELSE 1000000000 END)) AS x1,
           least(4 + f2, may + least(3 + f3, CASE initial WHEN 'a' THEN f3 ELSE 1000000000 END)) AS x2,
           least(4 + f3, may + least(3 + f2, CASE initial WHEN 'u' THEN f2 ELSE 1000000000 END)) AS x3
    FROM costs o JOIN (SELECT *, CASE fault WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS may FROM judged) j
      ON j.c = o.c AND j.i = o.i - 1
  )
), rules AS (
  SELECT c, i, unnest([0, 1, 2, 3]) AS p, unnest([f0, f1, f2, f3]) AS f, unnest([2, 2, 3, 2]) AS q, unnest([f2, f2, f3, f2]) AS g FROM costs
), choices AS (
  SELECT r.c, r.i, r.p, r.q, j.role, j.text, j.fault,
         CASE WHEN j.i IS NULL THEN CASE WHEN r.p IN (0, 3) THEN '' ELSE 'I' END
              WHEN 4 + a.f = r.f THEN 'D' WHEN 3 + r.g = r.f THEN 'I'
              WHEN j.fault IN ('', 't') AND (initial = 's' AND r.p = 0 AND e + s.f = r.f
                OR initial = 'u' AND r.p <> 2 AND e + a.g = r.f OR initial = 'a' AND r.p = 2 AND e + a.g = r.f) THEN 'K'
              ELSE 'R' END AS edit
  FROM rules r LEFT JOIN (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS e FROM judged) j ON j.c = r.c AND j.i = r.i
    LEFT JOIN rules a ON a.c = r.c AND a.i = r.i + 1 AND a.p = r.p LEFT JOIN rules s ON s.c = r.c AND s.i = r.i + 1 AND s.p = 1
), walked AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 0 AS p, '' AS audit, CAST([] AS VARCHAR[]) AS said, FALSE AS done FROM costs GROUP BY c
  UNION ALL
  SELECT w.c, w.i + CASE WHEN edit IN ('D', 'K', 'R') THEN 1 ELSE 0 END,
         CASE WHEN edit = 'K' AND starts_with(role, 's') THEN 1 WHEN edit IN ('', 'D') THEN w.p ELSE q END,
         audit || edit,
         CASE edit WHEN '' THEN said WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
              ELSE list_append(said, CASE q WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END,
         edit = ''
  FROM walked w JOIN choices h ON h.c = w.c AND h.i = w.i AND h.p = w.p WHERE NOT done
), faults AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM judged) GROUP BY c
)
SELECT m.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(f0, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM marked) m LEFT JOIN faults ON faults.c = m.c
  LEFT JOIN costs ON costs.c = m.c AND costs.i = 1 LEFT JOIN walked ON walked.c = m.c AND done
"""

NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

ORACLES: dict[str, str] = {"op2_chat_format": CHAT, "op3_mix_sources": MIX, "op8_minhash": NEAR, "op11_structure_repair": REPAIR, "op12_quality_rules": RULES, "op13_hard_negatives": NEGATIVES}
