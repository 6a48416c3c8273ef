"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from . import fingerprint, packing, quality, suffix

_WORD = "'[^ \\t\\n\\r\\f\\v]+'"


def packing_sql() -> str:
    """The same dynamic programme and numbering, as recursive queries over the histogram."""
    exact, digits = packing.EXACT, packing.EXACT.bit_length() - 1
    return f"""WITH RECURSIVE n AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS n_tokens FROM documents),
e AS (SELECT *, CASE WHEN n_tokens <= {exact} THEN n_tokens ELSE ((n_tokens + step - 1) // step) * step END AS edge
  FROM (SELECT *, CASE WHEN n_tokens > {exact} THEN 1 << (length(bin(n_tokens - 1)) - {digits}) ELSE 1 END AS step FROM n)),
h AS (SELECT edge, count(*) AS c, sum(n_tokens) AS t FROM e GROUP BY 1),
b AS (SELECT row_number() OVER (ORDER BY edge) AS j, edge, CAST(sum(c) OVER (ORDER BY edge) AS BIGINT) AS c, CAST(sum(t) OVER (ORDER BY edge) AS BIGINT) AS t FROM h),
p AS (SELECT 0 AS j, 0 AS c, 0 AS t UNION ALL SELECT j, c, t FROM b),
dp AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS frm
  UNION ALL
  SELECT k + 1, j, x.cost, x.i FROM (
    SELECT dp.k AS k, b.j AS j, min({{'cost': dp.cost + b.edge * (b.c - p.c) - (b.t - p.t), 'i': dp.j}}) AS x
    FROM dp JOIN p ON p.j = dp.j JOIN b ON b.j > dp.j WHERE dp.k < {packing.BUCKETS} GROUP BY 1, 2)
),
best AS (SELECT k FROM dp WHERE j = (SELECT max(j) FROM b) ORDER BY cost, k LIMIT 1),
back AS (
  SELECT k, j, frm FROM dp WHERE k = (SELECT k FROM best) AND j = (SELECT max(j) FROM b)
  UNION ALL
  SELECT dp.k, dp.j, dp.frm FROM back JOIN dp ON dp.k = back.k - 1 AND dp.j = back.frm WHERE back.frm > 0
),
cuts AS (SELECT CAST(back.k - 1 AS INTEGER) AS bucket, b.edge AS bucket_len, lag(b.edge, 1, -1) OVER (ORDER BY back.k) AS above FROM back JOIN b ON b.j = back.j)
SELECT doc_id, n_tokens, bucket, bucket_len,
  (row_number() OVER (PARTITION BY bucket ORDER BY edge, doc_id % {packing.SHARDS}, doc_id) - 1) // greatest(1, {packing.TOKEN_BUDGET} // greatest(1, bucket_len)) AS batch
FROM e JOIN cuts ON edge > above AND edge <= bucket_len"""


def repeats_sql() -> str:
    """Words under a passage whose words stand earlier, as maximal ranges."""
    size = suffix.LENGTH
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {size}], ' ') AS key FROM d, unnest(range(len(w) - {size - 1})) AS u(i) WHERE len(w) >= {size}),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {size} THEN 0 ELSE 1 END AS head FROM later),
part AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM new)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) + {size} AS INTEGER) AS end_word FROM part GROUP BY doc_id, part"""


def fingerprints_sql() -> str:
    """Horner's rule over code points, and comparison with the head's first document."""
    (p, q), (b, c) = fingerprint.PRIMES, fingerprint.BASES

    def horner(base: int, prime: int) -> str:
        return f"list_reduce(list_prepend(CAST(0 AS BIGINT), codes), lambda h, x: (h * {base} + x) % {prime})"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS BIGINT[])
  ELSE list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS BIGINT) + 1) END AS codes FROM documents),
f AS (SELECT *, len(codes) AS n_chars, {horner(b, p)} * 2147483648 + {horner(c, q)} AS fingerprint,
  first(doc_id) OVER head AS head_id, first(codes) OVER head AS lead FROM d WINDOW head AS (PARTITION BY substring(text, 1, {fingerprint.HEAD}) ORDER BY doc_id, length(text), text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, fingerprint, head_id,
  CAST(coalesce(nullif(list_position(list_transform(list_zip(codes, lead), lambda z: z[1] IS DISTINCT FROM z[2]), TRUE), 0) - 1, n_chars) AS BIGINT) AS common_chars FROM f"""


def quality_sql() -> str:
    """Repeated lines and n-grams by their words, and the rules in order."""
    parts = [
        f"d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents)",
        "words AS (SELECT doc_id, i, w[i + 1] AS word, length(w[i + 1]) AS size FROM d, unnest(range(len(w))) AS u(i))",
        f"""lines AS (SELECT doc_id, i, array_to_string(lw, ' ') AS key, list_sum(list_transform(lw, lambda x: length(x))) AS size
  FROM (SELECT doc_id, i, regexp_extract_all(l[i + 1], {_WORD}) AS lw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), unnest(range(len(l))) AS u(i)) WHERE len(lw) > 0)""",
        "m0 AS (SELECT doc_id, sum(size) AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS r FROM lines) WHERE r > 1 GROUP BY 1)",
    ]
    for n in quality.NGRAMS:
        key = "word" + "".join(f" || ' ' || lead(word, {k}) OVER d" for k in range(1, n))
        parts += [
            f"k{n} AS (SELECT doc_id, i, size, {key} AS key FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i))",
            f"r{n} AS (SELECT doc_id, i, size, CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, key ORDER BY i) > 1 THEN 1 ELSE 0 END AS later FROM k{n})",
            f"m{n} AS (SELECT doc_id, sum(size) AS s FROM (SELECT doc_id, size, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM r{n}) WHERE c = 1 GROUP BY 1)",
        ]
    parts.append("total AS (SELECT doc_id, sum(size) AS s FROM words GROUP BY 1)")
    ids = [0, *quality.NGRAMS]
    names = {0: "lines"} | {n: f"{n}grams" for n in quality.NGRAMS}
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.doc_id = d.doc_id" for n in ids)
    rules = " ".join(f"WHEN coalesce(m{n}.s, 0) > CAST({quality.LIMITS[n]} AS DOUBLE) * total.s THEN '{names[n]}'" for n in ids)
    columns = ", ".join(f"CAST(coalesce(m{n}.s, 0) AS BIGINT) AS dup_{'line' if n == 0 else f'{n}gram'}_chars" for n in ids)
    return f"""WITH {', '.join(parts)}, judged AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(total.s, 0) AS BIGINT) AS word_chars, {columns},
  CASE WHEN coalesce(total.s, 0) = 0 THEN 'empty' {rules} END AS reason FROM d LEFT JOIN total ON total.doc_id = d.doc_id {joins})
SELECT *, reason IS NULL AS keep FROM judged"""


ORACLES = {"op1_packing": packing_sql(), "op8_repeats": repeats_sql(), "op9_fingerprints": fingerprints_sql(), "op10_quality": quality_sql()}
