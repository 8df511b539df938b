"""SQL counterparts of the training-data queries, where SQL can state them.

Problems 3, 5, 6, 9 and 10 rest on page trees, tokenizers and byte encodings; they are tested against brute force, and so is
the rate of wrong answers of problem 4, which depends on hashes. DuckDB knows NFC but not NFKC: the SQL of problem 8 holds
for texts without compatibility characters, as in these tables; the tests cover the others.
"""

from __future__ import annotations

SITE = "nullif(lower(trim({c})), '')"


def _site(c: str) -> str:
    return SITE.format(c=c)


# The entities that occur in the tables; the operator decodes all of HTML's.
_ENT = [("&copy;", "©"), ("&raquo;", "»"), ("&laquo;", "«"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _line_text(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in _ENT:
        b = b.replace("'", "''")
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


LINES = f"""l AS (SELECT item_id, {_site('domain')} AS domain, unnest(string_split(raw_content, chr(10))) AS raw, generate_subscripts(string_split(raw_content, chr(10)), 1) AS line_no FROM cdr_items WHERE raw_content IS NOT NULL),
    t AS (SELECT item_id, domain, line_no, raw, {_line_text('raw')} AS text FROM l),
    k AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '0', 'g') AS k FROM t),
    f AS (SELECT domain, k FROM k WHERE domain IS NOT NULL AND text <> '' GROUP BY 1, 2 HAVING count(DISTINCT item_id) >= 5)"""

FORMS = f"(SELECT {_site('domain')} AS domain, form_id, url, unnest(map_keys(form)) AS form_type, unnest(map_values(form)) AS probability FROM forms)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY domain, form_type ORDER BY probability DESC, url, form_id) AS rank FROM {FORMS} WHERE domain IS NOT NULL AND probability IS NOT NULL AND NOT isnan(probability))"


def _key(u: str) -> str:
    bare = f"split_part({u}, '#', 1)"
    head = f"regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?]*)?', 0)"
    rest = f"substr({bare}, length({head}) + 1)"
    path = f"split_part({rest}, '?', 1)"
    query = f"substr({rest}, length({path}) + 2)"
    return f"lower({head}) || {path} || CASE WHEN contains({rest}, '?') THEN '?' || array_to_string(list_sort(string_split({query}, '&')), '&') ELSE '' END"


def _seen(kind: str, tab: str, i: str, u: str) -> str:
    return f"SELECT '{kind}' AS rec_kind, {i} AS rec_id FROM (SELECT {i}, min({i}) OVER (PARTITION BY {_key(u)}) AS first FROM {tab} WHERE {u} IS NOT NULL) WHERE {i} > first"


WORDS = "regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '\\p{Cf}+', '', 'g'))), '[\\p{L}\\p{Nd}]+')"


def _grams(i: str, tab: str) -> str:
    return f"SELECT DISTINCT {i}, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM (SELECT {i}, {WORDS} AS w FROM {tab} WHERE text IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {LINES} SELECT item_id, line_no::BIGINT AS line_no FROM k SEMI JOIN f USING (domain, k) WHERE text <> ''",
        "p1_stripped": f"""WITH {LINES}, g AS (SELECT k.item_id, k.line_no, k.raw, f.k IS NOT NULL AND k.text <> '' AS gone FROM k LEFT JOIN f ON f.domain = k.domain AND f.k = k.k),
            a AS (SELECT item_id, count_if(gone)::BIGINT AS removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text FROM g GROUP BY 1)
            SELECT c.item_id, coalesce(a.removed, 0)::BIGINT AS removed, a.text FROM cdr_items c LEFT JOIN a USING (item_id)""",
        "p2_found": f"SELECT domain, form_type, form_id FROM {RANKED} WHERE rank <= 3",
        "p2_ranked": f"SELECT domain, form_type, probability, form_id, rank::BIGINT AS rank FROM {RANKED} WHERE rank <= 3",
        "p4_found": f"{_seen('link', 'links', 'link_id', 'url')} UNION ALL {_seen('node', 'nodes', 'node_id', 'original_url')}",
        "p8_found": f"WITH a AS ({_grams('doc_id', 'documents')}), b AS ({_grams('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)",
        "p8_items": f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT item_id, {WORDS} AS v FROM eval_items WHERE text IS NOT NULL),
            a AS ({_grams('doc_id', 'documents')}), b AS ({_grams('item_id', 'eval_items')}), h AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)),
            x AS (SELECT doc_id, item_id, w, v, len(v) AS n FROM h JOIN w USING (doc_id) JOIN v USING (item_id)),
            p AS (SELECT doc_id, item_id, n, i, generate_subscripts(w, 1) AS j, unnest(w) AS word, v[i] AS mine FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM x)),
            m AS (SELECT doc_id, item_id, n, i, j, j - i AS d FROM p WHERE word = mine),
            r AS (SELECT doc_id, item_id, n, d, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS g FROM m),
            s AS (SELECT doc_id, item_id, n, max(c) AS span FROM (SELECT doc_id, item_id, n, d, g, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL)
            SELECT item_id, count(DISTINCT doc_id)::BIGINT AS docs, max(span)::BIGINT AS longest, max(span / n) AS share FROM s GROUP BY 1""",
    }
