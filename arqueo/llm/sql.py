"""SQL that gives the rows of queries p1_, p2_, p5_, p6_ and p7_."""

from __future__ import annotations

from arqueo.plans.registry import sql_amount, sql_data, sql_order
from arqueo.plans.times_sql import times

# Letters of other scripts in these tables, and the Latin letters of their shape.
_OTHER = "АВСЕНІЈКМОРЅТХУасеһіјорѕхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρια"
_LATIN = "ABCEHIJKMOPSTXYacehijopsxyABEZHIKMNOPTYXovpia"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _canon(c: str) -> str:
    blanks = rf"regexp_replace(regexp_replace({c}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}]', '', 'g'), '[\p{{Zs}}\t]', ' ', 'g')"
    shapes = f"translate({blanks}, '{_OTHER}{_WIDE}', '{_LATIN}{_NARROW}')"
    return rf"nfc_normalize(regexp_replace({shapes}, '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{2043}}\x{{02D7}}]', '-', 'g'))"


def _grams(table: str, key: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(translate(text, '{_WIDE}', '{_NARROW}'))), '[\p{{Cf}}\p{{M}}]+', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"


def _split(c: str) -> str:
    return f"CASE lower({sql_data(c)}) WHEN 'val' THEN 'validation' ELSE lower({sql_data(c)}) END"


# 1: groups as what can be reached from each key.
_P1 = f"""
l AS (SELECT file_id, {sql_data('supplier_id')} AS s, {sql_data('template_id')} AS t, CASE WHEN lower(trim(field)) = 'supplier_nif' THEN {sql_data('expected')} END AS n FROM ocr_labels WHERE file_id IS NOT NULL),
k AS (SELECT DISTINCT file_id, unnest(list_filter(['s:' || s, 't:' || t, 'n:' || n], lambda x: x IS NOT NULL)) AS k FROM l),
e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b ON a.file_id = b.file_id),
r AS (SELECT DISTINCT k AS root, k FROM k UNION SELECT r.root, e.b FROM r JOIN e ON r.k = e.a),
g AS (SELECT k, min(root) AS g FROM r GROUP BY 1),
f AS (SELECT DISTINCT k.file_id, g.g FROM k JOIN g ON k.k = g.k UNION ALL SELECT DISTINCT file_id, 'f:' || file_id FROM l WHERE file_id NOT IN (SELECT file_id FROM k)),
sp AS (SELECT DISTINCT file_id, {_split('split')} AS split FROM (SELECT file_id, split FROM ocr_splits UNION ALL SELECT file_id, split FROM ocr_report)),
bad AS (SELECT f.g FROM f JOIN sp ON f.file_id = sp.file_id GROUP BY 1 HAVING count(DISTINCT split) > 1),
nm AS (SELECT g, min(substr(k, 3)) AS n FROM g WHERE k LIKE 's:%' GROUP BY 1)"""


def _read(f: str) -> str:
    return f"json_extract_string(extraction, '$.fields.\"{f}\".value')"


_MARKS = r"(?:[\s_-]*\([0-9]+\)|[\s_-]+(?:copia|copy|v[0-9]+))*"
# 2: all links between rows, and then the rows one after the other in order of arrival.
_P2 = rf"""
d AS (SELECT id, row_number() OVER (ORDER BY created NULLS LAST, id) AS i, extraction IS NULL AS bare, nullif(regexp_replace(lower({sql_data('sha256')}), '^sha256:', ''), '') AS sha,
  nullif(regexp_replace(regexp_replace(regexp_replace(trim(lower(nfc_normalize(file_id)), ' _'), '(?:copia|copy)[\s_]+(?:de|of)[\s_]+', '', 'g'), '{_MARKS}(\.[a-z]{{2,4}}){_MARKS}$|{_MARKS}$', '\1'), '[\s_]+', '', 'g'), '') AS fn,
  {sql_data('nfc_normalize(' + _read('invoice_number') + ')')} AS s0, {sql_data(_read('supplier_nif'))} AS s1, coalesce({sql_order(_read('order'))}, {sql_data(_read('order'))}) AS s2, {_read('date')} AS dv,
  coalesce(CAST({sql_amount(_read('total'))} AS VARCHAR), {sql_data(_read('total'))}) AS s4 FROM invoice_documents WHERE id IS NOT NULL),
tv AS (SELECT dv AS v FROM d), {times('tv')},
x AS (SELECT d.*, coalesce(CAST(day AS VARCHAR), {sql_data('dv')}) AS s3 FROM d LEFT JOIN times ON v = dv),
bk AS (SELECT id, i, unnest(list_filter([{", ".join("'" + str(k) + ":' || " + " || '|' || ".join(f"s{j}" for j in range(5) if j != k) for k in range(5))}], lambda z: z IS NOT NULL)) AS k FROM x),
ln AS (SELECT b.id AS id, b.i AS i, a.id AS kept, a.i AS ki FROM x a JOIN x b ON a.sha = b.sha AND a.i < b.i UNION SELECT b.id, b.i, a.id, a.i FROM bk a JOIN bk b ON a.k = b.k AND a.i < b.i
  UNION SELECT b.id, b.i, a.id, a.i FROM x a JOIN x b ON a.fn = b.fn AND a.i < b.i WHERE b.bare),
od AS (SELECT row_number() OVER (ORDER BY i) AS n, id, ks FROM (SELECT id, i, list(kept) AS ks FROM ln GROUP BY 1, 2)),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS lost UNION ALL SELECT od.n, CASE WHEN len(list_filter(ks, lambda z: NOT list_contains(lost, z))) > 0 THEN list_append(lost, od.id) ELSE lost END FROM w JOIN od ON od.n = w.n + 1),
gone AS (SELECT unnest(lost) AS id FROM (SELECT lost FROM w ORDER BY n DESC LIMIT 1)),
rp AS (SELECT id, kept FROM ln WHERE id IN (SELECT id FROM gone) AND kept NOT IN (SELECT id FROM gone))"""

_FIELDS = {"importe": "importe", "proveedor": "proveedor", "nif": "nif", "estado": "estado"}
# 5: each field's candidates in order.
_P5 = f"""
cp AS (SELECT snapshot_id, bool_or(coalesce(complete, false)) AS complete FROM erp_snapshot GROUP BY 1),
tv AS (SELECT fecha AS v FROM erp_rows UNION ALL SELECT fecha_registro FROM erp_rows), {times('tv')},
er AS (SELECT e.snapshot_id, e.idx, {sql_order('pedido')} AS pedido, coalesce({sql_amount('importe')}, {sql_amount('importe_esperado')}) AS importe, coalesce({sql_data('proveedor')}, {sql_data('proveedor_id')}) AS proveedor, {sql_data('nif')} AS nif, {sql_data('estado')} AS estado,
  coalesce(cp.complete, false) AS complete, greatest(a.us, b.us) AS us FROM erp_rows e LEFT JOIN cp ON cp.snapshot_id = e.snapshot_id LEFT JOIN times a ON a.v = e.fecha LEFT JOIN times b ON b.v = e.fecha_registro),
mn AS (SELECT pedido FROM er WHERE pedido IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
lg AS ({' UNION ALL '.join(f"SELECT pedido, '{f}' AS field, complete, us, snapshot_id, idx FROM er WHERE {c} IS NOT NULL" for f, c in _FIELDS.items())})"""


def _places(table: str, key: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(translate(text, '{_WIDE}', '{_NARROW}'))), '[\p{{Cf}}\p{{M}}]+', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"SELECT {key}, unnest(range(0, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 11"


_P7 = f"""
d AS ({_places('documents', 'doc_id')}), e AS ({_grams('eval_items', 'item_id')}), h AS (SELECT DISTINCT doc_id, item_id, i FROM d JOIN e ON d.gram = e.gram),
n AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 1 ELSE 0 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, item_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) + 11 AS INTEGER) AS last_word FROM r GROUP BY doc_id, item_id, run)"""

_P6 = """
l AS (SELECT id, unnest(CAST(json_extract(extraction, '$.pages[*].lines[*]') AS JSON[])) AS l FROM invoice_documents WHERE extraction IS NOT NULL),
p AS (SELECT 'ocr_report' AS tab, file_id AS rec_key, field AS item, observed AS a, expected AS b FROM ocr_report UNION ALL
  SELECT 'invoice_documents', id, json_extract_string(l, '$.line_no'), json_extract_string(l, '$.raw_text'), json_extract_string(l, '$.text') FROM l)"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_P1} SELECT f.file_id, nm.n AS group_id FROM f JOIN bad ON f.g = bad.g LEFT JOIN nm ON nm.g = f.g",
    "p2_found": f"WITH RECURSIVE {_P2} SELECT DISTINCT least(id, kept) AS id_a, greatest(id, kept) AS id_b FROM rp",
    "p2_batches": f"WITH RECURSIVE {_P2} SELECT batch_id, count(*) AS n_rows, count(*) FILTER (id IN (SELECT id FROM gone)) AS n_repeats FROM invoice_documents GROUP BY 1",
    "p5_found": f"WITH {_P5} SELECT lg.pedido, field, arg_max(snapshot_id, {{c: complete, t: coalesce(us, -9223372036854775807), s: snapshot_id, i: idx}}) AS snapshot_id, arg_max(idx, {{c: complete, t: coalesce(us, -9223372036854775807), s: snapshot_id, i: idx}}) AS idx FROM lg JOIN mn ON lg.pedido = mn.pedido GROUP BY 1, 2",
    "p6_canonical": f"WITH {_P6}, q AS (SELECT a AS text FROM p UNION SELECT b FROM p) SELECT text, {_canon('text')} AS canon FROM q WHERE text <> {_canon('text')}",
    "p7_spans": f"WITH {_P7} SELECT * FROM s",
    "p7_items": f"WITH {_P7} SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(sum(last_word - first_word + 1) AS BIGINT) AS n_words FROM s GROUP BY 1",
    "p6_found": f"WITH {_P6} SELECT DISTINCT tab, rec_key, item FROM p WHERE a <> b AND {_canon('a')} = {_canon('b')}",
    "p7_found": f"WITH d AS ({_grams('documents', 'doc_id')}), e AS ({_grams('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e ON d.gram = e.gram",
}
