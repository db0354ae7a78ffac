"""DuckDB SQL of the registered queries, written from the definitions of the operators."""

from __future__ import annotations

#: Fixed values, written down here once more so that the SQL does not rest on what it tests.
PHRASES = {
    "revenue": ("выручка", "revenue", "выручка от реализации"),
    "net_profit": ("чистая прибыль", "прибыль за год", "net profit"),
    "profit_from_sales": ("операционная прибыль", "прибыль от продаж", "прибыль от основной", "operating profit"),
    "total_assets": ("итого активы", "всего активов", "total assets", "активы всего"),
    "equity": ("капитал и резервы", "собственный капитал", "итого капитал", "total equity"),
    "current_assets": ("оборотные активы", "current assets"),
    "current_liabilities": ("краткосрочные обязательства", "краткосрочные пассивы", "current liabilities"),
    "inventories": ("запасы", "inventories"),
    "cash_and_short_term_investments": ("денежные средства", "денежные средства и их эквиваленты", "краткосрочные финансовые вложения"),
    "total_liabilities": ("итого обязательства", "итого пассивы", "total liabilities"),
    "accounts_receivable": ("дебиторская задолженность", "accounts receivable"),
    "capex": ("приобретение основных средств", "приобретение внеоборотных активов", "покупка основных средств", "capex"),
}
FIELDS = tuple(PHRASES)
#: Key, title, formula, unit, hint, bounds of ok and warn, whether less is better.
RATIOS = (
    ("ros", "Рентабельность продаж", "Прибыль от продаж / Выручка", "%", "Доля операционной прибыли в выручке.", 0.15, 0.05, False),
    ("net_margin", "Рентабельность чистой прибыли", "Чистая прибыль / Выручка", "%", "Сколько чистой прибыли с рубля выручки.", 0.1, 0.03, False),
    ("roa", "ROA", "Чистая прибыль / Активы", "%", "Эффективность использования активов.", 0.08, 0.03, False),
    ("roe", "ROE", "Чистая прибыль / Собственный капитал", "%", "Доходность капитала для владельцев.", 0.08, 0.03, False),
    ("current_ratio", "Текущая ликвидность", "Оборотные активы / Краткосрочные обязательства", "раз", "Покрытие краткосрочных долгов оборотными активами.", 1.5, 1.0, False),
    ("quick_ratio", "Быстрая ликвидность", "(Оборотные активы − Запасы) / Краткосрочные обязательства", "раз", "Ликвидность без запасов.", 1.0, 0.7, False),
    ("cash_ratio", "Денежная ликвидность", "(Деньги + краткоср. вложения) / Краткосрочные обязательства", "раз", "Мгновенная платёжеспособность.", 0.2, 0.1, False),
    ("autonomy", "Автономия", "Собственный капитал / Активы", "доля", "Доля собственных средств в активах.", 0.5, 0.33, False),
    ("leverage", "Финансовый леверидж", "Обязательства / Собственный капитал", "раз", "Долг на рубль собственного капитала.", 1.0, 2.5, True),
    ("dso", "Оборачиваемость дебиторки (дни)", "(Дебиторка / Выручка) × 365", "дни", "Средний срок погашения дебиторки.", 45.0, 90.0, True),
    ("asset_turnover", "Оборачиваемость активов", "Выручка / Активы", "раз", "Выручка на рубль активов.", 0.5, 0.3, False),
    ("capex_revenue", "CAPEX / Выручка", "Приобретение ОС / Выручка", "%", "Доля инвестиций в основные средства от выручки.", 0.25, 0.4, True),
)
#: The texts of warnings and signs of statuses.
MISSING = "Нет показателя «{}» — часть метрик будет пропущена. Добавьте строку в отчёт или введите вручную."
NO_LIABILITIES = "Для ликвидности нужны краткосрочные обязательства."
NO_SALES_PROFIT = "Нет «прибыль от продаж / операционная прибыль» — рентабельность продаж не посчитана."
NO_INVENTORIES = "Нет строки «Запасы» — быстрая ликвидность не посчитана."
SIGNS = {"ok": "🟢", "warn": "🟡", "risk": "🔴"}
#: Phrases that make a page worth reading; words that speak against it and their weight.
KEYWORDS = (
    "выручка", "доход от реализации", "revenue", "sales", "чистая прибыль", "убыток за период", "net income", "net profit",
    "итого активы", "совокупные активы", "total assets", "капитал", "собственный капитал", "total equity", "shareholders' equity", "оборотные активы",
    "current assets", "краткосрочные обязательства", "current liabilities", "дебиторская задолженность", "accounts receivable", "receivables", "денежные средства и их эквиваленты", "cash and cash equivalents",
    "запасы", "inventories", "stock", "операционная прибыль", "operating profit", "ebit", "капитальные вложения", "capex",
    "приобретение основных средств", "capital expenditure", "себестоимость", "cost of sales", "cost of goods sold", "cogs",
)
PENALTY, PENALTY_WORDS = 5, ("вознаграждение", "руководящего персонала")
#: Headings of the report and the row a preview puts first.
TITLE = "Финансовый отчёт (автоанализ)"
HEADS = ("Статус", "Показатель", "Значение", "Формула")
BALANCE = ("balance", "Баланс", "активы = пасивы", "", "ok")

#: White space of Unicode in the syntax of the SQL engine's patterns.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WSC = _WS[1:-1]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _newest(table: str, key: str, at: str = "ingested_at") -> str:
    return f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) AS _rn FROM {table}) WHERE _rn = 1)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_score = " + ".join(f"({f} IS NOT NULL)::BIGINT" for f in FIELDS)
BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE strategy WHEN 'structured' THEN 1 WHEN 'plain' THEN 2 WHEN 'direct' THEN 3 ELSE 4 END, strategy DESC) AS _k
FROM (SELECT *, ({_score})::INTEGER AS score FROM {_newest("financial_facts", "fact_id")})) WHERE _k = 1)"""
_PARTS = {
    "ros": "profit_from_sales / nullif(revenue, 0)", "net_margin": "net_profit / nullif(revenue, 0)", "roa": "net_profit / nullif(total_assets, 0)", "roe": "net_profit / nullif(equity, 0)",
    "current_ratio": "current_assets / nullif(current_liabilities, 0)", "quick_ratio": "(current_assets - inventories) / nullif(current_liabilities, 0)", "cash_ratio": "cash_and_short_term_investments / nullif(current_liabilities, 0)",
    "autonomy": "equity / nullif(total_assets, 0)", "leverage": "total_liabilities / nullif(equity, 0)", "dso": "accounts_receivable / nullif(revenue, 0) * 365.0::DOUBLE", "asset_turnover": "revenue / nullif(total_assets, 0)", "capex_revenue": "capex / nullif(revenue, 0)",
}


def _metrics() -> str:
    rows = []
    for i, (k, title, formula, unit, hint, ok, warn, smaller) in enumerate(RATIOS, 1):
        op = "<=" if smaller else ">="
        status = f"CASE WHEN v IS NULL THEN 'na' WHEN v {op} {ok} THEN 'ok' WHEN v {op} {warn} THEN 'warn' ELSE 'risk' END"
        number = "printf('%.2f%%', v * 100)" if unit == "%" else "printf('%.0f дн.', v)" if k == "dso" else "printf('%.2f', v)"
        rows.append(f"SELECT doc_id, {i} AS ord, {_q(k)} AS metric, {_q(title)} AS title, {_q(formula)} AS formula, {_q(unit)} AS unit, {_q(hint)} AS hint, v AS value, {status} AS status, coalesce({number}, '—') AS display FROM (SELECT doc_id, {_PARTS[k]} AS v FROM best)")
    return f"metrics AS ({' UNION ALL '.join(rows)})"


METRIC_ROWS = _metrics()
METRICS = f"{BEST}, {METRIC_ROWS}"
_rules = [f"CASE WHEN {f} IS NULL THEN {_q(MISSING.format(f))} END" for f in ("revenue", "net_profit", "total_assets", "equity")] + [
    f"CASE WHEN current_assets IS NOT NULL AND current_liabilities IS NULL THEN {_q(NO_LIABILITIES)} END",
    f"CASE WHEN profit_from_sales IS NULL THEN {_q(NO_SALES_PROFIT)} END",
    f"CASE WHEN current_assets IS NOT NULL AND current_liabilities IS NOT NULL AND inventories IS NULL THEN {_q(NO_INVENTORIES)} END",
]
WARNINGS = f"warned AS (SELECT doc_id, unnest(range(len(w)))::INTEGER AS ord, unnest(w) AS warning FROM (SELECT doc_id, list_filter([{', '.join(_rules)}], lambda x: x IS NOT NULL) AS w FROM best))"
_sign = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNS.items()) + " ELSE '⚪' END"

_BREAK = r"\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}\x1C-\x1E]"
LINES = f"""split AS (SELECT result_id AS doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT result_id, regexp_split_to_array(plain_text, '{_BREAK}') AS p FROM {_newest("parser_result", "result_id")} WHERE plain_text IS NOT NULL)),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM (SELECT doc_id, i, {_strip("raw")} AS line FROM split) WHERE line <> '')"""
_PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _number(x: str) -> str:
    s = f"replace(replace(replace({_strip(x)}, chr(160), ''), ' ', ''), ',', '.')"
    inner = lambda v: f"regexp_replace(regexp_replace(regexp_replace({v}, '^\\((.*)\\)$', '\\1', 's'), '%$', ''), '^{_WS}+|{_WS}+$', '', 'g')"
    value = f"CASE WHEN regexp_full_match({inner(s)}, '{_PLAIN}') THEN try_cast({inner(s)} AS DOUBLE) END"
    return f"CASE WHEN {s} NOT IN ('', '-', '—', '-—') THEN CASE WHEN {s} LIKE '(%)' THEN -({value}) ELSE {value} END END"


_FIND = rf"\(?{_WS}*[\p{{Nd}}{_WSC}]{{1,20}}(?:[,.]\p{{Nd}}+)?{_WS}*\)?"


def _numbers(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{_FIND}'), lambda c: {_number('c')}), lambda v: v IS NOT NULL AND abs(v) > 1e-9)"


_NUMS = _numbers("line")
_YEARS = r"list_filter(regexp_extract_all(line, '[\p{L}\p{N}\p{M}\p{Pc}]+'), lambda w: regexp_full_match(w, '20[0-9]{2}'))"
_COLS = f"list_filter(list_transform(regexp_split_to_array(line, '{_WS}{{2,}}|\\t'), lambda c: {_strip('c')}), lambda c: c <> '')"
BLOCK_LINES = f"""split AS (SELECT doc_id, page_number, block_no, block_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT *, regexp_split_to_array(content, '{_BREAK}') AS p FROM {_newest("blocks", "block_id")} WHERE content IS NOT NULL AND doc_id IS NOT NULL)),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_no, block_id, i) AS line_no, line FROM (SELECT *, {_strip("raw")} AS line FROM split) WHERE line <> '')"""
#: The year columns in force at every line: header and page lines are folded one after another.
CONTEXT = f"""seen AS (SELECT doc_id, line_no, line, lower(line) AS low, list_transform({_YEARS}, lambda w: w::INTEGER) AS y, {_NUMS} AS n FROM lines),
told AS (SELECT *, len(y) >= 2 AND (len(n)::INT - len(y)::INT <= 1 OR low LIKE '%год%' OR low LIKE '%г.%') AS header, low LIKE '%страница%' OR low LIKE '%page%' AS brk FROM seen),
event AS (SELECT doc_id, line_no, CASE WHEN header THEN y ELSE []::INTEGER[] END AS yy, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM told WHERE header OR brk),
fold AS (SELECT doc_id, k, line_no, yy AS ctx FROM event WHERE k = 1 UNION ALL SELECT e.doc_id, e.k, e.line_no, list_filter(e.yy, lambda v: NOT list_contains(f.ctx, v)) FROM fold f JOIN event e ON e.doc_id = f.doc_id AND e.k = f.k + 1),
placed AS (SELECT t.doc_id, t.line_no, t.line, t.low, t.n, coalesce(f.ctx, []::INTEGER[]) AS ctx FROM told t ASOF LEFT JOIN fold f ON t.doc_id = f.doc_id AND t.line_no >= f.line_no WHERE NOT t.header)"""
_VALUE = f"""celled AS (SELECT *, {_COLS} AS cols FROM placed), firsts AS (SELECT *, list_transform(cols, lambda q: {_numbers("q")}[1]) AS f FROM celled),
cut AS (SELECT *, CASE WHEN f[1] IS NULL THEN f[2:] ELSE f END AS cells, list_position(ctx, list_max(ctx)) AS pos, list_filter(n, lambda v: len(list_filter(ctx, lambda y: v >= y AND v < y + 1)) = 0) AS other FROM firsts),
flat AS (SELECT *, list_filter(cells, lambda v: v IS NOT NULL) AS known, CASE WHEN len(ctx) > 0 AND len(other) > 0 THEN other ELSE n END AS kept FROM cut),
valued AS (SELECT doc_id, line_no, low, coalesce(CASE WHEN len(cols) >= 2 AND len(known) > 0 THEN coalesce(CASE WHEN len(ctx) > 0 AND len(ctx) <= len(cells) THEN cells[pos] END, known[-1]) END, CASE WHEN len(ctx) > 0 THEN kept[pos] END, kept[1]) AS value FROM flat)"""


_last = ", ".join("arg_max(value, line_no) FILTER (WHERE value IS NOT NULL AND (" + " OR ".join(f"contains(low, {_q(p)})" for p in PHRASES[f]) + f")) AS {f}" for f in FIELDS)
#: Facts of every document of ``lines``, with its number of lines.
FACTS = f"{CONTEXT}, {_VALUE}, facts AS (SELECT d.doc_id, d.n_lines, {', '.join('b.' + f for f in FIELDS)} FROM (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) d LEFT JOIN (SELECT doc_id, {_last} FROM valued GROUP BY doc_id) b USING (doc_id))"


def _facts_of(lines: str) -> str:
    return f"WITH RECURSIVE {lines}, {FACTS} SELECT * EXCLUDE (n_lines) FROM facts"


_METHOD = "CASE WHEN method IN ('surya_ocr', 'pdfplumber', 'pymupdf') THEN method WHEN method = 'surya' THEN 'surya_ocr' ELSE 'fallback' END"
_FILLED = "length(trim(text)) > 0"
PAGES = f"""cand AS (SELECT doc_id, page_number, {_METHOD} AS method, coalesce(string_agg(content, chr(10) ORDER BY block_no, block_id), '') AS text FROM {_newest("blocks", "block_id")} WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3),
conf AS (SELECT *, CASE method WHEN 'pdfplumber' THEN CASE WHEN {_FILLED} THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END WHEN 'pymupdf' THEN CASE WHEN {_FILLED} THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.6::DOUBLE + 0.0371::DOUBLE * (page_number % 5) END AS confidence FROM cand),
ranked AS (SELECT *, CASE WHEN NOT {_FILLED} THEN 9 WHEN method = 'surya_ocr' THEN CASE WHEN confidence >= 0.7 THEN 0 ELSE 9 END WHEN method = 'pdfplumber' THEN 1 WHEN confidence >= 0.85 THEN 2 ELSE 3 END AS r FROM conf),
pages AS (SELECT doc_id, page_number, CASE WHEN r < 9 THEN method ELSE 'fallback' END AS method, CASE WHEN r < 9 THEN text ELSE '' END AS text, CASE WHEN r < 9 THEN confidence ELSE 0 END AS confidence, r < 9 AS extracted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY r, confidence DESC, CASE method WHEN 'pymupdf' THEN 1 ELSE 2 END, method) AS k FROM ranked) WHERE k = 1)"""
_pagescore = " + ".join(f"contains(t, {_q(k)})::INTEGER" for k in KEYWORDS) + " - CASE WHEN " + " OR ".join(f"contains(t, {_q(w)})" for w in PENALTY_WORDS) + f" THEN {PENALTY} ELSE 0 END"
_known = ("profit_from_sales", "revenue", "net_profit", *FIELDS[3:])
_keyword = " UNION ALL ".join(f"SELECT doc_id, {_q(f)} AS field FROM lines WHERE " + " OR ".join(f"contains(lower(line), {_q(p)})" for p in PHRASES[f]) for f in FIELDS)
_inner = "regexp_replace(CASE WHEN regexp_full_match(w, '\\(.*\\)|\\[.*\\]', 's') THEN substr(w, 2, length(w) - 2) ELSE w END, '" + _WS + "+', '', 'g')"
_bal = BALANCE

_MEMBERS = "CASE json_type(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda x: '$[' || x || ']') WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: '$.\"' || k || '\"') ELSE []::VARCHAR[] END"
_NODE = "v, path, parent, arr, json_type(v) = 'OBJECT' AND (json_type(v, '$.type') IS NOT NULL OR json_type(v, '$.content') IS NOT NULL) AS block"
NODES = f"""WITH RECURSIVE given AS (SELECT DISTINCT result_id, pages FROM parser_result WHERE json_valid(pages)),
text AS (SELECT result_id, CASE WHEN json_type(pages) = 'VARCHAR' THEN json_extract_string(pages, '$') ELSE pages END AS t FROM given),
root AS (SELECT result_id, CASE json_type(t) WHEN 'ARRAY' THEN t::JSON WHEN 'OBJECT' THEN CASE WHEN json_type(t, '$.pages') = 'ARRAY' THEN json_extract(t, '$.pages') WHEN json_type(t, '$.structured') = 'ARRAY' THEN json_extract(t, '$.structured') END END AS a FROM text WHERE json_valid(t)),
page AS (SELECT result_id, i, json_extract(a, '$[' || i || ']') AS v FROM (SELECT result_id, a, unnest(range(json_array_length(a)::BIGINT)) AS i FROM root WHERE a IS NOT NULL) WHERE json_type(a, '$[' || i || ']') <> 'NULL'),
start AS (SELECT result_id, json_extract(v, p) AS v, i::VARCHAR || CASE WHEN json_type(v) = 'ARRAY' THEN '.' || regexp_extract(p, '[0-9]+') ELSE '' END AS path, i::VARCHAR AS parent, json_type(v) = 'ARRAY' AS arr FROM (SELECT *, unnest({_MEMBERS}) AS p FROM page)
UNION ALL SELECT result_id, v, i || '.0', i::VARCHAR, true FROM page WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT')),
walk AS (SELECT result_id, {_NODE} FROM start UNION ALL
SELECT result_id, {_NODE} FROM (SELECT result_id, json_extract(v, p) AS v, own || CASE WHEN json_type(v) = 'ARRAY' THEN '.' || regexp_extract(p, '[0-9]+') ELSE '' END AS path, CASE WHEN block THEN own ELSE parent END AS parent, json_type(v) = 'ARRAY' AS arr
FROM (SELECT *, CASE WHEN block AND NOT arr THEN path || '.0' ELSE path END AS own, unnest({_MEMBERS}) AS p FROM walk))),
seen AS (SELECT *, CASE WHEN block AND NOT arr THEN path || '.0' ELSE path END AS own, arr AND json_type(v) = 'VARCHAR' AS bare FROM walk)"""

NODE_LINES = f"""nodes AS ({NODES} SELECT result_id, list_transform(string_split(own, '.'), lambda x: x::INTEGER) AS place, CASE WHEN block THEN v->>'$.content' ELSE v->>'$' END AS content FROM seen WHERE block OR bare),
node_split AS (SELECT result_id, place, content, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT *, regexp_split_to_array(content, '{_BREAK}') AS p FROM nodes WHERE content IS NOT NULL)),
node_lines AS (SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY place, md5(content), i) AS line_no, line FROM (SELECT *, {_strip("raw")} AS line FROM node_split) WHERE line <> '')"""
#: Both readings of every report: lines by reading and document, facts, scores, the choice.
CHOSEN = f"""{NODE_LINES},
parses AS {_newest("parser_result", "result_id")},
text_split AS (SELECT result_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT result_id, regexp_split_to_array(plain_text, '{_BREAK}') AS p FROM parses WHERE plain_text IS NOT NULL)),
flat_split AS (SELECT doc_id, page_number, block_no, block_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT *, regexp_split_to_array(content, '{_BREAK}') AS p FROM {_newest("blocks", "block_id")} WHERE content IS NOT NULL AND doc_id IS NOT NULL)),
lines AS (SELECT 's parse ' || result_id AS doc_id, line_no, line FROM node_lines
UNION ALL SELECT 'p parse ' || result_id, row_number() OVER (PARTITION BY result_id ORDER BY i), line FROM (SELECT *, {_strip("raw")} AS line FROM text_split) WHERE line <> ''
UNION ALL SELECT 's ' || doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_no, block_id, i), line FROM (SELECT *, {_strip("raw")} AS line FROM flat_split) WHERE line <> ''),
{FACTS}, counted AS (SELECT *, ({_score})::INTEGER AS score FROM facts),
latest AS (SELECT doc_id, 'parse ' || result_id AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(success, false) DESC, ingested_at DESC, result_id DESC) AS _n FROM parses WHERE doc_id IS NOT NULL) WHERE _n = 1),
docs AS (SELECT doc_id, k FROM latest UNION ALL SELECT DISTINCT doc_id, doc_id FROM blocks WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM latest)),
paired AS (SELECT d.doc_id, coalesce(s.score, p.score, 0) AS score_structured, coalesce(p.score, 0) AS score_plain, coalesce(s.n_lines, p.n_lines, 0) AS rows_structured, coalesce(p.n_lines, 0) AS rows_plain, s.doc_id AS sk, p.doc_id AS pk FROM docs d LEFT JOIN counted s ON s.doc_id = 's ' || k LEFT JOIN counted p ON p.doc_id = 'p ' || k),
best AS (SELECT c.doc_id, CASE WHEN score_plain > score_structured THEN 'plain' ELSE 'structured' END AS strategy, CASE WHEN score_plain > score_structured THEN rows_plain ELSE rows_structured END AS line_count, score_structured, score_plain, rows_structured, rows_plain, {", ".join("f." + f for f in FIELDS)}
FROM paired c LEFT JOIN counted f ON f.doc_id = CASE WHEN score_plain > score_structured THEN pk ELSE coalesce(sk, pk) END)"""

def _cell(q: str) -> str:
    """A number cell with its thousands apart."""
    inner = f"replace(CASE WHEN {q} LIKE '(%)' AND length({q}) > 1 THEN substr({q}, 2, length({q}) - 2) ELSE {q} END, ' ', '')"
    sep = f"CASE WHEN contains({inner}, '.') THEN '.' ELSE ',' END"
    whole, part = f"split_part({inner}, {sep}, 1)", f"substr({inner}, length(split_part({inner}, {sep}, 1)) + 2)"
    shown = f"trim(reverse(regexp_replace(reverse({whole}), '([0-9]{{3}})', '\\1 ', 'g'))) || CASE WHEN {part} <> '' THEN '.' || {part} ELSE '' END"
    return f"(CASE WHEN regexp_full_match(replace({inner}, ',', '.'), '{_PLAIN}') THEN CASE WHEN {q} LIKE '(%)' AND length({q}) > 1 THEN '(' || {shown} || ')' ELSE {shown} END ELSE {inner} END)"


ORACLES: dict[str, str] = {
    "strategy_pick": f"WITH {BEST} SELECT doc_id, strategy, score, fact_id FROM best",
    "report_metrics": f"WITH {METRICS} SELECT doc_id, metric, value, status FROM metrics",
    "metric_displays": f"WITH {METRICS} SELECT doc_id, metric, display FROM metrics",
    "report_warnings": f"WITH {BEST}, {WARNINGS} SELECT * FROM warned",
    "report_coefficients": f"WITH {METRICS} SELECT doc_id, title, round(CASE WHEN unit = '%' THEN value * 100 ELSE value END, 4) AS coefficient FROM metrics WHERE value IS NOT NULL",
    "facts_summary": f"WITH {BEST} SELECT doc_id, coalesce(nullif(concat_ws('; ', {', '.join(f'{_q(f + chr(61))} || {f}::VARCHAR' for f in _known)}), ''), 'данные не извлечены') AS summary FROM best",
    "metrics_prompt": f"WITH {METRICS} SELECT doc_id, string_agg('- ' || title || ': ' || display || ' (' || status || ') — ' || hint, chr(10) ORDER BY ord) AS prompt FROM metrics GROUP BY doc_id",
    "report_rows": f"""WITH {METRICS}, {WARNINGS}, docs AS (SELECT b.doc_id, coalesce(f.file_name, '—') AS file_name FROM best b LEFT JOIN {_newest("filings", "doc_id")} f USING (doc_id))
SELECT doc_id, 1 AS section, 0 AS ord, {_q(TITLE)} AS text FROM docs UNION ALL SELECT doc_id, 2, 0, 'Файл: ' || file_name FROM docs UNION ALL SELECT doc_id, 2, 1, 'Дата: 2026-01-01' FROM docs
UNION ALL SELECT DISTINCT doc_id, 3, 0, 'Предупреждения' FROM warned UNION ALL SELECT doc_id, 3, ord + 1, '• ' || warning FROM warned UNION ALL SELECT doc_id, 4, 0, {_q(' | '.join(HEADS))} FROM docs
UNION ALL SELECT doc_id, 4, ord, {_sign} || ' | ' || title || ' | ' || display || ' | ' || formula FROM metrics""",
    "preview_rows": f"WITH {METRICS} SELECT doc_id, ord, title, display FROM metrics UNION ALL SELECT doc_id, 0, {_q(_bal[1])}, {_q(_bal[3])} FROM best",
    "parse_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "line_numbers": f"WITH {LINES}, n AS (SELECT doc_id, line_no, {_NUMS} AS v FROM lines) SELECT doc_id, line_no, len(v)::INTEGER AS n, round(coalesce(list_sum(v), 0), 3)::DOUBLE AS total FROM n",
    "line_years": f"WITH {LINES} SELECT doc_id, line_no, unnest({_YEARS})::INTEGER AS year FROM lines",
    "line_columns": f"WITH {LINES} SELECT doc_id, line_no, array_to_string({_COLS}, '¦') AS cells FROM lines",
    "keyword_lines": f"WITH {LINES} SELECT doc_id, field, count(*) AS n_lines FROM ({_keyword}) GROUP BY 1, 2",
    "year_headers": f"""WITH {LINES}, t AS (SELECT doc_id, lower(line) AS low, {_YEARS} AS y, {_NUMS} AS n FROM lines)
SELECT doc_id, count(*) FILTER (WHERE len(y) >= 2 AND (len(n)::INT - len(y)::INT <= 1 OR low LIKE '%год%' OR low LIKE '%г.%')) AS n_headers, count(*) FILTER (WHERE low LIKE '%страница%' OR low LIKE '%page%') AS n_breaks FROM t GROUP BY doc_id""",
    "year_context": f"WITH RECURSIVE {LINES}, {CONTEXT} SELECT doc_id, line_no, array_to_string(ctx, ',') AS context FROM placed",
    "plain_facts": _facts_of(LINES),
    "structured_facts": _facts_of(BLOCK_LINES),
    "analysis": f"""WITH RECURSIVE {CHOSEN}, {METRIC_ROWS}, {WARNINGS} SELECT b.doc_id, n.file_name, '2026-01-01' AS date, m.n_coefficients, coalesce(w.warnings, '') AS warnings, m.statuses, b.strategy, 'parse_financial_pdf' AS processor, b.line_count, b.score_structured, b.score_plain, -1 AS score_direct, b.rows_structured, b.rows_plain, {", ".join("b." + f for f in FIELDS)}
FROM best b JOIN (SELECT doc_id, count(value)::INTEGER AS n_coefficients, string_agg(status, ',' ORDER BY ord) AS statuses FROM metrics GROUP BY doc_id) m USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(warning, chr(10) ORDER BY ord) AS warnings FROM warned GROUP BY doc_id) w USING (doc_id) LEFT JOIN {_newest("filings", "doc_id")} n USING (doc_id)""",
    "record_lines": f"WITH RECURSIVE {NODE_LINES} SELECT * FROM node_lines",
    "preview_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE line_no <= 80",
    "block_kinds": f"SELECT block_id, CASE WHEN length(content) < 100 AND upper(content) = content AND lower(content) <> content THEN 'heading' WHEN contains(content, '### TABLE') OR contains(content, '|') THEN 'table' ELSE 'text' END AS kind FROM {_newest('blocks', 'block_id')} WHERE content IS NOT NULL",
    "plain_markup": r"SELECT doc_id, regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', ' ', 'g'), '</?[\p{L}\p{N}\p{M}\p{Pc}]+[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' {2,}', ' ', 'g') AS text FROM documents",
    "text_chunks": "SELECT doc_id, (i // 500)::INTEGER AS chunk_idx, substring(text, i + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS i FROM documents WHERE length(text) > 0)",
    "resolved_pages": f"WITH {PAGES} SELECT doc_id, page_number, method, confidence, extracted, length(text)::INTEGER AS n_chars FROM pages",
    "page_summary": f"""WITH {PAGES} SELECT doc_id, count(*)::INTEGER AS total_pages, count(*) FILTER (WHERE extracted)::INTEGER AS extracted_pages, round(count(*) FILTER (WHERE extracted) * 100.0::DOUBLE / count(*), 1) AS coverage_percent, coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (WHERE extracted), '') AS methods,
sum(CASE WHEN extracted THEN length(text) ELSE 0 END)::BIGINT AS total_chars, sum(CASE WHEN extracted THEN len(regexp_extract_all(text, '### TABLE')) ELSE 0 END)::BIGINT AS total_tables, round(coalesce(avg(confidence) FILTER (WHERE extracted), 0), 2) AS avg_confidence FROM pages GROUP BY doc_id""",
    "joined_pages": f"WITH {PAGES} SELECT doc_id, string_agg('[[PAGE:' || page_number || ']]' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS text FROM pages GROUP BY doc_id",
    "page_ranking": f"WITH s AS (SELECT doc_id, page_number, ({_pagescore})::INTEGER AS score FROM (SELECT doc_id, page_number, lower(string_agg(content, ' ' ORDER BY block_no, content)) AS t FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2)), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number)::INTEGER AS rank FROM s WHERE score > 0) SELECT doc_id, page_number, score, rank FROM k WHERE rank <= 5",
    "table_regions": f"""WITH l AS (SELECT block_id, (unnest(generate_series(1, len(p))) - 1)::INTEGER AS line_no, regexp_replace(unnest(p), '[^0-9 .,()|=\\-]', '', 'g') AS line FROM (SELECT block_id, string_split(content, chr(10)) AS p FROM {_newest("blocks", "block_id")} WHERE content IS NOT NULL)),
f AS (SELECT *, regexp_matches(translate(line, '|-=', '   '), '[0-9]') AS is_row FROM l), g AS (SELECT *, line_no - sum(is_row::INT) OVER (PARTITION BY block_id ORDER BY line_no) AS island FROM f),
r AS (SELECT block_id, line_no, min(line_no) OVER w AS region, count(*) OVER w AS n FROM g WHERE is_row WINDOW w AS (PARTITION BY block_id, island)) SELECT block_id, line_no, region FROM r WHERE n >= 2""",
    "reading_order": f"SELECT doc_id, page_number, block_id, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y IS NULL, floor(y / 10.0), (block_no * 37) % 200, block_id)::INTEGER AS ord FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL",
    "grouped_lines": f"""WITH RECURSIVE i AS (SELECT doc_id, page_number, y, x, text, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y IS NULL, floor(y / 10.0), x, block_id) AS k FROM (SELECT *, ((block_no * 37) % 200)::DOUBLE AS x, coalesce(content, '') AS text FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL)),
f AS (SELECT doc_id, page_number, k, 1 AS line_no, y, x, text FROM i WHERE k = 1 UNION ALL
SELECT doc_id, page_number, k, CASE WHEN same AND NOT far THEN n ELSE n + 1 END, CASE WHEN same AND far THEN sy WHEN same THEN sy * 0.7::DOUBLE + y * 0.3::DOUBLE ELSE y END, CASE WHEN same AND NOT far THEN sx ELSE x END, CASE WHEN same AND NOT far THEN st || '  ' || text ELSE text END
FROM (SELECT i.*, f.line_no AS n, f.y AS sy, f.x AS sx, f.text AS st, coalesce(abs(i.y - f.y) <= 6, false) AS same, abs(i.x - f.x) > 100 AS far FROM f JOIN i ON i.doc_id = f.doc_id AND i.page_number IS NOT DISTINCT FROM f.page_number AND i.k = f.k + 1))
SELECT doc_id, page_number, line_no, text, y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, line_no ORDER BY k DESC) AS r FROM f) WHERE r = 1""",
    "page_lines": f"""WITH RECURSIVE i AS (SELECT doc_id, page_number, y, t, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y IS NULL, y, x, block_id) AS k FROM (SELECT *, {_strip("content")} AS t, (block_no * 37) % 200 AS x FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL AND content IS NOT NULL) WHERE t <> ''),
f AS (SELECT doc_id, page_number, k, y, t FROM i WHERE k = 1 UNION ALL
SELECT i.doc_id, i.page_number, i.k, CASE WHEN coalesce(abs(i.y - f.y) <= 6, false) THEN f.y * 0.7::DOUBLE + i.y * 0.3::DOUBLE ELSE i.y END, f.t || CASE WHEN coalesce(abs(i.y - f.y) <= 6, false) THEN ' ' ELSE chr(10) END || i.t FROM f JOIN i ON i.doc_id = f.doc_id AND i.page_number IS NOT DISTINCT FROM f.page_number AND i.k = f.k + 1)
SELECT doc_id, page_number, regexp_replace({_strip("regexp_replace(t, '[ ' || chr(9) || ']{2,}', ' ', 'g')")}, '<br ?/?>', ' ', 'g') AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k DESC) AS r FROM f) WHERE r = 1""",
    "repaired_tables": f"""WITH l AS (SELECT block_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS line FROM (SELECT block_id, string_split(content, chr(10)) AS p FROM {_newest("blocks", "block_id")} WHERE content IS NOT NULL)),
f AS (SELECT *, translate(line, '|-=', '   ') AS bare, regexp_full_match(trim(translate(line, '|-=', '   ')), '[0-9 .,()\\-]*[0-9][0-9 .,()\\-]*') AS is_row FROM l), g AS (SELECT *, n - sum(is_row::INT) OVER (PARTITION BY block_id ORDER BY n) AS island FROM f),
r AS (SELECT *, CASE WHEN is_row AND count(*) OVER w >= 2 THEN min(n) OVER w END AS region FROM g WINDOW w AS (PARTITION BY block_id, is_row, island)),
c AS (SELECT *, CASE WHEN region IS NOT NULL THEN regexp_extract_all(bare, '[0-9.,()]+(?: [0-9][0-9.,()]*)*') END AS cells FROM r), m AS (SELECT *, max(len(cells)) OVER (PARTITION BY block_id, region) AS width FROM c),
d AS (SELECT block_id, n, CASE WHEN region IS NULL THEN CASE WHEN regexp_matches(line, '\\p{{Nd}}') THEN {_strip("regexp_replace(line, '[ ' || chr(9) || ']{2,}', ' ', 'g')")} ELSE line END
ELSE rtrim(array_to_string(list_transform(list_resize(cells, width, ''), lambda q: CASE WHEN length({_cell("q")}) < 15 THEN lpad({_cell("q")}, 15, ' ') ELSE {_cell("q")} END), ' | ')) END AS done FROM m)
SELECT block_id, string_agg(done, chr(10) ORDER BY n) AS text FROM d GROUP BY block_id""",
    "json_replies": "SELECT event_id, json_extract_string(regexp_extract('Sure: ' || props || ' done', '\\{.*\\}'), '$.k') AS k FROM events",
    "first_wins": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1",
    "last_wins": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1",
    "distinct_sources": "SELECT source, min(doc_id) AS first FROM documents GROUP BY source",
    "display_numbers": f"SELECT fact_id, coalesce(translate(format('{{:,.2f}}', revenue), ',.', ' ,'), 'N/A') AS shown FROM {_newest('financial_facts', 'fact_id')}",
    "mixed_numbers": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, regexp_extract(line, '([^\\t-\\r ]+)$', 1) AS w FROM lines), i AS (SELECT *, {_inner} AS s FROM w),
m AS (SELECT *, CASE WHEN s LIKE '%,%' AND s LIKE '%.%' THEN CASE WHEN strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END ELSE replace(s, ',', '.') END AS t FROM i)
SELECT doc_id, line_no, CASE WHEN regexp_full_match(t, '{_PLAIN}') THEN CASE WHEN regexp_full_match(w, '\\(.*\\)|\\[.*\\]') THEN -try_cast(t AS DOUBLE) ELSE try_cast(t AS DOUBLE) END END AS value FROM m""",
    "recommendation_texts": f"""WITH r AS (SELECT rec_id, recommendations AS t, CASE WHEN json_valid(recommendations) AND json_type(recommendations) = 'ARRAY' THEN json_extract(recommendations, '$[*]') END AS a FROM {_newest("recommendations", "rec_id", "created_at")})
SELECT rec_id, CASE WHEN a IS NULL THEN t WHEN json_type(a[1]) = 'OBJECT' THEN array_to_string(list_transform(a, lambda x, i: i || '. ' || coalesce(x->>'параметр', 'Рекомендация ' || i) || chr(10) || '   Рекомендация: ' || coalesce(x->>'рекомендация', '') || chr(10)
|| CASE WHEN coalesce(x->>'значение', '') <> '' THEN '   Текущее значение: ' || (x->>'значение') || chr(10) ELSE '' END || CASE WHEN coalesce(x->>'норма', '') <> '' THEN '   Норма: ' || (x->>'норма') || chr(10) ELSE '' END), chr(10)) ELSE array_to_string(list_transform(a, lambda x: x->>'$'), chr(10)) END AS text FROM r""",
    "merged_replies": f"""WITH r AS (SELECT rec_id, recommendations AS t, regexp_extract(recommendations, '(?s)(\\{{.*\\}}|\\[.*\\])', 1) AS s FROM {_newest("recommendations", "rec_id", "created_at")}), v AS (SELECT rec_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(s) THEN s END AS v FROM r),
o AS (SELECT rec_id, CASE json_type(v) WHEN 'OBJECT' THEN [v::JSON] WHEN 'ARRAY' THEN list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT') ELSE [] END AS o FROM v)
SELECT rec_id, len(list_distinct(flatten(list_transform(o, lambda x: json_keys(x)))))::INTEGER AS n, list_filter(o, lambda x: json_exists(x, '$."параметр"'))[-1]->>'параметр' AS parameter, list_filter(o, lambda x: json_exists(x, '$."норма"'))[-1]->>'норма' AS norm FROM o""",
    "extracted_keys": "WITH c AS (SELECT doc_id, i, substring(text, i + 1, 6000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 6000)) AS i FROM documents WHERE length(text) > 0)), k AS (SELECT doc_id, i, name, replace(nullif(regexp_extract(chunk, '(?i)' || name || '[^0-9]{0,20}?([0-9]+(?:[.,][0-9]+)?)', 1), ''), ',', '.') AS v FROM c, (SELECT unnest(['EBITDA', 'выручка', 'net profit']) AS name)) SELECT doc_id, name, arg_min(v, i) FILTER (WHERE v IS NOT NULL) AS value FROM k GROUP BY 1, 2",
    "page_texts": f"SELECT doc_id, page_number, string_agg(content, ' ' ORDER BY block_no, content) AS text FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2",
    "block_chunks": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_no, block_id) - 1)::INTEGER AS chunk_idx, content AS chunk FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL AND content IS NOT NULL",
    "joined_contents": f"SELECT doc_id, string_agg(content, ' ' ORDER BY page_number, block_no, block_id) AS text FROM {_newest('blocks', 'block_id')} WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY 1",
    "p5_found": NODES + " SELECT result_id, i::VARCHAR AS node_path, '' AS parent_path, 'page' AS node_kind FROM page UNION ALL SELECT DISTINCT result_id, own, parent, 'block' FROM seen WHERE block OR bare",
    "p5_pages": NODES + """ SELECT result_id, i::VARCHAR AS node_path, (v->>'$.page_number')::INTEGER AS page_number, v->>'$.method' AS method, (v->>'$.confidence')::DOUBLE AS confidence, (v->>'$.char_count')::BIGINT AS char_count, v->>'$.error' AS error FROM page""",
    "p5_blocks": NODES + """ SELECT result_id, own AS node_path, parent AS parent_path, split_part(own, '.', 1) AS page_path, CASE WHEN block THEN v->>'$.type' END AS type, CASE WHEN block THEN v->>'$.content' ELSE v->>'$' END AS content, CASE WHEN block THEN (v->>'$.y')::DOUBLE END AS y FROM seen WHERE block OR bare""",
}
