"""Queries of news, financials, comments, report rows and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import indicators as ind
from ..functions import scalars as sc
from ..operators import comments, financials, joins, news, ranking, scans, universe
from ..plans.features import features, numbered
from ..scratch import scratch_path, stored
from ..sources import readers, sinks
from . import ORACLES, query
from .bars import CANDLE, near_sql
from .derived import FEATS, LISTING, OVER, THEMES, lag_sql, listing, panel, projected_sql, supplier_code, table, themes
from .screens import C1, C5, REVIEW, W, c1, c5, candle_sql, j6_overview, review


def news_files(spark, sf_dir):
    """A markdown file for each document: a category, a header of two stocks, the text, a later category."""
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyy.MM.dd")
    path = F.concat(F.lit("/news/"), F.when(F.col("doc_id") % 3 == 0, F.lit("evening")).otherwise(day), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    stock = lambda k: F.concat(F.lit("stock"), ((F.col("doc_id") * k) % 1000).cast("string"))
    text = F.concat(F.lit("date: "), day, F.lit("\n### "), "source", F.lit("\n#### "), stock(1), F.lit(" (+1.5%), "), stock(3), F.lit(" (-2%)\n"), F.coalesce("text", F.lit("")), F.lit("\n### later\n"))
    return d.select(path.alias("path"), text.alias("text"), "doc_id")


def stock_names(spark, sf_dir):
    """Names of the suppliers in credit, aliases of the others."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("stock"), (F.col("s_suppkey") - 1).cast("string")).alias("name"), supplier_code().alias("code"), F.col("s_suppkey").alias("pos"), "s_acctbal")
    return s.where("s_acctbal >= 0").select("name", "code", "pos"), s.where("s_acctbal < 0").select(F.col("name").alias("alias"), "code")


NEWS = """nf AS (SELECT doc_id, strftime(DATE '2023-01-01' + CAST(doc_id % 700 AS INT), '%Y-%m-%d') AS news_date, source, text,
  array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM documents),
nt AS (SELECT *, unnest([row(doc_id % 1000, '+1.5%'), row((doc_id * 3) % 1000, '-2%')]) AS t FROM nf WHERE length(body) >= 5)"""


@query("SELECT doc_id, strftime(DATE '2023-01-01' + CAST(doc_id % 700 AS INT), '%Y-%m-%d') AS news_date FROM documents")
def n1_news_dates(spark, sf_dir):
    return news.news_dates(news_files(spark, sf_dir)).select("doc_id", "news_date")


@query(f"WITH {NEWS} SELECT news_date, 'category' AS kind, 2 * count(*) AS n FROM nf GROUP BY 1 UNION ALL SELECT news_date, 'header', count(*) FROM nf GROUP BY 1 UNION ALL SELECT news_date, 'body', CAST(sum(len(string_split(body, chr(10)))) AS BIGINT) FROM nf WHERE body <> '' GROUP BY 1")
def n2_news_lines(spark, sf_dir):
    return news.news_lines(news.news_dates(news_files(spark, sf_dir))).groupBy("news_date", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {NEWS} SELECT doc_id, news_date, CAST(1 AS BIGINT) AS block, source AS category, body AS text FROM nf")
def n3_news_blocks(spark, sf_dir):
    blocks = news.news_blocks(news.news_lines(news.news_dates(news_files(spark, sf_dir))))
    return blocks.select(F.regexp_extract("path", r"_(\d+)\.md", 1).cast("long").alias("doc_id"), "news_date", "block", "category", "text")


@query("SELECT doc_id, later.c AS category FROM documents, (SELECT 'later' AS c) later")
def n3_news_blocks_compat(spark, sf_dir):
    blocks = news.news_blocks(news.news_lines(news.news_dates(news_files(spark, sf_dir))), compat=True)
    return blocks.select(F.regexp_extract("path", r"_(\d+)\.md", 1).cast("long").alias("doc_id"), "category")


BLANKS = "[ \\t\\n\\r\\f]+"


def talk_files(spark, sf_dir):
    """A file for each conversation: each turn is a header and its text, every second one is followed by its role as a category."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    line = F.concat(F.lit("#### turn "), F.col("pos").cast("string"), F.lit("\nsaid "), F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " "), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("\n\n### "), F.coalesce("role", F.lit("none")))).otherwise(""))
    lines = turns.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", line.alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("conv_id").agg(whole.alias("text")).select(F.concat(F.lit("/news/2024.05.06_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "text")


LATEST_ROLE = "coalesce(last_value(CASE WHEN pos % 2 = 0 THEN coalesce(role, 'none') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {}), '')"


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL)
SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(pos AS BIGINT) AS block, 'turn ' || pos AS header, rtrim('said ' || regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g')) AS text, {LATEST_ROLE.format('1 PRECEDING')} AS category, {LATEST_ROLE.format('CURRENT ROW')} AS later FROM t"""
)
def n3_news_blocks_of_turns(spark, sf_dir):
    """Several headers a file, and categories between them, by both rules."""
    lines = news.news_lines(news.news_dates(talk_files(spark, sf_dir)))
    later = news.news_blocks(lines, compat=True).select("path", "block", F.col("category").alias("later"))
    rows = news.news_blocks(lines).join(later, ["path", "block"])
    return rows.select(F.regexp_extract("path", r"_([^/]*)\.md", 1).alias("conv"), "block", "header", "text", "category", "later")


@query(f"WITH {NEWS} SELECT doc_id, 'stock' || t[1] AS stock_name, t[2] AS rate FROM nt")
def n4_news_tokens(spark, sf_dir):
    blocks = news.news_blocks(news.news_lines(news.news_dates(news_files(spark, sf_dir)))).where(F.length("text") >= 5)
    return news.news_tokens(blocks).select(F.regexp_extract("path", r"_(\d+)\.md", 1).cast("long").alias("doc_id"), "stock_name", "rate")


ITEMS = f"""{NEWS}, ni AS (SELECT lpad(CAST(t[1] + 1 AS VARCHAR), 6, '0') AS code, news_date, 'stock' || t[1] AS stock_name, source AS category, t[2] AS rate,
  substr(string_split(body, chr(10))[1], 1, 80) AS title, substr(body, 1, 600) AS content,
  CASE WHEN doc_id % 3 = 0 THEN '/news/evening_' ELSE '/news/' || replace(news_date, '-', '.') || '_' END || doc_id || '.md' AS path FROM nt JOIN supplier ON s_suppkey = t[1] + 1),
items AS (SELECT code, news_date, stock_name, category, rate, title, content FROM ni QUALIFY row_number() OVER (PARTITION BY code, news_date, substr(title, 1, 30) ORDER BY path, stock_name, rate) = 1)"""


@query(f"WITH {ITEMS} SELECT * FROM items")
def n5_news_items(spark, sf_dir):
    return news.news_items(news_files(spark, sf_dir), *stock_names(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT code, news_date, base64(encode(title)) AS title FROM items")
def n5_news_items_encoded(spark, sf_dir):
    return news.news_items(news_files(spark, sf_dir), *stock_names(spark, sf_dir), encode=True).select("code", "news_date", "title")


@query(f"WITH {ITEMS} SELECT substr(news_date, 1, 4) AS year, count(*) AS n FROM items GROUP BY 1")
def a3_news_per_year(spark, sf_dir):
    return news.news_per_year(news.news_items(news_files(spark, sf_dir), *stock_names(spark, sf_dir)))


@query(f"WITH {NEWS} SELECT doc_id, lpad(CAST(t[1] + 1 AS VARCHAR), 6, '0') AS code FROM nt JOIN supplier ON s_suppkey = t[1] + 1")
def j11_news_code_join(spark, sf_dir):
    blocks = news.news_blocks(news.news_lines(news.news_dates(news_files(spark, sf_dir)))).where(F.length("text") >= 5)
    rows = joins.news_code_join(news.news_tokens(blocks), *stock_names(spark, sf_dir))
    return rows.select(F.regexp_extract("path", r"_(\d+)\.md", 1).cast("long").alias("doc_id"), "code")


PAGE = r"""(?is)<!--.*?(?:-->|$)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|$)|<[a-z/!?](?:[^>"\']|"[^"]*"|\'[^\']*\')*>|[^<]+|<""".replace("'", "''").replace("\\''", "''")


def headlines_sql(tag: str, fits: str = "true") -> str:
    """CTE heads (page_id, headlines): texts between a fitting tag and the next one of its name; such tags don't nest in these pages."""
    return f"""pt AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{PAGE}') AS l FROM pages)),
pe AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^</?{tag}[\\s/>]') THEN CASE WHEN t[2] <> '/' AND {fits} THEN i ELSE 0 END END AS e FROM pt),
po AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS o FROM pe),
px AS (SELECT page_id, o, trim(replace(replace(string_agg(t, '' ORDER BY i), '&quot;', '"'), '&amp;', '&')) AS x FROM po WHERE o > 0 AND NOT regexp_matches(t, '^<[a-zA-Z/!?]') GROUP BY page_id, o),
heads AS (SELECT page_id, coalesce(list(x ORDER BY o) FILTER (WHERE x <> ''), []) AS headlines FROM pages LEFT JOIN px USING (page_id) GROUP BY page_id)"""


@query(f"WITH {headlines_sql('a')} SELECT page_id, headlines[1:5] AS headlines FROM heads")
def n6_headlines_from_pages(spark, sf_dir):
    return news.headlines_from_pages(table(spark, sf_dir, "pages")).select("page_id", "headlines")


AD = """regexp_matches(t, 'class="([^"]* )?ad( [^"]*)?"')"""


@query(f"WITH {headlines_sql('div', AD)} SELECT page_id, headlines[1:5] AS headlines FROM heads")
def n6_headlines_of_class(spark, sf_dir):
    return news.headlines_from_pages(table(spark, sf_dir, "pages"), "ad", tag="div").select("page_id", "headlines")


@query("""SELECT page_id, list_transform(regexp_extract_all(html, '<a href="[^"]*"')[1:5], lambda x: x[10:-2]) AS headlines FROM pages WHERE html IS NOT NULL""")
def n6_attributes_from_pages(spark, sf_dir):
    """The values of an attribute, as titles are read from anchors."""
    return news.headlines_from_pages(table(spark, sf_dir, "pages").where("html is not null"), attribute="href").select("page_id", "headlines")


@query(
    f"""WITH {FEATS}, {headlines_sql('a')}, p AS (SELECT *, CASE WHEN rate > 20 THEN 1 ELSE 0 END AS e FROM ({C5})), h AS (SELECT lpad(CAST(page_id AS VARCHAR), 6, '0') AS code, headlines[1:5] AS headlines FROM heads)
SELECT p.scan_date AS issue_date, p.code, round_even(p.rate, 2) AS rate, CASE WHEN len(h.headlines) > 0 THEN array_to_string(h.headlines, ' / ') ELSE '뉴스 없음' END AS summary, coalesce(h.headlines, []) AS headlines FROM p LEFT JOIN h USING (code) WHERE e = 0"""
)
def n7_daily_issues(spark, sf_dir):
    heads = news.headlines_from_pages(table(spark, sf_dir, "pages")).withColumn("code", F.lpad(F.col("page_id").cast("string"), 6, "0"))
    picks = c5(spark, sf_dir).withColumn("elapsed_days", F.when(F.col("rate") > 20, 1).otherwise(0))
    return news.daily_issues(picks, heads)


@query(f"WITH {FEATS}, p AS ({C5}) SELECT scan_date, code FROM p WHERE rate <= 20")
def p11_day0_predictive(spark, sf_dir):
    picks = c5(spark, sf_dir).withColumn("elapsed_days", F.when(F.col("rate") > 20, F.lit(None)).otherwise(0))
    return universe.day0_only(universe.predictive_only(picks)).select("scan_date", "code")


LABELS = ("매출액", "수익(매출액)", "영업이익", "당기순이익", "당기순이익(손실)", "자산총계")


def filings(spark, sf_dir):
    """Statement rows from orders: an account for each order of a customer's year."""
    o = table(spark, sf_dir, "orders")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    amount = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return o.select(F.lpad((F.col("o_custkey") % 100).cast("string"), 6, "0").alias("code"), F.year("o_orderdate").alias("year"), F.when(F.col("o_custkey") % 3 == 0, "CFS").otherwise("OFS").alias("fs_div"), F.col("o_orderkey").cast("int").alias("pos"), label.alias("account_nm"), amount.alias("thstrm_amount"))


FILINGS = """filings AS (SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year, CASE WHEN o_custkey % 3 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div, o_orderkey AS pos,
  o_orderkey % 6 AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM orders),
best AS (SELECT * FROM filings f WHERE fs_div = 'CFS' OR (code, year) NOT IN (SELECT (code, year) FROM filings WHERE fs_div = 'CFS'))"""


def pivot_sql(source: str) -> str:
    last = lambda k: f"list(amount ORDER BY pos DESC) FILTER (WHERE k = {k})[1]"
    return f"SELECT code, year, coalesce({last(0)}, {last(1)}) AS revenue, {last(2)} AS operating_profit, coalesce({last(3)}, {last(4)}) AS net_income FROM {source} GROUP BY code, year"


@query(f"WITH {FILINGS} {pivot_sql('filings')}")
def a6_account_pivot(spark, sf_dir):
    return financials.account_pivot(filings(spark, sf_dir))


@query(f"WITH {FILINGS} SELECT code, year, fs_div, CAST(pos AS INT) AS pos FROM best")
def j12_prefer_consolidated(spark, sf_dir):
    return financials.prefer_consolidated(filings(spark, sf_dir)).select("code", "year", "fs_div", "pos")


STATEMENTS = f"{FILINGS}, st AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY year DESC) AS r FROM ({pivot_sql('best')}) WHERE coalesce(revenue, operating_profit, net_income) IS NOT NULL) WHERE r <= 3)"


@query(f"WITH {STATEMENTS} SELECT * EXCLUDE (r) FROM st")
def n9_financial_statement_long(spark, sf_dir):
    return financials.financial_statement_long(filings(spark, sf_dir))


CELL_ROWS = ("매출액", "매출액(증가)", "영업이익", "당기순이익", "자산")


def cells(spark, sf_dir):
    """A table of four rows and three years for each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_suppkey")
    rows = s.select("*", F.posexplode(F.array(*map(F.lit, CELL_ROWS))).alias("row", "label")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))
    value = F.col("s_suppkey") * 10 + F.col("row") * 3 + F.col("col")
    return rows.select("code", "row", "col", "label", F.concat((F.col("col") + 2021).cast("string"), F.lit(".12")).alias("header"), F.when(F.col("s_suppkey") % 5 == F.col("col"), "N/A").otherwise(F.format_number(value, 0)).alias("text"))


def cell_sql(row: int) -> str:
    return f"CASE WHEN s_suppkey % 5 = c THEN NULL ELSE CAST(s_suppkey * 10 + {row * 3} + c AS BIGINT) * 100000000 END"


@query(f"SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, 2021 + c AS year, {cell_sql(0)} AS revenue, {cell_sql(2)} AS operating_profit, {cell_sql(3)} AS net_income FROM supplier, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS c) WHERE s_suppkey % 5 <> c")
def n8_financial_table_long(spark, sf_dir):
    return financials.financial_table_long(cells(spark, sf_dir))


def published(spark, sf_dir):
    """Comments with the faults that the repair knows, one for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("close"))
    text = F.concat(F.lit("전저점(0원), 전고점(0원), "), F.col("close").cast("string"), F.lit(".0원(+1%), "), F.col("o_orderkey").cast("string"), F.lit(".0원으로, 7.0원) 평균 대비 100% 수준으로 상단 상단"))
    return o.withColumn("comment", F.when(F.col("o_orderkey") % 4 == 0, "정상").otherwise(text))


GOOD = "'전저점(' || format('{:,}', CAST(trunc(close * 0.88 / 10) AS BIGINT) * 10) || '원), 전고점(' || format('{:,}', CAST(trunc(close * 1.12 / 10) AS BIGINT) * 10) || '원), ' || format('{:,}', close) || '원(+1%), ' || format('{:,}', o_orderkey) || '원으로, 7원) 평균 대비 충분한 수준으로 상단'"
ORDERS = "o AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS close FROM orders)"


@query(f"WITH {ORDERS} SELECT o_orderkey, o_orderkey % 4 <> 0 AS flag_contains_0won, o_orderkey % 4 <> 0 AS flag_zero_won, false AS flag_full_volume FROM o")
def q1_comment_quality_flags(spark, sf_dir):
    return comments.comment_quality_flags(published(spark, sf_dir)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "flag_contains_0won", "flag_zero_won", "flag_full_volume")


@query(f"WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '정상' ELSE {GOOD} END AS repaired FROM o")
def q2_repair_comment(spark, sf_dir):
    return comments.repair_comment(published(spark, sf_dir)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "repaired")


@query(f"WITH {ORDERS} SELECT count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS repaired FROM o")
def a8_repaired_count(spark, sf_dir):
    return ranking.repaired_count(comments.repair_comment(published(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '가격 ' || doc_id || ' 지지 끝' END AS clean FROM documents")
def q3_clean_generated_text(spark, sf_dir):
    made = F.concat(F.lit("Answer 12, 가격 "), F.col("doc_id").cast("string"), F.lit(" 지지\n**굵은 줄\n[머리]\n 끝 (Support, Upward)\nGuidelines: be short\n"), F.coalesce("text", F.lit("")))
    latin = F.concat(F.lit("No text here Guidelines: "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", comments.clean_generated_text(F.when(F.col("doc_id") % 2 == 0, latin).otherwise(made)).alias("clean"))


def pool_sql(pool: list[str], step: int) -> str:
    return f"[{', '.join(repr(x) for x in pool)}][CAST((seed // {step}) % {len(pool)} AS INT) + 1]"


def won_sql(label: str, x: str) -> str:
    return f"'{label}(' || format('{{:.0f}}', {x}) || '원)'"


FACTS = f"""base AS (SELECT *, coalesce(ret, 0) AS rate, CASE WHEN v20 > 0 THEN volume / v20 * 100 ELSE 100 END AS ratio,
  coalesce(max(high) OVER ({OVER} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING), 0) AS peak,
  CAST(list_sum(list_transform(string_split(code, ''), lambda x: ascii(x))) AS BIGINT) + CAST(close AS BIGINT) % 997 AS seed,
  [row({won_sql('5일선', 'ma5')}, ma5), row({won_sql('20일선', 'ma20')}, ma20), row({won_sql('60일선', 'ma60')}, ma60), row({won_sql('120일선', 'ma120')}, ma120)] AS lines FROM feats),
facts AS (SELECT *, CASE WHEN rate >= 5 AND ratio >= 150 THEN 'surge_up' WHEN rate >= 5 THEN 'up' WHEN rate <= -5 AND ratio >= 150 THEN 'surge_down' WHEN rate <= -5 THEN 'down' WHEN ratio <= 50 THEN 'dry' ELSE 'calm' END AS kind,
  coalesce(list_filter(lines, lambda r: r[2] > 0 AND close >= r[2])[-1][1], {won_sql('전저점', 'low')}) AS support,
  coalesce(list_filter(lines, lambda r: r[2] > 0 AND close < r[2])[1][1], CASE WHEN peak > close THEN {won_sql('전고점', 'peak')} ELSE '상단 이격 저항대' END) AS resistance,
  CASE WHEN ma5 > 0 AND close >= ma5 THEN {won_sql('5일선', 'ma5')} WHEN ma20 > 0 AND close >= ma20 THEN {won_sql('20일선', 'ma20')} WHEN ma60 > 0 AND close >= ma60 THEN {won_sql('60일선', 'ma60')} ELSE {won_sql('전저점', 'low')} END AS buy,
  CASE WHEN NOT coalesce(ma5 > 0 AND close >= ma5, false) AND ma20 > 0 AND close >= ma20 THEN {won_sql('20일선', 'ma20')} ELSE {won_sql('전저점', 'low')} END AS stop FROM base WHERE bar_no >= 25),
goals AS (SELECT *, CASE WHEN peak > close * 1.03 THEN {won_sql('전고점', 'peak')} ELSE resistance END AS goal FROM facts)"""


#: The rate with two digits, ties of its decimal digits to the even one.
HUNDREDTHS = "CAST(CAST(abs(rate) AS VARCHAR) AS DECIMAL(28,17)) * 100"
EVEN_PCT = f"format('{{:+.2f}}%', sign(rate) * (trunc({HUNDREDTHS}) + CASE WHEN ({HUNDREDTHS}) % 1 > 0.5 OR (({HUNDREDTHS}) % 1 = 0.5 AND trunc({HUNDREDTHS}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE + 0.0::DOUBLE)"


def commented(spark, sf_dir):
    f = features(panel(spark, sf_dir), keep_running=True).withColumns({"rate": F.coalesce("ret", F.lit(0.0)), "vol_ratio": ind.volume_ratio(), "former_peak": F.coalesce(ind.former_peak_recent(), F.lit(0.0))})
    return f.where("bar_no >= 25")


@query(f"WITH {FEATS}, {FACTS} SELECT code, dt, kind, support, resistance, buy, stop, goal FROM goals")
def q4_rule_facts(spark, sf_dir):
    return comments.rule_facts(commented(spark, sf_dir)).select("code", "dt", "kind", "support", "resistance", "buy", "stop", "goal")


@query(
    f"""WITH {FEATS}, {FACTS} SELECT code, dt, format('{{:,}}', CAST(close AS BIGINT)) || '원(' || {EVEN_PCT} || '), 거래량 ' || format('{{:.0f}}%', ratio) || '. ' ||
  CASE kind {' '.join(f"WHEN '{k}' THEN {pool_sql(v, 1)}" for k, v in comments.VOLUME_SENTENCES.items())} END || ' ' ||
  replace(replace({pool_sql(comments.SUPPORT_SENTENCES, 3)}, '{{s}}', support), '{{r}}', resistance) || ' ' ||
  replace(replace(replace({pool_sql(comments.TRADE_SENTENCES, 7)}, '{{b}}', buy), '{{x}}', stop), '{{t}}', goal) AS comment FROM goals"""
)
def q4_rule_comment(spark, sf_dir):
    return comments.rule_comment(commented(spark, sf_dir)).select("code", "dt", "comment")


def candles(spark, sf_dir):
    return scans.scan_standard_candle(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None)


def near(spark, sf_dir):
    return scans.scan_near_ma(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None)


ZERO = "format('{:.0f}', %s)"


@query(
    f"""WITH {W}, {candle_sql(500, 30000.0)} SELECT scan_date, code, day_type, CASE
  WHEN day_type = 0 THEN '당일 기준봉: 거래량 ' || {ZERO % 'vol_ratio'} || '%, 내일 3일선(' || {ZERO % 'p3'} || '원) 확인.'
  WHEN day_type = 1 AND close < p3 THEN '3일선(' || {ZERO % 'p3'} || '원) 아래: 저항으로 작용합니다.'
  WHEN day_type = 1 THEN '거래량 ' || {ZERO % 'vol_change_ratio'} || '%로 감소, 3일선(' || {ZERO % 'p3'} || '원) 지지.'
  WHEN day_type = 2 AND close < p8 THEN '8일선(' || {ZERO % 'p8'} || '원) 아래: 관망합니다.'
  WHEN day_type = 2 THEN '거래량 ' || {ZERO % 'vol_change_ratio'} || '%, 8일선(' || {ZERO % 'p8'} || '원) 지지.'
  ELSE '이평선 부근에서 조정을 마쳤습니다.' END AS commentary FROM p500""",
    ints=("day_type",),
)
def q5_rule_comment_candle(spark, sf_dir):
    return comments.rule_comment_candle(candles(spark, sf_dir)).select("scan_date", "code", "day_type", "commentary")


#: Label of a candle's age in SQL.
AGE = "CASE WHEN {0} <= 0 THEN '당일' ELSE {0} || '일차' END"


NEAR = f"""{FEATS}, x AS (SELECT *, {CANDLE} AS cand FROM feats), y AS (SELECT *, max(CASE WHEN cand THEN dt END) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS ref_date,
  coalesce({near_sql('close', 'ma15')} OR {near_sql('low', 'ma15')}, false) AS near15, coalesce({near_sql('close', 'ma20')} OR {near_sql('low', 'ma20')}, false) AS near20,
  coalesce(ma15 > {lag_sql('ma15')}, false) AS up15, coalesce(ma20 > {lag_sql('ma20')}, false) AS up20 FROM x),
nearma AS (SELECT * FROM y WHERE n_bars >= 25 AND ref_date IS NOT NULL AND NOT cand AND (near15 OR near20))"""


@query(
    f"""WITH {NEAR} SELECT dt AS scan_date, code, code || ' (' || ref_date || ') ' || array_to_string(list_filter([
  CASE WHEN near15 THEN '15일선(' || format('{{:.0f}}', round(ma15, 6)) || '원)' || CASE WHEN up15 THEN ' 우상향' ELSE '' END END,
  CASE WHEN near20 THEN '20일선(' || format('{{:.0f}}', round(ma20, 6)) || '원)' || CASE WHEN up20 THEN ' 우상향' ELSE '' END END], lambda x: x IS NOT NULL), ', ') || ' 지지.' AS commentary FROM nearma"""
)
def q6_rule_comment_near_ma(spark, sf_dir):
    return comments.rule_comment_near_ma(near(spark, sf_dir)).select("scan_date", "code", "commentary")


KIND = "CASE WHEN max_profit >= 3 THEN '성공: 최고 ' || format('{:+.1f}%', round_even(max_profit, 1) + 0.0::DOUBLE) WHEN day_return < 0 THEN '조정: ' || format('{:+.1f}%', round_even(day_return, 1) + 0.0::DOUBLE) ELSE '유지: ' || format('{:+.1f}%', round_even(day_return, 1) + 0.0::DOUBLE) END"
TOUCHED = "array_to_string(list_filter([ma_touches, extreme_touches], lambda x: x <> ''), ', ')"


@query(f"WITH {FEATS}, {REVIEW} SELECT review_date, code, {KIND} || CASE WHEN {TOUCHED} = '' THEN '' ELSE ' (' || {TOUCHED} || ')' END AS review FROM review")
def q7_rule_review(spark, sf_dir):
    return comments.rule_review(review(spark, sf_dir)).select("review_date", "code", "review")


@query(
    f"""WITH {FEATS}, {THEMES}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date, strategy ORDER BY abs(rate) DESC, code) AS rank FROM ({C1}))
SELECT p.scan_date, p.strategy, p.rank, p.code, p.close, round_even(p.rate, 2) AS rate, p.pattern AS comment, 'charts/' || strftime(p.scan_date, '%Y%m%d') || '/' || p.code || '.png' AS chart, coalesce(t.category, '기타') AS category FROM p LEFT JOIN themes t USING (code) WHERE rank <= 3""",
    ints=("rank",),
)
def q8_dashboard_rows(spark, sf_dir):
    picks = c1(spark, sf_dir).withColumns({"name": F.col("code"), "comment": F.col("pattern")})
    return comments.dashboard_rows(picks, themes(spark, sf_dir), 3).select("scan_date", "strategy", "rank", "code", "close", "rate", "comment", "chart", "category")


@query(
    f"""WITH {W}, {THEMES}, {candle_sql(500, 30000.0)}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date ORDER BY candle_class DESC, day_type, vol_ratio DESC, code) AS pos, CAST(scan_date - ref_date AS INT) AS age FROM p500)
SELECT p.scan_date, p.pos AS rank, p.code, p.close, round_even(p.rate, 2) AS rate, '500 기준봉 ' || {AGE.format('p.age')} AS pattern, coalesce(t.category, '기타') AS category, coalesce(t.subthemes[1:2], []) AS subthemes,
  CASE WHEN len(t.subthemes) > 0 THEN t.category || ' > ' || array_to_string(t.subthemes[1:2], ', ') ELSE coalesce(t.category, '기타') END AS detail_theme, p.ref_date AS candle_date, p.age AS elapsed_days FROM p LEFT JOIN themes t USING (code) WHERE pos <= 2""",
    ints=("rank",),
)
def q9_dashboard_candle_rows(spark, sf_dir):
    return comments.dashboard_candle_rows(scans.priority_cut(candles(spark, sf_dir)), themes(spark, sf_dir), F.col("scan_date"), 2)


@query(f"WITH {FEATS}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date, strategy ORDER BY abs(rate) DESC, code) AS rank FROM ({C5})) SELECT scan_date, strategy, rank, code, 'n' || code AS name, close, format('{{:+.2f}}%', rate) AS rate, pattern, '기타' AS themes FROM p WHERE rank <= 12", ints=("rank",))
def q10_report_rows_picks(spark, sf_dir):
    top = ranking.top_by_abs_rate(c5(spark, sf_dir), 12, ("scan_date", "strategy")).withColumns({"name": F.concat(F.lit("n"), "code"), "themes": F.lit(joins.OTHER)})
    return comments.report_rows_picks(top)


@query(
    f"""WITH {FEATS}, {REVIEW} SELECT review_date, strategy, hit, row_number() OVER (PARTITION BY review_date, strategy, hit ORDER BY max_profit DESC, code) AS no, code,
  format('{{:+.1f}}%', round_even(max_profit, 1) + 0.0::DOUBLE) AS best, {KIND} || CASE WHEN {TOUCHED} = '' THEN '' ELSE ' (' || {TOUCHED} || ')' END AS review FROM review""",
    ints=("no",),
)
def q11_report_rows_review(spark, sf_dir):
    return comments.report_rows_review(review(spark, sf_dir))


@query(
    f"""WITH {W}, {candle_sql(500, 30000.0)}, {NEAR[len(FEATS) + 2:]}
SELECT scan_date, 1 AS part, code, close, {EVEN_PCT} AS rate, {AGE.format('day_type')} AS day, format('{{:.0f}}%', round_even(vol_ratio, 0)) AS volume, ref_date FROM p500
UNION ALL SELECT dt, 2, code, CAST(close AS BIGINT), {EVEN_PCT.replace('rate', 'round(ret, 6)')}, '이평선', '-', ref_date FROM nearma"""
)
def q12_report_rows_candle(spark, sf_dir):
    return comments.report_rows_candle(candles(spark, sf_dir), near(spark, sf_dir))


@query(f"WITH {W}, {candle_sql(500, 30000.0)} SELECT p.scan_date, p.code, p.close, p.low, p.vol_ratio, p.former_peak, p.p3 AS ma3, round(w.p5, 6) AS ma5, p.p8 AS ma8, round(w.p20, 6) AS ma20, CASE WHEN coalesce(w.p5 > w.ma5, false) THEN 'up' ELSE 'down' END AS ma5_trend, p.t3 AS ma3_trend, p.t8 AS ma8_trend, p.t20 AS ma20_trend FROM p500 p JOIN w ON w.code = p.code AND w.dt = p.scan_date")
def q13_candle_detail_rows(spark, sf_dir):
    return comments.candle_detail_rows(candles(spark, sf_dir))


STATUS = " UNION ALL ".join(
    f"SELECT code, dt, '{n}일선' AS label, round({'p' if n <= 20 else 'ma'}{n}, 6) AS value, CASE WHEN {'p' if n <= 20 else 'ma'}{n} > close THEN 'resistance' ELSE 'support' END AS role, CASE WHEN {'p' if n <= 20 else 'ma'}{n} > {'q' if n <= 20 else 'm'}{n} THEN 'up' ELSE 'down' END AS trend FROM s WHERE {'p' if n <= 20 else 'ma'}{n} > 0"
    for n in (5, 10, 20, 60, 120, 224)
)


@query(f"WITH {FEATS}, s AS (SELECT *, {', '.join(f'{projected_sql(n)} AS p{n}, {projected_sql(n, 1)} AS q{n}' for n in (5, 10, 20))}, {', '.join(f'{lag_sql(f"ma{n}")} AS m{n}' for n in (60, 120, 224))} FROM feats) {STATUS}")
def p15_ma_status_rows(spark, sf_dir):
    cols = {f"p{n}": ind.projected_sma(n) for n in (5, 10, 20)} | {f"ma{n}": ind.sma(n) for n in (60, 120, 224)} | {f"t{n}": ind.sma_trend(n, "commentator") for n in (5, 10, 20, 60, 120, 224)}
    return comments.ma_status_rows(numbered(panel(spark, sf_dir)).withColumns(cols))


@query(f"WITH {FEATS}, p AS ({C5} UNION ALL {C1}), e AS (SELECT scan_date, strategy, code, CAST(scan_date - (SELECT min(scan_date) + 1 FROM p) AS INT) AS d FROM p) SELECT scan_date, strategy, code, greatest(d, -1) AS elapsed, '500 기준봉 ' || {AGE.format('d')} AS label FROM e")
def x5_elapsed_label(spark, sf_dir):
    """Days since the day after the first pick, so that some are before it, with labels."""
    picks = c5(spark, sf_dir).unionByName(c1(spark, sf_dir))
    first = picks.agg(F.date_add(F.min("scan_date"), 1).alias("first"))
    days, label = sc.elapsed_label(F.col("first"), F.col("scan_date"), F.lit("500"))
    return picks.join(F.broadcast(first)).select("scan_date", "strategy", "code", days.alias("elapsed"), label.alias("label"))


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS won, format('{:+.2f}%', (o_orderkey % 1000 - 500) / 8.0::DOUBLE) AS pct FROM orders")
def x10_format_won(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.format_won(F.col("o_totalprice")).alias("won"), sc.signed_pct((F.col("o_orderkey") % 1000 - 500) / F.lit(8.0)).alias("pct"))


@query("SELECT o_orderkey, ['a', 'b', 'c'][CAST((o_orderkey // 7) % 3 AS INT) + 1] AS entry FROM orders")
def x13_pick_template(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.pick_template(["a", "b", "c"], F.col("o_orderkey"), 7).alias("entry"))


def named(spark, sf_dir):
    return c5(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), "code"))


@query(f"WITH {FEATS}, p AS ({C5}) SELECT scan_date, strategy, code, 'n' || code AS name, close, rate, match_type, pattern FROM p")
def f1_write_picks(spark, sf_dir):
    """Picks written by date and strategy, twice, and read back."""
    path, picks = scratch_path(spark, "picks"), stored(named(spark, sf_dir), "found")
    for _ in range(2):
        sinks.write_picks(picks, path)
    return spark.read.schema(schemas.PICK).json(path).select("scan_date", "strategy", "code", "name", "close", "rate", "match_type", "pattern")


FOUND = "scan_date, 'v2' AS strategy, {} AS found_in, code, close, rate, match_type, pattern"


@query(
    f"""WITH {FEATS}, a AS ({C5}), b AS ({C1}), own AS (SELECT * FROM a WHERE day(scan_date) % 2 = 0)
SELECT {FOUND.format("'v2'")} FROM own UNION ALL
SELECT {FOUND.format("''")} FROM b WHERE scan_date IN (SELECT scan_date FROM a) AND scan_date NOT IN (SELECT scan_date FROM own)"""
)
def s11_read_picks_json(spark, sf_dir):
    """Results of every date: a strategy's own file on even days, else the day's default file, which holds the volume surges."""
    fields = ["code", "close", "rate", "match_type", "pattern"]
    path, strong = scratch_path(spark, "results"), stored(c5(spark, sf_dir), "found")
    default = c1(spark, sf_dir).join(strong.select("scan_date").distinct(), "scan_date", "left_semi").withColumn("strategy", F.lit(None).cast("string"))
    sinks.write_dated_arrays(strong.where(F.dayofmonth("scan_date") % 2 == 0).unionByName(default), fields, path)
    return readers.read_results(spark, path, strong, "code string, close bigint, rate double, match_type string, pattern string")


@query(f"WITH {THEMES} SELECT code, list_concat([category], subthemes) AS tags FROM themes")
def s13_read_themes(spark, sf_dir):
    return readers.read_themes(themes(spark, sf_dir)).select("code", "tags")


HISTORY = f"WITH {FEATS}, p AS ({C5}), five AS (SELECT * FROM p WHERE scan_date IN (SELECT DISTINCT scan_date FROM p ORDER BY scan_date DESC LIMIT 5))"


def history_file(spark, sf_dir):
    """The history of the five newest dates, written as JSON."""
    w = Window.partitionBy("scan_date", "strategy").orderBy("code")
    history = ranking.keep_newest_dates(named(spark, sf_dir)).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    path = scratch_path(spark, "history")
    sinks.write_text(sinks.nested_history(history), path)
    return path


@query(f"{HISTORY} SELECT scan_date, strategy, CAST(row_number() OVER (PARTITION BY scan_date ORDER BY code) - 1 AS INT) AS pos, code, 'n' || code AS name, close, rate, match_type, pattern FROM five")
def s14_read_history(spark, sf_dir):
    """The nested history read back to rows."""
    return readers.read_history(spark, history_file(spark, sf_dir))


@query(f"{HISTORY} SELECT strftime(scan_date, '%Y%m%d') AS day, list(code ORDER BY code) AS codes, list(close ORDER BY code) AS closes FROM five GROUP BY scan_date")
def f3_write_history(spark, sf_dir):
    """What the written JSON says, parsed without the reader."""
    days = F.from_json("value", "map<string,map<string,array<struct<code:string,close:bigint>>>>")
    rows = spark.read.text(history_file(spark, sf_dir)).select(F.explode(days).alias("day", "s")).select("day", F.explode("s").alias("strategy", "picks"))
    return rows.select("day", F.col("picks.code").alias("codes"), F.col("picks.close").alias("closes"))


@query(
    f"""WITH {FEATS}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date, strategy ORDER BY code) - 1 AS pos FROM ({C1} UNION ALL {C5}))
SELECT scan_date, strategy, pos, code, 'n' || code AS name, close, rate, match_type, pattern FROM p WHERE pos < 3 AND scan_date IN (SELECT DISTINCT scan_date FROM p ORDER BY scan_date DESC LIMIT 5)""",
    ints=("pos",),
)
def f3_merged_history(spark, sf_dir):
    """The five newest dates of two strategies as one object, the first three picks of each list, read back to rows."""
    w, path = Window.partitionBy("scan_date", "strategy").orderBy("code"), scratch_path(spark, "merged")
    picks = c1(spark, sf_dir).unionByName(c5(spark, sf_dir)).withColumns({"name": F.concat(F.lit("n"), "code"), "pos": F.row_number().over(w) - 1})
    sinks.write_text(sinks.merged_history(picks, most=3), path)
    return readers.read_history(spark, path)


@query(f"WITH {NEAR} SELECT code, ref_date, CAST(close AS BIGINT) AS close FROM nearma")
def s16_read_near_ma_ndjson(spark, sf_dir):
    path = scratch_path(spark, "near")
    rows = near(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), "code"))
    rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.range(1).select(F.lit("").alias("value"))).write.text(path)
    return readers.read_near_ma_ndjson(spark, path).select("code", "ref_date", "close")


@query(
    f"""WITH {W}, {candle_sql(500, 30000.0)}, {NEAR[len(FEATS) + 2:]},
a AS (SELECT scan_date, 'scan_results' AS part, row_number() OVER (PARTITION BY scan_date ORDER BY code) AS pos, code, day_type, CAST(NULL AS BOOLEAN) AS near15 FROM p500),
b AS (SELECT dt AS scan_date, 'ma_stocks' AS part, row_number() OVER (PARTITION BY dt ORDER BY code) AS pos, code, CAST(NULL AS INT) AS day_type, near15 FROM nearma)
SELECT * FROM a UNION ALL SELECT * FROM b""",
    ints=("pos", "day_type"),
)
def f2_write_integrated(spark, sf_dir):
    """The integrated file of every date, written and parsed again."""
    w = Window.partitionBy("scan_date").orderBy("code")
    a = candles(spark, sf_dir).withColumn("pos", F.row_number().over(w)).select("scan_date", "pos", "code", "day_type")
    b = near(spark, sf_dir).withColumn("pos", F.row_number().over(w)).select("scan_date", "pos", "code", "near15")
    path = scratch_path(spark, "integrated")
    sinks.write_integrated(a, b, path)
    parsed = F.from_json("value", "scan_date date, scan_results array<struct<code:string,day_type:int>>, ma_stocks array<struct<code:string,near15:boolean>>")
    files = spark.read.text(path).select(parsed.alias("v")).select("v.*")
    part = lambda name, *cols: files.select("scan_date", F.lit(name).alias("part"), F.posexplode(name).alias("p", "r")).select("scan_date", "part", (F.col("p") + 1).alias("pos"), "r.code", *cols)
    return part("scan_results", "r.day_type", F.lit(None).cast("boolean").alias("near15")).unionByName(part("ma_stocks", F.lit(None).cast("int").alias("day_type"), "r.near15"))


@query(
    f"""{ORACLES["j6_overview"].replace("SELECT l.code", "SELECT 'overview' AS part, l.code", 1).replace(" FROM listing l", ", CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS close, CAST(NULL AS DOUBLE) AS rate FROM listing l", 1)}
UNION ALL SELECT 'latest', code, NULL, NULL, NULL, name, CAST(close AS BIGINT), coalesce(round_even(change, 2), 0) FROM listing"""
)
def f4_write_snapshots(spark, sf_dir):
    """Overview and latest prices written as published, twice, and read again."""
    path, rows = scratch_path(spark, "snapshots"), listing(spark, sf_dir)
    for _ in range(2):
        sinks.write_snapshots(j6_overview(spark, sf_dir), universe.latest_price_snapshot(rows), path)
    overview = readers.read_keyed(spark, f"{path}/{sinks.OVERVIEW_FILE}", schemas.OVERVIEW).withColumn("part", F.lit("overview"))
    latest = readers.read_keyed(spark, f"{path}/{sinks.LATEST_FILE}", schemas.LATEST_PRICE).withColumn("part", F.lit("latest"))
    return overview.unionByName(latest, allowMissingColumns=True)


@query(f"WITH {STATEMENTS} SELECT * EXCLUDE (r) FROM st")
def f5_write_financials(spark, sf_dir):
    """The years of each code written as JSON, and read again."""
    path = scratch_path(spark, "financials")
    sinks.write_keyed(sinks.yearly_json(financials.financial_statement_long(filings(spark, sf_dir))), path)
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<struct<year:int,revenue:bigint,operating_profit:bigint,net_income:bigint>>>")).alias("code", "years"))
    return rows.select("code", F.explode("years").alias("y")).select("code", "y.*")


@query(f"WITH {FEATS}, p AS ({C1} UNION ALL {C5}) SELECT scan_date, strategy, code, close FROM p WHERE (strategy, scan_date) IN (SELECT (strategy, max(scan_date)) FROM p GROUP BY strategy)")
def f6_publish_latest(spark, sf_dir):
    """The newest result of each strategy under latest/, twice, and read again."""
    path = scratch_path(spark, "published")
    picks = stored(c1(spark, sf_dir).unionByName(c5(spark, sf_dir)), "found")
    for _ in range(2):
        sinks.write_latest(picks, path)
    return sinks.latest_store(spark, path, "scan_date date, strategy string, code string, close bigint").read()


@query("SELECT conv_id, list(role ORDER BY turn)[1:3] AS roles FROM conversations GROUP BY conv_id")
def o6_first_items(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", ranking.first_items(F.transform("t", lambda x: x["role"]), 3).alias("roles"))


@query(
    f"""WITH {FEATS}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date, strategy ORDER BY abs(rate) DESC, code) AS rank FROM ({C1} UNION ALL {C5}))
SELECT scan_date, lower(strategy) AS technique, rank - 1 AS pos, code, '' AS name, close, round_even(rate, 2) AS rate, pattern, pattern AS comment, 'charts/' || strftime(scan_date, '%Y%m%d') || '/' || code || '.png' AS chart FROM p WHERE rank <= 3""",
    ints=("pos",),
)
def f7_write_dashboard(spark, sf_dir):
    """The dashboard files of two strategies and all dates, the newest five written again, read back."""
    picks = c1(spark, sf_dir).unionByName(c5(spark, sf_dir)).withColumns({"name": F.lit(None).cast("string"), "comment": F.col("pattern")})
    rows, path = comments.dashboard_rows(picks, themes(spark, sf_dir), 3), scratch_path(spark, "dashboard")
    rows = stored(rows.withColumn("strategy", F.concat(F.lit("차트_"), F.upper("strategy"), F.lit("_기법"))), "ranked")
    sinks.write_dashboard(rows, path)
    sinks.write_dashboard(ranking.keep_newest_dates(rows), path)
    return readers.read_dashboard(spark, path)
